"""The registered queries of this subpackage, each over its whole table, and SQL where it can express one."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm.bytetokens import byte_token_round_trip
from rasterloom.llm.common import fold, hash_sample, table
from rasterloom.llm.conversations import damaged, repaired_conversations
from rasterloom.llm.embeddings import embedding_components
from rasterloom.llm.importance import importance_draw
from rasterloom.llm.language import fit_language, identify_language
from rasterloom.llm.lm import lm_scores
from rasterloom.llm.media import text_media
from rasterloom.llm.packing import best_fit_packing
from rasterloom.llm.quality import SAMPLE, fit_voters, quality_scores
from rasterloom.llm.sentencepieces import sentencepiece_round_trip
from rasterloom.llm.simhash import simhash_components
from rasterloom.llm.tokencounts import token_counts
from rasterloom.llm.urlfilter import url_verdicts

RULES = "('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')"


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"), 4, 4)


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_language(docs.where(~fold("doc_id", 4).eqNullSafe(2)).select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("label")))
    found = identify_language(docs.select("doc_id", "text"), model)
    return found.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2048)


def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_components(table(spark, sf_dir, "embeddings"), 0.98)


def labelled_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows to learn quality from: a label by document, without those held out. At most SAMPLE labels, by the hash of
    the id, are broadcast, so that no text is shuffled."""
    known = labels.where(F.col("quality").isNotNull() & ~F.coalesce(fold("doc_id", 5) == 0, F.lit(True))).groupBy("doc_id").agg(F.max("quality").alias("label"))
    some = hash_sample(known, SAMPLE, "doc_id")
    return docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select(F.col("doc_id").alias("id"), "text", "label")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    voters = fit_voters(labelled_quality(docs, table(spark, sf_dir, "labels")))
    found = quality_scores(docs.select("doc_id", "text"), voters, 0.3)
    return found.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"), "crc32(cast(cast(doc_id as string) as binary)) % 7 = 2")


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_media(table(spark, sf_dir, "documents"))


def op9_tokencounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), 4096)


def op10_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql(f"SELECT * FROM VALUES {RULES} AS rules(verdict, host, path)")
    return url_verdicts(table(spark, sf_dir, "pages").select("page_id", "url"), rules)


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_draw(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return repaired_conversations(damaged(turns), ids=turns)


def op13_bytetokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_token_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: CRC-32 in SQL: the register is linear in its input, so a string's is the exclusive or of what each byte gives, by its
#: distance from the end, and of what its length gives. `keys(s)` must be there; `crc(s, crc)` follows.
CRC = """
        steps AS (SELECT max(strlen(s)) AS n FROM keys),
        turned(b, v, k) AS (SELECT b, b, 0 FROM range(256) t(b) UNION ALL SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM turned WHERE k < 8),
        bytes AS (SELECT b, v FROM turned WHERE k = 8),
        gives(d, b, v) AS (SELECT 0, b, v FROM bytes UNION ALL SELECT d + 1, g.b, xor(g.v >> 8, t.v) FROM gives g JOIN bytes t ON t.b = g.v & 255 WHERE d + 1 < (SELECT n FROM steps)),
        starts(n, v) AS (SELECT 0, 4294967295 UNION ALL SELECT n + 1, xor(s.v >> 8, t.v) FROM starts s JOIN bytes t ON t.b = s.v & 255 WHERE n < (SELECT n FROM steps)),
        places AS (SELECT s, hex(encode(s)) AS h, unnest(range(strlen(s))) AS i FROM keys),
        mixed AS (SELECT s, bit_xor(v) AS v FROM places JOIN gives ON d = strlen(s) - 1 - i AND b = ('0x' || substr(h, 2 * i + 1, 2))::BIGINT GROUP BY s),
        crc AS (SELECT keys.s, xor(xor(starts.v, coalesce(mixed.v, 0)), 4294967295) AS crc FROM keys JOIN starts ON n = strlen(keys.s) LEFT JOIN mixed ON mixed.s = keys.s)"""

QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_simhash": op2_simhash,
    "op3_language": op3_language,
    "op4_packing": op4_packing,
    "op5_embeddings": op5_embeddings,
    "op6_quality": op6_quality,
    "op7_lm": op7_lm,
    "op8_media": op8_media,
    "op9_tokencounts": op9_tokencounts,
    "op10_urlfilter": op10_urlfilter,
    "op11_importance": op11_importance,
    "op12_conversations": op12_conversations,
    "op13_bytetokens": op13_bytetokens,
}

SQL = {
    "op5_embeddings": """
        WITH RECURSIVE usable AS (
            SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), links AS MATERIALIZED (
            SELECT a.vec_id AS u, b.vec_id AS v FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id
            WHERE list_cosine_similarity(a.v, b.v) >= 0.98
        ), reach AS (
            SELECT vec_id, vec_id AS root FROM embeddings
            UNION
            SELECT links.v, reach.root FROM reach JOIN links ON links.u = reach.vec_id WHERE reach.root < links.v
        )
        SELECT e.vec_id, (SELECT count(*) FROM links WHERE u = e.vec_id) AS n_links, r.root AS component_id, e.vec_id = r.root AS kept
        FROM embeddings e JOIN (SELECT vec_id, min(root) AS root FROM reach GROUP BY vec_id) r ON r.vec_id = e.vec_id
    """,
    "op10_urlfilter": r"""
        WITH parts AS (
            SELECT page_id,
                   translate(coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path
            FROM pages
        ), judged AS (
            SELECT *, CASE
                WHEN ends_with('.' || host, '.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
                WHEN ends_with('.' || host, '.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
                WHEN ends_with('.' || host, '.net') AND starts_with(path, '/es/') THEN 'net/es/'
                WHEN ends_with('.' || host, '.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
                WHEN ends_with('.' || host, '.com') AND starts_with(path, '/') THEN 'com/'
            END AS rule
            FROM parts
        )
        SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict
        FROM judged
    """,
    "op11_importance": rf"""
        WITH RECURSIVE texts AS (SELECT 0 AS part, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark),
        split AS (SELECT part, id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
        words AS (SELECT part, id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM split),
        runs AS (SELECT part, id, word AS s FROM words
            UNION ALL SELECT part, id, word || ' ' || after FROM (SELECT *, lead(word) OVER (PARTITION BY part, id ORDER BY i) AS after FROM words) WHERE after IS NOT NULL),
        keys AS (SELECT DISTINCT s FROM runs), {CRC},
        found AS MATERIALIZED (SELECT part, id, crc % 10000 AS bucket FROM runs JOIN crc USING (s)),
        counts AS (SELECT b AS bucket, count(*) FILTER (part = 0)::DOUBLE AS s, count(*) FILTER (part = 1)::DOUBLE AS t FROM range(10000) r(b) LEFT JOIN found ON bucket = b GROUP BY b),
        sums AS (SELECT sum(s) AS s_all, sum(t) AS t_all FROM counts),
        gains AS (SELECT bucket, floor(1000 * ln((t + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000))))::BIGINT AS gain FROM counts, sums),
        weights AS (SELECT id, count(*) AS n_features, sum(gain)::BIGINT AS total FROM found JOIN gains USING (bucket) WHERE part = 0 GROUP BY id),
        scored AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(total // n_features - CASE WHEN total % n_features < 0 THEN 1 ELSE 0 END, 0) AS weight
            FROM documents LEFT JOIN weights ON id = doc_id),
        noisy AS (SELECT *, weight + floor(-1000 * ln(-ln((('0x' || sha256('7:' || doc_id)[:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM scored),
        ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM noisy WHERE n_features >= 39)
        SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 25 * (SELECT count(*) FROM ranked) // 100 THEN rank END AS rank FROM noisy LEFT JOIN ranked USING (doc_id)
    """,
    "op12_conversations": rf"""
        WITH RECURSIVE keys AS (SELECT DISTINCT coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS s FROM conversations), {CRC},
        marked AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, crc % 20 AS k FROM conversations
            JOIN crc ON s = coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')),
        damaged AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
            FROM marked, range(2) c(copy) WHERE k <> 0 AND (copy = 0 OR k = 3)),
        numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM damaged),
        judged AS (SELECT *, rtrim(text, E' \t\n\x0b\x0c\r') AS bare, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS seen, lag(role[:1]) OVER (PARTITION BY conv_id ORDER BY n) AS before FROM numbered),
        rows AS (SELECT *, CASE WHEN bare = '' THEN 1 WHEN seen THEN 2 WHEN bare[-1:] NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault FROM judged),
        facts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
            count(*) FILTER (before IS NOT NULL AND before || role[:1] NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM rows GROUP BY conv_id),
        run(conv_id, n, o, s, u, a) AS (
            SELECT conv_id, 0::BIGINT, {{'c': 0, 'e': '', 't': []::VARCHAR[]}}, {{'c': 1000000, 'e': '', 't': []::VARCHAR[]}}, {{'c': 5, 'e': 'I', 't': ['user:']}}, {{'c': 10, 'e': 'II', 't': ['user:', 'assistant:']}} FROM facts
            UNION ALL
            SELECT conv_id, n, o, s, u, list_min([a, {{'c': u.c + 5, 'e': u.e || 'I', 't': list_append(u.t, 'assistant:')}}]) FROM (
                SELECT conv_id, n, o, s, list_min([u] || list_transform([o, s, a], lambda x: {{'c': x.c + 5, 'e': x.e || 'I', 't': list_append(x.t, 'user:')}})) AS u, a FROM (
                    SELECT r.conv_id, r.n,
                        {{'c': o.c + 2, 'e': o.e || 'D', 't': o.t}} AS o,
                        list_min([{{'c': s.c + 2, 'e': s.e || 'D', 't': s.t}}, {{'c': o.c + CASE WHEN fault IN (1, 2) OR role[:1] <> 's' THEN 1000000 ELSE 5 * (fault = 3)::INTEGER END, 'e': o.e || 'K', 't': list_append(o.t, role || ':' || text)}}]) AS s,
                        list_min([{{'c': u.c + 2, 'e': u.e || 'D', 't': u.t}}]
                            || list_transform([o, s, a], lambda x: {{'c': x.c + CASE WHEN fault IN (1, 2) OR role[:1] <> 'u' THEN 1000000 ELSE 5 * (fault = 3)::INTEGER END, 'e': x.e || 'K', 't': list_append(x.t, role || ':' || text)}})
                            || list_transform([o, s, a], lambda x: {{'c': x.c + CASE WHEN fault IN (1, 2) THEN 1000000 ELSE 1 + 5 * (fault = 3)::INTEGER END, 'e': x.e || 'R', 't': list_append(x.t, 'user:' || text)}})) AS u,
                        list_min([{{'c': a.c + 2, 'e': a.e || 'D', 't': a.t}},
                            {{'c': u.c + CASE WHEN fault IN (1, 2) OR role[:1] <> 'a' THEN 1000000 ELSE 5 * (fault = 3)::INTEGER END, 'e': u.e || 'K', 't': list_append(u.t, role || ':' || text)}},
                            {{'c': u.c + CASE WHEN fault IN (1, 2) THEN 1000000 ELSE 1 + 5 * (fault = 3)::INTEGER END, 'e': u.e || 'R', 't': list_append(u.t, 'assistant:' || text)}}]) AS a
                    FROM run JOIN rows r ON r.conv_id IS NOT DISTINCT FROM run.conv_id AND r.n = run.n + 1))),
        ended AS (SELECT run.conv_id, list_min([o, a]) AS best FROM run JOIN facts ON facts.conv_id IS NOT DISTINCT FROM run.conv_id AND facts.n = run.n)
        SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
            coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.e, '') AS audit, sha256(coalesce(array_to_string(best.t, chr(10)), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN facts ON facts.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN ended ON ended.conv_id IS NOT DISTINCT FROM c.conv_id
    """,
}
