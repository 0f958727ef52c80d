"""Queries of the library's own operators over the test tables, and the SQL that checks them.

The tables hold no images, so a mask stands for each supplier: its line items are pixels of a 640 x 480 image.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rasterloom import config
from rasterloom.functions import text as T
from rasterloom.operators import cache, metrics, patches, progress, raster, requests, tiles, workflow
from rasterloom.scratch import forget, fresh_folder, written
from rasterloom.sources import backend as remote
from rasterloom.sources import frames
from rasterloom.streaming import runs

WIDTH, HEIGHT = 640, 480
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

PIXELS = "pixels AS (SELECT l_suppkey AS id, l_partkey % 640 AS x, l_orderkey % 480 AS y, (l_linenumber * 37) % 256 AS v FROM lineitem)"
BOX = """SELECT id, greatest(0, min(x) - 16)::INTEGER AS x0, greatest(0, min(y) - 16)::INTEGER AS y0,
    least(640, max(x) + 17)::INTEGER AS x1, least(480, max(y) + 17)::INTEGER AS y1 FROM pixels WHERE v > {} GROUP BY id"""


def query(sql: str | None = None) -> Callable:
    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mask_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("id"), (F.col("l_partkey") % WIDTH).alias("x"), (F.col("l_orderkey") % HEIGHT).alias("y"), ((F.col("l_linenumber") * 37) % 256).alias("v")
    )


@query(f"WITH {PIXELS} {BOX.format(0)}")
def mask_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.mask_boxes(mask_pixels(spark, sf_dir), WIDTH, HEIGHT)


@query(f"""WITH {PIXELS}, box AS ({BOX.format(200)}), ids AS (SELECT DISTINCT id FROM pixels)
    SELECT ids.id, coalesce(x0, 0)::INTEGER AS x, coalesce(y0, 0)::INTEGER AS y, coalesce(x1 - x0, 1)::INTEGER AS width, coalesce(y1 - y0, 1)::INTEGER AS height
    FROM ids LEFT JOIN box ON box.id = ids.id""")
def mask_bbox_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = mask_pixels(spark, sf_dir)
    return raster.boxes_or_default(pixels.select("id").distinct(), raster.mask_boxes(pixels, WIDTH, HEIGHT, least=200))


@query(f"""WITH {PIXELS}, gx AS (SELECT d::INTEGER AS dx, least(639, floor((d + 0.5) * 640 / 100))::BIGINT AS x FROM range(100) t(d)),
    gy AS (SELECT d::INTEGER AS dy, least(479, floor((d + 0.5) * 480 / 75))::BIGINT AS y FROM range(75) t(d))
    SELECT id, dx, dy, count(*) AS n, sum(v)::BIGINT AS total FROM pixels JOIN gx USING (x) JOIN gy USING (y) GROUP BY id, dx, dy""")
def nearest_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    small = raster.resize_nearest(mask_pixels(spark, sf_dir), (WIDTH, HEIGHT), (100, 75))
    return small.groupBy("id", F.col("x").alias("dx"), F.col("y").alias("dy")).agg(F.count("*").alias("n"), F.sum("v").alias("total"))


@query("""SELECT l_orderkey, l_linenumber,
    ((((l_orderkey % 256) * 19595 + (l_partkey % 256) * 38470 + (l_suppkey % 256) * 7471 + 32768) // 65536))::INTEGER AS grey FROM lineitem""")
def luma_gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, g, b = (F.col(c) % 256 for c in ("l_orderkey", "l_partkey", "l_suppkey"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", raster.luma(r, g, b).alias("grey"))


@query(f"WITH {PIXELS} SELECT id, x, y, v, (255 - v) * CAST(100 AS DOUBLE) / 255 AS inverted FROM pixels")
def alpha_invert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mask_pixels(spark, sf_dir).withColumn("inverted", raster.inverted_alpha(F.col("v")))


@query(f"WITH {PIXELS} SELECT id, x, y, 0 AS r, 0 AS g, 0 AS b, v AS a FROM pixels")
def alpha_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.alpha_mask(mask_pixels(spark, sf_dir))


@query(f"""WITH {PIXELS}, box AS ({BOX.format(128)})
    SELECT pixels.id, x - x0 AS x, y - y0 AS y, v FROM pixels JOIN box ON box.id = pixels.id WHERE x >= x0 AND x < x1 AND y >= y0 AND y < y1""")
def crop_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = mask_pixels(spark, sf_dir)
    return raster.crop(pixels, raster.mask_boxes(pixels, WIDTH, HEIGHT, least=128))


@query("""SELECT p_partkey, concat_ws(', ', nullif(CASE WHEN p_size % 3 = 0 THEN '' ELSE p_name END, ''), nullif(CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_type END, '')) AS prompt FROM part""")
def prompt_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", T.merge_prompt(given, F.when(F.col("p_size") % 5 != 0, F.col("p_type"))).alias("prompt"))


@query("SELECT event_id, coalesce(nullif(user_id % 5, 0), epoch(ts)::BIGINT) AS seed FROM (SELECT event_id, user_id, date_trunc('second', ts) AS ts FROM events)")
def seed_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", T.default_seed(F.col("user_id") % 5, F.col("ts")).alias("seed"))


@query("SELECT page_id, replace(replace(url, '/', '\\'), '\\', '/') AS path FROM pages")
def path_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.normal_path(F.replace("url", F.lit("/"), F.lit("\\"))).alias("path"))


@query(r"""SELECT page_id, coalesce(nullif(regexp_extract(split_part(split_part(url, '#', 1), '?', 1), '[^/.][^/]*?(\.[^./]*)$', 1), ''), '.png') AS ext FROM pages""")
def ext_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    bare = F.split_part(F.split_part("url", F.lit("#"), F.lit(1)), F.lit("?"), F.lit(1))
    return table(spark, sf_dir, "pages").select("page_id", T.extension(bare).alias("ext"))


@query("""WITH log AS (SELECT event_id, user_id, row_number() OVER (ORDER BY ts, event_id) AS n FROM events),
    earlier AS (SELECT *, lag(n) OVER (PARTITION BY user_id ORDER BY n) AS before FROM log)
    SELECT e.event_id, e.user_id, e.before IS NOT NULL AND
        (SELECT count(DISTINCT o.user_id) FROM log o WHERE o.n > e.before AND o.n < e.n) < 20 AS hit
    FROM earlier e""")
def cache_lru_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return cache.replay_accesses(log, "user_id", "ts", "event_id", 20).select("event_id", "user_id", "hit")


@query("""SELECT doc_id, n_chars FROM (
        SELECT doc_id, n_chars, sum(n_chars) OVER (ORDER BY doc_id DESC ROWS UNBOUNDED PRECEDING) AS running
        FROM (SELECT doc_id, n_chars, row_number() OVER (ORDER BY doc_id DESC) AS rn FROM documents) WHERE rn <= 19
    ) WHERE running <= 50000""")
def cache_evict_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return cache.kept_after_limits(docs, [F.desc("doc_id")], "n_chars", 20, 50_000)


@query("SELECT user_id, max_by(event_id, (ts, event_id)) AS event_id, max(ts) AS last_access FROM events GROUP BY user_id")
def cache_resync(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.latest(table(spark, sf_dir, "events").select("user_id", "event_id", "ts"), "user_id", "ts", ["event_id"])


PART_GRAPH = """edges(src, dst) AS (SELECT p_partkey, p_partkey // 2 FROM part WHERE p_partkey >= 2 UNION SELECT p_partkey, p_partkey // 3 FROM part WHERE p_partkey >= 3),
    nodes AS (SELECT src AS node_id FROM edges UNION SELECT dst FROM edges)"""


def part_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Each part points to those with half and a third of its number: many paths lead to the low ones."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("src"))
    edges = parts.where("src >= 2").selectExpr("src", "src div 2 AS dst").union(parts.where("src >= 3").selectExpr("src", "src div 3 AS dst"))
    return edges, edges.select(F.col("src").alias("node_id")).union(edges.select("dst")).distinct()


@query(f"""WITH RECURSIVE {PART_GRAPH}, walk(node_id, depth) AS (
        SELECT node_id, 0 FROM nodes WHERE node_id NOT IN (SELECT dst FROM edges)
        UNION SELECT e.dst, w.depth + 1 FROM walk w JOIN edges e ON e.src = w.node_id)
    SELECT node_id, max(depth) AS depth FROM walk GROUP BY node_id""")
def dag_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflow.depths(*part_graph(spark, sf_dir))


@query(f"WITH {PART_GRAPH} SELECT node_id FROM nodes WHERE node_id NOT IN (SELECT src FROM edges)")
def dag_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflow.sinks(*part_graph(spark, sf_dir))


@query("SELECT event_id, (props ->> '$.k')::BIGINT AS k FROM events")
def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("""SELECT s.user_id::VARCHAR AS prompt_id, s.ts, min(p.ts) AS done_at FROM (SELECT user_id, min(ts) AS ts FROM events WHERE event_type = 'signup' GROUP BY user_id) s
    LEFT JOIN events p ON p.user_id = s.user_id AND p.event_type = 'purchase' AND p.ts >= s.ts GROUP BY s.user_id, s.ts""")
def completion_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's first signup stands for a submitted run; purchases, for its end messages."""
    events = table(spark, sf_dir, "events").withColumn("prompt_id", F.col("user_id").cast("string"))
    submitted = events.where("event_type = 'signup'").groupBy("prompt_id").agg(F.min("ts").alias("ts"))
    messages = events.where("event_type = 'purchase'").select("prompt_id", "ts", F.lit("executing").alias("type"), F.lit(None).cast("string").alias("node"))
    return progress.completion(submitted, messages)


@query("""SELECT event_id::VARCHAR AS prompt_id, CASE WHEN user_id % 4 <> 0 AND user_id % 4 <> 3 THEN 'f' || event_id END AS filename,
    CASE WHEN user_id % 4 <> 0 AND user_id % 4 <> 3 THEN event_type END AS subfolder, CASE WHEN user_id % 4 <> 0 AND user_id % 4 <> 3 THEN 'output' END AS type,
    CASE user_id % 4 WHEN 0 THEN 'no output images' WHEN 3 THEN 'empty list of images' END AS error FROM events""")
def first_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histories made of events: some runs have no images, some an empty list, some two nodes with images."""
    image = F.concat(F.lit('{"filename":"f'), "event_id", F.lit('","subfolder":"'), "event_type", F.lit('","type":"output"}'))
    first = F.when(F.col("user_id") % 4 == 0, F.lit('"9":{}')).when(F.col("user_id") % 4 == 3, F.lit('"9":{"images":[]}')).otherwise(F.concat(F.lit('"9":{"text":[1]},"5":{"images":['), image, F.lit('],"n":2},"1":{"images":[{"filename":"z","subfolder":"","type":"temp"}]}')))
    history = F.concat(F.lit('{"'), "event_id", F.lit('":{"outputs":{'), first, F.lit('},"status":{"done":true}}}'))
    return progress.first_images(table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("prompt_id"), history.alias("history")))


@query("SELECT 'last_sent_image.' || event_type AS name, max_by(event_id, ts) AS payload, max(ts) AS ts FROM events GROUP BY event_type")
def debug_last_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return requests.last_sent(events.select(F.concat(F.lit("in/x."), "event_type").alias("path"), F.col("event_id").alias("payload"), "ts"))


@query("SELECT event_id, '/' || event_type AS path FROM events WHERE user_id % 4 >= 3 AND event_type <> 'view'")
def access_log_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as log records with up to three arguments; views stand for health checks."""
    path = F.concat(F.lit("/"), "event_type")
    full = F.array(F.lit("host"), F.lit("GET"), F.when(F.col("event_type") == "view", "/health").otherwise(path))
    log = table(spark, sf_dir, "events").select("event_id", path.alias("path"), F.slice(full, F.lit(1), (F.col("user_id") % 4).cast("int")).alias("args"))
    return requests.access_lines(log).select("event_id", "path")


@query("SELECT doc_id, to_base64(encode(text)) AS packed FROM documents")
def base64_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.pack_base64(F.col("text").cast("binary")).alias("packed"))


@query("SELECT page_id, html AS text FROM pages")
def base64_unpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = T.pack_base64(F.col("html").cast("binary"))
    return table(spark, sf_dir, "pages").select("page_id", F.decode(T.unpack_base64(packed), "UTF-8").alias("text"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def source_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return cache.live(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), index, "o_custkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def source_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return cache.stale(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), index, "o_custkey")


@query(f"""WITH {PIXELS}, one AS (SELECT id, x, y, max(v) AS v FROM pixels GROUP BY id, x, y)
    SELECT id, x, y, CASE WHEN v / 255.0::DOUBLE > 0.5 THEN 0 ELSE v END AS v FROM one""")
def composite_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Black where the mask is over a half, by a thresholded copy of the pixels as mask."""
    pixels = mask_pixels(spark, sf_dir).groupBy("id", "x", "y").agg(F.max("v").alias("v"))
    black = pixels.withColumn("v", F.lit(0))
    return raster.composite(pixels, black, raster.threshold(pixels))


@query("""SELECT user_id % 100 AS request_id, event_type AS stage, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0::DOUBLE AS seconds FROM events GROUP BY ALL""")
def stage_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return requests.stage_times(events.select((F.col("user_id") % 100).alias("request_id"), F.col("event_type").alias("stage"), "ts"))


@query("""SELECT CASE WHEN stage IN ('signup', 'purchase', 'error') THEN stage END AS stage, count(*) AS n, sum(micros)::BIGINT AS micros, max(micros) AS longest
    FROM (SELECT user_id % 100 AS request_id, event_type AS stage, epoch_us(max(ts)) - epoch_us(min(ts)) AS micros FROM events GROUP BY ALL) GROUP BY 1""")
def stage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of stages, told while their times are written."""
    figures = metrics.StageFigures(["signup", "purchase", "error"])
    times, told = metrics.watched(stage_times(spark, sf_dir), figures)
    forget(written(times))
    figures.add(told.get)
    return figures.table(spark)


@query("""SELECT event_id, CASE user_id % 5 WHEN 0 THEN 200 WHEN 1 THEN 422 WHEN 2 THEN 404 WHEN 3 THEN 502 ELSE 500 END AS status_code FROM events""")
def error_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(F.lit(None), *[F.lit(x) for x in ("invalid", "not_found", "connection", "image")]), (F.col("user_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", requests.status_code(kind).alias("status_code"))


@query("""SELECT n_nationkey, '0.0.0.0' AS host, CASE WHEN n_nationkey % 2 = 1 THEN 5000 + n_nationkey ELSE 5000 END::BIGINT AS port, '127.0.0.1' AS backend_host, 5545::BIGINT AS backend_port,
        dir AS cache_dir, 'workflow.json' AS workflow_file, 20::BIGINT AS max_cache_files, mb AS max_cache_size_mb, dir || '/sources' AS source_dir, dir || '/sent' AS sent_dir,
        mb * 1048576 AS max_cache_bytes, 'http://127.0.0.1:5545' AS http_url, 'ws://127.0.0.1:5545/ws' AS ws_url
    FROM (SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN '/data/' || n_name ELSE './cache' END AS dir, CASE WHEN n_nationkey % 5 = 0 THEN n_nationkey + 1 ELSE 2048 END::BIGINT AS mb FROM nation)""")
def settings_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deployment for each nation, some of whose settings are given."""
    nations = table(spark, sf_dir, "nation")
    one = lambda when, name, value: F.when(when, F.struct(F.lit(name).alias("name"), value.cast("string").alias("value")))
    key = F.col("n_nationkey")
    given = F.array(one(key % 2 == 1, "port", key + 5000), one(key % 3 == 0, "cache_dir", F.concat(F.lit("/data/"), "n_name")), one(key % 5 == 0, "max_cache_size_mb", key + 1), one(key >= 0, "unknown", key))
    return config.resolved(nations.select("n_nationkey", F.inline(F.array_compact(given))), "n_nationkey")


@query("SELECT 'error' AS status, 'http://127.0.0.1:5545' AS url, false AS connected UNION ALL SELECT 'ok', 'http://127.0.0.1:5545', true")
def health_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A backend that answers and one that doesn't."""
    settings = config.Settings()
    return requests.health(spark, settings, lambda url: 1 // 0).union(requests.health(spark, settings, len))


SOURCES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@query(f"SELECT unnest(string_split('{SOURCES}', ' ')) AS source_id")
def folder_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The folder of the test tables as a cache's folder: a source for each file's stem."""
    return cache.blob_index(spark, sf_dir).select("source_id")


@query("""SELECT event_id, CASE WHEN user_id % 3 = 0 THEN NULL ELSE event_type END AS prompt, CASE WHEN user_id % 4 = 0 THEN 'blur, low quality, distortion, watermark' ELSE '' END AS negative_prompt,
        CASE WHEN user_id % 5 = 0 THEN 0 ELSE user_id END AS seed,
        CASE WHEN user_id % 7 = 0 AND user_id % 3 = 0 THEN 'missing: source_id, prompt' WHEN user_id % 7 = 0 THEN 'missing: source_id' WHEN user_id % 3 = 0 THEN 'missing: prompt' END AS invalid
    FROM events""")
def request_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.col("user_id")
    sent = table(spark, sf_dir, "events").select(
        "event_id", F.when(user % 7 != 0, F.lit("s")).alias("source_id"), F.when(user % 3 != 0, F.col("event_type")).alias("prompt"),
        F.when(user % 4 != 0, F.lit("")).alias("negative_prompt"), F.lit("AAAA").alias("mask_image_base64"), F.when(user % 5 != 0, user).alias("seed"),
    )
    return requests.with_defaults(sent).select("event_id", "prompt", "negative_prompt", "seed", "invalid")


@query("""SELECT page_id::VARCHAR AS source_id, 'cached' AS status, 'cache/sources/' || page_id || CASE WHEN page_id % 3 = 0 THEN '.jpeg' ELSE '.png' END AS path, strlen(html)::BIGINT AS length FROM pages""")
def upload_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as uploads; a third has a name with an extension."""
    sent = table(spark, sf_dir, "pages").select(
        F.col("page_id").cast("string").alias("source_id"), F.when(F.col("page_id") % 3 == 0, "a.b/photo.x.jpeg").when(F.col("page_id") % 3 == 1, "a.b/photo").alias("filename"), F.col("html").cast("binary").alias("content")
    )
    return requests.uploads(sent, "cache/sources").select("source_id", "status", "path", F.octet_length("content").cast("long").alias("length"))


@query("""SELECT event_id, CASE WHEN user_id % 3 = 0 THEN 'server' WHEN user_id % 3 = 1 THEN 'engine' ELSE 'app' END AS label FROM events WHERE event_type IN ('click', 'error', 'view')""")
def log_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as log records: clicks are infos, errors errors, views warnings, all else is below."""
    level = F.when(F.col("event_type") == "click", "INFO").when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "view", "WARNING").otherwise("DEBUG")
    logger = F.when(F.col("user_id") % 3 == 0, "web").when(F.col("user_id") % 3 == 1, "core").otherwise("other")
    log = table(spark, sf_dir, "events").select("event_id", level.alias("level"), logger.alias("logger"))
    return requests.labelled(log, {"web": "server", "core": "engine"}).select("event_id", "label")


@query("SELECT r_regionkey AS id, x::INTEGER AS x, y::INTEGER AS y, 7 AS v FROM region, range(8) a(x), range(5) b(y)")
def blank_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.blank(table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("id")), 8, 5, 7)


@query(f"WITH {PIXELS} SELECT id, x, y, 255 - v AS v FROM pixels")
def invert_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.invert(mask_pixels(spark, sf_dir))


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_type END AS type, CASE WHEN event_id % 5 = 0 OR user_id % 2 = 0 THEN NULL ELSE user_id::VARCHAR END AS node,
        CASE WHEN event_id % 5 = 0 THEN NULL ELSE 'p' || event_id END AS prompt_id FROM events WHERE event_id % 7 <> 0""")
def message_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as frames of a socket: some are binary and have no text, some aren't JSON, some have no node."""
    node = F.when(F.col("user_id") % 2 == 0, "null").otherwise(F.concat(F.lit('"'), "user_id", F.lit('"')))
    text = F.concat(F.lit('{"type":"'), "event_type", F.lit('","data":{"node":'), node, F.lit(',"prompt_id":"p'), "event_id", F.lit('","more":[1]}}'))
    frames = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 7 == 0, None).when(F.col("event_id") % 5 == 0, "hello").otherwise(text).alias("value"))
    return progress.parse_messages(frames).drop("value")


TEMPLATE = """{"28": {"class_type": "Sampler", "inputs": {"seed": 1, "model": ["4", 0]}, "_meta": {"title": "s"}}, "7": {"class_type": "Text", "inputs": {"text": "base", "clip": ["4", 1]}},
    "8": {"class_type": "Text", "inputs": {"text": "", "clip": ["4", 1]}}, "30": {"class_type": "Load", "inputs": {"image": "x"}}, "47": {"class_type": "Load", "inputs": {}}, "4": {"class_type": "Model", "inputs": {"name": "é"}}}"""


@query("""SELECT event_id, user_id % 3 AS seed, CASE WHEN user_id % 4 = 0 THEN 'base' ELSE 'a "' || event_type || '", base' END AS prompt, event_type AS negative_prompt,
        'in/s' || user_id || '.png' AS source_path, 'mask_' || event_id || '.png' AS mask_path, 'é' AS kept, '4' AS model FROM events""")
def workflow_bind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request for each event, bound into a template and read back from the document's JSON."""
    asked = table(spark, sf_dir, "events").select(
        "event_id", (F.col("user_id") % 3).alias("seed"), F.when(F.col("user_id") % 4 == 0, "").otherwise(F.concat(F.lit('a "'), "event_type", F.lit('"'))).alias("prompt"), F.col("event_type").alias("negative_prompt"),
        F.concat(F.lit("in\\s"), "user_id", F.lit(".png")).alias("source_path"), F.concat(F.lit("mask_"), "event_id", F.lit(".png")).alias("mask_path"),
    )
    at = lambda path: F.get_json_object("workflow", f"$.{path}")
    return workflow.bind(asked, TEMPLATE).select(
        "event_id", at("28.inputs.seed").cast("long").alias("seed"), at("7.inputs.text").alias("prompt"), at("8.inputs.text").alias("negative_prompt"),
        at("30.inputs.image").alias("source_path"), at("47.inputs.image").alias("mask_path"), at("4.inputs.name").alias("kept"), at("28.inputs.model[0]").alias("model"),
    )


def order_workflows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document (o, text) for each order: a node for each line item, which takes an output of the one before it."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")).alias("k"))
    link = F.when(F.col("k") > 1, F.concat(F.lit(',"from":["n'), F.col("k") - 1, F.lit('", '), F.col("l_partkey") % 3, F.lit("]"))).otherwise("")
    node = F.concat(F.lit('"n'), "k", F.lit('":{"class_type":"'), "l_returnflag", F.lit('","inputs":{"part":'), "l_partkey", link, F.lit('},"_meta":{"title":"t'), "k", F.lit('"}}'))
    listed = items.groupBy(F.col("l_orderkey").alias("o")).agg(F.array_sort(F.collect_list(F.struct("k", node.alias("j")))).alias("js"))
    return listed.select("o", F.concat(F.lit("{"), F.array_join("js.j", ","), F.lit("}")).alias("text"))


ITEMS = "items AS (SELECT l_orderkey AS o, l_partkey, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS k FROM lineitem)"


@query(f"WITH {ITEMS} SELECT o, (k - 1)::INTEGER AS pos, 'n' || k AS node_id, l_returnflag AS class_type, 't' || k AS title FROM items")
def workflow_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflow.nodes(order_workflows(spark, sf_dir), keys=("o",)).drop("inputs")


@query(f"WITH {ITEMS} SELECT o, 'n' || (k - 1) AS src, (l_partkey % 3)::INTEGER AS slot, 'n' || k AS dst, 'from' AS input_name FROM items WHERE k > 1")
def workflow_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflow.edges(workflow.nodes(order_workflows(spark, sf_dir), keys=("o",)), ("o",))


@query(f"WITH {ITEMS} SELECT o, 'n' || k AS node_id, 'part' AS name, l_partkey::VARCHAR AS value FROM items")
def workflow_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflow.literals(workflow.nodes(order_workflows(spark, sf_dir), keys=("o",)), ("o",))


SMALL_WIDTH, SMALL_HEIGHT = 96, 64
#: A mask for each nation, whose pixels are its customers, and an image of a slanted gradient.
SMALL_PIXELS = """dots AS (SELECT c_nationkey AS id, (c_nationkey * 5) % 70 + c_custkey % 20 AS x, (c_nationkey * 3) % 50 + c_custkey % 11 AS y, 1 + c_custkey % 255 AS v FROM customer),
    masks AS (SELECT id, x, y, max(v) AS v FROM dots GROUP BY ALL),
    boxes AS (SELECT id, greatest(0, min(x) - 16) AS x0, greatest(0, min(y) - 16) AS y0, least(96, max(x) + 17) AS x1, least(64, max(y) + 17) AS y1 FROM masks GROUP BY id)"""


def nation_dots(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, customer = F.col("c_nationkey"), F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(nation.alias("id"), (nation * 5 % 70 + customer % 20).alias("x"), (nation * 3 % 50 + customer % 11).alias("y"), (1 + customer % 255).alias("v"))


def nation_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patches.to_images(nation_dots(spark, sf_dir), SMALL_WIDTH, SMALL_HEIGHT)


def nation_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = raster.blank(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id")), SMALL_WIDTH, SMALL_HEIGHT)
    return patches.to_images(cells.withColumn("v", (F.col("x") + F.col("y") + F.col("id")) % 256), SMALL_WIDTH, SMALL_HEIGHT)


@query(f"WITH {SMALL_PIXELS} SELECT id, x::INTEGER AS x, y::INTEGER AS y, 0 AS r, 0 AS g, 0 AS b, v::INTEGER AS a FROM masks")
def alpha_png(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks as PNG images, as the alpha of black PNG images, and decoded."""
    made = nation_masks(spark, sf_dir).select("id", patches.alpha_masks(F.col("content")).alias("m"))
    return patches.image_pixels(made.select("id", "m.content")).where("a > 0")


@query(f"""WITH {SMALL_PIXELS} SELECT b.id, x0::INTEGER AS x, y0::INTEGER AS y, (x1 - x0)::INTEGER AS width, (y1 - y0)::INTEGER AS height,
        (SELECT sum((gx + gy + b.id) % 256) FROM range(96) s(gx), range(64) t(gy) WHERE gx >= x0 AND gx < x1 AND gy >= y0 AND gy < y1)::BIGINT AS colour,
        (SELECT sum(v) FROM masks m WHERE m.id = b.id)::BIGINT AS mask
    FROM boxes b""")
def patch_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mask covers of an image, by the bytes of both, and the sums of the two patches' pixels."""
    both = nation_images(spark, sf_dir).withColumnRenamed("content", "image").join(nation_masks(spark, sf_dir), "id")
    cut = both.select("id", patches.patches(F.col("image"), F.col("content")).alias("p")).select("id", "p.*")
    part = lambda c: patches.image_pixels(cut.select("id", T.unpack_base64(F.col(c)).alias("content"))).groupBy("id").agg(F.sum("r").alias(c))
    return cut.select("id", "x", "y", "width", "height").join(part("color").withColumnRenamed("color", "colour"), "id").join(part("mask"), "id")


@query(f"""WITH {SMALL_PIXELS}, judged AS (SELECT c_custkey AS request_id, c_nationkey, CASE WHEN c_custkey % 7 = 0 THEN 422 WHEN c_nationkey % 4 = 1 THEN 404 WHEN c_custkey % 11 = 0 OR c_custkey % 13 = 0 THEN 500
        WHEN c_custkey % 17 = 0 THEN 502 ELSE 200 END AS status_code FROM customer)
    SELECT request_id, status_code, CASE WHEN status_code = 200 THEN x0 ELSE -1 END::INTEGER AS x, CASE WHEN status_code = 200 THEN y0 ELSE -1 END::INTEGER AS y,
        CASE WHEN status_code = 200 THEN x1 - x0 ELSE -1 END::INTEGER AS width, CASE WHEN status_code = 200 THEN y1 - y0 ELSE -1 END::INTEGER AS height FROM judged JOIN boxes ON id = c_nationkey""")
def inpaint_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request for each customer, from validation to patch: prompts are missing, sources aren't cached, masks aren't
    base64 or no images, the backend can't be reached; else it returns the nation's image. -1 stands where there is no patch."""
    k, nation = F.col("c_custkey"), F.col("c_nationkey")
    packed = nation_masks(spark, sf_dir).select(F.col("id").alias("c_nationkey"), T.pack_base64(F.col("content")).alias("good"))
    asked = table(spark, sf_dir, "customer").join(packed, "c_nationkey").select(
        k.alias("request_id"), F.concat(F.lit("n"), nation).alias("source_id"), F.when(k % 7 != 0, F.lit("p")).alias("prompt"), F.lit(None).cast("string").alias("negative_prompt"),
        F.when(k % 11 == 0, "!AAAAA").when(k % 13 == 0, "AAAA").otherwise(F.col("good")).alias("mask_image_base64"), F.lit(0).cast("long").alias("seed"), F.timestamp_seconds(k).alias("ts"),
    )
    cached = table(spark, sf_dir, "nation").where("n_nationkey % 4 <> 1").select(F.concat(F.lit("n"), "n_nationkey").alias("source_id"), F.lit("in/x.png").alias("path"))
    echo = requests.echo_backend(nation_images(spark, sf_dir).select(F.concat(F.lit("n"), "id").alias("source_id"), "content"))

    def backend(ready: DataFrame) -> DataFrame:
        down = F.col("request_id") % 17 == 0
        return echo(ready).select("request_id", F.when(~down, F.col("result")).alias("result"), F.when(down, "connection: refused").otherwise(F.col("failed")).alias("failed"))

    return requests.inpaint(asked, cached, TEMPLATE, backend).select("request_id", "status_code", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("x", "y", "width", "height")])


@query("""WITH RECURSIVE ops AS (SELECT (user_id % 40)::VARCHAR AS cache_id, event_id AS seq, 's' || (event_id * 7 % 9) AS source_id, event_type IN ('click', 'view') AS is_get,
        row_number() OVER (PARTITION BY user_id % 40 ORDER BY event_id) AS n FROM events),
    run(cache_id, n, seq, op, source_id, held, gone, outcome) AS (
        SELECT DISTINCT cache_id, 0::BIGINT, NULL::BIGINT, NULL::VARCHAR, NULL::VARCHAR, []::VARCHAR[], []::VARCHAR[], NULL::VARCHAR FROM ops
        UNION ALL
        SELECT o.cache_id, o.n, o.seq, CASE WHEN is_get THEN 'get' ELSE 'add' END, o.source_id,
            CASE WHEN is_get AND NOT list_contains(held, o.source_id) THEN held
                 ELSE list_append(list_filter(CASE WHEN NOT is_get AND len(held) >= 4 THEN held[2:] ELSE held END, lambda s: s <> o.source_id), o.source_id) END,
            CASE WHEN NOT is_get AND len(held) >= 4 THEN held[:1] ELSE [] END,
            CASE WHEN NOT is_get THEN 'added' WHEN list_contains(held, o.source_id) THEN 'hit' ELSE 'miss' END
        FROM run r JOIN ops o ON o.cache_id = r.cache_id AND o.n = r.n + 1)
    SELECT cache_id, seq, op, source_id, outcome FROM run WHERE n > 0
    UNION ALL SELECT cache_id, seq, op, gone[1], 'evicted_count' FROM run WHERE n > 0 AND len(gone) > 0""")
def cache_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookups and inserts of forty caches of four files, and what each insert evicts."""
    op = F.when(F.col("event_type").isin("click", "view"), "get").otherwise("add")
    ops = table(spark, sf_dir, "events").select(
        (F.col("user_id") % 40).cast("string").alias("cache_id"), F.col("event_id").alias("seq"), op.alias("op"), F.concat(F.lit("s"), F.col("event_id") * 7 % 9).alias("source_id"),
        F.lit(".png").alias("extension"), F.lit(10).cast("long").alias("length"),
    )
    return cache.replay(ops, 4, 1_000_000).drop("path")


@query("""SELECT event_id, '{"prompt":{"k":' || props || '},"client_id":"c' || user_id || '"}' AS payload FROM events""")
def queue_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What runs are submitted with: a workflow for each event, a client for each user."""
    document = F.concat(F.lit('{"k":'), "props", F.lit("}"))
    return table(spark, sf_dir, "events").select("event_id", remote.queue_payload(document, F.concat(F.lit("c"), "user_id")).alias("payload"))


@query("""SELECT page_id, 'http://b:1/view?filename=' || replace(url_encode(coalesce(url, '')), '%20', '+') || '&subfolder=s%2F' || page_id || '&type=output' AS address FROM pages""")
def view_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of result images whose names are urls; of a page without a url the name is empty."""
    return table(spark, sf_dir, "pages").select("page_id", remote.view_url("http://b:1", F.coalesce("url", F.lit("")), F.concat(F.lit("s/"), "page_id"), F.lit("output")).alias("address"))


def event_frames(spark: SparkSession, sf_dir: str) -> str:
    """A log of frames in two segments: signups are submissions of runs, one for each user, purchases end them, errors
    are failures, all else is progress."""
    kind = F.when(F.col("event_type") == "error", "execution_error").when(F.col("event_type") == "purchase", "executing").when(F.col("event_type") == "signup", "submitted").otherwise("progress")
    node = F.when(F.col("event_type").isin("purchase", "error", "signup"), "null").otherwise(F.concat(F.lit('"'), "event_id", F.lit('"')))
    value = F.concat(F.lit('{"type":"'), kind, F.lit('","data":{"node":'), node, F.lit(',"prompt_id":"'), "user_id", F.lit('"}}'))
    rows = table(spark, sf_dir, "events").select(F.concat(F.lit("c"), F.col("user_id") % 10).alias("channel"), "ts", value.alias("value"), "event_id")
    folder = fresh_folder(spark)
    for k in range(2):
        frames.append_frames(rows.where(F.col("event_id") % 2 == k), folder)
    return folder


@query("""SELECT 'c' || user_id % 10 AS channel, user_id::VARCHAR AS prompt_id, CASE event_type WHEN 'purchase' THEN 'executing' WHEN 'error' THEN 'execution_error' WHEN 'signup' THEN 'submitted' ELSE 'progress' END AS type,
        CASE WHEN event_type NOT IN ('purchase', 'error', 'signup') THEN event_id::VARCHAR END AS node, epoch_us(ts) AS us FROM events""")
def frame_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as frames of a log, streamed from it and parsed."""
    parsed = progress.parse_messages(frames.read_frames(spark, event_frames(spark, sf_dir)))
    return runs.collected(parsed.select("channel", "prompt_id", "type", "node", F.unix_micros("ts").alias("us")), fresh_folder(spark), fresh_folder(spark))


RUN_HOURS = 6


@query(f"""WITH sent AS (SELECT user_id, min(epoch_us(ts)) AS us FROM events WHERE event_type = 'signup' GROUP BY user_id),
        told AS (SELECT s.user_id, s.us, min((epoch_us(e.ts), CASE event_type WHEN 'purchase' THEN 'ended' ELSE 'failed' END)) AS first FROM sent s
            LEFT JOIN events e ON e.user_id = s.user_id AND e.event_type IN ('purchase', 'error') AND epoch_us(e.ts) >= s.us GROUP BY ALL),
        timed AS (SELECT user_id::VARCHAR AS prompt_id, us, us + {RUN_HOURS} * 3600000000 AS until, first[1] AS at_us, first[2] AS outcome, (SELECT max(epoch_us(ts)) FROM events WHERE event_type IN ('signup', 'purchase', 'error')) AS last FROM told)
    SELECT prompt_id, outcome, us AS submitted_us, at_us FROM timed WHERE at_us <= until
    UNION ALL SELECT prompt_id, 'silent', us, until FROM timed WHERE at_us > until OR at_us IS NULL AND until <= last
    UNION ALL SELECT prompt_id, 'late', us, at_us FROM timed WHERE at_us > until""")
def run_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of each user's run within six hours, by a stream that keeps its state: it ends, fails or is silent,
    and of silent ones which have a message later."""
    parsed = progress.parse_messages(frames.read_frames(spark, event_frames(spark, sf_dir)))
    told = F.when(F.col("type") == "submitted", "submitted").when(F.col("type") == "execution_error", "failed").when(progress.is_end(), "ended")
    stream = runs.run_outcomes(parsed.select("prompt_id", "ts", told.alias("event")).where("event is not null"), RUN_HOURS * 3600, 1000 * 86400)
    return runs.collected(stream, fresh_folder(spark), fresh_folder(spark), timers=True)


#: Edges of the part graph and, for parts divisible by 97, one that leads back over three halvings.
PART_CIRCLES = """edges(src, dst) AS (SELECT p_partkey, p_partkey // 2 FROM part WHERE p_partkey >= 2 UNION SELECT p_partkey // 8, p_partkey FROM part WHERE p_partkey % 97 = 0)"""


@query(f"""WITH RECURSIVE {PART_GRAPH}, reach(src, dst) AS (SELECT src, dst FROM edges UNION SELECT r.src, e.dst FROM reach r JOIN edges e ON e.src = r.dst)
    SELECT dst, count(*) AS n, min(src) AS least, max(src) AS most, sum(src)::BIGINT AS total FROM reach GROUP BY dst""")
def dag_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each part, the parts that lead to it over any number of edges."""
    pairs = workflow.reach(part_graph(spark, sf_dir)[0])
    return pairs.groupBy("dst").agg(F.count("*").alias("n"), F.min("src").alias("least"), F.max("src").alias("most"), F.sum("src").alias("total"))


@query(f"""WITH RECURSIVE {PART_CIRCLES}, reach(src, dst) AS (SELECT src, dst FROM edges UNION SELECT r.src, e.dst FROM reach r JOIN edges e ON e.src = r.dst)
    SELECT DISTINCT src AS node_id FROM reach WHERE src = dst""")
def dag_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts on cycles, where some edges lead back."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("p"))
    back = parts.where("p % 97 = 0").selectExpr("p div 8 AS src", "p AS dst")
    return workflow.cycles(parts.where("p >= 2").selectExpr("p AS src", "p div 2 AS dst").union(back))


#: How a request is bound into an order's document: its nodes are line items, so short orders lack some.
ORDER_BINDINGS = (("n1", "seed", "seed"), ("n2", "class", "prompt"), ("n1", "class", "negative_prompt"), ("n3", "image", "source_path"), ("n2", "part", "mask_path"))


def order_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of order_workflows, with the class as an input of every node too."""
    return order_workflows(spark, sf_dir).select(F.col("o").alias("template_id"), F.regexp_replace("text", r'"class_type":"(.)","inputs":\{', r'"class_type":"$1","inputs":{"class":"$1",').alias("text"))


@query(f"""WITH {ITEMS}, sizes AS (SELECT o, count(*) AS n FROM items GROUP BY o)
    SELECT o AS template_id, 'n' || k AS node_id, NULL::VARCHAR AS name FROM sizes, range(2, 4) t(k) WHERE k > n""")
def missing_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each order's document lacks of the nodes that a request needs."""
    return workflow.missing_in_templates(order_templates(spark, sf_dir), bindings=ORDER_BINDINGS)


@query(f"""WITH {ITEMS}, sizes AS (SELECT o, count(*) AS n FROM items GROUP BY o),
    nodes AS (SELECT o, k, '"n' || k || '":{{"class_type":"' || l_returnflag || '","inputs":{{"class":"' || CASE WHEN k = 1 THEN 'no \\"' || o || '\\", ' || l_returnflag WHEN k = 2 AND o_custkey % 3 > 0 THEN o_orderpriority || ', ' || l_returnflag ELSE l_returnflag END
            || '","part":' || CASE WHEN k = 2 THEN '"m/' || o || '"' ELSE l_partkey::VARCHAR END || CASE WHEN k > 1 THEN ',"from":["n' || (k - 1) || '",' || (l_partkey % 3) || ']' ELSE '' END
            || CASE k WHEN 1 THEN ',"seed":' || o_custkey WHEN 3 THEN ',"image":"s/' || o || '"' ELSE '' END || '}},"_meta":{{"title":"t' || k || '"}}}}' AS j
        FROM items JOIN orders ON o_orderkey = o),
    texts AS (SELECT o, '{{' || string_agg(j, ',' ORDER BY k) || '}}' AS workflow FROM nodes GROUP BY o)
    SELECT o_orderkey, CASE WHEN n >= 3 THEN workflow END AS workflow,
        CASE WHEN n IS NULL THEN 'no such template' WHEN n = 1 THEN 'template lacks node n2, node n3' WHEN n = 2 THEN 'template lacks node n3' END AS error
    FROM orders LEFT JOIN sizes ON sizes.o = o_orderkey LEFT JOIN texts ON texts.o = o_orderkey""")
def templates_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request for each order, bound into the order's own document: the documents' whole texts."""
    key = F.col("o_orderkey")
    asked = table(spark, sf_dir, "orders").select(
        "o_orderkey", key.alias("template_id"), F.col("o_custkey").alias("seed"), F.when(F.col("o_custkey") % 3 > 0, F.col("o_orderpriority")).alias("prompt"), F.concat(F.lit('no "'), key, F.lit('"')).alias("negative_prompt"),
        F.concat(F.lit("s\\"), key).alias("source_path"), F.concat(F.lit("m\\"), key).alias("mask_path"),
    )
    return workflow.bind_templates(asked, order_templates(spark, sf_dir), bindings=ORDER_BINDINGS).select("o_orderkey", "workflow", "error")


def event_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as raw bodies of requests: fields are absent, null or of another type; some bodies are no objects or no JSON."""
    user, event = F.col("user_id"), F.col("event_id")
    prompt = F.element_at(F.array(F.concat(F.lit('"prompt":"'), "event_type", F.lit('",')), F.lit('"prompt":null,'), F.lit('"prompt":5,'), F.lit("")), (user % 4 + 1).cast("int"))
    seed = F.element_at(F.array(F.lit(""), F.lit('"seed":null,'), F.concat(F.lit('"seed":'), user, F.lit(",")), F.concat(F.lit('"seed":"'), user, F.lit('",')), F.lit('"seed":1.5,'), F.lit('"seed":"x",'), F.lit('"seed":[1],')), (event % 7 + 1).cast("int"))
    body = F.concat(F.lit("{"), prompt, seed, F.lit('"source_id":"s","mask_image_base64":"AA=="}'))
    return table(spark, sf_dir, "events").select(event.alias("request_id"), F.when(event % 11 == 0, F.lit("[1]")).when(event % 13 == 0, F.lit("{no")).otherwise(body).alias("body"))


@query("""WITH fields AS (SELECT event_id AS request_id, event_id % 11 = 0 AS listed, event_id % 13 = 0 AS broken, CASE user_id % 4 WHEN 1 THEN 'string_type' WHEN 2 THEN 'string_type' WHEN 3 THEN 'missing' END AS prompt,
        CASE event_id % 7 WHEN 1 THEN 'int_type' WHEN 4 THEN 'int_from_float' WHEN 5 THEN 'int_parsing' WHEN 6 THEN 'int_type' END AS seed FROM events)
    SELECT request_id, NULL::VARCHAR AS field, CASE WHEN listed THEN 'model_type' ELSE 'json_invalid' END AS problem FROM fields WHERE listed OR broken
    UNION ALL SELECT request_id, 'prompt', prompt FROM fields WHERE NOT listed AND NOT broken AND prompt IS NOT NULL
    UNION ALL SELECT request_id, 'seed', seed FROM fields WHERE NOT listed AND NOT broken AND seed IS NOT NULL""")
def rejected_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.validated(event_bodies(spark, sf_dir))[1]


@query("""SELECT event_id AS request_id, 's' AS source_id, event_type AS prompt, 'blur, low quality, distortion, watermark' AS negative_prompt, 'AA==' AS mask_image_base64,
        CASE WHEN event_id % 7 = 0 THEN 0 ELSE user_id END AS seed FROM events WHERE event_id % 11 <> 0 AND event_id % 13 <> 0 AND user_id % 4 = 0 AND event_id % 7 IN (0, 2, 3)""")
def accepted_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return requests.validated(event_bodies(spark, sf_dir))[0]


CONTEXT = """grown AS (SELECT id, greatest(0, x0 - floor((x1 - x0) * 0.5 / 2)) AS x0, greatest(0, y0 - floor((y1 - y0) * 0.5 / 2)) AS y0,
        least(640, x1 + floor((x1 - x0) * 0.5 / 2)) AS x1, least(480, y1 + floor((y1 - y0) * 0.5 / 2)) AS y1 FROM box),
    needed AS (SELECT *, least(640, greatest(x1 - x0, ceil((y1 - y0) * 4.0 / 3))) AS w, least(480, greatest(y1 - y0, ceil((x1 - x0) * 3.0 / 4))) AS h FROM grown),
    placed AS (SELECT id, greatest(0, least(x0 - floor((w - (x1 - x0)) / 2), 640 - w))::INTEGER AS x0, greatest(0, least(y0 - floor((h - (y1 - y0)) / 2), 480 - h))::INTEGER AS y0, w::INTEGER AS w, h::INTEGER AS h FROM needed)"""


def context_of_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of the masks' values over 200 on the left half, with half of their size as context, in the aspect of 4 to 3."""
    boxes = raster.mask_boxes(mask_pixels(spark, sf_dir).where("x % 320 < 40 and y < 200"), WIDTH, HEIGHT, least=200)
    return raster.context_boxes(boxes, 1.5, (4, 3), WIDTH, HEIGHT)


SOME_BOX = """box AS (SELECT id, greatest(0, min(x) - 16) AS x0, greatest(0, min(y) - 16) AS y0, least(640, max(x) + 17) AS x1, least(480, max(y) + 17) AS y1
        FROM pixels WHERE v > 200 AND x % 320 < 40 AND y < 200 GROUP BY id)"""


@query(f"WITH {PIXELS}, {SOME_BOX}, {CONTEXT} SELECT id, x0, y0, (x0 + w)::INTEGER AS x1, (y0 + h)::INTEGER AS y1 FROM placed")
def context_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_of_masks(spark, sf_dir)


@query(f"""WITH {PIXELS}, {SOME_BOX}, {CONTEXT},
    cut AS (SELECT p.id, x - x0 AS x, y - y0 AS y, v, w, h FROM pixels p JOIN placed b ON b.id = p.id WHERE x >= x0 AND x < x0 + w AND y >= y0 AND y < y0 + h),
    shares AS (SELECT id, tx::INTEGER AS x, ty::INTEGER AS y, w, h, v * (least((tx + 1) * w, (x + 1) * 40) - greatest(tx * w, x * 40)) * (least((ty + 1) * h, (y + 1) * 30) - greatest(ty * h, y * 30)) AS share
        FROM cut, range(40) a(tx), range(30) b(ty) WHERE least((tx + 1) * w, (x + 1) * 40) > greatest(tx * w, x * 40) AND least((ty + 1) * h, (y + 1) * 30) > greatest(ty * h, y * 30))
    SELECT id, x, y, sum(share)::BIGINT AS total, floor((2 * sum(share) + w * h)::DOUBLE / (2 * w * h))::INTEGER AS v FROM shares GROUP BY id, x, y, w, h""")
def context_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the boxes with context cut out, resized to 40 x 30 by area."""
    boxes = context_of_masks(spark, sf_dir)
    sizes = boxes.select("id", (F.col("x1") - F.col("x0")).alias("width"), (F.col("y1") - F.col("y0")).alias("height"))
    return raster.resize_area(raster.crop(mask_pixels(spark, sf_dir), boxes).join(sizes, "id"), (40, 30))


BLEND = 4
EDGE = f"""{SMALL_PIXELS}, steps AS (SELECT dx, dy, dx * dx + dy * dy AS square FROM range(-{BLEND}, {BLEND} + 1) a(dx), range(-{BLEND}, {BLEND} + 1) b(dy)),
    edge AS (SELECT m.id, m.x, m.y, least({BLEND * BLEND}, min(square) FILTER (o.id IS NULL))::INTEGER AS square FROM masks m, steps LEFT JOIN masks o ON o.id = m.id AND o.x = m.x + dx AND o.y = m.y + dy GROUP BY ALL)"""


@query(f"WITH {EDGE} SELECT * FROM edge")
def edge_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The squared distance of each mask's pixels to the nearest place outside of it."""
    return raster.edge_distances(nation_dots(spark, sf_dir), BLEND)


@query(f"""WITH {EDGE}, shares AS (SELECT *, least(1, sqrt(square) / {BLEND}) AS share FROM edge)
    SELECT n_nationkey AS id, gx::INTEGER AS x, gy::INTEGER AS y, floor(coalesce(share, 0) * 255 + (1 - coalesce(share, 0)) * v + 0.5)::INTEGER AS v
    FROM (SELECT n_nationkey, gx, gy, (gx + gy + n_nationkey) % 256 AS v FROM nation, range({SMALL_WIDTH}) s(gx), range({SMALL_HEIGHT}) t(gy))
    LEFT JOIN shares e ON e.id = n_nationkey AND e.x = gx AND e.y = gy""")
def stitched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A white patch on each nation's gradient, from the corner of its mask, faded at the mask's edge."""
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"))
    image = raster.blank(nations, SMALL_WIDTH, SMALL_HEIGHT).withColumn("v", (F.col("x") + F.col("y") + F.col("id")) % 256)
    offsets = nations.select("id", (F.col("id") * 5 % 70).cast("int").alias("x0"), (F.col("id") * 3 % 50).cast("int").alias("y0"))
    return raster.stitch(image, raster.blank(nations, SMALL_WIDTH, SMALL_HEIGHT, 255), offsets, nation_dots(spark, sf_dir), BLEND)


@query(f"WITH {PIXELS} {BOX.format(150)}")
def tile_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.tile_boxes(tiles.to_tiles(mask_pixels(spark, sf_dir)), WIDTH, HEIGHT, least=150)


@query(f"""WITH {PIXELS}, {SOME_BOX}, one AS (SELECT id, x, y, max(v) AS v FROM pixels GROUP BY ALL)
    SELECT one.id, x - x0 AS x, y - y0 AS y, v::INTEGER AS v FROM one JOIN box ON box.id = one.id WHERE x >= x0 AND x < x1 AND y >= y0 AND y < y1 AND v > 0""")
def tile_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The padded boxes of some of the masks' values, cut from tiles to tiles."""
    boxes = raster.mask_boxes(mask_pixels(spark, sf_dir).where("x % 320 < 40 and y < 200"), WIDTH, HEIGHT, least=200)
    return tiles.to_pixels(tiles.crop(tiles.to_tiles(mask_pixels(spark, sf_dir)), boxes))


@query(f"""WITH {SMALL_PIXELS} SELECT id, x + dx AS x, y + dy AS y, max(v)::INTEGER AS v FROM masks, range(-3, 4) a(dx), range(-3, 4) b(dy)
    WHERE x + dx BETWEEN 0 AND {SMALL_WIDTH - 1} AND y + dy BETWEEN 0 AND {SMALL_HEIGHT - 1} GROUP BY ALL""")
def tile_dilate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks grown by three pixels over the borders of tiles of 16."""
    return tiles.to_pixels(tiles.dilate(tiles.to_tiles(nation_dots(spark, sf_dir), 16), SMALL_WIDTH, SMALL_HEIGHT, 3, 16), 16)
