import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.llm import media, urlfilter


def test_text_media(odd_docs, no_docs):
    found = media.text_media(odd_docs, full=True).collect()
    texts = sorted(((r["text"] or "").encode() for r in odd_docs.collect()))
    assert len(found) == len(texts)
    back = []
    for r in found:
        image = media.from_npy(bytes(r["media"]))
        payload = image.tobytes()
        assert image.dtype == np.uint8 and len(payload) == r["payload_bytes"] > 0 and len(payload) % 576 == 0 and 0 <= len(payload) - r["n_bytes"] <= 576
        assert set(payload[r["n_bytes"] :]) <= {255}
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-32:])
        assert r["media_bytes"] == len(r["media"]) and r["media_sha256"] == hashlib.sha256(r["media"]).hexdigest()
        back.append(payload[: r["n_bytes"]])
    assert sorted(back) == texts
    by_text = {}
    for b, r in zip(back, found, strict=True):
        assert by_text.setdefault(b, r["feature"]) == r["feature"]
    assert media.text_media(no_docs).collect() == []


def test_formats():
    rng = np.random.default_rng(0)
    grey, rgb = rng.integers(0, 256, (5, 7), dtype=np.uint8), rng.integers(0, 256, (4, 3, 3), dtype=np.uint8)
    assert (media.decode(media.encode_pgm(grey)) == grey).all() and (media.decode(media.encode_bmp(rgb)) == rgb).all()
    assert (media.decode(b"P6 # x\n3\t4\n255\n" + rgb.tobytes()) == rgb).all()
    assert (media.decode(b"P2\n# c\n7 5\n255\n" + " ".join(map(str, grey.ravel())).encode()) == grey).all()
    assert (media.decode(b"P3 3 4 255 " + " ".join(map(str, rgb.ravel())).encode()) == rgb).all()
    bits = rng.integers(0, 2, (3, 11))
    assert (media.decode(b"P1 11 3\n" + "".join(map(str, bits.ravel())).encode()) == (1 - bits) * 255).all()
    assert (media.decode(b"P4 11 3\n" + np.packbits(bits, axis=1).tobytes()) == (1 - bits) * 255).all()
    wide = rng.integers(0, 60000, (2, 3), dtype=np.uint16)
    assert (media.decode(b"P5 3 2 65535\n" + wide.astype(">u2").tobytes()) == wide).all()
    for bad in (b"", b"P7 1 1 1\n", b"P5 9 9 255\nxx", b"BMxx", b"P5 x"):
        with pytest.raises((ValueError, media.struct.error)):
            media.decode(bad)


def test_resize_and_hash():
    rng = np.random.default_rng(0)
    image = rng.integers(0, 256, (24, 36), dtype=np.uint8)
    assert np.allclose(media.area_resize(image, 8, 9), image.reshape(8, 3, 9, 4).mean(axis=(1, 3)))
    for h, w in ((5, 7), (40, 50), (1, 1)):
        small = media.area_resize(image, h, w)
        assert small.shape == (h, w) and np.isclose(small.mean(), image.mean())
    assert media.difference_hash(np.tile(np.arange(90, dtype=np.uint8), (8, 1))) == "ff" * 8
    assert media.difference_hash(np.zeros((24, 24), np.uint8)) == "00" * 8


def test_media_tiles(spark):
    image = np.arange(48, dtype=np.uint8).reshape(6, 8)
    df = spark.createDataFrame([("a", bytearray(media.encode_pgm(image))), ("b", bytearray(b"zz")), ("c", None), (None, bytearray(media.encode_bmp(np.dstack([image] * 3))))], "id string, media binary")
    got = {r["id"]: r for r in media.media_tiles(df, height=3, width=4).collect()}
    assert (media.from_npy(bytes(got["a"]["tile"])) == np.round(image.reshape(3, 2, 4, 2).mean(axis=(1, 3)))).all()
    assert got["a"]["tile"] == got[None]["tile"] and got["b"]["error"] and got["c"]["tile"] is None
    assert media.media_tiles(df.limit(0)).collect() == []


RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def slow_verdict(url):
    head, found, rest = (url or "").partition("://")
    at = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest)) if found else 0
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:at]) if found else ""
    path = rest[at:] if found else ""
    path = path[: min([path.index(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if f".{host}".endswith("." + h) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, "allow"))


def test_url_verdicts(spark):
    rnd = random.Random(0)
    urls = [None, "", "no scheme", "://", "http://", "x://com", "x://com/", "x://COM?/", "x://a.com#/", "x://xcom/", "x://com./", "x://.com/", "x://É.COM/en/", "a://b://c.com/", "x://com/://net/es/", "http://net\n/es/x", "http://a.net/es", "http://a.net/es/?q#/f"]
    urls += [f"{rnd.choice(['http', 'x'])}://{rnd.choice(['', 'www.', 'a.b.', 'WWW.'])}{rnd.choice(['example.com', 'example.net', 'net', 'com', 'example.org', 'wwwexample.com'])}{rnd.choice(['', '/', '/en/', '/es/1', '/fr/?', '/en', '/EN/'])}{rnd.choice(['', '?a=/en/', '#x'])}" for _ in range(400)]
    rows = [(None if i == 3 else i // 2, u, None, "x") for i, u in enumerate(urls)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, rule string")
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    found = urlfilter.url_verdicts(pages, rules).collect()
    assert sorted(map(str, map(tuple, found))) == sorted(str((r[0], *slow_verdict(r[1]))) for r in rows)
    assert urlfilter.url_verdicts(pages.limit(0), rules).collect() == []
    assert {r["verdict"] for r in urlfilter.url_verdicts(pages, rules.limit(0), "block").collect()} == {"block"}


def test_cascade(spark):
    """Many listed keys and a universe that passes every level wrongly in part."""
    universe = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = spark.range(300).select(F.concat(F.lit("k"), F.col("id") * 61).alias("key"))
    levels = urlfilter.cascade(listed, universe, 20_000)
    assert len(levels) > 1
    hits = universe.where(urlfilter.member(F.col("key"), levels)).collect()
    assert sorted(r["key"] for r in hits) == sorted(f"k{i * 61}" for i in range(300))


def test_a_long_list(spark):
    """A hundred thousand rules, a twentieth of which fit some url, against a plain look-up."""
    rnd = random.Random(5)
    hosts = [f"h{i}.t{i % 97}.org" for i in range(100_000)]
    verdict = {h: "block" if i % 10 else "allow" for i, h in enumerate(hosts)}
    rules = spark.createDataFrame([(verdict[h], h, "/") for h in hosts], "verdict string, host string, path string")
    urls = [f"http://{rnd.choice(['', 'www.'])}{rnd.choice(hosts)}/x" if rnd.random() < 0.5 else f"http://z{i}.t{i % 97}.org/" for i in range(10_000)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    found = urlfilter.url_verdicts(pages, rules).collect()
    assert len(found) == len(urls)
    for r in found:
        host = r["host"].removeprefix("www.")
        assert r["rule"] == (f"{host}/" if host in verdict else None) and r["verdict"] == verdict.get(host, "allow")
    # the same in four passes
    shared = urlfilter.url_verdicts(pages, rules, keys_a_pass=25_000)
    assert sorted(map(tuple, shared.collect()), key=str) == sorted(map(tuple, found), key=str)


def test_shares_of_a_list(spark):
    """Rules told one or two a pass, of both verdicts, with paths, ties and shares that list nothing."""
    urls = [None, "x://com", "x://www.example.com/en/a", "x://example.com/en/", "x://a.example.com/en/", "x://a.net/es/", "x://net/fr", "x://b.c/de/", "x://c/de/", "x://org/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    # b.c/d and c/de/ have the same length; com/ is listed twice
    rules = spark.createDataFrame([*RULES, ("block", "com", "/"), ("block", "c", "/de/"), ("allow", "b.c", "/d")], "verdict string, host string, path string")
    want = sorted(map(tuple, urlfilter.url_verdicts(pages, rules).collect()))
    assert [r[3] for r in want if r[0] in (7, 8)] == ["b.c/d", "c/de/"]
    for n in (1, 2, 5):
        found = urlfilter.url_verdicts(pages, rules, keys_a_pass=n)
        assert found.columns == ["page_id", "host", "path", "rule", "verdict"] and sorted(map(tuple, found.collect())) == want
    assert urlfilter.url_verdicts(pages.limit(0), rules, keys_a_pass=2).collect() == []
