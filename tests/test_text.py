import base64
import os.path

from pyspark.sql import functions as F

from rasterloom.functions import text as T


def column(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["o"] for r in rows.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


def test_extension_and_stem(spark):
    names = ["a.png", "a.b.jpg", ".hidden", "..x", "noext", "dir.x/name", "dir/.hid.png", "a.", "", "x/y.tar.gz", "..a.b"]
    assert column(spark, names, T.extension) == [os.path.splitext(n)[1] or ".png" for n in names]
    from pathlib import PurePosixPath

    names = ["s/a.png", "s/a.b.jpg", "s/.hidden", "s/noext", "s/x.tar.gz"]
    assert column(spark, names, T.stem) == [PurePosixPath(n).stem for n in names]


def test_prompts_and_paths(spark):
    rows = spark.createDataFrame([("a", "b"), ("", "b"), ("a", ""), (None, "b"), ("", ""), (None, None)], "a string, b string")
    assert [r[0] for r in rows.select(T.merge_prompt(F.col("a"), F.col("b"))).collect()] == ["a, b", "b", "a", "b", "", ""]
    assert column(spark, ["a\\b\\c", "x/y", None], T.normal_path) == ["a/b/c", "x/y", None]


def test_base64(spark):
    data = [bytes(range(n % 256)) * 3 for n in range(0, 90, 7)]
    rows = spark.createDataFrame([(i, d) for i, d in enumerate(data)], "i int, d binary")
    packed = [r["p"] for r in rows.select("i", T.pack_base64(F.col("d")).alias("p")).orderBy("i").collect()]
    assert packed == [base64.b64encode(d).decode() for d in data]
    texts = [*packed, "QQ==", "QQ=", "QQ", "Q", "data:image/png;base64,QUJD", "Q U\nJD", "", None]

    def lax(t):
        try:
            return None if t is None else base64.b64decode(t)
        except ValueError:
            return None

    assert [None if x is None else bytes(x) for x in column(spark, texts, T.unpack_base64)] == [lax(t) for t in texts]


def test_seed(spark):
    rows = spark.sql("SELECT * FROM VALUES (1, 7L, timestamp'1970-01-01 00:01:00'), (2, 0L, timestamp'1970-01-01 00:01:00'), (3, null, timestamp'1970-01-01 00:01:00') AS t(i, s, at)")
    assert [r[0] for r in rows.orderBy("i").select(T.default_seed(F.col("s"), F.col("at"))).collect()] == [7, 60, 60]
