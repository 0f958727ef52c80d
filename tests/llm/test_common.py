from pyspark.sql import functions as F

from rasterloom.llm.common import hash_sample


def test_hash_sample_of_repeated_keys(spark):
    """Keys that are null or one id leave a full sample, as do distinct ones."""
    rows = spark.range(200)
    for key in (F.lit(None).cast("long"), F.lit(7).cast("long"), F.col("id")):
        some = hash_sample(rows.select(key.alias("k"), F.col("id").alias("t")), 10, "k", "t").collect()
        assert len(some) == 10
