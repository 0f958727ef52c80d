"""Settings, read from the Spark session."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PREFIX = "rasterloom."


@dataclass(frozen=True)
class Settings:
    """The service's defaults."""

    host: str = "0.0.0.0"
    port: int = 5000
    backend_host: str = "127.0.0.1"
    backend_port: int = 5545
    cache_dir: str = "./cache"
    workflow_file: str = "workflow.json"
    max_cache_files: int = 20
    max_cache_size_mb: int = 2048

    @classmethod
    def of(cls, spark: SparkSession) -> Settings:
        """Values of spark.conf under `rasterloom.`, by field name; defaults for the rest."""
        found = {}
        for name, kind in cls.__annotations__.items():
            if (value := spark.conf.get(PREFIX + name, None)) is not None:
                found[name] = int(value) if kind == "int" else value
        return cls(**found)

    @property
    def source_dir(self) -> str:
        return f"{self.cache_dir}/sources"

    @property
    def sent_dir(self) -> str:
        return f"{self.cache_dir}/sent"

    @property
    def max_cache_bytes(self) -> int:
        return self.max_cache_size_mb * 1024 * 1024

    @property
    def backend_address(self) -> str:
        return f"{self.backend_host}:{self.backend_port}"

    @property
    def http_url(self) -> str:
        return f"http://{self.backend_address}"

    @property
    def ws_url(self) -> str:
        return f"ws://{self.backend_address}/ws"


def resolved(overrides: DataFrame, key: str) -> DataFrame:
    """Settings of several deployments: rows (key, name, value) give a row for each key, with a column for each setting,
    defaults where none is given (of several values of one name, the largest), and what follows from them."""
    defaults = Settings()
    named = overrides.where(F.col("name").isin(list(Settings.__annotations__))).groupBy(key, "name").agg(F.max("value").alias("value"))
    given = named.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("given"))
    rows = overrides.select(key).distinct().join(given, key, "left")
    one = lambda n, kind: F.coalesce(F.col("given")[n], F.lit(str(getattr(defaults, n)))).cast("bigint" if kind == "int" else "string").alias(n)
    full = rows.select(key, *[one(n, kind) for n, kind in Settings.__annotations__.items()])
    address = F.concat("backend_host", F.lit(":"), F.col("backend_port").cast("string"))
    return full.withColumns({
        "source_dir": F.concat("cache_dir", F.lit("/sources")), "sent_dir": F.concat("cache_dir", F.lit("/sent")), "max_cache_bytes": F.col("max_cache_size_mb") * 1024 * 1024,
        "http_url": F.concat(F.lit("http://"), address), "ws_url": F.concat(F.lit("ws://"), address, F.lit("/ws")),
    })
