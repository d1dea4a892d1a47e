"""Running a build: configuration, progress, resuming, and checks of the finished map."""

from __future__ import annotations

import os
import time
from collections.abc import Callable
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Config:
    """What a host sets once; every field can be overridden by an environment variable ATLASPARK_<NAME>. All caches lie under one root."""

    model: str = ""
    embed_model: str = "hash-128"
    min_chars: int = 400
    axes: int = 16
    neighbours: int = 8
    concurrency: int = 12
    max_doc_chars: int = 120_000
    cache_root: str = "atlaspark-cache"

    @classmethod
    def from_env(cls, env=None) -> Config:
        env = os.environ if env is None else env
        given = {f.name: env[f"ATLASPARK_{f.name.upper()}"] for f in fields(cls) if f"ATLASPARK_{f.name.upper()}" in env}
        kinds = {f.name: type(f.default) for f in fields(cls)}
        return cls(**{k: kinds[k](v) for k, v in given.items()})

    def cache(self, name: str) -> str:
        return f"{self.cache_root.rstrip('/')}/{name}"


@dataclass
class Progress:
    """Stage events of a run: (stage, state, seconds, note), handed to a listener as they come and kept."""

    listener: Callable[[dict], None] | None = None
    events: list[dict] = field(default_factory=list)

    def tell(self, stage: str, state: str, seconds: float = 0.0, note: str = "") -> None:
        event = {"stage": stage, "state": state, "seconds": round(seconds, 3), "note": note}
        self.events.append(event)
        if self.listener:
            self.listener(event)

    def run(self, stage: str, work: Callable):
        self.tell(stage, "started")
        at = time.monotonic()
        try:
            out = work()
        except Exception as e:
            self.tell(stage, "failed", time.monotonic() - at, str(e)[:200])
            raise
        self.tell(stage, "done", time.monotonic() - at)
        return out


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to the end: its committer leaves a mark."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


class Resumable:
    """Stages that write their table below a folder on shared storage; one that is already there is read, not made again."""

    def __init__(self, spark: SparkSession, root: str, progress: Progress | None = None):
        self.spark, self.root, self.progress = spark, root.rstrip("/"), progress or Progress()

    def stage(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        path = f"{self.root}/{name}"
        if exists(self.spark, path):
            self.progress.tell(name, "kept")
        else:
            self.progress.run(name, lambda: make().write.mode("overwrite").parquet(path))
        return self.spark.read.parquet(path)

    def again(self, name: str) -> None:
        """Forget a stage, such as the axes' names once there is a model to name them."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def ship_check(data: bytes, spark: SparkSession, least: int = 1000) -> int:
    """The cards of a map file, which has to decode and to hold ``least`` of them."""
    from ..sources.mapfile import decode_map

    n = decode_map(spark, data)["nodes"].count()
    if n < least:
        raise ValueError(f"a map of {n} cards is not shipped; it takes {least}")
    return n


def parity(old: DataFrame, new: DataFrame, key: str, *values: str, digits: int = 6) -> DataFrame:
    """(column, same, differ, only_old, only_new): whether two versions of a table agree, column by column; numbers to so many digits, nulls equal to nulls."""
    kinds = dict(old.dtypes)
    rounded = lambda c: F.round(c, digits) if kinds[c] in ("double", "float") else F.col(c)
    a = old.select(key, F.lit(True).alias("_a"), *[rounded(c).alias(f"a_{c}") for c in values])
    b = new.select(key, F.lit(True).alias("_b"), *[rounded(c).alias(f"b_{c}") for c in values])
    both = a.join(b, key, "full")
    sums = both.agg(
        F.count_if(F.col("_b").isNull()).alias("only_old"), F.count_if(F.col("_a").isNull()).alias("only_new"),
        *[F.count_if(F.col("_a") & F.col("_b") & F.equal_null(F.col(f"a_{c}"), F.col(f"b_{c}"))).alias(f"s_{c}") for c in values], F.count_if(F.col("_a") & F.col("_b")).alias("both"),
    )
    return sums.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"s_{c}").alias("same"), (F.col("both") - F.col(f"s_{c}")).alias("differ"), "only_old", "only_new") for c in values])).alias("x")).select("x.*")
