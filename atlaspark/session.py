"""Session, table access and lineage cutting shared by every operator."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(app: str = "atlaspark", cores: int | None = None) -> SparkSession:
    """A local session for tests and the bench; on a cluster the caller brings its own."""
    n = cores or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.driver.memory", os.environ.get("ATLASPARK_DRIVER_MEMORY", "8g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder and drop its lineage.

    The folder is the cluster's ``spark.checkpoint.dir``. Only where that is unset, as in tests, a local one is made.
    """
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="atlaspark-"))
    return df.checkpoint(eager=True)


def partitions(spark: SparkSession) -> int:
    """The shuffle width that the cluster is set to."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def once(df: DataFrame, *keys: str) -> DataFrame:
    """Rows written twice in full count once: one row per key, the same one however the input is ordered.

    Of rows that share a key but differ, the one with the smallest content hash stays. Null keys are left out.
    """
    rest = [c for c in df.columns if c not in keys]
    packed = F.struct(F.xxhash64(*[F.col(f"`{c}`") for c in rest]).alias("h"), *[F.col(f"`{c}`") for c in rest])
    kept = df.where(F.lit(True) if not keys else _all_set(keys)).groupBy(*keys).agg(F.min_by(packed, packed["h"]).alias("_row"))
    return kept.select(*keys, *[F.col("_row").getField(c).alias(c) for c in rest])


def _all_set(keys: tuple[str, ...]):
    cond = F.col(keys[0]).isNotNull()
    for k in keys[1:]:
        cond = cond & F.col(k).isNotNull()
    return cond
