"""Inputs shared by the queries, and their SQL counterparts. Rows written twice count once."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import once, table


def docs(spark, sf_dir):
    return once(table(spark, sf_dir, "docs"), "node_id")


def files(spark, sf_dir):
    return once(table(spark, sf_dir, "ingest_files"), "file_id")


def cards(spark, sf_dir):
    """(node_id, vec) of usable card vectors."""
    v = once(table(spark, sf_dir, "vectors").where("basis = 'card'").select("node_id", "vec"), "node_id")
    return v.where(F.size("vec") == 128)


def raw_scores(spark, sf_dir, axes: int = 4):
    """(node_id, pc, raw): the first coordinates of the card vectors, standing for raw axis projections."""
    return cards(spark, sf_dir).select("node_id", F.explode(F.array(*[F.struct(F.lit(i + 1).alias("pc"), F.col("vec")[i].cast("double").alias("raw")) for i in range(axes)])).alias("x")).select("node_id", "x.*")


def ladder(spark, sf_dir):
    """(level, node_id, region): three nested partitions of the nodes, by their numbers."""
    d = docs(spark, sf_dir).select("node_id", "map_id")
    levels = F.array(F.struct(F.lit(0).alias("level"), (F.col("map_id") % 4).alias("region")), F.struct(F.lit(1).alias("level"), (F.col("map_id") % 12).alias("region")), F.struct(F.lit(2).alias("level"), F.col("map_id").alias("region")))
    return d.select("node_id", F.explode(levels).alias("x")).select("x.level", "node_id", "x.region")


D = "d AS (SELECT DISTINCT ON (node_id) * FROM docs WHERE node_id IS NOT NULL)"
FILES = "f AS (SELECT DISTINCT ON (file_id) * FROM ingest_files WHERE file_id IS NOT NULL)"
V = "v AS (SELECT DISTINCT ON (node_id) node_id, vec FROM vectors WHERE basis = 'card' AND len(vec) = 128)"
RAW = V + ", raw AS (SELECT node_id, pc, vec[pc]::DOUBLE AS raw FROM v, (SELECT unnest([1, 2, 3, 4])::INT AS pc))"
LADDER = D + ", ladder AS (SELECT 0 AS level, node_id, map_id % 4 AS region FROM d UNION ALL SELECT 1, node_id, map_id % 12 FROM d UNION ALL SELECT 2, node_id, map_id FROM d)"
