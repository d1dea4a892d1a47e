"""Sinks: card lines, Markdown vaults and separate parts, written by the executors."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.files import MANIFEST
from .view import deck_lines, vault_names


def refuse_empty(df: DataFrame) -> None:
    if df.isEmpty():
        raise ValueError("refusing to write an empty map")


def write_lines(cards: DataFrame, path: str, *columns: str) -> None:
    refuse_empty(cards)
    deck_lines(cards, *columns).withColumnRenamed("line", "value").write.mode("overwrite").text(path)


def vault_entries(cards: DataFrame) -> DataFrame:
    """(filename, content) of cards (node_id, id, title, url, core, notes and, if they have it, region, a label): frontmatter, restatement and one line per placement."""
    quoted = lambda c: F.to_json(F.struct(F.coalesce(F.col(c), F.lit("")).alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.coalesce(F.col(c), F.lit("")).alias("v")))) - 6)
    keys = F.array_sort(F.map_keys("notes"))
    axes = F.concat(F.lit("axes:\n"), F.array_join(F.transform(keys, lambda k: F.concat(F.lit("  "), k, F.lit(": "), F.element_at("notes", k))), "\n"))
    link = F.when(F.col("url").isNotNull(), F.concat(F.lit("\nurl: "), quoted("url"))).otherwise("")
    place = F.when(F.coalesce(F.col("region"), F.lit("")) != "", F.concat(F.lit("\nregion: "), quoted("region"))).otherwise("") if "region" in cards.columns else F.lit("")
    content = F.concat(F.lit("---\nid: "), quoted("id"), F.lit("\ntitle: "), quoted("title"), link, place, F.lit("\n"), axes, F.lit("\n---\n\n"), F.coalesce("core", F.lit("")), F.lit("\n"))
    return cards.withColumn("content", content).join(vault_names(cards, "node_id", "title"), "node_id").select("filename", "content")


def write_vault(cards: DataFrame, folder: str, title: str) -> None:
    """One file per card into a folder that all executors share, and a manifest with the title, which is written first: an executor that does not see it raises, rather than write to a disk of its own."""
    refuse_empty(cards)
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, MANIFEST), "w", encoding="utf-8") as f:
        json.dump({"kind": "vault", "title": title}, f)

    def put(rows):
        if not os.path.exists(os.path.join(folder, MANIFEST)):
            raise FileNotFoundError(f"{folder} is not shared with the executors")
        for r in rows:
            with open(os.path.join(folder, r.filename), "w", encoding="utf-8") as f:
                f.write(r.content)

    vault_entries(cards).foreachPartition(put)


def write_parts(tables: dict[str, DataFrame], path: str, views: list[dict] | None = None) -> None:
    """Each table as its own Parquet part beside a manifest of their names and schemas; views only if there are any."""
    refuse_empty(tables["nodes"])
    spark = tables["nodes"].sparkSession
    manifest = []
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        manifest.append((name, df.schema.simpleString()))
    spark.createDataFrame(manifest, "name string, schema string").coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    if views:
        spark.createDataFrame([(json.dumps(v),) for v in views], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/views")
