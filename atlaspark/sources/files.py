"""Sources: folders, tables of rows, map tables, key-value logs."""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


MANIFEST = "atlaspark-vault.json"


class Source(Protocol):
    """Anything that describes itself and yields source files (path, name, text, meta)."""

    def describe(self) -> str: ...

    def load(self, spark: SparkSession) -> DataFrame: ...


@F.pandas_udf(StringType())
def decoded(content: pd.Series) -> pd.Series:
    """Bytes as text, with replacement characters for what is no UTF-8."""
    return content.map(lambda b: None if b is None else bytes(b).decode("utf-8", "replace"))


@dataclass(frozen=True)
class FolderSource:
    """Every .md, .markdown and .txt file below a folder, on any file system that Spark reads; the time of change becomes metadata.

    Other files are listed but not read. Bytes that are no UTF-8 become U+FFFD, so a stray binary file is skipped later and does not end the load. A manifest in the
    folder gives the title.
    """

    path: str

    def describe(self) -> str:
        return f"folder {self.path}"

    def title(self, spark: SparkSession) -> str:
        """The manifest's title, else the folder's name."""
        found = spark.read.format("binaryFile").option("pathGlobFilter", MANIFEST).load(self.path).select("content").head(1)
        manifest = vault_manifest(bytes(found[0][0]).decode("utf-8", "replace")) if found else None
        return (manifest or {}).get("title") or self.path.rstrip("/").rsplit("/", 1)[-1]

    def load(self, spark: SparkSession) -> DataFrame:
        wanted = "*.{" + ",".join("".join(f"[{c}{c.upper()}]" for c in ext) for ext in ("md", "markdown", "txt")) + "}"
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", wanted).load(self.path)
        meta = F.to_json(F.struct(F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("modified")))
        return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), decoded("content").alias("text"), meta.alias("meta"))


@dataclass(frozen=True)
class TableSource:
    """Rows as files: one column holds the text, an id-like one the title, every other primitive or array of primitives is metadata.

    Titles come from the first column named id, title or name, blanks and quotes collapsed, at most 200 characters, else "<name> · row N". Nested objects are left out.
    """

    frame: DataFrame
    text_col: str
    name: str = "rows"
    order: str | None = None

    def describe(self) -> str:
        return f"table {self.name}"

    def load(self, spark: SparkSession) -> DataFrame:
        df = self.frame
        title_col = next((c for c in df.columns if c.lower() in ("id", "title", "name") and c != self.text_col), None)
        kinds = dict(df.dtypes)
        plain = [c for c in df.columns if c != self.text_col and c != title_col and not kinds[c].startswith(("struct", "map", "array<struct", "array<map", "array<array", "binary"))]
        key = F.col(self.order) if self.order else F.xxhash64(*df.columns)
        n = F.conv(F.hex(key), 16, 36) if not self.order else key.cast("string")
        named = F.substring(F.trim(F.regexp_replace(F.col(title_col).cast("string"), '[\\s"]+', " ")), 1, 200) if title_col else F.lit(None).cast("string")
        title = F.coalesce(F.when(named != "", named), F.concat(F.lit(f"{self.name} · row "), n))
        text = F.concat(F.lit('---\nid: "row-'), n, F.lit('"\ntitle: "'), title, F.lit('"\n---\n'), F.coalesce(F.col(self.text_col).cast("string"), F.lit("")))
        meta = F.to_json(F.struct(*plain)) if plain else F.lit(None).cast("string")
        return df.select(F.concat(F.lit(f"{self.name}/"), n).alias("path"), F.concat(F.lit("row-"), n, F.lit(".md")).alias("name"), text.alias("text"), meta.alias("meta"))


def text_candidates(df: DataFrame) -> list[str]:
    """The columns that can hold the text: strings that do not look like an id."""
    return [c for c, t in df.dtypes if t == "string" and c.lower() not in ("id", "title", "name")]


def read_cache(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """((k, v), malformed lines): a log of JSON lines {"k", "v"}; the last line of a key wins, torn or malformed lines are counted, not fatal."""
    raw = spark.read.text(path).select(F.col("value"), F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    parsed = raw.withColumn("o", F.from_json("value", "k STRING, v STRING"))
    good = parsed.where("o.k is not null").groupBy("o.k").agg(F.max_by("o.v", F.struct("f", "b", "i")).alias("v"))
    return good, parsed.where("trim(value) <> '' and o.k is null").select("value")


def append_cache(rows: DataFrame, path: str) -> None:
    """Append (k, v) rows to a log; the committer renames whole files, so a reader sees no torn line."""
    rows.select(F.to_json(F.struct("k", "v")).alias("value")).write.mode("append").text(path)


def vault_manifest(text: str) -> dict | None:
    """The manifest that gives a vault's title and source, or None where the text is no manifest."""
    try:
        m = json.loads(text)
    except ValueError:
        return None
    return m if isinstance(m, dict) and m.get("kind") == "vault" else None
