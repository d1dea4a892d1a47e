"""Dataset exports and fixtures as sources: paged rows through a Spark data source, splits, and a prepared corpus with its vectors."""

from __future__ import annotations

import json
import os
import re
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.parse import parse_files
from .files import FolderSource, TableSource, text_candidates

PAGE, ATTEMPTS, LONGEST = 100, 8, 60.0


@dataclass(frozen=True)
class Payload:
    """What every connector hands over: source files, a name and where they come from."""

    files: DataFrame
    name: str
    source: str


def dataset_id(text: str) -> str | None:
    """owner/name out of an id or an address that ends in /datasets/owner/name; None for anything else."""
    m = re.fullmatch(r"(?:https?://[^/\s]+/datasets/)?([\w.-]+/[\w.-]+?)/?(?:[?#].*)?", text.strip())
    return m[1] if m else None


def pick_split(splits: list[str]) -> str | None:
    return "train" if "train" in splits else splits[0] if splits else None


def page_with_retry(fetch, at: int, length: int, attempts: int = ATTEMPTS, sleep=time.sleep):
    """fetch(at, length), again after a failure whose ``status`` is 429 or from 500 on, or that has none; waits double up to a minute and are never shorter than ``after``."""
    for i in range(attempts + 1):
        try:
            return fetch(at, length)
        except Exception as e:  # noqa: BLE001 - whatever a transport raises
            status = getattr(e, "status", None)
            if i == attempts or (status is not None and status != 429 and status < 500):
                raise
            sleep(min(LONGEST, max(2.0**i, getattr(e, "after", None) or 0.0)))


@dataclass
class Pages(InputPartition):
    """Rows ``at`` to ``end`` of an export, read a page at a time by one task."""

    at: int
    end: int


class PagedReader(DataSourceReader):
    def __init__(self, schema, options):
        self.schema, self.options = schema, options
        self.path, self.page = options["path"], int(options.get("page", PAGE))

    def partitions(self):
        total, per = int(self.options["rows"]), self.page * int(self.options.get("pages_per_task", 50))
        return [Pages(a, min(a + per, total)) for a in range(0, total, per)] or [Pages(0, 0)]

    def read(self, part):
        names = [f.name for f in self.schema.fields]
        for at in range(part.at, part.end, self.page):
            for row in page_with_retry(self.fetch, at, min(self.page, part.end - at)):
                yield tuple(row.get(n) for n in names)

    def fetch(self, at: int, length: int) -> list[dict]:
        """One page of a JSON-lines export whose lines are indexed by their byte offsets (8 bytes each, little end first) in <path>.idx."""
        with open(self.path + ".idx", "rb") as f:
            f.seek(8 * at)
            ends = [int.from_bytes(f.read(8), "little") for _ in range(length + 1)]
        with open(self.path, "rb") as f:
            f.seek(ends[0])
            return [json.loads(line) for line in f.read(ends[-1] - ends[0]).splitlines()]


class PagedSource(DataSource):
    """Format ``atlaspark_pages``: rows of an export in pages, one task for every ``pages_per_task`` of them. Another transport overrides ``PagedReader.fetch``."""

    @classmethod
    def name(cls):
        return "atlaspark_pages"

    def schema(self):
        return self.options["schema"]

    def reader(self, schema):
        return PagedReader(schema, self.options)


def index_lines(path: str) -> int:
    """Write the byte offsets of a JSON-lines file beside it; returns its lines."""
    at, n = 0, 0
    with open(path, "rb") as src, open(path + ".idx", "wb") as out:
        for line in src:
            out.write(at.to_bytes(8, "little"))
            at += len(line)
            n += 1
        out.write(at.to_bytes(8, "little"))
    return n


@dataclass(frozen=True)
class DatasetSource:
    """A dataset export: a folder with one Parquet or JSON folder or file per split. The split is ``train`` if there is one, else the first; the text is the column named, else the longest string column on average."""

    path: str
    name: str
    split: str | None = None
    text_col: str | None = None

    def describe(self) -> str:
        return f"dataset {self.name}"

    def splits(self) -> list[str]:
        return sorted({re.sub(r"(-\d+-of-\d+)?\.(parquet|jsonl?|ndjson)$", "", n) for n in os.listdir(self.path) if not n.startswith((".", "_"))})

    def frame(self, spark: SparkSession) -> DataFrame:
        split = self.split or pick_split(self.splits())
        if split is None:
            raise ValueError(f"{self.path} has no split")
        files = [n for n in os.listdir(self.path) if n == split or re.fullmatch(re.escape(split) + r"(-\d+-of-\d+)?\.(parquet|jsonl?|ndjson)", n)]
        read = spark.read.parquet if any(n.endswith(".parquet") or n == split for n in files) else spark.read.json
        return read(*[os.path.join(self.path, n) for n in sorted(files)])

    def load(self, spark: SparkSession) -> DataFrame:
        df = self.frame(spark)
        text = self.text_col
        if text is None:
            names = text_candidates(df)
            if not names:
                raise ValueError("no column of text")
            means = df.agg(*[F.coalesce(F.avg(F.length(c)), F.lit(0.0)).alias(c) for c in names]).first().asDict()
            text = max(names, key=lambda c: (means[c], -names.index(c)))
        return TableSource(df, text, self.name).load(spark)

    def payload(self, spark: SparkSession) -> Payload:
        return Payload(self.load(spark), self.name, self.describe())


@dataclass(frozen=True)
class FixtureSource:
    """A prepared corpus: JSON lines of (id, title, category, author, reading_progress, vec), a list of the ids to keep, and a folder of Markdown files that declare their id."""

    meta: str
    keep: str
    folder: str

    def describe(self) -> str:
        return f"fixture {self.meta}"

    def load(self, spark: SparkSession) -> DataFrame:
        """(id, title, body, cat, date_ms, author, url, path, read_progress, vec): kept rows only; one whose file is missing has an empty body. Of several files of one id the last by path counts."""
        rows = spark.read.schema("id string, title string, category string, author string, reading_progress double, vec array<float>").json(self.meta)
        kept = rows.join(spark.read.schema("id string").json(self.keep).distinct(), "id", "left_semi").dropDuplicates(["id"])
        files = FolderSource(self.folder).load(spark).where(F.col("name").endswith(".md"))
        parsed = parse_files(files.select("path", "name", "text"), 0).where("front <> ''").groupBy("id").agg(F.max_by(F.struct("path", "body", "date_ms", "url", "read_progress"), "path").alias("f"))
        return kept.join(parsed, "id", "left").select(
            "id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("f.body", F.lit("")).alias("body"), F.col("category").alias("cat"), F.col("f.date_ms").alias("date_ms"), "author", F.col("f.url").alias("url"), F.col("f.path").alias("path"),
            F.coalesce("reading_progress", "f.read_progress").alias("read_progress"), "vec",
        )
