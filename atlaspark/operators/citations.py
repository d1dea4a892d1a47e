"""References between documents: edges inside the corpus, the frontier outside it, and ghosts placed on the map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .knn import exact_knn


def external_key(arxiv: Column, title: Column) -> Column:
    """What an outside paper is known by: its arXiv number, else the first 60 characters of its title in lower case."""
    return F.coalesce(F.when(arxiv != "", arxiv), F.when(F.trim(title) != "", F.substring(F.lower(F.trim(title)), 1, 60)))


def cite_edges(references: DataFrame, docs: DataFrame, key: str = "node_id") -> DataFrame:
    """(src, dst) inside the corpus. ``references`` is (key, arxiv, citing): key refers to the paper arxiv or, where ``citing`` is true, is referred to by it.

    A paper that several documents carry stands for the one of the largest key. Self edges are dropped, repeated edges count once, nulls and papers outside the corpus are left out.
    """
    held = docs.where("arxiv <> ''").groupBy("arxiv").agg(F.max(key).alias("other"))
    met = references.join(held, "arxiv").where(F.col(key) != F.col("other"))
    turned = F.coalesce(F.col("citing"), F.lit(False))
    return met.select(F.when(turned, F.col("other")).otherwise(F.col(key)).alias("src"), F.when(turned, F.col(key)).otherwise(F.col("other")).alias("dst")).distinct()


def remap_edges(edges: DataFrame, keep: DataFrame, key: str = "node_id") -> DataFrame:
    """The edges (src, dst) of which both ends are kept; self edges dropped."""
    ends = keep.select(key).distinct()
    inner = edges.where("src <> dst").join(ends.withColumnRenamed(key, "src"), "src", "left_semi")
    return inner.join(ends.withColumnRenamed(key, "dst"), "dst", "left_semi").select("src", "dst")


def cite_counts(edges: DataFrame, nodes: DataFrame, key: str = "node_id") -> DataFrame:
    """(key, n): how often each node is referred to, 0 included."""
    n = edges.groupBy(F.col("dst").alias(key)).agg(F.count("*").alias("n"))
    return nodes.select(key).join(n, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))


def frontier_keys(keys: DataFrame, inside: DataFrame, top: int = 500) -> DataFrame:
    """(key, n): the keys outside the corpus by how often they are referred to, ties by key, at most ``top``. Nulls are left out."""
    out = keys.where("key is not null").join(inside.where("key is not null").distinct(), "key", "left_anti")
    return out.groupBy("key").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "key").limit(top)


def place_ghosts(ghosts: DataFrame, cards: DataFrame, key: str, vec: str, k: int = 6) -> DataFrame:
    """(key, x, y, sim): each outside vector at the mean of its k nearest cards' positions, weighted by max(0, cosine), and its best cosine.

    ``cards`` has key, vec, x and y. A ghost whose weights sum to 0 lies at the plain mean. Ghosts are compared with every card, in blocks.
    """
    near = exact_knn(cards, key, vec, k, queries=ghosts)
    at = near.join(cards.select(F.col(key).alias("dst"), "x", "y"), "dst").withColumn("w", F.greatest(F.lit(0.0), F.col("sim")))
    mean = lambda c: F.round(F.coalesce(F.sum(F.col("w") * F.col(c)) / F.nullif(F.sum("w"), F.lit(0.0)), F.avg(c)), 4)
    return at.groupBy(F.col("src").alias(key)).agg(mean("x").alias("x"), mean("y").alias("y"), F.round(F.max("sim"), 3).alias("sim"))


def frontier_on_map(references: DataFrame, docs: DataFrame, cards: DataFrame, embed, top: int = 500, key: str = "node_id") -> tuple[DataFrame, DataFrame]:
    """(edges, ghosts): a map's citation edges, and the papers outside it that it refers to most, placed among its cards.

    ``references`` is (key, arxiv, citing, title, url, core) of what each document refers to or is cited by, given as a table; ``embed`` is a function of (table, key, text column) as
    the build's. Ghosts are (key, title, arxiv, url, n, core, x, y, sim); of several texts for one paper the first in order stays.
    """
    edges = cite_edges(references, docs, key)
    named = references.withColumn("key", external_key(F.col("arxiv"), F.col("title")))
    inside = docs.select(external_key(F.col("arxiv"), F.col("title")).alias("key")).union(docs.select(external_key(F.lit(""), F.col("title")))).distinct()
    keys = frontier_keys(named.select("key"), inside, top)
    text = named.groupBy("key").agg(*[F.min(c).alias(c) for c in ("title", "arxiv", "url", "core")])
    ghosts = keys.join(text, "key").withColumn("ghost", F.xxhash64("key"))
    vectors = embed(ghosts.withColumn("t", F.concat_ws(". ", "title", "core")), "ghost", "t")
    placed = place_ghosts(vectors.withColumnRenamed("ghost", key), cards, key, "vec").withColumnRenamed(key, "ghost")
    return edges, ghosts.join(placed, "ghost").select("key", "title", "arxiv", "url", "n", "core", "x", "y", "sim")


def strongest_references(edges: DataFrame, nodes: DataFrame, key: str, k: int = 10) -> DataFrame:
    """(src, place, dst): each node's k most referred-to references, ties by key."""
    counted = edges.join(cite_counts(edges, nodes, key).select(F.col(key).alias("dst"), "n"), "dst")
    return counted.withColumn("place", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("n"), "dst"))).where(F.col("place") <= k).select("src", "place", "dst")
