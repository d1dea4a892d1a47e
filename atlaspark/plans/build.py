"""The build: source files to a finished map, and a finished map to the map of a part of it."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import card_text, year_month
from ..operators.citations import remap_edges
from ..operators.knn import calibrated_knn
from ..operators.linear import axis_table, default_grain, discover_axes, ladder, layout, project
from ..operators.parse import assemble, chunk
from ..operators.rank import band, rank_scores, unit_disc, upper_median
from ..operators.regions import axis_drift, centroids, distinctive_terms, fallback_label, hubs, trajectory
from ..session import cut

DIM = 128


def hash_embed(df: DataFrame, key: str, text_col: str, dim: int = DIM) -> DataFrame:
    """(key, vec): the offline default model, signed hashed words with sublinear counts, unit length; a text without words is a zero vector.

    Any function of the same shape can take its place in ``build_map``.
    """
    kind = dict(df.dtypes)[key]

    def run(batches):
        for b in batches:
            out = np.zeros((b.num_rows, dim), np.float32)
            for i, t in enumerate(b.column(1).to_pylist()):
                for w in (t or "").lower().split():
                    h = zlib.crc32(w.encode("utf-8", "surrogatepass"))
                    out[i, h % dim] += 1 if h >> 31 else -1
            out = np.sign(out) * np.log1p(np.abs(out))
            out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), dim).cast(pa.list_(pa.float32()))], [key, "vec"])

    return df.select(key, text_col).mapInArrow(run, f"`{key}` {kind}, vec array<float>")


def embed_cached(df: DataFrame, key: str, text_col: str, cache: DataFrame | None, embed=hash_embed, model: str = "hash-128") -> tuple[DataFrame, DataFrame]:
    """((key, vec), new cache entries (k, vec)): only texts that the cache lacks for this model are embedded, each distinct text once. The key is a hash of the model's name and the text, so one cache can hold several models."""
    keyed = df.select(key, F.coalesce(F.col(text_col), F.lit(" ")).alias("t")).withColumn("k", F.sha2(F.concat(F.lit(model + "\x00"), "t"), 256))
    todo = keyed.select("k", "t").dropDuplicates(["k"])
    fresh = cut(embed(todo.join(cache, "k", "left_anti") if cache is not None else todo, "k", "t"))
    have = fresh.unionByName(cache.select("k", "vec")) if cache is not None else fresh
    return keyed.join(have, "k").select(key, "vec"), fresh


def pooled(docs: DataFrame, key: str, text_col: str, embed=hash_embed) -> DataFrame:
    """(key, vec): the mean of a document's chunk vectors, not normalised again."""
    chunks = chunk(docs, key, text_col).withColumn("c", F.struct(key, "chunk_no"))
    vecs = embed(chunks, "c", "text").select(F.col(f"c.{key}").alias(key), F.posexplode("vec").alias("i", "x"))
    means = vecs.groupBy(key, "i").agg(F.avg("x").alias("x"))
    return means.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"].cast("float")).alias("vec"))


def extract_card(docs: DataFrame, scores: DataFrame, axes: DataFrame) -> DataFrame:
    """(node_id, core, notes): the offline card: the first sentences up to 600 characters, and a note on each axis that the node stands near a pole of."""
    lead = F.regexp_extract(F.substring("body", 1, 600), "(?s)^(.*[.!?])(?:\\s|$)", 1)
    core = F.when(lead != "", lead).otherwise(F.substring("body", 1, 600))
    near = scores.join(F.broadcast(axes.select("pc", "key")), "pc").withColumn("note", F.when(F.col("score") >= 80, F.concat(F.lit("near the high pole of "), "key")).when(F.col("score") <= 20, F.concat(F.lit("near the low pole of "), "key")))  # at most 16 axes
    notes = near.where("note is not null").groupBy("node_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "note")))).alias("notes"))
    return docs.select("node_id", core.alias("core")).join(notes, "node_id", "left").withColumn("notes", F.coalesce("notes", F.create_map().cast("map<string,string>")))


def build_map(files: DataFrame, meta_col: str | None = "meta", embed=hash_embed, kmax: int = 27, min_chars: int | None = None) -> dict[str, DataFrame]:
    """Source files to the tables of a map: docs, axes, axis_scores, cards, vectors, knn, layout, ladder, levels, regions, nodes.

    Nodes are numbered by path, densely, so every table joins on node_id. The neighbour method that answered is in ``levels`` as its provenance.
    """
    parsed = cut(assemble(files, meta_col, min_chars))
    ordered = parsed.select("path").distinct().repartitionByRange("path")
    part = cut(ordered.select("path", F.spark_partition_id().alias("p")))
    w = Window.partitionBy("p").orderBy("path")
    offs = part.groupBy("p").agg(F.count("*").alias("n")).withColumn("off", F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)))  # a row per partition
    numbered = part.join(F.broadcast(offs), "p").select("path", (F.coalesce("off", F.lit(0)) + F.row_number().over(w) - 1).alias("node_id"))
    docs = cut(parsed.join(numbered, "path"))
    if docs.isEmpty():
        raise ValueError("no documents to map")
    full = cut(pooled(docs, "node_id", "body", embed))
    axes = discover_axes(full, "vec")
    axis_df = axis_table(docs.sparkSession, axes)
    scores = cut(rank_scores(project(full, "node_id", "vec", axes), "raw", "node_id", ["pc"]))
    cards = cut(extract_card(docs, scores, axis_df))
    texts = cards.join(docs.select("node_id", "title"), "node_id").select("node_id", card_text(F.col("title"), F.col("core"), F.map_values("notes")).alias("t"))
    return _geometry(docs, cards, cut(embed(texts, "node_id", "t")), {"axes": axis_df, "axis_scores": scores}, kmax)


def ring(vectors: DataFrame, n: int, radius: float = 0.6) -> DataFrame:
    """(node_id, x, y): fewer than five nodes, in their order on a ring."""
    turn = 2 * math.pi * (F.row_number().over(Window.orderBy("node_id")) - 1) / max(n, 1)  # four rows at most
    return vectors.select("node_id", turn.alias("t")).select("node_id", (F.cos("t") * radius).alias("x"), (F.sin("t") * radius).alias("y"))


def layouts(vectors: DataFrame, knn: DataFrame, n: int) -> DataFrame:
    """(node_id, x, y, x3, y3, z3, color_x, color_y): the flat and the deep layout, each axis with its 2nd to 98th percentile at -1..1, and the colour plane, two principal coordinates on the unit disc."""
    if n < 5:
        return ring(vectors, n).select("node_id", "x", "y", F.col("x").alias("x3"), F.col("y").alias("y3"), F.lit(0.0).alias("z3"), F.col("x").alias("color_x"), F.col("y").alias("color_y"))

    def banded(df: DataFrame, names: dict[str, str]) -> DataFrame:
        for a, b in names.items():
            df = band(df, a).withColumn(b, F.col("scaled")).drop("scaled", *({a} - {b}))
        return df

    flat = banded(cut(layout(vectors, "node_id", "vec", knn, 2, 10)), {"x": "x", "y": "y"})
    deep = banded(cut(layout(vectors, "node_id", "vec", knn, 3, 10)), {"x": "x3", "y": "y3", "z": "z3"})
    axes = discover_axes(vectors, "vec")
    plane = project(vectors, "node_id", "vec", {**axes, "components": axes["components"][:2]}).groupBy("node_id").agg(*[F.max(F.when(F.col("pc") == i, F.col("raw"))).alias(f"p{i}") for i in (1, 2)])
    disc = unit_disc(cut(plane), "p1", "p2").select("node_id", F.col("dx").alias("color_x"), F.col("dy").alias("color_y"))
    return flat.join(deep, "node_id").join(disc, "node_id")


def _geometry(docs: DataFrame, cards: DataFrame, vectors: DataFrame, done: dict[str, DataFrame], kmax: int) -> dict[str, DataFrame]:
    spark, n = docs.sparkSession, vectors.count()
    knn, method = calibrated_knn(vectors, "node_id", "vec", max(1, min(14, n - 1)))
    knn = cut(knn)
    flat = cut(layouts(vectors, knn, n))
    rungs, counts = ladder(vectors, "node_id", "vec", min(kmax, max(1, n // 2)))
    rungs = cut(rungs)
    levels = spark.createDataFrame([(i, c, i == default_grain(counts), method) for i, c in enumerate(counts)], "level int, count int, is_default boolean, neighbours string")
    groups = rungs.withColumn("r", F.struct("level", "region"))
    terms = distinctive_terms(cards, groups.select("node_id", "r"), "node_id", "core", "r")
    sizes = rungs.groupBy("level", "region").agg(F.count("*").alias("n"))
    names = fallback_label(terms, "r").select("r.level", "r.region", "label")
    mids = centroids(groups.join(flat, "node_id"), "r", "x", "y").select("r.level", "r.region", "cx", "cy")
    regions = sizes.join(names, ["level", "region"], "left").join(mids, ["level", "region"], "left").withColumn("label", F.coalesce("label", F.lit("region")))
    nodes = docs.select("node_id", "id", "title", "url", "path").join(flat, "node_id").join(hubs(knn, docs.select("node_id"), "node_id"), "node_id")
    made = spark.createDataFrame([("", "", n, "card")], "title string, parent string, count bigint, basis string")
    return {"docs": docs, "cards": cards, "vectors": vectors, "knn": knn, "layout": flat, "ladder": rungs, "levels": levels, "regions": regions, "nodes": nodes, "provenance": made, **done}


def descend(parent: dict[str, DataFrame], selection: DataFrame, kmax: int = 27, title: str = "selection") -> dict[str, DataFrame]:
    """The map of a selection as its own space: axes, neighbours, layout and regions anew over the selected rows, notes emptied, the embedding kept. Citations of which both ends are selected stay, and so do the selected rows of the generic columns; the provenance names the parent.

    An id that the parent does not have is an error, and so are fewer than two.
    """
    ids = cut(selection.select("node_id").distinct())
    if not ids.join(parent["docs"], "node_id", "left_anti").isEmpty():
        raise ValueError("the selection has ids that the map does not have")
    if ids.count() < 2:
        raise ValueError("a map needs two nodes at least")
    keep = lambda name: cut(parent[name].join(ids, "node_id", "left_semi"))
    docs, vectors = keep("docs"), keep("vectors")
    cards = keep("cards").withColumn("notes", F.create_map().cast("map<string,string>"))
    axes = discover_axes(vectors, "vec")
    scores = rank_scores(project(vectors, "node_id", "vec", axes), "raw", "node_id", ["pc"])
    out = _geometry(docs, cards, vectors, {"axes": axis_table(docs.sparkSession, axes), "axis_scores": scores}, kmax)
    if "cite" in parent:
        out["cite"] = cut(remap_edges(parent["cite"], ids))
    if "cols" in parent:
        out["cols"] = keep("cols")
    before = parent["provenance"].first() if "provenance" in parent else None
    out["provenance"] = docs.sparkSession.createDataFrame([(title, before.title if before else "", vectors.count(), before.basis if before else "card")], "title string, parent string, count bigint, basis string")
    return out


REQUIRED = {
    "docs": ("node_id",), "cards": ("node_id", "core"), "vectors": ("node_id", "vec"), "layout": ("node_id", "x", "y"), "nodes": ("node_id", "title", "hub"), "axes": ("pc", "key", "variance"), "axis_scores": ("node_id", "pc", "score"),
    "ladder": ("level", "node_id", "region"), "levels": ("level", "count", "is_default"), "regions": ("level", "region", "n", "label"),
}


def check_map(tables: dict[str, DataFrame]) -> None:
    """Every table that a map needs is there with its columns, and every per-node table covers exactly the documents, or an error names it."""
    for name, columns in REQUIRED.items():
        if name not in tables or not set(columns) <= set(tables[name].columns):
            raise ValueError(f"{name} is missing or lacks one of {', '.join(columns)}")
    ids = tables["docs"].select("node_id")
    for name in ("cards", "vectors", "layout", "nodes"):
        t = tables[name].select("node_id")
        if not (ids.join(t, "node_id", "left_anti").isEmpty() and t.join(ids, "node_id", "left_anti").isEmpty()) or t.count() != ids.count():
            raise ValueError(f"{name} does not match the documents")


def report(tables: dict[str, DataFrame], title: str = "Map", top: int = 10) -> str:
    """A Markdown report: the regions of the default grain by size with their best linked node, the axes by weight, the best linked nodes."""
    grain = tables["levels"].where("is_default").first().level
    members = tables["ladder"].where(F.col("level") == grain).join(tables["nodes"].select("node_id", "title", "hub"), "node_id")
    best = members.groupBy("region").agg(F.max_by("title", F.struct("hub", -F.col("node_id"))).alias("exemplar"))
    regions = tables["regions"].where(F.col("level") == grain).join(best, "region").orderBy(F.desc("n"), "region").collect()
    lines = [f"# {title}", "", "## Regions", ""] + [f"- **{r.label}** ({r.n}): {r.exemplar}" for r in regions]
    lines += ["", "## Axes", ""] + [f"- {a.key}: {a.variance:.4f}{' (weak)' if a.weak else ''}" for a in tables["axes"].orderBy(F.desc("variance"), "pc").collect()]
    lines += ["", "## Read first", ""] + [f"{i + 1}. {r.title}" for i, r in enumerate(tables["nodes"].orderBy(F.desc("hub"), "node_id").limit(top).collect())]
    docs = tables["docs"]
    if "read_progress" in docs.columns:
        unread = tables["nodes"].join(docs.where(~F.coalesce(F.col("read_progress") > 0.05, F.lit(False))).select("node_id"), "node_id", "left_semi")
        lines += ["", "## Unread", ""] + [f"{i + 1}. {r.title}" for i, r in enumerate(unread.orderBy(F.desc("hub"), "node_id").limit(top).collect())]
    if "ghosts" in tables:
        lines += ["", "## Referred to, not here", ""] + [f"- {g.title or g.key} ({g.n})" for g in tables["ghosts"].orderBy(F.desc("n"), "key").limit(12).collect()]
    return "\n".join(lines) + "\n"


def state_text(tables: dict[str, DataFrame], date: str = "date_ms") -> str | None:
    """Where the corpus has moved, as Markdown: the regions of the default grain by the change of their share after the median date, and the axes that drifted. None for fewer than 20 dated nodes."""
    docs = tables["docs"]
    dated = docs.where(F.col(date) > 0)
    n = dated.count()
    if n < 20:
        return None
    grain = tables["levels"].where("is_default").first().level
    members = tables["ladder"].where(F.col("level") == grain).join(docs.select("node_id", date), "node_id")
    moved = trajectory(members, date, "region").join(tables["regions"].where(F.col("level") == grain).select("region", "label"), "region").orderBy(F.desc("delta"), "region").collect()
    month = upper_median(dated, date, out="m").select(year_month(F.col("m")).alias("m")).first().m
    lines = ["# State of the corpus", "", f"{n} dated nodes, halved at {month}", "", "## Regions by the change of their share", ""]
    lines += [f"- {r.trend}: **{r.label}** {r.delta * 100:+.1f} points" for r in moved]
    names = {a.pc: a for a in tables["axes"].collect()}
    drift = axis_drift(docs, tables["axis_scores"].select("node_id", "pc", "score"), date).orderBy("pc").collect()
    lines += ["", "## Axes that drifted", ""] + [f"- {names[d.pc].key}: {d.early:.0f} to {d.late:.0f}, towards its {d.pole} end" for d in drift if d.pc in names]
    return "\n".join(lines) + "\n"
