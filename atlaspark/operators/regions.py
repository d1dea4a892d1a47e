"""What sets groups of nodes apart: sizes, centres, terms, axes, drift, redundancy."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from .rank import upper_median


def term_counts(docs: DataFrame, key: str, text_col: str) -> DataFrame:
    """(key, term, n): how often each term stands in each document."""
    return docs.select(key, F.explode(tokens(F.col(text_col))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("n"))


def term_index(counts: DataFrame, key: str) -> DataFrame:
    """(term, n, df): a term's count over the corpus and the documents that have it."""
    return counts.groupBy("term").agg(F.sum("n").alias("n"), F.count("*").alias("df"))


def distinctive_terms(docs: DataFrame, groups: DataFrame, key: str, text_col: str, group: str, top: int = 8, min_docs: int = 2, max_df: float = 0.6) -> DataFrame:
    """(group, place, term, score): the terms that a group uses more than the corpus does.

    ``groups`` is (key, group); a node may be in several. Kept are terms in at least min(min_docs, group size) of the group's documents and at most max_df of all;
    the score is ln(share in group / share overall) ln(1 + documents in group), ties by term.
    """
    counts = term_counts(docs, key, text_col)
    corpus = term_index(counts, key).withColumnRenamed("n", "n_all")
    size = docs.agg(F.count("*").alias("docs_all"))
    total = counts.agg(F.sum("n").alias("t_all"))
    members = groups.groupBy(group).agg(F.count("*").alias("size"))
    inside = counts.join(groups, key).groupBy(group, "term").agg(F.sum("n").alias("n_in"), F.count("*").alias("docs_in"))
    whole = inside.groupBy(group).agg(F.sum("n_in").alias("t_in"))
    joined = inside.join(whole, group).join(members, group).join(corpus, "term").crossJoin(F.broadcast(size)).crossJoin(F.broadcast(total))  # one row each
    kept = joined.where((F.col("docs_in") >= F.least(F.lit(min_docs), F.col("size"))) & (F.col("df") <= max_df * F.col("docs_all")))
    score = F.log((F.col("n_in") / F.col("t_in")) / (F.col("n_all") / F.col("t_all"))) * F.log1p(F.col("docs_in"))
    ranked = kept.withColumn("score", F.round(score, 6)).withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("score"), "term")))
    return ranked.where(F.col("place") <= top).select(group, "place", "term", "score")


def distinctive_axes(scores: DataFrame, groups: DataFrame, key: str, group: str, top: int = 4) -> DataFrame:
    """(group, place, pc, pole, mean): the axes on which a group's mean score lies farthest from 50; a missing score counts as 50."""
    means = scores.join(groups, key).groupBy(group, "pc").agg(F.avg(F.coalesce("score", F.lit(50))).alias("m"))
    ranked = means.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(F.round(F.abs(F.col("m") - 50), 9)), "pc"))).where(F.col("place") <= top)
    return ranked.select(group, "place", "pc", F.when(F.col("m") >= 50, "high").otherwise("low").alias("pole"), F.round("m").cast("int").alias("mean"))


def fallback_label(terms: DataFrame, group: str) -> DataFrame:
    """(group, label): the two best terms, capitalised; 'region' where there is none."""
    best = terms.where("place <= 2").groupBy(group).agg(F.sort_array(F.collect_list(F.struct("place", "term"))).alias("t"))
    names = F.array_join(F.transform("t", lambda x: F.concat(F.upper(F.substring(x["term"], 1, 1)), F.substring(x["term"], 2, 1000))), " / ")
    return best.select(group, F.coalesce(F.when(names != "", names), F.lit("region")).alias("label"))


def centroids(nodes: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """(group, cx, cy): the upper median of each coordinate; 0 where a group has none."""
    groups = nodes.select(group).distinct()
    mx, my = upper_median(nodes, x, [group], "cx"), upper_median(nodes, y, [group], "cy")
    return groups.join(mx, group, "left").join(my, group, "left").select(group, F.coalesce("cx", F.lit(0.0)).alias("cx"), F.coalesce("cy", F.lit(0.0)).alias("cy"))


def hues(nodes: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """(group, hue): the angle of the group's mean colour coordinate, 0..360."""
    m = nodes.groupBy(group).agg(F.avg(x).alias("mx"), F.avg(y).alias("my"))
    return m.select(group, F.round(F.pmod(F.degrees(F.atan2("my", "mx")) + 360, F.lit(360.0)), 4).alias("hue"))


def trajectory(nodes: DataFrame, date: str, group: str, least: int = 20, still: float = 0.008) -> DataFrame:
    """(group, early, late, delta, trend): how each group's share changed after the upper-median date.

    Only positive dates count; fewer than ``least`` of them give no rows. A date up to the median is early.
    """
    dated = nodes.where(F.col(date) > 0)
    cut_ = upper_median(dated, date, out="_mid").crossJoin(dated.agg(F.count("*").alias("_n"))).where(F.col("_n") >= least)  # one row each
    half = dated.crossJoin(F.broadcast(cut_)).withColumn("_early", F.col(date) <= F.col("_mid"))
    totals = half.agg(F.count_if("_early").alias("e"), F.count_if(~F.col("_early")).alias("l"))
    g = half.groupBy(group).agg(F.count_if("_early").alias("ge"), F.count_if(~F.col("_early")).alias("gl")).crossJoin(F.broadcast(totals))  # one row
    early, late = F.coalesce(F.col("ge") / F.nullif("e", F.lit(0)), F.lit(0.0)), F.coalesce(F.col("gl") / F.nullif("l", F.lit(0)), F.lit(0.0))
    d = late - early
    return g.select(group, F.round(early, 6).alias("early"), F.round(late, 6).alias("late"), F.round(d, 6).alias("delta"), F.when(d > still, "rising").when(d < -still, "cooling").otherwise("steady").alias("trend"))


def axis_drift(nodes: DataFrame, scores: DataFrame, date: str, key: str = "node_id", least: int = 20, notable: float = 1.5) -> DataFrame:
    """(pc, early, late, pole): the axes on which the mean score moved by ``notable`` at least after the upper-median date, and the pole it moved towards.

    Only nodes of a positive date count, fewer than ``least`` give no rows; a missing score counts as 0.
    """
    dated = nodes.where(F.col(date) > 0).select(key, F.col(date).alias("_d"))
    mid = upper_median(dated, "_d", out="_mid").crossJoin(dated.agg(F.count("*").alias("_n"))).where(F.col("_n") >= least)  # one row each
    half = dated.crossJoin(F.broadcast(mid)).select(key, (F.col("_d") <= F.col("_mid")).alias("_early"))
    sizes = half.agg(F.count_if("_early").alias("_e"), F.count_if(~F.col("_early")).alias("_l"))  # one row
    sums = scores.join(half, key).groupBy("pc").agg(F.sum(F.when(F.col("_early"), F.col("score"))).alias("e"), F.sum(F.when(~F.col("_early"), F.col("score"))).alias("l"))
    mean = lambda s, n: F.coalesce(F.coalesce(F.col(s), F.lit(0)) / F.nullif(n, F.lit(0)), F.lit(0.0))
    out = sums.crossJoin(F.broadcast(sizes)).select("pc", F.round(mean("e", "_e"), 6).alias("early"), F.round(mean("l", "_l"), 6).alias("late"))
    return out.where(F.abs(F.col("late") - F.col("early")) >= notable).withColumn("pole", F.when(F.col("late") > F.col("early"), "high").otherwise("low"))


def redundant_pairs(wide: DataFrame, axes: list[str], top: int = 6) -> DataFrame:
    """(a, b, r): the pairs of axes of the highest absolute population correlation, ties by name, from one pass over the rows."""
    pairs = [(a, b) for i, a in enumerate(axes) for b in axes[i + 1 :]]
    base = wide.select(*[F.col(a).cast("double").alias(a) for a in axes])
    sums = base.agg(*[F.stddev_pop(a).alias(f"s_{a}") for a in axes], *[F.covar_pop(a, b).alias(f"c_{a}_{b}") for a, b in pairs])
    floor = lambda a: F.greatest(F.col(f"s_{a}"), F.lit(1e-9))
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(F.col(f"c_{a}_{b}") / (floor(a) * floor(b)), 6).alias("r")) for a, b in pairs])
    return sums.select(F.explode(rows).alias("x")).select("x.*").orderBy(F.desc(F.abs("r")), "a", "b").limit(top)


def region_samples(members: DataFrame, group: str, order: str, title: str, core: str, k: int = 12, width: int = 220) -> DataFrame:
    """(group, samples): the first k members of each group as text, title and restatement, each cut to ``width``."""
    first = members.withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy(order))).where(F.col("_r") <= k)
    line = F.substring(F.concat(F.coalesce(F.col(title), F.lit("")), F.lit(" — "), F.coalesce(F.col(core), F.lit(""))), 1, width)
    return first.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", line.alias("t")))), lambda x: x["t"]), "\n\n").alias("samples"))


def redundancy(wide: DataFrame, axes: list[str], strong: float = 0.5, passing: float = 0.3) -> DataFrame:
    """(pairs, mean_abs_r, strong_pairs, passes): population correlation of every pair of axes, in one pass over the rows."""
    pairs = [(a, b) for i, a in enumerate(axes) for b in axes[i + 1 :]]
    base = wide.select(*[F.col(a).cast("double").alias(a) for a in axes])
    sums = base.agg(F.count("*").alias("n"), *[F.avg(a).alias(f"m_{a}") for a in axes], *[F.stddev_pop(a).alias(f"s_{a}") for a in axes], *[F.covar_pop(a, b).alias(f"c_{a}_{b}") for a, b in pairs])
    floor = lambda a: F.greatest(F.col(f"s_{a}"), F.lit(1e-9))
    rs = F.array(*[F.abs(F.col(f"c_{a}_{b}") / (floor(a) * floor(b))) for a, b in pairs])
    mean = F.aggregate(rs, F.lit(0.0), lambda s, r: s + r) / len(pairs)
    return sums.select(F.lit(len(pairs)).alias("pairs"), F.round(mean, 6).alias("mean_abs_r"), F.size(F.filter(rs, lambda r: r >= strong)).alias("strong_pairs"), (mean < passing).alias("passes"))


def member_set_key(groups: DataFrame, key: str, group: str) -> DataFrame:
    """(group, members_key, n): equal for groups of the same members whatever their order, without collecting them."""
    return groups.groupBy(group).agg(F.bit_xor(F.xxhash64(key)).alias("x"), F.sum(F.shiftright(F.xxhash64(F.lit(1), key), 20)).alias("s"), F.count("*").alias("n")).select(group, F.xxhash64("x", "s", "n").alias("members_key"), "n")


def drill(ladder: DataFrame, level: int, region: int, ahead: int = 3) -> DataFrame:
    """(level, regions): the nearest finer level, at most ``ahead`` on, on which the region's members occupy two regions or more."""
    inside = ladder.where((F.col("level") == level) & (F.col("region") == region)).select("node_id")
    finer = ladder.where((F.col("level") > level) & (F.col("level") <= level + ahead)).join(inside, "node_id", "left_semi")
    return finer.groupBy("level").agg(F.count_distinct("region").alias("regions")).where("regions >= 2").orderBy("level").limit(1)


def hubs(knn: DataFrame, nodes: DataFrame, key: str, k: int = 8) -> DataFrame:
    """(key, hub): how many lists of the k nearest a node is on."""
    n = knn.where(F.col("rank") <= k).groupBy(F.col("dst").alias(key)).agg(F.count("*").alias("hub"))
    return nodes.select(key).join(n, key, "left").select(key, F.coalesce("hub", F.lit(0)).alias("hub"))


def agreement(a: DataFrame, b: DataFrame, n: int) -> DataFrame:
    """(agree): the mean number of shared neighbours per node between two neighbour tables (src, dst)."""
    return a.join(b, ["src", "dst"]).agg(F.round(F.count("*") / F.lit(max(n, 1)), 4).alias("agree"))
