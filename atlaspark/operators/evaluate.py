"""How well neighbours agree with labels from elsewhere, and clusterings of a given number."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def label_precision(knn: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, score): the share of a labelled node's labelled neighbours that have a label in common with it.

    ``labels`` is (node, label), several rows per node allowed. Neighbours without labels are left out; a node of which no neighbour is labelled has no score.
    """
    a = labels.select(F.col("node").alias("src"), F.col("label").alias("la")).distinct().groupBy("src").agg(F.collect_set("la").alias("la"))
    b = labels.select(F.col("node").alias("dst"), F.col("label").alias("lb")).distinct().groupBy("dst").agg(F.collect_set("lb").alias("lb"))
    return knn.select("src", "dst").join(a, "src").join(b, "dst").groupBy(F.col("src").alias("node")).agg(F.avg(F.arrays_overlap("la", "lb").cast("double")).alias("score"))


def scalar_difference(knn: DataFrame, values: DataFrame) -> DataFrame:
    """(node, score): the mean absolute difference of a value (node, v) from the neighbours' ones."""
    a = values.where("v is not null").select(F.col("node").alias("src"), F.col("v").alias("a"))
    b = values.where("v is not null").select(F.col("node").alias("dst"), F.col("v").alias("b"))
    return knn.select("src", "dst").join(a, "src").join(b, "dst").groupBy(F.col("src").alias("node")).agg(F.avg(F.abs(F.col("a") - F.col("b"))).alias("score"))


POISSON = np.cumsum([np.exp(-1) / math.factorial(k) for k in range(16)])  # of mean 1


def paired_bootstrap(a: DataFrame, b: DataFrame, resamples: int = 2000, seed: int = 42) -> tuple[float, float, float, int] | None:
    """(difference, 2.5 %, 97.5 %, n) of two score tables (node, score) over the nodes that both have; None for fewer than two.

    Each resample gives every node a Poisson(1) weight, drawn where the row lies, so a task sends one sum per resample and no row moves.
    """
    import pyarrow as pa

    both = a.where("score is not null").select("node", F.col("score").alias("x")).join(b.where("score is not null").select("node", F.col("score").alias("y")), "node").select(F.xxhash64("node", F.lit(seed)).alias("h"), (F.col("x") - F.col("y")).alias("d"))

    def run(batches):
        s, w = np.zeros(resamples), np.zeros(resamples)
        total, n = 0.0, 0
        for t in batches:
            for at in range(0, t.num_rows, 1024):
                h, d = (t.column(i).slice(at, 1024).to_numpy() for i in (0, 1))
                # a uniform number for each node and resample from both their hashes, and from it the Poisson weight
                x = h.view(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(resamples, dtype=np.uint64)[None, :] * np.uint64(0xBF58476D1CE4E5B9)
                x = (x ^ (x >> np.uint64(30))) * np.uint64(0x94D049BB133111EB)
                k = np.searchsorted(POISSON, ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53), "right")
                s += d @ k
                w += k.sum(axis=0)
                total += d.sum()
                n += len(d)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([n], pa.int64()), pa.array([list(s)]), pa.array([list(w)])], ["t", "n", "s", "w"])

    parts = both.mapInArrow(run, "t double, n bigint, s array<double>, w array<double>").collect()
    n = sum(p.n for p in parts)
    if n < 2:
        return None
    s, w = np.sum([p.s for p in parts], axis=0), np.sum([p.w for p in parts], axis=0)
    means = s / np.maximum(w, 1)
    return sum(p.t for p in parts) / n, float(np.quantile(means, 0.025)), float(np.quantile(means, 0.975)), n


def kmeans_elbow(df: DataFrame, vec: str, ks: list[int], seed: int = 42) -> tuple[int, dict[int, float]]:
    """(k, {k: cost}): flat k-means for each k, and the k farthest below the chord between the first and last cost."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer

    points = df.where(F.col(vec).isNotNull()).select(array_to_vector(F.transform(vec, lambda x: x.cast("double"))).alias("features")).cache()
    cost = {k: KMeans(k=k, seed=seed).fit(points).summary.trainingCost for k in ks if k > 1}
    if 1 in ks:
        whole = points.select(Summarizer.metrics("variance", "count").summary(F.col("features")).alias("s")).select("s.variance", "s.count").first()
        cost[1] = float(sum(whole[0].toArray()) * (whole[1] - 1))
    points.unpersist()
    a, b = min(ks), max(ks)
    chord = {k: cost[a] + (cost[b] - cost[a]) * (k - a) / max(1, b - a) - cost[k] for k in ks}
    return max(ks, key=lambda k: (chord[k], -k)), cost
