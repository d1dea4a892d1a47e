"""Axes and regions from vectors: covariance, principal axes, the shuffled noise floor, the bisecting ladder and a layout."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

# The most components looked at, the most axes kept, the replicates of the noise floor and the place of the floor among them.
COMPONENTS, AXES, REPLICATES, FLOOR = 60, 16, 8, 6
WEAK = 0.02
SEED = 42
REGION_FLOOR = 25


def _matrix(col: pa.Array, unit: bool) -> np.ndarray:
    x = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1)
    if unit:
        n = np.linalg.norm(x, axis=1, keepdims=True)
        x = x / np.where(n == 0, 1, n)
    return x


def moments(df: DataFrame, vec: str, unit: bool = True) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, mean, covariance), d x d with divisor n - 1, of the vectors. One pass: every task adds up X'X of its batches, so what leaves it is d x d whatever the rows."""

    def run(batches):
        n, s, c = 0, 0.0, 0.0
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(0), unit)
                n, s, c = n + len(x), s + x.sum(0), c + x.T @ x
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([n], pa.int64()), pa.array([list(s)]), pa.array([c.ravel()])], ["r", "n", "s", "c"])

    part = df.where(F.col(vec).isNotNull() & (F.size(vec) > 0)).select(vec).mapInArrow(run, "r int, n bigint, s array<double>, c array<double>")

    def add(t: pa.Table) -> pa.Table:
        s = np.stack(t.column("s").to_pylist()).sum(0)
        c = np.zeros(len(s) ** 2)
        for row in t.column("c"):
            c += np.asarray(row.values)
        return pa.table({"r": t.column("r").slice(0, 1), "n": pa.array([int(np.sum(t.column("n").to_numpy()))]), "s": pa.array([list(s)]), "c": pa.array([list(c)])})

    # partial sums of many tasks are added in two steps, so that no task gets more than a few dozen d x d matrices
    first = part.withColumn("g", F.pmod(F.spark_partition_id(), F.lit(64))).groupBy("r", "g").applyInArrow(lambda t: add(t), "r int, n bigint, s array<double>, c array<double>")
    row = first.groupBy("r").applyInArrow(lambda t: add(t), "r int, n bigint, s array<double>, c array<double>").first()
    if row is None:
        raise ValueError("no vectors")
    mean, c = np.array(row.s) / row.n, np.array(row.c).reshape(len(row.s), -1)
    return row.n, mean, (c - row.n * np.outer(mean, mean)) / max(row.n - 1, 1)


def noise_covariance(variances: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """The covariance of n rows whose columns have these variances and do not belong together: a draw of what shuffling every column by itself gives.

    A shuffle keeps each column's variance and leaves correlations of the size that chance gives to n rows; those of independent normal columns have the same law in the limit. So the correlation
    matrix of a Wishart draw (by Bartlett's decomposition; from n rows directly where they are few) stands for a pass over the data, whatever its partitioning.
    """
    d = len(variances)
    if n - 1 > 2 * d:
        a = np.tril(rng.standard_normal((d, d)), -1)
        a[np.arange(d), np.arange(d)] = np.sqrt(rng.chisquare(n - 1 - np.arange(d)))
        w = a @ a.T
    else:
        g = rng.standard_normal((max(n, 2), d))
        g -= g.mean(0)
        w = g.T @ g
    s = np.sqrt(np.maximum(np.diag(w), 1e-300))
    return w / np.outer(s, s) * np.sqrt(np.outer(variances, variances))


def principal(cov: np.ndarray, n: int, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """(components k x d, explained variance ratios), the largest loading of each component positive."""
    w, v = np.linalg.eigh(cov)
    order = np.argsort(-w)[: min(most, n, len(w))]
    ratio = np.maximum(w[order], 0) / max(np.maximum(w, 0).sum(), 1e-300)
    c = v[:, order].T
    lead = np.abs(c).argmax(axis=1)
    return c * np.where(c[np.arange(len(c)), lead] < 0, -1, 1)[:, None], ratio


def discover_axes(df: DataFrame, vec: str) -> dict:
    """The principal axes, as many as beat the noise floor, at least 2 and at most 16.

    The floor of a component is the second largest of eight replicates' ratios; counting stops at the first component that does not exceed it.
    """
    n, mean, cov = moments(df, vec, True)
    comps, ratio = principal(cov, n)
    rng = np.random.default_rng(SEED)
    floors = np.sort(np.stack([principal(noise_covariance(np.diag(cov), n, rng), n)[1] for _ in range(REPLICATES)]), axis=0)[FLOOR]
    real = 0
    while real < len(ratio) and ratio[real] > floors[real]:
        real += 1
    k = min(AXES, max(real, 2), len(comps))
    return {"mean": mean, "components": comps[:k], "variance": ratio[:k], "real_dims": real, "n": n}


def axis_table(spark, axes: dict) -> DataFrame:
    """(pc, key, variance, weak): the variance is rounded before it is tested."""
    rows = [(i + 1, f"pc{i + 1}", round(float(v), 4), bool(round(float(v), 4) < WEAK)) for i, v in enumerate(axes["variance"])]
    return spark.createDataFrame(rows, "pc int, key string, variance double, weak boolean")


def project(df: DataFrame, key: str, vec: str, axes: dict) -> DataFrame:
    """(key, pc, raw): centred unit rows on each axis."""
    shared = df.sparkSession.sparkContext.broadcast((axes["mean"], axes["components"]))

    def run(batches):
        mean, comps = shared.value
        for b in batches:
            if b.num_rows:
                raw = (_matrix(b.column(1), True) - mean) @ comps.T
                k = comps.shape[0]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), b.num_rows)), pa.array(raw.ravel())], [key, "pc", "raw"])

    kind = dict(df.dtypes)[key]
    return df.where(F.col(vec).isNotNull() & (F.size(vec) > 0)).select(key, vec).mapInArrow(run, f"`{key}` {kind}, pc int, raw double")


def grain_ladder(kmax: int) -> list[int]:
    """2, then half as much again each step, rounded and at least one more, up to kmax."""
    if kmax < 2:
        return [max(1, kmax)]
    out, k = [], 2
    while k < kmax:
        out.append(k)
        k = max(k + 1, int(1.5 * k + 0.5))
    return [*out, kmax]


def default_grain(counts: list[int]) -> int:
    """The finest level of at most 24 regions; the first where there is none."""
    return max([i for i, c in enumerate(counts) if c <= 24], default=0)


def regrained(counts: list[int]) -> int:
    """The level whose count lies nearest to 18, the coarser of equals."""
    return min(range(len(counts)), key=lambda i: (abs(counts[i] - 18), i))


class Splits:
    """The bisections in the order they were made; replaying the first k - 1 of them gives k regions."""

    def __init__(self):
        self.nodes: dict[int, tuple[int, int, np.ndarray]] = {}
        self.order: list[int] = []

    def leaf(self, x: np.ndarray, upto: int | None = None) -> np.ndarray:
        """The region of each row after the first ``upto`` splits, all of them for None."""
        use = set(self.order if upto is None else self.order[:upto])
        at, todo = np.zeros(len(x), np.int64), [0] if 0 in use else []
        while todo:
            k = todo.pop()
            a, b, c = self.nodes[k]
            mine = np.flatnonzero(at == k)
            if len(mine):
                at[mine] = np.where((x[mine] @ c.T).argmax(axis=1) == 0, a, b)
            todo += [i for i in (a, b) if i in use]
        return at


def bisect(df: DataFrame, vec: str, kmax: int, floor: int = REGION_FLOOR, rounds: int = 3, sample: int = 4096, seeds: int = 32) -> Splits:
    """Best-first bisecting 2-means of unit vectors: the loosest region above the floor is halved, until kmax regions or none is left.

    Looseness is a region's size times (1 - cohesion), from its vector sum. All regions that are due at one depth are halved in the same passes over the rows; their order is settled afterwards, so
    that replaying a prefix gives the best-first partition. A region of identical vectors cannot be halved and is left as it is. Only sums per
    region reach the driver, and a bounded sample that seeds the halves; a due region that has less than ``seeds`` rows in it gets that many of its own.
    """
    base = cut(df.where(F.col(vec).isNotNull() & (F.size(vec) > 0)).select(vec))
    spark, splits = df.sparkSession, Splits()
    got = base.withColumn("_h", F.xxhash64(F.col(vec).cast("string"))).orderBy("_h").limit(sample).select(vec).toArrow().column(0).combine_chunks()
    s = _matrix(got, True) if len(got) else np.zeros((0, 1))
    pending: dict[int, tuple[int, int, np.ndarray]] = {}

    def passed() -> dict[int, tuple[int, np.ndarray]]:
        probe = Splits()
        probe.nodes, probe.order = {**splits.nodes, **pending}, [*splits.nodes, *pending]
        shared = spark.sparkContext.broadcast(probe)

        def run(batches):
            sums: dict[int, list] = {}
            for b in batches:
                if b.num_rows:
                    x = _matrix(b.column(0), True)
                    leaf = shared.value.leaf(x)
                    for k in np.unique(leaf):
                        acc = sums.setdefault(int(k), [0, 0.0])
                        acc[0] += int((leaf == k).sum())
                        acc[1] = acc[1] + x[leaf == k].sum(0)
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array([v[0] for v in sums.values()], pa.int64()), pa.array([list(v[1]) for v in sums.values()], pa.list_(pa.float64()))], ["k", "n", "s"])

        each = base.mapInArrow(run, "k bigint, n bigint, s array<double>")

        def add(t: pa.Table) -> pa.Table:
            return pa.table({"k": t.column("k").slice(0, 1), "n": pa.array([int(np.sum(t.column("n").to_numpy()))]), "s": pa.array([np.stack(t.column("s").to_numpy()).sum(0)], pa.list_(pa.float64()))})

        total = each.groupBy("k").applyInArrow(lambda t: add(t), "k bigint, n bigint, s array<double>").collect()
        return {r.k: (r.n, np.array(r.s)) for r in total}

    def own_rows(ks: list[int]) -> dict[int, np.ndarray]:
        """Up to ``seeds`` rows of each region, the first by hash."""
        shared = spark.sparkContext.broadcast((_all(splits), set(ks)))

        def run(batches):
            for b in batches:
                if b.num_rows:
                    leaf = shared.value[0].leaf(_matrix(b.column(0), True))
                    rows = np.flatnonzero(np.isin(leaf, list(shared.value[1])))
                    yield pa.RecordBatch.from_arrays([pa.array(leaf[rows]), b.column(0).take(pa.array(rows))], ["k", "v"])

        kind = dict(base.dtypes)[vec]
        found = base.mapInArrow(run, f"k bigint, v {kind}").withColumn("_r", F.row_number().over(Window.partitionBy("k").orderBy(F.xxhash64(F.col("v").cast("string")))))
        got = found.where(F.col("_r") <= seeds).select("k", "v").toArrow()
        x = _matrix(got.column(1).combine_chunks(), True) if got.num_rows else np.zeros((0, 1))
        return {k: x[got.column(0).to_numpy() == k] for k in ks}

    sizes, done, fresh = passed(), set(), 1
    loose = lambda k: sizes[k][0] - np.linalg.norm(sizes[k][1])
    heads: dict[int, float] = {}
    while len(splits.nodes) + 1 < kmax:
        at = splits.leaf(s, None) if not splits.nodes else _all(splits).leaf(s)
        due = sorted((k for k in sizes if k not in done and sizes[k][0] > floor), key=lambda k: (-loose(k), k))[: max(1, (kmax - len(splits.nodes)) // 2)]
        pending = {}
        few = [k for k in due if (at == k).sum() < min(seeds, sizes[k][0])]
        more = own_rows(few) if few else {}
        for k in due:
            x = more.get(k, s[at == k])
            if len(x) < 2 or loose(k) < 1e-9 * sizes[k][0]:
                done.add(k)
                continue
            mean = x.mean(0)
            a = x[(x @ mean).argmin()]
            b = x[(x @ a).argmin()]
            if a @ b > 1 - 1e-12:
                done.add(k)
                continue
            c = np.stack([a, b])
            for _ in range(5):
                side = (x @ c.T).argmax(1)
                if 0 < side.sum() < len(side):
                    c = np.stack([x[side == j].mean(0) for j in (0, 1)])
                    c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
            pending[k] = (fresh, fresh + 1, c)
            heads[k] = loose(k)
            fresh += 2
        if not pending:
            if not due:
                break
            continue
        before = dict(sizes)
        for _ in range(rounds):
            sizes = passed()
            for a, b, c in pending.values():
                for j, i in enumerate((a, b)):
                    if i in sizes:
                        c[j] = sizes[i][1] / max(np.linalg.norm(sizes[i][1]), 1e-12)
        sizes = passed()
        for k, (a, b, c) in list(pending.items()):
            if a in sizes and b in sizes:
                splits.nodes[k] = (a, b, c)
            else:  # a half stayed empty: the region is terminal
                done.add(k)
                sizes.pop(a, None)
                sizes.pop(b, None)
                sizes[k] = before[k]
        pending = {}
    # best-first order: a region can be halved once its parent was
    ready = {0} & set(splits.nodes)
    while ready and len(splits.order) + 1 < kmax:
        k = max(ready, key=lambda i: (heads[i], -i))
        ready.remove(k)
        splits.order.append(k)
        ready |= {i for i in splits.nodes[k][:2] if i in splits.nodes}
    return splits


def _all(splits: Splits) -> Splits:
    out = Splits()
    out.nodes, out.order = splits.nodes, list(splits.nodes)
    return out


def ladder(df: DataFrame, key: str, vec: str, kmax: int, floor: int = REGION_FLOOR) -> tuple[DataFrame, list[int]]:
    """((level, key, region), counts): the nested partitions at the ladder's grains; regions are numbered from 0 by falling size of first appearance in the split order."""
    splits = bisect(df, vec, kmax, floor)
    counts = [c for c in grain_ladder(min(kmax, len(splits.order) + 1))]
    names = []
    for c in counts:
        leaves = [0]
        for k in splits.order[: c - 1]:
            i = leaves.index(k)
            leaves[i : i + 1] = list(splits.nodes[k][:2])
        names.append({k: i for i, k in enumerate(leaves)})
    shared = df.sparkSession.sparkContext.broadcast((splits, counts, names))

    def run(batches):
        splits, counts, names = shared.value
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(1), True)
                for level, (c, name) in enumerate(zip(counts, names)):
                    leaf = splits.leaf(x, c - 1)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), level, np.int32)), b.column(0), pa.array(np.array([name[int(k)] for k in leaf], np.int32))], ["level", key, "region"])

    kind = dict(df.dtypes)[key]
    return df.where(F.col(vec).isNotNull() & (F.size(vec) > 0)).select(key, vec).mapInArrow(run, f"level int, `{key}` {kind}, region int"), counts


def layout(df: DataFrame, key: str, vec: str, knn: DataFrame, dims: int = 2, rounds: int = 30, pull: float = 0.5) -> DataFrame:
    """(key, x, y[, z]): principal coordinates drawn towards the neighbours' mean for some rounds, each re-spread so that the axes stay uncorrelated, in -1..1.

    A spectral layout on the neighbour graph, in place of a gradient one: a round is a join and an aggregation, the spreading needs one row of moments.
    """
    n, mean, cov = moments(df, vec, True)
    comps = principal(cov, n)[0][:dims]
    comps = np.vstack([comps, np.zeros((dims - len(comps), len(mean)))])
    raw = project(df, key, vec, {"mean": mean, "components": comps})
    names = ["x", "y", "z"][:dims]
    at = raw.groupBy(key).agg(*[F.max(F.when(F.col("pc") == i + 1, F.col("raw"))).alias(n) for i, n in enumerate(names)])
    edges = cut(knn.select(F.col("src").alias(key), "dst").union(knn.select(F.col("dst").alias(key), F.col("src").alias("dst"))).distinct())
    for i in range(rounds):
        mean = edges.join(at.withColumnRenamed(key, "dst"), "dst").groupBy(key).agg(*[F.avg(n).alias(f"m{n}") for n in names])
        at = at.join(mean, key, "left").select(key, *[(F.col(n) * (1 - pull) + F.coalesce(f"m{n}", n) * pull).alias(n) for n in names])
        if i % 5 == 4 or i == rounds - 1:
            at = cut(at)
            m = at.agg(*[F.avg(n).alias(n) for n in names], *[F.covar_pop(a, b).alias(f"c{a}{b}") for a in names for b in names]).first()
            c = np.array([[m[f"c{a}{b}"] for b in names] for a in names], float)
            w, v = np.linalg.eigh(c)
            t = v @ np.diag(1 / np.sqrt(np.maximum(w, 1e-18))) @ v.T
            at = at.select(key, *[sum(((F.col(b) - float(m[b])) * float(t[i, j]) for j, b in enumerate(names)), F.lit(0.0)).alias(n) for i, n in enumerate(names)])
    ends = at.agg(*[F.max(F.abs(F.col(n))).alias(n) for n in names]).first()
    return at.select(key, *[(F.col(n) / (ends[n] or 1.0)).alias(n) for n in names])


def mean_difference(df: DataFrame, key: str, vec: str, selected: DataFrame) -> np.ndarray | None:
    """The unit direction from the rest's mean to the selection's, of unit rows; None if either is empty or they coincide."""
    flagged = df.where(F.col(vec).isNotNull() & (F.size(vec) > 0)).select(key, vec).join(selected.select(key, F.lit(True).alias("sel")).distinct(), key, "left")
    means = {r.g: np.array(r.mean) for r in vector_means(flagged.select(F.col("sel").isNotNull().alias("g"), vec), "g", vec).collect()}
    if True not in means or False not in means:
        return None
    d = means[True] - means[False]
    return d / n if (n := np.linalg.norm(d)) > 1e-9 else None


def vector_means(df: DataFrame, group: str, vec: str, unit: bool = True) -> DataFrame:
    """(group, n, mean): the mean vector of each group; a task sends one sum per group that it has."""

    def run(batches):
        sums: dict = {}
        for b in batches:
            if b.num_rows:
                g, x = np.array(b.column(0).to_pylist(), dtype=object), _matrix(b.column(1), unit)
                for k in set(g.tolist()):
                    m = x[[i for i, v in enumerate(g) if v == k]] if k is not None else x[[i for i, v in enumerate(g) if v is None]]
                    acc = sums.setdefault(k, [0, 0.0])
                    acc[0] += len(m)
                    acc[1] = acc[1] + m.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), kind_arrow), pa.array([v[0] for v in sums.values()], pa.int64()), pa.array([v[1] for v in sums.values()], pa.list_(pa.float64()))], [group, "n", "s"])

    from pyspark.sql.pandas.types import to_arrow_type

    kind, kind_arrow = dict(df.dtypes)[group], to_arrow_type(df.schema[group].dataType)
    part = df.where(F.col(vec).isNotNull() & (F.size(vec) > 0)).select(group, vec).mapInArrow(run, f"`{group}` {kind}, n bigint, s array<double>")

    def add(t: pa.Table) -> pa.Table:
        n = int(np.sum(t.column("n").to_numpy()))
        return pa.table({group: t.column(group).slice(0, 1), "n": pa.array([n]), "mean": pa.array([np.stack(t.column("s").to_numpy()).sum(0) / n], pa.list_(pa.float64()))})

    return part.groupBy(group).applyInArrow(lambda t: add(t), f"`{group}` {kind}, n bigint, mean array<double>")


def similarity_to(df: DataFrame, key: str, vec: str, query: np.ndarray) -> DataFrame:
    """(key, sim): the cosine of every vector with a query vector."""
    from ..functions.vector import cosine

    return df.select(key, cosine(F.col(vec), F.array(*[F.lit(float(x)) for x in query])).alias("sim")).where("sim is not null")
