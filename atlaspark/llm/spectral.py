"""Clusters of mutually similar records by power iteration on sparse affinities."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from ..session import cut, once, partitions, table
from .neighbours import LISTS, Cells, _top, best_k, card_vectors, classes, flat, lists, pack, pack12, unit_vectors, unpack, unpack_coarse

DIMS = 8  # vectors iterated
ROUNDS = 4
RADIUS = 0.3  # of a k-means cell about its centre, where an embedding coordinate has unit variance over the clusters
PART = 20000  # rows per k-means task
HOME = 4096  # nodes of one part of the graph, about
WEAK = 0.5  # normalised cut below which two pieces stay apart though some of their members are alike
WORDS = 20  # of a label whose combinations are listed; longer ones meet word by word


def power_iteration(start: DataFrame, affinity: DataFrame, home, rounds: int = ROUNDS) -> DataFrame:
    """(node, x): the start vectors after some rounds of x <- (D + I)^-1 (A + I) x, D the row sums of the affinities.

    ``start`` is (node, x binary of DIMS float32), ``affinity`` (node, other, w), symmetric, both ways round; ``home`` gives the part of the graph that a node column belongs to. What varies
    within a well linked part of the graph decays by its second eigenvalue each round, what varies between such parts stays: the vectors come to span the leading eigenvectors. In a round
    each part takes in what was sent to its nodes, normalises, and sends on, summed by receiver; as most links stay within a part, little more than a row per node
    is shuffled, however dense the graph.
    """
    edges = cut(affinity.select(home("node").alias("home"), "node", "other", home("other").alias("to"), F.col("w").cast("float").alias("w")))
    schema = "home bigint, node bigint, s binary, d float"

    def step(send: bool):
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            node, got = right.column("node").to_numpy(), np.frombuffer(b"".join(right.column("s").to_pylist()), np.float32).reshape(-1, DIMS)
            ids, inv = np.unique(node, return_inverse=True)
            s, d = np.zeros((len(ids), DIMS)), np.zeros(len(ids))
            np.add.at(s, inv, got)
            np.add.at(d, inv, right.column("d").to_numpy())
            x = s / np.maximum(d, 1e-12)[:, None]
            if not send:
                return _sent(np.full(len(ids), right.column("home")[0].as_py() if len(node) else 0), ids, x, np.ones(len(ids)))
            src, w = np.searchsorted(ids, left.column("node").to_numpy()), left.column("w").to_numpy().astype(float)
            to, inv = np.unique(left.column("other").to_numpy(), return_inverse=True)
            out, weight, where = np.zeros((len(to), DIMS)), np.bincount(inv, w, minlength=len(to)), np.zeros(len(to), np.int64)
            for j in range(DIMS):
                out[:, j] = np.bincount(inv, w * x[src, j], minlength=len(to))
            where[inv] = left.column("to").to_numpy()
            mine = np.full(len(ids), right.column("home")[0].as_py() if len(node) else 0)
            return _sent(np.r_[where, mine], np.r_[to, ids], np.r_[out, x], np.r_[weight, np.ones(len(ids))])

        return run

    state = start.select(home("node").alias("home"), "node", F.col("x").alias("s"), F.lit(1.0).cast("float").alias("d"))
    for _ in range(rounds):
        state = edges.groupBy("home").cogroup(state.groupBy("home")).applyInArrow(step(True), schema)
    return edges.groupBy("home").cogroup(state.groupBy("home")).applyInArrow(step(False), schema).select("node", F.col("s").alias("x"))


def _sent(home, node, x, d) -> pa.Table:
    return pa.table({"home": pa.array(home), "node": pa.array(node), "s": pack(x.astype(np.float32)), "d": pa.array(d.astype(np.float32))})


def _matrix(col) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.float32).reshape(-1, DIMS).astype(float)


def _seeded(x: np.ndarray, radius: float) -> np.ndarray:
    """Centres such that every row lies within the radius of one: rows are taken in order of their first coordinate, so only a strip is compared."""
    order = np.argsort(x[:, 0], kind="stable")
    y, free, centres = x[order], np.ones(len(x), bool), []
    for i in range(len(y)):
        if free[i]:
            j = np.searchsorted(y[:, 0], y[i, 0] + radius, "right")
            near = ((y[i:j] - y[i]) ** 2).sum(axis=1) <= radius**2
            centres.append(y[i])
            free[i:j] &= ~near
    return np.array(centres)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    sq = (centres**2).sum(axis=1)
    return np.concatenate([(sq[None, :] - 2 * x[s : s + 2048] @ centres.T).argmin(axis=1) for s in range(0, len(x), 2048)])


def kmeans(embedded: DataFrame, radius: float = RADIUS, lloyd: int = 3) -> DataFrame:
    """(node, part, k): k-means of the embedding with as many centres as it takes to have every row within the radius of a seed.

    The rows are first parted by the nearest of some sampled centres, whose number grows with the rows up to 4,096, and a part beyond PART rows is salted; then Lloyd's
    rounds run in each part. A cluster that a part's border or a salt divides comes out in several pieces, which a check of the affinities has to join again.
    """
    n = embedded.count()
    want = max(1, -(-n // PART) * 4 if n > PART else 1)
    pick = embedded.where(F.pmod(F.xxhash64("node", F.lit(5)), F.lit(1 << 20)) < int((1 << 20) * min(1.0, 2 * want / max(n, 1))) + 1).select("x").limit(4096).collect()
    coarse = np.array([np.frombuffer(r.x, np.float32) for r in pick], dtype=float).reshape(-1, DIMS)

    def place(batches):
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(1))
                part = _nearest(x, coarse) if len(coarse) > 1 else np.zeros(len(x), np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(part)], ["node", "x", "part"])

    placed = cut(embedded.select("node", "x").mapInArrow(place, "node bigint, x binary, part bigint"))
    sizes = placed.groupBy("part").count().select("part", (F.floor(F.col("count") / PART) + 1).alias("salts"))
    salted = placed.join(sizes, "part").select("node", "x", (F.col("part") * 100000 + F.pmod(F.xxhash64("node"), F.col("salts"))).alias("part"))

    def run(t: pa.Table) -> pa.Table:
        x = _matrix(t.column("x"))
        centres = _seeded(x, radius)
        for _ in range(lloyd):
            k = _nearest(x, centres)
            count = np.bincount(k, minlength=len(centres))
            sums = np.stack([np.bincount(k, x[:, d], minlength=len(centres)) for d in range(DIMS)], axis=1)
            centres = sums[count > 0] / count[count > 0, None]
        return pa.table({"node": t.column("node"), "part": t.column("part"), "k": _nearest(x, centres)})

    return salted.groupBy("part").applyInArrow(run, "node bigint, part bigint, k bigint")


def _sums(rows: DataFrame, key: str, start: bool) -> DataFrame:
    """(key, s): the sums of unit rows, or of such sums, by key."""

    def add(t: pa.Table) -> pa.Table:
        x = unpack(t.column(1)).astype(float) if start else np.frombuffer(b"".join(t.column(1).to_pylist()), float).reshape(t.num_rows, -1)
        return pa.table({key: t.column(0).slice(0, 1), "s": pack(x.sum(axis=0)[None, :])})

    return cut(rows.groupBy(key).applyInArrow(add, f"{key} bigint, s binary"))


def normalised_cuts(pairs: DataFrame, sums: DataFrame) -> DataFrame:
    """(p, q, ncut) for pairs of pieces: cut(p, q) / (assoc(p) + cut(p, q)) + the same of q, over the cosines of all their rows; assoc(p) is their sum within p, cut(p, q) that between the two.

    It is near 1 where the two are as much alike as each is within itself, and near 0 where only a stray pair is alike. ``sums`` (piece, s) has the pieces' summed unit vectors, whose
    products are sums over all pairs, so no pair of rows is looked at.
    """
    both = pairs.join(sums.select(F.col("piece").alias("p"), F.col("s").alias("a")), "p").join(sums.select(F.col("piece").alias("q"), F.col("s").alias("b")), "q")

    def run(batches):
        for t in batches:
            if t.num_rows:
                x, y = (np.frombuffer(b"".join(t.column(c).to_pylist()), float).reshape(t.num_rows, -1) for c in ("a", "b"))
                across = np.maximum((x * y).sum(axis=1), 0)
                ncut = sum(across / np.maximum((z * z).sum(axis=1) + across, 1e-9) for z in (x, y))
                yield pa.RecordBatch.from_arrays([t.column("p"), t.column("q"), pa.array(ncut.round(9))], ["p", "q", "ncut"])

    return both.select("p", "q", "a", "b").mapInArrow(run, "p bigint, q bigint, ncut double")


def joined_pieces(pairs: DataFrame, pieces: DataFrame, units: DataFrame, weak: float) -> DataFrame:
    """(piece, name) of the pieces in ``pairs`` (p < q): each round joins every piece with the neighbour it has the highest normalised cut with, if that is ``weak`` at least, and sums the joined ones anew.

    So a bridge's lone ends first go to the groups they belong to, and what is compared in the end are whole groups. Rounds at least halve the pieces that
    still join. Only pieces that occur in ``pairs`` (which some affinity crosses) are summed; each has at most about PART rows.
    """
    names = cut(pairs.select(F.explode(F.array("p", "q")).alias("piece")).distinct().withColumn("name", F.col("piece")))
    members = cut(pieces.join(names.select("piece"), "piece"))
    few = F.broadcast if members.count() <= FEW else lambda df: df
    sums = _sums(units.join(few(members), "node").select("piece", "v"), "piece", True)
    while True:
        good = cut(normalised_cuts(pairs, sums).where(F.col("ncut") >= weak))
        if good.isEmpty():
            return names
        ends = good.select("p", "q", "ncut").union(good.select("q", "p", "ncut"))
        best = ends.groupBy("p").agg(F.min_by("q", F.struct(-F.col("ncut"), "q")).alias("q"))
        root = cut(connected_components(best, "p", "q"))
        names = cut(names.join(root, F.col("name") == F.col("node"), "left").select("piece", F.coalesce("component", "name").alias("name")))
        sums = _sums(sums.join(root, F.col("piece") == F.col("node"), "left").select(F.coalesce("component", "piece").alias("piece"), "s"), "piece", False)
        for c in ("p", "q"):
            pairs = pairs.join(root.select(F.col("node").alias(c), "component"), c, "left").withColumn(c, F.coalesce("component", c)).drop("component")
        pairs = cut(pairs.where("p <> q").select(F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q")).distinct())


def local_components(edges: DataFrame, home) -> DataFrame:
    """(node, name): the components of the edges (node, other) whose ends are at home in one part of the graph, found part by part; name is the smallest node. Nodes of no such edge are left out."""

    def run(t: pa.Table) -> pa.Table:
        a, b = t.column(1).to_numpy(), t.column(2).to_numpy()
        ids, at = np.unique(np.r_[a, b], return_inverse=True)
        return pa.table({"node": ids, "name": ids[_merged(np.arange(len(ids)), at[: len(a)], at[len(a) :])]})

    return edges.select(home("node").alias("home"), "node", "other").where(F.col("home") == home("other")).groupBy("home").applyInArrow(run, "node bigint, name bigint")


def spectral_clusters(start: DataFrame, affinity: DataFrame, home, units: DataFrame, rounds: int = ROUNDS, weak: float = WEAK) -> DataFrame:
    """(node, cluster): power iteration, k-means of the embedding, and an exact check of its pieces against the affinities.

    Pieces that some affinity crosses are joined, as alike members belong together, unless the normalised cut between them over all their rows (``units``: node, v) is below ``weak``: then
    the spectral cut stands (see ``joined_pieces``). Within a piece, and between joined ones, a cluster is what the affinities link: a piece that holds nodes by the nearness of their embedding alone falls apart.
    ``cluster`` is the smallest node of the cluster. Nodes without any affinity are left out; no affinities give an empty result.
    """
    linked = affinity.select("node").distinct()
    embedded = cut(power_iteration(start.join(linked, "node"), affinity, home, rounds))
    pieces = cut(kmeans(embedded).select("node", F.xxhash64("part", "k").alias("piece")))
    a, b = pieces.select("node", F.col("piece").alias("p")), pieces.select(F.col("node").alias("other"), F.col("piece").alias("q"))
    edges = cut(affinity.where("node < other").select("node", "other").join(a, "node").join(b, "other"))
    across = edges.where("p <> q").select("node", "other", F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q"))
    pairs = cut(across.select("p", "q").distinct())
    kept = edges.where("p = q").select("node", "other")
    if not pairs.isEmpty():
        names = joined_pieces(pairs, pieces, units, weak)
        c, d = names.select(F.col("piece").alias("p"), F.col("name").alias("c")), names.select(F.col("piece").alias("q"), F.col("name").alias("d"))
        kept = cut(kept.union(across.join(c, "p").join(d, "q").where("c = d").select("node", "other")))
    named = cut(embedded.select("node").join(local_components(kept, home), "node", "left").select("node", F.coalesce("name", "node").alias("name")))
    far = kept.where(home("node") != home("other"))
    a, b = named.select("node", F.col("name").alias("c")), named.select(F.col("node").alias("other"), F.col("name").alias("d"))
    joined = connected_components(far.join(a, "node").join(b, "other").where("c <> d").select("c", "d").distinct(), "c", "d")
    return named.join(joined.withColumnRenamed("node", "name"), "name", "left").select("node", F.coalesce("component", "name").alias("cluster"))


def describe(clusters: DataFrame, top: int = 5) -> DataFrame:
    """(cluster, size, typical): each cluster's size and its members of the highest internal affinity, ties by the smaller node."""
    ranked = clusters.withColumn("place", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("inner"), "node"))).where(F.col("place") <= top)
    best = ranked.groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("place", "node"))).alias("t")).select("cluster", F.col("t.node").alias("typical"))
    return clusters.groupBy("cluster").agg(F.count("*").alias("size")).join(best, "cluster")


# --- vectors ---------------------------------------------------------------------------------------------------------------


UNSURE = 0.005  # about the threshold, where 8-bit vectors do not decide
FEW = 100_000  # rows, of some 300 bytes at most, that are broadcast; more are shuffled


def _merged(c: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The labels c, each the smallest of its component, after the components that hold a and b have been joined."""
    while True:
        low = np.minimum(c[a], c[b])
        new = c.copy()
        np.minimum.at(new, c[a], low)
        np.minimum.at(new, c[b], low)
        while (new != new[new]).any():
            new = new[new]
        new = new[c]
        if (new == c).all():
            return c
        c = new


def _forest(c: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which links, labels): of links in falling order those that join components best first, until none crosses any more (Boruvka)."""
    keep = np.zeros(len(a), bool)
    while True:
        e = np.flatnonzero(c[a] != c[b])
        if not len(e):
            return keep, c
        best = np.full(len(c), len(a))
        np.minimum.at(best, c[a[e]], e)
        np.minimum.at(best, c[b[e]], e)
        picked = np.unique(best[best < len(a)])
        keep[picked] = True
        c = _merged(c, a[picked], b[picked])


def spanning_links(x: np.ndarray, k: int, least: float, margin: float = UNSURE, block: int = 512) -> tuple[tuple, tuple]:
    """((row, column, value) of each row's k nearest, the same of the links that components hang on) over all pairs of rows whose product may reach least.

    Pairs above the margin only yield a spanning forest: the links among the k nearest first, best first, then whatever pair still crosses between two trees. Pairs within the
    margin are kept whenever they would join two trees of it, every one of them, for the exact check to decide. The pairs are held as bits.
    """
    near, bits = [], []
    for s in range(0, len(x), block):
        sims = x[s : s + block] @ x.T
        sims[np.arange(len(sims)), np.arange(s, s + len(sims))] = -2
        r, c, v = _top(sims, k, least - margin)
        near.append((r + s, c, v))
        bits.append([np.packbits(sims >= least + margin, axis=1), np.packbits((sims >= least - margin) & (sims < least + margin), axis=1)] if len(r) else None)
    r, c, v = (np.concatenate(z) for z in zip(*near))
    order = np.argsort(-v, kind="stable")
    order = order[v[order] >= least + margin]
    a, b = r[order], c[order]
    keep, tree = _forest(np.arange(len(x)), a, b)
    links = [(a[keep], b[keep])]

    def crossing(i: int, which: int):
        rows = np.arange(i * block, i * block + len(bits[i][which]))
        a, b = np.nonzero(np.unpackbits(bits[i][which], axis=1, count=len(x)).view(bool) & (tree[rows][:, None] != tree[None, :]))
        return rows[a], b

    full = [i for i, z in enumerate(bits) if z]
    for i in full:
        a, b = crossing(i, 0)
        _, one = np.unique(np.minimum(tree[a], tree[b]) * len(x) + np.maximum(tree[a], tree[b]), return_index=True)
        a, b = a[one], b[one]
        keep, tree = _forest(tree, a, b)
        links.append((a[keep], b[keep]))
    for i in full:
        a, b = crossing(i, 1)
        links.append((a[a < b], b[a < b]))
    a, b = (np.concatenate(z) for z in zip(*links))
    return (r, c, v), (a, b, np.concatenate([np.einsum("ij,ij->i", x[a[s : s + 32768]], x[b[s : s + 32768]]) for s in range(0, max(len(a), 1), 32768)]))


def cell_links(rows: DataFrame, k: int, least: float) -> DataFrame:
    """(h, nbr, sim, tree): within each cell, all of it compared, every node's k nearest and, as tree, the links that its components hang on."""

    def run(t: pa.Table) -> pa.Table:
        h = t.column(1).to_numpy()
        out = []
        for tree, (r, c, v) in enumerate(spanning_links(unpack_coarse(t.column(2)), k, least)):
            order = np.argsort(r, kind="stable")
            who, counts = np.unique(r, return_counts=True)
            out.append(pa.table({"h": h[who], "nbr": lists(h[c[order]], counts), "sim": lists(v[order].astype(np.float32), counts), "tree": np.full(len(who), bool(tree))}))
        return pa.concat_tables(out)

    return rows.groupBy("cell").applyInArrow(run, LISTS + ", tree boolean")


def vector_affinities(vectors: DataFrame, least: float, k: int = 3) -> tuple[DataFrame, DataFrame]:
    """(affinity (node, other, w), both ways round, keyed vectors): each vector's nearest, of a cosine of least at least, and as many links besides as keep together what any such pair of a cell links.

    The k nearest alone would not do: where more than k near-copies exist, their places all go to one another. Where the 8-bit vectors leave a link open, the 12-bit ones decide.
    """
    cells = Cells(vectors, vectors.count(), 3, 2)
    keyed = cells.keyed(vectors)

    def run(batches):
        got = [b for b in batches if b.num_rows]
        if got:
            t = pa.Table.from_batches(got)
            near = best_k(*flat(t.filter(pc.invert(t.column(3))).combine_chunks()), k)
            tree = flat(t.filter(t.column(3)).combine_chunks())
            h, m, w = (np.concatenate(z) for z in zip(near, tree))
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(m), pa.array(w.astype(float))], ["h", "m", "w"])

    one = cut(cell_links(cells.rows(keyed, True), k, least).repartition(partitions(vectors.sparkSession), "h").mapInArrow(run, "h bigint, m bigint, w double"))
    a, b = keyed.select("h", F.col("v").alias("va")), keyed.select(F.col("h").alias("m"), F.col("v").alias("vb"))

    def cosines(batches):
        for t in batches:
            if t.num_rows:
                yield pa.RecordBatch.from_arrays([t.column(0), t.column(1), pa.array(np.einsum("ij,ij->i", unpack(t.column(2)), unpack(t.column(3))).astype(float))], ["h", "m", "w"])

    unsure = cut(one.where(F.col("w") < least + UNSURE))
    n = unsure.count()
    if n:
        few = F.broadcast if n <= FEW else lambda df: df
        again = few(few(unsure).join(a, "h")).join(b, "m").select("h", "m", "va", "vb").mapInArrow(cosines, "h bigint, m bigint, w double").where(F.col("w") >= least)
        one = cut(one.where(F.col("w") >= least + UNSURE).union(again))
    pair = one.groupBy(F.least("h", "m").alias("a"), F.greatest("h", "m").alias("b")).agg(F.max("w").alias("w"))
    both = pair.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other"), "w"), F.struct(F.col("b").alias("node"), F.col("a").alias("other"), "w"))).alias("e"))
    return cut(both.select("e.*")), keyed


def projected(keyed: DataFrame) -> DataFrame:
    """(node, x): DIMS random projections of each vector, to start from."""

    def run(batches):
        axes = None
        for b in batches:
            if b.num_rows:
                x = unpack(b.column(1))
                axes = np.random.default_rng(11).standard_normal((x.shape[1], DIMS)) if axes is None else axes
                yield pa.RecordBatch.from_arrays([b.column(0), pack((x @ axes).astype(np.float32))], ["node", "x"])

    return keyed.select("h", "v").mapInArrow(run, "node bigint, x binary")


def summed_cosines(nodes: DataFrame) -> DataFrame:
    """(node, inner): for nodes (node, cluster, copies, v) the summed cosines of one copy to all other copies and nodes of its cluster, as its product with the cluster's summed vectors.

    A cluster's nodes are brought together once; one of more than HOME nodes is salted, and its sums (a row for every HOME nodes at most) are taken beforehand.
    """
    large = cut(nodes.groupBy("cluster").count().where(f"count > {HOME}").select("cluster", F.ceil(F.col("count") / HOME).alias("salts")))

    def run(batches):
        sums: dict = {}
        for b in batches:
            x = unpack(b.column(2)).astype(float) * b.column(1).to_numpy()[:, None] if b.num_rows else np.zeros((0, 1))
            who, at = np.unique(b.column(0).to_numpy(), return_inverse=True)
            for i, c in enumerate(who.tolist()):
                sums[c] = sums.get(c, 0) + x[at == i].sum(axis=0)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pack(np.stack(list(sums.values())))], ["cluster", "s"])

    total: dict = {}
    for r in nodes.join(large, "cluster").select("cluster", "copies", "v").repartition(partitions(nodes.sparkSession), "cluster", F.pmod(F.xxhash64("node"), F.col("salts"))).mapInArrow(run, "cluster bigint, s binary").toLocalIterator() if not large.isEmpty() else ():
        total[r.cluster] = total.get(r.cluster, 0) + np.frombuffer(r.s, float)

    def ranked(batches):
        got = [b for b in batches if b.num_rows]
        if got:
            t = pa.Table.from_batches(got).combine_chunks()
            x, c = unpack(t.column(3)).astype(float), t.column(1).to_numpy()
            order = np.argsort(c, kind="stable")
            starts = np.r_[0, np.flatnonzero(np.diff(c[order])) + 1]
            s = np.add.reduceat(x[order] * t.column(2).to_numpy()[order, None], starts)
            for i, name in enumerate(c[order[starts]].tolist()):
                if name in total:
                    s[i] = total[name]
            at = np.empty(len(c), np.int64)
            at[order] = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(c)]))
            inner = np.einsum("ij,ij->i", x, s[at]) - np.einsum("ij,ij->i", x, x)
            yield pa.RecordBatch.from_arrays([t.column(0).combine_chunks(), pa.array(inner.round(6))], ["node", "inner"])

    spread = nodes.join(large, "cluster", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("node"), F.col("salts")), F.lit(0)))
    return spread.repartition(partitions(nodes.sparkSession), "cluster", "salt").select("node", "cluster", "copies", "v").mapInArrow(ranked, "node bigint, inner double")


def vector_clusters(df: DataFrame, key: str, vec_col: str, least: float = 0.70, dim: int = 128, ranked: bool = True) -> DataFrame:
    """(member_id, cluster_id, inner): clusters of rows whose vectors' cosine reaches least, of at least two members; cluster_id is the smallest, inner the member's summed cosines to all others of its cluster.

    Without ``ranked`` inner is left out.

    Unusable vectors (null, empty, zero, non-finite, of another length) belong to none. Copies of a vector are one node with all its copies as members.
    """
    vectors, members = classes(unit_vectors(df, key, vec_col, dim))
    affinity, keyed = vector_affinities(vectors, least)
    found = spectral_clusters(projected(keyed), affinity, lambda c: F.shiftright(F.col(c), 40), keyed.select(F.col("h").alias("node"), "v"))
    named = cut(keyed.select("hash", F.col("h").alias("node"), "v").join(found, "node").select(F.col("hash").alias("h"), "cluster", *["v"] * ranked))
    joined = members.join(named.drop("v"), "h", "left").select("id", "h", F.coalesce("cluster", "h").alias("c"))
    if not ranked:
        return _smallest(joined)
    copies = cut(members.groupBy("h").agg(F.count("*").alias("copies")))
    inner = summed_cosines(named.join(copies, "h").select(F.col("h").alias("node"), "cluster", "copies", "v")).withColumnRenamed("node", "h")
    # copies that nothing else is linked to have a cosine of 1 to each other
    return _smallest(joined.join(copies, "h").join(inner, "h", "left").select("id", "c", F.coalesce("inner", F.col("copies") - 1.0).alias("inner")))


def _smallest(joined: DataFrame) -> DataFrame:
    joined = cut(joined)
    ids = joined.groupBy("c").agg(F.min("id").alias("cluster_id"), F.count("*").alias("n")).where("n > 1")
    return joined.join(ids, "c").select(F.col("id").alias("member_id"), "cluster_id", *[x for x in joined.columns if x == "inner"])


# --- labels ----------------------------------------------------------------------------------------------------------------

# Words that say nothing about a label's subject.
GENERIC = "a an and about at by essay essays for from in into introduction more note notes of on or other overview question questions reading readings some studies study the their to toward towards with work works".split()


def label_words(label) -> F.Column:
    """The distinctive words of a label: lower case, without accents, generic words and a plural's s, of four letters at least."""
    plain = F.regexp_replace(F.lower(label), "[àáâãäå]", "a")
    for accents, letter in (("[èéêë]", "e"), ("[ìíîï]", "i"), ("[òóôõöø]", "o"), ("[ùúûü]", "u"), ("[ýÿ]", "y"), ("ñ", "n"), ("ç", "c"), ("ß", "ss"), ("[\\u0300-\\u036f]", "")):
        plain = F.regexp_replace(plain, accents, letter)
    words = F.regexp_extract_all(plain, F.lit("[\\p{L}\\p{N}]+"), F.lit(0))
    words = F.filter(words, lambda w: (F.length(w) >= 4) & ~w.isin(GENERIC))
    return F.array_sort(F.array_distinct(F.transform(words, lambda w: F.regexp_replace(w, "(?<=[a-z]{3}[^s])s$", ""))))


def one_slip(a: str, b: str) -> bool:
    """Whether one letter added, lost, changed or two neighbours swapped turn a into b."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    ra, rb = a[i:], b[i:]
    if len(a) == len(b):
        return ra[1:] == rb[1:] or (ra[:2] == rb[:2][::-1] and ra[2:] == rb[2:])
    return ra[1:] == rb or ra == rb[1:]


def word_roots(words: DataFrame, ratio: int = 4) -> DataFrame:
    """(word, root): a word's roots are the word itself and every word, ``ratio`` times as frequent, that one slip makes of it.

    A word seen once also takes a root among others seen once, so a slip is found in the smallest cluster. Words of fewer than six letters have no slips. Only distinct
    words meet, over the strings that losing one letter leaves; the words that share such a string are bounded by the alphabet, not by the data.
    """
    vocab = cut(words.groupBy("word").agg(F.count("*").alias("df")))
    drops = F.expr("array_distinct(array_append(transform(sequence(1, length(word)), i -> concat(substring(word, 1, i - 1), substring(word, i + 1))), word))")
    keyed = cut(vocab.where(F.length("word") >= 6).select("word", "df", F.explode(drops).alias("key")))
    other = keyed.select(F.col("word").alias("root"), F.col("df").alias("rdf"), "key")
    slip = (F.col("rdf") >= ratio * F.col("df")) | ((F.col("df") == 1) & (F.struct("rdf", "root") > F.struct("df", "word")))
    pairs = keyed.join(other, "key").where((F.col("word") != F.col("root")) & slip).select("word", "root").distinct()

    def check(batches):
        for pdf in batches:
            yield pdf[pd.Series([one_slip(a, b) for a, b in zip(pdf["word"], pdf["root"])], index=pdf.index, dtype=bool)]

    return pairs.mapInPandas(check, "word string, root string").union(vocab.select("word", F.col("word").alias("root")))


def label_clusters(df: DataFrame, key: str, label_col: str, shared: int = 3, ranked: bool = True) -> DataFrame:
    """(member_id, cluster_id, inner): clusters of labels that share at least ``shared`` distinctive words, of at least two members; inner counts the combinations of ``shared`` words that a member has in common with the others, over all others.

    Without ``ranked`` inner is left out.

    Null and empty labels, and labels of fewer distinctive words, belong to none. Labels of the same words form one node; nodes meet over each
    combination of ``shared`` words that more than one has, every one linked to a first node rather than to every other, with a first node for every HOME. A label of more than
    WORDS words has too many combinations: it is compared with all that have a word in common with it, and its inner counts the words shared.
    """
    words = cut(df.select(F.col(key).cast("long").alias("id"), F.explode(label_words(F.col(label_col))).alias("word")))
    rooted = words.join(word_roots(words), "word").select("id", "word", "root").distinct()
    common = rooted.groupBy("root").agg(F.count_distinct("id").alias("n")).where("n > 1").select("root")
    kept = rooted.join(common, "root").groupBy("id", "word").agg(F.array_sort(F.collect_list("root")).alias("alike"))
    sets = kept.groupBy("id").agg(F.array_sort(F.collect_list("alike")).alias("roots")).where(F.size("roots") >= shared)
    sets = cut(sets.withColumn("h", F.xxhash64("roots")))
    nodes = cut(sets.groupBy("h").agg(F.first("roots").alias("roots"), F.count("*").alias("copies")))
    usual = nodes.where(F.size("roots") <= WORDS)
    combos = cut(usual.select("h", F.explode(F.array_distinct(_combinations(F.col("roots"), shared))).alias("combo")))
    held = combos.groupBy("combo").agg(F.min("h").alias("head"), F.count("*").alias("n")).where("n > 1").withColumn("salts", F.ceil(F.col("n") / HOME))
    met = combos.join(held, "combo").withColumn("salt", F.pmod(F.xxhash64("h"), F.col("salts")))
    salted = met.where("salts > 1").groupBy("combo", "salt").agg(F.min("h").alias("other"), F.first("head").alias("head"))
    stars = met.where("salts = 1").select("h", F.col("head").alias("other")).union(met.where("salts > 1").join(salted.drop("head"), ["combo", "salt"]).select("h", "other")).union(salted.select(F.col("other").alias("h"), F.col("head").alias("other")))
    long = nodes.where(F.size("roots") > WORDS).select("h", F.posexplode("roots").alias("i", "rs")).select("h", "i", F.explode("rs").alias("root"))
    every = nodes.select(F.col("h").alias("other"), F.posexplode("roots").alias("j", "rs")).select("other", "j", F.explode("rs").alias("root"))
    alike = long.join(every, "root").where("h <> other").groupBy("h", "other").agg(F.least(F.count_distinct("i"), F.count_distinct("j")).alias("w")).where(F.col("w") >= shared)
    one = stars.where("h <> other").groupBy("h", "other").agg(F.count("*").cast("double").alias("w")).union(alike.select("h", "other", F.col("w").cast("double")))
    one = one.groupBy(F.least("h", "other").alias("h"), F.greatest("h", "other").alias("other")).agg(F.sum("w").alias("w"))
    affinity = cut(one.union(one.select("other", "h", "w")).toDF("node", "other", "w"))
    gauss = [_label_axis(F.array_distinct(F.flatten("roots")), i) for i in range(DIMS)]

    def packed(batches):
        for b in batches:
            if b.num_rows:
                x = np.stack([c.to_numpy() for c in b.columns[1:]], axis=1)
                yield pa.RecordBatch.from_arrays([b.column(0), pack(x.astype(np.float32))], ["node", "x"])

    start = nodes.select(F.col("h").alias("node"), *[g.alias(f"x{i}") for i, g in enumerate(gauss)]).mapInArrow(packed, "node bigint, x binary")
    homes = max(1, -(-nodes.count() // HOME))
    hashes = nodes.select(F.col("h").alias("node"), F.transform(F.array_distinct(F.flatten("roots")), lambda r: F.xxhash64(r)).alias("r"))
    found = spectral_clusters(start, affinity, lambda c: F.pmod(F.xxhash64(c), F.lit(homes)), hashes.mapInArrow(_signed, "node bigint, v binary"))
    joined = sets.select("id", "h").join(found.withColumnRenamed("node", "h"), "h", "left").select("id", "h", F.coalesce("cluster", "h").alias("c"))
    if not ranked:
        return _smallest(joined)
    # the star only connects: every member of a combination counts here, copies too
    counts = combos.join(nodes.select("h", "copies"), "h").groupBy("combo").agg(F.sum("copies").alias("n")).where("n > 1")
    inner = combos.join(counts, "combo").groupBy("h").agg(F.sum(F.col("n") - 1).cast("double").alias("inner"))
    inner = inner.union(alike.groupBy("h").agg(F.sum("w").cast("double"))).groupBy("h").agg(F.sum("inner").alias("inner"))
    return _smallest(joined.join(inner, "h", "left").select("id", "c", F.coalesce("inner", F.lit(0.0)).alias("inner")))


def _signed(batches):
    """(node, v): a label's roots as a unit row of 128 summed signs, whose products estimate the share of roots in common."""
    for b in batches:
        if b.num_rows:
            n = b.column(1).value_lengths().to_numpy()
            x = b.column(1).flatten().to_numpy().view(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, 3, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            sign = np.unpackbits((x ^ (x >> np.uint64(31))).view(np.uint8), axis=1).astype(float) * 2 - 1
            s = np.add.reduceat(sign, np.r_[0, np.cumsum(n)[:-1]])
            yield pa.RecordBatch.from_arrays([b.column(0), pack12(s)], ["node", "v"])


def _label_axis(roots, seed: int):
    return F.aggregate(F.transform(roots, lambda r: _normal(r, seed)), F.lit(0.0), lambda a, v: a + v) / F.sqrt(F.size(roots))


def _normal(value, seed: int):
    """A number of mean 0 and variance 1 that depends on the value alone."""
    u = F.pmod(F.xxhash64(value, F.lit(seed)), F.lit(1 << 20)) / float(1 << 20)
    return (u - 0.5) * float(np.sqrt(12))


def _combinations(words, k: int):
    """Hashes of all sets of k roots from k different words; ``words`` has an array of roots for each word."""
    out = F.flatten(F.transform(words, lambda w, i: F.transform(w, lambda r: F.struct(F.array(r).alias("c"), (i + 1).alias("i")))))
    for _ in range(k - 1):
        out = F.flatten(F.transform(out, lambda s: F.flatten(F.transform(F.slice(words, s["i"] + 1, F.size(words)), lambda w, j: F.transform(w, lambda r: F.struct(F.concat(s["c"], F.array(r)).alias("c"), (s["i"] + j + 1).alias("i")))))))
    return F.transform(out, lambda s: F.xxhash64(F.array_sort(s["c"])))


def _labels(spark, sf_dir):
    return once(table(spark, sf_dir, "regions").select("region_id", "label"), "region_id")


def p2_clusters(spark, sf_dir):
    """(kind, cluster_id, size, typical): each cluster with its size and its most typical members."""
    out = []
    for kind, found in (("vector", vector_clusters(card_vectors(spark, sf_dir), "node_id", "vec")), ("label", label_clusters(_labels(spark, sf_dir), "region_id", "label"))):
        d = describe(found.select(F.col("member_id").alias("node"), F.col("cluster_id").alias("cluster"), "inner"))
        out.append(d.select(F.lit(kind).alias("kind"), F.col("cluster").alias("cluster_id"), "size", "typical"))
    return out[0].union(out[1])


def p2_found(spark, sf_dir):
    vectors = vector_clusters(card_vectors(spark, sf_dir), "node_id", "vec", ranked=False)
    labels = label_clusters(_labels(spark, sf_dir), "region_id", "label", ranked=False)
    both = vectors.select(F.lit("vector").alias("kind"), "member_id", "cluster_id").union(labels.select(F.lit("label").alias("kind"), "member_id", "cluster_id"))
    return both


QUERIES = {"p2_found": p2_found, "p2_clusters": p2_clusters}
ORACLE: dict[str, str] = {}
