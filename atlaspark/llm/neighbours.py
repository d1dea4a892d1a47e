"""A nearest-neighbour graph by NN-descent, and greedy search over it.

Vectors travel as rows of 12 bits a value. The graph's nodes are the distinct unit vectors, keyed by a 64-bit hash, so copies of a
vector cost one node and are put back at the end.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, partitions, table

CELL = 512  # rows per pivot
MAX_PIVOTS = 2048  # bound of the sample that the cells of a table are fitted on
OVERSIZE = 6144  # a cell beyond this is cut again
BITS = 12  # planes that cut a cell, at most
TABLES, SPILL = 1, 3
SEED = 7
DOOR = 0.6  # cosine from which a link makes one of its ends stand for the other as an entry point of searches
ROUNDS, STILL = 8, 0.002  # rounds of the descent at most, and the share of list entries whose change in a round ends it
FEW = 1_000_000  # rows of some 20 bytes that are broadcast; more are shuffled


def unit_rows(vec: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, n x dim floats) of the usable vectors: of length dim, finite and not zero."""
    lengths = vec.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(lengths == dim)
    if not len(rows):
        return rows, np.zeros((0, dim), np.float32)
    flat = vec.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)
    norm = np.sqrt(np.einsum("ij,ij->i", flat, flat, dtype=np.float64))
    ok = np.isfinite(norm) & (norm > 0)
    return rows[ok], flat[ok]


def pack12(x: np.ndarray) -> pa.Array:
    """The directions of rows in 12 bits a value, each scaled by its largest; a cosine is off by some 0.00006."""
    q = np.rint(x * (2047 / np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-30))).astype(np.int16) + np.int16(2048)
    q = (q if q.shape[1] % 2 == 0 else np.pad(q, ((0, 0), (0, 1)), constant_values=2048)).astype(np.uint16)
    a, b = q[:, 0::2], q[:, 1::2]
    return pack(np.stack([a >> 4, (a & 15) << 4 | b >> 8, b & 255], axis=2).astype(np.uint8).reshape(len(q), -1))


def pack(m: np.ndarray) -> pa.Array:
    """The rows of a matrix as a binary column."""
    size = m.shape[1] * m.itemsize
    data = np.ascontiguousarray(m)
    return pa.Array.from_buffers(pa.binary(), len(m), [None, pa.py_buffer(np.arange(len(m) + 1, dtype=np.int32) * size), pa.py_buffer(data)])


def _raw(col, kind) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        parts = [_raw(c, kind) for c in col.chunks if len(c)]
        return np.concatenate(parts) if parts else np.zeros((0, 1), kind)
    off = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1]
    return np.frombuffer(col.buffers()[2], np.uint8)[off[0] : off[-1]].view(kind).reshape(len(col), -1)


def unpack(col) -> np.ndarray:
    """Rows packed in 12 bits as a float32 matrix of unit rows. An odd dimension has one zero more."""
    raw = _raw(col, np.uint8).astype(np.int16)
    if not len(raw):
        return np.zeros((0, 1), np.float32)
    raw = raw.reshape(len(raw), -1, 3)
    x = np.empty((len(raw), raw.shape[1] * 2), np.float32)
    x[:, 0::2] = (raw[:, :, 0] << 4 | raw[:, :, 1] >> 4) - 2048
    x[:, 1::2] = ((raw[:, :, 1] & 15) << 8 | raw[:, :, 2]) - 2048
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def coarse(x: np.ndarray) -> np.ndarray:
    """Rows in 8 bits a value, each scaled by its largest; a cosine is off by some 0.0005."""
    return np.rint(x * (127 / np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-9))).astype(np.int8)


def unpack_coarse(col) -> np.ndarray:
    x = _raw(col, np.int8).astype(np.float32)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(values))


def unit_vectors(df: DataFrame, key: str, vec_col: str, dim: int) -> DataFrame:
    """(id, v) of every usable vector; null, empty, zero, non-finite and odd-length vectors are left out."""

    def run(batches):
        for b in batches:
            rows, x = unit_rows(b.column(1), dim)
            if len(rows):
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pack12(x)], ["id", "v"])

    return df.select(F.col(key).cast("long"), F.col(vec_col)).where(F.col(key).isNotNull() & F.col(vec_col).isNotNull()).mapInArrow(run, "id bigint, v binary")


def classes(units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vectors (h, v), members (id, h)): the distinct vectors, and each id's vector. An id with several vectors keeps the one of the smallest hash."""
    hashed = units.withColumn("h", F.xxhash64("v"))
    return cut(hashed.groupBy("v").agg(F.first("h").alias("h")).select("h", "v")), hashed.groupBy("id").agg(F.min("h").alias("h"))


# --- cells -------------------------------------------------------------------------------------------------------------


class Cells:
    """Voronoi cells about sampled pivots: each vector lies in the cells of its ``spill`` nearest pivots, in each of ``tables`` independent samples.

    The pivots are fitted on a bounded sample, at most some MAX_PIVOTS rows a table; every row is placed. A cell of more than OVERSIZE rows is cut by as many planes through its pivot as bring its
    rows down to about CELL, at random but the same on every worker, so nothing but the cells' sizes, MAX_PIVOTS a table, is needed for it.
    """

    def __init__(self, vectors: DataFrame, n: int, tables: int = TABLES, spill: int = SPILL, seed: int = SEED):
        self.sc, self.spill, self.seed = vectors.sparkSession.sparkContext, spill, seed
        self.pivots = [self._sample(vectors, max(1, min(MAX_PIVOTS, round(n / CELL))) / max(n, 1), t) for t in range(tables)]
        self.bits = [np.zeros(len(p), np.int64) for p in self.pivots]
        if n > OVERSIZE / 2:
            self._share()
            for r in self.rows(vectors.select("h", "v"), sizes=True).groupBy("cell").count().where(f"count > {OVERSIZE}").collect():
                self.bits[r.cell // MAX_PIVOTS // 4][r.cell % (MAX_PIVOTS * 4)] = min(BITS, int(np.ceil(np.log2(r["count"] / CELL))))
        self._share()

    def _sample(self, vectors: DataFrame, fraction: float, t: int) -> np.ndarray:
        key = F.pmod(F.xxhash64("h", F.lit(self.seed + t)), F.lit(1 << 24))
        got = vectors.where(key <= max(1, int(fraction * (1 << 24)))).select("v").limit(2 * MAX_PIVOTS).toArrow()
        if not got.num_rows:
            got = vectors.select("v").limit(1).toArrow()
        return unpack(got.column(0))

    def _share(self):
        planes = np.random.default_rng(self.seed).standard_normal((BITS, self.pivots[0].shape[1])).astype(np.float32)
        self.shared = self.sc.broadcast((self.pivots, self.bits, planes, self.spill))

    def keyed(self, vectors: DataFrame, *keep: str) -> DataFrame:
        """(h, v, hash): h now has the home in its upper bits and the hash's lower 40 below, so a node's home is known wherever its key is."""
        shared = self.shared

        def run(batches):
            for b in batches:
                if b.num_rows:
                    h = b.column(0).to_numpy()
                    key = (homes(shared.value, unpack(b.column(1))) << 40) | (h & ((1 << 40) - 1))
                    yield pa.RecordBatch.from_arrays([pa.array(key), b.column(1), b.column(0)], ["h", "v", "hash"])

        return vectors.select("h", "v").mapInArrow(run, "h bigint, v binary, hash bigint")

    def rows(self, vectors: DataFrame, in8bits: bool = False, sizes: bool = False) -> DataFrame:
        """(cell, h, v): every vector once for each of its cells; only (cell) for their sizes."""
        shared = self.shared

        def run(batches):
            for b in batches:
                if b.num_rows:
                    x = unpack(b.column(1))
                    cell, row = cells_of(shared.value, x, not sizes)
                    if sizes:
                        yield pa.RecordBatch.from_arrays([pa.array(cell)], ["cell"])
                        continue
                    v, take = pack(coarse(x)) if in8bits else b.column(1), pa.array(row)
                    yield pa.RecordBatch.from_arrays([pa.array(cell), b.column(0).take(take), v.take(take)], ["cell", "h", "v"])

        return vectors.select("h", "v").mapInArrow(run, "cell bigint" if sizes else "cell bigint, h bigint, v binary")


def _cut(fitted, table_: int, x: np.ndarray, pivot: np.ndarray) -> np.ndarray:
    """On which side of its cell's planes each row lies, as a number; 0 where the cell is not cut."""
    pivots, bits, planes, _ = fitted
    out, some = np.zeros(len(x), np.int64), np.flatnonzero(bits[table_][pivot])
    if len(some):
        side = ((x[some] - pivots[table_][pivot[some]]) @ planes.T > 0) & (np.arange(len(planes))[None, :] < bits[table_][pivot[some]][:, None])
        out[some] = side @ (1 << np.arange(len(planes)))
    return out


def cells_of(fitted, x: np.ndarray, fine: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(cell, row) of every row's cells. A cell's number has its table, its pivot and, unless only ``fine`` is off, the side of its planes."""
    cell, row = [], []
    for t, p in enumerate(fitted[0]):
        s = x @ p.T
        k = min(fitted[3], s.shape[1])
        near = np.argpartition(-s, k - 1, axis=1)[:, :k] if k < s.shape[1] else np.tile(np.arange(k), (len(x), 1))
        who, pivot = np.repeat(np.arange(len(x)), k), near.ravel()
        code = t * MAX_PIVOTS * 4 + pivot
        cell.append(code << BITS | _cut(fitted, t, x[who], pivot) if fine else code)
        row.append(who)
    return np.concatenate(cell), np.concatenate(row)


def homes(fitted, x: np.ndarray) -> np.ndarray:
    """The one cell of the first table that each row lies deepest in, as a number below 2^24."""
    pivot = (x @ fitted[0][0].T).argmax(axis=1)
    return pivot << BITS | _cut(fitted, 0, x, pivot)


LISTS = "h bigint, nbr array<bigint>, sim array<float>"
GRAPH = LISTS + ", fresh array<boolean>"


def _top(sims: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, value) of the k largest entries of each row that reach least, in order."""
    k = min(k, sims.shape[1])
    col = np.argpartition(-sims, k - 1, axis=1)[:, :k] if k < sims.shape[1] else np.tile(np.arange(k), (len(sims), 1))
    val = np.take_along_axis(sims, col, 1)
    order = np.argsort(-val, axis=1, kind="stable")
    col, val = np.take_along_axis(col, order, 1), np.take_along_axis(val, order, 1)
    ok = val >= least
    return np.repeat(np.arange(len(sims)), ok.sum(axis=1)), col[ok], val[ok]


def cell_lists(rows: DataFrame, k: int, least: float, in8bits: bool = False) -> DataFrame:
    """The k nearest within each cell, all of it compared, in blocks of rows."""
    read = unpack_coarse if in8bits else unpack

    def run(t: pa.Table) -> pa.Table:
        h, x = t.column(1).to_numpy(), read(t.column(2))
        out_h, out_n, out_s, out_c = [], [], [], []
        for s in range(0, len(h), 512):
            sims = x[s : s + 512] @ x.T
            sims[np.arange(len(sims)), np.arange(s, s + len(sims))] = -2
            need = (sims >= least).any(axis=1)
            if not need.any():
                continue
            r, c, v = _top(sims[need], k, least)
            out_h.append(h[s : s + 512][need])
            out_c.append(np.bincount(r, minlength=int(need.sum())))
            out_n.append(h[c])
            out_s.append(v.astype(np.float32))
        if not out_h:
            return pa.table({"h": pa.array([], pa.int64()), "nbr": pa.array([], pa.list_(pa.int64())), "sim": pa.array([], pa.list_(pa.float32()))})
        counts = np.concatenate(out_c)
        return pa.table({"h": np.concatenate(out_h), "nbr": lists(np.concatenate(out_n), counts), "sim": lists(np.concatenate(out_s), counts)})

    return rows.groupBy("cell").applyInArrow(run, LISTS)


def flat(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, neighbour, value) of every entry of a table of lists."""
    nbr, sim = t.column(1).combine_chunks(), t.column(2).combine_chunks()
    return np.repeat(t.column(0).to_numpy(), nbr.value_lengths().to_numpy()), nbr.flatten().to_numpy(), sim.flatten().to_numpy()


def best_k(h: np.ndarray, n: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best entries of each node, in order; ties go to the smaller key."""
    order = np.lexsort((n, -s, h))
    h, n, s = h[order], n[order], s[order]
    # the same pair may differ by a rounding error between cells: the first, best one stays
    pair = np.lexsort((np.arange(len(h)), n, h))
    first = np.ones(len(h), bool)
    first[pair[1:]] = (h[pair[1:]] != h[pair[:-1]]) | (n[pair[1:]] != n[pair[:-1]])
    h, n, s = h[first], n[first], s[first]
    starts = np.r_[0, np.flatnonzero(np.diff(h)) + 1]
    rank = np.arange(len(h)) - np.repeat(starts, np.diff(np.r_[starts, len(h)]))
    keep = rank < k
    return h[keep], n[keep], s[keep]


def merge_lists(df: DataFrame, k: int, anew: bool = False) -> DataFrame:
    """(h, nbr, sim, fresh): one list of the k best per node out of many; ties go to the smaller key. ``df`` is (h, nbr, sim, old): fresh marks what is not on the node's old list. With ``anew`` old lists serve for that only."""

    def run(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got).combine_chunks()
        h, n, s = best_k(*flat(t.filter(pc.invert(t.column(3))).combine_chunks() if anew else t), k)
        if not len(h):
            return
        before = flat(t.filter(t.column(3)))
        was = np.zeros(len(h), bool)
        if len(before[0]):
            pair = np.unique(np.stack([before[0], before[1]], axis=1).view([("h", np.int64), ("n", np.int64)]).ravel())
            was = np.isin(np.stack([h, n], axis=1).view([("h", np.int64), ("n", np.int64)]).ravel(), pair)
        u, counts = np.unique(h, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(u), lists(n, counts), lists(s, counts), pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(~was))], ["h", "nbr", "sim", "fresh"])

    return df.select("h", "nbr", "sim", "old").repartition(partitions(df.sparkSession), "h").mapInArrow(run, GRAPH)


def home_of(h: str):
    return F.shiftright(F.col(h), 40)


def star_members(c: np.ndarray, m: np.ndarray, own: np.ndarray, fresh: np.ndarray, reverse: int, turn: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, member, fresh), one row each, by node: all members on the node's own list, and of those that only have it on theirs the first ``reverse`` in an order by hash that changes with ``turn``, fresh ones first."""
    mixed = ((m ^ c ^ turn).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
    order = np.lexsort((~own, m, mixed, ~fresh, c))
    c, m, own, fresh = c[order], m[order], own[order], fresh[order]
    # a member that is on both lists counts as own, and as fresh if either entry is
    pair = np.lexsort((~own, m, c))
    first = np.r_[True, (c[pair][1:] != c[pair][:-1]) | (m[pair][1:] != m[pair][:-1])]
    group = np.cumsum(first) - 1
    any_fresh = np.zeros(group[-1] + 1, bool)
    np.logical_or.at(any_fresh, group, fresh[pair])
    keep = np.sort(pair[first])
    fresh[pair[first]] = any_fresh
    c, m, own, fresh = c[keep], m[keep], own[keep], fresh[keep]
    starts = np.r_[0, np.flatnonzero(np.diff(c)) + 1]
    sampled = np.cumsum(~own)
    stay = own | (sampled - np.repeat(sampled[starts] - ~own[starts], np.diff(np.r_[starts, len(c)])) <= reverse)
    return c[stay], m[stay], fresh[stay]


def local_join(graph: DataFrame, vectors: DataFrame, k: int, least: float, turn: int = 0) -> DataFrame:
    """The proposals (h, nbr, sim) of one NN-descent step: of all who meet in the list or the reverse list of some node, those are compared of which one came onto it in the step before.

    Each node is at home in one cell. A cell gets the lists of its own nodes, unless nothing on them is fresh, and, once, every vector that occurs in them; there the neighbours of
    neighbours are compared. Reverse lists can be long: as NN-descent does, 2k of them are sampled, by hash, others each round. A node's own list always stays, and the caller
    merges what comes out with it, so a step can only improve a list.
    """
    edges = graph.select("h", F.explode(F.arrays_zip("nbr", "fresh")).alias("x")).select("h", F.col("x.nbr").alias("m"), F.lit(True).alias("own"), F.col("x.fresh").alias("fresh"))
    both = edges.union(edges.select(F.col("m").alias("h"), F.col("h").alias("m"), F.lit(False), "fresh")).withColumn("home", home_of("h"))
    if turn:  # in the first round everything is fresh
        active = cut(both.where("fresh").select("h").distinct())
        both = cut(both.join(F.broadcast(active) if active.count() <= FEW else active, "h").select(*both.columns))
    own = both.select(F.col("home").alias("at"), F.col("h").alias("id"))
    asked = both.select(F.col("home").alias("at"), F.col("m").alias("id")).union(own).distinct()
    sent = vectors.select(F.col("h").alias("id"), "v")
    if turn:
        asked = cut(asked)
        ids = cut(asked.select("id").distinct())
        sent = sent.join(F.broadcast(ids), "id", "left_semi") if ids.count() <= FEW else sent
    need = asked.join(sent, "id").select("at", "id", "v")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table({"h": pa.array([], pa.int64()), "nbr": pa.array([], pa.list_(pa.int64())), "sim": pa.array([], pa.list_(pa.float32()))})
        if not left.num_rows or not right.num_rows:
            return empty
        ids, x = right.column(1).to_numpy(), unpack(right.column(2))
        order = np.argsort(ids)
        ids, x = ids[order], x[order]
        c, m = left.column("h").to_numpy(), left.column("m").to_numpy()
        who = np.unique(c)
        own, fresh = (np.r_[left.column(z).to_numpy(), np.full(len(who), z == "own")] for z in ("own", "fresh"))
        c, m, fresh = star_members(np.r_[c, who], np.r_[m, who], own, fresh, 2 * k, turn)
        m = np.searchsorted(ids, m)
        starts = np.r_[0, np.flatnonzero(np.diff(c)) + 1]
        sizes = np.diff(np.r_[starts, len(c)])
        codes = []
        for size in np.unique(sizes):
            if size < 2:
                continue
            at = starts[sizes == size][:, None] + np.arange(size)
            i, j = np.triu_indices(size, 1)
            a, b, new = m[at][:, i], m[at][:, j], fresh[at][:, i] | fresh[at][:, j]
            codes.append(np.unique((np.minimum(a, b).astype(np.int64) * len(ids) + np.maximum(a, b))[new]))
        if not codes:
            return empty
        code = np.unique(np.concatenate(codes))
        a, b = code // len(ids), code % len(ids)
        sim = np.empty(len(code), np.float32)
        for s in range(0, len(code), 1 << 15):
            sim[s : s + (1 << 15)] = np.einsum("ij,ij->i", x[a[s : s + (1 << 15)]], x[b[s : s + (1 << 15)]])
        ok = (sim >= least) & (a != b)
        a, b, sim = a[ok], b[ok], sim[ok]
        u, v, s = np.r_[a, b], np.r_[b, a], np.r_[sim, sim]
        order = np.lexsort((-s, u))
        u, v, s = u[order], v[order], s[order]
        if not len(u):
            return empty
        starts = np.r_[0, np.flatnonzero(np.diff(u)) + 1]
        rank = np.arange(len(u)) - np.repeat(starts, np.diff(np.r_[starts, len(u)]))
        u, v, s = u[rank < k], v[rank < k], s[rank < k]
        who, counts = np.unique(u, return_counts=True)
        return pa.table({"h": ids[who], "nbr": lists(ids[v], counts), "sim": lists(s, counts)})

    return both.groupBy("home").cogroup(need.groupBy("at")).applyInArrow(run, LISTS)


def neighbour_graph(vectors: DataFrame, k: int, least: float = -1.0, rounds: int = ROUNDS, tables: int = TABLES, still: float = STILL, seen=None) -> tuple[DataFrame, DataFrame, Cells]:
    """(graph (h, nbr, sim), vectors (h, v, hash), cells): the approximate k nearest of every vector, those of a cosine of least at least, by NN-descent.

    It starts from the lists within overlapping cells about sampled pivots (a bounded sample: every row is placed) and joins neighbours of neighbours, round by round, until a round changes no
    more than the share ``still`` of the list entries, or ``rounds`` are over. Each round's lists are merged with those before. Ties go to the smaller key. ``seen``, if
    given, is called with the graph of every round.
    """
    cells = Cells(vectors, vectors.count(), tables)
    vectors = cells.keyed(vectors)
    # the first lists only propose: 8-bit vectors and a few more places than k; the first round compares 12-bit ones anew, the node itself included
    first = cell_lists(cells.rows(vectors, True), k + 2, least - 0.005, True)
    graph = cut(merge_lists(first.withColumn("old", F.lit(False)), k + 2))
    for turn in range(max(1, rounds)):
        if seen:
            seen(graph)
        proposed = local_join(graph, vectors, k, least, turn).withColumn("old", F.lit(False))
        # the 8-bit cosines of the first lists give way to those of the first round
        graph = cut(merge_lists(graph.select("h", "nbr", "sim", F.lit(True).alias("old")).union(proposed), k, anew=not turn))
        size = graph.agg(F.sum(F.size("nbr")).alias("all"), F.sum(F.size(F.filter("fresh", lambda f: f))).alias("fresh")).first()
        if not size["all"] or size["fresh"] <= still * size["all"]:
            break
    if seen:
        seen(graph)
    return graph, vectors, cells


def neighbour_pairs(df: DataFrame, key: str, vec_col: str, k: int, least: float, dim: int = 128, rounds: int = ROUNDS) -> DataFrame:
    """(a_id, b_id): pairs, smaller key first, of which at least one is among the k most similar others of the other, and whose cosine reaches least.

    Unusable vectors (null, empty, zero, non-finite, of another length than dim) have no neighbours. Copies of a vector have
    cosine 1; among equals the smaller keys come first. Copies are taken from their class's first k + 1 keys, so a vector copied without bound costs
    its copies k rows each.
    """
    vectors, members = classes(unit_vectors(df, key, vec_col, dim))
    graph, keyed, _ = neighbour_graph(vectors, k + 1, least, rounds)
    members = cut(members.join(keyed.select(F.col("h").alias("key"), F.col("hash").alias("h")), "h").select("id", F.col("key").alias("h")))
    w = Window.partitionBy("h").orderBy("id")
    firsts = members.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1).select("h", "id")
    near = graph.select("h", F.explode(F.arrays_zip("nbr", "sim")).alias("x")).select("h", F.col("x.nbr").alias("q"), F.col("x.sim").alias("sim"))
    copied = members.groupBy("h").count().where("count > 1").select("h", F.col("h").alias("q"), F.lit(2.0).cast("float").alias("sim"))
    other = near.union(copied).join(firsts.withColumnRenamed("h", "q").withColumnRenamed("id", "other"), "q")
    best = other.withColumn("r", F.row_number().over(Window.partitionBy("h").orderBy(F.desc("sim"), "other"))).where(F.col("r") <= k + 1)
    listed = best.groupBy("h").agg(F.sort_array(F.collect_list(F.struct("r", "other"))).alias("best")).select("h", F.col("best.other").alias("best"))
    # an id that is itself on its class's list of k + 1 gives its place to the next
    each = members.join(listed, "h").select("id", F.explode(F.slice(F.filter("best", lambda x: x != F.col("id")), 1, k)).alias("other"))
    return each.select(F.least("id", "other").alias("a_id"), F.greatest("id", "other").alias("b_id")).distinct()


def graph_search(df: DataFrame, queries: DataFrame, key: str, vec_col: str, k: int = 8, dim: int = 128, beam: int = 32, step: int = 6, rounds: int = 16, least: float = 0.0) -> DataFrame:
    """(query, id, sim): greedy search over the neighbour graph of ``df`` for the vectors of ``queries``, both (key, vec_col, ..); the row of the query's own key is left out.

    The query's vector need not be in the collection. A search enters at the best of the cells' entry points, one for every well linked neighbourhood, that lie in the cells of its vector, and knows nothing else of the graph; at each round it looks at the neighbours, both
    ways, of its ``step`` best nodes not yet expanded, keeping the ``beam`` best seen; it ends when those have all been expanded. Every round is two joins, on node, of what the searches ask for (sent to the graph
    where it lies if it is at most FEW rows). Copies answer for each other up to k. Unusable queries have no answer; rows below ``least`` are left out.
    """
    vectors, members = classes(unit_vectors(df, key, vec_col, dim))
    # a search needs ways through the graph, not every last neighbour
    graph, keyed, cells = neighbour_graph(vectors, k + 2, max(-1.0, least - 0.1), rounds=3)
    keyed = cut(keyed)
    members = cut(members.join(keyed.select(F.col("h").alias("key"), F.col("hash").alias("h")), "h").select("id", F.col("key").alias("h")))
    asked_vectors, wanted = classes(unit_vectors(queries, key, vec_col, dim))
    asked = cut(cells.keyed(asked_vectors).select(F.col("hash").alias("q"), F.col("v").alias("qv"), home_of("h").alias("home")))
    forth = graph.select("h", F.explode(F.arrays_zip("nbr", "sim")).alias("x")).select("h", F.col("x.nbr").alias("n"), F.col("x.sim").alias("sim"))
    links = cut(forth.union(forth.select("n", "h", "sim")).dropDuplicates(["h", "n"]))
    # entry points: of every well linked neighbourhood the node of the smallest key, so none is without one
    covered = links.where((F.col("sim") >= DOOR) & (F.col("n") < F.col("h"))).select("h").distinct()
    doors = cells.rows(keyed.select("h", "v").join(covered, "h", "left_anti"), True)
    entering = cells.rows(asked.select(F.col("q").alias("h"), F.col("qv").alias("v")), True)

    def enter(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            x, y = unpack_coarse(left.column(2)), unpack_coarse(right.column(2))
            for at in range(0, len(y), 512):
                r, c, _ = _top(y[at : at + 512] @ x.T, step, -1.0)
                out.append(pa.table({"q": right.column(1).to_numpy()[at + r], "n": left.column(1).to_numpy()[c]}))
        return pa.concat_tables(out) if out else pa.table({"q": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})

    frontier = cut(doors.groupBy("cell").cogroup(entering.groupBy("cell")).applyInArrow(enter, "q bigint, n bigint").distinct())
    seen = None

    def few(rows: DataFrame, most: int = FEW) -> DataFrame:
        return F.broadcast(rows) if rows.count() <= most else rows

    vectors_asked = few(asked.select("q", "qv"), FEW // 10)

    def compare(batches):
        for b in batches:
            if b.num_rows:
                sim = np.einsum("ij,ij->i", unpack(b.column(2)), unpack(b.column(3)))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sim)], ["q", "n", "sim"])

    for _ in range(rounds):
        met = few(frontier).join(keyed.select(F.col("h").alias("n"), "v"), "n").join(vectors_asked, "q").select("q", "n", "v", "qv").mapInArrow(compare, "q bigint, n bigint, sim float").withColumn("open", F.lit(True))
        pool = met if seen is None else seen.unionByName(met)
        place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("sim"), "n"))
        turn = F.row_number().over(Window.partitionBy("q", "open").orderBy(F.desc("sim"), "n"))
        marked = cut(pool.withColumn("r", place).where(F.col("r") <= beam).drop("r").withColumn("now", F.col("open") & (turn <= step)))
        seen = marked.select("q", "n", "sim", (F.col("open") & ~F.col("now")).alias("open"))
        asking = marked.where("now").select("q", F.col("n").alias("h"))
        if asking.isEmpty():
            break
        frontier = cut(few(asking).join(links, "h").select("q", "n").distinct().join(seen.select("q", "n"), ["q", "n"], "left_anti"))
    firsts = members.withColumn("r", F.row_number().over(Window.partitionBy("h").orderBy("id"))).where(F.col("r") <= k + 1).select(F.col("h").alias("n"), "id")
    answers = seen.where(F.col("sim") >= least).select("q", "n", "sim").join(firsts, "n").select(F.col("q").alias("h"), "id", "sim")
    out = wanted.withColumnRenamed("id", "query").join(answers, "h").where("query <> id")
    return out.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("sim"), "id"))).where(F.col("r") <= k).select("query", "id", "sim")


def card_vectors(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "vectors").where("basis = 'card'").select("node_id", "vec")


def p4_found(spark, sf_dir):
    return neighbour_pairs(card_vectors(spark, sf_dir), "node_id", "vec", k=8, least=0.70)


def p4_search(spark, sf_dir):
    """The 8 most similar nodes, of a cosine of 0.70 at least, of every node whose id is divisible by 50, by greedy search over the graph of all nodes. The search has the vector only, not its place in the graph."""
    cards = card_vectors(spark, sf_dir)
    return graph_search(cards, cards.where(F.col("node_id") % 50 == 0), "node_id", "vec", least=0.70)


QUERIES = {"p4_found": p4_found, "p4_search": p4_search}
ORACLE: dict[str, str] = {}
