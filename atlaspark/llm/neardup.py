"""Near-duplicate groups by odd sketches: banded MinHash candidates, parity bitmaps, exact check, components."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from ..session import cut, partitions, table
from .neighbours import pack
from .spectral import _forest

ROWS, BANDS, BITS = 3, 40, 512
SAMPLES = ROWS * BANDS
MARGIN = 0.17
BLOCK = 1024
PAIRED = 8  # rows of a bucket whose pairs are simply listed
TILE = 512  # rows of a bucket beyond which it is compared tile by tile, in several tasks
GROUP = 1 << 21  # band entries of one task, about
_WORD = re.compile(r"[^\W_]+")


def _seeds(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(1, 2**32, n, dtype=np.uint32) | np.uint32(1), rng.integers(0, 2**32, n, dtype=np.uint32)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


class _Words(dict):
    """A 64-bit hash of each word, kept for the words seen last."""

    def __missing__(self, w: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        h = self[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
        return h


def shingle_sets(texts: list, size: int, min_words: int, memo: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row numbers, sizes, values) of the shingle sets, 32-bit hashes in order, of all texts with at least min_words words."""
    rows, counts, flat = [], [], []
    for i, t in enumerate(texts):
        if t:
            w = _WORD.findall(t.lower())
            if len(w) >= max(min_words, size):
                rows.append(i)
                counts.append(len(w))
                flat += [memo[x] for x in w]
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
    w, n = np.array(flat, np.uint64), np.array(counts)
    run = np.zeros(len(w), np.uint64)
    for j in range(size):
        run[: len(w) - j] = _mix(run[: len(w) - j] * np.uint64(0x100000001B3) + w[j:])
    # a run begins at each word but a text's last size - 1
    ends = np.cumsum(n)
    whole = np.arange(len(w)) + size <= np.repeat(ends, n)
    row = np.repeat(np.arange(len(n), dtype=np.uint64), n)
    u = np.unique(row[whole] << np.uint64(32) | run[whole] >> np.uint64(32))
    return np.array(rows), np.bincount((u >> np.uint64(32)).astype(np.int64), minlength=len(n)), u.astype(np.uint32)


def signatures(sizes: np.ndarray, values: np.ndarray, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(bands n x BANDS, sketches n x BITS/8 bytes) of shingle sets given by their sizes and their values one after the other.

    MinHash i of a set is its least value under hash i. The odd sketch has one bit per slot, flipped once for each (i, MinHash i) that falls on it; the XOR of two
    sketches is then the sketch of the samples in which they differ.
    """
    n, starts = len(sizes), np.r_[0, np.cumsum(sizes)[:-1]]
    a, b = _seeds(SAMPLES, seed)
    mins = np.empty((n, SAMPLES), dtype=np.uint64)
    for i in range(SAMPLES):
        mins[:, i] = np.minimum.reduceat(values * a[i] + b[i], starts)
    bands = np.zeros((n, BANDS), np.uint64)
    for r in range(ROWS):
        bands = _mix(bands * np.uint64(31) + _mix(mins.reshape(n, BANDS, ROWS)[:, :, r]))
    slots = (_mix(mins + (np.arange(SAMPLES, dtype=np.uint64) << np.uint64(40))) >> np.uint64(17)) % np.uint64(BITS)
    counts = np.zeros((n, BITS), dtype=np.uint8)
    for i in range(SAMPLES):
        counts[np.arange(n), slots[:, i]] ^= 1
    return (bands >> np.uint64(32)).astype(np.uint32), np.packbits(counts, axis=1)


def estimate(xor_bits: np.ndarray) -> np.ndarray:
    """Similarity from the population count of two sketches' XOR: E = BITS/2 (1 - exp(-2 d / BITS)), d = 2 SAMPLES (1 - J)."""
    fill = np.clip(1 - 2 * xor_bits / BITS, 1e-3, 1)
    return 1 + BITS * np.log(fill) / (4 * SAMPLES)


def _popcount(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a[:, None, :] ^ b[None, :, :]).sum(axis=2, dtype=np.int32)


def bucket_links(ids: np.ndarray, sk: np.ndarray, threshold: float, margin: float = MARGIN) -> list[tuple[int, int, bool]]:
    """(a, b, sure): pairs of one bucket that can be alike and that its components hang on.

    Pairs beyond the threshold by ``margin`` only yield a spanning forest; pairs within the estimate's error of the threshold are kept whenever they
    would join two trees of that forest, every one of them, for the exact check to decide. Blocks of rows are compared, the full table never exists.
    """
    order = np.argsort(ids)
    ids, sk = ids[order], sk[order]
    m = len(ids)
    tree = np.arange(m)

    def root(i: int) -> int:
        while tree[i] != i:
            tree[i] = tree[tree[i]]
            i = tree[i]
        return i

    out = []
    open_ = np.arange(m)  # those not yet reached
    maybe: list[tuple[np.ndarray, np.ndarray]] = []
    while len(open_):
        frontier, open_ = open_[:1], open_[1:]
        while len(frontier):
            reached = []
            for s in range(0, len(frontier), BLOCK):
                f = frontier[s : s + BLOCK]
                if not len(open_):
                    break
                hit = np.zeros(len(open_), dtype=bool)
                for o in range(0, len(open_), BLOCK):
                    est = estimate(_popcount(sk[f], sk[open_[o : o + BLOCK]]))
                    best = est.argmax(axis=0)
                    sure = est[best, np.arange(est.shape[1])] >= threshold + margin
                    for j in np.flatnonzero(sure):
                        out.append((int(ids[f[best[j]]]), int(ids[open_[o + j]]), True))
                        tree[root(open_[o + j])] = root(f[best[j]])
                    hit[o : o + est.shape[1]] |= sure
                    x, y = np.nonzero((est >= threshold - MARGIN) & ~sure[None, :])
                    if len(x):
                        maybe.append((f[x], open_[o + y]))
                reached.append(open_[hit])
                open_ = open_[~hit]
            frontier = np.concatenate(reached) if reached else frontier[:0]
    for xs, ys in maybe:
        out += [(int(ids[x]), int(ids[y]), False) for x, y in zip(xs, ys) if root(x) != root(y)]
    return out


def tile_links(ids: np.ndarray, sk: np.ndarray, sets: list[np.ndarray], threshold: float) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of a tile whose exact similarity reaches the threshold. The sketches only spare the check of pairs that are far off."""
    n = np.array([len(s) for s in sets])
    near = np.zeros((len(ids), len(ids)), bool)
    for s in range(0, len(ids), 64):
        near[s : s + 64] = estimate(_popcount(sk[s : s + 64], sk)) >= threshold - MARGIN
    a, b = np.nonzero(np.triu(near, 1))
    # only shingles that two sets have count; the sets' products with each other are their common ones
    u, inv, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.cumsum(count > 1) - 1
    row, col = np.repeat(np.arange(len(ids)), n), np.where(count > 1, place, -1)[inv]
    row, col = row[col >= 0], col[col >= 0]
    both = np.zeros((len(ids), len(ids)), np.float32)
    for s in range(0, int((count > 1).sum()), 8192):
        x = np.zeros((len(ids), 8192), np.float32)
        mine = (col >= s) & (col < s + 8192)
        x[row[mine], col[mine] - s] = 1
        both += x @ x.T
    ok = both[a, b] >= threshold * (n[a] + n[b] - both[a, b]) - 1e-4
    a, b = a[ok], b[ok]
    keep, _ = _forest(np.arange(len(ids)), a, b)
    return [(int(ids[x]), int(ids[y])) for x, y in zip(a[keep], b[keep])]


def _rows(col, kind) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), kind).reshape(len(col), -1)


def signed_texts(df: DataFrame, key: str, text_col: str, size: int, min_words: int) -> DataFrame:
    """(key, c, cid, n, sk, bands, sh) of every text with at least min_words words: a hash of the text, one of its shingle set, the set's size, odd sketch, bands and 32-bit shingle hashes in order. Whole texts, read once."""
    kind = dict(df.dtypes)[key]

    def run(batches):
        memo = _Words()
        for big in batches:
            for s in range(0, big.num_rows, 4096):
                b = big.slice(s, 4096)
                rows, n, values = shingle_sets(b.column(2).to_pylist(), size, min_words, memo)
                if not len(rows):
                    continue
                bands, sk = signatures(n, values)
                starts = np.r_[0, np.cumsum(n)]
                with np.errstate(over="ignore"):
                    cid = _mix(np.add.reduceat(_mix(_mix(values.astype(np.uint64) + np.uint64(1))), starts[:-1]) + n.astype(np.uint64)).view(np.int64)
                sh = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((starts * 4).astype(np.int32)), pa.py_buffer(values)])
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(cid), pa.array(n.astype(np.int32)), pack(sk), pack(bands), sh], ["key", "c", "cid", "n", "sk", "bands", "sh"])

    src = df.select(F.col(key).alias("key"), F.xxhash64(text_col).alias("c"), F.col(text_col).alias("t")).where(F.col("key").isNotNull() & F.col("t").isNotNull())
    return src.mapInArrow(run, f"key {kind}, c bigint, cid bigint, n int, sk binary, bands binary, sh binary")


def band_buckets(signed: DataFrame, parts: int) -> DataFrame:
    """(bucket, cid, m): the shingle sets of every band that at least two different ones share, m of them.

    Entries of 12 bytes are packed by target group on the way, equal sets of a batch once, so a text copied without end fills no bucket.
    """

    def spread(batches):
        held: list = []

        def flush():
            cid = np.concatenate([b.column(0).to_numpy() for b in held])
            bands = np.concatenate([_rows(b.column(1), np.uint32) for b in held])
            cid, first = np.unique(cid, return_index=True)
            bands = bands[first]
            g, e = [], []
            for i in range(BANDS):
                part = bands[:, i] % np.uint32(parts)
                order = np.argsort(part, kind="stable")
                entry = np.empty(len(cid), np.dtype([("b", np.uint32), ("c", np.int64)]))
                entry["b"], entry["c"] = bands[order, i], cid[order]
                edges = np.r_[0, np.flatnonzero(np.diff(part[order])) + 1, len(order)]
                g += [i * parts + int(part[order[s]]) for s in edges[:-1]]
                e += [entry[s:t].tobytes() for s, t in zip(edges, edges[1:])]
            return pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(e, pa.binary())], ["g", "e"])

        for b in batches:
            if b.num_rows:
                held.append(b)
            if sum(x.num_rows for x in held) >= 40000:
                yield flush()
                held = []
        if held:
            yield flush()

    def gather(t: pa.Table) -> pa.Table:
        x = np.frombuffer(b"".join(t.column(1).to_pylist()), np.dtype([("b", np.uint32), ("c", np.int64)]))
        order = np.lexsort((x["c"], x["b"]))
        b, c = x["b"][order], x["c"][order]
        new = np.r_[True, (b[1:] != b[:-1]) | (c[1:] != c[:-1])][: len(b)]
        b, c = b[new], c[new]
        starts = np.r_[0, np.flatnonzero(np.diff(b)) + 1][: len(b)]
        m = np.repeat(np.diff(np.r_[starts, len(b)]), np.diff(np.r_[starts, len(b)]))
        keep = m > 1
        return pa.table({"bucket": (np.int64(t.column(0)[0].as_py()) << 32) + b[keep].astype(np.int64), "cid": c[keep], "m": m[keep].astype(np.int64)})

    packed = signed.select("cid", "bands").mapInArrow(spread, "g bigint, e binary")
    return packed.groupBy("g").applyInArrow(gather, "bucket bigint, cid bigint, m bigint")


def near_duplicates(df: DataFrame, key: str, text_col: str, size: int = 5, threshold: float = 0.8, min_words: int = 8) -> tuple[DataFrame, DataFrame]:
    """(members, links): members (key, group_id, n_links) of all groups with at least two rows; links (a, b, similarity) between classes, named by a hash, that the groups hang on.

    Rows whose shingle sets are equal form a class (by a 64-bit hash of the set); only classes are compared, so a text copied a million times costs one.
    Candidates share a MinHash band; odd sketches decide which pairs of a bucket may reach the threshold, and the exact similarity of those is computed from the whole shingle sets. Of pairs well
    above the threshold a bucket only keeps a spanning forest; should the exact check reject one of these, all pairs of its buckets are checked. A bucket of more than TILE classes is compared in
    tiles, exactly, each of which puts out a forest, so no bucket yields more than its size times its tiles. Groups are the components of the exact links.
    Of rows that share a key but differ, the one of the smallest text hash counts. Null keys, null texts and
    texts of fewer than min_words words belong to no group; an empty table gives empty results.
    """
    spark = df.sparkSession
    signed = cut(signed_texts(df, key, text_col, size, min_words))
    twice = signed.groupBy("key").agg(F.min("c").alias("least"), F.max("c").alias("most")).where("least <> most").select("key", "least")
    if not twice.isEmpty():
        signed = cut(signed.join(twice, "key", "left").where("least is null or c = least").drop("least"))
    member = signed.groupBy("key").agg(F.first("cid").alias("cid"))
    entries = signed.count() * BANDS
    filled = cut(band_buckets(signed, max(1, -(-entries // (GROUP * BANDS)), -(-partitions(spark) // BANDS))))
    sketch = signed.select("cid", "sk")

    # small buckets: their pairs
    def listed(t: pa.Table) -> pa.Table:
        bucket, cid = t.column("bucket").to_numpy(), t.column("cid").to_numpy()
        order = np.lexsort((cid, bucket))
        bucket, cid = bucket[order], cid[order]
        a, b = [], []
        for gap in range(1, PAIRED):
            same = bucket[gap:] == bucket[:-gap]
            a.append(cid[:-gap][same])
            b.append(cid[gap:][same])
        pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], axis=1), axis=0)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    few = filled.where(F.col("m") <= PAIRED).withColumn("g", F.shiftright("bucket", 32))
    paired = cut(few.groupBy("g").applyInArrow(listed, "a bigint, b bigint").distinct())

    def close(batches):
        for t in batches:
            if t.num_rows:
                est = estimate(np.bitwise_count(_rows(t.column(2), np.uint64) ^ _rows(t.column(3), np.uint64)).sum(axis=1, dtype=np.int32))
                yield t.select([0, 1]).filter(pa.array(est >= threshold - MARGIN))

    reps = cut(sketch.join(filled.select("cid").distinct(), "cid").groupBy("cid").agg(F.first("sk").alias("sk")))
    likely = paired.join(reps.select(F.col("cid").alias("a"), F.col("sk").alias("x")), "a").join(reps.select(F.col("cid").alias("b"), F.col("sk").alias("y")), "b").select("a", "b", "x", "y")
    likely = likely.mapInArrow(close, "a bigint, b bigint")

    # middling buckets: a forest of each, and the pairs left open
    def linked(margin: float):
        def run(t: pa.Table) -> pa.Table:
            bucket, cid, sk = t.column("bucket").to_numpy(), t.column("cid").to_numpy(), _rows(t.column("sk"), np.uint64)
            order = np.argsort(bucket, kind="stable")
            edges = np.r_[0, np.flatnonzero(np.diff(bucket[order])) + 1, len(order)]
            out = [x for s, e in zip(edges, edges[1:]) for x in bucket_links(cid[order[s:e]], sk[order[s:e]], threshold, margin)]
            p = np.unique(np.array(out, dtype=np.int64).reshape(-1, 3), axis=0)
            return pa.table({"a": np.minimum(p[:, 0], p[:, 1]), "b": np.maximum(p[:, 0], p[:, 1]), "sure": p[:, 2] > 0})

        return run

    schema = "a bigint, b bigint, sure boolean"
    middling = filled.where((F.col("m") > PAIRED) & (F.col("m") <= TILE))
    work = F.pmod(F.xxhash64("bucket"), F.lit(max(8, 4 * partitions(spark)))).alias("g")
    sketched = cut(middling.join(reps, "cid").select(work, "bucket", "cid", "sk"))
    found = sketched.groupBy("g").applyInArrow(linked(MARGIN), schema).union(likely.withColumn("sure", F.lit(False))).groupBy("a", "b").agg(F.max("sure").alias("sure"))
    sets = signed.select("cid", "sh")

    def common(batches):
        for t in batches:
            if t.num_rows:
                v, n = [], []
                for c in (3, 4):
                    raw = t.column(c).to_pylist()
                    n.append(np.array([len(x) // 4 for x in raw]))
                    v.append(np.repeat(np.arange(len(raw), dtype=np.uint64), n[-1]) << np.uint64(32) | np.frombuffer(b"".join(raw), np.uint32))
                s = np.sort(np.concatenate(v))
                both = np.bincount((s[1:][s[1:] == s[:-1]] >> np.uint64(32)).astype(np.int64), minlength=t.num_rows)
                yield pa.RecordBatch.from_arrays([t.column(0), t.column(1), t.column(2), pa.array(both / (n[0] + n[1] - both))], ["a", "b", "sure", "similarity"])

    def checked(pairs: DataFrame) -> DataFrame:
        asked = pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
        whole = cut(sets.join(asked, "cid").groupBy("cid").agg(F.first("sh").alias("sh")))
        both = pairs.join(whole.select(F.col("cid").alias("a"), F.col("sh").alias("x")), "a").join(whole.select(F.col("cid").alias("b"), F.col("sh").alias("y")), "b")
        return cut(both.select("a", "b", "sure", "x", "y").mapInArrow(common, schema + ", similarity double"))

    exact = checked(cut(found))
    links = exact.where(F.col("similarity") >= threshold).select("a", "b", "similarity")
    wrong = exact.where(F.col("sure") & (F.col("similarity") < threshold)).select("a", "b")
    if not wrong.isEmpty():
        # a rejected tree edge may have stood for others: all pairs of the buckets that hold both its ends
        again = sketched.join(wrong, F.col("cid") == F.col("a")).select("bucket", "b").join(sketched.select("bucket", F.col("cid").alias("b")), ["bucket", "b"]).select("bucket").distinct()
        more = sketched.join(again, "bucket").groupBy("g").applyInArrow(linked(np.inf), schema).distinct().join(exact.select("a", "b"), ["a", "b"], "left_anti")
        links = links.union(checked(cut(more)).where(F.col("similarity") >= threshold).select("a", "b", "similarity"))

    # large buckets: tiles
    large = filled.where(F.col("m") > TILE)
    if not large.isEmpty():
        side = large.withColumn("tiles", F.ceil(F.col("m") / (TILE // 2)).cast("int")).withColumn("i", F.pmod(F.xxhash64("cid"), F.col("tiles")).cast("int"))
        spread = side.select("bucket", "cid", F.explode(F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda j: F.struct(F.least("i", j).alias("i"), F.greatest("i", j).alias("j")))).alias("tile"))
        whole = cut(signed.join(large.select("cid").distinct(), "cid").groupBy("cid").agg(F.first("sk").alias("sk"), F.first("sh").alias("sh")))

        def tiled(t: pa.Table) -> pa.Table:
            out = tile_links(t.column("cid").to_numpy(), _rows(t.column("sk"), np.uint64), [np.frombuffer(x, np.uint32) for x in t.column("sh").to_pylist()], threshold)
            p = np.sort(np.array(out, dtype=np.int64).reshape(-1, 2), axis=1)
            return pa.table({"a": p[:, 0], "b": p[:, 1]})

        tiles = spread.join(whole, "cid").select("bucket", "tile", "cid", "sk", "sh").groupBy("bucket", "tile").applyInArrow(tiled, "a bigint, b bigint").distinct()
        links = links.union(checked(cut(tiles.withColumn("sure", F.lit(False)))).where(F.col("similarity") >= threshold).select("a", "b", "similarity"))
    links = links.dropDuplicates(["a", "b"])
    comp = connected_components(links, "a", "b")
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    named = comp.join(degree, "node").select(F.col("node").alias("cid"), "component", "n_links")
    member = cut(member.join(named, "cid", "left").select("key", F.coalesce("component", "cid").alias("c"), F.coalesce("n_links", F.lit(0)).alias("n_links")))
    groups = member.groupBy("c").agg(F.min("key").alias("group_id"), F.count("*").alias("n")).where("n > 1")
    members = member.join(groups, "c").select(F.col("key").alias(key), "group_id", "n_links")
    return members, links


def p3_groups(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "docs").select("node_id", "cores"), "node_id", "cores", size=3, threshold=0.5, min_words=8)[0]


def p3_found(spark, sf_dir):
    return p3_groups(spark, sf_dir).select("node_id", "group_id")


QUERIES = {"p3_found": p3_found, "p3_groups": p3_groups}
ORACLE = {
    "p3_found": """WITH RECURSIVE d AS (SELECT DISTINCT ON (node_id) node_id, cores FROM docs WHERE node_id IS NOT NULL),
w AS (SELECT node_id, regexp_extract_all(lower(cores), '[\\p{L}\\p{N}]+') AS w FROM d),
s AS (SELECT DISTINCT node_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS t FROM w, unnest(range(1, len(w) - 1)) AS r(i) WHERE len(w) >= 8),
n AS (SELECT node_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.node_id AS a, b.node_id AS b, count(*) AS c FROM s a JOIN s b ON a.t = b.t AND a.node_id <> b.node_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON a = x.node_id JOIN n y ON b = y.node_id WHERE c >= 0.5 * (x.n + y.n - c)),
r AS (SELECT a AS node_id, a AS m FROM l UNION SELECT l.b, r.m FROM r JOIN l ON l.a = r.node_id AND r.m < l.b)
SELECT node_id, min(m) AS group_id FROM r GROUP BY 1"""
}
