"""Filling containers of fixed capacity by lexical retrieval: a BM25 index, sharded by what the items are about, returns what belongs with each seed."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, table
from .neighbours import pack12 as packed_rows
from .neighbours import unpack
from .tokens import TOKENIZER, encode

CAPACITY = 2048
SHARD = 1024  # items of one index shard
GROUP = 4  # shards that one task cuts out of a group of alike items
SAMPLE, LEAST_SAMPLE = 65536, 16  # bound of the sample that the groups are fitted on, and of a group's share in it
SPACE = 64  # dimensions of the projected term weights
K1, B = 1.2, 0.75
FULL = 0.98  # a container less full than this is opened again in the next pass


def token_items(df: DataFrame, key: str, text_col: str, capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, piece, start, n_tokens, terms, tfs): each document as one item, those above the capacity as several of at most the capacity.

    terms are the item's distinct token ids, tfs their counts up to 255, as packed bytes. Null and empty texts are one item of 0 tokens.
    """

    def run(batches):
        for b in batches:
            cols = {k: [] for k in ("doc_id", "piece", "start", "n_tokens", "terms", "tfs")}
            for k, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = np.array(encode(text, tokenizer), dtype=np.uint32)
                for p, s in enumerate(range(0, max(len(ids), 1), capacity)):
                    part = ids[s : s + capacity]
                    terms, tf = np.unique(part, return_counts=True)
                    for c, v in zip(cols, (k, p, s, len(part), terms.tobytes(), np.minimum(tf, 255).astype(np.uint8).tobytes())):
                        cols[c].append(v)
            yield pa.RecordBatch.from_pydict(cols, ITEMS)

    return df.select(F.col(key).cast("long"), F.col(text_col)).where(F.col(key).isNotNull()).mapInArrow(run, "doc_id bigint, piece int, start int, n_tokens int, terms binary, tfs binary")


ITEMS = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int32()), ("n_tokens", pa.int32()), ("terms", pa.binary()), ("tfs", pa.binary())])


class Stats:
    """What BM25 needs of all items: their number, their mean length and each token's document frequency. Bounded by the tokenizer's vocabulary."""

    def __init__(self, n: int, length: int, term: np.ndarray, df: np.ndarray):
        self.n, self.mean = max(1, n), max(length / max(1, n), 1e-9)
        self.df = np.zeros(int(term.max()) + 1 if len(term) else 1, np.int32)
        self.df[term] = df

    def weights(self, term: np.ndarray, tf: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The BM25 weight of each term occurrence, for items of these lengths."""
        df = self.df[term]
        return (np.log1p((self.n - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / self.mean))).astype(np.float32)


def item_stats(items: DataFrame) -> Stats:
    """The statistics of all items, counted in each task and summed."""

    def run(batches):
        df, n, length = np.zeros(0, np.int64), 0, 0
        for b in batches:
            got = np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint32), minlength=len(df))
            got[: len(df)] += df
            df, n, length = got, n + b.num_rows, length + int(np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).sum(dtype=np.int64))
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-2, -1, at]), pa.array(np.r_[length, n, df[at]])], ["term", "n"])

    got = items.select("terms", "tfs").mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    term, n = got.column(0).to_numpy(), got.column(1).to_numpy()
    total = dict(zip(term[term < 0].tolist(), n[term < 0].tolist()))
    return Stats(total.get(-1, 0), total.get(-2, 0), term[term >= 0], n[term >= 0])


_axes: dict = {}


def located(terms: list[bytes], tfs: list[bytes], stats: Stats, block: int = 128) -> np.ndarray:
    """Unit rows (int16): the items' BM25 weights under a fixed random projection. Items without terms are zero."""
    size = len(stats.df)
    if size not in _axes:
        _axes[size] = np.random.default_rng(17).standard_normal((size, SPACE), dtype=np.float32)
    out = np.zeros((len(terms), SPACE), np.float32)
    for s in range(0, len(terms), block):
        term, tf = np.frombuffer(b"".join(terms[s : s + block]), np.uint32), np.frombuffer(b"".join(tfs[s : s + block]), np.uint8).astype(np.float32)
        counts = np.array([len(t) // 4 for t in terms[s : s + block]])
        full = np.flatnonzero(counts)
        if len(full):
            starts = np.r_[0, np.cumsum(counts[full])[:-1]]
            length = np.repeat(np.add.reduceat(tf, starts), counts[full])
            out[s + full] = np.add.reduceat(_axes[size][term] * stats.weights(term, tf, length)[:, None], starts)
    return np.rint(out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9) * 32767).astype(np.int16)


def bisect(x: np.ndarray, leaf: float) -> tuple[list, list[np.ndarray]]:
    """(tree, leaves): rows halved by 2-means until a part has at most ``leaf`` of them; a half has from 0.3 to 0.7 of its rows.

    The tree is [axis, bound, left, right] per node, a leaf's number standing as -1 - number; leaves are numbered from left to right, so neighbours in number are alike.
    """
    tree, leaves, todo = [], [], [(np.arange(len(x)), -1, 0)]
    while todo:
        rows, parent, side = todo.pop()
        name = len(tree)
        if len(rows) <= leaf:
            name = -1 - len(leaves)
            leaves.append(rows)
        if parent >= 0:
            tree[parent][2 + side] = name
        if name < 0:
            continue
        y = x[rows]
        z = y - y.mean(axis=0)
        axis = np.random.default_rng(len(rows)).standard_normal(x.shape[1])
        for _ in range(8):
            axis = z.T @ (z @ axis)
            axis = axis / max(np.linalg.norm(axis), 1e-12)
        right = z @ axis > 0
        for _ in range(6):
            if right.all() or not right.any():
                break
            axis = y[right].mean(axis=0) - y[~right].mean(axis=0)
            bound = (y[right].mean(axis=0) + y[~right].mean(axis=0)) @ axis / 2
            right = y @ axis > bound
        p = y @ axis
        order = np.argsort(p, kind="stable")
        at = min(max(int((~right).sum()), int(np.ceil(0.3 * len(rows))), 1), max(1, int(0.7 * len(rows))))
        tree.append([axis, p[order[at]], 0, 0])
        todo += [(rows[np.sort(order[at:])], name, 1), (rows[np.sort(order[:at])], name, 0)]
    return tree, leaves


def routed(x: np.ndarray, tree: list) -> np.ndarray:
    """The number of the leaf that each row falls into."""
    out, todo = np.zeros(len(x), np.int64), [(0, np.arange(len(x)))] if tree else []
    while todo:
        name, rows = todo.pop()
        if name < 0:
            out[rows] = -1 - name
        elif len(rows):
            right = x[rows] @ tree[name][0] >= tree[name][1]
            todo += [(tree[name][2], rows[~right]), (tree[name][3], rows[right])]
    return out


class Index:
    """A BM25 inverted index over the items of one shard. Its statistics are those of all items where they are given, else of the shard."""

    def __init__(self, terms: list[bytes], tfs: list[bytes], stats: Stats | None = None):
        each = [np.frombuffer(t, np.uint32) for t in terms]
        counts = np.array([len(e) for e in each], dtype=np.int64)
        term = np.concatenate(each) if len(each) else np.zeros(0, np.uint32)
        tf = np.frombuffer(b"".join(tfs), np.uint8).astype(np.float32)
        item = np.repeat(np.arange(len(each), dtype=np.int32), counts)
        self.offsets = np.r_[0, np.cumsum(counts)]
        self.vocab, self.codes = np.unique(term, return_inverse=True)
        order = np.argsort(self.codes, kind="stable")
        df = np.bincount(self.codes, minlength=len(self.vocab))
        self.starts = np.r_[0, np.cumsum(df)]
        length = np.bincount(item, tf, minlength=len(each))
        weight = (stats or Stats(len(each), length.sum(), self.vocab, df)).weights(term, tf, length[item])
        self.items, self.weights, self.n = item[order], weight[order], len(each)

    def scores(self, i: int) -> np.ndarray:
        """BM25 of every item for item i as the query, over all its terms."""
        codes = self.codes[self.offsets[i] : self.offsets[i + 1]]
        a, b = self.starts[codes], self.starts[codes + 1]
        size = b - a
        total = int(size.sum())
        if not total:
            return np.zeros(self.n)
        at = np.repeat(a - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(total)
        return np.bincount(self.items[at], self.weights[at], minlength=self.n)


def fill(sizes: np.ndarray, index: Index, capacity: int) -> list[tuple[list[int], int]]:
    """[(items in order, tokens)]: containers of one shard.

    The largest unused item is the seed; its neighbours follow by falling score as long as they fit and leave room to close the window with, then the largest
    unused items that still fit close it, the better scored of equals first.
    """
    n = len(sizes)
    used = np.zeros(n, bool)
    order = np.lexsort((np.arange(n), -sizes))
    out, at = [], 0
    while True:
        while at < n and used[order[at]]:
            at += 1
        if at == n:
            return out
        seed = int(order[at])
        used[seed] = True
        members, room = [seed], capacity - int(sizes[seed])
        if room > 0:
            score = index.scores(seed)
            free = np.flatnonzero(~used & (sizes <= room))
            ranked = free[np.lexsort((free, -score[free]))]
            reserve = min(room, capacity // 8)
            for j in ranked:
                s = int(sizes[j])
                if s <= room - reserve or s == room:
                    members.append(int(j))
                    used[j] = True
                    room -= s
                    if room <= reserve:
                        break
            # close: the pair or single that fills best
            ranked = ranked[~used[ranked]]
            while room > 0 and len(ranked):
                fit = ranked[sizes[ranked] <= room]
                if not len(fit):
                    break
                best = _best_close(sizes, fit, room)
                for j in best:
                    members.append(int(j))
                    used[j] = True
                    room -= int(sizes[j])
                ranked = fit[~used[fit]]
                if room and not (ranked.size and (sizes[ranked] <= room).any()):
                    break
        out.append((members, capacity - room))


def _best_close(sizes: np.ndarray, fit: np.ndarray, room: int) -> list[int]:
    """The one item, or the two, whose sizes come nearest to the room; the better ranked on ties."""
    s = sizes[fit]
    one = int(s.argmax())
    if s[one] == room or len(fit) == 1:
        return [int(fit[one])]
    o = np.argsort(s, kind="stable")
    t = s[o]
    k = np.searchsorted(t, room - t, "right") - 1
    k = np.where(k == np.arange(len(t)), k - 1, k)
    total = np.where(k >= 0, t + t[np.maximum(k, 0)], -1)
    two = int(total.argmax())
    if total[two] > s[one] and total[two] <= room:
        return [int(fit[o[two]]), int(fit[o[k[two]]])]
    return [int(fit[one])]


PACKED = "shard bigint, slot int, place int, doc_id bigint, piece int, start int, n_tokens int, used int, terms binary, tfs binary"


def _fill_groups(items: DataFrame, capacity: int, stats: Stats, shard: int, ship: bool) -> DataFrame:
    """Each group (at) of items cut into shards of alike items, of at most ``shard`` each, and these filled into containers."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("doc_id", "ascending"), ("piece", "ascending")])
        terms, tfs = t.column("terms").to_pylist(), t.column("tfs").to_pylist()
        leaves = [np.arange(len(terms))] if len(terms) <= shard else bisect(unpack(packed_rows(located(terms, tfs, stats))), shard)[1]
        sizes, out, name = t.column("n_tokens").to_numpy(), [], t.column("at")[0].as_py() << 20
        for leaf in leaves:
            out += [(name, leaf[m], u) for m, u in fill(sizes[leaf], Index([terms[i] for i in leaf], [tfs[i] for i in leaf], stats), capacity)]
            name += 1
        lengths = [len(m) for _, m, _ in out]
        name = np.repeat(np.array([n for n, _, _ in out], dtype=np.int64), lengths)
        slot = np.repeat(np.arange(len(out), dtype=np.int32), lengths)
        place = np.concatenate([np.arange(n, dtype=np.int32) for n in lengths])
        full = np.repeat(np.array([u for _, _, u in out], dtype=np.int32), lengths)
        got = t.take(pa.array(np.concatenate([m for _, m, _ in out])))
        keep = pa.array(full < FULL * capacity) if ship else pa.array(np.zeros(len(full), bool))
        none = pa.scalar(None, pa.binary())
        return pa.table({"shard": name, "slot": slot, "place": place, "doc_id": got.column("doc_id"), "piece": got.column("piece"), "start": got.column("start"), "n_tokens": got.column("n_tokens"), "used": full, "terms": pc.if_else(keep, got.column("terms").combine_chunks(), none), "tfs": pc.if_else(keep, got.column("tfs").combine_chunks(), none)})

    return items.groupBy("at").applyInArrow(run, PACKED)


def grouped(items: DataFrame, n: int, stats: Stats, shard: int = SHARD) -> DataFrame:
    """items with at, their group: alike items are together, about GROUP shards in a group whatever the size of the input.

    The groups are the leaves of a tree fitted on a bounded sample; every item is placed. A group far too large (texts without any difference) is salted by hash.
    """
    want = -(-n // (GROUP * shard))
    if want < 2:
        return items.withColumn("at", F.lit(0).cast("long"))
    rows = min(n, SAMPLE, max(4096, 64 * want))

    def place(tree):
        def run(batches):
            for b in batches:
                if b.num_rows:
                    x = located(b.column("terms").to_pylist(), b.column("tfs").to_pylist(), stats)
                    yield b.append_column("at", pa.array(routed(unpack(packed_rows(x)), tree))) if tree is not None else pa.RecordBatch.from_arrays([packed_rows(x)], ["x"])

        return run

    some = items.where(F.pmod(F.xxhash64("doc_id", "piece", F.lit(3)), F.lit(1 << 24)) <= int(rows / n * (1 << 24))).select("terms", "tfs").limit(2 * SAMPLE)
    sample = unpack(some.mapInArrow(place(None), "x binary").toArrow().column(0))
    tree = bisect(sample, max(LEAST_SAMPLE, len(sample) / want))[0]
    placed = items.mapInArrow(place(tree), "doc_id bigint, piece int, start int, n_tokens int, terms binary, tfs binary, at bigint")
    large = {r["at"]: -(-r["count"] // (4 * GROUP * shard)) for r in placed.groupBy("at").count().where(f"count > {8 * GROUP * shard}").collect()}
    if not large:
        return placed
    salts = F.create_map(*[F.lit(x) for kv in large.items() for x in kv])[F.col("at")]
    return placed.withColumn("at", F.col("at") + (F.pmod(F.xxhash64("doc_id"), F.coalesce(salts, F.lit(1))) * (1 << 20)))


def pack(df: DataFrame, key: str, text_col: str, capacity: int = CAPACITY, tokenizer: str = TOKENIZER, shard: int = SHARD) -> DataFrame:
    """(container_id, place, doc_id, piece, start, n_tokens, used): every document in a container of at most ``capacity`` tokens.

    place counts from 0 within the container, start is the piece's first token, used the tokens in the container. Only a text above the capacity has several pieces. BM25's statistics are those of all items. Shards
    hold alike items, about ``shard`` at most whatever the size of the input, so a seed's neighbours are mostly in its own shard. A container that its shard could not fill is opened again, its
    items are packed once more with those of the shards next to it.
    Null and empty texts take a place and no room; an empty table gives an empty result.
    """
    items = cut(token_items(df, key, text_col, capacity, tokenizer))
    stats = item_stats(items)
    first = cut(_fill_groups(grouped(items, stats.n, stats, shard), capacity, stats, shard, True).withColumn("pass", F.lit(0)))
    done, rest = first.where(F.col("used") >= FULL * capacity), first.where(F.col("used") < FULL * capacity)
    # a row per shard, some thousandth of the items
    left = rest.groupBy("shard").count().orderBy("shard").toArrow()
    before = np.r_[0, np.cumsum(left.column(1).to_numpy())[:-1]] if left.num_rows else np.zeros(0, np.int64)
    names = left.column(0).to_numpy()[np.r_[True, np.diff(before // shard) > 0]] if left.num_rows else np.zeros(0, np.int64)

    def merged(batches):
        for b in batches:
            at = np.searchsorted(names, b.column(0).to_numpy(), "right").astype(np.int64) - 1
            yield pa.RecordBatch.from_arrays([pa.array(at), *b.columns[1:]], ["at", *b.schema.names[1:]])

    again = rest.select("shard", "doc_id", "piece", "start", "n_tokens", "terms", "tfs").mapInArrow(merged, "at bigint, doc_id bigint, piece int, start int, n_tokens int, terms binary, tfs binary")
    second = _fill_groups(again, capacity, stats, 2 * shard, False).withColumn("pass", F.lit(1))
    name = F.concat_ws("-", F.col("pass").cast("string"), F.col("shard").cast("string"), F.col("slot").cast("string")).alias("container_id")
    return done.unionByName(second).select(name, "place", "doc_id", "piece", "start", "n_tokens", "used")


def p6_containers(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"), "doc_id", "text")


QUERIES = {"p6_containers": p6_containers}
ORACLE: dict[str, str] = {}
