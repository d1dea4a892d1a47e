"""Subject areas of documents: bisecting k-means leaves, labelled by discriminative terms, mixed sentence by sentence."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, table
from .neighbours import coarse, unpack_coarse

DIMS = 256  # of the random projection of a document's tf-idf vector
RARE, COMMON = 0.0002, 0.2  # shares of the documents, and of those of any one language, that a term occurs in, at least and at most
LEAVES = 192
LEAST_LEAF = 12  # documents
SAMPLE = 8192  # documents that seed the halves of a leaf; every document then moves the centres
LABELLED = 20000  # labelled documents that leaves are named by, about, if there are more
SHARE = 0.2
TRUST = 0.25  # weight of a document's leaf beside the terms of a sentence

_FRONT = re.compile(r"\A﻿?\s*---[^\S\n]*\n.*?\n---[^\S\n]*(?:\n|\Z)", re.S)
_FENCE = re.compile(r"^[^\S\n]*(```|~~~).*?(?:^[^\S\n]*\1[^\n]*$|\Z)", re.S | re.M)
_BREAK = re.compile(r"<br\s*/?>|</p>|</li>|</div>", re.I)
_HEAD = re.compile(r"^[^\S\n]*(?:#{1,6}[^\S\n].*|<h[1-6][^>]*>.*?</h[1-6]>|[^\n]+\n(?:={3,}|-{3,})[^\S\n]*)$", re.M | re.I)
_TAG = re.compile(r"!\[[^\]\n]*\]\([^)\n]*\)|</?[a-zA-Z][^>\n]*>|https?://\S+")
_LINK = re.compile(r"\[([^\]\n]*)\]\([^)\n]*\)")
_ITEM = re.compile(r"\n[^\S\n]*\n|\n(?=[^\S\n]*(?:[-*+•>|]|\d+[.)])[^\S\n])")
# a question and its answer are one statement, so only a full stop or an exclamation ends one
_END = re.compile(r"(?<=[.!…。！])[\"'”’»)*_]*\s+|[。！]")
_WORD = re.compile(r"[^\W\d_]{3,}")


def body(text: str) -> str:
    """The running text: without frontmatter, code, headings, images, tags and link targets; in lower case."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    if "&" in text:
        text = text.replace("&quot;", '"').replace("&nbsp;", " ").replace("&lt;", "<").replace("&gt;", ">").replace("&amp;", "&")
    if "<" in text:
        text = _BREAK.sub("\n", text)
    if "Ã" in text or "â€" in text:
        text = _mended(text)
    text = _FRONT.sub("", text, count=1)
    text = _HEAD.sub("\n", _FENCE.sub("\n\n", text))
    return _LINK.sub(r"\1", _TAG.sub(" ", text)).lower()


def _mended(text: str) -> str:
    """Undo UTF-8 that was read as Latin-1 or Windows-1252, letter by letter where that works."""

    def one(m: re.Match) -> str:
        for kind in ("cp1252", "latin-1"):
            try:
                return m[0].encode(kind).decode("utf-8")
            except UnicodeError:
                pass
        return m[0]

    return re.sub(r"[Â-ß][\u0080-¿Œ-™]|â[\u0080-™]{2}", one, text)


def sentences(text: str) -> list[list[str]]:
    """The words, of three letters at least, of every sentence that has any."""
    out = []
    for block in _ITEM.split(body(text)):
        for s in _END.split(block):
            if s and (words := _WORD.findall(s)):
                out.append(words)
    return out


def _codes(words: list[str], memo: dict[str, int]) -> list[int]:
    out = []
    for w in words:
        c = memo.get(w)
        if c is None:
            if len(memo) > 2_000_000:
                memo.clear()
            c = memo[w] = zlib.crc32(w.encode("utf-8", "surrogatepass"))
        out.append(c)
    return out


READ = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("lens", pa.binary()), ("codes", pa.binary())])


def read_terms(df: DataFrame, key: str, text_col: str, lang_col: str | None = None) -> DataFrame:
    """(doc_id, lang, lens, codes): the number of terms of each sentence and the terms' codes, packed; whole texts."""

    def run(batches):
        memo: dict[str, int] = {}
        for b in batches:
            lens, codes = [], []
            for t in b.column(2).to_pylist():
                ss = sentences(t) if t else []
                lens.append(np.array([len(s) for s in ss], np.uint32).tobytes())
                codes.append(np.array(_codes([w for s in ss for w in s], memo), np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lens, pa.binary()), pa.array(codes, pa.binary())], schema=READ)

    lang = F.coalesce(F.lower(F.col(lang_col)), F.lit("")) if lang_col else F.lit("")
    return df.select(F.col(key).cast("long"), lang, text_col).where(F.col(key).isNotNull()).mapInArrow(run, "doc_id bigint, lang string, lens binary, codes binary")


def _flat(col) -> tuple[np.ndarray, np.ndarray]:
    """(all uint32 values, number of them in each row)"""
    off = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(col.buffers()[2], np.uint8)[off[0] : off[-1]] if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return raw.view(np.uint32), np.diff(off) // 4


def _doc_terms(col) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, code, tf) of the distinct terms of each document."""
    flat, n = _flat(col)
    pair = (np.repeat(np.arange(len(n), dtype=np.uint64), n) << np.uint64(32)) | flat.astype(np.uint64)
    u, tf = np.unique(pair, return_counts=True)
    return (u >> np.uint64(32)).astype(np.int64), (u & np.uint64(0xFFFFFFFF)).astype(np.uint32), tf


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, inv = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(inv, np.concatenate([v for _, v in parts]), minlength=len(keys))


def vocabulary(terms: DataFrame, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes, documents) of the terms that tell documents apart, ascending: not commoner than COMMON, overall or within a language, and in at least RARE of the documents of some language (and in 3).

    As a language has at most its documents' terms over RARE of them, the vocabulary's size is bounded by the number of languages, not of documents.
    """

    def run(batches):
        held: dict[str, list] = {}
        for b in batches:
            if b.num_rows:
                langs = b.column(0).to_pylist()
                row, code, _ = _doc_terms(b.column(1))
                names, at = np.unique(np.array(langs, dtype=object).astype(str), return_inverse=True)
                for i, name in enumerate(names):
                    part = held.setdefault(str(name), [])
                    part.append(np.unique(code[at[row] == i], return_counts=True))
                    if len(part) > 16:
                        held[str(name)] = [_summed(part)]
        for name, part in held.items():
            k, v = _summed(part)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(k), pa.string()), pa.array(k.astype(np.int64)), pa.array(v.astype(np.int64))], ["lang", "code", "df"])

    sizes = terms.groupBy("lang").agg(F.count("*").alias("docs"))
    each = terms.select("lang", "codes").mapInArrow(run, "lang string, code bigint, df bigint").groupBy("lang", "code").agg(F.sum("df").alias("df")).join(sizes, "lang")
    common = F.max((F.col("docs") >= 50) & (F.col("df") > COMMON * F.col("docs")))
    enough = F.max(F.col("df") >= F.greatest(F.lit(3), F.floor(RARE * F.col("docs"))))
    total = each.groupBy("code").agg(F.sum("df").alias("df"), common.alias("common"), enough.alias("enough"))
    kept = total.where(F.col("enough") & (F.col("df") <= max(3, COMMON * n_docs)) & ~F.col("common")).orderBy("code").toArrow()
    return kept.column(0).to_numpy().astype(np.uint32), kept.column(1).to_numpy()


def signs(codes: np.ndarray) -> np.ndarray:
    """A row of DIMS signs for each code, the same on every worker."""
    x = codes.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, DIMS // 64 + 1, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    for a, m in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(a))) * np.uint64(m)
    x ^= x >> np.uint64(31)
    return np.unpackbits(x.view(np.uint8), axis=1).astype(np.int8) * 2 - 1


def embed_docs(terms: DataFrame, vocab: np.ndarray, idf: np.ndarray) -> DataFrame:
    """(doc_id, lens, codes, v): with the projected, normalised tf-idf vector; null where no term counts."""
    shared = terms.sparkSession.sparkContext.broadcast((vocab, idf))

    def run(batches):
        vocab, idf = shared.value
        table_ = signs(vocab)
        for b in batches:
            if not b.num_rows:
                continue
            row, code, tf = _doc_terms(b.column(3))
            at = np.searchsorted(vocab, code)
            at[at == len(vocab)] = 0
            ok = vocab[at] == code if len(vocab) else np.zeros(len(code), bool)
            row, at, w = row[ok], at[ok], ((1 + np.log(tf[ok])) * idf[at[ok]]).astype(np.float32)
            x = np.zeros((b.num_rows, DIMS), np.float32)
            if len(row):
                starts = np.r_[0, np.flatnonzero(np.diff(row)) + 1]
                ends = np.r_[starts[1:], len(row)]
                for i, s, e in zip(row[starts], starts, ends):
                    x[i] = w[s:e] @ table_[at[s:e]]
            norm = np.linalg.norm(x, axis=1)
            packed = coarse(x)
            v = pa.array([p.tobytes() if n > 0 else None for p, n in zip(packed, norm)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), v], ["doc_id", "lens", "codes", "v"])

    return terms.mapInArrow(run, "doc_id bigint, lens binary, codes binary, v binary")


class Tree:
    """A tree of bisections: node 0 is the root; a split node has the centres of its two halves."""

    def __init__(self):
        self.split: dict[int, tuple[int, np.ndarray]] = {}  # node -> (first child, 2 x DIMS centres)
        self.next = 1

    def route(self, x: np.ndarray) -> np.ndarray:
        at, todo = np.zeros(len(x), np.int64), [0] if 0 in self.split else []
        while todo:
            node = todo.pop()
            child, c = self.split[node]
            mine = np.flatnonzero(at == node)
            if len(mine):
                at[mine] = child + (x[mine] @ c.T).argmax(axis=1)
                todo += [k for k in (child, child + 1) if k in self.split]
        return at


def _halves(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Two centres of a sample by 2-means on the sphere."""
    mean = x.mean(axis=0)
    away = x[(x @ mean).argmin()]
    c = np.stack([x[(x @ away).argmin()], away])
    for _ in range(8):
        side = (x @ c.T).argmax(axis=1)
        if side.min() == side.max():
            c = x[rng.choice(len(x), 2, replace=False)]
            continue
        c = np.stack([x[side == k].mean(axis=0) for k in (0, 1)])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c


def bisecting_kmeans(docs: DataFrame, leaves: int = LEAVES, least: int = LEAST_LEAF, lloyd: int = 2) -> tuple[Tree, dict[int, int]]:
    """(tree, {leaf: documents}): spherical bisecting k-means over all documents.

    A level splits its widest leaves at once. The halves are seeded from a bounded sample of documents; then every document takes part in Lloyd's rounds, one pass for all leaves.
    """
    sc = docs.sparkSession.sparkContext
    vectors = docs.select("v").where("v is not null")
    # thinned by hash to about the sample's size before the driver sees any of it
    share = int((1 << 30) * min(1.0, SAMPLE / max(1, docs.count())))
    got = docs.where(F.col("v").isNotNull() & (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share)).select("v").limit(2 * SAMPLE).toArrow()
    sample = unpack_coarse(got.column(0)) if got.num_rows else np.zeros((0, DIMS), np.float32)
    tree, rng = Tree(), np.random.default_rng(3)

    def passed(tree: Tree) -> dict[int, tuple[int, np.ndarray]]:
        shared = sc.broadcast(tree)

        def run(batches):
            sums: dict[int, list] = {}
            for b in batches:
                if b.num_rows:
                    x = unpack_coarse(b.column(0))
                    leaf = shared.value.route(x)
                    for k in np.unique(leaf):
                        m = x[leaf == k]
                        s = sums.setdefault(int(k), [0, np.zeros(DIMS)])
                        s[0] += len(m)
                        s[1] += m.sum(axis=0)
            ks = list(sums)
            yield pa.RecordBatch.from_arrays([pa.array(ks, pa.int64()), pa.array([sums[k][0] for k in ks], pa.int64()), pa.array([list(sums[k][1]) for k in ks], pa.list_(pa.float64()))], ["leaf", "n", "s"])

        each = vectors.mapInArrow(run, "leaf bigint, n bigint, s array<double>")

        def add(t: pa.Table) -> pa.Table:
            return pa.table({"leaf": t.column("leaf").slice(0, 1), "n": pa.array([int(np.sum(t.column("n").to_numpy()))]), "s": pa.array([np.stack(t.column("s").to_numpy()).sum(axis=0)], pa.list_(pa.float64()))})

        return {r.leaf: (r.n, np.array(r.s)) for r in each.groupBy("leaf").applyInArrow(lambda t: add(t), "leaf bigint, n bigint, s array<double>").collect()}

    sizes = passed(tree)
    while sizes and len(sizes) < leaves:
        at = tree.route(sample)
        # the looser and larger a leaf, the sooner it is halved: its inertia about its centre
        wide = sorted(((n - np.linalg.norm(s), k) for k, (n, s) in sizes.items() if n >= 2 * least and (at == k).sum() >= 4), reverse=True)[: leaves - len(sizes)]
        if not wide:
            break
        floor = wide[0][0] / 8
        fresh = [k for inertia, k in wide if inertia >= floor]
        for k in fresh:
            tree.split[k] = (tree.next, _halves(sample[at == k], rng).astype(np.float32))
            tree.next += 2
        for _ in range(lloyd):
            sizes = passed(tree)
            for k in fresh:
                child, c = tree.split[k]
                for j in (0, 1):
                    if child + j in sizes:
                        c[j] = sizes[child + j][1] / max(np.linalg.norm(sizes[child + j][1]), 1e-9)
    return tree, {k: n for k, (n, _) in sizes.items()}


def leaf_terms(docs: DataFrame, tree: Tree, vocab: np.ndarray) -> DataFrame:
    """(code, leaf, n): documents of each leaf that have the term, for the counted vocabulary."""
    shared = docs.sparkSession.sparkContext.broadcast((tree, vocab))

    def run(batches):
        tree, vocab = shared.value
        held: list = []
        for b in batches:
            if b.num_rows:
                leaf = tree.route(unpack_coarse(b.column(1)))
                row, code, _ = _doc_terms(b.column(0))
                at = np.minimum(np.searchsorted(vocab, code), max(len(vocab) - 1, 0))
                ok = vocab[at] == code
                held.append(np.unique((leaf[row[ok]] << 32) | code[ok].astype(np.int64), return_counts=True))
                if len(held) > 16:
                    held = [_summed(held)]
        if held:
            k, v = _summed(held)
            yield pa.RecordBatch.from_arrays([pa.array(k & 0xFFFFFFFF), pa.array((k >> 32).astype(np.int32)), pa.array(v.astype(np.int64))], ["code", "leaf", "n"])

    return docs.where("v is not null").select("codes", "v").mapInArrow(run, "code bigint, leaf int, n bigint").groupBy("code", "leaf").agg(F.sum("n").alias("n"))


def term_votes(subjects: list[tuple[str, str]], labelled: list[tuple[set[int], list[str]]]) -> tuple[dict[int, np.ndarray], np.ndarray]:
    """({term: weight of each subject}, prior): a labelled document votes with each of its terms for its subjects; a subject's description counts as two documents."""
    names = [s for s, _ in subjects]
    votes: dict[int, np.ndarray] = {}
    base = np.ones(len(names))
    for terms, subs in labelled:
        w = np.array([1.0 / len(subs) if s in subs else 0.0 for s in names])
        base += w
        for t in terms:
            votes.setdefault(t, np.zeros(len(names)))
            votes[t] += w
    for i, (name, descr) in enumerate(subjects):
        for w in set(_WORD.findall(f"{name} {descr}".lower())):
            votes.setdefault(zlib.crc32(w.encode()), np.zeros(len(names)))[i] += 2.0
    return votes, base / base.sum()


def label_leaves(counts: DataFrame, sizes: dict[int, int], votes: dict[int, np.ndarray], prior: np.ndarray, top: int = 60) -> dict[int, np.ndarray]:
    """{leaf: weight of each subject}: the leaf's discriminative terms vote. A leaf for which none speaks stays without a name (all weights 0).

    ``counts`` is (code, leaf, n); the terms are ranked where they are, and only the top ones of each leaf reach the driver.
    """
    spark = counts.sparkSession
    total = sum(sizes.values())
    size = spark.createDataFrame([(int(k), int(n)) for k, n in sizes.items()], "leaf int, size bigint")
    whole = counts.groupBy("code").agg(F.sum("n").alias("whole"))
    lift = F.log((F.col("n") + 0.5) / (F.col("size") + 1)) - F.log((F.col("whole") + 0.5) / (total + 1))
    gain = counts.join(whole, "code").join(F.broadcast(size), "leaf").select("leaf", "code", (F.col("n") * lift).alias("gain")).where("gain > 0")  # sizes has a row per leaf
    best = gain.withColumn("r", F.row_number().over(Window.partitionBy("leaf").orderBy(F.desc("gain"), "code"))).where(F.col("r") <= top)
    scores: dict[int, np.ndarray] = {k: np.zeros(len(prior)) for k in sizes}
    for r in best.collect():
        v = votes.get(int(r.code))
        if v is not None:
            scores[r.leaf] += r.gain * np.log((v + 2 * prior) / (v.sum() + 2) / prior) * (v.sum() / (v.sum() + 2))
    out = {}
    for k, score in scores.items():
        w = np.exp(6 * (score - score.max()) / max(np.abs(score).max(), 1e-9))
        out[k] = w / w.sum() if score.max() > 0 else np.zeros(len(prior))
    return out


def term_subjects(counts: DataFrame, sizes: dict[int, int], mixture: dict[int, np.ndarray], votes: dict[int, np.ndarray], least: float = 0.45, support: int = 3, trust: float = 2.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, subject, weight) of the terms that tell a subject: the mixture of the leaves they occur in, corrected by the labelled documents they occur in, favours one beyond its size."""
    n_subjects = len(next(iter(mixture.values())))
    rows = [(int(k), *[float(x) for x in m]) for k, m in mixture.items()]
    mixed = counts.sparkSession.createDataFrame(rows, "leaf int, " + ", ".join(f"m{i} double" for i in range(n_subjects)))
    # the mixture has a row per leaf
    sums = counts.join(F.broadcast(mixed), "leaf").groupBy("code").agg(F.sum("n").alias("n"), *[F.sum(F.col("n") * F.col(f"m{i}")).alias(f"s{i}") for i in range(n_subjects)]).toArrow()
    if not sums.num_rows:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0)
    order = np.argsort(sums.column("code").to_numpy())
    u, total = sums.column("code").to_numpy()[order], sums.column("n").to_numpy()[order]
    share = np.stack([sums.column(f"s{i}").to_numpy()[order] for i in range(n_subjects)], axis=1)
    prior = sum(m * sizes[k] for k, m in mixture.items())
    prior = prior / max(1e-9, prior.sum())
    seen = np.stack([votes.get(int(c), np.zeros(n_subjects)) for c in u])
    told = trust * share / total[:, None]  # leaves without a name tell nothing, then the labels alone speak
    p = (told + seen + prior) / (told.sum(axis=1) + seen.sum(axis=1) + 1)[:, None]
    best = p.argmax(axis=1)
    top = p[np.arange(len(u)), best]
    weight = np.log(np.maximum(top, 1e-9) / np.maximum(prior[best], 1e-9))
    ok = (top >= least) & (weight > np.log(2)) & (total >= support)
    return u[ok].astype(np.uint32), best[ok], weight[ok]


def leaf_priors(mixture: dict[int, np.ndarray], sizes: dict[int, int], trust: float = TRUST) -> dict[int, np.ndarray]:
    """{leaf: what the mixture of a leaf adds to the score of each subject in a sentence of its documents}: ``trust`` times the log of how much commoner the subject is there than in the corpus. An unnamed leaf adds nothing."""
    named = {k: m for k, m in mixture.items() if m.sum() > 0}
    if not named:
        return {}
    prior = sum(m * sizes[k] for k, m in named.items()) / sum(sizes[k] for k in named)
    prior = (prior + 0.01) / (prior + 0.01).sum()
    return {k: trust * np.log((0.9 * m + 0.1 * prior) / prior) for k, m in named.items()}


def sentence_subjects(lens, codes, words: tuple[np.ndarray, np.ndarray, np.ndarray], n_subjects: int, lean: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document row, subject or -1, terms that tell) of every sentence of a batch: the subject of the highest score, among those that a term of the sentence tells and whose score is positive.

    ``lean`` has a row per document, what its leaf's mixture adds to each subject.
    """
    n_terms, n_sent = _flat(lens)
    flat, _ = _flat(codes)
    doc = np.repeat(np.arange(len(n_sent)), n_sent)
    sent = np.repeat(np.arange(len(n_terms)), n_terms)
    vocab, subject, weight = words
    score = np.zeros((len(n_terms), n_subjects))
    if len(vocab):
        at = np.minimum(np.searchsorted(vocab, flat), len(vocab) - 1)
        ok = vocab[at] == flat
        np.add.at(score, (sent[ok], subject[at[ok]]), weight[at[ok]])
    if lean is not None:
        score = np.where(score > 0, score + lean[doc], 0)
    best = score.argmax(axis=1) if len(score) else np.zeros(0, np.int64)
    return doc, np.where(score[np.arange(len(score)), best] > 0, best, -1), sent


def refine(docs: DataFrame, words, n_subjects: int, vocab: np.ndarray, least: float = 0.5, support: int = 4, told_share: float = 0.05):
    """The terms once more, now by the sentences they stand in: a term tells a subject if the other terms of its sentences do."""
    shared = docs.sparkSession.sparkContext.broadcast((words, vocab))

    def run(batches):
        words, vocab = shared.value
        known, subject, weight = words
        held: list = []
        for b in batches:
            if not b.num_rows:
                continue
            n_terms, _ = _flat(b.column(0))
            flat, _ = _flat(b.column(1))
            sent = np.repeat(np.arange(len(n_terms)), n_terms)
            score = np.zeros((len(n_terms), n_subjects))
            own = np.zeros((len(flat), 2))
            own[:, 0] = -1
            if len(known):
                at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
                ok = known[at] == flat
                np.add.at(score, (sent[ok], subject[at[ok]]), weight[at[ok]])
                own[ok, 0], own[ok, 1] = subject[at[ok]], weight[at[ok]]
            in_vocab = np.minimum(np.searchsorted(vocab, flat), len(vocab) - 1)
            use = np.flatnonzero(vocab[in_vocab] == flat)
            rest = score[sent[use]]
            mine = np.flatnonzero(own[use, 0] >= 0)
            rest[mine, own[use[mine], 0].astype(int)] -= own[use[mine], 1]
            best = rest.argmax(axis=1) if len(rest) else np.zeros(0, np.int64)
            got = np.where(rest[np.arange(len(rest)), best] > 1e-6, best, n_subjects)
            held.append(np.unique((flat[use].astype(np.int64) << 31) | got, return_counts=True))
            if len(held) > 16:
                held = [_summed(held)]
        if held:
            k, v = _summed(held)
            yield pa.RecordBatch.from_arrays([pa.array(k >> 31), pa.array((k & 0x7FFFFFFF).astype(np.int32)), pa.array(v.astype(np.int64))], ["code", "s", "n"])

    got = docs.select("lens", "codes").mapInArrow(run, "code bigint, s int, n bigint").groupBy("code", "s").agg(F.sum("n").alias("n")).toArrow()
    code, s, n = (got.column(i).to_numpy() for i in range(3))
    u, inv = np.unique(code, return_inverse=True)
    share = np.zeros((len(u), n_subjects + 1))
    np.add.at(share, (inv, s), n)
    told = share[:, :n_subjects].sum(axis=1)
    best = share[:, :n_subjects].argmax(axis=1) if len(u) else np.zeros(0, np.int64)
    top = share[np.arange(len(u)), best]
    prior = share[:, :n_subjects].sum(axis=0) / max(1, share[:, :n_subjects].sum())
    purity = top / np.maximum(told, 1)
    ok = (top >= support) & (purity >= least) & (told >= told_share * share.sum(axis=1))
    return u[ok].astype(np.uint32), best[ok], np.log(np.maximum(purity[ok], 1e-9) / np.maximum(prior[best[ok]], 1e-9)).clip(0.1)


def subjects_of(df: DataFrame, areas: DataFrame, labels: DataFrame, key: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang", share: float = SHARE, leaves: int = LEAVES) -> DataFrame:
    """(key, subject, sentences, told): the subjects that at least ``share`` of a document's sentences deal with, with the number of its sentences and of those.

    ``areas`` (subject, descr) is a configuration, read to the driver; ``labels`` (key, subject) names the leaves, from at most LABELLED documents. The vocabulary has the terms of at least RARE of the documents,
    so its size is bounded by the terms of an average document over RARE, whatever their number; all
    counts are over all documents. A single sentence of a document that mostly deals with something else is a passing remark. Null, empty and stub texts, and
    texts of no listed subject, have no row; without labels the descriptions alone name the leaves.
    """
    subjects = [(r[0], r[1] or "") for r in areas.select("subject", "descr").where("subject is not null").distinct().orderBy("subject").collect()]
    schema = f"`{key}` bigint, subject string, sentences int, told int"
    terms = cut(read_terms(df, key, text_col, lang_col))
    n_docs = terms.count()
    if not n_docs or not subjects:
        return df.sparkSession.createDataFrame([], schema)
    vocab, dfs = vocabulary(terms, n_docs)
    if not len(vocab):
        return df.sparkSession.createDataFrame([], schema)
    docs = cut(embed_docs(terms, vocab, np.log(n_docs / dfs)))
    tree, sizes = bisecting_kmeans(docs, min(leaves, max(2, n_docs // (2 * LEAST_LEAF))))
    counts = cut(leaf_terms(docs, tree, vocab))
    marks = labels.select(F.col(key).cast("long").alias("doc_id"), "subject").dropna().distinct().groupBy("doc_id").agg(F.collect_list("subject").alias("s"))
    part = int((1 << 30) * min(1.0, LABELLED / max(1, marks.count())))
    known = docs.select("doc_id", "codes").join(marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < part), "doc_id").select("codes", "s").limit(2 * LABELLED).toArrow()
    in_vocab = set(vocab.tolist())
    labelled = [(set(np.frombuffer(c, np.uint32).tolist()) & in_vocab, s) for c, s in zip(known.column(0).to_pylist(), known.column(1).to_pylist())]
    votes, prior = term_votes(subjects, labelled)
    mixture = label_leaves(counts, sizes, votes, prior)
    words = term_subjects(counts, sizes, mixture, votes)
    for _ in range(2):
        words = refine(docs, words, len(subjects), vocab)
    shared = df.sparkSession.sparkContext.broadcast((words, [s for s, _ in subjects], tree, leaf_priors(mixture, sizes)))

    def run(batches):
        words, names, tree, leans = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            lean = np.zeros((b.num_rows, len(names)))
            placed = np.flatnonzero(b.column(3).is_valid().to_numpy(zero_copy_only=False))
            if len(placed) and leans:
                leaf = tree.route(unpack_coarse(b.column(3).take(pa.array(placed))))
                for k in np.unique(leaf):
                    if int(k) in leans:
                        lean[placed[leaf == k]] = leans[int(k)]
            doc, best, _ = sentence_subjects(b.column(1), b.column(2), words, len(names), lean)
            table_ = np.zeros((b.num_rows, len(names)), np.int64)
            told = best >= 0
            np.add.at(table_, (doc[told], best[told]), 1)
            total = np.bincount(doc, minlength=b.num_rows)
            r, s = np.nonzero((table_ > 0) & (table_ >= share * total[:, None] - 1e-9))
            n = table_[r, s]
            keep = (n >= 2) | (n == table_[r].max(axis=1))
            r, s, n = r[keep], s[keep], n[keep]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(r)), pa.array([names[i] for i in s], pa.string()), pa.array(total[r].astype(np.int32)), pa.array(n.astype(np.int32))], [key, "subject", "sentences", "told"])

    return docs.select("doc_id", "lens", "codes", "v").mapInArrow(run, schema)


def p8_subjects(spark, sf_dir):
    return subjects_of(table(spark, sf_dir, "documents"), table(spark, sf_dir, "subject_areas"), table(spark, sf_dir, "subject_labels"))


def p8_found(spark, sf_dir):
    return p8_subjects(spark, sf_dir).select("doc_id", "subject")


def p8_composition(spark, sf_dir):
    """(subject, documents, sentences): the make-up of the corpus."""
    return p8_subjects(spark, sf_dir).groupBy("subject").agg(F.count("*").alias("documents"), F.sum("told").alias("sentences"))


QUERIES = {"p8_found": p8_found, "p8_composition": p8_composition}
ORACLE: dict[str, str] = {}
