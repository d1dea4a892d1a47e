"""Cutting oversized texts into pieces at natural boundaries, by balanced targets."""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import once, table

LIMIT, OVERLAP = 1200, 120
# How strongly each kind of boundary pulls a target; the cut lies at the end of the match.
BOUNDARIES = ((3, re.compile(r"\n[^\S\n]*\n\s*|\r\n[^\S\r\n]*\r\n\s*")), (2, re.compile(r"[.!?…。！？]+[\"'”’»)\]]*\s+|[。！？]|\n+")), (1, re.compile(r"\s+")))


def _cuts(text: str) -> dict[int, int]:
    strength: dict[int, int] = {}
    for s, pattern in BOUNDARIES:
        for m in pattern.finditer(text):
            strength.setdefault(m.end(), s)
    strength.pop(len(text), None)
    return strength


def _snap(target: float, lo: int, hi: int, at: list[list[int]], window: int) -> int:
    """The strongest boundary within the window round target, the nearest of those; beyond the window the nearest of any kind; else a hard cut."""
    from bisect import bisect_left

    def nearest(xs: list[int], a: float, b: float) -> int | None:
        i, found = bisect_left(xs, target), []
        for k in (i - 1, i):
            if 0 <= k < len(xs) and a <= xs[k] <= b:
                found.append(xs[k])
        return min(found, key=lambda x: abs(x - target)) if found else None

    for xs in at:
        if (x := nearest(xs, max(lo, target - window), min(hi, target + window))) is not None:
            return x
    for xs in at:
        if (x := nearest(xs, lo, hi)) is not None:
            return x
        if xs and (i := bisect_left(xs, hi + 1)) and lo <= xs[i - 1] <= hi:
            return xs[i - 1]
    return int(min(max(target, lo), hi))


def _overlap_start(cut: int, floor: int, overlap: int, at: list[list[int]]) -> int:
    """Where the next piece begins: about overlap characters before the cut, at a word's start if there is one near."""
    from bisect import bisect_left

    want = max(floor, cut - overlap)
    words = at[-1]
    i = bisect_left(words, want)
    near = [x for x in words[max(0, i - 1) : i + 1] if floor <= x < cut and abs(x - want) <= overlap // 2 and cut - x <= overlap + overlap // 4]
    return min(near, key=lambda x: abs(x - want)) if near else want


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int]]:
    """[(start, body_start, end)]: the pieces of text in order, at most ``limit`` code points each.

    The pieces' bodies, text[body_start:end], follow each other without gap, so the text is their concatenation; text[start:body_start] repeats the
    end of the piece before. The count is the least that the limit allows; if no placing of the targets keeps
    every piece within the limit, it is raised by one. A text within the limit is one piece, an empty one none.
    """
    n = len(text)
    if n == 0:
        return []
    if n <= limit:
        return [(0, 0, n)]
    if not 0 <= overlap < limit / 2:
        raise ValueError("overlap must be less than half the limit")
    strength = _cuts(text)
    at = [sorted(k for k, s in strength.items() if s >= level) for level in (3, 2, 1)]
    slack = overlap + overlap // 4  # the most that an overlap can take
    k = max(2, math.ceil((n - overlap) / (limit - overlap)))
    while True:
        cuts, ok, start = [], True, 0
        for j in range(1, k):
            prev = cuts[-1] if cuts else 0
            target = prev + (n - prev) / (k - j + 1)
            hi = min(n - 1, start + limit)
            lo = min(hi, max(prev + 1, n - (k - j) * (limit - overlap)))
            cut = _snap(min(target, hi), lo, hi, at, max(1, limit // 8))
            cuts.append(cut)
            start = _overlap_start(cut, prev, overlap, at)
            if n - start > limit and j == k - 1:
                ok = False
        if ok:
            bounds = [0, *cuts, n]
            out = [(0 if i == 0 else _overlap_start(a, bounds[i - 1], overlap, at), a, b) for i, (a, b) in enumerate(zip(bounds, bounds[1:]))]
            if all(0 < e - s <= limit and b < e for s, b, e in out):
                return out
        k += 1
        if k > 2 * math.ceil(n / (limit - slack)) + 2:  # hard cuts always fit
            step, bounds = limit - overlap, list(range(0, n, limit - overlap))
            return [(max(0, b - overlap), b, min(n, b + step)) for b in bounds]


def split_oversized(df: DataFrame, key: str, text_col: str, limit: int = LIMIT, overlap: int = OVERLAP, only_long: bool = True) -> DataFrame:
    """(key, piece_no, n_pieces, start, body_start, end, piece) for every text longer than limit; with only_long=False for all texts.

    Positions are code points of the text as stored. Null and empty texts give no row. The length test runs before any text reaches Python, no shuffle
    takes place, and a text is always cut as a whole, never by a prefix.
    """
    src = df.select(F.col(key).alias("_k"), F.col(text_col).alias("_t")).where(F.length("_t") > (limit if only_long else 0))

    def run(batches):
        for pdf in batches:
            rows = []
            for k, t in zip(pdf["_k"], pdf["_t"]):
                ps = split_text(t, limit, overlap)
                rows += [(k, i, len(ps), s, b, e, t[s:e]) for i, (s, b, e) in enumerate(ps)]
            yield pd.DataFrame(rows, columns=[key, "piece_no", "n_pieces", "start", "body_start", "end", "piece"])

    kind = dict(src.dtypes)["_k"]
    return src.mapInPandas(run, f"`{key}` {kind}, piece_no int, n_pieces int, start int, body_start int, end int, piece string")


def _docs(spark, sf_dir):
    """The long texts, once: what is within the limit does not move."""
    return once(table(spark, sf_dir, "docs").select("node_id", "cores").where(F.length("cores") > LIMIT), "node_id")


def p5_pieces(spark, sf_dir):
    return split_oversized(_docs(spark, sf_dir), "node_id", "cores")


def p5_found(spark, sf_dir):
    """The nodes that the splitter had to cut."""
    return p5_pieces(spark, sf_dir).where("piece_no = 0").select("node_id")


def p5_joined(spark, sf_dir):
    """(node_id, digest, longest_ok): each text put together again from its pieces, without what they repeat, and whether all pieces are within the limit."""
    own = F.substring(F.col("piece"), F.col("body_start") - F.col("start") + 1, F.col("end") - F.col("body_start"))
    parts = p5_pieces(spark, sf_dir).groupBy("node_id").agg(F.array_sort(F.collect_list(F.struct("piece_no", own.alias("t")))).alias("p"), (F.max(F.length("piece")) <= LIMIT).alias("longest_ok"))
    return parts.select("node_id", F.md5(F.array_join(F.transform("p", lambda x: x["t"]), "")).alias("digest"), "longest_ok")


QUERIES = {"p5_found": p5_found, "p5_pieces": p5_pieces, "p5_joined": p5_joined}
ORACLE = {
    "p5_found": "SELECT DISTINCT node_id FROM docs WHERE length(cores) > 1200",
    "p5_joined": "SELECT DISTINCT node_id, md5(cores) AS digest, true AS longest_ok FROM docs WHERE length(cores) > 1200",
}
