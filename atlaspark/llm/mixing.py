"""Mixing sources to target weights: token quotas, capped repeats, and a Pfair interleaving by earliest deadline first."""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, table
from .tokens import TOKENIZER, encode

BLOCK = 4096  # tokens of one scheduled block
PERIOD = 10000  # slots after which the schedule repeats, at least
LONGEST = 1 << 17  # its upper bound, and so that of the table that is broadcast


def slots_per_period(shares: list, period: int = PERIOD, longest: int = LONGEST) -> list[int]:
    """Whole numbers of slots in proportion to the shares, none less than one; they sum to the period's length.

    Shares with a common denominator of at most ``longest`` (all decimal ones of up to five places) are met exactly, so a schedule may repeat its period without end. Others are
    rounded by largest remainder, to less than a slot a period.
    """
    exact = [Fraction(str(s)) if isinstance(s, float) else Fraction(s) for s in shares]
    whole = sum(exact)
    parts = [x / whole for x in exact]
    common = math.lcm(*[x.denominator for x in parts])
    if common <= longest:
        return [int(x * common) for x in parts]
    period = min(longest, max(period, int(2 / min(parts)) + 1))
    slots = [max(1, int(x * period)) for x in parts]
    for i in sorted(range(len(parts)), key=lambda i: (int(parts[i] * period) - parts[i] * period, i)):
        if sum(slots) >= period:
            break
        slots[i] += 1
    return slots


def pfair(slots: list[int]) -> list[list[int]]:
    """For each source the slots of its blocks within one period.

    Block j of a source of weight w is released at floor(j / w) and due at ceil((j + 1) / w); each slot goes to the released block of the earliest deadline, ties
    to the earlier source. As the weights fill the period exactly every deadline is met, so no source is ever a whole block off its share.
    """
    period = sum(slots)
    out: list[list[int]] = [[] for _ in slots]
    waiting = [(0, i) for i in range(len(slots))]  # (release, source)
    ready: list[tuple[int, int]] = []  # (deadline, source)
    for t in range(period):
        while waiting and waiting[0][0] <= t:
            _, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(len(out[i]) + 1) * period // slots[i]), i))
        if ready:
            due, i = heapq.heappop(ready)
            assert t < due, "a deadline was missed"
            out[i].append(t)
            if len(out[i]) < slots[i]:
                heapq.heappush(waiting, (len(out[i]) * period // slots[i], i))
    return out


def count_tokens(df: DataFrame, key: str, text_col: str, *keep: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(key, *keep, n_tokens) by a public tokenizer, over the whole text; null and empty texts have 0."""
    kinds = dict(df.dtypes)

    def run(batches):
        for b in batches:
            n = pa.array([len(encode(t, tokenizer)) for t in b.column(0).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[1:], n], [*b.schema.names[1:], "n_tokens"])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (key, *keep)) + ", n_tokens bigint"
    return df.select(text_col, key, *keep).mapInArrow(run, schema)


def quotas_for(goals: dict[str, tuple[float, int]], have: dict[str, int], tokens: int | None) -> dict[str, int]:
    """{source: tokens to be used}. ``goals`` has (share, max_repeats) of each source that has tokens, ``have`` its tokens.

    Without ``tokens`` the corpus is the largest in which every source has its share. With it, a source that cannot fill its share of so many tokens gives all that its
    repeats allow and falls short; what it lacks is shared among the others by their weights, as far as their own repeats go.
    """
    most = {s: m * have[s] for s, (_, m) in goals.items()}
    share = {s: Fraction(str(w)) for s, (w, _) in goals.items()}
    whole = sum(share.values())
    if tokens is None:
        size = min(most[s] / (share[s] / whole) for s in goals)
        return {s: int(size * share[s] / whole) for s in goals}
    out, left, open_ = {}, Fraction(tokens), set(goals)
    while open_:
        level = left / sum(share[s] for s in open_)
        full = {s for s in open_ if most[s] <= level * share[s]}
        for s in full or open_:
            out[s] = most[s] if full else int(level * share[s])
            left -= out[s]
        open_ = open_ - full if full else set()
    return out


def mix(df: DataFrame, targets: DataFrame, key: str = "doc_id", text_col: str = "text", block: int = BLOCK, tokenizer: str = TOKENIZER, tokens: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(mix (slot, source, key, repeat_no, start, n_tokens, at), report).

    ``targets`` is (source, target_share, max_repeats), one row per source; a configuration, read to the driver. ``tokens`` is the corpus's size, by default the largest at which every
    source reaches its share (see ``quotas_for``). Each source runs through its documents in hash order, again from the first after the last, at most max_repeats times. This stream is cut into blocks of ``block``
    tokens, each of which takes one slot; a document that crosses a border comes out in several rows, tokens ``start`` to ``start + n_tokens`` in each, and the last block ends with the
    source's quota. So the sizes agree with the targets to a token a source, and at any slot no source is a whole block off its share (where shares have no common denominator of
    at most LONGEST, off by another slot for every LONGEST slots at most). ``slot`` orders the blocks, rows of one slot by ``at``, their place in the source.

    The report has a row per target with the tokens available, wanted and used, the share reached beside the target, the most repeats used, and whether the source was short of documents
    (``capped``). A source without tokens cannot take part: its share is 0 and the others are in proportion. Documents of no
    target source, or without tokens, are left out; nulls in targets drop the row.
    """
    spark = df.sparkSession
    goals = [r for r in targets.select("source", F.col("target_share").cast("double").alias("w"), "max_repeats").dropna().where("w > 0 and max_repeats > 0").groupBy("source").agg(F.max("w").alias("w"), F.max("max_repeats").alias("m")).orderBy("source").collect()]
    schema = f"source string, `{key}` {dict(df.dtypes)[key]}, repeat_no int, start bigint, n_tokens bigint, at bigint"
    wanted = df.where(F.col("source").isin([g.source for g in goals]) & F.col(key).isNotNull())
    sized = cut(count_tokens(wanted, key, text_col, "source", tokenizer=tokenizer).where("n_tokens > 0").select("source", key, "n_tokens"))
    have = {r.source: r for r in sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")).collect()}
    live = [g for g in goals if g.source in have]
    if not live:
        return spark.createDataFrame([], f"slot bigint, {schema}"), _report(spark, goals, have, {}, None, None)
    quota = quotas_for({g.source: (g.w, g.m) for g in live}, {s: r.tokens for s, r in have.items()}, tokens)
    live = [g for g in live if quota[g.source] > 0]
    short = tokens is not None and any(quota[g.source] == g.m * have[g.source].tokens for g in live)
    slots = slots_per_period([quota[g.source] if short else g.w for g in live])
    period = sum(slots)
    plan = spark.createDataFrame([(g.source, j, t) for g, ts in zip(live, pfair(slots)) for j, t in enumerate(ts)], "source string, j bigint, t bigint")
    quotas = spark.createDataFrame([(g.source, quota[g.source], int(have[g.source].tokens), int(n)) for g, n in zip(live, slots)], "source string, quota bigint, tokens bigint, per bigint")
    buckets = max(16, min(1 << 16, sum(h.docs for h in have.values()) // 2000))
    hashed = sized.withColumn("hash", F.xxhash64(key)).withColumn("bucket", F.pmod("hash", F.lit(buckets)))
    sums = hashed.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("n"))
    before = sums.withColumn("before", F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")).select("source", "bucket", "before")
    inside = F.sum("n_tokens").over(Window.partitionBy("source", "bucket").orderBy("hash", key).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n_tokens")
    placed = hashed.withColumn("inside", inside).join(before, ["source", "bucket"]).join(F.broadcast(quotas), "source")
    turns = placed.withColumn("repeat_no", F.explode(F.sequence(F.lit(0), F.expr("cast((quota - 1) div tokens as int)"))))
    first = turns.withColumn("first", F.col("before") + F.col("inside") + F.col("repeat_no") * F.col("tokens")).where("first < quota").withColumn("last", F.least(F.col("first") + F.col("n_tokens"), "quota"))
    each = first.withColumn("block", F.explode(F.sequence(F.expr(f"first div {block}"), F.expr(f"(last - 1) div {block}"))))
    at = each.withColumn("at", F.greatest("first", F.col("block") * block)).withColumn("j", F.pmod("block", F.col("per")))
    # the plan has at most LONGEST rows
    slotted = at.join(F.broadcast(plan), ["source", "j"]).withColumn("slot", F.expr("block div per") * period + F.col("t"))
    size = F.least("last", (F.col("block") + 1) * block) - F.col("at")
    out = slotted.select("slot", "source", key, "repeat_no", (F.col("at") - F.col("first")).alias("start"), size.alias("n_tokens"), "at")
    return out, _report(spark, goals, have, quota, out, tokens)


def _report(spark, goals, have, quota: dict[str, int], out: DataFrame | None, tokens: int | None) -> DataFrame:
    rows = []
    for g in goals:
        docs, available = (int(have[g.source].docs), int(have[g.source].tokens)) if g.source in have else (0, 0)
        rows.append((g.source, float(g.w), int(g.m), docs, available, int(quota.get(g.source, 0)), available == 0 or (tokens is not None and quota[g.source] == g.m * available)))
    base = spark.createDataFrame(rows, "source string, target_share double, max_repeats int, docs bigint, tokens_available bigint, tokens_wanted bigint, capped boolean")
    if out is None:
        return base.select("*", F.lit(0).cast("bigint").alias("tokens_used"), F.lit(0.0).alias("actual_share"), F.lit(0).alias("repeats_used"))
    used = out.groupBy("source").agg(F.sum("n_tokens").alias("tokens_used"), (F.max("repeat_no") + 1).alias("repeats_used"))
    # a row per target: the window's one task has no more
    joined = base.join(used, "source", "left").withColumn("all", F.sum("tokens_used").over(Window.partitionBy(F.lit(0))))
    return joined.select(*base.columns, F.coalesce("tokens_used", F.lit(0)).alias("tokens_used"), F.coalesce(F.col("tokens_used") / F.col("all"), F.lit(0.0)).alias("actual_share"), F.coalesce("repeats_used", F.lit(0)).alias("repeats_used"))


def p7_mix(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


def p7_shares(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


def p7_kept(spark, sf_dir):
    """(source, share_kept, repeats_kept) for each target source that has documents: whether it is within a token of its share of the corpus, and no document used too often."""
    r = p7_shares(spark, sf_dir).where("docs > 0")
    whole = r.withColumn("w", F.sum("target_share").over(Window.partitionBy(F.lit(0)))).withColumn("all", F.sum("tokens_used").over(Window.partitionBy(F.lit(0))))
    kept = F.abs(F.col("tokens_used") - F.col("all") * F.col("target_share") / F.col("w")) < F.count("*").over(Window.partitionBy(F.lit(0))) + 1
    return whole.select("source", kept.alias("share_kept"), (F.col("repeats_used") <= F.col("max_repeats")).alias("repeats_kept"))


QUERIES = {"p7_mix": p7_mix, "p7_shares": p7_shares, "p7_kept": p7_kept}
# a text of at least one character has at least one token
ORACLE = {"p7_kept": "SELECT DISTINCT source, true AS share_kept, true AS repeats_kept FROM documents JOIN mix_targets USING (source) WHERE target_share > 0 AND max_repeats > 0 AND length(text) > 0"}
