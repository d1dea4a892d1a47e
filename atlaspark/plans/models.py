"""Seams for models: cards, names of axes and regions, from any client, through a cache, with retries and usage totals.

A client is a function of a request (a dict of named texts) that returns a dict; it may have a ``usage`` entry with ``in`` and ``out`` tokens. It runs on the executors, so it must be picklable, or be made there by
a factory. Without a client (None) every name is the one that the numbers alone give.
"""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.regions import distinctive_axes, distinctive_terms, fallback_label, member_set_key, region_samples
from ..session import cut

ATTEMPTS, CONCURRENCY = 5, 12


class Refused(Exception):
    """An answer that no retry will change, such as a rejected key."""


class Busy(Exception):
    """A passing failure; ``after`` is how many seconds to wait, if the service said so."""

    def __init__(self, message: str = "", after: float | None = None):
        super().__init__(message)
        self.after = after


def with_retry(call: Callable, attempts: int = ATTEMPTS, first: float = 1.0, most: float = 60.0, sleep=time.sleep, rng=random.random):
    """call(), again after a passing failure: waits double, with jitter, and are never shorter than the service asks. ``Refused`` is not tried again."""
    for i in range(attempts):
        try:
            return call()
        except Refused:
            raise
        except Exception as e:  # noqa: BLE001 - whatever a client raises
            if i == attempts - 1:
                raise
            wait = min(most, first * 2**i * (0.5 + rng()))
            sleep(max(wait, getattr(e, "after", None) or 0))


def prompt_version(*texts: str) -> str:
    """A short hash of the prompt's texts, part of every cache key: another prompt, another answer."""
    import hashlib

    return hashlib.sha256("\x00".join(texts).encode()).hexdigest()[:12]


def asked_through_cache(requests: DataFrame, key: str, fields: list[str], client, cache: DataFrame | None = None, version: str = "", attempts: int = ATTEMPTS, parallel: int = CONCURRENCY, sleep=time.sleep) -> tuple[DataFrame, DataFrame, dict]:
    """((key, k, answer as JSON), new cache entries (k, v), usage): what the client says to each row's fields, each distinct request asked once and only if the cache (k, v) lacks it.

    At most ``parallel`` tasks ask at a time. A request that fails after its retries has a null answer, and is counted in usage; if all fail that is an error, and so is a refusal.
    """
    keyed = requests.select(key, F.sha2(F.to_json(F.struct(F.lit(version).alias("_v"), *fields)), 256).alias("k"), *fields)
    todo = keyed.drop(key).dropDuplicates(["k"])
    todo = todo.join(cache.select("k"), "k", "left_anti") if cache is not None else todo

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.to_dict("records"):
                try:
                    got = with_retry(lambda r=r: client({f: r[f] for f in fields}), attempts, sleep=sleep)
                    use = got.pop("usage", None) or {}
                    rows.append((r["k"], json.dumps(got, ensure_ascii=False, sort_keys=True), int(use.get("in", 0)), int(use.get("out", 0)), None))
                except Refused:
                    raise
                except Exception as e:  # noqa: BLE001 - counted below
                    rows.append((r["k"], None, 0, 0, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["k", "v", "tokens_in", "tokens_out", "error"])

    asked = cut(todo.repartition(parallel, "k").mapInPandas(run, "k string, v string, tokens_in bigint, tokens_out bigint, error string"))
    u = asked.agg(F.count("*").alias("calls"), F.count("error").alias("failed"), F.coalesce(F.sum("tokens_in"), F.lit(0)).alias("tokens_in"), F.coalesce(F.sum("tokens_out"), F.lit(0)).alias("tokens_out"), F.min("error").alias("error")).first().asDict()
    if u["calls"] and u["failed"] == u["calls"]:
        raise RuntimeError(f"every request failed, the first by {u['error']}")
    fresh = asked.where("v is not null").select("k", "v")
    have = fresh.unionByName(cache.select("k", "v")) if cache is not None else fresh
    return keyed.select(key, "k").join(have, "k", "left").select(key, "k", F.col("v").alias("answer")), fresh, u


def usage_totals(*usages: dict) -> dict:
    return {k: sum(u.get(k) or 0 for u in usages) for k in ("calls", "failed", "tokens_in", "tokens_out")}


def axis_lines(axes: list) -> str:
    """The axes as a card's request lists them, one numbered line each."""
    return "\n".join(f'{i + 1}. {a.name}: low="{a.low or ""}" high="{a.high or ""}"' for i, a in enumerate(axes))


CARD_PROMPT = "Restate the document in its own terms, and place it on each axis."


def card_deck(docs: DataFrame, axes: DataFrame, client, cache: DataFrame | None = None, prompt: str = CARD_PROMPT, key: str = "node_id", **how) -> tuple[DataFrame, DataFrame, dict]:
    """(cards (key, core, notes), new cache entries, usage) from a client that answers {"core", "notes": {axis key: text}}.

    The cache key holds the prompt, the document and the axes' numbers and variances, not their names: naming axes anew leaves the cards as they are. A document whose request failed has no card.
    """
    known = axes.orderBy("pc").collect()
    numbers = ";".join(f"{a.pc}:{a.variance}" for a in known)
    lines = axis_lines([a for a in known]) if known and "name" in known[0].asDict() else numbers
    named = client and (lambda r: client({**r, "axes": lines}))
    ask, fresh, use = asked_through_cache(docs.select(key, F.coalesce("title", F.lit("")).alias("title"), F.coalesce("body", F.lit("")).alias("body")), key, ["title", "body"], named, cache, prompt_version(prompt, numbers), **how)
    got = F.from_json("answer", "core string, notes map<string,string>")
    cards = ask.where("answer is not null").select(key, F.coalesce(got["core"], F.lit("")).alias("core"), F.coalesce(got["notes"], F.create_map().cast("map<string,string>")).alias("notes"))
    return cards, fresh, use


def name_axes(axes: DataFrame, poles: DataFrame, client=None, prompt: str = "Name every axis and its poles.") -> DataFrame:
    """The axes (pc, key, ..) with name, low, high, coherence: all named in one call on the driver, from the titles at their ends; what is not named is PCn, of coherence 3.

    ``poles`` is (pc, pole, place, title), some titles for each of at most 16 axes. The client answers {"axes": [{"pc", "name", "low", "high", "coherence"}]}.
    """
    spark = axes.sparkSession
    known = axes.orderBy("pc").collect()
    told: dict[int, dict] = {}
    if client:
        ends: dict = {}
        for r in poles.orderBy("pc", "pole", "place").collect():
            ends.setdefault((r.pc, r.pole), []).append(r.title or "")
        text = "\n".join(f"{a.pc}. low: {'; '.join(ends.get((a.pc, 'low'), []))} | high: {'; '.join(ends.get((a.pc, 'high'), []))}" for a in known)
        answer = with_retry(lambda: client({"prompt": prompt, "axes": text}))
        told = {int(x["pc"]): x for x in answer.get("axes", []) if x.get("name")}
    rows = [(a.pc, told.get(a.pc, {}).get("name", f"PC{a.pc}"), told.get(a.pc, {}).get("low", ""), told.get(a.pc, {}).get("high", ""), int(told.get(a.pc, {}).get("coherence", 3))) for a in known]
    return axes.drop("name", "low", "high", "coherence").join(spark.createDataFrame(rows, "pc int, name string, low string, high string, coherence int"), "pc")


def name_regions(ladder: DataFrame, cards: DataFrame, scores: DataFrame, client=None, cache: DataFrame | None = None, prompt: str = "Name the region by what sets it apart.", key: str = "node_id", **how) -> tuple[DataFrame, DataFrame | None, dict]:
    """(regions (level, region, n, label, blurb, terms), new cache entries, usage).

    Every set of members is named once, however many levels it stands on, from its distinctive terms, its extreme axes and 12 sample members; ``cards`` is (key, title, core), ``scores`` (key, pc,
    score). Where the client has no name, or there is none, the two best terms make one. The client answers {"label", "blurb"}.
    """
    groups = ladder.select(key, F.struct("level", "region").alias("g"))
    sets = cut(member_set_key(groups, key, "g"))
    once_ = sets.groupBy("members_key").agg(F.min("g").alias("g"))
    one = cut(groups.join(once_, "g").select(key, "members_key"))
    terms = cut(distinctive_terms(cards, one, key, "core", "members_key"))
    listed = terms.groupBy("members_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "term"))), lambda x: x["term"]).alias("terms"))
    named = once_.select("members_key").join(listed, "members_key", "left").join(fallback_label(terms, "members_key"), "members_key", "left")
    named = named.select("members_key", F.coalesce("terms", F.array().cast("array<string>")).alias("terms"), F.coalesce("label", F.lit("region")).alias("plain"))
    fresh, use = None, {}
    if client:
        axes = distinctive_axes(scores, one, key, "members_key").groupBy("members_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "pc", "pole", "mean"))), lambda a: F.concat(F.lit("pc"), a["pc"], F.lit(": toward "), a["pole"], F.lit(" ("), a["mean"], F.lit("/100)"))), "; ").alias("axes"))
        texts = region_samples(one.join(cards, key), "members_key", key, "title", "core")
        asks = named.join(axes, "members_key", "left").join(texts, "members_key", "left").select("members_key", F.array_join("terms", ", ").alias("terms"), F.coalesce("axes", F.lit("")).alias("axes"), F.coalesce("samples", F.lit("")).alias("samples"))
        answers, fresh, use = asked_through_cache(asks, "members_key", ["terms", "axes", "samples"], client, cache, prompt_version(prompt), **how)
        told = F.from_json("answer", "label string, blurb string")
        named = named.join(answers.select("members_key", told["label"].alias("label"), told["blurb"].alias("blurb")), "members_key", "left")
    else:
        named = named.withColumn("label", F.lit(None).cast("string")).withColumn("blurb", F.lit(None).cast("string"))
    full = sets.join(named, "members_key").select("g.level", "g.region", "n", F.coalesce(F.when(F.col("label") != "", F.col("label")), F.col("plain")).alias("label"), F.coalesce("blurb", F.lit("")).alias("blurb"), "terms")
    return full, fresh, use


def relabel(tables: dict[str, DataFrame], client=None, cache: DataFrame | None = None, **how) -> dict[str, DataFrame]:
    """A map with its regions named anew; everything else stays, and so do the regions' centres. The default grain becomes the level nearest to 18 regions."""
    from ..operators.linear import regrained

    cards = tables["cards"].select("node_id", "core").join(tables["nodes"].select("node_id", "title"), "node_id")
    regions, _, _ = name_regions(tables["ladder"], cards, tables["axis_scores"].select("node_id", "pc", "score"), client, cache, **how)
    kept = [c for c in tables["regions"].columns if c in ("level", "region", "cx", "cy")]
    levels = tables["levels"]
    counts = [r[0] for r in levels.select("count").orderBy("level").collect()]
    levels = levels.withColumn("is_default", F.col("level") == regrained(counts))
    return {**tables, "regions": regions.join(tables["regions"].select(*kept), ["level", "region"], "left"), "levels": levels}
