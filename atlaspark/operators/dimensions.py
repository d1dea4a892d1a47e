"""Dimensions, the channels they are shown on, and views that can be named, stored and restored."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codecs import decode_ids, encode_ids
from .rank import min_max100, rank100

CHANNELS = ("color", "size", "x", "y", "z", "scrub", "sort")
# What the channels hold on a new map, and what they fall back to when their dimension goes; x, y and z take the first axes.
INITIAL = {"color": "region", "size": "hub", "scrub": "", "sort": "hub"}
RELEASE = {"color": "region", "size": "uniform", "scrub": "", "sort": "hub"}
SENTINELS = {"region", "uniform", "hub", ""}
URL_SET = 1800  # characters of an id set that an address may carry


@dataclass(frozen=True)
class Dimension:
    """One value per node: a scalar, a time or a category. ``column`` names where it lies in the node table."""

    key: str
    label: str
    kind: str  # 'scalar', 'temporal', 'boolean', 'categorical'
    column: str
    source: str  # 'axis', 'meta', 'query', 'derived'
    multi: bool = False
    low: str = ""
    high: str = ""
    norm: str = "honest"  # or 'rank'
    invert: bool = False

    def poles(self) -> tuple[str, str]:
        """What the low and the high end stand for; inverted they change places."""
        return (self.high, self.low) if self.invert else (self.low, self.high)

    def scores(self, nodes: DataFrame, key: str = "node_id", out: str = "score") -> DataFrame:
        """(key, score): 0..100 over all nodes, by value or by rank, missing ones 50; inverted 100 less."""
        base = nodes.select(key, F.col(f"`{self.column}`").cast("double").alias("_v"))
        s = (rank100(base, "_v", key) if self.norm == "rank" else min_max100(base, "_v")).select(key, F.col("score").alias("_s"))
        return s.select(key, (100 - F.col("_s") if self.invert else F.col("_s")).alias(out))


class Registry:
    """The dimensions of a map in their order: axes, scalar fields, categorical fields, queries, derived ones. Keys are unique; a later field of a taken key gets ``·col``."""

    def __init__(self, axes: list[Dimension] = (), fields: list[Dimension] = (), queries: list[Dimension] = (), derived: list[Dimension] = ()):
        self.dims: dict[str, Dimension] = {}
        plain = [d for d in fields if d.kind != "categorical"] + [d for d in fields if d.kind == "categorical"]
        for d in [*axes, *plain, *queries, *derived]:
            while d.key in self.dims:
                d = replace(d, key=d.key + "·col")
            self.dims[d.key] = d

    def __contains__(self, key: str) -> bool:
        return key in self.dims

    def __getitem__(self, key: str) -> Dimension:
        return self.dims[key]

    def __iter__(self):
        return iter(self.dims.values())

    def add(self, d: Dimension) -> Registry:
        return self._of([*self.dims.values(), d])

    def without(self, key: str) -> Registry:
        return self._of([d for d in self.dims.values() if d.key != key])

    def tuned(self, key: str, norm: str | None = None, invert: bool | None = None) -> Registry:
        d = self.dims[key]
        return self._of([replace(x, norm=norm or d.norm, invert=d.invert if invert is None else invert) if x.key == key else x for x in self.dims.values()])

    @staticmethod
    def _of(dims: list[Dimension]) -> Registry:
        out = Registry()
        out.dims = {d.key: d for d in dims}
        return out

    def window_field(self) -> str:
        """What a window opens on: a time, else a scalar of the metadata, else the first scalar; '' where there is none."""
        ordered = [d for d in self if d.kind != "categorical"]
        for test in (lambda d: d.kind == "temporal", lambda d: d.source == "meta", lambda d: True):
            for d in ordered:
                if test(d):
                    return d.key
        return ""


def registry(axes: DataFrame, manifest: DataFrame, queries: list[tuple[str, str]] = (), derived: list[tuple[str, str]] = ()) -> Registry:
    """The registry of a map from its axes (pc, key, name, low, high) and manifest (key, label, type, multi, source); a configuration, read to the driver. Queries and derived dimensions are (key, label)."""
    named = [Dimension(r.key, r.name, "scalar", f"axis_{r.key}", "axis", low=r.low or "", high=r.high or "") for r in axes.orderBy("pc").collect()]
    fields = [Dimension(r.key, r.label, r.type, r.key, "meta", bool(r.multi)) for r in manifest.where("source not like 'axis:%'").orderBy("ord", "key").collect()]
    extra = [[Dimension(k, label, "scalar", k, source) for k, label in rows] for rows, source in ((queries, "query"), (derived, "derived"))]
    return Registry(named, fields, *extra)


def relative_weights(axes: DataFrame) -> DataFrame:
    """The axes with ``weight``, their variance relative to the strongest one's."""
    top = axes.agg(F.max("variance").alias("_top"))  # one row
    return axes.crossJoin(F.broadcast(top)).withColumn("weight", F.round(F.col("variance") / F.nullif("_top", F.lit(0.0)), 4)).drop("_top")


def point_size(score: Column, bipolar: bool) -> Column:
    """Radius of a point: by the distance from the middle for a two-sided dimension, by the score for a one-sided one."""
    return 1.5 + 3 * F.abs(score - 50) / 50 if bipolar else 1.5 + 3.4 * score / 100


def position(score: Column) -> Column:
    """A score as a coordinate in -1..1."""
    return score / 50 - 1


@dataclass(frozen=True)
class Channels:
    """Which dimension each channel shows. Every change gives new channels."""

    registry: Registry
    held: dict = field(default_factory=dict)

    def _axes(self) -> dict:
        keys = [d.key for d in self.registry if d.source == "axis"]
        return {c: keys[i] if i < len(keys) else keys[0] if keys else "" for i, c in enumerate(("x", "y", "z"))}

    def get(self, channel: str) -> str:
        return self.held.get(channel, {**INITIAL, **self._axes()}[channel])

    def set(self, channel: str, key: str) -> Channels:
        if channel not in CHANNELS:
            raise KeyError(channel)
        if key not in self.registry and key not in SENTINELS:
            raise KeyError(f"no dimension {key}")
        return replace(self, held={**self.held, channel: key})

    def removed(self, key: str) -> tuple[Channels, bool]:
        """(channels without the dimension, whether the window went with it): a channel that showed it falls back."""
        after = Channels(self.registry.without(key))
        back = {**RELEASE, **after._axes()}
        held = {c: back[c] if self.get(c) == key else self.get(c) for c in CHANNELS}
        return replace(after, held=held), self.get("scrub") == key

    def frame(self, nodes: DataFrame, key: str = "node_id") -> DataFrame:
        """(key, color, size, x, y, z): what a drawing of the nodes needs. Colour is a region's number, a category or a score; without a dimension size is 1.5 and a coordinate 0."""
        out = nodes.select(key)
        for c in ("color", "size", "x", "y", "z"):
            k = self.get(c)
            if k in self.registry and self.registry[k].kind != "categorical":
                d = self.registry[k]
                s = F.col("_s")
                shown = s if c == "color" else point_size(s, d.source in ("axis", "derived")) if c == "size" else position(s)
                out = out.join(d.scores(nodes, key, "_s"), key).withColumn(c, F.round(shown, 6)).drop("_s")
            elif c == "color" and (k in self.registry or k in nodes.columns):
                col = F.col(f"`{self.registry[k].column if k in self.registry else k}`")
                out = out.join(nodes.select(key, (F.get(col, F.lit(0)) if dict(nodes.dtypes).get(k, "").startswith("array") else col).alias(c)), key)
            elif c == "size" and k == "hub" and "hub" in nodes.columns:
                out = out.join(min_max100(nodes.select(key, "hub"), "hub").select(key, F.round(point_size(F.col("score"), False), 6).alias(c)), key)
            else:
                out = out.withColumn(c, F.lit(None if c == "color" else 1.5 if c == "size" else 0.0))
        return out


def snapshot(channels: Channels, grain: int = 0, window: tuple | None = None, region: int | None = None, facet: str | None = None, find: str = "", queries: list[str] = (), derived: list[dict] = (), selection: list[str] = (), **rest) -> dict:
    """A view as a plain object: what is not at its default. Selections and derived dimensions name their examples in full."""
    props = {d.key: {"norm": d.norm, "invert": d.invert} for d in channels.registry if d.norm != "honest" or d.invert}
    state = {
        "channels": {c: channels.held[c] for c in CHANNELS if c in channels.held}, "grain": grain, "dimProps": props, "window": {k: v for k, v in zip(("lo", "hi"), window or ()) if v is not None}, "region": region,
        "facet": facet, "find": find, "queries": list(queries), "derived": list(derived), "selection": list(selection), **rest,
    }
    return {k: v for k, v in state.items() if v not in (None, "", {}, [], False)}


def restore(state: dict, registry_: Registry) -> tuple[Channels, dict, list[str]]:
    """(channels, what else the view has, names of the dimensions that are gone): a stored view on a map, after a reset, so nothing of the view before stays.

    A channel of a missing dimension keeps its default, and so does the window if it was on one.
    """
    gone, reg = [], registry_
    for key, p in state.get("dimProps", {}).items():
        if key in reg:
            reg = reg.tuned(key, p.get("norm"), p.get("invert"))
        else:
            gone.append(key)
    channels, rest = Channels(reg), {k: v for k, v in state.items() if k not in ("channels", "dimProps")}
    for c, key in state.get("channels", {}).items():
        if key in reg or key in SENTINELS:
            channels = channels.set(c, key)
        else:
            gone.append(key)
            if c == "scrub":
                rest.pop("window", None)
    return channels, rest, sorted(set(gone))


def to_address(state: dict, ids: list[str]) -> str:
    """The view as an address's query: the selection as an id set, left out where it is longer than URL_SET."""
    from urllib.parse import quote

    flat = {k: v for k, v in state.items() if k != "selection"}
    at = {k: i for i, k in enumerate(ids)}
    held = encode_ids([at[x] for x in state.get("selection", []) if x in at], ids) if state.get("selection") else ""
    return "view=" + quote(json.dumps(flat, ensure_ascii=False, separators=(",", ":"))) + (f"&sel={quote(held)}" if held and len(held) <= URL_SET else "")


def from_address(text: str, ids: list[str]) -> dict:
    """The view of an address; a selection of another corpus, or a broken one, is dropped as a whole."""
    from urllib.parse import parse_qs

    q = parse_qs(text)
    try:
        state = json.loads(q["view"][0]) if "view" in q else {}
    except ValueError:
        state = {}
    held = decode_ids(q["sel"][0], ids) if "sel" in q else None
    return {**state, "selection": [ids[i] for i in held]} if held else state


def save_view(views: DataFrame | None, spark, name: str, created_ms: int, state: dict) -> DataFrame:
    """The saved views (name, created_ms, state) with one more; one of the same name is replaced."""
    one = spark.createDataFrame([(name, created_ms, json.dumps(state, ensure_ascii=False))], "name string, created_ms bigint, state string")
    return one if views is None else views.where(F.col("name") != name).unionByName(one)


def open_view(views: DataFrame, name: str, registry_: Registry) -> tuple[Channels, dict, list[str]]:
    row = views.where(F.col("name") == name).orderBy(F.desc("created_ms")).first()
    if row is None:
        raise KeyError(name)
    return restore(json.loads(row.state), registry_)
