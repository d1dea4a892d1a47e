"""The single-file form of a map: a gzipped container of one JSON header and aligned typed buffers.

Layout: 8 bytes of magic, the header's length as a little-endian u32, the header, zeros up to a multiple of 4, then the buffers, each 4-byte aligned, as the header's
``buffers`` list says. A file is for one viewer and so bounded by what one machine shows; tables of any size are written with ``write_map``.
"""

from __future__ import annotations

import gzip
import json
import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession

MAGIC = b"ATLASMP1"
# The buffer types of the format.
TYPES = {"f32": "<f4", "i32": "<i4", "f16": "<f2", "u8": "u1", "f64": "<f8"}


def encode_container(meta: dict, buffers: dict[str, tuple[str, np.ndarray]], magic: bytes = MAGIC) -> bytes:
    specs, body, at = [], [], 0
    for key, (kind, values) in buffers.items():
        raw = np.ascontiguousarray(values, TYPES[kind]).tobytes()
        specs.append({"key": key, "type": kind, "length": len(raw) // np.dtype(TYPES[kind]).itemsize, "offset": at})
        raw += bytes(-len(raw) % 4)
        body.append(raw)
        at += len(raw)
    head = json.dumps({**meta, "buffers": specs}, ensure_ascii=False).encode()
    return gzip.compress(magic + struct.pack("<I", len(head)) + head + bytes(-len(head) % 4) + b"".join(body), mtime=0)


def decode_container(data: bytes, magic: bytes | None = None) -> tuple[dict, dict[str, np.ndarray]]:
    """(header, buffers). With ``magic`` the first eight bytes have to be these; a short or foreign file raises ValueError."""
    raw = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
    if len(raw) < 12 or (magic and raw[:8] != magic):
        raise ValueError("not a map container")
    (n,) = struct.unpack_from("<I", raw, 8)
    if 12 + n > len(raw):
        raise ValueError("the header is cut short")
    meta = json.loads(raw[12 : 12 + n])
    base = 12 + n + (-n % 4)
    out = {}
    for s in meta["buffers"]:
        t = np.dtype(TYPES[s["type"]])
        if base + s["offset"] + s["length"] * t.itemsize > len(raw):
            raise ValueError(f"buffer {s['key']} is cut short")
        out[s["key"]] = np.frombuffer(raw, t, s["length"], base + s["offset"])
    return meta, out


def ragged(rows: list[list]) -> tuple[np.ndarray, np.ndarray]:
    """(values, n + 1 offsets) of lists of unequal length."""
    return np.array([x for r in rows for x in r]), np.r_[0, np.cumsum([len(r) for r in rows])].astype(np.int32)


def unragged(values: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    return [values[a:b] for a, b in zip(offsets, offsets[1:])]


def json_rows(rows: list) -> tuple[np.ndarray, np.ndarray]:
    """One UTF-8 JSON row each, as a ragged byte buffer."""
    each = [json.dumps(r, ensure_ascii=False).encode() for r in rows]
    return np.frombuffer(b"".join(each), np.uint8), np.r_[0, np.cumsum([len(e) for e in each])].astype(np.int32)


BLOCK = 512  # notes of one compressed block
ROWS = {  # tables that travel as JSON rows, with their schemas
    "levels": "level int, count int, is_default boolean, neighbours string", "regions": "level int, region int, n bigint, label string, blurb string, cx double, cy double, terms array<string>",
    "axes": "pc int, key string, name string, low string, high string, coherence int, variance double, weak boolean", "ghosts": "key string, title string, arxiv string, url string, n bigint, core string, x double, y double, sim double",
    "views": "name string, created_ms bigint, state string", "cols": "node_id bigint, key string, type string, num double, str string, bool boolean, arr array<string>", "provenance": "title string, parent string, count bigint, basis string",
}


def _lists(df: DataFrame, at: dict, src: str, dst: str, *order: str) -> tuple[np.ndarray, np.ndarray]:
    """A table of pairs as ragged lists of positions; pairs with an end that is no node are left out."""
    out: list[list[int]] = [[] for _ in at]
    for r in df.select(src, dst, *order).orderBy(src, *(order or (dst,))).toLocalIterator():
        if r[0] in at and r[1] in at:
            out[at[r[0]]].append(at[r[1]])
    vals, offs = ragged(out)
    return vals.astype(np.int32), offs


def encode_map(nodes: DataFrame, vectors: DataFrame | None = None, knn: DataFrame | None = None, title: str = "", **tables: DataFrame) -> bytes:
    """A map file of a node table with node_id, x, y and any other columns, its card vectors, its neighbour lists and whichever other tables of the map are given: ladder, levels, regions, axes, axis_scores,
    cards (core and notes), cite, ghosts, cols, views, provenance.

    A file is written by the driver, so it is for maps that fit there (as a page that opens it has to); the tables themselves are written by ``write_map``. An empty map is refused.
    """
    rows = nodes.orderBy("node_id").toPandas()
    if rows.empty:
        raise ValueError("refusing to write an empty map")
    ids = rows["node_id"].tolist()
    at = {k: i for i, k in enumerate(ids)}
    rest = [c for c in rows.columns if c not in ("x", "y")]
    text = [json.loads(r) for r in rows[rest].to_json(orient="records", lines=True, date_format="iso").splitlines()]
    buffers = {"xy": ("f32", rows[["x", "y"]].to_numpy().ravel())}
    if vectors is not None:
        v = {r.node_id: r.vec for r in vectors.select("node_id", "vec").toLocalIterator()}
        dim = len(next(iter(v.values()))) if v else 0
        buffers["vectors"] = ("f16", np.array([v.get(k) or [0.0] * dim for k in ids], np.float32).ravel())
    for name, df, ends in (("nbr", knn, ("src", "dst", "rank")), ("cite", tables.get("cite"), ("src", "dst"))):
        if df is not None:
            vals, offs = _lists(df, at, *ends)
            buffers |= {f"{name}_v": ("i32", vals), f"{name}_o": ("i32", offs)}
    vals, offs = json_rows(text)
    buffers |= {"prow_v": ("u8", vals), "prow_o": ("i32", offs)}
    head: dict = {}
    if "ladder" in tables:
        depth = tables["ladder"].agg({"level": "max"}).first()[0]
        regions = np.full((0 if depth is None else depth + 1, len(ids)), -1, np.int32)
        for r in tables["ladder"].select("level", "node_id", "region").toLocalIterator():
            if r.node_id in at:
                regions[r.level, at[r.node_id]] = r.region
        buffers["ladder"] = ("i32", regions.ravel())
        head["depth"] = len(regions)
    if "axis_scores" in tables:
        pcs = [r[0] for r in tables["axis_scores"].select("pc").distinct().orderBy("pc").collect()]
        scores = np.full((len(pcs), len(ids)), np.nan, np.float32)
        for r in tables["axis_scores"].select("pc", "node_id", "score").toLocalIterator():
            if r.node_id in at and r.score is not None:
                scores[pcs.index(r.pc), at[r.node_id]] = r.score
        buffers["scores"] = ("f32", scores.ravel())
        head["pcs"] = pcs
    if "cards" in tables:
        cards: list = [None] * len(ids)
        for r in tables["cards"].select("node_id", "core", "notes").toLocalIterator():
            if r.node_id in at:
                cards[at[r.node_id]] = [r.core, r.notes]
        blocks = [gzip.compress(json.dumps(cards[s : s + BLOCK], ensure_ascii=False).encode(), mtime=0) for s in range(0, len(ids), BLOCK)]
        buffers |= {"cards_v": ("u8", np.frombuffer(b"".join(blocks), np.uint8)), "cards_o": ("i32", np.r_[0, np.cumsum([len(b) for b in blocks])])}
    for name in ROWS:
        if name in tables:
            vals, offs = json_rows([r.asDict(True) for r in tables[name].toLocalIterator()])
            buffers |= {f"{name}_v": ("u8", vals), f"{name}_o": ("i32", offs)}
    vdim = len(buffers["vectors"][1]) // len(ids) if "vectors" in buffers else 0
    return encode_container({"version": 3, "n": len(ids), "provenance": {"title": title, "count": len(ids)}, "hasVectors": vdim > 0, "vdim": vdim, **head}, buffers)


def decode_map(spark: SparkSession, data: bytes) -> dict[str, DataFrame]:
    """The tables of a map file: nodes, and every other that the file has."""
    meta, b = decode_container(data)
    n = meta["n"]
    rows = [json.loads(bytes(x)) for x in unragged(b["prow_v"], b["prow_o"])]
    xy = b["xy"].reshape(n, 2).astype(float)
    ids = [int(r.get("node_id", i)) for i, r in enumerate(rows)]
    out = {"nodes": spark.createDataFrame([(k, float(p[0]), float(p[1]), json.dumps(r, ensure_ascii=False)) for k, p, r in zip(ids, xy, rows)], "node_id bigint, x double, y double, row string")}
    if meta.get("hasVectors"):
        v = b["vectors"].reshape(n, meta["vdim"]).astype(np.float32)
        out["vectors"] = spark.createDataFrame([(k, [float(x) for x in r]) for k, r in zip(ids, v)], "node_id bigint, vec array<float>")
    if "nbr_v" in b:
        out["knn"] = spark.createDataFrame([(ids[i], j + 1, ids[int(d)]) for i, r in enumerate(unragged(b["nbr_v"], b["nbr_o"])) for j, d in enumerate(r)], "src bigint, rank int, dst bigint")
    if "cite_v" in b:
        out["cite"] = spark.createDataFrame([(ids[i], ids[int(d)]) for i, r in enumerate(unragged(b["cite_v"], b["cite_o"])) for d in r], "src bigint, dst bigint")
    if "ladder" in b:
        regions = b["ladder"].reshape(meta["depth"], n)
        out["ladder"] = spark.createDataFrame([(level, ids[i], int(r)) for level, row in enumerate(regions) for i, r in enumerate(row) if r >= 0], "level int, node_id bigint, region int")
    if "scores" in b:
        scores = b["scores"].reshape(len(meta["pcs"]), n)
        out["axis_scores"] = spark.createDataFrame([(ids[i], int(pc), int(s)) for pc, row in zip(meta["pcs"], scores) for i, s in enumerate(row) if not np.isnan(s)], "node_id bigint, pc int, score int")
    if "cards_v" in b:
        cards = [c for block in unragged(b["cards_v"], b["cards_o"]) for c in json.loads(gzip.decompress(block.tobytes()))]
        out["cards"] = spark.createDataFrame([(k, c[0], c[1]) for k, c in zip(ids, cards) if c], "node_id bigint, core string, notes map<string,string>")
    for name, schema in ROWS.items():
        if f"{name}_v" in b:
            fields = [f.split()[0] for f in schema.split(", ")]
            out[name] = spark.createDataFrame([tuple(json.loads(bytes(x)).get(f) for f in fields) for x in unragged(b[f"{name}_v"], b[f"{name}_o"])], schema)
    return out


def write_map(tables: dict[str, DataFrame], path: str) -> None:
    """The map as one Parquet table per part; an empty node table is refused."""
    if tables["nodes"].isEmpty():
        raise ValueError("refusing to write an empty map")
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def read_map(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}
