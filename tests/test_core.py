"""Core operators against brute force on small fixtures."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from atlaspark.functions.text import honest_percent, looks_binary, slug
from atlaspark.operators import knn as K
from atlaspark.operators import linear as L
from atlaspark.operators.graph import connected_components
from atlaspark.operators.parse import assemble, chunk, front_meta, parse_files, split_documents, text_pieces
from atlaspark.operators.rank import band, min_max100, percentile, rank100, rank_scores, unit_disc, upper_median
from atlaspark.operators.regions import distinctive_terms, fallback_label, redundancy, trajectory
from atlaspark.operators.view import View, facets, in_polygon, vault_names
from atlaspark.session import once

NOTE = "word " * 60
FILES = [
    ("v/a.md", "a.md", f'---\nid: A1\ntitle: "Alpha"\ncreated_at: 2024-01-02\ntags: [x, "y z"]\nurl: https://e.example/1).\n---\n{NOTE}', None),
    ("v/b.md", "b.md", f"# A heading\n{NOTE} see https://b.example/q, more", '{"score": 3}'),
    ("v/c.md", "c.md", "tiny", None),
    ("v/d.txt", "d.txt", f"{NOTE} https://arxiv.org/abs/2301.01234v2", None),
    ("v/e.png", "e.png", NOTE, None),
    ("v/f.md", "f.md", "\0" + NOTE, None),
    ("v/g.md", "g.md", "---\nid: card\naxes: {}\n---\nshort card", None),
    ("v/h.md", "h.md", f"# A heading\n{NOTE} see https://b.example/q, more", None),
    ("v/i.md", "i.md", None, None),
]


def test_parse(spark):
    df = spark.createDataFrame(FILES, "path string, name string, text string, meta string")
    got = {r.path: r for r in parse_files(df).collect()}
    assert "v/e.png" not in got
    assert {p: r.skip for p, r in got.items() if r.skip} == {"v/c.md": "short", "v/f.md": "binary", "v/i.md": "short"}
    a, b, d = got["v/a.md"], got["v/b.md"], got["v/d.txt"]
    assert (a.id, a.title, a.tags, a.url, a.date_ms) == ("A1", "Alpha", ["x", "y z"], "https://e.example/1", 1704153600000)
    assert (b.title, b.url) == ("A heading", "https://b.example/q")
    assert (d.title, d.arxiv) == ("d", "2301.01234")
    assert got["v/g.md"].vault_kept and got["v/g.md"].skip is None
    docs = assemble(df)
    assert {r.path for r in docs.collect()} == {"v/a.md", "v/b.md", "v/d.txt", "v/g.md"}  # h is b's twin
    assert assemble(df, limit=2).count() == 2
    assert {r.path: r.skip for r in parse_files(df, min_chars=5).collect()}["v/g.md"] is None


def test_front_meta(spark):
    front = 'id: 1\nscore: 3\nratio: -2.5\nok: yes\nname: "Ada"\nlist: [a, 2, true]\nitems:\n  - x\n  - 7\nnested:\n  k: v\nempty:\ncreated_at: 2024-01-01\ncreated: 2023'
    got = spark.createDataFrame([(front,), (None,), ("a: 1\na: two",)], "f string").select(front_meta(F.col("f")).alias("m")).collect()
    assert got[1].m == {} and got[2].m == {"a": '"two"'}
    assert {k: json.loads(v) for k, v in got[0].m.items()} == {"score": 3, "ratio": -2.5, "ok": True, "name": "Ada", "list": ["a", 2, True], "items": ["x", 7], "created_at": "2024-01-01"}


def test_split_and_chunk(spark):
    text = " ".join(f"w{i}" for i in range(500))
    for limit in (7, 100, 1000):
        ps = spark.createDataFrame([(text,)], "t string").select(text_pieces(F.col("t"), limit)).first()[0]
        assert "".join(ps) == text and max(map(len, ps)) <= limit + 1
    assert spark.createDataFrame([("a" * 10 + " " + "b" * 5,)], "t string").select(text_pieces(F.col("t"), 10)).first()[0] == ["a" * 10 + " ", "b" * 5]  # the blank at the limit itself
    df = spark.createDataFrame([(1, "t", text), (2, None, "short"), (3, "n", None)], "id long, title string, body string")
    out = {r.id: r for r in split_documents(df, "id", "title", "body", 1000).collect()}
    assert {"2", "3", "1#0", "1#1"} <= set(out) and out["1#1"].title.startswith("t (part 2/")
    c = chunk(spark.createDataFrame([(1, "a b c d e"), (2, ""), (3, None), (4, " ".join("x" * 1 for _ in range(30)))], "id long, t string"), "id", "t", 2, 4)
    by = {}
    for r in c.orderBy("id", "chunk_no").collect():
        by.setdefault(r.id, []).append(r.text)
    assert by[1] == ["a b", "c d", "e"] and by[2] == [" "] == by[3] and len(by[4]) == 4


def test_ranks(spark):
    rows = [(i, v) for i, v in enumerate([5.0, 5.0, 1.0, None, 9.0])]
    df = spark.createDataFrame(rows, "node_id long, v double").withColumn("n", F.lit(7)).withColumn("r", F.lit("x"))
    assert {r.node_id: r.score for r in rank_scores(df.where("v is not null"), "v", "node_id").collect()} == {2: 0, 0: 33, 1: 67, 4: 100}
    assert {r.node_id: round(r.score, 3) for r in rank100(df, "v", "node_id").collect()} == {2: 0, 0: 33.333, 1: 66.667, 4: 100, 3: 50}
    assert {r.node_id: r.score for r in min_max100(df, "v").collect()} == {0: 50, 1: 50, 2: 0, 3: 50, 4: 100}
    assert rank_scores(df.where("node_id = 0"), "v", "node_id").first().score == 50
    nums = spark.createDataFrame([(float(i),) for i in range(1, 11)], "v double")
    assert upper_median(nums, "v").first()[0] == 6 and percentile(nums, "v", 0.98).first()[0] == 9
    assert band(spark.createDataFrame([(3.0,)] * 4, "v double"), "v").first().scaled == 0
    assert unit_disc(spark.createDataFrame([(1.0, 1.0)] * 3, "x double, y double"), "x", "y").first().dx == 0
    ring = spark.createDataFrame([(math.cos(i), math.sin(i)) for i in range(50)], "x double, y double")
    assert ring.count() == sum(0.8 < math.hypot(r.dx, r.dy) <= 1.0001 for r in unit_disc(ring, "x", "y").collect())
    assert rank_scores(df.limit(0), "v", "node_id").count() == 0


def test_rank_is_ordinal_on_many(spark):
    rng = random.Random(1)
    rows = [(i, float(rng.randint(0, 40))) for i in range(1500)]
    want = {k: j for j, (k, _) in enumerate(sorted(rows, key=lambda r: (r[1], r[0])))}
    got = rank_scores(spark.createDataFrame(rows, "node_id long, v double"), "v", "node_id").collect()
    assert all(r.score == math.floor(100 * want[r.node_id] / 1499 + 0.5) for r in got) and len(got) == 1500


def test_view(spark):
    df = spark.createDataFrame([(1, "Alpha", None, 0.1, True), (2, "beta", "ALPHA in core", 0.5, None), (3, None, None, None, False)], "node_id long, title string, core string, v double, read boolean")
    v = View(df)
    ids = lambda w: sorted(r.node_id for r in w.rows().collect())
    assert ids(v.find("alpha", "title", "core")) == [1, 2] and ids(v.find("  ", "title")) == [1, 2, 3]
    assert ids(v.window("v", None, None)) == [1, 2, 3] and ids(v.window("v", 0.1, 0.5)) == [1, 2]
    assert ids(v.unread()) == [2, 3]
    held = spark.createDataFrame([(2,), (2,), (9,)], "node_id long")
    both = v.find("alpha", "title", "core").selection(held)
    assert ids(both) == [2] and ids(both.undo()) == [1, 2] and ids(both.clear()) == [1, 2, 3] and ids(both.remove("set", "held")) == [1, 2]
    assert {r.label: r.n for r in both.chips().collect()} == {"alpha": 2, "held": 1}
    assert v.chips().count() == 0
    square = [(0, 0), (1, 0), (1, 1), (0, 1)]
    p = spark.createDataFrame([(0.5, 0.5), (1.5, 0.5), (None, 0.2)], "x double, y double")
    assert [r[0] for r in p.select(in_polygon(F.col("x"), F.col("y"), square)).collect()] == [True, False, False]
    assert p.where(in_polygon(F.col("x"), F.col("y"), square[:2])).count() == 0
    assert facets(df, "core").count() == 0
    names = {r.node_id: r.filename for r in vault_names(spark.createDataFrame([(1, "A/b"), (2, "a b"), (3, None), (4, "")], "node_id long, title string"), "node_id", "title").collect()}
    assert names == {1: "A b.md", 2: "a b-2.md", 3: "untitled.md", 4: "untitled-2.md"}


def test_regions(spark):
    docs = spark.createDataFrame([(i, ("storm cloud common" if i < 3 else "bread flour common") if i < 6 else "common") for i in range(8)], "node_id long, core string")
    groups = docs.where("node_id < 6").select("node_id", F.when(F.col("node_id") < 3, "w").otherwise("f").alias("region"))
    t = distinctive_terms(docs, groups, "node_id", "core", "region")
    by = {}
    for r in t.orderBy("region", "place").collect():
        by.setdefault(r.region, []).append(r.term)
    assert by == {"w": ["cloud", "storm"], "f": ["bread", "flour"]}
    assert {r.region: r.label for r in fallback_label(t, "region").collect()} == {"w": "Cloud / Storm", "f": "Bread / Flour"}
    days = spark.createDataFrame([(1000 + i, i // 20) for i in range(40)], "d long, c int")
    tr = {r.c: r for r in trajectory(days, "d", "c").collect()}
    assert tr[0].trend == "cooling" and tr[1].trend == "rising"
    assert trajectory(days.limit(10), "d", "c").count() == 0
    rng = np.random.default_rng(0)
    w = spark.createDataFrame([(float(x), float(2 * x + 5), float(i % 2)) for i, x in enumerate(rng.random(60))], "a double, b double, c double")
    r = redundancy(w, ["a", "b", "c"]).first()
    assert r.pairs == 3 and r.strong_pairs == 1 and not r.passes


def test_components(spark):
    rng = random.Random(2)
    chain = [(i, i + 1) for i in range(300)]
    star = [(1000, 1000 + i) for i in range(1, 200)]
    loose = [(2000 + rng.randint(0, 300), 2000 + rng.randint(0, 300)) for _ in range(200)]
    edges = chain + star + loose + [(5, 5), (None, 3)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: root(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def blobs(n, d, k, seed=7):
    rng = np.random.default_rng(seed)
    c = rng.standard_normal((k, d))
    x = c[np.arange(n) % k] / np.linalg.norm(c, axis=1)[np.arange(n) % k, None] + 0.08 * rng.standard_normal((n, d))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def vec_df(spark, x, key="node_id"):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], f"{key} long, vec array<float>")


def test_knn(spark):
    x = blobs(90, 12, 3)
    got = K.exact_knn(vec_df(spark, x).union(spark.createDataFrame([(999, None)], "node_id long, vec array<float>")), "node_id", "vec", 5, block=32)
    s = x.astype(np.float32).astype(float)
    s = s / np.linalg.norm(s, axis=1, keepdims=True)
    s = s @ s.T
    np.fill_diagonal(s, -9)
    want = {(i, j) for i in range(90) for j in np.argsort(-s[i], kind="stable")[:5]}
    assert {(r.src, r.dst) for r in got.collect()} == want
    assert K.recall(got, got).first().recall == 1
    approx = K.lsh_knn(vec_df(spark, x), "node_id", "vec", 5, 24)
    assert K.recall(approx, got).first().recall > 0.9
    assert K.calibrated_knn(vec_df(spark, x), "node_id", "vec", 5)[1] == "exact"
    same = K.exact_knn(vec_df(spark, np.ones((6, 4))), "node_id", "vec", 2).where("src = 3").orderBy("rank").collect()
    assert [r.dst for r in same] == [0, 1]


def test_axes(spark):
    rng = np.random.default_rng(1)
    n, d, k = 200, 24, 3
    f = rng.standard_normal((n, k)) * [3, 2, 1.5]
    x = f @ np.sin(np.outer(np.arange(1, k + 1), np.arange(1, d + 1)) * 0.7) + 0.05 * rng.standard_normal((n, d))
    df = vec_df(spark, x)
    axes = L.discover_axes(df, "vec")
    u = x.astype(np.float32) / np.linalg.norm(x.astype(np.float32), axis=1, keepdims=True)
    w = np.linalg.eigvalsh(np.cov(u.T))[::-1]
    assert np.allclose(axes["variance"][:3], w[:3] / w.sum(), atol=1e-5) and 2 <= len(axes["components"]) <= 16 and axes["real_dims"] >= 2
    p = {(r.node_id, r.pc): r.raw for r in L.project(df, "node_id", "vec", axes).collect()}
    want = (u - u.mean(0)) @ axes["components"].T
    assert all(abs(p[i, j + 1] - want[i, j]) < 1e-6 for i in range(n) for j in range(2))


def test_ladder(spark):
    assert L.grain_ladder(101) == [2, 3, 5, 8, 12, 18, 27, 41, 62, 93, 101] and L.grain_ladder(1) == [1] and L.grain_ladder(2) == [2]
    assert L.default_grain([2, 3, 24, 30]) == 2 and L.regrained([2, 12, 24]) == 1
    x = blobs(160, 16, 4)
    rungs, counts = L.ladder(vec_df(spark, x), "node_id", "vec", 4)
    rows = rungs.collect()
    top = max(r.level for r in rows)
    fine = {r.node_id: r.region for r in rows if r.level == top}
    assert counts[-1] == 4 and len({(fine[i], i % 4) for i in range(160)}) == 4
    for level in range(top):  # nested
        coarse = {r.node_id: r.region for r in rows if r.level == level}
        assert len({(coarse[i], fine[i]) for i in range(160)}) == 4
    same, counts = L.ladder(vec_df(spark, np.ones((40, 4))), "node_id", "vec", 4)
    assert counts == [1] and same.select("region").distinct().count() == 1


def test_derived(spark):
    df = vec_df(spark, blobs(40, 8, 2))
    d = L.mean_difference(df, "node_id", "vec", df.where("node_id % 2 = 0"))
    s = {r.node_id: r.sim for r in L.similarity_to(df, "node_id", "vec", d).collect()}
    assert min(s[i] for i in range(0, 40, 2)) > max(s[i] for i in range(1, 40, 2))
    assert L.mean_difference(df, "node_id", "vec", df) is None and L.mean_difference(df, "node_id", "vec", df.limit(0)) is None


def test_scalars(spark):
    df = spark.createDataFrame([("A  b/C!",), (None,), ("\x01" * 9,)], "t string")
    assert [r[0] for r in df.select(slug(F.col("t"))).collect()][:2] == ["a-b-c", None]
    assert [r[0] for r in df.select(looks_binary(F.col("t"))).collect()] == [False, None, True]
    p = spark.createDataFrame([(0, 1000), (1, 100000), (1, 3), (999, 1000), (99999, 100000), (1, 0)], "a int, b int")
    assert [r[0] for r in p.select(honest_percent(F.col("a"), F.col("b"))).collect()] == [0.0, 0.1, 33.0, 99.9, 99.9, None]


def test_once(spark):
    df = spark.createDataFrame([(1, "a", None), (1, "a", None), (None, "b", 1), (2, None, 3)], "k long, key string, `n.x` int")
    assert once(df, "k").count() == 2 and once(df.limit(0), "k").count() == 0


@pytest.mark.parametrize("kind", ["map", "stream"])
def test_io(spark, tmp_path, kind):
    if kind == "map":
        from atlaspark.sources.mapfile import decode_container, decode_map, encode_container, encode_map, read_map, write_map

        nodes = spark.createDataFrame([(1, 0.5, -1.0, "é"), (2, 0.0, 1.0, None)], "node_id long, x double, y double, title string")
        knn = spark.createDataFrame([(1, 1, 2)], "src long, rank int, dst long")
        vec = spark.createDataFrame([(1, [0.5, 1.0])], "node_id long, vec array<float>")
        back = decode_map(spark, encode_map(nodes, vec, knn, "t"))
        assert [(r.node_id, r.x, r.y) for r in back["nodes"].orderBy("node_id").collect()] == [(1, 0.5, -1.0), (2, 0.0, 1.0)]
        assert back["knn"].collect()[0].dst == 2 and back["vectors"].orderBy("node_id").first().vec == [0.5, 1.0]
        with pytest.raises(ValueError):
            encode_map(nodes.limit(0))
        with pytest.raises(ValueError):
            write_map({"nodes": nodes.limit(0)}, str(tmp_path / "m"))
        write_map({"nodes": nodes}, str(tmp_path / "m"))
        assert read_map(spark, str(tmp_path / "m"), ["nodes"])["nodes"].count() == 2
        data = encode_container({"a": 1}, {"v": ("f64", np.arange(3.0))})
        assert decode_container(data)[1]["v"].tolist() == [0, 1, 2]
        with pytest.raises(ValueError):
            decode_container(data, b"OTHERMAG")
    else:
        from atlaspark.streaming.ingest import fresh_documents, run_into, stream_files

        rows = [(i % 3, 1, f"p{i % 3}", f"p{i % 3}.md", NOTE, None, None) for i in range(6)]
        df = spark.createDataFrame(rows, "file_id long, map_id int, path string, name string, text string, meta string, modified timestamp").withColumn("ingested_at", F.to_timestamp(F.lit("2024-01-01")))
        df.write.parquet(str(tmp_path / "in"))
        run_into(fresh_documents(stream_files(spark, str(tmp_path / "in"))).select("file_id", "title"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
        assert sorted(r.file_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 1, 2]


def test_sources(spark, tmp_path):
    from atlaspark.sources.files import FolderSource, TableSource, append_cache, read_cache

    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.md").write_text("# A\n" + NOTE)
    (tmp_path / "d" / "b.PNG").write_text("x")
    got = FolderSource(str(tmp_path)).load(spark).collect()
    assert [r.name for r in got] == ["a.md"] and "modified" in got[0].meta
    t = spark.createDataFrame([("T 1", NOTE, 3, [1]), (None, None, None, None)], "title string, body string, score int, xs array<int>")
    rows = TableSource(t, "body", "set").load(spark).collect()
    assert {r.meta for r in rows} == {'{}', '{"score":3,"xs":[1]}'} and any('title: "T 1"' in r.text for r in rows)
    append_cache(spark.createDataFrame([("a", "1"), ("b", "2")], "k string, v string").coalesce(1), str(tmp_path / "c"))
    with open(tmp_path / "c" / "zz-torn.txt", "w") as f:
        f.write('{"k": "a", "v": "9"}\n{"k": "a", "v"')
    good, bad = read_cache(spark, str(tmp_path / "c"))
    assert {r.k: r.v for r in good.collect()} == {"a": "9", "b": "2"} and bad.count() == 1


def test_small_regions_are_halved_too(spark):
    # a sample of 40 rows has next to none of the small groups, which still have to come apart
    rng = np.random.default_rng(2)
    centres = np.linalg.qr(rng.standard_normal((12, 12)))[0]
    x = np.concatenate([centres[g] + 0.02 * rng.standard_normal((2000 if g == 0 else 30, 12)) for g in range(6)])
    df = vec_df(spark, x)
    splits = L.bisect(df, "vec", 6, 25, sample=40)
    leaf = splits.leaf(x / np.linalg.norm(x, axis=1, keepdims=True))
    small = [set(leaf[2000 + 30 * g : 2030 + 30 * g].tolist()) for g in range(5)]
    assert len(splits.order) == 5 and all(len(s) == 1 for s in small)
