"""Columns, dimensions, views, citations, model seams, datasets and the map file."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from atlaspark.operators import citations as C
from atlaspark.operators import columns as T
from atlaspark.operators import dimensions as D
from atlaspark.operators.knn import row_defects
from atlaspark.operators.linear import noise_covariance, principal
from atlaspark.operators.regions import axis_drift, redundant_pairs
from atlaspark.operators.view import View, deck_lines
from atlaspark.plans import models as M
from atlaspark.plans import runs as R
from atlaspark.plans.build import build_map, check_map, descend, embed_cached, ring, state_text
from atlaspark.sources import datasets as S
from atlaspark.sources.files import FolderSource, vault_manifest
from atlaspark.sources.mapfile import decode_map, encode_map


def test_typed_columns(spark):
    rows = [(i, json.dumps(o) if o is not None else None) for i, o in enumerate([
        {"n": 3, "when": "2024-05-01", "genre": "a, b", "ok": True, "l": ["x", "", None, "y"], "empty": ""}, {"n": "three", "when": "2024-06", "genre": "b,c", "ok": "yes", "l": [], "nested": {"a": 1}},
        {"n": 2.5, "when": "2024-07-02T03:04:05Z", "genre": "c, d", "ok": False, "l": "z"}, {"n": -1, "when": "not a date", "genre": "d"}, None, {"when": "2023-01-01"}, {"when": "2023-01-02"}])]
    types, values = T.generic_columns(spark.createDataFrame(rows, "node_id long, meta string"), "node_id", "meta")
    assert {r.key: (r.type, r.multi) for r in types.collect()} == {"n": ("scalar", False), "when": ("temporal", False), "genre": ("categorical", True), "ok": ("boolean", False), "l": ("categorical", True)}
    got = {(r.node_id, r.key): r.num if r.num is not None else r.arr or r.bool for r in values.collect()}
    assert got[0, "n"] == 3 and (1, "n") not in got and got[2, "n"] == 2.5 and got[0, "genre"] == ["a", "b"] and got[0, "l"] == ["x", "y"] and (1, "l") not in got
    assert got[0, "when"] == 1714521600000 and got[1, "when"] == 1717200000000 and (3, "when") not in got and got[0, "ok"] is True and got[2, "ok"] is False and (1, "ok") not in got
    wide = {r.node_id: r for r in T.wide_columns(values, types.collect()).collect()}
    assert wide[0].genre == ["a", "b"] and wide[2].ok is False and wide[5].n is None
    nodes = spark.createDataFrame([(0, "x", ["t"], None), (1, "", [], None)], "node_id long, author string, tags array<string>, date_ms long")
    assert [r.key for r in T.manifest(nodes, types.union(types.limit(1).withColumn("key", F.lit("author")))).orderBy("ord", "key").collect()][:3] == ["author", "tags", "author·col"]


def dims():
    axes = [D.Dimension(f"pc{i}", f"Axis {i}", "scalar", f"a{i}", "axis", low="cold", high="warm") for i in (1, 2)]
    fields = [D.Dimension("tag", "Tag", "categorical", "tag", "meta"), D.Dimension("score", "Score", "scalar", "score", "meta"), D.Dimension("date", "Date", "temporal", "date", "meta"), D.Dimension("pc1", "A column", "scalar", "c", "meta")]
    return D.Registry(axes, fields, [D.Dimension("q0", "a query", "scalar", "q0", "query")])


def test_registry_and_channels(spark):
    r = dims()
    assert list(r.dims) == ["pc1", "pc2", "score", "date", "pc1·col", "tag", "q0"] and r.window_field() == "date" and r.without("date").window_field() == "score"
    assert r["pc1"].poles() == ("cold", "warm") and r.tuned("pc1", invert=True)["pc1"].poles() == ("warm", "cold")
    ch = D.Channels(r)
    assert (ch.get("x"), ch.get("y"), ch.get("z"), ch.get("size"), ch.get("color")) == ("pc1", "pc2", "pc1", "hub", "region")
    ch = ch.set("color", "q0").set("scrub", "q0").set("x", "score")
    after, window_gone = ch.removed("q0")
    assert window_gone and after.get("color") == "region" and after.get("scrub") == "" and after.get("x") == "score" and "q0" not in after.registry
    with pytest.raises(KeyError):
        ch.set("color", "nothing")
    nodes = spark.createDataFrame([(1, 0.0, 5.0, 2.0, "u", 0), (2, 1.0, None, 4.0, "v", 3), (3, 2.0, 7.0, 3.0, None, 1)], "node_id long, a1 double, a2 double, score double, tag string, hub long")
    got = {x.node_id: x for x in D.Channels(r.tuned("pc2", "rank", True)).set("color", "tag").set("x", "score").frame(nodes).collect()}
    assert (got[1].x, got[2].x, got[3].x) == (-1, 1, 0) and (got[1].y, got[2].y, got[3].y) == (1, 0, -1) and got[2].color == "v" and got[2].size == pytest.approx(4.9)


def test_views(spark):
    r = dims()
    ids = [f"d{i}" for i in range(500)]
    ch = D.Channels(r.tuned("score", "rank")).set("color", "tag").set("scrub", "date")
    state = D.snapshot(ch, grain=2, window=(1, None), find="x y&z", selection=["d3", "d400"])
    back = D.from_address(D.to_address(state, ids), ids)
    assert back == state and D.from_address(D.to_address(state, ids), ids[:-1]).get("selection") is None and D.from_address("view=%7B", ids) == {}
    many = D.snapshot(ch, selection=ids[::2] * 1)
    big = [f"d{i}" for i in range(9000)]
    assert "sel=" not in D.to_address({**many, "selection": big[::3]}, big)
    views = D.save_view(D.save_view(None, spark, "one", 1, {}), spark, "one", 2, state)
    c2, rest, gone = D.open_view(views, "one", r)
    assert views.count() == 1 and c2.get("color") == "tag" and c2.registry["score"].norm == "rank" and rest["window"] == {"lo": 1} and gone == []
    c3, rest, gone = D.restore(state, r.without("date").without("tag"))
    assert gone == ["date", "tag"] and "window" not in rest and c3.get("color") == "region"


def test_view_region_and_depth(spark):
    nodes = spark.createDataFrame([(i, float(i) / 4 - 1, 0.0, 0.5 if i < 6 else 5.0) for i in range(8)], "node_id long, x double, y double, z double")
    ladder = spark.createDataFrame([(0, i, i // 4) for i in range(8)] + [(1, i, i // 2) for i in range(8)], "level int, node_id long, region int")
    v = View(nodes).region(ladder, 1, 1).window("x", -1, 0)
    assert {r.node_id for r in v.rows().collect()} == {2, 3} and {r.label: r.n for r in v.chips().collect()} == {"region 1/1": 2, "x -1..0": 5}
    assert v.grain().rows().count() == 5 and v.grain().undo().rows().count() == 2
    square = [(-2.0, -1.0), (2.0, -1.0), (2.0, 1.0), (-2.0, 1.0)]
    eye = [1.0 if i % 5 == 0 else 0.0 for i in range(16)]
    assert {r.node_id for r in View(nodes).lasso3d(eye, "x", "y", "z", square).rows().collect()} == set(range(6))
    scores = spark.createDataFrame([(0, "warm", 80), (1, "cold", 10)], "node_id long, axis string, score int")
    lines = [json.loads(r.line) for r in deck_lines(nodes.limit(2), "node_id", scores=scores).collect()]
    assert sorted((x["node_id"], x["scores"]["warm"], x["scores"]["cold"]) for x in lines) == [(0, 80, 50), (1, 50, 10)]


def test_citations(spark):
    docs = spark.createDataFrame([(1, "2001.00001", "One"), (2, "2001.00002", "Two"), (3, "2001.00002", "Two again"), (4, None, "Four")], "node_id long, arxiv string, title string")
    refs = spark.createDataFrame([(1, "2001.00002", False, "Two", None, None), (1, "2001.00002", False, "Two", None, None), (3, "2001.00002", False, "Two", None, None), (4, "2001.00001", True, "One", None, None),
                                  (2, "1999.1", False, "Old", "u", "old text"), (4, "1999.1", False, "Old", "u", "old text"), (4, None, False, " Lone paper ", None, None), (4, None, None, None, None, None)], "node_id long, arxiv string, citing boolean, title string, url string, core string")
    edges = C.cite_edges(refs, docs)
    assert {(r.src, r.dst) for r in edges.collect()} == {(1, 3), (1, 4)}
    assert C.remap_edges(edges, docs.where("node_id <> 4")).collect() == [(1, 3)] and {r.node_id: r.n for r in C.cite_counts(edges, docs).collect()} == {1: 0, 2: 0, 3: 1, 4: 1}
    embed = lambda df, key, text: df.select(key, F.when(F.col(text).contains("Old"), F.array(F.lit(1.0), F.lit(0.2))).otherwise(F.array(F.lit(-1.0), F.lit(0.0))).alias("vec"))
    cards = spark.createDataFrame([(1, [1.0, 0.0], 0.0, 0.0), (2, [1.0, 0.4], 1.0, 1.0), (3, [0.0, -1.0], 9.0, 9.0)], "node_id long, vec array<double>, x double, y double")
    _, ghosts = C.frontier_on_map(refs, docs, cards, embed)
    got = {g.key: g for g in ghosts.collect()}
    assert set(got) == {"1999.1", "lone paper"} and got["1999.1"].n == 2 and got["1999.1"].x == pytest.approx(0.5, abs=0.01) and got["lone paper"].x == pytest.approx(3.3333, abs=0.001)
    assert [tuple(r) for r in C.strongest_references(edges, docs, "node_id", 1).collect()] == [(1, 1, 3)]


def test_models(spark):
    docs = spark.createDataFrame([(i, f"T{i % 3}", f"body {i % 3}") for i in range(6)] + [(9, None, None)], "node_id long, title string, body string")
    axes = spark.createDataFrame([(1, "pc1", 0.5), (2, "pc2", 0.25)], "pc int, key string, variance double")

    def client(r):
        if r["title"] == "T2":
            raise ValueError("no")
        return {"core": r["body"].upper(), "notes": {"pc1": "high"}, "usage": {"in": 10, "out": 2}}

    cards, fresh, use = M.card_deck(docs, axes, client, sleep=lambda s: None)
    got = {r.node_id: r.core for r in cards.collect()}
    assert got == {0: "BODY 0", 3: "BODY 0", 1: "BODY 1", 4: "BODY 1", 9: ""} and (use["calls"], use["failed"], use["tokens_in"]) == (4, 1, 30) and M.usage_totals(use, use)["tokens_out"] == 12
    named = M.name_axes(axes, spark.createDataFrame([(1, "low", 1, "a")], "pc int, pole string, place int, title string"), lambda r: {"axes": [{"pc": 1, "name": "Warmth", "low": "cold", "high": "hot", "coherence": 5}]})
    assert [(a.name, a.coherence) for a in named.orderBy("pc").collect()] == [("Warmth", 5), ("PC2", 3)]
    again = M.card_deck(docs.where("title <> 'T2'"), axes, lambda r: 1 / 0, fresh)  # all from the cache
    assert again[2]["calls"] == 0 and again[0].count() == 4
    with pytest.raises(Exception, match="every request failed"):
        M.card_deck(docs, axes, lambda r: 1 / 0, sleep=lambda s: None)
    assert M.axis_lines(named.orderBy("pc").collect()).splitlines()[0] == '1. Warmth: low="cold" high="hot"'


def test_retry():
    waits, tries = [], []

    def call():
        tries.append(1)
        if len(tries) < 3:
            raise M.Busy(after=7)
        return "ok"

    assert M.with_retry(call, sleep=waits.append, rng=lambda: 0.5) == "ok" and waits == [7, 7]
    with pytest.raises(M.Refused):
        M.with_retry(lambda: (_ for _ in ()).throw(M.Refused()), sleep=waits.append)
    assert len(waits) == 2


def test_region_names(spark):
    ladder = spark.createDataFrame([(0, i, i // 4) for i in range(8)] + [(1, i, i // 4) for i in range(8)], "level int, node_id long, region int")
    cards = spark.createDataFrame([(i, f"t{i}", "quartz garnet stone" if i < 4 else "violin cello music") for i in range(8)], "node_id long, title string, core string")
    scores = spark.createDataFrame([(i, 1, 90 if i < 4 else 10) for i in range(8)], "node_id long, pc int, score int")
    plain, _, _ = M.name_regions(ladder, cards, scores)
    assert {(r.level, r.region): r.label for r in plain.collect()} == {(lv, r): lab for lv in (0, 1) for r, lab in ((0, "Garnet / Quartz"), (1, "Cello / Music"))}
    named, fresh, use = M.name_regions(ladder, cards, scores, lambda r: {"label": "Stones" if "toward high" in r["axes"] else "", "blurb": r["samples"][:2]})
    assert use["calls"] == 2 and {(r.level, r.region): (r.label, r.blurb) for r in named.collect()}[1, 0] == ("Stones", "t0") and fresh.count() == 2


def test_drift_pairs_defects(spark):
    nodes = spark.createDataFrame([(i, 1000 + i) for i in range(30)] + [(99, 0)], "node_id long, d long")
    scores = spark.createDataFrame([(i, 1, 40 if i < 16 else 60) for i in range(30)] + [(i, 2, 50) for i in range(30)], "node_id long, pc int, score int")
    got = axis_drift(nodes, scores, "d").collect()
    assert [(r.pc, r.early, r.late, r.pole) for r in got] == [(1, 40, 60, "high")] and axis_drift(nodes.limit(10), scores, "d").count() == 0
    x = spark.createDataFrame([(float(i), float(-i), float(i % 3)) for i in range(30)], "a double, b double, c double")
    assert [(r.a, r.b, r.r) for r in redundant_pairs(x, ["a", "b", "c"], 1).collect()] == [("a", "b", -1.0)]
    knn = spark.createDataFrame([(1, 2), (1, 3), (2, 2), (2, 1), (3, 1), (3, 1), (4, 77), (4, 1)], "src long, dst long")
    d = row_defects(knn, spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5)], "node_id long"), "node_id", 2).first()
    assert (d.short, d.repeated, d.selfish, d.foreign) == (2, 1, 1, 1)


@pytest.mark.parametrize("n", [40, 400])
def test_noise_is_a_shuffle(n):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((n, 12)) * np.linspace(1, 3, 12)
    shuffled = [principal(np.cov(np.stack([rng.permutation(c) for c in x.T], axis=1).T), n)[1] for _ in range(40)]
    drawn = [principal(noise_covariance(x.var(0, ddof=1), n, rng), n)[1] for _ in range(40)]
    assert np.abs(np.mean(shuffled, 0) - np.mean(drawn, 0)).max() < 0.01


def test_sources(spark, tmp_path):
    folder = tmp_path / "v"
    folder.mkdir()
    (folder / "a.MD").write_text('---\nid: "f1"\nurl: http://a.example\n---\n' + "word " * 60)
    (folder / "b.md").write_bytes(b"\xff\xfe\x00\x81" * 200)
    (folder / "c.md").write_text('---\nid: "f2"\n---\nshort')
    (folder / "atlaspark-vault.json").write_text('{"kind": "vault", "title": "Mine"}')
    src = FolderSource(str(folder))
    assert {r.name for r in src.load(spark).collect()} == {"a.MD", "b.md", "c.md"} and src.title(spark) == "Mine" and vault_manifest('{"x": "vault"}') is None
    (tmp_path / "meta.jsonl").write_text("".join(json.dumps({"id": i, "title": i, "reading_progress": 0.5, "vec": [1.0, 2.0]}) + "\n" for i in ("f1", "f2", "f3", "f4")))
    (tmp_path / "keep.jsonl").write_text("".join(json.dumps({"id": i}) + "\n" for i in ("f2", "f3")))
    fix = {r.id: r for r in S.FixtureSource(str(tmp_path / "meta.jsonl"), str(tmp_path / "keep.jsonl"), str(folder)).load(spark).collect()}
    assert set(fix) == {"f2", "f3"} and fix["f2"].body == "short" and fix["f3"].body == "" and fix["f3"].vec == [1.0, 2.0]
    out = tmp_path / "ds"
    out.mkdir()
    for split in ("test", "train"):
        (out / f"{split}.jsonl").write_text("".join(json.dumps({"name": f"{split} {i}", "short": "s", "long": "a long text here", "k": i}) + "\n" for i in range(250)))
    ds = S.DatasetSource(str(out), "ds")
    assert ds.splits() == ["test", "train"] and "a long text here" in ds.load(spark).where("text like '%train 3%'").first().text
    assert [S.dataset_id(x) for x in ("a/b", "https://h.example/datasets/a/b-c?x=1", "no id", "a/b/c")] == ["a/b", "a/b-c", None, None]
    n = S.index_lines(str(out / "train.jsonl"))
    spark.dataSource.register(S.PagedSource)
    paged = spark.read.format("atlaspark_pages").option("path", str(out / "train.jsonl")).option("rows", n).option("pages_per_task", 1).option("schema", "name string, k int").schema("name string, k int").load()
    assert paged.count() == 250 and paged.rdd.getNumPartitions() == 3 and paged.agg(F.sum("k")).first()[0] == sum(range(250))


def test_pages_are_asked_again():
    class Down(Exception):
        status = 503

    class Gone(Exception):
        status = 404

    tries, waits = [], []

    def fetch(at, n):
        tries.append(at)
        if len(tries) < 3:
            raise Down
        return [at]

    assert S.page_with_retry(fetch, 5, 1, sleep=waits.append) == [5] and waits == [1, 2]
    with pytest.raises(Gone):
        S.page_with_retry(lambda a, n: (_ for _ in ()).throw(Gone()), 0, 1, sleep=waits.append)


@pytest.fixture(scope="module")
def made(spark):
    topics = ["quartz garnet basalt granite", "violin cello sonata fugue", "court statute judge appeal"]
    rows = [(f"n/{i}.md", f"{i}.md", f"---\nid: d{i}\ncreated_at: 2024-{1 + i % 12:02d}-01\n---\n" + " ".join((topics[i % 3] + f" item{i}").split() * 14), None) for i in range(60)]
    return build_map(spark.createDataFrame(rows, "path string, name string, text string, meta string"))


def test_a_map_survives_its_file(spark, made):
    check_map(made)
    assert {"x3", "y3", "z3", "color_x", "color_y"} <= set(made["layout"].columns)
    ids = [r.node_id for r in made["nodes"].orderBy("node_id").collect()]
    cite = spark.createDataFrame([(ids[0], ids[1]), (ids[2], ids[59])], "src long, dst long")
    cols = spark.createDataFrame([(ids[0], "k", "scalar", 1.5, None, None, None), (ids[9], "g", "categorical", None, None, None, ["a"])], "node_id long, " + T.LONG)
    full = {**made, "cite": cite, "cols": cols, "views": D.save_view(None, spark, "v", 5, {"grain": 1})}
    data = encode_map(full["nodes"], full["vectors"], full["knn"], "t", **{k: full[k] for k in ("ladder", "levels", "regions", "axes", "axis_scores", "cards", "cite", "cols", "views", "provenance")})
    back = decode_map(spark, data)
    for name, columns in {"ladder": ("level", "node_id", "region"), "levels": ("level", "count", "is_default"), "regions": ("level", "region", "n", "label", "cx"), "axes": ("pc", "key", "variance"), "axis_scores": ("node_id", "pc", "score"),
                          "cards": ("node_id", "core"), "cite": ("src", "dst"), "cols": ("node_id", "key", "num"), "views": ("name", "state"), "knn": ("src", "rank", "dst"), "provenance": ("count", "basis")}.items():
        assert sorted(map(str, back[name].select(*columns).collect())) == sorted(map(str, full[name].select(*columns).collect())), name
    assert {r.node_id: r.notes for r in back["cards"].collect()} == {r.node_id: r.notes for r in full["cards"].collect()}
    assert R.ship_check(data, spark, 60) == 60
    with pytest.raises(ValueError):
        R.ship_check(data, spark)
    part = descend(full, spark.createDataFrame([(i,) for i in ids[:30]], "node_id long"), title="half")
    assert [tuple(r) for r in part["cite"].collect()] == [(ids[0], ids[1])] and part["cols"].count() == 2 and part["provenance"].first().title == "half"
    text = state_text(made)
    assert text and "## Regions" in text and state_text({**made, "docs": made["docs"].limit(10)}) is None
    new = M.relabel(made)
    assert new["regions"].count() == made["regions"].count() and new["levels"].where("is_default").count() == 1
    same = R.parity(made["nodes"], made["nodes"].withColumn("title", F.when(F.col("node_id") == ids[0], "other").otherwise(F.col("title"))), "node_id", "title", "hub")
    assert {r.column: (r.same, r.differ, r.only_old) for r in same.collect()} == {"title": (59, 1, 0), "hub": (60, 0, 0)}


def test_small_maps(spark):
    v = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(4)], "node_id long, vec array<double>")
    got = [(round(r.x, 6), round(r.y, 6)) for r in ring(v, 4).orderBy("node_id").collect()]
    assert got == [(0.6, 0.0), (0.0, 0.6), (-0.6, 0.0), (0.0, -0.6)]
    a, b = (embed_cached(spark.createDataFrame([(1, "x y")], "node_id long, t string"), "node_id", "t", None, model=m)[1].first().k for m in ("one", "two"))
    assert a != b


def test_runs(spark, tmp_path):
    c = R.Config.from_env({"ATLASPARK_MIN_CHARS": "9", "ATLASPARK_CACHE_ROOT": "/c/"})
    assert c.min_chars == 9 and c.cache("cards") == "/c/cards" and c.axes == 16
    seen, made_ = [], []
    run = R.Resumable(spark, str(tmp_path / "r"), R.Progress(seen.append))
    for _ in range(2):
        assert run.stage("s", lambda: made_.append(1) or spark.range(3)).count() == 3
    assert len(made_) == 1 and [e["state"] for e in seen] == ["started", "done", "kept"]
    run.again("s")
    run.stage("s", lambda: made_.append(1) or spark.range(3))
    with pytest.raises(ZeroDivisionError):
        run.stage("t", lambda: 1 / 0)
    assert len(made_) == 2 and seen[-1]["state"] == "failed"
