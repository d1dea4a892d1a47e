"""Codecs, sinks and evaluation."""

import json
import os
import random

import numpy as np
from pyspark.sql import functions as F

from atlaspark.functions.codecs import decode_ids, duration, encode_ids, money, separate_hues, short_count
from atlaspark.operators.evaluate import kmeans_elbow, label_precision, paired_bootstrap, scalar_difference
from atlaspark.operators.sinks import vault_entries, write_lines, write_parts, write_vault


def test_id_sets():
    rng = random.Random(0)
    ids = [f"d{i}" for i in range(3000)]
    for _ in range(50):
        pick = rng.sample(range(3000), rng.choice([0, 1, 5, 400]))
        assert decode_ids(encode_ids(pick, ids), ids) == sorted(pick)
    text = encode_ids([3, 200], ids)
    assert decode_ids(text, ids[:-1]) is None and decode_ids(text[1:], ids) is None and decode_ids("*AA", ids) is None


def test_hues():
    rng = random.Random(1)
    for k in (1, 2, 5, 24, 60):
        out = separate_hues([rng.gauss(180, 20) % 360 for _ in range(k)])
        s = sorted(out)
        gap = min(10, 0.8 * 360 / k) if k > 1 else 0
        assert all((b - a) % 360 >= gap - 1e-6 for a, b in zip(s, [*s[1:], s[0] + 360])) or k == 1
    assert separate_hues([10.0, 100.0, 200.0]) == [10.0, 100.0, 200.0]


def test_formats():
    assert (money(3.456), money(1234), short_count(935), short_count(12_345), duration(59), duration(61), duration(7260)) == ("$3.46", "$1,234", "935", "12.3k", "59 s", "1 min 1 s", "2 h 1 min")


def test_sinks(spark, tmp_path):
    cards = spark.createDataFrame([(1, "a", 'T "q"', None, "Core.", {"pc1": "high"}), (2, "b", 'T "q"', "http://x", None, {})], "node_id long, id string, title string, url string, core string, notes map<string,string>")
    got = {r.filename: r.content for r in vault_entries(cards).collect()}
    assert set(got) == {"T q.md", "T q-2.md"} and 'title: "T \\"q\\""' in got["T q.md"] and "  pc1: high" in got["T q.md"] and 'url: "http://x"' in got["T q-2.md"]
    told = vault_entries(cards.withColumn("region", F.when(F.col("node_id") == 1, 'Old "stones"'))).collect()
    assert sum('\nregion: "Old \\"stones\\""\n' in r.content for r in told) == 1 and sum("region:" in r.content for r in told) == 1
    write_vault(cards, str(tmp_path / "v"), "t")
    assert sorted(os.listdir(tmp_path / "v")) == ["T q-2.md", "T q.md", "atlaspark-vault.json"]
    write_lines(cards, str(tmp_path / "l"), "id", "core")
    assert sorted(json.loads(r.value)["id"] for r in spark.read.text(str(tmp_path / "l")).collect()) == ["a", "b"]
    write_parts({"nodes": cards.select("node_id")}, str(tmp_path / "p"), [{"name": "x"}])
    assert spark.read.parquet(str(tmp_path / "p" / "nodes")).count() == 2


def test_evaluation(spark):
    knn = spark.createDataFrame([(i, (i + d) % 40) for i in range(40) for d in (2, 4)], "src long, dst long")
    perfect = spark.createDataFrame([(i, f"l{i % 2}") for i in range(40)], "node long, label string")
    p = label_precision(knn, perfect)
    assert p.count() == 40 and p.where("score < 1").count() == 0
    assert scalar_difference(knn, spark.createDataFrame([(i, 1.0) for i in range(20)], "node long, v double")).where("score > 0").count() == 0
    rng = np.random.default_rng(0)
    x = rng.random(274)
    a = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "node long, score double")
    b = spark.createDataFrame([(i, float(v + 0.2)) for i, v in enumerate(x)] + [(9999, None)], "node long, score double")
    diff, lo, hi, n = paired_bootstrap(b, a)
    assert abs(diff - 0.2) < 1e-9 and abs(lo - 0.2) < 1e-6 and n == 274
    noise = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x + rng.normal(0, 0.3, 274))], "node long, score double")
    _, lo, hi, _ = paired_bootstrap(noise, a)
    assert lo < 0 < hi and paired_bootstrap(a.limit(0), b) is None
    pts = spark.createDataFrame([([float(c * 10 + e), float(c * -7)],) for c in range(3) for e in (0, 0.1, 0.2, 0.3)], "v array<double>")
    assert kmeans_elbow(pts, "v", [1, 2, 3, 4, 5, 6])[0] == 3


def test_build(spark):
    from atlaspark.plans.build import build_map, check_map, descend, embed_cached, report

    words = ["storm cloud rain wind sleet gale", "bread flour yeast oven crust crumb"]
    rng = random.Random(2)
    rows = [(f"f/{i:03d}.md", f"{i:03d}.md", f"# Note {i}\n" + " ".join(rng.choice(words[i % 2].split()) for _ in range(70)) + ".", '{"score": 1}') for i in range(60)]
    m = build_map(spark.createDataFrame(rows, "path string, name string, text string, meta string"), kmax=4)
    check_map(m)
    assert m["docs"].count() == 60 and {r.node_id for r in m["docs"].select("node_id").collect()} == set(range(60))
    top = m["ladder"].where("level = 0").collect()
    assert len({(r.region, r.node_id % 2) for r in top}) == 2
    assert "## Regions" in report(m)
    child = descend(m, m["docs"].where("node_id % 2 = 0").select("node_id"), 3)
    check_map(child)
    assert child["docs"].count() == 30
    for bad in (spark.createDataFrame([(1,), (999,)], "node_id long"), spark.createDataFrame([(1,)], "node_id long")):
        try:
            descend(m, bad)
            raise AssertionError("not refused")
        except ValueError:
            pass
    texts = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, None)], "id long, t string")
    vecs, fresh = embed_cached(texts, "id", "t", None)
    assert vecs.count() == 3 and fresh.count() == 2
    assert embed_cached(texts, "id", "t", fresh)[1].count() == 0


def test_entry(spark):
    import __spark_entry__ as e

    names, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(names) and len(names) > 70
    assert e.entry(spark).limit(1).count() == 1


def test_assembled_corpus_is_whole(spark, tmp_path):
    from atlaspark.operators.parse import assemble
    from atlaspark.queries.common import files
    from atlaspark.queries.corpus import assembled_corpus

    rows = [(i, 1, f"v/{i}.md", f"{i}.md", f"# Note {i}\n" + f"word{i} " * 60, '{"score": 3}') for i in range(620)]
    spark.createDataFrame([*rows, rows[3]], "file_id long, map_id int, path string, name string, text string, meta string").write.parquet(str(tmp_path / "ingest_files.parquet"))
    got = [r.file_id for r in assembled_corpus(spark, str(tmp_path)).collect()]
    assert sorted(got) == list(range(620))
    assert {r.file_id for r in assemble(files(spark, str(tmp_path)), limit=7, order="file_id").collect()} == set(range(7))
