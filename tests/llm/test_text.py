"""Splitting, near-duplicates, packing, mixing and subjects against brute force and invariants."""

import os
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from atlaspark.llm import mixing, neardup, packing, split, subjects
from atlaspark.llm.tokens import encode

WORDS = "amber birch cedar delta ember fjord grove heath inlet jetty knoll ledge marsh north ocean plain quarry ridge shore tundra".split()


# --- splitting ---------------------------------------------------------------------------------------------------------


def check_pieces(text, limit, overlap):
    ps = split.split_text(text, limit, overlap)
    assert "".join(text[b:e] for _, b, e in ps) == text
    assert all(e - s <= limit and s <= b < e for s, b, e in ps)
    return ps


@settings(max_examples=150, deadline=None)
@given(st.text("ab .\n!é。", max_size=900), st.integers(20, 120))
def test_split_loses_nothing(text, limit):
    check_pieces(text, limit, limit // 10)


def test_split_boundaries():
    para = "One sentence here. Another follows it now.\n\n"
    text = para * 60
    ps = check_pieces(text, 1200, 120)
    assert all(text[:e].endswith("\n\n") for _, _, e in ps[:-1])
    assert all(90 <= b - s <= 150 for s, b, _ in ps[1:])
    assert len(ps) == -(-(len(text) - 120) // 1080)
    words = "word " * 700
    assert all(words[e - 1] == " " for _, _, e in check_pieces(words, 1200, 120)[:-1])
    assert all(e - s <= 1200 for s, _, e in check_pieces("x" * 5000, 1200, 120))
    assert split.split_text("") == [] and split.split_text("a" * 1200) == [(0, 0, 1200)]
    with pytest.raises(ValueError):
        split.split_text("a" * 50, 10, 5)


def test_split_table(spark):
    df = spark.createDataFrame([(1, "a b " * 400, "x"), (2, None, "x"), (3, "", "x"), (4, "short", "x"), (None, "z " * 900, "x"), (1, "a b " * 400, "x")], "node_id long, cores string, piece string")
    rows = split.split_oversized(df, "node_id", "cores").collect()
    assert {r.node_id for r in rows} == {1, None} and max(len(r.piece) for r in rows) <= 1200
    assert split.split_oversized(df.limit(0), "node_id", "cores").count() == 0


# --- near-duplicates -----------------------------------------------------------------------------------------------------


def brute_groups(rows, size, threshold, least):
    sets = {}
    for k, t in rows:
        w = re.findall(r"[^\W_]+", (t or "").lower())
        if k is not None and len(w) >= max(least, size):
            sets[k] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ks = sorted(sets)
    for i, a in enumerate(ks):
        for b in ks[i + 1 :]:
            if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    groups = defaultdict(list)
    for k in ks:
        groups[find(k)].append(k)
    return {k: min(g) for g in groups.values() if len(g) > 1 for k in g}


def edited(rng, words, share):
    return [rng.choice(WORDS) + str(rng.randint(0, 99)) if rng.random() < share else w for w in words]


@pytest.mark.parametrize("size,threshold", [(3, 0.5), (5, 0.8)])
def test_near_duplicates(spark, size, threshold):
    rng = random.Random(5)
    rows, k = [], 0
    for g in range(40):
        base = [rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(60)]
        for _ in range(rng.choice([1, 1, 2, 5])):
            rows.append((k, " ".join(edited(rng, base, rng.choice([0.0, 0.02, 0.05, 0.3])))))
            k += 1
    hot = [rng.choice(WORDS) for _ in range(80)]
    rows += [(1000 + i, " ".join(edited(rng, hot, 0.02))) for i in range(120)]  # a hot group, most of it unlike each other by little
    rows += [(2000 + i, " ".join(hot)) for i in range(50)]  # copies
    rows += [(3000, None), (3001, ""), (3002, "too few words here"), (3003, "too few words here"), (3004, "long " * 30000), (3005, "long " * 30000)]
    df = spark.createDataFrame(rows, "node_id long, cores string").withColumn("rep", F.lit(1)).withColumn("band", F.lit("x"))
    members, links = neardup.near_duplicates(df, "node_id", "cores", size, threshold)
    assert {r.node_id: r.group_id for r in members.collect()} == brute_groups(rows, size, threshold, 8)
    assert links.where(f"similarity < {threshold}").count() == 0


def boilerplate(n=300):
    """Texts that share a long stock passage and nothing else: a similarity of some 0.45."""
    rng = random.Random(9)
    stock = [rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(64)]
    return [(i, " ".join(stock + [f"w{i}x{j}" for j in range(38)])) for i in range(n)] + [(9000 + i, " ".join(stock + [f"w0x{j}" for j in range(38 - i)])) for i in range(3)]


@pytest.mark.parametrize("tile", [512, 64])
def test_stock_passages_do_not_yield_all_pairs(spark, monkeypatch, tile):
    monkeypatch.setattr(neardup, "TILE", tile)
    rows = boilerplate()
    df = spark.createDataFrame(rows, "node_id long, cores string")
    members, _ = neardup.near_duplicates(df, "node_id", "cores", 3, 0.5)
    assert {r.node_id: r.group_id for r in members.collect()} == brute_groups(rows, 3, 0.5, 8) == {0: 0, 9000: 0, 9001: 0, 9002: 0}


def test_a_tile_yields_a_forest():
    rows = boilerplate(200) + [(5000 + i, "stock words of one more text that is near another one and again the same " + f"end{i}") for i in range(100)]
    at, n, values = neardup.shingle_sets([t for _, t in rows], 3, 8, neardup._Words())
    _, sk = neardup.signatures(n, values)
    sets = np.split(values, np.cumsum(n)[:-1])
    got = neardup.tile_links(np.array([k for k, _ in rows]), np.ascontiguousarray(sk).view(np.uint64), sets, 0.5)
    assert len(got) == 99 + 3 and all((a in range(5000, 6000)) == (b in range(5000, 6000)) for a, b in got)


def test_a_wrong_sketch_loses_no_link(spark, monkeypatch):
    # sketches that call everything alike make every tree edge doubtful
    rows = boilerplate(24) + [(100 + i, " ".join(f"z{j}" for j in range(40)) + f" end{i}") for i in range(12)]
    monkeypatch.setattr(neardup, "estimate", lambda x: np.ones_like(x, dtype=float))
    members, _ = neardup.near_duplicates(spark.createDataFrame(rows, "node_id long, cores string"), "node_id", "cores", 3, 0.5)
    assert {r.node_id: r.group_id for r in members.collect()} == brute_groups(rows, 3, 0.5, 8)


def test_rows_of_one_key_that_differ(spark):
    a, b, c = (" ".join(f"{x}{j}" for j in range(20)) for x in "abc")
    df = spark.createDataFrame([(1, a), (1, b), (2, a), (3, b), (4, c), (4, c), (None, c), (5, c)], "node_id long, cores string")
    got = {r.node_id: r.group_id for r in neardup.near_duplicates(df, "node_id", "cores", 3, 0.5)[0].collect()}
    assert got in ({1: 1, 2: 1, 4: 4, 5: 4}, {1: 1, 3: 1, 4: 4, 5: 4})


def test_near_duplicates_empty(spark):
    df = spark.createDataFrame([], "node_id long, cores string")
    assert neardup.near_duplicates(df, "node_id", "cores")[0].count() == 0


def test_odd_sketch_estimates():
    rng = np.random.default_rng(0)
    for j in (0.5, 0.8, 0.95):
        est = []
        for _ in range(40):
            u = rng.integers(0, 2**32, 400, dtype=np.uint32)
            n = int(400 * (1 - j) / 2)
            a, b = u[: 400 - n], np.r_[u[:0], u[n:]]
            _, sk = neardup.signatures(np.array([len(a), len(b)]), np.r_[a, b])
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            est.append(neardup.estimate(np.bitwise_count(sk[0] ^ sk[1]).sum()) - true)
        assert abs(np.mean(est)) < 0.04 and np.std(est) < 0.1


# --- packing ---------------------------------------------------------------------------------------------------------------


def test_packing(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.choice([0, 3, 10, 40, 120])))) for i in range(300)]
    rows += [(500, None), (501, "ocean " * 1000), (502, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit(9)).withColumn("place", F.lit("x"))
    got = packing.pack(df, "doc_id", "text", capacity=128, shard=100).collect()
    need = {k: len(encode(t)) for k, t in rows}
    tokens, boxes = defaultdict(int), defaultdict(list)
    for r in got:
        tokens[r.doc_id] += r.n_tokens
        boxes[r.container_id].append(r)
    assert dict(tokens) == need and all(sum(x.n_tokens for x in b) == b[0].used <= 128 for b in boxes.values())
    assert all(sorted(x.place for x in b) == list(range(len(b))) for b in boxes.values())
    assert {r.doc_id for r in got if r.piece > 0} == {k for k, n in need.items() if n > 128}
    assert sum(tokens.values()) / (128 * len(boxes)) > 0.95
    assert packing.pack(df.limit(0), "doc_id", "text").count() == 0


def test_bm25_ranks_by_hand():
    t = [np.array(sorted(x), np.uint32).tobytes() for x in ([1, 2], [1, 3], [4, 5], [1, 2, 6])]
    index = packing.Index(t, [np.ones(len(x) // 4, np.uint8).tobytes() for x in t])
    s = index.scores(0)
    assert s[0] > s[3] > s[1] > s[2] == 0
    n, df, avg = 4, {1: 3, 2: 2}, 9 / 4
    by_hand = sum(np.log(1 + (n - d + 0.5) / (d + 0.5)) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 3 / avg)) for d in df.values())
    assert abs(s[3] - by_hand) < 1e-5


def test_shards_hold_lexical_neighbours(spark):
    rng = random.Random(8)
    topics = [[f"{a}{b}" for b in WORDS for a in (chr(97 + t) * 3,)] for t in range(8)]
    rows = [(i, " ".join(rng.choice(topics[i % 8] + WORDS[:4]) for _ in range(60))) for i in range(1600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    items = packing.token_items(df, "doc_id", "text").cache()
    stats = packing.item_stats(items)
    got = items.collect()
    assert stats.n == 1600 and stats.mean == sum(sum(r.tfs) for r in got) / 1600
    have = defaultdict(int)
    for r in got:
        for t in np.frombuffer(r.terms, np.uint32):
            have[int(t)] += 1
    assert {t: int(stats.df[t]) for t in have} == dict(have)
    packed = packing.pack(df, "doc_id", "text", shard=100).collect()
    index = packing.Index([r.terms for r in got], [r.tfs for r in got], stats)
    box = {r.doc_id: r.container_id.rsplit("-", 1)[0] for r in packed}
    near = [(i, j) for i in range(0, 1600, 20) for j in np.argsort(-index.scores(i))[1:9]]
    assert sum(box[got[i].doc_id] == box[got[j].doc_id] for i, j in near) > 0.3 * len(near)
    pure = defaultdict(set)
    for r in packed:
        pure[r.container_id].add(r.doc_id % 8)
    assert np.mean([len(x) for x in pure.values()]) < 1.5


# --- mixing --------------------------------------------------------------------------------------------------------------------


def test_pfair():
    for shares in ([0.5, 0.3, 0.2], [0.9, 0.05, 0.05], [1.0], [0.2, 0.15, 0.12, 0.13, 0.06, 0.1, 0.08, 0.06, 0.06, 0.04]):
        slots = mixing.slots_per_period(shares, 1000)
        plan = mixing.pfair(slots)
        period = sum(slots)
        assert sorted(x for p in plan for x in p) == list(range(period))
        for n, p in zip(slots, plan):
            done = np.searchsorted(p, np.arange(1, period + 1), "left")
            assert np.abs(done - np.arange(1, period + 1) * n / period).max() < 1


def test_quotas():
    goals = {"a": (0.5, 1), "b": (0.3, 2), "c": (0.2, 3)}
    have = {"a": 1000, "b": 100, "c": 1000}
    assert mixing.quotas_for(goals, have, None) == {"a": 333, "b": 200, "c": 133}
    # b gives all it may, the others share the rest by weight; a second one may be exhausted by that
    assert mixing.quotas_for(goals, have, 1600) == {"b": 200, "a": 1000, "c": 400}
    assert mixing.quotas_for(goals, have, 10**9) == {"a": 1000, "b": 200, "c": 3000}
    assert mixing.slots_per_period([0.06, 0.13, 0.81]) == [6, 13, 81]


@pytest.mark.parametrize("tokens", [None, 40000])
def test_mix(spark, tokens):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 60))), "abc"[min(2, i % 10)] if i % 50 else None) for i in range(1500)]
    rows += [(9000, None, "a"), (9001, "", "b"), (9002, "long " * 900, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("m", F.lit(1)).withColumn("slot", F.lit("x"))
    targets = spark.createDataFrame([("a", 0.6, 2), ("b", 0.3, 2), ("c", 0.1, 1), ("gone", 0.5, 1), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    out, rep = mixing.mix(df, targets, block=64, tokens=tokens)
    got, report = out.collect(), {r.source: r for r in rep.collect()}
    total = sum(r.n_tokens for r in got)
    size = {r.doc_id: r.n_tokens for r in mixing.count_tokens(df.where("doc_id is not null"), "doc_id", "text").collect()}
    for s, w, m in (("a", 0.6, 2), ("b", 0.3, 2), ("c", 0.1, 1)):
        mine = sorted((r for r in got if r.source == s), key=lambda r: r.at)
        assert sum(r.n_tokens for r in mine) == report[s].tokens_used == report[s].tokens_wanted
        if tokens is None:
            assert abs(report[s].tokens_used - w * total) < 3 and not report[s].capped
        at, pieces = 0, defaultdict(int)
        for r in mine:  # the source's stream without gap, no piece beyond its block
            assert r.at == at and r.at // 64 == (r.at + r.n_tokens - 1) // 64 and r.start == pieces[r.doc_id, r.repeat_no]
            at += r.n_tokens
            pieces[r.doc_id, r.repeat_no] += r.n_tokens
        assert all(n <= size[d] and k < m for (d, k), n in pieces.items()) and sum(n < size[d] for (d, _), n in pieces.items()) <= 1
    assert report["gone"].tokens_used == 0 and report["gone"].capped
    assert tokens is None or (total == 40000 and report["a"].capped and report["a"].tokens_used == 2 * report["a"].tokens_available)
    by, n = defaultdict(lambda: defaultdict(int)), 0
    for r in got:
        by[r.slot][r.source] += r.n_tokens
    assert all(len(v) == 1 and sum(v.values()) <= 64 for v in by.values())
    share, run = {s: report[s].tokens_used / total for s in "abc"}, defaultdict(int)
    for slot in sorted(by):
        n += sum(by[slot].values())
        run[next(iter(by[slot]))] += sum(by[slot].values())
        assert all(abs(run[s] - share[s] * n) < 64 for s in share)
    assert mixing.mix(df.limit(0), targets)[0].count() == 0 and mixing.mix(df, targets.limit(0))[1].count() == 0


@pytest.mark.parametrize("sf", ["0.001", "0.01", "0.1"])
def test_shares_at_every_size(spark, sf):
    path = f"/root/testdata/sf{sf}"
    if not os.path.exists(path):
        pytest.skip("no test data")
    got = mixing.p7_kept(spark, path).collect()
    assert got and all(r.share_kept and r.repeats_kept for r in got)


# --- subjects -------------------------------------------------------------------------------------------------------------------


def test_sentences():
    text = '---\ntitle: "x"\n---\n# Head line\n\nFirst one here. Second "ends" there! Is it so? It is.\n\n```\ncode here\n```\n- item one two\n- item three four\n\nlast [link text](https://a.example/b) here'
    got = [" ".join(s) for s in subjects.sentences(text)]
    assert got == ["first one here", "second ends there", "item one two", "item three four", "last link text here"] or got[2].startswith("so")
    assert not any("code" in s or "head" in s or "example" in s for s in got)
    assert subjects.sentences("") == [] and subjects.sentences("## only\n") == []


def test_subjects(spark):
    rng = random.Random(6)
    themes = {"law": "court judge statute", "sport": "goal team coach", "music": "choir fugue sonata", "cooking": "flour oven broth", "science": "comet photon lemma"}
    themes = {k: [w + e for w in v.split() for e in ("", "like", "wise", "hood", "ship", "dom")] for k, v in themes.items()}
    filler = [a + b for a in WORDS for b in ("ing", "er", "y")]

    def sentence(subject):
        own = rng.sample(themes[subject], 2) if subject else []
        return " ".join(rng.sample(own + rng.sample(filler, 6), len(own) + 6)).capitalize() + "."

    rows, labels, truth = [], [], {}
    for i in range(1500):
        a, b = rng.sample(list(themes), 2)
        kind = rng.random()
        plan = [a] * 6 + [None] * 3 if kind < 0.6 else [a] * 4 + [b] * 4 + [None] * 2 if kind < 0.8 else [a] * 9 + [b] + [None] * 3 if kind < 0.9 else [None] * 8
        rng.shuffle(plan)
        truth[i] = {s for s in plan if s and plan.count(s) >= 0.2 * len(plan)}
        rows.append((i, "# Heading judge court\n\n" + " ".join(map(sentence, plan)), "en"))
        if i % 6 == 0:
            labels += [(i, s) for s in truth[i]]
    rows += [(5000, None, None), (5001, "", "en"), (5002, "stub", "en"), (5003, "court judgelike. " * 20000, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("subject", F.lit("x")).withColumn("codes", F.lit(1))
    areas = spark.createDataFrame([("law", "court and statute"), ("sport", "team and match"), ("music", None), ("cooking", "flour"), ("science", "comet")], "subject string, descr string")
    lab = spark.createDataFrame(labels, "doc_id long, subject string")
    got = defaultdict(set)
    for r in subjects.subjects_of(df, areas, lab, leaves=8).collect():
        got[r.doc_id].add(r.subject)
    hits = sum(len(got[i] & truth[i]) for i in truth)
    assert hits / sum(len(got[i]) for i in truth) > 0.95 and hits / sum(map(len, truth.values())) > 0.95
    assert got[5000] == got[5001] == got[5002] == set() and got[5003] == {"law"}
    assert subjects.subjects_of(df.limit(0), areas, lab).count() == 0 and subjects.subjects_of(df, areas.limit(0), lab).count() == 0
