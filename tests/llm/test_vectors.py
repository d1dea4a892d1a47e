"""The neighbour graph and the spectral clusters against brute force."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from atlaspark.llm import neighbours, spectral

DIM = 32


@pytest.fixture(scope="module")
def world():
    """Clusters of many sizes, one of them a third of all, loose points, copies and unusable vectors."""
    rng = np.random.default_rng(0)
    parts = []
    for n in [500, 120, 60, *[12] * 10, *[3] * 20, *[2] * 30, *[1] * 300]:
        c = rng.standard_normal(DIM)
        c /= np.linalg.norm(c)
        x = c + 0.32 * rng.standard_normal((n, DIM)) / np.sqrt(DIM)
        parts.append(x * rng.uniform(0.5, 2, (n, 1)))
    x = np.concatenate(parts)
    x = np.concatenate([x, x[:1].repeat(20, axis=0)])  # copies
    return x[rng.permutation(len(x))].astype(np.float32)


def frame(spark, x):
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(90001, None), (90002, []), (90003, [0.0] * DIM), (90004, [1.0] * 5), (90005, [float("nan")] * DIM), (None, [1.0] * DIM), rows[7]]
    return spark.createDataFrame(rows, "node_id long, vec array<float>").withColumn("h", F.lit(3)).withColumn("id", F.lit("x"))


def cosines(x):
    u = x.astype(float) / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    return s


def test_neighbour_pairs(spark, world):
    s = cosines(world)
    want = set()
    for i in range(len(world)):
        for j in sorted(range(len(world)), key=lambda j: (-round(s[i, j], 6), j))[:8]:
            if s[i, j] >= 0.7:
                want.add((min(i, j), max(i, j)))
    got = {(r.a_id, r.b_id) for r in neighbours.neighbour_pairs(frame(spark, world), "node_id", "vec", 8, 0.7, DIM).collect()}
    assert len(got & want) / len(want) >= 0.97 and len(got & want) / len(got) >= 0.97
    assert all(s[a, b] >= 0.699 for a, b in got)
    empty = frame(spark, world).limit(0)
    assert neighbours.neighbour_pairs(empty, "node_id", "vec", 8, 0.7, DIM).count() == 0


def test_a_join_loses_no_neighbour(spark):
    # one dense group with exact lists: hubs on many lists, whose own neighbours must stay
    k, rng = 4, np.random.default_rng(6)
    x = (np.ones(DIM) + 0.5 * rng.standard_normal((800, DIM))).astype(np.float32)
    vectors, _ = neighbours.classes(neighbours.unit_vectors(plain(spark, x), "node_id", "vec", DIM))
    keyed = vectors.select((F.col("h").bitwiseAND((1 << 40) - 1)).alias("h"), "v").cache()
    lists = neighbours.cell_lists(keyed.select(F.lit(0).cast("long").alias("cell"), "h", "v"), k, 0.0)
    exact = neighbours.cut(neighbours.merge_lists(lists.withColumn("old", F.lit(False)), k))
    joined = neighbours.local_join(exact, keyed, k, 0.0).withColumn("old", F.lit(False))
    after = neighbours.merge_lists(exact.select("h", "nbr", "sim", F.lit(True).alias("old")).union(joined), k, anew=True)
    before, got = ({(r.h, n) for r in g.collect() for n in r.nbr} for g in (exact, after))
    assert len(before) == 800 * k and before == got and not any(any(r.fresh) for r in after.collect())


def test_the_descent_mends_poor_lists(spark, monkeypatch, capsys):
    # cells of some 16 rows, each row in two of them: most neighbours have to come from the rounds
    monkeypatch.setattr(neighbours, "CELL", 8)
    monkeypatch.setattr(neighbours.Cells.__init__, "__defaults__", (1, 2, 7))
    rng = np.random.default_rng(8)
    z = rng.standard_normal((1500, 6)) @ rng.standard_normal((6, DIM))
    x = (z + 0.05 * rng.standard_normal(z.shape)).astype(np.float32)
    s = cosines(x)
    k = 10
    want = {i: set(np.argsort(-s[i])[:k].tolist()) for i in range(len(x))}
    vectors, members = neighbours.classes(neighbours.unit_vectors(plain(spark, x), "node_id", "vec", DIM))
    by_hash, graphs = {r.h: r.id for r in members.collect()}, []
    _, keyed, _ = neighbours.neighbour_graph(vectors, k, -1.0, seen=graphs.append)
    name = {r.h: by_hash[r.hash] for r in keyed.select("h", "hash").collect()}
    recall = [sum(len(want[name[r.h]] & {name[n] for n in r.nbr}) for r in g.collect()) / (k * len(x)) for g in graphs]
    with capsys.disabled():
        print("recall per round", [round(r, 3) for r in recall])
    assert recall[0] < 0.75 and recall[-1] >= 0.97 and len(recall) >= 4


def test_copies_only(spark):
    df = spark.createDataFrame([(i, [1.0] * DIM) for i in range(30)], "node_id long, vec array<float>")
    got = {(r.a_id, r.b_id) for r in neighbours.neighbour_pairs(df, "node_id", "vec", 3, 0.7, DIM).collect()}
    assert got == {(min(i, j), max(i, j)) for i in range(30) for j in [k for k in range(30) if k != i][:3]}


def test_hot_cells_are_cut(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL", 32)
    monkeypatch.setattr(neighbours, "OVERSIZE", 64)
    rng = np.random.default_rng(3)
    x = (np.ones(DIM) + 0.2 * rng.standard_normal((600, DIM))).astype(np.float32)
    vectors, _ = neighbours.classes(neighbours.unit_vectors(frame(spark, x), "node_id", "vec", DIM))
    cells = neighbours.Cells(vectors, vectors.count(), 2, 2)
    assert any(b.any() for b in cells.bits)
    sizes = [r["count"] for r in cells.rows(vectors).groupBy("cell").count().collect()]
    assert max(sizes) < 200 and cells.rows(vectors).count() == 4 * 600 and cells.rows(vectors).select("h").distinct().count() == 600


def test_search_of_vectors_outside(spark, world):
    held = np.arange(len(world)) % 10 == 3
    s = cosines(world)
    df = frame(spark, world)
    inside, outside = df.where("node_id is null or node_id % 10 <> 3"), df.where("node_id % 10 = 3 or node_id > 90000")
    by = defaultdict(dict)
    for r in neighbours.graph_search(inside, outside, "node_id", "vec", 8, DIM).collect():
        by[r.query][r.id] = r.sim
    hit = want = 0
    for q in np.flatnonzero(held):
        top = [j for j in np.argsort(-np.where(held, -2, s[q]))[:8] if s[q, j] >= 0.7]
        want += len(top)
        hit += min(len(top), sum(1 for j in by[q] if top and s[q, j] >= s[q, top[-1]] - 1e-3))
        assert not any(held[j] for j in by[q])
    assert want and hit / want >= 0.9 and not set(by) & set(range(90001, 90006))


def test_vector_clusters(spark, world):
    s = cosines(world)
    seen, want = set(), {}
    for i in range(len(world)):
        if i not in seen:
            group, todo = {i}, [i]
            while todo:
                for j in np.flatnonzero(s[todo.pop()] >= 0.7):
                    if j not in group:
                        group.add(int(j))
                        todo.append(int(j))
            seen |= group
            if len(group) > 1:
                want |= {k: min(group) for k in group}
    got = {r.member_id: r.cluster_id for r in spectral.vector_clusters(frame(spark, world), "node_id", "vec", 0.7, DIM).collect()}
    assert sum(got.get(k) == v for k, v in want.items()) >= 0.97 * len(want) and len(set(got) - set(want)) <= 0.01 * len(want)
    assert spectral.vector_clusters(frame(spark, world).limit(0), "node_id", "vec", 0.7, DIM).count() == 0


def test_near_copies_do_not_hide_links(spark):
    rng = np.random.default_rng(5)
    q = np.linalg.qr(rng.standard_normal((DIM, DIM)))[0]
    groups = [np.sqrt(0.76) * q[0] + np.sqrt(0.24) * q[1 + g] for g in range(20)]
    x = np.concatenate([g + 0.03 * rng.standard_normal((8, DIM)) / np.sqrt(DIM) for g in groups]).astype(np.float32)
    got = {r.member_id: r.cluster_id for r in spectral.vector_clusters(spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "node_id long, vec array<float>"), "node_id", "vec", 0.7, DIM).collect()}
    assert got == {i: 0 for i in range(160)}


def test_spanning_links_keep_every_component(world):
    x = neighbours.coarse(world / np.linalg.norm(world, axis=1, keepdims=True)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    (r, c, v), (a, b, w) = spectral.spanning_links(x, 2, 0.7, block=64)
    s = cosines(world)
    assert np.allclose(s[a, b], w, atol=0.005) and np.bincount(r).max() <= 2 and len(a) < (s >= 0.7).sum() / 4
    n, exact = np.arange(len(x)), s[a, b] >= 0.7
    assert (spectral._merged(n, a[exact], b[exact]) == spectral._merged(n, *np.nonzero(s >= 0.7))).all()


def test_power_iteration_is_the_formula(spark):
    edges = [(1, 2, 1.0), (2, 3, 0.5), (4, 5, 2.0)]
    both = edges + [(b, a, w) for a, b, w in edges]
    aff = spark.createDataFrame(both, "node long, other long, w double")
    x0 = {i: np.random.default_rng(i).standard_normal(spectral.DIMS).astype(np.float32) for i in range(1, 6)}
    start = spark.createDataFrame([(i, v.tobytes()) for i, v in x0.items()], "node long, x binary")
    got = {r.node: np.frombuffer(r.x, np.float32) for r in spectral.power_iteration(start, aff, lambda c: F.pmod(F.col(c), F.lit(2)), 3).collect()}
    a = np.zeros((5, 5))
    for i, j, w in both:
        a[i - 1, j - 1] = w
    x = np.stack([x0[i] for i in range(1, 6)]).astype(float)
    for _ in range(3):
        x = (a @ x + x) / (a.sum(1) + 1)[:, None]
    assert all(np.allclose(got[i], x[i - 1], atol=1e-5) for i in range(1, 6))


def test_label_clusters(spark):
    rows = [
        (1, "Notes on Amberquay, Micrograding Scaphoornis"), (2, "scaphoornis AMBERQUAYS of micrograding"), (3, "Amberqauy & Mícrograding / Scaphoornis Wickrigg"),
        (4, "Holgate riverpath microphilia"), (5, "Riverpath: Holgate, microphillia…"), (6, "Holgate something different"), (7, None), (8, ""), (9, "The of and"),
        (10, "Amberquay other thing entirely"), (11, "lone label standing here"), (1, "Notes on Amberquay, Micrograding Scaphoornis"),
    ] + [(100 + i, "repeated label words again") for i in range(60)]
    df = spark.createDataFrame(rows, "region_id long, label string").withColumn("h", F.lit(1)).withColumn("root", F.lit("x"))
    got = {r.member_id: r.cluster_id for r in spectral.label_clusters(df, "region_id", "label").collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4} | {100 + i: 100 for i in range(60)}
    assert spectral.label_clusters(df.limit(0), "region_id", "label").count() == 0
    d = spectral.describe(spark.createDataFrame([(1, 1, 2.0), (2, 1, 3.0), (3, 1, 3.0)], "node long, cluster long, inner double"), 2).first()
    assert d.size == 3 and d.typical == [2, 3]


@pytest.mark.parametrize("home", [4096, 64])
def test_vector_inner_is_the_whole_cluster(spark, world, monkeypatch, home):
    monkeypatch.setattr(spectral, "HOME", home)
    s = np.clip(cosines(world), -1, 1)
    got = spectral.vector_clusters(frame(spark, world), "node_id", "vec", 0.7, DIM).collect()
    by = defaultdict(list)
    for r in got:
        by[r.cluster_id].append(r)
    assert max(map(len, by.values())) > 64
    for members in by.values():
        ids = [r.member_id for r in members]
        for r in members:
            assert abs(r.inner - s[r.member_id, [i for i in ids if i != r.member_id]].sum()) < 1e-3 * len(ids)


def test_label_inner_is_the_whole_cluster(spark):
    words = ["amberquay", "holgate", "scaphoorn", "wickrigg", "tarnbeck", "riverpath"]
    sets = {1: [3, 4, 5], 2: [0, 1, 2], 3: [0, 1, 2, 3], 4: [0, 1, 2, 3, 4], 5: [0, 1, 2, 3, 4], 6: [2, 3, 4, 5], 7: [0, 1, 2]}
    df = spark.createDataFrame([(i, " ".join(words[w] for w in x)) for i, x in sets.items()], "region_id long, label string")
    got = {r.member_id: r.inner for r in spectral.label_clusters(df, "region_id", "label").collect()}
    both = {(a, b): len(set(sets[a]) & set(sets[b])) for a in sets for b in sets if a != b}
    assert got == {a: sum(n * (n - 1) * (n - 2) / 6 for (x, _), n in both.items() if x == a) for a in sets}


@pytest.mark.parametrize("a,b,same", [("abcdef", "abdcef", True), ("abcdef", "abcde", True), ("abcdef", "abxdef", True), ("abcdef", "abcdeff", True), ("abcdef", "badcef", False), ("abc", "abcde", False)])
def test_one_slip(a, b, same):
    assert spectral.one_slip(a, b) == same == spectral.one_slip(b, a)


def plain(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "node_id long, vec array<float>")


def test_two_tight_groups_of_more_than_k_are_one(spark):
    rng = np.random.default_rng(2)
    q = np.linalg.qr(rng.standard_normal((DIM, DIM)))[0]
    x = np.concatenate([np.sqrt(0.86) * q[0] + np.sqrt(0.14) * q[1 + g] + 0.02 * rng.standard_normal((10, DIM)) / np.sqrt(DIM) for g in range(2)])
    assert cosines(x)[~np.eye(20, dtype=bool)].min() > 0.8
    assert {r.cluster_id for r in spectral.vector_clusters(plain(spark, x), "node_id", "vec", 0.7, DIM).collect()} == {0}


def chained():
    """Two groups of 40 that nothing but one pair of a cosine above 0.70 links."""
    rng = np.random.default_rng(4)
    q = np.linalg.qr(rng.standard_normal((DIM, DIM)))[0]
    a, b = (q[g] + 0.45 * rng.standard_normal((40, DIM)) / np.sqrt(DIM) for g in range(2))
    a[0], b[0] = q[0] + 0.62 * q[1], q[1] + 0.62 * q[0]
    return np.concatenate([a, b])


def test_a_weak_cut_stands(spark, monkeypatch):
    x = chained()
    s = cosines(x)
    assert (s[:40, 40:] >= 0.7).sum() == 1 and ((s[:40, :40] >= 0.7).sum(1) > 1).all()
    got = {r.member_id: r.cluster_id for r in spectral.vector_clusters(plain(spark, x), "node_id", "vec", 0.7, DIM).collect()}
    # the pair's ends are alike, so they may come out on one side of the cut
    sides = [{got[i] for i in g} for g in (range(1, 40), range(41, 80))]
    assert len(got) == 80 and len(sides[0]) == len(sides[1]) == 1 and sides[0] != sides[1]
    # without the spectral step the pair would make them one
    monkeypatch.setattr(spectral, "kmeans", lambda e: e.select("node", F.lit(0).alias("part"), F.lit(0).alias("k")))
    assert {r.cluster_id for r in spectral.vector_clusters(plain(spark, x), "node_id", "vec", 0.7, DIM).collect()} == {0}


def test_one_piece_is_not_one_cluster(spark, world, monkeypatch):
    monkeypatch.setattr(spectral, "kmeans", lambda e: e.select("node", F.lit(0).alias("part"), F.lit(0).alias("k")))
    s = cosines(world)
    for r in spectral.vector_clusters(frame(spark, world), "node_id", "vec", 0.7, DIM).collect():
        assert s[r.member_id].max() >= 0.699


@pytest.mark.parametrize("home", [4096, 3])
def test_long_labels_and_many_of_one_combination(spark, monkeypatch, home):
    monkeypatch.setattr(spectral, "HOME", home)
    words = ["amberquay", "holgate", "scaphoorn", "wickrigg", "tarnbeck", "riverpath"]
    extra = [f"{a}{b}filler" for a in "bcdfghjklm" for b in "aeiou"]
    rows = [(i, f"amberquay holgate scaphoorn {extra[i]}") for i in range(20)]
    rows += [(30, " ".join(words[:3] + [e + "x" for e in extra])), (31, " ".join(words[3:] + ["zu" + e[::-1] for e in extra])), (32, " ".join(words[3:])), (33, " ".join(words[2:4]))]
    got = {r.member_id: r.cluster_id for r in spectral.label_clusters(spark.createDataFrame(rows, "region_id long, label string"), "region_id", "label").collect()}
    assert got == {i: 0 for i in [*range(20), 30]} | {31: 31, 32: 31}
