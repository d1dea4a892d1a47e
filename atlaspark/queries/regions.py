"""Queries of regions, joins, graphs and corpus statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.citations import frontier_keys, place_ghosts, remap_edges
from ..operators.knn import distance, exact_knn, recall
from ..operators.linear import vector_means
from ..operators.rank import rank_scores
from ..operators.regions import agreement, centroids, distinctive_axes, distinctive_terms, drill, fallback_label, hubs, hues, member_set_key, redundancy, term_counts, trajectory
from ..session import once, table
from .common import LADDER, RAW, D, V, cards, docs, ladder, raw_scores
from .corpus import TOKENS


def _groups(spark, sf_dir):
    return docs(spark, sf_dir).select("node_id", F.col("map_id").alias("region"))


def region_sizes(spark, sf_dir):
    return ladder(spark, sf_dir).groupBy("level", "region").agg(F.count("*").alias("n"))


def region_filter(spark, sf_dir):
    return ladder(spark, sf_dir).where("level = 1 and region = 5").select("node_id")


def visible_counts(spark, sf_dir):
    """How many nodes of each region pass a mask."""
    mask = F.coalesce(F.lower("title").contains("reading"), F.lit(False))
    return docs(spark, sf_dir).groupBy(F.col("map_id").alias("region")).agg(F.count_if(mask).alias("n_visible"), F.count("*").alias("n"))


def region_medians(spark, sf_dir):
    p = cards(spark, sf_dir).join(_groups(spark, sf_dir), "node_id").select("region", F.col("vec")[0].cast("double").alias("x"), F.col("vec")[1].cast("double").alias("y"))
    return centroids(p, "region", "x", "y")


def region_means(spark, sf_dir):
    p = cards(spark, sf_dir).join(_groups(spark, sf_dir), "node_id")
    return p.groupBy("region").agg(F.round(F.avg(F.col("vec")[0].cast("double")), 6).alias("x"), F.round(F.avg(F.col("vec")[1].cast("double")), 6).alias("y"))


def region_hues(spark, sf_dir):
    p = cards(spark, sf_dir).join(_groups(spark, sf_dir), "node_id").select("region", F.col("vec")[0].cast("double").alias("x"), F.col("vec")[1].cast("double").alias("y"))
    return hues(p, "region", "x", "y")


def region_terms(spark, sf_dir):
    t = distinctive_terms(docs(spark, sf_dir), _groups(spark, sf_dir), "node_id", "cores", "region")
    return t.select("region", "place", "term", F.round("score", 5).alias("score"))


def region_labels(spark, sf_dir):
    return fallback_label(distinctive_terms(docs(spark, sf_dir), _groups(spark, sf_dir), "node_id", "cores", "region"), "region")


def region_axes(spark, sf_dir):
    return distinctive_axes(rank_scores(raw_scores(spark, sf_dir), "raw", "node_id", ["pc"]), _groups(spark, sf_dir), "node_id", "region")


def explain_selection(spark, sf_dir):
    """What sets a held set apart: its terms against the corpus."""
    held = docs(spark, sf_dir).where("site_name is not null and lower(site_name) like '%notes%'").select("node_id", F.lit(0).alias("region"))
    return distinctive_terms(docs(spark, sf_dir), held, "node_id", "cores", "region").select("place", "term", F.round("score", 5).alias("score"))


def region_drill(spark, sf_dir):
    return drill(ladder(spark, sf_dir), 0, 1)


def member_sets(spark, sf_dir):
    """Regions of different levels that have the very same members."""
    k = member_set_key(ladder(spark, sf_dir).withColumn("r", F.concat_ws("/", "level", "region")), "node_id", "r")
    return k.groupBy("members_key").agg(F.count("*").alias("regions"), F.max("n").alias("n")).select("regions", "n")


def region_catalog(spark, sf_dir):
    """The region table itself: the most populous region of each map and level, first by region number."""
    r = once(table(spark, sf_dir, "regions"), "region_id")
    w = Window.partitionBy("map_id", "level").orderBy(F.desc("n"), "region")
    return r.withColumn("place", F.row_number().over(w)).where("place = 1").select("map_id", "level", "region", "n", F.coalesce(F.when(F.trim("label") != "", F.col("label")), F.lit("region")).alias("label"))


def exemplars(spark, sf_dir):
    """Per region the node that is in most neighbour lists, ties by the smaller node."""
    h = hubs(_knn(spark, sf_dir), _vecs(spark, sf_dir).select("node_id", "label"), "node_id").join(_vecs(spark, sf_dir).select("node_id", "label"), "node_id")
    w = Window.partitionBy("label").orderBy(F.desc("hub"), "node_id")
    return h.withColumn("r", F.row_number().over(w)).where("r = 1").select("label", "node_id", "hub")


def corpus_trajectory(spark, sf_dir):
    return trajectory(docs(spark, sf_dir), "date_ms", "map_id")


def axis_redundancy(spark, sf_dir):
    v = cards(spark, sf_dir).select(*[F.col("vec")[i].cast("double").alias(f"a{i + 1}") for i in range(4)])
    return redundancy(v, ["a1", "a2", "a3", "a4"])


def aligned_tables(spark, sf_dir):
    """Documents, cards and vectors joined by id, never by position."""
    d = docs(spark, sf_dir)
    c = d.where("cores is not null").select("node_id", F.length("cores").alias("chars"))
    return d.select("node_id", "title").join(c, "node_id").join(cards(spark, sf_dir).select("node_id", F.size("vec").alias("dim")), "node_id")


def citation_edges(spark, sf_dir):
    """Edges from each node to the first of its folder, both ends in the selection, self edges dropped."""
    d = docs(spark, sf_dir).where("folder is not null").select("node_id", "folder")
    first = d.groupBy("folder").agg(F.min("node_id").alias("dst"))
    e = d.join(first, "folder").select(F.col("node_id").alias("src"), "dst")
    return remap_edges(e, docs(spark, sf_dir).where("map_id <= 20").select("node_id"), "node_id")


def frontier(spark, sf_dir):
    """Keys outside the corpus by how often they are referred to: here the tags that are no folder of it."""
    d = docs(spark, sf_dir)
    return frontier_keys(d.select(F.explode("tags").alias("key")), d.select(F.col("folder").alias("key")))


def _vecs(spark, sf_dir):
    return once(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("node_id"), "embedding", "label"), "node_id")


def _knn(spark, sf_dir, k=8):
    return exact_knn(_vecs(spark, sf_dir), "node_id", "embedding", k)


def knn_exact(spark, sf_dir):
    k = _knn(spark, sf_dir)
    return k.select("src", "rank", "dst", F.round("sim", 4).alias("sim"), F.round(distance(F.col("sim")), 3).alias("dist"))


def neighbour_list(spark, sf_dir):
    v = _vecs(spark, sf_dir)
    return exact_knn(v, "node_id", "embedding", 8, queries=v.where("node_id = 17")).select("rank", "dst")


def hub_scores(spark, sf_dir):
    return hubs(_knn(spark, sf_dir), _vecs(spark, sf_dir), "node_id")


def layout_agreement(spark, sf_dir):
    """Mean number of 8-neighbours that two coordinates of a vector and three of it share."""
    v = _vecs(spark, sf_dir)
    flat = exact_knn(v.select("node_id", F.slice("embedding", 1, 2).alias("p")), "node_id", "p", 8, "l2")
    deep = exact_knn(v.select("node_id", F.slice("embedding", 1, 3).alias("p")), "node_id", "p", 8, "l2")
    return agreement(flat, deep, v.count())


def relatedness(spark, sf_dir):
    """Precision at 8 of the neighbours by label, the share of equal labels over all pairs, and the lift."""
    v = _vecs(spark, sf_dir).select("node_id", "label").where("label is not null")
    k = _knn(spark, sf_dir).join(v.select(F.col("node_id").alias("src"), F.col("label").alias("a")), "src").join(v.select(F.col("node_id").alias("dst"), F.col("label").alias("b")), "dst")
    per = k.groupBy("src").agg(F.avg((F.col("a") == F.col("b")).cast("double")).alias("p")).agg(F.avg("p").alias("observed"), F.count("*").alias("scored"))
    base = v.groupBy("label").agg(F.count("*").alias("m")).agg((F.sum(F.col("m") * (F.col("m") - 1)) / (F.sum("m") * (F.sum("m") - 1))).alias("baseline"))
    return per.crossJoin(base).where("scored >= 10").select("scored", F.round("observed", 6).alias("observed"), F.round("baseline", 6).alias("baseline"), F.round(F.col("observed") / F.col("baseline"), 5).alias("lift"))  # one row each


def knn_recall(spark, sf_dir):
    """Recall of neighbours by 32 of the coordinates against those by all."""
    v = _vecs(spark, sf_dir)
    r = recall(exact_knn(v.select("node_id", F.slice("embedding", 1, 32).alias("p")), "node_id", "p", 8), _knn(spark, sf_dir))
    return r.select("hits", "wanted", F.round("recall", 6).alias("recall"))


def ghost_placement(spark, sf_dir):
    """Outside vectors, here every tenth, placed at the weighted mean of their 6 nearest inside ones."""
    v = _vecs(spark, sf_dir).withColumn("x", F.col("embedding")[0].cast("double")).withColumn("y", F.col("embedding")[1].cast("double"))
    return place_ghosts(v.where("node_id % 10 = 0"), v.where("node_id % 10 <> 0"), "node_id", "embedding").withColumnRenamed("node_id", "src")


def mean_vector(spark, sf_dir):
    m = vector_means(cards(spark, sf_dir).select(F.lit(0).alias("g"), "vec"), "g", "vec", unit=False)
    return m.select(F.posexplode("mean").alias("i", "x")).select("i", F.round("x", 6).alias("mean"))


def semantic_query(spark, sf_dir):
    """Cosine of every card with the vector of one of them."""
    from ..functions.vector import cosine

    c = cards(spark, sf_dir)
    q = c.where(F.aggregate("vec", F.lit(0.0), lambda s, x: s + F.abs(x)) > 0).agg(F.min_by("vec", "node_id").alias("q"))
    return c.crossJoin(F.broadcast(q)).select("node_id", F.round(cosine(F.col("vec"), F.col("q")), 4).alias("sim")).where("sim is not null")  # one row


def derived_direction(spark, sf_dir):
    """Per dimension the mean of a selection's unit vectors less the mean of the rest's."""
    m = vector_means(cards(spark, sf_dir).select((F.col("node_id") % 5 == 0).alias("g"), "vec"), "g", "vec")
    e = m.select("g", F.posexplode("mean").alias("i", "x"))
    return e.groupBy("i").agg(F.round(F.sum(F.when(F.col("g"), F.col("x"))) - F.sum(F.when(~F.col("g"), F.col("x"))), 6).alias("d"))


def term_document_counts(spark, sf_dir):
    return term_counts(docs(spark, sf_dir), "node_id", "cores")


QUERIES = {f.__name__: f for f in (
    region_sizes, region_filter, visible_counts, region_medians, region_means, region_hues, region_terms, region_labels, region_axes, explain_selection, region_drill, member_sets, region_catalog,
    exemplars, corpus_trajectory, axis_redundancy, aligned_tables, citation_edges, frontier, knn_exact, neighbour_list, hub_scores, layout_agreement, relatedness, knn_recall, ghost_placement,
    mean_vector, semantic_query, derived_direction, term_document_counts,
)}

_PV = D + ", " + V + ", p AS (SELECT map_id AS region, vec[1]::DOUBLE AS x, vec[2]::DOUBLE AS y FROM v JOIN d USING (node_id))"


def _terms(groups: str) -> str:
    return f"""WITH {D}, t AS (SELECT node_id, unnest({TOKENS}) AS term FROM d), c AS (SELECT node_id, term, count(*) AS n FROM t GROUP BY ALL), g AS ({groups}),
      ix AS (SELECT term, sum(n) AS na, count(*) AS df FROM c GROUP BY term), sz AS (SELECT region, count(*) AS size FROM g GROUP BY region),
      i AS (SELECT region, term, sum(n) AS ni, count(*) AS di FROM c JOIN g USING (node_id) GROUP BY ALL), w AS (SELECT region, sum(ni) AS ti FROM i GROUP BY region),
      k AS (SELECT region, term, round(ln((ni / ti) / (na / (SELECT sum(n) FROM c)))* ln(1 + di), 6) AS score FROM i JOIN w USING (region) JOIN sz USING (region) JOIN ix USING (term) WHERE di >= least(2, size) AND df <= 0.6 * (SELECT count(*) FROM d)),
      r AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY score DESC, term)::INT AS place FROM k)"""


_ALL = "SELECT node_id, map_id AS region FROM d"
_E = "e AS (SELECT DISTINCT ON (vec_id) vec_id, embedding, label FROM embeddings)"


def _nn(k: int, expr: str = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))", name: str = "knn") -> str:
    return f"{name} AS (SELECT * FROM (SELECT a.vec_id AS src, b.vec_id AS dst, {expr} AS sim, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({expr}, 9) DESC, b.vec_id)::INT AS rank FROM e a JOIN e b ON a.vec_id <> b.vec_id) WHERE rank <= {k})"


def _l2(d: int) -> str:
    return "-sqrt(" + " + ".join(f"(a.embedding[{i}]::DOUBLE - b.embedding[{i}]::DOUBLE) ** 2" for i in range(1, d + 1)) + ")"


_P32 = "list_dot_product(a.embedding[1:32]::DOUBLE[], b.embedding[1:32]::DOUBLE[]) / sqrt(list_dot_product(a.embedding[1:32]::DOUBLE[], a.embedding[1:32]::DOUBLE[]) * list_dot_product(b.embedding[1:32]::DOUBLE[], b.embedding[1:32]::DOUBLE[]))"
_HUB = "h AS (SELECT e.vec_id AS node_id, e.label, count(k.src) AS hub FROM e LEFT JOIN knn k ON k.dst = e.vec_id GROUP BY ALL)"
_RANKS = RAW + ", s AS (SELECT node_id, pc, round(100.0::DOUBLE * (row_number() OVER (PARTITION BY pc ORDER BY raw, node_id) - 1) / (count(*) OVER (PARTITION BY pc) - 1))::INT AS score FROM raw)"
ORACLE = {
    "region_sizes": f"WITH {LADDER} SELECT level, region, count(*) AS n FROM ladder GROUP BY ALL",
    "region_filter": f"WITH {LADDER} SELECT node_id FROM ladder WHERE level = 1 AND region = 5",
    "visible_counts": f"WITH {D} SELECT map_id AS region, count(*) FILTER (contains(lower(title), 'reading')) AS n_visible, count(*) AS n FROM d GROUP BY 1",
    "region_medians": f"WITH {_PV}, o AS (SELECT region, list(x ORDER BY x) AS lx, list(y ORDER BY y) AS ly, count(*) AS n FROM p GROUP BY region) SELECT region, lx[1 + n // 2] AS cx, ly[1 + n // 2] AS cy FROM o",
    "region_means": f"WITH {_PV} SELECT region, round(avg(x), 6) AS x, round(avg(y), 6) AS y FROM p GROUP BY region",
    "region_hues": f"WITH {_PV} SELECT region, round(fmod(degrees(atan2(avg(y), avg(x))) + 360, 360), 4) AS hue FROM p GROUP BY region",
    "region_terms": _terms(_ALL) + " SELECT region, place, term, round(score, 5) AS score FROM r WHERE place <= 8",
    "region_labels": _terms(_ALL) + " SELECT region, string_agg(upper(term[1]) || substr(term, 2), ' / ' ORDER BY place) AS label FROM r WHERE place <= 2 GROUP BY region",
    "region_axes": f"WITH {_RANKS}, {D}, m AS (SELECT map_id AS region, pc, avg(score) AS m FROM s JOIN d USING (node_id) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY round(abs(m - 50), 9) DESC, pc)::INT AS place FROM m) SELECT region, place, pc, CASE WHEN m >= 50 THEN 'high' ELSE 'low' END AS pole, round(m)::INT AS mean FROM r WHERE place <= 4",
    "explain_selection": _terms("SELECT node_id, 0 AS region FROM d WHERE lower(site_name) LIKE '%notes%'") + " SELECT place, term, round(score, 5) AS score FROM r WHERE place <= 8",
    "region_drill": f"WITH {LADDER} SELECT level, count(DISTINCT region) AS regions FROM ladder WHERE level > 0 AND node_id IN (SELECT node_id FROM ladder WHERE level = 0 AND region = 1) GROUP BY level HAVING count(DISTINCT region) >= 2 ORDER BY level LIMIT 1",
    "member_sets": f"WITH {LADDER}, k AS (SELECT level, region, list(node_id ORDER BY node_id) AS m, count(*) AS n FROM ladder GROUP BY ALL) SELECT count(*) AS regions, max(n) AS n FROM k GROUP BY m",
    "region_catalog": "WITH r AS (SELECT DISTINCT ON (region_id) * FROM regions), p AS (SELECT *, row_number() OVER (PARTITION BY map_id, level ORDER BY n DESC NULLS LAST, region) AS place FROM r) SELECT map_id, level, region, n, CASE WHEN trim(label) <> '' THEN label ELSE 'region' END AS label FROM p WHERE place = 1",
    "exemplars": f"WITH {_E}, {_nn(8)}, {_HUB} SELECT label, node_id, hub FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY hub DESC, node_id) AS r FROM h) WHERE r = 1",
    "corpus_trajectory": f"WITH {D}, p AS (SELECT map_id, date_ms FROM d WHERE date_ms > 0), o AS (SELECT list(date_ms ORDER BY date_ms) AS l, count(*) AS n FROM p), h AS (SELECT map_id, date_ms <= l[1 + n // 2] AS early FROM p, o WHERE n >= 20), t AS (SELECT count(*) FILTER (early) AS e, count(*) FILTER (NOT early) AS l FROM h), g AS (SELECT map_id, coalesce(count(*) FILTER (early) / nullif(e, 0), 0)::DOUBLE AS early, coalesce(count(*) FILTER (NOT early) / nullif(l, 0), 0)::DOUBLE AS late FROM h, t GROUP BY map_id, e, l) SELECT map_id, round(early, 6) AS early, round(late, 6) AS late, round(late - early, 6) AS delta, CASE WHEN late - early > 0.008 THEN 'rising' WHEN late - early < -0.008 THEN 'cooling' ELSE 'steady' END AS trend FROM g",
    "axis_redundancy": f"WITH {V}, a AS (SELECT vec[1]::DOUBLE a, vec[2]::DOUBLE b, vec[3]::DOUBLE c, vec[4]::DOUBLE d FROM v), r AS (SELECT unnest([abs(corr(a, b)), abs(corr(a, c)), abs(corr(a, d)), abs(corr(b, c)), abs(corr(b, d)), abs(corr(c, d))]) AS r FROM a) SELECT count(*)::INT AS pairs, round(avg(r), 6) AS mean_abs_r, (count(*) FILTER (r >= 0.5))::INT AS strong_pairs, avg(r) < 0.3 AS passes FROM r",
    "aligned_tables": f"WITH {D}, {V} SELECT d.node_id, d.title, length(d.cores)::INT AS chars, len(v.vec)::INT AS dim FROM d JOIN v USING (node_id) WHERE d.cores IS NOT NULL",
    "citation_edges": f"WITH {D}, p AS (SELECT folder, min(node_id) AS dst FROM d WHERE folder IS NOT NULL GROUP BY folder) SELECT d.node_id AS src, p.dst FROM d JOIN p USING (folder) JOIN d x ON x.node_id = p.dst WHERE d.node_id <> p.dst AND d.map_id <= 20 AND x.map_id <= 20",
    "frontier": f"WITH {D}, k AS (SELECT unnest(tags) AS key FROM d) SELECT key, count(*) AS n FROM k WHERE key IS NOT NULL AND key NOT IN (SELECT folder FROM d WHERE folder IS NOT NULL) GROUP BY key ORDER BY n DESC, key LIMIT 500",
    "knn_exact": f"WITH {_E}, {_nn(8)} SELECT src, rank, dst, round(sim, 4) AS sim, round(sqrt(greatest(0, 2 * (1 - sim))), 3) AS dist FROM knn",
    "neighbour_list": f"WITH {_E}, {_nn(8)} SELECT rank, dst FROM knn WHERE src = 17",
    "hub_scores": f"WITH {_E}, {_nn(8)}, {_HUB} SELECT node_id, hub FROM h",
    "layout_agreement": f"WITH {_E}, {_nn(8, _l2(2), 'a2')}, {_nn(8, _l2(3), 'a3')} SELECT round(count(*) / (SELECT count(*) FROM e), 4) AS agree FROM a2 JOIN a3 USING (src, dst)",
    "relatedness": f"WITH {_E}, {_nn(8)}, k AS (SELECT src, avg((a.label = b.label)::INT) AS p FROM knn JOIN e a ON a.vec_id = src JOIN e b ON b.vec_id = dst GROUP BY src), o AS (SELECT avg(p) AS observed, count(*) AS scored FROM k), b AS (SELECT sum(m * (m - 1))::DOUBLE / (sum(m) * (sum(m) - 1)) AS baseline FROM (SELECT count(*) AS m FROM e WHERE label IS NOT NULL GROUP BY label)) SELECT scored, round(observed, 6) AS observed, round(baseline, 6) AS baseline, round(observed / baseline, 5) AS lift FROM o, b WHERE scored >= 10",
    "knn_recall": f"WITH {_E}, {_nn(8)}, {_nn(8, _P32, 'k32')} SELECT count(k32.dst) AS hits, count(*) AS wanted, round(count(k32.dst) / count(*), 6) AS recall FROM knn LEFT JOIN k32 USING (src, dst)",
    "ghost_placement": f"WITH {_E}, {_nn(500)}, t AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY rank) AS r FROM knn WHERE src % 10 = 0 AND dst % 10 <> 0) SELECT src, round(sum(greatest(0, sim) * embedding[1]::DOUBLE) / sum(greatest(0, sim)), 4) AS x, round(sum(greatest(0, sim) * embedding[2]::DOUBLE) / sum(greatest(0, sim)), 4) AS y, round(max(sim), 3) AS sim FROM t JOIN e ON e.vec_id = dst WHERE r <= 6 GROUP BY src",
    "mean_vector": f"WITH {V}, i AS (SELECT unnest(range(128))::INT AS i) SELECT i, round(avg(vec[i + 1]::DOUBLE), 6) AS mean FROM v, i GROUP BY i",
    "semantic_query": f"WITH {V}, n AS (SELECT node_id, vec::DOUBLE[] AS x, sqrt(list_dot_product(vec::DOUBLE[], vec::DOUBLE[])) AS n FROM v), q AS (SELECT arg_min(x, node_id) AS qx, arg_min(n, node_id) AS qn FROM n WHERE n > 0) SELECT node_id, round(list_dot_product(x, qx) / (n * qn), 4) AS sim FROM n, q WHERE n > 0",
    "derived_direction": f"WITH {V}, i AS (SELECT unnest(range(128))::INT AS i), n AS (SELECT node_id, vec::DOUBLE[] AS x, sqrt(list_dot_product(vec::DOUBLE[], vec::DOUBLE[])) AS n FROM v), u AS (SELECT node_id, i, x[i + 1] / CASE WHEN n = 0 THEN 1 ELSE n END AS x FROM n, i) SELECT i, round(avg(x) FILTER (node_id % 5 = 0) - avg(x) FILTER (node_id % 5 <> 0), 6) AS d FROM u GROUP BY i",
    "term_document_counts": f"WITH {D}, t AS (SELECT node_id, unnest({TOKENS}) AS term FROM d) SELECT node_id, term, count(*) AS n FROM t GROUP BY ALL",
}
