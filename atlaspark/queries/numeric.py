"""Queries of axes, ladders, layouts and approximate neighbours: no SQL can say these, so they are tested on fixtures and by invariants."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.knn import calibrated_knn, exact_knn
from ..operators.linear import axis_table, discover_axes, ladder, layout, mean_difference, project, similarity_to
from ..operators.rank import rank_scores
from .common import cards
from .regions import _knn, _vecs


def axes_discovered(spark, sf_dir):
    return axis_table(spark, discover_axes(cards(spark, sf_dir), "vec"))


def axis_scores(spark, sf_dir):
    c = cards(spark, sf_dir)
    return rank_scores(project(c, "node_id", "vec", discover_axes(c, "vec")), "raw", "node_id", ["pc"]).select("node_id", "pc", "score")


def region_ladder(spark, sf_dir):
    return ladder(cards(spark, sf_dir), "node_id", "vec", 27)[0]


def map_layout(spark, sf_dir):
    v = _vecs(spark, sf_dir)
    return layout(v, "node_id", "embedding", exact_knn(v, "node_id", "embedding", 14), 2, 10)


def knn_approximate(spark, sf_dir):
    """Calibrated neighbours of the card vectors; the exact answer only serves the calibration."""
    return calibrated_knn(cards(spark, sf_dir), "node_id", "vec", 8, exact_below=256)[0]


def derived_dimension(spark, sf_dir):
    """How far each card lies towards the cards of one map."""
    c = cards(spark, sf_dir)
    d = mean_difference(c, "node_id", "vec", c.where("node_id % 5 = 0").select("node_id"))
    return similarity_to(c, "node_id", "vec", d).select("node_id", F.round("sim", 4).alias("sim"))


def exact_distances(spark, sf_dir):
    return _knn(spark, sf_dir).groupBy("rank").agg(F.round(F.avg("sim"), 4).alias("mean_sim"))


QUERIES = {f.__name__: f for f in (axes_discovered, axis_scores, region_ladder, map_layout, knn_approximate, derived_dimension, exact_distances)}
from .regions import _E, _nn  # noqa: E402

from .common import V  # noqa: E402

ORACLE = {"derived_dimension": f"WITH {V}, i AS (SELECT unnest(range(128))::INT AS i), n AS (SELECT node_id, vec::DOUBLE[] AS x, sqrt(list_dot_product(vec::DOUBLE[], vec::DOUBLE[])) AS n FROM v), u AS (SELECT node_id, i, x[i + 1] / CASE WHEN n = 0 THEN 1 ELSE n END AS x FROM n, i), m AS (SELECT i, avg(x) FILTER (node_id % 5 = 0) - avg(x) FILTER (node_id % 5 <> 0) AS d FROM u GROUP BY i), q AS (SELECT list(d ORDER BY i) AS d, sqrt(sum(d * d)) AS l FROM m) SELECT node_id, round(list_dot_product(x, d) / (n * l), 4) AS sim FROM n, q WHERE n > 0", "exact_distances": f"WITH {_E}, {_nn(8)} SELECT rank, round(avg(sim), 4) AS mean_sim FROM knn GROUP BY rank"}
