"""Queries of the map's view grammar: filters, windows, facets, ranks, poles, sorting."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.rank import band, min_max100, percentile, poles, rank100, rank_scores, top_per, unit_disc, upper_median
from ..operators.view import View, bounds, deck_lines, facets, in_polygon, vault_names
from ..session import once, table
from .common import RAW, D, V, cards, docs, raw_scores

POLYGON = [(-0.1, -0.15), (0.15, -0.05), (0.05, 0.02), (0.12, 0.18), (-0.12, 0.1)]


def _nodes(spark, sf_dir):
    return docs(spark, sf_dir).withColumn("read", F.col("read_progress") > 0.05)


def _points(spark, sf_dir):
    return cards(spark, sf_dir).select("node_id", F.col("vec")[0].cast("double").alias("x"), F.col("vec")[1].cast("double").alias("y"))


def filter_text(spark, sf_dir):
    return View(_nodes(spark, sf_dir)).find("Reading", "title", "cores").rows().select("node_id")


def filter_category(spark, sf_dir):
    return View(_nodes(spark, sf_dir)).category("map_id", 7).category("map_id", 14).rows().select("node_id", "map_id")


def filter_window(spark, sf_dir):
    return View(_nodes(spark, sf_dir)).window("read_progress", 0.25, 0.75).rows().select("node_id", "read_progress")


def filter_set(spark, sf_dir):
    held = docs(spark, sf_dir).where("node_id % 7 = 0").select("node_id")
    return View(_nodes(spark, sf_dir)).selection(held).rows().select("node_id")


def filter_mask(spark, sf_dir):
    held = docs(spark, sf_dir).where("node_id % 2 = 0").select("node_id")
    return View(_nodes(spark, sf_dir)).find("the", "title", "cores").window("date_ms", 1_400_000_000_000, None).selection(held).unread().rows().select("node_id")


def filter_chips(spark, sf_dir):
    return View(_nodes(spark, sf_dir)).find("the", "title", "cores").category("map_id", 14).window("read_progress", 0.5, None).chips()


def lasso(spark, sf_dir):
    return _points(spark, sf_dir).where(in_polygon(F.col("x"), F.col("y"), POLYGON)).select("node_id")


def facet_counts(spark, sf_dir):
    d = docs(spark, sf_dir)
    out = [facets(d, c).select(F.lit(c).alias("dimension"), "value", "n", "wide") for c in ("site_name", "folder", "tags", "author")]
    return out[0].union(out[1]).union(out[2]).union(out[3])


def deck_sort(spark, sf_dir):
    s = min_max100(docs(spark, sf_dir).select("node_id", "title", "read_progress"), "read_progress")
    return View(s).sorted(F.col("score")).select("node_id", F.round("score", 6).alias("score"))


def axis_ranks(spark, sf_dir):
    return rank_scores(raw_scores(spark, sf_dir), "raw", "node_id", ["pc"]).select("node_id", "pc", "score")


def dimension_rank(spark, sf_dir):
    return rank100(docs(spark, sf_dir).select("node_id", "read_progress"), "read_progress", "node_id", invert=True).select("node_id", F.round("score", 6).alias("score"))


def dimension_honest(spark, sf_dir):
    return min_max100(docs(spark, sf_dir).select("node_id", "read_progress"), "read_progress").select("node_id", F.round("score", 6).alias("score"))


def axis_poles(spark, sf_dir):
    p = poles(raw_scores(spark, sf_dir), "pc", "raw", "node_id")
    return p.select("pc", "pole", "place", "node_id")


def percentile_band(spark, sf_dir):
    return band(_points(spark, sf_dir), "x").select("node_id", "scaled")


def colour_disc(spark, sf_dir):
    return unit_disc(_points(spark, sf_dir), "x", "y").select("node_id", "dx", "dy")


def quantiles(spark, sf_dir):
    """The upper median and two percentiles of the dates per map."""
    d = docs(spark, sf_dir).select("map_id", "date_ms")
    m = upper_median(d, "date_ms", ["map_id"], "median")
    return m.join(percentile(d, "date_ms", 0.02, ["map_id"], "q02"), "map_id").join(percentile(d, "date_ms", 0.98, ["map_id"], "q98"), "map_id")


def decile_poles(spark, sf_dir):
    """Mean position of the lowest and highest tenth of the nodes by the first coordinate."""
    from ..operators.rank import ordinal

    r = ordinal(_points(spark, sf_dir), "x", "node_id").withColumn("k", F.greatest(F.lit(1), F.floor(F.col("_n") / 10)))
    end = r.withColumn("pole", F.when(F.col("_r") < F.col("k"), "low").when(F.col("_r") >= F.col("_n") - F.col("k"), "high")).where("pole is not null")
    return end.groupBy("pole").agg(F.count("*").alias("n"), F.round(F.avg("x"), 6).alias("x"), F.round(F.avg("y"), 6).alias("y"))


def extreme_axes(spark, sf_dir):
    s = rank_scores(raw_scores(spark, sf_dir), "raw", "node_id", ["pc"])
    return top_per(s, ["node_id"], [F.desc(F.abs(F.col("score") - 50)), F.col("pc")], 3).select("node_id", "place", "pc", "score")


def view_bounds(spark, sf_dir):
    return bounds(_points(spark, sf_dir), "x", "y")


def read_state(spark, sf_dir):
    d = _nodes(spark, sf_dir)
    return d.agg(F.count("*").alias("n"), F.count_if(F.coalesce("read", F.lit(False))).alias("read"), F.round(F.count_if(F.coalesce("read", F.lit(False))) * 100.0 / F.count("*"), 4).alias("percent"))


def channel_size(spark, sf_dir):
    """Point sizes: 1.5 + 3 |s - 50| / 50 for a two-sided dimension, 1.5 + 3.4 s / 100 for a one-sided one."""
    s = min_max100(docs(spark, sf_dir).select("node_id", "read_progress"), "read_progress")
    return s.select("node_id", F.round(1.5 + 3 * F.abs(F.col("score") - 50) / 50, 6).alias("bipolar"), F.round(1.5 + 3.4 * F.col("score") / 100, 6).alias("monotone"))


def selection_export(spark, sf_dir):
    held = docs(spark, sf_dir).where("map_id = 3").select("node_id")
    return View(docs(spark, sf_dir)).selection(held).rows().select("id", "title", "url")


def deck_jsonl(spark, sf_dir):
    return deck_lines(docs(spark, sf_dir), "node_id", "title", "cores", "url", "tags")


def vault_filenames(spark, sf_dir):
    return vault_names(docs(spark, sf_dir), "node_id", "title")


def last_wins(spark, sf_dir):
    """A key-value log read back: per key the entry written last, ties by the larger id."""
    e = table(spark, sf_dir, "events").select(F.concat_ws("/", "user_id", "event_type").alias("k"), "ts", "event_id", "value")
    return e.groupBy("k").agg(F.max_by("value", F.struct("ts", "event_id")).alias("v"))


def map_provenance(spark, sf_dir):
    """Each map with its size: nodes, regions of the coarsest level, share of nodes read."""
    d = docs(spark, sf_dir).groupBy("map_id").agg(F.count("*").alias("n"), F.count_if(F.col("read_progress") > 0.05).alias("read"))
    r = once(table(spark, sf_dir, "regions"), "region_id").groupBy("map_id").agg(F.count_distinct("level").alias("levels"))
    return table(spark, sf_dir, "maps").join(d, "map_id", "left").join(r, "map_id", "left").select("map_id", "title", F.coalesce("embedder", F.lit("unknown")).alias("embedder"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("read", F.lit(0)).alias("read"), F.coalesce("levels", F.lit(0)).alias("levels"))


QUERIES = {f.__name__: f for f in (
    filter_text, filter_category, filter_window, filter_set, filter_mask, filter_chips, lasso, facet_counts, deck_sort, axis_ranks, dimension_rank, dimension_honest,
    axis_poles, percentile_band, colour_disc, quantiles, decile_poles, extreme_axes, view_bounds, read_state, channel_size, selection_export, deck_jsonl, vault_filenames, last_wins, map_provenance,
)}

_P = V + ", p AS (SELECT node_id, vec[1]::DOUBLE AS x, vec[2]::DOUBLE AS y FROM v)"
_HONEST = D + ", e AS (SELECT min(read_progress) lo, max(read_progress) hi FROM d), s AS (SELECT node_id, coalesce((read_progress - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1 END * 100.0::DOUBLE, 50) AS score FROM d, e)"
_FOUND = "contains(lower(coalesce(title, '')), '{0}') OR contains(lower(coalesce(cores, '')), '{0}')"


def _facet(c: str, expr: str) -> str:
    return f"SELECT '{c}' AS dimension, value, n, vals > 40 AS wide FROM (SELECT value, count(*) AS n FROM (SELECT nullif({expr}, '') AS value FROM d) WHERE value IS NOT NULL GROUP BY value), (SELECT count(*) AS total, count(nullif({expr}, '')) AS have, count(DISTINCT nullif({expr}, '')) AS vals FROM d) WHERE vals >= 2 AND have >= 0.4 * total"


def _even_odd() -> str:
    parts = []
    for (ax, ay), (bx, by) in zip(POLYGON, POLYGON[-1:] + POLYGON[:-1]):
        parts.append(f"((({ay} > y) <> ({by} > y)) AND x < ({bx} - {ax}) * (y - {ay}) / ({by} - {ay}) + {ax})::INT")
    return " + ".join(parts)


_RANKS = RAW + ", r AS (SELECT *, row_number() OVER (PARTITION BY pc ORDER BY raw, node_id) - 1 AS r, count(*) OVER (PARTITION BY pc) AS n FROM raw), s AS (SELECT node_id, pc, CASE WHEN n = 1 THEN 50 ELSE round(100.0::DOUBLE * r / (n - 1))::INT END AS score FROM r)"
ORACLE = {
    "filter_text": f"WITH {D} SELECT node_id FROM d WHERE {_FOUND.format('reading')}",
    "filter_category": f"WITH {D} SELECT node_id, map_id FROM d WHERE map_id = 14",
    "filter_window": f"WITH {D} SELECT node_id, read_progress FROM d WHERE read_progress BETWEEN 0.25 AND 0.75",
    "filter_set": f"WITH {D} SELECT node_id FROM d WHERE node_id % 7 = 0",
    "filter_mask": f"WITH {D} SELECT node_id FROM d WHERE ({_FOUND.format('the')}) AND date_ms >= 1400000000000 AND node_id % 2 = 0 AND NOT coalesce(read_progress > 0.05, false)",
    "filter_chips": f"WITH {D} SELECT 'the' AS label, count(*) FILTER ({_FOUND.format('the')}) AS n FROM d UNION ALL SELECT 'map_id=14', count(*) FILTER (map_id = 14) FROM d UNION ALL SELECT 'read_progress 0.5..None', count(*) FILTER (read_progress >= 0.5) FROM d",
    "lasso": f"WITH {_P} SELECT node_id FROM p WHERE x BETWEEN -0.12 AND 0.15 AND y BETWEEN -0.15 AND 0.18 AND ({_even_odd()}) % 2 = 1",
    "facet_counts": f"WITH {D} " + " UNION ALL ".join(_facet(c, e) for c, e in (("site_name", "site_name"), ("folder", "folder"), ("tags", "tags[1]"), ("author", "author"))),
    "deck_sort": f"WITH {_HONEST} SELECT node_id, round(score, 6) AS score FROM (SELECT * FROM s ORDER BY score DESC, node_id LIMIT 2000)",
    "axis_ranks": f"WITH {_RANKS} SELECT node_id, pc, score FROM s",
    "dimension_rank": f"WITH {D}, r AS (SELECT node_id, row_number() OVER (ORDER BY read_progress, node_id) - 1 AS r, count(*) OVER () AS n FROM d WHERE read_progress IS NOT NULL) SELECT d.node_id, round(100.0::DOUBLE - coalesce(CASE WHEN n = 1 THEN 50 ELSE 100.0::DOUBLE * r / (n - 1) END, 50), 6) AS score FROM d LEFT JOIN r USING (node_id)",
    "dimension_honest": f"WITH {_HONEST} SELECT node_id, round(score, 6) AS score FROM s",
    "axis_poles": f"WITH {RAW} SELECT pc, 'low' AS pole, place, node_id FROM (SELECT *, row_number() OVER (PARTITION BY pc ORDER BY raw, node_id)::INT AS place FROM raw) WHERE place <= 14 UNION ALL SELECT pc, 'high', place, node_id FROM (SELECT *, row_number() OVER (PARTITION BY pc ORDER BY raw DESC, node_id DESC)::INT AS place FROM raw) WHERE place <= 14",
    "percentile_band": f"WITH {_P}, o AS (SELECT list(x ORDER BY x) AS l, count(*) AS n FROM p), q AS (SELECT l[1 + floor(0.02::DOUBLE * (n - 1))::INT] AS a, l[1 + floor(0.98::DOUBLE * (n - 1))::INT] AS b FROM o) SELECT node_id, round((x - (a + b) / 2) / CASE WHEN a = b THEN 1 ELSE (b - a) / 2 END, 4) AS scaled FROM p, q",
    "colour_disc": f"WITH {_P}, m AS (SELECT avg(x) mx, avg(y) my FROM p), c AS (SELECT *, sqrt((x - mx) ** 2 + (y - my) ** 2) AS r FROM p, m), o AS (SELECT list(r ORDER BY r) AS l, count(*) AS n FROM c), q AS (SELECT l[1 + floor(0.9::DOUBLE * (n - 1))::INT] AS r90 FROM o) SELECT node_id, round((x - mx) / greatest(r, CASE WHEN r90 = 0 THEN 1 ELSE r90 END), 4) AS dx, round((y - my) / greatest(r, CASE WHEN r90 = 0 THEN 1 ELSE r90 END), 4) AS dy FROM c, q",
    "quantiles": f"WITH {D}, o AS (SELECT map_id, list(date_ms ORDER BY date_ms) AS l, count(*) AS n FROM d WHERE date_ms IS NOT NULL GROUP BY map_id) SELECT map_id, l[1 + n // 2] AS median, l[1 + floor(0.02::DOUBLE * (n - 1))::INT] AS q02, l[1 + floor(0.98::DOUBLE * (n - 1))::INT] AS q98 FROM o",
    "decile_poles": f"WITH {_P}, r AS (SELECT *, row_number() OVER (ORDER BY x, node_id) - 1 AS r, count(*) OVER () AS n FROM p), e AS (SELECT *, CASE WHEN r < greatest(1, n // 10) THEN 'low' WHEN r >= n - greatest(1, n // 10) THEN 'high' END AS pole FROM r) SELECT pole, count(*) AS n, round(avg(x), 6) AS x, round(avg(y), 6) AS y FROM e WHERE pole IS NOT NULL GROUP BY pole",
    "extreme_axes": f"WITH {_RANKS} SELECT node_id, place, pc, score FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY abs(score - 50) DESC, pc)::INT AS place FROM s) WHERE place <= 3",
    "view_bounds": f"WITH {_P} SELECT min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, max(x) - min(x) AS span_x, max(y) - min(y) AS span_y FROM p",
    "read_state": f"WITH {D} SELECT count(*) AS n, count(*) FILTER (read_progress > 0.05) AS read, round(count(*) FILTER (read_progress > 0.05) * 100.0::DOUBLE / count(*), 4) AS percent FROM d",
    "channel_size": f"WITH {_HONEST} SELECT node_id, round(1.5 + 3 * abs(score - 50) / 50, 6) AS bipolar, round(1.5 + 3.4 * score / 100, 6) AS monotone FROM s",
    "selection_export": f"WITH {D} SELECT id, title, url FROM d WHERE map_id = 3",
    "deck_jsonl": f"WITH {D} SELECT to_json({{'node_id': node_id, 'title': title, 'cores': cores, 'url': url, 'tags': tags}})::VARCHAR AS line FROM d",
    "vault_filenames": f"""WITH {D}, b AS (SELECT node_id, trim(substr(trim(regexp_replace(regexp_replace(coalesce(title, ''), '[\\\\/:*?"<>|#^\\[\\]\\x00-\\x1f]', ' ', 'g'), '[\\t\\n\\x0b\\x0c\\r ]+', ' ', 'g')), 1, 80)) AS base FROM d), n AS (SELECT node_id, CASE WHEN base = '' THEN 'untitled' ELSE base END AS base FROM b), r AS (SELECT *, row_number() OVER (PARTITION BY lower(base) ORDER BY node_id) AS r FROM n)
      SELECT node_id, base || CASE WHEN r = 1 THEN '' ELSE '-' || r END || '.md' AS filename FROM r""",
    "last_wins": "SELECT concat_ws('/', user_id, event_type) AS k, arg_max(value, {'ts': ts, 'id': event_id}) AS v FROM events GROUP BY 1",
    "map_provenance": f"WITH {D}, n AS (SELECT map_id, count(*) AS n, count(*) FILTER (read_progress > 0.05) AS read FROM d GROUP BY map_id), r AS (SELECT map_id, count(DISTINCT level) AS levels FROM regions GROUP BY map_id) SELECT m.map_id, m.title, coalesce(m.embedder, 'unknown') AS embedder, coalesce(n.n, 0) AS n, coalesce(n.read, 0) AS read, coalesce(r.levels, 0) AS levels FROM maps m LEFT JOIN n USING (map_id) LEFT JOIN r USING (map_id)",
}
