"""Queries of typed columns, manifests, channels, drift, references and lists: what a finished map is asked besides its regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dimensions as dims
from ..operators.citations import cite_counts, cite_edges
from ..operators.columns import generic_columns, manifest
from ..operators.knn import row_defects
from ..operators.parse import front_meta, path_id
from ..operators.rank import rank_scores
from ..operators.regions import axis_drift, redundant_pairs, region_samples
from ..operators.view import View
from .common import FILES, LADDER, RAW, D, V, cards, docs, files, ladder, raw_scores
from .corpus import _KIND
from .corpus import ORACLE as CORPUS
from .regions import _E, _knn, _nn, _vecs


def typed_columns(spark, sf_dir):
    """Every metadata value in the column of its key's type."""
    _, values = generic_columns(files(spark, sf_dir).select("file_id", "meta"), "file_id", "meta")
    return values.select("file_id", "key", "type", F.round("num", 4).alias("num"), "str", F.col("bool").alias("flag"), F.array_join("arr", "|").alias("arr"))


def corpus_manifest(spark, sf_dir):
    """The dimensions that the documents offer, in the manifest's order."""
    d = docs(spark, sf_dir).select("author", "site_name", "folder", "tags", "date_ms", F.when(F.col("read_progress") > 0.05, True).alias("read"), F.length("cores").alias("length"))
    return manifest(d).select("ord", "key", "label", "type", "multi", "source", "present")


def frontmatter_meta(spark, sf_dir):
    """Generic frontmatter keys, of a frontmatter made of each document's fields."""
    m = F.col("map_id").cast("string")
    front = F.concat(F.lit("id: x\nscore: "), m, F.lit(".50\nrank: "), m, F.lit("\nshelf: \"s-"), m, F.lit("\"\nflag: Yes\nempty:\nlist: [a, "), m, F.lit(", ]\nitems:\n  - '"), m, F.lit("z'\n  - no\nnested:\n  k: v\nshelf: t"), m)
    return docs(spark, sf_dir).select("node_id", F.explode(front_meta(front)).alias("key", "value"))


def path_ids(spark, sf_dir):
    """The id of a file that declares none."""
    return files(spark, sf_dir).where("path is not null").select("file_id", path_id("path").alias("id"))


def _scored(spark, sf_dir):
    return rank_scores(raw_scores(spark, sf_dir), "raw", "node_id", ["pc"]).select("node_id", "pc", "score")


def corpus_drift(spark, sf_dir):
    """The axes whose mean score moved after the median date."""
    return axis_drift(docs(spark, sf_dir), _scored(spark, sf_dir), "date_ms", notable=0.01)


def axis_pairs(spark, sf_dir):
    v = cards(spark, sf_dir).select(*[F.col("vec")[i].cast("double").alias(f"a{i + 1}") for i in range(5)])
    return redundant_pairs(v, ["a1", "a2", "a3", "a4", "a5"])


def axis_weights(spark, sf_dir):
    """Axes with their variance relative to the strongest one's."""
    v = raw_scores(spark, sf_dir).groupBy("pc").agg(F.var_samp("raw").alias("variance"))
    return dims.relative_weights(v).select("pc", "weight")


def sample_texts(spark, sf_dir):
    """Twelve members of each region as a model is shown them."""
    d = docs(spark, sf_dir).select("node_id", F.col("map_id").alias("region"), "title", "cores")
    return region_samples(d, "region", "node_id", "title", "cores").select("region", F.md5("samples").alias("digest"))


def _references(spark, sf_dir):
    """Every document of a folder refers to the folder's first paper, every third one is referred to by it."""
    d = docs(spark, sf_dir).where("folder is not null")
    paper = d.where("arxiv <> ''").groupBy("folder").agg(F.min("arxiv").alias("arxiv"))
    return d.join(paper.withColumnRenamed("arxiv", "paper"), "folder").select("node_id", F.col("paper").alias("arxiv"), (F.col("node_id") % 3 == 0).alias("citing"))


def reference_edges(spark, sf_dir):
    """References by paper number as edges between documents; a paper that several carry stands for the last of them."""
    return cite_edges(_references(spark, sf_dir), docs(spark, sf_dir))


def reference_counts(spark, sf_dir):
    d = docs(spark, sf_dir)
    first = d.where("folder is not null").groupBy("folder").agg(F.min("node_id").alias("dst"))
    edges = d.join(first, "folder").select(F.col("node_id").alias("src"), "dst").where("src <> dst")
    return cite_counts(edges, d)


def view_regions(spark, sf_dir):
    """Two filters, one of them a region; after a change of grain only the other is left."""
    v = View(docs(spark, sf_dir)).region(ladder(spark, sf_dir), 1, 5).category("map_id", 5)
    one = v.rows().agg(F.count("*").alias("n")).select(F.lit("region").alias("state"), "n")
    return one.union(v.category("map_id", None).remove("cat", "map_id").rows().agg(F.count("*")).select(F.lit("alone"), "count(1)")).union(v.grain().rows().agg(F.count("*")).select(F.lit("regrained"), "count(1)"))


def channel_frame(spark, sf_dir):
    """Colour by site, size by reading progress, x by date, y by its rank turned round."""
    d = docs(spark, sf_dir)
    fields = [dims.Dimension("site", "Site", "categorical", "site_name", "meta"), dims.Dimension("read", "Read", "scalar", "read_progress", "meta"), dims.Dimension("date", "Date", "temporal", "date_ms", "meta"), dims.Dimension("back", "Date", "scalar", "date_ms", "derived", norm="rank", invert=True)]
    ch = dims.Channels(dims.Registry(fields=fields)).set("color", "site").set("size", "read").set("x", "date").set("y", "back")
    return ch.frame(d)


def list_defects(spark, sf_dir):
    """Defects of neighbour lists of which some were cut and some name a stranger."""
    k = _knn(spark, sf_dir).where("not (src % 7 = 0 and rank = 8)").select("src", F.when(F.col("src") % 11 == 0, F.col("dst") + 10_000_000).otherwise(F.col("dst")).alias("dst"))
    return row_defects(k, _vecs(spark, sf_dir), "node_id", 8)


QUERIES = {f.__name__: f for f in (
    typed_columns, corpus_manifest, frontmatter_meta, path_ids, corpus_drift, axis_pairs, axis_weights, sample_texts, reference_edges, reference_counts, view_regions, channel_frame, list_defects,
)}

_TYPES = f"""e AS (SELECT f.file_id, j.key AS key, {_KIND.replace('value', 'j.value')} AS kind, CASE json_type(j.value) WHEN 'VARCHAR' THEN j.value ->> '$' ELSE CAST(j.value AS VARCHAR) END AS str, j.value AS j FROM f, json_each(f.meta) j WHERE f.meta IS NOT NULL),
  p AS (SELECT *, kind = 'string' AND regexp_matches(str, '^\\d{{4}}-\\d{{2}}(-\\d{{2}})?([T ].*)?$') AND try_strptime(substr(str, 1, 7), '%Y-%m') IS NOT NULL AS iso, CASE WHEN kind = 'string' THEN list_filter(list_transform(string_split(str, ','), lambda t: trim(t)), lambda t: t <> '') ELSE [] END AS parts FROM e WHERE kind IS NOT NULL AND str <> ''),
  g AS (SELECT key, count(*) FILTER (kind = 'array') AS a, count(*) FILTER (kind = 'boolean') AS b, count(*) FILTER (kind = 'number') AS n, count(*) FILTER (kind = 'string') AS s, count(*) FILTER (iso) AS i, count(*) FILTER (kind = 'string' AND contains(str, ',')) AS c, sum(len(parts)) AS np, sum(len(list_filter(parts, lambda t: length(t) <= 40))) AS nb FROM p GROUP BY key),
  k AS (SELECT *, CASE greatest(a, b, n, s) WHEN a THEN 'array' WHEN b THEN 'boolean' WHEN n THEN 'number' ELSE 'string' END AS top FROM g), t AS (SELECT *, top = 'string' AND i >= 0.8 * s AS temporal FROM k),
  y AS (SELECT key, CASE WHEN temporal THEN 'temporal' WHEN top = 'boolean' THEN 'boolean' WHEN top = 'number' THEN 'scalar' ELSE 'categorical' END AS type, top = 'array' OR (top = 'string' AND NOT temporal AND c >= greatest(3.0, 0.05 * s) AND nb >= 0.95 * np) AS multi FROM t)"""
_RANKS = RAW + ", s AS (SELECT node_id, pc, round(100.0::DOUBLE * (row_number() OVER (PARTITION BY pc ORDER BY raw, node_id) - 1) / (count(*) OVER (PARTITION BY pc) - 1))::INT AS score FROM raw)"
_PAIRS = ", ".join(f"{{'a': 'a{i}', 'b': 'a{j}', 'r': corr(vec[{i}]::DOUBLE, vec[{j}]::DOUBLE)}}" for i in range(1, 6) for j in range(i + 1, 6))
_DIGITS = " || ".join(f"substr('0123456789abcdefghijklmnopqrstuvwxyz', ((h // {36**k}) % 36 + 1)::INT, 1)" for k in range(6, -1, -1))
_SPAN = lambda c: f"(coalesce(({c} - (SELECT min({c}) FROM d)) / (SELECT CASE WHEN max({c}) > min({c}) THEN max({c}) - min({c}) ELSE 1 END FROM d)::DOUBLE * 100.0::DOUBLE, 50))"
ORACLE = {
    "typed_columns": f"""WITH {FILES}, {_TYPES}, v AS (SELECT file_id, p.key, y.type, CASE WHEN type = 'scalar' AND kind = 'number' THEN str::DOUBLE WHEN type = 'temporal' AND kind = 'string' THEN epoch_ms(coalesce(try_cast(str AS TIMESTAMP), try_strptime(str, '%Y-%m')))::DOUBLE END AS num,
      CASE WHEN type = 'boolean' AND kind = 'boolean' THEN str = 'true' END AS flag, CASE WHEN type = 'categorical' AND NOT multi AND kind = 'string' THEN str END AS str,
      CASE WHEN type = 'categorical' AND multi THEN array_to_string(nullif(CASE kind WHEN 'array' THEN list_filter(CAST(p.j AS VARCHAR[]), lambda x: x IS NOT NULL AND x <> '') WHEN 'string' THEN parts END, []), '|') END AS arr FROM p JOIN y USING (key))
      SELECT file_id, key, type, round(num, 4) AS num, str, flag, arr FROM v WHERE num IS NOT NULL OR str IS NOT NULL OR flag IS NOT NULL OR arr IS NOT NULL""",
    "corpus_manifest": f"""WITH {D}, c AS (SELECT [count(*) FILTER (author <> ''), count(*) FILTER (site_name <> ''), count(*) FILTER (folder <> ''), count(*) FILTER (len(tags) > 0), count(date_ms), count(*) FILTER (read_progress > 0.05), count(cores)] AS n FROM d), k AS (SELECT unnest(range(7))::INT AS ord)
      SELECT ord, ['author', 'site', 'folder', 'tags', 'date', 'read', 'length'][ord + 1] AS key, ['Author', 'Site', 'Folder', 'Tags', 'Date', 'Read', 'Length'][ord + 1] AS label, ['categorical', 'categorical', 'categorical', 'categorical', 'temporal', 'boolean', 'scalar'][ord + 1] AS type, ord = 3 AS multi,
      ['col:authors', 'col:siteNames', 'derived:folder', 'col:tags', 'col:dates', 'col:read', 'derived:length'][ord + 1] AS source, n[ord + 1] AS present FROM k, c WHERE n[ord + 1] > 0""",
    "frontmatter_meta": f"""WITH {D}, e AS (SELECT node_id, unnest([{{'key': 'score', 'value': map_id || '.5'}}, {{'key': 'rank', 'value': map_id::VARCHAR}}, {{'key': 'flag', 'value': 'true'}}, {{'key': 'list', 'value': '["a", ' || map_id || ']'}}, {{'key': 'items', 'value': '["' || map_id || 'z", false]'}},
      {{'key': 'shelf', 'value': '"t' || map_id || '"'}}]) AS x FROM d WHERE map_id IS NOT NULL) SELECT node_id, x.key AS key, x.value AS value FROM e""",
    "path_ids": f"WITH {FILES}, h AS (SELECT file_id, list_reduce(list_prepend(5381::BIGINT, list_transform(string_split(path, ''), lambda c: unicode(c)::BIGINT)), lambda a, c: xor((a * 33) & 4294967295, c)) AS h FROM f WHERE path IS NOT NULL) SELECT file_id, CASE WHEN h = 0 THEN '0' ELSE ltrim({_DIGITS}, '0') END AS id FROM h",
    "corpus_drift": f"""WITH {D}, {_RANKS}, p AS (SELECT node_id, date_ms FROM d WHERE date_ms > 0), o AS (SELECT list(date_ms ORDER BY date_ms) AS l, count(*) AS n FROM p), h AS (SELECT node_id, date_ms <= l[1 + n // 2] AS early FROM p, o WHERE n >= 20), t AS (SELECT count(*) FILTER (early) AS e, count(*) FILTER (NOT early) AS l FROM h),
      m AS (SELECT pc, coalesce(coalesce(sum(score) FILTER (early), 0) / nullif(e, 0), 0)::DOUBLE AS early, coalesce(coalesce(sum(score) FILTER (NOT early), 0) / nullif(l, 0), 0)::DOUBLE AS late FROM s JOIN h USING (node_id), t GROUP BY pc, e, l) SELECT pc, round(early, 6) AS early, round(late, 6) AS late, CASE WHEN late > early THEN 'high' ELSE 'low' END AS pole FROM m WHERE abs(round(late, 6) - round(early, 6)) >= 0.01""",
    "axis_pairs": f"WITH {V}, r AS (SELECT unnest([{_PAIRS}]) AS x FROM v) SELECT x.a AS a, x.b AS b, round(x.r, 6) AS r FROM r ORDER BY abs(round(x.r, 6)) DESC, a, b LIMIT 6",
    "axis_weights": f"WITH {RAW}, a AS (SELECT pc, var_samp(raw) AS variance FROM raw GROUP BY pc) SELECT pc, round(variance / max(variance) OVER (), 4) AS weight FROM a",
    "sample_texts": f"WITH {D}, r AS (SELECT map_id AS region, node_id, substr(coalesce(title, '') || ' — ' || coalesce(cores, ''), 1, 220) AS t, row_number() OVER (PARTITION BY map_id ORDER BY node_id) AS r FROM d) SELECT region, md5(string_agg(t, chr(10) || chr(10) ORDER BY r)) AS digest FROM r WHERE r <= 12 GROUP BY region",
    "reference_edges": f"WITH {D}, a AS (SELECT folder, min(arxiv) AS arxiv FROM d WHERE arxiv <> '' AND folder IS NOT NULL GROUP BY folder), r AS (SELECT d.node_id, a.arxiv FROM d JOIN a USING (folder)), h AS (SELECT arxiv, max(node_id) AS other FROM d WHERE arxiv <> '' GROUP BY arxiv) SELECT DISTINCT CASE WHEN node_id % 3 = 0 THEN other ELSE node_id END AS src, CASE WHEN node_id % 3 = 0 THEN node_id ELSE other END AS dst FROM r JOIN h USING (arxiv) WHERE node_id <> other",
    "reference_counts": f"WITH {D}, p AS (SELECT folder, min(node_id) AS dst FROM d WHERE folder IS NOT NULL GROUP BY folder), e AS (SELECT d.node_id AS src, p.dst FROM d JOIN p USING (folder) WHERE d.node_id <> p.dst) SELECT d.node_id, count(e.src) AS n FROM d LEFT JOIN e ON e.dst = d.node_id GROUP BY d.node_id",
    "view_regions": f"WITH {LADDER} SELECT 'region' AS state, count(*) AS n FROM d WHERE map_id = 5 UNION ALL SELECT 'alone', count(*) FROM d WHERE map_id % 12 = 5 UNION ALL SELECT 'regrained', count(*) FROM d WHERE map_id = 5",
    "channel_frame": f"WITH {D}, r AS (SELECT node_id, 100 - 100.0::DOUBLE * (row_number() OVER (ORDER BY date_ms, node_id) - 1) / (count(*) OVER () - 1) AS back FROM d WHERE date_ms IS NOT NULL) SELECT d.node_id, site_name AS color, round(1.5 + 3.4 * {_SPAN('read_progress')} / 100, 6) AS size, round({_SPAN('date_ms')} / 50 - 1, 6) AS x, round(coalesce(back, 50) / 50 - 1, 6) AS y, 0.0::DOUBLE AS z FROM d LEFT JOIN r USING (node_id)",
    "list_defects": f"WITH {_E}, {_nn(8)} SELECT count(*) FILTER (vec_id % 7 = 0 OR (SELECT count(*) FROM e) <= 8) AS short, 0::BIGINT AS repeated, 0::BIGINT AS selfish, count(*) FILTER (vec_id % 11 = 0) AS foreign FROM e",
}
ORACLE["assembled_corpus"] = f"""WITH pd AS ({CORPUS['parse_documents']}), one AS (SELECT min(file_id) AS file_id, title, body FROM pd GROUP BY title, body), {FILES}, fr AS (SELECT file_id, regexp_extract(coalesce(text, ''), '^---\\n([\\s\\S]*?)\\n---\\n?', 1) AS front FROM f), ids AS ({ORACLE['path_ids']})
  SELECT one.file_id, coalesce(nullif(trim(regexp_extract(fr.front, '(?m)^(?:id):\\s*"?([^"\\n]+)', 1)), ''), ids.id) AS id, one.title, length(one.body)::INT AS body_chars, coalesce(len(json_keys(f.meta)), 0)::INT AS n_meta FROM one JOIN f USING (file_id) JOIN fr USING (file_id) LEFT JOIN ids USING (file_id)"""
