"""Queries of sources, parsing, cleaning and corpus assembly."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import STOPWORDS, arxiv_id, card_text, portable_source, slug, tokens
from ..operators.parse import assemble, chunk, column_types, dedupe, json_values, parse_files, split_documents
from ..operators.regions import term_counts, term_index
from .common import FILES, D, docs, files


def parse_documents(spark, sf_dir):
    p = parse_files(files(spark, sf_dir).select("file_id", "path", "name", "text")).where("skip is null")
    return p.select("file_id", "title", "body", "url", "site_name", "author", "arxiv", "date_ms", F.array_join("tags", "|").alias("tags"))


def parse_skips(spark, sf_dir):
    p = parse_files(files(spark, sf_dir).select("file_id", "path", "name", "text"))
    return p.groupBy(F.coalesce("skip", F.lit("kept")).alias("outcome")).agg(F.count("*").alias("n"))


def assembled_corpus(spark, sf_dir):
    a = assemble(files(spark, sf_dir).drop("map_id"), "meta", order="file_id")
    return a.select("file_id", "id", "title", F.length("body").alias("body_chars"), F.size("meta_map").alias("n_meta"))


def generic_columns(spark, sf_dir):
    return column_types(json_values(files(spark, sf_dir), "meta"))


def dedupe_documents(spark, sf_dir):
    return dedupe(docs(spark, sf_dir).select("node_id", "title", "cores"), ["title", "cores"], ["node_id"]).select("node_id", "title")


def oversized_parts(spark, sf_dir):
    p = split_documents(docs(spark, sf_dir).select("node_id", "title", "cores"), "node_id", "title", "cores", 1000)
    return p.select(F.col("node_id").alias("id"), "title", F.length("cores").alias("chars"))


def chunk_documents(spark, sf_dir):
    from ..session import table

    c = chunk(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")
    return c.select("doc_id", "chunk_no", F.md5("text").alias("digest"))


def card_texts(spark, sf_dir):
    notes = F.array("site_name", "author")
    return docs(spark, sf_dir).select("node_id", F.md5(card_text(F.col("title"), F.col("cores"), notes)).alias("digest"))


def assembled_fields(spark, sf_dir):
    d = docs(spark, sf_dir)
    folder = F.regexp_replace(F.element_at(F.split("path", "/"), -2), "_", " ")
    has = F.size(F.split("path", "/")) >= 2
    return d.select("node_id", F.coalesce("url", F.concat(F.lit("file://"), "path")).alias("url"), F.when(has, folder).alias("folder"), (F.col("read_progress") > 0.05).alias("read"))


def slugs(spark, sf_dir):
    return docs(spark, sf_dir).select("node_id", slug(F.col("title")).alias("slug"), portable_source(F.col("path")).alias("source"), arxiv_id(F.col("arxiv"), F.col("url"), F.col("cores")).alias("arxiv"))


def term_index_query(spark, sf_dir):
    return term_index(term_counts(docs(spark, sf_dir), "node_id", "cores"), "node_id").where("df >= 2").select("term", "n", "df")


def token_counts(spark, sf_dir):
    return docs(spark, sf_dir).select("node_id", F.size(tokens(F.col("cores"))).alias("n_tokens")).where("n_tokens >= 0")


def dimension_manifest(spark, sf_dir):
    """Which dimensions the corpus offers, and on how many nodes each is present."""
    d = docs(spark, sf_dir)
    filled = {c: F.count_if(F.col(c).isNotNull() & (F.col(c).cast("string") != "")) for c in ("author", "site_name", "folder")}
    counts = d.agg(*[v.alias(k) for k, v in filled.items()], F.count_if(F.size("tags") > 0).alias("tags"), F.count_if(F.col("date_ms").isNotNull()).alias("date_ms"), F.count_if(F.col("read_progress").isNotNull()).alias("read_progress"), F.count("cores").alias("length"))
    kinds = (("author", "categorical"), ("site_name", "categorical"), ("folder", "categorical"), ("tags", "categorical"), ("date_ms", "temporal"), ("read_progress", "scalar"), ("length", "scalar"))
    return counts.select(F.explode(F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(k).alias("key"), F.lit(t).alias("type"), F.lit(k == "tags").alias("multi"), F.col(k).alias("present")) for i, (k, t) in enumerate(kinds)])).alias("x")).select("x.*").where("present > 0")


def spend_estimate(spark, sf_dir):
    """Tokens and hours of a run over the corpus: chars / 4, 935 tokens a card, 40 documents and 7.5 cards a second."""
    d = docs(spark, sf_dir)
    return d.agg(F.count("*").alias("n_docs"), F.sum(F.length("cores")).alias("chars"), F.count("cores").alias("n_cards")).select("n_docs", (F.col("chars") / 4.0).alias("tokens_in"), (F.col("n_cards") * 935).alias("tokens_out"), F.round(F.col("n_docs") / 40.0, 3).alias("embed_s"), F.round(F.col("n_cards") / 7.5, 3).alias("card_s"))


QUERIES = {
    "parse_documents": parse_documents, "parse_skips": parse_skips, "assembled_corpus": assembled_corpus,
    "generic_columns": generic_columns, "dedupe_documents": dedupe_documents, "oversized_parts": oversized_parts, "chunk_documents": chunk_documents,
    "card_texts": card_texts, "assembled_fields": assembled_fields, "slugs": slugs, "term_index": term_index_query, "token_counts": token_counts,
    "dimension_manifest": dimension_manifest, "spend_estimate": spend_estimate,
}

_PARSED = FILES + r""", p0 AS (
  SELECT file_id, name, coalesce(text, '') AS raw, regexp_matches(coalesce(text, ''), '^---\n([\s\S]*?)\n---\n?([\s\S]*)$') AS has
  FROM f WHERE regexp_matches(name, '(?i)\.(md|markdown|txt)$')),
p1 AS (SELECT file_id, name, raw, CASE WHEN has THEN regexp_extract(raw, '^---\n([\s\S]*?)\n---\n?([\s\S]*)$', 1) ELSE '' END AS front,
  CASE WHEN has THEN regexp_extract(raw, '^---\n([\s\S]*?)\n---\n?([\s\S]*)$', 2) ELSE raw END AS rest FROM p0),
p2 AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(rest,
  '```[\s\S]*?```', ' ', 'g'), '!\[[^\]]*\]\([^)]*\)', ' ', 'g'), '\[([^\]]*)\]\([^)]*\)', '\1', 'g'), 'https?://\S+', ' ', 'g'),
  '[#>*_`|]+', ' ', 'g'), '[\t\n\x0b\x0c\r ]+', ' ', 'g'), '^ | $', '', 'g') AS body, substr(raw, 1, 8192) AS head FROM p1),
p3 AS (SELECT *, CASE WHEN contains(head, chr(0)) OR (length(head) > 0 AND length(regexp_replace(head, '[^\x00-\x08\x0b\x0c\x0e-\x1f\x{FFFD}]', '', 'g')) / length(head) > 0.3) THEN 'binary'
  WHEN length(body) < 200 AND NOT (regexp_matches(front, '(?m)^id:') AND regexp_matches(front, '(?m)^axes:')) THEN 'short' END AS skip FROM p2)"""


def _front(key: str) -> str:
    return rf"""nullif(trim(regexp_extract(front, '(?m)^(?:{key}):\s*"?([^"\n]+)', 1)), '')"""


def _link(sql: str) -> str:
    return rf"""nullif(regexp_replace({sql}, '[).,"'']+$', ''), '')"""


_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in STOPWORDS)
TOKENS = rf"list_filter(regexp_extract_all(lower(cores), '[a-z][a-z''-]{{2,}}'), lambda w: w NOT IN ({_STOP}))"
_KIND = "CASE json_type(value) WHEN 'ARRAY' THEN 'array' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'VARCHAR' THEN 'string' WHEN 'NULL' THEN NULL WHEN 'OBJECT' THEN NULL ELSE 'number' END"

ORACLE = {
    "parse_documents": f"""WITH {_PARSED} SELECT file_id, coalesce({_front('title')}, nullif(trim(regexp_extract(rest, '(?m)^#\\s+(.+)$', 1)), ''), regexp_replace(name, '(?i)\\.(md|markdown|txt)$', '')) AS title, body,
      coalesce({_link(_front('url'))}, {_link(_front('source_url|source'))}, {_link("regexp_extract(rest, '(?i)https?://(?:arxiv\\.org|doi\\.org|dx\\.doi\\.org)/[^ \\t\\n\\r]+', 0)")}, {_link("regexp_extract(substr(rest, 1, 600), 'https?://[^ \\t\\n\\r)>\"'']+', 0)")}) AS url,
      {_link(_front('site_name'))} AS site_name, {_front('author')} AS author,
      nullif(regexp_extract(regexp_extract(front || chr(10) || substr(rest, 1, 3000), '(?i)arxiv\\.org/(?:abs|pdf)/\\d{{4}}\\.\\d{{4,5}}|arxiv:\\s*\\d{{4}}\\.\\d{{4,5}}', 0), '\\d{{4}}\\.\\d{{4,5}}', 0), '') AS arxiv,
      epoch_ms(try_cast(trim(regexp_extract(front, '(?m)^(?:created_at|date|published_date):\\s*"?([^"\\n]+)', 1)) AS TIMESTAMP)) AS date_ms,
      nullif(array_to_string(list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_extract(front, '(?m)^tags:[ \\t]*(.+)$', 1), '[\\[\\]"'']', '', 'g'), ',\\s*'), lambda t: trim(t)), lambda t: t <> ''), '|'), '') AS tags
      FROM p3 WHERE skip IS NULL""",
    "parse_skips": f"WITH {_PARSED} SELECT coalesce(skip, 'kept') AS outcome, count(*) AS n FROM p3 GROUP BY 1",
    "generic_columns": f"""WITH {FILES}, e AS (SELECT j.key AS key, {_KIND.replace('value', 'j.value')} AS kind, CASE json_type(j.value) WHEN 'VARCHAR' THEN j.value ->> '$' ELSE CAST(j.value AS VARCHAR) END AS str FROM f, json_each(f.meta) j WHERE f.meta IS NOT NULL),
      p AS (SELECT *, kind = 'string' AND regexp_matches(str, '^\\d{{4}}-\\d{{2}}(-\\d{{2}})?([T ].*)?$') AND try_strptime(substr(str, 1, 7), '%Y-%m') IS NOT NULL AS iso, CASE WHEN kind = 'string' THEN list_filter(list_transform(string_split(str, ','), lambda t: trim(t)), lambda t: t <> '') ELSE [] END AS parts FROM e WHERE kind IS NOT NULL AND str <> ''),
      g AS (SELECT key, count(*) AS present, count(*) FILTER (kind = 'array') AS a, count(*) FILTER (kind = 'boolean') AS b, count(*) FILTER (kind = 'number') AS n, count(*) FILTER (kind = 'string') AS s, count(*) FILTER (iso) AS i, count(*) FILTER (kind = 'string' AND contains(str, ',')) AS c, sum(len(parts)) AS np, sum(len(list_filter(parts, lambda t: length(t) <= 40))) AS nb FROM p GROUP BY key),
      k AS (SELECT *, CASE greatest(a, b, n, s) WHEN a THEN 'array' WHEN b THEN 'boolean' WHEN n THEN 'number' ELSE 'string' END AS kind FROM g), t AS (SELECT *, kind = 'string' AND i >= 0.8 * s AS temporal FROM k)
      SELECT key, CASE WHEN temporal THEN 'temporal' WHEN kind = 'boolean' THEN 'boolean' WHEN kind = 'number' THEN 'scalar' ELSE 'categorical' END AS type, kind = 'array' OR (kind = 'string' AND NOT temporal AND c >= greatest(3.0, 0.05 * s) AND nb >= 0.95 * np) AS multi, present FROM t""",
    "oversized_parts": f"WITH {D}, p AS (SELECT node_id, title, cores, regexp_extract_all(cores, '(?s).{{1,1000}}\\z|.{{501,1000}} |.{{1000}}') AS p FROM d WHERE length(cores) > 1000), e AS (SELECT node_id, title, p, unnest(range(len(p))) AS k FROM p) SELECT node_id || '#' || k AS id, coalesce(title, '') || ' (part ' || (k + 1) || '/' || len(p) || ')' AS title, length(p[k + 1])::INT AS chars FROM e UNION ALL SELECT node_id::VARCHAR, title, length(cores)::INT FROM d WHERE coalesce(length(cores), 0) <= 1000",
    "dedupe_documents": f"WITH {D} SELECT min(node_id) AS node_id, title FROM d GROUP BY title, cores",
    "chunk_documents": r"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\t\n\x0b\x0c\r ]+') AS w FROM documents), n AS (SELECT *, greatest(ceil(len(w) / 220)::INT, 1) AS n FROM w),
      e AS (SELECT *, unnest(range(least(n, 50))) AS i FROM n), a AS (SELECT *, CASE WHEN n > 50 THEN floor(i * (n / 50.0::DOUBLE))::INT ELSE i END AS pick FROM e)
      SELECT doc_id, i::INT AS chunk_no, md5(CASE WHEN len(w) = 0 THEN ' ' ELSE array_to_string(list_slice(w, pick * 220 + 1, pick * 220 + 220), ' ') END) AS digest FROM a""",
    "card_texts": f"WITH {D} SELECT node_id, md5(CASE WHEN coalesce(title, '') <> '' THEN title || '. ' ELSE '' END || coalesce(cores, '') || ' ' || array_to_string(list_filter([site_name, author], lambda x: x IS NOT NULL AND x <> ''), '. ')) AS digest FROM d",
    "assembled_fields": f"WITH {D} SELECT node_id, coalesce(url, 'file://' || path) AS url, CASE WHEN len(string_split(path, '/')) >= 2 THEN replace(string_split(path, '/')[-2], '_', ' ') END AS folder, read_progress > 0.05 AS read FROM d",
    "slugs": f"""WITH {D} SELECT node_id, substr(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 40) AS slug,
      CASE WHEN regexp_matches(path, '^(/|[A-Za-z]:[\\\\/]|~)') THEN regexp_split_to_array(regexp_replace(path, '[\\\\/]+$', ''), '[\\\\/]')[-1] ELSE path END AS source,
      coalesce(nullif(arxiv, ''), nullif(regexp_extract(concat_ws(' ', url, cores), '(?i)arxiv\\.org/(?:abs|pdf)/(\\d{{4}}\\.\\d{{4,5}})', 1), ''), nullif(regexp_extract(concat_ws(' ', url, cores), '(?i)arxiv:\\s*(\\d{{4}}\\.\\d{{4,5}})', 1), '')) AS arxiv FROM d""",
    "term_index": f"WITH {D}, t AS (SELECT node_id, unnest({TOKENS}) AS term FROM d) SELECT term, count(*) AS n, count(DISTINCT node_id) AS df FROM t GROUP BY term HAVING count(DISTINCT node_id) >= 2",
    "token_counts": f"WITH {D} SELECT node_id, len({TOKENS})::INT AS n_tokens FROM d WHERE cores IS NOT NULL",
    "dimension_manifest": f"""WITH {D}, c AS (SELECT [count(*) FILTER (author <> ''), count(*) FILTER (site_name <> ''), count(*) FILTER (folder <> ''), count(*) FILTER (len(tags) > 0), count(date_ms), count(read_progress), count(cores)] AS n FROM d),
      k AS (SELECT unnest(range(7))::INT AS ord) SELECT ord, ['author', 'site_name', 'folder', 'tags', 'date_ms', 'read_progress', 'length'][ord + 1] AS key, ['categorical', 'categorical', 'categorical', 'categorical', 'temporal', 'scalar', 'scalar'][ord + 1] AS type, ord = 3 AS multi, n[ord + 1] AS present FROM k, c WHERE n[ord + 1] > 0""",
    "spend_estimate": f"WITH {D} SELECT count(*) AS n_docs, sum(length(cores)) / 4.0 AS tokens_in, count(cores) * 935 AS tokens_out, round(count(*) / 40.0, 3) AS embed_s, round(count(cores) / 7.5, 3) AS card_s FROM d",
}
