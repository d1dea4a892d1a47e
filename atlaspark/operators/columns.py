"""Generic metadata as typed columns, and the manifest of the dimensions that a corpus offers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .parse import column_types, json_values

LONG = "key string, type string, num double, str string, bool boolean, arr array<string>"


def split_list(text):
    """The filled parts of a comma-separated value, without surrounding blanks."""
    return F.filter(F.transform(F.split(text, ","), lambda t: F.trim(t)), lambda p: p != "")


def typed_values(values: DataFrame, types: DataFrame, node: str = "node_id") -> DataFrame:
    """(node, key, type, num, str, bool, arr): every value in the column that its key's type gives it; one of another kind, or that cannot be read as it, has no row.

    ``values`` is (node, key, kind, str), ``types`` (key, type, multi) as ``column_types`` infers them. Scalars and times (in milliseconds) are in num, categories in str or, where there
    may be several, in arr.
    """
    v = values.join(types.select("key", "type", "multi"), "key")
    s, kind = F.col("str"), F.col("kind")
    time = F.unix_millis(F.coalesce(F.try_to_timestamp(s), F.try_to_timestamp(s, F.lit("yyyy-MM")))).cast("double")
    num = F.when((F.col("type") == "scalar") & (kind == "number"), s.try_cast("double")).when((F.col("type") == "temporal") & (kind == "string"), time)
    flag = F.when((F.col("type") == "boolean") & (kind == "boolean"), s.try_cast("boolean"))
    listed = F.when(kind == "array", F.filter(F.from_json(s, "array<string>"), lambda x: x.isNotNull() & (x != ""))).when(kind == "string", split_list(s))
    category = F.col("type") == "categorical"
    arr = F.when(category & F.col("multi"), listed)
    text = F.when(category & ~F.col("multi") & (kind == "string"), s)
    out = v.select(node, "key", "type", num.alias("num"), text.alias("str"), flag.alias("bool"), F.when(F.size(arr) > 0, arr).alias("arr"))
    return out.where("num is not null or str is not null or bool is not null or arr is not null")


def generic_columns(df: DataFrame, node: str, json_col: str) -> tuple[DataFrame, DataFrame]:
    """(types (key, type, multi, present), values as ``typed_values``) of a JSON object column."""
    values = json_values(df, json_col, node)
    types = column_types(values)
    return types, typed_values(values, types, node)


def wide_columns(long: DataFrame, types: list, node: str = "node_id") -> DataFrame:
    """One column per key out of the long form, for the keys asked for: ``types`` is rows with key and type."""
    fields = {"scalar": "num", "temporal": "num", "boolean": "bool"}
    picks = [F.first(F.when(F.col("key") == t.key, F.col("arr" if t.type == "categorical" and t.multi else fields.get(t.type, "str"))), ignorenulls=True).alias(t.key) for t in types]
    return long.groupBy(node).agg(*picks)


# The dimensions of a node table in the order of the manifest: key, label, type, multi, column, source.
NATIVE = (
    ("author", "Author", "categorical", False, "author", "col:authors"), ("site", "Site", "categorical", False, "site_name", "col:siteNames"), ("folder", "Folder", "categorical", False, "folder", "derived:folder"),
    ("tags", "Tags", "categorical", True, "tags", "col:tags"), ("date", "Date", "temporal", False, "date_ms", "col:dates"), ("read", "Read", "boolean", False, "read", "col:read"), ("hub", "Hub", "scalar", False, "hub", "col:hub"),
    ("citec", "Cited", "scalar", False, "citec", "col:citec"), ("length", "Length", "scalar", False, "length", "derived:length"),
)


def manifest(nodes: DataFrame, types: DataFrame | None = None, axes: DataFrame | None = None) -> DataFrame:
    """(ord, key, label, type, multi, source, present): the dimensions that are present on some node, the native ones first, then generic columns by key, then axes by number.

    A native dimension counts where its column exists and is filled; all are counted in one pass. A generic column that shares a native one's name keeps its key with ``·col`` behind.
    """
    kinds = dict(nodes.dtypes)
    have = [d for d in NATIVE if d[4] in kinds]
    filled = lambda c: F.count_if(F.size(c) > 0) if kinds[c].startswith("array") else F.count_if(F.col(c).isNotNull() & (F.col(c).cast("string") != ""))
    counts = nodes.agg(*[filled(d[4]).alias(d[0]) for d in have])
    rows = [F.struct(F.lit(i).alias("ord"), F.lit(d[0]).alias("key"), F.lit(d[1]).alias("label"), F.lit(d[2]).alias("type"), F.lit(d[3]).alias("multi"), F.lit(d[5]).alias("source"), F.col(d[0]).alias("present")) for i, d in enumerate(have)]
    out = counts.select(F.explode(F.array(*rows)).alias("x")).select("x.*").where("present > 0")
    names = [d[0] for d in NATIVE]
    if types is not None:
        key = F.when(F.col("key").isin(names), F.concat("key", F.lit("·col"))).otherwise(F.col("key"))
        out = out.union(types.select(F.lit(1000), key, "key", "type", "multi", F.concat(F.lit("mcol:"), "key"), "present"))
    if axes is not None:
        out = out.union(axes.select(F.col("pc") + 2000, "key", "key", F.lit("scalar"), F.lit(False), F.concat(F.lit("axis:"), "key"), F.lit(None).cast("bigint")))
    return out
