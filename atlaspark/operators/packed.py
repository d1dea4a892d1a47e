"""Fields that hold several values in one string: one row per value, with its position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The characters that part values, the quote pairs, and blanks of any kind (JVM \s lacks the wide ones).
SEPARATORS = ";；|/·•\\t\\n\\r"
COMMAS = ",，、"
QUOTES = (('"', '"'), ("“", "”"), ("„", "“”"), ("«", "»"), ("'", "'"), ("‘", "’"))
BLANK = "\\s\\u00a0\\u1680\\u2000-\\u200b\\u202f\\u205f\\u3000\\ufeff"
MARK, JOIN = "\u0001", "\u0002"


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{BLANK}]+|[{BLANK}]+$", "")


def _unquote(c: Column) -> Column:
    """Undo \\" and "" inside a literal."""
    return F.regexp_replace(F.regexp_replace(c, r'""', '"'), r"\\(.)", "$1")


def split_values(text: Column, commas: bool = True) -> Column:
    """array<string>: the values of one packed string, in order; null for null, empty for a text without values.

    The quoted stretches are marked, the text is split on the marks, so that odd pieces are literals and even pieces are split on
    the delimiters, and a fold over the pieces puts the values together again. A quote only opens at the start of a value and
    only closes at its end, so the apostrophe in "reader's guide" is a letter like any other. ``commas=False`` leaves commas inside values
    (names such as "Iverley, Ada"), except between the quoted items of a bracketed list.
    """
    seps = SEPARATORS + (COMMAS if commas else "")
    edge = seps + COMMAS
    t = F.regexp_replace(text, f"[{MARK}{JOIN}]", "")
    t = F.regexp_replace(t, r"\r\n?", "\n")
    t = F.regexp_replace(t, f"(?m)^[{BLANK}]*[-*•–‣]{'[' + BLANK + ']'}+", "")  # list marks
    bracketed = t.rlike(f"(?s)^[{BLANK}]*\\[.*\\][{BLANK}]*$")
    t = F.when(bracketed, F.regexp_replace(t, f"(?s)^[{BLANK}]*\\[|\\][{BLANK}]*$", "")).otherwise(t)
    for left, right in QUOTES:
        inner = f'(?:[^{left}{right}\\\\]|\\\\.|"")' if left == '"' else f"(?:[^{left}{right}\\\\\\n]|\\\\.|(?<=\\p{{L}})['’](?=\\p{{L}}))" if left in "'‘" else f"(?:[^{left}{right}\\\\]|\\\\.)"
        t = F.regexp_replace(t, f"(?<=^|[{edge}{BLANK}])[{left}]({inner}*+)[{right}](?=[{BLANK}]*(?:$|[{edge}{MARK}]))", f"{MARK}$1{MARK}")
    pieces = F.split(t, MARK, -1)
    even = F.when(bracketed, F.lit(1)).otherwise(0) if not commas else F.lit(0)

    def parts(p: Column) -> Column:
        plain = F.split(p, f"[{seps}]", -1)
        return plain if commas else F.when(even == 1, F.split(p, f"[{seps}{COMMAS}]", -1)).otherwise(plain)

    # fold: acc.done holds finished values, acc.open the value being put together
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.lit(0).alias("i"))

    def step(acc: Column, p: Column) -> Column:
        xs = parts(p)
        n = F.size(xs)
        literal = F.struct(acc["done"].alias("done"), F.concat(acc["open"], F.lit(JOIN), _unquote(p), F.lit(JOIN)).alias("open"), (acc["i"] + 1).alias("i"))
        single = F.struct(acc["done"].alias("done"), F.concat(acc["open"], xs[0]).alias("open"), (acc["i"] + 1).alias("i"))
        several = F.struct(
            F.concat(acc["done"], F.array(F.concat(acc["open"], xs[0])), F.slice(xs, F.lit(2), F.greatest(n - 2, F.lit(0)))).alias("done"),
            F.element_at(xs, -1).alias("open"),
            (acc["i"] + 1).alias("i"),
        )
        return F.when(acc["i"] % 2 == 1, literal).when(n <= 1, single).otherwise(several)

    folded = F.aggregate(pieces, start, step, lambda acc: F.concat(acc["done"], F.array(acc["open"])))
    tidy = F.transform(folded, lambda v: _trim(F.regexp_replace(F.when(v.contains(JOIN), _trim(v)).otherwise(_trim(F.regexp_replace(v, r"\\(.)", "$1"))), JOIN, "")))
    return F.filter(tidy, lambda v: v != "")


def explode_packed(df: DataFrame, json_col: str, fields: dict[str, bool], key: str) -> DataFrame:
    """(key, field, pos, value): one row for each value under the named keys of a JSON object column.

    ``fields`` maps each key to whether commas part its values. A JSON array gives one value per element, not divided further; a
    string is taken apart by ``split_values``; a number or boolean is one value. Null, empty and missing
    fields, and text that is no JSON object, give no row. Empty values take no position; repeats count each. Only the JSON
    column and the key are read, nothing is shuffled, and other columns of df, whatever their names, play no part.
    """
    schema = ", ".join(f"`{f}` STRING" for f in fields)
    parsed = df.select(F.col(key).alias("_key"), F.from_json(F.col(json_col), schema).alias("_o"), F.col(json_col).alias("_raw"))
    lists = []
    for f, commas in fields.items():
        v = F.col("_o").getField(f)
        array = F.transform(F.from_json(v, "array<string>"), _trim)
        # only a value that opens with a bracket can be an array; whether it is one the object itself says (the pattern serves for objects that name a key twice)
        kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json("_raw"), F.lit(f'$["{f}"]'), "variant"))
        is_array = v.startswith("[") & F.coalesce(kind.startswith("ARRAY"), F.col("_raw").rlike(f'"{f}"\\s*:\\s*\\['))
        lists.append(F.struct(F.lit(f).alias("field"), F.when(is_array, F.filter(array, lambda x: x.isNotNull() & (x != ""))).otherwise(split_values(v, commas)).alias("values")))
    each = parsed.select("_key", F.explode(F.array(*lists)).alias("x"))
    return each.select(F.col("_key").alias(key), F.col("x.field").alias("field"), F.posexplode("x.values").alias("pos", "value"))
