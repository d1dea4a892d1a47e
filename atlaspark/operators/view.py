"""The query grammar over a finished map: dimensions, filters, windows, selections, sorting."""

from __future__ import annotations

import functools
import operator
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def text_filter(q: str, *columns: str) -> Column | None:
    """Case-insensitive substring of any of the columns; None, no filter, for a blank query."""
    if not q.strip():
        return None
    needle = q.strip().lower()
    return functools.reduce(operator.or_, [F.coalesce(F.lower(F.col(c)).contains(needle), F.lit(False)) for c in columns])


def window_filter(column: str, lo: float | None, hi: float | None) -> Column | None:
    """Inclusive range, null excluded; None, no filter (null passes), where both ends are open."""
    if lo is None and hi is None:
        return None
    c = F.col(column)
    cond = c.isNotNull()
    cond = cond & (c >= lo) if lo is not None else cond
    return cond & (c <= hi) if hi is not None else cond


def projected(matrix: list[float], x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """(x, y, inside): points under a column-major 4 x 4 projection, in -1..1, and whether they lie between the near and far planes and before the eye."""
    part = lambda r: sum((F.lit(float(matrix[4 * c + r])) * v for c, v in enumerate((x, y, z))), F.lit(float(matrix[12 + r])))
    w = part(3)
    depth = part(2) / w
    return part(0) / w, part(1) / w, F.coalesce((w > 0) & (depth >= -1) & (depth <= 1), F.lit(False))


def in_polygon(x: Column, y: Column, polygon: list[tuple[float, float]]) -> Column:
    """Even-odd ray casting, after a test of the bounding box; fewer than three corners contain nothing."""
    if len(polygon) < 3:
        return F.lit(False)
    xs, ys = [p[0] for p in polygon], [p[1] for p in polygon]
    crossings = F.lit(False)
    for (ax, ay), (bx, by) in zip(polygon, polygon[-1:] + polygon[:-1]):
        if ay != by:
            crosses = ((F.lit(ay) > y) != (F.lit(by) > y)) & (x < F.lit(bx - ax) * (y - ay) / F.lit(by - ay) + ax)
            crossings = crossings != crosses
    return F.coalesce((x >= min(xs)) & (x <= max(xs)) & (y >= min(ys)) & (y <= max(ys)) & crossings, F.lit(False))


SETS = ("set", "region")  # filters that are id tables, not predicates


@dataclass(frozen=True)
class View:
    """An immutable query over a node table: every method gives a new view, so undo is keeping the old one."""

    nodes: DataFrame
    key: str = "node_id"
    filters: tuple = ()  # (kind, name, Column or DataFrame, label)
    past: tuple = field(default=(), repr=False)

    def _with(self, kind: str, name: str, what, label: str) -> View:
        rest = tuple(f for f in self.filters if (f[0], f[1]) != (kind, name))
        if what is not None:
            rest += ((kind, name, what, label),)
        return replace(self, filters=rest, past=(*self.past, self.filters)[-32:])

    def find(self, q: str, *columns: str) -> View:
        return self._with("text", "find", text_filter(q, *columns), q)

    def category(self, column: str, value) -> View:
        """One value per dimension: a second call replaces the first."""
        return self._with("cat", column, F.col(column) == F.lit(value), f"{column}={value}")

    def region(self, ladder: DataFrame, level: int, region: int) -> View:
        """One region of a grain; ``ladder`` is (level, key, region)."""
        ids = ladder.where((F.col("level") == level) & (F.col("region") == region)).select(self.key)
        return self._with("region", "region", ids, f"region {level}/{region}")

    def grain(self) -> View:
        """Another grain: what names regions of the old one goes, every other filter stays."""
        return self.remove("region", "region")

    def window(self, column: str, lo=None, hi=None) -> View:
        return self._with("window", column, window_filter(column, lo, hi), f"{column} {lo}..{hi}")

    def selection(self, ids: DataFrame, name: str = "held") -> View:
        return self._with("set", name, ids, name)

    def lasso(self, x: str, y: str, polygon: list[tuple[float, float]]) -> View:
        return self._with("lasso", "lasso", in_polygon(F.col(x), F.col(y), polygon), "lasso")

    def lasso3d(self, matrix: list[float], x: str, y: str, z: str, polygon: list[tuple[float, float]]) -> View:
        """A lasso drawn on a projected scene, in its coordinates of -1..1; what lies behind the eye or beyond the planes is not selected."""
        px, py, inside = projected(matrix, F.col(x), F.col(y), F.col(z))
        return self._with("lasso", "lasso", inside & in_polygon(px, py, polygon), "lasso")

    def unread(self, column: str = "read") -> View:
        return self._with("unread", column, ~F.coalesce(F.col(column), F.lit(False)), "unread")

    def remove(self, kind: str, name: str) -> View:
        return self._with(kind, name, None, "")

    def clear(self) -> View:
        return replace(self, filters=(), past=(*self.past, self.filters)[-32:])

    def undo(self) -> View:
        return replace(self, filters=self.past[-1], past=self.past[:-1]) if self.past else self

    def rows(self) -> DataFrame:
        """The nodes that pass every filter: the predicates in one where, each set a semi join."""
        conds = [f[2] for f in self.filters if f[0] not in SETS]
        out = self.nodes.where(functools.reduce(operator.and_, conds)) if conds else self.nodes
        for f in self.filters:
            if f[0] in SETS:
                out = out.join(f[2], self.key, "left_semi")
        return out

    def chips(self) -> DataFrame:
        """(label, n): each filter's own count, whatever the others say; the predicates in one pass."""
        conds = [(f[3], f[2]) for f in self.filters if f[0] not in SETS]
        spark = self.nodes.sparkSession
        parts = []
        if conds:
            one = self.nodes.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(f"c{i}") for i, (_, c) in enumerate(conds)])
            parts.append(one.select(F.explode(F.array(*[F.struct(F.lit(label).alias("label"), F.col(f"c{i}").alias("n")) for i, (label, _) in enumerate(conds)])).alias("x")).select("x.*"))
        parts += [self.nodes.join(f[2], self.key, "left_semi").agg(F.count("*").alias("n")).select(F.lit(f[3]).alias("label"), "n") for f in self.filters if f[0] in SETS]
        return functools.reduce(DataFrame.union, parts) if parts else spark.createDataFrame([], "label string, n bigint")

    def sorted(self, score: Column, cap: int = 2000) -> DataFrame:
        """The deck: by falling score, missing counting as 50, ties by node; at most ``cap`` rows."""
        return self.rows().withColumn("_s", F.coalesce(score, F.lit(50.0))).orderBy(F.desc("_s"), self.key).limit(cap).drop("_s")


def facets(nodes: DataFrame, column: str, coverage: float = 0.4, wide: int = 40) -> DataFrame:
    """(value, n, wide): counts of a categorical dimension, of its first element where it is an array.

    Blank values are absent. The dimension is dropped, no rows, if it has fewer than two values or covers less than 40 % of the nodes; more than 40 values are
    flagged wide.
    """
    c = F.col(column)
    c = F.get(c, F.lit(0)) if dict(nodes.dtypes)[column].startswith("array") else c.cast("string")
    v = nodes.select(F.when(c != "", c).alias("value"))
    counts = v.where("value is not null").groupBy("value").agg(F.count("*").alias("n"))
    total = v.agg(F.count("*").alias("_all"), F.count("value").alias("_have"), F.count_distinct("value").alias("_values"))
    joined = counts.crossJoin(F.broadcast(total)).where((F.col("_values") >= 2) & (F.col("_have") >= coverage * F.col("_all")))  # one row
    return joined.select("value", "n", (F.col("_values") > wide).alias("wide"))


def bounds(nodes: DataFrame, *columns: str) -> DataFrame:
    """The smallest and largest of each coordinate, and the span."""
    return nodes.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))], *[(F.max(c) - F.min(c)).alias(f"span_{c}") for c in columns])


def deck_lines(cards: DataFrame, *columns: str, scores: DataFrame | None = None, key: str = "node_id") -> DataFrame:
    """One JSON line per card; with ``scores`` (key, axis, score) each line also has the card's score on every axis, 50 where it has none."""
    if scores is not None:
        axes = [r[0] for r in scores.select("axis").distinct().orderBy("axis").collect()]  # at most a map's axes
        wide = scores.groupBy(key).agg(*[F.max(F.when(F.col("axis") == a, F.col("score"))).alias(a) for a in axes])
        named = F.struct(*[F.coalesce(F.col(f"`{a}`"), F.lit(50)).alias(a) for a in axes])
        cards, columns = cards.join(wide, key, "left").withColumn("scores", named), (*columns, "scores")
    return cards.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("line"))


def vault_names(cards: DataFrame, key: str, title: str) -> DataFrame:
    """(key, filename): a file name per card from its title, cleaned, cut to 80; of equal names the later ones get -2, -3, ..."""
    base = F.substring(F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(F.col(title), F.lit("")), '[\\\\/:*?"<>|#^\\[\\]\\x00-\\x1f]', " "), "\\s+", " ")), 1, 80)
    named = cards.select(F.col(key), F.when(F.trim(base) == "", "untitled").otherwise(F.trim(base)).alias("base"))
    from pyspark.sql import Window

    r = F.row_number().over(Window.partitionBy(F.lower("base")).orderBy(key))
    return named.withColumn("r", r).select(key, F.when(F.col("r") == 1, F.concat("base", F.lit(".md"))).otherwise(F.concat("base", F.lit("-"), "r", F.lit(".md"))).alias("filename"))
