"""Row-wise text functions as Column expressions: everything here stays in the JVM."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words too general to set a region apart.
STOPWORDS = (
    "the a an and or of to in on for with without from by as at into is are be was were been being it its this that these those "
    "you your they them their he she his her we our us i me my not no do does did can could would should may might must will shall "
    "have has had having if then than so such but nor only own same too very can't don't more most other some any each few all both "
    "then once here there when where why how what which who whom whose against between through during before after above below up "
    "down out off over under again further"
).split()
# What counts as a source file, and the floor below which a body is junk.
SOURCE_EXT = r"(?i)\.(md|markdown|txt)$"
MIN_CHARS = 200
BINARY_HEAD = 8192
# What is stripped from Markdown, in this order, and what it leaves.
MARKUP = (
    ("```[\\s\\S]*?```", " "),
    ("!\\[[^\\]]*\\]\\([^)]*\\)", " "),
    ("\\[([^\\]]*)\\]\\([^)]*\\)", "$1"),
    ("https?://\\S+", " "),
    ("[#>*_`|]+", " "),
    ("\\s+", " "),
    ("^ | $", ""),
)
# Frontmatter, a quoted value, the end of a link, a paper's number.
FRONT = "^---\\n([\\s\\S]*?)\\n---\\n?([\\s\\S]*)$"
VALUE = '(?m)^(?:{key}):\\s*"?([^"\\n]+)'
LINK_END = "[).,\"']+$"
PAPER_LINK, PAPER_BARE = "(?i)arxiv\\.org/(?:abs|pdf)/(\\d{4}\\.\\d{4,5})", "(?i)arxiv:\\s*(\\d{4}\\.\\d{4,5})"


def looks_binary(raw: Column) -> Column:
    """A NUL in the first 8,192 characters, or more than 30 % of them replacement or control characters other than tab and line ends."""
    head = F.substring(raw, 1, BINARY_HEAD)
    odd = F.length(F.regexp_replace(head, "[^\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\uFFFD]", ""))
    return head.contains("\u0000") | ((F.length(head) > 0) & (odd / F.length(head) > 0.3))


def strip_markdown(raw: Column) -> Column:
    """Running text: fences, images, link targets, addresses and markup removed, blanks collapsed."""
    return functools.reduce(lambda text, rule: F.regexp_replace(text, *rule), MARKUP, raw)


def front_matter(raw: Column) -> tuple[Column, Column]:
    """(front, rest); front is empty where there is none."""
    # group 1 is empty where nothing matches, so one test tells an empty front from none
    found = raw.startswith("---\n") & raw.rlike(FRONT)
    return F.when(found, F.regexp_extract(raw, FRONT, 1)).otherwise(""), F.when(found, F.regexp_extract(raw, FRONT, 2)).otherwise(raw)


def filled(c: Column) -> Column:
    return F.when(c != "", c)


def field(front: Column, key: str) -> Column:
    """A frontmatter value, without its opening quote; null if absent or empty."""
    return filled(F.trim(F.regexp_extract(front, VALUE.replace("{key}", key), 1)))


def tidy_link(c: Column) -> Column:
    return filled(F.regexp_replace(c, LINK_END, ""))


def tokens(text: Column) -> Column:
    """Lower-case words of three letters or more that are no stopwords, in order, repeats kept."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z][a-z'-]{2,}"), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(STOPWORDS))


def slug(text: Column, width: int = 40) -> Column:
    """Lower case, runs of anything but a-z and 0-9 as one hyphen, none at the ends, cut to width."""
    dashed = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.substring(dashed, 1, width)


def portable_source(source: Column) -> Column:
    """The last segment of an absolute path, anything else as it is."""
    return F.when(source.rlike("^(/|[A-Za-z]:[\\\\/]|~)"), F.element_at(F.split(F.regexp_replace(source, "[\\\\/]+$", ""), "[\\\\/]"), -1)).otherwise(source)


def arxiv_id(declared: Column, url: Column, body: Column) -> Column:
    """The paper id: as declared, else from an address, else a bare id in the text."""
    both = F.concat_ws(" ", url, body)
    linked = F.regexp_extract(both, PAPER_LINK, 1)
    bare = F.regexp_extract(both, PAPER_BARE, 1)
    return F.coalesce(filled(declared), filled(linked), filled(bare))


def card_text(title: Column, core: Column, notes: Column) -> Column:
    """What a card's embedding is made from: title, restatement and the placements that are filled."""
    head = F.when(F.coalesce(title, F.lit("")) != "", F.concat(title, F.lit(". "))).otherwise("")
    placed = F.array_join(F.filter(notes, lambda n: n.isNotNull() & (n != "")), ". ")
    return F.concat(head, F.coalesce(core, F.lit("")), F.lit(" "), placed)


def honest_percent(part: Column, whole: Column) -> Column:
    """A percentage that is not rounded away near its ends: below 2 or above 98 it has one decimal, and never reads 0 or 100 unless it is."""
    p = F.when(whole > 0, part * 100.0 / whole)
    one = F.round(p, 1)
    guarded = F.when((p > 0) & (one == 0), 0.1).when((p < 100) & (one == 100), 99.9).otherwise(one)
    return F.when((p < 2) | (p > 98), guarded).otherwise(F.round(p, 0))


def file_slug(title: Column) -> Column:
    """A file name's stem from a title: lower case, hyphens for anything else, at most 60, 'map' where nothing is left."""
    s = slug(title, 60)
    return F.when(F.coalesce(s, F.lit("")) == "", "map").otherwise(F.regexp_replace(s, "-+$", ""))


def year_month(ms: Column) -> Column:
    """The month of a time in milliseconds, as 2024-05."""
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM")
