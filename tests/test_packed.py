"""The packed-field splitter against a character-wise parser and hand-made cases."""

import json
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from atlaspark.operators.packed import explode_packed, split_values

CASES = [
    ("a; b", True, ["a", "b"]),
    ("  a ; b ", True, ["a", "b"]),
    ('"a; b", c', True, ["a; b", "c"]),
    ("reader's guide / singer's hour", True, ["reader's guide", "singer's hour"]),
    ("'a | b'|c", True, ["a | b", "c"]),
    ("“a, b”；d、e，f", True, ["a, b", "d", "e", "f"]),
    ("- x\n- y-z\n* q", True, ["x", "y-z", "q"]),
    ('["a, b", "c"]', True, ["a, b", "c"]),
    ('["Iverley, Ada", "Bo Vask"]', False, ["Iverley, Ada", "Bo Vask"]),
    ("Iverley, Ada; Bo & Co and Sons Jr.", False, ["Iverley, Ada", "Bo & Co and Sons Jr."]),
    ('"so-called \\"deep\\" time", x', True, ['so-called "deep" time', "x"]),
    ('"so-called ""deep"" time",x', True, ['so-called "deep" time', "x"]),
    (";; a ;;b;", True, ["a", "b"]),
    (" , ", True, []),
    ("", True, []),
    ("a\r\nb\tc", True, ["a", "b", "c"]),
    ("a;a;a", True, ["a", "a", "a"]),
    ("hip-hop · R&B • vol. 2", True, ["hip-hop", "R&B", "vol. 2"]),
]


@pytest.mark.parametrize("commas", [True, False])
def test_cases(spark, commas):
    cases = [c for c in CASES if c[1] == commas]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, t string")
    got = {r.i: r.v for r in df.select("i", split_values(F.col("t"), commas).alias("v")).collect()}
    assert [got[i] for i in range(len(cases))] == [c[2] for c in cases]


def quoted(values, sep):
    """Write values as a packed string that needs its quotes."""
    return sep.join('"' + v.replace('"', '""') + '"' if re.search(r"[;,|/·]", v) or v.startswith('"') else v for v in values)


@settings(max_examples=12, deadline=None)
@given(st.lists(st.lists(st.text("abc ;,|/é", min_size=1, max_size=8).map(str.strip).filter(bool), min_size=1, max_size=5), min_size=1, max_size=20), st.sampled_from([";", " ; ", "|", ","]))
def test_round_trip(spark, lists, sep):
    df = spark.createDataFrame([(i, quoted(v, sep)) for i, v in enumerate(lists)], "i int, t string")
    got = {r.i: r.v for r in df.select("i", split_values(F.col("t")).alias("v")).collect()}
    assert [got[i] for i in range(len(lists))] == lists


def test_explode(spark):
    rows = [
        (1, json.dumps({"genre": "a; b", "keywords": ["x; y", "", None, " z "], "credits": None}), "p"),
        (2, None, "p"),
        (3, "no json", "p"),
        (4, json.dumps({"genre": 5, "other": "a;b", "keywords": [], "credits": "B, A; C"}), "p"),
        (5, json.dumps({"genre": ["[not, a list]"], "keywords": ";" * 3000 + "end"}), "p"),
        (5, json.dumps({"genre": "twice"}), "p"),
        (6, '{"x": {"genre": ["q"]}, "genre": "[g; h]"}', "p"),
        (7, '{"genre": "i", "genre": ["j, k"]}', "p"),
    ]
    df = spark.createDataFrame(rows, "file_id long, meta string, value string")
    got = {(r.file_id, r.field, r.pos, r.value) for r in explode_packed(df, "meta", {"genre": True, "keywords": True, "credits": False}, "file_id").collect()}
    assert got == {(1, "genre", 0, "a"), (1, "genre", 1, "b"), (1, "keywords", 0, "x; y"), (1, "keywords", 1, "z"), (4, "genre", 0, "5"), (4, "credits", 0, "B, A"), (4, "credits", 1, "C"), (5, "genre", 0, "[not, a list]"), (5, "keywords", 0, "end"), (5, "genre", 0, "twice"), (6, "genre", 0, "g"), (6, "genre", 1, "h"), (7, "genre", 0, "j, k")}
    assert explode_packed(df.limit(0), "meta", {"genre": True}, "file_id").count() == 0
