"""Queries of the packed-field operator."""

from ..operators.packed import explode_packed
from ..session import once, table

FIELDS = {"genre": True, "keywords": True, "credits": False}


def p1_found(spark, sf_dir):
    files = once(table(spark, sf_dir, "ingest_files").select("file_id", "meta"), "file_id")
    return explode_packed(files, "meta", FIELDS, "file_id")


QUERIES = {"p1_found": p1_found}
ORACLE = {}
