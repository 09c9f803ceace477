"""Small inputs shared by the tests."""

from __future__ import annotations

import glob
import os

import duckdb

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

#: Nulls, empties, blanks, ties, repeated rows and a long text.
ODD = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, " \t\n \x0b", "en", "a", 5),
    (4, "one", "en", None, 3),
    (5, "the cat sat on the mat and looked at the moon for a long while", "en", "b", 63),
    (5, "the cat sat on the mat and looked at the moon for a long while", "en", "b", 63),
    (6, "the cat sat on the mat and looked at the moon for a long while", "en", "b", 63),
    (None, "the cat sat on the mat and looked at the moon for a long while", "en", "b", 63),
    (7, "x" * 50_000 + " " + "word " * 40_000, "en", "c", 250_001),
    (8, "1234 5678 !!! ???", None, "c", 17),
    (9, "Émile était là hier \U0001f600 ß", "fr", "é", 25),
]

#: Further columns named like those the operators use inside.
EXTRA = {
    "size": "1", "copies": "2", "label": "'x'", "line": "'y'", "words": "'z'", "removed": "'r'", "fp": "3",
    "component_id": "4", "score": "0.5", "seed": "5", "rep": "6", "row": "7", "h1": "8", "first": "9",
}


def odd(spark, extra: bool = False):
    df = spark.createDataFrame(ODD, SCHEMA)
    return df.selectExpr("*", *[f"{v} AS {k}" for k, v in EXTRA.items()]) if extra else df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(sf: str = SF) -> list[tuple[int, str]]:
    return duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet' ORDER BY doc_id").fetchall()


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def duck(sf: str = SF):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def normal(found, columns):
    show = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(show(r[i]) for i in order) for r in found)
