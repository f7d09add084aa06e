from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from branchlore.functions import text
from branchlore.functions.sql import register_functions
from branchlore.operators.enrich import commit_trailers, enrich
from branchlore.schema import FIELD_NAMES, TRAILER_CATALOG

COLUMN = {f.trailer_field: f.column_name for f in TRAILER_CATALOG}

GOLDEN = {
    "G1": ("s\n\nReported-by: A <a@x>\nBug: #1\n", {"Reported-by": ["A <a@x>"], "Bug": ["#1"]}, ["A <a@x>"], []),
    "G2": ("s\r\nreported-BY:  A  \r\nReported-by: A\r\n", {"Reported-by": ["A", "A"]}, ["A"], []),
    "G3": (" Reported-by: indented\n\tBug: tab", {}, [], []),
    "G4": ("Bug:\nBug:   \nBug:x", {"Bug": ["x"]}, [], []),
    "G5": (
        "Discussion: https://e.org/a:b?c=1, <https://e.org/d>.\nBug: https://e.org/a:b?c=1,",
        {
            "Discussion": ["https://e.org/a:b?c=1, <https://e.org/d>."],
            "Bug": ["https://e.org/a:b?c=1,"],
        },
        [],
        ["https://e.org/a:b?c=1,", "https://e.org/d"],
    ),
    "G6": ("Bug: one\rBug: two", {"Bug": ["one\rBug: two"]}, [], []),
    "G7": (
        "Reviewed-by: B\nReported-by: A\nTested-by: B ",
        {"Reported-by": ["A"], "Reviewed-by": ["B"], "Tested-by": ["B"]},
        ["A", "B"],
        [],
    ),
    "G8": (None, {}, [], []),
    "G9": ("Bugs: no\nBug-x: no\nBug : no", {}, [], []),
    "G10": (
        "Bug: 1\t\nAuthor: https://p.org/~me (me)",
        {"Bug": ["1\t"], "Author": ["https://p.org/~me (me)"]},
        ["https://p.org/~me (me)"],
        ["https://p.org/~me"],
    ),
}


@pytest.fixture(scope="module")
def golden(spark):
    from branchlore.schema import COMMIT_SCHEMA

    names = COMMIT_SCHEMA.fieldNames()
    rows = [tuple({"commit_id": k, "message": v[0]}.get(n) for n in names) for k, v in GOLDEN.items()]
    log = spark.createDataFrame(rows, COMMIT_SCHEMA).select(F.lit("master").alias("branch"), "*")
    return enrich(log).cache()


@pytest.mark.parametrize("key", GOLDEN)
def test_golden_messages(golden, key):
    _, fields, people, urls = GOLDEN[key]
    row = golden.where(F.col("commit_id") == key).first()
    for field in FIELD_NAMES:
        assert row[COLUMN[field]] == fields.get(field, []), field
    assert row["mentioned_people"] == people
    assert row["mentioned_urls"] == urls


def test_trailer_rows_of_golden_messages(golden):
    rows = commit_trailers(golden).where(F.col("commit_id") == "G2").collect()
    assert [(r["trailer_field"], r["trailer_value"], r["people"], r["urls"]) for r in rows] == [
        ("Reported-by", "A", ["A"], []),
        ("Reported-by", "A", ["A"], []),
    ]
    urls = commit_trailers(golden).where("commit_id = 'G10'").select("trailer_field", "people", "urls")
    assert {r[0]: (r[1], r[2]) for r in urls.collect()} == {
        "Bug": ([], []),
        "Author": (["https://p.org/~me (me)"], ["https://p.org/~me"]),
    }


def values_by_line(message: str | None, field: str) -> list[str]:
    """The definition, step by step: lines, key check, key equality, value, blanks."""
    found = []
    for line in re.split("\r?\n", message or ""):
        if re.match("[A-Za-z0-9-]+:", line):
            key, _, value = line.partition(":")
            if key.lower() == field.lower() and value.strip(" "):
                found.append(value.strip(" "))
    return found


def random_messages(count: int) -> list[str]:
    rng = random.Random(7)
    parts = ["Bug", "bug:", "Bug:", "BUG: ", "Author:", "Reported-by: ", "x", " ", "  ", "\n", "\n", "\r\n", "\r", "\t"]
    parts += ["\u0085", " ", "K", ":", "-", "é", "http://a/b", "Backpatch-through: 14", "tested-BY:"]
    return ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(count)]


def test_extraction_agrees_with_the_definition_on_random_messages(spark):
    messages = random_messages(20_000)
    df = spark.createDataFrame([(m,) for m in messages], "message string")
    checked = ("Bug", "Author", "Reported-by", "Tested-by", "Backpatch-through")
    direct = [text.extract_field("message", f).alias(f"d{i}") for i, f in enumerate(checked)]
    lines = df.withColumn("lines", text.trailer_lines("message"))
    via = [text.extract_field("lines", f).alias(f"v{i}") for i, f in enumerate(checked)]
    hits = 0
    for row in lines.select("message", *direct, *via).collect():
        for i, field in enumerate(checked):
            expected = values_by_line(row["message"], field)
            hits += bool(expected)
            assert row[f"d{i}"] == expected, (row["message"], field)
            assert row[f"v{i}"] == expected, (row["message"], field)
    assert hits > 3000


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def texts(*values):
    return F.array(*[F.lit(v).cast("string") for v in values]).cast("array<string>")


def test_unique_text_array(spark):
    assert one(spark, text.unique_text_array(texts(" b", "a", None, "b ", "", "  ", "\tb", "a"))) == ["b", "a", "\tb"]
    assert one(spark, text.unique_text_array(F.lit(None).cast("array<string>"))) == []
    again = text.unique_text_array(text.unique_text_array(texts("b ", "b", "c")))
    assert one(spark, again) == ["b", "c"]


def test_extract_urls(spark):
    values = texts('see "http://a/1" (https://b/2)', None, "http://a/1 http://c/3.", "HTTP://no ftp://no https://")
    assert one(spark, text.extract_urls(values)) == ["http://a/1", "https://b/2", "http://c/3."]
    assert one(spark, text.extract_urls(F.lit(None).cast("array<string>"))) == []


def test_unknown_field_is_an_error(spark):
    with pytest.raises(ValueError, match="bug"):
        text.extract_field("message", "bug")
    assert one(spark, text.extract_field(F.lit("Bug: 1"), None)) == []


def test_categories(spark):
    rows = spark.createDataFrame([(f,) for f in FIELD_NAMES], "f string").select(
        "f", text.is_person_trailer("f").alias("p"), text.trailer_category("f").alias("c")
    )
    reference = {"Bug", "Discussion", "Backpatch-through"}
    for field, person, category in rows.collect():
        assert person == (field not in reference)
        assert category == ("reference" if field in reference else "person")


def test_sql_functions_match_column_functions(spark, tables):
    assert set(register_functions(spark)) == {
        "branch_suffix",
        "is_person_trailer",
        "unique_text_array",
        "extract_urls",
        "extract_field",
    }
    tables["master"].createOrReplaceTempView("master_log")
    for field in FIELD_NAMES:
        sql = spark.sql(f"SELECT commit_id, extract_field(message, '{field}') v FROM master_log")
        column = tables["master"].select("commit_id", text.extract_field("message", field).alias("v"))
        assert sql.exceptAll(column).isEmpty()
    with pytest.raises(Exception, match="unknown trailer field: bug"):
        spark.sql("SELECT extract_field('Bug: 1', 'bug')").collect()
    assert spark.sql("SELECT extract_field('Bug: 1', NULL)").first()[0] == []
