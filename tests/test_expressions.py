import datetime as dt

import pytest
from pyspark.sql import functions as F

from gridlens.functions.expressions import (
    add_expressions, bucket, indexof, match, match_all, replace, replace_all, search, to_spark_sql,
    validate_expressions,
)

TEXTS = ["", None, "xyz", "a1b22c333", "a.b*c", "cost $5"]


@pytest.fixture
def text(spark):
    return spark.createDataFrame([(i, s) for i, s in enumerate(TEXTS)], "i int, s string")


def col(df, c):
    return [r[0] for r in df.orderBy("i").select(c).collect()]


def test_match_and_match_all(text):
    assert col(text, match("s", r"\d+")) == [False, None, False, True, False, True]
    assert col(text, match_all("s", r"[a-z]+")) == [False, None, True, False, False, False]


def test_search_and_indexof(text):
    assert col(text, search("s", r"(\d+)")) == [None, None, None, "1", None, "5"]
    assert col(text, indexof("s", r"\d")) == [None, None, None, 2, None, 7]
    with pytest.raises(ValueError):
        search("s", r"\d+")


def test_replace_first_and_all_with_special_replacement(text):
    assert col(text, replace("s", r"\d+", "$\\")) == ["", None, "xyz", "a$\\b22c333", "a.b*c", "cost $$\\"]
    assert col(text, replace_all("s", r"\d+", "#")) == ["", None, "xyz", "a#b#c#", "a.b*c", "cost $#"]
    assert col(text, replace_all("s", r"\.", "9")) == ["", None, "xyz", "a1b22c333", "a9b*c", "cost $5"]


def test_bucket_units(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 5, 17, 13, 45, 59, 123456),)], "ts timestamp")
    got = df.select(*[bucket("ts", u).alias(u + "_") for u in "smhdMy"]).first()
    assert got[0] == dt.datetime(2024, 5, 17, 13, 45, 59)
    assert got[1] == dt.datetime(2024, 5, 17, 13, 45)
    assert got[2] == dt.datetime(2024, 5, 17, 13)
    assert got[3] == dt.datetime(2024, 5, 17)
    assert got[4] == dt.datetime(2024, 5, 1)
    assert got[5] == dt.datetime(2024, 1, 1)
    with pytest.raises(ValueError):
        bucket("ts", "w")


def test_column_references_rewritten():
    assert to_spark_sql('"a b" + 1 || \'"lit"\'') == "`a b` + 1 || '\"lit\"'"


def test_expression_text_functions(spark, text):
    out = add_expressions(text, {"m": "match(\"s\", '\\\\d')", "r": "replace_first(\"s\", '\\\\d+', '#')",
                                 "ra": "replace_all(\"s\", '\\\\d', '')", "ix": "indexof(\"s\", 'b')",
                                 "later": '"ix" + 1'})
    rows = out.orderBy("i").collect()
    assert rows[3].m is True and rows[3].r == "a#b22c333" and rows[3].ra == "abc" and rows[3].ix == 3
    assert rows[3].later == 4 and rows[1].m is None


def test_validate_expressions(text):
    res = validate_expressions(text, {"ok": '"i" * 2', "bad": '"nope" + 1', "syntax": "1 +"})
    assert res["expression_schema"] == {"ok": "integer"}
    assert set(res["errors"]) == {"bad", "syntax"}


def test_replace_with_leading_digit(text, spark):
    assert col(text, replace("s", r"(\d)", "5x"))[3] == "a5xb22c333"
    out = add_expressions(text, {"r": "replace_first(\"s\", '([0-9])', '5x')"})
    assert [r.r for r in out.orderBy("i").collect()][3] == "a5xb22c333"
