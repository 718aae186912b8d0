"""Computed columns and the scalar functions of the expression language.

Expression text is Spark SQL.  Two spellings of the view language are
accepted on top: ``"col"`` is a column reference (rewritten to backticks)
and the functions below are registered as SQL functions, so they inline
into the plan and stay inside whole-stage codegen.
"""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Bucket units of the view language and their date_trunc names.
BUCKET_UNITS = {"s": "SECOND", "m": "MINUTE", "h": "HOUR", "d": "DAY", "M": "MONTH", "y": "YEAR"}


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bucket(ts, unit: str) -> Column:
    """truncate a timestamp to second, minute, hour, day, month or year."""
    if unit not in BUCKET_UNITS:
        raise ValueError(f"unknown bucket unit {unit!r}; use one of {list(BUCKET_UNITS)}")
    return F.date_trunc(BUCKET_UNITS[unit], _col(ts))


def match(s, pattern: str) -> Column:
    """the pattern matches somewhere in the string."""
    return F.regexp_like(_col(s), F.lit(pattern))


def match_all(s, pattern: str) -> Column:
    """the pattern matches the whole string."""
    return F.regexp_like(_col(s), F.lit(f"^(?:{pattern})$"))


def _check_group(pattern: str) -> None:
    if re.compile(pattern).groups < 1:
        raise ValueError(f"search pattern {pattern!r} needs a capture group")


def search(s, pattern: str) -> Column:
    """first capture group of the first match, null when nothing matches."""
    _check_group(pattern)
    c = _col(s)
    return F.when(F.regexp_like(c, F.lit(pattern)), F.regexp_extract(c, pattern, 1))


def indexof(s, pattern: str) -> Column:
    """1-based position of the first match, null when nothing matches."""
    return F.nullif(F.regexp_instr(_col(s), F.lit(pattern)), F.lit(0))


def _escape_replacement(r: str) -> str:
    return r.replace("\\", "\\\\").replace("$", "\\$")


def replace(s, pattern: str, replacement: str) -> Column:
    """replace the first match only."""
    re.compile(f"(?s)^(.*?)(?:{pattern})")  # validates the pattern early
    rep = _escape_replacement(replacement)
    if replacement[:1].isdigit():
        rep = "\\" + rep  # "$1" + "5" would read as group 15
    return F.regexp_replace(_col(s), F.lit(f"(?s)^(.*?)(?:{pattern})"), F.lit("$1" + rep))


def replace_all(s, pattern: str, replacement: str) -> Column:
    """replace every match."""
    return F.regexp_replace(_col(s), F.lit(pattern), F.lit(_escape_replacement(replacement)))


# SQL definitions of the same functions, for use inside expression text.
_SQL_FUNCTIONS = {
    "bucket": (
        "bucket(ts TIMESTAMP, unit STRING) RETURNS TIMESTAMP RETURN date_trunc(CASE unit "
        + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in BUCKET_UNITS.items())
        + " END, ts)"
    ),
    "match": "match(s STRING, p STRING) RETURNS BOOLEAN RETURN regexp_like(s, p)",
    "match_all": "match_all(s STRING, p STRING) RETURNS BOOLEAN RETURN regexp_like(s, concat('^(?:', p, ')$'))",
    "search": ("search(s STRING, p STRING) RETURNS STRING RETURN "
               "CASE WHEN regexp_like(s, p) THEN regexp_extract(s, p, 1) END"),
    "indexof": "indexof(s STRING, p STRING) RETURNS INT RETURN nullif(regexp_instr(s, p), 0)",
    "replace_first": (
        "replace_first(s STRING, p STRING, r STRING) RETURNS STRING RETURN "
        "regexp_replace(s, concat('(?s)^(.*?)(?:', p, ')'), "
        "concat('$1', CASE WHEN r RLIKE '^[0-9]' THEN '\\\\' ELSE '' END, "
        "replace(replace(r, '\\\\', '\\\\\\\\'), '$', '\\\\$')))"
    ),
    "replace_all": (
        "replace_all(s STRING, p STRING, r STRING) RETURNS STRING RETURN "
        "regexp_replace(s, p, replace(replace(r, '\\\\', '\\\\\\\\'), '$', '\\\\$'))"
    ),
}


def register_sql_functions(spark: SparkSession) -> None:
    """Register the view-language functions as session SQL functions."""
    for body in _SQL_FUNCTIONS.values():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {body}")


_TOKEN = re.compile(r"'(?:[^'\\]|\\.)*'|\"((?:[^\"\\]|\\.)*)\"")


def to_spark_sql(text: str) -> str:
    """Rewrite ``"name"`` column references to backticks; leave 'strings' alone."""
    def sub(m: re.Match) -> str:
        if m.group(1) is None:
            return m.group(0)
        return "`" + m.group(1).replace("`", "``") + "`"
    return _TOKEN.sub(sub, text)


def compile_expression(text: str) -> Column:
    """V6: expression text -> Column."""
    return F.expr(to_spark_sql(text))


def add_expressions(df: DataFrame, expressions: dict[str, str]) -> DataFrame:
    """Add computed columns; later aliases may use earlier ones."""
    if not expressions:
        return df
    register_sql_functions(df.sparkSession)
    for alias, text in expressions.items():
        df = df.withColumn(alias, compile_expression(text))
    return df


def validate_expressions(df: DataFrame, expressions) -> dict:
    """M8: ``{expression_schema: {alias: type}, errors: {alias: message}}``."""
    from gridlens.config import parse_expressions
    from gridlens.types import type_name

    register_sql_functions(df.sparkSession)
    exprs = parse_expressions(expressions)
    schema, errors = {}, {}
    for alias, text in exprs.items():
        try:
            dt = df.select(compile_expression(text).alias("x")).schema["x"].dataType
            schema[alias] = type_name(dt)
        except (AnalysisException, ParseException) as e:
            errors[alias] = {"error_message": str(e).split("\n")[0]}
    return {"expression_schema": schema, "errors": errors}
