"""Filter clauses ``[column, op, value]`` -> one Spark predicate.

The predicate is a plain Catalyst expression, so comparisons on a table
column reach the Parquet scan as pushed filters.  Lists of any length are one
``IN`` (a hash set inside the scan's codegen); keys held in a DataFrame are
joined by :func:`semi_filter`.
"""

from __future__ import annotations

import datetime as _dt
import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlens.config import ANY_OF, ConfigError, is_valid_filter


def _operand(value, type_name: str) -> Column:
    """The value as a literal of the column's type.

    A date or time goes to Spark as text, so it means the same instant
    whatever the time zone of the driver's host: a text or datetime without a
    zone is wall-clock time in the session's zone, one with a zone an instant.
    """
    if type_name not in ("date", "datetime") or value is None:
        return F.lit(value)
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return F.timestamp_millis(F.lit(int(value))).cast("date" if type_name == "date" else "timestamp")
    v = value if isinstance(value, str) else value.isoformat()
    if type_name == "date":
        return F.lit(_dt.datetime.fromisoformat(v.strip().replace("Z", "+00:00")).date().isoformat()).cast("date")
    return F.lit(v.strip()).cast("timestamp")


def _list(value) -> list:
    """The members of a list operand; a null matches nothing and is left out."""
    return [v for v in (value if isinstance(value, (list, tuple, set)) else [value]) if v is not None]


def _flag(value) -> Column:
    """A boolean operand; the texts ``false`` and ``0`` are false."""
    return F.lit(value.strip().lower() not in ("false", "0", "") if isinstance(value, str) else bool(value))


def clause_predicate(clause, schema: dict[str, str]) -> Column:
    col, op = clause[0], clause[1]
    if op == ANY_OF:
        return build_predicate(clause[2], "or", schema)
    c = F.col(f"`{col}`")
    if op == "is null":
        return c.isNull()
    if op == "is not null":
        return c.isNotNull()
    kind = schema.get(col, "string")
    if op in ("in", "not in"):
        found = c.isin([_operand(v, kind) for v in _list(clause[2])])
        return found if op == "in" else c.isNotNull() & ~found
    value = _operand(clause[2], kind)
    if op == "<":
        return c < value
    if op == ">":
        return c > value
    if op == "<=":
        return c <= value
    if op == ">=":
        return c >= value
    if op == "==":
        return c == value
    if op == "!=":
        return c != value
    if op == "contains":
        return c.contains(value)
    if op == "begins with":
        return c.startswith(value)
    if op == "ends with":
        return c.endswith(value)
    if op in ("&", "and"):
        return c & _flag(clause[2])
    if op in ("|", "or"):
        return c | _flag(clause[2])
    raise ConfigError(f"unknown filter operator {op!r}")


def build_predicate(clauses, filter_op: str, schema: dict[str, str]) -> Column | None:
    """All valid clauses joined by ``and`` / ``or``; invalid clauses are skipped (M9)."""
    preds = [clause_predicate(c, schema) for c in clauses if is_valid_filter(schema, c)]
    if not preds:
        return None
    return functools.reduce(operator.or_ if filter_op == "or" else operator.and_, preds)


def apply_filters(df: DataFrame, clauses, filter_op: str = "and") -> DataFrame:
    from gridlens.types import table_schema

    pred = build_predicate(clauses, filter_op, table_schema(df))
    return df if pred is None else df.where(pred)


def semi_filter(df: DataFrame, selection: DataFrame, on, *, anti: bool = False) -> DataFrame:
    """Keep (or drop) rows whose key is in ``selection`` (J2, X1); columns stay as they are.

    Spark broadcasts the selection where it finds it small and joins by
    shuffle, splitting hot keys, where it doesn't.
    """
    cols = [on] if isinstance(on, str) else list(on)
    sel = selection.select(*cols).distinct()
    return df.join(sel, cols, "left_anti" if anti else "left_semi").select(*[F.col(f"`{c}`") for c in df.columns])
