"""View configuration: normalising, legacy spellings and validation.

V1 (the valid keys), V2 (legacy aliases), V3 (legacy ``aggregate`` list),
V5 (null placeholders in ``columns``), M9 (``is_valid_filter``) and A29
(an aggregate must suit its column's type).
"""

from __future__ import annotations

import dataclasses
import datetime as _dt
from typing import Any

# ---------------------------------------------------------------------------
# Config keys, legacy spellings, operator and aggregate names.
# ---------------------------------------------------------------------------
CONFIG_KEYS = (
    "version", "viewport", "group_by", "split_by", "aggregates", "columns", "filter",
    "sort", "computed_columns", "expressions", "group_by_depth", "split_by_depth", "filter_op",
)
LEGACY_KEYS = {
    "row_pivot": "group_by", "row-pivot": "group_by", "row-pivots": "group_by",
    "row_pivots": "group_by",
    "col_pivot": "split_by", "col_pivots": "split_by", "column_pivot": "split_by",
    "column-pivot": "split_by", "column-pivots": "split_by", "column_pivots": "split_by",
    "filters": "filter", "sorts": "sort",
}
# Options this library adds on top of the reference keys.
EXTRA_KEYS = ("leaves_only", "expanded", "order_by")

NUMBER_AGGREGATES = (
    "any", "avg", "abs sum", "count", "distinct count", "dominant", "first by index",
    "last by index", "last minus first", "last", "high", "join", "low", "high minus low",
    "max", "mean", "median", "min", "pct sum parent", "pct sum grand total", "stddev",
    "sum", "sum abs", "sum not null", "unique", "var",
)
TEXT_AGGREGATES = (
    "any", "count", "distinct count", "distinct leaf", "dominant", "first by index",
    "join", "last by index", "last", "unique",
)
BOOLEAN_AGGREGATES = (
    "any", "count", "distinct count", "distinct leaf", "dominant", "first by index",
    "last by index", "last", "unique",
)
AGGREGATES_BY_TYPE = {
    "string": TEXT_AGGREGATES, "float": NUMBER_AGGREGATES, "integer": NUMBER_AGGREGATES,
    "boolean": BOOLEAN_AGGREGATES, "datetime": TEXT_AGGREGATES, "date": TEXT_AGGREGATES,
}
ALL_AGGREGATES = tuple(dict.fromkeys(NUMBER_AGGREGATES + TEXT_AGGREGATES))
DEFAULT_AGGREGATE = {"integer": "sum", "float": "sum"}  # every other type: "count"

SORT_DIRECTIONS = (
    "none", "asc", "desc", "col asc", "col desc", "asc abs", "desc abs", "col asc abs",
    "col desc abs",
)

NUMBER_FILTERS = ("<", ">", "==", "<=", ">=", "!=", "is null", "is not null")
TEXT_FILTERS = ("==", "contains", "!=", "in", "not in", "begins with", "ends with",
                "is null", "is not null")
BOOLEAN_FILTERS = ("&", "|", "==", "!=", "or", "and", "is null", "is not null")
FILTERS_BY_TYPE = {
    "string": TEXT_FILTERS, "float": NUMBER_FILTERS, "integer": NUMBER_FILTERS,
    "boolean": BOOLEAN_FILTERS, "datetime": NUMBER_FILTERS, "date": NUMBER_FILTERS,
}
FILTER_OPS = ("and", "or")
PATH_SEPARATOR = "|"


class ConfigError(ValueError):
    pass


def default_aggregate(type_name: str) -> str:
    return DEFAULT_AGGREGATE.get(type_name, "count")


@dataclasses.dataclass
class ViewConfig:
    """A normalised view configuration."""

    group_by: list = dataclasses.field(default_factory=list)
    split_by: list = dataclasses.field(default_factory=list)
    columns: list | None = None
    aggregates: dict = dataclasses.field(default_factory=dict)
    filter: list = dataclasses.field(default_factory=list)
    filter_op: str = "and"
    sort: list = dataclasses.field(default_factory=list)
    expressions: dict = dataclasses.field(default_factory=dict)
    group_by_depth: int | None = None
    split_by_depth: int | None = None
    viewport: dict | None = None
    leaves_only: bool = False
    expanded: Any = None      # open row paths (B7): list of tuples or a DataFrame
    order_by: list | None = None  # arrival order columns for first/last aggregates

    def to_dict(self) -> dict:
        return {k: v for k, v in dataclasses.asdict(self).items() if k != "expanded"}


def parse_expressions(expressions) -> dict[str, str]:
    """``{alias: text}`` or legacy list of texts -> ordered ``{alias: text}``.

    The alias is the key, or a leading ``//alias`` comment, or the text
    itself.  A later duplicate alias replaces an earlier one.
    """
    if not expressions:
        return {}
    items = expressions.items() if isinstance(expressions, dict) else ((None, e) for e in expressions)
    out: dict[str, str] = {}
    for alias, text in items:
        body = text.strip()
        lines = body.split("\n")
        if lines and lines[0].lstrip().startswith("//"):
            comment_alias = lines[0].lstrip()[2:].strip()
            body = "\n".join(lines[1:]).strip()
            alias = alias or comment_alias
        alias = alias or body
        out.pop(alias, None)
        out[alias] = body
    return out


def normalize_config(config: dict | ViewConfig | None) -> ViewConfig:
    """Validate keys and fold legacy spellings into a ``ViewConfig`` (V1-V5)."""
    if isinstance(config, ViewConfig):
        return config
    config = dict(config or {})
    out: dict[str, Any] = {}
    for key, value in config.items():
        if key in LEGACY_KEYS:
            new = LEGACY_KEYS[key]
            if new in out or new in config:
                raise ConfigError(f'"{key}" is an old name of "{new}"; give one of the two')
            out[new] = value
        elif key == "aggregate":
            out["aggregates"] = {a["column"]: a["op"] for a in value}
            out["columns"] = [a["column"] for a in value]
        elif key in CONFIG_KEYS or key in EXTRA_KEYS:
            out[key] = value
        else:
            raise ConfigError(f'"{key}" is no part of a view; known are {sorted(CONFIG_KEYS)}')
    if out.get("computed_columns"):
        raise ConfigError('"computed_columns" is replaced by "expressions"')
    out.pop("computed_columns", None)
    out.pop("version", None)
    for k in ("group_by", "split_by"):
        v = out.get(k) or []
        out[k] = [v] if isinstance(v, str) else list(v)
    if out.get("columns") is not None:
        out["columns"] = [c for c in out["columns"] if c is not None]
    out["sort"] = [list(s) for s in out.get("sort") or []]
    for s in out["sort"]:
        if len(s) != 2 or s[1] not in SORT_DIRECTIONS:
            raise ConfigError(f"bad sort clause {s!r}")
    out["filter"] = [list(f) for f in out.get("filter") or []]
    out["filter_op"] = (out.get("filter_op") or "and").lower()
    if out["filter_op"] not in FILTER_OPS:
        raise ConfigError(f"bad filter_op {out['filter_op']!r}")
    out["expressions"] = parse_expressions(out.get("expressions"))
    out["aggregates"] = dict(out.get("aggregates") or {})
    return ViewConfig(**out)


def _parses_as_date(value) -> bool:
    if isinstance(value, (_dt.date, _dt.datetime)):
        return True
    if not isinstance(value, str):
        return False
    try:
        _dt.datetime.fromisoformat(value.strip().replace("Z", "+00:00"))
        return True
    except ValueError:
        return False


#: A clause ``["", ANY_OF, clauses]`` holds where at least one of its clauses does (made by drill-through).
ANY_OF = "any of"


def is_valid_filter(schema: dict[str, str], clause) -> bool:
    """M9: a filter clause is usable.

    Null checks are always valid; otherwise the operand must be non-null and,
    for date / datetime columns, must parse as a date.
    """
    if len(clause) < 2:
        return False
    col, op = clause[0], clause[1]
    if op in ("is null", "is not null"):
        return True
    if op == ANY_OF:
        return any(is_valid_filter(schema, c) for c in clause[2])
    if len(clause) < 3 or clause[2] is None:
        return False
    if schema.get(col) in ("date", "datetime"):
        return _parses_as_date(clause[2])
    return True


def validate(cfg: ViewConfig, schema: dict[str, str]) -> None:
    """Check column names, filter operators and aggregates against types."""
    for col in cfg.group_by + cfg.split_by:
        if col not in schema:
            raise ConfigError(f"unknown column {col!r}")
    for col in cfg.columns or []:
        if col not in schema:
            raise ConfigError(f"unknown column {col!r}")
    for col, agg in cfg.aggregates.items():
        name = agg if isinstance(agg, str) else agg[0]
        if col not in schema:
            continue  # an aggregate for a column the view does not show is ignored
        allowed = AGGREGATES_BY_TYPE.get(schema[col], ())
        if name not in allowed:
            raise ConfigError(f"aggregate {name!r} is not valid for {schema[col]} column {col!r}")
    for clause in [x for c in cfg.filter for x in (c[2] if c[1:2] == [ANY_OF] else [c])]:
        if clause[0] not in schema:
            raise ConfigError(f"unknown filter column {clause[0]!r}")
        allowed = FILTERS_BY_TYPE.get(schema[clause[0]], ())
        if clause[1] not in allowed:
            raise ConfigError(f"filter {clause[1]!r} is not valid for {schema[clause[0]]} column {clause[0]!r}")
    for col, _ in cfg.sort:
        if col not in schema:
            raise ConfigError(f"unknown sort column {col!r}")
