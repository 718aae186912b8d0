"""Drill-through and cross-filtering between views.

These are config functions: a selection becomes filter clauses on the base
table, which Catalyst pushes to the scan.  A selection given as a DataFrame
(many keys) becomes a semi join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from gridlens.config import ANY_OF, PATH_SEPARATOR, ConfigError, normalize_config
from gridlens.operators.filters import semi_filter


def _eq(col: str, value) -> list:
    return [col, "is null"] if value is None else [col, "==", value]


def _split_tuple(cfg, column) -> tuple:
    """The split values of a selected column: the typed tuple itself, or a column path that can be read only one way."""
    if not isinstance(column, str):
        return tuple(column)
    parts = column.split(PATH_SEPARATOR)[:-1]
    if len(parts) != len(cfg.split_by):
        raise ConfigError(f"column path {column!r} does not name one value per split level; pass the tuple of values")
    return tuple(None if v == "null" else v for v in parts)


def selection_filters(config, row_path=(), column=None) -> list:
    """A selected cell -> one equality clause per group / split level.

    ``column`` is the tuple of split values (typed, null as None) or the column path.
    """
    cfg = normalize_config(config)
    out = [_eq(c, v) for c, v in zip(cfg.group_by, row_path)]
    if column is not None and cfg.split_by:
        out += [_eq(c, v) for c, v in zip(cfg.split_by, _split_tuple(cfg, column))]
    return out


def controlled_columns(config) -> list[str]:
    """The columns a view controls in others: all it groups by, splits by or filters on."""
    cfg = normalize_config(config)
    filtered = [x[0] for c in cfg.filter for x in (c[2] if c[1] == ANY_OF else [c])]
    return list(dict.fromkeys([*cfg.group_by, *cfg.split_by, *filtered]))


def merge_filters(target: list, sender: list, sender_columns, target_columns=None) -> list:
    """The sender's clauses (on columns the target has) first; the target's
    clauses on columns the sender controls are dropped; one clause per column."""
    controlled = set(sender_columns)
    known = set(target_columns) if target_columns is not None else None
    out, seen = [], set()
    for clause in list(sender) + [c for c in target if c[0] not in controlled]:
        if known is not None and clause[0] not in known:
            continue
        if clause[0] in seen:
            continue
        seen.add(clause[0])
        out.append(list(clause))
    return out


def drill_through(config, row_path=(), column=None) -> dict:
    """The config of the rows behind a selected cell.

    The base filter stays whole: clauses joined by ``or`` become one clause,
    so that the selection narrows them.  Computed columns come along.
    """
    cfg = normalize_config(config)
    sel = selection_filters(cfg, row_path, column)
    if cfg.filter_op == "or" and len(cfg.filter) > 1:
        base = [["", ANY_OF, [list(c) for c in cfg.filter]]]
    else:
        base = [c for c in cfg.filter if c[0] not in {s[0] for s in sel}]
    out = {"filter": base + sel, "filter_op": "and"}
    if cfg.expressions:
        out["expressions"] = dict(cfg.expressions)
    return out


def global_filter(targets: dict[str, tuple[list, list]], sender: str, selection: list,
                  controls: list[str] | None = None) -> dict[str, list]:
    """Apply a master selection to every other view that has the columns.

    ``targets``: ``{name: (filters, table columns)}``.  Returns new filters.
    ``controls`` are the sender's :func:`controlled_columns`: clauses on them
    are replaced by the selection's, so an empty selection (deselect) or a
    shallower one clears what an earlier one set.  By default the columns of
    the selection.
    """
    cols = list(dict.fromkeys([*(controls or []), *[c[0] for c in selection]]))
    out = {}
    for name, (filters, columns) in targets.items():
        shared = name != sender and set(cols) & set(columns)
        out[name] = merge_filters(filters, selection, cols, columns) if shared else filters
    return out


def linked_filter(targets: dict[str, tuple[list, list]], sender: str, selection: list,
                  linked: set[str], controls: list[str] | None = None) -> dict[str, list]:
    """As J2, restricted to views linked with the sender (never the sender)."""
    sub = {k: v for k, v in targets.items() if k in linked or k == sender}
    out = {k: v[0] for k, v in targets.items()}
    out.update(global_filter(sub, sender, selection, controls))
    return out


def filter_by_selection(target: DataFrame, selection: DataFrame, on) -> DataFrame:
    """J2 for many selected keys: a semi join."""
    return semi_filter(target, selection, on)
