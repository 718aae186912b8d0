import pytest

from gridlens.config import (
    ConfigError, NUMBER_AGGREGATES, TEXT_AGGREGATES, BOOLEAN_AGGREGATES, default_aggregate,
    is_valid_filter, normalize_config, parse_expressions, validate,
)

SCHEMA = {"k": "string", "a": "integer", "b": "float", "flag": "boolean", "t": "datetime", "d": "date"}


def test_legacy_aliases():
    cfg = normalize_config({"row_pivots": ["k"], "column-pivots": ["flag"], "filters": [["a", ">", 1]],
                            "sorts": [["a", "desc"]]})
    assert cfg.group_by == ["k"] and cfg.split_by == ["flag"]
    assert cfg.filter == [["a", ">", 1]] and cfg.sort == [["a", "desc"]]


def test_alias_clash_and_unknown_key():
    with pytest.raises(ConfigError):
        normalize_config({"row_pivots": ["k"], "group_by": ["a"]})
    with pytest.raises(ConfigError):
        normalize_config({"nope": 1})


def test_legacy_aggregate_list_sets_columns():
    cfg = normalize_config({"aggregate": [{"column": "a", "op": "sum"}, {"column": "k", "op": "count"}]})
    assert cfg.aggregates == {"a": "sum", "k": "count"} and cfg.columns == ["a", "k"]


def test_null_column_placeholder_dropped():
    assert normalize_config({"columns": ["a", None, "b"]}).columns == ["a", "b"]


def test_expression_aliases():
    e = parse_expressions(['//x\n"a" + 1', '"b"', '//x\n"a" * 2'])
    assert list(e) == ['"b"', "x"] and e["x"] == '"a" * 2'
    assert parse_expressions({"y": '//ignored\n"a"'}) == {"y": '"a"'}


def test_is_valid_filter():
    assert is_valid_filter(SCHEMA, ["a", "is null"])
    assert not is_valid_filter(SCHEMA, ["a", "==", None])
    assert is_valid_filter(SCHEMA, ["t", ">", "2024-01-31"])
    assert not is_valid_filter(SCHEMA, ["t", ">", "abc"])


def test_aggregate_type_check():
    validate(normalize_config({"aggregates": {"a": "median", "k": "join"}}), SCHEMA)
    with pytest.raises(ConfigError):
        validate(normalize_config({"aggregates": {"k": "median"}}), SCHEMA)
    with pytest.raises(ConfigError):
        validate(normalize_config({"aggregates": {"flag": "join"}}), SCHEMA)


def test_filter_operator_type_check():
    with pytest.raises(ConfigError):
        validate(normalize_config({"filter": [["k", ">", "x"]]}), SCHEMA)
    with pytest.raises(ConfigError):
        validate(normalize_config({"filter": [["a", "contains", "x"]]}), SCHEMA)


def test_lists_and_defaults():
    assert len(NUMBER_AGGREGATES) == 26 and len(TEXT_AGGREGATES) == 10 and len(BOOLEAN_AGGREGATES) == 9
    assert default_aggregate("float") == "sum" and default_aggregate("string") == "count"
    assert default_aggregate("datetime") == "count"
