from gridlens.functions.expressions import (  # noqa: F401
    bucket, match, match_all, search, indexof, replace, replace_all,
    compile_expression, add_expressions, validate_expressions, register_sql_functions,
)
from gridlens.functions.aggregates import aggregate_column, AggSpec  # noqa: F401
