"""Column-expression helpers (pure Spark SQL expressions, no UDFs)."""

from framewright.functions.text import (  # noqa: F401
    canonical_json,
    json_string_literal,
    json_strict_valid,
    parse_offset,
    py_rstrip,
    py_strip,
    quote_regex,
)
