"""Text helpers that reproduce Python string semantics with Spark built-ins.

* ``py_strip`` / ``py_rstrip``: Python ``str.strip()`` removes all Unicode
  whitespace; Spark ``trim`` removes only spaces.
* ``parse_offset``: ``'-4'``, ``'- 4'``, ``'+8'``, ``'0ffch'`` -> signed int,
  null when the text is not a number.
* ``json_strict_valid``: whole-string JSON validity (Variant parsing alone
  ignores trailing text).
* ``canonical_json``: key-sorted compact JSON, for deep equality as in Python.
* ``json_string_literal``: a string as Python's ``json.dumps`` writes it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from framewright.functions.arrays import bind
from framewright.functions.patterns import JSON_SENTINEL

# --- fixed values: Python's str.isspace() characters (what str.strip() removes)
PY_WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same set as a Java regex class ((?U)\s is Unicode White_Space).
_WS = r"[\s\x1c-\x1f]"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """Python ``str.strip()``."""
    return F.btrim(_c(c), F.lit(PY_WHITESPACE))


def py_rstrip(c) -> Column:
    """Python ``str.rstrip()``."""
    return F.rtrim(_c(c), F.lit(PY_WHITESPACE))


def py_strip_sql(expr: str) -> str:
    """SQL-text form of :func:`py_strip` for use inside higher-order lambdas."""
    return f"regexp_replace({expr}, '(?U)^[\\\\s\\\\x1c-\\\\x1f]+|[\\\\s\\\\x1c-\\\\x1f]+$', '')"


def quote_regex(c) -> Column:
    """Quote a column value for literal use inside a Java regex."""
    return F.concat(F.lit(r"\Q"), F.replace(_c(c), F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def parse_offset(raw) -> Column:
    """Signed integer from an ``[ebp OP value]`` capture; null on failure.

    Decimal unless the value ends in ``h`` (then hexadecimal).  The sign is
    negative when the text holds a ``-``.
    """
    raw = _c(raw)
    clean = F.regexp_replace(F.lower(raw), r"(?U)[\s+\-]", "")
    hex_digits = F.regexp_replace(clean, "h$", "")
    hex_val = F.when(hex_digits.rlike("^[0-9a-f]+$"), F.conv(hex_digits, 16, 10).cast("bigint"))
    dec_val = F.when(clean.rlike("^[0-9]+$"), clean.try_cast("bigint"))
    value = F.when(clean.endswith("h"), hex_val).otherwise(dec_val)
    sign = F.when(F.instr(raw, "-") > 0, F.lit(-1)).otherwise(F.lit(1))
    return (sign * value).cast("bigint")


# Tokens that Python reads otherwise than a JSON parser: numbers with a fraction, an exponent or
# a minus before zero, booleans (1 and 0 in comparisons) and the three constants beyond JSON.
_JSON_TOKEN = (r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
               r"|(?<![\w.+-])(?:-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|NaN|-?Infinity)(?![\w.+-])"
               r"|[^\"\w.+-]++|.")
# A text with none of these has no such token.  A ``-0`` before a letter or digit is in a string, is malformed, or has an exponent.
_JSON_ODD = r"[0-9](?:[.eE]|[0-9]{18})|-0(?!\w)"
_JSON_ODD_WORDS = ("true", "false", "NaN", "Infinity")
NOT_A_NUMBER = "fw#nan"
INFINITY = "fw#infinity"


def _python_token(t: Column) -> Column:
    def number(x: Column) -> Column:
        # 1, 1.0 and 1e0 are one number; beyond 64 bits numbers are compared as doubles
        d = x.try_cast("double")
        whole = F.when((F.abs(d) < 9.0e18) & (d == F.floor(d)), F.coalesce(x.try_cast("bigint"), d.try_cast("bigint")).cast("string"))
        return F.when(F.abs(d) == float("inf"), F.concat(F.lit('"'), F.when(d < 0, "-").otherwise(""), F.lit(INFINITY + '"'))) \
            .otherwise(F.coalesce(whole, d.cast("string")))

    return F.when(t == "true", "1").when(t == "false", "0").when(t == "NaN", f'"{NOT_A_NUMBER}"') \
        .when(t == "Infinity", f'"{INFINITY}"').when(t == "-Infinity", f'"-{INFINITY}"') \
        .when(t.rlike(r"^-?[0-9]"), number(t)).otherwise(t)


def python_json(c) -> Column:
    """JSON text in which equal Python values are written alike: ``1``, ``1.0``, ``1e0`` and ``true``
    become ``1``, ``NaN`` and the infinities become marked strings.  Malformed text stays malformed;
    text without such tokens is returned as it is."""
    c = _c(c)
    tokens = F.regexp_extract_all(c, F.lit("(?s)" + _JSON_TOKEN), F.lit(0))
    odd = c.rlike(_JSON_ODD)
    for word in _JSON_ODD_WORDS:  # a plain search is much faster than a pattern's branch
        odd = odd | c.contains(word)
    return F.when(odd, F.array_join(F.transform(tokens, _python_token), "")).otherwise(c)


def _wrapped(c: Column) -> Column:
    return F.try_parse_json(F.concat(F.lit("["), c, F.lit(f',"{JSON_SENTINEL}"]')))


def _is_single(wrapped: Column) -> Column:
    return (F.try_variant_get(wrapped, "$[1]", "string") == F.lit(JSON_SENTINEL)) & F.try_variant_get(wrapped, "$[2]", "variant").isNull()


def json_strict_valid(c) -> Column:
    """True when the whole string is one JSON value (Python ``json.loads``).

    ``try_parse_json`` accepts trailing text, so the candidate is wrapped as
    ``[candidate, "<sentinel>"]``: it is valid exactly when that parses to a
    two-element array ending with the sentinel.
    """
    return F.coalesce(bind(_wrapped(python_json(c)), _is_single), F.lit(False))


def canonical_json(c) -> Column:
    """Key-sorted compact JSON text of a strictly valid value, equal for equal Python values; else null.
    (A parsed NaN is one object in Python: it equals itself inside a list or object, though not alone.)"""
    around = len(f'[,"{JSON_SENTINEL}"]')
    inner = lambda w: bind(w.cast("string"), lambda t: F.substring(t, F.lit(2), F.length(t) - around))
    return bind(_wrapped(python_json(c)), lambda w: F.when(_is_single(w), inner(w)))


def json_string_literal(c) -> Column:
    """JSON string literal (with quotes) as Python writes it: everything outside the printable ASCII
    range as ``\\uXXXX``, surrogate pairs included; ``null`` for null."""
    c = _c(c)
    pieces = F.regexp_extract_all(c, F.lit(r'(?s)[ !#-\[\]-~]++|.'), F.lit(0))
    hex4 = lambda n: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n)), 4, "0"))

    def written(p: Column) -> Column:
        short = F.when(p == '"', '\\"').when(p == "\\", "\\\\").when(p == "\n", "\\n").when(p == "\r", "\\r") \
            .when(p == "\t", "\\t").when(p == "\b", "\\b").when(p == "\f", "\\f")
        n = F.ascii(p)
        pair = F.concat(hex4(F.lit(0xD800) + F.shiftright(n - 0x10000, 10)), hex4(F.lit(0xDC00) + (n - 0x10000).bitwiseAND(0x3FF)))
        return F.coalesce(short, F.when(p.rlike(r"^[ -~]"), p), F.when(n < 0x10000, hex4(n)), pair)

    text = F.when(c.rlike(r'[^ !#-\[\]-~]'), F.array_join(F.transform(pieces, written), "")).otherwise(c)
    return F.coalesce(F.concat(F.lit('"'), text, F.lit('"')), F.lit("null"))
