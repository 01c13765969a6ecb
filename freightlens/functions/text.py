"""Text expressions: tax ids, paths, request bodies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BACKSLASH = chr(92)

# Whitespace removed by the body clean-up (ASCII set of Python's str.strip()).
_WS = r"[\t\n\x0b\x0c\r\x1c-\x1f ]"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def digits_only(c) -> Column:
    """Drop every non-digit character."""
    return F.regexp_replace(_c(c), "[^0-9]", "")


def _cpf_digits_ok(d: Column) -> Column:
    """CPF rule on a digits-only string ``d``."""
    digit = [F.substring(d, i + 1, 1).cast("int") for i in range(11)]
    s1 = digit[0] * 10
    for i in range(1, 9):
        s1 = s1 + digit[i] * (10 - i)
    s2 = digit[0] * 11
    for i in range(1, 10):
        s2 = s2 + digit[i] * (11 - i)
    dv1 = ((s1 * 10) % 11) % 10
    dv2 = ((s2 * 10) % 11) % 10
    return (
        F.when(F.length(d) != 11, F.lit(False))
        .when(d == F.repeat(F.substring(d, 1, 1), 11), F.lit(False))
        .otherwise((digit[9] == dv1) & (digit[10] == dv2))
    )


def cpf_is_valid(c) -> Column:
    """CPF check (E21) with native column arithmetic, no UDF.

    Rules: after keeping digits, exactly 11 digits, not all the same digit,
    and both mod-11 check digits right.  NULL input is invalid (FALSE).

    The digits-only string is one common subexpression, so generated code runs
    the regex once per row.
    """
    return F.coalesce(_cpf_digits_ok(digits_only(c)), F.lit(False))


def unescape_path(c) -> Column:
    """Doubled backslashes -> single backslash."""
    return F.replace(_c(c), F.lit(BACKSLASH * 2), F.lit(BACKSLASH))


def clean_body(c) -> Column:
    """Remove the two-character sequence backslash+n, then strip outer
    whitespace (E23)."""
    no_escapes = F.replace(_c(c), F.lit(BACKSLASH + "n"), F.lit(""))
    return F.regexp_replace(no_escapes, f"^{_WS}+|{_WS}+$", "")


def parsed_body(c) -> Column:
    """A body as VARIANT (E23): its JSON value, or the text itself as a string
    where it isn't JSON; NULL stays NULL."""
    return F.coalesce(F.try_parse_json(_c(c)), _c(c).cast("variant"))


def canonical_json(v) -> Column:
    """A VARIANT as text that is equal for equal values: no white space, object
    keys in order, numbers in one form."""
    return F.to_json(_c(v))


def body_kind(v) -> Column:
    """OBJECT, ARRAY, STRING, BIGINT, DECIMAL, DOUBLE, BOOLEAN or VOID (JSON null)."""
    return F.regexp_extract(F.schema_of_variant(_c(v)), "^[A-Z]+", 0)
