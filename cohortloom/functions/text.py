"""Column expressions for uneven text: ids, numbers, missing words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that stand for a missing reading, compared trimmed and in lower case.
MISSING_WORDS = ("", "na", "n/a", "nan", "null", "none", "unknown")

NUMBER = r"^[+-]?([0-9]+([.,][0-9]*)?|[.,][0-9]+)([eE][+-]?[0-9]+)?$"
PLAIN_NUMBER = r"^[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?$"
BLANKS = " \t\n\x0b\f\r"
#: The ASCII characters that are no part of an id.
_NO_ID = "".join(chr(i) for i in range(128) if not chr(i).isalnum())


def trimmed(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.btrim(c, F.lit(BLANKS))


def norm_id(c: Column) -> Column:
    """Letters and digits of an id in upper case; null where nothing is left (such an id names nobody)."""
    # plain ASCII needs no regular expression
    kept = F.when(F.octet_length(c) == F.char_length(c), F.translate(c, _NO_ID, "")).otherwise(F.regexp_replace(c, "[^A-Za-z0-9]", ""))
    x = F.upper(kept)
    return F.when(x != "", x)


def regular_sample_id(norm: Column) -> Column:
    """``DP3-0000012B`` from its normal form ``DP30000012B``; other forms stay as they are."""
    return F.when(norm.rlike("^DP3[0-9]"), F.concat(F.lit("DP3-"), F.substring(norm, 4, 1000))).otherwise(norm)


def is_missing_word(c: Column) -> Column:
    """Null, blank or a word for missing."""
    return c.isNull() | F.lower(trimmed(c)).isin(*MISSING_WORDS)


def read_number(c: Column) -> Column:
    """A number from text, blanks around it and a decimal comma allowed; null if there is none. NaN is none."""
    t = trimmed(c)
    return F.when(t.rlike(NUMBER), F.translate(t, ",", ".").try_cast("double"))


def read_plain_number(c: Column) -> Column:
    """A number written with a decimal point (or none); null if there is none."""
    t = trimmed(c)
    return F.when(t.rlike(PLAIN_NUMBER), t.try_cast("double"))


def is_control_sample(c: Column) -> Column:
    """Control samples start with CONTROL, NEG or PLATE."""
    t = F.upper(trimmed(c))
    return F.coalesce(t.startswith("CONTROL") | t.startswith("NEG") | t.startswith("PLATE"), F.lit(False))


def passes(c: Column) -> Column:
    """A warning column that reads PASS, ignoring case and blanks; null does not pass."""
    return F.coalesce(F.upper(trimmed(c)) == "PASS", F.lit(False))
