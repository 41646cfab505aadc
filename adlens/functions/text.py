"""Scalar string expressions (all JVM-side, inside whole-stage codegen)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the record formats and of the keyword text rules.
KEYWORD_SEPARATOR = ";"
HISTORY_SEPARATOR = ","
ENABLED_STATE = "enabled"
BLANK = " "          # only U+0020 is removed from keywords, not tabs
DASH = "-"           # removed from the history client id only
KEY_JOINER = "_"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_blanks(c: str | Column) -> Column:
    """Remove every U+0020 (not other white space)."""
    return F.replace(_col(c), F.lit(BLANK), F.lit(""))


def normalize_keyword(c: str | Column) -> Column:
    """Dictionary form of a keyword: lower-cased, blanks removed."""
    return strip_blanks(F.lower(_col(c)))


def lookup_key(c: str | Column, lookup_case: str = "reference") -> Column:
    """Key used to look a raw keyword up in the keyword dictionary.

    ``reference`` strips blanks but keeps the case, so keywords holding an
    upper-case letter miss the (lower-cased) dictionary and get the default
    label.  ``normalized`` applies the dictionary normalisation.
    """
    if lookup_case == "reference":
        return strip_blanks(c)
    if lookup_case == "normalized":
        return normalize_keyword(c)
    raise ValueError(f"lookup_case must be 'reference' or 'normalized', got {lookup_case!r}")


def strip_dashes(c: str | Column) -> Column:
    """Remove every ``-`` (history client ids)."""
    return F.replace(_col(c), F.lit(DASH), F.lit(""))


def campaign_key(client: str | Column, account: str | Column) -> Column:
    """Text form of the campaign key (``client_account``).

    Joins use the two columns instead: the text form lets ``("a_b", "c")`` and
    ``("a", "b_c")`` collide.
    """
    return F.concat_ws(KEY_JOINER, _col(client), _col(account))


def form_url_encode(c: str | Column) -> Column:
    """``application/x-www-form-urlencoded`` in UTF-8 (blank -> ``+``)."""
    return F.url_encode(_col(c))


def strict_double(c: str | Column, what: str = "number") -> Column:
    """Cast to double, failing on text that is not a number whatever the ANSI
    setting of the session (a null stays null)."""
    col = _col(c)
    parsed = col.try_cast("double")   # parsed once; the check and the value share it
    return F.when(col.isNotNull() & parsed.isNull(),
                  F.raise_error(F.concat(F.lit(f"{what} is not a number: "), col.cast("string")))
                  ).otherwise(parsed)
