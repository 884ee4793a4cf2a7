"""Plain spellings: two values that differ only in case or outer blanks become equal."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["BLANKS", "plain_id", "plain_code", "plain_word", "plain_number", "plain_flag"]

#: Regex class of every blank treated as such at the ends of an identifier.
BLANKS = r"[\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200B}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def plain_id(c: Column | str) -> Column:
    """Upper case without blanks of any kind at the ends; blank or null gives null."""
    s = F.regexp_replace(_c(c), f"^{BLANKS}+|{BLANKS}+$", "")
    return F.upper(F.when(s != "", s))


def plain_code(c: Column | str) -> Column:
    """Like :func:`plain_id`, and dots or inner blanks of a classification code do not count."""
    s = F.regexp_replace(_c(c), f"{BLANKS}|[.]", "")
    return F.when(plain_id(c).isNotNull(), F.upper(s))


def plain_word(c: Column | str) -> Column:
    """Meaning of a word-like attribute: case, outer and repeated blanks ignored; null and blank are ''."""
    s = F.regexp_replace(_c(c).cast("string"), f"{BLANKS}+", " ")
    return F.coalesce(F.upper(F.trim(s)), F.lit(""))


def plain_number(c: Column | str, scale: int = 4) -> Column:
    """Canonical text of a number in any notation; an unreadable text stays as its plain word."""
    w = plain_word(c)
    n = w.try_cast(f"decimal(20,{scale})")
    return F.coalesce(n.cast("string"), w)


def plain_flag(c: Column | str) -> Column:
    """'1' or '0' for the usual notations of a flag; other texts stay as their plain word."""
    w = plain_word(c)
    return (
        F.when(w.isin("1", "Y", "YES", "T", "TRUE"), F.lit("1"))
        .when(w.isin("0", "N", "NO", "F", "FALSE"), F.lit("0"))
        .otherwise(w)
    )
