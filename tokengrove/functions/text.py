"""Small text expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The 25 code points with the Unicode property White_Space (fixed values).
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def ascii_lower(c: Column) -> Column:
    """Fold A-Z only; ``lower`` would also fold accented letters."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def trim_start(c: Column) -> Column:
    return F.ltrim(c, F.lit(WHITE_SPACE))


def trim_end(c: Column) -> Column:
    return F.rtrim(c, F.lit(WHITE_SPACE))


def trim_all(c: Column) -> Column:
    """Strip Unicode whitespace on both ends (plain ``trim`` strips only spaces)."""
    return F.trim(c, F.lit(WHITE_SPACE))


def sha256_hex(c: Column) -> Column:
    return F.sha2(c, 256)


def contains_ascii_ci(hay: Column, needle: str) -> Column:
    """ASCII case-insensitive substring test; an empty needle matches everything."""
    return ascii_lower(hay).contains(ascii_lower(F.lit(needle)))


def json_text(c: Column) -> Column:
    """The characters of ``c`` as they appear inside a JSON string, without quotes."""
    boxed = F.to_json(F.array(c))
    return F.substring(boxed, F.lit(3), F.length(boxed) - 4)
