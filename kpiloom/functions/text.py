"""Text helpers: trimming, labels and column-name normalisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 29 characters of Unicode that count as white space; trim() alone
# removes the plain blank only.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# What a header character becomes before upper-casing.
_HEADER_CHARACTERS = str.maketrans(" áéíóúñ", "_aeioun")


def strip(value: Column) -> Column:
    """The value as text without outer white space of any kind."""
    return F.btrim(value.cast("string"), F.lit(BLANKS))


def child_label(value: Column) -> Column:
    return F.concat(F.lit("     "), value)


def normalise_name(name: str) -> str:
    """Header to table column: blanks to `_`, lower-case accents folded, then upper case."""
    return str(name).translate(_HEADER_CHARACTERS).upper()
