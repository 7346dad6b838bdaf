"""String helpers whose blanks are Unicode's, not only U+0020."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What str.strip() takes away: Unicode blanks and the four separators U+001C-U+001F.
BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """``c`` without blanks at either end; NULL stays NULL."""
    return F.trim(c, F.lit(BLANKS))


def blank_to_null(c: Column) -> Column:
    """NULL for NULL, empty and blank strings, else ``c`` stripped."""
    return F.nullif(strip(c), F.lit(""))


def digest_key(c: Column) -> Column:
    """A digest as compared: stripped, lower case; blank counts as missing."""
    return F.lower(blank_to_null(c))


def newlines(c: Column) -> Column:
    """CRLF and CR become LF."""
    return F.regexp_replace(c, r"\r\n?", "\n")
