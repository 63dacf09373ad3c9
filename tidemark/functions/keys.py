"""Key normalisation shared by all operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that may surround a key (fixed values): space, tab, line feed, carriage return, form feed, vertical tab, no-break space.
KEY_BLANKS = " \t\n\r\f\v\xa0"


def norm_key(col: Column | str) -> Column:
    """Key without surrounding white space, in upper case; null for a null or blank key."""
    c = F.col(col) if isinstance(col, str) else col
    return F.nullif(F.upper(F.btrim(c, F.lit(KEY_BLANKS))), F.lit(""))


def micros(col: Column | str) -> Column:
    """Microseconds since the epoch of a timestamp with time zone, null for null."""
    return F.unix_micros(F.col(col) if isinstance(col, str) else col)
