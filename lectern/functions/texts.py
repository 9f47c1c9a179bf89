"""Text rules that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The six white-space characters of ASCII.
WHITE = " \t\n\x0b\x0c\r"
#: The spaces of Unicode, which SQL's trim takes off; tabs and line feeds are none.
SPACES = " \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """The text without white space at either end."""
    return F.btrim(text, F.lit(WHITE))


def clipped(text: Column, limit: int) -> Column:
    """The stripped text, its first ``limit`` characters at most; empty if null."""
    return F.left(strip(F.coalesce(text, F.lit(""))), F.lit(limit))
