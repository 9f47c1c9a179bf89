"""Texts made from a template: ``{name}`` stands for a column."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def filled(template: str, **values: Column) -> Column:
    """The template with its names replaced, nulls by nothing; a name without a value is an error."""
    pieces = re.split(r"\{(\w+)\}", template)
    told = [F.lit(p) if n % 2 == 0 else F.coalesce(values[p].cast("string"), F.lit("")) for n, p in enumerate(pieces)]
    return F.concat(*told)
