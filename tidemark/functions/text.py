"""Text rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SYMBOL = r"^[A-Z0-9.\-]{1,10}$"


def symbol(text: Column) -> Column:
    """Trimmed, in capitals, or null if it is no symbol."""
    s = F.upper(F.trim(text))
    return F.when(s.rlike(SYMBOL), s)


def same_class(text: Column) -> Column:
    """Share classes are written with a dash here and a point there; joins need one form."""
    return F.replace(text, F.lit("-"), F.lit("."))


def listed(exchange: Column, name: Column) -> Column:
    return F.concat_ws(":", exchange, same_class(name))


def config_name(text: Column, most: int = 80) -> Column:
    s = F.trim(text)
    return F.when(F.length(s).between(1, most), s)
