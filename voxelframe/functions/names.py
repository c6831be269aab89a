"""Names and identifiers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_name(c: Column) -> Column:
    """What a leading bracket and the last closing one enclose, or all; without trailing marks and outer space."""
    c = F.regexp_replace(_trim(c), r"(?s)^\[(.*)\].*$", "$1")
    return _trim(F.regexp_replace(_trim(c), r"[!?]+$", ""))


def _trim(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def canon_id(c: Column) -> Column:
    """``12.0`` becomes ``12``; other texts stay."""
    return F.regexp_replace(c, r"^(\d+)\.0*$", "$1")
