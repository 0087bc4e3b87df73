"""Markers in binary columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_sync(data: Column, marker: str) -> Column:
    """Byte position of the first marker, given in hex and found on byte boundaries; null if there is none."""
    # One character for each byte, so a place in the string is one in the data.
    place = F.instr(F.decode(data, "ISO-8859-1"), bytes.fromhex(marker).decode("latin1"))
    return F.when(place > 0, (place - 1).cast("bigint"))
