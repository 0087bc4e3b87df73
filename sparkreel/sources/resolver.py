"""From a URL to the source that reads it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import containers

READERS = {"flv": containers.flv, "mpegps": containers.mpegps, "mpa": containers.mpa, "ac3": containers.ac3, "wav": containers.wav}
# Suffixes of the known containers.
SUFFIXES = {".flv": "flv", ".mpg": "mpegps", ".mpeg": "mpegps", ".vob": "mpegps", ".mp1": "mpa", ".mp2": "mpa", ".ac3": "ac3", ".wav": "wav"}
SCREEN = "screen:"


def format_of(url: str) -> str:
    """Name of the source for a URL, by suffix."""
    for suffix, name in SUFFIXES.items():
        if url.lower().endswith(suffix):
            return name
    raise ValueError(f"no source reads {url!r}")


def open_source(spark: SparkSession, url: str, format: str | None = None, **options) -> DataFrame:
    """The records of a file, of a folder or pattern given with its format, or of the screen clock."""
    if url.lower().startswith(SCREEN):
        return containers.screen_clock(spark, **options)
    return READERS[format or format_of(url)](spark, url, **options)


def local_path(url: Column) -> Column:
    """The path after an eight-character prefix, with encoded blanks decoded."""
    return F.replace(F.substring(url, 9, 2147483647), F.lit("%20"), F.lit(" "))
