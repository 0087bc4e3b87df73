"""Multipart framing of an HTTP image stream."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOUNDARY = "frame"


def opening(boundary: str = BOUNDARY) -> str:
    """The response head that comes before the first part."""
    return f"HTTP/1.1 200 OK\r\nContent-Type: multipart/x-mixed-replace; boundary={boundary}\r\nCache-Control: no-cache\r\n\r\n--{boundary}\r\n"


def part(payload: Column, kind: str = "image/jpeg", boundary: str = BOUNDARY) -> Column:
    """Head, payload and closing boundary of one part, as binary. Null stays null."""
    head = F.concat(F.lit(f"Content-Type: {kind}\r\nContent-Length: "), F.octet_length(payload).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(head.cast("binary"), payload, F.lit(f"\r\n--{boundary}\r\n").cast("binary"))
