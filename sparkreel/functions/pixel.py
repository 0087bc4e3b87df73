"""Pixel and sample arithmetic. Planes are rows (y, u, v) or arrays in row-major order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .bits import clamp

# Integer matrix of BT.601 with 14 fraction bits.
Y_GAIN, V_RED, U_GREEN, V_GREEN, U_BLUE, FRACTION = 19077, 26355, -6657, -13424, 33311, 14
# The same matrix in floating point, for components of one unit.
FLOAT_Y, FLOAT_V_RED, FLOAT_U_GREEN, FLOAT_V_GREEN, FLOAT_U_BLUE = 1.164, 1.596, -0.391, -0.813, 2.018
# Luma weights.
LUMA = (0.3, 0.59, 0.11)


def rgb_int(y: Column, u: Column, v: Column) -> dict[str, Column]:
    """8-bit r, g, b."""
    y, u, v = (x.cast("bigint") for x in (y, u, v))
    luma, u, v = (y - 16) * Y_GAIN, u - 128, v - 128
    out = {"r": luma + v * V_RED, "g": luma + u * U_GREEN + v * V_GREEN, "b": luma + u * U_BLUE}
    return {k: clamp(F.shiftright(x, FRACTION), 0, 255).cast("bigint") for k, x in out.items()}


def rgb_float(y: Column, u: Column, v: Column, swapped: bool = False) -> dict[str, Column]:
    """r, g, b between 0 and 1 from 8-bit components. swapped: the green weights of u and v exchanged."""
    luma, u, v = y / 256.0 - 16 / 256, u / 256.0 - 0.5, v / 256.0 - 0.5
    green = (FLOAT_V_GREEN, FLOAT_U_GREEN) if swapped else (FLOAT_U_GREEN, FLOAT_V_GREEN)
    out = {"r": luma * FLOAT_Y + v * FLOAT_V_RED, "g": luma * FLOAT_Y + u * green[0] + v * green[1], "b": luma * FLOAT_Y + u * FLOAT_U_BLUE}
    return {k: clamp(x, 0.0, 1.0) for k, x in out.items()}


def negative(rgb: dict[str, Column]) -> dict[str, Column]:
    return {k: 1.0 - x for k, x in rgb.items()}


def swizzle(rgb: dict[str, Column], mode: int) -> dict[str, Column]:
    """Mode 0 keeps; 1 gives (r, b, g), 2 gives (b, r, g), 3 gives (b, g, r)."""
    order = ("rgb", "rbg", "brg", "bgr")[mode]
    return {k: rgb[source] for k, source in zip("rgb", order, strict=True)}


def luma(rgb: dict[str, Column]) -> Column:
    return rgb["r"] * LUMA[0] + rgb["g"] * LUMA[1] + rgb["b"] * LUMA[2]


def mean(rgb: dict[str, Column]) -> Column:
    return (rgb["r"] + rgb["g"] + rgb["b"]) / 3.0


def contrast(rgb: dict[str, Column], power: float) -> dict[str, Column]:
    return {k: F.pow(x, F.lit(power)) for k, x in rgb.items()}


def saturation(rgb: dict[str, Column], amount: float) -> dict[str, Column]:
    gray = luma(rgb)
    return {k: gray + (x - gray) * amount for k, x in rgb.items()}


def mirror(at: Column, size: Column | int) -> Column:
    return (F.lit(size) if isinstance(size, int) else size) - 1 - at


def round_clamp16(value: Column, shift: int) -> Column:
    """Rounded right shift into the range of 16-bit samples."""
    return clamp(F.shiftright(value.cast("bigint") + (1 << (shift - 1)), shift), -32768, 32767).cast("bigint")


def average(*values: Column) -> Column:
    """Rounded average of two or four samples."""
    shift = {2: 1, 4: 2}[len(values)]
    total = values[0].cast("bigint")
    for x in values[1:]:
        total = total + x
    return F.shiftright(total + (1 << (shift - 1)), shift)


def mix16(a: Column, b: Column) -> Column:
    return clamp(a.cast("bigint") + b.cast("bigint"), -32768, 32767).cast("bigint")


def mix8(a: Column, b: Column, mode: str = "centered") -> Column:
    """Unsigned 8-bit samples. centered mixes around 128; reference adds raw bytes and clamps to [-128, 127]."""
    if mode == "reference":
        return clamp(a.cast("bigint") + b.cast("bigint"), -128, 127).cast("bigint")
    return clamp(a.cast("bigint") + b.cast("bigint") - 256, -128, 127).cast("bigint") + 128


def mix_arrays(a: Column, b: Column, low: int = -32768, high: int = 32767) -> Column:
    """Saturating sum of two sample arrays of one length; null for different lengths."""
    return F.when(F.size(a) == F.size(b), F.zip_with(a, b, lambda x, y: clamp(x + y, low, high).cast("int")))


def deinterleave(plane: Column) -> tuple[Column, Column]:
    """(first, second) components of an interleaved array."""
    return F.filter(plane, lambda _, i: i % 2 == 0), F.filter(plane, lambda _, i: i % 2 == 1)


def interleave(first: Column, second: Column) -> Column:
    return F.flatten(F.zip_with(first, second, lambda a, b: F.array(a, b)))


def flip_rows(plane: Column, width: Column | int) -> Column:
    """A plane with its rows in the opposite order."""
    width = F.lit(width) if isinstance(width, int) else width
    rows = F.size(plane) / width
    return F.flatten(F.transform(F.sequence(F.lit(1), rows.cast("int")), lambda i: F.slice(plane, (rows.cast("int") - i) * width + 1, width)))


def in_range(value: Column, low: Column, high: Column, supported: Column) -> Column:
    """A device setting, or null if it is unsupported or out of range."""
    return F.when(supported & value.between(low, high), value)


def downmix(left: Column, right: Column, center: Column, around: Column, to: int, bias: float = 0.0) -> list[Column]:
    """Sums of channels for one or two outputs; centre and surround go to both sides."""
    if to == 1:
        return [left + right + center + around + bias]
    return [left + center + around + bias, right + center + around + bias]
