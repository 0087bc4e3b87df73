"""Code tables of the public formats, as plain values and as small DataFrames for broadcast joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Bit rates in kbit/s by index 0 to 14 (ISO/IEC 11172-3 and 13818-3), for version 1 and the low-rate versions.
BIT_RATES = {
    (1, 1): [0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448],
    (1, 2): [0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384],
    (1, 3): [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320],
    (2, 1): [0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256],
    (2, 2): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
    (2, 3): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
}
# Sampling rates of version 1 by index; the low-rate versions halve and quarter them.
SAMPLE_RATES = [44100, 48000, 32000]
# AC-3 bit rates in kbit/s by half of the frame size code (ATSC A/52).
AC3_RATES = [32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384, 448, 512, 576, 640]
# AC-3 sampling rates by code, and full-bandwidth channels by channel mode.
AC3_SAMPLE_RATES = [48000, 44100, 32000]
AC3_CHANNELS = [2, 1, 2, 3, 3, 4, 4, 5]
# Video frame rates by code (ISO/IEC 13818-2).
FRAME_RATES = {1: (24000, 1001), 2: (24, 1), 3: (25, 1), 4: (30000, 1001), 5: (30, 1), 6: (50, 1), 7: (60000, 1001), 8: (60, 1)}
# Display aspect ratios of version 2, and pixel heights of version 1 in ten-thousandths of the width, by code.
ASPECTS = {1: (1, 1), 2: (4, 3), 3: (16, 9), 4: (221, 100)}
PIXEL_HEIGHTS = {1: 10000, 2: 6735, 3: 7031, 4: 7615, 5: 8055, 6: 8437, 7: 8935, 8: 9157, 9: 9815, 10: 10255, 11: 10695, 12: 10950, 13: 11575, 14: 12015}
# FLV codes. Nominal sound rates and the rates that they stand for; codecs; frame types.
FLV_RATES = {0: (5500, 5512), 1: (11000, 11025), 2: (22000, 22050), 3: (44000, 44100)}
FLV_SOUND = {0: "pcm", 1: "adpcm", 2: "mp3", 3: "pcm_le", 10: "aac", 11: "speex"}
FLV_VIDEO = {2: "h263", 3: "screen", 4: "vp6", 5: "vp6_alpha", 6: "screen2", 7: "avc"}
FLV_FRAMES = {1: "key", 2: "inter", 3: "disposable", 4: "generated", 5: "command"}
# AAC sampling rates by index.
AAC_RATES = [96000, 88200, 64000, 48000, 44100, 32000, 24000, 22050, 16000, 12000, 11025, 8000]


def at(values: list[int], code: Column) -> Column:
    """values[code], null outside."""
    inside = code.between(0, len(values) - 1)
    return F.when(inside, F.element_at(F.array(*[F.lit(int(v)) for v in values]), F.when(inside, code.cast("int") + 1).otherwise(1)).cast("bigint"))


def named(names: dict, code: Column, default: str | None = None) -> Column:
    out = F.lit(default).cast("string")
    for key, name in names.items():
        out = F.when(code == key, F.lit(name)).otherwise(out)
    return out


def bit_rates(spark: SparkSession) -> DataFrame:
    """version, layer, rate_index, kbps: 90 rows."""
    rows = [(v, layer, i, kbps) for (v, layer), rates in BIT_RATES.items() for i, kbps in enumerate(rates)]
    return spark.createDataFrame(rows, "version int, layer int, rate_index int, kbps bigint")


def frame_rates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, n, d) for c, (n, d) in FRAME_RATES.items()], "code int, num bigint, den bigint")


def mpa_kbps(version: Column, layer: Column, index: Column) -> Column:
    """Bit rate of an MPEG audio header; null where the tables have none."""
    rates = [kbps for key in sorted(BIT_RATES) for kbps in BIT_RATES[key]]
    place = (version - 1) * 45 + (layer - 1) * 15 + index
    return F.when(version.between(1, 2) & layer.between(1, 3) & index.between(0, 14), at(rates, place))
