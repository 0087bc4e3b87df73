"""Named transforms and chains of them."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame


class Transform(NamedTuple):
    category: str
    #: Columns that each input must have, before parameters name others.
    takes: tuple[tuple[str, ...], ...]
    #: Columns that the output has beside those it passes on.
    gives: tuple[str, ...]
    build: Callable[..., DataFrame]


REGISTRY: dict[str, Transform] = {}


def transform(name: str, category: str, *takes: tuple[str, ...], gives: tuple[str, ...] = ()) -> Callable:
    """Registers a function of as many DataFrames as `takes` has entries (one without any) and keyword parameters under a name."""

    def add(build: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        REGISTRY[name] = Transform(category, takes or ((),), gives, build)
        return build

    return add


def names(category: str | None = None) -> list[str]:
    """Registered transforms, of one category or all."""
    return sorted(n for n, t in REGISTRY.items() if category in (None, t.category))


def apply(name: str, *frames: DataFrame, **parameters) -> DataFrame:
    """A registered transform's result; the number of inputs and the columns that they must have are checked."""
    found = REGISTRY[name]
    if len(frames) != len(found.takes):
        raise ValueError(f"{name} takes {len(found.takes)} inputs, not {len(frames)}")
    for i, (frame, columns) in enumerate(zip(frames, found.takes, strict=True)):
        if missing := [c for c in columns if c not in frame.columns]:
            raise ValueError(f"input {i} of {name} has no {', '.join(missing)}")
    return found.build(*frames, **parameters)


def chain(frame: DataFrame, *steps: str | tuple[str, dict]) -> DataFrame:
    """One-input transforms one after the other: names, or (name, parameters)."""
    for step in steps:
        name, parameters = (step, {}) if isinstance(step, str) else step
        frame = apply(name, frame, **parameters)
    return frame


def _register() -> None:
    from pyspark.sql import functions as F

    from ..functions import clock, pixel
    from ..operators import framing, multi, routing, state, timeline
    from ..sinks import multipart, wave

    transform("mixer", "audio effect", (), (), gives=("a", "b", "mixed"))(lambda a, b, on=("seq",), carry=("pts_hns",): multi.mix_streams(a, b, list(on), list(carry)))
    transform("zip", "audio effect", (), (), gives=("a", "b"))(lambda a, b, on=("seq",), carry=("pts_hns",): multi.zip_streams(a, b, list(on), list(carry)))
    transform("as_payload", "audio effect", ("mixed",), gives=("payload",))(lambda df: df.withColumn("payload", F.col("mixed")).drop("a", "b", "mixed"))
    transform("byte_times", "audio decoder", ("payload",), gives=("dur_hns",))(lambda df, per_second: df.withColumn("dur_hns", clock.of_bytes(F.octet_length("payload"), per_second)))
    transform("reorder", "video decoder", gives=("display_seq",))(lambda df, keys=("gop",): timeline.display_order(df, list(keys), "decode_seq", "ptype", "temporal_ref"))
    transform("references", "video decoder", ("decode_seq", "ptype"), gives=("forward", "backward"))(lambda df, keys=("gop",): timeline.references(df, list(keys), "decode_seq", "ptype", "decode_seq"))
    transform("from_key", "video decoder")(lambda df, keys=("gop",): timeline.after_first_key(df, list(keys), "decode_seq", F.col("ptype") == "I"))
    transform("slices", "video decoder", gives=("picture", "slices", "offsets"))(lambda df, keys, order, value, opens: framing.slices(df, list(keys), order, F.expr(opens), value))

    def colours(name: str, change: Callable, category: str = "video effect") -> None:
        def build(df: DataFrame, **parameters) -> DataFrame:
            return df.withColumns(change({c: F.col(c) for c in "rgb"}, **parameters))

        transform(name, category, ("r", "g", "b"), gives=("r", "g", "b"))(build)

    transform("to_rgb", "video effect", ("y", "u", "v"), gives=("r", "g", "b"))(lambda df: df.withColumns(pixel.rgb_float(F.col("y"), F.col("u"), F.col("v"))))
    colours("negative", pixel.negative)
    colours("swizzle", lambda rgb, mode=0: pixel.swizzle(rgb, mode))
    colours("gray", lambda rgb, by="luma": dict.fromkeys("rgb", pixel.luma(rgb) if by == "luma" else pixel.mean(rgb)))
    colours("contrast", lambda rgb, power=1.0: pixel.contrast(rgb, power))
    colours("saturation", lambda rgb, amount=1.0: pixel.saturation(rgb, amount))
    transform("multipart", "video encoder", ("content",), gives=("part",))(lambda df: df.withColumn("part", multipart.part(F.col("content"))))
    transform("wave", "other", ("payload",), gives=("bytes",))(lambda df, keys, order, channels, rate, bits: wave.parts(df, list(keys), order, "payload", channels, rate, bits))
    transform("select", "other", ("stream_id",), ("stream_id", "selected"))(routing.select_streams)
    transform("route", "other", ("stream_id",), gives=("target",))(lambda df, targets: routing.route(df, targets))
    transform("fill", "other", gives=("filled",))(lambda df, keys, order, pts, step: timeline.gap_fill(df, list(keys), order, pts, F.lit(step)))
    transform("durations", "other", gives=("dur_hns",))(lambda df, keys, order="seq", pts="pts_hns": timeline.lag_duration(df, list(keys), order, pts))
    transform("transitions", "other", gives=("from_state",))(lambda df, keys, order, name: state.transitions(df, list(keys), order, name))


_register()
