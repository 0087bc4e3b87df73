"""Pipelines with branches: named parts, each with named inputs, whose types are agreed on when they are built.

A source offers types in the order that it likes them; a part accepts some types
at each input and derives its output's type from them. The first choice that all
parts accept is taken, and sources are read in that type. An output may have any
number of consumers; it is one plan, which Catalyst sees as a whole.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import product
from typing import NamedTuple

from pyspark.sql import DataFrame

from . import pipeline


class Kind(NamedTuple):
    major: str
    sub: str


class Part(NamedTuple):
    """A registered transform with its inputs' names and its parameters."""

    transform: str
    inputs: tuple[str, ...]
    parameters: dict = {}


class Source(NamedTuple):
    kinds: tuple[Kind, ...]
    read: Callable[[Kind], DataFrame]


class Signature(NamedTuple):
    """The kinds that each input accepts; the kind that comes of the inputs' kinds, or None if they do not go together."""

    accepts: tuple[tuple[Kind, ...], ...]
    gives: Callable[..., Kind | None]


PCM8, PCM16, YUV, RGB, JPEG = Kind("audio", "pcm8"), Kind("audio", "pcm16"), Kind("video", "yuv"), Kind("video", "rgb"), Kind("video", "jpeg")
_RGB = Signature(((RGB,),), lambda kind: kind)
SIGNATURES: dict[str, Signature] = {
    "mixer": Signature(((PCM16, PCM8), (PCM16, PCM8)), lambda a, b: a if a == b else None),
    "zip": Signature(((PCM16, PCM8), (PCM16, PCM8)), lambda a, b: a if a == b else None),
    "as_payload": Signature(((PCM16, PCM8),), lambda kind: kind),
    "to_rgb": Signature(((YUV,),), lambda kind: RGB),
    **dict.fromkeys(("negative", "swizzle", "gray", "contrast", "saturation"), _RGB),
    "multipart": Signature(((JPEG,),), lambda kind: Kind("stream", "multipart")),
    "wave": Signature(((PCM16, PCM8),), lambda kind: Kind("stream", "wave")),
}


def ordered(parts: dict[str, Part], sources: set[str]) -> list[str]:
    """Parts' names, each after its inputs; an unknown input or a circle is an error."""
    done, out = set(sources), []
    if both := done & set(parts):
        raise ValueError(f"{', '.join(sorted(both))} is a source and a part")
    while len(out) < len(parts):
        ready = [n for n, p in parts.items() if n not in done and all(i in done for i in p.inputs)]
        if not ready:
            left = {n: [i for i in p.inputs if i not in done] for n, p in parts.items() if n not in done}
            raise ValueError("; ".join(f"{n} waits for {', '.join(i)}" for n, i in left.items()))
        out += ready
        done |= set(ready)
    return out


def agreed(parts: dict[str, Part], offers: dict[str, tuple[Kind, ...]], signatures: dict[str, Signature] = SIGNATURES) -> dict[str, Kind]:
    """The kind of every source and part; the error of no agreement names the part that the best choice fails at."""
    names, furthest = ordered(parts, set(offers)), (-1, "")
    for choice in product(*offers.values()):
        kinds = dict(zip(offers, choice, strict=True))
        for at, name in enumerate(names):
            part, own = parts[name], signatures[parts[name].transform]
            if len(part.inputs) != len(own.accepts):
                raise ValueError(f"{name} has {len(part.inputs)} inputs, {part.transform} takes {len(own.accepts)}")
            given = [kinds[i] for i in part.inputs]
            refused = [f"{i}: {k.major}/{k.sub}" for i, k, accepted in zip(part.inputs, given, own.accepts, strict=True) if k not in accepted]
            kind = None if refused else own.gives(*given)
            if kind is None:
                furthest = max(furthest, (at, f"{name} does not take {', '.join(refused) or ' with '.join(f'{k.major}/{k.sub}' for k in given)}"))
                break
            kinds[name] = kind
        else:
            return kinds
    raise ValueError(furthest[1] or "a source offers nothing")


def built(parts: dict[str, Part], sources: dict[str, Source], signatures: dict[str, Signature] = SIGNATURES) -> dict[str, DataFrame]:
    """The results of the parts that no other part takes. Each source is read once, in the kind that was agreed on."""
    kinds = agreed(parts, {n: s.kinds for n, s in sources.items()}, signatures)
    frames = {n: s.read(kinds[n]) for n, s in sources.items()}
    for name in ordered(parts, set(sources)):
        frames[name] = pipeline.apply(parts[name].transform, *(frames[i] for i in parts[name].inputs), **parts[name].parameters)
    taken = {i for p in parts.values() for i in p.inputs}
    return {n: frames[n] for n in parts if n not in taken}
