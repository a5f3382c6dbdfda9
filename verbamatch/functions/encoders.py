"""Plug-in text encoders: a callable from a list of texts to a list of vectors."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .pieces import in_pieces

_loaded: dict = {}
_unloaded: dict = {}


def hashing_encoder(texts: list[str], size: int = 64) -> list[list[float]]:
    """Deterministic stand-in: hashed character trigrams, for tests and where no model is at hand."""
    out = []
    for t in texts:
        v = [0.0] * size
        padded = f"  {t} "
        for i in range(len(padded) - 2):
            h = int.from_bytes(hashlib.blake2b(padded[i : i + 3].encode(), digest_size=8).digest(), "little")
            v[h % size] += 1.0 if h >> 63 else -1.0
        out.append(v)
    return out


def letter_encoder(texts: list[str], letters: str = "abcdefghijklmnopqrstuvwxyz0123456789") -> list[list[float]]:
    """Deterministic stand-in: how often each letter and digit occurs."""
    return [[float(t.count(c)) for c in letters] for t in texts]


def encode(col: Column, encoder: Callable[[list[str]], list]) -> Column:
    """Unit vectors of a text column. The encoder is made ready once per Python worker and called for some hundred texts at a time."""

    def unit(texts: list[str | None]) -> list[list[float]]:
        vectors = [list(map(float, v)) for v in encoder([t if t is not None else "" for t in texts])]
        norms = [max(math.sqrt(sum(x * x for x in v)), 1e-10) for v in vectors]
        return [[x / n for x in v] for v, n in zip(vectors, norms)]

    @F.arrow_udf("array<float>")
    def run(texts: pa.Array) -> pa.Array:
        return in_pieces(texts, unit, pa.list_(pa.float32()))

    return run(col)


class Lazy:
    """An encoder whose model is loaded at its first use in a process and kept under its name.

    It travels to the workers with the number of times its name has been unloaded; a worker
    that holds an older model drops it before it loads anew.
    """

    def __init__(self, factory: Callable[[], Callable[[list[str]], list]], name: str):
        self.factory, self.name = factory, name

    def __getstate__(self) -> dict:
        return self.__dict__ | {"times": _unloaded.get(self.name, 0) + _unloaded.get(None, 0)}

    def __call__(self, texts: list[str]) -> list:
        times = self.__dict__.get("times", _unloaded.get(self.name, 0) + _unloaded.get(None, 0))
        if _loaded.get(self.name, (None,))[0] != times:
            _loaded.pop(self.name, None)
            _loaded[self.name] = (times, self.factory())
        return _loaded[self.name][1](texts)


def lazy(factory: Callable[[], Callable[[list[str]], list]], name: str) -> Lazy:
    return Lazy(factory, name)


def unload(name: str | None = None) -> None:
    """Forget loaded models: here at once, in workers when they next meet the encoder."""
    _unloaded[name] = _unloaded.get(name, 0) + 1
    if name is None:
        _loaded.clear()
    else:
        _loaded.pop(name, None)


def dot(a: Column, b: Column) -> Column:
    """Inner product of two vectors in double precision, clipped to [0, 1]."""
    product = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), product))
