"""Arrow columns of texts gone through piece by piece, as Python's objects take many times the room of Arrow's."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc

#: A piece has so many rows and bytes at most; a longer text is a piece of its own.
ROWS, BYTES = 512, 1 << 20


def pieces(texts: pa.Array) -> Iterator[list[str | None]]:
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    at = size = 0
    for i, n in enumerate(sizes):
        if i > at and (i - at >= ROWS or size + n > BYTES):
            yield texts.slice(at, i - at).to_pylist()
            at, size = i, 0
        size += n
    if at < len(texts):
        yield texts.slice(at).to_pylist()


def in_pieces(texts: pa.Array, run: Callable[[list[str | None]], list], kind: pa.DataType) -> pa.Array:
    """The column that `run` makes of the lists of texts; what was freed goes back to the system."""
    done = [pa.array(run(piece), kind) for piece in pieces(texts)]
    out = pa.concat_arrays(done) if done else pa.array([], kind)
    del done
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass
    return out
