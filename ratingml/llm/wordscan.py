"""Words of a batch of texts as slices of one byte buffer, found without a loop over words.

Word breaks are ASCII characters, so the work is done on UTF-8 bytes: a byte above 127
is always part of a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are scanned together; one longer text is scanned alone, as a whole.
SLICE_BYTES = 4 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


@dataclass
class Words:
    """``bounds[d]:bounds[d + 1]`` are the words of text ``d``; ``ids`` point into ``names``."""

    ids: np.ndarray
    names: pa.Array
    bounds: np.ndarray
    #: number of the piece that a word is in, over all texts; one piece per text without piece breaks
    pieces: np.ndarray


def slices(batch: pa.RecordBatch, column: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in parts of about ``size`` bytes of text, in order."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(lengths) // size
    starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else []
    for start, end in zip(starts, [*starts[1:], batch.num_rows]):
        yield batch.slice(start, end - start)


def _buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts and where each text begins; a null text is empty."""
    large = pc.fill_null(texts.cast(pa.large_string()), "")
    _, places, data = large.buffers()
    offsets = np.frombuffer(places, np.int64)[large.offset : large.offset + len(large) + 1]
    begin, end = int(offsets[0]), int(offsets[-1])
    whole = np.frombuffer(data, np.uint8)[begin:end] if data is not None else np.empty(0, np.uint8)
    return whole, offsets - begin


def scan(texts: pa.Array, word_breaks: bytes, piece_breaks: bytes = b"", lower: bool = False) -> Words:
    """The words of each text: longest stretches without a break. ``lower`` turns A-Z to a-z."""
    data, offsets = _buffer(texts)
    kinds = np.zeros(256, np.uint8)
    kinds[list(word_breaks)] = 1
    kinds[list(piece_breaks)] = 2
    kind = kinds[data]
    inside = kind == 0
    before = np.r_[False, inside[:-1]] if len(inside) else inside
    edges = offsets[:-1][offsets[:-1] < len(data)]
    first = inside & ~before
    first[edges] = inside[edges]
    starts = np.flatnonzero(first)
    # a word ends before a break, before the next text or with the buffer
    stops = ~inside
    stops[edges] = True
    marks = np.flatnonzero(stops)
    nearest = np.searchsorted(marks, starts, side="right")
    ends = np.r_[marks, len(data)][nearest]
    kept = data[inside]
    if lower:
        kept = _LOWER[kept]
    places = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=places[1:])
    names = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(kept)]
    ).dictionary_encode()
    bounds = np.searchsorted(starts, offsets)
    pieces = np.repeat(np.arange(len(texts)), np.diff(bounds))
    if piece_breaks:
        pieces = np.cumsum(kind == 2)[starts] + pieces if len(starts) else pieces
    return Words(names.indices.to_numpy(), names.dictionary, bounds, pieces)
