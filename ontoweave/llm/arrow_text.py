"""Texts in Arrow arrays: bounded pieces of a batch, and words by number."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once.
PIECE_BYTES = 8 << 20


def pieces(batch: pa.RecordBatch, text: int, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """batch in slices of rows whose texts have some most bytes, a row at least."""
    sizes = np.cumsum(pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(batch):
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most)))
        yield batch.slice(at, end - at)
        at = end


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, their numbers in order of all texts, the place of each text's first word and the end) of texts
    (null: empty) between ASCII white space; a text of none has one word, which is empty."""
    split = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(texts.fill_null("")))
    coded = split.flatten().dictionary_encode()
    offsets = split.offsets.to_numpy().astype(np.int64)
    return coded.dictionary, coded.indices.to_numpy(), offsets - offsets[0]


def release() -> None:
    """Gives freed memory back to the system, so a worker that is kept doesn't keep what its largest task took."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, with release() once a task ends."""

    def ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return ended
