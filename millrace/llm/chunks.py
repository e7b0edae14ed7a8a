"""Helpers that operators on texts share: Arrow batches cut by bytes, and words as dictionary codes."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

SLICE_BYTES = 1 << 20
_LIBC = ctypes.CDLL(None)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.Table]:
    """The rows of Arrow batches in pieces of about ``most`` bytes of text, one row at least.

    Null texts become empty ones. A batch of long texts is thus never expanded to words at once.
    Unused memory goes back to the system after the last piece, as workers outlive their tasks.
    """
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if not table.num_rows:
            continue
        texts = _large(plain(pc.fill_null(table[text], "") if table[text].null_count else table[text]))
        table = table.set_column(table.schema.get_field_index(text), text, texts)
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < table.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield table.slice(start, stop - start)
            start = stop
    give_back()


def _large(texts: pa.Array) -> pa.Array:
    """The same texts with long offsets, without a copy of them; none may be null."""
    if texts.type != pa.string() or not len(texts):
        return texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int32, len(texts) + 1).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offsets), data)


def give_back() -> None:
    """Return freed memory to the system: Arrow's, and that of the C library where it can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(_LIBC, "malloc_trim", None)
    if trim is not None:
        trim(0)


def plain(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    """One contiguous array without an offset."""
    array = column
    if isinstance(column, pa.ChunkedArray):  # combining copies one chunk, too
        array = column.chunk(0) if column.num_chunks == 1 else column.combine_chunks()
    if isinstance(array, pa.ChunkedArray):
        array = array.chunk(0) if array.num_chunks else pa.array([], array.type)
    return pa.concat_arrays([array]) if array.offset else array


def word_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words between ASCII white space as ``(offsets, codes, words)``: text ``i`` consists of
    ``words[codes[offsets[i]:offsets[i + 1]]]``; every distinct word is listed once."""
    lists = plain(pc.ascii_split_whitespace(texts))
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat = plain(lists.flatten())
    # White space at either end of a text leaves empty strings.
    full = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    if not full.all():
        kept = np.concatenate([[0], np.cumsum(full)])
        offsets, flat = kept[offsets], flat.filter(pa.array(full))
    encoded = pc.dictionary_encode(flat)
    encoded = plain(encoded)
    return offsets - offsets[0], encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), encoded.dictionary


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices ``starts[i] .. starts[i] + lengths[i] - 1`` for all ``i``, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def kept_rows(docs: DataFrame, text_col: str, decide: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """The rows of ``docs``, unchanged, for whose texts ``decide`` gives true; rows are not moved."""

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                texts = pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(text_col))], names=["text"])
                yield batch.filter(pa.array(np.concatenate([decide(plain(t["text"])) for t in slices(iter([texts]))])))

    return docs.mapInArrow(chosen, docs.schema)
