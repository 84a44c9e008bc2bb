"""Words of whole batches of texts as number arrays, without a Python object for each word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes between words: space and the ASCII controls 9 to 13. All are single bytes of UTF-8, so bytes can be split without decoding.
GAPS = b"\x20\x09\x0a\x0b\x0c\x0d"


def pieces_of(batch: pa.RecordBatch, column: int, max_bytes: int = 1 << 18) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch whose texts have about max_bytes at most (a longer text is a slice of its own), as (slice, bytes, offsets). Null texts are empty."""
    texts = batch.column(column).fill_null("").cast(pa.large_string())
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + max_bytes, "right")) - 1)
        yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


class Words:
    """The words of some texts: ``ids`` numbers them by first place in ``distinct``; those of text i are ids[first[i]:first[i + 1]]; ``begins`` and ``ends`` are places in the bytes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, gaps: bytes = GAPS):
        table = np.ones(256, bool)
        table[np.frombuffer(gaps, np.uint8)] = False
        inside = table[data]
        starts = inside.copy()
        starts[1:] &= ~inside[:-1]
        edge = offsets[:-1][offsets[:-1] < offsets[1:]]
        starts[edge] = inside[edge]
        stops = inside.copy()
        stops[:-1] &= ~inside[1:]
        stops[edge[1:] - 1] = inside[edge[1:] - 1]
        self.begins, self.ends = np.flatnonzero(starts), np.flatnonzero(stops) + 1
        self.first = np.searchsorted(self.begins, offsets)
        at = np.zeros(len(self.begins) + 1, np.int64)
        np.cumsum(self.ends - self.begins, out=at[1:])
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self.begins), [None, pa.py_buffer(at), pa.py_buffer(data[inside])])
        coded = words.dictionary_encode()
        self.ids = coded.indices.to_numpy(zero_copy_only=False)
        self.distinct = coded.dictionary


def ragged(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The numbers first[i] .. first[i] + length[i] - 1 for each i in turn."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    at = np.cumsum(length) - length
    return np.arange(total, dtype=np.int64) - np.repeat(at - first, length)
