"""Words of texts, told apart by their bytes, with an integer id for each distinct word of a block.

Both kinds of word end at ASCII characters only, so UTF-8 bytes decide exactly what code points would. Texts are taken in blocks of
about `BLOCK` bytes; a longer text is cut into parts behind bytes that belong to no word, so memory depends on the block and the longest word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK = 4 << 20


def table_without(*ranges: tuple[int, int]) -> np.ndarray:
    """Which bytes belong to words: all but those of `ranges`."""
    out = np.ones(256, dtype=bool)
    for low, high in ranges:
        out[low : high + 1] = False
    return out


@dataclass
class Block:
    row: int  # the first row
    rows: int
    data: np.ndarray  # bytes of these rows, or of a part of one row
    offsets: np.ndarray  # rows + 1 offsets into data
    last: bool  # whether the (last) row ends here

    def words(self, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """For each word, in order, its row within the block and its id; then the distinct words by id."""
        inside = is_word[self.data]
        before, after = np.zeros_like(inside), np.zeros_like(inside)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        bounds = self.offsets[1:-1]
        before[bounds[bounds < len(inside)]] = False
        after[bounds[bounds > 0] - 1] = False
        starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        at = np.zeros(len(starts) + 1, dtype=np.int32)
        np.cumsum(ends - starts, out=at[1:])
        found = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(self.data[inside])]).dictionary_encode()
        rows = np.searchsorted(self.offsets, starts, side="right") - 1
        return rows, found.indices.to_numpy(), found.dictionary.to_pylist()


def blocks(column: pa.Array, is_word: np.ndarray, size: int = BLOCK) -> Iterator[Block]:
    """`column` (binary, no nulls) in blocks; a text of more than `size` bytes in parts of its own."""
    column = column.cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    row = 0
    while row < len(column):
        stop = max(int(np.searchsorted(ends, ends[row] + size, side="right")) - 1, row + 1)
        if ends[row + 1] - ends[row] <= size:
            yield Block(row, stop - row, data[ends[row] : ends[stop]], ends[row : stop + 1] - ends[row], True)
            row = stop
            continue
        at, end = int(ends[row]), int(ends[row + 1])
        while at < end:
            cut = min(at + size, end)
            while cut < end and is_word[data[cut - 1]]:  # to the end of the word
                gaps = np.flatnonzero(~is_word[data[cut : min(cut + size, end)]])
                cut = cut + int(gaps[0]) + 1 if len(gaps) else min(cut + size, end)
            yield Block(row, 1, data[at:cut], np.array([0, cut - at]), cut == end)
            at = cut
        row += 1
