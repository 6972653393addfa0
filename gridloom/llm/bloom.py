"""Bloom filters in slices of bounded size, filled from each task's own sorted positions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import released, staged
from .shingles import mixed

#: Bits a row, of which two are set; bits of a slice at most (32 MB): keys fall into as many slices as all rows need, so a filter
#: of any number of rows is as thin, and no more than one slice is ever sent about at once.
BITS_A_ROW, LEAST_BITS, SLICE_BITS = 32, 1 << 16, 1 << 28
#: A slice is merged in blocks: about BLOCKS of them in all, of at most MOST_BLOCK bits. Positions that a task holds at once.
BLOCKS, LEAST_BLOCK, MOST_BLOCK, HELD = 512, 1 << 16, 1 << 24, 4_000_000


class Layout:
    """Slices and bits of a slice for a number of rows."""

    def __init__(self, rows: int):
        want = max(LEAST_BITS, rows * BITS_A_ROW)
        self.slices = -(-want // SLICE_BITS)
        self.bits = 1 << (-(-want // self.slices) - 1).bit_length()
        self.block = min(self.bits, MOST_BLOCK, max(LEAST_BLOCK, 1 << (self.slices * self.bits // BLOCKS).bit_length()))

    def places(self, keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The slice of each key (16 evenly distributed bytes or more) and its two positions there."""
        raw = b"".join([k[:16] for k in keys.to_pylist()])
        w = np.frombuffer(raw, "<u8").reshape(-1, 2)
        part = (mixed(w[:, 0] ^ (w[:, 1] >> np.uint64(1))) % np.uint64(self.slices)).astype(np.int64)
        return part, (w & np.uint64(self.bits - 1)).astype(np.int64)


def _packed(at: np.ndarray) -> bytes:
    """Ascending positions as the bytes of their steps, low bytes first, so that the shuffle's compression takes the high ones out."""
    return np.diff(at, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpacked(packed: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(packed, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel().astype(np.int64))


def marks(rows: DataFrame, key: str, layout: Layout, least: int = 1) -> DataFrame:
    """(slice, block, at): the positions that ``least`` rows (one or two) or more have set.

    A task sorts its own positions and sends, for each block, those set once and those set again; rows themselves don't
    move. Blocks are merged one at a time.
    """
    blocks, size = layout.bits // layout.block, layout.block

    def sent(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        at = np.sort(np.concatenate(held)) if held else np.zeros(0, np.int64)
        first = np.flatnonzero(np.diff(at, prepend=-1))
        n, at = np.diff(np.append(first, len(at))), at[first]
        cuts = np.flatnonzero(np.diff(at // size, prepend=-1))
        out = []
        for a, z in zip(cuts.tolist(), np.append(cuts[1:], len(at)).tolist() if len(at) else [], strict=True):
            some = at[a:z] % size
            out.append((int(at[a] // size), _packed(some[n[a:z] == 1]), _packed(some[n[a:z] > 1])))
        number = np.array([x[0] for x in out], np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(number // blocks), pa.array(number % blocks), *[pa.array([x[k] for x in out], pa.binary()) for k in (1, 2)]], ["slice", "block", "once", "again"])

    def marked(batches):
        held, n = [], 0
        for b in batches:
            part, at = layout.places(b.column(0))
            # two equal positions of one key are one
            same = at[:, 0] == at[:, 1]
            held.append(np.concatenate([part * layout.bits + at[:, 0], (part * layout.bits + at[:, 1])[~same]]))
            n += len(held[-1])
            if n > HELD:
                yield from sent(held)
                held, n = [], 0
        yield from sent(held)

    def merged(batches):
        now, seen, again = None, np.zeros(size, bool), np.zeros(size, bool)

        def done():
            at = np.flatnonzero(seen if least == 1 else again)
            return pa.RecordBatch.from_arrays([pa.array([now[0]]), pa.array([now[1]]), pa.array([_packed(at)], pa.binary())], ["slice", "block", "at"])

        for b in batches:
            for part, block, once, more in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if (part, block) != now:
                    if now:
                        yield done()
                    now = (part, block)
                    seen[:] = again[:] = False
                at = _unpacked(once)
                again[at[seen[at]]] = True
                seen[at] = True
                at = _unpacked(more)
                again[at] = seen[at] = True
        if now:
            yield done()

    parts = rows.select(key).mapInArrow(released(marked), "slice long, block long, once binary, again binary")
    return parts.repartition("slice", "block").sortWithinPartitions("slice", "block").mapInArrow(merged, "slice long, block long, at binary")


def slice_bits(marks: DataFrame, part: int, layout: Layout) -> np.ndarray:
    """One slice's filter as bytes of eight bits; a slice has at most SLICE_BITS, which bounds what comes to the driver."""
    out = np.zeros(layout.bits // 8, np.uint8)
    for r in marks.filter(F.col("slice") == part).toLocalIterator():
        block = np.zeros(layout.block, bool)
        block[_unpacked(bytes(r["at"]))] = True
        out[r["block"] * layout.block // 8 : (r["block"] + 1) * layout.block // 8] = np.packbits(block, bitorder="little")
    return out


def tested(rows: DataFrame, key: str, part: int, words: np.ndarray, layout: Layout) -> DataFrame:
    """Those of ``rows`` whose key falls into a slice, with ``maybe``: whether both of its positions are set."""
    shared = rows.sparkSession.sparkContext.broadcast(words)

    def test(batches):
        for b in batches:
            own, at = layout.places(b.column(key))
            here = own == part
            at, b = at[here], b.filter(pa.array(here)) if layout.slices > 1 else b
            hit = ((shared.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(hit)], [*b.schema.names, "maybe"])

    return rows.mapInArrow(released(test), T.StructType([*rows.schema.fields, T.StructField("maybe", T.BooleanType())]))


def in_slices(rows: DataFrame, key: str, count: int, least: int, write) -> None:
    """Hand each slice's tested rows to ``write``, one slice after another."""
    layout = Layout(count)
    found = staged(marks(rows, key, layout, least), "marks")
    for part in range(layout.slices):
        write(tested(rows, key, part, slice_bits(found, part, layout), layout))
