"""Postings of rare keys: lines or documents meet on keys of theirs, in packed rows for each part of the key space.

One order holds for all keys, rare ones first by a count of their hashes; a prefix filter takes the first keys of each
line or document in that order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import mix
from .groups import picked_groups
from .simhash import whole_groups

#: Keys that a part of the key space has, about.
PART_POSTINGS = 4_000_000
COLUMNS = "part int, n long, blocks binary, ids binary, words binary, signs binary"


def packed(values: np.ndarray) -> bytes:
    return pa.compress(values.tobytes(), codec="zstd", asbytes=True)


def unpacked(column: pa.ChunkedArray, n: list[int], kind: type) -> list[np.ndarray]:
    size = np.dtype(kind).itemsize
    return [np.frombuffer(pa.decompress(x.as_buffer(), decompressed_size=size * k, codec="zstd"), kind) for x, k in zip(column, n)]


def key_counts(source: DataFrame, keys: Callable[[pa.Array], Iterator[np.ndarray]], size: int) -> np.ndarray:
    """For each value of the low bits of a key, 8 log2 of how often it occurs in all of source, plus 1; 0 if never.

    One byte each, for `size` values, a power of two: a table of bounded size, whatever the keys. keys: those of some
    of source's one column."""
    slice_ = 1 << 16

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.uint32)
        for batch in batches:
            for some in keys(batch.column(0)):
                np.add.at(total, (some & np.uint64(size - 1)).astype(np.int64), np.uint32(1))
        for i, some in enumerate(total.reshape(-1, slice_)):
            if some.any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([packed(some)], pa.binary())], ["slice", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, np.zeros(slice_, np.int64)
        ranks = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.where(total > 0, np.minimum(255, 1 + 8 * np.log2(np.maximum(total, 1))), 0).astype(np.uint8).tobytes()], pa.binary())], ["slice", "ranks"])
        for batch in batches:
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                if i != now:
                    if now is not None:
                        yield ranks()
                    now, total = i, np.zeros(slice_, np.int64)
                total += np.frombuffer(pa.decompress(x.as_buffer(), decompressed_size=4 * slice_, codec="zstd"), np.uint32)
        if now is not None:
            yield ranks()

    counted = source.mapInArrow(count, "slice int, counts binary")
    out = np.zeros(size, np.uint8)
    for r in counted.repartition("slice").sortWithinPartitions("slice").mapInArrow(add, "slice int, ranks binary").collect():
        out[r["slice"] * slice_ : (r["slice"] + 1) * slice_] = np.frombuffer(r["ranks"], np.uint8)
    return out


#: How often what is this common occurs, about; from where on parities go with a key, as many may meet there.
COUNTED = 2 ** ((np.arange(256) - 1) / 8)
SIGNED = 8


def piece_numbers(usual: float, per_piece: int) -> np.ndarray:
    """Into how many pieces keys of each commonness are dealt, 0 if they aren't: those that are a good share of a part,
    where any value has `usual` keys."""
    return np.where((COUNTED > per_piece / 4) & (COUNTED > 8 * usual), 1 + np.ceil(COUNTED / per_piece), 0).astype(np.int64)


def packed_rows(ids: np.ndarray, n: np.ndarray, row: np.ndarray, key: np.ndarray, rank: np.ndarray, parts: int, pieces: np.ndarray, signs: np.ndarray | None = None) -> pa.RecordBatch:
    """The keys of some thousand rows, of these ids and lengths, as COLUMNS: a row for each part of the key space, with
    the keys' 32 other bits, the ids (as steps), lengths and, if given, 64 parities (see picked_groups). Only common keys
    take these along, in a row of their own.

    A key that is a good share of a part is dealt over several parts by id: `parts` times the number of its piece is
    added to the part."""
    part = (key & np.uint64(0xFFFFFFFF)) % np.uint64(parts)
    hot = np.flatnonzero(pieces[rank])
    part[hot] += np.uint64(parts) * (1 + mix(ids[row[hot]].view(np.uint64)) % pieces[rank[hot]].astype(np.uint64))
    signed = np.zeros(len(part), bool) if signs is None else COUNTED[rank] >= SIGNED
    by = np.argsort(part * np.uint64(2) + signed, kind="stable")
    part, signed, row, block = part[by].astype(np.int32), signed[by], row[by], (key[by] >> np.uint64(32)).astype(np.uint32)
    cuts = np.flatnonzero(np.r_[True, (part[1:] != part[:-1]) | (signed[1:] != signed[:-1]), True]) if len(part) else np.zeros(1, np.int64)
    each = [(block[a:b], np.diff(ids[row[a:b]], prepend=0), n[row[a:b]].astype(np.int32)) for a, b in zip(cuts, cuts[1:])]
    columns = [pa.array(part[cuts[:-1]]), pa.array(np.diff(cuts)), *(pa.array([x[0].tobytes() if c == 0 else packed(x[c]) for x in each], pa.binary()) for c in range(3))]
    columns.append(pa.array([signs[row[a:b]].tobytes() if signed[a] else b"" for a, b in zip(cuts, cuts[1:])], pa.binary()))
    return pa.RecordBatch.from_arrays(columns, ["part", "n", "blocks", "ids", "words", "signs"])


def picker(parts: int, similarity: float, bucket: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From packed rows, a part's together, to what meets on a key (see picked_groups)."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "part", 1):
            part, count = np.asarray(table["part"]), table["n"].to_pylist()
            for one in np.unique(part).tolist():
                here = pa.array(np.flatnonzero(part == one))
                some, k = table.take(here), [count[i] for i in here.to_pylist()]
                block = np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in some["blocks"]])
                by = np.argsort(block, kind="stable")
                block = block[by]
                start = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
                size = np.repeat(np.diff(np.r_[start, len(block)]), np.diff(np.r_[start, len(block)]))
                if one >= parts:
                    size[:] = bucket + 1
                shared = np.flatnonzero(size > 1)
                by, block, size = by[shared], block[shared].astype(np.int64), size[shared]
                ids = np.concatenate([np.cumsum(x) for x in unpacked(some["ids"], k, np.int64)])[by]
                n = np.concatenate(unpacked(some["words"], k, np.int32))[by].astype(np.int64)
                signs = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) if len(x.as_py()) else np.zeros(m, np.uint64) for x, m in zip(some["signs"], k)])[by]
                yield from picked_groups((one % parts << 32) + block, ids, n, size, similarity, bucket, signs)

    return pick
