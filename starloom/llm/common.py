"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_fallback: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir; a temporary one only on a local master that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _fallback.setdefault("dir", tempfile.mkdtemp(prefix="starloom-"))


#: Folders of the runs that are open, the innermost last.
_runs: list[str] = []


@contextlib.contextmanager
def scratch_run(spark: SparkSession) -> Iterator[str]:
    """A folder of its own for the tables that operators write meanwhile; it goes when the block ends, so write the
    result to another place within it."""
    _runs.append(f"{scratch_dir(spark)}/run-{uuid.uuid4().hex}")
    try:
        yield _runs[-1]
    finally:
        _delete(spark, _runs.pop())


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def materialise(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Write df to the shared scratch folder and read it back: cuts the lineage and survives lost executors."""
    path = f"{_runs[-1] if _runs else scratch_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables from which nothing is computed any more."""
    for table in tables:
        _delete(table.sparkSession, table._scratch_path)


def growing(df: DataFrame) -> DataFrame:
    """df as a side of a join that is shuffled and merged. Sides that grow with the input must not be broadcast: a
    written table's size is that of its compressed files, so one under the broadcast limit can take many times as much
    in the driver."""
    return df.hint("merge")


def free_names(taken: Iterable[str], *names: str) -> list[str]:
    """The names, each with as many underscores as set it apart from those taken, whatever their case."""
    used, out = {x.lower() for x in taken}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def width(spark: SparkSession) -> int:
    """How many partitions a shuffle of this session has."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def with_offsets(df: DataFrame, groups: list[str], bucket: str, order: list, out: str) -> DataFrame:
    """Number the rows of each group from 0, in the order (bucket, *order), with no task that holds a whole group.

    Buckets are counted first; a row's number is the rows in the group's earlier buckets plus its place in its own.
    df is evaluated twice, so it should be a written table.
    """
    n, before, at = free_names(df.columns, "n", "before", "place")
    counts = df.groupBy(*groups, bucket).agg(F.count(F.lit(1)).alias(n))
    earlier = Window.partitionBy(*groups).orderBy(bucket).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = counts.withColumn(before, F.sum(n).over(earlier) - F.col(n)).drop(n)
    place = F.row_number().over(Window.partitionBy(*groups, bucket).orderBy(*order)) - 1
    placed = df.withColumn(at, place)
    return placed.join(offsets, [*groups, bucket]).withColumn(out, F.col(before) + F.col(at)).drop(before, at)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose every output bit depends on every input bit (splitmix64's last steps)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: Multiplier of the polynomial over word hashes, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1024, 1 << (n - 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        have = _powers[base] = np.multiply.accumulate(have)
    return have[:n]


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k consecutive word hashes; none if there are fewer than k."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    if k <= 8:
        total = h[:n].copy()
        for j in range(1, k):
            total = total * np.uint64(BASE) + h[j : j + n]
        return mix(total)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * powers(BASE, len(h)), out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * powers(INVERSE, n))


def shingle_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """window_hashes, but a shorter, non-empty sequence is one shingle."""
    return window_hashes(h, min(k, len(h))) if len(h) else h


#: A byte's bits, each in a byte of its own: adding these counts bits, eight at a time, up to 255 of each.
SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8), bitorder="little").view(np.uint64)


def bit_counts(h: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """How many of the hashes of each segment have each of the 64 bits. A segment goes from its cut to the next; none
    is empty."""
    length = np.diff(np.r_[cuts, len(h)])
    pieces = -(-length // 255)
    first = np.cumsum(pieces) - pieces
    at = np.repeat(cuts, pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(first, pieces))
    sums = np.add.reduceat(SPREAD[np.ascontiguousarray(h).view(np.uint8).reshape(len(h), 8)], at, axis=0)
    counts = sums.view(np.uint8).reshape(len(at), 64)
    return counts.astype(np.int32) if len(at) == len(cuts) else np.add.reduceat(counts, first, axis=0, dtype=np.int32)


def runs(texts: pa.Array, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """(first, count) of runs of texts of about `size` bytes together, one text at least."""
    length = np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64)
    run = (np.cumsum(length) - length) // size
    cuts = np.r_[0, np.flatnonzero(run[1:] != run[:-1]) + 1, len(run)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield int(a), int(b - a)


def byte_table(spaces: bytes, lower: bool = False, digits: bool = False) -> np.ndarray:
    """What each byte counts as in a word: 0 ends words; lower: A-Z as a-z; digits: 0-9 as 0."""
    table = np.arange(256, dtype=np.uint8)
    if lower:
        table[65:91] += 32
    if digits:
        table[48:58] = 48
    table[list(spaces)] = 0
    return table


#: ASCII white space: 0x20 and 0x09 to 0x0D. Other characters, also byte 0, are part of words.
SPACES = b" \t\n\v\f\r"


class Words:
    """The words of a run of texts: where they are in `raw`, their hashes, and each text's share of them."""

    def __init__(self, texts: pa.Array, table: np.ndarray, spaces: bytes = SPACES, split: int | None = None, fold: bool = False, classes: np.ndarray | None = None) -> None:
        """table: see byte_table; split: a byte that also ends texts (lines); fold: upper-case Latin-1 letters as lower.

        classes, instead of spaces: the class of each byte, 0 between words; a change of class starts a word, and a
        point or comma between two digits (class 2) is a digit.
        """
        texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
        if not isinstance(texts, pa.Array):
            texts = texts.combine_chunks()
        bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        self.raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
        self.text_bounds = bounds = bounds - bounds[0]
        if classes is None:
            classes = np.ones(256, np.uint8)
            classes[list(spaces)] = 0
        self.kind = kind = classes[self.raw]
        inner = bounds[1:-1]
        inner = inner[(inner > 0) & (inner < len(kind))]
        if classes.max() > 1:
            edge = np.zeros(len(kind) + 1, bool)
            edge[inner] = True
            mark = np.isin(self.raw[1:-1], np.frombuffer(b".,", np.uint8)) & (kind[:-2] == 2) & (kind[2:] == 2) & ~edge[1:-2] & ~edge[2:-1]
            kind[1:-1][mark] = 2
        if split is not None:
            cut = np.flatnonzero(self.raw == split)
            bounds = np.sort(np.r_[bounds, cut + 1], kind="stable")
        self.bounds = bounds  # of texts, or of their lines
        before, after = np.r_[np.uint8(0), kind[:-1]], np.r_[kind[1:], np.uint8(0)]
        before[inner] = 0
        after[inner - 1] = 0
        self.start, self.end = np.flatnonzero((kind > 0) & (kind != before)), np.flatnonzero((kind > 0) & (kind != after)) + 1
        value = table[self.raw]
        if fold:
            high = np.flatnonzero((self.raw[1:] >= 0x80) & (self.raw[1:] <= 0x9E) & (self.raw[1:] != 0x97) & (self.raw[:-1] == 0xC3)) + 1
            value[high] += 0x20
        sums = np.zeros(len(self.raw) + 1, np.uint64)
        np.cumsum((value.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(self.raw)), out=sums[1:])
        self.hash = mix((sums[self.end] - sums[self.start]) * powers(INVERSE, len(self.raw) + 1)[self.start])
        #: text (or line) i has words offsets[i] : offsets[i + 1]
        self.offsets = np.searchsorted(self.start, bounds)


def bytes_array(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """values[offsets[i] : offsets[i + 1]] as a binary array, without a copy of each."""
    width = values.dtype.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * width).astype(np.int64).tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())]).cast(pa.binary())
