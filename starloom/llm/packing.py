"""Packing: cutting-stock column generation.

Documents are cut into pieces of at most a sequence; the histogram of piece lengths, in steps of `grain` tokens, is a
cutting-stock problem. A linear program over patterns (how many pieces of each length a sequence holds) is solved by
column generation: a knapsack dynamic program prices new patterns with the program's duals. Pattern counts are rounded
down, what is left is packed first-fit; pieces, ranked within their length, take the patterns' places in order. The
program knows only the histogram; ranks, places and offsets are Spark jobs over narrow rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_names, materialise, width, with_offsets
from .tokens import encoder

SEQUENCE, GRAIN = 2048, 8
#: Pieces of one length that one task numbers, at most (about).
RANKED_ROWS = 1_000_000


def best_pattern(values: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The most valuable pattern of any numbers of items that fits: an unbounded knapsack."""
    best, took = np.zeros(room + 1), np.full(room + 1, -1)
    for c in range(1, room + 1):
        best[c] = best[c - 1]
        fits = sizes <= c
        if fits.any():
            gain = np.where(fits, values + best[np.maximum(c - sizes, 0)], -1.0)
            i = int(gain.argmax())
            if gain[i] > best[c] + 1e-12:
                best[c], took[c] = gain[i], i
    pattern, c = np.zeros(len(sizes), np.int64), room
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            pattern[took[c]] += 1
            c -= sizes[took[c]]
    return float(best[room]), pattern


def solve_patterns(sizes: np.ndarray, demand: np.ndarray, room: int) -> list[tuple[np.ndarray, float]]:
    """An optimal basis of the linear program: fewest sequences whose patterns hold exactly the demand.

    Revised simplex from the patterns of one size each. Stops when no pattern prices out; the step limit only bounds
    the time on degenerate inputs, any basis on the way holds the demand.
    """
    m = len(sizes)
    each = room // sizes
    patterns = [np.eye(m, dtype=np.int64)[i] * each[i] for i in range(m)]
    inverse, x = np.diag(1.0 / each), demand / each
    for _ in range(50 * m + 100):
        duals = inverse.sum(axis=0)
        value, new = best_pattern(duals, sizes, room)
        if value <= 1 + 1e-7:
            break
        d = inverse @ new
        ok = d > 1e-9
        if not ok.any():
            break
        ratio = np.where(ok, x / np.where(ok, d, 1), np.inf)
        out = int(ratio.argmin())
        step = ratio[out]
        x = x - step * d
        x[out] = step
        row = inverse[out] / d[out]
        inverse = inverse - np.outer(d, row)
        inverse[out] = row
        patterns[out] = new
    return [(p, max(0.0, float(n))) for p, n in zip(patterns, x)]


def plan_patterns(histogram: dict[int, int], room: int) -> list[tuple[dict[int, int], int]]:
    """(size -> items, copies): patterns that hold exactly the histogram's items."""
    if not histogram:
        return []
    sizes = np.array(sorted(histogram, reverse=True), np.int64)
    demand = np.array([histogram[int(s)] for s in sizes], np.int64)
    out, left = [], demand.copy()
    for pattern, n in solve_patterns(sizes, demand.astype(float), room):
        items = pattern > 0
        copies = min(int(n + 1e-6), int((left[items] // pattern[items]).min())) if items.any() else 0
        if copies:
            out.append((pattern, copies))
            left -= copies * pattern
    # what rounding left: bins by first fit, largest items first; equal bins count together
    open_bins: list[tuple[int, np.ndarray]] = []
    for i, s in enumerate(sizes):
        for k, (free, pattern) in enumerate(open_bins):
            take = min(int(left[i]), free // int(s))
            if take:
                pattern[i] += take
                left[i] -= take
                open_bins[k] = (free - take * int(s), pattern)
        full = room // int(s)
        whole, rest = divmod(int(left[i]), full)
        if whole:
            one = np.zeros(len(sizes), np.int64)
            one[i] = full
            out_free = room - full * int(s)
            for _ in range(whole):
                open_bins.append((out_free, one.copy()))
        if rest:
            one = np.zeros(len(sizes), np.int64)
            one[i] = rest
            open_bins.append((room - rest * int(s), one))
        left[i] = 0
    out += [(pattern, 1) for _, pattern in open_bins]
    return [({int(sizes[i]): int(p[i]) for i in np.flatnonzero(p)}, n) for p, n in out]


def pack_pieces(pieces: DataFrame, sequence: int = SEQUENCE, grain: int = GRAIN) -> DataFrame:
    """pieces (a written table; piece long, unique; length int, 1 to sequence) with sequence_id (0..) and offset.

    Lengths are rounded up to the grain in the program only: a sequence's pieces stand gapless from offset 0. A null
    length is an error; no pieces give no rows; other columns of any name stay (sequence_id and offset are replaced).
    """
    if sequence % grain:
        raise ValueError("grain must divide sequence")
    size_, bucket_, rank_ = free_names([*pieces.columns, "sequence_id", "offset"], "size", "bucket", "rank")
    sized = pieces.drop("sequence_id", "offset").withColumn(size_, F.ceil(F.col("length") / F.lit(grain)).cast("int"))
    histogram = {r[size_]: r["n"] for r in sized.groupBy(size_).agg(F.count(F.lit(1)).alias("n")).collect()}
    if None in histogram or max(histogram, default=1) > sequence // grain or min(histogram, default=1) < 1:
        raise ValueError(f"a piece's length must be 1 to {sequence}")
    patterns = plan_patterns(histogram, sequence // grain)
    rows, done, first = [], dict.fromkeys(histogram, 0), 0
    for items, copies in patterns:
        for size, k in items.items():
            rows.append((size, done[size], k, first))
            done[size] += k * copies
        first += copies
    rows.sort()
    sizes, lows, per, base = (np.array([r[i] for r in rows], np.int64) for i in range(4))
    keys = (sizes << 44) + lows

    buckets = max(width(pieces.sparkSession), -(-max(histogram.values(), default=0) // RANKED_ROWS))
    spread = sized.withColumn(bucket_, F.pmod(F.xxhash64("piece"), F.lit(buckets)).cast("int"))
    ranked = with_offsets(spread, [size_], bucket_, [F.col("piece")], rank_)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = (np.asarray(batch.column(batch.schema.get_field_index(c))).astype(np.int64) for c in (size_, rank_))
            at = np.searchsorted(keys, (size << 44) + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(base[at] + (rank - lows[at]) // per[at])], [*batch.schema.names, "sequence_id"])

    placed = ranked.mapInArrow(place, T.StructType([*ranked.schema.fields, T.StructField("sequence_id", T.LongType())]))
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "piece")
    upto = F.sum("length").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return placed.withColumn("offset", (upto - F.col("length")).cast("long")).drop(size_, bucket_, rank_)


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, sequence: int = SEQUENCE, keep_ids: bool = True) -> DataFrame:
    """docs (doc_id, text) tokenised, closed with end_id and cut: piece, doc_id, start, length, ids_crc32, doc_tokens,
    ids (little-endian unsigned 32-bit integers; null without keep_ids). Written once.

    A document's pieces are full sequences and what is left. A null or empty text is its end id alone. Repeated rows
    and null ids are documents like any other.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        names = ["row", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            keys, docs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at, flat, offsets in encode.batches(batch.column(2)):
                rows, all_ids = [], flat.astype("<u4").tobytes()
                for i, (a, b) in enumerate(zip(offsets.tolist(), offsets[1:].tolist())):
                    raw = all_ids[4 * a : 4 * b] + end
                    for c in range(0, len(raw), 4 * sequence):
                        ids = raw[c : c + 4 * sequence]
                        rows.append((keys[at + i], docs[at + i], c // 4, len(ids) // 4, zlib.crc32(ids), len(raw) // 4, ids if keep_ids else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    cut = numbered.mapInArrow(run, "row long, doc_id long, start long, length int, ids_crc32 long, doc_tokens long, ids binary")
    return materialise(cut.withColumn("piece", F.monotonically_increasing_id()), "pieces")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, sequence: int = SEQUENCE, keep_ids: bool = True) -> DataFrame:
    """token_pieces, packed by pack_pieces."""
    return pack_pieces(token_pieces(docs, tokenizer, end_id, sequence, keep_ids), sequence)


def op4_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    import public_tokenizers

    packed = pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), 1, keep_ids=False)
    return packed.select("doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens", "sequence_id", "offset")
