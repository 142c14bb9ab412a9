"""Substring dedup by minimiser-anchored phrases, in place of greedy relative Lempel-Ziv factoring: passages that also
stand elsewhere are removed.

The reference is the whole table. Its index holds phrases: each window of WINDOW words has an anchor, the run of
ANCHOR words in it with the least hash, and the consecutive windows with the same anchor are one phrase, whose extent
depends on its own words only. So a document's phrases are looked up among all of the index (it is dealt by anchor):
equal phrases are repeated as a whole. Where phrases that share an anchor differ, they are compared window by window. Equal windows have equal anchors, so
nothing repeated is missed, and only phrases whose anchor occurs again are looked at twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BASE, INVERSE, SPACES, Words, byte_table, free_names, materialise, mix, powers, runs, window_hashes

WINDOW, ANCHOR = 35, 8
PLAIN = byte_table(SPACES)


def word_list(text: str | None) -> list[bytes]:
    """Words as bytes: they end at ASCII white space, and nothing else is changed."""
    return (text or "").encode().split()


def phrases(h: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """(anchor hash, phrase hash, first window, windows) of each phrase of a document's word hashes."""
    n = len(h) - window + 1
    if n <= 0:
        return (np.empty(0, np.int64),) * 4
    grams = window_hashes(h, anchor)
    span = window - anchor + 1
    place = np.empty(n, np.int64)
    for at in range(0, n, 1 << 16):
        some = np.lib.stride_tricks.sliding_window_view(grams[at : at + (1 << 16) + span - 1], span)[: n - at]
        place[at : at + len(some)] = some.argmin(axis=1) + np.arange(at, at + len(some))
    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    count = np.diff(np.r_[first, n])
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * powers(BASE, len(h)), out=sums[1:])
    whole = (sums[first + count + window - 1] - sums[first]) * powers(INVERSE, n)[first]
    shape = ((place[first] - first) << 32) + count
    return grams[place[first]].view(np.int64), mix(whole ^ mix(shape.astype(np.uint64))).view(np.int64), first, count


def window_codes(h: np.ndarray, starts: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """A hash, independent of the anchors', of the windows at these places."""
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(mix(h) * powers(BASE, len(h)), out=sums[1:])
    return mix((sums[starts + window] - sums[starts]) * powers(INVERSE, len(h))[starts])


def repeated_windows(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """docs (_row long, unique; text) to (_row, first, n): the windows first .. first+n-1 (by first word) that also
    start elsewhere. docs is read twice and must give the same rows each time."""

    def factor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in runs(batch.column(1)):
                rows, parts = batch.column(0)[at : at + n].to_numpy(), []
                words = Words(batch.column(1).slice(at, n), PLAIN)
                for row, a, b in zip(rows, words.offsets, words.offsets[1:]):
                    found = phrases(words.hash[a:b], window, anchor)
                    parts.append((*found, np.full(len(found[0]), row, np.int64)))
                a, p, first, count, row = (np.concatenate(x) for x in zip(*parts))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(p), pa.array(row), pa.array(first.astype(np.int32)), pa.array(count.astype(np.int32))], ["anchor", "phrase", "_row", "first", "n"])

    index = materialise(docs.select("_row", "text").mapInArrow(factor, "anchor long, phrase long, _row long, first int, n int"), "phrases")
    # a table of its own, so that the join's other side can be split where one anchor has most rows
    again = materialise(index.groupBy("anchor").agg(F.count(F.lit(1)).alias("uses")).where("uses > 1").select("anchor"), "again")
    shared = materialise(index.join(again, "anchor"), "shared")
    each = shared.groupBy("anchor", "phrase").agg(F.count(F.lit(1)).alias("uses"), F.min(F.struct("_row", "first", "n")).alias("at"))
    each = materialise(each, "kinds")
    whole = shared.join(each.where("uses > 1").select("anchor", "phrase"), ["anchor", "phrase"]).select("_row", "first", "n")
    # factor boundaries: anchors with a phrase that occurs once and another phrase
    mixed = each.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.min("uses").alias("least")).where("kinds > 1 AND least = 1").select("anchor")
    border = each.join(mixed, "anchor").select("anchor", (F.col("uses") == 1).alias("once"), "at.*")
    by_doc = border.groupBy("_row").agg(F.collect_list(F.struct("anchor", "once", "first", "n")).alias("phrases"))

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (row, found) in enumerate(zip(batch.column(0), batch.column(2))):
                h = Words(batch.column(1).slice(i, 1), PLAIN).hash
                items = found.as_py()
                n = np.array([x["n"] for x in items])
                first = np.repeat([x["first"] for x in items], n)
                starts = first + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                anchors = np.repeat(np.array([x["anchor"] for x in items], np.int64), n)
                once = np.repeat([x["once"] for x in items], n)
                yield pa.RecordBatch.from_arrays([pa.array(anchors), pa.array(window_codes(h, starts, window).view(np.int64)), pa.array(once), pa.array(np.full(len(starts), row.as_py(), np.int64)), pa.array(starts.astype(np.int32))], ["anchor", "code", "once", "_row", "first"])

    windows = docs.select("_row", "text").join(by_doc, "_row").mapInArrow(unfold, "anchor long, code long, once boolean, _row long, first int")
    windows = materialise(windows, "windows")
    twice = materialise(windows.groupBy("anchor", "code").agg(F.count(F.lit(1)).alias("uses")).where("uses > 1").select("anchor", "code"), "twice")
    partly = windows.where("once").join(twice, ["anchor", "code"]).select("_row", "first", F.lit(1).alias("n"))
    return whole.union(partly)


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """docs with n_words, n_removed and kept: its words, joined by one space, without those covered by a window of
    `window` consecutive words that also starts anywhere else in docs (in the same text too).

    docs has text and any other columns, which stay (n_words, n_removed and kept are replaced); it is read several times and must give the same rows in the same order each time, as files do. A
    null text has no words; a repeated row is elsewhere; a text of fewer words than a window keeps them all.
    """
    if not 0 < anchor <= window:
        raise ValueError("anchor must be 1 to window")
    row, spans_ = free_names(docs.columns, "row", "spans")
    numbered = docs.drop("n_words", "n_removed", "kept").withColumn(row, F.monotonically_increasing_id())
    spans = repeated_windows(numbered.select(F.col(row).alias("_row"), "text"), window, anchor).groupBy(F.col("_row").alias(row)).agg(F.collect_list(F.struct("first", "n")).alias(spans_))
    joined = numbered.join(spans, row, "left").drop(row)
    schema = T.StructType([*(f for f in joined.schema.fields if f.name != spans_), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            stay = [i for i, c in enumerate(names) if c != spans_]
            rows = []
            for text, spans in zip(batch.column(names.index("text")), batch.column(names.index(spans_))):
                words = word_list(text.as_py())
                gone = 0
                if spans.is_valid:
                    edge = np.zeros(len(words) + 1, np.int64)
                    found = spans.values
                    first, n = (np.asarray(found.field(c)).astype(np.int64) for c in ("first", "n"))
                    np.add.at(edge, first, 1)
                    np.add.at(edge, first + n + window - 1, -1)
                    keep = np.cumsum(edge[:-1]) == 0
                    gone = int((~keep).sum())
                    kept = [w for w, k in zip(words, keep.tolist()) if k]
                else:
                    kept = words
                rows.append((len(words), gone, b" ".join(kept).decode()))
            more = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else ((), (), ()), (pa.int64(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in stay), *more], [*(names[i] for i in stay), "n_words", "n_removed", "kept"])

    return joined.mapInArrow(cut, schema)


def op8_relative_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without their repeated passages, as digests."""
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
