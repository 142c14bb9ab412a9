"""Document fingerprints: threshold-scaled sketches.

A sketch keeps every shingle hash below a fraction of the hash range: a fixed one, doubled for small texts as long as
no more than SMALL hashes are kept, so that short texts keep all. Thresholds are nested: two sketches are compared, and
merged by union, below the smaller one, and what they share estimates containment however unequal the documents are. A
text's fingerprint is its sketch: base64 of the ascending, distinct 64-bit hashes, little-endian, and of one zero byte
for each doubling.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACES, Words, byte_table, runs, shingle_hashes, width, window_hashes

WORDS = 5
FRACTION = 1 / 8
#: Hashes that a sketch with a doubled fraction has at most.
SMALL = 32


LOWER = byte_table(SPACES, lower=True)


def below(h: np.ndarray, fraction: float, depth: int) -> np.ndarray:
    """The ascending hashes h below the fraction doubled `depth` times."""
    return h[: np.searchsorted(h, np.uint64(min(int(fraction * 2**depth * 2**64), 1 << 64) - 1), side="right")]


def deepest(fraction: float) -> int:
    """Doublings that keep all hashes."""
    return max(0, int(np.ceil(np.log2(1 / fraction))))


def scaled_sketches(texts: pa.Array, fraction: float = FRACTION, words: int = WORDS, small: int = SMALL) -> list[tuple[np.ndarray, int]]:
    """For each text, the distinct hashes of its word shingles below the threshold, ascending, and its doublings.

    A-Z count as a-z; words end at ASCII white space. Null and empty texts, and texts of white space, have no shingle;
    fewer words than a shingle are one shingle.
    """
    out, top = [], np.uint64(int(fraction * 2**64) - 1)
    for at, n in runs(texts):
        found = Words(texts.slice(at, n), LOWER)
        every = window_hashes(found.hash, words)
        for a, b in zip(found.offsets.tolist(), found.offsets[1:].tolist()):
            h = every[a : b - words + 1] if b - a >= words else shingle_hashes(found.hash[a:b], words)
            kept, depth = np.unique(h[h <= top]), 0
            if len(kept) <= small:
                h = np.unique(h)
                for depth in range(deepest(fraction), -1, -1):
                    kept = below(h, fraction, depth)
                    if len(kept) <= small:
                        break
            out.append((kept, depth))
    return out


def sketches(texts: pa.Array, fraction: float = FRACTION, words: int = WORDS) -> list[np.ndarray]:
    """The hashes of scaled_sketches."""
    return [h for h, _ in scaled_sketches(texts, fraction, words)]


def pack(hashes: np.ndarray, depth: int = 0) -> str:
    return base64.b64encode(hashes.astype("<u8").tobytes() + bytes(depth)).decode()


def unpack(fingerprint: str) -> np.ndarray:
    raw = base64.b64decode(fingerprint)
    return np.frombuffer(raw[: len(raw) - len(raw) % 8], "<u8")


def depth_of(fingerprint: str) -> int:
    return len(base64.b64decode(fingerprint)) % 8


def merge(fingerprints: list[str], fraction: float = FRACTION) -> str:
    """The fingerprint of the documents' shingles together, with the fewest doublings of all."""
    if not fingerprints:
        return ""
    depth = min(map(depth_of, fingerprints))
    return pack(np.unique(np.concatenate([below(unpack(x), fraction, depth) for x in fingerprints])), depth)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """The share of a's shingles that b has, of sketches below one threshold; 0 if a has none there, but 1 between
    equal sketches."""
    if len(a) == len(b) and (a == b).all():
        return 1.0
    return len(np.intersect1d(a, b, assume_unique=True)) / len(a) if len(a) else 0.0


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Containment of the smaller in the larger: 0 to 1, whichever comes first."""
    return containment(a, b) if len(a) <= len(b) else containment(b, a)


def text_likeness(one: str, a: tuple[np.ndarray, int], two: str, b: tuple[np.ndarray, int], fraction: float, words: int) -> float:
    """likeness of two texts by their sketches; by all their shingles, if one keeps all of its own and the other not."""
    if a[1] == b[1]:
        return likeness(a[0], b[0])
    if max(a[1], b[1]) == deepest(fraction):
        (x, _), (y, _) = scaled_sketches(pa.array([one, two], pa.large_string()), 1.0, words)
        return likeness(x, y)
    depth = min(a[1], b[1])
    return likeness(below(a[0], fraction, depth), below(b[0], fraction, depth))


def edit(text: str, following: str) -> str:
    """The last half of text replaced by as many of the first characters of what follows."""
    k = len(text) // 2
    return text[: len(text) - k] + following[:k]


def neighbours(docs: DataFrame, order: str, *, ranges: int | None = None) -> DataFrame:
    """docs dealt to ranges of ascending `order` (long), each range whole in one partition and sorted.

    Adds _range and _guest: the first document of a range is also the last of the range before (of the last range, for
    the very first document), as a guest, so that each range knows its successor. Range limits are values in the
    data, at most `ranges`, from Spark's quantile summary. Null goes first; ties go by text.
    """
    spark = docs.sparkSession
    n = ranges or 4 * width(spark)
    keyed = docs.withColumn("_order", F.coalesce(F.col(order), F.lit(-(1 << 63))))
    found = keyed.agg(F.min("_order").alias("least"), F.percentile_approx("_order", [i / n for i in range(1, n)] or [0.5], 10 * n).alias("q")).first()
    limits = sorted({found["least"], *(found["q"] or [])} - {None})
    last = len(limits) - 1
    array = np.array(limits, np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.asarray(batch.column(batch.schema.get_field_index("_order")))
            at = np.searchsorted(array, keys, side="right") - 1
            first = np.flatnonzero(array[at] == keys)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32)), pa.array(np.zeros(len(at), bool))], [*batch.schema.names, "_range", "_guest"])
            if len(first):
                guests = batch.take(pa.array(first))
                before = np.where(at[first] == 0, last, at[first] - 1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*guests.columns, pa.array(before), pa.array(np.ones(len(first), bool))], [*batch.schema.names, "_range", "_guest"])

    schema = T.StructType([*keyed.schema.fields, T.StructField("_range", T.IntegerType()), T.StructField("_guest", T.BooleanType())])
    return keyed.mapInArrow(deal, schema).repartition(width(spark), "_range").sortWithinPartitions("_range", "_guest", "_order", "text")


def edited_fingerprints(docs: DataFrame, fraction: float = FRACTION, words: int = WORDS) -> DataFrame:
    """Each document's fingerprint, that of its edited text (see edit) and their likeness, also to the next document.

    docs has doc_id and text; other columns are dropped. The next document is the next by (doc_id, text), null ids
    first; after the last comes the first (a single document follows itself). Null texts are empty. Repeated rows
    follow each other. No documents give no rows.
    """
    dealt = neighbours(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")), "doc_id")
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row of what came before, with its sketch; a guest ends its range
        for batch in batches:
            for at, n in runs(batch.column(1)):
                some = batch.slice(at, n)
                rows = [*([held] if held else []), *zip(*(c.to_pylist() for c in some.columns), scaled_sketches(some.column(1), fraction, words))]
                held = rows[-1]
                pairs = [(x, y) for x, y in zip(rows, rows[1:]) if x[2] == y[2] and not x[3]]
                changed = [edit(x[1], y[1]) for x, y in pairs]
                after = scaled_sketches(pa.array(changed, pa.large_string()), fraction, words)
                out = [(x[0], len(x[1]), hashlib.sha256(c.encode()).hexdigest(), pack(*x[4]), pack(*z), text_likeness(x[1], x[4], c, z, fraction, words), text_likeness(x[1], x[4], y[1], y[4], fraction, words)) for (x, y), c, z in zip(pairs, changed, after)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    return dealt.select("doc_id", "text", "_range", "_guest").mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op3_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' fingerprints and those of their edited texts."""
    return edited_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
