"""Fuzzy line dedup: one occurrence of each group of near equal lines stays in the corpus.

Lines are normalised (lower case, words and numbers only, digits as 0) and their runs of three words are put in one
order for all lines, rare ones first. Lines within the edit similarity share so many runs that they share one among the
first of each (prefix filter, no such pair is lost): lines meet on these, and what meets is verified by the edit
similarity of the word sequences. Verified lines form groups by chains; the first occurrence of a group, by
(doc_id, row, line), stays and the others go. A SimHash of lines doesn't take part: one word of six or ten changes a
fifth of its bits, far more than blocks of a pigeonhole search allow (README).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BASE, Words, byte_table, bytes_array, discard, free_names, growing, materialise, mix, runs, width
from .graph import components
from .groups import BUCKET, PICKED, Judge, code_arrays, linked, most_edits
from .postings import COLUMNS, PART_POSTINGS, key_counts, packed_rows, picker, piece_numbers

SIMILARITY, MIN_WORDS = 0.8, 5
#: Bytes that end words: ASCII but for letters and digits.
MARKS = bytes(b for b in range(128) if not chr(b).isalnum())
NORMAL = byte_table(MARKS, lower=True, digits=True)
#: Characters of scripts without spaces: each is a word.
UNSPACED = r"([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}])"
#: Values, at most, of the table that tells which runs of words are common. It sets their order, and how common
#: ones are dealt, only.
RANKS = 1 << 24


def spaced(texts: pa.Array) -> pa.Array:
    """texts with spaces around each character of a script without spaces."""
    raw = texts.cast(pa.large_binary()).buffers()[2]
    if raw is None or not (np.frombuffer(raw, np.uint8) >= 0xE0).any():
        return texts
    return pc.replace_substring_regex(texts, UNSPACED, r" \1 ")


def wordless_lines(texts: pa.Array) -> tuple[list[int], list[int], list[int]]:
    """(text, line, hash) of the lines that aren't blank and have no words, as a rule of signs."""
    text, number, h = [], [], []
    some = pc.fill_null(pc.match_substring_regex(texts, r"(?m)^[[:^alnum:]]*[[:punct:]][[:^alnum:]]*$"), False)
    for i in np.flatnonzero(np.asarray(some)).tolist():
        for j, line in enumerate(texts[i].as_py().split("\n")):
            bare = line.encode().strip()
            if bare and not bare.translate(None, MARKS):
                text.append(i)
                number.append(j)
                h.append(xxhash.xxh64_intdigest(bare, 7))
    return text, number, h


def line_features(texts: pa.Array, min_words: int) -> tuple[np.ndarray, ...]:
    """(text, line, hash, words' codes, their offsets) of all lines of min_words words or more.

    Words are runs of letters, digits and non-ASCII characters; A-Z and Latin-1 letters are lowered and digits are 0.
    A line's hash stands for its word sequence: lines with the same 64 bits count as equal.
    """
    words = Words(texts, NORMAL, MARKS, split=10, fold=True)
    count = np.diff(words.offsets)
    line = np.flatnonzero(count >= min_words)
    text = np.searchsorted(words.text_bounds, words.bounds[line], side="right") - 1
    first, n = words.offsets[line], count[line]
    ends = np.cumsum(n)
    place = np.arange(ends[-1] if len(n) else 0) - np.repeat(ends - n, n)
    h = words.hash[np.repeat(first, n) + place]
    if not len(h):
        return text, line, np.empty(0, np.uint64), np.empty(0, np.uint16), np.zeros(1, np.int64)
    cuts = ends - n
    ordered = mix(h ^ mix((place.astype(np.uint64) + np.uint64(1)) * np.uint64(BASE)))
    whole = mix(np.bitwise_xor.reduceat(ordered, cuts) + n.astype(np.uint64))
    number = line - np.searchsorted(words.bounds, words.text_bounds[text], side="left")
    return text, number, whole, (h >> np.uint64(24)).astype(np.uint16), np.r_[0, ends]


def line_table(docs: DataFrame, min_words: int, short: bool) -> DataFrame:
    """docs (_row, doc_id, text) to their lines: _row, doc_id, line, h, codes (16 bits a word).

    Lines of fewer than min_words words are there if short is set, with no codes; blank lines never are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in runs(batch.column(2)):
                some = batch.slice(at, n)
                text, line, h, codes, offsets = line_features(spaced(some.column(2)), 1 if short else min_words)
                length = np.diff(offsets)
                long = length >= min_words
                codes, offsets = codes[np.repeat(long, length)], np.r_[0, np.cumsum(np.where(long, length, 0))]
                if short:
                    more_text, more_line, more_h = wordless_lines(some.column(2))
                    text, line, h = np.r_[text, np.array(more_text, np.int64)], np.r_[line, np.array(more_line, np.int64)], np.r_[h, np.array(more_h, np.uint64)]
                    offsets = np.r_[offsets, np.full(len(more_h), offsets[-1])]
                place = pa.array(text)
                yield pa.RecordBatch.from_arrays([some.column(0).take(place), some.column(1).take(place), pa.array(line.astype(np.int32)), pa.array(h.view(np.int64)), bytes_array(codes, offsets)], ["_row", "doc_id", "line", "h", "codes"])

    return docs.select("_row", "doc_id", "text").mapInArrow(run, "_row long, doc_id long, line int, h long, codes binary")


def common_runs(n: np.ndarray, run: int, similarity: float) -> np.ndarray:
    """How many runs of so many words a line of n words has in common with any shorter one within the similarity: an
    edit takes as many runs at most as a run has words."""
    return n - run + 1 - run * most_edits(n, similarity)


def shortest(similarity: float) -> int:
    """The least length from which on lines always have a run of three words in common."""
    n = np.arange(1, 400)
    return int(n[common_runs(n, 3, similarity) < 1].max(initial=0)) + 1


def prefix_length(n: int, run: int, similarity: float) -> int:
    """How many first runs of a line of n words hold one that is also among the first of any line within the
    similarity, of n words or more. Runs of three words serve where the longer line has `shortest` words or more, runs
    of two below."""
    edge = shortest(similarity)
    most = int(n / similarity + 1e-9)
    longer = np.arange(n, min(most, edge - 1) + 1) if run == 2 else np.arange(max(n, edge), most + 1)
    return int(n - run + 1 - max(1, common_runs(longer, run, similarity).min()) + 1) if len(longer) else 0


def word_runs(codes: np.ndarray, offsets: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, 40 bits) of the runs of so many words. Runs with the same bits count as equal."""
    row = np.repeat(np.arange(len(offsets) - 1, dtype=np.uint64), np.diff(offsets))
    inside = np.flatnonzero(row[run - 1 :] == row[: len(row) - run + 1])
    wide = codes.astype(np.uint64)
    whole = np.full(len(inside), run, np.uint64)
    for k in range(run):
        whole = (whole << np.uint64(16)) + wide[inside + k]
    return row[inside], mix(whole) >> np.uint64(24)


def run_counts(lines: DataFrame, pairs: int) -> np.ndarray:
    """How common runs of words are by their low bits (see key_counts), for at most RANKS values."""

    def hashes(codes: pa.Array) -> Iterator[np.ndarray]:
        for at in range(0, len(codes), 4096):
            yield word_runs(*code_arrays(codes.slice(at, 4096)), 3)[1]

    return key_counts(lines.select("codes"), hashes, 1 << min(max((pairs // 2).bit_length(), 20), RANKS.bit_length() - 1))


def rare_runs(codes: np.ndarray, offsets: np.ndarray, common: np.ndarray, similarity: float) -> tuple[np.ndarray, ...]:
    """(row, key, how common) of each row's first runs of words, rare ones first. At most 4096 rows."""
    n, edge, out = np.diff(offsets), shortest(similarity), []
    sizes, which = np.unique(n, return_inverse=True)
    for run in (2, 3):
        first = np.array([prefix_length(x, run, similarity) for x in sizes.tolist()], np.int64)[which]
        if not (first > 0).any():
            continue
        row, pair = word_runs(codes, offsets, run)
        if run == 2:  # short lines only
            short = np.flatnonzero(n[row.astype(np.int64)] < edge)
            row, pair = row[short], pair[short]
        rank = common[pair & np.uint64(len(common) - 1)].astype(np.uint64)
        # one number each: row, rank and run, as bits
        value = np.sort((row << np.uint64(52)) | (rank << np.uint64(40)) | pair)
        row = (value >> np.uint64(52)).astype(np.int64)
        # a run's repeats in a line are told apart by number
        new = np.flatnonzero(np.r_[True, value[1:] != value[:-1]][: len(value)])
        nth = np.arange(len(value)) - np.repeat(new, np.diff(np.r_[new, len(value)]))
        kept = np.flatnonzero(np.arange(len(row)) - np.searchsorted(row, np.arange(len(n)))[row] < first[row])
        value = value[kept]
        key = mix((value & np.uint64((1 << 40) - 1)) + nth[kept].astype(np.uint64) * np.uint64(BASE))
        out.append((row[kept], key, (value >> np.uint64(40)).astype(np.uint8)))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint8))


def parities(codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """512 parities of each row's codes, as eight integers: an edit changes two of them at most."""
    place = (mix(codes.astype(np.uint64) + np.uint64(9)) % np.uint64(512)).astype(np.int64)
    out = np.empty((len(offsets) - 1, 8), np.uint64)
    for at in range(0, len(out), 1024):
        ends = offsets[at : at + 1025]
        row = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        found = np.bincount(row * 512 + place[ends[0] : ends[-1]], minlength=(len(ends) - 1) * 512)
        out[at : at + 1024] = np.packbits((found & 1).astype(np.uint8), bitorder="little").view(np.uint64).reshape(-1, 8)
    return np.ascontiguousarray(out.T)


def signs_of(codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """64 parities of each row's codes, one at least, as an integer: an edit changes two of them at most."""
    bit = np.uint64(1) << (mix(codes.astype(np.uint64) + np.uint64(9)) % np.uint64(64))
    return np.bitwise_xor.reduceat(bit, offsets[:-1]) if len(codes) else np.empty(0, np.uint64)


def word_counts(codes: np.ndarray, offsets: np.ndarray, buckets: int = 256) -> np.ndarray:
    """How many of each row's codes are in each of some buckets, up to 255: a row each."""
    place = (mix(codes.astype(np.uint64) + np.uint64(9)) % np.uint64(buckets)).astype(np.int64)
    out = np.empty((len(offsets) - 1, buckets), np.uint8)
    for at in range(0, len(out), 1024):
        ends = offsets[at : at + 1025]
        row = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        found = np.bincount(row * buckets + place[ends[0] : ends[-1]], minlength=(len(ends) - 1) * buckets)
        out[at : at + 1024] = np.minimum(found, 255).reshape(-1, buckets)
    return out


def unshared(counts: np.ndarray, a: np.ndarray, b: np.ndarray, together: int = 4096) -> np.ndarray:
    """No more than the edits between rows a[i] and b[i]: an edit adds one word at most to what either row has that the
    other lacks."""
    out = np.zeros(len(a), np.int64)
    for at in range(0, len(a), together):
        one, two = counts[a[at : at + together]], counts[b[at : at + together]]
        both = np.minimum(one, two).sum(axis=1, dtype=np.int64)
        out[at : at + together] = np.maximum(one.sum(axis=1, dtype=np.int64), two.sum(axis=1, dtype=np.int64)) - both
    return out


def postings(lines: DataFrame, pairs: int, parts: int, similarity: float, per_piece: int) -> DataFrame:
    """lines (id, codes) to the packed rows of their rare runs of words."""
    common = run_counts(lines, pairs)
    pieces = piece_numbers(pairs / len(common), per_piece)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                some = batch.slice(at, 4096)
                codes, offsets = code_arrays(some.column(1))
                yield packed_rows(np.asarray(some.column(0)), np.diff(offsets), *rare_runs(codes, offsets, common, similarity), parts, pieces, signs_of(codes, offsets))

    return lines.select("id", "codes").mapInArrow(run, COLUMNS)


def replaced(codes: np.ndarray, offsets: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many places of rows a[i] and b[i] differ, if these are of one length; else more than any row has."""
    n = np.diff(offsets)
    out = np.full(len(a), 1 << 60, np.int64)
    same = np.flatnonzero(n[a] == n[b])
    length = n[a[same]]
    pair = np.repeat(np.arange(len(same)), length)
    place = np.arange(len(pair)) - np.repeat(np.cumsum(length) - length, length)
    differs = codes[offsets[a[same]][pair] + place] != codes[offsets[b[same]][pair] + place]
    out[same] = np.bincount(pair[differs], minlength=len(same))
    return out


def one_pair_edits(a: np.ndarray, b: np.ndarray) -> int:
    """The edits between two rows of codes: bit vectors, a word of the longer at a time."""
    n = min(len(a), len(b))
    same = a[:n] == b[:n]
    first = n if same.all() else int(same.argmin())
    a, b, n = a[first:], b[first:], n - first
    same = a[len(a) - n :][::-1] == b[len(b) - n :][::-1]
    last = n if same.all() else int(same.argmin())
    a, b = a[: len(a) - last].tolist(), b[: len(b) - last].tolist()
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return len(b)
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    top, full = 1 << (len(a) - 1), (1 << len(a)) - 1
    plus, minus, n = full, 0, len(a)
    for x in b:
        eq = where.get(x, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        up, down = minus | ~(xh | plus) & full, plus & xh
        n += bool(up & top) - bool(down & top)
        up, down = (up << 1 | 1) & full, down << 1 & full
        plus, minus = down | ~(xv | up) & full, up & xv
    return n


def pair_edits(codes: np.ndarray, offsets: np.ndarray, a: np.ndarray, b: np.ndarray, together: int = 4096) -> np.ndarray:
    """The edits between rows a[i] and b[i]: many pairs of a like length side by side, as vectors of 64 words each; few
    pairs, and rows of over 512 words, one by one."""
    n = np.diff(offsets)
    short, long = np.where(n[a] <= n[b], a, b), np.where(n[a] <= n[b], b, a)
    out = np.zeros(len(a), np.int64)
    one = np.uint64(1)
    parts = np.maximum(1, -(-n[short] // 64))
    order = np.lexsort((n[long], parts))
    edge = np.flatnonzero(np.r_[True, np.diff(parts[order]) > 0, True]) if len(a) else np.zeros(1, np.int64)
    chunks = [order[at : min(at + together, y)] for x, y in zip(edge, edge[1:]) for at in range(x, y, together)]
    for now in chunks:
        m, steps = n[short[now]], n[long[now]]
        limbs = int(parts[now[0]])
        if limbs > 8 or len(now) < 25 * limbs:
            for i in now.tolist():
                out[i] = one_pair_edits(codes[offsets[a[i]] : offsets[a[i] + 1]], codes[offsets[b[i]] : offsets[b[i] + 1]])
            continue

        def words(rows: np.ndarray, width: int, absent: int) -> np.ndarray:
            place = np.arange(width)
            found = codes[np.minimum(offsets[rows][:, None] + place, len(codes) - 1)].astype(np.int32)
            return np.where(place < n[rows][:, None], found, absent)

        pattern, text = words(short[now], 64 * limbs, -1), words(long[now], int(steps.max()), -2)
        plus = np.full((limbs, len(now)), ~np.uint64(0))
        minus = np.zeros((limbs, len(now)), np.uint64)
        last, bit, edits = (np.maximum(m, 1) - 1) // 64, (np.maximum(m, 1) - 1).astype(np.uint64) % np.uint64(64), m.copy()
        for t in range(text.shape[1]):
            equal = np.packbits(pattern == text[:, t, None], axis=1, bitorder="little").view(np.uint64)
            up, down = np.ones(len(now), np.uint64), np.zeros(len(now), np.uint64)  # what comes from the limb below
            for k in range(limbs):
                pv, mv, eq = plus[k], minus[k], equal[:, k]
                xv = eq | mv
                eq = eq | down
                xh = (((eq & pv) + pv) ^ pv) | eq
                ph, mh = mv | ~(xh | pv), pv & xh
                here = (last == k) & (t < steps)
                edits += np.where(here, ((ph >> bit) & one).astype(np.int64) - ((mh >> bit) & one).astype(np.int64), 0)
                next_up, next_down = ph >> np.uint64(63), mh >> np.uint64(63)
                ph, mh = (ph << one) | up, (mh << one) | down
                plus[k], minus[k] = mh | ~(xv | ph), ph & xv
                up, down = next_up, next_down
        out[now] = np.where(m > 0, edits, steps)
    return out


def similar_lines(lines: DataFrame, similarity: float = SIMILARITY, bucket: int = BUCKET, per_part: int = PART_POSTINGS) -> DataFrame:
    """lines (id, h, codes of 16 bits, five words at least; one row a distinct line; a written table) to links (a, b)
    of lines h that connect all that chains of pairs of at least this edit similarity (0.7 or more) connect."""

    def judge(column: pa.Array) -> Judge:
        codes, offsets = code_arrays(column)
        n = np.diff(offsets)
        most, counts = most_edits(n, similarity), []

        def glance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            # words replaced in place are edits: few of them tell that a pair is near
            out = (replaced(codes, offsets, a, b) <= most[a]).astype(np.int8)
            rest = np.flatnonzero(out == 0)
            if len(rest):
                # and words that differ too much that it isn't
                counts[:] = counts or [word_counts(codes, offsets)]
                out[rest] -= unshared(counts[0], a[rest], b[rest]) > np.maximum(most[a[rest]], most[b[rest]])
            return out

        def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            return pair_edits(codes, offsets, a, b) <= np.maximum(most[a], most[b])

        return n, parities(codes, offsets), glance, near

    pairs = (lines.agg(F.sum(F.length("codes")).alias("n")).first()["n"] or 0) // 2
    parts = max(width(lines.sparkSession), int(pairs * 3 * (1 - similarity) / per_part) + 1)
    dealt = postings(lines, pairs, parts, similarity, per_part).repartition(parts, "part").sortWithinPartitions("part")
    picked = materialise(dealt.mapInArrow(picker(parts, similarity, bucket), PICKED), "blocks")
    return linked(picked, lines, similarity, bucket, judge)


def dedup_lines(docs: DataFrame, similarity: float = SIMILARITY, min_words: int = MIN_WORDS, short: bool = False) -> DataFrame:
    """docs with the lines removed that repeat, exactly or nearly, a line that comes earlier by (doc_id, row, line).

    Lines end at line feeds. Blank lines always stay; lines of fewer than min_words words (5 or more) are compared
    exactly if short is set, and stay otherwise. A character of a script without spaces is a word. Returns docs' columns with text replaced, and n_lines and n_removed (long). A null text stays null with no lines, an empty text is one blank
    line; a document of which every line goes keeps its row with an empty text; a null doc_id comes first; a repeated
    row comes after the first. No rows give none. docs is read twice and must give the same rows in the same order,
    as files do; columns n_lines and n_removed are replaced, others of any name stay.
    """
    row, lost = free_names(docs.columns, "row", "lost")
    numbered = docs.drop("n_lines", "n_removed").withColumn(row, F.monotonically_increasing_id())
    whole = materialise(line_table(numbered.select(F.col(row).alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), "text"), min_words, short), "lines")
    distinct = whole.groupBy("h").agg(F.min("codes").alias("codes"), F.min(F.struct("doc_id", "_row", "line")).alias("at"), F.count(F.lit(1)).alias("uses"))
    distinct = materialise(distinct.withColumn("id", F.monotonically_increasing_id()), "distinct")
    lines = materialise(whole.drop("codes"), "places")
    discard(whole)
    groups = components(similar_lines(distinct.where("length(codes) > 0").select("id", "h", "codes"), similarity)).select(F.col("node").alias("h"), "component")
    named = materialise(distinct.join(growing(groups), "h", "left").select("h", "at", "uses", F.coalesce("component", "h").alias("component")), "named")
    discard(distinct)
    kept = named.groupBy("component").agg(F.min("at").alias("keep"), F.sum("uses").alias("total")).where("total > 1")
    by_line = named.join(growing(kept), "component").select("h", "keep")
    gone = lines.select("_row", "doc_id", "line", "h").join(growing(by_line), "h").where(~F.struct("doc_id", "_row", "line").eqNullSafe(F.col("keep")))
    by_row = gone.groupBy(F.col("_row").alias(row)).agg(F.collect_set("line").alias(lost))
    split = F.split("text", "\n", -1)
    left = F.filter(split, lambda x, i: ~F.array_contains(lost, i))
    out = numbered.join(growing(by_row), row, "left").drop(row)
    removed = F.coalesce(F.size(lost), F.lit(0)).cast("long")
    return out.withColumn("n_lines", F.when(F.col("text").isNull(), 0).otherwise(F.size(split)).cast("long")).withColumn("n_removed", F.when(F.col(lost).isNull(), 0).otherwise(removed).cast("long")).withColumn("text", F.when(F.col(lost).isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))).drop(lost)


def op6_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without repeated lines: doc_id, n_lines, n_removed, kept_sha256 (of the text that stays)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs, short=True).select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
