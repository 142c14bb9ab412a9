"""Near copies of whole documents: SimHashes, the generalised pigeonhole search and a prefix filter on shingles find
candidates, all shingles decide.

Every text has a SimHash of its shingles, and the pigeonhole search of `simhash` groups those within two bits. A text's
SimHash moves by about ten bits at a Jaccard similarity of 0.8, though, more than that search can allow. So texts' word
shingles are also put in one order for all texts, rare ones first: texts within the similarity share so many that they
share one among the first of each (prefix filter, no such pair is lost). Documents meet in the search's groups and on
these, and all that meet are compared by all their shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, Words, byte_table, bytes_array, growing, materialise, mix, runs, shingle_hashes, width, window_hashes
from .graph import components
from .groups import BUCKET, PICKED, Judge, linked, picked_groups
from .lines import parities
from .postings import COLUMNS, COUNTED, PART_POSTINGS, key_counts, packed_rows, picker, piece_numbers
from .simhash import fingerprint_links, fingerprints, whole_groups

WORDS, SIMILARITY = 5, 0.8
#: Bits between fingerprints of whole texts that are compared.
RADIUS = 2
#: Documents with a like SimHash that are compared in one task before they are dealt by number.
PIECE = 100_000
#: Values of the table that tells which shingles are common. It sets their order, and how common ones are dealt, only.
RANKS = 1 << 22
#: Bits of a shingle's hash by which texts meet; texts whose shingles are packed together, about.
KEY_BITS, TOGETHER = 44, 2048
LOWER = byte_table(SPACES, lower=True)


def shingle_keys(texts: pa.Array, words: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, count, text among these, hash of KEY_BITS bits) of the word shingles, repeats included, of runs of
    up to 4096 texts. Fewer words than a shingle are one; no words have none."""
    for first, many in runs(texts):
        for at in range(first, first + many, 4096):
            n = min(4096, first + many - at)
            found = Words(texts.slice(at, n), LOWER)
            count = np.diff(found.offsets)
            short = np.flatnonzero((count > 0) & (count < words))
            text = np.repeat(np.arange(n), count)
            inside = np.flatnonzero(text[words - 1 :] == text[: max(0, len(text) - words + 1)])
            some = [shingle_hashes(found.hash[found.offsets[i] : found.offsets[i + 1]], words) for i in short.tolist()]
            h = np.concatenate([window_hashes(found.hash, words)[inside], *some])
            yield at, n, np.r_[text[inside], short], h & np.uint64((1 << KEY_BITS) - 1)


def prefix_length(n: np.ndarray, similarity: float) -> np.ndarray:
    """How many first shingles of a text of n distinct ones hold one that is also among the first of any text within
    the similarity: both have at least that share of either's shingles in common."""
    return n - np.ceil(similarity * n - 1e-9).astype(np.int64) + 1


def rare_shingles(n: int, text: np.ndarray, h: np.ndarray, common: np.ndarray, similarity: float, keys: int | None) -> tuple[np.ndarray, ...]:
    """(distinct shingles of each of n texts; text, key, how common) of each text's first shingles, rare ones first."""
    rank = common[(h & np.uint64(len(common) - 1)).astype(np.int64)].astype(np.uint64)
    # one number each: text, rank and hash, as bits
    value = np.sort((text.astype(np.uint64) << np.uint64(KEY_BITS + 8)) | (rank << np.uint64(KEY_BITS)) | h)
    value = value[np.r_[True, value[1:] != value[:-1]][: len(value)]]
    text = (value >> np.uint64(KEY_BITS + 8)).astype(np.int64)
    size = np.bincount(text, minlength=n)
    first = prefix_length(size, similarity) if keys is None else np.minimum(prefix_length(size, similarity), keys)
    kept = np.flatnonzero(np.arange(len(text)) - (np.cumsum(size) - size)[text] < first[text])
    value = value[kept]
    return size, text[kept], mix(value & np.uint64((1 << KEY_BITS) - 1)), (value >> np.uint64(KEY_BITS)).astype(np.uint8)


def shingle_groups(docs: DataFrame, words: int, similarity: float, keys: int | None, bucket: int, per_part: int) -> DataFrame:
    """docs (id, text) to what meets on the documents' rare shingles, as PICKED."""
    docs = docs.select("id", "text")
    common = key_counts(docs.select("text"), lambda texts: (h for *_, h in shingle_keys(texts, words)), RANKS)
    total = float(COUNTED[common[common > 0]].sum())  # of all shingles, about
    pieces = piece_numbers(total / RANKS, per_part)
    parts = max(width(docs.sparkSession), int(total * (1 - similarity) / per_part) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, rare = np.asarray(batch.column(0)), np.zeros(batch.num_rows, np.int64), []
            begun = 0
            for at, n, text, h in shingle_keys(batch.column(1), words):
                sizes[at : at + n], text, *more = rare_shingles(n, text, h, common, similarity, keys)
                rare.append((text + at, *more))
                if at + n - begun >= TOGETHER or at + n == batch.num_rows:
                    yield packed_rows(ids, sizes, *(np.concatenate(x) for x in zip(*rare)), parts, pieces)
                    begun, rare = at + n, []

    dealt = docs.mapInArrow(run, COLUMNS).repartition(parts, "part").sortWithinPartitions("part")
    return dealt.mapInArrow(picker(parts, similarity, bucket), PICKED)


def shingle_sets(docs: DataFrame, words: int) -> DataFrame:
    """docs (id, text) to id, h (the id) and codes: the distinct hashes of its word shingles, 32 bits each, ascending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in runs(batch.column(1)):
                found = Words(batch.column(1).slice(at, n), LOWER)
                sets = [np.unique((shingle_hashes(found.hash[a:b], words) >> np.uint64(32)).astype(np.uint32)) for a, b in zip(found.offsets, found.offsets[1:])]
                ids = batch.column(0).slice(at, n)
                yield pa.RecordBatch.from_arrays([ids, ids, bytes_array(np.concatenate(sets), np.cumsum([0, *map(len, sets)]))], ["id", "h", "codes"])

    return docs.select("id", "text").mapInArrow(run, "id long, h long, codes binary")


def pigeonhole_groups(docs: DataFrame, words: int, radius: int = RADIUS) -> DataFrame:
    """docs (id, text) to (id, uses, block): the documents whose SimHash has a chain of steps of at most radius bits to
    another document's, with their group's size and hash."""
    each = materialise(fingerprints(docs.select(F.col("id").alias("doc_id"), "text"), words), "fingerprints")
    nodes = materialise(each.groupBy("fp").agg(F.count(F.lit(1)).alias("n")), "nodes")
    chains = components(fingerprint_links(nodes, radius)).select(F.col("node").alias("fp"), "component")
    named = materialise(nodes.join(growing(chains), "fp", "left").withColumn("component", F.coalesce("component", "fp")), "named")
    sizes = named.groupBy("component").agg(F.sum("n").alias("uses")).where("uses > 1")
    by_fp = named.join(growing(sizes), "component").select("fp", "uses", F.xxhash64("component", F.lit("whole")).alias("block"))
    return each.join(growing(by_fp), "fp").select(F.col("doc_id").alias("id"), "uses", "block")


def near_copies(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, keys: int | None = None, bucket: int = BUCKET, piece: int = PIECE, per_part: int = PART_POSTINGS) -> DataFrame:
    """docs (id long, unique, not null; text; read four times) to (id, component): each document that has a copy, exact or of
    at least this Jaccard similarity of word shingles, with the least id that chains of such copies connect it to.

    A-Z count as a-z and words end at ASCII white space; fewer words than a shingle are one shingle; texts without
    words, null ones too, are copies of each other. Other columns are ignored; no rows give none. All similar pairs
    are connected, but for hashes. keys, if given: documents meet on at most so many of their shingles, so similar pairs
    may be missed; 0: by the search for like SimHashes alone.
    """

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "part"):
            part, block, ids, hot = (np.asarray(table[c]) for c in ("part", "block", "id", "hot"))
            first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            count = np.diff(np.r_[first, len(part)])
            size = np.repeat(count, count)
            size[hot] = bucket + 1
            kept = np.flatnonzero(size > 1)
            yield from picked_groups(block[kept], ids[kept], np.zeros(len(kept), np.int64), size[kept], similarity, bucket)

    def judge(column: pa.Array) -> Judge:
        sets = [np.frombuffer(x.as_buffer(), np.uint32) for x in column]
        n, bits = np.array([len(x) for x in sets], np.int64), []

        def glance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            # a shingle that only one has changes one parity at most
            bits[:] = bits or [parities(np.concatenate([*sets, np.empty(0, np.uint32)]), np.r_[0, np.cumsum(n)])]
            apart = np.bitwise_count(bits[0][:, a] ^ bits[0][:, b]).sum(axis=0, dtype=np.int64)
            return -(apart > (1 - similarity) / (1 + similarity) * (n[a] + n[b]) + 1e-9).astype(np.int8)

        def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            common = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a.tolist(), b.tolist())], np.int64)
            return common >= similarity * (n[a] + n[b] - common) - 1e-9

        return n, None, glance, near

    met = pigeonhole_groups(docs, words)
    number = F.pmod(F.xxhash64("id"), F.ceil(F.col("uses") / piece)).cast("int")
    dealt = met.select(F.xxhash64("block", number).alias("part"), "block", "id", (F.col("uses") > piece).alias("hot"))
    picked = dealt.repartition("part").sortWithinPartitions("part", "id").mapInArrow(pick, PICKED)
    if keys != 0:
        picked = picked.union(shingle_groups(docs, words, similarity, keys, bucket, per_part))
    picked = materialise(picked, "met")
    met = picked.select("id").union(picked.where("pivot IS NOT NULL").select("pivot")).distinct()
    nodes = materialise(shingle_sets(docs.join(growing(met), "id"), words), "shingles")
    return components(linked(picked, nodes, similarity, bucket, judge)).withColumnsRenamed({"node": "id"})
