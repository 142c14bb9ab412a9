"""Token-ID output: interleaved range asymmetric numeral systems with one static table.

Documents are sorted by id and tokenised; each range partition is cut into independent blocks of whole documents.
A block's ids are dealt in turn to LANES coders that share one word stream. Every STRIDE steps the lanes' states and
the place in the stream are kept as a checkpoint, so a block's segments decode independently and side by side.
States lie in [2**31, 2**63); at most one 32-bit word moves a step. A CRC-32 of a block's ids is checked on reading.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, scratch_dir, width
from .tokens import encoder

LANES, STRIDE, SCALE, LOW = 32, 256, 20, np.uint64(1 << 31)
BLOCK_TOKENS = 65_536
#: Blocks that are coded side by side in a task: bounds its memory.
TOGETHER = 16
IDS = "part int, block int, start long, doc_ids array<long>, doc_tokens array<long>, ids binary, counts binary"
CODED = "part int, block int, start long, doc_ids array<long>, doc_tokens array<long>, n long, crc long, states binary, places binary, words binary"


def quantise(counts: np.ndarray) -> np.ndarray:
    """Frequencies that sum to 2**SCALE, at least 1 where a count isn't 0."""
    total, room = int(counts.sum()), 1 << SCALE
    seen = np.flatnonzero(counts)
    if not len(seen):
        return np.zeros(len(counts), np.int64)
    if len(seen) > room:
        raise ValueError(f"more than {room} distinct ids")
    freq = np.zeros(len(counts), np.int64)
    freq[seen] = np.maximum(1, (counts[seen].astype(np.float64) * room / total).astype(np.int64))
    while over := int(freq.sum()) - room:
        top = int(freq.argmax())
        step = over if over < 0 else min(over, max(1, (int(freq[top]) - 1) // 2))
        freq[top] -= step
    return freq


def encode_blocks(blocks: list[np.ndarray], freq: np.ndarray) -> list[tuple[bytes, bytes, bytes]]:
    """(states, places, words) of each block of ids."""
    steps = max([1, *(-(-len(b) // LANES) for b in blocks)])
    ids = np.zeros((len(blocks), steps * LANES), np.int64)
    real = np.zeros(ids.shape, bool)
    for i, b in enumerate(blocks):
        ids[i, : len(b)], real[i, : len(b)] = b, True
    start = (np.cumsum(freq) - freq).astype(np.uint64)
    # an absent place takes the whole range: it leaves a state as it is
    f = np.where(real, freq[ids], 1 << SCALE).astype(np.uint64).reshape(len(blocks), steps, LANES)
    c = np.where(real, start[ids], 0).astype(np.uint64).reshape(f.shape)
    x = np.full((len(blocks), LANES), LOW, np.uint64)
    sent, word = np.zeros(f.shape, bool), np.zeros(f.shape, np.uint32)
    kept = np.zeros((-(-steps // STRIDE), len(blocks), LANES), np.uint64)
    for t in range(steps - 1, -1, -1):
        ft = f[:, t]
        full = x >= (ft << np.uint64(63 - SCALE))
        sent[:, t], word[:, t] = full, x.astype(np.uint32)
        x = np.where(full, x >> np.uint64(32), x)
        q = x // ft
        x = (q << np.uint64(SCALE)) + (x - q * ft) + c[:, t]
        if t % STRIDE == 0:
            kept[t // STRIDE] = x
    out = []
    for i, b in enumerate(blocks):
        segments = -(-len(b) // (LANES * STRIDE))
        each = np.cumsum(sent[i].sum(axis=1))
        places = [int(each[s * STRIDE - 1]) if s else 0 for s in range(segments)]
        out.append((kept[:segments, i].tobytes(), np.array(places, np.uint32).tobytes(), word[i][sent[i]].tobytes()))
    return out


def decode_blocks(coded: list[tuple[int, bytes, bytes, bytes]], freq: np.ndarray) -> list[np.ndarray]:
    """The ids of each (n, states, places, words); all segments of all blocks go side by side."""
    sizes = np.array([len(w) // 4 for *_, w in coded], np.int64)
    base = np.cumsum(sizes) - sizes
    words = np.frombuffer(b"".join(w for *_, w in coded) + b"\0\0\0\0", np.uint32).astype(np.uint64)
    x = np.frombuffer(b"".join(s for _, s, _, _ in coded), np.uint64).reshape(-1, LANES).copy()
    counts = [len(p) // 4 for _, _, p, _ in coded]
    at = np.frombuffer(b"".join(p for _, _, p, _ in coded), np.uint32).astype(np.int64) + np.repeat(base, counts)
    symbol = np.repeat(np.arange(len(freq), dtype=np.uint16 if len(freq) <= 1 << 16 else np.uint32), freq)
    start, f = (np.cumsum(freq) - freq).astype(np.uint64), freq.astype(np.uint64)
    out = np.zeros((len(x), STRIDE, LANES), np.uint32)
    longest = max([0, *(n for n, *_ in coded)])
    for t in range(min(STRIDE, -(-longest // LANES))):
        slot = x & np.uint64((1 << SCALE) - 1)
        s = symbol[slot]
        x = f[s] * (x >> np.uint64(SCALE)) + slot - start[s]
        short = x < LOW
        nth = np.cumsum(short, axis=1)
        place = np.minimum(at[:, None] + nth - 1, len(words) - 1)
        x = np.where(short, (x << np.uint64(32)) | words[place], x)
        at += nth[:, -1]
        out[:, t] = s
    first = np.cumsum(counts) - counts
    return [out[a : a + k].reshape(-1)[:n] for (n, *_), a, k in zip(coded, first, counts)]


def token_blocks(docs: DataFrame, tokenizer: str, end_id: int, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Blocks of token ids of whole documents, in ascending (doc_id, text) order of parts and blocks. Written once.

    A part's last block has the counts of all its ids (64-bit integers, by id).
    """
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
        .withColumn("row", F.monotonically_increasing_id())
        .repartitionByRange(width(docs.sparkSession), "doc_id", "row")
        .sortWithinPartitions("doc_id", "text", "row")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        part, block, start, held = TaskContext.get().partitionId(), 0, 0, 0
        end = np.array([end_id], encode.code)
        counts = np.zeros(max(encode.size, end_id + 1), np.int64)
        ids: list[np.ndarray] = []
        lengths: list[int] = []
        docs: list[int | None] = []

        def row(last: bool = False) -> pa.RecordBatch:
            columns = [[part], [block], [start], [docs], [lengths], [np.concatenate([np.empty(0, encode.code), *ids]).tobytes()], [counts.tobytes() if last else None]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()))], ["part", "block", "start", "doc_ids", "doc_tokens", "ids", "counts"])

        for batch in batches:
            keys = batch.column(0).to_pylist()
            for at, flat, offsets in encode.batches(batch.column(1)):
                counts += np.bincount(flat, minlength=len(counts))
                counts[end_id] += len(offsets) - 1
                for i, (a, b) in enumerate(zip(offsets, offsets[1:])):
                    ids += (flat[a:b], end)
                    docs.append(keys[at + i])
                    lengths.append(int(b - a) + 1)
                    held += lengths[-1]
                    if held >= block_tokens:
                        yield row()
                        block, start, held, ids, lengths, docs = block + 1, start + held, 0, [], [], []
        if counts.any():
            yield row(last=True)

    return materialise(ordered.mapInArrow(run, IDS), "ids")


def count_ids(blocks: DataFrame, n_ids: int) -> np.ndarray:
    """How often each id occurs, over all blocks: a table as long as the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_ids, np.int64)
        for batch in batches:
            for x in batch.column(0):
                total += np.frombuffer(x.as_buffer(), np.int64)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["id", "n"])

    rows = blocks.select("counts").where("counts IS NOT NULL").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(n_ids, np.int64)
    for r in rows:
        counts[r["id"]] = r["n"]
    return counts


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, block_tokens: int = BLOCK_TOKENS) -> None:
    """Tokenise docs (doc_id, text) and write them to path.

    path/table holds the shared frequencies and the code's width, path/blocks the coded blocks, path/parts where each
    part starts among all ids. Documents go by ascending doc_id (null first), then text; a null text is empty, a
    repeated row is kept, no documents make an empty file that reads back as such. Other columns are not written.
    """
    spark = docs.sparkSession
    known = encoder(tokenizer)
    code, n_ids = known.code, max(known.size, end_id + 1)
    blocks = token_blocks(docs, tokenizer, end_id, block_tokens)
    freq = quantise(count_ids(blocks, n_ids))
    spark.createDataFrame([(i, int(f), code) for i, f in enumerate(freq)], "id int, freq int, code string").coalesce(1).write.parquet(f"{path}/table")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                some = batch.slice(at, TOGETHER)
                ids = [np.frombuffer(x.as_buffer(), code) for x in some.column(5)]
                coded = encode_blocks(ids, freq)
                crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]
                more = [pa.array([len(x) for x in ids], pa.int64()), pa.array(crc, pa.int64()), *(pa.array([c[k] for c in coded], pa.binary()) for k in range(3))]
                yield pa.RecordBatch.from_arrays([*some.columns[:5], *more], ["part", "block", "start", "doc_ids", "doc_tokens", "n", "crc", "states", "places", "words"])

    # the words are as good as random: another compression only costs time
    blocks.where(F.size("doc_ids") > 0).drop("counts").mapInArrow(run, CODED).write.option("compression", "zstd").parquet(f"{path}/blocks")
    sizes = spark.read.parquet(f"{path}/blocks").groupBy("part").agg(F.sum("n").alias("n"))
    # one row a part, and there are only as many parts as a shuffle has partitions
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sizes.withColumn("start", F.sum("n").over(before) - F.col("n")).coalesce(1).write.parquet(f"{path}/parts")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """What write_tokens wrote: doc_id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned
    32-bit integers). A block whose checksum differs raises ValueError."""
    table = spark.read.parquet(f"{path}/table").orderBy("id").collect()
    freq = np.array([r["freq"] for r in table], np.int64)
    parts = spark.read.parquet(f"{path}/parts").select("part", F.col("start").alias("part_start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                rows = batch.slice(at, TOGETHER).to_pylist()
                decoded = decode_blocks([(r["n"], r["states"], r["places"], r["words"]) for r in rows], freq)
                for r, ids in zip(rows, decoded):
                    raw = ids.astype("<u4").tobytes()
                    if zlib.crc32(raw) != r["crc"]:
                        raise ValueError(f"checksum of part {r['part']}, block {r['block']}")
                    ends = np.cumsum(r["doc_tokens"])
                    begins = ends - r["doc_tokens"]
                    columns = [pa.array([r["part"]] * len(ends), pa.int32()), pa.array(r["doc_ids"], pa.int64()), pa.array(begins + r["start"]), pa.array(r["doc_tokens"], pa.int64()), pa.array([raw[4 * a : 4 * b] for a, b in zip(begins, ends)], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["part", "doc_id", "in_part", "n_tokens", "ids"])

    out = spark.read.parquet(f"{path}/blocks").mapInArrow(run, "part int, doc_id long, in_part long, n_tokens long, ids binary")
    return out.join(parts, "part").select("doc_id", (F.col("part_start") + F.col("in_part")).alias("start"), "n_tokens", "ids")


def op1_rans_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded, written and read back: doc_id, start, n_tokens, ids_crc32."""
    import uuid

    import public_tokenizers

    path = f"{scratch_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
