"""SimHash near-duplicates by the generalised pigeonhole principle.

Two fingerprints of 64 bits within `radius` agree within t_i bits on some part i, whenever the parts' thresholds sum
to radius - parts + 1 (-1: the part isn't probed). Correlated bits share a part; a dynamic program gives each part its
threshold by the rows and candidates expected of it, from bit statistics over all fingerprints. A part with threshold t
is probed by the values left when t of its bits are deleted; fingerprints that share a value are compared in full.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bit_counts, growing, materialise
from .graph import components, local_labels

BITS = 64
#: Members of a probed bucket that are compared with each other; larger buckets take the exact way of bridge_links.
BUCKET = 512


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of these hashes: a bit is 1 if it is 1 in over half of them. None: zero."""
    if not len(hashes):
        return 0
    ones = bit_counts(hashes, np.zeros(1, np.int64))[0]
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """SimHash of a text's word shingles, repeats included. A-Z are lowered, words end at ASCII white space.

    Fewer words than a shingle are one shingle; no words, empty and null texts have fingerprint zero.
    """
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    k = min(words, len(found))
    line = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = [0, *ends[: len(found) - k].tolist()]
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(line[a:b], seed) for a, b in zip(starts, (ends[k - 1 :] - 1).tolist())], np.uint64))


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42) -> DataFrame:
    """docs (doc_id, text) to (doc_id, fp): a row each, fp the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(x.as_py(), words, seed) for x in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and in how many bits i and j are both 1 (64 x 64), over all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((BITS, BITS), np.int64), 0
        for batch in batches:
            fp = np.ascontiguousarray(np.asarray(batch.column(0)))
            bits = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            both += (bits.T @ bits).astype(np.int64)
            n += len(fp)
        yield pa.RecordBatch.from_arrays([pa.array([*range(BITS * BITS), -1]), pa.array([*both.ravel().tolist(), n])], ["cell", "n"])

    rows = fps.select("fp").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    cells = {r["cell"]: r["n"] for r in rows}
    return cells.get(-1, 0), np.array([cells.get(i, 0) for i in range(BITS * BITS)], np.int64).reshape(BITS, BITS)


def correlated_parts(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """All bits in parts of near equal size: each part starts with the bit least tied to those taken, and takes the
    bits most correlated with its own."""
    p = np.diag(both) / max(n, 1)
    cov = both / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    tied, free, out = np.abs(cov / np.outer(sd, sd)), set(range(BITS)), []
    for k in range(parts):
        taken = [b for part in out for b in part]
        own = [min(free, key=lambda b: (tied[b, taken].sum(), b))]
        free.remove(own[0])
        while len(own) < (BITS * (k + 1)) // parts - (BITS * k) // parts:
            own.append(max(free, key=lambda b: (tied[b, own].sum(), -b)))
            free.remove(own[-1])
        out.append(sorted(own))
    return out


def differing_bits(n: int, both: np.ndarray, part: list[int], most: int) -> np.ndarray:
    """The chances that two fingerprints differ in 0 .. most of a part's bits. Whether they differ in bits i and j is
    known for each two bits from how often these are set together; more bits follow from the tree that ties the
    part's bits most closely, each given the bit above it."""
    one = np.diag(both) / max(n, 1)
    n11 = both / max(n, 1)
    n10, n01 = one[:, None] - n11, one[None, :] - n11
    n00 = np.maximum(1 - n11 - n10 - n01, 0)
    apart = 2 * one * (1 - one)
    joint = np.empty((2, 2, BITS, BITS))  # chances that i, j differ
    joint[1, 1] = 2 * (n11 * n00 + n10 * n01)
    joint[1, 0], joint[0, 1] = apart[:, None] - joint[1, 1], apart[None, :] - joint[1, 1]
    joint[0, 0] = 1 - joint[1, 1] - joint[1, 0] - joint[0, 1]
    joint = np.maximum(joint, 0)
    alone = np.stack([1 - apart, apart])
    independent = alone[:, None, :, None] * alone[None, :, None, :]
    tie = np.where(joint > 0, joint * np.log(np.maximum(joint, 1e-300) / np.maximum(independent, 1e-300)), 0).sum((0, 1))
    above, free = [(part[0], -1)], set(part[1:])
    while free:
        b, a = max(((b, a) for b in sorted(free) for a, _ in above), key=lambda x: tie[x])
        above.append((b, a))
        free.remove(b)
    counts = {b: np.zeros((2, most + 1)) for b in part}  # given whether the bit differs: how many below and with it do
    for b in part:
        counts[b][0, 0] = 1
        if most:
            counts[b][1, 1] = 1
    for b, a in reversed(above[1:]):
        for state in (0, 1):
            chance = joint[state, :, a, b]
            given = (chance / chance.sum() if chance.sum() > 0 else alone[:, b]) @ counts[b]
            counts[a][state] = np.convolve(counts[a][state], given)[: most + 1]
    return alone[:, part[0]] @ counts[part[0]]


def part_costs(n: int, both: np.ndarray, part: list[int], radius: int) -> list[float]:
    """Expected rows and candidate pairs of a part at thresholds -1, 0 .. radius. A pair with d differing bits in the
    part meets on the probes at threshold t that leave out those d bits."""
    most = min(radius, len(part))
    differ = differing_bits(n, both, part, most)
    costs = [0.0]
    for t in range(radius + 1):
        met = sum(differ[d] * comb(len(part) - d, t - d) for d in range(min(t, most) + 1))
        costs.append(n * comb(len(part), t) + n * n / 2 * met)
    return costs


def allocate(costs: list[list[float]], total: int) -> tuple[float, list[int]]:
    """Thresholds (-1 or more) of least cost that sum to total."""
    best = {0: (0.0, [])}
    for c in costs:
        new: dict = {}
        for done, (cost, chosen) in best.items():
            for t in range(-1, len(c) - 1):
                if done + t not in new or cost + c[t + 1] < new[done + t][0]:
                    new[done + t] = (cost + c[t + 1], [*chosen, t])
        best = new
    return best[total]


def probe_masks(n: int, both: np.ndarray, radius: int, most_parts: int = 5) -> np.ndarray:
    """The bits that each probe compares exactly: the cheapest plan over the numbers of parts."""
    plans = []
    for m in range(1, most_parts + 1):
        parts = correlated_parts(n, both, m)
        cost, thresholds = allocate([part_costs(n, both, x, radius) for x in parts], radius - m + 1)
        plans.append((cost, m, parts, thresholds))
    _, _, parts, thresholds = min(plans, key=lambda x: x[:2])
    masks = []
    for part, t in zip(parts, thresholds):
        if t >= 0:
            whole = sum(1 << b for b in part)
            masks += [whole - sum(1 << b for b in gone) for gone in combinations(part, t)]
    return np.array(masks, np.uint64)


def near_pairs(fp: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j), i < j, of rows of one group within radius. Rows of a group stand together."""
    left, right, place = [], [], np.arange(len(fp))
    for shift in range(1, len(fp)):
        place = place[: np.searchsorted(place, len(fp) - shift)]
        place = place[group[place] == group[place + shift]]
        if not len(place):
            break
        near = place[np.bitwise_count(fp[place] ^ fp[place + shift]) <= radius]
        left.append(near)
        right.append(near + shift)
    return (np.concatenate(left), np.concatenate(right)) if left else (np.empty(0, np.int64),) * 2


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, rows: int = 20_000) -> Iterator[pa.Table]:
    """Tables of about this many rows, in which no group is cut. Rows of a group follow each other."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            table = pa.Table.from_batches(held).combine_chunks()
            keys = np.asarray(table[key])
            cut = np.flatnonzero(keys != keys[-1])
            if len(cut):
                yield table.slice(0, cut[-1] + 1)
                held = table.slice(cut[-1] + 1).to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def bridge_links(fps: DataFrame) -> DataFrame:
    """Links that connect whatever lies within two bits, without comparing: two such fingerprints are each within one
    bit of a common value. Each fingerprint goes to its 65 values; a value has at most 65 members, all within two bits
    of each other, and links them to the least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips = np.array([0, *(1 << b for b in range(BITS))], np.uint64)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                fp = np.asarray(batch.column(0).slice(at, 1000)).view(np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array((fp[:, None] ^ flips).ravel().view(np.int64)), pa.array(np.repeat(fp, len(flips)).view(np.int64))], ["value", "a"])

    spread = fps.mapInArrow(run, "value long, a long")
    return spread.withColumn("b", F.min("a").over(Window.partitionBy("value"))).where("a <> b").select("a", "b").distinct()


def fingerprint_links(fps: DataFrame, radius: int = 2, bucket: int = BUCKET) -> DataFrame:
    """Distinct fingerprints (fp long; a written table) to links (a, b) that connect exactly those that chains of
    steps of at most radius bits connect. A bucket sends a star for each group it finds, not its pairs.

    Buckets of over `bucket` members go to bridge_links (radius 2), or are compared in tiles of members (other radii).
    """
    n, both = bit_statistics(fps)
    masks = probe_masks(n, both, radius)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 20_000):
                fp = np.asarray(batch.column(0).slice(at, 20_000)).view(np.uint64)
                for i, mask in enumerate(masks):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), i, np.int32)), pa.array((fp & mask).view(np.int64)), pa.array(fp.view(np.int64))], ["probe", "value", "fp"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "group"):
            fp, group = (np.asarray(table[c]) for c in ("fp", "group"))
            label = local_labels(len(fp), *near_pairs(fp.view(np.uint64), group, radius))
            far = np.flatnonzero(label != np.arange(len(fp)))
            yield pa.RecordBatch.from_arrays([pa.array(fp[far]), pa.array(fp[label[far]])], ["a", "b"])

    probed = fps.select("fp").mapInArrow(probe, "probe int, value long, fp long")
    sized = probed.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("probe", "value"))).where("size > 1")
    sized = materialise(sized.withColumn("group", F.xxhash64("probe", "value")), "buckets")
    near = sized.where(F.col("size") <= bucket).repartition("group").sortWithinPartitions("group").select("group", "fp").mapInArrow(verify, "a long, b long")
    large = sized.where(F.col("size") > bucket)
    if radius == 2:
        return near.union(bridge_links(large.select("fp").distinct()))
    tiles = F.ceil(F.col("size") / F.lit(bucket // 2)).cast("int")
    mine = large.withColumn("tile", F.pmod(F.xxhash64("fp"), tiles).cast("int"))
    other = F.explode(F.sequence(F.lit(0), tiles - 1))
    paired = mine.withColumn("other", other).withColumn("group", F.xxhash64("probe", "value", F.least("tile", "other"), F.greatest("tile", "other")))
    return near.union(paired.repartition("group").sortWithinPartitions("group").select("group", "fp").mapInArrow(verify, "a long, b long"))


def simhash_components(docs: DataFrame, radius: int = 2, words: int = 3) -> DataFrame:
    """docs (doc_id, text) to doc_id, fingerprint (16 hex digits) and component_id.

    Fingerprints link at radius or fewer differing bits; component_id is the smallest doc_id reachable. A row for each
    row of docs, repeated rows too; null and empty texts have fingerprint zero and link like any other; a null doc_id
    keeps its row and is never a component_id (null, if a component has no other). No rows give none; other columns
    are dropped.
    """
    each = materialise(fingerprints(docs, words), "fingerprints")
    nodes = materialise(each.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    groups = components(fingerprint_links(nodes, radius)).select(F.col("node").alias("fp"), "component")
    named = materialise(nodes.join(growing(groups), "fp", "left").withColumn("component", F.coalesce("component", "fp")), "named")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_fp = named.select("fp", "component").join(growing(least), "component").select("fp", "component_id")
    return each.join(growing(by_fp), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_simhash_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' fingerprints and components."""
    return simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
