"""Benchmark decontamination by template canonicalisation.

Words are lowered; numbers, the units after them and names (capitalised inside a sentence) become typed placeholders.
Windows of template tokens are joined by hash with the benchmark's. What the placeholders stand for is kept: a match
counts if the same benchmark value always meets the same document value, so a re-parameterised question is caught and
texts of the same shape are not. A capitalised word that opens a sentence may be a name or not: texts are read both ways.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Words, byte_table, growing, materialise, mix, runs, window_hashes

#: Template tokens of a window; the share of them that must be words; the share of an item's windows that must match.
WINDOW, LITERALS, COVERAGE = 8, 0.5, 0.5
#: Tokens of an exact passage that is reported whatever its share of the item.
PASSAGE = 13
#: Benchmark windows that are sent to every task (16 bytes each); more of them are joined by a shuffle.
PROBE_WINDOWS = 2_000_000
#: Words that are units when they follow a number.
UNITS = frozenset("mm cm m km in ft yd mi mg g kg t lb oz ml l gal s sec min h hr hour hours day days week weeks month months year years minute minutes second seconds percent % $ € £ ¢ °c °f c f k j kj cal kcal w kw mw v a hz khz mhz ghz b kb mb gb tb usd eur gbp dollar dollars euro euros pound pounds cent cents mile miles meter meters metre metres kilometer kilometers kilometre kilometres gram grams kilogram kilograms liter liters litre litres foot feet inch inches".split())
WORD, NUMBER, NAME, UNIT = 0, 1, 2, 3
#: Classes of bytes: letters and all beyond ASCII 1, digits 2, signs that are units 3; the rest ends words.
CLASSES = np.zeros(256, np.uint8)
CLASSES[[b for b in range(256) if b > 127 or chr(b).isalpha()]] = 1
CLASSES[48:58] = 2
CLASSES[list(b"%$")] = 3
LOWER = byte_table(bytes(b for b in range(256) if not CLASSES[b]), lower=True)
LOWER[list(b".,")] = list(b".,")
UNIT_HASHES = np.sort(Words(pa.array(sorted(UNITS)), LOWER, fold=True, classes=CLASSES).hash)
PLACEHOLDER = mix(np.arange(4, dtype=np.uint64) + np.uint64(77))


def canonical(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(template hashes, kinds, value hashes, offsets) of the template tokens of a run of texts.

    A name is a capitalised word, not all capitals, that doesn't begin a sentence; several in a row are one
    placeholder with the value of all. Null and empty texts have no tokens.
    """
    return reading(texts, False)[:4]


def reading(texts: pa.Array, openers: bool) -> tuple[np.ndarray, ...]:
    """What canonical gives, each token's first word (by place in its text) and whether it has a sentence's first word
    that is a name in this reading; openers: capitalised words that begin a sentence are names too."""
    words = Words(texts, LOWER, fold=True, classes=CLASSES)
    raw, start, end = words.raw, words.start, words.end
    if not len(start):
        return np.empty(0, np.uint64), np.empty(0, np.int8), np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64), np.empty(0, np.int64), np.empty(0, bool)
    stops = np.r_[0, np.cumsum(np.isin(raw, np.frombuffer(b".!?\n", np.uint8)) & (words.kind == 0))]
    opens = np.r_[True, stops[start[1:]] > stops[end[:-1]]]
    opens[words.offsets[:-1][words.offsets[:-1] < len(start)]] = True  # each text's first word
    first, second = raw[start], raw[np.minimum(start + 1, len(raw) - 1)]
    upper = lambda x: (x >= 65) & (x <= 90)
    capital = upper(first) & ~((end - start > 1) & upper(second)) | (first == 0xC3) & (second >= 0x80) & (second <= 0x9E)
    what = words.kind[start]
    after_number = np.r_[False, what[:-1] == 2] & ~opens
    kind = np.where(what == 2, NUMBER, np.where((what == 3) | after_number & np.isin(words.hash, UNIT_HASHES), UNIT, np.where(capital & (~opens | openers) & (what == 1), NAME, WORD))).astype(np.int8)
    own = np.zeros(len(start), bool)
    own[words.offsets[:-1][words.offsets[:-1] < len(start)]] = True
    keep = np.flatnonzero(~((kind == NAME) & np.r_[False, kind[:-1] == NAME] & ~own))
    value = np.add.reduceat(words.hash * np.uint64(3), keep)
    opened = np.logical_or.reduceat(opens & (kind == NAME), keep)
    kind = kind[keep]
    first_word = keep - words.offsets[np.searchsorted(words.offsets, keep, side="right") - 1]
    return np.where(kind == WORD, value, PLACEHOLDER[kind]), kind, value, np.searchsorted(keep, words.offsets), first_word, opened


def windows(read: tuple[np.ndarray, ...], sizes: list[int], literals: float, whole: bool) -> Iterator[tuple]:
    """(size, text, first token's place in its text, template hash, exact hash, first token) of the windows of each of
    these sizes of a reading.

    Template hash 0: too few of its tokens are words. whole: a text of fewer tokens than the largest size has only one
    window, the text; sizes must hold all lengths below the largest.
    """
    template, kind, value, offsets = read[:4]
    length = np.diff(offsets)
    enough = np.r_[0, np.cumsum(kind == WORD)]
    for size in sizes:
        count = np.where((length >= size) & (not whole or size == max(sizes) or length == size), length - size + 1, 0)
        if not count.sum():
            continue
        text = np.repeat(np.arange(len(length)), count)
        place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        at = offsets[text] + place
        hashes = np.where(enough[at + size] - enough[at] >= literals * size, window_hashes(template, size)[at], np.uint64(0))
        yield size, text, place, hashes, mix(window_hashes(value, size)[at] + np.uint64(size)), at


class Probe:
    """Which of many hashes are among a table's: a table of bits first, then a search."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.hashes = np.sort(hashes)
        self.mask = np.uint64((1 << max(16, (16 * len(hashes)).bit_length())) - 1)
        self.bits = np.zeros(int(self.mask) + 1, bool)
        self.bits[(hashes & self.mask).astype(np.int64)] = True

    def places(self, hashes: np.ndarray) -> np.ndarray:
        maybe = np.flatnonzero(self.bits[(hashes & self.mask).astype(np.int64)])
        found = np.minimum(np.searchsorted(self.hashes, hashes[maybe]), len(self.hashes) - 1)
        return maybe[self.hashes[found] == hashes[maybe]]


SCHEMA = "key long, exact boolean, id long, place int, token int, size int, named boolean, slots array<struct<kind: tinyint, value: long>>"


def _rows(ids: pa.Array, texts: pa.Array, sizes: list[int], literals: float, probe: Probe | None, whole: bool) -> Iterator[pa.RecordBatch]:
    """Windows of both readings; those with openers as names only where they differ. place: the first word; token: the
    first token as first read; named (of whole texts): whether the second reading has a window there too."""
    names = reading(texts, True)
    plain = reading(texts, False)
    starts = [np.concatenate([(text << 32) + names[4][at] for _, text, _, _, _, at in windows(names, sizes, literals, True)] or [np.empty(0, np.int64)])] if whole else []
    for read in (plain, names):
        _, kind, value, _, word, opened = read
        before = np.r_[0, np.cumsum(opened)]
        for size, text, token, template, exact, at in windows(read, sizes, literals, whole):
            for hashes, is_exact in ((template, False), (exact, True)):
                if read is names and is_exact:
                    continue
                found = np.flatnonzero(hashes) if probe is None else probe.places(hashes)
                found = found[hashes[found] != 0]
                if read is names:
                    found = found[before[at[found] + size] > before[at[found]]]
                if not len(found):
                    continue
                slots = [[] if is_exact else [{"kind": int(a), "value": int(b)} for a, b in zip(kind[i : i + size], value[i : i + size].view(np.int64)) if a != WORD] for i in at[found].tolist()]
                place = word[at[found]]
                named = np.isin((text[found] << 32) + place, starts[0]) if whole else np.zeros(len(found), bool)
                columns = [pa.array(hashes[found].view(np.int64)), pa.array(np.full(len(found), is_exact)), ids.take(pa.array(text[found])), pa.array(place.astype(np.int32)), pa.array(token[found].astype(np.int32)), pa.array(np.full(len(found), size, np.int32)), pa.array(named), pa.array(slots, pa.list_(pa.struct([("kind", pa.int8()), ("value", pa.int64())])))]
                yield pa.RecordBatch.from_arrays(columns, ["key", "exact", "id", "place", "token", "size", "named", "slots"])


def template_windows(texts: DataFrame, sizes: list[int], literals: float, probe: Probe | None = None, whole: bool = False) -> DataFrame:
    """texts (id long, text) to their windows, those whose hash is among the probe's if one is given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in runs(batch.column(1)):
                yield from _rows(batch.column(0).slice(at, n), batch.column(1).slice(at, n), sizes, literals, probe, whole)

    return texts.mapInArrow(run, SCHEMA)


def contaminated(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, literals: float = LITERALS, coverage: float = COVERAGE, probe_windows: int = PROBE_WINDOWS, passage: int = PASSAGE) -> DataFrame:
    """The pairs (doc, item) of which the document holds at least `coverage` of the item's windows, or `passage` tokens
    of it in a row unchanged.

    docs: doc (long), text; benchmark: item (long), text; other columns are ignored. Returns doc, item, item_windows,
    matched_windows, exact_windows, coverage. A window matches exactly, or as a template if in this pair each
    benchmark value of its slots (by type) always meets one document value. Null and empty texts match nothing. An
    item of fewer tokens than a window is one window, looked for anywhere; windows are counted in the reading, with or
    without sentences' first words as names, that gives more coverage. An item repeated under one id is one item; rows repeated in docs under one id are one document; rows with a null doc
    or item are left out. Empty tables give no rows.
    """
    items = materialise(template_windows(benchmark.select(F.col("item").cast("long"), "text").where("item IS NOT NULL"), list(range(1, size + 1)), literals, whole=True), "items")
    n = items.count()
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect()) or [size]
    probe = None
    if 0 < n <= probe_windows:
        probe = Probe(np.array([r["key"] for r in items.select("key").distinct().collect()], np.int64).view(np.uint64))
    found = template_windows(docs.select(F.col("doc").cast("long"), "text").where("doc IS NOT NULL"), sizes, literals, probe)
    mine = items.select("key", "exact", F.col("id").alias("item"), F.col("place").alias("at"), F.col("token").alias("own_token"), F.col("named").alias("own_named"), F.col("slots").alias("own"))
    hits = materialise(found.select("key", "exact", F.col("id").alias("doc"), "token", "size", "slots").join(mine, ["key", "exact"]), "hits")
    pair = F.explode(F.arrays_zip("own", "slots")).alias("p")
    slots = hits.where("NOT exact").select("doc", "item", pair).select("doc", "item", F.col("p.own.kind").alias("kind"), F.col("p.own.value").alias("asked"), F.col("p.slots.value").alias("told"))
    # the document value that most often stands for each benchmark value of a pair
    votes = slots.groupBy("doc", "item", "kind", "asked", "told").agg(F.count(F.lit(1)).alias("n"))
    chosen = votes.groupBy("doc", "item", "kind", "asked").agg(F.max(F.struct("n", "told")).alias("best")).select("doc", "item", F.struct("kind", "asked", F.col("best.told").alias("told")).alias("x"))
    meaning = chosen.groupBy("doc", "item").agg(F.collect_set("x").alias("meaning"))
    told = F.transform(F.arrays_zip("own", "slots"), lambda p: F.struct(p["own"]["kind"].alias("kind"), p["own"]["value"].alias("asked"), p["slots"]["value"].alias("told")))
    judged = hits.join(growing(meaning), ["doc", "item"], "left").withColumn("ok", F.col("exact") | (F.size(F.array_except(told, F.coalesce("meaning", F.array().cast("array<struct<kind:tinyint,asked:bigint,told:bigint>>")))) == 0))
    per_window = judged.where("ok").groupBy("doc", "item", "at").agg(F.max("exact").alias("exact"), F.max("own_named").alias("named"))
    count = lambda c: F.count_if(F.expr(c))
    matched = per_window.groupBy("doc", "item").agg(F.count(F.lit(1)).alias("m0"), count("named").alias("m1"), count("exact").alias("e0"), count("exact AND named").alias("e1"))
    counts = items.groupBy(F.col("id").alias("item")).agg(F.countDistinct("place").alias("n0"), F.countDistinct(F.when(F.col("named"), F.col("place"))).alias("n1"))
    # exact windows that follow each other in item and document
    lone = hits.where(F.col("exact") & (F.col("size") == size)).select("doc", "item", (F.col("token") - F.col("own_token")).alias("shift"), "own_token").distinct()
    follow = lone.withColumn("run", F.col("own_token") - F.row_number().over(Window.partitionBy("doc", "item", "shift").orderBy("own_token")))
    long_run = follow.groupBy("doc", "item", "shift", "run").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= max(1, passage - size + 1)).select("doc", "item").distinct().withColumn("long_run", F.lit(True))
    by_names = F.col("m1") * F.col("n0") > F.col("m0") * F.col("n1")
    best = lambda a, b: F.when(by_names, F.col(b)).otherwise(F.col(a))
    told_of = matched.join(counts, "item").select("doc", "item", best("n0", "n1").alias("item_windows"), best("m0", "m1").alias("matched_windows"), best("e0", "e1").alias("exact_windows"))
    reported = told_of.withColumn("coverage", F.col("matched_windows") / F.col("item_windows")).join(growing(long_run), ["doc", "item"], "left")
    return reported.where((F.col("coverage") >= coverage) | F.col("long_run")).drop("long_run")


def op7_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold benchmark items: doc_id, item_id and how much of the item they hold."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("doc"), "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("item"), "text")
    return contaminated(docs, items).withColumnsRenamed({"doc": "doc_id", "item": "item_id"})
