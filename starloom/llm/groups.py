"""Links within groups of candidates: small groups at once, large ones by a pivot first; no group in one task whole."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, growing, materialise, mix
from .graph import components, local_labels
from .simhash import whole_groups

#: Members of a group that are compared at once; those of larger ones are compared with its pivots first.
BUCKET = 128
#: Pivots of such a group; and buckets of members that are compared in one task: beyond, tile by tile.
PIVOTS, TILE = 4, 32
#: Pairs that are judged together.
TOGETHER = 2048
#: Members of a group that gives its pairs one by one.
FEW = 16
PICKED = "block long, id long, words long, pivot long"
#: Of nodes' codes: their lengths, their parities (or None), which of many pairs of places are near at a glance and
#: which aren't (1, -1, else 0), and which are near.
Judge = tuple[np.ndarray, np.ndarray | None, Callable[[np.ndarray, np.ndarray], np.ndarray], Callable[[np.ndarray, np.ndarray], np.ndarray]]


def most_edits(n: np.ndarray | int, similarity: float) -> np.ndarray:
    """Edits that lines within the similarity have at most, the longer of n words."""
    return np.floor((1 - similarity) * np.asarray(n) + 1e-9).astype(np.int64)


def code_arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The codes of a binary column without nulls, and the rows' offsets among them."""
    column = column.cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    return np.frombuffer(raw.tobytes(), np.uint16), (at - at[0]) // 2


def tiled(rows: DataFrame, size: str, key: list[str], member: str, bucket: int) -> DataFrame:
    """rows with `group`: a bucket of at most `bucket` members, or a pair of tiles of a larger one.

    Each two members of a bucket meet in some group, and no group has more than about `bucket` members.
    """
    tiles = F.greatest(F.lit(1), F.ceil(F.col(size) / F.lit(bucket // 2)).cast("int"))
    small = rows.where(F.col(size) <= bucket).withColumn("group", F.xxhash64(*key))
    large = rows.where(F.col(size) > bucket).withColumn("tile", F.pmod(F.xxhash64(member), tiles).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), tiles - 1)))
    large = large.withColumn("group", F.xxhash64(*key, F.least("tile", "other"), F.greatest("tile", "other"))).drop("tile", "other")
    return small.unionByName(large)


def neighbours(group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All places (i, j), i < j, of rows of one group, in turns: next ones first. Rows of a group stand together."""
    place = np.arange(len(group))
    for shift in range(1, len(group)):
        place = place[: np.searchsorted(place, len(group) - shift)]
        place = place[group[place] == group[place + shift]]
        if not len(place):
            return
        yield place, place + shift


def like(ids: np.ndarray, n: np.ndarray, signs: np.ndarray, a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """Whether rows a[i] and b[i] may be near, by their lengths and signs: an edit changes two parities at most."""
    most = most_edits(np.maximum(n[a], n[b]), similarity)
    return (ids[a] != ids[b]) & (np.abs(n[a] - n[b]) <= most) & (np.bitwise_count(signs[a] ^ signs[b]) <= 2 * most)


def by_length(group: np.ndarray, ids: np.ndarray, n: np.ndarray, known: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """The sets (hash of the members, member) that pairs of a like length connect within groups: in the order of
    lengths these are runs, which end where the next length is out of reach. Sets of which all is known to be connected
    are left out. No pairs are made."""
    if not len(group):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    number = np.cumsum(np.r_[False, group[1:] != group[:-1]])
    by = np.lexsort((n, number))
    number, ids, n, known = number[by], ids[by], n[by], known[by]
    start = np.flatnonzero(np.r_[True, (number[1:] != number[:-1]) | (np.diff(n) > most_edits(n[1:], similarity))])
    size = np.diff(np.r_[start, len(ids)])
    whole = np.repeat(np.add.reduceat(mix(ids.view(np.uint64)), start).view(np.int64), size)
    some = np.repeat(np.minimum.reduceat(known, start) != np.maximum.reduceat(known, start), size)
    return whole[some], ids[some]


def sets_of(group: np.ndarray, ids: np.ndarray, n: np.ndarray, similarity: float, known: np.ndarray | None = None, signs: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The sets of lines (hash of the members, member) that pairs of a like length of a group connect, each set once.
    Groups of FEW members give their pairs (one, other) instead, as these repeat from group to group. Pairs known to be
    connected don't count, nor do those whose signs (see picked_groups) rule them out, if given."""
    known = ids if known is None else known
    signs = np.zeros(len(ids), np.uint64) if signs is None else signs
    size = np.diff(np.flatnonzero(np.r_[True, group[1:] != group[:-1], True])) if len(group) else np.empty(0, np.int64)
    few = np.repeat(size, size) <= FEW
    signed = ~few & (np.repeat(np.maximum.reduceat(signs, np.cumsum(size) - size), size) != 0) if len(group) else few
    if signed.any():
        # what is like no other member can be left out
        many, alike = np.flatnonzero(signed), ~few & ~signed
        for a, b in neighbours(group[many]):
            a, b = many[a], many[b]
            near = like(ids, n, signs, a, b, similarity) & (known[a] != known[b])
            alike[a[near]] = alike[b[near]] = True
        kept = np.flatnonzero(few | alike)
        group, ids, n, known, signs, few = group[kept], ids[kept], n[kept], known[kept], signs[kept], few[kept]
    total, some = by_length(group[~few], ids[~few], n[~few], known[~few], similarity)
    group, ids, n, known, signs = group[few], ids[few], n[few], known[few], signs[few]
    low, high = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for a, b in neighbours(group):
        near = np.flatnonzero(like(ids, n, signs, a, b, similarity) & (known[a] != known[b]))
        low.append(np.minimum(ids[a[near]], ids[b[near]]))
        high.append(np.maximum(ids[a[near]], ids[b[near]]))
    one, other = np.concatenate(low), np.concatenate(high)
    by = np.lexsort((other, one))
    one, other = one[by], other[by]
    first = np.r_[True, (one[1:] != one[:-1]) | (other[1:] != other[:-1])][: len(one)]
    by = np.lexsort((some, total))
    total, some = total[by], some[by]
    new = np.r_[True, (total[1:] != total[:-1]) | (some[1:] != some[:-1])][: len(total)]
    return total[new], some[new], one[first], other[first]


def pivot_pairs(group: np.ndarray, ids: np.ndarray, n: np.ndarray, signs: np.ndarray, similarity: float, pivots: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's first pivot; and the pairs (id, pivot), alike by length and signs, of members and their group's pivots.
    These are the least by a hash, so that groups that share members share pivots."""
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[first, len(group)])
    by = np.lexsort((mix(ids.view(np.uint64)), np.repeat(np.arange(len(first)), size)))
    pairs = [np.empty((2, 0), np.int64)]
    for k in range(pivots):
        lead = np.repeat(by[first + np.minimum(k, size - 1)], size)
        near = np.flatnonzero(like(ids, n, signs, np.arange(len(ids)), lead, similarity))
        pairs.append(np.stack([ids[near], ids[lead[near]]]))
    return ids[np.repeat(by[first], size)], *np.unique(np.concatenate(pairs, axis=1), axis=1)


def picked_groups(block: np.ndarray, ids: np.ndarray, n: np.ndarray, size: np.ndarray, similarity: float, bucket: int, signs: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Rows of groups that stand together (PICKED; signs, if given: 64 parities of each row's words): of groups of at most bucket members the sets, without words and
    pivot, or the pairs (id, pivot), without block and of 0 words; members of larger ones, by their size, with a pivot
    that is here; and members' pairs with pivots in all groups of more than FEW, without block and words."""
    rows = lambda *columns: pa.RecordBatch.from_arrays([pa.nulls(len(columns[1]), pa.int64()) if c is None else pa.array(c) for c in columns], ["block", "id", "words", "pivot"])
    small = size <= bucket
    whole, member, one, other = sets_of(block[small], ids[small], n[small], similarity, signs=None if signs is None else signs[small])
    signs = np.zeros(len(ids), np.uint64) if signs is None else signs
    yield rows(whole, member, None, None)
    yield rows(None, other, np.zeros(len(one), np.int64), one)
    some = small & (size > FEW)
    if some.any():
        _, one, other = pivot_pairs(block[some], ids[some], n[some], signs[some], similarity, 1)
        yield rows(None, one, None, other)
    block, ids, n, signs = block[~small], ids[~small], n[~small], signs[~small]
    if len(block):
        pivot, one, other = pivot_pairs(block, ids, n, signs, similarity, PIVOTS)
        yield rows(block, ids, n, pivot)
        yield rows(None, one, None, other)


def judged(pairs: DataFrame, nodes: DataFrame, judge: Callable[[pa.Array], Judge]) -> DataFrame:
    """Of pairs (id, pivot) of nodes those that are near: id, pivot, h, pivot_h."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, others = (batch.column(batch.schema.get_field_index(c)).cast(pa.large_binary()) for c in ("codes", "pivot_codes"))
            at = np.arange(batch.num_rows)
            _, _, glance, near = judge(pa.concat_arrays([codes, others]))
            seen = glance(at, at + batch.num_rows)
            rest = np.flatnonzero(seen == 0)
            seen[rest] = near(rest, rest + batch.num_rows)
            yield batch.select(["id", "pivot", "h", "pivot_h"]).filter(pa.array(seen > 0))

    nodes = growing(nodes.select("id", "h", "codes"))
    both = pairs.join(nodes, "id").join(growing(nodes.withColumnsRenamed({"id": "pivot", "h": "pivot_h", "codes": "pivot_codes"})), "pivot")
    return both.select("id", "pivot", "h", "pivot_h", "codes", "pivot_codes").mapInArrow(verify, "id long, pivot long, h long, pivot_h long")


def unsettled(large: DataFrame, known: DataFrame, widest: int) -> DataFrame:
    """Of groups with many members (block, id, words, pivot: a member), what is left to compare where known (id, known)
    is connected: as (group, id, words, known), in groups of at most about `widest` members each, the groups of which
    not all is connected, whole; of wider ones the members apart from a pivot's part, with all others."""
    sides = large.join(growing(known), "id", "left").select("block", "id", "words", F.coalesce("known", "id").alias("known"), "pivot")
    sides = materialise(sides, "sides")
    # most groups are settled by now: all members are with each other
    groups = sides.groupBy("block").agg(F.min("known").alias("low"), F.max("known").alias("high"), F.count(F.lit(1)).alias("members"))
    groups = groups.where("low <> high").select("block", "members")
    whole = sides.join(growing(groups.where(F.col("members") <= widest)), "block").withColumn("group", F.xxhash64("block"))
    wide = sides.join(growing(groups.where(F.col("members") > widest)), "block")
    leads = wide.groupBy("block").agg(F.min("pivot").alias("id")).join(growing(known), "id", "left").select("block", F.coalesce("known", "id").alias("main"))
    left = wide.join(growing(leads), "block").withColumn("apart", F.col("known") != F.col("main"))
    left = left.join(growing(left.groupBy("block").agg(F.count_if("apart").alias("aparts"))), "block")
    tile = lambda size: F.ceil(F.col(size) / F.lit(widest // 2)).cast("int")
    mine, other = F.when(F.col("apart"), tile("aparts")).otherwise(tile("members")), F.when(F.col("apart"), tile("members")).otherwise(tile("aparts"))
    crossed = left.withColumn("tile", F.pmod(F.xxhash64("id"), mine)).withColumn("other", F.explode(F.sequence(F.lit(0), other - 1)))
    crossed = crossed.withColumn("group", F.xxhash64("block", F.when(F.col("apart"), F.col("tile")).otherwise(F.col("other")), F.when(F.col("apart"), F.col("other")).otherwise(F.col("tile")), F.lit(-1)))
    among = tiled(left.where("apart"), "aparts", ["block"], "id", widest)
    columns = ["group", "id", "words", "known"]
    return whole.select(columns).union(crossed.select(columns)).union(among.select(columns))


def linked(picked: DataFrame, nodes: DataFrame, similarity: float, bucket: int, judge: Callable[[pa.Array], Judge]) -> DataFrame:
    """Links (a, b) of nodes h that connect what chains of near pairs in the picked groups connect.

    picked: a materialised table of picked_groups' rows, deleted here; nodes: id, h and codes (binary, what judge reads), a written table."""

    def pick_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "group"):
            group, ids, words, known = (np.asarray(table[c]) for c in ("group", "id", "words", "known"))
            whole, member, low, high = sets_of(group, ids, words, similarity, known)
            of_pair = (mix(low.view(np.uint64)) + mix(high.view(np.uint64))).view(np.int64)
            whole, member = np.concatenate([of_pair, of_pair, whole]), np.concatenate([low, high, member])
            one, first = np.unique(ids, return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (whole, member, known[first[np.searchsorted(one, member)]])], ["set", "id", "known"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "set", 8_000):
            group, h, known = (np.asarray(table[c]) for c in ("set", "h", "known"))
            n, parity, glance, is_near = judge(table["codes"].combine_chunks())
            # those known to be connected are one from the start
            by = np.lexsort((known, group))
            new = np.r_[True, (group[by][1:] != group[by][:-1]) | (known[by][1:] != known[by][:-1])]
            label = apart = np.empty(len(by), np.int64)
            apart[by] = np.minimum.reduceat(by, np.flatnonzero(new))[np.cumsum(new) - 1]
            folded = None if parity is None else np.bitwise_xor.reduce(parity, axis=0)
            held, doubtful, none = [], [], np.empty((2, 0), np.int64)

            def taken(pairs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
                left, right = np.concatenate([none, *pairs], axis=1)
                pairs.clear()
                open_ = label[left] != label[right]
                return left[open_], right[open_]

            def joined(left: np.ndarray, right: np.ndarray, near: np.ndarray) -> np.ndarray:
                return local_labels(len(h), np.r_[np.arange(len(h)), left[near]], np.r_[label, right[near]])

            def settled() -> np.ndarray:
                # what is near at a glance may save other pairs the closer look
                left, right = taken(held)
                seen = glance(left, right)
                doubtful.append(np.stack([left, right])[:, seen == 0])
                return joined(left, right, seen > 0)

            def looked() -> np.ndarray:
                left, right = taken(doubtful)
                return joined(left, right, is_near(left, right))

            waiting = lambda pairs: sum(x.shape[1] for x in pairs)
            for a, b in neighbours(group):
                most = most_edits(np.maximum(n[a], n[b]), similarity)
                near = np.flatnonzero((label[a] != label[b]) & (np.abs(n[a] - n[b]) <= most))
                if parity is not None:
                    # the parities of all words in one integer rule most pairs out
                    near = near[np.bitwise_count(folded[a[near]] ^ folded[b[near]]) <= 2 * most[near]]
                    near = near[np.bitwise_count(parity[:, a[near]] ^ parity[:, b[near]]).sum(axis=0) <= 2 * most[near]]
                held.append(np.stack([a[near], b[near]]))
                if waiting(held) >= TOGETHER:
                    label = settled()
                    if waiting(doubtful) >= TOGETHER:
                        label = looked()
            label = settled()
            label = looked()
            far = np.flatnonzero(label != apart)
            yield pa.RecordBatch.from_arrays([pa.array(h[far]), pa.array(h[label[far]])], ["a", "b"])

    # few pairs may connect most: with pivots, and each node's with its least partner
    pairs = materialise(picked.where("block IS NULL AND words IS NOT NULL").select("id", "pivot").distinct(), "pairs")
    star = picked.where("block IS NULL AND words IS NULL").select("id", "pivot").union(pairs.groupBy("id").agg(F.min("pivot").alias("pivot")))
    first = materialise(judged(star.distinct(), nodes, judge), "first")
    known = components(first.select(F.col("id").alias("a"), F.col("pivot").alias("b"))).withColumnsRenamed({"node": "id", "component": "known"})
    known = materialise(known, "known")
    # the others are judged unless connected by now
    of_pivot = known.withColumnsRenamed({"id": "pivot", "known": "lead"})
    others = pairs.join(growing(known), "id", "left").join(growing(of_pivot), "pivot", "left").where("coalesce(known, id) <> coalesce(lead, pivot)")
    links = first.union(judged(others.select("id", "pivot"), nodes, judge)).select(F.col("h").alias("a"), F.col("pivot_h").alias("b"))
    sets = picked.where("pivot IS NULL").select(F.col("block").alias("set"), "id").distinct()
    sets = sets.join(growing(known), "id", "left").select("set", "id", F.coalesce("known", "id").alias("known"))
    large = picked.where("block IS NOT NULL AND words IS NOT NULL")
    if not large.isEmpty():
        rest = unsettled(large, known, TILE * bucket)
        sets = sets.unionByName(rest.repartition("group").sortWithinPartitions("group", "id").mapInArrow(pick_tiles, "set long, id long, known long"))
    sets = materialise(sets.distinct(), "sets")
    discard(picked)
    # most sets are settled by now
    open_ = sets.groupBy("set").agg(F.min("known").alias("low"), F.max("known").alias("high")).where("low <> high").select("set")
    sets = sets.join(growing(open_), "set", "left_semi")
    found = sets.join(growing(nodes.select("id", "h", "codes")), "id").select("set", "h", "codes", "known").repartition("set").sortWithinPartitions("set", "h").mapInArrow(verify, "a long, b long")
    return found.union(links)
