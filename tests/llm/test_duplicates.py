"""Sketches, SimHash components, lines and passages: against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from fixtures import corpus, make, prose

from pyspark.sql import functions as F

from starloom.llm import copies, graph, lines, repeats, simhash, sketch

SPACE = re.compile(rb"[^\x20\x09-\x0d]+")


def words(text):
    return SPACE.findall((text or "").encode())


# --- sketches


def shingles(text):
    w = words("".join(c.lower() if c.isascii() else c for c in text or ""))
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_sketches(docs, none):
    rows = sorted(sketch.edited_fingerprints(docs).collect(), key=lambda r: r["doc_id"])
    texts = [t or "" for _, t in sorted(corpus(), key=lambda r: (r[0], r[1] or ""))]
    by_text, seen = {}, Counter()
    assert [r["doc_id"] for r in rows] == sorted(d for d, _ in corpus())
    rows = [r for r in rows if r["doc_id"] != 48]  # the order of equal ids isn't in the result
    for i, r in enumerate(rows):
        text, after = texts[i], texts[i + 1]
        changed = sketch.edit(text, after)
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        k = len(text) // 2
        assert changed == text[: len(text) - k] + after[:k]
        assert by_text.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        a, b = shingles(text), shingles(changed)
        if len(a) > 150:
            small, large = (a, b) if len(a) <= len(b) else (b, a)
            assert abs(r["near_edited"] - len(small & large) / len(small)) < 0.25
        kept = sketch.unpack(r["fingerprint"])
        seen["kept"] += len(kept)
        seen["all"] += len(a)
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 and len(kept) <= len(a)
    assert 0.06 < seen["kept"] / seen["all"] < 0.25
    assert sketch.edited_fingerprints(none).count() == 0
    assert sketch.edited_fingerprints(make(docs.sparkSession, [(None, "a b c d e f"), (None, None)])).count() == 2


def test_containment_of_unequal_documents():
    rng = random.Random(1)
    large = prose(rng, 8000)
    part = " ".join(large.split(" ")[1000:2500])
    one, all_ = (sketch.sketches(__import__("pyarrow").array([t]), 1 / 8)[0] for t in (part, large))
    assert sketch.containment(one, all_) > 0.97 and sketch.containment(all_, one) < 0.3
    merged = sketch.unpack(sketch.merge([sketch.pack(one), sketch.pack(all_)]))
    assert set(merged) == set(one) | set(all_)


def test_sketches_of_short_texts(spark):
    """Texts of up to 32 shingles are compared exactly, also with long ones; unrelated ones aren't alike."""
    rng = random.Random(5)
    large = prose(rng, 2000)
    texts = [prose(rng, n) for n in (1, 2, 3, 4, 5, 6, 9, 12, 20, 30)] + [" ".join(large.split(" ")[500:512]), large, "", " ", "odd"]
    rows = sorted(sketch.edited_fingerprints(make(spark, list(enumerate(texts)))).collect(), key=lambda r: r["doc_id"])
    for i, r in enumerate(rows):
        a, b = shingles(texts[i]), shingles(texts[(i + 1) % len(texts)])
        if len(a) <= 32:
            assert len(sketch.unpack(r["fingerprint"])) == len(a)
        small, big = sorted((a, b), key=len)
        want = len(small & big) / len(small) if small else float(not big)
        assert r["near_next"] == pytest.approx(want)
        changed = shingles(sketch.edit(texts[i], texts[(i + 1) % len(texts)]))
        if len(a) <= 32:
            small, big = sorted((a, changed), key=len)
            assert r["near_edited"] == pytest.approx(len(small & big) / len(small) if small else float(not big))


# --- SimHash


def plain_fingerprint(text):
    w = [x.lower() for x in words(text)]
    if not w:
        return 0
    grams = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(fps, radius):
    """Least place of each fingerprint's class, by comparing all pairs."""
    a = np.array(fps, np.uint64)
    near = np.argwhere(np.triu(np.bitwise_count(a[:, None] ^ a) <= radius, 1))
    return graph.local_labels(len(a), *near.T) if len(near) else np.arange(len(a))


def test_simhash_of_texts(docs, none):
    rows = simhash.simhash_components(docs).collect()
    fps = {(d, t): plain_fingerprint(t) for d, t in corpus()}
    assert Counter((r["doc_id"], r["fingerprint"]) for r in rows) == Counter((d, f"{plain_fingerprint(t):016x}") for d, t in corpus())
    ordered = sorted(fps.items(), key=lambda x: x[0][0])
    label = classes([f for _, f in ordered], 2)
    want = {f: min(k[0] for (k, _), y in zip(ordered, label) if y == label[i]) for i, (_, f) in enumerate(ordered)}
    assert all(r["component_id"] == want[int(r["fingerprint"], 16)] for r in rows)
    assert simhash.simhash_components(none).count() == 0


@pytest.mark.parametrize("radius,bucket", [(2, 512), (2, 4), (3, 4), (1, 512)])
def test_links_of_fingerprints(spark, tmp_path, radius, bucket):
    """Clusters, chains and a crowd that shares most bits: no link is lost, in small buckets and large ones."""
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**63, 30).astype(np.uint64)
    fps = set(base.tolist())
    for x in base[:10].tolist():
        for _ in range(6):
            x ^= sum(1 << int(b) for b in rng.choice(64, int(rng.integers(1, radius + 2)), replace=False))
            fps.add(x)
    crowd = int(base[20])
    fps |= {crowd ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (60, 2))}
    fps = sorted(fps)
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    df.write.parquet(str(tmp_path / "f"))
    got = {r[0]: r[1] for r in graph.components(simhash.fingerprint_links(spark.read.parquet(str(tmp_path / "f")), radius, bucket)).collect()}
    label = classes(fps, radius)
    signed = [int(np.uint64(f).view(np.int64)) for f in fps]
    mine = Counter(map(frozenset, group(zip(signed, (got.get(s, s) for s in signed)))))
    assert mine == Counter(map(frozenset, group(zip(signed, label.tolist()))))


def group(pairs):
    out = {}
    for x, k in pairs:
        out.setdefault(k, set()).add(x)
    return out.values()


def test_thresholds_are_the_cheapest_and_cover():
    costs = [[0.0, 5, 1, 9], [0.0, 2, 8, 9], [0.0, 4, 4, 4]]
    cost, chosen = simhash.allocate(costs, 0)
    every = {(a, b, c): costs[0][a + 1] + costs[1][b + 1] + costs[2][c + 1] for a in range(-1, 3) for b in range(-1, 3) for c in range(-1, 3) if a + b + c == 0}
    assert cost == min(every.values()) == every[tuple(chosen)]
    parts = simhash.correlated_parts(0, np.zeros((64, 64), np.int64), 5)
    assert sorted(b for p in parts for b in p) == list(range(64))


def test_candidate_estimates_see_correlation():
    """Estimates against the candidates that were counted: near them, and in their order over plans."""
    rng = np.random.default_rng(3)
    topics = rng.integers(0, 2, (40, 64))
    bits = topics[rng.integers(0, 40, 3000)] ^ (rng.random((3000, 64)) < 0.12)
    bits[:, 1::2] = bits[:, ::2] ^ (rng.random((3000, 32)) < 0.03)  # each second bit follows its neighbour
    n, both = len(bits), bits.T @ bits
    estimates, counted = [], []
    for parts in (3, 5):
        for part in simhash.correlated_parts(n, both, parts):
            weight = bits[:, part].sum(1)
            differ = weight[:, None] + weight[None, :] - 2 * bits[:, part] @ bits[:, part].T
            near = np.bincount(differ[np.triu_indices(n, 1)].ravel(), minlength=3)[:3]
            for t in range(3):
                met = sum(near[d] * math.comb(len(part) - d, t - d) for d in range(t + 1))
                estimates.append(simhash.part_costs(n, both, part, 2)[t + 1])
                counted.append(n * math.comb(len(part), t) + met)
    ratio = np.array(estimates) / np.array(counted)
    assert 0.2 < ratio.min() and ratio.max() < 5, ratio
    ranks = [np.argsort(np.argsort(x)) for x in (estimates, counted)]
    assert np.corrcoef(*ranks)[0, 1] > 0.9


@pytest.mark.parametrize("chunk", [1_000_000, 3])
@pytest.mark.parametrize("n,edges", [(1, []), (150, "chain"), (400, "random"), (200, "star")])
def test_components(spark, n, edges, chunk):
    rng = np.random.default_rng(n)
    made = {"chain": [(i, i + 1) for i in range(n - 1)], "random": rng.integers(0, n, (n * 3 // 4, 2)).tolist(), "star": [(0, i) for i in range(1, n)] + [(5, 5)] * 3}.get(edges, []) if edges else []
    df = spark.createDataFrame([tuple(map(int, e)) for e in made], "a long, b long").repartition(5)
    got = {r["node"]: r["component"] for r in graph.components(df, chunk).collect()}
    real = [(a, b) for a, b in made if a != b]
    label = graph.local_labels(n, *(np.array(x, np.int64) for x in zip(*real))) if real else []
    assert got == {int(x): int(label[x]) for e in real for x in e}


# --- near copies of documents


@pytest.mark.parametrize("bucket,piece", [(512, 100_000), (4, 3)])
def test_near_copies(spark, tmp_path, bucket, piece):
    """Against all pairs by Jaccard similarity alone: none is wrong, and of the similar ones at least 0.95 are together."""
    rng = random.Random(bucket)
    passage = prose(rng, 60)
    texts = [None, "", " ", "one two", "One  two", "one two three"]
    for i in range(60):
        w = prose(rng, rng.choice([6, 12, 30, 80, 200, 600])).split(" ")
        w = w + passage.split(" ") if i % 4 == 0 else w
        texts.append(" ".join(w))
        for _ in range(rng.choice([0, 1, 1, 9])):
            other = list(w)
            for _ in range(rng.randint(0, 1 + len(w) // 45)):
                at = rng.randrange(len(other))
                other[at : at + rng.choice([0, 1, 1])] = rng.choice([[], ["altered"], ["changed"], [other[0]]])
            texts.append(" ".join(other))
    make(spark, list(enumerate(texts))).select(F.col("doc_id").alias("id"), "text", F.lit(1).alias("block")).write.parquet(str(tmp_path / "c"))
    got = {r["id"]: r["component"] for r in copies.near_copies(spark.read.parquet(str(tmp_path / "c")), bucket=bucket, piece=piece).collect()}
    sets = [shingles(t) for t in texts]
    near = [(i, j) for i in range(len(sets)) for j in range(i) if not sets[i] | sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    label = graph.local_labels(len(sets), *(np.array(x, np.int64) for x in zip(*near)))
    assert all(label[i] == label[c] for i, c in got.items())
    together = sum(got.get(i, i) == got.get(j, j) for i, j in near)
    assert len(near) > 100 and together >= 0.95 * len(near)


# --- lines


def normal_words(line):
    out = re.findall(r"[0-9A-Za-z\u0080-\U0010ffff]+", line)
    return ["".join("0" if c in "0123456789" else c.lower() if c.isascii() or "À" <= c <= "Þ" and c != "×" else c for c in w) for w in out]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


LINES = ["the quick brown fox jumps over the lazy dog near the old stone bridge today", "The quick brown fox jumps over the lazy dog near the old stone bridge today!", "the quick brown fox jumps over the lazy cat near the old stone bridge today", "an entirely different line about copper lanterns and winter markets by the sea", "short line", "", "Page 1 of 20 of the yearly report of the harbor office", "Page 7 of 35 of the yearly report of the harbor office"]


@pytest.mark.parametrize("bucket,per_part", [(512, 4_000_000), (8, 40)])
def test_near_copies_are_all_pairs_of_the_similarity(spark, tmp_path, bucket, per_part):
    """No similar pair is left out, neither among short texts and those with as many edits as the similarity bears nor
    among texts full of passages that many others have. Also with common shingles dealt over parts."""
    rng = random.Random(17)
    passages = [prose(rng, 30).split() for _ in range(12)]
    texts = []
    for i in range(150):
        w = prose(rng, rng.choice([4, 20, 46, 50, 95, 140])).split()
        for _ in range(rng.choice([0, 0, 1, 6]) if i % 2 else 0):
            w += rng.choice(passages)
        other = list(w)
        for k in range(len(w) // 45):
            other[min(len(w) - 1, 45 * k + rng.randrange(4, 40))] = f"altered{i}"
        texts += [" ".join(w), " ".join(other)]
    make(spark, list(enumerate(texts))).select(F.col("doc_id").alias("id"), "text").write.parquet(str(tmp_path / "c"))
    got = {r["id"]: r["component"] for r in copies.near_copies(spark.read.parquet(str(tmp_path / "c")), bucket=bucket, per_part=per_part).collect()}
    sets = [shingles(t) for t in texts]
    near = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    label = graph.local_labels(len(sets), *(np.array(x, np.int64) for x in zip(*near)))
    assert len(near) > 100
    assert got == {i: int(label[i]) for i in {x for pair in near for x in pair}}


def test_near_copies_take_the_pigeonhole_search(spark, monkeypatch):
    """Without segments, what is within two bits is found by the search alone and still decided by shingles."""
    from starloom.llm import copies
    from starloom.llm.simhash import fingerprint

    long = [" ".join(f"w{(i * i + 7 * j) % 997}" for i in range(400)) for j in range(3)]
    near = next(x for x in (long[0] + f" end{i}" for i in range(200)) if 0 < (fingerprint(x, 5) ^ fingerprint(long[0], 5)).bit_count() <= 2)
    docs = spark.createDataFrame([(0, long[0]), (1, near), (2, long[1]), (3, long[1].upper()), (4, long[2]), (5, None), (6, " ")], "id long, text string")
    docs = copies.materialise(docs, "docs")
    found = lambda: dict(map(tuple, copies.near_copies(docs, keys=0).where("id <> component").collect()))
    assert found() == {1: 0, 3: 2, 6: 5}
    monkeypatch.setattr(copies, "fingerprints", lambda docs, words: docs.select("doc_id", F.lit(1).cast("long").alias("fp")))
    assert found() == {1: 0, 3: 2, 6: 5}


def test_edit_similarity():
    rng = random.Random(2)
    rows = [np.array([rng.randrange(6) for _ in range(rng.choice([0, 1, 5, 63, 64, 65, 130, 200]))], np.uint16) for _ in range(40)]
    left, right = (x.ravel() for x in np.meshgrid(range(40), range(40)))
    got = lines.pair_edits(np.concatenate(rows), np.cumsum([0, *map(len, rows)]), left, right, together=300)
    assert got.tolist() == [edits(rows[a].tolist(), rows[b].tolist()) for a, b in zip(left, right)]


def test_unlike_words_need_no_edit_distance():
    """Counts of words never rule out a pair within the bound, and rule out bags of words that differ by more."""
    rng = np.random.default_rng(2)
    rows = [rng.integers(0, most, n).astype(np.uint16) for most in (3, 50, 5000) for n in (0, 1, 9, 40, 300, 700)]
    rows += [np.r_[x[len(x) // 3 :], x[: len(x) // 4]] for x in rows]
    codes, offsets = np.concatenate(rows), np.cumsum([0, *map(len, rows)])
    a, b = (x.ravel() for x in np.meshgrid(np.arange(len(rows)), np.arange(len(rows))))
    least = lines.unshared(lines.word_counts(codes, offsets), a, b, together=50)
    assert (least <= lines.pair_edits(codes, offsets, a, b)).all()
    exact = [max((x - y).total(), (y - x).total()) for x, y in ((Counter(rows[i].tolist()), Counter(rows[j].tolist())) for i, j in zip(a, b))]
    assert (least <= exact).all() and (least >= 0.7 * np.array(exact))[(np.diff(offsets)[a] < 60) & (np.diff(offsets)[b] < 60)].all()


def test_fuzzy_lines(spark, docs, none, tmp_path):
    rng = random.Random(4)
    rows = [(2, "\n".join(LINES[:4])), (1, "\n".join([LINES[3], LINES[4], LINES[4], LINES[5]])), (3, "\n".join(LINES[6:] + LINES[:1])), (4, None), (5, ""), (6, LINES[2]), (7, prose(rng, 200)), (8, LINES[4])]
    make(spark, rows).coalesce(1).write.parquet(str(tmp_path / "l"))
    out = {r["doc_id"]: r for r in lines.dedup_lines(spark.read.parquet(str(tmp_path / "l"))).collect()}
    kept = lambda d: out[d]["text"].split("\n")
    assert kept(1) == [LINES[3], LINES[4], LINES[4], LINES[5]] and out[1]["n_removed"] == 0
    assert kept(2) == [LINES[0], *(LINES[i] for i in (2,) if LINES[2] in kept(2))] and LINES[1] not in kept(2) and LINES[3] not in kept(2)
    assert kept(3) == [LINES[6]] and out[3]["n_removed"] == 2
    assert out[4]["text"] is None and out[4]["n_lines"] == 0 and out[5]["text"] == "" and out[5]["n_lines"] == 1
    assert out[7]["text"] == rows[6][1] and out[8]["text"] == LINES[4] and out[1]["shard"] == 1
    assert lines.dedup_lines(none).count() == 0
    whole = lines.dedup_lines(docs)
    assert whole.count() == docs.count() and set(docs.columns) <= set(whole.columns)


@pytest.mark.parametrize("bucket", [512, 6])
def test_similar_lines_are_all_pairs_of_the_similarity(spark, tmp_path, bucket):
    """Against all pairs by edit similarity alone, 5 to 120 words, up to a fifth of them edited; common passages too."""
    rng = random.Random(bucket)
    texts, passage = set(), prose(rng, 20).replace("\n", " ").split(" ")
    for i in range(60):
        w = prose(rng, rng.choice([5, 6, 7, 9, 12, 15, 19, 25, 40, 120])).replace("\n", " ").split(" ")
        w = w[: len(w) // 2] + passage + w[len(w) // 2 :] if i % 5 == 0 else w
        texts.add(" ".join(w))
        for _ in range(rng.choice([1, 1, 8])):
            other = list(w)
            for _ in range(rng.randint(1, max(1, len(w) // 4))):
                at = rng.randrange(len(other))
                other[at : at + rng.choice([0, 1, 1])] = rng.choice([[], ["altered"], ["changed"], [other[0]]])
            texts.add(" ".join(other))
    import pyarrow as pa

    _, _, h, codes, at = lines.line_features(pa.array(["\n".join(sorted(texts))]), 5)
    rows = {int(x): codes[a:b] for x, a, b in zip(h.view(np.int64), at, at[1:])}
    spark.createDataFrame([(i, x, c.tobytes()) for i, (x, c) in enumerate(rows.items())], "id long, h long, codes binary").write.parquet(str(tmp_path / "n"))
    got = {r["node"]: r["component"] for r in graph.components(lines.similar_lines(spark.read.parquet(str(tmp_path / "n")), bucket=bucket)).collect()}
    ids, uniq = list(rows), [c.tolist() for c in rows.values()]
    near = [(i, j) for i in range(len(uniq)) for j in range(i) if 5 * edits(uniq[i], uniq[j]) <= max(len(uniq[i]), len(uniq[j]))]
    label = graph.local_labels(len(uniq), *(np.array(x, np.int64) for x in zip(*near)))
    assert len(near) > 50 and Counter(map(frozenset, group(zip(ids, (got.get(i, i) for i in ids))))) == Counter(map(frozenset, group(zip(ids, label.tolist()))))


def test_short_lines_and_scripts_without_spaces(spark, tmp_path):
    chinese = "今天天气很好我们一起去公园散步吧"
    rows = [(1, f"All rights reserved.\n\n{chinese}\n-----\n{LINES[0]}"), (2, f"all rights reserved\n\n{chinese}\n-----\nall rights"), (3, f"{chinese.replace('公', '花')}\n{LINES[2]}\n \n====")]
    make(spark, rows).coalesce(1).write.parquet(str(tmp_path / "l"))
    out = {r["doc_id"]: r["text"] for r in lines.dedup_lines(spark.read.parquet(str(tmp_path / "l")), short=True).collect()}
    assert out == {1: rows[0][1], 2: "\nall rights", 3: " \n===="}


# --- passages


def brute_repeats(rows, window):
    seen = Counter()
    split = [words(t) for _, t in rows]
    for w in split:
        seen.update(tuple(w[i : i + window]) for i in range(len(w) - window + 1))
    out = Counter()
    for (doc, _), w in zip(rows, split):
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = True
        out[doc, len(w), int(gone.sum()), b" ".join(x for x, g in zip(w, gone) if not g).decode()] += 1
    return out


@pytest.mark.parametrize("window,anchor", [(35, 8), (6, 3), (3, 3), (2, 1)])
def test_repeats(docs, none, window, anchor):
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in repeats.remove_repeats(docs, window, anchor).collect())
    assert got == brute_repeats(corpus(), window)
    assert repeats.remove_repeats(none).count() == 0
    with pytest.raises(ValueError):
        repeats.remove_repeats(docs, 3, 4)


def test_groups_of_candidates_make_no_square_of_pairs(spark, tmp_path, monkeypatch):
    """Crowds of lines around common ones: no link is lost, groups of up to TILE buckets give one row a member, and
    those whose members pivots connect give none."""
    import pyarrow as pa

    from starloom.llm import groups

    rng = random.Random(8)
    texts = set()
    for size in (400, 90):
        w = prose(rng, 40).replace("\n", " ").split(" ")
        for _ in range(size):
            other = list(w)
            for _ in range(rng.randint(0, 5)):
                other[rng.randrange(len(other))] = f"word{rng.randrange(10**6)}"
            texts.add(" ".join(other))
    _, _, h, codes, at = lines.line_features(pa.array(["\n".join(sorted(texts))]), 5)
    rows = {int(x): codes[a:b] for x, a, b in zip(h.view(np.int64), at, at[1:])}
    spark.createDataFrame([(i, x, c.tobytes()) for i, (x, c) in enumerate(rows.items())], "id long, h long, codes binary").write.parquet(str(tmp_path / "n"))
    ids, offsets = list(rows), np.cumsum([0, *map(len, rows.values())])
    a, b = np.triu_indices(len(ids), 1)
    near = lines.pair_edits(np.concatenate(list(rows.values())), offsets, a, b) <= groups.most_edits(np.maximum(np.diff(offsets)[a], np.diff(offsets)[b]), 0.8)
    label = graph.local_labels(len(ids), a[near], b[near])
    for per_part, tile in ((4_000_000, groups.TILE), (40, 4)):  # also with common runs dealt over parts, and in tiles
        monkeypatch.setattr(groups, "TILE", tile)
        got = {r["node"]: r["component"] for r in graph.components(lines.similar_lines(spark.read.parquet(str(tmp_path / "n")), bucket=32, per_part=per_part)).collect()}
        assert Counter(map(frozenset, group(zip(ids, (got.get(i, i) for i in ids))))) == Counter(map(frozenset, group(zip(ids, label.tolist()))))

    large = spark.createDataFrame([(g, i, 40, 0) for g in (1, 2) for i in range(1000)], "block long, id long, words long, pivot long")
    known = spark.createDataFrame([(i, 0) for i in range(500)], "id long, known long")
    assert groups.unsettled(large, known, 32 * 32).count() == 2000
    assert groups.unsettled(large.where("id < 500"), known, 32 * 32).count() == 0
    crossed = groups.unsettled(large.where("block = 1"), known, 600).groupBy("group").count().collect()
    assert max(r["count"] for r in crossed) <= 800  # tiles of a wider group

    group_, member = np.zeros(3000, np.int64), np.arange(3000)
    _, some, one, _ = groups.sets_of(group_, member, np.repeat([10, 11, 20], 1000), 0.8)
    assert len(some) == 3000 and not len(one)


def test_signs_rule_out_unlike_pairs_only():
    """Crowds on one common run of words: members that parities tell from all others make no rows, any that may be
    near another do, also one whose parities are all zero."""
    from starloom.llm import groups

    rng = random.Random(3)
    ids, n = np.arange(200), np.full(200, 10)
    signs = np.array([0, 3, *(rng.getrandbits(64) for _ in range(198))], np.uint64)
    far = lambda i: all((int(signs[i]) ^ int(x)).bit_count() > 4 for j, x in enumerate(signs) if j != i)
    assert all(map(far, range(2, 200)))
    some = slice(0, 100)
    _, member, one, _ = groups.sets_of(np.zeros(100, np.int64), ids[some], n[some], 0.8, signs=signs[some])
    assert member.tolist() == [0, 1] and not len(one)
    assert len(groups.sets_of(np.zeros(100, np.int64), ids[some], n[some], 0.8)[1]) == 100
    rows = pa_rows(groups.picked_groups(np.zeros(200, np.int64), ids, n, np.full(200, 200), 0.8, 128, signs))
    assert len([r for r in rows if r["block"] is not None]) == 200
    assert len([r for r in rows if r["block"] is None]) <= 2  # pairs with pivots; 788 without signs
    rows = pa_rows(groups.picked_groups(np.zeros(200, np.int64), ids, n, np.full(200, 200), 0.8, 128))
    assert len([r for r in rows if r["block"] is None]) > 700


def pa_rows(batches):
    return [r for b in batches for r in b.to_pylist()]


def test_growing_tables_are_not_broadcast(spark, tmp_path, monkeypatch):
    """Small files don't send a table to the driver: sides of joins that grow with the input are shuffled, whatever the
    limit of broadcasts."""
    from starloom.llm import groups
    from starloom.llm.common import materialise

    plans = []

    def noted(df, label, codec="zstd"):
        plans.append((label, df._jdf.queryExecution().executedPlan().toString()))
        return materialise(df, label, codec)

    for module in (copies, graph, groups, lines, simhash):
        monkeypatch.setattr(module, "materialise", noted)
    rng = random.Random(4)
    texts = [prose(rng, 40) for _ in range(60)]
    texts += [x + " end" for x in texts[:30]] + texts[30:]
    make(spark, list(enumerate(texts))).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    noted(copies.near_copies(docs.select(F.col("doc_id").alias("id"), "text")), "copies")
    noted(lines.dedup_lines(docs), "deduped")
    assert {"known", "sets", "copies", "deduped"} <= {label for label, _ in plans}
    assert not [label for label, plan in plans if "BroadcastHashJoin" in plan or "BroadcastNestedLoopJoin" in plan]
