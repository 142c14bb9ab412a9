"""Token files and packing: against the tokenizers library text by text, exact round trips."""

import zlib
from itertools import groupby

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from fixtures import corpus
from tokenizers import Tokenizer

from starloom.llm import ans, packing
from starloom.llm.tokens import ChunkEncoder

FILE = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(FILE)
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


TEXTS = [t for _, t in corpus()] + ["don't can't it's we'll I'D 3.14 1,000 x.y,z", "A.B. (see) [x] {y} a_b #tag @me 50%", "Привет, мир! ΑΒΓ", "tabs\tand spaces　wide", "é é ﬁ ǅ İ", "a,b.c, d. e .f ,", "ÀÉ. naïve, ñ, ß."]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_chunks_give_the_library_s_ids(name):
    path = public_tokenizers.path(name)
    tokenizer = Tokenizer.from_file(path)
    ids, offsets = ChunkEncoder(path)(pa.array(TEXTS, pa.string()))
    for i, text in enumerate(TEXTS):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == (tokenizer.encode(text, add_special_tokens=False).ids if text else []), text


def test_written_and_read(spark, docs, none, library, tmp_path):
    ans.write_tokens(docs, str(tmp_path / "t"), FILE, end_id=2, block_tokens=500)
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids"]) for r in ans.read_tokens(spark, str(tmp_path / "t")).collect())
    start = 0
    for (at, doc, n, raw), (want, text) in zip(got, sorted(corpus(), key=lambda r: (r[0], r[1] or "")), strict=True):
        ids = np.frombuffer(bytes(raw), "<u4").tolist()
        assert (doc, at, n) == (want, start, len(ids)) and ids == [*library(text), 2]
        start += n
    ans.write_tokens(none, str(tmp_path / "e"), FILE, end_id=2)
    assert ans.read_tokens(spark, str(tmp_path / "e")).count() == 0


@pytest.mark.parametrize("sizes", [[1], [0, 1, 31, 32, 33], [8192, 8193, 20_000, 5]])
def test_coder_round_trip(sizes):
    rng = np.random.default_rng(3)
    blocks = [np.minimum(rng.zipf(1.3, n), 4000).astype(np.uint16) for n in sizes]
    counts = np.bincount(np.concatenate(blocks), minlength=4001)
    freq = ans.quantise(counts)
    assert freq.sum() == 1 << ans.SCALE and ((freq > 0) == (counts > 0)).all()
    coded = ans.encode_blocks(blocks, freq)
    back = ans.decode_blocks([(len(b), *c) for b, c in zip(blocks, coded)], freq)
    assert all((a == b).all() for a, b in zip(blocks, back))


def test_a_damaged_block_is_refused(spark, docs, tmp_path):
    path = str(tmp_path / "d")
    ans.write_tokens(docs.limit(5), path, FILE, end_id=2)
    bad = spark.read.parquet(f"{path}/blocks").withColumn("crc", __import__("pyspark").sql.functions.col("crc") + 1)
    bad.write.parquet(str(tmp_path / "x/blocks"))
    for part in ("table", "parts"):
        spark.read.parquet(f"{path}/{part}").write.parquet(str(tmp_path / f"x/{part}"))
    with pytest.raises(Exception, match="checksum"):
        ans.read_tokens(spark, str(tmp_path / "x")).count()


def test_packing(spark, docs, none, library):
    rows = packing.pack_documents(docs, FILE, 1, sequence=64).collect()
    want = {}
    for doc, text in corpus():
        want.setdefault(doc, []).append([*library(text), 1])
    for doc, pieces in groupby(sorted((r for r in rows), key=lambda r: (r["doc_id"], r["row"], r["start"])), key=lambda r: r["doc_id"]):
        got = []
        for _, own in groupby(pieces, key=lambda r: r["row"]):
            own = list(own)
            ids = np.frombuffer(b"".join(bytes(p["ids"]) for p in own), "<u4").tolist()
            assert [p["start"] for p in own] == [sum(q["length"] for q in own[:i]) for i in range(len(own))]
            assert all(p["doc_tokens"] == len(ids) and p["ids_crc32"] == zlib.crc32(bytes(p["ids"])) for p in own)
            got.append(ids)
        assert sorted(got) == sorted(want[doc])
    total = 0
    for _, own in groupby(sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])), key=lambda r: r["sequence_id"]):
        at = 0
        for p in own:
            assert p["offset"] == at
            at += p["length"]
        assert 0 < at <= 64
        total += 1
    tokens = sum(r["length"] for r in rows)
    assert {r["sequence_id"] for r in rows} == set(range(total)) and total <= 1.2 * tokens / 64 + 2
    assert packing.pack_documents(none, FILE, 1).count() == 0


def test_patterns_hold_the_histogram_and_are_few():
    rng = np.random.default_rng(5)
    for _ in range(5):
        histogram = {int(s): int(rng.integers(1, 400)) for s in rng.integers(1, 65, 12)}
        patterns = packing.plan_patterns(histogram, 64)
        got = dict.fromkeys(histogram, 0)
        for items, copies in patterns:
            assert sum(s * k for s, k in items.items()) <= 64
            for s, k in items.items():
                got[s] += k * copies
        bound = -(-sum(s * n for s, n in histogram.items()) // 64)
        large = sum(n for s, n in histogram.items() if s > 32)
        assert got == histogram and sum(c for _, c in patterns) <= 1.15 * max(bound, large) + 12
    assert packing.plan_patterns({}, 64) == [] and packing.plan_patterns({64: 3, 1: 1}, 64)


def test_knapsack_price_is_the_best():
    values, sizes = np.array([0.6, 0.35, 0.2]), np.array([6, 4, 3])
    best = max(a * 0.6 + b * 0.35 + c * 0.2 for a in range(3) for b in range(4) for c in range(6) if 6 * a + 4 * b + 3 * c <= 16)
    assert packing.best_pattern(values, sizes, 16)[0] == pytest.approx(best)
