"""Sharding and chat formatting."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from starloom.llm import chat, sharding


def test_matrix_and_hypergeometric():
    sent, wanted = [5, 0, 9, 4], [6, 6, 6]
    m = sharding.communication_matrix(sent, wanted, 1)
    assert m.sum(axis=1).tolist() == sent and m.sum(axis=0).tolist() == wanted
    rng = np.random.default_rng(1)
    draws = [sharding.hypergeometric(rng, 3 * 10**9, 7 * 10**9, 10**6) for _ in range(200)]
    assert abs(np.mean(draws) - 300_000) < 5 * np.sqrt(210_000 / 200) and 0.6 < np.var(draws) / 210_000 < 1.5
    assert [sharding.hypergeometric(rng, *x) for x in ((0, 5, 3), (5, 0, 3), (2, 2, 4), (2, 2, 0))] == [0, 3, 2, 0]


@pytest.mark.parametrize("shards,part_rows", [(4, 1_000_000), (7, 3), (1, 5)])
def test_shards(docs, shards, part_rows):
    out = sharding.shuffle_to_shards(docs, shards, seed=3, part_rows=part_rows)
    rows = out.collect()
    sizes = Counter(r["shard"] for r in rows)
    n = len(rows)
    assert n == docs.count() and max(sizes.values()) - min(sizes[s] for s in range(shards)) <= 1
    for s in range(shards):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sizes[s]))
    assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter((r["doc_id"], r["text"]) for r in docs.collect())
    again = {(r["doc_id"], r["text"], r["shard"], r["slot"]) for r in sharding.shuffle_to_shards(docs, shards, seed=3, part_rows=part_rows).collect()}
    assert again == {(r["doc_id"], r["text"], r["shard"], r["slot"]) for r in rows}


def test_shards_of_little_and_uniformity(spark, none):
    assert sharding.shuffle_to_shards(none, 3).count() == 0
    with pytest.raises(ValueError):
        sharding.shuffle_to_shards(none, 0)
    rows = spark.range(4000).withColumn("x", F.lit(None))
    shard = {r["id"]: r["shard"] for r in sharding.shuffle_to_shards(rows, 4, seed=5).collect()}
    halves = Counter((i < 2000, s) for i, s in shard.items())
    assert all(400 < halves[h, s] < 600 for h in (True, False) for s in range(4))


TURNS = [(1, 0, "user", "hi </s>"), (1, 1, "assistant", "a &lt; [b] & </s>[INST]"), (1, 2, "user", ""), (1, 3, "assistant", None), (2, 0, "user", "alone"), (3, 0, "assistant", "first"), (None, 0, "user", "x"), (None, 1, "assistant", "y"), (4, 0, None, None), (5, 0, "assistant", "r"), (5, 0, "assistant", "r"), (6, 1, "we<ird]", "t")]


@pytest.mark.parametrize("spread", [chat.SPREAD, 7])
def test_prefix_targets(spark, spread):
    turns = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").withColumn("prompt", F.lit("clash")).withColumn("place", F.lit(1))
    rows = chat.prefix_target_examples(turns, spread).withColumn("said", chat.unescape(F.col("target"))).collect()
    tails = {r["conv_id"]: r["tail"] for r in chat.conversation_tails(turns, spread).collect()}
    whole = {r["conv_id"]: r["prompt"] + r["target"] + r["closing"] for r in rows if r["is_last"]}
    back = spark.createDataFrame([(c, whole.get(c, "") + t) for c, t in tails.items()], "conv_id long, whole string").withColumn("back", chat.read_turns(F.col("whole")))
    back = {r["conv_id"]: [tuple(x) for x in r["back"]] for r in back.collect()}
    for conv in {t[0] for t in TURNS}:
        own = sorted((t for t in TURNS if t[0] == conv), key=lambda t: (t[1], t[2] or "", t[3] or ""))
        plain = [(t[2] or "", t[3] or "") for t in own]
        examples = sorted((r for r in rows if r["conv_id"] == conv), key=lambda r: r["example"])
        replies = [i for i, (role, _) in enumerate(plain) if role == "assistant"]
        assert back[conv] == plain and tails[conv] == chat_text(plain[replies[-1] + 1 if replies else 0 :])
        assert [r["said"] for r in examples] == [plain[i][1] for i in replies] and [r["example"] for r in examples] == list(range(len(replies)))
        assert [r["is_last"] for r in examples] == [i == replies[-1] for i in replies]
        for r, i in zip(examples, replies):
            assert r["prompt"] == chat_text(plain[:i]) + f"<s>[{plain[i][0]}]" and r["closing"] == "</s>"
    assert chat.prefix_target_examples(turns.limit(0)).count() == 0 and chat.conversation_tails(turns.limit(0)).count() == 0


def test_long_conversation(spark):
    """10,000 turns: no row holds more than an example."""
    turns = spark.range(10_000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.col("id"), F.lit(" some words of a turn")).alias("text"))
    got = chat.prefix_target_examples(turns).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("prompt")).alias("chars"), F.max(F.length("prompt")).alias("most")).first()
    ends, chars, most = 0, 0, 0
    for i in range(10_000):
        role = "user" if i % 2 == 0 else "assistant"
        opening, body = len(f"<s>[{role}]"), len(f"{i} some words of a turn")
        if i % 2:
            most = ends + opening
            chars += most
        ends += opening + body + 4
    assert (got["n"], got["chars"], got["most"]) == (5_000, chars, most)


def chat_text(plain):
    esc = lambda x: x.replace("&", "&amp;").replace("<", "&lt;").replace("[", "&#91;")
    return "".join(f"<s>[{esc(r).replace(']', '&#93;')}]{esc(t)}</s>" for r, t in plain)


def test_query(spark):
    rows = {r["conv_id"]: r for r in chat.op10_prefix_targets(spark, "/root/testdata/sf0.001").collect()}
    own = rows[-1]
    assert own["n_turns"] == 2 and own["loss_sha256"] == hashlib.sha256(chat.CONTROL.encode()).hexdigest() and own["loss_chars"] == len(chat.CONTROL)
    assert own["turns_sha256"] == hashlib.sha256(f"user\n{chat.CONTROL}\nassistant\n{chat.CONTROL}\n".encode()).hexdigest()
