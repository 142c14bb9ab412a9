"""The quality classifier and decontamination."""

import os

import numpy as np
import pyarrow as pa
import pytest
from fixtures import make
from pyspark.sql import functions as F

from starloom.llm import contamination, quality

SF = "/root/testdata/sf0.01"


def test_linear_time_form_is_the_pairwise_sum():
    rng = np.random.default_rng(0)
    rows = [(np.array([3, 9, 70]), np.array([0.5, 0.7, 0.5]), rng.normal(size=4), float(i % 2)) for i in range(30)]
    machine = quality.fit(rows, epochs=2)
    bucket, value, dense, _ = rows[0]
    index, more = machine.place(dense)
    index, x = np.r_[bucket, index], np.r_[value, more]
    y = machine.bias + machine.weight[index] @ x
    y += sum(machine.factor[index[i]] @ machine.factor[index[j]] * x[i] * x[j] for i in range(len(x)) for j in range(i))
    assert machine.score(bucket, value, dense) == pytest.approx(1 / (1 + np.exp(-y)), rel=1e-4)


def test_held_out_accuracy_and_sources_are_not_inputs(spark):
    rows = quality.op9_factorisation_machine(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(rows) > 50 and np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.9
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)


def test_little_to_learn_from(spark, docs, none):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None), (4, 1)], "doc_id long, quality int")
    machine = quality.train(docs, labels)
    out = quality.score_quality(docs, machine)
    assert out.columns == [*(c for c in docs.columns if c != "score"), "score"] and out.count() == docs.count() and out.where("score IS NULL OR NOT score BETWEEN 0 AND 1").isEmpty()
    assert quality.train(docs, labels.limit(0)).score(np.array([], int), np.array([]), np.zeros(len(quality.STATISTICS))) == pytest.approx(0.5)
    assert quality.score_quality(none, machine).count() == 0
    again = quality.train(docs.repartition(2), labels)
    assert (again.weight == machine.weight).all()


def test_the_driver_holds_no_sample(spark, docs, tmp_path, monkeypatch):
    """The machine is fitted in a task: labelled rows' features don't come to the driver."""
    fit, path = quality.fit, str(tmp_path / "pid")

    def noted(rows):
        with open(path, "w") as out:
            out.write(str(os.getpid()))
        return fit(rows)

    labels = spark.createDataFrame([(1, 1), (2, 0), (4, 1)], "doc_id long, quality int")
    monkeypatch.setattr(quality, "fit", noted)
    assert quality.train(docs, labels).weight.any()
    assert (tmp_path / "pid").read_text() != str(os.getpid())


ITEM = "Maria buys 12 boxes of apples in Lisbon for 30 dollars each, and then sells 7 of them to Peter. How much money did Maria spend on the boxes that she keeps?"
CHANGED = ITEM.replace("Maria", "Anna").replace("12", "48").replace("30", "25").replace("7 of", "9 of").replace("Peter", "Tom").replace("Lisbon", "Berlin")
CLEAN = "The river ran past the old stone bridge, and the lanterns of the market were lit long before the winter evening came down over the harbor."


def test_templates(spark):
    rows = [(1, f"Some words first. {ITEM} And more."), (2, f"Some words first. {CHANGED} And more."), (3, CLEAN), (4, None), (5, ""), (6, ITEM.upper()), (None, ITEM), (7, " ".join(ITEM.split()[:6]))]
    docs = make(spark, rows).withColumnRenamed("doc_id", "doc")
    items = spark.createDataFrame([(10, ITEM), (10, ITEM), (11, None), (12, ""), (None, ITEM), (13, "Tiny item")], "item long, text string").withColumn("doc", F.lit(0))
    for probe_windows in (10**6, 0):
        found = {(r["doc"], r["item"]): r for r in contamination.contaminated(docs, items, probe_windows=probe_windows).collect()}
        assert set(found) >= {(1, 10), (2, 10)} and {d for d, _ in found} <= {1, 2, 6}
        assert found[1, 10]["coverage"] == 1 and found[2, 10]["exact_windows"] < found[2, 10]["matched_windows"]
    assert contamination.contaminated(docs, items.limit(0)).count() == 0 and contamination.contaminated(docs.limit(0), items).count() == 0


def test_slots_must_be_consistent(spark):
    """The same shape with a value that changes its meaning on the way counts less than a consistent change."""
    item = "At noon Maria buys 12 boxes of apples and then Maria sells 12 of the boxes to Peter, while Peter keeps 12 of the old crates in the yard for Maria"
    same = item.replace("Maria", "Anna").replace("Peter", "Tom").replace("12", "48")
    mixed = same.replace("48", "49", 1).replace("keeps 48", "keeps 50")
    docs = spark.createDataFrame([(1, same), (2, mixed)], "doc long, text string")
    items = spark.createDataFrame([(10, item)], "item long, text string")
    found = {r["doc"]: r for r in contamination.contaminated(docs, items, coverage=0.0).collect()}
    assert found[1]["matched_windows"] == found[1]["item_windows"] > found[2]["matched_windows"] > 0


def test_canonical_tokens():
    text = "Then Maria Lopez paid 3.5 kg and 1,000 dollars. Paris is big."
    _, kind, _, offsets = contamination.canonical(pa.array([text, None, ""]))
    assert kind.tolist() == [0, 2, 0, 1, 3, 0, 1, 3, 0, 0, 0] and offsets.tolist() == [0, 11, 11, 11]


def test_benchmark_passages_are_found(spark):
    items = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").limit(8)
    clean = [(i, CLEAN + f" It was {i}.") for i in range(100, 110)]
    planted = [(r["item_id"], f"{CLEAN} {r['text']} {CLEAN}") for r in items.collect()]
    docs = spark.createDataFrame([*planted, *clean], "doc long, text string")
    found = {(r["doc"], r["item"]) for r in contamination.contaminated(docs, items.withColumnRenamed("item_id", "item")).collect()}
    assert {(d, d) for d, _ in planted} <= found and not [d for d, _ in found if d >= 100]


def test_names_that_open_sentences(spark):
    item = "Tom has 12 apples. Tom gives Anna 5 apples. How many apples does Tom have left?"
    once = "Tom has 12 apples and gives 5 apples to the boy who lives next door. How many are left?"
    changed = [x.replace("Tom", "Bill").replace("Anna", "Eve").replace("12", "31").replace("5", "8") for x in (item, once)]
    docs = spark.createDataFrame([(1, f"{CLEAN} {changed[0]} {CLEAN}"), (2, f"{CLEAN} {changed[1]} {CLEAN}"), (3, f"Question: {changed[0]}"), (4, CLEAN)], "doc long, text string")
    items = spark.createDataFrame([(10, item), (11, once)], "item long, text string")
    found = {(r["doc"], r["item"]): r["coverage"] for r in contamination.contaminated(docs, items).collect()}
    assert set(found) == {(1, 10), (2, 11), (3, 10)} and min(found.values()) > 0.75


def test_short_items_and_long_passages(spark):
    words = [f"{a}{b}" for a in ("stone", "river", "lamp", "wind") for b in ("ar", "el", "is", "on", "um")] * 10
    long = " ".join(w + str("xyz"[i % 3]) * (i // 20 + 1) for i, w in enumerate(words))
    part = " ".join(long.split()[90:150])
    docs = spark.createDataFrame([(1, f"{CLEAN} Who wrote the tale of Ulm? {CLEAN}"), (2, f"{CLEAN} {part} {CLEAN}"), (3, f"{CLEAN} {' '.join(long.split()[90:101])} {CLEAN}"), (4, CLEAN)], "doc long, text string")
    items = spark.createDataFrame([(10, "Who wrote the tale of Ulm?"), (11, long)], "item long, text string")
    for probe_windows in (10**6, 0):
        assert {(r["doc"], r["item"]) for r in contamination.contaminated(docs, items, probe_windows=probe_windows).collect()} == {(1, 10), (2, 11)}
