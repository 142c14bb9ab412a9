"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i (v_if x_i)^2]); the last form takes time linear
in the features that a text has. It is fitted on a bounded sample of labelled rows, whose features come from Spark;
scoring is a map over all rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACES, Words, byte_table, runs

#: Hash buckets of words, rank of the interactions, quantile bins of a statistic.
BUCKETS, RANK, BINS = 1 << 12, 8, 8
#: Labelled rows that the fit takes at most: those with the least hash of their doc_id.
SAMPLE_ROWS = 20_000
STATISTICS = ["log_words", "log_chars", "word_length", "word_spread", "upper", "digits", "symbols", "points", "spaces", "distinct", "top_word", "log_lines", "line_words", "line_repeats", "line_ends", "pipes", "exclaims", "pair_repeats", "capital_words", "non_ascii", "longest_word"]
CLASSES = np.zeros(256, np.uint8)
for _i, _set in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#$%&*+/<=>@\\^_`{}~|", b".,;:!?'\"()-", b" \t\n\r"), 1):
    CLASSES[list(_set)] = _i
CLASSES[128:] = 6
LOWER = byte_table(SPACES, lower=True)


def statistics(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray, text: str) -> list[float]:
    """The structure statistics of a text, in the order of STATISTICS: from its bytes and its words' places there."""
    kinds = np.bincount(CLASSES[raw], minlength=7) / max(1, len(raw))
    words, n = len(h), max(1, len(h))
    lengths = ends - starts if words else np.zeros(1)
    lines = [x for x in text.split("\n") if x.strip()]
    counts = np.unique(h, return_counts=True)[1] if words else np.ones(1)
    pairs = h[:-1] * np.uint64(3) + h[1:]
    return [
        np.log1p(words), np.log1p(len(text)), lengths.mean(), lengths.std(), *kinds[1:6], len(counts) / n, counts.max() / n,
        np.log1p(len(lines)), n / max(1, len(lines)), 1 - len(set(lines)) / max(1, len(lines)), sum(x.rstrip()[-1] in ".!?" for x in lines) / max(1, len(lines)),
        text.count("|") / n, text.count("!") / n, 1 - len(np.unique(pairs)) / max(1, len(pairs)), float((CLASSES[raw[starts]] == 1).sum()) / n,
        kinds[6], np.log1p(lengths.max()),
    ]


def features(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, list[float]]]:
    """Of each text, (bucket, value) of the hashed words, values with length 1, and the statistics. Null is empty."""
    for at, n in runs(texts):
        some = texts.slice(at, n)
        words = Words(some, LOWER)
        for i, text in enumerate(some.to_pylist()):
            part = slice(words.offsets[i], words.offsets[i + 1])
            first, last = words.text_bounds[i], words.text_bounds[i + 1]
            h = words.hash[part]
            bucket, count = np.unique((h >> np.uint64(20)).astype(np.int64) % BUCKETS, return_counts=True)
            value = np.log1p(count)
            yield bucket, value / max(1e-9, float(np.sqrt((value**2).sum()))), statistics(words.raw[first:last], words.start[part] - first, words.end[part] - first, h, text or "")


@dataclass
class FactorisationMachine:
    """Weights, and the means, spreads and bin limits of the dense columns (statistics and metadata)."""

    bias: float
    weight: np.ndarray
    factor: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    limits: np.ndarray

    def place(self, dense: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, value) of one row's dense columns: standardised values, and which bin each is in."""
        k = len(dense)
        dense = np.where(np.isfinite(dense), dense, self.mean)
        value = np.clip((dense - self.mean) / self.spread, -5, 5) / 5
        bins = (dense[:, None] > self.limits).sum(axis=1)
        return np.r_[BUCKETS + np.arange(k), BUCKETS + k + np.arange(k) * BINS + bins], np.r_[value, np.full(k, 1 / np.sqrt(k))]

    def score(self, bucket: np.ndarray, value: np.ndarray, dense: np.ndarray) -> float:
        index, more = self.place(dense)
        index, x = np.r_[bucket, index], np.r_[value, more]
        vx = self.factor[index] * x[:, None]
        y = self.bias + self.weight[index] @ x + 0.5 * ((vx.sum(axis=0) ** 2).sum() - (vx**2).sum())
        return float(1 / (1 + np.exp(-np.clip(y, -30, 30))))


def fit(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray, float]], rank: int = RANK, epochs: int = 30, batch: int = 256, rate: float = 0.02, decay: float = 1e-4, seed: int = 9) -> FactorisationMachine:
    """A machine fitted to rows of (bucket, value, dense, label) by Adam on the logistic loss.

    No rows give a machine that scores 0.5; labels of one kind one that scores near that kind.
    """
    k = len(rows[0][2]) if rows else len(STATISTICS)
    size = BUCKETS + k + k * BINS
    rng = np.random.default_rng(seed)
    weight, factor = np.zeros(size, np.float32), rng.normal(0, 0.02, (size, rank)).astype(np.float32)
    dense = np.array([r[2] for r in rows], float).reshape(-1, k)
    dense = np.where(np.isfinite(dense), dense, np.nan)
    some = np.where(np.isnan(dense).all(axis=0), 0.0, dense) if len(rows) else np.zeros((1, k))
    mean, spread = np.nanmean(some, axis=0), np.nanstd(some, axis=0) + 1e-6
    limits = np.nanquantile(some, np.arange(1, BINS) / BINS, axis=0).T
    machine = FactorisationMachine(0.0, weight, factor, mean, spread, limits)
    if not rows:
        factor[:] = 0
        return machine
    label = np.array([r[3] for r in rows], np.float32)
    rate_of_1 = float(np.clip(label.mean(), 1e-3, 1 - 1e-3))
    machine.bias = float(np.log(rate_of_1 / (1 - rate_of_1)))
    placed = []
    for bucket, value, d, _ in rows:
        index, more = machine.place(np.asarray(d, float))
        placed.append((np.r_[bucket, index].astype(np.int32), np.r_[value, more].astype(np.float32)))
    params = [weight, factor, np.array([machine.bias], np.float32)]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), batch):
            chosen = order[at : at + batch]
            used, inverse = np.unique(np.concatenate([placed[i][0] for i in chosen]), return_inverse=True)
            x = np.zeros((len(chosen), len(used)), np.float32)
            x[np.repeat(np.arange(len(chosen)), [len(placed[i][0]) for i in chosen]), inverse] = np.concatenate([placed[i][1] for i in chosen])
            w, v = params[0][used], params[1][used]
            xv, x2 = x @ v, x * x
            y = params[2] + x @ w + 0.5 * ((xv**2).sum(axis=1) - x2 @ (v**2).sum(axis=1))
            error = (1 / (1 + np.exp(-np.clip(y, -30, 30))) - label[chosen]) / len(chosen)
            grads = [x.T @ error + decay * w, x.T @ (error[:, None] * xv) - v * (x2.T @ error)[:, None] + decay * v, np.array([error.sum()], np.float32)]
            step += 1
            for p, m, s, g, place in zip(params, first, second, grads, (used, used, slice(None))):
                m[place] = 0.9 * m[place] + 0.1 * g
                s[place] = 0.999 * s[place] + 0.001 * g * g
                p[place] -= rate * (m[place] / (1 - 0.9**step)) / (np.sqrt(s[place] / (1 - 0.999**step)) + 1e-8)
    machine.weight, machine.factor, machine.bias = params[0], params[1], float(params[2][0])
    return machine


def train(docs: DataFrame, labels: DataFrame, metadata: list[str] | None = None, sample_rows: int = SAMPLE_ROWS) -> FactorisationMachine:
    """Fit on docs (doc_id, text, numeric metadata columns) and labels (doc_id, quality 0 or 1).

    At most sample_rows labelled ids are taken, by the least hash of the id; their features (not their texts) are
    gathered in one task, and the driver gets the machine only. Null ids and null labels are left out; an id with
    several labels has their mean, rounded; a text that repeats under an id counts each time, but no more than
    sample_rows rows in all are taken.
    """
    meta = metadata or []
    chosen = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(F.round(F.avg("quality")).alias("_label")).orderBy(F.xxhash64("_id", F.lit(9)), "_id").limit(sample_rows)
    picked = docs.select(F.col("doc_id").alias("_id"), "text", *(F.col(c).cast("double").alias(f"_m{i}") for i, c in enumerate(meta))).join(F.broadcast(chosen), "_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            others = zip(*(c.to_pylist() for c in batch.columns[2:]))
            for (*more, label), (bucket, value, dense) in zip(others, features(batch.column(1))):
                wide = np.array([*dense, *(np.nan if m is None else m for m in more)], np.float64)
                out.append((bucket.astype(np.uint16).tobytes(), value.astype(np.float32).tobytes(), wide.tobytes(), label))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else ((),) * 4, (pa.binary(), pa.binary(), pa.binary(), pa.float64()))], ["bucket", "value", "dense", "label"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [*batches]
        if held:
            rows = pa.Table.from_batches(held).combine_chunks()
            gathered = sorted(zip(*(rows.column(i).to_pylist() for i in (2, 0, 1, 3))))  # the order that rows arrive in doesn't matter
            machine = fit([(np.frombuffer(b, np.uint16), np.frombuffer(v, np.float32), np.frombuffer(d), y) for d, b, v, y in gathered])
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(machine)], pa.binary())], ["machine"])

    sample = picked.mapInArrow(run, "bucket binary, value binary, dense binary, label double").limit(sample_rows)
    learnt = sample.mapInArrow(learn, "machine binary").first()
    return pickle.loads(learnt["machine"]) if learnt else fit([])


def score_quality(docs: DataFrame, machine: FactorisationMachine, metadata: list[str] | None = None) -> DataFrame:
    """docs (text, the machine's metadata columns and any others) with score (double, 0 to 1).

    Null and empty texts, and null metadata, have a score as well. A score column is replaced.
    """
    meta = metadata or []
    base = docs.drop("score")
    given = base.withColumns({f"_m{i}": F.col(c).cast("double") for i, c in enumerate(meta)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            stay = [i for i, c in enumerate(names) if c not in {f"_m{j}" for j in range(len(meta))}]
            more = [batch.column(names.index(f"_m{j}")).to_pylist() for j in range(len(meta))]
            scores = []
            for i, (bucket, value, dense) in enumerate(features(batch.column(names.index("text")))):
                scores.append(machine.score(bucket, value, np.array([*dense, *(np.nan if m[i] is None else m[i] for m in more)])))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in stay), pa.array(scores, pa.float64())], [*(names[i] for i in stay), "score"])

    return given.mapInArrow(run, T.StructType([*base.schema.fields, T.StructField("score", T.DoubleType())]))


def held_out(doc_id: str) -> Column:
    """Rows that no model learns from."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def op9_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "n_chars")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality").where(~held_out("doc_id"))
    scored = score_quality(docs, train(docs, labels, ["n_chars"]), ["n_chars"])
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
