"""Quality classifier: hashed word n-grams, logistic regression by FTRL, sparse dot products."""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh32_intdigest

from mnemodex.llm.common import LOWER, bounded_share, cut, fresh

#: Hash buckets (a power of two), and the seeds of the two views' n-grams.
DIM = 1 << 18
#: At most about so many labelled rows are learned from, by so many independent learners whose weights are averaged.
MOST_ROWS, SHARDS, EPOCHS = 24_000, 4, 5
ALPHA, BETA, L1, L2 = 1.0, 0.05, 0.0005, 0.0

_LETTERS = bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))


def _grams(words: list[bytes], seed: int) -> list[np.ndarray]:
    one = np.fromiter(map(xxh32_intdigest, words, repeat(seed)), np.uint32, len(words))
    two = (one[:-1] * np.uint32(0x9E3779B1)) ^ (one[1:] * np.uint32(0x85EBCA77)) ^ np.uint32(seed)
    again = np.full(np.count_nonzero(one[:-1] == one[1:]), seed, np.uint32)  # "x x", whatever x is
    return [one, two ^ (two >> np.uint32(15)), again]


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of a text's word 1- and 2-grams, with length 1 together.

    There are two views of the text: its lower-cased words, and what is left of them without letters
    (punctuation, digits, signs), so that noise is seen however rare the words that carry it are.
    """
    raw = (text or "").encode()
    grams = _grams(raw.translate(LOWER).split(), 1) + _grams(raw.translate(None, _LETTERS).split(), 2)
    index, count = np.unique(np.concatenate(grams) & np.uint32(DIM - 1), return_counts=True)
    value = 1 + np.log(count)
    return index.astype(np.int64), value / np.sqrt((value * value).sum()) if len(value) else value


def _probability(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS) -> np.ndarray:
    """Weights after follow-the-regularised-leader updates over ``rows``; the last weight is the bias."""
    z, n = np.zeros(DIM + 1), np.zeros(DIM + 1)
    for _ in range(epochs):
        for index, value, label in rows:
            index, value = np.append(index, DIM), np.append(value, 1.0)
            zi, ni = z[index], n[index]
            w = -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2) * (np.abs(zi) > L1)
            g = (_probability(w @ value) - label) * value
            z[index] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w
            n[index] = ni + g * g
    return -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2) * (np.abs(z) > L1)


def _features(batches):
    for whole in batches:
        for at in range(0, whole.num_rows, 500):
            batch = whole.slice(at, 500)
            found = [features(t.as_py()) for t in batch.column("text")]
            sizes = pa.array(np.append(0, np.cumsum([len(x[0]) for x in found])).astype(np.int32))
            lists = [pa.ListArray.from_arrays(sizes, pa.array(np.concatenate([x[i] for x in found]).astype(kind))) for i, kind in ((0, np.int32), (1, np.float32))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), *lists], names=["doc_id", "label", "index", "value"])


def _learn(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by([("doc_id", "ascending")])
    order = np.random.default_rng(7).permutation(rows.num_rows).tolist()
    index, value, labels = rows["index"], rows["value"], rows["label"].to_pylist()
    w = ftrl([(index[i].values.to_numpy(), value[i].values.to_numpy(), labels[i]) for i in order])
    used = np.union1d(np.nonzero(w)[0], [DIM])  # the bias is always listed, so that learners can be counted
    return pa.table({"index": used, "weight": w[used]})


def train(docs: DataFrame, labels: DataFrame, label: str, learn: Column, id_col: str = "doc_id", text_col: str = "text", most: int = MOST_ROWS) -> np.ndarray:
    """Weights (DIM + 1 numbers, so the model's size is fixed) from the labelled rows for which ``learn`` holds.

    About ``most`` labelled ids are used (chosen by a hash of the id where there are more), in ``SHARDS`` groups that learn
    side by side; the weights of the groups that have rows are averaged. Null labels and ids are passed over; of rows that share an id the
    largest label and the smallest text count. Without any row all weights are zero.
    """
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).filter("doc_id is not null and label is not null")
    marked = bounded_share(marked.filter(learn), F.col("doc_id"), most).groupBy("doc_id").agg(F.max("label").alias("label"))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # The marked ids are bounded by ``most``, so they are sent to the texts and not the texts to them.
    rows = texts.join(F.broadcast(marked), "doc_id").groupBy("doc_id").agg(F.first("label").alias("label"), F.min("text").alias("text"))
    rows = rows.mapInArrow(_features, "doc_id long, label int, index array<int>, value array<float>")
    learned = cut(rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(SHARDS))).groupBy("shard").applyInArrow(_learn, "index long, weight double"))
    learners = learned.filter(F.col("index") == DIM).count()
    weights = np.zeros(DIM + 1)
    for index, weight in learned.groupBy("index").agg(F.sum("weight")).collect():
        weights[index] = weight / learners
    return weights


def score(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of ``docs`` (its id by default) and ``score``: one row for each row, scored over its whole text.

    A null text is an empty one; that gets the bias alone. Repeated rows and null ids are scored like any other. A column ``score`` in ``keep`` is replaced.
    """
    held = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))
    keep = [c for c in ([id_col] if keep is None else keep) if c != "score"]
    name = fresh("text", [*keep, "score"])
    rows = docs.select(*keep, F.col(text_col).cast("string").alias(name))
    schema = rows.select(*keep).withColumn("score", F.lit(0.0)).schema

    def run(batches):
        w = held.value
        for batch in batches:
            out, texts = np.empty(batch.num_rows), batch.column(name)
            for i in range(batch.num_rows):
                index, value = features(texts[i].as_py())
                out[i] = w[index] @ value + w[DIM]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(_probability(out))], names=[*keep, "score"])

    return rows.mapInArrow(run, schema)
