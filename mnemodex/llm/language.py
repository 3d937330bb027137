"""Language identification: bit-sliced Bloom filters over character n-grams.

The filters of all languages lie side by side: row r of the filter is a bitmask with
one bit for each language (in as many 64-bit words as there are languages for), and the conjunction of an n-gram's rows has the bit of each
language that holds it. A text's language is the one most of its n-grams are in, after
subtracting what the filter's false positives are expected to add.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemodex.llm.common import bounded_share, cut, fresh

#: Rows of the filter (a power of two), probes for each n-gram, and bytes of an n-gram.
ROWS, PROBES, GRAM = 1 << 20, 3, 4
#: About so many documents are learned from; an n-gram belongs to a language if it was seen so often there,
#: and its share of that language's n-grams is at least so much of its largest share in any language.
MOST_DOCS, LEAST_SEEN, LEAST_SHARE = 40_000, 4, 0.2
UNKNOWN = "und"
#: Texts whose n-grams are counted at once.
COUNTED = 1000

_SPACED = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
_OTHER = regex.compile(r"[^\x00-\x7F\p{L}\p{M}]+")


def grams(text: str) -> np.ndarray:
    """Keys of the ``GRAM``-byte windows of the lower-cased text, with all but letters and their marks as spaces; no window has a space inside."""
    text = text.lower()
    if not text.isascii():
        text = _OTHER.sub(" ", text)
    raw = np.frombuffer(b" " + text.encode().translate(_SPACED) + b" ", np.uint8)
    if len(raw) < GRAM:
        return np.empty(0, np.uint32)
    x = raw.astype(np.uint32)
    fine = np.ones(len(raw) - GRAM + 1, bool)
    for i in range(1, GRAM - 1):
        fine &= raw[i : len(raw) - GRAM + 1 + i] != 32
    key = x[: len(fine)]
    for i in range(1, GRAM):
        key = (key << np.uint32(8)) | x[i : i + len(fine)]
    return key[fine]


def _rows(keys: np.ndarray):
    h = keys * np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(16)
    step = (keys * np.uint32(0x85EBCA77)) >> np.uint32(11) | np.uint32(1)
    for i in range(PROBES):
        yield (h + np.uint32(i) * step) & np.uint32(ROWS - 1)


@dataclass
class Model:
    languages: list[str]
    #: One bitmask of languages for each row: ``ROWS`` times as many words as it takes.
    filter: np.ndarray
    #: Of each language: the chance that an n-gram it lacks passes its filter.
    false_positive: np.ndarray
    #: The language with most rows, for texts that tell nothing.
    usual: int


def _count(batches):
    for batch in (whole.slice(at, COUNTED) for whole in batches for at in range(0, whole.num_rows, COUNTED)):
        keys: dict[int, list[np.ndarray]] = {}
        for text, lang in zip(batch.column("text"), batch.column("lang").to_pylist()):
            keys.setdefault(lang, []).append(grams(text.as_py()))
        out = [[], [], []]
        for lang, found in keys.items():
            key, n = np.unique(np.concatenate(found), return_counts=True)
            out[0] += [lang] * len(key)
            out[1].append(key.astype(np.int64))
            out[2].append(n)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), *(pa.array(np.concatenate(x) if x else [], pa.int64()) for x in out[1:])], names=["lang", "key", "n"])


def train(docs: DataFrame, learn: Column, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", most: int = MOST_DOCS) -> Model:
    """The filter learned from the texts of known language for which ``learn`` holds.

    About ``most`` documents are used, chosen by a hash of the id where there are more. The filter has ``ROWS``
    rows whatever the corpus. Its counts are summed by Spark; only row numbers and masks reach the driver, at most ``ROWS`` for every 64 languages.
    Rows whose id, text or language is null are passed over; repeated rows count as often as they occur.
    """
    rows = docs.filter(learn).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.filter("doc_id is not null and text is not null and lang is not null")
    rows = bounded_share(rows, F.col("doc_id"), most)
    counts = cut(rows.select("text", "lang").mapInArrow(_count, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n")))
    totals = {r[0]: r[1] for r in counts.groupBy("lang").agg(F.sum("n")).collect()}
    languages = sorted(totals)
    if not languages:
        return Model([], np.zeros((ROWS, 1), np.uint64), np.zeros(0), 0)
    spark = docs.sparkSession
    known = spark.createDataFrame([(x, i, float(totals[x])) for i, x in enumerate(languages)], "lang string, bit int, total double")
    shares = counts.join(F.broadcast(known), "lang").withColumn("share", F.col("n") / F.col("total"))
    best = shares.groupBy("key").agg(F.max("share").alias("best"))
    member = shares.filter(F.col("n") >= LEAST_SEEN).join(best, "key").filter(F.col("share") >= LEAST_SHARE * F.col("best"))

    def place(batches):
        for batch in batches:
            key, bit = batch.column("key").to_numpy().astype(np.uint32), batch.column("bit").to_numpy()
            row = np.concatenate([r.astype(np.int64) for r in _rows(key)]) if len(key) else np.empty(0, np.int64)
            mask = np.int64(1) << (bit % 64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(np.tile(bit // 64, PROBES)), pa.array(np.tile(mask, PROBES))], names=["row", "word", "mask"])

    placed = member.select("key", "bit").mapInArrow(place, "row long, word int, mask long").groupBy("row", "word").agg(F.bit_or("mask").alias("mask"))
    filled = np.zeros((ROWS, -(-len(languages) // 64)), np.uint64)
    for row, word, mask in placed.collect():
        filled[row, word] = np.uint64(mask & 0xFFFFFFFFFFFFFFFF)
    density = np.array([((filled[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(languages))])
    return Model(languages, filled, density**PROBES, languages.index(max(languages, key=totals.get)))


def decide(text: str | None, model: Model) -> tuple[str, float]:
    """The language of a text and the corrected share of its n-grams that are in it."""
    if not text or not model.languages or not any(map(str.isalpha, text)):
        return UNKNOWN, 0.0
    keys = grams(text)
    if not len(keys):
        return model.languages[model.usual], 0.0
    mask = None
    for row in _rows(keys):
        mask = model.filter[row] if mask is None else mask & model.filter[row]
    hits = np.array([np.count_nonzero(mask[:, i // 64] & np.uint64(1 << i % 64)) for i in range(len(model.languages))])
    share = np.clip((hits / len(keys) - model.false_positive) / (1 - model.false_positive), 0, 1)
    best = int(share.argmax()) if share.any() else model.usual
    return model.languages[best], float(share[best])


def identify(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None, id_col: str = "doc_id") -> DataFrame:
    """``keep`` columns of ``docs`` (its id by default), ``lang_pred`` and ``score`` (0 to 1): one row for each row.

    ``lang_pred`` is a learned language, or ``und`` if the text is null or has no letter; the score is then 0. A text
    whose letters tell nothing gets the language with most rows and score 0, and of equal shares the first language in order wins. Columns
    of the results' names in ``keep`` are replaced.
    """
    out = ["lang_pred", "score"]
    keep = [c for c in ([id_col] if keep is None else keep) if c not in out]
    name = fresh("text", [*keep, *out])
    rows = docs.select(*keep, F.col(text_col).cast("string").alias(name))
    schema = rows.select(*keep).withColumn("lang_pred", F.lit("")).withColumn("score", F.lit(0.0)).schema
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = held.value
        for batch in batches:
            found = [decide(t.as_py(), m) for t in batch.column(name)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=[*keep, "lang_pred", "score"])

    return rows.mapInArrow(run, schema)
