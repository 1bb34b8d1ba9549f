"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed n-grams of one to three characters of a whole text in lower case, runs
of other characters than letters counting as one blank.  Document frequencies are counted
over all training rows.  The weights are fitted by follow-the-regularised-leader with
elastic-net penalties on a bounded sample of them, and a temperature is calibrated on
sample rows left out of the fit.  A text's term frequencies are relative to its n-grams, so
its scores are the mean of a table's rows: one narrow pass over all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Hashed features; n-gram lengths; characters of a text that are looked at at once.
FEATURES, ORDERS, AT_ONCE = 1 << 15, 3, 1 << 15
#: Expected most examples of a language in the sample for the fit; all below that.
EXAMPLES = 800
#: Per-coordinate learning rate, its offset, the two penalties, and rounds over the sample.
ALPHA, BETA, L1, L2, ROUNDS = 0.3, 1.0, 0.02, 0.05, 4
#: Scale of tf * idf, so that a frequent n-gram is a feature of about 1.
SCALE = 40.0


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Whether each code point below 0x10000 is a letter; those above count as letters."""
    return np.array([chr(c).isalpha() for c in range(1 << 16)])


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def ngram_parts(text: str) -> Iterator[np.ndarray]:
    """Feature of every n-gram occurrence of a whole text, of at most ``AT_ONCE`` characters at once."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4")
    solid = letters()[np.minimum(codes, 0xFFFF)] | (codes > 0xFFFF)
    codes = np.where(solid, codes, np.uint32(32))
    codes = codes[np.concatenate([[True], solid[1:] | solid[:-1]])]
    for at in range(0, len(codes), AT_ONCE):
        part = codes[at : at + AT_ONCE + ORDERS - 1].astype(np.uint64)
        out, value = [], np.zeros(min(AT_ONCE, len(part)), np.uint64)
        for n in range(ORDERS):
            value = value[: len(part) - n]
            value = value * np.uint64(0x9E3779B97F4A7C15) + part[n : n + len(value)] + np.uint64(n + 1)
            mix = value ^ (value >> np.uint64(29))
            out.append((mix * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(49))
        yield np.concatenate(out).astype(np.int64)


def term_frequencies(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The features of a whole text, ascending, and the share of its n-grams that each has."""
    total = sum(np.bincount(part, minlength=FEATURES) for part in ngram_parts(text))
    found = np.flatnonzero(total)
    return found, total[found] / max(1, total.sum())


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Documents that hold each feature, and their number, over all rows of ``text``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(FEATURES + 1, np.int64)
        for batch in batches:
            for cell in batch.column(0):
                own = np.zeros(FEATURES, bool)
                for part in ngram_parts(cell.as_py() or ""):
                    own[part] = True
                total[:-1] += own
                total[-1] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["feature", "n"])

    rows = texts.mapInArrow(count, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(FEATURES + 1, np.int64)
    for row in rows:
        total[row["feature"]] = row["n"]
    return total[:-1], int(total[-1])


def fit(texts: list[tuple[np.ndarray, np.ndarray]], langs: np.ndarray, classes: int, idf: np.ndarray, seed: int = 7) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights (features x classes), offsets and temperature, from texts' term frequencies; every fifth text calibrates only."""
    examples = [(found, (share * idf[found] * SCALE)[:, None]) for found, share in texts]
    z, n = np.zeros((FEATURES + 1, classes)), np.zeros((FEATURES + 1, classes))

    def weights(rows: np.ndarray) -> np.ndarray:
        own = z[rows]
        shrunk = np.sign(own) * np.maximum(np.abs(own) - L1, 0)
        return -shrunk / ((BETA + np.sqrt(n[rows])) / ALPHA + L2)

    def scores(k: int, w: np.ndarray) -> np.ndarray:
        return (w[:-1] * examples[k][1]).sum(0) + w[-1]

    def softmax(s: np.ndarray) -> np.ndarray:
        e = np.exp(s - s.max())
        return e / e.sum()

    order = np.random.Generator(np.random.PCG64(seed))
    taught = np.flatnonzero(np.arange(len(examples)) % 5 != 4) if len(examples) >= 20 else np.arange(len(examples))
    for _ in range(ROUNDS):
        for k in order.permutation(taught):
            rows = np.append(examples[k][0], FEATURES)
            w = weights(rows)
            error = softmax(scores(k, w))
            error[langs[k]] -= 1
            g = np.concatenate([examples[k][1], [[1.0]]]) * error
            z[rows] += g - (np.sqrt(n[rows] + g * g) - np.sqrt(n[rows])) / ALPHA * w
            n[rows] += g * g
    final = weights(np.arange(FEATURES + 1))
    left = np.setdiff1d(np.arange(len(examples)), taught)
    logits = [scores(k, np.concatenate([final[examples[k][0]], final[-1:]])) for k in left]

    def loss(t: float) -> float:
        return -sum(np.log(max(softmax(s / t)[langs[k]], 1e-12)) for s, k in zip(logits, left, strict=True))

    steps = np.exp(np.linspace(np.log(0.2), np.log(5), 41))
    return final[:-1] * idf[:, None] * SCALE, final[-1], float(min(steps, key=loss)) if logits else 1.0


def learn(train: DataFrame, lang: str, text: str, id_: str, examples: int) -> tuple[list[str], np.ndarray, np.ndarray, float] | None:
    """Languages, folded weights, offsets and temperature, from all training rows.

    The task that fits is sent term frequencies, not texts: at most ``FEATURES`` numbers for
    each of about ``examples`` texts a language.  The model grows with the languages.
    """
    spark = train.sparkSession
    counts = {r[lang]: r["n"] for r in train.groupBy(lang).agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(counts)
    if not langs:
        return None
    df, total = document_frequencies(train.select(text))
    idf = np.log((1 + total) / (1 + df)) + 1
    shares = spark.createDataFrame([(k, n, min(1.0, examples / counts[k])) for n, k in enumerate(langs)], "known string, place int, share double")
    dice = F.pmod(F.xxhash64(F.col(id_), F.lit(3)), F.lit(1 << 20)) / float(1 << 20)
    sample = train.join(F.broadcast(shares), F.col(lang) == F.col("known")).where(dice < F.col("share")).select("place", F.col(text).alias("text"), F.xxhash64(id_, text).alias("at"))

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [term_frequencies(x.as_py()) for x in batch.column("text")]
            features, parts = ([x[k].astype(t).tobytes() for x in found] for k, t in ((0, "<u2"), (1, "<f8")))
            yield pa.RecordBatch.from_arrays([batch.column("place"), batch.column("at"), pa.array(features, pa.binary()), pa.array(parts, pa.binary())], ["place", "at", "features", "parts"])

    def on_one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["at", "place", "features"])
        texts = [(np.frombuffer(f, "<u2").astype(np.int64), np.frombuffer(p, "<f8")) for f, p in zip(rows["features"], rows["parts"], strict=True)]
        w, b, t = fit(texts, rows["place"].to_numpy(), len(langs), idf)
        return pd.DataFrame({"w": [w.astype("<f4").tobytes()], "b": [b.astype("<f8").tobytes()], "t": [t]})

    short = sample.mapInArrow(shorten, "place int, at long, features binary, parts binary")
    got = short.groupBy(F.lit(0).alias("one")).applyInPandas(on_one, "w binary, b binary, t double").first()
    if got is None:
        return None
    return langs, np.frombuffer(got["w"], "<f4").reshape(FEATURES, len(langs)), np.frombuffer(got["b"], "<f8"), got["t"]


def held_out(id_: str):
    return F.coalesce(F.crc32(F.col(id_).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def predicted(text: str | None, model: tuple[list[str], np.ndarray, np.ndarray, float] | None) -> tuple[str, float]:
    """Language and calibrated probability of one text; ``und`` and 0 if there is nothing to tell it by."""
    if model is None or not has_letter(text):
        return "und", 0.0
    langs, w, b, t = model
    total, n = np.zeros(len(langs)), 0
    for part in ngram_parts(text):
        total += w[part].sum(0, dtype=np.float64)
        n += len(part)
    s = (total / n + b) / t
    e = np.exp(s - s.max())
    best = int(e.argmax())
    return langs[best], float(e[best] / e.sum())


def model_of(labelled: DataFrame, examples: int, id_col: str, text_col: str, lang_col: str):
    """A broadcast model, learned from the rows whose crc32(id) mod 3 is not 1 and that have id, text and language."""
    train = labelled.where(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(id_col, text_col, lang_col)
    return labelled.sparkSession.sparkContext.broadcast(learn(train, lang_col, text_col, id_col, examples))


def with_language(rows: DataFrame, model, text_col: str, names: tuple[str, str], drop: bool = False) -> DataFrame:
    """``rows`` with two more columns, prediction and probability; ``drop`` leaves out the text."""
    kept = [c for c in rows.columns if not (drop and c == text_col)]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned = model.value
        for batch in batches:
            found = [predicted(x.as_py(), learned) for x in batch.column(text_col)]
            said = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *said], [*kept, *names])

    schema = T.StructType([*(rows.schema[c] for c in kept), T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    return rows.mapInArrow(predict, schema)


def identify(docs: DataFrame, *, labelled: DataFrame | None = None, examples: int = EXAMPLES, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``id, held_out, lang_pred, score`` of every row.

    The model learns from ``labelled`` (default: the rows themselves), of which rows whose
    crc32(id) mod 3 is 1 and rows without id or language are left out.  ``score`` is the
    calibrated probability of the prediction.  Null texts and texts without a letter are
    ``und`` with score 0, as is everything if nothing is labelled.  Repeated rows are judged
    alike, a row without an id by its text; very long texts are read whole, a part at a time.
    """
    model = model_of(docs if labelled is None else labelled, examples, id_col, text_col, lang_col)
    rows = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return with_language(rows, model, "text", ("lang_pred", "score"), drop=True).withColumnRenamed("id", id_col)


def spoken(docs: DataFrame, least: float, *, examples: int = EXAMPLES, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs``, with their columns, whose language is told with a probability of ``least``.

    Every row is judged by itself, also one without an id or with another's id.
    """
    fresh = tuple(f"{name}_{'x' * max(map(len, docs.columns))}" for name in ("said", "sure"))
    rows = with_language(docs, model_of(docs, examples, id_col, text_col, lang_col), text_col, fresh)
    return rows.where((F.col(fresh[0]) != "und") & (F.col(fresh[1]) >= least)).select(docs.columns)
