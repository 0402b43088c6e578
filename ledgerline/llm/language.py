"""Language identification: multinomial logistic regression on TF-IDF character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.shingles import mix
from ledgerline.llm.texts import map_texts

BUCKETS = 1 << 15   # n-grams of one to three characters are hashed into so many features
SAMPLE = 1500       # training texts a language, those of least hash
EPOCHS = 4
NONE = "und"

_letter: np.ndarray | None = None


def _letters() -> np.ndarray:
    """Which code points are letters; made once in each worker."""
    global _letter
    if _letter is None:
        _letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letter


def ngram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Features and how often each is in the whole text: letters lower-cased, all else one space."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    if not letter.any():
        return np.empty(0, np.int64), np.empty(0)
    points = np.concatenate(([32], np.where(letter, points, 32), [32])).astype(np.uint64)
    points = points[np.concatenate(([True], (points[1:] != 32) | (points[:-1] != 32)))]
    grams = [points]
    for _ in range(2):
        grams.append(grams[-1][:-1] * np.uint64(0x110003) + points[len(points) - len(grams[-1]) + 1:])
    at = np.concatenate([mix(g + np.uint64(k + 1 << 62)) >> np.uint64(49) for k, g in enumerate(grams)]).astype(np.int64)
    counts = np.bincount(at, minlength=BUCKETS)
    found = np.flatnonzero(counts)
    return found, counts[found].astype(float)


def tf_idf(text: str | None, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit-length features of a text; the last one is constant. Empty without letters."""
    at, counts = ngram_counts(text)
    if not len(at):
        return at, counts
    values = (1 + np.log(counts)) * idf[at]
    values /= np.sqrt((values ** 2).sum())
    return np.append(at, BUCKETS), np.append(values, 1.0)


@dataclass(frozen=True)
class FTRL:
    """Follow the regularised leader, each coordinate with a step of its own."""
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.02


def _softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int, opt: FTRL, epochs: int = EPOCHS) -> np.ndarray:
    """Sparse weights, a row for each feature and the constant; rows are taken in the given order."""
    z, n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))

    def weights(at):
        shrunk = np.sign(z[at]) * np.maximum(np.abs(z[at]) - opt.l1, 0)
        return -shrunk / ((opt.beta + np.sqrt(n[at])) / opt.alpha + opt.l2)

    for _ in range(epochs):
        for (at, x), y in zip(rows, labels, strict=True):
            w = weights(at)
            p = _softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / opt.alpha
            z[at] += g - step * w
            n[at] += g * g
    return weights(slice(None))


def best_temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of scores at which the held-back rows are likeliest."""
    if not len(labels):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
    loss = [-np.log(_softmax(scores / t)[np.arange(len(labels)), labels] + 1e-12).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        at, x = tf_idf(text, self.idf)
        if not len(at) or not self.languages:
            return NONE, 0.0
        p = _softmax(x @ self.weights[at] / self.temperature)
        best = int(np.argmax(p))
        return self.languages[best], float(p[best])


def _document_frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    seen, n = np.zeros(BUCKETS + 1, np.int64), 0
    for batch in batches:
        for text in batch["text"]:
            at, _ = ngram_counts(text)
            seen[at] += 1
            n += 1
    seen[BUCKETS] = n
    at = np.flatnonzero(seen)
    yield pd.DataFrame({"feature": at, "n": seen[at]})


def _trainer(idf: np.ndarray, opt: FTRL, epochs: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [r for b in batches for r in zip(b["h"], b["lang"], b["text"], strict=True)]
        rows = [(h, lang, tf_idf(text, idf)) for h, lang, text in sorted(rows)]
        rows = [(lang, x) for _, lang, x in rows if len(x[0])]
        languages = sorted({lang for lang, _ in rows})
        if not languages:
            return
        y = np.array([languages.index(lang) for lang, _ in rows])
        kept = np.arange(len(rows)) % 5 == 4  # every fifth row only sets the temperature
        w = fit_ftrl([x for (_, x), k in zip(rows, kept, strict=True) if not k], y[~kept], len(languages), opt, epochs)
        scores = np.array([x @ w[at] for (_, (at, x)), k in zip(rows, kept, strict=True) if k]).reshape(-1, len(languages))
        used = np.flatnonzero(np.abs(w).sum(1))
        yield pd.DataFrame({"languages": [languages], "temperature": [best_temperature(scores, y[kept])],
                            "features": [used], "weights": [w[used].ravel()]})
    return run


def sampled(rows: DataFrame, sample: int) -> DataFrame:
    """Of ``lang, h, text``, those of the ``sample`` least distinct ``h`` of each language, one row each."""
    ids = rows.select("lang", "h").distinct()
    # Hashes are spread evenly: below this bound are twice as many as wanted, so that few rows are sorted.
    share = F.lit(2.0 * sample) / F.count("*")
    bounds = ids.groupBy("lang").agg(F.when(share >= 1, 2.0**63).otherwise(share * 2.0**64 - 2.0**63).alias("bound"))
    few = ids.join(F.broadcast(bounds), "lang").where(F.col("h").cast("double") <= F.col("bound"))
    ids = few.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("r") <= sample).select("lang", "h")
    # At most ``sample`` pairs of numbers and names a language: small enough to be sent to all tasks.
    one = F.row_number().over(Window.partitionBy("lang", "h").orderBy(F.xxhash64("text")))
    return rows.join(F.broadcast(ids), ["lang", "h"], "left_semi").withColumn("r", one).where("r = 1").drop("r")


def train(labelled: DataFrame, sample: int = SAMPLE, opt: FTRL = FTRL(), epochs: int = EPOCHS) -> LanguageModel:
    """A model from ``text`` and non-null ``lang``; ``doc_id`` only picks the sample.

    How many texts hold an n-gram is counted over all labelled rows. The weights are fitted in one
    task on at most ``sample`` texts a language, so that task and the model (``BUCKETS`` rows of a
    weight per language) stay as small however large the corpus is. A fifth of the sample is held back
    for the temperature.
    """
    rows = labelled.where("lang is not null").select("lang", "text", F.xxhash64("doc_id").alias("h"))
    counts = rows.select("text").mapInPandas(_document_frequencies, "feature long, n long") \
        .groupBy("feature").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(BUCKETS + 1)
    df[counts["feature"]] = counts["n"]
    idf = np.log((1 + df[BUCKETS]) / (1 + df[:BUCKETS])) + 1
    texts = sampled(rows, sample)
    fitted = texts.repartition(1).mapInPandas(_trainer(idf, opt, epochs), "languages array<string>, temperature double, "
                                              "features array<long>, weights array<double>").first()
    if fitted is None:
        return LanguageModel([], idf, np.zeros((BUCKETS + 1, 1)), 1.0)
    w = np.zeros((BUCKETS + 1, len(fitted["languages"])))
    w[fitted["features"]] = np.array(fitted["weights"]).reshape(-1, w.shape[1])
    return LanguageModel(list(fitted["languages"]), idf, w, fitted["temperature"])


def predict(docs: DataFrame, model: LanguageModel, *keep: str) -> DataFrame:
    """``lang_pred, score`` beside the columns ``keep`` for each row of ``docs``, from the whole text alone."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(texts):
        found = [sent.value.predict(t) for t in texts]
        return {"lang_pred": [f[0] for f in found], "score": [f[1] for f in found]}

    return map_texts(docs.select("text", *keep), "lang_pred string, score double", lambda: work)


def held_out() -> Column:
    """A fifth of the documents by checksum of their id; null ids are not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per document: ``doc_id, held_out, lang_pred, score``.

    The model learns from documents that are not held out and have a ``lang`` and an id. ``score`` is
    the calibrated probability of ``lang_pred``. A null text, or one without letters, is ``und`` with
    score 0, as is every text if there is nothing to learn from. Rows with null ids and repeated rows
    are judged like others; an empty table gives an empty result; other columns are ignored.
    """
    model = train(docs.where(~held_out() & F.col("doc_id").isNotNull()).select("doc_id", "text", "lang"), sample)
    ids = docs.select("doc_id", held_out().alias("held_out"), "text")
    return predict(ids, model, "doc_id", "held_out").select("doc_id", "held_out", "lang_pred", "score")
