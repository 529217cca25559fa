"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies come from every training document.  The weights are
fitted with follow-the-regularised-leader (elastic net) on a bounded sample of
training documents, spread evenly over the languages; a temperature is then
fitted on documents of the sample that the weights have not seen.

A text that is null or holds no letter gets 'und' and score 0.  So does every
text where nothing was learned (an empty table, or one without labels).
Repeated rows get repeated results, and texts are taken whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, map_texts, named, numbered, sampled, slices

#: Hash buckets of the n-grams.
BUCKETS = 8192
#: Orders of the n-grams, in characters.
ORDERS = (1, 2, 3)
#: Bound of the sample: training documents of each language whose features go to the driver.
SAMPLE_PER_LANGUAGE = 400
#: Cells of a dense block of features.
CELLS = 1 << 21

_LETTER = regex.compile(r"\p{L}")


def counts(texts: list[str], buckets: int = BUCKETS) -> np.ndarray:
    """n-gram counts, a row for each text.  Characters are folded to lower case; whatever of ASCII (and the signs up to U+00A9) isn't a letter counts as one kind of gap."""
    out = np.zeros((len(texts), buckets), np.float32)
    step = max(1, CELLS // buckets)
    for a in range(0, len(texts), step):
        part = [" " + t.lower() + " " for t in texts[a : a + step]]
        sizes = np.array([len(t) for t in part])
        chars = np.frombuffer("".join(part).encode("utf-32-le"), np.uint32)
        plain = (chars >= 97) & (chars <= 122)
        c = np.where(plain | (chars >= 0xAA), chars, np.uint32(32))
        row = np.repeat(np.arange(len(part), dtype=np.int64) * buckets, sizes)
        starts = np.cumsum(sizes) - sizes
        for n in ORDERS:
            mixed = _gram(c, n)
            cell = row + (((mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(7)) % np.uint32(buckets)
            keep = np.ones(len(c), bool)
            for j in range(n - 1):  # grams that would reach over a text's start
                keep[np.minimum(starts + j, len(c) - 1)] = False
            out[a : a + len(part)] += np.bincount(cell[keep], minlength=len(part) * buckets).reshape(len(part), buckets)
    return out


def _gram(c: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n characters that end at each place."""
    mixed = np.full(len(c), n, np.uint32)
    for j in range(n - 1, -1, -1):
        mixed = mixed * np.uint32(0x01000193)
        mixed[j:] ^= c[: len(c) - j] * np.uint32(0x9E3779B1)
    return mixed


def features(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(tf) * idf
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9)


class Ftrl:
    """Multinomial logistic regression, follow-the-regularised-leader with L1 and L2 penalties."""

    def __init__(self, n_features: int, n_classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.001):
        self.z = np.zeros((n_features, n_classes))
        self.n = np.zeros((n_features, n_classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, rows=slice(None)) -> np.ndarray:
        z, n = self.z[rows], self.n[rows]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, rows: np.ndarray, values: np.ndarray, label: int) -> None:
        w = self.weights(rows)
        p = softmax((values @ w)[None])[0]
        p[label] -= 1
        g = values[:, None] * p[None]
        sigma = (np.sqrt(self.n[rows] + g * g) - np.sqrt(self.n[rows])) / self.alpha
        self.z[rows] += g - sigma * w
        self.n[rows] += g * g


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


class Model:
    def __init__(self, languages: list[str], weights: np.ndarray, idf: np.ndarray, temperature: float):
        self.languages, self.weights, self.idf, self.temperature = languages, weights, idf, temperature

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        asked = [i for i, t in enumerate(texts) if _LETTER.search(t)] if self.languages else []
        step = max(1, CELLS // len(self.idf))
        for a in range(0, len(asked), step):
            part = asked[a : a + step]
            p = softmax(features(counts([texts[i] for i in part], len(self.idf)), self.idf) @ self.weights / self.temperature)
            for i, k, score in zip(part, p.argmax(1).tolist(), p.max(1).tolist(), strict=True):
                out[i] = (self.languages[k], min(1.0, score))
        return out


def document_frequencies(docs: DataFrame, buckets: int = BUCKETS) -> tuple[int, np.ndarray]:
    """Documents, and those that hold each bucket's n-grams, over all rows; each task sums its own first."""

    def run(batches):
        n, df = 0, np.zeros(buckets, np.int64)
        for _, texts in slices(batches):
            df += (counts(texts, buckets) > 0).sum(0)
            n += len(texts)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, buckets), pa.int32()), pa.array(np.concatenate([[n], df]), pa.int64())], ["bucket", "df"])

    rows = docs.select("text").mapInArrow(run, "bucket int, df long").groupBy("bucket").agg(F.sum("df").alias("df")).collect()  # one row for each bucket
    out = np.zeros(buckets + 1, np.int64)
    for r in rows:
        out[r.bucket + 1] = r.df
    return int(out[0]), out[1:]


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """What the logits are divided by so that the labels are likeliest."""
    tried = np.geomspace(0.02, 20, 120)
    # Even where every one of them is right the next may be wrong: a pseudo-count for each language keeps scores under 1.
    doubt = 1 / sum(logits.shape)
    target = np.full(logits.shape, doubt / logits.shape[1])
    target[np.arange(len(labels)), labels] += 1 - doubt
    losses = [-(target * np.log(np.maximum(softmax(logits / t), 1e-30))).sum(1).mean() for t in tried]
    return float(tried[int(np.argmin(losses))])


def train(docs: DataFrame, text_col: str = "text", label_col: str = "lang", id_col: str = "doc_id", buckets: int = BUCKETS, per_language: int = SAMPLE_PER_LANGUAGE, epochs: int = 6, seed: int = 7) -> Model:
    """A model of the rows of docs that have a text and a label."""
    rows = docs.where(named(label_col).isNotNull() & named(text_col).isNotNull()).select(named(id_col).alias("id"), named(text_col).alias("text"), named(label_col).alias("lang"))
    n, df = document_frequencies(rows, buckets)
    if not n:
        return Model([], np.zeros((buckets, 0)), np.zeros(buckets, np.float32), 1.0)
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    order = [F.xxhash64(F.col("id").cast("string")), F.col("id")]
    chosen = sampled(rows.select("id", "lang"), "lang", order, per_language).distinct()
    # An id may stand in many rows: the bound is put to rows, too.
    sample = sampled(rows.join(F.broadcast(chosen), ["id", "lang"]), "lang", order, per_language).select("id", "lang", "text")

    def start():
        def run(texts):
            made = []
            step = max(1, CELLS // buckets)
            for a in range(0, len(texts), step):
                x = features(counts(texts[a : a + step], buckets), idf)
                for row in x:
                    at = np.flatnonzero(row)
                    made.append((at.astype(np.int32).tobytes(), row[at].astype(np.float32).tobytes()))
            return made

        return run

    got = map_texts(sample, "rows binary, vals binary", start).collect()  # bounded by the sample
    got.sort(key=lambda r: (r.lang, str(r.id), r.rows))
    languages = sorted({r.lang for r in got})
    data = [(np.frombuffer(r.rows, np.int32), np.frombuffer(r.vals, np.float32).astype(float), languages.index(r.lang)) for r in got]
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(data))
    kept = order[: max(1, len(data) // 8)]
    fit = order[len(kept) :] if len(data) >= 16 else order
    learner = Ftrl(buckets, len(languages))
    for _ in range(epochs):
        for i in rng.permutation(fit):
            learner.learn(*data[i])
    w = learner.weights()
    logits = np.array([data[i][1] @ w[data[i][0]] for i in kept])
    labels = np.array([data[i][2] for i in kept])
    return Model(languages, w.astype(np.float32), idf, temperature(logits, labels))


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs without its text, with lang_pred and score."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # buckets x languages
    return map_texts(docs, "lang_pred string, score double", lambda: shipped.value.predict, text_col)


def languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """(id, held_out, lang_pred, score), with a model of the documents whose crc32 of the id leaves a remainder other than 2 by 4."""
    marked = docs.select(named(id_col), held_out(named(id_col), 4, 2).alias("held_out"), named(text_col).alias("text"), named(label_col).alias("lang"))
    model = train(marked.where(~F.col("held_out")), id_col=id_col)
    return predict(marked.select(named(id_col), "held_out", "text"), model)


def identified(docs: DataFrame, labelled: DataFrame, min_score: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs, with their columns, in which a language of labelled's training documents is found with at least min_score."""
    model = train(labelled.where(~held_out(F.col("doc_id"), 4, 2)))
    text = docs.columns.index(text_col)
    judged = predict(numbered(docs).withColumn("text", F.col(f"_{text}")), model)
    return judged.where((F.col("lang_pred") != "und") & (F.col("score") >= min_score)).drop("lang_pred", "score").toDF(*docs.columns)
