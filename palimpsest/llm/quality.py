"""Quality by attention-based multiple-instance learning.

A document is a bag of passages.  Each passage is encoded by a small network;
gated attention, tanh(V h) * sigmoid(U h) weighed and normalised over the bag,
says how much each passage counts; the weighted sum of the encodings is scored.
All of it is learned from document labels alone, on a bounded sample of them.

An empty or null text is a bag of one empty passage and gets a score as well.
Where no label can be learned from, every score is 0.5.  Repeated rows get
repeated results; texts are taken whole, however many passages they have.
"""

from __future__ import annotations

from operator import eq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, map_texts, named, sampled

#: Bytes of a passage.
PASSAGE = 400
#: Bound of the sample: labelled documents of each label whose passages' features go to the driver.
SAMPLE_PER_LABEL = 900
THRESHOLD = 0.3

# Kinds of bytes: lower, upper, digit, blank, line end, other control, accented or foreign, and signs that stand alone.
_SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _kinds() -> np.ndarray:
    table = np.full(256, 5, np.uint8)
    for b in range(256):
        c = chr(b)
        if b >= 0x80:
            table[b] = 6
        elif c.islower():
            table[b] = 0
        elif c.isupper():
            table[b] = 1
        elif c.isdigit():
            table[b] = 2
        elif c == " ":
            table[b] = 3
        elif c == "\n":
            table[b] = 4
        elif c in _SIGNS:
            table[b] = 7 + _SIGNS.index(c)
    return table


_KIND = _kinds()
N_KINDS = 7 + len(_SIGNS)
N_FEATURES = N_KINDS + 8


def bag(raw: bytes) -> np.ndarray:
    """A row of features for each passage of a text.  Passages are cut by bytes: a cut may fall inside a character, whose bytes then count on both sides."""
    n = max(1, -(-len(raw) // PASSAGE))
    kinds = _KIND[np.frombuffer(raw, np.uint8)].astype(np.int64)
    place = np.arange(len(raw)) // PASSAGE * N_KINDS
    share = np.bincount(place + kinds, minlength=n * N_KINDS).reshape(n, N_KINDS)
    size = np.maximum(share.sum(1), 1)
    x = np.zeros((n, N_FEATURES), np.float32)
    x[:, :N_KINDS] = np.sqrt(share / size[:, None])
    for i in range(n):
        words = raw[i * PASSAGE : (i + 1) * PASSAGE].split()
        if m := len(words):
            distinct = len(set(words))
            x[i, N_KINDS:] = (
                distinct / m,
                sum(map(eq, words, words[1:])) / m,
                sum(map(eq, words, words[2:])) / m,
                sum(map(eq, words, words[3:])) / m,
                min(m / 100, 1),
                min((size[i] - m) / m / 10, 2),
                max(map(len, words)) / 40,
                1 / m,
            )
    return x


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Attention:
    """The network; bags come as rows of passages and the starts of the bags."""

    def __init__(self, n: int = N_FEATURES, hidden: int = 24, gate: int = 12, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.p = {
            "W": rng.normal(0, 1 / np.sqrt(n), (n, hidden)), "b": np.zeros(hidden), "V": rng.normal(0, 0.3, (hidden, gate)), "U": rng.normal(0, 0.3, (hidden, gate)),
            "w": rng.normal(0, 0.3, gate), "c": rng.normal(0, 0.3, hidden), "d": np.zeros(1),
        }
        self.mean, self.scale = np.zeros(n), np.ones(n)
        self.learned = False

    def forward(self, x: np.ndarray, starts: np.ndarray):
        p = self.p
        x = (x - self.mean) / self.scale
        h = np.maximum(x @ p["W"] + p["b"], 0)
        t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        a = (t * g) @ p["w"]
        of = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(x)]))
        e = np.exp(a - np.maximum.reduceat(a, starts)[of])
        a = e / np.add.reduceat(e, starts)[of]
        z = np.add.reduceat(h * a[:, None], starts, axis=0)
        return x, h, t, g, a, of, z, z @ p["c"] + p["d"][0]

    def score(self, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return _sigmoid(self.forward(x, starts)[-1]) if self.learned else np.full(len(starts), 0.5)

    def gradients(self, x, starts, y):
        p = self.p
        x, h, t, g, a, of, z, out = self.forward(x, starts)
        d = (_sigmoid(out) - y) / len(y)
        dz = d[:, None] * p["c"]
        da = (h * dz[of]).sum(1)
        ds = a * (da - np.add.reduceat(a * da, starts)[of])
        dt, dg = ds[:, None] * p["w"] * g * (1 - t * t), ds[:, None] * p["w"] * t * g * (1 - g)
        dh = (a[:, None] * dz[of] + dt @ p["V"].T + dg @ p["U"].T) * (h > 0)
        return {"W": x.T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ ds, "c": z.T @ d, "d": np.array([d.sum()])}

    def fit(self, bags: list[np.ndarray], labels: np.ndarray, epochs: int = 30, size: int = 64, rate: float = 0.01, decay: float = 1e-4, seed: int = 5) -> Attention:
        every = np.concatenate(bags)
        self.mean, self.scale = every.mean(0), every.std(0) + 0.02
        rng, m, v, t = np.random.default_rng(seed), {}, {}, 0
        for epoch in range(epochs):
            step = rate * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
            order = rng.permutation(len(bags))
            for i in range(0, len(order), size):
                part = order[i : i + size]
                sizes = [len(bags[k]) for k in part]
                grads = self.gradients(np.concatenate([bags[k] for k in part]), np.cumsum([0, *sizes[:-1]]), labels[part])
                t += 1
                for k, grad in grads.items():
                    grad = grad + decay * self.p[k]
                    m[k] = 0.9 * m.get(k, 0) + 0.1 * grad
                    v[k] = 0.999 * v.get(k, 0) + 0.001 * grad * grad
                    self.p[k] = self.p[k] - step * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        self.learned = True
        return self


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_label: int = SAMPLE_PER_LABEL) -> Attention:
    """A model of the labelled rows of docs.  A document with several labels counts with the least; null labels don't count."""
    known = labels.where(named(label_col).isNotNull() & named(id_col).isNotNull()).groupBy(named(id_col).alias("id")).agg(F.min(named(label_col)).cast("int").alias("label"))
    order = [F.xxhash64(F.col("id").cast("string")), F.col("id")]
    chosen = sampled(known, "label", order, per_label)
    totals = {r.label: r["count"] for r in known.groupBy("label").count().collect()}  # a row for each label
    rows = docs.select(named(id_col).alias("id"), named(text_col).alias("text"))
    # An id may stand in many rows: the bound is put to rows, too.
    sample = sampled(rows.join(F.broadcast(chosen), "id"), "label", order, per_label).select("id", "label", "text")
    got = map_texts(sample, "bag binary", lambda: lambda texts: [(bag(t).tobytes(),) for t in texts], as_bytes=True).collect()  # bounded by the sample
    model = Attention()
    if len({r.label for r in got}) < 2:
        return model
    got.sort(key=lambda r: (r.label, str(r.id), r.bag))
    y = np.array([float(r.label == 1) for r in got])
    model.fit([np.frombuffer(r.bag, np.float32).reshape(-1, N_FEATURES).astype(float) for r in got], y)
    # The sample holds the labels in other shares than the table: the intercept is set back.
    share, drawn = totals.get(1, 0) / sum(totals.values()), y.mean()
    model.p["d"] = model.p["d"] + np.log(share / (1 - share)) - np.log(drawn / (1 - drawn))
    return model


def score(docs: DataFrame, model: Attention, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs without its text, with score and predicted."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        def run(texts):
            out = []
            for i in range(0, len(texts), 64):
                bags = [bag(t) for t in texts[i : i + 64]]
                sizes = [len(b) for b in bags]
                out += [(s, int(s >= threshold)) for s in shipped.value.score(np.concatenate(bags), np.cumsum([0, *sizes[:-1]])).tolist()]
            return out

        return run

    return map_texts(docs, "score double, predicted int", start, text_col, as_bytes=True)


def qualities(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(id, held_out, score, predicted), with a model of the labelled documents whose crc32 of the id leaves a remainder other than 0 by 5."""
    marked = docs.select(named(id_col), held_out(named(id_col), 5, 0).alias("held_out"), named(text_col).alias("text"))
    model = train(marked.where(~F.col("held_out")), labels.where(~held_out(named(id_col), 5, 0)), id_col=id_col, label_col=label_col)
    return score(marked, model)
