"""Language of whole texts by a byte convolutional network.

Windows of 256 bytes go through filters of widths 2, 3 and 4 over embedded bytes, max
pooling per window and a softmax; a text's scores are the means over all its windows.  The
network is trained in numpy on a bounded sample of labelled text: at most about
``per_language`` documents of each language, drawn by a hash, four windows of each.
Documents whose crc32 of the id leaves 2 modulo 4 are held out, rows without id are never
learned from, and a prediction sees bytes of the text only.

Filters over bytes are sums of table rows, so a batch of windows is a few gathers; memory
is bounded by the batch, whatever the text.  Scoring is a map without shuffle.  Texts
that are null or without a letter are ``und`` with score 0, and so is everything if
there is nothing to learn from.  Repeated rows are scored one by one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from slowlens.llm.catalog import query
from slowlens.llm.common import table

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 12
EMBEDDING = 8
PER_LANGUAGE = 600
PER_DOCUMENT = 4
EPOCHS = 6
BATCH = 64
SCORED = 256
LETTER = re.compile(r"[^\W\d_]")
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32


def windows_of(raw: bytes) -> np.ndarray:
    """All of a text as rows of ``WINDOW`` bytes, A-Z folded, the last row filled with spaces."""
    n = max(1, -(-len(raw) // WINDOW))
    padded = np.full(n * WINDOW, 32, np.uint8)
    padded[: len(raw)] = np.frombuffer(raw, np.uint8)
    return _FOLD[padded].reshape(n, WINDOW)


class ByteNetwork:
    """Embedding, filters per width, max pooling and softmax, with Adam steps on cross-entropy."""

    def __init__(self, classes: int, seed: int = 7):
        r = np.random.Generator(np.random.PCG64(seed))
        self.weights = {"embedding": r.normal(0, 0.5, (256, EMBEDDING))}
        for w in WIDTHS:
            self.weights[f"filter{w}"] = r.normal(0, 0.5 / np.sqrt(w), (w, EMBEDDING, FILTERS))
        self.weights["out"] = r.normal(0, 0.1, (len(WIDTHS) * FILTERS, classes))
        self.weights["bias"] = np.zeros(classes)

    def _pooled(self, x: np.ndarray):
        """Largest response per filter and where it is; each width is a sum of shifted table rows."""
        values, places = [], []
        for w in WIDTHS:
            tables = self.weights["embedding"] @ self.weights[f"filter{w}"]
            n = WINDOW - w + 1
            response = sum(tables[k][x[:, k : k + n]] for k in range(w))
            at = response.argmax(axis=1)
            places.append(at)
            values.append(np.take_along_axis(response, at[:, None, :], 1)[:, 0])
        return np.tanh(np.concatenate(values, axis=1)), places

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, rate: float = 0.01, seed: int = 11) -> None:
        r = np.random.Generator(np.random.PCG64(seed))
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        step = 0
        for _ in range(epochs):
            order = r.permutation(len(x))
            for at in range(0, len(order), BATCH):
                part = order[at : at + BATCH]
                step += 1
                for k, g in self._gradients(x[part], y[part]).items():
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    self.weights[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        pooled, places = self._pooled(x)
        logits = pooled @ self.weights["out"] + self.weights["bias"]
        chances = np.exp(logits - logits.max(axis=1, keepdims=True))
        chances /= chances.sum(axis=1, keepdims=True)
        chances[np.arange(len(y)), y] -= 1
        error = chances / len(y)
        found = {"out": pooled.T @ error, "bias": error.sum(axis=0), "embedding": np.zeros((256, EMBEDDING))}
        back = (error @ self.weights["out"].T) * (1 - pooled**2)
        for i, w in enumerate(WIDTHS):
            part, kernel = back[:, i * FILTERS : (i + 1) * FILTERS], self.weights[f"filter{w}"]
            of_kernel = np.zeros_like(kernel)
            for k in range(w):
                used = np.zeros((256, FILTERS))
                np.add.at(used, (x[np.arange(len(x))[:, None], places[i] + k], np.arange(FILTERS)[None, :]), part)
                of_kernel[k] = self.weights["embedding"].T @ used
                found["embedding"] += used @ kernel[k].T
            found[f"filter{w}"] = of_kernel
        return found

    def tables(self) -> dict[str, np.ndarray]:
        """What scoring needs: responses of byte pairs and single bytes per width."""
        one = {w: (self.weights["embedding"] @ self.weights[f"filter{w}"]).astype(np.float32) for w in WIDTHS}

        def pairs(a, b):
            return (a[:, None, :] + b[None, :, :]).reshape(65536, FILTERS)

        return {
            "two": pairs(one[2][0], one[2][1]),
            "three": pairs(one[3][0], one[3][1]),
            "third": one[3][2],
            "four": pairs(one[4][0], one[4][1]),
            "rest": pairs(one[4][2], one[4][3]),
            "out": self.weights["out"].astype(np.float32),
            "bias": self.weights["bias"].astype(np.float32),
        }


def log_chances(tables: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """Log probabilities per window."""
    pair = x[:, :-1].astype(np.int32) * 256 + x[:, 1:]
    two = tables["two"].take(pair, axis=0).max(axis=1)
    three = tables["three"].take(pair[:, :-1], axis=0)
    three += tables["third"].take(x[:, 2:], axis=0)
    four = tables["four"].take(pair[:, :-2], axis=0)
    four += tables["rest"].take(pair[:, 2:], axis=0)
    pooled = np.tanh(np.concatenate([two, three.max(axis=1), four.max(axis=1)], axis=1))
    logits = pooled @ tables["out"] + tables["bias"]
    logits -= logits.max(axis=1, keepdims=True)
    return logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))


def _sampled(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        langs, rows = [], []
        for lang, raw in zip(f["lang"], f["raw"]):
            x = windows_of(raw)
            full = max(1, len(raw) // WINDOW)
            for i in np.unique(np.linspace(0, full - 1, PER_DOCUMENT).astype(int)):
                langs.append(lang)
                rows.append(x[i].tobytes())
        yield pd.DataFrame({"lang": langs, "bytes": rows})


def _predicted(tables: dict[str, np.ndarray] | None, names: list[str]):
    def go(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            langs, scores = [], []
            for text in f["text"]:
                if tables is None or text is None or not LETTER.search(text):
                    langs.append("und")
                    scores.append(0.0)
                    continue
                x = windows_of(text.encode())
                total = np.zeros(len(names))
                for at in range(0, len(x), SCORED):
                    total += log_chances(tables, x[at : at + SCORED]).sum(axis=0)
                mean = total / len(x)
                chances = np.exp(mean - mean.max())
                best = int(chances.argmax())
                langs.append(names[best])
                scores.append(float(chances[best] / chances.sum()))
            yield f[["doc_id", "held_out"]].assign(lang_pred=langs, score=scores)

    return go


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE) -> tuple[dict | None, list[str]]:
    """Tables of a trained network and its languages, from ``doc_id, lang, text`` rows."""
    usable = docs.where("lang is not null and text rlike '\\\\p{L}'").select("doc_id", "lang", F.col("text").cast("binary").alias("raw"))
    counts = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}  # one row per language
    names = sorted(counts)
    if not names:
        return None, names
    modulus = 1 << 30
    shares = F.create_map(*[F.lit(x) for lang in names for x in (lang, min(modulus, per_language * modulus // counts[lang]))])
    drawn = usable.where(F.pmod(F.xxhash64("raw", "doc_id"), F.lit(modulus)) < F.element_at(shares, F.col("lang")))
    bounded = drawn.select("lang", "raw").limit(2 * per_language * len(names))
    rows = bounded.mapInPandas(_sampled, "lang string, bytes binary").collect()
    rows.sort(key=lambda r: (r["lang"], bytes(r["bytes"])))
    x = np.frombuffer(b"".join(bytes(r["bytes"]) for r in rows), np.uint8).reshape(-1, WINDOW)
    y = np.array([names.index(r["lang"]) for r in rows], int)
    network = ByteNetwork(len(names))
    network.fit(x, y)
    return network.tables(), names


def identify(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every document."""
    marked = docs.select("doc_id", "text", "lang", held_out(F.col("doc_id")).alias("held_out"))
    tables, names = learn(marked.where("not held_out and doc_id is not null"), per_language)
    return marked.select("doc_id", "held_out", "text").mapInPandas(
        _predicted(tables, names), "doc_id long, held_out boolean, lang_pred string, score double"
    )


@query("op9_byte_network")
def op9_byte_network(spark, sf_dir):
    return identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
