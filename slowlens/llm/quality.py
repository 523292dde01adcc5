"""Quality classifier from weak labels.

Overlapping heuristics vote good, bad or nothing on every document.  Expectation
maximisation over the counts of all vote patterns (4^9 at most, some hundreds in practice)
estimates how often each votes which way on good and on bad documents, and how common these are,
without any given label.  The posterior of a pattern is the soft label of its documents.  A hashed
linear scorer on byte trigrams and repetition is trained on a bounded sample of
documents (``sample``, drawn by a hash) and scores all of them.

Votes are built-in expressions, taken once and written with the texts to the shared folder;
features are numpy on whole texts.  The driver sees vote counts and the sample's features, both
of fixed size.  Nothing is shuffled but counts and the sample.
Texts without a word get no vote and score 0; null ids and repeated rows are scored like any
other.  Without documents the scorer is neutral (0.5) and the result empty.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from slowlens.llm.catalog import query
from slowlens.llm.common import SPACES, let, saved, table, tokens_of
from slowlens.llm.hashing import shingle_hashes, word_hashes
from slowlens.llm.lines import repeated_tokens

SAMPLE = 4_000
FEATURES = 4_096
SHAPES = 32
#: Tokens from which shares of tokens say something.
ENOUGH = 20
FALSE_ALARM = 0.01
DETECTED = 0.2
GOOD_ODDS = 2.0
CHUNK = 1 << 18
MARKS = r"[.!?…。！？][\"'”’)\]]*\s*$"
#: A token of letters and digits with usual marks around it, or one with a mark of languages without spaces.
PLAIN = r"(?<!\S)(?:[\"'“„«¿¡(\[]*+[\p{L}\p{N}]++(?:[-'’.@/][\p{L}\p{N}]++)*+[\"'”’»)\].,;:?…]*+|\S*[。！？]\S*+)(?!\S)"
#: A token whose next token is the same.
RUN = r"(?<!\S)(\S++)(?=\s++\1(?!\S))"
LABELLERS = ("symbols", "separators", "capitals", "shouts", "runs", "repeats", "plain", "endings", "sentences")


def votes(text: Column) -> Column:
    """A struct of 1 (good), 0 (bad), 2 (does not apply to so short a text) or null per labeller."""
    def share(part, whole):
        return part / F.greatest(whole, F.lit(1))

    def count_of(t, chars):
        return F.regexp_count(t, F.lit(f"[{chars}]"))

    def bad_from(value, limit):
        return F.when(value >= limit, 0)

    def judge(t):
        def of_tokens(w):
            n = F.size(w)
            # one search of the whole text each: a call per token or character costs several times as much
            capitals = F.regexp_count(t, F.lit(r"\p{Lu}"))
            letters = F.length(t) - F.length(F.regexp_replace(t, r"\p{L}++", ""))
            same = F.regexp_count(t, F.lit(RUN))
            plain = share(F.regexp_count(t, F.lit(PLAIN)), n)
            lines = F.filter(F.split(t, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
            unmarked = let(lines, lambda ls: share(F.size(F.filter(ls, lambda x: ~F.rlike(x, F.lit(MARKS)))), F.size(ls)))
            marks = share(count_of(t, ".!?…。！？"), n)
            found = {
                "symbols": bad_from(share(count_of(t, "#*$%&<>"), n), 0.2),
                "separators": bad_from(share(count_of(t, "|"), n), 0.2),
                "capitals": bad_from(share(capitals, letters), 0.6),
                "shouts": bad_from(share(count_of(t, "!"), n), 0.5),
                "runs": bad_from(share(same, n), 0.2),
                "repeats": let(share(repeated_tokens(w), n), lambda r: F.when(n < ENOUGH, 2).when(r >= 0.3, 0).when(r <= 0.1, 1)),
                "plain": let(plain, lambda p: F.when(n < ENOUGH, 2).when(p >= 0.85, 1).when(p <= 0.65, 0)),
                "endings": let(unmarked, lambda u: F.when(u <= 0.34, 1).when(u >= 0.67, 0)),
                "sentences": let(marks, lambda m: F.when(n < ENOUGH, 2).when((m >= 0.02) & (m <= 0.5), 1).when((m < 0.01) | (m >= 0.9), 0)),
            }
            return F.struct(*[F.when(n > 0, found[name]).cast("int").alias(name) for name in LABELLERS])

        return let(tokens_of(t), of_tokens)

    return let(F.coalesce(text, F.lit("")), judge)


def estimate(
    patterns: np.ndarray,
    counts: np.ndarray,
    rounds: int = 200,
    false_alarm: float = FALSE_ALARM,
    detected: float = DETECTED,
    good_odds: float = GOOD_ODDS,
) -> tuple[float, np.ndarray]:
    """Share of good documents and, per labeller, the log odds that its vote ``(bad, none, good)`` speaks for good.

    ``patterns`` holds 1, 0, -1 (no vote, an outcome like the others) or 2 (does not apply, no evidence).
    So that the classes keep their meaning, a bad vote is held to at most ``false_alarm`` of the good
    documents and at least ``detected`` of the bad ones, and no good vote outweighs ``good_odds`` : 1.
    ``1, 0, inf`` leave all to the estimate.
    """
    prior = 0.8
    outcome = np.empty((2, patterns.shape[1], 3))  # class, labeller, (bad, none, good)
    outcome[0], outcome[1] = (0.5, 0.3, 0.2), (0.05, 0.35, 0.6)
    weights = np.log(outcome[1] / outcome[0])
    votes_are = np.stack([patterns == v for v in (0, -1, 1)], axis=2)
    for _ in range(rounds):
        good = posterior(patterns, prior, weights)
        mass = np.stack([counts * (1 - good), counts * good])
        prior = float(np.clip(mass[1].sum() / max(counts.sum(), 1e-9), 0.05, 0.95))
        for c in (0, 1):
            seen = (mass[c][:, None, None] * votes_are).sum(axis=0) + 0.5
            outcome[c] = seen / seen.sum(axis=1, keepdims=True)
        outcome[1, :, 0] = np.minimum(outcome[1, :, 0], false_alarm)
        outcome[0, :, 0] = np.maximum(outcome[0, :, 0], detected)
        weights = np.log(outcome[1] / outcome[0])
        weights[:, 2] = np.clip(weights[:, 2], 0, np.log(good_odds))
    return prior, weights


def posterior(patterns: np.ndarray, prior: float, weights: np.ndarray) -> np.ndarray:
    column = np.select([patterns == 0, patterns == -1, patterns == 1], [0, 1, 2], 3)
    weights = np.hstack([weights, np.zeros((weights.shape[0], 1))])
    odds = np.log(prior / (1 - prior)) + weights[np.arange(weights.shape[0])[None, :], column].sum(axis=1)
    return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))


def posterior_of(vote: Column, prior: float, weights: np.ndarray) -> Column:
    odds = F.lit(float(np.log(prior / (1 - prior))))
    for name, (bad, none, good) in zip(LABELLERS, weights.tolist()):
        odds = odds + F.when(vote[name] == 1, good).when(vote[name] == 0, bad).when(vote[name] == 2, 0.0).otherwise(none)
    return 1 / (1 + F.exp(-F.greatest(F.lit(-50.0), F.least(F.lit(50.0), odds))))


def trigrams(raw: bytes) -> Iterator[np.ndarray]:
    """Feature numbers of all byte trigrams of a text, piece by piece."""
    for at in range(0, max(1, len(raw) - 2), CHUNK):
        b = np.frombuffer(raw, np.uint8, min(CHUNK + 2, len(raw) - at), at).astype(np.uint32)
        if len(b) > 2:
            h = (b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA6B)) ^ (b[2:] * np.uint32(0xC2B2AE35))
            yield ((h * np.uint32(0x27D4EB2F)) >> np.uint32(16)) % np.uint32(FEATURES - SHAPES) + np.uint32(SHAPES)


def shape(raw: bytes) -> list[int]:
    """Numbers of the repetition features of a text: equal neighbours and share of different three-word windows, of the whole text."""
    words = word_hashes(raw)
    n = max(1, len(words) - 1)
    runs = int((words[1:] == words[:-1]).sum() * 15 // n)
    windows = shingle_hashes(words, 3)
    fresh = int(len(np.unique(windows)) * 15 // max(1, len(windows)))
    return [runs, 16 + fresh]


def vector(raw: bytes) -> np.ndarray:
    counts = np.zeros(FEATURES, np.float32)
    for part in trigrams(raw):
        counts += np.bincount(part, minlength=FEATURES)
    counts = np.sqrt(counts / max(1.0, counts.sum()))
    counts[shape(raw)] = 0.5
    return counts


def _vectors(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        yield pd.DataFrame({"label": f["label"], "x": [zlib.compress(vector(r).tobytes(), 1) for r in f["raw"]]})


def train(x: np.ndarray, y: np.ndarray, steps: int = 300, rate: float = 4.0, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels, both classes weighted alike, by gradient steps with momentum."""
    w, b, vw, vb = np.zeros(x.shape[1], np.float32), 0.0, np.zeros(x.shape[1], np.float32), 0.0
    if not len(y):
        return w, b
    weight = y / max(y.sum(), 1e-6) + (1 - y) / max((1 - y).sum(), 1e-6)
    weight = (weight / weight.sum()).astype(np.float32)
    for _ in range(steps):
        error = weight * (1 / (1 + np.exp(-(x @ w + b))) - y).astype(np.float32)
        vw = 0.9 * vw - rate * (x.T @ error + decay * w)
        vb = 0.9 * vb - rate * float(error.sum())
        w, b = w + vw, b + vb
    return w, b


def _scores(w: np.ndarray, b: float):
    def go(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            scores = [1 / (1 + np.exp(-np.clip(float(vector(r) @ w) + b, -50, 50))) if n else 0.0 for r, n in zip(f["raw"], f["has_words"])]
            yield f[["doc_id", "n_votes", "posterior"]].assign(score=scores)

    return go


def score_quality(docs: DataFrame, sample: int = SAMPLE, keep_from: float = 0.3) -> DataFrame:
    """``doc_id, n_votes, posterior, score, kept`` of every document."""
    text = F.coalesce("text", F.lit(""))
    judged = docs.select("doc_id", text.cast("binary").alias("raw"), (F.translate(text, SPACES, "") != "").alias("has_words"), votes(F.col("text")).alias("vote"))
    judged = saved(judged, "votes")  # votes cost more than all the rest, so they are taken once
    rows = judged.groupBy(*[F.coalesce(F.col("vote")[n], F.lit(-1)).alias(n) for n in LABELLERS]).count().collect()  # 4^9 at most
    patterns = np.array([[r[n] for n in LABELLERS] for r in rows], int).reshape(-1, len(LABELLERS))
    counts = np.array([r["count"] for r in rows], float)
    prior, weights = estimate(patterns, counts)
    label = posterior_of(F.col("vote"), prior, weights)
    modulus = 1 << 30
    share = min(1.0, sample / max(1.0, counts.sum()))
    chosen = judged.where("has_words").where(F.pmod(F.xxhash64("raw", "doc_id"), F.lit(modulus)) < int(share * modulus))
    learned = chosen.select(label.alias("label"), "raw").limit(2 * sample).mapInPandas(_vectors, "label double, x binary").collect()
    x = np.zeros((len(learned), FEATURES), np.float32)
    for i, r in enumerate(learned):
        x[i] = np.frombuffer(zlib.decompress(r["x"]), np.float32)
    w, b = train(x, np.array([r["label"] for r in learned], float))
    n_votes = sum((F.coalesce(F.col("vote")[n].isin(0, 1), F.lit(False)).cast("int") for n in LABELLERS), F.lit(0))
    ready = judged.select("doc_id", n_votes.alias("n_votes"), label.alias("posterior"), "raw", "has_words")
    scored = ready.mapInPandas(_scores(w, b), "doc_id long, n_votes int, posterior double, score double")
    return scored.withColumn("kept", F.col("score") >= keep_from)


@query("op2_weak_label_quality")
def op2_weak_label_quality(spark, sf_dir):
    return score_quality(table(spark, sf_dir, "documents").select("doc_id", "text"))
