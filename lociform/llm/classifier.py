"""Quality classifier: Bradley-Terry pairwise ranking.

A document's strength is a linear function of its features (shares of marks, capitals, digits,
repeats; hashed word counts). Pairs of a good and a bad document are drawn from a bounded
sample of labelled rows, the logistic loss of the strength differences is minimised, and
a strength is good if it is over a quantile of the sample's strengths; the score is a logistic
function of the strength that is ``threshold`` at that quantile.

Defined results: a null text is scored like an empty one; ties score alike; rows without a label or a document
are not learned from; with no label of one kind every score is the share of good
ones (0.5 without any); extra columns pass through, those named like an added one are replaced.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, quoted, text_or_empty

BUCKETS = 1024
MARKS = re.compile(r"[#*$%&|<>{}~^=_\\@]")
SHOUT = re.compile(r"[!?]{2,}|[.]{4,}")
HELD_WORDS = 200_000
N_FACTS = 14


def facts(text: str, words: list[str]) -> list[float]:
    """Shares and logarithms that describe a text's surface."""
    n, chars = max(1, len(words)), max(1, len(text))
    lines = [x for x in text.split("\n") if x.strip()]
    counts = Counter(words)
    letters = sum(map(str.isalpha, text[:0])) if not text else 0
    upper = len(re.findall(r"[A-ZÀ-ÖØ-Þ]", text))
    lower = len(re.findall(r"[a-zß-öø-ÿ]", text))
    letters = upper + lower
    pairs = Counter(zip(words, words[1:], strict=False))
    return [
        float(np.log1p(len(words))),
        len(MARKS.findall(text)) / chars,
        len(SHOUT.findall(text)) / n,
        upper / max(1, letters),
        len(re.findall(r"\d", text)) / chars,
        letters / chars,
        sum(map(len, words)) / n,
        len(counts) / n,
        max(counts.values(), default=0) / n,
        sum(v for v in pairs.values() if v > 1) / n,
        max(pairs.values(), default=0) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        len(lines) / n,
        text.count("|") / n,
    ]


def vectors(texts: list[str], memory: dict[str, int]) -> np.ndarray:
    """(n, N_FACTS + BUCKETS) float32: facts and root shares of hashed words."""
    out = np.zeros((len(texts), N_FACTS + BUCKETS), np.float32)
    for i, text in enumerate(texts):
        words = text.lower().split()
        out[i, :N_FACTS] = facts(text, words)
        if words:
            if len(memory) > HELD_WORDS:
                memory.clear()
            found = []
            for w in words:
                b = memory.get(w)
                if b is None:
                    b = zlib.crc32(w.encode()) % BUCKETS
                    if len(w) <= 32:
                        memory[w] = b
                found.append(b)
            out[i, N_FACTS:] = np.sqrt(np.bincount(found, minlength=BUCKETS) / len(words))
    return out


@dataclass
class RankModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    slope: float
    shift: float  # score = logistic(slope * strength + shift)

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.mean) / self.scale) @ self.weights * self.slope + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def logit(p: float) -> float:
    p = min(max(p, 1e-6), 1 - 1e-6)
    return float(np.log(p / (1 - p)))


def fit(x: np.ndarray, y: np.ndarray, threshold: float, pairs: int = 8_000, steps: int = 150, ridge: float = 2e-3) -> RankModel:
    """Minimise mean log(1 + exp(-(w . (good - bad)))) + ridge |w|^2 / 2 over drawn pairs, by Adam on all of them."""
    d = x.shape[1]
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y != 1)
    if not len(good) or not len(bad):
        share = float(np.mean(y)) if len(y) else 0.5
        return RankModel(np.zeros(d), np.ones(d), np.zeros(d), 1.0, logit(share))
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    z = ((x - mean) / scale).astype(np.float32)
    draw = np.random.default_rng(11)
    diff = z[draw.choice(good, pairs)] - z[draw.choice(bad, pairs)]
    w, m, v = np.zeros(d, np.float32), np.zeros(d, np.float32), np.zeros(d, np.float32)
    for t in range(1, steps + 1):
        g = -(diff.T @ (1 / (1 + np.exp(np.clip(diff @ w, -60, 60))))) / pairs + ridge * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - 0.02 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    strength = z @ w
    # the quantile that parts the sample's labels best, in the middle between its neighbours
    order = np.argsort(strength, kind="stable")
    wrong = np.concatenate([[0], np.cumsum(y[order] == 1)]) + (np.sum(y != 1) - np.concatenate([[0], np.cumsum(y[order] != 1)]))
    best = np.flatnonzero(wrong == wrong.min())
    k = int(best[len(best) // 2])
    s = strength[order]
    cut = float((s[max(0, k - 1)] + s[min(k, len(s) - 1)]) / 2)
    slope = 2.0 / max(1e-6, float(np.std(strength)))
    return RankModel(mean, scale, w.astype(np.float64), slope, logit(threshold) - slope * cut)


def train(
    docs: DataFrame,
    labels: DataFrame,
    threshold: float = 0.3,
    text_col: str = "text",
    id_col: str = "doc_id",
    label_col: str = "quality",
    max_labelled: int = 4_000,
) -> RankModel:
    """Learn from at most about ``max_labelled`` labelled rows, a hash sample of them by id; whole texts."""
    known = labels.where(F.col(quoted(label_col)).isNotNull() & F.col(quoted(id_col)).isNotNull()).select(F.col(quoted(id_col)).alias("__id"), F.col(quoted(label_col)).cast("int").alias("__y"))
    n = known.count()
    if n > max_labelled:
        parts = 1_000_000
        known = known.where(F.pmod(F.xxhash64("__id", F.lit(5)), F.lit(parts)) < max(1, parts * max_labelled // n))
    # the sample is bounded by max_labelled, so it may be broadcast
    rows = docs.select(F.col(quoted(id_col)).alias("__id"), F.col(quoted(text_col)).alias("__text")).join(F.broadcast(known), "__id")

    def kernel(texts: pa.Array) -> list[pa.Array]:
        return [pa.array([r.tobytes() for r in vectors(texts.to_pylist(), {})], pa.binary())]

    made = append_columns(rows, [text_or_empty("__text")], [T.StructField("x", T.BinaryType())], kernel, keep=["__y"]).collect()
    made = sorted((r["x"], r["__y"]) for r in made)
    x = np.stack([np.frombuffer(a, np.float32) for a, _ in made]) if made else np.zeros((0, N_FACTS + BUCKETS), np.float32)
    return fit(np.asarray(x), np.array([int(b == 1) for _, b in made]), threshold)


def score(df: DataFrame, model: RankModel, text_col: str = "text", out: str = "score") -> DataFrame:
    """df with a score from 0 to 1: a map without a shuffle; the model has some thousand numbers."""
    memory: dict[str, int] = {}

    def kernel(texts: pa.Array) -> list[pa.Array]:
        return [pa.array(model.scores(vectors(texts.to_pylist(), memory)), pa.float64())]

    return append_columns(df, [text_or_empty(text_col)], [T.StructField(out, T.DoubleType())], kernel)
