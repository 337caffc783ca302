"""Near copies around the threshold: pairs of known similarity, and groups whose members are not all alike."""

import numpy as np
import pytest

from lociform.llm import simhash


def words(rng, n):
    return ["".join(rng.choice(list("abcdefghij"), 7)) for _ in range(n)]


def pairs(rng, replaced, n_shingles=240, count=60):
    """Texts whose last words are replaced: similarity (n - replaced) / (n + replaced) of their five-word shingles."""
    out = []
    for _ in range(count):
        first = words(rng, n_shingles + 4)
        out += [first, first[: len(first) - replaced] + words(rng, replaced)]
    return out


def test_pairs_around_the_threshold(spark):
    """Long pairs on both sides of 0.8, and short texts in which one inserted word leaves just 0.8 and one more replaced word less."""
    rng = np.random.default_rng(9)
    similar, apart = (26, 24, 20), (27, 30, 34, 42)
    assert all(((240 - m) / (240 + m) >= 0.8) == (m in similar) for m in similar + apart)
    texts = [t for m in similar + apart for t in pairs(rng, m)]
    for k in range(80):
        w = words(rng, 44)
        other = [*w[:20], *words(rng, 1), *w[20:]]
        texts += [w, other if k % 2 == 0 else [*other[:-1], *words(rng, 1)]]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    kept = {r["doc_id"] for r in simhash.keep_first(df).collect()}
    gone = [i for i in range(len(texts)) if i not in kept]
    for k, m in enumerate(similar + apart):
        found = [i for i in gone if 120 * k <= i < 120 * (k + 1)]
        assert all(i % 2 for i in found) and (len(found) >= 54 if m in similar else not found)
    short = [i - 840 for i in gone if i >= 840]
    assert all(i % 4 == 1 for i in short) and len(short) >= 36


@pytest.mark.parametrize("crossed", [2])
def test_groups_below_the_threshold(spark, monkeypatch, crossed):
    """Two groups of copies of texts that resemble each other at 0.75: each keeps one, none is lost to the other."""
    monkeypatch.setattr(simhash, "CROSSED", crossed)
    rng = np.random.default_rng(12)
    one = words(rng, 244)
    texts = []
    for base in (one, one[:210] + words(rng, 34)):
        for i in range(60):
            w = list(base)
            w[int(rng.integers(5, 200)) if i else 0] = words(rng, 1)[0]
            texts.append(w)
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in texts]
    across = [len(a & b) / len(a | b) for a in sets[:60] for b in sets[60:]]
    assert max(across) < 0.8
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.keep_first(df).collect()) == [0, 60]
