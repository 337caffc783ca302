"""Vector near-duplicates, collocations and source divergence against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from lociform.llm import collocations, divergence, embedding_dedup
from lociform.llm.common import stretches

LETTERS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# vectors


def brute_vectors(rows, threshold):
    ok = {}
    for i, (_, label, v) in enumerate(rows):
        if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, float)
            ok[i] = x / np.linalg.norm(x)
    links = defaultdict(set)
    for i in ok:
        for j in ok:
            if i != j and rows[i][1] == rows[j][1] and len(ok[i]) == len(ok[j]) and ok[i] @ ok[j] >= threshold - 1e-15:
                links[i].add(j)
    out = []
    for i, (vec_id, _, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            todo = [k for k in {m for x in todo for m in links[x]} if k not in seen]
            seen.update(todo)
        ids = [rows[k][0] for k in seen if rows[k][0] is not None]
        least = min(ids) if ids else None
        out.append((vec_id, len(links[i]), least, vec_id is not None and vec_id == least))
    return sorted(out, key=str)


def vector_rows(kind):
    rng = np.random.default_rng(3)
    rows = []
    for label in (0, 1, None):
        centres = rng.normal(size=(6, 24))
        for k in range(90):
            v = centres[k % 6] + rng.normal(size=24) * rng.choice([0.0, 0.1, 0.2, 0.3, 2.0])
            rows.append((int(rng.integers(10**6)), label, v.astype(kind).tolist()))
    rows += [rows[3], rows[4], (None, 0, rows[5][2]), (7, 1, None), (8, 1, []), (9, 1, [0.0] * 24), (10, 1, [1.0, None] * 12), (11, 1, [float("nan")] + [1.0] * 23)]
    rows += [(12, 1, [float("inf")] * 24), (13, 1, [1.0, 2.0]), (14, 1, [2.0, 4.0]), (15, 0, [1.0, 2.0]), (16, 1, [1e30] * 24), (17, 1, [3e30] * 24), (None, 5, [1.0]), (None, 5, [1.0]), (18, 1, [-0.0, 1.0]), (19, 1, [0.0, 1.0])]
    return rows


@pytest.mark.parametrize("kind", ["float", "double"])
@pytest.mark.parametrize("tile_rows", [16, 2048])
def test_similar_vectors(spark, kind, tile_rows):
    rows = vector_rows(np.float32 if kind == "float" else np.float64)
    df = spark.createDataFrame([(*r, "x") for r in rows], f"vec_id long, label int, embedding array<{kind}>, node string")
    got = embedding_dedup.similar_vectors(df, threshold=0.93, tile_rows=tile_rows, max_pivots=8)
    assert sorted(((r["id"], r["n_links"], r["component_id"], r["kept"]) for r in got.collect()), key=str) == brute_vectors(rows, 0.93)


def test_no_vectors(spark):
    assert embedding_dedup.similar_vectors(spark.createDataFrame([], "vec_id long, label int, embedding array<float>")).count() == 0


def test_bounds_of_tile_products():
    rng = np.random.default_rng(5)
    for dim in (3, 64, 1500):  # the last is summed in parts
        x = rng.normal(size=(200, dim)) * rng.choice([1, 30], size=(200, dim))
        x /= np.linalg.norm(x, axis=1)[:, None]
        q, s, e = embedding_dedup.quantise(x)
        whole = embedding_dedup.whole_products(q, q)
        assert (whole == q.astype(np.int64) @ q.astype(np.int64).T).all()
        gap = np.abs(x @ x.T - whole * s[:, None] * s[None, :])
        assert (gap <= e[:, None] + (1 + e[:, None]) * e[None, :] + 1e-12).all()
        tile = {"q": q, "scale": s, "err": e, "unit": x}
        i, j, checked = embedding_dedup.tile_links(tile, tile, True, 0.2)
        want = {(a, b) for a, b in zip(*np.nonzero(x @ x.T >= 0.2), strict=True) if a < b}
        assert set(zip(i.tolist(), j.tolist(), strict=True)) == want and checked < 200 * 199 / 2


# collocations


def brute_phrases(docs, min_count, limit, covered):
    counts, total = defaultdict(Counter), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LETTERS)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for n in (1, 2, 3):
                counts[lang].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, f in counts.items():
        rows, longest = [], Counter()
        for p, a in f.items():
            if len(p) == 3 and a >= min_count:
                for q in (p[:2], p[1:]):
                    longest[q] = max(longest[q], a)
        for p, a in f.items():
            if len(p) > 1 and a >= min_count and not (len(p) == 2 and longest[p] and 100 * longest[p] >= covered * a):
                score, _, cut_l, cut_r = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                rows.append((lang, " ".join(p), a, cut_l, cut_r, total[lang], score))
        rows.sort(key=lambda r: (-r[6], -r[2], r[1].encode()))
        out += [(r[0], i, *r[1:]) for i, r in enumerate(rows[:limit], 1)]
    return sorted(out)


def phrase_docs():
    rng = random.Random(4)
    words = ["the", "The", "of", "new", "york", "city", "Straße", "été", "x y", "a\x0bb", "(z)", "-"]
    docs = [(" ".join(rng.choices(words, weights=[9, 2, 6, 3, 3, 3, 1, 1, 1, 1, 1, 1], k=rng.randint(0, 60))) + rng.choice([".", "\n", "  new york city", ""]), rng.choice(["en", "de", None, "und"])) for _ in range(150)]
    return [*docs, (None, "en"), ("", "en"), ("   ", None), ("new york! city", "fr"), *[("one\ttwo  three", "xx")] * 12, docs[0], docs[0]]


@pytest.mark.parametrize(("ranges", "shard_words"), [(1, 10**6), (9, 40)])
def test_phrases(spark, ranges, shard_words):
    docs = phrase_docs()
    df = spark.createDataFrame([(t, g, 1, "x") for t, g in docs], "text string, lang string, rank int, w1 string").repartition(3)
    for min_count, limit in ((10, 2000), (2, 7)):
        got = collocations.phrases(df, min_count=min_count, limit=limit, ranges=ranges, shard_words=shard_words)
        assert sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in got.collect()) == brute_phrases(docs, min_count, limit, 50)


def test_long_text_phrases(spark):
    rng = random.Random(6)
    text = "".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + rng.choice([" ", " ", " ", ". "]) for _ in range(800_000))
    docs = [(text, "en"), ("alpha beta", "en")]
    assert len(text) > 4_500_000 and len(list(stretches(text, collocations.CUT))) == 2 and "".join(stretches(text, collocations.CUT)) == text
    got = collocations.phrases(spark.createDataFrame(docs, "text string, lang string"), ranges=3, shard_words=1000)
    assert sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in got.collect()) == brute_phrases(docs, 10, 2000, 50)


def test_no_phrases(spark):
    assert collocations.phrases(spark.createDataFrame([], "text string, lang string")).count() == 0
    assert collocations.phrases(spark.createDataFrame([(None, None)], "text string, lang string")).count() == 0


# divergence


def brute_audit(docs, min_docs, limit):
    counts, df, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in docs:
        text, lang, source = text or "", lang or "", source or ""
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(LETTERS))
        groups[lang].add(source)
        counts[lang, source].update(words)
        df[lang].update(set(words))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in df[lang].items() if n >= min_docs]
        whole = Counter()
        for s in sources:
            whole.update({t: counts[lang, s][t] for t in kept})

        def share(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept}

        p, q = {s: share(counts[lang, s]) for s in sources}, share(whole)
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = sorted(((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s))
            out += [(lang, s, "pair", o, -v, i) for i, (v, _, o) in enumerate(pairs, 1)]
            terms = sorted((-f(p[s][t], q[t]), t.encode(), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t])
            out += [(lang, s, "term", t, -v, i) for i, (v, _, t) in enumerate(terms[:limit], 1)]
    return sorted(out)


@pytest.mark.parametrize(("held", "block"), [(10**6, 1 << 20), (5, 4)])
def test_audit(spark, held, block):
    rng = random.Random(8)
    words = ["The", "the", "of", "été", "ÉTÉ", "ab-cd", "x1y", "日本語", "z"] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    docs = [(" ".join(rng.choices(words, k=rng.randint(0, 30))), rng.choice(["en", "de", "fr", None, ""]), rng.choice(["a", "b", "c", "é", None, ""])) for _ in range(160)]
    docs += [(None, "en", "quiet"), ("only one here", "xx", "s1"), ("12 34", "xx", "s2"), ("", "yy", "s"), docs[0], docs[0]]
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "text string, lang string, source string, rank int, term string").repartition(3)
    got = divergence.audit(df, min_docs=3, limit=5, held=held, block=block)
    assert sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in got.collect()) == brute_audit(docs, 3, 5)


def test_no_documents(spark):
    assert divergence.audit(spark.createDataFrame([], "text string, lang string, source string")).count() == 0


def test_merge_opens_few_segments_at_a_time(monkeypatch):
    """Segments wait compressed, and a range much larger than the bound is not merged anew for each of them."""
    rows, opened = [], []
    for k in range(40):
        shard = collocations._Shard([], 10**9)
        shard.add("en", [f"w{k}x{i}" for i in range(50)] + ["a", "b", "c"])
        shard.end("en")
        rows += shard.flush()
    kinds = (pa.int32(), pa.string(), *[pa.int32()] * 4, pa.binary())
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[f.split()[0] for f in collocations.SEGMENT.split(", ")])
    real = collocations.merged
    monkeypatch.setattr(collocations, "merged", lambda tries: opened.append(len(tries)) or real(tries))
    monkeypatch.setattr(collocations, "MERGED_NODES", 300)
    runs = []
    monkeypatch.setattr(collocations, "map_arrow", lambda df, run, schema: runs.append(run))

    class Tries:
        def repartitionById(self, *_):
            return self

    collocations.merge_ranges(Tries(), 1, 10)
    found = pa.Table.from_batches(runs[0](iter([batch]))).to_pylist()
    assert [(r["w1"], r["w2"], r["w3"], r["f"]) for r in found] == [(None, None, None, 2120), ("a", None, None, 40), ("b", None, None, 40), ("c", None, None, 40), ("a", "b", None, 40), ("b", "c", None, 40), ("a", "b", "c", 40)]
    assert max(opened) < 40 and len(opened) < 15
