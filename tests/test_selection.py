"""Merge trees, backbone edges and connected growth against brute force on small graphs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociform.operators import backbone, growth, merge_tree
from lociform.storage import Scratch


def parts(nodes, links):
    """The connected sets of nodes under links."""
    near = {v: set() for v in nodes}
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    left, out = set(nodes), []
    while left:
        todo = [min(left)]
        seen = set(todo)
        while todo:
            todo = [u for v in todo for u in near[v] if u not in seen and not seen.add(u)]
        out.append(frozenset(seen))
        left -= seen
    return out


@pytest.fixture(scope="module")
def case():
    rng = np.random.default_rng(11)
    links = sorted({tuple(sorted(map(int, rng.choice(80, 2, replace=False)))) for _ in range(130)})
    scores = {v: float(np.round(rng.normal(), 1)) for v in range(84)}  # ties; 80 to 83 lie outside the graph
    return links, scores, {v: 1.0 if v % 3 else 1e-9 for v in scores}


def modules_by_hand(links, score, p, fractions, repeats, min_size, min_weak, max_modules):
    nodes = sorted({v for e in links for v in e})
    order = sorted((v for v in nodes), key=lambda v: (-score[v], v))
    out, seen = [], set()
    for f in sorted(fractions):
        k = max(1, round(len(order) * f))
        chosen = set(order[:k])
        inner = [e for e in links if e[0] in chosen and e[1] in chosen]
        for c in sorted(parts(chosen, inner), key=min):
            weak = sum(p[v] > 5e-8 for v in c)
            if len(c) < min_size or weak < min_weak or (not repeats and c in seen):
                continue
            seen.add(c)
            m = sum(1 for a, b in inner if a in c)
            n = len(c)
            out.append((n >= 0.5 * k, -sum(score[v] for v in c) / n, -n, -2 * m / (n * (n - 1)), f, min(c), weak))
    return sorted((r[0], round(r[1], 9), *r[2:]) for r in out)[:max_modules]


@pytest.mark.parametrize("repeats", [False, True])
def test_reselection(spark, case, repeats):
    links, scores, p = case
    e = spark.createDataFrame([(a, b, 1.0) for a, b in links], "src long, dst long, weight double")
    s = spark.createDataFrame([(v, x, v % 4, p[v]) for v, x in scores.items()], "node long, score double, bin int, p double")
    fractions = (0.1, 0.3, 0.2, 0.6)
    modules, nulls = merge_tree.reselection_null(e, s, 4, fractions, repeats=repeats, min_size=3, min_weak=2, max_modules=6)
    want = modules_by_hand(links, scores, p, fractions, repeats, 3, 2, 6)
    got = sorted((r["is_broad"], round(-r["mean_score"], 9), -r["n_genes"], -r["edge_density"], r["rank_fraction"], r["least_node"], r["n_weak"]) for r in modules.collect())
    assert len(got) == len(want) > 2 and np.allclose(np.array(got, float), np.array(want, float))
    from lociform.operators.relational import hash_permute

    on = s.where(F.col("node").isin(sorted({v for x in links for v in x})))
    dealt = hash_permute(on, "score", "node", ["bin"], 4).toPandas()
    tops = {r["replicate"]: r for r in nulls.collect()}
    assert sorted(tops) == [0, 1, 2, 3]
    for r, part in dealt.groupby("replicate"):
        hand = modules_by_hand(links, dict(zip(part["node"], part["score"], strict=True)), p, fractions, repeats, 3, 2, 6)
        assert tops[r]["n_modules"] == len(hand)
        if hand:
            assert tops[r]["max_mean_score"] == pytest.approx(max(-h[1] for h in hand)) and tops[r]["max_n_genes"] == max(-h[2] for h in hand) and tops[r]["max_edge_density"] == pytest.approx(max(-h[3] for h in hand))
    for m in modules.collect():
        assert m["mean_score_p"] == pytest.approx((sum(round(t["max_mean_score"], 9) >= round(m["mean_score"], 9) for t in tops.values()) + 1) / 5)


def test_shares_of_all_thresholds(spark, case):
    """Every share from one tree: the components equal those of a search for each share."""
    links, scores, _ = case
    e = spark.createDataFrame([(a, b, 1.0) for a, b in links], "src long, dst long, weight double")
    s = spark.createDataFrame([(0, v, x) for v, x in scores.items()], "replicate int, node long, score double")
    grid = [i / 20 for i in range(1, 21)]
    got = {(round(r["rank_fraction"], 3), r["least_node"]): (r["n_genes"], r["n_edges"]) for r in merge_tree.share_components(e, s, grid).collect()}
    nodes = sorted({v for x in links for v in x})
    order = sorted(nodes, key=lambda v: (-scores[v], v))
    want = {}
    for f in grid:
        chosen = set(order[: max(1, round(len(order) * f))])
        inner = [x for x in links if x[0] in chosen and x[1] in chosen]
        want |= {(round(f, 3), min(c)): (len(c), sum(1 for a, _ in inner if a in c)) for c in parts(chosen, inner)}
    assert got == want


def test_no_edges(spark):
    e = spark.createDataFrame([], "src long, dst long, weight double")
    modules, nulls = merge_tree.reselection_null(e, spark.createDataFrame([(1, 1.0, 0)], "node long, score double, bin int"), 3)
    assert modules.count() == 0 and {r["n_modules"] for r in nulls.collect()} == {0} and nulls.count() == 3


def backbone_by_hand(existing, candidates, nodes, target, most):
    of = {}
    for c in parts(nodes, existing):
        of |= dict.fromkeys(c, c)
    largest = sorted(set(of.values()), key=lambda c: (-len(c), min(c)))[0]
    goal, limit, out = math.ceil(target * len(nodes)), math.floor(most * len(nodes)), []
    for a, b, w, s, p in sorted(candidates, key=lambda r: (-r[4], -r[2], -r[3], r[0], r[1])):
        if of[a] == of[b] or (of[a] != largest and of[b] != largest):
            continue
        size = len(of[a]) + len(of[b])
        if size > limit:
            if len(largest) >= goal:
                break
            continue
        largest = of[a] | of[b]
        of |= dict.fromkeys(largest, largest)
        out.append((a, b, size))
        if size >= goal:
            break
    return out, len(largest)


@pytest.mark.parametrize(("seed", "target", "most"), [(1, 0.5, 0.6), (2, 0.65, 0.7), (3, 0.9, 1.0), (4, 0.2, 0.25), (5, 1.0, 1.0), (6, 0.45, 0.46)])
def test_backbone(spark, seed, target, most):
    rng = np.random.default_rng(seed)
    pairs = sorted({tuple(sorted(map(int, rng.choice(60, 2, replace=False)))) for _ in range(150)})
    rng.shuffle(pairs)
    existing, rest = [tuple(x) for x in pairs[:38]], [tuple(x) for x in pairs[38:]]
    support = {v: float(rng.integers(0, 5)) / 4 for v in range(0, 60, 2)}
    frame = lambda x: spark.createDataFrame([(int(a), int(b), float(w)) for a, b, w in x], "src long, dst long, weight double")
    weights = [float(rng.integers(1, 6)) for _ in rest]
    universe = spark.range(60).select(F.col("id").alias("node"))
    every = frame([*[(a, b, 1.0) for a, b in existing], *[(a, b, w) for (a, b), w in zip(rest, weights, strict=True)], (3, 99, 9.0)])
    candidates = backbone.candidate_edges(every, frame([(a, b, 1.0) for a, b in existing]), spark.createDataFrame(list(support.items()), "node long, support double"), universe)
    rows = [tuple(r) for r in candidates.collect()]
    shared = lambda a, b: math.sqrt(support.get(a, 0.0) * support.get(b, 0.0))
    want = [(a, b, w, shared(a, b), 0.75 * w + 0.25 * shared(a, b)) for (a, b), w in zip(rest, weights, strict=True)]
    assert np.allclose(np.array(sorted(rows)), np.array(sorted(want)))
    got, report = backbone.add_backbone(frame([(a, b, 1.0) for a, b in existing]), candidates, universe, target, most)
    hand, size = backbone_by_hand(existing, rows, range(60), target, most)
    assert sorted((r["src"], r["dst"], r["component_size"]) for r in got.collect()) == sorted(hand) and report["final_size"] == size and report["n_added"] == len(hand)


def test_backbone_opens_no_window_after_the_target(spark):
    class Seen(Scratch):
        def keep(self, df, name):
            names.append(name)
            return super().keep(df, name)

    rng, names = np.random.default_rng(8), []
    pairs = sorted({tuple(sorted(map(int, rng.choice(30, 2, replace=False)))) for _ in range(200)})
    rows = [(a, b, float(w), 0.0, float(w)) for (a, b), w in zip(pairs, rng.integers(1, 40, len(pairs)), strict=True)]
    candidates = spark.createDataFrame(rows, "src long, dst long, weight double, edge_support double, priority double")
    existing = spark.createDataFrame([(0, 1, 1.0)], "src long, dst long, weight double")
    got, _ = backbone.add_backbone(existing, candidates, spark.range(30).select(F.col("id").alias("node")), 0.4, 0.5, Seen(spark, "backbone"), (0.5, 0.75))
    hand, _ = backbone_by_hand([(0, 1)], rows, range(30), 0.4, 0.5)
    assert sorted((r["src"], r["dst"], r["component_size"]) for r in got.collect()) == sorted(hand)
    assert "window-0-0" in names and "window-0-2" not in names


def test_empty_universe(spark):
    none = spark.createDataFrame([], "src long, dst long, weight double")
    nodes = spark.createDataFrame([], "node long")
    got, report = backbone.add_backbone(none, backbone.candidate_edges(none, none, spark.createDataFrame([], "node long, support double"), nodes), nodes)
    assert got.count() == 0 and report["n_added"] == 0




# connected growth


@pytest.fixture(scope="module")
def field(spark):
    rng = np.random.default_rng(21)
    links = sorted({tuple(sorted(map(int, rng.choice(50, 2, replace=False)))) for _ in range(85)} | {(50, 51), (51, 52), (52, 53), (53, 54), (54, 55)})
    near = {v: set() for v in range(56)}
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    score = {v: float(np.round(rng.normal(), 2)) for v in range(56)}
    edges = spark.createDataFrame([(a, b, 1.0) for a, b in links], "src long, dst long, weight double")
    scores = spark.createDataFrame([(v, score[v], len(near[v])) for v in range(56)], "node long, score double, degree long")
    return edges, scores, near, score


def ball_by_hand(near, seed, radius):
    dist, todo = {seed: 0}, [seed]
    for d in range(1, radius + 1):
        todo = [u for v in todo for u in near[v] if u not in dist and dist.setdefault(u, d) == d]
    return dist


def grow_by_hand(near, seed, allowed, key, size):
    have, links = [seed], {u: 1 for u in near[seed] if u in allowed}
    while links and len(have) < size:
        u = max(links, key=lambda x: key(x, links[x]))
        have.append(u)
        del links[u]
        for v in near[u]:
            if v in allowed and v not in have:
                links[v] = links.get(v, 0) + 1
    return have


def orders(rows):
    out = {}
    for r in sorted(rows, key=lambda r: r["step"]):
        out.setdefault(r["seed"], []).append(r["node"])
    return out


@pytest.mark.parametrize("deltas", [False, True])
def test_adaptive(spark, field, deltas):
    edges, scores, near, score = field
    sizes = (5, 8, 12)
    results, order = growth.adaptive_neighbourhoods(edges, scores, 9, 2, sizes, 5, 4, deltas)
    got, stats = orders(order.collect()), {(r["seed"], r["size"]): (r["stat"], r["is_best"]) for r in results.collect()}
    seeds = [v for v in sorted(score, key=lambda v: (-score[v], v)) if not deltas or score[v] > 0][:9]
    want, best = {}, None
    for seed in seeds:
        ball = ball_by_hand(near, seed, 2)
        if len(ball) < 5:
            assert seed not in got
            continue
        hand = grow_by_hand(near, seed, ball, lambda x, _: (score[x], -len(near[x]), -x), 12)
        assert got[seed] == hand
        for s in sizes:
            if s <= len(hand):
                inside, rest = [score[v] for v in hand[:s]], [score[v] for v in ball if v not in hand[:s]]
                stat = sum(max(x, 0) for x in inside) / s**0.5 if deltas else (np.mean(inside) - np.mean(rest)) * s**0.5 / np.std(rest, ddof=1) if len(rest) >= 4 else None
                want[seed, s] = stat
                if stat is not None and (best is None or round(stat, 9) > round(want[best], 9)):
                    best = (seed, s)
    assert set(stats) == set(want)
    assert all(stats[k][0] is None if v is None else stats[k][0] == pytest.approx(v) for k, v in want.items())
    assert [k for k, (_, b) in stats.items() if b] == [best]


def test_contrast(spark, field):
    edges, scores, near, score = field
    sizes = (5, 7)
    results, order = growth.contrast_neighbourhoods(edges, scores, 6, 1, 2, 6, sizes, 4, 0.3, 0.2, pool_size=30, degree_bins=4)
    got, rows = orders(order.collect()), results.collect()
    by_degree = sorted(score, key=lambda v: (len(near[v]), v))
    bins = {v: max(0, math.ceil(i * 4 / 55) - 1) for i, v in enumerate(by_degree)}
    local = {v: np.mean(sorted((score[u] for u in {v} | near[v]), reverse=True)[:4]) for v in score}
    pool = sorted(score, key=lambda v: (-round(local[v], 12), v))[:30]
    held = []
    for seed in pool:
        dist = ball_by_hand(near, seed, 2)
        inside, around, source = {v for v, d in dist.items() if d <= 1}, [v for v, d in dist.items() if d == 2], "annulus"
        if len(around) < 6:
            around, source = [v for v in score if bins[v] == bins[seed] and v not in inside], "degree_bin"
        if len(around) < 6:
            around, source = [v for v in score if v not in inside], "global"
        if len(inside) < 4:
            continue
        x = np.array([score[v] for v in around])
        mid = np.median(x)
        scale = 1.4826 * np.median(np.abs(x - mid))
        scale = (scale if scale > 1e-6 else np.std(x, ddof=1) if np.std(x, ddof=1) > 1e-6 else 1e-6) + 1e-6
        top = sorted((score[v] for v in inside), reverse=True)[:4]
        held.append((-round((np.mean(top) - mid) * 2 / scale, 9), len(near[seed]), seed, inside, mid, scale, source, len(around)))
    held.sort(key=lambda h: h[:3])
    seen = {}
    for _, _, seed, inside, mid, scale, source, n in held[:6]:
        z = {v: (score[v] - mid) / scale for v in inside}
        value = lambda x, k, z=z: (round(z[x] + 0.3 * math.log1p(k) - 0.2 * math.log1p(len(near[x])), 12), z[x], k, -x)
        hand = grow_by_hand(near, seed, inside, value, 7)
        assert got[seed] == hand
        seen |= {(seed, s): (np.mean([z[v] for v in hand[:s]]) * s**0.5, source, n) for s in sizes if s <= len(hand)}
    assert {(r["seed"], r["size"]): (pytest.approx(r["stat"]), r["source"], r["n_background"]) for r in rows} == seen and len(seen) > 4
    best = max(rows, key=lambda r: (round(r["stat"], 9), -r["seed_rank"], -r["size"]))
    assert [(r["seed"], r["size"]) for r in rows if r["is_best"]] == [(best["seed"], best["size"])]


@pytest.mark.parametrize("hubs", [False, True])
def test_compact(spark, field, hubs):
    edges, _, near, _ = field
    seeds = spark.createDataFrame([(v,) for v in (0, 7, 19, 52, 55)], "seed long")
    got = orders(growth.compact_sets(edges, seeds, 7, hubs).collect())
    d = {v: len(n) for v, n in near.items()}
    long = {v for v in (0, 7, 19, 52, 55) if len(ball_by_hand(near, v, 56)) >= 7}
    for seed in long:
        key = (lambda x, _, s=seed: (d[x], -abs(d[x] - d[s]), x)) if hubs else (lambda x, _, s=seed: (-abs(d[x] - d[s]), -d[x], -x))
        assert got[seed] == grow_by_hand(near, seed, set(near), key, 7)
    assert set(got) == long and 0 in long and 52 not in long  # the chain of six is too short


def test_growth_of_nothing(spark):
    none = spark.createDataFrame([], "src long, dst long, weight double")
    results, order = growth.adaptive_neighbourhoods(none, spark.createDataFrame([(1, 1.0, 0)], "node long, score double, degree long"), 3)
    assert results.count() == 0 and order.count() == 0
