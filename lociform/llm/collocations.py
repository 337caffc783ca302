"""Collocations: phrases of two and three words that stand together more often than their parts would.

Each shard of the corpus counts its phrases in a trie of depth three for each language. A trie is kept as sorted arrays (words, then pairs,
then third words under their pair), cut at common bounds into ranges of prefixes, and each range is serialised and sent to the
task of that range, which merges the sorted segments of all shards. A prefix is a word and its follower, so a very common word is
spread over many ranges. Only nodes of at least ``min_count`` occurrences leave the merge; nothing is lost by that, as every part of
a candidate occurs at least as often as the candidate.

Left parts come from walking the trie (a third word's node knows its pair); right parts from suffix links, which are joins of a
candidate's tail with the nodes of that phrase.

The bounds come from a bounded sample (``BOUND_DOCS`` documents, ``BOUND_PAIRS`` places each); they decide only which task merges what.

Defined results: a null text has no words, a null language is ``und``; languages without a candidate have no row; repeated
rows count again; ties as stated in ``phrases``. An empty table gives an empty one. Other columns are ignored. A document of any length is read in
stretches, phrases across their ends included. Counts are below 10 ** 15.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import map_arrow
from .common import Scratch, lowered, quoted, stretches, text_or_empty

BREAKS = ".,;:!?\n\x0b\x0c\r"
TOKEN = re.compile(r"[.,;:!?\x0A-\x0D]+|[^\x20\x09.,;:!?\x0A-\x0D]+")
CUT = re.compile(r"[\x20\x09.,;:!?\x0A-\x0D]")
#: A shard's trie is written when it has counted so many words, or holds so many different ones.
SHARD_WORDS, SHARD_TYPES = 1_500_000, 600_000
#: Nodes that wait before they are merged.
MERGED_NODES = 1_500_000
BOUND_DOCS, BOUND_PAIRS, BOUND_CHARS = 1000, 64, 32
#: Bytes of text that one range stands for.
RANGE_BYTES = 32 << 20


@dataclass
class Trie:
    """Sorted words, and nodes by sorted codes: a word, ``word << 32 | word``, and ``place of the pair << 32 | word``."""

    words: list[str]
    one: np.ndarray
    n_one: np.ndarray
    two: np.ndarray
    n_two: np.ndarray
    three: np.ndarray
    n_three: np.ndarray

    def nodes(self) -> int:
        return len(self.one) + len(self.two) + len(self.three)


def _summed(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order with the sums of their counts; sorted runs are merged."""
    if not len(codes):
        return codes, counts
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    return codes[first], np.add.reduceat(counts[order], first)


def count_phrases(ids: np.ndarray, skip: int, words: list[str]) -> Trie:
    """The trie of a sequence of words (places in the sorted list; -1 ends a phrase), without what ends in the first ``skip`` of them."""
    ok = ids >= 0
    counts = np.bincount(ids[skip:][ok[skip:]], minlength=len(words)).astype(np.int64)
    one = np.flatnonzero(counts)
    at = max(0, skip - 1)
    pair = ok[:-1] & ok[1:]
    codes = ids[:-1][pair] << 32 | ids[1:][pair]
    every, place = np.unique(codes, return_inverse=True)
    places = np.full(len(pair), -1)
    places[pair] = place
    n_two = np.bincount(places[at:][places[at:] >= 0], minlength=len(every)).astype(np.int64)
    triple = pair[:-1] & pair[1:]
    three, n_three = np.unique(places[:-1][triple] << 32 | ids[2:][triple], return_counts=True)
    return Trie(words, one, counts[one], every, n_two, three, n_three.astype(np.int64))


def segments(trie: Trie, bounds: list[tuple[str, str]]) -> Iterator[tuple[int, list[int], bytes]]:
    """(range, sizes, bytes) of the parts of a trie between bounds on its (word, follower)."""
    ends = [[0], [0], [0]]
    parents = trie.three >> 32
    for first, second in bounds:
        i = bisect_left(trie.words, first)
        held = i < len(trie.words) and trie.words[i] == first
        # a word's own node stands before all its pairs
        ends[0].append(int(np.searchsorted(trie.one, i + (held and second != ""))))
        ends[1].append(int(np.searchsorted(trie.two, (i << 32) + (bisect_left(trie.words, second) if held else 0))))
        ends[2].append(int(np.searchsorted(parents, ends[1][-1])))
    for k, size in enumerate((len(trie.one), len(trie.two), len(trie.three))):
        ends[k].append(size)
    for r in range(len(bounds) + 1):
        (a, b), (c, d), (e, f) = ((x[r], x[r + 1]) for x in ends)
        if a == b and c == d:
            continue
        two, three = trie.two[c:d], trie.three[e:f]
        parts = [trie.one[a:b], two >> 32, two & 0xFFFFFFFF, three & 0xFFFFFFFF]
        used, local = np.unique(np.concatenate(parts), return_inverse=True)
        cuts = np.cumsum([len(p) for p in parts])[:-1]
        one, first, second, third = np.split(local, cuts)
        text = "\n".join(trie.words[i] for i in used.tolist()).encode()
        columns = [one, trie.n_one[a:b], first, second, trie.n_two[c:d], (three >> 32) - c, third, trie.n_three[e:f]]
        body = text + np.concatenate(columns).astype("<i4").tobytes()
        yield r, [len(text), b - a, d - c, f - e], pa.compress(body, codec="zstd", asbytes=True)


def read_segment(sizes: list[int], packed: bytes) -> Trie:
    n_text, a, b, c = sizes
    body = memoryview(pa.decompress(packed, n_text + 4 * (2 * a + 3 * b + 3 * c), codec="zstd", asbytes=True))
    columns = np.frombuffer(body[n_text:], "<i4").astype(np.int64)
    one, n_one, first, second, n_two, parent, third, n_three = np.split(columns, np.cumsum([a, a, b, b, b, c, c]))
    return Trie(str(body[:n_text], "utf-8").split("\n"), one, n_one, first << 32 | second, n_two, parent << 32 | third, n_three)


def merged(tries: list[Trie]) -> Trie:
    """One trie with the sums of all; its words are the union, in order."""
    if len(tries) == 1:
        return tries[0]
    words = sorted(set().union(*(t.words for t in tries)))
    index = {w: i for i, w in enumerate(words)}
    maps = [np.fromiter(map(index.__getitem__, t.words), np.int64, len(t.words)) for t in tries]
    join = lambda parts: np.concatenate(list(parts))
    one, n_one = _summed(join(m[t.one] for m, t in zip(maps, tries, strict=True)), join(t.n_one for t in tries))
    codes = [m[t.two >> 32] << 32 | m[t.two & 0xFFFFFFFF] for m, t in zip(maps, tries, strict=True)]
    two, n_two = _summed(join(codes), join(t.n_two for t in tries))
    under = [np.searchsorted(two, c)[t.three >> 32] << 32 | m[t.three & 0xFFFFFFFF] for c, m, t in zip(codes, maps, tries, strict=True)]
    three, n_three = _summed(join(under), join(t.n_three for t in tries))
    return Trie(words, one, n_one, two, n_two, three, n_three)


class _Shard:
    """Counts of a task so far, by language."""

    def __init__(self, bounds: list[tuple[str, str, str]], shard_words: int):
        self.langs = [b[0] for b in bounds]
        self.bounds, self.limit = bounds, shard_words
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = defaultdict()
        self.index.default_factory = self.index.__len__
        self.parts: dict[str, list] = defaultdict(list)
        self.skip: dict[str, int] = {}
        self.size = 0

    def add(self, lang: str, tokens: list[str], context: int = 0) -> None:
        """Count tokens, the first ``context`` of which are only what stands before them."""
        part = np.fromiter(map(self.index.__getitem__, tokens), np.int64, len(tokens))
        if context:  # only a stretch after a flush has one, so it is the first
            self.skip[lang] = context
        self.parts[lang].append(part)
        self.size += len(tokens)

    def end(self, lang: str) -> None:
        self.parts[lang].append(np.array([-1]))

    def full(self) -> bool:
        return self.size >= self.limit or len(self.index) >= SHARD_TYPES

    def flush(self) -> list[tuple]:
        words = sorted(w for w in self.index if w[0] not in BREAKS)
        rank = np.full(len(self.index) + 1, -1)
        rank[np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))] = np.arange(len(words))
        self.index.clear()
        out = []
        for lang, parts in self.parts.items():
            trie = count_phrases(rank[np.concatenate([*parts, [-1, -1]])], self.skip.get(lang, 0), words)
            low, high = bisect_left(self.langs, lang), bisect_right(self.langs, lang)
            out += [(low + r, lang, *sizes, packed) for r, sizes, packed in segments(trie, [b[1:] for b in self.bounds[low:high]])]
        self.clear()
        return out


SEGMENT = "range int, lang string, n_text int, n_one int, n_two int, n_three int, packed binary"
NODE = "lang string, w1 string, w2 string, w3 string, f long, f_left long"


def shard_tries(docs: DataFrame, bounds: list[tuple[str, str, str]], shard_words: int = SHARD_WORDS) -> DataFrame:
    """(range, lang, sizes, bytes): the serialised segments of the tries of all shards of docs (text, lang)."""

    def run(batches):
        shard = _Shard(bounds, shard_words)

        def batch(rows):
            kinds = (pa.int32(), pa.string(), *[pa.int32()] * 4, pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[f.split()[0] for f in SEGMENT.split(", ")])

        for b in batches:
            for text, lang in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                last: list[str] = []
                fresh = False
                for stretch in stretches(text.as_py(), CUT):
                    tokens = TOKEN.findall(lowered(stretch))
                    shard.add(lang, last + tokens if fresh else tokens, len(last) if fresh else 0)
                    last, fresh = (last + tokens)[-2:], False
                    if shard.full():
                        if rows := shard.flush():
                            yield batch(rows)
                        fresh = True
                if not fresh:
                    shard.end(lang)
        if shard.size and (rows := shard.flush()):
            yield batch(rows)

    return map_arrow(docs, run, SEGMENT)


def merge_ranges(tries: DataFrame, ranges: int, min_count: int) -> DataFrame:
    """(lang, w1, w2, w3, f, f_left): nodes of min_count occurrences and more, w2 and w3 null above the depth; f_left is the count of
    (w1, w2) of a node with three words. A row without words has all word occurrences of its language in the range."""

    def run(batches):
        # segments wait as they came, compressed; only those of one merge are open at a time
        held: dict[str, Trie] = {}
        waiting: dict[str, list[tuple[list[int], bytes]]] = defaultdict(list)
        new, limit = 0, MERGED_NODES

        def opened(lang: str) -> Trie:
            tries = [held.pop(lang)] if lang in held else []
            return merged(tries + [read_segment(*x) for x in waiting.pop(lang, [])])

        for b in batches:
            for i in range(b.num_rows):
                row = {c: b.column(c)[i].as_py() for c in ("lang", "n_text", "n_one", "n_two", "n_three", "packed")}
                sizes = [row[k] for k in ("n_text", "n_one", "n_two", "n_three")]
                waiting[row["lang"]].append((sizes, row["packed"]))
                new += sum(sizes[1:])
                if new > limit:
                    for lang in list(waiting):
                        held[lang] = opened(lang)
                    # the next merge has at least half as many new ones
                    new, limit = 0, max(MERGED_NODES, sum(t.nodes() for t in held.values()) // 2)
        for lang in sorted({*held, *waiting}):
            t = opened(lang)
            words = pa.array(t.words, pa.string())
            a, b, c = (n >= min_count for n in (t.n_one, t.n_two, t.n_three))
            pair = t.three[c] >> 32
            firsts = np.concatenate([t.one[a], t.two[b] >> 32, t.two[pair] >> 32])
            seconds = np.concatenate([t.two[b] & 0xFFFFFFFF, t.two[pair] & 0xFFFFFFFF])
            n_a, n_b, n_c = int(a.sum()), int(b.sum()), int(c.sum())
            none = lambda n, kind=pa.string(): pa.nulls(n, kind)
            take = lambda ids: words.take(pa.array(ids))
            joined = lambda *arrays: pa.concat_arrays(arrays)
            total = pa.array([int(t.n_one.sum())], pa.int64())
            columns = [
                pa.array([lang] * (1 + n_a + n_b + n_c), pa.string()), joined(none(1), take(firsts)), joined(none(1 + n_a), take(seconds)),
                joined(none(1 + n_a + n_b), take(t.three[c] & 0xFFFFFFFF)), joined(total, pa.array(np.concatenate([t.n_one[a], t.n_two[b], t.n_three[c]]), pa.int64())),
                joined(none(1 + n_a + n_b, pa.int64()), pa.array(t.n_two[pair], pa.int64())),
            ]
            whole = pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in NODE.split(", ")])
            for i in range(0, whole.num_rows, 65536):
                yield whole.slice(i, 65536)

    return map_arrow(tries.repartitionById(ranges, "range"), run, NODE)


def _bounds(docs: DataFrame, n_docs: int, ranges: int) -> list[tuple[str, str, str]]:
    """ranges - 1 bounds on (lang, word, follower), evenly placed among pairs of a sample of documents."""

    def run(batches):
        for b in batches:
            for text, lang in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                tokens = TOKEN.findall(lowered(next(stretches(text.as_py(), CUT), "")))
                step = max(1, len(tokens) // BOUND_PAIRS)
                found = [(tokens[i][:BOUND_CHARS], tokens[i + 1][:BOUND_CHARS]) for i in range(0, len(tokens) - 1, step) if tokens[i][0] not in BREAKS]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found)), pa.array([x for x, _ in found]), pa.array([y for _, y in found])], names=["lang", "a", "b"])

    if ranges < 2 or not n_docs:
        return []
    some = docs.sample(fraction=min(1.0, BOUND_DOCS / n_docs), seed=7).limit(4 * BOUND_DOCS)
    pairs = sorted(tuple(r) for r in map_arrow(some, run, "lang string, a string, b string").collect())
    return sorted({pairs[len(pairs) * k // ranges] for k in range(1, ranges)}) if pairs else []


def phrases(
    df: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = 10, limit: int = 2000, covered: int = 50,
    ranges: int | None = None, shard_words: int = SHARD_WORDS, scratch: Scratch | None = None,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``limit`` phrases by score descending, a descending, phrase ascending.

    a, l, r: occurrences of the phrase, its left and its right part at the cut of the lowest score (the first of equal ones); n: all words of
    the language; score: floor(10^6 a a / (l r)). A phrase of two words is left out if a candidate of three words holds it and has
    at least ``covered`` percent of its occurrences.
    """
    scratch = scratch or Scratch(df.sparkSession, "phrases")
    docs = df.select(text_or_empty(text_col).alias("text"), F.coalesce(F.col(quoted(lang_col)).cast("string"), F.lit("und")).alias("lang"))
    n_docs, n_bytes = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    ranges = ranges or max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_bytes // RANGE_BYTES))
    bounds = _bounds(docs, n_docs, ranges)
    nodes = scratch.keep(merge_ranges(shard_tries(docs, bounds, shard_words), len(bounds) + 1, min_count), "nodes")
    totals = nodes.where("w1 is null").groupBy("lang").agg(F.sum("f").alias("n"))
    one = nodes.where("w1 is not null and w2 is null")
    two = nodes.where("w2 is not null and w3 is null")
    three = nodes.where("w3 is not null")
    word = lambda w, f: one.select("lang", F.col("w1").alias(w), F.col("f").alias(f))
    pairs = two.select("lang", "w1", "w2", F.col("f").alias("a")).join(word("w1", "l_1"), ["lang", "w1"]).join(word("w2", "r_1"), ["lang", "w2"])
    within = three.select("lang", "f", F.explode(F.array(F.struct(F.col("w1").alias("w1"), F.col("w2").alias("w2")), F.struct(F.col("w2").alias("w1"), F.col("w3").alias("w2")))).alias("p"))
    within = within.groupBy("lang", "p.w1", "p.w2").agg(F.max("f").alias("longer"))
    pairs = pairs.join(within, ["lang", "w1", "w2"], "left").where(f"longer is null or 100 * longer < {covered} * a")
    pairs = pairs.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", F.array(F.struct(F.col("l_1").alias("l"), F.col("r_1").alias("r"))).alias("cuts"))
    tail = two.select("lang", F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("f").alias("r_1"))
    triples = three.select("lang", "w1", "w2", "w3", F.col("f").alias("a"), F.col("f_left").alias("l_2"))
    triples = triples.join(tail, ["lang", "w2", "w3"]).join(word("w1", "l_1"), ["lang", "w1"]).join(word("w3", "r_2"), ["lang", "w3"])
    cut = lambda k: F.struct(F.col(f"l_{k}").alias("l"), F.col(f"r_{k}").alias("r"))
    triples = triples.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", F.array(cut(1), cut(2)).alias("cuts"))
    wide = lambda x: f"cast({x} as decimal(15, 0))"
    scored = F.expr(f"transform(cuts, (c, k) -> struct((cast(1000000 as decimal(7, 0)) * {wide('a')} * {wide('a')}) div ({wide('c.l')} * {wide('c.r')}) as score, k, c.l, c.r))")
    found = pairs.unionByName(triples).withColumn("best", F.array_min(scored)).select("lang", "phrase", "a", "best.l", "best.r", "best.score")
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    # the first of a language are among the first of each of its shares
    found = found.withColumn("share", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("rank") <= limit)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= limit)
    return found.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
