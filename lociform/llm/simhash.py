"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint is cut into blocks so that close pairs share some of them; fingerprints
are joined on the shared blocks and each candidate's Hamming distance is verified.

``link_components`` (64 bits, few differing bits) is exact. With ``d`` allowed bits the
fingerprint has ``d + 2`` blocks, so a close pair agrees in two blocks at least and a key is a
pair of blocks. A small bucket is joined with itself. A large one is never: two
fingerprints at distance two or less have a common neighbour at distance one or less from
both, so each emits itself and its one-bit neighbours outside the shared blocks, and all
that meet at a neighbour are linked to the least of them. The number of rows stays
proportional to the number of fingerprints, whatever the size of a group.

``near_duplicates`` (long fingerprints of several 64-bit words) serves
similarity thresholds such as 0.8, where dozens of bits differ. A pair of the threshold
similarity shares a block with a stated probability. In small buckets all pairs are
verified. In larger ones each fingerprint is verified against one pivot; then
those outside the bucket's largest component are verified against the whole bucket, which leaves no
link between components unseen; buckets with many such are first split by further bytes.
A pair whose fingerprints differ so little that its similarity is above the threshold by five standard deviations, whatever the sizes of the sets, is a link; of all others within
the bound the sets of shingles themselves are compared, unless links have joined them before. So no pair below the threshold is linked.

Defined results: null and empty texts have no words and the fingerprint zero, which is
linked like any other in ``link_components`` and makes one group of copies in
``near_duplicates``; a null id takes part, and a component of null ids alone has a null
component id; repeated rows stay rows. Extra columns pass through; those named
like an added column are replaced.
"""

from __future__ import annotations

import itertools
import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.components import components, joined
from ..shipping import map_arrow
from .common import Scratch, append_columns, quoted, text_or_empty, without

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SEED = 42
#: Buckets up to this size are joined with themselves.
SMALL = 32
#: ``near_duplicates`` verifies all pairs of buckets up to this size.
PAIRED = 8
#: Members outside a larger bucket's largest component are verified against so many of that component.
PIVOTS = 4
#: Buckets with up to so many members outside their largest component are settled by comparing those with the whole bucket.
CROSSED = 256
#: A bucket with more of them is split by so many further bytes of the fingerprint, each on its own.
SUB_BLOCKS = 32


def shingle_hashes(text: str, width: int) -> np.ndarray:
    """XXH64 of each run of ``width`` words, repeats included; of the whole sequence if it is shorter."""
    words = WORD.findall(text.translate(UPPER) if not text.isascii() else text.lower())
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= width:
        runs = [" ".join(words)]
    else:
        runs = list(map(" ".join, zip(*(words[i:] for i in range(width)), strict=False)))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(x, SEED) for x in runs), np.uint64, len(runs))


def bit_counts(words: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set in each column of an (n, k) array: (k, 64).

    Rows of one weight are added in threes by a full adder (sum keeps the weight, carry
    doubles it) until at most two are left; a few passes over the words, no 64-fold expansion.
    """
    level, out, weight = words, np.zeros((words.shape[1], 64), np.int64), 1
    carries: list[np.ndarray] = []
    while len(level):
        carries = []
        while len(level) > 2:
            m = len(level) // 3
            a, b, c = level[:m], level[m : 2 * m], level[2 * m : 3 * m]
            half = a ^ b
            carries.append((a & b) | (half & c))
            level = np.concatenate([half ^ c, level[3 * m :]])
        for row in level:
            out += weight * np.unpackbits(np.ascontiguousarray(row).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int64)
        level = np.concatenate(carries) if carries else words[:0]
        weight *= 2
    return out


def mixed(hashes: np.ndarray, words: int) -> np.ndarray:
    """(n, words): further 64-bit hashes of each shingle, by an invertible mix of the first with a word's number."""
    with np.errstate(over="ignore"):
        z = hashes[:, None] + np.arange(words, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def fingerprint_words(text: str, width: int, words: int) -> np.ndarray:
    h = shingle_hashes(text, width)
    counts = np.zeros((words, 64), np.int64)
    for i in range(0, len(h), 1 << 15):  # a long text is counted piece by piece
        part = h[i : i + (1 << 15)]
        counts += bit_counts(part[:, None] if words == 1 else mixed(part, words))
    set_bits = counts * 2 > len(h)
    return np.packbits(set_bits, axis=1, bitorder="little").view(np.uint64).reshape(-1)


def set_fingerprint(text: str, width: int, words: int) -> np.ndarray:
    """The fingerprint of the set of a text's shingles."""
    h = np.unique(shingle_hashes(text, width))
    counts = np.zeros((words, 64), np.int64)
    for i in range(0, len(h), 1 << 13):
        counts += bit_counts(mixed(h[i : i + (1 << 13)], words))
    return np.packbits(counts * 2 > len(h), axis=1, bitorder="little").view(np.uint64).reshape(-1)


def fingerprints(df: DataFrame, text_col: str = "text", width: int = 3, out: str = "fp") -> DataFrame:
    """df with a 64-bit fingerprint as a long: a map without a shuffle."""

    def kernel(texts: pa.Array) -> list[pa.Array]:
        made = np.array([fingerprint_words(t, width, 1)[0] for t in texts.to_pylist()], np.uint64)
        return [pa.array(made.view(np.int64), pa.int64())]

    return append_columns(df, [text_or_empty(text_col)], [T.StructField(out, T.LongType())], kernel)


def _keys(fp, max_distance: int) -> list:
    """(table, key, mask of free bits) for every pair of blocks."""
    n = max_distance + 2
    cuts = [round(i * 64 / n) for i in range(n + 1)]
    masks = [sum(1 << b for b in range(cuts[i], cuts[i + 1])) for i in range(n)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    out = []
    for k, (i, j) in enumerate(itertools.combinations(range(n), 2)):
        shared = masks[i] | masks[j]
        out.append((k, shared, [b for b in range(64) if not shared >> b & 1], signed(shared)))
    return [F.struct(F.lit(k).alias("t"), fp.bitwiseAND(F.lit(s)).alias("key")) for k, _, _, s in out], {k: bits for k, _, bits, _ in out}


def fingerprint_links(fps: DataFrame, max_distance: int = 2, scratch: Scratch | None = None) -> DataFrame:
    """(a, b), a < b: links of the distinct longs ``fp`` whose components are those of all pairs within max_distance (2 or less).

    Sizes of buckets, as all aggregated sides of joins here, are written first: a join of two plain tables is
    one whose hot keys Spark deals to several tasks.
    """
    scratch = scratch or Scratch(fps.sparkSession, "links")
    if max_distance > 2:
        raise ValueError("large buckets are linked through common neighbours, which needs max_distance <= 2")
    keys, free = _keys(F.col("fp"), max_distance)
    rows = fps.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.t", "k.key")
    shared = scratch.keep(rows.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    rows = rows.join(shared, ["t", "key"])
    few = rows.where(F.col("n") <= SMALL)
    near = (
        few.alias("x")
        .join(few.alias("y"), ["t", "key"])
        .where("x.fp < y.fp")
        .where(F.bit_count(F.expr("x.fp ^ y.fp")) <= max_distance)
        .select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    )
    signed = lambda b: -(1 << 63) if b == 63 else 1 << b
    flips = F.create_map(*itertools.chain.from_iterable((F.lit(t), F.array(*(F.lit(f).cast("long") for f in [*map(signed, bits), 0]))) for t, bits in free.items()))
    if max_distance < 2:  # a common neighbour of two others at distance one is at distance two from each other
        flips = None
    many = rows.where(F.col("n") > SMALL)
    if flips is not None:
        met = many.select("t", "key", "fp", F.explode(flips[F.col("t")]).alias("flip")).select("t", F.col("fp").bitwiseXOR(F.col("flip")).alias("m"), "fp")
        # all that meet at m are within two bits of each other; m's shared blocks hold the key
        least = met.groupBy("t", "m").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
        near = near.unionByName(met.join(least, ["t", "m"]).where("a < fp").select("a", F.col("fp").alias("b")))
    else:
        alone = many.select("fp", F.explode(F.array(*(F.lit(signed(b)) for b in range(64)))).alias("flip")).select(F.col("fp").alias("a"), F.col("fp").bitwiseXOR(F.col("flip")).alias("b"))
        near = near.unionByName(alone.join(many.select(F.col("fp").alias("b")).distinct(), "b", "left_semi").where("a < b").select("a", "b"))
    return near.distinct()


def link_components(
    df: DataFrame, text_col: str = "text", id_col: str = "doc_id", width: int = 3, max_distance: int = 2, scratch: Scratch | None = None
) -> DataFrame:
    """(id, fp, component_id) for every row of df; component_id is the least id that links reach."""
    scratch = scratch or Scratch(df.sparkSession, "simhash")
    made = fingerprints(df.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text")), "text", width)
    docs = scratch.keep(made.select("id", "fp"), "fingerprints")
    firsts = scratch.keep(docs.groupBy("fp").agg(F.min("id").alias("first")), "firsts")
    found = components(fingerprint_links(firsts.select("fp"), max_distance, scratch), scratch)
    found = scratch.keep(found, "components")
    linked = firsts.join(found, firsts["fp"] == found["node"])
    roots = linked.groupBy("root").agg(F.min("first").alias("least"))
    moved = linked.join(roots, "root").select("fp", F.col("least").alias("moved"))
    label = scratch.keep(firsts.join(moved, "fp", "left").select("fp", F.coalesce("moved", "first").alias("component_id")), "labels")
    return docs.join(label, "fp").select("id", "fp", "component_id")


def near_duplicates(
    df: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    width: int = 5,
    similarity: float = 0.8,
    recall: float = 0.995,
    words: int = 24,
    scratch: Scratch | None = None,
) -> DataFrame:
    """(id, row, component): the near-duplicate group of each row at a similarity of its sets of shingles.

    Two equally large sets of Jaccard similarity s have the cosine 2s / (1 + s), others a larger one; a
    pair is a candidate if at most the share of bits that belongs to that angle, plus three standard
    deviations, differ, and is then compared exactly (one pair in 700 at the threshold is lost by that); of a candidate pair first one word is compared, with a bound of 4.5 standard deviations
    (one pair in 10^5 at the threshold is lost by that). Sets have a cosine of the root of s at least at similarity s, so pairs five deviations within that angle need no exact comparison. Blocks widen with the logarithm of the number of rows, so that unrelated
    texts seldom meet, and are as many as a pair at ``similarity`` needs to share one with
    probability ``recall``; ``words`` is the least length of a fingerprint in 64-bit words.
    ``row`` numbers rows; ``component`` is the ``row`` that a group keeps: of its smallest id.
    """
    scratch = scratch or Scratch(df.sparkSession, "near")
    share = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    base = df.select(F.col(quoted(id_col)).alias("id"), text_or_empty(text_col).alias("text"))
    block_bits = max(12, base.count().bit_length() + 1)
    n_blocks = math.ceil(math.log(1 - recall) / math.log(1 - (1 - share) ** block_bits))
    words = max(words, -(-n_blocks * block_bits // 64))
    bits = 64 * words
    within = int(bits * share + 3 * (bits * share * (1 - share)) ** 0.5)
    least_share = float(np.arccos(similarity**0.5) / np.pi)
    sure = int(bits * least_share - 5 * (bits * least_share * (1 - least_share)) ** 0.5)
    first_within = int(64 * share + 4.5 * (64 * share * (1 - share)) ** 0.5)

    def kernel(texts: pa.Array) -> list[pa.Array]:
        return [pa.array([set_fingerprint(t, width, words).tobytes() for t in texts.to_pylist()], pa.binary())]

    # exact copies first: one row for each text, whatever their number
    base = base.withColumns({"row": F.monotonically_increasing_id(), "digest": F.unhex(F.sha2(F.col("text").cast("binary"), 256))})
    rows = scratch.keep(append_columns(base, [F.col("text")], [T.StructField("fp", T.BinaryType())], kernel, keep=["id", "row", "digest"]), "rows")
    firsts = rows.groupBy("digest").agg(F.min(F.struct(F.col("id").isNull(), "id", "row")).alias("first"), F.first("fp").alias("fp"))
    firsts = scratch.keep(firsts.select(F.xxhash64("digest").alias("node"), "digest", "first", "fp"), "texts")

    def blocks(low: int, high: int, found: DataFrame | None) -> DataFrame:
        """(node, w, c, bucket) of the blocks from low on: a text's first word, its component so far, and a bucket for each block."""

        def keys(fps: pa.Array) -> list[pa.Array]:
            held = np.frombuffer(b"".join(fps.to_pylist()), np.uint8).reshape(len(fps), 8 * words)
            bits_ = np.unpackbits(held, axis=1, bitorder="little")[:, low * block_bits : high * block_bits].reshape(len(fps), high - low, block_bits)
            made = bits_ @ (1 << np.arange(block_bits, dtype=np.int64))
            return [pa.ListArray.from_arrays(pa.array(np.arange(len(fps) + 1) * (high - low), pa.int32()), pa.array(made.ravel()))]

        held = firsts.select("node", long_of(F.col("fp"), 0).alias("w"), "fp")
        held = held.withColumn("c", F.col("node")) if found is None else held.join(found.select("node", F.col("root").alias("c")), "node", "left").withColumn("c", F.coalesce("c", "node"))
        made = append_columns(held, [F.col("fp")], [T.StructField("keys", T.ArrayType(T.LongType()))], keys, keep=["node", "w", "c"])
        return made.select("node", "w", "c", F.posexplode("keys").alias("t", "key")).select("node", "w", "c", F.xxhash64(F.col("t") + low, "key").alias("bucket"))

    long_of = lambda c, i: F.conv(F.hex(F.substring(c, 8 * i + 1, 8)), 16, -10).cast("long")
    small = firsts.select("node", F.array(*(long_of(F.col("fp"), i) for i in range(words))).alias("f"))

    def gap(x: str, y: str):
        return F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, p: s + p)

    first_words = F.bit_count(F.expr("x.w ^ y.w")) <= first_within

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = pairs.distinct()
        pairs = pairs.join(small.select(F.col("node").alias("a"), F.col("f").alias("fa")), "a").join(small.select(F.col("node").alias("b"), F.col("f").alias("fb")), "b")
        return pairs.withColumn("gap", gap("fa", "fb")).where(F.col("gap") <= within).select("a", "b", "gap")

    def met(x: DataFrame, y: DataFrame, different) -> DataFrame:
        """Pairs in a bucket whose first words are close enough for the whole fingerprints to be."""
        return x.alias("x").join(y.alias("y"), "bucket").where(different & first_words).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))

    def close(x: DataFrame, y: DataFrame, different, most: int = within) -> DataFrame:
        """Close pairs (a, b, gap) in a bucket of rows with their whole fingerprints f, so that only those leave the join."""
        both = x.alias("x").join(y.alias("y"), "bucket").where(different & first_words & (gap("x.f", "y.f") <= most))
        return both.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), gap("x.f", "y.f").alias("gap")).distinct()

    def alike(pairs: DataFrame, name: str) -> DataFrame:
        """Those of the pairs (a, b) whose sets of shingles have the similarity."""
        needed = scratch.keep(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(firsts.select("node", "digest"), "node"), f"needed-{name}")
        texts = df.select(text_or_empty(text_col).alias("text")).withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
        texts = texts.join(needed, "digest").groupBy("node").agg(F.first("text").alias("text"))

        def sets_kernel(values: pa.Array) -> list[pa.Array]:
            return [pa.array([np.unique(shingle_hashes(t, width)).tobytes() for t in values.to_pylist()], pa.binary())]

        sets = scratch.keep(append_columns(texts, [F.col("text")], [T.StructField("set", T.BinaryType())], sets_kernel, keep=["node"]), f"sets-{name}")

        def compare(batches):
            for batch in batches:
                kept = []
                for x, y in zip(batch.column(2), batch.column(3), strict=True):
                    x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                    shared = len(np.intersect1d(x, y, assume_unique=True))
                    kept.append(shared >= similarity * (len(x) + len(y) - shared) - 1e-9)
                yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

        both = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("sb")), "b")
        out = scratch.keep(map_arrow(both.select("a", "b", "sa", "sb"), compare, "a long, b long"), f"alike-{name}")
        scratch.drop(f"needed-{name}")
        scratch.drop(f"sets-{name}")
        return out

    def settled(found: DataFrame | None, pairs: DataFrame, name: str) -> DataFrame:
        """found with the links among close pairs: the sure ones first, then those that the sets confirm."""
        links = pairs.where(F.col("gap") <= sure).groupBy("b").agg(F.min("a").alias("m"), F.collect_set("a").alias("s"))
        # a node is close to a bounded number of pivots and of others in small buckets: it is linked to the least, and these to each other through it
        links = links.select(F.explode(F.concat(F.array(F.struct("m", "b")), F.transform("s", lambda x: F.struct(F.col("m"), x.alias("b"))))).alias("e"))
        links = scratch.keep(links.select(F.col("e.m").alias("a"), "e.b").where("a <> b").distinct(), f"sure-{name}")
        found = joined(found, links, scratch, f"found-{name}-sure")
        root = lambda c: found.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
        open_ = pairs.where(F.col("gap") > sure).join(root("a"), "a", "left").join(root("b"), "b", "left").where(F.coalesce("ra", "a") != F.coalesce("rb", "b"))
        open_ = scratch.keep(open_.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"doubtful-{name}")
        if not open_.isEmpty():
            found = joined(found, alike(open_, name), scratch, f"found-{name}")
        for k in ("sure", "doubtful", "alike"):
            scratch.drop(f"{k}-{name}")
        return found

    def forget(level: int) -> None:
        """Delete a level's tables, which later ones no longer read."""
        scratch.drop(f"buckets-{level}")
        scratch.drop(f"many-{level}")
        for k in (f"{level}-a", f"{level}-b"):
            scratch.drop(f"open-{k}")
        for k in (f"{level}", f"{level}-a", f"{level}-b", f"{level}-c"):
            scratch.drop(f"links-{k}")
            scratch.drop(f"found-{k}-links")
            scratch.drop(f"found-{k}-sure-links")

    def opened(rows: DataFrame, name: str) -> DataFrame:
        """Rows of the buckets of several components, with their component, the bucket's largest and the number outside it."""
        named = rows.join(found.withColumnRenamed("root", "c"), "node", "left")
        named = scratch.keep(named.withColumn("c", F.coalesce("c", "node")), f"named-{name}")
        sizes = named.groupBy("bucket", "c").agg(F.count("*").alias("n"))
        rest = sizes.groupBy("bucket").agg(F.max(F.struct("n", "c")).alias("top"), F.sum("n").alias("all"))
        rest = rest.select("bucket", F.col("top.c").alias("top"), (F.col("all") - F.col("top.n")).alias("rest")).where("rest > 0")
        out = scratch.keep(named.select("node", "w", "bucket", "c", "f").join(scratch.keep(rest, f"rest-{name}"), "bucket"), f"open-{name}")
        scratch.drop(f"named-{name}")
        scratch.drop(f"rest-{name}")
        return out

    # a few blocks join most of each large group. Of the others only buckets of several components are opened then, so that a group of copies meets again
    # only where something else lies in its bucket
    some = max(8, n_blocks // 8)
    found, level = None, -1
    for low, high in ((0, some), (some, n_blocks)):
        if low >= n_blocks:
            break
        at, depth = blocks(low, min(high, n_blocks), found), 0
        while True:
            level += 1
            crowded = at.groupBy("bucket").agg(F.count("*").alias("n"), F.min("c").alias("least"), F.max("c").alias("most")).where("least <> most").select("bucket", "n")
            at = scratch.keep(at.join(scratch.keep(crowded, f"crowded-{level}"), "bucket"), f"buckets-{level}")
            forget(level - 1)
            scratch.drop(f"crowded-{level}")
            few = at.where(F.col("n") <= PAIRED)
            many = scratch.keep(at.where(F.col("n") > PAIRED).join(small, "node"), f"many-{level}")
            # the pivot of a larger bucket is its least node by a hash. The hash is the same in all buckets, so those of one
            # group of copies mostly share their pivots, and a member meets a few of them in all
            order = F.struct(F.xxhash64("node"), "node", "w", "c")
            pivots = scratch.keep(many.groupBy("bucket").agg(F.min(order).alias("p")).select("bucket", "p.node", "p.w", "p.c").join(small, "node"), f"pivots-{level}")
            apart = F.expr("x.c <> y.c")
            near = verified(met(few, few, F.expr("x.node < y.node") & apart)).unionByName(close(pivots, many, apart))
            found = settled(found, scratch.keep(near, f"links-{level}"), f"{level}")
            scratch.drop(f"pivots-{level}")
            if many.isEmpty():
                break
            # a larger bucket of one component is done; in others all outside the largest component are compared with the whole
            # bucket. Where these are many, they are first compared with some of that component
            open_ = opened(many.drop("c"), f"{level}-a")
            scratch.drop(f"buckets-{level}")
            scratch.drop(f"many-{level}")
            now, left, last = open_.where(F.col("rest") <= CROSSED), open_.where(F.col("rest") > CROSSED), SUB_BLOCKS * (depth + 1) > 8 * words
            if not left.isEmpty():
                order = F.struct(F.xxhash64("node", "bucket"), "node", "w")
                dealt = left.where("c = top").withColumn("d", F.pmod(F.xxhash64("node", "bucket", F.lit(7)), F.lit(PIVOTS)))
                pivots = scratch.keep(dealt.groupBy("bucket", "d").agg(F.min(order).alias("p")).select("bucket", "p.node", "p.w").join(small, "node"), f"pivots-{level}-a")
                again = scratch.keep(close(pivots, left.where("c <> top"), F.lit(True)), f"links-{level}-a")
                found = settled(found, again, f"{level}-a")
                scratch.drop(f"pivots-{level}-a")
                left = opened(left.select("node", "w", "bucket", "f"), f"{level}-b")
                fewer = F.lit(True) if last else F.col("rest") <= CROSSED  # last: no bits are left to split by
                now, left = now.unionByName(left.where(fewer)), left.where(~fewer)
            # sure links join components, whatever their number between two; doubtful pairs are looked for between what is still apart
            both = now.where("c <> top").alias("x").join(now.alias("y"), "bucket").where(apart & first_words & (gap("x.f", "y.f") <= sure))
            crossed = scratch.keep(both.select(F.col("x.c").alias("a"), F.col("y.c").alias("b")).distinct(), f"links-{level}-b")
            found = joined(found, crossed, scratch, f"found-{level}-b")
            # a bucket's components are few rows: their roots now show which are still apart
            parts = now.select("bucket", "c", "top").distinct()
            for c in ("c", "top"):
                parts = parts.join(found.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")), c, "left").withColumn(f"{c}_root", F.coalesce(f"{c}_root", c))
            parts = scratch.keep(parts.select("bucket", "c", "c_root", (F.col("c_root") != F.col("top_root")).alias("outside")), f"parts-{level}")
            still = parts.join(parts.where("outside").select("bucket").distinct(), "bucket", "left_semi")
            again = now.join(still, ["bucket", "c"]).drop("c").withColumnRenamed("c_root", "c")
            doubtful = scratch.keep(close(again.where("outside"), again, apart), f"links-{level}-c")
            scratch.drop(f"parts-{level}")
            found = settled(found, doubtful, f"{level}-c")
            if left.isEmpty():
                break
            # buckets of many components are split by each of SUB_BLOCKS further bytes: a close pair shares one of them
            left = left.select("node", "w", "c", "bucket").join(firsts.select("node", "fp"), "node")
            left = left.select("node", "w", "c", "bucket", "fp", F.explode(F.sequence(F.lit(0), F.lit(SUB_BLOCKS - 1))).alias("j"))
            at, depth = left.select("node", "w", "c", F.xxhash64("bucket", "j", F.expr(f"substring(fp, {SUB_BLOCKS * depth} + j + 1, 1)")).alias("bucket")), depth + 1
    forget(level)
    linked = firsts.select("node", "first").join(found, "node")
    roots = linked.groupBy("root").agg(F.min("first").alias("least"))
    moved = linked.join(roots, "root").select("node", F.col("least.row").alias("moved"))
    label = firsts.select("node", "digest", "first").join(moved, "node", "left").select("digest", F.coalesce("moved", "first.row").alias("component"))
    label = scratch.keep(label, "labels")
    return rows.select("id", "row", "digest").join(label, "digest").select("id", "row", "component")


def keep_first(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", **options) -> DataFrame:
    """df without near copies: of each group the row with the smallest id stays. All columns of df."""
    scratch = Scratch(df.sparkSession, "dedup")
    columns, tag = without(df, []), "row"
    while tag.lower() in {c.lower() for c in columns}:  # a name that df does not use
        tag += "_"
    marked = scratch.keep(df.withColumn(tag, F.monotonically_increasing_id()), "input")
    base = marked.select(F.struct(F.col(quoted(id_col)).isNull().alias("n"), F.col(quoted(id_col)).alias("i"), F.col(tag).alias("r")).alias("key"), F.col(quoted(text_col)).alias("text"))
    groups = near_duplicates(base, "text", "key", scratch=scratch, **options)
    stay = groups.where("row = component").select(F.col("id.r").alias(tag))
    return marked.join(stay, tag, "left_semi").select(*(F.col(quoted(c)) for c in columns))
