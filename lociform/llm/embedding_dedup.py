"""Near-duplicate vectors by int8 tile products with proven error bounds.

Vectors of one label and dimension are dealt to tiles of bounded size. A vector x of length 1 is stored as
``s * q`` with ``q`` in int8, and ``e = |x - s q|`` is kept with it, so that for any two

    |x.y - sx sy qx.qy|  <=  ex + (1 + ex) ey

(x.y = sx sy qx.qy + (x - sx qx).y + sx qx.(y - sy qy), and |sx qx| <= 1 + ex). The product of two tiles is one
matrix product of small whole numbers, exact in float32. Pairs whose upper bound stays below the
threshold are settled, as are those whose lower bound reaches it; all others are computed in double precision.

A tile pair returns no pairs, only a row for each vector that has a link there: how many, and the
least vector that the links of this tile pair reach. So the rows that leave a product grow with the tiles, not with the square of a
group of near copies. Equal vectors are one vector with a count before all that.

Tiles hold vectors near one of up to ``max_pivots`` pivots, and the angle between two pivots, less the largest
angles of their vectors, rules out pairs of cells (by the triangle inequality). What that leaves is still quadratic in a label's vectors
where these lie apart in all directions: the work of the method, dealt to as many tasks as there are tile pairs.

Defined results: a vector that is null, empty, zero, or holds null or non-finite components, and one with a null label, links
with nothing and is its own component; vectors of different dimension are not compared; equal vectors of a label
link. Repeated rows stay rows, each a link of the other. A null id takes part; a component of null ids alone has a null id, and a row with a null id is not
kept. An empty table gives an empty one. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.components import components
from ..shipping import map_arrow
from .common import Scratch, append_columns, quoted

#: Room for rounding in float32 products of the bounds, and in double precision.
SLACK = 1e-5
#: float32 holds sums of so many products of two int8 numbers exactly: 127 * 127 * 1024 < 2 ** 24.
EXACT_COLUMNS = 1024
#: Rows of one block of a tile product.
BLOCK = 512


def unit(values: np.ndarray) -> np.ndarray | None:
    """values at length 1 in double precision; None for those without a direction."""
    x = np.asarray(values, np.float64)
    top = np.abs(x).max(initial=0.0)
    if not np.isfinite(top) or top == 0 or np.isnan(x).any():
        return None
    x = x / top
    return x / np.sqrt(x @ x)


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, their scales, and upper bounds of the length of what is lost, of the rows of x (length 1 each)."""
    scale = np.abs(x).max(axis=1) / 127
    q = np.rint(x / scale[:, None]).astype(np.int8)
    lost = x - scale[:, None] * q
    return q, scale, np.sqrt((lost * lost).sum(axis=1)) + 1e-12


def whole_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of int8 matrices, exact."""
    if a.shape[1] <= EXACT_COLUMNS:
        return a.astype(np.float32) @ b.astype(np.float32).T
    out = np.zeros((len(a), len(b)))
    for i in range(0, a.shape[1], EXACT_COLUMNS):
        out += a[:, i : i + EXACT_COLUMNS].astype(np.float32) @ b[:, i : i + EXACT_COLUMNS].astype(np.float32).T
    return out


def tile_links(a: dict, b: dict, same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Places (i, j) of the linked pairs of two tiles (i < j if they are the same), and how many were computed in double precision."""
    left, right, checked = [], [], 0
    for at in range(0, len(a["q"]), BLOCK):
        rows = slice(at, at + BLOCK)
        near = whole_products(a["q"][rows], b["q"]) * (a["scale"][rows, None] * b["scale"][None, :]).astype(np.float32)
        bound = (a["err"][rows, None] + (1 + a["err"][rows, None]) * b["err"][None, :] + SLACK).astype(np.float32)
        i, j = np.nonzero(near + bound >= threshold)
        if same:
            i, j = i[i + at < j], j[i + at < j]
        sure = near[i, j] - bound[i, j] >= threshold
        open_i, open_j = i[~sure] + at, j[~sure]
        checked += len(open_i)
        kept = np.concatenate([np.zeros(0, bool), *((a["unit"][open_i[k : k + 65536]] * b["unit"][open_j[k : k + 65536]]).sum(axis=1) >= threshold for k in range(0, len(open_i), 65536))])
        left.append(np.concatenate([i[sure] + at, open_i[kept]]))
        right.append(np.concatenate([j[sure], open_j[kept]]))
    return np.concatenate([*left, np.zeros(0, np.int64)]), np.concatenate([*right, np.zeros(0, np.int64)]), checked


def least_reached(nodes: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of nodes the least one that the links (places i, j) reach."""
    least = nodes.copy()
    while True:
        before = least.copy()
        low = np.minimum(least[i], least[j])
        np.minimum.at(least, i, low)
        np.minimum.at(least, j, low)
        if (least == before).all():
            return least


def _matrix(column: pa.Array, dtype: str, dim: int) -> np.ndarray:
    """Rows of binary values of equal length, as a matrix."""
    column = column if pa.types.is_large_binary(column.type) else column.cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(dtype).reshape(len(column), dim)


def _tile(members: pa.StructArray, dim: int, kind: str) -> dict:
    get = lambda name: members.field(name)
    raw = _matrix(get("raw"), kind, dim).astype(np.float64)
    raw = raw / np.abs(raw).max(axis=1)[:, None]
    made = {"node": get("node").to_numpy(), "n": get("n").to_numpy(), "scale": get("scale").to_numpy(), "err": get("err").to_numpy(), "q": _matrix(get("q"), "i1", dim)}
    return made | {"unit": raw / np.sqrt((raw * raw).sum(axis=1))[:, None]}


def similar_vectors(
    df: DataFrame, vec_col: str = "embedding", id_col: str = "vec_id", label_col: str = "label", threshold: float = 0.93,
    tile_rows: int = 2048, max_pivots: int = 256, scratch: Scratch | None = None,
) -> DataFrame:
    """(id, label, n_links, component_id, kept) for every row of df: vectors of equal label with a cosine of ``threshold`` or more are linked.

    ``tile_rows``: vectors of a tile at 64 components or fewer; larger ones get fewer, at least 64.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    scratch = scratch or Scratch(df.sparkSession, "vectors")
    kind = "<f4" if df.schema[vec_col].dataType.elementType == T.FloatType() else "<f8"

    def raw_kernel(vectors: pa.Array, labels: pa.Array) -> list[pa.Array]:
        out = []
        for v, label in zip(vectors, labels, strict=True):
            held = label.is_valid and v.is_valid and not v.values.null_count
            values = v.values.to_numpy(zero_copy_only=False) if held else np.zeros(0)
            # -0.0 and 0.0 are one component
            out.append((values + 0).astype(kind).tobytes() if held and unit(values) is not None else None)
        return [pa.array(out, pa.binary())]

    base = df.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(label_col)).alias("label"), F.col(quoted(vec_col)).alias("vector"))
    base = append_columns(base, [F.col("vector"), F.col("label")], [T.StructField("raw", T.BinaryType())], raw_kernel, keep=["id", "label"])
    rows = scratch.keep(base.withColumn("digest", F.sha2("raw", 256)), "rows")
    firsts = rows.where("raw is not null").groupBy("label", "digest").agg(F.first("raw").alias("raw"), F.min("id").alias("first"), F.count("*").alias("n"))
    firsts = scratch.keep(firsts.withColumn("node", F.monotonically_increasing_id()), "vectors")

    tile_size = F.greatest(F.lit(64), F.least(F.lit(tile_rows), F.floor(F.lit(64 * tile_rows) / F.col("dim")).cast("int")))
    most = firsts.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    wanted = min(max_pivots, -(-most // tile_rows))
    chosen = firsts.orderBy(F.xxhash64("node"), "node").limit(wanted).select("raw").collect() if wanted > 1 else []
    pivots = [unit(np.frombuffer(r["raw"], kind)) for r in chosen]
    by_dim = {d: ([k for k, p in enumerate(pivots) if len(p) == d], np.stack([p for p in pivots if len(p) == d])) for d in {len(p) for p in pivots}}

    def quantise_kernel(raws: pa.Array) -> list[pa.Array]:
        dims, cells, angles, qs, scales, errs = [], [], [], [], [], []
        for r in raws.to_pylist():
            x = unit(np.frombuffer(r, kind))
            q, s, e = quantise(x[None, :])
            places, ps = by_dim.get(len(x), ([-1], None))
            near = ps @ x if ps is not None else np.array([-1.0])
            k = int(near.argmax())
            dims.append(len(x)), cells.append(places[k]), angles.append(float(np.arccos(np.clip(near[k], -1, 1))))
            qs.append(q.tobytes()), scales.append(s[0]), errs.append(e[0])
        return [pa.array(dims, pa.int32()), pa.array(cells, pa.int32()), pa.array(angles, pa.float64()), pa.array(qs, pa.binary()), pa.array(scales, pa.float64()), pa.array(errs, pa.float64())]

    fields = [T.StructField(n, t()) for n, t in (("dim", T.IntegerType), ("cell", T.IntegerType), ("angle", T.DoubleType), ("q", T.BinaryType), ("scale", T.DoubleType), ("err", T.DoubleType))]
    coded = scratch.keep(append_columns(firsts, [F.col("raw")], fields, quantise_kernel, keep=["label", "node", "n", "raw"]), "coded")
    group = ["label", "dim", "cell"]
    cells = coded.groupBy(*group).agg(F.count("*").alias("rows"), F.max("angle").alias("radius"))
    cells = scratch.keep(cells.withColumn("tiles", F.ceil(F.col("rows") / tile_size).cast("int")), "cells")
    placed = coded.join(cells.select(*group, "tiles"), group).withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    members = F.collect_list(F.struct("node", "n", "q", "scale", "err", "raw")).alias("members")
    tiles = scratch.keep(placed.groupBy(*group, "tile").agg(members), "tiles")

    reach = float(np.arccos(threshold)) + 1e-6
    cosines = {(k, m): float(np.arccos(np.clip(pivots[k] @ pivots[m], -1, 1))) for ks, _ in by_dim.values() for k in ks for m in ks}

    def may_meet(batches):
        for b in batches:
            ca, cb, ra, rb = (b.column(n).to_pylist() for n in ("ca", "cb", "ra", "rb"))
            yield b.filter(pa.array([cosines.get((k, m), 0.0) - x - y <= reach for k, m, x, y in zip(ca, cb, ra, rb, strict=True)], pa.bool_()))

    one = lambda side: cells.select("label", "dim", F.col("cell").alias(f"c{side}"), F.col("radius").alias(f"r{side}"), F.col("tiles").alias(f"n{side}"))
    meeting = one("a").join(one("b"), ["label", "dim"]).where("ca <= cb")
    meeting = map_arrow(meeting, may_meet, meeting.schema)
    pairs = meeting.withColumn("ta", F.explode(F.sequence(F.lit(0), F.col("na") - 1))).withColumn("tb", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    pairs = pairs.where("ca < cb or ta <= tb").select("label", "dim", "ca", "ta", "cb", "tb")
    side = lambda s: tiles.select("label", "dim", F.col("cell").alias(f"c{s}"), F.col("tile").alias(f"t{s}"), F.col("members").alias(f"m{s}"))
    both = pairs.join(side("a"), ["label", "dim", "ca", "ta"]).join(side("b"), ["label", "dim", "cb", "tb"])

    def products(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                get = lambda name: batch.column(name)[k]  # noqa: B023, E731
                dim, same = get("dim").as_py(), (get("ca").as_py(), get("ta").as_py()) == (get("cb").as_py(), get("tb").as_py())
                a = _tile(get("ma").values, dim, kind)
                b = a if same else _tile(get("mb").values, dim, kind)
                i, j, _ = tile_links(a, b, same, threshold)
                if not len(i):
                    continue
                shift = 0 if same else len(a["node"])
                nodes, counts = (a["node"], a["n"]) if same else (np.concatenate([a["node"], b["node"]]), np.concatenate([a["n"], b["n"]]))
                j = j + shift
                links = np.zeros(len(nodes), np.int64)
                np.add.at(links, i, counts[j])
                np.add.at(links, j, counts[i])
                found, held = least_reached(nodes, i, j), links > 0
                yield pa.RecordBatch.from_arrays([pa.array(nodes[held]), pa.array(links[held]), pa.array(found[held])], names=["node", "links", "root"])

    linked = scratch.keep(map_arrow(both.select("dim", "ca", "ta", "cb", "tb", "ma", "mb"), products, "node long, links long, root long"), "links")
    totals = linked.groupBy("node").agg(F.sum("links").alias("links"))
    found = scratch.keep(components(linked.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")), scratch), "components")
    named = firsts.select("label", "digest", "node", "first", "n").join(found, "node", "left").join(totals, "node", "left")
    named = scratch.keep(named.select("label", "digest", "first", F.coalesce("root", "node").alias("root"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "named")
    roots = named.groupBy("root").agg(F.min("first").alias("least"))
    final = scratch.keep(named.join(roots, "root").select("label", "digest", "n_links", "least"), "final")
    out = rows.select("id", "label", "digest").join(final, ["label", "digest"], "left")
    out = out.select("id", "label", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("least")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)))
