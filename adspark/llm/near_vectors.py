"""Near duplicates among embeddings by quantised tile products with error bounds.

Vectors with the same label are compared, block by block. A vector of length 1 is
rounded to whole numbers q of -127..127 times a scale s; its rounding error, the
length e of what s * q leaves, is computed for that very vector. The product of
two rounded vectors, a whole number and so free of error, is then off from the
cosine by at most ``|s q| e' + e`` (Cauchy-Schwarz on u v = (sq + r) v' with
v' = s'q' + r'). Pairs whose product plus this bound stays below the threshold
are done; only the others of a tile are computed in full precision, from the vectors as given.

A tile hands on, for each vector, the number of its links, and links to the first
vector of its group within the tile: rows in proportion to its vectors, however
many pairs link. Vectors that are equal are one vector with a weight.
Blocks of a label meet in a ring, block i and the half of the others behind it, so
that a label with a third of all rows is spread over as many join keys as it has blocks.
The work is the square of a label's different vectors, the data moved are its
vectors once per block of the ring.

Nulls: rows with a null label, and vectors that are null, empty, zero or hold null or
non-finite components, link with nothing; vectors of different lengths do not link. Every
row of the table is a vector, also if it repeats a vec_id; a component is named
by its smallest vec_id, null only if all are, and a row is kept if it has that id. An empty table
gives no rows; other columns are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from adspark.llm._common import spread_lookup, stored
from adspark.llm.components import components
from adspark.sources.scratch import release

BLOCK_ROWS = 4096
STRIP = 512
LEVELS = 127
#: Dimensions whose products of whole numbers are summed exactly in 32-bit floats.
EXACT_DIMS = 2**24 // LEVELS**2
#: Covers the rounding of the bounds themselves.
SLACK = 1e-9


def unit(full: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; the largest component is divided out first, so no square overflows."""
    top = np.abs(full).max(axis=1, keepdims=True)
    scaled = full / top
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def quantised(units: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(q, s, e) of each row u: u = s q + r, and e is the length of r; |s q| is at most 1 + e."""
    scale = np.abs(units).max(axis=1) / LEVELS
    q = np.rint(units / scale[:, None]).astype(np.int8)
    rest = units - scale[:, None] * q
    return q, scale, np.sqrt((rest * rest).sum(axis=1))


def whole_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of 8-bit numbers."""
    out = None
    for at in range(0, a.shape[1], EXACT_DIMS):
        part = (a[:, at:at + EXACT_DIMS].astype(np.float32)
                @ b[:, at:at + EXACT_DIMS].astype(np.float32).T).astype(np.float64)
        out = part if out is None else out + part
    return out


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of ``a`` with each of ``b`` in double precision."""
    return unit(a) @ unit(b).T


def tile_links(a: dict, b: dict, threshold: float) -> np.ndarray:
    """Matrix of linked pairs; those the bound cannot rule out are computed in full."""
    linked = np.zeros((len(a["full"]), len(b["full"])), bool)
    for at in range(0, len(linked), STRIP):
        rows = slice(at, at + STRIP)
        rough = whole_products(a["q"][rows], b["q"])
        rough *= a["size"][rows, None]
        rough *= b["size"][None, :]
        bound = ((1 + a["error"][rows, None]) * b["error"][None, :]
                 + a["error"][rows, None] + SLACK)
        i, j = np.nonzero(rough + bound >= threshold)
        if not len(i):
            continue
        ri, at_i = np.unique(i, return_inverse=True)
        rj, at_j = np.unique(j, return_inverse=True)
        if len(i) * 8 > len(ri) * len(rj):  # many pairs: one product of all their rows
            near = cosines(a["full"][rows][ri], b["full"][rj])[at_i, at_j]
        else:
            left, right = unit(a["full"][rows][ri]), unit(b["full"][rj])
            near = np.empty(len(i))
            for k in range(0, len(i), 65536):
                part = slice(k, k + 65536)
                near[part] = np.einsum("ij,ij->i", left[at_i[part]], right[at_j[part]])
        hit = near >= threshold
        linked[at + i[hit], j[hit]] = True
    return linked


def tile_groups(linked: np.ndarray, same: bool) -> np.ndarray:
    """For each row, then each column, of a tile the first node of its group (-1: no link).

    Nodes are rows, then columns; in a tile of a block with itself row i is column i.
    """
    n, m = linked.shape
    root = np.full(n + m, -1)
    open_rows = linked.any(axis=1)
    for first in np.flatnonzero(open_rows):
        if root[first] >= 0:
            continue
        fresh, in_rows, in_cols = np.array([first]), np.zeros(n, bool), np.zeros(m, bool)
        in_rows[first] = True
        while len(fresh):
            cols = linked[fresh].any(axis=0) & ~in_cols
            in_cols |= cols
            reached = (cols if same else linked[:, cols].any(axis=1)) & ~in_rows
            in_rows |= reached
            fresh = np.flatnonzero(reached)
        root[:n][in_rows] = first
        root[n:][in_cols] = first
    return root


def weighted(linked: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Sum of the weights of each row's links, a strip at a time."""
    out = [linked[at:at + STRIP].astype(np.float64) @ weights.astype(np.float64)
           for at in range(0, len(linked), STRIP)]
    return np.concatenate(out).astype(np.int64)


def compared(a: dict, b: dict, same: bool, threshold: float) -> tuple:
    """(id, links, other) rows of a tile: link counts, then links that connect its groups."""
    linked = tile_links(a, b, threshold)
    if same:
        np.fill_diagonal(linked, True)
        counts = weighted(linked, b["weights"]) - a["weights"]
        root = tile_groups(linked, True)[:len(linked)]
        nodes, sums = a["ids"], counts
    else:
        root = tile_groups(linked, False)
        nodes = np.r_[a["ids"], b["ids"]]
        sums = np.r_[weighted(linked, b["weights"]), weighted(linked.T, a["weights"])]
    some = (sums > 0) & (root >= 0)
    return nodes[some], sums[some], nodes[root[some]]


def _blocks(rows: DataFrame) -> DataFrame:
    """One row per (label, dims, block) with its vectors, rounded vectors and bounds."""
    def stack(t: pa.Table) -> pa.Table:
        n = t.num_rows
        flat = t.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        full = np.ascontiguousarray(flat, np.float64).reshape(n, -1)
        q, scale, error = quantised(unit(full))
        return pa.table({
            "label": t.column("label")[:1], "dim": t.column("dim")[:1],
            "block": t.column("block")[:1], "blocks": t.column("blocks")[:1],
            "ids": pa.array([t.column("rep").to_pylist()], pa.list_(pa.int64())),
            "weights": pa.array([t.column("w").to_pylist()], pa.list_(pa.int64())),
            "full": pa.array([np.ascontiguousarray(flat).tobytes()], pa.binary()),
            "q": pa.array([q.tobytes()], pa.binary()),
            "size": pa.array([scale.tobytes()], pa.binary()),
            "error": pa.array([error.tobytes()], pa.binary())})

    label = dict(rows.dtypes)["label"]
    return rows.groupBy("label", "dim", "block").applyInArrow(
        stack, f"label {label}, dim int, block bigint, blocks bigint, ids array<bigint>, "
        "weights array<bigint>, full binary, q binary, size binary, error binary")


SIDE = ("ids", "weights", "full", "q", "size", "error")


def _side(batch: pa.RecordBatch, i: int, prefix: str, dtype: type) -> dict:
    cell = {x: batch.column(batch.schema.get_field_index(prefix + x))[i].as_py() for x in SIDE}
    n = len(cell["ids"])
    return {
        "ids": np.array(cell["ids"], np.int64), "weights": np.array(cell["weights"], np.int64),
        "full": np.frombuffer(cell["full"], dtype).astype(np.float64).reshape(n, -1),
        "q": np.frombuffer(cell["q"], np.int8).reshape(n, -1),
        "size": np.frombuffer(cell["size"]), "error": np.frombuffer(cell["error"])}


def near_links(vectors: DataFrame, threshold: float, block_rows: int) -> DataFrame:
    """(id, n, other) of (rep, w, label, dim, embedding) rows: links counted, and connected."""
    spark = vectors.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sizes = stored(vectors.groupBy("label", "dim").agg(F.count("*").alias("n"))
                   .filter("n > 1").select(
        F.struct("label", "dim").alias("of"), "n",
        F.ceil(F.col("n") / block_rows).alias("blocks")), "label-sizes")
    rows = spread_lookup(vectors.withColumn("of", F.struct("label", "dim")), sizes, "of", "n",
                         vectors.count(), parts, F.xxhash64("rep")).filter("blocks is not null")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks"))).drop("of")
    blocks = stored(_blocks(rows), "vector-blocks")
    release(sizes)
    # block i meets i, i + 1, ... i + blocks / 2 around the ring, each pair of blocks once
    half = F.floor(F.col("blocks") / 2)
    twice = (F.col("blocks") % 2 == 0) & (F.col("block") >= half)
    steps = F.when(twice, half - 1).otherwise(half)
    left = blocks.select(
        "label", "dim", "blocks", "block", *[F.col(x).alias("l_" + x) for x in SIDE],
        F.explode(F.sequence(F.lit(0).cast("bigint"), steps)).alias("step"))
    left = left.withColumns({"same": F.col("step") == 0, "block": F.pmod(
        F.col("block") + F.col("step"), F.col("blocks"))}).drop("blocks", "step")
    tiles = left.join(blocks.drop("blocks"), ["label", "dim", "block"])
    wide = np.float32 if dict(vectors.dtypes)["embedding"] == "array<float>" else np.float64

    def run(batches):
        for b in batches:
            same = b.column(b.schema.get_field_index("same"))
            for i in range(b.num_rows):
                found = compared(_side(b, i, "l_", wide), _side(b, i, "", wide),
                                 same[i].as_py(), threshold)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, pa.int64()) for x in found], names=["id", "n", "other"])

    links = stored(tiles.mapInArrow(run, "id bigint, n bigint, other bigint"), "tile-links", 4)
    release(blocks)
    return links


def near_vectors(embeddings: DataFrame, threshold: float = 0.98,
                 block_rows: int = BLOCK_ROWS) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is a cosine above 0, up to 1")
    parts = int(embeddings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = dict(embeddings.dtypes)["embedding"]
    if kind not in ("array<float>", "array<double>"):
        embeddings = embeddings.withColumn("embedding", F.col("embedding").cast("array<double>"))
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    usable = F.coalesce(F.col("label").isNotNull() & ~odd & some, F.lit(False))
    rows = stored(embeddings.select(
        "vec_id", "label", "embedding", F.monotonically_increasing_id().alias("row"),
        F.when(usable, F.struct(
            F.xxhash64("label", "embedding").alias("a"),
            F.xxhash64(F.lit(1), "label", "embedding").alias("b"))).alias("key")), "vectors")
    reps = stored(rows.filter("key is not null").groupBy("key").agg(
        F.min("row").alias("rep"), F.count("*").alias("w"), F.first("label").alias("label"),
        F.first("embedding").alias("embedding")).withColumn("dim", F.size("embedding")),
        "different-vectors")
    links = near_links(reps.select("rep", "w", "label", "dim", "embedding"), threshold, block_rows)
    counts = links.groupBy("id").agg(F.sum("n").alias("links"))
    roots = components(links.select(F.col("id").alias("a"), F.col("other").alias("b")))
    named = stored(
        reps.select("key", "rep", "w").join(counts, F.col("rep") == counts["id"], "left").drop("id")
        .join(roots, F.col("rep") == roots["id"], "left").select(
            "key", "w", F.coalesce("root", "rep").alias("root"),
            (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links")), "named-vectors")
    total = rows.count()
    placed = stored(spread_lookup(rows.select("vec_id", "row", "key"), named, "key", "w", total,
                                  parts, F.xxhash64("row")), "placed-vectors")
    least = stored(placed.filter("root is not null").groupBy("root").agg(
        F.min("vec_id").alias("least"), F.count("*").alias("w")).filter("w > 1"), "least-ids")
    out = spread_lookup(placed, least, "root", "w", total, parts, F.xxhash64("row"))
    for table in (links, roots, reps, named, rows):
        release(table)
    out = stored(out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"),
                            F.coalesce("least", "vec_id").alias("component_id")), "near-vectors")
    release(placed)
    release(least)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
