"""Exact top-k search by inner product: tiles of queries and shards.

The vectors, made integers, are stored once with a number for each row. Shards
of rows and blocks of queries are matrices of bounded size. The shards are dealt over
tasks, and each task reads the blocks, one after another, from the table they are
written to: a copy neither per shard nor in the driver. Each (block, shard) is a tile: one
matrix product, of which the scores below a query's k best so far in the task are left out. The
lists of a query, one from each task, are then merged up a tree with a fixed fan-in,
so no task sees more than ``FAN_IN * k`` entries of a query at once.

The query set is stated by the caller and goes against all rows, in blocks. A task holds k
entries for each query.

Vectors that are null or hold null or non-finite components take no part. Vectors
are compared with those of their own dimension only. Rows that repeat a vec_id
are rows of their own: a query leaves out its own row only, and ties among equal
ids are arbitrary. Scores outside 64 bits are held at the ends of that range. An
empty table gives no rows; extra columns are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from adspark.llm._common import parts_for, stored
from adspark.llm.files import as_uri, written_batches
from adspark.sources.scratch import release

SHARD_ROWS = 4096
BLOCK_QUERIES = 1024
FAN_IN = 8
#: Shards of a task, on average, where there are more than tasks.
SHARDS_A_TASK = 16
#: Whole numbers below these are exact in doubles and floats.
EXACT, EXACT_FLOAT = 2.0**53, 2.0**24
LOW = -2**63


def integer_vectors(embeddings: DataFrame, scale: float = 256.0) -> DataFrame:
    """vec_id, dim, v (array of double holding integers)."""
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("double"))
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | x.isin(
        float("inf"), float("-inf")))
    return (embeddings.filter(F.col("embedding").isNotNull())
            .filter(~F.coalesce(odd, F.lit(True)))
            .select("vec_id", F.size("embedding").alias("dim"), whole.alias("v")))


def _matrices(rows: DataFrame, group: str) -> DataFrame:
    """One row per (dim, group): ids, row numbers, matrix as bytes."""
    def stack(table: pa.Table) -> pa.Table:
        dim = table.column("dim")[0].as_py()
        flat = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return pa.table({
            "dim": pa.array([dim], pa.int32()),
            group: pa.array([table.column(group)[0].as_py()], pa.int64()),
            "ids": pa.array([table.column("vec_id").to_pylist()], pa.list_(pa.int64())),
            "nos": pa.array([table.column("no").to_pylist()], pa.list_(pa.int64())),
            "m": pa.array([np.ascontiguousarray(flat, np.float64).tobytes()], pa.binary())})

    return rows.groupBy("dim", group).applyInArrow(
        stack, f"dim int, {group} bigint, ids array<bigint>, nos array<bigint>, m binary")


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows of two matrices of whole doubles, as floats, doubles
    or, where these are not exact, integers."""
    top = (np.abs(a).max(initial=0) * np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if top < EXACT_FLOAT:
        return a.astype(np.float32) @ b.astype(np.float32).T
    if top < EXACT:
        return a @ b.T
    whole = [[[int(x) for x in r] for r in m] for m in (a, b)]
    lim = 2**63 - 1
    return np.array([[max(-lim - 1, min(lim, sum(x * y for x, y in zip(p, q))))
                      for q in whole[1]] for p in whole[0]], np.int64).reshape(len(a), len(b))


def tile_hits(a: np.ndarray, a_no: np.ndarray, b: np.ndarray, b_no: np.ndarray, k: int,
              edge: np.ndarray) -> tuple:
    """(query index, candidate index, score) of the tile that reach ``edge``, each query's least
    score of interest: among them its best k, with all ties at the k-th score."""
    s = products(a, b)
    _, qi, ci = np.intersect1d(a_no, b_no, assume_unique=True, return_indices=True)
    whole = s.dtype == np.int64
    if not whole:  # all scores lie between the limits
        lim = int(EXACT_FLOAT if s.dtype == np.float32 else EXACT)
        edge = np.clip(edge, -lim, lim).astype(s.dtype)
    hit = s >= edge[:, None]
    hit[qi, ci] = False  # a query's own row
    if s.shape[1] > k and np.count_nonzero(hit) > 4 * k * len(a):
        s[qi, ci] = LOW if whole else -np.inf
        hit &= s >= np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k, None]
    qi, ci = np.nonzero(hit)
    return qi, ci, s[qi, ci].astype(np.int64)


class Best:
    """The best k so far of each query of a block: by score, then by id, null first."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.qi, self.ids, self.score = (np.empty(0, np.int64) for _ in range(3))
        self.null = np.empty(0, bool)
        self.edge = np.full(n, LOW, np.int64)

    def add(self, qi: np.ndarray, ids: np.ndarray, null: np.ndarray, score: np.ndarray) -> None:
        if not len(qi):
            return
        new = [np.r_[x, y] for x, y in zip(
            (self.qi, self.ids, self.null, self.score), (qi, ids, null, score))]
        order = np.lexsort((new[1], ~new[3], new[0]))  # ~ turns the order without overflow
        qi = new[0][order]
        start = np.flatnonzero(np.r_[True, qi[1:] != qi[:-1]])
        rank = np.arange(len(qi)) - np.repeat(start, np.diff(np.r_[start, len(qi)]))
        order = order[rank < self.k]
        self.qi, self.ids, self.null, self.score = (x[order] for x in new)
        last = rank[rank < self.k] == self.k - 1
        self.edge[self.qi[last]] = self.score[last]


def _best(lists: Column, k: int) -> Column:
    return F.slice(F.array_sort(lists, _before), 1, k)


def _before(x: Column, y: Column) -> Column:
    return (F.when(x["score"] > y["score"], -1).when(x["score"] < y["score"], 1)
            .when(x["vec_id"] < y["vec_id"], -1).when(x["vec_id"] > y["vec_id"], 1)
            .otherwise(0))


def top_k(embeddings: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0,
          shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score of the k best rows for each query row."""
    rows = stored(integer_vectors(embeddings, scale)
                  .withColumn("no", F.monotonically_increasing_id()), "vectors")
    n, nq = rows.count(), rows.filter(is_query).count()
    shards, blocks = parts_for(n, shard_rows), parts_for(nq, block_queries)
    place = F.pmod(F.xxhash64("no"), F.lit(shards)).cast("bigint")
    sharded = stored(_matrices(rows.withColumn("shard", place), "shard"), "shards")
    block = F.pmod(F.xxhash64("no"), F.lit(blocks)).cast("bigint")
    blocked = stored(_matrices(rows.filter(is_query).withColumn("block", block), "block"),
                     "query-blocks")
    release(rows)
    folder = as_uri(blocked.__dict__["_scratch_path"])
    parts = int(embeddings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = min(shards, max(parts, parts_for(shards, SHARDS_A_TASK)))

    def matrices(batch):
        """dim, ids, row numbers and matrix of each row of a batch of ``_matrices``."""
        dim, ids, nos, m = (batch.column(batch.schema.get_field_index(x))
                            for x in ("dim", "ids", "nos", "m"))
        for i in range(batch.num_rows):
            no = nos[i].values.to_numpy()
            yield dim[i].as_py(), ids[i].values, no, np.frombuffer(
                m[i].as_py()).reshape(len(no), dim[i].as_py())

    def query_blocks():
        for batch in written_batches(folder, 1):
            yield from matrices(batch)

    def search(batches):
        best, names = {}, {}
        for b in batches:
            for dim, ids, no, right in matrices(b):
                null, ids = (ids.is_null().to_numpy(zero_copy_only=False),
                             ids.fill_null(LOW).to_numpy())
                for q_dim, q_ids, q_no, left in query_blocks():
                    if q_dim != dim:
                        continue
                    key = dim, int(q_no[0])
                    if key not in best:
                        best[key], names[key] = Best(len(q_no), k), (q_no, q_ids)
                    qi, ci, score = tile_hits(left, q_no, right, no, k, best[key].edge)
                    best[key].add(qi, ids[ci], null[ci], score)
        node = TaskContext.get().partitionId()
        for key, top in best.items():
            q_no, q_ids = names[key]
            yield pa.RecordBatch.from_arrays(
                [pa.array(q_no[top.qi]), q_ids.take(pa.array(top.qi)),
                 pa.array(np.full(len(top.qi), node, np.int64)),
                 pa.array(top.ids, mask=top.null), pa.array(top.score)],
                names=["no", "query_id", "node", "vec_id", "score"])

    found = stored(sharded.repartition(tasks).mapInArrow(
        search, "no bigint, query_id bigint, node bigint, vec_id bigint, score bigint"),
        "tops", rows_per_batch=1)
    release(sharded)
    release(blocked)
    width, lists = tasks, None
    entry = F.struct("score", "vec_id")
    lists = found.groupBy("no", "query_id", "node").agg(F.collect_list(entry).alias("top"))
    while True:
        width = -(-width // FAN_IN)
        lists = lists.groupBy("no", "query_id", F.floor(F.col("node") / FAN_IN).alias("node")).agg(
            _best(F.flatten(F.collect_list("top")), k).alias("top"))
        if width == 1:
            break
    return lists.select("query_id", F.posexplode("top").alias("at", "hit")).select(
        "query_id", (F.col("at") + 1).alias("rank"), "hit.vec_id", "hit.score")
