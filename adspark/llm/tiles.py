"""Comparing the queries of a group with its members, block by block."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from adspark.llm._common import spread_lookup, stored
from adspark.sources.scratch import release

TILES_PER_SALT = 8


def _blocks(pairs: DataFrame, bodies: DataFrame, side: str, block_size: int) -> DataFrame:
    """(gid, block, blocks, ids, bodies): rows of a group in blocks of bounded size, written."""
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = sizes = stored(pairs.join(bodies.select("doc", "n"), "doc"), f"{side}-sizes")
    sums = stored(rows.groupBy("gid").agg(
        F.ceil(F.sum("n") / block_size).alias("blocks"), F.count("*").alias("w")), side)
    rows = spread_lookup(rows, sums, "gid", "w", rows.count(), parts, F.xxhash64("doc"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks"))).drop("n")
    full = rows.join(bodies.select("doc", "body"), "doc")

    def pack(t: pa.Table) -> pa.Table:
        return pa.table({
            "gid": t.column("gid")[:1], "block": t.column("block")[:1],
            "blocks": t.column("blocks")[:1],
            "ids": pa.array([t.column("doc").to_pylist()], pa.list_(pa.int64())),
            "bodies": pa.array([t.column("body").to_pylist()], pa.list_(pa.binary()))})

    out = stored(full.groupBy("gid", "block").applyInArrow(
        pack, "gid bigint, block bigint, blocks bigint, ids array<bigint>, bodies array<binary>"),
        f"{side}-blocks")
    release(sizes)
    release(sums)
    return out


def tiles(queries: DataFrame, members: DataFrame, bodies: DataFrame, block_size: int,
          member_size: int = 0) -> tuple[DataFrame, list[DataFrame]]:
    """(gid, ids, bodies, m_ids, m_bodies) of every tile, and the tables to release when
    they are read.

    ``queries`` and ``members`` are (gid, doc), ``bodies`` a stored table (doc, n, body), n the
    size of a body. A tile is a block of a group's queries with a block of its members; tiles of a
    heavy group are spread by a salt. Blocks of members may have a size of their own,
    ``member_size``; queries that are the members are written once.
    """
    asked = _blocks(queries, bodies, "queries", block_size)
    salts = F.ceil(F.col("blocks") / TILES_PER_SALT)
    q = asked.withColumn("salt", F.pmod("block", salts))
    per = q.groupBy("gid").agg(F.ceil(F.max("blocks") / TILES_PER_SALT).alias("salts"))
    held = asked if members is queries and not member_size else _blocks(
        members, bodies, "members", member_size or block_size)
    m = held.join(per, "gid").select("gid", F.col("ids").alias("m_ids"), F.col("bodies").alias("m_bodies"),
                 F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1)).alias("salt"))
    out = q.select("gid", "salt", "ids", "bodies").join(m, ["gid", "salt"])
    return out.select("gid", "ids", "bodies", "m_ids", "m_bodies"), [asked, held]


def tiled_links(queries: DataFrame, members: DataFrame, bodies: DataFrame, block_size: int,
                compare: Callable[[list[bytes], list[bytes]], tuple]) -> DataFrame:
    """Links (doc, member), written, between (gid, doc) queries and members of the same gid.

    ``compare`` gets two lists of bodies and returns the indexes of linked ones;
    it need not return all links, but enough to keep what they connect.
    """
    def run(batches):
        for b in batches:
            col = {x: b.column(b.schema.get_field_index(x))
                   for x in ("ids", "bodies", "m_ids", "m_bodies")}
            for i in range(b.num_rows):
                ids, m_ids = (np.array(col[x][i].as_py(), np.int64) for x in ("ids", "m_ids"))
                qi, mi = compare(col["bodies"][i].as_py(), col["m_bodies"][i].as_py())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[qi]), pa.array(m_ids[mi])], names=["doc", "member"])

    pairs, read = tiles(queries, members, bodies, block_size)
    links = stored(pairs.mapInArrow(run, "doc bigint, member bigint"), "links")
    for table in read:
        release(table)
    return links
