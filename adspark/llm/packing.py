"""Best-fit packing of token sequences, by hierarchical rounds.

Documents are tokenized and cut only where longer than a sequence: all pieces but
the first are full. Full pieces are sequences. The others are packed in rounds:
each partition packs its items best-fit, largest first; bins that are nearly full
are emitted, the rest become items of the next round, where a tree merges
``FAN_IN`` partitions into one. Items of a partition are bounded in number; the
last round is one partition, and holds only what no round could fill.
Where the underfull bins are too many for the merged partitions, the tree
narrows by less, or deals them anew over as many partitions.

A bin carries its pieces, at most as many as it has tokens. Bins merged by a
later round keep their pieces in order, so offsets are counted at the end.

The rounds stop early only when one that was dealt anew saves no more than a bin a
partition: then hardly any two of the bins fit together, as with lengths all over half a
sequence, and each partition has at most one bin that is half empty or more.

Nulls: a null text is the empty text and has the end id alone. Repeated rows are
packed as documents of their own, told apart by a row number. An empty table gives
no rows. Extra columns are left out.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from adspark.llm._common import byte_texts, parts_for, stored
from adspark.llm.tokens import Encoder

FAN_IN = 8
#: Items that a partition packs; a bin nearly full lacks this share of a sequence at most.
PART_ITEMS = 200_000
SLACK = 1 / 256


def cut(n: int, longest: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens; only the first may be shorter."""
    first = n % longest or min(n, longest)
    return [(0, first), *((s, longest) for s in range(first, n, longest))]


def token_pieces(docs: DataFrame, path: str, end_id: int, longest: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, ids (little-endian 32-bit), written once."""
    def encode(batches):
        encoder = Encoder(path, "byte")
        end = np.array([end_id], encoder.type).tobytes()
        for b in batches:
            names = b.column(b.schema.get_field_index("doc_id"))
            texts = byte_texts(b)
            for at in range(0, len(texts), 500):
                rows = []
                for name, raw in zip(names[at:at + 500].to_pylist(),
                                     encoder.encode(texts[at:at + 500])):
                    ids = np.frombuffer(raw + end, encoder.type)
                    for k, (s, n) in enumerate(cut(len(ids), longest)):
                        part = ids[s:s + n].astype("<u4").tobytes()
                        rows.append((name, k, s, n, zlib.crc32(part)))
                cols = list(zip(*rows))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(cols, kinds)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"])

    out = docs.select("doc_id", "text").mapInArrow(
        encode, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")
    return stored(out.withColumn("no", F.monotonically_increasing_id()), "pieces")


def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each item: largest first, each into the fullest bin that still takes it.

    Open bins are kept by free room; a bit per room with bins makes the smallest
    sufficient room one shift and one lowest-bit search.
    """
    order = np.argsort(-lengths, kind="stable")
    bins = np.empty(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    have, count = 0, 0
    for i, n in zip(order.tolist(), lengths[order].tolist()):
        fits = have >> n
        if fits:
            room = n + ((fits & -fits).bit_length() - 1)
            at = by_room[room].pop()
            if not by_room[room]:
                have ^= 1 << room
        else:
            room, at, count = capacity, count, count + 1
        left = room - n
        if left:
            if not by_room[left]:
                have |= 1 << left
            by_room[left].append(at)
        bins[i] = at
    return bins


def _packed_round(items: DataFrame, parts: int, capacity: int, level: int) -> DataFrame:
    """One round: (length, members, part) to bins of the same shape."""
    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        bins = best_fit(frame["length"].to_numpy(np.int64), capacity)
        order = np.argsort(bins, kind="stable")
        edges = np.flatnonzero(np.r_[True, np.diff(bins[order]) > 0])
        members = frame["members"].to_numpy()[order]
        total = np.add.reduceat(frame["length"].to_numpy(np.int64)[order], edges)
        ends = np.r_[edges[1:], len(order)]
        merged = [np.concatenate(list(members[s:e])) for s, e in zip(edges, ends)]
        part = frame["part"].iat[0]
        return pd.DataFrame({"length": total, "members": merged, "part": part})

    return stored(items.groupBy("part").applyInPandas(
        pack, "length bigint, members array<bigint>, part bigint"), f"bins-{level}")


def pack_lengths(items: DataFrame, capacity: int, part_items: int = PART_ITEMS,
                 slack: float = SLACK) -> DataFrame:
    """(no, length) to (no, sequence_id, at): the sequence and the place among its items.

    ``no`` is a distinct number; lengths are 1 to ``capacity``.
    """
    least = int(capacity * (1 - slack))
    full = items.filter(F.col("length") >= least).select(
        F.array("no").alias("members"))
    rest = items.filter(F.col("length") < least)
    parts = parts_for(rest.count(), part_items)
    part = F.pmod(F.xxhash64("no"), F.lit(parts)).cast("bigint")
    left = rest.select(F.col("length"), F.array("no").alias("members"), part.alias("part"))
    done, level, given, anew = [full], 0, None, False
    while True:
        bins = _packed_round(left, parts, capacity, level)
        if parts == 1:
            done.append(bins.select("members"))
            break
        done.append(bins.filter(F.col("length") >= least).select("members"))
        left = bins.filter(F.col("length") < least)
        n = left.count()
        if anew and given - n <= parts:
            done.append(left.select("members"))
            break
        fewer = max(-(-parts // FAN_IN), parts_for(n, part_items))
        anew = fewer >= parts
        # a merge of whole partitions, or, where they would be too large, another deal of the bins
        whole = fewer == -(-parts // FAN_IN)
        key = F.col("part") if whole else F.xxhash64(F.array_min("members"), F.lit(level))
        parts, given, level = min(fewer, parts), n, level + 1
        left = left.withColumn("part", F.pmod(key, F.lit(parts)).cast("bigint"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    out = out.withColumn("sequence_id", F.array_min("members"))
    return out.select("sequence_id", F.posexplode("members").alias("at", "no"))


def packed_pieces(docs: DataFrame, path: str, end_id: int, longest: int = 1024,
                  part_items: int = PART_ITEMS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of all pieces."""
    from pyspark.sql import Window

    pieces = token_pieces(docs, path, end_id, longest)
    places = pack_lengths(pieces.select("no", "length"), longest, part_items)
    rows = pieces.join(places, "no")
    before = Window.partitionBy("sequence_id").orderBy("at").rowsBetween(
        Window.unboundedPreceding, -1)
    return rows.select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id",
        F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"))
