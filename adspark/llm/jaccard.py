"""N-gram Jaccard join with a token-group matrix.

A document is the set of its distinct word shingles. The matrix holds, for every
token, the group of documents that have it. The rows are not single shingles,
which are as frequent as the passages they come from, but coarse tokens: a hash
divides the shingles into parts, and a part with all its shingles is one token.
Two sets of J >= t in a size class differ in at most D shingles; with D + 1 + g
parts they agree in g + 1 parts or more. So a document needs g + 1 coarse tokens
in common with others (the bound), and it may leave out its g most
frequent ones and still meet every partner. Parts without shingles do not count:
a document with more than g of them is also divided by further hashes, and only
after the last one do its empty parts count.

Groups of up to ``FEW`` documents are compared pair by pair, where a
query's overlap with the union of a block's shingles bounds that with each member: at most
``FEW`` comparisons for each document and group. A larger one is compared with its leader O, the smallest document, which
gives links and, for each member A, its difference a = A xor O. Members linked to O are
connected. For any other linked pair A, B, one of them not linked to O, the differences
overlap: |a & b| = (|a| + |b| - |A xor B|) / 2, where |A xor B| <= r (|A| + |B|) with
r = (1 - t) / (1 + t), and |b| > r (|B| + |O|) if B is the one not linked, so that
2 |a & b| > |a| + r (|O| - |A|). Thus at least about half of a difference is shared, and near
copies that each differ from O in their own way never meet. The first shingles of the
differences, in an order that all members of O share (rare ones first, as counted in a few
members), are the tokens of the next round's matrix: as many as the bound leaves over.
Leaders only grow from round to round, so the groups run out. What is
left when that is little or after ``ROUNDS`` rounds is compared within the group.

Skew: equal sets are one document; sets travel only for documents that share
enough coarse tokens; groups are cut into blocks of bounded size,
and a heavy group's blocks are spread by a salt. A group costs its members once for
each round; only groups left after the last round cost their square.

Nulls: a null text has no words and no links, as an empty one. A row with a null
doc_id has no links and a null component. Rows that repeat a doc_id count as one
document with each of their texts. Empty tables give no rows; extra columns are left out.
"""

from __future__ import annotations

import bisect
import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from adspark.llm._common import (
    WordHashes, byte_texts, known_keys, mixed, shingles, spread_lookup, stored, words,
)
from adspark.llm.components import components
from adspark.llm.files import as_uri, written_batches
from adspark.llm.tiles import tiled_links, tiles
from adspark.sources.scratch import release

GROWTH = 1.4
SCHEMES = 4
#: Shingles of a block of queries or members.
BLOCK_SHINGLES = 50_000
#: Rounds of comparing groups with their leaders.
ROUNDS = 6
#: Documents of a group up to which all are compared with all; fewer rows than tokens of their differences.
FEW = 1000
#: Pairs for each document of a larger group, on average, up to which the rest is compared with all.
PAIRS = 1000
#: Rows of tokens from which documents that are connected already are looked up between rounds.
CONNECTED = 2000
#: About so many members of a larger group give the order of its differences.
SAMPLED = 16
#: Coarse tokens of a part in which repeated ones are found.
PART_TOKENS = 4_000_000
#: Coarse tokens that a task sends to the parts at once.
SENT_TOKENS = 2_000_000
#: Bits of a part's filter for each repeated token, at least, and places looked up in it.
FILTER_BITS, PROBES = 16, 3
LOW_BITS = np.uint64((1 << 40) - 1)


class Parts:
    """Size classes and the coarse tokens of a set, for J >= num / den."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.bounds = [1]
        while self.bounds[-1] < 2**31:
            b = self.bounds[-1]
            self.bounds.append(max(b + 1, int(b * GROWTH)))
        if any((above - 1) * den // num >= second
               for above, second in zip(self.bounds[1:], self.bounds[2:])):
            raise ValueError("a threshold this low has partners beyond the next size class")

    def differ(self, c: int) -> int:
        """Most shingles in which a pair differs whose larger set is in class ``c``."""
        return 2 * (self.bounds[c + 1] - 1) * (self.den - self.num) // (self.den + self.num)

    def classes(self, n: int) -> list[int]:
        """Own class, and the next if a partner can be in it."""
        c = bisect.bisect_right(self.bounds, n) - 1
        return [c, c + 1] if n * self.den // self.num >= self.bounds[c + 1] else [c]

    def coarse(self, tokens: np.ndarray, c: int) -> tuple[int, np.ndarray]:
        """(number that a partner shares at least, coarse tokens) in class ``c``.

        None where the class allows no difference: equal sets are one already.
        """
        d = self.differ(c)
        if d == 0:
            return 1, np.empty(0, np.uint64)
        spare = -(-(d + 1) // 4)
        p = d + 1 + spare
        out = []
        for scheme in range(SCHEMES):
            place = (mixed(tokens, 101 + scheme) % np.uint64(p)).astype(np.int64)
            total = np.zeros(p, np.uint64)
            np.add.at(total, place, mixed(tokens, 7 + scheme))
            full = np.bincount(place, minlength=p) > 0
            name = np.arange(p, dtype=np.uint64) + np.uint64((c * SCHEMES + scheme) << 32)
            sig = mixed(total ^ mixed(name, 3), 5)
            empty = p - int(full.sum())
            out.append(sig[full])
            if empty <= spare:
                return (spare + 1 - empty if scheme == 0 else 1), np.concatenate(out)
        out.append(sig[~full])
        return 1, np.concatenate(out)


SKETCH = ("doc_id bigint, n bigint, k1 bigint, k2 bigint, "
          "own array<bigint>, own_least int, up array<bigint>, up_least int")


def sketched(docs: DataFrame, n_words: int, num: int, den: int) -> DataFrame:
    """Set sizes, two hashes of the whole set, coarse tokens; written once."""
    def sketch(batches):
        hashes, parts = WordHashes(), Parts(num, den)
        for b in batches:
            names = b.column(b.schema.get_field_index("doc_id")).to_pylist()
            texts = byte_texts(b)
            for at in range(0, len(texts), 1000):
                rows = []
                for name, t in zip(names[at:at + 1000], texts[at:at + 1000]):
                    s = shingles(hashes.of(words(t)), n_words)
                    keys = [int(mixed(s, k).sum(dtype=np.uint64).view(np.int64)) for k in (1, 2)]
                    got = [(1, np.empty(0, np.uint64))] * 2
                    if len(s):
                        for i, c in enumerate(parts.classes(len(s))):
                            got[i] = parts.coarse(s, c)
                    (a, x), (e, y) = got
                    rows.append((name, len(s), *keys, x.view(np.int64), a, y.view(np.int64), e))
                cols = list(zip(*rows))
                kinds = [pa.int64()] * 4 + [pa.list_(pa.int64()), pa.int32()] * 2
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(cols, kinds)],
                    names=["doc_id", "n", "k1", "k2", "own", "own_least", "up", "up_least"])

    return stored(docs.select("doc_id", "text").mapInArrow(sketch, SKETCH), "sketches")


def slots_of(sigs: np.ndarray, bits: int) -> np.ndarray:
    """The highest ``bits`` of coarse tokens, their part, and the lowest 40 bits."""
    low = sigs & LOW_BITS
    return low if not bits else (sigs >> np.uint64(64 - bits) << np.uint64(40)) | low


def sent_slots(slots: np.ndarray, bits: int) -> pa.Array:
    """For each part its slots, sorted, five bytes each; those found more than once, twice."""
    slots = np.sort(slots)
    if len(slots) > 2:
        slots = slots[np.r_[True, True, slots[2:] != slots[:-2]]]
    ends = np.searchsorted(slots, np.arange(1, (1 << bits) + 1, dtype=np.uint64) << np.uint64(40))
    data = np.ascontiguousarray(slots.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5])
    return pa.Array.from_buffers(pa.binary(), 1 << bits, [
        None, pa.py_buffer(np.r_[0, 5 * ends].astype(np.int32)), pa.py_buffer(data)])


def places(low: np.ndarray, i: int) -> np.ndarray:
    """The ``i``-th place of slots in filters, of which the last bits are taken."""
    x = mixed(low, 17)
    return x + np.uint64(i) * (x >> np.uint64(32) | np.uint64(1))


def repeated_slots(own: np.ndarray, up: np.ndarray) -> np.ndarray:
    """Slots that come more than once, one of them from a document's own class."""
    one = np.uint64(1)
    tagged = np.sort(np.r_[own << one, up << one | one])
    slots = tagged >> one
    first = np.flatnonzero(np.r_[True, slots[1:] != slots[:-1]][:len(slots)])
    count = np.diff(np.r_[first, len(slots)])
    return slots[first[(count > 1) & (tagged[first] & one == 0)]]


def repeated_tokens(reps: DataFrame) -> tuple[DataFrame, int]:
    """A filter of the coarse tokens that several documents may share, and the bits of a slot's part.

    Nearly all coarse tokens belong to one document, and those need not be shuffled with
    it. Each task sends the slots of its tokens, five bytes each, to a part by their highest
    bits, a slot it has itself more than once twice, and the parts find those
    that came more than once, one of them from a document's own class. They return (part,
    filter): a Bloom filter, two bytes for a token, which tasks read whatever their number.
    Two tokens may fall into a slot, and others pass the filter, so this only rules out;
    what stays is counted as it is.
    """
    n = reps.agg(F.sum(F.size("own") + F.size("up"))).first()[0] or 0
    bits = max(0, math.ceil(math.log2(max(1, n) / PART_TOKENS)))

    def sent(held):
        cells = [sent_slots(np.concatenate(side), bits) for side in held]
        table = pa.table([pa.array(np.arange(1 << bits)), *cells], names=["part", "own", "up"])
        some = np.diff(np.asarray(cells[0].buffers()[1]).view(np.int32)) + np.diff(
            np.asarray(cells[1].buffers()[1]).view(np.int32))
        return table.filter(pa.array(some > 0)).combine_chunks().to_batches()

    def send(batches):
        held, size = ([], []), 0
        for b in batches:
            for i, side in enumerate(held):
                sigs = b.column(i).flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                side.append(slots_of(sigs, bits))
                size += len(sigs)
            if size >= SENT_TOKENS:
                yield from sent(held)
                held, size = ([], []), 0
        if size:
            yield from sent(held)

    def find(table: pa.Table) -> pa.Table:
        own, up = (np.frombuffer(b"".join(table.column(c).to_pylist()), np.uint8).reshape(-1, 5)
                   for c in ("own", "up"))
        wide = [np.zeros((len(x), 8), np.uint8) for x in (own, up)]
        for to, x in zip(wide, (own, up)):
            to[:, :5] = x
        slots = repeated_slots(*[x.reshape(-1).view("<u8") for x in wide])
        size = max(64, 1 << math.ceil(math.log2(FILTER_BITS * max(1, len(slots)))))
        full = np.zeros(size, bool)
        for i in range(PROBES if len(slots) else 0):
            full[places(slots, i) & np.uint64(size - 1)] = True
        return pa.table({"part": table.column("part")[:1],
                         "filter": pa.array([np.packbits(full, bitorder="little").tobytes()])})

    out = reps.select("own", "up").mapInArrow(send, "part bigint, own binary, up binary")
    return stored(out.groupBy("part").applyInArrow(find, "part bigint, filter binary"),
                  "repeated-tokens"), bits


class Filters:
    """The filters of all parts."""

    def __init__(self, rows: list[tuple[int, bytes]], bits: int):
        self.bits = bits
        self.start, self.mask = np.zeros((2, 1 << bits), np.uint64)
        held, at = [b"\0"], 1  # an empty byte, for parts without a filter
        for part, data in rows:
            self.start[part], self.mask[part] = at, 8 * len(data) - 1
            held.append(data)
            at += len(data)
        self.data = np.frombuffer(b"".join(held), np.uint8)

    def passed(self, sigs: np.ndarray) -> np.ndarray:
        """Indexes of the coarse tokens that several documents may share."""
        at = np.arange(len(sigs))
        slots = slots_of(sigs, self.bits)
        part, low = (slots >> np.uint64(40)).astype(np.int64), slots & LOW_BITS
        for i in range(PROBES):
            place = places(low, i) & self.mask[part]
            cell = self.data[self.start[part] + (place >> np.uint64(3))]
            good = cell >> (place & np.uint64(7)).astype(np.uint8) & 1 == 1
            at, part, low = at[good], part[good], low[good]
        return at


def shared_tokens(reps: DataFrame, maybe: DataFrame, bits: int) -> DataFrame:
    """(doc, least, index, sig): the coarse tokens that pass the filter ``maybe``, a row each."""
    folder = as_uri(maybe.__dict__["_scratch_path"])

    def pick(batches):
        filters = None
        for b in batches:
            if filters is None:
                filters = Filters([(r["part"], r["filter"]) for x in written_batches(folder, 64)
                                   for r in x.to_pylist()], bits)
            for at, index in ((1, True), (3, False)):
                sigs = b.column(at).flatten().to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(b.num_rows), b.column(at).value_lengths())
                good = filters.passed(sigs.view(np.uint64))
                row = pa.array(row[good])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(row), b.column(at + 1).take(row),
                     pa.array(np.full(len(good), index)), pa.array(sigs[good])],
                    names=["doc", "least", "index", "sig"])

    return reps.select("doc_id", "own", "own_least", "up", "up_least").mapInArrow(
        pick, "doc bigint, least int, index boolean, sig bigint")


def set_table(docs: DataFrame, ids: DataFrame, n_words: int) -> DataFrame:
    """(doc, n, body) of the documents with these ids; a body is the sorted 64-bit hashes."""
    def build(batches):
        hashes = WordHashes()
        for b in batches:
            names = b.column(b.schema.get_field_index("doc_id")).to_pylist()
            texts = byte_texts(b)
            for at in range(0, len(texts), 500):
                sets = [shingles(hashes.of(words(t)), n_words) for t in texts[at:at + 500]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names[at:at + 500], pa.int64()),
                     pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([s.tobytes() for s in sets], pa.binary())],
                    names=["doc", "n", "body"])

    wanted = known_keys(docs.select("doc_id", "text"), ids.withColumnRenamed("doc", "doc_id"),
                        "doc_id")
    return stored(wanted.mapInArrow(build, "doc bigint, n bigint, body binary"), "sets")


def linked(q_sets: list[np.ndarray], sets: list[np.ndarray], num: int, den: int) -> tuple:
    """(query, member) indexes of links J >= num / den that connect whatever links of the tile connect.

    The union of the members' tokens bounds a query's overlap first; only queries
    that reach the threshold there are compared with the members.
    """
    size = np.array([len(s) for s in sets])
    tokens = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(tokens, kind="stable")
    union, start, count = np.unique(tokens[order], return_index=True, return_counts=True)
    owner = owner[order]
    root = np.arange(len(sets))  # of members, as joined by queries so far
    qi, mi = [], []
    for i, q in enumerate(q_sets):
        at = np.searchsorted(union, q)
        at = at[(at < len(union)) & (union[np.minimum(at, len(union) - 1)] == q)]
        if not len(q) or den * len(at) < num * len(q):
            continue
        n = count[at]
        first = np.repeat(start[at] - np.cumsum(n) + n, n)
        shared = np.bincount(owner[first + np.arange(n.sum())], minlength=len(sets))
        good = np.flatnonzero(den * shared >= num * (len(q) + size - shared))
        if len(good):
            _, one = np.unique(root[good], return_index=True)
            chosen = good[one]
            qi += [i] * len(chosen)
            mi += chosen.tolist()
            root[np.isin(root, root[chosen])] = root[chosen].min()
    return np.array(qi, np.int64), np.array(mi, np.int64)


def commonness(lead: np.ndarray, sample: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Shingles in which members of the sample differ from the lead, and how many do."""
    gaps = [np.setxor1d(s, lead, assume_unique=True) for s in sample]
    return np.unique(np.concatenate([lead[:0], *gaps]), return_counts=True)


def against(q: np.ndarray, lead: np.ndarray, known: np.ndarray, count: np.ndarray,
            num: int, den: int) -> tuple:
    """(linked, own, either): whether J >= num / den, and the shingles of the difference
    to meet partners by: two documents not linked to the lead meet by ``own`` ones, one
    that is not and one that is by ``either``. ``known`` and ``count`` order them."""
    if not len(q) or not len(lead):  # no partners
        return False, q[:0], q[:0]
    at = np.searchsorted(lead, q)
    both = lead[np.minimum(at, len(lead) - 1)] == q
    lacks = np.ones(len(lead), bool)
    lacks[at[both]] = False
    gap = np.r_[q[~both], lead[lacks]]
    n, shared = len(gap), int(both.sum())
    often = np.zeros(n, np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, gap), len(known) - 1)
        often = np.where(known[at] == gap, count[at], 0)
    gap = gap[np.lexsort((gap, np.arange(n) >= len(q) - shared, often))]
    # the least that is shared with a partner not linked to the lead, and with any
    half = (n * (den + num) + (den - num) * (len(lead) - len(q))) // (2 * (den + num)) + 1
    least = max(1, n - len(q) * (den - num) // num)
    if den * shared >= num * (len(q) + len(lead) - shared):
        return True, gap[:0], gap[:max(0, n - half + 1)] if n else gap
    return False, gap[:max(0, n - max(half, least) + 1)], gap[:n - least + 1]


COMPARED = "doc bigint, member bigint, linked boolean, own array<bigint>, either array<bigint>"


def compared(asks: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(gid, doc) documents with their leaders: links, and the tokens of their differences."""
    def rows_of(gid: int, ids: list, sets: list, members: list, others: list) -> list:
        leads = [m for i, m in zip(members, others) if i == gid]
        rows = []
        sample = [m for i, m in zip(members, others) if i != gid]
        for lead in leads:
            name = mixed(lead).sum(dtype=np.uint64)
            known, count = commonness(lead, sample)
            for doc, q in zip(ids, sets):
                hit, *tokens = against(q, lead, known, count, num, den)
                rows.append((doc, gid, hit, *(
                    mixed(x ^ name, seed).view(np.int64) for x, seed in zip(tokens, (11, 13)))))
        return rows

    def run(batches):
        names = ("gid", "ids", "bodies", "m_ids", "m_bodies")
        for b in batches:
            for i in range(b.num_rows):
                gid, ids, bodies, members, others = (
                    b.column(b.schema.get_field_index(x))[i].as_py() for x in names)
                rows = rows_of(
                    gid, ids, [np.frombuffer(x, np.uint64) for x in bodies], members,
                    [np.frombuffer(x, np.uint64) for x in others])
                cols = list(zip(*rows)) or [[]] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(cols, (
                        pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int64()),
                        pa.list_(pa.int64())))],
                    names=["doc", "member", "linked", "own", "either"])

    parts = int(asks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = stored(asks.groupBy("gid").agg(F.count("*").alias("w")), "ask-sizes")
    total = int(sizes.agg(F.sum("w")).first()[0] or 0)
    step = F.greatest(F.lit(1), F.floor(F.col("w") / SAMPLED))
    sample = spread_lookup(asks, sizes.withColumn("step", step), "gid", "w", total, parts,
                           F.xxhash64("doc")).filter(
        F.pmod(F.xxhash64("doc", "gid"), F.col("step")) == 0)
    heads = sizes.select("gid", F.col("gid").alias("doc")).unionByName(sample.select("gid", "doc"))
    pairs, read = tiles(asks, heads, sets, BLOCK_SHINGLES, 1 << 40)
    out = stored(pairs.mapInArrow(run, COMPARED), "compared")
    for table in (*read, sizes):
        release(table)
    return out


def next_tokens(found: DataFrame) -> DataFrame:
    """(tok, doc, side): tokens of the differences; side 0 meets side 0, side 1 side 2."""
    return found.select("doc", F.explode(F.array(
        F.struct(F.col("own").alias("toks"), F.lit(0).alias("side")),
        F.struct(F.col("either").alias("toks"),
                 F.when(F.col("linked"), 1).otherwise(2).alias("side")))).alias("x")).select(
        "doc", "x.side", F.explode("x.toks").alias("tok"))


def meeting(tokens: DataFrame) -> tuple[DataFrame, int]:
    """(tok, gid, w), written: tokens of documents that meet and are not connected yet, with the
    smallest document and the number of rows; the sum of these."""
    heads = stored(tokens.groupBy("tok").agg(
        F.min("doc").alias("gid"), F.max("doc").alias("last"), F.count("*").alias("w"),
        F.min("side").alias("low"), F.max("side").alias("high"),
        F.min("root").alias("root"), F.max("root").alias("other"))
        .filter("gid <> last and root <> other and (low = 0 or low = 1 and high = 2)")
        .select("tok", "gid", "w"), "heads")
    return heads, int(heads.agg(F.sum("w")).first()[0] or 0)


def group_links(tokens: DataFrame, docs: DataFrame, n_words: int, num: int,
                den: int) -> list[DataFrame]:
    """Tables (a, b) of links that connect all linked documents that share a token.

    ``tokens`` is a stored table (tok, doc, side); a token counts if documents of sides that
    meet have it.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    links, sets = [], None
    for left in range(ROUNDS, -1, -1):
        heads, total = meeting(tokens.withColumn("root", F.col("doc")))
        if links and total > CONNECTED:
            release(heads)
            roots = components(functools.reduce(DataFrame.unionByName, links))
            for table in links:
                release(table)
            heads, total = meeting(
                tokens.join(roots.withColumnRenamed("id", "doc"), "doc", "left")
                .withColumn("root", F.coalesce("root", "doc")))
            links = [stored(roots.filter("id <> root").select(
                F.col("id").alias("a"), F.col("root").alias("b")), "stars")]
            release(roots)
        if not total:
            release(heads)
            break
        grouped = spread_lookup(tokens.select("tok", "doc"), heads, "tok", "w", total, parts,
                                F.xxhash64("doc"))
        grouped = grouped.filter(F.col("gid").isNotNull())
        asks = stored(grouped.select("gid", "doc").distinct(), "asks")
        if sets is None:
            ids = stored(asks.select("doc").distinct(), "set-ids")
            sets = set_table(docs, ids, n_words)
            release(ids)
        release(tokens)
        release(heads)
        sizes = stored(asks.groupBy("gid").agg(F.count("*").alias("w")), "ask-sizes")
        large = sizes.filter(F.col("w") > FEW)
        rows, pairs = large.agg(F.sum("w"), F.sum(F.col("w") * F.col("w"))).first()
        every = not left or not rows or bool(links) and pairs <= PAIRS * rows
        some = asks if every else stored(
            known_keys(asks, large.select("gid"), "gid", "left_anti"), "few-asks")
        found = tiled_links(
            some, some, sets, BLOCK_SHINGLES,
            lambda *sides: linked(*[[np.frombuffer(x, np.uint64) for x in side]
                                    for side in sides], num, den))
        links.append(stored(found.filter("doc <> member").select(
            F.col("doc").alias("a"), F.col("member").alias("b")).distinct(), "stars"))
        release(found)
        release(some)
        if every:
            release(sizes)
            break
        found = compared(known_keys(asks, large.select("gid"), "gid").filter("doc <> gid"),
                         sets, num, den)
        release(asks)
        release(sizes)
        links.append(stored(found.filter("linked").select(
            F.col("doc").alias("a"), F.col("member").alias("b")).distinct(), "stars"))
        tokens = stored(next_tokens(found), "next-tokens")
        release(found)
    release(tokens)
    if sets is not None:
        release(sets)
    return links


def jaccard_components(docs: DataFrame, n_words: int = 3, num: int = 9,
                       den: int = 10) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id reachable by links of
    Jaccard similarity num / den or more between sets of ``n_words``-word shingles."""

    Parts(num, den)  # refuses thresholds for which links would be missed
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sketches = sketched(docs, n_words, num, den)
    # equal sets are one document, named by its smallest id
    alike = stored(
        sketches.filter("n > 0 and doc_id is not null")
        .groupBy(F.struct("k1", "k2", "n").alias("key"))
        .agg(F.min("doc_id").alias("rep"), F.count("*").alias("w")).filter("w > 1"), "alike")
    total = int(alike.agg(F.sum("w")).first()[0] or 0)
    rows = spread_lookup(
        sketches.select("doc_id", "n", F.struct("k1", "k2", "n").alias("key")), alike, "key", "w",
        total, parts, F.xxhash64("doc_id"))
    known = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    rep = F.when(known, F.coalesce("rep", "doc_id")).otherwise(F.col("doc_id"))
    named = stored(rows.select("doc_id", "n", "key.k1", "key.k2", rep.alias("rep")), "named")
    release(alike)
    copies = stored(named.filter(F.col("rep") != F.col("doc_id")).select(
        "doc_id", "k1", "k2").distinct(), "copies")
    reps = known_keys(sketches.filter(known), copies, ["doc_id", "k1", "k2"], "left_anti")

    # the matrix: coarse tokens that more than one document has, one of them in its own class
    maybe, bits = repeated_tokens(reps)
    each = stored(shared_tokens(reps, maybe, bits), "tokens")
    for table in (sketches, copies, maybe):
        release(table)
    live = stored(
        each.groupBy("sig").agg(F.count("*").alias("w"), F.max("index").alias("indexed"))
        .filter("w > 1 and indexed").drop("indexed"), "live")
    total = int(live.agg(F.sum("w")).first()[0] or 0)
    hits = spread_lookup(
        each, live.withColumn("df", F.col("w")), "sig", "w", total, parts, F.xxhash64("doc"))
    hits = hits.filter(F.col("df").isNotNull())
    # a document needs `least` shared ones; its most frequent `least - 1` are left out
    by_doc = hits.groupBy("doc", "index").agg(
        F.first("least").alias("least"),
        F.sort_array(F.collect_list(F.struct("df", "sig"))).alias("sigs"))
    kept = by_doc.filter(F.size("sigs") >= F.col("least")).select(
        "doc", "index", F.explode(F.slice(
            "sigs", 1, F.size("sigs") - F.col("least") + 1)).alias("x"))
    # a token meets if one document has it in its own class
    kept = stored(kept.select("doc", F.when(F.col("index"), 0).otherwise(1).alias("side"),
                              F.col("x.sig").alias("tok")), "kept")
    release(each)
    release(live)
    found = group_links(kept, docs, n_words, num, den)
    none = spark.range(0).select(F.col("id").alias("a"), F.col("id").alias("b"))
    linked_docs = components(functools.reduce(DataFrame.unionByName, found, none))
    for table in found:
        release(table)
    weights = named.groupBy("rep").agg(F.count("*").alias("w"))
    roots = stored(linked_docs.withColumnRenamed("id", "rep").join(weights, "rep"), "roots")
    release(linked_docs)
    total = int(named.count())
    out = spread_lookup(named.select("doc_id", "n", "rep"), roots, "rep", "w", total, parts,
                        F.xxhash64("doc_id", "n"))
    return out.select("doc_id", F.col("n").alias("n_shingles"),
                      F.coalesce("root", "rep").alias("component_id"))
