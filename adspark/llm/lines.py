"""Line dedup by a segment-partition edit join.

Lines within ``distance`` edits of each other, directly or through others, are
a class; the first occurrence of a class (smallest doc_id, then line number)
stays and the others leave their documents. Lines are compared without white
space at their ends. Those with under ``least_chars`` characters are not joined: of equal
ones, from ``exact_chars`` characters on, the first stays; near copies of them stay too.

The join: a line is split into distance + 1 segments, so a line within the
distance holds one of them unchanged. Every line is indexed by its segments, with
its length, and probes, for each length it may meet, the substrings that can be
such a segment: at each place the edits left and right of a segment limit how far
it may have moved. Lines that share an entry are verified by edit distance in
a band of 2 * distance + 1 diagonals, held in the bits of a word.

Skew: entries are counted before lines are joined. The lines of an entry with up to ``FEW`` are
paired, and each different pair is compared once, many pairs in a step. Of a larger entry's
lines, those linked to its first line are done, and only the rest is compared with all of
the entry's lines, in blocks spread over tasks. Copies of a line are one line. Texts
travel only for lines that share an entry. The work left is the product, per entry, of
the lines not linked to its first line and all its lines.

Nulls: a null text stays null and has no lines; a null doc_id comes first. Every row is a
document, told apart by a number it gets, so rows that repeat a doc_id or have none
lose only lines of their own; of a line at the same place in such rows one stays. Documents
whose lines all left have an empty text. Empty tables give no rows; other columns are kept,
and columns that clash with the added ones are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from adspark.llm._common import byte_texts, known_keys, spread_lookup, stored, unused
from adspark.llm.components import components
from adspark.llm.tiles import tiled_links
from adspark.sources.scratch import release

SPACE = " \t\n\x0b\x0c\r"
#: Seed of Spark's xxhash64, so that SQL and tasks name a line alike.
SEED = 42
BLOCK_CHARS = 200_000
#: Lines of an entry up to which they are compared in pairs; characters of a step of comparisons.
FEW = 32
CELLS = 1 << 18
#: Removed lines up to which their list is broadcast to the documents.
SMALL = 1_000_000


def segments(length: int, distance: int) -> list[tuple[int, int]]:
    """(start, length) of distance + 1 segments; the later ones take what is left over."""
    k = distance + 1
    base, more = divmod(length, k)
    out, at = [], 0
    for i in range(k):
        n = base + (i >= k - more)
        out.append((at, n))
        at += n
    return out


def probes(length: int, distance: int) -> list[tuple[int, int, int, int]]:
    """(indexed length, segment, start, length) of the substrings that a line looks up.

    Segment i of a shorter line, with e edits before it at most, e <= i, has moved by e
    at most; the edits behind it, distance - i at most, have to make up for the rest
    of the difference in length.
    """
    out = []
    for shorter in range(max(length - distance, distance + 1), length + 1):
        gap = length - shorter
        for i, (at, n) in enumerate(segments(shorter, distance)):
            low = max(0, at - i, at + gap - (distance - i))
            high = min(length - n, at + i, at + gap + (distance - i))
            out += [(shorter, i, s, n) for s in range(low, high + 1)]
    return out


def line_id(line: bytes) -> int:
    h = xxhash.xxh64_intdigest(line, SEED)
    return h - (1 << 64) if h >> 63 else h


def indexed(docs: DataFrame, distance: int, least_chars: int) -> DataFrame:
    """(line, own, probe): ids of lines with the entries they index and those they only probe."""
    def build(batches):
        plans: dict[int, tuple[list, list]] = {}
        digest = xxhash.xxh3_64_intdigest
        for b in batches:
            seen: set[int] = set()
            rows: list[tuple] = []
            for text in byte_texts(b):
                for raw in text.split(b"\n"):
                    raw = raw.strip(SPACE.encode())
                    if len(raw) < least_chars:
                        continue
                    line = raw.decode()
                    n = len(line)
                    if n < least_chars:
                        continue
                    h = line_id(raw)
                    if h in seen:
                        continue
                    seen.add(h)
                    if n not in plans:
                        own = [(n, i, s, k) for i, (s, k) in enumerate(segments(n, distance))]
                        plans[n] = [[(4 * s, 4 * (s + k), length * 64 + i)
                                     for length, i, s, k in wanted]
                                    for wanted in (own, probes(n, distance))]
                    wide = memoryview(line.encode("utf-32-le"))
                    own, probe = ({digest(wide[s:e], seed) for s, e, seed in plan}
                                  for plan in plans[n])
                    rows.append((h, list(own), list(probe - own)))
                if len(rows) >= 5000:
                    yield batch_of(rows)
                    rows = []
            if rows:
                yield batch_of(rows)

    def batch_of(rows):
        ids, own, probe = zip(*rows)
        lists = [pa.ListArray.from_arrays(
            np.r_[0, np.cumsum([len(x) for x in side])].astype(np.int32),
            np.array([v for x in side for v in x], np.uint64).view(np.int64))
            for side in (own, probe)]
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), *lists], names=["line", "own", "probe"])

    return stored(docs.select("text").mapInArrow(
        build, "line bigint, own array<bigint>, probe array<bigint>"), "line-entries")


def _matrix(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of lines, one row each, padded behind; their lengths."""
    points = [np.frombuffer(x.decode().encode("utf-32-le"), np.uint32) for x in lines]
    size = np.array([len(p) for p in points])
    out = np.zeros((len(points), size.max(initial=0) + 1), np.uint32)
    for row, p in zip(out, points):
        row[:len(p)] = p
    return out, size


def within(a: np.ndarray, others: np.ndarray, size: np.ndarray, distance: int) -> np.ndarray:
    """Which rows of ``others`` are at most ``distance`` edits from ``a``."""
    return pairs_within(np.broadcast_to(np.r_[a, np.zeros(1, a.dtype)], (len(size), len(a) + 1)),
                        np.full(len(size), len(a)), others, size, distance)


def pairs_within(left: np.ndarray, n: np.ndarray, right: np.ndarray, size: np.ndarray,
                 distance: int) -> np.ndarray:
    """Which rows of ``left``, of ``n`` characters, are at most ``distance`` edits from those of ``right``.

    Word e of a pair has a bit for each diagonal of the band that e edits reach; a
    step over a character of ``left`` moves all diagonals at once. Pairs start behind their
    common prefix, end before their common suffix, and drop out when no diagonal is reached.
    """
    k = distance
    ok = np.zeros(len(size), bool)
    gap = size - n
    live = np.flatnonzero(np.abs(gap) <= k)
    if not len(live):
        return ok
    width = right.shape[1]
    m = min(left.shape[1], width)
    least = np.minimum(n, size)[live]
    none = np.zeros((len(live), 1), bool)
    same = left[live, :m] == right[live, :m]
    same &= np.arange(m) < least[:, None]
    at = np.argmin(np.c_[same, none], axis=1)
    back = np.arange(1, m + 1)
    row = live[:, None]
    tail = (right[row, np.maximum(size[row] - back, 0)] == left[row, np.maximum(n[row] - back, 0)])
    tail &= back <= least[:, None]
    suffix = np.argmin(np.c_[tail, none], axis=1)
    end = n[live] - np.minimum(suffix, least - at)
    reach = np.zeros((k + 1, len(live)), np.uint64)
    for e in range(k + 1):  # edits e alone reach e diagonals to the right
        reach[e] = (1 << (k + e + 1)) - (1 << k)
    one, band = np.uint64(1), np.uint64((1 << (2 * k + 1)) - 1)
    while len(live):
        done = at >= end
        if done.any():
            final = reach[k, done] >> (gap[live[done]] + k).astype(np.uint64)
            ok[live[done]] = (final & one) == one
            live, at, end, reach = live[~done], at[~done], end[~done], reach[:, ~done]
            if not len(live):
                break
        match = np.zeros(len(live), np.uint64)
        for d in range(-k, k + 1):
            j = at + d
            inside = (j >= 0) & (j < size[live])
            equal = inside & (right[live, np.clip(j, 0, width - 1)] == left[live, at])
            match |= equal.astype(np.uint64) << np.uint64(d + k)
        last = reach[0] & match
        fresh = [last]
        for e in range(1, k + 1):
            before = reach[e - 1]
            last = ((reach[e] & match) | before | (before >> one) | (last << one)) & band
            fresh.append(last)
        reach = np.stack(fresh)
        at = at + 1
        alive = reach[k] != 0
        if not alive.all():
            live, at, end, reach = live[alive], at[alive], end[alive], reach[:, alive]
    return ok


def tallies(points: np.ndarray, size: np.ndarray) -> np.ndarray:
    """How many characters of each row fall into each of 16 classes; an edit changes two by one at most."""
    row, at = np.nonzero(np.arange(points.shape[1]) < size[:, None])
    cell = row * 16 + (points[row, at] & np.uint32(15))
    return np.bincount(cell, minlength=16 * len(points)).reshape(-1, 16)


def spanning(queries: list[bytes], members: list[bytes], distance: int) -> tuple:
    """(query, member) indexes of links that connect whatever links within the tile connect."""
    left, n = _matrix(queries)
    right, size = _matrix(members)
    mine, theirs = tallies(left, n), tallies(right, size)
    root = np.arange(len(members))  # of members, as joined by queries so far
    qi, mi = [], []
    for i in range(len(queries)):
        may = np.flatnonzero(np.abs(theirs - mine[i]).sum(axis=1) <= 2 * distance)
        hit = may[within(left[i, :n[i]], right[may], size[may], distance)]
        if len(hit):
            _, first = np.unique(root[hit], return_index=True)
            chosen = hit[first]
            qi += [i] * len(chosen)
            mi += chosen.tolist()
            root[np.isin(root, root[chosen])] = root[chosen].min()
    return np.array(qi, np.int64), np.array(mi, np.int64)


def paired_links(pairs: DataFrame, bodies: DataFrame, distance: int) -> DataFrame:
    """Those of the pairs (a, b) of lines that are within the distance, written."""
    def compare(batches):
        for b in batches:
            left, right = (b.column(b.schema.get_field_index(x)).to_pylist() for x in ("left", "right"))
            size = np.array([max(len(x), len(y)) for x, y in zip(left, right)], np.int64)
            order = np.argsort(size, kind="stable")
            ok = np.zeros(b.num_rows, bool)
            start = 0
            while start < len(order):  # as many as fit; a longer pair is a step of its own
                cells = size[order[start:]] * np.arange(1, len(order) - start + 1)
                some = order[start:start + max(1, int(np.searchsorted(cells, CELLS, "right")))]
                (x, n), (y, m) = (_matrix([side[i] for i in some]) for side in (left, right))
                ok[some] = pairs_within(x, n, y, m, distance)
                start += len(some)
            yield b.select(["a", "b"]).filter(pa.array(ok))

    sides = [bodies.select(F.col("doc").alias(i), F.col("body").alias(body))
             for i, body in (("a", "left"), ("b", "right"))]
    both = pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "left", "right")
    return stored(both.mapInArrow(compare, "a bigint, b bigint"), "line-pairs")


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def occurrences(docs: DataFrame, row: str, least_chars: int) -> DataFrame:
    """(row, doc_id, no, line, other): every line that counts, with two hashes of it."""
    rows = docs.select(F.col(row).alias("row"), "doc_id", F.posexplode(_lines(F.col("text"))).alias("no", "raw"))
    rows = rows.withColumn("s", F.btrim("raw", F.lit(SPACE)))
    return rows.filter(F.length("s") >= least_chars).select(
        "row", "doc_id", F.col("no").cast("bigint").alias("no"), F.xxhash64("s").alias("line"),
        F.xxhash64(F.lit(1), "s").alias("other"))


def line_links(docs: DataFrame, distance: int, least_chars: int) -> tuple[DataFrame, list]:
    """(a, b) line ids that connect all lines within the distance, and the tables they come from."""
    entries = indexed(docs, distance, least_chars)
    each = entries.select("line", F.explode(F.array(
        F.struct(F.col("own").alias("keys"), F.lit(True).alias("own")),
        F.struct(F.col("probe").alias("keys"), F.lit(False).alias("own")))).alias("x"))
    each = each.select("line", "x.own", F.explode("x.keys").alias("key"))
    live = stored(each.groupBy("key").agg(
        F.min("line").alias("a"), F.max("line").alias("b"), F.max("own").alias("own"))
        .filter("own and a <> b").select("key"), "live-entries")
    hits = stored(known_keys(each, live, "key").distinct(), "hits")
    release(entries)
    release(live)

    # the first line of each entry, and the lines linked to it
    leads = stored(hits.groupBy("key").agg(
        F.min(F.when(F.col("own"), F.col("line"))).alias("lead"),
        (F.count("*") <= FEW).alias("few"), F.count("*").alias("w")), "line-leads")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    led = table = stored(spread_lookup(hits.select("key", "line", "own"), leads, "key", "w", hits.count(), parts,
                               F.xxhash64("line")), "led")
    wanted = stored(hits.select("line").distinct(), "line-ids")
    release(hits)
    release(leads)
    texts = docs.select(F.explode(_lines(F.col("text"))).alias("raw")).select(
        F.btrim("raw", F.lit(SPACE)).alias("s")).filter(F.length("s") >= least_chars)
    texts = known_keys(texts.withColumn("line", F.xxhash64("s")), wanted, "line")
    bodies = stored(texts.groupBy("line").agg(F.min("s").alias("s")).select(
        F.col("line").alias("doc"), F.length("s").cast("bigint").alias("n"),
        F.col("s").cast("binary").alias("body")), "line-texts")
    release(wanted)

    some = led.filter("few")
    pairs = some.filter("own").select("key", F.col("line").alias("x")).join(
        some.select("key", F.col("line").alias("y")), "key").filter("x <> y")
    pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    near = paired_links(pairs, bodies, distance)
    led = led.filter("not few")
    if not led.head(1):
        return near, [table, bodies, near]

    def compare(left: list[bytes], right: list[bytes]) -> tuple:
        return spanning(left, right, distance)

    asks = led.filter("line <> lead").select(
        F.col("lead").alias("gid"), F.col("line").alias("doc")).distinct()
    heads = asks.select("gid").distinct().withColumn("doc", F.col("gid"))
    direct = tiled_links(asks, heads, bodies, BLOCK_CHARS, compare)
    stars = stored(direct.distinct(), "line-stars")
    release(direct)
    rest = stored(led.filter("line <> lead").join(
        stars.select(F.col("doc").alias("line"), F.col("member").alias("lead")),
        ["line", "lead"], "left_anti").select(F.col("key").alias("gid"),
                                              F.col("line").alias("doc")), "line-rest")
    open_keys = rest.groupBy("gid").agg(F.count("*").alias("n"))
    members = led.select(F.col("key").alias("gid"), F.col("line").alias("doc")).join(
        open_keys.select("gid"), "gid", "left_semi")
    more = tiled_links(rest, members, bodies, BLOCK_CHARS, compare)
    links = stars.unionByName(more).filter("doc <> member").select(
        F.col("doc").alias("a"), F.col("member").alias("b"))
    return near.unionByName(links), [table, bodies, near, stars, rest, more]


def dedup_lines(docs: DataFrame, distance: int = 2, least_chars: int = 24,
                exact_chars: int = 1) -> DataFrame:
    """The documents with text reduced to the lines that stay, and ``n_lines``,
    ``n_removed``, ``kept_in``: for each line that left, the doc_id that keeps its class."""
    if least_chars < 2 * distance + 1:
        raise ValueError("least_chars must exceed twice the distance")
    if exact_chars < 1:
        raise ValueError("blank lines are no copies: exact_chars must be positive")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.drop("n_lines", "n_removed", "kept_in")
    columns = docs.columns
    row, leaving, split = (unused(x, columns) for x in ("row", "leaving", "split"))
    # the numbers have to stay the same for all readers, so the rows are written with them
    docs = stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered-documents")
    seen = stored(occurrences(docs, row, min(exact_chars, least_chars)), "occurrences")
    links, used = line_links(docs, distance, least_chars)
    classes = components(links)
    for table in used:
        release(table)
    near = classes.withColumnRenamed("id", "line")
    counts = seen.join(near.select("line"), "line", "left_semi").groupBy("line").agg(
        F.count("*").alias("w"))
    near = stored(near.join(counts, "line"), "near")
    release(classes)
    total = seen.count()
    rows = spread_lookup(seen, near, "line", "w", total, parts, F.xxhash64("row", "no"))
    rows = classed = stored(rows.select(
        "row", "doc_id", "no", F.coalesce("root", "line").alias("a"),
        F.when(F.col("root").isNull(), F.col("other")).otherwise(0).alias("b")), "classed")
    release(seen)
    release(near)
    # most lines are found once, and need no first one
    again = stored(rows.groupBy("a", "b").agg(F.count("*").alias("w")).filter("w > 1").select(
        "a", "b"), "repeated-lines")
    rows = stored(known_keys(rows, again, ["a", "b"]).select(
        "row", "doc_id", "no", F.struct("a", "b").alias("class")), "repeated")
    release(classed)
    release(again)
    total = rows.count()
    first = stored(rows.groupBy("class").agg(
        F.min(F.struct("doc_id", "no", "row")).alias("first"), F.count("*").alias("w")),
        "first-lines")
    placed = spread_lookup(rows, first, "class", "w", total, parts, F.xxhash64("row", "no"))
    gone = placed.filter(~F.struct("row", "no").eqNullSafe(F.struct("first.row", "first.no")))
    gone = stored(gone.groupBy("row").agg(F.sort_array(F.collect_list(
        F.struct("no", F.col("first.doc_id").alias("kept")))).alias(leaving)), "gone")
    release(rows)
    release(first)
    size = gone.agg(F.sum(F.size(leaving))).first()[0] or 0
    gone = gone.withColumnRenamed("row", row)
    out = docs.join(F.broadcast(gone) if size <= SMALL else gone, row, "left")
    # a column, as a function of each line would split the text for each
    out = out.withColumn(split, _lines(F.col("text")))
    last = F.size(split) - 1
    stay = F.array_except(F.sequence(F.lit(0).cast("bigint"), last.cast("bigint")),
                          F.transform(leaving, lambda g: g["no"]))
    left = F.array_join(F.transform(stay, lambda i: F.get(F.col(split), i.cast("int"))), "\n")
    return out.select(*[
        F.when(F.col(leaving).isNull(), F.col("text")).otherwise(left).alias(c)
        if c.lower() == "text" else F.col(f"`{c}`") for c in columns],
        F.when(F.col("text").isNull(), 0).otherwise(F.size(split)).cast("bigint").alias("n_lines"),
        F.coalesce(F.size(leaving), F.lit(0)).cast("bigint").alias("n_removed"),
        F.coalesce(F.transform(leaving, lambda g: g["kept"]),
                   F.array().cast("array<bigint>")).alias("kept_in"))
