"""Hierarchical Pitman-Yor language model: seating by Gibbs sampling, averaged predictions.

A word follows a context, the 64-bit hash of the word before it: a restaurant for each
different word; all share one parent, whose own base is uniform over the known words and one unknown.
Customers are the words of the training texts; every table of a context sends a
customer to the parent. A first pass seats the customers. A sweep seats every
customer again, with the probabilities of the Chinese restaurant process, and then does the
same for all of the parent's with the tables that it now gets. A restaurant (of one word) with up to
``DRAWN`` customers is seated as a whole: only its number of tables matters, t with
probability proportional to fresh ** t * S(c, t), S the generalised Stirling numbers, which is what
seating one by one converges to. In larger ones customers sit down one after the other in the first
pass, and in a sweep each gets up once. After the burn-in, each sweep gives a sample; a word's
probability is the mean over samples.

Spark's part. Words are dealt to parts by hash, so that all contexts of a word, its
customers and its parent's tables are in one part; a word frequent in a bounded
sample (which decides on balance only) is dealt over several parts by context. A text
becomes counts of (word, context, text) which go to the word's part once, in blocks.
Parts sample at the same time against the totals of the sweep before. Tables per
context are summed in buckets of contexts, of which each part sends its own and gets back
the sums, a row for each part and bucket; only the parent's totals reach the driver, with
the sums of frequent words, fewer than 4 for each part. To score, each
part sums log probabilities by text, and the sums meet again by block. State and counts of a
part are files in the shared folder, which tasks write and read; of a sweep's state the rows of
a written table have the places only, so that it does not pass through the executors' own memory. A
pair of words takes one entry for each text that has it.

Nulls: a null text is empty and has the end token alone; the id of a null doc_id is
the empty text. Repeated rows are texts of their own. An empty table gives no rows.
With no training text every probability is that of the base. Extra columns are left out.
"""

from __future__ import annotations

import pickle
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from adspark.llm._common import (  # noqa: F401 (hashes by name for tests)
    WordHashes, arrow_batches, give_back, mixed, parts_for, stored, text_bytes,
)
from adspark.llm.files import as_uri, put_file
from adspark.sources.scratch import delete_path, new_scratch_path, release

#: Bytes of text for each part; tokens of a block of texts.
PART_BYTES = 16_000_000
BLOCK_TOKENS = 1_250_000
SAMPLE_BYTES = 64_000_000
#: Bytes of the rows that a Python task gets at a time.
BATCH_BYTES = 4 << 20
#: Parts for each bucket of contexts.
PARTS_PER_BUCKET = 4
END, START = np.uint64(0x9D3779B97F4A7C15), np.uint64(0x51ED270B35AE1B2D)
#: Discount and strength of contexts, and of their parent.
DISCOUNT, STRENGTH = 0.8, 2.0
ROOT_DISCOUNT, ROOT_STRENGTH = 0.7, 100.0
BURN_IN, SAMPLES = 3, 4
#: Restaurants up to which each is seated by itself; random numbers drawn at a time for one.
FEW, DRAWS = 300, 1 << 16
#: Customers up to which a restaurant is seated as a whole; weights held at a time for that.
DRAWN, CELLS = 1024, 1 << 19
ROW = "k bigint, kind int, blob binary"


def packed(**arrays) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(arrays, 5))


def unpacked(blob: bytes) -> dict:
    """The arrays of ``packed`` or ``placed``."""
    arrays = pickle.loads(zstandard.ZstdDecompressor().decompress(blob))
    return read_file(arrays["place"]) if list(arrays) == ["place"] else arrays


def placed(path: str, **arrays) -> bytes:
    """Arrays written as a file, and in their stead its place."""
    put_file(path, packed(**arrays))
    return packed(place=path)


def read_file(path: str) -> dict:
    fs, path = pafs.FileSystem.from_uri(path)
    with fs.open_input_stream(path, compression=None) as f:
        return unpacked(f.read())


def least_type(x: np.ndarray) -> np.ndarray:
    """The same whole numbers in the narrowest unsigned type."""
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


def held_out(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 == 1


def rows_of(rows: list[tuple]) -> pa.RecordBatch:
    k, kind, blob = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(k, pa.int64()), pa.array(kind, pa.int32()), pa.array(blob, pa.binary())],
        names=["k", "kind", "blob"])


# ---- tables of restaurants: (owner, size) arrays, sorted by owner ----

def seated(c, fresh, discount, rng, owner, size, again=False):
    """Tables after every restaurant r has its ``c[r]`` customers; ``fresh``: weights of a new one.

    Those missing sit down one after the other; with ``again``, when none is missing, each
    customer gets up once, in a random order, and sits down again. A table is chosen with weight size - discount:
    that of a random other customer, refused with probability discount / size. All
    restaurants take a step at the same time, and leave the loop when they are through.
    """
    have = np.bincount(owner, size, len(c)).astype(np.int64)
    steps = c if again else c - have
    order = np.argsort(-steps, kind="stable")
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    c, have, steps, fresh = c[order], have[order], steps[order], np.asarray(fresh)[order]
    start = np.cumsum(c) - c  # of a restaurant's customers, and of as many places for tables
    total = int(c.sum())
    by = np.argsort(rank[owner], kind="stable")
    at, size = rank[owner][by], size[by]
    t = np.bincount(at, minlength=len(c))
    place = start[at] + np.arange(len(at)) - np.repeat(np.cumsum(t) - t, t)
    kind = np.int32 if total < 1 << 31 else np.int64
    n = np.zeros(total, kind)
    n[place] = size
    seat = np.zeros(total, kind)  # the place of each customer
    seat[np.repeat(start - np.cumsum(have) + have, have) + np.arange(have.sum())] = np.repeat(
        place, size)
    if again:  # the order in which they get up must not follow the tables
        mix = np.flatnonzero(np.repeat(t > 1, c))
        seat[mix] = seat[mix][np.argsort(np.repeat(np.arange(len(c)), c)[mix] + rng.random(len(mix)))]
    spare, empty = c - t, np.arange(total, dtype=kind) + np.repeat(t.astype(kind), c)  # stacks of places without a table
    first = start if again else start + have
    p, live = 0, np.searchsorted(-steps, 0)
    while live > FEW:
        mine = first[:live] + p
        if again:
            left = seat[mine]
            n[left] -= 1
            gone = np.flatnonzero(n[left] == 0)
            empty[start[gone] + spare[gone]] = left[gone]
            spare[gone] += 1
        who = np.arange(live)
        while len(who):
            others = c[who] - 1 if again else have[who] + p
            x = rng.random(len(who)) * (others + fresh[who])
            opens = x >= others
            r = who[opens]
            spare[r] -= 1
            k = empty[start[r] + spare[r]]
            n[k], seat[mine[r]] = 1, k
            r, x = who[~opens], x[~opens]
            j = x.astype(np.int64)
            x -= j
            if again:
                j += j >= p
            k = seat[start[r] + j]
            ok = x * n[k] >= discount
            n[k[ok]] += 1
            seat[mine[r[ok]]] = k[ok]
            who = r[~ok]
        p += 1
        live = np.searchsorted(-steps, -p)
    for r in range(live):
        _seat_one(p, int(have[r]), int(spare[r]), float(fresh[r]), discount, rng, again,
                  *(x[start[r]:start[r] + c[r]] for x in (seat, n, empty)), int(start[r]))
    used = n > 0
    owner, size = np.repeat(order, c)[used], n[used]
    by = np.argsort(owner, kind="stable")
    return owner[by], size[by]


def _seat_one(p, have, spare, fresh, discount, rng, again, seat, n, empty, start) -> None:
    """The steps of one restaurant from ``p`` on; few large ones are faster one by one.

    Whom a customer follows first does not depend on the tables, and is drawn for many at once.
    """
    c, sizes, seats = len(seat), n, seat
    seats -= start
    seat = seats.tolist() if c <= DRAWS else memoryview(seats)
    n, empty = n.tolist(), memoryview(empty)
    more = iter(())
    for first in range(p if again else have + p, c, DRAWS):
        who = np.arange(first, min(c, first + DRAWS))
        others = np.full(len(who), c - 1) if again else who
        x = rng.random(len(who)) * (others + fresh)
        j = np.where(x < others, x, -1).astype(np.int64)
        x -= j
        if again:
            j += j >= who
        for i, j, x in zip(who.tolist(), j.tolist(), x.tolist()):
            if again:
                k = seat[i]
                n[k] -= 1
                if not n[k]:
                    empty[spare] = k + start
                    spare += 1
            while True:
                if j < 0:
                    spare -= 1
                    k = empty[spare] - start
                    break
                k = seat[j]
                if x * n[k] >= discount:
                    break
                x = next(more, None)
                if x is None:
                    more = iter(rng.random(min(DRAWS, c)).tolist())
                    x = next(more)
                others = c - 1 if again else i
                x *= others + fresh
                j = -1
                if x < others:
                    j = int(x)
                    x -= j
                    j += again and j >= i
            n[k] += 1
            seat[i] = k
    if c <= DRAWS:
        seats[:] = seat
    seats += start
    sizes[:] = n


def drawn(c, fresh, discount, rng):
    """Numbers of tables of restaurants with ``c`` customers, all of whom are seated anew.

    The logarithms of the Stirling numbers of c customers follow from those of c - 1.
    """
    out = np.minimum(c, 1).astype(np.int64)
    order = np.argsort(c, kind="stable")
    top = int(c.max(initial=0))
    edges = np.searchsorted(c[order], np.arange(2, top + 2))
    slope = np.log(np.broadcast_to(fresh, len(c))[order])
    tables = np.arange(1.0, top + 1)
    row = np.zeros(1)  # for t from 1
    for n, start, end in zip(range(2, top + 1), edges, edges[1:]):
        stay = row + np.log(n - 1 - discount * tables[:n - 1])
        last, row = row, np.empty(n)
        row[0], row[-1] = stay[0], last[-1]
        np.logaddexp(last[:-1], stay[1:], out=row[1:-1])
        if n == 2 and end > start:
            out[order[start:end]] += rng.random(end - start) * (
                1 - discount + (f := np.exp(slope[start:end]))) < f
            continue
        for a in range(start, end, max(1, CELLS // n)):
            b = min(end, a + max(1, CELLS // n))
            weight = slope[a:b, None] * tables[:n]
            weight += row
            weight -= weight.max(axis=1, keepdims=True)
            np.cumsum(np.exp(weight, out=weight), axis=1, out=weight)
            x = rng.random(b - a) * weight[:, -1]
            out[order[a:b]] = 1 + np.count_nonzero(weight[:, :-1] <= x[:, None], axis=1)
    return out


def gibbs(owner, size, who, fresh_of, discount, sweeps, rng):
    """``sweeps`` times every customer of each of ``who`` is seated again; ``fresh_of()`` gives
    the weights of a new table."""
    for _ in range(sweeps if len(who) else 0):
        number = np.full(max(who.max(), owner.max()) + 1, -1)
        number[who] = np.arange(len(who))
        at = number[owner]
        mine = at >= 0
        c = np.bincount(at[mine], size[mine], len(who)).astype(np.int64)
        o, n = seated(c, fresh_of(), discount, rng, at[mine], size[mine], again=True)
        owner, size = np.r_[owner[~mine], who[o]], np.r_[size[~mine], n]
        order = np.argsort(owner, kind="stable")
        owner, size = owner[order], size[order]
    return owner, size


def resized(owner, size, now, wanted, fresh, discount, rng):
    """Customers come or go one by one until each restaurant has ``wanted``."""
    less = np.flatnonzero(wanted < now)
    if len(less):  # those who go are a random choice of a restaurant's customers
        mine = np.isin(owner, less)
        tables = np.flatnonzero(mine)
        table = np.repeat(tables, size[mine])
        by = np.lexsort((rng.random(len(table)), owner[table]))
        table = table[by]
        first = np.cumsum(now[less]) - now[less]
        nth = np.arange(len(table)) - np.repeat(first, now[less])
        goes = table[nth < np.repeat((now - wanted)[less], now[less])]
        size = size - np.bincount(goes, minlength=len(size))
        owner, size = owner[size > 0], size[size > 0]
    more = np.flatnonzero(wanted > now)
    if not len(more):
        return owner, size
    number = np.full(len(wanted), -1)
    number[more] = np.arange(len(more))
    at = number[owner]
    mine = at >= 0
    o, n = seated(wanted[more], np.full(len(more), fresh), discount, rng, at[mine], size[mine])
    owner, size = np.r_[owner[~mine], more[o]], np.r_[size[~mine], n]
    order = np.argsort(owner, kind="stable")
    return owner[order], size[order]


def root_sweep(owner, size, wanted, totals, discount, rng, first=False):
    """The parent's seating after its customers became ``wanted``; at ``first`` they all come in."""
    fresh = (ROOT_STRENGTH + ROOT_DISCOUNT * totals["tables"]) * totals["base"]
    if first:
        owner, size = np.zeros(0, np.int64), np.zeros(0, np.int64)
    now = np.bincount(owner, weights=size, minlength=len(wanted)).astype(np.int64)
    owner, size = resized(owner, size, now, wanted, fresh, discount, rng)
    if first:
        return owner, size
    who = np.flatnonzero(wanted > 1)
    return gibbs(owner, size, who, lambda: np.full(len(who), fresh), discount, 1, rng)


# ---- from texts to parts ----

def word_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of words of each text, the words of all as places in a list of hashes, and that
    list, ascending."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("").cast(pa.large_string())))
    flat = lists.flatten()
    some = pc.greater(pc.binary_length(flat), 0)  # white space at an end leaves an empty word
    n = np.bincount(pc.list_parent_indices(lists).to_numpy()[some.to_numpy(zero_copy_only=False)],
                    minlength=len(texts))
    coded = flat.filter(some).dictionary_encode()
    different, digest = coded.dictionary, xxhash.xxh3_64_intdigest
    _, places, letters = different.buffers()
    edge = np.frombuffer(places, np.int64)[different.offset:][:len(different) + 1].tolist()
    letters = letters.to_pybytes() if letters else b""
    hashes, at = np.unique(np.fromiter(
        (digest(letters[a:b]) for a, b in zip(edge, edge[1:])), np.uint64, len(different)),
        return_inverse=True)
    return n, at[coded.indices.to_numpy()], hashes


def block_rows(texts, names, block, parts, hot, spread):
    """Rows of one block: its counts for each part, and its texts."""
    n, w, vocab = word_codes(texts)
    give_back()
    n = n + 1
    ends = np.cumsum(n) - 1
    vocab, at = np.unique(np.r_[vocab, END, START], return_inverse=True)
    inner = np.ones(ends[-1] + 1, bool)
    inner[ends] = False
    word = np.full(len(inner), at[-2])
    word[inner] = at[w]
    del inner, w
    ctx = np.r_[at[-1], word[:-1]]
    ctx[ends[:-1] + 1] = at[-1]
    train = np.array([not held_out(d) for d in names])
    key = word * len(vocab) + ctx
    del word, ctx
    pairs = None
    if len(vocab) ** 2 * len(texts) >= 1 << 63:
        pairs, key = np.unique(key, return_inverse=True)
    key *= len(texts)
    key += np.repeat(np.arange(len(texts)), n)
    key.sort()
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    count = np.diff(np.r_[start, len(key)])
    pair_no, doc = np.divmod(key[start], len(texts))
    word, ctx = np.divmod(pair_no if pairs is None else pairs[pair_no], len(vocab))
    del key, start
    part = (mixed(vocab, 4) % np.uint64(parts)).astype(np.int64)[word]
    if len(hot):
        i = np.minimum(np.searchsorted(hot, vocab), len(hot) - 1)
        width = np.where(hot[i] == vocab, spread[i], 1)[word]
        part = (part + (mixed(vocab, 2) >> np.uint64(1)).astype(np.int64)[ctx] % width) % parts
    part = part.astype(np.min_scalar_type(parts))
    order = np.argsort(part, kind="stable")
    edges = np.searchsorted(part[order], np.arange(parts + 1))
    for k in range(parts):
        x = order[edges[k]:edges[k + 1]]
        if not len(x):
            continue
        pair = pair_no[x]
        start = np.flatnonzero(np.r_[True, np.diff(pair) != 0])
        own = word[x][start]
        begin = np.flatnonzero(np.r_[True, np.diff(own) != 0])
        own, pairs_of = own[begin], np.diff(np.r_[begin, len(own)])
        met, ctx_no = np.unique(ctx[x][start], return_inverse=True)
        yield k, 0, packed(
            block=block, words=vocab[own], pairs=least_type(pairs_of),
            rooms=vocab[met], ctx=least_type(ctx_no),
            train=least_type(np.add.reduceat(count[x] * train[doc[x]], start)),
            entries=least_type(np.diff(np.r_[start, len(x)])),
            doc=least_type(doc[x]), count=least_type(count[x]))
    yield parts + block, 1, packed(block=block, names=names, train=train, n=n)


def counted(docs: DataFrame, parts: int, hot: np.ndarray, spread: np.ndarray) -> DataFrame:
    """The rows of all blocks."""
    def count(batches):
        task, serial = TaskContext.get().partitionId(), 0
        texts, names, size = [], [], 0

        def rows():
            for r in block_rows(pa.concat_arrays(texts), names, (task << 24) + serial, parts, hot,
                                spread):
                yield rows_of([r])
            give_back()

        for b in batches:
            ids = b.column(b.schema.get_field_index("doc_id")).to_pylist()
            col = b.column(b.schema.get_field_index("text")).cast(pa.large_string())
            some = pc.fill_null(pc.add(pc.count_substring(col, " "), pc.count_substring(col, "\n")), 0)
            sizes = np.cumsum(some.to_numpy(zero_copy_only=False).astype(np.int64) + 1)
            a = 0
            while a < len(ids):
                before = sizes[a - 1] if a else 0
                e = int(np.searchsorted(sizes, before + BLOCK_TOKENS - size)) + 1
                texts.append(col[a:e])
                names += ids[a:e]
                size += sizes[min(e, len(ids)) - 1] - before
                if e <= len(ids):
                    yield from rows()
                    texts, names, size, serial = [], [], 0, serial + 1
                a = e
        if texts:
            yield from rows()

    return docs.select("doc_id", "text").mapInArrow(count, ROW)


def merged(blobs: list[dict], hot: np.ndarray) -> tuple[dict, dict]:
    """(counts of a part, its first state) from the rows of its blocks.

    Until the first pass seats the customers, each pair and each word of the parent has one table.
    """
    blobs = sorted(blobs, key=lambda x: x["block"])
    vocab, at = np.unique(np.concatenate([x["words"] for x in blobs]), return_inverse=True)
    word = np.repeat(at, np.concatenate([x["pairs"] for x in blobs]))
    rooms, room = np.unique(np.concatenate([x["rooms"] for x in blobs]), return_inverse=True)
    edges = np.cumsum([0, *(len(x["rooms"]) for x in blobs)])
    pair = word * len(rooms) + np.concatenate(
        [room[e:][x["ctx"]] for x, e in zip(blobs, edges)])
    pairs, at = np.unique(pair, return_inverse=True)
    c = np.bincount(at, weights=np.concatenate([x["train"] for x in blobs]),
                    minlength=len(pairs)).astype(np.int64)
    first = np.cumsum([0, *(len(x["ctx"]) for x in blobs)])
    entry = [np.repeat(at[a:b], x["entries"]) for x, a, b in zip(blobs, first, first[1:])]
    word, ctx = np.divmod(pairs, len(rooms))
    counts = dict(
        word=least_type(word), ctx=least_type(ctx), c=least_type(c), blocks=[x["block"] for x in blobs],
        step=[least_type(np.diff(e, prepend=0)) for e in entry], doc=[x["doc"] for x in blobs],
        count=[x["count"] for x in blobs])
    free = np.flatnonzero(c > 1)
    n = len(vocab)
    singles = np.bincount(word[c == 1], minlength=n)
    hot_no = np.full(n, -1)
    if len(hot):
        i = np.minimum(np.searchsorted(hot, vocab), len(hot) - 1)
        hot_no = np.where(hot[i] == vocab, i, -1)
    wanted = np.where(hot_no < 0, singles + np.bincount(word[free], minlength=n), 0)
    none = np.zeros(0, np.int64)
    return counts, dict(
        c_word=np.bincount(word, c, n).astype(np.int64), singles=singles, hot=hot_no,
        word=least_type(word[free]), ctx=least_type(ctx[free]), c=least_type(c[free]),
        pair=least_type(free), t=np.ones(len(free), np.uint8), owner=none, size=none,
        rooms=rooms, single_tables=least_type(np.bincount(ctx[c == 1], minlength=len(rooms))),
        room_tables=[], root_c=least_type(wanted), root_t=(wanted > 0).astype(np.uint8),
        root_large=none, root_owner=none, root_size=none, t_sum=np.zeros(len(free), np.uint8),
        samples=[])


def sums_of(state: dict) -> dict[int, int]:
    """What a part adds to the totals, by negative keys."""
    customers = state["singles"] + np.bincount(
        state["word"], state["t"], len(state["singles"])).astype(int)
    cold = state["hot"] < 0
    out = {}
    out[-1] = int(customers[cold].sum())
    out[-2] = int(state["root_t"].sum())
    out[-3] = int(state["c_word"].sum())
    out[-4] = int((state["c_word"][cold] > 0).sum())
    for i in np.flatnonzero(~cold):
        h = int(state["hot"][i])
        out[-10 - 2 * h] = int(customers[i])
        out[-11 - 2 * h] = int(state["c_word"][i])
    return out


def at_rooms(state: dict, of_pairs: np.ndarray) -> np.ndarray:
    """A part's sums by context of a number of its pairs (that of pairs seen once is one)."""
    n = len(state["rooms"])
    return state["single_tables"] + np.bincount(state["ctx"], of_pairs, n).astype(np.int64)


def bucketed(rooms: np.ndarray, buckets: int) -> list[np.ndarray]:
    """Indexes of the contexts of each bucket."""
    bucket = (mixed(rooms, 11) % np.uint64(buckets)).astype(np.min_scalar_type(buckets))
    order = np.argsort(bucket, kind="stable")
    return np.split(order, np.searchsorted(bucket[order], np.arange(1, buckets)))


def share_rooms(state: DataFrame, buckets: int, path: str, first: bool) -> None:
    """Tables of each context (at ``first`` also its customers) summed over parts, and written
    as a file for each part, of the contexts that the part has.

    Contexts are dealt to buckets by hash; a part sends a bucket one row, and gets one back.
    """
    def emit(batches):
        for b in batches:
            for k, blob in zip(b.column(0).to_pylist(), b.column(1)):
                s = unpacked(blob.as_py())
                values = [at_rooms(s, x) for x in ([s["t"], s["c"]] if first else [s["t"]])]
                for i, x in enumerate(bucketed(s["rooms"], buckets)):
                    yield rows_of([(i, k, packed(
                        rooms=s["rooms"][x], values=[least_type(v[x]) for v in values]))])

    def add(table: pa.Table) -> pa.Table:
        bucket, blobs = table.column("k")[0].as_py(), [
            unpacked(x.as_py()) for x in table.column("blob")]
        _, at = np.unique(np.concatenate([x["rooms"] for x in blobs]), return_inverse=True)
        sums = [np.bincount(at, np.concatenate(v)).astype(np.int64)
                for v in zip(*(x["values"] for x in blobs))]
        out, e = [], 0
        for k, x in zip(table.column("kind").to_pylist(), blobs):
            mine, e = at[e:e + len(x["rooms"])], e + len(x["rooms"])
            out.append((k, bucket, packed(values=[least_type(v[mine]) for v in sums])))
        return pa.Table.from_batches([rows_of(out)])

    def put(table: pa.Table) -> pa.Table:
        k = table.column("k")[0].as_py()
        values = {b: unpacked(x.as_py())["values"] for b, x in zip(
            table.column("kind").to_pylist(), table.column("blob"))}
        put_file(path.format(k), packed(values=values))
        return table.slice(0, 1)

    sums = state.select("k", "blob").mapInArrow(emit, ROW).groupBy("k").applyInArrow(add, ROW)
    with arrow_batches(state.sparkSession, 1000, BATCH_BYTES):
        sums.groupBy("k").applyInArrow(put, ROW).agg(F.sum("k")).first()


def shared_rooms(state: dict, buckets: int, path: str) -> list[np.ndarray]:
    """What ``share_rooms`` wrote for a part, in the order of its contexts."""
    values = read_file(path)["values"]
    out = [np.zeros(len(state["rooms"]), np.int64) for _ in values[0]]
    for i, x in enumerate(bucketed(state["rooms"], buckets)):
        for o, v in zip(out, values[i]):
            o[x] = v
    return out


def swept(state: dict, totals: dict, by_ctx: np.ndarray, first: bool, keep: bool, rng) -> dict:
    """One sweep of a part against the totals of the sweep before; the ``first`` seats all."""
    p = root_probability(state, totals)[state["word"]]
    c = state["c"].astype(np.int64)
    fresh = (STRENGTH + DISCOUNT * by_ctx[state["ctx"]]) * p
    t = drawn(np.where(c > DRAWN, 1, c), fresh, DISCOUNT, rng)
    large = np.flatnonzero(c > DRAWN)
    owner, size = state["owner"], state["size"]
    if first:
        owner, size = seated(c[large], fresh[large], DISCOUNT, rng, owner, size)
    else:
        owner, size = gibbs(owner, size, np.arange(len(large)), lambda: fresh[large], DISCOUNT, 1, rng)
    t[large] = np.bincount(owner, minlength=len(large))
    n = len(state["singles"])
    wanted = state["singles"] + np.bincount(state["word"], t, n).astype(np.int64)
    wanted = np.where(state["hot"] < 0, wanted, 0)
    # which of the parent's words are large stays as the first pass finds it
    r_large = np.flatnonzero(wanted > DRAWN) if first else state["root_large"]
    r_owner, r_size = root_sweep(state["root_owner"], state["root_size"], wanted[r_large], totals,
                                 ROOT_DISCOUNT, rng, first)
    few = wanted.copy()
    few[r_large] = 0
    fresh = (ROOT_STRENGTH + ROOT_DISCOUNT * totals["tables"]) * totals["base"]
    r_t = drawn(few, fresh, ROOT_DISCOUNT, rng)
    r_t[r_large] = np.bincount(r_owner, minlength=len(r_large))
    new = state | dict(
        t=least_type(t), owner=owner, size=least_type(size), root_c=least_type(wanted),
        root_t=least_type(r_t), root_large=r_large, root_owner=r_owner, root_size=least_type(r_size))
    if keep:
        new |= dict(t_sum=least_type(state["t_sum"].astype(np.int64) + t),
                    samples=[*state["samples"], (new["root_c"], new["root_t"])])
    return new


def _probability(customers, tables, totals):
    fresh = (ROOT_STRENGTH + ROOT_DISCOUNT * totals["tables"]) * totals["base"]
    return (customers - ROOT_DISCOUNT * tables + fresh) / (ROOT_STRENGTH + totals["customers"])


def root_probability(state: dict, totals: dict, sample=None) -> np.ndarray:
    """The parent's probability of each word of a part."""
    if sample is None:
        sample = state["root_c"], state["root_t"]
    p = _probability(sample[0].astype(float), sample[1].astype(float), totals)
    hot = np.flatnonzero(state["hot"] >= 0)
    p[hot] = totals["hot_p"][state["hot"][hot]]
    return p


# ---- the driver's part ----

def _frequent(docs: DataFrame, n_bytes: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of frequent words of a bounded sample and how many parts each is dealt over."""
    some = docs.select("text").sample(min(1.0, SAMPLE_BYTES / max(1, n_bytes)), seed=1)

    def count(batches):
        for b in batches:
            _, w, v = word_codes(b.column(0))
            n = np.bincount(w, minlength=len(v))
            total = n.sum()
            often = n * 4 * parts >= total
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.r_[v[often].view(np.int64), 0]), pa.array(np.r_[n[often], total])],
                names=["w", "n"])

    got = some.mapInArrow(count, "w bigint, n bigint").groupBy("w").agg(F.sum("n").alias("n"))
    total = got.filter("w = 0").first()
    if total is None or parts == 1 or not total["n"]:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    often = got.filter(f"w <> 0 and n * {2 * parts} >= {total['n']}").toPandas()  # 2 for each part
    w = often["w"].to_numpy(np.int64).view(np.uint64)
    width = np.ceil(often["n"].to_numpy() * 4 * parts / total["n"]).astype(np.int64)
    order = np.argsort(w)
    return w[order], np.minimum(width[order], parts)


def _totals(table: DataFrame, sums, hot: int) -> dict:
    """Sum what the parts add, a few numbers."""
    def emit(batches):
        total: dict[int, int] = {}
        for b in batches:
            for blob in b.column(0):
                for i, v in sums(unpacked(blob.as_py())).items():
                    total[i] = total.get(i, 0) + v
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())],
            names=["i", "v"])

    rows = (table.select("blob").mapInArrow(emit, "i bigint, v bigint")
            .groupBy("i").agg(F.sum("v").alias("v")).toPandas())
    got = dict(zip(rows["i"].tolist(), rows["v"].tolist()))
    return {"cold_customers": got.get(-1, 0), "cold_tables": got.get(-2, 0),
            "n": got.get(-3, 0), "cold_words": got.get(-4, 0),
            "hot_customers": np.array([got.get(-10 - 2 * h, 0) for h in range(hot)], np.int64),
            "hot_c": np.array([got.get(-11 - 2 * h, 0) for h in range(hot)], np.int64)}


def score_texts(docs: DataFrame, seed: int = 5) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of all texts."""
    spark = docs.sparkSession
    n_bytes = text_bytes(docs)
    parts = parts_for(n_bytes, PART_BYTES)
    hot, spread = _frequent(docs, n_bytes, parts)
    folder = as_uri(new_scratch_path(spark, "pitman-yor"))

    def dealt(table: DataFrame) -> DataFrame:
        """The rows of states, small as they are, each in a task of its own."""
        return table.filter("kind = 0").select("k", "blob").repartitionByRange(parts, "k")

    def merge(table: pa.Table) -> pa.Table:
        k, kind = table.column("k")[0].as_py(), table.column("kind")[0].as_py()
        if kind == 1:
            return table
        counts, state = merged([unpacked(x.as_py()) for x in table.column("blob")], hot)
        put_file(f"{folder}/{k:012d}.counts", packed(**counts))
        del counts
        give_back()
        place = placed(f"{folder}/seating0/{k:012d}", **state)
        return pa.Table.from_batches([rows_of([(k, 0, place)])])

    made = stored(counted(docs, parts, hot, spread).groupBy("k").applyInArrow(merge, ROW),
                  "seating", bytes_per_batch=BATCH_BYTES)
    blocks = made.filter("kind = 1")
    buckets = max(1, parts // PARTS_PER_BUCKET)

    hot_root: list[np.ndarray] | None = None
    table, state, kept = made, dealt(made), []
    totals = None
    passes = 1 + BURN_IN + SAMPLES  # the first one seats the customers
    for sweep in range(passes + 1):
        got = _totals(state, sums_of, len(hot))
        rooms = f"{folder}/{{:012d}}.rooms{sweep}"
        share_rooms(state, buckets, rooms, sweep == 0)
        rng = np.random.default_rng([seed, sweep])
        first = hot_root is None
        if first:
            on = np.flatnonzero(got["hot_customers"])
            hot_root = [on, got["hot_customers"][on]]
        base = 1.0 / (got["cold_words"] + int((got["hot_c"] > 0).sum()) + 1)
        before = totals or {"tables": got["cold_tables"] + len(hot_root[0]), "base": base}
        hot_root = list(root_sweep(*hot_root, got["hot_customers"], before, ROOT_DISCOUNT, rng,
                                   first))
        totals = {
            "base": base,
            "customers": got["cold_customers"] + int(got["hot_customers"].sum()),
            "tables": got["cold_tables"] + len(hot_root[0]), "n": got["n"]}
        h = np.bincount(hot_root[0], hot_root[1], len(hot)), np.bincount(
            hot_root[0], minlength=len(hot))
        totals |= {"hot_p": _probability(*h, totals), "hot_c": got["hot_c"]}
        if sweep > 1 + BURN_IN:
            kept.append(totals)
        if sweep == passes:
            break

        def step(batches, sweep=sweep, totals=totals, rooms=rooms):
            for b in batches:
                for k, blob in zip(b.column(0).to_pylist(), b.column(1)):
                    own = np.random.default_rng([seed, sweep, k])
                    s = unpacked(blob.as_py())
                    by_ctx, *more = shared_rooms(s, buckets, rooms.format(k))
                    if more:
                        s["room_customers"] = least_type(more[0])
                    if sweep > 1 + BURN_IN:  # those of the sample before
                        s["room_tables"] = [*s["room_tables"], least_type(by_ctx)]
                    s = swept(s, totals, by_ctx, sweep == 0, sweep > BURN_IN, own)
                    place = placed(f"{folder}/seating{sweep + 1}/{k:012d}", **s)
                    del s
                    give_back()
                    yield rows_of([(k, 0, place)])

        fresh = stored(state.mapInArrow(step, ROW), "seating", 1)
        if table is not made:
            release(table)
        delete_path(spark, f"{folder}/seating{sweep}")
        table, state = fresh, dealt(fresh)

    def score(batches):
        for b in batches:
            for k, blob in zip(b.column(0).to_pylist(), b.column(1)):
                s = unpacked(blob.as_py())
                s["room_tables"] = [
                    *s["room_tables"], shared_rooms(s, buckets, rooms.format(k))[0]]
                yield from scored(s, f"{folder}/{k:012d}.counts", kept)
                give_back()

    sums = state.mapInArrow(score, ROW)
    return _assembled(blocks, sums, parts, int(totals["n"]))


def scored(state: dict, path: str, kept: list[dict]):
    """Rows (block, 2, sums by text) of a part."""
    x = read_file(path)
    word, ctx, c = x["word"].astype(np.int64), x["ctx"], x["c"].astype(float)
    t = np.minimum(c, 1)
    t[state["pair"]] = state["t_sum"] / len(kept)
    room = STRENGTH + state["room_customers"].astype(float)
    p = (c - DISCOUNT * t) / room[ctx]
    for totals, sample, by_ctx in zip(kept, state["samples"], state["room_tables"]):
        root = root_probability(state, totals, sample)
        share = (STRENGTH + DISCOUNT * by_ctx) / room / len(kept)
        p += share[ctx] * root[word]
    p = np.log10(p)
    c_word = state["c_word"].copy()
    is_hot = state["hot"] >= 0
    c_word[is_hot] = kept[-1]["hot_c"][state["hot"][is_hot]]
    n, v1 = kept[-1]["n"], 1 / kept[-1]["base"]
    base = np.log10((c_word + 0.5) / (n + 0.5 * v1))[word]
    known = (c_word > 0)[word]
    for block, step, doc, count in zip(x["blocks"], x["step"], x["doc"], x["count"]):
        pair = np.cumsum(step.astype(np.int64))
        texts, at = np.unique(doc, return_inverse=True)
        yield rows_of([(block, 2, packed(
            texts=texts, score=np.bincount(at, p[pair] * count),
            base=np.bincount(at, base[pair] * count),
            known=np.bincount(at, known[pair] * count)))])


def _assembled(blocks: DataFrame, sums: DataFrame, parts: int, train_tokens: int) -> DataFrame:
    """Texts of each block with the sums of all parts."""
    def put(table: pa.Table) -> pa.Table:
        kinds = table.column("kind").to_pylist()
        blobs = [unpacked(x.as_py()) for x in table.column("blob")]
        texts = blobs[kinds.index(1)]
        total = np.zeros((3, len(texts["names"])))
        order = sorted((x["score"].sum(), i) for i, x in enumerate(blobs) if kinds[i] == 2)
        for _, i in order:  # in an order of their own, so that sums do not depend on arrival
            x = blobs[i]
            for row, field in zip(total, ("score", "base", "known")):
                row[x["texts"]] += x[field]
        return pa.table({
            "doc_id": pa.array(texts["names"], pa.int64()),
            "held_out": pa.array(~texts["train"]),
            "n_tokens": pa.array(texts["n"], pa.int64()),
            "n_known": pa.array(total[2].round().astype(np.int64)),
            "train_tokens": pa.array(np.full(len(texts["names"]), train_tokens, np.int64)),
            "base_score": pa.array(total[1]), "score": pa.array(total[0])})

    texts = blocks.select((F.col("k") - parts).alias("k"), "kind", "blob")
    return texts.unionByName(sums).groupBy("k").applyInArrow(
        put, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, "
             "train_tokens bigint, base_score double, score double")


def perplexity(scores: DataFrame, held: bool = True) -> float:
    """Per token, of the texts that were held out (or of those learnt from)."""
    r = scores.filter(F.col("held_out") == held).agg(
        F.sum("score").alias("s"), F.sum("n_tokens").alias("n")).first()
    return float(10 ** (-r["s"] / r["n"]))
