"""Ranked lexical search of many queries at once, sharing what they have in common.

A document's score for an item is a sum over the item's terms, so items that share terms
share parts of their sums. Sets of terms that recur among the items of a block are mined:
terms that occur in exactly the same items are one set, then the pair of sets that most
items hold together becomes a new set, again and again, until no pair is left in two items.
The sets form a graph: each is the sum of the sets it is made of, and an item
is the sum of its last ones. For a block of documents every set's
accumulator, one number per document, is computed once from its parts, and the items'
scores follow along the graph. Each task keeps the k best documents of each item; these
lists are merged up a tree of fixed fan-in.

Texts are read once: what is stored of a document is its length and, for the terms that
any item has, the term's number and count. Document frequencies come from these.
Items are taken in rounds of at most ``ROUND_BYTES`` of text, which bounds what is
mined at once and what travels to the tasks; the number of rounds grows
with the items alone.

Skew: documents stay where they are read and no rows are dealt by term, so frequent
terms cost what any other column of a block costs.

Nulls: a null text has no terms; such items rank nothing. Every row is a document, and
every row of the items an item, also if it repeats an id. Equal scores go by doc_id,
null last; rows that repeat a doc_id with the same score come in any order. Empty tables
give no rows; other columns are left out.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.taskcontext import TaskContext

from adspark.llm._common import byte_texts, parts_for, stored, text_bytes
from adspark.sources.scratch import release

#: Text of the items of a round, and items whose shared sets are mined together.
ROUND_BYTES = 8 << 20
BLOCK_ITEMS = 256
#: Sets of one item among which pairs are looked for at a time; sums take all of them.
MINED = 256
FAN_IN = 8
#: Numbers of a block of documents: its columns times its documents.
BLOCK_CELLS = 4_000_000
#: ASCII without digits and letters becomes a space, A-Z lower case.
PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32
              for c in range(256))
POSTINGS = "doc_id bigint, n bigint, terms binary, counts binary"


def terms(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and digits and of anything beyond ASCII, A-Z lower-cased."""
    return text.translate(PLAIN).split()


# ---- sharing among items ----

def mined(items: list[list[int]], n_terms: int) -> tuple[list[list[int]], list[list[int]]]:
    """(sets, sums): parts of each new set, and of each item.

    Columns 0 to n_terms - 1 are terms; set i is column n_terms + i. A set is
    made of columns before it. Every item's parts together are its terms, each once.
    """
    where = defaultdict(list)
    for i, ts in enumerate(items):
        for t in sorted(set(ts)):
            where[t].append(i)
    alike = defaultdict(list)
    for t in sorted(where):
        alike[tuple(where[t])].append(t)
    sets: list[list[int]] = []
    sums: list[set[int]] = [set() for _ in items]
    for at, ts in alike.items():
        if len(ts) > 1 and len(at) > 1:
            sets.append(ts)
            ts = [n_terms + len(sets) - 1]
        for i in at:
            sums[i].update(ts)

    shared = Counter(c for s in sums for c in s)
    pairs: Counter = Counter()

    def mates(i: int, c: int) -> list[int]:
        """Columns of the item that are paired with this one: its run of MINED columns."""
        return [x for x in runs[i][place[i, c]] if x != c and x in sums[i]]

    runs: list[list[list[int]]] = []
    place: dict[tuple[int, int], int] = {}
    for i, s in enumerate(sums):
        known = sorted(c for c in s if shared[c] > 1)
        runs.append([known[a:a + MINED] for a in range(0, len(known), MINED)])
        for r, run in enumerate(runs[i]):
            for j, a in enumerate(run):
                place[i, a] = r
                pairs.update((a, b) for b in run[j + 1:])
    heap = [(-n, p) for p, n in pairs.items() if n > 1]
    heapq.heapify(heap)
    holders = defaultdict(set)
    for i, s in enumerate(sums):
        for c in s:
            holders[c].add(i)
    while heap:
        n, (a, b) = heapq.heappop(heap)
        if pairs[a, b] != -n:  # changed since: it was put back with its count
            continue
        at = sorted(i for i in holders[a] & holders[b]
                    if place.get((i, a)) is not None and place.get((i, a)) == place.get((i, b)))
        new = n_terms + len(sets)
        sets.append([a, b])
        touched = set()
        for i in at:
            for c in (a, b):
                for x in mates(i, c):
                    p = (min(x, c), max(x, c))
                    pairs[p] -= 1
                    touched.add(p)
                sums[i].discard(c)
                holders[c].discard(i)
            sums[i].add(new)
            holders[new].add(i)
            r = place[i, new] = place[i, a]
            runs[i][r] = [x for x in runs[i][r] if x in sums[i]] + [new]
            for x in mates(i, new):
                p = (x, new)
                pairs[p] += 1
                touched.add(p)
        for p in touched:
            if pairs[p] > 1:
                heapq.heappush(heap, (-pairs[p], p))
            elif not pairs[p]:
                del pairs[p]
    return sets, [sorted(s) for s in sums]


def _plans(items: DataFrame) -> DataFrame:
    """One row per block of items: terms, the items' ids, and the parts of sets and items."""
    def plan(t: pa.Table) -> pa.Table:
        words = [sorted(set(terms(x or b""))) for x in t.column("text").cast(pa.binary()).to_pylist()]
        known = sorted({w for ws in words for w in ws})
        number = {w: i for i, w in enumerate(known)}
        sets, sums = mined([[number[w] for w in ws] for ws in words], len(known))
        lists = pa.list_(pa.list_(pa.int32()))
        return pa.table({
            "terms": pa.array([known], pa.list_(pa.binary())),
            "nos": pa.array([t.column("no").to_pylist()], pa.list_(pa.int64())),
            "sets": pa.array([sets], lists), "sums": pa.array([sums], lists)})

    return items.groupBy("block").applyInArrow(
        plan, "terms array<binary>, nos array<bigint>, sets array<array<int>>, "
        "sums array<array<int>>")


# ---- documents ----

def postings(docs: DataFrame, number: dict[bytes, int]) -> DataFrame:
    """doc_id, length in terms, numbers and counts of the items' terms, of documents with terms."""
    def read(batches):
        for b in batches:
            ids = b.column(b.schema.get_field_index("doc_id"))
            at, sizes, which, counts = [], [], [], []
            for i, text in enumerate(byte_texts(b)):
                found = terms(text)
                if not found:
                    continue
                tally = Counter(found)
                hits = tally.keys() & number.keys()
                at.append(i)
                sizes.append(len(found))
                which.append(np.fromiter((number[w] for w in hits), np.int32, len(hits)).tobytes())
                counts.append(np.fromiter((tally[w] for w in hits), np.int64, len(hits)).tobytes())
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(at, pa.int64())), pa.array(sizes, pa.int64()),
                 pa.array(which, pa.binary()), pa.array(counts, pa.binary())],
                names=["doc_id", "n", "terms", "counts"])

    return stored(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        read, POSTINGS), "postings")


def document_frequencies(found: DataFrame, n_terms: int) -> np.ndarray:
    """Documents that hold each of the terms; one list of counts per task, then their sum."""
    def count(batches):
        out = np.zeros(n_terms, np.int64)
        for b in batches:
            for raw in b.column(0).to_pylist():
                out[np.frombuffer(raw, np.int32)] += 1
        held = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(out[held])], names=["t", "df"])

    rows = found.select("terms").mapInArrow(count, "t bigint, df bigint").groupBy("t").agg(
        F.sum("df").alias("df"))
    out = np.zeros(n_terms, np.int64)
    for r in rows.toLocalIterator():
        out[r["t"]] = r["df"]
    return out


def term_weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    """floor(1000 ln((2 N + 2) / (2 df + 1)))."""
    top = float(2 * n_docs + 2)
    return np.array([math.floor(1000 * math.log(top / float(2 * d + 1))) for d in df.tolist()],
                    np.int64)


class BestLists:
    """The k best documents of each item that a task has seen so far."""

    def __init__(self, n_items: int, k: int):
        self.n, self.k = n_items, k
        self.item = self.score = self.id = np.zeros(0, np.int64)
        self.null = np.zeros(0, bool)
        self.edge = np.ones(n_items, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        """Scores of (item, document); those under an item's k-th best cannot enter."""
        if scores.shape[1] > self.k:
            cut = scores.shape[1] - self.k
            own = np.maximum(self.edge, np.partition(scores, cut, axis=1)[:, cut])
        else:
            own = self.edge
        item, at = np.nonzero(scores >= own[:, None])
        if not len(item):
            return
        score, doc, none = (np.r_[a, b] for a, b in (
            (self.score, scores[item, at]), (self.id, ids[at]), (self.null, null[at])))
        item = np.r_[self.item, item]
        order = np.lexsort((doc, none, -score, item))
        place = np.arange(len(item)) - np.searchsorted(item[order], item[order])
        order = order[place < self.k]
        self.item, self.score, self.id, self.null = (
            x[order] for x in (item, score, doc, none))
        full = np.bincount(self.item, minlength=self.n) == self.k
        last = np.searchsorted(self.item, np.arange(self.n), side="right") - 1
        self.edge = np.where(full, self.score[np.maximum(last, 0)], 1)


def item_scores(base: np.ndarray, sets: list, sums: list) -> np.ndarray:
    """Scores of (item, document) from the terms' shares: each set is added up once."""
    cells = np.zeros((len(base) + len(sets), base.shape[1]), np.int64)
    cells[:len(base)] = base
    for i, parts in enumerate(sets, len(base)):
        if len(parts) == 2:
            np.add(cells[parts[0]], cells[parts[1]], out=cells[i])
        else:
            cells[parts].sum(axis=0, out=cells[i])
    out = np.zeros((len(sums), base.shape[1]), np.int64)
    for i, parts in enumerate(sums):
        if len(parts):
            cells[parts].sum(axis=0, out=out[i])
    return out


def best_of_tasks(found: DataFrame, plans: list, weights: np.ndarray, n_docs: int, n_terms: int,
                  k: int) -> DataFrame:
    """no, node, score, doc_id: each task's k best documents of each item."""
    n_all = sum(len(p["nos"]) for p in plans)
    nos = np.concatenate([np.array(p["nos"], np.int64) for p in plans])
    total_terms = max(1, n_terms)

    def score(batches):
        best = BestLists(n_all, k)
        for b in batches:
            which = [np.frombuffer(x, np.int32) for x in b.column(2).to_pylist()]
            counts = [np.frombuffer(x, np.int64) for x in b.column(3).to_pylist()]
            size = np.asarray(b.column(1))
            ids = b.column(0)
            null = np.asarray(ids.is_null())
            ids = np.asarray(ids.fill_null(0))
            width = max(len(p["number"]) + len(p["sets"]) + len(p["sums"]) for p in plans)
            step = max(1, BLOCK_CELLS // max(1, width))
            for at in range(0, len(size), step):
                part = slice(at, at + step)
                n = np.array([len(x) for x in which[part]])
                doc = np.repeat(np.arange(len(n)), n)
                t = np.concatenate(which[part])
                tf = np.concatenate(counts[part])
                m = 10 + (90 * size[part] * n_docs) // total_terms
                share = weights[t] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
                rows = []
                for p in plans:
                    base = np.zeros((len(p["number"]), len(n)), np.int64)
                    own = p["column"][t]
                    held = own >= 0
                    base[own[held], doc[held]] = share[held]
                    rows.append(item_scores(base, p["sets"], p["sums"]))
                best.add(np.concatenate(rows), ids[part], null[part])
        node = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays(
            [pa.array(nos[best.item]), pa.array(np.full(len(best.item), node, np.int64)),
             pa.array(best.score), pa.array(best.id, mask=best.null)],
            names=["no", "node", "score", "doc_id"])

    return stored(found.mapInArrow(score, "no bigint, node bigint, score bigint, doc_id bigint"),
                  "task-best")


def _before(x: Column, y: Column) -> Column:
    """Higher scores first, then smaller ids, null last."""
    a, b = x["doc_id"], y["doc_id"]
    return (F.when(x["score"] > y["score"], -1).when(x["score"] < y["score"], 1)
            .when(a.isNull() & b.isNull(), 0).when(a.isNull(), 1).when(b.isNull(), -1)
            .when(a < b, -1).when(a > b, 1).otherwise(0))


def merged(found: DataFrame, k: int) -> DataFrame:
    """no, top: the k best of each item, from the lists of tasks up a tree."""
    width = (found.agg(F.max("node")).first()[0] or 0) + 1
    lists = found.groupBy("no", "node").agg(F.collect_list(F.struct("score", "doc_id")).alias("top"))
    while True:
        width = -(-width // FAN_IN)
        lists = lists.groupBy("no", F.floor(F.col("node") / FAN_IN).alias("node")).agg(
            F.slice(F.array_sort(F.flatten(F.collect_list("top")), _before), 1, k).alias("top"))
        if width == 1:
            return lists


def ranked(docs: DataFrame, items: DataFrame, k: int = 10, block_items: int = BLOCK_ITEMS,
           round_bytes: int = ROUND_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score of each item's k documents of highest score above 0."""
    spark: SparkSession = docs.sparkSession
    asked = stored(items.select("item_id", "text", F.monotonically_increasing_id().alias("no")),
                   "items")
    rounds = parts_for(text_bytes(asked), round_bytes)
    found = None
    for r in range(rounds):
        mine = asked.filter(F.pmod(F.xxhash64("no", F.lit(7)), F.lit(rounds)) == r)
        best = _round(docs, mine, k, block_items)
        if best is not None:
            found = best if found is None else found.unionByName(best)
    if found is None:
        found = spark.createDataFrame([], "no bigint, score bigint, doc_id bigint, rank int")
    return found.join(F.broadcast(asked.select("no", "item_id")) if rounds == 1 else asked.select(
        "no", "item_id"), "no").select("item_id", "rank", "doc_id", "score")


def _round(docs: DataFrame, items: DataFrame, k: int, block_items: int) -> DataFrame | None:
    """no, rank, doc_id, score for the items of one round."""
    blocks = parts_for(items.count(), block_items)
    placed = items.withColumn("block", F.pmod(F.xxhash64("no"), F.lit(blocks)))
    plans = [r.asDict() for r in _plans(placed).collect()]  # bounded by the text of a round
    known = sorted({bytes(w) for p in plans for w in p["terms"]})
    if not known:
        return None
    number = {w: i for i, w in enumerate(known)}
    for p in plans:
        p["number"] = np.array([number[bytes(w)] for w in p.pop("terms")], np.int64)
        p["column"] = np.full(len(known), -1)
        p["column"][p["number"]] = np.arange(len(p["number"]))
    texts = postings(docs, number)
    n_docs, n_terms = texts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    weights = term_weights(document_frequencies(texts, len(known)), n_docs)
    lists = best_of_tasks(texts, plans, weights, n_docs, n_terms, k)
    release(texts)
    top = stored(merged(lists, k), "item-best")
    release(lists)
    return top.select("no", F.posexplode("top").alias("at", "hit")).select(
        "no", (F.col("at") + 1).alias("rank"), "hit.doc_id", "hit.score")
