"""Quality rules: fixed rules, then a hashed n-gram likelihood ratio for every document.

Unigrams and bigrams of whole words are hashed into ``buckets``. Two multinomials
over buckets, of trusted documents and of the whole corpus, give each bucket a log
ratio; a document's score is the mean over its n-grams. The corpus counts have one
added to each bucket, and the trusted ones are smoothed towards the corpus, by ``prior``
times their own number. A document is kept if no fixed rule fails and its score is at
least a threshold. Scores of documents the model has not seen depend on how much it
has, so the threshold is measured: ratios of one half of the trusted documents score the
other half, and all but a share ``lost`` of those that meet the fixed rules lie above it.

The trusted documents are all of those labelled good; the corpus counts and the verdicts cover
every document. Only DataFrame operations: each text is read twice (of half the trusted
documents once more), counts are aggregated before the shuffle, and the ratios, one
number per bucket, are a literal of the last pass. No text is shuffled: the trusted ids are
broadcast in arrays, about 8 bytes each.

Nulls: a null text has no words and is not kept. Repeated rows are judged each. A
null doc_id is never trusted. Without trusted documents in both halves only
the fixed rules decide. An empty table gives no rows; other columns are kept
(``judge``), and columns that clash with the added ones, which the result names, are
replaced; columns with the names of intermediate ones stay.
"""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from adspark.llm._common import WORD, stored, unused
from adspark.sources.scratch import release

BUCKETS = 1 << 14
PRIOR = 0.1
#: Trusted ids in an array of the broadcast, on average.
IDS_A_ROW = 64
LOST = 0.002
LEAST_WORDS = 50
MOST_REPEATED = 50
SYMBOLS = r"[#*$%&|<>]"
#: Words whose positions fit in a long beside the 50 leading bits of a hash, which then tell windows apart.
PACKED_WORDS = 1 << 14


def _tail(a: Column) -> Column:
    """All but the first element (empty for an empty array)."""
    return F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0)))


def _once(value: Column, use) -> Column:
    """``use`` of a value that is evaluated once, however often ``use`` names it: functions with
    lambdas evaluate their arguments as they are written."""
    return F.get(F.transform(F.array(value), use), 0)


def word_hashes(ws: Column) -> Column:
    return F.transform(ws, lambda w: F.xxhash64(w))


def grams(hashed: Column, buckets: int) -> Column:
    """Bucket numbers of the unigrams and bigrams of hashed words (nulls to be left out)."""
    one = F.transform(hashed, lambda a: a.bitwiseAND(buckets - 1))
    two = F.zip_with(hashed, _tail(hashed), lambda a, b: F.when(
        b.isNotNull(), F.xxhash64(a, b).bitwiseAND(buckets - 1)))
    return F.concat(one, two)


def log_ratios(raw: np.ndarray, target: np.ndarray, prior: float = PRIOR) -> list[float]:
    """The log ratio of every bucket, from its counts in all and in trusted documents."""
    total, share = target.sum(), (raw + 1) / (raw + 1).sum()
    if not total:
        return [0.0] * len(raw)
    return np.log((target / total / share + prior) / (1 + prior)).tolist()


def _trusted(labels: DataFrame) -> DataFrame:
    """(_cell, _ids), written: the ids labelled good, by ``_cell_of`` their hash."""
    good = stored(labels.filter("quality = 1 and doc_id is not null").select("doc_id").distinct(),
                  "trusted")
    cells = max(1, good.count() // IDS_A_ROW)
    out = stored(good.groupBy(_cell_of(cells).alias("_cell")).agg(
        F.collect_list("doc_id").alias("_ids"), F.lit(cells).alias("_cells")), "trusted-ids")
    release(good)
    return out


def _cell_of(cells: int) -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(cells))


def _halved(docs: DataFrame, trusted: DataFrame, cells: int) -> DataFrame:
    """doc_id, text and ``_half``: which half of the trusted documents, null for others."""
    rows = docs.select("doc_id", "text").join(
        F.broadcast(trusted.select("_cell", "_ids")), _cell_of(cells) == F.col("_cell"), "left")
    return rows.select("doc_id", "text", F.when(
        F.array_contains("_ids", F.col("doc_id")),
        F.xxhash64("doc_id").bitwiseAND(1)).alias("_half"))


def _quantile(scores: DataFrame, share: float) -> float | None:
    """The quantile of the column ``s`` as ``percentile`` has it, from the lowest rows alone."""
    n = scores.count()
    if not n:
        return None
    at = (n - 1) * share
    below = int(at)
    ends = [r["s"] for r in scores.select("s").orderBy("s").limit(below + 2).orderBy(
        F.desc("s")).limit(2).collect()]
    if at == below or ends[0] == ends[-1]:
        return ends[0] if n < below + 2 else ends[-1]
    return (below + 1 - at) * ends[1] + (at - below) * ends[0]


def fitted(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, prior: float = PRIOR,
           lost: float = LOST) -> tuple[list[float], float]:
    """Log ratios of the buckets and the threshold.

    The threshold is the score under which a share ``lost`` of one half of the trusted
    documents lies, by the ratios that the other half gives.
    """
    trusted = _trusted(labels)
    cells = trusted.select("_cells").first()
    rows = _halved(docs, trusted, cells["_cells"] if cells else 1)
    words = F.regexp_extract_all(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD), F.lit(0))
    counted = (rows.select("_half", word_hashes(words).alias("h"))
               .select("_half", F.explode(grams(F.col("h"), buckets)).alias("bucket"))
               .filter(F.col("bucket").isNotNull())
               .groupBy("bucket").agg(F.count("*").alias("n"),
                                      F.count_if(F.col("_half") == 0).alias("first"),
                                      F.count_if(F.col("_half") == 1).alias("second"))
               .collect())  # a row per bucket
    raw, first, second = np.zeros(buckets), np.zeros(buckets), np.zeros(buckets)
    for r in counted:
        raw[r["bucket"]], first[r["bucket"]], second[r["bucket"]] = r["n"], r["first"], r["second"]
    held = judge(rows.filter("_half = 1").select("doc_id", "text"),
                 log_ratios(raw, first, prior), 0.0)
    # written: a filter on a verdict would be evaluated below it, with all its expressions
    held = stored(held.select("doc_id", "base_failed", "score"), "held-out")
    scores = stored(held.filter(~F.col("base_failed")).groupBy("doc_id").agg(
        F.min("score").alias("s")), "held-scores")
    lowest = _quantile(scores, lost)
    for table in (trusted, held, scores):
        release(table)
    return (log_ratios(raw, first + second, prior),
            -math.inf if lowest is None or not first.any() else lowest)


def _covered(starts: Column) -> Column:
    """Words in 3-word windows that begin at the sorted distinct ``starts``."""
    steps = _once(starts, lambda at: F.zip_with(
        at, _tail(at), lambda a, b: F.least(F.lit(3), b - a)))
    return F.aggregate(steps, F.lit(0).cast("bigint"), lambda acc, x: acc + x)


def _starts(keys: Column, same, place) -> Column:
    """Sorted distinct places of sorted keys that equal a neighbour."""
    pairs = _once(keys, lambda ks: F.zip_with(ks, _tail(ks), lambda a, b: F.when(
        same(a, b), F.array(place(a), place(b)))))
    return F.sort_array(F.array_distinct(F.flatten(F.array_compact(pairs))))


def repeat_words(windows: Column, n_words: Column) -> Column:
    """Words in windows found twice or more; ``windows`` are their hashes in order.

    Only texts with equal windows sort them with their places: in one long, or,
    for long texts, as structs.
    """
    mask = PACKED_WORDS - 1
    packed = F.sort_array(F.transform(
        windows, lambda x, i: x.bitwiseAND(~mask).bitwiseOR(i.cast("bigint"))))
    short = _starts(packed, lambda a, b: F.shiftrightunsigned(a.bitwiseXOR(b), 14) == 0,
                    lambda a: a.bitwiseAND(mask))
    wide = F.sort_array(F.transform(
        windows, lambda x, i: F.struct(x.alias("h"), i.cast("bigint").alias("i"))))
    long = _starts(wide, lambda a, b: a["h"] == b["h"], lambda a: a["i"])
    none = F.size(F.array_distinct(windows)) == F.size(windows)
    return (F.when(none, F.lit(0).cast("bigint"))
            .when(n_words <= PACKED_WORDS, _covered(short)).otherwise(_covered(long)))


def judge(docs: DataFrame, ratios: list[float], threshold: float) -> DataFrame:
    """The documents with the counts, ``base_failed``, ``score`` and ``kept``."""
    buckets = len(ratios)
    table = F.from_json(F.lit(json.dumps(ratios)), "array<double>")
    text = F.coalesce(F.col("text"), F.lit(""))
    found, hashes, pairs, windows, lines, total = (
        unused(f"_{x}", docs.columns)
        for x in ("found", "hashes", "pairs", "windows", "lines", "total"))
    rows = docs.withColumn(found, F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))
    rows = rows.withColumns({
        "n_words": F.size(found).cast("bigint"),
        "word_chars": F.length(F.array_join(found, "")).cast("bigint"),
        "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("bigint"),
        hashes: word_hashes(F.col(found)),
        lines: F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)),
    })
    rows = rows.withColumn(pairs, F.zip_with(  # the last one is no pair
        hashes, _tail(F.col(hashes)), lambda a, b: F.xxhash64(a, b)))
    n = F.col("n_words").cast("int")
    two = F.slice(pairs, 1, F.greatest(n - 1, F.lit(0)))
    three = F.zip_with(pairs, _tail(_tail(F.col(hashes))), lambda ab, c: F.when(
        c.isNotNull(), F.xxhash64(ab, c)))
    ratio = F.zip_with(hashes, two, lambda a, ab: (
        F.get(table, a.bitwiseAND(buckets - 1).cast("int"))
        + F.when(ab.isNull(), 0.0).otherwise(
            F.get(table, ab.bitwiseAND(buckets - 1).cast("int")))))
    rows = rows.withColumns({
        windows: F.slice(three, 1, F.greatest(n - 2, F.lit(0))),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint"),
        total: F.aggregate(ratio, F.lit(0.0), lambda acc, x: acc + x),
    })
    rows = rows.withColumn("n_repeat_words", repeat_words(F.col(windows), F.col("n_words")))
    n_grams = F.greatest(2 * F.col("n_words") - 1, F.lit(1))
    failed = (F.col("n_words") < LEAST_WORDS) | (
        100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed).withColumn("score", F.col(total) / n_grams)
    rows = rows.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
    return rows.drop(found, hashes, pairs, windows, lines, total)


def quality(docs: DataFrame, labels: DataFrame, threshold: float | None = None,
            buckets: int = BUCKETS, prior: float = PRIOR, lost: float = LOST) -> DataFrame:
    """``judge`` with ratios and, unless given, the threshold fitted on the documents themselves."""
    ratios, least = fitted(docs, labels, buckets, prior, lost)
    return judge(docs, ratios, least if threshold is None else threshold)
