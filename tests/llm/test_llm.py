"""Operators of the training-data package on small tables: against brute force, round
trips, nulls, ties, empty tables and columns with clashing names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import Window, functions as F
from tokenizers import Tokenizer

from adspark.llm import (
    chat, components, idfile, jaccard, lines, mixing, packing, pitman_yor, quality, tiles, tokens,
    topk, warc,
)
from adspark.llm.files import as_uri

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOC = "doc_id bigint, text string, source string, n bigint, size bigint, taken bigint, class string"
LONG = "lorem ipsum dolor " * 40_000


def words(text, lower=False):
    raw = (text or "").encode()
    return [w.decode() for w in (raw.lower() if lower else raw).split()]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeats, white space, and clashing columns."""
    texts = [
        None, "", "   \n\t ", "one", "two words", "Gamma delta epsilon zeta eta theta", LONG,
        "a line that is long enough to count here\nshort\na line that is long enough to count herE",
        "a line that is long enough to count here\nanother line that stays as it is, surely",
        "tabs\tand\r\nreturns \x0b\x0c end", "é ñ ß 日本語 ½   nbsp <|endoftext|>",
        " ".join(f"w{i % 7}" for i in range(200)), " ".join(f"v{i}" for i in range(300)),
        " ".join(f"v{i}" for i in range(299)) + " changed",
    ]
    rows = [(i, t, "s1" if i % 3 else None, 1, 2, 3, "x") for i, t in enumerate(texts)]
    rows += [(50, texts[12], "s2", 1, 2, 3, "y"), (None, "no id here", None, 0, 0, 0, None)]
    return spark.createDataFrame(rows, DOC).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


# ---- helpers ----

def test_components_match_union_find(spark):
    rng = random.Random(3)
    links = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)]
    links += [(i, i + 1) for i in range(200, 260)] + [(500, 500)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r["id"]: r["root"] for r in components.components(
        spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in root}


# ---- 1 ----

def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def changed(rng, text, n):
    s = list(text)
    for _ in range(n):
        i = rng.randint(0, len(s))
        kind = rng.randint(0, 2)
        if kind == 0 or i == len(s):
            s.insert(i, rng.choice("abé"))
        elif kind == 1:
            s.pop(i)
        else:
            s[i] = rng.choice("ab")
    return "".join(s)


@pytest.mark.parametrize("distance", [1, 2, 3])
def test_band_is_the_edit_distance(distance):
    rng = random.Random(distance)
    for _ in range(150):
        a = "".join(rng.choice("ab") for _ in range(rng.randint(0, 14)))
        others = [changed(rng, a, rng.randint(0, 5)) for _ in range(10)]
        points, size = lines._matrix([x.encode() for x in others])
        got = lines.within(np.frombuffer(a.encode("utf-32-le"), np.uint32), points, size, distance)
        assert got.tolist() == [edits(a, x) <= distance for x in others]


@pytest.mark.parametrize("distance", [1, 2, 3])
def test_probes_find_every_line_within_the_distance(distance):
    rng = random.Random(9 + distance)
    for _ in range(400):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(2 * distance + 1, 24)))
        b = changed(rng, a, distance)
        short, long = sorted((a, b), key=len)
        if len(short) <= distance:
            continue
        entries = {(len(short), i, short[s:s + n])
                   for i, (s, n) in enumerate(lines.segments(len(short), distance))}
        asked = {(k, i, long[s:s + n]) for k, i, s, n in lines.probes(len(long), distance)}
        assert entries & asked


def brute_lines(docs, distance, least):
    seen = defaultdict(list)
    for i in sorted(docs, key=lambda x: (x is not None, x or 0)):
        for no, raw in enumerate((docs[i] or "").split("\n") if docs[i] is not None else []):
            s = raw.strip(" \t\n\x0b\x0c\r")
            if len(s) >= least:
                seen[s].append(((i is not None, i or 0), no, i))
    names, root = list(seen), {}
    for x in names:
        root[x] = x

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, x in enumerate(names):
        for y in names[:n]:
            if abs(len(x) - len(y)) <= distance and len(x) < 1000 and edits(x, y) <= distance:
                root[find(x)] = find(y)
    first = {}
    for x in names:
        r = find(x)
        first[r] = min(first.get(r, seen[x][0]), seen[x][0])
    out = {}
    for i, text in docs.items():
        if text is None:
            out[i] = (None, 0)
            continue
        keep = []
        for no, raw in enumerate(text.split("\n")):
            s = raw.strip(" \t\n\x0b\x0c\r")
            if s not in seen or first[find(s)][1:] == (no, i):
                keep.append(raw)
        out[i] = ("\n".join(keep), text.count("\n") + 1 - len(keep))
    return out


def test_line_dedup_matches_brute_force(spark, odd, none):
    rng = random.Random(4)
    base = ["".join(rng.choice("abcdef ") for _ in range(rng.randint(24, 40))) for _ in range(12)]
    docs = {i: "\n".join(changed(rng, rng.choice(base), rng.randint(0, 2)) for _ in range(5))
            for i in range(40)}
    got = lines.dedup_lines(spark.createDataFrame(list(docs.items()), "doc_id bigint, text string"))
    rows = {r["doc_id"]: (r["text"], r["n_removed"]) for r in got.collect()}
    assert rows == brute_lines(docs, 2, 24)

    texts = {r["doc_id"]: r["text"] for r in odd.collect()}
    got = {r["doc_id"]: r for r in lines.dedup_lines(odd).collect()}
    assert {i: (r["text"], r["n_removed"]) for i, r in got.items()} == brute_lines(texts, 2, 24)
    assert got[5]["class"] == "x" and got[0]["n_lines"] == 0
    assert lines.dedup_lines(none).count() == 0


def test_lines_of_rows_that_share_an_id_or_have_none(spark):
    """Every row is a document: compared with the brute-force version over row numbers."""
    rng = random.Random(11)
    base = ["".join(rng.choice("abcdef ") for _ in range(30)) for _ in range(8)]
    own = lambda: "".join(rng.choice("uvwxyz") for _ in range(30))
    rows = [(1, base[0]), (7, base[0]), (7, "some wholly different and unique line of words"),
            (None, base[1] + "\n" + own()), (None, own() + "\n" + base[1]), (None, None), (7, "")]
    for _ in range(60):
        text = "\n".join(changed(rng, rng.choice(base), rng.randint(0, 1)) if rng.random() < .5
                         else own() for _ in range(4))
        rows.append((rng.choice([None, 7, 7, 8, rng.randrange(20, 90)]), text))
    rows.append((50, rows[-1][1] + "\n" + own()))
    table = spark.createDataFrame([(i, t, n, "g", "l") for n, (i, t) in enumerate(rows)], (
        "doc_id bigint, text string, n int, gone string, leaving string"))
    got = lines.dedup_lines(table.repartition(4))
    assert got.columns == table.columns + ["n_lines", "n_removed", "kept_in"]
    got = {r["n"]: r for r in got.collect()}
    assert len(got) == len(rows) and got[0]["gone"] == "g" and got[0]["leaving"] == "l"
    # which of several rows with one id and place keeps a line is open, so lines are counted
    strip = lambda t: [x.strip() for x in (t or "").split("\n")]
    classes = {}
    lines_all = sorted({x for _, t in rows for x in strip(t) if len(x) >= 24})
    for x in lines_all:
        classes[x] = x
    find = lambda x: x if classes[x] == x else find(classes[x])
    for i, x in enumerate(lines_all):
        for y in lines_all[:i]:
            if abs(len(x) - len(y)) <= 2 and edits(x, y) <= 2:
                classes[find(x)] = find(y)
    key = lambda i, no: (i is not None, i or 0, no)
    first, held = {}, Counter()
    for i, t in rows:
        for no, x in enumerate(strip(t)):
            if len(x) >= 24:
                first[find(x)] = min(first.get(find(x), key(i, no)), key(i, no))
    for n, r in got.items():
        i, t = rows[n]
        assert r["n_removed"] == (0 if t is None else t.count("\n") + 1 - (
            r["text"].count("\n") + 1 if r["text"] or not r["n_removed"] else 0)), r
        no = 0
        for x in strip(r["text"]):
            if len(x) >= 24:
                held[find(x)] += 1
                at = [j for j, y in enumerate(strip(t)) if y == x]
                assert first[find(x)] in [key(i, j) for j in at]
    assert set(held) == {find(x) for x in lines_all} and max(held.values()) == 1


def test_operators_leave_one_table(spark, odd):
    from adspark.llm._common import settled
    from adspark.sources.scratch import path_exists, scratch_root

    def tables():
        root = f"{scratch_root(spark)}/adspark"
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        return len(fs.listStatus(path)) if path_exists(spark, root) else 0

    before = tables()
    for work in (lines.dedup_lines, lambda d: jaccard.jaccard_components(d, 3, 9, 10)):
        out = settled(spark, lambda: work(odd), "one")
        assert out.count() == odd.count()
        assert tables() == before + 1
        before += 1
    before = tables()
    lines.dedup_lines(odd).count()
    assert tables() <= before + 4
    before = tables()
    jaccard.jaccard_components(odd, 3, 9, 10).count()
    assert tables() <= before + 3


def test_short_lines_leave_where_they_repeat_exactly(spark):
    texts = ["All rights reserved.\nHome\n\nx\n\nHome", " All rights reserved. \nHome!\n", "x\n\ny"]
    got = lines.dedup_lines(
        spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    assert {r["doc_id"]: (r["text"], r["n_removed"], r["kept_in"]) for r in got} == {
        0: ("All rights reserved.\nHome\n\nx\n", 1, [0]), 1: ("Home!\n", 1, [0]),
        2: ("\ny", 1, [0])}


def test_lines_of_a_busy_entry_are_linked_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(lines, "BLOCK_CHARS", 300)
    rng = random.Random(5)
    head = "the same first third of every line, "
    docs = {i: head + "".join(rng.choice("xyz") for _ in range(6)) + " and the same end of it"
            for i in range(60)}
    got = lines.dedup_lines(spark.createDataFrame(list(docs.items()), "doc_id bigint, text string"))
    assert {r["doc_id"]: (r["text"], r["n_removed"]) for r in got.collect()} == brute_lines(
        docs, 2, 24)


def test_lines_of_small_entries_are_compared_in_pairs(spark, monkeypatch):
    calls, tiled = [], lines.tiled_links
    monkeypatch.setattr(lines, "tiled_links", lambda *a: calls.append(1) or tiled(*a))
    rng = random.Random(8)

    def texts(n):
        head = "a first third that all of them have, "
        return {i: head + "".join(rng.choice("xyz") for _ in range(7)) + " and the end of it \u20ac"
                + "long " * (60 * (i % 5 == 0)) for i in range(n)}

    for n, tiles_made in ((20, 0), (45, 2)):
        docs = texts(n)
        calls.clear()
        got = lines.dedup_lines(spark.createDataFrame(list(docs.items()), "doc_id bigint, text string"))
        assert {r["doc_id"]: (r["text"], r["n_removed"]) for r in got.collect()} == brute_lines(
            docs, 2, 24)
        assert len(calls) == tiles_made


@pytest.mark.parametrize("distance", [1, 2, 3])
def test_edits_of_many_pairs_at_once(distance):
    rng = random.Random(distance)
    pairs = []
    for _ in range(400):
        a = [rng.choice("abcd\u20ac") for _ in range(rng.randrange(7, 40))]
        b = list(a)
        for _ in range(rng.randrange(distance + 2)):
            i = rng.randrange(len(b))
            b[i:i + rng.randrange(2)] = rng.choice(["", "a", "d"])
        pairs.append(("".join(a).encode(), "".join(b).encode()))
    (x, n), (y, m) = (lines._matrix([p[i] for p in pairs]) for i in (0, 1))
    got = lines.pairs_within(x, n, y, m, distance)
    one_by_one = [lines.within(x[i, :n[i]], y[i:i + 1], m[i:i + 1], distance)[0]
                  for i in range(len(pairs))]
    assert got.tolist() == one_by_one and 0 < got.sum() < len(got)
    far = np.abs(lines.tallies(x, n) - lines.tallies(y, m)).sum(axis=1) > 2 * distance
    assert far.any() and not (far & got).any()


# ---- 2 ----

def test_model_scores_and_their_base(spark, odd, none, monkeypatch):
    monkeypatch.setattr(pitman_yor, "PART_BYTES", 200_000)
    monkeypatch.setattr(pitman_yor, "BLOCK_TOKENS", 20_000)
    texts = [(r["doc_id"], words(r["text"], True) + [None]) for r in odd.collect()]
    held = {i: zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1 for i, _ in texts}
    c = Counter(w for i, ws in texts if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    got = {r["doc_id"]: r for r in pitman_yor.score_texts(odd).collect()}
    assert len(got) == len(texts)
    for i, ws in texts:
        r = got[i]
        base = sum(math.log10((c[w] + .5) / (n + .5 * (v + 1))) for w in ws)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (
            held[i], len(ws), sum(c[w] > 0 for w in ws), n)
        assert r["base_score"] == pytest.approx(base)
        assert math.isfinite(r["score"]) and r["score"] < 0
    assert pitman_yor.score_texts(none).count() == 0


def test_model_predicts_held_out_texts_better_than_its_base(spark):
    rng = random.Random(1)
    nxt = {w: [rng.randrange(40) for _ in range(3)] for w in range(40)}
    docs = []
    for i in range(200):
        w, out = 0, []
        for _ in range(60):
            w = rng.choice(nxt[w])
            out.append(f"w{w}")
        docs.append((i, " ".join(out)))
    scores = pitman_yor.score_texts(spark.createDataFrame(docs, "doc_id bigint, text string"))
    scores = scores.cache()
    r = scores.filter("held_out").agg(F.sum("base_score"), F.sum("n_tokens")).first()
    assert pitman_yor.perplexity(scores) < 0.25 * 10 ** (-r[0] / r[1])
    assert pitman_yor.perplexity(scores) < 5
    again = pitman_yor.score_texts(spark.createDataFrame(docs, "doc_id bigint, text string"))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, scores.collect()))


def test_every_context_is_a_restaurant_of_its_own(spark, monkeypatch):
    monkeypatch.setattr(pitman_yor, "PART_BYTES", 400_000)
    monkeypatch.setattr(pitman_yor, "PARTS_PER_BUCKET", 2)
    seen = []
    share = pitman_yor.share_rooms

    def spy(state, buckets, path, first):
        share(state, buckets, path, first)
        if first:
            seen.extend((pitman_yor.unpacked(bytes(r["blob"])), buckets, path.format(r["k"]))
                        for r in state.collect())

    monkeypatch.setattr(pitman_yor, "share_rooms", spy)
    # 90,000 contexts, more than the 65,536 of 16 bits, each before two words, twice and once
    docs = [(i, " ".join(f"c{j} x c{j} x c{j} y" for j in range(i * 300, i * 300 + 300)))
            for i in range(300)]
    train = [t for i, t in docs if not pitman_yor.held_out(i)]
    follow = defaultdict(Counter)
    for t in train:
        w = t.split()
        for a, b in zip(w, w[1:]):
            follow[pitman_yor.WordHashes()[a.encode()]][b] += 1
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)
    assert pitman_yor.score_texts(frame).count() == len(docs)
    assert len(seen) > 2 and seen[0][1] > 1
    got = {}
    for state, buckets, path in seen:
        tables, customers = pitman_yor.shared_rooms(state, buckets, path)
        for room, t, n in zip(state["rooms"].tolist(), tables.tolist(), customers.tolist()):
            assert got.setdefault(room, (t, n)) == (t, n)  # all parts have the same sums
    for room, words_after in follow.items():
        ends = got[room][1] - sum(words_after.values())  # the end token after the last word
        assert ends >= 0 and got[room][0] == len(words_after) + (ends > 0)
    assert len(follow) > 65_536


def test_rows_of_a_sweep_do_not_grow_with_its_state(spark, monkeypatch):
    monkeypatch.setattr(pitman_yor, "PART_BYTES", 200_000)
    sizes, write = [], pitman_yor.stored

    def spy(df, label, *args, **kwargs):
        table = write(df, label, *args, **kwargs)
        sizes.append(table.filter("kind = 0").agg(
            F.max(F.octet_length("blob")).alias("most"), F.count("*").alias("n")).first())
        return table

    monkeypatch.setattr(pitman_yor, "stored", spy)
    rng = random.Random(2)
    docs = [(i, " ".join(f"w{int(rng.paretovariate(0.6))}" for _ in range(2000)))
            for i in range(40)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert pitman_yor.score_texts(frame).count() == len(docs)
    parts = {r["n"] for r in sizes}
    assert len(sizes) == 9 and len(parts) == 1 and parts.pop() > 1
    assert max(r["most"] for r in sizes) < 2000


def test_seating_keeps_its_customers():
    rng = np.random.default_rng(2)
    owner = np.repeat(np.arange(5), [3, 1, 2, 4, 1])
    size = rng.integers(1, 6, len(owner))
    before = np.bincount(owner, size)
    for _ in range(200):
        owner, size = pitman_yor.gibbs(owner, size.copy(), np.arange(5), lambda: np.full(5, 1.5),
                                       0.7, 1, rng)
        assert (np.bincount(owner, size) == before).all() and (size > 0).all()
        assert (np.diff(owner) >= 0).all()
    wanted = np.array([0, 5, 1, 30, 2])
    owner, size = pitman_yor.resized(owner, size, before.astype(int), wanted, 1.0, 0.7, rng)
    assert np.bincount(owner, size, 5).tolist() == wanted.tolist()


def test_two_customers_share_a_table_as_often_as_they_should():
    rng = np.random.default_rng(0)
    owner, size = np.zeros(2, int), np.ones(2, int)
    together, fresh, discount = 0, 0.6, 0.5
    for _ in range(4000):
        owner, size = pitman_yor.gibbs(owner, size.copy(), np.array([0]),
                                       lambda: np.array([fresh]), discount, 1, rng)
        together += len(size) == 1
    assert together / 4000 == pytest.approx((1 - discount) / (1 - discount + fresh), abs=.03)


@pytest.mark.parametrize("few", [0, 1000])
def test_a_sweep_seats_every_customer_again(monkeypatch, few):
    monkeypatch.setattr(pitman_yor, "FEW", few)
    rng = np.random.default_rng(6)
    fresh, discount, c, n = 1.3, 0.7, 6, 2500
    # tables are t with probability fresh ** t * S(c, t), S the generalised Stirling numbers
    ways = np.zeros(c + 2)
    ways[1] = 1
    for i in range(1, c):
        ways[1:] = ways[:-1] + np.maximum(i - discount * np.arange(1, c + 2), 0) * ways[1:]
    expected = ways * fresh ** np.arange(c + 2)
    owner, size, seen = np.arange(n), np.full(n, c), np.zeros(c + 2)
    for sweep in range(30):
        owner, size = pitman_yor.gibbs(owner, size, np.arange(n), lambda: np.full(n, fresh),
                                       discount, 1, rng)
        if sweep >= 5:
            seen += np.bincount(np.bincount(owner), minlength=c + 2)
    assert seen / seen.sum() == pytest.approx(expected / expected.sum(), abs=.01)
    # one sweep at a high weight leaves none of 5,000 customers at the table they shared
    owner, size = pitman_yor.gibbs(np.zeros(1, int), np.array([5000]), np.zeros(1, int),
                                   lambda: np.array([1e12]), discount, 1, rng)
    assert len(size) == 5000


def test_small_restaurants_are_seated_as_a_whole():
    """As many tables as seating one by one converges to, in every chunk, and no seat kept."""
    rng, d, n = np.random.default_rng(8), 0.7, 40_000
    for c, fresh in ((2, 0.4), (6, 1.3), (40, 2.5)):
        ways = np.zeros(c + 2)
        ways[1] = 1
        for i in range(1, c):
            ways[1:] = ways[:-1] + np.maximum(i - d * np.arange(1, c + 2), 0) * ways[1:]
        expected = ways * fresh ** np.arange(c + 2)
        t = pitman_yor.drawn(np.full(n, c), np.full(n, fresh), d, rng)
        assert np.bincount(t, minlength=c + 2) / n == pytest.approx(
            expected / expected.sum(), abs=.012)
    c, fresh = np.array([3, 0, 1, 1000, 2, 1000]), np.array([1e12, 1, 1, 1e-12, 1e12, 1e12])
    assert pitman_yor.drawn(c, fresh, d, rng).tolist() == [3, 0, 1, 1, 2, 1000]


def test_words_of_a_block_and_memory_after_it():
    texts = ["  A b\tÄ ", None, "", "\n", "x\x0bY x\x1cz  q A", "A"]
    n, w, hashes = pitman_yor.word_codes(pa.array(texts))
    split = [(t or "").encode().lower().split() for t in texts]
    assert n.tolist() == [len(x) for x in split]
    assert hashes[w].tolist() == [pitman_yor.WordHashes()[x] for y in split for x in y]
    def resident():
        return int(open("/proc/self/statm").read().split()[1]) * 4096 / 1e6
    many = pa.array([" ".join(f"w{i * j % 70_001}" for j in range(500)) for i in range(1500)])
    none_hot = np.zeros(0, np.uint64)
    pitman_yor.give_back()
    before = resident()
    assert sum(1 for _ in pitman_yor.block_rows(many, range(1500), 0, 4, none_hot, none_hot)) == 5
    pitman_yor.give_back()
    assert resident() - before < 60


def test_the_first_pass_seats_customers_one_after_the_other(monkeypatch):
    rng = np.random.default_rng(7)
    none, c = np.zeros(0, int), np.full(20_000, 3)
    owner, size = pitman_yor.seated(c, np.full(len(c), 0.6), 0.5, rng, none, none)
    assert (np.bincount(owner, size) == c).all()
    alone = 0.5 / 1.1  # the second customer sits with the first, then the third with both
    assert (np.bincount(owner) == 1).mean() == pytest.approx(alone * 1.5 / 2.1, abs=.015)


# ---- 3 ----

def base_rules(text):
    w = WORD.findall(text or "")
    full = [x for x in (text or "").split("\n") if WORD.search(x)]
    grams = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    often, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if often[g] > 1:
            covered |= {i, i + 1, i + 2}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")),
            len(full) - len(set(full)), len(covered))


FIXED = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def test_quality_rules_match_brute_force(spark, odd, none):
    import xxhash

    good = [f"The house of number {i} is a good one and it stands by the {w} river." for i, w in
            enumerate("long wide deep cold warm dark".split() * 20)]
    docs = [(i, " ".join(good[i:i + 8])) for i in range(60)]
    docs += [(100 + i, " | ".join(f"x{i * 7 + j}%%%" for j in range(70))) for i in range(10)]
    rng = random.Random(4)
    plain = [f"{a}{b}" for a in "ka lo mi nu re so ta".split() for b in "ber dan fel gor hin".split()]
    docs += [(200 + i, " ".join(rng.choices(plain, k=70))) for i in range(60)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    trusted = [i for i, _ in docs if i < 40 or i >= 210]
    labels = spark.createDataFrame(
        [(i, 1, 0) for i in trusted] + [(i, 0, 0) for i in range(100, 110)] + [(None, 1, 0)],
        "doc_id bigint, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.quality(frame, labels).collect()}

    def buckets(text):
        h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in WORD.findall(text)]
        two = [xxhash.xxh64_intdigest(b.to_bytes(8, "little"),
                                      xxhash.xxh64_intdigest(a.to_bytes(8, "little"), 42))
               for a, b in zip(h, h[1:])]
        return [x % quality.BUCKETS for x in h + two]

    raw, halves = np.ones(quality.BUCKETS), np.zeros((2, quality.BUCKETS))
    half = {i: xxhash.xxh64_intdigest(i.to_bytes(8, "little"), 42) & 1 for i in trusted}
    for i, t in docs:
        for b in buckets(t):
            raw[b] += 1
            if i in half:
                halves[half[i], b] += 1

    def ratios(target):
        p = raw / raw.sum()
        n = target.sum()
        return np.log((target + 0.1 * n * p) / (1.1 * n * p))

    held = [ratios(halves[0])[buckets(t)].mean() for i, t in docs
            if half.get(i) == 1 and not got[i]["base_failed"]]
    assert len(held) > 10
    threshold = np.quantile(held, quality.LOST)
    ratio = ratios(halves.sum(0))
    for i, t in docs:
        r = got[i]
        assert tuple(r[c] for c in FIXED) == base_rules(t)
        assert r["score"] == pytest.approx(ratio[buckets(t)].mean())
        assert (r["score"] > -0.5) == (not 100 <= i < 110)
        failed = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
        assert (r["base_failed"], r["kept"]) == (
            failed, not failed and r["score"] >= threshold)

    empty = labels.filter("false")
    got = {r["doc_id"]: r for r in quality.quality(odd, empty).collect()}
    for r in odd.collect():
        x = got[r["doc_id"]]
        assert tuple(x[c] for c in FIXED) == base_rules(r["text"])
        assert x["kept"] == (x["n_words"] >= 50 and 100 * x["n_repeat_words"] <= 50 * x["n_words"])
    assert quality.quality(none, empty).count() == 0


def test_quality_trusts_every_labelled_document(spark):
    """Words that only trusted documents beyond the first 20,000 have are as good as others."""
    ids = spark.range(20_600).select(F.col("id").alias("doc_id"))
    late = F.row_number().over(Window.orderBy(F.xxhash64("doc_id"), "doc_id")) > 20_000
    docs = ids.withColumn("text", F.when(late, F.lit("late late")).otherwise(F.lit("soon soon")))
    labels = ids.withColumn("quality", F.lit(1))
    ratios, _ = quality.fitted(docs, labels)
    at = spark.range(1).select(*[
        F.xxhash64(F.lit(w)).bitwiseAND(quality.BUCKETS - 1) for w in ("late", "soon")]).first()
    assert abs(ratios[at[0]] - ratios[at[1]]) < 0.05


@pytest.mark.parametrize("share", [0.0, 0.002, 0.3, 0.5, 1.0])
def test_quality_quantile_is_the_percentile(spark, share):
    for n in (1, 2, 3, 8, 501):
        scores = spark.range(n).select((F.xxhash64("id") % 1000 / 7).alias("s"))
        assert quality._quantile(scores, share) == scores.agg(
            F.percentile("s", F.lit(share))).first()[0]


def test_quality_sorts_windows_once(spark):
    """Functions with lambdas evaluate an argument as often as it is written."""
    frame = spark.createDataFrame([(1, "a b c " * 30)], "doc_id bigint, text string")
    plan = quality.judge(frame, [0.0] * 4, 0.0)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sort_array(transform(") == 2  # of short texts and of long ones


def test_quality_keeps_columns_that_clash(spark):
    names = ["_found", "_hashes", "_windows", "_lines", "_total", "_w", "score"]
    frame = spark.createDataFrame([(1, "a b", *range(7))], ["doc_id", "text", *names])
    row = quality.judge(frame, [0.0] * 4, 0.0).first()
    assert [row[c] for c in names[:-1]] == list(range(6))
    assert (row["score"], row["n_words"], row["kept"]) == (0.0, 2, False)


# ---- 4 ----

@pytest.mark.parametrize("name,kind", [("word_bpe_49k.json", "word"), ("byte_bpe_50k.json", "byte")])
def test_pieces_give_the_ids_of_whole_texts(name, kind):
    path = public_tokenizers.path(name)
    whole, encoder = Tokenizer.from_file(path), tokens.Encoder(path, kind)
    rng = random.Random(7)
    texts = ["", " ", "it's we're o'clock I'LL x'd", "a b  c  d\n\n e", "<|endoftext|>x <|EndOfText|> y",
             "ÀÉ÷×ßÿé. É!!| é É.", "\x1cfoo\x85 bar", "tab\tx \t y\r\n z", "日本語 １２３ 4567 ½",
             "İstanbul ΣΑΣ ǅ", "a.b,c a..b 1.5 x1 x_1", " lead", "trail ", "é x́"]
    signs = "ab éA\n \t.,'!1 ́\U0001f600<|"
    texts += ["".join(rng.choice(signs) for _ in range(rng.randint(1, 30))) for _ in range(1500)]
    for text, ids in zip(texts, encoder.encode([t.encode() for t in texts])):
        want = whole.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, encoder.type).tolist() == want, repr(text)


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 1000])
def test_streams_round_trip(n):
    v = np.random.default_rng(n).choice([0, 1, 255, 256, 65535, 65536, 1 << 24, 2**32 - 1], n)
    assert idfile.unpack(*idfile.pack(v), n).tolist() == v.tolist()


def test_id_files_round_trip(spark, odd, none, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    folder = as_uri(str(tmp_path / "ids"))
    idfile.write_id_files(odd, folder, path, 2)
    got = idfile.read_id_files(spark, folder).orderBy("start").collect()
    docs = sorted(((r["doc_id"], r["text"]) for r in odd.collect()),
                  key=lambda x: (x[0] is not None, x[0] or 0))
    start = 0
    assert [r["doc_id"] for r in got] == [d for d, _ in docs]
    for r, (_, text) in zip(got, docs):
        ids = whole.encode(text or "", add_special_tokens=False).ids + [2]
        assert (r["start"], r["n_tokens"]) == (start, len(ids))
        assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == ids
        start += len(ids)
    assert idfile.write_id_files(none, as_uri(str(tmp_path / "no")), path, 2).count() == 0


def test_id_files_keep_the_least_id_apart_from_null(spark, tmp_path):
    path, folder = public_tokenizers.path("word_bpe_49k.json"), as_uri(str(tmp_path / "ids"))
    ids = [None, -(2**63), *range(9), 2**63 - 1]
    docs = spark.createDataFrame([(i, "a b") for i in reversed(ids)], "doc_id bigint, text string")
    idfile.write_id_files(docs, folder, path, 2)
    rows = idfile.read_id_files(spark, folder).orderBy("start").collect()
    assert [r["doc_id"] for r in rows[2:]] == ids[2:]
    assert {r["doc_id"] for r in rows[:2]} == {None, -(2**63)}


# ---- 5 ----

def test_mix_spreads_documents_without_id(spark):
    docs = [(None, f"w{i} " * (1 + i % 3), "a") for i in range(400)] + [(1, "x y", "b")]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    rows = [sorted(map(str, mixing.mix(f, (1.0, 5.0)).collect()))
            for f in (frame, frame.repartition(5).orderBy("text"))]
    assert rows[0] == rows[1]
    keys = frame.filter("doc_id is null").select(mixing.order_key(17).alias("k")).distinct()
    assert keys.count() == 400


def test_expand_keeps_columns_that_clash(spark):
    docs = spark.createDataFrame([(1, 5, 6, 7), (2, 8, 9, 0)], ["doc_id", "repeats", "id", "times"])
    mixed = spark.createDataFrame([(1, 2), (2, 0)], ["doc_id", "repeats"])
    assert [tuple(r) for r in mixing.expand(docs, mixed).collect()] == [(1, 5, 6, 7)] * 2


def test_mix_fills_to_the_limits(spark, odd, none):
    docs = [(i, " ".join(["w"] * (1 + i % 9)), f"s{i % 5}" if i % 50 else None) for i in range(3000)]
    docs += [(5000, "a b c", "tiny"), (5001, "", "void"), (5002, None, "void")]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    rows = mixing.mix(frame, (5.0, 2.0, 1.0)).collect()
    assert len(rows) == len(docs)
    total = sum(r["size"] for r in rows)
    by = defaultdict(list)
    for r in rows:
        by[r["source"]].append(r)
        assert r["taken"] == r["repeats"] * r["size"] and r["repeats"] <= 3
    order = sorted((s for s in by if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    size = {s: sum(r["size"] for r in x) for s, x in by.items()}
    target, open_ = {}, set(order)
    while True:
        level = (total - sum(target.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 3 * size[s]}
        if not over:
            break
        target |= {s: 3 * size[s] for s in over}
        open_ -= over
    target |= {s: weight[s] * level for s in open_}
    for s, x in by.items():
        assert x[0]["target"] == pytest.approx(target[s]) and x[0]["source_size"] == size[s]
        most = max(r["size"] for r in x)
        assert abs(sum(r["taken"] for r in x) - target[s]) <= most / 2 + 1e-6
    assert sorted(map(str, mixing.mix(frame, (5.0, 2.0, 1.0)).collect())) == sorted(map(str, rows))
    assert mixing.mix(odd, (5.0, 2.0, 1.0)).count() == odd.count()
    assert mixing.mix(none, (5.0, 2.0, 1.0)).count() == 0
    given = spark.createDataFrame([("s0", 1.0), ("s1", 3.0)], "source string, weight double")
    assert {r["source"] for r in mixing.mix(frame, given).filter("repeats > 0").collect()} == {
        "s0", "s1"}


def test_expand_repeats_documents(spark):
    docs = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "doc_id bigint, text string, repeats string")
    n = spark.createDataFrame([(1, 3), (2, 0)], "doc_id bigint, repeats bigint")
    out = mixing.expand(docs.drop("repeats"), n)
    assert [r["text"] for r in out.collect()] == ["a"] * 3


# ---- 6 ----

ODD_TEXT = "\\### Assistant: </turn> ok \\m\\b: ####</turn></turn>\n</turn"


def test_conversations_are_read_back(spark):
    rows = [(1, 0, "user", ODD_TEXT), (1, 1, "assistant", ODD_TEXT), (1, 1, "assistant", None),
            (2, 0, "user", ""), (None, None, None, "x"), (3, 1, "assistant", "b"),
            (3, 0, "ro:le: ###", "a\n: b"), (4, 0, "system", "s"), (4, 1, "user", "u"),
            (4, 2, "assistant", "a"), (4, 3, "user", "v"), (4, 4, "assistant", LONG)]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    frame = frame.withColumn("segments", F.lit(1)).withColumn("turns", F.lit(2)).repartition(3)
    out = chat.format_conversations(frame).withColumn("back", chat.read_turns(F.col("formatted")))
    got = {r["conv_id"]: r for r in out.collect()}
    assert len(got) == 5
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for c, r in got.items():
        want = sorted((x for x in rows if x[0] == c), key=key)
        assert [(t["role"], t["text"]) for t in r["back"]] == [
            (x[2] or "", x[3] or "") for x in want]
        assert "".join(s["text"] for s in r["segments"]) == r["formatted"]
        assert [s["loss"] for s in r["segments"][1::3]] == [x[2] == "assistant" for x in want]
    assert {c: r["accepted"] for c, r in got.items()} == {
        1: False, 2: False, 3: False, 4: True, None: False}
    assert chat.format_conversations(frame.filter("false")).count() == 0


@pytest.mark.parametrize("mark,close", [
    ("<|im_start|>", "<|im_end|>"), ("[x]: ", "(.*)+"), ("b ", "$^"), ("::", "]]"), ("||", "|")])
def test_any_template_reads_back(spark, mark, close):
    template = chat.Template(mark=mark, close=close)
    texts = [mark, close, close + "\n", "\\" + close, "\\b\\m\\c\\d", f"a: {mark}{close}b\n", "", "|", "]"]
    roles = ["user", "a: b", mark, close, "x:"]
    rows = [(1, i, roles[i % 5], t) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string")
    out = chat.format_conversations(frame, template)
    back = out.select(chat.read_turns(F.col("formatted"), template).alias("b")).first()["b"]
    assert [(t["role"], t["text"]) for t in back] == [(r, t) for _, _, r, t in rows]


@pytest.mark.parametrize("mark", ["", "\\x", "b"])
def test_marks_that_cannot_be_escaped_are_refused(mark):
    with pytest.raises(ValueError):
        chat.Template(mark=mark)


# ---- 7 ----

def test_top_k_matches_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, rng.integers(-3, 4, 6).astype(float).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(30)]  # copies and ties
    rows += [(2000, None), (2001, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (2002, [float("nan")] * 6),
             (2003, [float("inf")] * 6), (50, rows[50][1]), (2050, [1.0, 2.0]), (2055, [2.0, 1.0]),
             (2100, [3e18] * 6), (2101, [-3e18] * 6)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    frame = frame.withColumn("dim", F.lit("clash")).withColumn("no", F.lit(0)).repartition(4)
    got = defaultdict(list)
    for r in topk.top_k(frame, F.col("vec_id") % 50 == 0, 5, 256.0, 37, 3).collect():
        got[r["query_id"]].append((r["rank"], r["score"], r["vec_id"]))
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
            if v and all(x is not None and math.isfinite(x) for x in v)]
    lim = 2**63 - 1
    want = defaultdict(list)
    for n, (i, q) in enumerate(good):
        if i % 50 == 0:
            best = sorted((-max(-lim - 1, min(lim, sum(a * b for a, b in zip(q, v)))), j)
                          for m, (j, v) in enumerate(good) if m != n and len(v) == len(q))[:5]
            want[i] += [(k + 1, -s, j) for k, (s, j) in enumerate(best)]
    assert {i: sorted(x) for i, x in got.items()} == {i: sorted(x) for i, x in want.items()}
    assert topk.top_k(frame.filter("false"), F.lit(True)).count() == 0


def test_top_k_moves_no_copies_of_query_blocks(spark, tmp_path):
    """Blocks meet shards without a join, which would be a copy of a block for each shard."""
    rng = np.random.default_rng(6)
    rows = [(i, rng.integers(-9, 10, 4).astype(float).tolist()) for i in range(200)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    out = topk.top_k(frame, F.lit(True), 3, 1.0, 20, 30)
    assert "Join" not in out._jdf.queryExecution().toString()
    want = [sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in rows if j != i)[:3]
            for i, q in rows]
    got = sorted((r["query_id"], r["rank"], -r["score"], r["vec_id"]) for r in out.collect())
    assert got == [(i, k + 1, *x) for i, best in enumerate(want) for k, x in enumerate(best)]


@pytest.mark.parametrize("size", [3, 3_000, 30_000_000, 2.0**70])
def test_top_k_tiles_keep_the_best(size):
    """Floats, doubles and integers; later shards, own rows, ties and null ids."""
    rng = np.random.default_rng(7)
    a = np.floor(rng.uniform(-size, size, (9, 5)))
    b = np.floor(rng.uniform(-size, size, (60, 5)))
    b[40:50] = b[:10]
    a[3] = b[7]
    no, q_no = np.arange(60), np.r_[np.arange(4) * 20 + 100, 3, 44, 200:203]
    ids = rng.permutation(60) - 30
    null = ids == 4
    ids[null] = topk.LOW
    top = topk.Best(9, 3)
    for at in (slice(0, 30), slice(30, 33), slice(33, 60)):
        qi, ci, score = topk.tile_hits(a, q_no, b[at], no[at], 3, top.edge)
        top.add(qi, ids[at][ci], null[at][ci], score)
    lim = 2**63 - 1
    score = lambda p, q: max(-lim - 1, min(lim, sum(int(x) * int(y) for x, y in zip(p, q))))
    want = [(i, -s, j) for i in range(9) for s, j in sorted(
        (-score(a[i], b[m]), int(ids[m])) for m in range(60) if no[m] != q_no[i])[:3]]
    assert list(zip(top.qi.tolist(), top.score.tolist(), top.ids.tolist())) == want
    assert (top.null == (top.ids == topk.LOW)).all()


# ---- 8 ----

def packing_is_right(rows, longest):
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for x in by.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= longest
    return len(by)


def test_packing_matches_the_tokenizer(spark, odd, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    rows = packing.packed_pieces(odd, path, 2, 64).collect()
    want = []
    for r in odd.collect():
        ids = np.array(whole.encode(r["text"] or "", add_special_tokens=False).ids + [2], "<u4")
        first = len(ids) % 64 or min(len(ids), 64)
        edges = [0, *range(first, len(ids), 64), len(ids)]
        want += [(r["doc_id"], k, a, b - a, zlib.crc32(ids[a:b].tobytes()))
                 for k, (a, b) in enumerate(zip(edges, edges[1:]))]
    got = [tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in rows]
    assert sorted(map(str, got)) == sorted(map(str, want))
    packing_is_right(rows, 64)
    assert packing.packed_pieces(none, path, 2).count() == 0


@pytest.mark.parametrize("part_items", [50, 100_000])
def test_rounds_pack_nearly_full(spark, part_items):
    rng = random.Random(2)
    items = [(i, rng.randint(1, 1024)) for i in range(1500)]
    out = packing.pack_lengths(
        spark.createDataFrame(items, "no bigint, length bigint"), 1024, part_items).collect()
    size = dict(items)
    assert sorted(r["no"] for r in out) == sorted(size)
    bins = Counter()
    for r in out:
        bins[r["sequence_id"]] += size[r["no"]]
    assert max(bins.values()) <= 1024
    assert len(bins) <= (1.08 if part_items == 50 else 1.02) * sum(size.values()) / 1024 + 1


def test_bins_too_many_for_a_merge_are_dealt_anew(spark):
    # threes of a third each, but few beside each other: more bins than merged parts may hold
    rng = random.Random(3)
    items = [(i, rng.choice([341, 341, 600, 700])) for i in range(1200)]
    out = packing.pack_lengths(
        spark.createDataFrame(items, "no bigint, length bigint"), 1024, 6).collect()
    size, bins = dict(items), Counter()
    for r in out:
        bins[r["sequence_id"]] += size[r["no"]]
    assert sorted(r["no"] for r in out) == sorted(size) and max(bins.values()) <= 1024
    best = np.unique(packing.best_fit(np.array([n for _, n in items]), 1024)).size
    assert len(bins) <= 1.06 * best


# ---- 9 ----

def test_archives_round_trip(spark, tmp_path, monkeypatch):
    body = "<html>" + "the same page " * 20 + "</html>"
    rows = [(7, "http://a", body), (3, "http://b", body), (3, "http://b", body), (9, None, body),
            (None, "http://c", body), (1, "http://d", None), (2, "http://e", ""),
            (4, "x\r\ny", "short"), (5, "http://f", "short"), (6, "http://é", "ü" * 60),
            (8, "http://g", "ü" * 60), (10, "http://h", LONG)]
    rows += [(100 + i, f"http://p/{i}", f"<p>{i}</p>" + "common words of a page " * 30)
             for i in range(300)]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    frame = frame.withColumn("digest", F.lit("clash")).withColumn("n", F.lit(1)).repartition(3)
    folder = as_uri(str(tmp_path / "warc"))
    files = warc.write_archives(frame, folder, file_bytes=100_000)
    assert files.agg(F.sum("records")).first()[0] == len(rows)
    got = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])
           for r in warc.read_archives(spark, folder).collect()]
    first = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 100:
            first[h] = min(first.get(h, i), i)
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        ref = first.get(h) if first.get(h) != i and len(raw) >= 100 else None
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(),
                     "revisit" if ref is not None else "response", ref))
    assert sorted(map(str, got)) == sorted(map(str, want))
    head = next((tmp_path / "warc").glob("*.zst")).read_bytes()
    assert int.from_bytes(head[:4], "little") == warc.SKIPPABLE
    assert warc.write_archives(frame.filter("false"), as_uri(str(tmp_path / "no"))).count() == 0


# ---- 10 ----

def brute_jaccard(docs, n, num, den):
    sets = []
    for i, t in docs:
        w = words(t, True)
        sets.append((i, frozenset(tuple(w[j:j + n]) for j in range(max(1, len(w) - n + 1)))
                     if w else frozenset()))
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if i is not None and j is not None and a and b:
                both = len(a & b)
                if den * both >= num * (len(a) + len(b) - both):
                    x, y = find(i), find(j)
                    root[max(x, y)] = min(x, y)
    return sorted(((i, len(s), find(i)) for i, s in sets), key=str)


@pytest.mark.parametrize("n,num,den", [(3, 9, 10), (5, 8, 10)])
def test_jaccard_components_match_brute_force(spark, odd, none, n, num, den, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", 2000)
    if n == 3:  # many parts of repeated tokens
        monkeypatch.setattr(jaccard, "PART_TOKENS", 400)
    rng = random.Random(n)
    docs = []
    for size in (3, 5, 8, 9, 10, 11, 12, 14, 20, 40, 90, 200):
        for family in range(3):
            base = [f"w{rng.randrange(10_000)}" for _ in range(size)]
            for _ in range(12):
                w = list(base)
                for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                    w[rng.randrange(len(w))] = f"z{rng.randrange(10_000)}"
                if rng.random() < .3:
                    w.append("tail")
                docs.append((len(docs), " ".join(w)))
    passage = " ".join(f"common{i}" for i in range(60))
    docs += [(len(docs) + i, f"{passage} {' '.join(f'own{i}x{j}' for j in range(9))}")
             for i in range(40)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    got = sorted(map(tuple, jaccard.jaccard_components(frame, n, num, den).collect()), key=str)
    assert got == brute_jaccard(docs, n, num, den)
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = sorted(map(tuple, jaccard.jaccard_components(odd, n, num, den).collect()), key=str)
    assert got == brute_jaccard(rows, n, num, den)
    assert jaccard.jaccard_components(none).count() == 0


@pytest.mark.parametrize("part_tokens", [10**6, 500])
def test_jaccard_tokens_are_filtered_without_a_join(spark, part_tokens, monkeypatch):
    """All repeated tokens pass, hardly any other, and the tokens' rows are not joined."""
    monkeypatch.setattr(jaccard, "PART_TOKENS", part_tokens)
    monkeypatch.setattr(jaccard, "SENT_TOKENS", 700)
    rng = np.random.default_rng(8)
    common = rng.integers(-2**63, 2**63, 50)
    rows = [(i, np.r_[rng.integers(-2**63, 2**63, 20), rng.choice(common, i % 3)].tolist(), 2,
             rng.choice(common, i % 2).tolist(), 1) for i in range(200)]
    rows += [(200, [], 1, [], 1), (201, [], 1, [7], 1), (202, [], 1, [7], 1)]
    reps = spark.createDataFrame(rows, jaccard.SKETCH.replace(" n bigint, k1 bigint, k2 bigint,", ""))
    maybe, bits = jaccard.repeated_tokens(reps.repartition(5))
    assert bits == (0 if part_tokens == 10**6 else 4)
    out = jaccard.shared_tokens(reps, maybe, bits)
    assert "Join" not in out._jdf.queryExecution().toString()
    got = Counter((r["doc"], r["least"], r["index"], r["sig"]) for r in out.collect())
    every = Counter((r[0], r[2], True, x) for r in rows for x in r[1])
    every += Counter((r[0], r[4], False, x) for r in rows for x in r[3])
    assert not got - every
    count, own = Counter(), set()
    for (_, _, index, sig), n in every.items():
        count[sig] += n
        own |= {sig} if index else set()
    shared = {sig for sig in own if count[sig] > 1}
    assert 20 < len(shared) < 60
    assert {k for k in every if k[3] in shared} <= set(got)
    assert len({k for k in got if k[3] not in shared}) < 200  # of 4,000


def near_copies(rng, size, copies, edits, first=0):
    """Copies of one text, each with edits of its own."""
    base = [f"w{i}" for i in range(size)]
    out = []
    for i in range(copies):
        w = list(base)
        for at in rng.sample(range(size), edits(i)):
            w[at] = f"z{rng.randrange(10**6)}"
        out.append((first + i, " ".join(w)))
    return out


@pytest.mark.parametrize("rounds,few", [(0, 64), (1, 3), (6, 3)])
def test_jaccard_rounds_and_the_rest_match_brute_force(spark, rounds, few, monkeypatch):
    monkeypatch.setattr(jaccard, "ROUNDS", rounds)
    monkeypatch.setattr(jaccard, "FEW", few)
    monkeypatch.setattr(jaccard, "SAMPLED", 2)
    monkeypatch.setattr(jaccard, "PAIRS", 1 if rounds == 6 else 1000)
    monkeypatch.setattr(jaccard, "CONNECTED", 10 if few == 3 else 10**9)
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", 2000)
    rng = random.Random(rounds)
    docs = near_copies(rng, 90, 40, lambda i: rng.choice([2, 3, 4, 5]))
    for family in range(4):  # copies of copies, so that links form chains
        _, text = docs[rng.randrange(len(docs))]
        for i in range(12):
            w = text.split()
            for _ in range(rng.choice([1, 1, 2])):
                at = rng.randrange(len(w))
                w[at:at + rng.randrange(2)] = [f"y{rng.randrange(60)}"]
            text = " ".join(w)
            docs.append((len(docs), text))
    docs += [(docs[i][0], docs[i + 1][1]) for i in (3, 30)] + [(7, None)]
    rng.shuffle(docs)
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    for n, num, den in ((3, 9, 10), (5, 8, 10)):
        got = sorted(map(tuple, jaccard.jaccard_components(frame, n, num, den).collect()), key=str)
        assert got == brute_jaccard(docs, n, num, den)


def test_jaccard_near_copies_below_the_threshold_are_not_paired(spark, monkeypatch):
    asked = []
    write = tiles.stored

    def counted(df, label, *args):
        out = write(df, label, *args)
        if label == "queries-sizes":
            asked.append(out.count())
        return out

    monkeypatch.setattr(tiles, "stored", counted)
    docs = near_copies(random.Random(1), 100, 300, lambda i: 4)
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = jaccard.jaccard_components(frame, 3, 9, 10).collect()
    assert len({r["component_id"] for r in got}) > 200
    assert sum(asked) < 12 * len(docs)


def test_jaccard_groups_of_a_few_hundred_send_no_tokens(spark, monkeypatch):
    sent = []
    write = jaccard.stored

    def counted(df, label, *args):
        out = write(df, label, *args)
        if label == "next-tokens":
            sent.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "stored", counted)
    docs = near_copies(random.Random(2), 100, 200, lambda i: 2 + i % 3)
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    got = sorted(map(tuple, jaccard.jaccard_components(frame, 3, 9, 10).collect()), key=str)
    assert got == brute_jaccard(docs, 3, 9, 10)
    assert not sum(sent)
    monkeypatch.setattr(jaccard, "FEW", 64)  # larger groups go by leaders and tokens, to the same end
    again = sorted(map(tuple, jaccard.jaccard_components(frame, 3, 9, 10).collect()), key=str)
    assert again == got and sum(sent)


def test_jaccard_refuses_thresholds_with_partners_two_classes_up(spark, none):
    for num, den in ((9, 10), (8, 10)):
        parts = jaccard.Parts(num, den)
        for n in range(1, 400):
            c = parts.classes(n)
            assert n * den // num < parts.bounds[c[0] + 2]
    with pytest.raises(ValueError):
        jaccard.jaccard_components(none, 3, 1, 2)
