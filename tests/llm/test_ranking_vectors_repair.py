"""Ranked search, near vectors and conversation repair against brute force on small tables."""

import hashlib
import heapq
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from adspark.llm import catalog, near_vectors, repair, search

# ---- ranked search ----

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute_ranking(docs, items, k=10):
    held = [(d, Counter(TERM.findall(lowered(t)))) for d, t in docs]
    held = [(d, c, sum(c.values())) for d, c in held if c]
    n_docs, n_terms = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item_id, text in items:
        scored = []
        for d, c, n in held:
            m = 100 - 90 + (90 * n * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m))
                    for t in set(TERM.findall(lowered(text))) if t in c)
            if s > 0:
                scored.append((-s, d is None, d or 0))
        out += [(item_id, r, None if none else d, -s)
                for r, (s, none, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def test_terms_are_runs_of_letters_and_digits():
    for text in ("Ab-cD_9 É×é\x7fz{q}", "", " \n", "日本 x1 y", "\x00a\x00"):
        assert [t.decode() for t in search.terms(text.encode())] == TERM.findall(lowered(text))


def test_mined_sets_hold_each_term_once():
    rng = random.Random(4)
    common = [rng.sample(range(40), 9) for _ in range(4)]
    items = [sorted(set(sum(rng.sample(common, 2), []) + rng.sample(range(60), 5)))
             for _ in range(30)] + [[], [3], list(range(60))]
    for run in (5, 256):
        before, search.MINED = search.MINED, run
        try:
            sets, sums = search.mined(items, 60)
        finally:
            search.MINED = before

        def spread(c):
            return [c] if c < 60 else [t for p in sets[c - 60] for t in spread(p)]

        for item, parts in zip(items, sums):
            assert sorted(t for c in parts for t in spread(c)) == item
        additions = sum(max(0, len(p) - 1) for p in sets + sums)
        assert additions < 0.8 * sum(max(0, len(i) - 1) for i in items)
        for i, parts in enumerate(sets):
            assert max(parts) < 60 + i


@pytest.mark.parametrize("round_bytes", [1 << 20, 300])
def test_ranking_matches_brute_force(spark, round_bytes):
    rng = random.Random(9)
    vocab = [f"w{i}" for i in range(60)] + ["É", "日本", "x9"]
    text = lambda n: " ".join(rng.choices(vocab, [1 / (i + 1) for i in range(63)], k=n))
    docs = [(i, text(rng.randrange(1, 60))) for i in range(150)]
    docs += [(200 + i, docs[5][1]) for i in range(14)] + [
        (None, docs[5][1]), (None, None), (301, ""), (302, " ,.! "), (303, "W0, w1; " * 30_000),
        (7, text(30)), (-(2**63), docs[5][1])]
    items = [(i, text(12)) for i in range(25)] + [
        (90, None), (91, ""), (92, "unseen words only"), (None, docs[5][1]), (3, text(5)),
        (93, text(400))]
    table = spark.createDataFrame([(d, t, "k", 1, 2) for d, t in docs],
                                  "doc_id bigint, text string, no string, rank int, n int")
    asked = spark.createDataFrame([(i, t, 5) for i, t in items],
                                  "item_id bigint, text string, score int")
    got = search.ranked(table.repartition(5), asked.repartition(2), 10, 8, round_bytes)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    got = sorted(map(tuple, got.collect()), key=str)
    # one null doc_id of equal score may stand for another
    assert got == brute_ranking(docs, items)
    assert search.ranked(table.limit(0), asked).count() == 0
    assert search.ranked(table, asked.limit(0)).count() == 0


# ---- near vectors ----

def brute_vectors(rows, threshold):
    ok = lambda v: v is not None and len(v) and all(
        x is not None and math.isfinite(x) for x in v) and any(v)
    n = len(rows)
    links = {i: set() for i in range(n)}
    for i in range(n):
        for j in range(i):
            a, b = rows[i], rows[j]
            if a[1] is None or a[1] != b[1] or not ok(a[2]) or not ok(b[2]) or (
                    len(a[2]) != len(b[2])):
                continue
            x, y = (np.array(v, np.float64) / max(map(abs, v)) for v in (a[2], b[2]))
            if x @ y / math.sqrt((x @ x) * (y @ y)) >= threshold:
                links[i].add(j)
                links[j].add(i)
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        least = min(ids) if ids else None
        out.append((rows[i][0], len(links[i]), least, rows[i][0] == least))
    return sorted(out, key=str)


@pytest.mark.parametrize("kind, block", [("float", 4096), ("double", 16), ("float", 7)])
def test_near_vectors_match_brute_force(spark, kind, block):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(90):
        v = rng.normal(size=12)
        rows.append((i, int(rng.integers(3)), v.tolist()))
        for _ in range(int(rng.integers(3))):  # chains: some links, some just missed
            w = v + rng.normal(size=12) * rng.choice([0.02, 0.12, 0.2])
            rows.append((1000 + len(rows), rows[-1][1], (w * rng.uniform(0.1, 50)).tolist()))
            v = w
    near = rng.normal(size=12)
    rows += [(5000 + i, 1, (near + rng.normal(size=12) * 0.01).tolist()) for i in range(40)]
    rows += [(6000 + i, 2, rows[0][2]) for i in range(30)] + [(None, rows[0][1], rows[0][2])]
    one = [1.0] + [0.0] * 11
    rows += [(7, 0, one), (7, 0, one), (None, 9, one), (None, 9, one), (8, None, one),
             (9, None, one), (10, 0, None), (11, 0, []), (12, 0, [0.0] * 12), (13, 0, [-0.0] * 12),
             (14, 0, [float("nan")] + one[1:]), (15, 0, [float("inf")] + one[1:]),
             (16, 0, [None] + one[1:]), (17, 0, one[:5]), (18, 0, [1e-30] + [0.0] * 11),
             (19, 0, [3e38] * 12), (20, 0, [1e38] * 12), (21, 8, one)]
    if kind == "float":
        rows = [(i, lab, v and [None if x is None else float(np.float32(x)) for x in v])
                for i, lab, v in rows]
    table = spark.createDataFrame([(i, lab, v, "k", 3, True) for i, lab, v in rows], (
        f"vec_id bigint, label int, embedding array<{kind}>, key string, w int, kept boolean"))
    got = near_vectors.near_vectors(table.repartition(4), 0.98, block)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_vectors(rows, 0.98)
    assert near_vectors.near_vectors(table.limit(0)).count() == 0


def test_bounds_hold_and_leave_little(spark):
    rng = np.random.default_rng(1)
    u = near_vectors.unit(rng.normal(size=(300, 64)))
    q, scale, error = near_vectors.quantised(u)
    rough = near_vectors.whole_products(q, q) * scale[:, None] * scale[None, :]
    bound = (1 + error[:, None]) * error[None, :] + error[:, None]
    assert (np.abs(rough - u @ u.T) <= bound + 1e-12).all()
    assert bound.max() < 0.05
    wide = rng.integers(-127, 128, (3, 5000)).astype(np.int8)
    whole = wide.astype(np.int64) @ wide.astype(np.int64).T
    assert (near_vectors.whole_products(wide, wide) == whole).all()


# ---- conversation repair ----

ACCEPTS = re.compile(r"(s?(ua)+)?\Z")
BLANK = re.compile(r"[^\x20\x09-\x0D]")


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        kind = zlib.crc32(key.encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def brute_repair(rows):
    """Least cost first, then the audit, over (row, state) by Dijkstra's search."""
    codes, seen, faults = [], set(), Counter()
    for _, _, role, text in rows:
        shown = BLANK.findall(text)
        fault = ("blank" if not shown else "duplicate" if (role, text) in seen else
                 "truncated" if shown[-1] not in ".!?" else "")
        seen.add((role, text))
        faults[fault] += 1
        codes.append((role, text, fault))
    change = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
    keep = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    heap, done = [(0, "", 0, 0, ())], set()
    while heap:
        cost, audit, i, q, told = heapq.heappop(heap)
        if i == len(codes) and q in (0, 3):
            turns = [t for _, t, _, _ in rows if t is not None]
            gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
            roles = [r[:1] for r, _, _ in codes]
            bad = sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))
            return (gaps, faults["blank"], faults["duplicate"], faults["truncated"], bad, cost,
                    audit, hashlib.sha256("\n".join(told).encode()).hexdigest())
        if (i, q) in done:
            continue
        done.add((i, q))
        name, to = change[q]
        heapq.heappush(heap, (cost + 2, audit + "I", i, to, told + (name + ":",)))
        if i < len(codes):
            role, text, fault = codes[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, q, told))
            if fault not in ("blank", "duplicate"):
                cut = fault == "truncated"
                heapq.heappush(heap, (cost + 2 + cut, audit + "R", i + 1, to,
                                      told + (f"{name}:{text}",)))
                if (q, role[:1]) in keep:
                    heapq.heappush(heap, (cost + cut, audit + "K", i + 1, keep[q, role[:1]],
                                          told + (f"{role}:{text}",)))


def in_order(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))


def conversations(rng, n, longest):
    rows = []
    for conv in range(n):
        for turn in range(rng.randrange(1, longest)):
            role = rng.choice(["user", "assistant"] * 4 + ["system", "tool", None, ""])
            text = rng.choice(["Yes.", "No!", "so then", "", " \t\n", None, "Why? ", f"t{turn}.",
                               f"u{turn}", "é? "])
            rows.append((conv, rng.choice([turn] * 12 + [None, turn * 3]), role, text))
    return rows


def test_codes_repair_as_dijkstra_does():
    rng = random.Random(2)
    for n in [0, 1, 2, 3, 5, 8, 13] * 12 + [63, 64, 65, 130, 200]:
        rows = [(0, i, rng.choice(["user", "assistant", "assistant", "system", "x"]),
                 rng.choice([f"{i}.", f"{i}", "", "again."])) for i in range(n)]
        seen, codes = set(), []
        for _, _, role, text in rows:
            codes.append(repair.code_of(role, text, (role, text) in seen)[0])
            seen.add((role, text))
        want = brute_repair(rows)
        assert repair.repair(bytes(codes)) == want[5:7]


def test_long_conversations_take_work_in_proportion():
    rng = random.Random(3)
    codes = bytes(rng.choice([1, 2, 3, 2 | repair.CUT, 3, 2, 3 | repair.MUST_GO])
                  for _ in range(20_000))
    cost, audit = repair.repair(codes)
    assert len(audit) - audit.count("I") == len(codes)
    assert cost == 3 * audit.count("D") + 2 * (audit.count("I") + audit.count("R")) + sum(
        bool(c & repair.CUT) for c, e in zip(codes, audit.replace("I", "")) if e != "D")


def test_query_matches_brute_force(spark, tmp_path):
    rows = conversations(random.Random(8), 120, 9)
    rows += [(500, t, "user" if t % 2 else "assistant", f"m{t}") for t in range(150)]
    rows += [(None, t, "user", f"{t}.") for t in range(3)] + [(501, None, "user", "Hi.")] * 2
    rows += [(502, 2**63 - 1, "user", "Hi."), (502, -(2**63), "user", "Ho."),
             (503, 0, "user", "long text. " * 50_000), (503, 1, "assistant", "ok.")]
    lost = next(c for c in range(10_000, 20_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows.append((lost, 0, "user", "Gone."))
    table = spark.createDataFrame([(*r, "k", 1) for r in rows], (
        "conv_id bigint, turn bigint, role string, text string, audit string, cost int"))
    table.repartition(6).write.parquet(str(tmp_path / "conversations.parquet"))
    got = catalog.op13_repair(spark, str(tmp_path))
    got = {r["conv_id"]: tuple(r)[1:] for r in got.select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
        "repaired_sha256").collect()}
    broken = brute_damage(rows)
    assert set(got) == {r[0] for r in rows}
    for conv in got:
        want = brute_repair(in_order([r for r in broken if r[0] == conv]))
        assert got[conv] == (min(want[0], 2**63 - 1), *want[1:]), conv
        assert ACCEPTS.match("") and got[conv][6].count("I") >= 0
    assert got[lost] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_repaired_rows_are_the_conversations(spark):
    rows = conversations(random.Random(1), 40, 8)
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    plan = repair.plan_repairs(table).cache()
    out = repair.repaired_rows(table, plan).collect()
    for conv in {r[0] for r in rows}:
        roles = "".join(r["role"][0] for r in out if r["conv_id"] == conv)
        assert ACCEPTS.match(roles), roles
        assert [r["no"] for r in out if r["conv_id"] == conv] == list(range(1, len(roles) + 1))
    for empty in (table.limit(0),):
        none = repair.plan_repairs(empty)
        assert none.count() == 0 and repair.repaired_rows(empty, none).count() == 0


def test_null_texts_and_roles_are_spaces(spark):
    table = spark.createDataFrame([(1, 0, None, None), (1, 1, "user", None)],
                                  "conv_id bigint, turn bigint, role string, text string")
    row = repair.plan_repairs(table).withColumn("d", F.lit(0)).first()
    assert (row["blank"], row["illegal"], row["audit"]) == (2, 1, "DD")
