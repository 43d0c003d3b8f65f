"""Profiling queries."""

from adspark import operators as op
from adspark.plans.catalog.rounding import rounded
from adspark.plans.catalog.sqltext import DOCS, IMP, LINES
from adspark.plans.impressions import (
    PLACEHOLDER, events_as_impressions, impressions, labelled_documents, sold_lines, table,
)
from pyspark.sql import functions as F

WIDE = ["l_linenumber", "l_quantity", "l_returnflag", "l_linestatus", "l_partkey",
        "p_brand", "p_type", "p_size", "o_orderstatus", "o_orderpriority"]
COVERED = ["l_quantity", "l_returnflag", "p_brand", "p_type", "o_orderstatus", "l_suppkey"]
SHARES = (0.99, 0.95, 0.90, 0.75, 0.50)
SEGMENT_LABELS = {"AUTOMOBILE": "cars", "MACHINERY": "machines"}


def integrity(spark, sf):
    return op.integrity(table(spark, sf, "orders"))


def cardinality(spark, sf):
    return op.cardinality(sold_lines(spark, sf), WIDE)


def cardinality_approx(spark, sf):
    return op.cardinality(sold_lines(spark, sf), WIDE, approx=True)


def level_distribution(spark, sf):
    return rounded(op.level_distribution(
        impressions(spark, sf), "c_mktsegment", level_mapping=SEGMENT_LABELS))


def level_distribution_top5(spark, sf):
    """Five most frequent brands, as a share of all rows."""
    lines = sold_lines(spark, sf)
    five = op.keep_top_levels(lines, "p_brand", 5)
    counts = op.level_distribution(five, "p_brand", n=1.0, sort_descending=False)
    whole = lines.agg(F.count("*")).scalar()
    return rounded(counts.withColumn("percentage", F.col("percentage") / whole))


def level_distribution_pair(spark, sf):
    docs = table(spark, sf, "documents")
    toxic = labelled_documents(spark, sf).where("toxic = 1")
    return rounded(op.level_distribution_pair(
        (docs, toxic), ("lang", "source"), n=(None, 1000.0)))


def _coverage(ties):
    def run(spark, sf):
        return op.coverage(sold_lines(spark, sf), COVERED, SHARES, ties=ties)
    return run


def histogram(spark, sf):
    return rounded(op.histogram(sold_lines(spark, sf), ["l_extendedprice", "l_discount"], bins=20))


def histogram_positive(spark, sf):
    f = op.device_features(events_as_impressions(spark, sf), placeholder=PLACEHOLDER)
    return rounded(op.histogram(f, ["freq_device_id", "freq_device_ip"], 60, positive_only=True))


def preview(spark, sf):
    return op.preview(table(spark, sf, "events").select("event_id", "user_id", "event_type"),
                      5, ["event_id"])


def suggest_encoding(spark, sf):
    docs = op.suggest_encoding(table(spark, sf, "documents"), ["lang", "source", "doc_id"])
    labels = op.suggest_encoding(table(spark, sf, "labels"), ["toxic"])
    return rounded(docs.unionByName(labels))


def _coverage_sql(ties):
    """From the definition, by distinct counts: levels with an equal count are peers.

    At the first count where the mass reaches a share, peers need one level more than
    have a larger count; rows need as many of the peers as the missing mass takes.
    """
    def needed(t):
        level = "1" if ties == "peers" else (
            f"greatest(1, ceil(({t} * total - (mass - n * k)) / n - 1e-9))")
        return (f"CAST(MIN(larger + {level}) FILTER (WHERE mass >= {t} * total - 1e-9) AS BIGINT)")

    parts = []
    for c in COVERED:
        picks = ", ".join(f"{needed(t)} AS t{i}" for i, t in enumerate(SHARES))
        parts.append(f"""SELECT '{c}' AS "column", {picks} FROM (
            SELECT a.n, a.k, SUM(b.n * b.k) AS mass,
                   SUM(CASE WHEN b.n > a.n THEN b.k ELSE 0 END) AS larger,
                   (SELECT COUNT(*) FROM lines) AS total
            FROM (SELECT n, COUNT(*) AS k FROM (
                    SELECT COUNT(*) AS n FROM lines GROUP BY {c}) GROUP BY n) a
            JOIN (SELECT n, COUNT(*) AS k FROM (
                    SELECT COUNT(*) AS n FROM lines GROUP BY {c}) GROUP BY n) b ON b.n >= a.n
            GROUP BY a.n, a.k)""")
    return f"WITH {LINES} " + " UNION ALL ".join(parts)


def _histogram_sql(source, columns, bins, where=""):
    parts = []
    for c in columns:
        parts.append(f"""
        (WITH v AS (SELECT CAST({c} AS DOUBLE) AS v FROM {source} {where.format(c)}),
         s AS (SELECT MIN(v) AS lo, MAX(v) AS hi FROM v),
         e AS (SELECT i AS bin, lo + i * (hi - lo) / {bins} AS bin_lo,
                      CASE WHEN i = {bins - 1} THEN hi
                           ELSE lo + (i + 1) * (hi - lo) / {bins} END AS bin_hi
               FROM s, range({bins}) t(i))
         SELECT '{c}' AS "column", CAST(bin AS INTEGER) AS bin, round(bin_lo, 6) AS bin_lo,
                round(bin_hi, 6) AS bin_hi, COUNT(v) AS count
         FROM e LEFT JOIN v ON v >= bin_lo
              AND (v < bin_hi OR (bin = {bins - 1} AND v <= bin_hi))
         GROUP BY ALL)""")
    return " UNION ALL ".join(parts)


_ORDERS_TYPES = (("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
                 ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"),
                 ("o_orderpriority", "string"))


def _suggest_sql():
    cols = ["lang", "source", "toxic", "doc_id"]
    parts = " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", COUNT(*) AS n_levels, MAX(n) / SUM(n) AS share,
                   MIN(rn) FILTER (WHERE cum >= 0.9) AS needed
            FROM (SELECT n, row_number() OVER (ORDER BY n DESC) AS rn,
                         SUM(n) OVER (ORDER BY n DESC ROWS UNBOUNDED PRECEDING) * 1.0
                           / SUM(n) OVER () AS cum
                  FROM (SELECT COUNT(*) AS n FROM {'labels' if c == 'toxic' else 'documents'}
                        GROUP BY {c}))""" for c in cols)
    return f"""WITH p AS ({parts}),
      s AS (SELECT *, CASE WHEN share >= 0.75 THEN 'dichotomize'
                           WHEN needed <= 10 OR n_levels <= 100 THEN 'top_k'
                           WHEN share >= 0.3 THEN 'hybrid' ELSE 'target_rate' END AS strategy
            FROM p)
      SELECT "column", n_levels, round(CAST(share AS DOUBLE), 6) AS dominant_share, strategy,
             CASE WHEN strategy = 'top_k' THEN CAST(least(needed, 10) AS INTEGER) END AS k FROM s"""


QUERIES = {
    "integrity": integrity,
    "cardinality": cardinality,
    "cardinality_approx": cardinality_approx,
    "level_distribution": level_distribution,
    "level_distribution_top5": level_distribution_top5,
    "level_distribution_pair": level_distribution_pair,
    "coverage_peers": _coverage("peers"),
    "coverage_rows": _coverage("rows"),
    "histogram": histogram,
    "histogram_positive": histogram_positive,
    "preview": preview,
    "suggest_encoding": suggest_encoding,
}

ORACLE = {
    "integrity": " UNION ALL ".join(
        f"""SELECT CAST({i} AS INTEGER) AS position, '{c}' AS "column", '{t}' AS dtype,
            COUNT(*) - COUNT({c}) AS n_missing FROM orders"""
        for i, (c, t) in enumerate(_ORDERS_TYPES)),
    "cardinality": f"WITH {LINES} " + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", COUNT(DISTINCT {c}) AS n_distinct FROM lines" for c in WIDE),
    "level_distribution": f"""WITH {IMP}
      SELECT c_mktsegment AS level, COUNT(*) AS count,
             round(COUNT(*) * 100.0 / SUM(COUNT(*)) OVER (), 6) AS percentage,
             CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'cars' WHEN 'MACHINERY' THEN 'machines'
                  ELSE c_mktsegment END AS label
      FROM imp GROUP BY c_mktsegment""",
    "level_distribution_top5": f"""WITH {LINES}
      SELECT p_brand AS level, COUNT(*) AS count,
             round(COUNT(*) * 100.0 / (SELECT COUNT(*) FROM lines), 6) AS percentage,
             p_brand AS label
      FROM lines WHERE p_brand IN (
        SELECT p_brand FROM lines GROUP BY p_brand ORDER BY COUNT(*) DESC, p_brand LIMIT 5)
      GROUP BY p_brand""",
    "level_distribution_pair": f"""WITH {DOCS}
      SELECT 'left' AS panel, lang AS level, COUNT(*) AS count,
             round(COUNT(*) * 100.0 / SUM(COUNT(*)) OVER (), 6) AS percentage, lang AS label
      FROM documents GROUP BY lang
      UNION ALL
      SELECT 'right', source, COUNT(*), round(COUNT(*) * 100.0 / 1000.0, 6), source
      FROM docs WHERE toxic = 1 GROUP BY source""",
    "coverage_peers": _coverage_sql("peers"),
    "coverage_rows": _coverage_sql("rows"),
    "histogram": f"WITH {LINES} " + _histogram_sql("lines", ["l_extendedprice", "l_discount"], 20),
    "histogram_positive": f"""WITH {IMP}, f AS (
        SELECT CASE WHEN device_id = 0 THEN 0 ELSE COUNT(*) OVER (PARTITION BY device_id) END
                 AS freq_device_id,
               COUNT(*) OVER (PARTITION BY device_ip) AS freq_device_ip FROM imp) """
        + _histogram_sql("f", ["freq_device_id", "freq_device_ip"], 60, "WHERE {} > 0"),
    "preview": """SELECT event_id, user_id, event_type FROM events
                  ORDER BY event_id LIMIT 5""",
    "suggest_encoding": _suggest_sql(),
}
