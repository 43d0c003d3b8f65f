"""SQL building blocks of the oracle queries."""

IMP = """
imp AS (
  SELECT e.event_id AS id, CAST(e.event_type = 'click' AS INTEGER) AS click,
         CAST(strftime(e.ts, '%y%m%d%H') AS INTEGER) AS hour,
         e.user_id AS device_id,
         regexp_extract(e.props, '[0-9]+') AS device_ip,
         c.c_mktsegment, n.n_name, r.r_name,
         e.value / 500.0 AS score_a,
         CAST(regexp_extract(e.props, '[0-9]+') AS DOUBLE) / 100.0 AS score_b
  FROM events e
  JOIN customer c ON e.user_id = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
)"""

BUCKET = "CAST(concat('0x', substr(md5(CAST({0} AS VARCHAR)), 1, 8)) AS BIGINT) % 100"

DAY = "CAST(hour // 100 % 100 AS INTEGER)"
HOD = "CAST(hour % 100 AS INTEGER)"
SIN = f"round(sin(2 * pi() * {HOD} / 24), 9) + 0.0"
COS = f"round(cos(2 * pi() * {HOD} / 24), 9) + 0.0"
BAND = (f"CASE WHEN {HOD} BETWEEN 0 AND 5 THEN 'Madrugada' "
        f"WHEN {HOD} BETWEEN 6 AND 11 THEN 'Mañana' "
        f"WHEN {HOD} BETWEEN 12 AND 17 THEN 'Tarde' ELSE 'Noche' END")

SPLIT = (f"CASE WHEN {BUCKET.format('id')} < 70 THEN 'Entrenamiento' "
         "ELSE 'Prueba' END")

LINES = """
lines AS (
  SELECT l.*, p.p_brand, p.p_type, p.p_size, p.p_retailprice,
         o.o_orderstatus, o.o_orderpriority, o.o_totalprice,
         CAST(l.l_returnflag = 'R' AS INTEGER) AS returned
  FROM lineitem l
  LEFT JOIN part p ON l.l_partkey = p.p_partkey
  LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey
)"""

DOCS = """
docs AS (
  SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic
  FROM documents d JOIN labels l USING (doc_id)
)"""


def stacked_levels(source: str, columns: list[str], target: str) -> str:
    """Rows ``(column, level, n, pos)`` for several columns of ``source``."""
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS level, COUNT(*) AS n, "
        f"CAST(SUM({target}) AS BIGINT) AS pos FROM {source} GROUP BY {c}"
        for c in columns)
