"""DuckDB SQL for the registered queries, written from the definitions and independent of the Spark code."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

COLUMNS = {
    "region": "r_regionkey r_name",
    "nation": "n_nationkey n_name n_regionkey",
    "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment",
    "supplier": "s_suppkey s_name s_nationkey s_acctbal",
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate",
    "events": "event_id ts user_id event_type value props",
    "documents": "doc_id text lang source n_chars",
    "embeddings": "vec_id embedding label",
    "pages": "page_id url html",
    "benchmark": "item_id text",
    "labels": "doc_id quality toxic",
    "conversations": "conv_id turn role text",
}
COLUMNS = {t: c.split() for t, c in COLUMNS.items()}
DOUBLES = {
    "c_acctbal", "s_acctbal", "p_retailprice", "o_totalprice", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    "value", "price", "rounded_cost", "skewed", "total_price", "churn_rate",
}

EVENTS_GAPS = (
    "(SELECT event_id, event_type, CASE WHEN event_type <> 'error' THEN value END AS value, "
    "CASE WHEN event_type <> 'view' THEN user_id END AS user_id FROM events)")
MEASURES = (
    "(SELECT l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, "
    "l_extendedprice * (1 - l_discount) AS net_price, l_extendedprice / l_quantity AS unit_price, "
    "l_quantity + l_tax AS quantity_tax, l_quantity * l_extendedprice / 1000 AS order_size FROM lineitem)")
MEASURE_COLUMNS = [
    "l_quantity", "l_extendedprice", "l_discount", "l_tax", "net_price", "unit_price", "quantity_tax", "order_size"]
UNTIDY = (
    "(SELECT CAST(floor(o_custkey / 10) AS BIGINT) AS customer_group, "
    "CASE WHEN o_orderpriority <> '5-LOW' THEN o_totalprice END AS price, "
    "CAST(floor(o_totalprice / 100000) * 10 AS BIGINT) AS rounded_cost, power(o_totalprice / 100000, 4) AS skewed, "
    "CASE o_orderstatus WHEN 'F' THEN lower(o_orderpriority) WHEN 'O' THEN o_orderpriority || ' ' ELSE o_orderpriority END AS label, "
    "o_orderstatus FROM orders)")
DESCRIBED = (
    "(SELECT o_orderkey AS order_id, c_name, o_orderstatus, o_totalprice AS total_price, o_orderdate AS created, "
    "'c' || c_custkey || '@example.com' AS contact_email, 'https://example.com/' || c_custkey AS link, "
    "'$' || o_custkey AS paid, (c_nationkey * 4) || '%' AS share_text, "
    "CASE WHEN c_acctbal > 5000 THEN 'yes' ELSE 'No' END AS rich, c_acctbal / 10000 AS churn_rate, "
    "c_nationkey AS item_count, o_orderkey + 1700000000 AS unix_timestamp, "
    "CASE WHEN o_orderstatus <> 'P' THEN c_mktsegment END AS segment FROM orders JOIN customer ON o_custkey = c_custkey)")


def canon(c: str, double: bool) -> str:
    """Text of a cell: numbers without a trailing .0."""
    if double:
        return (f"CASE WHEN {c} = floor({c}) THEN CAST(CAST({c} AS BIGINT) AS VARCHAR) ELSE CAST({c} AS VARCHAR) END")
    return f"CAST({c} AS VARCHAR)"


def union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


# --- numeric profile -------------------------------------------------------------------------------------------

def stats_cte(name: str, source: str, c: str) -> str:
    return f"""{name} AS (
  SELECT count(v) AS n, count(*) - count(v) AS nulls, avg(v) AS mean, median(v) AS median, min(v) AS lo, max(v) AS hi,
         stddev_pop(v) AS sd, sum(v) AS s, max(v) FILTER (rn = floor(cnt * 0.25)) AS p25,
         max(v) FILTER (rn = floor(cnt * 0.75)) AS p75, avg(power((v - m) / nullif(d, 0), 3)) AS skew
  FROM (SELECT v, row_number() OVER (ORDER BY v NULLS LAST) - 1 AS rn, count(v) OVER () AS cnt, avg(v) OVER () AS m,
               stddev_pop(v) OVER () AS d FROM (SELECT CAST({c} AS DOUBLE) AS v FROM {source} q)))"""


def numeric_stats_sql(source: str, cols: list[str]) -> str:
    ctes = ",\n".join(stats_cte(f"s{i}", source, c) for i, c in enumerate(cols))
    rows = [
        f"""SELECT '{c}' AS "column", n AS count, nulls AS null_count, round(mean, 4) AS mean, round(median, 4) AS median,
        round(lo, 4) AS min, round(hi, 4) AS max, round(sd, 4) AS std, round(s, 1) AS sum, round(p25, 4) AS p25,
        round(median, 4) AS p50, round(p75, 4) AS p75, round(skew, 5) AS skewness FROM s{i}""" for i, c in enumerate(cols)]
    return f"WITH {ctes}\n{union(rows)}"


LINEITEM_NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
# sums of cents are compared to the cent: with one decimal they may sit on a rounding tie
ORACLES["numeric_stats"] = numeric_stats_sql("lineitem", LINEITEM_NUMBERS).replace("round(s, 1)", "round(s, 2)")
ORACLES["numeric_stats_orders"] = numeric_stats_sql(
    "orders", ["o_orderkey", "o_custkey", "o_totalprice"]).replace("round(s, 1)", "round(s, 2)")
ORACLES["numeric_stats_missing"] = numeric_stats_sql(EVENTS_GAPS, ["event_id", "value", "user_id"])


def moments_sql(source: str, cols: list[str], with_rows: bool = True) -> str:
    return union([
        f"""SELECT '{c}' AS "column", {'count(*) AS rows, ' if with_rows else ''}count({c}) AS count,
        count(*) - count({c}) AS null_count, round(sum(CAST({c} AS DOUBLE)), 1) AS sum, round(avg({c}), 4) AS mean,
        round(stddev_pop({c}), 4) AS std, round(CAST(min({c}) AS DOUBLE), 4) AS min, round(CAST(max({c}) AS DOUBLE), 4) AS max
        FROM {source} q""" for c in cols])


def text_state_sql(source: str, cols: list[str]) -> str:
    return union([
        f"""SELECT '{c}' AS "column", count(*) AS rows, 0 AS count, count(*) - count({c}) AS null_count, NULL AS sum,
        NULL AS mean, NULL AS std, NULL AS min, NULL AS max FROM {source} q""" for c in cols])


ORACLES["numeric_stats_approx"] = moments_sql("lineitem", LINEITEM_NUMBERS, with_rows=False)
ORACLES["mergeable_profile"] = union([
    moments_sql("lineitem", [c for c in LINEITEM_NUMBERS if c != "l_linenumber"]),
    text_state_sql("lineitem", ["l_returnflag", "l_linestatus", "l_shipdate"])])
ORACLES["streaming_profile"] = union([
    moments_sql("events", ["event_id", "user_id", "value"]), text_state_sql("events", ["ts", "event_type", "props"])])


def value_counts_sql(source: str, cols: list[str], doubles=DOUBLES) -> str:
    return union([
        f"""SELECT '{c}' AS "column", {canon(c, c in doubles)} AS value, count(*) AS cnt FROM {source} q GROUP BY 1, 2""" for c in cols])


ORACLES["value_counts"] = f"""SELECT "column", value, CAST(length(value) AS BIGINT) AS chars, cnt
FROM ({value_counts_sql('part', COLUMNS['part'])})"""


# equally frequent values: by their first 128 characters, then by SHA-256
TIE = "CASE WHEN length(value) > 128 THEN left(value, 128) || sha256(value) ELSE value END"


def categorical_sql(source: str, cols: list[str], k: int = 10, value: str = "value") -> str:
    return f"""WITH vc AS ({value_counts_sql(source, cols)}),
facts AS (SELECT "column", CAST(sum(cnt) AS BIGINT) AS count, CAST(coalesce(sum(cnt) FILTER (value IS NULL), 0) AS BIGINT) AS null_count,
                 count(value) AS unique_count FROM vc GROUP BY 1),
top AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY cnt DESC, {TIE}) AS rank FROM vc WHERE value IS NOT NULL)
SELECT f."column", count, null_count, unique_count, rank, {value}, cnt AS value_count
FROM facts f LEFT JOIN (SELECT * FROM top WHERE rank <= {k}) t ON f."column" = t."column" """


ORACLES["categorical_stats"] = categorical_sql("orders", ["o_orderstatus", "o_orderdate", "o_orderpriority"])
ORACLES["categorical_stats_documents"] = categorical_sql("documents", ["text", "lang", "source"], value="md5(value) AS value_md5")


def nulls_uniques_sql(source: str, cols: list[str]) -> str:
    return union([
        f"""SELECT '{c}' AS "column", count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS unique_count FROM {source} q"""
        for c in cols])


GAP_COLUMNS = ["event_id", "event_type", "value", "user_id"]
ORACLES["column_nulls_uniques"] = nulls_uniques_sql(EVENTS_GAPS, GAP_COLUMNS)
ORACLES["dataset_summary"] = f"""SELECT count(*) AS total_rows, 4 AS total_columns, 3 AS numeric_columns, 1 AS categorical_columns,
round((4.0 * count(*) - count(event_id) - count(event_type) - count(value) - count(user_id)) / (4 * count(*)), 6) AS missing_percent,
count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {EVENTS_GAPS} d)) AS duplicate_rows FROM {EVENTS_GAPS} q"""


def duplicates_sql(source: str) -> str:
    return f"""SELECT (SELECT count(*) FROM {source} a) AS total_rows, (SELECT count(*) FROM (SELECT DISTINCT * FROM {source} b)) AS distinct_rows,
(SELECT count(*) FROM {source} a) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {source} b)) AS duplicate_rows"""


ORACLES["duplicate_rows"] = duplicates_sql("(SELECT text, lang FROM documents)")
ORACLES["duplicate_rows_lineitem"] = duplicates_sql("lineitem")
ORACLES["duplicate_rows_documents"] = duplicates_sql("documents")

STRENGTH = ("CASE WHEN abs(r) >= 0.7 THEN 'strong' WHEN abs(r) >= 0.4 THEN 'moderate' WHEN abs(r) >= 0.2 THEN 'weak' ELSE 'none' END")


def pairs_sql(source: str, cols: list[str]) -> str:
    """Rows (column1, column2, r, n, i, j)."""
    return union([
        f"""SELECT '{a}' AS column1, '{b}' AS column2, corr({a}, {b}) AS r, count({a} + {b}) AS n, {i} AS i, {j} AS j FROM {source} q"""
        for i, a in enumerate(cols) for j, b in enumerate(cols) if i < j])


def matrix_sql(source: str, cols: list[str]) -> str:
    return f"""SELECT column1, column2, round(r, 6) AS value, {STRENGTH} AS strength, n
FROM ({pairs_sql(source, cols)}) WHERE r IS NOT NULL AND NOT isnan(r) AND n >= 3"""


ORACLES["correlation_matrix"] = matrix_sql(MEASURES, MEASURE_COLUMNS)
ORACLES["correlation_matrix_missing"] = matrix_sql(EVENTS_GAPS, ["event_id", "value", "user_id"])
ORACLES["mergeable_pairs"] = f"""SELECT column1, column2, n, round(r, 5) AS value FROM ({pairs_sql(MEASURES, MEASURE_COLUMNS)})"""


def cramers_sql(table: str, a: str, b: str) -> str:
    return f"""WITH cells AS (SELECT {a} AS a, {b} AS b, count(*) AS o FROM {table} GROUP BY 1, 2),
r AS (SELECT a, sum(o) AS t FROM cells GROUP BY 1), c AS (SELECT b, sum(o) AS t FROM cells GROUP BY 1),
n AS (SELECT sum(o) AS n FROM cells),
x AS (SELECT sum(power(coalesce(o, 0) - CAST(r.t AS DOUBLE) * c.t / n.n, 2) / (CAST(r.t AS DOUBLE) * c.t / n.n)) AS chi
      FROM r CROSS JOIN c CROSS JOIN n LEFT JOIN cells ON cells.a = r.a AND cells.b = c.b)
SELECT '{a}' AS column1, '{b}' AS column2, CAST(n AS BIGINT) AS n, (SELECT count(*) FROM r) AS row_levels,
(SELECT count(*) FROM c) AS col_levels, round(chi, 5) AS chi_squared,
round(least(1.0, sqrt(chi / (n * (least((SELECT count(*) FROM r), (SELECT count(*) FROM c)) - 1)))), 5) AS cramers_v FROM x, n"""


ORACLES["cramers_v"] = cramers_sql("lineitem", "l_returnflag", "l_linestatus")
ORACLES["cramers_v_events"] = cramers_sql("events", "event_type", "user_id")
ORACLES["point_biserial"] = f"""WITH t AS (SELECT event_type AS c FROM {EVENTS_GAPS} q GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
g AS (SELECT count(*) FILTER (event_type = c) AS n1, count(*) FILTER (event_type <> c) AS n0, avg(value) FILTER (event_type = c) AS m1,
      avg(value) FILTER (event_type <> c) AS m0, stddev_pop(value) AS sd, any_value(c) AS c FROM {EVENTS_GAPS} q, t WHERE value IS NOT NULL)
SELECT 'value' AS measure, 'event_type' AS category_column, (SELECT c FROM t) AS category, n1, n0, round(m1, 6) AS mean1, round(m0, 6) AS mean0,
round(coalesce((m1 - m0) / sd * sqrt(CAST(n0 AS DOUBLE) * n1 / power(n0 + n1, 2)), 0), 6) AS point_biserial FROM g"""
ORACLES["mean_by_category"] = """SELECT o_orderpriority AS category, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY 1
ORDER BY avg(o_totalprice) DESC LIMIT 8"""
ORACLES["category_distribution"] = """SELECT row_number() OVER (ORDER BY count(*) DESC, p_brand) AS rank, p_brand AS value, count(*) AS count
FROM part GROUP BY p_brand ORDER BY 1 LIMIT 8"""
ORACLES["uniformity_check"] = """WITH d AS (SELECT round(l_discount * 1000) AS v FROM lineitem),
b AS (SELECT least(4, floor(v / 20)) AS k, count(*) AS c FROM d GROUP BY 1), n AS (SELECT count(*) AS n FROM d),
w AS (SELECT max(abs(coalesce(c, 0) - n / 5.0) / (n / 5.0)) AS w FROM range(5) s(k) LEFT JOIN b ON b.k = s.k, n)
SELECT 'discount_points' AS "column", n, round(w, 6) AS max_deviation, w < 0.05 AS uniform FROM w, n
WHERE (SELECT min(v) = 0 AND max(v) = 100 FROM d)"""
ORACLES["group_mean_homogeneity"] = """WITH g AS (SELECT l_returnflag, avg(l_quantity) AS m FROM lineitem GROUP BY 1),
o AS (SELECT avg(m) AS mm, count(*) AS k FROM g), d AS (SELECT max(abs(m - mm)) AS d FROM g, o), s AS (SELECT stddev_pop(l_quantity) AS sd FROM lineitem)
SELECT 'l_returnflag' AS category, 'l_quantity' AS measure, k AS groups, round(d, 6) AS max_difference, round(sd, 6) AS std,
k >= 3 AND d < 1 AND sd > 10 AS homogeneous FROM o, d, s"""
ORACLES["round_number_ratio"] = union([
    f"""SELECT '{c}' AS "column", round(avg(CASE WHEN CAST({c} AS DOUBLE) % 5 = 0 THEN 1.0 ELSE 0.0 END), 6) AS round_ratio FROM lineitem"""
    for c in LINEITEM_NUMBERS])
LABELS = ("(SELECT CASE o_orderstatus WHEN 'F' THEN lower(o_orderpriority) WHEN 'O' THEN o_orderpriority || ' ' ELSE o_orderpriority END AS label FROM orders)")
ORACLES["near_duplicate_labels"] = f"""SELECT lower(trim(label)) AS normalized, count(DISTINCT label) AS spellings, count(*) AS rows,
min(label) AS first_label, max(label) AS last_label FROM {LABELS} q GROUP BY 1 HAVING count(DISTINCT label) > 1"""


def similar_sql(source: str, cols: list[str]) -> str:
    facts = union([f"SELECT '{c}' AS c, {i} AS i, avg({c}) AS m, stddev_pop({c}) AS s FROM {source} q" for i, c in enumerate(cols)])
    return f"""WITH f AS ({facts})
SELECT a.c AS column1, b.c AS column2, round(a.m / b.m, 6) AS mean_ratio, round(a.s / b.s, 6) AS std_ratio FROM f a, f b
WHERE a.i < b.i AND a.m <> 0 AND b.m <> 0 AND a.s <> 0 AND b.s <> 0 AND abs(a.m / b.m - 1) < 0.1 AND abs(a.s / b.s - 1) < 0.2"""


ORACLES["similar_distributions"] = similar_sql(MEASURES, MEASURE_COLUMNS)
SIZED = "(SELECT lang, source, CASE WHEN n_chars > 200 THEN 'long' ELSE 'short' END AS size FROM documents)"
ORACLES["dominant_values"] = f"""WITH vc AS ({value_counts_sql(SIZED, ['lang', 'source', 'size'])}),
t AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY cnt DESC, value) AS k, sum(cnt) OVER (PARTITION BY "column") AS n FROM vc),
s AS (SELECT "column", max(n) AS n, sum(cnt) AS top FROM t WHERE k <= 10 GROUP BY 1)
SELECT t."column", value, cnt AS value_count, round(cnt / t.n, 6) AS share, round(cnt / top, 6) AS share_of_top, cnt / t.n > 0.5 AS over_half,
cnt / top > 0.6 AS imbalanced, cnt / t.n > 0.7 AS dominated, cnt / t.n > 0.9 AS nearly_constant FROM t JOIN s ON t."column" = s."column" WHERE k = 1"""


SIZED = "(SELECT *, CASE WHEN n_chars > 200 THEN 'long' ELSE 'short' END AS size FROM documents)"


def segments_sql(source: str, cats: list[str], nums: list[str]) -> str:
    parts = union([
        f"""SELECT {i} AS place, '{c}' AS "column", value, size, '{m}' AS measure, m{j} AS segment_mean, 100 * (m{j} - o{j}) / o{j} AS difference_percent
        FROM (SELECT CAST({c} AS VARCHAR) AS value, count(*) AS size, {', '.join(f'avg({x}) AS m{y}' for y, x in enumerate(nums))} FROM {source} q
              WHERE {c} IS NOT NULL GROUP BY 1) g,
             (SELECT {', '.join(f'avg({x}) AS o{y}' for y, x in enumerate(nums))} FROM {source} q) o
        WHERE size >= 10 AND (SELECT count(DISTINCT {c}) BETWEEN 2 AND 10 FROM {source} q)"""
        for i, c in enumerate(cats) for j, m in enumerate(nums)])
    return f"""WITH p AS ({parts}),
k AS (SELECT *, dense_rank() OVER (ORDER BY place, size DESC, value) AS segment_order FROM p WHERE abs(difference_percent) > 10)
SELECT segment_order, "column", value, size, round(size / (SELECT count(*) FROM {source} q), 4) AS share, measure,
round(segment_mean, 4) AS segment_mean, round(difference_percent, 4) AS difference_percent FROM k"""


ORACLES["segment_profile"] = segments_sql(SIZED, ["lang", "source", "size"], ["doc_id", "n_chars"])
SHAPED = "(SELECT d.doc_id, n_chars, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"
ORACLES["distribution_shape"] = "WITH " + ",\n".join(
    stats_cte(f"s{i}", SHAPED, c) for i, c in enumerate(["doc_id", "n_chars", "quality", "toxic"])) + "\n" + union([
        f"""SELECT '{c}' AS "column", round(skew, 5) AS skewness, round((mean - lo) / nullif(hi - lo, 0), 5) AS mean_position,
        abs(skew) > 2 AS skewed, (mean - lo) / nullif(hi - lo, 0) < 0.2 OR (mean - lo) / nullif(hi - lo, 0) > 0.8 AS concentrated FROM s{i}"""
        for i, c in enumerate(["doc_id", "n_chars", "quality", "toxic"])])
ORACLES["apply_in_chunks"] = "SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1"


# --- sources ---------------------------------------------------------------------------------------------------

ORACLES["read_delimited"] = "SELECT conv_id, turn, role, md5(text) AS text_md5 FROM conversations"
ORACLES["read_json_records"] = """SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total,
CAST(min(o_orderdate) AS VARCHAR) AS first_date FROM orders GROUP BY 1"""
ORACLES["read_auto"] = "SELECT c_mktsegment, count(*) AS n, min(c_name) AS first_name FROM customer GROUP BY 1"
ORACLES["write_report"] = "SELECT count(*) AS row_count, 6 AS column_count, count(*) > 1000 AS truncated FROM orders"
ORACLES["normalize_cells"] = """SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, nullif(o_orderstatus, 'P') AS o_orderstatus,
round(o_totalprice, 2) AS o_totalprice_num, CAST(NULL AS DOUBLE) AS o_orderpriority_num FROM orders"""
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
DATE_STRING = r"^\d{4}-\d{2}-\d{2}|^\d{2}/\d{2}/\d{4}|^\d{2}-\d{2}-\d{4}|^\w{3}\s+\d{1,2},?\s+\d{4}"
DATE_VALUE = r"^\d{4}-\d{2}-\d{2}|^\d{1,2}/\d{1,2}/\d{2,4}$|^\d{1,2}-\d{1,2}-\d{2,4}$"
ORACLES["infer_column_types"] = union([
    f"""SELECT '{c}' AS "column", CASE WHEN count(*) FILTER (regexp_matches(t, '{NUMBER}')) > 0.8 * count(t) THEN 'number'
    WHEN count(*) FILTER (regexp_matches(t, '{DATE_STRING}')) > 0.8 * count(t) THEN 'date' ELSE 'string' END AS type
    FROM (SELECT CAST({c} AS VARCHAR) AS t FROM orders)""" for c in COLUMNS["orders"]])
ORACLES["flatten_json_column"] = "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events"
ORACLES["merge_pages"] = """WITH p AS (SELECT doc_id // 50 AS page, doc_id, quality,
row_number() OVER (PARTITION BY doc_id // 50 ORDER BY doc_id, quality) - 1 AS position, count(*) OVER (PARTITION BY doc_id // 50) AS n FROM labels)
SELECT page, position, doc_id, quality FROM p WHERE page <= coalesce((SELECT min(page) FROM p WHERE n < 15), page)"""
ORACLES["merge_pages_wrapped"] = """WITH p AS (SELECT doc_id // 50 AS page, doc_id, quality, toxic,
row_number() OVER (PARTITION BY doc_id // 50 ORDER BY doc_id, quality, toxic) - 1 AS position, count(*) OVER (PARTITION BY doc_id // 50) AS n FROM labels)
SELECT page, position, doc_id, quality, toxic FROM p WHERE page <= coalesce((SELECT min(page) FROM p WHERE n < 19), page)"""
ORACLES["systematic_sample"] = """WITH o AS (SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders)
SELECT * EXCLUDE (i, n, o_totalprice), round(o_totalprice, 4) AS o_totalprice FROM o WHERE n <= 1000 OR (i % CAST(ceil(n / 1000) AS BIGINT) = 0 AND i / CAST(ceil(n / 1000) AS BIGINT) < 1000)"""
SAMPLE_SIZE = "CASE WHEN n <= 10000 THEN n WHEN n <= 100000 THEN 10000 ELSE 5000 END"
ORACLES["tiered_sample"] = f"""WITH o AS (SELECT *,
row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS i, count(*) OVER () AS n FROM lineitem),
s AS (SELECT *, {SAMPLE_SIZE} AS k, CAST(ceil(n / ({SAMPLE_SIZE})) AS BIGINT) AS step FROM o)
SELECT * EXCLUDE (i, n, k, step) REPLACE (round(l_quantity, 4) AS l_quantity, round(l_extendedprice, 4) AS l_extendedprice, round(l_discount, 4) AS l_discount, round(l_tax, 4) AS l_tax)
FROM s WHERE i % step = 0 AND i < step * k"""
ORACLES["sampling_plan"] = """SELECT count(*) AS rows, CASE WHEN count(*) <= 10000 THEN 'small' WHEN count(*) <= 100000 THEN 'medium'
WHEN count(*) <= 500000 THEN 'large' ELSE 'massive' END AS tier,
CASE WHEN count(*) <= 10000 THEN NULL WHEN count(*) <= 100000 THEN 10000 ELSE 5000 END AS sample_size,
CASE WHEN count(*) <= 10000 THEN NULL WHEN count(*) <= 100000 THEN 50000 WHEN count(*) <= 500000 THEN 25000 ELSE 10000 END AS chunk_size,
count(*) > 10000 AS should_sample FROM lineitem"""


# --- predicates and scalar functions ---------------------------------------------------------------------------

CELLS = """(SELECT 'url' AS source, url AS cell FROM pages UNION ALL SELECT 'props', props FROM events
UNION ALL SELECT 'orderdate', CAST(o_orderdate AS VARCHAR) FROM orders UNION ALL SELECT 'custkey', CAST(o_custkey AS VARCHAR) FROM orders
UNION ALL SELECT 'text', text FROM documents UNION ALL SELECT 'name', c_name FROM customer UNION ALL SELECT 'status', o_orderstatus FROM orders
UNION ALL SELECT 'us_date', strftime(o_orderdate, '%m/%d/%Y') FROM orders UNION ALL SELECT 'eu_date', strftime(o_orderdate, '%d-%m-%Y') FROM orders
UNION ALL SELECT 'money', '$' || o_custkey FROM orders UNION ALL SELECT 'share', o_custkey || '%' FROM orders
UNION ALL SELECT 'mail', 'c' || o_custkey || '@example.com' FROM orders
UNION ALL SELECT 'phone', '+1 555-' || lpad(CAST(o_orderkey AS VARCHAR), 7, '0') FROM orders
UNION ALL SELECT 'flag', CASE WHEN o_orderstatus = 'F' THEN 'Yes' ELSE 'no' END FROM orders)"""
WORDS = "('true','false','yes','no','y','n','1','0','on','off','enabled','disabled','active','inactive')"


def tests(t: str) -> dict[str, str]:
    def like(pattern: str, options: str = "") -> str:
        return f"regexp_matches({t}, '{pattern}'{options})"

    return {
        "uuid": like("^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$", ", 'i'"),
        "email": like(r"^[^\s@]+@[^\s@]+\.[^\s@]+$"),
        "phone": f"({like(r'^[\d\s\-\(\)\+\.]{7,20}$')} AND length(regexp_replace({t}, '\\D', '', 'g')) >= 7)",
        "url": like(r"^https?://[^\s]+$", ", 'i'"),
        "currency": like(r"^\$[\d,]+\.?\d*$|^[\d,]+\.?\d*\s*(?:USD|EUR|GBP|JPY)$", ", 'i'"),
        "percent": like(r"^[\d.]+%$"),
        "unix_time": f"({like(r'^\d{10,13}$')} AND TRY_CAST({t} AS BIGINT) <= 4102444800000)",
        "boolean": f"lower({t}) IN {WORDS}",
        "date": like(DATE_VALUE),
        "date_string": like(DATE_STRING),
        "alphanumeric": like("^[A-Za-z0-9]+$"),
    }


ORACLES["pattern_flags"] = "SELECT source, " + ", ".join(
    f"count(*) FILTER ({test}) AS {name}" for name, test in tests("cell").items()) + f" FROM {CELLS} c GROUP BY 1"
ORACLES["is_date_string"] = f"SELECT source, count(*) FILTER ({tests('cell')['date_string']}) AS dates FROM {CELLS} c GROUP BY 1"
ORACLES["is_date_value"] = f"SELECT source, count(*) FILTER ({tests('cell')['date']}) AS dates FROM {CELLS} c GROUP BY 1"
ORACLES["correlation_strength"] = f"SELECT {STRENGTH} AS strength, count(*) AS n FROM (SELECT (l_quantity - 25) / 25 AS r FROM lineitem) GROUP BY 1"
ORACLES["confidence_level"] = """SELECT CASE WHEN c >= 90 THEN 'high' WHEN c >= 70 THEN 'medium' WHEN c >= 50 THEN 'low' ELSE 'very_low' END AS level,
count(*) AS n FROM (SELECT l_quantity * 2 AS c FROM lineitem) GROUP BY 1"""
ORACLES["zscore"] = "SELECT event_id, round((value - m) / s, 6) AS z FROM events, (SELECT avg(value) AS m, stddev_pop(value) AS s FROM events)"


def tail(z: str, x: str) -> str:
    t = f"(1.0 / (1.0 + 0.3275911 * ({x})))"
    return (f"(((((1.061405429 * {t} - 1.453152027) * {t} + 1.421413741) * {t} - 0.284496736) * {t} + 0.254829592) * {t} * exp(-({z}) * ({z}) / 2))")


def p_of(z: str) -> str:
    return tail(f"abs({z})", f"abs({z}) / sqrt(2)")


def p_ref(z: str) -> str:
    return tail(f"abs({z})", f"abs({z})")


ORACLES["p_value"] = f"SELECT event_id, round({p_of('value / 100')}, 6) AS p_value, round({p_ref('value / 100')}, 6) AS p_value_ref FROM events"
NAMES = """(SELECT p_partkey, upper(left(split_part(p_name, ' ', 1), 1)) || lower(substr(split_part(p_name, ' ', 1), 2)) || ' ' || lower(p_type) || 'ID' AS a,
'fk_' || split_part(p_name, ' ', 2) || '-' || CASE WHEN p_size > 25 THEN 'cost' ELSE 'code' END AS b,
CASE WHEN p_size > 30 THEN 'client' ELSE 'item' END || '_' || split_part(p_name, ' ', 1) || '_id' AS c,
CASE WHEN p_retailprice > 950 THEN 'cust' ELSE 'sku' END || '_num' AS d,
CASE WHEN p_size > 20 THEN 'sales' ELSE 'price' END || '_' || split_part(p_name, ' ', 2) AS e FROM part)"""


def normalized(x: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace(lower({x}), '[_\\-\\s]+', '_', 'g'), 'id$', '_id'), '^(fk|pk)_', '')"


def stem(x: str) -> str:
    return f"regexp_replace({normalized(x)}, '_?(id|key|code|num|number)$', '')"


GROUPS = ("customer cust client buyer", "product prod item sku", "order ord purchase transaction", "employee emp staff worker",
          "department dept div division", "category cat type class", "user usr account member")


def match_type(x: str, y: str) -> str:
    def has(s: str, words: str) -> str:
        return "(" + " OR ".join(f"contains({s}, '{w}')" for w in words.split()) + ")"

    fuzzy = " OR ".join(f"({has(stem(x), g)} AND {has(stem(y), g)})" for g in GROUPS)
    suffix = " OR ".join(f"(ends_with(lower({x}), '{s}') AND ends_with(lower({y}), '{s}'))" for s in ("_id", "_key", "_code", "_num"))
    return (f"CASE WHEN {normalized(x)} = {normalized(y)} THEN 'exact' WHEN {stem(x)} = {stem(y)} OR {fuzzy} THEN 'fuzzy' "
            f"WHEN {suffix} THEN 'value_overlap' END")


def related(x: str, y: str) -> str:
    x, y = f"lower({x})", f"lower({y})"
    pairs = (("price", "cost"), ("revenue", "sales"), ("qty", "quantity"), ("date", "time"), ("start", "end"), ("min", "max"))
    words = " OR ".join(f"(contains({x}, '{p}') AND contains({y}, '{q}')) OR (contains({x}, '{q}') AND contains({y}, '{p}'))" for p, q in pairs)
    fx, fy = (f"regexp_split_to_array({s}, '[_\\s]')[1]" for s in (x, y))
    return f"((length({fx}) > 3 AND {fx} = {fy}) OR {words})"


ORACLES["normalize_column_name"] = "SELECT p_partkey, " + ", ".join(f"{normalized(x)} AS {x}" for x in "abcde") + f" FROM {NAMES} n"
ORACLES["name_match_type"] = "SELECT p_partkey, " + ", ".join(
    f"{match_type(x, y)} AS {x}{y}" for x, y in ("ac", "bc", "cd", "bd")) + f" FROM {NAMES} n"
ORACLES["names_related"] = "SELECT p_partkey, " + ", ".join(f"{related(x, y)} AS {x}{y}" for x, y in ("be", "ce", "ae")) + f" FROM {NAMES} n"
ORACLES["similar_key_names"] = """SELECT p_partkey, (p_size > 25) = (p_retailprice > 950) AS similar,
contains(replace(lower(p_type), ' ', ''), replace(lower(p_name), ' ', '')) OR contains(replace(lower(p_name), ' ', ''), replace(lower(p_type), ' ', '')) AS contained
FROM part"""


def direction(x: str, y: str) -> str:
    def has(s: str, words: str) -> str:
        return "(" + " OR ".join(f"contains(lower({s}), '{w}')" for w in words.split()) + ")"

    cause, effect = "input spend investment effort time cost", "output revenue result return outcome sales"
    time = "date time year month day period"
    return (f"CASE WHEN {has(x, cause)} AND {has(y, effect)} THEN 'causal' WHEN {has(y, cause)} AND {has(x, effect)} THEN 'reverse_causal' "
            f"WHEN {has(x, time)} THEN 'causal' WHEN {has(y, time)} THEN 'reverse_causal' ELSE 'correlational' END")


ORACLES["causal_direction"] = "SELECT p_partkey, " + ", ".join(f"{direction(x, y)} AS {x}{y}" for x, y in ("be", "eb", "cd")) + f" FROM {NAMES} n"


# --- ordered analysis ------------------------------------------------------------------------------------------

MONTHLY = "(SELECT strftime(l_shipdate, '%Y-%m') AS month, sum(l_quantity) AS quantity, sum(l_tax * 100) AS tax FROM lineitem GROUP BY 1)"
HOURLY = "(SELECT date_trunc('hour', ts) AS hour, sum(value) AS total FROM events GROUP BY 1)"


def series_cte(parts: list[tuple[str, str, str, str]]) -> str:
    """CTE ``p`` with (k, c, idx, n, v, m, var); parts are (source, key, column, order)."""
    base = union([f"SELECT {k} AS k, '{c}' AS c, CAST({c} AS DOUBLE) AS v, row_number() OVER (PARTITION BY {k} ORDER BY {o}) - 1 AS idx FROM {s} q WHERE {c} IS NOT NULL"
                  for s, k, c, o in parts])
    return f"""p AS (SELECT *, count(*) OVER (PARTITION BY k, c) AS n, avg(v) OVER (PARTITION BY k, c) AS m,
  var_pop(v) OVER (PARTITION BY k, c) AS var FROM ({base}))"""


TREND = """t AS (SELECT k, c, max(n) AS n, max(m) AS m, coalesce(regr_slope(v, idx), 0) AS slope, corr(v, idx) AS r,
  avg(v) FILTER (idx < ceil(n / 4)) AS a, avg(v) FILTER (idx >= n - ceil(n / 4)) AS b FROM p GROUP BY 1, 2),
u AS (SELECT *, 100 * (b - a) / CASE WHEN a <> 0 THEN abs(a) WHEN m <> 0 THEN abs(m) ELSE 1 END AS chg,
  CASE WHEN slope > abs(m) * 0.05 / n THEN 'up' WHEN slope < -abs(m) * 0.05 / n THEN 'down' ELSE 'stable' END AS dir FROM t)"""
KEPT = "n >= 5 AND (dir <> 'stable' OR abs(chg) > 5)"
EVENT_SERIES = [("events", "event_type", "value", "ts, event_id")]
SEASONAL = "(SELECT strftime(l_shipdate, '%Y-%m') AS month, sum(l_quantity) AS quantity, sum(l_tax * 100) AS tax, sum(l_quantity * month(l_shipdate)) AS weighted FROM lineitem GROUP BY 1)"
SEASONAL_SERIES = [(SEASONAL, "1", c, "month") for c in ("quantity", "tax", "weighted")]
MONTH_SERIES = [(MONTHLY, "1", "quantity", "month"), (MONTHLY, "1", "tax", "month")]


def trend_sql(parts, key: str) -> str:
    return f"""WITH {series_cte(parts)}, {TREND}
SELECT {key}c AS "column", n, dir AS direction, round(slope, 5) AS slope, round(chg, 5) AS change_percent,
round(a, 5) AS first_mean, round(b, 5) AS last_mean FROM u WHERE {KEPT}"""


ORACLES["trend"] = trend_sql(MONTH_SERIES, "")
ORACLES["trend_events"] = trend_sql(EVENT_SERIES, "k AS event_type, ")
LINE_ORDER = "l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"
LINE_NUMBERS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
ORACLES["trend_lineitem"] = trend_sql([("lineitem", "l_returnflag", c, LINE_ORDER) for c in LINE_NUMBERS], "k AS l_returnflag, ").replace(", 5)", ", 4)")
ORACLES["trend_test"] = f"""WITH {series_cte(EVENT_SERIES)}, {TREND}, w AS (SELECT *, r * sqrt((n - 2) / (1 - r * r)) AS z FROM u WHERE n >= 10)
SELECT k AS event_type, c AS "column", n, round(r, 5) AS r, round(z, 5) AS t_statistic, round({p_of('z')}, 5) AS p_value, round({p_ref('z')}, 5) AS p_value_ref,
abs(r) >= 0.2 AND {p_of('z')} < 0.05 AS supported, abs(r) >= 0.2 AND {p_ref('z')} < 0.05 AS supported_ref, CAST(round(abs(r) * 100) AS INTEGER) AS confidence FROM w"""

ORACLES["trend_test_lineitem"] = ORACLES["trend_test"].replace(
    series_cte(EVENT_SERIES), series_cte([("lineitem", "1", c, LINE_ORDER) for c in LINE_NUMBERS])).replace("k AS event_type, ", "").replace(", 5)", ", 4)")


def change_cte(min_n: int = 10) -> str:
    return f"""s AS (SELECT *, sum(v - m) OVER w AS s1, sum((v - m) * (v - m)) OVER w AS s2 FROM p
  WINDOW w AS (PARTITION BY k, c ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
x AS (SELECT k, c, idx, m, s1 / idx AS mb, -s1 / (n - idx) AS ma, idx AS nb, n - idx AS na, s2, n * var AS sa FROM s
  WHERE n >= {min_n} AND var > 0 AND idx >= 5 AND idx < n - 5),
y AS (SELECT *, sqrt(((nb - 1) * (s2 / nb - mb * mb) + (na - 1) * ((sa - s2) / na - ma * ma)) / (nb + na - 2)) AS pooled FROM x),
cand AS (SELECT k, c, idx, mb + m AS bm, ma + m AS am, abs(ma - mb) / (pooled * sqrt(1.0 / nb + 1.0 / na)) AS sig FROM y WHERE pooled > 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY k, c ORDER BY sig DESC, idx) AS rk FROM cand WHERE sig > 2),
greedy AS (SELECT k, c, CAST(0 AS BIGINT) AS rk, CAST([] AS BIGINT[]) AS kept, CAST(NULL AS BIGINT) AS added FROM (SELECT DISTINCT k, c FROM ranked)
  UNION ALL
  SELECT g.k, g.c, r.rk, CASE WHEN len(list_filter(g.kept, lambda e: abs(e - r.idx) < 5)) = 0 THEN list_append(g.kept, r.idx) ELSE g.kept END,
         CASE WHEN len(list_filter(g.kept, lambda e: abs(e - r.idx) < 5)) = 0 THEN r.idx END
  FROM greedy g JOIN ranked r ON r.k = g.k AND r.c = g.c AND r.rk = g.rk + 1)"""


def change_sql(parts, key: str, digits: int) -> str:
    return f"""WITH RECURSIVE {series_cte(parts)}, {change_cte()}
SELECT {key}r.c AS "column", r.idx, round(bm, {digits}) AS before_mean, round(am, {digits}) AS after_mean, round(sig, {digits}) AS significance,
CASE WHEN am > bm THEN 'increase' ELSE 'decrease' END AS direction
FROM ranked r JOIN greedy g ON g.k = r.k AND g.c = r.c AND g.added = r.idx"""


ORACLES["change_points"] = change_sql(EVENT_SERIES, "r.k AS event_type, ", 5)
ORACLES["change_points_monthly"] = change_sql(MONTH_SERIES, "", 4)


def acf_cte(max_lag: str, min_n: int) -> str:
    return f"""a AS (SELECT x.k, x.c, y.idx - x.idx AS lag, sum((x.v - x.m) * (y.v - y.m)) / (max(x.n - (y.idx - x.idx)) * max(x.var)) AS acf
  FROM p x JOIN p y ON x.k = y.k AND x.c = y.c AND y.idx - x.idx BETWEEN 2 AND {max_lag} WHERE x.n >= {min_n} AND x.var > 0 GROUP BY 1, 2, 3)"""


def acf_sql(parts, key: str, max_lag: str) -> str:
    return f"""WITH {series_cte(parts)}, {acf_cte(max_lag, 2)} SELECT {key}c AS "column", lag, round(acf, 6) AS acf FROM a"""


SEASON = """h AS (SELECT *, lag(acf) OVER w AS b, lead(acf) OVER w AS f FROM a WINDOW w AS (PARTITION BY k, c ORDER BY lag)),
best AS (SELECT *, row_number() OVER (PARTITION BY k, c ORDER BY acf DESC, lag) AS rk FROM h WHERE acf > b AND acf > f AND acf > 0.3)"""
PEAKS = """e AS (SELECT *, lag(v) OVER w AS b, lead(v) OVER w AS f FROM p WINDOW w AS (PARTITION BY k, c ORDER BY idx)),
peaks AS (SELECT * FROM e WHERE v > b AND v > f)"""
ORACLES["acf"] = acf_sql([(HOURLY, "1", "total", "hour")], "", "floor(x.n / 2)")
ORACLES["acf_events"] = acf_sql(EVENT_SERIES, "k AS event_type, ", "24")
ORACLES["seasonality"] = f"""WITH {series_cte(SEASONAL_SERIES)}, {acf_cte('floor(x.n / 2)', 8)}, {SEASON}, {PEAKS},
ten AS (SELECT k, c, string_agg(idx, ',' ORDER BY idx) AS peaks FROM (SELECT *, row_number() OVER (PARTITION BY k, c ORDER BY idx) AS rk FROM peaks) WHERE rk <= 10 GROUP BY 1, 2)
SELECT best.c AS "column", lag AS period, round(acf, 6) AS strength,
CASE lag WHEN 7 THEN 'weekly' WHEN 12 THEN 'monthly' WHEN 4 THEN 'quarterly' WHEN 24 THEN 'hourly' END AS label, coalesce(peaks, '') AS peaks
FROM best LEFT JOIN ten ON best.k = ten.k AND best.c = ten.c WHERE rk = 1"""
ORACLES["local_peaks"] = f"""WITH {series_cte(EVENT_SERIES)}, {PEAKS} SELECT k AS event_type, c AS "column", idx, v AS value FROM peaks"""
ORACLES["local_peaks_lineitem"] = f"""WITH {series_cte([("lineitem", "l_linestatus", c, LINE_ORDER) for c in ("l_quantity", "l_extendedprice", "l_discount")])}, {PEAKS}
SELECT k AS l_linestatus, c AS "column", idx, v AS value FROM peaks"""
ORACLES["time_series_report"] = f"""WITH RECURSIVE {series_cte(SEASONAL_SERIES)}, {change_cte(20)}, {acf_cte('floor(x.n / 2)', 20)}, {SEASON}
SELECT r.c AS "column", 'change_point' AS finding, r.idx AS position, round(sig, 4) AS strength, round(bm, 4) AS before_mean,
round(am, 4) AS after_mean, CASE WHEN am > bm THEN 'increase' ELSE 'decrease' END AS direction
FROM ranked r JOIN greedy g ON g.k = r.k AND g.c = r.c AND g.added = r.idx
UNION ALL SELECT c, 'seasonality', lag, round(acf, 4), NULL, NULL, NULL FROM best WHERE rk = 1"""
ORACLES["global_index"] = "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS idx FROM orders"
ORACLES["series_head"] = """SELECT * FROM (SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS idx, o_totalprice AS value FROM orders) WHERE idx < 50"""
ORDER_SERIES = [("orders", "1", "o_totalprice", "o_orderdate, o_orderkey")]
ORACLES["kpis"] = f"""WITH {series_cte(ORDER_SERIES)}, {TREND}, w AS (SELECT * FROM u WHERE {KEPT})
SELECT 'total_records' AS kpi, NULL AS "column", CAST(count(*) AS DOUBLE) AS value, CAST(NULL AS DOUBLE) AS change, NULL AS change_type FROM orders
UNION ALL SELECT 'total', 'o_totalprice', round(sum(o_totalprice), 1), round((SELECT chg FROM w) / 100, 4),
  (SELECT CASE dir WHEN 'up' THEN 'increase' WHEN 'down' THEN 'decrease' ELSE 'neutral' END FROM w) FROM orders
UNION ALL SELECT 'average', 'o_totalprice', round(avg(o_totalprice), 1), NULL, NULL FROM orders
UNION ALL SELECT 'unique', 'o_orderstatus', count(DISTINCT o_orderstatus), NULL, NULL FROM orders"""
ORACLES["trend_insights"] = f"""WITH {series_cte(MONTH_SERIES)}, {TREND}
SELECT c AS "column", dir AS direction, round(chg, 4) AS change_percent, abs(chg) > 20 AS strong,
CASE WHEN abs(chg) > 20 THEN 'warning' ELSE 'info' END AS severity FROM u WHERE {KEPT}"""


def trend_hypotheses() -> str:
    return f"""SELECT 'trend' AS kind, c AS column1, CAST(NULL AS VARCHAR) AS column2,
 CAST(least(85, 50 + CASE WHEN abs(chg) > 50 THEN 25 WHEN abs(chg) > 20 THEN 15 ELSE 0 END + CASE WHEN n > 100 THEN 10 ELSE 0 END) AS DOUBLE) AS confidence,
 'correlational' AS interpretation, chg AS statistic, CAST(NULL AS DOUBLE) AS p_value FROM u WHERE {KEPT} AND dir <> 'stable' AND abs(chg) >= 5"""


ORACLES["hypotheses_trend"] = f"""WITH {series_cte(MONTH_SERIES)}, {TREND}
SELECT * EXCLUDE (statistic), round(statistic, 4) AS statistic FROM ({trend_hypotheses()})"""


# --- outliers and tests ----------------------------------------------------------------------------------------

def iqr_sql(source: str, cols: list[str], ids: list[str]) -> str:
    ctes = ",\n".join(stats_cte(f"s{i}", source, c) for i, c in enumerate(cols))
    rows = [f"""SELECT {', '.join(ids)}, '{c}' AS "column", round(CAST({c} AS DOUBLE), 5) AS value, round(p25 - 1.5 * (p75 - p25), 5) AS expected_min,
    round(p75 + 1.5 * (p75 - p25), 5) AS expected_max, round(coalesce(({c} - mean) / nullif(sd, 0), 0), 5) AS zscore
    FROM {source} q, s{i} WHERE {c} < p25 - 1.5 * (p75 - p25) OR {c} > p75 + 1.5 * (p75 - p25)""" for i, c in enumerate(cols)]
    return f"WITH {ctes}\n{union(rows)}"


ORACLES["outliers_iqr"] = iqr_sql("events", ["value"], ["event_id"])
# doc_id is both the id and a measured column without outliers
ORACLES["outliers_iqr_documents"] = iqr_sql("documents", ["doc_id", "n_chars"], ["doc_id"])
ORACLES["outliers_zscore"] = """SELECT event_id, 'value' AS "column", round(value, 5) AS value, round((value - m) / s, 5) AS zscore
FROM events, (SELECT avg(value) AS m, stddev_pop(value) AS s FROM events) WHERE abs((value - m) / s) > 3"""
ORACLES["row_anomalies"] = f"""WITH f AS (SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}' for c in LINEITEM_NUMBERS)} FROM lineitem),
z AS (SELECT l_orderkey, l_linenumber, ({' + '.join(f'abs(({c} - m_{c}) / s_{c})' for c in LINEITEM_NUMBERS)}) / {len(LINEITEM_NUMBERS)} AS z FROM lineitem, f)
SELECT l_orderkey, l_linenumber, round(z, 5) AS mean_abs_zscore FROM z WHERE z > 1.3"""
ORACLES["outlier_bounds"] = "WITH " + ",\n".join(stats_cte(f"s{i}", "lineitem", c) for i, c in enumerate(LINEITEM_NUMBERS)) + "\n" + union([
    f"""SELECT '{c}' AS "column", round(p25 - 1.5 * (p75 - p25), 4) AS expected_min, round(p75 + 1.5 * (p75 - p25), 4) AS expected_max FROM s{i}"""
    for i, c in enumerate(LINEITEM_NUMBERS)])
OUTLIER_TEST = f"""WITH {stats_cte('s', 'events', 'value')}, o AS (SELECT count(*) AS k FROM events, s WHERE value < p25 - 1.5 * (p75 - p25) OR value > p75 + 1.5 * (p75 - p25))"""
ORACLES["outlier_test"] = f"""{OUTLIER_TEST}
SELECT 'value' AS "column", n, k AS outliers, round(100.0 * k / n, 6) AS outlier_percent, k > 0 AS supported,
round(CASE WHEN k > 0 THEN least(90, 50 + 5 * (100.0 * k / n)) ELSE 30 END, 6) AS confidence FROM o, s"""


def welch_cte(source: str, cat: str, num: str, name: str = "w") -> str:
    return f"""g{name} AS (SELECT CAST({cat} AS VARCHAR) AS g, count({num}) AS n, avg({num}) AS m, var_pop({num}) AS v FROM {source} q WHERE {cat} IS NOT NULL GROUP BY 1 HAVING count({num}) >= 5),
{name} AS (SELECT a.g AS tg, a.n AS tn, a.m AS tm, b.g AS bg, b.n AS bn, b.m AS bm, (SELECT count(*) FROM g{name}) AS k,
 coalesce((a.m - b.m) / nullif(sqrt(a.v / a.n + b.v / b.n), 0), 0) AS z, sqrt(a.v / a.n + b.v / b.n) AS se
 FROM (SELECT * FROM g{name} ORDER BY m DESC, g LIMIT 1) a, (SELECT * FROM g{name} ORDER BY m, g LIMIT 1) b WHERE (SELECT count(*) FROM g{name}) >= 2)"""


ORACLES["welch_t_test"] = f"""WITH {welch_cte('events', 'event_type', 'value')}
SELECT 'event_type' AS category, 'value' AS measure, k AS groups, tg AS top_group, tn AS top_n, round(tm, 5) AS top_mean, bg AS bottom_group, bn AS bottom_n,
round(bm, 5) AS bottom_mean, round(z, 5) AS t_statistic, round({p_of('z')}, 5) AS p_value, round({p_ref('z')}, 5) AS p_value_ref, round((tm - bm) / bm, 5) AS effect_size,
{p_of('z')} < 0.05 AS supported, {p_ref('z')} < 0.05 AS supported_ref, CASE WHEN {p_of('z')} < 0.05 THEN 75.0 ELSE 40.0 END AS confidence FROM w"""


def correlation_test_cte(source: str, a: str, b: str) -> str:
    return f"""r AS (SELECT count({a} + {b}) AS n, coalesce(corr({a}, {b}), 0) AS r FROM {source} q),
ct AS (SELECT *, r * sqrt((n - 2) / (1 - r * r)) AS z FROM r WHERE n >= 10)"""


ORACLES["correlation_test"] = f"""WITH {correlation_test_cte(MEASURES, 'l_extendedprice', 'unit_price')}
SELECT 'l_extendedprice' AS column1, 'unit_price' AS column2, n, round(r, 4) AS r, round(z, 4) AS t_statistic, round({p_of('z')}, 4) AS p_value,
round({p_ref('z')}, 4) AS p_value_ref, abs(r) >= 0.4 AND {p_of('z')} < 0.05 AS supported, abs(r) >= 0.4 AND {p_ref('z')} < 0.05 AS supported_ref,
round(abs(r) * 100) AS confidence FROM ct"""
ORACLES["test_hypothesis"] = f"""WITH {correlation_test_cte('events', 'user_id', 'value')}, {welch_cte('events', 'event_type', 'value')},
{series_cte([('events', '1', 'value', 'ts, event_id')])}, {TREND}, tt AS (SELECT *, r * sqrt((n - 2) / (1 - r * r)) AS z FROM u WHERE n >= 10),
{OUTLIER_TEST[5:]}
SELECT 'correlation' AS kind, round(r, 5) AS statistic, round({p_of('z')}, 5) AS p_value, abs(r) >= 0.4 AND {p_of('z')} < 0.05 AS supported, round(abs(r) * 100) AS confidence FROM ct
UNION ALL SELECT 'group_difference', round(z, 5), round({p_of('z')}, 5), {p_of('z')} < 0.05, CASE WHEN {p_of('z')} < 0.05 THEN 75.0 ELSE 40.0 END FROM w
UNION ALL SELECT 'trend', round(r, 5), round({p_of('z')}, 5), abs(r) >= 0.2 AND {p_of('z')} < 0.05, round(abs(r) * 100) FROM tt
UNION ALL SELECT 'anomaly', CAST(k AS DOUBLE), NULL, k > 0, round(CASE WHEN k > 0 THEN least(90, 50 + 5 * (100.0 * k / s.n)) ELSE 30 END, 5) FROM o, s"""


# --- hypotheses ------------------------------------------------------------------------------------------------

CONFOUNDER_WORDS = ("time", "date", "size", "scale", "population", "region")


def confounder_cte(source: str, cols: list[str], all_cols: list[str]) -> str:
    """CTEs ``c`` (correlations both ways) and ``conf`` (c1, c2, x, by_name, place)."""
    places = ", ".join(f"('{c}', {i}, {str(any(w in c for w in CONFOUNDER_WORDS)).lower()})" for i, c in enumerate(all_cols))
    return f"""m AS ({pairs_sql(source, cols)}), cols(x, place, named) AS (VALUES {places}),
c AS (SELECT column1 AS a, column2 AS b, r FROM m UNION ALL SELECT column2, column1, r FROM m),
conf AS (SELECT pr.column1 AS c1, pr.column2 AS c2, x, place,
  CASE WHEN EXISTS (SELECT 1 FROM c u JOIN c w ON u.b = w.b WHERE u.a = pr.column1 AND w.a = pr.column2 AND u.b = x AND abs(u.r) > 0.3 AND abs(w.r) > 0.3)
       THEN 0 WHEN named THEN 1 END AS by_name FROM m pr, cols WHERE x <> pr.column1 AND x <> pr.column2),
listed AS (SELECT *, row_number() OVER (PARTITION BY c1, c2 ORDER BY by_name, place) - 1 AS position FROM conf WHERE by_name IS NOT NULL)"""


ALL_MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "net_price", "unit_price", "quantity_tax", "order_size"]
ORACLES["confounders"] = f"""WITH {confounder_cte(MEASURES, MEASURE_COLUMNS, ALL_MEASURES)}
SELECT position, x AS confounder, CASE by_name WHEN 1 THEN 'name' ELSE 'correlation' END AS basis FROM listed
WHERE c1 = 'l_quantity' AND c2 = 'l_extendedprice'"""


def correlation_hypotheses(source: str, cols: list[str], all_cols: list[str]) -> str:
    return f"""{confounder_cte(source, cols, all_cols)},
top AS (SELECT * FROM m WHERE abs(r) >= 0.4),
hc AS (SELECT top.*, (SELECT count(*) FROM listed WHERE c1 = column1 AND c2 = column2) AS k, (SELECT count(*) FROM {source} q) AS rows FROM top),
hcorr AS (SELECT 'correlation' AS kind, column1, column2,
 CAST(greatest(30, least(95, round(abs(r) * 80) + CASE WHEN rows > 1000 THEN 10 WHEN rows < 100 THEN -10 ELSE 0 END - CASE WHEN k > 2 THEN 10 ELSE 0 END)) AS DOUBLE) AS confidence,
 {direction('column1', 'column2')} AS interpretation, r AS statistic, CAST(NULL AS DOUBLE) AS p_value, k FROM hc)"""


def anomaly_hypotheses(source: str, cols: list[str]) -> str:
    ctes = ",\n".join(stats_cte(f"q{i}", source, c) for i, c in enumerate(cols))
    outside = [f"({c} < p25 - 1.5 * (p75 - p25) OR {c} > p75 + 1.5 * (p75 - p25))" for c in cols]
    rows = union([f"SELECT '{c}' AS c, count(*) AS k, max(abs(coalesce(({c} - mean) / nullif(sd, 0), 0))) AS z, (SELECT count(*) FROM {source} w) AS n FROM {source} q, q{i} WHERE {outside[i]}"
                  for i, c in enumerate(cols)])
    return f"""{ctes}, ha AS ({rows}), hanom AS (SELECT 'anomaly' AS kind, c AS column1, CAST(NULL AS VARCHAR) AS column2,
 CAST(least(85, CASE WHEN 100.0 * k / n > 5 THEN 70 WHEN 100.0 * k / n > 2 THEN 60 ELSE 50 END + CASE WHEN z > 5 THEN 10 ELSE 0 END) AS DOUBLE) AS confidence,
 CASE WHEN z > 4 THEN 'extreme' WHEN z > 3 THEN 'severe' ELSE 'moderate' END AS interpretation, CAST(k AS DOUBLE) AS statistic, CAST(NULL AS DOUBLE) AS p_value
 FROM ha WHERE k > 0)"""


def group_hypotheses(source: str, cats: list[str], nums: list[str]) -> str:
    names = [(c, n, f"gd{i}_{j}") for i, c in enumerate(cats) for j, n in enumerate(nums)]
    ctes = ",\n".join(welch_cte(source, c, n, x) for c, n, x in names)
    rows = union([f"""SELECT 'group_difference' AS kind, '{c}' AS column1, '{n}' AS column2,
 least(90, greatest(40, CASE WHEN {p_of('z')} < 0.05 AND se > 0 THEN 70 + (1 - {p_of('z')}) * 20 ELSE 40 END)) AS confidence, 'correlational' AS interpretation,
 z AS statistic, CASE WHEN se = 0 THEN 1.0 ELSE {p_of('z')} END AS p_value FROM {x}
 WHERE abs(tm - bm) / nullif(abs(tm + bm) / 2, 0) * 100 >= 10 AND (SELECT count(DISTINCT {c}) <= 10 FROM {source} q)""" for c, n, x in names])
    return f"{ctes}, hgroup AS ({rows})"


SHOWN = "kind, column1, column2, round(confidence, 4) AS confidence, interpretation, round(statistic, 4) AS statistic, round(p_value, 4) AS p_value"
ORACLES["hypotheses_correlation"] = f"""WITH {correlation_hypotheses(MEASURES, MEASURE_COLUMNS, ALL_MEASURES)}
SELECT {SHOWN}, CAST(k AS INTEGER) AS n_confounders FROM hcorr"""
ORACLES["hypotheses_group_difference"] = f"""WITH {group_hypotheses(SIZED, ['lang', 'source', 'size'], ['doc_id', 'n_chars'])} SELECT {SHOWN} FROM hgroup"""
ORACLES["hypotheses_anomaly"] = f"""WITH {anomaly_hypotheses('events', ['event_id', 'user_id', 'value'])} SELECT {SHOWN} FROM hanom"""
ORACLES["hypotheses"] = f"""WITH {correlation_hypotheses(MEASURES, MEASURE_COLUMNS, ALL_MEASURES)},
{group_hypotheses(MEASURES, ['l_returnflag', 'l_linestatus'], MEASURE_COLUMNS)}, {anomaly_hypotheses(MEASURES, MEASURE_COLUMNS)},
every AS (SELECT 1 AS o, * EXCLUDE (k) FROM hcorr UNION ALL SELECT 2, * FROM hgroup UNION ALL SELECT 4, * FROM hanom)
SELECT {SHOWN} FROM every"""
ORACLES["correlation_insights"] = f"""SELECT column1, column2, round(r, 6) AS value, round(r * r, 6) AS r_squared,
CASE WHEN abs(r) > 0.7 THEN 'strong' ELSE 'surprisingly_weak' END AS kind FROM ({pairs_sql(MEASURES, MEASURE_COLUMNS)})
WHERE abs(r) > 0.7 OR (abs(r) < 0.1 AND {related('column1', 'column2')})"""


# --- meaning of columns ----------------------------------------------------------------------------------------

DESCRIBED_COLUMNS = {
    "order_id": "number", "c_name": "text", "o_orderstatus": "text", "total_price": "number", "created": "moment",
    "contact_email": "text", "link": "text", "paid": "text", "share_text": "text", "rich": "text", "churn_rate": "number",
    "item_count": "number", "unix_timestamp": "number", "segment": "text",
}
CUSTOMER_KINDS = {"c_custkey": "number", "c_name": "text", "c_nationkey": "number", "c_acctbal": "number", "c_mktsegment": "text"}
EVENT_KINDS = {"event_id": "number", "ts": "moment", "user_id": "number", "event_type": "text", "value": "number", "props": "text"}


def any_word(name: str, words: str) -> str:
    return "(" + " OR ".join(f"contains({name}, '{w}')" for w in words.split()) + ")"


def meaning_ctes(source: str, kinds: dict[str, str]) -> str:
    """CTEs ``f`` (facts per column), ``b`` (with the basic type) and ``sc`` (with the thirteen scores)."""
    marks = tests("t")
    rows = union([
        f"""SELECT '{c}' AS "column", lower('{c}') AS nm, {i} AS place, count(*) AS total, count(*) - count(t) AS nulls, count(t) AS n,
  count(DISTINCT t) AS uniq, count(v) AS nums, count(t) - count(v) AS strs, min(v) AS lo, max(v) AS hi,
  count(*) FILTER (v = floor(v) AND v >= 0) AS nat, count(*) FILTER (v <> floor(v)) AS frac,
  count(*) FILTER (round(v, 2) = v AND round(v, 1) <> v) AS cents, sum(length(t)) AS chars, count(DISTINCT lower(t)) AS low_uniq,
  {', '.join(f'count(*) FILTER ({marks[m]}) AS {m}' for m in ('uuid', 'email', 'phone', 'url', 'currency', 'percent', 'unix_time', 'boolean', 'date'))}
  FROM (SELECT {canon(c, k == 'number' and c in DOUBLES)} AS t, {f'CAST({c} AS DOUBLE)' if k == 'number' else 'CAST(NULL AS DOUBLE)'} AS v FROM {source} q)"""
        for i, (c, k) in enumerate(kinds.items())])
    num = "basic_type = 'number'"
    hundred = f"({num} AND nums > 0 AND lo >= 0 AND hi <= 100 AND hi > 1)"
    unit = f"({num} AND nums > 0 AND lo >= 0 AND hi <= 1)"
    pct = any_word("nm", "percent pct share proportion")
    rate = any_word("nm", "rate ratio probability likelihood")
    scores = {
        "id": f"""CASE WHEN uuid > 0.8 * n THEN 95 ELSE least(100, CASE WHEN uniq = n AND n > 10 THEN 40 ELSE 0 END
          + CASE WHEN {any_word('nm', '_id uuid guid identifier')} THEN 35 WHEN ends_with(nm, 'id') THEN 30 WHEN {any_word('nm', 'key code')} THEN 15 ELSE 0 END
          + CASE WHEN nums = n AND n > 10 AND uniq = n AND lo >= 0 THEN CASE WHEN contains(nm, 'id') THEN 25 ELSE 10 END ELSE 0 END) END""",
        "boolean": "CASE WHEN low_uniq = 2 THEN round(100.0 * boolean / n) WHEN boolean > 0.9 * n THEN round(95.0 * boolean / n) ELSE 0 END",
        "percentage": f"""CASE WHEN percent > 0.8 * n THEN 95 ELSE least(100, CASE WHEN {pct} THEN 35 ELSE 0 END + CASE WHEN {hundred} THEN 30 ELSE 0 END
          + CASE WHEN {hundred} AND (hi > 90 OR lo < 10) THEN 15 ELSE 0 END + CASE WHEN {unit} AND {pct} THEN 30 WHEN {unit} THEN 15 ELSE 0 END) END""",
        "currency": f"""CASE WHEN currency > 0.8 * n THEN 90 ELSE least(100,
          CASE WHEN {any_word('nm', 'price cost revenue income expense salary wage fee payment balance budget')} THEN 50
               WHEN {any_word('nm', 'amount total spend value')} THEN 25 ELSE 0 END
          + CASE WHEN nums > 0 AND lo >= 0 AND hi < 10000000 THEN 15 ELSE 0 END + CASE WHEN cents > 0.5 * nums THEN 20 ELSE 0 END) END""",
        "count": f"""CASE WHEN {num} THEN CASE WHEN {any_word('nm', 'count quantity qty num number total amount units items size length age year month day')} THEN 25 ELSE 0 END
          + CASE WHEN nat > 0.95 * nums THEN 40 WHEN nat > 0.8 * nums THEN 25 ELSE 0 END ELSE 0 END""",
        "rate": f"""CASE WHEN {num} THEN least(100, CASE WHEN {rate} THEN 45 WHEN {any_word('nm', 'confidence score conversion churn retention')} THEN 25 ELSE 0 END
          + CASE WHEN nums > 0 AND lo >= 0 AND hi <= 1 THEN CASE WHEN {rate} THEN 50 ELSE 40 END + CASE WHEN frac > 0.5 * nums THEN 10 ELSE 0 END ELSE 0 END) ELSE 0 END""",
        "date": f"""CASE WHEN {any_word('nm', 'date time created updated modified timestamp born start end expire due')} THEN 25 ELSE 0 END
          + CASE WHEN date > 0.8 * n THEN 60 WHEN date > 0.5 * n THEN 35 ELSE 0 END""",
        "timestamp": f"CASE WHEN {any_word('nm', 'timestamp unix')} THEN 40 ELSE 0 END + CASE WHEN unix_time > 0.8 * n THEN 50 ELSE 0 END",
        "email": f"CASE WHEN {any_word('nm', 'email mail')} THEN 40 ELSE 0 END + CASE WHEN email > 0.8 * n THEN 55 WHEN email > 0.5 * n THEN 30 ELSE 0 END",
        "phone": f"CASE WHEN {any_word('nm', 'phone tel mobile')} THEN 40 ELSE 0 END + CASE WHEN phone > 0.8 * n THEN 50 ELSE 0 END",
        "url": f"CASE WHEN {any_word('nm', 'url link website')} THEN 40 ELSE 0 END + CASE WHEN url > 0.8 * n THEN 55 ELSE 0 END",
        "categorical": """CASE WHEN uniq <= 10 AND n > 50 THEN 85 WHEN uniq < 0.05 * n AND n > 100 THEN 75 WHEN uniq < 0.1 * n AND n > 50 THEN 60
          WHEN uniq <= 20 AND basic_type = 'string' THEN 50 ELSE 0 END""",
        "text": "CASE WHEN basic_type = 'string' THEN CASE WHEN chars / n > 50 THEN 80 WHEN chars / n > 20 THEN 60 ELSE 30 END ELSE 0 END",
    }
    return f"""f AS ({rows}),
b AS (SELECT *, CASE WHEN n = 0 THEN 'null' WHEN boolean > 0.9 * n THEN 'boolean' WHEN date > 0.8 * n THEN 'date' WHEN nums > 0.8 * n THEN 'number' ELSE 'string' END AS basic_type,
 CAST(CASE WHEN n = 0 THEN 100 WHEN boolean > 0.9 * n THEN round(100.0 * boolean / n) WHEN date > 0.8 * n THEN round(100.0 * date / n)
      WHEN nums > 0.8 * n THEN round(100.0 * nums / n) WHEN strs > 0.8 * n THEN round(100.0 * strs / n) ELSE 50 END AS DOUBLE) AS basic_confidence FROM f),
sc AS (SELECT *, {', '.join(f'CAST({e} AS DOUBLE) AS score_{k}' for k, e in scores.items())} FROM b),
long AS (SELECT "column", k, o, s FROM sc CROSS JOIN LATERAL (VALUES {', '.join(f"('{k}', {o}, score_{k})" for o, k in enumerate(scores))}) l(k, o, s) WHERE s > 0),
best AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY s DESC, o) AS rk FROM long),
sem AS (SELECT sc.*, coalesce(k, 'unknown') AS semantic_type, coalesce(s, 30) AS confidence,
 (SELECT count(*) FROM best x WHERE x."column" = sc."column") AS options FROM sc LEFT JOIN best ON best."column" = sc."column" AND rk = 1)"""


SCORES = ("id", "boolean", "percentage", "currency", "count", "rate", "date", "timestamp", "email", "phone", "url", "categorical", "text")
LEVEL = "CASE WHEN confidence >= 90 THEN 'high' WHEN confidence >= 70 THEN 'medium' WHEN confidence >= 50 THEN 'low' ELSE 'very_low' END"
ORACLES["basic_types"] = f"""WITH {meaning_ctes(DESCRIBED, DESCRIBED_COLUMNS)} SELECT "column", basic_type, basic_confidence FROM b"""
ORACLES["semantic_scores"] = f"""WITH {meaning_ctes(DESCRIBED, DESCRIBED_COLUMNS)} SELECT "column", {', '.join(f'score_{k}' for k in SCORES)} FROM sc"""
ORACLES["semantic_types"] = f"""WITH {meaning_ctes(DESCRIBED, DESCRIBED_COLUMNS)} SELECT "column", basic_type, semantic_type, confidence, {LEVEL} AS level FROM sem"""
ORACLES["infer_schema"] = f"""WITH {meaning_ctes('events', EVENT_KINDS)},
known AS (SELECT * EXCLUDE (semantic_type, confidence), CASE WHEN "column" = 'props' THEN 'text' WHEN "column" = 'value' AND confidence <= 20 THEN 'currency' ELSE semantic_type END AS semantic_type,
 CASE WHEN "column" = 'props' THEN 100 WHEN "column" = 'value' AND confidence <= 20 THEN 20 ELSE confidence END AS confidence FROM sem)
SELECT "column", basic_type, semantic_type, confidence, {LEVEL} AS level, total AS total_count, nulls AS null_count, uniq AS unique_count, nums AS numeric_count, strs AS string_count,
confidence < 70 AND (options > 1 OR uniq = n) AS needs_review,
CASE WHEN "column" = 'event_type' THEN (SELECT string_agg(event_type, ',' ORDER BY c DESC, event_type) FROM (SELECT event_type, count(*) AS c FROM events GROUP BY 1)) END AS samples FROM known"""
ORACLES["overall_confidence"] = f"""WITH {meaning_ctes('customer', CUSTOMER_KINDS)}
SELECT count(*) AS columns, round(avg(confidence), 6) AS confidence, count(*) FILTER (confidence < 70) AS uncertain_columns FROM sem"""


# --- relationships ---------------------------------------------------------------------------------------------

KEY_NAME = r"regexp_matches({c}, '^(id|.*_id|pk|fk_.*|.*_key|.*_code|uuid|guid)$', 'i') OR regexp_matches({c}, '^.*Id$')"


def keys_cte(tables: dict[str, list[str]], named: str) -> str:
    rows, i = [], 0
    for t, cols in tables.items():
        for c in cols:
            rows.append(f"""SELECT {i} AS id, '{t}' AS "table", '{c}' AS "column", count(DISTINCT {c}) AS unique_count, count({c}) AS total_count FROM {t}""")
            i += 1
    return f"""allcols AS ({union(rows)}), keyed AS (SELECT *, {named.format(c='"column"')} AS named_key FROM allcols),
keys AS MATERIALIZED (SELECT * FROM keyed WHERE total_count > 0 AND (named_key OR unique_count > 0.5 * total_count))"""


ORACLES["candidate_keys"] = f"""WITH {keys_cte(COLUMNS, KEY_NAME)} SELECT "table", "column", unique_count, total_count, named_key FROM keys"""
ORACLES["value_overlap"] = """WITH a AS (SELECT DISTINCT c_custkey AS v FROM customer), b AS (SELECT DISTINCT o_custkey AS v FROM orders),
x AS (SELECT (SELECT count(*) FROM a) AS s, (SELECT count(*) FROM b) AS t, (SELECT count(*) FROM a JOIN b USING (v)) AS m)
SELECT s AS source_unique, t AS target_unique, m AS matched, s - m AS source_orphans, t - m AS target_orphans, round(100.0 * m / least(s, t), 6) AS match_percent FROM x"""


def reasons(share: str) -> str:
    return (f"CASE WHEN {share} > 50 THEN 'export_timing; other_period_or_filter' "
            f"WHEN {share} > 10 THEN 'deleted_in_partner; entry_errors' "
            f"ELSE 'not_yet_synced; test_rows' END")


ORACLES["orphans"] = f"""WITH a AS (SELECT DISTINCT CAST(doc_id AS VARCHAR) AS v FROM documents), o AS (SELECT v FROM a WHERE v NOT IN (SELECT CAST(doc_id AS VARCHAR) FROM labels)),
x AS (SELECT (SELECT count(*) FROM a) AS n, (SELECT count(*) FROM o) AS k)
SELECT 'doc_id' AS "column", n AS value_count, k AS orphan_count, round(100.0 * k / n, 6) AS orphan_percent,
(SELECT string_agg(v, ',' ORDER BY v) FROM (SELECT v FROM o ORDER BY v LIMIT 10)) AS sample_orphans, {reasons('100.0 * k / n')} AS possible_reasons FROM x"""


def relations_cte(tables: dict[str, list[str]], named: str, bare: str) -> str:
    values = union([f"""SELECT DISTINCT {i} AS id, {canon(c, c in DOUBLES)} AS v FROM {t} WHERE {i} IN (SELECT a FROM pairs UNION SELECT b FROM pairs)""" for i, (t, c) in enumerate(
        (t, c) for t, cols in tables.items() for c in cols)])
    name = [bare.format(c=f'{x}."column"') for x in "ab"]
    return f"""{keys_cte(tables, named)},
pairs AS MATERIALIZED (SELECT * FROM (SELECT a.id AS a, b.id AS b, {match_type(*name)} AS match_type FROM keys a, keys b
 WHERE a.id < b.id AND a."table" <> b."table") WHERE match_type IS NOT NULL),
vals AS ({values}),
hits AS (SELECT p.a, p.b, p.match_type, count(*) AS matched FROM pairs p JOIN vals x ON x.id = p.a JOIN vals y ON y.id = p.b AND x.v = y.v
 WHERE x.v IS NOT NULL GROUP BY 1, 2, 3),
rel AS (SELECT a."table" AS source_table, a."column" AS source_column, b."table" AS target_table, b."column" AS target_column,
 CASE WHEN a.unique_count > 0.95 * a.total_count THEN CASE WHEN b.unique_count > 0.95 * b.total_count THEN 'one_to_one' ELSE 'one_to_many' END
      WHEN b.unique_count > 0.95 * b.total_count THEN 'many_to_one' ELSE 'many_to_many' END AS relationship_type, match_type,
 a.unique_count AS source_unique, b.unique_count AS target_unique, matched, 100.0 * matched / least(a.unique_count, b.unique_count) AS pct
 FROM hits JOIN keys a ON a.id = hits.a JOIN keys b ON b.id = hits.b),
scored AS (SELECT *, CAST(greatest(0, least(100, CASE match_type WHEN 'exact' THEN 70 WHEN 'fuzzy' THEN 50 ELSE 30 END
 + CASE WHEN pct > 80 THEN 20 WHEN pct > 50 THEN 10 WHEN pct < 20 THEN -20 ELSE 0 END
 + CASE WHEN matched > 100 THEN 10 WHEN matched < 10 THEN -10 ELSE 0 END)) AS DOUBLE) AS confidence FROM rel)"""


RELATION = """SELECT source_table, source_column, target_table, target_column, relationship_type, match_type, confidence, source_unique, target_unique, matched,
source_unique - matched AS source_orphans, target_unique - matched AS target_orphans, round(pct, 6) AS match_percent FROM scored WHERE confidence >= 30"""
ORACLES["find_relationships"] = f"WITH {relations_cte(COLUMNS, KEY_NAME, '{c}')} {RELATION}"
SALES = {t: COLUMNS[t] for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")}
ORACLES["find_relationships_prefixed"] = f"""WITH {relations_cte(SALES, "regexp_matches({c}, '^.*key$', 'i')", "regexp_replace({c}, '^[a-z]{{1,2}}_', '')")} {RELATION}"""


def orphan_side(a: str, b: str) -> str:
    share = f"100.0 * ({a}_unique - matched) / {a}_unique"
    return f"""SELECT {a}_table AS "table", {a}_column AS "column", {b}_table AS partner_table, {b}_column AS partner_column, {a}_unique - matched AS orphan_count,
round({share}, 6) AS orphan_percent, {reasons(share)} AS possible_reasons FROM scored WHERE confidence >= 30 AND {a}_unique > matched"""


ORACLES["orphan_report"] = f"""WITH {relations_cte(COLUMNS, KEY_NAME, '{c}')} {orphan_side('source', 'target')} UNION ALL {orphan_side('target', 'source')}"""
ORACLES["join_related"] = "SELECT d.doc_id, lang, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"
ORACLES["join_related_inner"] = """SELECT o_orderpriority, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1"""


def quality_ctes(source: str, cols: list[str], nums: list[str]) -> str:
    """CTE ``issues`` (issue, column, severity, affected_count, percent) and ``score``."""
    cats = [c for c in cols if c not in nums]
    parts = [f"""SELECT 'missing' AS issue, '{c}' AS "column", CASE WHEN p > 20 THEN 'critical' WHEN p > 5 THEN 'warning' ELSE 'info' END AS severity, k AS affected_count, p AS percent
 FROM (SELECT count(*) - count({c}) AS k, 100.0 * (count(*) - count({c})) / count(*) AS p FROM {source} q) WHERE k > 0""" for c in cols]
    parts += [f"""SELECT 'suspicious', '{c}', 'info', CAST(floor(n * r) AS BIGINT), 100 * r FROM (SELECT count(*) AS n, coalesce(avg(CASE WHEN CAST({c} AS DOUBLE) % 5 = 0 THEN 1.0 WHEN {c} IS NOT NULL THEN 0 END), 0) AS r FROM {source} q) WHERE r > 0.8"""
              for c in nums]
    parts += [f"""SELECT 'outlier', '{c}', CASE WHEN 100.0 * k / n > 5 THEN 'warning' ELSE 'info' END, k, 100.0 * k / n
 FROM (SELECT count(*) FILTER ({c} < p25 - 1.5 * (p75 - p25) OR {c} > p75 + 1.5 * (p75 - p25)) AS k, count(*) AS n FROM {source} q, z{i}) WHERE k > 0""" for i, c in enumerate(nums)]
    parts += [f"""SELECT 'many_values', '{c}', 'warning', u, 100.0 * u / n FROM (SELECT count(DISTINCT {c}) AS u, count(*) AS n FROM {source} q) WHERE u > 0.9 * n AND n > 100""" for c in cats]
    parts += [f"""SELECT 'near_duplicate', '{c}', 'warning', CAST(2 * sum(g * (g - 1) // 2) AS BIGINT), NULL FROM (SELECT count(*) AS g FROM
 (SELECT CAST({c} AS VARCHAR) AS v FROM {source} q WHERE {c} IS NOT NULL GROUP BY 1) GROUP BY lower(trim(v))) HAVING sum(g * (g - 1) // 2) > 0""" for c in cats]
    parts.append(f"""SELECT 'duplicate', NULL, CASE WHEN 100.0 * k / n > 10 THEN 'critical' ELSE 'warning' END, k, 100.0 * k / n
 FROM (SELECT count(*) AS n, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {source} d)) AS k FROM {source} q) WHERE k > 0""")
    stats = ",\n".join(stats_cte(f"z{i}", source, c) for i, c in enumerate(nums))
    return f"""{stats}, issues AS ({union(parts)}),
score AS (SELECT CAST(greatest(0, floor(100 - coalesce(sum(CASE issue WHEN 'missing' THEN least(percent, 20) WHEN 'near_duplicate' THEN 5 WHEN 'duplicate' THEN least(percent, 15) ELSE 0 END), 0) + 0.5)) AS BIGINT) AS score FROM issues)"""


UNTIDY_COLUMNS = ["customer_group", "price", "rounded_cost", "skewed", "label", "o_orderstatus"]
UNTIDY_NUMBERS = UNTIDY_COLUMNS[:4]
UNTIDY_QUALITY = quality_ctes(UNTIDY, UNTIDY_COLUMNS, UNTIDY_NUMBERS)
BAND = "CASE WHEN score >= 90 THEN 'excellent' WHEN score >= 70 THEN 'good' WHEN score >= 50 THEN 'moderate' ELSE 'poor' END"
ORACLES["quality_issues"] = f"""WITH {UNTIDY_QUALITY} SELECT issue, "column", severity, affected_count, round(percent, 5) AS percent FROM issues"""
ORACLES["quality_score"] = f"WITH {UNTIDY_QUALITY} SELECT score, {BAND} AS band FROM score"

NO_TEXT = "(SELECT doc_id, lang, source, n_chars FROM documents)"


def side_sql(source: str, cols: list[str], nums: list[str], side: str) -> str:
    return union([
        f"""SELECT '{c}' AS "column", count(*) - count({c}) AS null_count_{side}, count(DISTINCT {c}) AS unique_count_{side},
 {f'avg({c})' if c in nums else 'CAST(NULL AS DOUBLE)'} AS mean_{side}, {f'stddev_pop({c})' if c in nums else 'CAST(NULL AS DOUBLE)'} AS std_{side}, true AS in_{side} FROM {source} q""" for c in cols])


ORACLES["compare_datasets"] = f"""WITH l AS ({side_sql(NO_TEXT, ['doc_id', 'lang', 'source', 'n_chars'], ['doc_id', 'n_chars'], 'left')}),
r AS ({side_sql('labels', COLUMNS['labels'], COLUMNS['labels'], 'right')}),
ql AS (WITH {quality_ctes(NO_TEXT, ['doc_id', 'lang', 'source', 'n_chars'], ['doc_id', 'n_chars'])} SELECT score FROM score),
qr AS (WITH {quality_ctes('labels', COLUMNS['labels'], COLUMNS['labels'])} SELECT score FROM score)
SELECT "column", CASE WHEN in_left AND in_right THEN 'common' WHEN in_left THEN 'only_left' ELSE 'only_right' END AS presence,
 null_count_left, null_count_right, unique_count_left, unique_count_right, round(mean_left, 5) AS mean_left, round(mean_right, 5) AS mean_right,
 round(std_left, 5) AS std_left, round(std_right, 5) AS std_right, round(mean_right - mean_left, 5) AS mean_change,
 CAST(NULL AS BIGINT) AS rows_left, CAST(NULL AS BIGINT) AS rows_right, NULL AS columns_left, NULL AS columns_right, CAST(NULL AS BIGINT) AS score_left, CAST(NULL AS BIGINT) AS score_right
FROM l FULL JOIN r USING ("column")
UNION ALL SELECT NULL, 'table', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, (SELECT count(*) FROM documents), (SELECT count(*) FROM labels), 4, 3,
 (SELECT score FROM ql), (SELECT score FROM qr)"""
CATALOG = ", ".join(f"({i}, '{t}', {len(cols)}, '{c}')" for i, (t, cols) in enumerate(COLUMNS.items()) for c in cols)


def similar_names(x: str, y: str) -> str:
    x, y = (f"regexp_replace(lower({c}), '[_\\-\\s]', '', 'g')" for c in (x, y))
    forms = ("'customerid','custid','customer_id','cust_id','clientid'", "'productid','prodid','product_id','prod_id','itemid'",
             "'orderid','ordid','order_id','ord_id'", "'userid','user_id','uid','accountid'")
    same = " OR ".join(f"({x} IN ({f}) AND {y} IN ({f}))" for f in forms)
    return f"({x} = {y} OR contains({x}, {y}) OR contains({y}, {x}) OR {same})"


ORACLES["catalog_similarity"] = f"""WITH cat(p, t, w, c) AS (VALUES {CATALOG}),
sizes AS ({union([f"SELECT '{t}' AS t, count(*) AS n FROM {t}" for t in COLUMNS])}),
common AS (SELECT a.t AS table1, b.t AS table2, a.w AS w1, b.w AS w2, count(*) AS k, string_agg(a.c, ',' ORDER BY a.c) AS columns FROM cat a JOIN cat b ON a.c = b.c AND a.p < b.p GROUP BY 1, 2, 3, 4),
every AS (SELECT 'common_columns' AS kind, table1, table2, CAST(least(90, 50 + 10 * k) AS DOUBLE) AS confidence, columns, CAST(k AS DOUBLE) AS measure FROM common
UNION ALL SELECT 'schema_similarity', table1, table2, 85, columns, k / greatest(w1, w2) FROM common WHERE k / greatest(w1, w2) > 0.7
UNION ALL SELECT 'possible_join', a.t, b.t, 70, a.c || ',' || b.c, 1 FROM cat a JOIN cat b ON a.p < b.p AND a.c <> b.c
 WHERE {any_word('lower(a.c)', 'id _id key code')} AND {any_word('lower(b.c)', 'id _id key code')} AND {similar_names('a.c', 'b.c')})
SELECT kind, table1, table2, confidence, columns, round(measure, 6) AS measure, x.n AS rows1, y.n AS rows2 FROM every JOIN sizes x ON x.t = table1 JOIN sizes y ON y.t = table2"""
ORDER_ROW = " || ".join(f"coalesce(length({canon(c, c in DOUBLES)}) || ':' || {canon(c, c in DOUBLES)}, '-')"
                        for c in COLUMNS["orders"])
ORACLES["dataset_fingerprint"] = f"""SELECT 'orders' AS name, count(*) AS row_count, 6 AS column_count, '{'|'.join(COLUMNS['orders'])}' AS columns,
left(md5('{'|'.join(COLUMNS['orders'])}'), 8) AS column_hash, CAST(sum(CAST('0x' || left(md5({ORDER_ROW}), 15) AS HUGEINT)) AS VARCHAR) AS content_hash FROM orders"""

# --- insights --------------------------------------------------------------------------------------------------

def notes_sql(source: str, cols: list[str], nums: list[str]) -> str:
    rows = []
    for c in cols:
        if c in nums:
            rows.append(f"""SELECT '{c}' AS "column", 'numeric' AS kind, 0 AS unique_count, CASE WHEN min({c}) = 0 AND max({c}) = 100 THEN 'percentage'
 WHEN coalesce(stddev_pop({c}) / nullif(avg({c}), 0), 0) < 0.1 AND count(*) > 100 THEN 'low_variance' WHEN stddev_pop({c}) / nullif(avg({c}), 0) > 2 THEN 'high_variance' END AS note FROM {source} q""")
        else:
            rows.append(f"""SELECT '{c}', 'categorical', u, CASE WHEN u = n AND n > 100 THEN 'all_unique' WHEN length(t) > 20 AND regexp_matches(t, '^[A-Za-z0-9]+$') THEN 'garbage' END
 FROM (SELECT count(DISTINCT {c}) AS u, count(*) AS n, (SELECT CAST({c} AS VARCHAR) FROM {source} w WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS t FROM {source} q)""")
    return union(rows)


ORACLES["variable_notes"] = notes_sql("customer", COLUMNS["customer"], ["c_custkey", "c_nationkey", "c_acctbal"])
ORACLES["eda_overview"] = """SELECT count(*) AS rows, 6 AS columns, 3 AS numeric_columns, 2 AS categorical_columns,
count(*) > 1000 AND count(*) * 6 = count(o_orderkey) + count(o_custkey) + count(o_orderstatus) + count(o_totalprice) + count(o_orderdate) + count(o_orderpriority) AS suspiciously_clean FROM orders"""
EQUAL_MEANS = "\n".join(
    f"""UNION ALL SELECT 'equal_means', '{c}, {m}', greatest(max(x) - avg(x), avg(x) - min(x)) FROM (SELECT avg({m}) AS x FROM lineitem GROUP BY {c})
 WHERE (SELECT count(*) > 1000 AND stddev_pop({m}) > 10 FROM lineitem) HAVING greatest(max(x) - avg(x), avg(x) - min(x)) < 1 AND count(x) >= 3"""
    for c in ("l_returnflag", "l_linestatus", "l_shipdate") for m in LINEITEM_NUMBERS)
ORACLES["synthetic_checks"] = f"""WITH m AS ({pairs_sql('lineitem', list(LINEITEM_NUMBERS))}),
every AS (SELECT 'no_missing' AS "check", CAST(NULL AS VARCHAR) AS "column", CAST(0 AS DOUBLE) AS value FROM lineitem HAVING count(*) > 1000
 AND count(*) * 11 = {" + ".join(f"count({c})" for c in COLUMNS["lineitem"])}
UNION ALL SELECT 'no_correlation', NULL, max(abs(r)) FROM m HAVING max(abs(r)) < 0.1 AND count(*) >= 3
{EQUAL_MEANS})
SELECT "check", "column", round(value, 4) AS value, (SELECT count(*) FROM every) >= 2 AS synthetic FROM every"""
ORACLES["eda_findings"] = f"""WITH {series_cte(MONTH_SERIES)}, {TREND}, m AS (SELECT corr(quantity, tax) AS r FROM {MONTHLY} q),
{stats_cte('z0', MONTHLY, 'quantity')}, {stats_cte('z1', MONTHLY, 'tax')},
o AS (SELECT count(*) FILTER (quantity < z0.p25 - 1.5 * (z0.p75 - z0.p25) OR quantity > z0.p75 + 1.5 * (z0.p75 - z0.p25))
 + count(*) FILTER (tax < z1.p25 - 1.5 * (z1.p75 - z1.p25) OR tax > z1.p75 + 1.5 * (z1.p75 - z1.p25)) AS k FROM {MONTHLY} q, z0, z1)
SELECT 'complete' AS finding, 'quality' AS category, 'success' AS severity, CAST(NULL AS VARCHAR) AS "column", CAST(0 AS DOUBLE) AS value
UNION ALL SELECT 'strong_correlations', 'finding', 'success', 'quantity, tax', 1 FROM m WHERE abs(r) > 0.5
UNION ALL SELECT 'trend', 'finding', 'info', c, round(chg, 4) FROM u WHERE {KEPT} AND abs(chg) > 5
UNION ALL SELECT 'outliers', 'anomaly', CASE WHEN k > 10 THEN 'warning' ELSE 'info' END, NULL, k FROM o WHERE k > 0"""
QUICK = union([f"SELECT {i} AS i, '{c}' AS c, count(*) - count({c}) AS k, count(*) AS n FROM {UNTIDY} q" for i, c in enumerate(UNTIDY_COLUMNS)])
ORACLES["quick_insights"] = f"""WITH {", ".join(stats_cte(f"z{i}", UNTIDY, c) for i, c in enumerate(UNTIDY_NUMBERS))},
miss AS (SELECT 1 AS o, 'missing' AS insight, c AS "column", 100.0 * k / n AS value FROM ({QUICK}) WHERE k > 0 ORDER BY k DESC, i LIMIT 1),
best AS (SELECT 2 AS o, 'strong_correlation', column1 || ', ' || column2, r FROM ({pairs_sql(UNTIDY, UNTIDY_NUMBERS)}) WHERE abs(r) >= 0.7 ORDER BY abs(r) DESC, column1, column2 LIMIT 1),
outs AS (SELECT 3 AS o, 'outliers', c, CASE WHEN hi > u THEN hi ELSE lo END FROM ({union([f"SELECT {i} AS i, '{c}' AS c, lo, hi, p25 - 1.5 * (p75 - p25) AS l, p75 + 1.5 * (p75 - p25) AS u FROM z{i}" for i, c in enumerate(UNTIDY_NUMBERS)])})
 WHERE lo < l OR hi > u ORDER BY i LIMIT 1),
dom AS (SELECT 4 AS o, 'dominated', c, 100.0 * k / n FROM ({union([f"SELECT {i} AS i, '{c}' AS c, count(*) AS k, (SELECT count(*) FROM {UNTIDY} w) AS n FROM {UNTIDY} q WHERE {c} IS NOT NULL GROUP BY {c}" for i, c in enumerate(UNTIDY_COLUMNS[4:])])})
 WHERE 100.0 * k / n > 50 ORDER BY i LIMIT 1),
every AS (SELECT * FROM miss UNION ALL SELECT * FROM best UNION ALL SELECT * FROM outs UNION ALL SELECT * FROM dom)
SELECT CAST(row_number() OVER (ORDER BY o) - 1 AS INTEGER) AS place, insight, "column", round(value, 4) AS value FROM every"""
DEEP = f"""{UNTIDY_QUALITY}, m AS ({pairs_sql(UNTIDY, UNTIDY_NUMBERS)}),
sh AS ({union([f"SELECT {i} AS i, '{c}' AS c, skew, mean, lo, hi, sd FROM z{i}" for i, c in enumerate(UNTIDY_NUMBERS)])}),
an AS (SELECT count(*) FILTER (z > 2.5) AS k, count(*) AS n FROM (SELECT CASE WHEN {' + '.join(f'(({c} IS NOT NULL)::INT)' for c in UNTIDY_NUMBERS)} >= 2 THEN
 ({' + '.join(f'coalesce(abs(({c} - z{i}.mean) / z{i}.sd), 0)' for i, c in enumerate(UNTIDY_NUMBERS))}) / ({' + '.join(f'(({c} IS NOT NULL)::INT)' for c in UNTIDY_NUMBERS)}) END AS z FROM {UNTIDY} q, z0, z1, z2, z3)),
dom AS ({union([f"SELECT '{c}' AS c, max(k) / sum(k) AS share FROM (SELECT count({c}) AS k FROM {UNTIDY} q GROUP BY {c})" for c in UNTIDY_COLUMNS[4:]])}),
sim AS ({similar_sql(UNTIDY, UNTIDY_NUMBERS)}), seg AS ({segments_sql(UNTIDY, UNTIDY_COLUMNS[4:], UNTIDY_NUMBERS)}),
deep AS (SELECT issue AS insight, 'quality' AS type, severity, CAST(95 AS DOUBLE) AS confidence, coalesce("column", '') AS columns FROM issues
UNION ALL SELECT 'skewed', 'anomaly', 'info', 85, c FROM sh WHERE abs(skew) > 2
UNION ALL SELECT 'concentrated', 'anomaly', 'info', 70, c FROM sh WHERE (mean - lo) / nullif(hi - lo, 0) < 0.2 OR (mean - lo) / nullif(hi - lo, 0) > 0.8
UNION ALL SELECT 'anomalous_rows', 'anomaly', CASE WHEN k > 0.05 * n THEN 'warning' ELSE 'info' END, 80, '' FROM an WHERE k > 0
UNION ALL SELECT 'similar_distributions', 'pattern', 'info', 75, column1 || ',' || column2 FROM sim
UNION ALL SELECT 'dominated', 'pattern', CASE WHEN share > 0.9 THEN 'warning' ELSE 'info' END, 90, c FROM dom WHERE share > 0.7
UNION ALL SELECT 'strong_correlation', 'correlation', 'success', 90, column1 || ',' || column2 FROM m WHERE abs(r) > 0.7
UNION ALL SELECT 'surprisingly_weak_correlation', 'anomaly', 'info', 60, column1 || ',' || column2 FROM m WHERE abs(r) < 0.1 AND {related('column1', 'column2')}
UNION ALL SELECT DISTINCT 'segment ' || "column" || ': ' || value, 'segment', 'info', 70, "column" FROM seg)"""
ORACLES["deep_insights"] = f"WITH {DEEP} SELECT * FROM deep"
ACTION = """CASE issue WHEN 'missing' THEN CASE WHEN percent > 50 THEN 'drop_column' ELSE 'impute_or_filter' END WHEN 'suspicious' THEN 'verify_rounding'
 WHEN 'outlier' THEN 'review_values' WHEN 'many_values' THEN 'check_cardinality' WHEN 'near_duplicate' THEN 'unify_spelling' WHEN 'duplicate' THEN 'deduplicate_rows' END"""
ORACLES["recommendations"] = f"""WITH {DEEP}
SELECT CASE severity WHEN 'critical' THEN 'high' ELSE 'medium' END AS priority, issue AS reason, coalesce("column", '') AS columns, {ACTION} AS action
FROM issues WHERE severity IN ('critical', 'warning')
UNION ALL SELECT 'medium', insight, columns, CASE insight WHEN 'anomalous_rows' THEN 'inspect_rows' WHEN 'dominated' THEN 'drop_column' ELSE 'test_causality' END
FROM deep WHERE (type IN ('anomaly', 'pattern') AND severity = 'warning') OR (type = 'correlation' AND severity = 'success')
UNION ALL SELECT 'high', 'quality_score_' || score, '', 'clean_data' FROM score WHERE score < 70"""

# --- full report: the same results as the single operators, on events ---------------------------------------------

PART = "events"
PART_NUMBERS = ["event_id", "user_id", "value"]
ORACLES["full_report_numeric"] = numeric_stats_sql(PART, PART_NUMBERS).replace("round(s, 1)", "round(s, 4)").replace("round(skew, 5)", "round(skew, 4)")
ORACLES["full_report_categorical"] = categorical_sql(PART, ["ts", "event_type", "props"])
ORACLES["full_report_correlations"] = matrix_sql(PART, PART_NUMBERS).replace("round(r, 6)", "round(r, 4)")
ORACLES["full_report_outliers"] = iqr_sql(PART, PART_NUMBERS, ["event_id"]).replace(", 5)", ", 4)")
ORACLES["full_report_trends"] = trend_sql([(PART, "1", c, "event_id") for c in PART_NUMBERS], "").replace(", 5)", ", 4)")
PART_COLUMNS = ["event_id", "ts", "user_id", "event_type", "value", "props"]
PART_QUALITY = quality_ctes(PART, PART_COLUMNS, PART_NUMBERS)
ORACLES["full_report_notes"] = notes_sql(PART, PART_COLUMNS, PART_NUMBERS)
ORACLES["full_report_quality"] = f"WITH {PART_QUALITY} SELECT score, {BAND} AS band FROM score"
ORACLES["full_report_issues"] = f"""WITH {PART_QUALITY} SELECT issue, "column", severity, affected_count, round(percent, 4) AS percent, {ACTION} AS suggestion FROM issues"""
PART_SERIES = series_cte([(PART, "1", c, "event_id") for c in PART_NUMBERS])
ORACLES["full_report_hypotheses"] = f"""WITH {correlation_hypotheses(PART, PART_NUMBERS, PART_COLUMNS)}, {group_hypotheses(PART, ['event_type'], PART_NUMBERS)},
{anomaly_hypotheses(PART, PART_NUMBERS)}, {PART_SERIES}, {TREND}, htrend AS ({trend_hypotheses()}),
every AS (SELECT * EXCLUDE (k) FROM hcorr UNION ALL SELECT * FROM hgroup UNION ALL SELECT * FROM hanom UNION ALL SELECT * FROM htrend)
SELECT {SHOWN} FROM every"""
ORACLES["full_report_overview"] = f"""SELECT count(*) AS rows, 6 AS columns, 3 AS numeric_columns, 2 AS categorical_columns,
count(*) > 1000 AND count(*) * 6 = count(event_id) + count(ts) + count(user_id) + count(event_type) + count(value) + count(props) AS suspiciously_clean FROM {PART} q"""
ORACLES["full_report_kpis"] = f"""WITH {series_cte([(PART, "1", "value", "event_id")])}, {TREND}, w AS (SELECT * FROM u WHERE {KEPT})
SELECT 'total_records' AS kpi, NULL AS "column", CAST(count(*) AS DOUBLE) AS value, CAST(NULL AS DOUBLE) AS change, NULL AS change_type FROM events
UNION ALL SELECT 'total', 'value', round(sum(value), 4), round((SELECT chg FROM w) / 100, 4),
  (SELECT CASE dir WHEN 'up' THEN 'increase' WHEN 'down' THEN 'decrease' ELSE 'neutral' END FROM w) FROM events
UNION ALL SELECT 'average', 'value', round(avg(value), 4), NULL, NULL FROM events
UNION ALL SELECT 'unique', 'ts', count(DISTINCT ts), NULL, NULL FROM events"""


ORDER_TOTALS = """SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total, strftime(min(o_orderdate), '%Y-%m-%d') AS first_date,
max(o_custkey) AS last_customer, count(DISTINCT o_orderpriority) AS priorities FROM orders GROUP BY 1"""
for _name in ("read_json_root_array", "read_json_at_path", "read_json_first_array"):
    ORACLES[_name] = ORDER_TOTALS
ORACLES["export_data"] = "SELECT *, 'csv' AS kind FROM customer UNION ALL SELECT *, 'json' FROM customer"
ORACLES["streaming_profile_batches"] = ORACLES["streaming_profile"]
ORACLES["dataset_summary_columns"] = ORACLES["column_nulls_uniques"]
ORACLES["write_report_results"] = f"""WITH {quality_ctes("orders", COLUMNS["orders"], ["o_orderkey", "o_custkey", "o_totalprice"])}
SELECT issue, "column", severity, affected_count, round(percent, 4) AS percent FROM issues
UNION ALL SELECT 'data', NULL, NULL, count(DISTINCT o_orderkey), NULL FROM orders"""
ORACLES["full_profile_lineitem"] = "WITH " + ",\n".join(stats_cte(f"z{i}", "lineitem", c) for i, c in enumerate(LINEITEM_NUMBERS)) + "\n" + union([
    *[f"SELECT '{c}' AS name, 'median' AS fact, round(median({c}), 4) AS value FROM lineitem" for c in LINEITEM_NUMBERS],
    *[f"SELECT '{c}', 'distinct', CAST(count(DISTINCT {c}) AS DOUBLE) FROM lineitem" for c in ("l_returnflag", "l_linestatus", "l_shipdate")],
    f"SELECT column1 || ',' || column2, 'correlation', round(r, 4) FROM ({pairs_sql('lineitem', LINEITEM_NUMBERS)}) WHERE r IS NOT NULL",
    *[f"""SELECT '{c}', 'outliers', CAST(count(*) FILTER ({c} < p25 - 1.5 * (p75 - p25) OR {c} > p75 + 1.5 * (p75 - p25)) AS DOUBLE) FROM lineitem, z{i}"""
      for i, c in enumerate(LINEITEM_NUMBERS)],
    "SELECT 'rows', 'duplicates', CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem)) AS DOUBLE) FROM lineitem"])
