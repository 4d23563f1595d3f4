"""SQL counterparts of the registered queries, over the tables the inputs are made from.

They restate the rules of ``catalog.inputs`` on plain columns and never see JSON.
"""

from __future__ import annotations

ORACLES: dict[str, str] = {}


def _status(condition: str) -> str:
    return f"CASE WHEN {condition} THEN 'accepted' ELSE 'rejected' END AS status"


# --- rows -------------------------------------------------------------------------------

_RECORD_LENGTH = (
    "length('{\"event_id\":' || event_id || ',\"event_type\":\"' || event_type || '\"}')"
)

ORACLES["json_row_filter"] = f"""
SELECT event_id,
       CASE WHEN event_id % 25 = 3 THEN {_RECORD_LENGTH} - 3 ELSE {_RECORD_LENGTH} END AS n
FROM events WHERE event_id % 5 IN (3, 4)
"""

ORACLES["row_count"] = "SELECT count(*) AS n_rows FROM events WHERE event_id % 5 IN (3, 4)"

ORACLES["malformed_rows"] = """
SELECT event_id,
       CASE WHEN event_id % 25 = 3 THEN 'malformed' ELSE 'accepted' END AS status
FROM events WHERE event_id % 5 IN (3, 4)
"""

ORACLES["row_kinds"] = """
SELECT l_orderkey AS key, CAST(l_linenumber AS BIGINT) AS no, m.member, CASE
         WHEN m.member <> 'lines' THEN 'number'
         WHEN l_linenumber % 4 = 0 THEN 'empty_array' ELSE 'array' END AS kind
FROM lineitem, (VALUES ('key'), ('no'), ('lines')) AS m(member)
"""

# Each value of a nested row: what it is, and how often it occurs in it.
_NESTED_VALUES = """
WITH r AS (SELECT l_orderkey AS key, l_linenumber % 4 AS n,
                  CASE WHEN l_orderkey % 9 = 0 AND l_linenumber % 4 > 0 THEN 1 ELSE 0 END AS nulls
           FROM lineitem),
v AS (
  SELECT key, '$' AS path, 'object' AS kind, 1 AS n FROM r
  UNION ALL SELECT key, '$.key', 'number', 1 FROM r
  UNION ALL SELECT key, '$.no', 'number', 1 FROM r
  UNION ALL SELECT key, '$.lines', CASE WHEN n = 0 THEN '{empty}' ELSE 'array' END, 1 FROM r
  UNION ALL SELECT key, '$.lines[*]', 'object', n FROM r
  UNION ALL SELECT key, '$.lines[*].no', 'number', n FROM r
  UNION ALL SELECT key, '$.lines[*].qty', 'number', n FROM r
  UNION ALL SELECT key, '$.lines[*].flag', 'string', n - nulls FROM r
  UNION ALL SELECT key, '$.lines[*].flag', 'null', nulls FROM r)
"""

ORACLES["row_paths"] = (
    _NESTED_VALUES.replace("{empty}", "empty_array")
    + "SELECT key, path, kind, CAST(sum(n) AS BIGINT) AS n FROM v"
    + " WHERE n > 0 GROUP BY key, path, kind"
)

ORACLES["row_paths_plain"] = (
    _NESTED_VALUES.replace("{empty}", "array")
    + "SELECT path, kind, CAST(sum(n) AS BIGINT) AS n FROM v WHERE n > 0 GROUP BY path, kind"
)

ORACLES["row_leaves"] = """
WITH l AS (
  SELECT p.path FROM events,
       (VALUES ('$.event_id'), ('$.user'), ('$.etype'), ('$.value')) AS p(path)
  UNION ALL SELECT CASE WHEN event_id % 17 = 0 THEN '$.props' ELSE '$.props.k' END FROM events
  UNION ALL SELECT p.path FROM events,
       (VALUES ('$.ext.a'), ('$.ext.b[*].c'), ('$.ext.b[*]')) AS p(path) WHERE event_id % 10 = 0
  UNION ALL SELECT '$.ext.' || event_type FROM events WHERE event_id % 10 = 0
  UNION ALL SELECT p.path FROM customer, (VALUES ('$.cust'), ('$.seg'), ('$.bal')) AS p(path)
  UNION ALL SELECT '$.name' FROM customer WHERE c_custkey % 12 <> 0
  UNION ALL SELECT p.path FROM conversations,
       (VALUES ('$.conv'), ('$.turn'), ('$.text')) AS p(path)
  UNION ALL SELECT '$.role' FROM conversations WHERE turn % 3 <> 0)
SELECT path, count(*) AS n_rows FROM l GROUP BY path
"""

# --- verdicts ---------------------------------------------------------------------------

ORACLES["validate_flat"] = f"""
SELECT o_orderkey AS key, {_status("o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0")} FROM orders
"""

ORACLES["validate_required"] = f"""
SELECT o_orderkey AS key,
       {_status("o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0")}
FROM orders
"""

ORACLES["validate_open_object"] = f"""
SELECT o_orderkey AS key, {_status("o_orderkey % 11 <> 0")} FROM orders
"""

ORACLES["validate_max_properties"] = f"""
SELECT o_orderkey AS key,
       {_status("o_orderkey % 7 = 0 AND o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0")}
FROM orders
"""

ORACLES["validate_empty_object"] = """
SELECT event_id, event_id % 17 <> 0 AS closed_ok, true AS open_ok, event_id % 17 = 0 AS bare_ok
FROM events
"""

ORACLES["validate_arrays"] = f"""
SELECT l_orderkey AS key, CAST(l_linenumber AS BIGINT) AS no,
       {_status("l_linenumber % 4 = 0 OR l_orderkey % 9 <> 0")}
FROM lineitem
"""

ORACLES["validate_max_items"] = """
SELECT l_orderkey AS key, CAST(l_linenumber AS BIGINT) AS no,
       l_linenumber % 4 <= 2 AS within_items, l_linenumber % 4 <= 2 AS within_properties
FROM lineitem
"""

# Mixed rows, whether they fail, and to what entity and number of paths they are charged.
_MIXED = """
WITH mixed AS (
  SELECT 'e' || event_id AS id, event_id % 10 = 0 AS fails, 0 AS entity_idx, 4 AS n_paths
  FROM events
  UNION ALL SELECT 'c' || c_custkey, c_custkey % 12 = 0, 1, 0 FROM customer
  UNION ALL SELECT 't-' || conv_id || '-' || turn, turn % 3 = 0, 2, 0 FROM conversations),
paths AS (
  SELECT 0 AS entity_idx, p.path FROM
       (VALUES ('$.ext.a'), ('$.ext.b[*].c'), ('$.ext.b[*]')) AS p(path)
  WHERE EXISTS (SELECT 1 FROM events WHERE event_id % 10 = 0)
  UNION SELECT 0, '$.ext.' || event_type FROM events WHERE event_id % 10 = 0)
"""

ORACLES["validate_anyof"] = f"{_MIXED} SELECT id, {_status('NOT fails')} FROM mixed"
ORACLES["validate_wide"] = ORACLES["validate_anyof"]

ORACLES["validate_oneof"] = """
SELECT 'c' || c_custkey AS id,
       c_custkey % 12 <> 0 AND c_custkey % 9 <> 0 AS number_only,
       c_custkey % 12 <> 0 AS number_or_null, c_custkey % 12 <> 0 AS any_of_both
FROM customer
"""

ORACLES["validate_nested_by_joins"] = f"""
SELECT {_status("l_linenumber % 4 <= 2")}, count(*) AS n_rows FROM lineitem GROUP BY 1
"""

ORACLES["strong_checks"] = """
SELECT CAST(sum(CASE WHEN l_linenumber % 4 > 2 THEN 1 ELSE 0 END) AS BIGINT) AS array_max,
       CAST(0 AS BIGINT) AS array_type,
       CAST(sum(CASE WHEN l_linenumber % 4 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS text_type
FROM lineitem
"""

# --- issues and totals ------------------------------------------------------------------

ORACLES["failing_rows"] = f"{_MIXED} SELECT id FROM mixed WHERE fails"

ORACLES["missing_paths"] = (
    f"{_MIXED} SELECT CAST(entity_idx AS BIGINT) AS entity_idx, path FROM paths"
)

ORACLES["required_edits"] = f"{_MIXED} SELECT count(*) AS required_edits FROM paths"

ORACLES["best_entity"] = f"""{_MIXED}
SELECT id, CAST(entity_idx AS BIGINT) AS entity_idx, CAST(n_paths AS BIGINT) AS n_paths
FROM mixed WHERE fails
"""

ORACLES["schema_summary"] = f"""{_MIXED}
SELECT count(*) AS total, CAST(sum(CASE WHEN fails THEN 0 ELSE 1 END) AS BIGINT) AS accepted,
       CAST(sum(CASE WHEN fails THEN 1 ELSE 0 END) AS BIGINT) AS wrong,
       CAST(0 AS BIGINT) AS malformed,
       CAST(sum(CASE WHEN fails THEN 0 ELSE 1 END) AS DOUBLE) / count(*) AS share,
       (SELECT count(*) FROM paths) AS required_edits
FROM mixed
"""

ORACLES["summary_wide"] = ORACLES["schema_summary"]

ORACLES["summary_deep"] = """
WITH v AS (
  SELECT o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0 AS ok, o_orderkey % 13 = 0 AS note FROM orders)
SELECT count(*) AS total, count(*) FILTER (ok) AS accepted, count(*) FILTER (NOT ok) AS wrong,
       CAST(0 AS BIGINT) AS malformed, CAST(count(*) FILTER (ok) AS DOUBLE) / count(*) AS share,
       CAST(max(CASE WHEN note THEN 1 ELSE 0 END) AS BIGINT) AS required_edits
FROM v
"""

ORACLES["schema_summaries"] = """
WITH v AS (
  SELECT 'closed' AS name, o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0 AS ok,
         o_orderkey % 13 = 0 AS note FROM orders
  UNION ALL SELECT 'all_required',
         o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0,
         o_orderkey % 13 = 0 FROM orders
  UNION ALL SELECT 'open', o_orderkey % 11 <> 0, false FROM orders)
SELECT name, count(*) AS total, CAST(sum(CASE WHEN ok THEN 1 ELSE 0 END) AS BIGINT) AS accepted,
       CAST(sum(CASE WHEN ok THEN 0 ELSE 1 END) AS BIGINT) AS wrong,
       CAST(0 AS BIGINT) AS malformed,
       CAST(sum(CASE WHEN ok THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS share,
       CAST(max(CASE WHEN note THEN 1 ELSE 0 END) AS BIGINT) AS required_edits
FROM v GROUP BY name
"""

# --- logs and schema documents ----------------------------------------------------------

_RUNS = """
WITH runs AS (
  SELECT 'o' || o_orderkey AS path, 'o' || o_orderkey % 50 || '.log' AS file, rec, o_orderkey AS key, o_custkey AS cust,
         o_orderstatus AS status, (o_orderkey + rec) % 4 AS turn
  FROM orders, (VALUES (CAST(0 AS BIGINT)), (1), (2)) AS r(rec) WHERE rec <= o_orderkey % 3),
lines AS (
  SELECT *, '{"inputFile":"in' || cust || '","TotalTime":"' || key || '",'
         || CASE WHEN turn IN (0, 3) THEN '"TrainPercent":"1.0",'
                 WHEN turn = 1 THEN '"TrainPercent":"0.5",' ELSE '' END
         || '"ValidationSize":' || cust || ',"Seed":"'
         || CASE WHEN turn = 0 THEN 'None' ELSE CAST(rec AS VARCHAR) END || '"}' AS info_line,
         '{"type":"object","properties":{"' || status || '":{"type":"'
         || CASE WHEN rec = 0 THEN 'string' ELSE 'number' END || '"}}}' AS schema_json
  FROM runs)
"""

ORACLES["schema_log_pairs"] = f"{_RUNS} SELECT path, file, rec, info_line, schema_json FROM lines"

ORACLES["first_schemas"] = f"{_RUNS} SELECT path, file, schema_json FROM lines WHERE rec = 0"

ORACLES["run_filter"] = f"""{_RUNS}
SELECT path, file, rec, 'in' || cust AS input_file, CAST(key AS VARCHAR) AS total_time,
       CAST(1.0 AS DOUBLE) AS train_percent, CAST(cust AS BIGINT) AS validation_size,
       CASE WHEN turn = 3 THEN CAST(rec AS BIGINT) END AS seed
FROM lines WHERE turn IN (0, 3)
"""

# Properties of the schema of an order, and what sets the orders apart.
_ORDER_SCHEMAS = """
WITH props AS (
  SELECT l_orderkey AS id, l_linenumber AS no, min(l_returnflag) AS flag,
         min(l_linestatus) = 'F' AS req
  FROM lineitem GROUP BY l_orderkey, l_linenumber),
schemas AS (SELECT id, count(*) AS n, id % 4 = 0 AS two, id % 8 = 0 AS is_open
            FROM props GROUP BY id)
"""

ORACLES["schema_node_table"] = f"""{_ORDER_SCHEMAS},
tops AS (
  SELECT id, '$' AS path, CASE WHEN two THEN 'anyOf' ELSE 'root' END AS edge, 'object' AS type,
         CASE WHEN two THEN 1 ELSE 0 END AS depth, n AS n_props, false AS req, is_open FROM schemas
  UNION ALL SELECT id, '$', 'root', NULL, 0, 0, false, false FROM schemas WHERE two
  UNION ALL SELECT id, '$', 'anyOf', 'object', 1, 1, false, is_open FROM schemas WHERE two
  UNION ALL SELECT id, '$.other', 'prop', 'string', 2, 0, false, false FROM schemas WHERE two
  UNION ALL SELECT id, '$.l' || no, 'prop',
         CASE flag WHEN 'R' THEN 'object' WHEN 'A' THEN 'number' END,
         CASE WHEN id % 4 = 0 THEN 2 ELSE 1 END, CASE WHEN flag = 'R' THEN 2 ELSE 0 END,
         req, false FROM props
  UNION ALL SELECT id, '$.l' || no || '.' || k.key, 'prop', k.type,
         CASE WHEN id % 4 = 0 THEN 3 ELSE 2 END, 0, false, false
  FROM props, (VALUES ('x', 'string'), ('y', 'number')) AS k(key, type) WHERE flag = 'R'
  UNION ALL SELECT id, '$.l' || no, 'oneOf', k.type,
         CASE WHEN id % 4 = 0 THEN 3 ELSE 2 END, 0, false, false
  FROM props, (VALUES ('string'), ('null')) AS k(type) WHERE flag = 'N')
SELECT id AS schema_id, path, edge, type, CAST(depth AS BIGINT) AS depth,
       CAST(n_props AS BIGINT) AS n_props, req AS key_is_required, is_open AS additional
FROM tops
"""

ORACLES["precision"] = f"""{_ORDER_SCHEMAS},
shapes AS (
  SELECT id, CAST(product(CASE flag WHEN 'R' THEN CASE WHEN req THEN 4 ELSE 8 END
                                    WHEN 'A' THEN CASE WHEN req THEN 1 ELSE 2 END
                                    ELSE CASE WHEN req THEN 2 ELSE 3 END END) AS BIGINT) AS p
  FROM props GROUP BY id)
SELECT id AS schema_id,
       CAST(p + CASE WHEN id % 8 = 0 THEN 1 WHEN id % 4 = 0 THEN 2 ELSE 0 END AS VARCHAR)
         AS precision
FROM shapes
"""

ORACLES["precision_open"] = (
    f"{_ORDER_SCHEMAS} SELECT id AS schema_id, '/a1' AS sid FROM schemas WHERE is_open"
)

ORACLES["grouping"] = f"""{_ORDER_SCHEMAS}
SELECT id AS schema_id, CAST(CASE WHEN two THEN 2 ELSE 1 END AS BIGINT) AS grouping FROM schemas
"""

ORACLES["base_size"] = f"""{_ORDER_SCHEMAS}
SELECT id AS schema_id, CAST(CASE WHEN two THEN 2 ELSE 1 END AS BIGINT) AS base_size FROM schemas
"""

ORACLES["attribute_count"] = f"""{_ORDER_SCHEMAS}
SELECT id AS schema_id, CAST(sum(CASE WHEN flag = 'R' THEN 2 ELSE 1 END)
         + max(CASE WHEN id % 4 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS attributes
FROM props GROUP BY id
"""

_ATTRIBUTES = """,
attributes AS (
  SELECT id, 'l' || no || CASE WHEN flag = 'R' THEN k.leaf ELSE '' END AS name, req
  FROM props, (VALUES ('/x'), ('/y')) AS k(leaf) WHERE flag = 'R' OR k.leaf = '/x')
"""

ORACLES["attribute_set"] = f"""{_ORDER_SCHEMAS} {_ATTRIBUTES}
SELECT id AS schema_id, name FROM attributes
UNION ALL SELECT id, 'other' FROM schemas WHERE two
"""

ORACLES["attribute_diff"] = f"""{_ORDER_SCHEMAS} {_ATTRIBUTES}
SELECT id AS schema_id, name FROM attributes WHERE NOT req
"""

ORACLES["nested_entity_lint"] = """
SELECT o_orderkey AS schema_id, '$.arr[*]' AS path FROM orders WHERE o_orderkey % 3 = 0
"""

# --- distances --------------------------------------------------------------------------

def _supplier_file(number: str) -> str:
    return (
        f"'s' || {number} || '.' || CASE {number} % 4 WHEN 0 THEN 'baazizi' WHEN 1 THEN 'bimax'"
        " WHEN 2 THEN 'kmeans' ELSE 'hier' END || '.log'"
    )


# Path sets of the schemas of suppliers, by entity, and of nations.
_PATH_SETS = f"""
WITH sold AS (
  SELECT DISTINCT l_suppkey AS s, p_brand AS brand, p_type AS type,
         CASE WHEN l_suppkey % 5 = 0 THEN CAST(substr(p_brand, 7) AS INTEGER) % 2 ELSE 0 END AS b
  FROM lineitem JOIN part ON l_partkey = p_partkey),
entities AS (SELECT s, b, row_number() OVER (PARTITION BY s ORDER BY b) - 1 AS e
             FROM (SELECT DISTINCT s, b FROM sold)),
tests AS (
  SELECT {_supplier_file("s")} AS test, e, path
  FROM (SELECT s, b, '$' AS path FROM sold UNION SELECT s, b, '$.' || brand FROM sold
        UNION SELECT s, b, '$.' || brand || '.' || type FROM sold) JOIN entities USING (s, b)),
lots AS (
  SELECT DISTINCT CASE WHEN s_suppkey % 20 = 1 THEN s_suppkey + 100 ELSE s_nationkey END AS n,
         p_type AS type,
         p_brand || CASE WHEN p_size % 2 = 0 OR s_suppkey % 20 = 1 THEN '' ELSE 'o' END AS brand
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey),
truths AS (
  SELECT CASE WHEN n % 5 = 0 THEN {_supplier_file("n")} ELSE 'n' || n || '.groundtruth.log' END AS truth,
         path
  FROM (SELECT n, '$' AS path FROM lots UNION SELECT n, '$.' || brand FROM lots
        UNION SELECT n, '$.' || brand || '.' || type FROM lots))
"""

_DISTANCES = _PATH_SETS + """,
sizes AS (
  SELECT t.test, t.e, g.truth, t.n AS n_test, g.n AS n_truth, coalesce(c.n, 0) AS n_both
  FROM (SELECT test, e, count(*) AS n FROM tests GROUP BY test, e) t
  CROSS JOIN (SELECT truth, count(*) AS n FROM truths GROUP BY truth) g
  LEFT JOIN (SELECT test, e, truth, count(*) AS n FROM tests JOIN truths USING (path)
             GROUP BY test, e, truth) c ON c.test = t.test AND c.e = t.e AND c.truth = g.truth),
distances AS (
  SELECT test, truth, split_part(test, '.', 2) AS algorithm, split_part(truth, '.', 1) AS dataset,
         CAST(min({d}) AS BIGINT) AS d
  FROM sizes WHERE test <> truth GROUP BY test, truth)
"""

_SYMMETRIC = _DISTANCES.replace("{d}", "n_test + n_truth - 2 * n_both")
_SUB = _DISTANCES.replace("{d}", "CASE WHEN n_both = n_truth THEN 1 ELSE 0 END")
_COLUMNS = " SELECT test, truth, algorithm, dataset, d FROM distances"

ORACLES["schema_path_set"] = (
    _PATH_SETS + " SELECT test AS file, CAST(e AS BIGINT) AS entity_idx, path FROM tests"
)
ORACLES["distance_symmetric"] = _SYMMETRIC + _COLUMNS
ORACLES["distance_diff"] = _DISTANCES.replace("{d}", "n_test - n_both") + _COLUMNS
ORACLES["distance_sub"] = _SUB + _COLUMNS

ORACLES["distance_report"] = _SYMMETRIC + """
SELECT algorithm AS fragment, test,
       string_agg(CAST(d AS VARCHAR), ' & ' ORDER BY truth) AS line
FROM distances GROUP BY algorithm, test
"""

ORACLES["distance_cells"] = _SYMMETRIC + """
SELECT algorithm AS fragment, d,
       row_number() OVER (PARTITION BY algorithm ORDER BY test, truth) - 1 AS position
FROM distances
"""

ORACLES["distance_lines"] = _SYMMETRIC + """,
lines AS (SELECT algorithm, string_agg(CAST(d AS VARCHAR), ' & ' ORDER BY test, truth) AS line
          FROM distances GROUP BY algorithm)
SELECT fragment, coalesce(line, '') AS line
FROM (VALUES ('baazizi'), ('bimax'), ('kmeans'), ('hier')) AS f(fragment)
LEFT JOIN lines ON algorithm = fragment
"""

ORACLES["subset_report"] = _SUB + """
SELECT test, truth, dataset || ' subset of ' || algorithm AS line FROM distances WHERE d = 1
"""

ORACLES["precision_large"] = _PATH_SETS.replace("WITH sold", "WITH RECURSIVE sold") + """,
powers AS (
  SELECT t.test AS file, t.e,
         sum(CASE WHEN length(path) - length(replace(path, '.', '')) > 0 THEN 1 ELSE 0 END) AS p
  FROM tests t GROUP BY t.test, t.e),
totals AS (SELECT file, max(p) + log2(sum(pow(2.0, p - m))) AS l
           FROM (SELECT *, max(p) OVER (PARTITION BY file) AS m FROM powers) GROUP BY file),
twos AS (
  SELECT 0 AS p, CAST(1 AS BIGINT) AS v
  UNION ALL SELECT p + 1, v * 2 % 1000000000 FROM twos WHERE p < (SELECT max(p) FROM powers)),
endings AS (SELECT file, CAST(sum(v) % 1000000000 AS BIGINT) AS last_digits
            FROM powers JOIN twos USING (p) GROUP BY file)
SELECT file, round(l, 6) AS log2_precision,
       CAST(floor(l * log10(2)) + 1 AS BIGINT) AS n_digits, last_digits
FROM totals JOIN endings USING (file)
"""

# --- splits and whole evaluations -------------------------------------------------------


def _draw(seed: int) -> str:
    return (
        f"CAST(CAST('0x' || substr(md5('{seed}|' || o_orderkey), 1, 7) AS BIGINT) AS DOUBLE)"
        " / 268435456.0"
    )


# Size of the parts as shares of all rows: one percent, and a quarter in whole rows.
_SHARES = """(SELECT n * 0.01 / n AS t, (n * 0.01 + n // 4) / n AS tv
              FROM (SELECT CAST(count(*) AS DOUBLE) AS n FROM orders))"""
_SHARES = _SHARES.replace("n // 4", "floor(n / 4)")

ORACLES["split_buckets"] = f"""
SELECT o_orderkey AS key, CASE WHEN {_draw(42)} < t THEN 'train'
         WHEN {_draw(42)} < tv THEN 'validation' ELSE 'overflow' END AS part
FROM orders, {_SHARES} AS shares
"""


def _run(name: str, seed: int, time: int, fails: str, edits: str, precision: int) -> str:
    return f"""
  SELECT '{name}' AS run_id, {seed} AS seed, {time} AS time, {precision} AS prec,
         count(*) AS n, sum(CASE WHEN {fails} THEN 1 ELSE 0 END) AS wrong,
         max(CASE WHEN {edits} THEN 1 ELSE 0 END) AS edits
  FROM orders, {_SHARES} AS shares WHERE {_draw(seed)} >= t AND {_draw(seed)} < tv"""


ORACLES["evaluate_log_runs"] = (
    "WITH r AS ("
    + " UNION ALL ".join(
        [
            _run("run1", 6, 10, "o_orderkey % 11 = 0 OR o_orderkey % 13 = 0",
                 "o_orderkey % 13 = 0", 2),
            _run("run2", 7, 20, "o_orderkey % 7 = 0 OR o_orderkey % 11 = 0 OR o_orderkey % 13 = 0",
                 "o_orderkey % 13 = 0", 1),
            _run("run3", 8, 30, "o_orderkey % 11 = 0", "false", 1),
        ]
    )
    + """)
SELECT run_id, '{"ValidationSizeActual":"' || n || '","Validation":"'
       || CAST(CAST(n - wrong AS DOUBLE) / n AS VARCHAR)
       || '","RequiredEdits":"' || edits || '.0","TotalWrong":"' || wrong
       || '.0","inputFile":"orders","TotalTime":"' || time || '","TrainPercent":"1.0",'
       || '"ValidationSize":"' || (SELECT count(*) // 4 FROM orders) || '","Seed":"Some('
       || seed || ')","Precision":"' || prec || '","Grouping":"1","BaseSchemaSize":"1"}' AS value
FROM r
"""
)
