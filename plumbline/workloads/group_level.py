"""Group checks, comparisons between tables, and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import (
    content, cycles, differences, grouped_checks, hierarchy, metrics, near_records, row_checks,
)
from plumbline.operators import relational_checks as rel
from plumbline.operators import schema_checks, stat_checks
from plumbline.operators.change_order import order_violations
from plumbline.workloads import derive as d
from plumbline.workloads.registry import workload


@workload("chk02_pk", """SELECT l_orderkey AS record_id, COUNT(*) AS occurrences FROM lineitem
GROUP BY l_orderkey HAVING COUNT(*) > 1""")
def chk02_pk(t):
    return grouped_checks.repeated_keys(t["lineitem"], "l_orderkey")


@workload("chk02_null_key", f"""WITH {d.FLAGGED}
SELECT flag AS record_id, COUNT(*) AS occurrences FROM flagged GROUP BY flag HAVING COUNT(*) > 1""")
def chk02_null_key(t):
    return grouped_checks.repeated_keys(d.flagged_lines(t), "flag")


@workload("chk03_dup", """SELECT l_orderkey, l_linenumber, COUNT(*) AS dup_count FROM lineitem
WHERE l_linestatus = 'O' GROUP BY l_orderkey, l_linenumber HAVING COUNT(*) > 1""")
def chk03_dup(t):
    return grouped_checks.duplicate_records(t["lineitem"], ["l_orderkey", "l_linenumber"], "l_linestatus = 'O'")


@workload("chk03_text_dup", """SELECT text, COUNT(*) AS dup_count FROM documents GROUP BY text HAVING COUNT(*) > 1""")
def chk03_text_dup(t):
    return grouped_checks.duplicate_records(t["documents"], ["text"], wide=True)


@workload("chk04_fk", f"""WITH child AS (SELECT {d.CUSTKEY} AS custkey FROM orders)
SELECT custkey AS record_id, custkey AS failed_value FROM child
WHERE custkey IS NOT NULL AND custkey NOT IN (SELECT c_custkey FROM customer)""")
def chk04_fk(t):
    return rel.orphans(t["orders"].select(d.both(d.CUSTKEY).alias("custkey")), "custkey", t["customer"], "c_custkey")


@workload("chk04_counts", """SELECT l_orderkey AS orderkey, COUNT(*) AS n FROM lineitem
WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F') GROUP BY l_orderkey""")
def chk04_counts(t):
    lines = t["lineitem"].select(F.col("l_orderkey").alias("orderkey"))
    return rel.orphan_counts(lines, "orderkey", t["orders"].where("o_orderstatus <> 'F'"), "o_orderkey")


@workload("chk04_unlabelled", """SELECT doc_id AS record_id, doc_id AS failed_value FROM documents
WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def chk04_unlabelled(t):
    return rel.orphans(t["documents"], "doc_id", t["labels"], "doc_id")


@workload("chk15_skew", """SELECT event_type AS failed_value, COUNT(*) AS group_count,
  ROUND(COUNT(*) * 100.0 / (SELECT COUNT(*) FROM events), 2) AS pct FROM events
GROUP BY event_type HAVING COUNT(*) * 100.0 / (SELECT COUNT(*) FROM events) > 20""")
def chk15_skew(t):
    return grouped_checks.skewed_values(t["events"], "event_type", 20)


@workload("m15_freq", """SELECT p_name, COUNT(*) AS freq, ROUND(COUNT(*) * 100.0 / SUM(COUNT(*)) OVER (), 2) AS pct
FROM part GROUP BY p_name""")
def m15_freq(t):
    return metrics.frequencies(t["part"], "p_name")


ZSCORE = """stats AS (SELECT AVG(value) AS m, STDDEV_SAMP(value) AS s FROM events)"""


@workload("chk16_zscore", f"""WITH {ZSCORE}
SELECT event_id AS record_id, value AS failed_value, ROUND((value - m) / NULLIF(s, 0), 2) AS z_score
FROM events, stats WHERE value IS NOT NULL AND ABS((value - m) / NULLIF(s, 0)) > 3""")
def chk16_zscore(t):
    return stat_checks.outliers(t["events"], "value", "event_id", 3)


@workload("m16_zscore", f"""WITH {ZSCORE}
SELECT value, ROUND(ABS(value - m) / NULLIF(s, 0), 4) AS z_score FROM events, stats
WHERE ABS(value - m) / NULLIF(s, 0) > 2.5""")
def m16_zscore(t):
    return stat_checks.outlier_distances(t["events"], "value", 2.5).withColumn("z_score", F.round("z_score", 4))


@workload("ext1_iqr", """WITH q AS (SELECT quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events)
SELECT event_id AS record_id, value AS failed_value FROM events, q
WHERE value < a - 1.5 * (b - a) OR value > b + 1.5 * (b - a)""")
def ext1_iqr(t):
    return stat_checks.interquartile_outliers(t["events"], "value", "event_id")


@workload("chk17_drift", f"""WITH {d.COLUMNS_NOW}, {d.SNAPSHOTS}
SELECT table_name, column_name AS record_id, 'ADDED' AS failed_value FROM columns_now c
WHERE NOT EXISTS (SELECT 1 FROM snapshots s WHERE s.table_name = c.table_name AND s.column_name = c.column_name)
UNION ALL SELECT table_name, column_name, 'REMOVED' FROM snapshots s
WHERE NOT EXISTS (SELECT 1 FROM columns_now c WHERE s.table_name = c.table_name AND s.column_name = c.column_name)""")
def chk17_drift(t):
    return schema_checks.changed_columns(d.current_columns(t), d.schema_snapshots(t))


@workload("m17_schema", f"WITH {d.COLUMNS_NOW} SELECT * FROM columns_now")
def m17_schema(t):
    return schema_checks.schema_listing(d.current_columns(t))


@workload("schema_snapshot", f"""WITH {d.COLUMNS_NOW}, {d.SNAPSHOTS}
SELECT (SELECT COUNT(*) FROM snapshots) + ROW_NUMBER() OVER (ORDER BY table_name, table_schema, ordinal_position, column_name) AS snapshot_id,
  table_name, column_name, ordinal_position, data_type, TIMESTAMP '2024-01-31 00:00:00' AS snapshot_at FROM columns_now""")
def schema_snapshot(t):
    """Snapshots to append to a table whose largest id is its row count."""
    stored = d.schema_snapshots(t).agg(F.count(F.lit(1)).alias("snapshot_id"))
    listing = d.current_columns(t).selectExpr(
        "'DW' AS table_catalog", "*", "NULL AS character_maximum_length", "NULL AS numeric_precision",
        "NULL AS numeric_scale", "'YES' AS is_nullable")
    return schema_checks.schema_snapshot(listing, stored, d.AS_OF).select(
        "snapshot_id", "table_name", "column_name", "ordinal_position", "data_type", "snapshot_at")


DRIFT = f"""{d.COLUMNS_NOW}, {d.SNAPSHOTS},
newest AS (SELECT table_schema, table_name, MAX(snapshot_at) AS snapshot_at FROM snapshots GROUP BY ALL),
base AS (SELECT s.* FROM snapshots s JOIN newest USING (table_schema, table_name, snapshot_at)),
now AS (SELECT * FROM columns_now WHERE (table_schema, table_name) IN (SELECT (table_schema, table_name) FROM newest)),
drift AS (
  SELECT table_schema, table_name, column_name,
    CASE WHEN b.data_type IS NULL THEN 'ADDED' WHEN n.data_type IS NULL THEN 'REMOVED'
      WHEN b.data_type <> n.data_type THEN 'TYPE_CHANGED' END AS drift,
    CASE WHEN n.data_type IS NULL THEN b.ordinal_position ELSE n.ordinal_position END AS position,
    b.data_type AS old_type, n.data_type AS new_type
  FROM now n FULL JOIN base b USING (table_schema, table_name, column_name))"""


@workload("drift_report", f"""WITH {DRIFT}
SELECT table_schema, table_name, drift, column_name, position, old_type, new_type FROM drift WHERE drift IS NOT NULL""")
def drift_report(t):
    return schema_checks.drift(d.current_columns(t), d.schema_snapshots(t)).drop("drift_order")


DRIFT_SUMMARY = f"""WITH {DRIFT}, counts AS (
  SELECT table_schema, table_name, COUNT(*) AS drift_count,
    string_agg(drift || ':' || column_name, ', ' ORDER BY
      CASE drift WHEN 'ADDED' THEN 1 WHEN 'REMOVED' THEN 2 ELSE 3 END, position, column_name) AS drift_list
  FROM drift WHERE drift IS NOT NULL GROUP BY table_schema, table_name)
SELECT c.table_schema, c.table_name, n.snapshot_at AS baseline_at,
  CASE WHEN n.snapshot_at IS NULL THEN 'NO_BASELINE' WHEN drift_count > 0 THEN 'DRIFT_DETECTED' ELSE 'NO_DRIFT' END AS status,
  COALESCE(drift_count, 0) AS drift_count, COALESCE(drift_list, '') AS drift_list
FROM (SELECT DISTINCT table_schema, table_name FROM columns_now) c
LEFT JOIN newest n USING (table_schema, table_name) LEFT JOIN counts USING (table_schema, table_name)"""


@workload("drift_summary", DRIFT_SUMMARY)
def drift_summary(t):
    return schema_checks.drift_summary(d.current_columns(t), d.schema_snapshots(t))


@workload("ext9_renames", f"""WITH {DRIFT}
SELECT g.table_schema, g.table_name, g.position, g.old_type AS data_type, g.column_name AS old_name,
  a.column_name AS new_name
FROM drift g JOIN drift a ON g.table_schema = a.table_schema AND g.table_name = a.table_name
  AND g.position = a.position AND g.old_type = a.new_type
WHERE g.drift = 'REMOVED' AND a.drift = 'ADDED'""")
def ext9_renames(t):
    return schema_checks.renamed_columns(d.current_columns(t), d.schema_snapshots(t))


# A target that was loaded from the orders per day, with wrong days.
TARGET = """target AS (SELECT CAST(o_orderdate AS DATE) AS day, 'orders' AS source,
  COUNT(*) + MAX(CASE WHEN o_orderkey % 211 = 3 THEN 1 ELSE 0 END) AS row_total,
  SUM(CAST(o_totalprice AS DECIMAL(18,2))) + SUM(CAST(CASE WHEN o_orderkey % 199 = 2 THEN 5 ELSE 0 END AS DECIMAL(18,2))) AS amount
  FROM orders GROUP BY CAST(o_orderdate AS DATE))"""


def recon_target(t):
    return t["orders"].groupBy(F.to_date("o_orderdate").alias("day")).agg(
        (F.count(F.lit(1)) + F.max(d.both("CASE WHEN o_orderkey % 211 = 3 THEN 1 ELSE 0 END"))).alias("row_total"),
        (F.sum(F.col("o_totalprice").cast("decimal(18,2)"))
         + F.sum(d.both("CAST(CASE WHEN o_orderkey % 199 = 2 THEN 5 ELSE 0 END AS DECIMAL(18,2))"))).alias("amount"),
    ).withColumn("source", F.lit("orders"))


@workload("chk18_recon", f"""WITH {TARGET}, src AS (
  SELECT CAST(o_orderdate AS DATE) AS day, COUNT(*) AS src_count, SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS src_amount
  FROM orders WHERE o_orderdate IS NOT NULL GROUP BY CAST(o_orderdate AS DATE))
SELECT s.day AS record_id, src_count, CAST(src_amount AS DOUBLE) AS src_amount, CAST(t.row_total AS BIGINT) AS tgt_count,
  CAST(t.amount AS DOUBLE) AS tgt_amount, CAST(1 AS BIGINT) AS matches
FROM src s JOIN target t ON s.day = t.day
WHERE t.source = 'orders' AND (src_count <> t.row_total OR src_amount <> t.amount)""")
def chk18_recon(t):
    source = t["orders"].select(
        F.to_date("o_orderdate").alias("day"), F.col("o_totalprice").cast("decimal(18,2)").alias("price"))
    found = rel.reconcile(source, "day", "price", recon_target(t), "day", "row_total", "amount", "source = 'orders'")
    return found.withColumns({c: F.col(c).cast("double") for c in ("src_amount", "tgt_amount")})


@workload("m18_counts", """SELECT (SELECT COUNT(*) FROM lineitem) AS source_count,
  (SELECT COUNT(*) FROM orders) AS target_count""")
def m18_counts(t):
    return metrics.paired_row_counts(t["lineitem"], t["orders"])


@workload("ext6_sums", f"""WITH perturbed AS ({d.PERTURBED})
SELECT (SELECT COUNT(*) FROM orders) AS source_row_count,
  (SELECT CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) FROM orders) AS source_sum_price,
  (SELECT COUNT(*) FROM perturbed) AS target_row_count,
  (SELECT CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) FROM perturbed) AS target_sum_price,
  NOT EXISTS (FROM orders EXCEPT FROM perturbed) AS matches""")
def ext6_sums(t):
    def priced(df):
        return df.withColumn("price", F.col("o_totalprice").cast("decimal(18,2)"))

    found = rel.checksum_reconciliation(
        priced(t["orders"]), priced(d.perturbed_orders(t)), t["orders"].columns, ["price"])
    return found.select(
        "source_row_count", F.col("source_sum_price").cast("double").alias("source_sum_price"),
        "target_row_count", F.col("target_sum_price").cast("double").alias("target_sum_price"), "matches")


@workload("chk19_dup_file", """SELECT props AS record_id, props AS failed_value, COUNT(*) AS load_count FROM events
WHERE props IS NOT NULL GROUP BY props HAVING COUNT(*) > 1""")
def chk19_dup_file(t):
    return grouped_checks.repeated_files(t["events"], "props")


@workload("m19_dup_file", f"""WITH {d.FLAGGED}
SELECT flag AS record_id, flag AS failed_value, COUNT(*) AS load_count FROM flagged
GROUP BY flag HAVING COUNT(*) > 1""")
def m19_dup_file(t):
    return grouped_checks.repeated_files(d.flagged_lines(t), "flag", keep_unnamed=True)


@workload("m21_total", """SELECT l_orderkey, CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS computed_total,
  o_totalprice AS stated_total
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey, o_totalprice
HAVING ABS(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) - CAST(o_totalprice AS DECIMAL(18,2))) > 1000""")
def m21_total(t):
    lines = t["lineitem"].groupBy("l_orderkey").agg(
        F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("part"))
    orders = t["orders"].select("o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("stated"))
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    found = metrics.group_totals(joined, "l_orderkey", "part", "stated", 1000)
    return found.withColumns({c: F.col(c).cast("double") for c in ("computed_total", "stated_total")})


@workload("chk22_hier", f"""WITH {d.TREE}
SELECT e.p_partkey AS record_id, 'ORPHAN' AS failed_value, CAST(1 AS BIGINT) AS findings FROM tree e
WHERE e.parent IS NOT NULL AND e.parent NOT IN (SELECT p_partkey FROM tree)
UNION ALL SELECT a.p_partkey, 'CIRCULAR', 1 FROM tree a JOIN tree b ON a.parent = b.p_partkey WHERE b.parent = a.p_partkey""")
def chk22_hier(t):
    return rel.hierarchy_findings(d.part_tree(t), "p_partkey", "parent")


@workload("m22_unreachable", f"""WITH RECURSIVE {d.TREE}, hier AS (
  SELECT p_partkey, 1 AS depth FROM tree WHERE parent IS NULL
  UNION ALL SELECT t.p_partkey, h.depth + 1 FROM tree t JOIN hier h ON t.parent = h.p_partkey WHERE h.depth < 6)
SELECT p_partkey FROM tree WHERE p_partkey NOT IN (SELECT p_partkey FROM hier)""")
def m22_unreachable(t):
    return hierarchy.unreachable_nodes(d.part_tree(t), "p_partkey", "parent", 6)


@workload("ext5_depth", f"""WITH RECURSIVE {d.TREE}, hier AS (
  SELECT p_partkey, 1 AS depth FROM tree WHERE parent IS NULL
  UNION ALL SELECT t.p_partkey, h.depth + 1 FROM tree t JOIN hier h ON t.parent = h.p_partkey),
stray AS (
  SELECT p_partkey FROM tree WHERE parent IS NOT NULL AND parent NOT IN (SELECT p_partkey FROM tree)
  UNION ALL SELECT t.p_partkey FROM tree t JOIN stray s ON t.parent = s.p_partkey)
SELECT p_partkey, 'TOO_DEEP' AS finding, CAST(depth AS BIGINT) AS depth FROM hier WHERE depth > 6
UNION ALL SELECT p_partkey, 'NO_ROOT', NULL FROM stray
UNION ALL SELECT p_partkey, 'CYCLE', NULL FROM tree
WHERE p_partkey NOT IN (SELECT p_partkey FROM hier) AND p_partkey NOT IN (SELECT p_partkey FROM stray)""")
def ext5_depth(t):
    return hierarchy.depth_and_cycles(d.part_tree(t), "p_partkey", "parent", 6)


# Customers in rows of ten: each leads to the one before, the first of a row back to one of the row. Some lead to the
# same place of another row as well, so that cycles join and branches hang off.
RINGS = """rings AS (
  SELECT c_custkey AS node, CASE WHEN c_custkey % 10 = 0 THEN c_custkey + c_nationkey % 8 ELSE c_custkey - 1 END AS up FROM customer
  UNION ALL SELECT c_custkey, c_custkey - 30 FROM customer WHERE c_acctbal < 0
  UNION ALL SELECT c_custkey, c_custkey + 20 FROM customer WHERE c_acctbal > 9500
  UNION ALL SELECT c_custkey, NULL FROM customer WHERE c_custkey % 70 = 9)"""


def rings(t):
    first = t["customer"].selectExpr(
        "c_custkey AS node", "CASE WHEN c_custkey % 10 = 0 THEN c_custkey + c_nationkey % 8 ELSE c_custkey - 1 END AS up")
    back = t["customer"].where("c_acctbal < 0").selectExpr("c_custkey AS node", "c_custkey - 30 AS up")
    on = t["customer"].where("c_acctbal > 9500").selectExpr("c_custkey AS node", "c_custkey + 20 AS up")
    roots = t["customer"].where("c_custkey % 70 = 9").selectExpr("c_custkey AS node", "CAST(NULL AS BIGINT) AS up")
    return first.unionByName(back).unionByName(on).unionByName(roots)


REACHED = f"""{RINGS}, links AS (SELECT DISTINCT node, up FROM rings WHERE up IS NOT NULL),
reach AS (SELECT node, up FROM links UNION SELECT reach.node, links.up FROM reach JOIN links ON reach.up = links.node),
members AS (SELECT a.node, MIN(a.up) AS cycle_id, COUNT(*) AS members FROM reach a
  JOIN reach b ON a.up = b.node AND a.node = b.up GROUP BY a.node)"""


@workload("ext5_cycles", f"""WITH RECURSIVE {REACHED},
safe AS (SELECT node FROM rings WHERE up IS NULL OR up NOT IN (SELECT node FROM rings)
  UNION SELECT reach.node FROM reach WHERE up NOT IN (SELECT node FROM rings) OR up IN (SELECT node FROM rings WHERE up IS NULL))
SELECT node, 'CYCLE' AS finding, cycle_id, members FROM members
UNION ALL SELECT DISTINCT node, 'BRANCH', NULL, NULL FROM rings WHERE node NOT IN (SELECT node FROM members) AND node NOT IN (SELECT node FROM safe)""")
def ext5_cycles(t):
    return cycles.cycles_and_branches(rings(t), "node", "up")


@workload("chk23_multisource", """SELECT CAST(o_orderdate AS DATE) AS record_id, o_orderpriority AS failed_value,
  COUNT(*) AS entry_count, MIN(o_totalprice) AS min_val, MAX(o_totalprice) AS max_val FROM orders
WHERE o_orderpriority = '1-URGENT' AND o_orderdate IS NOT NULL
GROUP BY CAST(o_orderdate AS DATE), o_orderpriority HAVING COUNT(DISTINCT o_totalprice) > 1""")
def chk23_multisource(t):
    dated = t["orders"].withColumn("day", F.to_date("o_orderdate"))
    return grouped_checks.conflicting_amounts(dated, "day", "o_orderpriority", "1-URGENT", "o_totalprice")


@workload("m23_compare", f"""WITH perturbed AS ({d.PERTURBED})
SELECT a.o_orderkey, a.o_totalprice AS source_a_val, a.o_totalprice AS source_a_max, b.o_totalprice AS source_b_val,
  b.o_totalprice AS source_b_max, CAST(1 AS BIGINT) AS pairs
FROM orders a JOIN perturbed b ON a.o_orderkey = b.o_orderkey WHERE a.o_totalprice <> b.o_totalprice""")
def m23_compare(t):
    return rel.differing_values(t["orders"], d.perturbed_orders(t), "o_orderkey", "o_totalprice")


# Customers have several orders on either side, so a key stands for many differing pairs.
@workload("m23_values", f"""WITH perturbed AS ({d.PERTURBED}),
a AS (SELECT o_custkey AS k, o_totalprice AS v, COUNT(*) AS n FROM orders GROUP BY ALL),
b AS (SELECT o_custkey AS k, o_totalprice AS v, COUNT(*) AS n FROM perturbed GROUP BY ALL),
ta AS (SELECT k, SUM(n) AS t FROM a GROUP BY k), tb AS (SELECT k, SUM(n) AS t FROM b GROUP BY k),
each AS (SELECT a.k, 'A' AS side, a.v, a.n, tb.t - COALESCE(b.n, 0) AS pairs FROM a JOIN tb ON tb.k = a.k LEFT JOIN b ON b.k = a.k AND b.v = a.v
  UNION ALL SELECT b.k, 'B', b.v, b.n, ta.t - COALESCE(a.n, 0) FROM b JOIN ta ON ta.k = b.k LEFT JOIN a ON a.k = b.k AND a.v = b.v)
SELECT k AS o_custkey, side, v AS value, n AS occurrences, CAST(pairs AS BIGINT) AS pairs FROM each WHERE pairs > 0""")
def m23_values(t):
    return rel.differing_value_rows(t["orders"], d.perturbed_orders(t), "o_custkey", "o_totalprice")


@workload("m23_repeated", f"""WITH perturbed AS ({d.PERTURBED})
SELECT o_custkey, MIN(a.o_totalprice) AS source_a_val, MAX(a.o_totalprice) AS source_a_max, MIN(b.o_totalprice) AS source_b_val,
  MAX(b.o_totalprice) AS source_b_max, COUNT(*) FILTER (a.o_totalprice <> b.o_totalprice) AS pairs
FROM orders a JOIN perturbed b USING (o_custkey) GROUP BY o_custkey HAVING pairs > 0""")
def m23_repeated(t):
    return rel.differing_values(t["orders"], d.perturbed_orders(t), "o_custkey", "o_totalprice")


REPEATED = """(user_id, seq) IN (SELECT (user_id, seq) FROM change_log WHERE op <> 'X' GROUP BY user_id, seq HAVING COUNT(*) > 1)"""


@workload("chk25_cdc_dup", f"""WITH {d.CHANGE_LOG}
SELECT event_id AS record_id, seq AS failed_value FROM change_log WHERE {REPEATED} AND op <> 'D'""")
def chk25_cdc_dup(t):
    return rel.repeated_tuples(d.change_log(t), ["user_id", "seq"], "event_id", "seq", "op <> 'X'", "op <> 'D'")


@workload("chk25_dup_counts", f"""WITH {d.CHANGE_LOG}
SELECT user_id, seq, COUNT(*) FILTER (op <> 'X') AS in_group, COUNT(*) FILTER (op <> 'D') AS n FROM change_log
GROUP BY user_id, seq HAVING COUNT(*) FILTER (op <> 'X') > 1 AND COUNT(*) FILTER (op <> 'D') > 0""")
def chk25_dup_counts(t):
    return rel.repeated_tuple_counts(d.change_log(t), ["user_id", "seq"], "op <> 'X'", "op <> 'D'")


@workload("ext4_cdc_order", f"""WITH {d.CHANGE_LOG}, looked AS (
  SELECT *, LAG(seq) OVER w AS prev_seq, LAG(op) OVER w AS prev_op FROM change_log
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, seq, event_id))
SELECT event_id AS record_id, user_id, seq, prev_seq,
  CASE WHEN seq = prev_seq AND prev_op = 'D' AND op = 'I' THEN 'DELETE_BEFORE_INSERT' ELSE 'NOT_INCREASING' END AS finding
FROM looked WHERE seq <= prev_seq""")
def ext4_cdc_order(t):
    return order_violations(d.change_log(t), ["user_id"], "seq", "ts", "op", "event_id")


@workload("ext2_shift", """WITH now AS (SELECT event_type AS value, COUNT(*) / (SELECT CAST(COUNT(*) AS DOUBLE) FROM events WHERE ts >= TIMESTAMP '2024-01-16') AS s
    FROM events WHERE ts >= TIMESTAMP '2024-01-16' GROUP BY event_type),
  base AS (SELECT event_type AS value, COUNT(*) / (SELECT CAST(COUNT(*) AS DOUBLE) FROM events WHERE ts < TIMESTAMP '2024-01-16') AS s
    FROM events WHERE ts < TIMESTAMP '2024-01-16' GROUP BY event_type)
SELECT value, ROUND(COALESCE(n.s, 0), 6) AS now_share, ROUND(COALESCE(b.s, 0), 6) AS base_share,
  ROUND(ABS(COALESCE(n.s, 0) - COALESCE(b.s, 0)) / 2, 6) AS variation
FROM now n FULL JOIN base b USING (value)""")
def ext2_shift(t):
    cut = F.lit("2024-01-16").cast("timestamp_ntz")
    now, base = t["events"].where(F.col("ts") >= cut), t["events"].where(F.col("ts") < cut)
    return metrics.distribution_shift(now, base, "event_type").withColumns(
        {c: F.round(c, 6) for c in ("now_share", "base_share")})


@workload("ext3_volume_band", f"""WITH {d.PROFILE_HISTORY},
past AS (SELECT * FROM history WHERE profiled_at < TIMESTAMP '2024-01-30'),
band AS (SELECT table_name, AVG(row_count) AS m, STDDEV_SAMP(row_count) AS s, COUNT(*) AS observations FROM past GROUP BY table_name)
SELECT table_name, row_count, ROUND(m, 4) AS mean_rows, ROUND(s, 4) AS dev_rows, observations,
  CASE WHEN s IS NULL THEN 'NO_HISTORY' WHEN row_count < m - s THEN 'BELOW_RANGE'
    WHEN row_count > m + s THEN 'ABOVE_RANGE' ELSE 'IN_RANGE' END AS volume_status
FROM history LEFT JOIN band USING (table_name) WHERE profiled_at = TIMESTAMP '2024-01-30'""")
def ext3_volume_band(t):
    history = d.profile_history(t)
    today = F.lit("2024-01-30").cast("timestamp_ntz")
    found = metrics.volume_history(
        history.where(F.col("profiled_at") < today),
        history.where(F.col("profiled_at") == today).select("table_name", "row_count"), 1.0)
    return found.withColumns({c: F.round(c, 4) for c in ("mean_rows", "dev_rows")})


@workload("ext7_near_dup", r"""WITH spelled AS (
  SELECT text, COUNT(*) AS n, TRIM(regexp_replace(LOWER(text), '[^\p{L}\p{N}]+', ' ', 'g')) AS plain FROM documents GROUP BY text)
SELECT plain AS text, CAST(SUM(n) AS BIGINT) AS dup_count, COUNT(*) AS spellings FROM spelled GROUP BY plain HAVING SUM(n) > 1""")
def ext7_near_dup(t):
    return grouped_checks.near_duplicates(t["documents"], ["text"], wide=True)


@workload("ext8_sla", """WITH newest AS (SELECT event_type AS table_name, MAX(ts) AS newest FROM events GROUP BY event_type),
slas AS (SELECT event_type AS table_name, CAST(MIN(user_id) + 20 AS BIGINT) AS max_staleness_min FROM events GROUP BY event_type)
SELECT table_name, newest, max_staleness_min, date_diff('minute', newest, TIMESTAMP '2024-01-31') AS staleness_minutes,
  date_diff('minute', newest, TIMESTAMP '2024-01-31') > max_staleness_min AS breached
FROM newest JOIN slas USING (table_name)""")
def ext8_sla(t):
    newest = t["events"].groupBy(F.col("event_type").alias("table_name")).agg(F.max("ts").alias("newest"))
    slas = t["events"].groupBy(F.col("event_type").alias("target_table")).agg(
        (F.min("user_id") + 20).alias("max_staleness_min")).withColumn("is_active", F.lit(True))
    return metrics.sla_breaches(newest, slas, F.lit("2024-01-31").cast("timestamp_ntz"))


@workload("chk25_unknown_on_text", """SELECT conv_id AS record_id, role AS failed_value FROM conversations
WHERE role NOT IN ('user','assistant') AND role IS NOT NULL""")
def chk25_unknown_on_text(t):
    return row_checks.unknown_operations(t["conversations"], "role", "conv_id", ["user", "assistant"])


# Some orders are gone, some are new, and the prices of one stretch of keys differ.
RESTATED = """SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey BETWEEN 1000 AND 1040 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice
  FROM orders WHERE o_orderkey NOT BETWEEN 300 AND 310
  UNION ALL SELECT o_orderkey + 100000000, o_custkey, o_totalprice FROM orders WHERE o_orderkey < 20"""


def restated(t):
    columns = ["o_orderkey", "o_custkey", "o_totalprice"]
    kept = t["orders"].select(*columns).where("o_orderkey NOT BETWEEN 300 AND 310").withColumn(
        "o_totalprice", F.col("o_totalprice") + F.when(F.col("o_orderkey").between(1000, 1040), 1.0).otherwise(0.0))
    new = t["orders"].where("o_orderkey < 20").select((F.col("o_orderkey") + 100000000).alias("o_orderkey"), "o_custkey", "o_totalprice")
    return kept.unionByName(new)


@workload("ext6_locate", f"""WITH restated AS ({RESTATED})
SELECT COALESCE(o.o_orderkey, r.o_orderkey) AS o_orderkey,
  CASE WHEN r.o_orderkey IS NULL THEN 'MISSING' WHEN o.o_orderkey IS NULL THEN 'EXTRA' ELSE 'CHANGED' END AS finding,
  CAST(o.o_orderkey IS NOT NULL AS BIGINT) AS source_rows, CAST(r.o_orderkey IS NOT NULL AS BIGINT) AS target_rows
FROM orders o FULL JOIN restated r ON o.o_orderkey = r.o_orderkey
WHERE o.o_orderkey IS NULL OR r.o_orderkey IS NULL OR o.o_custkey <> r.o_custkey OR o.o_totalprice <> r.o_totalprice""")
def ext6_locate(t):
    return differences.differing_keys(t["orders"], restated(t), "o_orderkey", ["o_orderkey", "o_custkey", "o_totalprice"])


@workload("ext2_ks", """WITH base AS (SELECT o_totalprice AS v FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01' AND o_totalprice < 400000),
sizes AS (SELECT (SELECT COUNT(*) FROM orders) AS n, (SELECT COUNT(*) FROM base) AS m),
counts AS (SELECT v, SUM(a) AS a, SUM(b) AS b FROM (SELECT o_totalprice AS v, 1 AS a, 0 AS b FROM orders UNION ALL SELECT v, 0, 1 FROM base) GROUP BY v),
gaps AS (SELECT v, ABS(SUM(a) OVER w / CAST(n AS DOUBLE) - SUM(b) OVER w / CAST(m AS DOUBLE)) AS gap FROM counts, sizes WINDOW w AS (ORDER BY v))
SELECT n AS n_now, m AS n_base, distance, (SELECT MIN(v) FROM gaps WHERE gap = distance) AS at_value,
  distance > 1.36 * SQRT((n + m) / CAST(n * m AS DOUBLE)) AS shifted
FROM sizes, (SELECT MAX(gap) AS distance FROM gaps)""")
def ext2_ks(t):
    base = t["orders"].where("o_orderdate < TIMESTAMP_NTZ'1996-01-01 00:00:00' AND o_totalprice < 400000")
    return stat_checks.largest_gap(t["orders"], base, "o_totalprice").drop("allowed")


# Groups of three customers whose codes differ in one character taken out or replaced.
CODES = """SELECT CASE c_custkey % 3 WHEN 0 THEN code WHEN 1 THEN substr(code, 1, 4) || substr(code, 6) ELSE substr(code, 1, 2) || 'x' || substr(code, 4) END AS code
  FROM (SELECT c_custkey, substr(md5(CAST(c_custkey // 3 AS VARCHAR)), 1, 9) AS code FROM customer)"""


def codes(t):
    code = F.substring(F.md5(F.floor(F.col("c_custkey") / 3).cast("string")), 1, 9)
    left = lambda n: F.substring("code", 1, n)
    kept = F.when(F.col("k") == 0, F.col("code")).when(F.col("k") == 1, F.concat(left(4), F.substring("code", 6, 9))).otherwise(
        F.concat(left(2), F.lit("x"), F.substring("code", 4, 9)))
    return t["customer"].select((F.col("c_custkey") % 3).alias("k"), code.alias("code")).select(kept.alias("code"))


@workload("ext7_near_records", f"""WITH RECURSIVE v AS (SELECT code AS value, COUNT(*) AS n FROM ({CODES}) GROUP BY code),
links AS (SELECT a.value AS a, b.value AS b FROM v a JOIN v b ON abs(length(a.value) - length(b.value)) < 2 AND levenshtein(a.value, b.value) = 1),
reach AS (SELECT value AS a, value AS b FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
roots AS (SELECT a AS value, MIN(b) AS group_id FROM reach GROUP BY a)
SELECT value, n AS rows, group_id, CAST(spellings AS BIGINT) AS spellings, CAST(group_rows AS BIGINT) AS group_rows FROM (
  SELECT v.value, n, group_id, COUNT(*) OVER (PARTITION BY group_id) AS spellings, SUM(n) OVER (PARTITION BY group_id) AS group_rows
  FROM v JOIN roots ON roots.value = v.value) WHERE spellings > 1""")
def ext7_near_records(t):
    return near_records.near_records(codes(t), ["code"])


# The name is renamed and moved, the segment renamed, two keys bear each other's names, and a twentieth of the rows is gone.
NOW = """SELECT c_nationkey AS c_custkey, c_custkey AS c_nationkey, c_mktsegment AS segment, c_acctbal, c_name AS title
  FROM customer WHERE c_custkey % 20 <> 0"""
_SHAPES = " UNION ALL ".join(f"SELECT '{c}' AS c, CAST({c} AS VARCHAR) AS v FROM {{0}}" for c in ("c_custkey", "c_nationkey", "c_acctbal"))


@workload("ext9_content", f"""WITH now AS ({NOW}),
olds AS (SELECT DISTINCT c, v FROM ({_SHAPES.format("customer")} UNION ALL SELECT 'c_name', c_name FROM customer UNION ALL SELECT 'c_mktsegment', c_mktsegment FROM customer)),
news AS (SELECT DISTINCT c, v FROM ({_SHAPES.format("now")} UNION ALL SELECT 'title', title FROM now UNION ALL SELECT 'segment', segment FROM now)),
sizes AS (SELECT c, COUNT(*) AS n FROM olds GROUP BY c), sizes_now AS (SELECT c, COUNT(*) AS n FROM news GROUP BY c),
shared AS (SELECT o.c AS old_name, w.c AS new_name, COUNT(*) AS k FROM olds o JOIN news w ON o.v = w.v GROUP BY ALL)
SELECT old_name, new_name, CASE WHEN old_name NOT IN (SELECT c FROM news) THEN 'RENAMED' ELSE 'SWAPPED' END AS kind
FROM shared JOIN sizes ON sizes.c = old_name JOIN sizes_now ON sizes_now.c = new_name
WHERE k / CAST(sizes.n + sizes_now.n - k AS DOUBLE) >= 0.5 AND old_name <> new_name""")
def ext9_content(t):
    now = t["customer"].where("c_custkey % 20 <> 0").selectExpr(
        "c_nationkey AS c_custkey", "c_custkey AS c_nationkey", "c_mktsegment AS segment", "c_acctbal", "c_name AS title")
    return content.renamed_by_content(content.column_sketches(t["customer"]), content.column_sketches(now)).drop("similarity")
