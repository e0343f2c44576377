"""Named queries over the driver's tables, and the SQL that another engine answers them with."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.catalog import TABLES, extremes, register, table
from quern.functions import conversions, dates, numbers, text
from quern.operators import cursors, dml, fulltext, nullmode, pairs, quantified, setops
from quern.plans import ddl, routines, sql_compat
from quern.session import scratch_folder
from quern.sources import etl, infoviews, markup
from quern.streaming import events as streamed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def sql(name: str, tables: str, text_: str, oracle: str | None = None, legacy: bool = False) -> None:
    """A query in SQL; ``oracle`` where the other engine spells it differently; ``legacy`` for the dialect's own spelling."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        register(spark, sf_dir, tuple(tables.split()))
        return sql_compat.run(spark, text_) if legacy else spark.sql(text_)

    QUERIES[name] = run
    ORACLES[name] = oracle or text_


def frame(oracle: str | None):
    """A query made of operators; its name is the function's."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


# Scans, projections, predicates

sql("flagship_segment_revenue", "customer orders lineitem", """
    SELECT c_mktsegment, CAST(count(*) AS bigint) AS n_lines,
           round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
    FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
    WHERE o_orderdate >= TIMESTAMP '1996-01-01 00:00:00' AND l_shipdate > o_orderdate
    GROUP BY c_mktsegment HAVING count(*) > 10
    ORDER BY c_mktsegment LIMIT 3 OFFSET 1""")
sql("scan_project_filter", "lineitem", "SELECT l_orderkey, l_linenumber, l_quantity * 2 AS twice, -l_linenumber AS minus FROM lineitem WHERE l_quantity >= 45 AND l_discount < 0.03")
sql("scan_interval", "orders", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey BETWEEN 100 AND 900")
sql("scan_union_of_intervals", "orders", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey < 50 OR o_custkey = 7 OR o_orderkey IN (1000, 1001)")
sql("index_hint", "orders", "SELECT o_orderkey FROM orders INDEX by_key WHERE o_orderkey !> 25", "SELECT o_orderkey FROM orders WHERE o_orderkey <= 25", legacy=True)
sql("distinct_rows", "part", "SELECT DISTINCT p_brand, p_size FROM part")
sql("from_less_select", "region", "SELECT 1 + 2 AS three, 'a' || 'b' AS ab")
sql("operator_spellings", "orders", "SELECT o_orderkey FROM orders WHERE o_orderkey !< 10 AND o_orderkey !> 400 AND o_orderstatus != \"F\" AND o_orderkey == o_orderkey", "SELECT o_orderkey FROM orders WHERE o_orderkey >= 10 AND o_orderkey <= 400 AND o_orderstatus <> 'F'", legacy=True)
sql("like_escape", "part", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%#_%' ESCAPE '#' OR p_brand LIKE 'Brand##%' ESCAPE '#' OR p_name LIKE 'b%e%'")
sql("between_in_case", "lineitem", """
    SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity BETWEEN 1 AND 10 THEN 'low' WHEN l_quantity IN (11, 12, 13) THEN 'some' ELSE 'many' END AS band,
           CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 0 END AS flag
    FROM lineitem WHERE l_orderkey NOT BETWEEN 100 AND 50000""")
sql("prefix_substring", "part", "SELECT p_partkey, p_name, p_type FROM part WHERE p_name .= 'b' OR p_type .=. 'O'", "SELECT p_partkey, p_name, p_type FROM part WHERE starts_with(p_name, 'b') OR contains(p_type, 'O')", legacy=True)
sql("regexp_like", "part", "SELECT p_partkey, p_name FROM part WHERE regexp_like(p_name, '(?i)^[a-m].*[ae]')", "SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '(?i)^[a-m].*[ae]')")
sql("nullif_coalesce_is", "orders", """
    SELECT o_orderkey, nullif(o_orderstatus, 'F') AS open_status, coalesce(nullif(o_orderstatus, 'F'), 'done') AS status,
           (nullif(o_orderstatus, 'F') IS NULL) AS was_f, ((nullif(o_orderstatus, 'F') = 'O') IS TRUE) AS is_o, ((nullif(o_orderstatus, 'F') = 'O') IS NOT FALSE) AS not_p
    FROM orders WHERE NOT (o_orderstatus = 'P' AND o_totalprice < 1000)""")
sql("is_unknown", "orders", "SELECT o_orderkey FROM orders WHERE (nullif(o_orderstatus, 'F') = 'O') IS UNKNOWN", "SELECT o_orderkey FROM orders WHERE (nullif(o_orderstatus, 'F') = 'O') IS NULL")
sql("intdiv_mod", "part", "SELECT p_partkey, p_size div 7 AS q, p_size % 7 AS r, (p_size - 25) div 4 AS nq, (p_size - 25) % 4 AS nr FROM part",
    "SELECT p_partkey, CAST(p_size // 7 AS bigint) AS q, p_size % 7 AS r, CAST((p_size - 25) // 4 AS bigint) AS nq, (p_size - 25) % 4 AS nr FROM part")
sql("cast_try", "orders", "SELECT o_orderkey, CAST(o_totalprice AS int) AS whole, try_cast(o_orderpriority AS int) AS none, try_cast(left(o_orderpriority, 1) AS int) AS level, CAST(o_custkey AS string) AS cust FROM orders WHERE o_totalprice - floor(o_totalprice) BETWEEN 0.01 AND 0.49",
    "SELECT o_orderkey, CAST(o_totalprice AS int) AS whole, try_cast(o_orderpriority AS int) AS none, try_cast(left(o_orderpriority, 1) AS int) AS level, CAST(o_custkey AS varchar) AS cust FROM orders WHERE o_totalprice - floor(o_totalprice) BETWEEN 0.01 AND 0.49")
sql("odbc_escapes", "orders", "SELECT o_orderkey, {fn upper(o_orderstatus)} AS s FROM orders WHERE o_orderdate >= {ts '2001-01-01 00:00:00'} AND o_orderstatus LIKE '%' {escape '#'}", "SELECT o_orderkey, upper(o_orderstatus) AS s FROM orders WHERE o_orderdate >= TIMESTAMP '2001-01-01 00:00:00'", legacy=True)


@frame("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000.0 AND o_orderstatus = 'O'")
def parameters(spark, sf_dir):
    register(spark, sf_dir, ("orders",))
    return spark.sql("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > :least AND o_orderstatus = :status", args={"least": 100000.0, "status": "O"})


@frame("SELECT event_id, list_value(user_id, event_id)[2] AS second, len(list_value(user_id, event_id)) AS n FROM events WHERE event_type = 'error'")
def multi_value_columns(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type = 'error'").withColumn("v", F.array("user_id", "event_id"))
    return e.select("event_id", F.col("v").getItem(1).alias("second"), F.size("v").cast("long").alias("n"))


@frame("SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def pointer_dereference(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return o.join(c, o.o_custkey == c.c_custkey, "left").select("o_orderkey", "c_name")


@frame("SELECT doc_id, octet_length(encode(text)) AS bytes, substring(text, 3, 10) AS part FROM documents")
def lob_length_and_slice(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("bytes"), F.substring("text", 3, 10).alias("part"))


# Joins

sql("join_cross", "nation region", "SELECT n_name, r_name FROM nation, region WHERE n_nationkey < 5")
sql("join_inner", "nation region supplier", "SELECT s_name, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey INNER JOIN region ON n_regionkey = r_regionkey")
sql("join_theta", "nation region", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey > r_regionkey AND n_nationkey + r_regionkey < 20")
sql("join_left", "orders lineitem", "SELECT o_orderkey, CAST(count(l_orderkey) AS bigint) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_quantity > 40 GROUP BY o_orderkey")
sql("join_right", "orders customer", "SELECT c_custkey, o_orderkey FROM orders RIGHT OUTER JOIN customer ON o_custkey = c_custkey AND o_totalprice > 300000")
sql("join_full", "customer supplier", "SELECT c_custkey, s_suppkey, c_nationkey, s_nationkey FROM customer FULL OUTER JOIN supplier ON c_custkey = s_suppkey + 50 AND c_nationkey < s_nationkey")
sql("join_using", "nation supplier", "SELECT k, n_name, s_name FROM (SELECT n_nationkey AS k, n_name FROM nation) n JOIN (SELECT s_nationkey AS k, s_name FROM supplier) s USING (k)")
sql("join_natural", "nation region", "SELECT k, n_name, r_name FROM (SELECT n_regionkey AS k, n_name FROM nation) n NATURAL JOIN (SELECT r_regionkey AS k, r_name FROM region) r")
sql("join_natural_full", "nation region", "SELECT k, a, b FROM (SELECT n_nationkey AS k, n_name AS a FROM nation WHERE n_nationkey > 3) n NATURAL FULL JOIN (SELECT r_regionkey AS k, r_name AS b FROM region) r")
sql("join_union", "nation region", "SELECT * FROM nation UNION JOIN region", "SELECT n_nationkey, n_name, n_regionkey, NULL::int AS r_regionkey, NULL::varchar AS r_name FROM nation UNION ALL SELECT NULL, NULL, NULL, r_regionkey, r_name FROM region", legacy=True)


@frame("SELECT a.c_custkey AS one, b.c_custkey AS other FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_mktsegment = b.c_mktsegment AND a.c_custkey < b.c_custkey")
def join_self(spark, sf_dir):
    return pairs.ordered_pairs(table(spark, sf_dir, "customer"), ["c_nationkey", "c_mktsegment"], "c_custkey")


sql("exists", "customer orders", "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
sql("not_exists", "customer orders", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)")
sql("in_subquery", "customer orders", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
sql("not_in", "customer orders", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 150000)")
sql("not_in_with_null", "customer nation", "SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT nullif(n_nationkey, 3) FROM nation)")


@frame("SELECT a.o_orderkey AS k, b.o_orderkey AS other FROM (SELECT o_orderkey, nullif(o_orderstatus, 'F') s FROM orders WHERE o_orderkey < 300) a JOIN (SELECT o_orderkey, nullif(o_orderstatus, 'F') s FROM orders WHERE o_orderkey < 100) b ON a.s IS NOT DISTINCT FROM b.s")
def join_legacy_nulls(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("F")).alias("s"))
    a, b = o.where("o_orderkey < 300"), o.where("o_orderkey < 100").toDF("other", "t")
    return nullmode.join_equal(a, b, [("s", "t")]).select(F.col("o_orderkey").alias("k"), "other")


# Whole tables: the null of half of the orders meets the one customer without a key, so that the result grows with the orders.
@frame("SELECT o_orderkey, c_name FROM (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN o_custkey END k FROM orders) o JOIN (SELECT nullif(c_custkey, 1) k, c_name FROM customer) c ON o.k IS NOT DISTINCT FROM c.k")
def join_legacy_nulls_whole(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "F", F.col("o_custkey")).alias("k"))
    c = table(spark, sf_dir, "customer").select(F.nullif("c_custkey", F.lit(1)).alias("c"), "c_name")
    return nullmode.join_equal(o, c, [("k", "c")]).select("o_orderkey", "c_name")


@frame("""SELECT o_orderkey, (s IS NOT DISTINCT FROM t) AS eq, coalesce(s < t, s IS NULL AND t IS NOT NULL) AS lt, NOT coalesce(t < s, t IS NULL AND s IS NOT NULL) AS le
    FROM (SELECT o_orderkey, nullif(o_orderstatus, 'F') s, nullif(o_orderstatus, 'O') t FROM orders)""")
def null_mode_comparisons(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("F")).alias("s"), F.nullif("o_orderstatus", F.lit("O")).alias("t"))
    return o.select("o_orderkey", *[nullmode.compare(F.col("s"), op, F.col("t")).alias(n) for op, n in (("=", "eq"), ("<", "lt"), ("<=", "le"))])


# Subqueries and quantified comparisons

sql("quantified_all", "customer", "SELECT c_custkey FROM customer WHERE c_acctbal > ALL (SELECT c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey < 5)", legacy=True)
sql("quantified_any", "customer", "SELECT c_custkey FROM customer WHERE c_acctbal < ANY (SELECT c_acctbal - 500 FROM customer WHERE c_nationkey = 3)", legacy=True)
sql("quantified_some_equal", "customer supplier", "SELECT c_custkey FROM customer WHERE c_nationkey = SOME (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0)", "SELECT c_custkey FROM customer WHERE c_nationkey = ANY (SELECT s_nationkey FROM supplier WHERE s_acctbal < 0)", legacy=True)
sql("quantified_with_nulls", "part nation", "SELECT p_partkey, p_size > ALL (SELECT nullif(n_nationkey, 7) FROM nation) AS above, p_size <= ANY (SELECT nullif(n_nationkey, 24) FROM nation) AS below FROM part", legacy=True)
sql("quantified_empty", "part nation", "SELECT p_partkey, p_size > ALL (SELECT n_nationkey FROM nation WHERE n_nationkey > 99) AS every, p_size > ANY (SELECT n_nationkey FROM nation WHERE n_nationkey > 99) AS some_ FROM part", legacy=True)


@frame("SELECT o_orderkey, o_totalprice > ALL (SELECT l_extendedprice * 3 FROM lineitem WHERE l_orderkey = o_orderkey) AS holds FROM orders")
def quantified_correlated(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_extendedprice") * 3).alias("v"))
    return quantified.quantified(o, "o_totalprice", ">", "ALL", lines, "v", ["o_orderkey"]).select("o_orderkey", "holds")


sql("unique_predicate", "lineitem nation", "SELECT n_name FROM nation WHERE UNIQUE (SELECT l_orderkey, l_linenumber FROM lineitem) AND UNIQUE (SELECT nullif(n_nationkey, n_nationkey) FROM nation)",
    "SELECT n_name FROM nation WHERE NOT EXISTS (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)", legacy=True)
sql("unique_predicate_false", "customer nation", "SELECT n_name, UNIQUE (SELECT c_nationkey FROM customer) AS holds FROM nation", "SELECT n_name, false AS holds FROM nation", legacy=True)
sql("scalar_subquery", "orders", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders)")
sql("scalar_correlated", "orders customer", "SELECT c_custkey, (SELECT round(max(o_totalprice), 2) FROM orders WHERE o_custkey = c_custkey) AS top FROM customer")
sql("derived_table_rename", "lineitem", "SELECT f, n FROM (SELECT l_returnflag, count(*) FROM lineitem GROUP BY l_returnflag) AS t (f, n)")
sql("common_table", "orders", "WITH t AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey) SELECT k, n FROM t WHERE n > (SELECT avg(n) FROM t)")

# Aggregates

sql("agg_global", "lineitem", "SELECT CAST(count(*) AS bigint) AS n, CAST(sum(l_linenumber) AS bigint) AS s, round(avg(l_quantity), 6) AS a, min(l_shipdate) AS lo, max(l_shipdate) AS hi FROM lineitem")
sql("agg_empty", "lineitem", "SELECT CAST(count(*) AS bigint) AS n, CAST(sum(l_linenumber) AS bigint) AS s, max(l_shipmode) AS m FROM (SELECT l_linenumber, l_returnflag AS l_shipmode FROM lineitem WHERE l_quantity > 1000) t")
sql("agg_group", "lineitem", "SELECT l_returnflag, l_linestatus, CAST(count(*) AS bigint) AS n, round(sum(l_extendedprice), 2) AS price, round(avg(l_discount), 6) AS disc, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem GROUP BY l_returnflag, l_linestatus")
sql("agg_group_expression", "orders", "SELECT CAST(year(o_orderdate) AS int) AS y, CAST(count(*) AS bigint) AS n FROM orders GROUP BY CAST(year(o_orderdate) AS int)")
sql("agg_count_nulls", "orders", "SELECT o_orderpriority, CAST(count(nullif(o_orderstatus, 'F')) AS bigint) AS filled, CAST(count(*) AS bigint) AS n FROM orders GROUP BY o_orderpriority")
sql("agg_having", "orders", "SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey HAVING count(*) >= 15 AND max(o_totalprice) > 100000")
sql("agg_distinct", "lineitem", "SELECT l_returnflag, CAST(count(DISTINCT l_suppkey) AS bigint) AS n, CAST(sum(DISTINCT l_linenumber) AS bigint) AS s, avg(DISTINCT l_linenumber) AS a FROM lineitem GROUP BY l_returnflag")
sql("agg_min_max_text", "part", "SELECT p_type, min(p_name) AS first_name, max(p_brand) AS last_brand FROM part GROUP BY p_type")


@frame("SELECT p_brand, CAST(sum(p_size) // count(p_size) AS bigint) AS a FROM part GROUP BY p_brand")
def agg_int_avg_legacy(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(numbers.legacy_avg(F.col("p_size")).alias("a"))


@frame("SELECT CAST(sum(p_size) // count(p_size) AS bigint) AS value FROM part")
def cursor_aggregate(spark, sf_dir):
    return cursors.aggregate(table(spark, sf_dir, "part"), "AVG", "p_size", legacy=True)


# Set operations

_A, _B = "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 8000", "SELECT s_nationkey AS k FROM supplier"
for _name, _op in (("union", "UNION"), ("union_all", "UNION ALL"), ("intersect", "INTERSECT"), ("intersect_all", "INTERSECT ALL"), ("except", "EXCEPT"), ("except_all", "EXCEPT ALL")):
    sql(f"set_{_name}", "customer supplier", f"({_A}) {_op} ({_B})")
sql("set_nested", "customer supplier nation", f"({_A}) UNION (({_B}) INTERSECT (SELECT n_nationkey FROM nation WHERE n_nationkey < 9))")
sql("union_corresponding", "nation region", "SELECT n_regionkey AS k, n_name AS name, n_nationkey AS x FROM nation UNION CORRESPONDING SELECT r_name AS name, r_regionkey AS k, 1 AS y FROM region", "SELECT n_regionkey AS k, n_name AS name FROM nation UNION SELECT r_regionkey, r_name FROM region", legacy=True)
sql("except_corresponding_by", "customer supplier", "SELECT c_nationkey AS k, c_custkey AS id FROM customer EXCEPT ALL CORRESPONDING BY (k) SELECT s_suppkey AS id, s_nationkey AS k FROM supplier", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier", legacy=True)
sql("intersect_corresponding", "customer supplier", "SELECT c_nationkey AS k, c_custkey AS c FROM customer INTERSECT CORRESPONDING SELECT s_nationkey AS k, s_name AS n FROM supplier", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier", legacy=True)

sql("except_corresponding_chain", "customer supplier nation", "SELECT n_nationkey AS k, n_name AS a FROM nation EXCEPT CORRESPONDING SELECT s_nationkey AS k, s_name AS b FROM supplier WHERE s_acctbal < 0 EXCEPT CORRESPONDING SELECT 1 AS c, c_nationkey AS k FROM customer WHERE c_acctbal > 9900 ORDER BY k DESC LIMIT 7",
    "SELECT k FROM (SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal < 0 EXCEPT SELECT c_nationkey FROM customer WHERE c_acctbal > 9900) t ORDER BY k DESC LIMIT 7", legacy=True)
sql("union_intersect_corresponding", "customer supplier region", "SELECT r_regionkey AS k, r_name AS a FROM region UNION CORRESPONDING SELECT c_nationkey AS k FROM customer INTERSECT CORRESPONDING SELECT s_suppkey AS x, s_nationkey AS k FROM supplier",
    "SELECT r_regionkey AS k FROM region UNION (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier)", legacy=True)
sql("union_join_filtered", "nation region", "SELECT n.n_nationkey AS k, r.r_name AS name FROM nation AS n UNION JOIN region r WHERE n.n_nationkey > 20 OR r.r_regionkey >= 0",
    "SELECT n_nationkey AS k, CAST(NULL AS varchar) AS name FROM nation WHERE n_nationkey > 20 UNION ALL SELECT NULL, r_name FROM region WHERE r_regionkey >= 0", legacy=True)
sql("index_column", "nation", "SELECT index AS k, t.index + 1 AS more FROM (SELECT n_nationkey AS index FROM nation) t WHERE index <=> 3 OR index > 20", "SELECT n_nationkey AS k, n_nationkey + 1 AS more FROM nation WHERE n_nationkey = 3 OR n_nationkey > 20", legacy=True)
sql("odbc_functions", "nation", "SELECT {fn UCASE(n_name)} AS upper_name, {fn LENGTH(n_name)} AS size, {t '01:02:03'} AS t FROM nation", "SELECT upper(n_name) AS upper_name, CAST(length(n_name) AS int) AS size, 3723000 AS t FROM nation", legacy=True)


@frame("(SELECT n_nationkey AS k, 'left' AS side FROM nation WHERE n_nationkey NOT IN (SELECT r_regionkey + 3 FROM region)) UNION ALL (SELECT r_regionkey + 3, 'right' FROM region WHERE r_regionkey + 3 NOT IN (SELECT n_nationkey FROM nation))")
def table_comparison(spark, sf_dir):
    return setops.differences(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k")), table(spark, sf_dir, "region").select((F.col("r_regionkey") + 3).alias("k")))


# Order and limits

sql("order_nulls", "orders", "SELECT o_orderkey, nullif(o_orderstatus, 'F') AS s FROM orders ORDER BY s, o_orderkey LIMIT 40", "SELECT o_orderkey, nullif(o_orderstatus, 'F') AS s FROM orders ORDER BY s ASC NULLS FIRST, o_orderkey LIMIT 40")
sql("order_nulls_desc", "orders", "SELECT o_orderkey, nullif(o_orderstatus, 'O') AS s FROM orders ORDER BY s DESC, o_orderkey DESC LIMIT 40", "SELECT o_orderkey, nullif(o_orderstatus, 'O') AS s FROM orders ORDER BY s DESC NULLS LAST, o_orderkey DESC LIMIT 40")
sql("order_nulls_whole", "orders", "SELECT o_orderkey, nullif(o_orderstatus, 'F') AS s FROM orders ORDER BY s, o_orderkey", "SELECT o_orderkey, nullif(o_orderstatus, 'F') AS s FROM orders ORDER BY s ASC NULLS FIRST, o_orderkey")
sql("order_nulls_desc_whole", "orders", "SELECT o_orderkey, nullif(o_orderstatus, 'O') AS s FROM orders ORDER BY s DESC, o_orderkey DESC", "SELECT o_orderkey, nullif(o_orderstatus, 'O') AS s FROM orders ORDER BY s DESC NULLS LAST, o_orderkey DESC")
sql("limit_offset", "orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20, 15", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15 OFFSET 20", legacy=True)
sql("topk_tiebreak", "lineitem", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem ORDER BY l_quantity DESC, l_orderkey, l_linenumber LIMIT 25")
sql("limit_in_subquery", "orders customer", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM (SELECT o_custkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 30) t)")


@frame("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_totalprice BETWEEN 100000 AND 120000 ORDER BY o_totalprice DESC, o_orderkey")
def cursor_restrict(spark, sf_dir):
    return cursors.restrict(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), "o_orderstatus = 'O' AND o_totalprice BETWEEN 100000 AND 120000", "o_totalprice DESC, o_orderkey").drop("o_orderstatus")


@frame("SELECT * FROM (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey >= 77 ORDER BY o_orderkey LIMIT 1) UNION ALL SELECT * FROM (SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 1 OFFSET 9) UNION ALL SELECT * FROM (SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey DESC LIMIT 1 OFFSET 1)")
def cursor_positions(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return cursors.closest(o, "o_orderkey", 77).union(cursors.fetch(o, ["o_orderkey"], 10)).union(cursors.fetch(o, ["o_orderkey"], -2))


@frame("SELECT n_nationkey, 100 + 5 * (row_number() OVER (ORDER BY n_name) - 1) AS value FROM nation")
def sequence_values(spark, sf_dir):
    return dml.sequence(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), ["n_name"], 100, 5).select("n_nationkey", "value")


# Scalar functions


@frame("SELECT p_partkey, length(p_name) AS n, octet_length(encode(p_name)) AS bytes, bit_length(p_name) AS bits, position('a' IN p_name) AS at, upper(p_name) AS up, lower(p_type) AS low, trim('  ' || p_name || ' ') AS trimmed, ascii(p_name) AS code, chr(64 + p_size) AS c FROM part")
def str_length_and_case(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    n = F.col("p_name")
    return p.select("p_partkey", F.char_length(n).cast("long").alias("n"), F.octet_length(n).cast("long").alias("bytes"), F.bit_length(n).cast("long").alias("bits"), text.strpos(F.lit("a"), n).cast("long").alias("at"), F.upper(n).alias("up"), F.lower("p_type").alias("low"),
                    text.strtrim(F.concat(F.lit("  "), n, F.lit(" "))).alias("trimmed"), text.ord_(n).alias("code"), text.chr_(F.col("p_size") + 64).alias("c"))


@frame("""SELECT p_partkey, substring(p_name, 2, 4) AS sub, substring(p_name, 1, 2) AS early, left(p_name, 2) || 'XY' || substring(p_name, 3) AS inserted, left(p_name, 1) || substring(p_name, 4) AS deleted,
    starts_with(p_name, left(p_type, 1)) AS pre, contains(p_name, 'e') AS has_e FROM part""")
def str_edit(spark, sf_dir):
    n = F.col("p_name")
    return table(spark, sf_dir, "part").select(
        "p_partkey", text.substring(n, F.lit(2), F.lit(4)).alias("sub"), text.substring(n, F.lit(-1), F.lit(4)).alias("early"), text.strinsert(F.lit("XY"), n, F.lit(3)).alias("inserted"), text.strdelete(n, F.lit(2), F.lit(2)).alias("deleted"),
        text.pref(F.left("p_type", F.lit(1)), n).alias("pre"), text.substr(F.lit("e"), n).alias("has_e"))


@frame("SELECT p_partkey FROM part WHERE p_name LIKE '%e_' OR lower(p_brand) LIKE 'brand#_3'")
def str_like_function(spark, sf_dir):
    return table(spark, sf_dir, "part").where(text.like(F.col("p_name"), "%e_") | text.like(F.col("p_brand"), "BRAND#_3", ignore_case=True)).select("p_partkey")


@frame("SELECT p_partkey, abs(p_size - 25) AS a, round(sqrt(p_size), 9) AS sq, p_size * p_size AS square, round(sin(p_size), 9) AS si, round(cos(p_size), 9) AS co, round(atan(p_size), 9) AS at, round(ln(p_size), 9) AS l, round(exp(p_size / 10.0), 6) AS e, p_size % 2 <> 0 AS odd FROM part")
def math_basic(spark, sf_dir):
    s = F.col("p_size")
    r = lambda c, n=9: F.round(c, n)
    return table(spark, sf_dir, "part").select("p_partkey", F.abs(s - 25).alias("a"), r(F.sqrt(s)).alias("sq"), numbers.sqr(s).alias("square"), r(F.sin(s)).alias("si"), r(F.cos(s)).alias("co"), r(F.atan(s)).alias("at"), r(F.ln(s)).alias("l"), r(F.exp(s / 10.0), 6).alias("e"), numbers.odd(s).alias("odd"))


@frame("SELECT p_partkey, CAST(round(v) AS int) AS rounded, CAST(trunc(v) AS int) AS truncated, CAST(round(v) AS bigint) AS big FROM (SELECT p_partkey, (p_size - 25) / 2.0 AS v FROM part)")
def round_trunc(spark, sf_dir):
    v = table(spark, sf_dir, "part").select("p_partkey", ((F.col("p_size") - 25) / 2.0).alias("v"))
    return v.select("p_partkey", numbers.round_(F.col("v")).alias("rounded"), numbers.trunc(F.col("v")).alias("truncated"), numbers.round_(F.col("v"), "bigint").alias("big"))


@frame("SELECT o_orderkey, year(o_orderdate)::int AS y, month(o_orderdate)::int AS m, day(o_orderdate)::int AS d, quarter(o_orderdate)::int AS q, dayofweek(o_orderdate)::int AS w, CAST(o_orderdate AS date) AS dt FROM orders")
def date_parts(spark, sf_dir):
    d = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.year(d).alias("y"), F.month(d).alias("m"), F.day(d).alias("d"), F.quarter(d).alias("q"), dates.day_of_week(d).alias("w"), dates.timestamp_to_date(d).alias("dt"))


@frame("SELECT event_id, hour(ts)::int AS h, minute(ts)::int AS m, second(ts)::int AS s, ((hour(ts) * 60 + minute(ts)) * 60 + second(ts)) * 1000 AS t FROM events")
def time_parts(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", dates.timestamp_to_time(F.col("ts")).alias("t"))
    t = F.col("t")
    return e.select("event_id", dates.hours(t).alias("h"), dates.minutes(t).alias("m"), dates.seconds(t).alias("s"), t.cast("long").alias("t"))


@frame("SELECT o_orderkey, CAST(o_orderdate AS date) + 45 AS later, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS date)) AS days, CAST(CAST(o_orderdate AS date) - 1 AS date) AS before FROM orders")
def date_arith(spark, sf_dir):
    d = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.date_plus(d, F.lit(45)).alias("later"), dates.date_diff(d, F.lit("1995-01-01").cast("date")).cast("long").alias("days"), dates.date_plus(d, F.lit(-1)).alias("before"))


@frame("SELECT event_id, date_trunc('second', ts) + INTERVAL 90 SECOND AS later, CAST(epoch(date_trunc('second', ts)) - epoch(TIMESTAMP '2024-01-01 00:00:00') AS bigint) AS secs FROM events")
def ts_seconds(spark, sf_dir):
    ts = F.date_trunc("second", "ts").cast("timestamp_ntz")
    return table(spark, sf_dir, "events").select("event_id", dates.ts_plus(ts, F.lit(90)).alias("later"), dates.ts_diff(ts, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).alias("secs"))


@frame("""SELECT o_orderkey, try_cast(lpad(CAST(1995 + o_orderkey % 7 AS varchar), 4, '0') || '-' || lpad(CAST(o_orderkey % 14 AS varchar), 2, '0') || '-' || lpad(CAST(o_orderkey % 33 AS varchar), 2, '0') AS date) AS made,
    CASE WHEN o_orderkey % 26 < 24 THEN ((o_orderkey % 26) * 60 + o_orderkey % 60) * 60000 + 5 END AS t FROM orders""")
def date_making(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.make_date(k % 33, k % 14, k % 7 + 1995).alias("made"), dates.make_time((k % 26).cast("int"), (k % 60).cast("int"), F.lit(0), F.lit(5)).cast("long").alias("t"))


@frame("""SELECT o_orderkey, strftime(o_orderdate, '%-d.%-m.%Y') AS written, CAST(o_orderdate AS date) AS back, CAST(o_orderkey AS varchar) AS key_text, try_cast(o_orderpriority AS int) AS none, CAST(o_orderkey AS int) AS key_back FROM orders""")
def conv_roundtrip(spark, sf_dir):
    d = conversions.date2str(F.to_date("o_orderdate"), 1)
    return table(spark, sf_dir, "orders").select("o_orderkey", d.alias("written"), conversions.str2date(d).alias("back"), conversions.int2str(F.col("o_orderkey")).alias("key_text"), conversions.str2int(F.col("o_orderpriority")).alias("none"), conversions.str2int(conversions.int2str(F.col("o_orderkey"))).alias("key_back"))


@frame("SELECT o_orderkey, printf('%.2f', o_totalprice) AS fixed, replace(printf('%.2f', o_totalprice), '.', ',') AS money, strftime(o_orderdate, '%Y-%m-%d') AS iso, CASE WHEN o_totalprice > 100000 THEN 'TRUE' ELSE 'FALSE' END AS flag, o_totalprice > 100000 AS back FROM orders WHERE printf('%.2f', o_totalprice) NOT LIKE '%.00'")
def conv_formats(spark, sf_dir):
    o, x = table(spark, sf_dir, "orders"), F.col("o_totalprice")
    flag = conversions.bool2str(x > 100000)
    made = o.select("o_orderkey", conversions.real2str(x, -2).alias("fixed"), conversions.money2str(x, 0).alias("money"), conversions.date2str(F.to_date("o_orderdate"), 6).alias("iso"), flag.alias("flag"), conversions.str2bool(flag).alias("back"))
    return made.where("fixed NOT LIKE '%.00'")


@frame("SELECT c_custkey, CASE WHEN a IS NULL THEN b WHEN b IS NULL THEN a ELSE a + b END AS total FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_custkey END AS a, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_nationkey END AS b FROM customer)")
def money_sum(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_custkey")).alias("a"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_nationkey").cast("long")).alias("b"))
    return c.select("c_custkey", numbers.add_money(F.col("a"), F.col("b")).alias("total"))


# Full text

_POSTINGS = f"""WITH raw AS (SELECT doc_id, regexp_extract_all(text, '{fulltext.WORD}') AS words FROM documents),
    numbered AS (SELECT doc_id, words, unnest(range(0, len(words))) AS position FROM raw),
    p AS (SELECT doc_id, lower(left(words[position + 1], {fulltext.LONGEST})) AS word, CAST(position AS int) AS position FROM numbered)"""


def _index(spark, sf_dir):
    return fulltext.postings(table(spark, sf_dir, "documents"))


@frame(f"{_POSTINGS} SELECT word, CAST(count(DISTINCT doc_id) AS bigint) AS n_docs, CAST(count(*) AS bigint) AS n FROM p GROUP BY word")
def ft_postings(spark, sf_dir):
    return fulltext.word_table(_index(spark, sf_dir))


def _hits(word: str) -> str:
    return f"(SELECT doc_id, count(*) AS weight, min(position) AS position FROM p WHERE word = '{word}' GROUP BY doc_id)"


@frame(f"""{_POSTINGS}, x AS {_hits('the')}, y AS {_hits('was')}, z AS {_hits('of')}, w AS {_hits('license')}
    SELECT doc_id, max(weight) AS weight, min(position) AS position FROM (
        SELECT x.doc_id, least(x.weight, y.weight) AS weight, least(x.position, y.position) AS position FROM x JOIN y USING (doc_id) WHERE x.doc_id NOT IN (SELECT doc_id FROM z)
        UNION ALL SELECT doc_id, weight, position FROM w) GROUP BY doc_id""")
def ft_and_or_not(spark, sf_dir):
    return fulltext.search(_index(spark, sf_dir), "the AND was AND NOT of OR license")


@frame(f"""{_POSTINGS} SELECT a.doc_id, count(*) AS weight, min(a.position) AS position FROM p a JOIN p b ON a.doc_id = b.doc_id AND b.position = a.position + 1 JOIN p c ON a.doc_id = c.doc_id AND c.position = a.position + 2
    WHERE a.word = 'under' AND b.word = 'the' AND c.word = 'apache' GROUP BY a.doc_id""")
def ft_phrase(spark, sf_dir):
    return fulltext.search(_index(spark, sf_dir), '"under the apache"')


@frame(f"""{_POSTINGS} SELECT a.doc_id, count(*) AS weight, min(a.position) AS position FROM p a WHERE a.word = 'this'
    AND EXISTS (SELECT 1 FROM p b WHERE b.doc_id = a.doc_id AND b.word = 'with' AND b.position BETWEEN a.position - {fulltext.NEAR} AND a.position + {fulltext.NEAR}) GROUP BY a.doc_id""")
def ft_near(spark, sf_dir):
    return fulltext.search(_index(spark, sf_dir), "this NEAR with")


@frame(f"{_POSTINGS} SELECT d.doc_id, CAST(0 AS bigint) AS weight, CAST(NULL AS int) AS position FROM documents d WHERE doc_id NOT IN (SELECT doc_id FROM p WHERE word IN ('the', 'der'))")
def ft_negation(spark, sf_dir):
    return fulltext.search(_index(spark, sf_dir), "NOT (the OR der)", documents=table(spark, sf_dir, "documents"))


@frame(f"""{_POSTINGS}, h AS {_hits('license')} SELECT h.doc_id, h.weight,
    array_to_string(list_transform(r.words[greatest(h.position - 3, 0) + 1 : h.position + 4], lambda w, i: CASE WHEN i - 1 + greatest(h.position - 3, 0) = h.position THEN '[' || w || ']' ELSE w END), ' ') AS snippet FROM h JOIN raw r USING (doc_id)""")
def ft_snippet(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return fulltext.search(_index(spark, sf_dir), "license").join(docs, "doc_id").select("doc_id", "weight", fulltext.snippet(F.col("text"), F.col("position"), 3, 3).alias("snippet"))


@frame(f"{_POSTINGS} SELECT word, CAST(count(*) AS bigint) AS n FROM p WHERE doc_id % 2 = 1 GROUP BY word")
def ft_remove_documents(spark, sf_dir):
    gone = table(spark, sf_dir, "documents").where("doc_id % 2 = 0")
    return fulltext.remove_documents(_index(spark, sf_dir), gone).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


# Changes and constraints


@frame("SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal + 100 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_mktsegment = 'BUILDING' THEN 'BUILT' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def dml_update(spark, sf_dir):
    return dml.update(table(spark, sf_dir, "customer"), {"c_acctbal": F.col("c_acctbal") + 100, "c_mktsegment": F.lit("BUILT")}, F.col("c_mktsegment") == "BUILDING")


@frame("SELECT * FROM customer WHERE NOT coalesce(nullif(c_mktsegment, 'BUILDING') = 'MACHINERY', false)")
def dml_delete(spark, sf_dir):
    return dml.delete(table(spark, sf_dir, "customer"), F.nullif("c_mktsegment", F.lit("BUILDING")) == "MACHINERY")


@frame("SELECT * FROM nation UNION ALL SELECT r_regionkey + 100, r_name, NULL FROM region")
def dml_insert(spark, sf_dir):
    return dml.insert(table(spark, sf_dir, "nation"), table(spark, sf_dir, "region").select(F.col("r_regionkey") + 100, "r_name"), ["n_nationkey", "n_name"])


@frame("SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_nationkey NOT IN (SELECT r_regionkey + 22 FROM region) UNION ALL SELECT r_regionkey + 22, r_name, r_regionkey FROM region")
def dml_upsert(spark, sf_dir):
    new = table(spark, sf_dir, "region").select((F.col("r_regionkey") + 22).alias("n_nationkey"), F.col("r_name").alias("n_name"), F.col("r_regionkey").alias("n_regionkey"))
    return dml.upsert(table(spark, sf_dir, "nation"), new, ["n_nationkey"])


@frame("SELECT l_orderkey, l_linenumber, CAST(count(*) AS bigint) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def check_unique(spark, sf_dir):
    return dml.unique_violations(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@frame("SELECT o_orderkey, o_custkey FROM orders WHERE nullif(o_custkey, 5) NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def check_fk_orphans(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").withColumn("ref", F.nullif("o_custkey", F.lit(5)))
    return dml.orphans(o, ["ref"], table(spark, sf_dir, "customer").where("c_acctbal > 0"), ["c_custkey"]).drop("ref")


@frame("SELECT s_suppkey, s_acctbal FROM supplier WHERE NOT (s_acctbal > 0 OR s_nationkey < 10)")
def check_constraint(spark, sf_dir):
    return dml.check_violations(table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal", "s_nationkey"), (F.col("s_acctbal") > 0) | (F.col("s_nationkey") < 10)).drop("s_nationkey")


@frame("SELECT o_orderkey, CASE WHEN c_nationkey = 4 THEN NULL ELSE o_custkey END AS o_custkey FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def cascade_set_null(spark, sf_dir):
    _, child = dml.cascade_delete(table(spark, sf_dir, "customer"), "c_custkey", F.col("c_nationkey") == 4, table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", "SET NULL")
    return child.select("o_orderkey", "o_custkey")


@frame("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 4)")
def cascade_rows(spark, sf_dir):
    return dml.cascade_delete(table(spark, sf_dir, "customer"), "c_custkey", F.col("c_nationkey") == 4, table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey")[1]


@frame("SELECT s_suppkey, 10 + ((row_number() OVER (ORDER BY s_suppkey) - 1) % 31) * 3 AS value FROM supplier")
def sequence_cycle(spark, sf_dir):
    return dml.sequence(table(spark, sf_dir, "supplier").select("s_suppkey"), ["s_suppkey"], 10, 3, minimum=10, maximum=102, cycle=True)


@frame("SELECT o_orderkey, CASE WHEN o_orderkey % 40 BETWEEN 1 AND 28 AND o_orderkey % 15 BETWEEN 1 AND 12 THEN make_date(1990 + o_orderkey % 20, o_orderkey % 15, o_orderkey % 40) END AS made FROM orders WHERE o_orderkey % 40 NOT IN (29, 30, 31)")
def date_ranges(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderkey % 40 NOT IN (29, 30, 31)")
    k = F.col("o_orderkey")
    return o.select("o_orderkey", dates.make_date((k % 40).cast("int"), (k % 15).cast("int"), (1990 + k % 20).cast("int")).alias("made"))


@frame("SELECT o_orderkey, (o_orderkey + 9007199254740993) // 3 AS q, -(o_orderkey // 7) AS r FROM orders")
def whole_quotients(spark, sf_dir):
    k = F.col("o_orderkey").cast("long")
    return table(spark, sf_dir, "orders").select("o_orderkey", numbers.div(k + 9007199254740993, F.lit(3)).alias("q"), numbers.div(-k, F.lit(7)).alias("r"))


# Catalog and documents


# The other engine's names of types, and Spark's.
_TYPES = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "TIMESTAMP": "timestamp_ntz", "DATE": "date", "FLOAT[]": "array<float>", "DOUBLE[]": "array<double>"}


@frame(f"""SELECT table_name, column_name, CAST(ordinal_position AS int) AS ordinal, CASE data_type {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in _TYPES.items())} ELSE lower(data_type) END AS type_name, is_nullable = 'YES' AS nullable
    FROM information_schema.columns WHERE table_name IN ({', '.join(f"'{t}'" for t in TABLES)})""")
def table_columns(spark, sf_dir):
    register(spark, sf_dir)
    return infoviews.table_columns(spark).where(F.col("table_name").isin(*TABLES))


@frame("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def csv_round_trip(spark, sf_dir):
    path, form = scratch_folder(spark), etl.Format(separator=";", decimal=",", encoding="CP1250", line_breaks=True)
    etl.write_csv(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal"), path, form)
    return etl.read_csv(spark, path, {"s_suppkey": "bigint", "s_name": "string", "s_nationkey": "int", "s_acctbal": "double"}, form)


@frame("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def fixed_width_round_trip(spark, sf_dir):
    path = scratch_folder(spark)
    etl.write_fixed(table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"), path, [6, 30, 6])
    return etl.read_fixed(spark, path, [("n_nationkey", 6, "bigint"), ("n_name", 30, "string"), ("n_regionkey", 6, "bigint")])


@frame("SELECT p_partkey, p_name, p_size FROM part")
def xml_round_trip(spark, sf_dir):
    path = scratch_folder(spark)
    etl.write_xml(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size"), path)
    return etl.read_xml(spark, path, "row", "p_partkey bigint, p_name string, p_size bigint")


@frame(f"{_POSTINGS} SELECT doc_id, count(*) AS weight, min(position) AS position FROM p WHERE word = 'license' GROUP BY doc_id")
def ft_written_index(spark, sf_dir):
    path = scratch_folder(spark)
    fulltext.write_index(_index(spark, sf_dir), path)
    return fulltext.search(spark.read.parquet(path), "license")


@frame("SELECT n_name, CAST(n_nationkey AS int) AS k, CASE WHEN n_nationkey > 20 THEN 1.5 END AS rate FROM nation WHERE n_regionkey <> 2")
def table_definition(spark, sf_dir):
    name, domains = f"quern_{uuid.uuid4().hex}", {}
    for statement in ("CREATE DOMAIN label AS CHAR(25)", f"CREATE TABLE {name} (n_name label NOT NULL PRIMARY KEY, k INTEGER CHECK (k >= 0), old DATE, INDEX (k))", f"ALTER TABLE {name} DROP COLUMN old", f"ALTER TABLE {name} ADD COLUMN rate REAL"):
        ddl.execute(spark, statement, domains)
    n = table(spark, sf_dir, "nation").where("n_regionkey <> 2")
    rows = n.select("n_name", F.col("n_nationkey").cast("int").alias("k"), F.when(F.col("n_nationkey") > 20, 1.5).alias("rate"))
    rows.write.insertInto(name)
    found = spark.createDataFrame(spark.table(name).collect(), spark.table(name).schema)  # as many rows as there are nations
    ddl.execute(spark, f"DROP TABLE {name}")
    return found


@frame("SELECT least_o_orderkey, greatest_o_orderkey, least_o_totalprice, greatest_o_totalprice FROM (SELECT min(o_orderkey) AS least_o_orderkey, max(o_orderkey) AS greatest_o_orderkey, min(o_totalprice) AS least_o_totalprice, max(o_totalprice) AS greatest_o_totalprice FROM orders)")
def footer_extremes(spark, sf_dir):
    return extremes(spark, f"{sf_dir}/orders.parquet", ["o_orderkey", "o_totalprice"])


# Columns of several values, large objects, pointers and escapes in the dialect's spelling


@frame("SELECT event_id, list_value(user_id, event_id)[2] AS second, CAST(2 AS bigint) AS n FROM events WHERE event_type = 'error'")
def multi_value_syntax(spark, sf_dir):
    table(spark, sf_dir, "events").withColumn("v", F.array("user_id", "event_id")).createOrReplaceTempView("_multi")
    return sql_compat.run(spark, "SELECT event_id, v[1] AS second, CAST(m.v# AS bigint) AS n FROM _multi AS m WHERE event_type = 'error'")


@frame("SELECT doc_id, CAST(octet_length(encode(text)) AS bigint) AS bytes, substring(text, 4, 10) AS part FROM documents")
def lob_syntax(spark, sf_dir):
    register(spark, sf_dir, ("documents",))
    return sql_compat.run(spark, "SELECT doc_id, CAST(text# AS bigint) AS bytes, text[3, 10] AS part FROM documents")


@frame("SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def pointer_syntax(spark, sf_dir):
    register(spark, sf_dir, ("orders", "customer"))
    return sql_compat.run(spark, "SELECT o_orderkey, o.o_custkey^.c_name AS c_name FROM orders o", pointers={"o_custkey": ("customer", "c_custkey")})


sql("tilde_like", "part", "SELECT p_partkey, p_name FROM part WHERE p_name ~ '%e%'", "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%e%'", legacy=True)
sql("extract_fields", "orders", "SELECT o_orderkey, CAST(EXTRACT(YEAR FROM o_orderdate) AS bigint) AS y, CAST(EXTRACT(MONTH FROM o_orderdate) AS bigint) AS m, CAST(EXTRACT(DAY FROM o_orderdate) AS bigint) AS d, CAST(EXTRACT(HOUR FROM o_orderdate) AS bigint) AS h FROM orders")


@frame("SELECT event_id, user_id % 2 = 1 AS odd, substring(event_type, 2, 3) AS part, position('r' IN substring(event_type, 2)) AS found FROM events")
def odd_copy_find(spark, sf_dir):
    e, s = table(spark, sf_dir, "events"), F.col("event_type")
    return e.select("event_id", numbers.odd(F.col("user_id")).alias("odd"), text.strcopy(s, F.lit(2), F.lit(3)).alias("part"), F.greatest(cursors.find_text(s, "R", 2, ignore_case=True) - 1, F.lit(0)).cast("long").alias("found"))


_MS = "CAST(CAST(epoch(date_trunc('second', ts)) AS bigint) % 86400 * 1000 AS bigint)"


@frame(f"""SELECT event_id, CAST(CAST(ts AS date) AS timestamp) + to_milliseconds({_MS}) AS again, ({_MS} - 3600000 + 86400000) % 86400000 AS before, {_MS} + 1500 AS after,
    {_MS} - 43200000 AS from_noon, strftime(ts, '%H:%M') AS short, strftime(ts, '%H:%M:%S') AS long, strftime(ts, '%-d.%-m.%Y %H:%M:%S') AS stamp, strftime(ts, '%Y-%m-%d %H:%M:%S') AS iso FROM events""")
def times_of_day(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts")).withColumn("t", dates.timestamp_to_time(F.col("ts")))
    t, ts = F.col("t"), F.col("ts")
    return e.select("event_id", dates.datetime_to_timestamp(dates.timestamp_to_date(ts), t).alias("again"), dates.time_minus(t, F.lit(3_600_000)).cast("long").alias("before"), dates.time_plus(t, F.lit(1500)).cast("long").alias("after"),
                    dates.time_diff(t, F.lit(43_200_000)).cast("long").alias("from_noon"), conversions.time2str(t, 0).alias("short"), conversions.time2str(t, 1).alias("long"), conversions.timestamp2str(ts, 1).alias("stamp"), conversions.timestamp2str(ts, 2).alias("iso"))


@frame("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey = 7 UNION ALL (SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 1 OFFSET 4) UNION ALL SELECT max(o_orderkey), 0 FROM orders")
def cursor_positions(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    register(spark, sf_dir, ("orders",))
    greatest = cursors.single_value(spark, "SELECT max(o_orderkey) FROM orders")
    return cursors.look_up(o, "o_orderkey", 7).union(cursors.fetch(o, ["o_orderkey"], 5)).union(spark.createDataFrame([(greatest, 0)], "o_orderkey long, o_custkey long"))


@frame("SELECT count(*) AS n, max(o_totalprice) AS top FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 1000.0")
def prepared_query(spark, sf_dir):
    register(spark, sf_dir, ("orders",))
    return routines.prepare(spark, "SELECT count(*) AS n, max(o_totalprice) AS top FROM orders WHERE o_orderstatus == :status AND o_totalprice !< :least AND o_totalprice != :least")(status="O", least=1000.0)


@frame("SELECT n_name, n_nationkey FROM nation WHERE n_nationkey >= (SELECT avg(n_nationkey) FROM nation)")
def select_into_variables(spark, sf_dir):
    register(spark, sf_dir, ("nation",))
    (mean,) = routines.select_into(spark, "SELECT avg(n_nationkey) FROM nation")
    return routines.prepare(spark, "SELECT n_name, n_nationkey FROM nation WHERE n_nationkey >= ?")(mean)


@frame("SELECT n_name, n_nationkey, n_regionkey FROM nation WHERE false")
def dml_truncate(spark, sf_dir):
    return dml.delete(table(spark, sf_dir, "nation"))


@frame("SELECT CAST(sum(n_nationkey) AS bigint) AS total FROM nation WHERE n_regionkey = 1")
def psm_for_loop(spark, sf_dir):
    register(spark, sf_dir, ("nation",))
    return routines.script(spark, "BEGIN DECLARE total BIGINT = 0; FOR r AS SELECT n_nationkey AS k FROM nation WHERE n_regionkey = 1 DO SET total = total + r.k; END FOR; SELECT total AS total; END")


@frame("SELECT 'caught' AS outcome, CAST(3 AS int) AS k")
def psm_handler(spark, sf_dir):
    return routines.script(spark, """BEGIN
        DECLARE outcome STRING = 'none'; DECLARE k INT = 0;
        BEGIN
            DECLARE EXIT HANDLER FOR SQLEXCEPTION BEGIN SET outcome = 'caught'; END;
            again: LOOP
                SET k = k + 1;
                IF k = 3 THEN SIGNAL SQLSTATE '45000'; END IF;
                IF k > 9 THEN LEAVE again; END IF;
            END LOOP;
        END;
        SELECT outcome AS outcome, k AS k; END""")


@frame("SELECT s_suppkey, abs(s_acctbal) AS size FROM supplier")
def external_routine(spark, sf_dir):
    register(spark, sf_dir, ("supplier",))
    routines.create_external(spark, "quern_absolute", "DOUBLE PRECISION", "absolute@numpy")
    return spark.sql("SELECT s_suppkey, quern_absolute(s_acctbal) AS size FROM supplier")


@frame("SELECT page_id, octet_length(encode(html)) AS bytes FROM pages WHERE page_id < 3")
def external_objects(spark, sf_dir):
    path = scratch_folder(spark)
    few = table(spark, sf_dir, "pages").where("page_id < 3").select("page_id", F.regexp_replace("html", "[\r\n]", " ").alias("html"))
    few.select("html", "page_id").write.partitionBy("page_id").option("lineSep", "\n").text(path)
    return etl.read_files(spark, f"{path}/page_id=*/*.txt").select(F.regexp_extract("path", r"page_id=(\d+)", 1).cast("long").alias("page_id"), (F.col("length") - 1).alias("bytes"))


# Full-text systems in SQL


@frame(f"""{_POSTINGS}, x AS {_hits('license')}, y AS {_hits('under')}
    SELECT d.doc_id, d.lang, least(x.weight, y.weight) AS weight, least(x.position, y.position) AS position FROM documents d JOIN x USING (doc_id) JOIN y USING (doc_id) WHERE d.lang = 'en'""")
def ft_predicate(spark, sf_dir):
    register(spark, sf_dir, ("documents",))
    name = f"quern_ft_{uuid.uuid4().hex}"
    ddl.execute(spark, f"CREATE FULLTEXT {name} LANGUAGE 3 NOT LEMMATIZED (documents doc_id text)")
    return sql_compat.run(spark, f"SELECT d.doc_id, d.lang, @@FULLTEXT_WEIGHT AS weight, @@FULLTEXT_POSITION AS position FROM documents d WHERE d.lang = 'en' AND FULLTEXT({name}, d.doc_id, 'license AND under')")


@frame(f"""{_POSTINGS}, n AS (SELECT doc_id, len(regexp_extract_all(source, '{fulltext.WORD}')) AS first FROM documents),
    q AS (SELECT doc_id, lower(left(w, {fulltext.LONGEST})) AS word, 100 AS more, CAST(i - 1 AS int) AS position FROM (SELECT doc_id, unnest(regexp_extract_all(source, '{fulltext.WORD}')) AS w, generate_subscripts(regexp_extract_all(source, '{fulltext.WORD}'), 1) AS i FROM documents)
          UNION ALL SELECT doc_id, word, 0, CAST(position + first AS int) FROM p JOIN n USING (doc_id))
    SELECT doc_id, max(weight) AS weight, min(position) AS position FROM (SELECT doc_id, CAST(sum(1 + more) AS bigint) AS weight, min(position) AS position FROM q WHERE word IN ('src3', 'the') GROUP BY doc_id, word) GROUP BY doc_id""")
def ft_weights(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return fulltext.search(fulltext.postings(docs, parts={"source": 2, "text": 0}), "the OR src3")


@frame(f"""{_POSTINGS}, h AS (SELECT a.doc_id, min(a.position) AS position FROM p a JOIN p b ON a.doc_id = b.doc_id AND b.position = a.position + 1 WHERE a.word = 'under' AND b.word = 'the' GROUP BY a.doc_id)
    SELECT h.doc_id, h.position, array_to_string(list_transform(r.words[greatest(h.position - 2, 0) + 1 : h.position + 4],
        lambda w, i: CASE WHEN i - 1 + greatest(h.position - 2, 0) = h.position THEN '<b>' || w WHEN i - 1 + greatest(h.position - 2, 0) = h.position + 1 THEN w || '</b>' ELSE w END), ' ') AS context FROM h JOIN raw r USING (doc_id)""")
def ft_contexts(spark, sf_dir):
    found = fulltext.search(_index(spark, sf_dir), '"under the"').drop("weight")
    return fulltext.contexts(found, table(spark, sf_dir, "documents"), before=2, after=2, start="<b>", end="</b>", count=2)


@frame("SELECT 'n_name' AS column_name, 'string' AS type_name, 1 AS data_type UNION ALL SELECT 'k', 'int', 4")
def info_views(spark, sf_dir):
    name = f"quern_{uuid.uuid4().hex}"
    ddl.execute(spark, f"CREATE TABLE {name} (n_name CHAR(25) PRIMARY KEY, k INTEGER CHECK (k >= 0))")
    infoviews.register(spark)
    found = spark.sql(f"SELECT column_name, type_name, data_type FROM _iv_odbc_columns WHERE table_name = '{name}'")
    found = spark.createDataFrame(found.collect(), found.schema)  # two rows
    ddl.execute(spark, f"DROP TABLE {name}")
    return found


@frame("SELECT n_nationkey, n_name, 'CHECK' AS kind FROM nation")
def schema_round_trip(spark, sf_dir):
    path, name = scratch_folder(spark), f"quern_{uuid.uuid4().hex}"
    ddl.execute(spark, f"CREATE TABLE {name} (n_nationkey INTEGER CHECK (n_nationkey >= 0), n_name CHAR(25))")
    table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int"), "n_name").write.insertInto(name)
    infoviews.export_schema(spark, path, [name])
    (again,) = infoviews.import_schema(spark, path, lambda n: f"{n}_again")
    kind = infoviews.constraints(spark).where(F.col("table_name") == again).first().kind
    found = spark.createDataFrame(spark.table(again).collect(), spark.table(again).schema).withColumn("kind", F.lit(kind))  # as many rows as there are nations
    for n in (name, again):
        ddl.execute(spark, f"DROP TABLE {n}")
    return found


@frame("SELECT 'nation' AS table_name, count(*) AS n_rows FROM nation UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'orders', count(*) FROM orders")
def table_space(spark, sf_dir):
    register(spark, sf_dir, ("nation", "part", "orders"))
    return infoviews.table_space(spark, ["nation", "part", "orders"])


@frame(f"SELECT page_id, {markup.oracle('html')} AS text FROM pages")
def html_to_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", markup.html_text(F.col("html")).alias("text"))


@frame("SELECT event_type, date_trunc('hour', ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_by_hour(spark, sf_dir):
    return streamed.by_window(table(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))


@frame("SELECT o_orderkey, o_totalprice * 0.9 AS reduced FROM orders WHERE o_orderstatus = 'O'")
def sql_function(spark, sf_dir):
    register(spark, sf_dir, ("orders",))
    routines.create_function(spark, "quern_reduced", "x DOUBLE, share DOUBLE DEFAULT 0.9D", "DOUBLE", "x * share")
    return spark.sql("SELECT o_orderkey, quern_reduced(o_totalprice) AS reduced FROM orders WHERE o_orderstatus = 'O'")


@frame("SELECT 55 AS total")
def sql_script(spark, sf_dir):
    return routines.script(spark, "BEGIN DECLARE total INT = 0; DECLARE k INT = 1; WHILE k <= 10 DO SET total = total + k; SET k = k + 1; END WHILE; SELECT total AS total; END")
