"""Joins, aggregates, windows, sorts, set operations and functions: free SQL, and operators that SQL lacks.

Sums of money are exact decimals, turned into doubles at the end, so that the
order of addition does not show.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dialect import ascending, date_bin, day_of_week, descending, int_div, strpos
from ..operators import relational as R
from ..operators import selection
from .common import Query, stated, table


def money(x: str) -> str:
    return f"CAST(sum(CAST({x} AS DECIMAL(18,4))) AS DOUBLE)"


#: name: (tables, Spark SQL, oracle SQL or None if it is the same text)
STATED: dict[str, tuple[str, str, str | None]] = {
    "sql_projection": ("lineitem", "SELECT *, l_extendedprice * (1 - l_discount) AS net FROM lineitem", None),
    "sql_free": ("customer orders", f"SELECT c_nationkey, count(*) AS orders, {money('o_totalprice')} AS total FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderstatus <> 'P' GROUP BY c_nationkey", None),
    "sql_cte": ("orders", f"WITH big AS (SELECT * FROM orders WHERE o_totalprice > 100000), by_status AS (SELECT o_orderstatus, count(*) AS n, {money('o_totalprice')} AS total FROM big GROUP BY o_orderstatus) SELECT * FROM by_status WHERE n > 10", None),
    "sql_scalar_subquery": ("orders", "SELECT o_orderkey, o_totalprice, (SELECT max(o_totalprice) FROM orders) AS highest FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.9 FROM orders)", None),
    "sql_exists": ("customer orders", "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)", None),
    "sql_in_subquery": ("part lineitem", "SELECT p_partkey, p_brand FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49)", None),
    "sql_values": ("orders", "SELECT v.label, count(*) AS orders FROM (VALUES ('F', 'final'), ('O', 'open'), ('P', 'partial')) AS v(code, label) JOIN orders ON o_orderstatus = v.code GROUP BY v.label", None),
    "sql_recursive": (
        "part",
        "WITH RECURSIVE up(node, place, depth) AS (SELECT p_partkey, p_partkey, 0 FROM part UNION ALL SELECT node, place div 2, depth + 1 FROM up WHERE place >= 2) SELECT node, max(depth) AS depth, min(place) AS root FROM up GROUP BY node",
        "WITH RECURSIVE up(node, place, depth) AS (SELECT p_partkey, p_partkey, 0 FROM part UNION ALL SELECT node, place // 2, depth + 1 FROM up WHERE place >= 2) SELECT node, max(depth) AS depth, min(place) AS root FROM up GROUP BY node",
    ),
    "sql_explode": (
        "part",
        "SELECT word, count(*) AS n FROM (SELECT explode(split(p_type, ' ')) AS word FROM part) AS w GROUP BY word",
        "SELECT word, count(*) AS n FROM (SELECT unnest(string_split(p_type, ' ')) AS word FROM part) AS w GROUP BY word",
    ),
    "sql_correlated": ("orders", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders AS o WHERE o_totalprice = (SELECT max(i.o_totalprice) FROM orders AS i WHERE i.o_custkey = o.o_custkey)", None),
    "sql_distribute_by": (
        "lineitem",
        f"SELECT l_suppkey, count(*) AS n, {money('l_tax')} AS tax FROM (SELECT * FROM lineitem DISTRIBUTE BY l_suppkey) GROUP BY l_suppkey",
        f"SELECT l_suppkey, count(*) AS n, {money('l_tax')} AS tax FROM lineitem GROUP BY l_suppkey",
    ),
    "join_inner": ("supplier nation", "SELECT s_suppkey, s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey", None),
    "join_left": ("customer orders", "SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P' GROUP BY c_custkey", None),
    "join_right": ("orders customer", "SELECT c_custkey, o_orderkey FROM (SELECT * FROM orders WHERE o_totalprice > 200000) AS o RIGHT JOIN customer ON c_custkey = o_custkey", None),
    "join_full": ("customer supplier", "SELECT c_custkey, s_suppkey, coalesce(c_nationkey, s_nationkey) AS nation FROM (SELECT * FROM customer WHERE c_acctbal > 5000) AS c FULL JOIN (SELECT * FROM supplier WHERE s_acctbal < 5000) AS s ON c_custkey = s_suppkey", None),
    "join_semi": ("customer orders", "SELECT c_custkey, c_mktsegment FROM customer LEFT SEMI JOIN orders ON c_custkey = o_custkey", "SELECT c_custkey, c_mktsegment FROM customer SEMI JOIN orders ON c_custkey = o_custkey"),
    "join_anti": ("customer orders", "SELECT c_custkey, c_mktsegment FROM customer LEFT ANTI JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P'", "SELECT c_custkey, c_mktsegment FROM customer ANTI JOIN (SELECT * FROM orders WHERE o_orderstatus = 'P') AS o ON c_custkey = o_custkey"),
    "join_theta": ("supplier nation", "SELECT s.s_suppkey, n.n_nationkey FROM supplier AS s JOIN nation AS n ON s.s_nationkey < n.n_nationkey AND s.s_acctbal > n.n_nationkey * 400", None),
    "join_cross": ("region nation", "SELECT r_name, n_name FROM region CROSS JOIN nation", None),
    "join_using": ("orders lineitem", "SELECT k, count(*) AS lines, max(o_totalprice) AS price FROM (SELECT o_orderkey AS k, o_totalprice FROM orders) AS o JOIN (SELECT l_orderkey AS k, l_quantity FROM lineitem) AS l USING (k) GROUP BY k", None),
    "join_self": ("nation", "SELECT a.n_name AS one, b.n_name AS other FROM nation AS a JOIN nation AS b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey", None),
    "agg_basic": ("lineitem", f"SELECT l_returnflag, l_linestatus, count(*) AS n, {money('l_quantity')} AS quantity, round(avg(l_discount), 6) AS discount, min(l_shipdate) AS first_ship, max(l_extendedprice) AS dearest, round(sum(CAST(l_tax AS DECIMAL(18,4))), 2) * 1.0 = 0 AS no_tax FROM lineitem GROUP BY l_returnflag, l_linestatus", None),
    "agg_count_distinct": ("orders", "SELECT o_orderpriority, count(DISTINCT o_custkey) AS customers, count(*) AS orders FROM orders GROUP BY o_orderpriority", None),
    "agg_grouping_sets": (
        "orders",
        f"SELECT o_orderstatus, o_orderpriority, grouping(o_orderstatus) AS no_status, count(*) AS n, {money('o_totalprice')} AS total FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())",
        f"SELECT o_orderstatus, o_orderpriority, CAST(grouping(o_orderstatus) AS TINYINT) AS no_status, count(*) AS n, {money('o_totalprice')} AS total FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())",
    ),
    "agg_cube": ("lineitem", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)", None),
    "agg_rollup": ("customer", "SELECT c_mktsegment, c_nationkey, count(*) AS n, max(c_acctbal) AS richest FROM customer GROUP BY ROLLUP (c_mktsegment, c_nationkey)", None),
    "agg_distinct": ("lineitem", "SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem", None),
    "agg_median": ("lineitem", "SELECT l_returnflag, median(l_quantity) AS quantity, median(l_extendedprice) AS price FROM lineitem GROUP BY l_returnflag", None),
    "agg_max_by": ("orders", "SELECT o_custkey, max_by(o_orderkey, o_totalprice) AS dearest FROM orders GROUP BY ALL", "SELECT o_custkey, max_by(o_orderkey, o_totalprice) AS dearest FROM orders GROUP BY ALL"),
    "agg_having": ("orders", f"SELECT o_custkey, count(*) AS n, {money('o_totalprice')} AS total FROM orders GROUP BY o_custkey HAVING count(*) > 14", None),
    "agg_filter_clause": ("orders", f"SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS final, CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) FILTER (WHERE o_orderstatus = 'O') AS DOUBLE) AS open_total FROM orders GROUP BY o_orderpriority", None),
    "win_ranking": (
        "customer",
        "SELECT c_custkey, row_number() OVER w AS rn, rank() OVER v AS rk, dense_rank() OVER v AS dr, round(percent_rank() OVER v, 9) AS pr, round(cume_dist() OVER v, 9) AS cd, ntile(4) OVER w AS quarter FROM customer WINDOW w AS (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey), v AS (PARTITION BY c_mktsegment ORDER BY c_nationkey)",
        None,
    ),
    "win_lag_lead": ("orders", "SELECT o_orderkey, lag(o_totalprice) OVER w AS before, lead(o_orderkey, 2, -1) OVER w AS later FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)", None),
    "win_first_last": (
        "orders",
        "SELECT o_orderkey, first_value(o_orderkey) OVER w AS first_order, last_value(o_orderkey) OVER w AS last_order, nth_value(o_orderkey, 2) OVER w AS second_order FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
        None,
    ),
    "win_rows_frame": ("events", "SELECT event_id, CAST(sum(CAST(value AS DECIMAL(18,6))) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 FOLLOWING) AS DOUBLE) AS around FROM events", None),
    "win_range_frame": ("lineitem", "SELECT l_suppkey, l_partkey, l_quantity, count(*) OVER (PARTITION BY l_suppkey ORDER BY l_quantity RANGE BETWEEN 5 PRECEDING AND CURRENT ROW) AS near FROM lineitem", None),
    "sort_topk": ("orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25", None),
    "sql_limit_offset": ("orders", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 20 OFFSET 15", None),
    "set_union_all": ("customer supplier", "SELECT c_nationkey AS nation, c_acctbal AS balance FROM customer UNION ALL SELECT s_nationkey, s_acctbal FROM supplier", None),
    "set_union": ("customer supplier", "SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier", None),
    "set_intersect": ("orders lineitem", "SELECT o_custkey AS k FROM orders INTERSECT SELECT l_suppkey FROM lineitem", None),
    "set_except": ("part lineitem", "SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45", None),
    "fn_string": (
        "part",
        "SELECT p_partkey, p_brand || '-' || p_type AS joined, upper(p_name) AS up, lower(p_type) AS low, trim(concat('  ', p_brand, ' ')) AS trimmed, substr(p_name, 2, 4) AS middle, replace(p_type, ' ', '_') AS snake, split_part(p_type, ' ', 1) AS first_word, lpad(CAST(p_size AS STRING), 5, '0') AS padded, reverse(p_brand) AS backwards, regexp_replace(p_type, '[aeiou]', '*') AS masked, p_name ILIKE '%a%' AS has_a, instr(p_type, ' ') AS blank FROM part",
        "SELECT p_partkey, p_brand || '-' || p_type AS joined, upper(p_name) AS up, lower(p_type) AS low, trim(concat('  ', p_brand, ' ')) AS trimmed, substr(p_name, 2, 4) AS middle, replace(p_type, ' ', '_') AS snake, split_part(p_type, ' ', 1) AS first_word, lpad(CAST(p_size AS STRING), 5, '0') AS padded, reverse(p_brand) AS backwards, regexp_replace(p_type, '[aeiou]', '*', 'g') AS masked, p_name ILIKE '%a%' AS has_a, CAST(instr(p_type, ' ') AS INTEGER) AS blank FROM part",
    ),
    "fn_math": (
        "lineitem",
        "SELECT l_orderkey, l_linenumber, l_partkey, abs(l_discount - 0.05) < 0.02 AS near, ceil(l_tax * 100) AS up, floor(l_quantity / 3) AS down, round(l_extendedprice / 7, 2) AS rounded, round(sqrt(l_quantity), 9) AS root, round(power(l_quantity, 2), 2) AS squared, round(ln(l_quantity + 1), 9) AS logged, round(log10(l_extendedprice), 9) AS log10, sign(l_discount - 0.05) AS sgn, greatest(l_discount, l_tax) AS larger, least(l_discount, l_tax) AS smaller, l_partkey % 7 AS modulo, l_partkey div 7 AS whole FROM lineitem",
        "SELECT l_orderkey, l_linenumber, l_partkey, abs(l_discount - 0.05) < 0.02 AS near, CAST(ceil(l_tax * 100) AS BIGINT) AS up, CAST(floor(l_quantity / 3) AS BIGINT) AS down, round(l_extendedprice / 7, 2) AS rounded, round(sqrt(l_quantity), 9) AS root, round(power(l_quantity, 2), 2) AS squared, round(ln(l_quantity + 1), 9) AS logged, round(log10(l_extendedprice), 9) AS log10, CAST(sign(l_discount - 0.05) AS DOUBLE) AS sgn, greatest(l_discount, l_tax) AS larger, least(l_discount, l_tax) AS smaller, l_partkey % 7 AS modulo, l_partkey // 7 AS whole FROM lineitem",
    ),
    "fn_conditional": (
        "orders",
        "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'large' WHEN o_totalprice > 50000 THEN 'middle' ELSE 'small' END AS size, coalesce(nullif(o_orderstatus, 'P'), 'none') AS status, o_orderpriority IN ('1-URGENT', '2-HIGH') AS urgent, o_totalprice BETWEEN 1000 AND 90000 AS inside, o_orderstatus IS DISTINCT FROM 'F' AS not_final FROM orders",
        None,
    ),
    "fn_cast": (
        "orders",
        "SELECT o_orderkey, CAST(o_totalprice AS BIGINT) AS cut, CAST(o_totalprice AS DECIMAL(18,1)) AS tenth, CAST(o_orderkey AS STRING) AS text, TRY_CAST(o_orderpriority AS INT) AS no_number, TRY_CAST(substr(o_orderpriority, 1, 1) AS INT) AS digit, CAST(o_orderdate AS DATE) AS day FROM orders",
        "SELECT o_orderkey, CAST(trunc(o_totalprice) AS BIGINT) AS cut, CAST(o_totalprice AS DECIMAL(18,1)) AS tenth, CAST(o_orderkey AS STRING) AS text, TRY_CAST(o_orderpriority AS INT) AS no_number, TRY_CAST(substr(o_orderpriority, 1, 1) AS INT) AS digit, CAST(o_orderdate AS DATE) AS day FROM orders",
    ),
    "fn_array": (
        "part",
        "SELECT p_partkey, size(a) AS n, array_contains(a, 'TIN') AS tin, array_join(a, '/') AS joined, element_at(a, 1) AS head, aggregate(sequence(1, p_size), 0, (x, y) -> x + y) AS triangle FROM (SELECT *, split(p_type, ' ') AS a FROM part)",
        "SELECT p_partkey, CAST(len(a) AS INTEGER) AS n, list_contains(a, 'TIN') AS tin, array_to_string(a, '/') AS joined, a[1] AS head, CAST(list_sum(generate_series(1, p_size)) AS INTEGER) AS triangle FROM (SELECT *, string_split(p_type, ' ') AS a FROM part)",
    ),
    "fn_map": (
        "orders",
        "SELECT o_orderkey, map('s', o_orderstatus, 'p', o_orderpriority)['p'] AS priority, size(map_keys(map('a', 1, 'b', o_custkey))) AS keys, named_struct('k', o_orderkey, 'c', o_custkey).c AS customer FROM orders",
        "SELECT o_orderkey, map {'s': o_orderstatus, 'p': o_orderpriority}['p'] AS priority, 2 AS keys, struct_pack(k := o_orderkey, c := o_custkey).c AS customer FROM orders",
    ),
    "fn_hash": ("customer", "SELECT c_custkey, md5(c_name) AS m, sha2(c_name, 256) AS s FROM customer", "SELECT c_custkey, md5(c_name) AS m, sha256(c_name) AS s FROM customer"),
}

NATIVE: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def native(name: str, oracle: str | None):
    """Register a query of the DataFrame API, with its oracle."""

    def add(query: Query) -> Query:
        NATIVE[name] = query
        if oracle:
            ORACLES[name] = oracle
        return query

    return add


@native("join_right_semi", "SELECT * FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)")
def join_right_semi(spark, sf):
    orders = table(spark, sf, "orders").filter("o_totalprice > 250000").withColumnRenamed("o_custkey", "c_custkey")
    return R.right_semi(orders, table(spark, sf, "customer"), "c_custkey")


@native("join_right_anti", "SELECT * FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)")
def join_right_anti(spark, sf):
    orders = table(spark, sf, "orders").filter("o_totalprice > 250000").withColumnRenamed("o_custkey", "c_custkey")
    return R.right_anti(orders, table(spark, sf, "customer"), "c_custkey")


@native("join_mark", "SELECT c_custkey, c_name, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AS matched FROM customer")
def join_mark(spark, sf):
    orders = table(spark, sf, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return R.mark(table(spark, sf, "customer").select("c_custkey", "c_name"), orders, ["c_custkey"])


@native("agg_distinct_on", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
def agg_distinct_on(spark, sf):
    return R.distinct_on(table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")])


@native("agg_approx_distinct", None)
def agg_approx_distinct(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.02).alias("parts"))


@native("agg_approx_error", "SELECT l_returnflag, true AS near FROM lineitem GROUP BY l_returnflag")
def agg_approx_error(spark, sf):
    """Whether the approximate count is within 10 % (five standard errors) of the exact one."""
    approximate, exact = F.approx_count_distinct("l_partkey", 0.02), F.count_distinct("l_partkey")
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg((F.abs(approximate - exact) <= exact * 0.1).alias("near"))


@native("win_running_sum", "SELECT DISTINCT o_orderdate, CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) OVER (ORDER BY o_orderdate) AS DOUBLE) AS running FROM orders")
def win_running_sum(spark, sf):
    price = F.col("o_totalprice").cast("decimal(18,4)")
    found = R.running_total(table(spark, sf, "orders"), "o_orderdate", price, F.date_trunc("month", "o_orderdate"))
    return found.withColumn("running", F.col("running").cast("double"))


@native("win_running_ranges", "SELECT DISTINCT l_extendedprice, sum(CAST(l_quantity AS BIGINT)) OVER (ORDER BY l_extendedprice)::BIGINT AS running FROM lineitem")
def win_running_ranges(spark, sf):
    return selection.running_total(table(spark, sf, "lineitem"), "l_extendedprice", F.col("l_quantity").cast("long"))


@native("agg_median_selected", "SELECT l_returnflag, median(l_extendedprice) AS price FROM lineitem GROUP BY l_returnflag")
def agg_median_selected(spark, sf):
    """Medians of a few large groups, of which no task holds the values."""
    return selection.median(table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", "price")


@native("sort_multi", "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer ORDER BY c_mktsegment, c_acctbal DESC, c_custkey")
def sort_multi(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal").orderBy("c_mktsegment", F.desc("c_acctbal"), "c_custkey")


@native("sort_nulls", "SELECT c_custkey, nullif(c_nationkey, 3) AS nation FROM customer ORDER BY nation ASC NULLS LAST, c_custkey DESC NULLS FIRST")
def sort_nulls(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", F.nullif(F.col("c_nationkey"), F.lit(3)).alias("nation")).orderBy(ascending("nation"), descending("c_custkey"))


@native("topk_per_group", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 3")
def topk_per_group(spark, sf):
    return R.top_per_group(table(spark, sf, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3).select("o_custkey", "o_orderkey")


@native("win_groups_frame", "SELECT c_custkey, sum(c_custkey) OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW)::BIGINT AS around FROM customer")
def win_groups_frame(spark, sf):
    return R.group_frame_sum(table(spark, sf, "customer"), ["c_mktsegment"], "c_nationkey", "c_custkey", 1, 0, "around").select("c_custkey", "around")


@native("tables_equal", "SELECT (SELECT count(*) FROM (SELECT l_suppkey FROM lineitem EXCEPT ALL SELECT l_suppkey FROM lineitem WHERE l_quantity > 1)) AS only_left, CAST(0 AS BIGINT) AS only_right, (SELECT count(*) FROM lineitem WHERE l_quantity <= 1) = 0 AS equal")
def tables_equal(spark, sf):
    keys = table(spark, sf, "lineitem")
    return R.same_tables(keys.select("l_suppkey"), keys.filter("l_quantity > 1").select("l_suppkey"))


@native(
    "fn_date",
    "SELECT o_orderkey, date_trunc('month', o_orderdate) AS month, CAST(date_part('year', o_orderdate) AS INTEGER) AS year, CAST(date_part('dow', o_orderdate) AS INTEGER) AS dow, make_date(CAST(date_part('year', o_orderdate) AS BIGINT), 1, 1) AS new_year, CAST(epoch_us(o_orderdate) AS BIGINT) AS us, time_bucket(INTERVAL 10 DAY, o_orderdate, TIMESTAMP '1970-01-01') AS bin FROM orders",
)
def fn_date(spark, sf):
    at = F.col("o_orderdate")
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return table(spark, sf, "orders").select(
        "o_orderkey",
        F.date_trunc("month", at).cast("timestamp_ntz").alias("month"),
        F.year(at).alias("year"),
        day_of_week(at).alias("dow"),
        F.make_date(F.year(at), F.lit(1), F.lit(1)).alias("new_year"),
        F.timestamp_diff("MICROSECOND", start, at).alias("us"),
        date_bin(10 * 86_400_000_000, at).alias("bin"),
    )


@native("fn_names", "SELECT o_orderkey, CAST(strpos(o_orderpriority, '-') AS INTEGER) AS dash, CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE o_orderkey // (o_custkey % 5) END AS whole FROM orders")
def fn_names(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", strpos(F.col("o_orderpriority"), "-").alias("dash"), int_div(F.col("o_orderkey"), F.col("o_custkey") % 5).alias("whole"))


QUERIES: dict[str, Query] = {k: stated(names, text) for k, (names, text, _) in STATED.items()} | NATIVE
ORACLE_SQL: dict[str, str] = {k: other or text for k, (_, text, other) in STATED.items()} | ORACLES
