"""General relational capability on the star schema, and the way a statement goes through the session's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomtext.plans.registry import Registry
from loomtext.sources.tables import table

RELATIONAL = Registry()
TABLES = "region nation customer supplier part orders lineitem events books".split()

#: Name, statement for the engine, statement to hold it against where the dialects differ.
STATEMENTS: list[tuple[str, str, str | None]] = [
    ("rel_pricing_summary", """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
      FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus""", None),
    ("rel_inner_join", "SELECT n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name", None),
    ("rel_left_join", "SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey", None),
    # Counts the rows of customer FULL JOIN supplier ON c_nationkey = s_nationkey AND c_acctbal < s_acctbal from counts by balance: who
    # meets n of the other side has n rows, who meets none has one. The balances of a nation are in cents, so a window is bounded.
    ("rel_full_join", """WITH c AS (SELECT c_nationkey, c_acctbal, count(*) AS c_all, count(c_custkey) AS c_n FROM customer GROUP BY 1, 2),
      s AS (SELECT s_nationkey, s_acctbal, count(*) AS s_all, count(s_suppkey) AS s_n FROM supplier GROUP BY 1, 2),
      b AS (SELECT coalesce(c_nationkey, s_nationkey) AS k, coalesce(c_acctbal, s_acctbal) AS bal, c_all, c_n, s_all, s_n FROM c FULL JOIN s ON c_nationkey = s_nationkey AND c_acctbal = s_acctbal),
      m AS (SELECT *, sum(CASE WHEN bal IS NOT NULL THEN s_all END) OVER (PARTITION BY k ORDER BY bal DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS richer,
        sum(CASE WHEN bal IS NOT NULL THEN c_all END) OVER (PARTITION BY k ORDER BY bal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS poorer FROM b)
      SELECT k, sum(coalesce(c_n, 0) * CASE WHEN k IS NOT NULL AND bal IS NOT NULL AND richer > 0 THEN richer ELSE 1 END) AS c,
        sum(coalesce(s_n, 0) * CASE WHEN k IS NOT NULL AND bal IS NOT NULL AND poorer > 0 THEN poorer ELSE 1 END) AS s FROM m GROUP BY k""",
     "SELECT coalesce(c_nationkey, s_nationkey) AS k, count(c_custkey) AS c, count(s_suppkey) AS s FROM customer FULL JOIN supplier ON c_nationkey = s_nationkey AND c_acctbal < s_acctbal GROUP BY 1"),
    ("rel_semi_join", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 49)", None),
    ("rel_anti_join", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)", None),
    ("rel_theta_join", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_name < b.n_name", None),
    ("rel_rollup", "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY ROLLUP (c_mktsegment, c_nationkey)", None),
    ("rel_cube", "SELECT l_returnflag, l_linestatus, grouping(l_returnflag) AS g, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
     "SELECT l_returnflag, l_linestatus, grouping(l_returnflag)::TINYINT AS g, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)"),
    ("rel_grouping_sets", "SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY GROUPING SETS ((p_brand), (p_size), ())", None),
    ("rel_ranking", "SELECT o_custkey, o_orderkey, row_number() OVER w AS rn, rank() OVER w AS rk, dense_rank() OVER w AS dr, ntile(4) OVER w AS q FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)",
     "SELECT o_custkey, o_orderkey, (row_number() OVER w)::INT AS rn, (rank() OVER w)::INT AS rk, (dense_rank() OVER w)::INT AS dr, (ntile(4) OVER w)::INT AS q FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)"),
    ("rel_frames", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS moving, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders", None),
    ("rel_union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier", None),
    ("rel_intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier", None),
    ("rel_except_all", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier", None),
    ("rel_having_subquery", "SELECT l_orderkey, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > (SELECT 3 * avg(l_quantity) FROM lineitem)", None),
    ("rel_correlated", "SELECT p_partkey FROM part p WHERE p_retailprice > (SELECT avg(p_retailprice) FROM part q WHERE q.p_brand = p.p_brand)", None),
    ("rel_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100", None),
    ("rel_pivot", "SELECT * FROM (SELECT l_returnflag, l_linestatus, l_quantity FROM lineitem) PIVOT (count(l_quantity) FOR l_linestatus IN ('O' AS o, 'F' AS f))",
     "SELECT l_returnflag, nullif(count(*) FILTER (WHERE l_linestatus = 'O'), 0) AS o, nullif(count(*) FILTER (WHERE l_linestatus = 'F'), 0) AS f FROM lineitem GROUP BY 1"),
    ("rel_unpivot", "SELECT * FROM (SELECT p_partkey, p_size * 1.0D AS size, p_retailprice AS price FROM part) UNPIVOT (v FOR what IN (size, price))",
     "SELECT p_partkey, 'size' AS what, p_size::DOUBLE AS v FROM part UNION ALL SELECT p_partkey, 'price', p_retailprice FROM part"),
    ("rel_json", "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM events", "SELECT event_id, (props->>'k')::BIGINT AS k FROM events"),
    ("rel_dates", "SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, count(*) AS n FROM orders GROUP BY 1, 2", "SELECT year(o_orderdate)::INT AS y, month(o_orderdate)::INT AS m, count(*) AS n FROM orders GROUP BY 1, 2"),
    ("rel_strings", "SELECT p_partkey, upper(substr(p_name, 1, 5)) AS head, length(p_name) AS len, replace(p_type, ' ', '_') AS kind FROM part", "SELECT p_partkey, upper(substr(p_name, 1, 5)) AS head, length(p_name)::INT AS len, replace(p_type, ' ', '_') AS kind FROM part"),
    ("rel_arrays", "SELECT o_custkey, array_sort(collect_list(o_orderkey)) AS keys FROM orders GROUP BY o_custkey", "SELECT o_custkey, list_sort(list(o_orderkey)) AS keys FROM orders GROUP BY o_custkey"),
    ("rel_case_in_between", "SELECT CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal BETWEEN 0 AND 5000 THEN 'some' ELSE 'rich' END AS band, count(*) AS n FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE') GROUP BY 1", None),
    ("rel_lateral", "SELECT c_custkey, o.total FROM customer, LATERAL (SELECT round(sum(o_totalprice), 2) AS total FROM orders WHERE o_custkey = c_custkey) o", None),
    ("rel_recursive", "WITH RECURSIVE t(n, v) AS (SELECT 1, 1L UNION ALL SELECT n + 1, v * 2 FROM t WHERE n < 20) SELECT n, v FROM t", "WITH RECURSIVE t(n, v) AS (SELECT 1, 1::BIGINT UNION ALL SELECT n + 1, v * 2 FROM t WHERE n < 20) SELECT n, v FROM t"),
    ("rel_median_percentile", "SELECT l_returnflag, median(l_quantity) AS mid, round(percentile(l_extendedprice, 0.9), 4) AS p90 FROM lineitem GROUP BY 1", "SELECT l_returnflag, median(l_quantity) AS mid, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90 FROM lineitem GROUP BY 1"),
    ("rel_multi_join", """SELECT r_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
      JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""", None),
    ("rel_range_join", "SELECT a.event_id, count(b.event_id) AS later FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 1 HOUR GROUP BY a.event_id", None),
    ("rel_approximate", "SELECT event_type, approx_count_distinct(user_id) AS users, percentile_approx(value, 0.5) AS mid FROM events GROUP BY 1", ""),
]


def sql(spark: SparkSession, folder: str, statement: str, tables: list[str] = TABLES) -> DataFrame:
    """A statement over the tables of a folder, by their names."""
    for name in tables:
        if name in statement:
            table(spark, folder, name).createOrReplaceTempView(name)
    return spark.sql(statement)


def _register(name: str, statement: str, against: str | None) -> None:
    @RELATIONAL.add(name, (statement if against is None else against) or None)
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return sql(spark, folder, statement)

    query.__doc__ = statement


for _name, _statement, _against in STATEMENTS:
    _register(_name, _statement, _against)


@RELATIONAL.add(
    "rel_as_of_join",
    "SELECT a.event_id, (SELECT max(b.event_id) FROM events b WHERE b.user_id = a.user_id AND b.event_type = 'view' AND (b.ts, b.event_id) < (a.ts, a.event_id)) IS NOT NULL AS seen_before FROM events a WHERE a.event_type = 'purchase'",
)
def rel_as_of_join(spark: SparkSession, folder: str) -> DataFrame:
    """Whether each purchase had a view by the same user before it: a last-known value, not a join of all pairs."""
    return sql(
        spark,
        folder,
        """SELECT event_id, seen IS NOT NULL AS seen_before FROM (SELECT *, last_value(CASE WHEN event_type = 'view' THEN event_id END) IGNORE NULLS OVER
           (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM events) WHERE event_type = 'purchase'""",
    )
