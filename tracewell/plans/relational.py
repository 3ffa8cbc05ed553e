"""Registered queries of filters, statistics, joins, windows and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import relational as R
from ..sources.views import METHODS, RESULTS, methods, results, table

CELLS = "'red, \"small, blue\" ring;  widget and ' || p_name || ', n/a, x'"


def _cell(s, d):
    return table(s, d, "part").select("p_partkey", F.concat(F.lit('red, "small, blue" ring;  widget and '), "p_name", F.lit(", n/a, x")).alias("cell"))


def star(s, d):
    return (
        table(s, d, "lineitem").join(table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(F.broadcast(table(s, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(table(s, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    )  # fmt: skip  # nation and region hold 25 and 5 rows at every scale


STAR = "lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
def _revenue():
    return F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue")


_REVENUE = "round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue"


def grouping_sets(s, d):
    return star(s, d).groupingSets([["r_name"], ["c_mktsegment"], []], "r_name", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


def asof(s, d):
    e = table(s, d, "events")
    left = e.where("event_type = 'purchase'").select("user_id", "ts", "event_id")
    right = e.where("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    return R.asof_join(left, right, "user_id", "ts", "value")


def theta(s, d):
    bands = table(s, d, "nation").select("n_name", (F.col("n_nationkey") * 400 - 1000).alias("low"), (F.col("n_nationkey") * 400 - 301).alias("high"))
    return R.band_join(table(s, d, "supplier").select("s_suppkey", "s_acctbal"), bands, "s_acctbal", "low", "high", 500).select("s_suppkey", "n_name")


def _line():
    """A cell as of a CSV line: a plain value, one with a comma in quotes and text after them, an empty one, doubled quotes."""
    return F.concat("p_brand", F.lit(', "'), "p_type", F.lit(", "), "p_name", F.lit('" end, , "say ""'), "p_type", F.lit('"""'), F.when(F.col("p_size") % 2 == 0, ",  a  b ").otherwise(","))


QUERIES = {
    "src_split_values": (
        lambda s, d: _cell(s, d).select("p_partkey", F.array_join(R.split_values(F.col("cell")), "|").alias("parts")),
        f"SELECT p_partkey, array_to_string(list_filter(list_transform(regexp_split_to_array({CELLS}, '[,;]|\\s+and\\s+'), lambda x: trim(x)), lambda x: lower(x) NOT IN ('nan', '', '-', 'n/a', 'none') AND length(x) > 1), '|') AS parts FROM part",
    ),
    "src_smart_split": (
        lambda s, d: table(s, d, "part").select("p_partkey", R.smart_split(_line()).alias("x")).select("p_partkey", F.array_join("x", "|").alias("parts"), F.array_join(F.array_sort("x"), ", ").alias("canonical")),
        """WITH p AS (SELECT p_partkey, [p_brand, p_type || ', ' || p_name || ' end', 'say "' || p_type || '"'] || CASE WHEN p_size % 2 = 0 THEN ['a  b'] ELSE [] END AS x FROM part)
        SELECT p_partkey, array_to_string(x, '|') AS parts, array_to_string(list_sort(x), ', ') AS canonical FROM p""",
    ),
    "ft_filter_and_count": (
        lambda s, d: R.filter_and_count(methods(s, d), {"name": "RED|blue", "brand": r"#1\D*\d$", "missing": "x"}).select("method_id", "name"),
        f"WITH {METHODS} SELECT method_id, name FROM methods WHERE (contains(lower(name), 'red') OR contains(lower(name), 'blue')) AND brand IN ('Brand#10', 'Brand#11', 'Brand#12', 'Brand#13', 'Brand#14', 'Brand#15', 'Brand#16', 'Brand#17', 'Brand#18', 'Brand#19')",
    ),
    "ft_attribute_filter": (
        lambda s, d: R.attribute_filter(methods(s, d), "promo or small parts of brand#13", ("type", "brand")).select("method_id", "type", "brand"),
        f"WITH {METHODS} SELECT method_id, type, brand FROM methods WHERE contains('promo or small parts of brand#13', lower(type)) AND contains('promo or small parts of brand#13', lower(brand))",
    ),
    "ft_structured_matches": (
        lambda s, d: R.structured_matches(methods(s, d), "promo or small parts of brand#13", ("type", "brand")),
        f"""WITH {METHODS}, c AS (SELECT 'type' AS facet, type AS item, count(*) AS n FROM methods GROUP BY type UNION ALL SELECT 'brand', brand, count(*) FROM methods GROUP BY brand)
        SELECT *, row_number() OVER (ORDER BY n, facet, item) AS place FROM c WHERE contains('promo or small parts of brand#13', lower(item))""",
    ),
    "ag_value_distribution": (
        lambda s, d: R.value_distribution(methods(s, d), "words"),
        f"WITH {METHODS}, c AS (SELECT item, count(*) AS n FROM (SELECT unnest(words) AS item FROM methods) GROUP BY item) SELECT item, n, CAST(sum(n) OVER () AS BIGINT) AS total, round(n / sum(n) OVER (), 6) AS share FROM c",
    ),
    "ag_cross_tabulate": (
        lambda s, d: R.cross_tabulate(methods(s, d).withColumn("types", F.array("type", "brand")), "words", "types"),
        f"WITH {METHODS}, w AS (SELECT unnest(words) AS a, type, brand FROM methods) SELECT a, b, count(*) AS n FROM (SELECT a, unnest([type, brand]) AS b FROM w) GROUP BY a, b",
    ),
    "ag_gap_matrix": (
        lambda s, d: R.gap_matrix(methods(s, d).select(F.col("words")[0].alias("word"), "brand"), "word", "brand"),
        f"""WITH {METHODS}, m AS (SELECT words[1] AS word, brand FROM methods), c AS (SELECT word, brand, count(*) AS n FROM m GROUP BY ALL)
        SELECT w.word, b.brand, coalesce(n, 0) AS n FROM (SELECT DISTINCT word FROM m) w CROSS JOIN (SELECT DISTINCT brand FROM m) b LEFT JOIN c ON c.word = w.word AND c.brand = b.brand""",
    ),
    "ag_distribution_stats": (
        lambda s, d: R.top_per_group(methods(s, d), "type", "brand", 5),
        f"WITH {METHODS}, c AS (SELECT type, brand, count(*) AS n FROM methods GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY type ORDER BY n DESC, brand) AS place FROM c QUALIFY place <= 5",
    ),
    "ag_cooccurrence": (
        lambda s, d: R.cooccurrence(results(s, d), "paper", "method", 2),
        f"WITH {RESULTS}, t AS (SELECT DISTINCT paper, method FROM results) SELECT x.method AS a, y.method AS b, count(*) AS weight FROM t x JOIN t y ON x.paper = y.paper AND x.method < y.method GROUP BY ALL HAVING count(*) >= 2",
    ),
    "ag_timeline": (
        lambda s, d: R.dense_timeline(table(s, d, "orders"), F.year("o_orderdate"), "o_orderpriority"),
        """WITH c AS (SELECT year(o_orderdate) AS year, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL)
        SELECT CAST(y.year AS INT) AS year, p.o_orderpriority, coalesce(n, 0) AS n FROM (SELECT unnest(range((SELECT min(year) FROM c), (SELECT max(year) + 1 FROM c))) AS year) y CROSS JOIN (SELECT DISTINCT o_orderpriority FROM c) p LEFT JOIN c ON c.year = y.year AND c.o_orderpriority = p.o_orderpriority""",
    ),
    "ag_hub_histogram": (
        lambda s, d: R.hub_histogram(table(s, d, "orders"), "o_custkey"),
        """WITH g AS (SELECT count(*) AS degree FROM orders GROUP BY o_custkey), t AS (SELECT *, ceil(max(degree) OVER () / 16.0) AS step FROM g)
        SELECT CAST(floor((degree - 1) / step) * step + 1 AS BIGINT) AS low, degree >= 20 AS is_hub, count(*) AS n FROM t GROUP BY ALL""",
    ),
    "ag_rollup_sales": (
        lambda s, d: star(s, d).rollup("r_name", "n_name").agg(_revenue(), F.count(F.lit(1)).alias("n")),
        f"SELECT r_name, n_name, {_REVENUE}, count(*) AS n FROM {STAR} GROUP BY ROLLUP (r_name, n_name)",
    ),
    "ag_cube_sales": (
        lambda s, d: star(s, d).cube("r_name", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity")),
        f"SELECT r_name, c_mktsegment, count(*) AS n, sum(l_quantity) AS quantity FROM {STAR} GROUP BY CUBE (r_name, c_mktsegment)",
    ),
    "ag_grouping_sets": (grouping_sets, f"SELECT r_name, c_mktsegment, count(*) AS n FROM {STAR} GROUP BY GROUPING SETS ((r_name), (c_mktsegment), ())"),
    "ag_pivot_status": (
        lambda s, d: table(s, d, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.sum("l_quantity")).withColumnsRenamed({"F": "qty_f", "O": "qty_o"}),
        "SELECT l_returnflag, sum(l_quantity) FILTER (l_linestatus = 'F') AS qty_f, sum(l_quantity) FILTER (l_linestatus = 'O') AS qty_o FROM lineitem GROUP BY l_returnflag",
    ),
    "jn_semi": (
        lambda s, d: table(s, d, "customer").join(table(s, d, "orders").where("o_orderstatus = 'F'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_mktsegment"),
        "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')",
    ),
    "jn_anti": (
        lambda s, d: table(s, d, "customer").join(table(s, d, "orders").where("o_orderstatus = 'F'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey"),
        "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')",
    ),
    "jn_full_enrich": (
        lambda s, d: table(s, d, "documents").where("lang = 'en'").select("doc_id", "source").join(table(s, d, "labels").where("toxic = 0").select("doc_id", "quality"), "doc_id", "full").select("doc_id", "source", F.coalesce("quality", F.lit(-1)).alias("quality")),
        "SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, source, coalesce(quality, -1) AS quality FROM (SELECT doc_id, source FROM documents WHERE lang = 'en') a FULL JOIN (SELECT doc_id, quality FROM labels WHERE toxic = 0) b ON a.doc_id = b.doc_id",
    ),
    "jn_eqnullsafe": (
        lambda s, d: results(s, d).groupBy("std").agg(F.count(F.lit(1)).alias("n")).alias("a").join(results(s, d).where("is_own").groupBy("std").agg(F.avg("value").alias("m")).alias("b"), F.col("a.std").eqNullSafe(F.col("b.std"))).select(F.col("a.std").alias("std"), "n", F.round("m", 6).alias("mean_own")),
        f"WITH {RESULTS} SELECT a.std, n, round(m, 6) AS mean_own FROM (SELECT std, count(*) AS n FROM results GROUP BY std) a JOIN (SELECT std, avg(value) AS m FROM results WHERE is_own GROUP BY std) b ON a.std IS NOT DISTINCT FROM b.std",
    ),
    "jn_theta_range": (theta, "SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_acctbal BETWEEN n_nationkey * 400 - 1000 AND n_nationkey * 400 - 301"),
    "jn_asof": (
        asof,
        """SELECT p.event_id, p.user_id, v.value FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY ALL) v ON p.user_id = v.user_id AND p.ts >= v.ts""",
    ),
    "jn_edge_display": (
        lambda s, d: table(s, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("weight")).join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(table(s, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_name").alias("source_label"), F.col("n_name").alias("target_label"), "weight"),
        "SELECT c_name AS source_label, n_name AS target_label, weight FROM (SELECT o_custkey, count(*) AS weight FROM orders GROUP BY o_custkey) JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey",
    ),
    "wn_zscore": (
        lambda s, d: R.z_scores(table(s, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal"), "s_nationkey", "s_acctbal"),
        "SELECT s_suppkey, s_nationkey, s_acctbal, round((s_acctbal - avg(s_acctbal) OVER w) / CASE WHEN stddev_pop(s_acctbal) OVER w = 0 THEN 1 ELSE stddev_pop(s_acctbal) OVER w END, 6) AS z FROM supplier WINDOW w AS (PARTITION BY s_nationkey)",
    ),
    "wn_pagination": (
        lambda s, d: R.paged(table(s, d, "orders").select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.col("o_orderkey")], 3, 25),
        "SELECT * FROM (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders) WHERE place BETWEEN 51 AND 75",
    ),
    "wn_newest_per_group": (
        lambda s, d: table(s, d, "orders").groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey")).alias("m")).select("o_custkey", F.col("m.o_orderkey").alias("o_orderkey")),
        "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1",
    ),
    "set_sheet_diff": (
        lambda s, d: R.difference(methods(s, d).where("era < 4"), methods(s, d).where("era >= 2").withColumn("type", F.when(F.col("era") == 3, F.lower("type")).otherwise(F.col("type"))), "method_id", "type"),
        f"""WITH {METHODS}, o AS (SELECT * FROM methods WHERE era < 4), n AS (SELECT method_id, CASE WHEN era = 3 THEN lower(type) ELSE type END AS type FROM methods WHERE era >= 2)
        SELECT coalesce(o.method_id, n.method_id) AS method_id, CASE WHEN o.method_id IS NULL THEN 'added' WHEN n.method_id IS NULL THEN 'removed' ELSE 'edited' END AS kind FROM o FULL JOIN n ON o.method_id = n.method_id WHERE o.method_id IS NULL OR n.method_id IS NULL OR o.type IS DISTINCT FROM n.type""",
    ),
    "set_union_intersect_except": (
        lambda s, d: (lambda a, b: a.intersect(b).withColumn("part", F.lit("both")).unionByName(a.exceptAll(b).distinct().withColumn("part", F.lit("old"))).unionByName(b.subtract(a).withColumn("part", F.lit("new"))))(table(s, d, "part").where("p_size < 30").select("p_name"), table(s, d, "part").where("p_size > 20").select(F.col("p_name"))),
        """WITH a AS (SELECT p_name FROM part WHERE p_size < 30), b AS (SELECT p_name FROM part WHERE p_size > 20)
        SELECT p_name, 'both' AS part FROM (SELECT p_name FROM a INTERSECT SELECT p_name FROM b) UNION ALL SELECT p_name, 'old' FROM (SELECT DISTINCT p_name FROM (SELECT p_name FROM a EXCEPT ALL SELECT p_name FROM b)) UNION ALL SELECT p_name, 'new' FROM (SELECT p_name FROM b EXCEPT SELECT p_name FROM a)""",
    ),
    "set_cluster_overlap": (
        lambda s, d: R.shared_values(results(s, d).withColumn("item", F.concat_ws("/", "metric", "condition", F.col("value").cast("int").cast("string"))), "method", "item", "method", 0.05),
        f"""WITH {RESULTS}, t AS (SELECT DISTINCT method, metric || '/' || condition || '/' || CAST(CAST(value AS INT) AS VARCHAR) AS item FROM results), z AS (SELECT method, count(*) AS n FROM t GROUP BY method),
        c AS (SELECT x.method AS a, y.method AS b, count(*) AS common FROM t x JOIN t y ON x.item = y.item AND x.method < y.method GROUP BY ALL)
        SELECT a, b, common, round(common / (za.n + zb.n - common), 6) AS jaccard FROM c JOIN z za ON za.method = a JOIN z zb ON zb.method = b WHERE round(common / (za.n + zb.n - common), 6) > 0.05""",
    ),
    "set_comparability": (
        lambda s, d: R.comparability(results(s, d), "paper", ("metric", "condition", "std")),
        f"""WITH {RESULTS}, l AS (SELECT paper, 'metric' AS dimension, lower(metric) AS v FROM results UNION ALL SELECT paper, 'condition', lower(condition) FROM results UNION ALL SELECT paper, 'std', CAST(std AS VARCHAR) FROM results)
        SELECT paper, dimension, count(DISTINCT v) AS n, CASE count(DISTINCT v) WHEN 0 THEN 'gap' WHEN 1 THEN 'shared' ELSE 'differs' END AS status FROM l GROUP BY ALL""",
    ),
}
