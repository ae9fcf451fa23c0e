"""Sales jobs and their SQL twins."""

from __future__ import annotations

from brandweave.operators import sales as op
from brandweave.sources.tables import read, sales

_SALES = """
WITH sales AS (
  SELECT l_orderkey AS order_key, l_linenumber AS line, p_partkey AS part_key, p_brand AS brand, p_type AS type, r_name AS region,
         c_custkey AS customer, o_orderdate AS ordered,
         cast(l_extendedprice AS decimal(12,2)) * (1 - cast(l_discount AS decimal(4,2))) AS revenue
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
"""
_TREND = _SALES + """,
totals AS (SELECT date_trunc('month', ordered)::TIMESTAMP AS period, brand, sum(revenue) AS exact FROM sales GROUP BY ALL),
calendar AS (SELECT unnest(generate_series(min(period), max(period), INTERVAL 1 MONTH)) AS period FROM totals),
whole AS (
  SELECT period, brand, coalesce(exact, 0) AS exact
  FROM (SELECT period, brand FROM calendar, (SELECT DISTINCT brand FROM totals)) LEFT JOIN totals USING (period, brand)),
ranked AS (SELECT *, rank() OVER (PARTITION BY period ORDER BY exact DESC, brand) AS rank FROM whole)
"""

QUERIES = {
    "brand_revenue": lambda spark, d: op.brand_revenue(read(spark, d, "lineitem"), read(spark, d, "part")),
    "brand_share": lambda spark, d: op.brand_share(sales(spark, d)),
    "brand_trend": lambda spark, d: op.brand_trend(sales(spark, d)),
    "brand_moving_avg": lambda spark, d: op.brand_moving_avg(op.brand_trend(sales(spark, d))),
    "brand_cube": lambda spark, d: op.brand_cube(sales(spark, d)),
    "brand_top_parts": lambda spark, d: op.brand_top_parts(sales(spark, d)),
    "brand_price_position": lambda spark, d: op.brand_price_position(read(spark, d, "part")),
    "brand_return_rate": lambda spark, d: op.brand_return_rate(read(spark, d, "lineitem"), read(spark, d, "part")),
    "brand_affinity": lambda spark, d: op.brand_affinity(sales(spark, d)),
    "brand_switching": lambda spark, d: op.brand_switching(sales(spark, d)),
    "brand_lapsed": lambda spark, d: op.brand_lapsed(sales(spark, d)),
    "brand_concentration": lambda spark, d: op.brand_concentration(sales(spark, d)),
}

ORACLES = {
    "brand_revenue": """
        SELECT p_brand AS brand, sum(cast(l_extendedprice AS decimal(12,2)) * (1 - cast(l_discount AS decimal(4,2))))::DOUBLE AS revenue,
               count(*) AS n_lines, count(DISTINCT p_partkey) AS n_parts
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand""",
    "brand_share": _SALES + """
        SELECT region, brand, sum(revenue)::DOUBLE AS revenue,
               round(sum(revenue)::DOUBLE / (sum(sum(revenue)) OVER (PARTITION BY region))::DOUBLE, 6) AS share,
               rank() OVER (PARTITION BY region ORDER BY sum(revenue) DESC, brand) AS rank
        FROM sales GROUP BY region, brand""",
    "brand_trend": _TREND + """
        SELECT period, brand, exact::DOUBLE AS revenue, (exact - lag(exact) OVER w)::DOUBLE AS change, rank, lag(rank) OVER w - rank AS moved
        FROM ranked WINDOW w AS (PARTITION BY brand ORDER BY period)""",
    "brand_moving_avg": _TREND + """
        SELECT period, brand, (sum(exact) OVER w)::DOUBLE / count(*) OVER w AS average, count(*) OVER w AS n
        FROM ranked WINDOW w AS (PARTITION BY brand ORDER BY period ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""",
    "brand_cube": _SALES + """
        SELECT region, brand, type, sum(revenue)::DOUBLE AS revenue, grouping(region, brand, type)::BIGINT AS grouping
        FROM sales GROUP BY CUBE (region, brand, type)""",
    "brand_top_parts": _SALES + """
        SELECT * FROM (
          SELECT brand, row_number() OVER (PARTITION BY brand ORDER BY sum(revenue) DESC, part_key) AS place, part_key, sum(revenue)::DOUBLE AS revenue
          FROM sales GROUP BY brand, part_key) WHERE place <= 3""",
    "brand_price_position": """
        SELECT brand, type, n_parts, round(median, 6) AS median, round(type_median, 6) AS type_median, round(median / type_median, 6) AS position
        FROM (SELECT p_brand AS brand, p_type AS type, count(*) AS n_parts, quantile_cont(p_retailprice, 0.5) AS median FROM part GROUP BY ALL)
        JOIN (SELECT p_type AS of, quantile_cont(p_retailprice, 0.5) AS type_median FROM part GROUP BY ALL) ON type IS NOT DISTINCT FROM of""",
    "brand_return_rate": """
        SELECT brand, returned, quantity, round(returned / quantity, 6) AS rate FROM (
          SELECT p_brand AS brand, sum(CASE WHEN l_returnflag = 'R' THEN cast(l_quantity AS decimal(12,2)) ELSE 0 END)::DOUBLE AS returned,
                 sum(cast(l_quantity AS decimal(12,2)))::DOUBLE AS quantity
          FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand)""",
    "brand_affinity": _SALES + """,
        held AS (SELECT DISTINCT order_key, brand FROM sales),
        single AS (SELECT brand, count(*) AS n FROM held GROUP BY brand),
        pairs AS (SELECT x.brand AS a, y.brand AS b, count(*) AS n_both FROM held x JOIN held y USING (order_key) WHERE x.brand < y.brand GROUP BY ALL)
        SELECT a, b, n_both, round(n_both / orders, 6) AS support, round(n_both / s.n, 6) AS confidence, round(n_both * orders / (s.n * t.n), 6) AS lift
        FROM pairs JOIN single s ON a = s.brand JOIN single t ON b = t.brand, (SELECT count(DISTINCT order_key) AS orders FROM held)""",
    "brand_switching": _SALES + """,
        largest AS (
          SELECT customer, order_key, ordered, brand,
                 row_number() OVER (PARTITION BY customer, order_key ORDER BY revenue DESC, line DESC, part_key DESC, brand DESC) AS place FROM sales),
        moves AS (
          SELECT brand AS from_brand, lead(brand) OVER (PARTITION BY customer ORDER BY ordered, order_key) AS to_brand FROM largest WHERE place = 1)
        SELECT from_brand, to_brand, count(*) AS n FROM moves WHERE to_brand IS NOT NULL GROUP BY ALL""",
    "brand_lapsed": _SALES + """
        SELECT brand, customer FROM sales GROUP BY ALL HAVING max(ordered) < TIMESTAMP '2000-01-01'""",
    "brand_concentration": _SALES + """
        SELECT region, round(sum(share * share), 6) AS concentration, count(*) AS n_brands FROM (
          SELECT region, brand, sum(revenue)::DOUBLE / (sum(sum(revenue)) OVER (PARTITION BY region))::DOUBLE AS share FROM sales GROUP BY region, brand)
        GROUP BY region""",
}
