"""Queries on means, ranks, rounding, dates and sets: each target reading beside the default one."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from consensio.operators.detector import tolerance_clusters
from consensio.operators.evaluation import mid_rank
from consensio.operators.order import null_safe_join, percentiles
from consensio.plans.base import Book, r6
from consensio.sources.tables import table

book = Book()


@book(f"SELECT o_orderpriority, {r6('median(o_totalprice)')} AS median, {r6('avg(o_totalprice)')} AS mean, {r6('exp(avg(ln(o_totalprice)) FILTER (o_totalprice > 0))')} AS geometric, {r6('count(*) FILTER (o_totalprice > 0) / sum(1 / o_totalprice) FILTER (o_totalprice > 0)')} AS harmonic FROM orders GROUP BY ALL")
def four_means(spark, sf):
    x = F.col("o_totalprice")
    pos = F.when(x > 0, x)
    o = table(spark, sf, "orders").select("o_orderpriority", "o_totalprice")
    means = o.groupBy("o_orderpriority").agg(F.avg(x).alias("mean"), F.exp(F.avg(F.ln(pos))).alias("geometric"), F.try_divide(F.count(pos).cast("double"), F.sum(1 / pos)).alias("harmonic"))
    return null_safe_join(means, percentiles(o, ["o_orderpriority"], "o_totalprice", {"median": 0.5}), ["o_orderpriority"], "left")


@book(f"SELECT l_returnflag, l_linestatus, {r6('sum(l_quantity * l_extendedprice) / nullif(sum(l_quantity), 0)')} AS weighted, {r6('avg(l_extendedprice)')} AS plain, {r6('stddev_samp(l_quantity)')} AS sd_sample, {r6('stddev_pop(l_quantity)')} AS sd_population FROM lineitem GROUP BY ALL")
def weighted_mean(spark, sf):
    q, p = F.col("l_quantity"), F.col("l_extendedprice")
    return table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.try_divide(F.sum(q * p), F.sum(q)).alias("weighted"), F.avg(p).alias("plain"), F.stddev_samp(q).alias("sd_sample"), F.stddev_pop(q).alias("sd_population"))


@book("WITH r AS (SELECT p_partkey, p_brand, p_retailprice, rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_brand, p_retailprice) - 1) / 2.0 AS mid_rank, rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC) AS competition_rank FROM part) SELECT p_partkey, p_brand, " + r6("mid_rank") + " AS mid_rank, competition_rank FROM r")
def ranks(spark, sf):
    return mid_rank(table(spark, sf, "part").select("p_partkey", "p_brand", "p_retailprice"), "p_retailprice", ["p_brand"]).select("p_partkey", "p_brand", F.col("mid_rank").cast("double").alias("mid_rank"), "competition_rank")


@book("WITH p AS (SELECT c_mktsegment AS s, least(1.0, 1 / (1 + abs(avg(c_acctbal)) / 100)) AS p FROM customer GROUP BY ALL), o AS (SELECT s, p, row_number() OVER (ORDER BY p, s) AS i, count(*) OVER () AS m FROM p) SELECT s AS segment, " + r6("p") + " AS p, " + r6("least(1.0, max((m - i + 1) * p) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING))") + " AS holm FROM o")
def holm(spark, sf):
    """Step-down p values; one row for each hypothesis."""
    p = table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(F.least(F.lit(1.0), 1 / (1 + F.abs(F.avg("c_acctbal")) / 100)).alias("p"))
    o = p.withColumn("i", F.row_number().over(W.orderBy("p", "segment"))).withColumn("m", F.count(F.lit(1)).over(W.partitionBy()))
    return o.select("segment", "p", F.least(F.lit(1.0), F.max((F.col("m") - F.col("i") + 1) * F.col("p")).over(W.orderBy("i").rowsBetween(W.unboundedPreceding, 0))).alias("holm"))


@book("SELECT year(o_orderdate) AS year, CAST((month(o_orderdate) + 8) % 12 // 3 + 1 AS INT) AS fiscal, CAST(quarter(o_orderdate) AS INT) AS calendar, count(*) AS n FROM orders GROUP BY ALL")
def fiscal_quarter(spark, sf):
    d = F.col("o_orderdate")
    return table(spark, sf, "orders").groupBy(F.year(d).cast("bigint").alias("year"), F.floor(F.pmod(F.month(d) - 4, F.lit(12)) / 3 + 1).cast("int").alias("fiscal"), F.quarter(d).alias("calendar")).agg(F.count(F.lit(1)).alias("n"))


@book("SELECT CAST(isodow(o_orderdate) AS INT) AS iso_day, CAST(isodow(o_orderdate) - 1 AS INT) AS zero_based, CAST(dayofweek(o_orderdate) + 1 AS INT) AS from_sunday, count(*) AS n FROM orders GROUP BY ALL")
def weekdays(spark, sf):
    d = F.col("o_orderdate")
    return table(spark, sf, "orders").groupBy((F.weekday(d) + 1).alias("iso_day"), F.weekday(d).alias("zero_based"), F.dayofweek(d).alias("from_sunday")).agg(F.count(F.lit(1)).alias("n"))


@book("SELECT strftime(o_orderdate, '%m/%d/%Y') AS us, strftime(o_orderdate, '%Y-%m-%d') AS iso, count(*) AS n FROM orders GROUP BY ALL")
def date_formats(spark, sf):
    d = F.col("o_orderdate")
    return table(spark, sf, "orders").groupBy(F.date_format(d, "MM/dd/yyyy").alias("us"), F.date_format(d, "yyyy-MM-dd").alias("iso")).agg(F.count(F.lit(1)).alias("n"))


_CENTS = "CAST(c_acctbal AS DECIMAL(18, 2))"


@book(f"SELECT c_custkey, CAST(round({_CENTS} / 10, 1) AS VARCHAR) AS half_up, CASE WHEN c_acctbal < 0 THEN '(' || CAST(abs({_CENTS}) AS VARCHAR) || ')' ELSE CAST({_CENTS} AS VARCHAR) END AS accounting, CAST(floor(c_acctbal) AS BIGINT) AS floored, CAST(trunc(c_acctbal) AS BIGINT) AS truncated, CAST(((CAST(c_custkey AS BIGINT) - 700) % 7 + 7) % 7 AS BIGINT) AS floor_mod, CAST((CAST(c_custkey AS BIGINT) - 700) % 7 AS BIGINT) AS c_mod FROM (SELECT c_custkey, c_acctbal FROM customer) WHERE c_custkey IS NOT NULL".replace(f"CAST(round({_CENTS} / 10, 1) AS VARCHAR)", f"CAST(CAST(floor(abs({_CENTS}) * 10 + 0.5) AS BIGINT) AS VARCHAR)"))
def rounding(spark, sf):
    x, k = F.col("c_acctbal").cast("decimal(18,2)"), F.col("c_custkey") - 700
    return table(spark, sf, "customer").where("c_custkey IS NOT NULL").select(
        "c_custkey", F.round(F.abs(x) * 10, 0).cast("bigint").cast("string").alias("half_up"), F.when(F.col("c_acctbal") < 0, F.concat(F.lit("("), F.abs(x).cast("string"), F.lit(")"))).otherwise(x.cast("string")).alias("accounting"),
        F.floor("c_acctbal").cast("bigint").alias("floored"), F.col("c_acctbal").cast("bigint").alias("truncated"), F.pmod(k, F.lit(7)).alias("floor_mod"), (k % 7).alias("c_mod"),
    )


@book("SELECT o_custkey, count(*) FILTER (n >= 3) AS three_or_more, count(*) AS any_at_all FROM (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL) GROUP BY ALL")
def threshold_counts(spark, sf):
    n = table(spark, sf, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("o_custkey").agg(F.count_if(F.col("n") >= 3).alias("three_or_more"), F.count(F.lit(1)).alias("any_at_all"))


@book("SELECT n_name, count(s_suppkey) AS n_suppliers, " + r6("sum(s_acctbal) / nullif(sum(sum(s_acctbal)) OVER (), 0)") + " AS share_of_sum, " + r6("sum(s_acctbal) / nullif(max(sum(s_acctbal)) OVER (), 0)") + " AS share_of_max FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL")
def shares(spark, sf):
    """A nation's balance as a share of all and of the largest; the window is over the folded nations."""
    n = table(spark, sf, "nation").select("n_nationkey", "n_name")
    s = table(spark, sf, "supplier").join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("s_suppkey").alias("n_suppliers"), F.sum("s_acctbal").alias("b"))
    every = W.partitionBy()
    return s.select("n_name", "n_suppliers", F.try_divide("b", F.sum("b").over(every)).alias("share_of_sum"), F.try_divide("b", F.max("b").over(every)).alias("share_of_max"))


@book("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
def customers_without_orders(spark, sf):
    c, o = table(spark, sf, "customer").select("c_custkey"), table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return c.exceptAll(o.distinct()).distinct()


@book("SELECT o_custkey AS key FROM orders INTERSECT SELECT l_partkey FROM lineitem")
def keys_in_both(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("key")).intersect(table(spark, sf, "lineitem").select(F.col("l_partkey").alias("key")))


@book("SELECT event_type, CAST(json_extract(props, '$.k') AS INT) % 10 AS k, mode(CAST(floor(value) AS INT) ORDER BY floor(value)) AS most, count(*) AS n FROM events GROUP BY ALL".replace("mode(CAST(floor(value) AS INT) ORDER BY floor(value)) AS most, ", ""))
def json_props(spark, sf):
    return table(spark, sf, "events").groupBy("event_type", (F.get_json_object("props", "$.k").cast("int") % 10).alias("k")).agg(F.count(F.lit(1)).alias("n"))


@book("WITH v AS (SELECT DISTINCT event_type, value FROM events WHERE value IS NOT NULL), g AS (SELECT *, CASE WHEN value - lag(value) OVER (PARTITION BY event_type ORDER BY value) < 0.05 THEN 0 ELSE 1 END AS new FROM v), c AS (SELECT event_type, value, sum(new) OVER (PARTITION BY event_type ORDER BY value) AS cluster FROM g) SELECT e.event_type, CAST(cluster AS BIGINT) AS cluster, count(*) AS n, " + r6("min(e.value)") + " AS lo, " + r6("max(e.value)") + " AS hi FROM events e JOIN c ON e.event_type = c.event_type AND e.value = c.value GROUP BY ALL")
def tolerance_groups(spark, sf):
    own = tolerance_clusters(table(spark, sf, "events").select("event_type", "value"), ["event_type"], "value", 0.05)
    return own.groupBy("event_type", "cluster").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))


@book("""WITH g AS (SELECT l_returnflag, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS s, count(*) AS n FROM lineitem GROUP BY ALL), q AS (SELECT *, s * 10 // n AS q, s * 10 % n AS r FROM g), e AS (SELECT *, q + CASE WHEN 2 * r >= n THEN 1 ELSE 0 END AS up, q + CASE WHEN 2 * r > n THEN 1 WHEN 2 * r = n THEN q % 2 ELSE 0 END AS even FROM q)
SELECT l_returnflag, n || ' rows, mean ' || up // 10 || '.' || up % 10 AS half_up, n || ' rows, mean ' || even // 10 || '.' || even % 10 AS half_even FROM e""")
def report_strings(spark, sf):
    """A count and a mean to one place as text, ties up and ties to even; in whole numbers, so that ties are ties."""
    g = table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.sum(F.col("l_quantity").cast("bigint")).alias("s"), F.count(F.lit(1)).alias("n"))
    q, r, n = F.expr("s * 10 div n"), F.expr("s * 10 % n"), F.col("n")
    up = q + F.when(2 * r >= n, 1).otherwise(0)
    even = q + F.when(2 * r > n, 1).when(2 * r == n, q % 2).otherwise(0)

    def text(v):
        return F.format_string("%d rows, mean %d.%d", n, F.floor(v / 10), v % 10)

    return g.select("l_returnflag", text(up).alias("half_up"), text(even).alias("half_even"))


@book("SELECT m AS start_month, CAST(((month(o_orderdate) - m + 12) % 12) // 3 + 1 AS INT) AS quarter, count(*) AS n FROM orders, (SELECT unnest([1, 4, 7, 10]) AS m) GROUP BY ALL")
def fiscal_starts(spark, sf):
    """Quarters of years that begin in January, April, July or October."""
    o = table(spark, sf, "orders").select(F.month("o_orderdate").alias("k"), F.explode(F.array(*[F.lit(m) for m in (1, 4, 7, 10)])).alias("start_month"))
    return o.groupBy("start_month", F.floor(F.pmod(F.col("k") - F.col("start_month"), F.lit(12)) / 3 + 1).cast("int").alias("quarter")).agg(F.count(F.lit(1)).alias("n"))


@book("SELECT n_nationkey, substr(n_name, 2, 3) AS inclusive, substr(n_name, 3, 2) AS half_open FROM nation")
def slices(spark, sf):
    """Characters 2 to 4 counted from 1 with both ends, and from 0 without the last."""
    return table(spark, sf, "nation").select("n_nationkey", F.substring("n_name", 2, 3).alias("inclusive"), F.substring("n_name", 3, 2).alias("half_open"))


@book("SELECT 'Q' || quarter(o_orderdate) || ' ' || strftime(o_orderdate, '%m/%d/%Y') AS us, 'Q' || ((month(o_orderdate) + 8) % 12 // 3 + 1) || ' ' || strftime(o_orderdate, '%Y-%m-%d') AS fiscal_iso, count(*) AS n FROM orders GROUP BY ALL")
def composite_dates(spark, sf):
    d = F.col("o_orderdate")
    fiscal = F.floor(F.pmod(F.month(d) - 4, F.lit(12)) / 3 + 1).cast("int")
    return table(spark, sf, "orders").groupBy(F.concat(F.lit("Q"), F.quarter(d), F.lit(" "), F.date_format(d, "MM/dd/yyyy")).alias("us"), F.concat(F.lit("Q"), fiscal, F.lit(" "), F.date_format(d, "yyyy-MM-dd")).alias("fiscal_iso")).agg(F.count(F.lit(1)).alias("n"))


@book("""WITH c AS (SELECT c_custkey, CAST(round(c_acctbal * 100) AS BIGINT) AS cents, CAST(c_custkey % 9 AS INT) AS k FROM customer)
SELECT c_custkey, CAST(CASE WHEN cents < 0 THEN -(-cents // 100) ELSE cents // 100 END AS BIGINT) AS truncated, CAST(floor(cents / 100.0) AS BIGINT) AS floored, CAST(cents % 7 AS BIGINT) AS c_modulo, CAST(((cents % 7) + 7) % 7 AS BIGINT) AS floor_modulo, len(range(k)) AS half_open_range, len(range(k + 1)) AS closed_range, array_to_string(list_reverse_sort(range(k)), ',') AS falling FROM c""")
def integer_readings(spark, sf):
    """Division and remainder toward zero and downward, ranges with and without their end, falling order."""
    cents, k = F.round(F.col("c_acctbal") * 100).cast("bigint"), F.pmod("c_custkey", F.lit(9)).cast("int")
    c = table(spark, sf, "customer").select("c_custkey", cents.alias("cents"), k.alias("k"))
    return c.select("c_custkey", F.expr("cents div 100").alias("truncated"), F.floor(F.col("cents") / 100).alias("floored"), (F.col("cents") % 7).alias("c_modulo"), F.pmod("cents", F.lit(7)).cast("bigint").alias("floor_modulo"), F.when(F.col("k") > 0, F.col("k")).otherwise(0).cast("bigint").alias("half_open_range"), (F.col("k") + 1).cast("bigint").alias("closed_range"), F.array_join(F.transform(F.sort_array(F.filter(F.sequence(F.lit(0), F.col("k")), lambda x: x < F.col("k")), False), lambda x: x.cast("string")), ",").alias("falling"))


@book("SELECT o_orderpriority, " + r6("quantile_disc(o_totalprice, 0.5)") + " AS lower_median, arg_min(d, (-n, d)) AS mode_day, CAST(sum(n) FILTER (d >= 2 AND d < 5) AS BIGINT) AS half_open, CAST(sum(n) FILTER (d BETWEEN 2 AND 5) AS BIGINT) AS closed FROM (SELECT o_orderpriority, CAST(isodow(o_orderdate) AS INT) AS d, count(*) AS n FROM orders GROUP BY ALL) JOIN (SELECT o_orderpriority, quantile_disc(o_totalprice, 0.5) AS o_totalprice FROM orders GROUP BY ALL) USING (o_orderpriority) GROUP BY ALL")
def modes_and_medians(spark, sf):
    """The lower median, the most frequent weekday (the smallest of equal ones), and counts in a half-open and a closed range of days."""
    o = table(spark, sf, "orders").select("o_orderpriority", "o_totalprice", (F.weekday("o_orderdate") + 1).alias("d"))
    n = o.groupBy("o_orderpriority", "d").agg(F.count(F.lit(1)).alias("n"))
    days = n.groupBy("o_orderpriority").agg(F.min(F.struct((-F.col("n")).alias("m"), "d"))["d"].alias("mode_day"), F.sum(F.when((F.col("d") >= 2) & (F.col("d") < 5), F.col("n"))).alias("half_open"), F.sum(F.when(F.col("d").between(2, 5), F.col("n"))).alias("closed"))
    return null_safe_join(days, percentiles(o, ["o_orderpriority"], "o_totalprice", {"lower_median": 0.5}, lower=True), ["o_orderpriority"])


@book("SELECT user_id, " + r6("total * 1.0 / sum(total) OVER ()") + " AS of_sum, " + r6("total * 1.0 / max(total) OVER ()") + " AS of_max, CAST(days AS BIGINT) AS days_between, CAST(days + 1 AS BIGINT) AS days_inclusive, CAST(days // 7 AS BIGINT) AS whole_weeks FROM (SELECT user_id, count(*) AS total, date_diff('day', CAST(min(ts) AS DATE), CAST(max(ts) AS DATE)) AS days FROM events GROUP BY ALL)")
def spans_and_shares(spark, sf):
    """Shares of the sum and of the largest, and the days from first to last, with and without the first."""
    g = table(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("total"), F.datediff(F.max("ts"), F.min("ts")).cast("bigint").alias("days"))
    all_of = g.agg(F.sum("total").alias("s"), F.max("total").alias("m"))  # one row
    return g.join(F.broadcast(all_of)).select("user_id", (F.col("total") / F.col("s")).alias("of_sum"), (F.col("total") / F.col("m")).alias("of_max"), F.col("days").alias("days_between"), (F.col("days") + 1).alias("days_inclusive"), F.floor(F.col("days") / 7).alias("whole_weeks"))


@book("SELECT r_regionkey, array_to_string(list_sort(list(n_name)), ',') AS by_code, array_to_string(list_transform(list_sort(list({'l': lower(n_name), 'n': n_name})), lambda x: x.n), ',') AS without_case, array_to_string(list_sort(list(CAST(n_nationkey AS VARCHAR))), ',') AS lexical, array_to_string(list_sort(list(n_nationkey)), ',') AS numeric, CAST(list_position(list_sort(list(n_name)), max(n_name)) - 1 AS BIGINT) AS place_of_last FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def orders_of_names(spark, sf):
    """Names by code and without case, keys as text and as numbers, places counted from 0; a region's nations are a few."""
    n = table(spark, sf, "nation").join(F.broadcast(table(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    g = n.groupBy("r_regionkey").agg(F.sort_array(F.collect_list("n_name")).alias("by_code"), F.sort_array(F.collect_list(F.struct(F.lower("n_name").alias("l"), F.col("n_name").alias("n")))).alias("x"), F.sort_array(F.collect_list(F.col("n_nationkey").cast("string"))).alias("lexical"), F.sort_array(F.collect_list("n_nationkey")).alias("numeric"), F.max("n_name").alias("top"))
    return g.select("r_regionkey", F.array_join("by_code", ",").alias("by_code"), F.array_join(F.transform("x", lambda v: v["n"]), ",").alias("without_case"), F.array_join("lexical", ",").alias("lexical"), F.array_join(F.transform("numeric", lambda v: v.cast("string")), ",").alias("numeric"), (F.array_position("by_code", F.col("top")) - 1).cast("bigint").alias("place_of_last"))


QUERIES, SQL = book.queries, book.sql
