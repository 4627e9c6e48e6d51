"""Cohort statistics, lookups, set operations, scans and sinks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spanmill.operators import cohort, sampling
from spanmill.plans.session import table
from spanmill.queries.base import CLS, RECTS, Registry, cls, rects, rnd

_r = Registry()
QUERIES, SQL = _r.queries, _r.sql
query = _r.query


@query("SELECT c_mktsegment AS category, count(*) AS n FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY 1")
def cohort_categorical(spark, sf):
    return cohort.frequencies(table(spark, sf, "customer"), "c_mktsegment").withColumnRenamed("c_mktsegment", "category")


@query("WITH c AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2) SELECT c_nationkey, c_mktsegment, n FROM c QUALIFY rank() OVER (PARTITION BY c_nationkey ORDER BY n DESC) = 1")
def cohort_mode_all_ties(spark, sf):
    return cohort.modes(table(spark, sf, "customer"), "c_mktsegment", ["c_nationkey"]).select("c_nationkey", "c_mktsegment", "n")


@query("SELECT round_even(avg(c_acctbal), 2) AS mean, min(c_acctbal) AS min, max(c_acctbal) AS max, round(max(c_acctbal) - min(c_acctbal), 6) AS range FROM customer")
def cohort_continuous(spark, sf):
    return table(spark, sf, "customer").agg(*cohort.summary("c_acctbal")).withColumn("range", rnd(F.col("range")))


@query("SELECT r_name, round_even(avg(c_acctbal), 2) AS mean, min(c_acctbal) AS min, max(c_acctbal) AS max, round(max(c_acctbal) - min(c_acctbal), 6) AS range FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def cohort_by_group(spark, sf):
    # region and nation are fixed tables of 5 and 25 rows
    joined = table(spark, sf, "customer").join(F.broadcast(table(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(table(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("r_name").agg(*cohort.summary("c_acctbal")).withColumn("range", rnd(F.col("range")))


@query("WITH e AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer) SELECT CAST(least(floor((c_acctbal - lo) / (hi - lo) * 5) + 1, 5) AS BIGINT) AS bin, CAST(count(*) AS BIGINT) AS n FROM customer, e GROUP BY 1")
def cohort_histogram(spark, sf):
    return cohort.histogram(table(spark, sf, "customer"), "c_acctbal", 5)


@query("SELECT c_mktsegment, quantile_cont(c_acctbal, 0.25) AS q1, quantile_cont(c_acctbal, 0.5) AS q2, quantile_cont(c_acctbal, 0.75) AS q3 FROM customer GROUP BY 1")
def cohort_quartiles(spark, sf):
    return cohort.quantiles(table(spark, sf, "customer"), ["c_mktsegment"], "c_acctbal", [0.25, 0.5, 0.75])


@query("SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem GROUP BY 1")
def cohort_regression(spark, sf):
    fit = cohort.regression(table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", "l_quantity")
    return fit.select("l_returnflag", F.round("slope", 4).alias("slope"), F.round("intercept", 3).alias("intercept"), rnd(F.col("r2")).alias("r2"))


@query(f"WITH {RECTS}, a AS (SELECT slide, grp, count(*) AS n, sum((x1 - x0) * (y1 - y0)) AS area FROM rects GROUP BY 1, 2) SELECT slide, grp, n, round(n / (area / 4.0) * 1e6, 6) AS per_mm2 FROM a")
def cohort_density(spark, sf):
    """Objects per square millimetre of their area at half a micron per pixel side."""
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    return cohort.density(rects(spark, sf), ["slide", "grp"], area, 0.5).withColumn("per_mm2", rnd(F.col("per_mm2")))


@query(f"WITH {RECTS}, p AS (SELECT id % 997 AS item, id, (x1 - x0) * (y1 - y0) AS area FROM rects WHERE grp = 'A') SELECT item, count(*) AS parts, CAST(CASE WHEN count(*) = 2 THEN sum(area) ELSE arg_max(area, id) END AS BIGINT) AS area FROM p GROUP BY item")
def exactly_two_rule(spark, sf):
    """Two parts count together; otherwise the last one alone."""
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    parts = rects(spark, sf).filter("grp = 'A'").select((F.col("id") % 997).alias("item"), "id", area.alias("area"))
    return cohort.pair_or_last(parts, ["item"], "id", "area")


@query("SELECT s_suppkey, n_name, r_name, split_part(s_name, '#', 1) AS stem, split_part(s_name, '#', 2) AS number FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def metadata_lookup(spark, sf):
    """Two lookups in a row, and a name cut at its separator."""
    n = table(spark, sf, "nation").join(F.broadcast(table(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    parts = table(spark, sf, "supplier").join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey"))
    return parts.select("s_suppkey", "n_name", "r_name", F.substring_index("s_name", "#", 1).alias("stem"), F.substring_index("s_name", "#", -1).alias("number"))


@query("SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def asserted_lookup(spark, sf):
    dim = table(spark, sf, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    return cohort.looked_up(table(spark, sf, "customer"), F.broadcast(dim), "c_nationkey", "n_name").select("c_custkey", "n_name")


@query("SELECT c_custkey, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) THEN 'member' ELSE 'rest' END AS side, c_mktsegment IN ('BUILDING', 'MACHINERY') AS listed FROM customer")
def semi_anti_membership(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("side", F.lit("member"))
    return c.join(o, "c_custkey", "left").select("c_custkey", F.coalesce("side", F.lit("rest")).alias("side"), F.col("c_mktsegment").isin("BUILDING", "MACHINERY").alias("listed"))


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def difference(spark, sf):
    gone = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf, "orders").select("o_orderkey").join(gone, "o_orderkey", "left_anti")


@query("SELECT 'supplier' AS part, CAST(s_suppkey AS BIGINT) AS id, s_name AS name, s_acctbal AS balance FROM supplier UNION ALL SELECT 'customer', c_custkey, c_name, c_acctbal FROM customer")
def union_with_source(spark, sf):
    one = lambda t, p: table(spark, sf, t).select(F.lit(t).alias("part"), F.col(f"{p}_{'supp' if p == 's' else 'cust'}key").cast("long").alias("id"), F.col(f"{p}_name").alias("name"), F.col(f"{p}_acctbal").alias("balance"))
    return one("supplier", "s").unionByName(one("customer", "c"))


@query("SELECT s_suppkey, CAST(k AS BIGINT) AS copy FROM supplier, range(3) AS r(k)")
def replicate(spark, sf):
    return cohort.replicate(table(spark, sf, "supplier").select("s_suppkey"), 3).withColumn("copy", F.col("copy").cast("long"))


@query(f"WITH {CLS}, s AS (SELECT source, round(avg(score), 6) AS score, count(*) AS n FROM cls GROUP BY source) SELECT source AS name, score, n FROM s UNION ALL SELECT 'AVE', round(avg(score), 6), CAST(sum(n) AS BIGINT) FROM s")
def grand_mean_rows(spark, sf):
    """Per-group rows and one of their mean."""
    per = cls(spark, sf).groupBy(F.col("source").alias("name")).agg(rnd(F.avg("score")).alias("score"), F.count(F.lit(1)).alias("n"))
    return cohort.with_grand_mean(per, "name", "score", "n").withColumn("score", rnd(F.col("score")))


@query("SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1, 2")
def props_extract(spark, sf):
    return table(spark, sf, "events").groupBy("event_type", F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("WITH u AS (SELECT DISTINCT o_orderpriority AS priority, 'orders' AS data_path FROM orders UNION ALL SELECT DISTINCT p_type, 'part' FROM part) SELECT data_path, priority AS label, row_number() OVER (ORDER BY data_path, priority) - 1 AS idx FROM u WHERE priority <> '5-LOW'")
def scan_union_rename(spark, sf):
    """Two scans with where they come from, one value excluded, rows renumbered by an explicit key."""
    a = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("label")).distinct().withColumn("data_path", F.lit("orders"))
    b = table(spark, sf, "part").select(F.col("p_type").alias("label")).distinct().withColumn("data_path", F.lit("part"))
    return sampling.numbered(a.unionByName(b).filter(F.col("label") != "5-LOW"), ["data_path", "label"], "idx")


@query("SELECT DISTINCT o_custkey FROM orders")
def distinct_ids(spark, sf):
    return table(spark, sf, "orders").select("o_custkey").distinct()


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey <> 15")
def exclude_id(spark, sf):
    return table(spark, sf, "supplier").filter(F.col("s_suppkey") != 15).select("s_suppkey", "s_name")


@query("SELECT part, count(*) AS n, min(id) AS first FROM (SELECT 'train' AS part, s_suppkey AS id FROM supplier WHERE s_suppkey <> 7 UNION ALL SELECT 'test', p_partkey FROM part) GROUP BY part")
def positional_split_key(spark, sf):
    """The split travels as a column; nothing depends on a row's position."""
    both = table(spark, sf, "supplier").filter("s_suppkey <> 7").select(F.lit("train").alias("part"), F.col("s_suppkey").alias("id")).unionByName(table(spark, sf, "part").select(F.lit("test").alias("part"), F.col("p_partkey").alias("id")))
    return both.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))


@query("SELECT p_partkey, replace(p_name, ' ', '/masks/') AS path FROM part")
def path_substitution(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.regexp_replace("p_name", " ", "/masks/").alias("path"))


@query("WITH k AS (SELECT p_name, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k, p_brand, p_partkey FROM part) SELECT p_brand, p_partkey, k FROM k WHERE k <= 20")
def capped_selection(spark, sf):
    """At most twenty rows per brand, by key: the cap is the operator."""
    return cohort.capped(table(spark, sf, "part"), ["p_brand"], ["p_partkey"], 20).select("p_brand", "p_partkey", "k")


@query("SELECT a.p_partkey AS image, b.stem AS mask FROM part a JOIN (SELECT DISTINCT split_part(p_name, ' ', 1) AS stem FROM part) b ON starts_with(a.p_name, b.stem)")
def prefix_name_join(spark, sf):
    """Names join on their stem, which the reference infers by prefix; the stem is an equality key."""
    stems = table(spark, sf, "part").select(F.substring_index("p_name", " ", 1).alias("mask")).distinct()
    images = table(spark, sf, "part").select(F.col("p_partkey").alias("image"), F.substring_index("p_name", " ", 1).alias("mask"))
    return images.join(stems, "mask").select("image", "mask")


@query("SELECT c_custkey, c_name, o.n FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON o_custkey = c_custkey")
def sorted_key_pairing(spark, sf):
    """Rows that the reference aligns by sorted position, joined by their key."""
    n = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    return table(spark, sf, "customer").select("c_custkey", "c_name").join(n, "c_custkey", "left")


@query("WITH a AS (SELECT s_name AS image, row_number() OVER (ORDER BY s_name) - 1 AS number FROM supplier), b AS (SELECT 'mask_' || s_suppkey AS mask, row_number() OVER (ORDER BY 'mask_' || s_suppkey) - 1 AS number FROM supplier) SELECT image, mask, number FROM a JOIN b USING (number)")
def positional_pairs(spark, sf):
    """Two lists of one length side by side, each in the order of its names."""
    names = table(spark, sf, "supplier")
    return cohort.paired(names.select(F.col("s_name").alias("image")), names.select(F.concat(F.lit("mask_"), "s_suppkey").alias("mask")), "image", "mask")


@query("SELECT CAST(doc_id AS VARCHAR) AS name, unnest(['quality', 'toxic', 'both']) AS label, CAST(unnest([2 * quality - 1, 2 * toxic - 1, CASE WHEN quality = toxic THEN quality END]) AS INT) AS value FROM labels")
def wide_labels_file(spark, sf):
    """A file with a column per label, -1 or 1 or nothing, read as a row per name and label."""
    from spanmill.plans.session import shared_path
    from spanmill.sources import files

    rows = table(spark, sf, "labels").select(F.col("doc_id").alias("name"), (2 * F.col("quality") - 1).alias("quality"), (2 * F.col("toxic") - 1).alias("toxic"), F.when(F.col("quality") == F.col("toxic"), F.col("quality")).alias("both"))
    rows.write.option("header", True).csv(path := shared_path(spark, "labels"))
    return files.read_wide_labels(spark, path)


@query("SELECT o_orderkey AS run, o_orderstatus AS status, o_totalprice AS loss, CAST(NULL AS VARCHAR) AS priority FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, NULL, o_totalprice, o_orderpriority FROM orders WHERE o_orderkey % 2 <> 0")
def experiment_log(spark, sf):
    """A log begun with some columns and continued with others."""
    from spanmill.plans.session import shared_path
    from spanmill.sources import files

    rows, path = table(spark, sf, "orders").withColumnsRenamed({"o_orderkey": "run", "o_totalprice": "loss"}), shared_path(spark, "runs")
    files.append_run(rows.filter("run % 2 = 0").select("run", F.col("o_orderstatus").alias("status"), "loss"), path)
    files.append_run(rows.filter("run % 2 <> 0").select("run", "loss", F.col("o_orderpriority").alias("priority")), path)
    return files.read_runs(spark, path).select("run", "status", "loss", "priority")


@query("SELECT CAST(quality AS BIGINT) AS quality, count(*) FILTER (WHERE toxic = 0) AS clean, count(*) FILTER (WHERE toxic = 1) AS toxic FROM labels GROUP BY 1")
def wide_labels_pivot(spark, sf):
    pivoted = table(spark, sf, "labels").groupBy(F.col("quality").cast("long").alias("quality")).pivot("toxic", [0, 1]).agg(F.count(F.lit(1)))
    return pivoted.select("quality", F.coalesce("0", F.lit(0)).alias("clean"), F.coalesce("1", F.lit(0)).alias("toxic"))


@query("SELECT c_custkey, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def two_hop_lookup(spark, sf):
    dim = table(spark, sf, "nation").join(F.broadcast(table(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"), "r_name")
    return table(spark, sf, "customer").join(F.broadcast(dim), "c_nationkey").select("c_custkey", "r_name")


@query("SELECT event_type, round(sum(value) / epoch(max(ts) - min(ts)), 6) AS per_second, round(sum(value), 2) AS total, round(avg(value), 6) AS mean, arg_max(value, event_id) AS last FROM events GROUP BY 1")
def throughput(spark, sf):
    out = cohort.rates(table(spark, sf, "events"), ["event_type"], "value", "ts", "event_id")
    return out.select("event_type", rnd(F.col("per_second")).alias("per_second"), F.round("total", 2).alias("total"), rnd(F.col("mean")).alias("mean"), "last")


@query("WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events), p AS (SELECT unnest([0, 50, 95, 99]) AS p) SELECT event_type, CAST(p AS BIGINT) AS p, value FROM r, p WHERE k = least(floor(n * p / 100), n - 1)")
def nearest_rank_percentile(spark, sf):
    return cohort.nearest_rank(table(spark, sf, "events"), ["event_type"], "value", [0, 50, 95, 99])


@query(f"WITH {CLS} SELECT source, min(score) AS lo, quantile_cont(score, 0.25) AS q1, quantile_cont(score, 0.5) AS q2, quantile_cont(score, 0.75) AS q3, max(score) AS hi FROM cls GROUP BY source")
def violin_inputs(spark, sf):
    rows = cls(spark, sf)
    return rows.groupBy("source").agg(F.min("score").alias("lo"), F.max("score").alias("hi")).join(cohort.quantiles(rows, ["source"], "score", [0.25, 0.5, 0.75]), "source")


@query("SELECT event_type, event_id, round(sum(value) OVER w, 4) AS running, lag(value) OVER w AS before FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)")
def cumulative_and_lag(spark, sf):
    by = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    running = by.rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf, "events").select("event_type", "event_id", F.round(F.sum("value").over(running), 4).alias("running"), F.lag("value").over(by).alias("before"))


@query("SELECT CAST(s_suppkey AS BIGINT) AS id, CASE WHEN s_suppkey % 2 = 0 THEN 'new ' || s_name ELSE s_name END AS predicted FROM supplier UNION ALL SELECT -1, 'added'")
def csv_append_and_template_update(spark, sf):
    """Write a template as CSV, append to it, update it by key, and read it back."""
    from spanmill.sources import files

    return files.round_trip(table(spark, sf, "supplier").select(F.col("s_suppkey").cast("long").alias("id"), F.col("s_name").alias("predicted")))
