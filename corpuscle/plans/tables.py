"""Queries over the star schema and events: resolution, indexes, and what SQL engines have beyond."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpuscle.operators import classify, quality, relational, resolve
from corpuscle.operators.scan import running
from corpuscle.session import table
from corpuscle.streaming import jobs

from .catalog import query

_TAXONOMY = [("metal", "econ", 1), ("small things", "small", 2), ("standard", "stand", 3), ("ring", "ring", 4), ("red", "red", 5)]
_TAX_SQL = "tax(grp, category, prio) AS (VALUES " + ", ".join(f"('{g}', '{c}', {p})" for g, c, p in _TAXONOMY) + ")"


def _taxonomy(spark):
    return spark.createDataFrame(_TAXONOMY, "group string, category string, group_priority int")


@query(f"WITH {_TAX_SQL} SELECT p_partkey, (SELECT arg_min(grp, prio) FROM tax WHERE contains(lower(p_type), category) OR contains(lower(p_name), category)) AS part_group FROM part")
def taxonomy_classify(spark, sf_dir):
    found = classify.by_taxonomy(table(spark, sf_dir, "part"), "p_partkey", F.array("p_type", "p_name"), _taxonomy(spark))
    return found.withColumnRenamed("group", "part_group")


@query(f"""WITH {_TAX_SQL}, c AS (SELECT p_partkey, i, string_split(p_name, ' ')[i] AS category FROM part, unnest([1, 2]) AS r(i))
SELECT p.p_partkey, x.part_group FROM part p LEFT JOIN (SELECT p_partkey, arg_min(grp, i * 100 + prio) AS part_group FROM c JOIN tax USING (category) GROUP BY p_partkey) x USING (p_partkey)""")
def first_category(spark, sf_dir):
    found = classify.by_first_category(table(spark, sf_dir, "part"), "p_partkey", F.split("p_name", " "), _taxonomy(spark))
    return found.withColumnRenamed("group", "part_group")


@query("""WITH c AS (SELECT c_custkey, 1 AS pos, 'NATION_' || (c_nationkey + 20) AS name FROM customer UNION ALL SELECT c_custkey, 2, 'NATION_' || c_nationkey FROM customer)
SELECT c_custkey, arg_min(n_name, pos) AS match FROM c JOIN nation ON n_name = name GROUP BY c_custkey""")
def first_match_lookup(spark, sf_dir):
    """The first of two candidate names that exists."""
    names = F.array(F.concat(F.lit("NATION_"), (F.col("c_nationkey") + 20).cast("string")), F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string")))
    return resolve.first_match(table(spark, sf_dir, "customer"), "c_custkey", names, table(spark, sf_dir, "nation"), "n_name")


_NAMED = "p_name || ' ' || p_brand"
_TERM = (
    f"CASE p_size // 9 WHEN 0 THEN {_NAMED} WHEN 1 THEN p_brand || ', ' || p_name WHEN 2 THEN {_NAMED} || ', the' "
    f"WHEN 3 THEN p_brand || ' of House ' || p_name WHEN 4 THEN {_NAMED} || ', A' ELSE {_NAMED} || ', The' END"
)
_FILE = (
    f"CASE p_size WHEN 1 THEN replace({_NAMED}, ' ', '_') WHEN 2 THEN 'The_' || replace({_NAMED}, ' ', '_') WHEN 3 THEN 'A_' || replace({_NAMED}, ' ', '_') WHEN 4 THEN p_brand "
    f"WHEN 5 THEN upper(substr(p_name, 1, 1)) || replace(substr({_NAMED}, 2), ' ', '_') WHEN 6 THEN split_part(p_name, ' ', 2) || '_' || p_brand WHEN 7 THEN lower(replace({_NAMED}, ' ', '_')) WHEN 8 THEN {_NAMED} END"
)
_NONE = "[]::VARCHAR[]"
_CANDIDATES = f"""CASE WHEN contains(t, ' of House ') THEN [split_part(t, ' ', 1)] ELSE {_NONE} END || CASE WHEN t LIKE '%, the' THEN ['The_' || replace(l, ' ', '_'), replace(l, ' ', '_')] ELSE {_NONE} END
|| CASE WHEN t LIKE '%, The' THEN ['The_' || replace(l, ' ', '_')] ELSE {_NONE} END || CASE WHEN t LIKE '%, A' THEN ['A_' || replace(l, ' ', '_')] ELSE {_NONE} END
|| CASE WHEN contains(t, ', ') THEN [replace(f || '_' || l, ' ', '_'), replace(upper(f[1]) || f[2:] || '_' || l, ' ', '_'), replace(l, ' ', '_'), lower(replace(f || '_' || l, ' ', '_')), f || '_' || l, replace(string_split(f, ' ')[-1] || '_' || l, ' ', '_')]
ELSE [replace(t, ' ', '_'), lower(replace(t, ' ', '_')), replace(array_to_string(list_transform(string_split(t, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' '), ' ', '_')] END || [t, replace(t, ' ', '_'), lower(replace(t, ' ', '_'))]"""


@query(f"""WITH terms AS (SELECT DISTINCT {_TERM} AS t FROM part), files AS (SELECT DISTINCT {_FILE} || '.txt' AS file FROM part WHERE p_size <= 8),
named AS (SELECT t, {_CANDIDATES} AS c FROM (SELECT t, split_part(t, ', ', 1) AS l, CASE WHEN contains(t, ', ') THEN substr(t, strpos(t, ', ') + 2) ELSE '' END AS f FROM terms)),
hits AS (SELECT t, arg_min(file, i) AS match FROM (SELECT t, i, c[i] || '.txt' AS name FROM named, unnest(range(1, len(c) + 1)) AS r(i)) JOIN files ON file = name GROUP BY t)
SELECT t, match FROM terms LEFT JOIN hits USING (t)""")
def glossary_lookup(spark, sf_dir):
    """Terms in all the forms that have rewriting rules, each with the first of its candidate names that is a file."""
    part = table(spark, sf_dir, "part")
    full, low = F.concat_ws(" ", "p_name", "p_brand"), lambda c: F.translate(c, " ", "_")
    style = F.floor(F.col("p_size") / 9)
    forms = (full, F.concat_ws(", ", "p_brand", "p_name"), F.concat(full, F.lit(", the")), F.concat_ws(" of House ", "p_brand", "p_name"), F.concat(full, F.lit(", A")))
    term = F.concat(full, F.lit(", The"))
    for k, form in reversed(list(enumerate(forms))):
        term = F.when(style == k, form).otherwise(term)
    files = (
        low(full), F.concat(F.lit("The_"), low(full)), F.concat(F.lit("A_"), low(full)), F.col("p_brand"), low(F.concat(F.upper(F.substring(full, 1, 1)), F.substring(full, F.lit(2), F.length(full)))),
        F.concat_ws("_", F.element_at(F.split("p_name", " "), -1), "p_brand"), F.lower(low(full)), full,
    )
    known = part.filter("p_size <= 8").select(F.concat(F.element_at(F.array(*files), F.col("p_size")), F.lit(".txt")).alias("file"))
    return resolve.first_match(part.select(term.alias("t")).distinct(), "t", resolve.glossary_candidates("t"), known, "file")


@query("SELECT c_custkey, c_name FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 300000)")
def unmatched_anti(spark, sf_dir):
    large = table(spark, sf_dir, "orders").filter("o_totalprice > 300000")
    return resolve.unmatched(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey", large, "o_custkey")


@query("SELECT c_custkey, c_name FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)")
def redirect_semi(spark, sf_dir):
    return resolve.matched(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey", table(spark, sf_dir, "orders"), "o_custkey")


@query("SELECT r_name, array_to_string(list_sort(list(n_name)), ',') AS nations FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY r_name")
def alias_invert(spark, sf_dir):
    named = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return resolve.invert(named, "n_name", "r_name").select("r_name", F.array_join("values", ",").alias("nations"))


@query("""SELECT p_custkey AS c_custkey, c_name AS canonical FROM (SELECT c_custkey AS p_custkey, 'NATION_' || c_nationkey AS nm FROM customer) LEFT JOIN (SELECT lower(n_name) AS a, n_name AS c_name FROM nation) ON lower(nm) = a""")
def alias_lookup(spark, sf_dir):
    names = table(spark, sf_dir, "customer").select("c_custkey", F.upper(F.concat(F.lit("Nation_"), F.col("c_nationkey").cast("string"))).alias("nm"))
    aliases = table(spark, sf_dir, "nation").select(F.col("n_name").alias("canonical"), F.lower("n_name").alias("alias"), F.col("n_nationkey").alias("ord"))
    return resolve.by_alias(names, "nm", aliases).select("c_custkey", "canonical")


@query("SELECT word, count(*) AS n, CAST(min(p_partkey) AS BIGINT) AS first_part FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY word")
def inverted_index(spark, sf_dir):
    """By name word: how many parts and the first; the exploded pairs are the index itself."""
    words = table(spark, sf_dir, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first_part"))


@query("SELECT user_id, arg_min(event_type, event_id) AS event_type, arg_min(value, event_id) AS value FROM events GROUP BY user_id")
def first_wins(spark, sf_dir):
    return resolve.first_wins(table(spark, sf_dir, "events"), "user_id", ["event_id"], "event_type", "value")


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def last_wins(spark, sf_dir):
    return resolve.last_wins(table(spark, sf_dir, "events"), "user_id", ["event_id"], "event_type", "value")


@query("SELECT o_custkey, array_to_string(list_transform(list_sort(list(DISTINCT l_linenumber)), lambda x: CAST(x AS VARCHAR)), ',') AS numbers FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey")
def books_appeared(spark, sf_dir):
    """Sorted distinct numbers by key."""
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("l_linenumber")).cast("array<string>"), ",").alias("numbers"))


@query("""SELECT r_name, count(*) AS n, count(*) FILTER (c_acctbal < 0) AS in_debt, count(DISTINCT c_mktsegment) AS segments, max(CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END) = 1 AS any_building,
round(100.0 * count(*) FILTER (c_acctbal < 0) / count(*), 6) AS pct_debt FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY r_name""")
def entity_index(spark, sf_dir):
    """Conditional counters of an entity index."""
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    debt = F.col("c_acctbal") < 0
    return rows.groupBy("r_name").agg(F.count("*").alias("n"), F.count_if(debt).alias("in_debt"), F.count_distinct("c_mktsegment").alias("segments"), F.bool_or(F.col("c_mktsegment") == "BUILDING").alias("any_building"), F.round(100.0 * F.count_if(debt) / F.count("*"), 6).alias("pct_debt"))


@query("SELECT l_orderkey, count(*) AS n, min(l_linenumber) = 1 AND max(l_linenumber) = count(*) AND count(DISTINCT l_linenumber) = count(*) AS sequential, count(DISTINCT l_linenumber) < count(*) AS repeats FROM lineitem GROUP BY l_orderkey")
def sequential_check(spark, sf_dir):
    return quality.sequential(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("SELECT user_id, event_id, round(avg(value) OVER w, 6) AS running_avg, max(value) OVER w AS running_max FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)")
def running_metrics(spark, sf_dir):
    """Running mean and largest value by user, by a prefix scan."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    rows = running(events, ["user_id"], ["event_id"], {"n": F.col("value").isNotNull().cast("long"), "total": F.col("value")}, tops={"running_max": F.col("value")})
    return rows.select("user_id", "event_id", F.round(F.try_divide("total", "n"), 6).alias("running_avg"), "running_max")


@query("SELECT event_id, CAST(count(*) OVER w AS BIGINT) AS pos, round(sum(value) OVER w, 4) AS total, last_value(CASE WHEN event_type = 'error' THEN event_id END IGNORE NULLS) OVER w AS last_error FROM events WINDOW w AS (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def global_scan(spark, sf_dir):
    """All rows as one key, in order of time: place, running sum and the last error so far."""
    events = table(spark, sf_dir, "events").select(F.lit(0).alias("all"), "ts", "event_id", "value", "event_type")
    error = F.when(F.col("event_type") == "error", F.col("event_id"))
    rows = running(events, ["all"], ["ts", "event_id"], {"pos": F.lit(1).cast("long"), "total": F.col("value")}, {"last_error": error})
    return rows.select("event_id", "pos", F.round("total", 4).alias("total"), "last_error")


@query("SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'error') AS error, count(*) FILTER (event_type = 'view') AS view FROM events GROUP BY user_id")
def metrics_pivot(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy("user_id").pivot("event_type", ["click", "error", "view"]).count()
    return rows.select("user_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("click", "error", "view")))


# Beyond the retrieval system's own operators: what a SQL engine offers.


@query("""SELECT o.event_id, p.event_id AS before_id FROM (SELECT * FROM events WHERE event_type = 'error') o ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') p ON o.user_id = p.user_id AND o.ts > p.ts""")
def asof_join(spark, sf_dir):
    """For each error, the user's last click before it."""
    events = table(spark, sf_dir, "events")
    left, right = (events.filter(F.col("event_type") == k).select("event_id", "user_id", "ts") for k in ("error", "click"))
    return relational.asof(left, right, "user_id", "ts", "event_id").select("event_id", F.col("before_event_id").alias("before_id"))


@query("""SELECT p_partkey, band FROM part JOIN (VALUES ('low', 900.0, 1000.0), ('mid', 1000.0, 1500.0), ('high', 1400.0, 3000.0)) b(band, lo, hi) ON p_retailprice >= lo AND p_retailprice < hi""")
def range_join(spark, sf_dir):
    """Parts by overlapping price ranges, through equal buckets of the price."""
    bands = spark.createDataFrame([("low", 900.0, 1000.0), ("mid", 1000.0, 1500.0), ("high", 1400.0, 3000.0)], "band string, lo double, hi double")
    return relational.range_join(table(spark, sf_dir, "part"), "p_retailprice", bands, "lo", "hi", 100.0).select("p_partkey", "band")


@query("SELECT c_custkey, s_suppkey FROM customer FULL OUTER JOIN supplier ON c_custkey = s_suppkey + 50")
def full_outer(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "supplier"), F.col("c_custkey") == F.col("s_suppkey") + 50, "full").select("c_custkey", "s_suppkey")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS w_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def tumbling_window(spark, sf_dir):
    return jobs.tumbling(table(spark, sf_dir, "events"), "1 hour")


@query("""SELECT w_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM (SELECT time_bucket(INTERVAL 30 MINUTES, ts) - k * INTERVAL 30 MINUTES AS w_start, event_type, value FROM events, unnest([0, 1]) AS r(k)) GROUP BY 1, 2""")
def sliding_window(spark, sf_dir):
    return jobs.tumbling(table(spark, sf_dir, "events"), "1 hour", slide="30 minutes")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTES OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT user_id, min(ts) AS s_start, max(ts) + INTERVAL 30 MINUTES AS s_end, count(*) AS n FROM s GROUP BY user_id, sid""")
def session_windows(spark, sf_dir):
    return jobs.sessions(table(spark, sf_dir, "events"), "30 minutes")


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_totals(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("qty"), F.count("*").alias("n"))


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def set_intersect(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")).intersect(table(spark, sf_dir, "supplier").select("s_nationkey"))


@query("SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_suppkey < 20")
def set_except(spark, sf_dir):
    few = table(spark, sf_dir, "supplier").filter("s_suppkey < 20").select("s_nationkey")
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k")).exceptAll(few.distinct())


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 3")
def top_per_group(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf_dir, "orders").withColumn("rn", F.row_number().over(w)).filter("rn <= 3").select("o_custkey", "o_orderkey", "o_totalprice")


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price,
round(avg(l_quantity), 6) AS avg_qty, count(*) AS count_order FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus""")
def pricing_summary(spark, sf_dir):
    price, discount = F.col("l_extendedprice"), F.col("l_discount")
    rows = table(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") <= F.expr("TIMESTAMP_NTZ '1998-09-02'"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(price), 2).alias("sum_base_price"), F.round(F.sum(price * (1 - discount)), 2).alias("sum_disc_price"), F.round(F.avg("l_quantity"), 6).alias("avg_qty"), F.count("*").alias("count_order"))
