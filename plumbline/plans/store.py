"""Queries on the store: lookups, latest rows, joins, counts, state changes, table rewrites."""

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.scratch import fresh_path
from ..operators import store as S
from .registry import query


def cost():
    return (F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(18,4)")


COST_SQL = "CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))"


@query("SELECT * FROM orders WHERE o_orderkey = 7")
def point_lookup(t):
    return S.lookup(t.orders, o_orderkey=7)


@query("SELECT * FROM lineitem WHERE l_orderkey = 7 AND l_linenumber = 4 AND l_linestatus = 'O'")
def composite_lookup(t):
    return S.lookup(t.lineitem, l_orderkey=7, l_linenumber=4, l_linestatus="O")


@query("SELECT o_orderkey, o_orderstatus, o_orderdate FROM orders WHERE o_custkey = 10")
def children_ordered(t):
    return S.children(t.orders, "o_custkey", 10, "o_orderkey").select("o_orderkey", "o_orderstatus", "o_orderdate")


@query("""
    SELECT user_id, string_agg(event_id || '@' || event_type, ',' ORDER BY ts, event_id) AS rows, count(*) AS n
    FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY user_id""")
def batch_scan_by_keys(t):
    keys = t.customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id"))
    found = S.scan_by_keys(t.events, keys, "user_id", ["ts", "event_id", "event_type"])
    text = F.array_join(F.transform("rows", lambda r: F.concat(r["event_id"].cast("string"), F.lit("@"), r["event_type"])), ",")
    return found.select("user_id", text.alias("rows"), F.size("rows").cast("long").alias("n"))


@query("SELECT o_orderkey, o_orderdate, o_orderstatus FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50")
def recent_topn(t):
    return S.top(t.orders.select("o_orderkey", "o_orderdate", "o_orderstatus"), S.page_size(None), F.desc("o_orderdate"), F.desc("o_orderkey"))


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'P' ORDER BY o_orderdate, o_orderkey LIMIT 200")
def pending_fifo(t):
    return S.top(t.orders.where("o_orderstatus = 'P'").select("o_orderkey", "o_orderdate"), S.page_size(1000), "o_orderdate", "o_orderkey")


@query("""SELECT o_custkey, o_orderkey, o_orderstatus, o_orderdate FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def latest_per_key(t):
    return S.extreme(t.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_orderstatus", "o_orderdate"], largest=True)


@query("""SELECT user_id, event_id, event_type, ts FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1""")
def earliest_per_key(t):
    return S.extreme(t.events, ["user_id"], ["ts", "event_id"], ["event_id", "event_type", "ts"], largest=False)


@query("""SELECT o_custkey, o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1""")
def latest_succeeded(t):
    return S.latest(t.orders.where("o_orderstatus = 'F'"), ["o_custkey"], F.desc("o_totalprice"), F.col("o_orderkey")).select("o_custkey", "o_orderkey", "o_totalprice")


@query("""SELECT count(*) AS n, count(*) FILTER (o_orderpriority = '1-URGENT' AND o_orderstatus NOT IN ('F')) AS n_active_demo,
    count(*) FILTER (o_orderstatus <> 'P') AS n_started FROM orders""")
def filtered_counts(t):
    active = (F.col("o_orderpriority") == "1-URGENT") & ~F.col("o_orderstatus").isin("F")
    return t.orders.agg(F.count("*").alias("n"), F.count_if(active).alias("n_active_demo"), F.count_if(F.col("o_orderstatus") != "P").alias("n_started"))


@query("SELECT l_orderkey, count(DISTINCT l_linenumber) AS rounds FROM lineitem WHERE l_returnflag <> 'R' GROUP BY l_orderkey")
def count_distinct_rounds(t):
    return t.lineitem.where("l_returnflag <> 'R'").groupBy("l_orderkey").agg(F.count_distinct("l_linenumber").alias("rounds"))


@query(f"""SELECT count(*) AS calls, coalesce(sum(l_quantity::BIGINT), 0)::BIGINT AS tokens, coalesce(sum({COST_SQL}), 0)::DOUBLE AS cost
    FROM lineitem WHERE l_orderkey = 7""")
def cost_summary_global(t):
    rows = t.lineitem.where("l_orderkey = 7")
    return rows.agg(F.count("*").alias("calls"), F.coalesce(F.sum(F.col("l_quantity").cast("long")), F.lit(0)).alias("tokens"), F.coalesce(F.sum(cost()), F.lit(0)).cast("double").alias("cost"))


@query(f"""SELECT l_orderkey AS task_id, count(*) AS calls, sum(l_quantity::BIGINT)::BIGINT AS tokens, sum({COST_SQL})::DOUBLE AS cost
    FROM lineitem GROUP BY l_orderkey""")
def cost_summary_by_task(t):
    rows = t.lineitem.groupBy(F.col("l_orderkey").alias("task_id"))
    return rows.agg(F.count("*").alias("calls"), F.sum(F.col("l_quantity").cast("long")).alias("tokens"), F.sum(cost()).cast("double").alias("cost"))


@query("""SELECT source, count(d.doc_id) AS n_docs, count(l.doc_id) AS n_labelled, count(CASE WHEN l.quality = 1 THEN 1 END) AS n_good
    FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY source""")
def left_join_null_skipping_counts(t):
    labels = t.labels.select(F.col("doc_id").alias("labelled"), "quality")
    joined = t.documents.select("doc_id", "source").join(labels, F.col("doc_id") == F.col("labelled"), "left")
    return joined.groupBy("source").agg(F.count("doc_id").alias("n_docs"), F.count("labelled").alias("n_labelled"), F.count_if(F.col("quality") == 1).alias("n_good"))


@query("""SELECT o_orderkey, count(*) AS n, sum(l_quantity::BIGINT)::BIGINT AS quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey
    WHERE o_orderstatus = 'P' GROUP BY o_orderkey""")
def inner_join_child_parent(t):
    parents = t.orders.where("o_orderstatus = 'P'").select("o_orderkey")
    joined = t.lineitem.join(parents, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy("o_orderkey").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"))


@query("""SELECT DISTINCT o_orderkey, o_orderdate, l_shipdate FROM orders JOIN lineitem ON o_orderkey = l_orderkey
    WHERE l_linestatus = 'O' AND l_shipdate < TIMESTAMP '1996-01-01' - INTERVAL 7 DAY""")
def overdue_join(t):
    late = t.lineitem.where("l_linestatus = 'O' AND l_shipdate < TIMESTAMP_NTZ '1996-01-01' - INTERVAL 7 DAY").select("l_orderkey", "l_shipdate")
    return t.orders.select("o_orderkey", "o_orderdate").join(late, F.col("o_orderkey") == F.col("l_orderkey")).drop("l_orderkey").distinct()


@query("""SELECT s_suppkey, n_name, r_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey
    LEFT JOIN region ON n_regionkey = r_regionkey AND r_name <> 'ASIA'""")
def chained_left_join(t):
    nations = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return nations.join(t.region, (F.col("n_regionkey") == F.col("r_regionkey")) & (F.col("r_name") != "ASIA"), "left").select("s_suppkey", "n_name", "r_name")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def semi_in_subquery(t):
    return t.customer.join(t.orders.where("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def anti_missing(t):
    return S.missing(t.orders, t.lineitem.withColumnRenamed("l_orderkey", "o_orderkey"), ["o_orderkey"]).select("o_orderkey", "o_orderstatus")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority = '1-URGENT' OR o_custkey = 10")
def visible_rows(t):
    return t.orders.where((F.col("o_orderpriority") == "1-URGENT") | (F.col("o_custkey") == 10)).select("o_orderkey", "o_orderpriority")


@query("""SELECT event_id, event_type, coalesce(props, '{}') AS props, event_type IN ('view', 'click') AS early, event_type NOT LIKE 'p%' AS not_p,
    CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 ELSE 0 END AS code, value IS NULL AS open,
    CASE WHEN value >= 500 THEN 'retry' WHEN floor(value)::INT IN (408, 429) THEN 'retry' ELSE 'stop' END AS verdict,
    CAST(json_extract(props, '$.k') AS INT) AS k
    FROM events WHERE event_type IS NOT NULL AND user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def predicate_mix(t):
    kind, value = F.col("event_type"), F.col("value")
    chosen = t.customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id"))
    rows = t.events.where(kind.isNotNull()).join(chosen, "user_id", "left_semi")
    verdict = F.when((value >= 500) | F.floor(value).cast("int").isin(408, 429), "retry").otherwise("stop")
    code = F.when(kind == "view", 1).when(kind == "click", 2).otherwise(0)
    return rows.select(
        "event_id", "event_type", F.coalesce("props", F.lit("{}")).alias("props"), kind.isin("view", "click").alias("early"), (~kind.startswith("p")).alias("not_p"),
        code.alias("code"), value.isNull().alias("open"), verdict.alias("verdict"), F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


@query("SELECT p_partkey, p_name, p_type FROM part WHERE p_type LIKE '%NOMY' OR p_name LIKE '%gear' ORDER BY p_partkey LIMIT 200")
def suffix_filter(t):
    return S.top(t.part.where(F.col("p_type").endswith("NOMY") | F.col("p_name").endswith("gear")).select("p_partkey", "p_name", "p_type"), 200, "p_partkey")


@query("""SELECT o_orderkey, coalesce(m.attempt, 0)::INT AS attempt FROM orders
    LEFT JOIN (SELECT l_orderkey, max(l_linenumber) AS attempt FROM lineitem GROUP BY l_orderkey) m ON l_orderkey = o_orderkey""")
def lookup_default_join(t):
    last = t.lineitem.groupBy("l_orderkey").agg(F.max("l_linenumber").alias("a"))
    return t.orders.join(last, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.coalesce("a", F.lit(0)).alias("attempt"))


@query("""WITH types AS (SELECT DISTINCT p_type, string_split(p_type, ' ')[-1] AS last FROM part),
    targets AS (SELECT DISTINCT string_split(p_type, ' ')[-1] AS target FROM part WHERE p_size > 25)
    SELECT target, p_type FROM targets JOIN types ON last = target AND p_type LIKE '%' || target""")
def suffix_key_join(t):
    last = F.element_at(F.split("p_type", " "), -1)
    targets = t.part.where("p_size > 25").select(last.alias("target")).distinct()
    types = t.part.select("p_type", last.alias("last")).distinct()
    return targets.join(types, (F.col("last") == F.col("target")) & F.col("p_type").endswith(F.col("target"))).select("target", "p_type")


@query(f"""WITH calls AS (SELECT l_orderkey AS trace, count(*) AS calls, sum({COST_SQL})::DOUBLE AS cost FROM lineitem GROUP BY l_orderkey),
    spans AS (SELECT user_id AS trace, count(*) AS spans FROM events GROUP BY user_id)
    SELECT trace, spans, calls, cost FROM spans JOIN calls USING (trace)""")
def trace_call_join(t):
    calls = t.lineitem.groupBy(F.col("l_orderkey").alias("trace")).agg(F.count("*").alias("calls"), F.sum(cost()).cast("double").alias("cost"))
    return t.events.groupBy(F.col("user_id").alias("trace")).agg(F.count("*").alias("spans")).join(calls, "trace").select("trace", "spans", "calls", "cost")


@query("SELECT o_custkey AS repo, o_orderdate AS created_at FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1")
def newest_parent(t):
    newest = F.max(F.struct("o_orderdate", "o_orderkey", "o_custkey")).alias("x")
    return t.orders.agg(newest).select(F.col("x.o_custkey").alias("repo"), F.col("x.o_orderdate").alias("created_at"))


@query("SELECT DISTINCT w AS word FROM (SELECT unnest(string_split(p_name || ' ' || p_type, ' ')) AS w FROM part) WHERE w <> ''")
def unnest_distinct(t):
    return t.part.select(F.explode(F.split(F.concat_ws(" ", "p_name", "p_type"), " ")).alias("word")).where("word <> ''").distinct()


@query("""SELECT p_brand AS name FROM part WHERE p_size < 10 UNION SELECT p_type FROM part WHERE p_size > 40
    EXCEPT SELECT p_type FROM part WHERE p_retailprice > 1500""")
def catalog_union(t):
    names = t.part.where("p_size < 10").select(F.col("p_brand").alias("name")).union(t.part.where("p_size > 40").select("p_type")).distinct()
    return S.missing(names, t.part.where("p_retailprice > 1500").select(F.col("p_type").alias("name")), ["name"])


@query("""SELECT user_id, string_agg(event_id::VARCHAR, ',' ORDER BY ts DESC, event_id DESC) AS recent FROM
    (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 20) GROUP BY user_id""")
def bounded_collect(t):
    from ..operators.windows import last_n

    return last_n(t.events, ["user_id"], ["ts", "event_id"], 20).groupBy("user_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ts", "event_id")), asc=False), lambda x: x["event_id"].cast("string")), ",").alias("recent")
    )


@query("""SELECT o_orderkey, o_orderstatus, CASE o_orderstatus WHEN 'O' THEN 'cancel' WHEN 'P' THEN 'approve' ELSE 'retry' END AS command,
    o_orderstatus <> 'P' AS legal, CASE o_orderstatus WHEN 'O' THEN 'RUNNING' WHEN 'P' THEN 'PENDING' ELSE 'PENDING' END AS next_status FROM orders""")
def state_transition(t):
    status = F.when(F.col("o_orderstatus") == "O", "RUNNING").when(F.col("o_orderstatus") == "P", "PENDING").otherwise("FAILED")
    command = F.when(F.col("o_orderstatus") == "O", "cancel").when(F.col("o_orderstatus") == "P", "approve").otherwise("retry")
    asked = t.orders.select("o_orderkey", "o_orderstatus", status.alias("status"), command.alias("command"))
    return S.commanded(asked, "status", "command").drop("status")


@query("""SELECT o_orderkey, o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' AS changed,
    CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' THEN 'F' ELSE o_orderstatus END AS o_orderstatus FROM orders""")
def cas_update(t):
    return S.compare_and_set(t.orders, "o_orderstatus", "P", "F", F.col("o_orderpriority") == "1-URGENT").select("o_orderkey", "changed", "o_orderstatus")


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'P' ELSE o_orderstatus END AS stale_reset,
    CASE o_orderstatus WHEN 'O' THEN 'FAILED' WHEN 'P' THEN 'SKIPPED' ELSE o_orderstatus END AS interrupted,
    CASE WHEN o_orderstatus IN ('F') THEN NULL ELSE o_totalprice END AS result_after_retry FROM orders""")
def bulk_reset(t):
    s = F.col("o_orderstatus")
    return t.orders.select(
        "o_orderkey", S.transition(s, {"O": "P"}).alias("stale_reset"), S.transition(s, {"O": "FAILED", "P": "SKIPPED"}).alias("interrupted"),
        F.when(~s.isin("F"), F.col("o_totalprice")).alias("result_after_retry"),
    )


@query("SELECT * FROM nation UNION ALL SELECT n_nationkey + 100, 'NEW ' || n_name, n_regionkey FROM nation WHERE n_regionkey = 1")
def append_table(t):
    more = t.nation.where("n_regionkey = 1").select((F.col("n_nationkey") + 100).alias("n_nationkey"), F.concat(F.lit("NEW "), "n_name").alias("n_name"), "n_regionkey")
    return t.nation.unionByName(more)


@query("""WITH changes AS (SELECT c_custkey, 'renamed' AS c_name, c_acctbal + 1 AS c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING'
        UNION ALL SELECT c_custkey + 1000000, c_name, c_acctbal FROM customer WHERE c_mktsegment = 'MACHINERY')
    SELECT c_custkey, c_name, c_acctbal FROM changes UNION ALL
    SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM changes)""")
def upsert_latest(t):
    now = t.customer.select("c_custkey", "c_name", "c_acctbal", F.lit(0).alias("version"))
    named = t.customer.where("c_mktsegment = 'BUILDING'").select("c_custkey", F.lit("renamed").alias("c_name"), (F.col("c_acctbal") + 1).alias("c_acctbal"), F.lit(1).alias("version"))
    added = t.customer.where("c_mktsegment = 'MACHINERY'").select((F.col("c_custkey") + 1_000_000).alias("c_custkey"), "c_name", "c_acctbal", F.lit(1).alias("version"))
    return S.upsert(now, named.union(added), ["c_custkey"], "version").drop("version")


@query("""SELECT s_suppkey, s_name, s_nationkey FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)
    UNION ALL SELECT s_suppkey + 1000, 'again', s_nationkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)""")
def replace_partition(t):
    old = t.supplier.select("s_suppkey", "s_name", "s_nationkey")
    asia = t.nation.where("n_regionkey = 2").select(F.col("n_nationkey").alias("s_nationkey"))
    new = old.join(asia, "s_nationkey", "left_semi").select((F.col("s_suppkey") + 1000).alias("s_suppkey"), F.lit("again").alias("s_name"), "s_nationkey")
    return S.replace_partitions(old, new, "s_nationkey")


@query("""SELECT s_suppkey, s_name, s_nationkey FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (2, 3))
    UNION ALL SELECT s_suppkey + 1000, 'again', s_nationkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)""")
def partition_overwrite(t):
    """Suppliers by nation, written; those of one region are written anew, twice, and another region has none left."""
    path = fresh_path(t.spark, "suppliers")
    old = t.supplier.select("s_suppkey", "s_name", "s_nationkey")
    S.overwrite_partitions(old, path, "s_nationkey")
    nations = lambda *regions: t.nation.where(F.col("n_regionkey").isin(*regions)).select(F.col("n_nationkey").alias("s_nationkey"))
    new = old.join(nations(2), "s_nationkey", "left_semi").select((F.col("s_suppkey") + 1000).alias("s_suppkey"), F.lit("again").alias("s_name"), "s_nationkey")
    for _ in range(2):
        S.overwrite_partitions(new, path, "s_nationkey", nations(2, 3))
    return t.spark.read.schema(old.schema).parquet(path)


@query("SELECT c_custkey, count(*) AS n, count(*) AS keys FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_custkey % 2 = 0 GROUP BY c_custkey UNION ALL SELECT c_custkey, 2 * count(*), 2 * count(*) FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_custkey % 2 = 1 GROUP BY c_custkey")
def append_keys(t):
    """Orders appended in two calls, those of odd customers in both, with keys that the table gives."""
    path = fresh_path(t.spark, "appended")
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("c_custkey", F.array("o_orderkey").alias("a"), F.array("o_orderstatus").alias("b"))
    first = S.appended(rows, path, "key", ["a", "b"])
    again = S.appended(rows.where("c_custkey % 2 = 1"), path, "key", ["a", "b"])
    given = first.union(again).select("key", F.col("c_custkey").alias("c"))
    table = t.spark.read.parquet(path)
    return table.join(given, (table["key"] == given["key"]) & (F.col("c") == F.col("c_custkey"))).groupBy("c_custkey").agg(F.count("*").alias("n"), F.count_distinct(table["key"]).alias("keys"))


@query("""SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') GROUP BY l_orderkey""")
def cascade_delete(t):
    return S.without_parents(t.lineitem, t.orders.where("o_orderstatus = 'P'"), "l_orderkey", "o_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus NOT IN ('F') THEN 'active' WHEN o_orderdate < TIMESTAMP '1997-01-01' - INTERVAL 90 DAY THEN 'delete' ELSE 'keep' END AS decision FROM orders""")
def retention_decision(t):
    old = F.col("o_orderdate") < F.expr("TIMESTAMP_NTZ '1997-01-01' - INTERVAL 90 DAY")
    decision = F.when(~F.col("o_orderstatus").isin("F"), "active").when(old, "delete").otherwise("keep")
    return t.orders.select("o_orderkey", decision.alias("decision"))


@query("""SELECT o_orderkey, o_orderdate < TIMESTAMP '1996-06-01' AND o_orderstatus = 'P' AS changed,
    CASE WHEN o_orderdate < TIMESTAMP '1996-06-01' AND o_orderstatus = 'P' THEN 'F' ELSE o_orderstatus END AS o_orderstatus FROM orders""")
def overdue_gates(t):
    late = F.col("o_orderdate") < F.expr("TIMESTAMP_NTZ '1996-06-01'")
    return S.compare_and_set(t.orders, "o_orderstatus", "P", "F", late).select("o_orderkey", "changed", "o_orderstatus")


NAMES = {"view": "task", "click": "llm:PLAN", "purchase": "sandbox:mvn", "error": "node:rewrite:a/b/C.java"}


@query(f"""WITH named AS (SELECT *, CASE event_type {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in NAMES.items())} ELSE event_type || ':' || user_id END AS key, floor(value * (CASE user_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 50 WHEN 2 THEN 3000 ELSE 100000 END)) AS ms FROM events),
    parts AS (SELECT *, floor(ms / 1000 + 0.5)::BIGINT AS s, floor(ms / 100 + 0.5)::BIGINT AS tenths FROM named)
    SELECT event_id, CASE WHEN ms < 1000 THEN ms::BIGINT || ' ms' WHEN tenths < 600 THEN (tenths // 10) || '.' || (tenths % 10) || ' s' WHEN s < 3600 THEN (s // 60) || 'm ' || (s % 60) || 's' ELSE (s // 3600) || 'h ' || (s // 60 % 60) || 'm' END AS took,
    key, nullif(substr(key, strpos(key, ':') + 1), CASE WHEN strpos(key, ':') = 0 THEN key END) AS suffix, CASE WHEN key = 'task' THEN 'task' WHEN key LIKE 'llm:%' THEN 'llm' WHEN key LIKE 'sandbox:%' THEN 'sandbox' WHEN key LIKE 'node:%' THEN 'node' ELSE 'other' END AS category,
    CASE WHEN strpos(key, ':') = 0 THEN key ELSE split_part(key, ':', 1) || ': ' || string_split(substr(key, strpos(key, ':') + 1), '/')[-1] END AS short, event_type || ':' || user_id || ':' || event_id AS idempotency FROM parts""")
def key_texts(t):
    user = F.col("user_id")
    key = F.concat_ws(":", "event_type", "user_id")
    for kind, name in NAMES.items():
        key = F.when(F.col("event_type") == kind, name).otherwise(key)
    scale = F.when(user % 4 == 0, 1).when(user % 4 == 1, 50).when(user % 4 == 2, 3000).otherwise(100_000)
    return t.events.withColumn("key", key).select(
        "event_id", T.duration_text(F.floor(F.col("value") * scale)).alias("took"), "key", T.key_suffix(F.col("key")).alias("suffix"), T.span_category(F.col("key")).alias("category"),
        T.short_name(F.col("key")).alias("short"), T.idempotency_key(F.col("event_type"), user, F.col("event_id")).alias("idempotency"),
    )
