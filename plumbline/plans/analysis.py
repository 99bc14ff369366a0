"""Queries on evaluation runs, traces and dependency graphs."""

from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..operators import graphs as G
from ..operators import store as S
from ..operators import traces as R
from ..operators import windows as W
from .registry import query
from .store import cost

# Labels as evaluation runs: quality is what was expected, toxic the outcome; no source starts with src1: harness errors.
RUNS_SQL = """runs AS (SELECT doc_id AS case_id, source AS project, lang, n_chars, CASE WHEN quality = 1 THEN 'SUCCEEDED' ELSE 'FAILED' END AS expect,
    CASE WHEN doc_id % 11 = 0 THEN NULL WHEN toxic = 0 THEN 'SUCCEEDED' ELSE 'FAILED' END AS status,
    CASE WHEN doc_id % 13 = 0 THEN 'timeout' END AS harness_error, CASE WHEN doc_id % 7 > 0 THEN doc_id % 4 END AS attempts FROM labels JOIN documents USING (doc_id)),
    judged AS (SELECT *, CASE WHEN harness_error IS NOT NULL OR status IS NULL THEN 'HARNESS_ERROR' WHEN status = expect THEN 'AS_EXPECTED' ELSE 'UNEXPECTED' END AS verdict FROM runs)"""


def runs(t):
    joined = t.labels.join(t.documents.select("doc_id", "source", "lang", "n_chars"), "doc_id")
    status = F.when(F.col("doc_id") % 11 == 0, None).when(F.col("toxic") == 0, "SUCCEEDED").otherwise("FAILED")
    return joined.select(
        F.col("doc_id").alias("case_id"), F.col("source").alias("project"), "lang", "n_chars", F.when(F.col("quality") == 1, "SUCCEEDED").otherwise("FAILED").alias("expect"),
        status.alias("status"), F.when(F.col("doc_id") % 13 == 0, "timeout").alias("harness_error"), F.when(F.col("doc_id") % 7 > 0, F.col("doc_id") % 4).alias("attempts"),
    )


def judged(t):
    return runs(t).withColumn("verdict", E.verdict(F.col("harness_error"), F.col("status"), F.col("expect")))


def _ratio(hit, among):
    return f"(count(*) FILTER ({hit} AND {among}))::DOUBLE / nullif(count(*) FILTER ({among}), 0)"


@query(f"""WITH {RUNS_SQL} SELECT count(*) AS total, count(*) FILTER (verdict <> 'HARNESS_ERROR') AS usable, count(*) FILTER (verdict = 'HARNESS_ERROR') AS harness_errors,
    {_ratio("verdict = 'AS_EXPECTED'", "verdict <> 'HARNESS_ERROR'")} AS as_expected,
    {_ratio("verdict = 'AS_EXPECTED'", "verdict <> 'HARNESS_ERROR' AND expect = 'SUCCEEDED'")} AS positive_success,
    {_ratio("verdict = 'AS_EXPECTED'", "verdict <> 'HARNESS_ERROR' AND expect <> 'SUCCEEDED'")} AS negative_caught,
    count(*) FILTER (verdict <> 'HARNESS_ERROR' AND attempts IS NOT NULL) AS with_metrics, count(*) FILTER (verdict <> 'HARNESS_ERROR' AND attempts > 1) AS retried_cases,
    {_ratio("attempts <= 1", "verdict <> 'HARNESS_ERROR' AND attempts IS NOT NULL")} AS first_try FROM judged""")
def eval_overview(t):
    return E.overview(runs(t), attempts="attempts")


@query("""SELECT l_returnflag, sum(least(l_linenumber * 10, l_quantity))::DOUBLE / nullif(sum(l_quantity), 0) AS rate FROM lineitem GROUP BY l_returnflag""")
def eval_weighted_rate(t):
    return t.lineitem.groupBy("l_returnflag").agg(E.weighted_rate((F.col("l_linenumber") * 10).cast("double"), F.col("l_quantity")).alias("rate"))


@query("""SELECT l_returnflag, l_linestatus, count(l_quantity) AS n, avg(l_quantity) AS mean, quantile_disc(l_quantity, 0.5) AS median, quantile_disc(l_quantity, 0.9) AS p90,
    min(l_quantity) AS least, max(l_quantity) AS most FROM lineitem GROUP BY ALL""")
def eval_distribution(t):
    return E.distribution_by(t.lineitem, ["l_returnflag", "l_linestatus"], F.col("l_quantity"))


@query(f"""WITH {RUNS_SQL}, labelled AS (SELECT *, unnest([lang, CASE WHEN n_chars > 2000 THEN 'long' ELSE 'short' END]) AS label FROM judged)
    SELECT label, count(*) FILTER (verdict <> 'HARNESS_ERROR') AS usable, {_ratio("verdict = 'AS_EXPECTED'", "verdict <> 'HARNESS_ERROR'")} AS as_expected FROM labelled GROUP BY label""")
def eval_by_label_multi(t):
    labels = F.array("lang", F.when(F.col("n_chars") > 2000, "long").otherwise("short"))
    usable = F.col("verdict") != "HARNESS_ERROR"
    rows = judged(t).withColumn("label", F.explode(labels)).groupBy("label")
    return rows.agg(F.count_if(usable).alias("usable"), E.ratio(F.col("verdict") == "AS_EXPECTED", usable).alias("as_expected"))


@query(f"""WITH {RUNS_SQL} SELECT project, count(*) AS total, {_ratio("verdict = 'AS_EXPECTED'", "verdict <> 'HARNESS_ERROR'")} AS as_expected FROM judged GROUP BY project""")
def eval_by_project(t):
    return judged(t).groupBy("project").agg(F.count("*").alias("total"), E.ratio(F.col("verdict") == "AS_EXPECTED", F.col("verdict") != "HARNESS_ERROR").alias("as_expected"))


@query(f"""WITH {RUNS_SQL} SELECT project, count(*) FILTER (verdict = 'AS_EXPECTED') AS as_expected, count(*) FILTER (verdict = 'UNEXPECTED') AS unexpected,
    count(*) FILTER (verdict = 'HARNESS_ERROR') AS harness_error FROM judged GROUP BY project""")
def verdict_histogram(t):
    kinds = ["AS_EXPECTED", "UNEXPECTED", "HARNESS_ERROR"]
    return judged(t).groupBy("project").agg(*[F.count_if(F.col("verdict") == k).alias(k.lower()) for k in kinds])


@query("""WITH sums AS (SELECT l_orderkey, count(*) FILTER (l_returnflag <> 'R') AS part, count(*) FILTER (l_linestatus = 'O') AS whole FROM lineitem GROUP BY l_orderkey),
    rates AS (SELECT *, CASE WHEN whole > 0 THEN least(greatest(floor(part * 100.0 / whole + 0.5), 0), 100)::INT END AS percent FROM sums)
    SELECT l_orderkey, percent, CASE WHEN percent IS NULL THEN 'empty' WHEN percent = 100 THEN 'pass' WHEN percent > 0 THEN 'partial' ELSE 'fail' END AS state,
    CASE WHEN percent IS NULL THEN 'none' WHEN percent >= 90 THEN 'good' WHEN percent >= 60 THEN 'mid' ELSE 'bad' END AS tone FROM rates""")
def rate_state(t):
    sums = t.lineitem.groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") != "R").alias("part"), F.count_if(F.col("l_linestatus") == "O").alias("whole"))
    percent, state = E.rate_state(F.col("part"), F.col("whole"))
    return sums.select("l_orderkey", percent.alias("percent"), state.alias("state"), E.tone(percent).alias("tone"))


@query("""SELECT l_orderkey, count(*) AS total, count(*) FILTER (l_returnflag = 'R') AS failed, count(*) FILTER (l_returnflag = 'N') AS skipped,
    count(*) FILTER (l_returnflag = 'A') AS passed, coalesce(string_agg(l_linenumber || '#' || l_partkey, ',' ORDER BY l_linenumber, l_partkey) FILTER (l_returnflag = 'R'), '') AS failed_names
    FROM lineitem GROUP BY l_orderkey""")
def suite_totals(t):
    flag = F.col("l_returnflag")
    found = E.suite_totals(t.lineitem, ["l_orderkey"], flag == "R", flag == "N", ["l_linenumber", "l_partkey"], F.concat_ws("#", "l_linenumber", "l_partkey"))
    return found.withColumn("failed_names", F.array_join("failed_names", ","))


@query("""SELECT o_orderkey, CASE WHEN count(l_orderkey) = 0 THEN -1.0 WHEN sum(l_quantity) = 0 THEN 0.0 ELSE sum(l_quantity * (l_linenumber % 2)) / sum(l_quantity) END AS parity,
    sum(l_quantity * (l_linenumber % 2)) / nullif(sum(l_quantity), 0) AS coverage FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def coverage_ratio(t):
    joined = t.orders.select("o_orderkey").join(t.lineitem.select("l_orderkey", "l_quantity", "l_linenumber"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    share = E.share_covered(F.col("l_quantity") * (F.col("l_linenumber") % 2), F.col("l_quantity"))
    parity = F.when(F.count("l_orderkey") == 0, -1.0).otherwise(F.coalesce(share, F.lit(0.0)))
    return joined.groupBy("o_orderkey").agg(parity.alias("parity"), share.alias("coverage"))


@query("""WITH low AS (SELECT p_brand, min(struct_pack(s := p_size, k := p_partkey, n := p_name)) FILTER (p_retailprice < 1200) AS x, min(p_partkey) AS first FROM part GROUP BY p_brand)
    SELECT p_brand, coalesce(x.s || ':' || x.n, 'first:' || first) AS reason FROM low""")
def argmin_with_fallback(t):
    name = F.concat(F.col("p_size").cast("string"), F.lit(":"), "p_name")
    first = F.concat(F.lit("first:"), F.min("p_partkey").cast("string"))
    return t.part.groupBy("p_brand").agg(E.least_with_fallback(F.col("p_retailprice") < 1200, ["p_size", "p_partkey"], name, first).alias("reason"))


@query("""SELECT user_id, CASE WHEN count(*) FILTER (event_type = 'click') > 0 THEN greatest(count(DISTINCT value::INT) FILTER (event_type = 'view'), 1) ELSE count(DISTINCT value::INT) FILTER (event_type = 'view') END AS targets
    FROM (SELECT user_id, event_type, floor(value) AS value FROM events) GROUP BY user_id""")
def distinct_suffix_count(t):
    kind = F.col("event_type")
    return t.events.groupBy("user_id").agg(E.distinct_or_one(kind == "view", F.floor("value"), kind == "click").alias("targets"))


@query("""SELECT o_orderkey, count(l_orderkey) > 0 AND coalesce(bool_and(l_linestatus = 'F'), false) AS done FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def all_match(t):
    joined = t.orders.select("o_orderkey").join(t.lineitem.select("l_orderkey", "l_linestatus"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return joined.groupBy("o_orderkey").agg(E.all_match(F.col("l_orderkey"), F.col("l_linestatus") == "F").alias("done"))


@query("""WITH calls AS (SELECT l_orderkey, count(*) AS llm_calls, sum(l_quantity::BIGINT)::BIGINT AS tokens, sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4)))::DOUBLE AS cost,
        count(DISTINCT l_linenumber) FILTER (l_returnflag <> 'N') AS rounds, max(l_shipdate) AS last FROM lineitem GROUP BY l_orderkey)
    SELECT o_orderkey, coalesce(llm_calls, 0) AS llm_calls, coalesce(tokens, 0) AS tokens, coalesce(cost, 0) AS cost, coalesce(rounds, 0) AS rounds,
    greatest(0, datediff('second', o_orderdate, last)) AS duration_s FROM orders LEFT JOIN calls ON l_orderkey = o_orderkey""")
def metrics_row(t):
    rounds = F.when(F.col("l_returnflag") != "N", F.col("l_linenumber"))
    calls = E.call_metrics(t.lineitem, "l_orderkey", F.col("l_quantity").cast("long"), cost(), rounds, "l_shipdate")
    joined = t.orders.join(calls, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("llm_calls", "tokens", "cost", "rounds")]
    seconds = F.unix_seconds(F.col("last").cast("timestamp")) - F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    return joined.select("o_orderkey", *zero, F.greatest(F.lit(0), seconds).alias("duration_s"))


# Events as spans: a trace is a user's day, the value is the length in seconds; the last event of a day is still open for user_id % 7 = 0.
SPANS_SQL = """spans AS (SELECT user_id, ts::DATE AS day, event_id AS id, event_type AS name, (row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) > 1)::INT AS depth,
    (epoch_us(ts) // 1000) AS start_ms, CASE WHEN user_id % 7 = 0 AND event_id % 5 = 0 THEN NULL ELSE (epoch_us(ts) // 1000) + floor(value * 1000)::BIGINT END AS end_ms, floor(value * 1000)::BIGINT AS took FROM events)"""


def spans(t):
    e = t.events.withColumn("day", F.to_date("ts"))
    start = F.unix_millis(F.col("ts").cast("timestamp"))
    took = F.floor(F.col("value") * 1000)
    depth = (W.ordinal(["user_id", "day"], ["ts", "event_id"]) > 1).cast("int")
    end = F.when(~((F.col("user_id") % 7 == 0) & (F.col("event_id") % 5 == 0)), start + took)
    return e.select("user_id", "day", F.col("event_id").alias("id"), F.col("event_type").alias("name"), depth.alias("depth"), start.alias("start_ms"), end.alias("end_ms"), took.alias("took"))


RUN_SQL = """trace AS (SELECT user_id, day, min(start_ms) AS started, CASE WHEN NOT bool_or(end_ms IS NULL) THEN max(end_ms) END AS ended,
    coalesce(greatest(CASE WHEN NOT bool_or(end_ms IS NULL) THEN max(end_ms) END - min(start_ms), 0), 0) AS duration_ms, count(*) AS spans, max(name) FILTER (depth = 0) AS root_name FROM spans GROUP BY ALL)"""


@query(f"WITH {SPANS_SQL}, {RUN_SQL} SELECT user_id, strftime(day, '%Y-%m-%d') AS day, started, ended, duration_ms, spans, root_name FROM trace")
def trace_runs(t):
    return R.runs(spans(t), ["user_id", "day"]).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query(f"""WITH {SPANS_SQL}, {RUN_SQL} SELECT c_custkey, sum(duration_ms)::BIGINT AS total_ms FROM customer LEFT JOIN trace ON user_id = c_custkey GROUP BY c_custkey""")
def trace_total_duration(t):
    totals = R.runs(spans(t), ["user_id", "day"]).groupBy("user_id").agg(F.sum("duration_ms").alias("total_ms"))
    return t.customer.select("c_custkey").join(totals, F.col("user_id") == F.col("c_custkey"), "left").select("c_custkey", "total_ms")


@query(f"""WITH {SPANS_SQL}, {RUN_SQL} SELECT user_id, strftime(day, '%Y-%m-%d') AS day, row_number() OVER (PARTITION BY user_id ORDER BY started) AS ordinal FROM trace""")
def trace_ordinals(t):
    found = R.runs(spans(t), ["user_id", "day"])
    return found.select("user_id", F.date_format("day", "yyyy-MM-dd").alias("day"), W.ordinal(["user_id"], ["started"]).alias("ordinal"))


@query(f"""WITH {SPANS_SQL}, span AS (SELECT *, min(start_ms) OVER w AS first, greatest(max(start_ms + took) OVER w - min(start_ms) OVER w, 1) AS span FROM spans WINDOW w AS (PARTITION BY user_id, day))
    SELECT id, round(least(greatest((start_ms - first) * 100.0 / span, 0), 100), 6)::DOUBLE AS "offset", round(least(greatest(took * 100.0 / span, 0.6), 100), 6)::DOUBLE AS width FROM span""")
def trace_bars(t):
    at, width = W.share_of_group(["user_id", "day"], F.col("start_ms"), F.col("took"))
    return spans(t).select("id", F.round(at.cast("double"), 6).alias("offset"), F.round(width.cast("double"), 6).alias("width"))


@query(f"""WITH {SPANS_SQL}, {RUN_SQL}, ranked AS (SELECT s.*, duration_ms, row_number() OVER (PARTITION BY s.user_id, s.day ORDER BY depth DESC, took DESC, id) AS n FROM spans s JOIN trace USING (user_id, day))
    SELECT user_id, strftime(day, '%Y-%m-%d') AS day, id, name, took AS duration_ms, took::DOUBLE / nullif(duration_ms, 0) AS share FROM ranked WHERE n = 1""")
def slowest_hop(t):
    s = spans(t)
    total = R.runs(s, ["user_id", "day"]).select("user_id", "day", F.col("duration_ms").alias("total_ms"))
    return R.slowest(s.join(total, ["user_id", "day"]), ["user_id", "day"], "took", "depth", "total_ms").withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("""WITH RECURSIVE up AS (SELECT conv_id, turn, turn AS at, 0 AS depth FROM conversations
        UNION ALL SELECT up.conv_id, up.turn, c.turn, depth + 1 FROM up JOIN conversations c ON c.conv_id = up.conv_id AND c.turn = up.at - 1 WHERE depth < 16)
    SELECT conv_id, turn, max(depth)::INT AS depth FROM up GROUP BY ALL""")
def trace_depth(t):
    rows = t.conversations.select("conv_id", "turn", (F.col("turn") - 1).alias("parent"))
    return R.depths(rows, "conv_id", "turn", "parent").select("conv_id", "turn", "depth")


# Turns as nodes: each needs the one or two before it; user turns are done, the others pending.
NODES_SQL = """nodes AS (SELECT conv_id, turn, role, list_filter([turn - 1, turn - 2], lambda x: x >= 0) AS needs, CASE WHEN role = 'assistant' AND turn % 3 = 0 THEN 'PENDING' WHEN turn > 4 THEN 'PENDING' ELSE 'SUCCEEDED' END AS status FROM conversations)"""


def nodes(t):
    needs = F.filter(F.array(F.col("turn") - 1, F.col("turn") - 2), lambda x: x >= 0)
    status = F.when((F.col("role") == "assistant") & (F.col("turn") % 3 == 0), "PENDING").when(F.col("turn") > 4, "PENDING").otherwise("SUCCEEDED")
    return t.conversations.select("conv_id", "turn", "role", needs.alias("needs"), status.alias("status"))


@query(f"""WITH {NODES_SQL} SELECT conv_id, turn FROM nodes n WHERE status = 'PENDING' AND NOT EXISTS (SELECT 1 FROM (SELECT conv_id AS c, turn AS k, unnest(needs) AS need FROM nodes) d
    WHERE d.c = n.conv_id AND d.k = n.turn AND NOT EXISTS (SELECT 1 FROM nodes m WHERE m.conv_id = d.c AND m.turn = d.need AND m.status = 'SUCCEEDED'))""")
def dag_runnable(t):
    return G.runnable(nodes(t), "conv_id", "turn", "needs", "status").select("conv_id", "turn")


@query(f"WITH {NODES_SQL} SELECT e.conv_id, src, dst FROM (SELECT conv_id, unnest(needs) AS src, turn AS dst FROM nodes) e JOIN nodes n ON n.conv_id = e.conv_id AND n.turn = e.src")
def dag_edges(t):
    return G.edges(nodes(t), "turn", "needs", "conv_id")


@query(f"""WITH RECURSIVE {NODES_SQL}, links AS (SELECT e.conv_id, src, dst FROM (SELECT conv_id, unnest(needs) AS src, turn AS dst FROM nodes) e JOIN nodes n ON n.conv_id = e.conv_id AND n.turn = e.src),
    walk AS (SELECT conv_id, turn, 0 AS level FROM nodes UNION SELECT l.conv_id, l.dst, level + 1 FROM walk w JOIN links l ON l.conv_id = w.conv_id AND l.src = w.turn)
    SELECT conv_id, turn, max(level)::INT AS level FROM walk GROUP BY ALL""")
def dag_levels(t):
    n = nodes(t)
    return G.levels(n, G.edges(n, "turn", "needs", "conv_id"), "conv_id", "turn").select("conv_id", "turn", "level")


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn // 2 ORDER BY turn) AS slot FROM conversations")
def dag_slots(t):
    return t.conversations.withColumn("level", F.floor(F.col("turn") / 2)).select("conv_id", "turn", W.ordinal(["conv_id", "level"], ["turn"]).alias("slot"))


@query("""WITH RECURSIVE links AS (SELECT DISTINCT 'p' || l_partkey AS src, 's' || l_suppkey AS dst FROM lineitem
        UNION SELECT DISTINCT 's' || l_suppkey, 'p' || l_partkey FROM lineitem),
    one AS (SELECT DISTINCT dst FROM links WHERE src = 'p1' OR src = 'p2'), two AS (SELECT DISTINCT l.dst FROM links l JOIN one ON l.src = one.dst)
    SELECT dst AS node, 1 AS hops FROM one WHERE dst NOT IN ('p1', 'p2') UNION ALL SELECT dst, 2 FROM two WHERE dst NOT IN (SELECT dst FROM one) AND dst NOT IN ('p1', 'p2')""")
def bfs_expand_2hop(t):
    pairs = t.lineitem.select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("src"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dst"))
    links = pairs.union(pairs.select("dst", "src"))
    return G.expand(links, t.spark.createDataFrame([("p1",), ("p2",)], "node string"), 2)


@query(f"""WITH {NODES_SQL} SELECT conv_id, role, max(turn) + 1 AS next_attempt FROM nodes GROUP BY ALL HAVING arg_max(status, turn) = 'PENDING' AND max(turn) < 7""")
def retry_next_attempt(t):
    return G.next_attempts(nodes(t).withColumn("failed", F.col("status") == "PENDING"), "conv_id", "role", "turn", "failed", 7)


@query("""SELECT conv_id, role, turn, length(text) AS n FROM conversations WHERE role <> 'system'
    QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY (role = 'assistant')::INT DESC, turn DESC) = 1""")
def replay_latest(t):
    rows = t.conversations.where("role <> 'system'")
    found = S.latest(rows, ["conv_id"], (F.col("role") == "assistant").cast("int").desc(), F.desc("turn"))
    return found.select("conv_id", "role", "turn", F.length("text").cast("long").alias("n"))


@query(f"""WITH RECURSIVE {NODES_SQL}, waves AS (SELECT conv_id, turn, 1 AS wave FROM nodes WHERE status = 'PENDING'
        UNION SELECT p.conv_id, p.turn, wave + 1 FROM nodes p JOIN waves w ON w.conv_id = p.conv_id AND list_contains(p.needs, w.turn) WHERE p.status = 'PENDING')
    SELECT conv_id, turn, max(wave)::INT AS wave FROM waves GROUP BY ALL""")
def wave_schedule(t):
    n = nodes(t).where("status = 'PENDING'")
    return G.levels(n, G.edges(n, "turn", "needs", "conv_id"), "conv_id", "turn").select("conv_id", "turn", (F.col("level") + 1).alias("wave"))


@query("""SELECT event_id, event_type, count(*) OVER (PARTITION BY user_id, ts::DATE, event_type) > 1 AS repeated FROM events""")
def dup_in_group_label(t):
    rows = t.events.withColumn("day", F.to_date("ts"))
    return rows.select("event_id", "event_type", W.repeated_in_group(["user_id", "day", "event_type"]).alias("repeated"))


@query("""SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY s DESC, first) AS place, s AS score FROM
    (SELECT user_id, event_type, count(*) AS s, min(event_id) AS first FROM events GROUP BY ALL)""")
def stable_rank_sort(t):
    scores = t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("score"), F.min("event_id").alias("first"))
    return scores.select("user_id", "event_type", W.ordinal(["user_id"], [F.desc("score"), "first"]).alias("place"), "score")
