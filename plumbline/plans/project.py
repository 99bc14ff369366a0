"""Queries on project scans, upgrades, commands, retention and graph shapes."""

from pyspark.sql import functions as F

from ..functions.scratch import dealt
from ..operators import control as C
from ..operators import rules as R
from ..operators.windows import ordinal
from .registry import query

# Each order is a source file whose lines are imports, one for each of its lineitems.
PACKAGES = ["javax.xml.ws.soap", "javax.xml.bind", "javax.annotation.processing", "java.util", "org.omg.CORBA", "javax.servlet.http", "com.acme", "org.apache.http.client"]
_values = lambda rows: ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" for x in r) + ")" for r in rows)
_list = lambda rows: "[" + ", ".join(f"'{x}'" for x in rows) + "]"


# Lineitems of an order are told apart by their place: line numbers are not unique.
LINES_SQL = "numbered AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS k FROM lineitem)"


#: Lineitems that a task sorts, about.
LINES = 200_000


def _numbered(t):
    return dealt(t.lineitem, t.lineitem.count(), LINES, "l_orderkey").withColumn("k", ordinal(["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]))


def _best(catalogue, excluded):
    """SQL for the longest prefix of name in a catalogue, unless an excluded one fits too."""
    return f"""(SELECT arg_max(p, length(p)) FROM (VALUES {_values([(p,) for p, _ in catalogue])}) c(p) WHERE (name = p OR starts_with(name, p || '.'))
        AND NOT EXISTS (SELECT 1 FROM (VALUES {_values([(x,) for x in excluded])}) e(x) WHERE name = x OR starts_with(name, x || '.')))"""


@query(f"""WITH {LINES_SQL}, lines AS (SELECT l_orderkey AS path, k AS n, ({_list(PACKAGES)})[l_partkey % 8 + 1] || '.T' || k AS name FROM numbered),
    distinct_names AS (SELECT DISTINCT name FROM lines),
    known AS (SELECT name, {_best(R.REMOVED, R.REMOVED_EXCLUSIONS)} AS gone, {_best(R.ARTIFACTS, R.ARTIFACT_EXCLUSIONS)} AS replaced FROM distinct_names),
    hits AS (SELECT path, n, name, gone, replaced, artifact, name LIKE 'org.apache.http.%' AS old_client FROM lines JOIN known USING (name) LEFT JOIN (VALUES {_values(R.ARTIFACTS)}) a(p, artifact) ON p = replaced)
    SELECT path, coalesce(string_agg(name || '<' || gone, ',' ORDER BY n) FILTER (gone IS NOT NULL), '') AS removed, coalesce(string_agg(name || '<' || artifact, ',' ORDER BY n) FILTER (artifact IS NOT NULL), '') AS mapped,
    coalesce(string_agg(name, ',' ORDER BY n) FILTER (gone IS NOT NULL OR replaced IS NOT NULL), '') AS legacy, CASE WHEN bool_or(old_client) THEN 'HTTPCLIENT4_LEGACY' ELSE '' END AS breaking
    FROM hits GROUP BY path HAVING bool_or(old_client OR gone IS NOT NULL OR replaced IS NOT NULL)""")
def project_scan(t):
    package = F.element_at(F.array(*[F.lit(p) for p in PACKAGES]), (F.col("l_partkey") % 8 + 1).cast("int"))
    line = F.concat(F.lit("import "), package, F.lit(".T"), F.col("k").cast("string"), F.lit(";"))
    content = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", line.alias("line")))), lambda x: x["line"]), "\n")
    found = R.scan_sources(_numbered(t).groupBy(F.col("l_orderkey").alias("path")).agg(content.alias("content")))
    shown = lambda c, field: F.array_join(F.transform(c, lambda x: F.concat(x["name"], F.lit("<"), x[field])), ",").alias(c)
    return found.select("path", shown("removed", "prefix"), shown("mapped", "artifact"), F.array_join("legacy", ",").alias("legacy"), F.array_join("breaking", ",").alias("breaking"))


@query(f"""WITH {LINES_SQL}, marked AS (SELECT *, k % 2 = 1 AS head, (k + 1) // 2 AS block FROM numbered)
    SELECT l_orderkey, block, max('/src/A' || l_partkey || '.java') FILTER (head) AS file, (max(l_quantity) FILTER (head))::INT AS line, (max(l_linenumber) FILTER (head))::INT AS "column", max('cannot find symbol') FILTER (head) AS message,
    coalesce(string_agg('symbol: class C' || l_suppkey, ',' ORDER BY k) FILTER (NOT head), '') AS details FROM marked GROUP BY ALL""")
def compile_errors(t):
    rows = _numbered(t)
    text = lambda c: F.col(c).cast("int").cast("string")
    head = F.concat(F.lit("[ERROR] /src/A"), F.col("l_partkey").cast("string"), F.lit(".java:["), text("l_quantity"), F.lit(","), text("l_linenumber"), F.lit("] cannot find symbol"))
    line = F.when(F.col("k") % 2 == 1, head).otherwise(F.concat(F.lit("[ERROR]   symbol: class C"), F.col("l_suppkey").cast("string")))
    found = R.compile_errors(rows.select("l_orderkey", "k", line.alias("text")), "l_orderkey", "k", "text")
    return found.withColumn("details", F.array_join("details", ","))


VERSIONS_SQL = "CASE p_size % 5 WHEN 0 THEN NULL WHEN 1 THEN '${x}' WHEN 2 THEN '3.' || p_size WHEN 3 THEN 'v3.5.' || p_size ELSE '2.' || p_size || '.1-SNAPSHOT' END"


@query(f"""WITH v AS (SELECT p_partkey, {VERSIONS_SQL} AS version FROM part),
    parts AS (SELECT *, list_transform(string_split(nullif(regexp_extract(version, '^v?([0-9]+([.][0-9]+)*)', 1), ''), '.'), lambda x: x::INT) AS n FROM v)
    SELECT p_partkey, CASE WHEN n IS NULL THEN 'none' WHEN list_resize(n, 3, 0) < [3, 5, 16] THEN 'upgrade' ELSE 'keep' END AS decision FROM parts""")
def parent_upgrade(t):
    size = F.col("p_size")
    text = size.cast("string")
    version = F.when(size % 5 == 0, None).when(size % 5 == 1, "${x}").when(size % 5 == 2, F.concat(F.lit("3."), text)).when(size % 5 == 3, F.concat(F.lit("v3.5."), text))
    return t.part.select("p_partkey", R.parent_upgrade(version.otherwise(F.concat(F.lit("2."), text, F.lit(".1-SNAPSHOT")))).alias("decision"))


@query("""SELECT p_partkey, CASE WHEN p_brand = 'Brand#11' THEN 'Brand#99' ELSE p_brand END AS new_grp, p_name AS new_artifact,
    CASE WHEN (p_brand = 'Brand#11' OR p_brand = 'Brand#12') AND p_size < 20 THEN '20' ELSE p_size::VARCHAR END AS new_version,
    CASE WHEN p_brand = 'Brand#11' THEN 'rename' WHEN p_brand = 'Brand#12' AND p_size < 20 THEN 'bump' ELSE 'keep' END AS change FROM part""")
def dependency_changes(t):
    rows = t.part.select("p_partkey", F.col("p_brand").alias("grp"), F.col("p_name").alias("artifact"), F.col("p_size").cast("string").alias("version"))
    names = t.part.select(F.col("p_name").alias("artifact")).distinct()
    renames = names.select(F.lit("Brand#11").alias("grp"), "artifact", F.lit("Brand#99").alias("new_grp"), F.col("artifact").alias("new_artifact"))
    bumps = names.select(F.explode(F.array(F.lit("Brand#99"), F.lit("Brand#12"))).alias("grp"), "artifact", F.lit("20").alias("least"))
    return R.dependency_changes(rows, renames, bumps).drop("grp", "artifact", "version")


@query("""SELECT DISTINCT o_custkey AS project, p_brand AS grp, p_name AS artifact FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'R'
    EXCEPT SELECT o_custkey, p_brand, p_name FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE l_returnflag = 'A'""")
def artifacts_to_add(t):
    of = t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey")).join(t.part, F.col("p_partkey") == F.col("l_partkey"))
    rows = of.select(F.col("o_custkey").alias("project"), F.col("p_brand").alias("grp"), F.col("p_name").alias("artifact"), "l_returnflag")
    return R.artifacts_to_add(rows.where("l_returnflag = 'R'"), rows.where("l_returnflag = 'A'"), "project")


@query("""WITH lines AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, o_custkey, o_totalprice, count(l_orderkey) AS n, count(*) FILTER (l_returnflag = 'R') AS bad FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)
    SELECT o_orderkey, array_to_string(list_filter([CASE WHEN o_orderstatus <> 'F' THEN 'TASK_NOT_SUCCEEDED' END, CASE WHEN o_custkey % 5 = 0 THEN 'WORKSPACE_GONE' END, CASE WHEN o_custkey % 7 = 0 THEN 'PROJECT_ROOT_GONE' END,
        CASE WHEN o_orderpriority = '1-URGENT' THEN 'DIRTY_WORKING_TREE' END, CASE WHEN o_orderkey % 3 = 0 THEN 'FILE_NOT_ALLOWED' END, CASE WHEN o_totalprice < 50000 THEN 'SANDBOX_FILE_MISSING' END,
        CASE WHEN o_totalprice > 200000 THEN 'SOURCE_FILE_MISSING' END, CASE WHEN bad > 0 THEN 'BASE_MISMATCH' END, CASE WHEN n = 0 THEN 'NO_PATCH' END], lambda x: x IS NOT NULL), ',') AS reasons FROM lines""")
def preflight_reasons(t):
    keys = ["o_orderkey", "o_orderstatus", "o_orderpriority", "o_custkey", "o_totalprice"]
    joined = t.orders.select(*keys).join(t.lineitem.select("l_orderkey", "l_returnflag"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    rows = joined.groupBy(*keys).agg(F.count("l_orderkey").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("bad"))
    reasons = R.refusals(
        task_not_succeeded=F.col("o_orderstatus") != "F", workspace_gone=F.col("o_custkey") % 5 == 0, project_root_gone=F.col("o_custkey") % 7 == 0, dirty_working_tree=F.col("o_orderpriority") == "1-URGENT",
        file_not_allowed=F.col("o_orderkey") % 3 == 0, sandbox_file_missing=F.col("o_totalprice") < 50_000, source_file_missing=F.col("o_totalprice") > 200_000, base_mismatch=F.col("bad") > 0, no_patch=F.col("n") == 0,
    )
    return rows.select("o_orderkey", F.array_join(reasons, ",").alias("reasons"))


STATUSES, ASKED = ["PENDING", "RUNNING", "WAITING_HUMAN", "SUCCEEDED", "FAILED", "CANCELLED"], ["approve_plan", "reject_plan", "approve_gate", "reject_gate", "cancel", "retry", "delete"]


@query(f"""WITH asked AS (SELECT o_orderkey, ({_list(STATUSES)})[o_orderkey % 6 + 1] AS status, ({_list(ASKED)})[o_custkey % 7 + 1] AS command, o_orderpriority < '3' AS gate, (o_orderkey % 4 = 0)::INT AS others FROM orders),
    legal AS (SELECT *, CASE WHEN command IN ('approve_plan', 'reject_plan') THEN status = 'WAITING_HUMAN' AND NOT gate WHEN command IN ('approve_gate', 'reject_gate') THEN status = 'WAITING_HUMAN' AND gate AND others = 0
        WHEN command = 'cancel' THEN status IN ('PENDING', 'WAITING_HUMAN', 'RUNNING') WHEN command = 'retry' THEN status IN ('FAILED', 'CANCELLED') ELSE status <> 'RUNNING' END AS ok FROM asked)
    SELECT o_orderkey, CASE WHEN ok THEN 'accepted' ELSE 'conflict' END AS outcome, CASE WHEN NOT ok OR (command = 'cancel' AND status = 'RUNNING') THEN status WHEN command IN ('approve_plan', 'approve_gate', 'retry') THEN 'PENDING'
        WHEN command = 'reject_gate' THEN 'FAILED' WHEN command = 'delete' THEN 'DELETED' ELSE 'CANCELLED' END AS next_status FROM legal""")
def task_commands(t):
    pick = lambda names, n: F.element_at(F.array(*[F.lit(x) for x in names]), (n + 1).cast("int"))
    rows = t.orders.select("o_orderkey", pick(STATUSES, F.col("o_orderkey") % 6).alias("status"), pick(ASKED, F.col("o_custkey") % 7).alias("command"), (F.col("o_orderpriority") < "3").alias("gate"), F.when(F.col("o_orderkey") % 4 == 0, 1).otherwise(0).alias("others"))
    outcome, after = C.command_outcome(F.col("status"), F.col("command"), F.col("gate"), F.col("others"))
    return rows.select("o_orderkey", outcome.alias("outcome"), after.alias("next_status"))


@query("""WITH folders AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN -o_orderkey ELSE o_orderkey END AS task, o_orderdate FROM orders),
    decided AS (SELECT f.o_orderkey, o.o_orderkey IS NULL AS orphan, CASE WHEN o.o_orderstatus IN ('O', 'P') THEN 'active' WHEN CASE WHEN o.o_orderkey IS NULL THEN f.o_orderdate ELSE o.o_orderdate + INTERVAL 30 DAY END < TIMESTAMP '1997-01-01' - INTERVAL 90 DAY THEN 'delete' ELSE 'keep' END AS decision
        FROM folders f LEFT JOIN orders o ON o.o_orderkey = f.task)
    SELECT count(*) AS scanned, count(*) FILTER (decision = 'delete') AS deleted, count(*) FILTER (decision = 'keep') AS kept, count(*) FILTER (decision = 'active') AS active, count(*) FILTER (orphan) AS orphans FROM decided""")
def retention_sweep(t):
    key = F.col("o_orderkey")
    folders = t.orders.select(key.alias("name"), F.when(key % 10 == 0, -key).otherwise(key).alias("task_id"), F.col("o_orderdate").alias("modified"))
    status = F.when(F.col("o_orderstatus") == "F", "SUCCEEDED").otherwise("RUNNING")
    tasks = t.orders.select(key.alias("task_id"), status.alias("status"), (F.col("o_orderdate") + F.expr("INTERVAL 30 DAY")).alias("ended"))
    return C.sweep_counts(C.sweep(folders, tasks, F.expr("TIMESTAMP_NTZ '1997-01-01'"), 90))


@query("""WITH decided AS (SELECT o_orderkey, CASE WHEN o_orderstatus IN ('O', 'P') THEN 'active' WHEN o_orderdate < TIMESTAMP '1996-01-01' THEN CASE WHEN o_orderkey % 7 = 0 THEN 'failed' ELSE 'delete' END ELSE 'keep' END AS decision FROM orders)
    SELECT count(*) AS scanned, count(*) FILTER (decision = 'delete') AS deleted, count(*) FILTER (decision = 'keep') AS kept, count(*) FILTER (decision = 'active') AS active, 0::BIGINT AS orphans, count(*) FILTER (decision = 'failed') AS failed FROM decided""")
def retention_removal(t):
    """A sweep whose removals fail for some folders."""

    def remove(name):
        if name % 7 == 0:
            raise OSError(f"folder {name} is in use")

    key = F.col("o_orderkey")
    folders = t.orders.select(key.alias("name"), key.alias("task_id"), F.col("o_orderdate").alias("modified"))
    tasks = t.orders.select(key.alias("task_id"), F.when(F.col("o_orderstatus") == "F", "SUCCEEDED").otherwise("RUNNING").alias("status"), F.col("o_orderdate").alias("ended"))
    return C.sweep_counts(C.removed(C.sweep(folders, tasks, F.expr("TIMESTAMP_NTZ '1996-03-31'"), 90), remove), with_failed=True)


@query("SELECT 'events' AS name, count(*) AS before, 0 AS after FROM events UNION ALL SELECT 'orders', count(*), 0 FROM orders UNION ALL SELECT 'lineitem', count(*), 0 FROM lineitem")
def reset_counts(t):
    left, counts = C.emptied({"events": t.events, "orders": t.orders, "lineitem": t.lineitem}, dry_run=False)
    return counts


@query("""SELECT 'lineitem' AS name, count(*) AS deleted FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')
    UNION ALL SELECT 'events', count(*) FROM events WHERE user_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')""")
def cascade_counts(t):
    return C.cascade(t.orders.where("o_orderstatus = 'P'"), "o_orderkey", {"lineitem": (t.lineitem, "l_orderkey"), "events": (t.events, "user_id")})[1]


@query("""WITH tasks AS (SELECT DISTINCT conv_id, conv_id % 3 = 0 AS pom, conv_id % 2 = 0 AS gate FROM conversations), files AS (SELECT DISTINCT conv_id, turn FROM conversations WHERE role = 'assistant' AND conv_id % 5 <> 0)
    SELECT conv_id, 'ANALYZE' AS src, 'PLAN' AS dst FROM tasks UNION ALL SELECT conv_id, 'PLAN', 'POM' FROM tasks WHERE pom
    UNION ALL SELECT conv_id, CASE WHEN pom THEN 'POM' ELSE 'PLAN' END, 'REWRITE:' || turn FROM tasks JOIN files USING (conv_id) UNION ALL SELECT conv_id, 'REWRITE:' || turn, CASE WHEN gate THEN 'GATE' ELSE 'VERIFY' END FROM tasks JOIN files USING (conv_id)
    UNION ALL SELECT conv_id, CASE WHEN pom THEN 'POM' ELSE 'PLAN' END, CASE WHEN gate THEN 'GATE' ELSE 'VERIFY' END FROM tasks WHERE conv_id NOT IN (SELECT conv_id FROM files) UNION ALL SELECT conv_id, 'GATE', 'VERIFY' FROM tasks WHERE gate""")
def expected_shape(t):
    tasks = t.conversations.select("conv_id").distinct().select("conv_id", (F.col("conv_id") % 3 == 0).alias("with_pom"), (F.col("conv_id") % 2 == 0).alias("with_gate"))
    files = t.conversations.where("role = 'assistant' and conv_id % 5 <> 0").select("conv_id", F.col("turn").alias("file"))
    return C.plan_shape(tasks, files, "conv_id")


# Events as a task's nodes: views are rewrites of the file value % 5, clicks are verifications; the attempt is the place among its like.
RETRY_SQL = """base AS (SELECT user_id, CASE event_type WHEN 'view' THEN 'REWRITE' ELSE 'VERIFY' END AS kind, CASE event_type WHEN 'view' THEN event_id % 5 END AS file, event_id FROM events WHERE event_type IN ('view', 'click')),
    nodes AS (SELECT user_id, kind, file, row_number() OVER (PARTITION BY user_id, kind, file ORDER BY event_id) AS attempt, CASE WHEN kind = 'VERIFY' AND event_id % 9 = 0 THEN 'PENDING' WHEN event_id % 2 = 0 THEN 'FAILED' ELSE 'SUCCEEDED' END AS status,
        event_id % 3 = 0 AS legacy FROM base)"""


@query(f"""WITH {RETRY_SQL}, last AS (SELECT user_id, max(attempt) AS tried FROM nodes WHERE kind = 'VERIFY' AND status <> 'PENDING' GROUP BY user_id HAVING arg_max(status, attempt) = 'FAILED'),
    newest AS (SELECT user_id, file, max(attempt) AS attempt, arg_max(legacy, attempt) AS legacy, tried FROM nodes JOIN last USING (user_id) WHERE kind = 'REWRITE' GROUP BY ALL),
    again AS (SELECT * FROM newest WHERE attempt < 30 AND (legacy OR user_id NOT IN (SELECT user_id FROM newest WHERE legacy)))
    SELECT user_id, 'rewrite' AS action, file, attempt + 1 AS attempt FROM again UNION ALL SELECT DISTINCT user_id, 'verify', NULL, tried + 1 FROM again
    UNION ALL SELECT user_id, 'skip', NULL, attempt FROM nodes WHERE kind = 'VERIFY' AND status = 'PENDING' AND user_id IN (SELECT user_id FROM again)""")
def retry_after_verify(t):
    base = t.events.where("event_type in ('view', 'click')").select("user_id", F.when(F.col("event_type") == "view", "REWRITE").otherwise("VERIFY").alias("kind"), F.when(F.col("event_type") == "view", F.col("event_id") % 5).alias("file"), "event_id")
    key = F.col("event_id")
    status = F.when((F.col("kind") == "VERIFY") & (key % 9 == 0), "PENDING").when(key % 2 == 0, "FAILED").otherwise("SUCCEEDED")
    nodes = base.select("user_id", "kind", "file", ordinal(["user_id", "kind", "file"], ["event_id"]).alias("attempt"), status.alias("status"), (key % 3 == 0).alias("legacy"))
    return C.after_failed_verify(nodes, "user_id", 30)


@query("""WITH results AS (SELECT l_orderkey AS task, l_partkey % 3 AS path, (['REWRITE', 'POM', 'DEPENDENCY', 'PARENT', 'OTHER'])[l_suppkey % 5 + 1] AS kind, l_linenumber AS attempt, CASE WHEN l_returnflag = 'N' THEN 'FAILED' ELSE 'SUCCEEDED' END AS status FROM lineitem)
    SELECT task, path, kind, attempt FROM results WHERE status = 'SUCCEEDED' AND kind <> 'OTHER'
    QUALIFY row_number() OVER (PARTITION BY task, path ORDER BY list_position(['REWRITE', 'POM', 'DEPENDENCY', 'PARENT'], kind) DESC, attempt DESC) = 1""")
def replay_order(t):
    kind = F.element_at(F.array(*[F.lit(k) for k in [*C.REPLAY, "OTHER"]]), (F.col("l_suppkey") % 5 + 1).cast("int"))
    rows = t.lineitem.select(F.col("l_orderkey").alias("task"), (F.col("l_partkey") % 3).alias("path"), kind.alias("kind"), F.col("l_linenumber").alias("attempt"), F.when(F.col("l_returnflag") == "N", "FAILED").otherwise("SUCCEEDED").alias("status"))
    return C.replayed(rows, "task", "path").select("task", "path", "kind", "attempt")


@query("""SELECT user_id, min(ts) FILTER (event_type <> 'view') AS started, count(*) AS n FROM events GROUP BY user_id ORDER BY started NULLS LAST, user_id LIMIT 100""")
def runs_by_start(t):
    runs = t.events.groupBy("user_id").agg(F.min(F.when(F.col("event_type") != "view", F.col("ts"))).alias("started"), F.count("*").alias("n"))
    return runs.orderBy(F.asc_nulls_last("started"), "user_id").limit(100)
