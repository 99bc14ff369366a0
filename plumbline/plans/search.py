"""Queries on texts: retrieval, rules, budgets, text functions."""

from pyspark.sql import functions as F

from ..functions import json as J
from ..functions import text as T
from ..functions.scratch import dealt, fresh_path, kept_path
from ..operators import cells as VC
from ..operators import chunks as CH
from ..operators import fulltext as FT
from ..operators import retrieval as V
from ..operators import rules as R
from ..operators import similar as SM
from ..operators import windows as W
from .registry import query

TERMS = "list_filter(list_transform(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda w: lower(w)), lambda w: length(w) >= 2)"
GRAMS = "list_distinct(flatten(list_transform(regexp_extract_all(lower({0}), '[a-z0-9]+'), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"
KEYWORD_SQL = f"""terms AS (SELECT item_id AS query_id, unnest(list_distinct({TERMS})) AS q FROM benchmark),
    postings AS (SELECT id, term, count(*) AS tf FROM (SELECT doc_id AS id, unnest({TERMS}) AS term FROM documents) GROUP BY ALL),
    keyword AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM
        (SELECT query_id, id, round(sum(tf / (tf + 1)), 6) AS score FROM postings JOIN terms ON term = q GROUP BY ALL) QUALIFY rank <= 20)"""
VECTOR_SQL = """vec AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
    vector AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM
        (SELECT q.id AS query_id, v.id, round(list_cosine_distance(v.v, q.v), 6) AS distance FROM vec v, (SELECT * FROM vec WHERE {0}) q) QUALIFY rank <= 20)"""
# Symbols of documents are their sources, and a query's fragment is the source of the document that bears its id.
SYMBOL_SQL = """symbols AS (SELECT {1} AS id, {0} AS g FROM {2} WHERE {3} IS NOT NULL), asked AS (SELECT {1} AS query_id, {0} AS q FROM {2} WHERE {3} IS NOT NULL AND {4}),
    symbol AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT query_id, id,
        round(len(list_intersect(g, q)) / (len(g) + len(q) - len(list_intersect(g, q))), 6) AS score FROM symbols, asked WHERE len(list_intersect(g, q)) > 0) QUALIFY rank <= 20)"""
SOURCES_SQL = SYMBOL_SQL.format(GRAMS.format("source"), "doc_id", "documents", "source", "doc_id IN (SELECT item_id FROM benchmark)")
PARTS_SQL = SYMBOL_SQL.format(GRAMS.format("p_name"), "p_partkey", "part", "p_name", "p_partkey % 100 = 0")
FUSED_SQL = """ranks AS (SELECT query_id, id, rank, 0 AS arm, 'vector' AS source FROM vector UNION ALL SELECT query_id, id, rank, 1, 'keyword' FROM keyword UNION ALL SELECT query_id, id, rank, 2, 'symbol' FROM symbol),
    fused AS (SELECT query_id, id, round(sum(1 / (60 + rank)), 9) AS score, string_agg(source, '+' ORDER BY arm) AS sources FROM ranks GROUP BY ALL)"""

#: Java sources and texts that a task reads, about.
SOURCES, TEXTS = 25_000, 2_000


def _documents(t):
    return t.documents.select(F.col("doc_id").alias("id"), "text")


def _queries(t):
    return t.benchmark.select(F.col("item_id").alias("query_id"), "text")


def _keywords(t):
    """From the index that is kept of the documents."""
    return FT.index_of(t.documents, "documents", ("doc_id", "text")).search(_queries(t), V.CANDIDATES)


def _arms(t):
    vectors = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    symbols = t.documents.select(F.col("doc_id").alias("id"), F.col("source").alias("symbol"))
    ids = t.benchmark.select(F.col("item_id").alias("query_id"))
    return {
        "vector": V.vector_arm(vectors, vectors.withColumnRenamed("id", "query_id").join(ids, "query_id", "left_semi")),
        "keyword": _keywords(t),
        "symbol": V.symbol_arm(symbols, symbols.toDF("query_id", "fragment").join(ids, "query_id", "left_semi")),
    }


@query(f"WITH {VECTOR_SQL.format('id % 100 = 0')} SELECT query_id, id, distance, rank FROM vector")
def knn_cosine(t):
    vectors = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return V.vector_arm(vectors, vectors.where("id % 100 = 0").withColumnRenamed("id", "query_id"))


@query(f"WITH {VECTOR_SQL.format('id % 100 = 0')} SELECT query_id, id, distance, rank FROM vector")
def knn_cells(t):
    """The same from the kept index by cells, all of which are probed."""
    vectors = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    index = VC.CellIndex(t.spark, kept_path(t.embeddings, "cells"))
    if not index.built():
        index.build(vectors)
    return index.search(vectors.where("id % 100 = 0").withColumnRenamed("id", "query_id"), probes=VC.MOST_CELLS)


@query(f"WITH {KEYWORD_SQL} SELECT query_id, id, score, rank FROM keyword")
def keyword_topk(t):
    return _keywords(t)


@query(f"WITH {KEYWORD_SQL} SELECT query_id, id, score, rank FROM keyword")
def keyword_scan(t):
    """The same without an index."""
    return V.keyword_arm(_documents(t), _queries(t))


@query(f"SELECT doc_id AS id, term, count(*) AS tf FROM (SELECT CASE doc_id % 3 WHEN 0 THEN doc_id - 1 ELSE doc_id END AS doc_id, unnest({TERMS}) AS term FROM documents WHERE doc_id % 3 <> 2) WHERE term LIKE 'th%' GROUP BY ALL")
def fulltext_updates(t):
    """An index whose documents were moved to other ids, replaced and removed: what its postings say in the end."""
    docs = _documents(t)
    index = FT.TextIndex(t.spark, fresh_path(t.spark, "text-updates")).build(docs)
    index.update(docs.where("id % 3 = 0").withColumn("id", F.col("id") - 1))
    index.remove(docs.where("id % 3 = 0"))
    index.remove(docs.where("id % 3 = 2").join(docs.where("id % 3 = 0").select((F.col("id") - 1).alias("id")), "id", "left_anti"))
    terms = docs.select(F.explode(FT.words()).alias("term")).where("term like 'th%'").distinct()
    return index.postings(terms).select("id", "term", "tf")


@query(f"WITH {PARTS_SQL} SELECT query_id, id, score, rank FROM symbol")
def symbol_topk(t):
    symbols = t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("symbol"))
    return V.symbol_arm(symbols, symbols.where("id % 100 = 0").toDF("query_id", "fragment"))


@query(f"""WITH names AS (SELECT DISTINCT p_name FROM part), sims AS (SELECT a.p_name AS name, b.p_name AS other, {GRAMS.format('a.p_name')} AS g, {GRAMS.format('b.p_name')} AS h FROM names a, names b WHERE a.p_name <> b.p_name)
    SELECT name, other, round(len(list_intersect(g, h)) / (len(g) + len(h) - len(list_intersect(g, h))), 6) AS similarity FROM sims WHERE len(list_intersect(g, h)) > 0
    QUALIFY row_number() OVER (PARTITION BY name ORDER BY len(list_intersect(g, h)) / (len(g) + len(h) - len(list_intersect(g, h))) DESC, other) <= 3""")
def trigram_topk(t):
    names = t.part.select(F.col("p_name").alias("s"))
    scored = SM.nearest(names, names, 3, itself=False).select(F.col("s").alias("name"), "other", SM.similarity().alias("similarity"))
    return V.ranked(scored, ["name"], 3, F.desc("similarity"), F.col("other")).select("name", "other", F.round("similarity", 6).alias("similarity"))


FRAGMENT_SQL = "substr(p_name, 3, p_partkey % 7) || CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN '_' ELSE '%' END || substr(p_name, 4 + p_partkey % 7, p_partkey % 5)"


@query(f"""WITH asked AS (SELECT p_partkey AS query_id, {FRAGMENT_SQL} AS fragment FROM part WHERE p_partkey % 100 = 0),
    met AS (SELECT DISTINCT query_id, fragment, p_partkey AS id, p_name AS symbol FROM asked, part WHERE lower(p_name) LIKE '%' || lower(fragment) || '%'),
    sets AS (SELECT *, {GRAMS.format('symbol')} AS g, {GRAMS.format('fragment')} AS h FROM met),
    scores AS (SELECT query_id, id, round(coalesce(len(list_intersect(g, h)) / nullif(len(g) + len(h) - len(list_intersect(g, h)), 0), 0), 6) AS score FROM sets)
    SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scores QUALIFY rank <= 20""")
def symbol_contains(t):
    """Parts whose names contain fragments of other names, with wildcards in them."""
    key = F.col("p_partkey")
    wild = F.when(key % 3 == 0, "").when(key % 3 == 1, "_").otherwise("%")
    fragment = F.concat(F.substring("p_name", F.lit(3), (key % 7).cast("int")), wild, F.substring("p_name", (4 + key % 7).cast("int"), (key % 5).cast("int")))
    asked = t.part.where("p_partkey % 100 = 0").select(key.alias("query_id"), fragment.alias("fragment"))
    return SM.containing(t.part.select(key.alias("id"), F.col("p_name").alias("symbol")), asked, 20)


@query(f"WITH {VECTOR_SQL.format('id IN (SELECT item_id FROM benchmark)')}, {KEYWORD_SQL}, {SOURCES_SQL}, {FUSED_SQL} SELECT * FROM fused")
def rrf_fusion(t):
    return V.fused(_arms(t))


@query(f"""WITH {VECTOR_SQL.format('id IN (SELECT item_id FROM benchmark)')}, {KEYWORD_SQL}, {SOURCES_SQL}, {FUSED_SQL},
    own AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS n FROM fused WHERE id <> query_id QUALIFY n <= 6),
    heads AS (SELECT source AS grp, min(doc_id) AS head FROM documents GROUP BY source),
    near AS (SELECT DISTINCT query_id, head AS id FROM own JOIN documents d ON d.doc_id = own.id JOIN heads ON grp = d.source WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.query_id = own.query_id AND o.id = head)),
    every AS (SELECT query_id, id, score, sources FROM own UNION ALL SELECT query_id, id, 0.0, 'neighbor' FROM near)
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM every""")
def hybrid_search(t):
    hits = V.fused(_arms(t)).where("id <> query_id")
    return V.assembled(hits, t.documents.select(F.col("doc_id").alias("id"), F.col("source").alias("grp")))


@query(f"WITH {KEYWORD_SQL} SELECT query_id, id, round(sum(1 / (60 + rank)), 9) AS score, 'keyword' AS sources FROM keyword GROUP BY ALL")
def arm_isolation(t):
    """Arms that have nothing, fail in a task or fail in their code leave the others as they are."""

    def fails():
        raise OSError("no embedding service")

    vectors = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    bad = t.documents.select(F.col("doc_id").alias("query_id"), F.col("doc_id").alias("id"), F.when(F.col("doc_id") >= 0, F.raise_error(F.lit("disk")).cast("int")).alias("rank"))
    arms = {
        "vector": fails, "keyword": lambda: _keywords(t), "symbol": lambda: bad,
        "near": lambda: V.vector_arm(vectors.where("id < 0"), t.spark.createDataFrame([], "query_id long, vector array<float>")),
    }
    return V.fused(V.surviving(arms)[0])


@query("""SELECT source, doc_id, used FROM (SELECT source, doc_id, sum(ceil(length(text) / 4)::BIGINT) OVER (PARTITION BY source ORDER BY lang, doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM documents) WHERE used <= 3000""")
def prefix_budget(t):
    rows = t.documents.select("source", "lang", "doc_id", T.token_estimate(F.col("text")).alias("tokens"))
    return W.prefix_budget(rows, ["source"], ["lang", "doc_id"], "tokens", 3000).select("source", "doc_id", "used")


@query("""WITH RECURSIVE uniq AS (SELECT source, text, min(doc_id) AS id, ceil(length(text) / 4)::BIGINT AS tokens FROM documents GROUP BY source, text),
    items AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY tokens % 7, id) AS n FROM uniq),
    fold AS (SELECT source, 0::BIGINT AS n, 0::BIGINT AS used, 0::BIGINT AS kept FROM items GROUP BY source
        UNION ALL SELECT f.source, i.n, CASE WHEN kept = 0 OR used + tokens <= 3000 THEN used + tokens ELSE used END, CASE WHEN kept = 0 OR used + tokens <= 3000 THEN kept + 1 ELSE kept END
        FROM fold f JOIN items i ON i.source = f.source AND i.n = f.n + 1)
    SELECT source, max(used) AS used, max(kept) AS kept, max(n) - max(kept) AS dropped, max(used) > 3000 AS overflow FROM fold GROUP BY source""")
def greedy_budget(t):
    tokens = T.token_estimate(F.col("text"))
    items = t.documents.select("source", "text", (tokens % 7).alias("priority"), "doc_id", tokens.alias("tokens"))
    return W.curated(items, ["source"], "text", "priority", "doc_id", "tokens", 3000)[1]


@query("""WITH files AS (SELECT source, doc_id, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents), joined AS (SELECT f.*, v.vec_id FROM files f LEFT JOIN embeddings v ON v.vec_id = doc_id WHERE n <= 20)
    SELECT source AS project, doc_id AS path, length(substr(text, 1, 6000)) AS n_chars, vec_id IS NOT NULL AND NOT bool_or(vec_id IS NULL) OVER (PARTITION BY source) AS has_vector FROM joined""")
def index_build(t):
    chunks = t.documents.select(F.col("source").alias("project"), F.col("doc_id").alias("path"), F.lit("").alias("symbol"), F.col("text").alias("content"))
    vectors = t.documents.join(t.embeddings, F.col("vec_id") == F.col("doc_id")).select(F.col("source").alias("project"), F.col("doc_id").alias("path"), F.lit("").alias("symbol"), F.col("embedding").alias("vector"))
    return V.index_rows(chunks, vectors).select("project", "path", F.length("content").cast("long").alias("n_chars"), F.col("vector").isNotNull().alias("has_vector"))


@query("""WITH links AS (SELECT DISTINCT 'p' || l_partkey AS src, 's' || l_suppkey AS dst FROM lineitem UNION SELECT DISTINCT 's' || l_suppkey, 'p' || l_partkey FROM lineitem),
    hits AS (SELECT p_partkey AS query_id, 'p' || p_partkey AS id FROM part WHERE p_partkey % 100 = 0), one AS (SELECT DISTINCT query_id, dst AS id FROM hits JOIN links ON src = id),
    two AS (SELECT DISTINCT o.query_id, dst AS id FROM one o JOIN links ON src = o.id WHERE dst <> 'p' || o.query_id), every AS (SELECT *, 1 AS hops FROM one UNION ALL SELECT *, 2 FROM two)
    SELECT query_id, id, hops FROM every QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY hops, id) <= 40""")
def dependency_neighbours(t):
    pairs = t.lineitem.select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("src"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dst"))
    links = pairs.union(pairs.select("dst", "src"))
    hits = t.part.where("p_partkey % 100 = 0").select(F.col("p_partkey").alias("query_id"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"))
    return V.dependency_neighbours(hits, links, 2, 40)


@query("""SELECT l_orderkey, strftime(l_shipdate, '%Y%m%d-%H%M%S') AS run_id, CASE l_partkey % 4 WHEN 0 THEN l_linenumber * 3600 WHEN 1 THEN l_linenumber * 60 WHEN 2 THEN l_linenumber END AS seconds,
    round(l_quantity * 1000 / 1e6 * 3 + l_partkey / 1e6 * 15, 9) AS cost, CASE WHEN l_linenumber = 7 THEN 'no sample' ELSE printf('%.1f%%', l_discount * 100) END AS share, l_quantity * 1000 + l_linenumber * 1000 > 30000 AS over,
    CASE WHEN l_linenumber = 3 THEN false ELSE l_quantity * 100 - l_linenumber * 100 >= 1000 END AS split, CASE WHEN l_partkey % 4 = 3 THEN NULL ELSE '1.' || l_linenumber END AS tag FROM lineitem""")
def run_figures(t):
    n, part, amount = F.col("l_linenumber"), F.col("l_partkey"), F.col("l_quantity").cast("double")
    unit = F.element_at(F.array(*[F.lit(x) for x in ("h", "m", "s", "days")]), (part % 4 + 1).cast("int"))
    xml = F.concat(F.lit("<a><v> "), F.when(part % 4 != 3, F.concat(F.lit("1."), n.cast("string"))).otherwise(""), F.lit(" </v></a>"))
    return t.lineitem.select(
        "l_orderkey", T.run_id(F.col("l_shipdate")).alias("run_id"), T.duration_seconds(F.concat(n.cast("string"), unit)).alias("seconds"), F.round(T.token_cost(amount * 1000, part, 3, 15), 9).alias("cost"),
        T.percent_text(F.when(n != 7, F.col("l_discount").cast("double"))).alias("share"), T.over_budget(amount * 1000, n * 1000, 30_000).alias("over"),
        T.is_split_duration(amount * 100, F.when(n != 3, n * 100)).alias("split"), T.xml_value(xml, "v").alias("tag"),
    )


@query("""SELECT doc_id, array_to_string(list_filter(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda w: length(w) >= 2)[1:1], '') AS head,
    len(list_distinct(list_filter(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda w: length(w) >= 2))) AS n_terms FROM documents""")
def tokens(t):
    terms = T.query_terms(F.col("text"))
    return t.documents.select("doc_id", F.array_join(F.slice(terms, 1, 1), "").alias("head"), F.size(terms).cast("long").alias("n_terms"))


@query("""SELECT page_id, nullif(regexp_replace(string_split(url, '/')[-1], '^.*[.]', ''), '') AS fragment, nullif(split_part(url, '/', 5), '') AS lang FROM pages""")
def symbol_fragment(t):
    return t.pages.select("page_id", T.symbol_fragment(F.regexp_replace("url", "#", "~")).alias("fragment"), F.nullif(F.split_part("url", F.lit("/"), F.lit(5)), F.lit("")).alias("lang")).withColumn("fragment", F.regexp_replace("fragment", "~", "#"))


@query("SELECT doc_id, ceil(length(text) / 4)::BIGINT AS estimate FROM documents")
def token_estimate(t):
    return t.documents.select("doc_id", T.token_estimate(F.col("text")).alias("estimate"))


@query("""SELECT doc_id, CASE WHEN length(text) <= 300 THEN text ELSE substr(text, 1, 100) || chr(10) || '... [' || (length(text) - 300) || ' characters left out] ...' || chr(10) || right(text, 200) END AS short,
    CASE WHEN length(flat) > 80 THEN substr(flat, 1, 80) || '…' ELSE flat END AS line, array_to_string(string_split(text, chr(10))[-3:], chr(10)) AS tail FROM (SELECT *, trim(regexp_replace(text, '[ \t\r\n]+', ' ', 'g')) AS flat FROM documents)""")
def truncate_headtail(t):
    return t.documents.select("doc_id", T.head_and_tail(F.col("text"), 300).alias("short"), T.abbreviate(F.col("text"), 80).alias("line"), T.last_lines(F.col("text"), 3).alias("tail"))


@query("""SELECT page_id, split_part(url, '#', 1) AS owner, CASE WHEN instr(url, '#') > 1 THEN split_part(url, '#', 1) END AS type, array_to_string(string_split(url, '/')[-2:], '/') AS tail,
    replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS escaped, len(string_split(replace(replace(html, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))) AS n_lines,
    nullif(trim(split_part(url, '?', 2)), '') AS args, url || '::' || coalesce(nullif(split_part(url, '#', 2), ''), '') AS chunk FROM pages""")
def path_texts(t):
    url = F.col("url")
    anchor = F.nullif(F.split_part(url, F.lit("#"), F.lit(2)), F.lit(""))
    return t.pages.select(
        "page_id", F.substring_index("url", "#", 1).alias("owner"), T.owner_type(url).alias("type"), T.path_tail(url, 2).alias("tail"), T.html_escape(F.col("html")).alias("escaped"),
        F.size(T.lines(F.col("html"))).cast("long").alias("n_lines"), T.blank_to_null(F.split_part(url, F.lit("?"), F.lit(2))).alias("args"), T.chunk_key(url, anchor).alias("chunk"),
    )


@query("""SELECT event_id, v AS version, TRY_CAST(regexp_extract(regexp_replace(v, '^1\\.', ''), '^([0-9]+)(\\..*)?$', 1) AS INT) AS major
    FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '1.' || (event_id % 9) WHEN 1 THEN (event_id % 22) || '.0.2' WHEN 2 THEN '${java.version}' ELSE '' || (event_id % 22) END AS v FROM events)""")
def version_parse(t):
    n = lambda k: (F.col("event_id") % k).cast("string")
    case = F.col("event_id") % 4
    version = F.when(case == 0, F.concat(F.lit("1."), n(9))).when(case == 1, F.concat(n(22), F.lit(".0.2"))).when(case == 2, "${java.version}").otherwise(n(22))
    return t.events.select("event_id", version.alias("version"), T.java_major(version).alias("major"))


@query("""WITH base AS (SELECT text, min(doc_id) AS first FROM documents GROUP BY text)
    SELECT doc_id, sha256(d.text) AS hash, b.first <> d.doc_id AS repeated, CASE WHEN doc_id % 5 = 0 THEN true ELSE sha256(d.text) = sha256(b.text || CASE WHEN doc_id % 7 = 0 THEN 'x' ELSE '' END) END AS same FROM documents d JOIN base b ON b.text = d.text""")
def content_hash_compare(t):
    first = t.documents.groupBy(T.content_hash(F.col("text")).alias("h")).agg(F.min("doc_id").alias("first"))
    hashed = t.documents.withColumn("hash", T.content_hash(F.col("text")))
    baseline = F.when(F.col("doc_id") % 5 != 0, T.content_hash(F.concat("text", F.when(F.col("doc_id") % 7 == 0, "x").otherwise(""))))
    same = baseline.isNull() | (baseline == F.col("hash"))
    return hashed.join(first, F.col("h") == F.col("hash")).select("doc_id", "hash", (F.col("first") != F.col("doc_id")).alias("repeated"), same.alias("same"))


URL_SQL = "regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '')"


@query(f"""WITH names AS (SELECT DISTINCT {URL_SQL} AS name FROM pages), cat AS (SELECT DISTINCT split_part(name, '/', 1) AS prefix, 'host' AS kind FROM names UNION SELECT DISTINCT split_part(name, '/', 1) || '/' || split_part(name, '/', 2), 'lang' FROM names WHERE name LIKE '%/en/%'),
    best AS (SELECT name, arg_max(kind, length(prefix)) AS kind FROM names JOIN cat ON name = prefix OR starts_with(name, prefix || '/') GROUP BY name)
    SELECT name, CASE WHEN name LIKE 'm.%' THEN NULL ELSE kind END AS kind FROM names LEFT JOIN best USING (name)""")
def longest_prefix_join(t):
    name = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "")
    names = t.pages.select(name.alias("name")).distinct()
    part = lambda n: F.split_part("name", F.lit("/"), F.lit(n))
    catalogue = names.select(part(1).alias("prefix"), F.lit("host").alias("kind")).union(names.where("name like '%/en/%'").select(F.concat_ws("/", part(1), part(2)), F.lit("lang"))).distinct()
    mobile = names.where(F.col("name").startswith("m.")).select(part(1).alias("prefix")).distinct()
    return R.longest_prefix(names, "name", catalogue, "prefix", "kind", "/", mobile)


@query(f"""WITH files AS (SELECT DISTINCT {URL_SQL} AS path FROM pages), dirs AS (SELECT DISTINCT split_part(path, '/', 1) AS folder FROM files UNION SELECT DISTINCT split_part(path, '/', 1) || '/' || split_part(path, '/', 2) FROM files WHERE path LIKE '%/de/%'),
    best AS (SELECT path, arg_max(folder, length(folder)) AS folder FROM files JOIN dirs ON starts_with(path, folder || '/') GROUP BY path) SELECT path, folder FROM files LEFT JOIN best USING (path)""")
def containment_join(t):
    path = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "")
    files = t.pages.select(path.alias("path")).distinct()
    part = lambda n: F.split_part("path", F.lit("/"), F.lit(n))
    dirs = files.select(part(1).alias("folder")).union(files.where("path like '%/de/%'").select(F.concat_ws("/", part(1), part(2)))).distinct()
    return R.containing_dir(files, "path", dirs, "folder")


PAGE_RULES = {"script": ["<script", "</script>"], "table": ["<table", "<td"], "nav_and_footer": ["<nav", "<footer"], "links": ["(?i)<a [^>]*href", "http"], "title": ["<title>[^<]+</title>"]}


@query("""SELECT page_id, array_to_string(list_filter([CASE WHEN html LIKE '%<script%' AND html LIKE '%</script>%' THEN 'script' END, CASE WHEN html LIKE '%<table%' AND html LIKE '%<td%' THEN 'table' END,
    CASE WHEN html LIKE '%<nav%' AND html LIKE '%<footer%' THEN 'nav_and_footer' END, CASE WHEN regexp_matches(html, '(?i)<a [^>]*href') AND html LIKE '%http%' THEN 'links' END, CASE WHEN regexp_matches(html, '<title>[^<]+</title>') THEN 'title' END], lambda x: x IS NOT NULL), ',') AS rules FROM pages""")
def rule_scan_all_of(t):
    return t.pages.select("page_id", F.array_join(R.rule_hits(F.col("html"), PAGE_RULES), ",").alias("rules"))


@query("""WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), judged AS (SELECT doc_id, CASE WHEN line LIKE '%License%' THEN 'JAKARTA_LEFTOVER' WHEN line LIKE '%has been removed%' OR line LIKE '%org.springframework%' THEN 'API_SIGNATURE'
    WHEN line LIKE '%does not exist%' THEN 'DEPENDENCY_UNRESOLVED' WHEN line LIKE '%test%' THEN 'TEST_SOURCE' ELSE 'UNCLASSIFIED' END AS category FROM lines)
    SELECT category, count(*) AS n, count(DISTINCT doc_id) AS docs FROM judged GROUP BY category""")
def rule_priority_class(t):
    lines = t.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    category = R.error_category(F.col("line"), F.contains("line", F.lit("License")), F.contains("line", F.lit("test")))
    return lines.select("doc_id", category.alias("category")).groupBy("category").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))


@query("""SELECT doc_id, CASE WHEN n_chars < 50 THEN 'TOO_SHORT' WHEN lang = 'es' THEN 'LANG' WHEN text LIKE '%|%' THEN 'TABLE' END AS first,
    array_to_string(list_filter([CASE WHEN n_chars < 50 THEN 'TOO_SHORT' END, CASE WHEN lang = 'es' THEN 'LANG' END, CASE WHEN text LIKE '%|%' THEN 'TABLE' END], lambda x: x IS NOT NULL), ',') AS every FROM documents""")
def guard_first(t):
    rules = [(F.col("n_chars") < 50, "TOO_SHORT"), (F.col("lang") == "es", "LANG"), (F.contains("text", F.lit("|")), "TABLE")]
    return t.documents.select("doc_id", R.first_violation(*rules).alias("first"), F.array_join(R.all_violations(*rules), ",").alias("every"))


@query("""WITH lines AS (SELECT o_orderkey, o_orderstatus <> 'F' AS open, count(l_orderkey) AS n, count(*) FILTER (l_returnflag = 'R') AS bad FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)
    SELECT o_orderkey, array_to_string(list_filter([CASE WHEN open THEN 'TASK_NOT_SUCCEEDED' END, CASE WHEN n = 0 THEN 'NO_PATCH' END, CASE WHEN bad > 0 THEN 'BASE_MISMATCH' END], lambda x: x IS NOT NULL), ',') AS reasons FROM lines""")
def preflight_all(t):
    joined = t.orders.select("o_orderkey", "o_orderstatus").join(t.lineitem.select("l_orderkey", "l_returnflag"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    rows = joined.groupBy("o_orderkey", "o_orderstatus").agg(F.count("l_orderkey").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("bad"))
    reasons = R.all_violations((F.col("o_orderstatus") != "F", "TASK_NOT_SUCCEEDED"), (F.col("n") == 0, "NO_PATCH"), (F.col("bad") > 0, "BASE_MISMATCH"))
    return rows.select("o_orderkey", F.array_join(reasons, ",").alias("reasons"))


@query("""SELECT doc_id, coalesce(CASE WHEN quality = 0 THEN 'low' END, CASE WHEN toxic = 1 THEN 'toxic' END, CASE WHEN b.doc_id IS NOT NULL THEN 'long' END, 'plain') AS reason
    FROM documents LEFT JOIN labels USING (doc_id) LEFT JOIN (SELECT doc_id FROM documents WHERE n_chars > 5000) b USING (doc_id)""")
def plan_enrichment(t):
    docs = t.documents.select("doc_id", "n_chars")
    low = t.labels.where("quality = 0").select("doc_id", F.lit("low").alias("a"))
    toxic = t.labels.where("toxic = 1").select("doc_id", F.lit("toxic").alias("b"))
    joined = docs.join(low, "doc_id", "left").join(toxic, "doc_id", "left")
    return joined.select("doc_id", F.coalesce("a", "b", F.when(F.col("n_chars") > 5000, "long"), F.lit("plain")).alias("reason"))


@query("""WITH steps AS (SELECT o_custkey AS project, o_orderkey AS n, 'src/A' || (o_orderkey % 9) || '.java' AS path, CASE o_orderpriority WHEN '1-URGENT' THEN ' ' WHEN '2-HIGH' THEN NULL ELSE o_orderpriority END AS rationale FROM orders WHERE o_orderstatus = 'F'),
    targets AS (SELECT DISTINCT o_custkey AS project, 'SRC' || chr(92) || 'a' || (o_orderkey % 9) || '.java' AS path FROM orders),
    first AS (SELECT project, lower(path) AS k, arg_min_null(rationale, n) AS said FROM steps GROUP BY ALL),
    lines AS (SELECT o_custkey AS project, 'src/a' || (o_orderkey % 9) || '.java' AS k, CASE WHEN l_linenumber > 5 THEN 'R' ELSE 'S' END || l_linenumber AS flag, l_returnflag AS r FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
    flags AS (SELECT project, k, string_agg(DISTINCT flag, ', ' ORDER BY flag) AS flags FROM lines WHERE flag LIKE 'R%' GROUP BY ALL),
    found AS (SELECT t.*, nullif(trim(said), '') AS said, flags, EXISTS (SELECT 1 FROM lines l WHERE l.project = t.project AND l.k = lower(replace(t.path, chr(92), '/')) AND r = 'R') AS legacy,
        EXISTS (SELECT 1 FROM lines l WHERE l.project = t.project AND l.k = lower(replace(t.path, chr(92), '/')) AND r = 'A') AS breaking
        FROM targets t LEFT JOIN first f ON f.project = t.project AND f.k = lower(replace(t.path, chr(92), '/')) LEFT JOIN flags g ON g.project = t.project AND g.k = lower(replace(t.path, chr(92), '/')))
    SELECT project, path, CASE WHEN said IS NOT NULL THEN 'model' WHEN flags IS NOT NULL THEN 'removed' WHEN legacy THEN 'legacy' WHEN breaking THEN 'breaking' ELSE 'unexplained' END AS reason, coalesce(said, flags) AS detail FROM found""")
def plan_rationales(t):
    """A customer's orders name files of a project, their lines what scans find in them; paths differ in case and slashes."""
    file = lambda head: F.concat(F.lit(head), (F.col("o_orderkey") % 9).cast("string"), F.lit(".java"))
    said = F.when(F.col("o_orderpriority") == "1-URGENT", " ").when(F.col("o_orderpriority") != "2-HIGH", F.col("o_orderpriority"))
    project = F.col("o_custkey").alias("project")
    steps = t.orders.where("o_orderstatus = 'F'").select(project, F.col("o_orderkey").alias("n"), file("src/A").alias("path"), said.alias("rationale"))
    lines = t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey")).select(project, file("src/a").alias("path"), F.concat(F.when(F.col("l_linenumber") > 5, "R").otherwise("S"), F.col("l_linenumber").cast("string")).alias("flag"), "l_returnflag")
    targets = t.orders.select(project, file("SRC\\a").alias("path")).distinct()
    return R.enriched(targets, steps, lines.where("flag like 'R%'"), lines.where("l_returnflag = 'R'"), lines.where("l_returnflag = 'A'"))


@query("""WITH declared AS (SELECT o_orderkey, CASE l_linenumber % 4 WHEN 0 THEN '1.' || (5 + l_linenumber) WHEN 1 THEN '' || (l_partkey % 22) WHEN 2 THEN '${java.version}' END AS level FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey),
    least AS (SELECT o_orderkey, count(level) AS n, min(TRY_CAST(regexp_extract(regexp_replace(level, '^1[.]', ''), '^([0-9]+)$', 1) AS INT)) AS least FROM declared GROUP BY ALL)
    SELECT o_orderkey, least, CASE WHEN n = 0 THEN 'add' WHEN least IS NULL THEN 'unknown' WHEN least < 17 THEN 'upgrade' ELSE 'keep' END AS decision FROM least""")
def java_level(t):
    case = F.col("l_linenumber") % 4
    level = F.when(case == 0, F.concat(F.lit("1."), (5 + F.col("l_linenumber")).cast("string"))).when(case == 1, (F.col("l_partkey") % 22).cast("string")).when(case == 2, "${java.version}")
    declared = t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey"), "left").select("o_orderkey", level.alias("level"))
    return R.level_upgrade(declared, "o_orderkey", "level", 17)


@query("""WITH every AS (SELECT 0 AS priority, url AS path, page_id FROM pages WHERE url LIKE '%/en/%' UNION ALL SELECT 1, upper(url), page_id FROM pages WHERE url LIKE 'https%' UNION ALL SELECT 2, replace(url, '/', chr(92)), page_id FROM pages)
    SELECT priority, path, page_id FROM every QUALIFY row_number() OVER (PARTITION BY lower(replace(path, chr(92), '/')) ORDER BY priority, page_id) = 1""")
def ordered_union_merge(t):
    rows = t.pages.select(F.col("url").alias("path"), "page_id")
    upper = rows.where("path like 'https%'").select(F.upper("path").alias("path"), "page_id")
    back = rows.select(F.translate("path", "/", "\\").alias("path"), "page_id")
    return R.merged([rows.where("path like '%/en/%'"), upper, back], "path", "page_id").select("priority", "path", "page_id")


@query("""WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
    blocks AS (SELECT *, sum(regexp_matches(line, '^[A-Z][a-z]+ [a-z]+')::INT) OVER (PARTITION BY doc_id ORDER BY n) AS block FROM lines),
    sizes AS (SELECT doc_id, block, count(*) AS n FROM blocks WHERE block > 0 GROUP BY ALL)
    SELECT doc_id, block::BIGINT AS block, n AS n_lines, used::BIGINT AS used FROM (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY block) AS used FROM sizes) WHERE used <= 20""")
def error_blocks(t):
    docs = dealt(t.documents.select("doc_id", "text"), t.documents.count(), TEXTS, "doc_id")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    blocks = R.error_blocks(lines, "doc_id", "n", "line", "^[A-Z][a-z]+ [a-z]+").groupBy("doc_id", "block").agg(F.count("*").alias("n_lines"))
    return W.prefix_budget(blocks, ["doc_id"], ["block"], "n_lines", 20)


@query("""WITH diffs AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: CASE length(x) % 3 WHEN 0 THEN '+' || x WHEN 1 THEN '-' || x ELSE ' ' || x END) AS rows FROM documents)
    SELECT doc_id, len(list_filter(rows, lambda x: x LIKE '+%' AND x NOT LIKE '+++%')) AS added, len(list_filter(rows, lambda x: x LIKE '-%' AND x NOT LIKE '---%')) AS removed,
    md5(array_to_string(list_transform(list_filter(rows, lambda x: x NOT LIKE '-%' AND x NOT LIKE '+++%'), lambda x: substr(x, 2)), chr(10))) AS after FROM diffs""")
def diff_stat(t):
    sign = lambda x: F.when(F.length(x) % 3 == 0, "+").when(F.length(x) % 3 == 1, "-").otherwise(" ")
    diff = F.array_join(F.transform(F.split("text", "\n", -1), lambda x: F.concat(sign(x), x)), "\n")
    rows = t.documents.select("doc_id", diff.alias("diff"))
    added, removed = T.diff_stat(F.col("diff"))
    return rows.select("doc_id", added.alias("added"), removed.alias("removed"), F.md5(T.diff_side(F.col("diff"), after=True)).alias("after"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_extract(props, '$.missing') IS NULL AS no_missing FROM events")
def json_extract_typed(t):
    parsed = F.from_json("props", "k long, missing string")
    return t.events.select("event_id", parsed["k"].alias("k"), parsed["missing"].isNull().alias("no_missing"))


@query("""SELECT event_id, array_to_string(list_filter(['k', 'user', 'cost'], lambda x: NOT list_contains(json_keys(props), x)), ',') AS lacking FROM events""")
def json_required_keys(t):
    return t.events.select("event_id", F.array_join(J.has_keys(F.col("props"), ["k", "user", "cost"]), ",").alias("lacking"))


@query("SELECT event_id, props AS found FROM events")
def json_balanced_extract(t):
    noisy = F.concat(F.lit("note {not json} "), F.col("props"), F.lit(" and {\"k\": 1}"))
    return t.events.select("event_id", J.extracted(noisy, "k").alias("found"))


@query("""SELECT page_id, len(regexp_extract_all(html, 'class=')) AS n, list_contains(regexp_extract_all(html, '<([a-z0-9]+)', 1), 'script') AS legacy FROM pages""")
def legacy_reference_scan(t):
    tags = F.regexp_extract_all("html", F.lit("<([a-z0-9]+)"), F.lit(1))
    return t.pages.select("page_id", F.regexp_count("html", F.lit("class=")).cast("long").alias("n"), F.array_contains(tags, "script").alias("legacy"))


@query("""SELECT l_orderkey, NOT bool_or(l_returnflag = 'R') AND (count(*) > 1 OR bool_or(l_linestatus = 'O')) AS compiled,
    NOT bool_or(l_returnflag = 'R') AND (count(*) > 1 OR bool_or(l_linestatus = 'O')) AND max(l_quantity) < 45 AND count(*) FILTER (l_returnflag = 'A') = 0 AS green FROM lineitem GROUP BY l_orderkey""")
def verify_green(t):
    compiled = ~F.bool_or(F.col("l_returnflag") == "R") & ((F.count("*") > 1) | F.bool_or(F.col("l_linestatus") == "O"))
    green = compiled & (F.max("l_quantity") < 45) & (F.count_if(F.col("l_returnflag") == "A") == 0)
    return t.lineitem.groupBy("l_orderkey").agg(compiled.alias("compiled"), green.alias("green"))


@query("SELECT doc_id, regexp_extract_all(text, '[A-Z][a-z]+')[-1] AS last_name FROM documents")
def last_match_wins(t):
    return t.documents.select("doc_id", F.try_element_at(F.regexp_extract_all("text", F.lit("[A-Z][a-z]+"), F.lit(0)), F.lit(-1)).alias("last_name"))


@query("""SELECT doc_id, n AS chunk, length(part) AS n_chars, md5(part) AS hash FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS part, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents) WHERE length(trim(part)) > 0""")
def paragraph_chunks(t):
    parts = t.documents.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("chunk", "part")).where("length(trim(part)) > 0")
    return parts.select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.length("part").cast("long").alias("n_chars"), F.md5("part").alias("hash"))


@query("""WITH starts AS (SELECT doc_id, text, unnest(range(0, greatest(length(text) - 100, 1)::BIGINT, 300)) AS start FROM documents WHERE length(text) > 0)
    SELECT doc_id, start // 300 AS chunk, start, length(substr(text, start + 1, 400)) AS n_chars, md5(substr(text, start + 1, 400)) AS hash FROM starts""")
def window_chunks(t):
    found = CH.windows(t.documents, size=400, overlap=100)
    return found.select("doc_id", "chunk", "start", F.length("content").cast("long").alias("n_chars"), F.md5("content").alias("hash"))


@query("""WITH lines AS (SELECT l_orderkey AS k, l_linenumber AS l, l_returnflag AS f, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_returnflag = 'R') AS i, count(*) OVER (PARTITION BY l_orderkey) AS m FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)),
    orders2 AS (SELECT DISTINCT k, m FROM lines),
    every AS (SELECT k, 0 AS pos, 'p.o.Order' || k AS symbol, 'CLASS' AS kind, 3 AS start_line, 4 + 3 * m + 4 AS end_line FROM orders2
        UNION ALL SELECT k, i, 'p.o.Order' || k || CASE f WHEN 'R' THEN '#<init>' ELSE '#line' || l END, 'METHOD', 2 + 3 * i, 4 + 3 * i FROM lines
        UNION ALL SELECT k, m + 1, 'p.o.Order' || k || '$State', 'CLASS', 5 + 3 * m, 7 + 3 * m FROM orders2
        UNION ALL SELECT k, m + 2, 'p.o.Order' || k || '$State#of', 'METHOD', 6 + 3 * m, 6 + 3 * m FROM orders2)
    SELECT k AS path, (row_number() OVER (PARTITION BY k ORDER BY pos) - 1)::INT AS n, symbol, kind, start_line::INT AS start_line, end_line::INT AS end_line FROM every""")
def structural_chunks(t):
    """A class for each order with a method or constructor for each of its lines, and an enum inside."""
    name = F.concat(F.lit("Order"), F.col("l_orderkey").cast("string"))
    called = lambda x: F.when(x["r"], F.concat(F.lit("  public "), name)).otherwise(F.concat(F.lit("  @Line('{') <T> java.util.List<T> line"), x["l_linenumber"].cast("string")))
    method = lambda x: F.concat(called(x), F.lit('(int n) {\n    if (n > 0) { log("}"); } // {\n  }\n'))
    lines = t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("l_orderkey", F.struct("l_linenumber", (F.col("l_returnflag") == "R").alias("r")).alias("x"))
    lines = dealt(lines, t.orders.count(), SOURCES, "l_orderkey")  # so that no task has many sources, or is left alone at the end
    body = F.array_join(F.transform("x", method), "")
    source = F.concat(F.lit("/* class None { */\npackage p.o;\nfinal class "), name, F.lit(" extends Base<Order> {\n  int[] sizes = {1, 2}; int total = f(3);\n"), body, F.lit("  enum State { A(\"x\") { }, B;\n    static State of() { return A; }\n  }\n}\n"))
    files = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("x")).alias("x")).select(F.col("l_orderkey").alias("path"), source.alias("content"))
    return CH.structural(files, contents=False)


@query()
def schema_catalog(t):
    names = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
    rows = [(n, i, f.name, f.dataType.simpleString(), f.nullable) for n in names for i, f in enumerate(getattr(t, n).schema.fields)]
    return t.spark.createDataFrame(rows, "table_name string, ordinal int, column_name string, type string, nullable boolean").where(~F.col("table_name").startswith("flyway"))
