"""Queries over the driver's tables, one or more for each operator, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein import schemas
from skein.functions import fuzzy
from skein.functions import text as X
from skein.operators import community, concepts, graph, incremental, resolve, traverse
from skein.plans import adapters as A
from skein.shared import numbered, stored
from skein.sources import extract
from skein.streaming import ingest

#: Rounds of the PageRank queries, which their SQL unrolls: beyond what the tolerance asks for at any scale here.
ROUNDS = 40
#: Tasks that files made of a table's keys are dealt to.
FILE_TASKS = 64
_ENTRIES: dict[str, tuple] = {}


def _query(name: str, sql: str | None = None, graph_sql: bool = False):
    def keep(f):
        _ENTRIES[name] = (f, f"WITH RECURSIVE {A.SQL}{sql}" if graph_sql else sql)
        return f

    return keep


def queries() -> dict:
    return {k: f for k, (f, _) in _ENTRIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _ENTRIES.items() if sql}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question to ranked subgraph: the nodes that answer it, with their scores."""
    found = traverse.ask(A.trade_nodes(spark, sf_dir), A.trade_edges(spark, sf_dir), A.QUESTION)
    return found[1].select("id", "label", "modality", "ppr_score")


# functions


@_query(
    "slug_ids",
    "SELECT c_custkey, concat_ws('_', trim(regexp_replace(lower(c_name), '[^a-z0-9]+', '_', 'g'), '_'), trim(regexp_replace(lower(c_mktsegment), '[^a-z0-9]+', '_', 'g'), '_')) AS node_id FROM customer",
)
def slug_ids(spark, sf_dir):
    return A.table(spark, sf_dir, "customer").select("c_custkey", X.make_id(F.col("c_name"), F.lit(""), F.col("c_mktsegment"), ascii_only=True).alias("node_id"))


@_query(
    "normalize_ident",
    r"""WITH n AS (SELECT p_partkey, 'get' || upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) || 'By' || replace(p_name, ' ', '-') || 'ID' AS name FROM part)
SELECT p_partkey, name, trim(regexp_replace(lower(regexp_replace(name, '([a-z0-9])([A-Z])', '\1_\2', 'g')), '[^a-z0-9]+', '_', 'g'), '_') AS normalized FROM n""",
)
def normalize_ident(spark, sf_dir):
    name = F.concat(F.lit("get"), F.upper(F.substring("p_type", 1, 1)), F.lower(F.substring("p_type", 2, 1000)), F.lit("By"), F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("ID"))
    return A.table(spark, sf_dir, "part").select("p_partkey", name.alias("name"), X.normalize_identifier(name).alias("normalized"))


@_query("label_strip", "SELECT n_nationkey, trim('.' || n_name || '().', '().') AS label FROM nation")
def label_strip(spark, sf_dir):
    return A.table(spark, sf_dir, "nation").select("n_nationkey", X.simple_label(F.concat(F.lit("."), "n_name", F.lit("()."))).alias("label"))


@_query("last_import_component", r"SELECT p_partkey, trim(list_last(string_split(replace('com\' || p_brand || '.' || p_type || ' ', '\', '.'), '.'))) AS component FROM part")
def last_import_component(spark, sf_dir):
    module = F.concat(F.lit("com\\"), "p_brand", F.lit("."), "p_type", F.lit(" "))
    return A.table(spark, sf_dir, "part").select("p_partkey", X.last_component(module).alias("component"))


@_query("dotted_module", "SELECT c_custkey, 'src.' || lower(c_mktsegment) || '.m' || c_custkey || '.test' AS module FROM customer")
def dotted_module(spark, sf_dir):
    path = F.concat(F.lit("src/"), F.lower("c_mktsegment"), F.lit("/m"), F.col("c_custkey").cast("string"), F.lit(".test.py"))
    return A.table(spark, sf_dir, "customer").select("c_custkey", X.module_path(path).alias("module"))


@_query("word_tokens", "SELECT doc_id, len(list_distinct(regexp_extract_all(coalesce(text, ''), '[A-Za-z_][A-Za-z0-9_]*'))) AS n_words FROM documents")
def word_tokens(spark, sf_dir):
    return A.table(spark, sf_dir, "documents").select("doc_id", F.size(X.words(F.coalesce("text", F.lit("")))).cast("long").alias("n_words"))


@_query("confidence_weights", "SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'N' THEN 1.0::DOUBLE WHEN 'R' THEN 0.6 ELSE 0.3 END AS weight FROM lineitem")
def confidence_weights(spark, sf_dir):
    flag = F.when(F.col("l_returnflag") == "N", schemas.EXTRACTED).when(F.col("l_returnflag") == "R", schemas.INFERRED).otherwise(schemas.AMBIGUOUS)
    return A.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", X.confidence_weight(flag).alias("weight"))


@_query("segment_clock", "SELECT o_orderkey, format('{:02d}:{:02d}', floor(o_totalprice / 60)::BIGINT, floor(o_totalprice)::BIGINT % 60) AS at FROM orders")
def segment_clock(spark, sf_dir):
    return A.table(spark, sf_dir, "orders").select("o_orderkey", X.clock(F.col("o_totalprice")).alias("at"))


@_query("content_hash", "SELECT doc_id, sha1(coalesce(text, '')) AS sha1 FROM documents")
def content_hash(spark, sf_dir):
    return A.table(spark, sf_dir, "documents").select("doc_id", F.sha1(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("sha1"))


@_query(
    "parse_replies",
    """SELECT event_id, CASE WHEN event_id % 3 = 2 THEN 0 ELSE 1 END::BIGINT AS n_entities, CASE WHEN event_id % 3 = 2 THEN NULL ELSE event_type END AS first_name FROM events""",
)
def parse_replies(spark, sf_dir):
    """Replies as bare JSON, as JSON between fences, and broken."""
    body = F.concat(F.lit('{"entities": [{"name": "'), "event_type", F.lit('", "type": "kind"}], "relations": []}'))
    raw = F.when(F.col("event_id") % 3 == 0, body).when(F.col("event_id") % 3 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(F.lit("I can't say."))
    reply = X.parse_reply(raw)
    return A.table(spark, sf_dir, "events").select("event_id", F.size(reply["entities"]).cast("long").alias("n_entities"), F.get(reply["entities"], 0)["name"].alias("first_name"))


# files and policies

_PATHS = """paths AS (SELECT p_partkey, ['src', 'docs', 'build', '.git', 'HR', 'private', 'Vendor'][1 + p_partkey % 7] || '/' || lower(p_type) || '/f' || p_partkey
  || ['.py', '.MD', '.pdf', '.jpeg', '.webm', '.rs', '.bin', '', '.tsx', '.txt', '.h'][1 + p_partkey % 11] AS path FROM part)"""


def _paths(spark, sf_dir):
    pick = lambda values: F.get(F.array(*[F.lit(v) for v in values]), (F.col("p_partkey") % len(values)).cast("int"))
    folder = pick(["src", "docs", "build", ".git", "HR", "private", "Vendor"])
    ending = pick([".py", ".MD", ".pdf", ".jpeg", ".webm", ".rs", ".bin", "", ".tsx", ".txt", ".h"])
    return A.table(spark, sf_dir, "part").select("p_partkey", F.concat(folder, F.lit("/"), F.lower("p_type"), F.lit("/f"), F.col("p_partkey").cast("string"), ending).alias("path"))


@_query(
    "classify_files",
    f"""WITH {_PATHS}, s AS (SELECT *, lower(regexp_extract(path, '(\\.[^./]+)$', 1)) AS x FROM paths)
SELECT p_partkey, path, CASE WHEN x IN ('.py', '.rs', '.tsx', '.h') THEN 'code' WHEN x IN ('.md', '.txt') THEN 'document' WHEN x = '.pdf' THEN 'pdf' WHEN x = '.jpeg' THEN 'image' WHEN x = '.webm' THEN 'video' END AS modality,
  CASE x WHEN '.py' THEN 'python' WHEN '.rs' THEN 'rust' WHEN '.tsx' THEN 'tsx' WHEN '.h' THEN 'c' END AS language, CASE WHEN x = '.jpeg' THEN 'image/jpeg' ELSE 'image/png' END AS media_type FROM s""",
)
def classify_files(spark, sf_dir):
    path = F.col("path")
    return _paths(spark, sf_dir).select("p_partkey", "path", X.file_modality(path).alias("modality"), X.file_language(path).alias("language"), X.media_type(path).alias("media_type"))


@_query("noise_filter", f"WITH {_PATHS} SELECT p_partkey, path FROM paths WHERE NOT list_has_any(string_split(path, '/'), ['build', '.git', 'Vendor'])")
def noise_filter(spark, sf_dir):
    return _paths(spark, sf_dir).filter(~X.is_noise(F.col("path"), ("Vendor",)))


@_query(
    "security_decision",
    f"""WITH {_PATHS}, t AS (SELECT *, CASE WHEN p_partkey % 5 = 0 THEN 'password = "hunter22"' WHEN p_partkey % 5 = 1 THEN 'api_key: ''abcdefghijklmnop1''' WHEN p_partkey % 5 = 2 THEN '-----BEGIN RSA PRIVATE KEY-----' ELSE 'password = x' END AS text FROM paths),
d AS (SELECT *, list_has_any(string_split(lower(path), '/'), ['hr', 'private', 'vendor']) AS dir, p_partkey % 5 < 3 AND regexp_matches(path, '[.](py|txt)$') AS secret FROM t)
SELECT p_partkey, path, dir OR secret AS force_local, CASE WHEN dir THEN 'sensitive folder' WHEN secret THEN 'secret in content' ELSE 'no sign of sensitivity' END AS reason FROM d""",
)
def security_decision(spark, sf_dir):
    k = F.col("p_partkey") % 5
    text = F.when(k == 0, F.lit('password = "hunter22"')).when(k == 1, F.lit("api_key: 'abcdefghijklmnop1'")).when(k == 2, F.lit("-----BEGIN RSA PRIVATE KEY-----")).otherwise(F.lit("password = x"))
    decided = _paths(spark, sf_dir).withColumn("s", X.security(F.col("path"), text, ("Vendor",)))
    return decided.select("p_partkey", "path", "s.force_local", "s.reason")


@_query("file_order", f"WITH {_PATHS} SELECT p_partkey, row_number() OVER (ORDER BY string_split(path, '/')) AS place FROM paths")
def file_order(spark, sf_dir):
    """Places in the order of path parts."""
    parts = numbered(_paths(spark, sf_dir).withColumn("parts", F.split("path", "/")), "place", "parts")
    return parts.select("p_partkey", (F.col("place") + 1).alias("place"))


# building


@_query("collapse_edges", ", c AS (SELECT least(source, target) AS u, greatest(source, target) AS v, round(sum(CASE confidence WHEN 'EXTRACTED' THEN 1.0::DOUBLE WHEN 'INFERRED' THEN 0.6 ELSE 0.3 END), 6) AS weight FROM supply GROUP BY ALL) SELECT * FROM c", True)
def collapse_edges(spark, sf_dir):
    return graph.collapse_edges(A.supply_edges(spark, sf_dir)).select("u", "v", F.round("w", 6).alias("weight"))


@_query("edge_integrity", ", kept AS (SELECT * FROM nodes WHERE modality <> 'code') SELECT source, target, relation FROM edges WHERE source IN (SELECT id FROM kept) AND target IN (SELECT id FROM kept)", True)
def edge_integrity(spark, sf_dir):
    """Customers and suppliers have no nodes, so their edges dangle."""
    nodes = A.trade_nodes(spark, sf_dir).filter("modality <> 'code'")
    return graph.drop_dangling(A.trade_edges(spark, sf_dir), nodes).select("source", "target", "relation")


@_query(
    "collision_salt",
    """WITH n AS (SELECT 'part_' || p_size AS id, CASE WHEN p_size % 2 = 0 THEN 'a/' || p_brand ELSE 'one' END AS f FROM part), c AS (SELECT id FROM n GROUP BY id HAVING count(DISTINCT f) > 1)
SELECT n.id AS old_id, f AS source_file, CASE WHEN c.id IS NULL THEN n.id ELSE n.id || '_' || substr(sha1(f), 1, 6) END AS id, count(*) AS n_nodes FROM n LEFT JOIN c ON n.id = c.id GROUP BY ALL""",
)
def collision_salt(spark, sf_dir):
    file = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("a/"), "p_brand")).otherwise("one")
    old = F.concat(F.lit("part_"), F.col("p_size").cast("string"))
    nodes = A.table(spark, sf_dir, "part").select(old.alias("id"), file.alias("source_file"), old.alias("old_id"))
    none = spark.createDataFrame([], "source string, target string, source_file string")
    salted, _ = graph.resolve_collisions(nodes, none)
    return salted.groupBy("old_id", "source_file", "id").agg(F.count("*").alias("n_nodes"))


@_query("node_dedup_last", "SELECT 'cust_' || o_custkey AS id, arg_max(o_orderpriority, o_orderkey) AS label, min(o_orderkey) AS seq FROM orders GROUP BY o_custkey")
def node_dedup_last(spark, sf_dir):
    nodes = A.table(spark, sf_dir, "orders").select(F.concat(F.lit("cust_"), F.col("o_custkey").cast("string")).alias("id"), F.col("o_orderpriority").alias("label"), F.col("o_orderkey").alias("seq"))
    return graph.dedup_nodes(nodes)


_SYMBOLS = """s AS (SELECT 'n' || CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey // 6 ELSE o_orderkey END AS name, 'sym:' || o_orderkey AS id, o_orderkey AS seq FROM orders), u AS (SELECT name, min(id) AS id FROM s GROUP BY name HAVING count(*) = 1)"""


def _symbol_nodes(spark, sf_dir):
    """Every order as a symbol; a third of them share their names with others."""
    number = F.when(F.col("o_orderkey") % 3 == 0, F.floor(F.col("o_orderkey") / 6)).otherwise(F.col("o_orderkey"))
    return A.table(spark, sf_dir, "orders").select(F.concat(F.lit("sym:"), F.col("o_orderkey").cast("string")).alias("id"), F.concat(F.lit(".n"), number.cast("string"), F.lit("()")).alias("label"), F.lit("code").alias("modality"), F.lit("x/f.py").alias("source_file"), F.col("o_orderkey").alias("seq"))


@_query("resolve_calls_unique", f"WITH {_SYMBOLS} SELECT 'sym:' || l_orderkey AS source, u.id AS target, count(*) AS n_calls FROM lineitem JOIN u ON u.name = 'n' || (l_orderkey + 7) WHERE u.id <> 'sym:' || l_orderkey GROUP BY ALL")
def resolve_calls_unique(spark, sf_dir):
    rows = A.table(spark, sf_dir, "lineitem")
    calls = rows.select(F.concat(F.lit("sym:"), F.col("l_orderkey").cast("string")).alias("caller_id"), F.concat(F.lit("n"), (F.col("l_orderkey") + 7).cast("string")).alias("callee_name"), F.lit("x/f.py").alias("source_file"), F.lit("L1").alias("line"))
    return resolve.resolve_calls(calls, _symbol_nodes(spark, sf_dir)).groupBy("source", "target").agg(F.count("*").alias("n_calls"))


@_query(
    "resolve_imports_tiered",
    f"""WITH {_SYMBOLS}, i AS (SELECT c_custkey, 'file:' || c_custkey AS source, 'n' || 10 * c_custkey AS symbol, 'pkg.n' || 10 * c_custkey AS module FROM customer),
ns AS (SELECT 'pkg.n' || 30 * (s_suppkey - CASE WHEN s_suppkey % 5 = 0 THEN 1 ELSE 0 END) AS module, min('file:' || s_suppkey) AS id FROM supplier GROUP BY 1 HAVING count(*) = 1)
SELECT source, coalesce(u.id, ns.id) AS target, CASE WHEN u.id IS NOT NULL THEN 'cross_file_import' ELSE 'cross_file_import_namespace' END AS context
FROM i LEFT JOIN u ON u.name = i.symbol LEFT JOIN ns USING (module) WHERE coalesce(u.id, ns.id) IS NOT NULL AND coalesce(u.id, ns.id) <> source""",
)
def resolve_imports_tiered(spark, sf_dir):
    key = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    imports = A.table(spark, sf_dir, "customer").select(key("file:", F.col("c_custkey")).alias("source_id"), key("pkg.n", 10 * F.col("c_custkey")).alias("module"), F.lit("imports").alias("relation"), F.lit("x/g.py").alias("source_file"), F.lit("L1").alias("line"))
    spaces = A.table(spark, sf_dir, "supplier").select(key("pkg.n", 30 * (F.col("s_suppkey") - F.when(F.col("s_suppkey") % 5 == 0, 1).otherwise(0))).alias("namespace"), key("file:", F.col("s_suppkey")).alias("id"))
    return resolve.resolve_imports(imports, _symbol_nodes(spark, sf_dir), spaces).select("source", "target", "context")


@_query(
    "module_imports",
    "WITH m AS (SELECT 'mod.' || p_size AS module, arg_max('file:' || p_partkey, p_partkey) AS target FROM part GROUP BY 1) SELECT 'c:' || c_custkey AS source, target, target IS NULL AS open FROM customer LEFT JOIN m ON module = 'mod.' || c_custkey % 60",
)
def module_imports(spark, sf_dir):
    imports = A.table(spark, sf_dir, "customer").select(F.concat(F.lit("c:"), F.col("c_custkey").cast("string")).alias("source_id"), F.concat(F.lit("mod."), (F.col("c_custkey") % 60).cast("string")).alias("module"), F.lit("imports").alias("relation"), F.lit("f").alias("source_file"), F.lit("L1").alias("line"))
    modules = A.table(spark, sf_dir, "part").select(F.concat(F.lit("mod."), F.col("p_size").cast("string")).alias("module"), F.concat(F.lit("file:"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_partkey").alias("seq"))
    edges, left = resolve.module_imports(imports, modules)
    return edges.select("source", "target", F.lit(False).alias("open")).union(left.select(F.col("source_id"), F.lit(None).cast("string"), F.lit(True)))


@_query("symbols_last_wins", f"WITH {_SYMBOLS} SELECT name, arg_max(id, seq) AS id FROM s GROUP BY name")
def symbols_last_wins(spark, sf_dir):
    return resolve.symbols_last_wins(_symbol_nodes(spark, sf_dir)).select("name", "id")


@_query("normalized_first_wins", "SELECT trim(regexp_replace(lower(p_type || '_' || p_brand), '[^a-z0-9]+', '_', 'g'), '_') AS normalized, arg_min('p:' || p_partkey, p_partkey) AS id FROM part GROUP BY 1")
def normalized_first_wins(spark, sf_dir):
    name = F.when(F.col("p_partkey") % 2 == 0, F.concat("p_type", F.lit("-"), "p_brand")).otherwise(F.concat(F.lower("p_type"), F.lit("_"), F.lower("p_brand")))
    symbols = A.table(spark, sf_dir, "part").select(name.alias("name"), F.concat(F.lit("p:"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_partkey").alias("seq"))
    return resolve.normalized_first_wins(symbols)


# incremental

_TWO_BUILDS = """now AS (SELECT 'doc/' || doc_id AS rel_path, sha1(coalesce(text, '')) AS sha1 FROM documents),
cache AS (SELECT 'doc/' || doc_id AS rel_path, sha1(coalesce(text, '') || CASE WHEN l.quality = 1 THEN '' ELSE 'x' END) AS sha1 FROM documents d JOIN labels l USING (doc_id)
  UNION ALL SELECT 'bench/' || item_id, sha1(text) FROM benchmark)"""


def _two_builds(spark, sf_dir):
    """Now: the documents. Then: those with labels, another text where the quality is bad, and the benchmark's items."""
    row = lambda prefix, key, t: (F.concat(F.lit(prefix), F.col(key).cast("string")).alias("rel_path"), F.sha1(F.encode(t, "UTF-8")).alias("sha1"))
    docs = A.table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    known = docs.join(A.table(spark, sf_dir, "labels"), "doc_id").select(*row("doc/", "doc_id", F.concat("t", F.when(F.col("quality") == 1, "").otherwise("x"))))
    return docs.select(*row("doc/", "doc_id", F.col("t"))), known.union(A.table(spark, sf_dir, "benchmark").select(*row("bench/", "item_id", F.col("text"))))


@_query("status_diff", f"WITH {_TWO_BUILDS} SELECT rel_path, CASE WHEN c.sha1 IS NULL THEN 'new' WHEN n.sha1 IS NULL THEN 'deleted' WHEN c.sha1 = n.sha1 THEN 'unchanged' ELSE 'changed' END AS state FROM now n FULL JOIN cache c USING (rel_path)")
def status_diff(spark, sf_dir):
    return incremental.status(*_two_builds(spark, sf_dir))


@_query("status_summary", f"WITH {_TWO_BUILDS}, s AS (SELECT c.sha1 AS c, n.sha1 AS n FROM now n FULL JOIN cache c USING (rel_path)) SELECT count(*) FILTER (WHERE c IS NULL) AS new, count(*) FILTER (WHERE c <> n) AS changed, count(*) FILTER (WHERE c = n) AS unchanged, count(*) FILTER (WHERE n IS NULL) AS deleted, count(*) FILTER (WHERE c IS DISTINCT FROM n) > 0 AS needs_rebuild FROM s")
def status_summary(spark, sf_dir):
    return incremental.status_summary(incremental.status(*_two_builds(spark, sf_dir)))


@_query("cache_miss", f"WITH {_TWO_BUILDS} SELECT * FROM now n WHERE NOT EXISTS (SELECT 1 FROM cache c WHERE c.rel_path = n.rel_path AND c.sha1 = n.sha1)")
def cache_miss(spark, sf_dir):
    return incremental.misses(*_two_builds(spark, sf_dir))


@_query("cache_hit", f"WITH {_TWO_BUILDS} SELECT c.* FROM cache c JOIN now n USING (rel_path, sha1)")
def cache_hit(spark, sf_dir):
    return incremental.hits(*_two_builds(spark, sf_dir))


@_query("cache_prune", f"WITH {_TWO_BUILDS} SELECT * FROM cache WHERE rel_path IN (SELECT rel_path FROM now)")
def cache_prune(spark, sf_dir):
    now, cache = _two_builds(spark, sf_dir)
    return incremental.pruned(cache, now)


@_query("cache_update", f"WITH {_TWO_BUILDS} SELECT rel_path, sha1 FROM cache JOIN now USING (rel_path, sha1) UNION ALL SELECT n.rel_path, n.sha1 FROM now n LEFT JOIN cache c USING (rel_path, sha1) WHERE c.sha1 IS NULL AND ascii(n.sha1) < 56 AND NOT EXISTS (SELECT 1 FROM cache c JOIN now m USING (rel_path, sha1) WHERE c.rel_path = n.rel_path)")
def cache_update(spark, sf_dir):
    now, cache = _two_builds(spark, sf_dir)
    fresh = incremental.misses(now, cache).withColumn("incomplete", F.ascii("sha1") >= 56)
    return incremental.updated(cache, now, fresh)


# documents and concepts


def _markdown(spark, sf_dir):
    """documents as Markdown: every line a heading of level 1 to 4 by its number, every tenth word between backticks."""
    return A.table(spark, sf_dir, "documents").select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("lines"))


@_query(
    "heading_tree",
    """WITH l AS (SELECT doc_id, unnest(t) AS title, generate_subscripts(t, 1) AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS t FROM documents)),
h AS (SELECT doc_id, pos, pos * 7 % 4 + 1 AS level FROM l WHERE trim(title) <> '')
SELECT doc_id, pos::INTEGER AS pos, level::INTEGER AS level, coalesce((SELECT max(p.pos) FROM h p WHERE p.doc_id = h.doc_id AND p.pos < h.pos AND p.level < h.level), 0)::INTEGER AS parent FROM h""",
)
def heading_tree(spark, sf_dir):
    """Each heading's parent: the nearest one before it of a smaller level, by running maxima for each level."""
    from pyspark.sql import Window

    lines = _markdown(spark, sf_dir).select("doc_id", F.posexplode("lines").alias("p", "title")).filter(F.trim("title") != "")
    rows = lines.select("doc_id", (F.col("p") + 1).alias("pos"), ((F.col("p") + 1) * 7 % 4 + 1).alias("level"))
    before = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    last = [F.max(F.when(F.col("level") == k, F.col("pos"))).over(before) for k in range(1, 6)]
    parent = F.coalesce(F.greatest(*[F.when(F.col("level") > k + 1, p) for k, p in enumerate(last)]), F.lit(0))
    return rows.select("doc_id", "pos", "level", parent.alias("parent"))


@_query("document_headings", r"SELECT doc_id, len(regexp_extract_all(replace(coalesce(text, ''), chr(10), chr(10) || '## '), '(?m)^## [^\n]+$'))::BIGINT AS n_headings FROM documents")
def document_headings(spark, sf_dir):
    text = F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("\n## "))
    return A.table(spark, sf_dir, "documents").select("doc_id", F.size(X.headings(text)).cast("long").alias("n_headings"))


@_query(
    "backtick_mentions",
    """WITH m AS (SELECT e.event_id, n.name, n.pos FROM events e, LATERAL (VALUES ('NATION_' || e.user_id % 40, 1), (e.event_type, 2), ('NATION_' || e.event_id % 30, 3)) n(name, pos)),
s AS (SELECT n_name AS name, 'nation:' || n_nationkey AS target FROM nation) SELECT 'e:' || event_id AS source, target, 'L' || min(pos) AS source_location FROM m JOIN s USING (name) GROUP BY event_id, target""",
)
def backtick_mentions(spark, sf_dir):
    key = lambda c: F.col(c).cast("string")
    text = F.concat(F.lit("see `NATION_"), (F.col("user_id") % 40).cast("string"), F.lit("`\nand `"), "event_type", F.lit("`\nthen `NATION_"), (F.col("event_id") % 30).cast("string"), F.lit("`"))
    events = A.table(spark, sf_dir, "events").select(key("event_id").alias("rel_path"), F.concat(F.lit("e:"), key("event_id")).alias("file_id"), F.posexplode(F.split(text, "\n")).alias("pos", "line_text"))
    mentions = events.select("rel_path", "file_id", (F.col("pos") + 1).cast("string").alias("line"), "pos", F.explode(X.backticks(F.col("line_text"))).alias("name"))
    symbols = A.table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.concat(F.lit("nation:"), key("n_nationkey")).alias("id"))
    return concepts.backtick_mentions(mentions, symbols).select("source", "target", "source_location")


_CONCEPTS = """c AS (SELECT 'c:' || p_partkey AS concept_id, 'about ' || p_type || ' and NATION_' || p_partkey % 40 || ' region ' || ['AFRICA', 'asia', 'Europe', 'MiddleEast'][1 + p_partkey % 4] AS name, p_partkey FROM part),
w AS (SELECT DISTINCT concept_id, unnest(regexp_extract_all(name, '[A-Za-z_][A-Za-z0-9_]*')) AS word FROM c),
s AS (SELECT n_name AS name, 'nation:' || n_nationkey AS id, n_nationkey::BIGINT AS seq FROM nation UNION ALL SELECT r_name, 'region:' || r_regionkey, 100 + r_regionkey FROM region)"""


def _concepts(spark, sf_dir):
    pick = F.get(F.array(*[F.lit(x) for x in ("AFRICA", "asia", "Europe", "MiddleEast")]), (F.col("p_partkey") % 4).cast("int"))
    name = F.concat(F.lit("about "), "p_type", F.lit(" and NATION_"), (F.col("p_partkey") % 40).cast("string"), F.lit(" region "), pick)
    found = A.table(spark, sf_dir, "part").select((F.col("p_partkey") % 97).cast("string").alias("rel_path"), F.concat(F.lit("c:"), F.col("p_partkey").cast("string")).alias("concept_id"), name.alias("name"), F.col("p_partkey").alias("pos"))
    nation = A.table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_nationkey").cast("long").alias("seq"))
    region = A.table(spark, sf_dir, "region").select("r_name", F.concat(F.lit("region:"), F.col("r_regionkey").cast("string")), (F.lit(100) + F.col("r_regionkey")).cast("long"))
    return found, nation.union(region)


@_query("concept_exact", f"WITH {_CONCEPTS} SELECT DISTINCT concept_id, s.id AS target FROM w JOIN s ON s.name = w.word")
def concept_exact(spark, sf_dir):
    return concepts.exact_matches(*_concepts(spark, sf_dir))


@_query("concept_normalized", rf"WITH {_CONCEPTS}, n AS (SELECT trim(regexp_replace(lower(regexp_replace(name, '([a-z0-9])([A-Z])', '\1_\2', 'g')), '[^a-z0-9]+', '_', 'g'), '_') AS k, arg_min(id, seq) AS id FROM s GROUP BY 1) SELECT DISTINCT concept_id, n.id AS target FROM w JOIN n ON k = trim(regexp_replace(lower(regexp_replace(word, '([a-z0-9])([A-Z])', '\1_\2', 'g')), '[^a-z0-9]+', '_', 'g'), '_')")
def concept_normalized(spark, sf_dir):
    return concepts.normalized_matches(*_concepts(spark, sf_dir))


@_query("concept_tiers")
def concept_tiers(spark, sf_dir):
    """All tiers in turn, a reference for each file and target at most; order decides, so SQL can't."""
    found, symbols = _concepts(spark, sf_dir)
    none = spark.createDataFrame([], "rel_path string, target string")
    return concepts.link_concepts(found, symbols, none).select("source", "target", "confidence", "context")


@_query("relation_endpoints", f"WITH {_CONCEPTS}, r AS (SELECT p_partkey, 'NATION_' || p_partkey % 50 AS a, name AS b, p_partkey % 97 AS f FROM c) SELECT s.id AS source, c.concept_id AS target FROM r JOIN s ON s.name = r.a JOIN (SELECT p_partkey % 97 AS f, name, arg_max(concept_id, p_partkey) AS concept_id FROM c GROUP BY ALL) c ON c.name = r.b AND c.f = r.f")
def relation_endpoints(spark, sf_dir):
    found, symbols = _concepts(spark, sf_dir)
    rows = found.select("rel_path", F.concat(F.lit("NATION_"), (F.col("pos") % 50).cast("string")).alias("source_name"), F.col("name").alias("target_name"), F.lit("near").alias("relation"))
    return concepts.relation_edges(rows, found, symbols).select("source", "target")


@_query("page_links", r"""SELECT page_id, len(list_distinct(regexp_extract_all(coalesce(html, ''), 'href="([^"]+)"', 1)))::BIGINT AS n_targets, nullif(trim(regexp_extract(coalesce(html, ''), '(?s)<h1[^>]*>([^<]*)', 1)), '') AS title FROM pages""")
def page_links(spark, sf_dir):
    html = F.coalesce("html", F.lit(""))
    links = F.array_distinct(F.regexp_extract_all(html, F.lit('href="([^"]+)"'), F.lit(1)))
    return A.table(spark, sf_dir, "pages").select("page_id", F.size(links).cast("long").alias("n_targets"), F.nullif(F.trim(F.regexp_extract(html, "(?s)<h1[^>]*>([^<]*)", 1)), F.lit("")).alias("title"))


# ranking

_SEEDS = "seeds AS (SELECT id FROM nodes WHERE label IN ('How', 'do', 'NATION_3', 'NATION_7', 'and', 'the', 'region', 'ASIA', 'hang', 'together'))"
_BOTH = "sym AS (SELECT u, v, w FROM links UNION ALL SELECT v, u, w FROM links WHERE u <> v)"
_SCOPE = "scope AS (SELECT id FROM seeds UNION SELECT v FROM scope JOIN sym ON u = id)"


def _trade(spark, sf_dir):
    nodes = A.trade_nodes(spark, sf_dir)
    links = stored(graph.collapse_edges(A.trade_edges(spark, sf_dir)), "links")
    return nodes, links, stored(traverse.exact_seeds(nodes, traverse.question_words(spark, A.QUESTION)), "seeds")


@_query("seed_exact", f", {_SEEDS} SELECT id FROM seeds", True)
def seed_exact(spark, sf_dir):
    return traverse.exact_seeds(A.trade_nodes(spark, sf_dir), traverse.question_words(spark, A.QUESTION))


#: NATINO_12 and NATION_12 match in 8 of 9 letters (0.889), EUROP and EUROPE in 5 (0.909), AFRIKA and AFRICA in 5 of 6 (0.833).
@_query("seed_fuzzy", " SELECT max_by(id, seq) AS id FROM nodes WHERE label IN ('NATION_12', 'EUROPE') GROUP BY label", True)
def seed_fuzzy(spark, sf_dir):
    """A question of misspelt names."""
    return traverse.seeds(A.trade_nodes(spark, sf_dir), traverse.question_words(spark, "what of NATINO_12 in AFRIKA or EUROP"))


#: A name is a symbol with one letter more, so all of the symbol matches, which no other symbol can better.
@_query("fuzzy_symbols", "SELECT lower(p_type || '_' || p_brand) || 's' AS name, p_type || '_' || p_brand AS symbol, round(2.0 * n / (2 * n + 1), 9) AS ratio FROM (SELECT DISTINCT p_type, p_brand, length(p_type || '_' || p_brand) AS n FROM part)")
def fuzzy_symbols(spark, sf_dir):
    names = A.table(spark, sf_dir, "part").select(F.concat(F.lower("p_type"), F.lit("_"), F.lower("p_brand"), F.lit("s")).alias("name"))
    symbols = A.table(spark, sf_dir, "part").groupBy(F.concat("p_type", F.lit("_"), "p_brand").alias("name")).agg(F.min("p_partkey").alias("seq")).select("name", F.col("seq").cast("string").alias("id"), "seq")
    return fuzzy.best_symbols(names, symbols).select("name", "symbol", F.round("ratio", 9).alias("ratio"))


@_query("component_scope", f", {_SEEDS}, {_BOTH}, {_SCOPE} SELECT id FROM scope", True)
def component_scope(spark, sf_dir):
    _, links, seeds = _trade(spark, sf_dir)
    return traverse.component_scope(links, seeds)


#: Smallest ids spread by one link a round; no two ids of the trade graph are further apart than six links.
_SPREAD = 8
_COMPONENTS = ", ".join(
    [
        f", {_BOTH}, e AS MATERIALIZED (SELECT u, v FROM sym UNION SELECT u, u FROM sym), c0 AS (SELECT DISTINCT u AS id, u AS component FROM sym)",
        *[f"c{k + 1} AS MATERIALIZED (SELECT u AS id, min(component) AS component FROM e JOIN c{k} ON id = v GROUP BY u)" for k in range(_SPREAD)],
    ]
) + f" SELECT id, component FROM c{_SPREAD}"


def _links(spark, sf_dir):
    return stored(graph.collapse_edges(A.trade_edges(spark, sf_dir)), "links")


@_query("connected_components", _COMPONENTS, True)
def connected_components(spark, sf_dir):
    return traverse.ranked_components(_links(spark, sf_dir))


@_query("connected_components_distributed", _COMPONENTS, True)
def connected_components_distributed(spark, sf_dir):
    """The path beyond one task's size."""
    return traverse.ranked_components(_links(spark, sf_dir), 0)


@_query("component_scope_distributed", f", {_SEEDS}, {_BOTH}, {_SCOPE} SELECT id FROM scope", True)
def component_scope_distributed(spark, sf_dir):
    _, links, seeds = _trade(spark, sf_dir)
    return traverse.component_scope(links, seeds, one_task=0)


def _pagerank_sql(last: str) -> str:
    parts = [f", {_SEEDS}, {_BOTH}, {_SCOPE}", "o AS (SELECT u, sum(w) AS total FROM sym GROUP BY u)", "t AS (SELECT id, CASE WHEN id IN (SELECT id FROM seeds) THEN 1.0::DOUBLE / (SELECT count(*) FROM seeds) ELSE 0 END AS t FROM scope)"]
    parts += ["p AS MATERIALIZED (SELECT s.u, s.v, s.w / o.total AS p FROM sym s JOIN o USING (u) WHERE s.u IN (SELECT id FROM scope))", "x0 AS MATERIALIZED (SELECT id, t, 1.0::DOUBLE / (SELECT count(*) FROM scope) AS x FROM t)"]
    for k in range(ROUNDS):
        parts.append(f"x{k + 1} AS MATERIALIZED (SELECT id, t, 0.85::DOUBLE * coalesce(got, 0) + 0.15::DOUBLE * t AS x FROM x{k} LEFT JOIN (SELECT v, sum(p * x) AS got FROM p JOIN x{k} ON id = u GROUP BY v) ON v = id)")
    top = f"b AS (SELECT id, x FROM x{ROUNDS} ORDER BY round(x, 10) DESC, id), best AS (SELECT id, x FROM b WHERE id IN (SELECT id FROM seeds) UNION ALL (SELECT id, x FROM b WHERE id NOT IN (SELECT id FROM seeds) ORDER BY round(x, 10) DESC, id LIMIT greatest(0, {traverse.TOP_K} - (SELECT count(*) FROM seeds))))"
    return ", ".join([*parts, top]) + " " + last


def _ranked(spark, sf_dir, one_task=traverse.ONE_TASK_LINKS):
    nodes, links, seeds = _trade(spark, sf_dir)
    scope = traverse.component_scope(links, seeds)
    inside = links.join(scope.select(F.col("id").alias("u")), "u", "left_semi")
    return nodes, seeds, traverse.pagerank(inside, scope, seeds, ROUNDS, 0.0, one_task)


@_query("ppr_scores", _pagerank_sql(f"SELECT id, round(x, 10) AS score FROM x{ROUNDS}"), True)
def ppr_scores(spark, sf_dir):
    return _ranked(spark, sf_dir)[2].select("id", F.round("score", 10).alias("score"))


@_query("ppr_scores_distributed", _pagerank_sql(f"SELECT id, round(x, 10) AS score FROM x{ROUNDS}"), True)
def ppr_scores_distributed(spark, sf_dir):
    """The path for scopes beyond one task's size."""
    return _ranked(spark, sf_dir, 0)[2].select("id", F.round("score", 10).alias("score"))


@_query("ppr_topk_pinned", _pagerank_sql("SELECT id, round(x, 5) AS ppr_score FROM best"), True)
def ppr_topk_pinned(spark, sf_dir):
    _, seeds, scores = _ranked(spark, sf_dir)
    return traverse.top_k_pinned(stored(scores, "scores"), seeds).select("id", F.round("score", 5).alias("ppr_score"))


@_query("induced_subgraph", _pagerank_sql("SELECT source, target, relation FROM edges WHERE source IN (SELECT id FROM best) AND target IN (SELECT id FROM best)"), True)
def induced_subgraph(spark, sf_dir):
    _, seeds, scores = _ranked(spark, sf_dir)
    best = stored(traverse.top_k_pinned(stored(scores, "scores"), seeds), "best")
    return traverse.induced_edges(A.trade_edges(spark, sf_dir), best).select("source", "target", "relation")


@_query("ask_question")
def ask_question(spark, sf_dir):
    """The whole query path until convergence, whose number of rounds SQL can't follow."""
    return flagship(spark, sf_dir)


@_query("context_sentences", " SELECT e.source_file, e.seq, coalesce(a.modality, 'code') = 'code' AND coalesce(b.modality, 'code') = 'code' AS is_code, coalesce(a.label, e.source) || ' —' || relation || '—> ' || coalesce(b.label, e.target) AS line FROM edges e LEFT JOIN (SELECT * FROM nodes WHERE modality <> 'concept') a ON a.id = e.source LEFT JOIN (SELECT * FROM nodes WHERE modality <> 'concept') b ON b.id = e.target", True)
def context_sentences(spark, sf_dir):
    """Regions and nations have no nodes: their ids stand in for labels, and they count as code."""
    nodes = A.trade_nodes(spark, sf_dir).filter("modality <> 'concept'")
    return traverse.fact_lines(nodes, A.trade_edges(spark, sf_dir)).select("source_file", "seq", "is_code", "line")


@_query("context_by_source", ", f AS (SELECT CASE WHEN a.modality = 'code' AND b.modality = 'code' THEN '' ELSE t.source_file END AS section, t.seq, a.label || ' —' || relation || '—> ' || b.label AS line FROM edges t JOIN nodes a ON a.id = source JOIN nodes b ON b.id = target) SELECT section, count(*) AS n_facts, string_agg(line, chr(10) ORDER BY seq, line) AS body FROM f GROUP BY section", True)
def context_by_source(spark, sf_dir):
    return traverse.context_sections(traverse.fact_lines(A.trade_nodes(spark, sf_dir), A.trade_edges(spark, sf_dir)))


@_query("fallback_answers", "WITH t AS (SELECT doc_id, trim(coalesce(text, '')) AS t, substr(trim(coalesce(text, '')), 1, 800) AS h FROM documents) SELECT doc_id, CASE WHEN t = '' THEN 'Nothing in the graph bears on this question.' ELSE 'From the graph (no provider):' || chr(10) || chr(10) || CASE WHEN length(t) > 800 THEN CASE WHEN contains(h, chr(10)) THEN regexp_replace(h, '\\n[^\\n]*$', '') ELSE h END || chr(10) || '[...]' ELSE t END END AS answer FROM t")
def fallback_answers(spark, sf_dir):
    return A.table(spark, sf_dir, "documents").select("doc_id", X.fallback_answer(F.coalesce("text", F.lit(""))).alias("answer"))


# degrees and communities


@_query("degree_top5", ", d AS (SELECT id, count(*) AS degree FROM (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges) GROUP BY id) SELECT n.id, label, coalesce(degree, 0) AS degree FROM nodes n LEFT JOIN d USING (id) ORDER BY degree DESC, seq LIMIT 5", True)
def degree_top5(spark, sf_dir):
    return graph.top_degrees(A.trade_nodes(spark, sf_dir), A.trade_edges(spark, sf_dir))


@_query("degree_undirected", ", both_ways AS (SELECT source, target, seq FROM supply UNION ALL SELECT target, source, seq FROM supply WHERE confidence = 'INFERRED'), k AS (SELECT source, target, row_number() OVER (PARTITION BY source, target ORDER BY seq) AS key FROM both_ways), o AS (SELECT DISTINCT least(source, target) AS a, greatest(source, target) AS b, key FROM k) SELECT id, count(*) AS degree FROM (SELECT a AS id FROM o UNION ALL SELECT b FROM o) GROUP BY id", True)
def degree_undirected(spark, sf_dir):
    """Inferred edges also run back."""
    one = A.supply_edges(spark, sf_dir)
    back = one.filter("confidence = 'INFERRED'").select(F.col("target").alias("source"), F.col("source").alias("target"), "seq")
    return graph.undirected_degrees(one.select("source", "target", "seq").union(back))


@_query("modality_hist", " SELECT modality, count(*) AS n_nodes FROM nodes GROUP BY modality", True)
def modality_hist(spark, sf_dir):
    return graph.modality_counts(A.trade_nodes(spark, sf_dir))


_GROUPS = ", g AS (SELECT n.*, CASE WHEN starts_with(id, 'customer') THEN seq % 7 WHEN starts_with(id, 'nation') THEN seq % 3 END AS community FROM nodes n), d AS (SELECT id, count(*) AS degree FROM (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges) GROUP BY id), r AS (SELECT coalesce(community, 0) AS community, label, row_number() OVER (PARTITION BY coalesce(community, 0) ORDER BY coalesce(degree, 0) DESC, seq) AS place FROM g LEFT JOIN d USING (id))"


def _grouped(spark, sf_dir):
    number = F.when(F.startswith("id", F.lit("customer")), F.col("seq") % 7).when(F.startswith("id", F.lit("nation")), F.col("seq") % 3)
    return A.trade_nodes(spark, sf_dir).withColumn("community", number)


@_query("community_reps", _GROUPS + " SELECT community, max(label) FILTER (WHERE place = 1) AS label, count(*) AS n_members, array_to_string(list(label ORDER BY place) FILTER (WHERE place <= 8), '|') AS top_labels FROM r GROUP BY community", True)
def community_reps(spark, sf_dir):
    done = community.representatives(_grouped(spark, sf_dir), A.trade_edges(spark, sf_dir))
    return done.select("community", "label", "n_members", F.array_join("top_labels", "|").alias("top_labels"))


@_query("community_palette", _GROUPS + f", c AS (SELECT DISTINCT community FROM r) SELECT community, {list(community.PALETTE)}[1 + (row_number() OVER (ORDER BY community) - 1) % {len(community.PALETTE)}] AS color FROM c", True)
def community_palette(spark, sf_dir):
    return community.representatives(_grouped(spark, sf_dir), A.trade_edges(spark, sf_dir)).select("community", "color")


@_query("community_sizes", _GROUPS + " SELECT community, count(*) AS n_members FROM r GROUP BY community", True)
def community_sizes(spark, sf_dir):
    return _grouped(spark, sf_dir).groupBy(F.coalesce("community", F.lit(0)).cast("long").alias("community")).agg(F.count("*").alias("n_members"))


@_query("warm_start_membership", "WITH p AS (SELECT 'c' || c_custkey AS id, c_custkey % 13 AS community FROM customer WHERE c_mktsegment <> 'BUILDING'), n AS (SELECT 'c' || c_custkey AS id FROM customer WHERE c_mktsegment = 'BUILDING') SELECT id, community AS start FROM p UNION ALL SELECT id, (SELECT max(community) FROM p) + row_number() OVER (ORDER BY id) FROM n")
def warm_start_membership(spark, sf_dir):
    customers = A.table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), "c_custkey", "c_mktsegment")
    return community.initial_membership(customers.select("id"), customers.filter("c_mktsegment <> 'BUILDING'").select("id", (F.col("c_custkey") % 13).alias("community")))


@_query("communities_two_levels")
def communities_two_levels(spark, sf_dir):
    """Partitions by local moving depend on the order of moves; tests hold their properties."""
    nodes, edges = A.trade_nodes(spark, sf_dir), A.trade_edges(spark, sf_dir)
    return community.cluster(nodes, edges).select("id", "community", "community_group")


@_query("communities_distributed", " SELECT count(*) AS n_nodes, 0::BIGINT AS n_without, 0::BIGINT AS n_in_two, 0::BIGINT AS n_torn, true AS as_good FROM nodes", True)
def communities_distributed(spark, sf_dir):
    """The levels of DataFrames that large components take, held to what any right answer has: every node in one community, none torn apart, and a quality within 1 % of the sequential form's."""
    nodes, links = A.trade_nodes(spark, sf_dir), stored(graph.collapse_edges(A.trade_edges(spark, sf_dir)), "links")
    have = community.Links(nodes, links, one_task=1_000)
    # up to what one task takes, the other form has nothing in common with the levels
    other = have if have.n > community.ONE_TASK_LINKS else community.Links(nodes, links)
    found, whole = community.without_leaves(have, community.FINE, one_task=1_000), community.without_leaves(other, community.FINE)
    found, whole, no = found.withColumnRenamed("community", "levels"), whole.withColumnRenamed("community", "one_task"), F.lit(None).cast("long")
    both = have.whole(found.join(whole, "id", "full")) if other is have else have.whole(found).withColumn("one_task", no).union(other.whole(whole).select("id", no, "one_task"))
    rows = nodes.select("id", F.lit(True).alias("node"), no.alias("levels"), no.alias("one_task")).union(both.select("id", F.lit(False), "levels", "one_task"))
    per_id = stored(rows.groupBy("id").agg(F.max("node").alias("node"), F.count("levels").alias("n"), F.max("levels").alias("levels"), F.max("one_task").alias("one_task")), "per_id")
    a, b = (per_id.select(F.col("id").alias(e), F.col("levels").alias(f"c{e}"), F.col("one_task").alias(f"o{e}")) for e in ("u", "v"))
    placed = stored(have.links().join(a, "u").join(b, "v"), "placed")
    sums = stored(placed.groupBy("cu", "cv", "ou", "ov").agg(F.sum("w").alias("w")), "sums")
    good = community.quality(sums.select("cu", "cv", "w"), community.FINE) >= 0.99 * community.quality(sums.select(F.col("ou").alias("cu"), F.col("ov").alias("cv"), "w"), community.FINE)
    torn = community.torn(per_id.filter("n > 0").withColumnRenamed("levels", "community"), placed)
    total = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0).cast("long"))
    counts = per_id.filter("node").agg(F.count("*").alias("n_nodes"), total(F.col("n") == 0).alias("n_without"), total(F.col("n") > 1).alias("n_in_two"))
    return counts.withColumns({"n_torn": F.lit(torn.count()).cast("long"), "as_good": F.lit(bool(good))})


# files in tables


#: A small file of each language around a part's name, written NAME, and how many rows of each kind it has.
_SOURCES = [
    ("python", ".py", "import os\nclass NAME:\n    def size(self):\n        return helper(self)\n"),
    ("javascript", ".js", "import rig from 'rig';\nclass NAME {\n  size(a) { return helper(new Other(a)); }\n}\n"),
    ("typescript", ".ts", "import { rig } from 'rig';\nclass NAME<T> {\n  size(a: T): number { return helper<T>(a); }\n}\n"),
    ("tsx", ".tsx", "import rig from 'rig';\nclass NAME {\n  size() { return <b>{helper(1)} isn't f</b>; }\n}\n"),
    ("java", ".java", "import com.x.Helper;\npublic class NAME {\n  public NAME(int a) { super(a); }\n  public int size(int a) { return Helper.helper(a); }\n}\n"),
    ("c", ".c", "#include <stdio.h>\nint helper(int a);\nint size_NAME(int a)\n{\n  return helper(a); /* f() */\n}\n"),
    ("cpp", ".cpp", "#include <vector>\nclass NAME {\n  int later(int a);\n  int size(int a) { return helper(a); }\n};\n"),
    ("csharp", ".cs", "using System.Linq;\nnamespace Sea.Parts {\n  class NAME {\n    int Size(int a) => Helper(a);\n  }\n}\n"),
    ("go", ".go", "package main\nimport \"fmt\"\ntype NAME struct { N int }\nfunc (p *NAME) Size() int { return helper(p.N) }\n"),
    ("rust", ".rs", "use std::fmt::Debug;\nstruct NAME { n: i32 }\nimpl NAME { fn size(&self) -> i32 { helper(self.n) } }\n"),
    ("php", ".php", "<?php\nuse Sea\\Helper;\nclass NAME {\n  function size($a) { return helper(new Other($a)); }\n}\n"),
    ("kotlin", ".kt", "import sea.Helper\nclass NAME(val a: Int) {\n  fun size() = helper(\"${a} f()\")\n}\n"),
    ("swift", ".swift", "import Foundation\nclass NAME {\n  func size() -> Int { return helper(1) }\n}\n"),
    ("dart", ".dart", "import 'dart:math';\nclass NAME {\n  NAME(this.a);\n  int size(int a) => helper(a);\n}\n"),
    ("sql", ".sql", "create function size_NAME(a integer) returns integer as $$ select helper(a); $$ language sql;\n"),
    ("scala", ".scala", "import scala.util.Try\nclass NAME(a: Int) {\n  def size = helper(a)\n}\n"),
    ("powershell", ".ps1", "Import-Module Rig\nclass NAME {\n  [int] Size([int]$a) { Helper $a; return $a }\n}\n"),
]
#: C and SQL have no class here, SQL no import; C# has a namespace.
_COUNTS = {lang: {"node": 2 if lang in ("c", "sql") else 3, "edge": 1 if lang in ("c", "sql") else 2, "call": 1, "import": int(lang != "sql"), "namespace": int(lang == "csharp")} for lang, *_ in _SOURCES}
_EXPECTED = ", ".join(f"({k}, '{ext}', '{kind}', {n})" for k, (lang, ext, _) in enumerate(_SOURCES) for kind, n in _COUNTS[lang].items() if n)


@_query("code_facts", f"SELECT 'src/P' || p_partkey || ext AS rel_path, kind, n_rows::BIGINT AS n_rows FROM part JOIN (VALUES {_EXPECTED}) AS e(k, ext, kind, n_rows) ON p_partkey % {len(_SOURCES)} = k")
def code_facts(spark, sf_dir):
    """A small source file for each part in one of the 17 languages, read by its scanner."""
    name = F.concat(F.lit("P"), F.col("p_partkey").cast("string"))
    pick = lambda k: F.get(F.array(*[F.lit(x[k]) for x in _SOURCES]), (F.col("p_partkey") % len(_SOURCES)).cast("int"))
    content = F.encode(F.replace(pick(2), F.lit("NAME"), name), "UTF-8").alias("content")
    # a part is a few bytes in its table and a file to read here: keys are dealt to all tasks before they become files
    parts = A.table(spark, sf_dir, "part").select("p_partkey").repartition(FILE_TASKS, "p_partkey")
    files = parts.select(F.concat(F.lit("src/"), name, pick(1)).alias("rel_path"), F.lit("code").alias("modality"), pick(0).alias("language"), content)
    return extract.extract(files).groupBy("rel_path", "kind").agg(F.count("*").alias("n_rows"))


@_query("document_facts", "WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS t FROM documents) SELECT doc_id::VARCHAR AS rel_path, 1 + len(list_filter(t, lambda x: trim(x) <> '')) AS n_nodes, len(list_filter(t, lambda x: trim(x) <> '')) AS n_edges FROM l")
def document_facts(spark, sf_dir):
    """Every line that isn't blank as a heading."""
    marked = F.transform("lines", lambda x: F.when(F.trim(x) != "", F.concat(F.lit("## "), F.trim(x))).otherwise(F.lit("")))
    files = _markdown(spark, sf_dir).select(F.col("doc_id").cast("string").alias("rel_path"), F.lit("document").alias("modality"), F.lit(None).cast("string").alias("language"), F.encode(F.array_join(marked, "\n"), "UTF-8").alias("content"))
    count = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, 1)), F.lit(0)).cast("long")
    return extract.extract(files).groupBy("rel_path").agg(count("node").alias("n_nodes"), count("edge").alias("n_edges"))


@_query("stream_windowed_links", "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS window_start, 'user:' || user_id AS source, 'event:' || event_type AS target, count(*) AS n_events, round(sum(value), 6) AS weight FROM events GROUP BY ALL")
def stream_windowed_links(spark, sf_dir):
    """The events table as a stream, in complete windows: an extension to the reference's batch commands."""
    from skein.shared import shared_path

    stream = ingest.read_events(spark, f"{sf_dir}/events*.parquet", A.table(spark, sf_dir, "events").schema)
    out = shared_path(spark, "stream")
    sums = ingest.windowed_links(stream, late="10000 days").select(F.date_format("window_start", "yyyy-MM-dd").alias("window_start"), "source", "target", "n_events", F.round("weight", 6).alias("weight"))
    ingest.run_once(sums, out)
    return spark.read.parquet(out)
