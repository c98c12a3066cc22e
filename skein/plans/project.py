"""The five commands: build, cluster, query, status, init-config."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein import schemas
from skein.functions import text as X
from skein.operators import community, concepts, graph, incremental, relink, resolve, traverse
from skein.shared import stored
from skein.sinks import export
from skein.sources import extract, providers, settings
from skein.sources.files import read_files

log = logging.getLogger("skein")
_CACHE = "rel_path string, sha1 string, provider string"


def _cached(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame]:
    """(files, facts) of the last build; empty where there are none."""
    if export.exists(spark, f"{out}/cache/facts"):
        return spark.read.parquet(f"{out}/cache/files"), spark.read.parquet(f"{out}/cache/facts")
    return spark.createDataFrame([], _CACHE), spark.createDataFrame([], schemas.FACTS)


def _store_cache(spark: SparkSession, out: str, files: DataFrame, facts: DataFrame, links: DataFrame) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = lambda name: jvm.org.apache.hadoop.fs.Path(name)
    files.write.mode("overwrite").parquet(f"{out}/cache.new/files")
    facts.write.mode("overwrite").parquet(f"{out}/cache.new/facts")
    links.write.mode("overwrite").parquet(f"{out}/cache.new/links")
    fs = path(out).getFileSystem(conf)
    fs.delete(path(f"{out}/cache"), True)
    fs.rename(path(f"{out}/cache.new"), path(f"{out}/cache"))


def _open(nodes: DataFrame) -> DataFrame:
    """Nodes of files that any provider may see."""
    return nodes.filter(~F.coalesce("force_local", F.lit(False))) if "force_local" in nodes.columns else nodes


def assemble(files: DataFrame, facts: DataFrame, provider=None, link=relink.resolved) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges from all files' facts. ``link`` makes the links between files from calls, imports, code nodes and namespaces."""
    parts = extract.split_facts(facts, files.select("rel_path", "file_seq"))
    nodes = parts["nodes"]
    if "force_local" in files.columns:  # what must not leave the machine is known of each node from here on
        nodes = nodes.join(files.select(F.col("rel_path").alias("source_file"), "force_local"), "source_file", "left").select(*parts["nodes"].columns, "force_local")
    code = nodes.filter("modality = 'code'")
    symbols = stored(resolve.symbols_last_wins(code), "symbols")
    modules = files.filter("modality = 'code'").select(X.module_path(F.col("rel_path")).alias("module"), X.make_id(F.col("rel_path")).alias("id"), F.col("file_seq").alias("seq"))
    by_module, open_imports = resolve.module_imports(parts["imports"], modules)
    made = [
        by_module,
        link(parts["calls"], open_imports, code, parts["namespaces"]).drop(*relink.KEYS),
        concepts.backtick_mentions(parts["mentions"], symbols),
    ]
    described = made[-1].select(F.col("source_file").alias("rel_path"), "target")
    named = parts["concepts"].join(files.select("rel_path", F.col("modality").alias("of")), "rel_path")
    linker = None
    if provider is not None:
        shown = resolve.symbol_rows(_open(code)).select("name").distinct().orderBy("name").limit(providers.CANDIDATES).collect()
        linker = providers.Linker(provider, [r["name"] for r in shown])
    for prefix, kinds in (("semantic", ("document",)), ("vision", ("image",))):
        own = named.filter(F.col("of").isin(*kinds)).drop("of")
        made.append(concepts.link_concepts(own, symbols, described, prefix, linker))
    frames = named.filter("of = 'video'").join(symbols.select("name", F.col("id").alias("target")), "name")
    made.append(frames.groupBy("rel_path", "target").agg(F.min_by("concept_id", "pos").alias("source")).select("source", "target", F.lit("references").alias("relation"), F.lit(schemas.INFERRED).alias("confidence"), F.col("rel_path").alias("source_file"), F.lit("video_frame_exact_match").alias("context")))
    relations = parts["relations"].join(files.select("rel_path", F.col("modality").alias("of")), "rel_path")
    made.append(concepts.relation_edges(relations.filter("of = 'document'").drop("of"), named))
    made.append(concepts.relation_edges(relations.filter("of = 'image'").drop("of"), named, symbols))
    made.append(concepts.relation_edges(relations.filter("of = 'video'").drop("of"), named, symbols).distinct())
    edges = parts["edges"]
    for k, more in enumerate(made):
        place = F.lit((k + 1) << 56) + F.pmod(F.xxhash64("source", "target", "relation"), F.lit(1 << 40))  # after the files' own, in any fixed order
        edges = edges.unionByName(more.withColumn("seq", place), allowMissingColumns=True)
    owner = nodes.select("id", F.col("source_file").alias("_file")).groupBy("id").agg(F.first("_file").alias("_file"), F.count("*").alias("_n")).filter("_n = 1").drop("_n")
    if "target_source_file" not in edges.columns:
        edges = edges.withColumn("target_source_file", F.lit(None).cast("string"))
    edges = edges.join(owner.withColumnRenamed("id", "target"), "target", "left").withColumn("target_source_file", F.coalesce("target_source_file", "_file")).drop("_file")
    edges = edges.withColumn("weight", F.lit(1.0))
    nodes, edges = graph.build_graph(nodes, stored(edges, "edges"))
    return nodes, edges.select(*[f.name for f in schemas.EDGES.fields])


def _change(spark: SparkSession, out: str, listed: DataFrame, then: DataFrame, old_facts: DataFrame, facts: DataFrame) -> relink.Change | None:
    """What changed since the links in the cache were made; None where there are none."""
    if not export.exists(spark, f"{out}/cache/links"):
        return None
    now, before = listed.select("rel_path", "sha1"), then.select("rel_path", "sha1")
    moved = now.exceptAll(before).union(before.exceptAll(now)).select("rel_path").distinct()
    changed = stored(moved.union(facts.filter("kind = 'incomplete'").select("rel_path")).distinct(), "changed")
    tables = []
    for rows in (old_facts, facts):
        own = rows.join(changed, "rel_path", "left_semi")
        nodes = own.filter("kind = 'node' AND modality = 'code'").select("id", "label", F.col("rel_path").alias("source_file"))
        spaces = own.filter("kind = 'namespace'").select(F.col("name").alias("namespace"), "id")
        tables.append((relink.names_of(nodes), spaces))
    (old_names, old_spaces), (names, spaces) = tables
    modules = lambda paths: paths.select(X.module_path(F.col("rel_path")).alias("module"))
    code = lambda rows: modules(rows.filter("kind = 'node' AND modality = 'code'").select("rel_path").distinct())
    listed_code = modules(listed.filter("modality = 'code'").select("rel_path").join(changed, "rel_path", "left_semi"))
    stale_modules = relink.stale(code(old_facts.join(changed, "rel_path", "left_semi")), listed_code, "module")
    return relink.Change(changed, spark.read.parquet(f"{out}/cache/links"), relink.stale(old_names, names, "name"), relink.stale(old_spaces, spaces, "namespace"), stale_modules)


def build(spark: SparkSession, root: str, out: str, do_cluster: bool = True, provider=None) -> tuple[DataFrame, DataFrame]:
    settings.load_env(root)
    own = settings.load_settings(root)
    provider = provider or providers.choose(False, own.model, own.vision_model)
    name = provider.name if provider is not None else "none"
    found = read_files(spark, root, own.extra_ignore_dirs, own.extra_sensitive_dirs)
    found = found.withColumn("provider", F.when(F.col("force_local"), "none").otherwise(F.lit(name)))
    listed = stored(found.drop("content"), "files")
    then, old_facts = _cached(spark, out)
    # text read without a provider is read again once there is one
    todo = incremental.misses(found, then)
    fresh = stored(extract.extract(todo, provider), "facts")
    facts = stored(incremental.pruned(old_facts, incremental.hits(listed, then)).unionByName(fresh), "facts")
    failed = stored(facts.filter("kind = 'incomplete'").select("rel_path").distinct(), "incomplete")
    read = stored(incremental.misses(listed, then).select("rel_path", "sha1", "provider"), "read")
    log.info("%d files, %d read anew, %d incomplete", listed.count(), read.count(), failed.count())
    change, links = _change(spark, out, listed, then, old_facts, facts), []

    def link(calls, imports, code, namespaces):
        made = relink.resolved(calls, imports, code, namespaces) if change is None else relink.relinked(calls, imports, code, namespaces, change)
        links.append(stored(made, "cross_links"))
        return links[0]

    nodes, edges = assemble(listed, facts, provider, link)
    done = read.join(failed.withColumn("incomplete", F.lit(True)), "rel_path", "left").withColumn("incomplete", F.coalesce("incomplete", F.lit(False)))
    cache = stored(incremental.updated(then, listed, done), "cache")
    _store_cache(spark, out, cache, incremental.pruned(facts, cache), links[0])
    nodes, edges = stored(nodes, "nodes"), stored(edges, "edges")
    if do_cluster:
        nodes = community.cluster(_with_previous(spark, nodes, out), edges, own.fine_resolution, own.coarse_resolution)
    export.export(nodes, edges, out, provider)
    return export.read_tables(spark, out)


def _with_previous(spark: SparkSession, nodes: DataFrame, out: str) -> DataFrame:
    if not export.exists(spark, f"{out}/nodes"):
        return nodes
    before = spark.read.parquet(f"{out}/nodes")
    if "community" not in before.columns:
        return nodes
    return stored(nodes.join(before.select("id", "community", "community_group"), "id", "left"), "warm")


def cluster(spark: SparkSession, out: str, root: str | None = None) -> DataFrame:
    own = settings.load_settings(root) if root else settings.Settings()
    nodes, edges = (stored(t, "graph") for t in export.read_tables(spark, out))
    done = stored(community.cluster(nodes, edges, own.fine_resolution, own.coarse_resolution), "clustered")
    export.export(done, edges, out)
    return done


def query(spark: SparkSession, out: str, question: str, provider=None) -> str:
    nodes, edges = export.read_tables(spark, out)
    found = traverse.ask(nodes, edges, question)
    if found is None:
        return "No node of the graph matches this question. Name a function or class."
    _, shown, links = found
    shown, open_nodes = stored(shown, "shown"), None
    if provider is None and _open(shown).count() < shown.count():
        provider = providers.choose(force_local=True)
    if provider is None:
        provider, open_nodes = providers.choose(force_local=False), _open(shown).select("id")
    elif not getattr(provider, "local", False):
        open_nodes = _open(shown).select("id")
    if provider is not None and open_nodes is not None:  # facts of files that must not leave the machine stay here
        links = traverse.induced_edges(links, open_nodes)
    context = traverse.context_text(traverse.context_sections(traverse.fact_lines(shown, links)))
    return providers.answer(provider, question, context)


def status(spark: SparkSession, root: str, out: str) -> dict:
    """{new, changed, unchanged, deleted: paths, needs_rebuild}; nothing is extracted."""
    own = settings.load_settings(root)
    files = read_files(spark, root, own.extra_ignore_dirs).select("rel_path", "sha1")
    found = stored(incremental.status(files, _cached(spark, out)[0]), "status")
    rows = found.orderBy("rel_path").collect()
    states = {s: [r["rel_path"] for r in rows if r["state"] == s] for s in ("new", "changed", "unchanged", "deleted")}
    return states | {"needs_rebuild": incremental.status_summary(found).first()["needs_rebuild"]}
