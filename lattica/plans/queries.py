"""Named queries over the relational tables, one or more for each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import classify, extract, tokens
from ..graph import CodeGraph
from ..operators import algorithms, clusters, hierarchy, layout, ledger, merge, vectors, weights
from ..sources import incremental
from ..sources.relational import Tables, assignment, nodes, raw_edges
from ..sources.scratch import materialize
from . import openapi, report, specs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
    return f


def _edges(t: Tables, *kinds: str) -> DataFrame:
    return merge.merge_edges(raw_edges(t, *kinds))


def _named_report(t: Tables) -> DataFrame:
    report = clusters.cluster_report(nodes(t), _edges(t), assignment(t), lists=False)
    return clusters.dedup_names(report, "base_name", "cluster_id")


def _boundary(t: Tables) -> DataFrame:
    return clusters.boundary_edges(_edges(t), assignment(t))


def _place(t: Tables) -> tuple[DataFrame, DataFrame]:
    """The small graph of customers, nations and regions."""
    return nodes(t, "customer", "nation", "region"), _edges(t, "customer", "nation")


def _ring(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Embeddings as a graph: vec_id -> vec_id + 1, typed by whether labels agree."""
    e = t.embeddings
    n = e.select(F.col("vec_id").alias("node_seq"), F.format_string("vec:%08d", "vec_id").alias("id"), F.when(F.col("label") % 2 == 0, "Entity").otherwise("Service").alias("type"), "label")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("next"), F.col("label").alias("next_label"))
    kind = F.when(F.col("label") == F.col("next_label"), "INHERITS").when(F.col("label") < F.col("next_label"), "CALLS").otherwise("IMPORTS")
    raw = e.join(nxt, "vec_id").select(F.col("vec_id").alias("seq"), F.format_string("vec:%08d", "vec_id").alias("src"), F.format_string("vec:%08d", "next").alias("dst"), kind.alias("type"))
    raw = raw.select("seq", "src", "dst", "type", merge.type_weight(F.col("type")).alias("weight"), F.lit(None).cast("string").alias("method_name"))
    return n, merge.merge_edges(raw), e.select(F.format_string("vec:%08d", "vec_id").alias("id"), F.col("embedding").alias("vec"))


# --- edges and nodes ---------------------------------------------------------------------------------------------


@query
def edge_merge(t):
    """A1, A2, P7."""
    return _edges(t, "lineitem").select("src", "dst", "type", "weight", F.array_join("types", ",").alias("types"))


@query
def node_classify(t):
    """P1, P4 on part names and event types."""
    p = t.part.select(F.col("p_partkey").alias("k"), F.array("p_type").alias("marks"), F.element_at(F.split("p_name", " "), -1).alias("name"))
    e = t.events.select(F.col("event_id").alias("k"), F.array(F.concat("event_type", F.lit("Service"))).alias("marks"), F.col("event_type").alias("name"))
    both = p.withColumn("of", F.lit("part")).unionByName(e.withColumn("of", F.lit("event")))
    return both.select("of", "k", classify.node_type(F.col("marks"), F.col("name")).alias("type"), classify.class_type(F.array(F.initcap("name")), F.col("k") % 3 == 0).alias("class_type"))


@query
def node_type_counts(t):
    """A3."""
    return merge.type_counts(nodes(t))


@query
def complexity_by_package(t):
    """Sums of complexity."""
    return nodes(t).groupBy("package").agg(F.sum("complexity_score").alias("complexity"), F.count("*").alias("n"), F.max(classify.simple_name(F.col("simple_name"), F.col("id"))).alias("last_name"))


@query
def keep_last_node(t):
    """The same id twice keeps the last record, at the first one's place."""
    rows = t.lineitem.select(F.col("l_suppkey").cast("string").alias("id"), (F.col("l_orderkey") * 100_000_000 + F.col("l_partkey") * 100 + F.col("l_linenumber")).alias("node_seq"), F.col("l_partkey").alias("part"))
    return merge.keep_last(rows)


@query
def placeholder_nodes(t):
    """Customers without the even nations; their nations come back as placeholders."""
    known = nodes(t, "customer").unionByName(nodes(t, "nation").where("complexity_score % 2 = 1"))
    return merge.with_placeholders(known, _edges(t, "customer", "nation")).select("id", "type", "package")


@query
def degree_stats(t):
    """G9."""
    return merge.degrees(_edges(t))


@query
def induced_subgraph(t):
    """Customers with a positive balance and all nations."""
    rich = t.customer.where("c_acctbal > 0").select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("id")).unionByName(nodes(t, "nation").select("id"))
    n, e = merge.induced_subgraph(nodes(t), _edges(t, "customer", "nation"), rich)
    return n.select(F.lit("node").alias("kind"), "id", F.lit("").alias("dst")).unionByName(e.select(F.lit("edge").alias("kind"), F.col("src").alias("id"), "dst"))


@query
def dependents_of(t):
    """J11."""
    return merge.dependents_of(_edges(t, "customer", "supplier"), "nation:7")


@query
def dependencies_of(t):
    """J11."""
    return merge.dependencies_of(_edges(t, "lineitem"), "supplier:3")


@query
def library_filter(t):
    """P8 on urls' hosts as names."""
    name = F.concat(F.when(F.col("page_id") % 3 == 0, "java.").when(F.col("page_id") % 3 == 1, "javax.").otherwise("javac."), F.col("page_id").cast("string"))
    return t.pages.select("page_id", name.alias("name")).where(~classify.is_library(F.col("name"))).withColumn("last", classify.last_part(F.col("name")))


@query
def ignored_paths(t):
    """Pages whose url the patterns leave out, as substrings and as globs."""
    path = F.regexp_replace("url", r"^\w+://", "")
    patterns = ["**/en/**", "**/fr/1*"]
    return t.pages.select("page_id", classify.ignored(path, patterns).alias("loose"), classify.ignored(path, patterns, strict=True).alias("strict"))


# --- clusters ----------------------------------------------------------------------------------------------------


@query
def boundary_edges(t):
    """Edges between regions, counted and summed by service pair."""
    return _boundary(t).groupBy("from_service", "to_service").agg(F.count("*").alias("edges"), F.sum("weight").alias("weight"))


@query
def cluster_report(t):
    """A6, A8."""
    r = _named_report(t)
    return r.select("cluster_id", "class_count", F.round("internal_cohesion", 6).alias("internal_cohesion"), F.round("external_coupling", 6).alias("external_coupling"), "complexity_score", "dominant_type")


@query
def cluster_report_stack(t):
    """A7."""
    r = clusters.stack_report(nodes(t), _edges(t), assignment(t))
    return r.select("cluster_id", "class_count", "packages", F.round("internal_cohesion", 6).alias("internal_cohesion"), F.round("external_coupling", 6).alias("external_coupling"))


@query
def service_names(t):
    """Part types as base names, numbered by part."""
    base = F.concat(F.lower("p_type"), F.lit("-service"))
    rows = t.part.select("p_partkey", classify.service_name(F.lit(None).cast("string"), F.col("p_type"), F.col("p_partkey")).alias("base"), base.alias("same"))
    return clusters.dedup_names(rows, "base", "p_partkey").select("p_partkey", "name", (F.col("base") == F.col("same")).alias("by_package"))


@query
def warnings(t):
    """A9."""
    edges = materialize(_edges(t), "edges")
    r = clusters.dedup_names(clusters.cluster_report(nodes(t), edges, assignment(t), lists=False), "base_name", "cluster_id")
    r = materialize(r.withColumn("name", F.concat(F.lit("service-"), F.col("cluster_id").cast("string"))), "report")
    w = clusters.warnings(r, clusters.boundary_edges(edges, assignment(t)))
    return w.select("kind", "service", F.round("number", 6).alias("number"))


@query
def recommend_order(t):
    """O1, O3, J18."""
    r = _named_report(t).withColumn("name", F.concat(F.lit("service-"), F.col("cluster_id").cast("string")))
    return clusters.recommendations(r, _edges(t), assignment(t)).select("step", "title", F.round("number", 6).alias("number"))


@query
def pair_priority(t):
    """P18."""
    return clusters.pair_priority(_boundary(t))


@query
def first_calls(t):
    """A10, O2: the first edge, by its place, of every pair of services."""
    edges = merge.merge_edges(raw_edges(t), place=True)
    return clusters.first_calls(clusters.boundary_edges(edges, assignment(t)))


@query
def called_methods(t):
    """A11 on events: the kinds of events of each user, nulls left out."""
    rows = t.events.select(F.col("user_id").cast("string").alias("to_service"), F.when(F.col("value") > 50, F.col("event_type")).alias("method"))
    return clusters.called_methods(rows).select("to_service", F.array_join("methods", ",").alias("methods"))


@query
def package_summary(t):
    """A12."""
    return clusters.package_groups(t.documents.select(F.col("source").alias("package"), F.col("lang").alias("type")))


@query
def package_proposal(t):
    """One service for each source, numbered by its first document."""
    n = t.documents.select(F.col("doc_id").alias("node_seq"), F.col("doc_id").cast("string").alias("id"), F.col("source").alias("package"))
    return clusters.package_proposal(n).select("id", F.col("cluster_id").cast("long").alias("cluster_id"))


@query
def proposal_assignment(t):
    """Nations listed by the services of two overlapping groupings; the last wins, the rest get ids of their own."""
    a = t.nation.where("n_nationkey < 15").groupBy((F.col("n_nationkey") % 3).alias("service_index")).agg(F.collect_list(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string"))).alias("classes"))
    b = t.nation.where("n_nationkey BETWEEN 10 AND 19").groupBy((F.col("n_regionkey") + 3).alias("service_index")).agg(F.collect_list(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string"))).alias("classes"))
    return clusters.proposal_assignment(nodes(t, "nation"), a.unionByName(b))


@query
def single_service(t):
    """A proposal that can't be read gives one service of all classes."""
    n = nodes(t, "customer", "nation")
    none = t.spark.createDataFrame([], "service_index long, name string, classes array<string>")
    proposed = clusters.readable_proposal(n, none)
    return clusters.proposal_assignment(n, proposed).join(F.broadcast(proposed.select(F.col("service_index").alias("cluster_id"), "name").distinct()), "cluster_id").select("id", "cluster_id", "name")


@query
def domain_split(t):
    """Orders of urgent kinds are the domain, the rest is excluded."""
    ids = nodes(t, "orders").select("id", "simple_name")
    domain = ids.where(F.col("simple_name").rlike("^[12]-"))
    out = ids.join(domain.select("id"), "id", "left_anti")
    return domain.groupBy(F.lit("domain").alias("part"), "simple_name").agg(F.count("*").alias("n")).unionByName(out.groupBy(F.lit("excluded").alias("part"), "simple_name").agg(F.count("*").alias("n")))


@query
def chunk_100(t):
    """O6."""
    return clusters.chunks(t.customer.select("c_custkey"), ["c_custkey"]).groupBy("chunk").agg(F.count("*").alias("n"), F.min("c_custkey").alias("first"))


@query
def port_assignment(t):
    """Gateway first, then by name."""
    s = t.supplier.select(F.when(F.col("s_suppkey") == 1, "api-gateway").otherwise(F.col("s_name")).alias("name"))
    numbered = merge.sequential_ids(s.withColumn("late", (F.col("name") != "api-gateway").cast("int")), ["late", "name"], "i")
    return numbered.select("name", (F.col("i") + 18080).cast("long").alias("host_port"))


# --- weights -----------------------------------------------------------------------------------------------------


@query
def structural_weight(t):
    """J3, J4 on suppliers and parts."""
    p = weights.pairs(nodes(t, "supplier", "part"), _edges(t, "lineitem"))
    return p.select("a", "b", F.round("structural", 6).alias("structural"))


@query
def data_gravity(t):
    """J5."""
    return weights.pairs(nodes(t, "supplier", "part"), _edges(t, "lineitem")).select("a", "b", "gravity")


@query
def hybrid_weights(t):
    """J3-J6, G7 on the ring of embeddings."""
    n, e, v = _ring(t)
    return weights.hybrid_weights(n, e, v).select("a", "b", F.round("weight", 5).alias("weight"))


#: Groups of constraint_contract: a prefix, two literals, a literal with one that no node has.
GROUPS = [["vec:0000000*"], ["vec:00000020", "vec:00000021"], ["vec:00000005", "vec:absent"]]


@query
def prefix_constraints(t):
    """suppliers' keys as prefixes of orders and, for every ninth, of customers; every seventh also names an order, every tenth only one that isn't there."""
    k = F.col("s_suppkey")
    group = k.cast("int").alias("grp")
    of = F.when(k % 9 == 0, "customer:").otherwise("orders:")
    prefixes = t.supplier.where("s_suppkey % 10 > 0").select(group, F.concat(of, k.cast("string"), F.lit("*")).alias("pattern"))
    literals = t.supplier.where("s_suppkey % 7 = 0").select(group, F.concat(F.lit("orders:"), (k * 3).cast("string")).alias("pattern"))
    absent = t.supplier.where("s_suppkey % 10 = 0").select(group, F.concat(F.lit("nothing:"), k.cast("string")).alias("pattern"))
    return weights.constraint_members(nodes(t, "orders", "customer"), prefixes.unionByName(literals).unionByName(absent))


@query
def constraint_contract(t):
    """J7, J8, J9."""
    n, e, _ = _ring(t)
    p = weights.pairs(n, e).select("a", "b", F.col("structural").alias("weight"))
    return weights.contract(p, weights.constraint_members(n, GROUPS)).select("a", "b", F.round("weight", 6).alias("weight"))


# --- graph algorithms --------------------------------------------------------------------------------------------


@query
def modularity(t):
    """G10 of the regions on the pair weights of suppliers, customers and nations."""
    n, e = nodes(t, "customer", "supplier", "nation", "region"), _edges(t, "customer", "supplier", "nation")
    w = weights.pairs(n, e).select("a", "b", F.col("structural").alias("weight"))
    return algorithms.modularity(w, assignment(t)).select(F.round("modularity", 6).alias("modularity"))


@query
def wcc(t):
    """G1."""
    n, e = _place(t)
    return algorithms.weak_components(n, e)


def _cyclic(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Nations in a cycle within each region, and regions in a chain."""
    nat = t.nation.select("n_nationkey", "n_regionkey")
    nxt = F.lead("n_nationkey").over(Window.partitionBy("n_regionkey").orderBy("n_nationkey"))
    first = F.min("n_nationkey").over(Window.partitionBy("n_regionkey"))
    ring = nat.select(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("src"), F.concat(F.lit("nation:"), F.coalesce(nxt, first).cast("string")).alias("dst"))
    return _place(t)[0].unionByName(nodes(t, "supplier")), ring.unionByName(_edges(t, "customer", "nation", "supplier").select("src", "dst"))


@query
def scc(t):
    """G2."""
    return algorithms.strong_components(*_cyclic(t))


@query
def is_dag(t):
    """G3 of the references, and of those with cycles."""
    spark = t.spark
    return spark.createDataFrame([("references", algorithms.is_dag(_place(t)[1])), ("with cycles", algorithms.is_dag(_cyclic(t)[1]))], "graph string, is_dag boolean")


@query
def graph_statistics(t):
    """A4, A5."""
    s = algorithms.statistics(*_place(t))
    return s.select("node_count", "edge_count", "is_dag", "strongly_connected_components", "weakly_connected_components", F.size("node_types").alias("n_types"))


@query
def louvain(t):
    """G4, G6 on places; properties are tested."""
    n, e = _place(t)
    return algorithms.detect_communities(n, weights.pairs(n, e).select("a", "b", F.col("structural").alias("weight")))


@query
def girvan_newman(t):
    """G5 on nations and regions joined in a chain."""
    n, e = nodes(t, "nation", "region"), _edges(t, "nation")
    chain = t.region.where("r_regionkey < 4").select(F.concat(F.lit("region:"), F.col("r_regionkey").cast("string")).alias("a"), F.concat(F.lit("region:"), (F.col("r_regionkey") + 1).cast("string")).alias("b"))
    return algorithms.detect_communities(n, e.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(chain).withColumn("weight", F.lit(1.0)), "girvan_newman")


# --- vectors -----------------------------------------------------------------------------------------------------


@query
def cosine_pairs(t):
    """All pairs of vectors; those that are alike."""
    v = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return vectors.all_similarities(v, least=0.3).select("a", "b", F.round("similarity", 4).alias("similarity"))


@query
def top_k_similar(t):
    """The ten nearest of every vector whose id is divisible by 20."""
    v = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return vectors.find_similar(v, v.where("id % 20 = 0"), 10).select("query", F.col("rank").cast("long").alias("rank"), "id", F.round("similarity", 4).alias("similarity"))


@query
def vector_similarity(t):
    """V3: two given vectors, one of them with itself, and one that is missing."""
    v = t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    pairs = [(3, 7), (7, 3), (12, 40), (5, 5), (1, -1)]
    out = [vectors.similarity(v, a, b).select(F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b"), F.round("similarity", 4).alias("similarity")) for a, b in pairs]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3]).unionByName(out[4])


@query
def fixed_files(t):
    """Replies with two files, one of a language and one without."""
    first = F.format_string("Here:\n### FIXED: src/%s.java\n```java\n  // %s\n```\n", F.col("doc_id").cast("string"), F.col("source"))
    second = F.format_string("### FIXED: %s.yml\n```\nlang: %s\n```", F.col("doc_id").cast("string"), F.col("lang"))
    return extract.fixed_files(t.documents.select(F.col("doc_id").alias("id"), F.concat(first, second).alias("content"))).select("id", F.col("pos").cast("long").alias("pos"), "file", "body")


@query
def annotation_values(t):
    """Values in quotes, half quoted and plain."""
    quoted = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit('"'), "p_name", F.lit('"'))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit('"'), "p_name")).otherwise(F.col("p_name"))
    return t.part.select("p_partkey", extract.annotation_value(quoted).alias("value"))


@query
def embed_texts(t):
    """V1, V2: vectors of changed texts only; checked are the ids that were encoded and their dimension."""
    texts = t.documents.select(F.col("doc_id").cast("string").alias("id"), F.md5("text").alias("file_hash"), "text")
    stored = texts.where("cast(id AS long) % 3 > 0").select("id", F.when(F.col("id").cast("long") % 3 == 1, F.col("file_hash")).otherwise("old").alias("file_hash"), F.array(F.lit(0.0).cast("float")).alias("vec"))
    return vectors.refresh(stored, texts).select("id", "file_hash", F.size("vec").cast("long").alias("dimensions"))


# --- hierarchy, incremental, ledger --------------------------------------------------------------------------------


def _family(t: Tables) -> DataFrame:
    """Customers extend nations, nations extend regions; fields are columns."""
    field = lambda kind, name: F.struct(F.lit(kind).alias("type"), F.lit(name).alias("name"))
    row = lambda df, key, table, rank, parent, fields: df.select((F.lit(rank * 10**9) + F.col(key)).alias("node_seq"), F.concat(F.lit(f"{table}."), F.lit(table), F.col(key).cast("string")).alias("id"), F.lit(table).alias("package"), F.concat(F.lit(table), F.col(key).cast("string")).alias("simple_name"), parent.alias("superclass"), F.array(*fields).alias("fields"))
    return (
        row(t.region, "r_regionkey", "region", 0, F.lit(None).cast("string"), [field("int", "id"), field("String", "name")])
        .unionByName(row(t.nation, "n_nationkey", "nation", 1, F.concat(F.lit("region"), F.col("n_regionkey").cast("string")), [field("String", "name"), field("int", "code")]))
        .unionByName(row(t.customer, "c_custkey", "customer", 2, F.concat(F.lit("nation.nation"), F.col("c_nationkey").cast("string")), [field("double", "acctbal"), field("String", "name")]))
    )


@query
def resolve_superclass(t):
    """J13."""
    return hierarchy.resolve_superclasses(_family(t))


@query
def inherited_closure(t):
    """H1, G11."""
    return hierarchy.ancestors(hierarchy.resolve_superclasses(_family(t))).select("id", "ancestor", F.col("depth").cast("long").alias("depth"))


@query
def inherited_fields(t):
    """H2, U1."""
    return hierarchy.all_fields(_family(t)).select("id", F.col("pos").cast("long").alias("pos"), "name", "type", "inherited")


@query
def entity_specs(t):
    """Fields and id types of customers."""
    specs = hierarchy.entity_specs(_family(t).withColumn("type", F.when(F.col("package") == "customer", "Entity").otherwise("Unknown")))
    return specs.select("id", "name", F.array_join(F.transform("fields", lambda f: F.concat_ws(":", f["name"], f["type"], F.array_join(f["annotations"], "+"))), ",").alias("fields"), "id_type")


@query
def external_superclass(t):
    """Customers whose nation is in another cluster, clusters being key modulo 3."""
    a = _family(t).select("id", (F.regexp_extract("id", r"(\d+)$", 1).cast("long") % 3).alias("cluster_id"))
    return hierarchy.external_superclasses(_family(t), a)


@query
def changed_docs(t):
    """Hashes of a stored state against the current one."""
    now = t.documents.select(F.col("doc_id").cast("string").alias("file_path"), F.md5("text").alias("content_hash"))
    stored = now.where("cast(file_path AS long) % 5 > 0").select("file_path", F.when(F.col("file_path").cast("long") % 2 == 0, F.col("content_hash")).otherwise("old").alias("content_hash"))
    gone = t.pages.select(F.concat(F.lit("page"), F.col("page_id").cast("string")).alias("file_path"), F.md5("url").alias("content_hash"))
    return incremental.changes(stored.unionByName(gone), now).select("file_path", "state")


@query
def upsert_docs(t):
    """I2, I3."""
    rows = t.documents.select(F.col("doc_id").cast("string").alias("file_path"), F.md5("text").alias("content_hash"))
    stored = rows.where("cast(file_path AS long) % 2 = 0").withColumn("content_hash", F.lit("old"))
    current = rows.where("cast(file_path AS long) % 3 = 0")
    gone = rows.where("cast(file_path AS long) % 10 = 4")
    return incremental.remove(incremental.upsert(stored, current), gone)


@query
def llm_cost_ledger(t):
    """conversations' turns as calls; the first overflow ends a conversation."""
    c = t.conversations.select("conv_id", "turn", "role", extract.token_estimate(F.col("text")).alias("tokens"))
    model = F.when(F.col("role") == "assistant", "gpt-4").otherwise("unknown")
    calls = c.select(F.col("conv_id").alias("budget"), F.col("turn").alias("seq"), ledger.cost(model, F.when(F.col("role") == "assistant", 0).otherwise(F.col("tokens")), F.when(F.col("role") == "assistant", F.col("tokens")).otherwise(0)).alias("cost"))
    return ledger.running_accept(calls, 0.02).select("budget", "seq", F.round("cost", 8).alias("cost"), F.round("total", 8).alias("total"), "accepted")


@query
def llm_greedy_ledger(t):
    """Later cheaper calls may still fit; costs in thousands of tokens."""
    c = t.conversations.select(F.col("conv_id").alias("budget"), F.col("turn").alias("seq"), extract.token_estimate(F.col("text")).cast("double").alias("cost"))
    return ledger.greedy_accept(c.withColumn("estimate", F.col("cost")), 300.0)


@query
def llm_cost_report(t):
    """A13."""
    calls = t.conversations.select(extract.token_estimate(F.col("text")).alias("tokens")).withColumn("cost", ledger.cost(F.lit("gpt-4o"), F.col("tokens"), F.lit(0)))
    r = ledger.report(calls, 5.0)
    return r.select("total_tokens", F.round("total_cost", 4).alias("total_cost"), "cost_limit", F.round("remaining", 4).alias("remaining"))


# --- text --------------------------------------------------------------------------------------------------------


@query
def table_name_snake(t):
    """X2, P13, X13."""
    camel = F.concat(F.initcap("p_type"), F.lit("Kind"), F.regexp_extract("p_brand", r"(\d+)", 1))
    return t.part.select("p_partkey", classify.table_name(F.regexp_replace(camel, " ", ""), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit('@Table(name = "t'), F.col("p_size").cast("string"), F.lit('")')))).alias("table_name"), classify.base_package(F.when(F.col("p_size") > 25, "org.x"), F.lower("p_brand")).alias("package"), extract.shortened(F.col("p_name"), 12).alias("short"))


@query
def extract_links(t):
    """Every href."""
    return extract.links(t.pages).select("page_id", F.col("pos").cast("long").alias("pos"), "href")


@query
def extract_relations(t):
    """Relations in sources made of parts and sizes."""
    src = F.concat(F.lit("@OneToMany(x)\n  private List<P"), F.col("p_size").cast("string"), F.lit("> many;\n@ManyToOne private Q"), F.col("p_partkey").cast("string"), F.lit(" one;"))
    return extract.relationships(t.part.select(F.col("p_partkey").alias("id"), src.alias("source"))).select("id", "relation", "target", "field")


@query
def extract_json_props(t):
    """Numbers in JSON, -1 where there is none."""
    k = extract.json_or(F.when(F.col("event_id") % 10 == 0, "{broken").otherwise(F.col("props")), "k int", F.struct(F.lit(-1).alias("k")))
    return t.events.select("event_id", k["k"].cast("long").alias("k"))


@query
def tool_calls(t):
    """Calls in replies made of events' properties; broken and nameless ones are left out."""
    name = F.when(F.col("event_id") % 3 == 0, "").otherwise(F.concat(F.lit('"name": "'), F.col("event_type"), F.lit('", ')))
    call = F.concat(F.lit("text <tool_call> {"), name, F.lit('"id": '), F.col("event_id").cast("string"), F.when(F.col("event_id") % 5 == 0, ",,}").otherwise("}"), F.lit(" </tool_call>"))
    return extract.tool_calls(t.events.select(F.col("event_id").alias("id"), F.concat(call, F.lit("\n"), call).alias("content"))).select("id", F.col("pos").cast("long").alias("pos"), "name")


@query
def compile_errors(t):
    """Build logs made of orders."""
    log = F.concat(F.lit("[ERROR] /src/A"), F.col("o_orderkey").cast("string"), F.lit(".java:["), (F.col("o_custkey") % 90 + 1).cast("string"), F.lit(",5] error: cannot  find\n symbol [INFO] done"))
    e = extract.compile_errors(t.orders.select(F.col("o_orderkey").alias("id"), log.alias("output")))
    return e.select("id", "file_path", F.col("line").cast("long").alias("line"), F.col("column").cast("long").alias("col"), "message")


@query
def fenced_code(t):
    """X6."""
    body = F.concat(F.lit("key: "), F.col("n_name"))
    text = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("see\n```yaml\n"), body, F.lit("\n```\nend"))).otherwise(F.concat(F.lit("  "), body, F.lit("``` ")))
    return t.nation.select("n_nationkey", extract.fenced(text, "yaml", "yml").alias("body"))


@query
def token_budget(t):
    """X15."""
    tokens, limit = extract.token_estimate(F.col("text")), extract.context_limit(F.lit("gpt-4"))
    return t.documents.select("doc_id", tokens.alias("tokens"), extract.fits(tokens, limit).alias("fits"), extract.utilization(tokens, limit).alias("utilization"))


@query
def openapi_type_map(t):
    """P10, P11 on types made of part types and brands."""
    kind = F.element_at(F.array(*map(F.lit, ["Long", "int", "List<Pet>", "BigDecimal", "Point", "Pet", "boolean"])), (F.col("p_size") % 7 + 1).cast("int"))
    return t.part.select("p_partkey", classify.api_type(kind).alias("api_type"), classify.boxed(kind).alias("boxed"))


@query
def compose_failure_class(t):
    """P15, P16, P20 on messages made of events."""
    texts = ["yaml: line 3", "depends on undefined service x", "failed to solve: y", "Port is already allocated", "container is UNHEALTHY", "Service is complete", "other"]
    text = F.element_at(F.array(*map(F.lit, texts)), (F.col("event_id") % 7 + 1).cast("int"))
    return t.events.select("event_id", classify.failure_class(text).alias("failure"), classify.is_done(text).alias("done"), classify.is_finished(F.col("event_type")).alias("finished"))


@query
def boot_version(t):
    """P14."""
    v = F.element_at(F.array(F.lit("4.0.1"), F.lit(" 3.1.5 "), F.lit("latest"), F.lit(""), F.lit("2.7")), (F.col("n_nationkey") % 5 + 1).cast("int"))
    return t.nation.select("n_nationkey", classify.boot_version(F.when(F.col("n_nationkey") < 20, v)).alias("version"))


@query
def class_text(t):
    """Parts as classes."""
    marks = F.when(F.col("p_size") % 2 == 0, F.array(F.lit("Entity"), F.col("p_brand"))).otherwise(F.array().cast("array<string>"))
    method = F.struct(F.concat(F.lit("get"), F.col("p_type")).alias("name"), F.when(F.col("p_size") > 20, "int").alias("return_type"), F.array(F.struct(F.lit("long").alias("type"), F.lit("key").alias("name"))).alias("parameters"))
    field = F.struct(F.lit("int").alias("type"), F.lit("size").alias("name"))
    return t.part.select("p_partkey", classify.class_text(F.col("p_name"), F.col("p_size") % 5 == 0, F.col("p_size") % 5 == 1, marks, F.array(method), F.array(field)).alias("text"), classify.class_summary(F.col("p_name"), marks, F.array(method)).alias("summary"))


@query
def service_ports(t):
    """Ports in configurations, and published ones."""
    conf = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("server:\n  port: "), (F.col("s_suppkey") + 9000).cast("string")))
    return t.supplier.select("s_suppkey", extract.service_port(conf).cast("long").alias("port"))


@query
def host_ports(t):
    """S13."""
    short = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.col("s_suppkey").cast("string"), F.lit(":80"))).when(F.col("s_suppkey") % 3 == 1, "x:80")
    return extract.host_ports(t.supplier.select(short.alias("short"), F.when(F.col("s_suppkey") % 3 == 2, F.col("s_suppkey").cast("string")).alias("published"))).select(F.col("port").cast("long").alias("port"))


@query
def invalid_services(t):
    """P17, J20."""
    s = t.nation.where("n_nationkey % 4 > 0").select(F.concat(F.lit("s"), F.col("n_nationkey").cast("string")).alias("name"), F.array(F.concat(F.lit("s"), F.col("n_regionkey").cast("string"))).alias("depends_on"))
    return extract.invalid_services(s, t.nation.where("n_nationkey < 10").select(F.concat(F.lit("s"), F.col("n_nationkey").cast("string")).alias("name")))


@query
def compose_health(t):
    """Status lines of events as services."""
    line = F.to_json(F.struct(F.concat(F.lit("u"), (F.col("user_id") % 50).cast("string")).alias("Service"), F.when(F.col("value") < 99, "running").otherwise("exited").alias("State"), F.lit("healthy").alias("Health")))
    want = t.nation.select(F.concat(F.lit("u"), (F.col("n_nationkey") * 3).cast("string")).alias("name"))
    return extract.health(t.events.select(line.alias("line")), want)


@query
def success_summary(t):
    """A14."""
    return t.labels.agg(F.count_if(F.col("quality") == 1).alias("succeeded"), F.count("*").alias("total"))


@query
def endpoint_paths(t):
    """Parts as controllers; of a path that two have the later one counts."""
    base = F.concat(F.lit("/api/"), F.lower("p_brand"))
    method = F.struct(F.element_at(F.array(F.lit("GetMapping"), F.lit("PostMapping"), F.lit("Other")), (F.col("p_size") % 3 + 1).cast("int")).alias("mapping"), F.lit("/x").alias("suffix"), F.concat(F.lit("m"), F.col("p_partkey").cast("string")).alias("name"), F.lit("int").alias("return_type"), F.array().cast("array<string>").alias("parameters"))
    rows = t.part.select(F.col("p_partkey").alias("id"), extract.base_path(F.concat(F.lit('@RequestMapping("'), base, F.lit('")'))).alias("base"), F.array(method).alias("methods"))
    paths = extract.openapi_paths(extract.endpoints(rows), t.part.select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("seq")))
    return paths.select("path", F.array_join(F.map_keys("operations"), ",").alias("verbs"), F.array_join(F.map_values("operations"), ",").alias("names"))


# --- documents ---------------------------------------------------------------------------------------------------


@query
def openapi_operations(t):
    """Operations of parts as controllers."""
    p = lambda kind, name, mark: F.struct(F.lit(kind).alias("type"), F.lit(name).alias("name"), F.array(F.lit(mark)).alias("annotations"))
    returns = F.element_at(F.array(F.lit("void"), F.lit("List<org.Pet>"), F.lit("org.Pet")), (F.col("p_size") % 3 + 1).cast("int"))
    points = t.part.select(F.col("p_partkey").alias("id"), F.concat(F.lit("/x/"), F.col("p_size").cast("string")).alias("path"), F.lit("get").alias("http_method"), F.lit("op").alias("name"), returns.alias("returns"), F.when(F.col("p_size") > 25, F.array(p("Long", "id", "PathVariable"), p("String", "q", "RequestParam"), p("org.Owner<X>", "o", "RequestBody"))).otherwise(F.array(p("int", "n", "Other"))).alias("parameters"))
    return openapi.operations(points)


@query
def entity_schemas(t):
    """customers' fields without the relation."""
    c = _family(t).where("package = 'customer'").withColumn("type", F.lit("Entity")).withColumn("jpa_relationships", F.array(F.struct(F.lit("X").alias("target_class"), F.lit("ManyToOne").alias("relationship_type"), F.lit("name").alias("field_name"))))
    return openapi.schema_rows(c)


@query
def openapi_documents(t):
    """Paths and schemas of each service's document; parts are controllers, regions and nations entities."""
    points = t.part.select(F.concat(F.lit("part."), F.col("p_partkey").cast("string")).alias("id"), F.concat(F.lit('/"x"/'), F.col("p_size").cast("string")).alias("path"), F.lit("get").alias("http_method"), F.concat(F.lit('op"'), F.col("p_partkey").cast("string")).alias("name"), F.lit("void").alias("returns"), F.array().cast("array<struct<type:string,name:string,annotations:array<string>>>").alias("parameters"))
    c = _family(t).where("package <> 'customer'").withColumn("type", F.lit("Entity")).withColumn("jpa_relationships", F.array(F.struct(F.lit("X").alias("target_class"), F.lit("ManyToOne").alias("relationship_type"), F.lit("code").alias("field_name"))))
    key = F.regexp_extract("id", r"(\d+)$", 1).cast("long") % 3
    a = c.select("id", key.alias("cluster_id")).unionByName(points.select("id", key.alias("cluster_id")))
    return openapi.document_parts(points, openapi.entity_schemas(c), a, t.part.select(F.concat(F.lit("part."), F.col("p_partkey").cast("string")).alias("id"), F.col("p_partkey").alias("seq")))


@query
def spec_documents(t):
    """Customers are entities that extend nations (services), which extend regions (controllers); clusters are key modulo 3, the shared one holds keys divisible by 3."""
    source = F.when(F.col("package") == "region", '@RequestMapping("/r") class R').when(F.col("package") == "customer", F.concat(F.lit("@ManyToOne private Nation home; //"), "simple_name"))
    c = _family(t).withColumn("type", F.element_at(F.create_map(*map(F.lit, ["customer", "Entity", "nation", "Service", "region", "Controller"])), F.col("package"))).withColumn("source", source)
    a = c.select("id", (F.regexp_extract("id", r"(\d+)$", 1).cast("long") % 3).alias("cluster_id"))
    names = t.spark.sql("SELECT * FROM VALUES (0L, 'shared-service'), (1L, 'one-service'), (2L, 'two-service') AS v(cluster_id, name)")
    both = hierarchy.resolve_superclasses(c).where("parent LIKE 'region%'").select(F.col("id").alias("src"), F.col("parent").alias("dst"), F.lit("INHERITS").alias("type"), F.lit(1.0).alias("weight"), F.concat(F.lit("m"), F.regexp_extract("id", r"(\d+)$", 1)).alias("method_name"))
    boundary = clusters.boundary_edges(both, a, names)
    return specs.components(c, boundary, a, names).select("cluster_id", "part", "key", "doc")


@query
def bpe_token_usage(t):
    """Tokens of every document by a byte-pair vocabulary, and what of a context they take."""
    u = tokens.usage(t.documents.select("doc_id", "text"), F.lit("gpt-4"))
    return u.select("doc_id", "tokens", "max_context", "available_input", "fits", "fits_with_margin", "utilization_percent")


@query
def component_specs(t):
    """H3: nations as services, by region."""
    c = nodes(t, "nation").withColumn("methods", F.array(F.struct(F.lower("simple_name").alias("name"))))
    s = hierarchy.component_specs(c, assignment(t), "Service")
    return s.select("cluster_id", F.size("components").cast("long").alias("n"), F.array_join(F.transform("components", lambda x: x["name"]), ",").alias("names"))


@query
def shared_users(t):
    """Clusters of the family that extend a class of the shared one."""
    a = _family(t).select("id", F.when(F.col("package") == "region", 99).otherwise(F.regexp_extract("id", r"(\d+)$", 1).cast("long") % 3).alias("cluster_id"))
    names = t.spark.sql("SELECT * FROM VALUES (99L, 'shared-service'), (0L, 'a'), (1L, 'b'), (2L, 'c') AS v(cluster_id, name)")
    return hierarchy.uses_shared(_family(t), a, names)


@query
def missing_components(t):
    """Every fourth nation has no file, every fifth an empty controller."""
    expected = t.nation.select(F.when(F.col("n_nationkey") % 2 == 0, "Controller").otherwise("Entity").alias("kind"), F.col("n_name").alias("name"))
    body = F.when(F.col("n_nationkey") % 5 == 0, " \n ").otherwise(" int a; ")
    files = t.nation.where("n_nationkey % 4 > 0").select(F.col("n_name").alias("stem"), F.concat(F.lit("public class X {"), body, F.lit("}")).alias("source"))
    return openapi.missing_components(expected, files)


@query
def source_blocks(t):
    """Nations as files of their regions."""
    return openapi.as_blocks(t.nation.select(F.col("n_regionkey").alias("service"), F.concat("n_name", F.lit(".yml")).alias("name"), F.col("n_name").alias("source")))


@query
def service_states(t):
    """The farthest state of each user's events taken as transitions."""
    state = F.element_at(F.array(*map(F.lit, ["pending", "compiled", "docker_built", "unknown"])), (F.col("event_id") % 4 + 1).cast("int"))
    return openapi.latest_states(t.events.select(F.col("user_id").alias("service"), F.col("event_id").alias("seq"), state.alias("state")))


@query
def service_calls(t):
    """Boundary edges that leave orders' customers of nation 3."""
    own = t.customer.where("c_nationkey = 3").select(F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("id")).unionByName(nodes(t, "supplier").select("id"))
    return openapi.service_calls(_boundary(t), own).groupBy("to_service").agg(F.count("*").alias("n"))


@query
def sequence_diagrams(t):
    """K9: regions' diagrams over nations and regions."""
    n, e = nodes(t, "region", "nation"), _edges(t, "nation").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    names = t.region.select(F.col("r_regionkey").cast("long").alias("cluster_id"), F.lower("r_name").alias("name"))
    return report.diagrams(n, e, assignment(t), names)


@query
def compose_file(t):
    """K10."""
    s = t.region.select(F.when(F.col("r_regionkey") == 2, "api-gateway").otherwise(F.lower("r_name")).alias("name"), (F.col("r_regionkey") + 8080).alias("port"))
    return report.compose_services(s).select("name", F.col("host_port").cast("long").alias("host_port"), F.length("body").cast("long").alias("chars"))


@query
def gateway_routes(t):
    """E6."""
    return report.routes(t.region.select(F.lower("r_name").alias("name")))


@query
def render_tables(t):
    """Sizes, labels and widths for a drawing."""
    n, e = CodeGraph(nodes(t), _edges(t, "customer", "orders")).render_tables()
    return n.select(F.lit("node").alias("of"), "id", "label", F.col("size").cast("double").alias("x")).unionByName(e.select(F.lit("edge").alias("of"), F.col("src").alias("id"), F.col("dst").alias("label"), F.col("width").alias("x")))


@query
def layered_layout(t):
    """Layers and places of customers, nations and regions, ordered once by their predecessors' places."""
    n, e = _place(t)
    return layout.layered(n, e, sweeps=1).select("id", F.round("x", 6).alias("x"), "y")


@query
def plan_rows(t):
    """K3: clusters as the plan document rounds them."""
    r = clusters.dedup_names(clusters.cluster_report(nodes(t, "region", "nation"), _edges(t, "nation"), assignment(t).where("id LIKE 'region%' OR id LIKE 'nation%'")), "base_name", "cluster_id")
    rows = report.cluster_rows(r)
    return rows.select("id", F.size("classes").cast("long").alias("n"), F.round("metrics.internal_cohesion", 3).alias("cohesion"), F.round("metrics.external_coupling", 3).alias("coupling"), F.array_join("entry_points", ",").alias("entry_points"))
