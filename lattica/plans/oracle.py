"""DuckDB SQL for the named queries of :mod:`lattica.plans.queries`."""

from __future__ import annotations

#: Nodes, raw edges, merged edges and clusters of the relational graph, as common table expressions.
NODES = """
nodes AS (
  SELECT r_regionkey::BIGINT AS node_seq, 'region:' || r_regionkey AS id, 'Controller' AS type, 0::BIGINT AS complexity_score, 'region' AS package, r_name AS simple_name FROM region
  UNION ALL SELECT 10000000000000 + n_nationkey, 'nation:' || n_nationkey, 'Service', n_nationkey, 'nation', n_name FROM nation
  UNION ALL SELECT 20000000000000 + c_custkey, 'customer:' || c_custkey, 'Entity', 0, 'customer', c_name FROM customer
  UNION ALL SELECT 30000000000000 + s_suppkey, 'supplier:' || s_suppkey, 'Entity', 0, 'supplier', s_name FROM supplier
  UNION ALL SELECT 40000000000000 + p_partkey, 'part:' || p_partkey, 'Entity', p_size, 'part', p_name FROM part
  UNION ALL SELECT 50000000000000 + o_orderkey, 'orders:' || o_orderkey, 'Repository', 0, 'orders', o_orderpriority FROM orders)"""
RAW = """
raw0 AS (
  SELECT 'nation' AS kind, lpad(n_nationkey::VARCHAR, 12, '0') AS seq, 'nation:' || n_nationkey AS src, 'region:' || n_regionkey AS dst, 'INHERITS' AS type FROM nation
  UNION ALL SELECT 'customer', lpad(c_custkey::VARCHAR, 12, '0'), 'customer:' || c_custkey, 'nation:' || c_nationkey, 'INHERITS' FROM customer
  UNION ALL SELECT 'supplier', lpad(s_suppkey::VARCHAR, 12, '0'), 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'INHERITS' FROM supplier
  UNION ALL SELECT 'orders', lpad(o_orderkey::VARCHAR, 12, '0'), 'orders:' || o_orderkey, 'customer:' || o_custkey, 'CALLS' FROM orders
  UNION ALL SELECT 'lineitem', strftime(l_shipdate, '%Y%m%d') || lpad(l_orderkey::VARCHAR, 12, '0') || lpad(l_linenumber::VARCHAR, 12, '0') || l_returnflag, 'supplier:' || l_suppkey, 'part:' || l_partkey,
    CASE l_returnflag WHEN 'A' THEN 'IMPORTS' WHEN 'N' THEN 'CALLS' ELSE 'INHERITS' END FROM lineitem),
raw AS (SELECT *, CASE type WHEN 'INHERITS' THEN 10.0::DOUBLE WHEN 'CALLS' THEN 5.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM raw0)"""
EDGES = RAW + """,
by_type AS (SELECT kind, src, dst, type, sum(weight) AS w, min(seq) AS s FROM raw GROUP BY ALL),
edges AS (SELECT kind, src, dst, arg_min(type, s) AS type, sum(w) AS weight, string_agg(type, ',' ORDER BY s) AS types FROM by_type GROUP BY kind, src, dst)"""
CLUSTERS = """
assigned AS (
  SELECT 'region:' || r_regionkey AS id, r_regionkey::BIGINT AS c FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, n_regionkey FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 'supplier:' || s_suppkey, n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT 'part:' || p_partkey, p_size % 5 FROM part
  UNION ALL SELECT 'orders:' || o_orderkey, n_regionkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""
CROSS = f"""{EDGES}, {CLUSTERS},
linked AS (SELECT e.*, a.c AS cs, b.c AS cd FROM edges e JOIN assigned a ON a.id = e.src JOIN assigned b ON b.id = e.dst)"""
REPORT = f"""{NODES}, {CROSS},
n AS (SELECT c, count(*) AS n, sum(complexity_score)::BIGINT AS score FROM assigned JOIN nodes USING (id) GROUP BY c),
ins AS (SELECT cs AS c, count(*) AS k FROM linked WHERE cs = cd GROUP BY cs),
outs AS (SELECT c, sum(k) AS k FROM (SELECT cs AS c, count(*) AS k FROM linked WHERE cs <> cd GROUP BY cs UNION ALL SELECT cd, count(*) FROM linked WHERE cs <> cd GROUP BY cd) GROUP BY c),
report AS (SELECT c, n.n, score, CASE WHEN n.n > 1 THEN coalesce(ins.k, 0) / (n.n * (n.n - 1) / 2) ELSE 0 END AS cohesion, coalesce(outs.k, 0) / n.n AS coupling
           FROM n LEFT JOIN ins USING (c) LEFT JOIN outs USING (c))"""
PAIRS = f"""{NODES}, {EDGES},
ends AS (SELECT e.*, a.node_seq AS sa, b.node_seq AS sb, a.type AS ta, b.type AS tb,
           weight * ((CASE WHEN contains(types, 'CALLS') THEN 2 ELSE 0 END) + (CASE WHEN contains(types, 'INHERITS') THEN 3 ELSE 0 END) + (CASE WHEN contains(types, 'IMPORTS') THEN 0.5 ELSE 0 END))::DOUBLE AS st
         FROM edges e JOIN nodes a ON a.id = src JOIN nodes b ON b.id = dst WHERE src <> dst),
pairs AS (SELECT CASE WHEN sa < sb THEN src ELSE dst END AS a, CASE WHEN sa < sb THEN dst ELSE src END AS b, kind, least(sum(st) / 10, 1.0)::DOUBLE AS structural,
            max(CASE WHEN sa < sb AND ta = 'Entity' AND tb = 'Entity' AND weight > 5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS gravity FROM ends GROUP BY ALL)"""
RING = """
ring AS (
  SELECT 'vec:' || lpad(a.vec_id::VARCHAR, 8, '0') AS a, 'vec:' || lpad(b.vec_id::VARCHAR, 8, '0') AS b, a.label AS la, b.label AS lb, a.embedding::DOUBLE[] AS u, b.embedding::DOUBLE[] AS v
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
rp AS (SELECT a, b, u, v, CASE WHEN la = lb THEN 1.0::DOUBLE WHEN la < lb THEN 1.0::DOUBLE ELSE 0.05::DOUBLE END AS structural,
         CASE WHEN la % 2 = 0 AND lb % 2 = 0 AND la = lb THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS gravity FROM ring)"""
FAMILY = """
parents AS (
  SELECT 'nation.nation' || n_nationkey AS id, 'region' || n_regionkey AS sup, NULL AS parent FROM nation WHERE false
  UNION ALL SELECT 'nation.nation' || n_nationkey, 'region' || n_regionkey, 'region.region' || n_regionkey FROM nation
  UNION ALL SELECT 'customer.customer' || c_custkey, NULL, 'nation.nation' || c_nationkey FROM customer),
chain AS (
  SELECT id, parent AS ancestor, 1::BIGINT AS depth FROM parents
  UNION ALL SELECT p.id, q.parent, 2 FROM parents p JOIN parents q ON q.id = p.parent)"""
FIELDS = f"""{FAMILY},
own AS (
  SELECT 'region.region' || r_regionkey AS id, unnest([0, 1]) AS k, unnest(['id', 'name']) AS name, unnest(['int', 'String']) AS type FROM region
  UNION ALL SELECT 'nation.nation' || n_nationkey, unnest([0, 1]), unnest(['name', 'code']), unnest(['String', 'int']) FROM nation
  UNION ALL SELECT 'customer.customer' || c_custkey, unnest([0, 1]), unnest(['acctbal', 'name']), unnest(['double', 'String']) FROM customer),
allf AS (SELECT id, 0 AS depth, k, name, type FROM own UNION ALL SELECT c.id, c.depth, o.k, o.name, o.type FROM chain c JOIN own o ON o.id = c.ancestor),
once AS (SELECT * FROM allf QUALIFY row_number() OVER (PARTITION BY id, name ORDER BY depth, k) = 1),
fields AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY depth, k) - 1 AS pos, name, type, depth > 0 AS inherited FROM once)"""

ORACLE: dict[str, str] = {
    "edge_merge": f"WITH {EDGES} SELECT src, dst, type, weight, types FROM edges WHERE kind = 'lineitem'",
    "node_classify": """
WITH x AS (SELECT 'part' AS of, p_partkey AS k, p_type AS mark, split_part(p_name, ' ', -1) AS name FROM part
           UNION ALL SELECT 'event', event_id, event_type || 'Service', event_type FROM events)
SELECT of, k, CASE WHEN contains(lower(mark), 'controller') THEN 'Controller' WHEN contains(lower(mark), 'service') THEN 'Service' WHEN regexp_matches(lower(mark), 'entity|table') THEN 'Entity'
  WHEN regexp_matches(lower(mark), 'repository|dao') THEN 'Repository' WHEN regexp_matches(lower(name), 'service$') THEN 'Service' WHEN regexp_matches(lower(name), 'controller$') THEN 'Controller'
  WHEN regexp_matches(lower(name), '(entity|model)$') THEN 'Entity' WHEN regexp_matches(lower(name), 'utils?$') THEN 'Utility' ELSE 'Unknown' END AS type,
  CASE WHEN lower(name) IN ('entity', 'table') THEN 'Entity' WHEN k % 3 = 0 THEN 'Interface' ELSE 'Class' END AS class_type FROM x""",
    "node_type_counts": f"WITH {NODES} SELECT type, count(*) AS n FROM nodes GROUP BY type",
    "complexity_by_package": f"WITH {NODES} SELECT package, sum(complexity_score)::BIGINT AS complexity, count(*) AS n, max(simple_name) AS last_name FROM nodes GROUP BY package",
    "keep_last_node": """
WITH x AS (SELECT l_suppkey::VARCHAR AS id, l_orderkey * 100000000 + l_partkey * 100 + l_linenumber AS s, l_partkey AS part FROM lineitem)
SELECT id, min(s) AS node_seq, arg_max(part, s) AS part FROM x GROUP BY id""",
    "placeholder_nodes": """
SELECT 'customer:' || c_custkey AS id, 'Entity' AS type, 'customer' AS package FROM customer
UNION ALL SELECT 'nation:' || n_nationkey, CASE WHEN n_nationkey % 2 = 1 THEN 'Service' ELSE 'Unknown' END, CASE WHEN n_nationkey % 2 = 1 THEN 'nation' END FROM nation
UNION ALL SELECT DISTINCT 'region:' || n_regionkey, 'Unknown', NULL FROM nation""",
    "degree_stats": f"WITH {EDGES} SELECT id, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree FROM (SELECT src AS id, 1 AS o, 0 AS i FROM edges UNION ALL SELECT dst, 0, 1 FROM edges) GROUP BY id",
    "induced_subgraph": """
SELECT 'node' AS kind, 'customer:' || c_custkey AS id, '' AS dst FROM customer WHERE c_acctbal > 0 UNION ALL SELECT 'node', 'nation:' || n_nationkey, '' FROM nation
UNION ALL SELECT 'edge', 'customer:' || c_custkey, 'nation:' || c_nationkey FROM customer WHERE c_acctbal > 0""",
    "dependents_of": "SELECT 'customer:' || c_custkey AS id FROM customer WHERE c_nationkey = 7 UNION SELECT 'supplier:' || s_suppkey FROM supplier WHERE s_nationkey = 7",
    "dependencies_of": "SELECT DISTINCT 'part:' || l_partkey AS id FROM lineitem WHERE l_suppkey = 3",
    "library_filter": "SELECT page_id, 'javac.' || page_id AS name, page_id::VARCHAR AS last FROM pages WHERE page_id % 3 = 2",
    "ignored_paths": r"""
WITH p AS (SELECT page_id, regexp_replace(url, '^\w+://', '') AS path FROM pages)
SELECT page_id, contains(path, 'en/') OR contains(path, 'fr/1*') AS loose, regexp_matches(path, '^(.*/)?en/.*$') OR regexp_matches(path, '^(.*/)?fr/1[^/]*$') AS strict FROM p""",
    "boundary_edges": f"WITH {CROSS} SELECT 'service-' || cs AS from_service, 'service-' || cd AS to_service, count(*) AS edges, sum(weight) AS weight FROM linked WHERE cs <> cd GROUP BY cs, cd",
    "cluster_report": f"""WITH {REPORT},
kinds AS (SELECT c, type, count(*) AS k, min(node_seq) AS s FROM assigned JOIN nodes USING (id) GROUP BY c, type),
top AS (SELECT c, type FROM kinds QUALIFY row_number() OVER (PARTITION BY c ORDER BY k DESC, s) = 1)
SELECT c AS cluster_id, n AS class_count, round(cohesion, 6) AS internal_cohesion, round(coupling, 6) AS external_coupling, score AS complexity_score, type AS dominant_type FROM report JOIN top USING (c)""",
    "cluster_report_stack": f"""WITH {REPORT},
stack AS (SELECT c, (max((coalesce(type, 'Unknown') = 'Entity')::INT) + max((type = 'Controller')::INT) + max((type = 'Repository')::INT)) / 3.0 AS complete FROM assigned LEFT JOIN nodes USING (id) GROUP BY c)
SELECT c AS cluster_id, n AS class_count, 1::BIGINT AS packages, round(greatest(cohesion, 0.5 + 0.5 * complete), 6)::DOUBLE AS internal_cohesion, round(coupling, 6) AS external_coupling FROM report JOIN stack USING (c)""",
    "service_names": """
WITH x AS (SELECT p_partkey, lower(split_part(p_type, '.', -1)) || '-service' AS base, lower(p_type) || '-service' AS same FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY p_partkey) AS n FROM x)
SELECT p_partkey, CASE WHEN n = 1 THEN base ELSE base || '-' || n END AS name, base = same AS by_package FROM r""",
    "warnings": f"""WITH {REPORT}
SELECT 'HIGH_COUPLING' AS kind, 'service-' || c AS service, round(coupling, 6)::DOUBLE AS number FROM report WHERE coupling > 5
UNION ALL SELECT 'LOW_COHESION', 'service-' || c, round(cohesion, 6)::DOUBLE FROM report WHERE cohesion < 0.3
UNION ALL SELECT 'MANY_BOUNDARY_CALLS', 'service-' || cs, count(*)::DOUBLE FROM linked WHERE cs <> cd GROUP BY cs HAVING count(*) > 10""",
    "recommend_order": f"""WITH {REPORT},
one AS (SELECT * FROM report ORDER BY coupling, c LIMIT 1),
two AS (SELECT * FROM report WHERE c IN (SELECT cs FROM linked, one WHERE cd = one.c AND cs <> cd) ORDER BY coupling, c LIMIT 1)
SELECT 1::INT AS step, 'Start with service-' || c AS title, round(coupling, 6)::DOUBLE AS number FROM one
UNION ALL SELECT 2, 'Extract service-' || c || ' second', round(coupling, 6)::DOUBLE FROM two
UNION ALL SELECT 3, 'Create shared DTOs', NULL WHERE EXISTS (SELECT 1 FROM linked WHERE cs <> cd)""",
    "pair_priority": f"""WITH {CROSS} SELECT 'service-' || cs AS from_service, 'service-' || cd AS to_service, count(*) AS calls, min(src) AS first_class, CASE WHEN count(*) > 3 THEN 'HIGH' ELSE 'MEDIUM' END AS priority
FROM linked WHERE cs <> cd GROUP BY cs, cd""",
    "first_calls": f"""WITH {EDGES}, {CLUSTERS},
firsts AS (SELECT kind, src, dst, min(s) AS s FROM by_type GROUP BY ALL),
crossing AS (SELECT e.src, e.dst, e.type, f.s, a.c AS cs, b.c AS cd FROM edges e JOIN firsts f USING (kind, src, dst) JOIN assigned a ON a.id = e.src JOIN assigned b ON b.id = e.dst WHERE a.c <> b.c),
counted AS (SELECT *, count(*) OVER (PARTITION BY cs, cd) AS calls, row_number() OVER (PARTITION BY cs, cd ORDER BY s, src, dst) AS i FROM crossing)
SELECT 'service-' || cs AS from_service, 'service-' || cd AS to_service, src AS from_class, dst AS to_class, type AS method, calls, CASE WHEN calls > 3 THEN 'HIGH' ELSE 'MEDIUM' END AS priority FROM counted WHERE i = 1""",
    "single_service": "SELECT 'customer:' || c_custkey AS id, 0::BIGINT AS cluster_id, 'monolith-service' AS name FROM customer UNION ALL SELECT 'nation:' || n_nationkey, 0, 'monolith-service' FROM nation",
    "called_methods": "SELECT user_id::VARCHAR AS to_service, coalesce(string_agg(event_type, ',' ORDER BY event_type) FILTER (value > 50), '') AS methods FROM events GROUP BY user_id",
    "package_summary": "SELECT source AS package, lang AS type, count(*) AS n FROM documents GROUP BY source, lang",
    "package_proposal": "WITH f AS (SELECT source, row_number() OVER (ORDER BY min(doc_id)) - 1 AS cluster_id FROM documents GROUP BY source) SELECT doc_id::VARCHAR AS id, cluster_id FROM documents JOIN f USING (source)",
    "proposal_assignment": """
WITH s AS (SELECT n_nationkey AS k, n_nationkey % 3 AS c FROM nation WHERE n_nationkey < 15 UNION ALL SELECT n_nationkey, n_regionkey + 3 FROM nation WHERE n_nationkey BETWEEN 10 AND 19),
b AS (SELECT k, max(c) AS c FROM s GROUP BY k)
SELECT 'nation:' || k AS id, c::BIGINT AS cluster_id FROM b
UNION ALL SELECT 'nation:' || n_nationkey, (SELECT max(c) FROM b) + row_number() OVER (ORDER BY n_nationkey) FROM nation WHERE n_nationkey NOT IN (SELECT k FROM b)""",
    "domain_split": "SELECT CASE WHEN o_orderpriority[1] IN ('1', '2') THEN 'domain' ELSE 'excluded' END AS part, o_orderpriority AS simple_name, count(*) AS n FROM orders GROUP BY ALL",
    "chunk_100": "SELECT (rn // 100)::BIGINT AS chunk, count(*) AS n, min(c_custkey) AS first FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS rn FROM customer) GROUP BY rn // 100",
    "port_assignment": """
WITH s AS (SELECT CASE WHEN s_suppkey = 1 THEN 'api-gateway' ELSE s_name END AS name FROM supplier)
SELECT name, (row_number() OVER (ORDER BY (name <> 'api-gateway')::INT, name) - 1 + 18080)::BIGINT AS host_port FROM s""",
    "structural_weight": f"WITH {PAIRS} SELECT a, b, round(structural, 6) AS structural FROM pairs WHERE kind = 'lineitem'",
    "data_gravity": f"WITH {PAIRS} SELECT a, b, gravity FROM pairs WHERE kind = 'lineitem'",
    "hybrid_weights": f"""WITH {RING}, w AS (SELECT a, b, 0.5 * structural + 0.2 * list_cosine_similarity(u, v) + 0.3 * gravity AS weight FROM rp)
SELECT a, b, round(weight, 5)::DOUBLE AS weight FROM w WHERE weight > 0""",
    "layered_layout": """
WITH e AS (SELECT 'customer:' || c_custkey AS a, 'nation:' || c_nationkey AS b FROM customer UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey FROM nation),
l1 AS (SELECT 'nation:' || n_nationkey AS id, n_regionkey, CASE WHEN n_nationkey IN (SELECT c_nationkey FROM customer) THEN 1 ELSE 0 END AS y FROM nation),
l AS (SELECT 'customer:' || c_custkey AS id, 0 AS y FROM customer UNION ALL SELECT id, y FROM l1 UNION ALL SELECT 'region:' || r_regionkey, coalesce(max(y) + 1, 0) FROM region LEFT JOIN l1 ON n_regionkey = r_regionkey GROUP BY r_regionkey),
f AS (SELECT id, y, (row_number() OVER (PARTITION BY y ORDER BY id) - 0.5::DOUBLE) / count(*) OVER (PARTITION BY y) AS x FROM l),
m AS (SELECT b AS id, round(avg(x), 9) AS m FROM e JOIN f ON f.id = e.a GROUP BY b)
SELECT id, round((row_number() OVER (PARTITION BY y ORDER BY coalesce(m, x), id) - 0.5::DOUBLE) / count(*) OVER (PARTITION BY y), 6) AS x, y::DOUBLE AS y FROM f LEFT JOIN m USING (id)""",
    "prefix_constraints": """
WITH n AS (SELECT 'orders:' || o_orderkey AS id FROM orders UNION ALL SELECT 'customer:' || c_custkey FROM customer),
lit AS (SELECT s_suppkey AS g, 'orders:' || (s_suppkey * 3) AS id FROM supplier WHERE s_suppkey % 7 = 0 UNION ALL SELECT s_suppkey, 'nothing:' || s_suppkey FROM supplier WHERE s_suppkey % 10 = 0),
pre AS (SELECT s_suppkey AS g, CASE WHEN s_suppkey % 9 = 0 THEN 'customer:' ELSE 'orders:' END || s_suppkey AS p FROM supplier WHERE s_suppkey % 10 > 0),
hit AS (SELECT g, id FROM pre JOIN n ON starts_with(id, p) UNION SELECT g, id FROM lit),
big AS (SELECT g FROM hit GROUP BY g HAVING count(*) > 1)
SELECT id, 'super:' || max(g) AS super FROM hit JOIN big USING (g) JOIN n USING (id) GROUP BY id""",
    "constraint_contract": f"""WITH {RING},
m AS (SELECT DISTINCT a AS id, CASE WHEN a IN ('vec:00000005') THEN 'super:2' WHEN starts_with(a, 'vec:0000000') THEN 'super:0' WHEN a IN ('vec:00000020', 'vec:00000021') THEN 'super:1' ELSE a END AS s
      FROM (SELECT a FROM ring UNION SELECT b FROM ring)),
c AS (SELECT x.s AS a, y.s AS b, structural FROM rp JOIN m x ON x.id = rp.a JOIN m y ON y.id = rp.b WHERE x.s <> y.s)
SELECT least(a, b) AS a, greatest(a, b) AS b, round(sum(structural), 6) AS weight FROM c GROUP BY 1, 2""",
    "modularity": f"""WITH {PAIRS}, {CLUSTERS},
l AS (SELECT p.structural AS w, x.c AS ca, y.c AS cb FROM pairs p JOIN assigned x ON x.id = p.a JOIN assigned y ON y.id = p.b WHERE kind IN ('customer', 'supplier', 'nation')),
t AS (SELECT sum(w) AS m FROM l),
d AS (SELECT c, sum(d) AS d, sum(i) AS i FROM (SELECT ca AS c, w AS d, CASE WHEN ca = cb THEN w ELSE 0 END AS i FROM l UNION ALL SELECT cb, w, 0 FROM l) GROUP BY c)
SELECT round(sum(i / m - (d / (2 * m)) * (d / (2 * m))), 6) AS modularity FROM d, t""",
    "wcc": """
WITH n AS (SELECT n_nationkey, 'region:' || n_regionkey AS r FROM nation),
m AS (SELECT n.r, min(x) AS component FROM n JOIN (SELECT r, 'nation:' || n_nationkey AS x FROM n UNION ALL SELECT r, r FROM n UNION ALL SELECT r, 'customer:' || c_custkey FROM customer JOIN n ON n_nationkey = c_nationkey) y USING (r) GROUP BY n.r)
SELECT 'customer:' || c_custkey AS id, component FROM customer JOIN n ON n_nationkey = c_nationkey JOIN m USING (r)
UNION ALL SELECT 'nation:' || n_nationkey, component FROM n JOIN m USING (r) UNION ALL SELECT r, component FROM m""",
    "girvan_newman": """
WITH RECURSIVE e AS (SELECT 'nation:' || n_nationkey AS a, 'region:' || n_regionkey AS b FROM nation UNION ALL SELECT 'region:' || r_regionkey, 'region:' || (r_regionkey + 1) FROM region WHERE r_regionkey < 4),
arc AS (SELECT a AS v, b AS w FROM e UNION ALL SELECT b, a FROM e),
walk AS (SELECT v AS s, w AS v, v AS prev FROM arc UNION ALL SELECT walk.s, arc.w, arc.v FROM walk JOIN arc ON arc.v = walk.v WHERE arc.w <> walk.prev),
side AS (SELECT prev, v, count(*) AS n FROM walk GROUP BY ALL),
score AS (SELECT x.prev AS a, x.v AS b, x.n * y.n AS score FROM side x JOIN side y ON y.prev = x.v AND y.v = x.prev WHERE x.prev < x.v),
cut AS (SELECT a, b FROM score ORDER BY score DESC, a, b LIMIT 1),
kept AS (SELECT arc.* FROM arc, cut WHERE NOT (least(v, w) = cut.a AND greatest(v, w) = cut.b)),
reach AS (SELECT v AS s, w AS v, v AS prev FROM kept UNION ALL SELECT reach.s, kept.w, kept.v FROM reach JOIN kept ON kept.v = reach.v WHERE kept.w <> reach.prev),
leader AS (SELECT id, least(id, coalesce(min(reach.v), id)) AS l FROM (SELECT DISTINCT v AS id FROM arc) LEFT JOIN reach ON reach.s = id GROUP BY id)
SELECT id, (dense_rank() OVER (ORDER BY l) - 1)::BIGINT AS cluster_id FROM leader""",
    "scc": """
SELECT 'customer:' || c_custkey AS id, 'customer:' || c_custkey AS component FROM customer UNION ALL SELECT 'supplier:' || s_suppkey, 'supplier:' || s_suppkey FROM supplier
UNION ALL SELECT 'region:' || r_regionkey, 'region:' || r_regionkey FROM region
UNION ALL SELECT 'nation:' || n_nationkey, min('nation:' || n_nationkey) OVER (PARTITION BY n_regionkey) FROM nation""",
    "is_dag": "SELECT 'references' AS graph, true AS is_dag UNION ALL SELECT 'with cycles', false",
    "graph_statistics": """
SELECT ((SELECT count(*) FROM customer) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM region))::BIGINT AS node_count, ((SELECT count(*) FROM customer) + (SELECT count(*) FROM nation))::BIGINT AS edge_count, true AS is_dag,
  ((SELECT count(*) FROM customer) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM region))::BIGINT AS strongly_connected_components, (SELECT count(*) FROM region) AS weakly_connected_components, 3::INT AS n_types""",
    "cosine_pairs": """
SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id
WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.3""",
    "top_k_similar": """
WITH m AS (SELECT q.vec_id AS query, v.vec_id AS id, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS s FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0)
SELECT query, row_number() OVER (PARTITION BY query ORDER BY s DESC, id) AS rank, id, round(s, 4) AS similarity FROM m QUALIFY rank <= 10""",
    "vector_similarity": """
WITH p(a, b) AS (VALUES (3, 7), (7, 3), (12, 40), (5, 5), (1, -1))
SELECT p.a::BIGINT AS a, p.b::BIGINT AS b, CASE WHEN p.a = p.b THEN 0.0 ELSE coalesce(round(list_cosine_similarity(u.embedding::DOUBLE[], v.embedding::DOUBLE[]), 4), 0.0) END::DOUBLE AS similarity
FROM p LEFT JOIN embeddings u ON u.vec_id = p.a LEFT JOIN embeddings v ON v.vec_id = p.b""",
    "fixed_files": """
SELECT doc_id AS id, 0::BIGINT AS pos, 'src/' || doc_id || '.java' AS file, '// ' || source AS body FROM documents
UNION ALL SELECT doc_id, 1, doc_id || '.yml', 'lang: ' || lang FROM documents""",
    "annotation_values": "SELECT p_partkey, p_name AS value FROM part",
    "embed_texts": "SELECT doc_id::VARCHAR AS id, md5(text) AS file_hash, CASE WHEN doc_id % 3 = 1 THEN 1 ELSE 384 END::BIGINT AS dimensions FROM documents",
    "resolve_superclass": f"WITH {FAMILY} SELECT id, parent FROM parents",
    "inherited_closure": f"WITH {FAMILY} SELECT id, ancestor, depth FROM chain",
    "inherited_fields": f"WITH {FIELDS} SELECT id, pos, name, type, inherited FROM fields",
    "entity_specs": f"""WITH {FIELDS}
SELECT id, split_part(id, '.', 2) AS name, string_agg(name || ':' || type || ':' || CASE WHEN name = 'id' THEN '@Id+@GeneratedValue(strategy = GenerationType.IDENTITY)' ELSE '' END, ',' ORDER BY pos) AS fields,
  coalesce(max(CASE WHEN name = 'id' THEN 'Integer' END), 'Long') AS id_type FROM fields WHERE starts_with(id, 'customer.') GROUP BY id""",
    "external_superclass": rf"WITH {FAMILY} SELECT id, parent FROM parents WHERE regexp_extract(id, '(\d+)$', 1)::BIGINT % 3 <> regexp_extract(parent, '(\d+)$', 1)::BIGINT % 3",
    "changed_docs": """
SELECT doc_id::VARCHAR AS file_path, CASE WHEN doc_id % 5 = 0 THEN 'new' WHEN doc_id % 2 = 0 THEN 'unchanged' ELSE 'changed' END AS state FROM documents
UNION ALL SELECT 'page' || page_id, 'deleted' FROM pages""",
    "upsert_docs": "SELECT doc_id::VARCHAR AS file_path, CASE WHEN doc_id % 3 = 0 THEN md5(text) ELSE 'old' END AS content_hash FROM documents WHERE (doc_id % 2 = 0 OR doc_id % 3 = 0) AND doc_id % 10 <> 4",
    "llm_cost_ledger": """
WITH c AS (SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN (length(text) // 4) * (60.0::DOUBLE / 1000000) ELSE (length(text) // 4) * (5.0::DOUBLE / 1000000) END AS cost FROM conversations),
s AS (SELECT *, sum(cost) OVER (PARTITION BY conv_id ORDER BY turn) AS total FROM c)
SELECT conv_id AS budget, turn AS seq, round(cost, 8) AS cost, round(total, 8) AS total, total <= 0.02 AS accepted FROM s""",
    "llm_greedy_ledger": """
WITH RECURSIVE c AS (SELECT conv_id, turn, (length(text) // 4)::DOUBLE AS cost, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
f AS (SELECT conv_id, turn, i, cost <= 300 AS accepted, CASE WHEN cost <= 300 THEN cost ELSE 0 END AS total FROM c WHERE i = 1
      UNION ALL SELECT c.conv_id, c.turn, c.i, f.total + c.cost <= 300, CASE WHEN f.total + c.cost <= 300 THEN f.total + c.cost ELSE f.total END FROM f JOIN c ON c.conv_id = f.conv_id AND c.i = f.i + 1)
SELECT conv_id AS budget, turn AS seq, accepted, total::DOUBLE AS total FROM f""",
    "llm_cost_report": """
WITH x AS (SELECT sum(length(text) // 4)::BIGINT AS t FROM conversations)
SELECT t AS total_tokens, round(t * (5.0::DOUBLE / 1000000), 4) AS total_cost, 5.0::DOUBLE AS cost_limit, round(greatest(0, 5 - t * (5.0::DOUBLE / 1000000)), 4) AS remaining FROM x""",
    "table_name_snake": r"""
WITH x AS (SELECT *, replace(array_to_string(list_transform(string_split(p_type, ' '), lambda w: upper(w[1]) || lower(w[2:])), '') || 'Kind' || regexp_extract(p_brand, '(\d+)', 1), ' ', '') AS camel FROM part)
SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 't' || p_size ELSE lower(camel[1] || regexp_replace(camel[2:], '([A-Z])', '_\1', 'g')) || 's' END AS table_name,
  CASE WHEN p_size > 25 THEN 'org.x' ELSE 'com.example.' || replace(lower(p_brand), '-', '') END AS package, CASE WHEN length(p_name) > 12 THEN p_name[1:9] || '...' ELSE p_name END AS short FROM x""",
    "extract_links": """
SELECT page_id, (i - 1)::BIGINT AS pos, l[i] AS href FROM (SELECT page_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]+)"', 1) AS l FROM pages))""",
    "extract_relations": "SELECT p_partkey AS id, 'OneToMany' AS relation, 'P' || p_size AS target, 'many' AS field FROM part UNION ALL SELECT p_partkey, 'ManyToOne', 'Q' || p_partkey, 'one' FROM part",
    "extract_json_props": "SELECT event_id, CASE WHEN event_id % 10 = 0 THEN -1 ELSE (props->>'k')::BIGINT END AS k FROM events",
    "tool_calls": "SELECT event_id AS id, unnest([0, 1])::BIGINT AS pos, event_type AS name FROM events WHERE event_id % 3 <> 0 AND event_id % 5 <> 0",
    "compile_errors": "SELECT o_orderkey AS id, '/src/A' || o_orderkey || '.java' AS file_path, o_custkey % 90 + 1 AS line, 5::BIGINT AS col, 'cannot find symbol' AS message FROM orders",
    "fenced_code": "SELECT n_nationkey, 'key: ' || n_name AS body FROM nation",
    "token_budget": """
SELECT doc_id, (length(text) // 4)::BIGINT AS tokens, length(text) // 4 <= floor((8192 - 4000) * 0.9) AS fits, round_even((length(text) // 4)::DOUBLE / (8192 - 4000) * 100, 1) AS utilization FROM documents""",
    "openapi_type_map": """
SELECT p_partkey, ['integer', 'integer', 'array', 'number', 'integer', 'object', 'boolean'][p_size % 7 + 1] AS api_type, ['Long', 'Integer', 'List<Pet>', 'BigDecimal', 'Point', 'Pet', 'Boolean'][p_size % 7 + 1] AS boxed FROM part""",
    "compose_failure_class": """
SELECT event_id, ['compose_syntax', 'compose_semantic', 'service_build', 'environment_conflict', 'runtime_health', 'unknown', 'unknown'][event_id % 7 + 1] AS failure, event_id % 7 = 5 AS done,
  event_type IN ('healthy', 'approved', 'completed', 'docker_built') AS finished FROM events""",
    "boot_version": "SELECT n_nationkey, CASE WHEN n_nationkey >= 20 THEN '3.2.0' ELSE ['3.2.0', '3.1.5', '3.2.0', '3.2.0', '2.7'][n_nationkey % 5 + 1] END AS version FROM nation",
    "class_text": """
SELECT p_partkey, 'CLASS: ' || p_name || chr(10) || 'TYPE: ' || CASE WHEN p_size % 5 = 0 THEN 'Interface' WHEN p_size % 5 = 1 THEN 'Abstract' ELSE 'Class' END || CASE WHEN p_size % 2 = 0 THEN chr(10) || 'ANNOTATIONS: @Entity, @' || p_brand ELSE '' END
  || chr(10) || 'METHODS:' || chr(10) || '  - get' || p_type || '(long key) -> ' || CASE WHEN p_size > 20 THEN 'int' ELSE 'void' END || chr(10) || 'FIELDS:' || chr(10) || '  - int size' AS text,
  p_name || CASE WHEN p_size % 2 = 0 THEN ' | [@Entity, @' || p_brand || ']' ELSE '' END || ' | methods: get' || p_type AS summary FROM part""",
    "service_ports": "SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey + 9000 ELSE 8080 END AS port FROM supplier",
    "host_ports": "SELECT DISTINCT s_suppkey AS port FROM supplier WHERE s_suppkey % 3 <> 1",
    "invalid_services": """
WITH s AS (SELECT 's' || n_nationkey AS name, 's' || n_regionkey AS dep FROM nation WHERE n_nationkey % 4 > 0)
SELECT 'missing' AS problem, 's' || n_nationkey AS name FROM nation WHERE n_nationkey < 10 AND n_nationkey % 4 = 0
UNION ALL SELECT DISTINCT 'undefined_dependency', dep FROM s WHERE dep NOT IN (SELECT name FROM s)""",
    "compose_health": """
WITH e AS (SELECT 'u' || user_id % 50 AS name, bool_and(value < 99) AS h FROM events GROUP BY 1)
SELECT 'u' || n_nationkey * 3 AS name, coalesce(h, false) AS healthy FROM nation LEFT JOIN e ON e.name = 'u' || n_nationkey * 3""",
    "success_summary": "SELECT count(*) FILTER (quality = 1) AS succeeded, count(*) AS total FROM labels",
    "endpoint_paths": """
WITH m AS (SELECT p_partkey, '/api/' || lower(p_brand) || '/x' AS path, ['get', 'post', NULL][p_size % 3 + 1] AS verb FROM part)
SELECT path, arg_max(verb, p_partkey) AS verbs, 'm' || max(p_partkey) AS names FROM m WHERE verb IS NOT NULL GROUP BY path""",
    "openapi_operations": """
SELECT p_partkey AS id, '/x/' || p_size AS path, 'get' AS http_method, '{"operationId":"op","parameters":' ||
  CASE WHEN p_size > 25 THEN '[{"name":"id","in":"path","required":true,"schema":{"type":"integer"}},{"name":"q","in":"query","required":true,"schema":{"type":"string"}}],"requestBody":{"required":true,"content":{"application/json":{"schema":{"$ref":"#/components/schemas/Owner"}}}}' ELSE '[]' END ||
  ',"responses":{"200":{"description":"OK","content":{"application/json":{"schema":' || ['{}', '{"type":"array","items":{"$ref":"#/components/schemas/Pet"}}', '{"$ref":"#/components/schemas/Pet"}'][p_size % 3 + 1] || '}}}}}' AS operation FROM part""",
    "entity_schemas": """SELECT 'customer' || c_custkey AS name, '{"type":"object","properties":{"acctbal":{"type":"number"}}}' AS schema FROM customer""",
    "openapi_documents": """
WITH p AS (SELECT p_partkey % 3 AS c, '/"x"/' || p_size AS path, max(p_partkey) AS k FROM part GROUP BY ALL)
SELECT c::BIGINT AS cluster_id, 'paths' AS part, path AS key, '{"get":{"operationId":"op\\"' || k || '","parameters":[],"responses":{"200":{"description":"OK","content":{"application/json":{"schema":{}}}}}}}' AS value FROM p
UNION ALL SELECT r_regionkey % 3, 'schemas', 'region' || r_regionkey, '{"type":"object","properties":{"id":{"type":"integer"},"name":{"type":"string"}}}' FROM region
UNION ALL SELECT n_nationkey % 3, 'schemas', 'nation' || n_nationkey, '{"type":"object","properties":{"name":{"type":"string"}}}' FROM nation""",
    "spec_documents": """
WITH names(c, name) AS (VALUES (0, 'shared-service'), (1, 'one-service'), (2, 'two-service')),
e AS (SELECT c_custkey % 3 AS c, c_custkey AS k, c_nationkey AS n FROM customer)
SELECT c::BIGINT AS cluster_id, 'head' AS part, name AS key, '{"name":"' || name || '","base_package":"region","spring_boot_version":"3.2.0","java_version":17,"maven_dependencies":["spring-boot-starter-web","spring-boot-starter-data-jpa","spring-boot-starter-validation","h2","flyway-core"],"depends_on_shared":'
  || (c <> 0 AND (EXISTS (SELECT 1 FROM e WHERE e.c = names.c AND n % 3 = 0) OR EXISTS (SELECT 1 FROM nation WHERE n_nationkey % 3 = names.c AND n_regionkey % 3 = 0)))::VARCHAR || '}' AS doc FROM names
UNION ALL SELECT c, 'entities', 'customer.customer' || k, '{"fqn":"customer.customer' || k || '","simple_name":"customer' || k || '","table_name":"customer' || k || 's","fields":[{"name":"acctbal","type":"double","annotations":[],"is_inherited":false},{"name":"name","type":"String","annotations":[],"is_inherited":false},'
  || '{"name":"code","type":"int","annotations":[],"is_inherited":true},{"name":"id","type":"int","annotations":["@Id","@GeneratedValue(strategy = GenerationType.IDENTITY)"],"is_inherited":true}],'
  || '"relationships":[{"type":"ManyToOne","target_entity":"Nation","field_name":"home","mapped_by":null,"cascade":null,"fetch":null}],"methods":[],"superclass":' || CASE WHEN n % 3 = c THEN 'null' ELSE '"nation.nation' || n || '"' END
  || ',"source_code":"@ManyToOne private Nation home; //customer' || k || '"}' FROM e
UNION ALL SELECT c, 'repositories', 'customer.customer' || k, '{"interface_name":"customer' || k || 'Repository","entity_fqn":"customer.customer' || k || '","entity_simple_name":"customer' || k || '","id_type":"Integer","custom_methods":[]}' FROM e
UNION ALL SELECT n_nationkey % 3, 'services', 'nation.nation' || n_nationkey, '{"fqn":"nation.nation' || n_nationkey || '","simple_name":"nation' || n_nationkey || '","dependencies":[],"methods":[],"source_code":""}' FROM nation
UNION ALL SELECT r_regionkey % 3, 'controllers', 'region.region' || r_regionkey, '{"fqn":"region.region' || r_regionkey || '","simple_name":"region' || r_regionkey || '","base_path":"/r","dependencies":[],"endpoints":[],"source_code":"@RequestMapping(\\"/r\\") class R"}' FROM region
UNION ALL SELECT n_nationkey % 3, 'gateway_clients', t.name, '{"target_service":"' || t.name || '","methods_needed":[' || string_agg('"m' || n_nationkey || '"', ',' ORDER BY 'm' || n_nationkey) || ']}'
  FROM nation JOIN names t ON t.c = n_regionkey % 3 WHERE n_nationkey % 3 <> n_regionkey % 3 GROUP BY n_nationkey % 3, t.name""",
    "component_specs": "SELECT n_regionkey::BIGINT AS cluster_id, count(*) AS n, string_agg(n_name, ',' ORDER BY n_nationkey) AS names FROM nation GROUP BY n_regionkey",
    "shared_users": "SELECT DISTINCT (n_nationkey % 3)::BIGINT AS cluster_id FROM nation",
    "missing_components": """
SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'Controller' ELSE 'Entity' END AS kind, n_name AS name, CASE WHEN n_nationkey % 4 = 0 THEN 'missing' ELSE 'empty body' END AS problem
FROM nation WHERE n_nationkey % 4 = 0 OR (n_nationkey % 2 = 0 AND n_nationkey % 5 = 0)""",
    "source_blocks": "SELECT n_regionkey AS service, string_agg('### ' || n_name || '.yml' || chr(10) || '```yaml' || chr(10) || n_name || chr(10) || '```', chr(10) || chr(10) ORDER BY n_name) AS content FROM nation GROUP BY n_regionkey",
    "service_states": "SELECT user_id AS service, ['pending', 'compiled', 'docker_built'][max(event_id % 4) FILTER (event_id % 4 < 3) + 1] AS state, count(*) FILTER (event_id % 4 < 3) AS iterations FROM events GROUP BY user_id HAVING count(*) FILTER (event_id % 4 < 3) > 0",
    "service_calls": f"WITH {CROSS} SELECT 'service-' || cd AS to_service, count(*) AS n FROM linked WHERE cs <> cd AND (src IN (SELECT 'customer:' || c_custkey FROM customer WHERE c_nationkey = 3) OR starts_with(src, 'supplier:')) GROUP BY cd",
    "sequence_diagrams": """
WITH p AS (SELECT r_regionkey AS r, 'Client' AS short, 'actor' AS kind FROM region UNION ALL SELECT r_regionkey, r_name, 'participant' FROM region UNION ALL SELECT n_regionkey, n_name, 'participant' FROM nation)
SELECT r::BIGINT AS cluster_id, lower(r_name) AS name, '@startuml' || chr(10) || 'title ' || lower(r_name) || ' API Flow' || chr(10) || chr(10) || string_agg(kind || ' "' || short || '"', chr(10) ORDER BY short, kind)
  || chr(10) || chr(10) || 'Client -> region:' || r || ': API Request' || chr(10) || '@enduml' AS diagram FROM p JOIN region ON r = r_regionkey GROUP BY r, r_name""",
    "compose_file": """
WITH s AS (SELECT CASE WHEN r_regionkey = 2 THEN 'api-gateway' ELSE lower(r_name) END AS name, r_regionkey + 8080 AS port FROM region)
SELECT name, (row_number() OVER (ORDER BY (name <> 'api-gateway')::INT, name) - 1 + 18080)::BIGINT AS host_port,
  (2 * length(name) + length('  :' || chr(10) || '    image: :latest' || chr(10) || '    ports:' || chr(10) || '      - "18080:8080"' || chr(10) || '    environment:' || chr(10) || '      - SERVER_PORT=8080' || chr(10) || '    healthcheck:' || chr(10)
   || '      test: ["CMD-SHELL", "wget --spider -q http://localhost:8080/actuator/health || exit 1"]')
   + CASE WHEN name = 'api-gateway' THEN length(chr(10) || '    depends_on:') + (SELECT sum(length(chr(10) || '      ' || name || ':' || chr(10) || '        condition: service_started')) FROM s WHERE name <> 'api-gateway') ELSE 0 END)::BIGINT AS chars FROM s""",
    "gateway_routes": "SELECT lower(r_name) AS name, '/api/' || lower(r_name) || '/**' AS route FROM region",
    "render_tables": f"""WITH {NODES}, {EDGES}
SELECT 'node' AS of, id, CASE WHEN length(simple_name) > 20 THEN simple_name[1:17] || '...' ELSE simple_name END AS label, (2 * complexity_score + 10)::DOUBLE AS x FROM nodes
UNION ALL SELECT 'edge', src, dst, least(weight / 2, 5.0)::DOUBLE FROM edges WHERE kind IN ('customer', 'orders')""",
    "plan_rows": "SELECT n_regionkey::BIGINT AS id, count(*) + 1 AS n, round(count(*) / ((count(*) + 1) * count(*) / 2), 3)::DOUBLE AS cohesion, 0.0::DOUBLE AS coupling, 'region:' || n_regionkey AS entry_points FROM nation GROUP BY n_regionkey",
}
