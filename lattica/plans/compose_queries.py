"""Named queries over YAML text that Spark writes from the tables: a compose file for each customer with orders, in several ways of writing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import compose
from ..sources import yamltext
from ..sources.relational import Tables
from ..sources.scratch import materialize

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
    return f


def compose_texts(t: Tables) -> DataFrame:
    """(file, text): services are a customer's orders, dependencies the order that is 1, 2 or 32 keys before, whether or not it is theirs; every 40th file is broken."""
    k = F.col("o_orderkey")
    name = F.concat(F.lit("o"), k.cast("string"))
    port = (k % 20000 + 10000).cast("string")
    needs = F.concat(F.lit("o"), (k - F.element_at(F.array(F.lit(1), F.lit(2), F.lit(32)), (k % 3 + 1).cast("int"))).cast("string"))
    entry = (
        F.when(k % 5 == 0, F.concat(F.lit('      - "'), port, F.lit(':80"\n')))
        .when(k % 5 == 1, F.concat(F.lit("      - target: 80\n        published: "), port, F.lit("   # fixed\n        protocol: tcp\n")))
        .when(k % 5 == 2, F.concat(F.lit("      - 127.0.0.1:"), port, F.lit(":80/udp\n")))
        .when(k % 5 == 3, F.concat(F.lit("      - '"), port, F.lit("'\n")))
        .otherwise(F.concat(F.lit("      - "), port, F.lit("\n")))
    )
    depends = F.when(k % 4 == 0, F.concat(F.lit("    depends_on: ["), needs, F.lit("]\n"))).when(k % 4 == 1, F.concat(F.lit("    depends_on:\n    - "), needs, F.lit("\n"))).when(k % 4 == 2, F.concat(F.lit("    depends_on:\n      "), needs, F.lit(":\n        condition: service_healthy\n"))).otherwise("")
    body = F.concat(
        F.lit("  "), name, F.lit(":\n"), F.when(k % 7 == 0, "    <<: *common\n").otherwise(F.concat(F.lit('    image: "shop:'), F.col("o_orderstatus"), F.lit('"\n'))),
        F.lit("    labels:\n      note: >-\n        two\n        lines: here\n    ports:\n"), entry, depends,
    )
    whole = F.when(k % 11 == 0, F.concat(F.lit("  "), name, F.lit(": not a mapping\n"))).otherwise(body)
    bodies = t.orders.groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", whole.alias("body")))), lambda x: x["body"]), "").alias("bodies"))  # a customer's orders
    head = F.lit("# written for a customer\nx-common: &common\n  image: base\n  restart: always\nservices:\n")
    broken = F.when(F.col("o_custkey") % 40 == 0, "\tvolumes: none\n").otherwise(F.lit("networks: {}\n"))
    return bodies.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("file"), F.concat(head, "bodies", broken).alias("text"))


def _parsed(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    files = materialize(compose_texts(t), "texts")
    return files, *yamltext.parse(files)


@query
def yaml_scalars(t):
    """Every scalar of the files, counted by its path below a service."""
    _, rows, rejects = _parsed(t)
    below = F.expr("array_join(transform(slice(path, 3, size(path)), x -> IF(x RLIKE '^o?-?[0-9]+$', '*', x)), '.')")
    rows = rows.where("path[0] = 'services'").groupBy(below.alias("setting"), "kind").agg(F.count("*").alias("n"), F.count_distinct("value").alias("n_values"))
    return rows.unionByName(rejects.groupBy(F.lit("").alias("setting"), F.col("problem").alias("kind")).agg(F.count("*").alias("n"), F.lit(0).cast("long").alias("n_values")))


@query
def compose_ports(t):
    """Entries of ports, short and long."""
    _, rows, _ = _parsed(t)
    return compose.ports(rows).select("file", "service", "form", "host", "published", "target", "protocol")


@query
def compose_host_ports(t):
    """S13."""
    _, rows, _ = _parsed(t)
    return compose.host_ports(rows)


@query
def compose_problems(t):
    """Files against the services that are expected, the orders of a customer and one more for every third."""
    files, rows, rejects = _parsed(t)
    file = F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("file")
    expected = t.orders.select(file, F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("name")).unionByName(t.orders.where("o_custkey % 3 = 0").select(file, F.lit("api-gateway").alias("name")).distinct())
    return compose.problems(files, rows, rejects, expected)


@query
def compose_waves(t):
    """When each service can start; -1: never."""
    _, rows, _ = _parsed(t)
    return compose.start_order(rows).select("file", "service", F.coalesce("wave", F.lit(-1).cast("long")).alias("wave"))


@query
def discovered_services(t):
    """Suppliers as folders; configurations name a port plainly, quoted, by a placeholder, in a second place or not at all."""
    k = F.col("s_suppkey")
    text = (
        F.when(k % 6 == 0, F.concat(F.lit("spring:\n  application:\n    name: s\nserver:\n  port: "), (k + 9000).cast("string"), F.lit(" # plain\n")))
        .when(k % 6 == 1, F.concat(F.lit("server.port: "), (k + 9000).cast("string"), F.lit("\nmanagement:\n  port: 1\n")))
        .when(k % 6 == 2, F.concat(F.lit('server: {port: "'), (k + 9000).cast("string"), F.lit('"}\n')))
        .when(k % 6 == 3, "server:\n  port: ${PORT:8081}\n---\nserver:\n  port: 8082\n")
        .when(k % 6 == 4, "server:\n")
    )
    folder = F.concat(F.lit("s"), k.cast("string"))
    files = t.supplier.select(F.concat(folder, F.lit("/" + compose.CONFIGURATION)).alias("path"), text.alias("text")).where("text IS NOT NULL")
    files = files.unionByName(t.supplier.where("s_suppkey % 10 < 9").select(F.concat(folder, F.lit("/Dockerfile")).alias("path"), F.lit("FROM scratch").alias("text")))
    return compose.discover(files)


_O = """o AS (SELECT *, 'c' || o_custkey AS file, 'o' || o_orderkey AS service, o_orderkey % 20000 + 10000 AS port, o_orderkey % 11 = 0 AS flat,
  'o' || (o_orderkey - CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 32 END) AS needs FROM orders),
d AS (SELECT file, service, needs FROM o WHERE NOT flat AND o_orderkey % 4 < 3)"""

ORACLE = {
    "yaml_scalars": f"""WITH {_O}, m AS (SELECT * FROM o WHERE NOT flat), x AS (
  SELECT '' AS setting, 'str' AS kind, 'not a mapping' AS v FROM o WHERE flat
  UNION ALL SELECT 'image', 'str', CASE WHEN o_orderkey % 7 = 0 THEN 'base' ELSE 'shop:' || o_orderstatus END FROM m
  UNION ALL SELECT 'restart', 'str', 'always' FROM m WHERE o_orderkey % 7 = 0
  UNION ALL SELECT 'labels.note', 'str', 'two lines: here' FROM m
  UNION ALL SELECT 'ports.*', CASE WHEN o_orderkey % 5 = 4 THEN 'int' ELSE 'str' END, CASE o_orderkey % 5 WHEN 0 THEN port || ':80' WHEN 2 THEN '127.0.0.1:' || port || ':80/udp' ELSE port::VARCHAR END FROM m WHERE o_orderkey % 5 <> 1
  UNION ALL SELECT 'ports.*.' || k, CASE WHEN k = 'protocol' THEN 'str' ELSE 'int' END, CASE k WHEN 'target' THEN '80' WHEN 'protocol' THEN 'tcp' ELSE port::VARCHAR END FROM m, (VALUES ('target'), ('published'), ('protocol')) t(k) WHERE o_orderkey % 5 = 1
  UNION ALL SELECT 'depends_on.*', 'str', needs FROM m WHERE o_orderkey % 4 < 2
  UNION ALL SELECT 'depends_on.*.condition', 'str', 'service_healthy' FROM m WHERE o_orderkey % 4 = 2)
SELECT setting, kind, count(*) AS n, count(DISTINCT v) AS n_values FROM x GROUP BY ALL
UNION ALL SELECT '', 'tab', count(DISTINCT o_custkey), 0 FROM o WHERE o_custkey % 40 = 0 HAVING count(*) > 0""",
    "compose_ports": f"""WITH {_O} SELECT file, service, CASE WHEN o_orderkey % 5 = 1 THEN 'long' ELSE 'short' END AS form, CASE WHEN o_orderkey % 5 = 2 THEN '127.0.0.1' END AS host,
  CASE WHEN o_orderkey % 5 < 3 THEN port::VARCHAR END AS published, CASE WHEN o_orderkey % 5 < 3 THEN '80' ELSE port::VARCHAR END AS target, CASE o_orderkey % 5 WHEN 1 THEN 'tcp' WHEN 2 THEN 'udp' END AS protocol FROM o WHERE NOT flat""",
    "compose_host_ports": f"WITH {_O} SELECT DISTINCT file, port::BIGINT AS port FROM o WHERE NOT flat AND o_orderkey % 5 IN (0, 1, 3)",
    "compose_problems": f"""WITH {_O}, good AS (SELECT * FROM o WHERE o_custkey % 40 <> 0)
SELECT DISTINCT file, 'unreadable' AS problem, NULL::VARCHAR AS name FROM o WHERE o_custkey % 40 = 0
UNION ALL SELECT DISTINCT file, 'missing_service', 'api-gateway' FROM good WHERE o_custkey % 3 = 0
UNION ALL SELECT file, 'not_a_mapping', service FROM good WHERE flat
UNION ALL SELECT DISTINCT d.file, 'undefined_dependency', d.needs FROM d SEMI JOIN good USING (file) ANTI JOIN o ON o.file = d.file AND o.service = d.needs""",
    "compose_waves": f"""WITH RECURSIVE {_O}, up AS (SELECT file, service, needs AS at, 1 AS n FROM d UNION ALL SELECT up.file, up.service, d.needs, n + 1 FROM up JOIN d ON d.file = up.file AND d.service = up.at),
tops AS (SELECT up.file, up.service, max(n) AS n, bool_and(o.service IS NOT NULL) AS ok FROM up LEFT JOIN o ON o.file = up.file AND o.service = up.at GROUP BY ALL)
SELECT o.file, o.service, (CASE WHEN ok IS NULL THEN 0 WHEN ok THEN n ELSE -1 END)::BIGINT AS wave FROM o LEFT JOIN tops USING (file, service)""",
    "discovered_services": "SELECT 's' || s_suppkey AS service, (CASE WHEN s_suppkey % 6 < 2 THEN s_suppkey + 9000 WHEN s_suppkey % 6 = 3 THEN 8082 ELSE 8080 END)::BIGINT AS port FROM supplier WHERE s_suppkey % 10 < 9",
}
