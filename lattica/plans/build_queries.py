"""Named queries over build files that Spark writes from the tables: a region is a parent project, its nations are modules of it and their customers modules of those."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import buildfiles
from ..sources.relational import Tables
from ..sources.scratch import materialize

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
    return f


def build_texts(t: Tables) -> DataFrame:
    """(path, text). Regions: an external parent for the even ones, properties that refer to each other. Nations: a property of their own, a managed version. Customers: by key modulo 10 Gradle (0), broken (1), a language level of their own (2, 3)."""
    s = lambda c: F.col(c).cast("string")
    root = F.concat(
        F.lit('<project xmlns="http://maven.apache.org/POM/4.0.0">'),
        F.when(F.col("r_regionkey") % 2 == 0, F.concat(F.lit("<parent><groupId>org.springframework.boot</groupId><artifactId>spring-boot-starter-parent</artifactId><version>${boot}</version><relativePath/></parent>"))).otherwise(""),
        F.lit("<groupId>tpc.${name}</groupId><artifactId>root</artifactId><version>${major}.${minor}</version><packaging>pom</packaging><properties><boot>3.${minor}.0</boot><major>1</major><minor>"), s("r_regionkey"),
        F.lit("</minor><name>r${minor}</name><a>${b}</a><b>${a}</b><java.version>17</java.version></properties></project>"),
    )
    regions = t.region.select(F.concat(F.lit("r"), s("r_regionkey"), F.lit("/pom.xml")).alias("path"), root.alias("text"))
    nation = F.concat(
        F.lit("<project><parent><artifactId>root</artifactId></parent><artifactId>n"), s("n_nationkey"), F.lit("</artifactId><properties><minor>"), s("n_nationkey"), F.lit("</minor></properties><dependencyManagement><dependencies><dependency><groupId>lib</groupId><artifactId>"),
        F.lower("n_name"), F.lit("</artifactId><version>${major}.0-${minor}</version></dependency></dependencies></dependencyManagement></project>"),
    )
    folder = F.concat(F.lit("r"), s("n_regionkey"), F.lit("/n"), s("n_nationkey"))
    nations = t.nation.select(F.concat(folder, F.lit("/pom.xml")).alias("path"), nation.alias("text"))
    each = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).withColumns({"m": F.col("c_custkey") % 10, "f": F.concat(folder, F.lit("/c"), s("c_custkey"))})
    customer = F.concat(
        F.lit("<project><parent><artifactId>n"), s("n_nationkey"), F.lit("</artifactId><relativePath>"), F.when(F.col("m") > 5, "./..").otherwise("../pom.xml"), F.lit("</relativePath></parent><artifactId>c"), s("c_custkey"), F.lit("</artifactId>"),
        F.when(F.col("m") == 2, "<properties><java.version>2${minor}</java.version></properties>").when(F.col("m") == 3, "<build><plugins><plugin><artifactId>maven-compiler-plugin</artifactId><configuration><release>11</release></configuration></plugin></plugins></build>").otherwise(""),
        F.lit("<dependencies><dependency><groupId>lib</groupId><artifactId>"), F.lower("n_name"), F.lit("</artifactId>"), F.when(F.col("m") == 4, "<version>${project.version}</version>").otherwise(""), F.lit("</dependency></dependencies>"),
        F.when(F.col("m") == 1, "<project>").otherwise("</project>"),
    )
    groovy = F.concat(F.lit("plugins { id 'org.springframework.boot' version '3."), s("c_nationkey"), F.lit("' }\nsourceCompatibility = '"), (F.col("c_custkey") % 3 + 20).cast("string"), F.lit("'\n"))
    customers = each.select(F.concat("f", F.when(F.col("m") == 0, "/build.gradle").otherwise("/pom.xml")).alias("path"), F.when(F.col("m") == 0, groovy).otherwise(customer).alias("text"))
    return materialize(regions.unionByName(nations).unionByName(customers), "builds")


@query
def build_metadata(t):
    """Tool, framework, versions of every build file; nulls are what no file says."""
    m = buildfiles.metadata(build_texts(t))
    return m.select("path", "build_tool", "framework", "spring_boot_version", "java_version")


@query
def build_projects(t):
    """Coordinates of Maven projects, with properties put in."""
    return buildfiles.maven(build_texts(t))[0].select("path", "parent", "group", "artifact", "version", "packaging")


@query
def build_dependencies(t):
    """Dependencies with their own or managed versions."""
    return buildfiles.maven(build_texts(t))[2].select("path", "group", "artifact", "version", "scope", F.col("depth").cast("long").alias("depth"))


@query
def build_properties(t):
    """Settled properties, counted by name and state."""
    p = buildfiles.maven(build_texts(t))[1]
    return p.groupBy("name", "state").agg(F.count("*").alias("n"), F.count_distinct("value").alias("n_values"), F.min("value").alias("least"))


@query
def build_folders(t):
    """The nearest build file of each order's folder, some of which lie far below or beside."""
    folder = F.concat(F.lit("r"), (F.col("n_regionkey") + F.when(F.col("o_orderkey") % 9 == 0, 7).otherwise(0)).cast("string"), F.lit("/n"), F.col("n_nationkey").cast("string"), F.lit("/c"), F.col("c_custkey").cast("string"), F.lit("/src"))
    deep = F.concat(folder, F.when(F.col("o_orderkey") % 5 == 0, "/a/b/c/d/e/f/g/h/i/j/k").otherwise("/main"))
    folders = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(deep.alias("folder"))
    return buildfiles.build_roots(folders, build_texts(t)).select("folder", "root", "path")


_C = """c AS (SELECT *, c_custkey % 10 AS m, 'r' || n_regionkey || '/n' || n_nationkey AS up, 'r' || n_regionkey || '/n' || n_nationkey || '/c' || c_custkey AS f FROM customer JOIN nation ON c_nationkey = n_nationkey),
p AS (SELECT 'r' || r_regionkey || '/pom.xml' AS path, NULL AS parent, r_regionkey AS r, r_regionkey AS minor, 'root' AS artifact, 'pom' AS packaging, -1 AS m, NULL AS lib FROM region
  UNION ALL SELECT 'r' || n_regionkey || '/n' || n_nationkey || '/pom.xml', 'r' || n_regionkey || '/pom.xml', n_regionkey, n_nationkey, 'n' || n_nationkey, 'jar', -1, NULL FROM nation
  UNION ALL SELECT f || '/pom.xml', up || '/pom.xml', n_regionkey, n_nationkey, 'c' || c_custkey, 'jar', m, lower(n_name) FROM c WHERE m > 1)"""

ORACLE = {
    "build_metadata": f"""WITH {_C} SELECT path, 'maven' AS build_tool, CASE WHEN r % 2 = 0 THEN 'spring-boot' ELSE 'plain-java' END AS framework, CASE WHEN r % 2 = 0 THEN '3.' || minor || '.0' END AS spring_boot_version,
  CASE m WHEN 2 THEN '2' || minor WHEN 3 THEN '11' ELSE '17' END AS java_version FROM p
UNION ALL SELECT f || '/build.gradle', 'gradle', 'spring-boot', '3.' || c_nationkey, (c_custkey % 3 + 20)::VARCHAR FROM c WHERE m = 0""",
    "build_projects": f"""WITH {_C} SELECT path, parent, 'tpc.r' || minor AS "group", artifact, '1.' || minor AS version, packaging FROM p""",
    "build_dependencies": f"""WITH {_C} SELECT path, 'lib' AS "group", lib AS artifact, CASE WHEN m = 4 THEN '1.' || minor ELSE '1.0-' || minor END AS version, 'compile' AS scope, 0::BIGINT AS depth FROM p WHERE lib IS NOT NULL""",
    "build_properties": f"""WITH {_C}, v AS (SELECT p.*, unnest(['boot', 'major', 'minor', 'name', 'a', 'b', 'java.version', 'project.groupId', 'project.artifactId', 'project.version']) AS name FROM p),
w AS (SELECT name, CASE WHEN name IN ('a', 'b') THEN 'cycle' ELSE 'ok' END AS state, CASE name WHEN 'boot' THEN '3.' || minor || '.0' WHEN 'major' THEN '1' WHEN 'minor' THEN minor::VARCHAR WHEN 'name' THEN 'r' || minor WHEN 'a' THEN '${{b}}' WHEN 'b' THEN '${{a}}'
  WHEN 'java.version' THEN CASE WHEN m = 2 THEN '2' || minor ELSE '17' END WHEN 'project.groupId' THEN 'tpc.r' || minor WHEN 'project.artifactId' THEN artifact ELSE '1.' || minor END AS value FROM v)
SELECT name, state, count(*) AS n, count(DISTINCT value) AS n_values, min(value) AS least FROM w GROUP BY name, state""",
    "build_folders": f"""WITH {_C}, o AS (SELECT DISTINCT f, up, n_regionkey, m, o_orderkey % 9 = 0 AS off, o_orderkey % 5 = 0 AS deep, n_nationkey, c_custkey FROM orders JOIN c ON o_custkey = c_custkey)
SELECT CASE WHEN off THEN 'r' || (n_regionkey + 7) || '/n' || n_nationkey || '/c' || c_custkey ELSE f END || '/src' || CASE WHEN deep THEN '/a/b/c/d/e/f/g/h/i/j/k' ELSE '/main' END AS folder,
  CASE WHEN NOT off AND NOT deep THEN f END AS root, CASE WHEN NOT off AND NOT deep THEN f || CASE WHEN m = 0 THEN '/build.gradle' ELSE '/pom.xml' END END AS path FROM o""",
}
