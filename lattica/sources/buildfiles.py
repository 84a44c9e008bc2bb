"""Build files as rows: coordinates, properties, dependencies and language level of Maven and Gradle projects.

XML is read by Spark's own reader with an explicit schema. A project's parent is another file (by relative path, or by coordinates) or an external one; inheritance runs along the chain of parents,
and ``${property}`` references are put in wave by wave, all projects at once: a property is settled when those it refers to are. References in a circle are never settled and keep their text; references to
nothing known keep theirs. What a file doesn't say is null; :func:`with_defaults` fills in defaults, so that the two can be told apart before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.hierarchy import ancestors
from .scratch import materialize

_COORDINATES = "groupId string, artifactId string, version string"
_DEPENDENCIES = f"struct<dependency:array<struct<{_COORDINATES.replace(' string', ':string')},scope:string,type:string>>>"
POM = (
    f"{_COORDINATES}, packaging string, parent struct<{_COORDINATES.replace(' string', ':string')},relativePath:string>, properties map<string,string>, modules struct<module:array<string>>, "
    f"dependencies {_DEPENDENCIES}, dependencyManagement struct<dependencies:{_DEPENDENCIES}>, "
    "build struct<plugins:struct<plugin:array<struct<artifactId:string,configuration:struct<release:string,source:string,target:string>>>>>, _corrupt string"
)
#: Longest value that putting in references may make.
LONGEST = 65_536
#: Names of frameworks, and what tells each: a group of its parent or of a dependency.
FRAMEWORKS = {"spring-boot": "org.springframework.boot", "quarkus": "io.quarkus", "micronaut": "io.micronaut"}
#: Properties that name the language level, the first known counts.
LEVELS = ["maven.compiler.release", "java.version", "maven.compiler.source"]

_blank = lambda c: F.nullif(F.trim(c), F.lit(""))
_folder = lambda c: F.regexp_replace(c, r"/?[^/]*$", "")


def normal_path(path: Column) -> Column:
    """Without . and .. and doubled slashes; null if it leads out of the root."""
    step = lambda acc, x: F.when(x.isin("", "."), acc).when(x != "..", F.concat(acc, F.array(x))).when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.size(acc) - 1))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def poms(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(projects, rejects) of files (path, text) named *.xml: the parsed documents as they stand, and the paths of those that aren't XML."""
    xml = files.where("path LIKE '%.xml'").select("path", F.from_xml("text", POM, {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"}).alias("p"))
    xml = materialize(xml, "poms")
    fine = F.col("p").isNotNull() & F.col("p._corrupt").isNull()
    return xml.where(fine).select("path", "p.*").drop("_corrupt"), xml.where(~F.coalesce(fine, F.lit(False))).select("path")


def parents(projects: DataFrame) -> DataFrame:
    """(id, parent): paths of projects and of their parents, where the parent is one of the files: what relativePath names (../pom.xml if it names nothing) if the artifact agrees, else the file of those coordinates."""
    ask = projects.where("parent.artifactId IS NOT NULL").select("path", F.col("parent.artifactId").alias("artifact"), F.col("parent.groupId").alias("group"), F.col("parent.version").alias("version"), F.coalesce("parent.relativePath", F.lit("../pom.xml")).alias("relative"))
    near = F.when(F.trim("relative") != "", F.concat(_folder(F.col("path")), F.lit("/"), F.when(F.col("relative").endswith(".xml"), F.col("relative")).otherwise(F.concat("relative", F.lit("/pom.xml")))))
    own = projects.select(F.col("path").alias("at"), F.col("artifactId").alias("artifact"), F.coalesce("groupId", "parent.groupId").alias("group"), F.coalesce("version", "parent.version").alias("version"))
    by_path = ask.withColumn("at", normal_path(near)).join(own.select("at", "artifact"), ["at", "artifact"]).select("path", F.col("at").alias("near"))
    by_name = own.groupBy("group", "artifact", "version").agg(F.min("at").alias("far"))
    found = ask.join(by_path, "path", "left").join(by_name, ["group", "artifact", "version"], "left")
    return found.select(F.col("path").alias("id"), F.coalesce("near", "far").alias("parent")).where("parent IS NOT NULL AND parent <> id")


def settle(properties: DataFrame) -> DataFrame:
    """(path, name, value, state) of properties (path, name, value; one for each name): references put in. state: ok; cycle: on or behind a circle; long: over LONGEST characters. The latter two keep their text."""
    own = materialize(properties.select("path", "name", "value"), "properties")
    pieces = own.select("path", "name", F.posexplode(F.regexp_extract_all("value", F.lit(r"(?s)\$\{[^}]*\}|[^$]+|\$"), F.lit(0))).alias("pos", "piece"))
    pieces = pieces.withColumn("ref", F.nullif(F.regexp_extract("piece", r"^\$\{([^}]*)\}$", 1), F.lit("")))
    pieces = materialize(pieces, "pieces")
    names = own.select("path", F.col("name").alias("ref"))
    refs = materialize(pieces.where("ref IS NOT NULL").select("path", "name", "ref").distinct().join(names, ["path", "ref"], "left_semi"), "refs")
    left, done = own.select("path", "name"), None
    while True:
        waits = refs.join(left, ["path", "name"], "left_semi")
        if done is not None:
            waits = waits.join(done.where("state = 'ok'").select("path", F.col("name").alias("ref")), ["path", "ref"], "left_anti")
        ready = left.join(waits.select("path", "name").distinct(), ["path", "name"], "left_anti")
        if done is None:
            value = ready.join(own, ["path", "name"])
        else:
            known = done.select("path", F.col("name").alias("ref"), F.col("value").alias("known"))
            parts = pieces.join(ready, ["path", "name"], "left_semi").join(known, ["path", "ref"], "left").select("path", "name", "pos", F.coalesce("known", "piece").alias("x"))
            value = parts.groupBy("path", "name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]), "").alias("value"))  # a value's pieces
        long = F.length("value") > LONGEST
        value = value.join(own.withColumnRenamed("value", "text"), ["path", "name"]).select("path", "name", F.when(long, F.col("text")).otherwise(F.col("value")).alias("value"), F.when(long, "long").otherwise("ok").alias("state"))
        value = materialize(value, "settled")
        if value.isEmpty():
            break
        done = materialize(value if done is None else done.unionByName(value), "done")
        left = materialize(left.join(value.select("path", "name"), ["path", "name"], "left_anti"), "left")
    rest = own.join(left, ["path", "name"], "left_semi").withColumn("state", F.lit("cycle"))
    return rest if done is None else done.unionByName(rest)


def put_in(texts: DataFrame, settled: DataFrame, columns: list[str]) -> DataFrame:
    """texts (path, ..) with the references in some columns replaced by settled properties of the same path."""
    refs = F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\$\{([^}]*)\}"), F.lit(1)) for c in columns])))
    tagged = materialize(texts.withColumn("_row", F.monotonically_increasing_id()), "texts")
    known = tagged.select("_row", "path", F.explode(refs).alias("name")).join(settled.where("state = 'ok'"), ["path", "name"])
    known = known.groupBy("_row").agg(F.collect_list(F.struct(F.concat(F.lit("${"), "name", F.lit("}")).alias("ref"), "value")).alias("_known"))  # what one row refers to
    put = lambda c: F.when(F.col("_known").isNull() | F.col(c).isNull(), F.col(c)).otherwise(F.aggregate("_known", F.col(c), lambda acc, k: F.replace(acc, k["ref"], k["value"])))
    return tagged.join(known, "_row", "left").withColumns({c: put(c) for c in columns}).drop("_row", "_known")


def _nearest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of rows (path, depth, keys, ..) the one of the least depth for each path and keys; ties to the later one in a file (pos)."""
    first = F.row_number().over(Window.partitionBy("path", *keys).orderBy("depth", F.desc("pos")))
    return rows.withColumn("_n", first).where("_n = 1").drop("_n", "pos")


def maven(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(projects, properties, dependencies) of files (path, text).

    projects: path, parent (path or null), group, artifact, version, packaging, boot_parent (version of an external Spring Boot parent), plugin_level. properties as of settle, inherited ones included.
    dependencies: path, group, artifact, version (managed where the project names none), scope, depth (of the parent that names it; 0: itself).
    """
    raw, _ = poms(files)
    up = materialize(parents(raw), "parents")
    chain = raw.select("path", F.col("path").alias("from"), F.lit(0).alias("depth")).unionByName(ancestors(up).select(F.col("id").alias("path"), F.col("ancestor").alias("from"), "depth"))
    chain = materialize(chain, "chain")
    source = raw.withColumnRenamed("path", "from")
    inherited = chain.join(source, "from")

    # Coordinates: group and version from the parent where a project names none.
    named = inherited.select("path", "depth", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), _blank(F.col(c)).alias("value"), F.lit(0).alias("pos")) for n, c in (("groupId", "groupId"), ("version", "version"))])).alias("s")).select("path", "depth", "s.*")
    outer = raw.select("path", F.col("parent.groupId").alias("outer_group"), F.col("parent.version").alias("outer_version"))
    last = inherited.groupBy("path").agg(F.max_by(F.struct(F.col("parent.groupId").alias("g"), F.col("parent.artifactId").alias("a"), F.col("parent.version").alias("v")), "depth").alias("top"))
    got = _nearest(named.where("value IS NOT NULL"), ["name"]).groupBy("path").pivot("name", ["groupId", "version"]).agg(F.first("value"))
    levels = F.array_compact(F.transform("build.plugins.plugin", lambda p: F.when(p["artifactId"] == "maven-compiler-plugin", F.coalesce(_blank(p["configuration"]["release"]), _blank(p["configuration"]["source"]), _blank(p["configuration"]["target"])))))
    level = inherited.select("path", "depth", F.get(levels, F.lit(0)).alias("level")).where("level IS NOT NULL").groupBy("path").agg(F.min_by("level", "depth").alias("plugin_level"))
    projects = raw.select("path", _blank(F.col("artifactId")).alias("artifact"), F.coalesce(_blank(F.col("packaging")), F.lit("jar")).alias("packaging")).join(got, "path", "left").join(outer, "path", "left").join(last, "path", "left").join(level, "path", "left")
    projects = projects.join(up.withColumnRenamed("id", "path"), "path", "left")
    boot = F.when((F.col("top.g") == FRAMEWORKS["spring-boot"]) & (F.col("top.a") == "spring-boot-starter-parent"), _blank(F.col("top.v")))
    projects = projects.select("path", "parent", F.coalesce("groupId", _blank(F.col("outer_group"))).alias("group"), "artifact", F.coalesce("version", _blank(F.col("outer_version"))).alias("version"), "packaging", boot.alias("boot_parent"), "plugin_level")
    projects = materialize(projects, "projects")

    # Properties: own and inherited ones, the nearest counts, and the project's own coordinates.
    given = inherited.where("properties IS NOT NULL").select("path", "depth", F.explode("properties").alias("name", "value")).withColumn("pos", F.lit(0)).where("value IS NOT NULL")
    given = _nearest(given.withColumn("value", F.trim("value")), ["name"]).select("path", "name", "value")
    built_in = projects.select("path", F.explode(F.array(*[F.struct(F.lit(f"project.{n}").alias("name"), F.col(c).alias("value")) for n, c in (("groupId", "group"), ("artifactId", "artifact"), ("version", "version"))])).alias("s")).select("path", "s.*").where("value IS NOT NULL")
    properties = materialize(settle(given.join(built_in, ["path", "name"], "left_anti").unionByName(built_in)), "settled")

    def listed(column: str) -> DataFrame:
        each = inherited.select("path", "depth", F.posexplode(column).alias("pos", "d"))
        return each.select("path", "depth", "pos", *[_blank(F.col(f"d.{c}")).alias(n) for n, c in (("group", "groupId"), ("artifact", "artifactId"), ("version", "version"), ("scope", "scope"))])

    used = put_in(listed("dependencies.dependency"), properties, ["group", "artifact", "version"])
    managed = put_in(listed("dependencyManagement.dependencies.dependency"), properties, ["group", "artifact", "version"])
    managed = _nearest(managed, ["group", "artifact"]).select("path", "group", "artifact", F.col("version").alias("managed"), F.col("scope").alias("managed_scope"))
    used = _nearest(used, ["group", "artifact"]).join(managed, ["path", "group", "artifact"], "left")
    used = used.select("path", "group", "artifact", F.coalesce("version", "managed").alias("version"), F.coalesce("scope", "managed_scope", F.lit("compile")).alias("scope"), "depth")
    return put_in(projects, properties, ["group", "artifact", "version", "boot_parent", "plugin_level"]), properties, used


_GRADLE = {
    "group": r"(?m)^\s*group\s*=?\s*['\"]([^'\"]+)['\"]",
    "version": r"(?m)^\s*version\s*=?\s*['\"]([^'\"]+)['\"]",
    "boot_plugin": r"id\s*\(?\s*['\"]org\.springframework\.boot['\"]\s*\)?\s*version\s*\(?\s*['\"]([^'\"]+)['\"]",
    "level": r"(?:JavaLanguageVersion\.of\s*\(\s*|sourceCompatibility\s*=\s*['\"]?(?:JavaVersion\.VERSION_)?)(\d+(?:[._]\d+)*)",
}


def gradle(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(projects, dependencies) of files (path, text) named build.gradle or build.gradle.kts: path, group, version, boot_plugin, level; and path, group, artifact, version, scope. Variables that the file sets are put in."""
    own = files.where(F.col("path").rlike(r"(^|/)build\.gradle(\.kts)?$")).withColumn("text", F.regexp_replace("text", r"(?s)/\*.*?\*/|(?m)(^|\s)//[^\n]*", " "))
    pairs = F.expr(r"transform(regexp_extract_all(text, '(?m)^\\s*(?:def |val |ext\\.|set\\(\")?[\\w.]+(?:\", )?\\s*=?\\s*[\'\"][^\'\"\\n]*[\'\"]', 0), x -> struct(regexp_extract(x, '([\\w.]+)(?:\", )?\\s*=?\\s*[\'\"]', 1) AS name, regexp_extract(x, '[\'\"]([^\'\"]*)[\'\"]$', 1) AS value))")
    braced = lambda c: F.regexp_replace(c, r"\$(\w+)", r"\$\{$1\}")
    variables = own.select("path", F.posexplode(pairs).alias("pos", "v")).select("path", F.regexp_replace("v.name", r"^ext\.", "").alias("name"), braced(F.col("v.value")).alias("value"), "pos").withColumn("depth", F.lit(0))
    settled = materialize(settle(_nearest(variables, ["name"]).select("path", "name", "value")), "settled")
    first = lambda pattern: _blank(braced(F.regexp_extract("text", pattern, 1)))
    projects = put_in(own.select("path", *[first(p).alias(n) for n, p in _GRADLE.items()]), settled, ["group", "version", "boot_plugin", "level"])
    line = r"(?m)^\s*(\w+)\s*\(?\s*['\"]([\w.-]+:[\w.-]+(?::[^'\"]+)?)['\"]"
    found = own.select("path", F.explode(F.arrays_zip(F.regexp_extract_all("text", F.lit(line), F.lit(1)).alias("s"), F.regexp_extract_all("text", F.lit(line), F.lit(2)).alias("c"))).alias("x"))
    part = lambda i: F.get(F.split("x.c", ":"), F.lit(i))
    found = found.select("path", part(0).alias("group"), part(1).alias("artifact"), braced(part(2)).alias("version"), F.col("x.s").alias("scope"))
    return projects, put_in(found, settled, ["version"])


def metadata(files: DataFrame) -> DataFrame:
    """(path, build_tool, framework, spring_boot_version, java_version) of each readable build file; what it doesn't say is null."""
    projects, properties, used = maven(files)
    level = properties.where(F.col("name").isin(*LEVELS) & (F.col("state") == "ok")).groupBy("path").agg(
        F.min_by("value", F.array_position(F.array(*map(F.lit, LEVELS)), F.col("name"))).alias("level")
    )
    boot = properties.where("name = 'spring-boot.version' AND state = 'ok'").select("path", F.col("value").alias("boot_property"))
    of = F.coalesce(*[F.when(F.col("group") == g, n) for n, g in FRAMEWORKS.items()])

    def frameworks(df: DataFrame) -> DataFrame:
        return df.select("path", of.alias("f"), "version", "group").where("f IS NOT NULL").groupBy("path").agg(F.min_by("f", F.array_position(F.array(*map(F.lit, FRAMEWORKS)), F.col("f"))).alias("f"), F.max(F.when(F.col("f") == "spring-boot", F.col("version"))).alias("boot_dependency"))

    m = projects.join(level, "path", "left").join(boot, "path", "left").join(frameworks(used), "path", "left")
    version = F.coalesce("boot_parent", "boot_property", "boot_dependency")
    kind = F.when(F.col("boot_parent").isNotNull(), "spring-boot").otherwise(F.coalesce("f", F.lit("plain-java")))
    m = m.select("path", F.lit("maven").alias("build_tool"), kind.alias("framework"), F.when(kind == "spring-boot", version).alias("spring_boot_version"), F.coalesce("plugin_level", "level").alias("java_version"))
    g_projects, g_used = gradle(files)
    g = g_projects.join(frameworks(g_used), "path", "left")
    kind = F.when(F.col("boot_plugin").isNotNull(), "spring-boot").otherwise(F.coalesce("f", F.lit("plain-java")))
    g = g.select("path", F.lit("gradle").alias("build_tool"), kind.alias("framework"), F.when(kind == "spring-boot", F.coalesce("boot_plugin", "boot_dependency")).alias("spring_boot_version"), F.col("level").alias("java_version"))
    return m.unionByName(g)


def build_roots(folders: DataFrame, files: DataFrame, most: int = 10) -> DataFrame:
    """(folder, root, path): for each folder the nearest one, itself or up to ``most`` above, with a build file, and that file, pom.xml before build.gradle. A folder without one has nulls."""
    steps = F.split("folder", "/")
    own = folders.select("folder").distinct()
    up = own.select("folder", F.explode(F.sequence(F.lit(0), F.least(F.size(steps), F.lit(most)))).alias("n"))
    up = up.withColumn("root", F.array_join(F.slice(steps, F.lit(1), F.size(steps) - F.col("n")), "/"))
    built = files.select("path", _folder(F.col("path")).alias("root"), F.array_position(F.array(*map(F.lit, ["pom.xml", "build.gradle", "build.gradle.kts"])), F.regexp_extract("path", r"[^/]*$", 0)).alias("rank")).where("rank > 0")
    found = up.join(built, "root").groupBy("folder").agg(F.min(F.struct("n", "rank", "root", "path")).alias("x"))
    return own.join(found, "folder", "left").select("folder", "x.root", "x.path")


def with_defaults(found: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """Nulls of some columns filled in."""
    return found.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in defaults.items()})
