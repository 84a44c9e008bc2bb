"""Services, ports, dependencies and problems of compose files, and ports of application configurations, from YAML rows (:mod:`lattica.sources.yamltext`).

rows and rejects are what parse gives. Only the first document of a file counts. A file with rejects is not trusted: it has the problem ``unreadable`` and no others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where a service's configuration lies below its folder.
CONFIGURATION = "src/main/resources/application.yml"
#: Fixed value: the port of a service whose configuration names none.
DEFAULT_PORT = 8080


def _below(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows of the first document whose path goes services, a name, then keys."""
    under = rows.where("doc = 0 AND path[0] = 'services' AND size(path) > 1 AND substring(steps, 2, 1) = 'k'")
    for i, k in enumerate(keys):
        under = under.where((F.size("path") > 2 + i) & (F.get("path", F.lit(2 + i)) == k) & (F.substring("steps", 3 + i, 1) == "k"))
    return under.withColumn("service", F.col("path")[1])


def services(rows: DataFrame) -> DataFrame:
    """(file, service, is_map, image, settings): is_map tells a mapping (also an empty one) from anything else; settings counts its keys."""
    each = _below(rows)
    deep = (F.size("path") > 2) & (F.substring("steps", 3, 1) == "k")
    image = F.when((F.size("path") == 3) & (F.col("path")[2] == "image"), F.col("value"))
    return each.groupBy("file", "service").agg(
        F.bool_or(deep | (F.size("path") == 2) & (F.col("kind") == "map")).alias("is_map"), F.max(image).alias("image"), F.count_distinct(F.when(deep, F.col("path")[2])).alias("settings")
    )


def ports(rows: DataFrame) -> DataFrame:
    """(file, service, item, form, host, published, target, protocol) of each entry of ports.

    short: ``[address:]published:target[/protocol]`` or a target alone; long: a mapping. published and target may be ranges, so they are text.
    """
    each = _below(rows, "ports").where("size(path) > 3 AND substring(steps, 4, 1) = 'i'").withColumn("item", F.col("path")[3].cast("int"))
    short = each.where("size(path) = 4 AND kind NOT IN ('map', 'seq', 'null')").withColumns({"protocol": F.nullif(F.regexp_extract("value", r"/(\w+)$", 1), F.lit("")), "entry": F.regexp_replace("value", r"/\w+$", "")})
    whole = r"^(?:(.*):)?([^:]*):([^:]*)$"
    several = F.col("entry").contains(":")
    part = lambda i: F.nullif(F.regexp_extract("entry", whole, i), F.lit(""))
    short = short.select("file", "service", "item", F.lit("short").alias("form"), part(1).alias("host"), part(2).alias("published"), F.when(several, part(3)).otherwise(F.col("entry")).alias("target"), "protocol")
    field = lambda name: F.max(F.when(F.col("path")[4] == name, F.col("value"))).alias(name)
    long = each.where("size(path) = 5").groupBy("file", "service", "item").agg(field("host_ip"), field("published"), field("target"), field("protocol"))
    return short.unionByName(long.select("file", "service", "item", F.lit("long").alias("form"), F.col("host_ip").alias("host"), "published", "target", "protocol"))


def host_ports(rows: DataFrame) -> DataFrame:
    """(file, port), each once: what the entries take of the host's ports.

    Of a text the part before its first colon, if it is digits (an entry that YAML reads as a number has no host port); of a mapping what it publishes, if it is digits.
    """
    each = _below(rows, "ports").where("size(path) > 3 AND substring(steps, 4, 1) = 'i'")
    short = each.where("size(path) = 4 AND kind = 'str'").select("file", F.trim(F.split_part("value", F.lit(":"), F.lit(1))).alias("p"))
    long = each.where("size(path) = 5 AND path[4] = 'published' AND substring(steps, 5, 1) = 'k' AND kind IN ('int', 'str')").select("file", F.col("value").alias("p"))
    return short.unionByName(long).where(F.col("p").rlike(r"^\d+$")).select("file", F.expr("try_cast(p AS BIGINT)").alias("port")).where("port IS NOT NULL").distinct()


def dependencies(rows: DataFrame) -> DataFrame:
    """(file, service, needs, condition): depends_on as a list (condition: service_started) or as a mapping."""
    each = _below(rows, "depends_on").where("size(path) > 3")
    listed = each.where("size(path) = 4 AND substring(steps, 4, 1) = 'i'").select("file", "service", F.col("value").alias("needs"), F.lit("service_started").alias("condition"))
    named = each.where("substring(steps, 4, 1) = 'k'").groupBy("file", "service", F.col("path")[3].alias("needs")).agg(F.max(F.when((F.size("path") == 5) & (F.col("path")[4] == "condition"), F.col("value"))).alias("condition"))
    return listed.unionByName(named.withColumn("condition", F.coalesce("condition", F.lit("service_started")))).distinct()


def problems(files: DataFrame, rows: DataFrame, rejects: DataFrame, expected: DataFrame) -> DataFrame:
    """(file, problem, name) of files (file) against expected (file, name); a valid file has no row.

    unreadable; no_services: no mapping of services, or an empty one; missing_service: an expected one is not there; not_a_mapping: a service's definition; undefined_dependency: no service of that name.
    """
    from ..sources.scratch import materialize

    bad = materialize(rejects.select("file").distinct(), "bad")
    trusted, asked = rows.join(bad, "file", "left_anti"), files.select("file").distinct()
    found = materialize(services(trusted), "services")
    row = lambda df, problem, name: df.select("file", F.lit(problem).alias("problem"), name.alias("name"))
    none = F.lit(None).cast("string")
    readable = asked.join(bad, "file", "left_anti")
    empty = readable.join(found.select("file").distinct(), "file", "left_anti")
    needed = dependencies(trusted).select("file", F.col("needs").alias("service")).distinct()
    wanted = expected.select("file", F.col("name").alias("service")).distinct().join(readable, "file", "left_semi").join(empty, "file", "left_anti")
    return (
        row(asked.join(bad, "file", "left_semi"), "unreadable", none)
        .unionByName(row(empty, "no_services", none))
        .unionByName(row(wanted.join(found, ["file", "service"], "left_anti"), "missing_service", F.col("service")))
        .unionByName(row(found.where("NOT is_map"), "not_a_mapping", F.col("service")))
        .unionByName(row(needed.where("service IS NOT NULL").join(found, ["file", "service"], "left_anti"), "undefined_dependency", F.col("service")))
    )


def start_order(rows: DataFrame, rounds: int = 200) -> DataFrame:
    """(file, service, wave): the wave in which a service can start, those it depends on before it; null for services on or behind a cycle or an undefined dependency.

    A round settles a wave of every file at once, so rounds are as many as the longest chain; ``rounds`` bounds chains, beyond it this raises.
    """
    from ..sources.scratch import materialize

    every = materialize(services(rows).select("file", "service"), "services")
    needs = materialize(dependencies(rows).select("file", "service", "needs").where("needs IS NOT NULL"), "needs")
    of = ["file", "service"]
    # Services that need nothing start at once; those that need an undefined one never do. Rounds are about the rest, and what they still wait for.
    asking = needs.select(*of).distinct()
    never = materialize(needs.join(every.withColumnRenamed("service", "needs"), ["file", "needs"], "left_anti").select(*of).distinct(), "never")
    ready = materialize(every.join(asking, of, "left_anti"), "ready")
    left = materialize(every.join(asking, of, "left_semi").join(never, of, "left_anti"), "left")
    waits = needs.join(left, of, "left_semi")
    waves = [ready.withColumn("wave", F.lit(0).cast("long"))]
    for wave in range(1, rounds + 1):
        if left.isEmpty():
            break
        waits = materialize(waits.join(ready.withColumnRenamed("service", "needs"), ["file", "needs"], "left_anti").select(*of, "needs"), "waits")
        ready = materialize(left.join(waits.select(*of).distinct(), of, "left_anti"), "ready")
        if ready.isEmpty():
            break
        if wave == rounds:
            raise RuntimeError(f"a chain of dependencies is longer than {rounds}")
        waves.append(ready.withColumn("wave", F.lit(wave).cast("long")))
        left = materialize(left.join(ready, of, "left_anti"), "left")
    for rest in (left, never):
        waves.append(rest.withColumn("wave", F.lit(None).cast("long")))
    out = waves[0]
    for w in waves[1:]:
        out = out.unionByName(w.select(*out.columns))
    return out


def server_ports(rows: DataFrame, default: int = DEFAULT_PORT) -> DataFrame:
    """(file, port): the first plain number of a configuration under a key that ends with ``port``; files with none are not in rows' result."""
    named = rows.where("steps LIKE '%k' AND kind = 'int'").where(F.element_at("path", -1).endswith("port") & F.col("value").rlike(r"^\d+$"))
    return named.groupBy("file").agg(F.min_by(F.col("value").cast("long"), F.struct("doc", "line")).alias("port"))


def discover(files: DataFrame, default: int = DEFAULT_PORT) -> DataFrame:
    """(service, port): folders with a Dockerfile, and the port that their configuration names. files (path, text): paths below the folder of all services."""
    from ..sources.yamltext import parse

    parts = files.select("path", "text", F.split_part("path", F.lit("/"), F.lit(1)).alias("service"), F.expr("substring(path, instr(path, '/') + 1)").alias("rest")).where("path LIKE '%/%'")
    ready = parts.where("rest = 'Dockerfile'").select("service").distinct()
    rows, _ = parse(parts.where(F.col("rest") == CONFIGURATION).select(F.col("service").alias("file"), "text"))
    return ready.join(server_ports(rows).withColumnRenamed("file", "service"), "service", "left").select("service", F.coalesce("port", F.lit(default).cast("long")).alias("port"))
