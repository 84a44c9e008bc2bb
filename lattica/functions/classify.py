"""Column expressions: rule-based classification, names, text forms and small lookups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cases(rules: list[tuple[Column, str]], default: Column | str) -> Column:
    """The first rule's value that holds."""
    out = default if isinstance(default, Column) else F.lit(default)
    for test, value in reversed(rules):
        out = F.when(test, F.lit(value)).otherwise(out)
    return out


def _any_like(names: Column, *parts: str) -> Column:
    """Whether some name holds one of the parts, whatever its case."""
    return F.coalesce(F.exists(names, lambda a: F.lower(a).rlike("|".join(parts))), F.lit(False))


def node_type(annotations: Column, simple_name: Column) -> Column:
    """Annotations decide in order controller, service, entity or table, repository or dao; then the name's ending."""
    name = F.lower(F.coalesce(simple_name, F.lit("")))
    ends = lambda *xs: name.rlike("(" + "|".join(xs) + ")$")
    return cases(
        [
            (_any_like(annotations, "controller"), "Controller"),
            (_any_like(annotations, "service"), "Service"),
            (_any_like(annotations, "entity", "table"), "Entity"),
            (_any_like(annotations, "repository", "dao"), "Repository"),
            (ends("service"), "Service"),
            (ends("controller"), "Controller"),
            (ends("entity", "model"), "Entity"),
            (ends("utils?"), "Utility"),
        ],
        "Unknown",
    )


def class_type(annotations: Column, is_interface: Column) -> Column:
    """By exact annotations."""
    has = lambda *xs: F.coalesce(F.arrays_overlap(annotations, F.array(*map(F.lit, xs))), F.lit(False))
    return cases(
        [(has("Entity", "Table"), "Entity"), (has("Controller", "RestController"), "Controller"), (has("Service"), "Service"), (has("Repository"), "Repository"), (has("Component"), "Component"), (has("Configuration"), "Configuration"), (F.coalesce(is_interface, F.lit(False)), "Interface")],
        "Class",
    )


def complexity(methods: Column, fields: Column) -> Column:
    return F.coalesce(F.array_size(methods), F.lit(0)) + F.coalesce(F.array_size(fields), F.lit(0))


def is_library(name: Column) -> Column:
    return name.rlike(r"^javax?\.")


def last_part(name: Column) -> Column:
    return F.element_at(F.split(name, r"\."), -1)


def simple_name(simple: Column, fqn: Column) -> Column:
    return F.coalesce(simple, last_part(fqn))


def _some(items: Column) -> Column:
    return F.coalesce(F.array_size(items), F.lit(0)) > 0


def class_summary(fqn: Column, annotations: Column, methods: Column) -> Column:
    """name | [@a, @b, @c] | methods: m1, .. with at most three annotations and five methods; what is absent is left out."""
    marks = F.when(_some(annotations), F.concat(F.lit("["), F.array_join(F.transform(F.slice(annotations, 1, 3), lambda a: F.concat(F.lit("@"), a)), ", "), F.lit("]")))
    names = F.when(_some(methods), F.concat(F.lit("methods: "), F.array_join(F.transform(F.slice(methods, 1, 5), lambda m: m["name"]), ", ")))
    return F.concat_ws(" | ", fqn, marks, names)


def class_text(fqn: Column, is_interface: Column, is_abstract: Column, annotations: Column, methods: Column, fields: Column) -> Column:
    """The lines from which a class is embedded: its signatures, not its bodies."""
    params = lambda m: F.array_join(F.transform(m["parameters"], lambda p: F.concat_ws(" ", p["type"], p["name"])), ", ")
    sign = lambda m: F.concat(F.lit("  - "), m["name"], F.lit("("), params(m), F.lit(") -> "), F.coalesce(m["return_type"], F.lit("void")))
    listed = lambda title, items, f: F.when(_some(items), F.concat_ws("\n", F.lit(title), F.array_join(F.transform(items, f), "\n")))
    kind = cases([(F.coalesce(is_interface, F.lit(False)), "Interface"), (F.coalesce(is_abstract, F.lit(False)), "Abstract")], "Class")
    return F.concat_ws(
        "\n",
        F.concat(F.lit("CLASS: "), fqn),
        F.concat(F.lit("TYPE: "), kind),
        F.when(_some(annotations), F.concat(F.lit("ANNOTATIONS: "), F.array_join(F.transform(annotations, lambda a: F.concat(F.lit("@"), a)), ", "))),
        listed("METHODS:", methods, sign),
        listed("FIELDS:", fields, lambda f: F.concat(F.lit("  - "), f["type"], F.lit(" "), f["name"])),
    )


#: API type of a source type, by the first of these strings that its lower case holds.
API_TYPES = {
    "long": "integer", "int": "integer", "integer": "integer", "string": "string", "boolean": "boolean",
    "bigdecimal": "number", "double": "number", "float": "number", "list": "array",
}
#: Boxed forms.
BOXED = {"int": "Integer", "long": "Long", "boolean": "Boolean", "double": "Double", "float": "Float"}
#: Compose failures, by the first group of which the lower-case text holds a string.
FAILURES = {
    "compose_syntax": ["yaml:", "cannot start any token", "did not find expected"],
    "compose_semantic": ["undefined service", "depends on undefined service"],
    "service_build": ["failed to solve", "dockerfile:", "target "],
    "environment_conflict": ["port is already allocated", "already in use by container"],
    "runtime_health": ["unhealthy", "health"],
}
#: Phrases that end an agent's work.
DONE = ["service is complete", "generation complete", "successfully generated", "all files created", "compilation successful"]
#: States that a resumed run skips.
FINISHED = ["healthy", "approved", "completed", "docker_built"]


def api_type(source_type: Column) -> Column:
    return cases([(F.lower(source_type).contains(k), v) for k, v in API_TYPES.items()], "object")


def boxed(source_type: Column) -> Column:
    return cases([(source_type == k, v) for k, v in BOXED.items()], source_type)


def holds_any(text: Column, parts: list[str]) -> Column:
    low, out = F.lower(F.coalesce(text, F.lit(""))), F.lit(False)
    for part in parts:
        out = out | low.contains(part)
    return out


def failure_class(text: Column) -> Column:
    return cases([(holds_any(text, parts), name) for name, parts in FAILURES.items()], "unknown")


def is_done(text: Column) -> Column:
    return holds_any(text, DONE)


def is_finished(state: Column) -> Column:
    return F.coalesce(state.isin(FINISHED), F.lit(False))


def snake(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, r"(?<!^)(?=[A-Z])", "_"))


def table_name(name: Column, source: Column) -> Column:
    """The name in the source's table annotation, or the class name in snake case with an s."""
    given = F.regexp_extract(F.coalesce(source, F.lit("")), r'@Table\s*\(\s*name\s*=\s*"(\w+)"', 1)
    return F.coalesce(F.nullif(given, F.lit("")), F.concat(snake(name), F.lit("s")))


def field_annotations(name: Column) -> Column:
    return F.array_compact(F.array(
        F.when(name == "id", F.lit("@Id")), F.when(name == "id", F.lit("@GeneratedValue(strategy = GenerationType.IDENTITY)")),
        F.when(name.isin("firstName", "lastName"), F.concat(F.lit('@Column(name = "'), snake(name), F.lit('")'))),
    ))


def base_package(package: Column, service: Column) -> Column:
    return F.coalesce(F.nullif(package, F.lit("")), F.concat(F.lit("com.example."), F.replace(service, F.lit("-"), F.lit(""))))


def boot_version(version: Column, default: str = "3.2.0") -> Column:
    v = F.trim(version)
    return F.coalesce(F.when(v.rlike(r"^\d") & ~v.startswith("4."), v), F.lit(default))


def service_name(first_entity: Column, package: Column, cluster_id: Column) -> Column:
    """From the first entity's simple name without its ending, else the commonest package's last part, else the id."""
    stem = lambda x: F.concat(F.lower(x), F.lit("-service"))
    entity = F.nullif(F.regexp_replace(last_part(first_entity), "Entity$", ""), F.lit(""))
    return F.coalesce(stem(entity), stem(F.nullif(last_part(package), F.lit(""))), F.concat(F.lit("service-"), cluster_id.cast("string")))


def ignored(path: Column, patterns: list[str], strict: bool = False) -> Column:
    """Whether a path is left out. By default a pattern's stars and double-star slashes go and the rest is sought anywhere; strict: as a glob."""
    out = F.lit(False)
    for p in patterns:
        if strict:
            body = "".join("(.*/)?" if x == "**/" else ".*" if x == "**" else "[^/]*" if x == "*" else "[^/]" if x == "?" else "\\" + x if x in ".+()[]{}^$|\\" else x for x in _glob_parts(p))
            out = out | path.rlike("^" + body + "$")
        else:
            out = out | path.contains(p.replace("**/", "").replace("**", ""))
    return out


def _glob_parts(pattern: str) -> list[str]:
    import re

    return re.findall(r"\*\*/|\*\*|\*|\?|.", pattern)
