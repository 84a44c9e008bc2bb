"""YAML text as rows: a row for each scalar, with its path.

Lines are lexed by column expressions. What a line belongs to depends on the lines above, so each file's lines, which follow each other in the task that splits its text, are folded in order by a function over
Arrow batches of them that holds a stack of the open mappings and sequences, as deep as the file is nested. Kinds of scalars, aliases and merge keys are again columns and joins; the joins take the rows that aliases and
merge keys concern, the others stay where they are.

Known: block and flow collections, plain, quoted and block scalars over any number of lines, comments, several documents in a file, anchors, aliases, merge keys. Tags are dropped. Complex keys (``? ``) are not known.
What can't be read is a row of the rejects: tabs as indentation, an indentation that fits nothing, a key twice in one mapping (the latter rows stay), an open quote or bracket, an unknown alias.
A null or empty text has no rows. A row of files is a file of its own, whatever its name.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialize

_PLAIN = r"(?:[^\s\[\]{}#&*!|>'\"%@`,?:-]|[-?:](?=\S))(?:[^:#]|:(?=\S)|(?<=\S)#)*?"
_QUOTED = r"\"(?:[^\"\\]|\\.)*\"|'(?:[^']|'')*'"
#: A key, its colon, and what follows.
KEY = rf"^({_QUOTED}|{_PLAIN})\s*:(?:\s+(.*))?$"
#: Dashes that open items, with the spaces behind them.
ITEMS = r"^((?:-(?: +|$))*)"

ROWS = "file string, doc int, line int, path array<string>, steps string, value string, style string, problem string"
#: Deepest chain of anchors that hold aliases of other anchors.
NESTED = 20
#: Lines that go to Python at a time.
LINES = 20_000
#: Different prefixes or names that are broadcast at most, to leave out early the rows that no alias or merge key concerns.
FEW = 10_000


def lines(files: DataFrame, name: str = "file", text: str = "text") -> DataFrame:
    """(file, line, text, indent, items, key) of every line, lexed as if it stood alone; key is empty if there is none. A file's lines follow each other, the first has line 0."""
    each = files.select(F.col(name).cast("string").alias("file"), F.posexplode(F.split(F.col(text), r"\r\n|\n|\r")).alias("line", "text")).withColumn("body", F.ltrim("text"))
    body = F.col("body")
    each = each.withColumns({"indent": F.length("text") - F.length(body), "items": F.when(body.startswith("-"), F.regexp_extract(body, ITEMS, 1)).otherwise("")})
    rest = F.expr("substring(body, length(items) + 1)")
    key = F.when(F.instr(body, ":") > 0, F.regexp_extract(rest, KEY, 1)).otherwise("")
    return each.select("file", "line", "text", "indent", "items", key.alias("key"))


_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "a": "\a", "b": "\b", "e": "\x1b", "f": "\f", "v": "\v"}


def _quoted_end(text: str, at: int) -> int:
    """The place behind the quoted scalar that begins at ``at``; -1 if it is open."""
    mark, k = text[at], at + 1
    while k < len(text):
        if text[k] == "\\" and mark == '"':
            k += 1
        elif text[k] == mark:
            if mark == "'" and text[k + 1 : k + 2] == "'":
                k += 1
            else:
                return k + 1
        k += 1
    return -1


def _unquoted(text: str) -> str:
    import re

    if text[0] == "'":
        return text[1:-1].replace("''", "'")
    code = lambda m: chr(int(m[2] or m[3] or m[4], 16)) if m[1][0] in "xuU" and len(m[1]) > 1 else _ESCAPES.get(m[1], m[1])
    return re.sub(r"\\(x([0-9a-fA-F]{2})|u([0-9a-fA-F]{4})|U([0-9a-fA-F]{8})|.)", code, text[1:-1], flags=re.S)


def _folded(text: str) -> str:
    """A quoted scalar over several lines as one: a line break is a space, but k empty lines are k breaks; an escaped break is nothing."""
    import re

    if text[0] == '"':
        text = re.sub(r"(?<!\\)((?:\\\\)*)\\\n\n*", r"\1", text)
    return re.sub(r"\n(\n*)", lambda m: m[1] or " ", text)


def _balance(text: str) -> int:
    """Place behind a flow collection that begins the text; -1 if it is open."""
    depth = k = 0
    while k < len(text):
        c = text[k]
        if c in "\"'" and text[k - 1] in "[{,: ":
            k = _quoted_end(text, k)
            if k < 0:
                return -1
            continue
        if c == "#" and text[k - 1].isspace():
            k = text.find("\n", k)
            if k < 0:
                return -1
            continue
        depth += (c in "[{") - (c in "]}")
        k += 1
        if not depth:
            return k
    return -1


class _Flow:
    """Leaves of a flow collection: (path, steps, value, style)."""

    def __init__(self, text: str):
        self.text, self.at = text, 0

    def space(self) -> str:
        """The next character that is neither space nor comment."""
        while (c := self.text[self.at : self.at + 1]).isspace() or c == "#" and self.text[self.at - 1].isspace():
            self.at = self.at + 1 if c != "#" else (self.text + "\n").index("\n", self.at)
        return c

    def scalar(self, stops: str) -> tuple[str, str]:
        if self.space() in ("'", '"'):
            end = _quoted_end(self.text, self.at)
            raw, self.at = self.text[self.at : end], end
            return _unquoted(_folded(raw)), "quoted"
        begin = self.at
        while (c := self.text[self.at : self.at + 1]) and c not in stops and not (c == ":" and self.text[self.at + 1 : self.at + 2] in (" ", "\n", "", ",", "]", "}")) and not (c == "#" and self.text[self.at - 1].isspace()):
            self.at += 1
        raw = _folded(self.text[begin : self.at].strip() or " ").strip()
        return (raw[1:], "alias") if raw[:1] == "*" else (raw, "plain")

    def leaves(self, path: list[str], steps: str):
        first = self.space()
        if first not in ("[", "{"):
            yield path, steps, *self.scalar(",]}")
            return
        self.at += 1
        close, n = {"[": "]", "{": "}"}[first], 0
        while self.space() != close:
            if first == "{":
                key, style = self.scalar(",}")
                below = path + [key], steps + "k"
                if self.space() == ":":
                    self.at += 1
                    if self.space() in (",", "}"):
                        yield *below, "", "plain"
                    else:
                        yield from self.leaves(*below)
                else:
                    yield *below, "", "plain"
            else:
                below = path + [str(n)], steps + "i"
                for leaf in self.leaves(*below):
                    if self.space() == ":" and leaf[1] == below[1]:  # a single pair as an item
                        self.at += 1
                        yield from self.leaves(path + [str(n), leaf[2]], steps + "ik")
                    else:
                        yield leaf
            n += 1
            if self.space() == ",":
                self.at += 1
            elif self.space() != close:
                raise ValueError("bracket")
        self.at += 1
        if not n:
            yield path, steps, None, "seq" if first == "[" else "map"


class Fold:
    """A file's lines in order -> its scalars. Levels: [indent, "k" or "i", path, steps, next item, keys seen]."""

    def __init__(self, file, out):
        self.file, self.out = file, out
        self.doc, self.levels, self.mode = 0, [], None
        self.open = ([], "", 0, -1)  # a node whose value is still to come: path, steps, line, indent of its parent

    def row(self, line, path, steps, value, style):
        self.out.append((self.file, self.doc, line, path, steps, value, style, None))

    def bad(self, line, problem):
        self.out.append((self.file, self.doc, line, None, None, None, None, problem))

    def eval(self, line, text, indent, items, key):
        first = text[indent : indent + 1]
        blank = not first or first.isspace() and not text.strip()
        if self.mode:
            kind = self.mode[0]
            if kind == "block":
                if blank or indent > self.mode[4]:
                    self.mode[5].append(text)
                    return
                self.end_mode()
            elif kind in ("quote", "flow"):
                self.mode[5].append(text.strip())
                joined = "\n".join(self.mode[5])
                if (_quoted_end(joined, 0) if kind == "quote" else _balance(joined)) >= 0:
                    joined = _folded(joined) if kind == "quote" else joined
                    _, path, steps, at, parent, _ = self.mode
                    self.mode = None
                    self.value(joined, path, steps, at, parent)
                return
            elif indent > self.mode[4] and not blank and text.lstrip()[0] != "#" and not text.startswith(("---", "...")):
                if key and not items:
                    self.bad(line, "a key inside a scalar")
                else:
                    self.mode[5].append(self.uncommented(text.strip()))
                return
            elif blank:
                return
            else:
                self.end_mode()
        if blank or first == "#":
            return
        if not indent and text[:3] in ("---", "...") and not text[3:4].strip():
            self.end_document()
            if text[:3] == "---" and text[3:].strip() and text[3:].strip()[0] != "#":
                self.value(text[3:].strip(), [], "", line, -1)
            return
        if text[:1] == "%" and not self.levels:
            return
        if first == "\t":
            self.bad(line, "tab")
            return
        column = indent
        for part in items.split("-")[1:] if items else ():
            ok = self.place(column, "i", line)
            if not ok:
                return
            level = self.levels[-1]
            self.open = (level[2] + [str(level[4])], level[3] + "i", line, column)
            level[4] += 1
            column += 1 + len(part)
        rest = text[indent + len(items) :]
        if key:
            ok = self.place(column, "k", line)
            if not ok:
                return
            level, rest = self.levels[-1], rest[len(key) :].lstrip(" \t\v\f")[1:]
            key = _unquoted(key) if key[0] in "\"'" else key
            if key in level[5] and key != "<<":
                self.bad(line, "key twice")
            level[5].add(key)
            self.open = None
            self.value(rest, level[2] + [key], level[3] + "k", line, column)
        elif rest.strip():
            if self.open is None or indent <= self.open[3] and not items:
                self.bad(line, "neither a key nor an item")
                return
            path, steps, _, parent = self.open
            self.open = None
            self.value(rest, path, steps, line, parent)

    def place(self, column, kind, line):
        """Makes the level of a key or item at a column the last one."""
        if self.open is not None:
            path, steps, at, parent = self.open
            if column > parent or kind == "i" and column == parent and steps[-1:] == "k":
                self.levels.append([column, kind, path, steps, 0, set()])
                self.open = None
                return True
            self.close_open()
        while self.levels and (self.levels[-1][0] > column or self.levels[-1][0] == column and self.levels[-1][1] == "i" and kind == "k"):
            self.levels.pop()
        if self.levels and self.levels[-1][0] == column and self.levels[-1][1] == kind:
            return True
        self.bad(line, "indentation")
        return False

    def close_open(self):
        if self.open is not None and (self.open[0] or self.levels):
            path, steps, line, _ = self.open
            self.row(line, path, steps, "", "plain")
        self.open = None

    def uncommented(self, text):
        if "#" not in text:
            return text.rstrip()
        at = -1 if text[:1] == "#" else min([k for k in (text.find(" #"), text.find("\t#")) if k >= 0], default=len(text))
        return text[: max(at, 0)].rstrip()

    def value(self, text, path, steps, line, parent):
        text = text.strip()
        while text[:1] in ("&", "!"):
            word, _, text = text.partition(" ")
            text = text.strip()
            if word[0] == "&":
                self.row(line, path, steps, word[1:], "anchor")
        first = text[:1]
        if first in ("", "#"):
            self.open = (path, steps, line, parent)
        elif first in "|>" and not self.uncommented(text)[1:].strip("+-0123456789"):
            self.mode = ["block", path, steps, line, parent, [text]]
        elif first in "\"'":
            end = _quoted_end(text, 0)
            if end < 0:
                self.mode = ["quote", path, steps, line, parent, [text]]
            elif text[end:].strip()[:1] not in ("", "#"):
                self.bad(line, "text behind a quote")
            else:
                self.row(line, path, steps, _unquoted(text[:end]), "quoted")
        elif first in "[{":
            end = _balance(text)
            if end < 0:
                self.mode = ["flow", path, steps, line, parent, [text]]
            elif text[end:].strip()[:1] not in ("", "#"):
                self.bad(line, "text behind a bracket")
            else:
                try:
                    found = list(_Flow(text[:end]).leaves(path, steps))
                except (ValueError, IndexError, RecursionError):
                    self.bad(line, "bracket")
                    return
                for leaf in found:
                    self.row(line, *leaf)
        elif first == "*":
            self.row(line, path, steps, self.uncommented(text)[1:], "alias")
        elif first in "%@`,]}" or ": " in self.uncommented(text) or self.uncommented(text).endswith(":"):
            self.bad(line, "scalar")
        else:
            self.mode = ["plain", path, steps, line, parent, [self.uncommented(text)]]

    def end_mode(self):
        kind, path, steps, line, parent, parts = self.mode
        self.mode = None
        if kind == "plain":
            self.row(line, path, steps, " ".join(x for x in parts if x), "plain")
        elif kind == "block":
            head, body = parts[0], parts[1:]
            digits = [int(c) for c in head.split("#")[0] if c.isdigit()]
            used = [len(x) - len(x.lstrip(" ")) for x in body if x.strip()]
            cut = max(parent, 0) + digits[0] if digits else min(used[:1], default=0)
            text = "\n".join(x[cut:] if x.strip() else "" for x in body)
            if head[0] == ">":
                import re

                text = re.sub(r"(?m)(?<=\S)\n(\n*)(?=\S)", lambda m: m[1] or " ", text)
            bare = text.rstrip("\n")
            text = bare if "-" in head.split("#")[0] else text + "\n" if "+" in head.split("#")[0] else bare + "\n" * bool(bare)
            self.row(line, path, steps, text, "block")
        else:
            self.bad(line, "open " + kind)

    def end_document(self):
        if self.mode:
            self.end_mode()
        self.close_open()
        used = bool(self.levels)
        self.levels, self.open = [], ([], "", 0, -1)
        self.doc += used


def _folds(batches):
    """Lines of file after file -> ROWS."""
    import gc

    names = ["file", "doc", "line", "path", "steps", "value", "style", "problem"]
    types = [pa.string(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.string(), pa.string(), pa.string(), pa.string()]
    table = lambda out: pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [()] * len(types), types)], names)
    out = []
    fold = Fold(None, out)
    for b in batches:
        gc.disable()  # rows are many and hold no cycles
        files = b.column(0)
        for at, (line, text, indent, items, key) in enumerate(zip(*[b.column(k).to_pylist() for k in range(1, 6)])):
            if not line:
                fold.end_document()
                fold = Fold(files[at].as_py(), out)
            fold.eval(line + 1, text, indent, items, key)
        gc.enable()
        yield table(out)
        out.clear()
    fold.end_document()
    yield table(out)


#: How plain scalars other than strings begin.
_SPECIAL = r"^($|[-+.~0-9nNyYtTfFoO])"
_NULL = r"^(~|null|Null|NULL|)$"
_BOOL = r"^(yes|Yes|YES|no|No|NO|true|True|TRUE|false|False|FALSE|on|On|ON|off|Off|OFF)$"
_INT = r"^[-+]?(0b[01_]+|0[0-7_]*|[1-9][0-9_]*|0x[0-9a-fA-F_]+|[1-9][0-9_]*(:[0-5]?[0-9])+)$"
_FLOAT = r"^[-+]?(([0-9][0-9_]*)\.[0-9_]*([eE][-+][0-9]+)?|\.[0-9][0-9_]*([eE][-+][0-9]+)?|[0-9][0-9_]*(:[0-5]?[0-9])+\.[0-9_]*|\.(inf|Inf|INF|nan|NaN|NAN))$"


def _kind(style, value):
    plain = lambda pattern: value.rlike(pattern)
    return (
        F.when(style.isin("map", "seq", "alias", "anchor"), style).when(style != "plain", "str").when(~plain(_SPECIAL), "str").when(plain(_NULL), "null").when(plain(_BOOL), "bool").when(plain(_INT), "int").when(plain(_FLOAT), "float").otherwise("str")
    )


def parse(files: DataFrame, name: str = "file", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of files (name, text).

    rows: file, doc (0 for the first document), line, path (keys, and items by number), steps (k or i for each of the path), value, kind (str, int, float, bool, null; map and seq: empty ones).
    rejects: file, doc, line, problem. Aliases are replaced by what they name, merge keys by what they merge.
    """
    # Texts compress well, so Spark would put many in a task by their bytes; folding them takes its time by their lines.
    spark = files.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = lines(files.select(name, text).repartition(tasks), name, text).mapInArrow(_folds, ROWS)
    found = found.withColumn("kind", F.when(F.col("problem").isNull(), _kind(F.col("style"), F.col("value"))))
    found = materialize(found.drop("style").withColumn("value", F.when(F.col("kind") != "null", F.col("value"))), "yaml", LINES)
    rejects = found.where("problem IS NOT NULL").select("file", "doc", "line", "problem")
    return resolve(found.where("problem IS NULL").drop("problem"), rejects)


def _few(df: DataFrame) -> DataFrame | None:
    """The distinct rows, to be broadcast, unless they are many."""
    df = materialize(df.distinct(), "few")
    return F.broadcast(df) if df.count() <= FEW else None


def _sliced(rows: DataFrame, sizes: DataFrame, name: str) -> DataFrame:
    """rows for each of the sizes (a column k) that their path has, with the path's first k as a column of that name. Sizes are no more than files are deep."""
    ks = sorted(r[0] for r in sizes.distinct().collect())
    return rows.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]).cast("array<int>"))).where("size(path) >= k").withColumn(name, F.expr("slice(path, 1, k)"))


def resolve(rows: DataFrame, rejects: DataFrame, nested: int = NESTED) -> tuple[DataFrame, DataFrame]:
    """Aliases replaced by copies of what their anchors name, round by round while copies hold aliases; then merge keys replaced by what they merge, the innermost first."""
    at = ["file", "doc"]
    columns = [*at, "line", "path", "steps", "value", "kind"]
    anchors = materialize(rows.where("kind = 'anchor'").select(*at, F.col("value").alias("name"), F.col("path").alias("prefix"), F.col("line").alias("since")), "anchors")
    aliases = materialize(rows.where("kind = 'alias'").select(columns), "aliases")
    rows = rows.where("kind NOT IN ('anchor', 'alias')").select(columns)
    for _ in range(0 if anchors.isEmpty() else nested):
        # The nearest anchor of the name above the alias.
        named = aliases.join(anchors.withColumnRenamed("name", "value"), [*at, "value"]).where("since <= line")
        named = materialize(named.groupBy(*at, "path", "steps", "line").agg(F.max_by("prefix", "since").alias("prefix")), "named")
        if named.isEmpty():
            break
        own = _sliced(rows.unionByName(aliases).drop("line"), named.select(F.size("prefix").alias("k")), "prefix")
        few = _few(named.select("prefix"))
        own = own if few is None else own.join(few, "prefix", "left_semi")
        copied = own.join(named.select(*at, "prefix", "line", F.col("path").alias("to"), F.col("steps").alias("to_steps")), [*at, "prefix"])
        copied = copied.select(*at, "line", F.expr("concat(to, slice(path, k + 1, size(path)))").alias("path"), F.expr("concat(to_steps, substring(steps, k + 1))").alias("steps"), "value", "kind")
        copied = materialize(copied, "copied")
        kept = aliases.join(named.select(*at, "path", "line"), [*at, "path", "line"], "left_anti").select(columns)
        aliases = materialize(kept.unionByName(copied.where("kind = 'alias'")), "aliases")
        rows = rows.unionByName(copied.where("kind <> 'alias'"))
    rejects = rejects.unionByName(aliases.select(*at, "line", F.lit("unknown alias").alias("problem")))
    holds = F.array_contains("path", "<<")
    merges = F.size(F.filter("path", lambda x: x == "<<"))
    plain, merging = rows.where(~holds), materialize(rows.where(holds), "merging")
    for count in range(merging.agg(F.max(merges)).first()[0] or 0, 0, -1):
        # Before the innermost merge key: the mapping that takes; behind it the number of an item of a list of merges, or at once a key.
        merged = merging.where(merges == count).withColumn("depth", F.expr("size(path) - array_position(reverse(path), '<<')"))
        merged = merged.withColumn("listed", F.expr("CAST(substring(steps, depth + 2, 1) = 'i' AS INT)"))
        merged = merged.withColumn("rank", F.expr("IF(listed = 1, CAST(path[depth + 1] AS INT), 0)"))
        whole = F.expr("size(path) <= depth + 1 + listed")
        rejects = rejects.unionByName(merged.where(whole & (F.col("kind") != "map")).select(*at, "line", F.lit("merge of no mapping").alias("problem")))
        merged = merged.where(~whole).select(
            *at, "line", F.expr("concat(slice(path, 1, depth), slice(path, depth + 2 + listed, size(path)))").alias("path"), F.expr("concat(substring(steps, 1, depth), substring(steps, depth + 2 + listed))").alias("steps"),
            "value", "kind", F.expr("concat(slice(path, 1, depth), slice(path, depth + 2 + listed, 1))").alias("key"), "rank",
        )
        merged = materialize(merged, "merged")
        # A merged key gives way to an explicit one, and to one of an earlier item of a list of merges, whole.
        explicit = _sliced(plain.unionByName(merging), merged.select(F.size("key").alias("k")), "key")
        last = F.element_at("key", -1)
        few = _few(merged.select(last.alias("last")))
        explicit = explicit if few is None else explicit.withColumn("last", last).join(few, "last", "left_semi")
        first = merged.groupBy(*at, "key").agg(F.min("rank").alias("rank"))
        merged = merged.join(explicit.select(*at, "key"), [*at, "key"], "left_anti").join(first, [*at, "key", "rank"], "left_semi")
        merging = materialize(merging.where(merges < count).unionByName(merged.select(columns)), "merging")
    return plain.unionByName(merging), rejects
