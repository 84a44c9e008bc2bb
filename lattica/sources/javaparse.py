"""A declaration reader for Java sources: package, imports, the first top-level type, its annotations, fields and methods.

It reads tokens, not bodies: comments and literals are dropped first, brackets are matched, and what stands at the depth of members is
split into declarations. Sources without a class or interface as first type, or whose brackets don't match, give None.
"""

from __future__ import annotations

import re

TOKENS = re.compile(r'//[^\n]*|/\*.*?\*/|"""(?:\\.|.)*?"""|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|[A-Za-z_$][\w$]*|\d[\w.]*|\.\.\.|->|::|\S', re.S)
MODIFIERS = {"public", "protected", "private", "static", "final", "abstract", "native", "synchronized", "transient", "volatile", "strictfp", "default", "sealed"}
RELATIONS = ("OneToMany", "ManyToOne", "OneToOne", "ManyToMany")
OPEN, CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}


class _Reader:
    def __init__(self, source: str):
        self.t = [x for x in TOKENS.findall(source) if not x.startswith(("//", "/*"))]
        self.i = 0

    def peek(self, k: int = 0) -> str:
        return self.t[self.i + k] if self.i + k < len(self.t) else ""

    def next(self) -> str:
        self.i += 1
        return self.t[self.i - 1] if self.i <= len(self.t) else ""

    def until(self, *ends: str) -> list[str]:
        """Tokens up to one of ends at this depth; the end itself is left."""
        out = []
        while self.i < len(self.t) and self.peek() not in ends:
            out.extend(self.group() if self.peek() in OPEN else [self.next()])
        return out

    def group(self) -> list[str]:
        """A bracket, what it holds and its partner."""
        out, want = [], []
        while self.i < len(self.t):
            x = self.next()
            out.append(x)
            if x in OPEN:
                want.append(OPEN[x])
            elif x in CLOSE:
                if not want or want.pop() != x:
                    raise ValueError("brackets don't match")
                if not want:
                    return out
        raise ValueError("a bracket isn't closed")

    def name(self) -> str:
        out = self.next()
        while self.peek() == "." and re.match(r"[A-Za-z_$*]", self.peek(1)):
            self.next()
            out += "." + self.next()
        return out

    def generics(self) -> str:
        """Type arguments or parameters, if any."""
        if self.peek() != "<":
            return ""
        depth, out = 0, []
        while self.i < len(self.t):
            x = self.next()
            depth += (x == "<") - (x == ">")
            out.append(x)
            if not depth:
                break
        return _type("".join(y + " " if y in ("extends", "super") else " " + y if y in () else y for y in out))

    def type(self) -> str:
        out = self.name() + self.generics()
        while self.peek() == ".":
            self.next()
            out += "." + self.name() + self.generics()
        while self.peek() == "[" and self.peek(1) == "]":
            self.i += 2
            out += "[]"
        return out

    def annotations_and_modifiers(self) -> tuple[list[tuple[str, str]], set[str]]:
        marks, mods = [], set()
        while True:
            if self.peek() == "@" and self.peek(1) != "interface":
                self.next()
                name = self.name()
                body = self.group() if self.peek() == "(" else []
                literals = [x[1:-1] for x in body if x.startswith('"')]
                marks.append((name.rpartition(".")[2], literals[0] if literals else ""))
            elif self.peek() in MODIFIERS or (self.peek() == "non" and self.peek(1) == "-"):
                if self.peek() == "non":
                    self.i += 2
                mods.add(self.next())
            else:
                return marks, mods


def _type(text: str) -> str:
    return re.sub(r"(\w)(extends|super)\s", r"\1 \2 ", text.replace("?extends ", "? extends ").replace("?super ", "? super ")).replace(",", ", ")


def _parameters(tokens: list[str]) -> list[dict]:
    r, out = _Reader(""), []
    r.t = tokens[1:-1]
    while r.i < len(r.t):
        marks, _ = r.annotations_and_modifiers()
        kind = r.type()
        if r.peek() == "...":
            r.next()
            kind += "[]"
        while r.peek() == "@":
            r.annotations_and_modifiers()
        name = r.next()
        while r.peek() == "[":
            r.group()
            kind += "[]"
        if name:
            out.append({"type": kind, "name": name, "annotations": [m for m, _ in marks]})
        if r.peek() == ",":
            r.next()
        elif r.i < len(r.t):
            raise ValueError("a parameter list can't be read")
    return out


def parse(source: str, file_path: str = "") -> dict | None:
    """The record of a source's first class or interface, or None."""
    try:
        return _parse(_Reader(source), file_path)
    except (ValueError, IndexError):
        return None


def _parse(r: _Reader, file_path: str) -> dict | None:
    package, imports = "", []
    marks, mods = r.annotations_and_modifiers()
    if r.peek() == "package":
        r.next()
        package = r.name()
        r.until(";")
        r.next()
        marks, mods = [], set()
    while r.peek() == "import":
        r.next()
        if r.peek() == "static":
            r.next()
        path = r.name()
        r.until(";")
        r.next()
        imports.append(path.removesuffix(".*"))
    if not marks and not mods:
        while r.peek() == ";":
            r.next()
        marks, mods = r.annotations_and_modifiers()
    kind = r.next()
    if kind not in ("class", "interface"):
        return None
    simple = r.next()
    if not re.fullmatch(r"[A-Za-z_$][\w$]*", simple):
        return None
    r.generics()
    superclass, interfaces = None, []
    while r.peek() in ("extends", "implements", "permits"):
        word = r.next()
        names = [r.type()]
        while r.peek() == ",":
            r.next()
            names.append(r.type())
        names = [re.sub(r"<.*", "", n) for n in names]
        if word == "extends" and kind == "class":
            superclass = names[0]
        elif word != "permits":
            interfaces += names
    if r.peek() != "{":
        return None
    body = _Reader("")
    body.t = r.group()[1:-1]
    methods, fields, relations, mapped = [], [], [], []
    while body.i < len(body.t):
        if body.peek() == ";":
            body.next()
            continue
        own, with_ = body.annotations_and_modifiers()
        if body.peek() == "{":  # an initializer
            body.group()
            continue
        if body.peek() in ("class", "interface", "enum", "record", "@") and body.peek(1) != "(":
            body.until("{")
            body.group()
            continue
        body.generics()
        if body.peek() == simple and body.peek(1) == "(":  # a constructor
            body.until("{")
            body.group()
            continue
        returns = body.type()
        name = body.next()
        if body.peek() == "(":
            params = _parameters(body.group())
            body.until("{", ";")
            if body.peek() == "{":
                body.group()
            else:
                body.next()
            methods.append({
                "name": name, "return_type": None if returns == "void" else returns, "parameters": [{"type": p["type"], "name": p["name"]} for p in params],
                "annotations": [m for m, _ in own], "is_public": "public" in with_ or kind == "interface", "is_static": "static" in with_,
            })
            for mark, value in own:
                if mark.endswith("Mapping"):
                    mapped.append({"mapping": mark, "suffix": value, "name": name, "return_type": returns, "parameters": [{"type": p["type"], "name": p["name"], "annotations": p["annotations"]} for p in params]})
            continue
        first = name
        while True:
            suffix = ""
            while body.peek() == "[":
                body.group()
                suffix += "[]"
            fields.append({"type": returns + suffix, "name": name})
            if body.peek() == "=":
                body.until(",", ";")
            if body.next() != ",":
                break
            name = body.next()
        for mark, _ in reversed(own):
            if mark in RELATIONS:
                inner = re.search(r"<(?:.*,\s*)?([\w.$]+)>", returns)
                target = inner[1] if inner else returns
                relations.append({"target_class": _resolve(target, package, imports), "relationship_type": mark, "field_name": first})
                break
    fqn = f"{package}.{simple}" if package else simple
    listed = list(dict.fromkeys(imports))
    depends = [{"target_class": i, "dependency_type": "IMPORTS", "method_name": None} for i in listed if not i.startswith(("java.", "javax."))]
    depends += [{"target_class": x, "dependency_type": "INHERITS", "method_name": None} for x in [superclass, *interfaces] if x]
    return {
        "fully_qualified_name": fqn, "simple_name": simple, "package_name": package, "file_path": file_path, "is_interface": kind == "interface", "is_abstract": "abstract" in mods,
        "superclass": superclass, "interfaces": interfaces, "annotations": [m for m, _ in marks], "base_path": next((v for m, v in marks if m == "RequestMapping"), None),
        "methods": methods, "fields": fields, "dependencies": depends, "imports": listed, "jpa_relationships": relations, "mapped": mapped,
    }


def _resolve(target: str, package: str, imports: list[str]) -> str:
    """An imported name by its last part; else a name of the same package."""
    if "." in target:
        return target
    for i in imports:
        if i.rpartition(".")[2] == target:
            return i
    return f"{package}.{target}" if package else target


PARAMETER = "struct<type:string,name:string>"
SCHEMA = (
    "fully_qualified_name string, simple_name string, package_name string, file_path string, is_interface boolean, is_abstract boolean, superclass string, interfaces array<string>, "
    f"annotations array<string>, base_path string, methods array<struct<name:string,return_type:string,parameters:array<{PARAMETER}>,annotations:array<string>,is_public:boolean,is_static:boolean>>, "
    f"fields array<{PARAMETER}>, dependencies array<struct<target_class:string,dependency_type:string,method_name:string>>, imports array<string>, "
    "jpa_relationships array<struct<target_class:string,relationship_type:string,field_name:string>>, "
    "mapped array<struct<mapping:string,suffix:string,name:string,return_type:string,parameters:array<struct<type:string,name:string,annotations:array<string>>>>>"
)
