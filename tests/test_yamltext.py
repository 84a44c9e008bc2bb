import random

import yaml

from lattica.sources import yamltext

TEXTS = {
    "compose": """# a comment
version: "3.8"
x-common: &common
  restart: always
  environment: &env
    A: 1
    B: 'it''s'
services:
  web:
    <<: *common
    image: "nginx:latest"   # tail
    ports:
    - "18080:80"
    - 8443:443
    - 9000
    - target: 80
      published: 8081
      protocol: tcp
    -   published: "8082"
    depends_on:
      - db
      - cache
    command: ["CMD", "a b", 'c', d e]
    environment:
      C: x
  db:
    <<: [*common, {restart: never, image: pg}]
    environment: *env
    depends_on: {cache: {condition: service_started}, "q r": null}
    healthcheck:
      test: [ "CMD-SHELL",
              "wget || exit 1" ]   # flow over lines
  cache: {}
  empty:
networks: []
""",
    "scalars": """a: 1
b: -1.5
c: yes
d: ~
e: null
f: 0x1F
g: 1:30
h: 12e03
i: "multi
  line quoted"
j: plain over
  two lines
k: |
  block
    kept

  end
l: >-
  folded
  text

  para
m: 'a # b'
n: a#b
o: http://x:80/y
"quoted key": 1
? not_here
""".replace("? not_here\n", ""),
    "lists": """- a
- - b
  - c
- k: v
  w:
  - x
  -
    y: z
-
- "\\u00e9\\t\\x41\\n"
- []
- {a: [1, {b: c}], d: }
""",
    "documents": "---\na: 1\n---\nb:\n  - 2\n...\n",
    "scalar root": "hello world\n",
    "empty": "",
    "comments": "# only\n\n   # this\n",
    "windows": "a:\r\n  b: 1\r\n  c: two words\r\n",
    "strip": "a: |-\n  x\n  y\nb: |+\n  z\n\nc: >\n  one\n  two\n",
    "nested alias": "x: &x {p: 1}\ny: &y\n  q: *x\n  r: 2\nz: *y\nw:\n  <<: *y\n  r: 3\n",
}


def leaves(value, path=(), steps=""):
    if isinstance(value, dict) and value:
        for k, v in value.items():
            yield from leaves(v, path + (str(k),), steps + "k")
    elif isinstance(value, list) and value:
        for i, v in enumerate(value):
            yield from leaves(v, path + (str(i),), steps + "i")
    else:
        kind = {dict: "map", list: "seq", str: "str", int: "int", float: "float", bool: "bool", type(None): "null"}[type(value)]
        yield path, steps, kind, value if kind == "str" else None


def made(spark, texts):
    rows, rejects = yamltext.parse(spark.createDataFrame(list(texts.items()), "file string, text string"))
    out = {}
    for r in rows.collect():
        out.setdefault(r.file, []).append((r.doc, tuple(r.path), r.steps, r.kind, r.value if r.kind == "str" else None))
    out = {k: sorted(x for x in v if x[1] or x[3] != "null") for k, v in out.items()}
    return {k: v for k, v in out.items() if v}, rejects.collect()


def wanted(texts):
    out = {}
    for name, text in texts.items():
        rows = [(i, *x) for i, doc in enumerate(yaml.safe_load_all(text)) for x in leaves(doc) if doc is not None]  # a root of null is no row here
        if rows:
            out[name] = sorted(rows)
    return out


def test_as_the_library_reads_it(spark):
    got, rejects = made(spark, TEXTS)
    want = wanted(TEXTS)
    assert rejects == []
    for name in TEXTS:
        assert got.get(name) == want.get(name), name


def random_value(rng, depth):
    if depth and rng.random() < 0.5:
        return {rng.choice(["a", "b c", "x-y", "n1", "é", "on", "1"]) + str(i): random_value(rng, depth - 1) for i in range(rng.randrange(0, 4))}
    if depth and rng.random() < 0.4:
        return [random_value(rng, depth - 1) for _ in range(rng.randrange(0, 4))]
    return rng.choice([None, True, 12, -3.5, "text", "two words", "a: b", "# no", "", "12", "yes", "line\nbreak\n", "it's", 'say "x"', "- dash", "[b]", "trailing ", "é ü", "x" * 120 + " " + "y" * 60, "*a", "&b", "@c", "null"])


def test_random_documents(spark):
    rng = random.Random(4)
    texts = {}
    for i in range(120):
        value = random_value(rng, 4)
        texts[f"{i}"] = yaml.safe_dump(value, default_flow_style=rng.choice([None, False, False, True]), indent=rng.choice([2, 4]), allow_unicode=True, width=rng.choice([60, 1000]))
    got, rejects = made(spark, texts)
    want = wanted(texts)
    assert rejects == []
    for name in texts:
        assert got.get(name) == want.get(name), texts[name]


def test_rejects(spark):
    bad = {
        "tab": "a:\n\tb: 1\n", "indentation": "a:\n    b: 1\n  c: 2\n", "twice": "a: 1\nb: 2\na: 3\n", "quote": 'a: "open\nb: 1\n', "bracket": "a: [1, 2\nb: 3\n", "alias": "a: *nowhere\n", "inside": "a: x\n  b: 1\n",
        "stray": "a: 1\nstray\n", "behind": 'a: "x" y\n', "scalar": "a: b: c\n", "flow": "a: {b: 1]}\n", "item": "a: 1\n- b\n",
    }
    _, rejects = made(spark, bad | {"fine": "a: 1\n"})
    assert {r.file for r in rejects} == set(bad)


def test_null_and_empty(spark):
    rows, rejects = yamltext.parse(spark.createDataFrame([("a", None), ("b", "")], "file string, text string"))
    assert rows.count() == rejects.count() == 0
    rows, rejects = yamltext.parse(spark.createDataFrame([], "file string, text string"))
    assert rows.count() == rejects.count() == 0


def test_rows_that_no_alias_concerns_are_not_shuffled(spark):
    """No exchange in the plan of the result: only what aliases and merge keys concern is joined; before, every row was, once for each of its prefixes."""
    rows, rejects = yamltext.parse(spark.createDataFrame(list(TEXTS.items()), "file string, text string"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    assert {r.file for r in rows.where("get(path, 0) = 'services'").collect()} == {"compose"}


def test_files_over_many_batches(spark, monkeypatch):
    monkeypatch.setattr(yamltext, "LINES", 3)
    texts = TEXTS | {f"f{i}": TEXTS["compose"] for i in range(20)}
    got, rejects = made(spark, texts)
    assert rejects == [] and got == wanted(texts)
