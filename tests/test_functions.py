import pytest
from pyspark.sql import functions as F

from lattica.functions import classify as c
from lattica.functions import extract as x
from lattica.operators import hierarchy, ledger, vectors


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def arr(*xs):
    return F.array(*map(F.lit, xs)).cast("array<string>")


@pytest.mark.parametrize(
    "marks, name, want",
    [(["RestController"], "X", "Controller"), (["MyService"], "XController", "Service"), (["Table"], "X", "Entity"), (["PetDao"], "X", "Repository"), ([], "PetModel", "Entity"), ([], "StringUtils", "Utility"), ([], "X", "Unknown"), ([], "FooController", "Controller")],
)
def test_node_type(spark, marks, name, want):
    assert one(spark, c.node_type(arr(*marks), F.lit(name))) == want


def test_class_type_texts_and_lookups(spark):
    assert one(spark, c.class_type(arr("Service", "Entity"), F.lit(True))) == "Entity" and one(spark, c.class_type(arr("X"), F.lit(True))) == "Interface"
    assert one(spark, c.api_type(F.lit("Point"))) == "integer" and one(spark, c.api_type(F.lit("List<Pet>"))) == "array" and one(spark, c.api_type(F.lit("Pet"))) == "object"
    assert one(spark, c.boxed(F.lit("int"))) == "Integer" and one(spark, c.boxed(F.lit("Foo"))) == "Foo"
    assert one(spark, c.field_annotations(F.lit("firstName"))) == ['@Column(name = "first_name")'] and len(one(spark, c.field_annotations(F.lit("id")))) == 2
    assert one(spark, c.table_name(F.lit("PetType"), F.lit(None).cast("string"))) == "pet_types" and one(spark, c.table_name(F.lit("Owner"), F.lit('@Table(name = "owners")'))) == "owners"
    assert one(spark, c.failure_class(F.lit("Target x failed"))) == "service_build" and one(spark, c.failure_class(F.lit(None).cast("string"))) == "unknown"
    assert one(spark, c.boot_version(F.lit(" 3.1 "))) == "3.1" and one(spark, c.boot_version(F.lit("4.0"))) == "3.2.0" and one(spark, c.boot_version(F.lit(None).cast("string"))) == "3.2.0"
    assert one(spark, c.service_name(F.lit("a.OwnerEntity"), F.lit("q"), F.lit(3))) == "owner-service" and one(spark, c.service_name(F.lit(None).cast("string"), F.lit(""), F.lit(3))) == "service-3"
    assert one(spark, c.is_library(F.lit("javax.x"))) and not one(spark, c.is_library(F.lit("javaxx.x")))
    assert one(spark, c.is_done(F.lit("OK. Service IS complete"))) and one(spark, c.is_finished(F.lit("healthy"))) and not one(spark, c.is_finished(F.lit(None).cast("string")))


def test_ignored(spark):
    at = lambda p, strict=False: one(spark, c.ignored(F.lit(p), ["**/test/**"], strict))
    assert at("a/test/B.java") and at("a/latest/B.java") and not at("a/main/B.java")
    assert at("a/test/B.java", True) and not at("a/latest/B.java", True)


def test_relationships_and_paths(spark):
    src = '@OneToMany(mappedBy="o")\n  private List<Pet> pets;\n@ManyToOne @JoinColumn\n private Owner owner;'
    got = x.relationships(spark.createDataFrame([(1, src), (2, None)], "id long, source string")).collect()
    assert {(r.id, r.relation, r.target, r.field) for r in got} == {(1, "OneToMany", "Pet", "pets"), (1, "ManyToOne", "Owner", "owner")}
    assert one(spark, x.base_path(F.lit('@RequestMapping("/api/pets") class'))) == "/api/pets" and one(spark, x.base_path(F.lit(None).cast("string"))) == ""


def test_replies(spark):
    text = '<tool_call>{"name": "a", "x": {"y": 1}}</tool_call> <tool_call>\n{"name": </tool_call><tool_call>{"id": 1}</tool_call><tool_call>{broken}</tool_call>'
    assert [r.name for r in x.tool_calls(spark.createDataFrame([(1, text)], "id long, content string")).collect()] == ["a"]
    logs = [(1, "[ERROR] /p/A.java:[10,5] error: cannot find  symbol\n more [ERROR] /p/B.java:[1,2] bad [INFO] x"), (2, "nothing"), (3, None)]
    got = x.compile_errors(spark.createDataFrame(logs, "id long, output string")).orderBy("id", "pos").collect()
    assert [(r.file_path, r.line, r.column, r.message) for r in got] == [("/p/A.java", 10, 5, "cannot find symbol more"), ("/p/B.java", 1, 2, "bad")]
    assert one(spark, x.fenced(F.lit("a\n```YAML\nk: 1\n```\n```yaml\nz\n```"), "yaml", "yml")) == "k: 1" and one(spark, x.fenced(F.lit("  plain ``` "), "java")) == "plain"
    f = x.fixed_files(spark.createDataFrame([(1, "### FIXED: a/B.java\n```java\nclass B {}\n```")], "id long, content string")).first()
    assert (f.file, f.body) == ("a/B.java", "class B {}")
    assert one(spark, x.json_or(F.lit("{bad"), "k int", F.struct(F.lit(9).alias("k"))))["k"] == 9


def test_compose(spark):
    rows = spark.createDataFrame([("8080:80", None), ("x:80", None), (None, "9090"), ("8080:81", None), ("127.0.0.1:7000:70", None)], "short string, published string")
    assert [r.port for r in x.host_ports(rows).collect()] == [7000, 8080, 9090]
    s = spark.createDataFrame([("a", ["b"]), ("b", ["zz"])], "name string, depends_on array<string>")
    assert {tuple(r) for r in x.invalid_services(s, spark.createDataFrame([("a",), ("c",)], "name string")).collect()} == {("missing", "c"), ("undefined_dependency", "zz")}
    lines = spark.createDataFrame([('{"Service":"a","State":"Running","Health":""}',), ('{"Service":"b","State":"running","Health":"starting"}',), ("junk",)], "line string")
    assert {r.name: r.healthy for r in x.health(lines, spark.createDataFrame([("a",), ("b",), ("c",)], "name string")).collect()} == {"a": True, "b": False, "c": False}
    assert one(spark, x.service_port(F.lit("server:\n port: 9001"))) == 9001 and one(spark, x.service_port(F.lit(None).cast("string"))) == 8080


def test_hierarchy(spark):
    fields = "array<struct<type:string,name:string>>"
    rows = [(0, "p.A", "p", "A", "B", [("int", "x"), ("int", "a")]), (1, "p.B", "p", "B", "q.C", [("long", "x"), ("long", "b")]), (2, "q.C", "q", "C", None, [("Integer", "b"), ("int", "id")]), (3, "r.D", "r", "D", "E", []), (4, "s.E", "s", "E", "r.D", [("int", "e")])]
    classes = spark.createDataFrame(rows, f"node_seq long, id string, package string, simple_name string, superclass string, fields {fields}")
    assert {(r.id, r.parent) for r in hierarchy.resolve_superclasses(classes).collect()} == {("p.A", "p.B"), ("p.B", "q.C"), ("r.D", "s.E"), ("s.E", "r.D")}
    up = {(r.id, r.ancestor, r.depth) for r in hierarchy.ancestors(hierarchy.resolve_superclasses(classes)).collect()}
    assert up == {("p.A", "p.B", 1), ("p.A", "q.C", 2), ("p.B", "q.C", 1), ("r.D", "s.E", 1), ("s.E", "r.D", 1)}
    a = [(r.name, r.type, r.inherited) for r in hierarchy.all_fields(classes).where("id = 'p.A'").orderBy("pos").collect()]
    assert a == [("x", "int", False), ("a", "int", False), ("b", "long", True), ("id", "int", True)]
    spec = hierarchy.entity_specs(classes.withColumn("type", F.lit("Entity"))).where("id = 'p.A'").first()
    assert spec.id_type == "Integer" and [f.name for f in spec.fields] == ["x", "a", "b", "id"]


def test_ledger(spark):
    calls = spark.createDataFrame([("b", i, c_, c_) for i, c_ in enumerate([3.0, 4.0, 1.0])], "budget string, seq long, estimate double, cost double")
    got = ledger.greedy_accept(calls, 5.0).orderBy("seq").collect()
    assert [r.accepted for r in got] == [True, False, True] and got[-1].total == 4.0
    assert [r.accepted for r in ledger.running_accept(calls, 5.0).orderBy("seq").collect()] == [True, False, False]
    client = ledger.StubClient("gpt-4", limit=0.05, reply=lambda s, u: "x" * 400)
    assert client.chat("a", "b" * 40).tokens == 110
    with pytest.raises(ledger.CostLimitExceeded):
        for _ in range(10):
            client.chat("a", "b")
    tries = []

    def flaky(s, u):
        tries.append(1)
        if len(tries) < 3:
            raise ConnectionError
        return "ok"

    assert ledger.StubClient(reply=flaky, delay=0).chat("", "").content == "ok" and len(tries) == 3
    assert one(spark, ledger.cost(F.lit("none"), F.lit(1_000_000), F.lit(0))) == 5.0


def test_vectors(spark, monkeypatch):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 1.0]), ("c", [0.0, 0.0]), ("d", [-1.0, 0.0])], "id string, vec array<float>")
    sim = lambda a, b: vectors.similarity(v, a, b).first()[0]
    assert sim("a", "b") == pytest.approx(0.5**0.5) and sim("a", "a") == 0.0 and sim("a", "zz") == 0.0 and sim("a", "d") == -1.0
    assert [(r.rank, r.id) for r in vectors.find_similar(v, v.where("id = 'a'"), 2).orderBy("rank").collect()] == [(1, "b"), (2, "d")]
    want = {(r.a, r.b): round(r.similarity, 6) for r in vectors.all_similarities(v).collect()}
    assert set(want) == {("a", "b"), ("a", "d"), ("b", "d")}
    monkeypatch.setattr(vectors, "BLOCK", 1)
    monkeypatch.setattr(vectors, "QUERIES", 1)
    monkeypatch.setattr(vectors, "ROWS", 1)
    assert {(r.a, r.b): round(r.similarity, 6) for r in vectors.all_similarities(v).collect()} == want
    assert vectors.find_similar(v, v, 1).count() == 4
    texts = spark.createDataFrame([("1", "h1", "one two"), ("2", "h2", "three")], "id string, file_hash string, text string")
    stored = spark.createDataFrame([("1", "h1", [9.0]), ("2", "old", [9.0]), ("3", "x", [9.0])], "id string, file_hash string, vec array<float>")
    assert {(r.id, len(r.vec)) for r in vectors.refresh(stored, texts).collect()} == {("1", 1), ("2", 384)}


def test_token_usage_by_vocabulary(spark):
    from tokenizers import Tokenizer

    from lattica.functions import tokens

    t = Tokenizer.from_file(tokens.vocabulary())
    t.encode_special_tokens = True
    texts = ["", None, "a b", "caf\u00e9 <|endoftext|> x", "word " * 20_000]
    got = tokens.usage(spark.createDataFrame(list(enumerate(texts)), "i int, text string"), F.lit("gpt-4")).orderBy("i").collect()
    want = [len(t.encode(x or "", add_special_tokens=False).ids) for x in texts]
    assert [r.tokens for r in got] == want
    assert [(r.fits, r.fits_with_margin) for r in got] == [(n <= 4192, n <= 3772) for n in want] and got[2].available_input == 4192
