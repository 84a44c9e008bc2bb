import json
import random

from pyspark.sql import functions as F

from lattica.sources import jsondoc


def wanted(doc):
    return [(k, x) for k, v in doc.items() if isinstance(v, list) for x in v if isinstance(x, dict)]


def random_doc(rng, n):
    strings = ["a", "", "}{][", 'q"q', "back\\slash", "\\\"}", "é x", "line\nbreak", '": [{', "},{", "\\", "tab\t"]
    value = lambda d: rng.choice([1, None, True, 2.5, rng.choice(strings), rng.choice(strings)]) if d == 0 or rng.random() < 0.5 else rng.choice([lambda: {rng.choice(strings) + str(i): value(d - 1) for i in range(rng.randrange(4))}, lambda: [value(d - 1) for _ in range(rng.randrange(4))]])()
    element = lambda: {"id": rng.choice(strings), **{f"f{i}": value(3) for i in range(rng.randrange(5))}}
    doc = {}
    for k in rng.sample(["nodes", "edges", "meta", "empty", 'odd "key', "name", "mixed", "deep"], 8):
        doc[k] = {"nodes": lambda: [element() for _ in range(n)], "edges": lambda: [element() for _ in range(n // 2)], "meta": lambda: {"a": {"b": [{"c": 1}]}, "d": [[{"e": 2}]]}, "empty": list, 'odd "key': lambda: [element()],
                  "name": lambda: "x", "mixed": lambda: [1, "a", None], "deep": lambda: [{"x": [{"y": {"z": [{}]}}]}, {}]}[k]()
    return doc


def test_elements_of_any_document(spark, tmp_path):
    rng = random.Random(8)
    for i, n in enumerate((0, 60)):
        doc = random_doc(rng, n)
        path = tmp_path / f"{i}.json"
        path.write_text(json.dumps(doc, indent=rng.choice([None, 1]), ensure_ascii=rng.random() < 0.5), encoding="utf-8")
        rows = jsondoc.elements(spark, str(path), range_bytes=rng.choice([700, 5000, 1 << 20])).orderBy("pos").collect()
        assert [(r.key, json.loads(r.json)) for r in rows] == wanted(doc)


def test_read_by_more_than_one_task(spark, tmp_path):
    path = tmp_path / "large.json"
    with path.open("w") as f:
        f.write('{"project": "x", "nodes": [')
        f.write(",".join(json.dumps({"id": f"n{i}", "text": "}" * (i % 3)}) for i in range(100_000)))
        f.write('], "edges": [{"source": "n1", "target": "n2"}]}')
    assert jsondoc._pieces(spark, str(path), 256 << 10).rdd.getNumPartitions() > 1
    nodes = jsondoc.read(spark, str(path), "nodes", "id string, text string", 256 << 10)
    assert nodes.agg(F.count("*"), F.count_distinct("id"), F.sum(F.length("text")), F.min("pos"), F.max("pos")).first() == (100_000, 100_000, 99_999, 0, 99_999)
    assert [tuple(r)[1:] for r in jsondoc.read(spark, str(path), "edges", "source string, target string").collect()] == [("n1", "n2")]


def test_odd_documents(spark, tmp_path):
    for text in ("", "[{}]", '{"a": {}}', '{"a": [{"b": 1'):
        (tmp_path / "odd.json").write_text(text)
        assert jsondoc.elements(spark, str(tmp_path / "odd.json")).count() == 0, text
