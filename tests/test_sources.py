import json

import pytest

from lattica import cli, config
from lattica.plans.analysis import Analyzer, run
from lattica.plans.report import compose_services, read_plan, routes, summary
from lattica.sources import incremental, java
from lattica.sources.javaparse import parse
from lattica.streaming.files import fold_changes, watch

OWNER = '''/* header { */
package clinic.owner;
import java.util.List;
import clinic.model.*;
import static clinic.Tools.help;
import clinic.model.Person;

// comment }
@Entity @Table(name = "owners")
public class Owner extends Person implements Comparable<Owner>, java.io.Serializable {
    static final Map<String, List<int[]>> CACHE = new HashMap<>() {{ put("a;b", null); }};
    @OneToMany(cascade = CascadeType.ALL, mappedBy = "owner")
    private List<Pet> pets = new ArrayList<>(), spare;
    int a, b[];
    { a = 1; }
    public Owner() { }
    public List<Pet> getPets() { return this.pets; }
    protected static <T extends Comparable<T>> T pick(@Nonnull final T one, int... more) throws IOException { char c = '}'; return one; }
    abstract void nothing();
    class Inner { int hidden; void skip() {} }
    enum Kind { A, B }
}
class Second { }
'''
CONTROLLER = '''package clinic.owner;
import clinic.owner.Owner;
@RestController
@RequestMapping("/owners")
public class OwnerController {
    private final OwnerRepository repo;
    @GetMapping("/{id}") public Owner show(@PathVariable Long id) { return null; }
    @PostMapping public Owner make(@RequestBody Owner o) { return o; }
}
'''


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "src"
    for name, text in {"owner/Owner.java": OWNER, "owner/OwnerController.java": CONTROLLER, "owner/OwnerRepository.java": "package clinic.owner; interface OwnerRepository extends Repo<Owner, Long> { Owner find(int id); }", "model/Person.java": "package clinic.model;\npublic abstract class Person { String name; }", "broken/Bad.java": "class {", "kinds/Kind.java": "package k; enum Kind { A }", "test/Skip.java": "class Skip { }"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return root


def test_parser():
    r = parse(OWNER, "f")
    assert (r["fully_qualified_name"], r["superclass"], r["interfaces"], r["annotations"], r["is_abstract"]) == ("clinic.owner.Owner", "Person", ["Comparable", "java.io.Serializable"], ["Entity", "Table"], False)
    assert [(f["type"], f["name"]) for f in r["fields"]] == [("Map<String, List<int[]>>", "CACHE"), ("List<Pet>", "pets"), ("List<Pet>", "spare"), ("int", "a"), ("int[]", "b")]
    assert [m["name"] for m in r["methods"]] == ["getPets", "pick", "nothing"]
    pick = r["methods"][1]
    assert pick["is_static"] and not pick["is_public"] and pick["parameters"] == [{"type": "T", "name": "one"}, {"type": "int[]", "name": "more"}]
    assert r["methods"][2]["return_type"] is None
    assert r["jpa_relationships"] == [{"target_class": "clinic.owner.Pet", "relationship_type": "OneToMany", "field_name": "pets"}]
    assert [(d["target_class"], d["dependency_type"]) for d in r["dependencies"]] == [("clinic.model", "IMPORTS"), ("clinic.Tools.help", "IMPORTS"), ("clinic.model.Person", "IMPORTS"), ("Person", "INHERITS"), ("Comparable", "INHERITS"), ("java.io.Serializable", "INHERITS")]
    m = parse(CONTROLLER)
    assert m["base_path"] == "/owners" and [(x["mapping"], x["suffix"]) for x in m["mapped"]] == [("GetMapping", "/{id}"), ("PostMapping", "")]
    assert parse("class {") is None and parse("enum K { A }") is None and parse("") is None and parse("class A { void f( { }") is None


def test_scan_and_graph(spark, tree):
    parsed = java.classes(java.scan(spark, str(tree), ["**/test/**"]))
    assert parsed.count() == 6 and java.rejects(parsed).count() == 2
    nodes, edges = java.graph_tables(parsed)
    kinds = {r.id: r.type for r in nodes.collect()}
    assert kinds["clinic.owner.Owner"] == "Entity" and kinds["clinic.owner.OwnerController"] == "Controller" and kinds["Person"] == "Unknown"
    assert ("clinic.owner.OwnerController", "clinic.owner.Owner") in {(r.src, r.dst) for r in edges.collect()}
    assert not any(r.dst.startswith("java.") for r in edges.collect())


def test_analyzer_incremental_and_outputs(spark, tree, tmp_path):
    cache = str(tmp_path / "cache")
    a = Analyzer(spark, str(tree), cache=cache)
    first = {tuple(r) for r in a.analyze().edges.select("src", "dst", "weight").collect()}
    assert a.parsed_files == 6
    b = Analyzer(spark, str(tree), cache=cache)
    assert {tuple(r) for r in b.analyze().edges.select("src", "dst", "weight").collect()} == first and b.parsed_files == 0
    (tree / "model/Person.java").write_text("package clinic.model;\npublic class Person extends Thing { }")
    (tree / "owner/OwnerController.java").unlink()
    c = Analyzer(spark, str(tree), cache=cache)
    ids = {r.id for r in c.analyze().nodes.collect()}
    assert c.parsed_files == 1 and "Thing" in ids and "clinic.owner.OwnerController" not in ids
    p = c.plan()
    assert p.assignment.count() == c.graph.nodes.count() == p.assignment.select("id").distinct().count()
    c.write(str(tmp_path / "out"))
    doc = json.loads((tmp_path / "out/plan.json").read_text())
    assert doc["total_classes"] == p.assignment.count() and len(doc["clusters"]) == doc["suggested_services"] == p.report.count()
    clusters, calls = read_plan(spark, str(tmp_path / "out/plan.json"))
    assert clusters.count() == len(doc["clusters"]) and calls.count() == len(doc["boundary_calls"])
    assert "## Executive Summary" in (tmp_path / "out/plan.md").read_text() and "# Implementation Guide" in (tmp_path / "out/guide.md").read_text()
    folders = [f for f in (tmp_path / "out/services").iterdir()]
    assert len(folders) == clusters.count() and all(json.loads((f / "openapi.yaml").read_text())["info"]["title"] == f.name for f in folders)
    specs = [json.loads((f / "spec.json").read_text()) for f in folders]
    assert all(s["name"] == f.name and {"entities", "repositories", "services", "controllers", "gateway_clients"} <= s.keys() for s, f in zip(specs, folders))
    held = [e for s in specs for e in s["entities"]]
    assert held and all(e["source_code"] for e in held) and len(held) == sum(len(s["repositories"]) for s in specs)
    assert all(list(f.glob("diagrams/api-flow.puml")) for f in folders)
    guide = (tmp_path / "out/guide.md").read_text()
    assert "#### Entities and their tables" in guide and "## Steps for each service" in guide
    (tmp_path / "out/services/gone/diagrams").mkdir(parents=True)
    (tmp_path / "out/services/gone/spec.json").write_text("{}")
    (tmp_path / "out/services/mine").mkdir()
    (tmp_path / "out/services/mine/notes.txt").write_text("kept")
    a.write(str(tmp_path / "out"))
    assert not (tmp_path / "out/services/gone").exists() and (tmp_path / "out/services/mine/notes.txt").exists()


def test_run_and_cli(spark, tree, tmp_path, capsys):
    got = run(spark, str(tree), str(tmp_path / "o"))
    docs = [json.loads(f.read_text()) for f in (tmp_path / "o/services").glob("*/openapi.yaml")]
    assert any(d["paths"] for d in docs) and any(d["components"]["schemas"] for d in docs) and "#### Endpoints" in (tmp_path / "o/guide.md").read_text()
    assert got["clustering"]["services"] >= 1 and run(spark, str(tree), str(tmp_path / "o")) == got
    assert cli.main(["analyze", str(tmp_path / "nowhere"), "--out", str(tmp_path / "x")]) == 1
    assert cli.main(["visualize", str(tree), "--out", str(tmp_path / "g.json")]) == 0
    assert json.loads((tmp_path / "g.json").read_text())["nodes"]


def test_changes_and_checkpoints(spark, tmp_path):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1"), ("d", "1")], "file_path string, content_hash string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("e", "1"), ("d", "")], "file_path string, content_hash string")
    assert {r.file_path: r.state for r in incremental.changes(old, new).collect()} == {"a": "unchanged", "b": "changed", "c": "deleted", "d": "changed", "e": "new"}
    assert incremental.remove(incremental.upsert(old, new), new.where("file_path = 'e'")).count() == 4
    c = incremental.Checkpoints(str(tmp_path / "c"))
    assert c.resume_point() is None
    c.save("analysis", {"n": 1})
    c.save("gateway", {})
    c.save("service_x", {})
    assert c.completed() == ["analysis", "gateway"] and c.resume_point() == "analysis" and c.services() == ["x"] and c.load("analysis")["n"] == 1
    c.request_approval("s", {"k": 1})
    assert c.pending("s")
    c.approve("s")
    assert not c.pending("s")
    c.clear()
    assert not c.completed()
    s = incremental.Snapshots(spark, str(tmp_path / "snap"))
    assert s.load() is None and s.config_changed("x") and not s.info()["exists"]
    s.save({"files": old}, config_hash=incremental.config_hash("x"), file_count=4)
    assert not s.config_changed("x") and s.config_changed("y") and s.load()["files"].count() == 4 and s.info()["files"] == 4
    s.invalidate()
    assert s.load() is None


def test_stream(spark, tree, tmp_path):
    snaps, seen = incremental.Snapshots(spark, str(tmp_path / "snap")), []
    go = lambda: fold_changes(watch(spark, str(tree)), snaps, str(tmp_path / "cp"), lambda df: seen.append(df.count())).awaitTermination(60)
    assert go() and sum(seen) == 7
    (tree / "owner/New.java").write_text("class New { }")
    assert go() and sum(seen) == 8 and snaps.load()["files"].count() == 8


def test_stream_and_analysis_share_a_snapshot(spark, tree, tmp_path):
    from lattica.plans.analysis import Analyzer

    cache = tmp_path / "cache"
    a = Analyzer(spark, str(tree), cache=str(cache))
    a.analyze()
    (tree / "owner/Later.java").write_text("class Later { }")
    snaps = a.snapshots
    assert fold_changes(watch(spark, str(tree)), snaps, str(tmp_path / "cp2")).awaitTermination(60)
    assert {"files", "classes", "parsed_files"} <= snaps.load().keys() and snaps.info()["files"] > 0
    again = Analyzer(spark, str(tree), cache=str(cache))
    again.analyze()
    assert again.parsed_files == 1  # what the stream has seen is still parsed
    remote = incremental.Snapshots(spark, f"file://{tmp_path}/remote")
    remote.save({"files": spark.range(3)})
    assert remote.load()["files"].count() == 3
    remote.invalidate()
    assert remote.load() is None


def test_config(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "lattica.json").write_text(json.dumps({"project": {"name": "p", "java_version": 11}, "analysis": {"constraints": [{"group": "g", "classes": ["a*"]}], "clustering": {"resolution": 2.0}}, "llm": {"model": "gpt-4"}}))
    (tmp_path / "below/src").mkdir(parents=True)
    (tmp_path / "below/src/lattica.yaml").write_text("project: {name: q}")
    assert config.find(tmp_path / "below") == tmp_path / "below/src/lattica.yaml" and config.load(config.find(tmp_path / "below")).name == "q"
    (tmp_path / "projects/shop/src/main/java").mkdir(parents=True)
    (tmp_path / "projects/plain").mkdir()
    assert config.source_and_output(tmp_path / "sub", project="shop") == (tmp_path / "projects/shop/src/main/java", tmp_path / "output")
    assert config.source_and_output(tmp_path, project="plain", output=str(tmp_path / "o")) == (tmp_path / "projects/plain", tmp_path / "o")
    assert config.source_and_output(tmp_path / "sub", source=str(tmp_path / "below"))[0] == tmp_path / "below"
    for wrong in ({"project": "none"}, {"source": str(tmp_path / "none")}, {}):
        with pytest.raises(FileNotFoundError):
            config.source_and_output(tmp_path, **wrong)
    c = config.load(config.find(tmp_path / "sub"))
    assert (c.name, c.resolution, c.constraints, c.model, c.root) == ("p", 2.0, [["a*"]], "gpt-4", tmp_path)
    with pytest.raises(ValueError):
        config.Config(resolution=11)
    with pytest.warns(UserWarning):
        config.Config(model="unheard-of")
    with pytest.raises(FileNotFoundError):
        config.load(tmp_path / "none.json")
    (tmp_path / "pom.xml").write_text("")
    assert config.build_root(tmp_path / "sub") == tmp_path and config.merged_metadata({"a": None, "b": 2}, {"a": 1, "b": 1}) == {"a": 1, "b": 2}


def test_compose_and_summary(spark):
    s = spark.createDataFrame([("z-service", 8081), ("api-gateway", 8080), ("a-service", 8082)], "name string, port int")
    got = compose_services(s).collect()
    assert [(r.name, r.host_port) for r in got] == [("api-gateway", 18080), ("a-service", 18081), ("z-service", 18082)] and "condition: service_started" in got[0].body and "depends_on" not in got[1].body
    r = summary(spark.createDataFrame([(True, 0.5), (False, 0.25)], "success boolean, cost double")).first()
    assert (r.succeeded, r.total, r.cost) == (1, 2, 0.75)
    assert routes(s).where("name = 'a-service'").first().route == "/api/a-service/**"
