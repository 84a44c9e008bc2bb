import json

from lattica.plans import openapi as o
from lattica.sources.javaparse import parse

CONTROLLER = '''package clinic; @RestController @RequestMapping("/owners") public class OwnerController {
    @GetMapping("/{id}") public Owner show(@PathVariable Long id, @RequestParam String q) { return null; }
    @PostMapping public void make(@RequestBody Owner o) { }
    @GetMapping public List<Owner> all() { return null; } }'''


def test_document(spark):
    from lattica.functions.extract import endpoints

    r = parse(CONTROLLER)
    mapped = "array<struct<mapping:string,suffix:string,name:string,return_type:string,parameters:array<struct<type:string,name:string,annotations:array<string>>>>>"
    c = spark.createDataFrame([("clinic.OwnerController", r["base_path"], r["mapped"])], f"id string, base string, methods {mapped}")
    paths = o.paths(o.operations(endpoints(c)), spark.createDataFrame([("clinic.OwnerController", 1)], "id string, seq long"))
    entity = spark.createDataFrame([("clinic.Owner", "Owner", "Entity", [("Long", "id"), ("List<Pet>", "pets")], [("clinic.Pet", "OneToMany", "pets")])], "id string, simple_name string, type string, fields array<struct<type:string,name:string>>, jpa_relationships array<struct<target_class:string,relationship_type:string,field_name:string>>")
    doc = json.loads(o.document("owners", paths, o.schema_rows(entity)))
    show = doc["paths"]["/owners/{id}"]["get"]
    assert [(p["name"], p["in"], p["schema"]["type"]) for p in show["parameters"]] == [("id", "path", "integer"), ("q", "query", "string")]
    both = doc["paths"]["/owners"]
    assert both["post"]["requestBody"]["content"]["application/json"]["schema"] == {"$ref": "#/components/schemas/Owner"}
    assert both["get"]["responses"]["200"]["content"]["application/json"]["schema"]["type"] == "array"
    assert doc["components"]["schemas"] == {"Owner": {"type": "object", "properties": {"id": {"type": "integer"}}}}


def test_shared_cluster(spark):
    r = spark.createDataFrame([(3, "common-service"), (1, "x"), (2, "shared")], "cluster_id long, name string")
    assert o.shared_cluster(r).first().cluster_id == 2 and o.shared_cluster(r.where("cluster_id = 1")).count() == 0


def test_documents_of_services(spark):
    """Names with quotes, a path that two controllers share, services without paths or schemas."""
    points = spark.createDataFrame([("a.A", "/x", "get", 'o"1', "void", []), ("a.B", "/x", "post", "o2", "Pet", []), ("b.C", "/x", "get", "o3", "List<Pet>", [])], "id string, path string, http_method string, name string, returns string, parameters array<struct<type:string,name:string,annotations:array<string>>>")
    entities = spark.createDataFrame([("c.E", 'E"', '{"type":"object","properties":{}}')], "id string, name string, schema string")
    placed = spark.createDataFrame([("a.A", 1), ("a.B", 1), ("b.C", 2), ("c.E", 3)], "id string, cluster_id long")
    order = spark.createDataFrame([("a.A", 1), ("a.B", 2), ("b.C", 3), ("c.E", 4)], "id string, seq long")
    rows = o.document_parts(points, entities, placed, order).orderBy("cluster_id", "part", "key").collect()
    docs = {c: json.loads("\n".join(o.document_lines(f"s{c}", [(r.part, r.key, r.value) for r in rows if r.cluster_id == c]))) for c in (1, 2, 3, 4)}
    assert list(docs[1]["paths"]["/x"]) == ["post"] and docs[2]["paths"]["/x"]["get"]["operationId"] == "o3"
    assert docs[3]["components"]["schemas"] == {'E"': {"type": "object", "properties": {}}} and docs[4]["paths"] == {} and docs[4]["info"]["title"] == "s4"


def test_spec_lines():
    from lattica.plans.specs import lines

    rows = [("entities", '{"a":1}'), ("entities", '{"a":2}'), ("services", '{"b":1}')]
    doc = json.loads("\n".join(lines('{"name":"s"}', iter(rows))))
    assert doc == {"name": "s", "entities": [{"a": 1}, {"a": 2}], "repositories": [], "services": [{"b": 1}], "controllers": [], "gateway_clients": []}
    assert json.loads("\n".join(lines('{"name":"s"}', iter([]))))["controllers"] == []
