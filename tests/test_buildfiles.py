from lattica.sources import buildfiles as b

ROOT = """<?xml version="1.0"?><project xmlns="http://maven.apache.org/POM/4.0.0">
<parent><groupId>org.springframework.boot</groupId><artifactId>spring-boot-starter-parent</artifactId><version>${boot}</version><relativePath/></parent>
<groupId>com.shop</groupId><artifactId>root</artifactId><version>1.${minor}</version><packaging>pom</packaging>
<properties><boot>3.2.1</boot><minor>${x}.${y}</minor><x>4</x><y>5</y><java.version>17</java.version><loop.a>${loop.b}</loop.a><loop.b>a${loop.a}</loop.b><open>${nowhere}</open></properties>
<modules><module>core</module><module>web</module></modules>
<dependencyManagement><dependencies><dependency><groupId>g</groupId><artifactId>managed</artifactId><version>${minor}</version><scope>test</scope></dependency></dependencies></dependencyManagement>
<dependencies><dependency><groupId>g</groupId><artifactId>everywhere</artifactId><version>1</version></dependency></dependencies></project>"""
FILES = {
    "app/pom.xml": ROOT,
    "app/core/pom.xml": "<project><parent><groupId>com.shop</groupId><artifactId>root</artifactId><version>x</version></parent><artifactId>core</artifactId><properties><x>9</x><behind>${loop.a}!</behind></properties>"
    "<dependencies><dependency><groupId>g</groupId><artifactId>managed</artifactId></dependency><dependency><groupId>${project.groupId}</groupId><artifactId>everywhere</artifactId><version>${project.version}</version></dependency>"
    "<dependency><groupId>g</groupId><artifactId>everywhere</artifactId><version>2</version></dependency></dependencies></project>",
    "app/web/pom.xml": "<project><parent><groupId>com.shop</groupId><artifactId>core</artifactId><version>x</version><relativePath>.././core</relativePath></parent><artifactId>web</artifactId><version>7</version>"
    "<build><plugins><plugin><artifactId>other</artifactId></plugin><plugin><artifactId>maven-compiler-plugin</artifactId><configuration><source>1.8</source><release>${java.version}</release></configuration></plugin></plugins></build><properties><java.version>21</java.version></properties></project>",
    "lone/pom.xml": "<project><artifactId>lone</artifactId><version> </version><dependencies><dependency><groupId>io.quarkus</groupId><artifactId>q</artifactId></dependency></dependencies></project>",
    "far/pom.xml": "<project><parent><groupId>com.shop</groupId><artifactId>web</artifactId><version>7</version></parent><artifactId>far</artifactId></project>",
    "ring/a/pom.xml": "<project><parent><groupId>r</groupId><artifactId>b</artifactId><version>1</version><relativePath>../b</relativePath></parent><groupId>r</groupId><artifactId>a</artifactId><version>1</version></project>",
    "ring/b/pom.xml": "<project><parent><groupId>r</groupId><artifactId>a</artifactId><version>1</version><relativePath>../a</relativePath></parent><groupId>r</groupId><artifactId>b</artifactId><version>1</version></project>",
    "broken/pom.xml": "<project><artifactId>",
    "empty/pom.xml": "",
    "g/build.gradle": """plugins { id 'java'; id 'org.springframework.boot' version '3.1.0' }
// id 'org.springframework.boot' version '9'
group = 'com.g'
version = "$base-SNAPSHOT"
ext.base = '2.0'
def lib = "5.${base}"
java { toolchain { languageVersion = JavaLanguageVersion.of(21) } }
dependencies {
    implementation "a:b:${lib}"
    testImplementation('c:d')
    runtimeOnly 'e:f:1'
}""",
    "k/build.gradle.kts": "val v = \"4.1\"\nversion = \"1\"\ndependencies { \n implementation(\"io.micronaut:m:$v\")\n}\njava { sourceCompatibility = JavaVersion.VERSION_17 }\n",
}


def files(spark):
    return spark.createDataFrame([*FILES.items(), ("null/pom.xml", None)], "path string, text string").coalesce(1)


def test_projects(spark):
    projects, properties, used = b.maven(files(spark))
    p = {r.path: (r.parent, r.group, r.artifact, r.version, r.packaging) for r in projects.collect()}
    assert p["app/pom.xml"] == (None, "com.shop", "root", "1.4.5", "pom")
    assert p["app/core/pom.xml"] == ("app/pom.xml", "com.shop", "core", "1.9.5", "jar")  # ${minor} with its own x
    assert p["app/web/pom.xml"] == ("app/core/pom.xml", "com.shop", "web", "7", "jar")
    assert p["far/pom.xml"] == ("app/web/pom.xml", "com.shop", "far", "7", "jar")
    assert p["lone/pom.xml"] == (None, None, "lone", None, "jar")
    assert p["ring/a/pom.xml"][0] == "ring/b/pom.xml" and len(p) == 7
    v = {(r.path, r.name): (r.value, r.state) for r in properties.collect()}
    assert v["app/pom.xml", "minor"] == ("4.5", "ok") and v["app/web/pom.xml", "minor"] == ("9.5", "ok")
    assert v["app/pom.xml", "loop.a"] == ("${loop.b}", "cycle") and v["app/core/pom.xml", "behind"] == ("${loop.a}!", "cycle")
    assert v["app/pom.xml", "open"] == ("${nowhere}", "ok")
    d = {(r.path, r.group, r.artifact): (r.version, r.scope, r.depth) for r in used.collect()}
    assert d["app/core/pom.xml", "g", "managed"] == ("9.5", "test", 0)
    assert d["app/core/pom.xml", "g", "everywhere"] == ("2", "compile", 0) and d["app/web/pom.xml", "g", "everywhere"] == ("2", "compile", 1)
    assert d["app/core/pom.xml", "com.shop", "everywhere"] == ("1.9.5", "compile", 0)
    assert d["lone/pom.xml", "io.quarkus", "q"] == (None, "compile", 0)


def test_metadata(spark):
    m = {r.path: tuple(r)[1:] for r in b.metadata(files(spark)).collect()}
    assert m["app/pom.xml"] == ("maven", "spring-boot", "3.2.1", "17")
    assert m["far/pom.xml"] == ("maven", "spring-boot", "3.2.1", "21")
    assert m["lone/pom.xml"] == ("maven", "quarkus", None, None)
    assert m["ring/a/pom.xml"] == ("maven", "plain-java", None, None)
    assert m["g/build.gradle"] == ("gradle", "spring-boot", "3.1.0", "21")
    assert m["k/build.gradle.kts"] == ("gradle", "micronaut", None, "17")
    assert "broken/pom.xml" not in m and {r.path for r in b.poms(files(spark))[1].collect()} == {"broken/pom.xml", "empty/pom.xml", "null/pom.xml"}
    full = {r.path: r.java_version for r in b.with_defaults(b.metadata(files(spark)), {"java_version": "8"}).collect()}
    assert full["lone/pom.xml"] == "8" and full["app/pom.xml"] == "17"


def test_gradle(spark):
    projects, used = b.gradle(files(spark))
    p = {r.path: r for r in projects.collect()}
    assert (p["g/build.gradle"].group, p["g/build.gradle"].version) == ("com.g", "2.0-SNAPSHOT")
    d = {(r.group, r.artifact): (r.version, r.scope) for r in used.collect()}
    assert d == {("a", "b"): ("5.2.0", "implementation"), ("c", "d"): (None, "testImplementation"), ("e", "f"): ("1", "runtimeOnly"), ("io.micronaut", "m"): ("4.1", "implementation")}


def test_build_roots(spark):
    folders = spark.createDataFrame([("app/core/src/main",), ("app/x",), ("g/src",), ("none/at/all",), ("app",)], "folder string")
    got = {r.folder: (r.root, r.path) for r in b.build_roots(folders, files(spark)).collect()}
    assert got == {"app/core/src/main": ("app/core", "app/core/pom.xml"), "app/x": ("app", "app/pom.xml"), "g/src": ("g", "g/build.gradle"), "none/at/all": (None, None), "app": ("app", "app/pom.xml")}


def test_empty(spark):
    none = spark.createDataFrame([], "path string, text string")
    assert b.metadata(none).count() == 0 and b.maven(none)[1].count() == 0
