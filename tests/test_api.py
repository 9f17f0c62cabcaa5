"""Questions to an index built from source text."""

import pytest

from lattica.functions import roles
from lattica.operators import scopes
from lattica.plans.api import Index, federated, federated_ask
from lattica.sources import extract

MATH = "def add(a, b):\n    return a + b\n\n\ndef mul(a, b):\n    return a * b\n"
USE = "def total(xs):\n    return add(xs, 1)\n\n\ndef report(xs):\n    # NEEDLE\n    return total(xs)\n\n\ndef area(w, h):\n    return mul(w, h)\n"


@pytest.fixture(scope="module")
def index(spark):
    files = spark.createDataFrame([("src/math.py", MATH), ("src/use.py", USE), ("docs/x.py", "NEEDLE = 1\n")], "path string, text string").cache()
    nodes, edges = extract.build(files)
    return Index(nodes.cache(), edges.cache(), files)


def test_callers(index):
    assert {r.id for r in index.callers("add").collect()} >= {"src/use.py#total"}
    deep = {r.id: r.depth for r in index.callers("add", depth="all").where("relation = 'calls'").collect()}
    assert deep == {"src/use.py#total": 1, "src/use.py#report": 2}
    assert {r.id for r in index.callers("area", "out").where("relation = 'calls'").collect()} == {"src/math.py#mul"}
    with pytest.raises(ValueError):
        index.callers("add", "up")


def test_ask(index):
    assert [r.id for r in index.ask("who calls total").collect()] == ["src/use.py#report"]
    top = index.ask("area").collect()
    assert top[0].id == "src/use.py#area" and "src/math.py#mul" in {r.id for r in top}
    assert index.ask("nothingthere").count() == 0
    c = index.coverage("area zebra").first()
    assert 0 < c.coverage < 1 and c.strong == c.coverage


def test_ask_finds_words_of_bodies(spark):
    source = "# jitter of the fleet\nLIMIT = 3\n\n\ndef wait(n):\n    # exponential backoff\n    return n * 2\n\n\ndef other():\n    return 1\n"
    files = spark.createDataFrame([("a.py", source), ("b.go", "package b\n// quorum\nfunc Run() {\n  lease(1)\n}\n"), ("bad.py", "def (\nzygote")], "path string, text string")
    index = Index(*extract.build(files), files)
    bodies = {r.id: r.body_text for r in index.nodes.collect()}
    assert bodies["a.py"] == "# jitter of the fleet LIMIT = 3" and bodies["a.py#wait"] == "def wait(n): # exponential backoff return n * 2"
    assert bodies["b.go"] == "package b // quorum" and bodies["b.go#Run"] == "func Run() { lease(1) }" and bodies["bad.py"] == "def ( zygote"
    assert [r.id for r in index.ask("backoff", graph_rank=False).collect()] == ["a.py#wait"]


def test_long_bodies_are_cut():
    rows = extract.extract_file("x.py", "A = 1\n" * 9000 + "def f():\n" + "    x = 1\n" * 3000)
    assert [len(r["body_text"]) for r in rows.nodes] == [16_000, 5000]


def test_imports_end_at_files(spark):
    tree = {
        "web/util.ts": "export function pad(n) {\n}\n", "web/a.ts": "import { pad } from './util'\n", "web/in/b.ts": "import {\n  pad,\n} from '../util.js'\nimport x from 'react'\n", "web/in/c.js": "const u = require('..//util')\n",
        "p/__init__.py": "", "p/m.py": "", "p/q/n.py": "from ..m import x\nfrom .. import m\nimport os\n",
        "j/src/com/acme/Foo.java": "class Foo {\n}\n", "j/B.java": "import static com.acme.Foo.bar;\nclass B implements Runs, Stops<A> {\n}\n", "j/Runs.java": "interface Runs {\n}\n",
        "c/inc/net/s.h": "", "c/a.c": "#include \"net/s.h\"\n#include <stdio.h>\n", "h/Models/User.php": "", "h/x.php": "use App\\Models\\User;\n",
        "r/src/lib.rs": "use crate::net::Conn;\n", "r/src/net/mod.rs": "use crate::nowhere::deep::X;\n",
        "g/go.mod": "module ex.org/app\n", "g/u/a.go": "package u\n", "g/u/b.go": "package u\n", "g/main.go": "import (\n  \"fmt\"\n  \"ex.org/app/u\"\n)\n",
        "t/x.py": "class K:\n    def f(self, a):\n        pass\n", "t/y.py": "class K:\n    def f(self, a, b):\n        pass\n", "t/z.py": "def go(k: K):\n    k.f(1)\n",
    }
    nodes, edges = extract.build(spark.createDataFrame(list(tree.items()), "path string, text string").cache())
    edges = edges.cache()
    got = {(r.source, r.target) for r in edges.where("relation = 'imports'").collect()}
    inside = {
        ("web/a.ts", "web/util.ts"), ("web/in/b.ts", "web/util.ts"), ("web/in/c.js", "web/util.ts"), ("p/q/n.py", "p/m.py"), ("p/q/n.py", "p/__init__.py"), ("j/B.java", "j/src/com/acme/Foo.java"),
        ("c/a.c", "c/inc/net/s.h"), ("h/x.php", "h/Models/User.php"), ("r/src/lib.rs", "r/src/net/mod.rs"), ("g/main.go", "g/u/a.go"),
    }
    assert got == inside | {("web/in/b.ts", "react"), ("p/q/n.py", "os"), ("c/a.c", "stdio.h"), ("r/src/net/mod.rs", "crate::nowhere::deep::X"), ("g/main.go", "fmt")}
    others = {(r.source, r.relation, r.target) for r in edges.where("relation IN ('calls', 'implements')").collect()}
    assert others == {("j/B.java#B", "implements", "j/Runs.java#Runs"), ("j/B.java#B", "implements", "Stops"), ("t/z.py#go", "calls", "t/x.py#K.f")}
    ranges = spark.createDataFrame([("p/m.py", 1, 1)], "path string, start int, end int")
    assert {r.id for r in Index(nodes, edges).blast(ranges, 1).collect()} == {"p/q/n.py"}


def test_skeleton_grep_map(index):
    assert [r.name for r in index.skeleton("use.py").collect()] == ["total", "report", "area"]
    got = [(r.path, r.symbol, [h.line for h in r.hits]) for r in index.grep("needle", ignore_case=True).collect()]
    assert sorted(got, key=str) == [("docs/x.py", None, [1]), ("src/use.py", "src/use.py#report", [6])]
    m = {r.dir: (r.files, r.symbols, r.languages) for r in index.repo_map().collect()}
    assert m == {"docs": (1, 0, ["python"]), "src/math.py": (1, 2, ["python"]), "src/use.py": (1, 3, ["python"])}


def test_blast(spark, index):
    ranges = spark.createDataFrame([("src/math.py", 2, 2)], "path string, start int, end int")
    got = {r.id: (r.depth, r.origins) for r in index.blast(ranges).collect()}
    assert got == {"src/use.py#total": (1, ["src/math.py"]), "src/use.py#report": (2, ["src/math.py"])}


def test_prefix_and_check(index):
    assert index.under("src").nodes.where("path NOT LIKE 'src/%'").count() == 0
    with pytest.raises(ValueError):
        index.under("sr")
    old = index.nodes.where("name <> 'area'")
    assert [(r.id, r.drift) for r in index.check(old).collect()] == [("src/use.py#area", "added")]


def test_workspace(spark, index):
    nodes, edges = extract.build(spark.createDataFrame([("b.py", "def area_of_circle():\n    pass\n")], "path string, text string"))
    two = {"a": index, "b": Index(nodes, edges)}
    hits = federated_ask(two, "area").collect()
    assert {r.repo for r in hits} == {"a", "b"} and hits[0].score == 1 and all(r.path.startswith(r.repo + "/") for r in hits)
    assert {r.repo for r in federated(two, lambda i: i.under("src").skeleton("use.py")).collect()} == {"a"}


def test_scopes(spark):
    def found(paths, globs=None):
        return {r.prefix: r.markers for r in scopes.discover(spark.createDataFrame([(p,) for p in paths], "path string"), globs).collect()}

    assert found(["a.py", "src/b.py"]) == {"": []}
    assert set(found(["package.json", "frontend/package.json", "backend/go.mod", "a/b/c/pyproject.toml"])) == {"", "frontend", "backend"}
    assert set(found(["svc/go.mod", "svc/inner/go.mod"])) == {"svc"}
    web = ["package.json", "packages/package.json", "packages/a/package.json", "packages/b/x.ts", "tools/package.json", "tools/setup.py"]
    assert set(found(web, ["packages/*"])) == {"packages/a", "packages/b", "tools"}
    assert set(found(["p/a/x.ts", "p/a/b/y.ts"], ["p/**"])) == {"p/a"}


def test_roles(spark):
    files = spark.createDataFrame([(f"f{i}", "x" * 30_000) for i in range(3)], "path string, text string")
    got = roles.summarise(files, lambda text, path: f"{path}:{len(text)}").collect()
    assert {r.summary for r in got} == {f"f{i}:24000" for i in range(3)}
    gate = roles.FailureGate()

    def fail():
        raise OSError

    assert [gate.run(fail)[1] for _ in range(7)] == ["failed"] * 5 + ["skipped"] * 2
    symbols = spark.createDataFrame([("f", "text", ["a", "b"])], "path string, text string, ids array<string>")
    asked = roles.describe_symbols(symbols, lambda text, path, ids: {ids[0]: "s"})
    assert {r.id for r in asked.collect()} == {"a", "b"}
    concepts = spark.createDataFrame([("x", "X", [("y ", "uses", "")], []), ("y", "Y", [("y", "uses", "")], [("p", "h")])], "slug string, name string, links array<struct<to: string, relation: string, description: string>>, sources array<struct<path: string, hash: string>>")
    links = roles.linked_concepts(concepts)
    assert [(r.slug, r.to) for r in links.collect()] == [("x", "y")]
    assert {(r.slug, r.path) for r in roles.inherited_sources(concepts, links).collect()} == {("x", "p"), ("y", "p")}
