"""The code graph, cross references, graph analytics, questions, sources, sinks and the stream."""

import itertools
import json
import os
import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import StringEndsWith, StringStartsWith

from astraloom.functions import calls, javascript
from astraloom.functions.syntax import syntax_rows
from astraloom.functions.tables import numbered
from astraloom.functions.words import mentions
from astraloom.operators import code_graph, findings, graph, lint, questions, report, xref
from astraloom.sources import manifest, tree
from astraloom.sources.tree import described
from astraloom.streaming.watch import CHANGES, lint_changes


def project(spark, files):
    frame = described(spark.createDataFrame(list(files.items()), "path string, content string")).persist()
    rows = syntax_rows(frame).persist()
    return rows, frame, code_graph.build(rows, frame)


APP = {
    "app/__init__.py": "",
    "app/main.py": '"""Main doc.\n\nMore."""\nfrom app.a import work, LIMIT\nimport app.b as bb\nfrom . import c\nfrom .c import *\n@router.get("/x")\ndef handler(q):\n    try:\n        import json\n    finally:\n        pass\n    work(1)\n    return bb.run()\n@bp.route("/y", methods=["post", "GET"])\nasync def h2(): pass\napp.include_router(r, prefix="/p")\napp.include_router(r2)\napp.include_router(r3, prefix=P)\n',
    "app/a.py": 'from app.b import run\nLIMIT = 10\nUNUSED_C = 5\nclass M(Base, mixins.Foo):\n    __tablename__ = "ms"\n    rel = relationship("N")\n    def save(self):\n        """Doc."""\n        return None\ndef work(x):\n    return [i for i in x if i and x]\ndef stub():\n    ...\n',
    "app/b.py": "from app.a import work\ndef run():\n    a = 1111111111\n    b = 2222222222\n    return a + b\n",
    "app/c.py": 'import app.b\nclass N(M):\n    __tablename__ = "ns"\n    def run2(self):\n        a = 1111111111\n        b = 2222222222\n        return a + b\n',
    "app/d.py": "x = (\n",
    "pkg/lonely.py": "def alone():\n    return 1\n",
    "tool.py": "import os\ndef f(a, b):\n    return a\n",
}


@pytest.fixture(scope="module")
def app(spark):
    rows, files, g = project(spark, APP)
    return rows, files, g, xref.CrossReferences(rows, files, g)


def test_nodes(app):
    nodes = {r["id"]: r for r in app[2].nodes.collect()}
    assert len(nodes) == 19
    main = nodes["file:app/main.py"]
    assert (main["docstring"], main["n_routes"], main["line_end"]) == ("Main doc.", 5, 20)
    assert nodes["file:app/d.py"]["docstring"].startswith("PARSE ERROR")
    assert nodes["file:app/a.py"]["tables"] == ["ms", "ns (via N)"]
    assert nodes["func:app/a.py:M.save"]["is_stub"] and nodes["func:app/a.py:stub"]["is_stub"] and not nodes["func:app/a.py:work"]["is_stub"]
    assert nodes["func:app/a.py:work"]["complexity"] == 3 and nodes["func:app/main.py:handler"]["decorators"] == ["router.get"]


def test_lookups(app):
    g = app[2]
    assert code_graph.node(g, "file:tool.py").count() == 1
    assert code_graph.edges_from(g, "file:tool.py").count() == 1 and code_graph.edges_to(g, "func:app/a.py:work").count() == 1


def test_routes(app):
    routes = sorted((r["type"], r["method"] or "", r["route"] or "", r["prefix"] or "", r["warning"] or "") for r in app[2].routes.collect())
    assert routes == [
        ("include_router", "", "", "", "include_router called without prefix"), ("include_router", "", "", "/p", ""), ("include_router", "", "", "<dynamic>", "include_router prefix is dynamic"),
        ("route", "GET", "/x", "", ""), ("route", "POST/GET", "/y", "", ""),
    ]


def test_edges(app):
    edges = sorted((r["source"], r["target"], ",".join(r["flags"])) for r in app[2].edges.filter("path = 'app/main.py'").collect())
    f = "file:app/main.py"
    assert edges == [(f, "file:app/a.py", ""), (f, "file:app/a.py", ""), (f, "file:app/b.py", ""), (f, "file:app/c.py", ""), (f, "file:app/c.py", "dynamic"), (f, "func:app/a.py:work", ""), (f, "module:json", "function_scope,conditional")]
    assert app[2].edges.filter("target = 'class_ref:mixins.Foo'").count() == 1 and app[2].edges.filter("target = 'class:app/a.py:M'").count() == 1


def test_first_and_last_claims(spark):
    """Overwriting claims beat first claims; order is by path components, so a/b.py comes before a-b.py."""
    _, _, g = project(spark, {"pkg/__init__.py": "", "pkg/A.py": "", "pkg/a.py": "def x(): return 2\n", "pkg/sub/b.py": "from .. import a\nfrom ..a import x\n", "a.py": "import pkg\nimport pkg.sub\nimport pkg.sub.b.deep.more\nx()\n", "a-b.py": "def x(): return 1\n", "a/b.py": "def x(): return 3\n"})
    edges = {(r["source"], r["line"]): r["target"] for r in g.edges.collect()}
    assert edges[("file:a.py", 1)] == "file:pkg/__init__.py"
    assert edges[("file:a.py", 2)] == "file:pkg/sub/b.py"
    assert edges[("file:a.py", 3)] == "file:pkg/sub/b.py"
    assert edges[("file:a.py", 4)] == "func:a/b.py:x"
    assert edges[("file:pkg/sub/b.py", 1)] == "file:pkg/a.py" and edges[("file:pkg/sub/b.py", 2)] == "file:pkg/a.py"


def test_cross_references(app):
    x = app[3]
    got = sorted((r["rule"], r["path"], r["line"], r["symbol"]) for r in x.findings.collect())
    assert got == sorted(
        [("XREF_UNUSED_SYMBOL", p, n, s) for p, n, s in [("app/a.py", 4, "M"), ("app/a.py", 7, "save"), ("app/a.py", 12, "stub"), ("app/c.py", 2, "N"), ("app/c.py", 4, "run2"), ("pkg/lonely.py", 1, "alone"), ("tool.py", 2, "f")]]
        + [("XREF_UNUSED_CONSTANT", "app/a.py", 3, "UNUSED_C"), ("XREF_DUPLICATE_FUNCTION", "app/b.py", 2, "run"), ("XREF_DUPLICATE_FUNCTION", "app/c.py", 4, "run2")]
    )
    assert [(r["name"], r["uses"]) for r in x.top(2).collect()] == [("work", 3), ("run", 2)]
    assert x.envy.isEmpty()


def test_connectivity(app, spark):
    got = {r["path"]: (r["status"], r["dead_confidence"]) for r in graph.connectivity(app[2]).collect()}
    assert got["app/d.py"] == ("unreachable", 100) and got["pkg/lonely.py"] == ("unreachable", 100) and got["tool.py"] == ("reachable", 0) and got["app/b.py"] == ("reachable", 0)
    _, _, g = project(spark, {"s/main.py": "import s.load\nimport s.config\nimport s.db\n", "s/load.py": "def f():\n    return [1, 2, 3]\n", "s/config.py": "A = 1\n", "s/db.py": "__tablename__ = 't'\n", "s/x.py": "import s.y\n", "s/y.py": ""})
    got = {r["path"]: (r["status"], r["dead_confidence"]) for r in graph.connectivity(g).collect()}
    assert got == {"s/main.py": ("reachable", 0), "s/load.py": ("incomplete", 40), "s/config.py": ("reachable", 0), "s/db.py": ("reachable", 0), "s/x.py": ("unreachable", 100), "s/y.py": ("unreachable", 80)}
    status = graph.connectivity(g)
    rows, files = (lambda p: (p[0], p[1]))(project(spark, {"s/load.py": "def f():\n    return [1, 2, 3]\n"}))
    asked = questions.ask("connectivity", n=rows, f=files, nodes=g.nodes, status=status).collect()
    assert [(r["path"], r["symbol"], r["start_line"]) for r in asked] == [("s/load.py", "f", 1)]


def test_strong_components_and_cycles(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("e", "f"), ("g", "h"), ("b", "x"), ("x", "y"), ("y", "z"), ("z", "b")]
    got: dict[str, set] = {}
    for r in graph.strong_components(spark.createDataFrame(pairs, "src string, dst string")).collect():
        got.setdefault(r["scc"], set()).add(r["id"])
    assert sorted(map(sorted, got.values())) == [["a", "b", "c", "x", "y", "z"], ["d", "e"]]
    files = {"p/a.py": "import p.b\n", "p/b.py": "import p.c\nimport p.a\n", "p/c.py": "import p.a\n", "p/lazy1.py": "def f():\n    import p.lazy2\n", "p/lazy2.py": "import p.lazy1\n"}
    found = graph.cycles(project(spark, files)[2]).collect()
    assert [(r["scc_size"], r["cycle"], r["severity"]) for r in found] == [(3, ["p/b.py", "p/a.py"], "med")]


def test_shortest_cycles_against_brute_force(spark):
    rng = random.Random(5)
    edges, want = [], {}
    for k in range(12):
        # a ring makes one component; chords shorten its cycles
        n = rng.randint(2, 9)
        names = [f"file:{k}/{i}" for i in rng.sample(range(n), n)]
        here = {(names[i], names[(i + 1) % n]) for i in range(n)} | {tuple(rng.sample(names, 2)) for _ in range(rng.randint(0, n // 2))}
        edges += [(str(k), a, b) for a, b in here]
        rounds = [c for size in range(2, n + 1) for c in itertools.permutations(sorted(names), size) if c[0] == min(c) and all((c[i], c[(i + 1) % size]) in here for i in range(size))]
        best = min(rounds, key=lambda c: (len(c), c))
        want[str(k)] = [*best[1:], best[0]]
    found = graph.shortest_cycles(spark.createDataFrame(edges, "scc string, src string, dst string"))
    assert {r["scc"]: r["path"] for r in found.collect()} == want
    assert graph.shortest_cycles(spark.createDataFrame([], "scc string, src string, dst string")).collect() == []


def test_simple_cycles_against_brute_force(spark):
    r = random.Random(9)
    names = [f"n{i}" for i in range(12)]
    pairs = {tuple(r.sample(names, 2)) for _ in range(26)} | {("n1", "n1")}
    want = {c for size in range(2, 6) for c in itertools.permutations(names, size) if c[0] == min(c) and all((c[i], c[(i + 1) % size]) in pairs for i in range(size))}
    found, beyond = graph.simple_cycles(spark.createDataFrame(sorted(pairs), "src string, dst string"), 5)
    rows = [tuple(x["cycle"]) for x in found.collect()]
    assert set(rows) == want and len(rows) == len(want) and want
    ring = spark.createDataFrame([(f"r{i}", f"r{(i + 1) % 7}") for i in range(7)], "src string, dst string")
    assert graph.simple_cycles(ring, 5)[0].count() == 0 and graph.simple_cycles(ring, 5)[1].count() > 0
    assert graph.simple_cycles(ring, 7)[0].count() == 1 and graph.simple_cycles(ring, 7)[1].count() == 0
    files = {"p/a.py": "import p.b\n", "p/b.py": "def f():\n    import p.a\n    import p.b\n"}
    assert [x["cycle"] for x in graph.circular_dependencies(project(spark, files)[2])[0].collect()] == [["p/a.py", "p/b.py"]]


def test_soft_delete_finds_names_of_any_length(spark):
    names = ["a\U0001f600", "z", "orders", "ord", "absent"]
    files = {f"m/t{i}.py": f"class T{i}(Base):\n    __tablename__ = '{t}'\n    deleted_at = 1\n" for i, t in enumerate(names)}
    texts = {"q1": "return db.execute('from Orders')", "q2": "return db.query('a\U0001f600')", "q3": "return db.query(1)", "q4": "return db.quiz('z')", "q5": "return db.query('z')"}
    files |= {f"m/{k}.py": f"def {k}(db):\n    {v}\n" for k, v in texts.items()}
    rows, frame, g = project(spark, files)
    asked = questions.ask("soft_delete", n=rows, f=frame, nodes=g.nodes).collect()
    assert sorted(r["symbol"] for r in asked) == ["q1", "q2", "q5"]


def test_clusters(app, spark):
    blocks = {r["block"]: r["members"] for r in graph.clusters(app[2]).collect()}
    assert blocks["block:0"] == ["file:app/a.py", "file:app/b.py", "file:app/c.py", "file:app/main.py"] and len(blocks["block:utilities"]) == 4
    names = {r["block"]: r["name"] for r in graph.block_names(graph.clusters(app[2])).collect()}
    assert names == {"block:0": "App", "block:utilities": "Utilities / Standalone"}
    assert graph.clusters(project(spark, {"a.py": "", "b.py": ""})[2]).count() == 1
    found = lint.findings(app[0], app[1], ["DEAD_IMPORT"])
    totals, crossing = graph.block_view(graph.clusters(app[2]), app[2], found)
    assert {r["block"]: (r["files"], r["low"]) for r in totals.collect()} == {"block:0": (4, 6), "block:utilities": (4, 1)} and crossing.isEmpty()


def test_hotspots(app, spark):
    churn = spark.createDataFrame([("app/a.py", 4), ("z.py", 8)], "path string, churn long")
    got = {r["path"]: (r["complexity"], r["churn"], r["score"]) for r in graph.hotspots(app[2], churn).collect()}
    assert got["app/a.py"] == (5, 4, 0.5) and got["z.py"] == (0, 8, 0.0) and got["app/d.py"] == (1, 0, 0.0)
    alone = {r["path"]: r["score"] for r in graph.hotspots(app[2], churn.limit(0)).collect()}
    assert alone["app/a.py"] == 1.0 and alone["app/b.py"] == 0.2
    log = spark.sql("SELECT '1' AS commit_id, timestamp'2024-06-01' AS ts, 'a.py' AS path UNION ALL SELECT '2', timestamp'2023-01-01', 'a.py' UNION ALL SELECT '3', timestamp'2024-06-01', 'a.txt'")
    assert [tuple(r) for r in tree.churn(log, F.lit("2024-06-30").cast("timestamp")).collect()] == [("a.py", 1)]


def test_questions(spark):
    files = {
        "m/models.py": "class T:\n    __tablename__ = 'orders'\n    deleted_at = 1\n",
        "m/q.py": "def get(db):\n    return db.query('orders').all()\n",
        "m/exp.py": "def invite():\n    expires = datetime.now()\n    return expires\n",
        "m/tmp.py": "def go(db):\n    asyncio.create_task(x())\n    db.commit()\n    db.close()\n",
        "m/lim.py": "def cap(t):\n    return t[:147]\n",
        "m/wr.py": "def store(alt_text):\n    save(alt_text)\n",
        "m/r.py": "class R:\n    def risky(self):\n        raise ValueError\ndef two(a):\n    if a:\n        return 1\n    return 2\n",
        "m/c1.py": "try:\n    risky()\nexcept ValueError as e:\n    two(e)\n",
        "m/c2.py": "two(1)\n",
        "m/link_checker.py": "MAX_RETRIES = 3\n",
    }
    rows, frame, g = project(spark, files)
    x = xref.CrossReferences(rows, frame, g)
    done = spark.createDataFrame([("**DONE** max_retries",), ("✅ deleted_at filter",)], "item string")
    frames = {"n": rows, "f": frame, "nodes": g.nodes, "edges": g.edges, "usage": x.usage, "done": done}
    got = {k: [(r["path"], r["start_line"], r["end_line"], r["symbol"]) for r in questions.ask(k, **frames).orderBy("path", "symbol", "signal").collect()] for k in ("soft_delete", "expiry", "temporal", "constraints", "claims", "contracts", "error_handling")}
    assert got["soft_delete"] == [("m/q.py", 1, 2, "get")] and got["expiry"] == [("m/exp.py", 1, 3, "invite")]
    assert got["temporal"] == [("m/tmp.py", 1, 4, "go")] * 2 and got["constraints"] == [("m/wr.py", 1, 2, "store: 150-char truncation")]
    assert got["claims"] == [("(missing: *ada_checker*)", 0, 0, "deleted_at"), ("m/link_checker.py", 1, 1, "MAX_RETRIES")]
    assert got["contracts"] == [("m/r.py", 4, 7, "two")] and got["error_handling"] == [("m/c1.py", 1, 4, "risky")]
    asked = questions.ask("expiry", n=rows, f=frame)
    no = questions.verify(asked, lambda prompt: 'well {"answer": "no"}').collect()
    assert [(r["path"], r["rule"], r["severity"]) for r in no] == [("m/exp.py", "expiry", "high")]
    assert questions.verify(asked, lambda prompt: '{"answer": "yes"}').isEmpty()
    assert [r["rule"] for r in questions.verify(questions.ask("temporal", n=rows, f=frame), lambda prompt: None).collect()] == ["tool_failure"]
    assert questions.review_context(frame, lint.findings(rows, frame, ["DEAD_IMPORT"]), x.usage).filter("path = 'm/r.py'").first()["refs"] == ["R: NEVER USED outside this file"]


def test_prompts_are_cut_at_lines(spark):
    text = "\n".join(f"line {i}" for i in range(1000))
    cut = spark.createDataFrame([(text,), ("x" * 4000,), ("short",)], "t string").select(questions.shortened(F.col("t")).alias("t")).collect()
    assert cut[0]["t"].endswith("\n# [truncated]") and len(cut[0]["t"]) < 3020 and len(cut[1]["t"]) == 3000 and cut[2]["t"] == "short"
    assert questions.outermost('x {"a": {"b": 1}} y') == {"a": {"b": 1}} and questions.outermost("{") == {} and questions.outermost(None) == {}


def test_tree_source(spark, tmp_path):
    for path, text in {"a/x.py": b"import os\n", "a/b.js": b"var a;\n", "venv/y.py": b"", "old-OFF.py": b"", "gen/z.py": b"\xff = 1\n", ".gitignore": b"# c\ngen/\n"}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(text)
    files = tree.read_tree(spark, str(tmp_path))
    assert sorted(r["path"] for r in files.collect()) == ["a/b.js", "a/x.py", "gen/z.py", "old-OFF.py"]
    ignored = tuple(tree.ignored_names(spark, str(tmp_path)))
    assert ignored == ("gen",)
    of = lambda stage: sorted(r["path"] for r in tree.select_files(files, stage, ignored=ignored).collect())
    assert of("map") == ["a/x.py"] and of("lint") == ["a/x.py", "gen/z.py"] and of("js") == ["a/b.js"]
    assert tree.load_config(str(tmp_path / "none.json")) == {}


def test_excluded_folders_are_neither_listed_nor_read(spark, tmp_path, monkeypatch):
    names = ["src/deep/er/a.py", "src/b.js", "src/c.txt", "node_modules/x/y.py", "node_modules/x/y.js", "venv/lib/z.py", "vendor/v.py", "vendor/v.js", ".hid/h.py", ".hid/h.js", "own/o.py", "_under.py", "empty.py"]
    for name in names:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("" if name == "empty.py" else name)
    (tmp_path / "src/link").symlink_to(tmp_path / "venv")
    opened, listed = [], []
    real_open, real_list = tree.TreeReader.opened, tree.TreeReader.children
    monkeypatch.setattr(tree.TreeReader, "opened", lambda self, fs, path: opened.append(os.path.relpath(path, tmp_path)) or real_open(self, fs, path))
    monkeypatch.setattr(tree.TreeReader, "children", lambda self, fs, top, unit: listed.append(os.path.relpath(unit.path, tmp_path)) or real_list(self, fs, top, unit))
    for folders, size in ((4096, 64 << 20), (1, 10)):  # all listed before the tasks begin, or by the tasks
        monkeypatch.setattr(tree, "FOLDERS", folders)
        monkeypatch.setattr(tree, "BYTES", size)
        opened.clear()
        listed.clear()
        reader = tree.TreeReader({"path": str(tmp_path), "exclude": "\n".join((*tree.EXCLUDED, "own"))})
        parts = reader.partitions()
        rows = [(p, c) for part in parts for batch in reader.read(part) for p, c in zip(*(x.to_pylist() for x in batch.columns))]
        assert sorted(p for p, _ in rows) == [".hid/h.py", "_under.py", "empty.py", "src/b.js", "src/deep/er/a.py", "vendor/v.py"] and all(c == ("" if p == "empty.py" else p) for p, c in rows)
        assert sorted(opened) == sorted(p for p, _ in rows) and not {"venv", "node_modules", "src/link"} & set(listed)
        assert len(parts) > 3 or folders > 1
    # a filter prunes too
    opened.clear()
    listed.clear()
    reader = tree.TreeReader({"path": str(tmp_path)})
    assert len(list(reader.pushFilters([StringStartsWith(("path",), "src/de"), StringEndsWith(("path",), ".py")]))) == 2
    assert [p for part in reader.partitions() for batch in reader.read(part) for p in batch.column(0).to_pylist()] == ["src/deep/er/a.py"]
    assert sorted(listed) == [".", "src", "src/deep", "src/deep/er"]
    files = tree.read_tree(spark, str(tmp_path))
    assert sorted(r["path"] for r in files.filter("path LIKE 'src/%' AND path LIKE '%.js'").collect()) == ["src/b.js"]
    assert tree.read_tree(spark, str(tmp_path), scripts=False).count() == 6


def test_folders_that_are_left_are_dealt_to_few_tasks(tmp_path, monkeypatch):
    names = [f"svc{k}/{inner}m.py" for k in range(1500) for inner in ("", "in/")]
    for name in names:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    listed = []
    real = tree.TreeReader.children
    monkeypatch.setattr(tree.TreeReader, "children", lambda self, fs, top, unit: listed.append(unit.path) or real(self, fs, top, unit))
    monkeypatch.setattr(tree, "FOLDERS", 10)
    reader = tree.TreeReader({"path": str(tmp_path)})
    parts = reader.partitions()
    assert len(listed) <= 10 and 100 < len(parts) < 600  # neither the driver nor a task a folder
    batches = [batch for part in parts for batch in reader.read(part)]
    rows = [r for batch in batches for r in batch.to_pylist()]
    assert sorted(r["path"] for r in rows) == sorted(names) and all(r["path"] == r["content"] for r in rows) and len(batches) <= len(parts)


def test_mentions_against_brute_force(spark, monkeypatch):
    r = random.Random(4)
    words = ["".join(r.choice("ab") for _ in range(r.randint(1, 5))) for _ in range(40)] + ["é", "\U0001f600b", "order", "orders", "ord" + "x" * 50]
    texts = [(i, "".join(r.choice("abé\U0001f600") for _ in range(r.randint(0, 30)))) for i in range(60)] + [(100, None), (101, ""), (102, "reorders")]
    frame = spark.createDataFrame(texts, "id long, words string")
    for known in (words, [*words, "", None], []):
        found = mentions(frame, "words", spark.createDataFrame([(w,) for w in known], "w string"))
        assert sorted(map(tuple, found.collect()), key=repr) == sorted(((i, t, sorted({w for w in known if w is not None and w in t}) if t is not None else []) for i, t in texts), key=repr)
    monkeypatch.setattr("astraloom.functions.words.WORDS", 7)  # several automata
    found = mentions(frame, "words", spark.createDataFrame([(w,) for w in words], "w string"))
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(((i, t, sorted({w for w in words if w in t}) if t is not None else []) for i, t in texts), key=repr)


def test_sinks(app, spark, tmp_path):
    found = lint.findings(app[0], app[1], ["DEAD_IMPORT"])
    report.write_tables(str(tmp_path / "out"), findings=found, nodes=app[2].nodes)
    base = tree.read_baseline(spark, str(tmp_path / "out" / "findings"))
    assert findings.diff(found, base).filter("change <> 'unchanged'").isEmpty() and tree.read_baseline(spark, str(tmp_path / "no")) is None
    report.write_json(str(tmp_path / "map.json"), nodes=app[2].nodes, findings=found)
    with open(tmp_path / "map.json", encoding="utf-8") as f:
        document = json.load(f)
    assert len(document["nodes"]) == 19 and len(document["findings"]) == found.count()
    report.write_html(str(tmp_path / "page.html"), found, findings.diff(found, found.limit(1)))
    assert "DEAD_IMPORT" in (tmp_path / "page.html").read_text(encoding="utf-8")
    assert report.json_rows(nodes=app[2].nodes).count() == 19


def test_a_baseline_is_replaced_at_once(spark, tmp_path):
    place = str(tmp_path / "base")
    rows = lambda *names: spark.createDataFrame([("lint", n, 1, "R", "low", n) for n in names], tree.FINDING).repartition(3)
    seen = lambda: sorted(r["path"] for r in tree.read_baseline(spark, place).collect())
    assert tree.read_baseline(spark, place) is None
    tree.save_baseline(rows("a", "b"), place)
    assert seen() == ["a", "b"]

    def dies(batches):
        for k, batch in enumerate(batches):
            yield batch
            raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):  # tasks die
        tree.save_baseline(rows("c", "d", "e").mapInArrow(dies, tree.FINDING), place)
    assert seen() == ["a", "b"]
    writer = manifest.ManifestWriter(place)
    message = writer.write(iter([pa.RecordBatch.from_pylist([{"tier": "lint", "path": "z", "line": 1, "rule": "R", "severity": "low", "symbol": "z"}])]))
    assert seen() == ["a", "b"] and len(list((tmp_path / "base").glob("part-*"))) >= 2  # the driver dies before the commit
    writer.commit([message, None])
    assert seen() == ["z"] and len(list((tmp_path / "base").glob("part-*"))) == 1
    tree.save_baseline(tree.read_baseline(spark, place).union(rows("y")), place)  # read and replaced by one job
    assert seen() == ["y", "z"]
    tree.save_baseline(rows(), place)
    assert seen() == []


def test_rows_are_numbered_over_partitions(spark):
    rows = spark.range(2000).withColumn("k", F.col("id") % 7).repartition(5)
    got = numbered(rows, [F.col("k"), -F.col("id")]).orderBy("number").collect()
    assert [(x["k"], x["id"], x["number"]) for x in got] == [(*x, n) for n, x in enumerate(sorted(((i % 7, i) for i in range(2000)), key=lambda x: (x[0], -x[1])), 1)]
    assert numbered(rows.limit(0), [F.col("k")]).count() == 0


def test_calls_end(tmp_path):
    asked = []

    def client(prompt):
        asked.append(prompt)
        if prompt == "hangs":
            time.sleep(60)
        if prompt == "late" and asked.count("late") == 1:
            time.sleep(1.5)
        if prompt == "fails":
            raise OSError(prompt)
        if prompt == "second" and asked.count("second") == 1:
            return None
        return f"answer to {prompt}"

    limits = calls.Limits(seconds=0.5, attempts=2, in_flight=3, pause=0.01)
    prompts = ["hangs", "a", "late", "fails", "a", "second", *(f"p{k}" for k in range(20))]
    began = time.time()
    got = calls.ask_all(client, prompts, limits, f"file://{tmp_path}/answers")
    assert time.time() - began < 10
    assert got == [None, "answer to a", "answer to late", None, "answer to a", "answer to second", *(f"answer to p{k}" for k in range(20))]
    assert asked.count("a") == 1 and asked.count("hangs") == asked.count("late") == asked.count("fails") == asked.count("second") == 2
    asked.clear()  # what was answered is not asked again
    assert calls.ask_all(client, prompts, limits, f"file://{tmp_path}/answers") == got and sorted(asked) == ["fails", "fails", "hangs", "hangs"]
    running, most = [], []

    def counted(prompt):
        running.append(1)
        most.append(len(running))
        time.sleep(0.05)
        running.pop()
        return prompt

    assert calls.ask_all(counted, [str(k) for k in range(12)], limits) == [str(k) for k in range(12)] and 1 < max(most) <= 3


def test_stream(spark, tmp_path):
    rows = [("a.py", "import os\n", 1), ("a.py", "x = 1\n", 2), ("b.py", "import os\n", 1)]
    frame = spark.createDataFrame(rows, "path string, content string, at long").withColumn("at", F.timestamp_seconds("at"))
    spark.createDataFrame(frame.rdd, CHANGES).write.parquet(str(tmp_path / "in"))
    stream = lint_changes(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), ["DEAD_IMPORT"])
    stream.awaitTermination()
    assert [r["path"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["b.py"]


def test_budget(spark):
    files = described(spark.createDataFrame([("a.py", "x\n" * 40), ("b.py", "y\n" * 40), ("c.py", "z\n" * 40)], "path string, content string"))
    assert {r["path"]: r["taken"] for r in questions.source_budget(files, 75).collect()} == {"a.py": 40, "b.py": 35}
    assert {r["path"]: r["taken"] for r in questions.source_budget(files, 60).collect()} == {"a.py": 40}


def test_command(spark, tmp_path, monkeypatch):
    """The whole run from the command line, twice: a saved baseline, then a new high finding."""
    import astraloom.__main__ as command

    monkeypatch.setattr(command, "session", lambda: spark)
    root = tmp_path / "p"
    for path, text in APP.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text, encoding="utf-8")
    (root / "app" / "w.js").write_text("var a = 1;\n", encoding="utf-8")
    (root / ".astraloom.json").write_text('{"rules": [{"id": "w", "pattern": "work(...)"}]}', encoding="utf-8")
    flags = [str(root), "--lint", "--js", "--xref", "--cycles", "--hotspots", "--questions", "--diff", "auto"]
    assert command.main([*flags, "--html", "--fail-on", "med"]) == 1
    with open(root / "repo-map.json", encoding="utf-8") as f:
        document = json.load(f)
    assert {"PATTERN:w", "JS_VAR_DECLARATION", "DEAD_IMPORT", "XREF_UNUSED_SYMBOL"} <= {x["rule"] for x in document["findings"]}
    assert document["cycles"][0]["cycle"] == ["app/b.py", "app/a.py"] and document["stats"][0]["files"] == 8 and document["view_blocks"] and (root / "repo-map-report.html").exists()
    (root / "app" / "b.py").write_text(APP["app/b.py"] + "try:\n    pass\nexcept:\n    pass\n", encoding="utf-8")
    assert command.main(flags) == 1
    saved = command.baseline(spark, str(root / "repo-map.json"), str(root))
    assert saved.filter("rule = 'BARE_EXCEPT'").count() == 1 and command.baseline(spark, "no-such-revision", str(root)) is None
    assert command.main([str(root), "--fix", "--no-cluster", "--no-connectivity"]) == 0
    assert (root / "tool.py").read_text(encoding="utf-8") == "def f(a, _b):\n    return a\n"
    assert command.main([str(tmp_path / "none")]) == 2


def test_view_blocks(spark):
    blocks = spark.createDataFrame([("block:0", [f"file:a/x{i}.py" for i in range(40)] + [f"file:b/y{i}.py" for i in range(20)] + ["file:z.py", "file:a/tests/t.py"])], "block string, members array<string>")
    got = {r["name"]: len(r["members"]) for r in graph.view_blocks(blocks, code_graph.CodeGraph(blocks, blocks, blocks, blocks)).collect()}
    assert got == {"A / a": 40, "A / b": 20, "A / (misc)": 1, "Tests": 1}


def plain_modularity(pairs, label, resolution):
    total = sum(w for _, _, w in pairs)
    degree = {}
    for a, b, w in pairs:
        degree[a] = degree.get(a, 0) + w
        degree[b] = degree.get(b, 0) + w
    inside = sum(w for a, b, w in pairs if label[a] == label[b])
    sums = {}
    for n, k in degree.items():
        sums[label[n]] = sums.get(label[n], 0) + k
    return inside / total - resolution * sum(k * k for k in sums.values()) / (4 * total * total)


def test_communities(spark):
    """Two cliques on one bridge part; no single move raises the modularity of what is found."""
    clique = lambda names: [(a, b, 1.0) for i, a in enumerate(names) for b in names[i + 1 :]]
    pairs = clique("abcd") + clique("efgh") + [("d", "e", 1.0), ("i", "i", 1.0), ("x", "y", 2.0)]
    nodes = sorted({n for p in pairs for n in p[:2]} | {"z"})
    frames = spark.createDataFrame(pairs, "a string, b string, weight double"), spark.createDataFrame([(n,) for n in nodes], "id string")
    label = {r["id"]: r["label"] for r in graph.communities(*frames).collect()}
    assert [label[n] for n in "abcdefghixyz"] == list("aaaaeeeeixxz")
    best = plain_modularity(pairs, label, 1.0)
    for n in nodes:
        for other in set(label.values()):
            assert plain_modularity(pairs, label | {n: other}, 1.0) <= best + 1e-9


@pytest.mark.parametrize("wide", [0, 6])
def test_communities_of_tables_are_those_of_their_pairs(spark, wide):
    """Tables as members: the communities' modularity by the same links written out."""
    tabs = [(f"t{g}", f"f{g}{i}") for g in range(6) for i in range(4)] + [("wide", f"f{g}0") for g in range(wide)] + [("one", "f00")]
    bridges = [(f"f{g}3", f"f{g + 1}1", 1.0) for g in range(5)] + [("f00", "f00", 1.0)]
    nodes = spark.createDataFrame([(n,) for n in sorted({f for _, f in tabs} | {"z"})], "id string")
    label = {r["id"]: r["label"] for r in graph.communities(spark.createDataFrame(bridges, "a string, b string, weight double"), nodes, 1.0, members=spark.createDataFrame(tabs, "tab string, id string")).collect()}
    assert wide or all(label[f"f{g}{i}"] == f"f{g}0" for g in range(6) for i in range(4)) and label["z"] == "z"
    pairs = [*bridges, *((a, b, 2.0) for t in {t for t, _ in tabs} for a, b in itertools.combinations(sorted(f for x, f in tabs if x == t), 2))]
    assert plain_modularity(pairs, label, 1.0) > (0.25 if wide else 0.7)  # a wide table of six holds a third of all links


def test_a_wide_table_costs_a_row_per_file(spark):
    members = spark.range(30_000).select(F.lit("wide").alias("tab"), F.format_string("f%06d", "id").alias("id")).union(spark.range(40).select(F.lit("narrow").alias("tab"), F.format_string("g%02d", "id").alias("id")))
    pairs = spark.createDataFrame([("f000000", "g00", 1.0)], "a string, b string, weight double")
    found = graph.communities(pairs, members.select("id"), 1.0, members=members)
    assert sorted(map(tuple, found.groupBy("label").count().collect())) == [("f000000", 30_000), ("g00", 40)]


def plain_reach(pairs, start):
    seen, todo = set(start), list(start)
    while todo:
        x = todo.pop()
        for a, b in pairs:
            if a == x and b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


def test_long_chains_end_in_few_rounds(spark, monkeypatch):
    n = 2000
    chain = [(f"c{i:05d}", f"c{i + 1:05d}") for i in range(n)] + [(f"c{i:05d}", "util") for i in range(n)]
    ring = [(f"r{i:05d}", f"r{(i + 1) % 700:05d}") for i in range(700)]
    loop = [("u", "v0"), *((f"v{i}", f"v{i + 1}") for i in range(300)), ("v300", "u"), ("u", "c00000")]
    edges = spark.createDataFrame(chain + ring + loop, "src string, dst string")
    jobs = []
    real = graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: jobs.append(1) or real(df))
    assert {r["id"] for r in graph.reach(edges, spark.createDataFrame([("c00003",)], "id string")).collect()} == {"util", *(f"c{i:05d}" for i in range(3, n + 1))}
    assert len(jobs) < 100
    jobs.clear()
    assert {(r["id"], r["scc"]) for r in graph.strong_components(edges).collect()} == {(a, "r00699") for a, _ in ring} | {(a, "v99") for a, _ in loop}
    assert len(jobs) < 100


def test_reach_and_strong_components_at_random(spark, monkeypatch):
    monkeypatch.setattr(graph, "TOGETHER", 2)
    for seed in range(6):
        r = random.Random(seed)
        names = [f"n{i}" for i in range(30)]
        pairs = {(names[i], names[(i + 1) % 30]) for i in range(30) if r.random() < 0.85} | {tuple(r.sample(names, 2)) for _ in range(r.choice([2, 6, 12]))}
        edges = spark.createDataFrame(sorted(pairs), "src string, dst string")
        all_ = {x: plain_reach(pairs, [x]) for x in names}
        assert {x["id"] for x in graph.reach(edges, spark.createDataFrame([("n3",), ("n20",)], "id string")).collect()} == all_["n3"] | all_["n20"]
        both = {x: {y for y in all_[x] if x in all_[y]} for x in names}
        assert {(x["id"], x["scc"]) for x in graph.strong_components(edges).collect()} == {(x, max(g)) for x, g in both.items() if len(g) > 1}


def test_second_engine_of_javascript(spark):
    text = "class A extends B.C { static async go(x) { if (x) { f(); } }\n  get n() { return 1; } }\nconst f = function () {}, g = y => y, h = (1);\nimport('./x'); require(\"y\"); // import('z')\nfunction f() {}\nfunction* gen() {}\nconst o = { m() {} };\n"
    frame = spark.createDataFrame([("a.js", text), ("none.js", None)], "path string, content string")
    got = [(r["kind"], r["name"], r["line"], r["extends"]) for r in javascript.js_nodes(frame, "v2").collect()]
    assert sorted(got, key=str) == sorted([("import", "./x", 4, None), ("import", "y", 4, None), ("function", "f", 3, None), ("function", "g", 3, None), ("class", "A", 1, "extends B.C"), ("method", "go", 1, None), ("method", "n", 2, None), ("method", "m", 7, None)], key=str)


def test_pages_and_answers(spark, tmp_path):
    nodes = spark.createDataFrame([(f"n{i}", f"<b>{i}", i, [f"d{i}"]) for i in range(5)], "id string, label string, size int, details array<string>")
    edges = spark.createDataFrame([("n4", "n3", 1), ("n0", "n1", 1)], "source string, target string, weight int")
    report.write_graph_page(f"{tmp_path}/p.html", "Some <title>", nodes, edges, most=3)
    page = (tmp_path / "p.html").read_text()
    assert "Some &lt;title&gt;: the largest 3 of 5" in page and "<b>" not in page.split("<script")[1] and '"n1"' not in page
    assert questions.answered('{"findings": [{"desc": "x", "line": "7", "file": "f"}, {"line": 1}, 3]} tail') == [("f", 7, "review", "med", "x")]
    assert questions.answered("none") == [] and questions.answered('{"findings": 3}') == []
    assert questions.review_across(nodes, nodes, None).first()["rule"] == "tool_failure"


def test_a_pause_is_waited_once_an_attempt():
    import time

    from astraloom.functions import calls

    asked = []
    began = time.time()
    got = calls.ask_all(lambda prompt: asked.append(prompt), [str(k) for k in range(60)], calls.Limits(seconds=5, attempts=2, in_flight=2, pause=0.2))
    assert got == [None] * 60 and len(asked) == 120 and time.time() - began < 3  # 60 pauses over two calls in flight would be 6 s


def test_a_question_makes_only_the_stages_it_reads(spark, sf):
    from astraloom.plans import bundles

    bundles._KEPT.pop((spark.sparkContext.applicationId, sf), None)
    bundles.QUERIES["questions_constraints"](spark, sf).count()
    made = bundles._services(spark, sf).__dict__
    assert {"n", "f"} <= set(made) and not {"graph", "xref", "status", "found"} & set(made)


def test_parts_hold_all_sources_and_are_bounded(spark):
    import json

    from astraloom.operators import questions

    files = described(spark.createDataFrame([(f"p/m{k:03}.py", "x = 1\n" * (k % 7)) for k in range(300)], "path string, content string"))
    parts = questions.source_parts(files, lines=20).cache()
    whole = {r["path"]: (r["taken"], r["source"]) for r in parts.collect()}
    assert whole == {f"p/m{k:03}.py": (k % 7, "\n".join(["x = 1"] * (k % 7))) for k in range(300) if k % 7}
    sizes = [r["n"] for r in parts.groupBy("part").agg(F.sum("taken").alias("n")).collect()]
    assert len(sizes) > 30 and max(sizes) < 20 + 7
    context = spark.createDataFrame([("map", 1, "Files: 300")], "part string, at int, text string")

    def client(prompt):
        lines = prompt.split("\n")
        return json.dumps({"findings": [{"file": x.split()[1], "desc": lines[0]} for x in lines if x.startswith("=== ")]})

    got = questions.review_across(context, parts, client).collect()
    assert sorted(r["path"] for r in got) == sorted(whole) and {r["symbol"] for r in got} == {"Files: 300"}


def test_tables_of_loops_are_planned_at_their_size_in_memory(spark, tmp_path):
    from astraloom.functions import tables

    key = "spark.sql.sources.fileCompressionFactor"
    plans = lambda df: df._jdf.queryExecution().executedPlan().toString()
    ids = tables.written(spark.range(400_000).select(F.concat(F.lit("file:svc/"), "id").alias("id")), "ids")
    before = spark.conf.get(key)
    with tables.true_sizes(spark):
        inside = plans(ids.join(ids.withColumnRenamed("id", "b"), F.col("id") == F.col("b")))
    assert "Broadcast" not in inside and spark.conf.get(key) == before
    assert "Broadcast" in plans(ids.join(ids.withColumnRenamed("id", "b"), F.col("id") == F.col("b")))
    spark.conf.set(key, "3.0")
    with tables.true_sizes(spark):
        assert spark.conf.get(key) == "3.0"
    spark.conf.unset(key)


def test_claims_of_notes_parse_nothing(spark, sf):
    from astraloom.plans import bundles

    bundles._KEPT.pop((spark.sparkContext.applicationId, sf), None)
    bundles.QUERIES["questions_claims"](spark, sf).count()
    made = bundles._services(spark, sf).__dict__
    assert "f" in made and "n" not in made


def test_limits_meet_functions_by_broadcast(spark, sf):
    from astraloom.plans import bundles

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if all tables were large
    try:
        plan = bundles.QUERIES["questions_constraints"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "CartesianProduct" not in plan  # which would cut the texts of all functions once for every partition of the limits


def test_names_are_claimed_in_one_scan_and_decided_if_asked(spark, sf):
    from astraloom.functions.tables import sql
    from astraloom.operators import code_graph
    from astraloom.plans import bundles

    g = bundles._services(spark, sf)["graph"]
    claims = sql(spark, code_graph.CLAIMS, nodes=g.nodes)
    assert claims._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    made = {(r["key"], r["id"], r["over"]) for r in claims.filter("id LIKE '%:svc3/db.py%'").collect()}
    dotted = [("module:svc3", False), ("module:svc3.db", False), ("module:svc3.db", True), ("file:svc3/db.py", True)] + [(f"module:svc3.db.{x}", False) for x in ("save_3", "find_3", "Repo_3", "get_db", "get_session")]
    own = {(key, "file:svc3/db.py", over) for key, over in dotted}
    for x in ("save_3", "find_3", "Repo_3.risky_3", "get_db", "get_session"):
        id = f"func:svc3/db.py:{x}"
        own |= {(id, id, True), (f"call:{x}", id, False), (f"call:{x.split('.')[-1]}", id, False)}
    own |= {("class:svc3/db.py:Repo_3", "class:svc3/db.py:Repo_3", True), ("class_ref:Repo_3", "class:svc3/db.py:Repo_3", False)}
    assert made == own
    again = code_graph.resolved(g.raw_edges, g.nodes)
    assert again.exceptAll(g.edges).isEmpty() and g.edges.exceptAll(again).isEmpty()


def test_files_that_stand_alone_need_not_be_one_row(spark, sf):
    from astraloom.operators import graph
    from astraloom.plans import bundles

    g = bundles._services(spark, sf)["graph"]
    whole, rest = graph.clusters(g).collect(), graph.clusters(g, utilities=False).collect()
    assert sorted(map(str, rest)) == sorted(str(r) for r in whole if r["block"] != "block:utilities") and len(rest) == len(whole) - 1


def test_a_review_across_makes_only_the_parts_that_are_read(spark):
    from astraloom.operators import questions

    stats = spark.createDataFrame([(2, 3, 4)], "files int, functions int, edges int")
    status = spark.createDataFrame([("b.py", "incomplete"), ("a.py", "reachable")], "path string, status string")
    routes = spark.createDataFrame([], "path string, place int, method string, route string, handler string, prefix string, warning string")
    got = questions.across_context(stats, None, status, routes, None).collect()
    assert sorted((r["part"], r["text"]) for r in got) == [("connectivity", "INCOMPLETE: b.py"), ("map", "Files: 2, Functions: 3, Edges: 4")]


def test_threads_are_used_for_many_prompts_and_given_up_if_late():
    import threading
    import time

    from astraloom.functions import calls

    seen = []

    def client(prompt):
        seen.append(threading.current_thread())
        if prompt == "7":
            time.sleep(1)
        return None if prompt == "9" else prompt

    got = calls.ask_all(client, [str(k) for k in range(500)], calls.Limits(seconds=0.2, attempts=1, in_flight=2, pause=0))
    assert got == [None if k in (7, 9) else str(k) for k in range(500)] and len(seen) == 500 and len(set(seen)) <= 3


def test_files_are_made_of_keys_in_all_tasks(spark, sf):
    from astraloom.sources import bundles, corpus

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for made in (bundles.files(spark, sf, bundles.PYTHON), corpus.project_files(spark, sf), corpus.snippet_files(spark, sf)):
        assert made.rdd.getNumPartitions() == tasks  # one file of keys was one task
