"""The graph that is kept current equals a full run, whatever the changes."""

import random

import pytest

from astraloom.functions.syntax import syntax_rows
from astraloom.functions.tables import cut
from astraloom.operators import code_graph, lint
from astraloom.sources.tree import described
from astraloom.streaming import current
from astraloom.streaming.current import CurrentGraph, keep_current
from astraloom.streaming.watch import CHANGES

RULES = ["DEAD_IMPORT", "BARE_EXCEPT"]


def changes(spark, rows):
    """rows: path, content, seconds."""
    frame = spark.createDataFrame(rows or [], "path string, content string, at double")
    return frame.selectExpr("path", "content", "timestamp_seconds(at) AS at").to(current_schema(spark))


def current_schema(spark):
    return spark.createDataFrame([], CHANGES).schema


def shown(frame, leave=()):
    return sorted((repr(r.asDict(recursive=True)) for r in frame.select(*sorted(set(frame.columns) - set(leave))).collect()))


def same_as_a_full_run(spark, kept, files):
    g = kept.graph()
    if not files:
        assert not g.nodes.count() and not g.edges.count() and not g.routes.count() and not kept.findings().count()
        return
    frame = cut(described(spark.createDataFrame(list(files.items()), "path string, content string")))
    rows = cut(syntax_rows(frame))
    want = code_graph.build(rows, frame)
    for name in ("nodes", "raw_edges", "edges", "routes"):
        assert shown(getattr(g, name)) == shown(getattr(want, name)), name
    assert shown(kept.findings()) == shown(lint.findings(rows, frame, RULES))


PATHS = ["app/__init__.py", "app/a.py", "app/b.py", "app/b/__init__.py", "app/b/c.py", "lib.py", "z/a.py"]


def some_text(rng):
    lines = []
    for _ in range(rng.randint(0, 5)):
        lines.append(rng.choice([
            "import app.a", "import app.b.c as q", "from app.b import work", "from app.b.c import Model", "from lib import run", "from . import a", "import app", "import nowhere.near",
            "def work(x):\n    return run(x)", "def run(x):\n    return work(x)", "class Model(Root):\n    __tablename__ = 't'\n    def save(self):\n        return 1", "class Root(Model):\n    rel = relationship('Model')",
            "try:\n    run(1)\nexcept:\n    pass", "@app.get('/x')\ndef page():\n    return save()", "x = (", "run(2)",
        ]))
    return "\n".join(lines) + "\n"


def test_any_sequence_of_changes(spark, tmp_path):
    rng = random.Random(2)
    kept = CurrentGraph(spark, f"file://{tmp_path}/state", RULES)
    best: dict[str, tuple[int, str]] = {}
    for turn in range(3):
        batch = []
        for _ in range(rng.randint(1, 7)):
            # times repeat across batches in no order, but a path has no two changes of one time
            batch.append((rng.choice(PATHS), rng.choice([None, some_text(rng), some_text(rng), some_text(rng)]), float(rng.randint(0, 10**6))))
        kept.update(changes(spark, batch))
        for path, text, at in batch:
            if path not in best or at > best[path][0]:
                best[path] = (at, text)
        if turn == 1:
            kept.compact()
        same_as_a_full_run(spark, kept, {p: t for p, (_, t) in best.items() if t is not None})


def test_only_users_of_what_moved_are_resolved_again(spark, tmp_path, monkeypatch):
    kept = CurrentGraph(spark, f"file://{tmp_path}/state", RULES)
    tree = {"a.py": "def f():\n    return 1\n", "b.py": "from a import f\nf()\n", "c.py": "import os\n", "d.py": "import a.deep\n"}
    assert kept.update(changes(spark, [(p, t, 1.0) for p, t in tree.items()])) == 4
    # a change that claims the names of before
    tree["a.py"] = "def f():\n    return 2\n"
    assert kept.update(changes(spark, [("a.py", tree["a.py"], 2.0)])) == 1
    # the same text, older changes, rows without a path and other languages change nothing, and nothing is parsed for them
    monkeypatch.setattr(current, "syntax_rows", lambda files: pytest.fail("parsed") if files.count() else syntax_rows(files))
    assert kept.update(changes(spark, [("a.py", tree["a.py"], 3.0), ("b.py", "x\n", 0.5), (None, "x\n", 9.0), ("web.js", "x", 9.0)])) == 0
    # a name that goes touches the files that use it, and a file that goes those that import from below it
    monkeypatch.undo()
    tree["a.py"] = "def g():\n    return 2\n"
    assert kept.update(changes(spark, [("a.py", tree["a.py"], 4.0)])) == 2
    same_as_a_full_run(spark, kept, tree)
    del tree["a.py"]
    assert kept.update(changes(spark, [("a.py", None, 5.0)])) == 2
    # a null time is before all others, and so is a change of an older time than the deletion
    assert kept.update(changes(spark, [("a.py", "def f(): pass\n", None), ("b.py", "x\n", None)])) == 0
    assert kept.update(changes(spark, [("a.py", "def f(): pass\n", 4.5)])) == 0
    assert kept.update(changes(spark, [])) == 0
    same_as_a_full_run(spark, kept, tree)


def test_an_update_that_dies_changes_nothing(spark, tmp_path, monkeypatch):
    kept = CurrentGraph(spark, f"file://{tmp_path}/state", RULES)
    kept.update(changes(spark, [("a.py", "def f(): pass\n", 1.0), ("b.py", "import a\nf()\n", 1.0)]))
    before = shown(kept.graph().edges)
    with monkeypatch.context() as m:
        m.setattr(current, "replace_table", lambda *a: (_ for _ in ()).throw(OSError("gone")))
        with pytest.raises(OSError):
            kept.update(changes(spark, [("a.py", None, 2.0), ("c.py", "def f(): pass\n", 2.0)]))
    assert shown(kept.graph().edges) == before
    kept.update(changes(spark, [("a.py", None, 2.0)]))
    same_as_a_full_run(spark, kept, {"b.py": "import a\nf()\n"})
    # what was taken in once counts once
    assert kept.update(changes(spark, [("a.py", None, 2.0), ("b.py", "import a\nf()\n", 1.0)])) == 0


def test_ties_do_not_depend_on_order(spark, tmp_path):
    texts = ["def f(): pass\n", "def g(): pass\n", None]
    seen = set()
    for i, order in enumerate([texts, texts[::-1]]):
        kept = CurrentGraph(spark, f"file://{tmp_path}/state{i}", RULES)
        for text in order:
            kept.update(changes(spark, [("a.py", text, 1.0)]))
        seen.add(tuple(shown(kept.graph().nodes)))
    assert len(seen) == 1 and "file:a.py" in str(seen)


def test_stream_of_changes(spark, tmp_path):
    kept = CurrentGraph(spark, f"file://{tmp_path}/state", RULES)
    rounds, counts = [[("a.py", "def f(): pass\n", 1.0), ("b.py", "from a import f\nf()\n", 1.0)], [("a.py", None, 2.0)], []], []
    for batch in rounds:
        changes(spark, batch).write.mode("append").parquet(str(tmp_path / "in"))
        keep_current(kept, str(tmp_path / "in"), str(tmp_path / "offsets"), counts.append).awaitTermination()
    assert counts[:2] == [2, 1]
    same_as_a_full_run(spark, kept, {"b.py": "from a import f\nf()\n"})


def test_an_update_parses_in_tasks_that_grow(spark, tmp_path, monkeypatch):
    from astraloom.streaming import current

    parts = []
    whole = current.syntax_rows
    monkeypatch.setattr(current, "PARSED_AT_ONCE", 10)
    monkeypatch.setattr(current, "syntax_rows", lambda files: parts.append(files.rdd.getNumPartitions()) or whole(files))
    kept = current.CurrentGraph(spark, f"file://{tmp_path}/kept", ["DEAD_IMPORT"])
    kept.update(spark.createDataFrame([(f"p/m{k}.py", "import os\n") for k in range(120)], "path string, content string").selectExpr("*", "timestamp_seconds(1) AS at"))
    assert parts == [12] and kept.findings().count() == 120
