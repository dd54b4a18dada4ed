"""One run over a source tree: the tables of every stage that is asked for.

The stages share one parse: files, their syntax rows and the graph are written once and read by all the others.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from astraloom.functions import javascript
from astraloom.functions.syntax import syntax_rows
from astraloom.functions.tables import written
from astraloom.operators import code_graph, findings, graph, lint, patterns, questions, report, xref
from astraloom.sources import tree


@dataclass
class Options:
    """What to run; config is the content of a configuration file: exclude, rules, python.entry_points."""

    lint: bool = False
    js: bool = False
    xref: bool = False
    cycles: bool = False
    cluster: bool = True
    connectivity: bool = True
    config: dict = field(default_factory=dict)
    commits: DataFrame | None = None  # commit_id, ts, path: asks for hotspots
    hotspot_days: int = 180
    done: DataFrame | None = None  # item: lines of a notes file that claim something is done
    js_engine: str = "v2"  # or v1
    resolution: float | None = None  # asks for communities instead of components


class Analysis:
    """The stages of a tree (path, content) as frames; what was not asked for is None."""

    def __init__(self, files: DataFrame, options: Options = Options(), ignored: tuple[str, ...] = ()):
        spark: SparkSession = files.sparkSession
        exclude = (*tree.EXCLUDED, *options.config.get("exclude", ()))
        python = written(tree.described(tree.select_files(files, "lint", exclude)), "files")
        self.lint_rows = written(syntax_rows(python).sortWithinPartitions("kind", "path", "pre"), "rows")
        self.lint_files = python
        mapped = tree.select_files(python, "map", exclude, ignored)
        self.files, self.rows = mapped, self.lint_rows.join(mapped.select("path"), "path", "left_semi").select(*self.lint_rows.columns)
        self.graph = code_graph.build(self.rows, self.files)
        self.stats = code_graph.map_stats(self.graph)
        self.js_files = tree.select_files(files, "js", tuple(options.config.get("exclude", ()))) if options.js else None
        self.js_nodes, self.js_edges = javascript.js_graph(self.js_files, options.js_engine) if options.js else (None, None)
        self.blocks = graph.clusters(self.graph, resolution=options.resolution) if options.cluster else None
        entries = tuple((options.config.get("python") or {}).get("entry_points", ()))
        self.connectivity = graph.connectivity(self.graph, entries) if options.connectivity else None
        self.cycles = graph.cycles(self.graph) if options.cycles else None
        self.hotspots = graph.hotspots(self.graph, tree.churn(options.commits, days=options.hotspot_days)).orderBy(F.desc("score"), "path") if options.commits is not None else None
        self.xref = xref.CrossReferences(self.rows, self.files, self.graph) if options.xref else None
        parts = []
        if options.lint:
            parts.append(lint.findings(self.lint_rows, self.lint_files, [r for r in lint.RULES if not r.endswith("_INTENT")]))
        if options.js:
            parts.append(javascript.js_findings(self.js_files))
        if options.config.get("rules"):
            parts.append(patterns.pattern_findings(self.lint_rows, options.config["rules"]))
        if self.xref:
            parts.append(self.xref.findings.withColumn("tier", F.lit("xref")))
        empty = spark.createDataFrame([], "tier string, path string, line long, rule string, severity string, symbol string")
        self.findings = written(findings.collect(empty, *parts), "findings")
        self.options = options

    def questions(self) -> DataFrame:
        """All questions that the stages allow."""
        frames = {"n": self.rows, "f": self.files, "nodes": self.graph.nodes, "edges": self.graph.edges}
        kinds = ["soft_delete", "expiry", "temporal", "constraints", "error_handling"]
        if self.connectivity is not None:
            frames["status"] = self.connectivity
            kinds.append("connectivity")
        if self.xref:
            frames |= {"usage": self.xref.usage, "xref_findings": self.xref.findings}
            kinds += ["xref", "contracts"]
        if self.options.done is not None:
            frames["done"] = self.options.done
            kinds.append("claims")
        out: DataFrame | None = None
        for kind in kinds:
            one = written(questions.ask(kind, **frames), "questions")
            out = one if out is None else out.unionByName(one)
        return out

    def context(self) -> DataFrame:
        """What a review of each file is told; the review itself is `questions.review` with a client."""
        if not self.xref or self.connectivity is None:
            raise ValueError("a review needs cross references and connectivity")
        roles = questions.roles(self.graph.nodes, self.graph.routes, self.connectivity)
        return questions.review_context(self.files, self.findings, self.xref.usage, self.xref.users(), roles)

    def summary(self) -> DataFrame:
        """What a console shows of the run."""
        connected = None if self.connectivity is None else graph.connectivity_summary(self.connectivity)
        return report.summary(self.stats, self.findings, self.xref.usage if self.xref else None, self.cycles, self.hotspots, connected)

    def merged(self) -> tuple[DataFrame, DataFrame]:
        """Nodes and edges of the map, those of JavaScript files behind them."""
        if self.js_nodes is None:
            raise ValueError("the JavaScript files were not read")
        return javascript.merged(self.graph.nodes, self.graph.edges, self.js_nodes, self.js_edges)

    def tables(self) -> dict[str, DataFrame]:
        """What a report holds."""
        found = {
            "stats": self.stats, "nodes": self.graph.nodes.drop("seq"), "edges": self.graph.edges, "routes": self.graph.routes.drop("place"), "findings": self.findings, "blocks": self.blocks, "connectivity": self.connectivity,
            "cycles": self.cycles, "hotspots": self.hotspots, "symbols": self.xref.usage if self.xref else None, "js_nodes": self.js_nodes, "js_edges": self.js_edges, "map_nodes": self.merged()[0] if self.js_nodes is not None else None, "map_edges": self.merged()[1] if self.js_nodes is not None else None,
        }
        return {k: v for k, v in found.items() if v is not None}
