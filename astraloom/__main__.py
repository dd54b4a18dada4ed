"""python -m astraloom ROOT: maps a source tree and runs the stages that the flags ask for.

Exit status 1 if --fail-on finds something as severe, or --diff finds a new high finding.
"""

from __future__ import annotations

import argparse
import json
import os
import subprocess
import sys

from pyspark.sql import functions as F

from astraloom.engine import Analysis, Options
from astraloom.functions.tables import written
from astraloom.operators import findings, fixes, graph, report
from astraloom.session import session
from astraloom.sources import tree

BASELINE = ".astraloom-baseline"


def arguments(argv: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="astraloom", description=__doc__)
    p.add_argument("root")
    p.add_argument("--output", "-o", help="JSON document (default: repo-map.json in the root)")
    p.add_argument("--tables", help="folder for the tables as Parquet")
    p.add_argument("--config", "-c")
    for flag in ("lint", "js", "xref", "cycles", "hotspots", "questions", "no-cluster", "no-connectivity", "fix", "dry-run"):
        p.add_argument(f"--{flag}", action="store_true")
    p.add_argument("--hotspot-days", type=int, default=180)
    p.add_argument("--todo", help="notes whose done items become questions")
    p.add_argument("--fail-on", choices=("low", "med", "high"))
    p.add_argument("--diff", metavar="BASELINE", help="a folder of saved findings, a saved document, a git revision that has one, or 'auto' for the last run")
    p.add_argument("--js-engine", choices=("v1", "v2"), default="v2")
    p.add_argument("--resolution", type=float, help="cluster by modularity at this resolution instead of by components")
    p.add_argument("--pages", help="folder for the pages of files and blocks")
    p.add_argument("--html", nargs="?", const="repo-map-report.html")
    return p.parse_args(argv)


def git_commits(spark, root: str, days: int):
    """The log of a checkout as commits; anything that goes wrong gives no commits."""
    schema = "commit_id string, ts timestamp, path string"
    try:
        done = subprocess.run(["git", "-C", root, "log", f"--since={days}.days", "--name-only", "--pretty=format:@%H %ct"], capture_output=True, text=True, timeout=30, check=True)
    except (OSError, subprocess.SubprocessError):
        return spark.createDataFrame([], schema)
    rows, at = [], ("", 0)
    for line in filter(None, map(str.strip, done.stdout.splitlines())):
        if line[0] == "@":
            commit, _, seconds = line[1:].partition(" ")
            at = (commit, int(seconds))
        else:
            rows.append((*at, line))
    return spark.createDataFrame(rows, "commit_id string, seconds long, path string").select("commit_id", F.timestamp_seconds("seconds").alias("ts"), "path")


FINDING = tree.FINDING


def baseline(spark, spec: str, root: str):
    """Earlier findings: a folder of them, a saved document, or a document at a git revision; None if there are none."""
    text = None
    if os.path.isfile(spec):
        with open(spec, encoding="utf-8") as f:
            text = f.read()
    elif not os.path.isdir(spec):
        try:
            text = subprocess.run(["git", "-C", root, "show", f"{spec}:repo-map.json"], capture_output=True, text=True, timeout=15, check=True).stdout
        except (OSError, subprocess.SubprocessError):
            return None
    if text is None:
        return tree.read_baseline(spark, spec)
    try:
        rows = json.loads(text).get("findings", [])
    except ValueError:
        return None
    names = [x.split()[0] for x in FINDING.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], FINDING)


def main(argv: list[str] | None = None) -> int:
    args = arguments(sys.argv[1:] if argv is None else argv)
    root = os.path.abspath(args.root)
    if not os.path.isdir(root):
        print(f"no such folder: {root}", file=sys.stderr)
        return 2
    spark = session()
    config = tree.load_config(args.config or os.path.join(root, tree.CONFIG_NAME))
    options = Options(
        args.lint or args.fix, args.js, args.xref or args.questions, args.cycles, not args.no_cluster, not args.no_connectivity, config,
        git_commits(spark, root, args.hotspot_days) if args.hotspots else None, args.hotspot_days, tree.done_items(spark, args.todo) if args.todo else None,
        args.js_engine, args.resolution,
    )
    files = tree.read_tree(spark, root, (*tree.EXCLUDED, *config.get("exclude", ())), args.js)
    run = Analysis(files, options, tuple(tree.ignored_names(spark, root)))
    tables = run.tables() | ({"questions": run.questions()} if args.questions else {})
    if run.blocks is not None:
        tables["view_blocks"] = graph.view_blocks(run.blocks, run.graph)
    report.write_json(args.output or os.path.join(root, "repo-map.json"), **tables)
    if args.tables:
        report.write_tables(args.tables, **tables)
    for row in run.summary().orderBy("section", "at").collect():
        print(f"{row['section']}: {row['text']}")
    if args.pages:
        os.makedirs(args.pages, exist_ok=True)
        report.write_graph_page(os.path.join(args.pages, "files.html"), "Files", *report.file_page(graph.file_view(run.graph), graph.neighbourhood(run.graph)))
        if run.blocks is not None:
            crossing = graph.block_view(run.blocks, run.graph, run.findings)[1]
            report.write_graph_page(os.path.join(args.pages, "blocks.html"), "Blocks", *report.block_page(run.blocks, graph.block_names(run.blocks), crossing))
    if args.fix:
        for row in fixes.fixed(run.lint_files, run.findings).toLocalIterator():
            print(row["path"], row["dead_imports"], row["unused_params"], row["future_imports"])
            if not args.dry_run:
                with open(os.path.join(root, row["path"]), "w", encoding="utf-8", newline="") as out:
                    out.write(row["content"])
    changes, status = None, 0
    if args.diff:
        saved = os.path.join(root, BASELINE)
        before = baseline(spark, saved if args.diff == "auto" else args.diff, root)
        if before is not None:
            changes = written(findings.diff(run.findings, before), "changes")  # the baseline is overwritten below
            for row in findings.most_severe(changes.filter("change = 'new'")).collect():
                print("new", row["severity"], row["rule"], f"{row['path']}:{row['line']}", row["symbol"])
            for row in findings.most_severe(changes.filter("change = 'resolved'"), 5).collect():
                print("resolved", row["severity"], row["rule"], f"{row['path']}:{row['line']}", row["symbol"])
            status = int(findings.regressed(changes))
        tree.save_baseline(run.findings, saved)
    if args.html:
        report.write_html(args.html if os.path.isabs(args.html) else os.path.join(root, args.html), run.findings, changes)
    if args.fail_on and findings.gate(run.findings, args.fail_on):
        status = 1
    return status


if __name__ == "__main__":
    sys.exit(main())
