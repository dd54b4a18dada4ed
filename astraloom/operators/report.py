"""Sinks: tables, one JSON document, static pages, summaries for a console."""

from __future__ import annotations

import html
import json
import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from astraloom.operators.findings import by_severity, rank


def write_tables(folder: str, **tables: DataFrame) -> None:
    """Each table as Parquet below folder."""
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{folder}/{name}")


def json_rows(**tables: DataFrame) -> DataFrame:
    """table, row: every row of every table as JSON, for one document however large."""
    out: DataFrame | None = None
    for name, table in tables.items():
        one = table.select(F.lit(name).alias("table"), F.to_json(F.struct("*")).alias("row"))
        out = one if out is None else out.unionByName(one)
    return out


def write_json(path: str, **tables: DataFrame) -> None:
    """One JSON document on the driver's disk, written beside its place and moved in; rows come over one partition at a time."""
    with open(f"{path}.tmp", "w", encoding="utf-8") as out:
        out.write("{")
        for i, (name, table) in enumerate(tables.items()):
            out.write(f'{"," if i else ""}"{name}":[')
            for j, row in enumerate(table.select(F.to_json(F.struct("*")).alias("row")).toLocalIterator()):
                out.write(("," if j else "") + row["row"])
            out.write("]")
        out.write("}")
    os.replace(f"{path}.tmp", path)


def write_html(path: str, found: DataFrame, changes: DataFrame | None = None, rows: int = 5000) -> None:
    """A static page: counts, the most severe findings up to `rows`, and up to 30 new and resolved ones."""
    counts = by_severity(found).first()
    listed = found.orderBy(rank(F.col("severity")).desc(), "path", "line").limit(rows).collect()
    cell = lambda x: f"<td>{html.escape(str(x if x is not None else ''))[:300]}</td>"
    line = lambda r: "<tr>" + "".join(cell(r[c]) for c in ("severity", "rule", "path", "line", "symbol")) + "</tr>"
    parts = ["<!doctype html><meta charset=utf-8><title>Findings</title><h1>Findings</h1><p>" + ", ".join(f"{k}: {counts[k]}" for k in ("high", "med", "low", "other")) + "</p>"]
    for kind in ("new", "resolved") if changes is not None else ():
        some = changes.filter(F.col("change") == kind).orderBy(rank(F.col("severity")).desc(), "path", "line").limit(30).collect()
        parts.append(f"<h2>{kind}</h2><table>{''.join(map(line, some))}</table>")
    total = sum(counts[k] for k in ("high", "med", "low", "other"))
    parts.append(f"<table>{''.join(map(line, listed))}</table>" + (f"<p>The {rows} most severe of {total}; the JSON document and the tables hold all.</p>" if total > rows else ""))
    with open(f"{path}.tmp", "w", encoding="utf-8") as out:
        out.write("\n".join(parts))
    os.replace(f"{path}.tmp", path)


#: A page without libraries: blocks as boxes on a circle, sized by files, with their edges; a click lists a block's files, a filter hides names.
_PAGE = """<!doctype html><meta charset=utf-8><title>%(title)s</title>
<style>body{font:14px sans-serif;display:flex}svg{width:70vw;height:95vh}aside{width:28vw;overflow:auto;height:95vh}line{stroke:#999}circle{fill:#8ac;cursor:pointer}</style>
<svg viewBox="-120 -120 240 240"></svg><aside><input placeholder=filter><h2></h2><ul></ul></aside><script type="application/json">%(data)s</script>
<script>const d=JSON.parse(document.querySelector('script[type]').textContent),svg=document.querySelector('svg'),at={};
const add=(n,a,t)=>{const e=document.createElementNS('http://www.w3.org/2000/svg',n);for(const k in a)e.setAttribute(k,a[k]);if(t)e.textContent=t;svg.append(e);return e};
d.nodes.forEach((n,i)=>{const w=2*Math.PI*i/d.nodes.length;at[n.id]=[90*Math.cos(w),90*Math.sin(w)]});
d.edges.forEach(e=>{const a=at[e.source],b=at[e.target];if(a&&b)add('line',{x1:a[0],y1:a[1],x2:b[0],y2:b[1],'stroke-width':Math.min(3,.3*e.weight)})});
d.nodes.forEach(n=>{const [x,y]=at[n.id];add('circle',{cx:x,cy:y,r:2+Math.min(8,Math.sqrt(n.size))}).onclick=()=>{document.querySelector('h2').textContent=n.label;const u=document.querySelector('ul');u.replaceChildren(...n.details.map(t=>{const l=document.createElement('li');l.textContent=t;return l}))};add('text',{x:x+3,y:y,'font-size':3},n.label).dataset.name=n.label});
document.querySelector('input').oninput=e=>svg.querySelectorAll('text').forEach(t=>t.style.display=t.dataset.name.includes(e.target.value)?'':'none')</script>
"""


def write_graph_page(path: str, title: str, nodes: DataFrame, edges: DataFrame, most: int = 2000) -> None:
    """A static page of a graph. nodes: id, label, size, details; edges: source, target, weight. The largest `most` nodes are drawn, and of the edges between them the `20 * most` heaviest; the title says if more exist of either."""
    total = nodes.count()
    shown = nodes.orderBy(F.desc("size"), "id").limit(most).collect()
    drawn = nodes.orderBy(F.desc("size"), "id").limit(most).select("id")
    among = edges.join(drawn.withColumnRenamed("id", "source"), "source", "left_semi").join(drawn.withColumnRenamed("id", "target"), "target", "left_semi")
    keep, links = among.orderBy(F.desc("weight"), "source", "target").limit(20 * most).collect(), among.count()
    data = {"nodes": [r.asDict() for r in shown], "edges": [r.asDict() for r in keep]}
    said = title if total <= most else f"{title}: the largest {most} of {total}"
    said = html.escape(said if links <= len(keep) else f"{said}, {len(keep)} of {links} edges")
    with open(f"{path}.tmp", "w", encoding="utf-8") as out:
        out.write(_PAGE % {"title": said, "data": json.dumps(data).replace("<", "\\u003c")})
    os.replace(f"{path}.tmp", path)


def file_page(view: DataFrame, near: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a page of files, from `graph.file_view` and `graph.neighbourhood`."""
    nodes = view.join(near, "path").select(F.col("path").alias("id"), "label", F.col("complexity").alias("size"), F.concat(F.transform("imports", lambda x: F.concat(F.lit("imports "), x)), F.transform("imported_by", lambda x: F.concat(F.lit("imported by "), x))).alias("details"))
    return nodes, near.select(F.col("path").alias("source"), F.explode("imports").alias("target"), F.lit(1).alias("weight"))


def block_page(blocks: DataFrame, names: DataFrame, crossing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a page of blocks, from `graph.clusters`, `graph.block_names` and the edges of `graph.block_view`."""
    nodes = blocks.join(names, "block").select(F.col("block").alias("id"), F.col("name").alias("label"), F.size("members").alias("size"), F.col("members").alias("details"))
    return nodes, crossing.select(F.col("block_a").alias("source"), F.col("block_b").alias("target"), F.col("edges").alias("weight"))


def summary(stats: DataFrame, found: DataFrame | None = None, usage: DataFrame | None = None, cycles: DataFrame | None = None, hotspots: DataFrame | None = None, connectivity: DataFrame | None = None, top: int = 20) -> DataFrame:
    """section, at, text: what a console shows of a run: the map, findings by severity and rule, symbols, cycles and the first hotspots."""
    parts = [stats.select(F.lit("map").alias("section"), F.lit(1).alias("at"), F.concat_ws(", ", *(F.concat(F.lit(f"{c}: "), F.col(c)) for c in ("files", "classes", "functions", "stubs", "edges")), F.concat(F.lit("tables: "), F.size("tables"))).alias("text"))]
    from pyspark.sql import Window

    numbered = lambda section, df, order, text: df.select(F.lit(section).alias("section"), F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)).alias("at"), text.alias("text"))  # noqa: E731  a few rows each
    if connectivity is not None:
        parts.append(connectivity.select(F.lit("connectivity"), F.lit(1), F.concat_ws(", ", *(F.concat(F.lit(f"{c}: "), F.col(c)) for c in ("reachable", "unreachable", "incomplete")))))
    if found is not None:
        by_rule = found.groupBy("rule", "severity").agg(F.count(F.lit(1)).alias("n"))
        parts.append(by_severity(found).select(F.lit("findings"), F.lit(0), F.concat_ws(", ", *(F.concat(F.lit(f"{c}: "), F.col(c)) for c in ("high", "med", "low", "other")))))
        parts.append(numbered("findings", by_rule, (F.desc("n"), "rule"), F.concat(F.lit("["), "severity", F.lit("] "), "rule", F.lit(": "), "n")))
    if usage is not None:
        uses = F.col("n_imported") + F.col("n_called") + F.col("n_referenced")
        first = usage.select("path", "name", "line", uses.alias("n")).orderBy(F.desc("n"), F.split("path", "/"), "line").limit(5)
        parts.append(numbered("symbols", first, (F.desc("n"), F.split("path", "/"), "line"), F.concat("name", F.lit(" in "), "path", F.lit(": "), "n", F.lit(" uses"))))
    if cycles is not None:
        parts.append(cycles.agg(F.count(F.lit(1)).alias("n")).select(F.lit("cycles"), F.lit(0), F.when(F.col("n") == 0, "none").otherwise(F.concat("n", F.lit(" cycles")))))
        some = cycles.orderBy(F.desc("cycle_length"), "path").limit(top)
        parts.append(numbered("cycles", some, (F.desc("cycle_length"), "path"), F.concat(F.lit("["), "severity", F.lit("] "), F.concat_ws(" > ", "cycle"), F.when(F.col("scc_size") > F.col("cycle_length"), F.concat(F.lit(" of "), "scc_size", F.lit(" files"))).otherwise(""))))
    if hotspots is not None:
        some = hotspots.orderBy(F.desc("score"), "path").limit(top)
        parts.append(numbered("hotspots", some, (F.desc("score"), "path"), F.concat(F.format_number("score", 3), F.lit(" "), "complexity", F.lit(" x "), "churn", F.lit(" "), "path")))
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out
