"""Graph analytics over code graphs: reachability, import cycles, clusters, hotspots and aggregates for views.

Loops are frontier joins whose rounds are cut by checkpoints. Where the order of sets would decide, ties go to the
least name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from astraloom.functions.tables import cut, numbered, release, sql, true_sizes
from astraloom.operators.code_graph import CodeGraph
from astraloom.operators.lint import among

#: Fixed values of the classification.
ENTRY_STEMS = among("main __main__ cli app server wsgi asgi")
CONFIG_STEMS = among("config settings constants defaults env")
MIDDLEWARE_STEMS = among("csrf middleware cors logging_middleware auth_middleware")
STANDALONE_DIRS = "array('tols-pbj', 'updates', 'migrations', 'versions', 'scripts', 'tools')"
STOP_WORDS = among("__init__ backend routers services models schemas jobs py")


def reach(edges: DataFrame, start: DataFrame) -> DataFrame:
    """edges: src, dst; start: id. The ids that start reaches, itself included.

    A round writes what it has found anew, and nothing twice: what was seen before is the union of the earlier rounds,
    put together anew only after every `TOGETHER` rounds, so that plans stay short. A search that goes on for longer than that meets
    chains, so every `TOGETHER` rounds `shortcuts` are laid over the ways that are left: a chain of n then ends in log n rounds.
    """
    edges = cut(edges.select("src", "dst").distinct())
    frontier = seen = cut(start.select("id").distinct())
    rounds, parts = 0, [seen]
    while not frontier.isEmpty():
        step = edges.join(frontier, edges["src"] == frontier["id"], "left_semi").select(F.col("dst").alias("id")).distinct()
        frontier = cut(step.join(seen, "id", "left_anti"))
        rounds += 1
        seen = seen.union(frontier)
        parts.append(frontier)
        if rounds % TOGETHER == 0:
            seen = cut(seen)
            release(*(x for x in parts if x is not frontier))
            parts = [seen, frontier]
            ahead = edges.join(seen, edges["dst"] == seen["id"], "left_anti")
            last, edges = edges, cut(ahead.union(shortcuts(ahead)).distinct())
            release(last)
    release(edges)
    return seen


#: Rounds whose finds are put together into one table.
TOGETHER = 16


def shortcuts(edges: DataFrame) -> DataFrame:
    """src, dst: from every node with one way on (ways to dead ends aside) the ends of its 2, 4, 8 ... next steps along such nodes."""
    lively = edges.join(edges.select(F.col("src").alias("on")).distinct(), edges["dst"] == F.col("on"), "left_semi")
    hop = cut(lively.groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.min("dst").alias("dst")).filter("n = 1").select("src", "dst"))
    found, longest, most = hop.limit(0), hop, hop.count()
    size = 1
    while size < most:  # a ring has no end
        further = longest.select(F.col("src").alias("dst"), F.col("dst").alias("further"))
        longest = cut(longest.join(further, "dst").select("src", F.col("further").alias("dst")))
        if longest.isEmpty():
            break
        found, size = found.union(longest), 2 * size
    return found


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """id and the least id of its component: labels go down along edges, and labels of labels halve the way."""
    both = cut(edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    label = cut(nodes.select("id", F.col("id").alias("label")))
    last = label
    while True:
        near = both.join(label, both["dst"] == label["id"]).groupBy("src").agg(F.min("label").alias("near"))
        down = label.join(near, label["id"] == near["src"], "left").select("id", F.least("label", "near").alias("label"), F.col("label").alias("before"))
        jump = down.select(F.col("id").alias("via"), F.col("label").alias("further"))
        after = cut(down.join(jump, down["label"] == jump["via"], "left").select("id", F.least("label", "further").alias("label"), "before"))
        release(last)
        label, last = after.select("id", "label"), after
        if after.filter("label <> before").isEmpty():
            release(both)
            return label


def chains(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What lies between the ends of chains: (id, first, last), and (id, scc) of rings that nothing enters or leaves; edges: src, dst without self-loops.

    An inner node has one way in and one way on. Its ends are found by doubling, in both directions, in rounds that grow with the
    logarithm of the longest chain; a node that gets nowhere lies on a ring, whose name is the least of its nodes.
    """
    spark = edges.sparkSession
    into, on = (edges.groupBy(F.col(a).alias("id")).agg(F.count(F.lit(1)).alias("n"), F.min(b).alias("to")).filter("n = 1").select("id", "to") for a, b in (("dst", "src"), ("src", "dst")))
    inner = cut(into.withColumnRenamed("to", "first").join(on.withColumnRenamed("to", "last"), "id"))
    now = cut(inner.select("id", "first", "last", F.col("id").alias("least"), F.lit(False).alias("a_done"), F.lit(False).alias("b_done")))
    before = None
    while True:
        # an end that is no inner node is reached; else the way is as long again
        then = cut(
            sql(
                spark,
                """
SELECT n.id, IF(n.a_done OR p.id IS NULL, n.first, p.first) AS first, IF(n.b_done OR q.id IS NULL, n.last, q.last) AS last, least(n.least, coalesce(q.least, n.least)) AS least,
  n.a_done OR p.id IS NULL OR p.a_done AS a_done, n.b_done OR q.id IS NULL OR q.b_done AS b_done
FROM now n LEFT JOIN now p ON p.id = n.first LEFT JOIN now q ON q.id = n.last""",
                now=now,
            )
        )
        release(now)
        now = then
        mark = tuple(now.filter("NOT a_done").agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("id", "least").cast("decimal(38,0)")), F.lit(0))).first())
        if not mark[0] or mark == before:
            release(inner)
            return now.filter("a_done").select("id", "first", "last"), now.filter("NOT a_done").select("id", F.col("least").alias("scc"))
        before = mark


#: Rounds of one kind after which chains are contracted.
PATIENCE = 8


def strong_components(edges: DataFrame) -> DataFrame:
    """id and scc (its greatest id) of every node that lies on a cycle; edges: src, dst without self-loops.

    Nodes without a way in or on lie on no cycle and go, and what is left is coloured. Where either takes more than `PATIENCE` rounds
    there are long ways: chains become single edges then, whose inner nodes have their ends' component if both ends have the same.
    """
    spark = edges.sparkSession
    left = cut(edges.select("src", "dst").distinct())
    size = left.count()
    bound: list[DataFrame] = []  # of every contraction: what lies within its chains
    found: DataFrame = spark.createDataFrame([], "id string, scc string")

    def contracted(left: DataFrame) -> DataFrame:
        """One edge from end to end of every chain whose ends differ; rings are found and go."""
        nonlocal found
        inner, rings = map(cut, chains(left))
        found = found.union(rings)
        bound.append(inner)
        within = inner.select(F.col("id").alias("x")).union(rings.select("id"))
        outer = left.join(within, left["src"] == within["x"], "left_anti").join(within, left["dst"] == within["x"], "left_anti")
        after = cut(outer.union(inner.filter("first <> last").select("first", "last")).distinct())
        release(left)
        return after

    stuck = -1  # so many edges are left that no contraction lessens
    while size:
        rounds = 0
        while size:
            last, left = left, cut(left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
            release(last)
            before, size, rounds = size, left.count(), rounds + 1
            if size == before:
                break
            if rounds % PATIENCE == 0:
                left = contracted(left)
                size = left.count()
        if not size:
            break
        nodes = left.select(F.col("src").alias("id")).union(left.select("dst")).distinct()
        colour = cut(nodes.select("id", F.col("id").alias("colour")))
        rounds = 0 if size != stuck else PATIENCE  # without chains it goes on to the end
        while True:
            come = left.join(colour, left["src"] == colour["id"]).groupBy("dst").agg(F.max("colour").alias("come"))
            last, colour = colour, cut(colour.join(come, colour["id"] == come["dst"], "left").select("id", F.greatest("colour", F.coalesce("come", "colour")).alias("colour"), F.col("colour").alias("before")))
            release(last)
            rounds += 1
            settled = colour.filter("colour <> before").isEmpty()
            if settled or rounds == PATIENCE:
                break
        if not settled:
            left = contracted(left)
            before, size = size, left.count()
            stuck = size if size == before else -1
            continue
        # within a colour the root's component is what reaches the root
        a, b = colour.select(F.col("id").alias("src"), F.col("colour").alias("c")), colour.select(F.col("id").alias("dst"), F.col("colour").alias("d"))
        inside = left.join(a, "src").join(b, "dst").filter("c = d").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        members = cut(reach(inside, colour.filter("id = colour").select("id")).join(colour, "id").select("id", F.col("colour").alias("scc")))
        found = found.unionByName(members)
        gone = members.select(F.col("id").alias("gone"))
        last, left = left, cut(left.join(gone, left["src"] == gone["gone"], "left_anti").join(gone, left["dst"] == gone["gone"], "left_anti"))
        release(last)
        size = left.count()
    found = cut(found)
    for inner in reversed(bound):  # the ends of earlier chains may lie within later ones; a node without a component is its own
        known = sql(
            spark,
            """
WITH x AS (SELECT i.id, i.first, coalesce(a.scc, i.first) AS scc FROM inner_nodes i LEFT JOIN found a ON a.id = i.first LEFT JOIN found b ON b.id = i.last WHERE coalesce(a.scc, i.first) = coalesce(b.scc, i.last))
SELECT id, scc FROM x UNION ALL SELECT DISTINCT x.first, x.scc FROM x LEFT ANTI JOIN found f ON f.id = x.first""",
            inner_nodes=inner, found=found,
        )
        last, found = found, cut(found.union(known))
        release(last, inner)
    sized = found.groupBy("scc").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("name")).filter("n > 1")
    return found.join(sized, "scc").select("id", F.col("name").alias("scc"))


def import_graph(graph: CodeGraph) -> DataFrame:
    """Module-level imports between files, without self-imports."""
    return sql(graph.nodes.sparkSession, "SELECT DISTINCT source AS src, target AS dst FROM edges WHERE type = 'import' AND NOT arrays_overlap(flags, array('function_scope', 'dynamic')) AND source <> target AND startswith(source, 'file:') AND startswith(target, 'file:')", edges=graph.edges)


def shortest_cycles(edges: DataFrame) -> DataFrame:
    """scc and path of a shortest cycle of every component; edges: scc, src, dst within components.

    Of the cycles of that length it is one through the least node, then the least by its nodes in order, from behind that node,
    which closes it. Ways go from every node through greater ones only, as the least node of a shortest cycle reaches all of it so,
    and one way is kept per start and end. A component leaves with its first cycle, so the rounds are the greatest girth.
    """
    spark = edges.sparkSession
    ways = cut(edges.filter("src < dst").select("scc", F.col("src").alias("start"), F.col("dst").alias("at"), F.array("dst").alias("path")))
    found: DataFrame | None = None
    while not ways.isEmpty():
        closed = cut(
            sql(
                spark,
                """
WITH c AS (SELECT w.scc, w.start, min(w.path) AS path FROM ways w JOIN edges e ON e.scc = w.scc AND e.src = w.at AND e.dst = w.start GROUP BY w.scc, w.start)
SELECT scc, concat(min_by(path, start), array(min(start))) AS path FROM c GROUP BY scc""",
                ways=ways, edges=edges,
            )
        )
        found = closed if found is None else found.union(closed)
        ways = cut(
            sql(
                spark,
                """
SELECT w.scc, w.start, e.dst AS at, min(concat(w.path, array(e.dst))) AS path FROM (SELECT * FROM ways LEFT ANTI JOIN closed ON closed.scc = ways.scc) w
JOIN edges e ON e.scc = w.scc AND e.src = w.at AND e.dst > w.start GROUP BY w.scc, w.start, e.dst""",
                ways=ways, closed=closed, edges=edges,
            )
        )
    return spark.createDataFrame([], "scc string, path array<string>") if found is None else found


def simple_cycles(edges: DataFrame, longest: int = 5) -> tuple[DataFrame, DataFrame]:
    """Every simple cycle of 2 to `longest` nodes, and how much lies beyond; edges: src, dst.

    The first result is cycle (its nodes from the least one) and length, a row per cycle: ways grow within the strong components from
    every node through greater nodes only, so each rotation but one never begins. The second is start and n_open: the ways of `longest`
    nodes that can go on, a bound on nothing but a sign that longer cycles may be there; without rows there are none. The number of ways
    may grow with the power of the degree, which is what `longest` is for.
    """
    edges = edges.filter("src <> dst").select("src", "dst").distinct()
    scc = strong_components(edges)
    a, b = scc.select(F.col("id").alias("src"), "scc"), scc.select(F.col("id").alias("dst"), F.col("scc").alias("other"))
    inside = cut(edges.join(a, "src").join(b, "dst").filter("scc = other").select("src", "dst"))
    ways = cut(inside.filter("src < dst").select(F.col("src").alias("start"), F.col("dst").alias("at"), F.array("src", "dst").alias("path")))
    found: list[DataFrame] = []
    for size in range(2, longest + 1):
        back = inside.select(F.col("src").alias("at"), F.col("dst").alias("start"))
        found.append(cut(ways.join(back, ["at", "start"], "left_semi").select(F.col("path").alias("cycle"))))
        onward = ways.join(inside.filter("src <> dst"), ways["at"] == inside["src"]).filter("dst > start AND NOT array_contains(path, dst)")
        if size == longest:
            beyond = cut(onward.groupBy("start").agg(F.count(F.lit(1)).alias("n_open")))
            break
        last, ways = ways, cut(onward.select("start", F.col("dst").alias("at"), F.concat("path", F.array("dst")).alias("path")))
        release(last)
    release(ways, inside)
    return reduce(DataFrame.union, found).select("cycle", F.size("cycle").alias("length")), beyond


def all_imports(graph: CodeGraph) -> DataFrame:
    """Imports between files wherever they stand, within functions too, without self-imports."""
    return sql(graph.nodes.sparkSession, "SELECT DISTINCT source AS src, target AS dst FROM edges WHERE type = 'import' AND source <> target AND startswith(source, 'file:') AND startswith(target, 'file:')", edges=graph.edges)


def circular_dependencies(graph: CodeGraph, longest: int = 5) -> tuple[DataFrame, DataFrame]:
    """path, cycle and length of every cycle of imports of up to `longest` files, function-scope imports too, and what `simple_cycles` says of longer ones."""
    found, beyond = simple_cycles(all_imports(graph), longest)
    plain = F.transform("cycle", lambda x: F.regexp_replace(x, "^file:", ""))
    return found.select(plain[0].alias("path"), plain.alias("cycle"), "length"), beyond.select(F.regexp_replace("start", "^file:", "").alias("path"), "n_open")


def cycles(graph: CodeGraph) -> DataFrame:
    """One row per strongly connected component of files: its shortest cycle, size and severity."""
    edges = cut(import_graph(graph))
    scc = strong_components(edges)
    a, b = scc.select(F.col("id").alias("src"), "scc"), scc.select(F.col("id").alias("dst"), F.col("scc").alias("other"))
    inside = cut(edges.join(a, "src").join(b, "dst").filter("scc = other").select("scc", "src", "dst"))
    sizes = scc.groupBy("scc").agg(F.count(F.lit(1)).cast("int").alias("scc_size"))
    found = shortest_cycles(inside).join(sizes, "scc").withColumn("cycle", F.transform("path", lambda x: F.regexp_replace(x, "^file:", ""))).withColumn("cycle_length", F.size("cycle"))
    return found.select(F.lit("CIRCULAR_DEPENDENCY").alias("rule"), F.when(F.col("cycle_length") >= 3, "high").otherwise("med").alias("severity"), F.col("cycle")[0].alias("path"), F.lit(1).cast("long").alias("line"), "cycle_length", "scc_size", "cycle")


def connectivity(graph: CodeGraph, entry_points: tuple[str, ...] | DataFrame = ()) -> DataFrame:
    """path, status, dead_confidence of every file. entry_points: ids of nodes, or a frame of them (id); without any that exist, what the tree says."""
    spark = graph.nodes.sparkSession
    known = sql(spark, "SELECT e.source AS src, e.target AS dst FROM edges e LEFT SEMI JOIN nodes a ON a.id = e.source LEFT SEMI JOIN nodes b ON b.id = e.target UNION ALL SELECT c.parent_id, c.id FROM nodes c LEFT SEMI JOIN nodes p ON p.id = c.parent_id", edges=graph.edges, nodes=graph.nodes)
    known = cut(known.distinct())
    files = graph.nodes.filter("type = 'file'")
    if isinstance(entry_points, DataFrame):
        entries = graph.nodes.join(entry_points.select("id"), "id", "left_semi")
    else:
        entries = graph.nodes.filter(F.col("id").isin(*entry_points)) if entry_points else graph.nodes.limit(0)
    for rule in ("n_routes > 0", f"name IN {ENTRY_STEMS}"):
        if entries.isEmpty():
            entries = files.filter(rule)
    entries = cut(entries.select("id"))
    effects = cut(files.filter("n_routes > 0 OR size(tables) > 0").select("id"))
    forward = reach(known, entries)
    backward = forward if effects.isEmpty() else reach(known.select(F.col("dst").alias("src"), F.col("src").alias("dst")), effects.union(entries))
    return sql(
        spark,
        f"""
WITH x AS (SELECT f.path, f.name AS stem, f.id, f.n_routes, f.tables, split(f.path, '/') AS parts, f.id IN (SELECT id FROM forward) AS reachable, f.id IN (SELECT id FROM backward) AS useful, f.id IN (SELECT dst FROM known) AS inbound,
  f.id IN (SELECT id FROM entries) AS entry, f.id IN (SELECT id FROM effects) OR f.id IN (SELECT id FROM entries) AS effect FROM nodes f WHERE f.type = 'file'),
y AS (SELECT *, NOT contains(path, '/') OR arrays_overlap(slice(parts, 1, size(parts) - 1), {STANDALONE_DIRS}) OR stem = 'cli' OR endswith(stem, '_cli') OR stem = 'manage' AS standalone,
  contains(path, 'schemas/') OR (stem IN {CONFIG_STEMS} AND n_routes = 0 AND size(tables) = 0) OR stem IN {MIDDLEWARE_STEMS} AS passive FROM x)
SELECT path, CASE WHEN element_at(parts, -1) = '__init__.py' THEN 'reachable' WHEN NOT reachable AND NOT inbound AND NOT entry THEN IF(standalone, 'reachable', 'unreachable') WHEN NOT reachable AND inbound THEN 'unreachable'
    WHEN reachable AND NOT useful AND NOT effect THEN IF(passive, 'reachable', 'incomplete') ELSE 'reachable' END AS status,
  CASE WHEN element_at(parts, -1) = '__init__.py' THEN 0 WHEN NOT reachable AND NOT inbound AND NOT entry THEN IF(standalone, 0, 100) WHEN NOT reachable AND inbound THEN 80 WHEN reachable AND NOT useful AND NOT effect AND NOT passive THEN 40 ELSE 0 END AS dead_confidence
FROM y""",
        nodes=graph.nodes, known=known, entries=entries, effects=effects, forward=forward, backward=backward,
    )


def connectivity_summary(status: DataFrame) -> DataFrame:
    """How many files are reachable (those that are neither of the others), unreachable and incomplete."""
    count = lambda s: F.count_if(F.col("status") == s)
    return status.agg((F.count(F.lit(1)) - count("unreachable") - count("incomplete")).alias("reachable"), count("unreachable").alias("unreachable"), count("incomplete").alias("incomplete"))


def affinity(graph: CodeGraph) -> DataFrame:
    """a, b, weight of pairs of files: 2 per table in common, 2 per imported pair, 1 for a self-import."""
    return sql(
        graph.nodes.sparkSession,
        """
WITH t AS (SELECT DISTINCT id, tab FROM nodes LATERAL VIEW explode(tables) AS tab WHERE type = 'file'),
i AS (SELECT DISTINCT source AS x, target AS y FROM edges WHERE type = 'import' AND startswith(target, 'file:')),
ways AS (SELECT x, y FROM i UNION SELECT y, x FROM i)
SELECT a, b, sum(w) AS weight FROM (SELECT p.id AS a, q.id AS b, 2.0D AS w FROM t p JOIN t q ON p.tab = q.tab AND p.id < q.id
  UNION ALL SELECT least(x, y), greatest(x, y), 1.0D FROM ways) GROUP BY a, b""",
        nodes=graph.nodes, edges=graph.edges,
    )


def affine(graph: CodeGraph) -> DataFrame:
    """src, dst: links with the components of the affinity: a file and the least file of each of its tables, an importer and the imported. No pairs within a table."""
    return sql(
        graph.nodes.sparkSession,
        """
WITH t AS (SELECT DISTINCT id, tab FROM nodes LATERAL VIEW explode(tables) AS tab WHERE type = 'file'), hub AS (SELECT tab, min(id) AS id FROM t GROUP BY tab)
SELECT hub.id AS src, t.id AS dst FROM t JOIN hub ON hub.tab = t.tab WHERE hub.id <> t.id
UNION SELECT source, target FROM edges WHERE type = 'import' AND startswith(target, 'file:') AND source <> target""",
        nodes=graph.nodes, edges=graph.edges,
    )


def cluster_labels(graph: CodeGraph, merge_singletons: bool = True, resolution: float | None = None) -> DataFrame:
    """id, label and n (files of the label) of every file: the components of the affinity, or its communities where a resolution is given.

    Without any affinity all files have one label; if several files stand alone they have the label ~.
    """
    files = graph.nodes.filter("type = 'file'").select("id")
    links = cut(affine(graph))
    # a file that imports itself has affinity too, with nobody else
    if links.isEmpty() and graph.edges.filter("type = 'import' AND startswith(target, 'file:')").isEmpty():
        label = files.select("id", F.lit("").alias("label"))
    elif resolution is not None:
        label = communities(cut(imported(graph)), files, resolution, members=cut(tabled(graph)))
    else:
        label = components(links, files)
    label = cut(label)
    sized = label.join(label.groupBy("label").agg(F.count(F.lit(1)).alias("n")), "label")
    alone = sized.filter("n = 1").count()
    if merge_singletons and alone > 1:
        sized = sized.select("id", F.when(F.col("n") == 1, "~").otherwise(F.col("label")).alias("label"), F.when(F.col("n") == 1, F.lit(alone)).otherwise(F.col("n")).alias("n"))
    return sized.select("id", "label", "n")


def imported(graph: CodeGraph) -> DataFrame:
    """a, b, weight: the part of the affinity that comes from imports."""
    return sql(graph.nodes.sparkSession, "SELECT DISTINCT least(source, target) AS a, greatest(source, target) AS b, 1.0D AS weight FROM edges WHERE type = 'import' AND startswith(target, 'file:')", edges=graph.edges)


def tabled(graph: CodeGraph) -> DataFrame:
    """tab, id: the tables of every file, from which the rest of the affinity comes."""
    return sql(graph.nodes.sparkSession, "SELECT DISTINCT tab, id FROM nodes LATERAL VIEW explode(tables) AS tab WHERE type = 'file'", nodes=graph.nodes)


#: Rounds without a higher modularity after which a level ends.
STALE = 4


def communities(pairs: DataFrame, nodes: DataFrame, resolution: float = 1.0, rounds: int = 20, members: DataFrame | None = None) -> DataFrame:
    """id, label of communities by modularity, in the manner of Louvain. nodes: id; pairs: a, b, weight (a = b is a loop); members: tab, id.

    Every two members of a tab are linked with weight 2 per tab, but these links are never written: a node's degree follows from the
    sizes of its tabs, its weight to a community from how many members of each of its tabs are there (`here`, a row per tab and
    community). So a tab costs a row per member.

    Nodes move in parallel to the community with the largest gain of modularity (ties: the least label) among those of the nodes they
    are paired with and, for each of their tabs, the one that holds most of it; in a round only one half of the nodes, by a hash that
    changes with the round, may move, so that two do not swap for ever. When no node would gain, or `STALE` rounds have brought nothing,
    communities become nodes, until none joins another. A level whose moves do not raise the modularity is not taken. Every step is an aggregation and an equi-join; a label is the
    least id of its community.
    """
    spark = pairs.sparkSession
    label = cut(nodes.select("id", F.col("id").alias("label")))
    edges = cut(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("weight").cast("double").alias("w")).union(pairs.filter("a <> b").select("b", "a", F.col("weight").cast("double"))))
    mem = members.select("tab", "id").distinct() if members is not None else spark.createDataFrame([], "tab string, id string")
    mem = mem.withColumn("m", F.lit(1).cast("long"))
    mem = cut(mem.join(mem.groupBy("tab").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "tab").select("tab", "id", "m", "size"))
    total = sql(
        spark, "SELECT (SELECT coalesce(sum(IF(src = dst, 2 * w, w)), 0D) FROM edges) + (SELECT coalesce(sum(2D * m * (size - 1)), 0D) FROM mem) AS m2", edges=edges, mem=mem
    ).first()["m2"]
    if not total:
        return label
    while True:
        # weighted degree of each node of this level; loops count twice
        own = cut(
            sql(spark, "SELECT id, id AS c, sum(k) AS k FROM (SELECT src AS id, IF(src = dst, 2 * w, w) AS k FROM edges UNION ALL SELECT id, 2D * m * (size - 1) FROM mem) GROUP BY id", edges=edges, mem=mem)
        )
        quality, _ = _modularity(spark, edges, mem, own.withColumn("gains_some", F.lit(False)), total, resolution)
        best, best_quality, tables, stale = own, quality, [], 0
        for turn in range(rounds):
            moved = cut(
                sql(
                    spark,
                    f"""
WITH sums AS (SELECT c, sum(k) AS k_all FROM own GROUP BY c),
held AS (SELECT m.tab, o.c, sum(m.m) AS n FROM mem m JOIN own o ON o.id = m.id GROUP BY m.tab, o.c),
most AS (SELECT tab, min_by(c, struct(-n, c)) AS c FROM held GROUP BY tab),
paired AS (SELECT e.src AS id, t.c AS d, sum(e.w) AS w FROM edges e JOIN own t ON t.id = e.dst WHERE e.src <> e.dst GROUP BY e.src, t.c),
asked AS (SELECT id, c AS d FROM own UNION SELECT id, d FROM paired UNION SELECT m.id, t.c FROM mem m JOIN most t ON t.tab = m.tab),
ways AS (SELECT id, d, w FROM paired UNION ALL SELECT a.id, a.d, 2D * m.m * h.n FROM asked a JOIN mem m ON m.id = a.id JOIN held h ON h.tab = m.tab AND h.c = a.d
  UNION ALL SELECT m.id, o.c, -2D * m.m * m.m FROM mem m JOIN own o ON o.id = m.id UNION ALL SELECT id, c, 0D FROM own),
gains AS (SELECT x.id, o.c, o.k, x.d, x.w - {resolution}D * o.k * (s.k_all - IF(x.d = o.c, o.k, 0D)) / {total}D AS gain
  FROM (SELECT id, d, sum(w) AS w FROM ways GROUP BY id, d) x JOIN own o ON o.id = x.id JOIN sums s ON s.c = x.d),
to_be AS (SELECT id, c, k, min_by(d, struct(-bround(gain, 9), d)) AS d, max(bround(gain, 9)) > bround(max(IF(d = c, gain, NULL)), 9) AS gains_some FROM gains GROUP BY id, c, k)
SELECT id, IF(gains_some AND pmod(xxhash64(id, {turn}), 2) = 0, d, c) AS c, k, c AS before, gains_some FROM to_be""",
                    own=own, edges=edges, mem=mem,
                )
            )
            own = moved.select("id", "c", "k")
            now, some = _modularity(spark, edges, mem, moved, total, resolution)
            tables.append(moved)
            if now > best_quality + 1e-12:
                release(*tables[:-1])
                best, best_quality, tables, stale = own, now, [moved], 0
            else:
                stale += 1
            if not some or stale == STALE:
                break
        if best_quality <= quality + 1e-12:
            return label
        least = best.groupBy("c").agg(F.min("id").alias("to"))
        renamed = cut(best.join(least, "c").select("id", "to"))
        last, label = label, cut(label.join(renamed.withColumnRenamed("id", "label"), "label", "left").select("id", F.coalesce("to", "label").alias("label")))
        release(last)
        a, b = renamed.select(F.col("id").alias("src"), F.col("to").alias("s")), renamed.select(F.col("id").alias("dst"), F.col("to").alias("d"))
        # both directions of an inner edge add up, so they count half in the loop
        whole = F.when((F.col("s") == F.col("d")) & (F.col("src") != F.col("dst")), F.col("w") / 2).otherwise(F.col("w"))
        last, edges = edges, cut(edges.join(a, "src").join(b, "dst").groupBy(F.col("s").alias("src"), F.col("d").alias("dst")).agg(F.sum(whole).alias("w")))
        older, mem = mem, cut(mem.join(renamed, "id").groupBy("tab", F.col("to").alias("id"), "size").agg(F.sum("m").alias("m")).select("tab", "id", "m", "size"))
        release(last, older, renamed, *tables)


def _modularity(spark: SparkSession, edges: DataFrame, mem: DataFrame, own: DataFrame, total: float, resolution: float) -> tuple[float, int]:
    """The modularity, and how many nodes would gain by a move."""
    found = (
        sql(
            spark,
            f"""SELECT ((SELECT coalesce(sum(IF(e.src = e.dst, 2 * e.w, e.w)), 0D) FROM edges e JOIN own a ON a.id = e.src JOIN own b ON b.id = e.dst WHERE a.c = b.c)
  + (SELECT coalesce(sum(2D * n * (n - 1)), 0D) FROM (SELECT sum(m.m) AS n FROM mem m JOIN own o ON o.id = m.id GROUP BY m.tab, o.c))) / {total}D
  - {resolution}D * (SELECT sum(k_all * k_all) FROM (SELECT sum(k) AS k_all FROM own GROUP BY c)) / ({total}D * {total}D) AS q,
  (SELECT count_if(gains_some) FROM own) AS some""",
            edges=edges, mem=mem, own=own,
        )
    )
    with true_sizes(spark):
        return tuple(found.first())


def clusters(graph: CodeGraph, merge_singletons: bool = True, resolution: float | None = None, utilities: bool = True) -> DataFrame:
    """block, members, shared_tables and shared_imports of the labels, for views; `cluster_labels` has a row per file.

    Blocks are numbered by size and then by least member; the files that stand alone make one block, utilities, the last. As these may be most files
    and a block is one row, that block can be left out.
    """
    labels = cluster_labels(graph, merge_singletons, resolution)
    grouped = cut(labels if utilities else labels.filter("label <> '~'"))
    blocks = grouped.groupBy(F.col("label").alias("g")).agg(F.sort_array(F.collect_list("id")).alias("members"))
    return sql(
        graph.nodes.sparkSession,
        """
WITH shared AS (SELECT g, array_sort(collect_list(tab)) AS shared_tables FROM (SELECT label AS g, tab FROM grouped JOIN (SELECT id AS nid, tab FROM nodes LATERAL VIEW explode(tables) AS tab) ON nid = id GROUP BY label, tab HAVING count(*) >= 2) GROUP BY g),
imports AS (SELECT g, array_sort(collect_list(target)) AS shared_imports FROM (SELECT label AS g, target FROM grouped JOIN edges e ON e.source = id WHERE e.type = 'import' GROUP BY label, target HAVING count(*) >= 2) GROUP BY g)
SELECT IF(b.g = '~', 'block:utilities', concat('block:', b.number - 1)) AS block, members,
  coalesce(s.shared_tables, CAST(array() AS ARRAY<STRING>)) AS shared_tables, coalesce(i.shared_imports, CAST(array() AS ARRAY<STRING>)) AS shared_imports
FROM blocks b LEFT JOIN shared s ON s.g = b.g LEFT JOIN imports i ON i.g = b.g""",
        grouped=grouped, blocks=numbered(blocks, [F.col("g") == "~", -F.size("members"), F.col("members")[0]]), nodes=graph.nodes, edges=graph.edges,
    )


def block_names(blocks: DataFrame) -> DataFrame:
    """block and a name from its commonest directory (half of the files or more) and up to three words of file names that return."""
    return sql(
        blocks.sparkSession,
        f"""
WITH m AS (SELECT block, size(members) AS n, replace(x, 'file:', '') AS path, at FROM blocks LATERAL VIEW posexplode(members) AS at, x),
dirs AS (SELECT block, max_by(dir, struct(c, -first_at)) AS dir, max(c) AS c FROM (SELECT block, element_at(split(path, '/'), -2) AS dir, count(*) AS c, min(at) AS first_at FROM m WHERE contains(path, '/') GROUP BY 1, 2) GROUP BY block),
words AS (SELECT block, w, count(*) AS c, min(struct(at, p)) AS first_at FROM m LATERAL VIEW posexplode(split(replace(replace(element_at(split(path, '/'), -1), '.py', ''), '_', ' '), ' +')) AS p, w
  WHERE length(w) > 2 AND lower(w) NOT IN {STOP_WORDS} GROUP BY block, w),
top AS (SELECT block, array_join(transform(array_sort(collect_list(struct(r, w))), x -> initcap(x.w)), ' + ') AS label FROM (SELECT *, row_number() OVER (PARTITION BY block ORDER BY c DESC, first_at) AS r FROM words) WHERE r <= 3 AND c >= 2 GROUP BY block),
stems AS (SELECT block, max(n) AS n, array_join(transform(array_sort(collect_list(IF(at < 3, struct(at, replace(element_at(split(path, '/'), -1), '.py', '') AS s), NULL))), x -> x.s), ', ') AS stems FROM m GROUP BY block)
SELECT s.block, CASE WHEN s.block = 'block:utilities' THEN 'Utilities / Standalone'
  WHEN d.c >= s.n * 0.5 AND lower(d.dir) NOT IN {STOP_WORDS} THEN concat(initcap(replace(d.dir, '_', ' ')), coalesce(concat(': ', t.label), ''))
  WHEN t.label IS NOT NULL THEN t.label WHEN d.c >= s.n * 0.5 THEN initcap(replace(d.dir, '_', ' ')) ELSE s.stems END AS name
FROM stems s LEFT JOIN dirs d ON d.block = s.block LEFT JOIN top t ON t.block = s.block""",
        blocks=blocks,
    )


TEST_FILE = "(lower(path) RLIKE '/tests/|/__tests__/|/test/' OR lower(element_at(split(path, '/'), -1)) RLIKE '^test_|_test[.]py$|[.]test[.]|[.]spec[.]')"


def view_blocks(blocks: DataFrame, graph: CodeGraph, most: int = 50) -> DataFrame:
    """Blocks as a view shows them: tests apart, blocks under two files left out, blocks over `most` files split by top folder with what is alone in (misc)."""
    return sql(
        blocks.sparkSession,
        f"""
WITH m AS (SELECT b.block, x AS id, replace(x, 'file:', '') AS path FROM blocks b LATERAL VIEW explode(members) AS x),
named AS (SELECT m.*, {TEST_FILE} AS is_test, n.name FROM m JOIN names n ON n.block = m.block),
sized AS (SELECT *, count(*) OVER (PARTITION BY block) AS n, IF(contains(path, '/'), filter(split(path, '/'), p -> p <> '')[0], '(root)') AS dir FROM named WHERE NOT is_test),
split_up AS (SELECT *, count(*) OVER (PARTITION BY block, dir) AS n_dir FROM sized WHERE n >= 2),
shown AS (SELECT IF(n <= {most}, name, concat(name, ' / ', IF(n_dir < 2, '(misc)', dir))) AS name, block, id, false AS is_tests FROM split_up UNION ALL SELECT 'Tests', '', id, true FROM named WHERE is_test)
SELECT name, is_tests, array_sort(collect_list(id)) AS members FROM shown GROUP BY name, block, is_tests""",
        blocks=blocks, names=block_names(blocks), nodes=graph.nodes,
    )


def hotspots(graph: CodeGraph, churn: DataFrame) -> DataFrame:
    """Complexity times churn per file, each over its maximum; complexity alone where there is no churn at all."""
    return sql(
        graph.nodes.sparkSession,
        """
WITH cx AS (SELECT f.path, coalesce(sum(greatest(1, d.complexity)), 1) AS complexity FROM nodes f LEFT JOIN nodes d ON d.path = f.path AND d.type = 'function' WHERE f.type = 'file' GROUP BY f.path),
tops AS (SELECT (SELECT max(complexity) FROM cx) AS max_complexity, (SELECT max(churn) FROM churn) AS max_churn),
both AS (SELECT coalesce(c.path, h.path) AS path, coalesce(c.complexity, 0) AS complexity, coalesce(h.churn, 0) AS churn FROM cx c FULL OUTER JOIN churn h ON h.path = c.path)
SELECT path, complexity, churn, bround(complexity / max_complexity, 3) AS complexity_norm, bround(coalesce(churn / max_churn, 0D), 3) AS churn_norm,
  bround(complexity / max_complexity * IF(max_churn IS NULL, 1D, churn / max_churn), 3) AS score FROM both CROSS JOIN tops""",
        nodes=graph.nodes, churn=churn,
    )


def file_view(graph: CodeGraph) -> DataFrame:
    """Per file: complexity of its direct functions (1 without any), and how many files it imports and is imported by."""
    return sql(
        graph.nodes.sparkSession,
        """
WITH i AS (SELECT DISTINCT source, target FROM edges WHERE type = 'import' AND startswith(target, 'file:') AND source <> target)
SELECT f.path, coalesce(c.complexity, 1) AS complexity, coalesce(o.n, 0) AS n_imports, coalesce(b.n, 0) AS n_imported_by FROM nodes f
LEFT JOIN (SELECT parent_id, sum(complexity) AS complexity FROM nodes WHERE type = 'function' GROUP BY parent_id) c ON c.parent_id = f.id
LEFT JOIN (SELECT source, count(*) AS n FROM i GROUP BY source) o ON o.source = f.id LEFT JOIN (SELECT target, count(*) AS n FROM i GROUP BY target) b ON b.target = f.id WHERE f.type = 'file'""",
        nodes=graph.nodes, edges=graph.edges,
    )


def neighbourhood(graph: CodeGraph) -> DataFrame:
    """Per file the files it imports and those that import it, and a label that tells files of one name apart by their directory."""
    return sql(
        graph.nodes.sparkSession,
        """
WITH i AS (SELECT DISTINCT source, target FROM edges WHERE type = 'import' AND startswith(target, 'file:') AND source <> target),
names AS (SELECT lower(name) AS low, count(*) AS n FROM nodes WHERE type = 'file' GROUP BY lower(name))
SELECT f.path, IF(m.n > 1 AND contains(f.path, '/'), concat(element_at(split(f.path, '/'), -2), '/', f.name), f.name) AS label,
  coalesce(o.list, CAST(array() AS ARRAY<STRING>)) AS imports, coalesce(b.list, CAST(array() AS ARRAY<STRING>)) AS imported_by FROM nodes f JOIN names m ON m.low = lower(f.name)
LEFT JOIN (SELECT source, array_sort(collect_list(substr(target, 6))) AS list FROM i GROUP BY source) o ON o.source = f.id
LEFT JOIN (SELECT target, array_sort(collect_list(substr(source, 6))) AS list FROM i GROUP BY target) b ON b.target = f.id WHERE f.type = 'file'""",
        nodes=graph.nodes, edges=graph.edges,
    )


def block_view(blocks: DataFrame, graph: CodeGraph, findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(per block: files, findings by severity; import edges between blocks)."""
    spark: SparkSession = blocks.sparkSession
    of = cut(sql(spark, "SELECT block, x AS id FROM blocks LATERAL VIEW explode(members) AS x", blocks=blocks))
    totals = sql(
        spark,
        "SELECT o.block, count(DISTINCT o.id) AS files, count_if(f.severity = 'high') AS high, count_if(f.severity = 'med') AS med, count_if(f.severity = 'low') AS low FROM of_block o LEFT JOIN found f ON concat('file:', f.path) = o.id GROUP BY o.block",
        of_block=of, found=findings,
    )
    crossing = sql(spark, "SELECT a.block AS block_a, b.block AS block_b, count(*) AS edges FROM edges e JOIN of_block a ON a.id = e.source JOIN of_block b ON b.id = e.target WHERE e.type = 'import' AND a.block <> b.block GROUP BY 1, 2", of_block=of, edges=graph.edges)
    return totals, crossing
