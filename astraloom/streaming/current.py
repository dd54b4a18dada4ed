"""A code graph and its findings, kept current over changes of files.

What a file says by itself (findings, nodes, raw edges, routes, the names its nodes claim) is computed when its content changes and written
under the version of that update. What a name means depends on all files, so an update asks which names changed hands: the keys that the
changed files claimed or claim, their winners before and now. Only files with an edge to such a name, or to a module whose file came or
went, are resolved again. The state (a row per path: time and digest of its content, the versions of its facts and of its edges) is
replaced at once by a manifest; rows of other versions count for nothing, so an update that dies leaves the state before it, and one
that is run again changes nothing.

Of a path's changes the one with the greatest (at, digest) counts, whatever the order or the batches they come in; a null content deletes
the file, and its row stays so that older changes do not bring it back. Changes without a path, and files that are not Python, are passed
over; a null time is before all others. Only one update may run at a time.

An update parses the changed files alone. It scans the claimed names and the raw edges by the columns it needs, each behind a semi-join with
the few keys in question, and writes the state anew, a short row per file.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from astraloom.functions.syntax import PARSED_AT_ONCE, syntax_rows
from astraloom.functions.tables import cut, dealt, delete, release, sql
from astraloom.operators import code_graph, lint
from astraloom.sources.manifest import read_table, replace_table
from astraloom.sources.tree import described
from astraloom.streaming.watch import CHANGES

STATE = "path string, at timestamp, digest string, facts long, edges long"
#: Tables by the version that says which of their rows count.
FACTS, RESOLVED = ("findings", "nodes", "claims", "raw_edges", "routes"), ("edges",)


class CurrentGraph:
    """Graph and findings of a tree below a folder that driver and executors share; rules: names of lint rules, all by default."""

    def __init__(self, spark: SparkSession, folder: str, rules: list[str] | None = None):
        self.spark, self.folder, self.rules = spark, folder.rstrip("/"), rules

    # -- reading ---------------------------------------------------------------------------------------------------

    def state(self) -> DataFrame:
        found = read_table(self.spark, f"{self.folder}/state", STATE)
        return self.spark.createDataFrame([], STATE) if found is None else found

    def live(self) -> DataFrame:
        return self.state().filter("digest is not null")

    def _stored(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def _of(self, stored: DataFrame, live: DataFrame, by: str = "facts") -> DataFrame:
        """Of stored rows those of the files' versions."""
        versions = live.select("path", F.col(by).alias("version"))
        return stored.join(versions, ["path", "version"], "left_semi").drop("version")

    def _all(self, name: str) -> DataFrame:
        return self._of(self._stored(name), self.live(), "edges" if name in RESOLVED else "facts")

    def findings(self) -> DataFrame:
        return self._all("findings")

    def graph(self) -> code_graph.CodeGraph:
        """As `code_graph.build` has it of the files as they are; raises if there was no update yet."""
        return code_graph.CodeGraph(code_graph.with_related_tables(self._all("nodes")), self._all("raw_edges"), self._all("edges"), self._all("routes"))

    # -- updates ---------------------------------------------------------------------------------------------------

    def _put(self, name: str, version: int, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.folder}/{name}/version={version}")

    def _version(self, state: DataFrame) -> int:
        return state.agg(F.max(F.greatest("facts", "edges"))).first()[0] or 0

    def _winners(self, keys: DataFrame, live: DataFrame) -> DataFrame:
        """key, id of these keys, by the claims of the live files."""
        claims = self._of(self._stored("claims").join(keys, "key", "left_semi"), live)
        return sql(self.spark, code_graph.KEYS, claims=claims)

    def update(self, changes: DataFrame) -> int:
        """Takes in changes (path, content, at); returns how many files' edges were resolved again."""
        state = cut(self.state())
        arrived = cut(self._arrived(changes, state))
        if arrived.isEmpty():
            release(state, arrived)
            return 0
        # a version that was never read by a manifest is written over
        version = self._version(state) + 1
        changed = arrived.filter(~F.col("digest").eqNullSafe(F.col("old")))
        files = cut(described(changed.filter("digest is not null").select("path", "content")))
        if version == 1 or not files.isEmpty():
            self._write_facts(files, version)
        before = cut(state.filter("digest is not null").select("path", "facts"))
        after = cut(before.join(changed, "path", "left_anti").unionByName(files.select("path", F.lit(version).cast("long").alias("facts"))))
        again = cut(self._to_resolve(changed, files, before, after))
        self._put("edges", version, self._resolved(again, after))
        kept = state.join(arrived, "path", "left_anti")
        facts = F.when(~F.col("digest").eqNullSafe(F.col("old")) & F.col("digest").isNotNull(), F.lit(version).cast("long")).otherwise(F.col("facts"))
        rows = kept.unionByName(arrived.select("path", "at", "digest", facts.alias("facts"), "edges")).join(again.withColumn("_again", F.lit(True)), "path", "left")
        rows = rows.withColumn("edges", F.when(F.col("_again"), F.lit(version).cast("long")).otherwise(F.col("edges"))).drop("_again")
        replace_table(rows, f"{self.folder}/state")
        n = again.count()
        release(state, arrived, files, before, after, again)
        return n

    def _arrived(self, changes: DataFrame, state: DataFrame) -> DataFrame:
        """The last change of each path where it is later than what the state has, with what the state has."""
        one = F.max(F.struct("at", F.sha2(F.col("content"), 256).alias("digest"), "content")).alias("one")
        last = changes.filter(F.col("path").endswith(".py")).groupBy("path").agg(one).select("path", "one.*")
        known = state.select("path", F.struct("at", "digest").alias("known"), F.col("digest").alias("old"), "facts", "edges")
        return last.join(known, "path", "left").filter(F.col("known").isNull() | (F.struct("at", "digest") > F.col("known"))).drop("known")

    def _write_facts(self, files: DataFrame, version: int) -> None:
        rows = cut(syntax_rows(dealt(files.select("path", "content"), PARSED_AT_ONCE, "path")))  # sorted by kind within its batches
        nodes, raw, routes = code_graph.facts(rows, files)
        claims = sql(self.spark, code_graph.CLAIMS, nodes=nodes).withColumn("path", F.array_join("seq.parts", "/"))
        for name, frame in zip(FACTS, (lint.findings(rows, files, self.rules), nodes, claims, raw, routes), strict=True):
            self._put(name, version, frame)
        release(rows, nodes, raw, routes)

    def _to_resolve(self, changed: DataFrame, files: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
        """path of the live files whose edges may mean something else now."""
        mine = lambda live: self._of(self._stored("claims"), live.join(changed, "path", "left_semi")).select("key")
        keys = cut(mine(before).unionByName(mine(after)).distinct())
        then, now = self._winners(keys, before), self._winners(keys, after).withColumnRenamed("id", "now")
        moved = then.join(now, "key", "full").filter(~F.col("id").eqNullSafe(F.col("now"))).select(F.col("key").alias("target"))
        stirred = changed.filter(F.col("old").isNull() != F.col("digest").isNull()).select(F.concat(F.lit("file:"), "path").alias("id"))
        modules = self._stored("raw_edges").filter(F.col("target").startswith("module:")).select("target").distinct()
        tried = sql(self.spark, code_graph.TRIES, open_ones=modules).join(stirred, "id", "left_semi").select("target")
        touched = cut(moved.unionByName(tried).distinct())
        users = self._of(self._stored("raw_edges").select("path", "version", "target").join(touched, "target", "left_semi"), after).select("path")
        found = cut(users.unionByName(files.select("path")).distinct())
        release(keys, touched)
        return found

    def _resolved(self, again: DataFrame, after: DataFrame) -> DataFrame:
        raw = cut(self._of(self._stored("raw_edges").join(again, "path", "left_semi"), after))
        keys = cut(self._winners(raw.select(F.col("target").alias("key")).distinct(), after))
        return sql(self.spark, code_graph.RESOLVED, raw_edges=raw, keys=keys, nodes=after.select(F.concat(F.lit("file:"), "path").alias("id")))

    def compact(self) -> None:
        """Writes what counts as one version and deletes the others; frames that were read before are void."""
        state = cut(self.state())
        version = self._version(state) + 1
        for name in (*FACTS, *RESOLVED):
            self._put(name, version, self._all(name))
        one = F.when(F.col("digest").isNotNull(), F.lit(version).cast("long"))
        replace_table(state.withColumns({"facts": one, "edges": one}), f"{self.folder}/state")
        for name in (*FACTS, *RESOLVED):
            for old in {os.path.dirname(f) for f in self._stored(name).inputFiles()}:  # a folder an update
                if not old.endswith(f"/version={version}"):
                    delete(self.spark, old)
        release(state)


def keep_current(current: CurrentGraph, folder: str, checkpoint: str, ended: Callable[[int], None] | None = None) -> StreamingQuery:
    """Takes in Parquet files of changes (path, content, at) as they come; `ended` is told after each batch how many files were resolved again."""

    def each(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        try:
            n = CurrentGraph(batch.sparkSession, current.folder, current.rules).update(held)  # a stream has a session of its own
        finally:
            held.unpersist()
        if ended:
            ended(n)

    stream = current.spark.readStream.schema(CHANGES).parquet(folder)
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
