"""Source trees, commit logs, configuration, baselines and notes as DataFrames."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import NamedTuple

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, InputPartition, StringEndsWith, StringStartsWith

from astraloom.sources import manifest

#: Directories that are left out.
EXCLUDED = ("venv", ".venv", "node_modules", "__pycache__", ".git", "dist", "build", ".egg-info", ".tox", ".mypy_cache", ".pytest_cache", "BAD")
JS_EXCLUDED = ("node_modules", "dist", "build", ".next", ".nuxt", "out", "coverage", ".git", "venv", ".venv", "__pycache__", "vendor")
JS_SUFFIXES = (".js", ".jsx", ".mjs", ".cjs", ".ts", ".tsx")
CONFIG_NAME = ".astraloom.json"


def n_lines(content: Column) -> Column:
    """Lines as splitlines counts them: a final line break ends a line and starts none."""
    parts = F.split(content, "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085  ]")
    return F.when(content == "", 0).otherwise(F.size(parts) - F.when(F.element_at(parts, -1) == "", 1).otherwise(0))


def described(files: DataFrame) -> DataFrame:
    """path, content with parts, stem, n_lines and lang."""
    name = F.element_at("parts", -1)
    return files.withColumn("parts", F.split("path", "/")).select(
        "path", "parts", F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), "content", n_lines(F.col("content")).cast("int").alias("n_lines"),
        F.when(F.endswith("path", F.lit(".py")), "python").otherwise("javascript").alias("lang"),
    )


#: Folders that are listed before the tasks begin, bytes and files of a task, threads that list.
FOLDERS, BYTES, FILES, THREADS = 4096, 64 << 20, 2000, 16
#: Tasks that walk the folders that are left, one folder each at least, and folders that one of them begins with, at most.
WALKERS, WALKED = 128, 128
#: Files and bytes of a batch of rows.
ROWS, BATCH = 1000, 4 << 20


class Unit(NamedTuple):
    """A file, or a folder that a task still has to walk; for which languages it is wanted."""

    path: str
    folder: bool
    python: bool
    script: bool
    size: int


class Part(InputPartition):
    def __init__(self, units: list[Unit]):
        super().__init__(len(units))
        self.units = units


class TreeReader(DataSourceReader):
    """Walks a tree level by level; excluded folders are not entered, so nothing in them is listed or opened.

    The driver lists up to `FOLDERS` folders, whole levels in threads, and packs the files by bytes; folders that are left then are
    dealt to tasks, which walk them. Filters on the path that say how it begins or ends, or what it is, are taken: they prune folders too.
    """

    def __init__(self, options: dict[str, str]):
        root = options["path"]
        self.uri = root if "://" in root else f"file://{os.path.abspath(root)}"
        self.exclude = frozenset(x for x in options.get("exclude", "\n".join(EXCLUDED)).split("\n") if x)
        self.script = options.get("scripts", "true") == "true"
        self.begin, self.ends = "", [""]

    def pushFilters(self, filters):
        for f in filters:
            column, value = getattr(f, "attribute", None), getattr(f, "value", None)
            if column == ("path",) and isinstance(value, str) and isinstance(f, (EqualTo, StringStartsWith, StringEndsWith)):
                if not isinstance(f, StringEndsWith):
                    self.begin = max(self.begin, value, key=len)
                if not isinstance(f, StringStartsWith):
                    self.ends.append(value)
            yield f  # Spark asks again: a longer beginning may have been kept

    def store(self) -> tuple[pa.fs.FileSystem, str]:
        return pa.fs.FileSystem.from_uri(self.uri)

    def children(self, fs: pa.fs.FileSystem, top: str, unit: Unit) -> list[Unit]:
        """What a folder holds and is wanted; on a local disk symbolic links to folders are not followed."""
        local, found = isinstance(fs, pa.fs.LocalFileSystem), []
        for x in fs.get_file_info(pa.fs.FileSelector(unit.path, allow_not_found=True)):
            inner = os.path.relpath(x.path, top)
            if x.type == pa.fs.FileType.Directory:
                python = unit.python and x.base_name not in self.exclude
                script = unit.script and x.base_name not in JS_EXCLUDED and not x.base_name.startswith(".")
                near = self.begin.startswith(inner + "/") or (inner + "/").startswith(self.begin)
                if (python or script) and near and not (local and os.path.islink(x.path)):
                    found.append(Unit(x.path, True, python, script, 0))
            elif x.type == pa.fs.FileType.File and inner.startswith(self.begin) and all(inner.endswith(e) for e in self.ends):
                if unit.python and inner.endswith(".py") or unit.script and inner.endswith(JS_SUFFIXES):
                    found.append(Unit(x.path, False, unit.python, unit.script, x.size or 0))
        return found

    def partitions(self) -> list[Part]:
        fs, top = self.store()
        level, files, listed = [Unit(top, True, True, self.script, 0)], [], 0
        with ThreadPoolExecutor(THREADS) as pool:
            while level and listed + len(level) <= FOLDERS:
                listed += len(level)
                found = [x for group in pool.map(lambda u: self.children(fs, top, u), level) for x in group]
                files += (x for x in found if not x.folder)
                level = [x for x in found if x.folder]
        walkers = max(min(len(level), WALKERS), -(-len(level) // WALKED))
        parts, now, size = [level[k::walkers] for k in range(walkers)], [], 0
        for x in sorted(files):
            if now and (size + x.size > BYTES or len(now) >= FILES):
                parts.append(now)
                now, size = [], 0
            now.append(x)
            size += x.size
        return [Part(p) for p in (*parts, now)]

    def opened(self, fs: pa.fs.FileSystem, path: str) -> bytes:
        with fs.open_input_stream(path) as f:
            return f.read()

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        fs, top = self.store()
        todo, size, paths, texts = list(reversed(part.units)), 0, [], []
        rows = lambda: pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(texts, pa.string())], names=["path", "content"])
        while todo:
            x = todo.pop()
            if x.folder:
                todo += sorted(self.children(fs, top, x), reverse=True)
                continue
            data = self.opened(fs, x.path)
            if paths and (len(paths) == ROWS or size + len(data) > BATCH):
                yield rows()
                size, paths, texts = 0, [], []
            paths.append(os.path.relpath(x.path, top))
            texts.append(data.decode("utf-8", "replace"))
            size += len(data)
        if paths:
            yield rows()


class TreeSource(DataSource):
    """path (relative to the root), content of the Python and JavaScript files of a tree; options path, exclude (names by line), scripts."""

    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return "path string, content string"

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)


def read_tree(spark: SparkSession, root: str, exclude: tuple[str, ...] = EXCLUDED, scripts: bool = True) -> DataFrame:
    """path (relative), content of every Python and JavaScript file below root that some stage may want; bytes that are not UTF-8 become U+FFFD.

    Spark's own readers leave out names that begin with an underscore or a dot and files without a byte, and enter every folder.
    exclude: names of folders, those with a slash are left to `select_files`.
    """
    spark.dataSource.register(TreeSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    plain = "\n".join(e.rstrip("/") for e in exclude if "/" not in e.rstrip("/"))
    return spark.read.format(TreeSource.name()).option("exclude", plain or "\n").option("scripts", str(scripts).lower()).load(root)


def write_tree(files: DataFrame, root: str) -> None:
    """Writes every file (path, content) below root, each by the task that holds it; a task that runs again writes the same."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = pa.fs.FileSystem.from_uri(root)
        for batch in batches:
            paths = batch.column(0).to_pylist()
            for folder in sorted(set(map(os.path.dirname, paths))):
                fs.create_dir(f"{top}/{folder}", recursive=True)
            for path, content in zip(paths, batch.column(1).to_pylist(), strict=True):
                with fs.open_output_stream(f"{top}/{path}") as out:
                    out.write((content or "").encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    files.select("path", "content").mapInArrow(run, "n long").agg(F.sum("n")).collect()


def ignored_names(spark: SparkSession, root: str) -> list[str]:
    """Names of .gitignore: lines that are no comment, without a final slash; a file is ignored if a part of its path equals one."""
    fs, top = pa.fs.FileSystem.from_uri(root if "://" in root else f"file://{os.path.abspath(root)}")
    path = f"{top}/.gitignore"
    if fs.get_file_info(path).type != pa.fs.FileType.File:
        return []
    with fs.open_input_stream(path) as f:
        lines = f.read().decode("utf-8", "replace").splitlines()
    return [x.rstrip("/") for x in map(str.strip, lines) if x and not x.startswith("#")]


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def select_files(files: DataFrame, stage: str, exclude: tuple[str, ...] = EXCLUDED, ignored: tuple[str, ...] = ()) -> DataFrame:
    """The files a stage works on. `map` and `lint` take Python and skip -OFF.py; only `map` honours ignored names and excludes with a slash; `js` takes JavaScript but no declarations."""
    parts = F.split("path", "/")
    folders = F.slice(parts, 1, F.size(parts) - 1)
    plain = [e.rstrip("/") for e in exclude if "/" not in e.rstrip("/")]
    if stage == "js":
        hidden = F.exists(folders, lambda p: F.startswith(p, F.lit(".")))
        return files.filter(F.col("path").rlike(r"\.(js|jsx|mjs|cjs|ts|tsx)$") & ~F.endswith("path", F.lit(".d.ts")) & ~F.arrays_overlap(folders, _array((*plain, *JS_EXCLUDED))) & ~hidden)
    keep = F.endswith("path", F.lit(".py")) & ~F.endswith("path", F.lit("-OFF.py")) & ~F.arrays_overlap(folders, _array(tuple(plain)))
    if stage == "map":
        for e in exclude:
            if "/" in e:
                keep = keep & ~F.startswith("path", F.lit(e.rstrip("/")))
        if ignored:
            keep = keep & ~F.arrays_overlap(parts, _array(tuple(ignored)))
    return files.filter(keep)


def _array(words: tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")


def load_config(path: str) -> dict:
    """A configuration file as a dict; what cannot be read gives {}."""
    try:
        with open(path, encoding="utf-8") as f:
            found = json.load(f)
        return found if isinstance(found, dict) else {}
    except (OSError, ValueError):
        return {}


def churn(commits: DataFrame, now: Column | None = None, days: int = 180) -> DataFrame:
    """commits: commit_id, ts, path. Commits per Python file within the window."""
    since = (now if now is not None else F.current_timestamp()) - F.make_interval(days=F.lit(days))
    return commits.filter((F.col("ts") >= since) & F.endswith("path", F.lit(".py"))).groupBy("path").agg(F.count(F.lit(1)).alias("churn"))


#: Columns of saved findings.
FINDING = "tier string, path string, line long, rule string, severity string, symbol string"


def read_baseline(spark: SparkSession, path: str) -> DataFrame | None:
    """Findings saved earlier, by `save_baseline` or as a folder of Parquet, or None."""
    saved = manifest.read_table(spark, path, FINDING)
    return saved if saved is not None else spark.read.parquet(path) if _exists(spark, path) else None


def save_baseline(found: DataFrame, path: str) -> None:
    """Findings in place of those saved earlier, which stay readable until all of these are written."""
    columns = [x.split()[0] for x in FINDING.split(", ")]
    manifest.replace_table(found.select(*(F.col(c).cast("long") if c == "line" else F.col(c) for c in columns)), path)


def done_items(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a notes file that claim something is done."""
    return spark.read.text(path).filter(F.col("value").rlike(r"\*\*DONE\*\*|✅|FIXED")).select(F.trim("value").alias("item"))
