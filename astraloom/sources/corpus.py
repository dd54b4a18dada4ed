"""Code corpora made of the driver's tables, so that what a query must find follows from key arithmetic alone.

`snippet_files`: a module per part; the key picks a family of `snippets` and one of its variants.
`project_files`: a module per supplier, all of one project that imports, calls, routes and stores by the key's digits.
`commits`: the orders as a commit log over the project's files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from astraloom.functions.syntax import PARSED_AT_ONCE, syntax_rows
from astraloom.functions.tables import written
from astraloom.sources.snippets import FAMILIES, JS_FAMILIES, js_variants, variants
from astraloom.sources.tree import described

N = len(FAMILIES)
SNIPPET_PATH = "concat('pkg', p_partkey % 7, '/m', p_partkey, '.py')"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keys_of(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """The keys of a table, dealt to all tasks: a table of keys is one small file, and what is made of a key is many times its size."""
    return read(spark, sf_dir, name).select(key).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))


def snippet_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = spark.createDataFrame([(i, j, s.text) for i, v in enumerate(variants()) for j, s in enumerate(v)], "family int, variant int, content string")
    keys = keys_of(spark, sf_dir, "part", "p_partkey").select("p_partkey", (F.col("p_partkey") % N).cast("int").alias("family"), (F.floor(F.col("p_partkey") / N) % 3).cast("int").alias("variant"))
    found = keys.join(F.broadcast(texts), ["family", "variant"])  # three texts per family
    return described(found.select(F.expr(SNIPPET_PATH).alias("path"), "content"))


def expected(rule: str) -> str:
    """DuckDB SQL for path, line, symbol of a rule over the snippets, from the keys."""
    rows = [f"({i}, {j}, {line}, '{symbol}')" for i, v in enumerate(variants()) for j, s in enumerate(v) for line, name, symbol in s.findings if name == rule]
    if not rows:
        return "SELECT ''::VARCHAR AS path, 0::BIGINT AS line, ''::VARCHAR AS symbol WHERE false"
    return f"SELECT {SNIPPET_PATH} AS path, v.line::BIGINT AS line, replace(v.symbol, '{{path}}', {SNIPPET_PATH}) AS symbol FROM part JOIN (VALUES {', '.join(rows)}) v(family, variant, line, symbol) ON p_partkey % {N} = v.family AND (p_partkey // {N}) % 3 = v.variant"


N_JS = len(JS_FAMILIES)
JS_PATH = f"concat('web/', CASE WHEN s_suppkey % 3 = 0 THEN 'tests/' ELSE '' END, 'm', s_suppkey, '.js')"
JS_KEYS = (f"s_suppkey % {N_JS}", f"s_suppkey // {N_JS} % 2")


def js_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JavaScript module per supplier; a third of them are tests."""
    texts = spark.createDataFrame([(i, j, s.text) for i, v in enumerate(js_variants()) for j, s in enumerate(v)], "family int, variant int, content string")
    keys = read(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") % N_JS).cast("int").alias("family"), (F.floor(F.col("s_suppkey") / N_JS) % 2).cast("int").alias("variant"))
    return keys.join(F.broadcast(texts), ["family", "variant"]).select(F.expr(JS_PATH).alias("path"), "content")  # two texts per family


def expected_js() -> str:
    """DuckDB SQL for path, line, rule, symbol of all JavaScript rules, from the keys."""
    rows = [f"({i}, {j}, {line}, '{name}', '{symbol}')" for i, v in enumerate(js_variants()) for j, s in enumerate(v) for line, name, symbol in s.findings]
    return f"SELECT {JS_PATH} AS path, v.line::BIGINT AS line, v.rule, v.symbol FROM supplier JOIN (VALUES {', '.join(rows)}) v(family, variant, line, rule, symbol) ON {JS_KEYS[0]} = v.family AND {JS_KEYS[1]} = v.variant WHERE NOT (v.rule = 'JS_CONSOLE_LOG' AND s_suppkey % 3 = 0)"


#: A script ends at its end tag, whatever stands in its strings, or with the page.
SCRIPT = r"(?is)<script(?:\s[^>]*)?>(.*?)(?:</script|\z)"


def page_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JavaScript module per script of a page, in page order: pageN.js, pageN-2.js and so on."""
    scripts = read(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(SCRIPT), F.lit(1))).alias("at", "content"))
    more = F.when(F.col("at") > 0, F.concat(F.lit("-"), F.col("at") + 1)).otherwise("")
    return scripts.select(F.concat(F.lit("page"), "page_id", more, F.lit(".js")).alias("path"), "content")


#: Where the scan looks: one in four paths lies in a left-out folder, is switched off, or is ignored.
SCAN_PATH = "concat(CASE p_partkey % 8 WHEN 0 THEN 'venv/' WHEN 1 THEN 'src/build/' WHEN 2 THEN 'gen/' WHEN 3 THEN 'web/' ELSE 'src/' END, 'f', p_partkey, CASE p_partkey % 5 WHEN 0 THEN '-OFF.py' WHEN 1 THEN '.js' WHEN 2 THEN '.d.ts' ELSE '.py' END)"


def scan_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.expr(SCAN_PATH).alias("path"), F.lit("pass\n").alias("content"))


def _module(k: str) -> str:
    return f"concat('app.g', ({k}) % 5, '.mod', {k})"


K, R = "s_suppkey", "s_suppkey % 10"
PROJECT_PATH = f"concat('app/g', {K} % 5, '/mod', {K}, '.py')"
#: Whose function a module's own function calls: the next of its trio or pair.
NEXT = f"CASE WHEN {R} IN (1, 2, 5, 7) THEN {K} + 1 WHEN {R} = 3 THEN {K} - 2 WHEN {R} = 6 THEN {K} - 1 END"
LINES = (
    f"""concat('\"\"\"Module ', {K}, '.\"\"\"')""",
    f"CASE WHEN {R} IN (1, 3, 5, 6, 7) THEN concat('from ', {_module(NEXT)}, ' import work_', {NEXT}) WHEN {R} = 2 THEN concat('import ', {_module(NEXT)}) ELSE 'pass' END",
    f"concat('LIMIT_', {K}, ' = ', {K})",
    f"CASE WHEN {R} = 1 THEN concat('@app.get(\"/m/', {K}, '\")') ELSE '@plain' END",
    f"concat('def work_', {K}, '(a):')",
    f"CASE WHEN {R} IN (1, 3, 5, 6) THEN concat('    return work_', {NEXT}, '(a)') WHEN {R} = 2 THEN concat('    return mod.work_', {NEXT}, '(a)') ELSE '    return a' END",
    f"CASE WHEN {R} = 3 THEN concat('class Model_', {K}, '(Base):') ELSE concat('class Plain_', {K}, '(Root_', {K} % 3, '):') END",
    f"CASE WHEN {R} IN (3, 4) THEN concat('    __tablename__ = \"t', CAST(floor({K} / 20) AS BIGINT), '\"') ELSE concat('    size = ', {K}) END",
    "'    def save(self, value):'",
    f"concat('        total = value + ', {K} % 4, ' + 1000000')",
    "'        return (value, total, total)'",
    f"concat('TOTAL = helper_', CAST(floor({K} / 50) AS BIGINT), '()')",
    f"CASE WHEN {K} % 50 = 4 THEN concat('def helper_', CAST(floor({K} / 50) AS BIGINT), '():') ELSE concat('def other_', {K}, '():') END",
    "'    return 1'",
)


def project_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "concat_ws('\\n', " + ", ".join(LINES) + ", '')"
    return described(keys_of(spark, sf_dir, "supplier", "s_suppkey").select(F.expr(PROJECT_PATH).alias("path"), F.expr(text).alias("content")))


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is a commit that touches one file: that of its key modulo the number of suppliers, plus one."""
    n = F.broadcast(read(spark, sf_dir, "supplier").agg(F.count(F.lit(1)).alias("n")))  # one row
    keyed = read(spark, sf_dir, "orders").join(n).select(F.col("o_orderkey").cast("string").alias("commit_id"), F.col("o_orderdate").alias("ts"), (F.col("o_orderkey") % F.col("n") + 1).alias("s_suppkey"))
    return keyed.select("commit_id", "ts", F.expr(PROJECT_PATH).alias("path"))


_KEPT: dict[tuple[str, str], tuple[DataFrame, DataFrame]] = {}
_FILES: dict[tuple[str, str], DataFrame] = {}


def files_of(spark: SparkSession, sf_dir: str, which: str = "snippets", make=None) -> DataFrame:
    """The files of a corpus, described once per session; `make` gives path and content of one that is not known by its name."""
    key = (f"{spark.sparkContext.applicationId}:{which}", sf_dir)
    if key not in _FILES:
        files = {"snippets": snippet_files, "project": project_files}[which](spark, sf_dir) if make is None else described(make(spark, sf_dir))
        _FILES[key] = written(files.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path"), "files")  # one file of a table is one partition otherwise
    return _FILES[key]


def rows_of(files: DataFrame) -> DataFrame:
    """The syntax rows of files as a table.

    The number of tasks grows with that of the files, as a table of short and similar texts is a few MB, which Spark would read in one task a core. Rows lie
    sorted by kind within a batch of the parse, so a rule's filter on kinds skips most pages; sorting whole partitions would spill every row.
    """
    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = files.select("path", "content").repartition(max(tasks, files.count() // PARSED_AT_ONCE), "path")
    return written(syntax_rows(dealt), "rows")


def parsed(spark: SparkSession, sf_dir: str, which: str = "snippets", make=None) -> tuple[DataFrame, DataFrame]:
    """(rows, files) of a corpus, parsed once per session into tables."""
    key = (f"{spark.sparkContext.applicationId}:{which}", sf_dir)
    if key not in _KEPT:
        files = files_of(spark, sf_dir, which, make)
        _KEPT[key] = rows_of(files), files
    return _KEPT[key]
