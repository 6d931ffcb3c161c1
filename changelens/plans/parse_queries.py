"""Source parsing: sources, scripts and diffs written from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changelens.functions import parse as P
from changelens.functions.scripts import script_parsed
from changelens.plans.registry import query
from changelens.sources.tables import load


def _modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small Python module for every part."""
    k = F.col("p_partkey").cast("string")
    word = F.element_at(F.split("p_name", " "), 1)
    text = F.concat(
        F.lit("import os\nfrom pkg."), word, F.lit(" import a, b\n\nclass C"), k, F.lit(":\n    def run(self):\n        if self.x and self.y:\n            return os.path.join('"), word, F.lit("')\n\ndef _hidden():\n    return C"), k,
        F.lit("()\n"), F.when(F.col("p_size") > 45, F.lit("def broken(:\n")).otherwise(F.lit("")),
    )
    return load(spark, sf_dir, "part").select(F.col("p_partkey").alias("file_id"), text.alias("content"))


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _modules(spark, sf_dir).select("file_id", P.python_parsed(F.col("content")).alias("p")).select("file_id", "p.*")


_WORD = "string_split(p_name, ' ')[1]"


@query("py_parse", "SELECT p_partkey AS file_id, (CASE WHEN p_size > 45 THEN 0 ELSE 2 END)::INTEGER AS imports, (CASE WHEN p_size > 45 THEN 0 ELSE 3 END)::INTEGER AS symbols, (CASE WHEN p_size > 45 THEN 0 ELSE 2 END)::INTEGER AS calls, p_size > 45 AS failed FROM part")
def py_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir).select("file_id", F.size("imports").alias("imports"), F.size("symbols").alias("symbols"), F.size("calls").alias("calls"), F.col("error").isNotNull().alias("failed"))


@query("py_imports", f"SELECT p_partkey AS file_id, 'os' AS module, '' AS names, 1 AS line FROM part WHERE p_size <= 45 UNION ALL SELECT p_partkey, 'pkg.' || {_WORD}, 'a,b', 2 FROM part WHERE p_size <= 45")
def py_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = _parsed(spark, sf_dir).select("file_id", F.explode("imports").alias("i"))
    return each.select("file_id", "i.module", F.array_join("i.names", ",").alias("names"), "i.line")


@query(
    "py_symbols",
    "SELECT p_partkey AS file_id, q AS qualified, kind, s AS start_line, e AS end_line FROM part, LATERAL (VALUES ('C' || p_partkey, 'class', 4, 7), ('C' || p_partkey || '.run', 'method', 5, 7), ('_hidden', 'function', 9, 10)) v(q, kind, s, e) WHERE p_size <= 45",
)
def py_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = _parsed(spark, sf_dir).select("file_id", F.explode("symbols").alias("s"))
    return each.select("file_id", "s.qualified", "s.kind", "s.start_line", "s.end_line")


@query("py_exports", "SELECT p_partkey AS file_id, 'C' || p_partkey AS name FROM part WHERE p_size <= 45")
def py_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir).select("file_id", F.explode("exports").alias("name"))


@query("py_calls", "SELECT p_partkey AS file_id, c AS callee, s AS scope FROM part, LATERAL (VALUES ('os.path.join', 'C' || p_partkey || '.run'), ('C' || p_partkey, '_hidden')) v(c, s) WHERE p_size <= 45")
def py_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir).select("file_id", F.explode("calls").alias("c")).select("file_id", "c.callee", "c.scope")


@query("py_complexity", "SELECT p_partkey AS file_id, CASE WHEN p_size > 45 THEN 0 ELSE 2 END::BIGINT AS branches, CASE WHEN p_size > 45 THEN 0 ELSE 2 END::BIGINT AS functions, CASE WHEN p_size > 45 THEN 0 ELSE 1 END::BIGINT AS nesting FROM part")
def py_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _modules(spark, sf_dir).select("file_id", P.python_complexity(F.col("content")).alias("c")).select("file_id", "c.*")


def _scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small script for every part, in three forms: a module, a class over CommonJS, tests."""
    k = F.col("p_partkey").cast("string")
    word = F.element_at(F.split("p_name", " "), 1)
    module = F.concat(
        F.lit("import React, { useState as use } from 'react';\nimport x from \"./"), word, F.lit("\";\nimport * as ns from './ns'\nexport const run"), k, F.lit(" = async (a) => a / 2;\nexport default class W"), k,
        F.lit(" {}\n// import no from 'no'\nfunction go() {\n  return ns.call(1)\n}\nexport { go, x as z };\n"),
    )
    common = F.concat(
        F.lit("const y = require('../y"), k, F.lit("');\nclass C"), k, F.lit(" extends B {\n  constructor(a) {\n    super(a);\n  }\n  static async "), word,
        F.lit("(a, b) {\n    const s = \"function no() {}\";\n    return y(a).then(1)\n  }\n}\nconst make = function () {\n};\n"),
    )
    tests = F.concat(F.lit("/* class No {} */\nimport { a, b } from '../"), word, F.lit("';\ndescribe('"), word, F.lit("', () => {\n  it('x', () => { expect(a("), k, F.lit(")); });\n});\nconst testAll = x => { b() };\n"))
    form = F.col("p_partkey") % 3
    return load(spark, sf_dir, "part").select(F.col("p_partkey").alias("file_id"), F.when(form == 0, module).when(form == 1, common).otherwise(tests).alias("content"))


def _script_rows(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    parsed = _scripts(spark, sf_dir).select("file_id", script_parsed(F.col("content")).alias("p"))
    return parsed.select("file_id", F.explode(f"p.{name}").alias("x")).select("file_id", "x.*")


_FORM = f"p AS (SELECT p_partkey AS file_id, p_partkey % 3 AS form, p_partkey::VARCHAR AS k, {_WORD} AS word FROM part)"


@query(
    "js_imports",
    f"""WITH {_FORM} SELECT file_id, module, names, alias, line, kind FROM p, LATERAL (VALUES (0, 'react', 'useState', NULL, 1, 'es_import'), (0, './' || word, 'x', 'x', 2, 'es_import'), (0, './ns', 'ns', NULL, 3, 'es_import'),
      (1, '../y' || k, '', 'y', 1, 'require'), (2, '../' || word, 'a,b', NULL, 2, 'es_import')) v(f, module, names, alias, line, kind) WHERE f = form""",
)
def js_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _script_rows(spark, sf_dir, "imports").withColumn("names", F.array_join("names", ","))


@query(
    "js_exports",
    f"""WITH {_FORM} SELECT file_id, name, line, kind, confidence::DOUBLE AS confidence FROM p, LATERAL (VALUES (0, 'run' || k, 4, 'export', 1), (0, 'W' || k, 5, 'export', 1), (0, 'go', 10, 'export', 1), (0, 'x', 10, 'export', 1),
      (2, 'describe', 3, 'test_block', 0.7), (2, 'it', 4, 'test_block', 0.7), (2, 'expect', 4, 'test_block', 0.7)) v(f, name, line, kind, confidence) WHERE f = form""",
)
def js_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _script_rows(spark, sf_dir, "exports")


@query(
    "js_parse",
    f"""WITH {_FORM} SELECT file_id, qualified, kind, start_line, end_line, is_test FROM p, LATERAL (VALUES (0, 'run' || k, 'function', 4, 4, false), (0, 'W' || k, 'class', 5, 5, false), (0, 'go', 'function', 7, 9, false),
      (1, 'C' || k, 'class', 2, 10, false), (1, 'C' || k || '.constructor', 'method', 3, 5, false), (1, 'C' || k || '.' || word, 'method', 6, 9, false), (1, 'make', 'function', 11, 12, false), (2, 'testAll', 'function', 6, 6, true)) v(f, qualified, kind, start_line, end_line, is_test) WHERE f = form""",
)
def js_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _script_rows(spark, sf_dir, "symbols").select("file_id", "qualified", "kind", "start_line", "end_line", "is_test")


@query(
    "js_calls",
    f"""WITH {_FORM} SELECT file_id, callee, scope, line FROM p, LATERAL (VALUES (0, 'ns.call', NULL, 8), (1, 'require', NULL, 1), (1, 'y', 'C' || k, 8), (2, 'describe', NULL, 3), (2, 'it', NULL, 4), (2, 'expect', NULL, 4), (2, 'a', NULL, 4), (2, 'b', NULL, 6)) v(f, callee, scope, line) WHERE f = form""",
)
def js_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _script_rows(spark, sf_dir, "calls").select("file_id", "callee", "scope", "line")


def _diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A diff for every order: a hunk per line, and a deleted, an added and a renamed file."""
    hunk = F.concat(F.lit("@@ -1,2 +"), F.col("l_partkey") % 90 + 1, F.lit(","), (F.col("l_quantity").cast("bigint") % 6), F.lit(" @@"))
    hunks = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_list(hunk)), "\n").alias("hunks"))
    k = F.col("l_orderkey").cast("string")
    text = F.concat(
        F.lit("diff --git a/src/f"), k, F.lit(".py b/src/f"), k, F.lit(".py\n"), F.col("hunks"), F.lit("\ndiff --git a/gone.py b/gone.py\ndeleted file mode 100644\n@@ -1,3 +0,0 @@\ndiff --git a/new.py b/new.py\nnew file mode 100644\n@@ -0,0 +1,2 @@\ndiff --git a/old.py b/moved.py\nrename from old.py\nrename to moved.py\n")
    )
    return hunks.select(F.col("l_orderkey").alias("diff_id"), text.alias("text"))


_HUNKS = "h AS (SELECT l_orderkey AS diff_id, l_partkey % 90 + 1 AS s, l_quantity::BIGINT % 6 AS n FROM lineitem)"
_REST = "(VALUES (1, 'gone.py', 'deleted', 0, 0), (2, 'new.py', 'added', 1, 3), (3, 'moved.py', 'renamed', 0, 0)) v(seq, path, change_type, ranges, total)"


@query(
    "diff_parse",
    f"""WITH {_HUNKS} SELECT diff_id, 0 AS seq, 'src/f' || diff_id || '.py' AS path, 'modified' AS change_type, count(*) FILTER (WHERE n > 0)::INTEGER AS ranges, coalesce(sum(s + s + n - 1) FILTER (WHERE n > 0), 0)::BIGINT AS total FROM h GROUP BY diff_id
    UNION ALL SELECT diff_id, seq, path, change_type, ranges, total FROM (SELECT DISTINCT diff_id FROM h), {_REST}""",
)
def diff_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = F.aggregate("ranges", F.lit(0).cast("bigint"), lambda s, r: s + r["start"] + r["end"])
    return P.parse_diffs(_diffs(spark, sf_dir)).select("diff_id", "seq", "path", "change_type", F.size("ranges").alias("ranges"), total.alias("total"))


@query(
    "diff_parse_merged",
    f"""WITH {_HUNKS}, k AS (SELECT diff_id, s, s + n - 1 AS e FROM h WHERE n > 0), m AS (SELECT *, max(e) OVER (PARTITION BY diff_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS most FROM k),
    i AS (SELECT diff_id, count(*) FILTER (WHERE most IS NULL OR s > most + 1)::INTEGER AS n FROM m GROUP BY diff_id)
    SELECT diff_id, 0 AS seq, coalesce(i.n, 0) AS ranges FROM (SELECT DISTINCT diff_id FROM h) LEFT JOIN i USING (diff_id) UNION ALL SELECT diff_id, seq, ranges FROM (SELECT DISTINCT diff_id FROM h), {_REST}""",
)
def diff_parse_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.parse_diffs(_diffs(spark, sf_dir), merged=True).select("diff_id", "seq", F.size("ranges").alias("ranges"))
