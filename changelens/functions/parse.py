"""Source parsing. Syntax trees need Python; each parser is one Arrow batch function that
Spark runs over the contents, and everything after it is DataFrame work."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PARSED = (
    "imports array<struct<module: string, names: array<string>, level: int, alias: string, line: int>>, "
    "exports array<string>, "
    "symbols array<struct<qualified: string, name: string, kind: string, start_line: int, end_line: int>>, "
    "calls array<struct<callee: string, scope: string, line: int>>, error string"
)
_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)


def _dotted(node: ast.AST) -> str | None:
    names = []
    while isinstance(node, ast.Attribute):
        names.append(node.attr)
        node = node.value
    if not isinstance(node, ast.Name):
        return names[0] if names else None
    return ".".join([node.id, *reversed(names)])


def parse_python(text: str | None) -> dict:
    """Imports, exports, symbols and calls of a module; a syntax error is data."""
    out: dict = {"imports": [], "exports": [], "symbols": [], "calls": [], "error": None}
    try:
        tree = ast.parse(text or "")
    except (SyntaxError, ValueError, RecursionError) as e:
        out["error"] = type(e).__name__
        return out
    declared: list[str] | None = None
    todo: list[tuple[ast.AST, tuple[str, ...]]] = [(n, ()) for n in reversed(tree.body)]
    while todo:
        node, scope = todo.pop()
        inner, children = scope, list(ast.iter_child_nodes(node))
        if isinstance(node, ast.Import):
            out["imports"] += [{"module": a.name, "names": [], "level": 0, "alias": a.asname, "line": node.lineno} for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            alias = node.names[0].asname if len(node.names) == 1 else None
            out["imports"].append({"module": node.module or "", "names": [a.name for a in node.names], "level": node.level, "alias": alias, "line": node.lineno})
        elif isinstance(node, (*_FUNCTIONS, ast.ClassDef)):
            kind = "class" if isinstance(node, ast.ClassDef) else "method" if scope else "function"
            inner = (*scope, node.name)
            out["symbols"].append({"qualified": ".".join(inner), "name": node.name, "kind": kind, "start_line": node.lineno, "end_line": node.end_lineno})
            children = node.body  # decorators, bases and defaults are not looked into
        elif isinstance(node, ast.Call):
            callee = _dotted(node.func)
            if callee:
                out["calls"].append({"callee": callee, "scope": ".".join(scope) or None, "line": node.lineno})
        elif isinstance(node, ast.Assign) and not scope and isinstance(node.value, (ast.List, ast.Tuple)):
            if any(isinstance(t, ast.Name) and t.id == "__all__" for t in node.targets):
                declared = [e.value for e in node.value.elts if isinstance(e, ast.Constant) and isinstance(e.value, str)]
        todo += [(c, inner) for c in reversed(children)]
    public = [s["name"] for s in out["symbols"] if "." not in s["qualified"] and not s["name"].startswith("_")]
    out["exports"] = public if declared is None else declared
    return out


def python_parsed(content: Column) -> Column:
    @F.pandas_udf(PARSED)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([parse_python(t) for t in texts], columns=["imports", "exports", "symbols", "calls", "error"])

    return run(content)


# The nodes that count as branches, and those that count as nesting.
_BRANCHES = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.Try, ast.ExceptHandler, ast.IfExp, ast.BoolOp, ast.Match)
_NESTS = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.Try, ast.ExceptHandler, ast.With, ast.AsyncWith, ast.Match)


def python_shape(text: str | None) -> tuple[int, int, int]:
    """Branches, functions and nesting depth of a module; zeros on a syntax error."""
    try:
        tree = ast.parse(text or "")
    except (SyntaxError, ValueError, RecursionError):
        return 0, 0, 0
    branches = functions = deepest = 0
    todo = [(tree, 0)]
    while todo:
        node, depth = todo.pop()
        branches += isinstance(node, _BRANCHES)
        functions += isinstance(node, _FUNCTIONS)
        depth += isinstance(node, _NESTS)
        deepest = max(deepest, depth)
        todo += [(c, depth) for c in ast.iter_child_nodes(node)]
    return branches, functions, deepest


def python_complexity(content: Column) -> Column:
    @F.pandas_udf("branches long, functions long, nesting long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([python_shape(t) for t in texts], columns=["branches", "functions", "nesting"])

    return run(content)


# --- unified diffs: lines, then windows and grouping --------------------------------------

# The lines of a diff that git writes.
_HEADER = r"^diff --git a/(.*?) b/(.*)$"
_HUNK = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"


def parse_diffs(diffs: DataFrame, merged: bool = False) -> DataFrame:
    """diffs (diff_id, text) -> diff_id, seq, path, old_path, change_type, ranges.

    The lines that matter are numbered by file, a running count of the headers of their diff,
    and grouped; so the work grows with the lines, however many files a diff has. Hunks
    without new lines give no range; `merged` joins ranges that overlap or touch.
    """
    lines = diffs.select("diff_id", F.posexplode(F.split("text", r"\r?\n")).alias("pos", "line"))
    line = F.col("line")
    kind = (
        F.when(line.rlike(_HEADER), "header").when(line.startswith("new file mode"), "added").when(line.startswith("deleted file mode"), "deleted")
        .when(line.startswith("rename from "), "from").when(line.startswith("rename to "), "to").when(line.rlike(_HUNK), "hunk")
    )
    lines = lines.withColumn("kind", kind).where("kind IS NOT NULL")
    place = F.sum(F.when(F.col("kind") == "header", 1).otherwise(0)).over(W.partitionBy("diff_id").orderBy("pos")) - 1
    start = F.regexp_extract(line, _HUNK, 1).try_cast("int")
    length = F.coalesce(F.nullif(F.regexp_extract(line, _HUNK, 2), F.lit("")).try_cast("int"), F.lit(1))
    of = lambda *kinds: F.col("kind").isin(*kinds)
    hunk = F.when(of("hunk") & (length > 0), F.struct("pos", start.alias("start"), (start + length - 1).alias("end")))
    grouped = (
        lines.withColumn("seq", place)
        .where("seq >= 0")
        .groupBy("diff_id", F.col("seq").cast("int").alias("seq"))
        .agg(
            F.max(F.when(of("header"), F.regexp_extract(line, _HEADER, 1))).alias("a"),
            F.max(F.when(of("header"), F.regexp_extract(line, _HEADER, 2))).alias("b"),
            F.max_by(F.when(of("from"), F.trim(F.substring(line, F.lit(13), F.length(line)))), F.when(of("from"), F.col("pos"))).alias("from"),
            F.max_by(F.when(of("to", "deleted"), line), F.when(of("to", "deleted"), F.col("pos"))).alias("named"),
            F.max_by("kind", F.when(of("added", "deleted", "from"), F.col("pos"))).alias("last"),
            F.array_sort(F.collect_list(hunk)).alias("hunks"),
        )
    )
    old = F.coalesce("from", "a")
    path = F.when(F.col("named").startswith("rename to "), F.trim(F.substring("named", F.lit(11), F.length("named")))).when(F.col("named").isNotNull(), old).otherwise(F.col("b"))
    ranges = F.transform("hunks", lambda h: F.struct(h["start"].alias("start"), h["end"].alias("end")))
    out = grouped.select(
        "diff_id", "seq", path.alias("path"), old.alias("old_path"), F.when(F.col("last") == "from", "renamed").otherwise(F.coalesce("last", F.lit("modified"))).alias("change_type"), ranges.alias("ranges")
    )
    return out.withColumn("ranges", merge(F.col("ranges"))) if merged else out


def merge(ranges: Column) -> Column:
    """An array of ranges with those that overlap or touch joined."""

    def step(acc: Column, r: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        joined = F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], r["end"]).alias("end")))
        return F.when(F.size(acc) == 0, F.array(r)).when(r["start"] <= last["end"] + 1, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), joined)).otherwise(F.concat(acc, F.array(r)))

    return F.aggregate(F.array_sort(ranges), F.array().cast("array<struct<start: int, end: int>>"), step)
