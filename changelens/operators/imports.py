"""Import resolution: candidate paths of an import, and the first that exists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What is tried after a script module's path, in order.
JS_SUFFIXES = (".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js", "/index.jsx")


def _joined(folder: Column, rest: Column) -> Column:
    return F.when(folder == "", rest).when(rest == "", folder).otherwise(F.concat_ws("/", folder, rest))


def normalize(path: Column) -> Column:
    """The path without "." and with ".." carried out; ".." above the top stays."""

    def step(acc: Column, part: Column) -> Column:
        up = (F.size(acc) > 0) & (F.element_at(F.concat(F.array(F.lit("..")), acc), -1) != "..")
        return (
            F.when((part == "") | (part == "."), acc)
            .when((part == "..") & up, F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
            .otherwise(F.concat(acc, F.array(part)))
        )

    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def python_candidates(path: Column, module: Column, names: Column, level: Column) -> Column:
    """Where a Python import can lead, in order: the module (of a relative import without one,
    the package it counts from), its package, then each name in it."""
    folder = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    parts = F.filter(F.split(folder, "/"), lambda x: x != "")
    base = F.when(level > 0, F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - level + 1, F.lit(0))), "/")).otherwise("")
    stem = _joined(base, F.regexp_replace(F.coalesce(module, F.lit("")), r"\.", "/"))
    own = F.array(F.concat(stem, F.lit(".py")), F.concat(stem, F.lit("/__init__.py")))
    named = F.filter(F.coalesce(names, F.array().cast("array<string>")), lambda n: n != "*")
    each = F.flatten(F.transform(named, lambda n: F.array(F.concat(_joined(stem, n), F.lit(".py")), F.concat(_joined(stem, n), F.lit("/__init__.py")))))
    return F.when(stem != "", F.concat(own, each)).otherwise(F.array().cast("array<string>"))


def js_candidates(path: Column, module: Column) -> Column:
    """Where a relative or rooted script import can lead; none for a package."""
    folder = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    target = F.when(module.startswith("/"), normalize(module)).otherwise(normalize(_joined(folder, module)))
    whole = target.rlike(r"\.(js|jsx|ts|tsx)$")
    tried = F.when(whole, F.array(target)).otherwise(F.array(*[F.concat(target, F.lit(s)) for s in JS_SUFFIXES]))
    return F.when(module.startswith(".") | module.startswith("/"), tried).otherwise(F.array().cast("array<string>"))


def resolve(imports: DataFrame, files: DataFrame) -> DataFrame:
    """imports (import_id, candidates) -> import_id, target: the first candidate among
    files (path). Leading dots and slashes of a candidate do not count."""
    each = imports.select("import_id", F.posexplode("candidates").alias("pos", "path"))
    each = each.withColumn("path", F.regexp_replace("path", r"^[./]+", ""))
    return each.join(files.select("path").distinct(), "path").groupBy("import_id").agg(F.min_by("path", "pos").alias("target"))
