"""Merkle manifest of a dataset: a node store in external memory, and proofs from it.

Every row is a leaf, the digest of its fields. Leaves are sorted by source and doc_id into
ranges; a range is a sorted run of Parquet files, so a source of any size is many runs. Each
leaf gets its coordinate, (tree, position): trees are the sources in order, and positions come
from the rows of each range and the counts of the ranges before it.

The node store has a folder per level. A row of level k is one run of 16 consecutive nodes
below (the last run of a tree may have fewer): its coordinate, the digests of its members and
its own digest. A task reads its part of the level below in order and streams out the runs it
has whole; of a run that the edge of a task cuts, each side emits what it has, and the few
such pieces are put together by their coordinate. A level thus reads the one before once, in
sequence, and is a sixteenth of its size. The roots of the trees, in order of their sources,
are the leaves of one more tree of the same kind.

Proofs go down from the root: the path of a node is what stands left and right of it in its
run, then the path of the run. Runs of a level and paths of the level above are both in order
of their coordinates and are joined by a merge; only at the leaves is there a path per row,
and there it is folded and digested on the spot, never stored.

A digest is the lowercase hex SHA-256 of its inputs, concatenated. A null field is "-", any
other its UTF-8 byte count, ":" and its value.

Defined results: rows without doc_id come first within their source; rows that repeat are
leaves of their own, in the order of their digests; a null source is a tree of its own and the
first; a tree of one leaf has that leaf as its root, and so has a manifest of one tree; an
empty table gives an empty manifest; columns besides the fields and doc_id, source are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from changelens.llm.common import crc_mod, materialize, release, table

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT = 16
_PIECES = "tree long, run long, n long, at array<long>, members array<string>, whole boolean"


def leaf_digest(fields: list[Column]) -> Column:
    """The digest of a row's fields, each of them a column of any plain type."""
    parts = []
    for f in fields:
        text = f.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _sorted(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows in ranges of the order, stored, with `at`: the range's number and the row in it."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return materialize(ranged.withColumn("at", F.monotonically_increasing_id()))


def _range() -> Column:
    return F.shiftright("at", 33)


def _numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """rows with their place in the order, from 0. The running sum is over a row for each range."""
    stored = _sorted(rows, order)
    shift = F.expr("coalesce(sum(n) OVER (ORDER BY span ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - first")
    spans = stored.groupBy(_range().alias("span")).agg(F.min("at").alias("first"), F.count("*").alias("n")).select("span", shift.alias("shift"))
    return stored.join(spans, _range() == F.col("span")).withColumn(name, F.col("at") + F.col("shift")).drop("span", "shift", "at")


def _placed(leaves: DataFrame) -> tuple[DataFrame, int]:
    """leaves (doc_id, source, digest, tampered) with their coordinate (tree, position) and the
    leaves n of their tree, stored; and how many trees there are.

    Ranges are dealt by source and doc_id, so a large source is many ranges. A position is the
    row's place in its range, from the first of its source there, and what earlier ranges have.
    """
    first = F.col("source").asc_nulls_first()
    stored = _sorted(leaves, [first, F.col("doc_id").asc_nulls_first(), F.col("digest")])
    spans = materialize(stored.groupBy(F.col("source").alias("of"), _range().alias("span")).agg(F.min("at").alias("first"), F.count("*").alias("n")))
    trees = materialize(_numbered(spans.groupBy(F.col("of").alias("source")).agg(F.sum("n").alias("n")), [first], "tree"))
    # A window's rows are the ranges of one source: one for each task at most.
    shift = F.expr("coalesce(sum(n) OVER (PARTITION BY of ORDER BY span ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - first")
    spans = spans.select("of", "span", shift.alias("shift")).join(trees, F.col("of").eqNullSafe(F.col("source"))).select("of", "span", "shift", "tree", "n")
    placed = stored.join(spans, (_range() == F.col("span")) & F.col("source").eqNullSafe(F.col("of")))
    placed = placed.select("tree", (F.col("at") + F.col("shift")).alias("position"), "n", "doc_id", "digest", "tampered").sortWithinPartitions("tree", "position")
    placed = materialize(placed)
    n_trees = trees.count()
    for old in (stored, trees):
        release(old)
    return placed, n_trees


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes (tree, position, digest, n: nodes of the tree) -> runs, or pieces of them where the
    task's rows begin or end within one. Neighbours in the stream that share a run are put
    together; any order of the stream gives right pieces."""
    tree = run = None
    at: list[int] = []
    digests: list[str] = []
    size = 0
    out: list[tuple] = []

    def close() -> None:
        if at:
            out.append((tree, run, -(-size // FANOUT), list(at), list(digests), len(at) == min(FANOUT, size - run * FANOUT)))
            at.clear()
            digests.clear()

    def rows() -> pa.RecordBatch:
        names = ("tree", "run", "n", "at", "members", "whole")
        types = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.bool_())
        b = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
        out.clear()
        return b

    for b in batches:
        for t, p, d, n in zip(*(b.column(c).to_pylist() for c in ("tree", "position", "digest", "n")), strict=True):
            if t != tree or p // FANOUT != run:
                close()
                tree, run, size = t, p // FANOUT, n
            at.append(p)
            digests.append(d)
        if len(out) >= 1000:
            yield rows()
    close()
    if out:
        yield rows()


def _level(nodes: DataFrame) -> DataFrame:
    """The runs over nodes (tree, position, digest, n): (tree, run, n, members, digest), stored;
    n is now how many runs the tree has."""
    pieces = materialize(nodes.select("tree", "position", "digest", "n").mapInArrow(_streamed, _PIECES))
    # A run of 16 members has 16 pieces at most.
    cut = (
        pieces.where("NOT whole")
        .select("tree", "run", "n", F.explode(F.arrays_zip("at", "members")).alias("m"))
        .groupBy("tree", "run", "n")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("m.at", "m.members"))), lambda x: x["members"]).alias("members"))
    )
    runs = pieces.where("whole").select("tree", "run", "n", "members").union(cut)
    stored = materialize(runs.select("*", F.sha2(F.array_join("members", ""), 256).alias("digest")).repartitionByRange("tree", "run").sortWithinPartitions("tree", "run"))
    release(pieces)
    return stored


def _grown(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The levels of runs over nodes (tree, position, digest, n), lowest first, and the root of
    each tree (tree, digest)."""
    levels, roots = [], nodes.where("n = 1").select("tree", "digest")
    while not nodes.where("n > 1").isEmpty():
        runs = _level(nodes.where("n > 1"))
        levels.append(runs)
        nodes = runs.select("tree", F.col("run").alias("position"), "digest", "n")
        roots = roots.union(nodes.where("n = 1").select("tree", "digest"))
    return levels, roots


def _beside(members: Column, at: Column) -> Column:
    """What stands left and right of a member of a run."""
    size = F.greatest(F.size(members) - at - 1, F.lit(0))
    return F.struct(F.array_join(F.slice(members, F.lit(1), at), "").alias("left"), F.array_join(F.slice(members, at + 2, size), "").alias("right"))


_PATH = "array<struct<left:string,right:string>>"


def _paths(levels: list[DataFrame], base: DataFrame) -> DataFrame | None:
    """The runs of the lowest level with the paths above them: (tree, run, members, subroot, path).
    base (tree, subroot, path) has the root of each tree and what stands above it."""
    above = paths = None
    for k in reversed(range(len(levels))):
        runs = levels[k].select("tree", "run", "n", "members")
        paths = runs.where("n = 1").join(base, "tree").select("tree", "run", "members", "subroot", "path")
        if above is not None:
            paths = paths.union(runs.where("n > 1").hint("merge").join(above, ["tree", "run"]).select("tree", "run", "members", "subroot", "path"))
        if k:
            stored = materialize(
                paths.select("tree", F.col("run").alias("of"), "members", "subroot", "path", F.posexplode("members").alias("at", "digest")).select(
                    "tree", (F.col("of") * FANOUT + F.col("at")).alias("run"), "subroot", F.concat(F.array(_beside(F.col("members"), F.col("at"))), "path").alias("path")
                )
            )
            if above is not None:
                release(above)
            above = stored
    return paths


def _proofs(nodes: DataFrame, levels: list[DataFrame], base: DataFrame) -> DataFrame:
    """nodes (tree, position, n, ...) with `subroot` and `path`, from their own run up to the root."""
    alone = nodes.where("n = 1").join(base, "tree")
    paths = _paths(levels, base)
    if paths is None:
        return alone
    at = (F.col("position") % FANOUT).cast("int")
    runs = nodes.where("n > 1").withColumn("run", F.floor(F.col("position") / F.lit(FANOUT)).cast("long"))
    found = runs.hint("merge").join(paths, ["tree", "run"]).withColumn("path", F.concat(F.array(_beside(F.col("members"), at)), "path"))
    return alone.unionByName(found.select(*alone.columns))


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf gives with its path."""
    return F.aggregate(path, leaf, lambda acc, x: F.sha2(F.concat(x["left"], acc, x["right"]), 256))


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """docs (doc_id, source, lang, n_chars, text) -> doc_id, leaf, given, subroot, root, path.

    path has what stands left and right of a node at each level, from the leaf's run up. given is
    the leaf to be proved: that of the row with `tampered` as its text where this is not null,
    else the leaf. Files of the node store stay until the application ends: the result reads them.
    """
    spark = docs.sparkSession
    fields = [F.col(f) for f in FIELDS]
    other = F.lit(None).cast("string") if tampered is None else F.when(tampered.isNotNull(), leaf_digest([*fields[:-1], tampered]))
    leaves = materialize(docs.select("doc_id", "source", leaf_digest(fields).alias("digest"), other.alias("tampered")))
    placed, n_trees = _placed(leaves)
    release(leaves)
    levels, subroots = _grown(placed)
    nodes = materialize(subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("position"), F.lit(n_trees).cast("long").alias("n"), "digest").sortWithinPartitions("position"))
    top, roots = _grown(nodes)
    root = next((r["digest"] for r in roots.take(1)), None)
    base = spark.createDataFrame([(0, root, [])], f"tree long, subroot string, path {_PATH}")
    over = _proofs(nodes, top, base).select(F.col("position").alias("tree"), F.col("digest").alias("subroot"), "path")
    proofs = _proofs(placed, levels, materialize(over))
    return proofs.select("doc_id", F.col("digest").alias("leaf"), F.coalesce("tampered", "digest").alias("given"), "subroot", F.lit(root).cast("string").alias("root"), "path")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: leaf, roots and proof of every document; a fifth is tampered with."""
    tampered = F.when(crc_mod("doc_id", 5) == 0, lower_ascii(F.col("text")))
    proofs = manifest(table(spark, sf_dir, "documents"), tampered)
    text = F.array_join(F.transform("path", lambda x: F.concat(x["left"], x["right"])), "")
    return proofs.select("doc_id", "leaf", "subroot", "root", F.sha2(text, 256).alias("proof_sha256"), fold(F.col("given"), F.col("path")).alias("folded_root")).withColumn("verified", F.expr("folded_root = root"))


def _oracle(depth: int = 6) -> str:
    """The same in DuckDB, for trees of up to 16^depth nodes."""
    bits = "flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: [ascii(x), 0, 0, 0, 0, 0, 0, 0]))"
    crc = f"xor(list_reduce({bits}, lambda c, x: xor(xor(c, x) >> 1, (xor(c, x) & 1) * 3988292384), 4294967295::BIGINT), 4294967295)"
    h = lambda text: "sha256(" + " || ".join(f"coalesce(strlen({x}::VARCHAR)::VARCHAR || ':' || {x}::VARCHAR, '-')" for x in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    ctes = [
        f"base AS (SELECT doc_id, source, {h('text')} AS leaf, CASE WHEN {crc} % 5 = 0 THEN {h('lowered')} END AS tampered FROM (SELECT *, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lowered FROM documents))",
        "l AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM base)",
    ]

    def tree(name: str, nodes: str) -> None:
        ctes.append(f"{name}0 AS ({nodes})")
        for k in range(depth):
            ctes.append(f"{name}r{k} AS (SELECT tree, pos // 16 AS run, list(d ORDER BY pos) AS m FROM {name}{k} WHERE n > 1 GROUP BY ALL)")
            ctes.append(f"{name}{k + 1} AS (SELECT tree, run AS pos, sha256(array_to_string(m, '')) AS d, count(*) OVER (PARTITION BY tree) AS n FROM {name}r{k})")
        ctes.append(f"{name}roots AS (" + " UNION ALL ".join(f"SELECT tree, d FROM {name}{k} WHERE n = 1" for k in range(depth + 1)) + ")")

    def climb(name: str, rows: str, fold: str, proof: str) -> str:
        """rows (tree, pos, given columns) with `fold` and `proof` taken up through every level."""
        q = rows
        for k in range(depth):
            at = f"(pos // {16**k}) % 16"
            q = (
                f"SELECT q.* REPLACE (CASE WHEN m IS NULL THEN {fold} ELSE sha256(array_to_string(m[1:{at}], '') || {fold} || array_to_string(m[{at} + 2:], '')) END AS {fold}, "
                f"{proof} || coalesce(array_to_string(m[1:{at}], '') || array_to_string(m[{at} + 2:], ''), '') AS {proof}) "
                f"FROM ({q}) q LEFT JOIN {name}r{k} r ON r.tree = q.tree AND r.run = q.pos // {16 ** (k + 1)}"
            )
        return q

    tree("s", "SELECT tree, pos, leaf AS d, count(*) OVER (PARTITION BY tree) AS n FROM l")
    tree("t", "SELECT 0 AS tree, tree AS pos, d, count(*) OVER () AS n FROM sroots")
    low = climb("s", "SELECT tree, pos, doc_id, leaf, coalesce(tampered, leaf) AS fold, '' AS proof FROM l", "fold", "proof")
    high = climb("t", f"SELECT 0 AS tree, x.tree AS pos, doc_id, leaf, fold, proof, d AS subroot FROM ({low}) x JOIN sroots s ON s.tree = x.tree", "fold", "proof")
    return (
        f"WITH {', '.join(ctes)} SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = root AS verified "
        f"FROM ({high}) CROSS JOIN (SELECT d AS root FROM troots)"
    )


ORACLE_SQL = _oracle()
