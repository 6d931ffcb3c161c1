"""Near-duplicate embeddings by a forest of random-projection trees.

1. Equal vectors form a class; one vector of each class goes on with the class's size, so
   copies are not expanded into pairs.
2. Every tree splits the classes again and again along a random direction at a quantile of
   a bounded sample of the node (`node_sample` rows). Rows within a margin of the cut go to
   both sides. The margin follows the distance of two vectors at the threshold. What a cut
   parts of the pairs near the threshold is estimated from the sample; a node where every cut
   tried parts too many for the rows it takes away stays one leaf, however large. All other
   leaves have about `leaf_rows` rows. Trees are fitted and rows are dealt by Spark jobs over
   all nodes at once, some levels a round; no tree is on the driver. Each row carries the
   estimated chance that its pairs are still together, and trees are added until the row of
   the least chance has an estimated recall of 0.999.
   What is stored of a row and leaf are ids alone; vectors are joined where they are needed.
3. Within a leaf all pairs are compared by cosine in double precision (a matrix product; a
   large leaf in blocks of `block_rows`, each pair of blocks a group of its own). A first pass
   tells which rows have a link there at all. Only those come again, with the list of their
   leaves, as a pair that several leaves hold is counted in the first of them.
   Only counts and the edges of local spanning trees leave a leaf, never its pairs.
4. The edges are united into components.

Defined results: vectors that are null, zero, or hold null or non-finite components link with
nothing and are their own component; vectors of different lengths do not link; a null vec_id
links with nothing; rows that repeat are copies of each other; extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changelens.llm.common import connected_components, materialize, mix64, release, table

_DEPTH = 6  # levels of a tree that one round adds
_NODES = (1 << _DEPTH) - 1
_TRIES = 5
_QUANTILES = (0.35, 0.5, 0.65)
_DENSE = np.inf
_MOST_PARTED = 0.2  # of the pairs near the threshold, by cuts that halve a node
_PAIRS = 20_000  # sampled pairs that a cut is judged by
_PRIOR = 50  # so many pairs the density at the cut counts for


def _child(node: int, at: int) -> int:
    with np.errstate(over="ignore"):
        x = mix64(np.array([node & (2**64 - 1)], dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25) + np.uint64(at + 1))
    return int(x.view(np.int64)[0])


def _direction(node: int, at: int, turn: int, dim: int) -> np.ndarray:
    v = np.random.default_rng((node & (2**64 - 1), at, turn)).standard_normal(dim)
    return v / np.linalg.norm(v)


def _units(vectors: pd.Series) -> np.ndarray:
    x = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def margin(threshold: float, dim: int) -> float:
    """Half the width of the spill: 0.3 standard deviations of the projected distance of two
    unit vectors whose cosine is the threshold."""
    return 0.3 * float(np.sqrt(max(0.0, 2 - 2 * threshold) / dim))


def _near_pairs(x: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows with a cosine in the half next to the threshold, at most _PAIRS of them."""
    cosine = x @ x.T
    i, j = np.nonzero(np.triu((cosine >= threshold) & (cosine <= (1 + threshold) / 2), 1))
    if i.size > _PAIRS:
        some = np.random.default_rng(i.size).choice(i.size, _PAIRS, replace=False)
        i, j = i[some], j[some]
    return i, j


def _parted(p: np.ndarray, cut: float, side: float, ends: tuple[np.ndarray, np.ndarray]) -> float:
    """The estimated share of pairs near the threshold that a cut parts: from the density of
    the projections p at the cut, as if pairs lay anywhere, and from the sampled pairs."""
    wide = side / 0.3  # standard deviation of a pair's projected distance d; E max(0, |d| - 2 side) = 0.337 wide
    prior = min(1.0, 0.337 * wide * float((np.abs(p - cut) <= wide).mean()) / (2 * wide)) if wide else 0.0
    low, high = np.minimum(*ends), np.maximum(*ends)
    return (_PRIOR * prior + float(((low <= cut - side) & (high > cut + side)).sum())) / (_PRIOR + low.size)


def _fit(leaf_rows: int, threshold: float):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        node, total = int(group["node"].iloc[0]), int(group["n"].iloc[0])
        x = _units(group["vec"])
        scale = total / len(x)
        cuts, losses, turns = np.full(_NODES, np.nan), np.zeros(_NODES), np.zeros(_NODES, dtype=np.int8)
        side = margin(threshold, x.shape[1])
        waiting = [(0, np.arange(len(x)), *_near_pairs(x, threshold))]
        while waiting:
            at, rows, i, j = waiting.pop()
            if at >= _NODES or len(rows) * scale <= leaf_rows:
                continue
            best = None
            for turn in range(_TRIES):
                every = x @ _direction(node, at, turn, x.shape[1])
                p = every[rows]
                for cut in np.quantile(p, _QUANTILES):
                    most = max(int((p <= cut + side).sum()), int((p > cut - side).sum())) / len(rows)
                    if most > 0.8:
                        continue
                    loss = min(_parted(p, float(cut), side, (every[i], every[j])), 0.999)
                    kept = (1 - loss) ** (-1 / np.log2(most))  # over cuts that halve the node
                    if best is None or kept > best[0]:
                        best = (kept, float(cut), turn, loss, every)
            if best is None or best[0] < 1 - _MOST_PARTED:
                cuts[at] = _DENSE
                continue
            _, cuts[at], turns[at], losses[at], every = best
            for child, inside in ((2 * at + 1, every <= cuts[at] + side), (2 * at + 2, every > cuts[at] - side)):
                both = inside[i] & inside[j]
                waiting.append((child, rows[inside[rows]], i[both], j[both]))
        return pd.DataFrame({"node": [node], "tree": [cuts.tobytes() + losses.tobytes() + turns.tobytes()]})

    return run


def _route(threshold: float):
    @F.pandas_udf("array<struct<node: long, done: boolean, kept: double>>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for vectors, nodes, trees in batches:
            out: list[list[dict]] = [[] for _ in range(len(vectors))]
            ids = nodes.to_numpy()
            for node in np.unique(ids):
                mine = np.flatnonzero(ids == node)
                data = trees.iloc[mine[0]]
                cuts, losses = np.frombuffer(data[: 16 * _NODES]).reshape(2, _NODES)
                turns = np.frombuffer(data[16 * _NODES :], dtype=np.int8)
                x = _units(vectors.iloc[mine])
                side = margin(threshold, x.shape[1])
                waiting = [(0, np.arange(len(mine)), 1.0)]
                while waiting:
                    at, rows, kept = waiting.pop()
                    if at < _NODES and np.isfinite(cuts[at]):
                        p = x[rows] @ _direction(int(node), at, int(turns[at]), x.shape[1])
                        kept *= 1 - float(losses[at])
                        waiting += [(2 * at + 1, rows[p <= cuts[at] + side], kept), (2 * at + 2, rows[p > cuts[at] - side], kept)]
                        continue
                    done = at < _NODES  # below the last level of this round a node may go on
                    leaf = {"node": _child(int(node), at), "done": done, "kept": kept}
                    for r in rows:
                        out[mine[r]].append(leaf)
            yield pd.Series(out)

    return run


def _links(group: pd.DataFrame, threshold: float) -> np.ndarray:
    """Which rows of a leaf link with which; of two blocks, pairs across them only."""
    x = _units(group["vec"])
    links = (x @ x.T) >= threshold
    np.fill_diagonal(links, False)
    if group["b1"].iloc[0] != group["b2"].iloc[0]:
        block = group["block"].to_numpy()
        links &= block[:, None] != block[None, :]
    return links


def _linked(threshold: float):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        return group.loc[_links(group, threshold).any(axis=1), ["rep", "node", "block", "b1", "b2"]]

    return run


def _compare(threshold: float):
    def local(links: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The smallest id that each row reaches by links within the leaf."""
        label = ids.copy()
        while True:
            best = np.where(links, label[None, :], label.max()).min(axis=1)
            new = np.minimum(label, best)
            # follow each label to the label of the row that has it
            new = np.minimum(new, new[np.searchsorted(ids, new)])
            if (new == label).all():
                return label
            label = new

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rep", ignore_index=True)
        leaf = int(group["node"].iloc[0])
        ids, sizes = group["rep"].to_numpy(), group["size"].to_numpy()
        links = _links(group, threshold)
        label = local(links, ids)
        owner = np.repeat(np.arange(len(group)), [len(v) for v in group["leaves"]])
        leaves = np.concatenate([np.asarray(v) for v in group["leaves"]])
        owner, leaves = owner[leaves < leaf], leaves[leaves < leaf]
        if leaves.size:
            names, column = np.unique(leaves, return_inverse=True)
            held = np.zeros((len(group), len(names)), dtype=np.float32)
            held[owner, column] = 1
            links &= (held @ held.T) == 0  # the pair is counted in an earlier leaf
        return pd.DataFrame({"rep": ids, "other": label, "found": (links * sizes[None, :]).sum(axis=1)})

    return run


def _grow(classes: DataFrame, first: int, last: int, leaf_rows: int, threshold: float, node_sample: int) -> DataFrame:
    """rep, tree, node and kept (the estimated chance that a pair is still together) of every
    row in every leaf of the trees of these numbers."""
    vectors = classes.select("rep", "vec")
    trees = classes.select("rep", F.size("vec").alias("dims"), F.explode(F.sequence(F.lit(first), F.lit(last))).alias("tree"))
    spread = trees.select("rep", "tree", F.xxhash64("tree", "dims").alias("node"), F.lit(False).alias("done"), F.lit(1.0).alias("kept"))
    stored = None
    while True:
        full = materialize(spread.where(~F.col("done")).groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") > leaf_rows))
        if full.limit(1).count() == 0:
            release(full)
            return spread.drop("done")
        drawn = spread.where(~F.col("done")).join(full, "node").where(F.pmod(F.xxhash64("rep", "node"), F.lit(1 << 30)) < F.lit(float(node_sample << 30)) / F.col("n"))
        fitted = materialize(drawn.join(vectors, "rep").select("node", "n", "vec").groupBy("node").applyInPandas(_fit(leaf_rows, threshold), "node long, tree binary").withColumnRenamed("tree", "cuts"))
        open_rows = spread.where(~F.col("done")).join(vectors, "rep").join(fitted, "node")
        routed = open_rows.withColumn("to", F.explode(_route(threshold)("vec", "node", "cuts"))).select("rep", "tree", "to.node", "to.done", (F.col("kept") * F.col("to.kept")).alias("kept"))
        settled = spread.join(fitted.select("node").withColumn("_open", F.lit(True)), "node", "left").where("done OR _open IS NULL").select("rep", "tree", "node", F.lit(True).alias("done"), "kept")
        spread = materialize(routed.union(settled))
        for old in (full, fitted, *([] if stored is None else [stored])):
            release(old)
        stored = spread


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, leaf_rows: int = 256, node_sample: int = 2000, block_rows: int = 512, recall: float = 0.999) -> DataFrame:
    """vectors (vec_id, embedding) -> vec_id, n_links, component_id, kept; one row per vector."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vec"))
    sound = (
        F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0)
        & F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
        & F.exists("vec", lambda v: v != 0)
    )
    key = F.when(F.coalesce(sound, F.lit(False)), F.sha2(F.concat_ws(",", F.transform("vec", lambda v: (v + F.lit(0.0)).cast("string"))).cast("binary"), 256))
    keyed = materialize(rows.withColumn("key", key))
    # min(vec) of a class is any of its equal vectors
    classes = materialize(keyed.where("key IS NOT NULL").groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("size"), F.min("vec").alias("vec")))

    n = classes.count()
    depth = max(0.0, np.log2(max(1, n) / leaf_rows))
    together = 0.93**depth  # a tree's chance to keep a pair at the threshold in one leaf
    trees = 1 if depth == 0 else max(2, int(np.ceil(np.log(1 - recall) / np.log(1 - min(together, 0.999)))))
    spread = _grow(classes, 1, trees, leaf_rows, threshold, node_sample)
    while True:
        chance = spread.groupBy("rep", "tree").agg(F.least(F.avg("kept"), F.lit(1 - 1e-9)).alias("kept"))
        missed = chance.groupBy("rep").agg(F.avg(F.log1p(-F.col("kept"))).alias("missed")).agg(F.max("missed")).first()[0]
        needed = 1 if missed is None else int(np.ceil(np.log(1 - recall) / missed))
        if needed <= trees:
            break
        spread = spread.union(_grow(classes, trees + 1, needed, leaf_rows, threshold, node_sample))
        trees = needed

    vectors = classes.select("rep", "size", "vec")
    blocks = materialize(spread.groupBy("node").agg(F.ceil(F.count("*") / F.lit(block_rows)).cast("int").alias("blocks")).where("blocks > 1"))
    block = F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")
    paired = (
        spread.select("rep", "node")
        .join(blocks, "node", "left")
        .withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        .withColumn("block", block)
        .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("rep", "node", "block", F.least("block", "with").alias("b1"), F.greatest("block", "with").alias("b2"))
    )

    def by_leaf(rows: DataFrame):
        return rows.repartition("node", "b1", "b2").groupBy("node", "b1", "b2")

    linked = materialize(by_leaf(paired.join(vectors.drop("size"), "rep")).applyInPandas(_linked(threshold), "rep long, node long, block int, b1 int, b2 int"))
    leaves = spread.join(linked.select("rep").distinct(), "rep", "left_semi").groupBy("rep").agg(F.collect_set("node").alias("leaves"))
    found = materialize(by_leaf(linked.join(vectors.join(leaves, "rep"), "rep")).applyInPandas(_compare(threshold), "rep long, other long, found long"))
    counts = found.groupBy("rep").agg(F.sum("found").alias("found"))
    comps = connected_components(found.where("rep <> other"), "rep", "other").toDF("rep", "component")
    known = materialize(
        classes.select("key", "rep", "size")
        .join(counts, "rep", "left")
        .join(comps, "rep", "left")
        .select("key", (F.coalesce("found", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    out = keyed.select("vec_id", "key").join(known, "key", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: near-duplicate components of all embeddings."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLE_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, links.y FROM reach JOIN links ON reach.b = links.x
), comps AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a
), counts AS (SELECT x AS vec_id, count(*) AS n FROM links GROUP BY x)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN comps USING (vec_id) LEFT JOIN counts USING (vec_id)
"""
