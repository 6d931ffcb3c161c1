"""Near-duplicate documents by MinHash with sequential Bayesian verification.

1. Every document becomes the set of its distinct word shingles. Documents of the same set
   form a class, and only the smallest doc_id of a class goes on, so copies cost nothing more.
2. A class has `bands` x `rows` minimum hashes; classes that agree on a whole band share a
   bucket. At a similarity of 0.8, 40 bands of 6 rows miss a pair with probability 5e-6.
3. Candidates are compared batch by batch of their signatures: with m of n equal, the
   posterior of the similarity is Beta(m + 1, n - m + 1) for a uniform prior, and a pair is
   dropped once the posterior probability of reaching the threshold is below `miss`.
4. Survivors are verified on their full shingle sets.

All pairs of a large bucket are never listed. In each round every bucket names a leader (the
least of a hash that changes with the round), every member takes the one leader it shares most
buckets with, and what is verified is joined into components: a pair a member at most. What is
left then are buckets that still hold several components; there, every pair of members of
different components is compared within tasks, in blocks, and only survivors become rows, a
few a member at most, or the links that suffice to join what all links of the block join. So no link between two components is lost, and a large group of near
copies costs rows in proportion to its size.

Defined results: words are runs of anything but ASCII white space, with A-Z lower-cased; a
text of fewer words than a shingle is one shingle; a null text or one without words has no
shingles and links with nothing; a null doc_id links with nothing, has a null component and
is kept; repeated rows give one result each; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changelens.llm.common import arrow_rows, bounded, connected_components, hand_back, materialize, mix64, release, shingle_set, table

_CROWDED = 4  # survivors per member, over all its groups, beyond which groups are verified where they are
BATCH = 40  # hashes compared at a time
_BROADCAST_IDS = 1_000_000  # ids of 8 bytes: some 20 MB as a hash relation


def coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Fixed odd multipliers and offsets of n hash functions."""
    r = mix64(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    r = (r >> np.uint64(32)).astype(np.uint32)
    return (r[:n] | np.uint32(1))[:, None], r[n:, None]


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The minimum of each hash function over the set."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(a), 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, x.size, 2048):
        np.minimum(out, (x[at : at + 2048] * a + b).min(axis=1), out=out)
    return out


def posterior_floors(n_hashes: int, threshold: float, miss: float) -> list[tuple[int, int]]:
    """(n, m): after n compared hashes a pair needs at least m equal ones to go on."""
    s = (np.arange(200_000) + 0.5) / 200_000
    floors = []
    for n in range(BATCH, n_hashes + 1, BATCH):
        low = 0
        for m in range(n + 1):
            logs = m * np.log(s) + (n - m) * np.log1p(-s)
            density = np.exp(logs - logs.max())
            if density[s >= threshold].sum() / density.sum() >= miss:
                low = m
                break
        floors.append((n, low))
    return floors


def _sketch(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, key (of the whole set), sig, buckets."""
    a, b = coefficients(bands * rows)
    salts = mix64(np.arange(1, bands + 1, dtype=np.uint64))

    @F.pandas_udf("n_shingles long, key binary, sig binary, buckets array<long>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes, keys, sigs, buckets = [], [], [], []
            for text in batch:
                found = shingle_set((text or "").encode("utf-8", "surrogatepass"), shingle)
                sizes.append(found.size)
                if found.size == 0:
                    keys.append(None)
                    sigs.append(None)
                    buckets.append(None)
                    continue
                with np.errstate(over="ignore"):
                    place = mix64(np.arange(1, found.size + 1, dtype=np.uint64))
                    ends = (int(found.sum(dtype=np.uint64)), int((found * place).sum(dtype=np.uint64)))
                    sig = signature(found, a, b)
                    band = salts.copy()
                    for column in sig.reshape(bands, rows).T:
                        band = mix64(band * np.uint64(0x9FB21C651E98DF25) + column)
                keys.append(b"".join(x.to_bytes(8, "little") for x in (found.size, *ends)))
                sigs.append(sig.tobytes())
                buckets.append(band.view(np.int64))
            yield pd.DataFrame({"n_shingles": sizes, "key": keys, "sig": sigs, "buckets": buckets})
        hand_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), run("text").alias("s")).select("doc_id", "s.*")


def _equal(x: np.ndarray, y: np.ndarray, floors: list[tuple[int, int]]) -> np.ndarray:
    """Which rows of two signature arrays stay in the race, batch after batch."""
    alive, equal, before = np.arange(len(x)), np.zeros(len(x), dtype=np.int64), 0
    for n, least in floors:
        equal[alive] += (x[alive, before:n] == y[alive, before:n]).sum(axis=1)
        alive = alive[equal[alive] >= least]
        before = n
    out = np.zeros(len(x), dtype=bool)
    out[alive] = True
    return out


def _likely(pairs: DataFrame, reps: DataFrame, floors: list[tuple[int, int]]) -> DataFrame:
    """Those of pairs (x, y) that their signatures leave in the race."""

    @F.pandas_udf("boolean")
    def promising(xs: pd.Series, ys: pd.Series) -> pd.Series:
        if len(xs) == 0:
            return pd.Series([], dtype=bool)
        x, y = (np.frombuffer(b"".join(v), dtype=np.uint32).reshape(len(v), -1) for v in (xs, ys))
        return pd.Series(_equal(x, y, floors))

    sig = reps.select("doc_id", "sig")
    return pairs.join(sig.toDF("x", "sx"), "x").join(sig.toDF("y", "sy"), "y").where(promising("sx", "sy")).select("x", "y")


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """The sizes of all intersections of two lists of sets, as products of 0/1 matrices."""
    where = [np.repeat(np.arange(len(v)), [x.size for x in v]) for v in (left, right)]
    flat = [np.concatenate(v) for v in (left, right)]
    shared = np.intersect1d(*flat)
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    places = []
    for x in flat:
        at = np.minimum(np.searchsorted(shared, x), max(0, shared.size - 1))
        places.append((at, shared[at] == x if shared.size else np.zeros(x.size, dtype=bool)))
    for start in range(0, shared.size, 4096):
        sides = []
        for n, rows, (at, known) in zip((len(left), len(right)), where, places, strict=True):
            hit = known & (at >= start) & (at < start + 4096)
            m = np.zeros((n, min(4096, shared.size - start)), dtype=np.float32)
            m[rows[hit], at[hit] - start] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T
    return out


def _joining(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The places of links between components x and y, so few that they join what all links do."""
    parent: dict[int, int] = {}

    def root(v: int) -> int:
        while (up := parent.setdefault(v, v)) != v:
            parent[v] = v = parent[up]
        return v

    kept, left = [], np.unique(np.concatenate((x, y))).size - 1
    _, first = np.unique(np.stack((np.minimum(x, y), np.maximum(x, y))), axis=1, return_index=True)
    for at in first.tolist():
        if left == 0:
            break
        a, b = root(int(x[at])), root(int(y[at]))
        if a != b:
            parent[a] = b
            kept.append(at)
            left -= 1
    return np.array(kept, dtype=np.int64)


def _across(rows: DataFrame, reps: DataFrame, docs: DataFrame, floors: list[tuple[int, int]], shingle: int, percent: int, bands: int, block: int = 512) -> tuple[DataFrame, DataFrame]:
    """rows (bucket, band, doc_id, comp): pairs (x, y) of different components of a bucket.
    Returns those still to be verified, and verified links.

    The members outside a bucket's largest component are compared with all its members, in
    blocks; a group is one block against another. A pair counts in the first bucket that its
    members share. Sizes and signatures leave some pairs in the race. Each member has
    _CROWDED pairs to give, in equal parts to its groups; a group with no more pairs than its
    members give returns them, any other gets its texts and is verified where it is, and of its
    links those are returned that join components not yet joined by others. So rows stay in
    proportion to members.
    """
    parts = rows.groupBy("bucket", "comp").agg(F.count("*").alias("n"))
    mixed = parts.groupBy("bucket").agg(F.max(F.struct("n", "comp")).alias("top"), F.count("*").alias("k"), F.sum("n").alias("n")).where("k > 1")
    count = lambda n: F.ceil(n / F.lit(block)).cast("int")
    mixed = materialize(mixed.select("bucket", F.col("top.comp").alias("major"), count(F.col("n")).alias("all_blocks"), count(F.col("n") - F.col("top.n")).alias("minor_blocks")))
    inside = materialize(rows.join(mixed, "bucket"))
    gives = inside.groupBy("doc_id").agg((F.lit(float(_CROWDED)) / F.sum(F.when(F.col("comp") == F.col("major"), F.col("minor_blocks")).otherwise(F.col("minor_blocks") + F.col("all_blocks")))).alias("gives"))
    sized = inside.join(gives, "doc_id").join(reps.select("doc_id", "sig", F.col("n_shingles").alias("size")), "doc_id")
    place = lambda n: F.pmod(F.xxhash64("doc_id", "bucket"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ("bucket", "band", "doc_id", "comp", "major", "gives", "sig", "size")
    minor = sized.where("comp <> major").select(*columns, F.lit(True).alias("minor"), place("minor_blocks").alias("b1"), each("all_blocks").alias("b2"))
    every = sized.select(*columns, F.lit(False).alias("minor"), each("minor_blocks").alias("b1"), place("all_blocks").alias("b2"))
    dealt = minor.unionByName(every)
    group = ["bucket", "b1", "b2"]

    def compare(g: pd.DataFrame, sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of the pairs that stay in the race."""
        doc, comp, size, minor = (g[c].to_numpy() for c in ("doc_id", "comp", "size", "minor"))
        top = comp == g["major"].to_numpy()
        i, j = np.flatnonzero(minor), np.flatnonzero(~minor)
        row, column = (lambda v: v[i][:, None]), (lambda v: v[j][None, :])
        open_ = row(comp) != column(comp)
        open_ &= column(top) | (row(doc) < column(doc))
        open_ &= 100 * np.minimum(row(size), column(size)) >= percent * np.maximum(row(size), column(size))
        i, j = (v[at] for v, at in zip((i, j), np.nonzero(open_), strict=True))
        band = int(g["band"].iloc[0])
        kept = [np.zeros(0, dtype=bool)]
        for at in range(0, i.size, 8192):
            x, y = sig[i[at : at + 8192]], sig[j[at : at + 8192]]
            stay = _equal(x, y, floors)
            on = np.flatnonzero(stay)
            whole = (x[on] == y[on]).reshape(on.size, bands, sig.shape[1] // bands).all(axis=2)
            stay[on] = whole.argmax(axis=1) == band
            kept.append(stay)
        kept = np.concatenate(kept)
        return i[kept], j[kept]

    def groups(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
        """Batches come sorted by group; a group that a batch cuts waits for its rest."""
        held = None
        for more in itertools.chain(batches, [None]):
            rows = held if more is None else more if held is None else pd.concat([held, more], ignore_index=True)
            if rows is None or not len(rows):
                continue
            key = rows[group].to_numpy()
            cuts = np.concatenate(([0], np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1, [len(rows)]))
            if more is not None:
                held = rows.iloc[cuts[-2] :].reset_index(drop=True)
                cuts = cuts[:-1]
            if len(cuts) < 2:
                continue
            sig = np.frombuffer(b"".join(rows["sig"].iloc[: cuts[-1]]), dtype=np.uint32).reshape(cuts[-1], -1)
            for a, b in zip(cuts, cuts[1:], strict=False):
                yield rows.iloc[a:b], sig[a:b]

    def found(parts: list[tuple]) -> pd.DataFrame:
        # Column by column: numbers beside nulls would pass through floats, which blur a bucket.
        return pd.DataFrame({c: pd.array([p[k] for p in parts], dtype="Int64") for k, c in enumerate(("x", "y", *group))})

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        for g, sig in groups(batches):
            i, j = compare(g, sig)
            if i.size > max(1.0, g["gives"].sum()):
                out.append((None, None, *(int(v) for v in g[group].iloc[0])))
            elif i.size:
                doc = g["doc_id"].to_numpy()
                out += [(min(p, q), max(p, q), None, None, None) for p, q in zip(doc[i].tolist(), doc[j].tolist(), strict=True)]
            if len(out) > 10_000:
                yield found(out)
                out = []
        yield found(out)
        hand_back()

    def dense(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g, sig in groups(batches):
            i, j = compare(g, sig)
            doc = g["doc_id"].to_numpy()
            met, text = set(i.tolist()) | set(j.tolist()), g["text"].to_numpy()
            sets = {k: shingle_set(text[k].encode("utf-8", "surrogatepass"), shingle) for k in met}
            left, at_left = np.unique(i, return_inverse=True)
            right, at_right = np.unique(j, return_inverse=True)
            both = _common([sets[k] for k in left], [sets[k] for k in right])[at_left, at_right] if i.size else np.zeros(0)
            size = g["size"].to_numpy()
            link = 100 * both >= percent * (size[i] + size[j] - both)
            comp, p, q = g["comp"].to_numpy(), i[link], j[link]
            joins = _joining(comp[p], comp[q])
            p, q = doc[p[joins]], doc[q[joins]]
            yield pd.DataFrame({"x": np.minimum(p, q), "y": np.maximum(p, q)})
        hand_back()

    spark = rows.sparkSession
    with arrow_rows(spark, 2000):
        one = materialize(dealt.repartition(*group).sortWithinPartitions(*group).mapInPandas(first, "x long, y long, bucket long, b1 int, b2 int"))
    crowded = one.where("x IS NULL").select(*group)
    again = dealt.join(crowded, group).join(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text IS NOT NULL"), "doc_id")
    with arrow_rows(spark, 128):
        links = materialize(again.repartition(*group).sortWithinPartitions(*group).mapInPandas(dense, "x long, y long").distinct())
    release(inside)
    release(mixed)
    return one.where("x IS NOT NULL").select("x", "y").distinct(), links


def _verify(likely: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Those of likely (x, y) whose shingle sets reach the similarity."""

    @F.pandas_udf("boolean")
    def linked(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        recent: OrderedDict[tuple[int, str], np.ndarray] = OrderedDict()  # leaders come up again and again

        def of(doc: int, text: str) -> np.ndarray:
            found = recent.pop((doc, text), None)  # a doc_id can repeat with another text
            if found is None:
                found = shingle_set(text.encode("utf-8", "surrogatepass"), shingle)
            recent[doc, text] = found
            if len(recent) > 32:
                recent.popitem(last=False)
            return found

        for xs, tx, ys, ty in batches:
            out = []
            for x, a, y, b in zip(xs, tx, ys, ty, strict=True):
                p, q = of(x, a), of(y, b)
                both = np.intersect1d(p, q, assume_unique=True).size
                out.append(100 * both >= percent * (p.size + q.size - both))
            yield pd.Series(out, dtype=bool)
        recent.clear()
        hand_back()

    wanted = bounded(likely.select(F.explode(F.array("x", "y")).alias("doc_id")).distinct(), _BROADCAST_IDS)
    # Should a doc_id repeat with other texts, all of them count as that document.
    texts = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text IS NOT NULL").join(wanted, "doc_id", "left_semi"))
    both = likely.join(texts.toDF("x", "tx"), "x").join(texts.toDF("y", "ty"), "y")
    with arrow_rows(docs.sparkSession, 64):
        out = materialize(both.where(linked("x", "tx", "y", "ty")).select("x", "y").distinct())
    release(texts)
    return out


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, bands: int = 40, rows: int = 6, miss: float = 1e-5, star_rounds: int = 2) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_shingles, component_id, kept; one row per document.

    Documents are linked when 100 * intersection >= percent * union of their shingle sets.
    """
    with arrow_rows(docs.sparkSession, 500):
        sketches = materialize(_sketch(docs, shingle, bands, rows))
    known = sketches.where("key IS NOT NULL AND doc_id IS NOT NULL")
    classes = materialize(known.groupBy("key").agg(F.min("doc_id").alias("rep")))
    reps = materialize(known.join(classes.select(F.col("rep").alias("doc_id"), "key"), ["doc_id", "key"]).dropDuplicates(["doc_id", "key"]).select("doc_id", "n_shingles", "sig", "buckets"))
    rows_out = materialize(sketches.select("doc_id", "n_shingles", "key"))
    release(sketches)

    spread = reps.select("doc_id", F.posexplode("buckets").alias("band", "bucket"))
    shared = materialize(spread.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket"))
    members = materialize(spread.join(shared, "bucket"))
    release(shared)
    done = [classes, reps, members]  # nothing reads them once the components are named

    floors = posterior_floors(bands * rows, percent / 100, miss)
    links, compared, comps = None, None, None
    for turn in range(star_rounds + 1):
        if comps is None:
            rowset = members.withColumn("comp", F.col("doc_id"))
        else:
            rowset = members.join(comps, members["doc_id"] == comps["node"], "left").select("bucket", "band", "doc_id", F.coalesce("component", "doc_id").alias("comp"))
        rowset = materialize(rowset)
        if turn < star_rounds:
            lead = F.min(F.struct(F.xxhash64("doc_id", F.lit(turn)).alias("h"), "doc_id", "comp")).alias("lead")
            leaders = materialize(rowset.groupBy("bucket").agg(lead, F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 < c1").select("bucket", "lead"))
            met = rowset.join(leaders, "bucket").where("comp <> lead.comp").groupBy("doc_id", F.col("lead.h").alias("h"), F.col("lead.doc_id").alias("to")).agg(F.count("*").alias("n"))
            chosen = met.groupBy("doc_id").agg(F.min(F.struct(-F.col("n"), "h", "to")).alias("best"))
            pairs = chosen.select(F.least("doc_id", "best.to").alias("x"), F.greatest("doc_id", "best.to").alias("y")).distinct()
            if compared is not None:
                pairs = pairs.join(compared, ["x", "y"], "left_anti")
            pairs = materialize(pairs)
            done.append(pairs)
            release(leaders)
            compared = pairs if compared is None else compared.union(pairs)
            with arrow_rows(docs.sparkSession, 2000):
                likely = materialize(_likely(pairs, reps, floors))
        else:
            likely, direct = _across(rowset, reps, docs, floors, shingle, percent, bands)
            likely = materialize(likely if compared is None else likely.join(compared, ["x", "y"], "left_anti"))
            done.append(direct)
            links = direct if links is None else links.union(direct)
        release(rowset)
        if likely.limit(1).count() > 0:
            found = _verify(likely, docs, shingle, percent)
            done.append(found)
            links = found if links is None else links.union(found)
        release(likely)
        if links is not None:
            comps = materialize(connected_components(links, "x", "y"))
            done.append(comps)

    named = classes.withColumn("component_id", F.col("rep"))
    if comps is not None:
        named = classes.join(comps, F.col("rep") == F.col("node"), "left").select("key", F.coalesce("component", "rep").alias("component_id"))
    named = materialize(named.select("key", "component_id"))
    for df in done:
        release(df)
    out = rows_out.join(named, "key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: near-duplicate components of all documents, on two-word shingles."""
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=2)


ORACLE_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
    ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM words
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), numbered AS (SELECT doc_id, dense_rank() OVER (ORDER BY s) AS s FROM shingles
), shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM numbered a JOIN numbered b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * common >= 80 * (p.n + q.n - common)
), two_way AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, two_way.y FROM reach JOIN two_way ON reach.b = two_way.x
), comps AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) JOIN comps USING (doc_id)
"""
