"""Spelling variants: groups of words that differ by one letter, without a pair of them.

Words are counted over all texts. Each word, of a number that grows with its rank (count, then
code points), stands in one wildcard group per position: the words with the same code points
before and behind it. Two words that differ by one replaced code point share exactly one group.
A group keeps its size and its two words of best rank, and every member learns from it how many
near words it has there and which is the best of them. For an inserted or deleted code point,
every distinct string that a word leaves when one code point is deleted is looked up in the
vocabulary; each hit tells both words. Both kinds are added up by word.

Strings are compared by length, position and a 128-bit hash: the sum of a random number for each
(place, code point), so that all prefixes and suffixes of a word cost one running sum, however
long the word is. A word has a row of some 40 bytes per code point. Group sizes are bounded by
the letters: 26 of a to z, 32 of A-Z's accented kin and as many lower-cased, 90 in all.

A word's form is its near word of best rank if that occurs `ratio` times as often at least. Counts
grow along a chain of forms, so roots are found by doubling the steps, a few rounds.

Defined results: null and empty texts have no words; a null doc_id counts as an empty string;
rows that repeat are counted each; of near words of equal count the smallest in code-point order
is the best; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changelens.llm.common import materialize, mix64, release, table

_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_HELD = 200_000  # distinct words that a task counts before it hands them on
_SLICE = 500_000  # code points of words that are hashed at a time


def _altered(run: str, prefix: int, every: int) -> str:
    """run without one code point, if `every` divides its hash. prefix: the crc32 so far."""
    h = zlib.crc32(run.encode(), prefix)
    if h % every:
        return run
    i = h % len(run)
    return run[:i] + run[i + 1 :]


def word_counts(docs: DataFrame, every: int | None = None, least_length: int = 5) -> DataFrame:
    """docs (doc_id, text) -> the distinct words of least_length code points or more and how
    often they occur: (word, n). With `every`, a word of a document loses a code point where
    `every` divides the crc32 of "<doc_id>:<word>"."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def rows() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return b

        for batch in batches:
            for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text"), strict=True):
                text = text.as_py()
                if not text:
                    continue
                # Runs that are too short now stay so: a run only loses code points.
                own = Counter(w for w in _RUN.findall(text.translate(_LOWER)) if len(w) >= least_length)
                if every is None:
                    held.update(own)
                else:
                    prefix = zlib.crc32(f"{doc}:".encode())
                    for w, n in own.items():
                        w = _altered(w, prefix, every)
                        if len(w) >= least_length:
                            held[w] += n
                if len(held) >= _HELD:
                    yield rows()
        if held:
            yield rows()

    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit("")) if every is not None else F.lit("")
    found = docs.select(doc.alias("doc"), F.col("text").cast("string").alias("text")).where("length(text) > 0").mapInArrow(count, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n"))


def _values(places: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The two random numbers of each (place, code point)."""
    with np.errstate(over="ignore"):
        x = (places.astype(np.uint64) << np.uint64(21)) | codes.astype(np.uint64)
        return np.stack((mix64(x * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)), mix64(x * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(7))))


def _keys(words: list[str], ranks: np.ndarray) -> tuple[dict, dict, dict]:
    """The wildcard groups, the distinct deletions and the own hash of each word."""
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    codes = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4")
    first = np.cumsum(lengths) - lengths
    of = np.repeat(np.arange(lengths.size), lengths)
    place = np.arange(codes.size) - first[of]
    with np.errstate(over="ignore"):
        here, moved = _values(place, codes), _values(place - 1, codes)  # moved: behind a deleted code point
        total = np.add.reduceat(here, first, axis=1)
        wild = total[:, of] - here
        upto = np.cumsum(here, axis=1) - here
        behind = np.cumsum(moved, axis=1)
        last = first + lengths - 1
        deleted = upto - upto[:, first][:, of] + behind[:, last][:, of] - behind
    # Of a run of one code point any deletion leaves the same: the first stands for all.
    new = np.ones(codes.size, dtype=bool)
    new[1:] = (codes[1:] != codes[:-1]) | (place[1:] == 0)
    column = lambda h: h.view(np.int64)
    rank = ranks[of]
    groups = {"length": lengths[of], "place": place, "a": column(wild[0]), "b": column(wild[1]), "r": rank}
    deletions = {"length": lengths[of][new] - 1, "place": np.full(int(new.sum()), -1), "a": column(deleted[0][new]), "b": column(deleted[1][new]), "r": rank[new]}
    own = {"length": lengths, "place": np.full(lengths.size, -2), "a": column(total[0]), "b": column(total[1]), "r": ranks}
    return groups, deletions, own


_KEYS = "length long, place long, a long, b long, r long"


def _keyed(ranked: DataFrame) -> DataFrame:
    """The keys of all words: place is that of the wildcard, -1 for a deletion, -2 for the word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, ranks = batch.column("word").to_pylist(), batch.column("r").to_numpy()
            ends = np.cumsum([len(w) for w in words])
            at = 0
            while at < len(words):
                before = ends[at - 1] if at else 0
                end = max(at + 1, int(np.searchsorted(ends, before + _SLICE, side="right")))
                for part in _keys(words[at:end], ranks[at:end]):
                    yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in part.items()})
                at = end

    return ranked.select("word", "r").mapInArrow(run, _KEYS)


def near_words(ranked: DataFrame) -> DataFrame:
    """ranked (word, r: a number that is smaller for a better word) -> for each word that has
    near words, their number and the best of them: (r, n_near, best)."""
    keys = materialize(_keyed(ranked))
    # At most 90 members, see above; what is kept of a group is its size and its top two.
    groups = keys.where("place >= 0").groupBy("length", "place", "a", "b").agg(F.sort_array(F.collect_list("r")).alias("members")).where("size(members) > 1")
    groups = groups.select("members", F.size("members").alias("size"), F.col("members")[0].alias("top"), F.col("members")[1].alias("second"))
    replaced = groups.select(F.explode("members").alias("r"), (F.col("size") - 1).cast("long").alias("near"), "top", "second")
    replaced = replaced.select("r", "near", F.when(F.col("r") == F.col("top"), F.col("second")).otherwise(F.col("top")).alias("best"))
    longer = keys.where("place = -1").select("length", "a", "b", F.col("r").alias("longer"))
    shorter = keys.where("place = -2").select("length", "a", "b", F.col("r").alias("shorter"))
    hits = longer.join(shorter, ["length", "a", "b"]).select(F.explode(F.array(F.struct(F.col("longer").alias("r"), F.col("shorter").alias("best")), F.struct(F.col("shorter").alias("r"), F.col("longer").alias("best")))).alias("x"))
    hits = hits.select("x.r", F.lit(1).cast("long").alias("near"), "x.best")
    found = materialize(replaced.union(hits).groupBy("r").agg(F.sum("near").alias("n_near"), F.min("best").alias("best")))
    release(keys)
    return found


def _roots(links: DataFrame) -> DataFrame:
    """links (r, to), without cycles -> (r, root): where following them ends."""
    reached = materialize(links.select("r", F.col("to").alias("root")))
    while True:
        onward = reached.select(F.col("r").alias("root"), F.col("root").alias("next"))
        joined = reached.join(onward, "root", "left")
        further = materialize(joined.select("r", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("went")))
        release(reached)
        if further.where("went").isEmpty():
            return further.select("r", "root")
        reached = further


def variants(words: DataFrame, ratio: int = 2) -> DataFrame:
    """words (word, n), each word once -> word, form, root, n, n_near, form_n."""
    order = [F.col("n").desc(), F.col("word")]
    # Ranges of the order, numbered in it: a smaller number is a better word.
    ranked = materialize(words.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("r", F.monotonically_increasing_id()))
    near = near_words(ranked)
    better = ranked.select(F.col("r").alias("best"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    rows = ranked.join(near, "r", "left").join(better, "best", "left")
    fits = F.col("form_n") >= ratio * F.col("n")
    rows = materialize(
        rows.select("r", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("best")).alias("to"), F.when(fits, F.col("form")).alias("form"), F.when(fits, F.col("form_n")).alias("form_n"))
    )
    roots = _roots(rows.where("to IS NOT NULL").select("r", "to"))
    named = roots.join(rows.select(F.col("r").alias("root"), F.col("word").alias("name")), "root").select("r", "name")
    return rows.join(named, "r", "left").select("word", "form", F.coalesce("name", "word").alias("root"), "n", "n_near", "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: the spelling variants among the words of all documents."""
    return variants(word_counts(table(spark, sf_dir, "documents"), every=97).where("n >= 3"))


ORACLE_SQL = """
WITH runs AS (
    SELECT doc_id, w, count(*) AS c
    FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS w FROM documents)
    WHERE length(w) >= 5 GROUP BY ALL
), coded AS (
    SELECT *, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || w, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x), 0, 0, 0, 0, 0, 0, 0]
        ELSE [192 + (unicode(x) >> 6), 0, 0, 0, 0, 0, 0, 0, 128 + (unicode(x) & 63), 0, 0, 0, 0, 0, 0, 0] END)) AS bits FROM runs
), hashed AS (
    SELECT w, c, xor(list_reduce(bits, lambda a, b: xor(xor(a, b) >> 1, (xor(a, b) & 1) * 3988292384), 4294967295::BIGINT), 4294967295) AS h FROM coded
), words AS (
    SELECT word, sum(c)::BIGINT AS n
    FROM (SELECT c, CASE WHEN h % 97 = 0 THEN w[1:h % length(w)] || w[h % length(w) + 2:] ELSE w END AS word FROM hashed)
    WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3
), cuts AS (
    SELECT word, n, i, word[1:i] AS a, word[i + 2:] AS b FROM (SELECT *, unnest(range(length(word))) AS i FROM words)
), near AS (
    SELECT x.word, y.word AS other, y.n AS other_n FROM cuts x JOIN cuts y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word
    UNION SELECT x.word, w.word, w.n FROM cuts x JOIN words w ON w.word = x.a || x.b
    UNION SELECT w.word, x.word, x.n FROM cuts x JOIN words w ON w.word = x.a || x.b
), best AS (
    SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS form, max(other_n) AS form_n FROM near GROUP BY word
), formed AS (
    SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 2 * n THEN form END AS form, CASE WHEN form_n >= 2 * n THEN form_n END AS form_n FROM words w LEFT JOIN best USING (word)
), climb AS (
    WITH RECURSIVE up AS (
        SELECT word, word AS reached, form AS next FROM formed
        UNION ALL SELECT up.word, f.word, f.form FROM up JOIN formed f ON f.word = up.next
    ) SELECT word, reached AS root FROM up WHERE next IS NULL
)
SELECT word, form, root, n, n_near::BIGINT AS n_near, form_n FROM formed JOIN climb USING (word)
"""
