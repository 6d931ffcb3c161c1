"""Benchmark decontamination by size-partitioned MinHash containment search.

A document contains an item when at least `percent` of the item's distinct shingles are in
the document. Items are put in size classes (by the power of two of their number of
shingles). An item of q shingles, of which a document must hold `need`, is sketched by its k
smallest shingle hashes (bottom-k MinHash): k = q - need + e, where e, at least 1, is the
class's share of evidence (an eighth of its least size). The share of the sketch that is among
the document's hashes is the MinHash estimate of the containment; a document that contains the
item lacks q - need shingles at most, so it holds e of the sketch or more, and the search takes
exactly the items of which it does. So it misses nothing.

A class also says how much of a document is sketched for it: nothing, if the document has
fewer shingles than the class's least item needs, and else its hashes up to the class's
largest sketch hash, which are the document's MinHash sketch at that class's scale. A sketch
of fixed size for whole documents would lose the few shingles of a short item in a long text.
Candidates are verified by exact shingle containment.

Where the sketches and the items' texts have at most `broadcast_mb` they are broadcast and a
document is searched where it lies; beyond that, hashes are joined by a shuffle. Both give
the same rows.

Defined results: words are runs of anything but ASCII white space, with A-Z lower-cased; an
item of fewer words than a shingle is one shingle of its own length; null and empty texts
and items match nothing; an item_id that repeats counts once for each distinct text, with
the largest containment; rows of a null id are left out; rows of a doc_id that repeats give
one result for each item; empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changelens.llm.common import WORD_PATTERN, hand_back, materialize, shingle_hashes, table, word_hashes

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_WORD = re.compile(WORD_PATTERN)


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _grams(text: str, n: int) -> set[tuple[str, ...]]:
    words = _WORD.findall(text.translate(_LOWER))
    n = min(n, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


def _least(size: int, percent: int) -> int:
    """How many of an item's shingles a document must hold."""
    return -(-percent * size // 100)


def _evidence(size: int) -> int:
    """How many of an item's sketch a document that contains it holds at least."""
    return max(1, (1 << size.bit_length() - 1) // 8)


def _sketches(items: DataFrame, shingle: int, percent: int) -> DataFrame:
    """items (at, text) -> one row per item and sketch hash: at, n (words of a shingle), size,
    evidence, hash."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at, text in zip(b["at"], b["text"], strict=True):
                words = word_hashes(_bytes(text))
                if words.size == 0:
                    continue
                n = min(shingle, words.size)
                found = np.unique(shingle_hashes(words, n))
                evidence = _evidence(found.size)
                k = found.size - _least(found.size, percent) + evidence
                yield pd.DataFrame({"at": at, "n": n, "size": found.size, "evidence": evidence, "hash": found[:k].view(np.int64)})

    return items.select("at", "text").mapInPandas(run, "at long, n int, size int, evidence int, hash long")


class _Index:
    """The sketches of all items, sorted by hash, by shingle length and size class."""

    def __init__(self, sketches: pd.DataFrame, texts: dict[int, tuple[int, str]], percent: int) -> None:
        self.texts = texts
        self.parts = []
        for (n, evidence, _), part in sketches.groupby(["n", "evidence", sketches["size"].map(lambda q: int(q).bit_length())]):
            hashes = part["hash"].to_numpy(dtype=np.int64).view(np.uint64)
            order = np.argsort(hashes, kind="stable")
            self.parts.append((int(n), _least(int(part["size"].min()), percent), int(evidence), hashes[order], part["at"].to_numpy()[order]))

    def candidates(self, data: bytes) -> set[int]:
        words = word_hashes(data)
        own: dict[int, np.ndarray] = {}
        out: set[int] = set()
        for n, least, evidence, hashes, owners in self.parts:
            if words.size < n + least - 1:
                continue
            if n not in own:
                own[n] = shingle_hashes(words, n)
            mine = own[n][own[n] <= hashes[-1]]
            hit = np.unique(mine[hashes[np.searchsorted(hashes, mine)] == mine])
            if hit.size:
                who, held = np.unique(owners[np.isin(hashes, hit)], return_counts=True)
                out.update(who[held >= evidence].tolist())
        return out


def _contained(item_text: str, text: str, shingle: int) -> tuple[int, int]:
    """The item's shingles that the document has, and all of the item's; exact, on words."""
    own = _grams(item_text, shingle)
    n = len(next(iter(own)))
    return len(own & _grams(text, n)), len(own)


_RESULT = "doc_id long, item_id long, n_shared int, n_item int"


def _exact(found: Iterator[tuple[int, int, str, str]], shingle: int, percent: int) -> pd.DataFrame:
    """Those of (doc_id, item_id, item's text, document's text) that are contained."""
    out = []
    for doc, item, item_text, text in found:
        shared, size = _contained(item_text, text, shingle)
        if 100 * shared >= percent * size:
            out.append((doc, item, shared, size))
    return pd.DataFrame(out, columns=["doc_id", "item_id", "n_shared", "n_item"])


def _by_shuffle(docs: DataFrame, items: DataFrame, sketches: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Documents and items whose sketches meet often enough, joined by hash."""
    order = F.col("hash").bitwiseXOR(F.lit(-(2**63)))  # unsigned order
    bounds = {r["n"]: r["top"] for r in sketches.groupBy("n").agg(F.max(order).alias("top")).collect()}  # one per shingle length
    tops = {n: np.uint64((top ^ -(2**63)) & (2**64 - 1)) for n, top in bounds.items()}

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for doc, text in zip(b["doc"], b["text"], strict=True):
                words = word_hashes(_bytes(text))
                for n, top in tops.items():
                    if words.size >= n:
                        own = np.unique(shingle_hashes(words, n))
                        own = own[own <= top]
                        yield pd.DataFrame({"doc": doc, "n": n, "hash": own.view(np.int64)})

    met = docs.mapInPandas(hashed, "doc long, n int, hash long").join(sketches, ["n", "hash"]).groupBy("doc", "at", "evidence").agg(F.count("*").alias("held"))
    pairs = met.where("held >= evidence").select("doc", "at").join(items.select("at", "item_id", F.col("text").alias("item_text")), "at")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield _exact(zip(b["doc_id"], b["item_id"], b["item_text"], b["text"], strict=True), shingle, percent)

    return pairs.join(docs, "doc").select("doc_id", "item_id", "item_text", "text").mapInPandas(verify, _RESULT)


def contaminated(docs: DataFrame, items: DataFrame, shingle: int = 5, percent: int = 80, broadcast_mb: float = 64) -> DataFrame:
    """docs (doc_id, text), items (item_id, text) -> doc_id, item_id, n_shared, n_item,
    containment for each document that contains an item."""
    spark = docs.sparkSession
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    items = materialize(items.withColumn("at", F.monotonically_increasing_id()))
    sketches = materialize(_sketches(items, shingle, percent))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    size = (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) + 24 * sketches.count()
    if size <= broadcast_mb * 1_000_000:
        texts = {r["at"]: (r["item_id"], r["text"]) for r in items.collect()}
        index = spark.sparkContext.broadcast(_Index(sketches.toPandas(), texts, percent))

        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                near = ((doc, *index.value.texts[at], text) for doc, text in zip(b["doc_id"], b["text"], strict=True) for at in sorted(index.value.candidates(_bytes(text))))
                yield _exact(near, shingle, percent)
            hand_back()

        found = docs.mapInPandas(search, _RESULT)
    else:
        found = _by_shuffle(materialize(docs.withColumn("doc", F.monotonically_increasing_id())), items, sketches, shingle, percent)
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct((F.col("n_shared") / F.col("n_item")).alias("containment"), "n_shared", "n_item")).alias("b"))
    return best.select("doc_id", "item_id", "b.n_shared", "b.n_item", "b.containment")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: every document that contains a benchmark item, and the item."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE_SQL = r"""
WITH texts AS (
  SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark
), words AS (
  SELECT kind, id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM texts
), shingles AS (
  SELECT DISTINCT kind, id, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
  FROM words WHERE len(w) > 0
), sizes AS (SELECT id, count(*) AS n FROM shingles WHERE kind = 'i' GROUP BY id
), hits AS (
  SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n FROM shingles i JOIN shingles d ON i.kind = 'i' AND d.kind = 'd' AND d.s = i.s GROUP BY ALL
)
SELECT doc_id, item_id, hits.n::INTEGER AS n_shared, sizes.n::INTEGER AS n_item, hits.n / sizes.n AS containment
FROM hits JOIN sizes ON sizes.id = item_id WHERE 100 * hits.n >= 80 * sizes.n
"""
