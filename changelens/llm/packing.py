"""Sequence packing by lexical retrieval.

Documents become token ids with an end id. The rarest term of a document that another one has
too is its lexical key. Documents are dealt in the order of their keys to shards of about
`shard_tokens` tokens, so that documents which share rare terms meet; a key of many documents
takes as many shards as it needs. Each shard has a BM25 inverted index over its documents'
token ids, whose document frequencies and mean length are those of the whole corpus.

Whole windows of a long document are sequences of their own. Then, again and again, the first
unused document is a seed; all its terms are the query, and the unused neighbours fill the
seed's window by falling score (documents that share no term come last, in order). The last
one is cut where the window ends, and what is left of it stays unused. What remains at a
shard's end, less than a window, goes on to the next shard of the task; at the task's end it
is cut at powers of two. So no sequence needs padding.

Neighbours are sought in the seed's own shard: a search of all shards for every seed would
grow with the square of the corpus. The README has the recall against all documents.

Defined results: a null or empty text is a document of the end id alone; repeated rows are
documents of their own; ties of score go to the smaller doc_id, nulls last, then to the
earlier row; a null doc_id stays null; an empty table gives an empty result; extra columns
are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changelens.llm.common import arrow_rows, hand_back, materialize, table
from changelens.llm.tokens import CACHE_CHUNKS, SLICE_MB, forget, token_ids

_VOCABULARY = 1 << 16
_MOST_TASKS = 20_000  # a task takes several shards beyond that
_KEYED = 1000  # documents whose keys are sought at a time


def tokenize(docs: DataFrame, path: str | None = None, cache_chunks: int = CACHE_CHUNKS, slice_mb: int = SLICE_MB) -> DataFrame:
    """docs (doc_id, text) -> doc_id, ids (16-bit), n."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), token_ids("text", path, cache_chunks, slice_mb).alias("ids"))
    return ids.withColumn("n", F.expr("length(ids) div 2"))


def _flat(ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids of an Arrow column of 16-bit numbers, and where each row begins."""
    ids = ids.cast(pa.large_binary())
    at = np.frombuffer(ids.buffers()[1], dtype=np.int64)[ids.offset : ids.offset + len(ids) + 1]
    return np.frombuffer(ids.buffers()[2], dtype="<u2")[at[0] // 2 : at[-1] // 2], (at - at[0]) // 2


def _documents_with(ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """In how many of these documents each id occurs: sorted by id, a document's repeats of an
    id follow one another."""
    order = np.argsort(ids, kind="stable")
    owner, term = np.repeat(np.arange(at.size - 1, dtype=np.int32), np.diff(at))[order], ids[order]
    new = np.ones(ids.size, dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (term[1:] != term[:-1])
    return np.bincount(term[new], minlength=_VOCABULARY)


def document_frequencies(tokens: DataFrame, slice_ids: int = 1 << 20) -> np.ndarray:
    """In how many documents each id occurs: one number per id of the vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        out = np.zeros(_VOCABULARY, dtype=np.int64)
        for b in batches:
            ids, at = _flat(b.column(0))
            first = 0
            while first < at.size - 1:
                last = max(first + 1, int(np.searchsorted(at, at[first] + slice_ids, side="right")) - 1)
                out += _documents_with(ids[at[first] : at[last]], at[first : last + 1] - at[first])
                first = last
        found = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(out[found])], ["id", "df"])

    out = np.zeros(_VOCABULARY, dtype=np.int64)
    for r in tokens.select("ids").mapInArrow(count, "id int, df long").groupBy("id").agg(F.sum("df").alias("df")).collect():
        out[r["id"]] = r["df"]
    return out


def ranks(df: np.ndarray) -> np.ndarray:
    """The place of each id among those that two documents have at least, rarest first; all
    others come last."""
    out = np.full(df.size, df.size, dtype=np.int32)
    order = np.lexsort((np.arange(df.size), df))
    order = order[df[order] >= 2]
    out[order] = np.arange(order.size)
    return out


class _Index:
    """A BM25 inverted index over the documents of a shard."""

    def __init__(self, docs: list[np.ndarray], df: np.ndarray, n_docs: int, mean: float, k1: float = 1.2, b: float = 0.75) -> None:
        length = np.array([len(d) for d in docs])
        pairs = np.repeat(np.arange(len(docs)) << 16, length)
        pairs |= np.concatenate(docs)
        pairs.sort()
        first = np.flatnonzero(np.concatenate(([True], pairs[1:] != pairs[:-1])))
        tf, pairs = np.diff(first, append=pairs.size), pairs[first]
        owner, term = (pairs >> 16).astype(np.int32), pairs.astype(np.uint16)
        del first, pairs
        idf = np.log1p((n_docs - df + 0.5) / (df + 0.5))
        weight = idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[owner] / mean))
        self.n = len(docs)
        self.at, self.term = np.searchsorted(owner, np.arange(self.n + 1, dtype=np.int32)), term  # by document
        order = np.argsort(term, kind="stable")
        self.owners, self.weights, self.terms = owner[order], weight[order], term[order]  # by term
        self.starts = np.concatenate(([0], np.cumsum(np.bincount(self.terms, minlength=_VOCABULARY))))

    def keep(self, unused: np.ndarray) -> None:
        """Drop the postings of documents that are used up."""
        on = unused[self.owners]
        self.owners, self.weights, self.terms = self.owners[on], self.weights[on], self.terms[on]
        self.starts = np.concatenate(([0], np.cumsum(np.bincount(self.terms, minlength=_VOCABULARY))))

    def scores(self, doc: int) -> np.ndarray:
        """The score of every document for all terms of this one."""
        terms = self.term[self.at[doc] : self.at[doc + 1]]
        first, size = self.starts[terms], self.starts[1:][terms] - self.starts[terms]
        places = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
        return np.bincount(self.owners[places], self.weights[places], self.n)


def _falling(docs: np.ndarray, rank: np.ndarray, first: int = 64) -> Iterator[int]:
    """docs by falling rank, ties in order. A window is mostly full after a few, so those of the
    highest ranks are sorted before the others."""
    if docs.size > first:
        top = rank >= np.partition(rank, docs.size - first)[docs.size - first]
        yield from docs[top][np.argsort(-rank[top], kind="stable")].tolist()
        docs, rank = docs[~top], rank[~top]
    yield from docs[np.argsort(-rank, kind="stable")].tolist()


def _windows(lengths: np.ndarray, start: np.ndarray, index: _Index, window: int, first: int = 0) -> tuple[list[tuple[int, int, int, int, int]], np.ndarray]:
    """(doc, start, length, sequence, offset) of each piece of whole windows, and from where
    on each document is left. start: what of a document is placed already."""
    out, sequence = [], first
    start = start.copy()
    for i in np.flatnonzero(lengths - start >= window):
        while lengths[i] - start[i] >= window:
            out.append((int(i), int(start[i]), window, sequence, 0))
            start[i] += window
            sequence += 1
    left = lengths - start
    unused = left > 0
    remaining, seed, indexed = int(left.sum()), 0, int(unused.sum())
    while remaining >= window:
        while not unused[seed]:
            seed += 1
        if unused.sum() < 0.8 * indexed:
            index.keep(unused)
            indexed = int(unused.sum())
        rest = np.flatnonzero(unused)
        rank = index.scores(seed)[rest]
        rank[0] = np.inf  # the seed is the first that is unused
        offset = 0
        for i in _falling(rest, rank):
            take = min(int(left[i]), window - offset)
            out.append((i, int(start[i]), take, sequence, offset))
            start[i] += take
            left[i] -= take
            unused[i] = left[i] > 0
            offset += take
            if offset == window:
                break
        remaining -= window
        sequence += 1
    return out, start


def _powers(lengths: np.ndarray, start: np.ndarray, first: int) -> list[tuple[int, int, int, int, int]]:
    """The pieces of what is left, in sequences that are powers of two long."""
    out, sequence = [], first
    left = lengths - start
    remaining, start = int(left.sum()), start.copy()
    offset, size = 0, 1 << (remaining.bit_length() - 1) if remaining else 0
    for i in np.flatnonzero(left):
        while left[i]:
            take = min(int(left[i]), size - offset)
            out.append((int(i), int(start[i]), take, sequence, offset))
            start[i] += take
            left[i] -= take
            offset += take
            remaining -= take
            if offset == size and remaining:
                offset, size, sequence = 0, 1 << (remaining.bit_length() - 1), sequence + 1
    return out


class _Shards:
    """Packs the rows of one task, shard after shard."""

    def __init__(self, df: np.ndarray, n_docs: int, mean: float, window: int) -> None:
        self.df, self.n_docs, self.mean, self.window = df, n_docs, mean, window
        self.rest: list[tuple[int | None, int, np.ndarray, int]] = []  # doc_id, row, ids, start
        self.sequence = TaskContext.get().partitionId() << 32

    def pack(self, rows: list[tuple[int | None, int, np.ndarray, int]], last: bool) -> pd.DataFrame:
        rows = sorted(self.rest + rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        ids, lengths = [r[2] for r in rows], np.array([r[2].size for r in rows], dtype=np.int64)
        start = np.array([r[3] for r in rows], dtype=np.int64)
        pieces: list[tuple[int, int, int, int, int]] = []
        if rows:
            pieces, start = _windows(lengths, start, _Index(ids, self.df, self.n_docs, self.mean), self.window, self.sequence)
        self.sequence = pieces[-1][3] + 1 if pieces else self.sequence
        if last:
            pieces += _powers(lengths, start, self.sequence)
        self.rest = [(r[0], r[1], r[2], int(s)) for r, s in zip(rows, start, strict=True) if s < r[2].size]
        return pd.DataFrame(
            {
                "doc_id": pd.array([rows[p[0]][0] for p in pieces], dtype="Int64"),
                "start": [p[1] for p in pieces],
                "length": [p[2] for p in pieces],
                "ids": [ids[d][s : s + n].astype("<u4").tobytes() for d, s, n, _, _ in pieces],
                "doc_tokens": [ids[p[0]].size for p in pieces],
                "sequence_id": [p[3] for p in pieces],
                "offset": [p[4] for p in pieces],
            }
        )


_PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def deal(tokens: DataFrame, df: np.ndarray, total: int, shard_tokens: int) -> DataFrame:
    """tokens (doc_id, ids) with their row, in partitions of about shard_tokens tokens, by the
    rarest term of each that two documents have."""
    shared = tokens.sparkSession.sparkContext.broadcast(ranks(df))  # one number per id of the vocabulary

    @F.arrow_udf("int")
    def key(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        forget()
        for column in columns:
            found = []
            for first in range(0, len(column), _KEYED):
                ids, at = _flat(column.slice(first, _KEYED))
                found.append(np.minimum.reduceat(shared.value[ids], at[:-1]))
            yield pa.array(np.concatenate(found) if found else np.zeros(0, dtype=np.int32))
        hand_back()

    tasks = min(_MOST_TASKS, max(1, -(-total // shard_tokens)))
    keyed = tokens.select("doc_id", "ids", key("ids").alias("key"), F.monotonically_increasing_id().alias("row"))
    return keyed.repartitionByRange(tasks, "key", "row").sortWithinPartitions("key", "row").select("doc_id", "row", "ids")


def pack(docs: DataFrame, window: int = 4096, shard_tokens: int = 2_000_000, path: str | None = None, cache_chunks: int = CACHE_CHUNKS, slice_mb: int = SLICE_MB) -> DataFrame:
    """docs (doc_id, text) -> one row per piece: doc_id, start, length, ids (little-endian
    32-bit numbers), doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    with arrow_rows(spark, 500):
        tokens = materialize(tokenize(docs, path, cache_chunks, slice_mb))
    total, n_docs = tokens.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    mean = total / max(1, n_docs)
    df = document_frequencies(tokens)
    shared = spark.sparkContext.broadcast(df)  # one number per id of the vocabulary

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget()
        shards = _Shards(shared.value, n_docs, mean, window)
        held, size = [], 0
        for b in batches:
            for doc, row, ids in zip(b["doc_id"], b["row"], b["ids"], strict=True):
                held.append((None if pd.isna(doc) else int(doc), row, np.frombuffer(ids, dtype="<u2"), 0))
                size += held[-1][2].size
                if size >= 1.5 * shard_tokens:
                    found = shards.pack(held, last=False)
                    held, size = [], 0
                    if len(found):  # Arrow takes no frame of binary columns without rows
                        yield found
        found = shards.pack(held, last=True)
        if len(found):
            yield found
        hand_back()

    return deal(tokens, df, total, shard_tokens).mapInPandas(run, _PIECES)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: all documents packed into windows of 4096."""
    pieces = pack(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
