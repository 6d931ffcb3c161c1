"""Text to vector: hashed and signed TF-IDF features, fitted and applied as tables.

The features of a text are its words and numbers. Each feature has four places among the 64
components, with a sign each, from the first bytes of its MD5: a sparse random projection. What
it adds there is its weight, fitted over the chunks of an index, times its count. Weights are
whole numbers, so sums don't depend on the order of rows, and a vector is the same wherever it
is computed. Cosines of the vectors estimate those of the TF-IDF features.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changelens.operators import search

SIZE = 64
PLACES = 4  # components that a feature adds to
_UNIT = 256  # of a weight
_TASK_TEXTS = 5_000
_COMMON = 10_000  # features whose weights are broadcast
WORD = "[a-z]+|[0-9]+"


def prepared(text: Column, most_chars: int = 2048) -> Column:
    """What an embedder reads of a text: its first characters, and a space for nothing."""
    cut = F.substring(F.coalesce(text, F.lit("")), 1, most_chars)
    return F.when(F.trim(cut) == "", F.lit(" ")).otherwise(cut)


def features(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(prepared(text)), F.lit(WORD), F.lit(0))


def fit(texts: DataFrame) -> DataFrame:
    """texts (text) -> token, texts_with (in how many texts it occurs) and weight."""
    n = texts.count()
    df = texts.repartition(_tasks(n)).select(F.explode(F.array_distinct(features(F.col("text")))).alias("token")).groupBy("token").agg(F.count("*").alias("texts_with"))
    return df.select("token", "texts_with", _weight(n, F.col("texts_with")).alias("weight"))


def _tasks(n: int) -> int:
    """A table of short texts is one split of a scan: its texts are dealt out before they are
    taken apart, so that a task's sums have a bound."""
    return max(1, -(-n // _TASK_TEXTS))


def _weight(n: int, texts_with: Column) -> Column:
    return F.round(_UNIT * F.log(F.lit(n + 1.0) / (texts_with + F.lit(1.0)))).cast("long") + _UNIT


def _places(token: Column) -> Column:
    """For each byte: the component, and 1 or -1."""
    digest = F.md5(token.cast("binary"))
    bytes_ = [F.conv(F.substring(digest, 2 * i + 1, 2), 16, 10).cast("int") for i in range(PLACES)]
    return F.array(*[F.struct((b % SIZE).alias("at"), (1 - 2 * (F.floor(b / F.lit(SIZE)) % 2)).alias("sign")) for b in bytes_])


def embed(texts: DataFrame, weights: DataFrame) -> DataFrame:
    """texts (id, text) with a vector each: (id, embedding). Features that the weights don't
    know count for nothing; a text without features has a vector of zeros.

    The most common features meet their weights in a broadcast table; the others are few in each
    text and are shuffled by feature. The sums of a text are taken in one task.
    """
    tasks = _tasks(texts.count())
    spread = texts.select("id", "text").repartition(tasks, "id")
    table = weights.select("token", "weight")
    common = F.broadcast(table.orderBy("weight", "token").limit(_COMMON))
    tokens = spread.select("id", F.explode(features(F.col("text"))).alias("token")).join(common, "token", "left")
    others = tokens.where("weight IS NULL").select("id", "token").join(table.hint("merge"), "token")
    known = tokens.where("weight IS NOT NULL").unionByName(others).select("id", "token", "weight").repartition(tasks, "id")
    placed = known.select("id", "weight", F.explode(_places(F.col("token"))).alias("p"))
    sums = placed.groupBy("id", F.col("p.at").alias("at")).agg(F.sum(F.col("p.sign") * F.col("weight")).alias("v"))
    vectors = sums.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("at", "v"))).alias("m"))
    found = spread.select("id").join(vectors.hint("merge"), "id", "left")
    return found.select("id", F.transform(F.sequence(F.lit(0), F.lit(SIZE - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0)).cast("double")).alias("embedding"))


def change_texts(changes: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """The query text of each change: changes (change_id, path) and symbols (change_id, name)
    -> id, text. A change is what one developer hands in: a few files."""
    listed = lambda rows, name, head: rows.groupBy("change_id").agg(F.concat_ws("\n", F.lit(head), F.sort_array(F.collect_set(name))).alias(head))
    texts = listed(changes, "path", "Changed files:")
    if symbols is None:
        return texts.select(F.col("change_id").alias("id"), F.col("Changed files:").alias("text"))
    texts = texts.join(listed(symbols, "name", "Changed symbols:"), "change_id", "left")
    return texts.select(F.col("change_id").alias("id"), F.concat_ws("\n", "Changed files:", F.coalesce("Changed symbols:", F.lit("Changed symbols:"))).alias("text"))


def path_texts(rows: DataFrame) -> DataFrame:
    """rows (change_id, path) -> id, text: the paths of each change, a line each."""
    return rows.groupBy(F.col("change_id").alias("id")).agg(F.concat_ws("\n", F.sort_array(F.collect_set("path"))).alias("text"))


def nearest_chunks(queries: DataFrame, vectors: DataFrame, weights: DataFrame, k: int = 50) -> DataFrame:
    """The k chunks nearest to each query text: queries (id, text), vectors (chunk_id,
    embedding) -> query_id, rank, chunk_id, score."""
    asked = embed(queries, weights).select(F.col("id").alias("query_id"), F.col("embedding").alias("query_vec"))
    return search.batch_topk(vectors.select("chunk_id", "embedding"), asked, k)


def embed_missing(texts: DataFrame, stored: DataFrame, weights: DataFrame) -> DataFrame:
    """stored (chunk_id, embedding) and the vectors of those texts (chunk_id, text) that it does
    not have yet. What is stored stays as it is; of a chunk that is handed in twice the
    smallest text counts."""
    new = texts.join(stored.select("chunk_id"), "chunk_id", "left_anti").groupBy("chunk_id").agg(F.min("text").alias("text"))
    found = embed(new.withColumnRenamed("chunk_id", "id"), weights).withColumnRenamed("id", "chunk_id")
    return stored.select("chunk_id", "embedding").unionByName(found)
