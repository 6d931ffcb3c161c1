"""The k files that change most often with each file, by cosine over the commits, exactly.

The pairs of commits of at most `most_files` files are made and counted. Those of larger commits
are not all made:

1. Files that took part in the same large commits, and in as many commits overall, are alike to
   every file that never met them in a small one, so k + 1 of them stand for all.
2. Some partners of each file are counted exactly: the best it met in small commits, and the
   files of its large commits that spend most of their commits in large ones. The k-th of these
   is a floor.
3. A pair that met in large commits only has joint^2 / n_b <= g_a * g_b / n_b, with g the number
   of large commits. So a file meets only those whose share g_b / n_b can reach its floor, which
   are kept in bins of that share. Pairs from small commits whose bound reaches the floor are
   counted over the large commits of the file that has fewer.

Strength is joint^2 / n_b, which orders the partners b of one file as the cosine does, without
rounding. Without any structure (all shares and strengths alike) the bound prunes little, so
`row_pairs` raises most_files where the pairs are few anyway; without larger commits nothing
else is done.

Pairs go to their first file as the list of a commit's files, one row a commit and file; the lists
of a file of many commits are dealt to several tasks by their second files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from changelens.sources.tables_sink import stored

_BINS = 64
_MANY = 100_000  # commits of a file whose pairs are dealt to several tasks
_DEALS = 64
_TASK_PAIRS = 500_000  # about, of one task
_SLACK = 1 - 1e-9  # bounds are doubles


def _strength(joint: str) -> F.Column:
    return F.col(joint).cast("double") * F.col(joint) / F.col("n_b")


def _best(pairs: DataFrame, k: int, *within: str) -> DataFrame:
    """The k strongest rows of each a, ties to the smaller b, with rank."""
    rank = F.row_number().over(W.partitionBy("a", *within).orderBy(F.desc("strength"), "b"))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)


def _most_files(sized: DataFrame, most_files: int, row_pairs: float) -> tuple[int, int]:
    """The most files of a commit such that commits up to it make at most row_pairs pairs for
    each row of all commits, or most_files if that is more; and those pairs. sized: sha, files."""
    # a row for each size, of which there are at most sqrt(2 * rows)
    sizes = sorted(sized.groupBy("files").agg(F.count("*").alias("n")).collect())
    most, pairs, rows = most_files, 0, sum(r["files"] * r["n"] for r in sizes)
    for files, n in sizes:
        more = pairs + n * files * (files - 1)
        if files > most and more > row_pairs * rows:
            break
        most, pairs = max(most, files), more
    return most, pairs


def _met(small: DataFrame, n: DataFrame, pairs: int) -> DataFrame:
    """small (sha, file_id), n (file_id, n) -> a, part, n_a, b, n_b, joint for all pairs that met;
    all rows of an (a, part) are in one partition, and a file has one part unless it is in many
    commits."""
    commit = small.join(n, "file_id").repartition("sha").groupBy("sha").agg(F.collect_list(F.struct("file_id", "n")).alias("files")).where(F.size("files") > 1)
    each = commit.select(F.explode("files").alias("f"), "files").select(F.col("f.file_id").alias("a"), F.col("f.n").alias("n_a"), "files")
    deals = F.when(F.col("n_a") > _MANY, F.sequence(F.lit(0), F.lit(_DEALS - 1))).otherwise(F.array(F.lit(-1)))
    dealt = each.withColumn("part", F.explode(deals))
    mine = F.when(F.col("part") < 0, F.col("files")).otherwise(F.filter("files", lambda x: F.pmod(F.xxhash64(x["file_id"]), F.lit(_DEALS)) == F.col("part")))
    dealt = dealt.withColumn("files", mine).where(F.size("files") > 0)
    tasks = max(small.sparkSession.sparkContext.defaultParallelism, -(-pairs // _TASK_PAIRS))
    # two plain arrays take half the bytes of one of structs
    sent = dealt.select("a", "part", "n_a", F.transform("files", lambda x: x["file_id"]).alias("b"), F.transform("files", lambda x: x["n"]).alias("n_b")).repartition(tasks, "a", "part")
    pairs = sent.select("a", "part", "n_a", F.explode(F.arrays_zip("b", "n_b")).alias("x")).select("a", "part", "n_a", "x.b", "x.n_b").where("a <> b")
    return pairs.groupBy("a", "part", "n_a", "b", "n_b").agg(F.count("*").alias("joint"))


def _scored(ranked: DataFrame) -> DataFrame:
    score = F.round(F.col("joint") / F.sqrt(F.col("n_a") * F.col("n_b").cast("double")), 6)
    return ranked.select(F.col("a").alias("file_id"), "rank", F.col("b").alias("partner"), "joint", score.alias("score"))


def _in_large(pairs: DataFrame, member: DataFrame) -> DataFrame:
    """pairs (a, b, g_a, g_b) -> a, b, more: in how many large commits both took part."""
    fewer = F.when(F.col("g_a") <= F.col("g_b"), F.col("a")).otherwise(F.col("b"))
    other = F.when(F.col("g_a") <= F.col("g_b"), F.col("b")).otherwise(F.col("a"))
    walked = pairs.select("a", "b", fewer.alias("file_id"), other.alias("_other")).join(member, "file_id").select("a", "b", "sha", F.col("_other").alias("file_id"))
    return walked.join(member, ["sha", "file_id"]).groupBy("a", "b").agg(F.count("*").alias("more"))


def top_partners(touched: DataFrame, k: int, most_files: int = 100, row_pairs: float = 0) -> DataFrame:
    """touched (sha, file_id) -> file_id, rank, partner, joint, score: the k strongest partners of
    each file, ties to the smaller partner; a file without any has no row. Repeated rows count once.

    most_files (above k) and row_pairs change the way taken, never the result: commits of more
    than most_files files are taken by bounds, unless those of up to some larger number make at
    most row_pairs pairs a row. Rows of a null sha or file count for nothing."""
    if most_files <= k:
        raise ValueError("most_files must be above k")
    rows = stored(touched.where("sha IS NOT NULL AND file_id IS NOT NULL").select("sha", "file_id").repartition("sha").distinct())
    sized = rows.groupBy("sha").agg(F.count("*").alias("files"))
    most, pairs = _most_files(sized, most_files, row_pairs)
    sized = sized.where(F.col("files") > most).select("sha")
    total = rows.groupBy("file_id").agg(F.count("*").alias("n"))
    if sized.limit(1).count() == 0:
        met = _met(rows, total, pairs).withColumn("strength", _strength("joint"))
        return _scored(_best(_best(met, k, "part").drop("rank"), k))
    member = stored(rows.join(sized, "sha", "left_semi"))
    small = rows.join(sized, "sha", "left_anti")

    # n commits, g of them large, and the class of files with the same large commits and n
    # two independent sums of 64-bit hashes stand for the set of large commits
    mark = lambda salt: F.sum(F.xxhash64(F.lit(salt), "sha").cast("decimal(38,0)"))
    large = member.groupBy("file_id").agg(F.count("*").alias("g"), mark(1).alias("m1"), mark(2).alias("m2"))
    facts = stored(total.join(large, "file_id", "left").withColumn("g", F.coalesce("g", F.lit(0))))
    n = facts.select("file_id", "n", "g")
    of_a = n.toDF("a", "n_a", "g_a")
    of_b = n.toDF("b", "n_b", "g_b")

    met = _met(small, facts.select("file_id", "n"), pairs).select("a", "b", "joint")
    met = stored(met.join(of_a, "a").join(of_b, "b"))

    # 1: the files that stand for their class
    order = F.row_number().over(W.partitionBy("m1", "m2", "n").orderBy("file_id"))
    share = (F.col("g") / F.col("n")).alias("share")
    heads = facts.where("g > 0").withColumn("_order", order).where(F.col("_order") <= k + 1).select("file_id", "n", "g", share)
    meeting = stored(member.join(heads, "file_id").select("sha", F.col("file_id").alias("b"), F.col("n").alias("n_b"), F.col("g").alias("g_b"), "share"))

    # 2: a floor for each file that took part in large commits
    top = F.row_number().over(W.partitionBy("sha").orderBy(F.desc("share"), "b"))
    lead = meeting.withColumn("_top", top).where(F.col("_top") <= k + 1).select("sha", "b", "n_b", "g_b")
    asked = member.withColumnRenamed("file_id", "a").join(of_a, "a")
    leads = asked.join(lead, "sha").where("a <> b").groupBy("a", "b", "n_a", "g_a", "n_b", "g_b").agg(F.count("*").alias("joint"))
    known = met.select("a", "b", "n_a", "g_a", "n_b", "g_b", "joint")
    guessed = known.where("g_a > 0").union(leads.select(known.columns)).groupBy("a", "b", "n_a", "g_a", "n_b", "g_b").agg(F.sum("joint").alias("joint"))
    tried = stored(_best(guessed.withColumn("strength", _strength("joint")), k + 1).drop("rank", "strength", "joint"))
    exact = (
        tried.join(_in_large(tried, member), ["a", "b"], "left")
        .join(met.select("a", "b", F.col("joint").alias("few")), ["a", "b"], "left")
        .withColumn("joint", F.coalesce("more", F.lit(0)) + F.coalesce("few", F.lit(0)))
        .withColumn("strength", _strength("joint"))
    )
    floor = stored(_best(exact, k).groupBy("a").agg(F.when(F.count("*") == k, F.min("strength")).otherwise(0.0).alias("floor")))

    # 3: pairs whose bound reaches the floor, each counted wholly
    need = F.col("floor") * _SLACK / F.col("g_a")
    bins = F.sequence(F.greatest(F.lit(0), F.floor(need * _BINS).cast("int") - 1), F.lit(_BINS))
    wide = asked.join(floor, "a").withColumn("need", need).where("need <= 1").withColumn("bin", F.explode(bins))
    binned = meeting.withColumn("bin", F.floor(F.col("share") * _BINS).cast("int"))
    bound = wide.join(binned, ["sha", "bin"]).where("a <> b AND share >= need")
    apart = bound.groupBy("a", "b", "n_a", "n_b").agg(F.count("*").alias("more"))
    # pairs that also met in small commits are counted over the large ones on their own
    apart = apart.join(met.select("a", "b"), ["a", "b"], "left_anti").select("a", "b", "n_a", "n_b", F.col("more").alias("joint"))

    most = F.col("joint") + F.least("g_a", "g_b")
    open_pairs = met.join(floor, "a", "left").where(F.col("floor").isNull() | (most.cast("double") * most / F.col("n_b") >= F.col("floor") * _SLACK))
    both = open_pairs.where("g_a > 0 AND g_b > 0").select("a", "b", "g_a", "g_b")
    together = open_pairs.join(_in_large(both, member), ["a", "b"], "left").select("a", "b", "n_a", "n_b", (F.col("joint") + F.coalesce("more", F.lit(0))).alias("joint"))

    return _scored(_best(together.union(apart).withColumn("strength", _strength("joint")), k))
