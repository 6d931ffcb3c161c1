"""The git source over a clone that is made of the driver's smallest tables: a commit for each
nation, which adds a file to its region's folder, then a branch that is merged."""

from __future__ import annotations

import subprocess
import tempfile
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changelens.plans.registry import query
from changelens.sources.git import GitSource
from changelens.sources.tables import load

_FIRST = 1_700_000_000  # author date of the first commit, one a minute


@cache
def _clone(nations: tuple[tuple[int, str, str], ...]) -> str:
    """A clone by fast-import: nation k is commit k, and every seventh one renames its file
    afterwards. The last commit merges a branch that removes a file and adds `café.txt`."""
    folder = tempfile.mkdtemp(prefix="clone-")
    out = []

    def commit(ref: str, mark: int, minute: int, message: str, parents: list[int], changes: list[str]) -> None:
        who = f"n <n@example.com> {_FIRST + 60 * minute} +0000"
        lines = [f"commit {ref}", f"mark :{mark}", f"author {who}", f"committer {who}", f"data {len(message.encode())}", message]
        lines += [f"{'from' if i == 0 else 'merge'} :{p}" for i, p in enumerate(parents)]
        out.append("\n".join(lines + changes) + "\n")

    def blob(path: str, text: str) -> str:
        return f"M 100644 inline {path}\ndata {len(text.encode())}\n{text}"

    before: list[int] = []
    for k, nation, region in nations:
        commit("refs/heads/main", k + 1, k, f"Fix {nation}" if k % 3 == 0 else f"Add {nation}", before, [blob(f"{region}/{nation}.txt", f"{nation}\n" * (k + 1))])
        before = [k + 1]
    n, (_, nation, region) = len(nations), nations[0]
    commit("refs/heads/side", n + 1, n, "Side", [n], [f"D {region}/{nation}.txt", blob("café.txt", "one\ntwo\n")])
    commit("refs/heads/main", n + 2, n + 1, "More", [n], [blob("more.txt", "more\n"), f"R \"{nations[1][2]}/{nations[1][1]}.txt\" moved.txt"])
    commit("refs/heads/main", n + 3, n + 2, "Merge side", [n + 2, n + 1], [f"D {region}/{nation}.txt", blob("café.txt", "one\ntwo\n")])
    out.append(f"reset refs/tags/start\nfrom :{nations[0][0] + 1}\n\nreset refs/remotes/origin/far\nfrom :2\n\n")
    subprocess.run(["git", "init", "-q", "--initial-branch=main", folder], check=True, capture_output=True)
    subprocess.run(["git", "-C", folder, "fast-import", "--quiet"], input="".join(out).encode(), check=True, capture_output=True)
    return folder


def _read(spark: SparkSession, sf_dir: str, kind: str, **options: str) -> DataFrame:
    """`kind` of the clone of 25 nations, whose names reach the driver."""
    rows = load(spark, sf_dir, "nation").join(load(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    names = tuple((i, r["n_name"], r["r_name"]) for i, r in enumerate(sorted(rows.collect(), key=lambda r: r["n_nationkey"])))
    spark.dataSource.register(GitSource)
    return spark.read.format("git").options(path=_clone(names), kind=kind, **options).load()


_N = f"""WITH n AS (SELECT n_nationkey AS k, n_name AS nation, r_name AS region FROM nation JOIN region ON r_regionkey = n_regionkey),
c AS (SELECT k, CASE WHEN k % 3 = 0 THEN 'Fix ' ELSE 'Add ' END || nation AS message, k + 1 AS insertions, 0 AS deletions FROM n
  UNION ALL SELECT count(*), 'Side', 2, 1 FROM n UNION ALL SELECT count(*) + 1, 'More', 3, 2 FROM n UNION ALL SELECT count(*) + 2, 'Merge side', 2, 1 FROM n),
own AS (SELECT k, region || '/' || nation || '.txt' AS path FROM n),
items AS (SELECT CASE WHEN k % 3 = 0 THEN 'Fix ' ELSE 'Add ' END || nation AS message, region || '/' || nation || '.txt' AS path, k + 1 AS insertions, 0 AS deletions FROM n
  UNION ALL SELECT m, path, 0, 1 FROM own, (VALUES ('Side'), ('Merge side')) v(m) WHERE k = 0 UNION ALL SELECT m, 'café.txt', 2, 0 FROM (VALUES ('Side'), ('Merge side')) v(m)
  UNION ALL SELECT 'More', 'more.txt', 1, 0 UNION ALL SELECT 'More', 'moved.txt', 2, 0 UNION ALL SELECT 'More', path, 0, 2 FROM own WHERE k = 1),
tracked AS (SELECT path, (k + 1) * (length(nation) + 1) AS bytes FROM n JOIN own USING (k) WHERE k > 1 UNION ALL SELECT 'café.txt', 8 UNION ALL SELECT 'more.txt', 5
  UNION ALL SELECT 'moved.txt', 2 * (length(nation) + 1) FROM n WHERE k = 1)"""


@query("scan_files", f"{_N} SELECT path, bytes::BIGINT AS bytes FROM tracked")
def scan_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files that a ref tracks."""
    return _read(spark, sf_dir, "files", ref="main").select("path", "bytes")


@query("scan_commits", f"{_N} SELECT message, k = 0 AS is_root, {_FIRST} + 60 * k AS author_seconds, insertions::BIGINT AS insertions, deletions::BIGINT AS deletions FROM c ORDER BY k DESC LIMIT 20")
def scan_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty newest commits, read by several tasks."""
    read = _read(spark, sf_dir, "commits", rows_per_task="7", limit="20")
    return read.select("message", F.col("parent").isNull().alias("is_root"), "author_seconds", "insertions", "deletions")


@query("scan_commit_files", f"{_N} SELECT message, path, insertions::BIGINT AS insertions, deletions::BIGINT AS deletions, (insertions + deletions)::BIGINT AS lines FROM items")
def scan_commit_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each commit changed; a merge against its first parent."""
    commits = _read(spark, sf_dir, "commits").select("sha", "message")
    return _read(spark, sf_dir, "commit_files", rows_per_task="7").join(commits, "sha").drop("sha")


@query(
    "diff_refs",
    f"""{_N} SELECT path, 'added' AS change_type, NULL AS old_path FROM own WHERE k > 1 UNION ALL SELECT path, 'added', NULL FROM (VALUES ('café.txt'), ('more.txt'), ('moved.txt')) v(path)
    UNION ALL SELECT path, 'deleted', NULL FROM own WHERE k = 0""",
)
def diff_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files that differ between a tag and a branch."""
    return _read(spark, sf_dir, "diff_files", base="start", head="main")


@query("diff_refs_renamed", f"{_N} SELECT 'moved.txt' AS path, 'renamed' AS change_type, path AS old_path FROM own WHERE k = 1 UNION ALL SELECT 'more.txt', 'added', NULL")
def diff_refs_renamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files that differ between a branch and its merge: one renamed, one added."""
    return _read(spark, sf_dir, "diff_files", base="side", head="main")


@query("diff_text", f"{_N} SELECT 'more.txt' AS path, 'added' AS change_type, 1 AS ranges UNION ALL SELECT 'moved.txt', 'renamed', 0")
def diff_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of that difference, parsed."""
    from changelens.functions.parse import parse_diffs

    text = _read(spark, sf_dir, "diff_text", base="side", head="main").select(F.lit(1).alias("diff_id"), "text")
    return parse_diffs(text).select("path", "change_type", F.size("ranges").alias("ranges"))


@query("file_at_ref", f"{_N} SELECT path, repeat(nation || chr(10), (k + 1)::INTEGER) AS content FROM n JOIN own USING (k) WHERE k = 1")
def file_at_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The content of a file at a ref that still has it."""
    path = _read(spark, sf_dir, "commit_files").where("deletions = 2 AND insertions = 0").select("path").first()["path"]
    return _read(spark, sf_dir, "content", ref="side", file=path).select("path", F.col("content").cast("string").alias("content"))


@query("resolve_ref", f"{_N} SELECT 'main' AS ref, 'Merge side' AS message UNION ALL SELECT 'side', 'Side' UNION ALL SELECT 'no-such-ref', 'Merge side' UNION ALL (SELECT 'start', message FROM c WHERE k = 0) UNION ALL (SELECT 'far', message FROM c WHERE k = 1)")
def resolve_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Branches, tags and remote branches by the commit they name; what none names is HEAD."""
    commits = _read(spark, sf_dir, "commits").select("sha", "message")
    found = None
    for ref in ("main", "side", "no-such-ref", "start", "far"):
        one = _read(spark, sf_dir, "resolve", ref=ref)
        found = one if found is None else found.union(one)
    return found.join(commits, "sha").select("ref", "message")


@query("list_refs", "SELECT * FROM (VALUES ('main', 'branch'), ('side', 'branch'), ('origin/far', 'remote'), ('start', 'tag')) v(name, kind)")
def list_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "refs").select("name", "kind")
