"""File classification, hashes, chunks and other text projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changelens.functions import text as T
from changelens.operators import name_index
from changelens.plans.registry import query
from changelens.sources.tables import FILES_SQL, SOURCE_FILES_SQL, files, load, source_files

_LANGUAGE = """CASE WHEN lower(regexp_extract({p}, '[^/](\\.[^./]*)$', 1)) = '.py' THEN 'python'
  WHEN lower(regexp_extract({p}, '[^/](\\.[^./]*)$', 1)) IN ('.js', '.jsx') THEN 'javascript'
  WHEN lower(regexp_extract({p}, '[^/](\\.[^./]*)$', 1)) IN ('.ts', '.tsx') THEN 'typescript' ELSE 'unknown' END"""
_IGNORE = """({})""".format(
    " OR ".join([f"contains(path, '{f}')" for f in T.IGNORED_FOLDERS] + [f"parse_filename(path) = '{n}'" for n in T.IGNORED_NAMES] + [f"path LIKE '%{s}'" for s in T.IGNORED_SUFFIXES])
)
_HEAD = "lower(array_to_string(list_slice(string_split(content, chr(10)), 1, 8), chr(10)))"
_GENERATED = "({})".format(
    " OR ".join(
        [f"lower(path) LIKE '%{s}'" for s in T.GENERATED_SUFFIXES]
        + ["contains('/' || lower(path), '/generated/')", "contains('/' || lower(path), '/__generated__/')"]
        + [f"contains({_HEAD}, '{m}')" for m in T.GENERATED_MARKERS]
    )
)
_TEST_CODE = r"""CASE WHEN lower(path) LIKE '%.py' THEN regexp_matches(content, '(?m)^\s*def\s+test_[\w_]+\s*\(|^\s*class\s+Test\w*\s*[:(]')
  WHEN regexp_matches(lower(path), '\.(js|jsx|ts|tsx)$') THEN regexp_matches(content, '\b(describe|it|test|expect)\s*\(') ELSE false END"""
_TEST_FILE = rf"""(contains('/' || lower(path), '/tests/') OR contains('/' || lower(path), '/__tests__/')
  OR regexp_matches(lower(path), '(^|/)test_[^/]*\.py$') OR lower(path) LIKE '%\_test.py' ESCAPE '\' OR regexp_matches(lower(path), '\.(test|spec)\.(js|ts)$') OR ({_TEST_CODE}))"""
_LOC = r"len(list_filter(string_split(content, chr(10)), lambda x: trim(regexp_replace(x, '[\t\r\f\v]', ' ', 'g')) <> ''))"


def _src(sql: str) -> str:
    return f"WITH {SOURCE_FILES_SQL} {sql} FROM source_files"


def _one(name: str, column, sql: str, alias: str) -> None:
    """A query of file_id and one function of path and content."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        files = source_files(spark, sf_dir)
        return files.select("file_id", column(files.path, files.content).alias(alias))

    query(name, _src(f"SELECT file_id, {sql} AS {alias}"))(run)


@query("detect_language", f"WITH {SOURCE_FILES_SQL} SELECT file_id, path, {_LANGUAGE.format(p='path')} AS language FROM source_files")
def detect_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_files(spark, sf_dir).select("file_id", "path", T.detect_language(F.col("path")).alias("language"))


def _register() -> None:
    _one("ignore_filter", lambda p, c: T.should_ignore(p), _IGNORE, "should_ignore")
    _one("generated_filter", lambda p, c: T.is_generated(p, c), _GENERATED, "is_generated")
    _one("is_test_file", lambda p, c: T.is_test_file(p, c), _TEST_FILE, "is_test")
    _one("contains_test_code", lambda p, c: T.contains_test_code(p, c), _TEST_CODE, "has_test_code")
    _one("count_loc", lambda p, c: T.count_loc(c), _LOC, "loc")
    kept = "array_to_string(list_filter(list_transform(string_split(content, chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10))"
    _one("content_hash", lambda p, c: T.content_hash(c), f"sha256({kept})", "content_hash")
    _one("js_branches", lambda p, c: T.js_branches(c), r"len(regexp_extract_all(content, '\b(if|for|while|switch|catch)\b|\?|&&|\|\|'))", "branches")
    _one("js_functions", lambda p, c: T.js_functions(c), r"len(regexp_extract_all(content, '\bfunction\b|=>'))", "functions")


_register()


@query(
    "classify_files",
    f"""WITH {SOURCE_FILES_SQL}, c AS (SELECT file_id, path, {_LANGUAGE.format(p="path")} AS language, {_TEST_FILE} AS is_test, {_GENERATED} AS is_generated,
      {_IGNORE} AS should_ignore, {_LOC} AS loc FROM source_files)
    SELECT file_id, path, language, language <> 'unknown' AS is_supported, is_test, is_generated, should_ignore, loc FROM c
    WHERE NOT should_ignore AND NOT is_generated AND language <> 'unknown'""",
)
def classify_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything that indexing asks of a file; only the files it would index."""
    _path, _content = F.col("path"), F.col("content")
    out = source_files(spark, sf_dir).select(
        "file_id",
        "path",
        T.detect_language(_path).alias("language"),
        (T.detect_language(_path) != "unknown").alias("is_supported"),
        T.is_test_file(_path, _content).alias("is_test"),
        T.is_generated(_path, _content).alias("is_generated"),
        T.should_ignore(_path).alias("should_ignore"),
        T.count_loc(_content).alias("loc"),
    )
    return out.where("NOT should_ignore AND NOT is_generated AND is_supported")


@query(
    "is_test_symbol",
    """SELECT event_id, (kind IN ('function', 'method') AND (starts_with(name, 'test_') OR name IN ('describe', 'it', 'test')) OR kind = 'class' AND starts_with(name, 'Test')) AS is_test
    FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'function' WHEN 1 THEN 'method' ELSE 'class' END AS kind,
      CASE event_id % 5 WHEN 0 THEN 'test_' || event_type WHEN 1 THEN 'Test' || event_type WHEN 2 THEN 'it' ELSE event_type END AS name FROM events)""",
)
def is_test_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    kind = F.when(k % 3 == 0, "function").when(k % 3 == 1, "method").otherwise("class")
    name = F.when(k % 5 == 0, F.concat(F.lit("test_"), "event_type")).when(k % 5 == 1, F.concat(F.lit("Test"), "event_type")).when(k % 5 == 2, "it").otherwise(F.col("event_type"))
    return load(spark, sf_dir, "events").select("event_id", T.is_test_symbol(name, kind).alias("is_test"))


@query("path_search", f"WITH {FILES_SQL} SELECT file_id, path FROM files WHERE path ILIKE '%BRAND1%7%' AND language = 'python' ORDER BY path LIMIT 200")
def path_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose path holds the search text (in which % and _ are wildcards): a limited list."""
    return files(spark, sf_dir).where(F.ilike("path", F.lit("%BRAND1%7%")) & (F.col("language") == "python")).select("file_id", "path").orderBy("path").limit(200)


@query("path_search_indexed", f"WITH {FILES_SQL} SELECT file_id, path FROM files WHERE path ILIKE '%BRAND1%7%' AND language = 'python' ORDER BY path LIMIT 200")
def path_search_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by an index of the paths' trigrams."""
    names = files(spark, sf_dir).select(F.col("file_id").alias("id"), F.col("path").alias("name"), "language")
    found = name_index.search(names, name_index.postings(names), "%BRAND1%7%").where("language = 'python'")
    return found.select(F.col("id").alias("file_id"), F.col("name").alias("path")).orderBy("path").limit(200)


@query("distinct_languages", f"WITH {FILES_SQL} SELECT DISTINCT language FROM files WHERE language <> ''")
def distinct_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).where("language <> ''").select("language").distinct().orderBy("language")


@query("paged_list", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 20")
def paged_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page of an owner's list, newest first."""
    return load(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), "o_orderkey").offset(20).limit(50)


@query(
    "run_history",
    "SELECT o.o_orderkey, o_orderdate, count(l.l_partkey) AS changed_count FROM orders o LEFT JOIN lineitem l ON l_orderkey = o_orderkey GROUP BY ALL",
)
def run_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs, newest first, with the number of files that each was given."""
    runs = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    given = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("l_partkey").alias("changed_count"))
    out = runs.join(given, "o_orderkey", "left")
    return out.select("o_orderkey", "o_orderdate", F.coalesce("changed_count", F.lit(0)).alias("changed_count")).orderBy(F.desc("o_orderdate"))


@query(
    "ingest_limits",
    "SELECT count(*) AS total_files, sum(strlen(text))::BIGINT AS total_bytes, max(strlen(text))::BIGINT AS largest, count(*) > 50000 OR sum(strlen(text)) > 524288000 OR max(strlen(text)) > 10485760 AS exceeded FROM documents",
)
def ingest_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.octet_length("content").cast("bigint")
    t = source_files(spark, sf_dir).agg(F.count("*").alias("total_files"), F.sum(size).alias("total_bytes"), F.max(size).alias("largest"))
    return t.withColumn("exceeded", F.expr("total_files > 50000 OR total_bytes > 524288000 OR largest > 10485760"))


@query("size_filter", "SELECT doc_id AS file_id, strlen(text)::BIGINT AS bytes FROM documents WHERE strlen(text) <= 4096")
def size_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files up to a size; small here so that both sides occur."""
    return source_files(spark, sf_dir).select("file_id", F.octet_length("content").cast("bigint").alias("bytes")).where("bytes <= 4096")


@query(
    "binary_filter",
    "SELECT page_id, contains(html, 'track(1') OR url ILIKE '%.png' AS is_binary FROM pages",
)
def binary_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A NUL in the first 8000 bytes, or a binary suffix; a NUL stands where pages call track(1."""
    pages = load(spark, sf_dir, "pages")
    content = F.regexp_replace("html", r"track\(1", "\x00").cast("binary")
    return pages.select("page_id", (T.is_binary(content) | T.binary_name(F.col("url"))).alias("is_binary"))


_SYMBOLS = """symbols AS (SELECT file_id, path, content, 'sym_' || file_id AS qualified, CASE file_id % 3 WHEN 0 THEN 'function' WHEN 1 THEN 'class' ELSE 'method' END AS kind,
  (1 + file_id % 3)::INTEGER AS start_line, (3 + file_id % 5)::INTEGER AS end_line, CASE WHEN file_id % 4 = 0 THEN NULL ELSE 'def sym_' || file_id || '(x)' END AS signature FROM source_files WHERE path LIKE '%.py' OR path LIKE '%.JSX')"""


def _symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("file_id")
    return source_files(spark, sf_dir).where("path LIKE '%.py' OR path LIKE '%.JSX'").select(
        "file_id", "path", "content",
        F.concat(F.lit("sym_"), k).alias("qualified"),
        F.when(k % 3 == 0, "function").when(k % 3 == 1, "class").otherwise("method").alias("kind"),
        (1 + k % 3).cast("int").alias("start_line"), (3 + k % 5).cast("int").alias("end_line"),
        F.when(k % 4 != 0, F.concat(F.lit("def sym_"), k, F.lit("(x)"))).alias("signature"),
    )


@query(
    "symbol_hash",
    f"WITH {SOURCE_FILES_SQL}, {_SYMBOLS} SELECT file_id, sha256(trim(concat_ws('|', qualified, kind, start_line, end_line, coalesce(signature, '')))) AS symbol_hash FROM symbols",
)
def symbol_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _symbols(spark, sf_dir)
    return s.select("file_id", T.symbol_hash(s.qualified, s.kind, s.start_line, s.end_line, s.signature).alias("symbol_hash"))


_CHUNK = """'path: ' || path || chr(10) || 'language: ' || lang || chr(10) || 'symbol: ' || qualified || chr(10) || 'signature: ' || coalesce(signature, '') || chr(10) || chr(10) ||
  array_to_string(list_slice(string_split(content, chr(10)), start_line, end_line), chr(10))"""
_CHUNKED = f"""WITH {SOURCE_FILES_SQL}, {_SYMBOLS}, c AS (SELECT *, {_LANGUAGE.format(p="path")} AS lang FROM symbols), t AS (SELECT *, {_CHUNK} AS chunk FROM c)"""


def _chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _symbols(spark, sf_dir)
    return s.withColumn("chunk", T.chunk_text(s.path, T.detect_language(s.path), s.qualified, s.signature, s.content, s.start_line, s.end_line))


@query("chunk_text", f"{_CHUNKED} SELECT file_id, sha256(chunk) AS chunk_sha, greatest(length(chunk) // 4, 1)::BIGINT AS tokens FROM t")
def chunk_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunked(spark, sf_dir).select("file_id", F.sha2(F.col("chunk").cast("binary"), 256).alias("chunk_sha"), T.token_estimate(F.col("chunk")).alias("tokens"))


@query(
    "snippet",
    f"""{_CHUNKED}, n AS (SELECT file_id, array_to_string(list_transform(string_split(trim(chunk), chr(10)), lambda x: rtrim(x)), chr(10)) AS neat FROM t),
    b AS (SELECT file_id, trim(substr(neat, instr(neat, chr(10) || chr(10)) + 2)) AS body FROM n)
    SELECT file_id, CASE WHEN length(body) <= 600 THEN body ELSE rtrim(left(body, 597)) || '...' END AS snippet FROM b""",
)
def snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chunked(spark, sf_dir).select("file_id", T.snippet(F.col("chunk")).alias("snippet"))


@query(
    "chunks",
    f"""WITH {SOURCE_FILES_SQL}, {_SYMBOLS} SELECT f.file_id, coalesce(s.qualified, 'module') AS symbol,
      CASE WHEN {_TEST_FILE.replace("path", "f.path").replace("content", "f.content")} THEN 'test' WHEN s.kind IS NOT NULL THEN s.kind ELSE 'file' END AS chunk_type,
      coalesce(s.start_line, 1) AS start_line, coalesce(s.end_line, len(string_split(f.content, chr(10))))::INTEGER AS end_line
    FROM source_files f LEFT JOIN symbols s USING (file_id)""",
)
def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk per symbol, or one of the whole file where there is none."""
    f = source_files(spark, sf_dir)
    s = _symbols(spark, sf_dir).drop("path", "content")
    return f.join(s, "file_id", "left").select(
        "file_id",
        F.coalesce("qualified", F.lit("module")).alias("symbol"),
        F.when(T.is_test_file(f.path, f.content), "test").when(F.col("kind").isNotNull(), F.col("kind")).otherwise("file").alias("chunk_type"),
        F.coalesce("start_line", F.lit(1)).alias("start_line"),
        F.coalesce("end_line", F.size(T.lines(f.content))).alias("end_line"),
    )


@query(
    "sanitize_paths",
    r"SELECT page_id, regexp_replace(regexp_replace('failed at ' || replace(url, '://', '://user:pw@') || ' in /home/app/' || page_id || '/x.py: bad', '([a-z]+://)[^/@]+@', '\1****@', 'g'), '/(?:app|workspaces|workspace|tmp|root|home|etc|var|usr)/[^\s''\"<>:]+', '<sanitized_path>', 'g') AS message FROM pages",
)
def sanitize_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    message = F.concat(F.lit("failed at "), F.regexp_replace("url", "://", "://user:pw@"), F.lit(" in /home/app/"), "page_id", F.lit("/x.py: bad"))
    return load(spark, sf_dir, "pages").select("page_id", T.sanitize_paths(message).alias("message"))


@query(
    "normalize_url",
    """WITH u AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'git@GitHost.com:org/repo' || page_id || '.git' WHEN 1 THEN 'ssh://git@host.org:team/r' || page_id
      WHEN 2 THEN 'git://host.net/a/b' || page_id || '.git/' ELSE ' https://host.net/a/b' || page_id || '.git/ ' END AS url FROM pages),
    c AS (SELECT page_id, regexp_replace(regexp_replace(trim(url), '/+$', ''), '\\.git$', '') AS url FROM u),
    n AS (SELECT page_id, CASE WHEN regexp_matches(url, '^(?:ssh://)?git@([^:]+):(.+)$') THEN 'https://' || lower(regexp_extract(url, '^(?:ssh://)?git@([^:]+):(.+)$', 1)) || '/' || regexp_extract(url, '^(?:ssh://)?git@([^:]+):/*(.+)$', 2)
      WHEN starts_with(url, 'git://') THEN 'https://' || substr(url, 7) ELSE url END AS url FROM c)
    SELECT page_id, url, string_split(url, '/')[-1] AS repo FROM n""".replace("\\\\", "\\"),
)
def normalize_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    url = (
        F.when(k % 4 == 0, F.concat(F.lit("git@GitHost.com:org/repo"), k, F.lit(".git")))
        .when(k % 4 == 1, F.concat(F.lit("ssh://git@host.org:team/r"), k))
        .when(k % 4 == 2, F.concat(F.lit("git://host.net/a/b"), k, F.lit(".git/")))
        .otherwise(F.concat(F.lit(" https://host.net/a/b"), k, F.lit(".git/ ")))
    )
    return load(spark, sf_dir, "pages").select("page_id", T.normalize_url(url).alias("url"), T.repo_name(url).alias("repo"))


@query(
    "brace_depth",
    r"""WITH RECURSIVE p AS (SELECT page_id, regexp_replace(regexp_replace(html, '[<]', '{', 'g'), '[>]', '}', 'g') AS t FROM pages),
    m AS (SELECT page_id, regexp_replace(t, '[^{}]', '', 'g') AS s FROM p),
    r AS (SELECT page_id, s, 0 AS pos, 0 AS depth, 0 AS most FROM m UNION ALL
      SELECT page_id, s, pos + 1, d, greatest(most, d) FROM (SELECT *, CASE WHEN s[pos + 1] = '{' THEN depth + 1 ELSE greatest(depth - 1, 0) END AS d FROM r WHERE pos < length(s)))
    SELECT page_id, max(most)::BIGINT AS depth FROM r GROUP BY page_id""",
)
def brace_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nesting depth, with the pages' angle brackets as braces."""
    return load(spark, sf_dir, "pages").select("page_id", T.brace_depth(F.translate("html", "<>", "{}")).alias("depth"))


@query(
    "complexity_score",
    rf"""WITH {SOURCE_FILES_SQL} SELECT file_id, least(1.0, round((len(regexp_extract_all(content, '{T.JS_BRANCHES}')) * 0.08::DECIMAL(3,2) + len(regexp_extract_all(content, '\band\b')) * 0.12::DECIMAL(3,2)
      + len(regexp_extract_all(content, '\bfunction\b|=>|\bof\b')) * 0.03::DECIMAL(3,2))::DECIMAL(18,4), 4)::DOUBLE)::DOUBLE AS complexity FROM source_files""",
)
def complexity_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prose words stand for levels and functions."""
    c = F.col("content")
    return source_files(spark, sf_dir).select(
        "file_id", T.complexity(T.js_branches(c), F.regexp_count(c, F.lit(r"\band\b")), F.regexp_count(c, F.lit(r"\bfunction\b|=>|\bof\b"))).alias("complexity")
    )
