"""Golden values and edge cases of the operators."""

import subprocess
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from changelens.functions import parse, text, vectors
from changelens.functions.vectors import cosine_score
from changelens.operators import cochange, control, evaluation, graph, impact, imports, ordered, partners, risk, search, tests_rec
from changelens.sources.upsert import first_wins, last_wins, merge


def one(df, column):
    return df.select(column.alias("v")).first()["v"]


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_cochange_golden(spark):
    touched = frame(spark, [(1, "a"), (1, "b"), (2, "a"), (2, "b"), (3, "b")], "sha int, file_id string")
    changed = frame(spark, [("a",)], "file_id string")
    assert cochange.cosine(touched, changed, 4).collect() == [("b", 0.8165)]
    assert {r["file_id"]: r["score"] for r in cochange.jaccard(touched, changed, 4).collect()} == {"b": 0.6667}
    assert cochange.cosine(touched.where("false"), changed).collect() == []


def test_items_are_dealt_out_by_rows(spark, monkeypatch):
    monkeypatch.setattr(cochange, "_TASK_ROWS", 10)
    items = spark.range(400).selectExpr("id % 40 AS sha", "id % 7 AS file_id")
    commits = spark.range(40).selectExpr("id AS sha", "if(id % 2 = 0, 'Fix', 'Change') AS message")
    assert cochange.dealt(items).rdd.getNumPartitions() == 40 and cochange.dealt(items.limit(80)).rdd.getNumPartitions() < 8
    got = {tuple(r) for r in cochange.bugfix_churn(items, commits).collect()}
    want = {}
    for k in range(400):
        if k % 2 == 0:
            want.setdefault(k % 7, set()).add(k % 40)
    assert got == {(f, len(s)) for f, s in want.items()}


def test_bugfix_and_churn_count_differently(spark):
    items = frame(spark, [(1, "p"), (1, "p"), (2, "p")], "sha int, file_id string")
    commits = frame(spark, [(1, "Fix payment regression"), (2, "Refactor names")], "sha int, message string")
    assert cochange.churn(items).first()["churn"] == 3
    assert cochange.bugfix_churn(items, commits).first()["bugfix"] == 1


def test_reverse_dependents(spark):
    edges = frame(spark, [(2, 1), (3, 2), (1, 3), (4, 1), (3, 4)], "src int, dst int")
    got = {r["file_id"]: r["distance"] for r in graph.reverse_dependents(edges, frame(spark, [(1,)], "file_id int"), 3).collect()}
    assert got == {2: 1, 4: 1, 3: 2, 1: 3}  # a cycle reports the file itself, a diamond its nearest distance


def test_build_edges_keeps_the_first_import(spark):
    rows = [("a", "b", "import", 5, "x"), ("a", "b", "import", 2, "y"), ("a", "a", "import", 1, "z"), ("a", None, "import", 1, "z")]
    got = graph.build_edges(frame(spark, rows, "src string, dst string, edge_type string, pos int, evidence string")).collect()
    assert [(r["src"], r["dst"], r["evidence"]) for r in got] == [("a", "b", "y")]


@pytest.mark.parametrize(
    ("path", "module", "names", "level", "target"),
    [
        ("src/api/routes.py", "src.auth.token", [], 0, "src/auth/token.py"),
        ("pkg/api/routes.py", "auth.token", [], 2, "pkg/auth/token.py"),
        ("src/api/routes.py", "src.auth", ["token"], 0, "src/auth/token.py"),
        ("src/api/routes.py", "nowhere", [], 0, None),
    ],
)
def test_python_imports(spark, path, module, names, level, target):
    files = frame(spark, [("src/auth/token.py",), ("pkg/auth/token.py",)], "path string")
    row = frame(spark, [(1, path, module, names, level)], "import_id int, path string, module string, names array<string>, level int")
    made = row.select("import_id", imports.python_candidates(row.path, row.module, row["names"], row.level).alias("candidates"))
    assert [r["target"] for r in imports.resolve(made, files).collect()] == ([target] if target else [])


def test_script_imports(spark):
    files = frame(spark, [("src/auth/token.ts",), ("src/auth/index.ts",)], "path string")
    rows = frame(spark, [(1, "src/api/routes.ts", "../auth/token"), (2, "src/api/routes.ts", "react"), (3, "src/api/routes.ts", "../auth")], "import_id int, path string, module string")
    made = rows.select("import_id", imports.js_candidates(rows.path, rows.module).alias("candidates"))
    assert {r["import_id"]: r["target"] for r in imports.resolve(made, files).collect()} == {1: "src/auth/token.ts", 3: "src/auth/index.ts"}


def test_dependency_score(spark):
    rows = frame(spark, [(1, 1, 1.0), (2, 1, 0.65), (3, 1, 0.4), (7, 1, 0.2), (2, 3, 0.81), (1, 9, 1.0)], "d int, n int, want double")
    assert rows.where(F.abs(impact.dependency_score(F.col("d"), F.col("n")) - F.col("want")) > 1e-9).count() == 0


def test_final_score_clamps(spark):
    row = frame(spark, [(2.0, 0.5, 0.5, 0.0, 0.5)], "dependency double, semantic double, cochange double, test double, risk double")
    assert row.select(impact.final_score().alias("s")).first()["s"] == pytest.approx(0.35 + 0.125 + 0.1 + 0.05, abs=1e-4)


def test_risk_golden(spark):
    files = frame(spark, [(1, "a.py", "python", 400, False)], "file_id int, path string, language string, loc int, is_test boolean")
    edges = frame(spark, [(i, 1) for i in range(2, 14)] + [(1, 20), (1, 21)], "src int, dst int")
    items = frame(spark, [(s, 1) for s in range(15)], "sha int, file_id int")
    commits = frame(spark, [(s, "fix it" if s < 4 else "add") for s in range(15)], "sha int, message string")
    complexity = frame(spark, [(1, 0.7)], "file_id int, complexity double")
    got = risk.scored(risk.components(files, edges, items, commits, complexity)).first()
    assert got["score"] == pytest.approx(0.76, abs=1e-4)
    assert {"High fan-in", "Frequently changed"} <= set(got["reasons"])
    assert risk.mean(spark.createDataFrame([], "is_test boolean, score double, language string")).first()["mean_risk"] == 0.0


def test_test_recommendation_golden(spark):
    files = frame(
        spark,
        [(1, "src/auth/token.py", False), (2, "tests/test_token.py", True), (3, "src/auth/test_session.py", True), (4, "src/auth/token.test.ts", True), (5, "tests/test_auth_flow.py", True)],
        "file_id int, path string, is_test boolean",
    )
    sources = files.where("file_id = 1")
    edges = frame(spark, [(2, 1)], "src int, dst int")
    touched = frame(spark, [(1, 1), (1, 5)], "sha int, file_id int")
    got = {r["path"]: (r["score"], r["linked"]) for r in tests_rec.recommend(tests_rec.signals(files, sources, edges, touched), files).collect()}
    assert got["tests/test_token.py"] == (0.95, [1])
    assert got["src/auth/token.test.ts"][0] == 0.85
    assert got["src/auth/test_session.py"][0] == 0.55
    assert got["tests/test_auth_flow.py"][0] == 0.75


def test_ranking_metrics_golden(spark):
    scen = frame(spark, [(1, "k", ["b", "c", "d"]), (2, "l", ["b", "c"])], "sha int, known string, truth array<string>")
    preds = frame(spark, [("hybrid", k, i + 1, p) for k in "kl" for i, p in enumerate("abc")], "method string, known string, rn int, path string")
    got = {(r["sha"], r["k"]): r for r in evaluation.metrics(scen, preds, (2, 3)).where("method = 'hybrid'").collect()}
    assert (got[1, 2]["precision"], got[1, 2]["recall"], got[1, 2]["f1"]) == (0.5, 0.3333, 0.4)
    assert (got[2, 3]["mrr"], got[2, 3]["map"], got[2, 3]["ndcg"]) == (0.5, 0.5833, 0.6934)
    none = evaluation.metrics(scen, preds, (5,)).where("method = 'semantic_only'").first()
    assert none["precision"] == none["recall"] == none["mrr"] == none["ndcg"] == 0.0


def test_ranges(spark):
    rows = frame(spark, [("f", 1, 5), ("f", 3, 8), ("f", 10, 12), ("g", 1, 5), ("g", 6, 10)], "file string, start int, end int")
    got = {(r["file"], r["start"], r["end"]) for r in control.merge_ranges(rows, "file").collect()}
    assert got == {("f", 1, 8), ("f", 10, 12), ("g", 1, 10)}


def test_changed_symbols(spark):
    symbols = frame(spark, [("a", "f", 5, 12), ("a", "g", 20, 30), ("b", "h", 1, 2)], "path string, symbol string, start_line int, end_line int")
    changed = frame(spark, [("a", 0, [(25, 26)]), ("a", 1, [(6, 8)]), ("b", 0, [])], "path string, seq int, ranges array<struct<start:int,end:int>>")
    assert {r["symbol"] for r in control.changed_symbols(symbols, changed).collect()} == {"f", "h"}


def test_diffs(spark):
    diff = "diff --git a/x.py b/x.py\n@@ -1,2 +8,4 @@\n@@ -9 +10,7 @@\ndiff --git a/old.py b/new.py\nrename from old.py\nrename to new.py\ndiff --git a/gone.py b/gone.py\ndeleted file mode 100644\n@@ -1,3 +0,0 @@\n"
    rows = frame(spark, [(1, diff), (2, ""), (3, "no diff")], "diff_id int, text string")
    got = [(r["path"], r["change_type"], r["old_path"], [tuple(x) for x in r["ranges"]]) for r in parse.parse_diffs(rows).orderBy("seq").collect()]
    assert got == [("x.py", "modified", "x.py", [(8, 11), (10, 16)]), ("new.py", "renamed", "old.py", []), ("gone.py", "deleted", "gone.py", [])]
    assert [tuple(x) for x in parse.parse_diffs(rows, merged=True).orderBy("seq").first()["ranges"]] == [(8, 16)]


def test_python_parser():
    got = parse.parse_python("import os as o\nfrom a import b\n__all__ = ['x']\nclass K:\n    def m(self):\n        return o.f(1)\n")
    assert [(i["module"], i["alias"]) for i in got["imports"]] == [("os", "o"), ("a", None)]
    assert [(s["qualified"], s["kind"]) for s in got["symbols"]] == [("K", "class"), ("K.m", "method")]
    assert got["exports"] == ["x"] and got["calls"][0]["callee"] == "o.f"
    assert parse.parse_python("def (")["error"] == "SyntaxError" and parse.parse_python(None)["symbols"] == []
    assert parse.python_shape("def f(a):\n    if a:\n        for b in a:\n            if b:\n                pass\n") == (3, 1, 3)


@pytest.mark.parametrize(("path", "want"), [("a/node_modules/b.js", True), ("layout/x.py", True), ("src/coverage_report.py", False), ("yarn.lock", True), ("a/b.min.js", True), ("src/a.py", False)])
def test_ignore(spark, path, want):
    assert one(spark.range(1), text.should_ignore(F.lit(path))) is want


def test_text_functions(spark):
    r = spark.range(1)
    assert one(r, text.count_loc(F.lit("a\n \n\tb\n"))) == 2 and one(r, text.count_loc(F.lit(None).cast("string"))) == 0
    assert one(r, text.is_generated(F.lit("a.py"), F.lit("# auto-generated\n# Do not edit\n"))) is True
    assert one(r, text.normalize_url(F.lit("git@GitHost.com:org/repo.git"))) == "https://githost.com/org/repo"
    assert one(r, text.snippet(F.lit("path: a\nlanguage: b\n\nbody  \nmore"))) == "body\nmore"
    assert one(r, text.brace_depth(F.lit("}{{}{"))) == 2
    assert one(r, text.is_binary(F.lit(b"ab\x00c"))) is True and one(r, text.is_binary(F.lit(b"abc"))) is False


def test_vectors(spark):
    v = frame(spark, [(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, [0.83, 0.5577]), (3, [-1.0, 0.0])], "chunk_id int, embedding array<double>")
    got = {r["chunk_id"]: r["score"] for r in search.topk(v, F.array(F.lit(1.0), F.lit(0.0)), 10).collect()}
    assert got == {0: 1.0, 2: 0.83, 1: 0.0, 3: 0.0}
    assert one(v.where("chunk_id = 0"), vectors.clean(F.array(F.lit(float("nan")), F.lit(2.0), F.lit(None)))) == [0.0, 2.0, 0.0]
    with pytest.raises(Exception, match="expected 3 dimensions"):
        v.select(vectors.validated(F.col("embedding"), 3)).collect()


def test_upserts(spark):
    rows = frame(spark, [("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "k string, t int, v string")
    assert {(r["k"], r["v"]) for r in last_wins(rows, ["k"], "t").collect()} == {("a", "y"), ("b", "z")}
    assert {(r["k"], r["v"]) for r in first_wins(rows, ["k"], "t").collect()} == {("a", "x"), ("b", "z")}
    stored = frame(spark, [("a", 0, "old"), ("c", 0, "kept")], "k string, t int, v string")
    assert {(r["k"], r["v"]) for r in merge(stored, rows, ["k"], "t").collect()} == {("a", "y"), ("b", "z"), ("c", "kept")}


def test_git_source(spark, tmp_path):
    from changelens.sources.git import GitSource

    def git(*args):
        subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=e@x", *args], check=True, capture_output=True)

    git("init", "-q", "--initial-branch=main")
    (tmp_path / "a.py").write_text("one\n")
    git("add", "."), git("commit", "-qm", "first")
    (tmp_path / "a.py").write_text("one\ntwo\n")
    (tmp_path / "b.py").write_text("b\n")
    git("add", "."), git("commit", "-qm", "Fix it\n\nwith a body")
    git("checkout", "-qb", "side", "HEAD~1")
    (tmp_path / "café.py").write_text("x\ny\n")
    (tmp_path / "a b\tc.bin").write_bytes(b"\0\1")
    git("add", "."), git("commit", "-qm", "odd names")
    git("checkout", "-q", "main"), git("merge", "-q", "--no-ff", "-m", "merge", "side")
    spark.dataSource.register(GitSource)

    def read(kind, **options):
        return spark.read.format("git").options(path=str(tmp_path), kind=kind, limit="10", rows_per_task="1", **options).load()

    commits = {r["message"]: r for r in read("commits").collect()}
    assert set(commits) == {"first", "Fix it\n\nwith a body", "odd names", "merge"}
    assert commits["first"]["parent"] is None and commits["merge"]["parent"] == commits["Fix it\n\nwith a body"]["sha"]
    assert (commits["merge"]["insertions"], commits["merge"]["deletions"]) == (2, 0)
    changed = read("commit_files")
    by_sha = {}
    for r in changed.collect():
        by_sha.setdefault(r["sha"], set()).add((r["path"], r["insertions"]))
    assert by_sha[commits["merge"]["sha"]] == by_sha[commits["odd names"]["sha"]] == {("café.py", 2), ("a b\tc.bin", 0)}
    assert changed.select("path").distinct().join(read("files"), "path").count() == 4
    assert {r["path"] for r in read("files", ref="side").collect()} == {"a.py", "café.py", "a b\tc.bin"}
    assert read("content", ref="side", file="a.py").first()["content"] == b"one\n"


def test_python_import_candidates(spark):
    from changelens.operators import imports

    cases = [
        ("pkg/api/routes.py", "", ["token"], 1, ["pkg/api.py", "pkg/api/__init__.py", "pkg/api/token.py", "pkg/api/token/__init__.py"]),
        ("pkg/api/routes.py", "auth.token", ["x"], 2, ["pkg/auth/token.py", "pkg/auth/token/__init__.py", "pkg/auth/token/x.py", "pkg/auth/token/x/__init__.py"]),
        ("pkg/api/routes.py", "", ["a", "*"], 2, ["pkg.py", "pkg/__init__.py", "pkg/a.py", "pkg/a/__init__.py"]),
        ("pkg/api/routes.py", None, ["a"], 3, []),
        ("pkg/routes.py", "a.b", [], 0, ["a/b.py", "a/b/__init__.py"]),
        ("routes.py", "", ["a"], 1, []),
    ]
    df = frame(spark, [(i, *c[:4]) for i, c in enumerate(cases)], "id int, path string, module string, names array<string>, level int")
    got = {r["id"]: r["c"] for r in df.select("id", imports.python_candidates(F.col("path"), F.col("module"), F.col("names"), F.col("level")).alias("c")).collect()}
    assert [got[i] for i in range(len(cases))] == [c[4] for c in cases]


def test_async_code_counts_as_branches_and_nesting():
    from changelens.functions.parse import python_shape

    assert python_shape("async def f():\n    async for x in y:\n        async with z:\n            if x:\n                pass\n") == (2, 1, 3)
    assert python_shape("for a in b:\n    with c:\n        while d:\n            pass\n") == (2, 0, 3)


def test_scripts():
    from changelens.functions.scripts import parse_script

    got = parse_script("import d, { a as b, type T } from \"m\"\nimport './side'\nexport default class extends X {}\nclass A {\n  if(x) { return /[/\"]/.test(x) }\n  #p() { new B(); this.a.b(1) }\n}\nexport const f = (a): number => { g() }\nfoo(`in ${no()} text`)\n")
    assert [(i["module"], i["names"], i["alias"]) for i in got["imports"]] == [("m", ["a", "T"], None), ("./side", [], None)]
    assert [(e["name"], e["line"]) for e in got["exports"]] == [("default", 3), ("f", 8)]
    assert [(s["qualified"], s["kind"], s["start_line"], s["end_line"]) for s in got["symbols"]] == [("A", "class", 4, 7), ("A.if", "method", 5, 5), ("A.#p", "method", 6, 6), ("f", "function", 8, 8)]
    assert [(c["callee"], c["scope"]) for c in got["calls"]] == [("this.a.b", "A"), ("g", None), ("foo", None)]
    assert parse_script(None) == parse_script("") == {"imports": [], "exports": [], "symbols": [], "calls": []}
    for broken in ("(" * 20_000, "'" * 20_001, "/*" * 20_000, "import {" * 5_000, "class A " * 5_000, "a.b" * 20_000, "const a : " * 5_000):
        began = time.process_time()
        parse_script(broken)
        assert time.process_time() - began < 5


def test_diff_with_many_files_and_odd_lines(spark):
    from changelens.functions.parse import parse_diffs

    text = "".join(f"diff --git a/f{i} b/f{i}\n@@ -1 +{i + 1},2 @@\n+diff --git a/no b/no\n+rename to no\n" for i in range(500))
    got = parse_diffs(frame(spark, [(1, text), (2, None), (3, ""), (4, "@@ -1 +1 @@\nnothing before")], "diff_id int, text string")).orderBy("seq").collect()
    assert [(r["diff_id"], r["path"], [(x["start"], x["end"]) for x in r["ranges"]]) for r in got] == [(1, f"f{i}", [(i + 1, i + 2)]) for i in range(500)]


def test_cell_index_recall(spark):
    from changelens.operators import search

    r = np.random.default_rng(1)
    x = r.standard_normal((3000, 48)) + 2 * r.standard_normal((40, 48))[r.integers(0, 40, 3000)]
    chunks = frame(spark, [(i, v.tolist()) for i, v in enumerate(x)] + [(9000, [0.0] * 48)], "chunk_id long, embedding array<double>")
    queries = chunks.where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    exact = {(q["query_id"], q["chunk_id"]) for q in search.batch_topk(chunks, queries, 10).collect() if q["query_id"] != 9000}
    near = {(q["query_id"], q["chunk_id"]) for q in search.ann_topk(chunks, queries, 10).collect()}
    assert len(exact & near) >= 0.9 * len(exact)
    assert search.batch_topk(chunks, queries, 10, broadcast_rows=1).count() == 31 * 10


def test_commits_of_too_many_files_are_skipped(spark):
    from changelens.operators import evaluation as ev

    files = frame(spark, [(i, f"p{i:02}") for i in range(30)], "file_id int, path string")
    touched = frame(spark, [("big", i) for i in range(21)] + [("most", i) for i in range(20)] + [("one", 1)], "sha string, file_id int")
    recent = frame(spark, [("big",), ("most",), ("one",), ("none",)], "sha string")
    got = {r["sha"]: r["skipped"] for r in ev.judged(recent, touched, files).collect()}
    assert got == {"big": "too_many_files", "most": None, "one": "fewer_than_two_code_files", "none": "no_indexed_code_files"}


def test_refresh_replaces_only_its_partitions(spark, tmp_path):
    from changelens.sources import tables_sink

    path = tables_sink.write_generation(frame(spark, [("a", 1), ("b", 2)], "g string, v int"), "g", str(tmp_path))
    tables_sink.refresh(frame(spark, [("b", 3), ("b", 4)], "g string, v int"), "g", path)
    assert sorted(tuple(r) for r in spark.read.parquet(path).select("g", "v").collect()) == [("a", 1), ("b", 3), ("b", 4)]


def test_messages_without_secrets(spark):
    r = spark.range(1)
    said = lambda t: one(r, text.sanitize_paths(F.lit(t)))
    assert said("clone of http://me:pw@host/a.git failed, see mail@host") == "clone of http://****@host/a.git failed, see mail@host"
    assert said("ssh://git@host:22/x and https://host/app/x.py") == "ssh://****@host:22/x and https://host<sanitized_path>"
    assert said('File "/home/me/x.py": no; C:\\Users\\me\\x.txt; d:/data/y z') == 'File "<sanitized_path>": no; <sanitized_path> <sanitized_path> z'
    assert said("nothing: src/app.py, /opt/x") == "nothing: src/app.py, /opt/x" and said("") == "" and one(r, text.sanitize_paths(F.lit(None).cast("string"))) is None


def test_snippets(spark):
    r = spark.range(1)
    cut = lambda t: one(r, text.snippet(F.lit(t)))
    assert cut("path: a\nsymbol: b  \n\n  body  \n\nrest") == "body\n\nrest"
    assert cut("no header  \n\nrest ") == "no header\n\nrest" and cut("path: a\nbody") == "path: a\nbody"
    assert cut("x" * 700) == "x" * 597 + "..." and cut("") == ""


def test_binary_names(spark):
    names = [("a.PNG", True), ("dir.db/x", False), ("lib.so", True), ("x.pyc.txt", False), ("obj.o", True), ("hello", False), ("a.foo", False), (None, None)]
    got = frame(spark, names, "n string, want boolean").select(text.binary_name(F.col("n")).alias("b"), "want").collect()
    assert all(x["b"] == x["want"] for x in got)


def strongest(touched, k):
    """Plain loops over all pairs of all commits."""
    commits = {}
    for sha, file in set(touched):
        commits.setdefault(sha, set()).add(file)
    n, joint = {}, {}
    for members in commits.values():
        for a in members:
            n[a] = n.get(a, 0) + 1
            for b in members - {a}:
                joint[a, b] = joint.get((a, b), 0) + 1
    out = set()
    for a in n:
        mine = sorted((-j * j / n[b], b, j) for (x, b), j in joint.items() if x == a)[:k]
        out |= {(a, i + 1, b, j, round(j / (n[a] * n[b]) ** 0.5, 6)) for i, (_, b, j) in enumerate(mine)}
    return out


@pytest.mark.parametrize("most", [4, 8, 1000])
def test_top_partners_equal_all_pairs(spark, most):
    rng = np.random.default_rng(most)
    touched = [(c, int(f)) for c in range(40) for f in rng.choice(60, rng.integers(1, 7), replace=False)]
    touched += [(100 + c, int(f)) for c in range(6) for f in rng.choice(60, 20, replace=False)]  # large ones
    touched += [(200, f) for f in range(70, 130)]  # an import of files that never change again: all alike
    touched += [(201, f) for f in range(60, 100)] + [(202, 75), (202, 5)]
    df = frame(spark, [*touched, touched[0], (None, 3), (7, None)], "sha int, file_id int")
    got = {(r["file_id"], r["rank"], r["partner"], r["joint"], r["score"]) for r in partners.top_partners(df, 3, most).collect()}
    assert got == strongest(touched, 3)


def test_top_partners_of_a_huge_commit_make_few_pairs(spark):
    """20,000 files in one commit, a tenth of which change in pairs as well: no 4 * 10^8 pairs."""
    once = spark.range(20_000).select(F.lit(-1).alias("sha"), F.col("id").alias("file_id"))
    again = spark.range(2_000).select((F.col("id") % 1000).cast("int").alias("sha"), F.col("id").alias("file_id"))
    began = time.perf_counter()
    got = partners.top_partners(once.union(again), 2).where("file_id IN (3, 1003, 19999)").collect()
    assert {(r["file_id"], r["rank"], r["partner"], r["joint"]) for r in got} == {
        (3, 1, 1003, 2), (3, 2, 2000, 1), (1003, 1, 3, 2), (1003, 2, 2000, 1), (19999, 1, 2000, 1), (19999, 2, 2001, 1),
    }
    assert time.perf_counter() - began < 120


def test_top_partners_of_nothing(spark):
    assert partners.top_partners(frame(spark, [], "sha int, file_id int"), 2).collect() == []
    with pytest.raises(ValueError, match="most_files"):
        partners.top_partners(frame(spark, [], "sha int, file_id int"), 2, most_files=2)


def test_ordered_blocks_equal_plain_windows(spark):
    """One key of 4,000 rows lies in several blocks; a null key, ties and nulls beside it."""
    rows = [(1, i, i * 7919 % 1000) for i in range(4000)] + [(2, i // 2, i) for i in range(10)] + [(None, 1, 5), (None, 2, None), (3, 1, None)]
    df = frame(spark, rows, "k int, o int, v long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be one block
    try:
        dealt = ordered.blocks(df, ["k"], ["o"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert dealt.where("k = 1").select("_block").distinct().count() > 1
    places = ordered.numbered(dealt, ["k"], ["o"]).collect()
    assert sorted(r["place"] for r in places if r["k"] == 1) == list(range(1, 4001)) and all(r["place"] == r["o"] + 1 for r in places if r["k"] == 1)
    assert {(r["k"], r["total"]) for r in places} == {(1, 4000), (2, 10), (3, 1), (None, 2)}
    for how, agg in (("max", "max(v) OVER w"), ("sum", "coalesce(sum(v) OVER w, 0)")):
        got = ordered.running(dealt, ["k"], ["o"], "v", how, "x").select("k", "o", "v", "x")
        want = df.selectExpr("k", "o", "v", f"{agg.replace('w', '(PARTITION BY k ORDER BY o)')} AS x")
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    got = ordered.running(dealt, ["k"], ["o"], "v", "max", "x", own=False).where("k = 1").select("o", "x")
    want = df.where("k = 1").selectExpr("o", "max(v) OVER (ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS x")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert ordered.numbered(ordered.blocks(df.where("false"), ["k"], ["o"]), ["k"], ["o"]).count() == 0


def test_top_partners_of_few_pairs_are_counted_plainly(spark, monkeypatch):
    """Orders of up to seven files, all alike: the bound prunes nothing, so a bound of five must
    not be kept up where the pairs are six a row at most. A file in many commits has many parts."""
    rng = np.random.default_rng(5)
    touched = [(c, int(f)) for c in range(300) for f in {0, *rng.choice(90, rng.integers(1, 7), replace=False)}]
    df = frame(spark, touched, "sha int, file_id int")
    sized = df.groupBy("sha").agg(F.count("*").alias("files"))
    largest = sized.agg(F.max("files")).first()[0]
    assert partners._most_files(sized, 5, 20) == (largest, sum(r["files"] * (r["files"] - 1) for r in sized.collect()))
    assert partners._most_files(sized, 5, 0)[0] == 5 < largest
    monkeypatch.setattr(partners, "_MANY", 50)
    monkeypatch.setattr(partners, "_in_large", None)  # the way by bounds would need it
    got = {(r["file_id"], r["rank"], r["partner"], r["joint"], r["score"]) for r in partners.top_partners(df, 3, 5, row_pairs=20).collect()}
    assert got == strongest(touched, 3)


def test_batch_topk_bounds_keep_all_that_may_be_nearest(spark):
    """Equal to all pairs scored by Spark, without making them: ties by chunk_id, vectors that are
    zero, null, of other lengths, tiny, huge or not finite, and a null chunk_id."""
    rng = np.random.default_rng(11)
    vectors = [[float(x) for x in rng.integers(-2, 3, 4)] for _ in range(400)] + [[float(x) for x in rng.normal(size=4)] for _ in range(400)]
    vectors += [None, [], [0.0] * 4, [1.0, 2.0], [1.0, None, 0.0, 1.0], [float("nan"), 1.0, 1.0, 1.0], [float("inf"), 1.0, 1.0, 1.0], [1e-120] * 4, [1e160] * 4, [3e-170, 0.0, 0.0, 0.0]]
    order = rng.permutation(len(vectors)).tolist()
    chunks = frame(spark, [*((f"c{i}", vectors[i]) for i in order), (None, [1.0, 1.0, 0.0, 0.0])], "chunk_id string, embedding array<double>").repartition(3)
    queries = frame(spark, [(j, vectors[i]) for j, i in enumerate([0, 1, 405, *range(800, 810)])], "query_id int, query_vec array<double>")
    score = cosine_score(F.col("embedding"), F.col("query_vec"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "90")  # several batches a task
    try:
        for k in (1, 7, 300):
            found = search.batch_topk(chunks, queries, k)
            assert not any(x in found._jdf.queryExecution().toString() for x in ("CartesianProduct", "BroadcastNestedLoopJoin"))
            pairs = chunks.crossJoin(queries).select("query_id", "chunk_id", score.alias("score"))
            want = pairs.selectExpr("query_id", "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank", "chunk_id", "score").where(f"rank <= {k}")
            assert sorted(map(str, found.collect())) == sorted(map(str, want.collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert search.batch_topk(chunks, queries.where("false"), 3).count() == 0 == search.batch_topk(chunks.where("false"), queries, 3).count()
