"""Embedded texts, mixed commit items, path counts, interval joins, stored tables and generations."""

import hashlib
import json
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from changelens.operators import commit_items, control, embed, graph, intervals, name_index
from changelens.sources.store import StoredTable, active_rows, write_generations

# --- text to vector ----------------------------------------------------------------------


def features(text):
    return re.findall("[a-z]+|[0-9]+", (text or "")[:2048].lower())


def vectors_by_hand(texts, asked):
    """The vectors of asked texts, with weights fitted on texts."""
    with_ = Counter(t for x in texts for t in set(features(x)))
    out = []
    for x in asked:
        v = [0] * 64
        for t in features(x):
            if t in with_:
                weight = round(256 * math.log((len(texts) + 1) / (with_[t] + 1))) + 256
                for b in hashlib.md5(t.encode()).digest()[:4]:
                    v[b % 64] += weight * (1 - 2 * (b // 64 % 2))
        out.append(v)
    return out


def cosine(a, b):
    n = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return max(0.0, min(1.0, sum(x * y for x, y in zip(a, b, strict=True)) / n)) if n else 0.0


@pytest.fixture(scope="module")
def code():
    r = random.Random(4)
    words = "parse token tree node ledger account price order user login mail cart stock tax".split()
    return [(i, f"src/{words[i % 14]}/{r.choice(words)}_{i}.py\ndef {r.choice(words)}_{r.choice(words)}(): " + " ".join(r.choices(words, k=8))) for i in range(120)] + [(500, None), (501, " \n"), (502, "x" * 3000 + " tail")]


def test_vectors_and_rankings_equal_plain_loops(spark, code):
    texts = spark.createDataFrame(code, "chunk_id long, text string")
    weights = embed.fit(texts)
    vectors = embed.embed(texts.withColumnRenamed("chunk_id", "id"), weights).withColumnRenamed("id", "chunk_id")
    want = dict(zip([i for i, _ in code], vectors_by_hand([t for _, t in code], [t for _, t in code]), strict=True))
    assert {r["chunk_id"]: r["embedding"] for r in vectors.collect()} == want
    changes = [(1, "src/ledger/tax_9.py"), (1, "src/price/order_2.py"), (2, "src/login/mail.py")]
    symbols = [(1, "ledger_tax"), (2, "login_user"), (2, "mail_user")]
    asked = embed.change_texts(spark.createDataFrame(changes, "change_id int, path string"), spark.createDataFrame(symbols, "change_id int, name string"))
    got = embed.nearest_chunks(asked, vectors, weights, 10).collect()
    lines = {c: "\n".join(["Changed files:", *sorted(p for i, p in changes if i == c), "Changed symbols:", *sorted(n for i, n in symbols if i == c)]) for c in (1, 2)}
    rankings = {}
    for c in (1, 2):
        q = vectors_by_hand([t for _, t in code], [lines[c]])[0]
        order = sorted(((-round(cosine(q, v), 4), i) for i, v in want.items()))[:10]
        rankings[c] = [r["chunk_id"] for r in sorted((r for r in got if r["query_id"] == c), key=lambda r: r["rank"])]
        assert rankings[c] == [i for _, i in order]
    assert rankings[1] != rankings[2]


def test_only_missing_texts_are_embedded(spark, code):
    texts = spark.createDataFrame([*code, (3, "a second text of a chunk")], "chunk_id long, text string")
    old = spark.createDataFrame([(0, [1.0] * 64), (77, [2.0] * 64)], "chunk_id long, embedding array<double>")
    got = {r["chunk_id"]: r["embedding"] for r in embed.embed_missing(texts, old, embed.fit(texts)).collect()}
    assert got[0] == [1.0] * 64 and got[77] == [2.0] * 64 and len(got) == len(code)
    assert embed.embed_missing(texts.where("false"), old, embed.fit(texts)).count() == 2


# --- commit items ------------------------------------------------------------------------


def paths_by_hand(lists):
    renamed, plain, churn = set(), set(), Counter()
    for sha, text in lists:
        try:
            found = json.loads(text) if text else None
        except ValueError:
            found = None
        for item in found if isinstance(found, list) else []:
            if isinstance(item, str):
                renamed.add((sha, item))
                plain.add((sha, item))
            elif isinstance(item, dict):
                if p := item.get("path") or item.get("new_path") or item.get("old_path"):
                    renamed.add((sha, str(p)))
                if p := item.get("path"):
                    plain.add((sha, str(p)))
                    churn[str(p)] += 1
    return renamed, plain, churn


def test_three_shapes_of_commit_items(spark):
    lists = [
        (1, '["a", {"path": "b"}, {"new_path": "c", "old_path": "d"}, {"old_path": "e"}, "a", {"path": "b"}]'),
        (2, '[{"path": null, "new_path": "f"}, {"path": ""}, {}, null, 5, true, ["x"], ""]'),
        (3, None), (4, "[]"), (5, "no json ["), (6, '{"path": "g"}'), (7, "null"), (8, '[{"path": 12}]'), (1, '["a"]'),
    ]
    df = spark.createDataFrame(lists, "sha int, changed_files string")
    renamed, plain, churn = paths_by_hand(lists)
    assert {tuple(r) for r in commit_items.renamed_paths(df).collect()} == renamed
    assert {tuple(r) for r in commit_items.plain_paths(df).collect()} == plain
    assert {r["path"]: r["churn"] for r in commit_items.churn_counts(df).collect()} == dict(churn)
    assert commit_items.renamed_paths(df.where("false")).count() == 0


# --- path counts -------------------------------------------------------------------------


def test_shortest_paths_on_cyclic_graphs(spark):
    r = random.Random(8)
    pairs = {(r.randrange(25), r.randrange(25)) for _ in range(90)} | {(1, 2), (2, 1), (3, 3)}
    back = {}
    for s, d in pairs:
        back.setdefault(d, set()).add(s)
    want = set()
    for start in (1, 3, 7):
        paths, seen = [(start,)], {}
        for d in range(1, 5):
            paths = [(*p, x) for p in paths for x in back.get(p[-1], ())]
            # Only shortest paths go on: one that ends where an earlier level was is none.
            paths = [p for p in paths if seen.get(p[-1], d) == d]
            for p in paths:
                seen.setdefault(p[-1], d)
            for x, n in Counter(p[-1] for p in paths).items():
                want.add((start, x, d, n))
    edges = spark.createDataFrame([*pairs, *list(pairs)[:10]], "src int, dst int")
    got = graph.shortest_paths(edges, spark.createDataFrame([(1,), (3,), (7,)], "file_id int"), 4).collect()
    assert {(r["start"], r["file_id"], r["distance"], int(r["paths"])) for r in got} == want and len(got) == len(want)
    near = graph.reverse_dependents(edges, spark.createDataFrame([(1,), (3,), (7,)], "file_id int"), 4).collect()
    assert {(r["start"], r["file_id"], r["distance"]) for r in got} == {tuple(r) for r in near}


# --- intervals ---------------------------------------------------------------------------


def test_each_overlap_comes_once(spark):
    r = random.Random(2)
    some = lambda n: [(r.choice("ab"), i, s, s + r.choice([0, 1, 3, 63, 64, 65, 500, 40_000, -2])) for i in range(n) for s in [r.randrange(0, 3000)]]
    left, right = some(150), [*some(120), ("a", 900, 0, 10**6), ("c", 901, 5, 6)]
    got = intervals.overlaps(spark.createDataFrame(left, "k string, l int, l_start int, l_end int"), spark.createDataFrame(right, "k string, r int, r_start int, r_end int"), "k")
    want = sorted((x[1], y[1]) for x in left for y in right if x[0] == y[0] and x[2] <= x[3] and y[2] <= y[3] and x[2] <= y[3] and y[2] <= x[3])
    assert sorted((r_["l"], r_["r"]) for r_ in got.collect()) == want
    assert intervals.overlaps(spark.createDataFrame([], "k string, l_start int, l_end int"), spark.createDataFrame(right, "k string, r int, r_start int, r_end int"), "k").count() == 0


def test_one_large_file_takes_linear_time(spark):
    n = 300_000
    symbols = spark.range(n).select(F.lit("f").alias("path"), F.col("id").alias("symbol"), (F.col("id") * 10).alias("start_line"), (F.col("id") * 10 + 8).alias("end_line"))
    ranges = spark.range(n // 10).select((F.col("id") * 100 + 5).alias("start"), (F.col("id") * 100 + 12).alias("end"))
    changed = ranges.agg(F.collect_list(F.struct("start", "end")).alias("ranges")).select(F.lit("f").alias("path"), F.lit(0).alias("seq"), "ranges")
    assert control.changed_symbols(symbols, changed).count() == n // 10 * 2


# --- stored tables -----------------------------------------------------------------------


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


SCHEMA = "repo string, sha int, at int, note string"


def test_upserts_against_a_dict(spark, tmp_path):
    r = random.Random(6)
    for pick, replace in (("last", True), ("first", True), ("last", False), ("first", False)):
        table = StoredTable(spark, ["repo", "sha"], f"file://{tmp_path}/{pick}{replace}", buckets=5)
        want = {}
        for n in (60, 0, 40, 1):
            batch = [(r.choice(["a", "b", None]), r.randrange(30), at, f"n{at}") for at in r.sample(range(10**6), n)]
            table.upsert(spark.createDataFrame(batch, SCHEMA), "at", pick, replace)
            best = {}
            for row in sorted(batch, key=lambda x: x[2], reverse=pick == "first"):
                best[row[:2]] = row
            for k, row in best.items():
                if None in k or replace or k not in want:  # a null key equals none
                    want[(*k, len(want)) if None in k else k] = row
        assert rows_of(table.read()) == sorted(want.values(), key=str)


def test_a_failed_write_leaves_the_version_before(spark, tmp_path):
    table = StoredTable(spark, ["sha"], f"file://{tmp_path}/t", buckets=4)
    first = spark.createDataFrame([(i, i, "x") for i in range(20)], "sha int, at int, note string")
    table.upsert(first, "at")
    broken = first.withColumn("note", F.when(F.col("sha") == 7, F.raise_error(F.lit("broken")).cast("string")).otherwise("y"))
    with pytest.raises(Exception, match="broken"):
        table.upsert(broken, "at")
    assert table.versions() == [1] and rows_of(table.read()) == rows_of(first)
    assert len(list((tmp_path / "t" / "data").iterdir())) == 1


def test_two_writers_of_one_version(spark, tmp_path):
    table = StoredTable(spark, ["sha"], f"file://{tmp_path}/t", buckets=4)
    one = spark.createDataFrame([(1, 1)], "sha int, at int")
    table.upsert(one, "at")
    late = table._manifest()
    table.upsert(spark.createDataFrame([(1, 2)], "sha int, at int"), "at")
    with pytest.raises(Exception, match="(?i)exist"):
        table._rewrite(late, one.schema, table._bucketed(one), [0])
    assert rows_of(table.read()) == [(1, 2)] and rows_of(table.read(1)) == [(1, 1)]
    assert sorted(f.name for f in (tmp_path / "t" / "_versions").iterdir() if not f.name.endswith(".crc")) == ["00000001.json", "00000002.json"]


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    table = StoredTable(spark, ["sha"], f"file://{tmp_path}/t", buckets=16)
    table.upsert(spark.createDataFrame([(i, i) for i in range(200)], "sha int, at int"), "at")
    before = table._manifest()["folders"]
    table.upsert(spark.createDataFrame([(3, 1000)], "sha int, at int"), "at")
    after = table._manifest()["folders"]
    assert sum(before[b] != after[b] for b in before) == 1
    table.delete(spark.createDataFrame([(3,), (4,)], "sha int"))
    assert table.read().count() == 198
    table.upsert(spark.createDataFrame([(5, 1)], "sha int, at int"), "at", replace=False)
    assert table.read().count() == 198 and table.read().where("sha = 5").first()["at"] == 5
    with pytest.raises(ValueError, match="other columns"):
        table.upsert(spark.createDataFrame([(5,)], "sha int"), "sha")


# --- generations -------------------------------------------------------------------------


def test_old_generations_are_not_read(spark, tmp_path):
    facts = spark.range(4000).select(F.col("id").alias("file_id"), (F.col("id") % 8).alias("generation"))
    path = write_generations(facts, f"file://{tmp_path}/facts")
    pointers = spark.createDataFrame([(1, 3), (2, 5)], "repository int, generation long")
    got = active_rows(spark.read.parquet(path), pointers, 1)
    assert got.select("file_id").distinct().count() == 500
    assert "dynamicpruning" in got._jdf.queryExecution().explainString(got.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")).lower()
    read = got.select(F.input_file_name().alias("f")).distinct().collect()
    assert read and all("generation=3/" in r["f"] for r in read)


# --- names -------------------------------------------------------------------------------


def test_indexed_search_equals_the_scan(spark):
    r = random.Random(12)
    names = [(i, "".join(r.choice("abAB/_%\\é. ") for _ in range(r.randrange(0, 14)))) for i in range(600)] + [(900, None), (901, "Kab"), (902, "aab" * 5000)]
    df = spark.createDataFrame(names, "id int, name string")
    index = name_index.postings(df)
    for pattern in ["%aba%", "%AB/%b%", "%a\\_b%", "aab%", "%", "%ab%", "%éab%", "", "%zzz%", "%aab%aab%aab%", "%kab%", "_ab_a%", "%a\\%b%"]:
        want = sorted(x["id"] for x in df.where(F.ilike("name", F.lit(pattern))).collect())
        assert sorted(x["id"] for x in name_index.search(df, index, pattern).collect()) == want, pattern
        name_index._FEW, before = 0, name_index._FEW
        try:
            assert sorted(x["id"] for x in name_index.search(df, index, pattern).collect()) == want, pattern
        finally:
            name_index._FEW = before
    assert name_index.search(df, index, "%aab%").count() and name_index.search(df.where("false"), name_index.postings(df.where("false")), "%aab%").count() == 0


def test_texts_are_dealt_out_and_rare_weights_shuffled(spark, monkeypatch):
    """Vectors don't depend on how many texts a task has or how many weights are broadcast; a
    scan of one split must not sum all texts in one task, nor all weights be broadcast."""
    texts = spark.createDataFrame([(i, f"src run_{i} p{i % 7} word{'x' * (i % 5)} src") for i in range(60)] + [(60, ""), (61, None)], "id int, text string").coalesce(1)
    weights = embed.fit(texts).where("token <> 'p'").localCheckpoint()  # one that it does not know
    whole = sorted(map(tuple, embed.embed(texts, weights).collect()))
    assert len(whole) == 62 and whole[60][1] == whole[61][1] == [0.0] * embed.SIZE
    monkeypatch.setattr(embed, "_TASK_TEXTS", 7)
    monkeypatch.setattr(embed, "_COMMON", 3)
    dealt = embed.embed(texts, weights)
    assert sorted(map(tuple, dealt.collect())) == whole
    assert dealt.rdd.getNumPartitions() == 9
    assert sorted(embed.fit(texts).collect()) == sorted(spark.createDataFrame(embed.fit(texts.repartition(5)).collect()).collect())
