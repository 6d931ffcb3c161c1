"""Merkle manifest, spelling variants and SentencePiece ids against plain loops and the library."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from changelens.llm import merkle, sentencepieces, spelling
from changelens.llm.registry import QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def low(t):
    return t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


# --- Merkle ------------------------------------------------------------------------------


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    return digest(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text)))


def tree(nodes):
    """The root, and for each node what stands left and right of it, upwards."""
    paths = [[] for _ in nodes]
    under = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, over = [], []
        for at in range(0, len(nodes), 16):
            run = nodes[at : at + 16]
            for k in range(len(run)):
                for i in under[at + k]:
                    paths[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
            up.append(digest(*run))
            over.append(sum(under[at : at + 16], []))
        nodes, under = up, over
    return nodes[0], paths


def expected(rows):
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    subs, parts = [], {}
    for s in order:
        mine = sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        sub, paths = tree([leaf(*r) for r in mine])
        subs.append(sub)
        parts[s] = list(zip(mine, paths, strict=True))
    root, tops = tree(subs)
    out = []
    for s, sub, top in zip(order, subs, tops, strict=True):
        for r, path in parts[s]:
            given_ = leaf(r[0], low(r[1]), *r[2:]) if r[0] is not None and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else leaf(*r)
            folded = given_
            for a, b in path + top:
                folded = digest(a, folded, b)
            out.append((r[0], leaf(*r), sub, root, digest(*(a + b for a, b in path + top)), folded, folded == root))
    return sorted(out, key=str)


def manifest_of(spark, tmp_path, rows, parts=3):
    spark.createDataFrame(rows, DOCS).withColumn("digest", F.lit("clash")).withColumn("tree", F.lit("clash")).withColumn("position", F.lit(0)).repartition(parts).write.parquet(f"{tmp_path}/documents.parquet")
    return sorted((tuple(r) for r in merkle.query(spark, str(tmp_path)).collect()), key=str)


def test_merkle_trees_of_every_shape(spark, tmp_path):
    r = random.Random(3)
    sizes = {None: 17, "": 1, "a": 16, "b": 256, "hot": 700, "é": 15, "z": 33}
    rows = []
    for s, n in sizes.items():
        for i in range(n):
            rows.append((r.randrange(10**6), "Text %d of %s" % (i, s), "en", s, i))
    rows += [(7, "same", "en", "b", 4)] * 3 + [(None, None, None, None, None)] * 2 + [(8, None, None, "a", None), (9, "", "", "a", 0), (10, "Ä|🙂" * 9000, "de", "hot", 1)]
    assert manifest_of(spark, tmp_path, rows) == expected(rows)


def test_merkle_of_many_sources_and_of_one_leaf(spark, tmp_path):
    many = [(i, "t", "en", f"s{i:03}", 1) for i in range(290)]
    assert manifest_of(spark, tmp_path / "many", many) == expected(many)
    one = [(5, "T", "en", "s", 1)]
    assert manifest_of(spark, tmp_path / "one", one, 1) == expected(one)
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert merkle.query(spark, f"{tmp_path}/none").collect() == []


def test_merkle_finds_what_was_changed(spark, tmp_path):
    rows = [(i, "Word %d" % i, "en", "s%d" % (i % 3), 1) for i in range(120)]
    got = manifest_of(spark, tmp_path, rows)
    changed = {r[0] for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0}
    assert changed and {r[0] for r in got if not r[-1]} == changed


def test_runs_are_put_together_from_any_cut(spark):
    digests = [digest(str(i)) for i in range(100)]
    nodes = spark.createDataFrame([(0, i, d, 100) for i, d in enumerate(digests)], "tree long, position long, digest string, n long")
    for cut in (nodes.coalesce(1).sortWithinPartitions("position"), nodes.repartition(7), nodes.repartitionByRange(9, "position").sortWithinPartitions("position")):
        levels, roots = merkle._grown(cut)
        assert [r["digest"] for r in roots.collect()] == [tree(digests)[0]]
        assert [x.count() for x in levels] == [7, 1]


# --- spelling ----------------------------------------------------------------------------


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants_of(rows, every=97, least=3):
    count = Counter()
    for doc, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = low(w)
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            if h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            count[w] += 1
    words = {w: n for w, n in count.items() if len(w) >= 5 and n >= least}
    form, out = {}, []
    nears = {w: [x for x in words if near(w, x)] for w in words}
    for w, xs in nears.items():
        best = min(xs, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(nears[w]), words.get(form[w])))
    return sorted(out, key=str)


def spelled(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("clash")).withColumn("n", F.lit(1)).withColumn("r", F.lit(1)).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    return sorted((tuple(r) for r in spelling.query(spark, str(tmp_path)).collect()), key=str)


def test_spelling_equals_all_pairs(spark, tmp_path):
    r = random.Random(11)
    base = ["letter", "lettre", "stelle", "grüßen", "ÉCOLES", "aaaaaa", "banana", "Over×÷y"]
    def misspelt(w):
        i = r.randrange(len(w))
        return r.choice([w, w, w, w[:i] + w[i + 1 :], w[:i] + r.choice("aeiéz") + w[i:], w[:i] + r.choice("aeisÿ") + w[i + 1 :]])
    rows = [(r.choice([None, *range(200)]), " ".join(misspelt(misspelt(r.choice(base))) for _ in range(40)) + r.choice([",", "1x", "\n"])) for _ in range(250)]
    rows += [(1, None), (2, ""), (None, None), (3, "ab cd"), (4, "same words again " * 50), (4, "same words again " * 50)]
    want = variants_of(rows)
    assert len(want) > 100 and any(x[1] and x[1] != x[2] for x in want) and any(x[1] is None and x[4] for x in want)
    assert spelled(spark, tmp_path, rows) == want


def test_spelling_of_long_words_and_hot_words(spark, tmp_path):
    long = "ab" * 15_000
    rows = [(i, f"{long} " * 3 + "hotword " * 2000 + f"hotwurd {long[:-1]}c {long}q") for i in range(8)]
    got = {r[0]: r for r in spelled(spark, tmp_path, rows)}
    assert got[long + "q"][1] == got[long[:-1] + "c"][1] == long and got[long][4] == 2
    assert got["hotwurd"][1] == "hotword"


def test_spelling_of_nothing(spark, tmp_path):
    assert spelled(spark, tmp_path / "a", [(1, None), (2, "")]) == []
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/b/documents.parquet")
    assert spelling.query(spark, f"{tmp_path}/b").collect() == []


def test_chains_of_forms_end_at_the_root(spark):
    words = [("a" * 9 + chr(97 + i), 3 * 2**i) for i in range(1)] + [("x" * i + "y" * (30 - i), 2**i) for i in range(1, 30)]
    got = {r["word"]: r["root"] for r in spelling.variants(spark.createDataFrame(words, "word string, n long")).collect()}
    assert {got["x" * i + "y" * (30 - i)] for i in range(1, 30)} == {"x" * 29 + "y"}


# --- SentencePiece -----------------------------------------------------------------------

PIECES = st.lists(st.sampled_from([" ", "  ", "▁", "\n", "\r\n", "the", "ing", "é", "中文", "😀", "\x00", "\x01", "<s>", "<0x0A>", "1", "...", "))", ";", "￿"]) | st.text(max_size=8).filter(lambda t: t.encode("utf-8", "ignore").decode() == t), max_size=30).map("".join)


@pytest.fixture(scope="module")
def vocabulary():
    return sentencepieces.Vocabulary(sentencepieces.default_path())


@settings(max_examples=300, deadline=None)
@given(st.lists(PIECES, max_size=6))
def test_ids_and_texts_are_the_librarys(vocabulary, texts):
    mine = vocabulary.encode(texts)
    theirs = vocabulary.library.encode(texts, add_bos=True, add_eos=True)
    assert [x.tolist() for x in mine] == theirs
    assert vocabulary.decode(mine) == [vocabulary.library.decode(x) for x in theirs]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 31_999) | st.integers(3, 258), max_size=20).filter(lambda x: not any(i in (1, 2) for i in x)))
def test_any_ids_decode_as_the_librarys(vocabulary, ids):
    assert vocabulary.decode([np.array(ids, dtype="<u4")]) == [vocabulary.library.decode(ids)]


@settings(max_examples=100, deadline=None)
@given(PIECES.filter(bool))
def test_the_agenda_alone_gives_the_symbols_of_the_cut_text(vocabulary, text):
    text = sentencepieces.SPACE + text.replace(" ", sentencepieces.SPACE)
    whole = [vocabulary.id.get(s) for s in vocabulary.merge(text)]
    cut, _ = vocabulary._section_ids([text])
    assert [i for i in whole if i is not None] == [i for i in cut.tolist() if vocabulary.kind[i] != sentencepieces._BYTE]


def test_sections_and_slices_change_nothing(vocabulary, monkeypatch):
    texts = ["ab" * 4000, " " * 900, "x" * 3000, None, "", "word and words, wörter 中文 " * 200]
    want = [x.tolist() for x in vocabulary.encode(texts)]
    monkeypatch.setattr(sentencepieces, "_SECTION", 50)
    assert [x.tolist() for x in vocabulary.encode(texts)] == want


def test_every_document_agrees_with_the_library(spark, vocabulary):
    sf = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in QUERIES["op13_sentencepiece"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs) and all(r["agrees"] for r in got.values())
    for d in docs:
        ids = vocabulary.library.encode(d["text"], add_bos=True, add_eos=True)
        r = got[d["doc_id"]]
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(vocabulary.library.decode(ids).encode()).hexdigest()


def test_odd_rows(spark, tmp_path):
    rows = [(None, None), (1, ""), (1, ""), (2, None), (3, "very long " * 50_000), (4, " "), (5, "\x00")]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("decoded", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    got = sentencepieces.query(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and all(r["agrees"] for r in got)
    nothing = hashlib.sha256(b"").hexdigest()
    assert sum(r["n_tokens"] == 2 and r["decoded_sha256"] == nothing for r in got) == 4
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert sentencepieces.query(spark, f"{tmp_path}/none").collect() == []
