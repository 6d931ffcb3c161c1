"""The training-data operators against brute force, and their edge cases."""

import hashlib
import itertools
import math
import pickle
import random
import re
import time
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from changelens.llm import chat_format, common, decontaminate, embedding_dedup, html_extract, language_id, lm_score, minhash_dedup, packing, quality, tokens, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string"


def words(text):
    return WORD.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def grams(text, n):
    w = words(text)
    n = min(n, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()


def made(seed, n_words, vocabulary=400):
    r = random.Random(seed)
    return " ".join("w%d" % int(vocabulary * r.random() ** 2) for _ in range(n_words))


EDGE_TEXTS = [None, "", " \n\t", "one", "É one\u00a0two", "x " * 5000, "same words here", "same words here", "🙂 中文 text", "A" * 30000]


# --- words -------------------------------------------------------------------------------


def test_word_hashes_follow_the_words(monkeypatch):
    monkeypatch.setattr(common, "_CHUNK", 64)
    texts = [t or "" for t in EDGE_TEXTS] + [made(i, 300) for i in range(5)]
    seen = {}
    for t in texts:
        h = common.word_hashes(t.encode())
        w = words(t)
        assert len(h) == len(w)
        for a, b in zip(w, h.tolist(), strict=True):
            assert seen.setdefault(a, b) == b
    assert len(set(seen.values())) == len(seen)


def test_components(spark):
    r = random.Random(5)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(7, 7)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {r["node"]: r["component"] for r in common.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert common.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


# --- 1: html -----------------------------------------------------------------------------


def page(i, body, url="http://h.example.com/x"):
    return (i, url, body)


def extracted(spark, pages, **kw):
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    return {r["page_id"]: r["text"] for r in html_extract.extract(df.withColumn("host", F.lit("clash")).withColumn("text", F.lit(1)), **kw).collect()}


def test_html_structure(spark):
    got = extracted(
        spark,
        [
            page(1, '<html><head><title>t</title></head><body><nav><a>menu</a></nav><article><h1>Head</h1><p>a <b>b</b>c &amp;&lt;&nbsp;d<br>e<script>var x="</p>";</script><aside>side</aside><div class="comments"><p>reader</p></div></article><footer>f</footer>'),
            page(2, None),
            page(3, ""),
            page(4, '<div class="ad">buy<article><p>kept', None),
            page(5, "<main><form>name</form><p>x\n\n  y</p><!-- no --><style>p{}</style></main>"),
            page(5, "<main><form>name</form><p>x\n\n  y</p><!-- no --><style>p{}</style></main>"),
        ],
    )
    assert got == {1: "Head a bc &< d e", 2: "", 3: "", 4: "kept", 5: "x y"}
    assert extracted(spark, []) == {}


def test_repeated_runs_go_where_structure_is_open(spark):
    boiler = "we use small files to keep this site running well for all"
    pages = [page(i, f"<body><div>{boiler}</div><p>{made(i, 30, 100000)}</p></body>") for i in range(5)]
    got = extracted(spark, pages)
    assert got == {i: made(i, 30, 100000) for i in range(5)}
    assert all(boiler in t for t in extracted(spark, pages[:2]).values())  # two pages are no proof


def test_runs_are_counted_over_all_shards_of_a_host(spark):
    rare, twice = "this notice stands on three pages of the whole host only", "this passage stands on one page and on its exact copy"
    pages = [page(i, f"<body><p>{made(i, 30, 100000)}</p><div>{rare if i < 3 else ''}</div></body>") for i in range(40)]
    pages += [page(i, f"<body><p>{made(99, 30, 100000)}</p><div>{twice}</div></body>") for i in range(40, 48)]
    pages += [page(50, f"<article>{rare}</article>"), page(51, f"<body>{rare}</body>", "http://other.example.com/")]
    got = extracted(spark, pages, shard_pages=4)
    assert got == extracted(spark, pages)
    assert all(got[i] == made(i, 30, 100000) for i in range(3)) and all(twice in got[i] for i in range(40, 48))
    assert got[50] == got[51] == rare


def test_hosts_without_landmarks_equal_brute_force(spark):
    """What repetition decides, over several hosts, one of them dealt to many shards."""
    r = random.Random(6)
    notices = [" ".join(f"n{k}x{j}" for j in range(r.randint(9, 20))) for k in range(12)]
    pages, bodies = [], {}
    for i in range(260):
        host = "large.example.com" if i < 200 else f"h{i % 4}.example.com"
        parts = [made(i, r.randint(5, 30), 10**6)] + r.sample(notices, r.randint(0, 3))
        r.shuffle(parts)
        pages.append((i, "".join(f"<div>{p}</div>" for p in parts), f"http://{host}/{i}"))
        bodies[i] = (host, " ".join(parts).split())
    pages += [(1000, pages[0][1], pages[0][2])] * 2  # copies of a page are one page
    bodies[1000] = bodies[0]
    where = {}
    for host, w in bodies.values():
        for at in range(len(w) - 7):
            where.setdefault((host, tuple(w[at : at + 8])), set()).add(tuple(w))
    want = {}
    for i, (host, w) in bodies.items():
        gone = {k for at in range(len(w) - 7) if len(where[host, tuple(w[at : at + 8])]) >= 3 for k in range(at, at + 8)}
        want[i] = " ".join(x for k, x in enumerate(w) if k not in gone)
    assert sum(len(want[i]) < len(" ".join(bodies[i][1])) for i in want) > 100
    rows = [page(i, body, url) for i, body, url in pages]
    for size in (7, 96, 10_000):
        assert extracted(spark, rows, shard_pages=size) == want


@pytest.mark.parametrize("broken", ["<a" + " a = b" * 10_000, "<img" + " a = b" * 10_000 + 'x"y>', "<a <a " * 10_000, '<a x="> " ' * 10_000, '<a x="y>' * 10_000, "<!" * 50_000, '<p class="' * 10_000, "&#" + "1" * 9000 + "; &#0000000000065;"])
def test_broken_markup_takes_linear_time(broken):
    began = time.process_time()
    html_extract.blocks(broken + "<p>end")
    assert time.process_time() - began < 2


def test_long_and_odd_references():
    assert html_extract.blocks("<p>&#00000000000000065;&#x00000000041;&#" + "9" * 9000 + ";&amp;lt;") == [(1, "AA\ufffd&lt;")]
    assert html_extract.blocks("<article><p title='a > b' class=x>y<br/>z</p></article>") == [(0, "y"), (0, "z")]
    assert html_extract.blocks('<article><p data-x="class=ad">kept</p><div class="x"id="ad">gone</div></article>') == [(0, "kept"), (2, "gone")]


def test_repeated_equals_brute_force():
    r = np.random.default_rng(3)
    for _ in range(30):
        streams = [r.integers(0, 3, r.integers(0, 40)).astype(np.uint64) for _ in range(4)]
        pages = np.array([0, 1, 2, 2])
        got = html_extract.repeated(streams, pages, 5, 2)
        where = {}
        for p, s in zip(pages, streams, strict=True):
            for i in range(len(s) - 4):
                where.setdefault(tuple(s[i : i + 5]), set()).add(p)
        for s, flags in zip(streams, got, strict=True):
            want = np.zeros(len(s), dtype=bool)
            for i in range(len(s) - 4):
                if len(where[tuple(s[i : i + 5])]) >= 2:
                    want[i : i + 5] = True
            assert (want == flags).all()


# --- 2 and 5: classifiers ----------------------------------------------------------------


def test_quality_learns_and_scores_everything(spark):
    good = [(i, made(i, 80).capitalize() + ".", 1) for i in range(120)]
    bad = [(1000 + i, " ".join(w + "$$%" for w in made(i, 60).split()), 0) for i in range(60)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in good + bad] + [(5000 + i, t) for i, t in enumerate(EDGE_TEXTS)], DOCS)
    labels = spark.createDataFrame([(i, q) for i, _, q in good + bad] + [(None, 1), (3, None), (4, 1)], "doc_id long, quality int")
    model = quality.fit(docs.where("doc_id % 3 <> 0"), labels)
    got = {r["doc_id"]: r for r in quality.score(docs.withColumn("score", F.lit("clash")), model).collect()}
    assert all(got[i]["predicted"] == q for i, _, q in good + bad)
    assert all(0 <= r["score"] <= 1 for r in got.values()) and len(got) == docs.count()
    empty = quality.fit(docs.where("false"), labels)
    assert quality.score(docs, empty).where("score IS NULL").count() == 0


def test_pair_tables_carry_interactions():
    r = np.random.default_rng(0)
    x = r.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    with_pairs, without = quality.boost(x, y, n_pairs=2), quality.boost(x, y, n_pairs=0)
    accuracy = [((m.score(x) > 0.5) == y).mean() for m in (with_pairs, without)]
    assert accuracy[0] > 0.93 and accuracy[1] < 0.7


def test_language_id(spark):
    tongues = {"aa": "kalo meri tanu sipo", "bb": "grzk vsch plnt thrx", "cc": "ουκ εστι λογος παν"}

    def text(lang, seed):
        r = random.Random(seed)
        letters = tongues[lang].replace(" ", "")
        return " ".join("".join(r.choice(letters) for _ in range(r.randint(2, 7))) for _ in range(60))

    rows = [(i, text(lang, i), lang) for i, lang in enumerate(list(tongues) * 60)] + [(9000, "kalo", None)]
    docs = spark.createDataFrame(rows, DOCS + ", lang string")
    model = language_id.fit(docs.where("doc_id % 4 <> 0"))
    got = {r["doc_id"]: r for r in language_id.predict(docs, model).collect()}
    assert all(got[i]["lang_pred"] == lang and not got[i]["rejected"] for i, _, lang in rows[:-1])
    odd = spark.createDataFrame([(0, None), (1, ""), (2, "123 !?"), (3, "漢字仮名" * 50), (4, "kalo " * 400_000)], DOCS)
    odd = {r["doc_id"]: r for r in language_id.predict(odd, model).collect()}
    assert [odd[i]["lang_pred"] for i in (0, 1, 2)] == ["und"] * 3 and all(odd[i]["score"] == 0 for i in (0, 1, 2))
    assert odd[3]["rejected"] and odd[4]["lang_pred"] == "aa"
    none = language_id.predict(docs, language_id.fit(docs.where("false")))
    assert none.where("lang_pred <> 'und'").count() == 0


def test_gram_counts_do_not_depend_on_chunks(monkeypatch):
    text = made(1, 400) + " ... ünï 12 " + made(2, 50)
    whole = language_id.gram_counts(text)
    for size in (7, 64, 1000):
        monkeypatch.setattr(language_id, "_CHUNK", size)
        assert (language_id.gram_counts(text) == whole).all()


def test_foreign_texts_are_rejected(spark):
    """Texts in an alphabet of which the model knows a few letters, mixed in; own ones stay."""
    r = random.Random(4)

    def text(letters, n):
        return " ".join("".join(r.choice(letters) for _ in range(r.randint(2, 7))) for _ in range(n))

    own = [(i, text("kalomerit" if i % 2 else "grzkvschpl", 20 + i % 300), "aa" if i % 2 else "bb") for i in range(600)]
    foreign = [(1000 + i, text("qwxyjfuden", 20 + i), None) for i in range(100)]
    docs = spark.createDataFrame(own + foreign, DOCS + ", lang string")
    model = language_id.fit(docs.where("doc_id % 3 <> 0"))
    got = {x["doc_id"]: x["rejected"] for x in language_id.predict(docs.withColumn("rejected", F.lit("clash")), model).collect()}
    assert sum(got[i] for i, _, _ in own) <= 3
    assert sum(got[i] for i, _, _ in foreign) >= 97
    assert language_id.predict(docs.where("false"), model).count() == 0


# --- 3: urls -----------------------------------------------------------------------------


def test_url_rules(spark):
    urls = ["https://WWW.Example.com/en/x?q", "http://a.example.com/en/", "http://example.com/fr", "http://x.net/es/1", "http://x.net/de/", "nothing", None, "a://b.net?x://y", "http://com/", "http://x.com"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = spark.createDataFrame(url_filter.RULES, "rule string, verdict string")
    outcomes = spark.createDataFrame([("x.net", 1)] * 40 + [("y.net", 0)] * 40 + [("x.com", None)], "host string, bad int")
    got = {r["page_id"]: r for r in url_filter.judge(pages, outcomes, rules).collect()}
    assert [got[i]["rule"] for i in range(10)] == ["www.example.com/en/", "example.com/en/", "com/", "net/es/", None, None, None, None, "com/", None]
    assert [got[i]["verdict"] for i in range(10)] == ["allow", "block", "allow", "block", "block", "allow", "allow", "allow", "allow", "allow"]
    assert (got[0]["host"], got[0]["path"]) == ("www.example.com", "/en/x") and (got[6]["host"], got[6]["path"]) == ("", "") and (got[7]["host"], got[7]["path"]) == ("b.net", "")


def test_reputation_equals_brute_force(spark):
    r = random.Random(1)
    outcomes = [(f"h{r.randrange(30)}.d{i % 4}.{'com' if i % 3 else 'co.uk'}", r.choice([0, 0, 1, None])) for i in range(900)]
    got = {x["host"]: x for x in url_filter.reputations(spark.createDataFrame(outcomes, "host string, bad int")).collect()}

    def up(host, n):
        parts = host.split(".")
        wide = ".".join(parts[-2:]) in url_filter.TWO_LABEL_SUFFIXES
        return ".".join(parts[-(n + wide) :])

    counts = {}
    for host, bad in outcomes:
        n, k = counts.get(host, (0, 0))
        counts[host] = (n + (bad is not None), k + (bad or 0))
    total = [sum(c[i] for c in counts.values()) for i in (0, 1)]
    parent = dict.fromkeys({up(h, 1) for h in counts}, (total[1] + 0.5) / (total[0] + 1))
    for level in (1, 2, None):
        sums = {}
        for h, (n, k) in counts.items():
            name = h if level is None else up(h, level)
            a = sums.get(name, (0, 0))
            sums[name] = (a[0] + n, a[1] + k)
        mu = {x: parent[x] if level == 1 else parent[up(x, 1 if level == 2 else 2)] for x in sums}
        s = sum((k - n * mu[x]) ** 2 for x, (n, k) in sums.items())
        a = sum(n * mu[x] * (1 - mu[x]) for x, (n, k) in sums.items())
        b = sum(n * (n - 1) * mu[x] * (1 - mu[x]) for x, (n, k) in sums.items())
        m = 1 / min(0.5, max(1e-3, (s - a) / b)) - 1
        parent = {x: (k + m * mu[x]) / (n + m) for x, (n, k) in sums.items()}
    assert {h: round(x["bad_rate"], 9) for h, x in got.items()} == {h: round(p, 9) for h, p in parent.items()}


def test_bad_hosts_domains_and_suffixes_are_blocked(spark):
    r = random.Random(2)
    rate = lambda host: 0.9 if host.endswith(".bad") or "evil." in host or host == "worse.fine.org" else 0.1
    hosts = [f"h{i}.d{i % 9}.org" for i in range(60)] + [f"x{i}.evil.org" for i in range(12)] + [f"y{i}.z{i}.bad" for i in range(12)] + ["worse.fine.org", "better.fine.org"]
    outcomes = [(h, int(r.random() < rate(h))) for h in hosts for _ in range(25)] + [(h, None) for h in ("new.evil.org", "new.z99.bad", "new.d1.org")] + [("few.d2.org", 1)] * 2
    pages = [(i, f"http://{h}/x", "clash") for i, h in enumerate([*hosts, "new.evil.org", "new.z99.bad", "new.d1.org", "few.d2.org", "few.d2.org"])]
    rules = spark.createDataFrame([], "rule string, verdict string")
    df = spark.createDataFrame(pages, "page_id long, url string, host string")
    got = [(x["host"], x["verdict"]) for x in url_filter.judge(df, spark.createDataFrame(outcomes, "host string, bad int"), rules).collect()]
    assert len(got) == len(pages)
    assert {h for h, v in got if v == "block"} == {h for h in hosts if rate(h) > 0.5} | {"new.evil.org", "new.z99.bad"}
    none = spark.createDataFrame([], "host string, bad int")
    assert {x["verdict"] for x in url_filter.judge(df, none, rules).collect()} == {"allow"}
    assert url_filter.judge(df.where("false"), none, rules).count() == 0


def test_beta_quantiles():
    r = np.random.default_rng(0)
    for a, b in ((0.3, 4.0), (1.0, 1.0), (9.0, 2.5), (400.0, 3000.0), (0.05, 0.05)):
        x = np.sort(r.beta(a, b, 200_000))
        for q in (0.05, 0.5, 0.9):
            got = url_filter.beta_quantiles(np.array([a]), np.array([b]), q)[0]
            assert abs((x <= got).mean() - q) < 0.01 or abs(got - x[int(q * x.size)]) < 0.002


# --- 4: decontamination ------------------------------------------------------------------


@pytest.mark.parametrize("most", [64, 0])
def test_containment_equals_brute_force(spark, most):
    items = [(i, made(100 + i, n, 5000)) for i, n in enumerate([40, 15, 60, 7, 5, 25])] + [(50, "two words"), (51, None), (52, "  "), (53, made(100, 40, 5000))]
    docs = []
    for i in range(60):
        item = items[i % 6][1].split()
        cut = item[: max(1, len(item) - i // 6)] if i % 2 else item
        docs.append((i, f"{made(i, 200, 5000)} {' '.join(cut).upper()} {made(i + 99, 30, 5000)}"))
    docs += [(900 + i, t) for i, t in enumerate(EDGE_TEXTS)] + [(990, "so two WORDS here"), (None, items[0][1]), (0, docs[0][1])]
    got = decontaminate.contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("clash")), broadcast_mb=most)
    got = {(r["doc_id"], r["item_id"]): (r["n_shared"], r["n_item"]) for r in got.collect()}
    want = {}
    for (d, t), (i, q) in itertools.product(docs, items):
        own = grams(q, 5)
        if d is None or not own:
            continue
        n = len(next(iter(own)))
        shared = len(own & {g for g in grams(t, n) if len(g) == n})
        if 100 * shared >= 80 * len(own):
            want[d, i] = (shared, len(own))
    assert got == want and (990, 50) in want


def test_containment_of_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "five words of one text")], DOCS), spark.createDataFrame([(1, "five words of one text")], "item_id long, text string")
    for d, i in ((docs.where("false"), items), (docs, items.where("false")), (docs, items.withColumn("text", F.lit(None).cast("string")))):
        for most in (64, 0):
            assert decontaminate.contaminated(d, i, broadcast_mb=most).count() == 0


# --- 6: language model -------------------------------------------------------------------


def lm_by_hand(docs):
    """doc_id, held_out, n_tokens, n_known, N, base score and score, in plain loops."""
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    toks = [(d, [*words(t), "\0end"]) for d, t in docs]
    train = [x for d, x in toks if not held(d)]
    count = Counter(w for x in train for w in x)
    pairs = Counter(p for x in train for p in zip(["\0end", *x], x))
    n, v = sum(count.values()), len(count)
    value = lambda c: 1.5 * 2 ** (c.bit_length() - 1) - 0.5 if c else 0.0
    mass, k = Counter(), 50 * (v / 2**16 + 4 * math.sqrt(v / 2**16) + 2)
    for (h, _), c in pairs.items():
        mass[h] += value(c)

    def p(h, w):
        alone = (count[w] + 1) / (n + v + 1)
        return (value(pairs[h, w]) + k * alone) / (mass[h] + k) if mass[h] else alone

    rows = [
        (d, held(d), len(x), sum(count[w] > 0 for w in x), n, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in x), sum(math.log10(p(h, w)) for h, w in zip(["\0end", *x], x)))
        for d, x in toks
    ]
    return sorted(rows, key=str), count, pairs


def test_lm_scores(spark):
    docs = [(i, made(i, 50)) for i in range(80)] + [(500 + i, t) for i, t in enumerate(EDGE_TEXTS)] + [(3, made(3, 50)), (None, made(4, 20)), (None, None)]
    df = spark.createDataFrame(docs, DOCS).withColumn("score", F.lit("clash")).withColumn("word", F.lit(1)).withColumn("n", F.lit(None).cast("long"))
    held = common.crc_mod("doc_id", 7) == 2
    want, *_ = lm_by_hand(docs)
    for how in ({}, {"broadcast_mb": 0}):
        got = sorted((tuple(r) for r in lm_score.score(df, held, shard_grams=300, **how).collect()), key=str)
        for a, b in zip(got, want, strict=True):
            # One pair in 8,192 passes at one level more by chance; that doubles its value.
            assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], abs=1e-6) and -1e-6 <= a[6] - b[6] < 1
        assert sum(a[6] == pytest.approx(b[6], abs=1e-6) for a, b in zip(got, want, strict=True)) >= 0.9 * len(want)
    assert lm_score.score(df.where("false"), held).count() == 0
    alone = lm_score.score(df.limit(5), F.lit(True)).collect()
    assert len(alone) == 5 and all(r["score"] == r["base_score"] == 0 and r["train_tokens"] == 0 for r in alone)


def test_lm_texts_ask_the_shards_in_packed_rows(spark, monkeypatch):
    docs = [(i, made(i, 50)) for i in range(80)] + [(500 + i, t) for i, t in enumerate(EDGE_TEXTS)] + [(None, made(4, 20)), (None, None)]
    df, write, stored = spark.createDataFrame(docs, DOCS).repartition(3), lm_score.materialize, []

    def counted(frame, **how):
        stored.append((out := write(frame, **how)).count())
        return out

    monkeypatch.setattr(lm_score, "materialize", counted)
    want, *_ = lm_by_hand(docs)
    for together, most in ((10**6, 0), (700, 5), (90, 4096)):
        monkeypatch.setattr(lm_score, "_TOGETHER", together, raising=False)
        monkeypatch.setattr(lm_score, "_COMMON", most, raising=False)
        stored.clear()
        got = sorted((tuple(r) for r in lm_score.score(df, common.crc_mod("doc_id", 7) == 2, broadcast_mb=0, shard_grams=300).collect()), key=str)
        for a, b in zip(got, want, strict=True):
            assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], abs=1e-6) and -1e-6 <= a[6] - b[6] < 1
        assert sum(a[6] == pytest.approx(b[6], abs=1e-6) for a, b in zip(got, want, strict=True)) >= 0.9 * len(want)
        # A row for each batch and shard, none for each pair of a text.
        assert together == 90 or max(stored) < sum(r[2] for r in want) / 5


def test_lm_probabilities_sum_to_one_after_any_history(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text")
    shards, known, shift, n, v = lm_score.train(docs)
    s, w = lm_score._gathered(shards, known, shift)
    counts = np.sort(np.unique(w.counts))
    for c in [*counts[:8], *counts[8::40], counts[-1]]:
        for h in w.hashes[w.counts == c][:3]:
            count, _ = w.look_up(w.hashes)
            _, mass = (np.full(v, x[0]) for x in w.look_up(np.array([h])))
            p = lm_score.model_probabilities(s.levels(lm_score._pair(np.full(v, h), w.hashes)), mass, count, n, v)
            unknown = lm_score.model_probabilities(np.zeros(1), mass[:1], np.zeros(1), n, v)
            assert p.sum() + unknown[0] == pytest.approx(1, abs=0.02)


def test_lm_batches_give_the_same_shards_however_they_are_sorted(spark, monkeypatch):
    df = spark.createDataFrame([(i, made(i, 60)) for i in range(60)] + [(900 + i, t) for i, t in enumerate(EDGE_TEXTS)], DOCS)
    seen = []
    for bins, piece in ((0, 10**6), (2, 17), (3, 1000)):
        monkeypatch.setattr(lm_score, "_BINS", bins)
        monkeypatch.setattr(lm_score, "_PIECE", piece)
        shards, known, *numbers = lm_score.train(df, shard_grams=200)
        seen.append((sorted(map(tuple, shards.collect())), sorted(map(tuple, known.collect())), numbers))
    assert seen[0][0] and seen[0] == seen[1] == seen[2]


def test_lm_model_is_broadcast_in_parts(spark, monkeypatch):
    df = spark.createDataFrame([(i, made(i, 60)) for i in range(60)] + [(900 + i, t) for i, t in enumerate(EDGE_TEXTS)], DOCS)
    run = lambda: sorted((tuple(r) for r in lm_score.score(df, common.crc_mod("doc_id", 7) == 2, shard_grams=200).collect()), key=str)
    want, sizes, send = run(), [], spark.sparkContext.broadcast

    def sent(value):
        sizes.append(len(pickle.dumps(value)))
        return send(value)

    monkeypatch.setattr(spark.sparkContext, "broadcast", sent)
    monkeypatch.setattr(lm_score, "_PART_BYTES", 1000, raising=False)
    assert run() == want
    assert len(sizes) > 5 and max(sizes) < 4000 < sum(sizes)


def test_bloom_levels():
    grams_ = np.unique(np.random.default_rng(2).integers(1, 2**63, 5000, dtype=np.uint64))
    levels = lm_score._levels(np.random.default_rng(3).integers(1, 300, grams_.size))
    bits = lm_score._build(grams_, levels).tobytes()
    m = lm_score.Shards([{"shard": 0, "bits": bits}], [(0, len(bits))], 64)
    got = m.levels(grams_)
    assert (got >= levels).all() and (got > levels).mean() < 0.02
    assert (m.levels(np.random.default_rng(9).integers(1, 2**63, 200_000, dtype=np.uint64)) > 0).sum() <= 15


# --- 7: minhash --------------------------------------------------------------------------


def linked(texts, n, percent=80):
    sets = {d: grams(t, n) for d, t in texts.items()}
    parent = {d: d for d in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(texts), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {d: (len(sets[d]), find(d)) for d in texts}


@pytest.mark.parametrize("shingle", [2, 5])
def test_near_duplicates_equal_brute_force(spark, shingle):
    r = random.Random(7)
    texts = {i: made(i, 60, 3000) for i in range(40)}
    for i in range(40, 200):  # drifting copies: chains whose ends are no near duplicates
        w = texts[i - 40 if i % 3 else i - 1].split()
        for _ in range(r.choice([0, 1, 2, 4, 8])):
            w[r.randrange(len(w))] = f"z{r.randrange(10**6)}"
        texts[i] = " ".join(w)
    texts |= {300 + i: t for i, t in enumerate(EDGE_TEXTS)}
    df = spark.createDataFrame([*texts.items(), (None, texts[0])], DOCS).withColumn("key", F.lit("clash")).withColumn("component_id", F.lit(0))
    rows = minhash_dedup.near_duplicates(df, shingle).collect()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}
    assert got.pop(None)[1] is None
    assert got == linked(texts, shingle)
    assert all(r["kept"] == (r["doc_id"] in (None, r["component_id"])) for r in rows)
    assert minhash_dedup.near_duplicates(df.where("false")).count() == 0


def test_large_group_of_near_copies(spark, monkeypatch):
    base = made(1, 80, 10**6).split()
    rows = []
    for i in range(1500):
        w = list(base)
        w[i % 80] = f"y{i}"
        rows.append((i, " ".join(w)))
    verified = []
    verify = minhash_dedup._verify
    monkeypatch.setattr(minhash_dedup, "_verify", lambda likely, *a: (verified.append(likely.count()), verify(likely, *a))[1])
    got = minhash_dedup.near_duplicates(spark.createDataFrame(rows, DOCS), 5)
    assert got.where("component_id <> 0").count() == 0
    assert sum(verified) <= 3 * 1500


# --- 8: embeddings -----------------------------------------------------------------------


def test_embedding_links_equal_brute_force(spark):
    r = np.random.default_rng(4)
    x = r.standard_normal((700, 24))
    x[200:500] = x[r.integers(0, 60, 300)] + 0.12 * r.standard_normal((300, 24))
    x[500:560] = x[500]
    vectors = [v.tolist() for v in x]
    odd = [None, [], [0.0] * 24, [float("nan")] * 24, [float("inf")] + [1.0] * 23, [1.0] * 3]
    rows = [(i, v) for i, v in enumerate([*vectors, *odd])] + [(None, vectors[0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("n_links", F.lit("clash"))
    got = {q["vec_id"]: q for q in embedding_dedup.near_duplicates(df, leaf_rows=40, node_sample=200, block_rows=32).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = u @ u.T >= 0.9
    np.fill_diagonal(links, False)
    found = sum(got[i]["n_links"] for i in range(700))
    assert found >= 0.99 * links.sum() and all(got[i]["n_links"] <= links[i].sum() for i in range(700))
    assert all(got[i]["n_links"] == 59 + links[i].sum() - 59 for i in range(500, 560))
    assert all(got[700 + i]["n_links"] == 0 and got[700 + i]["kept"] for i in range(6))
    assert embedding_dedup.near_duplicates(df.where("false")).count() == 0


def test_embedding_links_of_a_large_group_are_kept(spark):
    r = np.random.default_rng(8)
    x = r.standard_normal((3000, 64))
    x[:1000] = x[0] / np.linalg.norm(x[0]) * np.sqrt(0.92) + np.sqrt(0.08 / 64) * r.standard_normal((1000, 64))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = u @ u.T >= 0.9
    np.fill_diagonal(links, False)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = embedding_dedup.near_duplicates(df, leaf_rows=16).agg(F.sum("n_links")).first()[0]
    assert 0.999 * links.sum() <= got <= links.sum()


# --- 9: packing --------------------------------------------------------------------------


def test_packing_workers_keep_and_take_little():
    tokens._encoder(tokens.default_path(), 10)
    tokens.forget()
    assert tokens._encoder.cache_info().currsize == 0
    draw = np.random.default_rng(1)
    docs = [draw.integers(0, 40_000, 5000).astype("<u2") for _ in range(200)]
    tracemalloc.start()
    packing._Index(docs, np.full(1 << 16, 5), len(docs), 5000.0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 * sum(d.size for d in docs)


def test_packing_keeps_every_token(spark):
    from tokenizers import Tokenizer

    docs = [(i, made(i, random.Random(i).randrange(1, 900))) for i in range(60)] + [(100 + i, t) for i, t in enumerate(EDGE_TEXTS)] + [(None, "no id"), (5, made(5, 20))]
    rows = packing.pack(spark.createDataFrame(docs, DOCS).withColumn("n", F.lit("clash")), window=256, shard_tokens=5000).collect()
    tokenizer = Tokenizer.from_file(tokens.default_path())
    want = Counter((d, np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4").tobytes()) for d, t in docs)
    pieces = {}
    for r in rows:
        pieces.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], bytes(r["ids"])))
    assert sum(len(r["ids"]) for r in rows) == sum(len(k[1]) * n for k, n in want.items())
    for (d, ids), n in want.items():
        if n == 1 and sum(k[0] == d and len(k[1]) == len(ids) for k in want) == 1:
            assert b"".join(p for _, p in sorted(pieces[d, len(ids) // 4])) == ids
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= 256 and at & (at - 1) == 0
    assert packing.pack(spark.createDataFrame([], DOCS)).count() == 0


def test_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    tokenizer, encoder = Tokenizer.from_file(tokens.default_path()), tokens.Encoder(tokens.default_path(), cache_chunks=50)
    odd = ["İstanbul ǅ don't I'll e\u0301 é x\x1cy a\u0085b <|endoftext|>hi 12 3.5 ﬁ ΑΣ", "\x85 z", "Ñandú, ß. ÀÉ! a\u200bb", "🙂🙂 'S ''"]
    for t in [*[t or "" for t in EDGE_TEXTS], *odd, made(1, 300)]:
        assert np.frombuffer(encoder.encode(t), dtype="<u2").tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def test_encoder_looks_each_piece_up_once(tmp_path):
    """Chunks that differ in case and marks only share their pieces, and only other chunks are kept whole."""
    from tokenizers import Tokenizer

    encoder = tokens.Encoder(tokens.default_path())
    asked = []
    model = encoder._model
    encoder._model = lambda pieces: asked.extend(pieces) or model(pieces)
    encoder.encode_batch(pa.array(["Fjord fjord, FJORD! fjörd", None, "", "fjord! (fjord) FJÖRD,"]))
    assert sorted(asked) == ["!", ",", "fjord", "fjörd"] and set(encoder.chunks.places) == {"", "(fjord)"}
    # a special token that looks like a simple chunk
    tokenizer = Tokenizer.from_file(tokens.default_path())
    tokenizer.add_special_tokens(["fjord!"])
    tokenizer.save(str(tmp_path / "t.json"))
    encoder = tokens.Encoder(str(tmp_path / "t.json"))
    for t in ("a fjord! b", "Fjord! fjord", ""):
        assert np.frombuffer(encoder.encode(t), dtype="<u2").tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def test_document_frequencies_and_falling_ranks_by_slices(spark):
    r = np.random.default_rng(3)
    docs = [r.integers(0, 40, n).astype("<u2") for n in r.integers(1, 60, 200)]
    want = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=1 << 16)
    rows = spark.createDataFrame([(d.tobytes(),) for d in docs], "ids binary")
    for size in (1, 100, 1 << 20):
        assert (packing.document_frequencies(rows, slice_ids=size) == want).all()
    for ranks in (r.integers(0, 9, 500).astype(float), np.zeros(500), r.random(500), r.random(3)):
        ranks[0] = np.inf
        assert list(packing._falling(np.arange(ranks.size), ranks)) == np.argsort(-ranks, kind="stable").tolist()


def test_retrieval_prefers_neighbours():
    r = np.random.default_rng(1)
    docs = [np.concatenate((r.integers(1000 * (i % 3), 1000 * (i % 3) + 60, 40), r.integers(5000, 5020, 40))).astype(np.uint16) for i in range(30)]
    df = np.zeros(1 << 16, dtype=np.int64)
    for d in docs:
        df[np.unique(d)] += 1
    index = packing._Index(docs, df, 30, 80)
    scores = index.scores(0)
    assert {int(i) % 3 for i in np.argsort(-scores)[:10]} == {0}
    for i, d in enumerate(docs):
        own = [np.log1p((30 - df[t] + 0.5) / (df[t] + 0.5)) * (d == t).sum() * 2.2 / ((d == t).sum() + 1.2 * (0.25 + 0.75 * 80 / 80)) for t in np.unique(docs[0])]
        assert scores[i] == pytest.approx(sum(own))
    index.keep(np.arange(30) != 3)
    assert index.scores(0)[3] == 0 and (np.delete(index.scores(0), 3) == np.delete(scores, 3)).all()


def test_windows_equal_a_plain_plan():
    """Every window holds its seed and then the unused documents that BM25 ranks first."""
    r = np.random.default_rng(5)
    docs = [r.integers(0, 300, n).astype(np.uint16) for n in r.integers(1, 130, 80)] + [np.array([2], dtype=np.uint16)] * 20
    df = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=1 << 16)
    lengths = np.array([d.size for d in docs])
    mean = lengths.mean()
    sets = [Counter(d.tolist()) for d in docs]
    idf = np.log1p((len(docs) - df + 0.5) / (df + 0.5))
    bm25 = lambda q, d: sum(idf[t] * sets[d][t] * 2.2 / (sets[d][t] + 1.2 * (0.25 + 0.75 * lengths[d] / mean)) for t in sorted(sets[q]) if t in sets[d])
    got, start = packing._windows(lengths, np.zeros(len(docs), dtype=np.int64), packing._Index(docs, df, len(docs), mean), 64)
    left, want, sequence = lengths.copy(), [], 0
    for i, n in enumerate(lengths):
        while left[i] >= 64:
            want.append((i, int(n - left[i]), 64, sequence, 0))
            left[i] -= 64
            sequence += 1
    while left.sum() >= 64:
        seed = int(np.flatnonzero(left)[0])
        rest = sorted((i for i in np.flatnonzero(left).tolist() if i != seed), key=lambda i: (-round(bm25(seed, i), 9), i))
        offset = 0
        for i in [seed, *rest]:
            take = min(int(left[i]), 64 - offset)
            want.append((i, int(lengths[i] - left[i]), take, sequence, offset))
            left[i] -= take
            offset += take
            if offset == 64:
                break
        sequence += 1
    assert got == want and (lengths - start == left).all()


def test_equal_rows_take_many_shards(spark):
    docs = spark.createDataFrame([(i, made(1, 60)) for i in range(300)], DOCS).withColumn("ids", F.lit("clash")).withColumn("row", F.lit(0))
    rows = packing.pack(docs, window=128, shard_tokens=2000).collect()
    n = rows[0]["doc_tokens"]
    per = Counter()
    for x in rows:
        per[x["sequence_id"] >> 32] += x["length"]
    assert sum(per.values()) == 300 * n and max(per.values()) <= 3 * 2000 and len(per) >= 300 * n / 6000


# --- 10: chat ----------------------------------------------------------------------------


def test_chat_round_trip(spark):
    t = chat_format.TEMPLATE
    nasty = [*t.controls, "\\", "\\\\", "<\\|end|>", "<|end", "|>", "\\<|end|>\\", "a\nb", "", None, "🙂<|text|>\\n$1", "$0 \\1"]
    rows = [(i, j, role, text) for i, text in enumerate(nasty) for j, role in enumerate(("system", "user", "assistant"))]
    rows += [(50, 1, "assistant", "first"), (51, 1, "user", "x"), (51, 1, "user", "x"), (52, None, None, "y"), (None, 1, "user", "z"), (53, 2, "assistant", "two"), (53, 1, "user", "one"), (54, 1, "to<|end|>ol", "q")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segments", F.lit("clash"))
    got = {r["conv_id"]: r for r in chat_format.digests(chat_format.format_conversations(df)).collect()}
    by = {}
    for c, j, role, text in rows:
        by.setdefault(c, []).append((j is not None, j or 0, role or "", text or ""))
    for c, turns in by.items():
        turns = [x[2:] for x in sorted(turns)]
        whole = "".join(f"{a}\n{b}\n" for a, b in turns)
        learned = "".join(b for a, b in turns if a == "assistant")
        assert got[c]["n_turns"] == len(turns) and got[c]["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
        assert got[c]["loss_chars"] == len(learned) and got[c]["loss_sha256"] == hashlib.sha256(learned.encode()).hexdigest()
    assert [got[c]["valid"] for c in (0, 50, 51, 53)] == [True, False, False, True] and got[51]["bad_turn"] == 1
    assert chat_format.format_conversations(df.where("false")).count() == 0


def test_dense_groups_equal_brute_force(spark, monkeypatch):
    """Pairs just below the limit keep a bucket in several components."""
    monkeypatch.setattr(minhash_dedup, "_CROWDED", 0)
    r = random.Random(11)
    base = made(3, 90, 10**6).split()
    texts = {}
    for i in range(70):
        w = list(base)
        for k in r.sample(range(90), 9 if i % 4 else 3):
            w[k] = f"v{r.randrange(10**6)}"
        texts[i] = " ".join(w)
    rows = minhash_dedup.near_duplicates(spark.createDataFrame([*texts.items()], DOCS), 2).collect()
    assert {r_["doc_id"]: (r_["n_shingles"], r_["component_id"]) for r_ in rows} == linked(texts, 2)


def test_dense_groups_return_links_in_proportion_to_members(spark, monkeypatch):
    """All pairs of the first 60 texts are links: 1770, of which few join anything."""
    monkeypatch.setattr(minhash_dedup, "_CROWDED", 0)
    sizes = []
    monkeypatch.setattr(minhash_dedup, "connected_components", lambda links, x, y: sizes.append(links.count()) or common.connected_components(links, x, y))
    r = random.Random(12)
    texts = {}
    for i in range(80):
        w = made(3 if i < 60 else 4, 120).split()
        w[r.randrange(120)] = f"v{i}"
        texts[i] = " ".join(w)
    rows = minhash_dedup.near_duplicates(spark.createDataFrame([*texts.items()], DOCS), 2, star_rounds=0).collect()
    assert {r_["doc_id"]: (r_["n_shingles"], r_["component_id"]) for r_ in rows} == linked(texts, 2)
    assert sizes and max(sizes) < 6 * len(texts)
    x, y = np.array([1, 2, 1, 5, 1]), np.array([2, 3, 3, 6, 2])
    assert minhash_dedup._joining(x, y).tolist() == [0, 2, 3] and minhash_dedup._joining(x[:0], y[:0]).tolist() == []


def test_fits_take_a_bounded_sample_of_repeated_rows(spark):
    one = [(1, made(1, 40), "xx", 1)] * 3000 + [(2, made(2, 40), "yy", 0)] * 3000
    df = spark.createDataFrame(one, "doc_id long, text string, lang string, quality int")
    labels = df.select("doc_id", "quality")
    few = df.dropDuplicates()
    assert language_id.fit(df, 6000).centroids.tolist() == language_id.fit(few, 6000).centroids.tolist()
    a, b = quality.fit(df, labels, 10), quality.fit(few, labels, 10)
    x = np.array([quality.features(made(5, 30))])
    assert a.score(x) == b.score(x)


def test_quality_of_a_null_doc_id(spark, tmp_path):
    rows = [(None, made(3, 30)), (None, None), (5, made(4, 30))]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(5, 1, 0), (None, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = quality.query(spark, str(tmp_path)).collect()
    assert len(got) == 3 and all(r["held_out"] is False for r in got if r["doc_id"] is None) and all(0 <= r["score"] <= 1 for r in got)
