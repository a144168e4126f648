"""The corpus operators against brute force on small rows: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from rowscope.llm import decontaminate, html, licenses, quality, rules, sentencepieces, sharding, similar, simhash, substrings, toxicity
from rowscope.llm.stats import measure

RNG = np.random.default_rng(5)
SYL = "an en in on er th ha re st nd ou ly ing ed tion".split()


def word():
    return "".join(RNG.choice(SYL, RNG.integers(1, 5)))


def prose(n):
    return " ".join(word() for _ in range(n))


BASE = [prose(int(n)) for n in RNG.integers(20, 160, 24)]
LONG = prose(9000)
PASSAGE = prose(70)
TEXTS = [None, "", " \n\t", "one", "Ünï ☃ CODE", BASE[0], BASE[0], BASE[0].replace("an", "on", 1), LONG, LONG[:4000] + " x " + LONG[4000:], "a" * 900, *BASE, *[prose(40) + " " + PASSAGE + " " + prose(30) for _ in range(5)]]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, f"src{i % 3}", "en", "keep", i) for i, t in enumerate(TEXTS)] + [(3, "one", "src0", "en", "keep", 3), (None, BASE[1], None, None, None, None)]
    # extra columns with names that operators use themselves
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, kept string, score long").repartition(3).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 4 != 0), int(i % 5 == 0)) for i in range(30)], "doc_id long, quality int, toxic int")


def rows_of(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def test_substrings_equal_brute_force(docs):
    got = rows_of(substrings.dedup_report(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    data = [(r["doc_id"], (r["text"] or "").encode()) for r in docs.collect()]
    seen = Counter(b[s : s + 200] for _, b in data for s in range(len(b) - 199))
    want = []
    for i, b in data:
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - 199):
            if seen[b[s : s + 200]] > 1:
                gone[s : s + 200] = True
        left = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        want.append((i, len(b), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(left).hexdigest()))
    assert got == sorted(want, key=repr)
    kept = substrings.remove_repeats(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count()


def test_substrings_of_segments(monkeypatch):
    arr = pa.array([LONG, LONG[50:], "x"], pa.large_string())
    whole = {(int(r), int(p) >> 16) for r, p, *_ in zip(*substrings.phrases(arr), strict=True)}
    monkeypatch.setattr(substrings, "SEGMENT", 1000)
    row, p, *_ = substrings.phrases(arr)
    windows = sum(int(((x >> 8) & 255) + 1) for x in p)
    assert windows == sum(len(t) - 199 for t in (LONG, LONG[50:])) and len(whole) <= len(p)


def fingerprint(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    sh = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash_equals_brute_force(docs):
    got = rows_of(simhash.grouped(docs.where("doc_id is not null")), "doc_id", "fingerprint", "component_id")
    data = [(r["doc_id"], fingerprint(r["text"])) for r in docs.collect() if r["doc_id"] is not None]
    root = {i: i for i, _ in data}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in data:
        for j, b in data:
            if (a ^ b).bit_count() <= 4:
                x, y = sorted((find(i), find(j)))
                root[y] = x
    assert got == sorted(((i, f"{f:016x}", find(i)) for i, f in data), key=repr)


def test_simhash_keeps_one_of_each(docs):
    out = simhash.keep_one(docs)
    assert out.columns == docs.columns
    kept = [r["doc_id"] for r in out.collect()]
    assert 5 in kept and 6 not in kept and 7 not in kept and kept.count(3) == 1 and 9 not in kept
    assert {11 + i for i in range(2, 24)} <= set(kept)  # the rest of BASE is unlike anything
    assert simhash.keep_one(docs.limit(0)).count() == 0


def test_chain_of_links_is_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(-40, 40)] + [(100, 101)], "a long, b long")
    assert {(r["node"], r["root"]) for r in simhash.components(links).collect()} == {(i, -40) for i in range(-40, 41)} | {(100, 100), (101, 100)}


def test_statistics_equal_brute_force():
    texts = [t or "" for t in TEXTS] + ["a b c a b c\n\na b c\n a\n a", "\n\n", "x\ny\nx\n", "#1 a$ <b>\r\nq"]
    m = measure(pa.array(texts, pa.large_string()))
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        c = Counter(zip(w, w[1:], w[2:], strict=False))
        cover = {j + d for j in range(len(w) - 2) if c[tuple(w[j : j + 3])] > 1 for d in range(3)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        assert [int(m[k][i]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] == [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover)]


def test_rules_and_monotone_trees(docs, labels):
    x = np.random.default_rng(0).random((600, 3))
    y = (x[:, 0] + 0.2 * x[:, 1] < 0.6).astype(float)
    t = rules.fit_trees(x, y, np.array([-1, 0, 0]))
    grid = np.c_[np.linspace(0, 1, 50), np.full((50, 2), 0.5)]
    assert (np.diff(t.margin(grid)) <= 1e-12).all() and ((t.probability(x) >= 0.5) == y).mean() > 0.95
    out = rules.apply_rules(docs, rules.train(docs, labels))
    assert out.count() == docs.count() and out.where("base_failed and kept").count() == 0
    assert rules.apply_rules(docs.limit(0), rules.train(docs, labels.limit(0))).count() == 0


def test_quality_by_sites(spark, labels):
    junk = [(i, "&&& %%% ### " * 30, "bad", "x") for i in range(40)]
    good = [(100 + i, prose(80), "good", "x") for i in range(40)] + [(200, None, None, None), (201, "", "solo", "y")]
    docs = spark.createDataFrame(junk + good, "doc_id long, text string, source string, lang string")
    marks = spark.createDataFrame([(i, 0) for i in range(20)] + [(100 + i, 1) for i in range(20)], "doc_id long, quality int")
    model = quality.train(docs, marks)
    got = {r["doc_id"]: r["kept"] for r in quality.classify(docs, model).collect()}
    assert len(got) == 82 and not any(got[i] for i in range(40)) and all(got[100 + i] for i in range(40))
    assert quality.reject(docs, model).columns == docs.columns
    assert quality.classify(docs, quality.train(docs, marks.limit(0))).where("not kept").count() == 0
    assert quality.classify(docs.limit(0), model).count() == 0


def test_sites_change_verdicts(spark):
    """Equal evidence: kept among good neighbours, rejected among bad ones; a document alone at its site keeps its own."""
    rows = [(i, f"w{i}", "good" if i < 30 else "bad", "x") for i in range(60)] + [(90, "solo", "alone", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    doubt = {0, 30, 90}

    def stated(df, *_):
        own = F.when(F.col("doc_id").isin(*doubt), 0.2).when(F.col("source") == "bad", -6.0).otherwise(6.0)
        return df.withColumns({quality._EV: own, quality._HOST: F.col("source"), quality._PATH: F.col("lang")})

    real, quality.with_evidence = quality.with_evidence, stated
    try:
        out = {r["doc_id"]: r for r in quality.classify(docs, None).collect()}
    finally:
        quality.with_evidence = real
    assert out[0]["kept"] and not out[30]["kept"] and out[30]["evidence"] > 0 and out[90]["kept"]
    # without itself the bad site is as bad for the doubtful document as its 29 neighbours are
    p = 1 / (1 + np.exp(6.0))
    assert out[30]["site_rate"] < 0.1 and out[30]["site_rate"] > p and out[90]["site_rows"] == 1


def test_toxicity_held_out(spark):
    bad = ["idiot", "m0ron", "sсum"]  # a digit, and a Cyrillic letter
    data = [(i, prose(60) + (" " + bad[i % 3] + " " + prose(10) if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in data] + [(900, None), (901, "")], "doc_id long, text string")
    marks = spark.createDataFrame([(i, y) for i, _, y in data], "doc_id long, toxic int")
    out = {r["doc_id"]: r for r in toxicity.score_documents(docs, toxicity.train(docs, marks)).collect()}
    held = [(i, y) for i, _, y in data if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(out[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in out)
    assert np.mean([out[i]["predicted"] == y for i, y in held]) > 0.97
    assert out[900]["predicted"] == out[901]["predicted"] == 0
    assert toxicity.fold("𝐈𝐃𝐈𝐎𝐓 1d10t іdiоt ＩＤＩＯＴ ídïót") == "idiot " * 4 + "idiot"
    lex = toxicity.learn(spark.createDataFrame([], "t string, y int"))
    auto = lex.automaton()
    assert lex.features("a trash can here", auto)[0] == 0 and lex.features("such tr4sh here", auto)[0] > 0


def test_licenses(spark):
    t = ["CC-BY 4.0", "the GNU General Public License, version 3 or any later version", "All rights\nreserved. all RIGHTS reserved", "accby", None, "MIT License; SPDX-License-Identifier: Apache-2.0", "ünterm cc by"]
    got = {r["doc_id"]: r for r in licenses.scan_documents(spark.createDataFrame(list(enumerate(t)), "doc_id int, text string"), spans=True).collect()}
    assert (got[0]["n_base"], got[0]["base_labels"], got[0]["labels"]) == (1, "cc-by", "cc-by,cc-by-4.0")
    assert got[1]["base_labels"] == "gpl" and got[1]["first_word"] == 2 and "gpl-3-or-later" in got[1]["labels"]
    assert (got[2]["n_base"], got[2]["first_word"], got[2]["last_word"], got[2]["n_words"]) == (2, 0, 3, 6)
    assert got[3]["n_base"] == 0 and got[3]["first_word"] is None and (got[4]["n_words"], got[4]["labels"], got[4]["score"]) == (0, "", 0.0)
    assert got[5]["labels"] == "apache-2.0,mit" and got[6]["first_word"] == 1


def test_sharding_law_and_slots(docs):
    out = sharding.shard_documents(docs).collect()
    assert len(out) == docs.count()
    for s in range(16):
        slots = sorted(r["slot"] for r in out if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert all(r["grown_shard"] in (r["shard"], 16) for r in out)
    assert {r["size"] for r in out if r["doc_id"] in (0, 1)} == {1} and all(r["text_crc32"] == zlib.crc32((TEXTS[r["doc_id"]] or "").encode()) for r in out if r["doc_id"] is not None)
    assert sharding.shard_documents(docs.limit(0)).count() == 0


def test_draws_recomputed(docs):
    """The least of all draws decides, and the words of the rule give the same shard."""
    for r in sharding.shard_documents(docs).collect():
        name = "n" if r["doc_id"] is None else f"v{r['doc_id']}"
        u = [(int(hashlib.md5(f"7|{i}|{name}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52 for i in range(17)]
        assert r["shard"] == int(np.argmax(u[:16])) and r["grown_shard"] == int(np.argmax(u))


def test_sql_of_this_folder(spark):
    import duckdb

    from rowscope.llm.queries import ORACLE_SQL, QUERIES

    sf = "/root/testdata/sf0.001"
    db = duckdb.connect()
    try:
        db.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    except duckdb.Error:
        pytest.skip("no test data")
    for name, sql in ORACLE_SQL.items():
        got = db.execute(sql)
        names = [d[0] for d in got.description]
        assert sorted(got.fetchall(), key=repr) == sorted((tuple(r) for r in QUERIES[name](spark, sf).select(*names).collect()), key=repr)


def test_suppression_equals_brute_force():
    rng = np.random.default_rng(8)
    for _ in range(200):
        hits = [licenses.Found(str(rng.choice(list("abc"))), int(a := rng.integers(0, 12)), int(a + rng.integers(0, 6)), int(rng.choice([1, 2])), 0.5) for _ in range(rng.integers(0, 12))]
        rank = {h: (-h.priority, h.first - h.last, h.first, h.label) for h in hits}
        kept = []
        for h in sorted(set(hits), key=rank.get):
            if not any(k.first <= h.first and h.last <= k.last for k in kept):
                kept.append(h)
        assert set(licenses.suppress(hits)) == set(kept)


def test_clashing_names_and_repeated_rows(spark, docs, labels, vocabulary):
    """Results take the place of input columns of their names; rows that repeat get equal results and one label."""
    names = "evidence site_rows score kept held_out predicted labels n_words pieces lossless __matches site_rate".split()
    twice = docs.select("doc_id", "text", "source", "lang").withColumns({n: F.lit("own") for n in names})
    twice = twice.unionAll(twice)
    lex = toxicity.train(docs.unionAll(docs), labels)
    assert rules.labelled_sample(docs.unionAll(docs).select("doc_id", "text"), labels, "quality", 20).count() <= 20
    model, trees = quality.train(docs, labels), rules.train(docs, labels)
    for out, own in (
        (quality.classify(twice, model), ["evidence", "score", "kept"]), (toxicity.score_documents(twice, lex), ["held_out", "score", "predicted"]),
        (rules.apply_rules(twice, trees), ["n_words", "score", "kept"]), (licenses.scan_documents(twice), ["labels", "n_words", "score"]), (sentencepieces.encode_documents(twice, vocabulary), ["pieces", "lossless"]),
    ):
        assert out.count() == twice.count() and len(out.columns) == len(set(out.columns))
        got = out.select("doc_id", *[F.col(c).cast("string").alias(c) for c in own])
        assert all(r[c] != "own" for r in got.collect() for c in own)
        assert got.where("doc_id is not null").distinct().count() <= docs.where("doc_id is not null").count()
    bench = spark.createDataFrame([(1, BASE[5])], "item_id long, text string")
    left = decontaminate.remove_contaminated(twice, bench)
    assert left.columns == twice.columns and {r["__matches"] for r in left.collect()} == {"own"}
    assert quality.reject(twice, model).columns == twice.columns
    extra = twice.withColumns({"fingerprint": F.lit("own"), "component_id": F.lit("own"), "f": F.lit("own"), "k": F.lit("own"), "__t": F.lit("own")})
    assert simhash.grouped(extra).count() == substrings.dedup_report(extra).count() == sharding.shard_documents(extra).count() == extra.count()
    assert simhash.keep_one(extra).columns == extra.columns and substrings.remove_repeats(extra).columns == extra.columns


def test_empty_tables(spark, docs, vocabulary):
    """No rows in, no rows out, and the columns of the result."""
    none = docs.limit(0)
    bench = spark.createDataFrame([(1, BASE[5])], "item_id long, text string")
    lex = toxicity.learn(spark.createDataFrame([], "t string, y int"))
    for out, col in (
        (toxicity.score_documents(none, lex), "predicted"), (decontaminate.find(none, bench), "lcs_share"), (substrings.dedup_report(none), "kept_sha256"),
        (simhash.grouped(none), "component_id"), (licenses.scan_documents(none), "labels"), (sentencepieces.encode_documents(none, vocabulary), "pieces"),
        (html.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")), "text"), (substrings.remove_repeats(none), "text"), (decontaminate.remove_contaminated(none, bench), "text"),
    ):
        assert out.count() == 0 and col in out.columns
    assert decontaminate.find(docs, bench.limit(0)).count() == 0 and decontaminate.remove_contaminated(docs, bench.limit(0)).count() == docs.count()


def test_reweighting_moves_rows_out_of_one_subtree_only(spark):
    df = spark.range(4000)
    a = sharding.place(df, "id", sharding.tree(8), "a")
    b = sharding.place(a, "id", sharding.tree(8, weights={5: 0.25}), "b")
    assert b.where("a <> b and a <> 5").count() == 0
    n = {r["b"]: r["count"] for r in b.groupBy("b").count().collect()}
    assert 0.15 < n[5] / (sum(n.values()) / 7.25) < 0.4


def test_pages_by_two_passes():
    """Labels against the rule written out plainly, over pages with and without articles."""
    rng = np.random.default_rng(2)

    def page(article):
        parts = []
        for _ in range(rng.integers(1, 14)):
            n = int(rng.choice([2, 6, 40]))
            text = " ".join(rng.choice(["the", "of", "and", "zork", "blim", "quux"], n))
            kind = rng.choice(["p", "h2", "div class=nav", "a"])
            parts.append(f"<p><a href=x>{text}</a></p>" if kind == "a" else f"<{kind}>{text}</{kind.split()[0]}>")
        return "<nav>x y</nav>" + (f"<article>{''.join(parts)}</article>" if article else "".join(parts)) + "<footer>z</footer>"

    for i in range(300):
        found = html.blocks(page(i % 2))
        first = [html.first_pass(b) for b in found]
        got = html.second_pass(found, first)
        for k, b in enumerate(found):
            if first[k] is not None:
                assert got[k] == first[k]
                continue
            own = [j for j, x in enumerate(found) if x.article == b.article]
            if not any(first[j] == 1 for j in own):
                assert got[k] == (1 if b.article or i % 2 == 0 else 0)
                continue
            left = [j for j in own if j < k and first[j] is not None][-1:]
            right = [j for j in own if j > k and first[j] is not None][:1]
            if not left or not right or b.heading:
                want = first[(right or left)[0]] if b.heading and right else first[(left or right)[0]]
            else:
                near = own.index(k) - own.index(left[0]) <= own.index(right[0]) - own.index(k)
                want = first[left[0]] if near else first[right[0]]
            assert got[k] == want


def test_odd_pages():
    import time

    assert html.extract("<div><h1>Title</h1><p>Short one.</p><p>Two.</p></div>") == "Title\nShort one.\nTwo."
    assert html.extract('<article><p data-id="nav">kept</p></article>') == "kept"
    assert html.extract('<article><div class="article-header"><h1>T</h1></div><p>x</p></article>') == "T\nx"
    assert html.extract('<p id=nav>gone</p><div class="main"><p>kept</p></div>') == "kept"
    start = time.perf_counter()
    assert html.extract("<div>" * 60_000 + "</span>" * 60_000 + "x") == "x" and html.extract("<p><b>" * 60_000 + "y</i>" * 60_000).startswith("y")
    assert time.perf_counter() - start < 5


def test_html():
    page = """<!doctype html><html><head><title>t</title><style>p{}</style><script>var a="</p>";</script></head><body>
    <nav><ul><li><a href=/a>Home</a></ul></nav><div class="cookie-notice">We use cookies on the site and you can say no to them here.</div>
    <article><h1>Head</h1><p>Some&nbsp;words &amp; <b>the <i>rest</i></b> of it<br>next<p>Hi.</article>
    <section id="comments"><p>This is what a reader says of the text, and it is long enough to be taken for a paragraph of it.</p></section>
    <form><p>Your mail</p></form><footer>&copy; all</footer>"""
    assert html.extract(page) == "Head\nSome words & the rest of it next\nHi."
    assert html.extract(None) == html.extract("") == "" and html.extract("<p>cut <b") == "cut"
    long = "It is the case that the words of this block are those of the text and that they go on for a while in it."
    assert html.extract(f"<body><div><a href=x>one</a> <a href=y>two</a></div><div>{long}</div><p>Short.</p><div>{long}</div></body>") == f"{long}\nShort.\n{long}"


def test_pages_keep_other_columns(spark):
    df = spark.createDataFrame([(1, "u", "<p>x", "old"), (2, None, None, "old")], "page_id int, url string, html string, text string")
    assert rows_of(html.extract_pages(df), "page_id", "url", "n_chars") == [(1, "u", 1), (2, None, 0)]


def test_decontamination_recall(spark):
    items = [prose(int(n)) for n in RNG.integers(15, 60, 30)]
    items[1], items[2] = prose(150), prose(400)  # longer than any window
    clean = [prose(200) for _ in range(60)]
    hold, where = [], []
    for i, t in enumerate(items):
        w = t.split()
        if i % 3 == 0:  # a paraphrase: every eighth word differs
            w = [x if k % 8 else word() for k, x in enumerate(w)]
        hold.append(prose(50 + i) + " " + " ".join(w) + " " + prose(60))
        where.append(i)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(clean + hold)] + [(900, None), (901, "")], "doc_id long, text string")
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(99, ""), (98, None)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find(docs, bench).collect()}
    want = {(60 + k, i) for k, i in enumerate(where)}
    assert len(got & want) >= 0.9 * len(want) and {x for x in want if x[1] % 3} <= got and {d for d, _ in got} <= {d for d, _ in want}
    left = decontaminate.remove_contaminated(docs, bench)
    assert left.columns == docs.columns and left.count() == docs.count() - len({d for d, _ in got})


def test_lcs():
    a, b = RNG.integers(0, 9, 40).tolist(), RNG.integers(0, 9, 25).tolist()
    masks = {}
    for i, v in enumerate(b):
        masks[v] = masks.get(v, 0) | 1 << i
    t = np.zeros((41, 26), int)
    for i in range(40):
        for j in range(25):
            t[i + 1, j + 1] = t[i, j] + 1 if a[i] == b[j] else max(t[i, j + 1], t[i + 1, j])
    assert decontaminate.lcs(a, masks, 25) == t[40, 25]


@pytest.fixture(scope="module")
def vocabulary():
    import os

    if not os.path.exists(sentencepieces.MODEL):
        pytest.skip("no model file")
    return sentencepieces.Vocabulary.load()


def test_pieces_equal_the_library_and_decode(docs, vocabulary, monkeypatch):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.MODEL)
    texts = [t or "" for t in TEXTS] + ["  a", "日本 x\x00 😀", "a\tb\n", "ab" * 300]
    arr = pa.array(texts, pa.large_string())
    ids, off = sentencepieces.encode(vocabulary, arr, 0.0)
    assert [ids[off[i] : off[i + 1]].tolist() for i in range(len(texts))] == [sp.encode(t) for t in texts]
    one, off = sentencepieces.encode(vocabulary, arr, 0.3)
    assert len(one) > len(ids)
    data, ends = sentencepieces.decode(vocabulary, one, off)
    assert [data[a:b].tobytes().decode() for a, b in zip(ends[:-1], ends[1:], strict=True)] == texts
    monkeypatch.setattr(sentencepieces, "LONG", 3)
    assert sentencepieces.encode(vocabulary, arr, 0.3)[0].tolist() == one.tolist()
    out = sentencepieces.encode_documents(docs, vocabulary)
    assert out.where("not lossless").count() == 0 and out.count() == docs.count()
    back = sentencepieces.decode_documents(out, vocabulary)
    assert rows_of(back, "doc_id", "text") == rows_of(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "doc_id", "text")


def test_pipeline(docs, labels, spark, tmp_path, vocabulary):
    import corpus_pipeline

    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, BASE[5])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.where("not lossless").count() == 0
    assert {"doc_id", "pieces"} <= set(out.columns) and 16 not in [r["doc_id"] for r in out.collect()]


def _shingles(t):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", t.lower()) if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_similar_sets_equal_brute_force_where_most_texts_share_a_template(spark):
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(5000)]

    def fresh(n):
        return list(rng.choice(vocabulary, n))

    template = fresh(60)
    rows = [" ".join(template + fresh(int(rng.integers(8, 60)))) for _ in range(150)]  # share most of their words
    for _ in range(120):
        own = (template if rng.random() < 0.7 else []) + fresh(int(rng.integers(60, 200)))
        rows.append(" ".join(own))
        for _ in range(int(rng.integers(1, 4))):  # pairs on both sides of the threshold
            other = list(own)
            for i in rng.choice(len(own), max(1, int(len(own) * rng.uniform(0.005, 0.03))), replace=False):
                other[i] = str(rng.choice(vocabulary))
            rows.append(" ".join(other))
    rows += ["one", "ONE", "", " ", "one two three"]
    sets = [_shingles(t) for t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a == b or (a or b) and len(a & b) / len(a | b) >= 0.8:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_classes(df).collect()}
    assert got == {i: find(i) for i in range(len(rows))}
    assert len(set(got.values())) < 350


def test_decontamination_is_fitted_on_all_documents(spark):
    rng = np.random.default_rng(17)
    words = [f"t{i}" for i in range(3000)]
    passages = [list(rng.choice(words, 40)) for _ in range(10)]
    texts = [" ".join(rng.choice(words, 90)) for _ in range(6000)]
    for i in range(60):  # half of the passages with every eighth word replaced
        own = [str(rng.choice(words)) if i % 2 and j % 8 == 7 else w for j, w in enumerate(passages[i % 10])]
        texts[i * 97] += " " + " ".join(own)
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame([(i, " ".join(p)) for i, p in enumerate(passages)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find(df, bench).collect()}
    want = {(i * 97, i % 10) for i in range(60)}
    assert got <= want and len(got) >= 54
    # a document without a key counts like any other
    bare = df.select(F.lit(None).cast("long").alias("doc_id"), "text")
    a, b = (np.abs(decontaminate.fit(x, bench)) for x in (df, bare))
    assert np.allclose(a.sum(), b.sum(), rtol=1e-3)


def test_repeated_lines_do_not_make_texts_similar(spark):
    rng = np.random.default_rng(8)
    line = "this line stands here many times\n"
    rows = [line * 60 + " ".join(f"w{i}" for i in rng.integers(0, 100_000, 150)) for _ in range(12)]
    df = spark.createDataFrame([*enumerate(rows), (12, rows[0] + "\n" + line), (13, rows[0])], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.keep_one(df).collect()) == list(range(12))


def _samples(pattern):
    """Texts that match a rule's pattern, for each branch and with and without what is optional."""
    def seq(items):
        out = [""]
        for op, arg in items:
            out = [a + b for a in out for b in one(str(op), arg)]
        return out

    def one(op, arg):
        if op == "LITERAL":
            return [chr(arg)]
        if op == "IN":
            return ["7" if str(arg[0][1]) == "CATEGORY_DIGIT" else "w" if str(arg[0][0]) == "CATEGORY" else chr(arg[0][1])]
        if op == "BRANCH":
            return [x for branch in arg[1] for x in seq(branch)]
        if op == "SUBPATTERN":
            return seq(arg[3])
        low, high, inner = arg
        got = seq(inner)
        return [*([""] if not low else []), *(x * max(1, low) for x in got)]

    return seq(re._parser.parse(pattern))


def test_every_rule_is_found_in_a_text_of_its_own():
    scanner = licenses.Scanner()
    for rule, p in scanner.rules:
        for t in _samples(rule.pattern):
            assert p.search(t), (rule, t)
            assert any(k in t for k in rule.keywords) and any(scanner.scan(t)), (rule, t)
    for t in ("gpl3", "apache2", "mpl2.0", "lgpl2.1", "php 3.01", "eclipse public v 2.0", "python software foundation 2", "boost software 1.0", "affero general public v3", "berkeley software distribution"):
        assert scanner.scan(t)[1], t


def test_long_passages_are_found(spark):
    rng = np.random.default_rng(23)
    words = [f"t{i}" for i in range(4000)]
    passages = [" ".join(rng.choice(words, n)) for n in (400, 600, 801, 1000, 1500)]
    rows = [(i, " ".join(rng.choice(words, 300)) + (" " + passages[i % 5] + " " if i < 40 else " ") + " ".join(rng.choice(words, 300))) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([*enumerate(passages)], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.find(df, bench).collect()} == {(i, i % 5) for i in range(40)}


def test_rules_on_held_out_rows(spark):
    """Trees fitted without the held-out fold judge it; documents that fail the base rules are never kept."""
    import os

    sf = "/root/testdata/sf0.1"
    if not os.path.isdir(sf):
        pytest.skip("no test data")
    docs, marks = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    held = toxicity.held_out(F.col("doc_id"))
    out = rules.apply_rules(docs.select("doc_id", "text"), rules.train(docs, marks.where(~held)))
    got = out.join(marks, "doc_id").where(held).select("quality", "kept", "base_failed", "n_words", "n_repeat_words").collect()
    assert len(got) > 500 and not any(r["kept"] and r["base_failed"] for r in got)
    assert all(r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) for r in got)
    free = [r for r in got if not r["base_failed"]]
    assert np.mean([r["kept"] == (r["quality"] == 1) for r in free]) > 0.95
    model = quality.train(docs, marks.where(~held))
    seen = quality.classify(docs.select("doc_id", "text", "source", "lang"), model).join(marks, "doc_id").where(held).select("quality", "kept").collect()
    assert np.mean([r["kept"] == (r["quality"] == 1) for r in seen]) > 0.9


def test_paraphrases_are_candidates(spark):
    """Passages with every eighth, fourth or third word replaced, or with neighbours swapped, in texts of the same words."""
    rng = np.random.default_rng(31)
    words = [f"t{i}" for i in range(1500)]
    passages = [list(rng.choice(words, int(n))) for n in rng.integers(18, 58, 24)]
    rows, want = [], set()
    for i in range(360):
        text = list(rng.choice(words, 120))
        if i % 3 == 0:
            p, k = passages[i // 3 % 24].copy(), i // 3 % 4
            for j in range(0, len(p) - 1, 2) if k == 3 else []:
                p[j], p[j + 1] = p[j + 1], p[j]
            p = [str(rng.choice(words)) if k < 3 and j % (8, 4, 3)[k] == 2 else w for j, w in enumerate(p)]
            text[50:50] = p
            want.add((i, i // 3 % 24, k))
        rows.append((i, " ".join(text)))
    bench = spark.createDataFrame([(i, " ".join(p)) for i, p in enumerate(passages)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), bench).collect()}
    for k in range(4):
        own = {(d, i) for d, i, x in want if x == k}
        assert len(own & got) >= 0.9 * len(own), k
    assert {d for d, _ in got} <= {d for d, _, _ in want}


def test_a_crowd_of_texts_too_different_is_not_verified_pair_by_pair(spark, monkeypatch):
    """400 texts of one template with four of twenty words of their own: what is verified does not follow the square."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(204)]
    rows = []
    for i in range(400):
        words = list(base)
        for j, at in enumerate(rng.choice(20, 4, replace=False)):
            words[5 + 10 * at] = f"own{i}x{j}"
        rows.append((i, " ".join(words)))
    for i in range(0, 40, 2):  # and twenty that are near another
        words = rows[i][1].split()
        words[-1] = f"end{i}"
        rows.append((1000 + i, " ".join(words)))
    verified, pairs = similar.Sets.verified, []
    monkeypatch.setattr(similar.Sets, "verified", lambda self, p: pairs.append(p.count()) or verified(self, p))
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(200)} for i, t in rows}
    root = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {k: new if v == old else v for k, v in root.items()}
    assert got == root
    assert pairs[-1] < 4_000, pairs


def test_phrases_found_once_are_not_looked_up(spark, monkeypatch):
    """Forty texts share a passage; the phrases over its ends differ from text to text and have their places at once."""
    rng = np.random.default_rng(9)

    def own(n):
        return " ".join("".join(rng.choice(SYL, 3)) for _ in range(n))

    passage = own(90)
    rows = [(i, f"{own(40)} {passage} {own(40)}") for i in range(40)]
    frame, looked = type(spark.range(0)), []
    join = frame.join

    def counted(self, other, on=None, how=None):
        out = join(self, other, on, how)
        if on == ["a", "c", "c2"]:
            looked.append((out.count(), out.groupBy(*on).count().where("count = 1").count()))
        return out

    monkeypatch.setattr(frame, "join", counted)
    parts = substrings.dedup_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r["n_removed"] >= len(passage) for r in parts)
    assert [single for _, single in looked] == [0], looked


def test_what_a_text_repeats_is_marked_there(spark, monkeypatch):
    """Texts with long stretches of one short line; a stretch of over 65,535 windows; copies of a stretch's edge elsewhere."""
    rng = np.random.default_rng(10)

    def own(n):
        return " ".join("".join(rng.choice(SYL, 3)) for _ in range(n))

    line, edge = "Is onhe. ", own(20)
    rows = [(i, f"{own(30)} {edge}{line * int(rng.integers(30, 300))}{own(30)}") for i in range(20)]
    rows += [(20, "ab " * 30_000), (21, own(20) + "ab " * 80), (22, own(60)), (23, line * 23), (24, None), (25, ("xyz " * 60 + own(10)) * 2)]
    frame, looked = type(spark.range(0)), []
    join = frame.join

    def counted(self, other, on=None, how=None):
        out = join(self, other, on, how)
        if on == ["a", "c", "c2"]:
            looked.append(out.count())
        return out

    monkeypatch.setattr(frame, "join", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    test_substrings_equal_brute_force(docs)
    assert max(looked) <= 3 * len(rows), looked
