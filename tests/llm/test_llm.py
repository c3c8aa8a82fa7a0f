"""Each corpus operator against a plain version, on hand-made and on driver documents."""

from __future__ import annotations

import hashlib
import os
import random
import sys
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402

from batchtide.llm import bytebpe, decontaminate, htmltext, licenses, neardup, pii, quality, substrings, suffixlm, tokenfiles, words  # noqa: E402
from batchtide.llm.shared import documents  # noqa: E402

SF = "/root/testdata/sf0.001"
LONG = "the quick brown fox jumps over a lazy dog and " * 40
HARD = [
    None, "", " \n\t ", "one", "two words", "Ünïcode   Wörds 漢字 🙂 　x", "a" * 5000, LONG, LONG, LONG + "tail", "MIT License. mit license CC BY-NC apache  License gnu General public LICENSE, gnu public",
    "a@b.c%x@d.e x@y 1.2.3.4.5.6.7.8 256.1.1.1 4111 1111 1111 1111 +1 (743) 555-3824 GB82 WEST 1234 5698 7654 32", "9" * 2000 + "a." * 500 + "@b.c",
    "# $ % x\nx y z x y z\nx y z x y z\n\n", "<|endoftext|> <|ENDOFTEXT|> it's IT'S 1²3", " ".join(f"w{i % 97}" for i in range(3000)),
]


@pytest.fixture(scope="module")
def docs(spark):
    """Driver documents and hard cases, with columns whose names clash with the operators' own."""
    rows = [(10**6 + i, t) for i, t in enumerate(HARD)] + [(None, "no id"), (7, "repeated row " * 20), (7, "repeated row " * 20)]
    d = documents(spark, SF).select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    return d.withColumn("n_words", F.lit("x")).withColumn("uid", F.lit(1)).withColumn("hash", F.lit(None).cast("string")).persist()


@pytest.fixture(scope="module")
def plain(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def key(r):
    return tuple((x is None or x != x, str(x)) for x in r)


def same(got, want):
    got, want = sorted((tuple(r) for r in got), key=key), sorted(want, key=key)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a == b


def test_words():
    for table, rule, lower in ((words.EXACT, brute.BLANK, False), (words.LOWER, brute.BLANK, True), (words.ALNUM, brute.ALNUM, True)):
        texts = [t or "" for t in HARD]
        w = words.Words([t.encode() for t in texts], table)
        for i, t in enumerate(texts):
            assert [x.decode() for x in w.of(i)] == rule.findall(brute.low(t) if lower else t)
        assert len({bytes(w.buf[a:b]) for a, b in zip(w.start, w.end, strict=True)}) == len(set(w.hash.tolist()))
        for k in (1, 2, 3, 35):
            g, ok = w.grams(k)
            seen = {}
            for i in np.flatnonzero(ok):
                said = w.buf[w.start[i] : w.end[i + k - 1]].split()
                assert seen.setdefault(tuple(said), g[i]) == g[i]
            assert len(set(seen.values())) == len(seen)


def thue_morse(n):
    t = "a"
    while len(t) < n:
        t += t.translate({97: 98, 98: 97})
    return t, t.translate({97: 98, 98: 97})


@pytest.mark.parametrize("n", [1024, 4096])
def test_words_that_polynomials_confuse(spark, n):
    """Thue-Morse words, which every polynomial modulo 2**64 gives one hash, in op2, op3, op5, op9 and op10."""
    import public_tokenizers as P
    import tiktoken
    from tokenizers import Tokenizer

    x, y = thue_morse(n)
    raw = [x.encode(), y.encode()]
    w = words.Words(raw, words.EXACT)
    assert len(set(w.hash.tolist())) == 2
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bytebpe.read_ranks(bytebpe.default_path()), special_tokens={})
    bpe = bytebpe.load(bytebpe.default_path())
    assert [i.tolist() for i in bpe.encode(raw)] == [enc.encode_ordinary(t) for t in (x, y)]
    tok = Tokenizer.from_file(tokenfiles.default_path())
    ids, at = tokenfiles.load(tokenfiles.default_path())(raw)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:], strict=False)] == [tok.encode(t, add_special_tokens=False).ids for t in (x, y)]
    rest = " ".join(f"v{i}" for i in range(60))
    rows = [(0, f"{x} p q r"), (1, f"{y} p q r"), (2, f"{x} {rest}"), (3, f"{y} {rest}")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    same(neardup.report(d).collect(), [(i, m, c, i == c) for (i, _), (m, c) in zip(rows, brute.near(rows), strict=True)])
    same(substrings.deduplicate(d).collect(), [(i, *r) for (i, _), r in zip(rows, brute.substrings([t for _, t in rows]), strict=True)])
    got = {r.doc_id: r for r in suffixlm.score(d).collect()}
    for (i, _), r in zip(rows, brute.unigrams(rows), strict=True):
        assert (got[i].held_out, got[i].n_tokens, got[i].n_known, got[i].train_tokens) == r[:4] and got[i].base_score == pytest.approx(r[4])


def test_pieces_of_one_hash(monkeypatch):
    """Ids go by bytes, even if all pieces have one hash."""
    from batchtide.llm import pieces

    buf = b"ab cd ab x"
    start, end, first = np.array([0, 3, 6, 9]), np.array([2, 5, 8, 10]), np.array([0, 4])
    ids, at = pieces.PieceIds(lambda names: [[len(n), ord(n[0])] for n in names])(buf, start, end, first, np.zeros(4, np.uint64))
    assert ids.tolist() == [2, 97, 2, 99, 2, 97, 1, 120] and at.tolist() == [0, 8]


def test_licenses(docs, plain, empty):
    got = licenses.licenses(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()
    same(got, [(i, *brute.licenses(t)) for i, t in plain])
    assert licenses.licenses(empty).count() == 0


def test_license_wording(spark):
    text = licenses.WORDING["mit"].split()
    texts = [" ".join(text), " ".join(text[:30] + ["new", "words"] + text[32:]), " ".join(text[:12]), "x " * 50 + " ".join(text)]
    got = licenses.licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.labels for r in got] == ["mit", "mit", "", "mit"] and got[0].score == 1.0 and 0.5 <= got[1].score < 1 and all(r.n_base == 0 for r in got)


def test_license_fragments_are_no_license(spark):
    """Words of a template over and over, or its grams in another order, are not the template."""
    isc = licenses.WORDING["isc"].split()
    parts = [isc[i : i + 6] for i in range(0, len(isc), 6)]
    texts = ["copies of the software " * 30, "permission notice appear in all copies " * 12, " ".join(w for p in parts[::-1] for w in p), " ".join(isc)]
    got = licenses.licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r.labels, r.score) for r in got] == [("", 0.0), ("", 0.0), ("", 0.0), ("isc", 1.0)]


def test_byte_bpe(docs, plain, empty):
    import public_tokenizers as P
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bytebpe.read_ranks(bytebpe.default_path()), special_tokens={})
    want = []
    for i, t in plain:
        ids = enc.encode_ordinary(t or "")
        want.append((i, len(ids), brute.sha(",".join(map(str, ids))), brute.sha(t or "")))
    same(bytebpe.digests(docs).collect(), want)
    assert bytebpe.digests(empty).count() == 0
    back = bytebpe.decode(bytebpe.encode(docs)).select("doc_id", "text").collect()
    same(back, [(i, t or "") for i, t in plain])
    r = bytebpe.encode(docs.where("doc_id = 1000005"), offsets=True).first()
    bpe, raw = bytebpe.load(bytebpe.default_path()), HARD[5].encode()
    assert [raw[a:b] for a, b in zip([0, *r.ends], r.ends, strict=False)] == [bpe.decode_bytes([x]) for x in r.ids]


def test_byte_bpe_fuzz():
    import public_tokenizers as P
    import tiktoken

    path = bytebpe.default_path()
    bpe, rng = bytebpe.load(path), random.Random(3)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bytebpe.read_ranks(path), special_tokens={})
    pool = "abcXYZ  \t\n\r\x0b\x1c\x1f\x85\xa0  　'sdlvre012٣½é́漢字한국🙂‍.,!?-_#$%&ßİǅ"
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    for t, ids in zip(texts, bpe.encode([t.encode() for t in texts]), strict=True):
        assert ids.tolist() == enc.encode_ordinary(t)


def test_token_files(spark, docs, plain, empty):
    import xxhash
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenfiles.default_path())
    tie = lambda t: xxhash.xxh64_intdigest((t or "").encode(), 42)
    order = sorted(plain, key=lambda r: (r[0] is not None, r[0] or 0, tie(r[1]) - (tie(r[1]) >> 63 << 64)))
    want, start = [], 0
    for i, t in order:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    same(tokenfiles.round_trip(docs).collect(), want)
    assert tokenfiles.round_trip(empty).count() == 0


def test_ids_of_one_key(spark, docs, plain):
    """Constant-time reads give what the library gives, for null, repeated and unknown keys too."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenfiles.default_path())
    folder, manifest, n = tokenfiles.write_files(docs)
    rows = manifest.collect()
    for k in (None, 7, plain[0][0], plain[5][0], 10**6 + 5, -3, 10**12):
        want = sorted(tok.encode(t or "", add_special_tokens=False).ids + [1] for i, t in plain if i == k)
        assert sorted(x.tolist() for x in tokenfiles.ids_of(folder, rows, n, k)) == want


def test_perfect_hash():
    h = words.mix(np.arange(20_000, dtype=np.uint64))
    mph = tokenfiles.PerfectHash.of(h)
    assert sorted(mph(h).tolist()) == list(range(len(h)))
    b = tokenfiles.Bucket(tokenfiles.pack_bucket(h, 0, np.arange(len(h)), 1))
    e, found = b.find(h)
    assert found.all() and e["ordinal"].tolist() == list(range(len(h)))
    assert not b.find(words.mix(np.arange(10**6, 10**6 + 20_000, dtype=np.uint64)))[1].any()


def test_pii(docs, plain, empty):
    want = []
    for i, t in plain:
        r = brute.pii(t)
        want.append((i, *[sum(x[0] == k for x in r) for k in pii.BASE], brute.sha(",".join(f"{a}:{b}:{c}" for a, b, c in r))))
    got = pii.report(docs)
    same(got.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256").collect(), want)
    assert "iban:" in got.where("doc_id = 1000011").first().spans
    assert pii.report(empty).count() == 0


def test_pii_score_and_redaction(spark):
    d = spark.createDataFrame([(1, "mail me: a@b.org now"), (2, "x a@b.org y"), (3, "card 4111 1111 1111 1111, not 4111 1111 1111 1112 ip 1.2.3.4"), (4, None)], "doc_id long, text string")
    top = {r.doc_id: r.top_score for r in pii.report(d).collect()}
    assert top[1] > top[2] and top[4] is None
    got = {r.doc_id: r.t for r in d.select("doc_id", pii.redact(F.col("text")).alias("t")).collect()}
    assert got == {1: "mail me: <EMAIL> now", 2: "x <EMAIL> y", 3: "card <CARD>, not 4111 1111 1111 1112 ip <IP>", 4: None}


def test_iban_before_capitals(spark):
    rows = [(1, "pay GB82 WEST 1234 5698 7654 32 EUR 3000 now"), (2, "GB82WEST12345698765432 PLEASE TRANSFER IT NOW AND HERE"), (3, "GB83 WEST 1234 5698 7654 32 EUR"), (4, "DE89370400440532013000.")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.spans, r.t) for r in pii.report(d).join(d.select("doc_id", pii.redact(F.col("text")).alias("t")), "doc_id").collect()}
    assert got[1] == ("iban:4:31", "pay <IBAN> EUR 3000 now") and got[2] == ("iban:0:22", "<IBAN> PLEASE TRANSFER IT NOW AND HERE")
    assert got[3][0] == "" and got[4] == ("iban:0:22", "<IBAN>.")


def test_substrings(docs, plain, empty):
    want = brute.substrings([t for _, t in plain])
    same(substrings.deduplicate(docs, block_bytes=50_000).collect(), [(i, *w) for (i, _), w in zip(plain, want, strict=True)])
    assert substrings.deduplicate(empty).count() == 0


def test_windows_of_one_hash():
    """Windows with equal 64 bits are told apart by their checks."""
    known, check = np.array([5, 7, 7, 9], np.uint64), np.array([1, 2, 3, 4], np.uint32)

    class Fixed:
        def grams(self, n):
            return np.array([7, 7, 7, 5, 9], np.uint64), np.ones(5, bool)

    old = substrings.Windows.checks
    substrings.Windows.checks = staticmethod(lambda w, n: np.array([3, 2, 8, 1, 5], np.uint32))
    try:
        at, rank = substrings._find(known, check, Fixed(), 1)
    finally:
        substrings.Windows.checks = old
    assert at.tolist() == [0, 1, 3] and rank.tolist() == [2, 1, 0]


@pytest.mark.parametrize("n", [3, 12, 13, 35])
def test_substrings_of_few_words(spark, n):
    """Dense repeats across many small blocks, windows of several lengths."""
    rng = random.Random(n)
    texts = [" ".join(rng.choice("abc") * rng.randint(1, 2) for _ in range(rng.randint(0, 120))) for _ in range(60)] + ["z " * 90, "a b c " * 40]
    got = substrings.deduplicate(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), n, block_bytes=500)
    same(got.collect(), [(i, *w) for i, w in enumerate(brute.substrings(texts, n))])


def test_factors_name_their_reference(spark):
    """Each factor's words stand at its reference, which is the first place of its first window."""
    rng = random.Random(2)
    one, two = ([f"w{rng.randrange(10**6)}" for _ in range(80)] for _ in range(2))
    rows = [(0, " ".join(one)), (1, " ".join(two)), (2, " ".join(one[10:60] + two[20:70])), (3, "x y z")]
    got = {r.doc_id: r.spans for r in substrings.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), with_text=True).collect()}
    assert got[2] == [0, 50, 0, 10, 50, 100, 0, 100] and got[0] == [10, 60, 0, 10] and got[3] == []


def test_decontamination(spark, docs, plain, empty, monkeypatch):
    items = [(1, "The quick brown fox jumps over a lazy dog and the quick"), (2, "two WORDS"), (3, None), (None, "no id"), (4, "..."), (5, plain[0][1][:300])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute.decontaminate([t for _, t in plain], [("" if i is None else i, t or "") for i, t in items])
    same(decontaminate.report(docs, bench).collect(), [(i, *w) for (i, _), w in zip(plain, want, strict=True)])
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 100)  # several blocks, same result
    same(decontaminate.report(docs, bench).collect(), [(i, *w) for (i, _), w in zip(plain, want, strict=True)])
    clean = decontaminate.without_hits(docs, bench)
    assert clean.columns == docs.columns and clean.where("doc_id = 1000004").first().text.strip() == ""
    assert decontaminate.report(empty, bench).count() == 0 and decontaminate.report(docs, bench.limit(0)).where("contaminated").count() == 0


def test_quality(docs, plain, empty):
    got = quality.judge(docs)
    same(got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect(), [(i, *brute.quality(t)) for i, t in plain])
    assert got.where("base_failed and kept").count() == 0 and quality.judge(empty).count() == 0
    assert sorted(r.doc_id or 0 for r in quality.good(docs).collect()) == sorted(r.doc_id or 0 for r in got.where("kept").collect())


def test_repeats_between_windows_of_one_hash(spark):
    """B has the first 36 bits of the hash of A and stands between A's places."""
    a, b = "k293334 l293334 m293334", "k481096 l481096 m481096"
    text = f"{a} x1 {b} x2 {a} x3 x4"
    got = quality.judge(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert got.n_repeat_words == brute.quality(text)[4] == 6


def test_quality_plan_is_small(spark):
    """Features are worked out once, not at each use."""
    plan = quality.good(documents(spark, SF))._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 20_000 and "regexp_extract_all" not in plan


def test_quality_against_labels(spark):
    got = quality.judge(documents(spark, "/root/testdata/sf0.01")).toPandas()
    held = pd.read_parquet("/root/testdata/sf0.01/labels.parquet").rename(columns={"quality": "label"}).merge(got, on="doc_id")
    held = held[~held.base_failed]
    assert (held.kept == (held.label == 1)).mean() > 0.97


def test_em_separates_planted_rules():
    rng = random.Random(1)
    counts = {}
    for _ in range(5000):
        good = rng.random() < 0.8
        v = tuple(rng.choice((1, 1, 1, 0) if good else (-1, -1, 1, 0)) if i < 4 else rng.choice((1, -1, 0)) for i in range(5))
        counts[v] = counts.get(v, 0) + 1
    prior, w = quality.estimate(counts, 5)
    assert 0.7 < 1 / (1 + np.exp(-prior)) < 0.95 and all(x[-1] < -1 for x in w[:4]) and abs(w[4][-1]) < 0.7


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("<p>a<p>b <b>c</b>d<br>e", "a\n\nb cd\ne"),
        ("<ul><li>x<li>y<ol><li>1<li>2</ol><li>z</ul>", "- x\n- y\n  1. 1\n  2. 2\n- z"),
        ("<table><tr><td>aa<td>b<tr><td>c<td>dddd</table>", "aa  b\nc   dddd"),
        ("<div hidden>no</div><p style='display: none'>no</p>yes<script>if(a<b)</script><!-- no -->", "yes"),
        ("<pre>  x\n    y</pre>&amp; &eacute;", "  x\n    y\n\n& é"),
        ("</p></div>a<b", "a<b"),
        ("<div>" * 20_000 + "deep", "deep"),
    ],
)
def test_html(page, text):
    assert htmltext.page_text(page) == text


@pytest.mark.parametrize(
    "page, text",
    [
        ("<html><head><title>T</title><p>Hello", "Hello"),
        ("<head><meta charset=x><link href=y>\n<script>a</script>Bare <b>text</b>", "Bare text"),
        ("<head><title>T</title></head><p>A<head><p>B", "A\n\nB"),
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>", "a  b\n   c\nd  e"),
        ("<table><tbody><tr><td rowspan=0>a<td>b<tr><td>c<tbody><tr><td>d</table>", "a  b\n   c\nd"),
        ("<table><tr><td colspan=150>a<td>b<tr>" + "<td>" * 150 + "<td>c</table>", "a" + " " * 300 + "b\n" + " " * 301 + "c"),
        ("<svg><defs/><title>no</title><path d='x'/><text>A</text><text>B</text><desc>no</desc></svg>", "A\nB"),
        ("<p>so <math><semantics><mi>x</mi><mo>=</mo><mn>1</mn><annotation>no</annotation></semantics></math> holds", "so x=1 holds"),
        ("<svg><defs><p>Out", "Out"),
    ],
)
def test_html_whole(page, text):
    assert htmltext.page_text(page) == text


def test_html_size_and_time():
    """Text in proportion to the page, and no walk over open elements."""
    import time

    page = "<table><tr><td>" + "x" * 60_000 + "</td></tr>" + "<tr><td>a<td>b</tr>" * 4000 + "</table>"
    assert len(htmltext.page_text(page)) < 10 * len(page)
    wide = "<table><tr>" + "<td>" * 8000 + "z</tr>" + "<tr><td colspan=1000><td>y</tr>" * 2000 + "</table>"
    assert len(htmltext.page_text(wide)) < 50 * len(wide)
    began = time.time()
    htmltext.page_text("<p><button>" + "<div>" * 50_000)
    assert time.time() - began < 5


def test_html_edge_rows(spark):
    rows = [(1, None, "a", 1), (1, None, "a", 1), (None, "<p>x", "b", 2), (2, "", "c", 3)]
    d = spark.createDataFrame(rows, "page_id long, html string, text string, n_words long")
    want = [(1, "", 0, 0), (1, "", 0, 0), (None, "x", 1, 1), (2, "", 0, 0)]
    assert sorted((tuple(r) for r in htmltext.extract(d).collect()), key=str) == sorted(want, key=str)
    assert htmltext.extract(d.limit(0)).count() == 0


def test_html_query(spark):
    assert htmltext.extract(documents(spark, SF, "pages")).where("n_words > 0").count() == 50


def test_suffix_lm(docs, plain, empty):
    rows = [(i, t) for i, t in plain if i is not None]
    got = suffixlm.score(docs.where("doc_id is not null"), block_bytes=50_000)
    h = got.collect()
    want = brute.unigrams(rows)
    by = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in h), key=key)
    assert by == sorted(((i, *w[:4], round(w[4], 6)) for (i, _), w in zip(rows, want, strict=True)), key=key)
    assert all(r.score < 0 and np.isfinite(r.score) for r in h)
    assert suffixlm.score(empty).count() == 0


def test_rare_states_of_a_large_corpus(spark, monkeypatch):
    """A context that a fixed number of places has is a state, however small its share."""
    from batchtide.llm import blocks

    monkeypatch.setattr(suffixlm, "MIN_SHARE", 1e-2, raising=False)  # as if the corpus were larger
    d = spark.createDataFrame([(i, "abra cadabra " * 20 + "qzxqv" * (i < 100)) for i in range(400)], "doc_id long, text string")
    tree = suffixlm.load(suffixlm.train(blocks.blocks(d)))
    assert int.from_bytes(b"xq", "big") in tree.levels[2][0].tolist()


def test_sharded_scores(docs):
    """The blocks' answers are those of the whole tree."""
    from batchtide.llm import blocks

    d = docs.where("doc_id is not null")
    tree = suffixlm.load(suffixlm.train(blocks.blocks(d), 7))
    want = sorted((r.doc_id, tree.scores([(r.text or "").encode()])[0]) for r in d.select("doc_id", "text").collect())
    got = sorted((r.doc_id, r.score) for r in suffixlm.score(d, block_bytes=50_000).select("doc_id", "score").collect())
    assert [i for i, _ in got] == [i for i, _ in want]
    assert [x for _, x in got] == pytest.approx([x for _, x in want], rel=1e-6)


def test_tree_is_a_distribution(spark):
    from batchtide.llm import blocks

    d = spark.createDataFrame([(i, "abra cadabra " * 5) for i in range(50)], "doc_id long, text string")
    tree = suffixlm.load(suffixlm.train(blocks.blocks(d)))
    for context in (b"abracad", b"\n" * 7, b"zzzzzzz"):
        base = int.from_bytes(context[-6:], "big")
        runs = np.array([(base << 8) | s for s in range(256)], np.uint64) & np.uint64((1 << 56) - 1)
        assert (10 ** tree.log10(runs)).sum() == pytest.approx(1.0)
    text = [b"abra cadabra abra", b"xyxyx zzqzz qqqq"]
    assert tree.scores(text)[0] > tree.scores(text)[1]


def test_near_duplicates(docs, plain, empty):
    rows = [(i, t) for i, t in plain if i is not None]
    want = brute.near(rows)
    same(neardup.report(docs.where("doc_id is not null")).collect(), [(i, n, c, i == c) for (i, _), (n, c) in zip(rows, want, strict=True)])
    assert neardup.report(empty).count() == 0
    assert neardup.report(docs).count() == len(plain)


def test_near_duplicates_dense_group(spark):
    rng = random.Random(8)
    base = [f"w{rng.randrange(5000)}" for _ in range(200)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randrange(9)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    want = brute.near(rows)
    got = neardup.report(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    same(got.collect(), [(i, n, c, i == c) for (i, _), (n, c) in zip(rows, want, strict=True)])


@pytest.mark.parametrize("parts", [32, 1])
def test_near_duplicates_large_family(spark, monkeypatch, parts):
    """Near copies at the threshold between texts of one template, by pairs of parts and by prefixes."""
    monkeypatch.setattr(neardup, "BLOCK", 100)
    monkeypatch.setattr(neardup, "UNIT_PAIRS", 50)
    monkeypatch.setattr(neardup, "PARTS", parts)
    rng = random.Random(4)
    template, rows = [f"w{i}" for i in range(200)], []

    def edited(words, n):
        out = list(words)
        for i in rng.sample(range(len(out)), n):
            out[i] = f"x{rng.randrange(10**9)}"
        return out

    for _ in range(400):
        base = edited(template, 4)
        rows += [(len(rows) + i, " ".join(w)) for i, w in enumerate((base, edited(base, 5)))]
    rng.shuffle(rows)
    want = brute.near(rows)
    got = neardup.report(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    same(got.collect(), [(i, n, c, i == c) for (i, _), (n, c) in zip(rows, want, strict=True)])


def test_near_duplicates_thousands(spark):
    """5,000 near copies of one text are one component, told by less than 30 pairs a text."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(5000):
        w = list(base)
        for j in rng.sample(range(len(w)), rng.randrange(8)):
            w[j] = f"x{rng.randrange(10**9)}"
        rows.append((i, " ".join(w)))
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert neardup.report(d).where("component_id = 0").count() == 5000
    scanned = neardup.scan(d, 3)
    made = neardup.forest(scanned, 85).where("a <> b")
    assert made.count() < 30 * 5000


def test_one_of_each_row(spark):
    """Of rows with one id and text the first as JSON stays; columns of any name do."""
    text = "one two three four five six seven"
    rows = [(1, text, "b", 9), (1, text, "a", 8), (2, text + " eight", "z", 7), (None, text, "n", 1), (3, None, "x", 0), (3, None, "x", 0), (4, "", "y", 5)]
    d = spark.createDataFrame(rows, "doc_id long, text string, _n string, uid int")
    got = sorted(((r.doc_id, r._n, r.uid) for r in neardup.one_of_each(d).collect()))
    assert got == [(1, "a", 8), (2, "z", 7), (3, "x", 0), (4, "y", 5)]


@pytest.mark.parametrize("edges", [250_000, 60])
def test_components_of_a_chain(spark, monkeypatch, edges):
    """Whether one task holds all edges or few of them; so too for edges in any order, several times."""
    monkeypatch.setattr(neardup, "EDGES", edges)
    rng = random.Random(edges)
    drawn = [(rng.randrange(800), rng.randrange(800)) for _ in range(500)] * 2
    high, low = neardup.stars(*(np.array(x) for x in zip(*[e for e in drawn if e[0] != e[1]], strict=True)))
    want = dict(zip(high.tolist(), low.tolist(), strict=True)) | {r: r for r in set(low.tolist())}
    assert {r.uid: r.root for r in neardup.components(spark.createDataFrame(drawn, "a long, b long").repartition(9)).collect()} == want
    assert neardup.components(spark.createDataFrame([], "a long, b long")).count() == 0
    chain = [(i, i + 1) for i in range(999)]
    got = neardup.components(spark.createDataFrame([*chain, (5000, 4000), (4000, 4500)], "a long, b long")).collect()
    assert sorted(map(tuple, got)) == [*((i, 0) for i in range(1000)), (4000, 4000), (4500, 4000), (5000, 4000)]
    with pytest.raises(RuntimeError):
        neardup.components(spark.createDataFrame(chain, "a long, b long"), rounds=0)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    d = documents(spark, SF)
    rejected = {r.doc_id for r in quality.judge(d).where("not kept").collect()}
    seen = d
    for name, stage in corpus_pipeline.STAGES[:-1]:
        seen = stage(spark, seen, SF).persist()
        assert seen.columns == d.columns and dict(seen.dtypes) == dict(d.dtypes), name
    left = {r.doc_id: r.text for r in seen.collect()}
    assert not rejected & set(left)
    rows = [(r.doc_id, r.text) for r in d.where(~F.col("doc_id").isin(list(rejected))).select("doc_id", "text").collect()]
    groups = brute.near(rows, 5, 80)
    assert set(left) == {i for (i, _), (_, c) in zip(rows, groups, strict=True) if i == c}
    items = [(r.item_id, r.text) for r in documents(spark, SF, "benchmark").collect()]
    assert not any(x[4] for x in brute.decontaminate(list(left.values()), items))
    assert not any(brute.pii(t) for t in left.values())
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert {i: r.decoded_sha256 for i, r in out.items()} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in left.items()}
