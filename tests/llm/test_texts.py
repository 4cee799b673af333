"""op1, op2, op3, op7, op9 and op10 on small rows: round trips, brute force, and odd input."""

import base64
import hashlib
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shelfmark.llm import html_text, merkle, token_counts, token_files, trie_bpe, warc
from shelfmark.llm.queries import ORACLES, QUERIES, tokenizer_path
from tests.oracle import connect, spark_rows, sql_rows

ODD = ["", None, "a", "The the THE", "x" * 5000, "Σίγμα ΟΔΟΣ é́ ǅ", "a<|endoftext|>b", "tab\tnew\r\nline\x1c\x85end", "I'll don'T 've !!''s 12345 ٣", "日本語 text 😀😀", " lead  double ", "<|startoftext|>", "same text", "same text"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(k, t, f"clash{k}") for k, t in enumerate(ODD)] + [(None, "null id", "c"), (3, "another row of id 3", "c")]
    return spark.createDataFrame(rows, "doc_id long, text string, id string")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, id string")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracles(spark, sf, name):
    assert spark_rows(QUERIES[name](spark, sf)) == sql_rows(connect(sf), ORACLES[name])


# BPE


def test_trie_is_the_library(spark, odd, none):
    tok = Tokenizer.from_file(tokenizer_path())
    bpe = trie_bpe.TrieBpe(tokenizer_path())
    for t in ODD:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        assert bpe.encode(t or "") == ids
        assert bpe.decode(ids) == tok.decode(ids, skip_special_tokens=False)
    got = trie_bpe.encode_and_decode(odd, tokenizer_path(), texts=True)
    assert got.count() == odd.count() and trie_bpe.encode_and_decode(none, tokenizer_path()).count() == 0
    for r in got.join(odd.withColumnRenamed("text", "t"), "doc_id").filter("doc_id <> 3").collect():
        ids = tok.encode(r.t or "", add_special_tokens=False).ids
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_trie_on_documents(spark, sf):
    tok = Tokenizer.from_file(tokenizer_path())
    got = {r.doc_id: r.ids_sha256 for r in QUERIES["op10_trie_bpe"](spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        assert got[r.doc_id] == hashlib.sha256(" ".join(map(str, tok.encode(r.text, add_special_tokens=False).ids)).encode()).hexdigest()


def test_token_files(spark, sf, odd, none, tmp_path):
    tok = Tokenizer.from_file(tokenizer_path())
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    start = 0
    got = {r.doc_id: r for r in token_files.token_file_digests(docs, tokenizer_path()).collect()}
    for r in docs.orderBy("doc_id").collect():
        ids = [*tok.encode(r.text, add_special_tokens=False).ids, 1]
        assert (got[r.doc_id].start, got[r.doc_id].n_tokens) == (start, len(ids))
        assert got[r.doc_id].ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))
        start += len(ids)
    path = str(tmp_path / "odd")
    token_files.write_token_files(odd, path, tokenizer_path())
    rows = token_files.read_token_files(spark, path).orderBy("start").collect()
    assert len(rows) == odd.count() and [r.start for r in rows] == [sum(x.n_tokens for x in rows[:k]) for k in range(len(rows))]
    assert [r.doc_id for r in rows] == [None, 0, 1, 2, 3, 3, *range(4, len(ODD))]
    assert all(r.ids == [*tok.encode(ODD[r.doc_id] or "", add_special_tokens=False).ids, 1] for r in rows if r.doc_id not in (None, 3))
    assert token_files.lookup(spark, path, 5).count() == 1
    assert token_files.token_file_digests(none, tokenizer_path()).count() == 0


@pytest.mark.parametrize("text", ["İ,", "İ.", "é,", "É., x", "ǅ,", "ŉ.", "ß,.", "a\u0301, b", "É\u0327,", "日,", "Σ,", "ΑΣ."])
def test_words_of_other_letters_and_signs(text):
    tok = Tokenizer.from_file(tokenizer_path())
    ids = tok.encode(text, add_special_tokens=False).ids
    got = token_files.RaggedWords(token_files._Library(tokenizer_path()).encode, 10).batch([text])[0].tolist()
    assert got == ids and trie_bpe.TrieBpe(tokenizer_path()).encode(text) == ids


def test_fuzzed_words():
    import random

    tok, rng = Tokenizer.from_file(tokenizer_path()), random.Random(2)
    letters = "abcXYZ'sdtİßéÉñΣς١½Ⅷ日ǅŉ\u0301\u0307,.-!0 19\t\u00a0\u2003"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    words, bpe = token_files.RaggedWords(token_files._Library(tokenizer_path()).encode, 500), trie_bpe.TrieBpe(tokenizer_path())
    for text, got in zip(texts, words.batch(texts), strict=True):
        ids = tok.encode(text, add_special_tokens=False).ids
        assert got.tolist() == ids and bpe.encode(text) == ids, text


@pytest.mark.parametrize("text", ["\u0958,", "x\u0958."])
def test_letters_that_come_apart_keep_the_sign_after_them(text):
    ids = Tokenizer.from_file(tokenizer_path()).encode(text, add_special_tokens=False).ids
    assert token_files.RaggedWords(token_files._Library(tokenizer_path()).encode, 10).batch([text])[0].tolist() == ids


def test_words_of_whole_texts_are_the_library():
    import random

    tok, rng = Tokenizer.from_file(tokenizer_path()), random.Random(3)
    texts = [f"{c}, a{c}. {c} {c}b,\n{c}{c}." for c in map(chr, range(0x2100))]
    texts += ["\u0958,", "x\u0958. y", "#, a", "_, a", "a., b. c", "a, , b", "a<|endoftext|>, B.", "<|ENDOFTEXT|>. A,", "J\u030c, A. b", "", "A."]
    texts += ["".join(rng.choice("abXY'sté\u01c5İ\u0958\u0301,,..# _0\u2026\u00a0 \n") for _ in range(rng.randint(0, 40))) for _ in range(2000)]
    rng.shuffle(texts)
    cached = token_files.LibraryWords(tokenizer_path(), 300)
    for at in range(0, len(texts), 200):
        part = texts[at : at + 200]
        for kind in (pa.string(), pa.large_string()):
            ids, ends = cached.batch(pa.array(part, kind))
            want = [tok.encode(t, add_special_tokens=False).ids for t in part]
            assert [x.tolist() for x in np.split(ids, ends)] == [*want, []]


def test_the_library_gets_few_words_twice():
    seen = Counter()
    cached = token_files.LibraryWords(tokenizer_path(), 100)
    flat = cached.cache.encode
    cached.cache.encode = lambda words: seen.update(words) or flat(words)
    for k in range(20):
        cached.batch(pa.array([f"The the, THE. the\nnorth north, {' '.join(f'w{k}x{j}' for j in range(60))}"] * 2 + [f"rare{chr(97 + k)}"]))
    assert seen["the"] == seen["north"] == 1 and not {"The", "THE.", "the,", "north,"} & seen.keys()
    assert len(cached.cache.words) <= 100 + 70


def test_trie_of_whole_texts_is_the_library(monkeypatch):
    import random
    import unicodedata

    monkeypatch.setattr(trie_bpe, "WORDS_KEPT", 300)
    monkeypatch.setattr(trie_bpe, "PAIRS_KEPT", 1000)
    monkeypatch.setattr(trie_bpe, "AT_ONCE", 50)
    tok, rng = Tokenizer.from_file(tokenizer_path()), random.Random(4)
    texts = [f"{c}, a{c}. {c} {c}b,\n{c}{c}." for c in map(chr, range(0x2100)) if unicodedata.category(c) != "Cn"]
    texts += ["\u0958,", "x\u0958. y", "a., b. c", "a<|endoftext|>, B.", "<|ENDOFTEXT|>. A,", "J\u030c, A. b", "", "A.", "it's I'LL don't's", "the them theme there"]
    texts += ["".join(rng.choice("abXY'sté\u01c5İ\u0958\u0301,,..# _0\u2026\u00a0 \n") for _ in range(rng.randint(0, 40))) for _ in range(2000)]
    texts += [" ".join("".join(rng.choices("aeinstü", k=rng.randint(1, 9))) for _ in range(30)) for _ in range(300)]
    rng.shuffle(texts)
    cached = trie_bpe._Encoded(trie_bpe.TrieBpe(tokenizer_path()))
    for at in range(0, len(texts), 200):
        part = texts[at : at + 200]
        ids, starts = cached.flat(pa.array(part))
        assert [x.tolist() for x in np.split(ids, starts[1:])] == [*(tok.encode(t, add_special_tokens=False).ids for t in part), []]


def test_the_trie_gets_few_words_twice(monkeypatch):
    monkeypatch.setattr(trie_bpe, "WORDS_KEPT", 100)
    monkeypatch.setattr(trie_bpe, "PIECES_KEPT", 50)
    bpe, seen = trie_bpe.TrieBpe(tokenizer_path()), Counter()
    walk = bpe.encode_words
    bpe.encode_words = lambda words: seen.update(words) or walk(words)
    cached = trie_bpe._Encoded(bpe)
    for k in range(20):
        cached.flat(pa.array([f"The the, THE. the\nnorth north, {' '.join(f'w{chr(97 + k)}x{chr(97 + j % 26)}y{chr(97 + j // 26)}' for j in range(60))}"] * 2))
    assert seen["the"] == seen["north"] == 1
    assert len(cached.words.words) <= 100 + 70


def test_words_that_begin_alike():
    tok, bpe = Tokenizer.from_file(tokenizer_path()), trie_bpe.TrieBpe(tokenizer_path())
    words = sorted({w[:k] for w in ("internationalisation", "internet", "interns", "into", "zzzzzzzz", "a") for k in range(1, len(w) + 1)})
    assert list(bpe.encode_words(words)) == [tok.encode(w, add_special_tokens=False).ids for w in words]


def test_other_tokenizer_files_are_refused(odd):
    other = tokenizer_path("byte_bpe_50k.json")
    for use in (trie_bpe.encode_and_decode, token_files.token_file_digests):
        with pytest.raises(ValueError, match="pre_tokenizer"):
            use(odd, other)


def test_many_rows_of_one_id_are_spread(spark, tmp_path):
    rows = [(7, f"text {k % 50}") for k in range(3000)] + [(None, "n")] * 500 + [(k, "x") for k in range(20)]
    path = str(tmp_path / "hot")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # for so few rows
    try:
        token_files.write_token_files(spark.createDataFrame(rows, "doc_id long, text string"), path, tokenizer_path())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = token_files.read_token_files(spark, path).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i))
    assert [r.start for r in got] == [sum(len(x.ids) for x in got[:k]) for k in range(len(got))][: len(got)]
    sizes = spark.read.orc(path).groupBy(F.col("_metadata.file_path")).count().collect()
    assert max(r["count"] for r in sizes) <= len(rows) / 3


# Token counts


def test_sections(spark, odd, none):
    ranks, pattern = tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    encode, lengths = token_counts.byte_encoder(ranks, pattern)
    for rule in token_counts.RULES:
        rows = token_counts.section_tokens(odd, ranks, pattern, rule).filter("doc_id <> 3").collect()
        by_doc = {}
        for r in rows:
            by_doc.setdefault(r.doc_id, []).append(r)
        for k, own in by_doc.items():
            text = (ODD[k] if k is not None else "null id") or ""
            own.sort(key=lambda r: r.section)
            assert "".join(text[r.start_char : r.end_char] for r in own) == text
            assert abs(sum(r.n_tokens for r in own) - len(encode(text))) < 1e-9 and own[0].doc_tokens == len(encode(text))
    assert token_counts.section_tokens(none, ranks, pattern).count() == 0


def test_sections_against_brute_force(spark, sf):
    """Each token's characters looked at one by one."""
    ranks, pattern = tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    encode, lengths = token_counts.byte_encoder(ranks, pattern)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()} | {-k: t for k, t in enumerate(ODD, 1)}
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    got = {}
    for rule in token_counts.RULES:
        for r in token_counts.section_tokens(df, ranks, pattern, rule).collect():
            got[rule, r.doc_id, r.section] = r.n_tokens
    seen = 0
    for doc, text in docs.items():
        text = text or ""
        owner = [k for k, c in enumerate(text) for _ in c.encode()]  # character of each byte
        begins = [j == 0 or owner[j] != owner[j - 1] for j in range(len(owner))]
        section, now = [], 0
        for c in text:
            section.append(now)
            now += c == "\n"
        want = {rule: {} for rule in token_counts.RULES}
        at = 0
        for t in encode(text):
            stop = at + int(lengths[t])
            chars = [owner[j] for j in range(at, stop) if begins[j]] or [owner[at]]
            held = {}
            for c in chars:
                held[section[c]] = held.get(section[c], 0) + 1
            for rule, parts in (("first", {section[chars[0]]: 1}), ("most", {max(held, key=lambda k: (held[k], -k)): 1}), ("share", {k: n / len(chars) for k, n in held.items()})):
                for k, n in parts.items():
                    want[rule][k] = want[rule].get(k, 0) + n
            at = stop
        for rule in token_counts.RULES:
            for k in range(section[-1] + 1 if section else 1):
                assert abs(got[rule, doc, k] - want[rule].get(k, 0)) < 1e-6, (rule, doc, k)
                seen += 1
    assert seen > 1000


def test_crossing_tokens():
    import numpy as np

    # "ab", "c\n\nd" crosses both borders, "ef"
    counts = lambda rule: token_counts.attribute("abc\n\ndef", np.array([2, 4, 2]), rule)[2].tolist()
    assert counts("first") == [2, 0, 1] and counts("most") == [2, 0, 1] and counts("share") == [1.5, 0.25, 1.25]
    # One character over three tokens of a byte each: all belong to it.
    assert token_counts.attribute("日", np.array([1, 1, 1]), "most")[2].tolist() == [3]


# WARC


def test_warc_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u1", "<p>é</p>", "x"), (2, "u2", "<p>é</p>", "x"), (3, None, None, "x"), (4, "u\r\nX: y", "", "x"), (5, "u5", "WARC/1.1\r\n\r\n", "x"), (None, "u6", "<p>é</p>", "x"), (7, "u7", "only", "x")], "page_id long, url string, html string, digest string")
    path = str(tmp_path / "w")
    warc.write_archive(pages, path)
    archive = warc.read_archive(spark, path)
    got = {r.page_id: r for r in warc.parsed(archive).collect()}
    assert len(got) == 7 and all(r.header_agrees for r in got.values())
    assert [(got[k].record_type, got[k].refers_to) for k in (1, 2, 3, 4, 5, None, 7)] == [("revisit", 2), ("response", None), ("revisit", 4), ("response", None), ("response", None), ("revisit", 2), ("response", None)]
    assert [got[k].url for k in (1, 3, 4, None)] == ["u1", "", "u\r\nX: y", "u6"]
    assert got[1].payload_digest == base64.b32encode(hashlib.sha1("<p>é</p>".encode()).digest()).decode() and got[1].payload_bytes == 9 and got[3].payload_bytes == 0
    assert spark.read.parquet(f"{path}/payloads").count() == 4
    records = sorted(bytes(r.record) for r in warc.record_bytes(archive).collect())
    want = next(r for r in records if b"<urn:page:5>" in r)
    assert want.endswith(b"Content-Length: 12\r\n\r\nWARC/1.1\r\n\r\n\r\n\r\n")
    empty = str(tmp_path / "e")
    warc.write_archive(pages.limit(0), empty)
    assert warc.read_archive(spark, empty).count() == 0


# HTML

ARTICLE = """<html><head><title>T</title><style>p{}</style><script>if (a<b) "</p>"</script></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href=/a>Home</a></li></ul></nav><div class="cookie-notice"><p>We use cookies, please accept them, thanks.</p></div>
<div id="sidebar"><p>Other things to read, and many more.</p></div>
<article><h1>A &amp; B</h1><p>First   paragraph, with <b>bold</b>er text.<p>Second<br>line; it goes on, and on.</p><ul><li>item one</li></ul><form><p>Sign up, now.</p></form></article>
<section class="comments"><p>Great post, really, I liked it a lot.</p></section><footer>&copy; 2000</footer></body></html>"""


def test_main_text(spark):
    want = "A & B First paragraph, with bolder text. Second line; it goes on, and on. item one"
    assert html_text.main_text(ARTICLE) == want
    plain = ARTICLE.replace("<article>", "<div class=post>").replace("</article>", "</div>")
    assert html_text.main_text(plain) == want
    df = spark.createDataFrame([(1, "u", ARTICLE, 1), (2, None, None, 2), (3, "u", "", 3), (4, "u", "<p>a &am<p", 4), (1, "u", "just text", 5)], "page_id long, url string, html string, text int")
    got = sorted((r.page_id, r.text, r.n_chars) for r in html_text.extract(df).collect())
    assert got == [(1, want, len(want)), (1, "just text", 9), (2, "", 0), (3, "", 0), (4, "a &am<p", 7)]
    assert html_text.extract(df.limit(0)).count() == 0


def test_article_pages(spark, sf):
    """Against the blocks of the article element, which these pages all have."""
    import html as h
    import re

    got = {r.page_id: r.text for r in QUERIES["op1_html_text"](spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        inside = re.search(r"<article>(.*)</article>", r.html, re.S)
        text = re.sub(r"</?(?:p|h1|br)[^>]*>", " ", inside[1])
        assert got[r.page_id] == " ".join(h.unescape(re.sub(r"<[^>]+>", "", text)).split())


def article_text(html):
    import html as h
    import re

    inside = re.search(r"<article>(.*)</article>", html, re.S)
    return " ".join(h.unescape(re.sub(r"<[^>]+>", "", re.sub(r"</?(?:p|h1|br)[^>]*>", " ", inside[1]))).split())


def test_ratios_decide(spark, monkeypatch):
    """Pages whose elements say less and less of themselves: what is left to go by is the ratios of their paths."""
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    want = list(map(article_text, pages))
    right = lambda change: sum(html_text.main_text(change(p)) == w for p, w in zip(pages, want, strict=True)) / len(pages)
    div = lambda p: p.replace("<article>", "<div>").replace("</article>", "</div>")
    plain = lambda p: div(p).replace(' class="ad"', "")
    bare = lambda p: plain(p).replace("<nav>", "<div>").replace("</nav>", "</div>").replace("<footer>", "<div>").replace("</footer>", "</div>")
    assert right(lambda p: p) == 1 and right(div) >= 0.98 and right(plain) >= 0.85 and right(bare) >= 0.65
    for threshold in (-1, 1e9):
        monkeypatch.setattr(html_text, "THRESHOLD", threshold)
        assert right(lambda p: p) == 0


def test_path_ratios_against_brute_force():
    page = html_text.Page(ARTICLE)
    blocks = [b for b in page.blocks if b.linked <= html_text.LINKS * len(b.text)]
    kernel = [0.02, 0.13, 0.7, 0.13, 0.02]

    def by_path(values):
        same = [[j for j, c in enumerate(blocks) if (c.path, c.weight) == (b.path, b.weight)] for b in blocks]
        return [sum(values[j] for j in own) / len(own) for own in same]

    def around(values):
        out = []
        for k in range(len(values)):
            near = [(kernel[2 + d], values[k + d]) for d in range(-2, 3) if 0 <= k + d < len(values)]
            out.append(sum(w * v for w, v in near) / sum(w for w, _ in near))
        return out

    length = around(by_path([len(b.text) - b.linked for b in blocks]))
    marks = around([m + 0.1 for m in by_path([sum(c in ".,;:!?" for c in b.text) for b in blocks])])
    fused = [x * y * b.weight for x, y, b in zip(length, marks, blocks, strict=True)]
    ratio, mean = html_text.path_ratios(blocks)
    assert ratio.tolist() == pytest.approx(by_path(fused))
    weights = [len(b.text) - b.linked + 1 for b in blocks]
    assert mean == pytest.approx(sum(f * w for f, w in zip(fused, weights, strict=True)) / sum(weights))


def test_names_destroy_nothing():
    body = "".join(f"<p>Sentence {k} of the article, which is long enough, has commas, and ends here.</p>" for k in range(6))
    for name in ("search-results-page", "article-form-factor", "related-menu widget"):
        for inner in (f"<article><h1>Head</h1><div class='{name}'>{body}</div></article>", f"<div class='{name}'><h1>Head</h1>{body}</div>", f"<article class='{name}'><h1>Head</h1>{body}</article>"):
            assert html_text.main_text(f"<body><nav><a>Menu</a></nav>{inner}<footer>End, of all.</footer></body>").count("Sentence") == 6
    # A link counts however deep in inline elements its text is, and an unnamed nested part of an article is kept.
    deep = "<a href=x>" + "<b><i>" * 8 + "Read this other story, it is good, and long" + "</i></b>" * 8 + "</a>"
    page = f"<body><article><h1>Head</h1>{body}<div><p>Short part</p></div><ul><li>{deep}</li></ul></article></body>"
    assert "other story" not in html_text.main_text(page) and html_text.main_text(page).endswith("Short part")


def test_long_page():
    body = "<p>A sentence, which is one of many.</p>" * 20_000
    text = html_text.main_text(f"<nav>{'<a>link</a>' * 2000}</nav><div>{body}</div>")
    assert text.count("sentence") == 20_000 and "link" not in text


# Merkle


def test_ranges_don_t_change_neighbours(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    a, b = (spark_rows(merkle.edited_neighbours(docs, range_rows=n)) for n in (2000, 13))
    assert a == b


def test_hot_ids_are_split(spark):
    rows = [(k, f"text {k} " * 5) for k in range(200)] + [(50, f"other text {k % 40} of a hot id, {k % 40}") for k in range(900)] + [(None, "null id")] * 700 + [(60, "one text")] * 500 + [(None, f"null {k}") for k in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    ranges = merkle.Ranges.of(df.select(F.col("doc_id").alias("id")), 50)
    assert {50, 60, None} <= set(ranges.hot)
    found = merkle.edited_neighbours(df, range_rows=50)
    got = found.collect()
    assert len(got) == len(rows)
    same = lambda i: sorted(r.fingerprint for r in got if r.doc_id == i)
    roots = {(r.doc_id, r.text): r.f for r in df.distinct().select("doc_id", "text", merkle.root(F.col("text")).alias("f")).collect()}
    for i in (None, 50, 60, 7):
        assert same(i) == sorted(roots[i, t] for k, t in rows if k == i)
    # Each row is followed by one, and each row but one of the highest id follows one: what edits take from the next text shows which.
    nexts = Counter()
    edits = {}
    for a in roots:
        for b in roots:
            if a[0] == b[0] or (a[0] is not None and (b[0] is None or b[0] < a[0])) or (a[0] is None and b[0] == 199):
                k = len(a[1]) // 3
                edits.setdefault((a[0], hashlib.sha256((a[1][: len(a[1]) - k] + b[1][:k]).encode()).hexdigest()), b)
    for r in got:
        follower = edits[r.doc_id, r.edited_sha256]
        nexts[follower[0]] += 1
    assert sum(nexts.values()) == len(rows)
    plan = found._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_merkle_odd(spark, odd, none):
    rows = merkle.edited_neighbours(odd, range_rows=3).collect()
    assert len(rows) == odd.count() and merkle.edited_neighbours(none).count() == 0
    by_id = {r.doc_id: r for r in rows}
    assert by_id[12].fingerprint == by_id[13].fingerprint and by_id[13].near_next == 1.0 and by_id[0].fingerprint == by_id[1].fingerprint
    assert by_id[7].n_chars == len(ODD[7]) and all(0 <= r.near_edited <= 1 for r in rows)
    text, nxt = ODD[8], ODD[7]
    k = len(text) // 3
    assert by_id[8].edited_sha256 == hashlib.sha256((text[: len(text) - k] + nxt[:k]).encode()).hexdigest()
    one = merkle.edited_neighbours(odd.filter("doc_id = 2")).first()
    assert one.near_next == 1.0


def test_merkle_locates_edits(spark):
    rows = lambda lines: merkle.tree(spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string"))
    old = [f"line {k}" for k in range(50)]
    new = [*old[:20], "changed", *old[21:]]
    d = merkle.differing_paragraphs(rows(old), rows(new)).first()
    assert (d.removed, d.added) == ([20], [20])
    a, b = rows(old).first(), rows(new).first()
    assert a.root != b.root and len(set(a.sections) ^ set(b.sections)) <= 4
    assert rows(old).select(F.size("leaves")).first()[0] == 50


def test_wrappers_named_like_excluded_elements_keep_the_article():
    body = "".join(f"<p>Sentence {k} of the article, which is long enough, has commas, and ends here.</p>" for k in range(6))
    side = "<div class='sidebar'><p>Beside it, short.</p></div>"
    comments = "<div id='comments'><article><p>A comment, which is no part of it, as it says.</p></article></div>"
    for wrapper in ("div class='content-sidebar-wrap'", "div class='layout-right-sidebar'", "div id='page-with-sidebar'", "form action='x'"):
        end = wrapper.split()[0]
        for inner in (f"<main>{body}</main>", f"<article>{body}</article>", f"<div>{body}</div>"):
            text = html_text.main_text(f"<body><nav>Menu</nav><{wrapper}>{inner}{side}{comments}</{end}><footer>End.</footer></body>")
            assert text.count("Sentence") == 6 and "Beside" not in text and "comment" not in text and "Menu" not in text
    # Comments stay out however long they are.
    assert "comment" not in html_text.main_text(f"<body><div><p>One, two, three.</p></div>{comments * 9}</body>")
