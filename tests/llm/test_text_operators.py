"""URL filter, host rules, media, BPE and extraction on small and odd inputs."""

import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from conftest import DATA, same_as_sql
from nearfield.llm import bpe, html, media, queries, rules, urls

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    None,
    "",
    " \n\t ",
    "Hello's wörld!!'s 123 naïve<|endoftext|>x qzqz é\u0301",
    "a\u00a0b\u2003c x\u0301 İSTANBUL ΑΣ ß Ⅷ ½ 漢字テスト 🎉🎉!!\u200d",
    "<|startoftext|><|endoftext|>  <|start",
    "it's'll 'Re''ve we’re",
    "x\x1cy\x85z \ufeff \x00",
    "word " * 3000,
    "q" * 5000,
    "Hello's wörld!!'s 123 naïve<|endoftext|>x qzqz é\u0301",
]


def docs(spark, texts, **more):
    """Documents with null ids among them and extra columns that clash with results."""
    rows = [(None if i == 5 else i, t, "s" if i % 2 else None, "clash", "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, score string, size string")


def test_queries_equal_sql(spark):
    for name, sql in queries.ORACLE_SQL.items():
        same_as_sql(spark, queries.QUERIES[name], sql)


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(PATH)
    rng = random.Random(7)
    letters = "abcxyz'’.!<|>é ß1２²\n\t\u0301\u00a0日"
    texts = [*ODD, *("".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(200))]
    out = bpe.encode_documents(docs(spark, texts).drop("doc_id").withColumn("decoded", F.lit("x")), PATH).collect()
    encoded = [whole.encode(t or "", add_special_tokens=False) for t in texts]
    assert len(out) == len(texts)
    for got, want in zip(out, encoded, strict=True):
        assert got.token_ids == want.ids and got.decoded == whole.decode(want.ids, skip_special_tokens=False)
    again = bpe.decode_ids(bpe.encode_documents(docs(spark, texts).drop("doc_id"), PATH, decoded=None), PATH)
    assert [r.decoded for r in again.collect()] == [r.decoded for r in out]


def test_forced_boundaries_are_in_no_token():
    e = bpe.ForcedBoundaryEncoder(PATH)
    pieces = ["hello", "qzqzx", "жq", "…!"]
    for piece, parts in zip(pieces, e.fragments(pieces), strict=True):
        assert "".join(parts) == piece
        for a, b in zip(parts, parts[1:], strict=False):
            assert not e.pairs[a.encode()[-1], b.encode()[0]]
    assert not e.pairs[32].any() and not e.pairs[:, 32].any()


def test_urls_odd(spark):
    given = [
        (1, None), (2, ""), (3, "no scheme/porn"), (4, "http://EXAMPLE.com/en/7x?q#f"), (5, "http://xexample.com/en/7"), (6, "x://a.b.net/de/"),
        (7, "http://h/free-bets"), (8, "http://h/free/free"), (9, "http://h/alphabet-free"), (10, "http://adult-x.h/"), (11, "http://h#/x?y"), (12, "http://h/\nPORN"), (13, "a://b://c/d"),
        (14, "http://net/de/8"), (15, "http://É.org/es/" + "x" * 10_000),
    ]
    df = spark.createDataFrame([(*r, "clash") for r in given], "page_id long, url string, host string")
    got = {r.page_id: r for r in urls.filter_urls(df).collect()}
    assert [(got[i].host, got[i].path) for i in (1, 2, 3)] == [("", "")] * 3
    assert (got[4].host, got[4].path, got[4].rule, got[4].verdict) == ("example.com", "/en/7x", "example.com/en/7", "allow")
    assert (got[5].rule, got[5].verdict) == ("com/en/", "block")
    assert (got[6].rule, got[6].verdict) == ("net/de/", "block")
    assert [got[i].verdict for i in (7, 8, 9, 10)] == ["block", "allow", "allow", "block"]
    assert got[8].soft_terms == ["free"] and got[10].strict_terms == ["adult"]
    assert (got[11].host, got[11].path) == ("h", "") and got[12].verdict == "block" and got[3].verdict == "block"
    assert (got[13].host, got[13].path) == ("b:", "//c/d")
    assert got[14].rule == "net/de/" and got[15].host == "É.org" and got[15].rule == "org/es/"
    assert urls.filter_urls(df.limit(0)).count() == 0


def test_stems_weights_and_vocabularies_from_tables(spark):
    rows = [("soft", "deal", "Deal", 1), ("soft", "deal", "deals", None), ("soft", None, "heavy", 2), ("soft", "x", "light", 0), ("strict", "y", "bad", 1), ("soft", "z", "bad", 1), ("soft", "n", None, 1), ("soft", "n", "", 1)]
    vocabulary = urls.vocabulary_of(spark.createDataFrame(rows, "kind string, stem string, form string, weight int"))
    assert {t.form: (t.stem, t.weight, t.strict) for t in vocabulary} == {"deal": ("deal", 1, False), "deals": ("deal", 1, False), "heavy": ("heavy", 2, False), "light": ("x", 0, False), "bad": ("y", 1, True)}
    given = ["http://h/deal-deals", "http://h/deal-light", "http://h/heavy", "http://h/BAD", "http://h/x", "http://h/free-bets", None]
    df = spark.createDataFrame(list(enumerate(given)), "page_id long, url string")
    verdicts = lambda v: [r.verdict for r in urls.filter_urls(df, vocabulary=v).orderBy("page_id").collect()]
    assert verdicts(vocabulary) == ["allow", "allow", "block", "block", "allow", "allow", "allow"]
    assert verdicts(urls.VOCABULARY)[0] == "allow" and verdicts(urls.VOCABULARY)[5] == "block"  # one idea, two ideas
    assert set(verdicts(())) == {"allow"}
    with pytest.raises(ValueError):
        urls.vocabulary_of(spark.createDataFrame([("odd", "a", "a", 1)], "kind string, stem string, form string, weight int"))


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = {}
    for i in range(len(words) - 4):
        grams.setdefault(tuple(words[i : i + 5]), []).append(i)
    covered = {i + k for at in grams.values() if len(at) > 1 for i in at for k in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_host_rules_count_like_brute_force(spark):
    rng = random.Random(3)
    texts = [*ODD[:8], *(" ".join(rng.choice("ab") for _ in range(rng.randrange(30))).replace("a b a", "a\nb\n\n") for _ in range(80)), "a b c d e", "a b c d e a b c d e", "x " * 4000, "#*|a\x0bb\x0cc <>"]
    got = rules.judge(docs(spark, texts).withColumn("n", F.monotonically_increasing_id()).withColumn("n_words", F.lit("clash"))).drop("doc_id").collect()
    by_n = {r.n: r for r in got}
    assert len(got) == len(texts)
    order = [by_n[k] for k in sorted(by_n)]
    for text, r in zip(texts, order, strict=True):
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_counts(text), text
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
    assert rules.judge(docs(spark, texts).limit(0)).count() == 0


def test_bad_hosts_go_and_small_ones_are_shrunk(spark):
    rows = [("good", False)] * 200 + [("bad", True)] * 90 + [("bad", False)] * 10 + [("small", True)] + [("mid", False)] * 95 + [("mid", True)] * 5 + [(None, False)] * 50
    got = {r.host: r for r in rules.host_verdicts(spark.createDataFrame(rows, "host string, base_failed boolean")).collect()}
    assert got["good"].host_kept and not got["bad"].host_kept and got[None].host_kept
    assert got["small"].shrunk_rate < 1 and got["bad"].shrunk_rate < 0.9


def test_host_verdicts_decide_rows(spark):
    """A host of junk takes its few good documents along; a small host with as high a rate is drawn back and stays."""
    good = " ".join(f"word{i}" for i in range(30))
    rows, n = [], 0
    for host, docs_, bad in [*((f"h{i}", 20, i % 3) for i in range(40)), ("junk", 60, 55), ("small", 3, 2), (None, 20, 1)]:
        for i in range(docs_):
            rows.append((n := n + 1, host, "too short" if i < bad else good))
    got = rules.judge(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    rates = {h: (sum(r.source == h and r.base_failed for r in got), sum(r.source == h for r in got)) for h in {r.source for r in got}}
    each = [f / n for f, n in rates.values()]
    m = sum(each) / len(each)
    v = sum((x - m) ** 2 for x in each) / len(each)
    s = m * (1 - m) / v - 1
    limit = max(0.5, min(m + 2 * (m * (1 - m) / (s + 1)) ** 0.5, (1 + m) / 2))
    for r in got:
        f, n = rates[r.source]
        assert r.shrunk_rate == pytest.approx((f + m * s) / (n + s))
        assert r.kept == (not r.base_failed and (f + m * s) / (n + s) <= limit)
    assert all(r.kept == (not r.base_failed) for r in got if r.source != "junk") and not any(r.kept for r in got if r.source == "junk")
    assert rates["small"][0] / rates["small"][1] > limit > rules.HOST_LEAST - 1e-9


def test_one_host_has_a_prior(spark):
    got = rules.host_verdicts(spark.createDataFrame([("a", False)] * 3, "host string, base_failed boolean")).first()
    assert got.shrunk_rate == 0 and got.host_kept


def test_media_round_trip(spark):
    texts = [*ODD, "x" * 576, "y" * 577, "é" * 20_000]
    df = docs(spark, texts).withColumn("media", F.lit("clash")).drop("doc_id").withColumn("n", F.monotonically_increasing_id())
    got = media.load(media.store(df)).orderBy("n").collect()
    assert len(got) == len(texts)
    for text, r in zip(texts, got, strict=True):
        raw = (text or "").encode()
        size = max(1, -(-len(raw) // 576)) * 576
        assert bytes(r.payload) == raw + b"\xff" * (size - len(raw)) and r.n_bytes == len(raw)
        assert media.read_wav(bytes(r.media)) == bytes(r.payload) and len(r.pcm16k) == 4 * size
    assert got[3].feature == got[10].feature != got[4].feature
    assert media.store(df.limit(0)).count() == 0
    for broken in (b"", b"RIFF1234WAVE", b"RIFFxxxxWAVEfmt \x02\x00\x00\x00\x01\x00"):
        with pytest.raises(ValueError):
            media.read_wav(broken)


def test_companding_tables():
    # Ends and middle of the G.711 tables.
    assert media.MU_LAW[[0x00, 0x80, 0x7F, 0xFF]].tolist() == [-32124, 32124, 0, 0]
    assert media.A_LAW[[0x55, 0xD5, 0x2A, 0xAA]].tolist() == [-8, 8, -32256, 32256]
    assert (np.diff(np.sort(media.MU_LAW.astype(int))) >= 0).all() and len(set(media.A_LAW.tolist())) == 256


def slow_adpcm(block):
    sample = int.from_bytes(block[:2], "little", signed=True)
    index = min(block[2], 88)
    out = [sample]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(media.STEPS[index])
            change = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
            sample = max(-32768, min(32767, sample - change if code & 8 else sample + change))
            index = max(0, min(88, index + int(media.INDEX_MOVES[code & 7])))
            out.append(sample)
    return out


def test_adpcm_blocks_equal_the_scalar_decoder():
    raw = np.random.default_rng(1).integers(0, 256, (50, 36), np.uint8)
    assert media.decode_adpcm(raw).tolist() == [slow_adpcm(bytes(b)) for b in raw]


def slow_expand(law, code):
    """G.711 by its segments, one sample at a time."""
    if law == "mu-law":
        code = 255 - code
        size = (33 + 2 * (code % 16)) * 2 ** (code // 16 % 8) - 33
        return (-4 if code >= 128 else 4) * size
    code ^= 0b01010101
    segment, step = code // 16 % 8, code % 16
    size = 2 * step + 1 if segment == 0 else (2 * step + 33) * 2 ** (segment - 1)
    return (8 if code >= 128 else -8) * size


def test_companding_equals_the_segments():
    assert [slow_expand("mu-law", c) for c in range(256)] == media.MU_LAW.tolist()
    assert [slow_expand("a-law", c) for c in range(256)] == media.A_LAW.tolist()


def slow_feature(payload):
    """The feature string by plain loops."""
    mu, a = ([slow_expand(law, c) for c in payload] for law in ("mu-law", "a-law"))
    double = [x for p, q in zip(mu, [*mu[1:], mu[-1]], strict=True) for x in (p, (p + q) // 2)]
    adpcm = [x for i in range(0, len(payload), 36) for x in slow_adpcm(payload[i : i + 36])]
    mean = lambda x: sum(v * v for v in x) // len(x)
    crossings = sum((p < 0) != (q < 0) for p, q in zip(mu, mu[1:], strict=False))
    return f"mu={mean(mu)};a={mean(a)};pcm16k={mean(double)};zc={crossings};adpcm={mean(adpcm)};peak={max(map(abs, adpcm))}"


def test_features_equal_plain_loops():
    rng = np.random.default_rng(4)
    payloads = [media.payload_of(x) for x in (b"", "Hello wörld".encode() * 60, bytes(rng.integers(0, 256, 1500, np.uint8)), b"\x00" * 600, b"\x80\x7f" * 300)]
    assert media.features(payloads) == list(map(slow_feature, payloads))


@pytest.mark.parametrize("codec", ["mu-law", "a-law", "ima-adpcm"])
def test_files_of_each_codec(spark, codec):
    texts = ["abc" * 500, None, "é" * 700, "abc" * 500]
    df = docs(spark, texts).drop("doc_id").withColumn("n", F.monotonically_increasing_id())
    got = media.load(media.store(df, codec=codec)).orderBy("n").collect()
    for text, r in zip(texts, got, strict=True):
        payload = media.payload_of((text or "").encode())
        assert bytes(r.payload) == payload and media.parse_wav(bytes(r.media))[0] == codec
        slow = [x for i in range(0, len(payload), 36) for x in slow_adpcm(payload[i : i + 36])] if codec == "ima-adpcm" else [slow_expand(codec, c) for c in payload]
        double = [x for p, q in zip(slow, [*slow[1:], slow[-1]], strict=True) for x in (p, (p + q) // 2)]
        assert np.frombuffer(r.pcm16k, np.int16).tolist() == double
    assert got[0].pcm16k == got[3].pcm16k
    whole = bytes(got[0].media)
    for broken in (whole[:-1], whole.replace(b"fmt ", b"FMT "), whole[:50]):
        with pytest.raises(ValueError):
            media.parse_wav(broken)


def test_features_do_not_depend_on_neighbours():
    payloads = [media.payload_of(bytes([i]) * (300 * i)) for i in range(1, 6)]
    assert media.features(payloads) == [media.features([p])[0] for p in payloads]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>x</p>";</script></head><body>
<header><h1>Site name</h1></header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><div class="cookie-notice">We use cookies a lot, and more</div>
<div id="page"><div class="post-%d entry"><h1>Head &amp; line</h1><p>One
  two <b>three</b>&nbsp;four<p>Five<br>six<ul><li>a<li>b &lt;i&gt;</ul><form><input value=x>Search</form><div class="ad">Buy</div>
<blockquote>Said</blockquote><div class="comments"><p>Reader one says a thing that is long, long and longer than the article itself is</p></div></div>
<aside>Also read</aside></div><footer>&copy; me</footer></body></html>"""
TEXT = "Head & line\nOne two three four\nFive six\na\nb <i>\nSaid"


def test_extraction(spark):
    pages = [(i, f"http://h.com/{i}", PAGE % i, "clash") for i in range(5)]
    pages += [(10, "http://h.com/x", None, ""), (11, None, "", ""), (12, "bad", "<p>loose", ""), (13, "http://h.com/y", "plain < text", ""), (14, "http://h.com/z", "<html><body><script>only()", "")]
    pages += [(15, "http://o.com", "<html><body><article><p>" + "long " * 50_000 + "</article></body>", ""), (1, "http://h.com/1", PAGE % 1, "clash")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, path string")
    got = html.extract(df).collect()
    assert len(got) == len(pages)
    by = {r.page_id: r.text for r in got}
    assert all(by[i] == TEXT for i in range(5))
    assert by[10] == by[11] == by[14] == "" and by[15] == ("long " * 50_000).strip()
    assert by[12] == "loose" and by[13] == "plain < text"
    assert html.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("outer", ["article", "div class=post"])
def test_slug_ids_are_no_boilerplate(outer):
    slugs = "side-effects related-work legal-basis form-factor search-for-answers discussion".split()
    inner = "".join(f'<section id="{x}"><h2 id="{x}">Head {x}</h2><p id="{x}">Text of {x}</p></section>' for x in slugs)
    page = f'<body><{outer}><h1>Title</h1>{inner}<div class="ad">Buy</div><div class="comments"><p>Reader</p></div></{outer.split()[0]}></body>'
    paths = ["body>article" if outer == "article" else "body>div.post"]
    assert html.text_at(page, paths) == "\n".join(["Title", *(t for x in slugs for t in (f"Head {x}", f"Text of {x}"))])


@pytest.mark.parametrize(
    "page,text",
    [
        ("<html><p>Hello world this is text</p></html>", "Hello world this is text"),
        ("<p>Hello <b>world</b></p>", "Hello world"),
        ("plain text", "plain text"),
        ("<body><div><p don't>One</p><p>Two</p><p>isn't it</p></div></body>", "One\nTwo\nisn't it"),
        ("<div class='form-of-art'><p>" + "On the form of art. " * 20 + "</p></div>", ("On the form of art. " * 20).strip()),
        ("<article><p>One</p><div class=share><p>" + "A share of the whole is what it is about. " * 5 + "</p></div><div class=share><a>Tweet</a></div></article>", "One\n" + ("A share of the whole is what it is about. " * 5).strip()),
        ("<body><div class=cookie-notice>Cookies</div><div class='sidebar left'>Also</div><div class=main-nav>Nav</div><div class=x><p>Text &lt;b&gt;&#x41;</p></div></body>", "Text <b>A"),
        ("<article><p>One</p><section id=comments><p>" + "A reader says so. " * 20 + "</p></section><div id=respond>Say</div></article><ol class=comment-list><li>" + "Another says no. " * 20 + "</ol>", "One"),
        ("<body><div class=post><div class=post-header><h1>Head</h1></div><div class=entry-content><p>" + "Body text. " * 9 + "</p></div><div class=page-footer>Foot</div></div></body>", "Head\n" + ("Body text. " * 9).strip()),
        ("<body><section><p>" + "Long part. " * 50 + "</p></section><section><p>End</p></section></body>", ("Long part. " * 50).strip() + "\nEnd"),
        ("<div class=a><p title='a > b'>One<!-- <p>no</p> --> two<![CDATA[ no ]]> three", "One two three"),
        ("<p>One</p><!-- unclosed <p>Two</p>", "One"),
        ("<p>One</p><a href='x", "One"),
        ("<p>a < b and <3</p></></ x><p>c<?php echo?></p>", "a < b and <3\nc"),
        ("<p style='display: none'>no</p><p hidden>no</p><p>One</p>", "One"),
        ("<table><tr><td>One<td>Two<tr><td>Three</table><ul><li>a<li>b</ul><dl><dt>t<dd>d</dl>", "One\nTwo\nThree\na\nb\nt\nd"),
    ],
)
def test_odd_pages(page, text):
    assert html.text_at(page, []) == text


def test_a_wrapper_keeps_its_heading_and_lead_however_long_the_body():
    for n in (5, 20, 3000):
        page = f"<body><div class=menu-main>Menu</div><div class=post><h1>Head</h1><p>Lead</p><div class=content><p>{'Long body. ' * n}</p></div></div><div class=rail>Rail</div></body>"
        assert html.text_at(page, []).split("\n")[:2] == ["Head", "Lead"] and "Rail" not in html.text_at(page, [])
        page = f"<body><div class=post><section><p>{'Long body. ' * n}</p></section><section><p>End</p></section></div><p>Foot</p></body>"
        assert html.text_at(page, []).split("\n")[1:] == ["End"]


def test_pages_are_read_in_proportion_to_their_length():
    import time
    import tracemalloc

    n = 1 << 18
    for page in ("<a '" * n, "<p '>x" * n, "<a b='" * n, "<![CDATA[" * n, "<!--" * n, "</b" * n, "<i><p>" + "<b>" * n + "</i>" * n, "<" * n, "<div " + " " * n + "=" * n, "<script>" * n, "<div class=share>" * 50_000 + "x"):
        started = time.process_time()
        html.text_at(page, [])
        assert time.process_time() - started < 8, page[:20]
    tracemalloc.start()
    assert html.text_at("<div class='a b'>" * 50_000 + "deep", []) == "deep"
    assert tracemalloc.get_traced_memory()[1] < 120 << 20
    tracemalloc.stop()


def slow_text(page, path):
    """The article by the standard library's parser: texts under the tags of the path, block by block."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__()
            self.stack, self.out, self.parts = [], [], []

        def cut(self):
            if text := " ".join("".join(self.parts).split()):
                self.out.append(text)
            self.parts = []

        def handle_starttag(self, tag, attrs):
            self.cut()
            self.stack.append(".".join([tag, *re.sub(r"\d+", "#", dict(attrs).get("class", "")).split()]))

        def handle_endtag(self, tag):
            self.cut()
            self.stack.pop()

        def handle_data(self, data):
            if ">".join(self.stack).startswith(path):
                self.parts.append(data)

    reader = Reader()
    reader.feed(page)
    return "\n".join(reader.out)


def test_votes_decide_where_a_page_would_choose_otherwise(spark):
    rng = random.Random(8)
    text = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma &amp; delta"]) for _ in range(n))
    rows, want = [], {}
    for host, name in (("a.com", "story"), ("b.com", "text")):
        for i in range(30):
            odd = i % 6 == 0  # a short text beside a long column of another kind
            body = f"<p>{text(5 if odd else 80)}</p><p>{text(4)}</p>"
            rail = f"<div class='extra{i}'><p>{text(150 if odd else 6)}</p></div>"
            page = f"<html><body>{rail if i % 2 else ''}<div class='{name}'>{body}</div>{'' if i % 2 else rail}</body></html>"
            rows.append((len(rows), f"http://{host}/{i}", page))
            want[rows[-1][0]] = slow_text(page, f"html>body>div.{name}")
            assert (html.best_path(page)[0] != f"html>body>div.{name}") == odd
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in html.extract(df).collect()} == want


def test_hosts_vote(spark):
    page = "<html><body><div class='main%d'><p>{}</p></div><div class='rail'><p>{}</p></div></body></html>"
    many = [(i, "http://h.com", (page % i).format("main text " * 9, "rail " * 2)) for i in range(9)]
    odd = [(99, "http://h.com", (page % 1).format("short", "rail " * 99))]
    df = spark.createDataFrame(many + odd, "page_id long, url string, html string")
    path = {r.host: r.path for r in html.host_paths(df).collect()}
    assert path == {"h.com": "html>body>div.main#"}
    assert {r.page_id: r.text for r in html.extract(df).collect()}[99] == "short"


def test_extraction_equals_the_articles_of_the_pages(spark):
    from html import unescape

    for r in queries.QUERIES["op6_consensus_paths"](spark, str(DATA)).join(spark.read.parquet(f"{DATA}/pages.parquet").select("page_id", "html"), "page_id").collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = (re.sub(r"\s+", " ", unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " ")))).strip() for b in re.split(r"</?(?:p|h1)>", article))
        assert r.text == "\n".join(filter(None, blocks)) and r.n_chars == len(r.text)
