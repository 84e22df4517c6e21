"""Packing, quality rules, BPE, media, URL filters and HTML extraction on small, awkward inputs."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import bpe, html_text, media, packing, quality, url_filters

public_tokenizers = pytest.importorskip("public_tokenizers")
ODD = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "aaa " * 300), (6, "É ß 中文 ½ 😀 ﬁ Σς ΑΣ İ"), (6, "É ß 中文 ½ 😀 ﬁ Σς ΑΣ İ"),
    (None, "no key"), (7, "x" * 5000), (8, "a <|endoftext|> b<|startoftext|>"), (9, "tab\tand\x1cother\x85space\xa0here don't I'LL"),
]


@pytest.fixture(scope="module")
def docs(spark):
    # columns of other names and of clashing ones
    return spark.createDataFrame([(i, t, "x", 1) for i, t in ODD], "doc_id long, text string, block string, keys int").repartition(3)


def empty(docs):
    return docs.filter("false")


def test_packing(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.vocabulary())
    want = sorted(t.encode(x or "", add_special_tokens=False).ids + [0] for _, x in ODD)
    pieces = packing.pack(docs, packing.vocabulary(), 64)
    out = pieces.collect()
    assert sum(r["length"] for r in out) == sum(map(len, want))
    stream = b"".join(bytes(r["ids"]) for r in sorted(out, key=lambda r: (r["sequence_id"], r["offset"])))
    ids, now, got = np.frombuffer(stream, "<u4").tolist(), [], []
    for i in ids:
        now.append(i)
        if i == 0:
            got.append(now)
            now = []
    # id 0 is also a token of a text; joined ends compare all the same
    assert sorted(sum(got, [])) == sorted(sum(want, []))
    rows = packing.sequences(pieces).orderBy("sequence_id").collect()
    assert all(len(r["ids"]) == 256 for r in rows[:-1]) and [r["sequence_id"] for r in rows] == list(range(len(rows)))
    for r in rows:
        at = 0
        for p in r["pieces"]:
            assert p["offset"] == at
            at += p["length"]
    assert packing.pack(empty(docs), packing.vocabulary()).count() == 0


def test_fast_encoder_equals_the_library():
    from tokenizers import Tokenizer

    t, encode, g = Tokenizer.from_file(packing.vocabulary()), packing.encoder(packing.vocabulary()), random.Random(3)
    for _ in range(500):
        text = "".join(g.choice("ab c\n\t  '\"s're.,!0123 ½éΣ中😀\x1c\xa0<|endoftext|>") for _ in range(g.randint(0, 50)))
        assert encode(text).tolist() == t.encode(text, add_special_tokens=False).ids


def test_bpe(docs):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    out = bpe.encode_decode(docs, path).collect()
    assert len(out) == len(ODD)
    texts = {}
    for i, x in ODD:
        texts[i] = x
    for r in out:
        e = t.encode(texts[r["doc_id"]] or "", add_special_tokens=False)
        assert r["ids"] == e.ids and r["decoded"] == t.decode(e.ids, skip_special_tokens=False)
    assert bpe.encode_decode(empty(docs), path).count() == 0


def test_bpe_merges_at_random():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t, words, g = Tokenizer.from_file(path), bpe.Words(path), random.Random(5)
    texts = ["".join(g.choice("aabbcdeee th'sé 1½中ß") for _ in range(g.randint(0, 40))) for _ in range(800)]
    ids, n = words.encode(texts)
    ends = np.cumsum(n)
    for i, e in enumerate(t.encode_batch(texts, add_special_tokens=False)):
        assert ids[ends[i] - n[i] : ends[i]].tolist() == e.ids


def test_bpe_tells_special_tokens_from_words_that_look_like_them():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t, words, g = Tokenizer.from_file(path), bpe.Words(path), random.Random(9)
    special = list(words.special)
    looks = special + [s.upper() for s in special] + [s.title() for s in special] + ["".join(g.choice((c.lower(), c.upper())) for c in s) for s in special * 4]
    assert special and len(set(looks)) > len(special) + 2
    texts = [g.choice(("", " ", "x")).join(g.choice((g.choice(looks), "a b", " ", "Word", "<|", "|>", "\u00c9")) for _ in range(g.randint(1, 8))) for _ in range(4000)]
    ids, n = words.encode(texts)
    ends = np.cumsum(n)
    for i, e in enumerate(t.encode_batch(texts, add_special_tokens=False)):
        assert ids[ends[i] - n[i] : ends[i]].tolist() == e.ids, texts[i]


def test_bpe_agrees_on_every_code_point():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t, words = Tokenizer.from_file(path), bpe.Words(path)
    points = [*bpe.ASSIGNED, 0xF0000, 0x10FFFF]
    texts = ["".join(f"a{chr(c)}b {chr(c)}\u0301{chr(c)}1 " for c in points[i : i + 16]) for i in range(0, len(points), 16)]
    for at in range(0, len(texts), 1000):
        some = texts[at : at + 1000]
        ids, n = words.encode(some)
        ends = np.cumsum(n)
        for i, e in enumerate(t.encode_batch(some, add_special_tokens=False)):
            assert ids[ends[i] - n[i] : ends[i]].tolist() == e.ids, some[i]


def brute_repeats(words, w=8):
    seen = {}
    for i in range(len(words) - w + 1):
        seen.setdefault(tuple(words[i : i + w]), []).append(i)
    return len({j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + w)})


def test_quality_counts(spark, docs):
    g = random.Random(1)
    texts = [x for _, x in ODD] + [" ".join(g.choice("abc") for _ in range(g.randint(0, 60))) for _ in range(200)] + ["l\nl\n \n \nm\r\nm\r\n#$ <|"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality.measured(df).collect():
        text, m = texts[r["row"]["doc_id"]] or "", r["m"]
        words = text.encode().split()
        lines = [x for x in text.split("\n") if x.encode().split()]
        assert m["n_words"] == len(words)
        assert m["word_chars"] == sum(len(w.decode()) for w in words)
        assert m["n_symbols"] == sum(text.count(c) for c in "#*$%&|<>")
        assert m["n_dup_lines"] == len(lines) - len(set(lines))
        assert m["n_repeat_words"] == brute_repeats(words)
        assert m["base_failed"] == (len(words) < 20 or 100 * m["n_repeat_words"] > 30 * len(words))
    assert quality.clean(empty(docs)).count() == 0


def test_quality_removes_lines_first(spark):
    g = random.Random(4)
    prose = "\n".join(" ".join("".join(g.choice("bdlmnrst") + g.choice("aeiou") for _ in range(g.randint(1, 4))) for _ in range(12)) + "." for _ in range(12))
    junk = "\n".join(" ".join(f"W{i}{j}!!" for j in range(9)) for i in range(12))
    bars = "\n".join(" | ".join(f"menu{i}{j}" for j in range(9)) for i in range(12))
    mixed = "Home | News | Sport | About | Help\n" + prose + "\nAll rights reserved."
    df = spark.createDataFrame([(1, prose, 0), (2, junk, 0), (3, bars, 0), (4, mixed, 0)], "doc_id long, text string, n_chars long")
    kept = {r["doc_id"]: r for r in quality.clean(df).collect()}
    assert sorted(kept) == [1, 4] and kept[4]["text"] == prose and kept[4]["n_chars"] == len(prose)


LINES = [
    ("Licensed under CC BY-NC 4.0.", True), ("This work is licensed under the GNU General Public License.", True), ("© 2020 Someone", True),
    ("Copyright 2019 Someone", True), ("Copyright law has changed a good deal since then.", False), ("Tous droits réservés", True),
    ("Alle Rechte vorbehalten.", True), ("Todos los derechos reservados", True), ("Home About Contact Login", True), ("Startseite Kontakt Impressum", True),
    ("Home sweet home is what they say.", False), ("Please contact the help desk about the news.", False), ("https://a.example/b www.c.example", True),
    ("See https://a.example/b for the whole story.", False), ("The minister said on Monday ... Read more »", True), ("They read more than ever", False),
    ("A paragraph " + "of many words " * 12 + "names the privacy policy of the house", False), ("", False), ("!", False), ("home home home", True),
]


def test_quality_lines_by_example_and_by_sql(spark):
    df = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(LINES)], "i int, line string")
    got = {LINES[r["i"]][0] for r in df.filter(quality.line_fails(F.col("line"))).collect()}
    assert got == {x for x, fails in LINES if fails}
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [[i, x] for i, (x, _) in enumerate(LINES)])
    cleaned = con.execute(f"WITH {quality.CTES} SELECT clean FROM c").fetchall()
    assert sorted(x for (x,) in cleaned if x) == sorted(x for x, fails in LINES if x and not fails)


def test_media_round_trip(spark, docs, tmp_path):
    folder = f"file://{tmp_path}/archives"
    media.store(docs, folder)
    for options in ({}, {"rangeBytes": "300"}):
        rows = media.load(spark, folder, **options)
        assert rows.count() == len(ODD) and rows.filter("error IS NOT NULL").count() == 0
        got = sorted((r["doc_id"] or -1, r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in media.described(rows).collect())
        want = []
        for i, t in ODD:
            raw = (t or "").encode()
            data = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
            want.append((i or -1, len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:])))
        assert got == sorted(want)
    media.store(empty(docs), f"file://{tmp_path}/none")
    assert media.load(spark, f"file://{tmp_path}/none").count() == 0


def test_broken_member_leaves_the_others(spark, docs, tmp_path):
    folder = f"file://{tmp_path}/archives"
    media.store(docs.coalesce(1), folder)
    rows = media.load(spark, folder).orderBy("offset").collect()
    archive = next(p for p in (tmp_path / "archives").iterdir() if p.suffix == ".zip")
    raw = bytearray(archive.read_bytes())
    raw[rows[3]["offset"] + 40] ^= 0xFF
    archive.write_bytes(raw)
    again = media.load(spark, folder).orderBy("offset").collect()
    assert [r["error"] is None for r in again] == [i != 3 for i in range(len(rows))]
    assert media.described(media.load(spark, folder)).count() == len(ODD)


URLS = [
    (1, "http://A.Example.COM/en/x?q#f", "example.com/en/", "block"), (2, "https://www.example.com/en/", "www.example.com/en/", "allow"), (3, "https://x.www.example.com/en/1", "www.example.com/en/", "allow"),
    (4, "http://spam.net/es/1", "net/es/", "block"), (5, "http://spam.net/de/1", None, "allow"), (6, "http://b.ads-track.example.net/de/", None, "block"), (7, "http://b.ads-track.example.com/de/", "com/", "allow"),
    (8, None, None, "allow"), (9, "no scheme", None, "allow"), (10, "http://", None, "allow"), (11, "http://notexample.com", None, "allow"), (12, "ftp://com/a", "com/", "allow"), (12, "ftp://com/a", "com/", "allow"),
]


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, u, "h") for i, u, _, _ in URLS], "page_id long, url string, host string")
    out = url_filters.judge(pages.select("page_id", "url"), F.col("key").rlike(r"(^|\.)ads-track\."))
    assert sorted((r["page_id"], str(r["rule"]), r["verdict"]) for r in out.collect()) == sorted((i, str(x), v) for i, _, x, v in URLS)
    assert url_filters.judge(pages.filter("false").select("page_id", "url"), F.lit(True)).count() == 0


@pytest.mark.parametrize("words", [None, 8])
def test_cascade_is_exact(spark, monkeypatch, words):
    if words:  # so small that the keys are split into shards
        monkeypatch.setattr(url_filters, "MAX_WORDS", words)
    universe = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") % 23 == 0).alias("listed"))
    c = url_filters.build_cascade(universe)
    assert (c.shards > 1) == bool(words) and max(map(len, c.levels)) > 1
    marked = c.mark(universe.withColumn("shard", F.lit("x")), "key", "found")
    assert marked.count() == 3000 and marked.filter("found != listed OR shard != 'x'").count() == 0



@pytest.mark.parametrize("words", [None, 2])
def test_block_list_as_a_table(spark, monkeypatch, words):
    if words:
        monkeypatch.setattr(url_filters, "MAX_WORDS", words)
    pages = spark.range(400).select(F.col("id").alias("page_id"), F.concat(F.lit("http://H"), F.col("id") % 97, F.lit(".org/en/")).alias("url"))
    listed = spark.createDataFrame([(f"h{i}.org",) for i in range(0, 300, 3)] + [("h3.org",), (None,)], "key string")
    out = url_filters.judge(pages, listed).collect()
    assert len(out) == 400 and all((r["verdict"] == "block") == (r["page_id"] % 97 % 3 == 0) for r in out)
    assert {r["verdict"] for r in url_filters.judge(pages, listed.filter("false")).collect()} == {"allow"}


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body><header>Site name</header><nav><ul><li><a href=/a>menu entry</a></ul></nav>
<div class="cookie-notice">We use cookies on this site.</div><main><h1>A &lt;title&gt; &amp; more</h1><p>First
  line <b>and</b> the&nbsp;second.<p>Short<br>one<div class="ad">Buy this now, it is really good.</div><ul><li>item one</li><li>item two</ul>
<script>if (a < b) document.write("<p>no</p>")</script><form><p>Your name please.</p></form><section id="comments"><p>Nice article, thank you for this.</p></section></main>
<aside><p>Something else that you might like to read.</p></aside><footer>&copy; someone</footer></body></html>"""


def test_html(spark):
    want = "A <title> & more\nFirst line and the second.\nShort one\nitem one\nitem two"
    assert html_text.main_text(PAGE) == want
    pages = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<nav>only</nav>"), (5, "u", PAGE[: PAGE.index("item two") + 4]), (None, "u", "<p>" * 2000 + "x")], "page_id long, url string, html string")
    out = {r["page_id"]: r for r in html_text.extract(pages).collect()}
    assert out[1]["text"] == want and out[1]["n_chars"] == len(want)
    assert [out[i]["text"] for i in (2, 3, 4)] == ["", "", ""] and out[5]["text"].endswith("item")
    assert html_text.extract(pages.filter("false")).count() == 0


LONG = "The river rose all night, and in the morning the lower fields lay under a sheet of brown water."
LINKS = "<ul><li><a href=/a>Home</a><li><a href=/b>News</a><li><a href=/c>About us</a></ul>"


@pytest.mark.parametrize(
    "page,want",
    [
        (f'<body class="has-sidebar no-ads"><article><p>{LONG}</p></article></body>', LONG),
        (f'<div class="post-header-wrap"><article><p>{LONG}</p><p>{LONG}</p></article></div>', f"{LONG}\n{LONG}"),
        (f'<div id="page" class="layout with-sidebar"><div class=content><p>{LONG}<p>{LONG}</div><div class="sidebar"><p>{LONG}</div></div>', f"{LONG}\n{LONG}"),
        (f"<article><p class=it's>{LONG}<p>{LONG}<p>It's</article>", f"{LONG}\n{LONG}\nIt's"),
        (f'<article><p title="a > b">{LONG}</p></article>', LONG),
        (f"<article><p data-x=a/b/>{LONG}</p></article>", LONG),
        (f'<article><p>{LONG}</p><p title="x>foo bar baz</p></article>', LONG),
        (f"<article><p>{LONG}</p><!-- <p>no</p> --!><p>{LONG}</p></article>", f"{LONG}\n{LONG}"),
        (f"<nav>{LINKS}</nav><main><h1>Flood</h1><p>{LONG}</p></main><footer><p>{LONG}</p></footer>", f"Flood\n{LONG}"),
        (f"<header>{LINKS}</header><article><h1>Flood</h1><p>{LONG}</p><section id=comments><article class=comment><p>{LONG}</p></article></section></article>", f"Flood\n{LONG}"),
        (f"<article><p>{LONG}</p><div class='ad-box'><p>{LONG}</p></div><aside><p>{LONG}</p></aside><p>{LONG}</p></article>", f"{LONG}\n{LONG}"),
        (f'<div class="cookie-notice"><p>{LONG}</p></div><div><p>{LONG}</p><p>{LONG}</p></div>', f"{LONG}\n{LONG}"),
        (f"<article><p>{LONG}</p><p hidden>{LONG}</p><div style='display: none'><p>{LONG}</p></div></article>", LONG),
        (f"<article><form><p>{LONG}</p></form><p>a&nbsp;b &lt;c&gt;<script>x='</p>'</script> d</article>", "a b <c> d"),
        (f"<div>{LINKS}</div><div><p>{LONG}</p><p>So it was</p><p>{LONG}</p></div>", f"{LONG}\nSo it was\n{LONG}"),  # by the cut
    ],
)
def test_html_pages(page, want):
    assert html_text.main_text(page) == want


def test_the_cut_changes_labels():
    found = [(b, " ".join(b.parts)) for b in html_text.blocks_of(f"<div><p>{LONG}</p><p>So it was</p><p>{LONG}</p></div>")]
    assert [html_text.score(b, t) > 0 for b, t in found] == [True, False, True]


BUDGET = "The council met on Tuesday to discuss the new budget, and members agreed that further work was needed before a vote."

#: Pages with the text that a reader would call the article.
LABELLED = [
    ("sponsor article", f'<article id="sponsor-story-12"><p>{BUDGET}</p><p>{BUDGET}</p></article>',f"{BUDGET}\n{BUDGET}"),
    ("share price", f'<article><p>{BUDGET}</p><p class="share-price">The share rose to 12.40 euros.</p><p>{BUDGET}</p></article>',f"{BUDGET}\nThe share rose to 12.40 euros.\n{BUDGET}"),
    ("entry header", f'<article><header class="entry-header"><h1>Budget agreed</h1><p class="byline">By A. Writer</p></header><p>{BUDGET}</p></article>',f"Budget agreed\n{BUDGET}"),
    ("table", f'<div><p>{BUDGET}</p><table><tr><th>Year</th><th>Sum</th></tr><tr><td>2020</td><td>14 million</td></tr></table><p>{BUDGET}</p></div>',f"{BUDGET}\nYear\nSum\n2020\n14 million\n{BUDGET}"),
    ("dl", '<body><dl><dt>Coffee</dt><dd>Black hot drink</dd><dt>Milk</dt><dd>White cold drink</dd></dl></body>',"Coffee\nBlack hot drink\nMilk\nWhite cold drink"),
    ("one short p", '<body><p>Hello there</p></body>',"Hello there"),
    ("link item", f'<article><p>{BUDGET}</p><ul><li><a href="/x">The annual report</a></li><li><a href="/y">Minutes of the meeting</a></li></ul><p>{BUDGET}</p></article>',f"{BUDGET}\nThe annual report\nMinutes of the meeting\n{BUDGET}"),
    ("copyright", f'<div><p>{BUDGET}</p></div><div>Copyright 2024 Example Media Ltd. All rights reserved.</div>',BUDGET),
    ("cookies", f'<div>We use cookies to improve your experience on our site.</div><div><p>{BUDGET}</p><p>{BUDGET}</p></div>',f"{BUDGET}\n{BUDGET}"),
    ("related heading", f'<article><p>{BUDGET}</p><h3>Related articles</h3><ul class="related"><li><a href=a>One more story here</a></li><li><a href=b>Another story to read</a></li></ul></article>',BUDGET),
    ("related div", f'<div><p>{BUDGET}</p><h3>Related articles</h3><ul class="related"><li><a href=a>One more story here</a></li></ul></div>',BUDGET),
    ("menu only", '<nav><ul><li><a href=a>Home</a></li><li><a href=b>News</a></li></ul></nav>',""),
    ("links only", '<div><ul><li><a href=a>Home</a></li><li><a href=b>News</a></li></ul></div>',""),
    ("comments", f'<article><p>{BUDGET}</p></article><section class="comments"><h2>3 Comments</h2><p>{BUDGET}</p></section>',BUDGET),
    ("post-comments", f'<div class="post"><p>{BUDGET}</p></div><div class="post-comments"><p>{BUDGET}</p></div>',BUDGET),
    ("cookie text", f'<article><p>{BUDGET}</p><p>We use cookies in this recipe because they hold the cream well.</p></article>',f"{BUDGET}\nWe use cookies in this recipe because they hold the cream well."),
]


@pytest.mark.parametrize("name,page,want", LABELLED)
def test_html_labelled_pages(name, page, want):
    assert html_text.main_text(page) == want


NEIGHBOURS = [
    (f"<div><p>{BUDGET}</p><p>So it was</p><p>{BUDGET}</p><p>{BUDGET}</p></div>", f"{BUDGET}\nSo it was\n{BUDGET}\n{BUDGET}"),
    (f"<div><p>{BUDGET}</p><ul><li>first</li><li>second thing</li></ul><p>{BUDGET}</p></div>", f"{BUDGET}\nfirst\nsecond thing\n{BUDGET}"),
]


def test_the_cut_decides_on_the_labelled_pages():
    """Blocks whose own costs say the opposite of what the cut says, and the cut is right."""
    changed = 0
    for _, page, want in LABELLED + [("", *p) for p in NEIGHBOURS]:
        for b, t in [(b, " ".join(html_text.html.unescape("".join(b.parts)).split())) for b in html_text.blocks_of(page)]:
            changed += bool(t) and (html_text.score(b, t) > 0) != (t in want.split("\n"))
        assert html_text.main_text(page) == want
    assert changed >= 6


def test_minimum_cut_against_all_labellings():
    g = random.Random(2)
    for _ in range(200):
        n = g.randint(1, 7)
        margin = [g.randint(-9, 9) for _ in range(n)]
        edges = [(a, b, g.randint(0, 6)) for a in range(n) for b in range(a) if g.random() < 0.5]

        def cost(label, margin=margin, edges=edges):
            return sum(m for m, x in zip(margin, label, strict=True) if m > 0 and not x) - sum(m for m, x in zip(margin, label, strict=True) if m < 0 and x) + sum(c for a, b, c in edges if label[a] != label[b])

        assert cost(html_text.min_cut(margin, edges)) == min(cost([k >> i & 1 for i in range(n)]) for k in range(1 << n))
