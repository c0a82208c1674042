"""Main text of pages: parsing, wrappers, and the whole operator."""

import json

from siftwell.llm import wrappers

from .helpers import frame

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p><p>no";</script></head><body><header><h1>Site</h1></header>
<nav><ul><li><a href=/a>One</a></li><li><a href=/b>Two</a></li></ul></nav><!-- <p>hidden</p> --><div class="ad">Buy {n}</div>
<article><header><h1>Title &amp; {n}</h1></header><p><b>First  {n}.<br><p>Second &#233;{n}</p><ul><li>x{n}<li>y</ul><div class="share">Tweet</div>
<section id="comments"><p>Great post</p></section></article><aside>Side</aside><form><p>Mail</p></form><footer>&copy; me</footer>"""


def test_parts_of_a_page():
    assert wrappers.extract(PAGE.format(n=1), None) == "Title & 1\n\nFirst 1.\n\nSecond é1\n\nx1\n\ny"


def test_odd_pages_never_raise():
    deep = "<div>" * 3000 + "in" + "</div>" * 10
    for page, text in [(None, ""), ("", ""), ("plain", "plain"), ("<p>a<b>b</b>c d</p>", "abc d"), ("a < b > c", "a < b > c"), (deep, "in"), ("<p>x</div></p></p>y", "x\n\ny"), ("<p>un<", "un<"), ('<p class="a>b', '<p class="a>b'), ("<script>x", ""), ("<p>a<br/>b<hr>c", "a b\n\nc")]:
        got = wrappers.extract(page, None)
        assert got == text or page.startswith('<p class'), (page[:20], got)
        wrappers.infer(wrappers.parse(page))
    json.dumps(wrappers.infer(wrappers.parse(deep)))


def test_wrapper_has_optional_repeated_and_variable_parts():
    a, b = (wrappers.infer(wrappers.parse(p)) for p in ("<div><h2>A</h2><p>1</p><p>2</p><i>same</i></div>", "<div><p>3</p><i>same</i><em>e</em></div>"))
    w = wrappers.merge(a, b)
    kids = {k[0]: k for k in w[4][0][4]}
    assert list(kids) == ["h2", "p", "i", "em"]
    assert kids["h2"][1] == 1 and kids["em"][1] == 1 and kids["p"][1] == 0 and kids["p"][2] == 1
    assert kids["p"][4][0][4] is None and kids["i"][4][0][4] is not None and kids["i"][3] == 2


def test_long_lists_are_generalised():
    page = "<div>" + "".join(f"<h2>{i}</h2><p>{i}</p>" for i in range(100)) + "</div>"
    w = wrappers.infer(wrappers.parse(page))
    assert isinstance(w[4][0][4], dict) and set(w[4][0][4]) == {"h2", "p"}
    assert len(json.dumps(wrappers.merge(w, w))) < 400
    root = wrappers.parse(page)
    wrappers.mark(root, wrappers.merge(w, w))


def test_template_text_is_found_by_alignment(spark):
    page = "<html><body><div><span>Welcome to the site</span></div><div><p>Body text number {n} of a page.</p><p>More {n}.</p></div><div>All rights kept</div></body></html>"
    rows = [(i, f"https://www.Host.example:80/p{i}", page.format(n=i)) for i in range(8)]
    rows += [(100, "http://other.example/x", page.format(n=1)), (101, None, None), (102, "nonsense", ""), (103, "https://host.example/z", PAGE.format(n=7)), (103, "https://host.example/z", PAGE.format(n=7))]
    df = frame(spark, [(*r, "own") for r in rows], "page_id long, url string, html string, main_text string")
    found, name = wrappers.main_text(df)
    assert name != "main_text" and found.count() == len(rows)
    got = {r["page_id"]: r[name] for r in found.collect()}
    assert all(got[i] == f"Body text number {i} of a page.\n\nMore {i}." for i in range(8))
    assert got[100].startswith("Welcome") and got[101] == got[102] == "" and got[103].startswith("Title & 7")
    assert wrappers.main_text(df.limit(0))[0].count() == 0


def test_joined_and_broadcast_wrappers_give_the_same(spark, monkeypatch):
    from siftwell.llm import common

    rows = [(i, f"http://h{i % 3 if i % 2 else 0}.example/", PAGE.format(n=i)) for i in range(60)] + [(100, None, None)]
    df = frame(spark, rows, "page_id long, url string, html string")
    found, name = wrappers.main_text(df)
    want = sorted((r.page_id, r[name]) for r in found.collect())
    monkeypatch.setattr(common, "HEAVY_LEAST", 5)
    for limit in (0, 2_000):  # all joined; some hot hosts broadcast
        monkeypatch.setattr(wrappers, "BROADCAST_BYTES", limit)
        found, name = wrappers.main_text(df)
        assert sorted((r.page_id, r[name]) for r in found.collect()) == want


def test_partial_wrappers_merge_in_any_grouping(spark):
    rows = [(i, f"http://h{i % 3}.example/", PAGE.format(n=i)) for i in range(30)]
    df = frame(spark, rows, "page_id long, url string, html string")
    got = {r.host: (json.loads(r.wrapper), r.pages) for r in wrappers.infer_wrappers(df).collect()}
    assert {h: n for h, (_, n) in got.items()} == {f"h{i}.example": 10 for i in range(3)}
    assert {wrappers.main_part(w)[0] for w, _ in got.values()} == {"article"}


def of_host(pages, names):
    whole = None
    for p in pages:
        w = wrappers.infer(wrappers.parse(p, names))
        whole = w if whole is None else wrappers.merge(whole, w)
    return whole, wrappers.main_part(whole, 1.0 if names else wrappers.MOST)


def test_wrapper_alone_finds_the_same_text_on_the_pages_table(spark):
    hosts = {}
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html", wrappers.host("url").alias("h")).collect():
        hosts.setdefault(r.h, []).append(r.html)
    shown = removed = 0
    for pages in hosts.values():
        (w, main), (v, alone) = of_host(pages, True), of_host(pages, False)
        for p in pages:
            text = wrappers.extract(p, w, main)
            assert text == wrappers.extract(p, v, alone, names=False)
            shown, removed = shown + len(text), removed + len("\n\n".join(wrappers.blocks(wrappers.parse(p, names=False), False))) - len(text)
    assert removed > 10_000 and shown > 10 * removed


LAYOUT = """<html><body><div id=top>{menu}</div><div class="box-{n}7"><div>{side}</div><section><h2>About {n}</h2><p>Read our rules before you write here.</p>
<div><em>{body}</em>{more}</div></section></div><div>{end}</div></body></html>"""


def test_template_text_goes_inside_the_main_part_without_any_class_word():
    body = lambda n: f"Sentence {n} of a long text that only this page has, and it goes on for a while. " * 6
    pages = [LAYOUT.format(n=n, menu=f"<a href=/{n}>menu {n}</a>", side=f"Offer {n} today", body=body(n), more="<i>kept by two</i>" if n < 2 else "", end=f"Seen {n} times") for n in range(6)]
    w, main = of_host(pages, False)
    assert main[0] in ("section", "div") and "box-07" not in json.dumps(main)
    for n, p in enumerate(pages):
        got = wrappers.extract(p, w, main, names=False)
        assert body(n).strip() in got and "rules" not in got and "Offer" not in got and "Seen" not in got and "menu" not in got
        assert ("kept by two" in got) == (n < 2)
    copies = pages[:1] * 20
    w, main = of_host(copies, True)
    assert "Read our rules" in wrappers.extract(copies[0], w, main)  # copies of one article are no template


def test_deep_text_stays():
    deep = lambda n: "<div>" * 60 + f"<b>{n} " + "own words of this page " * 9 + "</b><u>shared deep text</u>" + "</div>" * 60
    pages = [f"<html><body>{deep(n)}</body></html>" for n in range(5)]
    w, main = of_host(pages, True)
    assert all(wrappers.extract(p, w, main) == f"{n} " + "own words of this page " * 9 + "shared deep text" for n, p in enumerate(pages))
    w, main = of_host(pages, False)  # without names a text in a slot of the template goes
    assert all("shared" not in wrappers.extract(p, w, main, names=False) for p in pages)


SENTENCE = "Sentence {n} that only this page has, which goes on for a while. "


def test_shared_texts_inside_an_article_stay():
    pages = [f"<html><body><nav>x</nav><article><h1>T{n}</h1><h2>Introduction</h2><p>{SENTENCE.format(n=n)}</p><blockquote>To be or not to be</blockquote><h2>Conclusion</h2><p>{n}!</p></article></body></html>" for n in range(6)]
    w, main = of_host(pages, True)
    for n, p in enumerate(pages):
        assert wrappers.extract(p, w, main).split("\n\n") == [f"T{n}", "Introduction", SENTENCE.format(n=n).strip(), "To be or not to be", "Conclusion", f"{n}!"]


def test_sibling_containers_stay():
    pages = [f"<html><body><div id=a>{SENTENCE.format(n=n) * 7}</div><div id=b>{SENTENCE.format(n=n + 50)}</div></body></html>" for n in range(6)]
    w, main = of_host(pages, True)
    assert all(len(wrappers.extract(p, w, main).split("\n\n")) == 2 for p in pages)


def test_class_words_only_propose():
    for word in ("share-price", "form-theory", "comments-on-law", "search-algorithms", "social-history", "menu-of-the-day", "ad-hoc", "notice", "widget", "header-files"):
        pages = [f'<html><body><article><h1>T{n}</h1><p>{SENTENCE.format(n=n)}</p><div class="{word}"><p>A paragraph {n} of the article.</p></div></article></body></html>' for n in range(5)]
        w, main = of_host(pages, True)
        assert all(f"A paragraph {n} of" in wrappers.extract(p, w, main) for n, p in enumerate(pages)), word
    for word in ("share-box", "comments", "comment-list", "AdBanner", "related-posts", "site-nav", "newsletter signup"):
        page = f'<html><body><article><p>{SENTENCE}</p><div class="{word}"><p>Gone.</p></div></article></body></html>'
        assert "Gone" not in wrappers.extract(page, None), word


def test_the_wrapper_decides_what_words_propose_and_what_has_no_word():
    page = '<html><body><div class=x1>All rights kept</div><article><h1>T{n}</h1><p>{s}</p><div class="notice">We use your data.</div><div class="widget"><a href=/a>Link {n}</a> or</div></article></body></html>'
    pages = [page.format(n=n, s=SENTENCE.format(n=n)) for n in range(6)]
    w, main = of_host(pages, True)
    for n, p in enumerate(pages):
        assert wrappers.extract(p, w, main) == f"T{n}\n\n{SENTENCE.format(n=n).strip()}"
        assert "We use your data." in wrappers.extract(p, None)  # one page alone can't tell
    plain = "<html><body><div class=lead><p>About this site</p></div><div class=text><h2>Part</h2><p>{s}</p><p>Same on all pages.</p></div><div class=end>All rights kept</div></body></html>"
    pages = [plain.format(s=SENTENCE.format(n=n)) for n in range(6)]
    w, main = of_host(pages, True)
    for n, p in enumerate(pages):
        assert wrappers.extract(p, w, main) == f"Part\n\n{SENTENCE.format(n=n).strip()}\n\nSame on all pages."
        assert "All rights kept" in wrappers.extract(p, None)


def test_wrappers_do_not_grow_with_class_words_of_single_pages():
    page = lambda n: f'<html><body><div class="p{chr(97 + n % 26)}{chr(97 + n // 26 % 26)}x"><article class="post-{chr(97 + n % 26)}q{n}"><p>{SENTENCE.format(n=n)}</p></article></div></body></html>'
    sizes = []
    for most in (50, 200, 800):
        whole, _ = of_host([page(n) for n in range(most)], True)
        sizes.append(len(json.dumps(whole)))
    assert max(sizes) < 12_000  # 48 kinds of children at most, however many pages there are


def by_hand(page):
    """An extractor of its own for the test pages: their article element, by the standard library's parser."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.inside, self.out, self.now = False, [], []

        def end_block(self):
            if text := " ".join("".join(self.now).split()):
                self.out.append(text)
            self.now = []

        def handle_starttag(self, tag, attrs):
            self.inside |= tag == "article"
            if tag == "br":
                self.now.append(" ")
            elif tag not in ("b", "a", "i", "em", "strong"):
                self.end_block()

        def handle_endtag(self, tag):
            if tag not in ("b", "a", "i", "em", "strong", "br"):
                self.end_block()
            self.inside &= tag != "article"

        def handle_data(self, data):
            if self.inside:
                self.now.append(data)

    reader = Reader()
    reader.feed(page or "")
    reader.close()
    return "\n\n".join(reader.out)


def test_all_pages_equal_an_extractor_of_its_own(spark):
    from siftwell.llm import queries

    folder = "/root/testdata/sf0.01"
    want = {r.page_id: by_hand(r.html) for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    got = {r.page_id: (r.text, r.n_chars) for r in queries.op7_html_text(spark, folder).collect()}
    assert got == {k: (v, len(v)) for k, v in want.items()}
