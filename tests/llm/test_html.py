from hawser.llm import html_extraction as H

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/x">Menu %d</a></li></ul></nav><header>Head</header><div class="cookie-notice">Notice</div><div class="ad">Buy %d</div>
<article><h1>Title &amp; more</h1><p><b>Bold start<br><p>Second&nbsp;part  of
text&#33; x<i>y</i>z</p><aside>Side</aside><form><input>Form</form><section class="comments"><p>First!</p></section><ul><li>one<li>two</ul></article>
<footer>&copy; %d</footer></body></html>"""


def test_article():
    want = "Title & more Bold start Second part of text! xyz one two"
    assert H.main_text(PAGE % (1, 2, 3), frozenset()) == want
    cut = (PAGE % (1, 2, 3)).split("<footer>")[0]
    assert H.main_text(cut, frozenset()) == want


def test_odd_pages():
    for page, text in [
        ("", ""), ("plain", "plain"), ("a < b &lt; c", "a < b < c"), ("<p>unclosed", "unclosed"), ("<script>never ends", ""), ("<!-- comment", ""), ("<div hidden>no</div>yes", "yes"),
        ("<p>x</p><p>y", "x y"), ("<article></article>", ""), ('<a title="a>b">link</a> text', "link text"), ("<p>&am &amp &#x41;</p>", "&am & A"), ("<article><!-- ad --><p>a<!-- x -->b</p></article>", "ab"),
        ("<b>" * 3000 + "deep", "deep"), ("<div>" * 3000 + "deep", "deep"), ("<p a='unbalanced>text</p>rest", "text rest"),
    ]:
        assert H.main_text(page, frozenset()) == text, page[:60]


def test_template_of_pages_without_article(spark):
    rows = [(i, f"http://h.example/{i}", f"<html><body><div><div>Site name</div><p>Own story {i} goes here</p><p>All rights kept</p></div></body></html>") for i in range(8)]
    rows += [(100, "http://other/", "<html><body><p>Site name</p></body></html>"), (101, None, None), (102, "x", "")]
    got = {r.page_id: r for r in H.extract(spark.createDataFrame([(*r, "old") for r in rows], "page_id long, url string, html string, text string")).collect()}
    for i in range(8):
        assert got[i].text == f"Own story {i} goes here"
    assert got[100].text == "Site name" and got[101].text == "" and got[102].text == "" and got[102].n_chars == 0


def test_articles_keep_what_all_pages_share(spark):
    rows = [(i, "http://h/", f"<html><body><article><p>Shared line.</p><p>Own {i}</p></article></body></html>") for i in range(6)]
    got = H.extract(spark.createDataFrame(rows + rows[:2], "page_id long, url string, html string")).collect()
    assert len(got) == 8 and all(r.text == f"Shared line. Own {r.page_id}" for r in got)


def test_pages_that_are_all_alike(spark):
    rows = [(i, "http://h/", "<html><body><p>The same.</p></body></html>") for i in range(5)]
    assert {r.text for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()} == {"The same."}
    assert H.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_whole_table_against_plain_reading(spark, small):
    import html
    import re

    got = {r.page_id: r.text for r in H.op1_html_extraction(spark, small).collect()}
    for r in spark.read.parquet(f"{small}/pages.parquet").collect():
        article = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        parts = re.split(r"</?(?:p|h1|br)[^>]*>", article)
        assert got[r.page_id] == " ".join(x for x in (" ".join(html.unescape(re.sub(r"</?b>", "", p)).split()) for p in parts) if x)


def test_template_decides_below_articles(spark):
    page = """<html><body><div class="top"><a href="/">Site</a></div><article><header><h1>Title {i}</h1></header><div class="x1">Join our letter today</div>
<p>Own story {i}</p><div class="notice">Own warning {i}</div><p><a href="/{i}">Source {i}</a></p><div><span>Read more on Site</span></div></article><p>All rights kept</p></body></html>"""
    rows = [(i, f"http://h.example/{i}", page.format(i=i)) for i in range(8)]
    rows.append((50, "http://few.example/", page.format(i=50)))
    got = {r.page_id: r.text for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(8):
        assert got[i] == f"Title {i} Own story {i} Own warning {i} Source {i}"
    assert got[50] == "Join our letter today Own story 50 Source 50 Read more on Site"  # one page: names only


def test_links_and_marked_slots_without_article(spark):
    page = '<html><body><nav><a href="/">Site</a><p>Page {i}</p></nav><div><p>Own story {i}</p><p><a href="/{i}">Source {i}</a></p><p class="alert">Own alert {i}</p></div><p>All rights kept</p></body></html>'
    got = H.extract(spark.createDataFrame([(i, "http://h/", page.format(i=i)) for i in range(8)], "page_id long, url string, html string")).collect()
    assert {r.text for r in got} == {f"Own story {i} Source {i} Own alert {i}" for i in range(8)}


def test_raw_elements_end_where_they_end():
    page = "<article><p>Hello</p><script>if(a<b){x='</p>'}</script><p>World</p><style>a<b</style><textarea><p></textarea><p>End</p></article>"
    assert H.main_text(page, frozenset()) == "Hello World End"
    assert H.main_text("<p>a</p><script>x<y</scripty></script><p>b</p>", frozenset()) == "a b"


def test_deep_and_long_pages_take_linear_memory():
    import tracemalloc

    for piece in ("<div>", "<b>", "<p>", "</i></div>", "<ul><li>", "<a b='", "<!--x"):
        page = piece * (300_000 // len(piece)) + "deep"
        tracemalloc.start()
        H.tokens(page[:60_000])
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 60 << 20, piece
        assert isinstance(H.main_text(page, frozenset()), str)


SLOTS = """<html><body><div class="top"><a href="/">Site</a></div><div class="x7"><div class="x1"><h1>Title {i}</h1>{story}</div><div class="x2"><p>Side talk {i} about {i}</p></div></div><p>All rights kept</p></body></html>"""


def slot_rows(n=9):
    story = lambda i: "".join(f"<p>Own story {i} part {j} with words enough to be the main part</p>" for j in range(1 + i % 4))
    return [(i, f"http://h.example/{i}", SLOTS.format(i=i, story=story(i))) for i in range(n)], story


def test_only_the_template_tells_the_main_slot(spark, monkeypatch):
    rows, story = slot_rows()
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = {i: f"Title {i} " + " ".join(f"Own story {i} part {j} with words enough to be the main part" for j in range(1 + i % 4)) for i, _, _ in rows}
    assert {r.page_id: r.text for r in H.extract(pages).collect()} == want
    real = H.templates
    monkeypatch.setattr(H, "templates", lambda p: real(p).where("false"))
    emptied = {r.page_id: r.text for r in H.extract(pages).collect()}
    assert all(emptied[i] != want[i] for i in want)


def plain_template(pages):
    """Classes by explicit occurrence vectors: (texts of the template, the main slot) of one host's pages."""
    from collections import Counter, defaultdict

    found = [H.tokens(p) for p in pages]
    about, vectors, before = {}, defaultdict(lambda: [0] * len(pages)), defaultdict(set)
    weight = Counter()
    for k, toks in enumerate(found):
        counts, last, seen = Counter(t.token for t in toks), 0, set()
        for t in toks:
            weight[t.token] += t.weight
            vectors[t.token][k] += 1
            about[t.token] = t
            if t.token not in seen:
                before[t.token].add(last)
                seen.add(t.token)
                if counts[t.token] == 1 and t.kind < H.ROLE_MARK:
                    last = t.token
    enough = lambda t: sum(n > 0 for n in vectors[t]) >= max(H.LEAST_PAGES, H.LEAST_SHARE * len(pages))
    classes = defaultdict(list)
    for t in vectors:
        if about[t].kind < H.ROLE_MARK and enough(t):
            classes[tuple(vectors[t])].append(t)
    valid = [t for c in classes.values() if len(c) >= H.LEAST_TOKENS and 2 * sum(len(before[t]) == 1 for t in c) >= len(c) for t in c]
    frequent = {t for c in classes.values() for t in c if about[t].kind == H.ELEMENT}
    texts = [t for t in valid if about[t].kind > H.ELEMENT and about[t].around in frequent]
    shared, of_role = Counter(), Counter()
    for t in texts:
        shared[about[t].around] += sum(vectors[t])
    for t in vectors:
        if about[t].kind == H.ROLE_MARK:
            of_role[about[t].around] += sum(vectors[t])
    template = {t for t in texts if about[t].kind == H.TEXT or 2 * shared[about[t].around] > of_role[about[t].around]}
    whole = sum(t.weight for toks in found for t in toks if t.kind == H.PAGE_MARK)
    holding = [t for t in valid if about[t].kind == H.ELEMENT and about[t].named and weight[t] > H.MAIN_SHARE * whole]
    return template, min(holding, key=lambda t: (-about[t].named, weight[t], -about[t].depth), default=None)


def test_templates_equal_plain_classes(spark, small):
    from collections import defaultdict

    rows, _ = slot_rows()
    given = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{small}/pages.parquet").collect()]
    mixed = [(100 + i, "http://m.example/", f"<html><body><main><p>Same</p><p>Own {i}</p></main><ul><li>a<li>b{i % 2}</ul><div>Foot {i // 5}</div></body></html>") for i in range(10)]
    pages = spark.createDataFrame(rows + given + mixed, "page_id long, url string, html string")
    by_host = defaultdict(list)
    for r in pages.withColumn("h", H.host_of()).collect():
        by_host[r.h].append(r.html or "")
    got = {r._host: (set(r.template), r.slot) for r in H.templates(pages).collect()}
    assert got == {h: plain_template(p) for h, p in by_host.items() if len(p) >= H.LEAST_PAGES}


def test_comments_of_readers_go_on_large_hosts(spark):
    page = "<html><body><article><h1>T {i}</h1><p>Own story {i} with some more words in it</p><section class='comments'><p>First {i}!</p><p>Second</p></section></article><footer>F</footer></body></html>"
    got = H.extract(spark.createDataFrame([(i, "http://h/", page.replace("{i}", str(i))) for i in range(6)], "page_id long, url string, html string")).collect()
    assert {r.text for r in got} == {f"T {i} Own story {i} with some more words in it" for i in range(6)}
