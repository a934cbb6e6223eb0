import html
import re

from pyspark.sql import functions as F

from lodestore.llm.html_extract import candidates, extract, main_text, op10_html_extract, template_candidates


def plain(page):
    """The synthetic pages' article, by its own plain rules: blocks are h1 and p, other tags vanish."""
    body = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br>", " ", b)))).strip() for b in re.split(r"</?(?:p|h1)>", body)]
    return "\n".join(b for b in blocks if b)


def test_query_equals_plain_rules(spark):
    d = "/root/testdata/sf0.01"
    pages = {r.page_id: r for r in spark.read.parquet(f"{d}/pages.parquet").collect()}
    got = op10_html_extract(spark, d).collect()
    assert sorted(r.page_id for r in got) == sorted(pages)
    for r in got:
        want = plain(pages[r.page_id].html)
        assert (r.text, r.n_chars, r.url) == (want, len(want), pages[r.page_id].url)


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav>
<div class="cookie-notice">We use cookies</div><div id="wrap" class="layout no-sidebar">
<article><h1>Head&shy;line &amp; more</h1><p>One <b>bold</b>
 text<br>line<p>Two &lt;b&gt; &#233;&#x41; <script>var x = "</p>";</script>end<ul><li>a<li>b</ul>
<div class='ad'>Buy</div><aside>side</aside><form>f<input value=3></form><table><tr><td>c1<td>c2</table><!-- gone --></article>
<div id="comments"><article class="comment"><p>First!</p></article></div></div><footer>foot</footer></body></html>"""


def test_article_without_furniture():
    assert main_text(PAGE) == "Head­line & more\nOne bold text line\nTwo <b> éA end\na\nb\nc1\nc2"


def test_broken_pages():
    assert main_text("") == main_text("<!-- never closed <p>x") == main_text("<script>x") == ""
    assert main_text("<") == "<"
    assert main_text("just text & more") == "just text & more"
    assert main_text("</p></div>a<p>b</article>c") == "a\nbc"
    assert main_text("<p>a < b</p>") == "a < b"
    assert main_text("<p title='a>b'>x</p>") == "x"
    assert main_text("<b>" * 50000 + "deep") == "deep"
    assert main_text("<article></article><p>rest") == "rest"
    assert main_text("<nav><ul><li>menu<article><p>text</article>") == "text"
    assert main_text("<nav><article class=teaser>more</article></nav><p>text") == "text"


def test_templates_of_a_site_go_and_shared_article_text_stays(spark):
    line = "<p>This sentence is on every page.</p>"
    rows = [(i, f"https://a.example/{i}", f"<div><span>Share this page</span></div><section>{line}</section><p>Story {i}.</p>") for i in range(10)]
    rows += [(100 + i, f"https://b.example/{i}", f"<div>Tip of the day</div><article>{line}<p>Story {i}.</p></article>") for i in range(10)]
    rows += [(200, "https://c.example/", f"<section>{line}</section><p>Alone.</p>"), (201, None, f"<section>{line}</section>")]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Story {i}." for i in range(10))
    assert all(got[100 + i] == f"This sentence is on every page.\nStory {i}." for i in range(10))
    assert got[200] == "This sentence is on every page.\nAlone." and got[201] == "This sentence is on every page."


def test_templates_of_a_large_host_go(spark):
    """A menu of one section stands on many pages, but on a small share of its host's."""
    menu = "<div><span>Section menu</span></div>"
    rows = [(i, f"https://a.example/{i}", (menu if i < 150 else "") + f"<p>Story {i}.</p>") for i in range(1000)]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"Story {i}." for i in range(1000)}


def test_unmarked_boilerplate_inside_articles_goes(spark):
    """Blocks that different articles of a host share go; shared sentences, and the text of copied articles, stay."""
    more = "<div><p>More stories</p><p><a href=/1>One</a> <a href=/2>Two</a></p></div>"
    line = "<p>This sentence is on every page.</p>"
    story = lambda i: f"<p>Story {i} is long enough to be most of its article.</p><p>And it goes on for a second paragraph.</p>"
    text = lambda i: f"This sentence is on every page.\nStory {i} is long enough to be most of its article.\nAnd it goes on for a second paragraph."
    rows = [(i, f"https://{tag}.example/{i}", f"<{tag}>{line}{story(i)}{more}</{tag}>") for k, tag in enumerate(("article", "main")) for i in range(10 * k, 10 * k + 10)]
    copied = f"<article><div>{story(0)}</div><div><p>a</p><p>b</p></div></article>"
    rows += [(100 + i, "https://copies.example/", copied) for i in range(10)]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == text(i) for i in range(20))
    assert all(got[100 + i] == text(0).partition("\n")[2] + "\na\nb" for i in range(10))


def test_hashes_cover_whole_subtrees():
    a, b = template_candidates("<div><p>x</p></div>"), template_candidates("<div class=q><p>x</p></div>")
    c = template_candidates("<div><b>x</b></div>")
    assert a == b and len(a) == 2 and not set(a) & set(c)


def test_odd_rows(spark):
    rows = [(1, "https://a/x", None), (2, None, ""), (None, "odd", "<p>x"), (3, "https://a/x", "<p>y"), (3, "https://a/x", "<p>y"), (4, "https://a/z", "<p>" + "é " * 200000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("h")).withColumn("text", F.lit("t"))
    got = sorted([(r.page_id, r.url, r.text) for r in extract(pages).collect()], key=str)
    assert got == sorted([(1, "https://a/x", ""), (2, None, ""), (None, "odd", "x"), (3, "https://a/x", "y"), (3, "https://a/x", "y"), (4, "https://a/z", ("é " * 200000).strip())], key=str)
    assert extract(pages.limit(0)).collect() == []


def test_counts_are_reported_and_bounds_are_parameters(spark):
    """Unmarked boilerplate is deleted and counted where it would be text; a shared sentence inside an article stays."""
    line, tip = "<p>This sentence is on every page.</p>", "<div>Tip of the day</div>"
    rows = [(i, f"https://a.example/{i}", f"{tip}<article>{line}<p>Story {i}.</p></article><div>Join {i % 2}</div>") for i in range(10)]
    rows += [(100 + i, f"https://b.example/{i}", f"{tip}<p>Story {i}.</p>") for i in range(3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: (r.text, r.n_templates) for r in extract(pages).collect()}
    assert all(got[i] == (f"This sentence is on every page.\nStory {i}.", 0) for i in range(10))
    assert all(got[100 + i] == (f"Tip of the day\nStory {i}.", 0) for i in range(3))
    got = {r.page_id: (r.text, r.n_templates) for r in extract(pages, min_pages=3).collect()}
    assert all(got[100 + i] == (f"Story {i}.", 1) for i in range(3))


def test_names_are_a_second_step():
    page = '<article><p>a</p><div class="share">b</div><p style="display:none">c</p><nav>d</nav></article>'
    assert main_text(page) == "a\nc" and main_text(page, names=None) == "a\nb\nc"


def test_broken_pages_take_linear_time():
    """A megabyte of each kind of breakage, as whole pages."""
    from time import perf_counter

    n = 1 << 20
    kinds = {
        "open quotes": '<a "' * (n // 4),
        "open quotes and an end": '<a "' * (n // 4) + ">",
        "odd quotes": "<a '>\"<b \">" * (n // 10),
        "nested blocks": "<div>" * (n // 5),
        "nested articles": "<article>x" * (n // 10),
        "unmatched ends": "<b>" * (n // 7) + "</i>" * (n // 7),
        "blocks deep in a paragraph": "<p><div>" + "<b>" * (n // 12) + "<h1></h1>" * (n // 12),
        "list items": "<ul>" + "<li><b>" * (n // 7),
        "lone brackets": "<" * n,
        "comments": "<!--" * (n // 4),
        "attributes": "<p " + "class " * (n // 6) + ">x",
    }
    for name, page in kinds.items():
        start = perf_counter()
        extracted = main_text(page, frozenset([1]), frozenset([1]))
        candidates(page)
        seconds = (perf_counter() - start) * 2**20 / len(page)
        assert seconds < 20, (name, seconds)
        assert extracted is not None
        half = page[: len(page) // 4]
        start = perf_counter()
        main_text(half, frozenset([1]), frozenset([1]))
        candidates(half)
        assert seconds < 10 * max(perf_counter() - start, 0.3), name  # four times the page
