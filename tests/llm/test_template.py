import random
import time

import pytest

from corpusloom.llm import template

PAGE = """<!DOCTYPE html><html><head><title>T {n}</title><style>p{{}}</style><script>var x="</p>";if(a<b)c();</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Home</a></li><li>More</li></ul></nav><!-- ad <p>no</p> -->
<div class="cookie-notice">We use cookies</div><div class="ad">Buy now</div>
<article><h1>Title &amp; {n}</h1><p>First  <b>bold</b>\n text&nbsp;{n}.<p>Second<br>line &lt;x&gt;</p><aside>Side</aside><form><input>Send</form><ul><li>one<li>two</ul>
<div id="comments"><p>Great post</p></div></article><div class="sidebar">Links</div><footer>&copy; Site {n}</footer></body></html>"""
TEXT = "Title & {n}\n\nFirst bold text {n}.\n\nSecond line <x>\n\none\n\ntwo"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "t", 3, "f") for r in rows], "page_id long, url string, html string, text string, n_chars long, frame string")


def test_article_without_boilerplate(spark):
    rows = [(i, f"http://site.example/{i}", PAGE.format(n=i)) for i in range(6)] + [(6, "http://lone.example/", PAGE.format(n=6)), (7, None, PAGE.format(n=7)), (8, "http://[bad", PAGE.format(n=8))]
    for r in template.main_text(pages(spark, rows)).collect():
        assert r["text"] == TEXT.format(n=r["page_id"])
        assert r["n_chars"] == len(r["text"])


def test_pages_without_an_article_lose_what_the_host_repeats(spark):
    body = "<html><body><div><span>Welcome to us</span></div><div><p>Own text {n}</p></div><div>All rights reserved</div></body></html>"
    rows = [(i, f"http://plain.example/{i}", body.format(n=i)) for i in range(5)]
    assert {r["page_id"]: r["text"] for r in template.main_text(pages(spark, rows)).collect()} == {i: f"Own text {i}" for i in range(5)}


def test_frames_are_the_tokens_that_all_pages_have_once(spark):
    rows = [(i, "http://h.example/x", f"<html><body><article><h1>A{i}</h1>{'<p>x</p>' * (i + 1)}</article></body></html>") for i in range(4)]
    frame = template.templates(pages(spark, rows)).first()["frame"]
    tags = {template._hash(t.key): t.key for t in template.tokens(rows[0][2])}
    assert [tags[x] for x in frame] == ["<html>", "html<body>", "html/body<article>", "html/body/article<h1>", "html/body/article</h1>", "html/body</article>", "html</body>", "</html>"]


def test_equal_pages_keep_their_text(spark):
    rows = [(i, "http://same.example/", PAGE.format(n=1)) for i in (1, 2, 2)]
    assert [r["text"] for r in template.main_text(pages(spark, rows)).collect()] == [TEXT.format(n=1)] * 3


def test_odd_pages(spark):
    rows = [(1, "http://o.example/", None), (2, "http://o.example/", ""), (3, "http://o.example/", "just text"), (4, "http://o.example/", "<p>unclosed <b>all & <article><p>the way"), (None, "u", "<script>never closed <p>x</p>"), (5, "u", "<main><p>M</p></main><p>rest</p>"), (6, "u", "<p>not this</p><article></article>"), (7, "u", "a < b <3 </nothing> c"), (8, "u", "<article>" + "<p>long word</p>" * 20_000 + "</article>")]
    found = {r["page_id"]: r["text"] for r in template.main_text(pages(spark, rows)).collect()}
    assert found[8].count("long word") == 20_000
    del found[8]
    assert found == {1: "", 2: "", 3: "just text", 4: "the way", None: "", 5: "M", 6: "", 7: "a < b <3 c"}


def test_no_pages(spark):
    assert template.main_text(pages(spark, [])).count() == 0


def test_the_template_decides_where_nothing_tells(spark):
    """No article, no telling names: the element with the text is found, its repeated texts and link records left out."""
    words = lambda n, k: " ".join(f"w{n}x{i}" for i in range(k))
    page = "<html><body><div><ul>{menu}</ul></div><div><span>Hello visitor {n}</span></div><section><h2>{title}</h2>{text}<ul>{more}</ul><b>Read on below</b></section><div><i>tail {n}</i></div></body></html>"
    rows, expected = [], {}
    for n in range(8):
        paragraphs = [words(f"{n}p{k}", 30) for k in range(2 + n % 3)]
        menu = "".join(f"<li><a href=x>menu {n} {k}</a></li>" for k in range(5))
        more = "".join(f"<li><a href=x>see {n} {k}</a></li>" for k in range(3 + n % 2))
        rows.append((n, f"http://plain.example/{n}", page.format(n=n, menu=menu, more=more, title=f"Title {n}", text="".join(f"<p>{p}</p>" for p in paragraphs))))
        expected[n] = "\n\n".join([f"Title {n}", *paragraphs])
    assert {r["page_id"]: r["text"] for r in template.main_text(pages(spark, rows)).collect()} == expected


def test_classes_match_brute_force(spark):
    rng = random.Random(3)
    rows = [(k, f"http://{'ab'[k % 2]}.example/", "<html><body>" + "".join(rng.choice(["<p>one</p>", "<div>two</div>", f"<i>{k}</i>", "<ul><li>x<li>y</ul>"]) for _ in range(rng.randint(2, 6))) + "<hr><p>end</p></body></html>") for k in range(12)]
    found = {}
    for r in template.classes(pages(spark, rows)).collect():
        found.setdefault((r["host"], r["low"], r["high"]), set()).add((r["token"], r["is_text"], r["pages"], r["times"]))
    expected = []
    for host in "ab":
        own = [[(template._hash(t.key), t.text is not None) for t in template.tokens(h)] for _, u, h in rows if u == f"http://{host}.example/"]
        vectors = {}
        for token in {t for page in own for t in page}:
            vectors.setdefault(tuple(page.count(token) for page in own), set()).add(token)
        for vector, members in vectors.items():
            n = sum(v > 0 for v in vector)
            if len(members) > 1 and n >= max(2, len(own) / 2):
                expected.append({(*t, n, sum(vector)) for t in members})
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, expected))


@pytest.mark.parametrize("html", ["<div>" * 100_000, '<a "' * 100_000, "<p>x" * 100_000, "<!" * 100_000, "</i>" * 100_000, "<b class='x'>" * 100_000, "<li><div><a '\">" * 30_000, "<script>" * 100_000, "<" * 300_000, "<div><p><span>" * 30_000 + "</div>" * 30_000])
def test_broken_pages_take_linear_time(html):
    began = time.process_time()
    template.extract(html, [], set())
    assert time.process_time() - began < 4


def test_unclosed_quotes_leave_later_tags(spark):
    assert [t.text for t in template.tokens("<p>a <x 'b <i>c</i><p>d \"<b>e</b>") if t.text] == ["a <x 'b c", 'd "e']
