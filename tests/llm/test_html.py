import html
import re

from tariffa.llm import html_extract as hx

SF = "/root/testdata/sf0.01"


def plain(page):
    """Article text of the test pages: every piece between block tags, joined."""
    m = re.search(r"<article>(.*)</article>", page, re.S)
    blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)[^>]*>", m.group(1))]
    return " ".join(x for x in blocks if x)


def test_whole_table_equals_plain_article(spark):
    got = {r["page_id"]: r for r in hx.op1_html_extraction(spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        assert got[p["page_id"]]["text"] == plain(p["html"]) and got[p["page_id"]]["n_chars"] == len(plain(p["html"]))


def test_parts_that_go_and_stay():
    body = " ".join(["This is the body of the article and it goes on for a good while."] * 3)
    page = f"""<html><head><title>T</title><style>p{{}}</style></head><body class="has-sidebar"><header><h1>Site</h1></header><ul class="mainMenu"><li><a href="/">Home</a></ul>
    <div class="cookie-notice">We use cookies</div><div id=content><h2>A&amp;B &lt;tag&gt;</h2><p>{body}<script>if (a < b) "</p>"</script><p>Short.<table><tr><td>x<td>y</table>
    <p>1 < 2 and <b>bo</b>ld<br>next&nbsp;line<!-- <p>no --></p><div class="ad">Buy</div><p>{body}</p></div><aside>Side</aside><form>Name <input></form>
    <div id="comments"><p>{body} says a reader</p></div><footer>&copy; me</footer></body></html>"""
    assert hx.extract(page) == f"A&B <tag> {body} Short. x y 1 < 2 and bold next line {body}"


def test_short_paragraph_between_adverts_of_an_article():
    long = "long " * 300
    assert hx.extract(f"<article><p>{long}</p><div class=ad>x</div><p>Short.</p><div class=ad>y</div><p>{long}</p></article>") == f"{long}Short. {long.strip()}"


def test_plain_page_without_any_hint():
    text = "word " * 60
    assert hx.extract(f"<div><a href=x>one</a></div><p>{text}</p><p>tail {text}</p>").endswith(text.strip())
    assert hx.extract("only text") == "only text"
    assert hx.extract("<nav>all there is</nav>") == "all there is"
    assert hx.extract("<form><article><p>inside a form</p></article></form>") == "inside a form"


def test_awkward_rows(spark):
    big = "<p>" + "x y " * 200000
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<"), (4, "u", "<p"), (5, "u", "<!-- open"), (6, "u", "<script>open"), (7, "u", "<a b='c>d"), (8, "u", big), (8, "u", big), (None, "u", "<p>a</p>"), (9, "u", '<p x="1 > 0">&#x41;&bogus;&#0;</p>')]
    pages = spark.createDataFrame([(i, u, h, "clash") for i, u, h in rows], "page_id long, url string, html string, text string")
    got = [(r["page_id"], r["text"], r["n_chars"]) for r in hx.main_text(pages).collect()]
    assert [len(t) == n for _, t, n in got] == [True] * len(rows)
    assert [t for i, t, _ in got if i in (1, 2, 5, 6)] == ["", "", "", ""]
    assert [t for i, t, _ in got if i == 8] == [" ".join(["x y"] * 200000)] * 2
    assert ("A&bogus;�") in [t for _, t, _ in got] and (None, "a", 1) in got
    assert hx.main_text(pages.limit(0)).collect() == []


def test_elements_with_optional_end_tags_do_not_take_the_rest():
    body = "This is the body of the article and it goes on for a good while."
    for rest in (f"<article><p>{body}</p></article>", f"<p>{body}</p>"):
        assert hx.extract(f"<body><datalist><option value=a>A<option value=b>B</datalist>{rest}</body>") == body
        assert hx.extract(f"<body><div><button>Go<svg><path d=x></div><select><optgroup><option>1<option>2</select>{rest}</body>") == body
    assert hx.extract('<article><h1>Head</h1><p class="notice">We note<p>one<p>two</article>') == "Head one two"
    assert hx.extract(f"<div><ul><li class=ad>Buy<li>{body}<li class=ad><p>Buy<ul><li>x</ul><li>{body}</ul><dl><dt class=promo>P<dd>{body}</dl></div>") == f"{body} {body} {body}"
    assert hx.extract(f"<table><tr><td class=sidebar>Side<td>{body}<tr class=nav><td>n<tr><td>{body}</table>") == f"{body} {body}"
    assert hx.extract(f"<p>{body} <svg><title>t</title><text>no</text></svg>and <button>press</button>on</p>") == f"{body} and on"


def test_article_cards_do_not_replace_the_body():
    body, card = " ".join(["The body of the page stands in a plain div and is long."] * 20), "A teaser of some other page."
    cards = "".join(f"<article><p>{card}</p></article>" for _ in range(3))
    for name in ("related", "comments"):  # removed, with the articles in them
        assert hx.extract(f"<div><h1>Head</h1><p>{body}</p></div><section class={name}>{cards}</section>") == f"Head {body}"
    assert hx.extract(f"<div><p>{body}</p></div><div class=x>{cards}</div>").startswith(body)
    assert hx.extract(f"<div>Site</div><article><p>{body}</p></article><div>{card}</div>") == body
    # a wrapper with such a class word that holds the article
    assert hx.extract(f"<h1>Site</h1><div class=has-sidebar><article><p>{body}</p></article></div>") == body


def test_adverts_do_not_split_the_text_of_their_parent():
    long, short = ("long " * 360).strip(), "A closing line of a hundred characters. " * 2
    ad = "<div class=ad><p>Buy</p></div>"
    for top in ("<div id=content>", "<body>", "<section><div>"):
        assert hx.extract(f"{top}<p>{long}</p>{ad}<p>{short}</p>{ad}<p>{long}</p>") == f"{long} {short}{long}"
    assert hx.extract(f"<div id=content>{long}{ad}{short}<br>{ad}<div>{short}</div>{ad}<p>{long}") == f"{long} {short}{short}{long}"
    # a part between other parts than paragraphs still splits
    assert hx.extract(f"<body><div>Site name</div><nav>n</nav><div><p>{long}</p></div><footer>f</footer><div>Imprint</div></body>") == long
    assert hx.lines("<div><p>one <button>x</p>two</div>")[0] == [("one", 3.0, 0), ("two", 3.0, 0)]


def test_class_tokens_and_wrappers():
    body, side = " ".join(["The body of the page stands in a plain div and is long."] * 8), "Read these other pages of ours today."
    for name in ("content-with-sidebar", "has-sidebar", "no-ads", "menu-open", "menu-content", "page-menu", "sidebar"):  # wrappers, some named like boilerplate
        page = f"<body><div class='{name}'><h1>Head</h1><p>{body}</p><div class='sidebar left'><p>{side}</p></div><div id=comments><p>{side}</p></div></div></body>"
        assert hx.extract(page) == f"Head {body}", name
    assert hx.extract(f"<div class='menu-page'><div class='main-menu'><p>{body}</p></div></div>") == body
    assert hx.extract(f"<article><p>{body}</p><div class='social-impact'><p>{side}</p></div><div class='social-links'><p>x</p></div></article>") == f"{body} {side}"
    assert hx.extract(f"<div><h1 class='entry-header'>Head</h1><p>{body}</p></div>") == f"Head {body}"
    remarks = f"<div class='post-comments'>{'<p>' + body + ' says a reader</p>' * 40}</div>"
    assert hx.extract(f"<div><h1>Head</h1><p>{side}</p></div>{remarks}") == f"Head {side}"


def test_lists_of_links_outside_articles():
    body = " ".join(["The body of the page stands in a plain div and is long."] * 3)
    menu = "<ul><li><a href=1>One page</a><li><a href=2>Two pages</a><li><a href=3>Three</a></ul>"
    assert hx.extract(f"{menu}<div><h2>Head</h2><p>{body}</p><h3>More</h3>{menu}</div>") == f"Head {body}"
    assert hx.extract(f"<div><p>{body}</p><ul><li>One thing<li>Another <a href=x>thing</a></ul></div>") == f"{body} One thing Another thing"
    assert hx.extract(f"<article><p>{body}</p><h3>Sources</h3>{menu}</article>") == f"{body} Sources One page Two pages Three"
    assert hx.extract(menu) == "One page Two pages Three"
