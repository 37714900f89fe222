from inkwell.llm import pagetext as P

ARTICLE = ("<h1>A title</h1><p>First, a long sentence with some points. It goes on, and on.</p>"
           "<p>Second one, also long enough to count; it has <b>bold<i> and</b> more</i> text.</p><ul><li>item</ul>")
TEXT = ("A title First, a long sentence with some points. It goes on, and on. Second one, also long enough to count; "
        "it has bold and more text. item")
NOISE = ('<nav><ul><li><a href="/a">Home, sweet. home</a></ul></nav><div class="cookie-notice">We use cookies, a lot. '
         'Really, we do.</div><form><label>Mail</label><input><button>Go, now.</button></form>')


def test_main_text_of_several_layouts():
    for start, end in (("<article>", "</article>"), ('<div class="post">', "</div>"), ("<main>", "</main>"),
                       ('<div id=x><section class="body">', "</section></div>")):
        html = (f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var t='</p>'</script></head><body>"
                f"<header>Site, name.</header>{NOISE}<!-- ad <p>x, y.</p> -->{start}{ARTICLE}{end}"
                f"<aside>Related, things. To read.</aside><div class='comments'><p>Reader says: nice, good. Very, very long "
                f"comment with points, more, and more. And then again, some.</p></div>"
                f"<div class='ad'>Buy, buy. buy</div><footer>&copy; 2020, all. rights.</footer></body></html>")
        assert P.main_text(html) == TEXT, start


LONG = "Here, the story goes on. It has many, many words. " * 8


def test_nothing_of_an_article_in_several_sections_is_dropped():
    p = f"<p>{LONG}</p>"
    lead = "<div class=lead><p>Short lead, with a point.</p></div>"
    whole = " ".join(["Title Short lead, with a point.", LONG.strip(), LONG.strip()])
    links = '<ul><li><a href="/">Home, sweet.</a><li><a href="/b">About us.</a></ul>'
    for a, b in (("<div class=content>", "</div>"), ("<div id=page><div class=content>", "</div></div>"), ("", ""),
                 ("<div id=page>" + links + "<div class=content>", "</div></div>")):
        html = f"<body>{a}<h1>Title</h1>{lead}<div class=text>{p}{p}</div>{b}<footer>End, of. page</footer></body>"
        assert P.main_text(html) == whole, a
    for tag in ("div", "section", "article"):              # 85 / 15 in siblings, with a heading each
        html = (f"<body><{tag} class=a><h2>One</h2>{p * 6}</{tag}><{tag} class=b><h2>Two</h2>{p}</{tag}></body>")
        assert P.main_text(html) == " ".join(["One", *[LONG.strip()] * 6, "Two", LONG.strip()]), tag
    html = f"<body><div class=t><p>Before, it was so.</p><blockquote>{p * 5}</blockquote><p>After, it was not.</p></div></body>"
    assert P.main_text(html) == " ".join(["Before, it was so.", *[LONG.strip()] * 5, "After, it was not."])
    html = f"<body><div id=w>{links}<div class=x>{p * 300}</div>{links}</div></body>"
    assert P.main_text(html) == " ".join([LONG.strip()] * 300)


def test_names_and_forms_around_the_main_text_do_not_empty_the_page():
    body = f"<h1>A title</h1><p>{LONG}</p><p>{LONG}</p>"
    text = f"A title {LONG.strip()} {LONG.strip()}"
    talk = f"<div id=comments class=comments-area>{'<p>Reader says: nice, good. Very, very long.</p>' * 60}</div>"
    for start, end in (('<div class="layout no-sidebar"><article>', "</article></div>"),
                       ('<article class="post has-comments">', "</article>"), ('<div id="legal-news">', "</div>"),
                       ('<div class="search-result-page">', "</div>"), ("<form id=all><div class=x>", "</div></form>"),
                       ('<form><div class="with-ads"><div id=legal><main>', "</main></div></div></form>"),
                       ('<div class="related-widget"><div class="post">', "</div></div>")):
        for inside, outside in (("", ""), (NOISE, ""), ("", NOISE), ("", talk), (NOISE, talk)):
            html = f"<body><header>Site, name.</header>{start}{inside}{body}{end}{outside}<footer>End, of. it</footer></body>"
            assert P.main_text(html) == text, (start, inside, outside)
    # names still keep out what stands beside the main text, longer or not
    for start, end in (("<article>", "</article>"), ("<div class=post>", "</div>")):
        assert P.main_text(f"<body>{start}{body}{end}{talk}</body>") == text
        assert P.main_text(f"<div class=no-sidebar>{start}{body}{end}{talk}</div>") == text
    # without any heading, comments up to 95 % of the text are still comments
    assert P.main_text(f"<body><div class=post><p>{LONG}</p></div>{talk}</body>") == LONG.strip()


def test_references_white_space_and_broken_markup():
    assert P.main_text("<article><p>a &amp;lt; b\n\t c&nbsp;d &eacute;.</p></article>") == "a &lt; b c d é."
    assert P.main_text("<article><p>one, two.<p>thr<em>ee</em>, four.<br>five") == "one, two. three, four. five"
    assert P.main_text("<article><p>cut, off.</p><p>tail, end.</p><foo") == "cut, off. tail, end."
    assert P.main_text("<article><p>2 < 3, and 4 > 1.</p><script>if (a<b) {'</div>'}</script></article>") == "2 < 3, and 4 > 1."
    assert P.main_text("plain text, without tags.") == "plain text, without tags."
    for empty in (None, "", " \n", "<", "<<>>", "<nav>only, menu.</nav>", "<script>x", "<!-- open", "<p"):
        assert P.main_text(empty) in ("", "<", "<<>>")


def test_long_and_deep_pages():
    para = "<p>" + "Word, word. " * 50 + "</p>"
    page = "<html><body><article>" + para * 3000 + "</article></body></html>"
    assert len(P.main_text(page)) == 3000 * (len("Word, word. " * 50))- 1
    assert P.main_text("<div>" * 3000 + "<p>deep, text.</p>") == "deep, text."


def test_path_ratios_pick_the_text_paths():
    found = P.blocks("<body><div class=m><p>x</p><p>y</p></div><div class=t><p>" + "Long, text. " * 9 + "</p></div></body>")
    s = P.scores(found)
    assert len(s) == 3 and s[2] > 5 * max(s[:2])


def test_table_with_messy_rows(spark, tmp_path):
    rows = [(1, "u", f"<article>{ARTICLE}</article>"), (1, "u", f"<article>{ARTICLE}</article>"), (2, None, None), (None, "v", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text", "2 as n_chars")
    df.write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted((r.page_id or 0, r.url or "", r.text, r.n_chars) for r in P.op9_tag_path_ratios(spark, str(tmp_path)).collect())
    assert got == [(0, "v", "", 0), (1, "u", TEXT, len(TEXT)), (1, "u", TEXT, len(TEXT)), (2, "", "", 0)]
    assert P.extract(df.where("1 = 0")).count() == 0
