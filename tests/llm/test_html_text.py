from amrspark.llm.html_text import extract_text, main_text

PAGE = """<html><head><title>Lost</title><style>p{}</style></head><body class="has-sidebar">
<header>Site head</header><div id="cookie-notice">We use cookies, and tell you at great length.</div>
<div class="wrap"><div class="main"><h2>blaKPC &lt;1&gt;</h2><div class=entry-content>
<p>A class A   carbapenemase &amp; a marker.<br>It spreads.</p><ul><li>meropenem<li>ceftriaxone</ul>
<p>short</p>loose text</div><div class="share"><a href=x>Tweet this page</a></div></div>
<aside><p>Other text of the side that is long enough to look like an article.</p></aside></div>
<div id="comments"><article class="comment"><p>A reader writes a long reply to all this.</p></article></div>
<form>Search</form><script>var x = "<p>no</p>";</script><footer>&copy; foot</footer></body></html>"""


def test_article_alone():
    assert main_text(PAGE).split("\n") == [
        "blaKPC <1>", "A class A carbapenemase & a marker. It spreads.", "meropenem", "ceftriaxone",
        "short", "loose text",
    ]


def test_link_lists_inside_go_and_truncated_pages_stay():
    links = "".join(f'<li><a href="/{i}">more</a></li>' for i in range(40))
    body = "<p>" + "the gene confers resistance to carbapenems " * 20 + "</p>"
    text = main_text(f"<body><article>{body}<ul>{links}</ul><p>The end.</p></article>")
    assert "more" not in text and text.endswith("The end.")
    assert main_text("<body><nav><a>x</a></nav><article><p>one<p>two &amp") == "one\ntwo &"


def test_wrappers_with_noisy_names_stay():
    side = '<div class="sidebar"><p>Popular now.</p></div>'
    text = "<p>" + "carbapenem resistance " * 9 + "</p><p class=byline>By A. B.</p>"
    for page in (
        f'<body><div class="content-with-sidebar"><main>{text}</main>{side}</div>',
        f"<body><form id=f>{side}<article>{text}</article></form>",
        f'<body><div class="comments-off"><article class="post">{text}</article></div>'
        '<div class="comments"><article class="comment"><p>No!</p></article></div>',
    ):
        assert main_text(page).split("\n") == ["carbapenem resistance " * 8 + "carbapenem resistance", "By A. B."]


def test_odd_pages():
    assert [main_text(x) for x in (None, "", "plain", "<", "a<b", "x</p>y", "<!-- x", "<script>v")] == [
        "", "", "plain", "<", "a", "x\ny", "", "",
    ]
    assert main_text("<div>" * 3000 + "deep") == "deep"
    assert len(main_text("<p>" + "word " * 200_000)) == 999_999


def test_rows(spark):
    schema = "chunk_id int, source string, html string, text string, TEXT_ string"
    rows = [(1, "u", PAGE, "own", None), (1, "u", PAGE, "own", None), (None, None, None, None, None)]
    got = extract_text(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.chunk_id or 0, r.source, r.text == main_text(PAGE)) for r in got if r.source) == [
        (1, "u", True), (1, "u", True)
    ]
    assert [(r.chunk_id, r.text) for r in got if r.source is None] == [(None, "")]
    assert extract_text(spark.createDataFrame([], schema)).count() == 0


def test_several_and_nested_articles_stay_whole():
    one, two = "carbapenem resistance " * 9 + "rises", "A second report."
    for page in (
        f"<body><main><article><p>{one}</p><p>{one}</p></article><article><p>{two}</p></article></main></body>",
        f"<body><article><article><p>{one}</p><p>{one}</p></article><p>{two}</p></article></body>",
    ):
        assert main_text(page).split("\n") == [one, one, two]


def test_thin_blocks_beside_plain_divs_go():
    one = "carbapenem resistance " * 19 + "rises"
    page = (
        f"<body><div>Our <b>daily</b> notice</div><div><h2>Title</h2><div><p>{one}</p><p>Short.</p><p>{one}</p></div></div>"
        "<div><p>You may</p><p>also read</p></div></body>"
    )
    assert main_text(page).split("\n") == ["Title", one, "Short.", one]
