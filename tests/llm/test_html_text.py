import pytest

from styloscope.llm.html_text import Page, host_of, main_text


def text_of(html):
    return "\n\n".join(t for t, _ in Page(html).content())


CASES = {
    "": "",
    "plain &amp; simple": "plain & simple",
    "<p>one<p>two</p>tail": "one\n\ntwo\n\ntail",
    "<article><h1>T</h1><p><b>Bold start.<br><p>Next &lt;b&gt; &eacute;&#233;&nbsp;x.</p></article>":
        "T\n\nBold start.\n\nNext <b> éé x.",
    "<nav><ul><li><a href='/'>m</a></li></ul></nav><article>body</article><footer>f</footer>": "body",
    "<header>site</header><article><header><h1>Title</h1></header><p>text</p></article>": "Title\n\ntext",
    "<body><div class='ad'>buy</div><p>a  b\n c</p><div class=\"x comments\"><p>no</p></div></body>": "a b c",
    "<article><p>a</p><section id='comments'><article><p>reader</p></article></section><p>b</p></article>": "a\n\nb",
    "<main><p>m</p></main><p>outside</p>": "m",
    "<script>var t='</p>';</script><style>p{}</style><p>x</p><!-- <p>no</p> --><form><p>q</p></form>": "x",
    "<p>a<span>b</span> <i>c</i></p><ul><li>d<li>e</ul><table><tr><td>f<td>g</table>": "ab c\n\nd\n\ne\n\nf\n\ng",
    "<p>cut off in a tag <a href='/x": "cut off in a tag",
    "<p>1 < 2 & 3 > 2</p><p title='a>b'>t</p>": "1 < 2 & 3 > 2\n\nt",
    "<p>unended comment <!-- never": "unended comment",
    "<div role='navigation'>n</div><div hidden>h</div><p>k</p>": "k",
    "<script>never closed <p>x</p>": "",
    "<p>a</b></i></div>b</p>": "ab",
    "<h1>a</h1>b<hr>c": "a\n\nb\n\nc",
}


@pytest.mark.parametrize("html", CASES)
def test_text_of_a_page(html):
    assert text_of(html) == CASES[html]


@pytest.mark.parametrize("open_, close", [("<div>", "</div>"), ("<div class='menu x'>", "</div>")])
def test_deep_nesting_is_linear(open_, close):
    import tracemalloc

    peaks = []
    for depth in (10_000, 100_000):
        tracemalloc.start()
        assert text_of(open_ * depth + "x" + close * depth) == "x"
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 15 * peaks[0]


def test_attributes_are_whole_names():
    story = "<article><p>Story.</p></article>"
    assert text_of(f"<div style='overflow: hidden'>{story}</div>") == "Story."
    kept = ["title='a hidden gem'", "data-id='share'", 'data-role="dialog"', "data-hidden", "data-class=menu",
            "alt='class=menu role=navigation'", "title='x' data-x='id=\"share\"'", "style=overflow:hidden"]
    for attrs in kept:
        assert text_of(f"<article><p>Story.</p><div {attrs}>Inside</div></article>") == "Story.\n\nInside", attrs
    for attrs in ["hidden", "HIDDEN=''", "role=dialog", "Role = 'dialog'", "aria-hidden='true'", "x hidden/"]:
        assert text_of(f"<article><p>Story.</p><div {attrs}>Inside</div></article>") == "Story.", attrs


def page(k, extra=""):
    box = "<div class='box'><p>Read our magazine</p><ul><li>Now</li></ul></div>"
    return f"<html><body>{box}<article><p>Story number {k}.</p><p>The end.</p>{extra}</article><div><p>Own {k}</p></div>{box}</body>"


def test_recurring_containers_go_and_prose_stays(spark):
    subscribe = "<div><p>Write to us</p></div>"
    rows = [(k, f"https://a.example/{k}", page(k, subscribe)) for k in range(12)]
    rows += [(100 + k, f"http://b.example:80/{k}", page(1)) for k in range(12)]  # copies of one article
    rows += [(200 + k, "https://c.example/x", f"<body><div>Shared words</div><p>Alone {k}</p></body>") for k in range(9)]
    rows += [(300, None, None), (301, "", ""), (None, "https://a.example/0", page(0, subscribe)), (300, None, None)]
    pages = spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in rows],
                                  "page_id long, url string, html string, host string, key int")
    got = sorted((tuple(r) for r in main_text(pages).collect()), key=str)
    story = lambda k, more="": f"Story number {k}.\n\nThe end.{more}"
    want = [(k, f"https://a.example/{k}", story(k)) for k in range(12)]
    want += [(100 + k, f"http://b.example:80/{k}", story(1)) for k in range(12)]
    want += [(200 + k, "https://c.example/x", f"Alone {k}") for k in range(9)]
    want += [(300, None, "")] * 2 + [(301, "", ""), (None, "https://a.example/0", story(0))]
    assert got == sorted(((*r, len(r[2])) for r in want), key=str)


def test_copies_keep_their_containers(spark):
    rows = [(k, "https://b.example/", page(1, "<div><p>In the article</p></div>")) for k in range(20)]
    got = main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r.text for r in got} == {"Story number 1.\n\nThe end.\n\nIn the article"} and len(got) == 20


def test_pages_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    texts = {r.page_id: r.text for r in main_text(pages).collect()}
    assert set(texts) == {r.page_id for r in pages.collect()}
    for r in pages.collect():
        body = r.html.split("<article>")[1].split("</article>")[0]
        assert texts[r.page_id].startswith(text_of(body.split("</h1>")[0]))
        assert "".join(texts[r.page_id].split()) == "".join(text_of(body).split())


def test_host_and_empty(spark):
    urls = ["https://User:pw@Ex.Ample.org:81/a?b#c", "http://x", "no url", None, "ftp://h/"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    from pyspark.sql import functions as F
    assert [r[0] for r in df.select(host_of(F.col("url"))).collect()] == ["ex.ample.org", "x", "", "", "h"]
    assert main_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
