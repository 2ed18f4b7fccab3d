"""Layout wrappers and article elements with class names that also mark boilerplate."""

import pytest

from styloscope.llm.html_text import Page, main_text

STORY = "<p>" + "The story goes on. " * 8 + "</p>"
TOLD = ("The story goes on. " * 8).strip()
CASES = {
    f"<body class='x'><div class='has-sidebar'><article>{STORY}</article></div></body>": TOLD,
    f"<div class='no-sidebar'><div id='content-menu-wrap'>{STORY}</div></div>": TOLD,
    f"<div class='content sidebar'><article>{STORY}</article></div><p>out</p>": TOLD,
    f"<div class='menu'><main>{STORY}</main></div>": TOLD,
    f"<div class='widget'>{STORY}</div><p>k</p>": f"{TOLD}\n\nk",
    f"<article>{STORY}<section class='related-work'><p>a</p></section><p class='notice'>b</p>"
    "<section class='notice'>c</section><p class='social-policy'>d</p></article>": f"{TOLD}\n\na\n\nb\n\nc\n\nd",
    f"<article>{STORY}</article><article class='comment'>{STORY * 3}</article>": TOLD,
    f"<article><p>Short.</p></article><div class='comments'><article>{STORY}</article></div>": "Short.",
    f"<article>{STORY}</article><div class='related'><article><p>teaser</p></article></div>": TOLD,
}


@pytest.mark.parametrize("html", CASES)
def test_wrappers(html):
    assert "\n\n".join(text for text, _ in Page(html).content()) == CASES[html]


def test_a_section_box_of_a_large_host_is_template(spark):
    box = "<div><p>Section box</p></div>"
    rows = [(k, f"https://big.example/{k}", f"<body><article><p>Story {k}</p>{box if k < 50 else ''}</article></body>")
            for k in range(1100)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in main_text(pages).collect()} == {k: f"Story {k}" for k, _, _ in rows}
