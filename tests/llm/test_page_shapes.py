"""Page shapes whose headline or sections are easily lost, and parts that must go."""

import pytest

from leafmill.llm import html

TEXT = "<p>The river rose in the night, and by morning the lower fields were under water; nobody had expected it so soon.</p>" * 4
LINE = "The river rose in the night, and by morning the lower fields were under water; nobody had expected it so soon."
MENU = "<nav><ul><li><a href=/>Home</a></li><li><a href=/a>About</a></li></ul></nav>"


def lines(page):
    return html.main_text(page).split("\n")


@pytest.mark.parametrize(
    "page",
    [
        f"<body>{MENU}<div id=content><h1>Floods</h1><div class=post-body>{TEXT}</div></div><footer>f</footer></body>",
        f"<body><div class=header><a href=/>Site</a></div><h1>Floods</h1><div class=text>{TEXT}</div></body>",
        f"<body>{MENU}<div><div><h1>Floods</h1></div><div class=post-body>{TEXT}</div></div></body>",
    ],
)
def test_headline_next_to_the_body(page):
    got = lines(page)
    assert got.count(LINE) == 4 and got[-1] == LINE
    assert got[0] == "Floods" or "<div><h1>" in page  # a headline in a box of its own is not on the path


def test_other_headings_stay_out():
    page = f"<body><h1>Site</h1><h1>Other</h1><div><div class=side><h3>Links</h3><a href=/a>x</a></div><div class=post-body>{TEXT}</div></div></body>"
    assert lines(page) == [LINE] * 4


@pytest.mark.parametrize("name", ["share-economy", "notice-period", "searchLight", "sponsor-history", "related-work"])
def test_sections_with_compound_names_stay(name):
    page = f"<body><article><h1>Floods</h1>{TEXT}<section class='{name}'>{TEXT}</section></article></body>"
    assert lines(page) == ["Floods", *[LINE] * 8]


@pytest.mark.parametrize("name", ["share-buttons", "comments", "comment-list", "related-posts widget", "adContainer", "newsletter-signup box", "social-links top"])
def test_marked_parts_in_articles_go(name):
    page = f"<body><article><h1>Floods</h1>{TEXT}<div class='{name}'>{TEXT}</div></article></body>"
    assert lines(page) == ["Floods", *[LINE] * 4]


def test_long_pages_come_in_parts(spark, monkeypatch):
    rows = [(i, "u", f"<body><article>{TEXT * (i % 3)}</article></body>") for i in range(20)] + [(None, None, None)]
    monkeypatch.setattr(html, "CHARS", 900)
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((r["page_id"], r["n_chars"]) for r in got if r["page_id"] is not None) == [(i, max(0, 4 * (i % 3) * (len(LINE) + 1) - 1)) for i in range(20)]
