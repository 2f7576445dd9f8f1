"""Pages that a list of names alone, or a path as long as its depth, gets wrong."""

from __future__ import annotations

import time

import pytest

from kpiloom.llm import html_extract

P = [f"Paragraph {i} tells something, at some length, of what it was about; and so it goes on, word by word, to its end." for i in range(6)]
BODY = "".join(f"<p>{p}</p>" for p in P)
NAV = '<div class="menu"><ul><li><a href=a>Home</a><li><a href=b>News</a></ul></div>'
NOTES = '<div class="comments">' + "".join(f"<p>Reader {i} says, well, this is a rather long remark, and no part of it at all.</p>" for i in range(9)) + "</div>"


def lines(page):
    return html_extract.main_text(page).split("\n\n")


@pytest.mark.parametrize(
    "page",
    [
        f"<body>{NAV}<div class='post'>{BODY}</div>{NOTES}</body>",
        f"<body>{NAV}<div class='post tag-social'>{BODY}</div></body>",
        f"<body>{NAV}<div class='post tag-social'>{BODY}{NOTES}</div><p>Short tail</p></body>",
        f"<body>{NAV}<section id='share-2024'><div class='entry reply-allowed'>{BODY}</div></section><div>(c)</div></body>",
        f"<body class='has-sidebar'><main>{NAV}<article class='promo'>{BODY}<div class='widget'>Buy, now, this.</div></article></main></body>",
    ],
)
def test_names_decide_only_where_the_ratios_agree(page):
    found = lines(page)
    assert [x for x in found if x in P] == P
    assert not [x for x in found if x.startswith(("Reader", "Home", "Buy"))]


def test_headers_by_place():
    page = f"<body><header><h1>Site</h1></header><article><header><h1>Title of it</h1></header>{BODY}<footer>x</footer></article></body>"
    assert lines(page) == ["Title of it", *P]


def test_formulas_and_links_inside_the_text_stay():
    formula = "<p>It holds that <math><mi>a</mi><mo>=</mo><mn>2</mn><annotation encoding=tex>a=2</annotation></math> here, as was said.</p>"
    linked = "<p>See <a href=x>this very long account of the matter, and of others too</a>.</p>"
    menu = "<ul><li><a href=a>One more page to read</a></li><li><a href=b>Another one of those</a></li></ul>"
    found = lines(f"<body><article>{BODY}{formula}{linked}{menu}</article></body>")
    assert found[len(P) :] == [
        "It holds that a=2 here, as was said.",
        "See this very long account of the matter, and of others too.",
    ]


@pytest.mark.parametrize("unit", ["<div>", "<div>a", "<div class=ad>a", "<p>x", "<ul><li>a<b>", "<div class=x1><span hidden>b"])
def test_deep_and_long_pages_take_time_by_their_length(unit):
    def took(size):
        page = unit * (size // len(unit))
        begin = time.process_time()
        html_extract.main_text(page)
        return time.process_time() - begin

    took(10_000)
    small, large = took(60_000), took(600_000)
    assert large < 40 * small + 0.5  # ten times the page; by the depth it would be a hundred


def test_paths_share_what_their_labels_share():
    paths = html_extract.Paths()
    chain = [0]
    for i in range(300):
        chain.append(paths.child(chain[-1], f"d{i % 7}"))
    other = chain[120]
    for i in range(40):
        other = paths.child(other, f"e{i}")
    assert paths.child(chain[4], "d4") == chain[5]  # equal labels, one node
    assert paths.shared(other, chain[300]) == chain[120] and paths.shared(chain[7], chain[250]) == chain[7]
    assert paths.likeness(other, chain[300]) == 120 / 300 and paths.likeness(other, other) == 1
    under = paths.below(chain[121])
    assert under[chain[300]] and not under[other] and not under[0]
