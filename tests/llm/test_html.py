"""Pages with the class names of real sites: what looks like a hint and is none, and comments that look like articles."""

from collections import Counter

import pytest

from quillmere.llm import html_text

PROSE = "The body of it, which is long enough to be prose, and it goes on for a while."
SAID = "I do not agree with this at all, as a reader I would say something else entirely."

#: Names that say nothing, apart from those that the training pages use.
OTHER_NOISE = "entry-2024 single-format-standard hfeed tag-rivers category-sports comments-closed sidebar-none no-footer with-footer has-banner js-ready is-premium layout-with-sidebar unformatted reformation informational uniform adapter header-less antisocial-behaviour related-science popularity sharepoint moreland wp-block-group lg:w-2/3 sc-bdVaJa cat-menus topic-comments".split()


def whole(inner):
    return f"<html><head><title>t</title></head><body><nav><ul><li><a href=x>a</a></ul></nav>{inner}<footer>© y</footer></body></html>"


@pytest.mark.parametrize(
    "inner",
    [
        f'<article class="post-12 post type-post hentry category-news tag-flood comments-open"><p>{PROSE}</p></article>',
        f'<article class="post tag-news category-local"><p>{PROSE}</p></article>',
        f'<main class="with-sidebar"><p>{PROSE}</p></main>',
        f'<body class="has-sidebar"><div><p>{PROSE}</p></div>',
        *[f'<{tag} class="{name}"><p>{PROSE}</p></{tag}>' for tag in ("div", "article", "section") for name in ("formatted-text", "platform", "social-issues", "popular-science", "no-comments", "read-more-content")],
        f'<article><p>{PROSE}</p></article><section id="comments"><article><p>{SAID}</p></article></section>',
        f'<article><p>{PROSE}</p></article><div class="comments"><article><p>{SAID}</p></article></div>',
        f'<article><p>{PROSE}</p></article><div class="comments"><article class="post"><header><b>me</b></header><p>{SAID}</p></article></div>',
        f'<article><p>{PROSE}</p><section id="comments"><article><p>{SAID}</p></article></section></article>',
        f'<div class="sidebar-left"><p>{SAID}</p></div><article><p>{PROSE}</p></article>',
        f'<div class="site-navigation"><p>{SAID}</p></div><div class="cookie-bar">{SAID}</div><article><p>{PROSE}</p></article><div class="related-posts"><p>{SAID}</p></div>',
    ],
)
def test_class_names_of_real_sites(inner):
    for page in (inner, whole(inner)):
        assert html_text.main_text(page, html_text.trained_field()) == PROSE


@pytest.mark.parametrize(
    "name,kind",
    [
        ("navbar", "against"),
        ("leftmenu", "against"),
        ("site-footer", "against"),
        ("commentlist", "comments"),
        ("commentFormArea", "comments"),
        ("related-posts", "against"),
        ("share-buttons", "against"),
        ("content-wrapper", "for"),
        ("formatted", None),
        ("platform", None),
        ("has-sidebar", None),
        ("comments-open", None),
        ("tag-menu", None),
        ("tag-list", "against"),
        ("popular-science", None),
        ("", None),
        ("123", None),
    ],
)
def test_hints(name, kind):
    assert html_text.hint(name) == kind


def token_f1(got, want):
    a, b = Counter(got.split()), Counter(want.split())
    return 2 * sum((a & b).values()) / max(1, sum(a.values()) + sum(b.values())) if a or b else 1.0


@pytest.mark.parametrize("seed,noise", [(1234, None), (77, OTHER_NOISE), (78, OTHER_NOISE)])
def test_fresh_pages_with_unknown_class_names(seed, noise):
    pages = html_text.labelled_pages(300, seed=seed, noise=noise)
    scores = [token_f1(html_text.main_text(html, html_text.trained_field()), main) for html, main in pages]
    assert sum(scores) / len(scores) >= 0.98
