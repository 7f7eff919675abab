"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

A page is parsed into blocks of text, in page order. Features of a block are its
ancestors' tags, the words in their class, id and role, and properties of its
text. The field is trained in numpy on labelled pages and decoded by Viterbi.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, type_of

# HTML's element kinds.
SILENT = frozenset("script style noscript template svg math head title textarea select option button iframe object canvas audio video datalist dialog".split())
RAW = frozenset("script style".split())
IN_HEAD = frozenset("html head title meta link base script style noscript template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements that hold paragraphs together.
REGIONS = frozenset("article aside body div footer form header main nav section table td".split())
#: An opening tag on the left ends an open element on the right.
ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
# Words in class, id and role, by what they say of a part of a page. Words of
# the first list say it wherever they stand in a name, those of the second only if the rest of
# the name is in a list too: "related-posts" is a side box, "related-science" may be a topic.
AGAINST = frozenset(
    "nav navbar navbars navigation menu menus menubar submenu topbar masthead footer sidebar sidebars aside ads advert adverts advertisement advertising adsense adslot banner promo promotion sponsor sponsored cookie cookies consent gdpr popup modal overlay newsletter login signup signin breadcrumb breadcrumbs widget widgets toolbar pagination pager copyright contentinfo complementary navbox infobar colophon lightbox offcanvas tagcloud".split()
)
AGAINST_ALONE = frozenset(
    "ad head header foot bottom top side rail notice notices alert alerts subscribe subscription register form forms search share sharing social follow related recommended recommendations recommendation more trending popular tag tags categories category legal disclaimer skip byline bio author authors meta cta sponsors teaser teasers promoted also".split()
)
COMMENTS = frozenset("comment comments commenter commenters commentary disqus respond reply replies discussion discussions commentlist commentform".split())
FOR = frozenset("article articles content contents post posts entry main story stories body text maincontent articlebody blog news prose copy".split())
#: Words that only say what kind of box a name is of.
PLAIN = frozenset(
    "list lists area areas box boxes wrap wrapper container block blocks section sections item items bar bars left right inner outer panel panels col column columns row rows links link buttons button icons icon page site global primary secondary group cell title titles label labels field fields input inputs unit units card cards feed small large mobile desktop desk info details data the at by of us in is my pre".split()
)
#: First and last words of names that say which state or layout a page or part has.
STATES = frozenset("has no not with without is are hide hides show shows enable enabled disable disabled allow allows supports js layout template theme".split())
STATE_ENDS = frozenset("open opened closed enabled disabled on off active visible hidden layout template theme ready loaded present absent none".split())
#: First words of names whose next words are the title of a tag, category or the like.
TITLED = frozenset("tag tags category categories cat topic topics type status format term author section channel series".split())
COMPOUNDS = ((AGAINST, "against"), (COMMENTS, "comments"), (AGAINST_ALONE, "alone"), (FOR, "for"))


class Place(NamedTuple):
    """What is known of a spot in the tree: features of its ancestors, and what the nearest of them speaks for."""

    features: frozenset = frozenset()
    nearest: str | None = None
    in_article: bool = False
    tag: str = ""
    #: Inside comments, a menu, an aside or a footer: an article in there is a part of it.
    apart: bool = False
    #: The element, by number, that holds the paragraphs around.
    region: int = 0


@dataclass
class Block:
    text: str
    linked: int
    place: Place
    #: The nearest silent element around the text, and whether a block element stands between.
    silence: tuple


@dataclass
class _Silent:
    """A silent element and the nearest around it; whether its own end tag has come."""

    around: _Silent | None
    closed: bool = False


class _Blocks(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        #: (tag, place, silence, where the nearest block element is) of every open element.
        self.stack: list[tuple[str, Place, tuple, int]] = [("", Place(), (None, False), 0)]
        self.silent: list[_Silent] = []
        self.open: Counter = Counter()
        self.links = self.linked = self.regions = 0
        self.parts: list[str] = []
        self.blocks: list[Block] = []

    def flush(self):
        text = " ".join("".join(self.parts).split())
        if text:
            self.blocks.append(Block(text, self.linked, *self.stack[-1][1:3]))
        self.parts, self.linked = [], 0

    def _pop(self, count):
        for tag, *_ in self.stack[len(self.stack) - count :]:
            self.open[tag] -= 1
            self.links -= tag == "a"
        del self.stack[len(self.stack) - count :]

    def _close_head(self):
        """What can't stand in a head ends it, as its end tag may be left out."""
        for k, (tag, *_) in enumerate(self.stack[1:4], 1):
            if tag == "head":
                self._pop(len(self.stack) - k)
                break

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK:
            self.flush()
        if tag in VOID:
            return
        if tag not in IN_HEAD:
            self._close_head()
        ends = ENDS.get(tag, {"p"} if tag in BLOCK else ())
        while self.stack[self.stack[-1][3]][0] in ends:
            self._pop(len(self.stack) - self.stack[-1][3])
        if tag == "option" and self.stack[-1][0] == "option":
            self._pop(1)
        names = tuple(dict.fromkeys(w for n, v in attrs if n in ("class", "id", "role") and v for w in v.split()))
        _, place, silence, block = self.stack[-1]
        if tag in BLOCK:
            silence = silence[0], True
        if tag in SILENT:
            self.flush()
            silence = _Silent(silence[0]), False
            self.silent.append(silence[0])
        place = inside(place, tag, names)
        if tag in REGIONS:
            self.regions += 1
            place = place._replace(region=self.regions)
        self.stack.append((tag, place, silence, len(self.stack) if tag in BLOCK else block))
        self.open[tag] += 1
        self.links += tag == "a"

    def handle_startendtag(self, tag, attrs):
        if tag in BLOCK:
            self.flush()

    def handle_endtag(self, tag):
        if tag in BLOCK:
            self.flush()
        for k in range(len(self.stack) - 1, 0, -1) if self.open[tag] else ():
            if self.stack[k][0] == tag:
                if tag in SILENT:
                    self.flush()
                    self.stack[k][2][0].closed = True
                self._pop(len(self.stack) - k)
                break

    def handle_data(self, data):
        if self.stack[-1][0] not in RAW:
            self.parts.append(data)
            if self.links:
                self.linked += len(data.strip())


def parse_blocks(html: str) -> list[Block]:
    """The text blocks of a page, in order; broken markup is read as far as it goes.

    What stands in a silent element is no block. One that its own end tag never
    closes counts as closed where the first block element inside it begins.
    """
    parser = _Blocks()
    parser.feed(html)
    parser.close()
    parser.flush()
    for s in parser.silent:
        s.closed = s.closed or s.around is not None and s.around.closed
    blocks = [b for b in parser.blocks if b.silence[0] is None or b.silence[1] and not b.silence[0].closed]
    if blocks and html.endswith("<") and blocks[-1].text == "<":  # a page cut off inside a tag
        blocks.pop()
    return blocks


@lru_cache(maxsize=4096)
def word_kind(word: str) -> str | None:
    """The list a word is in; one of two listed words written together, as 'leftmenu' or 'commentlist', counts as both."""
    if word in PLAIN:
        return "plain"
    for words, kind in COMPOUNDS:
        if word in words:
            return kind
    for k in range(2, len(word) - 1):
        kinds = []
        for half in (word[:k], word[k:]):
            kinds += [kind for words, kind in ((PLAIN, "plain"), *COMPOUNDS) if half in words][:1]
        if len(kinds) == 2:
            return next((kind for _, kind in COMPOUNDS if kind in kinds), "plain")
    return None


@lru_cache(maxsize=4096)
def hint(name: str) -> str | None:
    """What a class, id or role speaks for: 'against', 'comments', 'for' or nothing. States and titles say nothing."""
    parts = re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower())
    if not parts or len(parts) > 1 and (parts[0] in STATES or parts[-1] in STATE_ENDS or {"with", "has"} & set(parts[1:-1])):
        return None
    kinds = [word_kind(w) for w in parts]
    if len(parts) > 1 and parts[0] in TITLED and "plain" not in kinds[1:]:
        return None
    if "comments" in kinds:
        return "comments"
    if "against" in kinds:
        return "against"
    if "alone" in kinds and None not in kinds:
        return "against"
    return "for" if "for" in kinds else None


@lru_cache(maxsize=4096)
def _own_features(tag: str, names: tuple) -> tuple[frozenset, str | None]:
    """Features of one element, and what its class, id and role speak for. A page's body and main element say nothing against it."""
    kinds = [hint(n) for n in names]
    if tag in ("html", "body"):
        kinds = []
    elif tag == "main":
        kinds = [k if k == "for" else None for k in kinds]
    elif tag == "article" and "for" in kinds:
        kinds = [k for k in kinds if k != "against"]
    out = {f"in {tag}", *(f"name {n}" for n, k in zip(names, kinds) if k), *(f"hint {k}" for k in kinds if k)}
    return frozenset(out), next((k for k in ("comments", "against", "for") if k in kinds), None)


def inside(place: Place, tag: str, names: tuple) -> Place:
    """The place of an element that is opened at ``place``. A header of an article is a part of it; an article in comments, an aside or the like too."""
    own, hinted = _own_features("article header" if tag == "header" and place.in_article else tag, names)
    nearest = place.nearest
    if tag in ("nav", "footer", "aside", "form", "menu") or tag == "header" and not place.in_article:
        nearest = "against"
    elif tag in ("article", "main") and not place.apart:
        nearest = "for"
    apart = place.apart or hinted == "comments" or tag in ("nav", "aside", "menu") or tag == "footer" and not place.in_article
    # A class or id says more than the tag, but nothing inside comments speaks for them.
    nearest = (hinted if hinted != "for" or not place.apart else None) or nearest
    known = place.features if own <= place.features else place.features | own
    if apart and "apart" not in known:
        known = known | {"apart"}
    return Place(known, nearest, place.in_article or tag in ("article", "main"), tag, apart, place.region)


class _Page:
    """What a page's blocks are measured by: the longest, the text of each region, the whole."""

    def __init__(self, blocks: list[Block]):
        self.longest = max((len(b.text) for b in blocks), default=1)
        self.regions: Counter = Counter()
        for b in blocks:
            self.regions[b.place.region] += len(b.text) - b.linked
        self.most = max(self.regions.values(), default=1) or 1


def features(block: Block, page: _Page) -> list[str]:
    n = len(block.text)
    words = block.text.count(" ") + 1
    return [
        *block.place.features,
        f"nearest {block.place.nearest}",
        f"at {block.place.tag}",
        f"words {min(7, words.bit_length())}",
        f"linked {min(3, 4 * block.linked // max(n, 1))}",
        f"ends {block.text[-1] in '.!?…:;'}",
        f"mark {bool(re.search('[©|»›]', block.text))}",
        f"of longest {min(3, (page.longest // n).bit_length())}",
        f"of region {min(4, (page.most // max(page.regions[block.place.region], 1)).bit_length())} {block.place.nearest}",
    ]


class Field:
    """Two labels; a weight per feature for 'main text', and a score per pair of neighbours."""

    def __init__(self):
        self.weights: dict[str, float] = {}
        self.pairs = np.zeros((2, 2))

    def scores(self, blocks: list[Block]) -> list[float]:
        get = self.weights.get
        page = _Page(blocks)
        return [get("bias", 0.0) + sum(get(f, 0.0) for f in features(b, page)) for b in blocks]

    def decode(self, blocks: list[Block]) -> list[bool]:
        """The best sequence of labels (Viterbi)."""
        if not blocks:
            return []
        t00, t01, t10, t11 = self.pairs.ravel().tolist()
        back, a, b = [], 0.0, None
        for s in self.scores(blocks):
            if b is None:
                a, b = 0.0, s
                continue
            from_a, from_b = a + t00 < b + t10, a + t01 < b + t11
            back.append((from_a, from_b))
            a, b = max(a + t00, b + t10), max(a + t01, b + t11) + s
        label = b > a
        out = [label]
        for from_a, from_b in reversed(back):
            label = from_b if label else from_a
            out.append(label)
        return out[::-1]

    def train(self, pages: list[tuple[list[Block], list[bool]]], epochs: int = 8, rate: float = 0.3, shrink: float = 1e-4, seed: int = 3) -> Field:
        """Maximum likelihood by Adagrad, one page at a time."""
        index: dict[str, int] = {"bias": 0}
        coded = []
        for blocks, labels in pages:
            page = _Page(blocks)
            rows = [[0] + [index.setdefault(f, len(index)) for f in features(b, page)] for b in blocks]
            if rows:
                coded.append((rows, np.array(labels, int)))
        w, p = np.zeros(len(index)), np.zeros((2, 2))
        sw, sp = np.full(len(index), 1e-2), np.full((2, 2), 1e-2)
        rng = random.Random(seed)
        for _ in range(epochs):
            rng.shuffle(coded)
            for rows, y in coded:
                n = len(rows)
                s = np.array([w[r].sum() for r in rows])
                up, down = np.zeros((n, 2)), np.zeros((n, 2))
                up[0, 1] = s[0]
                for i in range(1, n):
                    up[i] = np.logaddexp(up[i - 1, 0] + p[0], up[i - 1, 1] + p[1])
                    up[i, 1] += s[i]
                for i in range(n - 2, -1, -1):
                    ahead = p + down[i + 1] + np.array([0, s[i + 1]])
                    down[i] = np.logaddexp(ahead[:, 0], ahead[:, 1])
                total = np.logaddexp(*up[-1])
                chance = np.exp(up[:, 1] + down[:, 1] - total)
                gw, gp = np.zeros(len(w)), np.zeros((2, 2))
                for i, r in enumerate(rows):
                    gw[r] += y[i] - chance[i]
                    if i:
                        joint = np.exp(up[i - 1][:, None] + p + down[i] + np.array([0, s[i]]) - total)
                        gp -= joint
                        gp[y[i - 1], y[i]] += 1
                gw -= shrink * w
                sw += gw * gw
                sp += gp * gp
                w += rate * gw / np.sqrt(sw)
                p += rate * gp / np.sqrt(sp)
        self.weights = {f: float(w[i]) for f, i in index.items()}
        self.pairs = p
        return self


# --- labelled pages -------------------------------------------------------------------


#: Class names that say nothing of a part, though some look as if they did.
NOISE = "post-17 type-post hentry category-news tag-flood comments-open has-sidebar no-sidebar with-sidebar has-menu no-comments is-sticky layout-sidebar-right formatted transform platform information social-studies popular-music readmore-container col-md-8 u-clearfix css-x1y2 topic-advertising category-footer status-publish".split()


def labelled_pages(count: int = 400, seed: int = 29, noise: list[str] | None = None) -> list[tuple[str, str]]:
    """(html, main text) of invented pages in many layouts, made by rule from a seed.

    Main text stands in articles, mains, sections, tables and plain divisions;
    around and inside it are menus, headers, footers, sidebars, notices, adverts,
    forms, scripts and comments, marked by tag, by class, by id or by role. Articles,
    bodies, mains and paragraphs often have classes of ``noise`` that mark nothing.
    """
    rng = random.Random(seed)
    noise = NOISE if noise is None else noise
    letters = "etaoinshrdlucmfwypvbgkéèüöñ"

    def word():
        return "".join(rng.choice(letters) for _ in range(rng.randint(2, 9)))

    def sentence(low=4, high=22):
        return " ".join(word() for _ in range(rng.randint(low, high))).capitalize() + rng.choice(["."] * 8 + ["?", "!"])

    def prose():
        return " ".join(sentence() for _ in range(rng.randint(1, 6)))

    def links(n):
        return "".join(f'<li><a href="/{word()}">{word()}</a></li>' for _ in range(n))

    def noisy(share=0.5):
        few = rng.sample(noise, rng.randint(1, min(5, len(noise)))) + [f"{word()}-{word()}"] * rng.randint(0, 1)
        return f' class="{" ".join(few)}"' if rng.random() < share else ""

    def mark(*names):
        name = rng.choice(names)
        with_noise = f'class="{" ".join([rng.choice(noise), name])}"'
        return rng.choice([f'class="{name}"', f'id="{name}"', f'class="{word()} {name}"', with_noise, f'class="site-{name}"', f'class="{name}-{rng.choice(["list", "area", "box", "wrap"])}"', f'class="{name}{rng.choice(["list", "area", "box", "wrap"])}"', f'id="left{name}"'])

    def boiler(kind):
        if kind == "nav":
            return rng.choice([f"<nav><ul>{links(6)}</ul></nav>", f'<div {mark("menu", "nav", "navbar", "navigation")}><ul>{links(5)}</ul></div>', f'<ul {mark("menu", "breadcrumb", "nav")}>{links(4)}</ul>', f'<div role="navigation">{links(4)}</div>'])
        if kind == "header":
            return rng.choice([f"<header><h1>{word()} {word()}</h1><p>{sentence()}</p></header>", f'<div {mark("header", "masthead", "topbar")}><a href="/">{word()}</a> {sentence(2, 6)}</div>', f'<div role="banner"><p>{sentence(2, 8)}</p></div>'])
        if kind == "footer":
            return rng.choice([f"<footer>&copy; {word()}.example &middot; {sentence(2, 8)}</footer>", f'<div {mark("footer", "copyright", "legal")}><p>{sentence()}</p><p>© {word()}</p></div>', f"<footer><p>{prose()}</p><ul>{links(3)}</ul></footer>"])
        if kind == "side":
            return rng.choice([f"<aside><h3>{word()}</h3><p>{prose()}</p></aside>", f'<div {mark("sidebar", "related", "widget", "trending", "recommended", "author", "bio")}><h2>{word()}</h2><ul>{links(4)}</ul><p>{sentence()}</p></div>'])
        if kind == "notice":
            return f'<div {mark("cookie", "notice", "consent", "newsletter", "popup", "alert", "banner")}><p>{prose()}</p><a href="#">{word()}</a></div>'
        if kind == "ad":
            return rng.choice([f'<div {mark("ad", "ads", "advert", "sponsored", "promo", "banner")}>{sentence()}</div>', f'<section {mark("ad", "advertisement", "sponsor")}><p>{prose()}</p></section>'])
        if kind == "form":
            return rng.choice([f'<form action="/{word()}"><label>{word()}</label><input name="q"><p>{sentence(2, 6)}</p></form>', f'<div {mark("search", "login", "signup", "subscribe")}><form><p>{sentence()}</p><input></form></div>'])
        if kind == "share":
            return f'<div {mark("share", "social", "tags", "pagination")}><a href="#">{word()}</a> <a href="#">{word()}</a></div>'
        talk = "".join(rng.choice([f'<li class="comment"><p>{prose()}</p></li>', f'<div class="comment"><b>{word()}</b><p>{prose()}</p></div>', f'<article class="comment"><p>{prose()}</p></article>', f"<article><p>{prose()}</p></article>", f"<article{noisy()}><header><b>{word()}</b></header><p>{prose()}</p><p>{prose()}</p></article>", f"<div><p>{prose()}</p></div>"]) for _ in range(rng.randint(1, 4)))
        return rng.choice([f'<div {mark("comments", "discussion", "replies", "respond")}><h3>{word()}</h3>{talk}</div>', f'<section {mark("comments", "comment")}><ul>{talk}</ul></section>'])

    pages = []
    for _ in range(count):
        inner, gold = [], []

        def say(tag, text, inner=inner, gold=gold):
            gold.append(text)
            own = noisy(0.15)
            inner.append(f"<{tag}{own}>{text}</{tag}>" if rng.random() < 0.85 or tag != "p" else f"<p{own}>{text}")

        own_header = rng.random() < 0.2
        if own_header or rng.random() < 0.8:
            say(rng.choice(["h1", "h1", "h2"]), sentence(2, 9).rstrip(".?!"))
        if own_header:
            byline = f'<p {mark("byline", "author", "meta")}>{word()} {word()}</p>' if rng.random() < 0.5 else ""
            inner[:] = [f"<header>{inner[0]}{byline}</header>"]
        for _ in range(rng.randint(1, 9)):
            roll = rng.random()
            if roll < 0.72:
                say("p", prose() if rng.random() < 0.8 else sentence(1, 4))
            elif roll < 0.79:
                say(rng.choice(["h2", "h3"]), sentence(1, 6).rstrip(".?!"))
            elif roll < 0.85:
                say(rng.choice(["blockquote", "pre"]), prose())
            elif roll < 0.9:
                items = [sentence(2, 9) for _ in range(rng.randint(2, 4))]
                gold.extend(items)
                inner.append("<ul>" + "".join(f"<li>{t}</li>" for t in items) + "</ul>")
            elif roll < 0.93:
                text = [word(), sentence(2, 6), word()]
                gold.append(" ".join([f"{text[0]} {text[1]} {text[2]}"]))
                inner.append(f'<p><b>{text[0]}</b> {text[1]} <a href="/{word()}">{text[2]}</a></p>')
            else:
                inner.append(boiler(rng.choice(["ad", "share", "side", "ad", "form"])))
        body = "".join(inner)
        late = boiler("comments") if rng.random() < 0.35 else ""
        wrap = rng.random()
        if wrap < 0.4 or own_header:
            main = f"<article{noisy()}>{body}{late if rng.random() < 0.5 else ''}</article>{late}" if late and rng.random() < 0.3 else f"<article{noisy()}>{body}</article>{late}"
        elif wrap < 0.6:
            main = f"<main{noisy()}>{body}{late}</main>"
        elif wrap < 0.85:
            main = f'<div {mark("content", "post", "entry", "story", "article", "main")}>{body}</div>{late}'
        elif wrap < 0.93:
            main = f"<section{noisy()}><div{noisy()}>{body}</div></section>{late}"
        else:
            main = f"<div{noisy()}><div>{body}</div></div>{late}"
        before = [boiler(k) for k in ("notice", "header", "nav", "ad", "form") if rng.random() < 0.5]
        after = [boiler(k) for k in ("side", "share", "ad", "nav", "footer") if rng.random() < 0.5]
        if rng.random() < 0.3:
            main = f'<div {mark("container", "wrapper", "page", "row")}>{main}{after.pop() if after else ""}</div>'
        pages.append((f"<!DOCTYPE html><html><head><title>{word()}</title><style>p{{margin:0}}</style>{rng.choice(["</head>", "</head>", ""])}<body{noisy(0.4)}><script>var a=1;</script>{''.join(before)}{main}{''.join(after)}</body></html>", " ".join(gold)))
    return pages


def block_labels(blocks: list[Block], main: str) -> list[bool]:
    """Which blocks make up the main text, found in order."""
    at, out = 0, []
    for b in blocks:
        hit = main.startswith(b.text, at) and (at + len(b.text) == len(main) or main[at + len(b.text)] == " ")
        out.append(hit)
        if hit:
            at += len(b.text) + 1
    return out


@lru_cache(maxsize=1)
def trained_field() -> Field:
    """The field trained on ``labelled_pages``; a few seconds, once per process."""
    pages = []
    for html, main in labelled_pages():
        blocks = parse_blocks(html)
        pages.append((blocks, block_labels(blocks, main)))
    return Field().train(pages)


def main_text(html: str | None, field: Field) -> str:
    blocks = parse_blocks(html or "")
    return " ".join(b.text for b, good in zip(blocks, field.decode(blocks), strict=True) if good)


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", field: Field | None = None) -> DataFrame:
    """One row per input row: (id, url, text).

    Null and empty pages, and pages without main text, have empty text. Character
    references are decoded once, white space inside a block becomes one space,
    blocks are joined by one space in page order. An article's own header, with its
    title, belongs to the article; a page's does not. A page is read whole, however
    long; end tags may be missing (``parse_blocks``). Repeated rows are treated
    alike; an empty table gives no rows; other columns are ignored, whatever their
    names.
    """
    shared = pages.sparkSession.sparkContext.broadcast(field or trained_field())

    def run(batches):
        f = shared.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([main_text(h, f) for h in batch.column(2).to_pylist()], pa.string())], names=["id", "url", "text"])

    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    return arrow_map(rows, run, f"id {type_of(pages, id_col)}, url {type_of(pages, url_col)}, text string")
