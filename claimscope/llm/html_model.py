"""The tree model of operator 1: labels of DOM nodes as a graphical model, trained from labelled pages.

Each node (block or text leaf) is content or not.  Its own evidence is a weighted sum of features; a table for each
relation (block to block, block to leaf) scores the labels of parent and child together.  Sum-product messages go up
from the leaves and down again, level by level for all pages of a batch at once, and give every node's exact
marginal.  Training climbs the exact likelihood of the labels, whose gradient the same messages give.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np

from claimscope.llm.dom import Page, parse

#: Groups of tags that share a weight.
TAG_GROUPS = {
    "page": "#page html body", "article": "article", "main": "main", "section": "section", "div": "div center details",
    "p": "p", "heading": "h1 h2 h3 h4 h5 h6 hgroup summary", "list": "ul ol dl", "item": "li dd dt", "nav": "nav menu dir",
    "header": "header", "footer": "footer address", "aside": "aside dialog", "form": "form fieldset legend label option",
    "table": "table tbody thead tfoot tr td th caption", "quote": "blockquote pre figure figcaption", "text": "#text",
}
#: Words in class, id and role attributes.  Words of up to four letters must be a whole part of a name.
HINT_GROUPS = {
    "good": "article content post entry story main body text blog prose",
    "nav": "nav navbar navigation menu breadcrumb toolbar pager pagination tabs skip toc",
    "ad": "ad ads advert adverts sponsor promo banner adsense outbrain taboola",
    "side": "sidebar side aside widget related recommend trending popular rail complementary",
    "foot": "footer foot copyright legal colophon contentinfo",
    "head": "header head masthead topbar branding logo tagline",
    "notice": "cookie consent gdpr notice alert popup modal overlay disclaimer paywall newsletter subscribe signup",
    "comment": "comment disqus reply replies discussion respond feedback review reader",
    "social": "social share sharing follow tweet facebook",
    "form": "form login search register contact poll survey",
}
NUMERIC = ["bias", "size", "linked", "stops", "short", "late", "rights", "ends", "share", "title", "paragraphs", "named", "stated"]
_GROUP_OF = {t: i for i, g in enumerate(TAG_GROUPS.values()) for t in g.split()}
_HINTS = [g.split() for g in HINT_GROUPS.values()]
_RIGHTS = re.compile("©|copyright|all rights reserved", re.I)
N_FIXED = len(TAG_GROUPS) + 1 + len(HINT_GROUPS)
N_FEATURES = N_FIXED + len(NUMERIC)
ROUNDS, RATE, DECAY = 200, 0.08, 1e-4


@dataclass(frozen=True)
class TreeModel:
    weights: np.ndarray
    pair: np.ndarray  # relation x parent's label x child's label


@dataclass
class Forest:
    """Nodes of several pages."""

    features: np.ndarray
    parent: np.ndarray
    relation: np.ndarray  # 0: block under block, 1: leaf under block
    levels: list[np.ndarray]  # nodes by depth
    first: np.ndarray  # first node of each page


_NAMES: dict[tuple[str, str], np.ndarray] = {}


def name_features(tag: str, hints: str) -> np.ndarray:
    got = _NAMES.get((tag, hints))
    if got is None:
        got = np.zeros(N_FIXED, np.float32)
        got[_GROUP_OF.get(tag, len(TAG_GROUPS))] = 1
        names = re.split("[^a-z]+", hints)
        for i, group in enumerate(_HINTS):
            got[len(TAG_GROUPS) + 1 + i] = any(n == w or len(w) > 4 and w in n for n in names for w in group)
        if len(_NAMES) > 50_000:
            _NAMES.clear()
        _NAMES[tag, hints] = got
    return got


def forest(pages: list[Page]) -> Forest:
    sizes = [len(p.parent) for p in pages]
    first = np.zeros(len(pages) + 1, np.int64)
    np.cumsum(sizes, out=first[1:])
    parent = np.concatenate([np.array(p.parent, np.int64) + f for p, f in zip(pages, first, strict=False)])
    parent[first[:-1]] = -1
    n = len(parent)
    depth = np.concatenate([np.array(p.depth, np.int64) for p in pages])
    by_depth = np.argsort(depth, kind="stable")
    levels = np.split(by_depth, np.flatnonzero(np.diff(depth[by_depth])) + 1)
    text = [t for p in pages for t in p.text]
    length = np.array([len(t) for t in text], float)
    linked = np.array([x for p in pages for x in p.linked], float)
    stops = np.array([t.count(".") + t.count(",") + t.count("!") + t.count("?") + t.count(";") for t in text], float)
    rights = np.array([bool(_RIGHTS.search(t)) for t in text], float)
    ends = np.array([t[-1:] in ".!?…\"”»" if t else False for t in text], float)
    is_leaf = length > 0
    before = np.cumsum(length) - length
    total = np.add.reduceat(length, first[:-1]) if n else np.zeros(0)
    page = np.repeat(np.arange(len(pages)), sizes)
    late = (before - before[first[:-1]][page]) / np.maximum(total[page], 1)
    tags = [t for p in pages for t in p.tag]
    title = np.array([t == "h1" for t in tags], float)
    paragraphs = np.array([t == "p" for t in tags], float)
    for level in levels[:0:-1]:
        for x in (length, linked, stops, rights, title, paragraphs):
            np.add.at(x, parent[level], x[level])
    f = np.zeros((n, N_FEATURES))
    f[:, :N_FIXED] = np.stack([name_features(t, h) for p in pages for t, h in zip(p.tag, p.hints, strict=True)])
    some = np.maximum(length, 1)
    named = f[:, len(TAG_GROUPS) + 2 : N_FIXED].any(axis=1)
    stated = np.array([t in ("article", "main") for t in tags]) & ~named
    extra = (length / np.maximum(total[page], 1), np.minimum(title, 1), np.minimum(paragraphs, 8) / 4, named, stated)
    f[:, N_FIXED:] = np.stack([np.ones(n), np.log1p(length) / 6, linked / some, np.minimum(stops / some * 20, 2), (length < 30), late, np.minimum(rights, 1) * (length < 400), ends, *extra], axis=1)
    return Forest(f, parent, is_leaf.astype(np.int64), levels, first)


def _either(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """log(exp(a) + exp(b))"""
    return np.maximum(a, b) + np.log1p(np.exp(-np.abs(a - b)))


def messages(x: Forest, m: TreeModel) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Log beliefs of all nodes (two labels each), and of each level the pair log beliefs of parents and children."""
    own = np.zeros((len(x.parent), 2))
    own[:, 1] = x.features @ m.weights
    up, sent, down = own.copy(), np.zeros_like(own), np.zeros_like(own)
    for level in x.levels[:0:-1]:
        pair, u = m.pair[x.relation[level]], up[level]
        for y in (0, 1):  # the parent's label
            sent[level, y] = _either(pair[:, y, 0] + u[:, 0], pair[:, y, 1] + u[:, 1])
            np.add.at(up[:, y], x.parent[level], sent[level, y])
    pairs = []
    for level in x.levels[1:]:
        p = x.parent[level]
        without = up[p] + down[p] - sent[level]
        both = m.pair[x.relation[level]] + without[:, :, None]
        down[level] = _either(both[:, 0], both[:, 1])
        pairs.append((level, both + up[level][:, None, :]))
    return up + down, pairs


def marginals(x: Forest, m: TreeModel) -> np.ndarray:
    """Probability that each node is content."""
    b, _ = messages(x, m)
    return 1 / (1 + np.exp(np.clip(b[:, 0] - b[:, 1], -500, 500)))


def truths(pages: list[Page], x: Forest) -> np.ndarray:
    """Labels of all nodes of labelled pages: that of the nearest marked block; an unmarked block above the marked
    ones is content if most of its text is."""
    marked = np.concatenate([np.array(p.truth) for p in pages])
    y = marked.copy()
    for level in x.levels[1:]:
        y[level] = np.where(marked[level] >= 0, marked[level], y[x.parent[level]])
    length = np.array([len(t) for p in pages for t in p.text], float)
    good = length * (y == 1)
    for level in x.levels[:0:-1]:
        np.add.at(length, x.parent[level], length[level])
        np.add.at(good, x.parent[level], good[level])
    return np.where(y >= 0, y, (good > length / 2) & (x.relation == 0)).astype(np.int64)


def fit(pages: list[Page], rounds: int = ROUNDS) -> TreeModel:
    x = forest(pages)
    y = truths(pages, x)
    theta = np.zeros(N_FEATURES + 8)
    mean, spread = np.zeros_like(theta), np.zeros_like(theta)
    seen = np.zeros((2, 2, 2))
    for level in x.levels[1:]:
        np.add.at(seen, (x.relation[level], y[x.parent[level]], y[level]), 1)
    for k in range(1, rounds + 1):
        model = TreeModel(theta[:N_FEATURES], theta[N_FEATURES:].reshape(2, 2, 2))
        beliefs, pairs = messages(x, model)
        p = 1 / (1 + np.exp(np.clip(beliefs[:, 0] - beliefs[:, 1], -500, 500)))
        expected = np.zeros((2, 2, 2))
        for level, b in pairs:
            q = np.exp(b - b.max(axis=(1, 2), keepdims=True))
            q /= q.sum(axis=(1, 2), keepdims=True)
            for r in (0, 1):
                expected[r] += q[x.relation[level] == r].sum(axis=0)
        slope = np.concatenate([x.features.T @ (y - p), (seen - expected).ravel()]) / len(y) - DECAY * theta
        mean, spread = 0.9 * mean + 0.1 * slope, 0.999 * spread + 0.001 * slope**2
        theta = theta + RATE * (mean / (1 - 0.9**k)) / (np.sqrt(spread / (1 - 0.999**k)) + 1e-8)
    return TreeModel(theta[:N_FEATURES], theta[N_FEATURES:].reshape(2, 2, 2))


# Labelled pages -----------------------------------------------------------------------------------------------

_SYLLABLES = "ba ce di fo gu la me ni po ru sa te vi xo zu an er in on ul".split()


def made_page(rng: np.random.Generator) -> str:
    """A page of a random layout; ``data-content`` marks the article (1) and whatever is not part of it (0)."""
    pick = lambda *a: a[int(rng.integers(len(a)))]
    chance = lambda p: rng.random() < p
    word = lambda: "".join(pick(*_SYLLABLES) for _ in range(int(rng.integers(1, 5))))
    words = lambda a, b: " ".join(word() for _ in range(int(rng.integers(a, b))))
    sentence = lambda: words(4, 18).capitalize() + pick(".", ".", ".", "!", "?")
    para = lambda a=1, b=7: " ".join(sentence() for _ in range(int(rng.integers(a, b))))
    links = lambda a, b: "".join(f'<li><a href="/{word()}">{words(1, 5)}</a></li>' for _ in range(int(rng.integers(a, b))))

    def inline(text: str) -> str:
        if chance(0.3):
            parts = text.split(" ")
            i = int(rng.integers(len(parts)))
            parts[i] = pick('<a href="/x">{}</a>', "<b>{}</b>", "<em>{}</em>", "<span>{}</span>").format(parts[i])
            return " ".join(parts)
        return text

    def block(kind: str, inner: str, *tags: str, none: float = 0.1) -> str:
        """A block that is no part of the article, told by its tag, by a name, or at times by neither."""
        tag = pick("div", "div", "section", *tags, *tags)
        hint = pick(*HINT_GROUPS[kind].split())
        shape = pick("{}", "{}", "{}", "site-{}", "{}-box", "page-{}", "{} clearfix", "{}-area", "js-{}")
        named = "" if tag in tags and chance(0.5) or chance(none) else f' {pick("class", "class", "id")}="{shape.format(hint)}"'
        return f'<{tag}{named} data-content="0">{inner}</{tag}>'

    nav = lambda: block("nav", pick("<ul>{}</ul>", "<div><ul>{}</ul></div>").format(links(3, 9)), "nav")
    head = lambda: block("head", pick(f"<h2>{words(1, 4)}</h2>", f"<p>{sentence()}</p>", f"<div>{words(1, 3)}</div>{nav()}", words(1, 4)), "header")
    foot = lambda: block("foot", pick("", f"<ul>{links(2, 6)}</ul>") + pick(f"&copy; {words(1, 4)} &middot; {sentence()}", f"<p>Copyright {words(2, 6)}</p>", f"<p>{para(1, 3)}</p><p>&copy; {words(1, 3)}</p>"), "footer")
    advert = lambda: block("ad", pick(sentence(), f"<p>{para(1, 3)}</p>", f'<a href="/x">{words(2, 8)}</a>', f"<h4>{words(2, 4)}</h4><p>{sentence()}</p>"), none=0)
    notice = lambda: block("notice", pick(f"<p>{para(1, 4)}</p>", f"{sentence()} <a href='/x'>{words(1, 3)}</a>", para(1, 3)), none=0)
    side = lambda: block("side", f"<h3>{words(1, 4)}</h3>" + pick(f"<ul>{links(3, 8)}</ul>", f"<p>{para(1, 4)}</p>", f"<ul>{links(2, 5)}</ul><p>{para(1, 3)}</p>"), "aside")
    share = lambda: block("social", pick(f"<ul>{links(2, 5)}</ul>", words(1, 5)), none=0)
    form = lambda: pick(block("form", f"<form><label>{words(1, 3)}</label><input name=q><p>{sentence()}</p></form>"), f'<form data-content="0"><p>{para(1, 3)}</p><label>{words(1, 2)}</label><input></form>')

    def comments() -> str:
        item = lambda: pick("<div class='{0}'>{1}</div>", "<li>{1}</li>", "<div class='{0}'>{1}</div>", "<article class='{0}'>{1}</article>", "<div>{1}</div>").format(pick("comment", "comment-body", "reply"), f"<{pick('b', 'h5', 'p')}>{words(1, 3)}</{pick('b', 'h5', 'p')}><p>{para()}</p>")
        return block("comment", pick("", f"<h3>{words(1, 3)}</h3>") + "".join(item() for _ in range(int(rng.integers(1, 6)))), none=0)

    body = [f"<h1>{words(3, 12)}{pick('', '.')}</h1>"] if chance(0.85) else []
    for _ in range(int(rng.integers(1, 9))):
        body.append(
            pick(
                *[f"<p>{inline(para())}</p>"] * 6,
                f"<p>{words(1, 4)}</p>",
                f"<p>{pick('', '&copy; ', 'Copyright ')}{words(1, 4)}{pick('. All rights reserved.', '.')}</p>",
                f"<p>{pick('All rights reserved.', 'Copyright notice.')}</p>",
                f"<h2>{words(2, 8)}</h2>",
                f"<ul>{''.join(f'<li>{sentence()}</li>' for _ in range(3))}</ul>",
                f"<blockquote><p>{para()}</p></blockquote>",
                f"<pre>{words(5, 30)}</pre>",
                f"<table><tr><td>{words(1, 4)}</td><td>{words(1, 4)}</td></tr></table>",
                f"<div>{para()}</div>",
                f'<p><a href="/x">{words(2, 9)}</a></p>',
                f'<p>{words(0, 3)} <a href="/x">{sentence()}</a> <a href="/y">{words(1, 5)}</a></p>',
                *[f"<{(kind := pick('ul', 'ol'))}>{links(1, 7)}</{kind}>"] * 2,
                f"<details><summary>{words(1, 6)}</summary><p>{para(1, 4)}</p></details>",
                f"<p><b>{para()}<br><p>{para()}",
            )
        )
    extras = [x() for x, p in ((advert, 0.2), (share, 0.15), (side, 0.1), (notice, 0.1), (form, 0.08), (nav, 0.05)) if chance(p)]
    for extra in extras:
        body.insert(int(rng.integers(len(body) + 1)), extra)
    if chance(0.15):
        body.append(comments())
    kind = pick("article", "article", "main", "named", "named", "plain", "section")
    open_tag = {"article": "article", "main": "main", "plain": "div", "section": "section"}.get(kind)
    inner = "".join(body)
    if kind == "named":
        inner = f'<div {pick("class", "id")}="{pick("{}", "post-{}", "{}-wrap", "the-{}").format(pick(*HINT_GROUPS["good"].split()))}" data-content="1">{inner}</div>'
    else:
        named = f' class="{pick(*HINT_GROUPS["good"].split())}"' if chance(0.3) else ""
        inner = f'<{open_tag}{named} data-content="1">{inner}</{open_tag}>'
    before = [x() for x, p in ((nav, 0.7), (head, 0.6), (notice, 0.25), (advert, 0.4), (side, 0.2), (form, 0.15)) if chance(p)]
    after = [x() for x, p in ((side, 0.4), (advert, 0.25), (share, 0.25), (comments, 0.4), (form, 0.15), (notice, 0.15), (nav, 0.2)) if chance(p)]
    rng.shuffle(before)
    rng.shuffle(after)
    for _ in range(int(rng.integers(0, 3))):
        if chance(0.5):
            take = after[: int(rng.integers(len(after) + 1))]
            inner, after = inner + "".join(take), after[len(take) :]
        inner = f"<div{pick('', ' class=wrapper', ' id=container', ' class=row')}>{inner}</div>"
    tail = foot() if chance(0.85) else ""
    return f"<html><head><title>{words(2, 6)}</title></head><body>{''.join(before)}{inner}{''.join(after)}{tail}</body></html>"


_SEMANTIC = re.compile(r"<(/?)(article|main|nav|aside|header|footer|section)(?=[\s>])", re.I)
OUTSIDE = frozenset("nav aside header footer form menu dialog".split())


def self_labelled(html: str, mask: bool) -> Page | None:
    """A page that states its article by markup: one ``article`` or else one ``main`` block.  With ``mask`` the model
    is not shown these tags, but plain ``div``, so that it learns from the rest."""
    page = parse(html)
    for want in ("article", "main"):
        at = [i for i, t in enumerate(page.tag) if t == want]
        if len(at) == 1:
            break
    else:
        return None
    inside = [0] * len(page.tag)
    for i, t in enumerate(page.tag):
        if i:
            p = page.parent[i]
            inside[i] = 1 if i == at[0] else int(inside[p] and t not in OUTSIDE)
        named = name_features(t, page.hints[i])[len(TAG_GROUPS) + 2 :].any() and t != want
        if inside[i] and named:
            inside[i] = 0
        if t in OUTSIDE or i == at[0] or t == "#text" or named:
            page.truth[i] = inside[i]
    if mask:
        page.tag = ["div" if t in OUTSIDE | {"article", "main", "section"} else t for t in page.tag]
    return page


def training_pages(sample: list[str], made: int, seed: int = 1) -> list[Page]:
    """Generated pages, and those of the sample that label themselves; every second one is masked."""
    rng = np.random.default_rng(seed)
    own = [q for i, h in enumerate(sample) if (q := self_labelled(h, bool(i % 2))) is not None]
    return [parse(made_page(rng)) for _ in range(made)] + own
