"""Main text of web pages: boosted trees over DOM nodes, decoded from the root so that labels never contradict.

A node is an element of block level or a run of inline text below one. The trees give each node's odds of holding main
text, from its text, place, siblings and ancestors, and from the tokens of its class, id and role: these are hashed, and
a bucket's odds are learned from training nodes. Decoding picks the likeliest labelling of the whole tree in which a node
has main text only if its parent has; runs of text that end up with it are the blocks of the result. The trees learn, in
one task, from a bounded sample of pages, labelled by their semantic elements where these leave no doubt, and from pages
composed of that sample's paragraphs and furniture of known kind.
"""

from __future__ import annotations

import html as entities
import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Trees, fit_trees
from .shingles import chunks, text_buffers

#: Pages that training reads at most, and bytes of one that it may read; pages it composes.
SAMPLE_PAGES, SAMPLE_BYTES, COMPOSED_PAGES, SEED = 200, 1 << 18, 700, 5
#: Bytes of html whose nodes are handled at once, or one page.
SPAN = 1 << 19
#: Buckets of attribute tokens; training nodes that a bucket's odds need; added to its counts.
TOKENS, LEAST_NODES, PRIOR = 1 << 12, 4, 1.0

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s>/]*)[^>]*(?:>|\Z)"
    r"|<([a-zA-Z][^\s>/]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<([a-zA-Z][^\s>/]*)([^>]*)(?:>|\Z)",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"(?:class|id|role|data-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
# Element kinds of HTML: fixed values.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark output picture q rp rt ruby s samp slot small span strike strong sub sup time tt u var wbr "
    "math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mtable mtr mtd semantics mstyle mspace".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template svg iframe object canvas audio video title textarea select option datalist head button annotation annotation-xml".split())
RAW = frozenset("script style textarea title iframe noscript template".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
BARRIER = frozenset("table td th ul ol div section article aside main nav header footer form blockquote body html".split())
TAGS = ("#text", "p", "h1", "h2", "h3", "div", "section", "li", "ul", "ol", "table", "td", "blockquote", "pre", "nav", "footer", "header", "aside", "form", "article", "main", "body", "figure", "dl")
BESIDES = frozenset("nav footer aside form".split())
LABELS = ("label0", "label1")


@dataclass
class Page:
    """Nodes in page order; a node's parent comes before it. Texts belong to nodes of the kind #text."""

    tags: list[str] = field(default_factory=lambda: ["html"])
    parents: list[int] = field(default_factory=lambda: [-1])
    words: list[tuple[str, ...]] = field(default_factory=lambda: [()])
    texts: list[str] = field(default_factory=lambda: [""])
    linked: list[int] = field(default_factory=lambda: [0])
    inline: list[int] = field(default_factory=lambda: [0])


def parse_page(source: str) -> Page:
    """The block-level tree of a page. Anything is accepted: unclosed, crossed and cut-off tags end where they must.

    Elements without text of their own (scripts, controls, pictures) don't end the block that they stand in. Work grows
    with the page: an end tag without a start, or a start without an end, is looked for once.
    """
    page, stack = Page(), [0]
    run: list[str] = []
    open_tags: Counter[str] = Counter()
    endless: set[str] = set()  # tags of which no end is ahead
    links, in_link, n_inline, at, end = 0, 0, 0, 0, len(source)

    def node(tag: str, words: tuple[str, ...] = (), text: str = "", linked: int = 0, inline: int = 0) -> int:
        page.tags.append(tag)
        page.parents.append(stack[-1])
        page.words.append(words)
        page.texts.append(text)
        page.linked.append(linked)
        page.inline.append(inline)
        return len(page.tags) - 1

    def flush() -> None:
        nonlocal links, n_inline
        if run:
            text = " ".join("".join(run).split())
            if text:
                node("#text", (), text, min(links, len(text)), n_inline)
            run.clear()
        links = n_inline = 0

    def add(raw: str) -> None:
        nonlocal links
        text = entities.unescape(raw) if "&" in raw else raw
        run.append(text)
        if in_link:
            links += len(text.strip())

    def shut(names: set[str] | frozenset[str], barrier: frozenset[str]) -> bool:
        """Close the nearest open element of these names, if no barrier is nearer."""
        if not any(open_tags[x] for x in names):
            return False
        for k in range(len(stack) - 1, 0, -1):
            name = page.tags[stack[k]]
            if name in names:
                flush()
                open_tags.subtract(page.tags[i] for i in stack[k:])
                del stack[k:]
                return True
            if name in barrier:
                return False
        return False

    while at < end:
        m = TOKEN.search(source, at)
        if m is None:
            add(source[at:])
            break
        if m.start() > at:
            add(source[at : m.start()])
        at = m.end()
        close, tag = m[1], m[2] or m[4]
        if close:
            close = close.lower()
            if close in INLINE:
                if close == "a":
                    in_link = 0
            elif shut({close}, frozenset()):
                in_link = 0
            continue
        if not tag:
            continue
        tag = tag.lower()
        if tag in INLINE:
            n_inline += 1
            if tag == "br":
                run.append(" ")
            elif tag == "a":
                in_link = 1
            continue
        if tag in SILENT:
            if (m[3] or m[5] or "").rstrip().endswith("/") and tag not in RAW:
                continue
            stop = None if tag in endless else re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.IGNORECASE).search(source, at)
            if stop:
                at = stop.end()
            elif tag in RAW:
                at = end
            else:
                endless.add(tag)
            continue
        if tag in VOID and tag != "hr":
            continue
        flush()
        if tag in ("hr", "html"):
            continue
        in_link = 0
        names = CLOSES.get(tag, frozenset()) | ({"p"} if tag in ENDS_P else frozenset())
        if names:
            shut(names, BARRIER)
        attributes = m[3] or m[5] or ""
        words = tuple(w for a in ATTRIBUTE.findall(attributes) for w in re.split(r"[\s_\-]+", "".join(a).lower()) if w) if attributes and not attributes.isspace() else ()
        stack.append(node(tag, words))
        open_tags[tag] += 1
    flush()
    return page


def _buckets(words: tuple[str, ...]) -> list[int]:
    return [zlib.crc32(w.encode()) % TOKENS for w in words if w not in LABELS]


def token_odds(pages: list[Page], labels: list[np.ndarray]) -> np.ndarray:
    """For each bucket of attribute tokens the smoothed log odds that its nodes hold main text; 0 where few are known."""
    n = np.zeros((2, TOKENS))
    for page, y in zip(pages, labels, strict=True):
        for words, label in zip(page.words, y.tolist(), strict=True):
            if label >= 0:
                for b in set(_buckets(words)):
                    n[label, b] += 1
    return np.where(n.sum(0) >= LEAST_NODES, np.log((n[1] + PRIOR) / (n[0] + PRIOR)), 0.0)


def _forest(pages: list[Page]) -> tuple[Page, np.ndarray]:
    """All pages' nodes in one, and each node's root."""
    forest, roots = Page([], [], [], [], [], []), []
    for page in pages:
        at = len(forest.tags)
        roots += [at] * len(page.tags)
        forest.parents += [k + at if k >= 0 else -1 for k in page.parents]
        for name in ("tags", "words", "texts", "linked", "inline"):
            getattr(forest, name).extend(getattr(page, name))
    return forest, np.array(roots, np.int64)


def node_features(pages: list[Page], odds: np.ndarray) -> np.ndarray:
    """A row for each node of the pages: own and subtree text, density, links, depth, attribute tokens, siblings, place."""
    page, root = _forest(pages)
    n = len(page.tags)
    parent = np.array(page.parents)
    is_text = np.array([t == "#text" for t in page.tags])
    own = np.array([len(t) for t in page.texts], float)
    stops = np.array([t.count(".") + t.count(",") + t.count("?") + t.count("!") if t else 0 for t in page.texts], float)
    words = np.array([t.count(" ") + 1 if t else 0 for t in page.texts], float)
    signs = np.array([t.count("\u00a9") if t else 0 for t in page.texts], float)
    sums = np.stack([own, np.array(page.linked, float), stops, words, is_text.astype(float), (~is_text).astype(float), np.array(page.inline, float), signs], 1)
    leaf = sums.copy()
    kind = {t: k for k, t in enumerate(TAGS)}
    tokens = [[odds[b] for b in _buckets(ws)] for ws in page.words]
    low, high = (np.array([f(x, default=0.0) for x in tokens]) for f in (min, max))
    depth, index, last = [0] * n, [0] * n, [0] * n
    least, most, inside = low.tolist(), high.tolist(), [0] * n  # over a node and its ancestors
    alike: Counter[tuple] = Counter()
    named = np.array([len(x) > 0 for x in tokens], float)
    for i, p in enumerate(page.parents):
        if p < 0:
            continue
        depth[i] = depth[p] + 1
        index[i] = last[p]
        last[p] += 1
        least[i], most[i] = min(least[i], least[p]), max(most[i], most[p])
        tag = page.tags[i]
        inside[i] = 1 if tag in ("article", "main") else -1 if tag in BESIDES else inside[p]
        alike[p, tag, page.words[i]] += 1
    if n > 1:
        depths = np.array(depth)
        for d in range(int(depths.max()), 0, -1):
            at = np.flatnonzero(depths == d)
            np.add.at(sums, parent[at], sums[at])
    code = np.array([kind.get(t, len(TAGS)) for t in page.tags])
    up = np.where(parent >= 0, parent, root)
    grand = up[up]
    total = np.maximum(sums[:, 0], 1)
    page_total = np.maximum(sums[root, 0], 1)
    siblings = np.maximum(np.array(last)[up], 1)
    same = np.array([alike[key] if key[0] >= 0 else 1 for key in zip(page.parents, page.tags, page.words, strict=True)], float)
    begin = np.cumsum(own) - own
    begin -= begin[root]
    columns = [
        np.log1p(leaf[:, 0]), np.log1p(sums[:, 0]), sums[:, 1] / total, sums[:, 2] / np.maximum(sums[:, 3], 1), sums[:, 0] / np.maximum(sums[:, 3], 1), sums[:, 0] / (sums[:, 5] + sums[:, 6] + 1),
        np.array(depth, float), sums[:, 4], sums[:, 5], np.array(last, float), siblings.astype(float), np.array(index) / siblings, sums[up, 0] / page_total, sums[:, 0] / np.maximum(sums[up, 0], 1),
        np.log1p((sums[up, 0] - sums[:, 0]) / np.maximum(siblings - 1, 1)), sums[up, 1] / np.maximum(sums[up, 0], 1), begin / page_total, sums[:, 0] / page_total,
        low, high, low[up], high[up], low[grand], high[grand], np.array(least), np.array(most), named, named[up], np.array(inside, float), same, same[up], same[grand],
        leaf[:, 7], sums[:, 7], sums[up, 7], code.astype(float), code[up].astype(float), code[grand].astype(float), np.isin(code, [kind[t] for t in ("h1", "h2", "h3")]).astype(float),
    ]
    return np.stack(columns, 1)


def decode_tree(parents: list[int], odds: np.ndarray) -> np.ndarray:
    """The likeliest labels in which a node is 1 only below nodes that are 1."""
    yes, no = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
    off, on = no.tolist(), yes.tolist()  # of whole subtrees
    for i in range(len(parents) - 1, 0, -1):
        p = parents[i]
        on[p] += max(on[i], off[i])
        off[p] += off[i]
    keep = np.zeros(len(parents), bool)
    keep[0] = on[0] >= off[0]
    for i in range(1, len(parents)):
        keep[i] = keep[parents[i]] and on[i] > off[i]
    return keep


def node_labels(page: Page) -> np.ndarray | None:
    """Labels 1 and 0 of nodes, -1 where unknown: of composed pages by their marks, of others by semantic elements.

    In an article, what stands below an element with attributes of its own may be main text or not. None for a page
    without marks or articles.
    """
    n, state, marked = len(page.tags), [None] * len(page.tags), False
    composed = any(w in LABELS for ws in page.words for w in ws)
    for i in range(1, n):
        tag, words = page.tags[i], page.words[i]
        now = state[page.parents[i]]
        if composed:
            for w in words:
                if w in LABELS:
                    now, marked = LABELS.index(w), True
        elif tag in BESIDES:
            now = 0
        elif tag in ("article", "main"):
            now, marked = (1 if now is None else now), True
        elif now == 1 and words:
            now = -1
        state[i] = now
    if not marked:
        return None
    y = np.array([(-1 if s == -1 else int(s == 1)) if t == "#text" else 0 for s, t in zip(state, page.tags, strict=True)])
    known = np.array([t == "#text" or s == 0 for s, t in zip(state, page.tags, strict=True)])
    for i in range(n - 1, 0, -1):
        p = page.parents[i]
        if y[i] == 1 or y[i] == -1 and y[p] != 1 and not known[p]:
            y[p] = y[i]
    return y


def composed_pages(paragraphs: list[str], n: int = COMPOSED_PAGES, seed: int = SEED) -> list[str]:
    """Pages of known labels: paragraphs in varied content elements, between and around varied furniture.

    Names of classes are usual ones, ones of no meaning, or none, so that the trees can't rely on names alone.
    """
    rng = np.random.default_rng(seed)
    paragraphs = paragraphs or ["A paragraph of some words, long enough to be one. It has a second sentence as well."]
    pick = lambda: paragraphs[rng.integers(len(paragraphs))]
    some = lambda k: " ".join(pick().split()[:k])
    one_of = lambda *x: x[rng.integers(len(x))]
    made_up = lambda: "".join(rng.choice(list("abdegiklmnorstu"), rng.integers(3, 9)))
    links = lambda k: "".join(f'<li><a href="/{j}">{some(2)}</a></li>' for j in range(k))

    def named(usual: str, label: int | None = None) -> str:
        kind = rng.random()
        name = "" if kind < 0.25 else f' {one_of("class", "class", "id")}="{made_up() if kind < 0.5 else one_of(*usual.split("|"))}"'
        return name + ("" if label is None else f" data-label=label{label}")

    def comments() -> str:
        name = named("comment|comment-body|reply|c")
        one = lambda: f"<{tag}{name}><b>{some(1)}</b>{one_of('', ' <time>12:0' + str(rng.integers(10)) + '</time>')}<p>{some(rng.integers(3, 60))}</p></{tag}>"
        tag, outer = one_of("div", "div", "li", "article"), one_of("section", "div", "ol")
        return f"<{outer}{named('comments|comment-list|reader-comments|replies|discussion|disqus', 0)}><h3>{some(2)}</h3>{''.join(one() for _ in range(rng.integers(1, 7)))}</{outer}>"

    def related() -> str:
        tag = one_of("aside", "div", "section")
        return f"<{tag}{named('sidebar|related|widget|related-posts|share|social|tags', 0)}><h3>{some(2)}</h3>{one_of('', f'<p>{some(rng.integers(5, 40))}</p>')}<ul>{links(rng.integers(2, 6))}</ul></{tag}>"

    def advert() -> str:
        tag = one_of("div", "div", "aside", "section")
        return f"<{tag}{named('ad|ads|advert|sponsored|promo banner|ad-slot', 0)}>{one_of('', '<b>' + some(2) + '</b> ')}{some(rng.integers(4, 40))}</{tag}>"

    def legal() -> str:
        tag = one_of("footer", "footer", "div", "p")
        return f"<{tag}{named('footer|site-footer|copyright|legal', 0)}>{one_of('&copy;', '&copy;', '(c)')} {some(rng.integers(1, 30))}</{tag}>"

    furniture = [
        lambda: f"<nav data-label=label0><ul>{links(rng.integers(2, 9))}</ul></nav>",
        lambda: f"<div{named('menu|nav-bar|navigation|top-menu|breadcrumbs', 0)}><ul>{links(rng.integers(2, 9))}</ul></div>",
        lambda: f"<header{named('header|masthead|top', 0)}><{(t := one_of('h1', 'h2', 'div'))}>{some(3)}</{t}><p>{some(8)}</p></header>",
        lambda: f"<footer data-label=label0><p>&copy; {some(4)}</p><ul>{links(3)}</ul></footer>",
        legal, legal, advert, advert, related, related,
        lambda: f"<div{named('cookie-notice|cookie-banner|notice|consent|gdpr|alert', 0)} role=alert><p>{some(rng.integers(6, 40))}</p><button>OK</button></div>",
        lambda: f"<form data-label=label0 action=/s><label>{some(3)}</label><input name=q><button>{some(1)}</button><p>{some(9)}</p></form>",
        lambda: f"<div{named('newsletter|subscribe|signup', 0)}><p>{some(12)}</p><input></div>",
        comments, comments,
    ]
    contents = [
        lambda x: f"<h2>{some(4)}</h2><p>{x}</p>", lambda x: "<ul>" + "".join(f"<li>{some(rng.integers(2, 14))}</li>" for _ in range(rng.integers(2, 5))) + "</ul>", lambda x: f"<blockquote><p>{x}</p></blockquote>",
        lambda x: f'<p>{some(9)} <a href="/x">{some(3)}</a> {x}</p>', lambda x: f"<div{named('par|text|block')}>{x}</div>", lambda x: f"<pre>{some(rng.integers(2, 30))}\n  {some(5)}</pre>", lambda x: f"<pre{named('code|source')}><code>{some(9)}</code></pre>",
        lambda x: f"<figure><img src=x><figcaption>{some(rng.integers(3, 14))}</figcaption></figure>", lambda x: f"<dl><dt>{some(2)}</dt><dd>{some(12)}</dd></dl>", lambda x: f"<section{named('part|chapter|section')}><h3>{some(3)}</h3><p>{x}</p></section>",
        lambda x: f"<table><tr><td>{some(2)}</td><td>{some(rng.integers(1, 6))}</td></tr><tr><td>{some(1)}</td><td>{some(3)}</td></tr></table>", lambda x: f"<p>{some(4)} <math><mi>x</mi></math> {some(5)}</p>",
    ]
    pages = []
    for _ in range(n):
        title = f"<h1{named('title|headline')}>{some(rng.integers(1, 11))}</h1>"
        kind = rng.random()
        main = [title] if kind < 0.6 else [f"<header{named('entry-header|article-header|post-header')}>{title}</header>"] if kind < 0.8 else []
        tiny = rng.random() < 0.15  # a line or two of main text, less than the furniture has
        if tiny:
            main = [f"<{t}>{some(rng.integers(1, 5))}</{t}>" for t in ("h1", "p")]
        for _ in range(0 if tiny else rng.integers(1, 12)):
            text = some(rng.integers(1, 15)) if rng.random() < 0.35 else pick()
            main.append(f"<p>{text}</p>" if rng.random() < 0.6 else contents[rng.integers(len(contents))](text))
        if not tiny and rng.random() < 0.4:  # in the midst or at the end of the article
            main.insert(int(rng.integers(1, len(main) + 1)), one_of(advert, advert, related)())
            if rng.random() < 0.5:
                main.append(one_of(comments, comments, legal, related)())
        tag = one_of("article", "article", "main", "div", "div", "section")
        inner = f"<{tag}{named('content|post|entry-content|story-body|story|text|prose|article|story widget-story|post with-sidebar|content has-ad|article-body share-on|entry related-entry|main widget', 1)}>{''.join(main)}</{tag}>"
        before = "".join(furniture[k]() for k in rng.integers(0, len(furniture), rng.integers(0, 4)))
        after = "".join(furniture[k]() for k in rng.integers(0, len(furniture), rng.integers(0, 5)))
        if rng.random() < 0.4:
            beside = related() if rng.random() < 0.4 else ""
            inner = f"<div{named('wrapper|container|page|row')}>{inner}{beside}</div>"
        pages.append(f"<html><head><title>{some(5)}</title></head><body>{before}{inner}{after}</body></html>")
    return pages


@dataclass(frozen=True)
class Extractor:
    """The trees, and the odds of attribute tokens that they read."""

    trees: Trees
    odds: np.ndarray


def fit_extractor(sources: list[str], composed: int = COMPOSED_PAGES) -> Extractor:
    """Fit on pages and on ``composed`` ones that are made of their paragraphs."""
    seen = [parse_page(h) for h in sources]
    paragraphs = [t for p in seen if (y := node_labels(p)) is not None for t, k in zip(p.texts, y, strict=True) if k == 1 and len(t) > 80]
    pages = [p for p in [*seen, *(parse_page(h) for h in composed_pages(paragraphs, composed))] if node_labels(p) is not None]
    labels = [node_labels(p) for p in pages]
    odds = token_odds(pages, labels)
    y = np.concatenate(labels)
    x = node_features(pages, odds)
    return Extractor(fit_trees(x[y >= 0], y[y >= 0]), odds)


def train_extractor(pages: DataFrame, sample: int = SAMPLE_PAGES, composed: int = COMPOSED_PAGES) -> Extractor:
    """Fit on ``sample`` pages (those with the smallest hash of their id, of up to SAMPLE_BYTES) and ``composed`` ones.

    One task reads the sample; the driver gets the trees alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = fit_extractor([h for batch in batches for h in batch.column("html").to_pylist()], composed)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(made)], pa.binary())], names=["model"])

    fit = pages.filter("length(html) > 0").filter(F.octet_length("html") <= SAMPLE_BYTES)
    chosen = fit.select("page_id", "html").orderBy(F.xxhash64("page_id"), "page_id", "html").limit(sample).select("html")
    found = chosen.coalesce(1).mapInArrow(run, "model binary").first()
    return pickle.loads(found["model"]) if found else fit_extractor([], composed)


def main_texts(pages: list[str], model: Extractor) -> list[str]:
    """Main text of each page: its kept blocks in page order, one a line."""
    parsed = [parse_page(h) for h in pages]
    if not parsed:
        return []
    odds = model.trees.log_odds(node_features(parsed, model.odds))
    out, at = [], 0
    for p in parsed:
        n = len(p.tags)
        keep = decode_tree(p.parents, odds[at : at + n])
        out.append("\n".join(t for t, k in zip(p.texts, keep.tolist(), strict=True) if k and t))
        at += n
    return out


def extract_main_text(pages: DataFrame, model: Extractor) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of ``pages`` (page_id, url, html): the whole main text.

    Null or empty html, and pages without main text, give an empty text. Repeated rows give repeated results, equal html
    equal texts; pages of any length are read whole, in time in proportion; other columns are left aside.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bounds = text_buffers(batch.column("html"))[1]
            for at, end in chunks(bounds, SPAN):
                part = batch.slice(at, end - at)
                texts = main_texts([h or "" for h in part.column("html").to_pylist()], model)
                yield pa.RecordBatch.from_arrays([part.column("page_id").cast(pa.int64()), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
