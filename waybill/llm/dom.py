"""A lenient HTML reader: block nodes with their text, and features of every node."""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg textarea title object canvas select head xmp noembed noframes".split())
BLOCK = frozenset(
    "html body div p section article main header footer nav aside ul ol li dl dt dd table thead tbody tfoot tr td th caption form fieldset legend h1 h2 h3 h4 h5 h6 "
    "blockquote pre figure figcaption address details summary center dialog menu hgroup search button label".split()
)
#: What a start tag closes if it is open.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
CLOSES_P = BLOCK - {"html", "body", "button", "label", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend"}
#: Beyond these an open element stays open.
SCOPE = frozenset("ul ol dl table td th div section article main aside blockquote body html".split())

DEEPEST = 500

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S
)
ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S)
NAMED = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

TAGS = ("#text", "p", "div", "li", "ul", "h1", "h2", "section", "article", "main", "nav", "header", "footer", "aside", "form", "table", "td", "blockquote", "pre", "figure", "button", "body")
ALIAS = {"ol": "ul", "dl": "ul", "menu": "ul", "dd": "li", "dt": "li", "h3": "h2", "h4": "h2", "h5": "h2", "h6": "h2", "tr": "table", "tbody": "table", "thead": "table", "th": "td", "figcaption": "figure", "label": "form", "fieldset": "form", "html": "body"}
#: Attribute tokens by what they speak of.
TOKENS = {
    "nav": "nav navbar navigation menu menubar breadcrumb breadcrumbs crumb crumbs pagination pager pages toc skip tabs dropdown topnav sitemap links linklist megamenu",
    "head": "header head masthead topbar banner logo branding brand site title tagline hero",
    "foot": "footer foot bottom copyright legal colophon imprint bottombar credits",
    "side": "sidebar side aside rail widget widgets related recommended recommendations more popular trending tags tagcloud secondary complementary see also archive archives teaser",
    "ad": "ad ads advert adverts advertisement advertising sponsor sponsored sponsors promo promotion promoted adsense dfp banner outbrain taboola affiliate commercial offer offers adbox adslot",
    "notice": "cookie cookies consent notice notices alert alerts gdpr popup modal overlay newsletter subscribe subscription paywall message warning info disclaimer signup toast",
    "form": "form search login register contact input field submit feedback survey poll",
    "talk": "comment comments reply replies respond discussion disqus reader readers thread feedback response responses user commentlist guestbook",
    "share": "share sharing social follow facebook twitter print email tools toolbar meta byline author bio",
    "main": "article content main post entry body story text maincontent articlebody page hentry copy prose blog news primary read document",
}
#: What junk says of itself, by kind; phrases that prose seldom holds weigh as a share of the words.
CUES = (
    r"©|\(c\)|\bcopyright\b|all rights reserved|\bprivacy\b|\bterms\b|\bimprint\b|\bimpressum\b|datenschutz|\bpowered by\b|derechos reservados|tous droits",
    r"\bcookies?\b|\bconsent\b|\baccept\b|\bsubscribe\b|\bnewsletter\b|\bsign up\b|\bsign in\b|\blog in\b|\bjavascript\b|\bagree\b|akzeptieren|aceptar|accepter|\bgot it\b|\bdismiss\b",
    r"\d+ (?:comments?|repl(?:y|ies)|responses?|kommentare?|comentarios?)\b|\breply\b|\bleave a comment\b|\b\d+ (?:minutes?|hours?|days?|weeks?|months?|years?) ago\b|\bantworten\b|\bresponder\b|\bcomments\b|\blikes?\b|\bupvote|\bpermalink\b",
    r"\badvertisement\b|\bsponsored\b|\banzeige\b|\bpublicidad\b|\bbuy now\b|\bshop now\b|\border now\b|\b\d+ ?% off\b|\bfree shipping\b|\bspecial offer\b|\bad\b|\bpromo\b",
    r"\brelated\b|\bread (?:more|also|next)\b|\bmore from\b|\bmost (?:read|popular)\b|\btrending\b|\bshare\b|\btweet\b|\bfollow us\b|\bsee also\b|\brecommended\b|\btags?:|\byou may also like\b",
)
CUE = [re.compile(c, re.I) for c in CUES]
#: Each cue holds one of these; and texts above this length are no cues as a whole, whatever they mention.
STEMS = (
    "©", "(c)", "copyright", "rights reserved", "privacy", "terms", "imprint", "impressum", "datenschutz", "powered by", "derechos", "tous droits", "cookie", "consent", "accept", "subscribe", "newsletter", "sign ", "log in", "javascript",
    "agree", "akzept", "acept", "got it", "dismiss", "comment", "repl", "response", "kommentar", "comentario", " ago", "antworten", "responder", "like", "upvote", "permalink", "advert", "sponsored", "anzeige", "publicidad", " now", "% off",
    " % off", "shipping", "offer", "promo", "related", "read ", "more from", "most ", "trending", "share", "tweet", "follow us", "see also", "recommended", "tag",
)
AD = re.compile(r"\bad\b")
LONGEST_CUE = 300
WORDS = {w: i for i, (_, ws) in reversed(list(enumerate(TOKENS.items()))) for w in ws.split()}
N_TOKENS = len(TOKENS)


@dataclass
class Page:
    """Nodes in document order; a node without blocks below holds its text itself."""

    tag: list[str] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    tokens: list[list[int]] = field(default_factory=list)
    hidden: list[bool] = field(default_factory=list)
    named: list[int] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)
    inline: list[int] = field(default_factory=list)

    def add(self, tag: str, parent: int, attrs: str = "") -> int:
        kinds, hidden, named = [0] * N_TOKENS, False, 0
        if attrs:
            for m in ATTRIBUTE.finditer(attrs):
                name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
                if name in ("class", "id", "role", "itemprop", "aria-label", "data-role"):
                    for w in NAMED.findall(value):
                        named += 1
                        if (k := WORDS.get(w.lower())) is not None:
                            kinds[k] += 1
                elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
                    hidden = True
        self.tag.append(tag)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.tokens.append(kinds)
        self.hidden.append(hidden)
        self.named.append(named)
        self.text.append("")
        self.linked.append(0)
        self.inline.append(0)
        return len(self.tag) - 1


def parse(source: str) -> Page:
    """The block nodes of a page; text directly inside a block that has blocks becomes a ``#text`` node."""
    page = Page()
    root = page.add("body", -1)
    stack: list[tuple[str, int]] = [("body", root)]
    # where elements of each name, blocks and scopes stand in the stack: no tag has to pass over the stack
    places: dict[str, list[int]] = defaultdict(list)
    block_places, scope_places = [0], [0]
    run: list[str] = []
    state = {"links": 0, "linked": 0, "inline": 0}
    owner = root

    def flush() -> None:
        raw = "".join(run)
        run.clear()
        text = " ".join(raw.split())
        if text:
            n = page.add("#text", owner)
            page.text[n] = text
            page.linked[n], page.inline[n] = min(state["linked"], len(text)), state["inline"]
        state["linked"] = state["inline"] = 0

    def put(raw: str) -> None:
        if raw:
            text = html.unescape(raw)
            run.append(text)
            if state["links"]:
                state["linked"] += len(text.strip())

    def close(i: int) -> None:
        nonlocal owner
        if block_places[-1] >= i:
            flush()
        for t, _ in stack[i:]:
            places[t].pop()
            state["links"] -= t == "a"
        del stack[i:]
        for held in (block_places, scope_places):
            while held[-1] >= i:
                held.pop()
        owner = stack[-1][1]

    def last(names: Iterable[str]) -> int:
        return max((places[t][-1] for t in names if places[t]), default=0)

    at, n = 0, len(source)
    while at < n:
        m = TOKEN.search(source, at)
        if m is None:
            put(source[at:])
            break
        put(source[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        name, end, attrs = name.lower(), m[1] or m[4], m[3] or m[6] or ""
        if end:
            i = last((name,))
            if i and (name in BLOCK or i > block_places[-1]):
                close(i)
            elif name == "p" and not i:
                flush()
            continue
        if name in RAW:
            if not attrs.rstrip().endswith("/") or name in ("script", "style"):
                stop = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(source, at)
                if stop is None and name == "head":
                    stop = re.compile(r"<body[\s/>]", re.I).search(source, at)
                    at = stop.start() if stop else at
                elif stop is None:
                    at = n
                else:
                    at = source.find(">", stop.start()) + 1 or n
            continue
        if name in VOID:
            if name in ("br", "hr"):
                run.append(" ")
                if name == "hr":
                    flush()
            continue
        if name in ("html", "body"):
            continue
        if name in BLOCK:
            if name in CLOSES_P and (i := last("p")) > scope_places[-1]:
                close(i)
            while name in CLOSES and (i := last(CLOSES[name])) > last(SCOPE - CLOSES[name]):
                close(i)
                if name != "tr" or stack[-1][0] != "tr":
                    break
            flush()
            while page.depth[owner] >= DEEPEST:  # as in browsers, deeper blocks become siblings
                owner = page.parent[owner]
            owner = page.add(name, owner, attrs)
        else:
            state["inline"] += 1
            if name == "a":
                state["links"] += 1
        if not attrs.rstrip().endswith("/") or name in BLOCK:
            places[name].append(len(stack))
            if name in BLOCK:
                block_places.append(len(stack))
            if name in SCOPE:
                scope_places.append(len(stack))
            stack.append((name, owner))
    flush()
    return page


class Forest:
    """The nodes of many pages in one numbering; nodes of one depth stand in the order of their parents."""

    def __init__(self, pages: list[Page]):
        counts = np.array([len(p.tag) for p in pages])
        self.n = int(counts.sum())
        self.root = np.cumsum(counts) - counts
        self.page = np.repeat(np.arange(len(pages)), counts)
        self.parent = np.fromiter((x for p in pages for x in p.parent), np.int64, self.n)
        self.parent = np.where(self.parent < 0, -1, self.parent + self.root[self.page])
        self.depth = np.fromiter((x for p in pages for x in p.depth), np.int64, self.n)
        order = np.argsort(self.depth, kind="stable")
        cuts = np.searchsorted(self.depth[order], np.arange(1, int(self.depth.max()) + 2 if self.n else 1))
        #: For every depth from 1 on its nodes, their parents, and where the children of each parent start.
        self.levels = []
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            own = order[x:y]
            up, first = np.unique(self.parent[own], return_index=True)
            self.levels.append((own, up, first))

    def rise(self, values: np.ndarray, combine: np.ufunc, scale: float = 1.0) -> None:
        """Values of children go into those of their parents, from the leaves up."""
        for own, up, first in reversed(self.levels):
            values[up] = combine(values[up], scale * combine.reduceat(values[own], first, axis=0))

    def sink(self, values: np.ndarray) -> np.ndarray:
        """For every node the largest values among the nodes above it."""
        out = np.zeros_like(values)
        for own, _, _ in self.levels:
            above = self.parent[own]
            out[own] = np.maximum(out[above], values[above])
        return out


JUNK_COLUMNS = [TAGS.index(t) for t in ("nav", "header", "footer", "aside", "form", "button")]
TAG_COLUMN = {t: TAGS.index(ALIAS.get(t, t)) for t in (*TAGS, *ALIAS) if ALIAS.get(t, t) in TAGS}


def cued(low: str) -> bool:
    """Whether a lower-case text may hold a cue."""
    for x in STEMS:
        if x in low:
            return True
    return "ad" in low and AD.search(low) is not None


def features(pages: list[Page], forest: Forest) -> np.ndarray:
    """One row of numbers for every node: tag, attribute tokens, subtree density, depth and siblings."""
    f, n = forest, forest.n
    texts, tag = [t for p in pages for t in p.text], [t for p in pages for t in p.tag]

    def numbers(name: str) -> np.ndarray:
        return np.array([x for p in pages for x in getattr(p, name)], float)

    size = np.fromiter(map(len, texts), float, n)
    words = np.array([t.count(" ") + (t != "") for t in texts], float)
    stops = np.array([t.count(".") + t.count(",") + t.count("!") + t.count("?") if t else 0 for t in texts], float)
    codes: dict[str, int] = {}
    code = np.fromiter((codes.setdefault(t, len(codes)) for t in tag), np.int64, n)
    column = np.array([TAG_COLUMN.get(t, -1) for t in codes], np.int64)[code]
    is_text, is_p = (np.array([t == name for t in codes], float)[code] for name in ("#text", "p"))
    total = np.stack([size, words, stops, numbers("linked"), numbers("inline"), np.ones(n), is_p], 1)
    f.rise(total, np.add)
    longest = size.copy()
    f.rise(longest, np.maximum)
    up = np.where(f.parent < 0, np.arange(n), f.parent)
    own = np.bincount(up, weights=size * is_text * (f.parent >= 0), minlength=n)
    n_children, index, prev_same = np.zeros(n), np.zeros(n), np.zeros(n)
    for at, above, first in f.levels:
        count = np.diff(np.append(first, len(at)))
        n_children[above] = count
        index[at] = np.arange(len(at)) - np.repeat(first, count)
        prev_same[at[1:]] = (code[at[1:]] == code[at[:-1]]) & (index[at[1:]] > 0)
    _, kind, many = np.unique(f.parent * len(codes) + code + (f.parent < 0) * (-1 - f.page) * len(codes) * 2, return_inverse=True, return_counts=True)
    same = many[kind]
    tags = np.zeros((n, len(TAGS)))
    tags[np.flatnonzero(column >= 0), column[column >= 0]] = 1
    tokens, hidden = np.array([x for p in pages for x in p.tokens], float).reshape(n, N_TOKENS), numbers("hidden")
    above = f.sink(np.concatenate([tags, tokens, hidden[:, None]], 1))
    below = np.minimum(tokens, 3)
    f.rise(below, np.maximum, 0.5)
    whole = np.maximum(total[f.root, 0], 1)[f.page]
    before = np.cumsum(size) - size
    before -= before[f.root][f.page]
    chars = np.maximum(total[:, 0], 1)
    per_word = np.maximum(total[:, 1], 1)
    cues = np.zeros((n, len(CUE)))
    for i, t in enumerate(texts):
        if t and len(t) <= LONGEST_CUE and cued(t.lower()):
            cues[i] = [len(c.findall(t)) for c in CUE]
    before_cue = np.zeros_like(cues)  # what the node before it says, such as a heading
    for at, _, first in f.levels:
        follows = np.ones(len(at), bool)
        follows[first] = False
        k = np.flatnonzero(follows)
        before_cue[at[k]] = cues[at[k - 1]]
    cue_total = cues.copy()
    f.rise(cue_total, np.add)
    # names and tags are only to be trusted if text remains without the nodes that they speak against
    junk = (tokens[:, :-1].sum(1) > 0) | np.isin(column, JUNK_COLUMNS)
    clean = size * ~(junk | (f.sink(junk[:, None].astype(float))[:, 0] > 0))
    f.rise(clean, np.add)
    page_clean = clean[f.root][f.page]
    rest = np.stack([
        np.log1p(page_clean), np.log1p(page_clean - clean), clean / np.maximum(total[:, 0], 1), page_clean / whole, np.log1p(whole - total[:, 0]),
        np.log1p(total[:, 0]), np.log1p(total[:, 1]), np.log1p(longest), total[:, 3] / chars, total[up, 3] / chars[up], total[:, 2] / per_word,
        chars / np.maximum(total[:, 5], 1), total[:, 4] / per_word, total[:, 6], total[:, 0] / whole, total[:, 0] / chars[up], own / chars,
        f.depth, index, n_children, n_children[up], same / np.maximum(n_children[up], 1), prev_same, before / whole, np.log1p(total[up, 0]), hidden, np.maximum(hidden, above[:, -1]),
        total[:, 0] / per_word, numbers("named"), np.log1p(whole),
    ], 1)
    cue_share = np.minimum(cue_total / np.maximum(total[:, 1:2], 1), 1)
    return np.concatenate([rest, np.minimum(cue_total, 4), cue_share, cue_share[up], np.minimum(before_cue, 2), tags, above[:, : len(TAGS)], np.minimum(tokens, 3), np.minimum(above[:, len(TAGS) : -1], 3), below], 1).astype(np.float32)
