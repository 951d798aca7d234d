"""Labelled sample pages for the HTML extractor: random layouts with marked main text.

Everything that is not main text shows it: by its tag, by a word in its class, id or role, by being a
list of links outside the main text, or by what it says.  On half of the pages names are dropped or mislead: junk has none
and says what it is, and wrappers of main text bear names of junk.  Main text comes in all block tags, bare,
between line breaks, in tables, in wrappers with and without names, and on pages without any tags.
"""

from __future__ import annotations

import random
import re

from .dom import TOKENS

SYLLABLES = "ba be bi bo bu ca ce co da de di do fa fe ga ge go ha he hi ho la le li lo lu ma me mi mo na ne ni no nu pa pe pi po ra re ri ro sa se si so su ta te ti to tu va ve vi wa we an en in on er es st nd th ing tion ß é ñ".split()
#: What junk says, by kind; ``#`` is a number and ``@`` a name.
SAYINGS = {
    "foot": ("© 20## @", "Copyright 20## @. All rights reserved.", "Copyright # @ &middot; Privacy &middot; Terms", "All rights reserved.", "&copy; @ Privacy policy | Terms of use", "Imprint and privacy", "Powered by @"),
    "notice": ("We use cookies to improve this site. Accept", "This site uses cookies.", "Subscribe to our newsletter", "Sign up for news from @", "By going on you agree to our use of cookies. Got it", "Please enable JavaScript.", "Accept all cookies", "Sign in to read on"),
    "talk": ("# comments", "# replies", "3 responses", "Leave a comment", "# Kommentare", "Comments", "Reader comments"),
    "ad": ("Advertisement", "Sponsored", "Anzeige", "Buy now and save #0 % off", "Shop now", "Special offer from @: free shipping", "Ad"),
    "side": ("Related stories", "Read more", "Most popular", "Trending now", "More from @", "You may also like", "See also", "Recommended for you"),
    "share": ("Share this", "Follow us", "Tweet Share", "Tags: @, @", "Share on @"),
}
LABELS = "Home About Contact News Sports Login Register Share Tweet Print Next Previous Archive Tags Search Help Terms Privacy Jobs Shop".split()


class Writer:
    """Makes one page; text between the two marks is main text."""

    ON, OFF = "\ue000", "\ue001"

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        #: How far names tell: always, seldom (junk then says what it is), or misleading around main text.
        self.dull = self.chance(0.45)
        self.misled = self.chance(0.3)

    def one(self, *options: str) -> str:
        return self.r.choice(options)

    def chance(self, p: float) -> bool:
        return self.r.random() < p

    def word(self) -> str:
        return str(self.r.randint(0, 2100)) if self.chance(0.04) else "".join(self.r.choice(SYLLABLES) for _ in range(self.r.randint(1, 4)))

    def words(self, low: int, high: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(low, high)))

    def prose(self, sentences: int) -> str:
        return " ".join(self.words(2, 16).capitalize() + self.one(".", ".", ".", "!", "?") for _ in range(sentences))

    def named(self, *names: str) -> str:
        """A class, id or role that tells what the element is; on dull pages mostly none."""
        if self.dull and self.chance(0.9):
            return self.plain()
        return self.called(self.r.choice(names))

    def misnamed(self) -> str:
        """A name that speaks of junk."""
        words = self.r.choice(list(TOKENS.values())).split()
        name = self.r.choice(words)
        return self.called(self.one(name, name, f"{name}-{self.one('content', 'body', 'text', 'box', 'page', 'story', 'item')}", f"{self.one('user', 'main', 'page', 'site', 'post')}-{name}"))

    def says(self, kind: str) -> str:
        """What junk of a kind says, in a block of its own or bare."""
        text = "".join(str(self.r.randint(1, 9)) if c == "#" else self.word().capitalize() if c == "@" else c for c in self.r.choice(SAYINGS[kind]))
        return self.one(text + " ", f"<p>{text}</p>", f"<h3>{text}</h3>", f"<span>{text}</span> ", f"<div>{text}</div>", f"<b>{text}</b><br>")

    def said(self, kind: str, body: str) -> str:
        """Junk with what it says before or behind it; on dull pages always."""
        if not self.dull and self.chance(0.6):
            return body
        return body + self.says(kind) if kind in ("foot", "notice") and self.chance(0.4) else self.says(kind) + body

    def called(self, name: str) -> str:
        value = self.one(name, name, f"{name} {self.word()}", f"{self.word()}-{name}", f"{name}-{self.word()}", f"site-{name}", f"{name}_{self.r.randint(1, 9)}", f"js{name.capitalize()}")
        return f' {self.one("class", "class", "class", "id")}="{value}"'

    def plain(self) -> str:
        """An attribute that tells nothing."""
        x = self.r.random()
        return "" if x < 0.6 else f' class="{self.word()}"' if x < 0.8 else f' id="{self.word()}{self.r.randint(1, 99)}"' if x < 0.9 else f' style="margin:{self.r.randint(0, 9)}px"'

    def shown(self, tag: str, names: tuple[str, ...], body: str, generic: tuple[str, ...] = ("div", "div", "div", "section")) -> str:
        """Junk in its own tag, or in a generic one with a telling name."""
        if tag and self.chance(0.5):
            return f"<{tag}{self.named(*names) if self.chance(0.5) else self.plain()}>{body}</{tag}>"
        kind = self.r.choice(generic)
        if kind == "p":
            body = self.one(self.prose(self.r.randint(1, 3)), self.words(1, 8), " ".join(self.links(2)))
        return f"<{kind}{self.named(*names)}>{body}</{kind}>"

    def links(self, n: int) -> list[str]:
        return [f'<a href="/{self.word()}">{self.one(self.r.choice(LABELS), self.words(1, 3), self.words(3, 8))}</a>' for _ in range(n)]

    def junk_body(self) -> str:
        return self.r.choice([
            self.prose(self.r.randint(1, 4)), f"<p>{self.prose(self.r.randint(1, 3))}</p>", f"<p>{self.prose(1)}</p>" * self.r.randint(1, 3), self.words(1, 9), f"<h3>{self.words(1, 4)}</h3><p>{self.prose(1)}</p>",
            f"<h2>{self.words(1, 4)}</h2><ul><li>{'</li><li>'.join(self.links(4))}</li></ul>", f"<ul><li>{'<li>'.join(self.words(1, 5) for _ in range(3))}</ul>", f"<div><div>{self.prose(2)}</div></div>", " ".join(self.links(3)),
            f"{self.words(1, 5)}<br>{self.words(1, 5)}", f"<table><tr><td>{self.words(1, 3)}</td><td>{self.prose(1)}</td></tr></table>",
        ])

    def menu(self) -> str:
        items = self.links(self.r.randint(3, 10))
        body = self.one(f"<ul><li>{'</li><li>'.join(items)}</li></ul>", " | ".join(items), f"<ul><li>{'<li>'.join(items)}</ul>", "".join(f"<div>{i}</div>" for i in items), f"<ul><li>{'</li><li>'.join(LABELS[:4])}</li></ul>")
        if "<ul" in body and "href" in body and self.chance(0.2):
            return body
        return self.shown("nav", ("nav", "menu", "navigation", "breadcrumb", "topnav", "pagination", "navbar"), body)

    def header(self) -> str:
        body = self.one(f"<h1>{self.words(1, 4)}</h1><p>{self.words(3, 8)}</p>", f"<h1>{self.words(1, 4)}</h1>", f"<h2>{self.words(1, 3)}</h2>{self.menu()}", self.junk_body())
        return self.shown("header", ("header", "masthead", "topbar", "logo", "branding", "banner"), body)

    def footer(self) -> str:
        body = self.one("&copy; ", "", "Copyright ") + self.one(self.junk_body(), self.junk_body(), self.menu(), self.words(2, 9) + " &middot; " + self.prose(self.r.randint(1, 5)))
        return self.shown("footer", ("footer", "bottom", "copyright", "legal", "imprint"), self.said("foot", body) if not self.dull or self.chance(0.5) else self.says("foot") + self.one("", self.words(1, 6), " ".join(self.links(2))))

    def sidebar(self) -> str:
        body = "".join(self.junk_body() for _ in range(self.r.randint(1, 3)))
        return self.shown("aside", ("sidebar", "related", "widget", "recommended", "rail", "popular", "trending"), self.said("side", body if not self.dull else f"<ul><li>{'</li><li>'.join(self.links(self.r.randint(2, 6)))}</li></ul>"))

    def advert(self) -> str:
        return self.shown("", ("ad", "advert", "ads", "sponsored", "promo", "advertisement", "ad-box", "banner"), self.said("ad", self.junk_body() if not self.dull else self.one(self.words(2, 9), f"<p>{self.prose(1)}</p>", " ".join(self.links(2)))), ("div", "div", "section", "aside", "p", "ul", "table"))

    def notice(self) -> str:
        body = self.said("notice", self.junk_body() if not self.dull else self.one("", self.prose(1), f"<p>{self.prose(1)}</p>")) + self.one("", "", "<button>OK</button>", "<button>Accept</button>")
        if self.chance(0.15):
            return f'<div role="{self.one("alert", "dialog", "alertdialog")}"{self.named("cookie", "consent", "notice")}>{body}</div>'
        return self.shown("", ("cookie-notice", "notice", "alert", "consent", "cookie-banner", "gdpr", "newsletter", "popup", "subscribe", "modal", "paywall"), body, ("div", "section", "aside", "p"))

    def form(self) -> str:
        body = "".join(f"<{t}>{self.words(1, 3)}</{t}><input name=x>" for t in [self.one("label", "p", "div")] * self.r.randint(1, 3))
        return f"<form{self.named('form', 'search', 'login', 'subscribe', 'contact') if self.chance(0.5) else self.plain()}>{body}<button>{self.word()}</button></form>"

    def comments(self) -> str:
        def entry() -> str:
            text = self.prose(self.r.randint(1, 5))
            by = self.one("", f"<h4>{self.word()}</h4>", f"<span>{self.word()}</span> ", f"<b>{self.word()}:</b> ", f"<b>{self.word()}</b> {self.r.randint(1, 30)} {self.one('minutes', 'hours', 'days')} ago ")
            if self.dull or self.chance(0.2):
                text += self.one("", " Reply", ' <a href="#r">Reply</a>')
            tag = self.one("div", "li", "article", "p")
            return f"<{tag}{self.named('comment', 'reply', 'comment-body') if self.chance(0.6) else self.plain()}>{by}{text if tag == 'p' or self.chance(0.4) else '<p>' + text + '</p>'}</{tag}>"

        inner = (self.says("talk") if self.dull or self.chance(0.4) else self.one("", f"<h3>{self.words(1, 2)}</h3>")) + "".join(entry() for _ in range(self.r.randint(1, 6)))
        return self.shown("", ("comments", "comment-list", "discussion", "replies", "reader-comments", "responses", "disqus"), inner, ("div", "section", "ol", "div"))

    def share(self) -> str:
        return self.shown("", ("share", "social", "share-tools", "tags", "author-bio"), self.said("share", self.one(" ".join(self.links(3)), self.words(2, 8) if not self.dull else "")), ("div", "div", "ul", "p"))

    def junk(self) -> str:
        return self.r.choice([self.advert, self.advert, self.share, self.sidebar, self.notice, self.form, self.menu, self.comments])()

    def on(self, text: str) -> str:
        return f"{self.ON}{text}{self.OFF}"

    def paragraph(self) -> str:
        text = self.one(self.prose(self.r.choice([1, 1, 1, 2, 3, 5, 8])), self.prose(self.r.choice([1, 2, 4])), self.words(1, 12), self.word())
        x = self.r.random()
        if x < 0.2:
            text = self.one("<b>{}</b> ", "<em>{}</em> ", '<a href="/y">{}</a> ', "<span>{}</span> ").format(self.words(1, 4)) + text
        elif x < 0.25:
            text = f'<a href="/z">{text}</a>'
        elif x < 0.3:
            text = f"<b>{text}"
        elif x < 0.38:
            text = text.replace(" ", self.one("  ", "\n", " &amp; ", "&nbsp;"), 2)
        return text

    def blocks(self) -> list[str]:
        """Some blocks of main text."""
        x, on, n = self.r.random(), self.on, self.r.choice([1, 1, 1, 2, 2, 3, 4, 6, 9, 14])
        if x < 0.45:
            same = self.paragraph() if self.chance(0.15) else None
            return [f"<p{self.plain() if self.chance(0.2) else ''}>{on(same or self.paragraph())}" + ("</p>" if self.chance(0.9) else "") for _ in range(n)]
        if x < 0.55:
            return [self.one("<br>", "<br><br>", "<br/>\n").join(on(self.paragraph().replace("<b>", "")) for _ in range(n))]
        if x < 0.62:
            return [f"<div{self.plain()}>{on(self.paragraph())}</div>" for _ in range(n)]
        if x < 0.72:
            return [f"<h{k}>{on(self.words(1, 7))}</h{k}>" for k in [self.r.randint(1, 6)]]
        if x < 0.8:
            tag = self.one("ul", "ol")
            return [f"<{tag}>" + "".join(f"<li>{on(self.one(self.words(1, 6), self.prose(1), self.paragraph()))}" + self.one("", "</li>") for _ in range(n)) + f"</{tag}>"]
        if x < 0.83:
            return ["<dl>" + "".join(f"<dt>{on(self.words(1, 3))}<dd>{on(self.prose(1))}" for _ in range(n)) + "</dl>"]
        if x < 0.87:
            return [f"<blockquote>{on(self.prose(2))}</blockquote>", f"<pre>{on(self.words(5, 20))}</pre>"][: self.r.randint(1, 2)]
        if x < 0.93:
            head = f"<tr><th>{on(self.words(1, 2))}</th><th>{on(self.words(1, 2))}</th></tr>" if self.chance(0.5) else ""
            return [f"<table{self.plain()}>{head}" + "".join(f"<tr><td>{on(self.words(1, 3))}</td><td>{on(self.one(self.words(1, 3), self.prose(2)))}</td></tr>" for _ in range(n)) + "</table>"]
        if x < 0.96:
            return [f"<figure><img src=x><figcaption>{on(self.words(3, 9))}</figcaption></figure>"]
        if x < 0.98:
            return [f"<details><summary>{on(self.words(1, 5))}</summary>{on(self.prose(2))}</details>"]
        return [on(self.paragraph())]

    def wrapped(self, body: str) -> str:
        """Main text in none to three wrappers."""
        for _ in range(self.r.choice([0, 0, 1, 1, 1, 2, 3])):
            x = self.r.random()
            if x < 0.3:
                body = f"<article{self.named('article', 'post', 'entry') if self.chance(0.4) else self.plain()}>{body}</article>"
            elif x < 0.45:
                body = f"<main{self.plain()}>{body}</main>"
            elif x < 0.7:
                tag = self.one("div", "section")
                body = f"<{tag}{self.misnamed()}>{body}</{tag}>" if self.misled else f"<{tag}{self.named('content', 'article', 'post', 'entry-content', 'story', 'main', 'text', 'body')}>{body}</{tag}>"
            elif x < 0.9:
                body = f"<div{self.misnamed() if self.misled and self.chance(0.5) else self.plain()}>{body}</div>"
            elif x < 0.95:
                body = f"<center>{body}</center>"
            else:
                body = f"<table><tr><td>{body}</td></tr></table>"
        return body

    def article(self) -> str:
        title = self.on(self.words(2, 9))
        parts = [x for _ in range(self.r.choice([1, 1, 2, 3, 5])) for x in self.blocks()]
        if self.chance(0.15):  # an article may say what junk says, in a paragraph among others
            kind = self.r.choice(list(SAYINGS))
            said = re.sub("<[^>]+>", "", self.says(kind)).strip()
            parts.insert(self.r.choice([len(parts), len(parts), self.r.randint(0, len(parts))]), f"<p>{self.on(self.one(said, said, said + ' ' + self.prose(2), self.prose(2) + ' ' + said))}</p>")
        for _ in range(self.r.choice([0, 0, 0, 0, 1, 1, 2])):
            parts.insert(self.r.randint(0, len(parts)), self.junk())
        x = self.r.random()
        if x < 0.45:
            return self.wrapped(f"<h1>{title}</h1>" + "".join(parts))
        if x < 0.55:
            return f"<article><header><h1>{title}</h1>{self.one('', f'<p>{self.on(self.words(2, 9))}</p>')}</header>{''.join(parts)}</article>"
        if x < 0.65:
            return self.one(f"<h1>{title}</h1>", f"<div{self.plain()}><h1>{title}</h1></div>") + self.wrapped("".join(parts))
        return self.wrapped("".join(parts))

    def page(self) -> str:
        x = self.r.random()
        if x < 0.03:
            return self.on(self.prose(self.r.randint(1, 9)))
        if x < 0.07:
            return "".join(self.blocks())
        if x < 0.11:
            return f"<html><body>{self.on(self.paragraph())}</body></html>"
        if x < 0.2:  # one block of main text, whatever its name, with or without cued junk beside it
            body = f"<h{self.r.randint(1, 2)}>{self.on(self.words(2, 8))}</h1>" * self.chance(0.7) + "".join(f"<p>{self.on(self.paragraph())}</p>" for _ in range(self.r.randint(1, 5)))
            self.dull, more = True, [f() for f, p in ((self.comments, 0.2), (self.notice, 0.3), (self.footer, 0.4)) if self.chance(p) and x > 0.13]
            return f"<html><body><div{self.misnamed() if self.chance(0.7) else self.plain()}>{body}</div>{''.join(more)}</body></html>"
        bare = self.chance(0.15)
        top = [] if bare else [f() for f, p in ((self.notice, 0.25), (self.header, 0.5), (self.menu, 0.7), (self.form, 0.2), (self.advert, 0.35), (self.menu, 0.15)) if self.chance(p)]
        end = [] if bare else [f() for f, p in ((self.sidebar, 0.4), (self.comments, 0.25), (self.advert, 0.25), (self.form, 0.15), (self.notice, 0.15), (self.menu, 0.15), (self.footer, 0.75)) if self.chance(p)]
        article = "" if self.chance(0.02) and not bare else "".join(self.article() for _ in range(self.r.choice([1, 1, 1, 1, 1, 2, 3])))
        if self.chance(0.3):
            side = self.sidebar() if self.chance(0.5) else ""
            inner = self.one(article + side, side + article)
            article = self.one(f"<main>{inner}</main>", f"<div{self.named('wrapper', 'container', 'page')}>{inner}</div>", f"<table><tr><td>{article}</td><td>{side}</td></tr></table>", f"<div{self.plain()}>{inner}</div>")
        if self.chance(0.2):
            self.r.shuffle(top)
        head = f"<head><title>{self.words(2, 6)}</title><style>p{{}}</style></head>"
        return f"<!DOCTYPE html><html>{head}<body>{''.join(top)}<script>var a='</p>';</script>{article}{''.join(end)}</body></html>"


def pages(n: int, seed: int = 5) -> list[str]:
    return [Writer(seed * 1_000_003 + i).page() for i in range(n)]
