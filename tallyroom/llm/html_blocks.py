"""Leaf blocks of HTML pages, and labelled pages to train on."""

from __future__ import annotations

import html
import random
import re
from dataclasses import dataclass, field

# Elements whose start or end parts blocks of text.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
# Elements whose content is never text of the page.
HIDDEN_TAGS = frozenset("script style template noscript head title svg iframe object select textarea button canvas audio video map".split())
RAW_TAGS = frozenset("script style textarea title iframe noscript".split())
# Elements without an end tag.
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements that may stand in a head; any other start tag, or text, ends an open head.
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
# Hidden elements that can hold others of their kind.
NESTS = frozenset("svg object template map".split())
# Block-level elements that a menu of choices holds.
CHOICES = frozenset("option optgroup hr".split())
# A start tag of the key ends an open element of the values.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|</[^>]*(?:>|\Z)""", re.S)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_PART = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


@dataclass
class Block:
    text: str
    tags: tuple[str, ...]  # open elements, outermost first
    names: tuple[str, ...]  # words of their class, id and role
    links: int  # characters inside links
    before: str = ""  # the tag that ended the block before


@dataclass
class _Open:
    tag: str
    names: tuple[str, ...] = field(default=())
    left_open: bool = False


def names_of(attributes: str) -> tuple[str, ...]:
    if "=" not in attributes:
        return ()
    found = " ".join(html.unescape(a or b or c) for a, b, c in _NAMES.findall(attributes))
    return tuple(_PART.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", found).lower()))


def blocks(page: str) -> list[Block]:
    """The leaf blocks with text, in page order. Broken markup is read leniently: open elements end where they must."""
    out: list[Block] = []
    stack: list[_Open] = []
    text: list[str] = []
    size = links = hidden = in_link = 0
    before = ""
    at, n = 0, len(page)

    def end_block(tag: str) -> None:
        nonlocal size, links, before
        if text:
            joined = _SPACE.sub(" ", html.unescape("".join(text))).strip()
            if joined:
                out.append(Block(joined, tuple(o.tag for o in stack), tuple(x for o in stack for x in o.names), links, before))
            text.clear()
            links = 0
        before = tag

    def pop(k: int) -> None:
        nonlocal hidden
        hidden -= sum(o.tag in HIDDEN_TAGS for o in stack[k:])
        del stack[k:]

    last_end: dict[str, int] = {}

    def ends(tag: str, at: int) -> bool:
        """Whether a hidden element that starts before `at` has an end tag of its own."""
        if tag in NESTS:
            if tag not in last_end:
                last_end[tag] = lower.rfind("</" + tag)
            return last_end[tag] >= at
        found = re.compile(rf"<(/?){tag}\b").search(lower, at)
        return bool(found and found[1])

    lower = page.lower() if len(page.lower()) == n else page
    while at < n:
        m = _TAG.search(page, at)
        stop = m.start() if m else n
        if stop > at and hidden and stack[-1].tag == "head" and page[at:stop].strip():
            pop(len(stack) - 1)
        if stop > at and not hidden:
            piece = page[at:stop]
            text.append(piece)
            if in_link:
                links += len(piece)
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if tag == "a":
                in_link = 0
            elif tag in BLOCK_TAGS or tag in HIDDEN_TAGS:
                k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k].tag == tag), None)
                if tag in BLOCK_TAGS:
                    end_block("/" + tag)
                    in_link = 0
                if k is not None:
                    pop(k)
            continue
        if hidden and tag not in IN_HEAD and stack[-1].tag == "head":
            pop(len(stack) - 1)
        if hidden and tag in BLOCK_TAGS and tag not in CHOICES:
            k = next((k for k, o in enumerate(stack) if o.left_open), None)
            if k is not None:  # a hidden element without an end holds no block
                pop(k)
        if tag == "a":
            in_link = 1
        elif tag == "br":
            text.append(" ")
        elif tag in HIDDEN_TAGS:
            if tag in RAW_TAGS and (tag != "noscript" or ends(tag, at)):
                close = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
                at = close.end() if close else n
            elif not (m[3] or "").endswith("/"):
                stack.append(_Open(tag, (), tag != "head" and not ends(tag, at)))
                hidden += 1
        elif tag in BLOCK_TAGS:
            end_block(tag)
            if tag in VOID_TAGS:
                continue
            if stack and stack[-1].tag == "p":
                pop(len(stack) - 1)
            closes = CLOSES.get(tag)
            if closes:
                k = len(stack) - 1
                while k >= 0 and stack[k].tag not in ("ul", "ol", "dl", "table", "menu"):
                    if stack[k].tag in closes:
                        pop(k)
                        break
                    k -= 1
            stack.append(_Open(tag, names_of(m[3] or "")))
    end_block("")
    return out


# Labelled pages ------------------------------------------------------------

# Words that names of page parts are made of.
_MAIN = ("content", "main-content", "article-body", "post", "post-content", "entry-content", "story", "storytext", "body-text", "page-content", "article", "text", "main", "blog-post", "news-body")
_NAV = ("menu", "nav", "navbar", "navigation", "topnav", "main-menu", "breadcrumb", "breadcrumbs", "site-nav", "links", "tabs", "pagination")
_HEAD = ("header", "site-header", "masthead", "top", "banner", "branding", "logo", "topbar", "page-header")
_FOOT = ("footer", "site-footer", "bottom", "copyright", "colophon", "legal", "foot", "credits")
_SIDE = ("sidebar", "side", "aside", "widget", "right-column", "rail", "related", "popular", "trending", "recommended", "more-stories", "tags", "author-box")
_AD = ("ad", "ads", "advert", "advertisement", "sponsored", "promo", "promotion", "adsense", "banner-ad", "ad-slot", "partner", "sponsor")
_NOTICE = ("notice", "cookie", "cookie-notice", "cookie-banner", "consent", "alert", "gdpr", "disclaimer", "popup", "modal", "subscribe-notice", "warning", "message", "announcement", "privacy")
_FORM = ("form", "search", "search-form", "login", "newsletter", "subscribe", "signup", "contact-form", "subscription")
_TALK = ("comments", "comment", "comment-list", "reader-comments", "discussion", "responses", "replies", "reply", "disqus", "commentlist", "user-comments", "feedback", "reviews")
_SHARE = ("share", "social", "sharing", "share-buttons", "follow", "toolbar", "print", "meta-links")
_OTHER = ("wrap", "container", "row", "col", "inner", "outer", "section", "block", "box", "item", "left", "page", "wrapper", "layout", "grid", "clearfix", "site")
_SYLLABLES = "an er on the re in ti es ed or at en and th st al le de la que ion ment eau ou ie sch ung lich keit en ber ver ado mente cion os ar ra el".split()


class Author:
    """Makes pages whose blocks are labelled: 1 for the main text, 0 for the rest."""

    def __init__(self, seed: int):
        self.rng = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        r = self.rng
        return " ".join("".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 3))) for _ in range(r.randint(low, high)))

    def sentences(self, n: int) -> str:
        r = self.rng
        ends = ["."] * 8 + ["?", "!"]
        return " ".join(self.words(2, 22).capitalize() + r.choice(ends) for _ in range(max(1, n)))

    def named(self, tag: str, kind: tuple[str, ...], inner: str) -> str:
        r = self.rng
        name = r.choice(kind)
        roll = r.random()
        attr = f' class="{name}"' if roll < 0.55 else f' id="{name}"' if roll < 0.8 else f' class="{r.choice(_OTHER)} {name}"' if roll < 0.95 else f' id="{name}" class="{r.choice(_OTHER)}"'
        return f"<{tag}{attr}>{inner}</{tag}>"

    def p(self, low: int = 1, high: int = 6) -> str:
        r = self.rng
        s = self.sentences(r.randint(low, high))
        if r.random() < 0.2:
            w = s.split(" ")
            k = r.randrange(len(w))
            w[k] = f'<a href="/x">{w[k]}</a>'
            s = " ".join(w)
        if r.random() < 0.15:
            return f"<p><b>{s}<br>"
        return f"<p>{s}</p>" if r.random() < 0.9 else f"<p>{s}"

    def list_of_links(self) -> str:
        r = self.rng
        return "<ul>" + "".join(f'<li><a href="/{k}">{self.words(1, 4)}</a></li>' for k in range(r.randint(2, 9))) + "</ul>"

    def main_part(self) -> str:
        r = self.rng
        roll = r.random()
        if roll < 0.72:
            return self.p()
        if roll < 0.8:
            return f"<h{r.randint(2, 4)}>{self.words(1, 8).capitalize()}</h{r.randint(2, 4)}>"
        if roll < 0.86:
            return "<ul>" + "".join(f"<li>{self.sentences(1)}</li>" for _ in range(r.randint(2, 6))) + "</ul>"
        if roll < 0.9:
            return f"<blockquote>{self.p(1, 3)}</blockquote>"
        if roll < 0.93:
            return f"<pre>{self.words(3, 20)}</pre>"
        if roll < 0.96:
            return "<table>" + "".join(f"<tr><td>{self.words(1, 5)}</td><td>{self.words(1, 5)}</td></tr>" for _ in range(r.randint(2, 4))) + "</table>"
        return f"<div>{self.sentences(r.randint(1, 5))}</div>"

    def rest_part(self, inside: bool) -> str:
        r = self.rng
        text = lambda: r.choice((self.words(1, 6), self.sentences(1), self.sentences(r.randint(1, 4)), self.p(1, 3)))
        plain = "div" if r.random() < 0.75 else "section"
        kinds = [
            lambda: self.named("div", _AD, text()), lambda: self.named(r.choice(("aside", plain)), _SIDE, r.choice((text(), f"<h3>{self.words(1, 3)}</h3>" + self.list_of_links(), self.p(1, 4)))),
            lambda: f"<aside>{text()}</aside>", lambda: self.named(plain, _NOTICE, text()),
            lambda: self.named("form", _FORM, f"<label>{self.words(1, 3)}</label><input type='text'><p>{self.sentences(1)}</p>"), lambda: f"<form action='/s'>{text()}<input name='q'><button>{self.words(1, 2)}</button></form>",
            lambda: self.named(plain, _SHARE, self.list_of_links()), lambda: self.named("div", _FORM, f"<p>{self.sentences(1)}</p><form><input></form>"),
        ]
        if not inside:
            kinds += [lambda: f"<nav>{self.list_of_links()}</nav>", lambda: self.named("div", _NAV, self.list_of_links())]
        return r.choice(kinds)()

    def comments(self) -> str:
        r = self.rng
        tag, item = r.choice((("div", "div"), ("section", "article"), ("section", "div"), ("ol", "li"), ("ul", "li"), ("aside", "div")))
        one = lambda: f'<{item} class="comment">' + r.choice(("", f"<span class='author'>{self.words(1, 2)}</span> ", f"<h4>{self.words(1, 2)}</h4>")) + r.choice((self.p(1, 4), self.sentences(r.randint(1, 5)))) + f"</{item}>"
        return self.named(tag, _TALK, r.choice(("", f"<h3>{self.words(1, 3)}</h3>")) + "".join(one() for _ in range(r.randint(1, 5))))

    def page(self) -> str:
        """HTML in which a mark (see split_marks) stands before each part."""
        r = self.rng
        shell = r.choice(("article", "main", "div", "div", "section", "td", "none"))
        before, inside, after = [], [], []
        if r.random() < 0.8:
            before.append(r.choice((f"<header>{self.words(1, 5)}</header>", f"<header><h2>{self.words(1, 4)}</h2><p>{self.sentences(1)}</p></header>", self.named("div", _HEAD, r.choice((self.words(1, 5), f"<p>{self.sentences(1)}</p>"))))))
        if r.random() < 0.8:
            before.append(r.choice((f"<nav>{self.list_of_links()}</nav>", self.named("div", _NAV, self.list_of_links()), self.named("ul", _NAV, "".join(f'<li><a href="#">{self.words(1, 3)}</a></li>' for _ in range(5))))))
        before += [self.rest_part(False) for _ in range(r.choice((0, 0, 1, 1, 2)))]
        main = [f"<h1>{self.words(1, 14).capitalize()}</h1>"] if r.random() < 0.8 else []
        main += [self.main_part() for _ in range(r.randint(1, 14))]
        parts = [(x, 1) for x in main]
        for _ in range(r.choice((0, 0, 0, 1, 1, 2))):
            parts.insert(r.randint(1, len(parts)), (self.rest_part(True), 0))
        if r.random() < 0.35:
            if r.random() < 0.3:
                parts.append((self.comments(), 0))
            else:
                after.append(self.comments())
        after += [self.rest_part(False) for _ in range(r.choice((0, 0, 1, 1, 2)))]
        if r.random() < 0.9:
            after.append(r.choice((f"<footer>&copy; {self.words(1, 3)} {self.sentences(r.randint(1, 3))}</footer>", f"<footer><p>{self.sentences(r.randint(1, 3))}</p></footer>", self.named("div", _FOOT, r.choice((f"&copy; {self.words(1, 5)}", f"<p>{self.sentences(1)}</p>", self.list_of_links()))))))
        opened = {"article": "<article>", "main": "<main>", "td": "<table><tr><td>" + self.list_of_links() + "</td><td>", "none": ""}.get(shell) or f'<{shell} class="{r.choice(_MAIN)}">' if shell != "none" else ""
        closed = {"td": "</td></tr></table>", "none": ""}.get(shell, f"</{shell}>")
        if shell == "div" and r.random() < 0.4:
            opened, closed = f'<div class="{r.choice(_OTHER)}">' + opened, closed + "</div>"
        mark = lambda s, y: f"\x02{y}" + s
        body = "".join(mark(x, 0) for x in before) + opened + "".join(mark(x, y) for x, y in parts) + closed + "".join(mark(x, 0) for x in after)
        return f"<!DOCTYPE html><html><head><title>{self.words(1, 5)}</title><style>p{{margin:0}}</style></head><body>{body}" + r.choice(("</body></html>", ""))


def labelled(seed: int, n: int) -> list[tuple[list[Block], list[int]]]:
    """n pages made by seed, as blocks and labels."""
    author = Author(seed)
    out = []
    for _ in range(n):
        out.append(split_marks(author.page()))
    return out


def split_marks(page: str) -> tuple[list[Block], list[int]]:
    """Blocks of a page in which \\x02 and a digit stand before each part, with the part's digit for all its blocks."""
    got, labels, now = [], [], 0
    # a mark stands between elements, so it opens a text run that blocks() joins to the part's first text
    for b in blocks(re.sub("\x02([01])", lambda m: f"<p>\x02{m[1]}</p>", page)):
        if b.text[:1] == "\x02":
            now = int(b.text[1])
            continue
        got.append(b)
        labels.append(now)
    return got, labels
