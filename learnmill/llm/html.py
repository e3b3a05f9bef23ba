"""Operator 1, HTML extraction: a linear-chain conditional random field over the leaf blocks of a page.

A page is cut into blocks: the text between two block-level tags, with its open ancestors. Each block is
described by its ancestors' tags and class words and by its text; a chain of two labels (main text or not) is
trained on labelled pages by the gradient of the conditional likelihood, and decoded by Viterbi. The labelled
pages are made here from a seed, in many layouts; nothing of the tables is looked at.
"""

from __future__ import annotations

import html
import math
import random
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map

#: Elements that stand inside a line, that have no content, and whose content is no text.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br img".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe xmp".split())
DROPPED = frozenset("noscript template svg math object select button datalist".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: Parts of class and id names that tell what a container is for.
HINTS = (
    "nav", "menu", "breadcrumb", "header", "banner", "masthead", "footer", "copyright", "sidebar", "aside", "widget", "related", "recommend", "advert", "sponsor", "promo",
    "cookie", "consent", "notice", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "signup", "form", "search", "login", "comment", "reply", "disqus", "discussion", "respons",
    "share", "social", "tag", "pagination", "pager", "toolbar", "skip", "meta", "byline", "author", "legal", "disclaimer", "article", "content", "post", "entry", "story", "body", "text", "main",
)
#: Words of short blocks that tell what they, or the blocks under them, are for.
TELLING = (
    "comment", "comments", "reply", "replies", "respond", "related", "recommended", "share", "read more", "read next", "more from", "you may also", "popular", "trending", "menu", "home",
    "log in", "login", "sign in", "sign up", "register", "subscribe", "newsletter", "search", "advertisement", "sponsored", "cookie", "cookies", "privacy", "terms", "contact", "previous", "next", "skip to",
    "all rights", "(c) ", "©", "copyright", "mailing list", "join", "accept", "follow us",
)
_HINT = re.compile("|".join(sorted(HINTS, key=len, reverse=True)))
_TELLING = [(x, re.compile(rf"(?<!\w){re.escape(x)}" + (r"(?!\w)" if x[-1].isalpha() else ""))) for x in TELLING]
_TAG = re.compile(
    r"<!--"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)>"
    r"|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*\Z",
    re.S,
)
_CLOSING = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I) for name in RAW | DROPPED}
_CLASS = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_ALONE = re.compile(r"(?:^|[\s\"'])/\Z")
_AD = re.compile(r"(?:^|[\s_-])ads?(?:[\s_-]|$)")
_WORD_END = re.compile(r"[.!?…。！？][\"'”’»)\]]*$")
_LISTS = frozenset("ul ol dl table menu nav".split())
_ITEMS = frozenset("li dt dd tr td th option".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
NONE = frozenset()


class Block:
    """text; the tags of the open block elements, and the innermost of them; what the containers' names tell; how many characters are
    links; what the heading tells that the block is under."""

    __slots__ = ("text", "tags", "tag", "hints", "link", "under")

    def __init__(self, text: str, tags: frozenset, tag: str, hints: frozenset, link: int, under: frozenset = frozenset()):
        self.text, self.tags, self.tag, self.hints, self.link, self.under = text, tags, tag, hints, link, under


def hints_of(attributes: str) -> frozenset:
    """What class, id and role, and hidden attributes tell of a container."""
    found: set[str] = set()
    if "=" in attributes:
        names = " ".join(x for g in _CLASS.findall(attributes) for x in g if x).lower()
        if names:
            found.update(_HINT.findall(names))
            if _AD.search(names):
                found.add("advert")
    if _HIDDEN.search(attributes):
        found.add("hidden")
    return frozenset(found) if found else NONE


def blocks_of(page: str | None) -> list[Block]:
    """The page's leaf blocks in order: text with its references decoded and white space made one space each. Every open element
    carries what it and its ancestors tell, so that time grows with the length of the page alone, however it nests."""
    if not page:
        return []
    out: list[Block] = []
    stack: list[tuple[str, frozenset, frozenset, str, int]] = []  # name, tags, hints and innermost block tag down to here, number
    made = 0
    under, scope = NONE, -1  # what the last heading tells, and the number of the element that holds it (0: the page)
    opened: dict[str, int] = {}
    unclosed: set[str] = set()
    parts: list[str] = []
    link = in_link = at = 0

    def flush():
        nonlocal link, under, scope
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                _, tags, hints, tag, _ = stack[-1] if stack else ("", NONE, NONE, "", 0)
                block = Block(text, tags, tag, hints, link)
                out.append(block)
                if tag in HEADINGS:
                    k = len(stack) - 1
                    while k and stack[k][0] in INLINE:
                        k -= 1
                    under = telling(text) if text.count(" ") < 5 else NONE
                    scope = stack[k - 1][4] if k else 0
                else:
                    block.under = under
            parts.clear()
        link = 0

    def add(raw: str):
        nonlocal link
        text = html.unescape(raw) if "&" in raw else raw
        parts.append(text)
        if in_link:
            link += len(text.strip())

    def shut(k: int):
        nonlocal under, in_link
        for entry in stack[k:]:
            opened[entry[0]] -= 1
            if entry[0] == "a":
                in_link = 0
            if entry[4] == scope:
                under = NONE
        del stack[k:]

    while m := _TAG.search(page, at):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            if m[0] == "<!--":
                end = page.find("-->", m.start() + 2)
                at = end + 3 if end >= 0 else len(page)
            continue
        name, closing, attributes = name.lower(), (m[1] or m[4]) == "/", m[3] or m[6] or ""
        if name == "br":
            parts.append(" ")
            continue
        if not closing and (name in RAW or name in DROPPED and name not in unclosed and not _ALONE.search(attributes)):
            end = _CLOSING[name].search(page, at)
            if end or name in RAW:
                at = end.end() if end else len(page)
                parts.append(" ")
                continue
            unclosed.add(name)
        inline = name in INLINE
        if not inline:
            flush()
        if closing:
            if opened.get(name):
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        shut(k)
                        break
                    if inline and stack[k][0] not in INLINE:
                        break
            continue
        if name in CLOSES_P:
            k = len(stack) - 1
            while k > 0 and stack[k][0] in INLINE and stack[k][3] in HEADINGS:
                k -= 1
            if k >= 0 and stack[k][0] in HEADINGS:  # a heading holds no blocks
                shut(k)
            if opened.get("p"):
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == "p":
                        shut(k)
                        break
                    if stack[k][0] not in INLINE:
                        break
        elif name in _ITEMS and opened.get(name):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    shut(k)
                    break
                if stack[k][0] in _LISTS:
                    break
        if name in VOID or _ALONE.search(attributes):
            continue
        # what the page's root is called tells nothing of its parts
        own = hints_of(attributes) if attributes and name not in ("html", "body") else NONE
        _, tags, hints, tag, _ = stack[-1] if stack else ("", NONE, NONE, "", 0)
        if not inline:
            tags, tag = tags if name in tags else tags | {name}, name
            under = NONE if name == "main" else under
        made += 1
        stack.append((name, tags, hints if own <= hints else hints | own, tag, made))
        opened[name] = opened.get(name, 0) + 1
        if name == "a":
            in_link = 1
    if at < len(page):
        add(page[at:])
    flush()
    return out


def telling(text: str) -> frozenset:
    """The telling words in a text: each is looked for as it is, and only where it is, as a word of its own."""
    low = text.lower()
    return frozenset([x for x, pattern in _TELLING if x in low and pattern.search(low)])


def features(block: Block) -> list[str]:
    text, tags = block.text, block.tags
    out = ["any"]
    out += ["in:" + t for t in tags if t not in ("html", "body")]
    out += ["hint:" + h for h in block.hints]
    out.append("tag:" + block.tag)
    if ("header" in tags or "header" in block.hints) and ("article" in tags or not block.hints.isdisjoint(("entry", "post", "article"))):
        out.append("article's header:" + ("title" if block.tag in HEADINGS else "rest"))
    n = text.count(" ") + 1
    out.append(f"words:{min(6, n.bit_length())}")
    share = block.link / len(text)
    out.append("link:all" if share > 0.8 else "link:some" if share > 0.2 else "link:few")
    out.append("end:stop" if _WORD_END.search(text) else "end:open")
    if "|" in text or "»" in text or "›" in text:
        out.append("bars")
    told = telling(text)
    if told:
        # in a short block such a word is nearly all there is
        out += [("tells:" if n <= 6 else "says:") + t for t in told]
        out.append("tells" if n <= 6 else "says")
    if block.under:
        out.append("under")
        out += ["under:" + t for t in block.under]
    return out


class Chain:
    """A conditional random field with labels 0 (other) and 1 (main). A feature's weight is for label 1 against 0. A page may begin with
    either label, so that a first block is judged by its features alone."""

    def __init__(self):
        self.weights: dict[str, float] = {}
        self.moves = [[0.0, 0.0], [0.0, 0.0]]

    def scores(self, rows: list[list[str]]) -> list[float]:
        get = self.weights.get
        return [sum([get(f, 0.0) for f in row]) for row in rows]

    def marginals(self, s: list[float]) -> tuple[list[float], list[list[float]]]:
        """P(label 1) of each block, and the expected moves, by forward and backward sums."""
        m = [[math.exp(x) for x in row] for row in self.moves]
        n = len(s)
        e = [math.exp(max(-30.0, min(30.0, x))) for x in s]
        f = [(0.0, 0.0)] * n
        a0, a1 = 1.0, e[0]
        f[0] = (a0 / (a0 + a1), a1 / (a0 + a1))
        for t in range(1, n):
            x0, x1 = f[t - 1]
            a0, a1 = x0 * m[0][0] + x1 * m[1][0], (x0 * m[0][1] + x1 * m[1][1]) * e[t]
            f[t] = (a0 / (a0 + a1), a1 / (a0 + a1))
        p, moves = [0.0] * n, [[0.0, 0.0], [0.0, 0.0]]
        b0 = b1 = 1.0
        for t in range(n - 1, -1, -1):
            z = f[t][0] * b0 + f[t][1] * b1
            p[t] = f[t][1] * b1 / z
            if t:
                both = [[f[t - 1][i] * m[i][j] * (e[t] * b1 if j else b0) for j in (0, 1)] for i in (0, 1)]
                z = sum(map(sum, both))
                for i in (0, 1):
                    for j in (0, 1):
                        moves[i][j] += both[i][j] / z
                b0, b1 = both[0][0] / f[t - 1][0] + both[0][1] / f[t - 1][0] if f[t - 1][0] else 0.0, (both[1][0] + both[1][1]) / f[t - 1][1] if f[t - 1][1] else 0.0
                scale = max(b0, b1) or 1.0
                b0, b1 = b0 / scale, b1 / scale
        return p, moves

    def viterbi(self, s: list[float]) -> list[int]:
        (m00, m01), (m10, m11) = self.moves
        back = []
        v0, v1 = 0.0, s[0]
        for x in s[1:]:
            from0 = 0 if v0 + m00 >= v1 + m10 else 1
            from1 = 0 if v0 + m01 > v1 + m11 else 1
            back.append((from0, from1))
            v0, v1 = (v1 + m10 if from0 else v0 + m00), (v1 + m11 if from1 else v0 + m01) + x
        path = [1 if v1 > v0 else 0]
        for b in reversed(back):
            path.append(b[path[-1]])
        return path[::-1]

    def train(self, pages: list[tuple[list[list[str]], list[int]]], rounds: int = 12, rate: float = 0.3, decay: float = 1e-3, seed: int = 1) -> None:
        order = random.Random(seed)
        pages = list(pages)
        for k in range(rounds):
            order.shuffle(pages)
            step = rate / (1 + k)
            for rows, labels in pages:
                p, moves = self.marginals(self.scores(rows))
                for row, y, q in zip(rows, labels, p, strict=True):
                    g = step * (y - q)
                    if abs(g) > 1e-6:
                        for f in row:
                            w = self.weights.get(f, 0.0)
                            self.weights[f] = w + g - step * decay * w
                for a, b in zip(labels, labels[1:], strict=False):
                    moves[a][b] -= 1
                for i in (0, 1):
                    for j in (0, 1):
                        self.moves[i][j] -= step * moves[i][j]


#: Pages extracted at once.
AT_ONCE = 100
#: Private-use characters that mark the texts of labelled pages.
MAIN, OTHER = "\ue000", "\ue001"


def labelled_page(r: random.Random) -> str:
    """A page in a random layout; every text starts with MAIN or OTHER."""
    letters = "etaoinshrdlucmfwypvbgk"

    def word():
        return "".join(r.choice(letters) for _ in range(r.randint(1, 9)))

    def words(n):
        return " ".join(word() for _ in range(n))

    def sentence(a=3, b=18):
        return words(r.randint(a, b)).capitalize() + r.choice([".", ".", ".", "!", "?"])

    def prose(mark, lo=1, hi=6):
        return mark + " ".join(sentence() for _ in range(r.randint(lo, hi)))

    def link(text):
        return f'<a href="/{word()}">{text}</a>'

    def cls(*names):
        name = r.choice(names)
        name = r.choice([name, name, name, f"{word()} {name}", f"site-{name}", f"{name}-{r.choice(['box', 'wrap', 'inner', 'list', 'block'])}", f"js-{name}"])
        return f' {r.choice(["class", "class", "id"])}={r.choice([chr(34), chr(39)])}{name}{{q}}'.replace("{q}", "Q")

    def quoted(page):
        """Closes each attribute with the mark that opened it."""
        return re.sub(r"(['\"])([^'\"<>]*?)Q", r"\1\2\1", page)

    def links(mark=OTHER, lo=2, hi=8):
        t = r.choice(["ul", "ul", "ul", "ol"])
        return f"<{t}>" + "".join(f"<li>{link(mark + words(r.randint(1, 4)))}</li>" for _ in range(r.randint(lo, hi))) + f"</{t}>"

    def menu():
        return r.choice([
            f"<nav>{links()}</nav>", f"<div{cls('menu', 'main-nav', 'navbar', 'topnav', 'toolbar')}>{links()}</div>", f"<nav{cls('breadcrumbs', 'menu')}>{link(OTHER + word())} <span>{OTHER}{word()}</span></nav>",
            f"<nav><p>{OTHER}{' | '.join(link(words(1)) for _ in range(4))}</p></nav>", f"<nav>{prose(OTHER, 1, 1)}</nav>", f"<a{cls('skip', 'skip-link')} href=#main>{OTHER}Skip to {word()}</a>",
            f"<div>{OTHER}{r.choice(['Home', 'Menu'])} | {' | '.join(link(words(1)) for _ in range(3))}</div>",
        ])

    def head():
        inner = r.choice([f"<h1>{OTHER}{words(2)}</h1>", f"<div{cls('logo', 'site-title')}>{OTHER}{words(2)}</div>", f"<p>{prose(OTHER, 1, 1)}</p>"])
        return r.choice([f"<header>{inner}{menu()}</header>", f"<div{cls('header', 'banner', 'masthead')}>{inner}</div>{menu()}", menu(), menu()])

    def foot():
        inner = r.choice([f"{OTHER}&copy; {word()} &middot; {sentence()}", f"<p>{OTHER}&copy; {r.randint(1999, 2030)} {words(3)}</p>", f"<p>{prose(OTHER, 1, 2)}</p>{links()}", links(), f"<p>{OTHER}Copyright {words(3)}. All rights reserved.</p>"])
        return r.choice([f"<footer>{inner}</footer>", f"<footer>{inner}</footer>", f"<div{cls('footer', 'copyright', 'legal', 'colophon footer')}>{inner}</div>"])

    def body_of(kind):
        return r.choice([lambda: prose(OTHER, 1, 3), lambda: f"<p>{prose(OTHER, 1, 3)}</p>", lambda: f"<p>{prose(OTHER, 1, 2)}</p><p>{prose(OTHER, 1, 2)}</p>", lambda: f"<h3>{OTHER}{kind or words(3)}</h3><p>{prose(OTHER)}</p>", lambda: link(OTHER + sentence()), lambda: f"{OTHER}{words(r.randint(1, 6))}", lambda: f"<span>{OTHER}{words(3)}</span>"])()

    def advert():
        return f"<{(t := r.choice(['div', 'div', 'section', 'aside']))}{cls('ad', 'ads', 'advert', 'ad-banner', 'sponsored', 'promo', 'advertisement', 'sponsor')}>{body_of('Advertisement')}</{t}>"

    def notice():
        inner = body_of("")
        if r.random() < 0.4:
            inner = f"<p>{OTHER}{r.choice(['We use cookies.', 'Please join our mailing list today.', 'Sign up for the newsletter.', 'Please subscribe.', 'Accept our terms.'])} {r.choice(['', sentence()])}</p>"
        names = ("cookie-banner", "notice", "alert", "consent", "site-notice", "popup", "newsletter", "disclaimer", "modal", "overlay", "signup", "subscribe", "legal", "modal-dialog", "toolbar")
        return f"<{(t := r.choice(['div', 'div', 'section', 'dialog']))}{cls(*names)}>{inner}</{t}>"

    def hidden():
        return f"<{(t := r.choice(['div', 'p', 'section', 'span']))}{r.choice([' hidden', ' style=%sdisplay:none%s' % (chr(34), chr(34)), ' aria-hidden=true'])}>{prose(OTHER, 1, 3)}</{t}>"

    def form():
        return f"<form{r.choice(['', cls('search', 'login-form', 'subscribe', 'form')])}><{(t := r.choice(['label', 'p', 'div']))}>{OTHER}{r.choice([words(2), sentence()])}</{t}><input name=q><button>{word()}</button></form>"

    def side():
        body = "".join(r.choice([lambda: f"<h3>{OTHER}{words(2)}</h3>{links()}", lambda: f"<p>{prose(OTHER, 1, 4)}</p>", advert, lambda: f"<div>{prose(OTHER, 1, 3)}</div>"])() for _ in range(r.randint(1, 3)))
        return r.choice([f"<aside>{body}</aside>", f"<aside>{body}</aside>", f"<div{cls('sidebar', 'right-sidebar', 'widget', 'related', 'recommended', 'aside')}>{body}</div>"])

    def related():
        return f"<h{(h := r.randint(2, 4))}>{OTHER}{r.choice(['Related', 'Read next', 'More from us', 'You may also like', 'Popular', 'Recommended'])}</h{h}>{links()}"

    def comments():
        def one(t, name):
            return f"<{t}{name}>{r.choice(['', f'<h4>{OTHER}{word()}</h4>', f'<span>{OTHER}{word()}</span>', f'<cite>{OTHER}{word()}</cite>'])}<p>{prose(OTHER, 1, 5)}</p></{t}>"

        kind = r.random()
        title = f"<h{(h := r.randint(2, 4))}>{OTHER}{r.choice(['Comments', '3 Comments', 'Replies', 'Leave a reply', 'Reader comments'])}</h{h}>"
        if kind < 0.3:  # only the heading tells
            t = r.choice(["ol", "ul", "div", "section"])
            inner = "li" if t in ("ol", "ul") else r.choice(["div", "article"])
            return title + f"<{t}>" + "".join(one(inner, "") for _ in range(r.randint(1, 4))) + f"</{t}>"
        body = "".join(one(r.choice(["div", "li", "article", "section"]), r.choice(["", cls("comment", "reply", "comment-body")])) for _ in range(r.randint(1, 4)))
        return f"<{(t := r.choice(['section', 'div', 'ol', 'aside']))}{cls('comments', 'comment-list', 'disqus', 'responses', 'discussion')}>{r.choice(['', title])}{body}</{t}>"

    def share():
        return f"<div{cls('share', 'social-links', 'tags', 'meta', 'byline', 'pagination', 'pager', 'author', 'author-bio')}>{r.choice([link(OTHER + word()) + ' ' + link(word()), OTHER + words(3), prose(OTHER, 1, 1)])}</div>"

    def piece():
        k = r.random()
        if k < 0.03:
            return f"<p>{MAIN}{words(6)} {r.choice(['cookie', 'cookies', 'newsletter', 'subscribe', 'sponsored', 'comments', 'search', 'share', 'home', 'next', 'privacy', 'terms'])} {words(7)}. {sentence()}</p>"
        if k < 0.06:
            return f"<p>{MAIN}{words(r.randint(1, 2)).capitalize()} {r.choice(['home', 'search', 'share', 'next', 'join', 'contact', 'terms', 'reply', 'popular', 'comments'])} {words(r.randint(1, 2))}.</p>"
        if k < 0.58:
            return f"<p>{prose(MAIN)}" + r.choice(["</p>", "</p>", "</p>", ""])
        if k < 0.66:
            return f"<p><b>{prose(MAIN, 1, 2)}<br>"
        if k < 0.73:
            return f"<h{(h := r.randint(2, 4))}>{MAIN}{words(r.randint(1, 6))}</h{h}>"
        if k < 0.79:
            return f"<{(t := r.choice(['ul', 'ol']))}>" + "".join(f"<li>{MAIN}{r.choice([sentence(), words(3)])}</li>" for _ in range(r.randint(2, 5))) + f"</{t}>"
        if k < 0.83:
            return f"<blockquote>{r.choice(['', '<p>'])}{prose(MAIN, 1, 3)}</blockquote>"
        if k < 0.87:
            return f"<div>{prose(MAIN)}</div>"
        if k < 0.9:
            return f"<p>{MAIN}{sentence()} {link(words(2))} {sentence()}</p>"
        if k < 0.94:
            return f"<p>{MAIN}{words(r.randint(1, 8))}</p>"
        if k < 0.95:
            return f"<p>{MAIN}{r.choice(['All rights reserved.', 'Licensed under ' + words(2) + '.', ' | '.join(word() for _ in range(9))])}</p>"
        if k < 0.97:
            return "<table><tr>" + "".join(f"<td>{MAIN}{words(2)}</td>" for _ in range(3)) + "</tr></table>"
        if k < 0.985:
            return f"<figure><img src=x><figcaption>{MAIN}{r.choice([sentence(), words(4)])}</figcaption></figure>"
        return f"<pre>{MAIN}{words(8)}</pre>"

    kind = r.random()
    if kind < 0.1:  # text alone
        return r.choice(["", "", "<body>"]) + (prose(MAIN, 1, 4) if r.random() < 0.5 else f"{MAIN}{words(r.randint(1, 9))}")
    if kind < 0.22:  # a fragment without anything round it
        short = lambda: f"<p>{MAIN}{r.choice([words(r.randint(1, 4)), sentence()])}</p>"
        inner = "".join(r.choice([short, piece])() for _ in range(r.randint(1, 4)))
        title = r.choice(["", f"<h1>{MAIN}{words(r.randint(1, 6))}</h1>"])
        around = r.choice(["{}", "{}", "<body>{}</body>", "<html><body>{}</body></html>", "<article>{}</article>", "<main>{}</main>", "<div>{}</div>"])
        return around.format(title + inner)
    title = f"<h{(h := r.choice([1, 1, 1, 2]))}>{MAIN}{words(r.randint(1, 9))}{r.choice(['', '.'])}</h{h}>"
    titled = r.random() < 0.2
    if titled:  # the article's own header: its title belongs to it, the rest is about it
        about = r.choice(["", f"<p>{OTHER}{words(3)}</p>", f"<div{cls('meta', 'byline', 'author')}>{OTHER}{words(3)}</div>"])
        title = r.choice([f"<header>{title}{about}</header>", f"<header{cls('entry-header', 'post-header', 'article-header')}>{title}{about}</header>"])
    inner = [title] * r.choice([1, 1, 1, 0]) + [piece() for _ in range(r.randint(1, 12))]
    for extra, chance in ((advert, 0.25), (notice, 0.25), (share, 0.25), (side, 0.15), (form, 0.1), (hidden, 0.2)):
        if r.random() < chance:
            inner.insert(r.randint(min(1, len(inner)), len(inner)), extra())
    for extra, chance in ((related, 0.08), (comments, 0.15)):
        if r.random() < chance:
            inner.append(extra())
    body = "".join(inner)
    main = r.choice([
        f"<article>{body}</article>", f"<article>{body}</article>", f"<main><article>{body}</article></main>", f"<main>{body}</main>", f"<div{cls('content', 'post', 'entry-content', 'article-body', 'story', 'main-text', 'post-body')}>{body}</div>",
        f"<article{cls('post', 'entry', 'story')}><div{cls('entry-content', 'body')}>{body}</div></article>", f"<div><div>{body}</div></div>", f"<section{cls('content', 'main')}>{body}</section>", body,
        f"<div{cls('wrapper', 'container', 'page')}>{body}</div>",
    ])
    if titled:
        main = r.choice([f"<article>{body}</article>", f"<main><article{cls('post', 'entry')}>{body}</article></main>"])
    if r.random() < 0.06:
        main = f"<table><tr><td{cls('menu', 'sidebar', 'nav')}>{r.choice(['<br>', ' ']).join(link(OTHER + words(1)) for _ in range(r.randint(1, 4)))}</td><td{r.choice(['', cls('content', 'main')])}>{body}</td></tr></table>"
    if r.random() < 0.25:
        main = f"<{(t := r.choice(['div', 'main', 'section']))}{r.choice(['', cls('content', 'main', 'primary content')])}>{main}{r.choice([comments, comments, comments, related, share, notice])()}</{t}>"
    before = [head()] * (r.random() < 0.7) + [x() for x, c in ((advert, 0.4), (notice, 0.3), (form, 0.15), (side, 0.2), (hidden, 0.1), (menu, 0.15)) if r.random() < c]
    after = [x() for x, c in ((advert, 0.2), (side, 0.3), (related, 0.15), (comments, 0.4), (form, 0.2), (notice, 0.2), (hidden, 0.1)) if r.random() < c] + [foot()] * r.choice([1, 1, 1, 0])
    page = f"<!DOCTYPE html><html><head><title>{words(3)}</title><script>var a='</p>';</script></head><body>{''.join(before)}{main}{''.join(after)}"
    return quoted(page + r.choice(["</body></html>", "</body></html>", ""]))


def training_set(n: int, seed: int) -> list[tuple[list[list[str]], list[int]]]:
    r, out = random.Random(seed), []
    while len(out) < n:
        blocks = blocks_of(labelled_page(r))
        labels = [1 if b.text[0] == MAIN else 0 for b in blocks]
        for b in blocks:
            b.text = b.text.replace(MAIN, "").replace(OTHER, "").strip() or "-"
        if blocks:
            out.append(([features(b) for b in blocks], labels))
    return out


@lru_cache(maxsize=2)
def trained(n: int = 1200, seed: int = 7) -> Chain:
    chain = Chain()
    chain.train(training_set(n, seed))
    return chain


def extract(page: str | None, chain: Chain) -> str:
    """Main text of a page: the blocks that the best path labels as main, joined by one space."""
    blocks = blocks_of(page)
    if not blocks:
        return ""
    path = chain.viterbi(chain.scores([features(b) for b in blocks]))
    return " ".join(b.text for b, y in zip(blocks, path, strict=True) if y)


def main_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",), chain: Chain | None = None) -> DataFrame:
    """Rows (id_col, *keep, text, n_chars), one for each input row; text is empty for null or empty pages and those
    without main text; n_chars counts its code points. Rows are taken one by one, so repeats and order don't matter and null ids stay; columns not in keep are
    ignored, whatever their names. Pages of any length are read whole, in time that grows with their length; an empty table gives an empty one."""
    chain = chain or trained()
    columns = [id_col, *keep]

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, AT_ONCE):
                some = batch.slice(start, AT_ONCE)
                texts = [extract(p, chain) for p in some.column(some.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*some.columns[:-1], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*columns, "text", "n_chars"])

    schema = pages.select(*columns).schema.add("text", "string").add("n_chars", "long")
    return arrow_map(pages.select(*columns, html_col), run, schema)
