"""Main text of web pages by a recurrent block labeller.

A page becomes a sequence of leaf blocks: text between tags that start or end a block, with the path
of open elements (tag names, class and id words). Each block's vector is the mean of learned vectors
of its hashed path entries, the mean of learned vectors of its hashed words, and its length and
share of link text. A bidirectional LSTM reads the sequence, so that every block is judged with all
of the page before and behind it, and labels it as main text or not.

There are no labelled pages; the net learns from weak ones. On at most FIT_PAGES pages chosen by a
hash of their id, blocks are labelled by their elements' meaning in HTML (article and main against
navigation, footers, asides, forms and class words of the kind). Since pages at hand need not show every
kind, each is also varied (its article's element renamed, notices, sidebars, forms and reader comments
of its own words added) and remade: its article's words are laid anew in headings, lists, quotes, tables,
definitions and figures, in an element that may have no telling name or be missing, among boilerplate
that may have none either. In these labels tell where a block was placed, whatever its element. Class
names are hidden by chance, and so are paths and words of single blocks, which leaves the blocks around
them to judge by. Fitting runs on the driver, extraction as a map over partitions.

Cases: null and empty html give empty text; markup that never closes is text or ends with the page;
pages without main blocks give empty text; repeated rows each get their row; null ids and urls are
kept; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import html
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIT_BYTES = 500_000
FIT_PAGES, EPOCHS, BATCH, RATE = 240, 12, 16, 0.015
#: Share of the varied pages that hide class names.
HIDDEN_NAMES = 0.15
#: Shares of blocks whose path and words are hidden in a step of fitting, so that the net reads what is around them.
UNSEEN = np.array([0.1, 0.8])
#: New pages made of the words of each page for fitting.
REMADE = 3
PATHS, WORDS, EMBED, HIDDEN, SCALARS = 1024, 1024, 12, 16, 3
INPUT = 2 * EMBED + SCALARS
#: Blocks in a batch of pages, filling included.
BATCH_BLOCKS = 8192
BATCH_BYTES = 8_000_000

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|template|noscript|textarea|iframe|svg)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)>|<[!?][^>]*>",
    re.S | re.I,
)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_NAME_WORD = re.compile(r"[a-z]+")
# Fixed values of HTML: elements without content, and those that leave a block whole.
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_CLOSES_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}

#: Elements and class words that tell boilerplate and main text apart in pages for fitting.
_OTHER_TAGS = frozenset("nav footer aside form head title button select menu dialog".split())
_OTHER_WORDS = frozenset("ad ads advert advertisement sponsor sponsored promo banner cookie consent notice alert sidebar menu nav navbar breadcrumb footer header masthead share social related newsletter subscribe signup login search comment comments reply replies disqus respond widget popup modal".split())
_MAIN_TAGS = frozenset(["article", "main"])
_MAIN_WORDS = frozenset("article content post entry story main body text".split())


class Block:
    __slots__ = ("path", "text", "words", "linked")

    def __init__(self, path, text, linked):
        self.path, self.text = path, text
        self.words = text.split(" ")
        self.linked = linked


def blocks_of(page: str) -> list[Block]:
    """The leaf blocks of a page in order."""
    out, parts, stack, at, links, linked = [], [], [], 0, 0, 0
    path: tuple = ()

    def end():
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(path, text, min(1.0, linked / len(text))))
            parts.clear()
        linked = 0

    def pop_to(i):
        del stack[i:]

    for m in _TOKEN.finditer(page):
        if m.start() > at:
            parts.append(page[at : m.start()])
            if links:
                linked += m.start() - at
        at = m.end()
        name = m["name"] or m["name2"]
        if not name:
            if m["raw"] and m["raw"].lower() not in ("svg",):
                end()
            continue
        name, closing = name.lower(), bool(m["end"] or m["end2"])
        if name in _INLINE:
            if name == "a":
                links = 0 if closing else 1
            continue
        end()
        if name in _VOID:
            continue
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    pop_to(i)
                    break
        else:
            if name in _CLOSES_P and stack and stack[-1][0] == "p":
                pop_to(len(stack) - 1)
            if name in _SAME and stack and stack[-1][0] in _SAME[name]:
                pop_to(len(stack) - 1)
            attrs = m["attrs"] or m["attrs2"] or ""
            named = [w for x in _NAMED.findall(attrs) for w in _NAME_WORD.findall("".join(x).lower())] if attrs else []
            stack.append((name, named))
            links = 0
        path = tuple(stack[i][0] for i in range(len(stack))), tuple(w for s in stack for w in s[1])
    if at < len(page):
        parts.append(page[at:])
    end()
    return out


def weak_label(block: Block) -> bool:
    tags, names = block.path or ((), ())
    if any(t in _OTHER_TAGS for t in tags) or any(w in _OTHER_WORDS for w in names) or ("header" in tags and not _MAIN_TAGS & {*tags}):
        return False
    return bool(_MAIN_TAGS & {*tags}) or any(w in _MAIN_WORDS for w in names) or "p" in tags


_MAIN = re.compile(r"<(article|main)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>", re.I)
_BODY = re.compile(r"<(body)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>", re.I)

#: What boilerplate says in its own words; half of the added boilerplate has one, all of it where nothing else tells it apart.
_MENU = ("Home", "Menu", "About us", "Contact", "News", "Log in", "Sign up", "Archive", "Next", "Previous", "Skip to content")
_NOTICE = ("We use cookies.", "Accept all cookies", "Please note: this site will be down.", "Cookie settings")
_ADVERT = ("Advertisement", "Sponsored", "Buy now", "Special offer")
_ASIDE = ("Related articles", "Read more", "Most read", "You may also like", "Tags", "About the author")
_COMMENT = ("Comments", "Leave a reply", "Reader comments", "Responses")
_SHARE = ("Share", "Tweet", "Follow us", "Print")
_LETTER = ("Subscribe to our newsletter", "Sign up", "Your email")
_FOOTER = ("All rights reserved.", "Copyright", "Privacy policy", "Terms of use", "Imprint")


class Maker:
    """Parts of pages, made of a given page's words by chance: boilerplate of many kinds, articles of many elements."""

    def __init__(self, page: str, rng: np.random.Generator):
        blocks = blocks_of(page)
        self.rng, self.words = rng, [w for b in blocks for w in b.words] or ["x"]
        self.texts = [b.words for b in blocks if weak_label(b)] or [["x"]]

    def pick(self, *x):
        return x[int(self.rng.integers(len(x)))]

    def often(self, share: float) -> bool:
        return self.rng.random() < share

    def some(self, least: int, most: int) -> str:
        return html.escape(" ".join(self.pick(*self.words) for _ in range(int(self.rng.integers(least, most + 1)))), quote=False)

    def head(self, text: str) -> str:
        return f"<{(t := self.pick('h2', 'h3', 'h4', 'h5'))}>{text}</{t}>"

    def links(self, cues=()) -> str:
        texts = [*cues, *(self.some(1, 4) for _ in range(int(self.rng.integers(2, 7))))]
        linked = [f"<a href='/{i}'>{t}</a>" for i, t in enumerate(texts)]
        return self.pick(
            lambda: "<ul>" + "".join(f"<li>{x}</li>" for x in linked) + "</ul>",
            lambda: self.pick(" ", " | ", " &middot; ").join(linked),
            lambda: "<p>" + self.pick(" ", " / ").join(linked) + "</p>",
            lambda: "".join(f"<div>{x}</div>" for x in linked),
        )()

    def boilerplate(self, kind: str) -> str:
        """A header, menu, notice, advert, search, sidebar, share, comments, letter or footer."""
        tags, names, cues = {
            "header": (("header",), ("header", "masthead", "banner"), ()),
            "menu": (("nav",), ("menu", "navbar", "breadcrumb"), _MENU),
            "notice": (("dialog", "aside"), ("cookie-notice", "cookie-banner", "consent", "notice", "alert"), _NOTICE),
            "advert": (("aside",), ("ad", "ads", "advert", "sponsored", "promo", "banner"), _ADVERT),
            "search": (("form",), ("search",), ()),
            "sidebar": (("aside",), ("sidebar", "related", "widget"), _ASIDE),
            "share": (("nav", "aside"), ("share", "social"), _SHARE),
            "comments": (("aside",), ("comments", "comment-list", "replies", "disqus"), _COMMENT),
            "letter": (("form",), ("newsletter", "login", "signup"), _LETTER),
            "footer": (("footer",), ("footer", "site-footer"), _FOOTER),
        }[kind]
        form = self.rng.random()
        cue = [self.pick(*cues)] if cues and (form > 0.7 or self.often(0.5)) else []
        said = " ".join(cue)
        long = self.some(3, 60)
        inner = {
            "header": lambda: self.pick(f"<a href='/'>{self.some(1, 3)}</a>", f"<div class='logo'>{self.some(1, 3)}</div>", f"<h1><a href='/'>{self.some(1, 3)}</a></h1>", self.head(self.some(1, 3)), f"<p>{self.some(1, 6)}</p>") + self.pick("", "", self.links([self.pick(*_MENU)]), f"<p>{self.some(2, 8)}</p>"),
            "menu": lambda: self.links(cue),
            "notice": lambda: f"<p>{said} {long}</p>" + self.pick("", f"<button>{self.some(1, 1)}</button>"),
            "advert": lambda: self.pick(f"{said} {long}", f"<p>{said} {long}</p>", f"<a href='/z'>{said} {long}</a>"),
            "search": lambda: f"<label>{self.some(1, 2)}</label><input name='q'><button>{self.pick('Search', 'Go', self.some(1, 1))}</button>",
            "sidebar": lambda: (self.head(said or self.some(1, 4)) if cue or self.often(0.5) else "") + self.pick(self.links(), f"<p>{long}</p>", f"<ul><li>{self.some(2, 6)}</li><li>{self.some(2, 6)}</li></ul>"),
            "share": lambda: self.links(cue),
            "comments": lambda: self.head(said or self.some(1, 3)) + "".join(self.pick("<div class='comment'><p>{}</p></div>", "<div><p>{}</p></div>", "<p>{}</p>", "<li>{}</li>").format(self.some(3, 40)) for _ in range(int(self.rng.integers(1, 5)))),
            "letter": lambda: f"<p>{said} {self.some(2, 10)}</p><input><button>{self.some(1, 1)}</button>",
            "footer": lambda: self.pick(f"<p>{said} {self.some(2, 20)}</p>", f"&copy; {self.some(1, 3)} {said}", self.links(cue), f"<p>&copy; {long}</p>"),
        }[kind]()
        if form < 0.4 or kind in ("search", "letter") and form < 0.8:
            tag = self.pick(*tags)
            return f"<{tag}>{inner}</{tag}>"
        if form < 0.7 or not (cue or "<a " in inner or kind in ("search", "letter")):
            tag = self.pick("div", "section")
            return f"<{tag} {self.pick('class', 'id')}='{self.pick(*names)}'>{inner}</{tag}>"
        return f"<div>{inner}</div>"

    def more(self, kinds: str, share: float) -> str:
        return "".join(self.boilerplate(k) for k in kinds.split() if self.often(share))

    def within(self, words: list[str]) -> str:
        """Main text as one of the elements that articles hold."""
        text = html.escape(" ".join(words), quote=False)
        cuts = sorted({0, len(words), *(int(i) for i in self.rng.integers(1, max(2, len(words)), int(self.rng.integers(1, 5))))} - {-1})
        parts = [html.escape(" ".join(words[i:j]), quote=False) for i, j in zip(cuts, cuts[1:])]
        half = (len(parts) + 1) // 2
        linked = html.escape(" ".join(words[:-3]), quote=False) + f" <a href='/w'>{html.escape(' '.join(words[-3:]), quote=False)}</a>"
        table = lambda t: f"<table>{'<caption>' + self.some(1, 4) + '</caption>' if self.often(0.3) else ''}<tr>" + "".join(f"<{t}>{x}</{t}>" for x in parts[:half]) + "</tr><tr>" + "".join(f"<td>{x}</td>" for x in parts[half:]) + "</tr></table>"
        return self.pick(
            *[lambda: f"<p>{text}</p>"] * 5,
            lambda: "".join(f"<p>{x}</p>" for x in parts),
            lambda: f"<p>{linked}</p>",
            lambda: f"<{(t := self.pick('ul', 'ol'))}>" + "".join(f"<li>{x}</li>" for x in parts) + f"</{t}>",
            lambda: "<ul>" + "".join(f"<li>{self.some(1, 5)}</li>" for _ in parts) + "</ul>",
            lambda: f"<blockquote>{self.pick('<p>' + text + '</p>', text)}</blockquote>",
            lambda: table(self.pick("th", "td")),
            lambda: "<dl>" + "".join(f"<dt>{self.some(1, 3)}</dt><dd>{x}</dd>" for x in parts) + "</dl>",
            lambda: f"<figure><img src='i'><figcaption>{self.some(2, 12)}</figcaption></figure><p>{text}</p>",
            lambda: f"<pre>{text}</pre>",
            lambda: f"<div>{self.pick('<p>' + text + '</p>', text)}</div>",
            lambda: f"<section>{self.head(self.some(1, 6))}<p>{text}</p></section>",
        )()

    def article(self) -> tuple[str, str]:
        """An article in an element of some kind, or none; boilerplate inside is in an aside of the second."""
        h1 = f"<{(t := self.pick('h1', 'h1', 'h2'))}>{self.some(2, 9)}</{t}>" if self.often(0.85) else ""
        h1 = f"<header>{h1}{self.pick('', '<p>' + self.some(3, 15) + '</p>')}</header>" if self.often(0.25) else h1
        shown = meant = h1
        for words in self.texts:
            part = (self.head(self.some(1, 7)) if self.often(0.3) else "") + self.within(words)
            other = self.more("advert share", 0.04)
            shown, meant = shown + part + other, meant + part + (f"<aside>{other}</aside>" if other else "")
        if self.often(0.3):
            shown, meant = (x + part for x, part in zip((shown, meant), [self.within(self.words[:8])] * 2))
        return self.framed(shown), f"<article>{self.framed(meant)}</article>"

    def framed(self, inner: str) -> str:
        if not hasattr(self, "frame"):
            odd = "".join(chr(97 + int(i)) for i in self.rng.integers(0, 26, 5))
            self.frame = self.pick("article", f"article class='{odd}'", "main", "main role='main'", "main><article", "div class='content'", "div class='post-body'", "section id='main-text'", "div class='entry'", f"div class='{odd}'", "div", "div", "div", "section", "", "")
        ends = "".join(f"</{x.split()[0]}>" for x in reversed(self.frame.split("><"))) if self.frame else ""
        return (f"<{self.frame}>" if self.frame else "") + inner + ends


def remade(page: str, rng: np.random.Generator) -> tuple[str, str]:
    """A new page of the page's words. The second has the same blocks, in article elements what was placed as main text, in asides what was not."""
    make = Maker(page, rng)
    before, after = make.more("notice header menu search advert", 0.45), make.more("share advert sidebar comments letter footer", 0.45)
    (shown, meant), (open_, close) = make.article(), make.pick(("", ""), ("", ""), ("<div>", "</div>"), ("<div class='wrapper'>", "</div>"))
    page = f"<html><head><title>{make.some(1, 8)}</title></head><body>{open_}" + "{}" + f"{close}</body></html>"
    return page.replace("{}", before + shown + after, 1), page.replace("{}", f"<aside>{before}</aside>{meant}<aside>{after}</aside>", 1)


def varied(page: str, rng: np.random.Generator) -> tuple[str, str]:
    """The page with its article's element renamed and other kinds of blocks added, by chance.

    The second page has the same blocks, with an article element where the article is and asides where blocks
    were added; labels are taken from it. A page without article or main keeps its elements and gets blocks
    at both ends of its body.
    """
    make = Maker(page, rng)
    main = _MAIN.search(page)
    first = main or _BODY.search(page)
    last = first and max(re.finditer(rf"</{first[1]}\s*>", page[first.end() :], re.I), key=lambda m: m.start(), default=None)
    if not last:
        return page, page
    top, inner, tail = page[: first.start()], page[first.end() : first.end() + last.start()], page[first.end() + last.end() :]
    before, after = make.more("notice header menu search advert", 0.4), make.more("share advert sidebar comments letter", 0.4)
    aside = lambda x: f"<aside>{x}</aside>"
    if not main:
        return top + first[0] + before + inner + after + last[0] + tail, top + first[0] + aside(before) + inner + aside(after) + last[0] + tail
    early, late = make.more("advert notice", 0.1), make.more("share advert letter comments", 0.1)
    shown, meant = early + inner + late, aside(early) + inner + aside(late)
    return top + before + make.framed(shown) + after + tail, top + aside(before) + f"<article>{make.framed(meant)}</article>" + aside(after) + tail


def _labelled(pairs, rng: np.random.Generator) -> tuple[list[list[Block]], list[np.ndarray]]:
    """Blocks of shown pages with labels of meant ones; class names are hidden in some that are not as they were."""
    blocks, labels = [], []
    for shown, meant, new in pairs:
        seen, true = blocks_of(shown), blocks_of(meant)
        if len(seen) != len(true):  # markup that only one of the elements closes
            seen = true
        if new and rng.random() < HIDDEN_NAMES:
            seen = [Block((b.path[0], ()) if b.path else b.path, b.text, b.linked) for b in seen]
        blocks.append(seen), labels.append(np.array([weak_label(b) for b in true], np.float32))
    return blocks, labels


def examples(pages: list[str]) -> tuple[list[list[Block]], list[np.ndarray]]:
    """Blocks and weak labels of each page, as it is and varied twice."""
    rng = np.random.default_rng(0)
    return _labelled(((*x, x[0] is not page) for page in pages for x in ((page, page), varied(page, rng), varied(page, rng))), rng)


def remade_examples(pages: list[str]) -> tuple[list[list[Block]], list[np.ndarray]]:
    """Blocks and labels by place of REMADE new pages of each page's words."""
    rng = np.random.default_rng(1)
    return _labelled(((*remade(page, rng), True) for page in pages for _ in range(REMADE)), rng)


def fitted(pages: list[str]) -> "BlockLabeller":
    kinds = examples(pages), remade_examples(pages)
    return BlockLabeller().fit(*(sum(x, []) for x in zip(*kinds)))


class Features:
    """Hashed ids and scalars of the blocks of many pages, laid end to end."""

    def __init__(self, pages: list[list[Block]]):
        self.lengths = np.array([len(p) for p in pages], np.int64)
        blocks = [b for p in pages for b in p]
        self.paths, self.path_sizes = self._flat([_path_ids(b.path) for b in blocks])
        self.words, self.word_sizes = self._flat([[zlib.crc32(w.encode()) % WORDS for w in b.words] for b in blocks])
        n = np.array([len(b.words) for b in blocks], np.float32)
        self.scalars = np.stack([np.log1p(n) / 4, np.array([b.linked for b in blocks], np.float32), np.log1p(np.array([len(b.text) for b in blocks], np.float32)) / 6], 1).astype(np.float32) if blocks else np.zeros((0, SCALARS), np.float32)

    @staticmethod
    def _flat(lists):
        sizes = np.array([len(x) for x in lists], np.int64)
        return np.array([y for x in lists for y in x], np.int64), sizes


_PATH_IDS: dict = {}


def _path_ids(path) -> list[int]:
    if path not in _PATH_IDS:
        if len(_PATH_IDS) > 20_000:
            _PATH_IDS.clear()
        tags, names = path or ((), ())
        entries = ["root"] + ["t:" + t for t in tags] + ["n:" + w for w in names] + ["leaf:" + t for t in tags[-1:]]
        _PATH_IDS[path] = [zlib.crc32(e.encode()) % PATHS for e in entries]
    return _PATH_IDS[path]


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class BlockLabeller:
    def __init__(self):
        rng = np.random.default_rng(0)
        weight = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s).astype(np.float32)
        self.p = {"path": rng.normal(0, 0.5, (PATHS, EMBED)).astype(np.float32), "word": rng.normal(0, 0.1, (WORDS, EMBED)).astype(np.float32), "out": weight(2 * HIDDEN), "shift": np.zeros(1, np.float32)}
        for d in "fb":
            self.p |= {f"w{d}": weight(INPUT, 4 * HIDDEN), f"u{d}": weight(HIDDEN, 4 * HIDDEN), f"c{d}": np.zeros(4 * HIDDEN, np.float32)}
            self.p[f"c{d}"][HIDDEN : 2 * HIDDEN] = 1  # remember at first

    def _inputs(self, f: Features):
        means = []
        for ids, sizes, name in ((f.paths, f.path_sizes, "path"), (f.words, f.word_sizes, "word")):
            means.append(np.add.reduceat(self.p[name][ids], np.cumsum(sizes) - sizes) / sizes[:, None])
        return np.concatenate([*means, f.scalars], 1).astype(np.float32)

    def _pad(self, flat: np.ndarray, lengths: np.ndarray):
        """(steps, pages, width) forwards and backwards, and where each block lies in both."""
        page = np.repeat(np.arange(len(lengths)), lengths)
        step = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        back = np.repeat(lengths, lengths) - 1 - step
        x, y = (np.zeros((int(lengths.max()), len(lengths), flat.shape[1]), np.float32) for _ in range(2))
        x[step, page], y[back, page] = flat, flat
        return x, y, (step, page), (back, page)

    def _states(self, x: np.ndarray, d: str) -> np.ndarray:
        """The outputs of one direction alone; gates are held for one step, so that long pages fit."""
        out = np.empty((*x.shape[:2], HIDDEN), np.float32)
        h = c = np.zeros((x.shape[1], HIDDEN), np.float32)
        for t, step in enumerate(x):
            g = step @ self.p[f"w{d}"] + self.p[f"c{d}"] + h @ self.p[f"u{d}"]
            i, f, o = np.split(_sigmoid(g[:, : 3 * HIDDEN]), 3, 1)
            c = f * c + i * np.tanh(g[:, 3 * HIDDEN :])
            out[t] = h = o * np.tanh(c)
        return out

    def _run(self, x: np.ndarray, d: str):
        h = c = np.zeros((x.shape[1], HIDDEN), np.float32)
        hs, cs, gs = [h], [c], []
        for t in range(len(x)):
            g = x[t] @ self.p[f"w{d}"] + self.p[f"c{d}"] + h @ self.p[f"u{d}"]  # products too small for idle threads to spin
            g[:, : 3 * HIDDEN] = _sigmoid(g[:, : 3 * HIDDEN])
            g[:, 3 * HIDDEN :] = np.tanh(g[:, 3 * HIDDEN :])
            i, f, o, n = np.split(g, 4, 1)
            c = f * c + i * n
            h = o * np.tanh(c)
            hs.append(h), cs.append(c), gs.append(g)
        return hs, cs, gs

    def _back(self, x, d, run, d_out):
        """Gradients of one direction; returns (d of its inputs, gradients)."""
        hs, cs, gs = run
        d_x, g = np.zeros_like(x), {k: np.zeros_like(self.p[k]) for k in (f"w{d}", f"u{d}", f"c{d}")}
        dh = dc = np.zeros((x.shape[1], HIDDEN), np.float32)
        for t in range(len(x) - 1, -1, -1):
            i, f, o, n = np.split(gs[t], 4, 1)
            dh = dh + d_out[t]
            tc = np.tanh(cs[t + 1])
            dc = dc + dh * o * (1 - tc * tc)
            d_gates = np.concatenate([dc * n * i * (1 - i), dc * cs[t] * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - n * n)], 1)
            dh, dc = d_gates @ self.p[f"u{d}"].T, dc * f
            d_x[t] = d_gates @ self.p[f"w{d}"].T
            g[f"w{d}"] += x[t].T @ d_gates
            g[f"u{d}"] += hs[t].T @ d_gates
            g[f"c{d}"] += d_gates.sum(0)
        return d_x, g

    def probabilities(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """The probability of main text of each block of each page."""
        out: list = [np.zeros(0)] * len(pages)
        order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
        while order:
            some = [order.pop()]
            longest = len(pages[some[0]])
            while order and (len(some) + 1) * longest <= BATCH_BLOCKS:
                some.append(order.pop())
            f = Features([pages[i] for i in some])
            x, y, at, back = self._pad(self._inputs(f), f.lengths)
            h = np.concatenate([self._states(x, "f")[at], self._states(y, "b")[back]], 1)
            p = _sigmoid(np.einsum("ij,j->i", h, self.p["out"]) + self.p["shift"])
            for i, q in zip(some, np.split(p, np.cumsum(f.lengths)[:-1])):
                out[i] = q
        return out

    def _gradient(self, f: Features, labels: np.ndarray, kept: np.ndarray | float = 1.0):
        """Gradients where blocks' words and paths are seen as far as ``kept`` says, one column each."""
        kept = np.broadcast_to(np.float32(kept), (len(labels), 2))
        seen = np.concatenate([np.repeat(kept, EMBED, axis=1), np.ones((len(labels), SCALARS), np.float32)], 1)
        flat = self._inputs(f) * seen
        x, y, at, back = self._pad(flat, f.lengths)
        forward, backward = self._run(x, "f"), self._run(y, "b")
        h = np.concatenate([np.stack(forward[0][1:])[at], np.stack(backward[0][1:])[back]], 1)
        d = ((_sigmoid(np.einsum("ij,j->i", h, self.p["out"]) + self.p["shift"]) - labels) / len(labels)).astype(np.float32)
        g = {"out": np.einsum("i,ij->j", d, h), "shift": d.sum(keepdims=True)}
        dh = d[:, None] * self.p["out"]
        d_in = np.zeros_like(flat)
        for name, xs, run, where, part in (("f", x, forward, at, dh[:, :HIDDEN]), ("b", y, backward, back, dh[:, HIDDEN:])):
            d_out = np.zeros((*xs.shape[:2], HIDDEN), np.float32)
            d_out[where] = part
            d_x, more = self._back(xs, name, run, d_out)
            d_in += d_x[where]
            g |= more
        d_in *= seen
        for name, ids, sizes, part in (("path", f.paths, f.path_sizes, d_in[:, :EMBED]), ("word", f.words, f.word_sizes, d_in[:, EMBED : 2 * EMBED])):
            g[name] = np.zeros_like(self.p[name])
            np.add.at(g[name], ids, np.repeat(part / sizes[:, None], sizes, axis=0))
        return g

    def fit(self, pages: list[list[Block]], labels: list[np.ndarray]) -> "BlockLabeller":
        some = [i for i, p in enumerate(pages) if p]
        rng, step = np.random.default_rng(1), 0
        parts = np.array_split(rng.permutation(some), -(-len(some) // BATCH)) if some else []
        batches = [Features([pages[i] for i in part]) for part in parts]
        labels = [np.concatenate([labels[i] for i in part]) for part in parts]
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        steps = EPOCHS * len(batches)
        for _ in range(EPOCHS):
            for i in rng.permutation(len(batches)):
                step += 1
                kept = rng.random((len(labels[i]), 2)) >= UNSEEN
                for k, g in self._gradient(batches[i], labels[i], kept).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] -= RATE * (1 - step / (steps + 1)) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self


def learn(pages: DataFrame, key: str = "page_id", text: str = "html") -> BlockLabeller:
    """Fit on at most FIT_PAGES pages of at most FIT_BYTES each, as they are, varied and remade."""
    known = pages.where(F.col(text).isNotNull() & F.col(key).isNotNull() & (F.octet_length(text) <= FIT_BYTES)).select(F.col(key).alias("id"), F.col(text).alias("t"))
    # Ids are chosen first, so that no more pages than these reach the driver; of repeated ids one.
    chosen = known.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(FIT_PAGES)
    rows = sorted(known.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("t").alias("t")).collect())
    return fitted([r.t for r in rows])


def main_texts(pages: list[str], net: BlockLabeller) -> list[str]:
    blocks = [blocks_of(p) for p in pages]
    return [" ".join(b.text for b, q in zip(bs, p) if q > 0.5) for bs, p in zip(blocks, net.probabilities(blocks))]


def extract(pages: DataFrame, net: BlockLabeller, key: str = "page_id", text: str = "html") -> DataFrame:
    """page_id, url and text of every row."""

    def run(batches):
        for batch in batches:
            ids, urls, raw = (batch.column(batch.schema.get_field_index(c)) for c in (key, "url", text))
            at, size, held = 0, 0, []
            for i, page in enumerate(raw):
                held.append(page.as_py() or "")
                size += len(held[-1])
                if size > BATCH_BYTES or i + 1 == len(raw):
                    yield pa.RecordBatch.from_arrays([ids.slice(at, len(held)).cast(pa.int64()), urls.slice(at, len(held)).cast(pa.string()), pa.array(main_texts(held, net), pa.string())], names=["page_id", "url", "text"])
                    at, size, held = i + 1, 0, []

    return pages.select(key, "url", text).mapInArrow(run, "page_id long, url string, text string")
