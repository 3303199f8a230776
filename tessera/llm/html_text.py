"""HTML extraction: a recurrent labeller of blocks.

A page is cut into blocks: runs of text between block-level tags. A block is described by its tag path and its words,
both hashed into vectors, and a few numbers; a bidirectional LSTM, written in numpy, reads the sequence of a page's
blocks and gives each a probability to belong to the main text, so that every decision sees the whole document. The
network is trained here on generated pages of many layouts whose labels are known. Pages don't leave their partition.

Time and memory grow with a page's length, however deep its elements lie and whatever is never closed; a page of very many
blocks is read in runs. (Only quotes placed so that every tag seems to go on to the page's end take longer.)

Defined results: a null or empty html, or one without main text, gives an empty text; tags that are never closed end
with the page, but one that would hide the rest (all but script, style and textarea) hides nothing; an unknown character reference stays as it is; rows that repeat an id are each read; an empty frame gives
an empty frame; extra columns are ignored.
"""

from __future__ import annotations

import html as _html
import random
import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessera.llm._common import U64, chunks, words

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*+)>""", re.S)
#: A tag that the page's end cuts off; any other "<" is text.
_UNFINISHED = re.compile(r"<[a-zA-Z/!?]")
_NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
#: Fixed values of HTML: elements whose text isn't shown, void elements, inline ones, and what an opening tag closes.
RAW = frozenset(("script", "style", "template", "svg", "textarea", "annotation", "annotation-xml"))
FOREIGN, TO_THE_END = frozenset(("svg", "annotation", "annotation-xml")), frozenset(("script", "style", "textarea"))
_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: A formula is read as part of the line that it stands in; annotations repeat it as source and aren't shown.
MATH = frozenset("maction math menclose merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split()) | MATH
CLOSED_BY_BLOCK = frozenset("p h1 h2 h3 h4 h5 h6".split())
SIBLINGS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "tbody", "thead"), "td": ("tr",), "th": ("tr",), "option": ("select",)}


class Place:
    """Where a block stands: the innermost element that isn't inline, by its names and those around it.

    Elements that add no new name share the vector of the one around them, so deep pages stay small.
    """

    __slots__ = ("leaf", "over", "vector")

    def __init__(self, leaf: str, over: str, vector: np.ndarray):
        self.leaf, self.over, self.vector = leaf, over, vector


class _Open:
    """The elements that are open, innermost last; what closes is found without a search through all of them."""

    def __init__(self):
        self.stack: list[list] = []  # [tag, place around it, new names, whether it is open, depth]
        self.solid: list[list] = []  # those of them that aren't inline
        self.of: dict[str, list[list]] = {}
        self.named: Counter[str] = Counter()
        self.place = Place("", "", np.zeros(PATH_DIMS, np.float32))
        self.links = 0

    def has(self, *tags: str) -> bool:
        return any(self.of.get(t) for t in tags)

    def push(self, tag: str, more: list[str]) -> None:
        entry = [tag, self.place, [], True, len(self.stack)]
        self.stack.append(entry)
        self.of.setdefault(tag, []).append(entry)
        if tag in INLINE:
            self.links += tag == "a"
            return
        self.solid.append(entry)
        names = [f"in:{tag}", *(f"named:{x}" for x in dict.fromkeys(more))]
        entry[2] = names
        new = [x for x in names if not self.named[x]]
        self.named.update(names)
        vector = self.place.vector
        if new:
            vector = vector.copy()
            for x in new:
                _add(vector, x)
        self.place = Place(tag, f"{self.place.leaf}>{tag}" if self.place.leaf else tag, vector)

    def pop(self) -> None:
        tag, place, names, is_open, _ = self.stack.pop()
        if is_open:
            self.of[tag].pop()
            self.links -= tag == "a"
        if tag not in INLINE:
            self.solid.pop()
            self.place = place
            self.named.subtract(names)

    def close_inline(self, tag: str) -> None:
        if self.of.get(tag):
            entry = self.of[tag].pop()
            entry[3] = False
            self.links -= tag == "a"
            while self.stack and not self.stack[-1][3]:
                self.pop()

    def inmost(self, tags: tuple[str, ...]) -> list | None:
        """The innermost open element of some tags (not inline ones)."""
        return max((self.of[t][-1] for t in tags if self.of.get(t)), key=lambda e: e[4], default=None)

    def close(self, entry: list) -> None:
        """Close an element and all within it."""
        while True:
            last = self.stack[-1]
            self.pop()
            if last is entry:
                return


def blocks(page: str) -> list[tuple[Place, str, float]]:
    """(place, text, share of linked characters) of every block with text, in page order."""
    out: list[tuple[Place, str, float]] = []
    opened = _Open()
    parts: list[str] = []
    linked, at = 0, 0
    place = opened.place

    def flush():
        nonlocal linked
        if parts:
            text = " ".join(_html.unescape("".join(parts)).split())
            if text:
                out.append((place, text, min(1.0, linked / len(text))))
            parts.clear()
        linked = 0

    def text(piece: str):
        nonlocal linked, place
        if piece:
            if not parts:
                place = opened.place
            parts.append(piece)
            if opened.links > 0:
                linked += len(piece.strip())

    last, missing = page.rfind(">") + 1, set()  # no tag ends beyond; elements whose end doesn't come any more
    while m := _TAG.search(page, at, last) if at < last else None:
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        if at == last and m[0].startswith("<!--") and (len(m[0]) < 7 or not m[0].endswith("-->")):
            at = len(page)  # a comment that never ends
        name = m[2]
        if name is None:
            continue
        name = name.lower()
        if m[1]:
            if name in INLINE:
                opened.close_inline(name)
                continue
            flush()
            if opened.has(name):
                opened.close(opened.of[name][-1])
            continue
        if name in RAW:
            if name in FOREIGN and m[3].rstrip().endswith("/"):  # foreign elements close themselves
                continue
            end = None if name in missing else _END[name].search(page, at)
            if not end:
                missing.add(name)
            if end or name in TO_THE_END:
                at = end.end() if end else (at if m[3].rstrip().endswith("/") else len(page))
            continue  # another one that is never closed hides nothing
        if name in VOID:
            if name == "hr":
                flush()
            elif parts:
                parts.append(" ")
            continue
        if m[3].rstrip().endswith("/") and (name not in INLINE or name in MATH):
            continue
        if name not in INLINE:
            flush()
            for entry in reversed(opened.solid) if opened.has(*CLOSED_BY_BLOCK) else ():
                if entry[0] not in CLOSED_BY_BLOCK:
                    break
                if entry[0] == "p" or name in CLOSED_BY_BLOCK or name in ("article", "section", "footer", "nav", "header", "aside"):
                    opened.close(entry)
                    break
            like = opened.inmost(("dt", "dd") if name in ("dt", "dd") else ("td", "th") if name in ("td", "th") else (name,)) if name in SIBLINGS else None
            if like and ((around := opened.inmost(SIBLINGS[name])) is None or around[4] < like[4]):
                opened.close(like)
        more = [p.lower() for _, a, b, c in _NAMED.findall(m[3]) for p in _PIECE.findall(a or b or c)] if m[3] and name not in INLINE else []
        opened.push(name, more)
    if (hidden := page.find("<!--", at)) >= 0:
        text(page[at:hidden])
    elif not _UNFINISHED.match(page, at):
        text(page[at:])
    flush()
    return out


# vectors

PATH_DIMS, WORD_DIMS, NUMBERS = 128, 24, 9
DIMS = PATH_DIMS + WORD_DIMS + NUMBERS


@lru_cache(1 << 14)
def _spots(name: str) -> tuple[tuple[int, float], ...]:
    h = zlib.crc32(name.encode())  # two places each, so that names differ even where one place is shared
    return tuple(((h >> k) % PATH_DIMS, 1.0 if (h >> (k + 9)) & 1 else -1.0) for k in (0, 11))


def _add(vector: np.ndarray, name: str) -> None:
    for at, sign in _spots(name):
        vector[at] += sign


def vectors(pages: list[list[tuple[Place, str, float]]], first: int = 0, total: int | None = None) -> np.ndarray:
    """One row for each block of all pages, in order. A run of a page's blocks is given with the place of its first
    among `total`."""
    flat = [b for p in pages for b in p]
    x = np.zeros((len(flat), DIMS), np.float32)
    if not flat:
        return x
    for i, (place, _, _) in enumerate(flat):
        x[i, :PATH_DIMS] = place.vector
        _add(x[i], "over:" + place.over)
        if place.leaf:
            _add(x[i], "leaf:" + place.leaf)
    column = pa.array([t for _, t, _ in flat], pa.large_string())
    n_words = np.zeros(len(flat))
    for at, offsets, data in chunks(column):
        _, _, row, h = words(offsets, data, lower=True)
        n = len(offsets) - 1
        sign = ((h >> U64(40)) & U64(1)).astype(np.float32) * 2 - 1
        x[at : at + n, PATH_DIMS : PATH_DIMS + WORD_DIMS] = np.bincount(row * WORD_DIMS + (h % U64(WORD_DIMS)).astype(np.int64), sign, n * WORD_DIMS).reshape(n, WORD_DIMS)
        n_words[at : at + n] = np.bincount(row, minlength=n)
    x[:, PATH_DIMS : PATH_DIMS + WORD_DIMS] /= np.sqrt(np.maximum(n_words, 1))[:, None]
    chars = np.array([len(t) for _, t, _ in flat], float)
    own = x[:, PATH_DIMS + WORD_DIMS :]
    own[:, 0] = np.log1p(chars) / 4
    own[:, 1] = np.log1p(n_words) / 3
    own[:, 2] = [s for _, _, s in flat]
    own[:, 3] = [sum(map(t.count, ".,!?")) / len(t) * 10 for _, t, _ in flat]
    own[:, 4] = ["\xa9" in t for _, t, _ in flat]
    own[:, 5] = np.concatenate([(np.arange(len(p)) + first) / (total or len(p)) for p in pages if p])
    own[:, 6] = np.concatenate([np.full(len(p), min(total or len(p), 200) / 50) for p in pages if p])
    own[:, 7] = [t[:1].isupper() for _, t, _ in flat]
    own[:, 8] = 1
    return x


# the network

HIDDEN = 20
#: Pages of more blocks are read in runs of so many.
LONG_PAGE = 8192


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """A bidirectional LSTM with one output for each block."""

    def __init__(self, seed: int = 11):
        r = np.random.default_rng(seed)
        self.p = {}
        for d in "fb":
            self.p[f"x{d}"] = r.normal(0, DIMS**-0.5, (DIMS, 4 * HIDDEN)).astype(np.float32)
            self.p[f"h{d}"] = r.normal(0, HIDDEN**-0.5, (HIDDEN, 4 * HIDDEN)).astype(np.float32)
            self.p[f"c{d}"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]).astype(np.float32)
        self.p["o"] = r.normal(0, (2 * HIDDEN) ** -0.5, 2 * HIDDEN).astype(np.float32)
        self.p["q"] = np.zeros(1, np.float32)

    def _run(self, x, d, keep=False):
        """States over time of (pages, length, dims); later positions than a page has don't reach back."""
        n, length, _ = x.shape
        z = x @ self.p[f"x{d}"] + self.p[f"c{d}"]
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        out, kept = np.zeros((n, length, HIDDEN), np.float32), []
        for k in range(length):
            g = z[:, k] + h @ self.p[f"h{d}"]
            i, f, o = (_sigmoid(g[:, s * HIDDEN : (s + 1) * HIDDEN]) for s in range(3))
            u = np.tanh(g[:, 3 * HIDDEN :])
            before, c = c, f * c + i * u
            t = np.tanh(c)
            if keep:
                kept.append((h, before, i, f, o, u, t))
            h = o * t
            out[:, k] = h
        return out, kept

    @staticmethod
    def _turned(x, lengths):
        """Each page's rows in reverse order, padding last."""
        at = np.arange(x.shape[1])[None, :]
        return np.take_along_axis(x, np.where(at < lengths[:, None], lengths[:, None] - 1 - at, at)[..., None], axis=1)

    def forward(self, x, lengths, keep=False):
        f, kf = self._run(x, "f", keep)
        b, kb = self._run(self._turned(x, lengths), "b", keep)
        h = np.concatenate([f, self._turned(b, lengths)], axis=2)
        return h @ self.p["o"] + self.p["q"], h, kf, kb

    def _back(self, x, d, dh_all, kept, grads):
        n, length, _ = x.shape
        dh, dc = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        dz = np.zeros((n, length, 4 * HIDDEN), np.float32)
        for k in range(length - 1, -1, -1):
            before_h, before_c, i, f, o, u, t = kept[k]
            dh = dh + dh_all[:, k]
            dc = dc + dh * o * (1 - t * t)
            g = np.concatenate([dc * u * i * (1 - i), dc * before_c * f * (1 - f), dh * t * o * (1 - o), dc * i * (1 - u * u)], axis=1)
            dz[:, k] = g
            grads[f"h{d}"] += before_h.T @ g
            dh, dc = g @ self.p[f"h{d}"].T, dc * f
        grads[f"x{d}"] += np.tensordot(x, dz, ([0, 1], [0, 1]))
        grads[f"c{d}"] += dz.sum(axis=(0, 1))

    def gradients(self, x, y, lengths):
        real = np.arange(x.shape[1])[None, :] < lengths[:, None]
        s, h, kf, kb = self.forward(x, lengths, keep=True)
        d = ((_sigmoid(s) - y) * real / real.sum()).astype(np.float32)
        grads = {k: np.zeros_like(v) for k, v in self.p.items()}
        grads["o"], grads["q"] = np.tensordot(d, h, ([0, 1], [0, 1])), d.sum(keepdims=True)[0]
        dh = d[..., None] * self.p["o"]
        self._back(x, "f", dh[..., :HIDDEN], kf, grads)
        self._back(self._turned(x, lengths), "b", self._turned(dh[..., HIDDEN:], lengths), kb, grads)
        return grads

    def label_long(self, page) -> np.ndarray:
        """The same for one page of very many blocks: both directions read it in runs and hand on their state, so that
        vectors are held for one run at a time."""
        n, total = len(page), np.full(len(page), self.p["q"][0], np.float32)
        for d, side in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, None))):
            state = None
            starts = range(0, n, LONG_PAGE)
            for start in starts if d == "f" else reversed(starts):
                x = vectors([page[start : start + LONG_PAGE]], start, n)[None]
                h, state = self._walk(x if d == "f" else x[:, ::-1], d, state)
                own = h[0] @ self.p["o"][side]
                total[start : start + LONG_PAGE] += own if d == "f" else own[::-1]
        return total > 0

    def _walk(self, x, d, state):
        """States over time of (pages, length, dims) from a state, and the last one."""
        z = x @ self.p[f"x{d}"] + self.p[f"c{d}"]
        h, c = state or (np.zeros((len(x), HIDDEN), np.float32),) * 2
        out = np.zeros((*x.shape[:2], HIDDEN), np.float32)
        for k in range(x.shape[1]):
            g = z[:, k] + h @ self.p[f"h{d}"]
            s = _sigmoid(g[:, : 3 * HIDDEN])
            c = s[:, HIDDEN : 2 * HIDDEN] * c + s[:, :HIDDEN] * np.tanh(g[:, 3 * HIDDEN :])
            out[:, k] = h = s[:, 2 * HIDDEN :] * np.tanh(c)
        return out, (h, c)

    def label(self, pages) -> list[np.ndarray]:
        """For each page, whether each of its blocks belongs to the main text."""
        long = {k: self.label_long(p) for k, p in enumerate(pages) if len(p) > LONG_PAGE}
        pages = [p if k not in long else [] for k, p in enumerate(pages)]
        x = vectors(pages)
        ends = np.cumsum([len(p) for p in pages])
        out: list[np.ndarray] = [long.get(k, np.zeros(0, bool)) for k in range(len(pages))]
        order = sorted((k for k, p in enumerate(pages) if p), key=lambda k: len(pages[k]))
        while order:
            size = 1
            while size < min(len(order), 256) and (size + 1) * len(pages[order[size]]) <= 8192:
                size += 1
            now, order = order[:size], order[size:]
            lengths = np.array([len(pages[k]) for k in now])
            padded = np.zeros((len(now), int(lengths[-1]), DIMS), np.float32)
            for row, k in enumerate(now):
                padded[row, : lengths[row]] = x[ends[k] - lengths[row] : ends[k]]
            s = self.forward(padded, lengths)[0]
            for row, k in enumerate(now):
                out[k] = s[row, : lengths[row]] > 0
        return out


# training pages

_SYLLABLES = "th an er on in st re ed ou ing tion ent or is at es ha en it ar eau aux ch ung keit die der ción mente os que".split()
MAIN = "\ue000"


def _say(r: random.Random, low: int, high: int) -> str:
    style = r.random()
    out = []
    for _ in range(r.randint(low, high)):
        w = "".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 3)))
        out.append(w.upper() + "!!" if style < 0.06 else w + r.choice(["***", "%%%", "$$$", "&amp;&amp;"]) if style < 0.12 else w + (r.choice([",", "."]) if r.random() < 0.15 else ""))
    return " ".join(out).capitalize() if style >= 0.06 else " ".join(out)


def _wrap(r: random.Random, choices: list[str], body: str, closed: float = 0.97) -> str:
    tag = r.choice(choices)
    return f"<{tag}>{body}" + (f"</{tag.split()[0]}>" if r.random() < closed else "")


def _names(tag: str, names: str) -> list[str]:
    return [f'{tag} {"id" if k % 3 == 2 else "class"}="{x}"' for k, x in enumerate(names.split())]


def _list(r: random.Random, low: int, high: int) -> str:
    return "<ul>" + "".join(f'<li><a href="/x">{_say(r, 1, 4)}</a></li>' for _ in range(r.randint(low, high))) + "</ul>"


def _nav(r):
    return _wrap(r, ["nav", *_names("div", "nav navbar menu breadcrumbs topnav navigation main-menu"), *_names("ul", "menu nav")], _list(r, 2, 9))


def _ad(r):
    return _wrap(r, [*_names("div", "ad ads advert advertisement sponsored promo ad-slot banner-ad adbox"), 'aside class="ad"', 'section class="promo"'], r.choice([_say(r, 3, 25), f"<p>{_say(r, 3, 25)}</p>", f'<a href="/buy">{_say(r, 2, 10)}</a>']))


def _notice(r):
    return _wrap(r, _names("div", "cookie cookie-notice notice gdpr consent alert banner popup modal cookie-banner"), f"<p>{r.choice(['We use cookies.', ''])} {_say(r, 3, 25)}</p>" + r.choice(["", "<button>OK</button>"]))


def _form(r):
    return _wrap(r, ["form", 'form class="newsletter"', 'form class="search"', *_names("div", "newsletter subscribe signup search login")], f"<label>{_say(r, 1, 4)}</label><input name=q><p>{_say(r, 2, 15)}</p><button>{_say(r, 1, 2)}</button>")


def _side(r):
    return _wrap(r, ["aside", *_names("div", "sidebar related widget side rail recommended more-stories share social"), 'aside class="sidebar"'], r.choice([f"<h3>{_say(r, 1, 4)}</h3>{_list(r, 2, 6)}", f"<p>{_say(r, 4, 30)}</p>"]))


def _comments(r):
    one = lambda: r.choice([f'<div class="comment"><p>{_say(r, 3, 40)}</p></div>', f"<li><p>{_say(r, 3, 40)}</p></li>", f"<p><b>{_say(r, 1, 2)}</b> {_say(r, 3, 40)}</p>"])
    return _wrap(r, [*_names("div", "comments comment-list responses replies disqus user-comments"), *_names("section", "comments comments discussion"), 'ol class="commentlist"'], r.choice(["", f"<h3>{_say(r, 1, 3)}</h3>"]) + "".join(one() for _ in range(r.randint(1, 5))))


def _head(r):
    return _wrap(r, ["header", *_names("div", "header masthead site-header top page-header")], f"<p>{_say(r, 1, 6)}</p>" + r.choice(["", _list(r, 1, 4), f"<h2>{_say(r, 1, 4)}</h2>"]))


def _foot(r):
    return _wrap(r, ["footer", "footer", *_names("div", "footer site-footer copyright bottom legal")], r.choice(["&copy; ", "", "Copyright "]) + _say(r, 2, 20) + r.choice(["", _list(r, 1, 4), f"<p>{_say(r, 2, 12)}</p>"]), 0.85)


def _article(r):
    out = [f"<h1>{MAIN}{_say(r, 1, 12)}</h1>"] if r.random() < 0.9 else []
    for _ in range(r.randint(0, 12)):
        k = r.random()
        size = (1, 6) if r.random() < 0.25 else (8, 90)
        if k < 0.72:
            out.append(f"<p>{MAIN}" + r.choice(["", "", "<b>", "<i>"]) + _say(r, *size) + r.choice(["</p>", "</p>", "<br>", "</b></p>", f'<a href="/y">{_say(r, 1, 4)}</a></p>']))
        elif k < 0.78:
            out.append(f"<h2>{MAIN}{_say(r, 1, 8)}</h2>")
        elif k < 0.84:
            out.append("<ul>" + "".join(f"<li>{MAIN}{_say(r, 2, 20)}</li>" for _ in range(r.randint(1, 5))) + "</ul>")
        elif k < 0.88:
            out.append(f"<blockquote>{MAIN}{_say(r, 5, 40)}</blockquote>")
        elif k < 0.90:
            out.append(f"<pre>{MAIN}{_say(r, 3, 30)}</pre>")
        elif k < 0.92:
            out.append(f"<table><tr><td>{MAIN}{_say(r, 1, 5)}</td><td>{MAIN}{_say(r, 1, 5)}</td></tr></table>")
        elif k < 0.96:
            out.append(_ad(r))
        else:
            out.append(r.choice([_side, _form, _notice])(r))
    body = "".join(out)
    if r.random() < 0.1:
        body += _comments(r)
    kind = r.random()
    if kind < 0.5:
        return f"<article>{body}</article>"
    if kind < 0.62:
        return f"<main>{body}</main>"
    if kind < 0.7:
        return f'<main id="main"><article class="post">{body}</article></main>'
    if kind < 0.95:
        return _wrap(r, [*_names("div", "content post entry-content article-body story post-content main-content article text body-text"), 'section class="article"', 'div id="main"'], body, 1)
    return f"<div>{body}</div>"


def training_page(r: random.Random) -> str:
    before = [f for f, p in ((_notice, 0.2), (_head, 0.35), (_nav, 0.7), (_ad, 0.4), (_form, 0.15), (_side, 0.1)) if r.random() < p]
    after = [f for f, p in ((_ad, 0.2), (_side, 0.3), (_comments, 0.3), (_form, 0.15), (_notice, 0.1)) if r.random() < p]
    r.shuffle(before)
    r.shuffle(after)
    body = "".join(f(r) for f in before) + _article(r) + "".join(f(r) for f in after) + (_foot(r) if r.random() < 0.85 else "")
    if r.random() < 0.15:
        body = f'<div class="{r.choice(["page", "wrapper", "container", "site"])}">{body}</div>'
    return f"<!DOCTYPE html><html><head><title>{_say(r, 1, 10)}</title><script>var t=\"</p>\";</script></head><body>{body}" + ("</body></html>" if r.random() < 0.85 else "")


def training_set(n: int, seed: int):
    """Pages as blocks, and the label of each block."""
    r, pages, labels = random.Random(seed), [], []
    for _ in range(n):
        own = blocks(training_page(r))
        labels.append(np.array([MAIN in t for _, t, _ in own], np.float32))
        pages.append([(p, " ".join(t.replace(MAIN, "").split()) or "x", s) for p, t, s in own])
    return pages, labels


@lru_cache(1)
def train(n: int = 2400, rounds: int = 16, batch: int = 32, rate: float = 0.01, seed: int = 23) -> Labeller:
    """Fit the network to generated pages by Adam; always the same pages and order."""
    pages, labels = training_set(n, seed)
    net = Labeller()
    order = sorted((k for k in range(n) if pages[k]), key=lambda k: len(pages[k]))
    sets = []
    for i in range(0, len(order), batch):
        own = order[i : i + batch]
        lengths = np.array([len(pages[k]) for k in own])
        x, y = np.zeros((len(own), lengths.max(), DIMS), np.float32), np.zeros((len(own), lengths.max()), np.float32)
        for row, k in enumerate(own):
            x[row, : lengths[row]], y[row, : lengths[row]] = vectors([pages[k]]), labels[k]
        sets.append((x, y, lengths))
    m, v, step = {k: np.zeros_like(p) for k, p in net.p.items()}, {k: np.zeros_like(p) for k, p in net.p.items()}, 0
    r = random.Random(seed)
    for epoch in range(rounds):
        r.shuffle(sets)
        for x, y, lengths in sets:
            step += 1
            g = net.gradients(x, y, lengths)
            norm = max(1.0, float(np.sqrt(sum((a * a).sum() for a in g.values()))) / 1.0)
            for k, p in net.p.items():
                d = g[k] / norm
                m[k] += 0.1 * (d - m[k])
                v[k] += 0.01 * (d * d - v[k])
                p -= np.float32(rate * (0.85**epoch)) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return net


def main_texts(pages: list[str], net: Labeller) -> list[str]:
    cut = [blocks(p) for p in pages]
    return [" ".join(t for (_, t, _), keep in zip(b, k) if keep) for b, k in zip(cut, net.label(cut))]


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every row."""
    net = df.sparkSession.sparkContext.broadcast(train())

    def f(batches):
        for b in batches:
            at, size = 0, 0
            lengths = [len(x or "") for x in b.column(2).to_pylist()]
            for k, n in enumerate(lengths):
                size += n
                if size > 2 << 20 or k - at >= 511 or k == len(lengths) - 1:
                    out = main_texts([x or "" for x in b.column(2).slice(at, k + 1 - at).to_pylist()], net.value)
                    yield pa.RecordBatch.from_arrays([*(c.slice(at, k + 1 - at) for c in b.columns[:2]), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], [id_col, url_col, "text", "n_chars"])
                    at, size = k + 1, 0

    rows = df.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col).cast("string"))
    return rows.mapInArrow(f, f"`{id_col}` long, `{url_col}` string, text string, n_chars long")
