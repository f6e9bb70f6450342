"""Main text of web pages: a recurrent labeller of blocks.

A page's html is read into leaf blocks in page order: stretches of text between block-level tags, without comments, scripts, styles and the
like, character references decoded, white space turned into one space. Each block becomes a vector: its tag path (names, classes, ids and roles of the
open elements, hashed), its words (hashed), and a few numbers (length, share of link text, place in the page). A bidirectional LSTM in numpy reads
the sequence of all blocks of the page, so each block is judged in the page's whole context, and a block is main text if its probability is at least
a half. The text is the main blocks joined by a line end; nothing else is dropped.

The network is trained on the driver by backpropagation through time, on pages that ``invented_page`` makes from invented words in many layouts (with
and without article or main elements, unclosed tags, menus, banners, side bars, adverts, forms, comments) whose blocks are known; the corpus isn't used, so
results don't depend on it. Pages are read whole, in one pass without a shuffle.

Defined cases: null html is empty; a page without main blocks has an empty text; unclosed or crossed tags are closed by the next enclosing end tag;
repeated rows are read alike; other columns aren't looked at.
"""

from __future__ import annotations

import functools
import html
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Words, groups, small_batches, table, utf8
from .nets import adam

PATH, WORDS, NUMBERS, UNITS = 96, 48, 8, 16
STEPS, PAGES, TRAINING = 500, 16, 500

#: Elements that separate blocks, whose content is no text, and that have no content.
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noframes ol option optgroup p pre search section select summary table tbody td tfoot th thead title tr ul".split())
UNSEEN = set("script style noscript template textarea iframe svg canvas audio video head title select button datalist".split())
RAW = set("script style textarea title noscript iframe noframes xmp template".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag of the first kind closes an open one of the second within the same parent.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
#: The same without quotes, for the rest of a page after so many tags whose quotes don't close: each costs a look at the whole page.
_PLAIN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>()()()", re.S)
UNCLOSED = 16
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_EVERY = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?|[\"'][^\s]*")
_NONE = re.compile(r"(?:^|;)\s*display\s*:\s*none\s*(?:!\s*important\s*)?(?:;|$)", re.I)
_MAYBE = re.compile(r"hidden|style", re.I)
_NAME = re.compile(r"[a-z]+")
_OPEN = re.compile(r"<!--|<!\[CDATA\[")
_DIGITS = re.compile(r"[^0-9]+")


def is_hidden(attrs: str) -> bool:
    """Whether an element's attributes hold one named hidden, or a style with display: none."""
    for a in _EVERY.finditer(attrs):
        name = (a[1] or "").lower()
        if name == "hidden" or name == "style" and _NONE.search(html.unescape(a[2] or a[3] or a[4] or "")):
            return True
    return False


class Block:
    __slots__ = ("text", "path", "links")

    def __init__(self, text: str, path: Path, links: float):
        self.text, self.path, self.links = text, path, links


class Path:
    """The names, classes, ids and roles of the open elements: hashed, all of them, in one row; the last three weigh more."""

    __slots__ = ("last", "row", "below")

    def __init__(self, last: tuple[str, ...] = (), row: np.ndarray | None = None):
        self.last, self.row = last, np.zeros(PATH, np.float32) if row is None else row
        self.below: dict[tuple[str, ...], Path] = {}

    def to(self, words: tuple[str, ...]) -> Path:
        got = self.below.get(words)
        if got is None:
            row = self.row.copy()
            for w in words:
                row[_slot(w)] += 0.6
            got = self.below[words] = Path((self.last + words)[-3:], row)
        return got

    def vector(self) -> np.ndarray:
        row = self.row.copy()
        for w in self.last:
            row[_slot(w)] += 0.4
        return row


@functools.lru_cache(20_000)
def _slot(w: str) -> int:
    return zlib.crc32(w.encode("utf-8", "replace")) % PATH


def blocks(page: str) -> list[Block]:
    """Leaf blocks in page order, each with its text, its tag path and the share of its text inside links."""
    out: list[Block] = []
    top = Path()
    stack: list[tuple[str, Path, bool, bool]] = []  # element, path to it, unseen, block
    places: dict[str, list[int]] = {}  # where in the stack elements of a name, and blocks, are
    parents: list[int] = []
    pieces: list[str] = []
    linked = hidden = links = 0

    def flush() -> None:
        nonlocal pieces, linked
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                out.append(Block(text, stack[-1][1] if stack else top, min(1.0, linked / len(text))))
            pieces, linked = [], 0

    def text(s: str) -> None:
        nonlocal linked
        if s and not hidden:
            pieces.append(s)
            if links:
                linked += len(s.strip())

    def close(n: int) -> None:
        """Leave the elements from n on."""
        nonlocal hidden, links
        for _, _, _, block in stack[n:]:
            if block:
                flush()
                break
        for x, _, unseen, block in reversed(stack[n:]):
            hidden -= unseen
            links -= x == "a"
            places[x].pop()
            if block:
                parents.pop()
        del stack[n:]

    at, size = 0, len(page)
    last = page.rfind(">") + 1  # beyond it there are no tags: an opened one isn't looked for again and again
    unclosed = 0
    while at < size:
        m = (_TAG if unclosed < UNCLOSED else _PLAIN).search(page, at, last) if at < last else None
        if m is None:
            m = _OPEN.search(page, at)  # a comment without an end hides the rest
            text(page[at : m.start()] if m else page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        if at == last and _OPEN.match(m[0]) and not m[0].endswith(("-->", "]]>")):
            break
        name = m[2] or m[5]
        if not name:
            continue
        unclosed += m[2] is None
        name, attrs, end = name.lower(), m[3] if m[2] else m[6], bool(m[1] or m[4])
        if end:
            if places.get(name):
                close(places[name][-1])
            elif name in BLOCK:
                flush()
            continue
        if name == "br":
            text(" ")
            continue
        if name in BLOCK:
            flush()
            if parents and stack[parents[-1]][0] in ("p", *CLOSES.get(name, ())):  # p ends at the next block; li, td and others at their like
                close(parents[-1])
        if name in VOID or attrs.rstrip().endswith("/"):
            continue
        words = [name]
        if attrs:
            for a in _ATTR.finditer(attrs):
                words += [f"{a[1].lower()}.{w}" for w in _NAME.findall((a[2] or a[3] or a[4] or "").lower())]
        unseen = name in UNSEEN or bool(attrs and _MAYBE.search(attrs) and is_hidden(attrs))
        places.setdefault(name, []).append(len(stack))
        if name in BLOCK:
            parents.append(len(stack))
        stack.append((name, (stack[-1][1] if stack else top).to(tuple(words)), unseen, name in BLOCK))
        hidden += unseen
        links += name == "a"
        if name in RAW:
            e = re.compile(f"</{name}", re.I).search(page, at)
            at = e.start() if e else size
    flush()
    return out


def vectors(pages: list[list[Block]]) -> list[np.ndarray]:
    """(blocks, features) of each page."""
    every = [b for p in pages for b in p]
    x = np.zeros((len(every), PATH + WORDS + NUMBERS), np.float32)
    if every:
        buf, off = utf8(pa.array([b.text for b in every], pa.string()))
        for lo, hi in groups(off):
            w = Words(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
            n = np.diff(w.first)
            counts = np.bincount(w.doc * WORDS + (w.hash % np.uint64(WORDS)).astype(np.int64), minlength=(hi - lo) * WORDS).reshape(-1, WORDS)
            x[lo:hi, PATH : PATH + WORDS] = 0.3 * counts / np.sqrt(n + 1.0)[:, None]
            x[lo:hi, PATH + WORDS + 5] = np.minimum(n, 20) / 20
        x[:, :PATH] = [b.path.vector() for b in every]
        size = np.array([len(b.text) for b in every])
        at = PATH + WORDS
        x[:, at] = np.log1p(size) / 6
        x[:, at + 1] = [b.links for b in every]
        x[:, at + 4] = [b.text[-1] in ".!?:" for b in every]
        x[:, at + 6] = [len(_DIGITS.sub("", b.text)) / len(b.text) for b in every]
        x[:, at + 7] = ["©" in b.text for b in every]
    out, lo = [], 0
    for p in pages:
        part = x[lo : lo + len(p)]
        if len(p):
            part[:, PATH + WORDS + 2] = np.arange(len(p)) / len(p)
            part[:, PATH + WORDS + 3] = size[lo : lo + len(p)] / size[lo : lo + len(p)].max()
        out.append(part)
        lo += len(p)
    return out


class Net:
    """Gates in the order input, forget, output, new; one set each per direction."""

    def __init__(self, seed: int = 3):
        r = np.random.default_rng(seed)
        f = lambda *s, scale: (r.standard_normal(s) * scale).astype(np.float32)
        self.p = {"o": np.zeros(1, np.float32)}
        for d in "fb":
            self.p |= {"w" + d: f(PATH + WORDS + NUMBERS, 4 * UNITS, scale=0.15), "u" + d: f(UNITS, 4 * UNITS, scale=0.2), "c" + d: np.zeros(4 * UNITS, np.float32), "v" + d: f(UNITS, scale=0.3)}
            self.p["c" + d][UNITS : 2 * UNITS] = 1

    def _run(self, x: np.ndarray, seen: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """(time, pages, units) states; beyond a page's end the state stays."""
        H, T, n = UNITS, x.shape[0], x.shape[1]
        g = x @ self.p["w" + d] + self.p["c" + d]
        h, c = np.zeros((n, H), np.float32), np.zeros((n, H), np.float32)
        out = np.zeros((T, n, H), np.float32)
        for t in range(T) if d == "f" else range(T - 1, -1, -1):
            a = g[t] + h @ self.p["u" + d]
            s = 1 / (1 + np.exp(-a[:, : 3 * H]))
            new = np.tanh(a[:, 3 * H :])
            c2 = s[:, H : 2 * H] * c + s[:, :H] * new
            tc = np.tanh(c2)
            m = seen[t][:, None]
            h2 = s[:, 2 * H :] * tc
            if keep is not None:
                keep.append((t, h, c, s, new, tc))
            h, c = np.where(m, h2, h), np.where(m, c2, c)
            out[t] = h
        return out

    def probabilities(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Probability of being main text for each block of each page; pages of like length go side by side."""
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        while order:
            longest = len(pages[order[-1]])
            now, order = order[-max(1, 20_000 // longest) :], order[: -max(1, 20_000 // longest)]
            z = self._logits(*_side_by_side([pages[i] for i in now]))
            for k, i in enumerate(now):
                out[i] = 1 / (1 + np.exp(-z[: len(pages[i]), k]))
        return out

    def _logits(self, x: np.ndarray, seen: np.ndarray) -> np.ndarray:
        return self._run(x, seen, "f") @ self.p["vf"] + self._run(x, seen, "b") @ self.p["vb"] + self.p["o"]

    def step(self, pages: list[np.ndarray], truth: list[np.ndarray], state: dict, lr: float) -> float:
        x, seen = _side_by_side(pages)
        H, (T, n) = UNITS, seen.shape
        y = np.zeros((T, n), np.float32)
        for k, t in enumerate(truth):
            y[: len(t), k] = t
        memory, states, g = {"f": [], "b": []}, {}, {}
        for d in "fb":
            states[d] = self._run(x, seen, d, memory[d])
        z = states["f"] @ self.p["vf"] + states["b"] @ self.p["vb"] + self.p["o"]
        s = 1 / (1 + np.exp(-z))
        e = ((s - y) * seen / seen.sum()).astype(np.float32)
        g["o"] = np.array([e.sum()], np.float32)
        for d in "fb":
            g["v" + d] = np.einsum("tn,tnh->h", e, states[d]).astype(np.float32)
            dg, dh, dc = np.zeros((T, n, 4 * H), np.float32), np.zeros((n, H), np.float32), np.zeros((n, H), np.float32)
            du = np.zeros_like(self.p["u" + d])
            for t, h, c, s3, new, tc in reversed(memory[d]):
                m = seen[t][:, None]
                dh = dh + e[t][:, None] * self.p["v" + d]
                i, f, o = s3[:, :H], s3[:, H : 2 * H], s3[:, 2 * H :]
                hot, cold = dh * m, dc * m
                cold = cold + hot * o * (1 - tc * tc)
                da = np.concatenate([cold * new * i * (1 - i), cold * c * f * (1 - f), hot * tc * o * (1 - o), cold * i * (1 - new * new)], 1)
                dg[t] = da
                du += h.T @ da
                dh = np.where(m, da @ self.p["u" + d].T, dh)
                dc = np.where(m, cold * f, dc)
            g["u" + d], g["c" + d] = du, dg.sum((0, 1))
            g["w" + d] = x.reshape(-1, x.shape[2]).T @ dg.reshape(-1, 4 * H)
        adam(self.p, g, state, lr)
        return float(-((y * np.log(s + 1e-9) + (1 - y) * np.log(1 - s + 1e-9)) * seen).sum() / seen.sum())


def _side_by_side(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    T = max(map(len, pages))
    x, seen = np.zeros((T, len(pages), pages[0].shape[1]), np.float32), np.zeros((T, len(pages)), bool)
    for k, p in enumerate(pages):
        x[: len(p), k], seen[: len(p), k] = p, True
    return x, seen


# ---- pages to learn from --------------------------------------------------------------------------------------
MARK = "⁣"  # begins each main block of an invented page; taken off before its words are read


def invented_page(r: np.random.Generator) -> str:
    """A page in one of many layouts; blocks of main text begin with MARK."""
    pick = lambda *x: x[int(r.integers(len(x)))]
    letters = pick("abcdefghijklmnopqrstuvwxyz", "etaoinshrdluéè", "aeinrstäöüch", "aeosnrdlóñí")
    end = pick("", "", "###", "***", "!!")

    def words(n: int) -> str:
        made = ["".join(letters[i] for i in r.integers(0, len(letters), int(r.integers(1, 10)))) + (end if r.random() < 0.5 else "") for _ in range(n)]
        s = " ".join(made)
        return s[:1].upper() + s[1:] + pick(".", ".", ".", "", "&amp;", "|")

    def some(f, lo: int, hi: int) -> str:  # noqa: ANN001
        return "".join(f() for _ in range(int(r.integers(lo, hi))))

    link = lambda: f'<a href="/{words(1)}">{words(int(r.integers(1, 4)))}</a>'
    menu = lambda: "<ul>" + some(lambda: f"<li>{link()}</li>" if r.random() < 0.9 else f"<li>{words(2)}", 2, 9) + "</ul>"
    length = lambda: int(np.exp(r.uniform(0.5, 5)))

    def paragraph() -> str:
        body = words(length())
        if r.random() < 0.15:
            body += " " + link() + " " + words(4)
        kind = r.random()
        if kind < 0.7:
            return f"<p>{MARK}{pick('', '', '<b>', '<i>', '<em>')}{body}" + pick("</p>", "</p>", "</p>", "<br>", "")
        if kind < 0.78:
            return f"<{(h := pick('h2', 'h3', 'h4'))}>{MARK}{words(4)}</{h}>"
        if kind < 0.86:
            return "<ul>" + some(lambda: f"<li>{MARK}{words(5)}</li>", 1, 5) + "</ul>"
        if kind < 0.9:
            return f"<blockquote>{MARK}{body}</blockquote>"
        if kind < 0.94:
            return f"<pre>{MARK}{body}</pre>"
        if kind < 0.97:
            return "<table>" + some(lambda: f"<tr><td>{MARK}{words(2)}<td>{MARK}{words(3)}</tr>", 1, 4) + "</table>"
        return f"<div>{MARK}{body}</div>"

    advert = lambda: f'<!-- ad --><div class="{pick("ad", "ads", "advert", "banner", "sponsored", "promo", "ad-slot")}">{words(length() // 2 + 1)}</div>'
    notice = lambda: f'<div class="{pick("cookie-banner", "notice", "cookie-notice", "newsletter", "alert", "consent")}">{pick("", "<p>")}{words(8)}{pick("", " cookies ", " subscribe ")}</div>'
    share = lambda: f'<div class="{pick("share", "social", "tags", "meta", "byline", "breadcrumb", "related")}">{some(link, 1, 5)}</div>'
    form = lambda: f'<form action="/s"><label>{words(2)}</label><input type="text"><p>{words(5)}</p><button>{words(1)}</button></form>'
    side = lambda: pick(f"<aside>{menu()}<p>{words(length() // 2 + 1)}</p></aside>", f'<div class="{pick("sidebar", "side", "widget", "related")}"><h3>{words(3)}</h3>{menu()}<p>{words(12)}</p></div>', f'<div id="{pick("sidebar", "side")}"><p>{words(10)}</p></div>')
    comments = lambda: f'<{(s := pick("section", "div"))} {pick("id", "class")}="{pick("comments", "comment-list", "comments-area", "disqus", "responses", "replies")}"><h3>{words(2)}</h3>' + some(lambda: f'<div class="comment"><b>{words(1)}</b><p>{words(length() // 2 + 1)}</p></div>', 1, 6) + f"</{s}>"
    heading = f"<h1>{MARK}{words(int(r.integers(2, 12)))}</h1>"
    middle = [paragraph() for _ in range(int(r.integers(1, 14)))]
    for extra in (advert, share, notice, side):
        if r.random() < 0.12:
            middle.insert(int(r.integers(len(middle) + 1)), extra())
    inner = (heading if r.random() < 0.9 else "") + (share() if r.random() < 0.2 else "") + "".join(middle) + (comments() if r.random() < 0.12 else "")
    if r.random() < 0.15:
        inner = f"<header>{heading}</header>" + "".join(middle)
    box = pick("article", "article", "article", "main", "main", "div content", "div post", "div entry", "div article-body", "div main", "section content")
    tag, _, name = box.partition(" ")
    core = f"<{tag}{f' {pick("class", "id")}="{name}"' if name else ''}>{inner}</{tag}>"
    if r.random() < 0.2:
        core = f"<main>{core}{comments() if r.random() < 0.4 else ''}</main>"
    top = pick(f"<nav>{menu()}</nav>", f"<nav>{some(link, 2, 8)}</nav>", f'<div class="{pick("menu", "nav", "navbar", "topbar")}">{menu()}</div>', f"<header><p>{words(3)}</p><nav>{menu()}</nav></header>", f'<div id="header"><h2>{words(3)}</h2>{menu()}</div>', "")
    before = "".join(f() for f in (notice, advert, share, form, side) if r.random() < 0.3)
    after = "".join(f() for f in (side, comments, form, advert, share, notice) if r.random() < 0.3)
    foot = pick(f"<footer>&copy; {words(2)} &middot; {words(length() // 2 + 1)}</footer>", f"<footer>{menu()}<p>{words(6)}</p></footer>", f'<div class="{pick("footer", "foot", "copyright", "legal")}"><p>{words(9)}</p></div>', f'<div id="footer">{some(link, 1, 6)} {words(5)}</div>', "")
    return f'<!DOCTYPE html><html><head><title>{words(4)}</title><style>p{{margin:0}}</style></head><body>{top}{before}{core}{after}{foot}<script>var a="</p>"</script></body></html>'


def train(pages: int = TRAINING, steps: int = STEPS, seed: int = 3) -> Net:
    r = np.random.default_rng(seed)
    x, y = [], []
    for _ in range(pages):
        bs = blocks(invented_page(r))
        y.append(np.array([MARK in b.text for b in bs], np.float32))
        for b in bs:
            b.text = b.text.replace(MARK, "") or "."
        x += vectors([bs])
    net, state = Net(seed), {}
    for t in range(steps):
        pick = r.choice(pages, PAGES)
        net.step([x[i] for i in pick], [y[i] for i in pick], state, 0.01 * (1 - t / steps) + 0.001)
    return net


_net: list[Net] = []


def trained() -> Net:
    if not _net:
        _net.append(train())
    return _net[0]


def extract(pages: list[str | None], net: Net) -> list[str]:
    """The main text of each page."""
    read = [blocks(p) if p else [] for p in pages]
    found = net.probabilities(vectors(read))
    return ["\n".join(b.text for b, p in zip(bs, ps) if p >= 0.5) for bs, ps in zip(read, found)]


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each page."""
    small_batches(pages.sparkSession)
    held = pages.sparkSession.sparkContext.broadcast(trained())
    p = pages.select("page_id", "url", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                b = batch.slice(lo, 128)
                texts = extract(b.column(2).to_numpy(zero_copy_only=False).tolist(), held.value)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in p.schema.fields}
    return p.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def op3(spark, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
