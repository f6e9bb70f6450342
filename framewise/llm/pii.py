"""Personal data: fixed patterns, and a semi-Markov conditional random field over candidate segments.

The patterns of ``BASE`` find e-mail addresses, IP addresses, payment cards and international phone numbers; these spans
always stay. The field adds what they miss (written-out addresses, national phone numbers, identity numbers, secrets):
it splits a text into outside tokens and whole segments of a type, of at most ``LONGEST`` tokens. A segment is a candidate
if it holds a digit, an ``@`` or a token ``at`` and has at most ``WIDEST`` characters, so text farther than that from any of these
signs is outside, at score 0, and the dynamic programme runs only around them; that is exact. Features describe the
whole segment at once: its shape, number of digits, check digit, being a value of four bytes, being hexadecimal, the words
to its left. Boundaries and types are chosen jointly by the best path.

Weights are learned on the driver by maximum likelihood (forward-backward over segments) from sentences of invented words with
known spans; the corpus is not used, so results don't depend on it. Each text is read whole, in one pass without a shuffle.

Defined cases: null text is empty and has no spans; ties go to the longer outside stretch; repeated rows are scanned
alike; other columns aren't looked at.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches, table

KINDS = ("email", "ip", "card", "phone", "id", "secret")
BASE_KINDS = KINDS[:4]
LONGEST = 14
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SIGN = re.compile(r"[0-9@]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> Iterator[Span]:
    """[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+, found from each @ to both sides."""
    last = 0
    for m in _DOMAIN.finditer(text):
        at = m.start()
        lo = at
        while lo > last and text[lo - 1] in LOCAL:
            lo -= 1
        if lo < at:
            last = m.end()
            yield lo, last, "email"


def base_spans(text: str) -> list[Span]:
    """The spans of the fixed patterns: leftmost, not overlapping within a kind; a match that fails its test is dropped."""
    out = list(emails(text)) if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
            out.append((m.start(), m.end(), "ip"))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            out.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((m.start(), m.end(), "phone"))
    return ordered(out)


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


# ---- the field ------------------------------------------------------------------------------------------------
_TOKEN = re.compile(r"[^\W_]+|[^\w\s]|_")
WIDEST, LEFT = 200, 4
_HEX = re.compile(r"[0-9a-fA-F]{16,}")
_MIXED = re.compile(r"(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9_+/=-]{12,}")
_QUAD = re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}")
_MAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_SPOKEN = re.compile(r"[A-Za-z0-9]+(?:[._-][A-Za-z0-9]+)* ?(?:[\[(]at[\])]|@| at ) ?[A-Za-z0-9]+(?: ?(?:[\[(]dot[\])]|\.| dot ) ?[A-Za-z]+)+")
_NATIONAL = re.compile(r"(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}")
_ABROAD = re.compile(r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9][0-9 .-]{5,14}[0-9]")
_PERSONAL = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}")


def tokens(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _TOKEN.finditer(text)]


def features(text: str, toks: list[tuple[int, int]], i: int, j: int) -> tuple[str, ...]:
    """Of the whole segment of tokens i to j - 1."""
    a, b = toks[i][0], toks[j - 1][1]
    s = text[a:b]
    digits = _NOT_DIGIT.sub("", s)
    n = len(digits)
    out = ["bias", f"digits{min(n, 20)}", f"tokens{min(j - i, 6)}"]
    shape = re.sub(r"[0-9]+", lambda m: f"d{min(len(m[0]), 6)}", re.sub(r"[A-Za-z]+", "a", s))
    if len(shape) <= 16:
        out.append("shape" + shape)
    for name, p in (("hex", _HEX), ("mixed", _MIXED), ("quad", _QUAD), ("mail", _MAIL), ("spoken", _SPOKEN), ("national", _NATIONAL), ("abroad", _ABROAD), ("personal", _PERSONAL)):
        if p.fullmatch(s):
            out.append(name)
    if "spoken" in out and text[toks[j - 1][0] : b].lower() in TOP:
        out.append("top")
    if "quad" in out and all(int(x) <= 255 for x in s.split(".")):
        out.append("bytes")
    if 13 <= n <= 19 and not re.search(r"[^0-9 -]", s):
        out.append("luhn" if luhn(digits) else "noluhn")
    if "\n" in s:
        out.append("newline")
    if re.search(r"\s{2}|[^\s.@+()\[\]_%A-Za-z0-9/=-]", s):
        out.append("odd")
    if a and text[a - 1].isalnum() or b < len(text) and text[b].isalnum():
        out.append("inside")
    if a and text[a - 1] in "+-.@_/(" or b < len(text) - 1 and text[b] in "-.@_/" and text[b + 1].isalnum():
        out.append("joined")
    left = [text[x:y].lower() for x, y in toks[max(0, i - LEFT) : i]]
    quote = bool(left) and left[-1] in "\"'"
    for w in left:
        if w in CUES:
            out += ["cue" + CUES[w], "cue" + CUES[w] + "quoted" * quote]
    return tuple(out)


#: Last parts of written-out addresses.
TOP = set("app biz ch co com de dev edu es eu fr gov info io it me net nl org uk us".split())
#: Words that tell what follows.
CUES = {"token": "secret", "secret": "secret", "key": "secret", "password": "secret", "passwd": "secret", "apikey": "secret", "phone": "phone", "tel": "phone", "call": "phone", "fax": "phone", "mobile": "phone", "ssn": "id", "id": "id", "social": "id", "passport": "id", "card": "card", "visa": "card", "ip": "ip", "host": "ip", "mail": "email", "email": "email", "contact": "email"}


def candidates(text: str, toks: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Segments of at most LONGEST tokens that hold a digit or @, or spell one out, and begin and end as data may."""
    sign = [bool(_SIGN.search(text[a:b])) or text[a:b] == "at" for a, b in toks]
    before = np.concatenate([[0], np.cumsum(sign)])
    out = []
    for i in range(len(toks)):
        c = text[toks[i][0]]
        if not (c.isalnum() or c in "+(") or before[min(i + LONGEST, len(toks))] == before[i]:
            continue
        for j in range(i + 1, min(i + LONGEST, len(toks)) + 1):
            x, y = toks[j - 2] if j - 2 >= i else toks[i], toks[j - 1]
            if j - 1 > i and (y[0] - x[1] > 1 or "\n" in text[x[1] : y[0]]):
                break
            if y[1] - toks[i][0] > WIDEST:
                break
            if text[y[0]] not in _ENDS and before[j] > before[i]:
                out.append((i, j))
    return out


_ENDS = set(" .,;:!?\"'([{+-@_%&|<>=/\\*#$~^`")


class Field:
    """Weights by (feature, type); scores of segments; the best path and expectations over paths."""

    def __init__(self):
        self.weights: dict[str, np.ndarray] = {}
        self.dull = [False] * 7

    def score(self, f: tuple[str, ...]) -> np.ndarray:
        total = np.zeros(len(KINDS))
        for x in f:
            if (w := self.weights.get(x)) is not None:
                total = total + w
        return total

    def bound(self) -> None:
        """By number of tokens: whether no segment without digit, @, spelled-out address and cue can score above 0."""
        up = {x: np.maximum(w, 0) for x, w in self.weights.items()}
        none = np.zeros(len(KINDS))
        shapes = [w for x, w in up.items() if x.startswith("shape") and "@" not in x and not re.search("d[0-9]", x[5:])]
        most = self.score(("bias", "digits0")) + sum((up.get(x, none) for x in ("hex", "newline", "odd", "inside", "joined")), none) + np.max([none, *shapes], axis=0)
        self.dull = [bool((most + self.score((f"tokens{n}",)) < -1e-6).all()) for n in range(7)]

    def best(self, text: str) -> list[Span]:
        """The best split of a text into outside tokens (score 0) and segments."""
        toks = tokens(text)
        ends: dict[int, list[tuple[int, float, int]]] = {}
        at, cued = -1, False
        for i, j in candidates(text, toks):
            if i != at:
                at, cued = i, any(text[x:y].lower() in CUES for x, y in toks[max(0, i - LEFT) : i])
            if not cued and self.dull[min(j - i, 6)]:
                a, b = toks[i][0], toks[j - 1][1]
                if not _SIGN.search(text, a, b) and not _SPOKEN.fullmatch(text, a, b):
                    continue  # bound() says that its score isn't above 0
            s = self.score(features(text, toks, i, j))
            k = int(s.argmax())
            if s[k] > 0:  # a segment under the outside score is on no best path
                ends.setdefault(j, []).append((i, float(s[k]), k))
        value, back = [0.0], [None]
        for j in range(1, len(toks) + 1):
            v, b = value[j - 1], None
            for i, s, k in ends.get(j, ()):
                if value[i] + s > v:
                    v, b = value[i] + s, (i, k)
            value.append(v)
            back.append(b)
        out, j = [], len(toks)
        while j:
            if back[j] is None:
                j -= 1
            else:
                i, k = back[j]
                out.append((toks[i][0], toks[j - 1][1], KINDS[k]))
                j = i
        return out[::-1]

    def learn(self, data: list[tuple[str, list[Span]]], rounds: int = 15, rate: float = 0.5, decay: float = 1e-3) -> None:
        """Maximum likelihood by AdaGrad."""
        names: dict[str, int] = {}
        seen = []
        for text, spans in data:
            toks = tokens(text)
            gold = {(a, b): KINDS.index(k) for a, b, k in spans}
            segs = candidates(text, toks)
            if not segs:
                continue
            feats = [[names.setdefault(x, len(names)) for x in features(text, toks, i, j)] for i, j in segs]
            truth = [(n, y) for n, (i, j) in enumerate(segs) if (y := gold.get((toks[i][0], toks[j - 1][1]))) is not None]
            sizes = np.array([len(f) for f in feats])
            seen.append((len(toks), segs, np.concatenate(feats).astype(int), sizes, truth))
        w, square = np.zeros((len(names), len(KINDS))), np.full((len(names), len(KINDS)), 1e-2)
        for _ in range(rounds):
            for n, segs, flat, sizes, truth in seen:
                scores = np.add.reduceat(w[flat], np.cumsum(sizes) - sizes)
                top = scores.max(1)
                z = top + np.log(np.exp(scores - top[:, None]).sum(1))
                ahead, upto = np.zeros(n + 1), np.zeros(n + 1)
                by_end: dict[int, list[int]] = {}
                by_start: dict[int, list[int]] = {}
                for s, (i, j) in enumerate(segs):
                    by_end.setdefault(j, []).append(s)
                    by_start.setdefault(i, []).append(s)
                for j in range(1, n + 1):
                    v = upto[j - 1]
                    for s in by_end.get(j, ()):
                        v = np.logaddexp(v, upto[segs[s][0]] + z[s])
                    upto[j] = v
                for i in range(n - 1, -1, -1):
                    v = ahead[i + 1]
                    for s in by_start.get(i, ()):
                        v = np.logaddexp(v, ahead[segs[s][1]] + z[s])
                    ahead[i] = v
                ij = np.array(segs)
                g = -np.exp(scores + (upto[ij[:, 0]] + ahead[ij[:, 1]] - upto[n])[:, None])
                for s, y in truth:
                    g[s, y] += 1
                used, where = np.unique(flat, return_inverse=True)
                total = np.zeros((len(used), len(KINDS)))
                np.add.at(total, where, np.repeat(g, sizes, axis=0))
                total -= decay * w[used]
                square[used] += total * total
                w[used] += rate * total / np.sqrt(square[used])
        self.weights = {x: w[i] for x, i in names.items()}
        self.bound()


def invented(n: int = 360, seed: int = 11) -> list[tuple[str, list[Span]]]:
    """Sentences of invented words with marked spans, and numbers that are none."""
    r = np.random.default_rng(seed)
    pick = lambda x: x[int(r.integers(len(x)))]
    digits = lambda k: "".join(map(str, r.integers(0, 10, k)))
    letters = lambda lo, hi: "".join(map(chr, r.integers(97, 123, int(r.integers(lo, hi)))))
    hexes = lambda k: "".join(pick("0123456789abcdef") for _ in range(k))

    def card() -> str:
        d = pick("3456") + digits(int(r.integers(12, 17)))
        d += next(c for c in "0123456789" if luhn(d + c))
        return pick([d, " ".join(d[i : i + 4] for i in range(0, len(d), 4)), "-".join(d[i : i + 4] for i in range(0, len(d), 4))])

    def wrong() -> str:
        d = digits(16)
        return d if not luhn(d) else d[:-1] + str((int(d[-1]) + 1) % 10)

    made = {
        "email": lambda: pick([f"{letters(3, 9)}.{digits(2)}@{letters(4, 8)}.{pick(['com', 'org', 'net'])}", f"{letters(3, 9)}@{letters(2, 7)}{digits(1)}.{letters(3, 8)}.com", f"{letters(3, 8)} at {letters(4, 8)} dot {pick(['com', 'org', 'net'])}", f"{letters(3, 8)} [at] {letters(4, 8)} [dot] {pick(['com', 'org'])}", f"{letters(3, 8)}(at){letters(4, 8)}.com"]),
        "ip": lambda: ".".join(str(x) for x in r.integers(0, 256, 4)),
        "card": card,
        "phone": lambda: pick([f"+{r.integers(1, 99)} ({digits(3)}) {digits(3)}-{digits(4)}", f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"+{r.integers(1, 99)} {digits(3)} {digits(3)} {digits(4)}", f"{digits(3)}.{digits(3)}.{digits(4)}"]),
        "id": lambda: f"{digits(3)}-{digits(2)}-{digits(4)}",
        "secret": lambda: pick([hexes(40), hexes(32), letters(4, 8) + digits(6) + letters(4, 9).upper() + digits(3)]),
    }
    lead = {"secret": ['token = "', "api key: ", 'password = "', "secret: "], "phone": ["call ", "tel ", "", ""], "id": ["ssn ", "id ", ""], "email": ["mail ", "contact ", "", ""], "card": ["card ", "", ""], "ip": ["host ", "", ""]}
    none = [lambda: digits(4), lambda: f"{r.integers(0, 20)}.{r.integers(0, 20)}", lambda: f"{digits(1)}.{digits(1)}.{digits(2)}", lambda: f"{digits(4)}-{digits(2)}-{digits(2)}", lambda: f"{digits(2)}:{digits(2)}", lambda: digits(int(r.integers(1, 12))), wrong, lambda: f"{digits(3)},{digits(3)}", lambda: f"{r.integers(300, 999)}.{digits(3)}.{digits(3)}.{digits(3)}", lambda: "at " + letters(3, 7), lambda: f"{digits(2)}/{digits(2)}/{digits(4)}", lambda: letters(2, 5) + digits(3), lambda: f"looked at {letters(3, 8)} and {letters(3, 6)}", lambda: f"{digits(3)} {digits(3)}", lambda: f"{letters(3, 8)} at {letters(3, 8)} dot {letters(2, 7)}", lambda: "@" + letters(4, 8), lambda: f"{digits(1)}-{digits(2)}", lambda: f"page {digits(3)}-{digits(3)}"]
    data = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(int(r.integers(1, 4))):
            for _ in range(int(r.integers(0, 5))):
                w = letters(1, 10)
                text += (w.title() if r.random() < 0.3 else w) + pick([" ", " ", " ", ", ", ". ", "\n"])
            if r.random() < 0.55:
                k = pick(KINDS)
                cue = pick(lead[k])
                s = made[k]()
                a = len(text) + len(cue)
                text += cue + s + ('"' if cue.endswith('"') else "")
                spans.append((a, a + len(s), k))
            else:
                text += pick(none)()
            text += pick([" ", " ", ", ", ". ", "\n"])
        data.append((text, spans))
    return data


_field: list[Field] = []


def trained() -> Field:
    if not _field:
        f = Field()
        f.learn(invented())
        _field.append(f)
    return _field[0]


REACH = WIDEST + 60
#: Every sign that candidates() takes: a digit, an @ or a token "at".
_NEAR = re.compile(r"[0-9@]|(?<![^\W_])at(?![^\W_])")


def regions(text: str) -> Iterator[tuple[int, int]]:
    """Stretches around the signs, cut at white space; all candidates lie inside, with the LEFT tokens before them."""
    lo = hi = None
    for m in _NEAR.finditer(text):
        if hi is not None and (m.end() + REACH <= hi or hi == len(text)):
            continue
        # Once the stretch before is reached the two are one, so each character is looked at a bounded number of times.
        a = _back(text, m.start(), hi or 0)
        b = _SPACE.search(text, min(len(text), m.end() + REACH))
        b = b.start() if b else len(text)
        if hi is not None and a <= hi:
            hi = max(hi, b)
            continue
        if hi is not None:
            yield lo, hi
        lo, hi = a, b
    if hi is not None:
        yield lo, hi


_SPACE = re.compile(r"\s")


def _back(text: str, start: int, least: int) -> int:
    """Where the candidates that hold text[start], and the LEFT tokens before them, begin at the earliest; least if that is earlier still."""
    reach = REACH
    while True:
        lo = start - reach
        while lo > least and not text[lo - 1].isspace():
            lo -= 1
        if lo <= least:
            return least
        if len(tokens(text[lo : start - WIDEST])) > LEFT:
            return lo
        reach *= 2


def find(text: str | None, field: Field) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans: the base ones and those of the field that overlap none."""
    text = text or ""
    base = base_spans(text)
    starts, ends, added = [x for x, _, _ in base], list(accumulate((y for _, y, _ in base), max)), []
    for lo, hi in regions(text):
        for a, b, k in field.best(text[lo:hi]):
            a, b = a + lo, b + lo
            n = bisect_left(starts, b)
            if not n or ends[n - 1] <= a:
                added.append((a, b, k))
    return base, ordered(base + added)


SCHEMA = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long"


def detect(docs: DataFrame) -> DataFrame:
    """Per document: counts of base spans by kind, the digest of the base spans, all spans, and their number."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(trained())
    d = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_numpy(zero_copy_only=False):
                if not text or not _NEAR.search(text):
                    rows.append(_EMPTY)
                    continue
                base, every = find(text, held.value)
                rows.append((*(sum(k == kind for *_, k in base) for kind in BASE_KINDS), hashlib.sha256(written(base).encode()).hexdigest(), written(every), len(every)))
            cols = list(zip(*rows)) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0)] + [pa.array(c, pa.int64()) for c in cols[:4]] + [pa.array(c, pa.string()) for c in cols[4:6]] + [pa.array(cols[6], pa.int64())], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans"])

    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, {SCHEMA}")


_EMPTY = (0, 0, 0, 0, hashlib.sha256(b"").hexdigest(), "", 0)


def redact(text: str | None, field: Field) -> str | None:
    """The text with each span replaced by its kind in brackets."""
    if text is None:
        return None
    out, at = [], 0
    for a, b, k in find(text, field)[1]:
        if a >= at:
            out += [text[at:a], f"[{k}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def op1(spark, sf_dir: str) -> DataFrame:
    return detect(table(spark, sf_dir, "documents"))
