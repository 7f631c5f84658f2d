"""Personal data by fixed patterns and a character-level bidirectional LSTM with CRF transitions.

**Patterns.** Emails, IPv4 addresses, payment cards (Luhn) and international phone numbers,
leftmost and without overlap per kind. They are always kept.

**Model.** Characters become classes (digit, lower, upper, each useful mark, ...). A forward
and a backward LSTM give tag scores, and learned CRF transitions over BIO tags of the four
kinds tie them together. It is trained in numpy, by back-propagation through time and the
forward-backward gradient of the CRF, on labelled spans: those of the patterns in a bounded
sample of documents, as written and rewritten in the forms that patterns miss
(``name [at] host [dot] net``, ``10 . 1 . 2 . 3``, cards with dots, national phone numbers),
and look-alikes that are none (dates, versions, amounts, order numbers).

**Decoding.** The whole text is covered by windows of ``WINDOW`` characters that overlap by half.
Every kind has a digit, an ``@`` or a bracketed ``at`` in each of its spans, so windows
without any of these cannot hold a whole span and are not scored. A piece cut by an inner window
edge is left to the neighbour that sees it whole; where none does, the windows of twice the width
about its ends are scored, and so on, so that a span of any length is seen whole by some window
(a piece that no span of its kind can contain is let go; memory of a task grows with the longest span). All candidates of a text, with their gain over
no span, are reconciled globally: of overlapping ones the set with the largest total gain is
taken, by dynamic programming. Candidates must pass the rules of their kind (ranges, digit
counts, Luhn) and may not touch a pattern's span.

Fitting uses at most ``max_documents`` documents chosen by a hash of the key, and at most six
windows of each; scoring is one pass without a shuffle. Null and empty texts have no spans.
Without sample windows the model trains on the built-in forms alone. Empty tables give no
rows; repeated rows each get one. Extra columns are ignored. Positions are code points, end
exclusive.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brinewave.llm.common import bounded_sample, map_texts

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE = 128, 64
TRIGGER = re.compile(r"[0-9@]|[\[(] ?at ?[\])]", re.I)
_PLAIN_TRIGGER = re.compile(r"[0-9@]")

# -- patterns ---------------------------------------------------------------------------

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")


def triggered(text: str) -> bool:
    """Whether the text has a trigger anywhere."""
    return _PLAIN_TRIGGER.search(text) is not None or (("(" in text or "[" in text) and TRIGGER.search(text) is not None)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def _part_fits(part: str) -> bool:
    bare = part.lstrip("0")
    return len(bare) <= 3 and int(bare or "0") <= 255


def pattern_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of each kind by the fixed rules, in time linear in the text."""
    emails, free = [], 0
    at = text.find("@")
    while at >= 0:
        a = at
        while a > free and text[a - 1] in _LOCAL:
            a -= 1
        m = _DOMAIN.match(text, at + 1) if a < at else None
        if m:
            emails.append((a, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    ips = [m.span() for m in _IP.finditer(text) if all(_part_fits(p) for p in m.group().split("."))]
    cards = []
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            cards.append(m.span())
    phones = [m.span() for m in _PHONE.finditer(text) if 8 <= len(_DIGITS.findall(m.group())) <= 15] if "+" in text else []
    return {"email": emails, "ip": ips, "card": cards, "phone": phones}


def passes(kind: str, text: str, a: int, b: int) -> bool:
    """The rules a span of the model must pass: those of its kind, and no letter or digit goes on at its ends."""
    if (a and text[a - 1].isalnum() and text[a].isalnum()) or (b < len(text) and text[b].isalnum() and text[b - 1].isalnum()):
        return False
    span = text[a:b]
    digits = re.sub(r"\D", "", span)
    if kind == "email":
        return bool(re.fullmatch(r"[\w.%+-]+ ?(@|[\[(] ?at ?[\])]) ?[\w-]+( ?(\.|[\[(] ?dot ?[\])]) ?[\w-]+)+", span, re.I | re.A))
    if kind == "ip":
        parts = re.findall(r"\d+", span, re.A)
        return len(parts) == 4 and all(_part_fits(p) for p in parts) and re.sub(r"[\d.\[\] ]", "", span) == ""
    if re.search(r"[^\d\s().+/_-]", span):
        return False
    if kind == "card":
        return digits.isascii() and 13 <= len(digits) <= 19 and luhn(digits) and len(set(digits)) > 1
    return digits.isascii() and 8 <= len(digits) <= 15


# -- characters -------------------------------------------------------------------------

_MARKS = "@.-_+%()[]/:=,'\"*#$&|<>;!?"
_CLASS = np.full(128, 5, np.int64)  # other ASCII
_CLASS[48:58], _CLASS[97:123], _CLASS[65:91] = 1, 2, 3
_CLASS[32], _CLASS[[9, 10, 13]] = 6, 7
for _i, _c in enumerate(_MARKS):
    _CLASS[ord(_c)] = 8 + _i
_FIRST_WORD = 8 + len(_MARKS)
for _i, _c in enumerate("adot"):  # letters of the spelled-out marks
    _CLASS[ord(_c)] = _FIRST_WORD + _i
N_CLASSES = _FIRST_WORD + 4


def classes(text: str) -> np.ndarray:
    """Class of each code point; beyond ASCII is class 4, padding is 0."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 128, _CLASS[np.minimum(points, 127)], 4)


TAGS = ["O", *[f"{p}-{k}" for k in KINDS for p in "BI"]]
N_TAGS = len(TAGS)


def _allowed() -> np.ndarray:
    out = np.ones((N_TAGS, N_TAGS), bool)
    for k in range(len(KINDS)):
        inner = 2 + 2 * k
        out[:, inner] = False
        out[[inner - 1, inner], inner] = True
    return out


ALLOWED = _allowed()


def tags_of(length: int, spans: list[tuple[str, int, int]]) -> np.ndarray:
    out = np.zeros(length, np.int64)
    for kind, a, b in spans:
        k = 1 + 2 * KINDS.index(kind)
        out[a:b] = k + 1
        out[a] = k
    return out


# -- network ----------------------------------------------------------------------------


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


@dataclass
class Tagger:
    """Weights by name; ``f`` and ``b`` stand for the two directions."""

    weights: dict[str, np.ndarray]

    def scores(self, x: np.ndarray, keep: bool = False):
        """Tag scores of class windows (n, length), and the states if they are to be kept."""
        states = {d: _run_lstm(x if d == "f" else x[:, ::-1], self.weights, d, keep) for d in "fb"}
        h = np.concatenate([states["f"][0], states["b"][0][:, ::-1]], axis=2)
        out = h @ self.weights["out"] + self.weights["out_bias"]
        return (out, h, states) if keep else out

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tags, and each position's part of the path score less that of no span."""
        e, a = self.scores(x), np.where(ALLOWED, self.weights["move"], -1e4)
        n, length, _ = e.shape
        start = np.where(np.arange(N_TAGS) % 2 == 0, -1e4, 0.0)
        start[0] = 0
        best = e[:, 0] + start
        back = np.empty((n, length, N_TAGS), np.int8)
        for t in range(1, length):
            total = best[:, :, None] + a[None]
            back[:, t] = total.argmax(axis=1)
            best = total.max(axis=1) + e[:, t]
        tags = np.empty((n, length), np.int64)
        tags[:, -1] = best.argmax(axis=1)
        rows = np.arange(n)
        for t in range(length - 1, 0, -1):
            tags[:, t - 1] = back[rows, t, tags[:, t]]
        gain = np.take_along_axis(e, tags[:, :, None], axis=2)[:, :, 0] - e[:, :, 0]
        gain[:, 1:] += a[tags[:, :-1], tags[:, 1:]] - a[0, 0]
        return tags, gain


def _run_lstm(x, w, d, keep):
    n, length = x.shape
    size = w[f"h_{d}"].shape[0]
    given = w[f"x_{d}"][x] + w[f"bias_{d}"]
    h, c = np.zeros((n, size), np.float32), np.zeros((n, size), np.float32)
    out = np.empty((n, length, size), np.float32)
    kept = []
    for t in range(length):
        z = given[:, t] + h @ w[f"h_{d}"]
        gates = _sigmoid(z[:, :3 * size])
        i, f, o = gates[:, :size], gates[:, size:2 * size], gates[:, 2 * size:]
        g = np.tanh(z[:, 3 * size:])
        before, c = c, f * c + i * g
        tc = np.tanh(c)
        if keep:
            kept.append((h, before, i, f, o, g, tc))
        h = o * tc
        out[:, t] = h
    return out, kept


def _lstm_gradient(x, w, d, kept, dout, grads):
    n, length = x.shape
    size = w[f"h_{d}"].shape[0]
    dh, dc = np.zeros((n, size), np.float32), np.zeros((n, size), np.float32)
    dz_all = np.empty((n, length, 4 * size), np.float32)
    for t in range(length - 1, -1, -1):
        h, before, i, f, o, g, tc = kept[t]
        dh = dh + dout[:, t]
        dc = dc + dh * o * (1 - tc * tc)
        dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
        dz_all[:, t] = dz
        grads[f"h_{d}"] += h.T @ dz
        dh, dc = dz @ w[f"h_{d}"].T, dc * f
    one_hot = (np.arange(N_CLASSES)[:, None] == x.ravel()[None]).astype(np.float32)
    grads[f"x_{d}"] += one_hot @ dz_all.reshape(-1, 4 * size)
    grads[f"bias_{d}"] += dz_all.sum(axis=(0, 1))


def _logsum(x, axis):
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def loss_and_gradient(tagger: Tagger, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean negative log-likelihood of the tags, and its gradient."""
    w = tagger.weights
    e, h, states = tagger.scores(x, keep=True)
    n, length, _ = e.shape
    a = w["move"]
    alpha, beta = np.empty_like(e), np.zeros_like(e)
    alpha[:, 0] = e[:, 0]
    for t in range(1, length):
        alpha[:, t] = _logsum(alpha[:, t - 1][:, :, None] + a[None], 1) + e[:, t]
    for t in range(length - 2, -1, -1):
        beta[:, t] = _logsum(a[None] + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
    total = _logsum(alpha[:, -1], 1)
    rows = np.arange(n)
    path = np.take_along_axis(e, y[:, :, None], 2)[:, :, 0].sum(axis=1) + a[y[:, :-1], y[:, 1:]].sum(axis=1)
    de = np.exp(alpha + beta - total[:, None, None])
    np.subtract.at(de, (rows[:, None], np.arange(length)[None], y), 1)
    de /= n
    move = np.zeros_like(a)
    for t in range(1, length):
        move += np.exp(alpha[:, t - 1][:, :, None] + a[None] + (e[:, t] + beta[:, t])[:, None, :] - total[:, None, None]).sum(axis=0)
    np.subtract.at(move, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
    grads = {k: np.zeros_like(v) for k, v in w.items()}
    grads["move"] = move / n
    size = h.shape[2] // 2
    grads["out"] = h.reshape(-1, 2 * size).T @ de.reshape(-1, N_TAGS)
    grads["out_bias"] = de.sum(axis=(0, 1))
    dh = de @ w["out"].T
    _lstm_gradient(x, w, "f", states["f"][1], dh[:, :, :size], grads)
    _lstm_gradient(x[:, ::-1], w, "b", states["b"][1], dh[:, ::-1, size:], grads)
    return float((total - path).mean()), grads


def train(windows: list[tuple[str, list[tuple[str, int, int]]]], size: int = 16, rounds: int = 500, batch: int = 40, rate: float = 0.01,
          length: int = 64, seed: int = 7) -> Tagger:
    """Fit to labelled windows, each round rewriting some spans and adding look-alikes."""
    rng = np.random.default_rng(seed)
    scale = 1 / np.sqrt(size)

    def init(*shape):
        return (rng.standard_normal(shape) * scale).astype(np.float32)

    w = {"out": init(2 * size, N_TAGS), "out_bias": np.zeros(N_TAGS, np.float32), "move": np.where(ALLOWED, 0, -4).astype(np.float32)}
    for d in "fb":
        w |= {f"x_{d}": init(N_CLASSES, 4 * size), f"h_{d}": init(size, 4 * size), f"bias_{d}": np.zeros(4 * size, np.float32)}
        w[f"bias_{d}"][size:2 * size] = 1
    tagger = Tagger(w)
    m = {k: np.zeros_like(v) for k, v in w.items()}
    v = {k: np.zeros_like(x) for k, x in w.items()}
    by_kind: dict[str, list] = {k: [] for k in (*KINDS, "none")}
    for text, spans in windows:
        by_kind[spans[0][0] if spans else "none"].append((text, spans))
    for t in range(1, rounds + 1):
        x, y = np.zeros((batch, length), np.int64), np.zeros((batch, length), np.int64)
        for r in range(batch):
            text, spans = _example(rng, by_kind, length)
            got = classes(text)[:length]
            x[r, :len(got)] = got
            y[r, :len(got)] = tags_of(len(text), spans)[:length]
        _, g = loss_and_gradient(tagger, x, y)
        norm = np.sqrt(sum(float((q * q).sum()) for q in g.values()))
        step = rate * (1 if t < rounds * 2 // 3 else 0.2)
        for k in w:
            g[k] *= min(1.0, 3 / (norm + 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            v[k] = 0.995 * v[k] + 0.005 * g[k] * g[k]
            w[k] -= (step * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(v[k] / (1 - 0.995 ** t)) + 1e-6)).astype(np.float32)
    return tagger


def _number(rng, n: int) -> str:
    return "".join(str(d) for d in rng.integers(0, 10, n))


def _word(rng) -> str:
    return "".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9)))


def _span(rng, kind: str) -> str:
    """A span of the kind in one of the ways people write it."""
    pick = rng.integers(0, 4)
    if kind == "email":
        host = [_word(rng), *[_word(rng) for _ in range(rng.integers(0, 2))], "com" if pick % 2 else "org"]
        local = _word(rng) + ("." + _word(rng) if pick > 1 else _number(rng, int(rng.integers(0, 3))))
        at, dot = (("@", "."), (" [at] ", " [dot] "), ("(at)", "."), (" @ ", "."))[rng.integers(0, 4)]
        out = local + at + dot.join(host)
        return out.upper() if rng.random() < 0.1 else out
    if kind == "ip":
        return (".", " . ", "[.]", ".")[pick].join(str(p) for p in rng.integers(0, 256, 4))
    if kind == "card":
        digits = _number(rng, 16)
        return (" ", "-", ".", "/")[pick].join(digits[i:i + 4] for i in range(0, 16, 4)) if rng.random() < 0.7 else digits
    a, b, c = _number(rng, 3), _number(rng, 3), _number(rng, 4)
    return (f"+{rng.integers(1, 99)} ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"00{rng.integers(1, 99)} {a} {b} {c}")[pick]


def _lookalike(rng) -> str:
    n = int(rng.integers(0, 1000))
    return (f"20{_number(rng, 2)}-0{n % 9 + 1}-1{n % 9}", f"v{n % 9}.{n % 7}.{n % 5}", f"{n}.{n % 90 + 10} USD", f"no. {_number(rng, 6)}",
            f"\"{''.join('0123456789abcdef'[i] for i in rng.integers(0, 16, 40))}\"", f"{n % 12}:{n % 50 + 10}", f"{n} of {n + 5}",
            f"Version {n % 5}.0", _number(rng, int(rng.integers(1, 7))), f"({n})", "(attached)", "@ all", f"{n}-{n + 3}")[rng.integers(0, 13)]


def _example(rng, by_kind: dict[str, list], length: int) -> tuple[str, list[tuple[str, int, int]]]:
    kind = (*KINDS, "none", "none")[rng.integers(0, 6)]
    found = by_kind[kind]
    if found and rng.random() < 0.6:
        text, spans = found[rng.integers(0, len(found))]
        if spans and rng.random() < 0.5:
            which, a, b = spans[0]
            new = _span(rng, which)
            return text[:a] + new + text[b:], [(which, a, a + len(new)), *[(k, s - b + a + len(new), e - b + a + len(new)) for k, s, e in spans[1:]]]
        return text, spans
    plain = by_kind["none"]
    around = plain[rng.integers(0, len(plain))][0] if plain and rng.random() < 0.7 else " ".join(_word(rng) for _ in range(12))
    around = re.sub(r"[0-9@+]+", "", around)
    at = int(rng.integers(0, max(1, length - 34)))
    head, tail = around[:at].rstrip() + " " if at else "", around[at:]
    middle = _lookalike(rng) if kind == "none" else _span(rng, kind)
    return head + middle + (" " if rng.random() < 0.7 else ". ") + tail, [] if kind == "none" else [(kind, len(head), len(head) + len(middle))]


# -- Spark ------------------------------------------------------------------------------


def sample_windows(texts: list[str], length: int = 64, most: int = 6) -> list[list[dict]]:
    """Windows around spans and other triggers of each text, with the patterns' spans in them."""
    out = []
    for text in texts:
        spans = sorted((a, b, k) for k, found in pattern_spans(text).items() for a, b in found)
        centres = [a for a, _, _ in spans][:most // 2] + [m.start() for _, m in zip(range(200), TRIGGER.finditer(text)) if not any(a <= m.start() < b for a, b, _ in spans)][:most // 2]
        made = []
        for c in centres:
            a = max(0, c - (c * 7919 % (length - 30)))
            b = a + length
            inner = [(k, s - a, e - a) for s, e, k in spans if s >= a and e <= b]
            if any(s < b and e > a and not (s >= a and e <= b) for s, e, _ in spans):
                continue
            clean, end = [], 0
            for k, s, e in inner:
                if s >= end:
                    clean.append({"kind": k, "start": s, "end": e})
                    end = e
            made.append({"text": text[a:b], "spans": clean})
        out.append(made)
    return out


def train_tagger(docs: DataFrame, key: str = "doc_id", text: str = "text", max_documents: int = 3000, seed: int = 21, **settings) -> Tagger:
    """Fit on windows from a bounded sample of the documents with a digit or an ``@``."""
    ids = docs.where(F.col(text).rlike("[0-9@]")).select(F.col(key).alias("key")).where("key is not null")
    chosen = bounded_sample(ids, ["key"], max_documents, seed).distinct()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(chosen), "key")
    fields = "windows array<struct<text:string,spans:array<struct<kind:string,start:bigint,end:bigint>>>>"
    got = map_texts(rows, ["key"], fields, lambda texts: {"windows": sample_windows(texts)}).dropDuplicates(["key"]).orderBy("key").toLocalIterator()
    windows = [(w["text"], [(s["kind"], s["start"], s["end"]) for s in w["spans"]]) for r in got for w in r["windows"]]
    return train(windows, **settings)


def model_spans(texts: list[str], tagger: Tagger, batch: int = 256) -> list[list[tuple[str, int, int, float]]]:
    """Candidates (kind, start, end, gain) of each text from all its windows.

    A span cut by an edge of its window, and not seen whole by another one, is looked at again
    in windows twice as wide, until one holds it.
    """
    coded: dict[int, np.ndarray] = {}
    hot: set[tuple[int, int]] = set()
    for d, text in enumerate(texts):
        if triggered(text):
            coded[d] = classes(text)
            hot.update((d, g) for m in TRIGGER.finditer(text) for g in (m.start() // STRIDE - 1, m.start() // STRIDE) if g >= 0)
    out: list[list] = [[] for _ in texts]
    width = WINDOW
    while hot:
        whole, cut = _window_spans(coded, sorted(hot), width, tagger, max(1, batch * WINDOW // width))
        for d, *span in whole:
            out[d].append(tuple(span))
        stride, hot = width, set()
        seen: dict[tuple[int, str], list[tuple[int, int]]] = {}
        for d, kind, a, b, _ in whole:
            seen.setdefault((d, kind), []).append((a, b))
        for (d, kind), spans in seen.items():
            seen[d, kind] = _outermost(spans)
        for d, kind, a, b in cut:
            if _can_go_on(kind, texts[d], a, b) and not _within(seen.get((d, kind), []), a, b):
                hot.update((d, g) for p in (a, b - 1) for g in (p // stride - 1, p // stride) if g >= 0)
        width *= 2
    return out


def _window_spans(coded: dict[int, np.ndarray], windows: list[tuple[int, int]], width: int, tagger: Tagger, batch: int) -> tuple[list, list]:
    """(text, kind, start, end, gain) of spans that a window holds whole, and (text, kind, start, end) of pieces cut by its edges."""
    whole, cut = [], []
    for first in range(0, len(windows), batch):
        part = [(d, g * (width // 2)) for d, g in windows[first:first + batch]]
        x = np.zeros((len(part), width), np.int64)
        for r, (d, a) in enumerate(part):
            piece = coded[d][a:a + width]
            x[r, :len(piece)] = piece
        tags, gain = tagger.decode(x)
        for r in np.flatnonzero(tags.any(axis=1)):
            d, at = part[r]
            for b in np.flatnonzero(tags[r] % 2 == 1):
                e = b + 1
                while e < width and tags[r, e] == tags[r, b] + 1:
                    e += 1
                kind = KINDS[(tags[r, b] - 1) // 2]
                if (b == 0 and at > 0) or (e == width and at + width < len(coded[d])):
                    cut.append((d, kind, at + int(b), at + int(e)))
                elif at + e <= len(coded[d]):
                    whole.append((d, kind, at + int(b), at + int(e), float(gain[r, b:min(e + 1, width)].sum())))
    return whole, cut


_FOREIGN = {
    "email": re.compile(r"[^\w.%+@\[\]() -]|\w \w", re.A),
    "ip": re.compile(r"[^\d.\[\] ]", re.A),
    "card": re.compile(r"[^\d\s().+/_-]", re.A),
    "phone": re.compile(r"[^\d\s().+/_-]", re.A),
}
#: what a span of the kind has at most so many of
_AT_MOST = {
    "email": (re.compile(r"@|[\[(] ?at ?[\])]", re.I), 1),
    "ip": (re.compile(r"\d+", re.A), 4),
    "card": (re.compile(r"\d", re.A), 19),
    "phone": (re.compile(r"\d", re.A), 15),
}


def _can_go_on(kind: str, text: str, a: int, b: int) -> bool:
    """Whether some longer span around this piece could pass the rules of its kind."""
    counted, most = _AT_MOST[kind]
    return not _FOREIGN[kind].search(text, a, b) and len(counted.findall(text, a, b)) <= most


def _outermost(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans that lie in no other one, by start and so by end."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans, key=lambda s: (s[0], -s[1])):
        if not out or b > out[-1][1]:
            out.append((a, b))
    return out


def _within(spans: list[tuple[int, int]], a: int, b: int) -> bool:
    """Whether one of the outermost spans holds [a, b)."""
    i = bisect_right(spans, (a, float("inf"))) - 1
    return i >= 0 and b <= spans[i][1]


def reconcile(candidates: list[tuple[str, int, int, float]], fixed: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    """The non-overlapping candidates of largest total gain that touch no fixed span."""
    best: dict[tuple[str, int, int], float] = {}
    for kind, a, b, gain in candidates:
        if gain > 0 and not any(a < e and s < b for s, e in fixed):
            best[kind, a, b] = max(gain, best.get((kind, a, b), 0.0))
    ranked = sorted(best, key=lambda c: (c[2], c[1], c[0]))
    ends = np.array([c[2] for c in ranked])
    total, taken = [0.0], []
    for i, c in enumerate(ranked):
        j = int(np.searchsorted(ends[:i], c[1], "right"))
        with_it = total[j] + best[c]
        taken.append((with_it > total[i], j))
        total.append(max(with_it, total[i]))
    out, i = [], len(ranked)
    while i:
        if taken[i - 1][0]:
            out.append(ranked[i - 1])
            i = taken[i - 1][1]
        else:
            i -= 1
    return out[::-1]


def spans_of(texts: list[str], tagger: Tagger) -> tuple[list[list[tuple]], list[list[tuple]]]:
    """Pattern spans and added spans of each text, each by kind as listed, then by start."""
    base, added = [], []
    for text, candidates in zip(texts, model_spans(texts, tagger)):
        found = pattern_spans(text) if triggered(text) else {k: [] for k in KINDS}
        fixed = [s for spans in found.values() for s in spans]
        more = reconcile([c for c in candidates if passes(c[0], text, c[1], c[2])], fixed)
        base.append([(k, a, b) for k in KINDS for a, b in found[k]])
        added.append(sorted(more, key=lambda s: (KINDS.index(s[0]), s[1])))
    return base, added


_SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


def find_spans(docs: DataFrame, tagger: Tagger, keys: list[str] = ["doc_id"], text: str = "text") -> DataFrame:
    """(keys, base, added) spans of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(tagger)

    def named(spans):
        return [[{"kind": k, "start": a, "end": b} for k, a, b in one] for one in spans]

    def work(texts: list[str]) -> dict[str, list]:
        base, added = spans_of(texts, shared.value)
        return {"base": named(base), "added": named(added)}

    return map_texts(docs, keys, f"base {_SPANS}, added {_SPANS}", work, text)


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind in angle brackets; overlapping ones become one."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, tagger: Tagger, text: str = "text") -> DataFrame:
    """The documents with personal data masked; other columns and null texts stay as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(tagger)

    def work(texts: list[str]) -> dict[str, list]:
        base, added = spans_of(texts, shared.value)
        return {"_masked": [masked(t, [*b, *a]) if b or a else None for t, b, a in zip(texts, base, added)]}

    done = map_texts(docs, docs.columns, "_masked string", work, text)
    return done.select(*[F.coalesce("_masked", c).alias(c) if c == text else F.col(c) for c in docs.columns])
