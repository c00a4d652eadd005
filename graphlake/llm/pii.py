"""Personal data by rules and a semi-Markov conditional random field.

Rules (kind, pattern, test) find the base spans.  Around digits and ``@`` a segment model looks for more: text is cut
into tokens, every run of at most ``MAX_TOKENS`` tokens (and ``MAX_CHARS`` characters) that begins and ends with whole words is
a candidate segment with features of the *whole* span
(digits, groups, separators, shape, checksum, the words around), segments side by side have transition scores by
their types, and dynamic programming chooses boundaries and types jointly.  Weights are fitted by gradient of the segment-level conditional log-likelihood on
generated sentences (``training_set``), with the forward-backward recursion; the same seed gives the same weights.

The model adds spans of the base kinds that the patterns miss (phones without a plus, cards or addresses
written apart) and of the kinds ``id`` (national numbers), ``iban`` and ``secret`` (keys and tokens).  A span
that overlaps a base span is left out: base spans always stay.

Nulls and edges: null or empty text has no spans; positions are code points, end exclusive; a null ``doc_id`` is
reported; repeated rows are reported each.  Every region is decided as a whole, however long: it is read in pieces
of ``PIECE`` tokens and solved up to the last place that no possible entity crosses, which changes nothing.
"""

from __future__ import annotations

import bisect
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import extend

BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "iban", "id", "secret"]
#: The longest forms are written-out addresses (some 30 tokens, blanks and marks counted) and account numbers in groups.
MAX_TOKENS = 34
MAX_CHARS = 256
PIECE = 2048
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_TRIGGER = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c)
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the rules, by start, then kind."""
    out = []
    # An address needs a local part before its @: what stands there since the last @ or the last address.  One look at each @.
    at, done, since = text.find("@"), 0, 0
    while at >= 0:
        a, floor = at, max(done, since)
        while a > floor and text[a - 1] in _LOCAL:
            a -= 1
        if a < at and (m := _DOMAIN.match(text, at + 1)):
            out.append(("email", a, m.end()))
            done = m.end()
        since = at + 1
        at = text.find("@", since)
    if re.search("[0-9]", text):
        # Numbers joined by dots, four by four from the left, are what the pattern matches; runs are read once.
        for m in _DOTTED.finditer(text):
            if m.group().count(".") < 3:
                continue
            parts, place = m.group().split("."), m.start()
            for k in range(0, len(parts) - 3, 4):
                four = parts[k : k + 4]
                size = sum(map(len, four)) + 3
                if all(int(p[-4:]) <= 255 and not p[:-3].strip("0") for p in four):
                    out.append(("ip", place, place + size))
                place += size + 1
        for m in _CARD.finditer(text):
            d = _digits(m.group())
            if 14 <= len(d) <= 19 and luhn(d):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_digits(m.group())) <= 15:
                    out.append(("phone", m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], BASE.index(s[0])))


# --- the segment model ---------------------------------------------------------------------------------------

_TOKEN = re.compile(r"[A-Za-z0-9_]{20,}|[A-Za-z\u0080-\U0010FFFF]+|[0-9]+|\s|[^\sA-Za-z0-9\u0080-\U0010FFFF]")
_HEX = re.compile(r"[0-9a-f]{16,}|[0-9A-F]{16,}")
_LONG = re.compile(r"[A-Za-z0-9_\-]{20,}")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?")
_AT = re.compile(r"[\w.%+-]+ ?(?:@|\(at\)|\[at\]) ?[\w-]+(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z]{2,})+")
_SPELLED = re.compile(r"[(\[]at[)\]]")
_MORE_LEFT = re.compile(r"[0-9][ .)-]{1,2}$")
_MORE_RIGHT = re.compile(r"[ .(-]{1,2}[0-9]")
_WORDS = {
    "phone": {"phone", "tel", "telephone", "call", "mobile", "fax", "cell", "ring"},
    "card": {"card", "visa", "mastercard", "credit", "amex"},
    "email": {"mail", "email", "contact", "write"},
    "ip": {"ip", "host", "server", "address", "from"},
    "id": {"ssn", "social", "passport", "security", "national"},
    "iban": {"iban", "account", "bank"},
    "secret": {"token", "key", "secret", "password", "apikey", "api", "bearer"},
}
NAMES = [
    "one", "has_letter", "has_at", "mail_shape", "dots3", "ip_shape", "octets", "d_lt7", "d7_9", "d10_11", "d12_15", "d16", "d17_19", "d20_up", "luhn",
    "parens", "plus", "dashes", "blank", "groups_334", "groups_4444", "groups_324", "hex", "long_mix", "iban_shape", "edge_bad", "cut_left", "cut_right",
    "quoted", "more_left", "more_right", *(f"near_{k}" for k in _WORDS),
]
N_FEATURES = len(NAMES)


def tokens_of(text: str, start: int, end: int) -> list[tuple[int, int]]:
    return [m.span() for m in _TOKEN.finditer(text, start, end)]


def features(text: str, a: int, z: int) -> np.ndarray | None:
    """Of the span [a, z) as a whole; None if it can't be an entity at all."""
    s = text[a:z]
    if not _TRIGGER.search(s) and "(at)" not in s and "[at]" not in s or s[0].isspace() or s[-1].isspace() or "\n" in s:
        return None
    d = _digits(s)
    n = len(d)
    groups = [len(g) for g in re.findall("[0-9]+", s)]
    letter = bool(re.search("[A-Za-z]", s))
    left, right = text[a - 1 : a], text[z : z + 1]
    parts = s.split(".")
    f = np.zeros(N_FEATURES)
    plain = not letter
    alnum = lambda c: bool(c) and (c.isalnum() or c == "_")
    values = [
        1, letter, "@" in s, bool(_AT.fullmatch(s)), s.count(".") == 3, len(parts) == 4 and all(p.strip().isdigit() for p in parts),
        len(parts) == 4 and all(p.strip().isdigit() and len(p.strip()) < 4 and int(p) < 256 for p in parts),
        plain and n < 7, plain and 7 <= n < 10, plain and 10 <= n < 12, plain and 12 <= n < 16, plain and n == 16, plain and 17 <= n < 20, plain and n > 19,
        plain and 13 <= n <= 19 and luhn(d), bool(re.match(r"(?:\+[0-9]+ )?\([0-9]{2,4}\)", s)), s[0] == "+", "-" in s and plain, " " in s and plain,
        groups[-3:] == [3, 3, 4] and plain, groups == [4, 4, 4, 4] and plain, groups == [3, 2, 4] and plain, bool(_HEX.fullmatch(s)) and letter and n > 0,
        bool(_LONG.fullmatch(s)) and letter and n > 2 and len(set(s)) > 10, bool(_IBAN.fullmatch(s)), not (alnum(s[-1]) and (alnum(s[0]) or s[0] in "(+")),
        alnum(left) and alnum(s[0]) or left in ("@", "+") and left != "", alnum(right) and alnum(s[-1]) or right == "@" or right == "." and alnum(text[z + 1 : z + 2]), left in "\"'`" and right in "\"'`" and left == right and left != "",
        bool(_MORE_LEFT.search(text, max(0, a - 3), a)), bool(_MORE_RIGHT.match(text, z)),
    ]
    f[: len(values)] = values
    before = {w.lower() for w in re.findall("[A-Za-z]+", text[max(0, a - 24) : a])}
    for k, (_, words) in enumerate(_WORDS.items()):
        f[len(values) + k] = bool(words & before)
    return f


def lattice(text: str, tokens: list[tuple[int, int]], low: int = 0, high: int | None = None) -> list[tuple[int, int, np.ndarray]]:
    """Candidate segments (first token, end token, features) whose first token is one of ``low`` to ``high``."""
    out = []
    for i in range(low, len(tokens) if high is None else min(high, len(tokens))):
        a = tokens[i][0]
        c = text[a]
        if not (c.isalnum() or c in "(+") or c.isalnum() and a and text[a - 1].isalnum():
            continue
        stop = tokens[min(len(tokens), i + MAX_TOKENS) - 1][1]
        spelled = "@" in text[a : min(stop, a + MAX_CHARS)] or _SPELLED.search(text, a, min(stop, a + MAX_CHARS)) is not None
        small = blank = False
        for j in range(i + 1, min(len(tokens), i + MAX_TOKENS) + 1):
            b, z = tokens[j - 1]
            said = text[b]
            if said == "\n" or z - a > MAX_CHARS:
                break
            if said.isspace():
                blank = True
                continue
            small = small or said.isalpha() and not text[b:z].isupper()
            if small and blank and not spelled:  # of several words in small letters only an address can be made
                break
            if not text[z - 1].isalnum() or z < len(text) and text[z].isalnum():
                continue
            f = features(text, a, z)
            if f is not None:
                out.append((i, j, f))
    return out


def _lse(x: np.ndarray, axis: int = 0) -> np.ndarray:
    top = np.maximum(x.max(axis=axis), -1e300)
    return top + np.log(np.exp(x - np.expand_dims(top, axis)).sum(axis=axis))


class SemiMarkovCRF:
    """Types over segments, with a score for each type following another; a token outside entities is a segment of its own with score 0."""

    OUT = len(KINDS)

    def __init__(self, weights: np.ndarray | None = None, transitions: np.ndarray | None = None):
        self.w = np.zeros((len(KINDS), N_FEATURES)) if weights is None else weights
        self.t = np.zeros((self.OUT + 1, self.OUT + 1)) if transitions is None else transitions  # from, to; outside to outside stays 0

    def _forward(self, n: int, segments, scores) -> tuple[np.ndarray, np.ndarray]:
        """By place and type: log-sums of the paths whose last segment of that type ends there, and of those that go on with that type."""
        ending: list[list[int]] = [[] for _ in range(n + 1)]
        for x, (_, j, _) in enumerate(segments):
            ending[j].append(x)
        alpha, on = np.full((n + 1, self.OUT + 1), -np.inf), np.full((n + 1, self.OUT + 1), -np.inf)
        alpha[0, self.OUT] = 0.0
        on[0] = self.t[self.OUT]
        for j in range(1, n + 1):
            alpha[j, self.OUT] = on[j - 1, self.OUT]
            for x in ending[j]:
                alpha[j, : self.OUT] = np.logaddexp(alpha[j, : self.OUT], on[segments[x][0], : self.OUT] + scores[x])
            on[j] = _lse(alpha[j][:, None] + self.t) if ending[j] else alpha[j, self.OUT] + self.t[self.OUT]
        return alpha, on

    def _backward(self, n: int, segments, scores) -> tuple[np.ndarray, np.ndarray]:
        """By place and type: log-sums of what follows a segment of that type, and of what begins there with that type."""
        starting: list[list[int]] = [[] for _ in range(n + 1)]
        for x, (i, _, _) in enumerate(segments):
            starting[i].append(x)
        beta, begin = np.zeros((n + 1, self.OUT + 1)), np.full((n + 1, self.OUT + 1), -np.inf)
        for i in range(n - 1, -1, -1):
            begin[i, self.OUT] = beta[i + 1, self.OUT]
            for x in starting[i]:
                begin[i, : self.OUT] = np.logaddexp(begin[i, : self.OUT], scores[x] + beta[segments[x][1], : self.OUT])
            beta[i] = _lse(self.t + begin[i][None, :], 1) if starting[i] else self.t[:, self.OUT] + begin[i, self.OUT]
        return beta, begin

    def gradient(self, n: int, segments, gold: set[tuple[int, int, int]]) -> tuple[float, np.ndarray, np.ndarray]:
        """Log-likelihood of the gold segments (first, end, kind) and its gradients by weights and transitions."""
        g, gt = np.zeros_like(self.w), np.zeros_like(self.t)
        f = np.array([s[2] for s in segments]).reshape(-1, N_FEATURES)
        scores = f @ self.w.T
        alpha, on = self._forward(n, segments, scores)
        beta, begin = self._backward(n, segments, scores)
        z = _lse(alpha[n])
        value = -z
        if len(segments):
            i, j = np.array([s[0] for s in segments]), np.array([s[1] for s in segments])
            p = np.exp(on[i][:, : self.OUT] + scores + beta[j][:, : self.OUT] - z)
            g -= p.T @ f
            for x, (a, b, v) in enumerate(segments):
                for k in range(len(KINDS)):
                    if (a, b, k) in gold:
                        g[k] += v
                        value += scores[x, k]
        gt -= np.exp(alpha[:-1, :, None] + self.t + begin[:-1, None, :] - z).sum(0)
        last, at = self.OUT, 0
        for a, b, k in [*sorted(gold), (n, n, self.OUT)]:
            labels = ([self.OUT] if a > at else []) + ([k] if a < n else [])
            gt[self.OUT, self.OUT] += max(0, a - at - 1)
            for to in labels:
                gt[last, to] += 1
                value += self.t[last, to]
                last = to
            at = b
        gt[self.OUT, self.OUT] = 0.0
        return value, g, gt

    def fit(self, data: list[tuple[str, list[tuple[str, int, int]]]], epochs: int = 10, rate: float = 0.4, decay: float = 1e-4) -> SemiMarkovCRF:
        ready = []
        for text, spans in data:
            tokens = tokens_of(text, 0, len(text))
            first, end = {a: i for i, (a, _) in enumerate(tokens)}, {z: i + 1 for i, (_, z) in enumerate(tokens)}
            gold = {(first[a], end[z], KINDS.index(k)) for k, a, z in spans}
            ready.append((len(tokens), lattice(text, tokens), gold))
        total, total_t = np.full_like(self.w, 1e-2), np.full_like(self.t, 1e-2)
        for _ in range(epochs):
            for n, segments, gold in ready:
                _, g, gt = self.gradient(n, segments, gold)
                g -= decay * self.w
                gt -= decay * self.t
                total += g * g
                total_t += gt * gt
                self.w += rate * g / np.sqrt(total)
                self.t += rate * gt / np.sqrt(total_t)
        return self

    def decode(self, text: str, start: int, end: int, piece: int = PIECE) -> list[tuple[str, int, int]]:
        """The best segmentation of text[start:end], entities only."""
        out: list[tuple[str, int, int]] = []
        tokens: list[tuple[int, int]] = []
        more = _TOKEN.finditer(text, start, end)
        wanted, ended = piece, False
        while not ended:
            while len(tokens) < wanted and not ended:
                m = next(more, None)
                ended = m is None
                if m is not None:
                    tokens.append(m.span())
            found = self._possible(text, tokens)
            cut = len(tokens)
            if not ended:
                # A token that no possible entity covers is outside on every best path: what follows doesn't depend on what came.
                covered = np.zeros(len(tokens) + 1, np.int64)
                for i, j, _ in found:
                    covered[i] += 1
                    covered[j] -= 1
                free = np.flatnonzero(np.cumsum(covered)[: max(0, len(tokens) - MAX_TOKENS)] == 0)
                if not len(free):  # possible entities all along: look further
                    wanted = 2 * len(tokens)
                    continue
                cut = int(free[-1]) + 1
            entities = self._best(cut, [x for x in found if x[1] <= cut])
            out += [(KINDS[k], tokens[i][0], tokens[j - 1][1]) for i, j, k in entities]
            tokens, wanted = tokens[cut:], piece + len(tokens) - cut
        return out

    def _possible(self, text: str, tokens: list[tuple[int, int]]) -> list[tuple[int, int, np.ndarray]]:
        """Segments that could be part of a best segmentation, with their scores by type; no more than ``PIECE`` features at once."""
        # The most that transitions can give an entity over tokens outside.
        gain = float(2 * max(0.0, self.t.max()) - min(0.0, self.t.min()))
        out = []
        for low in range(0, len(tokens), 512):
            segments = lattice(text, tokens, low, low + 512)
            if segments:
                scores = np.array([s[2] for s in segments]) @ self.w.T
                out += [(i, j, v) for (i, j, _), v, top in zip(segments, scores, scores.max(1)) if top + gain > 0]
        return out

    def _best(self, n: int, found: list[tuple[int, int, np.ndarray]]) -> list[tuple[int, int, int]]:
        """Entities (first, end, kind) of the best segmentation of ``n`` tokens."""
        ending: dict[int, list[tuple[int, int, np.ndarray]]] = {}
        places = {0, n}
        for i, j, v in found:
            ending.setdefault(j, []).append((i, j, v))
            places |= {i, j}
        best = {0: np.full(self.OUT + 1, -np.inf)}
        best[0][self.OUT] = 0.0
        back: dict[tuple[int, int], tuple[int, int]] = {}  # (place, type) to (place, type) before
        follow = {}
        order = sorted(places)
        for p, j in zip([None, *order], order):
            if p is not None:
                v = np.full(self.OUT + 1, -np.inf)
                into, by = follow[p]
                v[self.OUT] = into[self.OUT]
                back[j, self.OUT] = (p, int(by[self.OUT]))
                for i, _, score in ending.get(j, ()):
                    into, by = follow[i]
                    for k in np.flatnonzero(into[: self.OUT] + score > v[: self.OUT]):
                        v[k] = into[k] + score[k]
                        back[j, int(k)] = (i, int(by[k]))
                best[j] = v
            paths = best[j][:, None] + self.t
            follow[j] = paths.max(0), paths.argmax(0)
        out = []
        at, kind = n, int(best[n].argmax())
        while at > 0:
            before, was = back[at, kind]
            if kind != self.OUT:
                out.append((before, at, kind))
            at, kind = before, was
        return out[::-1]


def training_set(n: int = 240, seed: int = 5) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Generated sentences with marked entities, and numbers that are none."""
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnoprstuvw"), rng.integers(2, 9)))
    num = lambda k: "".join(str(x) for x in rng.integers(0, 10, k))
    pick = lambda *x: x[rng.integers(len(x))]
    upper = lambda k: "".join(rng.choice(list("ABCDEFGHIKLMNOPRST"), k))
    hexa = lambda k: "".join(rng.choice(list("0123456789abcdef"), k))

    def card() -> str:
        d = pick("4", "5", "3") + num(14)
        d += next(c for c in "0123456789" if luhn(d + c))
        return pick(d, " ".join(d[i : i + 4] for i in range(0, 16, 4)), "-".join(d[i : i + 4] for i in range(0, 16, 4)))

    def phone() -> str:
        a, b, c = num(3), num(3), num(4)
        return pick(f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+1 ({a}) {b}-{c}", f"+{num(2)} {a} {b} {c}", f"{a} {b} {c}")

    make = {
        "email": lambda: pick(f"{word()}.{word()}@{word()}.com", f"{word()}{num(2)}@{word()}.example.org", f"{word()} (at) {word()} (dot) com", f"{word()}[at]{word()}.net", f"{word()}.{word()} (at) {word()}.{word()} (dot) co (dot) uk"),
        "ip": lambda: ".".join(str(x) for x in rng.integers(0, 256, 4)),
        "card": card,
        "phone": phone,
        "iban": lambda: pick(
            pick("DE", "FR", "ES", "GB") + num(2) + pick("", " ") + " ".join(num(4) for _ in range(4)) + " " + num(2),
            f"{upper(2)}{num(2)} {upper(4)} {num(4)} {num(4)} {num(4)} {upper(4)} {upper(3)}{num(1)} {num(2)}{upper(1)}",
        ),
        "id": lambda: f"{num(3)}-{num(2)}-{num(4)}",
        "secret": lambda: pick(hexa(40), hexa(32), "sk_" + "".join(rng.choice(list("abcdefghijkLMNOPQRST0123456789"), 28))),
    }
    none = [
        lambda: num(4), lambda: f"{num(1)}.{num(2)}", lambda: f"{rng.integers(1900, 2030)}-{rng.integers(10, 13)}-{rng.integers(10, 29)}", lambda: f"{num(2)}:{num(2)}",
        lambda: f"${num(3)}.{num(2)}", lambda: num(int(rng.integers(1, 10))), lambda: f"{num(1)}.{num(1)}.{num(1)}", lambda: f"v{num(1)}.{num(2)}", lambda: f"{num(1)},{num(3)},{num(3)}",
        lambda: f"{num(2)}/{num(2)}/{num(4)}", lambda: f"{num(3)}-{num(3)}", lambda: f"{word()}{num(2)}", lambda: num(16), lambda: num(22), lambda: f"{num(1)}-{num(3)}-{num(5)}-{num(1)}",
        lambda: f"{num(4)}-{num(4)}", lambda: f"page {num(2)} of {num(3)}", lambda: f"@{word()}", lambda: f"{rng.integers(300, 999)}.{num(3)}.{num(3)}.{rng.integers(300, 999)}",
    ]
    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(rng.integers(2, 5)):
            text += " ".join(word() for _ in range(rng.integers(1, 5))) + pick(" ", ", ", ". ", ": ")
            if rng.random() < 0.55:
                kind = KINDS[rng.integers(len(KINDS))]
                if rng.random() < 0.35:
                    text += pick(*sorted(_WORDS[kind])) + pick(" ", ": ", " = ")
                quote = pick('"', "") if kind == "secret" else ""
                said = make[kind]()
                text += quote
                spans.append((kind, len(text), len(text) + len(said)))
                text += said + quote
            else:
                text += none[rng.integers(len(none))]()
            text += pick(" ", ". ", ", ", " ")
        out.append((text, spans))
    return out


_REACH = 40


def regions(text: str) -> list[tuple[int, int]]:
    """Stretches around digits, ``@`` and spelled-out ats, within their lines."""
    out: list[list[int]] = []
    for m in re.finditer(r"[0-9@]+|[(\[]at[)\]]", text):
        a, z = m.span()
        stop = text.rfind("\n", max(0, a - _REACH), a)
        a = stop + 1 if stop >= 0 else max(0, a - _REACH)
        stop = text.find("\n", z, z + _REACH)
        z = stop if stop >= 0 else min(len(text), z + _REACH)
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            while a > 0 and text[a - 1].isalnum() and text[a].isalnum():
                a -= 1
            out.append([a, z])
        while out[-1][1] < len(text) and text[out[-1][1] - 1].isalnum() and text[out[-1][1]].isalnum():
            out[-1][1] += 1
    return [(a, z) for a, z in out]


def all_spans(text: str, model: SemiMarkovCRF) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans), each by start, then kind."""
    base = base_spans(text)
    added = []
    # Base spans of different kinds may overlap: by start, with the furthest end so far.
    starts, reach = [b for _, b, _ in base], list(itertools.accumulate((e for _, _, e in base), max))
    for a, z in regions(text):
        for k, f, t in model.decode(text, a, z):
            before = bisect.bisect_left(starts, t)
            if not before or reach[before - 1] <= f:
                added.append((k, f, t))
    return base, sorted(base + added, key=lambda s: (s[1], KINDS.index(s[0])))


def _join(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{z}" for k, a, z in spans)


def _find(weights: np.ndarray, transitions: np.ndarray):
    model = SemiMarkovCRF(weights, transitions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base, every = [], []
            for t in b.column("__t"):
                x, y = all_spans(t.as_py(), model) if t.is_valid else ([], [])
                base.append(_join(x))
                every.append(_join(y))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(base, pa.string()), pa.array(every, pa.string())], [*b.schema.names, "base", "spans"])

    return run


def find(docs: DataFrame, model: SemiMarkovCRF | None = None) -> DataFrame:
    """``doc_id``, text (``__t``), base spans and all spans as kind:start:end lists."""
    model = model or SemiMarkovCRF().fit(training_set())
    rows = docs.select("doc_id", F.col("text").cast("string").alias("__t"))
    return rows.mapInArrow(_find(model.w, model.t), extend(rows.schema, "base string, spans string"))


def redact(text: str, spans: str) -> str:
    """``text`` with every span replaced by its kind in angle brackets; overlapping spans become one."""
    out, at = [], 0
    for s in spans.split(",") if spans else []:
        kind, a, z = s.split(":")
        a, z = int(a), int(z)
        if a >= at:
            out.append(text[at:a] + f"<{kind}>")
        at = max(at, z)
    return "".join([*out, text[at:]])


def _is(kind: str):
    return lambda span: span.startswith(kind + ":")


def query(docs: DataFrame) -> DataFrame:
    counts = [F.size(F.filter(F.split("base", ","), _is(k))).cast("long").alias(f"n_{k}") for k in BASE]
    every = F.size(F.filter(F.split("spans", ","), lambda x: x != "")).cast("long")
    return find(docs).select("doc_id", *counts, F.sha2("base", 256).alias("base_sha256"), "spans", every.alias("n_spans"))


#: The base columns of the query that SQL can tell: where no kind's pattern meets itself twice in one run, counting needs no places.
BASE_COLUMNS = ["doc_id", "n_email", "n_ip", "n_card", "n_phone"]
BASE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
x AS (
  SELECT doc_id, len(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+')) AS n_email,
    regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') AS ips,
    list_transform(regexp_extract_all(t, '[0-9]([\x20-]?[0-9])+'), lambda c: regexp_replace(c, '[^0-9]', '', 'g')) AS cards,
    list_transform(regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), lambda c: regexp_replace(c, '[^0-9]', '', 'g')) AS phones
  FROM d)
SELECT doc_id, n_email::BIGINT AS n_email,
  len(list_filter(ips, lambda i: len(list_filter(string_split(i, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(try_cast(ltrim(p, '0') AS INTEGER), 0) > 255)) = 0))::BIGINT AS n_ip,
  len(list_filter(cards, lambda c: length(c) BETWEEN 14 AND 19 AND list_sum(list_transform(range(1, length(c) + 1), lambda i:
    CASE WHEN (length(c) - i) % 2 = 0 THEN c[i]::INTEGER WHEN c[i]::INTEGER > 4 THEN 2 * c[i]::INTEGER - 9 ELSE 2 * c[i]::INTEGER END)) % 10 = 0))::BIGINT AS n_card,
  len(list_filter(phones, lambda c: length(c) BETWEEN 10 AND 15))::BIGINT AS n_phone
FROM x
"""
