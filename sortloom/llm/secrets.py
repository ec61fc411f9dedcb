"""Secrets in whole texts: fixed base patterns, and a linear-chain conditional random field that adds spans.

The field tags tokens as B (a secret begins), I (inside one) or O, from the token's shape, its neighbours and
features of the whole text, and is decoded by Viterbi. Every token of every text gets its weights, many texts at a
time (`Tables`). A token whose weight for O is ahead of B and I by more than any transitions could gain is O on the best
path, whatever stands around it; the path between such tokens is found by Viterbi, so labels are those of the whole text.

The field is trained here, on lines made from templates with a fixed seed (TRAINING of them): assignments,
headers, connection strings and keys as secrets; prose, numbers, checksums, code and contact data as not.

Defined results: null text counts as empty and has no spans; positions are code points, the end exclusive;
texts of any length are scanned whole; repeated rows give equal results; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import cache, lru_cache
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sortloom.llm.common import alone, table

KINDS = ("assign", "access", "hex", "crf")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_WORDS = ("passw", "secret", "token", "apikey", "api_key")
#: Words and prefixes that features name.
SIGNS = ("passw", "pwd", "secret", "token", "apikey", "api_key", "api-key", "access_key", "credential", "authorization", "bearer", "private key", "ghp_", "xoxb-", "sk_live", "sk-", "eyj", "akia", "://", "-----begin")
TOKEN = re.compile(r"[\w+/\-.~=]*[\w+/\-~]|[^\w\s]")
#: The same tokens in time that grows with the text; a run of stops and signs of equality stands for one token each.
RUN = re.compile(r"[.=]*[\w+/\-~]+(?:[.=]+[\w+/\-~]+)*|[.=]+|[^\w\s]")
MARKS = ("..", "==", ".=", "=.")
SPACE = re.compile(r"\s")
#: Characters that are cut into tokens, and tokens that get weights, at a time; tokens that a worker remembers.
PIECE, SLICE, REMEMBERED = 1 << 20, 1 << 18, 400_000
LABELS = "BIO"
TRAINING, ROUNDS, SEED = 1600, 120, 7


# ---- features ------------------------------------------------------------------------------------------------


@lru_cache(100_000)
def _shape(token: str) -> tuple[str, ...]:
    squeezed = re.sub(r"(.)\1+", r"\1", "".join("9" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c for c in token))[:8]
    n = len(token)
    size = "1" if n < 4 else "4" if n < 8 else "8" if n < 16 else "16" if n < 24 else "24" if n < 48 else "48"
    digits, letters = any(c.isdigit() for c in token), any(c.isalpha() for c in token)
    counts = Counter(token)
    entropy = -sum(k / n * math.log2(k / n) for k in counts.values())
    low = token.lower()
    signs = [s for s in SIGNS if s in low]
    kind = "hex" if re.fullmatch(r"[0-9a-f]{16,}", token) else "num" if token.isdigit() else "mix" if digits and letters and n >= 8 else "word" if token.isalpha() else "punct" if n == 1 and not token.isalnum() else "other"
    return (f"shape={squeezed}", f"size={size}", f"kind={kind}", f"kind,size={kind}{size}", f"entropy={int(entropy)}", f"case={token[:1].isupper()}{any(c.isupper() for c in token[1:])}", *(f"sign={s}" for s in signs))


WORDS = ("commit", "sha256", "sha1", "md5", "checksum", "digest", "id", "uuid", "version", "line", "the", "a", "of", "for", "basic", "user", "key", "export", "set")
KIND = ("kind=hex", "kind=num", "kind=mix", "kind=word", "kind=punct", "kind=other")


def _brief(token: str) -> str:
    """What a neighbour sees of a token."""
    if len(token) == 1 and not token.isalnum():
        return token
    low = token.lower()
    for s in SIGNS:
        if s in low:
            return s
    if low in WORDS:
        return low
    return "w" if token.isalpha() else "n" if token.isdigit() else "m"


def text_features(text: str) -> tuple[str, str]:
    """Of the whole text: how much it looks like code or configuration, and its length."""
    marks = sum(map(text.count, "={};<>"))
    return f"marks={min(3, int(100 * marks / (len(text) + 1)))}", f"long={len(text) > 2000}"


def features(tokens: list[str], whole: tuple[str, str]) -> list[list[str]]:
    brief = ["^"] * 4 + [_brief(t) for t in tokens] + ["$"] * 2
    out = []
    for i, t in enumerate(tokens):
        at = i + 4
        own = _shape(t) if len(t) < 256 else _shape.__wrapped__(t)  # long ones aren't remembered
        near = (f"-1={brief[at - 1]}", f"-2={brief[at - 2]},{brief[at - 1]}", f"-3={brief[at - 3]},{brief[at - 2]},{brief[at - 1]}", f"-4={brief[at - 4]}", f"+1={brief[at + 1]}", f"+2={brief[at + 2]}")
        out.append(["1", *own, *near, f"{own[2]},{near[1]}", *whole, f"{own[2]},{whole[0]}"])
    return out


# ---- the field -----------------------------------------------------------------------------------------------


class Field:
    """Weights by feature and label, transitions between labels (from, to), and starts."""

    def __init__(self, weights: dict[str, np.ndarray], moves: np.ndarray):
        self.weights, self.moves = weights, moves

    def emissions(self, rows: list[list[str]]) -> np.ndarray:
        none = np.zeros(3)
        return np.array([sum((self.weights.get(f, none) for f in row), none) for row in rows])

    def viterbi(self, e: np.ndarray, closed: bool = False) -> list[int]:
        """The best labels; before the first token stands O, and if closed, after the last one too."""
        best, back = e[0] + self.moves[2], []
        for x in e[1:]:
            total = best[:, None] + self.moves
            back.append(total.argmax(0))
            best = total.max(0) + x
        labels = [int((best + self.moves[:, 2] if closed else best).argmax())]
        for b in reversed(back):
            labels.append(int(b[labels[-1]]))
        return labels[::-1]

    def spans(self, text: str, start: int, whole: tuple[str, str]) -> list[tuple[int, int]]:
        found = list(TOKEN.finditer(text))
        if not found:
            return []
        out: list[list[int]] = []
        for m, k in zip(found, self.viterbi(self.emissions(features([m.group() for m in found], whole))), strict=True):
            if k == 0 or k == 1 and not (out and out[-1][2]):
                out.append([start + m.start(), start + m.end(), 1])
            elif k == 1:
                out[-1][1] = start + m.end()
            elif out:
                out[-1][2] = 0
        return [(s, e) for s, e, _ in out if e - s >= 6]

    def lead(self) -> np.ndarray:
        """By how much O must be ahead of B and of I at a token to be on the best path, whatever labels stand around it."""
        into = (self.moves[:, :2] - self.moves[:, 2:]).max(0)
        out = (self.moves[:2] - self.moves[2]).max(1)
        return into + np.maximum(0.0, out) + 1e-9


class Classes(dict):
    """For str.translate: what a character's place in a token's shape depends on."""

    def __missing__(self, point: int) -> str:
        c = chr(point)
        out = self[point] = "9" if c.isdigit() else ("A" if c.isalpha() else c) if c.isupper() else "a" if c.isalpha() else c
        return out


CLASSES, HEX16 = Classes(), re.compile("[0-9a-f]{16,}")


@lru_cache(100_000)
def _entropy(counts: tuple[int, ...]) -> int:
    n = sum(counts)
    return int(-sum(k / n * math.log2(k / n) for k in counts))


class Tables(dict):
    """The field's weights as tables, for many tokens at once; and as a dict, the number of each token met so far."""

    def __init__(self, field: Field):
        super().__init__()
        self.field, self.lead = field, field.lead()
        none, get = np.zeros(3), field.weights.get
        known = set("".join(field.weights))
        briefs = ["^", "$", *SIGNS, *WORDS, "w", "n", "m"]
        briefs += sorted(c for c in known if not c.isalnum() and c not in briefs)
        self.code = {b: i for i, b in enumerate(briefs)}  # of the others no feature has a weight: they share the last number
        n = self.n = len(briefs) + 1
        one = lambda name: np.array([get(f"{name}={b}", none) for b in briefs] + [none])
        pair = lambda name: np.array([[get(f"{name}={a},{b}", none) for b in briefs] + [none] for a in briefs] + [[none] * n])
        three = np.zeros((n, n, n, 3))
        for key, w in field.weights.items():
            if key.startswith("-3="):
                for a in (x for x in briefs if key.startswith(f"-3={x},")):
                    for b in (x for x in briefs if key.startswith(f"-3={a},{x},")):
                        if (c := key[len(f"-3={a},{b},") :]) in self.code:
                            three[self.code[a], self.code[b], self.code[c]] = w
        self.before = (three + pair("-2") + one("-1")).reshape(-1, 3)
        self.fourth, self.after = one("-4"), (one("+1")[:, None] + one("+2")).reshape(-1, 3)
        self.kind_before = np.array([pair(f"{k},-2") for k in KIND]).reshape(-1, 3)
        # by marks and length of the whole text, and by kind
        self.shared = np.array([get(f"marks={i}", none) + get(f"{k},marks={i}", none) + get(f"long={x}", none) for i in range(4) for x in (False, True) for k in KIND])
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.shapes: dict[tuple, int] = {}  # the numbers of shapes, which many tokens share
        self.own, self.kind = np.zeros((1 << 10, 3)), np.zeros(1 << 10, np.int64)
        self.shape, self.brief = np.zeros(1 << 12, np.int32), np.zeros(1 << 12, np.int32)
        self.used, self.long = 2, []  # the first two numbers stand for what is before and after a text
        self.brief[:2] = self.code["^"], self.code["$"]

    def __missing__(self, token: str) -> int:
        at, self.used = self.used, self.used + 1
        if at == len(self.brief):
            self.shape, self.brief = np.concatenate([self.shape, self.shape]), np.concatenate([self.brief, self.brief])
        low, n = token.lower(), len(token)
        signs = tuple(x for x in SIGNS if x in low) if n > 2 else ()
        if n >= 256:
            key = at  # long ones aren't remembered
            self.long.append(token)
        else:
            key = token.translate(CLASSES), _entropy(tuple(map(token.count, dict.fromkeys(token)))), signs, n >= 16 and HEX16.fullmatch(token) is not None
        if (shape := self.shapes.get(key)) is None:
            shape = self.shapes[key] = len(self.shapes)
            if shape == len(self.kind):
                self.own, self.kind = np.concatenate([self.own, self.own]), np.concatenate([self.kind, self.kind])
            names = _shape.__wrapped__(token)
            self.own[shape] = sum((self.field.weights[f] for f in ("1", *names) if f in self.field.weights), np.zeros(3))
            self.kind[shape] = KIND.index(names[2])
        self.shape[at] = shape
        self.brief[at] = self.code[signs[0]] if signs else self.code.get(_brief(token), self.n - 1)
        self[token] = at
        return at

    def numbers(self, text: str) -> list[np.ndarray]:
        """The tokens' numbers, by piece of the text."""
        out = []
        for a, b in pieces(text):
            found = RUN.findall(text, a, b)
            if any(text.find(m, a, b) >= 0 for m in MARKS):
                found = [x for t in found for x in (t if t[0] in ".=" and not t.strip(".=") else (t,))]
            out.append(np.fromiter(map(self.__getitem__, found), np.int32, len(found)))
        for t in self.long:  # long ones aren't remembered
            self.pop(t, None)
        self.long.clear()
        return out

    def unsure(self, numbers: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of tokens of several texts, each with four numbers 0 before and two numbers 1 after: where O isn't sure, and the weights there.

        whole: for each of them a row of `shared`, of its text.
        """
        places, weights = [np.zeros(0, np.int64)], [np.zeros((0, 3))]
        n = self.n
        for s in range(4, len(numbers) - 2, SLICE):
            e = min(s + SLICE, len(numbers) - 2)
            own = numbers[s:e]
            b = self.brief[numbers[s - 4 : e + 2]]
            b4, b3, b2, b1, _, n1, n2 = (b[k : k + e - s] for k in range(7))
            shape = self.shape[own]
            kind, two = self.kind[shape], b2 * n + b1
            w = self.own[shape] + self.before[b3 * (n * n) + two] + self.fourth[b4] + self.after[n1 * n + n2] + self.kind_before[kind * (n * n) + two] + self.shared[whole[s:e] * len(KIND) + kind]
            at = np.flatnonzero((own > 1) & (w[:, 2:] - w[:, :2] <= self.lead).any(1))
            places.append(at + s)
            weights.append(w[at])
        return np.concatenate(places), np.concatenate(weights)

    def spans(self, texts: list[str]) -> list[list[tuple[int, int]]]:
        """The spans that the field finds in each whole text."""
        if self.used + len(self.shapes) > REMEMBERED:
            self.forget()
        cut = [self.numbers(t) for t in texts]
        parts, row, begins, at = [], [], [], 0
        for text, own in zip(texts, cut, strict=True):
            marks, long = text_features(text)
            parts += [np.zeros(4, np.int32), *own, np.ones(2, np.int32)]
            row.append((2 * int(marks[-1]) + (long == "long=True"), sum(map(len, own)) + 6))
            begins.append(at + 4)
            at += row[-1][1]
        if not parts:
            return []
        place, weight = self.unsure(np.concatenate(parts), np.repeat(*np.array(row).T))
        out: list[list[tuple[int, int]]] = [[] for _ in texts]
        runs = [*np.flatnonzero(np.diff(place, prepend=-2) > 1).tolist(), len(place)]
        for s, e in pairwise(runs):
            i = bisect_right(begins, int(place[s])) - 1
            first = int(place[s]) - begins[i]
            closed = first + e - s < row[i][1] - 6
            labels = self.field.viterbi(weight[s:e], closed)
            for k, label in enumerate(labels):
                if label == 0 or label == 1 and (not k or labels[k - 1] == 2):
                    out[i].append((first + k, first + k + 1))
                elif label == 1:
                    out[i][-1] = (out[i][-1][0], first + k + 1)
        return [placed(t, [len(x) for x in own], spans) if spans else [] for t, own, spans in zip(texts, cut, out, strict=True)]


def pieces(text: str) -> Iterator[tuple[int, int]]:
    """Stretches of about PIECE characters, cut at white space, where no token runs on."""
    at = 0
    while at < len(text):
        gap = SPACE.search(text, at + PIECE)
        end = gap.start() if gap else len(text)
        yield at, end
        at = end


def placed(text: str, counts: list[int], spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The places in the text of spans of tokens (in order), of six characters or more; counts: tokens in each piece."""
    out, before, todo = [], 0, 0
    for (a, b), n in zip(pieces(text), counts, strict=True):
        if todo < len(spans) and spans[todo][0] < before + n or out and out[-1][1] is None:
            where = [x for m in RUN.finditer(text, a, b) for x in (((k, k + 1) for k in range(*m.span())) if text[m.start()] in ".=" and not m.group().strip(".=") else (m.span(),))]
            if out and out[-1][1] is None:  # begun in a piece before
                last = spans[todo - 1][1] - 1 - before
                out[-1] = (out[-1][0], where[last][1] if last < n else None)
            while todo < len(spans) and spans[todo][0] < before + n:
                s, e = spans[todo]
                out.append((where[s - before][0], where[e - 1 - before][1] if e <= before + n else None))
                todo += 1
        before += n
    return [(s, e) for s, e in out if e - s >= 6]


def _line(r: random.Random) -> tuple[str, list[tuple[int, int]]]:
    """A made-up line and the places of its secrets."""
    word = lambda: "".join(r.choice(("an", "er", "th", "on", "re", "la", "que", "ie", "st", "ou", "de", "mi", "ka", "ver", "ß", "é")) for _ in range(r.randint(1, 4)))
    prose = lambda n: " ".join(w.capitalize() if r.random() < 0.1 else w for w in (word() + r.choice(("", "", "", ",", ".")) for _ in range(r.randint(1, n))))
    chars = lambda alphabet, n: "".join(r.choice(alphabet) for _ in range(n))
    hexes, mixed = "0123456789abcdef", string.ascii_letters + string.digits
    value = lambda: r.choice((chars(hexes, r.choice((24, 32, 40, 64))), chars(mixed, r.randint(10, 40)), chars(mixed + "+/", r.randint(24, 44)) + "=", chars(mixed + "-_", r.randint(16, 48))))
    name = r.choice(("password", "passwd", "DB_PASSWORD", "secret", "client_secret", "token", "access_token", "api_key", "apiKey", "api-key", "auth_token", "pwd", "credentials", "private_key"))
    quote = r.choice(('"', "'", ""))
    made = value()
    secret = r.choice(
        (
            (f"{name} = {quote}", made, quote), (f"{name}: {quote}", made, quote), (f'"{name}": "', made, '",'), (f"export {name.upper()}=", made, ""),
            ("Authorization: Bearer ", "eyJ" + chars(mixed, 30), ""), ("Authorization: Basic ", chars(mixed, 24) + "==", ""), (f"{name} is ", made, ""),
            ("postgres://user:", chars(mixed, 14), "@db.host:5432/x"), ("git token ", "ghp_" + chars(mixed, 36), ""), ("key ", "AKIA" + chars(string.ascii_uppercase + string.digits, 16), ""),
            ("slack ", "xoxb-" + chars(string.digits, 11) + "-" + chars(mixed, 24), ""), ("stripe ", "sk_live_" + chars(mixed, 24), ""), ("use sk-", chars(mixed, 32), " now"),
        )
    )
    harmless = r.choice(
        (
            lambda: f"commit {chars(hexes, 40)}", lambda: f"sha256 {chars(hexes, 64)}", lambda: f"checksum: {chars(hexes, 32)}", lambda: f"id {chars(hexes, 8)}-{chars(hexes, 4)}-{chars(hexes, 4)}-{chars(hexes, 12)}",
            lambda: "the secret of " + prose(4), lambda: "a token of " + prose(3), lambda: f"{name}: required", lambda: f"{name} = get_{word()}()", lambda: "password must have " + prose(4),
            lambda: chars(string.digits, r.choice((6, 10, 16))), lambda: f"{r.randint(1, 250)}.{r.randint(0, 250)}.{r.randint(0, 250)}.{r.randint(1, 250)}", lambda: f"+1 ({chars(string.digits, 3)}) 555-{chars(string.digits, 4)}",
            lambda: f"{word()}.{r.randint(1, 99)}@mail{r.randint(1, 9)}.example.com", lambda: f"version {r.randint(0, 9)}.{r.randint(0, 20)}.{r.randint(0, 9)}", lambda: "CC BY-NC 4.0", lambda: f"https://{word()}.example.com/{word()}/{r.randint(1, 9999)}",
            lambda: f"ISO-{r.randint(1000, 9999)}-{word()}{r.randint(1, 20)}", lambda: f"{word()}### {word()}$$$ {word()}%%%", lambda: f"| {word()} | {word()} | {r.randint(1, 99)} |", lambda: f"{word()}{r.randint(10, 9999)}", lambda: prose(12),
        )
    )
    head = prose(8) + " " if r.random() < 0.8 else ""
    tail = " " + prose(8) if r.random() < 0.8 else ""
    if r.random() < 0.45:
        a, v, b = secret
        return head + a + v + b + tail, [(len(head + a), len(head + a + v))]
    return head + harmless() + tail, []


@cache
def trained(lines: int = TRAINING, rounds: int = ROUNDS, seed: int = SEED) -> Field:
    """The field whose likelihood on the made-up lines is greatest (Adam on the whole set, weights held small)."""
    r = random.Random(seed)
    rows, labels, lengths = [], [], []
    for _ in range(lines):
        text, secrets = _line(r)
        found = list(TOKEN.finditer(text))
        filler = r.choice((("marks=0", "long=True"), ("marks=0", "long=False"), ("marks=1", "long=False"), text_features(text)))
        rows += features([m.group() for m in found], filler)
        lengths.append(len(found))
        inside = False
        for m in found:
            hit = any(s < m.end() and m.start() < e for s, e in secrets)
            labels.append(2 if not hit else 1 if inside else 0)
            inside = hit
    seen = Counter(f for row in rows for f in row)
    number = {f: i for i, f in enumerate(sorted(f for f, n in seen.items() if n > 2))}
    token, feature = (np.array(x) for x in zip(*((i, number[f]) for i, row in enumerate(rows) for f in row if f in number), strict=True))
    n, width = len(lengths), max(lengths)
    at = np.concatenate([i * width + np.arange(k) for i, k in enumerate(lengths)])
    gold = np.array(labels)
    mask = np.zeros(n * width, bool)
    mask[at] = True
    mask = mask.reshape(n, width)
    full = np.full(n * width, 2)
    full[at] = gold
    full = full.reshape(n, width)
    prior = np.concatenate([np.full((n, 1), 2), full[:, :-1]], axis=1)
    weights, moves = np.zeros((len(number), 3)), np.zeros((3, 3))
    state = [np.zeros_like(x) for x in (weights, weights, moves, moves)]
    for step in range(1, rounds + 1):
        emit = np.stack([np.bincount(token, weights[feature, k], len(rows)) for k in range(3)], axis=1)
        e = np.zeros((n * width, 3))
        e[at] = emit
        e = e.reshape(n, width, 3)
        forward, backward = np.zeros_like(e), np.zeros_like(e)
        forward[:, 0] = e[:, 0] + moves[2]
        for t in range(1, width):
            forward[:, t] = np.where(mask[:, t, None], np.logaddexp.reduce(forward[:, t - 1, :, None] + moves, axis=1) + e[:, t], forward[:, t - 1])
        for t in range(width - 2, -1, -1):
            backward[:, t] = np.where(mask[:, t + 1, None], np.logaddexp.reduce(moves + (e[:, t + 1] + backward[:, t + 1])[:, None, :], axis=2), backward[:, t + 1])
        total = np.logaddexp.reduce(forward[:, -1], axis=1)
        p = np.exp(forward + backward - total[:, None, None]).reshape(-1, 3)[at]
        p[np.arange(len(gold)), gold] -= 1
        grad = np.stack([np.bincount(feature, p[token, k], len(number)) for k in range(3)], axis=1) + 0.5 * weights
        pair = np.exp(forward[:, :-1, :, None] + moves + (e[:, 1:] + backward[:, 1:])[:, :, None, :] - total[:, None, None, None])
        moved = (pair * mask[:, 1:, None, None]).sum((0, 1))
        moved[2] += np.exp(forward[:, 0] + backward[:, 0] - total[:, None]).sum(0)
        np.subtract.at(moved, (prior[mask], full[mask]), 1)
        moved += 0.5 * moves
        for x, g, m, v in ((weights, grad, state[0], state[1]), (moves, moved, state[2], state[3])):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Field({f: weights[i] for f, i in number.items()}, moves)


# ---- scanning ------------------------------------------------------------------------------------------------


def base_spans(text: str, low: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) by start, then kind."""
    out = [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if any(w in low for w in ASSIGN_WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return sorted(out)


def scan(text: str, field: Field) -> tuple[list[int], str, str]:
    """(counts of the base kinds, base spans as text, all spans as text)."""
    return next(scans([text], tables(field)))


_tables: list[Tables] = []


def tables(field: Field) -> Tables:
    """The field's tables, which a worker keeps for its next task."""
    if not _tables or _tables[0].field is not field:
        _tables[:] = [Tables(field)]
    return _tables[0]


def scans(texts: list[str], known: Tables) -> Iterator[tuple[list[int], str, str]]:
    """scan of each text, about PIECE characters of them at a time."""
    write = lambda spans: ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)
    at = 0
    while at < len(texts):
        end, size = at + 1, len(texts[at])
        while end < len(texts) and size + len(texts[end]) <= PIECE:
            size, end = size + len(texts[end]), end + 1
        for text, found in zip(texts[at:end], known.spans(texts[at:end]), strict=True):
            base, more = base_spans(text, text.lower()), []
            starts, reach = [x for x, _, _ in base], list(accumulate((y for _, _, y in base), max))
            for a, b in found:
                before = bisect_left(starts, b)  # base spans that begin before this one's end
                if not before or reach[before - 1] <= a:
                    more.append((a, 3, b))
            yield [sum(k == i for _, k, _ in base) for i in range(3)], write(base), write(sorted(base + more))
        at = end


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_spans, spans of each row's whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alone("secrets", _tables.clear)
        known = tables(shared.value)
        for batch in batches:
            got = list(scans([t or "" for t in batch.column(1).to_pylist()], known))
            columns = [batch.column(0), *(pa.array([g[0][k] for g in got], pa.int64()) for k in range(3))]
            columns += [pa.array([g[1] for g in got], pa.string()), pa.array([hashlib.sha256(g[1].encode()).hexdigest() for g in got], pa.string()), pa.array([g[2] for g in got], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_assign", "n_access", "n_hex", "base_spans", "base_sha256", "spans"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_spans string, base_sha256 string, spans string")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents")).drop("base_spans")
