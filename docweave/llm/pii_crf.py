"""Personal data in texts: exact patterns, and a linear-chain CRF over word shapes for what no pattern fixes."""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm.common import arrow_rows, whole_row

KINDS = ("email", "ip", "card", "phone")
#: Kinds the CRF knows; "secret" is a credential (key, password, token).
TAGS = ("O", *(f"{p}-{k}" for k in (*KINDS, "secret") for p in "BI"))
#: Rows that the labelled table may have.
MAX_SENTENCES = 5000
#: Distinct words that a worker remembers.
MEMO = 400_000
#: Or so many bytes of them.
MEMO_BYTES = 1 << 25
#: How much better than "no personal data here" a span must be, in log score, on average over its words.
MARGIN = 2.0

# ---------------------------------------------------------------- patterns

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# the left-hand condition keeps long runs of digits linear; a match always begins where a run does
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT_CHARS = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost, non-overlapping: from each sign back over the local part, never before the last match."""
    done, at = 0, text.find("@")
    while at >= 0:
        a = at
        while a > done and text[a - 1] in _LOCAL_CHARS:
            a -= 1
        m = _DOMAIN.match(text, at + 1) if a < at else None
        if m:
            yield a, m.end()
            done = m.end()
        else:  # what is before this sign can begin no match
            done = at + 1
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of each kind by its pattern; matches that fail the check of their kind are dropped without another try."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    found["email"] = list(emails(text)) if "@" in text else []
    if "." in text:
        found["ip"] = [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _DIGIT_CHARS.sub("", m[0])) <= 19 and luhn(d):
            found["card"].append(m.span())
    if "+" in text:
        found["phone"] = [m.span() for m in _PHONE.finditer(text) if 8 <= len(_DIGIT_CHARS.sub("", m[0])) <= 15]
    return found


# ---------------------------------------------------------------- labelled table

_SYLLABLES = ("an", "er", "th", "ing", "on", "tion", "le", "de", "que", "mente", "ado", "sch", "ein", "ung", "keit", "re", "la", "ou", "mar", "vo")


def labelled_sentences(n: int = 600, seed: int = 5) -> list[tuple[list[str], list[str]]]:
    """The small labelled table: invented sentences with mentions in many forms, and look-alikes that are none."""
    r = random.Random(seed)
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4)))
    hexa = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))
    upper = lambda k: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(k))

    mixed = lambda k: "".join(r.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz23456789") for _ in range(k))

    def email():
        name = r.choice((word(), f"{word()}.{word()}", f"{word()}{digits(2)}", f"{word()}_{word()}", f"{word()}.{digits(2)}", f"{word().capitalize()}-{word().capitalize()}", word().capitalize()))
        host = r.choice((f"{word()}.com", f"mail{digits(1)}.{word()}.org", f"{word()}.co.uk", f"{word()}-{word()}.net", f"{word()}{digits(2)}.io"))
        return r.choice(([f"{name}@{host}"], [f"{name}@{host}"], [f"<{name}@{host}>"], [f"{name}[at]{host}"], [f"{name}(at){host}"], [f"mailto:{name}@{host}"]))

    def phone():
        return r.choice((
            [f"+{digits(1)}", f"({digits(3)})", f"{digits(3)}-{digits(4)}"], [f"({digits(3)})", f"{digits(3)}-{digits(4)}"], [f"{digits(3)}-{digits(3)}-{digits(4)}"],
            [f"+{digits(2)}", digits(2), digits(4), digits(4)], [f"+{digits(11)}"], [f"{digits(3)}.{digits(3)}.{digits(4)}"], [f"0{digits(1)}", digits(2), digits(2), digits(2), digits(2)],
        ))

    def card():
        return r.choice(([digits(16)], [digits(4) for _ in range(4)], ["-".join(digits(4) for _ in range(4))], [digits(4), digits(6), digits(5)]))

    def ip():
        return [r.choice((".".join(str(r.randint(0, 255)) for _ in range(4)), ":".join(hexa(4) for _ in range(8))))]

    def secret():
        return r.choice((
            [f"AKIA{upper(16)}"], [f"password={hexa(18)}"], [f"token={hexa(32)}"], [f'"{hexa(40)}"'], [f"sk_live_{hexa(24)}"], [hexa(40)], [f"passwd:{word()}{digits(4)}"],
            [f"pat_{mixed(30)}"], [f"{word()}_key={mixed(24)}"], [f"pwd={mixed(14)}"], [hexa(56)],
        ))

    def none():
        return r.choice((
            [digits(4)], [f"{digits(1)}.{digits(1)}"], ["version", f"{digits(1)}.{digits(1)}."], [f"{digits(2)}/{digits(2)}/{digits(4)}"], [f"{digits(4)}-{digits(2)}-{digits(2)}"], [f"{digits(2)}:{digits(2)}"],
            [f"${digits(3)}.{digits(2)}"], [f"{digits(2)}%"], [f"({digits(4)})"], [f"[{digits(2)}]"], [f"{digits(1)},{digits(3)},{digits(3)}"], ["Version", f"{digits(1)}.{digits(1)},"], [digits(3)], [f"{word()}-{word()}"],
            [f"{word()}{digits(1)}"], ["|"], [f"{word()}!!"], [f"{word().upper()}!!"], [f"{word()}***"], [f"{word()}%%%"], [f"{word()}$$$"], [f"{word()}&&&"], [f"{word()}###"], [f"#{digits(3)}"], [f"@{word()}"], [f"{digits(1)}", f"{digits(2)}"],
            [word().capitalize() + word().capitalize()], [f"{word()}={digits(2)}"], [f"{word()}_{word()}"], ["GPL-3.0"], ["BY-NC", f"{digits(1)}.0."], [digits(5)], [f"{digits(3)}-{digits(1)}"], [f"{digits(2)}-{digits(2)}"], [f"{word()}.{word()}"], ["https://" + word() + ".com/" + word()], [digits(10)], [digits(8)],
        ))

    makers = {"email": email, "phone": phone, "card": card, "ip": ip, "secret": secret}
    table = []
    for _ in range(n):
        words, tags = [], []

        def put(parts, kind=None):
            words.extend(parts)
            tags.extend(["O"] * len(parts) if kind is None else [f"{'B' if k == 0 else 'I'}-{kind}" for k in range(len(parts))])

        for _ in range(r.randint(2, 5)):
            for _ in range(r.randint(1, 6)):
                w = word()
                put([r.choice((w, w, w, w.capitalize(), w + ",", w + ".", w.upper(), "é" + w, w + "ü", w + "ó"))])
            if r.random() < 0.45:
                kind = r.choice(list(makers))
                if kind == "secret" and r.random() < 0.4:
                    put(["token", "="])
                parts = makers[kind]()
                if r.random() < 0.2:
                    parts = [*parts[:-1], parts[-1] + r.choice(".,;")]
                put(parts, kind)
            elif r.random() < 0.6:
                put(none())
        table.append((words, tags))
    return table


def labelled_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(labelled_sentences(), "words array<string>, tags array<string>")


# ---------------------------------------------------------------- features

_RUN = re.compile(r"(a+|A+|0+)")
# every code point becomes one byte: letters a or A, digits 0, what is not ASCII counts as a letter, other signs stay
_TO_SHAPE = bytes(
    97 if 97 <= c <= 122 or c >= 192 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c for c in range(256)
)
_CONTINUED = bytes(range(128, 192))
_OUTER = ".,;:!?\"'()[]<>"


def shape(text: str) -> bytes:
    """The text's shape, as long as the text; words of it are between ASCII white space."""
    return text.encode().translate(_TO_SHAPE, _CONTINUED)


def word_features(word: bytes) -> tuple[list[str], str]:
    """Features of a word's shape, and the class that its neighbours see."""
    s = word.decode("ascii", "replace")
    core = s.strip(_OUTER)
    short = _RUN.sub(lambda m: m[0][0], s)[:24]
    sized = _RUN.sub(lambda m: m[0][0] + str(min(len(m[0]), 20)), s)[:60]
    n_digit, n_lower, n_upper = s.count("0"), s.count("a"), s.count("A")
    mixed = n_digit > 0 and n_lower + n_upper > 0
    own = [
        "shape=" + short, f"digits={min(n_digit, 20)}", f"dots={min(core.count('.'), 5)}", f"at={'@' in s or '[aa]' in s or '(aa)' in s}",
        f"len={min(len(word), 45) // 5}", f"mixed={mixed}", f"equals={'=' in s}", f"plus={s[:1] == '+'}",
        f"key={0 if len(core) < 16 or not mixed or n_digit + n_lower + n_upper < len(core) else 1 if not n_lower else 2 if not n_upper else 3}",
    ]
    if n_digit:
        own.append("sized=" + sized)
    plain = n_lower + n_upper == len(core)
    seen = "word" if plain else "sized=" + sized if n_digit and len(sized) < 14 else "shape=" + short
    return own, seen


@dataclass
class Crf:
    """Weights of features (own, of the left neighbour's class, of the right one's) by tag, transitions and ends."""

    own: dict[str, np.ndarray]
    left: dict[str, np.ndarray]
    right: dict[str, np.ndarray]
    step: np.ndarray
    first: np.ndarray
    last: np.ndarray


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis=axis))


def train(sentences: list[tuple[list[str], list[str]]], rounds: int = 60, rate: float = 0.4, decay: float = 2e-4) -> Crf:
    """Maximum likelihood by AdaGrad over all sentences at once; forward and backward sums run over padded arrays."""
    tag = {t: k for k, t in enumerate(TAGS)}
    ids: dict[tuple[str, str], int] = {}
    row, col = [], []
    length = np.array([len(w) for w, _ in sentences])
    n, width, k = len(sentences), int(length.max()), len(TAGS)
    gold = np.zeros((n, width), np.int64)
    for i, (words, tags) in enumerate(sentences):
        parts = [word_features(shape(w)) for w in words]
        for j, (own, _) in enumerate(parts):
            names = [("own", f) for f in own]
            names.append(("left", parts[j - 1][1] if j else "^"))
            names.append(("right", parts[j + 1][1] if j + 1 < len(parts) else "$"))
            for f in names:
                row.append(i * width + j)
                col.append(ids.setdefault(f, len(ids)))
            gold[i, j] = tag[tags[j]]
    row, col = np.array(row), np.array(col)
    inside = np.arange(width)[None, :] < length[:, None]
    size = len(ids) * k + k * k + 2 * k
    w, seen = np.zeros(size), np.full(size, 1e-8)
    hot = np.zeros((n, width, k))
    hot[np.arange(n)[:, None], np.arange(width)[None, :], gold] = 1.0
    hot *= inside[:, :, None]
    flat = len(ids) * k
    truth = np.zeros(size)
    truth_steps = np.zeros((k, k))
    both = inside[:, 1:]
    np.add.at(truth_steps, (gold[:, :-1][both], gold[:, 1:][both]), 1.0)
    order = np.argsort(col, kind="stable")
    starts = np.searchsorted(col[order], np.arange(len(ids)))

    def expected(p: np.ndarray) -> np.ndarray:
        return np.add.reduceat(p.reshape(-1, k)[row[order]], starts, axis=0).ravel()

    truth[:flat] = expected(hot)
    truth[flat : flat + k * k] = truth_steps.ravel()
    truth[flat + k * k : flat + k * k + k] = hot[:, 0].sum(axis=0)
    truth[-k:] = hot[np.arange(n), length - 1].sum(axis=0)
    by_row = np.argsort(row, kind="stable")
    row_starts = np.searchsorted(row[by_row], np.flatnonzero(inside.ravel()))
    for _ in range(rounds):
        e = np.zeros((n * width, k))
        e[np.flatnonzero(inside.ravel())] = np.add.reduceat(w[:flat].reshape(-1, k)[col[by_row]], row_starts, axis=0)
        e = e.reshape(n, width, k)
        step, first, last = w[flat : flat + k * k].reshape(k, k), w[flat + k * k : flat + k * k + k], w[-k:]
        a, b = np.zeros((width, n, k)), np.zeros((width, n, k))
        a[0] = first + e[:, 0]
        for j in range(1, width):
            a[j] = np.where(inside[:, j, None], _logsumexp(a[j - 1][:, :, None] + step[None], 1) + e[:, j], a[j - 1])
        z = _logsumexp(a[-1] + last, 1)
        b[-1] = last
        for j in range(width - 2, -1, -1):
            b[j] = np.where(inside[:, j + 1, None], _logsumexp(step[None] + (e[:, j + 1] + b[j + 1])[:, None, :], 2), last)
        p = np.exp(a + b - z[None, :, None]).transpose(1, 0, 2) * inside[:, :, None]
        pairs = np.zeros((k, k))
        for j in range(1, width):
            m = inside[:, j]
            pairs += np.exp(a[j - 1][m][:, :, None] + step[None] + (e[m, j] + b[j][m])[:, None, :] - z[m][:, None, None]).sum(axis=0)
        g = np.concatenate((expected(p), pairs.ravel(), p[:, 0].sum(axis=0), p[np.arange(n), length - 1].sum(axis=0))) - truth
        g = g / n + decay * w
        seen += g * g
        w -= rate * g / np.sqrt(seen)
    table = w[:flat].reshape(-1, k)
    part = {s: {f: table[i].astype(np.float32) for (t, f), i in ids.items() if t == s} for s in ("own", "left", "right")}
    return Crf(part["own"], part["left"], part["right"], w[flat : flat + k * k].reshape(k, k).astype(np.float32), w[flat + k * k : flat + k * k + k].astype(np.float32), w[-k:].astype(np.float32))


class Scorer:
    """Emission scores of words, by class of equal features; a word's class is computed once and remembered."""

    def __init__(self, crf: Crf):
        self.crf, self.k = crf, len(TAGS)
        self.classes: dict[tuple, int] = {}
        self.own: list[np.ndarray] = []
        self.left: list[np.ndarray] = []
        self.right: list[np.ndarray] = []
        zero = np.zeros(self.k, np.float32)
        self.zero = zero
        self.edge = self._new(("^",), zero, crf.left.get("^", zero), crf.right.get("$", zero))
        self.memo: dict[bytes, int] = {}
        self.held = 0
        # how much a neighbour can gain from any tag instead of O: an O that leads by more is O on every best path
        s = crf.step
        ends_a = np.vstack((s, crf.first))
        ends_b = np.column_stack((s, crf.last))
        self.lead = float((ends_a[:, 1:] - ends_a[:, :1]).max() + (ends_b[1:] - ends_b[:1]).max())

    def _new(self, key: tuple, own, left, right) -> int:
        self.classes[key] = c = len(self.own)
        self.own.append(own)
        self.left.append(left)
        self.right.append(right)
        return c

    def class_of(self, word: bytes) -> int:
        names, seen = word_features(word)
        key = (*sorted(names), seen)
        c = self.classes.get(key)
        if c is None:
            own = sum((self.crf.own[f] for f in names if f in self.crf.own), self.zero)
            c = self._new(key, own, self.crf.left.get(seen, self.zero), self.crf.right.get(seen, self.zero))
        self.held += len(word)
        if len(self.memo) >= MEMO or self.held >= MEMO_BYTES:
            self.memo.clear()
            self.held = len(word)
        self.memo[word] = c
        return c

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.stack(self.own), np.stack(self.left), np.stack(self.right)

    def tag(self, texts: list[list[bytes]]) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """Viterbi over all texts at once: (text, first word, tags, lead over O) of each stretch that is not all O.

        Exact: only words whose O leads by more than any transition can repay are fixed beforehand; the stretches
        between them are decoded together, as arrays sorted by length.
        """
        memo, class_of, edge = self.memo, self.class_of, self.edge
        ids = [edge]
        bounds = [1]
        for words in texts:
            try:  # mostly all words are known
                ids += [memo[w] for w in words]
            except KeyError:
                ids += [class_of(w) if (c := memo.get(w)) is None else c for w in words]
            ids.append(edge)
            bounds.append(len(ids))
        c = np.array(ids, np.int64)
        own, left, right = self.tables()
        if len(self.classes) > 200_000:  # should junk have made very many, begin again after this batch
            self.__init__(self.crf)
        mid = slice(1, len(c) - 1)
        open_ = np.full(len(c), False)
        # O against each other tag, a tag at a time: three gathers of numbers each
        base = own[c[mid], 0] + left[c[:-2], 0] + right[c[2:], 0]
        rival = np.full(len(c) - 2, -np.inf, np.float32)
        for k in range(1, self.k):
            np.maximum(rival, own[c[mid], k] + left[c[:-2], k] + right[c[2:], k], out=rival)
        open_[mid] = base - rival <= self.lead
        open_[c == edge] = False
        at = np.flatnonzero(open_)
        if not len(at):
            return []
        cut = np.flatnonzero(np.diff(at) > 1) + 1
        start, size = at[np.concatenate(([0], cut))], np.diff(np.concatenate(([0], cut, [len(at)])))
        order = np.argsort(-size, kind="stable")
        start, size = start[order], size[order]
        crf, step = self.crf, self.crf.step
        emit = lambda p: own[c[p]] + left[c[p - 1]] + right[c[p + 1]]
        score = np.where((c[start - 1] == edge)[:, None], crf.first[None], step[0][None]) + emit(start)
        # the way that stays at O, to compare with
        stay = score[:, 0].copy()
        back = np.zeros((int(size[0]), len(start), self.k), np.int8)
        final = score.copy()
        for j in range(1, int(size[0])):
            n = int(np.searchsorted(-size, -j - 1, side="right"))
            e = emit(start[:n] + j)
            paths = final[:n, :, None] + step[None]
            back[j, :n] = paths.argmax(axis=1)
            final[:n] = paths.max(axis=1) + e
            stay[:n] += step[0, 0] + e[:, 0]
        end = start + size
        close = np.where((c[end] == edge)[:, None], crf.last[None], step[:, 0][None])
        best = (final + close).argmax(axis=1)
        tags = np.zeros((len(start), int(size[0])), np.int8)
        now = best.astype(np.int64)
        lead = (final + close)[np.arange(len(start)), best] - (stay + close[:, 0])
        for j in range(int(size[0]) - 1, -1, -1):
            live = size > j
            tags[live, j] = now[live]
            now[live] = back[j][live, now[live]] if j else now[live]
        found = np.flatnonzero((tags > 0).any(axis=1))
        text = np.searchsorted(bounds, start[found], side="right") - 1
        begin = np.array(bounds)[text]
        return [(int(t), int(start[f] - b), tags[f, : size[f]], lead[f]) for f, t, b in zip(found, text, begin, strict=True)]


_WORD = re.compile(rb"\S+")
_TRIM_A, _TRIM_B = "\"'<([", "\"'>)],.;:!?"


def _byte(digits: str) -> bool:
    """Whether digits, of any number, are at most 255."""
    bare = digits.lstrip("0")
    return len(bare) <= 3 and int(bare or "0") <= 255


def plausible(kind: str, found: str) -> bool:
    """What a mention of the kind has in any form; shapes alone do not tell a card from another long number."""
    digits = _DIGIT_CHARS.sub("", found)
    if kind == "email":
        low = found.lower()
        return "@" in low or "[at]" in low or "(at)" in low
    if kind == "phone":
        return 7 <= len(digits) <= 15
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    if kind == "ip":
        return found.count(":") >= 2 or bool(digits) and found.count(".") == 3 and bool(_IP.fullmatch(found)) and all(_byte(p) for p in found.split("."))
    return len(found) >= 8 and bool(digits)


def crf_spans(texts: list[str], scorer: Scorer) -> list[list[tuple[str, int, int]]]:
    """(kind, start, end) that the CRF finds in each text; outer quotes, brackets and stops are not part of a span."""
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    places: dict[int, list[tuple[int, int]]] = {}
    shapes = [shape(x) for x in texts]
    for t, first, tags, lead in scorer.tag([x.split() for x in shapes]):
        if lead < MARGIN * int((tags > 0).sum()):
            continue
        text = texts[t]
        if t not in places:
            places[t] = [m.span() for m in _WORD.finditer(shapes[t])]
        j = 0
        while j < len(tags):
            if not tags[j]:
                j += 1
                continue
            kind, e = TAGS[tags[j]][2:], j + 1
            while e < len(tags) and tags[e] and TAGS[tags[e]] == f"I-{kind}":
                e += 1
            a, b = places[t][first + j][0], places[t][first + e - 1][1]
            while a < b and text[a] in _TRIM_A and not (text[a] == "(" and kind == "phone"):
                a += 1
            while b > a and text[b - 1] in _TRIM_B:
                b -= 1
            if b > a and plausible(kind, text[a:b]):
                out[t].append((kind, a, b))
            j = e
    return out


def find_pii(texts: list[str], scorer: Scorer) -> list[tuple[dict[str, list[tuple[int, int]]], list[tuple[str, int, int]]]]:
    """Base spans of each text, and what the CRF adds: its spans that touch no base span of any kind."""
    out = []
    for text, more in zip(texts, crf_spans(texts, scorer), strict=True):
        base = base_spans(text)
        taken = sorted(s for spans in base.values() for s in spans)
        out.append((base, [s for s in more if all(s[2] <= a or s[1] >= b for a, b in taken)]))
    return out


def _line(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def op1(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Spans of personal data in each whole text, in code points, end exclusive.

    n_email, n_ip, n_card and n_phone count base spans, base_sha256 is of these; spans lists all, kind by kind (those
    of the base first, then other kinds by name) and by start. n_added counts what the model adds, n_secret the secrets
    among it, n_found all spans. A null or empty text has none. Repeated rows are searched each, with equal results.
    """
    return pii(docs.select("doc_id", "text"), labelled_table(spark)).select(
        "doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added", "n_secret", "n_found"
    )


def pii(docs: DataFrame, labelled: DataFrame, text: str = "text") -> DataFrame:
    """docs with the columns of :func:`op1`. labelled: words array<string>, tags array<string>, MAX_SENTENCES rows at most.

    Texts of any length are searched whole, in memory of that text's words. An empty table gives an empty result. Of
    docs' own columns, those named like a new one give way to it; all others pass through.
    """
    rows = labelled.limit(MAX_SENTENCES + 1).collect()
    if len(rows) > MAX_SENTENCES:
        raise ValueError(f"the labelled table has more than {MAX_SENTENCES} rows")
    model = train([(list(r["words"]), list(r["tags"])) for r in rows if r["words"]])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # as large as the labelled table has features
    arrow_rows(docs.sparkSession)
    names = ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added", "n_secret", "n_found")

    @F.pandas_udf("n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_secret long, n_found long")
    def find(column: pd.Series) -> pd.DataFrame:
        global _scorer
        if _scorer is None or _scorer[0] is not shared.value:
            _scorer = (shared.value, Scorer(shared.value))
        out = []
        rank = {k: n for n, k in enumerate((*KINDS, *sorted(t[2:] for t in TAGS if t[:2] == "B-" and t[2:] not in KINDS)))}
        for base, more in find_pii(column.tolist(), _scorer[1]):
            own = [(k, a, b) for k in KINDS for a, b in base[k]]
            every = sorted([*own, *more], key=lambda s: (rank[s[0]], s[1], s[2]))
            out.append((*(len(base[k]) for k in KINDS), hashlib.sha256(_line(own).encode()).hexdigest(), _line(every), len(more), sum(s[0] == "secret" for s in more), len(every)))
        return pd.DataFrame(out, columns=list(names))

    found = docs.select(whole_row(docs.drop(*names)), find(F.coalesce(F.col(text), F.lit(""))).alias("__new"))
    return found.select("__row.*", "__new.*")


_scorer: tuple | None = None
