"""Personal data: base patterns, and a character-level bidirectional LSTM with CRF transitions.

The tagger is trained in numpy from labelled spans: texts are made by a seeded generator of invented people's mail
addresses, phone, card and network numbers in many written forms, among them forms that no base pattern describes
(spelled-out addresses, numbers without a country code, extensions, longer network addresses), between numbers that are
nobody's. Forward and backward LSTMs over characters feed a linear layer; a CRF over the tags (outside, and begin and inside of each kind) is trained by its likelihood, so decoding is the
Viterbi path.

Texts are tagged in windows that overlap by half. Model spans are added only where they don't overlap base spans and can be of
their kind (``plausible``: an at-sign and a dotted name, digits enough, a valid check digit or address); one that can't is taken for another
kind if it can be that. Each such span holds a
digit, an at-sign, an at in brackets or the word at before a dotted name; windows without any of these, and without a
neighbour that has one, would give no span and are left out. Every character takes its emission scores from the window in which
it lies farthest from an edge, and one global Viterbi pass over each joined stretch decides, so overlaps never disagree.

Edge cases: null or empty text has no spans; very long texts are tagged whole, in windows; repeated rows are tagged alike;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import ipaddress
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import storage

KINDS = ("email", "ip", "card", "phone")

# --- base patterns ---------------------------------------------------------------------------------------------------
#: The base patterns. Possessive repeats and look-behinds only keep long runs from being tried again.

_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str):
    """Leftmost matches: the longest run of local characters before an at-sign that a domain follows."""
    free = at = 0
    while (at := text.find("@", at)) >= 0:
        m = _DOMAIN.match(text, at)
        start = at
        if m:
            while start > free and text[start - 1] in _LOCAL:
                start -= 1
        if m and start < at:
            yield start, m.end()
            free = at = m.end()
        else:
            at += 1


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind), ordered by start, then kind as listed."""
    out = [(a, z, "email") for a, z in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                out.append((*m.span(), "ip"))
        for m in _CARD.finditer(text):
            digits = re.sub("[ -]", "", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((*m.span(), "card"))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_DIGIT.findall(m[0])) <= 15:
                    out.append((*m.span(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


# --- labelled spans --------------------------------------------------------------------------------------------------

_SYLLABLES = ("an", "be", "cor", "da", "el", "fin", "go", "hu", "in", "ka", "lo", "mer", "no", "ou", "pa", "ri", "sel", "ti", "un", "ver", "wo", "yl", "é", "ö", "ñ")
_TOPS = ("com", "org", "net", "edu", "example", "io")


def _word(rng: random.Random) -> str:
    return "".join(rng.choice(_SYLLABLES) for _ in range(rng.randint(1, 3)))


def _ascii(rng: random.Random) -> str:
    return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 8)))


def _digits(rng: random.Random, n: int) -> str:
    return "".join(rng.choice("0123456789") for _ in range(n))


_BRACKETS = ("[]", "()", "{}", "<>")


def _spelled(rng: random.Random, word: str) -> str:
    """A sign as people hide it: in words, in brackets, with or without spaces."""
    word, space = rng.choice((word, word, word.upper())), rng.choice(("", " "))
    if rng.random() < 0.55:
        return f" {word} "
    pair = rng.choice(_BRACKETS)
    return f"{space}{pair[0]}{word}{pair[1]}{space}"


def _name(rng: random.Random) -> str:
    return rng.choice((_ascii(rng), _ascii(rng), _ascii(rng).capitalize(), f"{_ascii(rng)}{rng.choice('._-')}{_ascii(rng)}", f"{_ascii(rng).capitalize()}.{_ascii(rng).capitalize()}", f"{rng.choice('abcdefghij')}.{_ascii(rng)}"))


def _with_check_digit(body: str) -> str:
    return next(body + c for c in "0123456789" if luhn(body + c))


def invent(rng: random.Random, kind: str) -> str:
    """One written form of an invented value."""
    if kind == "email":
        plain = rng.random() < 0.35
        at, dot = (rng.choice(("@", "@", " @ ")), ".") if plain else (_spelled(rng, "at"), rng.choice((".", _spelled(rng, "dot"))))
        labels = [_ascii(rng) for _ in range(rng.choice((1, 1, 2)))] + [rng.choice(_TOPS)]
        return f"{_name(rng)}{_digits(rng, rng.choice((0, 0, 1, 3)))}{at}{dot.join(labels)}"
    if kind == "ip":
        if rng.random() < 0.6:
            return ".".join(str(rng.randint(0, 255)) for _ in range(4))
        parts = [f"{rng.getrandbits(rng.choice((4, 12, 16, 16))):x}" for _ in range(8)]
        parts[0] = rng.choice((parts[0], "fe80", "fd" + parts[1][:2], "2001", "2a0" + parts[1][:1]))
        if rng.random() < 0.6:
            k = rng.randint(1, 5)
            parts[k : k + rng.randint(2, 8 - k)] = [""]
        whole = ":".join(parts)
        return rng.choice((whole, whole, whole.upper())) + (":" if whole.endswith(":") else "")
    if kind == "card":
        sep = rng.choice(("", " ", "-", ".", "/"))
        if rng.random() < 0.3:
            whole = _with_check_digit("3" + _digits(rng, 13))
            return sep.join((whole[:4], whole[4:10], whole[10:]))
        whole = _with_check_digit(rng.choice("456") + _digits(rng, 14))
        return sep.join(whole[k : k + 4] for k in range(0, 16, 4))
    sep, roll = rng.choice((" ", "-", ".", "/")), rng.random()
    if roll < 0.3:
        out = f"{rng.choice(('+', '00'))}{rng.randint(1, 99)}{sep}{_digits(rng, rng.randint(2, 3))}{sep}{_digits(rng, 3)}{sep}{_digits(rng, rng.randint(3, 4))}"
    elif roll < 0.55:
        out = f"({_digits(rng, 3)}){rng.choice(('', ' '))}{_digits(rng, 3)}{sep}{_digits(rng, 4)}"
    elif roll < 0.85:
        out = f"{_digits(rng, 3)}{sep}{_digits(rng, 3)}{sep}{_digits(rng, 4)}"
    else:
        out = f"0{_digits(rng, rng.randint(2, 4))}{sep}{_digits(rng, rng.randint(3, 4))}{sep}{_digits(rng, 4)}"
    return out + (f"{rng.choice((' ext ', ' ext. ', ' x', ', ext '))}{_digits(rng, rng.randint(1, 4))}" if rng.random() < 0.2 else "")


def _other_number(rng: random.Random) -> str:
    """Numbers that are nobody's: dates, times, amounts, versions, sizes, and at-words in prose."""
    d = lambda n: _digits(rng, n)
    return rng.choice((
        d(rng.randint(1, 6)), f"{d(1)}.{d(2)}", f"{d(4)}-{d(2)}", f"20{d(2)}-0{rng.randint(1, 9)}-1{d(1)}", f"1{d(1)}:{d(2)}", f"{d(2)}/{d(2)}/20{d(2)}", f"${d(2)},{d(3)}.{d(2)}", f"v{d(1)}.{d(1)}.{d(2)}", f"{d(3)}-{d(3)}",
        f"{d(2)} %", f"No. {d(5)}", f"{_word(rng)} at {_word(rng)}", f"at {d(1)}.{d(2)}", f"{_word(rng)} at {_word(rng)}. {_word(rng).capitalize()}", f"dot {_word(rng)}",
    ))


def labelled(rng: random.Random, length: int) -> tuple[str, list[tuple[int, int, str]]]:
    """A text of about length characters with its spans; other numbers stand in it as well."""
    text, spans = "", []
    while len(text) < length:
        roll = rng.random()
        if roll < 0.14:
            kind = rng.choice(("email", "email", "email", "ip", "card", "card", "phone", "phone"))
            value, (before, behind) = invent(rng, kind), rng.choice((("", ""), ("", ""), ("", ""), ("(", ")"), ('"', '"'), (":", ""), ("<", ">"), ("=", ";")))
            text += before
            spans.append((len(text), len(text) + len(value), kind))
            text += value + behind
        elif roll < 0.26:
            text += _other_number(rng)
        else:
            word = _word(rng) if rng.random() < 0.6 else _ascii(rng)
            text += word.capitalize() if rng.random() < 0.15 else word
        text += rng.choice((" ", " ", " ", " ", ", ", ". ", ".\n"))
    return text, spans


# --- model -----------------------------------------------------------------------------------------------------------

TAGS = 1 + 2 * len(KINDS)
#: Every ASCII character is itself; beyond it are letters, and anything else.
N_CLASSES = 130


def classes_of(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    far = np.flatnonzero(points > 127)
    if len(far):
        points[far] = [128 if text[k].isalpha() else 129 for k in far.tolist()]
    return points


def allowed() -> np.ndarray:
    """Transitions that tags permit: inside follows begin or inside of its kind."""
    ok = np.ones((TAGS, TAGS), bool)
    for k in range(len(KINDS)):
        inside = 2 + 2 * k
        ok[:, inside] = False
        ok[[inside - 1, inside], inside] = True
    return ok


def _lstm(x: np.ndarray, p: dict, keep: bool = False):
    """x: time, batch of classes. Hidden states, and what the backward pass needs."""
    steps, width = x.shape
    size = p["U"].shape[0]
    h, c = np.zeros((width, size), np.float32), np.zeros((width, size), np.float32)
    out, held = np.empty((steps, width, size), np.float32), []
    for t in range(steps):
        z = p["W"][x[t]] + h @ p["U"] + p["b"]
        gate = 1.0 / (1.0 + np.exp(-z[:, : 3 * size]))
        i, f, o, g = gate[:, :size], gate[:, size : 2 * size], gate[:, 2 * size :], np.tanh(z[:, 3 * size :])
        before, c = c, f * c + i * g
        tc = np.tanh(c)
        if keep:
            held.append((h, before, i, f, o, g, tc))
        h = o * tc
        out[t] = h
    return out, held


def _lstm_back(x, p, held, grad):
    d = {k: np.zeros_like(v) for k, v in p.items()}
    dh, dc = np.zeros_like(grad[0]), np.zeros_like(grad[0])
    for t in range(len(x) - 1, -1, -1):
        h, before, i, f, o, g, tc = held[t]
        dh = dh + grad[t]
        dc = dc + dh * o * (1 - tc * tc)
        dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
        np.add.at(d["W"], x[t], dz)
        d["U"] += h.T @ dz
        d["b"] += dz.sum(0)
        dh, dc = dz @ p["U"].T, dc * f
    return d


class Tagger:
    """Emission scores of both LSTMs, and CRF transitions."""

    def __init__(self, size: int = 16, seed: int = 7):
        rng = np.random.default_rng(seed)
        make = lambda *s: (rng.standard_normal(s) * 0.3).astype(np.float32)
        self.ahead = {"W": make(N_CLASSES, 4 * size), "U": make(size, 4 * size), "b": np.zeros(4 * size, np.float32)}
        self.back = {"W": make(N_CLASSES, 4 * size), "U": make(size, 4 * size), "b": np.zeros(4 * size, np.float32)}
        self.out = {"V": make(2 * size, TAGS), "c": np.zeros(TAGS, np.float32), "T": np.zeros((TAGS, TAGS), np.float32)}
        self.size, self.ban = size, np.where(allowed(), 0, -1e4).astype(np.float32)

    def emissions(self, x: np.ndarray, keep: bool = False):
        """x: time, batch. Scores: time, batch, tag."""
        a, held_a = _lstm(x, self.ahead, keep)
        b, held_b = _lstm(x[::-1], self.back, keep)
        both = np.concatenate([a, b[::-1]], axis=2)
        return both @ self.out["V"] + self.out["c"], (both, held_a, held_b)

    def step(self, x: np.ndarray, y: np.ndarray):
        """Negative log-likelihood per character, and gradients."""
        steps, width = x.shape
        e, (both, held_a, held_b) = self.emissions(x, keep=True)
        trans = self.out["T"] + self.ban
        lse = lambda v, axis: (m := v.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(v - m).sum(axis))
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[0] = e[0]
        for t in range(1, steps):
            alpha[t] = e[t] + lse(alpha[t - 1][:, :, None] + trans, 1)
        for t in range(steps - 2, -1, -1):
            beta[t] = lse(trans + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        total = lse(alpha[-1], 1)
        lanes = np.arange(width)
        gold = e[np.arange(steps)[:, None], lanes, y].sum(0) + trans[y[:-1], y[1:]].sum(0)
        de = np.exp(alpha + beta - total[:, None])
        de[np.arange(steps)[:, None], lanes, y] -= 1
        dT = np.zeros_like(trans)
        for t in range(1, steps):
            dT += np.exp(alpha[t - 1][:, :, None] + trans + (e[t] + beta[t])[:, None, :] - total[:, None, None]).sum(0)
        np.add.at(dT, (y[:-1].ravel(), y[1:].ravel()), -1)
        scale = 1.0 / (steps * width)
        de *= scale
        d_out = {"V": both.reshape(-1, 2 * self.size).T @ de.reshape(-1, TAGS), "c": de.sum((0, 1)), "T": dT * scale}
        d_both = de @ self.out["V"].T
        d_a = _lstm_back(x, self.ahead, held_a, d_both[:, :, : self.size])
        d_b = _lstm_back(x[::-1], self.back, held_b, d_both[::-1, :, self.size :])
        return float((total - gold).sum() * scale), (d_a, d_b, d_out)

    def decode(self, e: np.ndarray) -> np.ndarray:
        """Best tags for scores (time, tag)."""
        trans = self.out["T"] + self.ban
        score, back = e[0].copy(), np.empty(e.shape, np.int8)
        score[2::2] -= 1e4
        for t in range(1, len(e)):
            both = score[:, None] + trans
            back[t] = both.argmax(0)
            score = both.max(0) + e[t]
        tags = np.empty(len(e), np.int64)
        tags[-1] = score.argmax()
        for t in range(len(e) - 1, 0, -1):
            tags[t - 1] = back[t][tags[t]]
        return tags


def batch_of(rng: random.Random, lanes: int, steps: int) -> tuple[np.ndarray, np.ndarray]:
    x, y = np.empty((steps, lanes), np.int64), np.zeros((steps, lanes), np.int64)
    for k in range(lanes):
        text, spans = labelled(rng, steps)
        x[:, k] = classes_of(text)[:steps]
        for a, z, kind in spans:
            tag = 1 + 2 * KINDS.index(kind)
            y[a:z, k] = tag + 1
            if a < steps:
                y[a, k] = tag
    return x, y


@lru_cache(maxsize=2)
def train(rounds: int = 800, lanes: int = 48, steps: int = 72, size: int = 16, seed: int = 7) -> Tagger:
    """Adam on freshly made batches; the same seed gives the same model."""
    rng, model = random.Random(seed), Tagger(size, seed)
    groups = (model.ahead, model.back, model.out)
    first = [{k: np.zeros_like(v) for k, v in g.items()} for g in groups]
    second = [{k: np.zeros_like(v) for k, v in g.items()} for g in groups]
    for n in range(1, rounds + 1):
        _, grads = model.step(*batch_of(rng, lanes, steps))
        rate = 0.03 * min(1.0, 2.0 * (1 - (n - 1) / rounds))
        for g, d, m, v in zip(groups, grads, first, second, strict=True):
            for k in g:
                m[k] = 0.9 * m[k] + 0.1 * d[k]
                v[k] = 0.99 * v[k] + 0.01 * d[k] ** 2
                g[k] -= (rate * (m[k] / (1 - 0.9**n)) / (np.sqrt(v[k] / (1 - 0.99**n)) + 1e-8)).astype(np.float32)
    return model


# --- texts -----------------------------------------------------------------------------------------------------------

WINDOW = 96
_AT, _DOT = r"[\[({<]\s?at\s?[\])}>]", r"[\[({<]\s?dot\s?[\])}>]"
_DOTTED = rf"(?:(?:\.|\s?{_DOT}\s?|\sdot\s)[\w-]+)"
_EMAIL = re.compile(rf"[\w.+%-]+(?:\s?@\s?|\s?{_AT}\s?|\sat\s)[\w-]+{_DOTTED}+", re.I)
_LINE = re.compile(r"(?:\+|\()?[0-9][0-9(). /-]+[0-9]((?:,\s?|\s?)(?:ext\.?|x)\s?[0-9]{1,5})?", re.I)
#: What every span that passes ``plausible`` holds: a digit, an at-sign, an at in brackets, or the word at before a dotted name.
_TRIGGER = re.compile(rf"[0-9@]|{_AT}|\sat\s[\w-]+{_DOTTED}", re.I)


def stretches(text: str) -> list[tuple[int, int]]:
    """Joined windows, on a grid of half windows, around everything that a span of any kind contains."""
    half, out = WINDOW // 2, []
    for m in _TRIGGER.finditer(text):
        a = max(0, (m.start() // half - 1) * half)
        z = min(len(text), (m.start() // half + 2) * half)
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return [tuple(x) for x in out]


def model_spans(texts: list[str], model: Tagger, lanes: int = 512) -> list[list[tuple[int, int, str]]]:
    """Spans of every text, by one global decoding of each stretch."""
    half, jobs, scores = WINDOW // 2, [], {}
    places = [(k, a, z) for k, text in enumerate(texts) for a, z in stretches(text)]
    codes = {k: classes_of(texts[k]) for k, _, _ in places}
    for n, (k, a, z) in enumerate(places):
        scores[n] = np.zeros((z - a, TAGS), np.float32)
        jobs.extend((n, k, s, a, z) for s in range(a, max(a + 1, z - half), half))
    for b in range(0, len(jobs), lanes):
        part = jobs[b : b + lanes]
        x = np.full((WINDOW, len(part)), 10, np.int64)
        for lane, (_, k, s, _, z) in enumerate(part):
            own = codes[k][s : min(s + WINDOW, z)]
            x[: len(own), lane] = own
        e, _ = model.emissions(x)
        for lane, (n, _, s, a, z) in enumerate(part):
            # The middle half of a window is its own; at the ends of a stretch the outer quarters too.
            lo = s if s == a else s + half // 2
            hi = z if s + half >= z - half else s + half + half // 2
            scores[n][lo - a : hi - a] = e[lo - s : hi - s, lane]
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    for n, (k, a, z) in enumerate(places):
        tags, start = model.decode(scores[n]), None
        for t in range(len(tags) + 1):
            tag = int(tags[t]) if t < len(tags) else 0
            if start is not None and (tag == 0 or tag % 2 or tag != int(tags[start]) + 1):
                out[k].append((a + start, a + t, KINDS[(int(tags[start]) - 1) // 2]))
                start = None
            if tag % 2:
                start = t
    return out


def plausible(value: str, kind: str) -> bool:
    """Whether a value can be of its kind; what the tagger finds besides is dropped."""
    digits = "".join(c for c in value if c in "0123456789")
    if kind == "email":
        return bool(_EMAIL.fullmatch(value))
    if kind == "ip":
        try:
            return bool(digits) and (value.count(".") == 3 or value.count(":") > 1) and bool(ipaddress.ip_address(value))
        except ValueError:
            return False
    if kind == "card":
        return bool(re.fullmatch(r"[0-9][0-9 ./-]+[0-9]", value)) and 14 <= len(digits) <= 19 and luhn(digits)
    line = _LINE.fullmatch(value)
    return bool(line) and 9 <= len(digits) - sum(c.isdigit() for c in line[1] or "") <= 15


def tag_texts(texts: list[str], model: Tagger) -> list[tuple[list, list]]:
    """(base spans, all spans) of every text."""
    out = []
    for text, found in zip(texts, model_spans(texts, model), strict=True):
        base = base_spans(text)
        more = [(a, z, next((k for k in (kind, *KINDS) if plausible(text[a:z], k)), None)) for a, z, kind in found]
        more = [s for s in more if s[2] and not any(s[0] < z and a < s[1] for a, z, _ in base)]
        out.append((base, sorted([*base, *more], key=lambda s: (s[0], KINDS.index(s[2]))) if more else base))
    return out


def written(spans) -> str:
    return ",".join(f"{kind}:{a}:{z}" for a, z, kind in spans)


FIELDS = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def find_personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text", model: Tagger | None = None) -> DataFrame:
    """One row per document: base counts and digest, and all spans as kind:start:end."""
    shared = docs.sparkSession.sparkContext.broadcast(model or train())

    def run(batches):
        for batch in batches:
            got = tag_texts(storage.texts_of(batch, 1), shared.value)
            counts = [storage.longs([sum(s[2] == kind for s in base) for base, _ in got]) for kind in KINDS]
            digest = pa.array([hashlib.sha256(written(base).encode()).hexdigest() for base, _ in got], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, digest, pa.array([written(s) for _, s in got], pa.string())], [x.split()[0] for x in FIELDS.split(", ")])

    return storage.map_batches(storage.text_column(docs, key, text), run, FIELDS)


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text", model: Tagger | None = None) -> DataFrame:
    """doc_id and the text with every span replaced by its kind in angle brackets."""
    shared = docs.sparkSession.sparkContext.broadcast(model or train())

    def clear(value: str, spans) -> str:
        parts, at = [], 0
        for a, z, kind in spans:
            if a >= at:
                parts.extend((value[at:a], f"<{kind}>"))
            at = max(at, z)
        return "".join([*parts, value[at:]])

    def run(batches):
        for batch in batches:
            values = storage.texts_of(batch, 1)
            got = tag_texts(values, shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([clear(v, s) for v, (_, s) in zip(values, got, strict=True)], pa.string())], ["doc_id", "text"])

    return storage.map_batches(storage.text_column(docs, key, text), run, "doc_id long, text string")
