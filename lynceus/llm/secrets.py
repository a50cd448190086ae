"""Secrets in texts: three fixed patterns, and spans found by a linear-chain conditional random field.

The field tags every token of a text as begin (B), inside (I) or outside (O) of a secret from its shape, the words before
it and features of the whole text, and is decoded by Viterbi. The best path can leave O only where a bound on what that
may gain, taken from the scores of all tokens, is positive; Viterbi runs there, which gives the best path of the text.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in the order in which spans that start together are listed; "field" is the random field's own.
KINDS = ("assign", "access", "hex", "field")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Chunks without white space that may hold a secret: eight characters of a key's alphabet with a digit among them.
DIGIT = re.compile(r"[0-9]")
CHUNK_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-.")
HINT_WORDS = ("passw", "passphrase", "secret", "token", "key", "credential", "bearer", "auth", "pwd")
HINTS = re.compile("|".join(HINT_WORDS), re.I | re.A)
SPACE = re.compile(r"\s")
B, I, O = 0, 1, 2
FEATURES = ("bias", "digit", "upper", "lower", "digit_lower", "all_hex", "all_digits", "upper_digit", "mixed_case", "len4",
            "len8", "len16", "len32", "entropy", "changes", "punctuation", "separator", "quote", "assigned", "hint_near",
            "quoted", "at_sign", "dotted", "glued", "after_secretlike", "text_digits", "text_assignments", "text_code")


#: Features that are numbers: of the token, of the whole text (with the bias). The others are bits, in this order.
OF_TOKEN = [FEATURES.index(f) for f in ("entropy", "changes")]
OF_TEXT = [FEATURES.index(f) for f in ("bias", "text_digits", "text_assignments", "text_code")]
BITS = [i for i in range(len(FEATURES)) if i not in OF_TOKEN + OF_TEXT]
HALF = len(BITS) // 2
#: Features reach this far to the left and right of a token; texts are read in blocks of about BLOCK characters, those
#: below TOGETHER characters several at a time, with blanks between that no feature reaches across.
REACH = 40
BLOCK = 1 << 20
TOGETHER = 1 << 15
APART = "\n" * (REACH + 1)
#: Tokens of a piece of training text.
PIECE = 128
BLANK, DIGITS, UPPERS, LOWERS, HEXES, SEPARATORS, QUOTES, ASSIGNS, DOTS, ATS, SIGNS = (1 << i for i in range(11))
#: Characters of two kinds are counted in one number, the second above this bit, which no text is long enough to reach.
SECOND = 31


def _character_classes() -> np.ndarray:
    """What each character is; the last place stands for all behind the last white space."""
    classes = np.zeros(0x3002, dtype=np.uint16)
    kinds = {DIGITS: "0123456789", HEXES: "0123456789abcdef", SEPARATORS: "+/_.-=", QUOTES: "\"'`", ASSIGNS: "=:", DOTS: ".", ATS: "@",
             UPPERS: "ABCDEFGHIJKLMNOPQRSTUVWXYZ", LOWERS: "abcdefghijklmnopqrstuvwxyz"}
    for kind, chars in kinds.items():
        classes[[ord(c) for c in chars]] |= kind
    for i in range(128):
        classes[i] |= BLANK if chr(i).isspace() else 0 if chr(i).isalnum() else SIGNS
    classes[[i for i in range(128, 0x3001) if chr(i).isspace()]] = BLANK
    return classes


def _pair(first: int, second: int) -> np.ndarray:
    """Per set of classes, what a character of it adds to the count of two kinds."""
    of = np.arange(1 << 11)
    return (of & first != 0) + ((of & second != 0).astype(np.int64) << SECOND)


CLASSES = _character_classes()
CAPITALS, SMALL, MARKS = _pair(DIGITS, UPPERS), _pair(HEXES, LOWERS), _pair(ASSIGNS, ATS)


@dataclass(frozen=True)
class Field:
    """Weights of the features per tag, and of a tag after a tag (row: before; last row: the start)."""

    emit: np.ndarray
    move: np.ndarray

    @cached_property
    def halves(self) -> tuple[np.ndarray, np.ndarray]:
        """Scores of every setting of the first and of the other bits."""
        low, high = self.emit[BITS[:HALF]], self.emit[BITS[HALF:]]
        return _settings(np.arange(1 << len(low)), len(low)) @ low, _settings(np.arange(1 << len(high)), len(high)) @ high

    @cached_property
    def over(self) -> tuple[np.ndarray, np.ndarray, float, float]:
        """What B and I bring at most over O: by the tag before them, and beyond it where a run of them begins and ends."""
        move = self.move[:3]
        reached = move[:, :O].max(0)
        return (reached - move[O, O], self.move[3, :O] - self.move[3, O], float((move[O, :O] - reached).max()),
                max(0.0, float((move[:O, O] - move[O, O]).max())))

    @cached_property
    def gains(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For B and I: what the first bits, the other bits, the numbers and the text bring over O, as ``over`` counts it."""
        low, high = self.halves
        gain = self.emit - self.emit[:, O:]
        return [(low[:, k] - low[:, O] + self.over[0][k], high[:, k] - high[:, O], gain[OF_TOKEN, k], gain[OF_TEXT, k])
                for k in (B, I)]


def _settings(bits: np.ndarray, n: int) -> np.ndarray:
    return (bits[:, None] >> np.arange(n) & 1).astype(float)


@dataclass
class Tokens:
    """Tokens of a text in order: start, end, their bits (BITS) and numbers (OF_TOKEN, a row each); ``whole``: OF_TEXT.

    Sums of scores are taken in one order, so a token's scores do not depend on what is scored beside it.
    """

    start: np.ndarray
    end: np.ndarray
    bits: np.ndarray
    numbers: np.ndarray
    whole: np.ndarray

    def features(self) -> np.ndarray:
        """A row per token, columns as in FEATURES."""
        x = np.zeros((len(self.start), len(FEATURES)))
        x[:, BITS], x[:, OF_TOKEN], x[:, OF_TEXT] = _settings(self.bits, len(BITS)), self.numbers, self.whole
        return x

    def scores(self, model: Field) -> np.ndarray:
        """A row per token with the score of each tag."""
        low, high = model.halves
        return (low[self.bits & (1 << HALF) - 1] + high[self.bits >> HALF]
                + sum(self.numbers[:, i:i + 1] * model.emit[k] for i, k in enumerate(OF_TOKEN))
                + sum(self.whole[i] * model.emit[k] for i, k in enumerate(OF_TEXT)))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the three patterns: leftmost, not overlapping within a kind, matches that fail a length dropped."""
    found = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return found


def listed(spans: list[tuple[str, int, int]]) -> str:
    """kind:start:end by start, then kind as listed, comma-joined."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))


def stretches(text: str) -> list[tuple[int, int]]:
    """Ranges of the text that may hold a secret, each with the two chunks before it."""
    found, done = [], 0
    n = len(text)

    def back(at: int, chunks: int) -> int:
        for _ in range(chunks):
            while at > 0 and text[at - 1].isspace():
                at -= 1
            while at > 0 and not text[at - 1].isspace():
                at -= 1
        return at

    def ahead(at: int) -> int:
        while at < n and not text[at].isspace():
            at += 1
        return at

    m = DIGIT.search(text)
    while m:
        a, b = m.start(), m.end()
        while a > done and text[a - 1] in CHUNK_CHARS:
            a -= 1
        while b < n and text[b] in CHUNK_CHARS:
            b += 1
        if b - a >= 8:
            found.append((back(a, 3), ahead(b)))
        done = b
        m = DIGIT.search(text, b)
    low = text.lower()
    if any(w in low for w in HINT_WORDS):
        for m in HINTS.finditer(text):
            end = m.end()
            after = re.compile(r"""\w*["']?\s{0,2}[:=]\s{0,2}\S{6,}""").match(text, end)
            if after:
                found.append((back(m.start(), 1), after.end()))
    merged: list[list[int]] = []
    for a, b in sorted(found):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    return [(a, b) for a, b in merged]


def text_features(text: str) -> tuple[float, float, float]:
    """Features of the whole text: shares of digits, of "=" and ":" and of brackets, on a log scale."""
    n = max(1, len(text))
    raw = text.encode("utf-8", "surrogatepass")
    share = lambda chars: math.log1p(1000 * (len(raw) - len(raw.translate(None, chars))) / n) / 7
    return share(b"0123456789"), share(b"=:"), share(b"{}[]();")


def _counts(pair: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Per place, how many characters of the two kinds stand before it."""
    total = np.zeros(len(kind) + 1, dtype=np.int64)
    np.cumsum(pair[kind], out=total[1:])
    return total


def _both(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return count & (1 << SECOND) - 1, count >> SECOND


def _block_tokens(text: str, a: int, b: int, since: int, firsts: np.ndarray | None = None) -> tuple[Tokens, int]:
    """Tokens that start in a block of the text, which ends before white space; tokens since the last hint word, at most 9.

    ``firsts``: where texts begin that are joined in the block, APART lying between.
    """
    left = max(0, a - REACH)
    part = text[left:b + REACH]
    if part.isascii():
        points = np.frombuffer(part.encode("ascii"), dtype=np.uint8)
        kind = CLASSES[points]
    else:
        points = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        kind = CLASSES[np.minimum(points, len(CLASSES) - 1)]
    kind = np.append(kind, np.uint16(BLANK))  # before the first character and behind the last one
    word = kind & (DIGITS | UPPERS | LOWERS) != 0
    sign = ~word & (kind & BLANK == 0)
    begin, stop = sign.copy(), sign.copy()
    begin[1:] |= word[1:] & ~word[:-1]
    begin[0] |= word[0]
    stop[:-1] |= word[:-1] & ~word[1:]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    inside = slice(*np.searchsorted(start, [a - left, b - left]))
    glued = np.append(False, start[1:] == end[:-1])[inside]
    start, end = start[inside], end[inside]
    n, size = len(start), end - start
    capitals, small, marks = (_counts(pair, kind) for pair in (CAPITALS, SMALL, MARKS))
    digits, upper = _both(capitals[end] - capitals[start])
    hexes, lower = _both(small[end] - small[start])
    assigned = _both(marks[start] - marks[np.maximum(start - 4, 0)])[0]
    ats = _both(marks[np.minimum(end + REACH, len(kind))] - marks[np.maximum(start - REACH, 0)])[1]
    here, before, after = kind[start], kind[start - 1], kind[end]
    place = np.arange(n)
    hint = np.zeros(n, dtype=bool)
    low = part.lower()
    if any(w in low for w in HINT_WORDS):
        hint[np.searchsorted(start, [m.start() - left for m in HINTS.finditer(text, a, b)], "right") - 1] = True
    last_hint = np.maximum.accumulate(np.where(hint, place, -since))
    if firsts is not None:  # a hint ends with its text
        firsts = np.searchsorted(start, firsts)
        own = np.repeat(firsts, np.diff(firsts, append=n))
        last_hint = np.where(last_hint >= own, last_hint, own - 9)
    some = digits > 0
    secretlike = (size >= 8) & some
    like = (np.maximum.accumulate(np.where(secretlike, place, -1)) >= np.maximum.accumulate(np.where(glued, -1, place))) & (
        np.maximum.accumulate(secretlike))
    several = some & (lower > 0)
    flags = (some, upper > 0, lower > 0, several, hexes == size, digits == size, some & (upper > 0) & (lower == 0),
             several & (upper > 0), size >= 4, size >= 8, size >= 16, size >= 32, here & SIGNS != 0, here & SEPARATORS != 0,
             here & QUOTES != 0, assigned > 0, (place - last_hint <= 5) & ~hint, before & QUOTES != 0, ats > 0,
             (before | after) & DOTS != 0, glued, np.append(False, like[:-1]) & glued)
    bits = np.zeros(n, dtype=np.int32)
    for i, flag in enumerate(flags):
        bits |= flag.astype(np.int32) << i
    numbers = np.zeros((n, 2))
    longer = np.flatnonzero(size >= 8)
    if len(longer):  # the characters of shorter tokens say little
        of = np.repeat(np.arange(len(longer)), size[longer])
        where = np.arange(len(of)) + np.repeat(start[longer] - np.append(0, np.cumsum(size[longer])[:-1]), size[longer])
        pairs, counts = np.unique(of * 128 + points[where], return_counts=True)
        share = counts / size[longer][pairs // 128]
        numbers[longer, 0] = -np.bincount(pairs // 128, share * np.log2(share), len(longer)) / 4
    mixed = np.flatnonzero(some & (digits < size))  # only there digits and others take turns
    if len(mixed):
        is_digit = kind & DIGITS != 0
        turns = np.append(0, np.cumsum(np.append(False, is_digit[1:] != is_digit[:-1]), dtype=np.int32))
        numbers[mixed, 1] = (turns[end[mixed]] - turns[start[mixed] + 1]) / size[mixed]
    since = min(9, int(n - last_hint[-1])) if n else since
    return Tokens(start + left, end + left, bits, numbers, np.zeros(0)), since


def tokens_of(text: str, block: int = BLOCK) -> Tokens:
    """All tokens of a text: runs of ASCII letters and digits, other characters one by one, white space left out."""
    whole = np.array([1.0, *text_features(text)])
    parts, a, since = [], 0, 9
    while a < len(text) or not parts:
        space = SPACE.search(text, a + block) if a + block < len(text) else None
        b = space.start() if space else len(text)
        found, since = _block_tokens(text, a, b, since)
        parts.append(found)
        a = b
        if space is None:
            break
    join = lambda name: np.concatenate([getattr(p, name) for p in parts])
    return Tokens(join("start"), join("end"), join("bits"), join("numbers"), whole)


def _viterbi(scores: np.ndarray, start: np.ndarray, move: np.ndarray, end: np.ndarray) -> np.ndarray:
    score = scores[0] + start
    back = np.zeros((len(scores), 3), dtype=int)
    for i in range(1, len(scores)):
        ways = score[:, None] + move
        back[i] = ways.argmax(0)
        score = ways.max(0) + scores[i]
    tags = np.zeros(len(scores), dtype=int)
    tags[-1] = int((score + end).argmax())
    for i in range(len(scores) - 1, 0, -1):
        tags[i - 1] = back[i, tags[i]]
    return tags


def decode(x: np.ndarray, model: Field) -> np.ndarray:
    """Viterbi: the best tags of a text with these features."""
    return _viterbi(x @ model.emit, model.move[3], model.move[:3], np.zeros(3)) if len(x) else np.zeros(0, dtype=int)


def best_tags(scores: np.ndarray, model: Field) -> np.ndarray:
    """The same best tags from the scores of all tokens, by Viterbi where the path may leave O.

    What a run of tags other than O gains over O is at most the sum of its tokens' ``most``, ``enter`` and ``leave``; a
    token of no run with a positive bound is O.
    """
    n, move = len(scores), model.move[:3]
    tags = np.full(n, O)
    if not n:
        return tags
    after, first, enter, leave = model.over
    gain = scores[:, :O] - scores[:, O:]
    most = (gain + after).max(1)
    most[0] = max(most[0], float((gain[0] + first).max()) - enter)
    total = np.append(0, np.cumsum(most))
    best = np.maximum.accumulate(total[:0:-1])[::-1] - np.minimum.accumulate(total[:-1])
    edges = np.flatnonzero(np.diff(np.concatenate([[False], best + enter + leave > -1e-6, [False]])))
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
        tags[a:b] = _viterbi(scores[a:b], model.move[3 if a == 0 else O], move, move[:, O] if b < n else np.zeros(3))
    return tags


def _spans(tokens: Tokens, model: Field, shortest: int) -> list[tuple[str, int, int]]:
    tags = best_tags(tokens.scores(model), model)
    held = np.flatnonzero(tags != O)
    if not len(held):
        return []
    first = (tags[held] == B) | (np.diff(held, prepend=-2) > 1)
    last = np.append(first[1:], True)
    spans = zip(tokens.start[held[first]].tolist(), tokens.end[held[last]].tolist())
    return [("field", s, e) for s, e in spans if e - s >= shortest]


def field_spans(text: str, model: Field | None, shortest: int = 8) -> list[tuple[str, int, int]]:
    """The field's spans of ``shortest`` characters or more, all tokens of the text being tagged."""
    if model is None or not text:
        return []
    return _spans(tokens_of(text), model, shortest)


def _joined_spans(texts: list[str], model: Field, shortest: int) -> list[list[tuple[str, int, int]]]:
    """``field_spans`` of short texts, their tokens scored together: where the sum of what a text's tokens may gain (the
    most that one may, if none gains) cannot pay for leaving O, all its tokens are O; the others are decoded one by one."""
    begins = np.cumsum([0, *(len(x) + len(APART) for x in texts[:-1])])
    tokens, _ = _block_tokens(APART.join(texts), 0, int(begins[-1]) + len(texts[-1]), 9, begins)
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    if not len(tokens.start):
        return out
    edges = np.append(np.searchsorted(tokens.start, begins), len(tokens.start))
    filled = np.flatnonzero(np.diff(edges))
    edges = edges[np.append(filled, len(texts))]
    whole = np.array([[1.0, *text_features(texts[i])] for i in filled])
    low, high = tokens.bits & (1 << HALF) - 1, tokens.bits >> HALF
    _, first, enter, leave = model.over
    gain = [by_low[low] + by_high[high] + tokens.numbers @ of_token + np.repeat(whole @ of_text, np.diff(edges))
            for by_low, by_high, of_token, of_text in model.gains]
    most, at = np.maximum(*gain), edges[:-1]
    begin = [g[at] - model.over[0][k] + first[k] - enter for k, g in enumerate(gain)]
    most[at] = np.maximum(most[at], np.maximum(*begin))
    total = np.add.reduceat(np.maximum(most, 0), at)
    bound = np.where(total > 0, total, np.maximum.reduceat(most, at)) + enter + leave
    for k in np.flatnonzero(bound > -1e-5).tolist():
        a, b = edges[k], edges[k + 1]
        i = int(filled[k])
        one = Tokens(tokens.start[a:b] - begins[i], tokens.end[a:b] - begins[i], tokens.bits[a:b], tokens.numbers[a:b], whole[k])
        out[i] = _spans(one, model, shortest)
    return out


def spans_of_all(texts: list[str], model: Field | None, shortest: int = 8) -> list[list[tuple[str, int, int]]]:
    """``field_spans`` of each text; short ones, in ASCII or not, are read about TOGETHER characters at a time."""
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    if model is None:
        return out
    for plain in (True, False):
        joined, size = [], 0
        some = [i for i, x in enumerate(texts) if x and x.isascii() == plain]
        for i in some:
            if len(texts[i]) >= TOGETHER:
                out[i] = field_spans(texts[i], model, shortest)
            else:
                joined.append(i)
                size += len(texts[i])
            if joined and (size >= TOGETHER or i == some[-1]):
                for j, spans in zip(joined, _joined_spans([texts[j] for j in joined], model, shortest)):
                    out[j] = spans
                joined, size = [], 0
    return out


def _expected(e: np.ndarray, real: np.ndarray, start: np.ndarray, end: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chances of each token's tag, and the expected number of each tag after each tag, by forward and backward sums.

    ``e``: scores of pieces, tokens and tags; ``start``, ``end``: scores of the first and last tag of a piece.
    """
    most = real.shape[1]
    # Pieces stand side by side in the last axis, which is the long one; ``real`` is None where all tokens are.
    e, real = np.ascontiguousarray(e.transpose(1, 2, 0)), None if real.all() else real.T[:, None]
    e = np.exp(e - e.max(1, keepdims=True))
    if real is not None:
        e = np.where(real, e, 1.0)
    a = np.exp(move - move.max())
    f = np.empty_like(e)
    f[0] = np.exp(start - start.max(1, keepdims=True)).T * e[0]
    f[0] /= f[0].sum(0)
    for t in range(1, most):
        step = a.T @ f[t - 1] * e[t]
        step /= step.sum(0)
        f[t] = step if real is None else np.where(real[t], step, f[t - 1])
    g = np.exp(end - end.max(1, keepdims=True)).T
    both = np.zeros((3, 3))
    for t in range(most - 1, 0, -1):
        ahead = e[t] * g
        f[t] *= g
        back = a @ ahead
        weight = 1 / (f[t - 1] * back).sum(0)
        if real is not None:
            weight = np.where(real[t, 0], weight, 0.0)
        both += f[t - 1] * weight @ ahead.T
        back /= back.sum(0)
        g = back if real is None else np.where(real[t], back, g)
    f[0] *= g
    f /= f.sum(1, keepdims=True)
    return f.transpose(2, 0, 1), both * a


def _tagged(text: str) -> tuple[Tokens, np.ndarray]:
    """Tokens of a text and the tags that the fixed patterns give them: a value is B, then I."""
    marks = [(m.start(2), m.end(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    marks += [(s, e) for k, s, e in base_spans(text) if k != "assign"]
    tokens = tokens_of(text)
    y = np.full(len(tokens.start), O)
    for s, e in sorted(set(marks)):
        a, b = np.searchsorted(tokens.start, s), np.searchsorted(tokens.end, e, "right")
        if a < b:
            y[a:b] = I
            y[a] = B
    return tokens, y


def learn(texts: list[str], rounds: int = 120, rate: float = 0.3, ridge: float = 1.0) -> Field | None:
    """Maximum likelihood by AdaGrad on whole texts whose tags come from the fixed patterns; None without any secret.

    A pattern's value (group 2 of an assignment, else the match) is tagged B then I. Texts are learned from in pieces of
    PIECE tokens, given the tags beside a piece, so that all pieces are summed over side by side.
    """
    held = [(t, y) for t, y in map(_tagged, texts) if len(y)]
    if not any((y == B).any() for _, y in held):
        return None
    sizes = np.array([len(y) for _, y in held])
    y = np.concatenate([y for _, y in held])
    codes, code = np.unique(np.concatenate([t.bits for t, _ in held]), return_inverse=True)
    numbers = np.concatenate([t.numbers for t, _ in held]).T.astype(np.float32).astype(float)
    whole, text = np.array([t.whole for t, _ in held]), np.repeat(np.arange(len(held)), sizes)
    settings = _settings(codes, len(BITS))
    del held
    # Pieces: the place of their first token, their length, and the tags before and behind (3: the text's start or end).
    begins = np.cumsum(sizes) - sizes
    first = np.concatenate([np.arange(b, b + n, PIECE) for b, n in zip(begins, sizes)])
    last = np.minimum(first + PIECE, (begins + sizes)[text[first]])
    ahead = np.where(np.isin(first, begins), 3, y[first - 1])
    behind = np.where(last == (begins + sizes)[text[first]], 3, np.append(y, O)[last])
    by_size = np.argsort(last - first, kind="stable")
    groups = []  # of pieces: which, a column of tokens for each (the last one again below its end), which of them there are
    for i in range(0, len(by_size), 2048):
        group = by_size[i:i + 2048]
        n = last[group] - first[group]
        step = np.arange(n.max())[:, None]
        groups.append((group, first[group] + np.minimum(step, n - 1), (step < n).T))
    emit, move = np.zeros((len(FEATURES), 3)), np.zeros((4, 3))
    ge, gm = np.full(emit.shape, 1e-6), np.full(move.shape, 1e-6)
    gold = np.zeros((4, 3))
    inner = np.ones(len(y), dtype=bool)
    inner[begins] = False
    np.add.at(gold, (np.where(inner, np.roll(y, 1), 3), y), 1)
    border = first[inner[first]]  # known from both pieces beside it
    np.add.at(gold, (y[border - 1], y[border]), 1)
    for _ in range(rounds):
        de, dm = np.zeros(emit.shape), -gold
        by_code, by_text = settings @ emit[BITS], whole @ emit[OF_TEXT]
        off = np.empty((3, len(y)))
        scores = [by_code[:, k].take(code) + np.repeat(by_text[:, k], sizes) + emit[OF_TOKEN, k] @ numbers for k in range(3)]
        for group, at, real in groups:
            n = last[group] - first[group]
            e = np.empty((len(at), 3, len(group)))
            for k in range(3):
                e[:, k] = scores[k].take(at)
            end = np.append(move[:3].T, np.zeros((1, 3)), 0)[behind[group]]
            p, both = _expected(e.transpose(2, 0, 1), real, move[ahead[group]], end, move[:3])
            for k in range(3):  # what stands again below the end of a piece has equal chances
                off[k][at] = p[..., k].T
            dm[:3] += both
            np.add.at(dm, ahead[group], p[:, 0])
            inside = behind[group] < 3
            np.add.at(dm[:3].T, behind[group][inside], p[np.arange(len(n)), n - 1][inside])
        off[y, np.arange(len(y))] -= 1
        for k in range(3):
            de[BITS, k] = np.bincount(code, off[k], len(codes)) @ settings
            de[OF_TEXT, k] = np.add.reduceat(off[k], begins) @ whole
        de[OF_TOKEN] = numbers @ off.T
        de += ridge * emit
        dm += ridge * move
        ge += de * de
        gm += dm * dm
        emit -= rate * de / np.sqrt(ge)
        move -= rate * dm / np.sqrt(gm)
    return Field(emit, move)


def _least(rows: DataFrame, wanted: Column, n: int, total: int) -> list[int]:
    """The ``n`` least values of h, a hash, among the wanted ones of the ``total`` rows.

    Hashes are spread evenly, so a small share of them holds the least ones; it grows until n of them are found or it is
    everything. What is wanted is only worked out for rows below that share.
    """
    share = min(1.0, 32 * n / max(1, total))
    while True:
        below = rows if share >= 1 else rows.where(F.col("h") <= int(share * 2**64) - 2**63)
        found = [r[0] for r in below.where(wanted).select("h").orderBy("h").limit(n).collect()]
        if len(found) == n or share >= 1:
            return found
        share = min(1.0, share * 1.3 * n / max(len(found), n / 16))


def fit(docs: DataFrame, text: str = "text", key: str = "doc_id", max_docs: int = 1000, max_chars: int = 20_000) -> Field | None:
    """The field of a bounded sample: ``max_docs`` texts with one of the patterns' words and as many others with digits.

    Texts of the smallest key hashes among those of at most ``max_chars`` characters are taken.
    """
    # The lower case is an element of an array, so that it is worked out once, not for each of the words.
    named = F.exists(F.array(F.lower("text")), lambda low: reduce(or_, (F.contains(low, F.lit(w)) for w in ASSIGN_WORDS)))
    marked = F.contains(F.col("text"), F.lit("AKIA")) | named
    every = docs.select(F.col(text).alias("text"), F.xxhash64(key).alias("h"))
    total, short = every.count(), F.length("text") <= max_chars
    texts = []
    for wanted in (marked, ~marked & F.rlike("text", F.lit("[0-9]{4}"))):
        least = _least(every, short & wanted, max_docs, total)
        if least:
            rows = every.where(F.col("h") <= least[-1]).where(short & wanted)
            texts += sorted(r[0] for r in rows.select("text").limit(2 * max_docs).collect())
    return learn(texts)


def secrets(text: Column, model: Field | None) -> Column:
    """Array of (kind, start, end) in code points, by start. The field's spans inside a pattern's span are left out.

    Null and empty texts have no spans. Rows are read whole and by themselves, so repeated rows give equal spans.
    """

    @F.pandas_udf("array<struct<kind:string,start:int,end:int>>")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = []
            whole = [x or "" for x in texts]
            for x, found in zip(whole, spans_of_all(whole, model)):
                base = base_spans(x)
                more = [s for s in found if not any(a <= s[1] and s[2] <= b for _, a, b in base)]
                spans = sorted(base + more, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
                out.append([{"kind": k, "start": a, "end": b} for k, a, b in spans])
            yield pd.Series(out)

    return scan(text)


def op2(docs: DataFrame) -> DataFrame:
    """The contract's columns, one row per row of ``docs``."""
    spans = F.col("spans")
    text = lambda kept: F.array_join(F.transform(kept, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter(spans, lambda s: s["kind"] != "field")
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    return (docs.select("doc_id", secrets(F.col("text"), fit(docs)).alias("spans"))
            .select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"),
                    count("hex").alias("n_hex"), F.sha2(text(base).cast("binary"), 256).alias("base_sha256"),
                    text(spans).alias("spans")))
