"""Secret scans: fixed patterns, and a linear-chain conditional random field that adds spans.

Patterns (the base): assignments to password-like names, access keys, long hexadecimal runs. They are matched on the
UTF-8 bytes, as they hold ASCII only, and their places are given in code points.

The field: a line's tokens (words, and every other mark by itself) are one chain; each token is outside, at the beginning
of, or inside a secret, which it cannot be inside without a beginning. A token's features are its shape, its word, the
tokens around it, the word before the marks before it, whether blanks part them, and the file's features. The best
labelling of every line is found by the Viterbi algorithm, for many lines side by side. A token that is outside in every
best labelling whatever its neighbours are (its weights show that, see `surely_out`) cuts its chain in two, which changes
no result.

Weights are learned by gradient steps on the likelihood over lines of a bounded sample of texts. The patterns label those
lines; so that neither the name before a secret nor its letters alone decide, each labelled line comes again with another
name, with none, and with secrets of other makes, and lines that hold the names or such makes without a secret come too.

Defined cases: null and empty texts have no spans; texts of any length are scanned whole; repeated rows are scanned row
by row; a table in which the patterns label nothing gives a field that adds nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import bounded_batches, forget_kept, free_name, remove, stretch_hashes, written

# The base patterns and the least lengths of their matches.
ASSIGN = re.compile(rb"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "crf")

_NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_LONG_HEX = re.compile(rb"[0-9a-f]{24,}")
OUT, BEGIN, INSIDE = 0, 1, 2
_NEVER = -1e4


@dataclass(frozen=True)
class Settings:
    #: At most so many texts are learned from, half of them with a match of a pattern: those whose ids hash lowest, of texts
    #: of up to max_training_length code points; of a line, at most `window` tokens; of a text, at most `lines` lines.
    max_training_texts: int = 600
    max_training_length: int = 1 << 16
    window: int = 48
    lines: int = 4
    #: So many times at least, labelled lines are made anew.
    made: int = 150
    buckets: int = 1 << 16
    epochs: int = 6
    batch: int = 48
    rate: float = 0.25
    decay: float = 1e-4
    seed: int = 9
    #: Bytes of text tagged together; a line of more is cut at blanks into several chains.
    together: int = 1 << 19


# ---- patterns -------------------------------------------------------------------------------------------------------


def base_matches(raw: bytes) -> list[tuple[int, int, int, int]]:
    """(start, end, kind, start of the secret itself) in bytes, sorted by start and kind."""
    out = []
    low = raw.lower()
    if any(x in low for x in _NAMES):
        out += [(*m.span(), 0, m.start(2)) for m in ASSIGN.finditer(raw) if len(m[2]) >= LEAST["assign"]]
    if b"AKIA" in raw:
        out += [(*m.span(), 1, m.start()) for m in ACCESS.finditer(raw) if len(m[0]) >= LEAST["access"]]
    out += [(*m.span(), 2, m.start()) for m in _LONG_HEX.finditer(raw)]
    return sorted(out, key=lambda x: (x[0], x[2]))


# ---- tokens and features --------------------------------------------------------------------------------------------

_BLANK, _LINE, _WORD, _MARK = range(4)
_KIND = np.full(256, _MARK, np.uint8)
_KIND[np.frombuffer(b" \t\x0b\x0c\r", np.uint8)] = _BLANK
_KIND[10] = _LINE
_KIND[np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_", np.uint8)] = _WORD
_KIND[128:] = _WORD
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: What letters are: others, digits, capitals, small letters, small letters that are hexadecimal digits.
_CLASS = np.zeros(256, np.uint8)
_CLASS[48:58], _CLASS[65:91], _CLASS[97:123], _CLASS[97:103] = 1, 2, 3, 4
_P = 0x9E3779B97F4A7C15


@dataclass
class Tokens:
    start: np.ndarray
    end: np.ndarray
    #: Whether a token is the first of its chain.
    first: np.ndarray
    #: Whether no blank is before it; a secret holds none, so only such a token can be inside.
    glued: np.ndarray
    #: A column for each feature: rows of the weights' table.
    features: np.ndarray


def file_features(raw: bytes) -> int:
    return (len(raw).bit_length() // 3) * 4 + 2 * (b"AKIA" in raw) + (b"BEGIN" in raw)


def tokenize(texts: list[bytes], files: list[int], s: Settings) -> tuple[Tokens, np.ndarray]:
    """Tokens of texts joined by ends of lines, and where each text begins."""
    whole = b"\n".join(texts) + b"\n"
    codes = np.frombuffer(whole, np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    begins = np.cumsum(sizes) - sizes
    kind = _KIND[codes]
    word, mark = kind == _WORD, kind == _MARK
    start = np.flatnonzero((word & ~np.append(False, word[:-1])) | mark)
    end = np.flatnonzero((word & ~np.append(word[1:], False)) | mark) + 1
    n = len(start)
    if not n:
        return Tokens(start, end, np.empty(0, bool), np.empty(0, bool), np.empty((0, 12), np.int32)), begins
    since = lambda x: np.append(0, np.cumsum(x, dtype=np.int32))
    within = lambda c: c[end] - c[start]
    cls = _CLASS[codes]
    digits, caps, small, hexes = (within(since(x)) for x in (cls == 1, cls == 2, cls >= 3, (cls == 1) | (cls == 4)))
    change = since(np.append(False, (cls[1:] == 1) != (cls[:-1] == 1)))
    changes = change[end] - change[start + 1]
    own = stretch_hashes(_LOWER[codes], start, end)
    line = since(kind == _LINE)[start]
    first = np.append(True, line[1:] != line[:-1])
    length = end - start
    is_word = word[start]
    size = np.minimum(length, 12) + np.where(length > 12, np.minimum(length, 60) // 8, 0)
    coarse = np.where(is_word, 256 + ((size * 3 + np.where(digits == 0, 0, np.where(digits == length, 2, 1))) * 3 + np.where(caps == 0, 0, np.where(caps == length, 2, 1))) * 2 + (small > 0), codes[start])
    coarse = coarse.astype(np.uint64)
    fine = np.minimum(changes, 7) * 64 + np.minimum(10 * digits // length, 9) * 4 + (hexes == length) * 2 + (hexes + caps == length)

    def beside(x, by, none):
        """x of the token `by` places on, within the line."""
        out = np.full(n, none, x.dtype)
        if n > abs(by):
            a, b = (slice(None, by), slice(-by, None)) if by < 0 else (slice(by, None), slice(None, -by))
            same = line[a] == line[b]
            out[b] = np.where(same, x[a], none)
        return out

    none = np.uint64(0)
    glued = np.append(False, start[1:] == end[:-1]).astype(np.uint64)
    glued_next = np.append(glued[1:], none)
    # the last word before, if only a few marks are between
    at = np.where(is_word, np.arange(n), -1)
    at = np.append(-1, np.maximum.accumulate(at)[:-1])
    near = (at >= 0) & (np.arange(n) - at <= 4)
    near &= line[np.maximum(at, 0)] == line
    before = np.where(near, own[np.maximum(at, 0)], none)
    before2 = at[np.maximum(at, 0)]
    before2 = np.where(near & (before2 >= 0) & (line[np.maximum(before2, 0)] == line), own[np.maximum(before2, 0)], none)
    prev, follow = beside(coarse, -1, none), beside(coarse, 1, none)
    file = np.repeat(np.array(files, np.uint64), np.diff(np.append(np.searchsorted(start, begins), n)))
    parts = (
        coarse, own, before, before2 * np.uint64(3) + is_word, prev * np.uint64(4) + glued * np.uint64(2) + is_word, coarse * np.uint64(512) + fine.astype(np.uint64),
        coarse * np.uint64(2048) + prev * np.uint64(2) + glued, coarse * np.uint64(2048) + follow * np.uint64(2) + glued_next, beside(own, 1, none) * np.uint64(2) + glued_next,
        beside(own, -1, none) * np.uint64(2) + glued, file * np.uint64(2048) + coarse, before + coarse,
    )
    shift = np.uint64(64 - (s.buckets.bit_length() - 1))
    table = np.empty((n, len(parts)), np.int32)
    for j, x in enumerate(parts):
        x = (x + np.uint64(j + 1)) * np.uint64(0xD6E8FEB86659FD93) + np.uint64((j + 1) * 0xA0761D6478BD642F & 0xFFFFFFFFFFFFFFFF)
        table[:, j] = ((x ^ (x >> np.uint64(31))) * np.uint64(_P)) >> shift
    return Tokens(start, end, first, glued > 0, table), begins


# ---- the field ------------------------------------------------------------------------------------------------------


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + np.squeeze(top, axis)


@dataclass
class Field:
    settings: Settings
    unary: np.ndarray  # buckets x 3
    step: np.ndarray  # 3 x 3; nothing is inside that does not follow a beginning or an inside
    first: np.ndarray  # 3
    #: Whether anything was learned.
    able: bool = True

    def scores(self, features: np.ndarray, glued: np.ndarray) -> np.ndarray:
        """Of labels of tokens; features: tokens in any shape x features."""
        out = np.zeros((*features.shape[:-1], 3))
        for j in range(features.shape[-1]):
            out += self.unary[features[..., j]]
        out[~glued, INSIDE] += _NEVER
        return out

    def surely_out(self, u: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Tokens that no best labelling has other than outside: making them so gains whatever their neighbours are.

        A label y between a and c becomes OUT; where c is INSIDE it becomes BEGIN, before d. The gain is known but for the
        labels, over which the least is taken.
        """
        ways = range(3)
        a_part = {y: max(max(self.step[a, y] - self.step[a, OUT] for a in ways), self.first[y] - self.first[OUT]) for y in (BEGIN, INSIDE)}
        most = {BEGIN: [], INSIDE: []}
        for y in (BEGIN, INSIDE):
            plain = max(0.0, *(self.step[y, c] - self.step[OUT, c] for c in (OUT, BEGIN)))
            after = max(0.0, *(self.step[INSIDE, d] - self.step[BEGIN, d] for d in ways))
            most[y] = (a_part[y] + plain, a_part[y] + self.step[y, INSIDE] - self.step[OUT, BEGIN] + after)
        swap = np.append(u[1:, INSIDE] - u[1:, BEGIN], -np.inf)
        swap[np.append(first[1:], True)] = -np.inf
        sure = np.ones(len(u), bool)
        for y in (BEGIN, INSIDE):
            loss = u[:, y] - u[:, OUT]
            sure &= (loss + most[y][0] < 0) & (loss + most[y][1] + swap < 0)
        return sure

    def viterbi(self, u: np.ndarray, first: np.ndarray, cut: bool = True) -> np.ndarray:
        """The best labels of chains that follow one another; first: where each begins."""
        n = len(u)
        labels = np.zeros(n, np.int8)
        sure = self.surely_out(u, first) if cut else np.zeros(n, bool)
        rest = np.flatnonzero(~sure)
        if not len(rest):
            return labels
        # pieces: stretches of tokens that are not surely outside, within a chain
        new = np.append(True, (rest[1:] != rest[:-1] + 1) | first[rest[1:]])
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(rest)))
        order = np.argsort(-size, kind="stable")
        begin, size = begin[order], size[order]
        head = rest[begin]
        tail = rest[begin + size - 1]
        u_rest = u[rest]
        score = u_rest[begin] + np.where(first[head][:, None], self.first, self.step[OUT])
        back = np.zeros((len(rest), 3), np.int8)
        live = np.searchsorted(-size, -np.arange(1, size[0] + 1), side="right")  # how many are longer than t - 1
        for t in range(1, int(size[0])):
            m = live[t]
            every = score[:m, :, None] + self.step
            back[begin[:m] + t] = every.argmax(1)
            score[:m] = every.max(1) + u_rest[begin[:m] + t]
        # a piece before a token that is surely outside ends with the step to it
        ends = ~np.append(first[1:], True)[tail]
        now = (score + np.where(ends[:, None], self.step[:, OUT], 0.0)).argmax(1).astype(np.int8)
        got = np.zeros(len(rest), np.int8)
        for t in range(int(size[0]) - 1, -1, -1):
            m = live[t]
            at = begin[:m] + t
            got[at] = now[:m]
            now[:m] = back[at, now[:m]]
        labels[rest] = got
        return labels

    def spans(self, texts: list[bytes]) -> list[list[tuple[int, int]]]:
        """(start, end) in bytes of what the field finds in each text."""
        out: list = [[] for _ in texts]
        held, size = [], 0
        for i, text in enumerate(texts if self.able else ()):
            file = file_features(text)
            for at, part in portions(text, self.settings.together):
                if held and size + len(part) > self.settings.together:
                    self._tag(held, out)
                    held, size = [], 0
                held.append((i, at, part, file))
                size += len(part)
        if held:
            self._tag(held, out)
        return out

    def _tag(self, parts: list[tuple[int, int, bytes, int]], out: list) -> None:
        tokens, begins = tokenize([x for _, _, x, _ in parts], [f for _, _, _, f in parts], self.settings)
        if not len(tokens.start):
            return
        y = self.viterbi(self.scores(tokens.features, tokens.glued), tokens.first)
        start = np.flatnonzero(y == BEGIN)
        # a secret goes on to the last token before one that is not inside
        stop = np.flatnonzero(np.append(y != INSIDE, True))
        last = stop[np.searchsorted(stop, start, side="right")] - 1
        of = np.searchsorted(begins, tokens.start[start], side="right") - 1
        for k, a, b in zip(of.tolist(), tokens.start[start].tolist(), tokens.end[last].tolist(), strict=True):
            i, at, _, _ = parts[k]
            out[i].append((at + a - int(begins[k]), at + b - int(begins[k])))


def portions(text: bytes, most: int):
    """(place, part) of a text in parts of at most `most` bytes, cut at ends of lines, which no chain spans; only a line that
    is longer is cut at a blank, or where it has none anywhere, into several chains."""
    at = 0
    while len(text) - at > most:
        for mark in (b"\n", b" "):
            end = text.rfind(mark, at, at + most)
            if end > at:
                break
        else:
            end = at + most
        yield at, text[at:end]
        at = end
    yield at, text[at:] if at else text


def gradient(field: Field, f: np.ndarray, glued: np.ndarray, y: np.ndarray, n: np.ndarray):
    """(likelihood, its gradient by unary scores, steps and firsts) of padded chains: f places x features, y labels, n lengths."""
    m, t = y.shape
    u = field.scores(f, glued)
    inside = np.arange(t) < n[:, None]
    ahead, behind = np.zeros((m, t, 3)), np.zeros((m, t, 3))
    ahead[:, 0] = field.first + u[:, 0]
    for i in range(1, t):
        ahead[:, i] = np.where(inside[:, i, None], _lse(ahead[:, i - 1, :, None] + field.step, 1) + u[:, i], ahead[:, i - 1])
    for i in range(t - 2, -1, -1):
        behind[:, i] = np.where(inside[:, i + 1, None], _lse(field.step + (u[:, i + 1] + behind[:, i + 1])[:, None, :], 2), 0.0)
    z = _lse(ahead[:, -1], 1)
    p = np.exp(ahead + behind - z[:, None, None]) * inside[:, :, None]
    hit = np.eye(3)[y] * inside[:, :, None]
    pair = np.exp(ahead[:, :-1, :, None] + field.step + (u[:, 1:] + behind[:, 1:])[:, :, None, :] - z[:, None, None, None]) * inside[:, 1:, None, None]
    seen = hit[:, :-1, :, None] * hit[:, 1:, None, :]
    path = (u * hit).sum() + (field.step * seen.sum((0, 1))).sum() + (field.first * hit[:, 0].sum(0)).sum()
    return path - z.sum(), hit - p, seen.sum((0, 1)) - pair.sum((0, 1)), hit[:, 0].sum(0) - p[:, 0].sum(0)


# ---- learning -------------------------------------------------------------------------------------------------------

# Other names of secrets, and how values are joined to names, in lines made for learning.
OTHER_NAMES = (b"pwd", b"pass", b"passphrase", b"credential", b"auth", b"bearer", b"access key", b"private key", b"login", b"passcode", b"auth_token", b"db_password", b"client_secret", b"key")
JOINTS = (b"=", b" = ", b": ", b" is ", b":", b'="', b" was set to ", b" -> ")
_LETTERS = b"abcdefghijklmnopqrstuvwxyz"
_DIGITS = b"0123456789"


def made_secret(rng: np.random.Generator, make: int) -> bytes:
    """A random secret of one of ten makes; the last three are known by what stands around them only."""
    pick = lambda letters, n: bytes(rng.choice(np.frombuffer(letters, np.uint8), n))
    n = int(rng.integers(8, 33))
    upper = _LETTERS.upper()
    if make == 0:
        return pick(b"0123456789ABCDEF", n + 8)
    if make == 1:
        return pick(_LETTERS + upper + _DIGITS, n + 4)
    if make == 2:
        return pick(_LETTERS + upper + _DIGITS + b"+/", n + 8) + b"=" * int(rng.integers(0, 3))
    if make == 3:
        return b"-".join(pick(b"0123456789abcdef", int(rng.integers(4, 13))) for _ in range(int(rng.integers(3, 6))))
    if make == 4:
        return pick(_LETTERS, 2) + b"_" + pick(_LETTERS, 4) + b"_" + pick(_LETTERS + upper + _DIGITS, n + 4)
    if make == 5:
        return b".".join(pick(_LETTERS + upper + _DIGITS + b"_-", n) for _ in range(3))
    if make == 6:
        return pick(_LETTERS + _DIGITS, n + 8)
    if make == 7:
        return pick(_LETTERS, int(rng.integers(4, 8))) + pick(_DIGITS, int(rng.integers(1, 4))) + pick(_LETTERS, int(rng.integers(0, 4)))
    if make == 8:
        return b"".join(pick(_LETTERS, int(rng.integers(3, 8))).capitalize() for _ in range(int(rng.integers(2, 5))))
    return pick(_LETTERS + upper, int(rng.integers(7, 14)))


def made_clean(rng: np.random.Generator) -> list[bytes]:
    """Random marks that are no secrets: addresses, dates, times, paths, numbers, versions, names of code."""
    d = lambda n: bytes(rng.choice(np.frombuffer(_DIGITS, np.uint8), n))
    w = lambda: bytes(rng.choice(np.frombuffer(_LETTERS, np.uint8), int(rng.integers(2, 9))))
    pick = lambda *x: x[int(rng.integers(len(x)))]
    return [
        pick(b"http://", b"https://", b"") + b"www." + w() + pick(b".com", b".org") + b"".join(b"/" + w() + pick(b"", d(1), d(2)) for _ in range(int(rng.integers(0, 4)))) + pick(b"", b".html", b"?id=" + d(3), b"#" + w()),
        pick(b"19", b"20") + d(2) + pick(b"-", b"/", b".") + d(2) + pick(b"-", b"/", b".") + d(2), d(2) + b":" + d(2) + pick(b"", b":" + d(2)),
        w() + pick(b"", b"." + w(), d(2)) + b"@" + w() + pick(b"", d(1)) + b".com", b".".join(d(int(rng.integers(1, 4))) for _ in range(int(rng.integers(2, 5)))),
        pick(b"+", b"") + b"-".join(d(int(rng.integers(2, 5))) for _ in range(int(rng.integers(2, 5)))), b" ".join(d(4) for _ in range(4)), b"/" + b"/".join(w() for _ in range(int(rng.integers(2, 5)))) + pick(b"", b".txt", b".py"),
        w() + b"_" + w() + pick(b"", b"()", d(1)), w() + w().capitalize() + pick(b"", b"()"), b"v" + d(1) + b"." + d(2), d(int(rng.integers(5, 19))),
    ]


def made_lines(line: bytes, a: int, name_at: int, b: int, rng: np.random.Generator) -> list[tuple[bytes, list]]:
    """(line, secrets) made of a line whose secret is at a to b and whose name, if it has one, begins at name_at."""
    before, after, value = line[:name_at], line[b:], line[a:b]
    named = line[name_at:a] or rng.choice(np.array(_NAMES)).tobytes().rstrip(b"\0") + b"="
    close = b'"' if named[-1:] == b'"' else b""
    after = after.removeprefix(b'"')
    words = re.findall(rb"[^\W\d_]+", before + after) or [b"the"]
    word = lambda: words[int(rng.integers(len(words)))]

    def line_of(name: bytes, secret: bytes, end: bytes = b""):
        return before + name + secret + end + b" " * (end == b"" and after[:1].isalnum()) + after, [(len(before + name), len(before + name + secret))]

    out = []
    for make in range(10):
        name = OTHER_NAMES[int(rng.integers(len(OTHER_NAMES)))] + JOINTS[int(rng.integers(len(JOINTS)))]
        shown = named if rng.random() < 0.4 else name
        end = close if shown == named else b'"' * (shown[-1:] == b'"')
        out.append(line_of(shown, made_secret(rng, make), end))
        if make < 6:
            out.append(line_of(b"", made_secret(rng, make)))
        if make >= 7:
            # the same makes without anything that says so
            out.append((before + made_secret(rng, make) + b" " + after, []))
    out.append(line_of(OTHER_NAMES[int(rng.integers(len(OTHER_NAMES)))] + JOINTS[int(rng.integers(len(JOINTS)))], value))
    out.append(line_of(word() + b" ", value))
    marks = made_clean(rng)
    out += [(before + b" ".join(x for m in part for x in (word(), m)) + b" " + after, []) for part in (marks[:4], marks[4:8], marks[8:])]
    # names without a secret
    for name in (named.strip(b"\"'=: "), OTHER_NAMES[int(rng.integers(len(OTHER_NAMES)))]):
        out.append((before + name + b" " + word() + b" " + word() + b" " + after, []))
        out.append((before + name + rng.choice(np.array([b": ", b" is ", b", "])).tobytes().rstrip(b"\0") + b" " + word() + b" " + word() + after, []))
    return out


def learning_lines(texts: list[bytes], s: Settings) -> list[tuple[bytes, list, int]]:
    """(line, secrets, file features) to learn from."""
    out, shown = [], []
    for raw in texts:
        file, found = file_features(raw), base_matches(raw)
        others, labelled, at = [], 0, 0
        for line in raw.split(b"\n"):
            mine: dict[int, tuple] = {}
            for a, b, _, _ in found:
                if at <= a and b <= at + len(line):
                    # matches that end alike are one secret, which begins where the last of them says
                    value = max(v for _, z, _, v in found if z == b)
                    mine[b] = (value - at, min(a - at, mine[b][1]) if b in mine else a - at, b - at)
            if mine and labelled < s.lines:
                labelled += 1
                out.append((line, [(a, b) for a, _, b in mine.values()], file))
                value, name, end = next(iter(mine.values()))
                cut = max(0, name - 200)
                shown.append((line[cut : end + 200], value - cut, name - cut, end - cut, file))
            elif not mine and line.strip():
                others.append(line)
            at += len(line) + 1
        # of other lines those with digits come first: they are what secrets might be taken for
        others.sort(key=lambda x: (not re.search(rb"\d", x), crc32(x)))
        out += [(x, [], file) for x in others[: s.lines]]
    for turn in range(-(-s.made // len(shown)) if shown else 0):
        for line, value, name, end, file in shown:
            rng = np.random.default_rng(crc32(line) + s.seed + turn)
            out += [(x, y, file) for x, y in made_lines(line, value, name, end, rng)]
    return out


def fit(texts: list[bytes], s: Settings) -> Field:
    """Gradient steps on the conditional likelihood, in batches of lines."""
    field = Field(s, np.zeros((s.buckets, 3)), np.array([[0, 0, _NEVER], [0, 0, 0], [0, 0, 0]], float), np.array([0, 0, _NEVER], float))
    lines = learning_lines(texts, s)
    if not any(spans for _, spans, _ in lines):
        field.able = False
        return field
    tokens, begins = tokenize([x for x, _, _ in lines], [f for _, _, f in lines], s)
    bounds = np.searchsorted(tokens.start, np.append(begins, 1 << 60))
    chains = []
    for i, (_, spans, _) in enumerate(lines):
        lo, hi = int(bounds[i]), int(bounds[i + 1])
        y = np.zeros(hi - lo, np.int64)
        a, b = tokens.start[lo:hi] - begins[i], tokens.end[lo:hi] - begins[i]
        for x, z in spans:
            hit = np.flatnonzero((a < z) & (b > x))
            y[hit] = INSIDE
            y[hit[:1]] = BEGIN
        # what a match holds after a blank is not inside of anything
        y[(y == INSIDE) & ~tokens.glued[lo:hi]] = BEGIN
        # a window around the first secret
        at = max(0, int(np.argmax(y > 0)) - s.window // 2) if spans else 0
        if hi > lo:
            chains.append((lo + at, y[at : at + s.window]))
    rng = np.random.default_rng(s.seed)
    speed, speed2, speed1 = np.full((s.buckets, 3), 1e-3), np.full((3, 3), 1e-3), np.full(3, 1e-3)
    for _ in range(s.epochs):
        # chains of like lengths go together
        order = sorted(range(len(chains)), key=lambda i: (len(chains[i][1]) // 8, rng.random()))
        batches = [order[i : i + s.batch] for i in range(0, len(order), s.batch)]
        for k in rng.permutation(len(batches)):
            own = [chains[i] for i in batches[k]]
            n = np.array([len(y) for _, y in own])
            wide = int(n.max())
            at = np.array([lo for lo, _ in own])[:, None] + np.minimum(np.arange(wide), n[:, None] - 1)
            f = tokens.features[at]
            y = np.zeros((len(own), wide), np.int64)
            for i, (_, x) in enumerate(own):
                y[i, : len(x)] = x
            _, gu, gs, gf = gradient(field, f, tokens.glued[at], y, n)
            rows = f.reshape(-1, f.shape[2])
            wide_g = gu.reshape(-1, 3)
            some = np.abs(wide_g).max(1) > 1e-6
            rows, wide_g = rows[some], wide_g[some]
            uniq, place = np.unique(rows, return_inverse=True)
            place = place.reshape(rows.shape)
            g = np.stack([np.bincount(place.ravel(), np.repeat(wide_g[:, c], rows.shape[1]), len(uniq)) for c in range(3)], axis=1)
            g -= s.decay * field.unary[uniq]
            speed[uniq] += g * g
            field.unary[uniq] += s.rate * g / np.sqrt(speed[uniq])
            for w, gw, v in ((field.step, gs, speed2), (field.first, gf, speed1)):
                gw = np.where(w <= _NEVER, 0, gw - s.decay * w)
                v += gw * gw
                w += s.rate * gw / np.sqrt(v)
    return field


def train(documents: DataFrame, s: Settings = Settings()) -> Field:
    """Half of the sample are texts that a pattern might label, told in the JVM. Ids and hashes are sorted, not texts, and
    what is gathered is bounded by the settings. Rows without an id are not learned from."""
    text = documents.select("doc_id", "text").where(F.col("doc_id").isNotNull() & (F.length("text") <= s.max_training_length))
    shape = F.col("text").rlike("[0-9a-f]{24}|AKIA[A-Z0-9]{16}|(?i)(password|passwd|secret|token|api_?key)[\"']? *[:=]")
    h = F.xxhash64("text").alias("__h")
    marks = written(text.where(F.col("text").rlike("[0-9]")).select("doc_id", h, shape.alias("__shape")), "secret-marks")
    half, order = s.max_training_texts // 2, (F.xxhash64("doc_id", F.lit(1)), "doc_id", "__h")
    own = marks.distinct()
    few = own.where("__shape").orderBy(*order).limit(half).unionByName(own.where("not __shape").orderBy(*order).limit(half)).drop("__shape")
    # at most max_training_texts rows of two numbers: the bound proves the size of the broadcast
    found = text.withColumn("__h", F.xxhash64("text")).join(F.broadcast(few), ["doc_id", "__h"]).dropDuplicates(["doc_id", "__h"]).limit(s.max_training_texts).collect()
    remove(marks)
    return fit(sorted(r.text.encode("utf-8", "surrogatepass") for r in found), s)


# ---- scans ----------------------------------------------------------------------------------------------------------


def scan(texts: list[bytes | None], field: Field) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text, in code points: (start, end, kind)."""
    texts = [t or b"" for t in texts]
    out = []
    for raw, more in zip(texts, field.spans(texts), strict=True):
        base = [(a, b, k) for a, b, k, _ in base_matches(raw)]
        starts = [x[0] for x in base]
        far = np.maximum.accumulate([x[1] for x in base]).tolist() if base else []
        extra = []
        for a, b in more:
            k = bisect_left(starts, b)
            if not (k and far[k - 1] > a):  # it meets no base span
                extra.append((a, b, 3))
        if (base or extra) and not raw.isascii():
            at = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
            base, extra = ([(int(at[a]), int(at[b]), k) for a, b, k in x] for x in (base, extra))
        out.append((base, sorted(base + extra, key=lambda x: (x[0], x[2]))))
    return out


def find_secrets(documents: DataFrame, s: Settings = Settings(), keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (all if not given) of documents, n_assign, n_access, n_hex, base (string), spans (string)."""
    bounded_batches(documents.sparkSession)
    keep = documents.columns if keep is None else keep
    shared = documents.sparkSession.sparkContext.broadcast(train(documents, s))
    kept = documents.select(*(F.col(f"`{c}`") for c in keep))
    schema = kept.schema
    for c, t in (("n_assign", "long"), ("n_access", "long"), ("n_hex", "long"), ("base", "string"), ("spans", "string")):
        schema = schema.add(free_name(kept, c), t)
    show = lambda spans: ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)

    def run(batches):
        forget_kept()
        field = shared.value
        for b in batches:
            counts, base, spans = [], [], []
            for own, every in scan(b.column(b.num_columns - 1).to_pylist(), field):
                counts.append([sum(k == i for _, _, k in own) for i in range(3)])
                base.append(show(own))
                spans.append(show(every))
            n = np.array(counts, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *(pa.array(n[:, i]) for i in range(3)), pa.array(base, pa.string()), pa.array(spans, pa.string())], names=schema.names)

    return documents.select(*(F.col(f"`{c}`") for c in keep), F.col("text").cast("binary").alias(free_name(kept, "__bytes"))).mapInArrow(run, schema)


def secrets_query(documents: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every row of documents."""
    out = find_secrets(documents.select("doc_id", "text"), s, ["doc_id"])
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")
