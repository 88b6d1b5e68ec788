"""Secret scans: base patterns, and a linear-chain conditional random field that adds what they miss.

Tokens are tagged as begin of a secret, inside one or outside. A token's
scores are a sum over features of its own shape, of the words before and after
it, and of the file (shares of digits, of symbols and of assignments); tags
follow each other by learned transition scores. The most likely tags come from
Viterbi decoding over lines. The model is trained here by exact gradients of
the likelihood (forward-backward) on sentences made by a seeded generator:
prose, code, settings and logs, with and without secrets of many formats.

A span can gain over "outside" at most the score of its begin, the best run of
inside scores after it and the best transitions. A line in which no token
could begin a span with a gain has only outside tags as its best path; such
lines, nearly all, are settled without decoding and without loss.

Spans of the model that reach beyond the base spans are added whole as kind ``crf``; base
spans always stay. Spans are in code points, the end exclusive.

Defined cases: null or empty text has no spans; texts and lines of any length
are scanned whole, and a line without a token that could begin a span costs no
decoding; of equally good tag sequences the one with the lower tags (outside,
begin, inside) wins; rows are scanned each, repeated or not; null ids are
kept; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.llm import common

# The base patterns, their kinds in order, and what a match must have (fixed values).
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ["assign", "access", "hex", "crf"]
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 8, 16, 32

O, B, I = 0, 1, 2
BITS = 13
CACHE_TOKENS = 200_000
MAX_TRAIN = 4_000

# A run of letters, digits and the marks that secrets hold, or one other character.
TOKEN = re.compile(r"[\w+/.~-]+|[^\w\s+/.~-]")
_LINE_TOKEN = re.compile(r"[\w+/.~-]+|[^\w\s+/.~-]|\n")
_HOT = re.compile(r"pass|secret|token|key|auth|cred|bearer|private|sign|pwd|login|client|access", re.IGNORECASE)
_PREFIX = re.compile(r"(?:gh[pousr]_|github_pat_|glpat-|xox[abprs]-|sk[_-]|pk_|rk_|AIza|ya29\.|eyJ|SG\.|npm_|pypi-|hf_|dop_v1_|shpat_|AKIA|ASIA|AGE-|whsec_)")
_UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
_STAMP = re.compile(r"\d{4}-\d\d-\d\d|\d{8}T?\d")
_FILE = re.compile(r"\.(?:py|js|css|html?|png|jpe?g|gif|svg|pdf|zip|gz|txt|md|json|ya?ml|xml|csv|java|rs|go|c|h|cpp|so|whl)$", re.IGNORECASE)

# Greedy runs of at least that many characters are just the long ones among all greedy runs.
_LONG_HEX = re.compile(HEX.pattern[:-1] + "{%d,}" % MIN_HEX)
_LONG_ACCESS = re.compile(ACCESS.pattern[:-1] + "{%d,}" % (MIN_ACCESS - 4))
_WORDS_OF_ASSIGN = ("password", "passwd", "secret", "token", "apikey", "api_key")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    low = text.lower()  # a text without these words in any case has no match
    out = []
    if any(w in low for w in _WORDS_OF_ASSIGN):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= MIN_ASSIGN]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _LONG_ACCESS.finditer(text)]
    out += [("hex", *m.span()) for m in _LONG_HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def _shape(token: str) -> str:
    """Runs of like characters as one letter: ``Ab12-x`` is ``XxdX-x`` without repeats."""
    s = re.sub(r"[^\W\d_]", lambda m: "X" if m.group().isupper() else "x", token[:64])
    return re.sub(r"(.)\1+", r"\1", re.sub(r"\d", "d", s))


def own_features(token: str) -> list[str]:
    n, letters = len(token), sum(c.isalpha() for c in token)
    digits, upper = sum(c.isdigit() for c in token), sum(c.isupper() for c in token)
    turns = sum((a.isdigit() != b.isdigit()) or (a.isupper() != b.isupper()) for a, b in zip(token, token[1:], strict=False))
    spread = len(set(token)) / max(1, n)
    shape = _shape(token)
    out = [
        "bias", f"len{min(n.bit_length(), 7)}", f"digits{digits * 4 // max(1, n)}{digits > 0}", f"upper{upper * 4 // max(1, n)}", f"letters{letters * 4 // max(1, n)}",
        f"turns{min(turns, 12) // 3}", f"turn_rate{turns * 5 // max(1, n)}{n >= 16}", f"spread{int(spread * 4)}{n >= 16}", f"shape{shape[:8]}" if len(shape) < 9 else "shapelong",
        f"long_mixed{n >= 16 and digits >= 3 and letters >= 3}", f"very_long{n >= 20 and turns >= 6}", f"prefix{bool(_PREFIX.match(token)) and n >= 16}", f"ascii{token.isascii()}",
    ]
    if n == 1:
        out.append(f"char{token}")
    if n >= 16:  # what looks random but names things in the open
        out += [f"uuid{bool(_UUID.fullmatch(token))}", f"url{token.startswith('//')}", f"path_like{token.count('/') >= 2 and max(map(len, token.split('/'))) < n * 3 // 4}", f"stamp{bool(_STAMP.match(token))}", f"file{bool(_FILE.search(token))}"]
    if "/" in token or "." in token:
        out.append(f"path{token.count('/') + token.count('.') > 1}{n >= 20 and turns >= 6}")
    return out


def near_features(token: str) -> list[str]:
    """What a token tells of its neighbour."""
    out = [f"hot{bool(_HOT.search(token))}", f"shape{_shape(token)[:3]}"]
    if not token.isalpha() and len(token) <= 2:
        out.append(f"char{token}")
    return out


def file_features(text: str) -> list[str]:
    n = max(1, len(text))
    digits = sum(text.count(c) for c in "0123456789")
    return [f"f_digits{min(digits * 50 // n, 4)}", f"f_marks{min((text.count('=') + text.count(':')) * 100 // n, 4)}", f"f_braces{min((text.count('{') + text.count(';')) * 100 // n, 3)}"]


def _slots(names: list[str], part: str) -> np.ndarray:
    import zlib

    return np.array(sorted({zlib.crc32(f"{part}|{x}".encode()) & ((1 << BITS) - 1) for x in names}), dtype=np.int64)


# --- training sentences -----------------------------------------------------------------------------------------

_KEYS = "password passwd secret token api_key apikey access_key client_secret auth_token private_key DB_PASSWORD SECRET_KEY credentials bearer pwd signing_key".split()
_NAMES = "name title count limit host port path user email version timeout region bucket color width date author language mode level".split()
_ALNUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
_SYLLABLES = "an the re on er en ti es th in at or ou ing ed tion le que ment un der ein sch lich os ado cion is and of to be".split()


def _of(rng: np.random.Generator, chars: str, low: int, high: int) -> str:
    return "".join(chars[i] for i in rng.integers(0, len(chars), int(rng.integers(low, high))))


def _secret(rng: np.random.Generator) -> str:
    kind = int(rng.integers(0, 10))
    if kind < 3:
        prefix = ["ghp_", "gho_", "glpat-", "xoxb-", "sk_live_", "sk-", "pk_live_", "AIza", "hf_", "npm_", "SG.", "whsec_", "AKIA"][int(rng.integers(0, 13))]
        return prefix + _of(rng, _ALNUM, 20, 40)
    if kind < 4:
        return f"eyJ{_of(rng, _ALNUM, 15, 30)}.eyJ{_of(rng, _ALNUM, 20, 40)}.{_of(rng, _ALNUM + '-_', 20, 43)}"
    if kind < 6:
        return _of(rng, _ALNUM, 20, 44)
    if kind < 7:
        return _of(rng, _ALNUM + "+/", 24, 64)
    if kind < 8:
        return _of(rng, "0123456789abcdef", 24, 65)
    return _of(rng, _ALNUM, 10, 20) + str(int(rng.integers(10, 1000)))


def _word(rng: np.random.Generator) -> str:
    w = "".join(_SYLLABLES[i] for i in rng.integers(0, len(_SYLLABLES), int(rng.integers(1, 6))))
    k = int(rng.integers(0, 24))
    return w.capitalize() if k == 0 else w.upper() if k == 1 else w + ".,;:!?"[k % 6] if k < 6 else w


def _plain(rng: np.random.Generator) -> str:
    kind, d, h = int(rng.integers(0, 20)), "0123456789", "0123456789abcdef"
    return [
        lambda: _of(rng, d, 1, 8), lambda: _of(rng, d, 12, 20), lambda: ".".join(_of(rng, d, 1, 4) for _ in range(4)), lambda: f"{_word(rng)}@{_word(rng)}.example.com",
        lambda: f"https://www.{_word(rng)}.example.org/en/{_of(rng, d, 1, 5)}?page={_of(rng, d, 1, 3)}", lambda: f"20{_of(rng, d, 2, 3)}-0{_of(rng, d, 1, 2)}-1{_of(rng, d, 1, 2)}", lambda: f"+49-{_of(rng, d, 3, 4)}-{_of(rng, d, 4, 9)}",
        lambda: f"{_of(rng, d, 1, 3)}.{_of(rng, d, 1, 3)}.{_of(rng, d, 1, 3)}", lambda: "_".join(_word(rng) for _ in range(4)), lambda: "/".join(["src", *(_word(rng) for _ in range(3))]) + ".py",
        lambda: f"{_word(rng)}{_word(rng).capitalize()}{_word(rng).capitalize()}", lambda: _word(rng) + ["&&&", "%%%", "$$$", "###", "***", "!!"][int(rng.integers(0, 6))], lambda: "|", lambda: f"{_word(rng)}-{_word(rng)}-{_of(rng, d, 1, 3)}",
        # Identifiers that are no secrets, however random.
        lambda: (lambda u: u.upper() if rng.random() < 0.2 else u)("-".join(_of(rng, h, n, n + 1) for n in (8, 4, 4, 4, 12))),
        lambda: f"http{['', 's'][int(rng.integers(0, 2))]}://{['www.', '', 'cdn.'][int(rng.integers(0, 3))]}{_word(rng).strip('.,;:!?')}.example.{['com', 'net', 'org'][int(rng.integers(0, 3))]}/{['en', 'v', 'img', 'watch'][int(rng.integers(0, 4))]}/{_of(rng, _ALNUM, 8, 33)}{['', '.png', '/', '?v=2'][int(rng.integers(0, 4))]}",
        lambda: f"20{_of(rng, d, 2, 3)}-0{_of(rng, d, 1, 2)}-1{_of(rng, d, 1, 2)}T{_of(rng, d, 2, 3)}:{_of(rng, d, 2, 3)}:{_of(rng, d, 2, 3)}.{_of(rng, d, 3, 7)}Z",
        lambda: f"{_word(rng).strip('.,;:!?')}-{_of(rng, d, 1, 2)}.{_of(rng, d, 1, 3)}.{_of(rng, d, 1, 2)}-py3-none-any.whl", lambda: f"IMG_20{_of(rng, d, 6, 7)}_{_of(rng, d, 6, 7)}.jpg", lambda: f"/usr/lib/{_word(rng)}/{_word(rng)}{_of(rng, d, 1, 3)}/{_word(rng)}.so",
    ][kind]()


def sentence(rng: np.random.Generator) -> tuple[str, list[tuple[int, int]]]:
    """One line and the spans of its secrets."""
    text, spans = "", []
    for _ in range(int(rng.integers(2, 14))):
        kind = rng.random()
        if kind < 0.08:
            key, s = _KEYS[int(rng.integers(0, len(_KEYS)))], _secret(rng)
            sep = ["=", ": ", " = ", ':"', ' = "', "='", " "][int(rng.integers(0, 7))]
            text += key + sep
            spans.append((len(text), len(text) + len(s)))
            text += s + ('"' if '"' in sep else "'" if "'" in sep else "")
        elif kind < 0.12:
            s = _secret(rng)
            while len(s) < 24:
                s = _secret(rng)
            spans.append((len(text), len(text) + len(s)))
            text += s
        elif kind < 0.2:
            text += f"{_NAMES[int(rng.integers(0, len(_NAMES)))]}{['=', ': ', ' = '][int(rng.integers(0, 3))]}{_plain(rng)}"
        elif kind < 0.24:
            text += f"{_KEYS[int(rng.integers(0, len(_KEYS)))]} {_word(rng)}"  # a key word in prose
        elif kind < 0.4:
            text += _plain(rng)
        else:
            text += _word(rng)
        text += " "
    return text, spans


@dataclass(frozen=True)
class Crf:
    own: np.ndarray  # slots x 3
    transition: np.ndarray  # 3 x 3
    start: np.ndarray  # 3

    def own_scores(self, token: str) -> np.ndarray:
        return self.own[_slots(own_features(token), "own")].sum(axis=0)

    def previous_scores(self, token: str) -> np.ndarray:
        return self.own[_slots(near_features(token), "previous")].sum(axis=0)

    def next_scores(self, token: str) -> np.ndarray:
        return self.own[_slots(near_features(token), "next")].sum(axis=0)

    def file_scores(self, text: str) -> np.ndarray:
        return self.own[_slots(file_features(text), "file")].sum(axis=0)


_NEVER = -30.0


@functools.lru_cache(maxsize=2)
def train(sentences: int = 1600, seed: int = 3, steps: int = 90, rate: float = 0.12, l2: float = 2e-3) -> Crf:
    """Adam on the exact conditional likelihood; I after O, or first, is never allowed."""
    if sentences > MAX_TRAIN:
        raise ValueError(f"more than {MAX_TRAIN} training sentences")
    rng = np.random.default_rng(seed)
    rows, tags = [], []
    for _ in range(sentences):
        text, spans = sentence(rng)
        tokens = list(TOKEN.finditer(text))
        slots = [_slots(own_features(t.group()), "own") for t in tokens]
        near = [_slots(near_features(t.group()), "previous") for t in tokens], [_slots(near_features(t.group()), "next") for t in tokens]
        whole = _slots(file_features(text), "file")
        first, last = _slots(["edge"], "previous"), _slots(["edge"], "next")
        rows.append([np.concatenate([s, near[0][i - 1] if i else first, near[1][i + 1] if i + 1 < len(tokens) else last, whole]) for i, s in enumerate(slots)])
        y = np.zeros(len(tokens), dtype=np.int64)
        for a, b in spans:
            inside = [i for i, t in enumerate(tokens) if t.start() < b and t.end() > a]
            y[inside] = I
            y[inside[:1]] = B
        tags.append(y)
    n, length = len(rows), max(map(len, rows))
    mask = np.array([[i < len(r) for i in range(length)] for r in rows])
    y = np.array([np.pad(t, (0, length - len(t))) for t in tags])
    flat = np.concatenate([s for r in rows for s in r])
    used, flat = np.unique(flat, return_inverse=True)
    owner = np.repeat(np.flatnonzero(mask.ravel()), [len(s) for r in rows for s in r])
    ones = np.ones(len(flat))

    w, tr, st = np.zeros((len(used), 3)), np.zeros((3, 3)), np.zeros(3)
    ban_t, ban_s = np.zeros((3, 3)), np.zeros(3)
    ban_t[O, I] = ban_s[I] = _NEVER
    target = np.eye(3)[y] * mask[..., None]
    pair = np.zeros((3, 3))
    both = mask[:, 1:] & mask[:, :-1]
    np.add.at(pair, (y[:, :-1][both], y[:, 1:][both]), 1)
    m = v = 0.0
    for step in range(1, steps + 1):
        e = np.stack([np.bincount(owner, weights=w[flat, k], minlength=n * length) for k in range(3)], axis=1).reshape(n, length, 3)
        t, s = tr + ban_t, st + ban_s
        alpha, beta = np.zeros((n, length, 3)), np.zeros((n, length, 3))
        alpha[:, 0] = s + e[:, 0]
        for i in range(1, length):
            a = np.logaddexp.reduce(alpha[:, i - 1, :, None] + t, axis=1) + e[:, i]
            alpha[:, i] = np.where(mask[:, i, None], a, alpha[:, i - 1])
        for i in range(length - 2, -1, -1):
            b = np.logaddexp.reduce(t + (e[:, i + 1] + beta[:, i + 1])[:, None, :], axis=2)
            beta[:, i] = np.where(mask[:, i + 1, None], b, 0)
        z = np.logaddexp.reduce(alpha[:, -1], axis=1)
        p = np.exp(alpha + beta - z[:, None, None]) * mask[..., None]
        diff = (p - target).reshape(-1, 3)
        gw = np.stack([np.bincount(flat, weights=diff[owner, k] * ones, minlength=len(used)) for k in range(3)], axis=1) / n + l2 * w / 10
        two = np.exp(alpha[:, :-1, :, None] + t + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]) * both[..., None, None]
        gt = (two.sum(axis=(0, 1)) - pair) / n + l2 * tr
        gs = (p[:, 0] - target[:, 0]).mean(axis=0) + l2 * st
        g = np.concatenate([gw.ravel(), gt.ravel(), gs])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        d = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w -= d[: w.size].reshape(w.shape)
        tr -= d[w.size : w.size + 9].reshape(3, 3)
        st -= d[-3:]
    full = np.zeros((1 << BITS, 3))
    full[used] = w
    return Crf(full, tr + ban_t, st + ban_s)


def viterbi(e: np.ndarray, transition: np.ndarray, start: np.ndarray) -> list[int]:
    score, back = start + e[0], []
    for row in e[1:]:
        s = score[:, None] + transition
        best = s.argmax(axis=0)
        back.append(best)
        score = s[best, [0, 1, 2]] + row
    tags = [int(score.argmax())]
    for best in reversed(back):
        tags.append(int(best[tags[-1]]))
    return tags[::-1]


class Scanner:
    """Finds the model's spans in texts; remembers the scores of tokens."""

    def __init__(self, crf: Crf) -> None:
        self.crf = crf
        self.at: dict[str, int] = {}
        self.alike: dict[tuple, int] = {}
        self.n_rows = 0
        self.rows = np.zeros((1024, 9))
        t, s = crf.transition, crf.start
        self.edge_before = crf.own[_slots(["edge"], "previous")].sum(axis=0)
        self.edge_after = crf.own[_slots(["edge"], "next")].sum(axis=0)
        # What the best transitions into, inside and out of a span can add over staying outside.
        self.into = max(t[O, B] - t[O, O], s[B] - s[O], t[B, B] - t[O, O], t[I, B] - t[O, O])
        self.inside = max(t[B, I], t[I, I]) - t[O, O]
        self.out = max(0.0, t[B, O] - t[O, O], t[I, O] - t[O, O])

    @staticmethod
    def _like(t: str) -> tuple | None:
        """Plain words, a full stop after them or not, with one such key have the same features."""
        core = t[:-1] if t[-1] == "." else t
        if len(core) < 2 or not core.isalpha():
            return None
        case = "l" if core.islower() else "u" if core.isupper() else "c" if core[0].isupper() and core[1:].islower() else ""
        if not case or (len(core) > 64):
            return None
        if case == "u" and (len(t) >= 16 or not core.isascii()):
            return None
        return len(t), len(core), int(len(set(t)) / len(t) * 4), case, t.isascii(), _HOT.search(t) is not None

    def index(self, tokens: list[str]) -> np.ndarray:
        at = self.at
        try:
            return np.fromiter(map(at.__getitem__, tokens), dtype=np.int64, count=len(tokens))
        except KeyError:
            pass
        if len(at) > CACHE_TOKENS:
            at.clear()
            self.alike.clear()
            self.n_rows = 0
        for t in tokens:
            if t not in at:
                like = self._like(t)
                if like is not None and like in self.alike:
                    at[t] = self.alike[like]
                    continue
                k = self.n_rows
                self.n_rows += 1
                if like is not None:
                    self.alike[like] = k
                if k >= len(self.rows):
                    self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
                # A line end is the edge of its neighbours' lines and no token itself.
                self.rows[k] = np.concatenate([np.array([0, -1e4, -1e4]), self.edge_before, self.edge_after] if t == "\n" else [self.crf.own_scores(t), self.crf.previous_scores(t), self.crf.next_scores(t)])
                at[t] = k
        return np.fromiter(map(at.__getitem__, tokens), dtype=np.int64, count=len(tokens))

    def spans(self, text: str) -> list[tuple[int, int]]:
        tokens = ["\n", *_LINE_TOKEN.findall(text), "\n"]
        if len(tokens) == 2:
            return []
        index = self.index(tokens)
        rows = self.rows[index]
        e = rows[1:-1, 0:3] + rows[:-2, 3:6] + rows[2:, 6:9] + self.crf.file_scores(text)
        # No span from a token on can gain more than its begin and the best run of inside tags that may follow.
        run = np.cumsum(e[:, I] - e[:, O] + self.inside)
        follow = np.append(np.maximum.accumulate(run[::-1])[::-1][1:] - run[:-1], 0.0)
        hot = np.flatnonzero(e[:, B] - e[:, O] + self.into + np.maximum(follow, 0) + self.out > -1e-6)
        if not len(hot):
            return []
        breaks = [i for i, t in enumerate(tokens[1:-1]) if t == "\n"]
        edges = np.array([-1, *breaks, len(e)])
        lines = np.unique(np.searchsorted(edges, hot, side="right") - 1)
        where = [m.span() for m in _LINE_TOKEN.finditer(text)]
        out: list[tuple[int, int]] = []
        for k in lines:
            a, b = int(edges[k]) + 1, int(edges[k + 1])
            open_ = False
            for i, tag in zip(range(a, b), viterbi(e[a:b], self.crf.transition, self.crf.start), strict=True):
                if tag == B:
                    out.append(where[i])
                elif tag == I and open_:
                    out[-1] = (out[-1][0], where[i][1])
                open_ = tag != O
        return out


_scanners: dict[int, tuple[Crf, Scanner]] = {}


def scanner_of(crf: Crf) -> Scanner:
    """One for each model and worker, so that tokens stay known from batch to batch."""
    if id(crf) not in _scanners:
        _scanners.clear()
        _scanners[id(crf)] = crf, Scanner(crf)
    return _scanners[id(crf)][1]


def _reaches_beyond(text: str, a: int, b: int, base: list[tuple[str, int, int]]) -> bool:
    """Whether anything but blanks of text[a:b] lies outside the base spans, which come by start."""
    for _, s, e in base:
        if s >= b:
            break
        if e > a:
            if text[a:s].strip():
                return True
            a = e
    return bool(text[a:b].strip())


def all_spans(text: str, scanner: Scanner) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    base = base_spans(text)
    added = [("crf", a, b) for a, b in scanner.spans(text) if _reaches_beyond(text, a, b, base)]
    return base, sorted(base + added, key=lambda s: (s[1], KINDS.index(s[0])))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan(text: Column, sent) -> Column:
    """Struct of base and all spans of a text, each an array of (kind, start, end). sent: the broadcast model."""
    kind = "struct<kind string, start bigint, stop bigint>"

    def find(texts: pa.Array) -> pa.Array:
        scanner = scanner_of(sent.value)
        rows = [all_spans(t.as_py() or "", scanner) for t in texts]

        def listed(i: int) -> pa.Array:
            return pa.array([[{"kind": k, "start": a, "stop": b} for k, a, b in r[i]] for r in rows], pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())])))

        return pa.StructArray.from_arrays([listed(0), listed(1)], ["base", "spans"])

    return F.arrow_udf(find, f"struct<base array<{kind}>, spans array<{kind}>>").asNondeterministic()(text.cast("string"))


def find_secrets(docs: DataFrame, text_col: str = "text", out_col: str = "found") -> DataFrame:
    """The rows with a struct column: ``base`` and ``spans``, arrays of (kind, start, stop)."""
    sent = docs.sparkSession.sparkContext.broadcast(train())
    return docs.withColumn(out_col, scan(F.col(text_col), sent))


def full_decode(crf: Crf, text: str) -> list[tuple[int, int]]:
    """The model's spans with every line decoded, for comparison with ``Scanner.spans``."""
    out: list[tuple[int, int]] = []
    whole, offset = crf.file_scores(text), 0
    edge_before, edge_after = (crf.own[_slots(["edge"], part)].sum(axis=0) for part in ("previous", "next"))
    for line in text.split("\n"):
        at = list(TOKEN.finditer(line))
        tokens = [m.group() for m in at]
        if tokens:
            e = np.array([
                crf.own_scores(t) + (crf.previous_scores(tokens[i - 1]) if i else edge_before) + (crf.next_scores(tokens[i + 1]) if i + 1 < len(tokens) else edge_after) + whole for i, t in enumerate(tokens)
            ])
            open_ = False
            for m, tag in zip(at, viterbi(e, crf.transition, crf.start), strict=True):
                if tag == B:
                    out.append((offset + m.start(), offset + m.end()))
                elif tag == I and open_:
                    out[-1] = (out[-1][0], offset + m.end())
                open_ = tag != O
        offset += len(line) + 1
    return out


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The rows with every span of the text replaced by a mark; texts without spans are unchanged."""
    found = find_secrets(docs, text_col, "__found")
    # Spans come by start; one that begins inside another only lengthens it. Pieces are joined in one pass.
    step = F.aggregate(
        "__found.spans",
        F.struct(F.lit("").alias("done"), F.lit(0).cast("bigint").alias("at")),
        lambda acc, s: F.struct(
            F.when(s["start"] < acc["at"], acc["done"]).otherwise(F.concat(acc["done"], F.substring(F.col(text_col), acc["at"].cast("int") + 1, (s["start"] - acc["at"]).cast("int")), F.lit(mark))).alias("done"),
            F.greatest(acc["at"], s["stop"]).alias("at"),
        ),
        lambda acc: F.concat(acc["done"], F.substring(F.col(text_col), acc["at"].cast("int") + 1, F.length(F.col(text_col)))),
    )
    out = F.when(F.size("__found.spans") > 0, step).otherwise(F.col(text_col))
    return found.withColumn(text_col, out).drop("__found")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("found.base", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in KINDS[:3]], F.sha2(text("found.base"), 256).alias("base_sha256"), text("found.spans").alias("spans"))
