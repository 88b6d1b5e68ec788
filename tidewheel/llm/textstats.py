"""Statistics of whole texts, one pass in numpy over the bytes and one over the words.

``BASE`` are exact integer counts; ``RATIOS`` are derived from them and serve
as inputs of the rule learner and the quality classifier.
"""

from __future__ import annotations

import numpy as np

from tidewheel.llm.common import window_hashes, word_hashes

SYMBOLS = "#*$%&|<>"
REPEAT_WINDOW = 8

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
RATIOS = ["mean_word_chars", "symbol_ratio", "dup_line_ratio", "repeat_ratio", "upper_ratio", "digit_ratio", "punct_ratio", "other_ratio", "unique_word_ratio", "mean_line_words", "same_next_ratio", "short_word_ratio"]

# Classes of bytes: the rows and columns of the class transitions.
CLASSES = ["other", "upper", "lower", "digit", "blank", "line", "stop", "shout", "symbol", "bar", "quote", "high"]
_CLASS = np.zeros(256, dtype=np.uint8)
for _i, _chars in enumerate(["", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " \t\r\x0b\x0c", "\n", ".,;:", "!?", "#*$%&", "|<>", "\"'`()[]{}"]):
    for _c in _chars:
        _CLASS[ord(_c)] = _i
_CLASS[128:] = len(CLASSES) - 1
TRANSITIONS = len(CLASSES) ** 2


def repeated_positions(windows: np.ndarray, n_words: int, k: int) -> int:
    """Words that lie in a window which occurs twice or more."""
    if len(windows) < 2:
        return 0
    order = np.argsort(windows, kind="stable")
    same = windows[order][1:] == windows[order][:-1]
    if not same.any():
        return 0
    hit = np.zeros(len(windows), dtype=bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    edge = np.zeros(n_words + 1, dtype=np.int32)
    at = np.flatnonzero(hit)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + k, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


_SYMBOL_BYTES = list(SYMBOLS.encode())
_BLANK_BYTES = [0x20, *range(0x09, 0x0E)]


def features(raw: bytes | None) -> tuple[list[int], list[float], np.ndarray]:
    """Base counts, ratios, and the relative frequencies of byte-class transitions of a UTF-8 text."""
    raw = raw or b""
    hashes, lengths = word_hashes(raw)
    n = len(hashes)
    b = np.frombuffer(raw, dtype=np.uint8)
    by_byte = np.bincount(b, minlength=256)
    points = len(raw) - int(by_byte[0x80:0xC0].sum())
    chars = points - int(by_byte[_BLANK_BYTES].sum())
    symbols = int(by_byte[_SYMBOL_BYTES].sum())
    seen: set[bytes] = set()
    dup = 0
    for line in raw.split(b"\n"):
        if line in seen:
            dup += bool(line.strip(b" \t\x0b\x0c\r"))
        else:
            seen.add(line)
    repeat = repeated_positions(window_hashes(hashes, REPEAT_WINDOW), n, REPEAT_WINDOW)
    by = np.bincount(_CLASS, weights=by_byte, minlength=len(CLASSES))
    size = max(1.0, float(len(raw) - by[4] - by[5]))
    lines = raw.count(b"\n") + 1
    ordered = np.sort(hashes)
    ratios = [
        chars / max(1, n), symbols / max(1, chars), dup / lines, repeat / max(1, n),
        by[1] / size, by[3] / size, (by[6] + by[7] + by[10]) / size, by[0] / size,
        (int((ordered[1:] != ordered[:-1]).sum()) + (n > 0)) / max(1, n), n / lines,
        int((hashes[1:] == hashes[:-1]).sum()) / max(1, n - 1), int((lengths < 4).sum()) / max(1, n),
    ]
    cls = _CLASS[b]
    pairs = np.bincount(cls[:-1] * np.uint8(len(CLASSES)) + cls[1:], minlength=TRANSITIONS) if len(cls) > 1 else np.zeros(TRANSITIONS)
    return [n, chars, symbols, dup, repeat], [float(r) for r in ratios], pairs / max(1, len(cls) - 1)
