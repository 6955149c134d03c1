"""Counts of a text that quality rules go by."""

from __future__ import annotations

import numpy as np

from .common import WORD

SYMBOLS = "#*$%&|<>"
FIELDS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list[str], k: int = 3) -> int:
    """Words that lie in a run of ``k`` words found twice or more in the text."""
    n = len(words) - k + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    run = h[:n].copy()
    for i in range(1, k):
        run = (run ^ (run >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[i : n + i]
    order = np.argsort(run)
    same = run[order[1:]] == run[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n + k - 1, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = twice.copy()
    for i in range(1, k):
        covered[i:] |= twice[:-i]
    return int(covered.sum())


def stats(text: str | None) -> tuple[int, ...]:
    """FIELDS of a text; all 0 for null. Lines without a word don't count as lines."""
    if not text:
        return (0,) * len(FIELDS)
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (
        len(words),
        sum(map(len, words)),
        sum(map(text.count, SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )
