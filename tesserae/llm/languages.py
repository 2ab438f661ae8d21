"""Which language a stretch of text is in: naive Bayes on words and their character n-grams, from a bounded labelled sample."""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np

BITS = 18
MASK = (1 << BITS) - 1
#: A language needs so many labelled texts to be told.
SUPPORT = 30
#: Weight of what a gram's share is everywhere.
SMOOTH = 1000.0
WORD = re.compile(r"[぀-ヿ㐀-鿿]+|[^\W\d_぀-ヿ㐀-鿿]+")
CJK = re.compile(r"[぀-ヿ㐀-鿿]")
#: Names, and codes of letters and digits, are in no language.
NAME = re.compile(r"(?<![A-Za-zÀ-ɏА-я])[A-ZÀ-ÖØ-ÞА-Я][^\W\d_A-ZÀ-ÖØ-Þ぀-ヿ㐀-鿿]{2,}|[A-Za-z]+\d\w*|\d+[A-Za-z]\w*")
QUOTED = re.compile(r"[“„«「『\"][^“”„«»「」『』\"]*[”“»」』\"]")


def units(text: str) -> Iterator[str]:
    """The words that tell a language; single characters and pairs in scripts without blanks."""
    for word in WORD.findall(text.casefold() if text.isupper() else NAME.sub(" ", text).casefold()):
        if CJK.match(word):
            yield from word
            yield from (word[i : i + 2] for i in range(len(word) - 1))
        elif len(word) > 1:
            yield word


def grams(unit: str) -> list[int]:
    """Hashed word and, of a longer one, its n-grams."""
    marked = f"^{unit}$"
    found = [marked]
    if len(unit) > 3 and not CJK.match(unit):
        found += [marked[i : i + 4] for i in range(len(marked) - 3)]
    return [crc32(f.encode("utf-8", "surrogatepass")) & MASK for f in found]


class Languages:
    """Scores are log-likelihoods relative to the mean of all languages; zeros where nothing tells."""

    KEPT = 50_000

    def __init__(self, codes: list[str], table: np.ndarray) -> None:
        self.codes, self.table = codes, table
        self.known: dict[str, int] = {}
        self.rows = np.zeros((self.KEPT, len(codes)), np.float32)

    def __getstate__(self):
        return self.codes, self.table

    def __setstate__(self, state):
        self.__init__(*state)

    def weight(self, unit: str) -> np.ndarray:
        """A word's own score and the mean of its n-grams', which all say much the same."""
        own, *parts = grams(unit)
        return self.table[own] + self.table[parts].mean(axis=0) if parts else self.table[own]

    def scores(self, text: str) -> list[float]:
        known, at = self.known, []
        for unit in units(text):
            if (row := known.get(unit)) is None:
                if len(known) >= self.KEPT:
                    return np.sum([self.weight(u) for u in units(text)], axis=0).tolist()
                row = known[unit] = len(known)
                self.rows[row] = self.weight(unit)
            at.append(row)
        return self.rows[at].sum(axis=0).tolist() if at else [0.0] * len(self.codes)

    @staticmethod
    def fit(texts: list[tuple[str, str]]) -> Languages:
        sizes: dict[str, int] = {}
        for _, code in texts:
            sizes[code] = sizes.get(code, 0) + 1
        codes = sorted(c for c, n in sizes.items() if n >= SUPPORT)
        place = {c: i for i, c in enumerate(codes)}
        counts = np.zeros((MASK + 1, len(codes)), np.float64)
        for text, code in texts:
            if code in place:
                at = {g for u in units(QUOTED.sub(" ", text)) or units(text) for g in grams(u)}
                if at:
                    counts[list(at), place[code]] += 1
        if not codes:
            return Languages([], counts.astype(np.float32))
        total = counts.sum(axis=0)
        everywhere = counts.sum(axis=1, keepdims=True) / max(total.sum(), 1) + 1e-9
        table = np.log((counts + SMOOTH * everywhere) / (total + SMOOTH))
        return Languages(codes, (table - table.mean(axis=1, keepdims=True)).clip(-6, 6).astype(np.float32))
