"""Spellings of words and names: folding, edit distance, near words, abbreviations and name agreement."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from itertools import combinations

#: Letters without a decomposition and their plain forms: fixed values.
_PLAIN = str.maketrans({"ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ð": "d", "þ": "th", "’": "'", "`": "'"})


@lru_cache(maxsize=100_000)
def plain(text: str) -> str:
    """Text without accents, compatibility forms resolved, letter case kept."""
    if text.isascii():
        return text
    text = unicodedata.normalize("NFKD", text.translate(_PLAIN))
    return "".join(c for c in text if not unicodedata.combining(c))


def spaced(text: str) -> str:
    """Words run together are set apart where every word begins with a capital: 'AnnaNorth' to 'Anna North'."""
    if re.fullmatch(r"(?:[^\W\d_][a-z'’]*[a-z])(?:[A-Z][a-z'’]+)+", text):
        return re.sub(r"(?<=[a-z])(?=[A-Z])", " ", text)
    return text


def distance(a: str, b: str, limit: int = 99) -> int:
    """Edits from a to b: insertions, deletions, substitutions and swaps of neighbours; limit + 1 for any above it."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    while a and b and a[0] == b[0]:
        a, b = a[1:], b[1:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    if not a or not b:
        return min(max(len(a), len(b)), limit + 1)
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if before and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, before[j - 2] + 1)
            row.append(best)
        if min(row) > limit and min(last) > limit:
            return limit + 1
        before, last = last, row
    return min(last[-1], limit + 1)


#: Characters read for one another in typed or scanned names: fixed values.
LOOKALIKES = (("0", "o"), ("1", "l"), ("rn", "m"), ("5", "s"), ("vv", "w"))


@lru_cache(maxsize=200_000)
def looks(word: str) -> str:
    """A word with lookalike characters made equal; i, l and 1 are one, as are 0 and o, rn and m."""
    for a, b in LOOKALIKES:
        word = word.replace(a, b)
    return word.replace("l", "i")


def word_distance(a: str, b: str) -> int:
    """Edits between two words up to 3, confusions of lookalikes as one edit however many there are."""
    d = distance(a, b, 2)
    if d > 1 and ((x := looks(a)) != a or looks(b) != b):
        d = min(d, 1 + distance(x, looks(b), 1))
    return d


def subsequence(short: str, long: str) -> bool:
    rest = iter(long)
    return all(c in rest for c in short)


def abbreviates(short: str, word: str) -> bool:
    """Whether ``short`` can stand for ``word``: same first letter, a prefix of two or more or letters in order."""
    if not short or len(short) >= len(word) or short[0] != word[0]:
        return False
    return word.startswith(short) if len(short) < 3 else subsequence(short, word)


class NearWords:
    """Words of a vocabulary within ``most`` edits, found by common deletions."""

    def __init__(self, words: set[str], most: int = 2):
        self.most, self.words = most, words
        self.longest = max(map(len, words), default=0) + most
        self.index: dict[str, list[str]] = {}
        for w in words:
            for form in {w, looks(w)}:
                for v in self._shorter(form):
                    self.index.setdefault(v, []).append(w)

    def _shorter(self, w: str) -> set[str]:
        out = {w}
        for k in range(1, min(self.most, max(0, len(w) - 2)) + 1):
            for drop in combinations(range(len(w)), k):
                out.add("".join(c for i, c in enumerate(w) if i not in drop))
        return out

    def near(self, word: str) -> list[tuple[str, int]]:
        if len(looks(word)) > self.longest:
            return []
        found = {w for form in {word, looks(word)} for v in self._shorter(form) for w in self.index.get(v, ())}
        return [(w, d) for w in found if (d := word_distance(word, w)) <= self.most]
