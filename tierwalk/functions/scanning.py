"""Walks over a text by hand, in time linear in its length: names in running text, values that follow labels.

A capital word is an upper-case ASCII letter and lower-case ones. A name is a capital word, an initial if there is one, and
capital words after it, with one space between (a word may also follow straight on, as in two-part names).
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

_CAPITAL = re.compile("[A-Z][a-z]+")
_UPPER, _LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_LOWER = _LETTERS - _UPPER
SIGNS = ",-—–"


class AnyCase:
    """A pattern (of lower-case letters) that counts in any case. ASCII texts are searched in lower case, so that case needs no thought at every place."""

    def __init__(self, pattern: str):
        self.lower, self.any = re.compile(pattern), re.compile(pattern, re.I)

    def on(self, t: str) -> tuple[re.Pattern, str]:
        """A pattern and a text that have the same matches at the same places as this one in t."""
        return (self.lower, t.lower()) if t.isascii() else (self.any, t)

    def finditer(self, t: str) -> Iterator[re.Match]:
        pattern, t = self.on(t)
        return pattern.finditer(t)


def _at(t: str, i: int) -> str:
    return t[i] if 0 <= i < len(t) else ""


def _initial(t: str, i: int, letters: frozenset[str] = _UPPER) -> int:
    """Where a space, a single letter, a point if there is one, and then a space begins at i: the place of that last space; else i."""
    if _at(t, i).isspace() and _at(t, i + 1) in letters:
        j = i + 2 + (_at(t, i + 2) == ".")
        if _at(t, j).isspace():
            return j
    return i


def names_in(t: str) -> list[str]:
    """Names from left to right, each as long as it goes."""
    out, done = [], 0
    for m in _CAPITAL.finditer(t):
        if m.start() < done:
            continue
        i = _initial(t, m.end())
        if not _at(t, i).isspace():
            continue
        word = _CAPITAL.match(t, i + 1)
        if not word:
            continue
        while word:
            done = word.end()
            i = done + _at(t, done).isspace()
            word = _CAPITAL.match(t, i)
        out.append(t[m.start() : done])
    return out


def name_before(t: str, end: int, least: int) -> int | None:
    """The first place from `least` on where a name begins that goes up to `end`; spaces may stand before end."""
    i = end
    while i > least and t[i - 1].isspace():
        i -= 1
    starts: list[int] = []  # of capital words, the last one first
    while True:
        j = i
        while j > least and t[j - 1] in _LOWER:
            j -= 1
        if j == i or j <= least or t[j - 1] not in _UPPER:
            break
        starts.append(j - 1)
        i = j - 1
        if i > least and t[i - 1].isspace():
            i -= 1
    if not starts:
        return None
    first = starts[-1]
    # an initial and a word before the first of them
    i = first - 1
    if i > least and t[i].isspace():
        j = i - 1
        if t[j] == "." and j > least:
            j -= 1
        if t[j] in _UPPER and j - 1 > least and t[j - 1].isspace():
            k = e = j - 1
            while k > least and t[k - 1] in _LOWER:
                k -= 1
            if k < e and k > least and t[k - 1] in _UPPER:
                return k - 1
    # else the first word that a space divides from the next one
    for a, b in zip(reversed(starts), reversed(starts[:-1]), strict=False):
        if t[b - 1].isspace():
            return a
    return None


_AGE = re.compile(r",\s*(?:(?:age|Age|AGE)\s+)?\d\d\s*[,.]")


def aged(t: str) -> list[str]:
    """Names before a comma and an age of two digits."""
    out, done = [], 0
    for m in _AGE.finditer(t):
        start = name_before(t, m.start(), done)
        if start is not None:
            out.append(t[start : m.start()])
            done = m.end()
    return out


#: Words after the first (and an initial) that a name beside a title has at most.
BESIDE_TITLE = 3


def _words_before(t: str, end: int, least: int) -> int | None:
    """The first place from `least` on where words in any case begin that go up to `end`: one, an initial if there is one, one to three more."""
    i = end
    while i > least and t[i - 1].isspace():
        i -= 1
    best = None
    for _ in range(BESIDE_TITLE):
        j = i
        while j > least and t[j - 1] in _LETTERS:
            j -= 1
        if i - j < 2 or j <= least or not t[j - 1].isspace():
            break
        i = j - 1  # the space before this word
        for k in (i, _before_initial(t, i, least)):
            a = k
            while a > least and t[a - 1] in _LETTERS:
                a -= 1
            if k - a >= 2:
                best = a if best is None else min(best, a)
    return best


def _before_initial(t: str, i: int, least: int) -> int:
    """Where the space stands before a single letter (and a point) that ends at i; else i."""
    j = i - 1
    if j > least and t[j] == ".":
        j -= 1
    if j > least and t[j] in _LETTERS and t[j - 1].isspace():
        return j - 1
    return i


def before_titles(t: str, titles: re.Pattern | AnyCase) -> list[str]:
    """Words before signs and a title. titles: the signs, spaces and a title."""
    out, done = [], 0
    for m in titles.finditer(t):
        start = _words_before(t, m.start(), done)
        if start is not None:
            out.append(t[start : m.start()])
            done = m.end()
    return out


def after_titles(t: str, titles: re.Pattern | AnyCase) -> list[str]:
    """Words after a title and signs: one, an initial if there is one, one to three more. titles: a title, signs and spaces."""

    def word(i: int) -> int:
        j = i
        while _at(t, j) in _LETTERS and j < len(t):
            j += 1
        return j if j - i >= 2 else i

    out, done = [], 0
    for m in titles.finditer(t):
        i = m.end()
        end = word(i)
        if m.start() < done or end == i:
            continue
        at, n = _initial(t, end, _LETTERS), 0
        while n < BESIDE_TITLE and (n or _at(t, at).isspace()):
            begin = at + _at(t, at).isspace()
            e = word(begin)
            if e == begin:
                break
            at, n = e, n + 1
        if n:
            out.append(t[i:at])
            done = at
    return out


_INSIDE = _LETTERS | frozenset(".-' ")


def signed(t: str, marks: re.Pattern, stops: re.Pattern, shortest: int = 3, longest: int = 51) -> list[str]:
    """What stands between a mark and the first stop after it: an upper-case letter, then letters, points, hyphens, apostrophes and spaces."""
    out, at = [], 0
    while m := marks.search(t, at):
        i, at = m.end(), m.start() + 1
        if _at(t, i) in _UPPER and i < len(t):
            stop = stops.search(t, i + shortest)
            # a stop may stand at the text's end, too
            end = stop.start() if stop else len(t)
            if shortest <= end - i <= longest and all(c in _INSIDE for c in t[i + 1 : end]):
                out.append(t[i:end])
                at = end
    return out


def label(words: str) -> str:
    """Words with any white space between them."""
    return r"\s+".join(map(re.escape, words.split()))


def labelled(t: str, labels: Sequence[str], after: str = "\n\r:") -> Iterator[int]:
    """Places where the value of a label begins: past spaces with one of the signs of `after` among them. Labels count in any case; of several at a place the first."""
    pattern, done = re.compile("|".join(map(label, labels)), re.I), 0
    while m := pattern.search(t, done):
        i, sign = m.end(), False
        while i < len(t) and (t[i].isspace() or t[i] in after):
            sign |= t[i] in after
            i += 1
        done = m.end()
        if sign:
            yield i
            done = max(done, i)


def rest_of_line(t: str, i: int) -> str | None:
    """What follows up to the line's end, if it has one and something stands before it."""
    ends = [e for e in (t.find("\n", i + 1), t.find("\r", i + 1)) if e >= 0]
    return t[i : min(ends)] if ends and i < len(t) else None


def number(t: str, i: int) -> str | None:
    """Digits, with a point and more digits if there are any."""
    j = i
    while _at(t, j).isdigit() and t[j].isascii():
        j += 1
    if j == i:
        return None
    if _at(t, j) == ".":
        j += 1
        while _at(t, j).isdigit() and t[j].isascii():
            j += 1
    return t[i:j]
