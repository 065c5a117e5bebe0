"""Names as people type them: folding, words, weighted edit distance, symmetric-delete lookup, abbreviations."""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterable

# fixed values: words that carry no meaning in the name of a body
EMPTY_WORDS = set("of on for in the and a an to & de la".split())
VOWELS = set("aeiouy")

_word = re.compile(r"[^\W_]+(?:['’.](?=[^\W_])[^\W_]+)*[.'’]?")
_acronym = re.compile(r"(?:[^\W\d_]\.){3,}|[^\W\d_]{3,7}")


def fold(text: str | None) -> str:
    """Lower case, no accents, plain blanks and apostrophes."""
    t = unicodedata.normalize("NFKD", (text or "").replace("’", "'").replace("`", "'").replace("''", "'"))
    return re.sub(r"\s+", " ", "".join(c for c in t if not unicodedata.combining(c))).strip().lower()


def words(text: str) -> list[str]:
    """The words of a folded text; a full stop or an apostrophe inside marks an abbreviation and is kept."""
    out = []
    for w in _word.findall(text.replace("&", " and ")):
        w = re.sub(r"'s?$", "", w)
        if w.rstrip(".") and w.rstrip(".") not in EMPTY_WORDS:
            out.append(w)
    return out


def acronym_of(text: str) -> str:
    """The letters of a folded text that is nothing but an acronym, else ''."""
    t = re.sub(r"'s$", "", re.sub(r"^the ", "", text)).strip()
    return t.replace(".", "") if _acronym.fullmatch(t) else ""


def distance(a: str, b: str, most: float = 3.0) -> float:
    """Damerau-Levenshtein distance; a doubled letter, a swap or a vowel for a vowel is cheaper than other edits."""
    if a == b:
        return 0.0
    if abs(len(a) - len(b)) > most * 2:
        return most + 1
    two: list[float] = []
    one = [float(j) for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        row = [float(i)]
        for j, y in enumerate(b, 1):
            if x == y:
                best = one[j - 1]
            else:
                gone = 0.7 if i > 1 and a[i - 2] == x else 1.0
                come = 0.7 if j > 1 and b[j - 2] == y else 1.0
                swap = 0.8 if x in VOWELS and y in VOWELS else 1.0
                best = min(one[j] + gone, row[j - 1] + come, one[j - 1] + swap)
                if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                    best = min(best, two[j - 2] + 0.8)
            row.append(best)
        if min(row) > most:
            return most + 1
        two, one = one, row
    return one[-1]


def reach(word: str) -> int:
    """Edits allowed in a word of its length."""
    return 0 if len(word) < 4 else 1 if len(word) < 8 else 2


def deletes(word: str, depth: int) -> set[str]:
    """The word with up to ``depth`` letters left out."""
    out = last = {word}
    for _ in range(depth):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        out = out | last
    return out


class Lookup:
    """Symmetric-delete dictionary: words within a bounded edit distance of a query, without a scan."""

    def __init__(self, entries: Iterable[str]) -> None:
        self.entries = set(entries)
        self.index: dict[str, list[str]] = defaultdict(list)
        for w in sorted(self.entries):
            for d in deletes(w, reach(w)):
                self.index[d].append(w)
        self.seen: dict[str, list[tuple[str, float]]] = {}

    def near(self, word: str) -> list[tuple[str, float]]:
        """``(entry, distance)``, nearest first."""
        if word in self.seen:
            return self.seen[word]
        limit = reach(word)
        found = {e for d in deletes(word, limit) for e in self.index.get(d, ())}
        out = sorted(((e, dist) for e in found if (dist := distance(word, e)) <= min(limit, reach(e)) + 0.01), key=lambda x: (x[1], x[0]))
        if len(self.seen) > 200_000:
            self.seen.clear()
        self.seen[word] = out
        return out


def shortens(short: str, word: str) -> float:
    """How badly ``short`` abbreviates ``word``: 0.1 as its beginning, 0.2 with the same end, 0.4 else; 9 if not at all."""
    s = re.sub(r"[.']", "", short)
    if not 2 <= len(s) < len(word) or s[0] != word[0]:
        return 9.0
    if word.startswith(s):
        return 0.1
    at = iter(word)
    if not all(c in at for c in s):
        return 9.0
    return 0.2 if s[-1] == word[-1] else 0.4


def garbled(typed: str, word: str) -> float:
    """The cost of reading ``typed`` as ``word`` where other words already point to it; 9 if too far."""
    plain = re.sub(r"[.']", "", typed)
    d = distance(plain, word)
    if d <= max(1.0, 0.4 * len(word)):
        return d
    if typed != plain or len(plain) <= 5:
        # an abbreviation with one letter wrong or too many
        cost = min((shortens(plain[:i] + plain[i + 1 :], word) for i in range(1, len(plain))), default=9.0)
        if cost < 0.4 and len(plain) > 3:
            return 1.0 + cost
    return 9.0


class Vocabulary:
    """General words of names with their frequency, and what a typed word may stand for."""

    def __init__(self, frequency: dict[str, int]) -> None:
        self.frequency = frequency
        self.lookup = Lookup(frequency)
        self.by_letter: dict[str, list[str]] = defaultdict(list)
        for w in sorted(frequency):
            self.by_letter[w[0]].append(w)
        self.letters = [(w, frozenset(w)) for w in sorted(frequency, key=lambda w: (-len(w), w))]
        self.seen: dict[str, list[tuple[str, float]]] = {}

    def nearest(self, word: str) -> tuple[float, str]:
        """The least distance over length, and its word; a distance above 3 counts as 4. A word whose letters or length
        already cost too much is not compared."""
        letters, best = frozenset(word), (9.0, "")
        for w, own in self.letters:
            least = 0.7 * max(abs(len(word) - len(w)), len(letters - own), len(own - letters))
            if least > 3:
                best = min(best, (4 / len(w), w))
            elif least / len(w) <= best[0]:
                best = min(best, (distance(word, w) / len(w), w))
        return best

    def readings(self, word: str) -> list[tuple[str, float]]:
        """``(word, cost)`` of all readings, the best first; ties by frequency."""
        if word in self.seen:
            return self.seen[word]
        plain = re.sub(r"[.']", "", word)
        out: dict[str, float] = {}
        if plain in self.frequency:
            out[plain] = 0.0
        else:
            marked = plain != word
            if marked or len(plain) <= 5:
                for w in self.by_letter.get(plain[:1], ()):
                    if (cost := shortens(plain, w)) < 9 and (marked or cost <= 0.2):
                        out[w] = min(out.get(w, 9.0), cost)
            for w, d in self.lookup.near(plain):
                out[w] = min(out.get(w, 9.0), d)
        result = sorted(out.items(), key=lambda x: (x[1], -self.frequency[x[0]], x[0]))
        if len(self.seen) > 200_000:
            self.seen.clear()
        self.seen[word] = result
        return result
