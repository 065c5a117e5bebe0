"""Splitting oversized texts at natural boundaries by recursive bisection.

Boundaries, from the strongest: the opening of a numbered section, the start of a paragraph (after a blank line, or in
texts without blank lines after a line break), the start of a sentence, a blank. A span that exceeds the limit minus
the overlap is cut at the strongest boundary in its middle half, there at the one nearest to the midpoint; the halves
are treated alike; then each piece but the first is extended backwards by the overlap.

An opening stands alone on its line with a number and a heading, and text of its own follows. Entries of a table of
contents, mentions in running text and openings led by a quotation mark are none.

Defined results: a NULL text and one within the limit have no pieces in ``pieces`` with ``whole=False`` and one piece
otherwise (a NULL text none). Every piece names the sections that open in it. A text without any boundary is cut at the midpoint. Offsets count code points.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 6000, 300
HEADING_WORDS = 8

# fixed values: words that lead a numbered division, titles of a table of contents, number words, words before a mention
DIVISIONS = """section sec article art title part chapter clause titre chapitre partie artikel abschnitt kapitel teil titel
artículo articulo capítulo capitulo título titulo sección seccion parte cláusula clausula disposición disposicion
division schedule annex annexe anexo anlage paragraph paragraphe""".split()
CONTENTS = {
    "table of contents", "contents", "table des matières", "sommaire", "inhaltsverzeichnis", "inhaltsübersicht",
    "inhalt", "índice", "indice", "contenido", "tabla de contenido",
}
UNITS = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
FIRST = "premier première erster erste primero primera único unique".split()
BEFORE_MENTION = set("under see in of by to and or with per from voir selon de à nach gemäß gemäss según véase del conforme the la le der den".split())

_NUMBER_WORD = "|".join([*(f"{t}(?:-(?:{'|'.join(UNITS[:9])}))?" for t in TENS), *UNITS[::-1], *FIRST])
_NUMBER = rf"(?P<number>\d+(?:\.\d+)*(?:er|re)?[a-zA-Z]?(?:\.?[ªº°])?|[ivxlcdm]+|(?:{_NUMBER_WORD}))"
_LED = "|".join(sorted(DIVISIONS, key=len, reverse=True))
_OPENING = re.compile(
    rf"(?:#{{1,6}}[ \t]*(?:(?:{_LED})\.?[ \t]+)?|[\[(*]{{0,3}}(?:(?:{_LED})\.?[ \t\xa0]+|§{{1,2}}[ \t\xa0]*))"
    rf"{_NUMBER}(?![\w(])[\])*]{{0,3}}(?:[ \t\xa0]*[.:—–-]+)*[ \t\xa0]*(?P<heading>.*)",
    re.IGNORECASE,
)
_LINE = re.compile(r"[^\r\n]+")
_LEAD = re.compile(r"[\s﻿​-‏\x00-\x1f]*")
_ROMAN = dict(zip("ivxlcdm", (1, 5, 10, 50, 100, 500, 1000)))


def number_value(text: str) -> int | None:
    """The value of a section number in digits, Roman numerals or words."""
    t = text.lower()
    if m := re.match(r"\d+", t):
        return int(m[0])
    if t in UNITS:
        return UNITS.index(t) + 1
    if t in FIRST:
        return 1
    head, _, tail = t.partition("-")
    if head in TENS:
        return (TENS.index(head) + 2) * 10 + (UNITS.index(tail) + 1 if tail else 0)
    if set(t) <= set(_ROMAN):
        values = [_ROMAN[c] for c in t]
        return sum(-v if i + 1 < len(values) and v < values[i + 1] else v for i, v in enumerate(values))
    return None


def _opening(line: str) -> tuple[bool, int | None]:
    """Whether a line looks like an opening; its number."""
    m = _OPENING.match(line)
    if not m:
        return False, None
    heading = m["heading"].strip().rstrip(".:—–- *").strip()
    first = heading[:1]
    if not (first.isupper() or first == "¿") or len(heading.split()) > HEADING_WORDS or re.search(r"[.;:!?]\s|\d|,$", heading):
        return False, None
    return True, number_value(m["number"])


def openings(text: str) -> list[int]:
    """Offsets of the openings of numbered sections, in order."""
    lines: list[tuple[int, bool, int | None, str]] = []
    for m in _LINE.finditer(text):
        lead = _LEAD.match(text, m.start(), m.end()).end()
        line = text[lead : m.end()].rstrip()
        if line:
            is_opening, number = _opening(line) if len(line) <= 160 else (False, None)
            lines.append((lead, is_opening, number, line))
    out: list[int] = []
    in_contents, run = False, []
    for i, (at, is_opening, number, line) in enumerate(lines):
        if not is_opening:
            in_contents, run = line.lower().rstrip(":") in CONTENTS, []
            continue
        run.append(number)
        if i + 1 == len(lines) or lines[i + 1][1]:
            continue
        if in_contents and (len(run) == 1 or (number is not None and run[-2] is not None and number > run[-2])):
            continue  # the last entry of a table of contents, before other text
        if i and not lines[i - 1][1] and lines[i - 1][3].rsplit(None, 1)[-1].lower() in BEFORE_MENTION:
            continue
        out.append(at)
    return out


def boundaries(text: str) -> list[list[int]]:
    """Offsets of the boundaries of each strength, from the strongest."""
    blank = [m.end() for m in re.finditer(r"(?:\r\n|\n|\r)[^\S\r\n]*(?:\r\n|\n|\r)\s*", text)]
    lines = [m.end() for m in re.finditer(r"(?:\r\n|\n|\r)\s*", text)]
    sentences = [m.end() for m in re.finditer(r"[.!?;…][\"”»)\]]*\s+(?=[\"“«(\[]*[^\Wa-z_])", text)]
    return [openings(text), blank or lines, lines, sentences, [m.end() for m in re.finditer(r"\s+", text)]]


def cuts(text: str, limit: int = LIMIT, overlap: int = OVERLAP, kinds: list[list[int]] | None = None) -> list[int]:
    """Offsets where ``text`` is cut, in order; ``kinds`` are its boundaries, if known."""
    if len(text) <= limit:
        return []
    kinds = kinds or boundaries(text)
    out: list[int] = []
    spans = [(0, len(text))]
    while spans:
        start, end = spans.pop()
        size = end - start
        if size <= limit - overlap:
            continue
        middle, low, high = start + size // 2, start + size // 4, end - size // 4
        for at in kinds:
            i, j = bisect_left(at, max(low, start + 1)), bisect_right(at, min(high, end - 1))
            if i < j:
                k = bisect_left(at, middle, i, j)
                near = [at[x] for x in (k - 1, k) if i <= x < j]
                cut = min(near, key=lambda x: (abs(x - middle), x))
                break
        else:
            cut = middle
        out.append(cut)
        spans += [(start, cut), (cut, end)]
    return sorted(out)


def pieces(df: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP, whole: bool = False, texts: bool = True) -> DataFrame:
    """``(key, piece, char_start, char_end, openings, text)``: ordered pieces of at most ``limit`` characters.

    Each piece but the first begins with the last ``overlap`` characters of the one before it. ``openings`` are the
    offsets in the whole text of the sections that open in the piece, each in the piece that has it beyond its overlap.
    ``texts=False`` leaves the texts of the pieces out.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be less than the limit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, number, starts, ends, found, parts, size = [], [], [], [], [], [], 0
            for i, t in enumerate(batch.column(1).to_pylist()):
                kinds = boundaries(t) if len(t) > limit else [openings(t)]
                edges = [0, *cuts(t, limit, overlap, kinds), len(t)]
                for n, (a, b) in enumerate(zip(edges, edges[1:])):
                    start = max(0, a - overlap) if n else 0
                    owner.append(i)
                    number.append(n)
                    starts.append(start)
                    ends.append(b)
                    found.append(kinds[0][bisect_left(kinds[0], a) : bisect_left(kinds[0], b)])
                    parts.append(t[start:b] if texts else None)
                    size += b - start
                if size > 4_000_000:
                    yield made(batch, owner, number, starts, ends, found, parts)
                    owner, number, starts, ends, found, parts, size = [], [], [], [], [], [], 0
            if owner:
                yield made(batch, owner, number, starts, ends, found, parts)

    def made(batch: pa.RecordBatch, owner: list[int], number: list[int], starts: list[int], ends: list[int], found: list[list[int]], parts: list[str | None]) -> pa.RecordBatch:
        whole_numbers = [pa.array(x, pa.int64()) for x in (number, starts, ends)]
        cols = [batch.column(0).take(pa.array(owner, pa.int64())), *whole_numbers, pa.array(found, pa.list_(pa.int64())), pa.array(parts, pa.string())]
        return pa.RecordBatch.from_arrays(cols, ["key", "piece", "char_start", "char_end", "openings", "text"])

    src = df.select(key, text).where(F.col(text).isNotNull() if whole else F.length(text) > limit)
    kind = df.select(key).schema[0].dataType.simpleString()
    out = src.mapInArrow(run, f"key {kind}, piece bigint, char_start bigint, char_end bigint, openings array<bigint>, text string")
    out = out.withColumnRenamed("key", key)
    return out if texts else out.drop("text")


def section_openings(df: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """``(key, char_start)`` of the section openings, the strongest boundaries, in the pieces of every text above the limit."""
    return pieces(df, key, text, limit, overlap, texts=False).select(key, F.explode("openings").alias("char_start"))
