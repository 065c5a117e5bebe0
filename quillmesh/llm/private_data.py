"""Personal information inside free text: found, typed, and replaced by placeholders.

Bootstrapped contextual extraction:

1. A first pass over all texts notes every stretch that could be personal data (numbers of seven and more digits; runs
   of capitalised words; words around an @ or a word in brackets; what leads up to a postal code) as an edge from its
   context (words before and after it) to its instance (the shape of a number or an address, the last word of a name,
   what stands for the @), with the count of seeds: numbers with a cue word just before or a country prefix, names
   after a form of address, mail with a plain @, addresses with a word for a street.
2. Spark scores the pattern-instance graph in rounds: an instance by its seeds and by its patterns, a pattern by its
   instances. Patterns, shapes and name words that reach the threshold become the model. Of each list a fixed number,
   the most frequent, is broadcast; the rest, if there is any, is joined to the texts that hold one of its entries.
3. A second pass applies the model: known patterns discover instances never seen with a seed, known name words are
   found in contexts of their own, and lower-case names are found between known patterns. Mail written with another
   sign for the @ and addresses of another form than the seeds' are found by learned signs, forms and contexts.

Defined results: a NULL or empty text has no finds and is returned as it is. Finds do not overlap; where two meet the
order is email, address, phone and id, name. Offsets count code points.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.session import materialize

ROUNDS = 3
SCORE = 0.7
TRIGGER = 0.3
SUPPORT = 3
LISTED = 50_000

# fixed values: forms of address, particles inside names, cue words of seeds, words that never belong to a name
ADDRESS_FORMS = set("mr mrs ms miss dr prof mme mlle mm herr herrn frau sr sra srta dra señor señora monsieur madame".split())
PARTICLES = set("von van zu de del la las los du des der den le da di y".split())
PHONE_CUES = set("phone telephone tel fax mobile téléphone telefon teléfono".split())
ID_CUES = set("ssn security passport tax id sociale identidad identifiant kennung steuernummer".split())
AT_CUES = set("at arroba".split())
BODY_WORDS = set(
    """board agency authority directorate department commission federation laboratory institute center centre council bureau
    office program programme act committee ministry society association university college school bank fund street road
    avenue court lane boulevard terrace square union company corporation administration service court library panel""".split()
)
NOT_NAMES = set(
    """the a an each every any all no not as in on at by for from of to with under over this that these those if where when
    while before after upon such both he she it they we you i his her its their who which and or but nor so than then there
    here may must shall should will can is are was were be been being has have had do does did section article part title
    chapter clause le la les un une des du de et ou si par pour dans sur sous avec sans ce cette ces il elle tout toute tous
    der die das ein eine einer und oder wenn nach vor mit ohne im in am zum zur bei auf aus von jede jeder jedes alle es
    el los las una unos unas y o si por para en con sin sobre este esta estos cada todo toda al del lo su sus
    secretary director administrator comptroller secretariat state states docket form doc no nr bl""".split()
)
CUES = 5

_NUMBER = re.compile(r"\d(?:[() ./\-\xa0\r\n]*\d){6,}")
_LEAD = re.compile(r"(?:\(?\+|\(|(?<![A-Za-z])[A-Z]{1,2})$")
_NUMBER_FORM = re.compile(
    r"(?:\(?\+\d{1,3}\)?[ .\-\xa0]?|(?<![\w])[A-Z]{1,2}(?=\d{6}))?(?:\(\d{1,5}\)[ .\-\xa0]?)?\d+(?:(?:[ .\-/\xa0]|\r?\n)\d+)*(?:-?[A-Z](?![\w]))?"
)
_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]")
_CAP = r"[A-ZÀ-ÖØ-Þ][^\W\d_]*+(?:['’-][^\W\d_]++)*"
_ONE = rf"(?:(?:[A-ZÀ-ÖØ-Þ]|Mrs?|Ms|Dra?|Prof|Sra?|Srta|Mme|Mlle|MRS?|MS|DRA?|SRA?|SRTA)\.(?=\s)|{_CAP})"
_GAP = r"(?:[ \xa0]|\r?\n[ \t]*)"
_NEXT = rf"{_GAP}(?:(?:von|van|zu|de|del|la|las|los|du|der|le){_GAP}){{0,2}}{_ONE}"
# two words and more, or one before a comma; that it begins with a plain set of letters lets the scan skip to them, and
# that no letter is given back ends it soon where a word stands alone
_RUN = re.compile(
    r"[A-ZÀ-ÖØ-Þ](?<![\w@'’.-].)"
    r"(?:(?:(?<=M)(?:rs?|s|me|lle|RS?|S)|(?<=D)(?:ra?|RA?)|(?<=P)rof|(?<=S)(?:ra?|rta?|RA?|RTA)|)\.(?=\s)|[^\W\d_]*+(?:['’-][^\W\d_]++)*+)"
    rf"(?=[ \xa0\r\n,])(?:(?:{_NEXT})+(?![\w@])|(?![\w@])(?=,))"
)
_COMMA_FIRST = re.compile(rf",{_GAP}({_CAP}(?:{_GAP}[A-ZÀ-ÖØ-Þ]\.)?)(?=\s*[,;.:)(]|{_GAP}[a-zà-ÿ(])")
_PARTED = re.compile("['’-]")
_SPACED = re.compile(r"\S+")
_ANY = r"(?:[^\W\d_](?:\.|[^\W\d_]*(?:['’-][^\W\d_]+)*))"
_LOWER = re.compile(rf"{_GAP}?({_ANY}(?:,?{_GAP}{_ANY}){{1,3}})")
_LOWER_BEFORE = re.compile(rf"(?<![\w'’-])({_ANY}(?:,?{_GAP}{_ANY}){{1,3}}){_GAP}?$")
_NAME_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_ODD = re.compile(r"[^\x00-\x7f\w]|[^\x00-\x7f\D]")
_ASCII_RUN = re.compile(rb"[A-Za-z]+")
_IS_LETTER = bytes(i < 128 and chr(i).isalpha() for i in range(256))
_LETTERS = bytes(i if i > 127 or chr(i).isalpha() else 32 for i in range(256))
_LOWER_INITIAL = re.compile(rf"\.(?<=[^\W\d_A-Z].)(?<!\w..)(?:{_GAP}[^\W\d_]\.)*(?:{_GAP}({_NAME_WORD.pattern}))?")
_ANY_INITIAL = re.compile(r"\.(?<=[^\W\d_].)(?<!\w..)")
_BEFORE_INITIAL = re.compile(rf"({_NAME_WORD.pattern}),{_GAP}$")
_NEXT_NAME = re.compile(rf"(?:,|;|{_GAP}(?:and|et|und|y)){_GAP}")


def _fold(tokens: list[str]) -> list[str]:
    return ["9" if t.isdigit() else t.lower() for t in tokens]


_SHAPED = {i: "9" if chr(i).isdigit() else "A" for i in range(128) if chr(i).isalnum()}


def shape(number: str) -> str:
    """Digits as 9, letters as A, blanks as one."""
    plain = " ".join(number.split())
    return plain.translate(_SHAPED) if plain.isascii() else re.sub(r"[A-Za-z]", "A", re.sub(r"\d", "9", plain))


class Candidate(NamedTuple):
    start: int
    end: int
    instance: str
    patterns: list[str]
    seed: str


def _sides(text: str, start: int, end: int, floor: int = 0) -> tuple[list[str], list[str]]:
    """The last two tokens before and the first two after; ``floor`` is the end of a name just before, written <n>."""
    left = _before(text, max(floor, start - 32), start, 3)
    if floor and len(left) < 2 and floor >= start - 32:
        left.insert(0, "<n>")
    return left, _after(text, end, end + 24)


def _before(text: str, start: int, end: int, most: int) -> list[str]:
    """The last folded tokens of a window."""
    out: list[str] = []
    for w in reversed(text[start:end].rsplit(None, most)):
        if w.isalpha():
            out.append(w.lower())
        elif w[:-1].isalpha() and not (w[-1].isalnum() or w[-1] == "_"):
            out += w[-1], w[:-1].lower()
        else:
            out += reversed(_fold(_TOKEN.findall(w)))
        if len(out) >= most:
            break
    return out[most - 1 :: -1] if len(out) > most else out[::-1]


def _after(text: str, start: int, end: int) -> list[str]:
    """The first two folded tokens of a window."""
    out: list[str] = []
    for w in text[start:end].split(None, 2)[:2]:
        if w.isalpha():
            out.append(w.lower())
        elif w[1:].isalpha() and not (w[0].isalnum() or w[0] == "_"):
            out += w[0], w[1:].lower()
        else:
            return _fold(_TOKEN.findall(text, start, end)[:2])
        if len(out) > 1:
            break
    return out[:2]


def _cue(tokens: list[str]) -> str:
    """The kind of the nearest cue word among the last ``CUES`` tokens of the clause."""
    for t in reversed(tokens):
        if t in ID_CUES:
            return "id"
        if t in PHONE_CUES:
            return "phone"
        if t in ";!?9":
            break
    return ""


def numbers(text: str) -> Iterator[Candidate]:
    """Stretches of at least seven digits, as a whole."""
    at = 0
    for m in _NUMBER.finditer(text):
        start = m.start()
        if start < at:
            continue
        lead = _LEAD.search(text[max(0, start - 3) : start])
        begin = start - len(lead[0]) if lead else start
        while begin < m.end():
            form = _NUMBER_FORM.match(text, begin)
            if not form:
                begin += 1
                continue
            s, e = form.span()
            value = form[0]
            if e - s >= 7 and sum(map(str.isdigit, value)) >= 7 and not (s and (text[s - 1].isalnum() or text[s - 1] in "$€")) and not text[e : e + 1].isalnum():
                if value[0] == "(" and value.count("(") > value.count(")"):
                    s, value = s + 1, value[1:]
                left = _before(text, max(0, s - 32), s, 3)
                seed = "phone" if value.lstrip("(").startswith("+") else _cue(_before(text, max(0, s - 60), s, CUES))
                patterns = [" ".join(left), f"{left[1]} {left[2]}", left[2]] if len(left) == 3 else list(dict.fromkeys(" ".join(left[-k:]) for k in (3, 2, 1)))
                yield Candidate(s, e, shape(value), patterns, seed)
            begin = at = max(e, begin + 1)
            while begin < m.end() and not (text[begin].isdigit() or text[begin] in "+("):
                begin += 1


class Run(NamedTuple):
    """Capitalised words without forms of address and function words around them."""

    start: int
    end: int
    words: list[str]
    seed: bool  # a form of address leads
    opens: bool  # begins a sentence
    floor: int  # end of a run just before, or 0


def _stops(word: str) -> bool:
    return word.lower() in NOT_NAMES


def _line_breaks(text: str, run: re.Match) -> list[int]:
    """Line ends inside a run that end a short line, such as a heading; a run goes on over the end of a wrapped line.
    Offsets in the run."""
    out = []
    at = text.find("\n", run.start(), run.end())
    while at >= 0:
        if at - max(text.rfind("\n", 0, at), text.rfind("\r", 0, at - 1)) < 50:
            out.append(at - run.start())
        at = text.find("\n", at + 1, run.end())
    return out


def _inner(text: str, r: Run) -> Run | None:
    """The run without the word that opens its sentence."""
    words = r.words[1:]
    at = r.start + len(r.words[0])
    while words and words[0].lower() in PARTICLES:
        at = text.index(words[0], at) + len(words[0])
        words = words[1:]
    return r._replace(words=words, start=text.index(words[0], at), opens=False, floor=0) if words else None


_SPECIAL = NOT_NAMES | ADDRESS_FORMS | BODY_WORDS


# the parts of runs on one line, which depend on nothing else; of French texts apart; long runs are not kept
_READ: tuple[dict[str, list], dict[str, list]] = ({}, {})
_READ_MOST = 50_000


def runs(text: str, french: bool) -> Iterator[Run]:
    previous, read = 0, _READ[french]
    for m in _RUN.finditer(text):
        whole = m[0]
        parts = read.get(whole)
        if parts is None:
            if "\n" in whole or len(whole) > 100:
                parts = _read(whole, _line_breaks(text, m), french)
            else:
                if len(read) >= _READ_MOST:
                    read.clear()
                parts = read[whole] = _read(whole, (), french)
        if parts:
            at = m.start()
            for start, end, part, seed, first in parts:
                opens = False
                if first and not seed:
                    head = text[max(0, at - 3) : at].rstrip(" \t\xa0")
                    opens = not head or head[-1] in ".!?;\n\r…”" or not head[-1].isalnum() and head[-1] not in ",:-–—("
                start += at
                yield Run(start, at + end, part, seed, opens, previous if previous > start - 12 else 0)
                previous = at + end


def _read(whole: str, breaks: Sequence[int], french: bool) -> list[tuple[int, int, list[str], bool, bool]]:
    """The parts of a run, with offsets in it."""
    lows = whole.lower().split()
    if "." in whole:
        lows = [w.rstrip(".") for w in lows]
    plain = "\n" not in whole and not (french and "m" in lows)
    if plain and _SPECIAL.isdisjoint(lows):
        return [(0, len(whole), whole.split(), False, True)]
    if whole.lower() in NOT_NAMES:
        return []  # the first half of "Last, First" is no function word
    if plain and NOT_NAMES.isdisjoint(lows) and ADDRESS_FORMS.isdisjoint(lows) and not BODY_WORDS.isdisjoint(lows):
        return []  # one part, which names a body
    return list(_parts(whole, breaks, french))


def _parts(whole: str, breaks: Sequence[int], french: bool) -> Iterator[tuple[int, int, list[str], bool, bool]]:
    """A run cut at forms of address, function words and ends of short lines; parts that name a body are left out."""
    seed, opened, part = False, True, []
    parts: list[tuple[list[tuple[int, str]], bool, bool]] = []
    for w in [(w.start(), w[0]) for w in _SPACED.finditer(whole)]:
        if part and breaks and any(part[-1][0] < b < w[0] for b in breaks):
            parts.append((part, seed, opened))
            seed, part = False, []
        form = w[1].rstrip(".").lower() in ADDRESS_FORMS or (w[1] == "M." and french and not part)
        if form or w[1][0].isupper() and _stops(w[1]):
            if part:
                parts.append((part, seed, opened))
            seed, opened, part = form, opened and not parts and not part and not form, []
        else:
            part.append(w)
    if part:
        parts.append((part, seed, opened))
    for part, seed, first in parts:
        while part and not seed and part[0][1].lower() in PARTICLES:
            part = part[1:]
        while part and part[-1][1].lower() in PARTICLES:
            part = part[:-1]
        if part and (seed or not any(w.lower() in BODY_WORDS for _, w in part)):
            yield part[0][0], part[-1][0] + len(part[-1][1]), [w for _, w in part], seed, first


def _last(word: str) -> str:
    low = word.lower()
    if "'" in low or "’" in low:
        low = re.sub("^(?:o|d)['’]", "", low.removesuffix("'s").removesuffix("’s"))
    return low


def _name_patterns(left: list[str], right: list[str]) -> list[str]:
    if len(left) > 1 and len(right) > 1:  # no two are alike
        l1, r1 = left[-1], right[0]
        l2, r2 = f"{left[-2]} {l1}", f"{r1} {right[1]}"
        return [f"{l2}|", f"|{r2}", f"{l2}|{r1}", f"{l1}|{r2}"]
    l2, l1, r1, r2 = " ".join(left[-2:]), " ".join(left[-1:]), " ".join(right[:1]), " ".join(right)
    out = [f"{l2}|", f"|{r2}", f"{l2}|{r1}", f"{l1}|{r2}"]
    return [p for p in dict.fromkeys(out) if p.strip("|")]


def _patterns(text: str, r: Run) -> list[str]:
    return _name_patterns(*_sides(text, r.start, r.end, r.floor))


def _matched(text: str, r: Run, model: Model, known: bool) -> list[str]:
    """The patterns of a run that the model has; where no word of the run is known, those with a word before it."""
    if not known and r.floor < r.start - 32 and "".join(_before(text, max(0, r.start - 32), r.start, 1)) not in model.lefts:
        return []
    return [p for p in _patterns(text, r) if p in model.patterns]


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(group, pattern, instance, kind of seed or '', n) and, as group ``full``, first and last words of names."""
    seen: dict[tuple[str, str, str, str], int] = defaultdict(int)

    def flush() -> pa.RecordBatch:
        keys = list(seen)
        cols = [pa.array([k[i] for k in keys], pa.string()) for i in range(4)] + [pa.array(list(seen.values()), pa.int64())]
        seen.clear()
        return pa.RecordBatch.from_arrays(cols, ["grp", "pattern", "instance", "seed", "n"])

    for batch in batches:
        for text, lang in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            for c in numbers(text):
                for p in c.patterns:
                    seen["num", p, c.instance, c.seed] += 1
            for group, found in (("at", mails(text)), ("place", places(text))):
                for c in found:
                    for p in c.patterns:
                        seen[group, p, c.instance, c.seed] += 1
            for r in runs(text, (lang or "").lower().startswith("fr")):
                if len(r.words) == 1 and (r.opens or len(r.words[0]) < 3):
                    continue
                last, seed = _last(r.words[-1]), "name" if r.seed else ""
                # the word that opens a sentence may be the context of the name or its first word
                for each in (r, _inner(text, r)) if r.opens else (r,):
                    if each is None:
                        continue
                    for p in _patterns(text, each):
                        seen["name", p, last, seed] += 1
                    if len(each.words) > 1 and not r.seed:
                        seen["full", each.words[0].lower(), last, "" if each.opens else "name"] += 1
            if len(seen) > 200_000:
                yield flush()
    yield flush()


def score_graph(edges: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """Scores ``(id, total, a, b)`` of the patterns and of the instances of a graph ``(pid, iid, n, a, b, weight)``.

    ``a`` and ``b`` are the seeds of the kinds of a group. Only ids and numbers travel in the rounds.
    """
    # a name word has few of its mentions after a form of address, a number shape has many beside a cue
    by_seed = lambda k: F.least(F.lit(1.0), F.first("weight") * F.sum(k) / F.sum("n"))
    seeded = materialize(edges.groupBy("iid").agg(F.sum("n").alias("total"), by_seed("a").alias("sa"), by_seed("b").alias("sb")), "seeds")
    instances = seeded.select("iid", "total", F.col("sa").alias("a"), F.col("sb").alias("b"))
    graph = edges.select("pid", "iid", "n")
    mean = lambda k: (F.sum(F.col("n") * F.col(k)) / F.sum("n")).alias(k)
    for i in range(rounds):
        patterns = materialize(graph.join(instances.select("iid", "a", "b"), "iid").groupBy("pid").agg(F.sum("n").alias("total"), mean("a"), mean("b")), "patterns")
        if i + 1 < rounds:
            found = graph.join(patterns.select("pid", "a", "b"), "pid").groupBy("iid").agg(mean("a"), mean("b"))
            instances = seeded.join(found, "iid").select("iid", "total", F.greatest("sa", "a").alias("a"), F.greatest("sb", "b").alias("b"))
    return patterns.withColumnRenamed("pid", "id"), materialize(instances, "instances").withColumnRenamed("iid", "id")


class Model(NamedTuple):
    contexts: dict[str, tuple[float, float]]
    shapes: dict[str, tuple[float, float]]
    patterns: frozenset[str]
    first: frozenset[str]
    last: frozenset[str]
    before: frozenset[str]
    after: frozenset[str]
    signs: frozenset[str] = frozenset()  # what stands for the @
    mailed: frozenset[str] = frozenset()  # contexts of mail
    forms: frozenset[str] = frozenset()  # shapes of addresses
    placed: frozenset[str] = frozenset()  # contexts of addresses
    lefts: frozenset[str] = frozenset()  # the word before a name in its patterns, '' in those without one
    given: frozenset[bytes] = frozenset()  # the first part of every given name


class _Both:
    """A list of the model with further entries."""

    def __init__(self, head, more) -> None:
        self.head, self.more = head, more

    def __contains__(self, k: str) -> bool:
        return k in self.head or k in self.more

    def __getitem__(self, k: str):
        return self.head[k] if k in self.head else self.more[k]

    def get(self, k: str, default):
        return self[k] if k in self else default


def _model(entries: list[tuple[str, str, int, float, float]]) -> Model:
    """From ``(list, entry, total, score, score)``."""
    of = lambda kind: [e for e in entries if e[0] == kind]
    # words of a name confirm what a literal context only suggests
    patterns = frozenset(p for _, p, _, a, _ in of("pattern") if a >= SCORE)
    literal = [p for _, p, n, _, _ in of("pattern") if n >= 20 and re.search(r"[^\W\d_]{2}", p) and "<n>" not in p]
    return Model(
        {p: (a, b) for _, p, _, a, b in of("context")},
        {p: (a, b) for _, p, _, a, b in of("shape")},
        patterns,
        frozenset(p for _, p, *_ in of("first")),
        frozenset(p for _, p, *_ in of("last")),
        frozenset(p[:-1] for p in literal if p.endswith("|")),
        frozenset(p[1:] for p in literal if p.startswith("|")),
        *(frozenset(p for _, p, *_ in of(kind)) for kind in ("sign", "mailed", "form", "placed")),
        frozenset(p.partition("|")[0].rpartition(" ")[2] for p in patterns),
        frozenset(_PARTED.split(p)[0].encode() for _, p, *_ in of("first")),
    )


def _looked_up(text: str, french: bool) -> set[tuple[str, str]]:
    """``(list, entry)`` of all that ``find`` may ask of a model for this text."""
    out = set()
    for c in numbers(text):
        out |= {("context", p) for p in c.patterns} | {("shape", c.instance)}
    for c in mails(text):
        out |= {("mailed", p) for p in c.patterns} | {("sign", c.instance)}
    for c in places(text):
        out |= {("placed", p) for p in c.patterns} | {("form", c.instance)}
    for r in runs(text, french):
        for each in (r, _inner(text, r)):
            if each is not None:
                out |= {("pattern", p) for p in _patterns(text, each)}
    for m in _NAME_WORD.finditer(text):
        low = _last(m[0])
        out |= {("first", m[0].lower()), ("last", low)} | {("last", p) for p in low.split("-")}
    tokens = _fold(_TOKEN.findall(text))
    for p in {*tokens, *map(" ".join, zip(tokens, tokens[1:]))}:
        out |= {("pattern", p + "|"), ("pattern", "|" + p)}
    return out


def learn(df: DataFrame, key: str, text: str, lang: str) -> tuple[Model, DataFrame | None]:
    """The model of a corpus with the ``LISTED`` most frequent entries of each list, and the rest or None.

    The rest has ``(list, entry, total, a, b)``.
    """
    src = df.select(key, text, lang).where(F.length(text) > 0)
    raw = src.mapInArrow(_edges, "grp string, pattern string, instance string, seed string, n bigint")
    seeds = lambda *kinds: F.sum(F.when(F.col("seed").isin(*kinds), F.col("n")).otherwise(0))
    edges = raw.groupBy("grp", "pattern", "instance").agg(F.sum("n").alias("n"), seeds("phone", "name", "email", "address").alias("a"), seeds("id").alias("b"))
    weight = F.when(F.col("grp") == "name", 20.0).otherwise(2.0)
    edges = materialize(edges.select("*", F.xxhash64("grp", "pattern").alias("pid"), F.xxhash64("grp", "instance").alias("iid"), weight.alias("weight")), "edges")
    graph = edges.where("grp <> 'full'")
    patterns, instances = score_graph(graph)

    def named(scores: DataFrame, group: str, side: str, least: float, support: int) -> DataFrame:
        """``(entry, total, a, b)`` of a group; the strings come back for what is kept only."""
        kept = scores.where((F.greatest("a", "b") >= least) & (F.col("total") >= support))
        strings = graph.where(F.col("grp") == group).select(F.col("pid" if side == "pattern" else "iid").alias("id"), F.col(side).alias("entry"))
        return strings.join(kept, "id", "left_semi").distinct().join(kept, "id").select("entry", "total", "a", "b")

    last = materialize(named(instances, "name", "instance", 0.5, 5), "last")  # more than one mention: each has up to four edges
    full = edges.where("grp = 'full'")
    first = (
        full.join(last.select(F.col("entry").alias("instance"), F.lit(1).alias("known")), "instance", "left")
        .groupBy("pattern")
        .agg(F.sum("n").alias("total"), (F.sum(F.when(F.col("known") == 1, F.col("n")).otherwise(0)) / F.sum("n")).alias("share"), (F.sum("a") / F.sum("n")).alias("inside"))
        # a word that mostly opens sentences is no given name; initials need no list
        .where((F.col("share") >= 0.5) & (F.col("inside") >= 0.3) & (F.col("total") >= 2) & ~F.col("pattern").rlike(r"^.\.?$"))
    )
    lists = {
        "context": named(patterns, "num", "pattern", 0.0, SUPPORT),
        "shape": named(instances, "num", "instance", 0.0, 0),
        "pattern": named(patterns, "name", "pattern", TRIGGER, SUPPORT),
        "first": first.select("pattern", "total", F.lit(0.0), F.lit(0.0)),
        "last": last,
        "sign": named(instances, "at", "instance", SCORE, 0),
        "mailed": named(patterns, "at", "pattern", SCORE, SUPPORT),
        "form": named(instances, "place", "instance", SCORE, SUPPORT),
        "placed": named(patterns, "place", "pattern", SCORE, SUPPORT),
    }
    entries, rest = [], None
    for kind, rows in lists.items():
        rows = rows.toDF("entry", "total", "a", "b")
        head = rows.orderBy(F.desc("total"), "entry").limit(LISTED + 1).collect()
        if len(head) > LISTED:
            end = head[LISTED - 1]
            more = rows.where((F.col("total") < end.total) | (F.col("total") == end.total) & (F.col("entry") > end.entry))
            more = more.select(F.lit(kind).alias("list"), "entry", "total", "a", "b")
            rest = more if rest is None else rest.unionByName(more)
        entries += [(kind, *r) for r in head[:LISTED]]
    return _model(entries), rest


_AT = re.compile(r"[@\[({<](?:(?<=@)|(?<!@)\s?([^\W\d_]{1,8})\s?[\])}>])")
_LOCAL = re.compile(r"[\w.+%'-]*[\w+%-]\s?$")
_DOMAIN = re.compile(r"\s?(?:[\w-]+(?:\.|\s?[\[({<]\s?(?:dot|punto|point|punkt)\s?[\])}>]\s?))+[^\W\d_]{2,}", re.I)


def mails(text: str) -> Iterator[Candidate]:
    """Stretches with an @, or with a word in brackets between what may be the two halves of a mail address."""
    for m in _AT.finditer(text):
        if not (domain := _DOMAIN.match(text, m.end())):
            continue
        if local := _LOCAL.search(text, max(0, m.start() - 80), m.start()):
            start, sign = local.start(), (m[1] or "@").lower()
            while text[start] in ".'":
                start += 1
            left = _fold(_TOKEN.findall(text, max(0, start - 32), start)[-2:])
            patterns = [f"{' '.join(left)}|", f"|{domain[0].rpartition('.')[2].lower()}"]
            yield Candidate(start, domain.end(), sign, patterns, "email" if sign == "@" or sign in AT_CUES else "")


def emails(text: str, model: Model | None = None) -> Iterator[tuple[int, int]]:
    """Mail with a plain sign, a learned one, or in a context of mail."""
    for c in mails(text):
        if c.seed or model and (c.instance in model.signs or c.patterns[0] in model.mailed):
            yield c.start, c.end


# fixed values: words of streets and of parts of a building
_UNIT = r"(?:#[ ]?\w+|(?:Apt|Apartment|Suite|Ste|Unit|Floor|Fl|Room|Rm)\.?\s*#?\w+)"
_US = re.compile(
    rf"(?<![\w#.,/-])\d{{1,6}}[A-Za-z]?\s+(?:(?:[NSEW]\.?|North|South|East|West)\s+)?(?:[^\W\d_][\w'’-]*\.?\s+){{0,4}}[^\W\d_][\w'’-]*\.?"
    rf"(?:,?\s+{_UNIT})?,\s+(?:[^\W\d_][\w'’-]*\s+){{0,2}}[^\W\d_][\w'’-]*,?\s+[A-Z]{{2}},?\s+$",
    re.I,
)
_FR = re.compile(
    r"(?<![\w/-])\d{1,4}(?:\s?(?:bis|ter|quater))?,?\s+(?:rue|avenue|av\.|bd|boulevard|quai|impasse|place|allée|chemin|cours|route|square|passage)"
    r"\s[^\d;:.\n]{2,60}?,\s+(?:[A-Z]-)?$",
    re.I,
)
_ES = re.compile(
    r"(?<!\w)(?:C/|Calle|Avda\.?|Avenida|Plaza|Pza\.?|Paseo|Camino|Ronda|Carretera|Travesía)\s[^\d;:.\n]{2,60}?,?\s+(?:n\.?º\s*)?\d{1,4}\w?"
    r"(?:,\s+(?:bajo|ático|\d{1,2}\.?[ºª°]?\s*\w{0,4}))?,\s+(?:[A-Z]-)?$",
    re.I,
)
_DE = re.compile(r"(?<!\w)(?:[A-ZÄÖÜ][\w.’'-]*\s+){1,3}\d{1,4}\s?[a-z]?,\s+(?:[A-Z]-)?$")
_CODE = re.compile(r"\d\d{4,}(?:-\d{4})?")
_BREAKS = set("./-")
_PLACE = re.compile(r"(?<!\w)(?:\d{1,6}\w?|[A-ZÀ-ÖØ-Þ][\w.’'-]*)(?:[ ,\xa0]+(?:\d[\w.º#/-]*|[A-ZÀ-ÖØ-Þ][\w.’'-]*|#\w+|de|la|las|los|el|du|des|le|del|bis|ter))*,?\s+(?:[A-Z]-)?$")
_TOWN = re.compile(r"\s+([A-ZÀ-ÖØ-Þ][^\W\d_]*(?:['’-][^\W\d_]+)*)")


def places(text: str) -> Iterator[Candidate]:
    """Stretches from house number or street to the postal code and, where that precedes it, the town.

    One of a form with a word for a street, or of street, number, code and town, is a seed. Of the others it is the
    longest stretch of numbers, capitalised words and commas before the code.
    """
    for m in _CODE.finditer(text):
        start, end = m.span()
        if end - start not in (5, 10) or text[end : end + 1] in ("/", "°") or text[end : end + 1] in (".", ",", "-") and text[end + 1 : end + 2].isdigit():
            continue
        lead = text[max(0, start - 2) : start]
        if lead and lead[-1] in _BREAKS and not (lead[-1] == "-" and lead[0].isupper()):
            continue
        base = max(0, start - 130)
        before = text[base:start]
        town = _TOWN.match(text, end)
        # the nearest start that leads up to the code without a break
        hit, seed = _nearest(_US, before), "address"
        if hit is None and town:
            hit = next((h for form in (_FR, _ES, _DE) if (h := _nearest(form, before)) is not None), None)
            end = town.end()
        if hit is None:
            if not (stretch := _PLACE.search(before)) or "," not in stretch[0]:
                continue
            hit, seed = stretch.start(), ""
        left = _fold(_TOKEN.findall(text, max(0, base + hit - 32), base + hit)[-2:])
        patterns = [f"{' '.join(left)}|", f"{' '.join(left[-1:])}|"]
        yield Candidate(base + hit, end, _place_shape(before[hit:]), list(dict.fromkeys(patterns)), seed)


def _place_shape(text: str) -> str:
    """Numbers as 9, words as a, short capitals as A; repeats once."""
    tokens = ["9" if t[0].isdigit() else "A" if len(t) == 2 and t.isupper() else "a" if t.isalpha() else t for t in _TOKEN.findall(text)]
    return " ".join(t for i, t in enumerate(tokens) if not i or t != tokens[i - 1])


def addresses(text: str, model: Model | None = None) -> Iterator[tuple[int, int]]:
    """Addresses of a known form, and those in a context of addresses whose shape is one of addresses."""
    for c in places(text):
        if c.seed or model and c.instance in model.forms and any(p in model.placed for p in c.patterns):
            yield c.start, c.end


def _nearest(form: re.Pattern, text: str) -> int | None:
    """The last offset at which ``form`` matches up to the end; for a form that begins with words, the first of them."""
    found = None
    m = form.search(text)
    while m:
        found = m.start()
        if form is _DE:
            break
        m = form.search(text, found + 1)
    return found


def _number_kind(model: Model, c: Candidate) -> str | None:
    for p in c.patterns:
        if p in model.contexts:
            phone, id_ = model.contexts[p]
            break
    else:
        phone, id_ = model.shapes.get(c.instance, (0.0, 0.0))
    if max(phone, id_) < 0.4:
        return c.seed or None
    return "phone" if phone >= id_ else "id"


_INITIAL = re.compile(r"[^\W\d_]\.")


def _is_first(model: Model, word: str) -> bool:
    return word.lower() in model.first or len(word) == 2 and word[1] == "." and bool(_INITIAL.fullmatch(word))


def _is_last(model: Model, word: str) -> bool:
    low = _last(word)
    return low in model.last or "-" in low and any(p in model.last for p in low.split("-") if len(p) > 2)


def find(text: str, lang: str | None, model: Model, told: bool = True) -> list[tuple[str, int, int]]:
    """``(kind, start, end)`` of all personal data of a text, in order; ``told``: it may hold a given name in lower case."""
    out: list[tuple[str, int, int]] = []

    def add(kind: str, start: int, end: int) -> None:
        if all(end <= a or b <= start for _, a, b in out):
            out.append((kind, start, end))

    for s, e in emails(text, model):
        add("email", s, e)
    for s, e in addresses(text, model):
        add("address", s, e)
    for c in numbers(text):
        if kind := _number_kind(model, c):
            add(kind, c.start, c.end)
    for r in runs(text, (lang or "").lower().startswith("fr")):
        words = r.words
        if r.opens and len(words) > 1 and not _is_first(model, words[0]):
            # the word that opens the sentence is context
            if (r := _inner(text, r)) is None:
                continue
            words = r.words
        last, end = _is_last(model, words[-1]), r.end
        if len(words) == 1:
            if (more := _COMMA_FIRST.match(text, end)) and _is_first(model, _SPACED.match(more[1])[0]) and (last or not r.opens):
                end = more.end(1)
            elif r.opens or not (last or r.seed):
                continue
        first = _is_first(model, words[0])
        hit = r.seed or (last and (len(words) > 1 or end > r.end) and (end > r.end or first))
        if not hit:
            found = _matched(text, r, model, last or first)
            sure = [p for p in found if not p.startswith("|")]
            hit = bool(found) if last or first else bool(sure) and (len(words) > 1 or end > r.end)
        if hit:
            if text[end - 2 : end] in ("'s", "’s"):
                end -= 2
            add("name", r.start, end)
    anchors = _lower_anchors(text, model, told)
    if anchors:
        for tokens in _windows(text, anchors):
            folded = [x for _, _, x in tokens]
            pairs = [*map(" ".join, zip(folded, folded[1:]))]
            for i, (_, e, word) in enumerate(tokens):
                if word in model.before or i and pairs[i - 1] in model.before:
                    _add_lower(text, e, model, add)
            for i, (s, _, word) in enumerate(tokens):
                if (word in model.after or i < len(pairs) and pairs[i] in model.after) and (b := _LOWER_BEFORE.search(text, max(0, s - 60), s)) and (w := _lower_tail(b[1], model)):
                    add("name", b.start(1) + w[0], b.start(1) + w[1])
        for _, _, e in [x for x in out if x[0] == "name"]:
            if m := _NEXT_NAME.match(text, e):
                _add_lower(text, m.end(), model, add)
    return sorted(out, key=lambda x: (x[1], x[2]))


class GivenNames:
    """Which of many texts may hold one of the given names in lower case, looked up by their letters in one array.

    A text is told by the longest run of ASCII letters of a name, so some are told that hold none, and none is missed.
    """

    AT_ONCE = 1 << 20  # letters of the texts looked up together; a longer text is told without being looked at

    def __init__(self, given: frozenset[bytes]) -> None:
        runs = {max(_ASCII_RUN.findall(g), key=len, default=b"") for g in given}
        self.beyond = b"" in runs  # a name without ASCII letters may stand in any text that has others
        self.runs = runs - {b""}
        # lengths (63 for more) of the runs by their first two letters, and by their first and last
        self.second, self.last = np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.uint64)
        for w in self.runs:
            bit = np.uint64(1 << min(len(w), 63))
            self.second[w[0] << 8 | (w[1] if len(w) > 1 else 0)] |= bit
            self.last[w[0] << 8 | w[-1]] |= bit

    def told(self, texts: list[str | None]) -> list[bool]:
        out, some, size = [False] * len(texts), [], 0
        for i, t in enumerate(texts):
            if t and (len(t) > self.AT_ONCE or self.beyond and not t.isascii()):
                out[i] = True
            elif t:
                some.append(i)
                size += len(t)
                if size > self.AT_ONCE:
                    self._tell(texts, some, out)
                    some, size = [], 0
        if some:
            self._tell(texts, some, out)
        return out

    def _tell(self, texts: list[str | None], some: list[int], out: list[bool]) -> None:
        parts = [texts[i].encode() for i in some]
        whole = b"\n".join(parts) + b"\n"
        b = np.frombuffer(whole, np.uint8)
        letter = np.frombuffer(whole.translate(_IS_LETTER), np.bool_)
        turns = np.flatnonzero(letter[1:] != letter[:-1]) + 1
        if letter[0]:
            turns = np.concatenate([[0], turns])
        start, end = turns[::2], turns[1::2]  # the last byte is no letter
        bit = np.left_shift(np.uint64(1), np.minimum(end - start, 63).astype(np.uint64))
        lead = b[start].astype(np.uint16) << 8
        near = np.flatnonzero(self.second[lead | np.where(end - start > 1, b[start + 1], 0)] & bit)
        near = near[(self.last[lead[near] | b[end[near] - 1]] & bit[near]) != 0]
        start, end = start[near], end[near]
        hits = [s for s, e in zip(start.tolist(), end.tolist()) if whole[s:e] in self.runs]
        ends = np.cumsum([len(p) + 1 for p in parts])
        for at in set(np.searchsorted(ends, hits, "right").tolist()):
            out[some[at]] = True


def _holds_given(text: str, model: Model) -> bool:
    # runs of letters, as bytes: quickly made and looked up; a part of a hyphened name counts as well
    letters = (text if text.isascii() else _ODD.sub(" ", text)).encode().translate(_LETTERS).split()
    return any(w in model.given for w in letters) if isinstance(model.given, _Both) else not model.given.isdisjoint(letters)


def _lower_anchors(text: str, model: Model, told: bool = True) -> list[tuple[int, int]]:
    """Where given names in any case and initials stand, if a name in lower case may stand in the text: if it holds a given
    name in lower case, which is not looked for unless ``told``, or an initial in lower case beside a last name."""
    if not (told and _holds_given(text, model)):
        for m in _LOWER_INITIAL.finditer(text):
            if m[1] and _is_last(model, m[1]) or (b := _BEFORE_INITIAL.search(text, max(0, m.start() - 61), m.start() - 1)) and _is_last(model, b[1]):
                break
        else:
            return []
    spans = [(m.start() - 1, m.end()) for m in _ANY_INITIAL.finditer(text)]
    for w in set(_NAME_WORD.findall(text)):
        if w.lower() in model.first:
            at = text.find(w)
            while at >= 0:
                end = at + len(w)
                if not (at and _is_letter(text[at - 1]) or end < len(text) and _is_letter(text[end])):
                    spans.append((at, end))
                at = text.find(w, at + 1)
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans, key=lambda x: (x[0], -x[1])):  # the longest of those that begin together
        if not out or s >= out[-1][1]:
            out.append((s, e))
    return out


def _is_letter(c: str) -> bool:
    return c.isalnum() and not c.isdecimal()


def _windows(text: str, anchors: list[tuple[int, int]]) -> Iterator[list[tuple[int, int, str]]]:
    """The tokens around the anchors: a name begins at most three words before one and ends as many after it."""
    start = end = 0
    spans: list[list[int]] = []
    for s, e in anchors:
        start, end = _words_off(text, s, -6), _words_off(text, e, 6)
        if spans and start <= spans[-1][1]:
            spans[-1][1] = max(end, spans[-1][1])
        else:
            spans.append([start, end])
    for start, end in spans:
        yield [(m.start(), m.end(), "9" if m[0].isdigit() else m[0].lower()) for m in _TOKEN.finditer(text, start, end)]


def _words_off(text: str, at: int, words: int) -> int:
    """The offset some blank-separated words before or after one, in whole tokens."""
    step = -1 if words < 0 else 1
    left, size = abs(words), len(text)
    while 0 < at < size and left:
        at += step
        left -= text[at - 1 if step < 0 else at - 1].isspace() and not text[at : at + 1].isspace()
    return at


def _add_lower(text: str, at: int, model: Model, add) -> None:
    m = _LOWER.match(text, at)
    if m and m[1][0].islower() and (length := _lower_name(m[1], model)):
        add("name", m.start(1), m.start(1) + length)


def _pieces(text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), m[0]) for m in re.finditer(r"[^\s,]+", text)]


def _lower_name(text: str, model: Model) -> int:
    """The length of the name at the start of ``text``, in whatever case; 0 if there is none."""
    words = _pieces(text)
    best = 0
    for i in range(1, len(words)):
        a, b = words[0][2], words[i][2]
        comma = "," in text[words[0][1] : words[1][0]]
        if (not comma and _is_first(model, a) and _is_last(model, b)) or (comma and i == 1 and _is_last(model, a) and _is_first(model, b)):
            best = words[i][1]
    return best


def _lower_tail(text: str, model: Model) -> tuple[int, int] | None:
    """The name in lower case at the end of ``text``."""
    words = _pieces(text)
    for i in range(len(words) - 1):
        if words[i][2][0].islower() and _lower_name(text[words[i][0] :], model) == len(text) - words[i][0]:
            return words[i][0], len(text)
    return None


def _finder(model, do):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = GivenNames(model.value.given)
        for batch in batches:
            rows = []
            more = batch.column(3).to_pylist() if batch.num_columns > 3 else [None] * batch.num_rows
            keys, texts, langs = (batch.column(i).to_pylist() for i in range(3))
            for k, t, la, x, told in zip(keys, texts, langs, more, given.told(texts)):
                m = model.value
                if x:
                    m, told = Model(*map(_Both, m, _model([tuple(e.values()) for e in x]))), True
                rows.append((k, t, find(t, la, m, told) if t else []))
            yield do(batch, rows)

    return run


def _prepared(df: DataFrame, key: str, text: str, lang: str):
    """The broadcast model; the texts, with what they need of the lists beyond it in a fourth column, if there are such."""
    model, rest = learn(df, key, text, lang)
    src = df.select(key, text, lang)
    if rest is not None:

        def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [(i, *x) for i, (t, la) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())) if t for x in _looked_up(t, (la or "").lower().startswith("fr"))]
                owner = pa.array([f[0] for f in found], pa.int64())
                cols = [batch.column(0).take(owner), *(pa.array([f[i] for f in found], pa.string()) for i in (1, 2))]
                yield pa.RecordBatch.from_arrays(cols, ["owner", "list", "entry"])

        kind = df.select(key).schema[0].dataType.simpleString()
        needed = src.mapInArrow(asked, f"owner {kind}, list string, entry string").join(rest, ["list", "entry"])
        needed = needed.groupBy("owner").agg(F.collect_set(F.struct("list", "entry", "total", "a", "b")).alias("more"))
        src = src.join(needed, src[key].eqNullSafe(needed["owner"]), "left").select(src[key], src[text], src[lang], "more")
    return df.sparkSession.sparkContext.broadcast(model), src


def find_private(df: DataFrame, key: str, text: str, lang: str) -> DataFrame:
    """``(key, kind, char_start, char_end)`` of all personal data in all texts."""
    model, src = _prepared(df, key, text, lang)

    def do(batch: pa.RecordBatch, rows: list) -> pa.RecordBatch:
        owner = pa.array([i for i, r in enumerate(rows) for _ in r[2]], pa.int64())
        flat = [x for r in rows for x in r[2]]
        cols = [pa.array([x[0] for x in flat], pa.string()), *(pa.array([x[i] for x in flat], pa.int64()) for i in (1, 2))]
        return pa.RecordBatch.from_arrays([batch.column(0).take(owner), *cols], ["key", "kind", "char_start", "char_end"])

    kind = df.select(key).schema[0].dataType.simpleString()
    out = src.mapInArrow(_finder(model, do), f"key {kind}, kind string, char_start bigint, char_end bigint")
    return out.withColumnRenamed("key", key)


def redact(df: DataFrame, key: str, text: str, lang: str) -> DataFrame:
    """``(key, text, n_found)``: every find replaced by ``[EMAIL]``, ``[PHONE]``, ``[ID]``, ``[ADDRESS]`` or ``[NAME]``."""
    model, src = _prepared(df, key, text, lang)

    def replaced(t: str | None, found: list) -> str | None:
        if not found:
            return t
        parts, at = [], 0
        for kind, s, e in found:
            parts += [t[at:s], f"[{kind.upper()}]"]
            at = e
        return "".join([*parts, t[at:]])

    def do(batch: pa.RecordBatch, rows: list) -> pa.RecordBatch:
        texts = pa.array([replaced(t, found) for _, t, found in rows], pa.string())
        return pa.RecordBatch.from_arrays([batch.column(0), texts, pa.array([len(r[2]) for r in rows], pa.int64())], ["key", "text", "n_found"])

    kind = df.select(key).schema[0].dataType.simpleString()
    out = src.mapInArrow(_finder(model, do), f"key {kind}, text string, n_found bigint")
    return out.select(F.col("key").alias(key), F.col("text").alias(text), "n_found")
