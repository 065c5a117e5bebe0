"""Mapping freely typed names to the entries of a reference list, misses reported.

The reference list is small and fixed (its size is checked); it is broadcast as a symmetric-delete dictionary. A typed
name is folded into words; each word is read as one or more words of the list (typing errors within a bounded weighted
Damerau-Levenshtein distance, abbreviations); the name means the entry one of whose names holds all its words, the
rarest among them included. Candidates are ranked by the summed distance, then by how often the entry is named exactly
in the whole data. The typed names are matched where they lie, each distinct one once a task: nothing is shuffled, so
a name that a third of all rows carry costs nothing more.

A distinctive word near one of the list is another name and not an error where most of its mentions stand in names that
fit no entry, and it makes up a fair share of all mentions of the word it resembles and those around it. Both are shares
of the mentions of the whole data, so the verdict does not change with their number.

Defined results: NULL and blank names, acronyms of several entries and names of several equally good entries are
``unmatched``; case, accents, blanks, articles and a possessive do not count.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from quillmesh.llm.names import Lookup, Vocabulary, acronym_of, fold, garbled, shortens, words
from quillmesh.session import materialize

UNMATCHED = "unmatched"
REFERENCE_ROWS = 50_000
OTHER_SHARE = 1 / 8


class Profile(NamedTuple):
    entity: str
    words: frozenset[str]
    rare: frozenset[str]


class Reference:
    """A reference list prepared for lookups."""

    def __init__(self, rows: list[tuple[str, str, str | None, list[str] | None]]) -> None:
        named: list[tuple[str, list[str], bool]] = []
        self.acronyms: dict[str, set[str]] = defaultdict(set)
        self.exact: dict[str, set[str]] = defaultdict(set)
        for entity, name, acronym, aliases in rows:
            if a := re.sub(r"[^a-z0-9]", "", fold(acronym)):
                self.acronyms[a].add(entity)
            for i, n in enumerate([name, *(aliases or [])]):
                if f := fold(n):
                    self.exact[f].add(entity)
                    named.append((entity, words(f), i == 0))
        count = Counter(w for _, ws, _ in named for w in set(ws))
        # a word of few entries tells them apart; the others are the common words of such names
        owners: dict[str, set[str]] = defaultdict(set)
        for entity, ws, _ in named:
            for w in ws:
                owners[w].add(entity)
        rare = {w for w, e in owners.items() if len(e) <= max(2, len(rows) // 200) and len(w) > 5}
        self.common = Vocabulary({w: n for w, n in count.items() if w not in rare})
        self.rare = Lookup(rare)
        self.profiles: dict[str, list[Profile]] = defaultdict(list)
        done = set()
        for entity, ws, _ in sorted(named, key=lambda x: -len(x[1])):
            p = Profile(entity, frozenset(ws), frozenset(w for w in ws if w in rare))
            if p in done:
                continue
            done.add(p)
            for w in p.rare:
                self.profiles[w].append(p)

    def near_rare(self, word: str, others: frozenset[str]) -> list[tuple[str, float]]:
        plain = re.sub(r"[.']", "", word)
        if plain in self.rare.entries:
            return [(plain, 0.0)]
        return [] if plain in others else self.rare.near(plain)

    def find(self, name: str | None, others: frozenset[str] = frozenset(), frequency: dict[str, int] | None = None) -> str:
        text = fold(name)
        if not text:
            return UNMATCHED
        if len(hit := self.exact.get(re.sub("^the ", "", text), ())) == 1:
            return next(iter(hit))
        if a := acronym_of(text):
            hit = self.acronyms.get(a, ())
            return next(iter(hit)) if len(hit) == 1 else UNMATCHED
        hint = ""
        if (m := re.search(r"\(([^()]*)\)\s*$", text)) and (a := acronym_of(m[1])) in self.acronyms:
            hint, text = a, text[: m.start()]
        typed = words(text)
        if len(typed) < 2:
            return next(iter(self.acronyms[hint])) if hint and len(self.acronyms[hint]) == 1 else UNMATCHED
        ranked = self._ranked(typed, hint, others, frequency or {})
        if not ranked:
            return UNMATCHED
        rivals = {e for c, f, e in ranked if (c, f) == ranked[0][:2]}
        return ranked[0][2] if len(rivals) == 1 else UNMATCHED

    def fits(self, name: str) -> bool:
        """Whether the words of ``name`` are those of an entry, typing errors undone; of several entries, too."""
        return bool(self._ranked(words(re.sub(r"\([^()]*\)\s*$", "", fold(name))), "", frozenset(), {}))

    def _ranked(self, typed: list[str], hint: str, others: frozenset[str], frequency: dict[str, int]) -> list[tuple[float, int, str]]:
        """``(cost, -frequency, entry)`` of the entries that hold all words, the best first."""
        readings = []
        for w in typed:
            rare = self.near_rare(w, others) if len(w) > 5 else []
            readings.append((w, rare, self.common.readings(w)))
        # the plainest words first, so that an abbreviation does not take the place of a word written out
        readings.sort(key=lambda x: min([d for _, d in [*x[1], *x[2]]], default=9.0))
        candidates = {p for _, rare, _ in readings for r, _ in rare for p in self.profiles[r]}
        ranked = []
        for p in candidates:
            cost, used, kept = 0.0, set(), True
            for w, rare, common in readings:
                options = [(d, r) for r, d in [*rare, *common] if r in p.words and r not in used]
                if not options and not (common and common[0][1] == 0):
                    options = [(d, r) for r in p.words - used if (d := shortens(w, r) if r in p.rare else garbled(w, r)) < (0.4 if r in p.rare else 9)]
                if not options:
                    kept = False
                    break
                d, r = min(options)
                cost += d
                used.add(r)
            if kept and used & p.rare and len(used) > 1:
                ranked.append((cost - (0.5 if hint and p.entity in self.acronyms[hint] else 0), -frequency.get(p.entity, 0), p.entity))
        return sorted(ranked)


def load_reference(reference: DataFrame, key: str, name: str, acronym: str, aliases: str) -> Reference:
    rows = reference.select(key, name, acronym, aliases).orderBy(key).limit(REFERENCE_ROWS + 1).collect()
    if len(rows) > REFERENCE_ROWS:
        raise ValueError(f"the reference list has more than {REFERENCE_ROWS} rows and cannot be broadcast")
    return Reference([tuple(r) for r in rows])


def map_names(
    df: DataFrame, name: str, reference: Reference, out: str = "entity_id"
) -> DataFrame:
    """``df`` with column ``out``: the key of the entry that ``name`` means, or ``unmatched``."""
    df = df.drop(out)
    sc = df.sparkSession.sparkContext
    ref = sc.broadcast(reference)
    distinct = df.select(F.col(name).alias("n")).where(F.col("n").isNotNull()).groupBy("n").agg(F.count("*").alias("rows"))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Mentions of distinctive words and of words near them, and how many of these stand in names of no entry."""
        for batch in batches:
            found: Counter[tuple[str, str]] = Counter()
            against: Counter[tuple[str, str]] = Counter()
            for n, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fits = None
                for w in {re.sub(r"[.']", "", w) for w in words(fold(n))}:
                    if w in ref.value.rare.entries:
                        found[w, w] += c
                    elif len(w) > 5 and (alike := ref.value.rare.near(w)):
                        fits = ref.value.fits(n) if fits is None else fits
                        for r, _ in alike:
                            found[w, r] += c
                            against[w, r] += 0 if fits else c
            cols = [pa.array([k[i] for k in found], pa.string()) for i in (0, 1)] + [pa.array([x[k] for k in found], pa.int64()) for x in (found, against)]
            yield pa.RecordBatch.from_arrays(cols, ["w", "r", "c", "against"])

    counted = distinct.mapInArrow(near, "w string, r string, c bigint, against bigint").groupBy("w", "r").agg(F.sum("c").alias("c"), F.sum("against").alias("against"))
    counted = materialize(counted, "near")
    around = counted.groupBy("r").agg(F.sum("c").alias("around"))
    shares = counted.where("w <> r").join(around, "r").groupBy("w").agg(F.min(F.col("c") / F.col("around")).alias("share"), F.max(F.col("against") / F.col("c")).alias("against"))
    # by their share at most eight for every word of the list
    others = frozenset(r[0] for r in shares.where((F.col("share") >= OTHER_SHARE) & (F.col("against") > 0.5)).select("w").collect())

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter[str] = Counter()
            for n, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if len(hit := ref.value.exact.get(fold(n), ())) == 1:
                    seen[next(iter(hit))] += c
            yield pa.record_batch({"e": pa.array(seen.keys(), pa.string()), "c": pa.array(seen.values(), pa.int64())})

    named = distinct.mapInArrow(exact, "e string, c bigint").groupBy("e").agg(F.sum("c").alias("c")).limit(REFERENCE_ROWS)
    frequency = {r[0]: r[1] for r in named.collect()}
    extra = sc.broadcast((others, frequency))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str | None, str] = {}
        for batch in batches:
            if len(known) > 500_000:
                known.clear()
            found = []
            for n in batch.column(batch.schema.names.index(name)).to_pylist():
                if n not in known:
                    known[n] = ref.value.find(n, *extra.value)
                found.append(known[n])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], [*batch.schema.names, out])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(out, StringType())]))


def misses(mapped: DataFrame, name: str, out: str = "entity_id") -> DataFrame:
    """``(name, n)`` of the names without an entry, the most frequent first."""
    return mapped.where(F.col(out) == UNMATCHED).groupBy(name).agg(F.count("*").alias("n")).orderBy(F.desc("n"), name)
