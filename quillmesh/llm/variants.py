"""Variant spellings of the names of bodies, offices, roles and their holders.

1. Every row is read into a kind (body, office, role, holder, lone acronym), the office's function or the role's title,
   a distinctive word (the place of a body, the last name of a holder) and the common words of such names, with typing
   errors and abbreviations undone by a reference vocabulary.
2. Distinctive words are joined on gapped grams: what is left of a word with as many letters out as its length allows
   edits. Two words within reach share such a gram, and as it holds nearly all of a word, few others do: plain grams of
   two to four letters give candidates that grow with the square of the words (README). A pair is verified by soft
   weighted token similarity: the distinctive word counts by its edit distance, the common words of the rarer name where
   the other has them, each by its inverse document frequency; above ``ALIKE`` the rarer is a variant of the other.
3. Among the names with one distinctive word, a set of common words belongs to the fullest set that holds it. Functions
   of offices typed in rare ways are joined with frequent ones on the same grams.
4. A lone acronym means the body annotated with it in the same document. A title that names its holder means the holder.

Only distinct words and distinct sets of common words are compared, so a name that a third of all rows carry is one
item until the pairs are written out.

Defined results: a row without any name is linked to none; a name without a distinctive word is linked to rows of its
kind with the same folded text; an acronym without a body in its document is linked to the same acronym there.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmesh.llm.names import Vocabulary, acronym_of, distance, fold, reach, words
from quillmesh.llm.pairs import same_key_pairs
from quillmesh.operators.components import connected_components
from quillmesh.session import materialize

ALIKE = 0.66
RARER = 5  # a function typed in another way is at least so many times rarer

# fixed values: titles, titles with another form, and short forms of given names
TITLES = (
    "director", "deputy director", "administrator", "assistant administrator", "commissioner", "chair", "vice chair",
    "inspector general", "chief data officer", "general counsel", "secretary", "president",
)
TITLE_WORDS = {w: 1 for t in TITLES for w in t.split()} | {"chairperson": 1, "chairman": 1}
SHORT_TITLES = {"ig": "inspector general", "cdo": "chief data officer", "gc": "general counsel", "chairperson": "chair", "chairman": "chair", "chairwoman": "chair"}
NICKNAMES = {
    "alex": "alexander alexandra", "sasha": "alexander alexandra", "sandy": "alexander alexandra", "xander": "alexander",
    "pip": "philippa philip", "pippa": "philippa", "etta": "henrietta", "harriet": "henrietta", "hattie": "henrietta", "hetty": "henrietta", "bill": "william", "will": "william",
    "billy": "william", "liam": "william", "ted": "theodore edward", "teddy": "theodore edward", "theo": "theodore theodora", "leo": "leopold leonard leonora",
    "dot": "dorothea dorothy", "dottie": "dorothea dorothy", "thea": "dorothea theodora", "dora": "dorothea theodora", "roz": "rosalind", "ros": "rosalind", "rosie": "rosalind",
    "jo": "josephine joseph", "josie": "josephine", "posy": "josephine", "nat": "nathaniel natalie", "nate": "nathaniel", "neil": "cornelius", "con": "cornelius constance", "corny": "cornelius", "nelius": "cornelius",
    "max": "maximilian maxine", "nell": "eleanor helen", "nora": "eleanor honora", "ellie": "eleanor", "lena": "eleanor helena", "liz": "elizabeth", "beth": "elizabeth", "betsy": "elizabeth", "bess": "elizabeth", "eliza": "elizabeth", "lizzie": "elizabeth", "libby": "elizabeth",
    "peg": "margaret", "peggy": "margaret", "meg": "margaret", "maggie": "margaret", "greta": "margaret", "daisy": "margaret", "kit": "katherine christopher", "kate": "katherine", "kathy": "katherine", "kat": "katherine",
    "bart": "bartholomew", "barty": "bartholomew", "gus": "augustus august angus", "fritz": "frederick", "fred": "frederick", "freddie": "frederick", "mina": "wilhelmina", "billie": "wilhelmina", "willa": "wilhelmina", "minnie": "wilhelmina",
    "jack": "john", "ned": "edward", "ed": "edward", "bob": "robert", "rob": "robert", "dick": "richard", "rick": "richard", "jim": "james", "tony": "anthony", "sam": "samuel samantha",
    "zandy": "alexander", "bea": "beatrice", "trixie": "beatrice", "tilly": "matilda", "mattie": "matilda", "polly": "mary", "molly": "mary", "sally": "sarah", "sadie": "sarah", "nan": "anne", "nancy": "anne", "hal": "henry", "harry": "henry", "hank": "henry",
}

_PART = re.compile(r"[^\W_]+(?:['.-](?=[^\W_])[^\W_]+)*[.']?|[,()]|\s-\s")


class Reader:
    """Reads names with a vocabulary of common words."""

    def __init__(self, vocabulary: dict[str, int]) -> None:
        self.common = Vocabulary(vocabulary)
        self.titles = Vocabulary(TITLE_WORDS)
        self.office = Vocabulary({"office": 1})

    def body(self, text: str) -> tuple[str, list[str]]:
        """The distinctive word and the sorted common words of the name of a body."""
        rare, known = [], set()
        for w in words(re.sub(r"\(([a-z.]{3,9})\)", lambda m: "" if acronym_of(m[1]) and len(m[1]) < 8 else f" {m[1]} ", text)):
            for part in w.split("-") if "-" in w else [w]:
                found = self.common.readings(part)
                if found:
                    known.add(found[0][0])
                elif len(part) > 8 or len(part) > 4 and part[-1] not in ".'":
                    rare.append(part.rstrip(".'"))
        if len(rare) > 1:
            # a common word beyond recognition is longer or odder than others, but nearer to a common word than a name is
            odd = []
            for w in rare:
                cost, meant = self.common.nearest(w)
                odd.append((cost, w, meant))
            odd.sort()
            known |= {c for cost, _, c in odd[:-1] if cost <= 0.4}
            return odd[-1][1], sorted(known)
        return (rare or [""])[0], sorted(known)

    def _is_title(self, parts: list[str]) -> str:
        ws = [re.sub(r"[.']", "", p) for x in parts for p in x.split("-")]
        if not ws or len(ws) > 3:
            return ""
        if len(ws) == 1 and ws[0] in SHORT_TITLES:
            return SHORT_TITLES[ws[0]]
        read = []
        for p, w in zip([q for x in parts for q in x.split("-")], ws):
            found = self.titles.readings(p)
            if not found or found[0][1] > 1.7:
                return ""
            read.append(SHORT_TITLES.get(found[0][0], found[0][0]))
        t = " ".join(read)
        return t if t in TITLES else ""

    def title(self, text: str) -> tuple[str, str]:
        """The title and the rest of a role."""
        parts = _PART.findall(re.sub(r"^the ", "", text))
        flat = [p for p in parts]
        bare = [i for i, p in enumerate(flat) if p.strip() not in (",", "(", ")", "-")]
        for n in (3, 2, 1):
            for at in (bare[:n], bare[-n:]):
                if len(at) == n and len(bare) > n and at[-1] - at[0] == n - 1 and (t := self._is_title([flat[i] for i in at])):
                    rest = [p for i, p in enumerate(flat) if i not in at]
                    while rest and rest[0].strip() in (",", "of", "(", ")", "-", "the"):
                        rest = rest[1:]
                    while rest and rest[-1].strip() in (",", "(", ")", "-"):
                        rest = rest[:-1]
                    return t, re.sub(r" ,", ",", " ".join(rest))
        return "", text

    def function(self, text: str) -> tuple[str, str]:
        """The function of an office and the name of its body."""
        parts = _PART.findall(text)
        for i, p in enumerate(parts[:-1]):
            near = self.office.readings(p)
            if (near and near[0][1] <= 2 or p.strip(".") in ("ofc", "off")) and parts[i + 1] == "of":
                j = i + 2
                while j < len(parts) and parts[j].strip() not in ("of", ",", "(", "-", ")"):
                    j += 1
                return " ".join(parts[i + 2 : j]), " ".join([*parts[:i], *parts[j:]])
        return "", text

    def row(self, kind: str | None, name: str | None, title: str | None, acronym: str | None) -> tuple[str, str, str, list[str], str]:
        """kind, function or title, distinctive word, common words, acronym."""
        short = re.sub(r"[^a-z0-9]", "", fold(acronym))
        text = fold(title if kind == "roles" else name) or fold(name) or fold(title)
        if not text:
            return "none", "", "", [], short
        if kind == "roles":
            t, rest = self.title(text)
            place, known = self.body(rest)
            people = re.sub(r"[^\w\s,.'-]", "", rest)
            ws = [w for w in re.split(r"[\s,]+", people) if w]
            if t and 1 <= len(ws) <= 3 and not any((f := self.common.readings(w)) and f[0][1] <= 0.7 for w in ws):
                last, first = (ws[0], ws[-1]) if "," in people and len(ws) > 1 else (ws[-1], ws[0] if len(ws) > 1 else "")
                return "holder", t, last, [first.rstrip(".")] if first else [], short
            return ("role" if place else "text"), t, place or text, known, short
        if kind == "offices":
            f, rest = self.function(text)
            place, known = self.body(rest)
            return ("office" if place else "text"), f, place or text, known, short
        if a := acronym_of(text):
            return "acronym", "", "", [], a
        if m := re.search(r"\(([a-z.]{3,9})\)", text):
            short = short or acronym_of(m[1])
        place, known = self.body(text)
        return ("body" if place else "text"), "", place or text, known, short


def _read(df: DataFrame, reader, id_: str, doc: str, kind: str, name: str, title: str, acronym: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [reader.value.row(*r) for r in zip(*(batch.column(i).to_pylist() for i in range(2, 6)))]
            cols = [pa.array([r[i] for r in rows], pa.list_(pa.string()) if i == 3 else pa.string()) for i in range(5)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], ["id", "doc", "kind", "slot", "rare", "known", "short"])

    src = df.select(F.col(id_).cast("bigint"), F.trim(doc), kind, name, title, acronym)
    return src.mapInArrow(run, "id bigint, doc string, kind string, slot string, rare string, known array<string>, short string")


def gapped_grams(word: Column) -> Column:
    """Hashes of a word with up to as many letters left out as ``reach`` allows: 0, 1 from four letters, 2 from eight."""
    without = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
    one = F.when(F.length(word) >= 4, without(word)).otherwise(F.array().cast("array<string>"))
    two = F.when(F.length(word) >= 8, F.flatten(F.transform(one, without))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.transform(F.concat(F.array(word), one, two), lambda g: F.xxhash64(g)))


def near_words(words: DataFrame, key: str, group: str, word: str) -> DataFrame:
    """``(key_a, key_b)``, once each, of distinct words of one group that share a gapped gram: all within reach and few more.

    As many words share a gram as differ in two letters only: a number bound by word length and alphabet.
    """
    grams = words.select(key, group, F.explode(gapped_grams(F.col(word))).alias("g")).select(key, F.xxhash64(group, "g").alias("gram"))
    # counted where they lie: a plan takes grams for as few as the words, and would send them all to the driver for a join
    counted = grams.withColumn("n", F.count("*").over(Window.partitionBy("gram")))
    met = materialize(counted.where("n > 1").select("gram", key), "grams")
    return met.toDF("gram", f"{key}_a").join(met.toDF("gram", f"{key}_b"), "gram").where(f"{key}_a < {key}_b").select(f"{key}_a", f"{key}_b").distinct()


def _attach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Which of two words is a variant of which, and at what distance: soft weighted token similarity of the names."""
    for batch in batches:
        out: list[tuple[str, str, float, int]] = []
        for x, y, n, m, p, q, rare in zip(*(batch.column(i).to_pylist() for i in range(7))):
            if (n, y) > (m, x):
                x, y, n, m, p, q = y, x, m, n, q, p
            # x is the rarer: a variant of y
            u, v = x.partition("|")[2], y.partition("|")[2]
            d = distance(u, v)
            if d > min(reach(u), reach(v)) + 0.01 or (d > 1.01 and len(u) < 9):
                continue
            theirs = {w["word"] for w in q}
            alike = rare * (1 - d / len(u)) + sum(w["idf"] for w in p if w["word"] in theirs)
            if alike >= ALIKE * (rare + sum(w["idf"] for w in p)):
                out.append((x, y, d, m))
        yield pa.record_batch([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.float64(), pa.int64()))], ["x", "y", "d", "m"])


def _clusters(rows: DataFrame) -> DataFrame:
    """``(token, cluster)`` of the distinctive words."""
    named = rows.where("kind NOT IN ('none', 'acronym', 'text')")
    long = named.select("token", F.explode_outer(F.when(F.col("kind") == "holder", F.array("slot")).otherwise(F.col("known"))).alias("word")).distinct()
    counts = named.groupBy("token", "rare").agg(F.count("*").alias("n"))
    total = counts.agg(F.log(F.count("*").cast("double")).alias("top"))
    weights = long.where("word IS NOT NULL").groupBy("word").agg(F.log(F.count("*").cast("double")).alias("df")).join(F.broadcast(total)).select("word", (F.col("top") - F.col("df")).alias("idf"))
    # the common words of a token are at most the vocabulary
    worded = long.join(weights, "word").groupBy("token").agg(F.array_sort(F.collect_list(F.struct("word", "idf"))).alias("words"))
    none = F.array().cast("array<struct<word:string,idf:double>>")
    tokens = counts.join(worded, "token", "left").join(F.broadcast(total)).select(
        F.xxhash64("token").alias("tid"), "token", F.split_part("token", F.lit("|"), F.lit(1)).alias("grp"), "rare", "n", F.coalesce("words", none).alias("words"), "top"
    )
    tokens = materialize(tokens, "tokens")
    pairs = near_words(tokens, "tid", "grp", "rare")
    for s in "ab":
        pairs = pairs.join(tokens.select(F.col("tid").alias(f"tid_{s}"), *[F.col(c).alias(f"{c}_{s}") for c in ("token", "n", "words", "top")]), f"tid_{s}")
    variant = pairs.select("token_a", "token_b", "n_a", "n_b", "words_a", "words_b", "top_a").mapInArrow(_attach, "x string, y string, d double, m bigint")
    # every variant goes to the nearest, then most frequent word it may be a variant of
    best = variant.groupBy("x").agg(F.min_by("y", F.struct("d", -F.col("m"), "y")).alias("y"))
    found = connected_components(materialize(best, "attached"), "x", "y")
    return tokens.select("token").join(found, tokens["token"] == found["node"], "left").select("token", F.coalesce("component", "token").alias("cluster"))


def _full_sets(sets: list[tuple[list[str], int]]) -> list[tuple[list[str], str]]:
    """For every set of common words the name of the fullest set that holds it; between such, the most frequent.

    A set is compared with the fullest sets that have its rarest word only.
    """
    whole = [(frozenset(s), n) for s, n in sets]
    has = Counter(w for s, _ in whole for w in s)
    under: dict[str, list[tuple[frozenset[str], int]]] = defaultdict(list)
    fullest: list[tuple[frozenset[str], int]] = []
    above = lambda s: under[min(s, key=lambda w: (has[w], w))] if s else fullest
    for s, n in sorted(whole, key=lambda x: -len(x[0])):
        if not any(s < m for m, _ in above(s)):
            fullest.append((s, n))
            for w in s:
                under[w].append((s, n))
    out = []
    for s, n in whole:
        home = min(((-k, sorted(m)) for m, k in above(s) if s <= m), default=(0, sorted(s)))[1]
        out.append((sorted(s), " ".join(home)))
    return out


def _given(firsts: list[tuple[list[str], int]]) -> list[tuple[list[str], str]]:
    """For every given name, nickname or initial of holders of one title and last name, the given name it stands for."""
    names = {f[0]: n for f, n in firsts if f}
    formal = {f: n for f, n in names.items() if len(f) > 1 and f not in NICKNAMES}
    kept: list[str] = []
    stands: dict[str, str] = {}
    for f in sorted(formal, key=lambda f: (-formal[f], f)):
        near = next((k for k in kept if distance(f, k) <= (1.01 if len(f) < 7 else 2.01)), None)
        stands[f] = near or f
        if not near:
            kept.append(f)
    for f in names:
        if f in NICKNAMES:
            full = NICKNAMES[f].split()
            stands[f] = next((k for k in kept if k in full), full[0])
    people = sorted(set(stands.values()))
    out = []
    for f, _ in firsts:
        if not f:
            out.append((f, people[0] if len(people) == 1 else ""))
        elif len(f[0]) == 1:
            fits = [p for p in people if p[0] == f[0]]
            out.append((f, fits[0] if len(fits) == 1 else f[0]))
        else:
            out.append((f, stands[f[0]]))
    return out


def _resolve(resolver):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cluster, slot = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out = [(c, s, k, h) for c, s, sets in zip(cluster, slot, batch.column(2).to_pylist()) for k, h in resolver([(x["known"], x["n"]) for x in sets])]
            kinds = (pa.string(), pa.string(), pa.list_(pa.string()), pa.string())
            yield pa.record_batch([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)], ["cluster", "slot", "known", "home"])

    return run


def variant_keys(df: DataFrame, vocabulary: dict[str, int], id_: str, doc: str, kind: str, name: str, title: str, acronym: str) -> DataFrame:
    """``(id, entity)``: rows of one entity have one key."""
    reader = df.sparkSession.sparkContext.broadcast(Reader(vocabulary))
    group = F.when(F.col("kind") == "holder", F.lit("person")).otherwise(F.lit("body"))
    rows = materialize(_read(df, reader, id_, doc, kind, name, title, acronym).withColumn("token", F.concat(group, F.lit("|"), F.col("rare"))), "names")
    named = rows.where("kind NOT IN ('none', 'acronym', 'text')").join(_clusters(rows), "token")
    named = materialize(named.withColumn("over", F.when(F.col("kind") == "holder", F.col("slot")).otherwise("")), "named")
    sets = named.groupBy("cluster", "over", "known").agg(F.count("*").alias("n"))
    # distinct sets of the vocabulary's words under one distinctive word: as many as there are ways to shorten a name
    sets = sets.groupBy("cluster", "over").agg(F.array_sort(F.collect_list(F.struct("known", "n"))).alias("sets"))
    schema = "cluster string, slot string, known array<string>, home string"
    homes = sets.where("cluster NOT LIKE 'person|%'").mapInArrow(_resolve(_full_sets), schema)
    homes = homes.union(sets.where("cluster LIKE 'person|%'").mapInArrow(_resolve(_given), schema)).withColumnRenamed("slot", "over")
    named = materialize(named.join(homes, ["cluster", "over", "known"]), "resolved")
    body = F.concat_ws("|", "cluster", "home")
    slots = _slots(named.where("kind IN ('office', 'role')"))
    keyed = named.join(slots, ["kind", "slot"], "left").select(
        "id", "doc", "kind", "short", F.concat_ws("|", F.when(F.col("kind") == "holder", "holder").otherwise(F.col("kind")), F.coalesce("meant", "slot"), body).alias("entity")
    )
    bodies = keyed.where("kind = 'body' AND short <> ''").groupBy("doc", "short").agg(F.min("entity").alias("entity"), F.max("entity").alias("other"))
    bodies = bodies.where("entity = other").drop("other")
    lone = rows.where("kind = 'acronym'").join(bodies, ["doc", "short"], "left")
    lone = lone.select("id", F.coalesce("entity", F.concat_ws("|", F.lit("acronym"), "doc", "short")).alias("entity"))
    plain = rows.where("kind = 'text'").select("id", F.concat_ws("|", F.lit("text"), "slot", "rare").alias("entity"))
    return keyed.select("id", "entity").union(lone).union(plain)


def _slots(rows: DataFrame) -> DataFrame:
    """``(kind, slot, meant)``: functions of offices typed in rare ways, with the frequent one meant."""
    counts = materialize(rows.groupBy("kind", "slot").agg(F.count("*").alias("n")), "slots")
    office = counts.where("kind = 'office' AND slot <> ''").select(F.xxhash64("slot").alias("sid"), "kind", "slot", "n")
    pairs = near_words(office, "sid", "kind", "slot")
    both = pairs.union(pairs.select("sid_b", "sid_a")).toDF("sid", "other")
    near = both.join(office.select("sid", "slot", "n"), "sid").join(office.select(F.col("sid").alias("other"), F.col("slot").alias("known"), F.col("n").alias("m")), "other")
    near = near.where(F.col("n") * RARER <= F.col("m")).withColumn("d", F.levenshtein("slot", "known"))
    best = near.groupBy("slot").agg(F.min_by("known", F.struct("d", -F.col("m"), "known")).alias("meant"))
    return counts.join(best, "slot", "left").select("kind", "slot", F.when(F.col("kind") == "office", F.coalesce("meant", "slot")).otherwise(F.col("slot")).alias("meant"))


def variant_pairs(df: DataFrame, vocabulary: dict[str, int], id_: str, doc: str, kind: str, name: str, title: str, acronym: str) -> DataFrame:
    """``(id_a, id_b)``, a < b, of all rows that mean the same entity."""
    keys = materialize(variant_keys(df, vocabulary, id_, doc, kind, name, title, acronym), "entities")
    return same_key_pairs(keys, "entity", "id").toDF(f"{id_}_a", f"{id_}_b")
