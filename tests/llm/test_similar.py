import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from quillmesh.llm import setjoin
from quillmesh.llm.near_duplicates import near_duplicate_groups, near_duplicate_pairs, prefix_length
from quillmesh.llm.setjoin import similar_sets


def clean(values):
    return {v.strip().lower() for v in values or [] if v and v.strip()}


def brute(rows, t, least):
    sets = [(k, clean(v)) for k, v in rows]
    return {tuple(sorted((a, b))) for (a, x), (b, y) in itertools.combinations(sets, 2) if min(len(x), len(y)) >= least and len(x & y) / len(x | y) >= t}


@pytest.mark.parametrize(("t", "least", "vocabulary"), [(0.7, 6, 25), (0.5, 1, 12), (0.9, 2, 40)])
def test_sets(spark, t, least, vocabulary):
    r = random.Random(vocabulary)
    rows = [(i, [r.choice(["", " "]) + f"T{min(int(r.expovariate(0.2)), vocabulary)}" for _ in range(r.randint(0, 14))]) for i in range(250)]
    rows += [(300 + i, [f"t{j}" for j in range(8)] + ["T1 ", None, " "]) for i in range(30)] + [(400, None), (401, [None])] + [(402, [f"v{j}" for j in range(120)]), (403, [f"V{j}" for j in range(118)])]
    df = spark.createDataFrame(rows, "ord bigint, tags array<string>").withColumn("cid", F.lit(1)).withColumn("set", F.lit("x"))
    assert {tuple(p) for p in similar_sets(df, "ord", "tags", t, least).collect()} == brute(rows, t, least)


@pytest.mark.parametrize("top", [1, 2, 3, 4])
@pytest.mark.parametrize("t", [0.5, 0.7])
def test_small_sets_at_every_level(spark, monkeypatch, top, t):
    monkeypatch.setattr(setjoin, "_cost", lambda classes, levels, share: abs(len(levels.up_to) - top))
    rows = [(i, list(v)) for i, v in enumerate(v for n in range(1, 6) for v in itertools.combinations("abcdef", n))] + [(900 + n, [f"w{j}" for j in range(n)]) for n in range(20, 90, 5)]
    df = spark.createDataFrame(rows, "ord bigint, tags array<string>")
    assert {tuple(p) for p in similar_sets(df, "ord", "tags", t).collect()} == brute(rows, t, 1)


def test_sets_between_tables(spark):
    a = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["x"])], "k bigint, v array<string>")
    b = spark.createDataFrame([(7, ["A", "b", "c"]), (8, ["a", "b", "d"]), (9, None)], "k bigint, v array<string>")
    assert {tuple(p) for p in similar_sets(a, "k", "v", 0.9, right=b).collect()} == {(1, 7)}
    assert similar_sets(a.limit(0), "k", "v", 0.9).count() == 0


def words(title, text):
    return re.findall(r"[^\W_]+", f"{title or ''} {text or ''}".lower())


def versions(r, n):
    out = []
    for i in range(n):
        base = [r.choice("abcdefghij") + r.choice("klmnop") + str(r.randint(0, 60)) for _ in range(r.randint(30, 200))]
        for v in range(r.choice([1, 1, 2, 4])):
            ws = [w if r.random() > 0.02 * v * r.random() else "edit" for w in base]
            out.append((len(out), f"Title {i}", " ".join(ws)))
    return out


def test_near_duplicates_against_brute_force(spark):
    rows = versions(random.Random(9), 120)
    rows += [(1000 + i, "Same", "copy of one text " * 20) for i in range(40)] + [(2000, None, None), (2001, "t", ""), (2002, None, "SAME copy; of one text " * 20), (2003, "x", "word " * 100_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, title string, text string").withColumn("doc", F.lit(1)).withColumn("rep", F.lit(1))
    sets = {k: set(zip(w, w[1:], w[2:])) for k, t, x in rows if len(w := words(t, x)) >= 40}
    wanted = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.6}
    got = {tuple(p) for p in near_duplicate_pairs(df, "doc_id", "title", "text", 0.6, 3).collect()}
    assert got <= wanted and len(got) >= 0.99 * len(wanted) > 700
    groups = {r.doc_id: (r.group_id, r.n_links) for r in near_duplicate_groups(df, "doc_id", "title", "text", 0.6, 3).collect()}
    assert set(groups) == {r[0] for r in rows}
    assert {groups[k][0] for k in range(1000, 1040)} == {1000} and groups[2000] == (2000, 0)
    assert near_duplicate_pairs(df.limit(0), "doc_id", "title", "text").count() == 0


def test_a_hot_node_is_split(spark, monkeypatch):
    # 900 texts open and go on alike, 20 pairs of versions lie among them; every text is in one node of most trees
    from quillmesh.llm import pairs

    monkeypatch.setattr(pairs, "BLOCK", 50)
    r = random.Random(3)
    common = [f"c{i}" for i in range(200)]
    rows = [(i, None, " ".join(common + [f"w{r.randint(0, 10**6)}" for _ in range(190)])) for i in range(300)]
    rows += [(1000 + i, None, rows[i][2].rsplit(" ", 3)[0]) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id bigint, title string, text string")
    sets = {k: set(zip(w, w[1:], w[2:])) for k, t, x in rows if len(w := words(t, x)) >= 40}
    wanted = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.6}
    got = {tuple(p) for p in near_duplicate_pairs(df, "doc_id", "title", "text", 0.6, 3).collect()}
    assert got == wanted and len(wanted) >= 20


def test_pairs_of_one_key(spark):
    from quillmesh.llm.pairs import same_key_pairs

    rows = [(i, "hot" if i % 3 == 0 else None if i % 3 == 1 else f"k{i // 9}") for i in range(300)]
    got = [tuple(r) for r in same_key_pairs(spark.createDataFrame(rows, "id bigint, k string"), "k", "id", block=7).collect()]
    assert len(got) == len(set(got)) and set(got) == {(a, b) for (a, x), (b, y) in itertools.combinations(rows, 2) if x and x == y}


def test_prefix_is_shortened_to_the_recall():
    d = prefix_length(0.6)
    assert 1 - (1 - 0.6**d) ** 48 >= 0.995 > 1 - (1 - 0.6 ** (d + 1)) ** 48
