from datetime import datetime

import pytest

from quillmesh.operators.orphans import catalogue_states, orphan_counts, orphan_rows, references
from quillmesh.operators.packed import split_packed

NAMES = ["Treaties; accords", 'Curators\' "short list"', "Defense/dual-use", "Rules, circulars, and memoranda"]


def items(spark, *fields):
    df = spark.createDataFrame([(i, f, "x") for i, f in enumerate(fields)], "ord bigint, tags string, item string")
    rows = split_packed(df, "ord", ["tags"], NAMES).orderBy("ord", "item_pos").collect()
    return {i: [r.item for r in rows if r.ord == i] for i in range(len(fields))}


@pytest.mark.parametrize(
    ("field", "wanted"),
    [
        (None, []),
        ("", []),
        ("  \t ", []),
        ("a;b , c|d\te\nf", ["a", "b", "c", "d", "e", "f"]),
        (" a ;; b;", ["a", "b"]),
        ("a;a", ["a", "a"]),
        ('"x; y", z', ["x; y", "z"]),
        ('"say ""hi""; ok";b', ['say "hi"; ok', "b"]),
        ("'x; y'|b", ["x; y", "b"]),
        ('["a", "b, c", "say \\"hi\\""]', ["a", "b, c", 'say "hi"']),
        ('["caf\\u00e9; x"]', ["café; x"]),
        ("Treaties; accords|b", ["Treaties; accords", "b"]),
        ("treaties; accords / b", ["treaties; accords", "b"]),
        ("Defense/dual-use/b", ["Defense/dual-use", "b"]),
        ('Curators\' "short list"; b', ['Curators\' "short list"', "b"]),
        ('"open; b', ['"open', "b"]),
        ("0; b", ["0", "b"]),
        ('"x;y";0', ["x;y", "0"]),
        ('"";b', ["b"]),
    ],
)
def test_packed(spark, field, wanted):
    assert items(spark, field)[0] == wanted


def test_packed_long_and_empty(spark):
    long = '"' + "x;" * 200_000 + '";b'
    assert items(spark, long)[0] == ["x;" * 200_000, "b"]
    empty = spark.createDataFrame([], "ord bigint, tags string")
    assert split_packed(empty, "ord", ["tags"], NAMES).count() == 0


def at(month, day=1):
    return datetime(2021, month, day)


def brute(refs, catalogue):
    out = []
    for table, ord_, key, t in refs:
        try:
            k = int(float(key.strip()))
        except (AttributeError, ValueError):
            continue
        docs = [c for c in catalogue if c[0] and int(float(c[0])) == k]
        gone = [c[2] for c in docs if c[2]]
        if not docs:
            kind = "missing"
        elif t and gone and min(gone) <= t:
            kind = "deleted"
        elif t and min(c[1] for c in docs) > t:
            kind = "late"
        else:
            continue
        out.append((table, ord_, kind, t.strftime("%Y-%m") if t else None))
    return sorted(out, key=str)


def test_orphans(spark):
    catalogue = [("1", at(1), None), (" 2.0", at(3), at(6)), ("2", at(4), None), ("0003", at(5), None), (None, at(1), None)]
    keys = ["1", "\t1", "2", "2.0 ", "3", "9", "", None, "x", "1"]
    a = [(i, keys[i % 10], at(1 + i % 9, 1 + i % 28) if i % 7 else None, "clash") for i in range(400)] + [(500 + i, "2", at(6, 1 + i % 28), "c") for i in range(300)]
    cat = spark.createDataFrame(catalogue, "doc_id string, loaded_at timestamp_ntz, deleted_at timestamp_ntz")
    refs_df = spark.createDataFrame(a, "ord bigint, doc_id string, loaded_at timestamp_ntz, kind string")
    refs, states = references({"t": refs_df}), catalogue_states(cat)
    wanted = brute([("t", r[0], r[1], r[2]) for r in a], catalogue)
    assert sorted((tuple(r) for r in orphan_rows(refs, states).collect()), key=str) == wanted
    counts = {(r.table_name, r.period, r.kind): r.n_rows for r in orphan_counts(refs, states).collect()}
    assert sum(counts.values()) == len(wanted)
    assert counts[("t", "2021-06", "deleted")] == sum(1 for w in wanted if w[2:] == ("deleted", "2021-06"))
    none = spark.createDataFrame([], refs_df.schema)
    assert orphan_rows(references({"t": none}), states).count() == 0
    assert orphan_rows(refs, catalogue_states(spark.createDataFrame([], cat.schema))).where("kind <> 'missing'").count() == 0
