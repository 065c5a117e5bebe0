import pytest

from quillmesh.llm.canonical_map import UNMATCHED, Reference, load_reference, map_names, misses
from quillmesh.llm.names import Lookup, acronym_of, distance, fold, words
from quillmesh.llm.variants import variant_pairs

ROWS = [
    ("o1", "Center for Harbor Safety in Zorfaltolter", "ZOHSC", ["Zorfaltolter Harbor Center", "Department of Labor Transition of Senbalralral"]),
    ("o2", "Directorate of Crop Genetics, Renvascorros", "", None),
    ("o3", "Halvashaltol Consumer Redress Board", "HACRB", []),
    ("o4", "Bureau of Ballemvaskir Grid Resilience", "BAGRB", []),
    ("o5", "Lemjorzelwen Sensor Standards Authority", None, ["", None]),
    ("o6", "Department of Grid Safety of Mardornaljor", "MAGSD", []),
    ("o7", "Center for Crop Standards in Velbalvinost", "VECSC", []),
    ("o8", "Tolgarvinnes Labor Board", "TOLB", []),
    ("o9", "Directorate of Sensor Genetics, Quensalterlan", "QUSGD", []),
    ("o10", "Consumer Transition Authority of Pormirsultol", "POCTA", []),
    ("o11", "Bureau of Corhalbersen Redress Resilience", "CORRB", []),
]
NAMES = {
    "Center for Harbor Safety in Zorfaltolter": "o1", "  CENTER FOR HARBOR  SAFETY IN ZORFALTOLTER's": "o1", "Ctr. for Harbor Sfty in Zörfaltolter": "o1",
    "the Zorfaltotler Harbor Center": "o1", "Department of Labor Transition of Senbalralral (ZOHSC)": "o1", "Z.O.H.S.C.": "o1", "the zohsc": "o1",
    "Crop Directorate Renvascorros": "o2", "Halvashaltol Consumer Redress Bd.": "o3", "Bur. of Ballemvaskir Grid Resilience": "o4", "Dir'ate of Crop Genetics (Renvascorros)": "o2",
    "Zorfaltolter Grid Board": UNMATCHED, "agency": UNMATCHED, "XXXXX": UNMATCHED, "": UNMATCHED, "Office of Audits of the Halvashaltol Consumer Redress Board": UNMATCHED, "a" * 5000: UNMATCHED,
}


@pytest.mark.parametrize("name", NAMES)
def test_find(name):
    assert Reference(ROWS).find(name) == NAMES[name]


def test_words_and_distance():
    assert words(fold("The Bur. of  Ört’s Dir'ate")) == ["bur.", "ort", "dir'ate"]
    assert acronym_of("z.o.h.s.c.") == "zohsc" and acronym_of("harbor safety") == ""
    assert distance("board", "baord") < 1 < distance("board", "bxxrd")
    look = Lookup(["zorfaltolter", "board"])
    assert [w for w, _ in look.near("zorfaltotlre")] == ["zorfaltolter"] and look.near("brd") == []


def test_mapping(spark):
    ref = load_reference(spark.createDataFrame(ROWS, "entity_id string, canonical_name string, acronym string, aliases array<string>"), "entity_id", "canonical_name", "acronym", "aliases")
    df = spark.createDataFrame([(i, n, "clash") for i, n in enumerate([*NAMES, None])], "i int, name string, entity_id string")
    got = {r.name: r.entity_id for r in map_names(df, "name", ref).collect()}
    assert got == NAMES | {None: UNMATCHED}
    assert map_names(df.limit(0), "name", ref).count() == 0
    assert misses(map_names(df, "name", ref), "name").count() == sum(v == UNMATCHED for v in NAMES.values()) + 1


def test_other_names_by_share(spark):
    ref = load_reference(spark.createDataFrame(ROWS, "entity_id string, canonical_name string, acronym string, aliases array<string>"), "entity_id", "canonical_name", "acronym", "aliases")
    typo = "Department of Labor Transition of Senbalarlral"
    typed = {typo: "o1", typo.upper(): "o1", "The " + typo: "o1", "Dept. of Labor Transition of Senbalarlral": "o1", "Department of Labor Trans. of Senbalarlral": "o1"}
    other = {n: UNMATCHED for n in ["Ballemvaskor Labor Board", "Ballemvaskor Consumer Authority", "Ballemvaskor Sensor Council", "Bureau of Ballemvaskor Grid Resilience"]}
    exact = {"Department of Labor Transition of Senbalralral": "o1", "Bureau of Ballemvaskir Grid Resilience": "o4"}
    for times in (1, 40):
        df = spark.createDataFrame([(n,) for n in [*typed, *other, *exact] for _ in range(times)], "name string")
        assert {r.name: r.entity_id for r in map_names(df, "name", ref).collect()} == typed | other | exact


ANNOTATIONS = [
    (1, "d1", "organizations", "Zorfaltolter Harbor Safety Center", None, "ZOHSC"),
    (2, "d1", "organizations", "ZOHSC", None, None),
    (3, "d2", "organizations", "Ctr. for Harbor Sfty in Zörfaltolter", None, ""),
    (4, "d2", "organizations", "Center for Harbor Safety in Zorfaltoltre", None, None),
    (5, "d2", "organizations", "Zorfaltolter Grid Resilience Board", None, None),
    (6, "d3", "organizations", "ZOHSC", None, "ZOHSC"),
    (7, "d3", "organizations", "z.o.h.s.c.", None, None),
    (8, "d1", "offices", "Office of Audits, Center for Harbor Safety in Zorfaltolter", None, None),
    (9, "d1", "offices", "Zorfaltolter Harbor Safety Center Office of Audits", None, None),
    (10, "d1", "offices", "Office of Grants of the Zorfaltolter Harbor Center", None, None),
    (11, "d1", "roles", None, "Chair of the Center for Harbor Safety in Zorfaltolter", None),
    (12, "d1", "roles", None, "Zorfaltolter Harbor Safety Center - Chairperson", None),
    (13, "d1", "roles", None, "Vice Chair, Center for Harbor Safety in Zorfaltolter", None),
    (14, "d1", "roles", None, "Commissioner Dorothea Carthondor", None),
    (15, "d4", "roles", None, "Dot Carthondor, Commr.", None),
    (16, "d4", "roles", None, "Carthondor, Dorothea (Commissioner)", None),
    (17, "d4", "roles", None, "COMMISSIONER D. CARTHONDOR", None),
    (18, "d4", "roles", None, "Commissioner William Tarvitlow", None),
    (19, "d4", None, None, None, None),
    (20, None, "organizations", "", None, None),
]
LINKED = [{1, 2, 3, 4}, {6, 7}, {8, 9}, {11, 12}, {14, 15, 16, 17}]


def test_variants(spark):
    vocabulary = Reference(ROWS).common.frequency
    df = spark.createDataFrame(ANNOTATIONS, "annotation_id bigint, doc_id string, entity_type string, name string, title string, acronym string")
    columns = ("annotation_id", "doc_id", "entity_type", "name", "title", "acronym")
    wanted = {(a, b) for g in LINKED for a in g for b in g if a < b}
    assert {tuple(r) for r in variant_pairs(df, vocabulary, *columns).collect()} == wanted
    assert variant_pairs(df.limit(0), vocabulary, *columns).count() == 0


def test_grams_are_not_broadcast(spark, tmp_path, monkeypatch):
    from quillmesh.llm import variants

    names = ["zorfaltolter", "zorfaltotler", "halvashaltol", "lemjorzelwen"]
    spark.createDataFrame([(i, "body", w) for i, w in enumerate(names)], "tid bigint, grp string, rare string").write.parquet(str(tmp_path / "words"))
    plans, write = [], variants.materialize
    monkeypatch.setattr(variants, "materialize", lambda df, label: (plans.append(df._jdf.queryExecution().executedPlan().toString()), write(df, label))[1])
    assert [tuple(r) for r in variants.near_words(spark.read.parquet(str(tmp_path / "words")), "tid", "grp", "rare").collect()] == [(0, 1)]
    assert len(plans) == 1 and "Broadcast" not in plans[0]
