import random

from quillmesh.llm.split import cuts, openings, pieces, section_openings


def starts(text):
    return [text[i : i + 12] for i in openings(text)]


def test_forms():
    for line in ["SEC. 2A. FINDINGS.—", "§ 3. Sunset.", "§ 7 Vergabe", "TITLE IV—ENFORCEMENT", "[Sec. 6] Effective date", "## 12. Findings", "Section One. Advisory committee.—", "Article 7. — Objet", "Sección 4.ª Objeto", "ARTICULO 9.- OBJETO", "Kapitel I – Zweck", "Disposición 13. Revisión"]:
        assert openings(f"Intro text.\n\n{line}\n\nIts own text follows here.") == [13], line
        assert openings(f"﻿  {line}\nText follows.") == [3], line


def test_no_openings():
    for text in [
        "The rule\nSECTION 6 above. It goes on.",
        "as published under\nArticle VI. As published in FR Doc. 23-207, it holds.\nMore.",
        "Text.\n\n“SEC. 6085. REPORTING REQUIREMENTS.\n\nQuoted text.",
        "« Article 3254. — Financement\n\nTexte.",
        "Table of contents\nSEC. 1. A thing\nSEC. 2. Other thing\n\nA preamble follows here.",
        "Text.\n\nSEC. 9. LAST ONE.",
        "",
    ]:
        assert openings(text) == [], text


def test_contents_before_the_first_section():
    text = "Table of contents\nSEC. 1. Findings\nSEC. 2. Sunset\n\nSEC. 1. Findings\nText one.\n\nSEC. 2. Sunset\nText two."
    assert openings(text) == [text.index("SEC. 1. Findings\nText"), text.index("SEC. 2. Sunset\nText")]


def test_cuts_prefer_sections():
    text = "".join(f"SEC. {i}. FINDINGS.\n\n" + "word word. " * 60 + "\n\n" for i in range(1, 20))
    got = cuts(text, 3000, 100)
    assert got and set(got) <= set(openings(text))


def test_cuts_are_bounded():
    r = random.Random(4)
    for text in ["x" * 9999, "", "a b " * 5000, "\n" * 8000, "".join(r.choices("ab .\n", k=20_000))]:
        e = [0, *cuts(text, 1000, 100), len(text)]
        assert all(b - a <= 900 for a, b in zip(e, e[1:])) or len(text) <= 1000


def test_pieces(spark):
    text = "\n\n".join("Sentence number %d. " % i * 5 for i in range(200))
    df = spark.createDataFrame([(1, text, 0), (2, "short", 0), (3, None, 0), (4, "", 0), (5, "é" * 7000, 0)], "doc_id bigint, text string, piece int")
    rows = pieces(df, "doc_id", "text", 1000, 50).orderBy("doc_id", "piece").collect()
    assert {r.doc_id for r in rows} == {1, 5}
    for d, whole in ((1, text), (5, "é" * 7000)):
        mine = [r for r in rows if r.doc_id == d]
        assert mine[0].char_start == 0 and mine[-1].char_end == len(whole)
        assert all(len(r.text) <= 1000 and whole[r.char_start : r.char_end] == r.text for r in mine)
        assert all(b.char_start == a.char_end - 50 for a, b in zip(mine, mine[1:]))
    assert [r.text for r in pieces(df, "doc_id", "text", 1000, 50, whole=True).where("doc_id IN (2, 4)").orderBy("doc_id").collect()] == ["short", ""]
    assert section_openings(spark.createDataFrame([], df.schema), "doc_id", "text").count() == 0
