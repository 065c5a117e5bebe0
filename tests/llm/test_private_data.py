import random

import pytest

from quillmesh.llm import private_data
from quillmesh.llm.private_data import addresses, emails, find_private, redact

FIRST = "Calder Ione Wren Petra Mabel Dorian Odalys Corwin".split()
LAST = [a + b for a in "Thorn Fen Sut Lorn Brack Quel".split() for b in "worth ley by born".split()]


def corpus(n=400):
    r = random.Random(1)
    out = []
    for i in range(n):
        f, l = r.choice(FIRST), r.choice(LAST)
        phone, ssn = f"(202) 555-0{r.randint(100, 199)}", f"9{r.randint(10, 99)}-{r.randint(10, 99)}-{r.randint(1000, 9999)}"
        kinds = [
            (f"Payee {f} {l}; ID {ssn}; phone {phone}.", [("name", f"{f} {l}"), ("id", ssn), ("phone", phone)]),
            (f"The Board met. Mr. {l} spoke.", [("name", l)]),
            (f"The record lists {f} {l} as the clerk.", [("name", f"{f} {l}")]),
            (f"Docket No. 2026-{r.randint(1000, 9999)}-897 stays open in the Marrow Bay Institute.", []),
            (f"For information contact: {l}, {f}, tel. {phone.replace('(', '').replace(') ', '-')}.", [("name", f"{l}, {f}"), ("phone", phone.replace("(", "").replace(") ", "-"))]),
            (f"Mail goes to 12 West Quarry Road, Apt. 3B, Lindrau, QA 00163 or to {f.lower()}.{l.lower()} [at] office.example now.", [("address", "12 West Quarry Road, Apt. 3B, Lindrau, QA 00163"), ("email", f"{f.lower()}.{l.lower()} [at] office.example")]),
        ]
        text, found = "", []
        for s, spans in r.sample(kinds, 4):
            for kind, value in spans:
                at = len(text) + s.index(value)
                found.append((i, kind, at, at + len(value)))
            text += s + "\n"
        out.append((i, text, found))
    return out


def test_planted_data_is_found(spark):
    docs = corpus()
    rows = [(i, t, r"en" if i % 5 else None, "clash") for i, t, _ in docs] + [(9000, None, "en", ""), (9001, "", None, ""), (9002, "Nothing here. " * 50_000, "EN", "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, kind string")
    wanted = {x for _, _, f in docs for x in f}
    got = {tuple(r) for r in find_private(df, "doc_id", "text", "lang").collect()}
    assert len(got & wanted) >= 0.98 * len(wanted)
    assert len(got - wanted) <= 0.02 * len(wanted)
    texts = {r.doc_id: r for r in redact(df, "doc_id", "text", "lang").collect()}
    assert texts[9000].text is None and texts[9001].text == "" and texts[9002].n_found == 0
    i, text, _ = docs[0]
    spans = sorted((s, e, k) for d, k, s, e in got if d == i)
    redone, at = "", 0
    for s, e, k in spans:
        redone += text[at:s] + f"[{k.upper()}]"
        at = e
    assert texts[i].text == redone + text[at:]


def test_lists_beyond_the_broadcast_lose_nothing(spark, monkeypatch):
    rows = [(i, t, "en") for i, t, _ in corpus(150)] + [(None, "The record lists Wren Lornley as the clerk.", "en")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    whole = {tuple(r) for r in find_private(df, "doc_id", "text", "lang").collect()}
    monkeypatch.setattr(private_data, "LISTED", 2)
    assert {tuple(r) for r in find_private(df, "doc_id", "text", "lang").collect()} == whole


def test_lower_case_names_in_many_contexts(spark):
    word = lambda i: "q" + "".join("abcdefghij"[int(c)] for c in f"{i:03}")
    rows = [(i * 30 + k, f"Then {word(i)} {word(i)} Wren Thornley went on. Mr. Thornley left.", "en") for i in range(80) for k in range(30)]
    rows += [(10_000 + i, f"then {word(i)} {word(i)} wren thornley went on", "en") for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    found = find_private(df, "doc_id", "text", "lang").where("doc_id >= 10000 AND kind = 'name'")
    assert found.select("doc_id").distinct().count() == 80


NAMED = private_data.Model({}, {}, frozenset(), frozenset({"lena", "jo"}), frozenset({"smith"}), frozenset({"signed by"}), frozenset({"signed it"}), given=frozenset({b"lena", b"jo"}))


@pytest.mark.parametrize(
    ("text", "name"),
    [
        ("signed by j. smith today", "j. smith"), ("signed by smith, j. today", "smith, j."), ("signed by smith, lena; and no one", "smith, lena"),
        ("İ was there, signed by lena smith today", "lena smith"), ("here (lena smith signed it)", "lena smith"), ("and lena smith signed it", "lena smith"),
        ("at the Office of Lena Smith in town", "Lena Smith"), ("at the Office of Mr. Smith in town", "Smith"), ("the Bureau of Grid Smith in town", None),
        ("Dale Moss sat. He ran the Office of Lena Smith in town", "Lena Smith"),
    ],
)
def test_names_of_given_lists(text, name):
    found = [text[s:e] for _, s, e in private_data.find(text, "en", NAMED)]
    assert found == ([name] if name else [])


def test_given_names_of_two_letters(spark):
    rows = [(i, f"Mr. {n} spoke. The record lists Jo {n} as the clerk, and J. {n}.", "en") for i, n in enumerate(LAST * 10)]
    model, rest = private_data.learn(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), "doc_id", "text", "lang")
    assert "jo" in model.first and "j." not in model.first and rest is None


def test_learned_signs_and_forms(spark):
    word = lambda i: "".join("bdfgklmnpr"[int(c)] + "aeiou"[int(c) % 5] for c in f"{i:03}")
    rows = [(i, f"Please write {word(i)}@office.example today. The claimant lives at {i} {word(i).title()} Street, Lindrau, QA 00{i + 100}.", "en") for i in range(200)]
    rows += [(1000 + i, f"Please write {word(i)} [chez] office.example today. See rule 5 (old) text.Then go.", "en") for i in range(20)]
    rows += [(2000 + i, f"The claimant lives at {word(i).title()} Mews, {i}, Lindrau, QA 00{i + 100} now. The Fund holds Tranche {i}, Series 00{i + 300} now.", "en") for i in range(20)]
    got = {(r.doc_id, r.kind, r.char_start, r.char_end) for r in find_private(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), "doc_id", "text", "lang").collect()}
    for d, t, _ in rows:
        kinds = {(k, t[s:e]) for i, k, s, e in got if i == d}
        if d < 2000:
            assert ("email", t[13 : t.index(" today")]) in kinds and len([k for k, _ in kinds if k == "email"]) == 1, (t, kinds)
        else:
            assert [v for k, v in kinds if k == "address"] == [t[22 : t.index(" now")]], (t, kinds)


def test_a_run_is_read_once(monkeypatch):
    calls, parts = [], private_data._parts
    monkeypatch.setattr(private_data, "_parts", lambda *a: calls.append(a) or parts(*a))
    text = "then Mr. Quelborn spoke of the National Council of Lindrau. " * 50
    found = list(private_data.runs(text, False))
    assert len(found) == 50 and len({(r.start - i * 60, *r.words, r.seed) for i, r in enumerate(found)}) == 1
    assert len(calls) <= 2


def test_texts_told_of_given_names(monkeypatch):
    given = frozenset(w.encode() for w in ("ione", "jo", "côme", "óñ", "élodie", "x" * 70))
    model = NAMED._replace(given=given)
    texts = [None, "", "ione", "an ion", "Ione", "(ione)", "ionel", "so jo-ann", "jo", "«jo»", "ajo", "the ion e", "côme", "came", "l’élodie", "x" * 70, "x" * 71, "jo" + "y" * 50, "ó ñ", "óñ", "plain " * 9]
    texts += [t + s for t in texts if t for s in ("", " ione", "\nÀ jo.")]
    for names in (given, given - {"óñ".encode()}, frozenset()):
        for most in (1 << 20, 20):
            monkeypatch.setattr(private_data.GivenNames, "AT_ONCE", most)
            told = private_data.GivenNames(names).told(texts)
            assert all(x for t, x in zip(texts, told) if t and private_data._holds_given(t, model._replace(given=names)))
            assert not any(told[:2]) and (most == 20 or not told[3] and not told[20])


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string, lang string")
    assert find_private(df, "doc_id", "text", "lang").count() == 0


@pytest.mark.parametrize("text", ["write a.b+c@mail.x-gov.test.", "A_B@X.EXAMPLE", "p@ office.invalid;", "q (at) mail.test", "r-s [at] mail [dot] x [dot] invalid"])
def test_emails(text):
    (s, e), = emails(text)
    assert text[s:e] == text.removeprefix("write ").rstrip(".;")


@pytest.mark.parametrize("text", ["1387 West Fenwick Avenue #29, Pontreau, QA 00939", "95 bis, avenue Verriers,\n99955 Eastmere", "Am Torfgraben 4b, D-99960 Quenby", "C/ Alameda, 51, 2.º B, 99396 Dunmarrow", "Gerberstraße 63b, 99263 Brasdorf"])
def test_addresses(text):
    lead = "The claimant lives at "
    (s, e), = addresses(lead + text + " and more.")
    assert (lead + text + " and more.")[s:e] == text
