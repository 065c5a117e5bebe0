import pytest
from pyspark.sql import functions as F

from quillmesh.operators import alignments as A
from quillmesh.operators import reports


@pytest.mark.parametrize(
    ("raw", "wanted"),
    [
        ("Resolved to the Secretary of Commerce per SEC. 4", "the Secretary of Commerce"), ("Department of Energy or Department of State", None), ("not referenced", None), ("abc", None),
        ("Confirmed as Office of Audits inferred from title", "Office of Audits"), ("In SEC. 3, 'the Board' refers to Harbor Safety Board; see above", "Harbor Safety Board"),
        ("Refers to the Grid Agency.", "Grid Agency"), ("“Grid Agency”, appointed by the Board", "Grid Agency"), ("Grid Agency (used 3 times in text)", "Grid Agency"), ("grid agency", None), ("Authority to act", None),
        ("per SEC. 4", "per SEC. 4"), ("", None), (" \n", None), (None, None),
    ],
)
def test_canonical_name(spark, raw, wanted):
    assert spark.createDataFrame([(raw,)], "v string").select(A.canonical_name(F.col("v"))).first()[0] == wanted


def test_list_items(spark):
    got = spark.createDataFrame([("Office of Audits, Grants and Records",)], "v string").select(A.list_items(F.col("v"))).first()[0]
    assert got == ["Office of Audits", "Office of Grants", "Office of Records"]


def test_pre_resolve(spark):
    registry = spark.createDataFrame([(1, "o1", "organizations", "Harbor Safety Board", "HSB", ["Harbor Board"], 0.9), (2, "o2", "organizations", "Harbor Board", "", None, 0.5)], "ord bigint, entity_id string, entity_type string, canonical_name string, acronym string, aliases array<string>, confidence double")
    texts = spark.createDataFrame([(1, "The harbor safety board met; Harbor Boards did not, the Harbor Board did."), (2, None), (3, "")], "doc_id bigint, text string")
    assert [tuple(r) for r in A.pre_resolve(texts, "doc_id", "text", registry).collect()] == [(1, "o1", 4, 23)]


def test_budget_and_groups(spark):
    lines = spark.createDataFrame([("a", "xxxx", 1), ("a", "yyyy", 2), ("a", "zz", 3), ("b", "q" * 50, 1)], "g string, line string, o int")
    assert [tuple(r) for r in A.budgeted_context(lines, "g", "line", "o", 10).collect()] == [("a", 2, 10)]
    docs = spark.createDataFrame([(1, "u", "a;b"), (2, "u", "b; c"), (3, "", "x"), (4, None, None)], "ord bigint, link string, tags string")
    assert [tuple(r) for r in A.link_groups(docs).collect()] == [("u", 1, 2, 3)]


def test_dismiss_and_sample(spark):
    q = spark.createDataFrame([(1, "a"), (2, "b")], "id int, k string")
    assert [r.id for r in A.dismiss(q, q.where("id = 1"), ["id", "k"]).collect()] == [2]
    df = spark.range(1000)
    assert {r.id for r in A.sample(df, "id", 5, 42).collect()} == {r.id for r in A.sample(df.repartition(7), "id", 5, 42).collect()}


def test_html(spark):
    page = reports.page("T", [reports.html_table(spark.createDataFrame([("a<b", None)], "x string, y string"), "rows")])
    assert "a&lt;b" in page and "1 rows" in page
    assert reports.fragment("# H\n- a\n- b\n\ntext\n```\nx < y\n```") == "<h1>H</h1>\n<ul>\n<li>a</li>\n<li>b</li>\n</ul>\n<p>text</p>\n<pre><code>x &lt; y</code></pre>"

    made, missing = reports.dashboard("D", ["Fig A", "B"], {"Fig A": "<i/>"})
    assert missing == ["B"] and "id='fig-a'" in made and "<li>B</li>" in made
