"""Queries that cross the tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmesh.functions.ids import entity_id
from quillmesh.operators import alignments as A
from quillmesh.operators import legislators as L
from quillmesh.operators import networks as N
from quillmesh.operators.entities import mentions
from quillmesh.plans.data_quality import _NUMBER
from quillmesh.plans.graphs import _FACTS, _T, _area_graph, _pairs
from quillmesh.plans.records import _MENTIONS, _PREFIX, _SLUG, _STRIP, _TAGS, _W
from quillmesh.session import materialize
from quillmesh.sources.tables import table

KEYWORDS = ["board", "agency", "department", "council", "bureau", "commission"]


def _t(name):
    return lambda s, d: table(s, d, name)


people, records, segments, documents, registry = (_t(n) for n in ("cosponsor_rows", "entity_record", "segments_raw", "documents_raw", "registry"))


def seeded(s, d):
    m = mentions(records(s, d)).select(entity_id(F.col("name"), F.col("kind")).alias("entity_id"), "name", "kind", F.lit("").alias("acronym")).distinct()
    g = table(s, d, "manual_annotations").where("entity_type = 'organizations' AND trim(coalesce(name, '')) <> ''")
    g = g.select(entity_id(F.col("name"), F.col("entity_type")).alias("entity_id"), "name", F.col("entity_type").alias("kind"), F.coalesce("acronym", F.lit("")).alias("acronym")).distinct()
    return A.seed_registry(m, g).select("entity_id", "canonical_name", "entity_type", "confidence", "n_names")


def pca_features(s, d):
    e = _area_graph(s, d)
    f = L.clustering(e).join(N.betweenness(e), "node")
    return A.principal_components(f, "node", ["degree", "betweenness", "clustering"])


def canonical_names(s, d):
    m = records(s, d).select("record_id", F.explode("disambiguation_updates").alias("phrase", "meaning"))
    return m.select("record_id", "phrase", A.canonical_name(F.col("meaning")).alias("name"))


def memory_context(s, d):
    m = mentions(records(s, d)).groupBy("kind", "name").agg(F.count("*").alias("n"))
    lines = m.select("kind", F.format_string("- %s (%d)", "name", "n").alias("line"), (-F.col("n")).alias("o"))
    return A.budgeted_context(lines, "kind", "line", "o")


def community_profile(s, d):
    pairs = _pairs(s, d)
    found = materialize(N.communities(pairs, "louvain"), "communities")
    who = L.breadth_depth(people(s, d), documents(s, d))
    size = N.member_centrality(pairs, found).groupBy("community").agg(F.first("size").alias("size"), F.avg("centrality").alias("mean_centrality"))
    mix = found.join(who, F.col("node") == F.col("person")).groupBy("community").agg(
        F.count_if(F.col("party") == "D").alias("n_d"), F.count_if(F.col("party") == "R").alias("n_r"), F.countDistinct("state").alias("n_states"), F.sum("n_docs").alias("n_docs")
    )
    return size.join(mix, "community")


def review_accept(s, d):
    r = records(s, d)
    queue = mentions(r).where("kind = 'organizations' AND lower(name) IN ('agency', 'the board')").select(F.col("doc").alias("doc_id"), "name").distinct()
    accepted = queue.where("lower(name) = 'agency'").withColumn("canonical", F.lit("Agency (unnamed)"))
    out = A.accept_canonical(r, accepted).select("record_id", F.explode("organizations.name").alias("name"))
    return out.where("lower(name) IN ('agency', 'the board', 'agency (unnamed)')").groupBy("name").agg(F.count("*").alias("n"))


QUERIES = {
    "sponsor_summary": lambda s, d: A.sponsor_summary(people(s, d), documents(s, d)),
    "sponsor_bills": lambda s, d: A.sponsor_bills(people(s, d), documents(s, d)),
    "url_bill_tags": lambda s, d: A.link_group_tags(documents(s, d)),
    "tag_party_alignment": lambda s, d: A.tag_party_alignment(segments(s, d), people(s, d)),
    "entity_tag_cooccurrence": lambda s, d: A.entity_tags(records(s, d), segments(s, d), "harms", 2),
    "role_domain_top3": lambda s, d: A.role_domains(records(s, d), segments(s, d)),
    "party_skew_entities": lambda s, d: A.entity_parties(records(s, d), people(s, d)),
    "cosponsor_entities": lambda s, d: A.person_entities(people(s, d), records(s, d)),
    "url_bill_groups": lambda s, d: A.link_groups(documents(s, d)),
    "keyword_histogram": lambda s, d: A.department_histogram(registry(s, d), "canonical_name", KEYWORDS),
    "registry_seed": seeded,
    "merge_chunks": lambda s, d: A.merged_records(records(s, d)),
    "review_accept": review_accept,
    "memory_context": memory_context,
    "canonical_name_extract": canonical_names,
    "pre_resolve_spans": lambda s, d: A.pre_resolve(table(s, d, "documents"), "doc_id", "text", registry(s, d)),
    "fingerprint_similarity": lambda s, d: A.fingerprints(people(s, d), segments(s, d), every=50),
    "pca_features": pca_features,
    "community_profile": community_profile,
    "seeded_sample": lambda s, d: A.sample(table(s, d, "documents").select("doc_id"), "doc_id", 20, 42),
}

_MODE = f", pm AS (SELECT doc, party FROM (SELECT doc, trim(party) AS party, count(*) AS n, min(ord) AS o FROM facts WHERE {_T('party')} <> '' GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY doc ORDER BY n DESC, o) = 1)"
_NAMED = f", nm AS (SELECT DISTINCT {_NUMBER.replace('doc_id', 'doc')} AS doc, kind, lower(trim(name)) AS name FROM men), named AS (SELECT * FROM nm WHERE doc IS NOT NULL)"
_BOTH = _TAGS.rstrip() + "," + _FACTS.replace("WITH ", "", 1).strip()
_ALL = _MENTIONS.rstrip() + "," + _TAGS.replace("WITH ", "", 1).strip() + "," + _FACTS.replace("WITH ", "", 1).strip() + _MODE + _NAMED



def _canonical(c: str) -> str:
    """The SQL of ``canonical_name``."""
    quote = lambda t: "'" + t.replace("'", "''") + "'"
    text = _STRIP(f"coalesce({c}, '')")
    bare = text
    for p in A.PREAMBLES:
        bare = f"regexp_replace({bare}, {quote('(?i)^' + p)}, '')"
    t = f"CASE WHEN regexp_matches({text}, {quote('(?i)' + A.QUOTED)}) THEN {_STRIP(f'regexp_extract({text}, ' + quote('(?i)' + A.QUOTED) + ', 1)')} ELSE {bare} END"
    t = f"regexp_replace({t}, {quote(f'^[{A.QUOTES}]+')}, '')"
    t = f"list_reduce([{t}, {', '.join(quote(b) for b in A.BOUNDARIES)}], lambda t, b: CASE WHEN strpos(lower(t), lower(b)) > 1 THEN substr(t, 1, strpos(lower(t), lower(b)) - 1) ELSE t END)"
    t = f"regexp_replace({t}, {quote('(?i)' + A.NOISE)}, '')"
    end = f"[{A.QUOTES},.\\-{_W[1:]}+$"
    t = _STRIP(f"regexp_replace({t}, {quote(end)}, '')")
    skipped = " OR ".join(f"starts_with(lower({text}), {quote(p)})" for p in A.SKIPPED)
    bad = " OR ".join(f"starts_with(lower(n), {quote(p)})" for p in A.NO_NAME)
    return f"(SELECT CASE WHEN {text} = '' OR {skipped} OR regexp_matches(n, {quote(A.EITHER)}) OR length(n) < 4 OR NOT regexp_matches(n, '\\p{{Lu}}') OR {bad} THEN NULL ELSE n END FROM (SELECT {t} AS n))"


SQL = {
    "sponsor_summary": _FACTS
    + ", f AS (SELECT DISTINCT person, doc, coalesce(area, '') AS area FROM fa), c AS (SELECT person, area, count(*) AS n FROM f WHERE area <> '' GROUP BY ALL), "
    + "t AS (SELECT person, string_agg(area || ' (' || n || ')', '; ' ORDER BY n DESC, area) AS top_areas FROM (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY person ORDER BY n DESC, area) <= 3) GROUP BY person) "
    + "SELECT person, count(*) AS n_bills, coalesce(any_value(top_areas), '') AS top_areas FROM f LEFT JOIN t USING (person) GROUP BY person",
    "sponsor_bills": _FACTS + "SELECT DISTINCT person, doc, coalesce(area, '') AS area FROM fa",
    "url_bill_tags": f"WITH r AS (SELECT {_T('link')} AS link, tags FROM documents_raw WHERE {_T('link')} <> '') SELECT DISTINCT link, t AS tag FROM (SELECT link, trim(unnest(string_split(coalesce(tags, ''), ';'))) AS t FROM r WHERE link IN (SELECT link FROM r GROUP BY link HAVING count(*) > 1)) WHERE t <> ''",
    "tag_party_alignment": _BOTH + _MODE + ", n AS (SELECT tag, party, count(*) AS n FROM dt JOIN pm USING (doc) GROUP BY ALL) SELECT tag, party, n, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY tag) AS share FROM n",
    "entity_tag_cooccurrence": _ALL + " SELECT kind, name, tag, count(*) AS n_docs FROM named JOIN dt USING (doc) WHERE grp = 'harms' GROUP BY ALL HAVING count(*) >= 2",
    "role_domain_top3": _ALL + ", n AS (SELECT name, tag, count(*) AS n_docs FROM named JOIN dt USING (doc) WHERE grp = 'strategies' AND kind = 'roles' GROUP BY ALL) SELECT name, CAST(row_number() OVER (PARTITION BY name ORDER BY n_docs DESC, tag) AS INTEGER) AS rank, tag, n_docs FROM n QUALIFY rank <= 3",
    "party_skew_entities": _ALL + ", c AS (SELECT kind, name, count(*) FILTER (party = 'D') AS n_d, count(*) FILTER (party = 'R') AS n_r FROM named JOIN pm USING (doc) GROUP BY ALL) SELECT *, greatest(n_d, n_r) >= 10 AND (CASE WHEN n_d + n_r = 0 THEN 0 ELSE least(n_d, n_r) / CAST(n_d + n_r AS DOUBLE) END) < 0.1 AS skewed FROM c",
    "cosponsor_entities": _ALL + " SELECT person, name, count(*) AS n_docs FROM (SELECT DISTINCT doc, person FROM facts) JOIN (SELECT DISTINCT doc, name FROM named WHERE kind = 'organizations') USING (doc) GROUP BY ALL HAVING count(*) >= 2",
    "url_bill_groups": f"WITH r AS (SELECT {_T('link')} AS link, ord, list_filter(list_transform(string_split(coalesce(tags, ''), ';'), lambda x: trim(x)), lambda x: x <> '') AS ts FROM documents_raw WHERE {_T('link')} <> '') SELECT link, min(ord) AS first_ord, count(*) AS n_rows, CAST(len(list_distinct(flatten(list(ts)))) AS INTEGER) AS n_tags FROM r GROUP BY link HAVING count(*) > 1",
    "keyword_histogram": "SELECT CASE " + " ".join(f"WHEN contains(lower(canonical_name), '{k}') THEN '{k}'" for k in KEYWORDS) + " ELSE 'Other' END AS keyword, count(*) AS n FROM registry GROUP BY 1",
    "registry_seed": _MENTIONS
    + f", s AS (SELECT DISTINCT {_PREFIX.replace('{k}', 'kind')} || ':' || {_SLUG('name')} AS entity_id, name, kind, 0.9 AS confidence, 1 AS stage FROM men UNION ALL "
    + f"SELECT DISTINCT 'org:' || {_SLUG('name')}, name, entity_type, 1.0, 2 FROM manual_annotations WHERE entity_type = 'organizations' AND trim(coalesce(name, '')) <> '' UNION ALL "
    + " UNION ALL ".join(f"SELECT 'org:{n.lower().replace(' ', '_')}', '{n}', 'organizations', 1.0, 0" for n in A.SEEDS)
    + ") SELECT entity_id, arg_max(name, (confidence, stage, name)) AS canonical_name, arg_max(kind, (confidence, stage, name)) AS entity_type, CAST(max(confidence) AS DOUBLE) AS confidence, CAST(count(DISTINCT name) AS INTEGER) AS n_names FROM s GROUP BY entity_id",
    "merge_chunks": _MENTIONS
    + ", f AS (SELECT doc, kind, lower(trim(name)) AS low, arg_min(name, (record_id, pos)) AS name, count(*) AS n FROM men GROUP BY 1, 2, 3), a AS (SELECT DISTINCT trim(doc_id) AS doc, lower(trim(unnest(map_keys(disambiguation_updates)))) AS low FROM entity_record) "
    + "SELECT doc, kind, name, n FROM f WHERE NOT (EXISTS (SELECT 1 FROM a WHERE a.doc = f.doc AND a.low = f.low) AND EXISTS (SELECT 1 FROM f g WHERE g.doc = f.doc AND g.kind = f.kind AND g.low <> f.low AND contains(g.low, f.low)))",
    "canonical_name_extract": "WITH d AS (SELECT record_id, unnest(map_entries(disambiguation_updates)) AS e FROM entity_record), r AS (SELECT record_id, e.key AS phrase, e.value AS meaning FROM d) SELECT record_id, phrase, " + _canonical("meaning") + " AS name FROM r",
    "memory_context": _MENTIONS
    + ", m2 AS (SELECT kind, '- ' || name || ' (' || count(*) || ')' AS line, -count(*) AS o FROM men GROUP BY kind, name), r AS (SELECT kind, sum(length(line) + 1) OVER (PARTITION BY kind ORDER BY o, line ROWS UNBOUNDED PRECEDING) AS length FROM m2) SELECT kind, count(*) AS n_lines, CAST(max(length) AS BIGINT) AS n_chars FROM r WHERE length <= 6000 GROUP BY kind",
    "review_accept": "WITH n AS (SELECT unnest(organizations).name AS name FROM entity_record) SELECT CASE WHEN lower(trim(name)) = 'agency' THEN 'Agency (unnamed)' ELSE name END AS name, count(*) AS n FROM n WHERE lower(name) IN ('agency', 'the board') GROUP BY 1",
}
