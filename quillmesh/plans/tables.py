"""Queries of normalised tables, profiles and subgraphs, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmesh.operators import graph as G
from quillmesh.operators import legislators as L
from quillmesh.operators import networks as N
from quillmesh.operators import normalise as R
from quillmesh.operators import profiles as P
from quillmesh.operators import subgraphs as S
from quillmesh.operators.taxonomy import segment_tags
from quillmesh.plans.crossings import _ALL, documents, people, records, registry, segments
from quillmesh.plans.data_quality import _NUMBER
from quillmesh.plans.graphs import _KG, _LONG, _T, _pairs, _rows
from quillmesh.plans.records import _SLUG
from quillmesh.session import materialize
from quillmesh.sources.tables import table

EGO, NODE, DOCUMENT = "collection:treaties", "authority:united_assembly", "document:1"


def _docs(s, d):
    return R.documents(documents(s, d), table(s, d, "authorities"))


def _tags(s, d):
    return segment_tags(segments(s, d)).where("doc IS NOT NULL").select("doc", "tag").distinct()


def _catalogue(s, d):
    return _docs(s, d).select(F.col("doc_id").alias("doc")).distinct()


def _states(s, d):
    """Groups of people: those whose first row has one state."""
    first = L.facts(people(s, d)).groupBy("person").agg(F.min_by(F.trim(F.coalesce("state", F.lit(""))), "ord").alias("grp"))
    return first.where("grp <> ''").select("grp", "person")


def _members(s, d):
    """People with the party of their first row."""
    return L.person_nodes(people(s, d)).select(F.expr("substring(node_id, 9)").alias("node"), "party")


def _graph(s, d):
    rows = _rows(s, d)
    return materialize(G.graph_nodes(rows), "nodes"), materialize(G.graph_edges(rows).select("src_id", "relation", "dst_id"), "graph-edges")


def sponsor_rows(s, d):
    """Rows in the form of the sponsor file: one cosponsor each as its list, every seventh list broken."""
    listed = F.format_string('[{"id": "%s", "party": "%s"}]', F.trim("person_id"), F.coalesce("party", F.lit("")))
    r = people(s, d).select("ord", "doc_id", "party", F.col("state").alias("policy_area"), F.when(F.col("ord") % 3 > 0, F.col("ord").cast("string")).otherwise("").alias("n_cosponsors"), F.when(F.col("ord") % 7 > 0, listed).otherwise("[{").alias("people_json"))
    out = R.sponsors(r, _catalogue(s, d).withColumnRenamed("doc", "doc_id"))
    return out.select("ord", "document_id", "party", "policy_area", "latest_action", "n_cosponsors", "n_current", F.element_at(F.col("people")[0], "id").alias("first_person"))


def flags_round_trip(s, d):
    """Tags as flag columns and back, over the labels at the top of one group."""
    labels = [r[0] for r in table(s, d, "taxonomy").where("name LIKE 'Harms: %' AND name NOT LIKE 'Harms: %: %'").select("name").orderBy("name").collect()]
    held = segments(s, d).select("ord", F.transform(F.coalesce("taxonomy_tags", F.array().cast("array<string>")), lambda t: F.trim(t)).alias("taxonomy_tags"))
    wide = R.tags_to_flags(held, "taxonomy_tags", labels).drop("taxonomy_tags")
    return wide.select("ord", F.array_join(R.flags_to_tags(R.taxonomy_columns(wide.columns)), "; ").alias("tags"))


def binary_matrix(s, d):
    labels = [r[0] for r in P.in_group(_tags(s, d), "incentives").select(P.short_label(F.col("tag"), "incentives").alias("l")).where("NOT contains(l, ': ')").distinct().orderBy("l").collect()]
    m = P.binary_matrix(_tags(s, d), "incentives", labels)
    return m.select("doc", F.expr(" + ".join(f"`{c}`" for c in labels) or "0").cast("bigint").alias("n_set"), F.lit(len(labels)).alias("n_columns"))


def _area(s, d):
    return materialize(L.area_pairs(people(s, d), documents(s, d)), "areas")


def area_measures(s, d):
    e = _area(s, d)
    return L.degrees(e).join(N.betweenness(e), "node").join(N.closeness(e), "node").join(N.eigenvector(e), "node")


def bridge_betweenness(s, d):
    pairs = _pairs(s, d)
    _, crossing = S.cross_party_graph(_members(s, d), pairs)
    crossing = materialize(crossing.select("src", "dst", "weight"), "crossing")
    return S.top_nodes(S.bridges(_members(s, d), pairs, N.betweenness(crossing, weighted=True)), "betweenness", 15)


QUERIES = {
    "authorities_normalised": lambda s, d: R.authorities(table(s, d, "authorities")),
    "collections_normalised": lambda s, d: R.collections(table(s, d, "collections")),
    "documents_normalised": lambda s, d: _docs(s, d).select("ord", "doc_id", "authority_name", "authority_id", "collections_raw", "official_name", "casual_name", "link", "activity_date", "proposed_date", "short_summary", "long_summary", "tags", "annotated", "n_segments"),
    "segments_normalised": lambda s, d: R.segments(segments(s, d), documents(s, d)).select("ord", "document_id", "segment_position", F.md5("text").alias("digest"), "tags", "summary", "non_operative", "not_relevant", F.size("taxonomy_tags").alias("n_tags")),
    "cosponsors_normalised": lambda s, d: R.cosponsors(people(s, d), documents(s, d)),
    "sponsors_normalised": sponsor_rows,
    "rows_skipped": lambda s, d: R.skipped({"segments": (segments(s, d), documents(s, d)), "cosponsors": (people(s, d), documents(s, d))}),
    "document_collections": lambda s, d: R.document_collections(_docs(s, d), table(s, d, "collections")),
    "catalogue_rows": lambda s, d: R.catalogue_rows(_docs(s, d)),
    "tag_flags_round_trip": flags_round_trip,
    "entity_mention_counts": lambda s, d: R.mention_counts(R.entity_mentions(records(s, d), R.typed_lookup(registry(s, d)))),
    "entity_mention_rows": lambda s, d: R.entity_mentions(records(s, d), R.typed_lookup(registry(s, d))),
    "entity_rows_primary": lambda s, d: R.primary_else(
        R.mention_counts(R.entity_mentions(records(s, d).where("record_id % 2 = 0"), R.typed_lookup(registry(s, d)))), R.mention_counts(R.entity_mentions(records(s, d), R.typed_lookup(registry(s, d)))), ["doc", "entity_id"]
    ),
    "binary_matrix": binary_matrix,
    "tags_per_document": lambda s, d: P.tags_per_document(_catalogue(s, d), _tags(s, d)),
    "person_profile": lambda s, d: P.person_profile(people(s, d), _tags(s, d)),
    "most_active_profiles": lambda s, d: P.most_active_profiles(people(s, d), P.person_profile(people(s, d), _tags(s, d))),
    "party_incentives": lambda s, d: P.party_tags(people(s, d), _tags(s, d), "incentives"),
    "risk_champions": lambda s, d: P.champions(people(s, d), _tags(s, d), "risk factors"),
    "application_coverage": lambda s, d: P.tag_coverage(_tags(s, d), "applications"),
    "application_top10": lambda s, d: P.tag_coverage(_tags(s, d), "applications").limit(10),
    "risk_totals_with_parent": lambda s, d: P.totals_with_parent(_tags(s, d), "risk factors"),
    "strategy_top_labels": lambda s, d: P.top_labels(P.tag_coverage(_tags(s, d), "strategies").withColumnRenamed("n_docs", "n"), "strategies"),
    "group_strategies": lambda s, d: P.group_tags(_states(s, d), people(s, d), _tags(s, d), "strategies", _catalogue(s, d)),
    "group_applications": lambda s, d: P.group_tags(_states(s, d), people(s, d), _tags(s, d), "applications"),
    "group_profile": lambda s, d: P.group_profile(_states(s, d), people(s, d), documents(s, d)),
    "chamber_top_areas": lambda s, d: P.top_area_rows(L.chamber_areas(people(s, d), documents(s, d))),
    "bipartisanship_by_area": lambda s, d: P.bipartisanship_by_area(people(s, d), documents(s, d)),
    "area_networks": lambda s, d: P.area_networks(people(s, d), documents(s, d)),
    "large_area_networks": lambda s, d: P.area_networks(people(s, d), documents(s, d), min_nodes=10),
    "distinct_areas": lambda s, d: L.areas(documents(s, d)).where("area IS NOT NULL").select("area").distinct(),
    "harm_strategy_playbook": lambda s, d: P.playbook(_tags(s, d), "harms", "strategies"),
    "strategy_application_pairs": lambda s, d: P.playbook(_tags(s, d), "strategies", "applications", 1, 0),
    "coverage_shares": lambda s, d: R.coverage_shares(documents(s, d), ["short_summary", "long_summary", "tags", "link", "proposed_date"]),
    "ego_nodes": lambda s, d: S.ego(_graph(s, d)[1].toDF("src", "relation", "dst"), EGO)[0],
    "ego_edges": lambda s, d: S.ego(_graph(s, d)[1].toDF("src", "relation", "dst"), EGO)[1],
    "attribute_subgraph": lambda s, d: S.by_attribute(_members(s, d), _pairs(s, d), "party", "D")[1],
    "cross_party_graph_degrees": lambda s, d: S.with_isolated(_members(s, d), S.cross_party_graph(_members(s, d), _pairs(s, d))[1].select("src", "dst", "weight")),
    "cosponsor_degrees_all": lambda s, d: S.with_isolated(_members(s, d), _pairs(s, d)),
    "bridges": lambda s, d: S.bridges(_members(s, d), _pairs(s, d)),
    "bridge_betweenness": bridge_betweenness,
    "largest_component": lambda s, d: S.largest_component(_pairs(s, d)),
    "area_measures": area_measures,
    "top_areas_by_degree": lambda s, d: S.top_nodes(L.degrees(L.area_pairs(people(s, d), documents(s, d))), "weighted_degree", 10),
    "strongest_edges": lambda s, d: S.strongest_edges(_pairs(s, d)),
    "hub_documents": lambda s, d: S.hubs(*_graph(s, d)),
    "neighbours_by_type": lambda s, d: S.neighbours_by_type(*_graph(s, d), NODE),
    "cross_cutting_nodes": lambda s, d: S.cross_cutting(_graph(s, d)[1]),
    "around_document": lambda s, d: S.around_document(_graph(s, d)[1], DOCUMENT, ["UNDER_AUTHORITY", "IN_COLLECTION", "HAS_TAG"]),
    "related_nodes": lambda s, d: S.related(_graph(s, d)[1], NODE, "UNDER_AUTHORITY"),
    "bipartite_edges": lambda s, d: S.bipartite(people(s, d)),
    "bipartite_projection": lambda s, d: S.projection(S.bipartite(people(s, d)), "person", "doc"),
}

_B = lambda c: f"coalesce({c}, '')"
_NORM = f"""
WITH auth AS (SELECT name, max(ord) AS id FROM authorities WHERE name IS NOT NULL GROUP BY name), coll AS (SELECT name, max(ord) AS id FROM collections WHERE name IS NOT NULL GROUP BY name),
docs AS (SELECT d.ord, {_NUMBER} AS doc_id, {_B('authority')} AS authority_name, auth.id AS authority_id, {_B('collections')} AS collections_raw, {_B('official_name')} AS official_name, {_B('casual_name')} AS casual_name, {_B('link')} AS link,
 {_B('activity')} AS activity, {_B('activity_date')} AS activity_date, {_B('proposed_date')} AS proposed_date, {_B('short_summary')} AS short_summary, {_B('long_summary')} AS long_summary, {_B('tags')} AS tags
 FROM documents_raw d LEFT JOIN auth ON {_B('d.authority')} = auth.name WHERE {_NUMBER} IS NOT NULL),
known AS (SELECT DISTINCT doc_id AS k FROM docs),
segs AS (SELECT s.*, {_NUMBER} AS doc, CASE WHEN {_NUMBER} IS NULL THEN 'no document id' WHEN {_NUMBER} NOT IN (SELECT k FROM known) THEN 'unknown document' WHEN {_T('position')} = '' THEN 'no position' END AS skip FROM segments_raw s),
cos AS (SELECT s.*, {_NUMBER} AS doc, CASE WHEN {_NUMBER} IS NULL THEN 'no document id' WHEN {_NUMBER} NOT IN (SELECT k FROM known) THEN 'unknown document' WHEN {_T('person_id')} = '' THEN 'no person' END AS skip FROM cosponsor_rows s)
"""
_OPTIONAL = lambda c: f"CASE WHEN lower({_T(c)}) = 'true' THEN true END"
_LOOKED = _ALL + """, lk AS (SELECT entity_type AS kind, lower(trim(canonical_name)) AS k, arg_max(entity_id, ord) AS entity_id FROM registry WHERE lower(trim(canonical_name)) <> '' GROUP BY 1, 2),
full_men AS (SELECT record_id, trim(doc_id) AS doc, 'organizations' AS kind, unnest(organizations) AS e, generate_subscripts(organizations, 1) - 1 AS pos FROM entity_record),
ents AS (
 SELECT record_id, trim(doc_id) AS doc, 'organizations' AS kind, unnest(organizations).name AS name, unnest(organizations).char_start AS char_start, unnest(organizations).context AS context, generate_subscripts(organizations, 1) - 1 AS pos FROM entity_record
 UNION ALL SELECT record_id, trim(doc_id), 'offices', unnest(offices).name, unnest(offices).char_start, unnest(offices).context, generate_subscripts(offices, 1) - 1 FROM entity_record
 UNION ALL SELECT record_id, trim(doc_id), 'roles', unnest(roles).title, unnest(roles).char_start, unnest(roles).context, generate_subscripts(roles, 1) - 1 FROM entity_record),
em AS (SELECT doc, entity_id, record_id, ents.kind, CAST(pos AS INTEGER) AS pos, char_start, context FROM ents JOIN lk ON ents.kind = lk.kind AND lower(trim(name)) = lk.k WHERE trim(coalesce(name, '')) <> '')
"""
_PROF = _ALL + """, pp AS (SELECT person, tag, grp, count(*) AS n FROM facts JOIN dt USING (doc) GROUP BY ALL),
pty AS (SELECT person, arg_min(trim(coalesce(party, '')), ord) AS party, arg_min(trim(coalesce(state, '')), ord) AS st FROM facts GROUP BY person), sg AS (SELECT st AS grp, person FROM pty WHERE st <> ''),
gd AS (SELECT DISTINCT grp, doc FROM (SELECT DISTINCT doc, person FROM facts) JOIN sg USING (person))
"""
_LABEL = lambda g: f"ltrim(trim(replace(tag, '{g}', '')), ': ')"
_GROUPED = lambda g, known="": (
    f", kept AS (SELECT * FROM gd {known}), big AS (SELECT grp FROM kept GROUP BY grp HAVING count(*) >= 5), n AS (SELECT kept.grp, tag, count(*) AS n FROM kept JOIN (SELECT doc, tag FROM dt WHERE grp = '{g}') USING (doc) WHERE kept.grp IN (SELECT grp FROM big) GROUP BY ALL) "
    "SELECT grp, tag, n, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY grp) AS share FROM n"
)
_MEM = _ALL + ", mem AS (SELECT person AS node, arg_min(trim(coalesce(party, '')), ord) AS party FROM facts GROUP BY person), crossing AS (SELECT src, dst, weight FROM ppairs JOIN mem a ON a.node = src JOIN mem b ON b.node = dst WHERE a.party <> '' AND b.party <> '' AND a.party <> b.party) "
_DEG = lambda e: f"(SELECT node, count(*) AS degree, sum(weight) AS weighted FROM (SELECT src AS node, weight FROM {e} UNION ALL SELECT dst, weight FROM {e}) GROUP BY node)"
_ISOLATED = lambda e: _MEM + f"SELECT mem.node, coalesce(degree, 0) AS degree, CAST(coalesce(weighted, 0) AS BIGINT) AS weighted_degree, CASE WHEN (SELECT count(*) FROM mem) > 1 THEN CAST(coalesce(degree, 0) AS DOUBLE) / ((SELECT count(*) FROM mem) - 1) ELSE 0 END AS degree_centrality FROM mem LEFT JOIN {_DEG(e)} USING (node)"
_UND = "u AS (SELECT node, count(*) AS degree FROM (SELECT src_id AS node FROM edges UNION ALL SELECT dst_id FROM edges) GROUP BY node)"
_EGO = _KG.rstrip() + f", eg AS (SELECT '{EGO}' AS node, 0 AS hops UNION SELECT DISTINCT n, 1 FROM (SELECT src_id AS n FROM edges WHERE dst_id = '{EGO}' UNION SELECT dst_id FROM edges WHERE src_id = '{EGO}') WHERE n <> '{EGO}') "

SQL = {
    "authorities_normalised": f"SELECT ord, {_B('name')} AS name, {_B('jurisdiction')} AS jurisdiction, {_B('parent_authority')} AS parent_authority FROM authorities",
    "collections_normalised": f"SELECT ord, {_B('name')} AS name, {_B('description')} AS description FROM collections",
    "documents_normalised": _NORM + "SELECT ord, doc_id, authority_name, authority_id, collections_raw, official_name, casual_name, link, activity_date, proposed_date, short_summary, long_summary, tags, CAST(NULL AS BOOLEAN) AS annotated, CAST(NULL AS INTEGER) AS n_segments FROM docs",
    "segments_normalised": _NORM + f"SELECT ord, doc AS document_id, CAST(trunc(TRY_CAST(position AS DOUBLE)) AS INTEGER) AS segment_position, md5({_B('text')}) AS digest, {_B('tags')} AS tags, {_B('summary')} AS summary, {_OPTIONAL('non_operative')} AS non_operative, {_OPTIONAL('not_relevant')} AS not_relevant, CAST(len(coalesce(taxonomy_tags, [])) AS INTEGER) AS n_tags FROM segs WHERE skip IS NULL",
    "cosponsors_normalised": _NORM + f"SELECT ord, doc AS document_id, trim(person_id) AS person_id, {_B('full_name')} AS full_name, {_B('party')} AS party, {_B('state')} AS state, {_B('district')} AS district, sponsorship_date, coalesce(is_original, false) AS is_original, withdrawn_date, coalesce(is_withdrawn, false) AS is_withdrawn FROM cos WHERE skip IS NULL",
    "sponsors_normalised": _NORM + f"SELECT ord, doc AS document_id, {_B('party')} AS party, {_B('state')} AS policy_area, '' AS latest_action, CAST(CASE WHEN ord % 3 > 0 THEN ord ELSE 0 END AS INTEGER) AS n_cosponsors, 0 AS n_current, CASE WHEN ord % 7 > 0 THEN trim(coalesce(person_id, 'null')) END AS first_person FROM cos WHERE skip IS NULL OR skip = 'no person'",
    "rows_skipped": _NORM + "SELECT 'segments' AS table_name, skip AS reason, count(*) AS n FROM segs WHERE skip IS NOT NULL GROUP BY skip UNION ALL SELECT 'cosponsors', skip, count(*) FROM cos WHERE skip IS NOT NULL GROUP BY skip",
    "document_collections": _NORM + "SELECT doc_id, coll.id AS collection_id FROM (SELECT doc_id, trim(unnest(string_split(collections_raw, ';'))) AS c FROM docs) JOIN coll ON c = coll.name",
    "catalogue_rows": _NORM + "SELECT ord, CAST(doc_id AS VARCHAR) AS doc_id, official_name, casual_name, link, activity, activity_date, proposed_date, short_summary, long_summary, tags, authority_name AS authority, collections_raw AS collections, '' AS applies_government, '' AS applies_private FROM docs",
    "tag_flags_round_trip": "WITH l AS (SELECT list(DISTINCT name) AS ls FROM taxonomy WHERE name LIKE 'Harms: %' AND name NOT LIKE 'Harms: %: %') SELECT ord, array_to_string(list_sort(list_distinct(list_filter(list_transform(coalesce(taxonomy_tags, []), lambda x: trim(x)), lambda x: list_contains(ls, x)))), '; ') AS tags FROM segments_raw, l",
    "entity_mention_counts": _LOOKED + "SELECT doc, entity_id, count(*) AS n FROM em GROUP BY ALL",
    "entity_mention_rows": _LOOKED + "SELECT doc, entity_id, kind, record_id, pos, char_start, context, CAST(row_number() OVER (PARTITION BY doc, entity_id ORDER BY record_id, pos, kind) AS INTEGER) AS k FROM em",
    "entity_rows_primary": _LOOKED + ", a AS (SELECT doc, entity_id, count(*) AS n FROM em WHERE record_id % 2 = 0 GROUP BY ALL), b AS (SELECT doc, entity_id, count(*) AS n FROM em GROUP BY ALL) SELECT * FROM a UNION ALL SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.doc = b.doc AND a.entity_id = b.entity_id)",
    "binary_matrix": _ALL + f", l AS (SELECT doc, {_LABEL('incentives')} AS l FROM dt WHERE grp = 'incentives') SELECT doc, count(DISTINCT l) FILTER (NOT contains(l, ': ')) AS n_set, (SELECT CAST(count(DISTINCT l) AS INTEGER) FROM l WHERE NOT contains(l, ': ')) AS n_columns FROM l GROUP BY doc",
    "tags_per_document": _ALL + f", k AS (SELECT DISTINCT {_NUMBER} AS doc FROM documents_raw WHERE {_NUMBER} IS NOT NULL), n AS (SELECT k.doc, count(tag) AS n FROM k LEFT JOIN dt USING (doc) GROUP BY k.doc) SELECT count(*) AS n_docs, avg(n) AS mean_n, median(n) AS median_n, count(*) FILTER (n = 0) AS n_without FROM n",
    "person_profile": _PROF + "SELECT person, tag, n, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY person) AS share FROM pp",
    "most_active_profiles": _PROF + ", busiest AS (SELECT person FROM facts GROUP BY person ORDER BY count(DISTINCT doc) DESC, person LIMIT 30) SELECT * FROM (SELECT person, tag, n, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY person) AS share FROM pp) WHERE person IN (SELECT person FROM busiest)",
    "party_incentives": _PROF + ", n AS (SELECT party, tag, CAST(sum(n) AS BIGINT) AS n FROM pp JOIN pty USING (person) WHERE grp = 'incentives' AND party <> '' GROUP BY ALL) SELECT party, tag, n, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY party) AS share FROM n",
    "risk_champions": _PROF + "SELECT tag, CAST(row_number() OVER (PARTITION BY tag ORDER BY n DESC, person) AS INTEGER) AS rank, person, party, n FROM pp JOIN pty USING (person) WHERE grp = 'risk factors' QUALIFY rank <= 3",
    "application_coverage": _ALL + "SELECT tag, count(*) AS n_docs FROM dt WHERE grp = 'applications' GROUP BY tag",
    "application_top10": _ALL + "SELECT tag, count(*) AS n_docs FROM dt WHERE grp = 'applications' GROUP BY tag ORDER BY n_docs DESC, tag LIMIT 10",
    "risk_totals_with_parent": _ALL + f"SELECT {_LABEL('risk factors')} AS label, CASE WHEN contains({_LABEL('risk factors')}, ': ') THEN string_split({_LABEL('risk factors')}, ': ')[1] ELSE 'risk factors' END AS parent, count(*) AS n_docs FROM dt WHERE grp = 'risk factors' GROUP BY ALL",
    "strategy_top_labels": _ALL + f", c AS (SELECT tag, count(*) AS n FROM dt WHERE grp = 'strategies' GROUP BY tag), t AS (SELECT tag FROM c WHERE NOT contains({_LABEL('strategies')}, ': ')) SELECT tag FROM t WHERE (SELECT count(*) FROM t) >= 5 UNION ALL (SELECT tag FROM c WHERE (SELECT count(*) FROM t) < 5 ORDER BY n DESC, tag LIMIT 15)",
    "group_strategies": _PROF + _GROUPED("strategies", f"WHERE doc IN (SELECT {_NUMBER} FROM documents_raw WHERE {_NUMBER} IS NOT NULL)"),
    "group_applications": _PROF + _GROUPED("applications"),
    "group_profile": _PROF + f""", sz AS (SELECT grp, count(*) AS size FROM sg GROUP BY grp), fr AS (SELECT person, arg_min(coalesce(full_name, ''), ord) AS full_name FROM facts GROUP BY person),
mix AS (SELECT grp, count(*) FILTER (party = 'D') AS d, count(*) FILTER (party = 'R') AS r, count(*) FILTER ({_LONG} = 'Senate') AS senate, count(*) FILTER ({_LONG} = 'House') AS house FROM sg JOIN pty USING (person) JOIN fr USING (person) GROUP BY grp),
ar AS (SELECT grp, area, count(*) AS n FROM fa JOIN sg USING (person) WHERE area IS NOT NULL GROUP BY ALL), rk AS (SELECT grp, area || ' (' || n || ')' AS s, row_number() OVER (PARTITION BY grp ORDER BY n DESC, area) AS k FROM ar)
SELECT grp, size, round(100.0 * d / size, 1)::DOUBLE AS d_pct, round(100.0 * r / size, 1)::DOUBLE AS r_pct, senate, house, CAST(1 AS BIGINT) AS n_states, coalesce((SELECT s FROM rk WHERE rk.grp = sz.grp AND k = 1), '') AS top_1, coalesce((SELECT s FROM rk WHERE rk.grp = sz.grp AND k = 2), '') AS top_2, coalesce((SELECT s FROM rk WHERE rk.grp = sz.grp AND k = 3), '') AS top_3 FROM sz JOIN mix USING (grp)""",
    "chamber_top_areas": _ALL + f", c AS (SELECT {_LONG} AS chamber, area, count(*) AS n FROM fa WHERE area IS NOT NULL GROUP BY ALL), t AS (SELECT area, CAST(sum(n) AS BIGINT) AS total FROM c GROUP BY area ORDER BY total DESC, area LIMIT 10) SELECT chamber, c.area, n, total FROM c JOIN t USING (area)",
    "bipartisanship_by_area": _ALL + ", b AS (SELECT doc, count(*) FILTER (upper(trim(party)) = 'D') AS d, count(*) FILTER (upper(trim(party)) = 'R') AS r FROM active GROUP BY doc), i AS (SELECT doc, CASE WHEN d + r = 0 THEN 0 ELSE least(d, r) / CAST(d + r AS DOUBLE) END AS ix, coalesce(nullif(a, '∅'), 'Unknown') AS area FROM b LEFT JOIN areas USING (doc)), t AS (SELECT area FROM i GROUP BY area ORDER BY count(*) DESC, area LIMIT 10) SELECT area, count(*) AS n_docs, quantile_cont(ix, 0.25) AS low, quantile_cont(ix, 0.5) AS median, quantile_cont(ix, 0.75) AS high FROM i WHERE area IN (SELECT area FROM t) GROUP BY area",
    "area_networks": (_AREA_NET := _ALL + ", f AS (SELECT fa.area, doc, person FROM fa WHERE NOT coalesce(is_withdrawn, false) AND fa.area IS NOT NULL), n AS (SELECT area, count(*) AS n_rows, count(DISTINCT person) AS n_nodes FROM f GROUP BY area), e AS (SELECT area, count(*) AS n_edges FROM (SELECT DISTINCT x.area, x.person, y.person FROM f x JOIN f y ON x.area = y.area AND x.doc = y.doc AND x.person < y.person) GROUP BY area) SELECT area, n_rows, n_nodes, coalesce(n_edges, 0) AS n_edges FROM n LEFT JOIN e USING (area) WHERE n_rows >= 3 AND n_nodes >= {least}").replace("{least}", "2"),
    "large_area_networks": _AREA_NET.replace("{least}", "10"),
    "distinct_areas": _ALL + "SELECT DISTINCT nullif(a, '∅') AS area FROM areas WHERE a <> '∅'",
    "harm_strategy_playbook": _ALL + ", h AS (SELECT doc, tag FROM dt WHERE grp = 'harms' AND tag IN (SELECT tag FROM dt WHERE grp = 'harms' GROUP BY tag HAVING count(*) >= 5)) SELECT h.tag AS src, x.tag AS dst, count(*) AS n_docs FROM h JOIN dt x USING (doc) WHERE x.grp = 'strategies' GROUP BY ALL HAVING count(*) > 3",
    "strategy_application_pairs": _ALL + "SELECT h.tag AS src, x.tag AS dst, count(*) AS n_docs FROM dt h JOIN dt x USING (doc) WHERE h.grp = 'strategies' AND x.grp = 'applications' GROUP BY ALL",
    "coverage_shares": "SELECT " + ", ".join(f"CAST(count(*) FILTER (trim(coalesce({c}, '')) <> '') AS DOUBLE) / count(*) AS {c}" for c in ["short_summary", "long_summary", "tags", "link", "proposed_date"]) + " FROM documents_raw",
    "ego_nodes": _EGO + "SELECT node, hops FROM eg",
    "ego_edges": _EGO + "SELECT src_id AS src, relation, dst_id AS dst FROM edges WHERE src_id IN (SELECT node FROM eg) AND dst_id IN (SELECT node FROM eg)",
    "attribute_subgraph": _MEM + "SELECT src, dst, weight FROM ppairs WHERE src IN (SELECT node FROM mem WHERE party = 'D') AND dst IN (SELECT node FROM mem WHERE party = 'D')",
    "cross_party_graph_degrees": _ISOLATED("crossing"),
    "cosponsor_degrees_all": _ISOLATED("ppairs"),
    "bridges": _MEM + f"SELECT c.node, party, CAST(c.weighted AS BIGINT) AS cross_degree, CAST(t.weighted AS BIGINT) AS total_degree, CAST(c.weighted AS DOUBLE) / greatest(t.weighted, 1) AS cross_ratio FROM {_DEG('crossing')} c JOIN {_DEG('ppairs')} t USING (node) JOIN mem USING (node)",
    "top_areas_by_degree": _ALL + f", d AS {_DEG('apairs')} SELECT node, degree, CAST(weighted AS BIGINT) AS weighted_degree, CAST(degree AS DOUBLE) / ((SELECT count(*) FROM d) - 1) AS degree_centrality FROM d ORDER BY weighted DESC, node LIMIT 10",
    "strongest_edges": _ALL + "SELECT src, dst, weight FROM ppairs ORDER BY weight DESC, src, dst LIMIT (SELECT greatest(CAST(floor(count(*) * 0.2) AS BIGINT), 500) FROM ppairs)",
    "hub_documents": _KG.rstrip() + f", {_UND} SELECT node, degree, label FROM u JOIN nodes ON node = node_id WHERE node_type = 'Document' ORDER BY degree DESC, node LIMIT 10",
    "neighbours_by_type": _KG.rstrip() + f", {_UND}, nb AS (SELECT dst_id AS node FROM edges WHERE src_id = '{NODE}' UNION SELECT src_id FROM edges WHERE dst_id = '{NODE}') SELECT node_type, CAST(row_number() OVER (PARTITION BY node_type ORDER BY degree DESC, node) AS INTEGER) AS rank, node, degree FROM nb JOIN u USING (node) JOIN nodes ON node = node_id WHERE node <> '{NODE}' QUALIFY rank <= 12",
    "cross_cutting_nodes": _KG.rstrip() + " SELECT dst_id AS node, count(DISTINCT src_id) AS n_docs FROM edges WHERE src_id LIKE 'document:%' AND dst_id NOT LIKE 'document:%' GROUP BY 1 HAVING count(DISTINCT src_id) >= 10",
    "around_document": _KG.rstrip() + f" SELECT DISTINCT relation, dst_id AS node FROM edges WHERE src_id = '{DOCUMENT}' AND relation IN ('UNDER_AUTHORITY', 'IN_COLLECTION', 'HAS_TAG')",
    "related_nodes": _KG.rstrip() + f" SELECT dst_id AS node FROM edges WHERE src_id = '{NODE}' AND relation = 'UNDER_AUTHORITY' UNION SELECT src_id FROM edges WHERE dst_id = '{NODE}' AND relation = 'UNDER_AUTHORITY'",
    "bipartite_edges": _ALL + "SELECT doc, person, arg_max(coalesce(party, '∅'), ord) AS party_, count(*) AS n FROM facts GROUP BY ALL",
    "bipartite_projection": _ALL + "SELECT x.person AS src, y.person AS dst, count(*) AS weight FROM (SELECT DISTINCT doc, person FROM facts) x JOIN (SELECT DISTINCT doc, person FROM facts) y ON x.doc = y.doc AND x.person < y.person GROUP BY ALL",
}
SQL["bipartite_edges"] = "SELECT doc, person, nullif(party_, '∅') AS party, n FROM (" + SQL["bipartite_edges"] + ")"
