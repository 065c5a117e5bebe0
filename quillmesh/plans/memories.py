"""Queries of layers, memory, resolution, evaluation, document similarity and scalars, with their SQL.

Where an operator takes communities of documents, these queries take the authority of a document as its community: SQL
can tell it. ``doc_communities`` detects them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmesh.functions import shown as W
from quillmesh.operators import affinity as D
from quillmesh.operators import assessment as Q
from quillmesh.operators import entities as E
from quillmesh.operators import knowledge as K
from quillmesh.operators import layers as Y
from quillmesh.operators import legislators as L
from quillmesh.plans.crossings import _ALL, _canonical, documents, people, records, registry
from quillmesh.plans.data_quality import _NUMBER
from quillmesh.plans.graphs import _BARE, _DISTRICT, _T
from quillmesh.plans.records import _MENTIONS, _PLAIN, _SLUG, _gold, _predicted
from quillmesh.plans.tables import _tags
from quillmesh.session import materialize
from quillmesh.sources.tables import table


def _communities(s, d):
    return L.areas(documents(s, d)).where("area IS NOT NULL").select(F.col("doc").cast("string").alias("doc"), F.col("area").alias("community"))


def _terms(s, d):
    return E.registry_terms(registry(s, d))


def _roster(s, d):
    return K.roster(records(s, d), _communities(s, d), _terms(s, d), registry(s, d))


def _queue(s, d):
    c = _communities(s, d)
    return K.review_queue(records(s, d), c, K.community_phrases(records(s, d), c), _terms(s, d), registry(s, d))


def _last(df):
    return L.person_nodes(df, "last")


def _labelled(s, d):
    members = L.areas(documents(s, d)).where("area IS NOT NULL").select("doc", F.col("area").alias("community"))
    return D.community_labels(members, _tags(s, d), people(s, d)), members.withColumn("centrality", F.lit(1.0))


def _relations(s, d):
    """Offices as part of the body they name, roles as held in theirs."""
    part = None
    for i, (kind, field, other, relation) in enumerate((("offices", "name", "parent_org", "PART_OF"), ("roles", "title", "org", "HELD_IN"))):
        r = records(s, d).select("record_id", F.explode(kind).alias("e")).select(
            "record_id", F.lit(kind).alias("source_type"), F.col(f"e.{field}").alias("source_name"), F.lit("organizations").alias("target_type"), F.col(f"e.{other}").alias("target_name"), F.lit(relation).alias("relation_type"), "e.context"
        )
        part = r if part is None else part.unionByName(r)
    return part


def _layers(s, d):
    p = people(s, d)
    sponsors, active, gone = p.where("is_original"), L.active(p), p.where("is_withdrawn")
    return {
        "sponsor": lambda: Y.people_layer(L.person_nodes(sponsors, "first"), L.sponsorship_edges(sponsors, "SPONSORED_BY"), "Sponsor", 1),
        "cosponsor": lambda: Y.people_layer(_last(active), L.sponsorship_edges(active, "COSPONSORED_BY"), "Cosponsor", 2),
        "withdrawn": lambda: Y.people_layer(_last(gone), L.sponsorship_edges(gone, "WITHDRAWN_COSPONSOR"), "WithdrawnCosponsor", 2),
        "community": lambda: Y.community_layer(*_labelled(s, d)),
        "entity": lambda: Y.entity_layer(records(s, d), E.term_map(registry(s, d)), _relations(s, d)),
    }


def _nodes(name):
    return lambda s, d: _layers(s, d)[name]()[0]


def multiplex_stats(phase):
    def query(s, d):
        layers = {k: tuple(materialize(x, "layer") for x in v) for k, v in Y.build(phase, _layers(s, d)).items()}
        return Y.stats(layers, Y.combine(layers))

    return query


def multiplex_nodes(s, d):
    return Y.combine(Y.build("all", _layers(s, d)))[0].select("node_id", "node_type", "label", "layer")


def shares_edges(s, d):
    """The document pairs of all people: as many as the squares of their documents."""
    return L.shares_edges(L.active(people(s, d)), "SHARES_COSPONSOR", True)


def _similarity(s, d):
    members = materialize(D.link_members(documents(s, d)), "members")
    return members, D.profile_tags(_tags(s, d), members), D.profile_words(documents(s, d), members)


def doc_similarity(s, d):
    members, tags, words = _similarity(s, d)
    queries = members.where("rep % 50 = 0").select("rep")
    return D.combined_similarity(tags, words, queries=queries).select("src", "dst", F.round("similarity", 6).alias("similarity"))


def doc_communities(s, d):
    return D.document_communities(documents(s, d), _tags(s, d))


def doc_community_labels(s, d):
    found = materialize(doc_communities(s, d), "communities")
    return D.community_labels(found.select("doc", "community"), _tags(s, d), people(s, d)).withColumn("signature", F.array_join("signature", "|"))


def parsing_rules(s, d):
    c = _communities(s, d)
    r = records(s, d).select(F.trim("doc_id").alias("doc"), F.col("record_id").alias("ord"), F.concat_ws(" ", "oddity", F.get("organizations", F.lit(0))["name"]).alias("rule")).join(c, "doc", "left")
    return K.parsing_rules(r.select("community", "ord", "rule"))


def community_context(s, d):
    c = _communities(s, d)
    phrases = K.community_phrases(records(s, d), c)
    return K.disambiguation_context(phrases, _roster(s, d), K.last_oddities(records(s, d), c), _terms(s, d), registry(s, d))


def report_scalars(s, d):
    t, n = F.col("canonical_name"), F.col("ord")
    return registry(s, d).select(
        "ord", W.digest(t).alias("digest"), W.shortened(t, 35).alias("short"), W.numbered("community:", n).alias("numbered"), W.humanised(F.col("entity_type")).alias("human"), W.anchor(t).alias("anchor"),
        W.file_stem(t).alias("stem"), W.table_line([(t, 20), (n, 6)]).alias("line"), W.thousands(n * 12345).alias("thousands"), W.context_of(t, F.substring(t, 5, 8), t).cast("int").alias("at"),
        W.window(t, F.lit(6), F.lit(9), 3, 8).alias("around"), W.batches(n, 200).alias("batches"), W.megabytes(n * 1_000_003).alias("mb"), W.clamped(n / 100.0, 0.5, 3.0).alias("clamped"),
        W.scaled(n, F.lit(600), 1.0, 9.0).alias("scaled"), W.entry_or(F.col("metadata"), F.lit("region"), F.lit("none")).alias("region"), F.size(W.truthy_entries(F.col("metadata"))).alias("n_meta"),
        F.size(W.appended(F.coalesce("aliases", F.array().cast("array<string>")), t)).alias("n_names"), F.coalesce(W.inside_any(F.col("acronym"), F.array(t)), F.lit(False)).alias("inside"),
    )


def time_scalars(s, d):
    t = F.col("loaded_at")
    return documents(s, d).select("ord", W.blank_date(F.col("activity_date")).alias("day"), W.time_suffix(t).alias("suffix"), W.seconds_left(t, t + F.expr("INTERVAL 1 SECOND"), 1.5).alias("left_"), F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'+00:00'").alias("iso"))


QUERIES = {
    "layer_sponsor_nodes": _nodes("sponsor"),
    "layer_cosponsor_nodes": _nodes("cosponsor"),
    "layer_withdrawn_nodes": _nodes("withdrawn"),
    "layer_community_nodes": _nodes("community"),
    "layer_community_edges": lambda s, d: _layers(s, d)["community"]()[1],
    "layer_entity_nodes": _nodes("entity"),
    "layer_entity_edges": lambda s, d: _layers(s, d)["entity"]()[1].groupBy("src_id", "relation", "dst_id").agg(F.count("*").alias("n")),
    "multiplex_nodes": multiplex_nodes,
    "multiplex_stats": multiplex_stats("all"),
    "multiplex_stats_cosponsor": multiplex_stats("cosponsor"),
    "shares_cosponsor_edges": shares_edges,
    "link_members": lambda s, d: D.link_members(documents(s, d)),
    "doc_similarity_edges": doc_similarity,
    "doc_communities": doc_communities,
    "doc_community_labels": doc_community_labels,
    "community_labels": lambda s, d: _labelled(s, d)[0].withColumn("signature", F.array_join("signature", "|")),
    "generic_names": lambda s, d: E.mentions(records(s, d)).where(K.is_generic(F.col("name"), F.array().cast("array<string>"))).groupBy("kind", F.lower(F.trim("name")).alias("name")).agg(F.count("*").alias("n")),
    "valid_extractions": lambda s, d: records(s, d).groupBy(K.valid_extraction(records(s, d), E.LISTS).alias("valid")).agg(F.count("*").alias("n")),
    "community_phrases": lambda s, d: K.community_phrases(records(s, d), _communities(s, d)),
    "review_queue": _queue,
    "review_stats": lambda s, d: K.queue_stats(_queue(s, d)),
    "memory_roster": _roster,
    "novel_mentions": lambda s, d: K.novel(records(s, d).where("record_id % 2 = 1"), K.roster(records(s, d).where("record_id % 2 = 0"), _communities(s, d), _terms(s, d), registry(s, d)), _communities(s, d), _terms(s, d), registry(s, d)),
    "graduated_rules": lambda s, d: K.graduated(_named(s, d), _communities(s, d), _terms(s, d), 2),
    "last_oddities": lambda s, d: K.last_oddities(records(s, d), _communities(s, d)),
    "parsing_rules": parsing_rules,
    "community_context": community_context,
    "eval_matched": lambda s, d: Q.by_kind(Q.matched(_predicted(s, d), _gold(s, d))),
    "eval_macro": lambda s, d: Q.macro_f1(E.evaluate_exact(_predicted(s, d), _gold(s, d))),
    "eval_type_accuracy": lambda s, d: Q.type_accuracy(_predicted(s, d), _gold(s, d)),
    "name_overlap": lambda s, d: Q.overlap(_predicted(s, d), _gold(s, d)),
    "contained_names": lambda s, d: Q.contained(_predicted(s, d), _gold(s, d)),
    "label_totals": lambda s, d: Q.label_totals(E.mentions(records(s, d))),
    "report_scalars": report_scalars,
    "time_scalars": time_scalars,
}


def _named(s, d):
    """Records whose disambiguations mean a name and not an id: that of the first organization."""
    first = F.get("organizations", F.lit(0))["name"]
    return records(s, d).where(first.isNotNull()).withColumn("disambiguation_updates", F.transform_values("disambiguation_updates", lambda k, v: first))


_COM = _ALL + """, com AS (SELECT CAST(doc AS VARCHAR) AS doc, a AS community FROM areas WHERE a <> '∅'),
best_key AS (SELECT key, kind, arg_max(entity_id, (CAST(entity_type = kind AS INTEGER), confidence, -ord)) AS entity_id FROM (SELECT DISTINCT lower(trim(name)) AS key, kind FROM men) n JOIN terms ON key = term GROUP BY ALL),
own AS (SELECT record_id, trim(coalesce(doc_id, '')) AS doc, lower(trim(e.key)) AS phrase, arg_min(e.value, e.key) AS meaning FROM (SELECT record_id, doc_id, unnest(map_entries(disambiguation_updates)) AS e FROM entity_record) GROUP BY ALL),
cph AS (SELECT community, phrase, arg_min(meaning, (record_id, meaning)) AS meaning FROM own JOIN com USING (doc) WHERE NOT contains(phrase, '_in_sec_') GROUP BY ALL),
full_of AS (SELECT entity_id, canonical_name, lower(trim(canonical_name)) AS full_ FROM registry)
"""
_BARES = ", ".join(f"'{b}'" for b in K.BARE)
_QUEUE = _COM + f""", q1 AS (SELECT men.record_id, men.doc, men.kind, CAST(men.pos AS INTEGER) AS pos, men.name, lower(trim(men.name)) AS phrase, own.meaning AS own_meaning, com.community AS community FROM men LEFT JOIN own ON own.record_id = men.record_id AND own.phrase = lower(trim(men.name)) LEFT JOIN com ON com.doc = men.doc WHERE lower(trim(men.name)) IN ({_BARES}) OR own.meaning IS NOT NULL),
q2 AS (SELECT q1.*, cph.meaning AS com_meaning, canonical_name FROM q1 LEFT JOIN cph ON cph.community = q1.community AND cph.phrase = q1.phrase LEFT JOIN best ON best.name = q1.name AND best.kind = q1.kind LEFT JOIN full_of ON full_of.entity_id = best.entity_id),
q3 AS (SELECT *, {_canonical('own_meaning')} AS a, {_canonical('com_meaning')} AS b FROM q2),
q4 AS (SELECT *, CASE WHEN lower(a) <> phrase THEN a END AS a1, CASE WHEN lower(b) <> phrase THEN b END AS b1, CASE WHEN lower(canonical_name) <> phrase THEN canonical_name END AS c1 FROM q3),
queue AS (SELECT record_id, doc, kind, pos, name, coalesce(community, '') AS community, coalesce(a1, b1, c1) AS suggestion, CASE WHEN a1 IS NOT NULL THEN 'doc' WHEN b1 IS NOT NULL THEN 'community' WHEN c1 IS NOT NULL THEN 'registry' ELSE 'unresolved' END AS source FROM q4)
"""


def _roster_sql(of: str) -> str:
    return f"""
, seen AS (SELECT coalesce(community, '') AS community, kind, lower(trim(name)) AS key, count(*) AS n, min((record_id, pos)) AS since, arg_min(name, (record_id, pos)) AS name, arg_min(men.doc, (record_id, pos)) AS first_seen FROM men LEFT JOIN com ON com.doc = men.doc WHERE {of} GROUP BY 1, 2, 3),
known AS (SELECT seen.*, full_ FROM seen LEFT JOIN best_key USING (key, kind) LEFT JOIN full_of USING (entity_id)),
in1 AS (SELECT k.* FROM known k LEFT JOIN known f ON f.community = k.community AND f.kind = k.kind AND f.key = k.full_ WHERE NOT coalesce(k.full_ <> k.key AND f.since < k.since, false)),
in2 AS (SELECT k.* FROM known k LEFT JOIN in1 f ON f.community = k.community AND f.kind = k.kind AND f.key = k.full_ WHERE NOT coalesce(k.full_ <> k.key AND f.since < k.since, false))
"""


_PEOPLE = lambda pick, where: f"SELECT person, {pick}({{'full_name': full_name, 'party': party, 'state': state, 'district': district}}, ord) AS a FROM facts WHERE {where} GROUP BY person"
_CHAMBER = "CASE WHEN trim(coalesce(a.full_name, '')) LIKE 'Rep.%' THEN 'Rep' WHEN trim(coalesce(a.full_name, '')) LIKE 'Sen.%' THEN 'Sen' WHEN trim(coalesce(a.full_name, '')) LIKE 'Del.%' THEN 'Del' ELSE '' END"


def _people_layer(pick: str, where: str, node_type: str, layer: int) -> str:
    t = lambda c: f"trim(coalesce(a.{c}, ''))"
    return (
        f"SELECT 'sponsor:' || person AS node_id, '{node_type}' AS node_type, {t('full_name')} AS label, {layer} AS layer, concat_ws('|', {t('party')}, {t('state')}, {_DISTRICT}, {_CHAMBER}) AS detail FROM ({_PEOPLE(pick, where)}) "
        f"UNION ALL SELECT DISTINCT 'document:' || doc, 'Document', 'document:' || doc, {layer}, CAST(NULL AS VARCHAR) FROM facts WHERE {where}"
    )


_SPONSOR, _COSPONSOR, _GONE = _people_layer("arg_min", "is_original", "Sponsor", 1), _people_layer("arg_max", "NOT coalesce(is_withdrawn, false)", "Cosponsor", 2), _people_layer("arg_max", "is_withdrawn", "WithdrawnCosponsor", 2)
_LABELS = """, mb AS (SELECT doc, a AS community FROM areas WHERE a <> '∅'), sz AS (SELECT community, count(*) AS size FROM mb GROUP BY community),
tn AS (SELECT community, tag, count(DISTINCT mb.doc) AS n FROM mb JOIN dt USING (doc) GROUP BY ALL), tr AS (SELECT *, row_number() OVER (PARTITION BY community ORDER BY n DESC, tag) AS k FROM tn JOIN sz USING (community)),
sg2 AS (SELECT community, string_agg(tag, ' | ' ORDER BY k) FILTER (k <= 3) AS label, string_agg(tag, '|' ORDER BY k) FILTER (n >= 0.4 * size) AS signature FROM tr GROUP BY community),
pc AS (SELECT community, trim(party) AS p, count(*) AS n, min(ord) AS o FROM facts JOIN mb USING (doc) WHERE trim(coalesce(party, '')) <> '' GROUP BY ALL), pb AS (SELECT community, arg_max(p, (n, -o)) AS p FROM pc GROUP BY community),
lab AS (SELECT community, size, coalesce(label, 'General') AS label, coalesce(signature, '') AS signature, coalesce(p, '') AS dominant_party FROM sz LEFT JOIN sg2 USING (community) LEFT JOIN pb USING (community))
"""
_COMMUNITY = "SELECT community AS node_id, 'Community' AS node_type, label, 2 AS layer, concat_ws('|', dominant_party, CAST(size AS VARCHAR)) AS detail FROM lab UNION ALL SELECT 'document:' || doc, 'Document', 'document:' || doc, 2, CAST(NULL AS VARCHAR) FROM mb"
_LSLUG = lambda c: f"coalesce(nullif(substr({_SLUG(c)}, 1, 80), ''), 'unknown')"
_FIELDS = (("organizations", "MENTIONS_ORG", "name", "org", "acronym"), ("offices", "MENTIONS_OFFICE", "name", "office", "parent_org"), ("roles", "INVOLVES_ROLE", "title", "role", "org"))
_ENTITY = (
    ", tmap AS (SELECT term, arg_max(entity_id, ord) AS entity_id FROM terms GROUP BY term), em0 AS ("
    + " UNION ALL ".join(f"SELECT record_id, trim(coalesce(doc_id, '')) AS doc, {i} AS list, generate_subscripts({k}, 1) - 1 AS pos, '{k}' AS kind, '{r}' AS relation, '{p}' AS prefix, unnest({k}).{f} AS name, unnest({k}).{d} AS detail, unnest({k}).context AS context FROM entity_record" for i, (k, r, f, p, d) in enumerate(_FIELDS))
    + f"), em1 AS (SELECT em0.*, coalesce(entity_id, prefix || ':' || {_LSLUG('name')}) AS node FROM em0 LEFT JOIN tmap ON term = lower(trim(name)) WHERE name <> '' AND doc <> ''), "
    + "en AS (SELECT node, arg_min(prefix, (record_id, list, pos)) AS prefix, arg_min(name, (record_id, list, pos)) AS name, arg_min(coalesce(detail, ''), (record_id, list, pos)) AS detail, min(record_id) AS since FROM em1 GROUP BY node), "
    + "rl AS (" + " UNION ALL ".join(f"SELECT record_id, '{p}' AS sp, unnest({k}).{f} AS sn, 'org' AS tp, unnest({k}).{d} AS tn, '{rel}' AS relation FROM entity_record" for k, f, p, d, rel in (("offices", "name", "office", "parent_org", "PART_OF"), ("roles", "title", "role", "org", "HELD_IN"))) + "), "
    + f"rl1 AS (SELECT record_id, relation, coalesce(a.entity_id, sp || ':' || {_LSLUG('sn')}) AS s, coalesce(b.entity_id, tp || ':' || {_LSLUG('tn')}) AS t FROM rl LEFT JOIN tmap a ON a.term = lower(trim(sn)) LEFT JOIN tmap b ON b.term = lower(trim(tn)) WHERE sn <> '' AND tn <> ''), "
    + "ee AS (SELECT 'document:' || doc AS src_id, relation, node AS dst_id FROM em1 UNION ALL SELECT s, relation, t FROM rl1 JOIN en x ON x.node = s JOIN en y ON y.node = t WHERE x.since <= record_id AND y.since <= record_id), "
    + "ent AS (SELECT node AS node_id, CASE prefix WHEN 'org' THEN 'Org' WHEN 'office' THEN 'Office' ELSE 'Role' END AS node_type, name AS label, 3 AS layer, detail FROM en UNION ALL SELECT DISTINCT 'document:' || trim(doc_id), 'Document', 'document:' || trim(doc_id), 3, CAST(NULL AS VARCHAR) FROM entity_record WHERE trim(coalesce(doc_id, '')) <> '')"
)
_EDGES_OF = {"sponsor": ("SPONSORED_BY", "is_original"), "cosponsor": ("COSPONSORED_BY", "NOT coalesce(is_withdrawn, false)"), "withdrawn": ("WITHDRAWN_COSPONSOR", "is_withdrawn")}
_MULTI = _ALL + _LABELS + _ENTITY + f", l1 AS ({_SPONSOR}), l2 AS ({_COSPONSOR}), l3 AS ({_GONE}), l4 AS ({_COMMUNITY})"


def _stats_sql(layers: list[str]) -> str:
    nodes = {"sponsor": "l1", "cosponsor": "l2", "withdrawn": "l3", "community": "l4", "entity": "ent"}
    edge = lambda x: f"SELECT '{_EDGES_OF[x][0]}' AS relation FROM facts WHERE {_EDGES_OF[x][1]}" if x in _EDGES_OF else "SELECT 'IN_COMMUNITY' AS relation FROM mb" if x == "community" else "SELECT relation FROM ee"
    n = " UNION ALL ".join(f"SELECT '{x}' AS layer, node_id, node_type AS kind FROM {nodes[x]}" for x in layers)
    e = " UNION ALL ".join(f"SELECT '{x}' AS layer, relation AS kind FROM ({edge(x)})" for x in layers)
    return (
        _MULTI + f", an AS ({n}), ae AS ({e}) SELECT layer, 'nodes' AS what, kind, count(*) AS n FROM an GROUP BY GROUPING SETS ((layer, kind), (layer)) UNION ALL SELECT layer, 'edges', kind, count(*) FROM ae GROUP BY GROUPING SETS ((layer, kind), (layer)) "
        "UNION ALL SELECT 'combined', 'nodes', NULL, count(DISTINCT node_id) FROM an UNION ALL SELECT 'combined', 'edges', NULL, count(*) FROM ae"
    )


_MATCH = _MENTIONS + f", p AS (SELECT doc, kind, name, {_PLAIN('name')} AS n FROM men), g AS (SELECT trim(doc_id) AS doc, entity_type AS kind, coalesce(name, title) AS name, {_PLAIN('coalesce(name, title)')} AS n FROM manual_annotations WHERE coalesce(name, title) IS NOT NULL)"
_PRF = _MATCH + ", j AS (SELECT coalesce(a.kind, b.kind) AS kind, count(*) FILTER (a.n IS NOT NULL AND b.n IS NOT NULL) AS tp, count(*) FILTER (b.n IS NULL) AS fp, count(*) FILTER (a.n IS NULL) AS fn FROM (SELECT DISTINCT doc, kind, n FROM p WHERE n <> '') a FULL JOIN (SELECT DISTINCT doc, kind, n FROM g WHERE n <> '') b ON a.doc = b.doc AND a.kind = b.kind AND a.n = b.n GROUP BY 1)"
_SIM = _ALL + f""", fd AS (SELECT {_NUMBER} AS doc, ord, {_T('link')} AS link, concat_ws(' ', nullif(short_summary, ''), nullif(long_summary, ''), nullif(tags, '')) AS profile FROM documents_raw WHERE {_NUMBER} IS NOT NULL),
f1 AS (SELECT doc, min(ord) AS ord, arg_min(link, ord) AS link, arg_min(profile, ord) AS profile FROM fd GROUP BY doc), lr AS (SELECT link, arg_min(doc, ord) AS rep FROM f1 WHERE link <> '' GROUP BY link),
lm AS (SELECT doc, coalesce(rep, doc) AS rep, ord, profile FROM f1 LEFT JOIN lr USING (link))"""
_COSINE = """, pt AS (SELECT DISTINCT rep, tag FROM dt JOIN lm USING (doc)), pn AS (SELECT rep, count(*) AS n FROM pt GROUP BY rep),
tw AS (SELECT rep, unnest(regexp_extract_all(lower(profile), '([a-z0-9]+)', 1)) AS token FROM lm WHERE doc = rep), tf AS (SELECT rep, token, count(*) AS tf FROM tw GROUP BY ALL), df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
w0 AS (SELECT rep, token, tf * ln(((SELECT count(*) FROM lm WHERE doc = rep) + 1) / CAST(df + 1 AS DOUBLE)) AS w FROM tf JOIN df USING (token)), wn AS (SELECT rep, sqrt(sum(w * w)) AS norm FROM w0 WHERE w > 0 GROUP BY rep), ww AS (SELECT rep, token, w / norm AS w FROM w0 JOIN wn USING (rep) WHERE w > 0),
q AS (SELECT DISTINCT rep FROM lm WHERE rep % 50 = 0),
jt AS (SELECT a.rep AS src, b.rep AS dst, count(*) AS both_ FROM pt a JOIN pt b ON a.tag = b.tag AND a.rep <> b.rep WHERE a.rep IN (SELECT rep FROM q) GROUP BY ALL),
jp AS (SELECT src, dst, 0.5 * both_ / (x.n + y.n - both_) AS part FROM jt JOIN pn x ON x.rep = src JOIN pn y ON y.rep = dst),
cw AS (SELECT a.rep AS src, b.rep AS dst, 0.25 * greatest(0, least(1, sum(a.w * b.w))) AS part FROM ww a JOIN ww b ON a.token = b.token AND a.rep <> b.rep WHERE a.rep IN (SELECT rep FROM q) GROUP BY ALL)
SELECT src, dst, round(sum(part), 6)::DOUBLE AS similarity FROM (SELECT * FROM jp UNION ALL SELECT * FROM cw) GROUP BY ALL HAVING sum(part) > 0.25"""

SQL = {
    "layer_sponsor_nodes": _ALL + " " + _SPONSOR,
    "layer_cosponsor_nodes": _ALL + " " + _COSPONSOR,
    "layer_withdrawn_nodes": _ALL + " " + _GONE,
    "layer_community_nodes": _ALL + _LABELS + _COMMUNITY,
    "layer_community_edges": _ALL + _LABELS + "SELECT 'document:' || doc AS src_id, 'IN_COMMUNITY' AS relation, community AS dst_id, 2 AS layer, '1.0' AS detail FROM mb",
    "layer_entity_nodes": _ALL + _ENTITY + " SELECT * FROM ent",
    "layer_entity_edges": _ALL + _ENTITY + " SELECT src_id, relation, dst_id, count(*) AS n FROM ee GROUP BY ALL",
    "multiplex_nodes": _MULTI + " , al AS (SELECT *, 0 AS r FROM l1 UNION ALL SELECT *, 1 FROM l2 UNION ALL SELECT *, 2 FROM l3 UNION ALL SELECT *, 3 FROM l4 UNION ALL SELECT *, 4 FROM ent) SELECT node_id, arg_min(node_type, r) AS node_type, arg_min(label, r) AS label, arg_min(layer, r) AS layer FROM al GROUP BY node_id",
    "multiplex_stats": _stats_sql(list(Y.LAYERS)),
    "multiplex_stats_cosponsor": _stats_sql(["cosponsor", "withdrawn"]),
    "shares_cosponsor_edges": _ALL + ", s AS (SELECT doc, person, min(ord) AS ord FROM active GROUP BY ALL) SELECT 'document:' || a.doc AS src_id, 'SHARES_COSPONSOR' AS relation, 'document:' || b.doc AS dst_id, a.person FROM s a JOIN s b ON a.person = b.person AND a.ord < b.ord",
    "link_members": _SIM + " SELECT doc, rep, ord FROM lm",
    "doc_similarity_edges": _SIM + _COSINE,
    "community_labels": _ALL + _LABELS + "SELECT * FROM lab",
    "generic_names": _MENTIONS + "SELECT kind, lower(trim(name)) AS name, count(*) AS n FROM men WHERE lower(trim(name)) IN (" + ", ".join(f"'{g}'" for g in K.GENERIC) + ") OR length(lower(trim(name))) < 5 GROUP BY 1, 2",
    "valid_extractions": "SELECT organizations IS NOT NULL AND offices IS NOT NULL AND roles IS NOT NULL AS valid, count(*) AS n FROM entity_record GROUP BY 1",
    "community_phrases": _COM + "SELECT community, phrase, meaning FROM cph",
    "review_queue": _QUEUE + "SELECT * FROM queue",
    "review_stats": _QUEUE + "SELECT source, kind, count(*) AS n FROM queue GROUP BY CUBE (source, kind)",
    "memory_roster": _COM + _roster_sql("true") + "SELECT community, kind, name, n AS n_mentions, first_seen FROM in2",
    "novel_mentions": _COM + _roster_sql("record_id % 2 = 0") + "SELECT m.record_id, m.doc, coalesce(com.community, '') AS community, m.kind, CAST(m.pos AS INTEGER) AS pos, m.name FROM men m LEFT JOIN com ON com.doc = m.doc LEFT JOIN best ON best.name = m.name AND best.kind = m.kind LEFT JOIN full_of ON full_of.entity_id = best.entity_id WHERE m.record_id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM in2 WHERE in2.community = coalesce(com.community, '') AND in2.kind = m.kind AND (in2.key = lower(trim(m.name)) OR in2.key = full_of.full_))",
    "graduated_rules": _COM + ", lg AS (SELECT trim(coalesce(doc_id, '')) AS doc, lower(trim(unnest(map_keys(disambiguation_updates)))) AS phrase, organizations[1].name AS resolved FROM entity_record WHERE organizations[1].name IS NOT NULL), ln AS (SELECT coalesce(community, '') AS community, phrase, resolved, count(*) AS n FROM lg LEFT JOIN com USING (doc) GROUP BY ALL HAVING count(*) >= 2), bt AS (SELECT term, arg_max(entity_id, (confidence, -ord)) AS entity_id FROM terms GROUP BY term) SELECT community, phrase, resolved, entity_id, n, CAST(least(0.95, 0.6 + 0.05 * n) AS DOUBLE) AS confidence FROM ln JOIN bt ON term = lower(trim(resolved)) WHERE phrase NOT IN (SELECT term FROM terms)",
    "last_oddities": _COM + "SELECT coalesce(community, '') AS community, CAST(row_number() OVER (PARTITION BY coalesce(community, '') ORDER BY record_id DESC) AS INTEGER) AS k, oddity FROM (SELECT trim(coalesce(doc_id, '')) AS doc, record_id, oddity FROM entity_record WHERE trim(coalesce(oddity, '')) <> '') LEFT JOIN com USING (doc) QUALIFY k <= 3",
    "eval_macro": _PRF + ", f AS (SELECT *, CASE WHEN tp = 0 THEN 0 ELSE 2.0 * (tp / CAST(tp + fp AS DOUBLE)) * (tp / CAST(tp + fn AS DOUBLE)) / (tp / CAST(tp + fp AS DOUBLE) + tp / CAST(tp + fn AS DOUBLE)) END AS f1 FROM j) SELECT CAST(coalesce(round(avg(f1), 4), 0) AS DOUBLE) AS macro_f1, count(*) AS n_kinds FROM f WHERE tp + fp + fn > 0",
    "eval_type_accuracy": _MATCH + ", t AS (SELECT p.kind, x.kind AS gk FROM p JOIN (SELECT DISTINCT doc, kind, n FROM g) x ON p.doc = x.doc AND p.n = x.n) SELECT count(*) AS n_total, count(*) FILTER (kind = gk) AS n_right, CAST(coalesce(round(count(*) FILTER (kind = gk) / nullif(CAST(count(*) AS DOUBLE), 0), 4), 0) AS DOUBLE) AS accuracy FROM t",
    "name_overlap": _MATCH + ", a AS (SELECT DISTINCT doc, lower(trim(name)) AS n FROM p WHERE trim(name) <> ''), b AS (SELECT DISTINCT doc, lower(trim(name)) AS n FROM g WHERE trim(name) <> '') SELECT coalesce(a.doc, b.doc) AS doc, count(*) FILTER (a.n IS NOT NULL AND b.n IS NOT NULL) AS n_both, count(*) FILTER (b.n IS NULL) AS n_a, count(*) FILTER (a.n IS NULL) AS n_b FROM a FULL JOIN b ON a.doc = b.doc AND a.n = b.n GROUP BY 1",
    "contained_names": _MATCH + ", a AS (SELECT DISTINCT doc, lower(trim(name)) AS name FROM p WHERE trim(name) <> ''), b AS (SELECT DISTINCT doc, lower(trim(name)) AS n FROM g WHERE trim(name) <> '') SELECT doc, name FROM a WHERE EXISTS (SELECT 1 FROM b WHERE b.doc = a.doc AND (contains(b.n, a.name) OR contains(a.name, b.n)))",
    "label_totals": _MENTIONS + "SELECT kind, count(*) AS n FROM men GROUP BY kind",
    "report_scalars": """SELECT ord, sha256(canonical_name) AS digest, substr(canonical_name, 1, 35) AS short, 'community:' || CASE WHEN ord < 100 THEN lpad(CAST(ord AS VARCHAR), 3, '0') ELSE CAST(ord AS VARCHAR) END AS numbered, upper(entity_type[1]) || substr(entity_type, 2) AS human, replace(lower(canonical_name), ' ', '-') AS anchor,
 replace(regexp_replace(lower(canonical_name), '[/,]', '', 'g'), ' ', '_') AS stem, rpad(substr(canonical_name, 1, 20), 20, ' ') || ' ' || rpad(substr(CAST(ord AS VARCHAR), 1, 6), 6, ' ') AS line, format('{:,}', ord * 12345) AS thousands, CAST(strpos(canonical_name, substr(canonical_name, 5, 8)) - 1 AS INTEGER) AS at,
 substr(canonical_name, 4, 8) AS around, CAST(ceil(ord / 200.0) AS BIGINT) AS batches, CAST(floor(ord * 1000003 / 1048576.0) AS BIGINT) AS mb, CAST(greatest(0.5, least(3.0, ord / 100.0)) AS DOUBLE) AS clamped, CAST(greatest(1.0, least(9.0, 1.0 + 8.0 * ord / 600)) AS DOUBLE) AS scaled,
 coalesce(metadata['region'], 'none') AS region, CAST(len(list_filter(map_values(metadata), lambda v: v IS NOT NULL AND v <> '')) AS INTEGER) AS n_meta, CAST(len(coalesce(aliases, [])) + CASE WHEN list_contains(coalesce(aliases, []), canonical_name) THEN 0 ELSE 1 END AS INTEGER) AS n_names, coalesce(contains(canonical_name, acronym) AND canonical_name <> acronym, false) AS inside FROM registry""",
    "time_scalars": "SELECT ord, TRY_CAST(nullif(trim(activity_date), '') AS DATE) AS day, strftime(loaded_at, '%Y%m%d_%H%M%S') AS suffix, 0.5::DOUBLE AS left_, strftime(loaded_at, '%Y-%m-%dT%H:%M:%S+00:00') AS iso FROM documents_raw",
}

_SECRETARY = """
WITH s AS (SELECT doc_id, text, string_split(lower(text), 'the secretary') AS p FROM documents WHERE text IS NOT NULL), h AS (SELECT doc_id, text, p, unnest(range(1, len(p))) AS i FROM s WHERE len(p) > 1),
o AS (SELECT doc_id, text, CAST(list_sum(list_transform(p[1:i], lambda x: length(x))) + (i - 1) * 13 AS INTEGER) AS st FROM h)
SELECT doc_id, st AS char_start, st + 13 AS char_end, substr(text, greatest(st - 20, 0) + 1, st + 33 - greatest(st - 20, 0)) AS context FROM o WHERE NOT (st > 0 AND regexp_matches(substr(text, st, 1), '[A-Za-z0-9_]')) AND NOT regexp_matches(substr(text, st + 14, 1), '[A-Za-z0-9_]')"""
_REACH = _ALL.replace("WITH ", "WITH RECURSIVE ", 1) + ", both_ AS (SELECT src AS a, dst AS b FROM ppairs UNION SELECT dst, src FROM ppairs), rc AS (SELECT a AS node, a AS comp FROM both_ UNION SELECT both_.b, rc.comp FROM rc JOIN both_ ON both_.a = rc.node), cc AS (SELECT node, min(comp) AS component FROM rc GROUP BY node) "
SQL |= {
    "connected_components": _REACH + "SELECT node, component FROM cc",
    "largest_component": _REACH + "SELECT node FROM cc WHERE component = (SELECT component FROM cc GROUP BY component ORDER BY count(*) DESC, component LIMIT 1)",
    "closeness": _ALL.replace("WITH ", "WITH RECURSIVE ", 1) + ", und AS (SELECT src AS a, dst AS b FROM apairs UNION SELECT dst, src FROM apairs), nn AS (SELECT DISTINCT a AS n FROM und), bf AS (SELECT n AS s, n AS v, 0 AS d FROM nn UNION SELECT s, b, d + 1 FROM bf JOIN und ON a = v WHERE d < 8), ds AS (SELECT s, v, min(d) AS d FROM bf GROUP BY s, v), t AS (SELECT s, count(*) - 1 AS r, sum(d) AS total FROM ds GROUP BY s) SELECT s AS node, CASE WHEN total = 0 THEN 0 ELSE (r / CAST(total AS DOUBLE)) * (r / CAST((SELECT count(*) FROM nn) - 1 AS DOUBLE)) END AS closeness FROM t",
    "eval_prf": _PRF + " SELECT kind, tp, fp, fn, CASE WHEN tp + fp = 0 THEN 0 ELSE CAST(tp AS DOUBLE) / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 0 ELSE CAST(tp AS DOUBLE) / (tp + fn) END AS recall, CASE WHEN tp = 0 THEN 0 ELSE 2 * (CAST(tp AS DOUBLE) / (tp + fp)) * (CAST(tp AS DOUBLE) / (tp + fn)) / (CAST(tp AS DOUBLE) / (tp + fp) + CAST(tp AS DOUBLE) / (tp + fn)) END AS f1 FROM j",
    "cooccurrence_matrix": _ALL + ", co AS (SELECT a.tag AS src, b.tag AS dst, count(*) AS weight FROM dt a JOIN dt b USING (doc) WHERE a.grp = 'strategies' AND b.grp = 'harms' GROUP BY ALL) SELECT src, CAST(coalesce(COLUMNS(* EXCLUDE (src)), 0) AS BIGINT) FROM (PIVOT co ON dst USING sum(weight) GROUP BY src)",
    "soft_alias_spans": _SECRETARY,
}
