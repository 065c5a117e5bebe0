"""Graph, legislator and network queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.operators import graph as G
from quillmesh.operators import legislators as L
from quillmesh.operators import networks as N
from quillmesh.operators.components import connected_components
from quillmesh.plans.data_quality import _NUMBER
from quillmesh.session import materialize
from quillmesh.sources.tables import table

SEED = "document:1"


def _rows(spark: SparkSession, sf: str) -> DataFrame:
    return G.graph_rows(*[table(spark, sf, t) for t in ("documents_raw", "segments_raw", "authorities", "collections")])


def kg_nodes(spark, sf):
    return G.graph_nodes(_rows(spark, sf))


def kg_edges(spark, sf):
    return G.graph_edges(_rows(spark, sf)).select("src_id", "relation", "dst_id")


def kg_stats(spark, sf):
    rows = _rows(spark, sf)
    return G.graph_stats(G.graph_nodes(rows), G.graph_edges(rows))


def _near(**options):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        rows = _rows(spark, sf)
        nodes, edges = materialize(G.graph_nodes(rows), "nodes"), materialize(G.graph_edges(rows), "graph-edges")
        return G.neighborhood(nodes, edges, **({"seed": SEED, "limit": 50} | options)).drop("path")

    return query


NEAR = {
    "neighborhood_out": {"max_hops": 2},
    "neighborhood_in": {"direction": "in", "seed": "collection:treaties", "max_hops": 1},
    "neighborhood_both": {"direction": "both", "max_hops": 2},
    "neighborhood_relation_filtered": {"relations": {"HAS_SEGMENT", "HAS_TOPIC"}},
    "neighborhood_type_filtered": {"node_types": {"Topic"}},
    "neighborhood_unranked": {"ranked": False, "limit": 25},
}


def hop_histogram(spark, sf):
    return G.hop_counts(_near(limit=100)(spark, sf))


def _people(spark, sf):
    return table(spark, sf, "cosponsor_rows")


def _sponsors(spark, sf):
    return _people(spark, sf).where("is_original")


def _documents(spark, sf):
    return table(spark, sf, "documents_raw")


def _pairs(spark, sf):
    return materialize(L.person_pairs(_people(spark, sf)), "pairs")


def _area_graph(spark, sf):
    return materialize(L.area_pairs(_people(spark, sf), _documents(spark, sf)), "areas")


def coalition_stability(spark, sf):
    whole = N.communities(_pairs(spark, sf), "greedy")
    areas = L.areas(_documents(spark, sf))
    facts = L.facts(_people(spark, sf)).join(areas, "doc").where("area IS NOT NULL").select("area", "doc", "person").distinct()
    top = facts.groupBy("area").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "area").limit(8).select("area")
    f = facts.join(top, "area", "left_semi")
    inside = f.toDF("area", "doc", "src").join(f.toDF("area", "doc", "dst"), ["area", "doc"]).where("src < dst").groupBy("area", "src", "dst").agg(F.count("*").alias("weight"))
    named = inside.select("area", F.concat_ws("\u001f", "area", "src").alias("src"), F.concat_ws("\u001f", "area", "dst").alias("dst"), "weight")
    local = N.communities(named, "greedy", part="area").select(F.split_part("node", F.lit("\u001f"), F.lit(1)).alias("area"), "community", F.split_part("node", F.lit("\u001f"), F.lit(2)).alias("node"))
    return N.stability(local, whole.select("node", "community"))


QUERIES = {
    "kg_nodes": kg_nodes,
    "kg_edges": kg_edges,
    "kg_stats": kg_stats,
    **{name: _near(**options) for name, options in NEAR.items()},
    "hop_histogram": hop_histogram,
    "sponsor_nodes_first_wins": lambda s, d: L.person_nodes(_sponsors(s, d), "first"),
    "cosponsor_nodes_last_wins": lambda s, d: L.person_nodes(L.active(_people(s, d)), "last"),
    "sponsored_by_edges": lambda s, d: L.sponsorship_edges(_sponsors(s, d), "SPONSORED_BY").groupBy("src_id", "relation", "dst_id").agg(F.count("*").alias("n")),
    "shares_cosponsor_counts": lambda s, d: L.shares_counts(L.active(_people(s, d))),
    "cosponsor_stats": lambda s, d: L.layer_stats(_people(s, d)),
    "breadth_depth": lambda s, d: L.breadth_depth(_people(s, d), _documents(s, d)),
    "top_generalists": lambda s, d: L.top_people(L.breadth_depth(_people(s, d), _documents(s, d))),
    "top_specialists": lambda s, d: L.top_people(L.breadth_depth(_people(s, d), _documents(s, d)), specialists=True),
    "chamber_pivot": lambda s, d: L.chamber_pivot(_people(s, d)),
    "chamber_avg": lambda s, d: L.chamber_pivot(_people(s, d)).agg(F.avg("house").alias("house"), F.avg("senate").alias("senate")),
    "chamber_area_counts": lambda s, d: L.chamber_areas(_people(s, d), _documents(s, d)),
    "bipartisanship_by_doc": lambda s, d: L.bipartisanship(_people(s, d)),
    "bipartisanship_summary": lambda s, d: L.bipartisanship_summary(L.bipartisanship(_people(s, d))),
    "integration_score": lambda s, d: L.integration(_people(s, d), _documents(s, d)),
    "dominant_party": lambda s, d: L.party_mode(_people(s, d)),
    "party_top_areas": lambda s, d: L.ranked_areas(_people(s, d), _documents(s, d)),
    "cosponsor_projection": lambda s, d: L.person_pairs(_people(s, d)),
    "policy_cooccurrence": lambda s, d: L.area_pairs(_people(s, d), _documents(s, d)),
    "weighted_degree": lambda s, d: L.degrees(L.area_pairs(_people(s, d), _documents(s, d))),
    "cross_party_edges": lambda s, d: L.cross_party(L.person_pairs(_people(s, d)), L.person_nodes(_people(s, d))),
    "cross_ratio": lambda s, d: L.cross_ratio(L.person_pairs(_people(s, d)), L.person_nodes(_people(s, d))),
    "clustering_coefficient": lambda s, d: L.clustering(L.person_pairs(_people(s, d))),
    "connected_components": lambda s, d: connected_components(_pairs(s, d)),
    "betweenness": lambda s, d: N.betweenness(_area_graph(s, d), weighted=True),
    "betweenness_unweighted": lambda s, d: N.betweenness(_pairs(s, d)),
    "closeness": lambda s, d: N.closeness(_area_graph(s, d)),
    "eigenvector": lambda s, d: N.eigenvector(_area_graph(s, d)),
    "louvain": lambda s, d: N.communities(_pairs(s, d), "louvain", 1.5),
    "subcluster": lambda s, d: N.communities(_pairs(s, d), "louvain", 1.5, most=80),
    "greedy_modularity": lambda s, d: N.communities(_area_graph(s, d), "greedy"),
    "coalition_stability": coalition_stability,
}

_T = lambda c: f"trim(coalesce({c}, ''))"
_SAFE = lambda c: f"coalesce(nullif(trim(regexp_replace(lower(coalesce({c}, '')), '[^\\p{{L}}\\p{{N}}_.-]', '_', 'g'), '_'), ''), 'unknown')"
_ID = lambda kind, c: f"'{kind}:' || {_SAFE(c)}"
_SQUEEZE = lambda c: f"trim(regexp_replace(coalesce({c}, ''), '\\s+', ' ', 'g'))"
_LIST = lambda c: f"list_filter(list_transform(string_split(coalesce({c}, ''), ';'), lambda x: trim(x)), lambda x: x <> '')"
_TOPICS = "list_filter(list_transform(coalesce(taxonomy_tags, []), lambda x: trim(coalesce(x, ''))), lambda x: x <> '')"

_KG = f"""
WITH seg AS (SELECT *, CAST({_NUMBER} AS VARCHAR) AS d, {_T('position')} AS p FROM segments_raw WHERE {_NUMBER} IS NOT NULL AND {_T('position')} <> ''),
doc AS (SELECT *, CAST({_NUMBER} AS VARCHAR) AS d FROM documents_raw WHERE {_NUMBER} IS NOT NULL),
st AS (SELECT ord, d, p, len({_LIST('tags')}) AS nt, unnest({_LIST('tags')}) AS t, generate_subscripts({_LIST('tags')}, 1) AS i FROM seg),
so AS (SELECT ord, d, p, len({_LIST('tags')}) AS nt, unnest({_TOPICS}) AS t, generate_subscripts({_TOPICS}, 1) AS i FROM seg),
dc AS (SELECT ord, d, CASE WHEN {_T('authority')} <> '' THEN 1 ELSE 0 END AS na, unnest({_LIST('collections')}) AS t, generate_subscripts({_LIST('collections')}, 1) AS i FROM doc),
dt AS (SELECT ord, d, CASE WHEN {_T('authority')} <> '' THEN 1 ELSE 0 END + len({_LIST('collections')}) AS na, unnest({_LIST('tags')}) AS t, generate_subscripts({_LIST('tags')}, 1) AS i FROM doc),
cand AS (
 SELECT 1 AS stage, ord, 0 AS sub, {_ID('authority', _T('name'))} AS node_id, 'Authority' AS node_type, {_SQUEEZE('name')} AS label FROM authorities WHERE {_T('name')} <> ''
 UNION ALL SELECT 2, ord, 0, {_ID('collection', _T('name'))}, 'Collection', {_SQUEEZE('name')} FROM collections WHERE {_T('name')} <> ''
 UNION ALL SELECT 3, ord, 0, {_ID('segment', "d || ':' || p")}, 'Segment', {_SQUEEZE("'Segment ' || p")} FROM seg
 UNION ALL SELECT 3, ord, i, {_ID('tag', 't')}, 'Tag', {_SQUEEZE('t')} FROM st
 UNION ALL SELECT 3, ord, nt + i, {_ID('topic', 't')}, 'Topic', {_SQUEEZE('t')} FROM so
 UNION ALL SELECT 4, ord, 0, {_ID('document', 'd')}, 'Document', {_SQUEEZE(f"coalesce(nullif({_T('official_name')}, ''), 'Document ' || d)")} FROM doc
 UNION ALL SELECT 4, ord, 1, {_ID('authority', _T('authority'))}, 'Authority', {_SQUEEZE('authority')} FROM doc WHERE {_T('authority')} <> ''
 UNION ALL SELECT 4, ord, na + i, {_ID('collection', 't')}, 'Collection', {_SQUEEZE('t')} FROM dc
 UNION ALL SELECT 4, ord, na + i, {_ID('tag', 't')}, 'Tag', {_SQUEEZE('t')} FROM dt),
nodes AS (SELECT node_id, arg_min(node_type, (stage, ord, sub)) AS node_type, arg_min(label, (stage, ord, sub)) AS label FROM cand GROUP BY node_id),
link AS (
 SELECT 3 AS stage, ord, 0 AS sub, {_ID('document', 'd')} AS src_id, 'HAS_SEGMENT' AS relation, {_ID('segment', "d || ':' || p")} AS dst_id FROM seg
 UNION ALL SELECT 3, ord, i, {_ID('segment', "d || ':' || p")}, 'HAS_TAG', {_ID('tag', 't')} FROM st
 UNION ALL SELECT 3, ord, nt + i, {_ID('segment', "d || ':' || p")}, 'HAS_TOPIC', {_ID('topic', 't')} FROM so
 UNION ALL SELECT 4, ord, 0, {_ID('document', 'd')}, 'UNDER_AUTHORITY', {_ID('authority', _T('authority'))} FROM doc WHERE {_T('authority')} <> ''
 UNION ALL SELECT 4, ord, na + i - 1, {_ID('document', 'd')}, 'IN_COLLECTION', {_ID('collection', 't')} FROM dc
 UNION ALL SELECT 4, ord, na + i - 1, {_ID('document', 'd')}, 'HAS_TAG', {_ID('tag', 't')} FROM dt),
edges AS (SELECT src_id, relation, dst_id, min((stage, ord, sub)) AS o FROM link GROUP BY ALL)
"""

_WEIGHT = "CASE via " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in G.DEFAULT_WEIGHTS.items()) + " ELSE 0.5 END"


def _walk(seed=SEED, max_hops=2, limit=50, direction="out", relations=None, node_types=None, ranked=True) -> str:
    keep = f"WHERE relation IN ({', '.join(repr(r) for r in sorted(relations))})" if relations else ""
    steps = []
    if direction in ("out", "both"):
        steps.append(f"SELECT src_id AS a, relation, dst_id AS b, (0, o) AS k FROM edges {keep}")
    if direction in ("in", "both"):
        steps.append(f"SELECT dst_id AS a, relation, src_id AS b, (1, o) AS k FROM edges {keep}")
    first = f"h1 AS (SELECT b AS node_id, min([k]) AS trail, arg_min(relation, [k]) AS via FROM steps WHERE a = '{seed}' AND b <> '{seed}' GROUP BY b)"
    second = f""", h2 AS (SELECT b AS node_id, min(list_append(trail, k)) AS trail, arg_min(via, list_append(trail, k)) AS via
      FROM h1 JOIN steps ON a = h1.node_id WHERE b <> '{seed}' AND b NOT IN (SELECT node_id FROM h1) GROUP BY b)"""
    found = "SELECT node_id, 1 AS hop, via FROM h1" + (" UNION ALL SELECT node_id, 2, via FROM h2" if max_hops > 1 else "")
    types = f"WHERE node_type IN ({', '.join(repr(t) for t in sorted(node_types))})" if node_types else ""
    order = ("rank_score DESC, " if ranked else "") + "hop_distance, node_type, node_id"
    return (
        _KG
        + f", steps AS ({' UNION ALL '.join(steps)}), {first}{second if max_hops > 1 else ''}, found AS ({found}) "
        + f"SELECT f.node_id, coalesce(node_type, '') AS node_type, coalesce(label, '') AS label, CAST(hop AS INTEGER) AS hop_distance, via AS via_relation, "
        + f"round(CAST({_WEIGHT} AS DOUBLE) * pow(0.7, hop - 1), 8) AS rank_score FROM found f LEFT JOIN nodes n ON f.node_id = n.node_id {types} ORDER BY {order} LIMIT {limit}"
    )


_FACTS = f"""
WITH facts AS (SELECT *, {_NUMBER} AS doc, {_T('person_id')} AS person FROM cosponsor_rows WHERE {_NUMBER} IS NOT NULL AND {_T('person_id')} <> ''),
areas AS (SELECT doc, arg_min(coalesce(area, '∅'), ord) AS a FROM (SELECT {_NUMBER} AS doc, ord, nullif({_T('authority')}, '') AS area FROM documents_raw) WHERE doc IS NOT NULL GROUP BY doc),
fa AS (SELECT facts.*, nullif(a, '∅') AS area FROM facts LEFT JOIN areas USING (doc)),
active AS (SELECT * FROM facts WHERE NOT coalesce(is_withdrawn, false)),
ppairs AS (SELECT x.person AS src, y.person AS dst, count(*) AS weight FROM (SELECT DISTINCT doc, person FROM facts) x JOIN (SELECT DISTINCT doc, person FROM facts) y
  ON x.doc = y.doc AND x.person < y.person GROUP BY ALL HAVING count(*) >= 2),
apairs AS (SELECT x.area AS src, y.area AS dst, count(*) AS weight FROM (SELECT DISTINCT person, area FROM fa WHERE area IS NOT NULL) x
  JOIN (SELECT DISTINCT person, area FROM fa WHERE area IS NOT NULL) y ON x.person = y.person AND x.area < y.area GROUP BY ALL)
"""
_DISTRICT = "CASE WHEN {d} = '' OR lower({d}) = 'nan' THEN '' WHEN TRY_CAST({d} AS DOUBLE) IS NOT NULL THEN CAST(CAST(trunc(CAST({d} AS DOUBLE)) AS BIGINT) AS VARCHAR) ELSE {d} END".replace("{d}", "trim(coalesce(a.district, ''))")
_BARE = "trim(regexp_replace(regexp_replace(coalesce(a.full_name, ''), '^(Rep\\.|Sen\\.|Del\\.)\\s*', ''), '\\s*\\[.*\\]\\s*$', ''))"
_LONG = "CASE WHEN full_name LIKE 'Sen.%' THEN 'Senate' WHEN full_name LIKE 'Rep.%' THEN 'House' ELSE 'Unknown' END"


def _person_sql(source: str, pick: str) -> str:
    return (
        _FACTS
        + f", s AS (SELECT person, {pick}(struct_pack(full_name, party, state, district), ord) AS a FROM {source} GROUP BY person) "
        + f"SELECT 'sponsor:' || person AS node_id, {_T('a.full_name')} AS full_name, trim(split_part({_BARE}, ',', 1)) AS last_name, "
        + f"CASE WHEN contains({_BARE}, ',') THEN trim(substr({_BARE}, strpos({_BARE}, ',') + 1)) ELSE '' END AS first_name, "
        + f"{_T('a.party')} AS party, {_T('a.state')} AS state, {_DISTRICT} AS district, "
        + f"CASE WHEN {_T('a.full_name')} LIKE 'Rep.%' THEN 'Rep' WHEN {_T('a.full_name')} LIKE 'Sen.%' THEN 'Sen' WHEN {_T('a.full_name')} LIKE 'Del.%' THEN 'Del' ELSE '' END AS chamber FROM s"
    )


def _known(c: str) -> str:
    return f"arg_min({_T(c)}, ord) FILTER ({_T(c)} <> '') AS {c}"


_BREADTH = _FACTS + f", bd AS (SELECT person, count(DISTINCT doc) AS n_docs, count(DISTINCT area) AS n_areas, {_known('full_name')}, {_known('party')}, {_known('state')} FROM fa GROUP BY person) "
_PIVOT = _FACTS + f", cp AS (SELECT doc, count(*) FILTER ({_LONG} = 'House') AS house, count(*) FILTER ({_LONG} = 'Senate') AS senate, count(*) FILTER ({_LONG} = 'Unknown') AS unknown FROM facts GROUP BY doc) "
_BIP = (
    _FACTS
    + ", b AS (SELECT doc, count(*) FILTER (upper(trim(party)) = 'D') AS n_d, count(*) FILTER (upper(trim(party)) = 'R') AS n_r, count(*) AS n_all FROM active GROUP BY doc), "
    + 'bi AS (SELECT *, CASE WHEN n_d + n_r = 0 THEN 0.0 ELSE CAST(least(n_d, n_r) AS DOUBLE) / (n_d + n_r) END AS "index" FROM b) '
)
_DEGREES = "SELECT node, count(*) AS degree, CAST(sum(weight) AS BIGINT) AS weighted_degree FROM (SELECT src AS node, weight FROM {t} UNION ALL SELECT dst, weight FROM {t}) GROUP BY node"
_PEOPLE_PARTY = f", pp AS (SELECT person, {_T('arg_min(coalesce(party, chr(32)), ord)')} AS party FROM facts GROUP BY person)"
_CROSS = (
    _FACTS
    + _PEOPLE_PARTY
    + ", cr AS (SELECT src, dst, weight, x.party AS party_src, y.party AS party_dst FROM ppairs JOIN pp x ON src = x.person JOIN pp y ON dst = y.person WHERE x.party <> '' AND y.party <> '' AND x.party <> y.party) "
)

SQL = {
    "kg_nodes": _KG + "SELECT * FROM nodes",
    "kg_edges": _KG + "SELECT src_id, relation, dst_id FROM edges",
    "kg_stats": _KG + "SELECT 'nodes' AS what, node_type AS kind, count(*) AS n FROM nodes GROUP BY ROLLUP (node_type) UNION ALL SELECT 'edges', relation, count(*) FROM edges GROUP BY ROLLUP (relation)",
    **{name: _walk(**options) for name, options in NEAR.items()},
    "hop_histogram": f"SELECT hop_distance, count(*) AS n FROM ({_walk(limit=100)}) GROUP BY hop_distance",
    "sponsor_nodes_first_wins": _person_sql("(SELECT * FROM facts WHERE is_original)", "arg_min"),
    "cosponsor_nodes_last_wins": _person_sql("active", "arg_max"),
    "sponsored_by_edges": _FACTS + "SELECT 'document:' || doc AS src_id, 'SPONSORED_BY' AS relation, 'sponsor:' || person AS dst_id, count(*) AS n FROM facts WHERE is_original GROUP BY ALL",
    "shares_cosponsor_counts": _FACTS + "SELECT person, count(DISTINCT doc) AS n_docs, CAST(count(DISTINCT doc) * (count(DISTINCT doc) - 1) // 2 AS BIGINT) AS n_pairs FROM active GROUP BY person HAVING count(DISTINCT doc) > 1",
    "cosponsor_stats": _FACTS
    + f"SELECT (SELECT count(*) FROM cosponsor_rows) AS n_rows, (SELECT count(*) FROM cosponsor_rows WHERE {_NUMBER} IS NOT NULL AND {_T('person_id')} = '') AS skipped_no_person, "
    + "count(DISTINCT doc) AS n_docs, count(DISTINCT person) AS n_persons, count(*) AS n_edges FROM facts",
    "breadth_depth": _BREADTH + "SELECT * FROM bd",
    "top_generalists": _BREADTH + "SELECT * FROM bd ORDER BY n_areas DESC, n_docs DESC, person LIMIT 10",
    "top_specialists": _BREADTH + "SELECT * FROM bd WHERE n_areas <= 2 ORDER BY n_docs DESC, person LIMIT 10",
    "chamber_pivot": _PIVOT + "SELECT * FROM cp",
    "chamber_avg": _PIVOT + "SELECT avg(house) AS house, avg(senate) AS senate FROM cp",
    "chamber_area_counts": _FACTS + f"SELECT {_LONG} AS chamber, area, count(*) AS n FROM fa WHERE area IS NOT NULL GROUP BY ALL",
    "bipartisanship_by_doc": _BIP + "SELECT * FROM bi",
    "bipartisanship_summary": _BIP + 'SELECT count(*) AS n_docs, count(*) FILTER ("index" > 0.45) AS n_balanced, count(*) FILTER ("index" = 0) AS n_partisan, median("index") AS median_index FROM bi',
    "integration_score": _FACTS
    + ", pa AS (SELECT DISTINCT person, coalesce(area, '∅') AS area FROM fa), br AS (SELECT person, count(*) AS n_areas FROM pa GROUP BY person) "
    + "SELECT area, count(*) AS n_people, count(*) FILTER (n_areas > 1) AS n_multi, CAST(sum(n_areas) AS BIGINT) AS sum_areas, CAST(count(*) FILTER (n_areas > 1) AS DOUBLE) / count(*) AS share_multi FROM pa JOIN br USING (person) WHERE area <> '∅' GROUP BY area",
    "dominant_party": _FACTS
    + f", c AS (SELECT doc, trim(party) AS party, count(*) AS n, min(ord) AS o FROM facts WHERE {_T('party')} <> '' GROUP BY ALL) SELECT doc, party, n FROM c QUALIFY row_number() OVER (PARTITION BY doc ORDER BY n DESC, o) = 1",
    "party_top_areas": _FACTS
    + ", c AS (SELECT trim(party) AS party, area, count(*) AS n FROM fa WHERE area IS NOT NULL AND trim(party) <> '' GROUP BY ALL) SELECT *, CAST(row_number() OVER (PARTITION BY party ORDER BY n DESC, area) AS INTEGER) AS rank FROM c QUALIFY rank <= 3",
    "cosponsor_projection": _FACTS + "SELECT * FROM ppairs",
    "policy_cooccurrence": _FACTS + "SELECT * FROM apairs",
    "weighted_degree": _FACTS + f", d AS ({_DEGREES.replace('{t}', 'apairs')}) SELECT *, CAST(degree AS DOUBLE) / ((SELECT count(*) FROM d) - 1) AS degree_centrality FROM d",
    "cross_party_edges": _CROSS + "SELECT * FROM cr",
    "cross_ratio": _CROSS
    + f", t AS ({_DEGREES.replace('{t}', 'ppairs')}), x AS ({_DEGREES.replace('{t}', 'cr')}) SELECT t.node, t.degree, x.degree AS cross_degree, CAST(x.degree AS DOUBLE) / t.degree AS cross_ratio FROM x JOIN t USING (node)",
    "clustering_coefficient": _FACTS
    + f", e AS (SELECT src AS a, dst AS b FROM ppairs UNION ALL SELECT dst, src FROM ppairs), t AS (SELECT x.a AS node, count(*) // 2 AS triangles FROM e x JOIN e y ON x.a = y.a AND x.b <> y.b JOIN e z ON z.a = x.b AND z.b = y.b GROUP BY x.a), d AS ({_DEGREES.replace('{t}', 'ppairs')}) "
    + "SELECT node, degree, CAST(coalesce(triangles, 0) AS BIGINT) AS triangles, CASE WHEN degree > 1 THEN 2.0 * coalesce(triangles, 0) / (degree * (degree - 1)) ELSE 0.0 END AS clustering FROM d LEFT JOIN t USING (node)",
}
