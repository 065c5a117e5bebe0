"""Taxonomy, entity, scalar and sink queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.functions import ids, text, truth
from quillmesh.operators import assessment as Q
from quillmesh.operators import entities as E
from quillmesh.operators import taxonomy as T
from quillmesh.plans.data_quality import _NUMBER
from quillmesh.session import materialize
from quillmesh.sources.tables import table
from quillmesh.sources.writers import merge_by_key

GENERIC = ["agency", "department", "the board", "the committee", "board", "committee"]


def _tags(spark: SparkSession, sf: str) -> DataFrame:
    return T.segment_tags(table(spark, sf, "segments_raw"))


def _records(spark, sf):
    return table(spark, sf, "entity_record")


def _registry(spark, sf):
    return table(spark, sf, "registry")


def _gold(spark, sf):
    g = table(spark, sf, "manual_annotations").select(F.trim("doc_id").alias("doc"), F.col("entity_type").alias("kind"), F.coalesce("name", "title").alias("name"), F.col("annotation_id").alias("pos"))
    return g.where("name IS NOT NULL")


def _predicted(spark, sf):
    return E.mentions(_records(spark, sf)).select("doc", "kind", "name", F.struct("record_id", "pos").alias("pos"))


def truth_dialects(spark, sf):
    f = table(spark, sf, "segments_raw").select("ord", F.col("non_operative").alias("v"))
    v = F.col("v")
    return f.select("ord", truth.graph_flag(v).alias("graph"), truth.exact_flag(v).alias("exact"), truth.government_flag(v).alias("government"), truth.sync_flag(v).alias("sync"), truth.sync_optional(v).alias("optional"), truth.demo_flag(v).alias("demo"))


def slug_dialects(spark, sf):
    r = _registry(spark, sf)
    n, k = F.col("canonical_name"), F.col("entity_type")
    return r.select("ord", ids.safe_id(n).alias("safe"), ids.entity_id(n, k).alias("entity"), ids.sync_id(n, k).alias("sync"), ids.layer_slug(n).alias("layer"), ids.dropping_slug(n).alias("dropping"))


def tag_signature(spark, sf):
    t = _tags(spark, sf).where("doc IS NOT NULL").select(F.pmod("doc", F.lit(50)).alias("grp"), F.col("doc").alias("member"), "tag").distinct()
    return T.signature(t).select("grp", "size", "label", F.array_join("signature", "|").alias("signature"))


def cooccurrence_matrix(spark, sf):
    pairs = materialize(T.cooccurrence(_tags(spark, sf), "strategies", "harms"), "cooccurrence")
    return T.matrix(pairs, [r[0] for r in pairs.select("dst").distinct().collect()])


def upsert_merge(spark, sf):
    d = table(spark, sf, "documents_raw").select("ord", "doc_id", "official_name", "loaded_at")
    old, new = d.where("deleted_at IS NULL OR true").where("ord % 3 <> 0"), d.where("ord % 3 = 0").withColumn("official_name", F.upper("official_name"))
    return merge_by_key(old, new.unionByName(old.where("ord % 5 = 0").withColumn("official_name", F.lower("official_name"))), ["ord"]).select("ord", "official_name")


def json_props(spark, sf):
    e = table(spark, sf, "events").select("event_id", "event_type", F.from_json("props", "k bigint").alias("p"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.count("p.k").alias("n_k"), F.sum("p.k").alias("sum_k"))


def resume_antijoin(spark, sf):
    done = _records(spark, sf).select(F.trim("doc_id").alias("doc")).distinct()
    docs = table(spark, sf, "documents").select("doc_id", F.col("doc_id").cast("string").alias("doc"))
    return docs.join(done, "doc", "left_anti").select("doc_id")


def _profiles(spark, sf):
    """Summaries and tags of every catalogue row in one text."""
    return table(spark, sf, "documents_raw").select("ord", F.concat_ws(" ", "short_summary", "long_summary", "tags").alias("profile"))


def dense_cosine(spark, sf):
    v = table(spark, sf, "embeddings")
    return T.cosine_to(v, "vec_id", "embedding", v.where("vec_id % 50 = 0")).select("query", "vec_id", F.round("cosine", 6).alias("cosine"))


def chunk_text(spark, sf):
    return E.sections(table(spark, sf, "documents"), "doc_id", "text").select("doc_id", "chunk", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


def soft_alias_spans(spark, sf):
    return E.soft_aliases(table(spark, sf, "documents"), "doc_id", "text", "the Secretary")


QUERIES = {
    "split_explode_tags": lambda s, d: table(s, d, "segments_raw").select("ord", F.posexplode(text.split_list(F.col("tags"))).alias("pos", "tag")),
    "tag_totals": lambda s, d: T.tag_totals(_tags(s, d)),
    "group_totals": lambda s, d: T.group_totals(_tags(s, d)),
    "taxonomy_hierarchy": lambda s, d: T.hierarchy(table(s, d, "taxonomy")),
    "taxonomy_cooccurrence": lambda s, d: T.cooccurrence(_tags(s, d), "strategies", "harms"),
    "harm_strategy_support": lambda s, d: T.cooccurrence(_tags(s, d), "harms", "strategies", 4),
    "cooccurrence_matrix": cooccurrence_matrix,
    "tag_signature": tag_signature,
    "segments_per_doc": lambda s, d: T.segments_per_document(table(s, d, "segments_raw")),
    "coverage_ratios": lambda s, d: T.coverage(table(s, d, "documents_raw")),
    "top_authorities": lambda s, d: table(s, d, "documents_raw").where("trim(authority) <> ''").groupBy(F.trim("authority").alias("authority")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "authority").limit(15),
    "tfidf_totals": lambda s, d: T.tfidf(_profiles(s, d), "ord", "profile").groupBy("token", "df").agg(F.sum("tf").alias("tf")),
    "tfidf_weights": lambda s, d: T.tfidf(_profiles(s, d), "ord", "profile").select("ord", "token", F.round("weight", 6).alias("weight")),
    "tag_jaccard_edges": lambda s, d: T.jaccard_pairs(_tags(s, d).where("doc IS NOT NULL").select(F.col("doc").alias("item"), "tag"), 0.25, queries="item % 50 = 0"),
    "dense_cosine_edges": dense_cosine,
    "entity_coverage": lambda s, d: E.coverage(_records(s, d)),
    "token_usage": lambda s, d: E.token_usage(_records(s, d)),
    "registry_terms": lambda s, d: E.registry_terms(_registry(s, d)).select("term", "entity_id", "entity_type"),
    "registry_stats": lambda s, d: E.registry_stats(_registry(s, d)),
    "canonical_term_map": lambda s, d: E.term_map(_registry(s, d)),
    "resolve_terms": lambda s, d: E.resolve(E.mentions(_records(s, d)), E.registry_terms(_registry(s, d))).groupBy("kind", "entity_id").agg(F.count("*").alias("n")),
    "dictionary_entries": lambda s, d: E.dictionary(_records(s, d)),
    "bare_alias_queue": lambda s, d: E.bare_aliases(_records(s, d), _registry(s, d), GENERIC),
    "confidence_scores": lambda s, d: E.scored(_records(s, d), _registry(s, d), _gold(s, d)),
    "memory_first_wins": lambda s, d: E.memory(_records(s, d)),
    "graduation_candidates": lambda s, d: E.graduates(_records(s, d), 2),
    "eval_prf": lambda s, d: E.evaluate_exact(_predicted(s, d), _gold(s, d)),
    "eval_fuzzy": lambda s, d: Q.by_kind(Q.matched(_predicted(s, d), _gold(s, d))).select("kind", "tp", "fp", "fn"),
    "truth_dialects": truth_dialects,
    "slug_dialects": slug_dialects,
    "upsert_merge": upsert_merge,
    "json_props_parse": json_props,
    "resume_antijoin": resume_antijoin,
    "catalogue_search": lambda s, d: table(s, d, "documents_raw").where(F.lower(F.concat_ws(" ", "doc_id", "official_name", "casual_name")).contains("audit")).select("ord", "official_name"),
    "chunk_text": chunk_text,
    "soft_alias_spans": soft_alias_spans,
}

_LIST = "list_filter(list_transform(string_split(coalesce(tags, ''), ';'), lambda x: trim(x)), lambda x: x <> '')"
_TAGS = f"""
WITH raw AS (SELECT ord, {_NUMBER} AS doc, list_distinct(list_filter(list_transform(coalesce(taxonomy_tags, []), lambda x: lower(trim(coalesce(x, '')))), lambda x: x <> '')) AS ts FROM segments_raw),
tags AS (SELECT ord, doc, unnest(ts) AS tag FROM raw),
dt AS (SELECT DISTINCT doc, tag, trim(split_part(tag, ':', 1)) AS grp FROM tags WHERE doc IS NOT NULL)
"""
_CO = _TAGS + ", co AS (SELECT a.tag AS src, b.tag AS dst, count(*) AS weight FROM dt a JOIN dt b USING (doc) WHERE a.grp = '{a}' AND b.grp = '{b}' GROUP BY ALL) "
_MENTIONS = """
WITH m AS (SELECT record_id, trim(doc_id) AS doc, 'organizations' AS kind, unnest(organizations).name AS name, generate_subscripts(organizations, 1) - 1 AS pos FROM entity_record
 UNION ALL SELECT record_id, trim(doc_id), 'offices', unnest(offices).name, generate_subscripts(offices, 1) - 1 FROM entity_record
 UNION ALL SELECT record_id, trim(doc_id), 'roles', unnest(roles).title, generate_subscripts(roles, 1) - 1 FROM entity_record),
men AS (SELECT * FROM m WHERE trim(coalesce(name, '')) <> ''),
t0 AS (SELECT ord, entity_id, entity_type, confidence, unnest(list_concat([canonical_name, acronym], coalesce(aliases, []))) AS t FROM registry),
terms AS (SELECT lower(trim(t)) AS term, entity_id, any_value(entity_type) AS entity_type, any_value(confidence) AS confidence, min(ord) AS ord FROM t0 WHERE trim(coalesce(t, '')) <> '' GROUP BY 1, 2),
best AS (SELECT name, kind, arg_max(entity_id, (CAST(entity_type = kind AS INTEGER), confidence, -ord)) AS entity_id FROM (SELECT DISTINCT name, kind FROM men) n JOIN terms ON lower(trim(name)) = term GROUP BY ALL),
resolved AS (SELECT men.*, entity_id FROM men LEFT JOIN best USING (name, kind))
"""
_SLUG = lambda c: f"trim(regexp_replace(lower(trim(coalesce({c}, ''))), '[^a-z0-9]+', '_', 'g'), '_')"
_PREFIX = "CASE {k} WHEN 'organizations' THEN 'org' WHEN 'offices' THEN 'office' WHEN 'roles' THEN 'role' ELSE 'entity' END"
_PLAIN = lambda c: f"trim(regexp_replace(regexp_replace(lower(trim(coalesce({c}, ''))), '[^\\p{{L}}\\p{{N}}\\p{{M}}_\\s]', '', 'g'), '[\\s\\p{{Z}}]+', ' ', 'g'))"

_W = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_STRIP = lambda c: f"regexp_replace({c}, '^{_W}+|{_W}+$', '', 'g')"
_M = "chr(57344) || chr(57345)"
_CHUNKS = f"""
WITH d AS (SELECT doc_id, text FROM documents WHERE length(text) > 0),
o AS (SELECT doc_id, text, string_split(regexp_replace(text, '(?im)^({_W}*SEC(?:TION)?\\.?{_W}+\\p{{Nd}}+[A-Z]?\\.)', {_M} || '\\1', 'g'), {_M}) AS os FROM d WHERE length(text) > 6000),
p AS (SELECT doc_id, CASE WHEN len(os) > 1 THEN {_STRIP('x')} ELSE x END AS part, i, len(os) > 1 AS many FROM (SELECT doc_id, os, unnest(os) AS x, generate_subscripts(os, 1) AS i FROM o)),
s AS (SELECT *, list_filter(string_split(regexp_replace(part, '(?m)^({_W}*\\([a-z]\\))', {_M} || '\\1', 'g'), {_M}), lambda x: x <> '') AS subs FROM p WHERE part <> ''),
f AS (SELECT doc_id, i, CASE
  WHEN length(part) <= 6000 AND many THEN [part]
  WHEN len(subs) < 2 THEN list_transform(range(0, CAST(floor((length(part) - 1) / 6000) AS BIGINT) + 1), lambda k: {_STRIP('part[k * 6000 + 1 : k * 6000 + 6000]')})
  ELSE list_transform(string_split(list_reduce(list_concat([''], subs), lambda st, x: CASE WHEN length(string_split(st, {_M})[-1]) + length(x) > 6000 AND string_split(st, {_M})[-1] <> '' THEN st || {_M} || x ELSE st || x END), {_M}), lambda x: {_STRIP('x')}) END AS cs FROM s),
c AS (SELECT doc_id, list_filter(flatten(list(cs ORDER BY i)), lambda x: x <> '') AS cs FROM f GROUP BY doc_id
  UNION ALL SELECT doc_id, [text] FROM d WHERE length(text) <= 6000)
SELECT doc_id, CAST(generate_subscripts(cs, 1) - 1 AS INTEGER) AS chunk, length(unnest(cs)) AS n_chars, md5(unnest(cs)) AS digest FROM c"""

SQL = {
    "split_explode_tags": f"SELECT ord, unnest({_LIST}) AS tag, CAST(generate_subscripts({_LIST}, 1) - 1 AS INTEGER) AS pos FROM segments_raw",
    "tag_totals": _TAGS + "SELECT tag, count(*) AS n_segments, count(DISTINCT doc) AS n_docs FROM tags GROUP BY tag",
    "group_totals": _TAGS + "SELECT trim(split_part(tag, ':', 1)) AS grp, count(*) AS n, count(DISTINCT tag) AS n_tags FROM tags GROUP BY 1",
    "taxonomy_hierarchy": "WITH p AS (SELECT trim(name) AS name, string_split(trim(name), ': ') AS s FROM taxonomy WHERE trim(coalesce(name, '')) <> '') SELECT name, s[1] AS grp, CASE WHEN len(s) > 2 THEN array_to_string(s[1:len(s)-1], ': ') END AS parent, len(s) <= 2 AS is_top FROM p",
    "taxonomy_cooccurrence": _CO.replace("{a}", "strategies").replace("{b}", "harms") + "SELECT * FROM co",
    "harm_strategy_support": _CO.replace("{a}", "harms").replace("{b}", "strategies") + "SELECT * FROM co WHERE weight >= 4",
    "segments_per_doc": f"WITH n AS (SELECT {_NUMBER} AS doc, count(*) AS n FROM segments_raw GROUP BY 1) SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_segments, max(n) AS max_n, median(n) AS median_n FROM n WHERE doc IS NOT NULL",
    "coverage_ratios": "SELECT count(*) AS n, " + ", ".join(f"count(*) FILTER (trim(coalesce({c}, '')) <> '') AS with_{c}" for c in ["casual_name", "authority", "collections", "tags", "short_summary", "long_summary", "proposed_date"]) + " FROM documents_raw",
    "top_authorities": "SELECT trim(authority) AS authority, count(*) AS n FROM documents_raw WHERE trim(authority) <> '' GROUP BY 1 ORDER BY n DESC, authority LIMIT 15",
    "tfidf_totals": "WITH w AS (SELECT ord, unnest(regexp_extract_all(lower(concat_ws(' ', short_summary, long_summary, tags)), '([a-z0-9]+)', 1)) AS token FROM documents_raw) SELECT token, count(DISTINCT ord) AS df, count(*) AS tf FROM w GROUP BY token",
    "tfidf_weights": "WITH w AS (SELECT ord, unnest(regexp_extract_all(lower(concat_ws(' ', short_summary, long_summary, tags)), '([a-z0-9]+)', 1)) AS token FROM documents_raw), tf AS (SELECT ord, token, count(*) AS tf FROM w GROUP BY ALL), df AS (SELECT token, count(*) AS df FROM tf GROUP BY token) SELECT ord, token, round(tf * ln(((SELECT count(*) FROM documents_raw) + 1) / CAST(df + 1 AS DOUBLE)), 6) AS weight FROM tf JOIN df USING (token)",
    "tag_jaccard_edges": _TAGS + ", z AS (SELECT doc, count(*) AS n FROM dt GROUP BY doc), b AS (SELECT x.doc AS src, y.doc AS dst, count(*) AS both_ FROM dt x JOIN dt y ON x.tag = y.tag AND x.doc <> y.doc WHERE x.doc % 50 = 0 GROUP BY ALL) SELECT src, dst, CAST(both_ AS DOUBLE) / (za.n + zb.n - both_) AS similarity FROM b JOIN z za ON src = za.doc JOIN z zb ON dst = zb.doc WHERE CAST(both_ AS DOUBLE) / (za.n + zb.n - both_) > 0.25",
    "dense_cosine_edges": "SELECT q.vec_id AS query, v.vec_id, round(list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS cosine FROM embeddings v JOIN embeddings q ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id",
    "entity_coverage": _MENTIONS + "SELECT kind, count(DISTINCT lower(trim(name))) AS n_names, count(*) AS n_mentions, count(DISTINCT doc) AS n_docs FROM men GROUP BY kind",
    "token_usage": "SELECT CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens, CAST(sum(chunks_processed) AS BIGINT) AS chunks FROM entity_record",
    "registry_terms": _MENTIONS + "SELECT term, entity_id, entity_type FROM terms",
    "registry_stats": "SELECT entity_type, count(*) AS n, count(*) FILTER (trim(coalesce(acronym, '')) <> '') AS n_acronyms, CAST(sum(len(coalesce(aliases, []))) AS BIGINT) AS n_aliases FROM registry GROUP BY entity_type",
    "canonical_term_map": _MENTIONS + "SELECT term, arg_max(entity_id, ord) AS entity_id FROM terms GROUP BY term",
    "resolve_terms": _MENTIONS + "SELECT kind, entity_id, count(*) AS n FROM resolved GROUP BY ALL",
    "dictionary_entries": _MENTIONS + f"SELECT {_PREFIX.replace('{k}', 'kind')} || ':' || {_SLUG('name')} AS entity_id, arg_min(name, (record_id, pos)) AS canonical_name, any_value(kind) AS entity_type, count(*) AS mention_count, count(DISTINCT doc) AS n_seen_in FROM men GROUP BY 1",
    "bare_alias_queue": _MENTIONS + f"SELECT kind, name, entity_id, count(*) AS n, count(DISTINCT doc) AS n_docs FROM resolved WHERE lower(trim(name)) IN ({', '.join(repr(g) for g in GENERIC)}) GROUP BY ALL",
    "chunk_text": _CHUNKS,
    "tag_signature": _TAGS + ", m AS (SELECT DISTINCT ((doc % 50) + 50) % 50 AS grp, doc AS member, tag FROM tags WHERE doc IS NOT NULL), z AS (SELECT grp, count(DISTINCT member) AS size FROM m GROUP BY grp), n AS (SELECT grp, tag, count(DISTINCT member) AS n FROM m GROUP BY ALL), r AS (SELECT n.*, size, row_number() OVER (PARTITION BY grp ORDER BY n DESC, tag) AS k FROM n JOIN z USING (grp)) SELECT grp, any_value(size) AS size, string_agg(tag, ' | ' ORDER BY k) FILTER (k <= 3) AS label, coalesce(string_agg(tag, '|' ORDER BY k) FILTER (n >= 0.4 * size), '') AS signature FROM r GROUP BY grp",
    "confidence_scores": _MENTIONS
    + """, e AS (SELECT r.*, lower(trim(g.canonical_name)) AS full_, trim(coalesce(g.acronym, '')) <> '' AS has FROM resolved r LEFT JOIN registry g USING (entity_id)),
k AS (SELECT DISTINCT entity_type AS kind, lower(trim(coalesce(name, title))) AS k FROM manual_annotations WHERE trim(coalesce(name, title, '')) <> ''),
c AS (SELECT record_id, kind, CAST(pos AS INTEGER) AS pos, name, entity_id, length(trim(name)) < 8 AS brief,
 round(greatest(0.0, least(1.0, 0.5 + CASE WHEN entity_id IS NOT NULL THEN 0.3 ELSE 0 END
 + CASE WHEN EXISTS (SELECT 1 FROM k WHERE k.kind = e.kind AND k.k IN (lower(trim(e.name)), e.full_)) THEN 0.1 ELSE 0 END
 + CASE WHEN has THEN 0.1 ELSE 0 END - CASE WHEN length(trim(name)) < 8 THEN 0.2 ELSE 0 END)), 3)::DOUBLE AS confidence FROM e)
SELECT record_id, kind, pos, name, entity_id, confidence, CASE WHEN confidence < 0.5 THEN concat_ws(', ', CASE WHEN brief THEN 'short_name' END, CASE WHEN entity_id IS NULL THEN 'not_in_registry' END) END AS reason FROM c""",
    "memory_first_wins": "WITH d AS (SELECT record_id, unnest(map_entries(disambiguation_updates)) AS e FROM entity_record), c AS (SELECT record_id, lower(trim(e.key)) AS phrase, e.value AS meaning FROM d WHERE NOT contains(e.key, '_in_sec_')) SELECT phrase, arg_min(meaning, (record_id, meaning)) AS meaning, count(*) AS n_given, count(DISTINCT meaning) AS n_meanings FROM c GROUP BY phrase",
    "graduation_candidates": "WITH d AS (SELECT unnest(map_entries(disambiguation_updates)) AS e FROM entity_record) SELECT lower(trim(e.key)) AS phrase, trim(e.value) AS meaning, count(*) AS n, CAST(least(0.95, 0.6 + 0.05 * count(*)) AS DOUBLE) AS confidence FROM d GROUP BY 1, 2 HAVING count(*) >= 2",
    "truth_dialects": "SELECT ord, lower(trim(coalesce(non_operative, ''))) IN ('1', 'true', 'yes', 'y', 'x') AS graph, trim(coalesce(non_operative, '')) = 'True' AS exact, lower(trim(coalesce(non_operative, ''))) IN ('true', '1', 'yes') AS government, lower(trim(coalesce(non_operative, ''))) = 'true' AS sync, CASE WHEN lower(trim(coalesce(non_operative, ''))) = 'true' THEN true END AS optional, trim(coalesce(non_operative, '')) NOT IN ('', '0', 'FALSE', 'False', 'No') AS demo FROM segments_raw",
    "slug_dialects": f"SELECT ord, coalesce(nullif(trim(regexp_replace(lower(canonical_name), '[^\\p{{L}}\\p{{N}}_.-]', '_', 'g'), '_'), ''), 'unknown') AS safe, {_PREFIX.replace('{k}', 'entity_type')} || ':' || {_SLUG('canonical_name')} AS entity, {_PREFIX.replace('{k}', 'entity_type')} || ':' || {_SLUG('canonical_name')} AS sync, coalesce(nullif(substr({_SLUG('canonical_name')}, 1, 80), ''), 'unknown') AS layer, trim(regexp_replace(regexp_replace(lower(trim(canonical_name)), '[^a-z0-9\\s_-]', '', 'g'), '[\\s_-]+', '_', 'g'), '_') AS dropping FROM registry",
    "upsert_merge": "SELECT ord, CASE WHEN ord % 3 = 0 THEN upper(official_name) WHEN ord % 5 = 0 THEN lower(official_name) ELSE official_name END AS official_name FROM documents_raw",
    "json_props_parse": "SELECT event_type, count(*) AS n, count(json_extract(props, '$.k')) AS n_k, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS sum_k FROM events GROUP BY event_type",
    "resume_antijoin": "SELECT doc_id FROM documents WHERE CAST(doc_id AS VARCHAR) NOT IN (SELECT trim(doc_id) FROM entity_record WHERE doc_id IS NOT NULL)",
    "catalogue_search": "SELECT ord, official_name FROM documents_raw WHERE contains(lower(concat_ws(' ', doc_id, official_name, casual_name)), 'audit')",
}
