"""Further core queries, over entities, specifications and retrieval, each with its SQL where SQL can state it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellon.catalog import _ASK, _HALF, _HYB, _IDX, _LATEST, _SPEC, _SQL, _WIDE, _cos, _norm, _orgs, asked, asked_terms, asked_vectors, chunks, query, spec_rows
from tessellon.functions import text as X
from tessellon.operators import agent, diagnostics, entities, generation, knowledge, queries as Q, retrieval, specs
from tessellon.plans.lineage import keep
from tessellon.sources.tables import table
from tessellon.streaming import ingest

# --- entities ---------------------------------------------------------------

_SORTED = "coalesce((SELECT list(DISTINCT x ORDER BY x) FROM (SELECT unnest(flatten(list({0}))) AS x) WHERE x IS NOT NULL), [])"


@query("WITH e AS (SELECT entity_name, entity_type, frequency, source_docs FROM entity_raw), t AS (SELECT entity_name, entity_type, sum(frequency)::BIGINT AS frequency FROM e GROUP BY ALL), s AS (SELECT entity_name, entity_type, list(DISTINCT x ORDER BY x) AS docs FROM (SELECT entity_name, entity_type, unnest(source_docs) AS x FROM e) WHERE x IS NOT NULL GROUP BY ALL) SELECT t.*, coalesce(s.docs, []) AS docs FROM t LEFT JOIN s ON t.entity_name IS NOT DISTINCT FROM s.entity_name AND t.entity_type IS NOT DISTINCT FROM s.entity_type")
def entity_increments(spark, folder):
    """Entities of two deliveries, the later added to the merged earlier one."""
    rows = table(spark, folder, "entity_raw")
    first = ingest.merged_entities(None, rows.where("entity_id % 2 = 0"))
    return ingest.merged_entities(first, rows.where("entity_id % 2 <> 0 or entity_id is null")).select("entity_name", "entity_type", "frequency", F.col("source_docs").alias("docs"))


@query("SELECT entity_name, list(x ORDER BY x) AS source_chunks FROM (SELECT entity_name, unnest(source_chunks) AS x FROM entity_raw WHERE entity_type = 'ORG') WHERE x IS NOT NULL GROUP BY 1")
def org_chunks(spark, folder):
    """All chunks of each organisation's name, repeated ones kept."""
    return entities.name_chunks(table(spark, folder, "entity_raw"), "ORG").select("entity_name", F.filter("source_chunks", lambda x: x.isNotNull()).alias("source_chunks")).where("size(source_chunks) > 0")


_ORG = "e AS (SELECT DISTINCT unnest(source_chunks) AS chunk_id, entity_name FROM entity_raw WHERE entity_type = 'ORG' AND entity_name IS NOT NULL)"


@query(f"WITH {_ORG}, c AS (SELECT * FROM e WHERE chunk_id IS NOT NULL), p AS (SELECT entity_name AS p FROM c GROUP BY 1 ORDER BY count(*) DESC, entity_name LIMIT 1), h AS (SELECT chunk_id FROM c, p WHERE entity_name = p) SELECT chunk_id, list(entity_name ORDER BY entity_name) AS others FROM c, p WHERE chunk_id IN (SELECT chunk_id FROM h) AND entity_name <> p GROUP BY 1")
def partners_of_primary(spark, folder):
    """The other organisations of the chunks that name the one of most chunks."""
    rows = table(spark, folder, "entity_raw")
    first = rows.where("entity_type = 'ORG' and entity_name is not null").select("entity_name", F.explode("source_chunks").alias("c")).where("c is not null").distinct().groupBy("entity_name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "entity_name").first()
    first = first["entity_name"] if first else ""
    return entities.partners(entities.cooccurrence(rows, first), first)


@query(f"WITH {_ORG}, c AS (SELECT * FROM e WHERE chunk_id IS NOT NULL) SELECT a.entity_name AS a, b.entity_name AS b, count(*) AS n_chunks FROM c a JOIN c b USING (chunk_id) WHERE a.entity_name < b.entity_name GROUP BY ALL")
def cooccurring_orgs(spark, folder):
    """Pairs of organisations by the chunks that name both."""
    return entities.cooccurring_pairs(table(spark, folder, "entity_raw"))


@query(f"WITH {_IDX}, m AS (SELECT DISTINCT entity_name AS model FROM entity_raw WHERE entity_type = 'MODEL' AND entity_name IS NOT NULL), e AS (SELECT DISTINCT lower(entity_name) AS k, unnest(source_chunks) AS chunk_id FROM entity_raw WHERE entity_name IS NOT NULL), r AS (SELECT DISTINCT model, idx.chunk_id, content FROM m JOIN e ON lower(model) = k JOIN idx USING (chunk_id)), w AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY chunk_id) AS r FROM r) SELECT model, left(coalesce(string_agg(content, chr(10) || chr(10) ORDER BY r), ''), 3000) AS context FROM w WHERE r <= 5 GROUP BY 1")
def model_contexts(spark, folder):
    """The chunks from which a model's parameters would be filled."""
    rows = table(spark, folder, "entity_raw")
    models = rows.where("entity_type = 'MODEL' and entity_name is not null").select(F.col("entity_name").alias("model")).distinct()
    return entities.model_chunks(models, rows, chunks(spark, folder))


_COOP = f"""{_IDX}, {_ORG}, o AS (SELECT chunk_id, list(entity_name ORDER BY entity_name) AS units FROM e WHERE chunk_id IS NOT NULL GROUP BY 1 HAVING count(*) >= 2),
cr AS (SELECT units, chunk_id, CASE WHEN length(coalesce(content, '')) > 100 THEN left(content, 100) || '...' ELSE coalesce(content, '') END AS content FROM o JOIN idx USING (chunk_id)),
coop AS (SELECT units, list_reduce(list(content ORDER BY chunk_id, content), lambda t, x: CASE WHEN t = '' THEN x WHEN x = t OR x = '' THEN t ELSE t || '；' || x END) AS content, list(chunk_id ORDER BY chunk_id, content) AS source_chunks FROM cr GROUP BY 1)"""


def cooperations(spark, folder) -> DataFrame:
    """(units, content, products, source_chunks, confidence): chunks of several organisations merged by these."""
    rows = entities.cooccurrence(table(spark, folder, "entity_raw"))
    text = chunks(spark, folder).select("chunk_id", F.coalesce("content", F.lit("")).alias("content"))
    made = rows.join(text, "chunk_id").select(F.col("orgs").alias("units"), X.snippet("content", 100).alias("content"), F.array("chunk_id").alias("products_or_projects"), F.col("chunk_id").alias("source_chunk"), F.lit(0.5).alias("confidence"), F.col("chunk_id").alias("position"))
    return entities.merge_cooperation(made)


_SQL["cooperation_merge"] = f"WITH {_COOP} SELECT units, content, list_sort(source_chunks) AS products, source_chunks, 0.5::DOUBLE AS confidence FROM coop"


@query("WITH r AS (SELECT l_orderkey AS o, list(DISTINCT l_suppkey::VARCHAR) AS units, min(l_shipdate)::VARCHAR AS content FROM lineitem GROUP BY 1), k AS (SELECT list_sort(units) AS units, o FROM r) SELECT units, list(o ORDER BY o) AS source_chunks, round(max((o % 10) / 10.0), 6) AS confidence FROM k GROUP BY 1")
def cooperation_units(spark, folder):
    """Orders as cooperations of their suppliers, those of the same set merged whatever the order of its members."""
    rows = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.col("l_suppkey").cast("string")).alias("units"))
    none = F.array().cast("array<string>")
    made = rows.select(F.reverse("units").alias("units"), F.lit("").alias("content"), none.alias("products_or_projects"), F.col("l_orderkey").alias("source_chunk"), F.round(F.col("l_orderkey") % 10 / 10.0, 6).alias("confidence"), F.col("l_orderkey").alias("position"))
    return entities.merge_cooperation(made).select("units", "source_chunks", "confidence")


_ORG_LINKS = _SQL["org_links"]
_GROUPED = f"l AS ({_ORG_LINKS}), f AS (SELECT entity_name AS name, sum(frequency) AS frequency FROM entity_raw WHERE entity_type = 'ORG' AND entity_name IS NOT NULL GROUP BY 1), b AS (SELECT a AS x, b AS y FROM l UNION SELECT b, a FROM l), r(n, g) AS (SELECT name, name FROM f UNION SELECT r.n, b.y FROM r JOIN b ON r.g = b.x), c AS (SELECT n AS name, min(g) AS root FROM r GROUP BY 1), best AS (SELECT root, arg_max(name, (frequency, name)) AS representative FROM c JOIN f USING (name) GROUP BY 1), grp AS (SELECT name, representative FROM c JOIN best USING (root))"
_SQL["org_alias_union"] = f"WITH RECURSIVE {_GROUPED} SELECT name, representative FROM grp"
_NODE = "'org_' || left(regexp_replace({0}, '[^a-zA-Z0-9\\x{{4e00}}-\\x{{9fff}}]', '', 'g'), 8) || '_' || left(md5({0}), 6)"


@query(f"WITH RECURSIVE {_COOP}, {_GROUPED}, flat AS (SELECT row_number() OVER () AS id, units, source_chunks FROM coop), mine AS (SELECT id, unnest(units) AS name, units, source_chunks FROM flat), j AS (SELECT * FROM mine JOIN grp USING (name)), prod AS (SELECT representative, list(DISTINCT p ORDER BY p) AS products FROM (SELECT representative, unnest(source_chunks) AS p FROM j) GROUP BY 1), oth AS (SELECT DISTINCT j.representative, coalesce(g.representative, o) AS other FROM (SELECT representative, name, unnest(units) AS o FROM j) j LEFT JOIN grp g ON g.name = o WHERE o <> j.name), co AS (SELECT representative, list(other ORDER BY other) AS cooperators FROM oth WHERE other <> representative GROUP BY 1) SELECT {_NODE.format('g.representative')} AS id, g.representative AS name, list(g.name ORDER BY g.name) AS names, any_value(products) AS products, any_value(cooperators) AS cooperators FROM grp g LEFT JOIN prod USING (representative) LEFT JOIN co USING (representative) GROUP BY g.representative")
def organisation_nodes(spark, folder):
    """A node for each group of organisations' names with what they cooperate on and with whom."""
    return entities.org_nodes(keep(entities.org_groups(_orgs(spark, folder))), cooperations(spark, folder))


@query(f"WITH RECURSIVE {_COOP}, {_GROUPED} SELECT {_NODE.format('coalesce(g.representative, units[1])')} AS source, {_NODE.format('coalesce(h.representative, units[2])')} AS target, content FROM coop LEFT JOIN grp g ON g.name = units[1] LEFT JOIN grp h ON h.name = units[2]")
def organisation_edges(spark, folder):
    """Edges between the first two organisations of each cooperation."""
    return entities.cooperation_edges(cooperations(spark, folder), keep(entities.org_groups(_orgs(spark, folder))))


@query("WITH m AS (SELECT p_name || '#' || p_partkey AS model, lower(p_brand) AS p FROM part), n AS (SELECT DISTINCT p_brand || ' Works' AS name, upper(p_brand) AS representative, lower(regexp_replace(p_brand || ' Works', '\\s+', '', 'g')) AS k FROM part WHERE p_brand > 'Brand#2'), h AS (SELECT model, name, representative FROM m JOIN n ON contains(k, regexp_replace(p, '\\s+', '', 'g')) OR contains(regexp_replace(p, '\\s+', '', 'g'), k)) SELECT model, arg_min(representative, (name, representative)) AS representative FROM h GROUP BY 1")
def model_owners(spark, folder):
    """The organisation that each model belongs to."""
    p = table(spark, folder, "part")
    models = p.select(F.concat_ws("#", "p_name", F.col("p_partkey").cast("string")).alias("model"), F.lower("p_brand").alias("partner"))
    groups = p.where("p_brand > 'Brand#2'").select(F.concat("p_brand", F.lit(" Works")).alias("name"), F.upper("p_brand").alias("representative")).distinct()
    return entities.owned_by(models, groups)


@query("SELECT 'node' AS part, p_type AS kind, count(*) AS n FROM part GROUP BY ALL UNION ALL SELECT 'edge', l_returnflag, count(*) FROM lineitem GROUP BY ALL")
def graph_sizes(spark, folder):
    """Nodes and edges of each kind."""
    return entities.graph_counts(table(spark, folder, "part").select(F.col("p_type").alias("kind")), table(spark, folder, "lineitem").select(F.col("l_returnflag").alias("kind")))


@query("SELECT p_partkey, standard, entity_type, count(*) AS n FROM (SELECT p_partkey, unnest(regexp_extract_all('the A' || p_size || ' and B' || p_size || '/C7, not DNA', '\\b([A-Z][0-9]{1,2}(?:\\s*[/-]\\s*[A-Z][0-9]{1,2})*)\\b')) AS standard, 'PRODUCT' AS entity_type FROM part UNION ALL SELECT p_partkey, unnest(regexp_extract_all('北方星座' || CASE WHEN p_size % 2 = 0 THEN '三号' ELSE '' END, '[\\x{4e00}-\\x{9fff}]{2,8}星座[一二三四五六七八九十]*号?')), 'PROJECT' FROM part) GROUP BY ALL")
def pattern_mentions(spark, folder):
    """Models and projects found by their patterns."""
    size = F.col("p_size").cast("string")
    text = F.concat(F.lit("the A"), size, F.lit(" and B"), size, F.lit("/C7, not DNA 北方星座"), F.when(F.col("p_size") % 2 == 0, "三号").otherwise(""))
    return entities.pattern_hits(table(spark, folder, "part").select("p_partkey", text.alias("content")), "p_partkey")


@query("SELECT DISTINCT entity_name, CASE WHEN contains(entity_name, '大学') OR contains(entity_name, 'University') THEN 'SCHOOL' WHEN contains(entity_name, '集团') OR contains(entity_name, 'Group') THEN 'GROUP' ELSE 'TECH' END AS kind FROM entity_raw WHERE entity_name IS NOT NULL")
def name_types(spark, folder):
    """The type that words of a name tell."""
    rows = table(spark, folder, "entity_raw").where("entity_name is not null")
    return rows.select("entity_name", entities.domain_type("entity_name", {"SCHOOL": ["大学", "University"], "GROUP": ["集团", "Group"]}).alias("kind")).distinct()


@query(f"WITH {_IDX}, v AS (SELECT chunk_id, doc_id, embedding_vector AS v FROM idx WHERE doc_id IS NOT NULL AND embedding_vector IS NOT NULL AND {_norm('embedding_vector')} > 0) SELECT a, b, similarity FROM (SELECT x.chunk_id AS a, y.chunk_id AS b, {_cos('x.v', 'y.v')} AS similarity FROM v x JOIN v y ON x.doc_id = y.doc_id AND x.chunk_id < y.chunk_id AND len(x.v) = len(y.v)) WHERE similarity >= 0.85")
def alias_pairs_near(spark, folder):
    """Chunks of one document that are close."""
    rows = chunks(spark, folder).where("doc_id is not null").select(F.col("chunk_id").alias("id"), F.col("embedding_vector").alias("vec"), "doc_id")
    return entities.alias_pairs(rows, "doc_id")


@query(f"WITH {_IDX}, v AS (SELECT chunk_id, chunk_type, embedding_vector AS v FROM idx WHERE embedding_vector IS NOT NULL AND len(embedding_vector) = 64 AND {_norm('embedding_vector')} > 0), s AS (SELECT v FROM v WHERE chunk_type = 'parent') SELECT chunk_id FROM v f WHERE chunk_type <> 'parent' AND NOT EXISTS (SELECT 1 FROM s WHERE list_cosine_similarity(f.v::DOUBLE[], s.v::DOUBLE[]) > 0.92)")
def semantic_new_chunks(spark, folder):
    """Children and summaries that are not close to a parent."""
    rows = chunks(spark, folder).where("size(embedding_vector) = 64").where(F.exists("embedding_vector", lambda x: x != 0)).select("chunk_id", "chunk_type", F.col("embedding_vector").alias("vec"))
    return retrieval.semantic_new(rows.where("chunk_type = 'parent'"), rows.where("chunk_type <> 'parent'")).select("chunk_id")


# --- specifications ---------------------------------------------------------


@query(f"WITH {_SPEC}, q AS (SELECT 1 AS query_id, lower(min(p_type)) AS name FROM part), m AS (SELECT query_id, 0 AS level, category, series, model FROM spec JOIN q ON lower(category) = name) SELECT query_id, level, category, series, model FROM m QUALIFY row_number() OVER (PARTITION BY query_id, model ORDER BY level, category, series) = 1")
def spec_alias(spark, folder):
    """Models by an alias of a category."""
    p = table(spark, folder, "part")
    names = spark.createDataFrame([(1, "Nickname")], "query_id int, name string")
    return specs.resolve(spec_rows(spark, folder), names, p.agg(F.min("p_type").alias("name")).select(F.lit("nickname").alias("alias"), "name")).drop("params")


@query("SELECT p_partkey, (p_size / 10.0)::DOUBLE AS weight, (p_size * 3)::DOUBLE AS power, p_size::DOUBLE AS compute FROM part")
def spec_measures(spark, folder):
    """Weight, power and compute read from parameters' texts."""
    size = F.col("p_size")
    params = F.create_map(F.lit("重量"), F.concat((size / 10.0).cast("string"), F.lit(" kg")), F.lit("功耗"), F.concat((size * 3).cast("string"), F.lit("W")), F.lit("算力"), F.concat(size.cast("string"), F.lit("Tops")))
    return specs.measures(table(spark, folder, "part").select("p_partkey", params.alias("params"))).select("p_partkey", "weight", "power", "compute")


@query(f"WITH {_SPEC} SELECT category, model, ['功耗=' || power, '颜色=', '备注=' || note, '尺寸=' || size] AS shown FROM spec")
def spec_required(spark, folder):
    """Parameters with the required ones first."""
    got = specs.required_first(spec_rows(spark, folder), ["功耗", "颜色"])
    return got.select("category", "model", F.transform("shown", lambda s: F.concat(s["name"], F.lit("="), s["value"])).alias("shown"))


@query(f"WITH {_SPEC}, n AS (SELECT *, row_number() OVER (PARTITION BY category, series ORDER BY model) AS n FROM spec), t AS (SELECT category, series, string_agg(n || '. ' || model || ': ' || concat_ws('; ', '功耗 ' || power, CASE WHEN note <> '' THEN '备注 ' || note END, '尺寸 ' || size), chr(10) ORDER BY n) AS lines FROM n GROUP BY ALL) SELECT category, '## ' || category || chr(10) || string_agg('### ' || series || chr(10) || lines, chr(10) ORDER BY series) AS text FROM t GROUP BY 1")
def spec_text(spark, folder):
    """Specifications as text: numbered models by series, key parameters first."""
    return specs.formatted(spec_rows(spark, folder), ["功耗"])


@query("WITH s AS (SELECT p_type AS kind, p_brand AS name, count(*) AS n FROM part WHERE p_brand IN ('Brand#11', 'Brand#12', 'Brand#13') GROUP BY ALL) SELECT kind, name, n FROM s")
def partner_counts(spark, folder):
    """Counts of two-level specifications for some names, given as lists and as maps."""
    p = table(spark, folder, "part").groupBy("p_type", "p_brand").agg(F.count("*").alias("n"))
    listed = p.groupBy(F.col("p_type").alias("category")).agg(F.collect_list(F.struct(F.col("p_brand").alias("name"), F.col("n").alias("count"))).alias("entries"))
    return specs.counted_names(specs.entries_of(listed.where("category < 'M'")).unionByName(specs.entries_of(listed.where("category >= 'M'").select("category", F.map_from_arrays("entries.name", "entries.count").alias("entries")))), ["Brand#11", "Brand#12", "Brand#13"]).select("kind", "name", "n")


# --- questions and answers --------------------------------------------------

def _keywords_sql(source: str) -> str:
    """CTEs ending in kw (query_id, position, term, weight) of source (query_id, query)."""
    from tessellon.catalog_documents import _quoted, _without_question

    spaced = "regexp_replace(regexp_replace(query, '([\\x{4e00}-\\x{9fa5}])([A-Za-z0-9])', '\\1 \\2', 'g'), '([A-Za-z0-9])([\\x{4e00}-\\x{9fa5}])', '\\1 \\2', 'g')"
    low = f"lower(translate({spaced}, '{_WIDE}', '{_HALF}'))"
    # punctuation but hyphens and underscores, which stand aside meanwhile
    marks = "translate(q1, '-_', chr(1) || chr(2))"
    gone = f"translate(regexp_replace({marks}, '[\\p{{P}}\\p{{S}}&&[:punct:]]+|\\p{{P}}+', ' ', 'g'), chr(1) || chr(2), '-_')".replace("[\\p{P}\\p{S}&&[:punct:]]+|", "[!-/:-@\\[-`{-~]+|")
    kept = f"CASE WHEN term IN ({_quoted(Q.STOP_WORDS)}) THEN false WHEN regexp_matches(term, '(?i)^[A-Z]{{1,3}}\\d{{1,4}}[A-Z]?$') THEN true WHEN term IN ({_quoted(Q.SERIES)}) THEN true WHEN regexp_matches(term, '^[\\x{{4e00}}-\\x{{9fff}}]$|^[a-z]$|^\\d{{1,2}}$') THEN false ELSE term <> '' END"
    return f"""k0 AS (SELECT query_id, {low} AS q0 FROM {source}), k1 AS (SELECT query_id, {_without_question('q0')} AS q1 FROM k0), k2 AS (SELECT query_id, unnest(range(0, len(w))) AS i, unnest(w) AS term FROM (SELECT query_id, string_split_regex({gone}, '\\s+') AS w FROM k1)),
k3 AS (SELECT query_id, term, row_number() OVER (PARTITION BY query_id ORDER BY i) - 1 AS position FROM k2 WHERE {kept}), k4 AS (SELECT query_id, term, min(position)::INT AS position FROM k3 GROUP BY ALL), hi AS (SELECT lower(alias) AS h FROM terms_seed UNION SELECT lower(standard) FROM terms_seed),
kw AS (SELECT query_id, position, term, CASE WHEN term IN (SELECT h FROM hi WHERE h IS NOT NULL) THEN 3.0 WHEN regexp_matches(term, '^[\\x{{4e00}}-\\x{{9fff}}]{{2,}}$') THEN 1.5 ELSE 0.5 END::DOUBLE AS weight FROM k4)"""


_SQL["keyword_weights"] = f"WITH s AS (SELECT item_id AS query_id, text AS query FROM eval_items), {_keywords_sql('s')} SELECT query_id, position, term, weight FROM kw"
_SQL["rerank_queries"] = f"WITH {_ASK}, {_keywords_sql('ask')}, said AS (SELECT query_id, string_agg(CASE WHEN weight >= 3 THEN term || ' ' || term || ' ' || term WHEN weight >= 1.5 THEN term || ' ' || term ELSE term END, ' ' ORDER BY position) AS t FROM kw GROUP BY 1) SELECT query_id, query, CASE WHEN t IS NULL THEN query ELSE query || ' 关键词: ' || t END AS rerank_query FROM ask LEFT JOIN said USING (query_id)"
_SQL["query_clauses"] = f"""WITH {_ASK}, {_keywords_sql('ask')}, al AS (SELECT lower(alias) AS term, min(standard) AS standard FROM terms_seed GROUP BY 1),
n0 AS (SELECT query_id, position, coalesce(standard, term) AS term, weight FROM kw LEFT JOIN al USING (term)), n1 AS (SELECT * FROM n0 QUALIFY row_number() OVER (PARTITION BY query_id, term ORDER BY position) = 1), nk AS (SELECT query_id, position, term, round(weight / sum(weight) OVER (PARTITION BY query_id), 9) AS weight FROM n1),
cnt AS (SELECT query_id, count(*) AS n FROM nk GROUP BY 1), pr AS (SELECT DISTINCT lower(alias) AS x, lower(standard) AS y FROM terms_seed), sy AS (SELECT DISTINCT x, y FROM (SELECT x, y FROM pr UNION ALL SELECT y, x FROM pr UNION ALL SELECT a.x, b.x FROM pr a JOIN pr b ON a.y = b.y) WHERE x <> y),
ex AS (SELECT query_id, y AS term, weight * 0.2 AS weight FROM nk JOIN sy ON sy.x = nk.term),
nx AS (SELECT query_id, term, weight, lead(term) OVER w AS t2, lead(weight) OVER w AS w2 FROM nk WINDOW w AS (PARTITION BY query_id ORDER BY position)),
u AS (SELECT query_id, 'term' AS layer, term, weight * CASE WHEN n > 1 THEN 5.0 ELSE 1.0 END AS boost FROM nk JOIN cnt USING (query_id)
UNION ALL SELECT query_id, 'phrase', term || ' ' || t2, 2 * greatest(weight, w2) * CASE WHEN n > 1 THEN 5.0 ELSE 1.0 END FROM nx JOIN cnt USING (query_id) WHERE t2 IS NOT NULL
UNION ALL SELECT query_id, 'synonym', term, weight * CASE WHEN n > 1 THEN 5.0 ELSE 1.0 END FROM ex JOIN cnt USING (query_id)
UNION ALL SELECT query_id, 'synonym_phrase', term, 0.7 FROM ex JOIN cnt USING (query_id) WHERE n > 1
UNION ALL SELECT query_id, 'raw', regexp_replace(query, '([+\\-&|!(){{}}\\[\\]^"~*?:\\\\/])', '\\\\\\1', 'g'), 1.0 FROM ask)
SELECT query_id, layer, term, round(boost, 6)::DOUBLE AS boost FROM u"""


@query("SELECT item_id AS query_id, count(*) AS n_new FROM (SELECT DISTINCT item_id, unnest(string_split(text, ' ')) AS w FROM eval_items) GROUP BY 1")
def token_usage(spark, folder):
    """What queries used in all, added up over their steps."""
    steps = table(spark, folder, "eval_items").select(F.col("item_id").alias("query_id"), F.explode(F.split("text", " ")).alias("w")).distinct().withColumn("tokens", F.lit(1))
    return diagnostics.usage(steps, "query_id", "tokens").select("query_id", F.col("tokens").alias("n_new"))


_KNN = f"{_IDX}, kn AS (SELECT q.vec_id AS query_id, e.chunk_id, e.content, round((1 + c) / 2, 6) AS score FROM (SELECT * FROM idx WHERE {_LATEST} AND len(embedding_vector) = 64 AND {_norm('embedding_vector')} > 0) e, (SELECT * FROM embeddings WHERE vec_id % 20 = 0) q, LATERAL (SELECT {_cos('e.embedding_vector', 'q.embedding')} AS c) WHERE c >= 0), h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) - 1 AS rank FROM kn QUALIFY rank < 20)"


def near_hits(spark, folder) -> DataFrame:
    """(query_id, chunk_id, content, score, rank): the twenty nearest searchable chunks of each twentieth embedding."""
    rows = keep(chunks(spark, folder).where(retrieval.searchable(retrieval.Options())).select("chunk_id", "content", F.col("embedding_vector").alias("vec")))
    hits = retrieval.top(retrieval.knn(asked_vectors(spark, folder), rows.where("size(vec) = 64").select("chunk_id", "vec"), k=20), 20)
    return hits.join(rows.select("chunk_id", "content"), "chunk_id")


@query(f"WITH {_KNN}, s AS (SELECT query_id, chunk_id, rank, round(1.0 - 0.01 * rank, 6)::DOUBLE AS score FROM h) SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) - 1 AS position FROM s WHERE score >= 0.9 QUALIFY position < 5")
def rerank_threshold(spark, folder):
    """Hits in their order, cut by score and number, when there is no reranker."""
    options = retrieval.Options(rerank_top_k=5, rerank_threshold=0.9)
    return retrieval.rerank(near_hits(spark, folder).withColumn("query", F.lit("")), None, options).select("query_id", "chunk_id", "score", "position")


@query(f"WITH {_KNN}, s AS (SELECT query_id, chunk_id, rank, (length(coalesce(content, '')) % 97) / 97.0 AS score FROM h) SELECT query_id, chunk_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) - 1 AS position FROM s QUALIFY position < 20")
def rerank_scores(spark, folder):
    """Hits in the order of a scorer."""
    scorer = lambda q, c: (c.fillna("").map(lambda t: len(t) % 97) / 97.0).astype(float)
    return retrieval.rerank(near_hits(spark, folder).withColumn("query", F.lit("")), scorer).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "position")


@query(f"WITH {_KNN}, s AS (SELECT query_id, chunk_id, rank, (length(coalesce(content, '')) % 97) / 97.0 AS score FROM h), o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) - 1 AS position FROM s) SELECT query_id, chunk_id, position, position < 10 AS expanded FROM o")
def rerank_split(spark, folder):
    """All gathered chunks reranked together: the first ten to expand, the rest as they are."""
    scorer = lambda q, c: (c.fillna("").map(lambda t: len(t) % 97) / 97.0).astype(float)
    return agent.global_rerank(near_hits(spark, folder).withColumn("query", F.lit("")), scorer).select("query_id", "chunk_id", "position", "expanded")


@query(f"WITH {_KNN}, c AS (SELECT *, '[' || (rank + 1) || '] ' || coalesce(content, '') AS part FROM h) SELECT query_id, left(string_agg(part, chr(10) || chr(10) ORDER BY rank), 16000) AS context FROM c GROUP BY 1")
def synthesis_context(spark, folder):
    """What an agent's last answer would be written from."""
    return agent.synthesis(near_hits(spark, folder).select("query_id", "content", F.col("rank").alias("position")))


@query(f"WITH {_KNN}, l AS (SELECT query_id, content, max_by(chunk_id, rank) AS chunk_id FROM h WHERE content IS NOT NULL GROUP BY ALL) SELECT query_id, content, chunk_id FROM l")
def reranked_texts(spark, folder):
    """The chunk that a reranked text goes back to: of equal texts the last."""
    return retrieval.by_content(near_hits(spark, folder).where("content is not null"))


@query(f"{_HYB.replace('SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, wr ASC NULLS LAST, kr ASC NULLS LAST, chunk_id) - 1 AS rank FROM f QUALIFY rank < 20', '')}, hh AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, wr ASC NULLS LAST, kr ASC NULLS LAST, chunk_id) - 1 AS rank FROM f QUALIFY rank < 20), c AS (SELECT query_id, chunk_id, hh.score, content AS t, len(regexp_extract_all(content, '[\\x{{4e00}}-\\x{{9fff}}]|[a-zA-Z]{{2,}}|[0-9]+')) AS w, regexp_replace(content, '<[^>]+>', '', 'g') AS p FROM hh JOIN idx USING (chunk_id)), r AS (SELECT *, (length(t) - length(p)) / greatest(length(t), 1) AS q FROM c), judged AS (SELECT *, CASE WHEN t IS NULL THEN true WHEN regexp_matches(t, '<[^>]+>') THEN (q > 0.5 AND length(trim(p, ' ' || chr(10) || chr(9) || chr(13))) < 20) OR regexp_matches(t, '(?i)</td>\\s*</tr>\\s*<tr>\\s*<td') OR (len(regexp_extract_all(t, '(?i)</td>')) >= 3 AND w < 15) OR (q > 0.15 AND w < 15) ELSE w < 3 END AS low FROM r) SELECT query_id, chunk_id, score FROM judged WHERE NOT low AND score >= 0.008")
def search_min_score(spark, folder):
    """Fused hits without contents of low quality and scores under a bound."""
    vecs = asked_vectors(spark, folder).join(F.broadcast(asked(spark, folder).select("query_id")), "query_id", "left_semi")
    return retrieval.search(asked_terms(spark, folder), vecs, keep(chunks(spark, folder)), retrieval.Options(min_score=0.008)).select("query_id", "chunk_id", "score")


_PHRASES = f"{_ASK}, tk AS (SELECT query_id, unnest(range(0, len(t))) AS i, unnest(t) AS x FROM (SELECT query_id, {{tok_q}} AS t FROM ask)), ph AS (SELECT DISTINCT a.query_id, a.x AS first, b.x AS second FROM tk a JOIN tk b ON a.query_id = b.query_id AND b.i = a.i + 1), dt AS (SELECT doc_id, unnest(range(0, len(t))) AS i, unnest(t) AS x FROM (SELECT doc_id, {{tok_d}} AS t FROM documents))"


def _phrases() -> str:
    from tessellon.catalog import _tok

    return _PHRASES.replace("{tok_q}", _tok("query")).replace("{tok_d}", _tok("text"))


@query(f"WITH {_phrases()} SELECT query_id, doc_id, count(*) AS n_phrases FROM (SELECT DISTINCT ph.query_id, ph.first, ph.second, a.doc_id FROM ph JOIN dt a ON a.x = ph.first JOIN dt b ON b.doc_id = a.doc_id AND b.x = ph.second AND b.i - a.i BETWEEN 1 AND 3) GROUP BY ALL")
def phrase_matches(spark, folder):
    """How many neighbouring pairs of a query's words stand in a document with at most two words between them."""
    toks = asked(spark, folder).select("query_id", X.tokens("query").alias("t"))
    pairs = toks.select("query_id", F.explode(F.arrays_zip(F.slice("t", F.lit(1), F.greatest(F.size("t") - 1, F.lit(0))).alias("a"), F.slice("t", 2, 1_000_000).alias("b"))).alias("p")).select("query_id", F.array("p.a", "p.b").alias("phrase")).distinct()
    found = retrieval.phrases(pairs, table(spark, folder, "documents"), "doc_id", "text", slop=2)
    return found.groupBy("query_id", "doc_id").agg(F.count("*").alias("n_phrases"))


@query("SELECT item_id AS query_id, CASE WHEN set_name = 'heldout_facts' THEN '问题：' || text || chr(10) || chr(10) || '资料：' || chr(10) || lang || chr(10) || chr(10) || '要求：' || 'list' ELSE '问题：' || text || chr(10) || chr(10) || '资料：' || chr(10) || lang END AS prompt FROM eval_items WHERE lang IS NOT NULL")
def prompts(spark, folder):
    """What a model is asked for each query."""
    rows = table(spark, folder, "eval_items").where("lang is not null")
    return generation.prompts(rows.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), F.col("lang").alias("context"), F.when(F.col("set_name") == "heldout_facts", "list").alias("format")))


@query("SELECT item_id AS query_id, CASE WHEN item_id % 7 = 0 THEN NULL ELSE upper(text) END AS answer, CASE WHEN item_id % 7 = 0 THEN 3 WHEN item_id % 5 = 0 THEN 2 ELSE 1 END AS tries FROM eval_items")
def model_calls(spark, folder):
    """Answers of a model that sometimes fails, asked again where that may help."""

    def call(prompt: str, attempt: int) -> str:
        n, text = prompt.split("|", 1)
        if int(n) % 7 == 0 or (int(n) % 5 == 0 and attempt == 0):
            raise RuntimeError("429 too many requests")
        return text.upper()

    rows = table(spark, folder, "eval_items")
    return generation.answers(rows.select(F.col("item_id").alias("query_id"), F.concat(F.col("item_id").cast("string"), F.lit("|"), F.col("text")).alias("prompt")), call, tries=3, wait=lambda attempt: 0.0).select("query_id", "answer", "tries")


@query("WITH a AS (SELECT lower(alias) AS term, min(standard) AS standard FROM terms_seed WHERE length(alias) >= 3 AND regexp_matches(alias, '^[A-Za-z]+$') GROUP BY 1), t AS (SELECT lower(standard) AS term, max(standard) AS standard FROM a GROUP BY 1 UNION ALL SELECT * FROM a WHERE term NOT IN (SELECT lower(standard) FROM a)), w AS (SELECT item_id, unnest(range(0, len(s))) AS i, unnest(s) AS x FROM (SELECT item_id, string_split(text, ' ') AS s FROM eval_items)) SELECT item_id, i, coalesce(standard, x) AS word FROM w LEFT JOIN t ON lower(x) = term WHERE regexp_matches(x, '^[a-z]+$')")
def words_normalised(spark, folder):
    """Words of texts with aliases put to their standards."""
    seed = table(spark, folder, "terms_seed").where("length(alias) >= 3 and alias rlike '^[A-Za-z]+$'")
    rows = table(spark, folder, "eval_items").select("item_id", F.posexplode(F.split("text", " ")).alias("i", "x")).where("x rlike '^[a-z]+$'")
    whole = seed.select("alias", "standard")
    got = knowledge.normalise_terms(rows.select(F.struct("item_id", "i").alias("key"), "x"), whole, "x", whole_words=True)
    return got.select("key.item_id", "key.i", F.col("x").alias("word"))


@query("WITH d AS (SELECT metadata['doc_id'] AS doc_id, lower(primary_entity) AS name, lower(content) AS c FROM documents_tree WHERE primary_entity <> '' AND content <> '' AND metadata['doc_id'] IS NOT NULL) SELECT doc_id, name FROM d WHERE contains(c, name) GROUP BY ALL")
def recognised_names(spark, folder):
    """Names that a recogniser finds in chunks; what is no name is left out."""
    rows = table(spark, folder, "documents_tree").where("primary_entity <> '' and content <> ''").select(F.element_at("metadata", "doc_id").alias("doc_id"), F.lower("primary_entity").alias("p"), F.lower("content").alias("c")).where("doc_id is not null")

    def recognise(text: str) -> list[dict]:
        name, content = text.split("\x01", 1)
        return [{"name": name, "type": "ORG"}] if name in content else [{"name": "", "type": "ORG"}, {"type": "ORG"}]

    found = knowledge.recognise(rows.select("doc_id", F.concat("p", F.lit("\x01"), "c").alias("content")), recognise, "doc_id")
    return found.select("doc_id", F.col("entity_name").alias("name")).distinct()
