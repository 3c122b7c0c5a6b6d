"""All core queries over the test tables, each with its SQL where SQL can state it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellon.functions import text as X
from tessellon.functions import vectors as V
from tessellon.operators import chunking, diagnostics, entities, graph, index, queries as Q, retrieval, specs, versions
from tessellon.plans.lineage import cut
from tessellon.sources.tables import table
from tessellon.streaming import ingest

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (spark, folder) -> DataFrame under its name."""

    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# --- pieces of SQL ----------------------------------------------------------

_WIDE = X._WIDE.replace("'", "''")
_HALF = X._HALF.replace("'", "''")


def _tok(c: str) -> str:
    return f"regexp_extract_all(lower(translate({c}, '{_WIDE}', '{_HALF}')), '[\\x{{4e00}}-\\x{{9fff}}]|[a-z0-9\\x{{df}}-\\x{{f6}}\\x{{f8}}-\\x{{24f}}]+')"


_IDX = "idx AS (SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY ingested_at DESC NULLS LAST, created_at DESC NULLS LAST, content ASC NULLS LAST) = 1)"
_ASK = "ask AS (SELECT item_id AS query_id, text AS query FROM eval_items WHERE item_id % 20 = 0)"
_LATEST = "is_latest AND chunk_type IN ('child', 'summary', 'doc_summary')"


def _norm(c: str) -> str:
    return f"sqrt(list_sum(list_transform({c}, lambda x: x::DOUBLE * x::DOUBLE)))"


def _cos(a: str, b: str) -> str:
    return f"round(list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[]), 6)"


def _bm25(name: str, source: str, key: str, fields: list[tuple[str, float]], keep: str = "true") -> str:
    """CTEs ending in `name` (query_id, key, score) for terms qt (query_id, term, weight)."""
    out, parts = [], []
    for i, (field, boost) in enumerate(fields):
        out.append(f"{name}_t{i} AS (SELECT {key}, {keep} AS keep, t FROM (SELECT *, {_tok(field)} AS t FROM {source}) WHERE len(t) > 0)")
        out.append(f"{name}_s{i} AS (SELECT count(*) AS nd, sum(len(t)) / count(*) AS avgdl FROM {name}_t{i})")
        out.append(f"{name}_f{i} AS (SELECT {key}, keep, dl, term, count(*) AS tf FROM (SELECT {key}, keep, len(t) AS dl, unnest(t) AS term FROM {name}_t{i}) WHERE term IN (SELECT term FROM qt) GROUP BY ALL)")
        out.append(f"{name}_d{i} AS (SELECT term, count(*) AS df FROM {name}_f{i} GROUP BY 1)")
        parts.append(f"SELECT {key}, term, {boost} * ln(1.0 + (nd - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS s FROM {name}_f{i} JOIN {name}_d{i} USING (term), {name}_s{i} WHERE keep")
    out.append(f"{name} AS (SELECT query_id, {key}, round(sum(s * weight), 6) AS score FROM (SELECT {key}, term, max(s) AS s FROM ({' UNION ALL '.join(parts)}) GROUP BY ALL) JOIN qt USING (term) GROUP BY ALL)")
    return ", ".join(out)


_QT = f"qt AS (SELECT query_id, term, count(*)::DOUBLE AS weight FROM (SELECT query_id, unnest({_tok('query')}) AS term FROM ask) GROUP BY ALL)"


# --- shared inputs ----------------------------------------------------------


def chunks(spark: SparkSession, folder: str) -> DataFrame:
    """The chunk index: of each chunk_id the row ingested last."""
    rows = table(spark, folder, "chunks")
    return index.newest(rows, "chunk_id", [F.col("ingested_at").desc_nulls_last(), F.col("created_at").desc_nulls_last(), F.col("content").asc_nulls_last()])


def asked(spark: SparkSession, folder: str) -> DataFrame:
    """(query_id, query): the set of queries, every twentieth of eval_items."""
    return table(spark, folder, "eval_items").where("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def asked_terms(spark: SparkSession, folder: str) -> DataFrame:
    return asked(spark, folder).select("query_id", F.explode(X.tokens("query")).alias("term")).groupBy("query_id", "term").agg(F.count("*").cast("double").alias("weight"))


def asked_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """(query_id, query_vec): the same ids with vectors of embeddings."""
    return table(spark, folder, "embeddings").where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))


def spec_rows(spark: SparkSession, folder: str) -> DataFrame:
    """part as specifications: type, brand, name and parameters with units."""
    p = table(spark, folder, "part")
    params = F.create_map(F.lit("尺寸"), F.concat(F.col("p_size").cast("string"), F.lit("cm")), F.lit("功耗"), F.concat((F.col("p_size") * 3).cast("string"), F.lit("W")), F.lit("备注"), F.when(F.col("p_size") % 5 == 0, "").otherwise(F.col("p_brand")))
    return p.select(F.col("p_type").alias("category"), F.col("p_brand").alias("series"), F.concat_ws("#", "p_name", F.col("p_partkey").cast("string")).alias("model"), params.alias("params"))


_SPEC = "spec AS (SELECT p_type AS category, p_brand AS series, p_name || '#' || p_partkey AS model, p_size || 'cm' AS size, (p_size * 3) || 'W' AS power, CASE WHEN p_size % 5 = 0 THEN '' ELSE p_brand END AS note FROM part)"


def alias_links(spark: SparkSession, folder: str) -> DataFrame:
    """(source, position, target): names of alias_candidates linked with their aliases, in order of name."""
    rows = entities.merge_aliases(table(spark, folder, "alias_candidates"))
    return rows.select(F.col("standard_name").alias("source"), F.hash("alias").alias("position"), F.col("alias").alias("target"))


_AL = "al AS (SELECT DISTINCT standard_name AS source, c.alias AS target FROM (SELECT standard_name, unnest(candidate_aliases) AS c FROM alias_candidates) WHERE standard_name IS NOT NULL AND c.alias IS NOT NULL)"


# --- retrieval --------------------------------------------------------------

_HYB_WORDS = _bm25("bm", "idx", "chunk_id", [("content", 1.0), ("doc_title", 2.0)], _LATEST)
_HYB = f"""WITH {_IDX}, {_ASK}, {_QT}, {_HYB_WORDS},
w AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) - 1 AS r FROM bm QUALIFY r < 40),
kn AS (SELECT vec_id AS query_id, chunk_id, round((1 + c) / 2, 6) AS score FROM (SELECT vec_id, chunk_id, {_cos('embedding_vector', 'embedding')} AS c FROM (SELECT * FROM idx WHERE {_LATEST} AND embedding_vector IS NOT NULL AND len(embedding_vector) = 64 AND {_norm('embedding_vector')} > 0), (SELECT * FROM embeddings WHERE vec_id % 20 = 0 AND vec_id IN (SELECT query_id FROM ask))) WHERE c >= 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) - 1 AS r FROM kn QUALIFY r < 40),
f AS (SELECT query_id, chunk_id, w.r AS wr, k.r AS kr, round(coalesce((1 - 0.7) / (60 + w.r), 0) + coalesce(0.7 / (60 + k.r), 0), 9) AS score FROM w FULL JOIN k USING (query_id, chunk_id))
SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, wr ASC NULLS LAST, kr ASC NULLS LAST, chunk_id) - 1 AS rank FROM f QUALIFY rank < 20"""


@query(_HYB)
def hybrid_search_rrf(spark, folder):
    """BM25 and nearest vectors fused, for a batch of queries."""
    vecs = asked_vectors(spark, folder).join(F.broadcast(asked(spark, folder).select("query_id")), "query_id", "left_semi")
    return retrieval.hybrid(asked_terms(spark, folder), vecs, chunks(spark, folder))


@query(f"WITH {_ASK}, {_QT}, {_bm25('bm', 'documents', 'doc_id', [('text', 1.0)])} SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1 AS rank FROM bm QUALIFY rank < 20")
def bm25_topk(spark, folder):
    """The twenty best documents of each query by BM25."""
    return retrieval.top(retrieval.bm25(asked_terms(spark, folder), table(spark, folder, "documents"), fields={"text": 1.0}, key="doc_id"), 20, "doc_id")


@query(f"WITH {_ASK}, {_QT}, {_bm25('bm', 'documents', 'doc_id', [('text', 1.0), ('doc_title', 2.0)])} SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1 AS rank FROM bm QUALIFY rank < 20")
def bm25_title_boost(spark, folder):
    """The same over text and title, the better field counting."""
    return retrieval.top(retrieval.bm25(asked_terms(spark, folder), table(spark, folder, "documents"), fields={"text": 1.0, "doc_title": 2.0}, key="doc_id"), 20, "doc_id")


@query(f"SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) - 1 AS rank FROM (SELECT q.vec_id AS query_id, e.vec_id, round((1 + c) / 2, 6) AS score FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 20 = 0) q, LATERAL (SELECT {_cos('e.embedding', 'q.embedding')} AS c) WHERE c >= 0) QUALIFY rank < 10")
def knn_cosine_topk(spark, folder):
    """The ten nearest embeddings of every twentieth."""
    rows = table(spark, folder, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    return retrieval.top(retrieval.knn(asked_vectors(spark, folder), rows, "vec_id", k=10), 10, "vec_id")


@query(f"WITH {_IDX} SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) - 1 AS rank FROM (SELECT q.vec_id AS query_id, e.chunk_id, round((1 + c) / 2, 6) AS score FROM (SELECT * FROM idx WHERE {_LATEST} AND len(embedding_vector) = 64 AND {_norm('embedding_vector')} > 0) e, (SELECT * FROM embeddings WHERE vec_id % 20 = 0) q, LATERAL (SELECT {_cos('e.embedding_vector', 'q.embedding')} AS c) WHERE c >= 0) QUALIFY rank < 10")
def knn_filtered(spark, folder):
    """Nearest chunks among those that retrieval may return."""
    rows = chunks(spark, folder).where(retrieval.searchable(retrieval.Options())).select("chunk_id", F.col("embedding_vector").alias("vec"))
    return retrieval.top(retrieval.knn(asked_vectors(spark, folder), rows, k=10), 10)


@query(f"WITH {_IDX}, {_ASK}, {_QT}, {_bm25('bm', 'idx', 'chunk_id', [('content', 1.0)], _LATEST)}, hits AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) - 1 AS rank FROM bm QUALIFY rank < 30), h AS (SELECT hits.*, chunk_type, parent_id, p.chunk_id IS NOT NULL AS there FROM hits JOIN idx USING (chunk_id) LEFT JOIN (SELECT chunk_id FROM idx WHERE chunk_type = 'parent') p ON p.chunk_id = idx.parent_id), c AS (SELECT *, parent_id IS NOT NULL AND there AND (count(*) OVER (PARTITION BY query_id, parent_id) >= 2 OR max((chunk_type = 'summary')::INT) OVER (PARTITION BY query_id, parent_id) = 1) AS up FROM h), o AS (SELECT query_id, parent_id AS chunk_id, max(score) AS score, min(rank) AS rank, true AS expanded FROM c WHERE up GROUP BY query_id, parent_id UNION ALL SELECT query_id, chunk_id, score, rank, false FROM c WHERE NOT up), d AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY rank) = 1) SELECT query_id, chunk_id, score, expanded, row_number() OVER (PARTITION BY query_id ORDER BY rank, chunk_id) - 1 AS position FROM d")
def parent_expand(spark, folder):
    """Hits replaced by their parents where two share one or a summary points to it."""
    rows = cut(chunks(spark, folder).drop("embedding_vector"))
    hits = retrieval.top(retrieval.bm25(asked_terms(spark, folder), rows, retrieval.searchable(retrieval.Options())), 30)
    return retrieval.expand(hits.join(rows.select("chunk_id", "chunk_type", "parent_id"), "chunk_id"), rows)


@query("WITH k AS (SELECT DISTINCT parent_id, chunk_id FROM chunks WHERE chunk_type = 'child' AND parent_id IS NOT NULL AND chunk_id IS NOT NULL), o AS (SELECT *, row_number() OVER (PARTITION BY parent_id ORDER BY coalesce(try_cast(regexp_extract(chunk_id, '_t?c(\\d+)$', 1) AS BIGINT), 0), chunk_id) AS n FROM k) SELECT chunk_id, parent_id, lag(chunk_id) OVER w AS prev_id, lead(chunk_id) OVER w AS next_id FROM o WINDOW w AS (PARTITION BY parent_id ORDER BY n)")
def sibling_neighbors(spark, folder):
    """Each child with its neighbours under the same parent."""
    return retrieval.neighbours(table(spark, folder, "chunks").where("chunk_id is not null"))


@query("WITH d AS (SELECT source AS query_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS position, '[来源: ' || coalesce(doc_title, '') || ']' || chr(10) || coalesce(text, '') AS part FROM documents WHERE source IS NOT NULL), s AS (SELECT *, sum(length(part)) OVER (PARTITION BY query_id ORDER BY position) AS n FROM d) SELECT query_id, string_agg(part, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY position) AS context, count(*) AS n_chunks FROM s WHERE n <= 10000 GROUP BY 1")
def context_budget(spark, folder):
    """Per source the texts that fit a context, in order of id."""
    from pyspark.sql import Window

    w = Window.partitionBy("source").orderBy("doc_id")
    hits = table(spark, folder, "documents").where("source is not null").select(F.col("source").alias("query_id"), "doc_title", F.col("text").alias("content"), F.row_number().over(w).alias("position"))
    return retrieval.context(hits)


def _modes(spark, folder) -> DataFrame:
    terms, docs = asked_terms(spark, folder), table(spark, folder, "documents")
    plain = retrieval.top(retrieval.bm25(terms, docs, fields={"text": 1.0}, key="doc_id"), 20, "doc_id").withColumn("mode", F.lit("text"))
    titled = retrieval.top(retrieval.bm25(terms, docs, fields={"text": 1.0, "doc_title": 2.0}, key="doc_id"), 20, "doc_id").withColumn("mode", F.lit("title"))
    return plain.unionByName(titled).withColumnRenamed("doc_id", "chunk_id")


_MODES = f"{_ASK}, {_QT}, {_bm25('b1', 'documents', 'doc_id', [('text', 1.0)])}, {_bm25('b2', 'documents', 'doc_id', [('text', 1.0), ('doc_title', 2.0)])}, m AS (SELECT 'text' AS mode, *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1 AS rank FROM b1 QUALIFY rank < 20 UNION ALL SELECT 'title', *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1 AS rank FROM b2 QUALIFY rank < 20)"


@query(f"WITH {_MODES}, j AS (SELECT query_id, count(*) FILTER (WHERE n = 2) AS n_common, count(*) AS n_union FROM (SELECT query_id, doc_id, count(*) AS n FROM m GROUP BY ALL) GROUP BY 1) SELECT query_id, 'text' AS mode_a, 'title' AS mode_b, n_common, n_union, round(n_common / n_union, 6) AS jaccard FROM j")
def mode_overlap_jaccard(spark, folder):
    """How far two ways of searching agree."""
    return retrieval.overlap(_modes(spark, folder))


@query(f"WITH {_MODES}, c AS (SELECT * FROM m WHERE rank < 5), f AS (SELECT query_id, doc_id AS chunk_id, mode AS part, rank FROM c QUALIFY row_number() OVER (PARTITION BY query_id, doc_id ORDER BY mode, rank) = 1) SELECT query_id, chunk_id, part, row_number() OVER (PARTITION BY query_id ORDER BY part, rank) - 1 AS position FROM f")
def multi_query_union_cut(spark, folder):
    """The results of several searches as one list, ten in all."""
    return retrieval.union_cut(_modes(spark, folder).withColumnRenamed("mode", "part"), 10)


@query(f"WITH e AS (SELECT vec_id, embedding FROM embeddings), s AS (SELECT * FROM e WHERE vec_id % 20 = 0), f AS (SELECT * FROM e WHERE vec_id % 20 <> 0) SELECT vec_id AS chunk_id FROM f WHERE NOT EXISTS (SELECT 1 FROM s WHERE list_cosine_similarity(f.embedding::DOUBLE[], s.embedding::DOUBLE[]) > 0.92)")
def semantic_dedup(spark, folder):
    """Embeddings that are not close to one of every twentieth."""
    rows = table(spark, folder, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vec"))
    return retrieval.semantic_new(rows.where("chunk_id % 20 = 0"), rows.where("chunk_id % 20 <> 0")).select("chunk_id")


@query("SELECT label, list(m ORDER BY i) AS vec FROM (SELECT label, i, round(avg(x), 6) AS m FROM (SELECT label, unnest(range(1, 65)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY ALL) GROUP BY 1")
def mean_vectors(spark, folder):
    """The mean vector of each label."""
    got = V.mean_vector(table(spark, folder, "embeddings").select("label", F.col("embedding").alias("vec")), "label", "vec")
    return got.select("label", F.transform("vec", lambda x: F.round(x, 6)).alias("vec"))


# --- queries ----------------------------------------------------------------


@query()
def keyword_weights(spark, folder):
    """Keywords of all evaluation texts with their weights."""
    rows = table(spark, folder, "eval_items").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return Q.keywords(rows, table(spark, folder, "terms_seed"))


@query()
def query_clauses(spark, folder):
    """The weighted clauses of a batch of queries."""
    seed = table(spark, folder, "terms_seed")
    rows = asked(spark, folder)
    return Q.clauses(Q.normalised(Q.keywords(rows, seed), seed), seed, rows)


@query()
def rerank_queries(spark, folder):
    """Queries with their keywords for a reranker."""
    rows = asked(spark, folder)
    return Q.rerank_query(rows, Q.keywords(rows, table(spark, folder, "terms_seed")))


@query("WITH s AS (SELECT lower(alias) AS x, lower(standard) AS y FROM terms_seed), p AS (SELECT x, y FROM s UNION SELECT y, x FROM s UNION SELECT a.x, b.x FROM s a JOIN s b ON a.y = b.y), k AS (SELECT DISTINCT lower(standard) AS term FROM terms_seed) SELECT term, 1.0 AS weight, false AS synonym FROM k UNION ALL SELECT y, 0.2, true FROM k JOIN p ON p.x = k.term WHERE p.x <> p.y")
def synonym_expand(spark, folder):
    """Every standard term with its synonyms at a fifth of the weight."""
    seed = table(spark, folder, "terms_seed")
    rows = seed.select(F.lower("standard").alias("term")).distinct().select(F.lit(1).alias("query_id"), F.lit(0).alias("position"), "term", F.lit(1.0).alias("weight"))
    return Q.expanded(rows, seed).select("term", "weight", "synonym")


# --- text -------------------------------------------------------------------


@query("SELECT doc_id, regexp_replace(regexp_replace(replace(replace(text, '<|', '<'), '|>', '>'), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F\\x{FFFE}]', '', 'g'), '\\n{3,}', chr(10) || chr(10), 'g') AS text FROM documents")
def clean_controls(spark, folder):
    """Texts without broken brackets, control characters and runs of blank lines."""
    text = F.regexp_replace(X.drop_controls(X.unbar("text")), "\\n{3,}", "\n\n")
    return table(spark, folder, "documents").select("doc_id", text.alias("text"))


@query("SELECT doc_id, regexp_replace(regexp_replace(content, '\\n{3,}', chr(10) || chr(10), 'g'), '[\\t\\f\\r \\x{00a0}\\x{1680}\\x{180e}\\x{2000}-\\x{200a}\\x{202f}\\x{205f}\\x{3000}]{2,}', ' ', 'g') AS text FROM document_info")
def clean_spaces(spark, folder):
    """Contents with runs of spaces and blank lines squeezed."""
    return table(spark, folder, "document_info").select("doc_id", X.squeeze("content").alias("text"))


@query("SELECT doc_id, regexp_replace(regexp_replace(content, '!\\[[^\\n]*?\\]\\(https?://[^)]+\\)', '', 'g'), '(\\[[^\\]]*\\]\\(https?://[^)]+\\))|[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\\.[a-zA-Z0-9-.]+|https?://\\S+', '\\1', 'g') AS text FROM document_info")
def clean_addresses(spark, folder):
    """Contents without addresses, links staying."""
    return table(spark, folder, "document_info").select("doc_id", X.drop_addresses("content").alias("text"))


@query()
def clean_headers_footers(spark, folder):
    return table(spark, folder, "document_info").select("doc_id", X.drop_headers_footers("content", whole_words=True).alias("text"))


@query()
def clean_all(spark, folder):
    """All cleaning steps over all contents."""
    return table(spark, folder, "document_info").select("doc_id", X.clean("content").alias("text"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[\\x{4e00}-\\x{9fff}]|[a-zA-Z]{2,}|[0-9]+')) AS n_words, text IS NULL OR len(regexp_extract_all(text, '[\\x{4e00}-\\x{9fff}]|[a-zA-Z]{2,}|[0-9]+')) < 3 AS low FROM documents WHERE text IS NULL OR NOT regexp_matches(text, '<[^>]+>')")
def low_quality_filter(spark, folder):
    """Texts without tags with the number of their words and whether these are too few."""
    rows = table(spark, folder, "documents").where("text is null or not text rlike '<[^>]+>'")
    return rows.select("doc_id", X.effective_words("text").alias("n_words"), X.is_low_quality("text").alias("low"))


@query("WITH c AS (SELECT doc_id, content AS t, regexp_replace(content, '<[^>]+>', '', 'g') AS p, len(regexp_extract_all(content, '[\\x{4e00}-\\x{9fff}]|[a-zA-Z]{2,}|[0-9]+')) AS w FROM document_info WHERE regexp_matches(content, '<[^>]+>')), r AS (SELECT *, (length(t) - length(p)) / greatest(length(t), 1) AS q FROM c) SELECT doc_id, round(q, 6) AS tag_ratio, (q > 0.5 AND length(trim(p, ' ' || chr(10) || chr(9) || chr(13))) < 20) OR regexp_matches(t, '(?i)</td>\\s*</tr>\\s*<tr>\\s*<td') OR (len(regexp_extract_all(t, '(?i)</td>')) >= 3 AND w < 15) OR (q > 0.15 AND w < 15) AS low FROM r")
def low_quality_html(spark, folder):
    """Contents with tags, their part of the text, and whether they are remains of tables."""
    rows = table(spark, folder, "document_info").where("content rlike '<[^>]+>'")
    return rows.select("doc_id", F.round(X.tag_ratio("content"), 6).alias("tag_ratio"), X.is_low_quality("content").alias("low"))


@query("SELECT sha256(text) AS content_hash, count(*) AS n, min(doc_id) AS first_id FROM documents WHERE text <> '' GROUP BY 1 HAVING count(*) > 1")
def doc_hash_exact_dups(spark, folder):
    """Texts that stand under several ids."""
    rows = table(spark, folder, "documents").where("text <> ''")
    return rows.groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@query("SELECT DISTINCT doc_id, lower(regexp_extract(file_name, '(\\.[^./]+)$', 1)) AS suffix, translate(title, '/\\:*?\"<>|', '_________') AS safe_title, left(sha256(coalesce(content, '')), 16) AS short_hash, CASE WHEN length(content) > 150 THEN left(content, 150) || '...' ELSE content END AS snippet FROM document_info")
def file_projection(spark, folder):
    """Names, hashes and snippets of files."""
    rows = table(spark, folder, "document_info")
    return rows.select("doc_id", F.lower(F.regexp_extract("file_name", "(\\.[^./]+)$", 1)).alias("suffix"), X.safe_file_name("title").alias("safe_title"), X.short_hash(F.coalesce("content", F.lit(""))).alias("short_hash"), X.snippet("content", 150).alias("snippet")).distinct()


@query()
def file_kinds(spark, folder):
    """Format, kind and base name of every file, with its pages by estimate."""
    rows = table(spark, folder, "document_info").select("doc_id", "file_name", "content").distinct()
    return rows.select("doc_id", X.file_format("file_name").alias("format"), X.doc_type("file_name").alias("kind"), X.base_name("file_name").alias("base"), X.is_versioned("file_name").alias("versioned"), X.page_estimate("content").alias("pages"), X.slug("file_name").alias("slug"))


@query("SELECT doc_id, unnest(range(0, len(s))) AS position, unnest(s) AS sentence FROM (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([。！？.!?])[ \\t\\n\\r\\f\\x0B\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+', '\\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS s FROM documents)")
def sentence_split(spark, folder):
    """The sentences of all texts."""
    return table(spark, folder, "documents").select("doc_id", F.posexplode(X.sentences("text")).alias("position", "sentence"))


# --- the index --------------------------------------------------------------


@query(f"WITH {_IDX} SELECT chunk_id, doc_id, chunk_type, content, ingested_at FROM idx")
def upsert_index(spark, folder):
    """The index after all deliveries, the last of each chunk counting."""
    return chunks(spark, folder).select("chunk_id", "doc_id", "chunk_type", "content", "ingested_at")


@query("WITH p AS (SELECT metadata['chunk_id'] AS pid, metadata['doc_id'] AS doc_id, metadata['doc_hash'] AS h, content, children, summaries FROM documents_tree), r AS (SELECT pid AS chunk_id, doc_id, 'parent' AS chunk_type, content, NULL AS parent_id, h AS doc_hash FROM p UNION ALL SELECT c.metadata['chunk_id'], doc_id, 'child', c.content, coalesce(c.metadata['parent_id'], pid), coalesce(c.metadata['doc_hash'], h) FROM (SELECT *, unnest(children) AS c FROM p) UNION ALL SELECT c.metadata['chunk_id'], doc_id, 'summary', c.content, pid, coalesce(c.metadata['doc_hash'], h) FROM (SELECT *, unnest(summaries) AS c FROM p)) SELECT chunk_id, doc_id, chunk_type, content, parent_id, doc_hash FROM r")
def tree_rows(spark, folder):
    """Index rows of the nested documents."""
    return index.rows_of(table(spark, folder, "documents_tree")).select("chunk_id", "doc_id", "chunk_type", "content", "parent_id", "doc_hash")


@query(f"WITH {_IDX}, l AS (SELECT dataset_id, source_key, max_by(doc_id, (ingested_at, doc_id)) AS last FROM idx WHERE source_key IS NOT NULL GROUP BY ALL) SELECT chunk_id, doc_id, source_key, l.last IS NULL OR idx.doc_id = l.last AS is_latest FROM idx LEFT JOIN l USING (dataset_id, source_key)")
def latest_versions(spark, folder):
    """Which chunks belong to the version that arrived last."""
    return index.mark_latest(chunks(spark, folder).drop("embedding_vector")).select("chunk_id", "doc_id", "source_key", "is_latest")


@query(f"WITH {_IDX} SELECT doc_id, min(doc_title) AS doc_title, count(DISTINCT chunk_id) AS n_chunks, max(created_at) AS created_at FROM idx WHERE chunk_type = 'parent' GROUP BY 1")
def list_documents(spark, folder):
    """All documents with the number of their parent chunks."""
    return index.list_documents(chunks(spark, folder))


@query(f"WITH {_IDX}, d AS (SELECT doc_id, min(doc_title) AS doc_title, count(DISTINCT chunk_id) AS n_chunks, max(created_at) AS created_at FROM idx WHERE chunk_type = 'parent' GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY created_at DESC NULLS LAST, doc_id) AS position, count(*) OVER () AS total FROM d) SELECT * FROM r WHERE position > 20 AND position <= 40")
def list_documents_page(spark, folder):
    """The second page of twenty documents."""
    return index.list_documents(chunks(spark, folder), page=2, size=20)


@query("SELECT doc_id, min_by(doc_title, (chunk_id, doc_title)) AS doc_title FROM chunks WHERE doc_title <> '' GROUP BY 1")
def document_titles(spark, folder):
    return index.titles(table(spark, folder, "chunks"))


@query("SELECT dataset_id, chunk_type, count(*) AS n_chunks, count(DISTINCT doc_id) AS n_docs FROM chunks GROUP BY ALL")
def dataset_counts(spark, folder):
    return index.counts(table(spark, folder, "chunks"), ["dataset_id", "chunk_type"])


@query("SELECT chunk_id FROM chunks WHERE doc_id NOT IN (SELECT metadata['doc_id'] FROM documents_tree WHERE metadata['dataset_id'] = 'ds_press' AND metadata['doc_id'] IS NOT NULL)")
def delete_documents(spark, folder):
    """The index without the documents of one dataset."""
    gone = table(spark, folder, "documents_tree").where("metadata['dataset_id'] = 'ds_press'").select(F.element_at("metadata", "doc_id").alias("doc_id"))
    return index.delete(table(spark, folder, "chunks").select("chunk_id", "doc_id"), gone.where("doc_id is not null")).select("chunk_id")


# --- diagnostics ------------------------------------------------------------

_P = [10, 25, 50, 75, 90, 95, 99]


@query("SELECT chunk_type, count(*) AS n, min(length(content)) AS least, max(length(content)) AS greatest, round(avg(length(content)), 6) AS mean, " + ", ".join(f"round(quantile_cont(length(content), {p / 100}), 6) AS p{p}" for p in _P) + " FROM chunks WHERE content IS NOT NULL GROUP BY 1")
def length_percentiles(spark, folder):
    return diagnostics.length_percentiles(table(spark, folder, "chunks"), "content", ["chunk_type"])


@query("SELECT low, n, round(n / sum(n) OVER (), 6) AS share FROM (SELECT CASE WHEN l >= 2000 THEN 2000 WHEN l >= 1000 THEN 1000 WHEN l >= 500 THEN 500 WHEN l >= 200 THEN 200 WHEN l >= 100 THEN 100 WHEN l >= 50 THEN 50 ELSE 0 END AS low, count(*) AS n FROM (SELECT length(text) AS l FROM documents WHERE text IS NOT NULL) GROUP BY 1)")
def length_histogram(spark, folder):
    return diagnostics.length_histogram(table(spark, folder, "documents"), "text")


@query("SELECT doc_id, n, n_short, round(n_short / n, 6) AS share FROM (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE length(content) < 100) AS n_short FROM chunks WHERE content IS NOT NULL GROUP BY 1) ORDER BY share DESC, n DESC, doc_id LIMIT 10")
def short_ratio_top10(spark, folder):
    return diagnostics.short_share(table(spark, folder, "chunks"), "content", "doc_id")


@query("SELECT event_type, count(*) AS n, count(*) FILTER (WHERE f) AS n_failed, round(avg(value) FILTER (WHERE NOT f), 6) AS mean_value, round(max(value) FILTER (WHERE NOT f), 6) AS max_value FROM (SELECT *, coalesce(value < 0, true) AS f FROM events) GROUP BY 1")
def mode_statistics(spark, folder):
    return diagnostics.mode_statistics(table(spark, folder, "events"), "event_type", "value", F.coalesce(F.col("value") < 0, F.lit(True)))


@query("WITH a AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER w THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), r AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM a) SELECT user_id, event_type, min(ts) AS started, count(*) AS n FROM r GROUP BY user_id, g, event_type HAVING count(*) >= 3")
def stuck_detection(spark, folder):
    """Runs of three and more events of one kind."""
    return diagnostics.streaks(table(spark, folder, "events"), "user_id", ["ts", "event_id"], "event_type")


@query("SELECT time_bucket(INTERVAL 10 MINUTES, ts, TIMESTAMP '1970-01-01') AS started, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def windowed_events(spark, folder):
    return ingest.windowed(table(spark, folder, "events")).withColumn("total", F.round("total", 4))


@query("WITH a AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM a) SELECT user_id, min(ts) AS started, max(ts) + INTERVAL 30 MINUTES AS ended, count(*) AS n FROM s GROUP BY user_id, g")
def event_sessions(spark, folder):
    return ingest.sessions(table(spark, folder, "events"))


# --- chunking ---------------------------------------------------------------


@query()
def chunk_documents(spark, folder):
    """Parents and children of all contents."""
    return chunking.chunk(table(spark, folder, "document_info").dropDuplicates(["doc_id"]).select("doc_id", "content"))


@query()
def chunk_tables_apart(spark, folder):
    return chunking.chunk(table(spark, folder, "document_info").dropDuplicates(["doc_id"]).select("doc_id", "content"), tables_apart=True)


@query(f"WITH {_IDX}, p AS (SELECT doc_id, try_cast(regexp_extract(chunk_id, '_p(\\d+)$', 1) AS INT) AS group_no, embedding_vector AS v FROM idx WHERE chunk_type = 'parent'), c AS (SELECT doc_id, group_no, v, lag(v) OVER (PARTITION BY doc_id ORDER BY group_no) AS u FROM p), b AS (SELECT *, CASE WHEN u IS NULL OR v IS NULL OR len(u) <> len(v) THEN 0 WHEN {_norm('u')} * {_norm('v')} = 0 THEN 1 WHEN list_cosine_similarity(u::DOUBLE[], v::DOUBLE[]) < 0.7 THEN 1 ELSE 0 END AS b FROM c) SELECT doc_id, group_no, sum(b) OVER (PARTITION BY doc_id ORDER BY group_no) AS segment FROM b")
def chunk_semantic(spark, folder):
    """Segments of documents by their parents' vectors."""
    rows = chunks(spark, folder).where("chunk_type = 'parent'").select("doc_id", F.regexp_extract("chunk_id", "_p(\\d+)$", 1).try_cast("int").alias("group_no"), F.col("embedding_vector").alias("vec"))
    return chunking.semantic_breaks(rows)


@query("SELECT chunk_id, CASE WHEN length(content) > 100 THEN left(content, 100) || '...' ELSE content END AS summary FROM (SELECT DISTINCT chunk_id, content FROM chunks WHERE chunk_type = 'parent')")
def summaries_default(spark, folder):
    return chunking.summaries(table(spark, folder, "chunks").where("chunk_type = 'parent'").select("chunk_id", "content").distinct())


# --- versions and similarity ------------------------------------------------


@query()
def version_groups(spark, folder):
    """Files of one dataset whose names are versions of one name."""
    return versions.name_groups(table(spark, folder, "document_info").select(F.element_at("metadata", "dataset_id").alias("folder"), F.col("file_name").alias("filename")))


def _contents(spark, folder) -> DataFrame:
    rows = table(spark, folder, "document_info").where("content is not null and metadata['dataset_id'] is not null")
    return rows.select(F.element_at("metadata", "dataset_id").alias("folder"), F.col("doc_id").alias("filename"), "content").dropDuplicates(["folder", "filename"])


@query("WITH f AS (SELECT DISTINCT metadata['dataset_id'] AS folder, doc_id AS k, content AS t FROM document_info WHERE length(content) > 50 AND metadata['dataset_id'] IS NOT NULL), g AS (SELECT folder, k, list_distinct(list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3))) AS s FROM f), j AS (SELECT a.folder, a.k AS a, b.k AS b, len(list_intersect(a.s, b.s)) AS c, len(a.s) + len(b.s) AS n FROM g a JOIN g b ON a.folder = b.folder AND a.k < b.k AND len(a.s) >= 0.7 * len(b.s) AND len(b.s) >= 0.7 * len(a.s)) SELECT folder, a, b, round(c / (n - c), 6) AS similarity FROM j WHERE c / (n - c) >= 0.7")
def trigram_jaccard_pairs(spark, folder):
    """Contents of one dataset that share most of their three-character runs, over the whole texts."""
    return versions.similar_contents(_contents(spark, folder))


@query()
def greedy_near_dup_clusters(spark, folder):
    return versions.greedy_clusters(versions.similar_contents(_contents(spark, folder)))


@query(f"SELECT a, b, similarity FROM (SELECT x.vec_id AS a, y.vec_id AS b, {_cos('x.embedding', 'y.embedding')} AS similarity FROM embeddings x JOIN embeddings y ON x.label = y.label AND x.vec_id < y.vec_id) WHERE similarity >= 0.85")
def alias_pairs_cosine(spark, folder):
    """Embeddings of one label that are close."""
    rows = table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")
    return entities.alias_pairs(rows, "label")


# --- entities ---------------------------------------------------------------


@query("WITH t AS (SELECT DISTINCT term, standard FROM (SELECT lower(alias) AS term, standard FROM terms_seed UNION ALL SELECT lower(standard), standard FROM terms_seed) WHERE term <> ''), d AS (SELECT DISTINCT doc_id, lower(content) AS c FROM document_info WHERE content <> '') SELECT doc_id, standard, sum(n)::BIGINT AS n FROM (SELECT doc_id, standard, len(list_filter(range(1, length(c) + 1), lambda i: substr(c, i, length(term)) = term)) AS n FROM d JOIN t ON contains(c, term)) GROUP BY ALL HAVING sum(n) > 0")
def dictionary_entities(spark, folder):
    """Mentions of all the dictionary's terms, those of one character too, in all contents."""
    rows = table(spark, folder, "document_info").select("doc_id", "content").distinct()
    return entities.dictionary_hits(rows, table(spark, folder, "terms_seed"), "doc_id")


@query()
def pattern_entities(spark, folder):
    return entities.pattern_hits(table(spark, folder, "document_info").select("doc_id", "content").distinct(), "doc_id")


_SRC = "coalesce((SELECT list(DISTINCT x ORDER BY x) FROM (SELECT unnest(flatten(list({0}))) AS x) WHERE x IS NOT NULL), [])"


@query("WITH t AS (SELECT entity_name, entity_type, sum(frequency)::BIGINT AS frequency FROM entity_raw GROUP BY ALL), s AS (SELECT entity_name, entity_type, count(DISTINCT x) AS n FROM (SELECT entity_name, entity_type, unnest(source_docs) AS x FROM entity_raw) WHERE x IS NOT NULL GROUP BY ALL), c AS (SELECT entity_name, entity_type, count(DISTINCT x) AS n FROM (SELECT entity_name, entity_type, unnest(source_chunks) AS x FROM entity_raw) WHERE x IS NOT NULL GROUP BY ALL) SELECT t.entity_name, t.entity_type, frequency, coalesce(s.n, 0) AS n_docs, coalesce(c.n, 0) AS n_chunks FROM t LEFT JOIN s ON t.entity_name IS NOT DISTINCT FROM s.entity_name AND t.entity_type IS NOT DISTINCT FROM s.entity_type LEFT JOIN c ON t.entity_name IS NOT DISTINCT FROM c.entity_name AND t.entity_type IS NOT DISTINCT FROM c.entity_type")
def entity_merge(spark, folder):
    """Entities of one name and type as one."""
    return entities.merge(table(spark, folder, "entity_raw")).select("entity_name", "entity_type", "frequency", F.size("source_docs").alias("n_docs"), F.size("source_chunks").alias("n_chunks"))


@query("SELECT standard_name, c.alias AS alias, max(c.embedding_sim) AS embedding_sim FROM (SELECT standard_name, unnest(candidate_aliases) AS c FROM alias_candidates) WHERE standard_name IS NOT NULL AND c.alias IS NOT NULL GROUP BY ALL")
def alias_merge(spark, folder):
    return entities.merge_aliases(table(spark, folder, "alias_candidates"))


@query("WITH e AS (SELECT DISTINCT unnest(source_chunks) AS chunk_id, entity_name FROM entity_raw WHERE entity_type = 'ORG' AND entity_name IS NOT NULL) SELECT chunk_id, list(entity_name ORDER BY entity_name) AS orgs FROM e WHERE chunk_id IS NOT NULL GROUP BY 1 HAVING count(*) >= 2")
def cooccurrence_candidates(spark, folder):
    """Chunks that name several organisations."""
    return entities.cooccurrence(table(spark, folder, "entity_raw"))


@query("WITH r AS (SELECT l_orderkey AS o, list(DISTINCT l_suppkey::VARCHAR ORDER BY l_suppkey::VARCHAR) AS units, min(l_shipmode) AS c FROM (SELECT *, 'S' || (l_suppkey % 7) AS l_shipmode FROM lineitem) GROUP BY 1) SELECT units, count(*) AS n_rows, min(o) AS first_row FROM r GROUP BY 1")
def dedup_unordered_units(spark, folder):
    """Orders with the same set of suppliers as one cooperation."""
    rows = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.col("l_suppkey").cast("string")).alias("units"))
    return rows.groupBy(F.array_sort("units").alias("units")).agg(F.count("*").alias("n_rows"), F.min("l_orderkey").alias("first_row"))


@query()
def cooperation_merge(spark, folder):
    """Cooperation rows made of chunks and their organisations, merged by their set of units."""
    rows = entities.cooccurrence(table(spark, folder, "entity_raw"))
    text = chunks(spark, folder).select("chunk_id", F.coalesce("content", F.lit("")).alias("content"))
    made = rows.join(text, "chunk_id").select(F.col("orgs").alias("units"), X.snippet("content", 100).alias("content"), F.array("chunk_id").alias("products_or_projects"), F.col("chunk_id").alias("source_chunk"), F.lit(0.5).alias("confidence"), F.col("chunk_id").alias("position"))
    return entities.merge_cooperation(made)


def _orgs(spark, folder) -> DataFrame:
    return table(spark, folder, "entity_raw").where("entity_type = 'ORG' and entity_name is not null").groupBy(F.col("entity_name").alias("name")).agg(F.sum("frequency").alias("frequency"))


@query(f"WITH n AS (SELECT DISTINCT entity_name AS name, regexp_replace(lower(translate(entity_name, '{_WIDE}', '{_HALF}')), '[\\s\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}\\x0B]+', '', 'g') AS k FROM entity_raw WHERE entity_type = 'ORG' AND entity_name IS NOT NULL) SELECT DISTINCT least(a.name, b.name) AS a, greatest(a.name, b.name) AS b FROM n a JOIN n b ON a.name <> b.name AND length(a.k) >= 2 AND contains(b.k, a.k)")
def org_links(spark, folder):
    """Organisations' names that are equal but for spacing and case, or of which one holds the other."""
    return entities.org_links(_orgs(spark, folder))


@query()
def org_alias_union(spark, folder):
    return entities.org_groups(_orgs(spark, folder))


# --- specifications ---------------------------------------------------------


@query(f"WITH {_SPEC} SELECT category, model FROM spec WHERE try_cast(regexp_extract(size, '([0-9.]+)', 1) AS DOUBLE) >= 25")
def spec_filter_numeric(spark, folder):
    return specs.query(spec_rows(spark, folder), condition="尺寸 >= 25cm").select("category", "model")


@query(f"WITH {_SPEC} SELECT category, model, try_cast(regexp_extract(power, '(\\d+)\\s*W', 1) AS DOUBLE) AS power FROM spec WHERE try_cast(regexp_extract(power, '(\\d+)\\s*W', 1) AS DOUBLE) <= 60")
def spec_constraints(spark, folder):
    """Models within a limit on a measure read from its text."""
    return specs.constrained(specs.measures(spec_rows(spark, folder)), {"功耗": "<=60"}).select("category", "model", "power")


@query(f"WITH {_SPEC}, q AS (SELECT 1 AS query_id, lower(min(p_type)) AS name FROM part UNION ALL SELECT 2, lower(max(p_brand)) FROM part), m AS (SELECT query_id, 0 AS level, category, series, model FROM spec JOIN q ON lower(category) = name UNION ALL SELECT query_id, 1, category, series, model FROM spec JOIN q ON lower(series) = name UNION ALL SELECT query_id, 2, category, series, model FROM spec JOIN q ON lower(model) = name) SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY query_id, model ORDER BY level, category, series) = 1")
def spec_resolve_hierarchy(spark, folder):
    """Models by the names of a category and of a series."""
    p = table(spark, folder, "part")
    names = p.agg(F.min("p_type").alias("name")).withColumn("query_id", F.lit(1)).unionByName(p.agg(F.max("p_brand").alias("name")).withColumn("query_id", F.lit(2)))
    return specs.resolve(spec_rows(spark, folder), names).drop("params")


@query(f"WITH {_SPEC}, r AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY model) AS n FROM spec) SELECT category, string_agg('- ' || model || ' (' || concat_ws(', ', '功耗: ' || power, CASE WHEN note <> '' THEN '备注: ' || note END, '尺寸: ' || size) || ')', chr(10) ORDER BY model) AS text FROM r WHERE n <= 10 GROUP BY 1")
def spec_context_top10(spark, folder):
    return specs.context(spec_rows(spark, folder))


@query(f"WITH {_SPEC} SELECT category, series, count(DISTINCT model) AS n_models, list(DISTINCT model ORDER BY model) AS models FROM spec GROUP BY ALL")
def spec_listing(spark, folder):
    return specs.listing(spec_rows(spark, folder))


@query(f"WITH {_SPEC} SELECT model, size AS a, power AS b, CASE WHEN note = '' THEN 'none' ELSE note END AS c FROM spec")
def map_fill_empty(spark, folder):
    """Empty parameters filled from other rows."""
    rows = spec_rows(spark, folder).withColumn("confidence", F.lit(0.5))
    known = rows.select("category", "series", "model", F.create_map(F.lit("备注"), F.lit("none")).alias("params"), F.lit(0.9).alias("confidence"))
    got = specs.fill_empty(rows.select("category", "series", "model", "params", "confidence"), known, ["category", "series", "model"])
    return got.select("model", F.element_at("params", "尺寸").alias("a"), F.element_at("params", "功耗").alias("b"), F.element_at("params", "备注").alias("c"))


@query("SELECT o_custkey AS k, 'old' AS part FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1 UNION ALL SELECT o_custkey, 'new' FROM orders WHERE o_orderkey % 2 = 1 AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 0) GROUP BY 1")
def incremental_merge(spark, folder):
    """Old keys stay, new ones are added."""
    o = table(spark, folder, "orders")
    part = lambda n, name: o.where(F.col("o_orderkey") % 2 == n).select(F.col("o_custkey").alias("k"), F.lit(name).alias("part")).distinct()
    return entities.add_new(part(0, "old"), part(1, "new"), ["k"])


# --- graphs -----------------------------------------------------------------


@query(f"WITH {_AL}, n AS (SELECT source AS id FROM al UNION SELECT target FROM al), e AS (SELECT source AS id FROM al WHERE source <> target UNION ALL SELECT target FROM al WHERE source <> target) SELECT n.id, count(e.id) AS link_count FROM n LEFT JOIN e USING (id) GROUP BY 1")
def link_graph_degrees(spark, folder):
    """Links in and out of each name."""
    links = alias_links(spark, folder)
    nodes = links.select(F.explode(F.array("source", "target")).alias("id"))
    return graph.degrees(links, nodes)


@query(f"WITH {_AL} SELECT DISTINCT least(source, target) AS a, greatest(source, target) AS b, 1.0 AS weight FROM al WHERE source <> target")
def undirected_edge_dedup(spark, folder):
    rows = graph.undirected(alias_links(spark, folder))
    return rows.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"), "weight")


@query(f"WITH RECURSIVE {_AL}, e AS (SELECT source AS a, target AS b FROM al WHERE source <> target UNION SELECT target, source FROM al WHERE source <> target), r(n, g) AS (SELECT a, a FROM e UNION SELECT r.n, e.b FROM r JOIN e ON r.g = e.a) SELECT n AS id, min(g) AS root FROM r GROUP BY 1")
def connected_components(spark, folder):
    links = alias_links(spark, folder)
    return graph.components(links.select(F.col("source").alias("a"), F.col("target").alias("b")))


@query()
def communities_louvain(spark, folder):
    links = alias_links(spark, folder)
    edges = cut(graph.undirected(links))
    return graph.louvain(links.select(F.explode(F.array("source", "target")).alias("id")), edges)


@query(f"WITH {_AL}, n AS (SELECT source AS id FROM al UNION SELECT target FROM al), m AS (SELECT id, left(id, 1) AS community FROM n), u AS (SELECT DISTINCT least(source, target) AS s, greatest(source, target) AS t FROM al WHERE source <> target), d AS (SELECT id, count(e) AS link_count FROM n LEFT JOIN (SELECT source AS e FROM al WHERE source <> target UNION ALL SELECT target FROM al WHERE source <> target) ON e = id GROUP BY 1), z AS (SELECT community, count(*) AS n_nodes FROM m GROUP BY 1), i AS (SELECT a.community, count(*) AS k FROM u JOIN m a ON a.id = s JOIN m b ON b.id = t WHERE a.community = b.community GROUP BY 1), o AS (SELECT community, list(id ORDER BY link_count DESC, id) AS top_nodes FROM (SELECT * FROM m JOIN d USING (id) QUALIFY row_number() OVER (PARTITION BY community ORDER BY link_count DESC, id) <= 5) GROUP BY 1) SELECT community, n_nodes, CASE WHEN n_nodes > 1 THEN round(coalesce(k, 0) / (n_nodes * (n_nodes - 1) / 2), 6) ELSE 0.0 END AS cohesion, top_nodes FROM z LEFT JOIN i USING (community) JOIN o USING (community)")
def community_cohesion(spark, folder):
    """Names by their first letter as communities: size, cohesion and best linked."""
    links = cut(alias_links(spark, folder))
    nodes = links.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    members = nodes.withColumn("community", F.substring("id", 1, 1))
    return graph.community_stats(members, graph.undirected(links), nodes.withColumn("label", F.col("id")), graph.degrees(links, nodes))


@query(f"WITH {_AL}, n AS (SELECT source AS id FROM al UNION SELECT target FROM al), e AS (SELECT source AS id FROM al WHERE source <> target UNION ALL SELECT target FROM al WHERE source <> target), d AS (SELECT n.id, count(e.id) AS link_count FROM n LEFT JOIN e USING (id) GROUP BY 1) SELECT id, link_count, round(8 + sqrt(link_count / max(link_count) OVER ()) * 20, 6) AS size FROM d")
def node_size_projection(spark, folder):
    links = alias_links(spark, folder)
    return graph.node_size(graph.degrees(links, links.select(F.explode(F.array("source", "target")).alias("id"))))
