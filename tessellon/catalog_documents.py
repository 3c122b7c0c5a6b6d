"""Further core queries, over files, texts, pages and versions, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellon.catalog import _IDX, _tok, alias_links, query
from tessellon.functions import text as X
from tessellon.operators import chunking, graph, index, queries as Q, versions, wiki
from tessellon.plans.lineage import shared_dir
from tessellon.sources import files
from tessellon.sources.tables import table
from tessellon.streaming import ingest


def _quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _hits(c: str, words: list[str], fold: bool = True) -> str:
    text = f"lower({c})" if fold else c
    return " + ".join(f"(instr({text}, '{w.lower() if fold else w}') > 0)::INT" for w in words)


# --- names and short texts --------------------------------------------------


@query("SELECT DISTINCT entity_id, entity_name, regexp_replace(entity_name, '([+\\-&|!(){}\\[\\]^\"~*?:\\\\/])', '\\\\\\1', 'g') AS escaped, regexp_replace(regexp_replace(entity_name, '([\\x{4e00}-\\x{9fa5}])([A-Za-z0-9])', '\\1 \\2', 'g'), '([A-Za-z0-9])([\\x{4e00}-\\x{9fa5}])', '\\1 \\2', 'g') AS spaced, regexp_matches(entity_name, '(?i)^[A-Z]{1,3}\\d{1,4}[A-Z]?$') AS is_model, lower(entity_type) || '_' || left(regexp_replace(entity_name, '[^a-zA-Z0-9\\x{4e00}-\\x{9fff}]', '', 'g'), 8) || '_' || left(md5(entity_name), 6) AS node FROM entity_raw")
def name_projection(spark, folder):
    """Names of entities escaped for a query language, with scripts spaced, as models and as ids of nodes."""
    rows = table(spark, folder, "entity_raw")
    return rows.select("entity_id", "entity_name", X.escape_query("entity_name").alias("escaped"), X.space_scripts("entity_name").alias("spaced"), X.is_model_name("entity_name").alias("is_model"), X.node_id("entity_type", "entity_name", hashed=True).alias("node")).distinct()


@query(f"SELECT doc_id, {_hits('content', X.META_TABLE_WORDS)} AS n_words, CASE WHEN length(content) > 2000 THEN left(content, 1600) || chr(10) || '...' || chr(10) || right(content, 400) ELSE content END AS shown FROM (SELECT DISTINCT doc_id, content FROM document_info)")
def hits_and_ends(spark, folder):
    """How many words of sign-off sheets contents hold, and long contents as their beginnings and ends."""
    rows = table(spark, folder, "document_info").select("doc_id", "content").distinct()
    return rows.select("doc_id", X.hits("content", X.META_TABLE_WORDS).alias("n_words"), X.head_and_tail("content", 2000).alias("shown"))


_LINES = "l AS (SELECT DISTINCT doc_id, trim(unnest(string_split(content, chr(10)))) AS line FROM document_info WHERE content IS NOT NULL)"


@query(f"WITH {_LINES} SELECT doc_id, line, ({' OR '.join(f'''instr(lower(line), '{w}') > 0''' for w in X.META_HEADERS)}) OR regexp_matches(line, '^\\s*\\d+(?:\\.\\d+)*\\s+\\S.+[.\\s]{{2,}}\\d{{1,4}}\\s*$|^目\\s*录\\s*$') AS meta FROM l WHERE starts_with(line, '#')")
def meta_headers(spark, folder):
    """Headings of contents and whether they head parts that say nothing, such as tables of contents."""
    rows = table(spark, folder, "document_info").select("doc_id", F.explode(F.split("content", "\n")).alias("line")).select("doc_id", F.trim("line").alias("line")).where("line like '#%'").distinct()
    return rows.select("doc_id", "line", X.is_meta_header("line").alias("meta"))


@query("WITH t AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(content, '(?is)<table[^>]*>.*?</table>')) AS t FROM document_info) SELECT doc_id, md5(t) AS table_hash, regexp_matches(lower(t), '编制|审核|批准|会签|签字|文件编号|研制单位|阶段标记|文档编号|版次|共.*页') OR length(regexp_replace(regexp_replace(regexp_replace(t, '<[^>]+>', '', 'g'), '\\s+', '', 'g'), '[|\\-:]', '', 'g')) < 5 AS meta FROM t")
def meta_tables(spark, folder):
    """Tables of contents and whether they are sign-off sheets or empty."""
    rows = table(spark, folder, "document_info").select("doc_id", F.explode(F.regexp_extract_all("content", F.lit("(?is)(<table[^>]*>.*?</table>)"), F.lit(1))).alias("t")).distinct()
    return rows.select("doc_id", F.md5("t").alias("table_hash"), X.is_meta_table("t").alias("meta"))


def _table_type_sql(c: str) -> str:
    return "CASE " + " ".join(f"WHEN {_hits(c, ws)} >= 2 THEN '{k}'" for k, ws in X.TABLE_TYPES.items()) + " END"


@query("SELECT doc_id, " + _table_type_sql("array_to_string(list_slice(string_split(trim(content, ' ' || chr(10) || chr(9) || chr(13)), chr(10)), 1, 3), '')") + " AS kind FROM (SELECT DISTINCT doc_id, content FROM document_info WHERE content IS NOT NULL)")
def table_types(spark, folder):
    """The kind of table that the first three lines of a content tell."""
    rows = table(spark, folder, "document_info").where("content is not null").select("doc_id", "content").distinct()
    return rows.select("doc_id", X.table_type("content").alias("kind"))


# --- versions of files ------------------------------------------------------

_NAMED = "n AS (SELECT p_brand AS folder, p_type || CASE p_size % 5 WHEN 0 THEN '-v1.' || (p_size % 4) || '.docx' WHEN 1 THEN '-20240' || (601 + p_size) || '.docx' WHEN 2 THEN '_终版.docx' WHEN 3 THEN '_final.pdf' ELSE '.docx' END AS filename FROM part UNION ALL SELECT p_brand, 'only ' || p_partkey || '.docx' FROM part WHERE p_partkey % 3 = 0)"
_STEM = "regexp_replace(filename, '^(.+)\\.[^.]*$', '\\1')"
_BASE = _STEM
for _p in X.VERSION_MARKS:
    _BASE = f"regexp_replace({_BASE}, '{_p}', '', 'g')"
_BASE = f"trim(regexp_replace({_BASE}, '[-_ 　]+$', ''))"
_FINAL = " OR ".join(f"instr(lower(filename), '{w.lower()}') > 0" for w in X.FINAL_MARKS)
_ORDERED = f"""{_NAMED}, d AS (SELECT DISTINCT folder, filename, {_BASE} AS base, {_STEM} <> {_BASE} AS marked, regexp_extract(filename, '[vV](\\d+(?:\\.\\d+)*)', 1) AS v, regexp_extract(filename, '(20\\d{{6}})', 1) AS dt, {_FINAL} AS fin FROM n),
o AS (SELECT *, CASE WHEN fin THEN 3 WHEN v <> '' THEN 1 WHEN dt <> '' THEN 0 ELSE 2 END AS kind FROM d),
k AS (SELECT *, CASE WHEN kind = 1 THEN list_transform(string_split(v, '.'), lambda x: x::INT) ELSE []::INT[] END AS num, CASE WHEN kind = 0 THEN dt ELSE '' END AS dd FROM o),
g AS (SELECT folder, base, list(filename ORDER BY kind, num, dd, filename) AS files FROM k WHERE base <> '' AND NOT lower(base) IN ({_quoted(X.GENERIC_NAMES)}) AND NOT ({' OR '.join(f"instr(lower(base), '{w.lower()}') > 0" for w in X.EVENT_WORDS)}) GROUP BY folder, base HAVING count(*) >= 2 AND bool_or(marked))"""


def named_files(spark, folder) -> DataFrame:
    """(folder, filename): names of files made of part, in several versions of a name."""
    size = F.col("p_size")
    tail = F.when(size % 5 == 0, F.concat(F.lit("-v1."), (size % 4).cast("string"), F.lit(".docx"))).when(size % 5 == 1, F.concat(F.lit("-20240"), (size + 601).cast("string"), F.lit(".docx"))).when(size % 5 == 2, "_终版.docx").when(size % 5 == 3, "_final.pdf").otherwise(".docx")
    rows = table(spark, folder, "part")
    return rows.select(F.col("p_brand").alias("folder"), F.concat("p_type", tail).alias("filename")).union(rows.where("p_partkey % 3 = 0").select("p_brand", F.concat(F.lit("only "), F.col("p_partkey").cast("string"), F.lit(".docx"))))


@query(f"WITH {_ORDERED} SELECT folder, base, files FROM g")
def version_chains(spark, folder):
    """Files whose names are versions of one name, oldest first."""
    return versions.name_groups(named_files(spark, folder))


@query(f"WITH {_ORDERED} SELECT folder, unnest(files) AS filename, base AS source_key FROM g")
def version_keys(spark, folder):
    """The name that stands for all versions of each file."""
    return versions.version_map(named_files(spark, folder))


@query(f"WITH {_ORDERED} SELECT DISTINCT folder, filename FROM d WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.folder = d.folder AND list_contains(g.files, d.filename))")
def version_strays(spark, folder):
    """Files that are no version of another."""
    return versions.ungrouped(named_files(spark, folder).distinct())


@query(f"WITH {_ORDERED}, m AS (SELECT folder AS dataset_id, base AS source_key, files[-1] AS filename FROM g) SELECT dataset_id, source_key, filename FROM m")
def version_last_by_name(spark, folder):
    """The last version of each file by its name."""
    rows = named_files(spark, folder).distinct()
    keyed = rows.join(versions.version_map(rows), ["folder", "filename"]).select(F.col("folder").alias("dataset_id"), "source_key", "filename")
    return index.latest_files(keyed)


# --- pages ------------------------------------------------------------------

_PAGES = "p AS (SELECT doc_id AS path, CASE WHEN length(doc_id) % 2 = 0 OR doc_id < 'c' THEN 'entity' ELSE 'odd' END AS kind, trim(min(title)) AS title, [min(file_name)] AS sources, 'About [[' || doc_id || ']] and [[x|y]].' AS body FROM document_info WHERE doc_id IS NOT NULL AND title IS NOT NULL AND NOT regexp_matches(title, '[\\n\\r\",\\[\\]]') AND file_name IS NOT NULL AND NOT regexp_matches(file_name, '[,\"\\[\\]]') GROUP BY doc_id)"


def made_pages(spark, folder) -> DataFrame:
    """(path, kind, title, sources, body): a page for each file of document_info."""
    rows = table(spark, folder, "document_info").where("doc_id is not null and title is not null and file_name is not null").where(~F.col("title").rlike('[\\n\\r",\\[\\]]') & ~F.col("file_name").rlike('[,"\\[\\]]'))
    one = rows.groupBy(F.col("doc_id").alias("path")).agg(F.trim(F.min("title")).alias("title"), F.array(F.min("file_name")).alias("sources"))
    return one.select("path", F.when((F.length("path") % 2 == 0) | (F.col("path") < "c"), "entity").otherwise("odd").alias("kind"), "title", "sources", F.concat(F.lit("About [["), F.col("path"), F.lit("]] and [[x|y]].")).alias("body"))


def rendered(spark, folder) -> DataFrame:
    none = F.array().cast("array<string>")
    return wiki.render(made_pages(spark, folder).select("path", "kind", "title", F.lit(None).cast("string").alias("created"), F.lit(None).cast("string").alias("updated"), none.alias("tags"), none.alias("related"), "sources", "body"))


@query(f"WITH {_PAGES} SELECT path, CASE WHEN kind = 'entity' THEN kind END AS kind, title, sources, body FROM p")
def page_round_trip(spark, folder):
    """Pages written with front matter and read again; an unknown kind is none."""
    return wiki.parsed(rendered(spark, folder)).select("path", "kind", "title", "sources", "body")


@query(f"WITH {_PAGES} SELECT path, [path, 'x'] AS links, title, sources AS listed FROM p")
def page_fields(spark, folder):
    """Links and front matter of pages."""
    return rendered(spark, folder).select("path", X.wiki_links("text").alias("links"), X.front_value("text", "title").alias("title"), X.front_list("text", "sources").alias("listed"))


@query(f"WITH {_PAGES} SELECT path, 'pages/' || path || '.md' AS file, '---' || chr(10) || 'title: ' || title || chr(10) || '---' || chr(10) || body AS written, title AS review, 'missing' AS kind, ['look at ' || path] AS suggestions FROM p")
def reply_blocks(spark, folder):
    """Pages and reviews read from replies of a model."""
    reply = F.concat(F.lit("Some words first.\nFILE: pages/"), F.col("path"), F.lit(".md\n---\ntitle: "), F.col("title"), F.lit("\n---\n"), F.col("body"), F.lit("\nREVIEW: "), F.col("title"), F.lit("\nType: Missing\nReason: none\n- look at "), F.col("path"), F.lit("\n"))
    replies = made_pages(spark, folder).select(F.col("path").alias("reply_id"), reply.alias("text"))
    found = wiki.file_blocks(replies).join(wiki.review_blocks(replies), "reply_id")
    return found.select(F.col("reply_id").alias("path"), F.col("path").alias("file"), F.col("body").alias("written"), F.col("title").alias("review"), "kind", "suggestions")


@query(f"WITH {_PAGES} SELECT path, '---' || chr(10) || 'title: ' || title || chr(10) || 'sources: [a, ' || sources[1] || ']' || chr(10) || '---' || chr(10) || chr(10) || 'old' || chr(10) || chr(10) || body AS text FROM p WHERE sources[1] <> 'a'")
def page_merge(spark, folder):
    """Pages that were there before, with the sources and bodies of new ones."""
    rows = made_pages(spark, folder).where("sources[0] <> 'a'")
    old = rows.select("path", F.concat(F.lit("---\ntitle: "), F.col("title"), F.lit("\nsources: [a]\n---\n\nold")).alias("text"))
    new = rows.select("path", F.concat(F.lit("---\nsources: ["), F.array_join("sources", ", "), F.lit("]\n---\n\n"), F.col("body")).alias("text"))
    return wiki.merge_pages(old, new)


@query("SELECT DISTINCT file_name AS filename FROM document_info WHERE file_name <> '' AND length(doc_id) > 0 AND doc_id < '8' AND NOT regexp_matches(file_name, '[\\n\\r]')")
def ingest_log(spark, folder):
    """Files that a log says were taken in."""
    rows = table(spark, folder, "document_info").where("file_name <> ''")
    return wiki.ingested(rows.select(F.concat(F.when(F.col("doc_id") < "8", "2024 - [ingest] ").otherwise("2024 - [query] "), F.col("file_name")).alias("line")))


@query("WITH r AS (SELECT item_id AS title, set_name AS kind, item_id % 3 = 0 AS dismissed FROM eval_items) SELECT title, kind FROM r WHERE NOT dismissed AND kind = 'heldout_facts' AND title % 5 <> 0")
def review_list(spark, folder):
    """Reviews of a kind that are open and were not removed."""
    rows = table(spark, folder, "eval_items").select(F.col("item_id").alias("title"), F.col("set_name").alias("kind"), (F.col("item_id") % 3 == 0).alias("dismissed"))
    return wiki.remove_review(wiki.pending(rows, "heldout_facts"), rows.where("title % 5 = 0").select("title")).select("title", "kind")


@query("WITH i AS (SELECT DISTINCT area AS slug, 'old' AS line FROM area_labels WHERE area < 'm'), e AS (SELECT area AS slug, 'new' AS line FROM subject_areas) SELECT * FROM i WHERE slug IS NOT NULL UNION ALL SELECT * FROM e WHERE slug NOT IN (SELECT slug FROM i WHERE slug IS NOT NULL)")
def index_page_lines(spark, folder):
    """Lines of an index page with those that it did not have."""
    old = table(spark, folder, "area_labels").where("area < 'm'").select(F.col("area").alias("slug"), F.lit("old").alias("line")).distinct()
    return wiki.index_lines(old, table(spark, folder, "subject_areas").select(F.col("area").alias("slug"), F.lit("new").alias("line")))


# --- graphs of pages --------------------------------------------------------

_GRAPH = """al AS (SELECT DISTINCT standard_name AS s, c.alias AS t FROM (SELECT standard_name, unnest(candidate_aliases) AS c FROM alias_candidates) WHERE standard_name IS NOT NULL AND c.alias IS NOT NULL AND NOT regexp_matches(standard_name || c.alias, '[\\[\\]|\\n\\r"'']') AND trim(standard_name) = standard_name AND trim(c.alias) = c.alias AND standard_name <> '' AND c.alias <> ''),
nodes AS (SELECT DISTINCT s AS id FROM al WHERE NOT starts_with(s, 'B')),
tgt AS (SELECT s, t, coalesce((SELECT id FROM nodes WHERE id = t), (SELECT min(id) FROM nodes WHERE lower(id) = lower(t)), (SELECT min(id) FROM nodes WHERE lower(id) = replace(lower(t), ' ', '-')), (SELECT min(id) FROM nodes WHERE lower(id) = replace(lower(t), '-', ' '))) AS target FROM al WHERE s IN (SELECT id FROM nodes)),
links AS (SELECT s AS source, target FROM tgt WHERE target IS NOT NULL)"""


def alias_pages(spark, folder) -> DataFrame:
    """(id, path, text): a page for each name with links to its aliases; pages of names with B are of the type that graphs hide."""
    links = alias_links(spark, folder).where(~F.concat("source", "target").rlike("[\\[\\]|\\n\\r\"']") & (F.trim("source") == F.col("source")) & (F.trim("target") == F.col("target")) & (F.col("source") != "") & (F.col("target") != ""))
    made = links.groupBy(F.col("source").alias("id")).agg(F.array_join(F.transform(F.sort_array(F.collect_set("target")), lambda t: F.concat(F.lit("[["), t, F.lit("]]"))), " ").alias("body"))
    kind = F.when(F.col("id").startswith("B"), "query").otherwise("entity")
    return made.select("id", F.concat(F.lit("pages/"), "id").alias("path"), F.concat(F.lit("---\ntitle: "), "id", F.lit("\ntype: "), kind, F.lit("\n---\n\n"), "body").alias("text"))


@query(f"WITH {_GRAPH}, e AS (SELECT source AS id FROM links WHERE source <> target UNION ALL SELECT target FROM links WHERE source <> target) SELECT n.id, n.id AS label, 'entity' AS kind, count(e.id) AS link_count FROM nodes n LEFT JOIN e USING (id) GROUP BY ALL")
def page_graph_nodes(spark, folder):
    """Nodes of the graph of pages with their links."""
    return graph.build(alias_pages(spark, folder))[0].select("id", "label", "kind", "link_count")


@query(f"WITH {_GRAPH} SELECT DISTINCT least(source, target) AS a, greatest(source, target) AS b FROM links WHERE source <> target")
def page_graph_edges(spark, folder):
    """Edges of the graph of pages, whatever their direction."""
    return graph.build(alias_pages(spark, folder))[1].select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"))


@query("WITH e AS (SELECT (l_suppkey % 50)::VARCHAR AS source, l_linenumber AS position, (l_partkey % 50)::VARCHAR AS target FROM lineitem), r AS (SELECT source, target, least(source, target) AS a, greatest(source, target) AS b, row_number() OVER (PARTITION BY least(source, target), greatest(source, target) ORDER BY source, position, target) AS n FROM e WHERE source <> target) SELECT source, target, 1.0::DOUBLE AS weight FROM r WHERE n = 1")
def edge_directions(spark, folder):
    """Pairs once each, in the direction that comes first."""
    rows = table(spark, folder, "lineitem").select((F.col("l_suppkey") % 50).cast("string").alias("source"), F.col("l_linenumber").alias("position"), (F.col("l_partkey") % 50).cast("string").alias("target"))
    return graph.undirected(rows)


@query("WITH s AS (SELECT p_brand AS community, count(*) AS n_nodes FROM part GROUP BY 1) SELECT community, n_nodes, row_number() OVER (ORDER BY n_nodes DESC, community) - 1 AS number FROM s")
def community_numbers(spark, folder):
    """Communities numbered by size."""
    return graph.numbered(table(spark, folder, "part").groupBy(F.col("p_brand").alias("community")).agg(F.count("*").alias("n_nodes")))


@query("WITH e AS (SELECT DISTINCT least(l_suppkey, l_partkey % 100) AS s, greatest(l_suppkey, l_partkey % 100) AS t FROM lineitem WHERE l_suppkey <> l_partkey % 100), m AS (SELECT count(*)::DOUBLE AS m, sum((s % 7 = t % 7)::INT)::DOUBLE AS inside FROM e), d AS (SELECT c, count(*)::DOUBLE AS d FROM (SELECT s % 7 AS c FROM e UNION ALL SELECT t % 7 FROM e) GROUP BY 1) SELECT round(inside / m - (SELECT sum(d * d) FROM d) / (4.0 * m * m), 6) AS modularity FROM m")
def split_modularity(spark, folder):
    """How well a split of a graph fits it."""
    one = table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("x"), (F.col("l_partkey") % 100).alias("y")).where("x <> y")
    edges = one.select(F.least("x", "y").alias("source"), F.greatest("x", "y").alias("target")).distinct().withColumn("weight", F.lit(1.0))
    nodes = edges.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    return graph.modularity(nodes.withColumn("community", F.col("id") % 7), edges)


# --- the index, again -------------------------------------------------------


@query("WITH h AS (SELECT *, minute(ingested_at) % 2 = 1 AS late FROM chunks), n AS (SELECT *, row_number() OVER (PARTITION BY chunk_id, late ORDER BY ingested_at DESC NULLS LAST, created_at DESC NULLS LAST, content ASC NULLS LAST) AS r FROM h WHERE late IS NOT NULL) SELECT chunk_id, max_by(content, late::INT) AS content FROM (SELECT chunk_id, late, coalesce(content, '') AS content FROM n WHERE r = 1) GROUP BY 1")
def upsert_twice(spark, folder):
    """The index after a delivery of the rows of even minutes and one of those of odd minutes."""
    rows = table(spark, folder, "chunks").withColumn("late", F.minute("ingested_at") % 2 == 1)
    first = index.upsert(rows.limit(0), rows.where("not late"))
    return index.upsert(first, rows.where("late")).select("chunk_id", F.coalesce("content", F.lit("")).alias("content"))


@query("SELECT chunk_id, content FROM chunks WHERE chunk_id IN (SELECT chunk_id FROM chunks WHERE chunk_type = 'summary')")
def index_get(spark, folder):
    """Chunks by their ids."""
    rows = table(spark, folder, "chunks")
    return index.get(rows, rows.where("chunk_type = 'summary'").select("chunk_id")).select("chunk_id", "content")


@query("SELECT doc_id, doc_title, NULL::VARCHAR AS owner FROM (SELECT DISTINCT doc_id, doc_title FROM chunks)")
def index_schema(spark, folder):
    """Rows in a schema that has gained a column."""
    rows = table(spark, folder, "chunks").select("doc_id", "doc_title").distinct()
    return index.aligned(rows, "doc_id string, doc_title string, owner string")


@query("WITH s AS (SELECT DISTINCT chunk_id FROM chunks WHERE chunk_type = 'parent'), f AS (SELECT DISTINCT coalesce(parent_id, chunk_id) AS chunk_id FROM chunks) SELECT chunk_id FROM s UNION ALL SELECT chunk_id FROM f WHERE chunk_id IS NOT NULL AND chunk_id NOT IN (SELECT chunk_id FROM s)")
def accumulate_chunks(spark, folder):
    """Chunks gathered so far with those that are new."""
    from tessellon.operators import retrieval

    rows = table(spark, folder, "chunks")
    seen = rows.where("chunk_type = 'parent'").select("chunk_id").distinct()
    return retrieval.accumulate(seen, rows.select(F.coalesce("parent_id", "chunk_id").alias("chunk_id")).where("chunk_id is not null"))


@query(f"WITH {_IDX} SELECT chunk_id, doc_id, content FROM idx")
def stream_upsert(spark, folder):
    """The index that a stream of all deliveries leaves."""
    import uuid

    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    rows = spark.read.parquet(f"{folder}/chunks.parquet")
    arrivals = spark.readStream.schema(rows.schema).parquet(f"{folder}/chunks.parque[t]")
    ingest.ingest_chunks(arrivals, f"{at}/index", f"{at}/checkpoint").awaitTermination()
    return ingest.read_index(spark, f"{at}/index").select("chunk_id", "doc_id", "content")


@query("WITH t AS (SELECT entity_name, entity_type, sum(frequency)::BIGINT AS frequency FROM entity_raw GROUP BY ALL), s AS (SELECT entity_name, entity_type, count(DISTINCT x) AS n_docs FROM (SELECT entity_name, entity_type, unnest(source_docs) AS x FROM entity_raw) WHERE x IS NOT NULL GROUP BY ALL) SELECT t.*, coalesce(s.n_docs, 0)::INT AS n_docs FROM t LEFT JOIN s ON t.entity_name IS NOT DISTINCT FROM s.entity_name AND t.entity_type IS NOT DISTINCT FROM s.entity_type")
def stream_entities(spark, folder):
    """Entities that a stream of all rows has merged."""
    import uuid

    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    rows = spark.read.parquet(f"{folder}/entity_raw.parquet")
    arrivals = spark.readStream.schema(rows.schema).parquet(f"{folder}/entity_raw.parque[t]")
    ingest.merge_entities(arrivals, f"{at}/entities", f"{at}/checkpoint").awaitTermination()
    return ingest.read_state(spark, f"{at}/entities").select("entity_name", "entity_type", "frequency", F.size("source_docs").alias("n_docs"))


@query("SELECT metadata['chunk_id'] AS chunk_id, content, len(coalesce(children, [])) AS n_children, list_sum(list_transform(coalesce(children, []), lambda c: coalesce(length(c.content), 0)))::BIGINT AS n_signs FROM documents_tree")
def documents_round_trip(spark, folder):
    """Nested documents written without vectors and read again."""
    import uuid

    at = f"{shared_dir(spark)}/documents-{uuid.uuid4().hex}"
    tree = table(spark, folder, "documents_tree")
    files.write_documents(tree, at)
    back = files.read_documents(spark, at, tree)
    n = F.aggregate(F.coalesce("children", F.slice("children", 1, 0)), F.lit(0).cast("bigint"), lambda s, c: s + F.coalesce(F.length(c["content"]), F.lit(0)))
    return back.select(F.element_at("metadata", "chunk_id").alias("chunk_id"), "content", F.coalesce(F.when(F.col("children").isNotNull(), F.size("children")), F.lit(0)).alias("n_children"), F.when(F.coalesce(F.size("children"), F.lit(0)) > 0, n).alias("n_signs"))


# --- chunks' texts ----------------------------------------------------------


@query("WITH s AS (SELECT doc_id, chunk_id, summary FROM chunks WHERE chunk_type = 'parent' AND summary <> '' AND doc_id IS NOT NULL) SELECT doc_id, doc_id || '_ds0' AS chunk_id, string_agg(summary, chr(10) ORDER BY chunk_id, summary) AS content FROM s GROUP BY 1 HAVING count(*) >= 2 AND sum(length(summary)) >= 50")
def document_summaries(spark, folder):
    """A summary for each document made of its parents' summaries."""
    rows = table(spark, folder, "chunks").where("chunk_type = 'parent' and doc_id is not null")
    return chunking.document_summaries(rows.select("doc_id", "chunk_id", "summary"))


_SENT = "s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([。！？.!?])[ \\t\\n\\r\\f\\x0B\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+', '\\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS s FROM documents)"


@query(f"WITH {_SENT}, u AS (SELECT doc_id, unnest(range(0, len(s))) AS i, unnest(s) AS x FROM s) SELECT doc_id, (i // 3)::INT AS group_no, string_agg(x, ' ' ORDER BY i) AS text FROM u GROUP BY ALL")
def sentence_groups(spark, folder):
    """Sentences in groups of three."""
    return chunking.sentence_groups(table(spark, folder, "documents").select("doc_id", F.col("text").alias("content")))


# --- questions --------------------------------------------------------------


def _without_question(c: str) -> str:
    one = f"regexp_replace({c}, '(?i){Q.QUESTION_ZH}', '', 'g')"
    two = f"regexp_replace(regexp_replace({one}, '(?i){Q.QUESTION_EN.replace(chr(39), chr(39) * 2)}', ' ', 'g'), '(?i){Q.FILLERS_EN.replace(chr(39), chr(39) * 2)}', ' ', 'g')"
    return f"CASE WHEN trim({two}) = '' THEN {c} ELSE {two} END"


@query(f"SELECT item_id, {_without_question('text')} AS text FROM eval_items")
def questions_stripped(spark, folder):
    """Texts without question phrases and fillers."""
    return table(spark, folder, "eval_items").select("item_id", Q.without_question("text").alias("text"))


@query(f"WITH t AS (SELECT DISTINCT unnest({_tok('text')}) AS term FROM eval_items) SELECT term, CASE WHEN term IN ({_quoted(Q.STOP_WORDS)}) THEN false WHEN regexp_matches(term, '(?i)^[A-Z]{{1,3}}\\d{{1,4}}[A-Z]?$') THEN true WHEN term IN ({_quoted(Q.SERIES)}) THEN true WHEN regexp_matches(term, '^[\\x{{4e00}}-\\x{{9fff}}]$|^[a-z]$|^\\d{{1,2}}$') THEN false ELSE term <> '' END AS kept FROM t")
def tokens_kept(spark, folder):
    """Tokens of texts and whether they may be keywords."""
    return table(spark, folder, "eval_items").select(F.explode(X.tokens("text")).alias("term")).distinct().select("term", Q.keep_token(F.col("term")).alias("kept"))


# --- cleaning, whole --------------------------------------------------------


def _squeezed(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '\\n{{3,}}', chr(10) || chr(10), 'g'), '[\\t\\f\\r \\x{{00a0}}\\x{{1680}}\\x{{180e}}\\x{{2000}}-\\x{{200a}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]{{2,}}', ' ', 'g')"


_STRIP = "regexp_replace({0}, '^[\\s\\x0B\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+|[\\s\\x0B\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+$', '', 'g')"


def _clean_sql() -> str:
    """The cleaning steps one after another over document_info.content."""
    steps = [
        "regexp_replace(replace(replace(content, '<|', '<'), '|>', '>'), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F\\x{FFFE}]', '', 'g')",
        _squeezed("t"),
        "regexp_replace(regexp_replace(t, '!\\[[^\\n]*?\\]\\(https?://[^)]+\\)', '', 'g'), '(\\[[^\\]]*\\]\\(https?://[^)]+\\))|[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\\.[a-zA-Z0-9-.]+|https?://\\S+', '\\1', 'g')",
        "regexp_replace(regexp_replace(t, '!\\[[^\\]]*\\]\\([^)]*\\)', '', 'g'), '(?i)<img[^>]*>', '', 'g')",
        f"list_reduce(list_prepend(t, list_filter(regexp_extract_all(t, '(?is)((?:<table[^>]*>.*?</table>\\s*)+)', 1), lambda g: len(string_split(lower(g), '<tr')) - 1 <= 20 AND ({_hits('g', X.META_TABLE_WORDS)}) >= 2)), lambda a, g: replace(a, g, ''))",
    ]
    for p in X.HEADER_FOOTER:
        flags = "(?i)" if p.startswith("(?i") else "(?m)" if p.startswith("(?m") else ""
        bare = p[p.index(")") + 1 :] if p.startswith("(?") and p[2] != ":" else p
        steps.append(f"regexp_replace(t, '{flags}{bare}', '', 'g')")
    steps += [_squeezed("t"), f"regexp_replace(t, '{X.TOC_LINE}', '', 'g')", _squeezed("t"), _STRIP.format("t")]
    ctes = [f"c0 AS (SELECT DISTINCT doc_id, content, {steps[0]} AS t FROM document_info)"]
    ctes += [f"c{i} AS (SELECT doc_id, content, {s} AS t FROM c{i - 1})" for i, s in enumerate(steps[1:], 1)]
    return f"WITH {', '.join(ctes)} SELECT doc_id, CASE WHEN content = '' THEN content ELSE t END AS text FROM c{len(steps) - 1}"


@query(_clean_sql())
def clean_contents(spark, folder):
    """All cleaning steps over each different content."""
    return table(spark, folder, "document_info").select("doc_id", "content").distinct().select("doc_id", X.clean("content").alias("text"))


def _kinds_sql() -> str:
    suffix = "lower(regexp_extract(file_name, '(\\.[^./\\\\]+)$', 1))"
    stem = "regexp_replace(regexp_extract(file_name, '([^/\\\\]*)$', 1), '^(.+)\\.[^.]*$', '\\1')"
    base = stem
    for p in X.VERSION_MARKS:
        base = f"regexp_replace({base}, '{p}', '', 'g')"
    base = f"trim(regexp_replace({base}, '[-_ \u3000]+$', ''))"
    kinds = " ".join(f"WHEN {_hits('file_name', ws)} > 0 THEN '{k}'" for k, ws in X.DOC_TYPES.items())
    formats = " ".join(f"WHEN {suffix} = '{k}' THEN '{v}'" for k, v in X.FORMATS.items())
    rules = "len(list_filter(string_split(content, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13)) IN ('---', '***', '___')))"
    slug = "regexp_replace(regexp_replace(regexp_replace(lower(trim(file_name)), '[^\\p{L}\\p{M}\\p{N}\\p{Pc}\\s-]', '', 'g'), '[-\\s]+', '-', 'g'), '^-+|-+$', '', 'g')"
    return f"SELECT DISTINCT doc_id, file_name, CASE {formats} ELSE 'unknown' END AS format, CASE {kinds} ELSE '其他' END AS kind, {base} AS base, {stem} <> {base} AS versioned, CASE WHEN {rules} > 0 THEN {rules} + 1 ELSE greatest(1, len(string_split(content, chr(10))) // 50) END::INT AS pages, {slug} AS slug FROM document_info WHERE file_name IS NOT NULL AND content IS NOT NULL"


@query(_kinds_sql())
def file_facts(spark, folder):
    """Format, kind, base name, pages by estimate and slug of every named file that has a content."""
    rows = table(spark, folder, "document_info").where("file_name is not null and content is not null").select("doc_id", "file_name", "content").distinct()
    return rows.select("doc_id", "file_name", X.file_format("file_name").alias("format"), X.doc_type("file_name").alias("kind"), X.base_name("file_name").alias("base"), X.is_versioned("file_name").alias("versioned"), X.page_estimate("content").cast("int").alias("pages"), X.slug("file_name").alias("slug")).distinct()


# --- parts of contents ------------------------------------------------------


@query(r"""WITH d AS (SELECT DISTINCT doc_id, content FROM document_info WHERE content <> ''), l AS (SELECT doc_id, content, unnest(range(0, len(w))) AS i, unnest(w) AS line FROM (SELECT doc_id, content, string_split(content, chr(10)) AS w FROM d)),
f AS (SELECT *, sum(regexp_matches(line, '^\s*(```|~~~)')::INT) OVER (PARTITION BY doc_id, content ORDER BY i) % 2 = 1 AS fenced FROM l),
h AS (SELECT *, NOT fenced AND regexp_matches(line, '^\s{0,3}#{1,3}\s+.*\S\s*$') AS head FROM f),
n AS (SELECT *, CASE WHEN head THEN len(regexp_extract(line, '(#{1,3})\s', 1)) END AS level, regexp_extract(line, '^\s{0,3}#{1,3}\s+(.*\S)\s*$', 1) AS title, sum(head::INT) OVER (PARTITION BY doc_id, content ORDER BY i) AS s, sum((trim(line) <> '')::INT) OVER (PARTITION BY doc_id, content ORDER BY i) AS seen FROM h),
p AS (SELECT *, last_value(CASE WHEN level = 1 THEN i END IGNORE NULLS) OVER w AS i1, last_value(CASE WHEN level = 2 THEN i END IGNORE NULLS) OVER w AS i2, last_value(CASE WHEN level = 3 THEN i END IGNORE NULLS) OVER w AS i3, last_value(CASE WHEN level = 1 THEN title END IGNORE NULLS) OVER w AS t1, last_value(CASE WHEN level = 2 THEN title END IGNORE NULLS) OVER w AS t2, last_value(CASE WHEN level = 3 THEN title END IGNORE NULLS) OVER w AS t3 FROM n WHERE seen > 0 WINDOW w AS (PARTITION BY doc_id, content ORDER BY i)),
b AS (SELECT doc_id, content, s, coalesce(any_value(t1), '') AS h1, coalesce(any_value(CASE WHEN i2 > coalesce(i1, -1) THEN t2 END), '') AS h2, coalesce(any_value(CASE WHEN i3 > coalesce(greatest(i1, i2), -1) THEN t3 END), '') AS h3, trim(string_agg(line, chr(10) ORDER BY i), ' ' || chr(10) || chr(9) || chr(13) || chr(12) || chr(11) || chr(160) || chr(12288)) AS body FROM p GROUP BY ALL)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id, content ORDER BY s) - 1 AS section_no, h1, h2, h3, body FROM b WHERE body <> ''""")
def heading_sections(spark, folder):
    """The stretches of contents between headings with their paths."""
    return chunking.sections(table(spark, folder, "document_info").where("content <> ''").select("doc_id", "content").distinct())


@query(r"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(content, '(?is)<table[^>]*>.*?</table>')) AS html FROM (SELECT DISTINCT doc_id, content FROM document_info)),
c AS (SELECT doc_id, html, list_filter(list_transform(regexp_extract_all(html, '(?is)<tr[^>]*>(.*?)</tr>', 1), lambda r: list_transform(regexp_extract_all(r, '(?is)<t[dh][^>]*>(.*?)</t[dh]>', 1), lambda x: replace(trim(regexp_replace(regexp_replace(x, '<[^>]+>', '', 'g'), '\s+', ' ', 'g')), '|', '\|'))), lambda r: len(r) > 0) AS rows FROM t WHERE NOT regexp_matches(html, '(?i)(row|col)span')),
w AS (SELECT *, list_max(list_transform(rows, lambda r: len(r))) AS width FROM c WHERE len(rows) > 0),
m AS (SELECT *, list_transform(rows, lambda r: '| ' || array_to_string(list_concat(r, list_transform(range(0, width - len(r)), lambda i: '')), ' | ') || ' |') AS lines FROM w)
SELECT doc_id, html, array_to_string(list_concat([lines[1], '|' || repeat(' --- |', width::INT)], lines[2:]), chr(10)) AS markdown FROM m""")
def tables_markdown(spark, folder):
    """HTML tables without spans as Markdown."""
    rows = table(spark, folder, "document_info").select("doc_id", "content").distinct()
    return chunking.tables_of(rows).where("not html rlike '(?i)(row|col)span'")


# --- replies, caches, trees -------------------------------------------------


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 4 THEN NULL ELSE '{\"id\": ' || doc_id || '}' END AS found FROM documents")
def json_replies(spark, folder):
    """The object in replies that hold one plainly, in a fence, among words, with a comma too many, or not at all."""
    one = F.concat(F.lit('{"id": '), F.col("doc_id").cast("string"), F.lit("}"))
    n = F.col("doc_id") % 5
    reply = F.when(n == 0, one).when(n == 1, F.concat(F.lit("Here:\n```json\n"), one, F.lit("\n```\n"))).when(n == 2, F.concat(F.lit("It is "), one, F.lit(", I think"))).when(n == 3, F.replace(one, F.lit("}"), F.lit(",}"))).otherwise("none at all")
    return table(spark, folder, "documents").select("doc_id", X.json_text(reply).alias("found"))


@query("SELECT doc_id, file_name AS filename, k.source_key FROM (SELECT DISTINCT doc_id, file_name FROM document_info WHERE file_name IS NOT NULL) LEFT JOIN (SELECT file_name AS f, min(title) AS source_key FROM document_info WHERE doc_id < '8' AND file_name IS NOT NULL AND title IS NOT NULL GROUP BY 1) k ON k.f = file_name")
def source_keys(spark, folder):
    """Files with the name that stands for all their versions, where one is known."""
    rows = table(spark, folder, "document_info").where("file_name is not null")
    known = rows.where("doc_id < '8' and title is not null").select(F.col("file_name").alias("filename"), F.col("title").alias("source_key"))
    return files.with_source_keys(rows.select("doc_id", F.concat(F.lit("a/b/"), "file_name").alias("relative")).distinct(), known).select("doc_id", "filename", "source_key")


@query("SELECT DISTINCT doc_id FROM document_info WHERE content IS NOT NULL AND sha256(content) NOT IN (SELECT sha256(content) FROM document_info WHERE content IS NOT NULL AND doc_id < '8')")
def files_to_convert(spark, folder):
    """Files whose content no cache knows."""
    rows = table(spark, folder, "document_info").where("content is not null").select("doc_id", "content").distinct()
    cache = rows.where("doc_id < '8'").select(F.sha2("content", 256).alias("content_hash"))
    return files.not_cached(rows, cache).select("doc_id").distinct()


@query("WITH s AS (SELECT doc_id AS f, min(content) AS c FROM document_info WHERE content IS NOT NULL GROUP BY 1) SELECT f AS filename FROM s WHERE NOT (f < 'c' AND f >= '4')")
def files_to_take_in(spark, folder):
    """Files that are new, have changed, or whose page is gone."""
    rows = table(spark, folder, "document_info").where("content is not null").groupBy(F.col("doc_id").alias("filename")).agg(F.min("content").alias("content"))
    # of the files before c the cache has the hash, but the pages of those before 4 are gone
    cache = rows.where("filename < 'c'").select("filename", F.sha2("content", 256).alias("hash"), F.array(F.concat(F.lit("pages/"), "filename")).alias("files_written"))
    pages = rows.where("filename >= '4'").select(F.concat(F.lit("pages/"), "filename").alias("path"))
    return files.cached_changes(rows, cache, pages).select("filename")


@query("WITH p AS (SELECT DISTINCT p_type || '/' || p_brand || '/' || p_partkey || '.md' AS path FROM part) SELECT path, string_split(path, '/')[-1] AS name, 2 AS depth FROM p")
def tree_files(spark, folder):
    """The Markdown files of a nested tree of folders."""
    rows = table(spark, folder, "part")
    leaf = lambda c: F.struct(F.concat(c, F.lit(".md")).alias("name"), F.lit(False).alias("is_dir"))
    inner = rows.groupBy("p_type", "p_brand").agg(F.collect_list(leaf(F.col("p_partkey").cast("string"))).alias("children"))
    nodes = inner.select(F.concat("p_type", F.lit("/"), "p_brand").alias("parent"), F.explode("children").alias("c")).select("parent", "c.name", "c.is_dir")
    dirs = inner.select(F.col("p_type").alias("parent"), F.col("p_brand").alias("name"), F.lit(True).alias("is_dir")).union(inner.select(F.lit(""), "p_type", F.lit(True)).distinct())
    return wiki.flat_tree(nodes.unionByName(dirs))
