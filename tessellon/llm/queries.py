"""The queries of the training-data problems over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellon.llm import glyphs, groups, leakage, mixture, names, neardup, neighbours, pieces, scans, subjects
from tessellon.sources.tables import table


def alias_matches(rows: DataFrame) -> DataFrame:
    """(a, b): standard_name with each of its aliases."""
    return rows.select(F.col("standard_name").alias("a"), F.explode("candidate_aliases.alias").alias("b"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Names of alias_candidates with the smallest name of their group."""
    rows = table(spark, folder, "alias_candidates")
    return groups.name_groups(alias_matches(rows), rows.select(F.col("standard_name").alias("name")))


def p1_group_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """How many groups there are of each size."""
    sizes = p1_found(spark, folder).groupBy("group_name").agg(F.count("*").alias("n_names"))
    return sizes.groupBy("n_names").agg(F.count("*").alias("n_groups"))


def tree_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """(id, vec): parents and children of documents_tree."""
    rows = table(spark, folder, "documents_tree")
    own = rows.select(F.element_at("metadata", "chunk_id").alias("id"), F.col("vector").alias("vec"))
    kids = rows.select(F.explode(F.transform("children", lambda c: F.struct(F.element_at(c["metadata"], "chunk_id").alias("id"), c["vector"].alias("vec")))).alias("c"))
    return own.unionByName(kids.select("c.id", "c.vec"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of chunks of which one is among the five most similar of the other."""
    return neighbours.nearest_pairs(tree_vectors(spark, folder))


def p3_groups(spark: SparkSession, folder: str) -> DataFrame:
    """The person or organisation of every row of entity_raw that is one or may be."""
    return names.entity_groups(table(spark, folder, "entity_raw").select("entity_id", "entity_name", "entity_type", "aliases"), table(spark, folder, "terms_seed"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of entity_ids of one person or organisation."""
    return names.group_pairs(p3_groups(spark, folder))


def edited_contents(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Classes and links of contents that share half of their runs of three tokens."""
    info = table(spark, folder, "document_info").select(F.lit("info").alias("field"), F.col("doc_id").alias("key"), F.col("content").alias("text"))
    kids = child_texts(spark, folder).select(F.lit("child").alias("field"), F.col("id").alias("key"), "text")
    return neardup.classes_and_links(info.unionByName(kids), at_least=0.5, width=3, bands=100, band_rows=4)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of contents that are one text apart from small edits."""
    return neardup.key_pairs(*edited_contents(spark, folder))


def p4_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Class, group and number of links of every content."""
    return neardup.near_groups(*edited_contents(spark, folder))


def p4_similar_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Classes, groups and links of the texts of documents, by five words and a similarity of 0.8."""
    rows = table(spark, folder, "documents").select(F.lit("text").alias("field"), F.col("doc_id").cast("string").alias("key"), "text")
    return neardup.near_groups(*neardup.classes_and_links(rows, by_script=False))


def long_items(spark: SparkSession, folder: str) -> DataFrame:
    """(field, item_key, size_limit, text): contents of document_info (limit 2,000) and children of documents_tree (500), each key once."""
    info = table(spark, folder, "document_info").where(F.length("content") > 2000).select("doc_id", "content")
    info = info.dropDuplicates(["doc_id"]).select(F.lit("info").alias("field"), F.col("doc_id").alias("item_key"), F.lit(2000).alias("size_limit"), F.col("content").alias("text"))
    kids = child_texts(spark, folder).where(F.length("text") > 500).dropDuplicates(["id"])
    return info.unionByName(kids.select(F.lit("child").alias("field"), F.col("id").alias("item_key"), F.lit(500).alias("size_limit"), "text"))


def child_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(id, text): children of documents_tree as delivered."""
    kids = table(spark, folder, "documents_tree").select(F.explode(F.transform("children", lambda c: F.struct(F.element_at(c["metadata"], "chunk_id").alias("id"), c["content"].alias("text")))).alias("c"))
    return kids.select("c.id", "c.text")


def p5_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces of every item above its limit."""
    return pieces.split(long_items(spark, folder), F.col("size_limit"), 100)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Items above their limit: those that the splitter cuts."""
    return p5_pieces(spark, folder).where("piece_no = 0 and n_pieces > 1").select("field", "item_key")


def written_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(field, item_key, text): contents of document_info and names of entity_raw, each key and text once."""
    info = table(spark, folder, "document_info").select(F.lit("content").alias("field"), F.col("doc_id").alias("item_key"), F.col("content").alias("text"))
    names = table(spark, folder, "entity_raw").select(F.lit("entity_name").alias("field"), F.col("entity_id").cast("string").alias("item_key"), F.col("entity_name").alias("text"))
    return info.unionByName(names).where("item_key is not null and text is not null")


def p6_forms(spark: SparkSession, folder: str) -> DataFrame:
    """The consistent form of every content and name."""
    return glyphs.forms(written_texts(spark, folder).dropDuplicates(["field", "item_key", "text"]))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Records that hold stand-ins or marks that can't be seen."""
    return glyphs.stand_ins(written_texts(spark, folder)).select("field", "item_key").distinct()


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """What scanning did to the contents of document_info."""
    return scans.defects(table(spark, folder, "document_info").select("doc_id", "content"))


def p7_repaired(spark: SparkSession, folder: str) -> DataFrame:
    """The contents of document_info as continuous, readable paragraphs."""
    return scans.repaired(table(spark, folder, "document_info").select("doc_id", "content"))


def p8_overlaps(spark: SparkSession, folder: str) -> DataFrame:
    """Texts of documents with the eval_items of which they hold passages, and how much of them."""
    return leakage.leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Texts that hold more than 45 % of an item in long unbroken runs."""
    return p8_overlaps(spark, folder).where("exact_share > 0.45").select("doc_id", "item_id")


def p9_uses(spark: SparkSession, folder: str) -> DataFrame:
    """The texts of the mixture of documents by mix_targets and how often each is used."""
    return mixture.mix(table(spark, folder, "documents").select("doc_id", "source", "text"), table(spark, folder, "mix_targets"))[0]


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The shares that the mixture reaches."""
    return mixture.mix(table(spark, folder, "documents").select("doc_id", "source", "text"), table(spark, folder, "mix_targets"))[1]


def p9_whole_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The shares reached when the mixture is to hold as many tokens as the listed sources have: small sources are repeated as often as they may be."""
    return mixture.mix(table(spark, folder, "documents").select("doc_id", "source", "text"), table(spark, folder, "mix_targets"), total_share=1.0)[1]


def p10_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The part of each document's sentences that deals with each area."""
    return subjects.area_shares(table(spark, folder, "documents"), table(spark, folder, "subject_areas"), table(spark, folder, "area_labels"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """Areas with about a quarter or more of a document's sentences."""
    return p10_shares(spark, folder).where("share >= 0.24").select("doc_id", "area").distinct()


def p10_make_up(spark: SparkSession, folder: str) -> DataFrame:
    """How many documents deal with each area, and the corpus's sentences weighted by document."""
    rows = p10_shares(spark, folder)
    return rows.groupBy("area").agg(F.sum(F.when(F.col("share") >= 0.24, 1).otherwise(0)).alias("n_documents"), F.round(F.sum("share"), 3).alias("document_shares"))


def queries() -> dict:
    return {"p1_found": p1_found, "p1_group_sizes": p1_group_sizes, "p2_found": p2_found, "p3_found": p3_found, "p3_groups": p3_groups, "p4_found": p4_found, "p4_groups": p4_groups, "p4_similar_documents": p4_similar_documents, "p5_found": p5_found, "p5_pieces": p5_pieces, "p6_found": p6_found, "p6_forms": p6_forms, "p7_found": p7_found, "p7_repaired": p7_repaired, "p8_found": p8_found, "p8_overlaps": p8_overlaps, "p9_uses": p9_uses, "p9_shares": p9_shares, "p9_whole_shares": p9_whole_shares, "p10_found": p10_found, "p10_shares": p10_shares, "p10_make_up": p10_make_up}


_GROUPS = """WITH RECURSIVE m AS (SELECT standard_name AS a, c.alias AS b FROM (SELECT standard_name, unnest(candidate_aliases) AS c FROM alias_candidates)),
names AS (SELECT standard_name AS n FROM alias_candidates WHERE standard_name IS NOT NULL UNION SELECT b FROM m WHERE b IS NOT NULL),
e AS (SELECT a, b FROM m WHERE a <> b UNION SELECT b, a FROM m WHERE a <> b),
r(n, g) AS (SELECT n, n FROM names UNION SELECT r.n, e.b FROM r JOIN e ON r.g = e.a), groups AS (SELECT n AS entity_name, min(g) AS group_name FROM r GROUP BY 1) """


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _GROUPS + "SELECT entity_name, group_name FROM groups",
        "p1_group_sizes": _GROUPS + "SELECT n_names, count(*) AS n_groups FROM (SELECT count(*) AS n_names FROM groups GROUP BY group_name) GROUP BY 1",
        "p5_found": "SELECT DISTINCT 'info' AS field, doc_id AS item_key FROM document_info WHERE length(content) > 2000 UNION ALL SELECT DISTINCT 'child', c.metadata['chunk_id'] FROM (SELECT unnest(children) AS c FROM documents_tree) WHERE length(c.content) > 500",
    }
