"""Entities of texts: dictionary matches, merging, aliases, co-occurrence and the graph of organisations and models."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessellon.functions import text as X
from tessellon.functions import vectors as V
from tessellon.operators import graph
from tessellon.plans.lineage import is_small

MODEL = "\\b([A-Z][0-9]{1,2}(?:\\s*[/-]\\s*[A-Z][0-9]{1,2})*)\\b"
#: Words of standard names by the type they tell, in order; a domain's own words are passed instead.
TYPE_WORDS = {"PROJECT": ["星座", "卫星", "项目", "计划"]}
#: Patterns of names of projects; a domain's own are passed instead.
PROJECTS = ("[\\u4e00-\\u9fff]{2,8}星座[一二三四五六七八九十]*号?",)


def domain_type(c, words: dict[str, list[str]] | None = None):
    """The first type of `words` of which a word stands in the name, else TECH."""
    out = F.lit("TECH")
    for kind, ws in reversed(list((words or TYPE_WORDS).items())):
        out = F.when(X.hits(c, ws, fold=False) > 0, kind).otherwise(out)
    return out


#: Terms that a dictionary held by every task may have; larger ones are joined.
MOST_TERMS = 1_000_000


def dictionary_hits(texts: DataFrame, terms: DataFrame, key: str = "chunk_id", text: str = "content", most: int = MOST_TERMS) -> DataFrame:
    """(key, standard, n): how often each standard's aliases, and the standard itself, occur in each text; case aside, overlapping occurrences count, terms of one character too.

    terms: (alias, standard). Spots are found by their first two characters,
    so the cost is that of the text, not of text times dictionary. A
    dictionary of up to `most` terms goes to the tasks; a larger one is joined
    with the spots, with the same result.
    """
    both = terms.select(F.lower("alias").alias("term"), "standard").union(terms.select(F.lower("standard"), "standard")).where("term <> ''").distinct()
    low = texts.select(key, F.lower(F.col(text)).alias("t")).where("t <> ''")
    found = _spotted(low, both, key) if is_small(both, most) else _joined_spots(low, both, key)
    return found.groupBy(key, "standard").agg(F.sum("n").alias("n"))


def _spotted(low: DataFrame, both: DataFrame, key: str) -> DataFrame:
    """(key, standard, n) with the dictionary in every task."""
    by_head: dict[int, list[tuple[str, str]]] = {}
    singles: dict[str, list[str]] = {}
    for term, standard in both.toPandas().itertuples(index=False):
        if len(term) == 1:
            singles.setdefault(term, []).append(standard)
        else:
            by_head.setdefault(ord(term[0]) << 21 | ord(term[1]), []).append((term, standard))
    heads = np.array(sorted(by_head), np.int64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            rows = []
            for k, t in zip(p[key], p["t"]):
                codes = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
                pairs = codes[:-1] << 21 | codes[1:]
                n: Counter = Counter()
                if len(heads):
                    near = np.minimum(np.searchsorted(heads, pairs), len(heads) - 1)
                    for i in np.nonzero(heads[near] == pairs)[0].tolist():
                        n.update(standard for term, standard in by_head[int(pairs[i])] if t.startswith(term, i))
                for c, standards in singles.items():
                    if m := t.count(c):
                        n.update({s: m for s in standards})
                rows += [(k, s, m) for s, m in n.items()]
            yield pd.DataFrame(rows, columns=[key, "standard", "n"])

    return low.mapInPandas(run, f"{key} {dict(low.dtypes)[key]}, standard string, n bigint")


def _joined_spots(low: DataFrame, both: DataFrame, key: str) -> DataFrame:
    """(key, standard, n) by a join of the texts' spots with a dictionary of any size."""
    two = both.where("length(term) >= 2").select(F.substring("term", 1, 2).alias("head"), "term", "standard")
    heads = two.groupBy("head").agg(F.max(F.length("term")).alias("longest"))
    longest = two.agg(F.max(F.length("term")).alias("most"))
    signs = low.crossJoin(F.broadcast(longest)).select(key, "most", X.characters("t").alias("t"))
    # a spot takes with it what the longest term can cover, not the text
    spots = signs.select(key, F.explode(F.transform(F.sequence(F.lit(1), F.size("t")), lambda i: F.array_join(F.slice("t", i, F.coalesce("most", F.lit(1))), ""))).alias("rest"))
    found = spots.withColumn("head", F.substring("rest", 1, 2)).join(heads, "head").join(two, "head").where(F.col("rest").startswith(F.col("term"))).select(key, "standard")
    single = spots.select(key, F.substring("rest", 1, 1).alias("term")).join(both.where("length(term) = 1"), "term").select(key, "standard")
    return found.unionByName(single).withColumn("n", F.lit(1))


def pattern_hits(texts: DataFrame, key: str = "chunk_id", text: str = "content", projects: tuple[str, ...] = PROJECTS) -> DataFrame:
    """(key, standard, entity_type, n): models and projects by their patterns; common abbreviations are none."""
    models = texts.select(key, F.explode(F.regexp_extract_all(F.col(text), F.lit(MODEL), F.lit(1))).alias("standard"), F.lit("PRODUCT").alias("entity_type")).where(~F.upper("standard").isin(X.ABBREVIATIONS))
    found = models
    for p in projects:
        found = found.unionByName(texts.select(key, F.explode(F.regexp_extract_all(F.col(text), F.lit(f"({p})"), F.lit(1))).alias("standard"), F.lit("PROJECT").alias("entity_type")))
    return found.groupBy(key, "standard", "entity_type").agg(F.count("*").alias("n"))


def merge(entities: DataFrame) -> DataFrame:
    """(entity_name, entity_type, frequency, source_docs, source_chunks): rows of one name and type as one, frequencies added, sources united."""
    sides = ["source_docs", "source_chunks"]
    total = entities.groupBy("entity_name", "entity_type").agg(F.sum("frequency").alias("frequency"))
    out = total
    for s in sides:
        # sources are made distinct before they are gathered, so that a hot source costs no more than one value
        one = entities.select("entity_name", "entity_type", F.explode(s).alias("x")).where("x is not null").distinct()
        got = one.groupBy("entity_name", "entity_type").agg(F.sort_array(F.collect_list("x")).alias(s))
        same = (F.col("l.entity_name").eqNullSafe(F.col("r.entity_name"))) & (F.col("l.entity_type").eqNullSafe(F.col("r.entity_type")))
        out = out.alias("l").join(got.alias("r"), same, "left").select("l.*", F.coalesce(f"r.{s}", F.array().cast("array<string>")).alias(s))
    return out


def merge_aliases(rows: DataFrame) -> DataFrame:
    """(standard_name, alias, embedding_sim): the greatest similarity of each pair; null aliases drop out."""
    flat = rows.select("standard_name", F.explode("candidate_aliases").alias("c")).select("standard_name", "c.alias", "c.embedding_sim").where("standard_name is not null and alias is not null")
    return flat.groupBy("standard_name", "alias").agg(F.max("embedding_sim").alias("embedding_sim"))


def alias_pairs(entities: DataFrame, block: str, at_least: float = 0.85) -> DataFrame:
    """(a, b, similarity): entities (id, vec, block) of one block whose cosine is at_least; every pair of a block is compared, so blocks should be small."""
    e = entities.where("vec is not null").withColumn("_n", V.norm(F.col("vec"))).where("_n > 0")
    a, b = e.select(block, F.col("id").alias("a"), F.col("vec").alias("va"), F.col("_n").alias("na")), e.select(block, F.col("id").alias("b"), F.col("vec").alias("vb"), F.col("_n").alias("nb"))
    sim = F.round(V.dot(F.col("va"), F.col("vb")) / (F.col("na") * F.col("nb")), 6)
    return a.join(b, block).where("a < b and size(va) = size(vb)").withColumn("similarity", sim).where(F.col("similarity") >= at_least).select("a", "b", "similarity")


def name_chunks(entities: DataFrame, entity_type: str) -> DataFrame:
    """(entity_name, source_chunks): all chunks of each name of a type, repeated ones kept."""
    rows = entities.where(F.col("entity_type") == entity_type).select("entity_name", F.explode("source_chunks").alias("x"))
    return rows.groupBy("entity_name").agg(F.sort_array(F.collect_list("x")).alias("source_chunks"))


def cooccurrence(entities: DataFrame, primary: str | None = None) -> DataFrame:
    """(chunk_id, orgs): chunks that name two organisations at least, `primary` among them if given."""
    pairs = entities.where("entity_type = 'ORG' and entity_name is not null").select(F.explode("source_chunks").alias("chunk_id"), "entity_name").where("chunk_id is not null").distinct()
    sets = pairs.groupBy("chunk_id").agg(F.sort_array(F.collect_list("entity_name")).alias("orgs")).where("size(orgs) >= 2")
    return sets.where(F.array_contains("orgs", primary)) if primary else sets


def cooccurring_pairs(entities: DataFrame) -> DataFrame:
    """(a, b, n_chunks): pairs of organisations by the number of chunks that name both."""
    one = entities.where("entity_type = 'ORG' and entity_name is not null").select(F.explode("source_chunks").alias("chunk_id"), "entity_name").where("chunk_id is not null").distinct()
    return one.withColumnRenamed("entity_name", "a").join(one.withColumnRenamed("entity_name", "b"), "chunk_id").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n_chunks"))


def merge_cooperation(rows: DataFrame) -> DataFrame:
    """(units, content, products, source_chunks, confidence): rows (units, content, products_or_projects, source_chunk, confidence, position) with the same set of units as one; contents follow each other unless equal to all that was gathered, the greatest confidence counts."""
    key = F.array_sort(F.array_distinct("units"))
    got = rows.withColumn("key", key).groupBy("key").agg(
        F.sort_array(F.collect_list(F.struct("position", "content", "source_chunk"))).alias("p"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("products_or_projects")))).alias("products"),
        F.max("confidence").alias("confidence"),
    )
    fold = F.aggregate("p", F.lit(""), lambda t, x: F.when(t == "", x["content"]).when((x["content"] == t) | (x["content"] == ""), t).otherwise(F.concat(t, F.lit("；"), x["content"])))
    return got.select(F.col("key").alias("units"), fold.alias("content"), "products", F.transform("p", lambda x: x["source_chunk"]).alias("source_chunks"), "confidence")


def add_new(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """old with the rows of new whose key it doesn't have."""
    return old.unionByName(new.join(old.select(*key).distinct(), key, "left_anti"), allowMissingColumns=True)


def model_chunks(models: DataFrame, entities: DataFrame, chunks: DataFrame, per_model: int = 5, limit: int = 3000) -> DataFrame:
    """(model, context): the first chunks that name each model, up to per_model and `limit` characters."""
    e = entities.where("entity_name is not null").select(F.lower("entity_name").alias("k"), F.explode("source_chunks").alias("chunk_id")).distinct()
    rows = models.select("model", F.lower("model").alias("k")).join(e, "k").join(chunks.select("chunk_id", "content"), "chunk_id")
    w = Window.partitionBy("model").orderBy("chunk_id")
    rows = rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= per_model)
    return rows.groupBy("model").agg(F.substring(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_r", "content"))), lambda x: x["content"]), "\n\n"), 1, limit).alias("context"))


def org_links(orgs: DataFrame) -> DataFrame:
    """(a, b): names of organisations that are equal in their comparing form or of which one holds the other.

    Names are indexed by the three-letter runs of their comparing form; a name
    is looked up under its own rarest run only, so a frequent run pairs
    nothing by itself.
    """
    n = orgs.select("name").distinct().withColumn("k", X.compare_form("name")).where("length(k) >= 2")
    grams = n.select("name", "k", F.explode(F.when(F.length("k") >= 3, X.trigrams("k")).otherwise(F.array("k"))).alias("g"))
    df = grams.groupBy("g").agg(F.count("*").alias("df"))
    rare = grams.join(df, "g").groupBy("name", "k").agg(F.min_by("g", F.struct("df", "g")).alias("g"))
    short = n.where("length(k) = 2").select("name", "k")
    held = rare.select(F.col("name").alias("a"), F.col("k").alias("ka"), "g").join(grams.select(F.col("name").alias("b"), F.col("k").alias("kb"), "g"), "g")
    two = n.select(F.col("name").alias("b"), F.col("k").alias("kb"), F.explode(F.transform(F.sequence(F.lit(1), F.length("k") - 1), lambda i: F.substring(F.col("k"), i, F.lit(2)))).alias("ka"))
    more = short.select(F.col("name").alias("a"), F.col("k").alias("ka")).join(two, "ka").select("a", "b")
    return held.where("a <> b and instr(kb, ka) > 0").select("a", "b").union(more.where("a <> b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def org_groups(orgs: DataFrame) -> DataFrame:
    """(name, representative): names (name, frequency) with the most frequent name they are linked with, directly or not."""
    one = orgs.groupBy("name").agg(F.sum("frequency").alias("frequency"))
    roots = graph.components(org_links(one))
    rooted = one.join(roots.withColumnRenamed("id", "name"), "name", "left").select("name", "frequency", F.coalesce("root", "name").alias("root"))
    best = rooted.groupBy("root").agg(F.max_by("name", F.struct("frequency", "name")).alias("representative"))
    return rooted.join(best, "root").select("name", "representative")


def org_nodes(groups: DataFrame, cooperation: DataFrame) -> DataFrame:
    """(id, name, names, products, cooperators): one node for each group with what its cooperation rows (units, products) say."""
    names = groups.groupBy("representative").agg(F.sort_array(F.collect_set("name")).alias("names"))
    flat = cooperation.select(F.monotonically_increasing_id().alias("row"), "units", "products").select("row", F.explode("units").alias("name"), "products", "units")
    mine = flat.join(groups, "name")
    products = mine.select("representative", F.explode("products").alias("p")).groupBy("representative").agg(F.sort_array(F.collect_set("p")).alias("products"))
    others = mine.select("representative", "name", F.explode("units").alias("o")).where("o <> name").join(groups.select(F.col("name").alias("o"), F.col("representative").alias("other")), "o", "left").select("representative", F.coalesce("other", "o").alias("other")).where("other <> representative")
    coop = others.groupBy("representative").agg(F.sort_array(F.collect_set("other")).alias("cooperators"))
    return names.join(products, "representative", "left").join(coop, "representative", "left").select(X.node_id(F.lit("ORG"), "representative", hashed=True).alias("id"), F.col("representative").alias("name"), "names", "products", "cooperators")


def cooperation_edges(cooperation: DataFrame, groups: DataFrame) -> DataFrame:
    """(source, target, content): an edge between the first two units of each row, by their groups' nodes, or by an id made of the name."""
    rows = cooperation.where("size(units) >= 2").select(F.col("units")[0].alias("u"), F.col("units")[1].alias("v"), "content")
    g = groups.select("name", "representative")
    rows = rows.join(g.select(F.col("name").alias("u"), F.col("representative").alias("ru")), "u", "left").join(g.select(F.col("name").alias("v"), F.col("representative").alias("rv")), "v", "left")
    node = lambda c: X.node_id(F.lit("ORG"), c, hashed=True)
    return rows.select(node(F.coalesce("ru", "u")).alias("source"), node(F.coalesce("rv", "v")).alias("target"), "content")


def owned_by(models: DataFrame, groups: DataFrame) -> DataFrame:
    """(model, representative): models (model, partner) with the group of the first name, in order, that the partner holds or that holds the partner."""
    m = models.select("model", "partner", X.compare_form("partner").alias("p")).where("length(p) >= 2")
    n = groups.select("name", "representative", X.compare_form("name").alias("k")).where("length(k) >= 2")
    heads = lambda rows, c: rows.withColumn("g", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda i: F.substring(F.col(c), i, F.lit(2))))))
    hit = heads(m, "p").join(heads(n, "k"), "g").where("instr(p, k) > 0 or instr(k, p) > 0")
    return hit.groupBy("model").agg(F.min_by("representative", F.struct("name", "representative")).alias("representative"))


def graph_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, kind, n): how many nodes and edges of each kind."""
    return nodes.groupBy("kind").agg(F.count("*").alias("n")).select(F.lit("node").alias("part"), "kind", "n").unionByName(edges.groupBy("kind").agg(F.count("*").alias("n")).select(F.lit("edge").alias("part"), "kind", "n"))


def partners(sets: DataFrame, primary: str) -> DataFrame:
    """(chunk_id, others) of sets (chunk_id, orgs): all organisations of a chunk but `primary`."""
    return sets.select("chunk_id", F.array_except("orgs", F.array(F.lit(primary))).alias("others")).where("size(others) > 0")
