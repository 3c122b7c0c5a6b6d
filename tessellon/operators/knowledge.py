"""From chunks to a graph of entities: recognition, normal terms, filled parameters, cooperations, and the graph's nodes and edges."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellon.functions import text as X
from tessellon.operators import entities, specs
from tessellon.plans.lineage import keep


def normalise_terms(texts: DataFrame, terms: DataFrame, text: str = "content", whole_words: bool = False) -> DataFrame:
    """texts with the aliases of terms (alias, standard) in `text` put to their standards, from the left, the longest match first, case aside; standards stand for themselves. whole_words: only where no letter or digit adjoins. The dictionary is a vocabulary that goes to every task."""
    known: dict[str, str] = {}
    for r in terms.where("alias <> '' and standard <> ''").groupBy(F.lower("alias").alias("a")).agg(F.min("standard").alias("s")).toLocalIterator():
        known[r["a"]] = r["s"]
    for s in sorted(set(known.values())):
        known[s.lower()] = s
    pattern = "|".join(re.escape(k) for k in sorted(known, key=lambda k: (-len(k), k)))
    if not pattern:
        return texts
    edge = r"(?<![^\W_])(?:{})(?![^\W_])" if whole_words else "{}"

    @F.pandas_udf("string")
    def put(column: pd.Series) -> pd.Series:
        found = re.compile(edge.format(pattern), re.I)
        return column.map(lambda t: None if t is None else found.sub(lambda m: known.get(m[0].lower(), m[0]), t))

    return texts.withColumn(text, put(F.col(text)))


def recognise(texts: DataFrame, recogniser: Callable[[str], list[dict]], key: str = "chunk_id", text: str = "content") -> DataFrame:
    """(key, entity_name, entity_type) that recogniser(text) -> [{name, type}] finds; entries without a name or type drop out, and a text on which it fails has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            rows = []
            for k, t in zip(p[key], p[text]):
                try:
                    found = recogniser(t)
                except Exception:  # noqa: BLE001 - one text does not stop the rest
                    found = []
                rows += [(k, str(f["name"]).strip(), str(f["type"])) for f in found or [] if f.get("name") and f.get("type") and str(f["name"]).strip()]
            yield pd.DataFrame(rows, columns=[key, "entity_name", "entity_type"])

    return texts.where(F.col(text) != "").select(key, text).mapInPandas(run, f"{key} {dict(texts.dtypes)[key]}, entity_name string, entity_type string")


def entities_of(chunks: DataFrame, terms: DataFrame, recogniser: Callable[[str], list[dict]] | None = None, words: dict[str, list[str]] | None = None) -> DataFrame:
    """(entity_name, entity_type, frequency, source_docs, source_chunks) of chunks (chunk_id, doc_id, content): by dictionary, by patterns and by a recogniser, merged by name and type."""
    known = entities.dictionary_hits(chunks, terms).select("chunk_id", F.col("standard").alias("entity_name"), entities.domain_type("standard", words).alias("entity_type"), "n")
    found = known.unionByName(entities.pattern_hits(chunks).select("chunk_id", F.col("standard").alias("entity_name"), "entity_type", "n"))
    if recogniser is not None:
        found = found.unionByName(recognise(chunks, recogniser).groupBy("chunk_id", "entity_name", "entity_type").agg(F.count("*").alias("n")))
    rows = found.join(chunks.select("chunk_id", "doc_id").distinct(), "chunk_id")
    return entities.merge(rows.select("entity_name", "entity_type", F.col("n").alias("frequency"), F.array("doc_id").alias("source_docs"), F.array("chunk_id").alias("source_chunks")))


def alias_candidates(found: DataFrame, embed: Callable[[pd.Series], pd.Series], at_least: float = 0.85) -> DataFrame:
    """(standard_name, candidate_aliases): for each entity the names of its type that lie close to it, the more frequent name being the standard."""
    one = keep(found.where("entity_name is not null").groupBy("entity_type", "entity_name").agg(F.sum("frequency").alias("frequency")).withColumn("vec", F.pandas_udf(embed, "array<float>")("entity_name")))
    pairs = entities.alias_pairs(one.select(F.struct((-F.col("frequency")).alias("f"), F.col("entity_name").alias("name")).alias("id"), "vec", F.coalesce("entity_type", F.lit("")).alias("block")), "block", at_least)
    listed = pairs.groupBy(F.col("a.name").alias("standard_name")).agg(F.sort_array(F.collect_list(F.struct(F.col("b.name").alias("alias"), F.col("similarity").alias("embedding_sim")))).alias("candidate_aliases"))
    return listed


def fill_parameters(models: DataFrame, contexts: DataFrame, extract: Callable[[str, str, list[str]], dict], fields: list[str]) -> DataFrame:
    """(category, series, model, params, confidence): models (category, series, model, params) whose empty `fields` extract(model, context, fields) fills from contexts (model, context); what is filled already stays."""
    missing = models.join(contexts, "model").withColumn("asked", F.filter(F.array(*[F.lit(f) for f in fields]), lambda f: F.coalesce(F.try_element_at("params", f), F.lit("")) == ""))
    asked = missing.where("size(asked) > 0")

    @F.pandas_udf("map<string,string>")
    def ask(model: pd.Series, context: pd.Series, wanted: pd.Series) -> pd.Series:
        def one(m: str, c: str, w) -> dict:
            try:
                got = extract(m, c, list(w)) or {}
            except Exception:  # noqa: BLE001 - nothing is filled then
                got = {}
            return {k: str(v) for k, v in got.items() if k in set(w) and v not in (None, "")}

        return pd.Series([one(*x) for x in zip(model, context, wanted)])

    found = asked.select("category", "series", "model", ask("model", "context", "asked").alias("params"), F.lit(0.8).alias("confidence"))
    return specs.fill_empty(models.withColumn("confidence", F.lit(1.0)), found, ["category", "series", "model"])


def cooperations(candidates: DataFrame, chunks: DataFrame, extract: Callable[[str, list[str]], list[dict]]) -> DataFrame:
    """Cooperation rows that extract(content, organisations) -> [{units, content, products_or_projects, confidence}] reads from chunks with several organisations (chunk_id, orgs), merged by their set of units; rows of fewer than two units drop out."""
    schema = "units array<string>, content string, products_or_projects array<string>, source_chunk string, confidence double, position string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            rows = []
            for chunk, orgs, content in zip(p["chunk_id"], p["orgs"], p["content"]):
                try:
                    found = extract(content, list(orgs)) or []
                except Exception:  # noqa: BLE001 - one chunk does not stop the rest
                    found = []
                for i, f in enumerate(found):
                    units = [u for u in f.get("units") or [] if u]
                    if len(set(units)) >= 2:
                        rows.append((units, f.get("content") or "", list(f.get("products_or_projects") or []), chunk, float(f.get("confidence") or 0.5), f"{chunk}#{i:04d}"))
            yield pd.DataFrame(rows, columns=["units", "content", "products_or_projects", "source_chunk", "confidence", "position"])

    made = candidates.join(chunks.select("chunk_id", "content").where("content <> ''"), "chunk_id").select("chunk_id", "orgs", "content").mapInPandas(run, schema)
    return entities.merge_cooperation(made)


def model_nodes(models: DataFrame) -> DataFrame:
    """(id, name, category, series, filled) of models (category, series, model, params): the names of the parameters that have a value."""
    filled = F.array_sort(F.map_keys(F.map_filter("params", lambda k, v: v != "")))
    return models.select(X.node_id(F.lit("MODEL"), "model", hashed=True).alias("id"), F.col("model").alias("name"), "category", "series", filled.alias("filled"))


def assemble(groups: DataFrame, cooperation: DataFrame, models: DataFrame, owners: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the whole graph: organisations and models (id, kind, name), cooperations and ownerships (source, target, kind, content).

    groups: (name, representative); cooperation: (units, content, products);
    models: (category, series, model, params); owners: (model, representative).
    """
    org = entities.org_nodes(groups, cooperation).select("id", F.lit("ORG").alias("kind"), "name")
    nodes = org.unionByName(model_nodes(models).select("id", F.lit("MODEL").alias("kind"), "name"))
    edges = entities.cooperation_edges(cooperation, groups).select("source", "target", F.lit("COOPERATION").alias("kind"), "content")
    owned = owners.select(X.node_id(F.lit("MODEL"), "model", hashed=True).alias("source"), X.node_id(F.lit("ORG"), "representative", hashed=True).alias("target"), F.lit("OWNED_BY").alias("kind"), F.lit(None).cast("string").alias("content"))
    return nodes.dropDuplicates(["id"]), edges.unionByName(owned)


def save(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Both tables as JSON lines below path."""
    nodes.write.mode("overwrite").json(f"{path}/nodes")
    edges.write.mode("overwrite").json(f"{path}/edges")


def load(spark, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) that save wrote."""
    return spark.read.schema("id string, kind string, name string").json(f"{path}/nodes"), spark.read.schema("source string, target string, kind string, content string").json(f"{path}/edges")
