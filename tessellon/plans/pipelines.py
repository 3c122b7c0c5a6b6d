"""Whole runs: ingest of files and batch search."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellon.functions import interfaces
from tessellon.functions import text as X
from tessellon.operators import chunking, entities, generation, index, knowledge, queries, retrieval
from tessellon.plans.lineage import keep
from tessellon.sources import files


def ingest(scanned: DataFrame, cache: DataFrame | None = None, versions: DataFrame | None = None, embed: Callable[[pd.Series], pd.Series] | None = None) -> DataFrame:
    """Index rows of scanned files (files.scan): converted, cleaned, chunked, embedded; the last version of each source_key is marked latest. Files whose hash the cache has are left out."""
    rows = files.not_cached(scanned, cache) if cache is not None else scanned
    rows = files.with_source_keys(rows, versions) if versions is not None else rows.withColumn("filename", F.regexp_extract("relative", "([^/]*)$", 1)).withColumn("source_key", F.lit(None).cast("string"))
    text = files.to_markdown(rows).where("status = 'ok'")
    # a text is a document of each dataset that has it; of equal files of one dataset the first by name counts
    docs = rows.join(text.select("path", "markdown"), "path").withColumn("doc_id", X.short_hash(F.concat_ws("\n", "dataset_id", "markdown")))
    docs = index.newest(docs.select("doc_id", "markdown", "dataset_id", "source_key", "filename", "path"), "doc_id", [F.col("filename"), F.col("path")])
    docs = docs.select("doc_id", X.clean("markdown").alias("content"), X.stem("filename").alias("doc_title"), "dataset_id", "source_key", "filename")
    made = chunking.chunk(docs.select("doc_id", "content")).withColumn("embedding_vector", F.pandas_udf(embed or interfaces.hashed_embedder(), "array<float>")("content"))
    full = made.join(docs.drop("content"), "doc_id")
    full = full.withColumn("created_at", F.current_timestamp()).withColumn("summary", F.lit(None).cast("string")).withColumn("primary_entity", F.lit(None).cast("string"))
    return index.mark_latest(full, X.version_order("filename")).select(*index.COLUMNS)


def answer_contexts(asked: DataFrame, rows: DataFrame, terms: DataFrame, options: retrieval.Options = retrieval.Options(), embed=None, scorer=None) -> DataFrame:
    """(query_id, context, n_chunks): for queries (query_id, query) the text an answer would be written from: analysed, searched, reranked, expanded and cut to the budget, all queries in one plan."""
    keys = queries.normalised(queries.keywords(asked, terms), terms)
    parts = queries.query_terms(queries.clauses(keys, terms, asked))
    vectors = asked.select("query_id", F.pandas_udf(embed, "array<float>")("query").alias("query_vec")) if embed else None
    found = retrieval.search(parts, vectors, rows, options)
    ranked = retrieval.rerank(found.join(queries.rerank_query(asked, queries.keywords(asked, terms)).select("query_id", F.col("rerank_query").alias("query")), "query_id"), scorer, options)
    hits = ranked.select("query_id", "chunk_id", "chunk_type", "parent_id", "score", F.col("position").alias("rank"))
    grown = retrieval.expand(hits, rows)
    shown = grown.join(rows.select("chunk_id", "doc_title", "content"), "chunk_id")
    return retrieval.context(shown)


def quick_search(asked: DataFrame, rows: DataFrame, terms: DataFrame, options: retrieval.Options = retrieval.Options(), embed=None, generate=None, n_hypothetical: int = 1, scorer=None, call=None, format: str | None = None) -> DataFrame:
    """(query_id, context, n_chunks, prompt, answer): queries (query_id, query) from words to answers, all in one plan.

    Keywords, synonyms and phrases score by BM25, hypothetical answers (by
    generate, or the query itself) by the mean of their vectors; both lists
    are fused, reranked, expanded by parents and cut to the budget, and call
    answers the prompt. Without embed only words search; without call the
    answer is a stand-in.
    """
    rows = keep(rows)
    keys = queries.normalised(queries.keywords(asked, terms), terms)
    said = keep(queries.clauses(keys, terms, asked))
    fields = {"content": 1.0, "doc_title": 2.0}
    scored = retrieval.bm25(queries.words_of(said), rows, retrieval.searchable(options), fields)
    found = retrieval.phrases(queries.phrases_of(said), rows.where(retrieval.searchable(options)))
    words = retrieval.top(retrieval.with_phrases(scored, found), 2 * options.top_k)
    if embed is not None:
        near = rows.where(retrieval.searchable(options)).select("chunk_id", F.col("embedding_vector").alias("vec"))
        close = retrieval.top(retrieval.knn(queries.hypothetical_vectors(asked, embed, generate, n_hypothetical), near, k=2 * options.top_k), 2 * options.top_k)
        words = retrieval.fused_top(retrieval.fuse(words, close, 1 - options.vector_weight, options.vector_weight), options.top_k).select("query_id", "chunk_id", "score", "rank")
    hits = words.where(F.col("rank") < options.top_k).join(rows.select("chunk_id", "chunk_type", "parent_id", "content"), "chunk_id").where(~X.is_low_quality("content"))
    named = queries.rerank_query(asked, queries.keywords(asked, terms)).select("query_id", F.col("rerank_query").alias("query"))
    ranked = retrieval.rerank(hits.join(named, "query_id"), scorer, options)
    grown = retrieval.expand(ranked.select("query_id", "chunk_id", "chunk_type", "parent_id", "score", F.col("position").alias("rank")), rows)
    context = retrieval.context(grown.join(rows.select("chunk_id", "doc_title", "content"), "chunk_id"))
    wanted = keep(asked.join(context, "query_id", "left").withColumn("format", F.lit(format).cast("string")))
    prompts = generation.prompts(wanted)
    answers = generation.answers(prompts, call or generation.stand_in)
    return wanted.select("query_id", "context", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks")).join(prompts, "query_id", "left").join(answers.select("query_id", "answer"), "query_id", "left")


def build_knowledge(chunks: DataFrame, terms: DataFrame, models: DataFrame, steps: tuple[str, ...] = ("entities", "parameters", "cooperations", "graph"), recogniser=None, extract_parameters=None, extract_cooperations=None, fields: list[str] = []) -> dict[str, DataFrame]:
    """The tables of the steps asked for, each kept and used by the later ones: entities, parameters of models, cooperations, and the graph's nodes and edges. chunks: (chunk_id, doc_id, content); models: (category, series, model, params). A step without its function leaves its table empty or as given."""
    out: dict[str, DataFrame] = {"entities": keep(knowledge.entities_of(chunks, terms, recogniser))}
    if "parameters" in steps:
        contexts = entities.model_chunks(models.select("model").distinct(), out["entities"], chunks)
        out["parameters"] = keep(knowledge.fill_parameters(models, contexts, extract_parameters or (lambda m, c, f: {}), fields))
    if "cooperations" in steps:
        out["cooperations"] = keep(knowledge.cooperations(entities.cooccurrence(out["entities"]), chunks, extract_cooperations or (lambda c, orgs: [])))
    if "graph" in steps:
        orgs = out["entities"].where("entity_type = 'ORG'").select(F.col("entity_name").alias("name"), "frequency")
        groups = keep(entities.org_groups(orgs))
        made = out.get("cooperations") or chunks.sparkSession.createDataFrame([], "units array<string>, content string, products array<string>")
        params = out.get("parameters", models)
        partners = params.select("model", F.try_element_at("params", F.lit("合作单位")).alias("partner")).where("partner <> ''")
        out["nodes"], out["edges"] = knowledge.assemble(groups, made.select("units", "content", "products"), params.select("category", "series", "model", "params"), entities.owned_by(partners, groups))
    return {k: v for k, v in out.items() if k in steps or k in ("nodes", "edges")}
