"""A tool-using loop over retrieval: a driver-side controller whose tools are DataFrame jobs."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessellon.functions import text as X
from tessellon.operators import queries as Q
from tessellon.operators import retrieval as R

#: Names of tools that models may use for the same thing.
ALIASES = {"search_knowledge": "bm25_search"}


def repair_json(text: str) -> dict | None:
    """A JSON object from a model's arguments, mending what is usual: missing brackets, trailing commas, single quotes; None if it can't be read."""
    import re

    text = (text or "").strip()
    commas = lambda t: re.sub(r",\s*([}\]])", r"\1", t)
    mended = commas(text)
    closed = commas(mended + "]" * max(0, mended.count("[") - mended.count("]")) + "}" * max(0, mended.count("{") - mended.count("}")))
    for t in (text, mended, closed, closed.replace("'", '"')):
        try:
            out = json.loads(t)
            if isinstance(out, dict):
                return out
        except ValueError:
            pass
    return None


@dataclass
class State:
    """What one run has gathered."""

    chunks: DataFrame | None = None
    steps: list[dict] = field(default_factory=list)
    tokens: int = 0
    empty: int = 0


class Agent:
    """decide(question, steps) -> {'tool', 'arguments', 'tokens'}; tools: name -> (arguments) -> DataFrame with chunk_id and vec.

    Stops when the tool is 'finish', no tool is asked for, two searches in a
    row found nothing new, a signature repeats three times, or after
    max_steps.
    """

    def __init__(self, decide: Callable[[str, list[dict]], dict], tools: dict[str, Callable[[dict], DataFrame]], max_steps: int = 8, dedup: float | None = 0.92):
        self.decide, self.tools, self.max_steps, self.dedup = decide, tools, max_steps, dedup

    def run(self, question: str) -> State:
        state, signatures = State(), []
        for _ in range(self.max_steps):
            move = self.decide(question, state.steps)
            state.tokens += int(move.get("tokens", 0))
            tool = ALIASES.get(move.get("tool"), move.get("tool"))
            if not tool or tool == "finish":
                state.steps.append({"tool": tool or "none", "n_new": 0})
                break
            args = move.get("arguments") or {}
            args = repair_json(args) if isinstance(args, str) else args
            if args is None or tool not in self.tools:
                state.steps.append({"tool": tool, "error": "unreadable arguments" if args is None else "unknown tool", "n_new": 0})
                continue
            signatures.append((tool, json.dumps(args, sort_keys=True, ensure_ascii=False)))
            fresh = self.tools[tool](args)
            if state.chunks is not None and self.dedup is not None:
                fresh = R.semantic_new(state.chunks, fresh, self.dedup)
            before = state.chunks
            joined = fresh.dropDuplicates(["chunk_id"]) if before is None else R.accumulate(before, fresh)
            joined = joined.persist()
            n_new = joined.count() - (0 if before is None else before.count())
            state.chunks = joined
            state.steps.append({"tool": tool, "arguments": args, "n_new": n_new})
            state.empty = 0 if n_new else state.empty + 1
            if state.empty >= 2 or signatures[-3:].count(signatures[-1]) == 3:
                break
        return state


def grouped_terms(groups: list[list[str]], spark) -> DataFrame:
    """(query_id, term, weight): each group of terms as one query of equal weights."""
    rows = [(i, t) for i, g in enumerate(groups) for t in g]
    df = spark.createDataFrame(rows, "query_id int, phrase string")
    return df.select("query_id", F.explode(X.tokens("phrase")).alias("term")).groupBy("query_id", "term").agg(F.lit(1.0).alias("weight"))


def global_rerank(gathered: DataFrame, scorer=None, expanded: int = 10) -> DataFrame:
    """gathered hits (query_id, query, chunk_id, content, rank) of all steps reranked together, with position and whether they are among the first `expanded`, whose parents are to be shown; the rest stays as it is."""
    ranked = R.rerank(gathered, scorer, R.Options(top_k=100))
    return ranked.withColumn("expanded", F.col("position") < expanded)


def synthesis(gathered: DataFrame, limit: int = 16_000) -> DataFrame:
    """(query_id, context): gathered contents (query_id, content, position), numbered, as one text cut at `limit` characters."""
    parts = gathered.select("query_id", "position", F.concat(F.lit("["), (F.col("position") + 1).cast("string"), F.lit("] "), F.coalesce("content", F.lit(""))).alias("part"))
    # a part that begins beyond the limit is never gathered
    w = Window.partitionBy("query_id").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    near = parts.withColumn("_before", F.coalesce(F.sum(F.length("part") + 2).over(w), F.lit(0))).where(F.col("_before") < limit)
    whole = near.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "part"))), lambda s: s["part"]), "\n\n").alias("context"))
    return whole.select("query_id", F.substring("context", 1, limit).alias("context"))


def vector_search(asked: DataFrame, rows: DataFrame, embed, generate=None, scorer=None, options: R.Options = R.Options(), n: int = 1) -> DataFrame:
    """The agent's search by meaning: hypothetical answers to each query (query_id, query), the mean of their vectors, the nearest chunks of rows, reranked."""
    near = rows.where(R.searchable(options)).select("chunk_id", F.col("embedding_vector").alias("vec"))
    vectors = Q.hypothetical_vectors(asked, embed, generate, n)
    hits = R.top(R.knn(vectors, near, k=2 * options.top_k), 2 * options.top_k)
    shown = hits.join(rows.select("chunk_id", "content", "parent_id", "chunk_type"), "chunk_id").join(asked, "query_id")
    return R.rerank(shown, scorer, options)


def term_search(groups: DataFrame, rows: DataFrame, scorer=None, options: R.Options = R.Options()) -> DataFrame:
    """The agent's search by words: groups (group_id, terms array) of equal terms, each searched by BM25 in one plan, in the order of the groups, with the group's rank."""
    terms = groups.select(F.col("group_id").alias("query_id"), F.explode("terms").alias("phrase")).select("query_id", F.explode(X.tokens("phrase")).alias("term")).distinct().withColumn("weight", F.lit(1.0))
    hits = R.top(R.bm25(terms, rows, R.searchable(options), {"content": 1.0, "doc_title": 2.0}), options.top_k)
    shown = hits.join(rows.select("chunk_id", "content", "parent_id", "chunk_type"), "chunk_id").join(groups.select(F.col("group_id").alias("query_id"), F.array_join("terms", " ").alias("query")), "query_id")
    return R.rerank(shown, scorer, options).orderBy("query_id", "position")
