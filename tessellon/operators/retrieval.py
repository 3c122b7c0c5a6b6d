"""Ranked retrieval of chunks for batches of queries.

Every operator takes queries as rows with a query_id, so that a batch is one
plan. Corpus statistics count the whole index, before any filter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessellon.functions import text as X
from tessellon.plans.lineage import cut, is_small

K1, B = 1.2, 0.75
RRF_K = 60
#: Rows and vectors that a broadcast query side may have at most; above that the plan shuffles.
BROADCAST_ROWS = 20_000


@dataclass(frozen=True)
class Options:
    """Plan parameters, checked."""

    top_k: int = 20
    min_score: float = 0.0
    vector_weight: float = 0.7
    rerank_top_k: int | None = None
    rerank_threshold: float = 0.0
    datasets: tuple[str, ...] = ()
    documents: tuple[str, ...] = ()

    def __post_init__(self):
        if not 1 <= self.top_k <= 100:
            raise ValueError("top_k must lie in 1..100")
        if not (0 <= self.min_score <= 1 and 0 <= self.vector_weight <= 1):
            raise ValueError("min_score and vector_weight must lie in 0..1")
        if self.rerank_top_k is not None and not 1 <= self.rerank_top_k <= 100:
            raise ValueError("rerank_top_k must lie in 1..100")


def searchable(options: Options) -> Column:
    """The retrieval filter; never scored, pushed to the scan."""
    cond = F.col("is_latest") & F.col("chunk_type").isin("child", "summary", "doc_summary")
    if options.documents:
        cond &= F.col("doc_id").isin(*options.documents)
    if options.datasets:
        cond &= F.col("dataset_id").isin(*options.datasets)
    return cond


def postings(index: DataFrame, key: str = "chunk_id", text: str = "content") -> DataFrame:
    """(key, term, tf, dl): how often each term stands in each text, and the text's length in terms."""
    toks = index.select(key, X.tokens(F.col(text)).alias("t")).where("size(t) > 0")
    return toks.select(key, F.size("t").alias("dl"), F.explode("t").alias("term")).groupBy(key, "term", "dl").agg(F.count("*").alias("tf"))


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast if it has no more than `rows` rows."""
    return F.broadcast(df) if is_small(df, rows) else df


def bm25(queries: DataFrame, index: DataFrame, keep: Column | None = None, fields: dict[str, float] | None = None, key: str = "chunk_id") -> DataFrame:
    """(query_id, key, score): BM25 of every row of index (key, fields...) that shares a term with a query (query_id, term, weight).

    For a term the best field counts, with its boost. `keep` restricts which
    rows are scored, not the statistics. Repeated query terms count by weight.
    """
    fields = fields or {"content": 1.0}
    terms = cut(queries.groupBy("query_id", "term").agg(F.sum("weight").alias("weight")))
    wanted = small(terms.select("term").distinct())
    scored = None
    for field, boost in fields.items():
        toks = index.select(key, X.tokens(F.col(field)).alias("t"), (keep if keep is not None else F.lit(True)).alias("_keep")).where("size(t) > 0")
        stats = toks.agg(F.count("*").alias("n_docs"), F.avg(F.size("t")).alias("avgdl"))
        # what is asked for is counted once; the rest of the corpus leaves no row
        hit = toks.select(key, "_keep", F.size("t").alias("dl"), F.explode("t").alias("term")).join(wanted, "term", "left_semi")
        tf = cut(hit.groupBy(key, "_keep", "term", "dl").agg(F.count("*").alias("tf")))
        df = tf.groupBy("term").agg(F.count("*").alias("df"))
        idf = F.log(F.lit(1.0) + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        s = boost * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
        part = tf.where("_keep").join(small(df), "term").crossJoin(F.broadcast(stats)).select(key, "term", s.alias("s"))
        scored = part if scored is None else scored.unionByName(part)
    if len(fields) > 1:
        scored = scored.groupBy(key, "term").agg(F.max("s").alias("s"))
    return scored.join(small(terms), "term").groupBy("query_id", key).agg(F.round(F.sum(F.col("s") * F.col("weight")), 6).alias("score"))


#: Vectors that go to the tasks as one matrix; more of them go in several passes.
BLOCK = 2_000


def _blocks(vectors: DataFrame, size: int) -> Iterator[pd.DataFrame]:
    """The rows of vectors in frames of about `size`, by a hash of their first column."""
    rows = cut(vectors)
    n = -(-rows.count() // size)
    for i in range(n):
        yield rows.where(F.pmod(F.xxhash64(rows.columns[0]), F.lit(n)) == i).toPandas()


def _unit(vectors: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """(vectors of length 1 as rows, which of the given ones they are): without those of no finite length above 0."""
    x = np.array(vectors.tolist(), dtype=np.float64)
    norms = np.linalg.norm(x, axis=1)
    good = np.nonzero(np.isfinite(norms) & (norms > 0))[0]
    return x[good] / norms[good, None], good


def knn(queries: DataFrame, vectors: DataFrame, key: str = "chunk_id", floor: float = 0.0, k: int | None = None, block: int = BLOCK) -> DataFrame:
    """(query_id, key, score): (1 + cosine) / 2 of every query (query_id, query_vec) and row of vectors (key, vec) with a cosine of `floor` at least; null and zero vectors and other lengths take no part.

    Queries go to the tasks in matrices of `block`, each of which is
    multiplied with the vectors' batches; with k only rows that can be among a
    query's k best leave a batch (equals included).
    """
    asked = queries.where(F.col("query_vec").isNotNull()).select("query_id", "query_vec")
    ok = vectors.where(F.col("vec").isNotNull()).select(key, "vec")
    types = dict(queries.dtypes) | {key: dict(vectors.dtypes)[key]}
    schema = f"query_id {types['query_id']}, {key} {types[key]}, cos double"
    found = None
    for rows in _blocks(asked, block):
        by_size = {n: (g["query_id"].to_numpy(), *_unit(g["query_vec"])) for n, g in rows.groupby(rows["query_vec"].map(len))}

        def run(batches: Iterator[pd.DataFrame], by_size: dict = by_size) -> Iterator[pd.DataFrame]:
            for p in batches:
                sizes = p["vec"].map(len)
                for n, (qids, q, asks) in by_size.items():
                    own = p[sizes == n]
                    if not len(own) or not len(q):
                        continue
                    x, good = _unit(own["vec"])
                    ids = own[key].to_numpy()[good]
                    cos = np.round(q @ x.T, 6)
                    fits = cos >= floor
                    if k is not None and cos.shape[1] > k:
                        fits &= cos >= -np.partition(-cos, k - 1, axis=1)[:, k - 1 : k]
                    i, j = np.nonzero(fits)
                    yield pd.DataFrame({"query_id": qids[asks[i]], key: ids[j], "cos": cos[i, j]})

        part = ok.mapInPandas(run, schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = queries.sparkSession.createDataFrame([], schema)
    return found.select("query_id", key, F.round((1 + F.col("cos")) / 2, 6).alias("score"))


def top(scored: DataFrame, k: int, key: str = "chunk_id", out: str = "rank") -> DataFrame:
    """scored with each query's k best and their rank from 0; ties by key. The rank limit is taken before the shuffle as well."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return scored.withColumn(out, F.row_number().over(w) - 1).where(F.col(out) < k)


def fuse(first: DataFrame, second: DataFrame, weight_first: float, weight_second: float, key: str = "chunk_id", k: int = RRF_K) -> DataFrame:
    """(query_id, key, score, first_rank, second_rank): reciprocal rank fusion of two ranked lists (query_id, key, rank)."""
    a = first.select("query_id", key, F.col("rank").alias("first_rank"))
    b = second.select("query_id", key, F.col("rank").alias("second_rank"))
    both = a.join(b, ["query_id", key], "full_outer")
    score = F.coalesce(weight_first / (k + F.col("first_rank")), F.lit(0.0)) + F.coalesce(weight_second / (k + F.col("second_rank")), F.lit(0.0))
    return both.withColumn("score", F.round(score, 9))


def fused_top(fused: DataFrame, k: int, key: str = "chunk_id") -> DataFrame:
    """The k best of fuse's rows: equal scores by the first list's rank, then the second's."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("first_rank"), F.asc_nulls_last("second_rank"), key)
    return fused.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < k)


def hybrid(terms: DataFrame, vectors: DataFrame | None, index: DataFrame, options: Options = Options()) -> DataFrame:
    """(query_id, chunk_id, score, rank): BM25 over title and content and nearest vectors, 2 * top_k each, fused. Without vectors BM25 alone."""
    can = 2 * options.top_k
    words = top(bm25(terms, index, searchable(options), {"content": 1.0, "doc_title": 2.0}), can)
    if vectors is None:
        return words.where(F.col("rank") < options.top_k)
    near = index.where(searchable(options)).select("chunk_id", F.col("embedding_vector").alias("vec"))
    close = top(knn(vectors, near, k=can), can)
    return fused_top(fuse(words, close, 1 - options.vector_weight, options.vector_weight), options.top_k).select("query_id", "chunk_id", "score", "rank")


def search(terms: DataFrame, vectors: DataFrame | None, index: DataFrame, options: Options = Options()) -> DataFrame:
    """hybrid's hits with the index's columns, without low-quality contents and scores under min_score."""
    hits = cut(hybrid(terms, vectors, index, options))
    rows = index.select("chunk_id", "doc_id", "content", "doc_title", "dataset_id", "chunk_type", "doc_hash", "parent_id").join(small(hits), "chunk_id")
    rows = rows.where(~X.is_low_quality("content"))
    return rows.where(F.col("score") >= options.min_score) if options.min_score > 0 else rows


def rerank(hits: DataFrame, scorer: Callable[[pd.Series, pd.Series], pd.Series] | None = None, options: Options = Options()) -> DataFrame:
    """hits (query_id, query, chunk_id, content, rank) scored anew by scorer(query, content) in batches; without a scorer the order stays, with scores falling by 0.01."""
    if scorer is None:
        scored = hits.withColumn("score", F.round(1.0 - 0.01 * F.col("rank"), 6))
    else:

        def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
            for q, c in parts:
                yield scorer(q, c)

        run.__annotations__ = {"parts": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
        scored = hits.withColumn("score", F.pandas_udf(run, "double")("query", "content"))
    if options.rerank_threshold > 0:
        scored = scored.where(F.col("score") >= options.rerank_threshold)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "rank")
    return scored.withColumn("position", F.row_number().over(w) - 1).where(F.col("position") < (options.rerank_top_k or options.top_k))


def expand(hits: DataFrame, index: DataFrame, siblings: int = 0) -> DataFrame:
    """(query_id, chunk_id, score, position, expanded): hits (query_id, chunk_id, chunk_type, parent_id, score, rank) with chunks replaced by their parents.

    A summary becomes its parent; two and more hits under one parent become
    the parent once, at the first one's place with the best score; a lone
    child stays, followed by up to `siblings` neighbours on either side. Hits
    whose parent is not in the index stay as they are.
    """
    hits = cut(hits)
    parents = index.where("chunk_type = 'parent'").select(F.col("chunk_id").alias("parent_id")).distinct()
    known = hits.join(parents.withColumn("_there", F.lit(True)).join(small(hits.select("parent_id").distinct()), "parent_id", "left_semi"), "parent_id", "left")
    group = Window.partitionBy("query_id", "parent_id")
    counted = known.withColumn("_n", F.count("*").over(group)).withColumn("_sum", F.max((F.col("chunk_type") == "summary").cast("int")).over(group))
    up = F.col("parent_id").isNotNull() & F.col("_there") & ((F.col("_n") >= 2) | (F.col("_sum") == 1))
    up = F.coalesce(up, F.lit(False))
    lifted = counted.where(up).groupBy("query_id", "parent_id").agg(F.max("score").alias("score"), F.min("rank").alias("rank"))
    lifted = lifted.select("query_id", F.col("parent_id").alias("chunk_id"), "score", "rank", F.lit(0).alias("_step"), F.lit(True).alias("expanded"))
    lone = counted.where(~up)
    stay = lone.select("query_id", "chunk_id", "score", "rank", F.lit(0).alias("_step"), F.lit(False).alias("expanded"))
    out = lifted.unionByName(stay)
    if siblings:
        seq = sibling_order(index)
        mine = lone.where("chunk_type = 'child' and parent_id is not null").join(seq.select("chunk_id", "ordinal"), "chunk_id")
        near = mine.select("query_id", "parent_id", "score", "rank", F.col("ordinal").alias("_o")).join(seq.withColumnRenamed("chunk_id", "_c"), "parent_id")
        near = near.where((F.abs(F.col("ordinal") - F.col("_o")) <= siblings) & (F.col("ordinal") != F.col("_o")))
        out = out.unionByName(near.select("query_id", F.col("_c").alias("chunk_id"), "score", "rank", (F.col("ordinal") - F.col("_o") + siblings + 1).alias("_step"), F.lit(True).alias("expanded")))
    once = Window.partitionBy("query_id", "chunk_id").orderBy("rank", "_step")
    out = out.withColumn("_r", F.row_number().over(once)).where("_r = 1").drop("_r")
    place = Window.partitionBy("query_id").orderBy("rank", "_step", "chunk_id")
    return out.withColumn("position", F.row_number().over(place) - 1).select("query_id", "chunk_id", "score", "position", "expanded")


def sibling_order(index: DataFrame) -> DataFrame:
    """(parent_id, chunk_id, ordinal): children in the order of the number at their id's end."""
    kids = index.where("chunk_type = 'child' and parent_id is not null").select("parent_id", "chunk_id").distinct()
    n = F.coalesce(F.regexp_extract("chunk_id", "_t?c(\\d+)$", 1).try_cast("bigint"), F.lit(0))
    return kids.withColumn("ordinal", F.row_number().over(Window.partitionBy("parent_id").orderBy(n, "chunk_id")))


def neighbours(index: DataFrame) -> DataFrame:
    """(chunk_id, parent_id, prev_id, next_id): each child with the children before and after it."""
    w = Window.partitionBy("parent_id").orderBy("ordinal")
    return sibling_order(index).select("chunk_id", "parent_id", F.lag("chunk_id").over(w).alias("prev_id"), F.lead("chunk_id").over(w).alias("next_id"))


def context(hits: DataFrame, budget: int = 10_000, notes: DataFrame | None = None) -> DataFrame:
    """(query_id, context, n_chunks): hits (query_id, doc_title, content, position) as text, up to the first that would exceed the budget; notes (query_id, note) come first and count."""
    rows = hits.select("query_id", "position", F.concat(F.lit("[来源: "), F.coalesce("doc_title", F.lit("")), F.lit("]\n"), F.coalesce("content", F.lit(""))).alias("part"))
    if notes is not None:
        rows = rows.unionByName(notes.where("note <> ''").select("query_id", F.lit(-1).alias("position"), F.col("note").alias("part")))
    w = Window.partitionBy("query_id").orderBy("position")
    upto = rows.withColumn("_sum", F.sum(F.length("part")).over(w))
    # the sum only grows, so rows before the first overflow are those that fit
    kept = upto.where(F.col("_sum") <= budget)
    return kept.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "part"))), lambda s: s["part"]), "\n\n---\n\n").alias("context"), F.count("*").alias("n_chunks"))


def union_cut(lists: DataFrame, top_k: int) -> DataFrame:
    """lists (query_id, part, chunk_id, rank) of several rewritings of each query as one: of each rewriting the first max(1, top_k // n), the first occurrence of a chunk counting."""
    n = lists.groupBy("query_id").agg(F.countDistinct("part").alias("_n"))
    first_of = lists.join(small(n), "query_id").where(F.col("rank") < F.greatest(F.lit(1), F.floor(F.lit(top_k) / F.col("_n"))))
    w = Window.partitionBy("query_id", "chunk_id").orderBy("part", "rank")
    first = first_of.withColumn("_r", F.row_number().over(w)).where("_r = 1")
    place = Window.partitionBy("query_id").orderBy("part", "rank")
    return first.withColumn("position", F.row_number().over(place) - 1).select("query_id", "chunk_id", "part", "position")


def overlap(results: DataFrame) -> DataFrame:
    """(query_id, mode_a, mode_b, n_common, n_union, jaccard) of results (query_id, mode, chunk_id)."""
    sets = results.groupBy("query_id", "mode").agg(F.collect_set("chunk_id").alias("s"))
    a, b = sets.select("query_id", F.col("mode").alias("mode_a"), F.col("s").alias("sa")), sets.select("query_id", F.col("mode").alias("mode_b"), F.col("s").alias("sb"))
    both = a.join(b, "query_id").where("mode_a < mode_b")
    return both.select("query_id", "mode_a", "mode_b", F.size(F.array_intersect("sa", "sb")).alias("n_common"), F.size(F.array_union("sa", "sb")).alias("n_union"), F.round(X.jaccard("sa", "sb"), 6).alias("jaccard"))


def accumulate(seen: DataFrame, fresh: DataFrame) -> DataFrame:
    """seen with the chunks of fresh that it doesn't have, of which each comes once."""
    return seen.unionByName(fresh.join(seen.select("chunk_id"), "chunk_id", "left_anti").dropDuplicates(["chunk_id"]), allowMissingColumns=True)


def semantic_new(seen: DataFrame, fresh: DataFrame, above: float = 0.92, block: int = BLOCK) -> DataFrame:
    """fresh (chunk_id, vec) without those whose cosine with a row of seen (chunk_id, vec) exceeds `above`; rows without a usable vector stay. What was seen goes to the tasks in matrices of `block`."""
    kind = dict(fresh.dtypes)["chunk_id"]
    rest = fresh
    for rows in _blocks(seen.where("vec is not null").select("chunk_id", "vec"), block):
        by_size = {n: _unit(g["vec"])[0] for n, g in rows.groupby(rows["vec"].map(len))}

        def run(batches: Iterator[pd.DataFrame], by_size: dict = by_size) -> Iterator[pd.DataFrame]:
            for p in batches:
                sizes = p["vec"].map(len)
                for n, q in by_size.items():
                    own = p[sizes == n]
                    if len(own) and len(q):
                        x, good = _unit(own["vec"])
                        yield pd.DataFrame({"chunk_id": own["chunk_id"].to_numpy()[good[(x @ q.T).max(1, initial=-1.0) > above]]})

        near = fresh.where("vec is not null").select("chunk_id", "vec").mapInPandas(run, f"chunk_id {kind}").distinct()
        rest = rest.join(near, "chunk_id", "left_anti")
    return rest


def sources(hits: DataFrame, n: int = 150) -> DataFrame:
    """hits with a snippet of n characters instead of their content."""
    return hits.withColumn("snippet", X.snippet("content", n)).drop("content")


def by_content(hits: DataFrame) -> DataFrame:
    """(query_id, content, chunk_id): the chunk that each text of hits (query_id, content, chunk_id, rank) stands for; of equal texts the last ranked."""
    return hits.groupBy("query_id", "content").agg(F.max_by("chunk_id", "rank").alias("chunk_id"))


def phrases(wanted: DataFrame, index: DataFrame, key: str = "chunk_id", text: str = "content", slop: int = 2) -> DataFrame:
    """wanted (query_id, phrase array, ...) with the keys of index's texts that hold the phrase's words in order, with at most `slop` other words between neighbours; each text once for a phrase.

    Only positions of wanted words leave the corpus. The words of a phrase are
    joined one after the other, each keeping the earliest place reached.
    """
    asked = cut(wanted.where("size(phrase) > 0").withColumn("_id", F.monotonically_increasing_id()))
    words = small(asked.select(F.explode("phrase").alias("term")).distinct())
    toks = index.select(key, F.posexplode(X.tokens(F.col(text))).alias("_at", "term"))
    places = cut(toks.join(words, "term", "left_semi"))
    longest = asked.agg(F.max(F.size("phrase"))).first()[0] or 0
    reached, ended = None, None
    for i in range(longest):
        term = asked.where(F.size("phrase") > i).select("_id", F.element_at("phrase", i + 1).alias("term"))
        here = places.join(small(term), "term").select("_id", key, "_at")
        if reached is not None:
            before = reached.withColumnRenamed("_at", "_before")
            here = here.join(before, ["_id", key]).where(F.col("_at").between(F.col("_before") + 1, F.col("_before") + 1 + slop)).select("_id", key, "_at").distinct()
        reached = here
        done = reached.join(small(asked.where(F.size("phrase") == i + 1).select("_id")), "_id", "left_semi").select("_id", key).distinct()
        ended = done if ended is None else ended.unionByName(done)
    if ended is None:
        return asked.drop("_id").join(index.select(key).limit(0), F.lit(False))
    return asked.join(ended, "_id").drop("_id")


def with_phrases(scored: DataFrame, found: DataFrame, key: str = "chunk_id") -> DataFrame:
    """scored (query_id, key, score) with the boosts of the phrases found (query_id, key, boost) added; a text that only phrases found counts too."""
    extra = found.groupBy("query_id", key).agg(F.sum("boost").alias("_boost"))
    both = scored.join(extra, ["query_id", key], "full_outer")
    return both.select("query_id", key, F.round(F.coalesce("score", F.lit(0.0)) + F.coalesce("_boost", F.lit(0.0)), 6).alias("score"))
