"""The chunk index: rows of parents, children and summaries, upserts, versions and listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessellon.functions import text as X

COLUMNS = ["chunk_id", "doc_id", "doc_hash", "doc_title", "dataset_id", "source_key", "chunk_type", "content", "summary", "primary_entity", "parent_id", "embedding_vector", "is_latest", "created_at"]


def _meta(c: str, key: str) -> Column:
    return F.element_at(F.col(c) if isinstance(c, str) else c, key)


def rows_of(tree: DataFrame, created_at: Column | None = None) -> DataFrame:
    """Index rows of documents_tree: each parent, its children and its summaries, all three kinds in one pass over the tree. A child's document fields are its parent's."""
    parent = "metadata"
    none = F.lit(None)

    def row(kind: str, content: Column, summary: Column, entity: Column, meta: Column, vector: Column, parent_id: Column) -> Column:
        return F.struct(
            F.element_at(meta, "chunk_id").alias("chunk_id"),
            F.lit(kind).alias("chunk_type"),
            content.alias("content"),
            summary.cast("string").alias("summary"),
            entity.alias("primary_entity"),
            F.coalesce(F.element_at(meta, "doc_hash"), F.element_at(F.col(parent), "doc_hash")).alias("doc_hash"),
            parent_id.cast("string").alias("parent_id"),
            vector.alias("embedding_vector"),
        )

    own = F.array(row("parent", F.col("content"), F.col("summary"), F.col("primary_entity"), F.col(parent), F.col("vector"), none))
    pid = F.element_at(F.col(parent), "chunk_id")
    kids = F.transform("children", lambda c: row("child", c["content"], none, c["primary_entity"], c["metadata"], c["vector"], F.coalesce(F.element_at(c["metadata"], "parent_id"), pid)))
    sums = F.transform("summaries", lambda s: row("summary", s["content"], none, s["primary_entity"], s["metadata"], s["vector"], pid))
    every = F.concat(own, F.coalesce(kids, F.slice(own, 1, 0)), F.coalesce(sums, F.slice(own, 1, 0)))
    flat = tree.select(F.col(parent).alias("_m"), F.explode(every).alias("r"))
    stamp = created_at if created_at is not None else F.current_timestamp()
    return flat.select(
        "r.chunk_id", _meta("_m", "doc_id").alias("doc_id"), "r.doc_hash", _meta("_m", "doc_title").alias("doc_title"), _meta("_m", "dataset_id").alias("dataset_id"), _meta("_m", "source_key").alias("source_key"),
        "r.chunk_type", "r.content", "r.summary", "r.primary_entity", "r.parent_id", "r.embedding_vector", F.lit(True).alias("is_latest"), stamp.alias("created_at"),
    )


def newest(rows: DataFrame, key: str | list[str], order: list[Column]) -> DataFrame:
    """One row for each key, the first in `order`; a rank limit of 1 is pushed before the shuffle."""
    keys = [key] if isinstance(key, str) else key
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def upsert(index: DataFrame, arrivals: DataFrame) -> DataFrame:
    """index with arrivals by chunk_id, the arriving row winning; of arrivals of one id the last ingested counts."""
    order = [F.col(c).desc_nulls_last() for c in ("ingested_at", "created_at") if c in arrivals.columns] + [F.col("content").asc_nulls_last()]
    fresh = newest(arrivals, "chunk_id", order)
    return index.join(fresh.select("chunk_id"), "chunk_id", "left_anti").unionByName(fresh, allowMissingColumns=True)


def delete(index: DataFrame, documents: DataFrame) -> DataFrame:
    """index without the chunks of documents (doc_id)."""
    return index.join(documents.select("doc_id").distinct(), "doc_id", "left_anti")


def get(index: DataFrame, ids: DataFrame) -> DataFrame:
    """The index's rows of ids (chunk_id)."""
    return index.join(ids.select("chunk_id").distinct(), "chunk_id", "left_semi")


def mark_latest(rows: DataFrame, order: Column | None = None) -> DataFrame:
    """rows with is_latest: under each source_key the chunks of the document that arrived last (or is last in `order`); rows without a source_key are all latest."""
    rank = order if order is not None else F.struct("ingested_at", "doc_id")
    last = rows.where("source_key is not null").groupBy("dataset_id", "source_key").agg(F.max_by("doc_id", rank).alias("_last"))
    marked = rows.drop("is_latest").join(last, ["dataset_id", "source_key"], "left")
    return marked.withColumn("is_latest", F.col("_last").isNull() | (F.col("doc_id") == F.col("_last"))).drop("_last")


def latest_files(files: DataFrame) -> DataFrame:
    """files (dataset_id, source_key, filename, ...) that are the last version by their names."""
    last = files.groupBy("dataset_id", "source_key").agg(F.max_by("filename", X.version_order("filename")).alias("filename"))
    return files.join(last, ["dataset_id", "source_key", "filename"], "left_semi")


def list_documents(index: DataFrame, page: int = 1, size: int | None = None) -> DataFrame:
    """(doc_id, doc_title, n_chunks, created_at, position, total): documents by their last parent chunk, newest first; `page` counts from 1, `size` None lists all."""
    parents = index.where("chunk_type = 'parent'")
    docs = parents.groupBy("doc_id").agg(F.countDistinct("chunk_id").alias("n_chunks"), F.max("created_at").alias("created_at"), F.min("doc_title").alias("doc_title"))
    if size is None:
        return docs.select("doc_id", "doc_title", "n_chunks", "created_at")
    total = docs.agg(F.count("*").alias("total"))
    first = docs.orderBy(F.col("created_at").desc_nulls_last(), "doc_id").limit(page * size)
    w = Window.orderBy(F.col("created_at").desc_nulls_last(), "doc_id")
    ranked = first.withColumn("position", F.row_number().over(w)).where(F.col("position") > (page - 1) * size)
    return ranked.crossJoin(F.broadcast(total)).select("doc_id", "doc_title", "n_chunks", "created_at", "position", "total")


def titles(index: DataFrame) -> DataFrame:
    """(doc_id, doc_title): the title of each document's first chunk that has one."""
    return index.where("doc_title <> ''").groupBy("doc_id").agg(F.min_by("doc_title", F.struct("chunk_id", "doc_title")).alias("doc_title"))


def counts(index: DataFrame, by: list[str]) -> DataFrame:
    return index.groupBy(*by).agg(F.count("*").alias("n_chunks"), F.countDistinct("doc_id").alias("n_docs"))


def aligned(rows: DataFrame, schema: str) -> DataFrame:
    """rows in the columns of `schema`, a DDL string: missing ones null, others cast; columns that the schema doesn't know stay behind them, so a schema only grows."""
    wanted = StructType.fromDDL(schema)
    known = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in wanted]
    return rows.select(*known, *[c for c in rows.columns if c not in wanted.names])
