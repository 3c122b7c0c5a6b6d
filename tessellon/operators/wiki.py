"""Wiki pages: parsing generated blocks, merging pages, index and log, reviews."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellon.functions import text as X
from tessellon.plans.lineage import cut

# Types of pages.
PAGE_TYPES = ["source", "entity", "concept", "comparison", "synthesis", "query", "overview"]


def parse_files(text: str) -> list[tuple[str, str]]:
    """(path, body) of 'FILE: path' blocks; a body starts after the block's first '---' line and keeps its own '---' lines."""
    out: list[tuple[str, list[str]]] = []
    opened = review = False
    for line in (text or "").split("\n"):
        if m := re.match(r"\s*FILE:\s*(\S.*?)\s*$", line):
            out.append((m[1], []))
            opened, review = False, False
        elif re.match(r"\s*REVIEW:", line):
            review = True
        elif out and not review:
            if not opened and line.strip() == "---":
                opened = True
                out[-1][1].append(line)
            elif opened:
                out[-1][1].append(line)
    return [(p, "\n".join(b).strip()) for p, b in out if "".join(b).strip()]


def parse_reviews(text: str) -> list[tuple[str, str, str, list[str]]]:
    """(title, kind, reason, suggestions) of 'REVIEW: title' blocks; lines before the first one belong to none."""
    out: list[list] = []
    for line in (text or "").split("\n"):
        if m := re.match(r"\s*REVIEW:\s*(.*?)\s*$", line):
            out.append([m[1], "skip", "", []])
        elif re.match(r"\s*FILE:", line):
            out.append(None)
        elif out and out[-1]:
            if m := re.match(r"\s*Type:\s*(.*?)\s*$", line):
                out[-1][1] = m[1].lower()
            elif m := re.match(r"\s*Reason:\s*(.*?)\s*$", line):
                out[-1][2] = m[1]
            elif m := re.match(r"\s*-\s+(.*?)\s*$", line):
                out[-1][3].append(m[1])
    return [tuple(x) for x in out if x]


def file_blocks(replies: DataFrame) -> DataFrame:
    """(reply_id, path, body) of replies (reply_id, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            yield pd.DataFrame([(i, a, b) for i, t in zip(p["reply_id"], p["text"]) for a, b in parse_files(t)], columns=["reply_id", "path", "body"])

    return replies.select("reply_id", "text").mapInPandas(run, f"reply_id {dict(replies.dtypes)['reply_id']}, path string, body string")


def review_blocks(replies: DataFrame) -> DataFrame:
    """(reply_id, title, kind, reason, suggestions) of replies (reply_id, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            yield pd.DataFrame([(i, *r) for i, t in zip(p["reply_id"], p["text"]) for r in parse_reviews(t)], columns=["reply_id", "title", "kind", "reason", "suggestions"])

    return replies.select("reply_id", "text").mapInPandas(run, f"reply_id {dict(replies.dtypes)['reply_id']}, title string, kind string, reason string, suggestions array<string>")


def without_reviews(c: Column | str) -> Column:
    return F.regexp_replace(X.col(c), "(?s)\\n?REVIEW:.*?(?=\\nFILE:|\\z)", "")


def merge_pages(old: DataFrame, new: DataFrame, combine: Callable[[pd.Series, pd.Series], pd.Series] | None = None) -> DataFrame:
    """(path, text): pages (path, text) of both; where both have a path, front matter of the old with the sources of either and both bodies, or what `combine` makes of the bodies unless it is less than half as long as the old one. Several new pages of one path become one first: the front matter of the first in order of text, with the sources and bodies of all."""
    every = lambda c: F.transform(F.sort_array(F.collect_set("text")), c)
    n = new.where("text is not null").groupBy("path").agg(F.min("text").alias("_first"), F.count_distinct("text").alias("_n"), F.array_distinct(F.flatten(every(lambda t: X.front_list(t, "sources")))).alias("_s"), F.array_join(every(X.page_body), "\n\n").alias("_b"))
    whole = F.concat(F.lit("---\n"), X.strip(F.regexp_replace(X.front_matter("_first"), "(?m)^sources:.*$\\n?", "")), F.lit("\nsources: ["), F.array_join("_s", ", "), F.lit("]\n---\n\n"), F.col("_b"))
    n = n.select("path", F.when(F.col("_n") == 1, F.col("_first")).otherwise(whole).alias("_new"))
    both = old.join(n, "path", "full_outer")
    sources = F.array_join(F.array_distinct(F.concat(X.front_list("text", "sources"), X.front_list("_new", "sources"))), ", ")
    head = F.regexp_replace(X.front_matter("text"), "(?m)^sources:.*$\\n?", "")
    bodies = F.concat_ws("\n\n", X.page_body("text"), X.page_body("_new"))
    if combine is not None:
        made = F.pandas_udf(combine, "string")(X.page_body("text"), X.page_body("_new"))
        bodies = F.when(F.length(made) >= 0.5 * F.length(X.page_body("text")), made).otherwise(bodies)
    joined = F.concat(F.lit("---\n"), X.strip(head), F.lit("\nsources: ["), sources, F.lit("]\n---\n\n"), bodies)
    return both.select("path", F.when(F.col("text").isNotNull() & F.col("_new").isNotNull(), joined).otherwise(F.coalesce("text", "_new")).alias("text"))


def index_lines(index: DataFrame, entries: DataFrame) -> DataFrame:
    """index (slug, line) with the entries whose slug it doesn't have."""
    return index.unionByName(entries.join(index.select("slug"), "slug", "left_anti").dropDuplicates(["slug"]))


def ingested(log: DataFrame) -> DataFrame:
    """(filename): the files that log lines (line) say were taken in."""
    return log.select(F.regexp_extract("line", "- \\[ingest\\] (.+)", 1).alias("filename")).where("filename <> ''").distinct()


def pending(reviews: DataFrame, kind: str | None = None) -> DataFrame:
    rows = reviews.where("not coalesce(dismissed, false)")
    return rows.where(F.col("kind") == kind) if kind else rows


def remove_review(reviews: DataFrame, titles: DataFrame) -> DataFrame:
    return reviews.join(titles.select("title").distinct(), "title", "left_anti")


def render(pages: DataFrame) -> DataFrame:
    """(path, text) of pages (path, kind, title, created, updated, tags, related, sources, body)."""
    listed = lambda c: F.concat(F.lit("["), F.array_join(F.coalesce(c, F.array().cast("array<string>")), ", "), F.lit("]"))
    fields = [("type", "kind"), ("title", "title"), ("created", "created"), ("updated", "updated")]
    head = F.concat_ws("\n", F.lit("---"), *[F.concat(F.lit(f"{k}: "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for k, c in fields], *[F.concat(F.lit(f"{k}: "), listed(k)) for k in ("tags", "related", "sources")], F.lit("---"))
    return pages.select("path", F.concat(head, F.lit("\n\n"), F.coalesce("body", F.lit(""))).alias("text"))


def parsed(pages: DataFrame) -> DataFrame:
    """pages (path, text) as (path, kind, title, tags, related, sources, body); an unknown kind is null."""
    kind = X.front_value("text", "type")
    return pages.select("path", F.when(kind.isin(PAGE_TYPES), kind).alias("kind"), X.front_value("text", "title").alias("title"), *[X.front_list("text", k).alias(k) for k in ("tags", "related", "sources")], X.page_body("text").alias("body"))


def write_rule(path: Column | str) -> Column:
    """How a page that a model wrote goes into the wiki: an index or log page is appended to, an overview replaced, others merged."""
    name = F.regexp_extract(X.col(path), "([^/]*)$", 1)
    return F.when(name.isin("index.md", "log.md"), "append").when(name == "overview.md", "replace").otherwise("merge")


def take_in(pages: DataFrame, written: DataFrame, combine: Callable[[pd.Series, pd.Series], pd.Series] | None = None) -> DataFrame:
    """pages (path, text) after the pages that replies wrote (path, text), each by its write_rule."""
    ruled = written.where("path <> '' and text <> ''").withColumn("rule", write_rule("path"))
    merged = merge_pages(pages, ruled.where("rule = 'merge'").select("path", "text"), combine)
    added = ruled.where("rule = 'append'").groupBy("path").agg(F.array_join(F.sort_array(F.collect_set("text")), "\n").alias("_more"))
    over = ruled.where("rule = 'replace'").groupBy("path").agg(F.max("text").alias("_over"))
    both = merged.join(added, "path", "full_outer").join(over, "path", "full_outer")
    longer = F.when(F.col("text").isNotNull() & F.col("_more").isNotNull(), F.concat(F.regexp_replace("text", "\\n+\\z", ""), F.lit("\n"), F.col("_more")))
    return both.select("path", F.coalesce("_over", longer, "text", "_more").alias("text"))


def ingest_sources(pages: DataFrame, sources: list[tuple[str, str]], ask: Callable[[str, str, dict[str, str]], str], done: set[str] = frozenset()) -> tuple[DataFrame, list[str]]:
    """(pages, names): the wiki after sources (name, text), one after another as each sees what those before it wrote; those in `done` are passed over. ask(name, text, known index lines) replies with FILE blocks. A source is one reply, so this loop grows with the sources, not with the wiki."""
    spark = pages.sparkSession
    taken = []
    for name, text in sources:
        if name in done:
            continue
        known = {r["path"]: r["text"] for r in pages.where(write_rule("path") == "append").toLocalIterator()}
        made = parse_files(ask(name, text, known))
        log = [("log.md", f"- [ingest] {name}")]
        pages = cut(take_in(pages, spark.createDataFrame([*made, *log], "path string, text string")))
        taken.append(name)
    return pages, taken


def flat_tree(nodes: DataFrame, max_depth: int = 64) -> DataFrame:
    """(path, name, depth): the Markdown files of a tree given as nodes (parent, name, is_dir), the root's parent being the empty path. One join a level; a tree deeper than max_depth is an error."""
    nodes = cut(nodes.select("parent", "name", "is_dir"))
    whole = F.when(F.col("parent") == "", F.col("name")).otherwise(F.concat("parent", F.lit("/"), "name"))
    level = nodes.where("parent = ''")
    found = None
    for depth in range(max_depth + 1):
        part = level.where("not is_dir and name like '%.md'").select(whole.alias("path"), "name", F.lit(depth).alias("depth"))
        found = part if found is None else found.unionByName(part)
        dirs = cut(level.where("is_dir").select(whole.alias("parent")).distinct())
        if dirs.isEmpty():
            return found
        level = nodes.join(dirs, "parent", "left_semi")
    raise ValueError("the tree is deeper than max_depth")
