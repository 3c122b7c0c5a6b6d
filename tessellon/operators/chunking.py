"""Documents to parent and child chunks.

Each document is folded on its own, in Arrow batches; nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessellon.functions import text as X
from tessellon.functions import vectors as V

PARENT_MIN, PARENT_MAX = 1000, 2000
CHILD_MAX, CHILD_OVERLAP, CHILD_SHORT, CHILD_CAP, BUFFER = 500, 100, 50, 750, 1000
TABLE = re.compile(r"<table[^>]*>.*?</table>", re.S | re.I)
_WORDS = re.compile(r"[一-鿿]|[a-zA-Z]{2,}|\d+")


class _Table(HTMLParser):
    """Cells of an HTML table with spans written out."""

    def __init__(self):
        super().__init__()
        self.grid: list[dict[int, str]] = []
        self.cell: list[str] | None = None
        self.span = (1, 1)
        self.pending: dict[tuple[int, int], str] = {}

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "tr":
            self.grid.append({})
        elif tag in ("td", "th") and self.grid:
            number = lambda k: max(1, int(re.sub(r"\D", "", a.get(k) or "1") or 1))
            self.span, self.cell = (min(number("rowspan"), 1000), min(number("colspan"), 1000)), []

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.cell is not None:
            text = " ".join("".join(self.cell).split()).replace("|", "\\|")
            r = len(self.grid) - 1
            row = self.grid[r]
            at = 0
            while at in row or (r, at) in self.pending:
                if (r, at) in self.pending:
                    row[at] = self.pending.pop((r, at))
                at += 1
            for j in range(self.span[1]):
                row[at + j] = text
                for i in range(1, self.span[0]):
                    self.pending[r + i, at + j] = text
            self.cell = None
        elif tag == "tr" and self.grid:
            r = len(self.grid) - 1
            for (i, j) in [k for k in self.pending if k[0] == r]:
                self.grid[r].setdefault(j, self.pending.pop((i, j)))


def table_markdown(html: str) -> str:
    """An HTML table as a Markdown table; without cells an empty text."""
    p = _Table()
    p.feed(html)
    rows = [r for r in p.grid if r]
    if not rows:
        return ""
    width = max(max(r) for r in rows) + 1
    line = lambda r: "| " + " | ".join(r.get(i, "") for i in range(width)) + " |"
    return "\n".join([line(rows[0]), "|" + " --- |" * width, *map(line, rows[1:])])


def tables_to_markdown(text: str) -> str:
    return TABLE.sub(lambda m: "\n" + table_markdown(m[0]) + "\n", text)


def split_table(md: str, limit: int) -> list[str]:
    """A Markdown table in parts of at most `limit` characters where rows allow it, each with the header."""
    lines = md.strip().split("\n")
    if len(md) <= limit or len(lines) < 3:
        return [md]
    head, out, part = lines[:2], [], []
    size = base = sum(len(x) + 1 for x in head)
    for row in lines[2:]:
        if part and size + len(row) + 1 > limit:
            out.append("\n".join(head + part))
            part, size = [], base
        part.append(row)
        size += len(row) + 1
    return [*out, "\n".join(head + part)]


def header_sections(text: str) -> list[tuple[tuple[str, str, str], str]]:
    """((H1, H2, H3), body with its headers) for each stretch between headers of the first three levels; fenced code has none."""
    out: list[tuple[tuple[str, str, str], list[str]]] = []
    path, fence = ["", "", ""], False
    for line in text.split("\n"):
        if line.lstrip().startswith(("```", "~~~")):
            fence = not fence
        m = None if fence else re.match(r"\s{0,3}(#{1,3})\s+(.*\S)\s*$", line)
        if m:
            level = len(m[1])
            path = [*path[: level - 1], m[2], *[""] * (3 - level)]
            out.append((tuple(path), [line]))
        elif out:
            out[-1][1].append(line)
        elif line.strip():
            out.append((("", "", ""), [line]))
    return [(h, "\n".join(b).strip()) for h, b in out if "\n".join(b).strip()]


def _is_meta(headers: tuple[str, ...]) -> bool:
    return any(h and (any(w in h.lower() for w in X.META_HEADERS) or re.search(X.TOC_HEADER, h)) for h in headers)


def _join_paths(a: tuple, b: tuple) -> tuple:
    return tuple(x if x == y or not y else (y if not x else f"{x} -> {y}") for x, y in zip(a, b))


def merge_small(sections: list[tuple[tuple, str]]) -> list[tuple[tuple, str]]:
    """Neighbouring sections gathered until PARENT_MIN, never beyond PARENT_MAX; what is left at the end joins the last if it fits."""
    out: list[tuple[tuple, str]] = []
    path, text = None, ""
    for h, body in sections:
        if text and len(text) + len(body) + 2 > PARENT_MAX:
            out.append((path, text))
            path, text = None, ""
        path, text = (h, body) if not text else (_join_paths(path, h), text + "\n\n" + body)
        if len(text) >= PARENT_MIN:
            out.append((path, text))
            path, text = None, ""
    if text:
        if out and len(out[-1][1]) + len(text) + 2 <= PARENT_MAX:
            out[-1] = (_join_paths(out[-1][0], path), out[-1][1] + "\n\n" + text)
        else:
            out.append((path, text))
    return out


def split_large(sections: list[tuple[tuple, str]]) -> list[tuple[tuple, str]]:
    """Sections above PARENT_MAX cut before and after tables where the gathered part would exceed it; text without tables stays whole."""
    out = []
    for h, body in sections:
        if len(body) <= PARENT_MAX:
            out.append((h, body))
            continue
        spots = [0, *[x for m in TABLE.finditer(body) for x in m.span()], len(body)]
        part = ""
        for a, b in zip(spots, spots[1:]):
            piece = body[a:b].strip()
            if not piece:
                continue
            if part and len(part) + len(piece) > PARENT_MAX:
                out.append((h, part))
                part = ""
            part = part + "\n\n" + piece if part else piece
        if part:
            out.append((h, part))
    return out


def absorb_small(sections: list[tuple[tuple, str]]) -> list[tuple[tuple, str]]:
    """Sections under PARENT_MIN added to the one before, the first one to the one after."""
    out: list[tuple[tuple, str]] = []
    carry = None
    for h, body in sections:
        if carry:
            h, body = _join_paths(carry[0], h), carry[1] + "\n\n" + body
            carry = None
        if len(body) < PARENT_MIN and out:
            out[-1] = (_join_paths(out[-1][0], h), out[-1][1] + "\n\n" + body)
        elif len(body) < PARENT_MIN and not out and len(sections) > 1:
            carry = (h, body)
        else:
            out.append((h, body))
    return out + ([carry] if carry else [])


def recursive_split(text: str, limit: int = CHILD_MAX, overlap: int = CHILD_OVERLAP, separators: tuple[str, ...] = ("\n\n", "\n", " ", "")) -> list[str]:
    """Pieces of at most `limit` characters, cut at the coarsest separator that does, with up to `overlap` characters in common."""
    sep = next((s for s in separators if s == "" or s in text), "")
    finer = separators[separators.index(sep) + 1 :]
    parts = list(text) if sep == "" else [p for p in text.split(sep) if p]
    out: list[str] = []
    run: list[str] = []

    def flush():
        joined = sep.join(run).strip()
        if joined:
            out.append(joined)

    def size(xs: list[str]) -> int:
        return sum(map(len, xs)) + len(sep) * max(0, len(xs) - 1)

    for p in parts:
        if len(p) > limit and finer:
            flush()
            run = []
            out += recursive_split(p, limit, overlap, finer)
            continue
        if run and size(run) + len(sep) + len(p) > limit:
            flush()
            while run and (size(run) > overlap or size(run) + len(sep) + len(p) > limit):
                run = run[1:]
        run.append(p)
    flush()
    return out


def _low_quality(text: str) -> bool:
    tags = re.findall(r"<[^>]+>", text)
    words = len(_WORDS.findall(text))
    if not tags:
        return words < 3
    part = sum(map(len, tags)) / max(len(text), 1)
    plain = re.sub(r"<[^>]+>", "", text).strip()
    return (part > 0.5 and len(plain) < 20) or bool(re.search(r"</td>\s*</tr>\s*<tr>\s*<td", text, re.I)) or (len(re.findall(r"</td>", text, re.I)) >= 3 and words < 15) or (part > 0.15 and words < 15)


def children_of(body: str) -> list[str]:
    """A parent's children: tables by themselves, text gathered to BUFFER and split to CHILD_MAX, poor ones dropped, short ones merged."""
    pieces: list[tuple[str, bool]] = []
    spots = [(m.start(), m.end()) for m in TABLE.finditer(body)]
    at = 0
    for a, b in [*spots, (len(body), len(body))]:
        buffer = ""
        for para in re.split(r"\n\s*\n", body[at:a]):
            para = para.strip()
            if not para:
                continue
            if buffer and len(buffer) + len(para) + 2 > BUFFER:
                pieces += [(x, False) for x in ([buffer] if len(buffer) <= CHILD_MAX else recursive_split(buffer))]
                buffer = ""
            buffer = buffer + "\n\n" + para if buffer else para
        if buffer:
            pieces += [(x, False) for x in ([buffer] if len(buffer) <= CHILD_MAX else recursive_split(buffer))]
        if b > a:
            md = table_markdown(body[a:b])
            pieces += [(x, True) for x in split_table(md, BUFFER)] if md else []
        at = b
    return merge_short([(t, table) for t, table in pieces if table or not _low_quality(t)])


def merge_short(pieces: list[tuple[str, bool]]) -> list[str]:
    """Texts under CHILD_SHORT become the caption of a table after them, or join the text before or after them if the result stays within CHILD_CAP."""
    out: list[tuple[str, bool]] = []
    i = 0
    while i < len(pieces):
        t, table = pieces[i]
        if not table and len(t) < CHILD_SHORT:
            nxt = pieces[i + 1] if i + 1 < len(pieces) else None
            if nxt and nxt[1]:
                out.append((t + "\n\n" + nxt[0], True))
                i += 2
                continue
            if out and not out[-1][1] and len(out[-1][0]) + len(t) + 2 <= CHILD_CAP:
                out[-1] = (out[-1][0] + "\n\n" + t, False)
                i += 1
                continue
            if nxt and not nxt[1] and len(nxt[0]) + len(t) + 2 <= CHILD_CAP:
                out.append((t + "\n\n" + nxt[0], False))
                i += 2
                continue
        out.append((t, table))
        i += 1
    return [t for t, _ in out]


def parents_of(markdown: str) -> list[tuple[str, str]]:
    """(path, body) of a document's parents."""
    sections = [(h, b) for h, b in header_sections(markdown) if not _is_meta(h)]
    sections = absorb_small(split_large(merge_small(sections)))
    return [(" / ".join(x for x in h if x), b) for h, b in sections]


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()[:16]


SCHEMA = "doc_id string, chunk_id string, parent_id string, chunk_type string, ordinal int, path string, content string, doc_hash string, table_type string"


def chunk(documents: DataFrame, tables_apart: bool = False) -> DataFrame:
    """Parents and children of documents (doc_id, content) in SCHEMA.

    A parent is headed by the path of its headers and has its tables in
    Markdown. tables_apart: each HTML table is a parent of its own with one
    child, marked with its type. Children are numbered through the document
    after merging, so ids are unique. Null and empty contents give no rows.
    """

    def rows(doc: str, text: str) -> Iterator[tuple]:
        n = t = 0
        if tables_apart:
            for m in TABLE.finditer(text):
                md = table_markdown(m[0])
                if md:
                    kind = next((k for k, ws in X.TABLE_TYPES.items() if sum(w.lower() in "".join(md.split("\n")[:3]).lower() for w in ws) >= 2), None)
                    yield doc, f"{doc}_t{t}", None, "parent", t, "", md, _hash(md), kind
                    yield doc, f"{doc}_tc{t}", f"{doc}_t{t}", "child", t, "", md, _hash(md), kind
                    t += 1
            text = TABLE.sub("\n", text)
        for i, (path, body) in enumerate(parents_of(text)):
            pid = f"{doc}_p{i}"
            head = f"[路径: {path}]\n\n" if path else ""
            full = head + tables_to_markdown(body)
            yield doc, pid, None, "parent", i, path, full, _hash(full), None
            for c in children_of(body):
                yield doc, f"{doc}_c{n}", pid, "child", n, path, c, _hash(c), None
                n += 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            yield pd.DataFrame([r for d, c in zip(p["doc_id"], p["content"]) for r in rows(d, c)], columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return documents.where("doc_id is not null and content <> ''").select(F.col("doc_id").cast("string").alias("doc_id"), "content").mapInPandas(run, SCHEMA)


def sections(documents: DataFrame) -> DataFrame:
    """(doc_id, section_no, h1, h2, h3, body) of documents (doc_id, content): header_sections as rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            yield pd.DataFrame([(d, i, *h, b) for d, c in zip(p["doc_id"], p["content"]) for i, (h, b) in enumerate(header_sections(c))], columns=["doc_id", "section_no", "h1", "h2", "h3", "body"])

    return documents.where("content <> ''").select("doc_id", "content").mapInPandas(run, f"doc_id {dict(documents.dtypes)['doc_id']}, section_no int, h1 string, h2 string, h3 string, body string")


def tables_of(documents: DataFrame) -> DataFrame:
    """(doc_id, html, markdown): the HTML tables of documents (doc_id, content); those without cells have none."""

    @F.pandas_udf("string")
    def convert(html: pd.Series) -> pd.Series:
        return html.map(table_markdown)

    found = documents.select("doc_id", F.explode(F.regexp_extract_all("content", F.lit("(?is)(<table[^>]*>.*?</table>)"), F.lit(1))).alias("html"))
    return found.withColumn("markdown", convert("html")).where("markdown <> ''")


def sentence_groups(documents: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, group_no, text): each document's sentences in groups of `size`."""
    rows = documents.select("doc_id", F.posexplode(X.sentences("content")).alias("i", "s"))
    parts = rows.groupBy("doc_id", F.floor(F.col("i") / size).cast("int").alias("group_no")).agg(F.sort_array(F.collect_list(F.struct("i", "s"))).alias("p"))
    return parts.select("doc_id", "group_no", F.array_join(F.transform("p", lambda x: x["s"]), " ").alias("text"))


def semantic_breaks(groups: DataFrame, below: float = 0.7) -> DataFrame:
    """(doc_id, group_no, segment): groups (doc_id, group_no, vec) numbered by segments, a new one where neighbours' cosine lies under `below`; a missing vector breaks nothing."""
    w = Window.partitionBy("doc_id").orderBy("group_no")
    broke = F.coalesce(V.cosine(F.col("vec"), F.lag("vec").over(w)) < below, F.lit(False))
    return groups.withColumn("_b", broke.cast("int")).withColumn("segment", F.sum("_b").over(w)).select("doc_id", "group_no", "segment")


def semantic_chunks(documents: DataFrame, embed: Callable[[pd.Series], pd.Series], below: float = 0.7) -> DataFrame:
    """(doc_id, segment, content): documents cut where the meaning of their sentence groups changes; embed maps texts to vectors."""
    groups = sentence_groups(documents).withColumn("vec", F.pandas_udf(embed, "array<float>")("text"))
    rows = groups.join(semantic_breaks(groups), ["doc_id", "group_no"])
    parts = rows.groupBy("doc_id", "segment").agg(F.sort_array(F.collect_list(F.struct("group_no", "text"))).alias("p"))
    return parts.select("doc_id", "segment", F.array_join(F.transform("p", lambda x: x["text"]), " ").alias("content"))


def summaries(parents: DataFrame, summarise: Callable[[pd.Series], pd.Series] | None = None) -> DataFrame:
    """(chunk_id, summary) of parents (chunk_id, content); without a summariser the first hundred characters."""
    s = X.snippet("content", 100) if summarise is None else F.pandas_udf(summarise, "string")("content")
    return parents.select("chunk_id", s.alias("summary"))


def document_summaries(parents: DataFrame) -> DataFrame:
    """(doc_id, chunk_id, content): one summary for each document whose parents (doc_id, chunk_id, summary) have two summaries of together fifty characters at least."""
    rows = parents.where("summary <> ''").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("chunk_id", "summary"))).alias("p"), F.sum(F.length("summary")).alias("n"))
    return rows.where("size(p) >= 2 and n >= 50").select("doc_id", F.concat("doc_id", F.lit("_ds0")).alias("chunk_id"), F.array_join(F.transform("p", lambda x: x["summary"]), "\n").alias("content"))
