"""Repairing text of scanned pages.

Lines are told apart with SQL windows: with digits masked, lines that repeat
at page tops are running headers, and numbers that rise from page to page are
page numbers. What remains is reflowed into paragraphs, mending words cut at
line ends. Words are then grouped by the skeleton that a scanner confuses
them in; a rare form is replaced by the frequent form of its group that its
own text or its neighbours support.

All windows stand on one partitioning, that of the texts, which are written
once as repaired lines; words are counted by form before anything about their
neighbours is looked at, and neighbours only where a form is in doubt.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessellon.llm import filters
from tessellon.llm.glyphs import EXACT
from tessellon.llm.tokens import IGNORABLE, mix
from tessellon.plans.lineage import cut, keep

# What a scanner confuses, written as the strokes both have; longer ones stand for several letters.
STROKES = {"m": "rn", "d": "ci", "h": "ii", "b": "ii", "u": "ii", "l": "i", "1": "i", "|": "i", "!": "i", "0": "o", "e": "c", "f": "t", "8": "ii", "5": "s", "2": "z", "9": "g", "6": "ii"}
# Characters of one group look alike.
ALIKE = ("天夭", "人入", "已己巳", "的旳", "测侧", "为力", "土士", "日曰", "待侍", "推椎", "项顶", "第笫", "处外", "见贝", "未末", "干千", "大太", "目自", "因困", "今令", "历厉", "另男", "广厂", "几儿", "刀刁", "住往", "折拆", "候侯", "治冶", "遗遣", "辨辩", "准淮", "戊戌", "免兔", "鸟乌", "气汽", "拔拨", "幕墓", "末朱", "无元", "王玉", "间问", "末术", "己乙")

_CJK = "\\u3400-\\u4dbf\\u4e00-\\u9fff"
_NUMBER = f"(?:[^\\p{{L}}\\p{{N}}\\s]{{0,2}} ?#(?: ?/ ?#)? ?[^\\p{{L}}\\p{{N}}\\s]{{0,2}}|[pP]\\. ?#|[Pp]age #(?: of #)?|第 ?# ?页(?: ?共 ?# ?页)?)"
_SURE = "(?i)^(?:page #(?: of #)?|第 ?# ?页(?: ?共 ?# ?页)?)$"
_SHAPE = "^(?:#{1,6} |\\||<|[-*+•] |[0-9]+[.)、] )"
#: Stands in a text where a line's end cut a word; a character for private use.
CUT = ""
_LETTERS = "0-9A-Za-z|!À-ÖØ-öø-ʯ̀-ԯԱ-᳿Ḁ-῿"
_IDEO = "㐀-䶿一-鿿"
#: Words, single ideographs and line breaks; a number between an ideograph and a name is a word of its own.
_WORD = f"(?<=[{_IDEO}])[0-9]+(?=[A-Z])|[{_LETTERS}]+"
TOKEN = re.compile(f"{_WORD}|[{_IDEO}]|\n")
_DASHED = re.compile(f"[{_LETTERS}]+(?:-[{_LETTERS}]+)+")
_SIGNS = "".join(dict.fromkeys("".join(ALIKE)))
_HEADS = {c: g[0] for g in reversed(ALIKE) for c in g}
_SPOT = re.compile(f"(?=(.[{_SIGNS}].))")


def lines_of(documents: DataFrame) -> DataFrame:
    """(doc_id, no, s, tail, head, number): the lines of documents (doc_id, content), each doc_id once.

    s: the line, trimmed, in one form; tail: the masked page number at its
    end, if it could be one; head: the rest; number: the tail's first number.
    """
    look = "".join(EXACT)
    wide = [c for c in range(0xFF10, 0xFF5B) if chr(c).isalnum()]
    # texts of plain characters are in one form already
    odd = F.col("content").rlike(f"[^\\x00-\\x7e{_CJK}\\u3001\\u3002\\u300a-\\u3011\\uff01\\uff08\\uff09\\uff0c\\uff1a\\uff1b\\uff1f\\u2014\\u2018-\\u201d\\u2026]")
    text = F.translate("content", look + "".join(map(chr, wide)), "".join(EXACT.values()) + "".join(chr(c - 0xFEE0) for c in wide))
    text = F.regexp_replace(text, "[\\u00ad\\u2010\\u00ac]([ \\t]*\\r?\\n)", "-$1")
    text = F.regexp_replace(text, f"[{IGNORABLE}{CUT}]", "")
    text = F.regexp_replace(text, "[\\u00a0\\u2000-\\u200a\\u202f\\u3000]", " ")
    text = F.translate(F.when(odd, text).otherwise(F.col("content")), "\t\r", " ")
    one = documents.where("doc_id is not null and content <> ''").groupBy("doc_id").agg(F.min("content").alias("content"))
    rows = one.select("doc_id", F.posexplode(F.split(text, "\n")).alias("no", "line")).select("doc_id", "no", F.trim("line").alias("s"))
    # a page number ends in a digit or shortly behind one
    masked = F.regexp_replace("s", "[0-9]+", "#")
    tail = F.when(F.substring("s", -8, 8).rlike("[0-9]"), F.regexp_extract(masked, f"(?:^|\\s{{2,}})({_NUMBER})$", 1)).otherwise("")
    rows = rows.withColumn("tail", tail).withColumn("head", F.when(F.col("tail") == "", F.col("s")).otherwise(F.rtrim(F.regexp_replace("s", "(?:^|\\s{2,})\\S(?:[^\\s]| (?! ))*$", ""))))
    return rows.withColumn("number", F.when(F.col("tail") != "", F.expr("try_cast(regexp_extract(substring(s, length(head) + 1), '([0-9]+)', 1) as bigint)")))


def marked_lines(documents: DataFrame) -> DataFrame:
    """lines_of with is_number and is_header, by windows over each text's lines."""
    rows = lines_of(documents)
    w = Window.partitionBy("doc_id").orderBy("no")
    before = F.lag(F.struct("s", "tail")).over(w)
    rows = rows.withColumn("top", F.coalesce((before["s"] == "") | (before["tail"] != ""), F.lit(True)) & (F.col("s") != ""))
    # page numbers: the same mask again with a number one or two higher, and other lines in between
    same = Window.partitionBy("doc_id", "tail")
    rows = rows.withColumn("rise", F.col("number") - F.lag("number").over(same.orderBy("no"))).withColumn("apart", F.col("no") - F.lag("no").over(same.orderBy("no")))
    good = F.sum(F.when((F.col("rise").between(1, 2)) & (F.col("apart") > 2), 1).otherwise(0)).over(same)
    n = F.count("*").over(same)
    rows = rows.withColumn("is_number", (F.col("tail") != "") & ((good >= F.greatest(F.lit(1), F.floor((n - 1) / 2))) | F.col("tail").rlike(_SURE)))
    # running headers: a short line at a page top that another such line of the text repeats or begins with
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.when(F.col("is_number"), F.col("head")).otherwise(F.col("s"))), "[0-9]+", "#"), "[^\\p{L}\\p{M}#]+", " "))
    can = F.col("top") & (F.length("s") <= 100)
    bare = F.when(can, F.when(~F.col("s").rlike("^(?:#|\\||<|[-*+•] |[0-9]+[.)、] )") & ~F.col("s").rlike("[.。;；,，:：!！?？]$"), bare))
    rows = rows.withColumn("bare", bare).withColumn("bare", F.when(F.length("bare") >= 4, F.col("bare")))
    # sorted, what begins with a line stands right behind it
    by = Window.partitionBy("doc_id").orderBy("bare")
    rows = rows.withColumn("after", F.lead("bare").over(by)).withColumn("twice", (F.lag("bare").over(by) == F.col("bare")) | (F.lead("bare").over(by) == F.col("bare")))
    begins = F.when((F.col("after") != F.col("bare")) & F.col("after").startswith(F.col("bare")), F.col("bare"))
    rows = rows.withColumn("begins", F.collect_set(begins).over(Window.partitionBy("doc_id")))
    headed = F.col("twice") | F.exists("begins", lambda b: F.col("bare").startswith(b))
    return rows.withColumn("is_header", F.coalesce(headed, F.lit(False))).select("doc_id", "no", "s", "head", "is_number", "is_header")


def reflowed(documents: DataFrame) -> DataFrame:
    """(doc_id, text, has_header, has_number): documents as paragraphs with a blank line between them, without what the pages added; CUT stands where a line's end cut a word.

    A blank line ends a paragraph unless it stands at a page break. In a text
    whose lines are wrapped a line is followed by the next one in its
    paragraph; in others, and around headings, tables and lists, each line is
    a paragraph.
    """
    rows = marked_lines(documents)
    w = Window.partitionBy("doc_id").orderBy("no")
    gone = F.col("is_header") | (F.col("is_number") & (F.col("head") == ""))
    rows = rows.withColumn("gone", gone).withColumn("g", F.when(F.col("s") != "", gone))
    # blank lines beside what went away are the page break's own
    near = lambda f: F.coalesce(F.expr(f"{f}(g) ignore nulls over (partition by doc_id order by no)"), F.lit(False))
    rows = rows.withColumn("blank", (F.col("s") == "") & ~near("lag") & ~near("lead"))
    rows = rows.withColumn("blanks", F.sum(F.col("blank").cast("int")).over(w)).withColumn("stays", (F.col("s") != "") & ~F.col("gone"))
    own = Window.partitionBy("doc_id", "stays")
    rows = rows.withColumn("shape", F.col("stays") & F.col("s").rlike(_SHAPE))
    rows = rows.withColumn("width", F.max(F.when(~F.col("shape"), F.length("s"))).over(own))
    before = F.lag(F.struct("blanks", "shape", "s")).over(own.orderBy("no"))
    joins = (F.col("width") <= 110) & ~F.col("shape") & ~before["shape"] & (before["blanks"] == F.col("blanks")) & ((F.length(before["s"]) >= 0.6 * F.col("width")) | before["s"].endswith("-"))
    rows = rows.withColumn("joins", F.coalesce(joins, F.lit(False)))
    after = F.lead(F.struct("joins", F.substring("s", 1, 1).alias("c"))).over(own.orderBy("no"))
    rows = rows.withColumn("on", F.coalesce(after["joins"], F.lit(False))).withColumn("next_c", after["c"])
    end = F.substring("s", -1, 1)
    ideo = f"[{_CJK}\\u3000-\\u303f\\uff00-\\uffef]"
    # a text in ideographs is wrapped anywhere, also inside its few words of letters
    mostly = F.length(F.regexp_replace("s", f"[^{_CJK}]", "")) * 3 > F.length("s")
    piece = (
        F.when(~F.col("on"), F.concat("s", F.lit("\n\n")))
        .when((end == "-") & F.col("s").rlike("[\\p{L}\\p{M}]-$") & F.col("next_c").rlike("[\\p{Ll}\\p{M}]"), F.concat(F.expr("substring(s, 1, length(s) - 1)"), F.lit(CUT)))
        .when(end.rlike(ideo) | F.col("next_c").rlike(ideo) | mostly, F.col("s"))
        .otherwise(F.concat("s", F.lit(" ")))
    )
    parts = F.sort_array(F.collect_list(F.when(F.col("stays"), F.struct("no", piece.alias("piece")))))
    whole = rows.groupBy("doc_id").agg(parts.alias("p"), F.max("is_header").alias("has_header"), F.max("is_number").alias("has_number"))
    return whole.select("doc_id", F.rtrim(F.array_join(F.col("p.piece"), ""), F.lit("\n ")).alias("text"), "has_header", "has_number")


def skeleton(word: str) -> str:
    """What a scanner makes of a word's strokes."""
    s = word.lower().translate(_STROKES)
    # letters made of letters: what came out is split on
    return s.replace("li", "ii").replace("cl", "ci")


_STROKES = str.maketrans(STROKES)


def _is_word(t: str) -> bool:
    return 2 <= len(t) <= 40 and not t.isdigit() and any("a" <= c <= "z" or "A" <= c <= "Z" for c in t)


class _Words(dict):
    """Numbers for the tokens of a batch, with what is known of each."""

    def __init__(self):
        super().__init__()
        self.names: list[str] = []
        self.skeletons: list[str | None] = []

    def __missing__(self, t: str) -> int:
        self[t] = n = len(self.names)
        self.names.append(t)
        self.skeletons.append(skeleton(t) if _is_word(t) else None)
        return n

    def add(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of all tokens, number of the text of each); a break stands between texts."""
        found = [[self[t] for t in TOKEN.findall(x + "\n")] for x in texts]
        n = [len(x) for x in found]
        return np.array([t for x in found for t in x], np.int64), np.repeat(np.arange(len(found)), n)

    def is_word(self) -> np.ndarray:
        return np.array([s is not None for s in self.skeletons], bool)

    def hashes(self, before: str = "") -> np.ndarray:
        """Hashes of the tokens or, with a mark of the side, of what they are as neighbours: skeletons, as they may be misread themselves, and numbers as #."""
        if not before:
            return np.array([filters.hash_of(t) for t in self.names], np.uint64)
        return np.array([filters.hash_of(before + by) for by in self.neighbours()], np.uint64)

    def neighbours(self) -> list[str]:
        return ["#" if t.isdigit() else t if s is None else s for t, s in zip(self.names, self.skeletons)]


def _may_read(word: str, right: str) -> bool:
    """Whether right can be what was read as word, for two forms of one skeleton."""
    if word.lower() == right.lower() or re.search("[0-9|!]", right):
        return False
    return not word[0].isalpha() or word[0].isupper() == right[0].isupper()


def _spots(text: str) -> list[str]:
    """Three characters around each sign that has look-alikes; paragraphs begin with ^ and end with $, numbers are one #."""
    if text.isascii():
        return []
    return _SPOT.findall("^" + re.sub("[0-9]+", "#", text).replace("\n\n", "$\n\n^") + "$")


def _rivals(words: _Words, text: np.ndarray, word: np.ndarray, n: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(text, word, right word): forms of one skeleton in one text of which the right one stands there more often; text, word and n say how often each text holds each word."""
    order_of = {s: i for i, s in enumerate(dict.fromkeys(s for s in words.skeletons if s is not None))}
    of = np.array([order_of.get(s, -1) for s in words.skeletons], np.int64)
    key = text * (len(order_of) + 1) + of[word]
    order = np.argsort(key, kind="stable")
    key, text, word, n = key[order], text[order], word[order], n[order]
    first = np.nonzero(np.concatenate([[True], key[1:] != key[:-1]]))[0] if len(key) else np.empty(0, np.int64)
    last = np.append(first[1:], len(key))
    for a, b in zip(first[last - first > 1], last[last - first > 1]):
        for i in range(a, b):
            for j in range(a, b):
                if n[j] > n[i] and _may_read(words.names[word[i]], words.names[word[j]]):
                    yield int(text[i]), int(word[i]), int(word[j])


_COUNTS = "kind string, word string, skeleton string, right_word string, n bigint, m bigint"


def counted(texts: DataFrame) -> DataFrame:
    """(kind, word, skeleton, right_word, n, m) of texts (doc_id, text), added up by batches.

    w: a word, how often it stands and in how many texts; h: a compound with
    hyphens, lower case; s: a spot; g: a pair of forms of one skeleton in one
    text of which right_word stands there more often: n texts.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            plain = [t.replace(CUT, "") for t in p["text"]]
            words = _Words()
            token, text = words.add(plain)
            keep_it = words.is_word()[token]
            size = max(len(words.names), 1)
            held, n = np.unique(text[keep_it] * size + token[keep_it], return_counts=True)
            word = held % size
            total, df = np.bincount(word, weights=n, minlength=size).astype(np.int64), np.bincount(word, minlength=size)
            rows = [("w", words.names[i], words.skeletons[i], None, int(total[i]), int(df[i])) for i in np.nonzero(df)[0].tolist()]
            pairs = Counter((words.names[w], words.names[r]) for _, w, r in _rivals(words, held // size, word, n))
            dashed = Counter(d.lower() for t in plain if "-" in t for d in _DASHED.findall(t))
            spots = Counter(s for t in plain for s in _spots(t))
            rows += [("h", w, None, None, k, 0) for w, k in dashed.items()] + [("s", w, None, None, k, 0) for w, k in spots.items()] + [("g", w, None, r, k, 0) for (w, r), k in pairs.items()]
            yield pd.DataFrame(rows, columns=["kind", "word", "skeleton", "right_word", "n", "m"])

    made = texts.select("text").mapInPandas(run, _COUNTS)
    return keep(made.groupBy("kind", "word", "right_word").agg(F.first("skeleton", ignorenulls=True).alias("skeleton"), F.sum("n").alias("n"), F.sum("m").alias("m")))


def _hashes(rows: DataFrame, *columns: str) -> DataFrame:
    """(h): hashes of the words in columns, or of the pairs they make."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            h = np.zeros(len(p), np.uint64)
            for c in columns:
                h = mix(h + np.array([filters.hash_of(w) for w in p[c]], np.uint64))
            yield pd.DataFrame({"h": h.view(np.int64)})

    return rows.select(*columns).mapInPandas(run, "h bigint")


def misread(texts: DataFrame, counts: DataFrame, ratio: int = 8) -> tuple[DataFrame, DataFrame]:
    """(words, signs): (doc_id, word, right_word) and (doc_id, spot, right_spot) of texts (doc_id, text) that are a scanner's reading of others.

    A form is misread if its skeleton group has a form, alike in its first
    letter's case, that occurs at least `ratio` times as often in all texts
    and next to one of the word's neighbours, or if in most of the texts that
    hold it the other stands more often, although few texts have the other at
    all. A sign between two others is misread
    if all texts have one of its look-alikes there `ratio` times as often.
    """
    forms = counts.where("kind = 'w'").select("skeleton", "word", "n", F.col("m").alias("df"))
    case = lambda c: F.substring(c, 1, 1).rlike("\\p{Lu}")
    letter = F.substring("word", 1, 1).rlike("\\p{L}")
    other = forms.select("skeleton", F.col("word").alias("right_word"), F.col("n").alias("rn"), F.col("df").alias("rdf")).where("not right_word rlike '[0-9|!]'")
    options = forms.join(other, "skeleton").where("lower(word) <> lower(right_word) and rn > n").where(~letter | (case("word") == case("right_word")))
    local = counts.where("kind = 'g'").select("word", "right_word", F.col("n").alias("beside"))
    # forms of one text: in half of the word's texts at least, and far more often than chance brings them together
    drawn = (F.col("beside") * 2 >= F.col("df")) & (F.col("beside") * texts.count() >= 4 * F.col("df") * F.col("rdf"))
    options = options.join(local, ["word", "right_word"], "left").select("word", "right_word", "rn", (F.col("rn") >= ratio * F.col("n")).alias("common"), F.coalesce(drawn, F.lit(False)).alias("local"))
    options = cut(options.where("common or local"))
    fixes = cut(_sign_fixes(counts.where("kind = 's'").select(F.col("word").alias("spot"), "n"), ratio))
    doubtful = filters.build(_hashes(options.select("word").distinct().union(fixes.select("spot")), "word"))
    kept = texts.sparkSession.sparkContext.broadcast(doubtful)
    kind = dict(texts.dtypes)["doc_id"]

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            plain = [t.replace(CUT, "") for t in p["text"]]
            words = _Words()
            token, text = words.add(plain)
            doubted = np.zeros(len(words.names), bool)
            doubted[filters.may_hold(kept.value, mix(words.hashes()))] = True
            doubted &= words.is_word()
            size = max(len(words.names), 1)
            rows = []
            held, n = np.unique(text[words.is_word()[token]] * size + token[words.is_word()[token]], return_counts=True)
            better: dict[tuple[int, int], list[str]] = {}
            some = np.isin(held // size, text[doubted[token]])
            for t, w, r in _rivals(words, held[some] // size, held[some] % size, n[some]):
                better.setdefault((t, w), []).append(words.names[r])
            by, keys = words.neighbours(), p["doc_id"].tolist()
            sides: dict[tuple[int, int], set[str]] = {}
            at = np.nonzero(doubted[token])[0]
            ends = (np.maximum(at - 1, 0), np.minimum(at + 1, max(len(token) - 1, 0)))
            for t, w, a, b in zip(text[at].tolist(), token[at].tolist(), token[ends[0]].tolist(), token[ends[1]].tolist()):
                sides.setdefault((t, w), set()).update(x for x in ("<" + by[a], ">" + by[b]) if x[1] != "\n")
            rows = [(keys[t], "w", words.names[w], sorted(s), better.get((t, w), [])) for (t, w), s in sides.items()]
            spots = [(t, s) for t, x in enumerate(plain) for s in set(_spots(x))]
            hit = filters.may_hold(kept.value, mix(np.array([filters.hash_of(s) for _, s in spots], np.uint64))).tolist() if spots else []
            rows += [(keys[spots[i][0]], "s", spots[i][1], [], []) for i in hit]
            yield pd.DataFrame(rows, columns=["doc_id", "kind", "word", "sides", "better"])

    found = keep(texts.select("doc_id", "text").mapInPandas(look, f"doc_id {kind}, kind string, word string, sides array<string>, better array<string>"))
    words = found.where("kind = 'w'").join(options, "word")
    in_text = words.where(F.col("local") & F.array_contains("better", F.col("right_word"))).select("doc_id", "word", "right_word", "rn")
    near = words.where("common").select("doc_id", "word", "right_word", "rn", F.explode("sides").alias("side"))
    # both forms' counts beside the same neighbours; a common word of its own is used to its place
    asked = near.select(F.explode(F.array("right_word", "word")).alias("word"), "side").distinct()
    beside = _beside(texts, asked)
    count = lambda c: beside.select(F.col("word").alias(c), "side", F.col("n").alias(f"n_{c}"))
    backed = near.join(count("right_word"), ["right_word", "side"], "left").join(count("word"), ["word", "side"], "left")
    backed = backed.groupBy("doc_id", "word", "right_word", "rn").agg(F.sum("n_right_word").alias("r"), F.sum("n_word").alias("k")).where(F.col("r") >= ratio / 2 * F.coalesce("k", F.lit(0)))
    best = backed.select("doc_id", "word", "right_word", "rn").unionByName(in_text).groupBy("doc_id", "word").agg(F.max_by("right_word", F.struct("rn", "right_word")).alias("right_word"))
    signs = found.where("kind = 's'").select("doc_id", F.col("word").alias("spot")).join(fixes, "spot").select("doc_id", "spot", "right_spot")
    return best, signs


def _beside(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """(word, side, n): how often texts have the words of asked (word, side) beside those neighbours."""
    asked = cut(asked)
    kept = texts.sparkSession.sparkContext.broadcast(filters.build(_hashes(asked, "word", "side")))

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            words = _Words()
            token, _ = words.add([t.replace(CUT, "") for t in p["text"]])
            if len(token) < 2:
                continue
            own, is_word = mix(words.hashes()), words.is_word()
            names = np.array(words.names, dtype=object)
            by = np.array(words.neighbours(), dtype=object)
            for mark, form, near in (("<", token[1:], token[:-1]), (">", token[:-1], token[1:])):
                form, near = form[is_word[form]], near[is_word[form]]
                left = filters.may_hold(kept.value, mix(own[form] + words.hashes(mark)[near]))
                pair, n = np.unique(form[left] * len(names) + near[left], return_counts=True)
                yield pd.DataFrame({"word": names[pair // len(names)], "side": mark + by[pair % len(names)], "n": n})

    got = texts.select("text").mapInPandas(look, "word string, side string, n bigint").where("side not in ('<\n', '>\n')")
    return cut(got.join(asked, ["word", "side"], "left_semi").groupBy("word", "side").agg(F.sum("n").alias("n")))


def _sign_fixes(spots: DataFrame, ratio: int) -> DataFrame:
    """(spot, right_spot) for spots (spot, n) of which another look-alike is by far the usual one."""
    norm = F.translate("spot", "".join(_HEADS), "".join(_HEADS.values()))
    forms = spots.withColumn("group", norm).withColumn("c", F.substring("spot", 2, 1))
    by_sign = forms.groupBy("group", "c").agg(F.sum("n").alias("n"))
    top = by_sign.groupBy("group").agg(F.max(F.struct("n", "c")).alias("top")).select("group", F.col("top.n").alias("most"), F.col("top.c").alias("right"))
    wrong = forms.join(by_sign.select("group", "c", F.col("n").alias("all_n")), ["group", "c"]).join(top, "group").where((F.col("c") != F.col("right")) & (F.col("most") >= ratio * F.col("all_n")))
    return wrong.select("spot", F.concat(F.substring("spot", 1, 1), F.col("right"), F.substring("spot", 3, 1)).alias("right_spot"))


def cut_words(texts: DataFrame, counts: DataFrame) -> DataFrame:
    """(doc_id, left, right, keeps): the words that line ends cut in texts; keeps: whether all texts write it with a hyphen more often than in one."""
    word = "[\\p{L}\\p{M}]+(?:-[\\p{L}\\p{M}]+)*"
    found = texts.where(F.col("text").contains(CUT)).select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"({word}{CUT}[\\p{{Ll}}\\p{{M}}]+)"), F.lit(1))).alias("x"))
    ends = found.select("doc_id", F.split_part("x", F.lit(CUT), F.lit(1)).alias("left"), F.split_part("x", F.lit(CUT), F.lit(2)).alias("right"))
    ends = ends.withColumn("joined", F.lower(F.concat("left", "right"))).withColumn("dashed", F.lower(F.concat("left", F.lit("-"), "right")))
    one = counts.where("kind = 'w'").groupBy(F.lower("word").alias("joined")).agg(F.sum("n").alias("nj"))
    two = counts.where("kind = 'h'").select(F.col("word").alias("dashed"), F.col("n").alias("nd"))
    asked = ends.groupBy("joined", "dashed").agg(F.count("*").alias("cuts"))
    # the cut words themselves were counted in one
    known = asked.join(two, "dashed").join(one, "joined", "left").where(F.col("nd") > F.coalesce("nj", F.lit(0)) - F.col("cuts"))
    return ends.join(known.select("joined", "dashed", F.lit(True).alias("keeps")), ["joined", "dashed"], "left").select("doc_id", "left", "right", F.coalesce("keeps", F.lit(False)).alias("keeps"))


def _parts(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    texts = keep(reflowed(documents))
    return texts, counted(texts)


def defects(documents: DataFrame) -> DataFrame:
    """(doc_id, defect): what scanning did to documents (doc_id, content): broken_word, misread, running_header, page_number.

    Null ids, null and empty contents have none; of a repeated doc_id the
    smallest content counts.
    """
    texts, counts = _parts(documents)
    words, signs = misread(texts, counts)
    found = [
        (cut_words(texts, counts).where("not keeps"), "broken_word"),
        (words.select("doc_id").union(signs.select("doc_id")), "misread"),
        (texts.where("has_header"), "running_header"),
        (texts.where("has_number"), "page_number"),
    ]
    out = None
    for rows, name in found:
        part = rows.select("doc_id", F.lit(name).alias("defect"))
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def _mended(text: str, fixes: dict[str, str], spots: list[tuple[str, str]], keeps: set[str]) -> str:
    if CUT in text:
        text = re.sub(f"([^\\W\\d_]+){CUT}([^\\W\\d_]+)", lambda m: m[1] + ("-" if f"{m[1]}-{m[2]}".lower() in keeps else "") + m[2], text).replace(CUT, "")
    if fixes:
        text = re.sub(_WORD, lambda m: fixes.get(m[0], m[0]), text)
    for spot, right in spots:
        # a spot's edges are contexts: # any number, ^ and $ a paragraph's begin and end
        left = {"#": "(?<=[0-9])", "^": "(?:(?<=\n\n)|(?<![\\s\\S]))"}.get(spot[0], f"(?<={re.escape(spot[0])})")
        after = {"#": "(?=[0-9])", "$": "(?=\n\n|\\Z)"}.get(spot[2], f"(?={re.escape(spot[2])})")
        text = re.sub(left + re.escape(spot[1]) + after, right[1], text)
    return text


def repaired(documents: DataFrame) -> DataFrame:
    """(doc_id, text): documents in continuous paragraphs, without what the pages added or spoiled."""
    texts, counts = _parts(documents)
    words, signs = misread(texts, counts)
    fixes = words.groupBy("doc_id").agg(F.collect_list(F.struct("word", "right_word")).alias("fixes"))
    spots = signs.groupBy("doc_id").agg(F.collect_list(F.struct("spot", "right_spot")).alias("spots"))
    keeps = cut_words(texts, counts).where("keeps").groupBy("doc_id").agg(F.collect_set(F.lower(F.concat("left", F.lit("-"), "right"))).alias("keeps"))

    @F.pandas_udf("string")
    def mend(text: pd.Series, fixes: pd.Series, spots: pd.Series, keeps: pd.Series) -> pd.Series:
        pairs = lambda xs, a, b: [(x[a], x[b]) for x in xs] if xs is not None else []
        return pd.Series([_mended(t, dict(pairs(f, "word", "right_word")), pairs(s, "spot", "right_spot"), set(k) if k is not None else set()) for t, f, s, k in zip(text, fixes, spots, keeps)])

    rows = texts.join(fixes, "doc_id", "left").join(spots, "doc_id", "left").join(keeps, "doc_id", "left")
    touched = F.col("fixes").isNotNull() | F.col("spots").isNotNull() | F.col("text").contains(CUT)
    done = rows.where(touched).select("doc_id", mend("text", "fixes", "spots", "keeps").alias("text"))
    return done.unionByName(rows.where(~touched).select("doc_id", "text"))
