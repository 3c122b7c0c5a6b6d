"""Understanding queries: keywords, weights, synonyms, clauses."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessellon.functions import text as X
from tessellon.functions import vectors as V

# Question phrases, stop words and series that stay although short.
QUESTION_ZH = "是*(怎么办|什么样的|哪家|一下|那家|请问|啥样|咋样了|什么时候|何时|何地|何人|是否|是不是|多少|哪里|怎么|哪儿|怎么样|如何|哪些|是啥|啥是|啊|吗|呢|吧|咋|什么|有没有|呀|谁|哪位|哪个)是*"
QUESTION_EN = "(^| )(what|who|how|which|where|why)('re|'s)? "
FILLERS_EN = "(^| )('s|'re|is|are|were|was|do|does|did|don't|doesn't|didn't|has|have|be|there|you|me|your|my|mine|just|please|may|i|should|would|wouldn't|will|won't|done|go|for|with|so|the|a|an|by|i'm|it's|he's|she's|they|they're|you're|as|by|on|in|at|up|out|down|of|to|or|and|if) "
STOP_WORDS = [
    "您", "你", "我", "他", "她", "它", "这", "那", "我们", "的", "了", "在", "是", "就", "有", "于", "及", "即", "为", "最", "从", "以", "将", "与", "吧", "中", "又", "还", "把",
    "被", "让", "给", "对", "向", "往", "到", "得", "地", "和", "或", "但", "而", "且", "还是", "个", "只", "件", "条", "种", "些", "很", "也", "都", "颗", "家", "款", "次",
    "可以", "能", "会", "要", "需", "需要", "应该", "写", "写一下", "来", "去", "采用", "发射", "号", "大于", "小于", "等于", "相关", "关于", "比较", "介绍", "说明", "描述", "信息", "简单",
    "推荐", "分别", "适合", "具体", "主要", "问题", "解决", "即可", "一段话", "一下", "一个", "一段", "一段时间", "一款", "哪种", "或者", "哪几种", "几家", "几次", "几种", "超过", "翻译成", "以内",
    "之前", "颗卫星", "支持", "使用", "包括", "提供", "实现", "进行", "具备", "满足", "达到", "包含", "the", "and", "for", "are", "not", "but", "was", "has", "all", "can",
    "did", "may", "who", "why", "how", "out", "its", "let", "say", "our", "use",
]
SERIES = ["g", "x", "nx", "r", "rh"]
HIGH, MEDIUM, LOW = 3.0, 1.5, 0.5


def without_question(c: Column | str) -> Column:
    """Without question phrases and English fillers; the text itself if nothing would be left."""
    text = X.col(c)
    out = F.regexp_replace(text, "(?iu)" + QUESTION_ZH, "")
    out = F.regexp_replace(F.regexp_replace(out, "(?iu)" + QUESTION_EN, " "), "(?iu)" + FILLERS_EN, " ")
    return F.when(X.strip(out) == "", text).otherwise(out)


def keep_token(t: Column) -> Column:
    """Whether a token may be a keyword; rules in order: stop words go, names of models and series stay, single letters and numbers of one or two digits go."""
    return F.when(t.isin(STOP_WORDS), False).when(X.is_model_name(t), True).when(t.isin(SERIES), True).when(t.rlike("^[\\u4e00-\\u9fff]$|^[a-z]$|^\\d{1,2}$"), False).otherwise(t != "")


def query_text(c: Column | str) -> Column:
    return F.regexp_replace(without_question(F.lower(X.half_width(X.space_scripts(c)))), "(?U)[\\p{Punct}\\p{IsPunctuation}&&[^-_]]+", " ")


def keywords(queries: DataFrame, terms: DataFrame | None = None, text: str = "query") -> DataFrame:
    """(query_id, position, term, weight) of queries (query_id, text): the tokens that may be keywords, first occurrence only.

    Words are runs of Latin letters and digits or of ideographs between the
    boundaries that spacing and punctuation leave. terms (alias, standard):
    the dictionary whose members weigh most; runs of two and more ideographs
    weigh medium, others least.
    """
    toks = F.transform(F.split(query_text(F.col(text)), "(?U)\\s+"), lambda t: X.strip(t))
    rows = queries.select("query_id", F.posexplode(F.filter(toks, keep_token)).alias("position", "term"))
    w = Window.partitionBy("query_id", "term").orderBy("position")
    rows = rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    weight = F.when(F.col("term").rlike("^[\\u4e00-\\u9fff]{2,}$"), MEDIUM).otherwise(LOW)
    if terms is None:
        return rows.withColumn("weight", weight)
    high = terms.select(F.explode(F.array(F.lower("alias"), F.lower("standard"))).alias("term")).where("term is not null").distinct()
    return rows.join(high.withColumn("_h", F.lit(True)), "term", "left").select("query_id", "position", "term", F.when(F.col("_h"), HIGH).otherwise(weight).alias("weight"))


def normalised(keywords: DataFrame, terms: DataFrame) -> DataFrame:
    """keywords with aliases put to their standards, the first occurrence staying and weights scaled to a sum of 1 for each query."""
    one = terms.groupBy(F.lower("alias").alias("term")).agg(F.min("standard").alias("standard"))
    rows = keywords.join(one, "term", "left").select("query_id", "position", F.coalesce("standard", "term").alias("term"), "weight")
    w = Window.partitionBy("query_id", "term").orderBy("position")
    rows = rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    return rows.withColumn("weight", F.round(F.col("weight") / F.sum("weight").over(Window.partitionBy("query_id")), 9))


def expanded(keywords: DataFrame, terms: DataFrame, factor: float = 0.2) -> DataFrame:
    """keywords with each term's synonyms (the other aliases of its standard and the standard), weighing `factor` of it."""
    pairs = terms.select(F.lower("alias").alias("x"), F.lower("standard").alias("y")).distinct()
    same = pairs.select("x", "y").union(pairs.select("y", "x"))
    same = same.union(pairs.alias("a").join(pairs.alias("b"), F.col("a.y") == F.col("b.y")).select(F.col("a.x"), F.col("b.x").alias("y"))).where("x <> y").distinct()
    more = keywords.join(same.withColumnRenamed("x", "term"), "term").select("query_id", "position", F.col("y").alias("term"), (F.col("weight") * factor).alias("weight"), F.lit(True).alias("synonym"))
    return keywords.select("query_id", "position", "term", "weight", F.lit(False).alias("synonym")).unionByName(more)


def clauses(keywords: DataFrame, synonyms: DataFrame, raw: DataFrame | None = None) -> DataFrame:
    """(query_id, layer, term, boost): the weighted parts of a query: each term (times 5 if there are several), its synonyms at 0.2, neighbouring pairs as phrases at twice the larger weight, synonyms as phrases at 0.7, and the raw text at 1."""
    n = keywords.groupBy("query_id").agg(F.count("*").alias("n"))
    base = keywords.join(n, "query_id")
    many = F.when(F.col("n") > 1, 5.0).otherwise(1.0)
    one = base.select("query_id", F.lit("term").alias("layer"), "term", (F.col("weight") * many).alias("boost"))
    w = Window.partitionBy("query_id").orderBy("position")
    pairs = base.withColumn("_t", F.lead("term").over(w)).withColumn("_w", F.lead("weight").over(w)).where("_t is not null")
    two = pairs.select("query_id", F.lit("phrase").alias("layer"), F.concat_ws(" ", "term", "_t").alias("term"), (2 * F.greatest("weight", "_w") * many).alias("boost"))
    syn = expanded(keywords.select("query_id", "position", "term", "weight"), synonyms).where("synonym").join(n, "query_id")
    three = syn.select("query_id", F.lit("synonym").alias("layer"), "term", (F.col("weight") * many).alias("boost"))
    four = syn.where("n > 1").select("query_id", F.lit("synonym_phrase").alias("layer"), "term", F.lit(0.7).alias("boost"))
    out = one.unionByName(two).unionByName(three).unionByName(four)
    if raw is not None:
        out = out.unionByName(raw.select("query_id", F.lit("raw").alias("layer"), X.escape_query("query").alias("term"), F.lit(1.0).alias("boost")))
    return out.withColumn("boost", F.round("boost", 6))


def query_terms(clauses: DataFrame) -> DataFrame:
    """(query_id, term, weight) for scoring: the tokens of all clauses with their boosts; a phrase's tokens share its boost."""
    toks = clauses.select("query_id", X.tokens(F.col("term")).alias("t"), "boost").where("size(t) > 0")
    return toks.select("query_id", F.explode("t").alias("term"), (F.col("boost") / F.size("t")).alias("w")).groupBy("query_id", "term").agg(F.sum("w").alias("weight"))


def rerank_query(queries: DataFrame, keywords: DataFrame) -> DataFrame:
    """(query_id, query, rerank_query): the query followed by its keywords, written three, two or one times by weight; unchanged without keywords."""
    times = F.when(F.col("weight") >= HIGH, 3).when(F.col("weight") >= MEDIUM, 2).otherwise(1)
    said = keywords.select("query_id", "position", F.array_repeat("term", times).alias("t"))
    all_said = said.groupBy("query_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("position", "t"))), lambda s: s["t"])).alias("t"))
    return queries.select("query_id", "query").join(all_said, "query_id", "left").select("query_id", "query", F.when(F.size("t") > 0, F.concat("query", F.lit(" 关键词: "), F.array_join("t", " "))).otherwise(F.col("query")).alias("rerank_query"))


def hypothetical(queries: DataFrame, generate=None, n: int = 1) -> DataFrame:
    """(query_id, part, text): n hypothetical answers to each query by generate(query, i), a pandas function; without it the query itself."""
    if not 1 <= n <= 3:
        raise ValueError("n must lie in 1..3")
    rows = queries.select("query_id", F.col("query").alias("text"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("part"))
    return rows if generate is None else rows.withColumn("text", F.pandas_udf(generate, "string")("text", "part"))


def hypothetical_vectors(queries: DataFrame, embed, generate=None, n: int = 1) -> DataFrame:
    """(query_id, query_vec): the mean vector of n hypothetical answers to each query, embedded by embed(texts)."""
    made = hypothetical(queries, generate, n).withColumn("vec", F.pandas_udf(embed, "array<float>")("text"))
    return V.mean_vector(made, "query_id", "vec").withColumnRenamed("vec", "query_vec")


def phrases_of(clauses: DataFrame) -> DataFrame:
    """(query_id, phrase array, boost): the phrases among clauses, as their tokens in order."""
    rows = clauses.where(F.col("layer").isin("phrase", "synonym_phrase")).select("query_id", X.tokens(F.col("term")).alias("phrase"), "boost")
    return rows.where("size(phrase) >= 2")


def words_of(clauses: DataFrame) -> DataFrame:
    """(query_id, term, weight): the tokens of the clauses that are no phrases, with their boosts."""
    return query_terms(clauses.where(~F.col("layer").isin("phrase", "synonym_phrase")))


def protected(c: Column | str, terms: list[str], function) -> Column:
    """function(text) with the occurrences of terms left as they are, the longest first; they stand aside under signs for private use meanwhile."""
    marks = {t: f"\ue100{chr(0xE200 + i)}\ue101" for i, t in enumerate(sorted(set(terms), key=lambda t: (-len(t), t)))}
    text = X.col(c)
    for t, m in marks.items():
        text = F.replace(text, F.lit(t), F.lit(m))
    text = function(text)
    for t, m in marks.items():
        text = F.replace(text, F.lit(m), F.lit(t))
    return text


def segmented(queries: DataFrame, terms: DataFrame, text: str = "query") -> DataFrame:
    """(query_id, position, term): the tokens of queries with runs of ideographs cut, from the left, into the longest words of the dictionary terms (alias, standard) and what lies between them."""
    words = sorted({w.lower() for r in terms.select("alias", "standard").distinct().toLocalIterator() for w in (r[0], r[1]) if w and len(w) >= 2}, key=lambda w: (-len(w), w))
    pattern = re.compile("|".join(map(re.escape, words))) if words else None

    @F.pandas_udf("array<string>")
    def cut_up(column: pd.Series) -> pd.Series:
        def one(t: str | None) -> list[str]:
            out: list[str] = []
            for token in (t or "").split():
                if pattern is None or not re.search("[\u4e00-\u9fff]", token):
                    out.append(token)
                    continue
                at = 0
                for m in pattern.finditer(token):
                    out += [token[at : m.start()], m[0]]
                    at = m.end()
                out.append(token[at:])
            return [x for x in out if x]

        return column.map(one)

    rows = queries.select("query_id", F.posexplode(cut_up(query_text(F.col(text)))).alias("position", "term"))
    return rows.where(keep_token(F.col("term")))
