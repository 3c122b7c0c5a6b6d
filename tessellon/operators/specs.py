"""Semi-structured specifications: category, series, model and a map of parameters."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessellon.functions import text as X

_FILTER = re.compile(r"^(.+?)\s*(<=|>=|==|!=|<|>)\s*(.*)$")
_LIMIT = re.compile(r"^\s*(<=|>=|<|>|==)\s*([\d.]+)")
# Parameters with units, the words that ask for them and stand in parameter names, and the unit.
MEASURES = {"weight": (("重量", "weight"), "kg"), "power": (("功耗", "power"), "W"), "compute": (("算力", "compute", "tops"), "TOPS")}


def flatten_nested(raw: DataFrame) -> DataFrame:
    """(category, series, model, params) of category -> [series, model_list -> [model, params]] given as rows (category, series array)."""
    s = raw.select("category", F.explode("series").alias("s")).select("category", "s.series", F.explode("s.model_list").alias("m"))
    return s.select("category", "series", "m.model", "m.params")


def flatten_flat(raw: DataFrame) -> DataFrame:
    """The same of rows (type, models map<model, params>)."""
    return raw.select(F.col("type").alias("category"), F.explode("models").alias("model", "params")).select("category", F.lit(None).cast("string").alias("series"), "model", "params")


def parse_filter(text: str) -> tuple[str, str, str] | None:
    """(field, operator, value) of 'field op value'; None if there is no operator or no field."""
    m = _FILTER.match(text.strip())
    return (m[1].strip(), m[2], m[3].strip()) if m and m[1].strip() else None


def matches(value: Column, op: str, target: str) -> Column:
    """First numbers of both compared, else texts for == and !=; an empty or missing value never matches."""
    number = X.first_number(value)
    m = re.search(r"[\d.]+", target)
    other = None
    if m:
        try:
            other = float(m[0])
        except ValueError:
            other = None
    same = value == target
    text = {"==": same, "!=": ~same}.get(op, F.lit(False))
    if other is not None:
        compare = {"<": number < other, "<=": number <= other, ">": number > other, ">=": number >= other, "==": number == other, "!=": number != other}[op]
        text = F.when(number.isNotNull(), compare).otherwise(text)
    return F.coalesce((value != "") & text, F.lit(False))


def query(specs: DataFrame, category: str | None = None, model: str | None = None, condition: str | None = None) -> DataFrame:
    """specs of a category and model (each exact) that satisfy a condition on a parameter."""
    rows = specs
    if category:
        rows = rows.where(F.col("category") == category)
    if model:
        rows = rows.where(F.col("model") == model)
    if condition and (f := parse_filter(condition)):
        rows = rows.where(matches(F.try_element_at("params", F.lit(f[0])), f[1], f[2]))
    return rows


def measures(specs: DataFrame) -> DataFrame:
    """specs with weight (kg), power (W) and compute (TOPS) as numbers, from the first parameter of each whose name says so."""
    out = specs
    for name, (words, unit) in MEASURES.items():
        named = F.filter(F.map_entries("params"), lambda e: X.any_word(e["key"], list(words)))
        out = out.withColumn(name, X.unit_number(F.try_element_at(F.transform(F.array_sort(named), lambda e: e["value"]), F.lit(1)), unit))
    return out


def constrained(measured: DataFrame, limits: dict[str, str]) -> DataFrame:
    """measured rows within all limits ('weight': '<=2'); a missing measure passes, and so does a limit of another form."""
    rows = measured
    for name, limit in limits.items():
        key = next((k for k, (words, _) in MEASURES.items() if name.lower() in words or name == k), None)
        m = _LIMIT.match(limit)
        if key and m and re.fullmatch(r"\d+\.?\d*|\.\d+", m[2]):
            c, n = F.col(key), float(m[2])
            rows = rows.where(F.coalesce({"<": c < n, "<=": c <= n, ">": c > n, ">=": c >= n, "==": c == n}[m[1]], F.lit(True)))
    return rows


def resolve(specs: DataFrame, asked: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(query_id, level, category, series, model, params): specs by names asked for (query_id, name), which may be a category's, a series' or a model's; a model found at several levels comes once, by the highest. aliases: (alias, name)."""
    q = asked.select("query_id", F.lower(F.trim("name")).alias("name"))
    if aliases is not None:
        one = aliases.groupBy(F.lower("alias").alias("name")).agg(F.min(F.lower(F.col("name"))).alias("_to"))
        q = q.join(one, "name", "left").select("query_id", F.coalesce("_to", "name").alias("name"))
    found = None
    for level, field in enumerate(("category", "series", "model")):
        part = specs.withColumn("name", F.lower(F.col(field))).join(q, "name").select("query_id", F.lit(level).alias("level"), "category", "series", "model", "params")
        found = part if found is None else found.unionByName(part)
    w = Window.partitionBy("query_id", "model").orderBy("level", F.asc_nulls_last("category"), F.asc_nulls_last("series"))
    return found.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def required_first(specs: DataFrame, fields: list[str]) -> DataFrame:
    """specs with `shown`: parameters as structs, required fields in their order first, then the rest by name; required fields without a value are empty."""
    wanted = F.array(*[F.struct(F.lit(f).alias("name"), F.coalesce(F.try_element_at("params", F.lit(f)), F.lit("")).alias("value")) for f in fields])
    rest = F.transform(F.array_sort(F.filter(F.map_entries("params"), lambda e: ~e["key"].isin(fields))), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("value")))
    return specs.withColumn("shown", F.concat(wanted, rest) if fields else rest)


def context(specs: DataFrame, per_type: int = 10) -> DataFrame:
    """(category, text): up to `per_type` models of each category with their non-empty parameters."""
    w = Window.partitionBy("category").orderBy("model")
    rows = specs.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= per_type)
    pairs = F.array_join(F.transform(F.array_sort(F.map_entries(F.map_filter("params", lambda k, v: v != ""))), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), ", ")
    line = rows.select("category", "model", F.concat(F.lit("- "), F.col("model"), F.lit(" ("), pairs, F.lit(")")).alias("line"))
    return line.groupBy("category").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("model", "line"))), lambda s: s["line"]), "\n").alias("text"))


def listing(specs: DataFrame) -> DataFrame:
    """(category, series, n_models, models)."""
    return specs.groupBy("category", "series").agg(F.countDistinct("model").alias("n_models"), F.sort_array(F.collect_set("model")).alias("models"))


def fill_empty(filled: DataFrame, known: DataFrame, key: list[str]) -> DataFrame:
    """filled (key..., params, confidence) with empty parameters taken from known; keys of either; the larger confidence."""
    a, b = filled.withColumnsRenamed({"params": "_a", "confidence": "_ca"}), known.withColumnsRenamed({"params": "_b", "confidence": "_cb"})
    none = F.create_map().cast("map<string,string>")
    both = a.join(b, key, "full_outer")
    merged = F.map_zip_with(F.coalesce("_a", none), F.coalesce("_b", none), lambda k, x, y: F.when((x.isNull()) | (x == ""), F.coalesce(y, x)).otherwise(x))
    return both.select(*key, merged.alias("params"), F.greatest("_ca", "_cb").alias("confidence"))


def formatted(specs: DataFrame, first: list[str]) -> DataFrame:
    """(category, text): a category's models numbered by series, parameters with a value only, those of `first` before the others, the rest by name."""
    w = Window.partitionBy("category", "series").orderBy("model")
    shown = F.filter(F.col("shown"), lambda s: s["value"] != "")
    line = F.concat(F.col("n").cast("string"), F.lit(". "), F.col("model"), F.lit(": "), F.array_join(F.transform(shown, lambda s: F.concat(s["name"], F.lit(" "), s["value"])), "; "))
    rows = required_first(specs, first).withColumn("n", F.row_number().over(w)).select("category", "series", "n", line.alias("line"))
    by_series = rows.groupBy("category", "series").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "line"))), lambda s: s["line"]), "\n").alias("lines"))
    block = F.concat(F.lit("### "), F.coalesce("series", F.lit("")), F.lit("\n"), F.col("lines"))
    texts = by_series.groupBy("category").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("series", block.alias("block")))), lambda s: s["block"]), "\n").alias("blocks"))
    return texts.select("category", F.concat(F.lit("## "), F.col("category"), F.lit("\n"), F.col("blocks")).alias("text"))


def entries_of(raw: DataFrame) -> DataFrame:
    """(kind, name, n) of two-level specifications (category, entries), entries being a list of (name, count) or a map of names to counts."""
    if dict(raw.dtypes)["entries"].startswith("map"):
        return raw.select(F.col("category").alias("kind"), F.explode("entries").alias("name", "n"))
    return raw.select(F.col("category").alias("kind"), F.explode("entries").alias("e")).select("kind", "e.name", F.col("e.count").alias("n"))


def counted_names(entries: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(kind, name, n, position): entries of some names, or of all, the largest count of a kind first."""
    rows = entries.where(F.col("name").isin(names)) if names is not None else entries
    return rows.withColumn("position", F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("n"), "name")) - 1)
