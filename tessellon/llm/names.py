"""Variant spellings of names typed by people, by suffix blocking.

Names are parsed into the part that tells entities apart (a surname, or the
proper word of an organisation) and the rest (given name, unit, field of work,
legal form). All suffixes of the parts above a least length are indexed; a
suffix that too many names share is refined with other fields before it may
pair names. Pairs are compared by the ratio of their longest common
subsequence, and what is linked, directly or through an alias, is one entity.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellon.llm import glyphs, groups
from tessellon.plans.lineage import cut

# General words of organisations' names.
FORMS = {
    "corporation": "group", "corp": "group", "group": "group", "grp": "group", "aerospace": "group", "aero": "group", "holding": "group", "holdings": "group",
    "technologies": "company", "technology": "company", "tech": "company", "co": "company", "ltd": "company", "limited": "company", "inc": "company", "company": "company", "llc": "company", "gmbh": "company",
    "institute": "institute", "inst": "institute", "university": "university", "univ": "university", "uni": "university", "college": "university",
    "laboratory": "laboratory", "lab": "laboratory", "labs": "laboratory", "laboratories": "laboratory", "department": "department", "dept": "department", "centre": "centre", "center": "centre",
    "of": "", "the": "", "for": "", "and": "",
}
# Fields of work in organisations' names.
FIELDS = ["sensors", "optics", "photonics", "geodesy", "computing", "robotics", "avionics", "materials", "imaging", "propulsion", "communications", "electronics", "systems", "energy", "software", "physics", "chemistry", "mechanics", "surveying", "optoelectronics"]
# Endings of organisations' names in Chinese with the form they stand for, longest first.
ZH_FORMS = {"集团股份有限公司": "group", "科技有限公司": "company", "股份有限公司": "group", "有限责任公司": "company", "技术研究所": "institute2", "有限公司": "company", "技术所": "institute2", "研究院": "institute", "研究所": "institute2", "实验室": "laboratory", "大学": "university", "学院": "university", "集团": "group", "股份": "group", "科技": "company", "公司": "company", "研究": "institute", "院": "institute", "所": "institute2", "大": "university"}
# Fields of work in Chinese names.
ZH_FIELDS = ["机器人", "航电", "计算", "成像", "光电", "通信", "测绘", "推进", "材料", "传感", "光学", "光子", "电子", "能源", "软件", "遥感", "导航", "航天", "卫星", "信息", "技术"]
TITLES = {"dr", "prof", "professor", "mr", "ms", "mrs", "miss", "sir", "ing", "phd"}
_UNIT = re.compile(r"[\s,\-–—_(]*\b(?:branch|unit|no|number|section|site|division)\.?\s*#?(\d+)\)?\s*$")
_HEAD = re.compile(r"[\s,\-–—_(]*\b(?:hq|headquarters|main campus|head office)\b\)?\s*$")
_ZH_UNIT = re.compile(r"[（(]?第?([一二三四五六七八九十百\d]+)(?:分部|分院|分公司|分所|校区|分校|事业部|部)[）)]?$")
_ZH_HEAD = re.compile(r"[（(]?(?:校本部|本部|总部|总院|总公司)[）)]?$")
_HAN = re.compile("[㐀-鿿]")


def ratio(a: str, b: str) -> float:
    """Twice the longest common subsequence over both lengths; bit-parallel."""
    if not a or not b:
        return 0.0
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        u = s & masks.get(c, 0)
        s = ((s + u) | (s - u)) & full
    return 2.0 * (len(a) - s.bit_count()) / (len(a) + len(b))


def _bare(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c))


class Parser:
    """Names to their parts. short: short forms to standards (lower case); places: place names of two or three signs that stand before or in brackets after a Chinese name; given: known given names; learned: general words that the rows themselves show, which tell fields of work apart."""

    def __init__(self, short: dict[str, str], places: set[str], learned: set[str] = frozenset()):
        self.short = short
        self.learned = learned
        self.general = {g: FORMS.get(g, "") for g in [*FORMS, *FIELDS] if len(g) > 3}
        self.given = {v for v in short.values()} | {k for k in short if "." not in k}
        self.places = places

    def _person(self, words: list[str], comma: int, upper: list[bool]) -> dict:
        initials = [w for w in words if len(w) == 1]
        full = [(i, w) for i, w in enumerate(words) if len(w) > 1]
        if not full:
            return {"core": " ".join(words), "given": "", "initial": ""}
        known = [(i, w) for i, w in full if w in self.given]
        rest = [(i, w) for i, w in full if w not in self.given]
        if len(full) == 1:
            return {"core": full[0][1], "given": "", "initial": initials[0] if initials else ""}
        if comma > 0:
            before, after = [x for x in full if x[0] < comma], [x for x in full if x[0] >= comma]
            given = after[0][1] if after else ""
            core = " ".join(w for _, w in before) or full[-1][1]
        elif known and rest:
            given, core = known[0][1], rest[-1][1]
        elif not known and any(upper) and not all(upper[i] for i, _ in full):
            core = next(w for i, w in full if upper[i])
            given = next(w for i, w in full if not upper[i])
        else:
            near = max(full, key=lambda x: max((ratio(x[1], g) for g in self.given if abs(len(g) - len(x[1])) < 3), default=0.0))
            sure = max((ratio(near[1], g) for g in self.given), default=0.0) >= 0.8
            given = near[1] if sure else full[0][1]
            core = next((w for _, w in reversed(full) if w != given), given)
        if given not in self.given:
            best = max(self.given, key=lambda g: ratio(given, g), default="")
            if best and ratio(given, best) >= 0.82:
                given = best
        given = self.short.get(given, given)
        return {"core": core, "given": given, "initial": given[:1]}

    def _western(self, text: str) -> dict:
        unit = ""
        if m := _UNIT.search(text):
            unit, text = m[1], text[: m.start()]
        text = _HEAD.sub("", text)
        words = [w for w in re.split(r"[^\w]+|_", text) if w]
        form, field, rest, own = "", "", [], []
        for w in words:
            if w in FORMS:
                form = form or FORMS[w]
            elif w in FIELDS:
                field = w
            elif w in self.learned:
                own.append(w)
            else:
                rest.append(w)
        proper = []
        for w in rest:
            # what is far from w in length cannot reach the ratio
            near = [g for g in self.general if 0.7 <= len(g) / len(w) <= 1.42] if len(w) > 3 else []
            like = max(near, key=lambda g: ratio(w, g), default="")
            if like and ratio(w, like) >= 0.83:
                if like in FORMS:
                    form = form or FORMS[like]
                else:
                    field = like
            else:
                proper.append(w)
        field = " ".join(sorted({field, *own} - {""}))
        # a name of general words alone is told apart by all of them
        core = max(proper, key=len, default="") or " ".join(sorted(words))
        return {"core": core, "unit": unit, "field": field, "form": form}

    def _han(self, text: str) -> dict:
        text = re.sub(r"[\s·_]+", "", text)
        unit = ""
        if m := _ZH_UNIT.search(text):
            unit, text = m[1], text[: m.start()]
        text = _ZH_HEAD.sub("", text)
        text = re.sub(r"[（(\[][^（()）\]]*[)）\]]?", "", text)
        form = field = ""
        for ending, kind in ZH_FORMS.items():
            if text.endswith(ending) and len(text) >= len(ending) + 2:
                form, text = kind, text[: -len(ending)]
                break
        for f in ZH_FIELDS:
            if text.endswith(f) and len(text) >= len(f) + 2:
                field, text = f, text[: -len(f)]
                break
        for n in (3, 2):
            if text[:n] in self.places and len(text) >= n + 3:
                text = text[n:]
                break
        return {"core": text, "unit": unit, "field": field, "form": form}

    def parse(self, name: str, kind: str | None) -> dict:
        """kind ('p' or 'o'), core, given, initial, unit, field, form, han of a name in its consistent form."""
        seen = _bare(name).strip()
        out = {"kind": "o", "core": "", "given": "", "initial": "", "unit": "", "field": "", "form": "", "han": bool(_HAN.search(seen))}
        if out["han"]:
            return out | self._han(seen)
        low = seen.lower()
        words = [w for w in re.split(r"[^\w]+|_", low) if w]
        if kind is None:
            common = [w for w in words if len(w) > 2 and (w in FORMS or w in FIELDS)]
            kind = "ORG" if common or _UNIT.search(low) or (len(words) == 1) else "PERSON"
        if kind == "ORG":
            return out | self._western(low)
        parts = [p for p in re.split(r"[\s_,./]+", seen) if p]
        head = seen.split(",")[0]
        before = [p for p in re.split(r"[\s_,./]+", head) if p and p.lower() not in TITLES] if "," in seen else []
        keep = [p for p in parts if p.lower() not in TITLES]
        plain = [re.sub(r"[^\w]", "", p) for p in keep]
        return out | {"kind": "p"} | self._person([p.lower() for p in plain if p], len(before), [len(p) > 1 and p.isupper() for p in plain if p])


_PARTS = "kind string, core string, given string, initial string, unit string, field string, form string, han boolean"


def _shortened(core: str) -> list[str]:
    """The core with as many letters left out, in every way, as a ratio of 0.85 allows either side (0.74 between cores of one length); three at most."""
    n = len(core)
    return sorted({"".join(p) for d in range(min(3, int(n * 0.2611)) + 1) for p in combinations(core, n - d)})


def blocks(forms: DataFrame, crowded: int = 40) -> DataFrame:
    """(key, form): suffix keys of forms (form, kind, core, given, unit, field, form_kind, han).

    Suffixes of the core and of the other words; a suffix that more than
    `crowded` forms share is taken together with the first two letters of the
    core, the unit and the given name's initial, then with the first four;
    none is thrown away. As that parts spellings of one name, the forms of
    crowded suffixes also get keys of unit, given name and the core with
    letters left out: forms that _alike accepts share one, if their cores have
    up to 15 letters.
    """

    @F.pandas_udf("array<string>")
    def shortened(core: pd.Series) -> pd.Series:
        return core.map(_shortened)

    least = F.when(F.col("han"), 2).otherwise(4)
    other = F.when(F.col("kind") == "p", F.col("given")).otherwise(F.concat_ws(" ", "field", "form_kind"))
    sides = []
    for token, is_core in ((F.col("core"), True), (other, False)):
        keyed = forms.withColumn("_t", token).withColumn("_n", least)
        suffix = F.explode(F.when(F.length("_t") >= F.col("_n"), F.transform(F.sequence(F.lit(1), F.length("_t") - F.col("_n") + 1), lambda i: F.substring(F.col("_t"), i, F.length("_t")))).otherwise(F.array().cast("array<string>")))
        sides.append(keyed.select("form", "kind", "core", "given", "unit", "initial", "han", suffix.alias("suffix"), F.lit(is_core).alias("of_core")))
    rows = sides[0].unionByName(sides[1]).withColumn("key", F.xxhash64("kind", "of_core", "suffix", "unit"))
    sized = lambda x: x.join(x.groupBy("key").agg(F.count("*").alias("n")), "key")
    out = None
    for letters in (2, 4, 99):
        rows = cut(sized(rows))
        done = rows.where((F.col("n") <= crowded) | F.lit(letters == 99)).where("n > 1").select("key", "form")
        out = done if out is None else out.unionByName(done)
        if letters == 2:
            given = F.when(F.col("kind") == "p", F.col("given")).otherwise("")
            hot = rows.where(F.col("n") > crowded).select("form", "kind", "core", given.alias("given"), "unit", "han").distinct()
            near = cut(hot.select("form", F.explode(shortened("core")).alias("_s"), "kind", "given", "unit", "han").select(F.xxhash64(F.lit("shortened"), "kind", "given", "unit", "han", "_s").alias("key"), "form"))
            out = out.unionByName(sized(near).where("n > 1").select("key", "form"))
        rows = rows.where(F.col("n") > crowded).drop("n").withColumn("key", F.xxhash64("key", F.substring("core", 1, letters), "initial"))
    return out


def _alike(a: dict, b: dict, least: float) -> bool:
    if a["kind"] != b["kind"] or a["unit"] != b["unit"]:
        return False
    close = ratio(a["core"], b["core"])
    if a["kind"] == "p":
        return close >= least and bool(a["given"]) and a["given"] == b["given"]
    if a["han"] != b["han"]:
        return False
    same_field = not a["field"] or not b["field"] or a["field"] == b["field"]
    same_form = not a["form_kind"] or not b["form_kind"] or a["form_kind"] == b["form_kind"]
    if a["core"] == b["core"]:
        return same_field
    if a["han"]:
        return len(a["core"]) == len(b["core"]) and close >= 0.74 and a["field"] == b["field"] and same_form and len(a["core"]) > 3 or (abs(len(a["core"]) - len(b["core"])) == 1 and close >= 0.85 and a["field"] == b["field"] and same_form)
    return close >= least and same_field and same_form


def linked(forms: DataFrame, least: float) -> DataFrame:
    """(a, b): forms of one name, by comparing those that share a suffix key."""
    keys = cut(blocks(forms))
    tasks = max(forms.sparkSession.sparkContext.defaultParallelism, int(forms.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    pairs = keys.withColumnRenamed("form", "a").join(keys.withColumnRenamed("form", "b"), "key").where("a < b").select("a", "b").distinct()
    parts = F.struct("kind", "core", "given", "unit", "field", "form_kind", "han")
    pairs = pairs.join(forms.select(F.col("form").alias("a"), parts.alias("pa")), "a").join(forms.select(F.col("form").alias("b"), parts.alias("pb")), "b").repartition(tasks, "a", "b")

    @F.pandas_udf("boolean")
    def alike(pa: pd.DataFrame, pb: pd.DataFrame) -> pd.Series:
        return pd.Series([_alike(x, y, least) for x, y in zip(pa.to_dict("records"), pb.to_dict("records"))], dtype=bool)

    return pairs.where(alike("pa", "pb")).select("a", "b")


def general_words(names: DataFrame, share: float = 0.02, fresh: float = 0.3) -> set[str]:
    """Words of names (text, type) of organisations that say what kind one is, not which: the part `share` of all different names has them, and they stand beside new rarer words in at least the part `fresh` of these, which the proper word of one much written organisation does not. With w words in the mean name there are w / share of them at most."""
    words = F.filter(F.array_distinct(F.split(F.lower("text"), "[^\\p{L}\\p{N}]+")), lambda w: F.length(w) >= 3)
    rows = names.where("type is null or type = 'ORG'").where(~F.col("text").rlike("[\\u4e00-\\u9fff]")).select("text").distinct().select(words.alias("ws")).where("size(ws) >= 2")
    rows = cut(rows)
    n = rows.count()
    df = rows.select(F.explode("ws").alias("w")).groupBy("w").agg(F.count("*").alias("df"))
    often = cut(df.where(F.col("df") >= max(5, share * n)))
    beside = rows.select(F.explode("ws").alias("w"), "ws").join(F.broadcast(often), "w").select("w", "df", F.explode("ws").alias("x")).distinct()
    rarer = beside.join(df.select(F.col("w").alias("x"), F.col("df").alias("dx")), "x").where("dx < df").groupBy("w", "df").agg(F.count("*").alias("k"))
    return {r["w"] for r in rarer.where(F.col("k") >= fresh * F.col("df")).toLocalIterator()}


def entity_groups(entities: DataFrame, seed: DataFrame, least: float = 0.85) -> DataFrame:
    """(entity_id, group_id): one row for each entity_id of entities (entity_id, entity_name, entity_type, aliases) with a type of ORG, PERSON or null; group_id is the smallest entity_id of the same person or organisation.

    seed: (alias, standard) short forms. Rows with a null id or name and other
    types take no part; of a repeated id the row with the smallest name
    counts, with the aliases of all its rows. Units and branches are entities
    of their own, and so are namesakes by surname. A name with only an initial
    is linked if one given name alone fits it.
    """
    rows = entities.where("entity_id is not null and entity_name is not null and (entity_type is null or entity_type in ('ORG', 'PERSON'))")
    one = rows.groupBy("entity_id").agg(F.min("entity_name").alias("name"), F.min("entity_type").alias("type"), F.array_distinct(F.flatten(F.collect_set("aliases"))).alias("aliases"))
    spark = entities.sparkSession
    written = one.select("entity_id", "type", F.explode(F.concat(F.array(F.struct(F.col("name").alias("text"), F.lit(False).alias("alias"))), F.transform(F.filter(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: a.isNotNull() & (F.trim(a) != "")), lambda a: F.struct(a.alias("text"), F.lit(True).alias("alias"))))).alias("w")).select("entity_id", "type", "w.text", "w.alias")
    # names are short, so size alone would leave them to a few tasks
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    written = cut(written.repartition(tasks, "entity_id"))
    scores = glyphs.learn(written)
    clean = cut(glyphs.forms(written, scores).select("entity_id", "type", "alias", F.col("form").alias("text")))
    # the tables of short forms and of place names are small vocabularies, not rows of the corpus
    short = {r["alias"].lower().strip("."): r["standard"].lower() for r in seed.where("alias is not null and standard is not null").distinct().toLocalIterator()}
    # a place is what a thousandth of all bracketed places or more name, so there are a thousand at most
    said = clean.select(F.explode(F.regexp_extract_all("text", F.lit("[(（]([\\u4e00-\\u9fff]{2,3})[)）]"), F.lit(1))).alias("p")).groupBy("p").agg(F.count("*").alias("n"))
    said = cut(said)
    all_said = said.agg(F.sum("n")).first()[0] or 0
    places = {r["p"] for r in said.where(F.col("n") >= 0.001 * all_said).toLocalIterator()}
    parser = Parser(short, places, general_words(clean))

    @F.pandas_udf(_PARTS)
    def parse(text: pd.Series, kind: pd.Series) -> pd.DataFrame:
        out = [parser.parse(t, k) for t, k in zip(text, kind.where(kind.notna(), None))]
        return pd.DataFrame(out, columns=["kind", "core", "given", "initial", "unit", "field", "form", "han"])

    parsed = clean.withColumn("p", parse("text", "type")).select("entity_id", "alias", "p.kind", "p.core", "p.given", "p.initial", "p.unit", "p.field", F.col("p.form").alias("form_kind"), "p.han").where("core <> ''")
    parsed = cut(_learn_short(parsed).withColumn("form", F.xxhash64("kind", "core", "given", "initial", "unit", "field", "form_kind", "han")))
    whole = (F.col("kind") == "o") | (F.col("given") != "")
    forms = cut(parsed.select("form", "kind", "core", "given", "initial", "unit", "field", "form_kind", "han").distinct())
    # nodes are forms and entities; an alias with a mere initial says nothing certain
    node = F.xxhash64(F.lit("entity"), "entity_id")
    own = parsed.where(~F.col("alias") | whole).select(node.alias("a"), F.col("form").alias("b"))
    edges = own.unionByName(linked(forms.where(whole), least)).unionByName(_cut_short(forms))
    roots = cut(groups.components(edges))
    # names with an initial only join groups to groups, so the second graph is that of the groups
    late = _initials(parsed, forms, roots, node).join(roots.select(F.col("v").alias("a"), F.col("root").alias("ra")), "a", "left").select(F.coalesce("ra", "a").alias("a"), "b")
    above = groups.components(late).select(F.col("v").alias("root"), F.col("root").alias("top"))
    ids = parsed.select("entity_id").distinct().withColumn("v", node)
    named = ids.join(roots, "v").join(above, "root", "left").select("entity_id", F.coalesce("top", "root").alias("root"))
    least_id = named.groupBy("root").agg(F.min("entity_id").alias("group_id"))
    found = named.join(least_id, "root").select("entity_id", "group_id")
    return one.select("entity_id").join(found, "entity_id", "left").select("entity_id", F.coalesce("group_id", "entity_id").alias("group_id"))


def _learn_short(parsed: DataFrame) -> DataFrame:
    """parsed with given names put to the standard that rows give them themselves: two given names of one surname in one row, the pair seen under two surnames at least."""
    people = parsed.where("kind = 'p' and given <> ''").select("entity_id", "core", "given", "alias").distinct()
    both = people.select("entity_id", "core", F.col("given").alias("x")).join(people.select("entity_id", "core", F.col("given").alias("y")), ["entity_id", "core"]).where("x <> y")
    seen = both.groupBy("x", "y").agg(F.countDistinct("core").alias("n")).where("n >= 2")
    freq = people.groupBy("given").agg(F.countDistinct("core").alias("m"))
    seen = seen.join(freq.select(F.col("given").alias("x"), F.col("m").alias("mx")), "x").join(freq.select(F.col("given").alias("y"), F.col("m").alias("my")), "y")
    standard = seen.where("(my > mx or (my = mx and y < x)) and n >= 0.1 * mx").groupBy("x").agg(F.max_by("y", F.struct("n", "my", "y")).alias("y"))
    known = parsed.join(standard.withColumnRenamed("x", "given"), "given", "left")
    given = F.coalesce("y", "given")
    return known.select("entity_id", "alias", "kind", "core", given.alias("given"), F.when(F.col("given") != "", F.substring(given, 1, 1)).otherwise(F.col("initial")).alias("initial"), "unit", "field", "form_kind", "han")


def _cut_short(forms: DataFrame) -> DataFrame:
    """(a, b): organisations' forms whose core is the beginning of one other core only, with that core's forms of the same unit and no other field or form."""
    orgs = forms.where("kind = 'o' and not han and length(core) >= 5")
    cores = orgs.select("core").distinct()
    begins = cores.select(F.col("core").alias("long"), F.explode(F.transform(F.sequence(F.lit(5), F.length("core")), lambda i: F.substring(F.col("core"), 1, i))).alias("core")).where("core <> long and length(core) <= length(long) - 2")
    one = cores.join(begins, "core").groupBy("core").agg(F.min("long").alias("long"), F.max("long").alias("long2"))
    # cores that begin alike to within a letter or two are spellings of one
    one = one.where((F.col("long") == F.col("long2")) | (F.levenshtein("long", "long2") <= 2)).select("core", "long")
    left = orgs.select(F.col("form").alias("a"), "core", "unit", F.col("field").alias("fa"), F.col("form_kind").alias("ka")).join(one, "core")
    right = orgs.select(F.col("form").alias("b"), F.col("core").alias("long"), "unit", F.col("field").alias("fb"), F.col("form_kind").alias("kb"))
    fits = ((F.col("fa") == "") | (F.col("fb") == "") | (F.col("fa") == F.col("fb"))) & ((F.col("ka") == "") | (F.col("kb") == "") | (F.col("ka") == F.col("kb")))
    return left.join(right, ["long", "unit"]).where(fits).select("a", "b")


def _initials(parsed: DataFrame, forms: DataFrame, roots: DataFrame, node: Column) -> DataFrame:
    """(a, b): forms with only an initial linked to the one person of that surname whom it fits; with none to be linked to, nothing."""
    short = forms.where("kind = 'p' and given = '' and initial <> ''").select("form", "core", "initial")
    full = forms.where("kind = 'p' and given <> ''").select(F.col("form").alias("v"), "core", "initial").join(roots, "v")
    fits = short.join(full, ["core", "initial"]).groupBy("form").agg(F.min("root").alias("root"), F.max("root").alias("root2"))
    one = fits.where("root = root2").select(F.col("form").alias("a"), F.col("root").alias("b"))
    # a surname mistyped beside an initial: again by suffixes, only where the surname stands nowhere in full
    lone = short.join(fits.select("form"), "form", "left_anti")
    near = full.select("v", F.col("core").alias("full_core"), "initial", "root")
    key = lambda c: F.explode(F.array(F.concat(F.lit("<"), F.substring(c, 1, 4)), F.concat(F.lit(">"), F.substring(c, -4, 4))))
    close = lone.withColumn("key", key("core")).join(near.withColumn("key", key("full_core")), ["key", "initial"]).where((F.levenshtein("core", "full_core") <= 1) | ((F.levenshtein("core", "full_core") == 2) & (F.sort_array(F.split("core", "")) == F.sort_array(F.split("full_core", "")))))
    one2 = close.groupBy("form").agg(F.min("root").alias("root"), F.max("root").alias("root2")).where("root = root2").select(F.col("form").alias("a"), F.col("root").alias("b"))
    # an ambiguous initial joins nobody: its rows must not hang together over the shared form either
    return one.unionByName(one2)


def group_pairs(found: DataFrame) -> DataFrame:
    """(entity_a, entity_b): all pairs within the groups."""
    a, b = found.select("group_id", F.col("entity_id").alias("entity_a")), found.select("group_id", F.col("entity_id").alias("entity_b"))
    return a.join(b, "group_id").where("entity_a < entity_b").select("entity_a", "entity_b")
