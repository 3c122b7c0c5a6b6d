"""The training-data operators on small tables: hand-made cases, brute force, and the dirt that any column may hold."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessellon.llm import filters, glyphs, groups, leakage, mixture, names, neardup, neighbours, pieces, scans, subjects


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


# --- groups -----------------------------------------------------------------


def test_groups_match_union_find(spark):
    rng = random.Random(5)
    pairs = [(f"n{rng.randrange(300)}", f"n{rng.randrange(300)}") for _ in range(180)] + [(f"c{i}", f"c{i + 1}") for i in range(60)] + [("hub", f"leaf{i}") for i in range(200)]
    pairs += [(None, "n1"), ("n2", None), ("x", "x"), pairs[0], pairs[0][::-1], ("", "n5")]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        for x in (a, b):
            if x is not None:
                find(x)
        if a is not None and b is not None:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    find("alone")
    matches = spark.createDataFrame([(a, b, 1) for a, b in pairs], "a string, b string, id int")
    single = spark.createDataFrame([("alone",), (None,), ("alone",)], "name string")
    got = rows(groups.name_groups(matches, single), "entity_name", "group_name")
    assert got == sorted((n, find(n)) for n in root)


def test_groups_of_empty_tables(spark):
    none = spark.createDataFrame([], "a string, b string")
    assert groups.name_groups(none, spark.createDataFrame([], "name string")).count() == 0
    assert groups.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# --- neighbours -------------------------------------------------------------


def brute_pairs(vectors, k, at_least):
    ids = sorted(vectors)
    x = np.array([vectors[i] for i in ids], dtype=np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(x @ x.T, 6)
    out = set()
    for i in range(len(ids)):
        near = sorted((j for j in range(len(ids)) if j != i and s[i, j] >= at_least), key=lambda j: (-s[i, j], ids[j]))[:k]
        out |= {tuple(sorted((ids[i], ids[j]))) for j in near}
    return out


def test_nearest_pairs_find_what_brute_force_finds(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((60, 64))
    vectors = {f"v{i:04d}": (centres[i % 60] + 0.3 * rng.standard_normal(64)).astype(np.float32).tolist() for i in range(900)}
    data = [(i, v) for i, v in vectors.items()]
    data += [("null", None), ("zero", [0.0] * 64), ("short", [1.0] * 5), (None, data[0][1]), ("part", [None] + [1.0] * 63), ("inf", [float("inf")] * 64), data[3]]
    got = set(rows(neighbours.nearest_pairs(spark.createDataFrame(data, "id string, vec array<float>"), cell_rows=100), "chunk_a", "chunk_b"))
    exp = brute_pairs(vectors, 5, 0.86)
    assert len(got & exp) >= 0.9 * len(exp)
    assert len(got - exp) <= 0.02 * len(exp)


def test_copies_of_one_vector_stay_linear(spark):
    v = [1.0] + [0.0] * 63
    df = spark.createDataFrame([(f"c{i:03d}", v) for i in range(300)], "id string, vec array<float>")
    got = rows(neighbours.nearest_pairs(df), "chunk_a", "chunk_b")
    assert len(got) == len(set(got)) <= 6 * 300
    assert {x for p in got for x in p} == {f"c{i:03d}" for i in range(300)}
    assert set(got) == brute_pairs({f"c{i:03d}": v for i in range(300)}, 5, 0.86)


def test_nearest_of_nothing(spark):
    assert neighbours.nearest_pairs(spark.createDataFrame([], "id string, vec array<float>")).count() == 0


# --- names ------------------------------------------------------------------


def test_spellings_of_names(spark):
    data = [
        (1, "William Bribrurazivo", "PERSON", None), (2, "Bribrurazivo, Bill", "PERSON", []), (3, "W. Bribrurazivo", "PERSON", [None]), (4, "BRIBRURAZIVO William", None, None),
        (5, "William Bribrurazvio", "PERSON", None), (6, "Edward Bribrurazivo", "PERSON", None),
        (10, "Likozezumi Sensors Technologies Co., Ltd.", "ORG", None), (11, "Likozezumi Sensors Technologies Co., Ltd. No. 2", "ORG", None), (12, "likozezumi sensors tech. ltd", "ORG", None), (13, "Likozzumi Sensors Technologies Co., Ltd., Branch 2", "ORG", None),
        (20, "砺璋溯灿大学", "ORG", None), (21, "汐州砺璋溯灿大学", "ORG", None), (22, "砺璋溯灿（汐州）大学", "ORG", None), (23, "砺璋溯灿大学第一分部", "ORG", None),
        (30, "NX1", "MODEL", None), (31, None, "ORG", None), (None, "William Bribrurazivo", "PERSON", None), (1, "William Bribrurazivo", "PERSON", ["Bill Bribrurazivo"]),
    ]
    df = spark.createDataFrame([(*r, "x") for r in data], "entity_id bigint, entity_name string, entity_type string, aliases array<string>, group_id string").drop("group_id")
    seed = spark.createDataFrame([("Bill", "William"), ("Tech.", "Technologies"), (None, "x")], "alias string, standard string")
    got = dict(rows(names.entity_groups(df, seed), "entity_id", "group_id"))
    assert {got[i] for i in (1, 2, 3, 4, 5)} == {1} and got[6] == 6
    assert got[10] == got[12] == 10 and got[11] == got[13] == 11
    assert {got[i] for i in (20, 21, 22)} == {20} and got[23] == 23
    assert set(got) == {1, 2, 3, 4, 5, 6, 10, 11, 12, 13, 20, 21, 22, 23}
    pairs = rows(names.group_pairs(names.entity_groups(df, seed)), "entity_a", "entity_b")
    assert (1, 5) in pairs and all(a < b for a, b in pairs)


def test_general_words_are_learned_from_the_rows(spark):
    proper = [f"{a}{b}{c}o" for a in ("bra", "kel", "mon", "tir", "vus") for b in ("di", "fa", "gu") for c in ("lem", "nar", "pos", "rit")]
    data = [(i, f"{p.title()} {'Hospital' if i % 2 else 'Bank'}", "ORG", None) for i, p in enumerate(proper)]
    # one organisation under very many names, and two of one proper word
    data += [(1000 + i, f"Zuviloranta {w} Bank", "ORG", None) for i, w in enumerate(["North", "South"] * 40)]
    data += [(2000, "Quelfarindo Bank", "ORG", None), (2001, "Quelfarindo Hospital", "ORG", None)]
    df = spark.createDataFrame(data, "entity_id bigint, entity_name string, entity_type string, aliases array<string>")
    learned = names.general_words(df.select(F.col("entity_name").alias("text"), F.col("entity_type").alias("type")))
    assert {"bank", "hospital"} <= learned and "zuviloranta" not in learned
    seed = spark.createDataFrame([], "alias string, standard string")
    got = dict(rows(names.entity_groups(df, seed), "entity_id", "group_id"))
    assert got[2000] == 2000 and got[2001] == 2001 and got[1000] == got[1002]


def test_names_of_an_empty_table(spark):
    none = spark.createDataFrame([], "entity_id bigint, entity_name string, entity_type string, aliases array<string>")
    assert names.entity_groups(none, spark.createDataFrame([], "alias string, standard string")).count() == 0


def test_ratio_is_the_longest_common_subsequence():
    assert names.ratio("abcd", "abxd") == 0.75
    assert names.ratio("", "a") == 0.0
    assert names.ratio("linupupimo", "linupupino") == 0.9


# --- near duplicates --------------------------------------------------------


def shingles(text, width):
    w = text.lower().split()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    base = [[rng.choice(words) for _ in range(60)] for _ in range(40)]
    texts = {}
    for i, b in enumerate(base):
        for j in range(4):
            t = list(b)
            for _ in range(j * 3):
                t[rng.randrange(60)] = rng.choice(words)
            texts[f"d{i}_{j}"] = " ".join(t)
    texts["copy"] = texts["d0_0"].upper() + "!"
    df = spark.createDataFrame([("f", k, t) for k, t in texts.items()] + [("f", "none", None), ("f", "empty", ""), ("f", "dots", "..."), (None, "x", "a b c d"), ("f", "d0_0", texts["d0_0"]), ("g", "other", texts["d0_0"])], "field string, key string, text string")
    members, links = neardup.classes_and_links(df, at_least=0.5, width=3, bands=40, band_rows=4)
    got = set(rows(neardup.key_pairs(members, links), "field", "key_a", "key_b"))
    s = {k: shingles(t.lower().replace("!", ""), 3) for k, t in texts.items()}
    exp = {("f", a, b) for a in s for b in s if a < b and len(s[a] & s[b]) >= 0.5 * len(s[a] | s[b])}
    assert got <= exp and len(got) >= 0.97 * len(exp)
    assert ("f", "copy", "d0_0") in got
    out = {r["key"]: r for r in neardup.near_groups(members, links).collect() if r["field"] == "f"}
    assert out["copy"]["class_key"] == out["d0_0"]["class_key"] == "copy" and "none" not in out and "dots" not in out
    assert out["d0_1"]["group_key"] == out["d0_0"]["group_key"]


def test_large_classes_are_stars(spark):
    df = spark.createDataFrame([("f", f"k{i:02d}", "one two three four") for i in range(30)], "field string, key string, text string")
    members, links = neardup.classes_and_links(df, at_least=0.5, width=3, bands=10, band_rows=4)
    assert neardup.key_pairs(members, links).count() == 435
    assert neardup.key_pairs(members, links, whole_class=10).count() == 29


def test_near_duplicates_of_nothing(spark):
    members, links = neardup.classes_and_links(spark.createDataFrame([], "field string, key string, text string"))
    assert members.count() == links.count() == 0
    assert neardup.near_groups(members, links).count() == 0


# --- pieces -----------------------------------------------------------------


@pytest.mark.parametrize("text", ["A sentence here. " * 300, "字" * 5001, "x" * 2001, "# H\n\n" + "para graph text, more. " * 90 + "\n\n## I\n\n" + "两句话。" * 400, "é" * 3999])
def test_pieces_are_whole_and_within_limits(text):
    spans = pieces.cuts(text, 2000, 100)
    assert spans[0][0] == 0 and spans[-1][1] == len(text) and len(spans) > 1
    assert all(b - a <= 2000 for a, b in spans)
    assert all(n[0] == p[1] - 100 for p, n in zip(spans, spans[1:]))
    whole = text[spans[0][0] : spans[0][1]] + "".join(text[a + 100 : b] for a, b in spans[1:])
    assert whole == text


def test_split_keeps_columns_and_dirt_out(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "short"), (4, "A b. " * 300), (4, "A b. " * 300)], "id int, text string")
    out = pieces.split(df, 500, 100)
    assert {r["id"] for r in out.collect()} == {4} and out.columns == ["id", "piece_no", "n_pieces", "start_at", "piece"]
    with pytest.raises(ValueError):
        pieces.split(df.withColumn("piece", F.lit(1)), 500)


# --- forms ------------------------------------------------------------------


def test_forms_of_look_alikes(spark):
    data = [("a", "Margaret Kuvohiwalo and the other names of Margaret"), ("b", "Μargaret"), ("c", "Ｍａｔｔｈｉａｓ"), ("d", "ze​ro"), ("e", "thin space"), ("f", "café"), ("g", "café，全角。"), ("h", "on-board α-particle"), ("i", None), ("j", ""), ("k", "⼈员"), ("l", "ﬁbre"), ("m", "Москва и Россия")]
    df = spark.createDataFrame(data, "id string, text string")
    got = {r["id"]: (r["form"], r["kinds"]) for r in glyphs.forms(df).collect()}
    assert got["b"] == ("Margaret", ["look_alike"]) and got["c"] == ("Matthias", ["compatibility"]) and got["d"] == ("zero", ["invisible"])
    assert got["e"] == ("thin space", ["space"]) and got["f"] == ("café", ["combining"]) and got["k"] == ("人员", ["compatibility"]) and got["l"][0] == "fibre"
    assert got["g"][1] == [] and got["h"][1] == [] and got["i"] == (None, []) and got["j"] == ("", []) and got["m"][1] == []
    assert {r["id"] for r in glyphs.stand_ins(df).collect()} == {"b", "c", "d", "e", "f", "k", "l"}
    with pytest.raises(ValueError):
        glyphs.forms(df.withColumn("form", F.lit("")))


def test_look_alikes_go_both_ways():
    words = {"the love good value ocean apple cop code mode note see come one people world copper corner cow scope":  20, "москва вода сор город слово море небо река лес дорога скорость гора сок нос рост кот мост вор собор": 20}
    counts = {}
    for text, n in words.items():
        for w in text.split():
            for p in zip("\x02" + w, w + "\x02"):
                counts["".join(p)] = counts.get("".join(p), 0) + n
    scores = glyphs.Scores(counts)
    form = lambda t: glyphs.form_of(t, scores)[0]
    # Latin letters in Russian words
    assert form("М\u006fсква") == "Москва" and form("м\u006f\u0063ква") == "москва" and form("в\u006fда") == "вода"
    # whole words of either script stay
    assert form("сор") == "сор" and form("cop") == "cop" and form("большой сор в городе") == "большой сор в городе"
    # letters of Armenian, Cherokee and Cyrillic in English words
    assert form("\u0585cean") == "ocean" and form("\u13aapple") == "Apple" and form("\u0475alue") == "value" and form("\u050dood") == "good"
    # a word of look-alikes alone in an English text
    assert form("the good people see the \u0441\u043e\u0440") == "the good people see the cop"
    assert form("NX10 a1 Detidra12 α-particle 957b51cc0a11be") == "NX10 a1 Detidra12 α-particle 957b51cc0a11be"


# --- scans ------------------------------------------------------------------


def test_scanned_pages(spark):
    common = "The quick archive desk will approve the northern liability clause during the week. Our partner asks for the northern liability clause today."
    page = ["ANNUAL REPORT\n\nthe first page has a word that was cut at the line-", "\nAnd then it went", " on."]
    scanned = "Annual cost report\n\nThe archive desk will approve the northern hability clause and document-\n- 4 -\n\nAnnual cost report\ned it during the week with all the others that were there in the archives\n- 5 -\n\nAnnual cost report\nand so on.\n- 6 -"
    figures = "# Table\n\nText before.\n\n343\n29\n19\n85\n70\n62"
    wrapped = "A plain text whose lines are wrapped at the same width and\nwhich has nothing else to it, so that no defect is found in\nit at all."
    df = spark.createDataFrame([("s", scanned), ("f", figures), ("w", wrapped), ("n", None), ("e", ""), (None, scanned), ("s", scanned)] + [(f"c{i}", common) for i in range(12)], "doc_id string, content string")
    found = rows(scans.defects(df), "doc_id", "defect")
    assert found == [("s", "broken_word"), ("s", "misread"), ("s", "page_number"), ("s", "running_header")]
    text = {r["doc_id"]: r["text"] for r in scans.repaired(df).collect()}
    assert "liability clause and documented it" in text["s"] and "report" not in text["s"].lower() and "- 5 -" not in text["s"]
    assert text["w"].count("\n") == 0 and page


def test_scans_of_nothing(spark):
    assert scans.defects(spark.createDataFrame([], "doc_id string, content string")).count() == 0


# --- leakage ----------------------------------------------------------------


def test_leaks(spark):
    item = " ".join(f"word{i}" for i in range(40))
    han = "试验组对载波锁定进行登记低于上限的裕度为百分之二十四随后将有简短备忘"
    corpus = [
        (1, f"Before it. {item.upper().replace(' ', ',  ')} And after."),
        (2, "start " + " ".join(f"word{i}" for i in range(20)) + " end"),
        (3, "start " + " ".join(f"word{i}" for i in range(12)) + " end"),
        (4, " ".join(f"word{i}" if i % 5 else "other" for i in range(40))),
        (5, f"前面的话，{han[:20]}，" + han[20:] + "后面"),
        (6, None), (7, ""), (None, item), (8, "word1"),
    ]
    items = spark.createDataFrame([(10, item, "x"), (11, han, "x"), (12, None, "x"), (13, "", "x"), (None, item, "x"), (10, item, "x"), (14, "too short", "x")], "item_id int, text string, doc_id string")
    got = {(r["doc_id"], r["item_id"]): (r["exact_share"], r["tolerant_share"]) for r in leakage.leaks(spark.createDataFrame(corpus, "doc_id bigint, text string"), items).collect()}
    assert got[1, 10] == (1.0, 1.0) and got[2, 10][0] == 0.5 and abs(got[3, 10][0] - 0.3) < 1e-9 and got[5, 11][0] == 1.0
    assert got.get((4, 10), (0.0, 0.0))[0] == 0.0
    assert {k for k, v in got.items() if v[0] > 0.45} == {(1, 10), (2, 10), (5, 11)}
    assert leakage.leaks(spark.createDataFrame([], "doc_id bigint, text string"), items).count() == 0
    assert leakage.leaks(spark.createDataFrame(corpus, "doc_id bigint, text string"), items.limit(0)).count() == 0


def test_leaks_of_many_items_in_one_pass(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(3000)]
    texts = {i: [rng.choice(words) for _ in range(rng.randrange(12, 20))] for i in range(20_000)}
    corpus, exp = [], set()
    for d in range(300):
        mine = rng.sample(sorted(texts), 2)
        said = [rng.choice(words) for _ in range(15)]
        for i in mine:
            said += texts[i] + [rng.choice(words) for _ in range(15)]
            exp.add((d, i))
        corpus.append((d, " ".join(said)))
    items = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "item_id bigint, text string")
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for p in batches:
            seen.add(len(p))
            yield p

    read = spark.createDataFrame(corpus, "doc_id bigint, text string").mapInPandas(count, "doc_id bigint, text string")
    got = set(rows(leakage.leaks(read, items).where("exact_share > 0.99"), "doc_id", "item_id"))
    assert got == exp and seen.value == len(corpus)


def test_leaks_with_a_filter_that_lets_all_through(spark, monkeypatch):
    item = " ".join(f"word{i}" for i in range(40))
    corpus = spark.createDataFrame([(1, item), (2, "the the the " * 30), (3, " ".join(f"x{i}" for i in range(50)))], "doc_id bigint, text string")
    items = spark.createDataFrame([(10, item), (11, "the " * 200)], "item_id bigint, text string")
    plain = rows(leakage.leaks(corpus, items), "doc_id", "item_id", "exact_share")
    monkeypatch.setattr(filters, "MOST_BITS", 64)
    assert rows(leakage.leaks(corpus, items), "doc_id", "item_id", "exact_share") == plain == [(1, 10, 1.0), (2, 11, 1.0)]


# --- mixture ----------------------------------------------------------------


def test_mixture_meets_its_shares(spark):
    rng = random.Random(4)
    docs = [(i, s, " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.randrange(5, 40)))) for i, s in enumerate(["a"] * 700 + ["b"] * 200 + ["c"] * 30)]
    docs += [(5000, "a", docs[0][2]), (5001, "z", "not listed"), (5002, None, "no source"), (5003, "a", None), (5004, "a", "")]
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.1, 4), ("gone", 0.1, 2)], "source string, target_share double, max_repeats int")
    uses, shares = mixture.mix(spark.createDataFrame(docs, "doc_id bigint, source string, text string"), targets)
    s = {r["source"]: r for r in shares.collect()}
    assert s["gone"]["mixed_tokens"] == 0 and len(s) == 4
    for k in "abc":
        assert abs(s[k]["actual_share"] - s[k]["wanted_share"]) < 0.01 and s[k]["most_uses"] <= s[k]["max_repeats"]
    ids = [r["doc_id"] for r in uses.collect()]
    assert len(ids) == len(set(ids)) and not {5000, 5001, 5002, 5003, 5004} & set(ids)
    _, fixed = mixture.mix(spark.createDataFrame(docs, "doc_id bigint, source string, text string"), targets, total_tokens=10**9)
    got = {r["source"]: r for r in fixed.collect()}
    assert {k: r["most_uses"] for k, r in got.items()} == {"a": 1, "b": 2, "c": 4, "gone": 0} and {k: r["binds"] for k, r in got.items()} == {"a": True, "b": True, "c": True, "gone": False}
    assert [k for k, r in s.items() if r["binds"]] == ["c"] or sum(r["binds"] for r in s.values()) >= 1
    uses, half = mixture.mix(spark.createDataFrame(docs, "doc_id bigint, source string, text string"), targets, total_share=0.5)
    h = {r["source"]: r for r in half.collect()}
    assert abs(sum(r["mixed_tokens"] for r in h.values()) - 0.5 * sum(h[k]["available"] for k in "abc")) < 0.05 * sum(h[k]["available"] for k in "abc") or any(r["binds"] for r in h.values())
    # no text is used more often than its source may be
    assert all(r["uses"] <= {"a": 1, "b": 2, "c": 4}[r["source"]] for r in uses.collect())


def test_mixture_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id bigint, source string, text string")
    uses, shares = mixture.mix(none, spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int"))
    assert uses.count() == 0 and shares.count() == 1


# --- subjects ---------------------------------------------------------------


def test_subjects(spark):
    rng = random.Random(6)
    words = {"law": ["contract", "clause", "court", "plaintiff", "licence", "statute"], "sport": ["match", "goalkeeper", "team", "coach", "league", "trophy"]}
    plain = ["the notes were filed later", "nobody asked for another copy", "the matter returns soon"]

    def sentence(area):
        return f"the {rng.choice(words[area])} and {rng.choice(words[area])} {rng.choice(['were kept', 'was moved', 'is late'])} by us"

    docs, truth = [], {}
    for i in range(400):
        kind = rng.choice([("law",), ("sport",), ("law", "sport"), ()])
        said = [sentence(a) for a in kind for _ in range(4)] or [rng.choice(plain) for _ in range(5)]
        docs.append((i, ". ".join(said) + "."))
        truth[i] = set(kind)
    labels = spark.createDataFrame([(i, a) for i in range(60) for a in truth[i]] + [(0, "sport"), (1, None), (2, "unknown")], "doc_id bigint, area string")
    areas = spark.createDataFrame([("law", ""), ("sport", ""), (None, "")], "area string, description string")
    df = spark.createDataFrame(docs + [(900, None), (901, "")], "doc_id bigint, text string")
    got = {}
    for r in subjects.area_shares(df, areas, labels, most=0.6).where("share >= 0.24").collect():
        got.setdefault(r["doc_id"], set()).add(r["area"])
    right = sum(got.get(i, set()) == t for i, t in truth.items())
    assert right >= 0.95 * len(truth) and not {900, 901} & set(got)
    assert subjects.area_shares(df.limit(0), areas, labels).count() == 0
    assert subjects.area_shares(df, areas.limit(0), labels).count() == 0
