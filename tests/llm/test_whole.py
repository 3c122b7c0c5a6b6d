"""Tests that the operators do the whole job where a cut once left some of it out."""

import math
import random
import tracemalloc
from pathlib import Path

import numpy as np

from tessellon import catalog
from tessellon.llm import names, neighbours, queries
from tessellon.operators import versions
from tessellon.plans.lineage import shared_dir


def test_edited_contents_at_half_are_found(spark, tmp_path):
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(10_000_000)}"
    rows = []
    for i in range(1000):
        one = [word() for _ in range(60)]
        # 39 of the 58 runs of either are common: a similarity of 0.506
        rows += [(f"{i}a", " ".join(one)), (f"{i}b", " ".join(one[:41] + [word() for _ in range(19)]))]
    spark.createDataFrame(rows, "doc_id string, content string").write.parquet(f"{tmp_path}/document_info.parquet")
    spark.createDataFrame([], "children array<struct<metadata: map<string, string>, content: string>>").write.parquet(f"{tmp_path}/documents_tree.parquet")
    got = {(r["key_a"], r["key_b"]) for r in queries.p4_found(spark, str(tmp_path)).collect()}
    assert got <= {(f"{i}a", f"{i}b") for i in range(1000)} and len(got) >= 995


def test_similar_contents_compares_whole_texts(spark, tmp_path):
    rng = random.Random(6)
    text = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    start, end = text(5000), text(13000)
    # one beginning with other ends, and other beginnings with one end
    rows = [("a", start + text(9000)), ("b", start + text(9000)), ("c", text(2000) + end), ("d", text(2000) + end)]
    spark.createDataFrame([(k, {"dataset_id": "s"}, t) for k, t in rows], "doc_id string, metadata map<string, string>, content string").write.parquet(f"{tmp_path}/document_info.parquet")
    runs = {k: {t[i : i + 3] for i in range(len(t) - 2)} for k, t in rows}
    alike = {(a, b): len(runs[a] & runs[b]) / len(runs[a] | runs[b]) for a in runs for b in runs if a < b}
    exp = {p for p, s in alike.items() if s >= 0.7}
    assert exp == {("c", "d")}
    got = {(r["seed"], r["member"]) for r in catalog.greedy_near_dup_clusters(spark, str(tmp_path)).collect()}
    assert got == {("c", "c"), ("c", "d")}
    assert {(r["a"], r["b"]): r["similarity"] for r in catalog.queries()["trigram_jaccard_pairs"](spark, str(tmp_path)).collect()} == {p: round(alike[p], 6) for p in exp}


def test_dictionary_matches_terms_of_any_length(spark, tmp_path):
    long = "x" + "yz" * 50
    texts = {"a": f"某院与所, 院 {long}", "b": "院", "c": long[:-1], "d": None}
    spark.createDataFrame(list(texts.items()), "doc_id string, content string").write.parquet(f"{tmp_path}/document_info.parquet")
    spark.createDataFrame([("院", "研究院"), ("所", "研究所"), (long, "Long")], "alias string, standard string").write.parquet(f"{tmp_path}/terms_seed.parquet")
    got = lambda q: {(r["doc_id"], r["standard"], r["n"]) for r in catalog.queries()[q](spark, str(tmp_path)).collect()}
    assert got("dictionary_entities") == {("a", "Long", 1), ("a", "研究院", 2), ("a", "研究所", 1), ("b", "研究院", 1)}


def test_a_typo_in_a_crowded_surname_is_compared(spark):
    rng = random.Random(7)
    given = [f"{a}{b}{c}" for a in "bdk" for b in ("ola", "emi", "uri") for c in ("na", "so", "ta", "vin", "rel")]
    people = [("Podonativu", g) for g in given] + [("".join(rng.choices("bcdfgklmnprst", k=9)), g) for g in given for _ in range(45)]
    typos = [("Pdonativu", given[0]), ("Podonatvu", given[1]), ("Potonativu", given[2]), ("Podnaivu", given[3])]
    forms = [(i, "p", c.lower(), g, g[:1], "", "", "", False) for i, (c, g) in enumerate(people + typos)]
    df = spark.createDataFrame(forms, "form long, kind string, core string, given string, initial string, unit string, field string, form_kind string, han boolean")
    got = {(r["a"], r["b"]) for r in names.linked(df, 0.85).collect()}
    assert {(i, len(people) + i) for i in range(4)} <= got


def test_many_centroids_need_little_memory():
    x = np.random.default_rng(3).standard_normal((16_000, 64)).astype(np.float32)
    tracemalloc.start()
    try:
        got = neighbours._centroids(x, 8_000, 7, steps=1)
        assert tracemalloc.get_traced_memory()[1] < 100e6  # all products at once take 512 MB
    finally:
        tracemalloc.stop()
    start = x[np.random.default_rng(7).choice(len(x), 8_000, replace=False)]
    at = (x[:500] @ start.T).argmax(1)
    assert np.allclose(got[at[0]], x[(x @ start.T).argmax(1) == at[0]].sum(0) / np.linalg.norm(x[(x @ start.T).argmax(1) == at[0]].sum(0)), atol=1e-5)


def test_similar_contents_keeps_no_runs_and_loses_no_pair(spark):
    rng = random.Random(8)
    text = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz甲乙丙😀", k=n))
    files = []
    for i in range(60):
        one = text(rng.choice([60, 300, 1500, 4000]))
        # cut off or written over, so that similarities lie on both sides of 0.7
        files += [("f", f"{i}a", one), ("f", f"{i}b", one[: math.ceil(len(one) * rng.uniform(0.6, 1))]), ("f", f"{i}c", text(len(one) // rng.choice([5, 7, 20])) + one)]
    df = spark.createDataFrame(files, "folder string, filename string, content string")
    at = Path(shared_dir(spark).removeprefix("file:"))
    stored = lambda: sum(p.stat().st_size for p in at.rglob("*") if p.is_file())
    before = stored()
    pairs = versions.similar_contents(df)
    assert stored() - before < 3 * sum(len(t.encode()) for _, _, t in files)
    runs = {k: {t[i : i + 3] for i in range(len(t) - 2)} for _, k, t in files if len(t) > 50}
    alike = {(a, b): len(runs[a] & runs[b]) / len(runs[a] | runs[b]) for a in runs for b in runs if a < b}
    exp = {p: round(s, 6) for p, s in alike.items() if s >= 0.7}
    assert len(exp) > 60
    assert {(r["a"], r["b"]): r["similarity"] for r in pairs.collect()} == exp
    # and by many slices
    assert {(r["a"], r["b"]): r["similarity"] for r in versions.similar_contents(df, slice_rows=16).collect()} == exp
