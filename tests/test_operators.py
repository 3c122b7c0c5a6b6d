import os

import pytest
from pyspark.sql import functions as F

from tessellon.functions import interfaces
from tessellon.operators import agent, entities, graph, index, queries, retrieval, specs, versions, wiki
from tessellon.plans import pipelines
from tessellon.sources import files
from tessellon.streaming import ingest


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


def ranked(spark, data):
    return spark.createDataFrame(data, "query_id int, chunk_id string, rank int")


def test_fusion_is_symmetric_and_ties_follow_the_first_list(spark):
    a, b = ranked(spark, [(1, "x", 0), (1, "y", 1)]), ranked(spark, [(1, "y", 0), (1, "z", 1)])
    one = rows(retrieval.fuse(a, b, 0.5, 0.5), "chunk_id", "score")
    assert one == rows(retrieval.fuse(b, a, 0.5, 0.5), "chunk_id", "score")
    top = retrieval.fused_top(retrieval.fuse(a, b, 0.5, 0.5), 10).orderBy("rank").collect()
    assert [r["chunk_id"] for r in top] == ["y", "x", "z"] and top[0]["score"] == pytest.approx(0.5 / 61 + 0.5 / 60)


def test_expand(spark):
    idx = spark.createDataFrame([(c, k, p) for c, k, p in [("p1", "parent", None), ("p2", "parent", None), *[(f"d_c{i}", "child", "p1") for i in range(4)], ("e_c0", "child", "p2"), ("s1", "summary", "p2"), ("lost", "child", "gone")]], "chunk_id string, chunk_type string, parent_id string")
    hits = spark.createDataFrame([(1, "e_c0", "child", "p2", 0.9, 0), (1, "d_c0", "child", "p1", 0.5, 1), (1, "d_c2", "child", "p1", 0.8, 2), (1, "lost", "child", "gone", 0.1, 3), (2, "s1", "summary", "p2", 0.7, 0), (3, "d_c1", "child", "p1", 0.6, 0)], "query_id int, chunk_id string, chunk_type string, parent_id string, score double, rank int")
    got = rows(retrieval.expand(hits, idx), "query_id", "position", "chunk_id", "score", "expanded")
    assert got == [(1, 0, "e_c0", 0.9, False), (1, 1, "p1", 0.8, True), (1, 2, "lost", 0.1, False), (2, 0, "p2", 0.7, True), (3, 0, "d_c1", 0.6, False)]
    near = rows(retrieval.expand(hits.where("query_id = 3"), idx, siblings=1), "position", "chunk_id")
    assert sorted(c for _, c in near) == ["d_c0", "d_c1", "d_c2"]


def test_knn_joined_and_multiplied_agree(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 2.0]), ("z", [0.0, 0.0]), ("n", None), ("l", [1.0])], "chunk_id string, vec array<float>")
    q = spark.createDataFrame([(1, [1.0, 1.0]), (2, [-1.0, 0.0]), (3, None)], "query_id int, query_vec array<float>")
    small, large = retrieval.knn(q, v), retrieval.knn(q, v, block=1)
    assert rows(small, "query_id", "chunk_id", "score") == rows(large, "query_id", "chunk_id", "score") == [(1, "a", 0.853554), (1, "b", 0.853554), (2, "b", 0.5)]


def test_options_are_checked():
    for bad in ({"top_k": 0}, {"min_score": 2.0}, {"rerank_top_k": 0}):
        with pytest.raises(ValueError):
            retrieval.Options(**bad)


def test_context_stops_at_the_budget(spark):
    hits = spark.createDataFrame([(1, "t", "x" * 40, i) for i in range(5)], "query_id int, doc_title string, content string, position int")
    assert retrieval.context(hits, budget=110).first()["n_chunks"] == 2


def test_keywords(spark):
    q = spark.createDataFrame([(1, "设备G1的重量是多少"), (2, "what is the weight of NX1"), (3, "是什么"), (4, None)], "query_id int, query string")
    got = rows(queries.keywords(q, spark.createDataFrame([("nx1", "NX1")], "alias string, standard string")), "query_id", "term", "weight")
    assert (1, "g1", 0.5) in got and (2, "nx1", 3.0) in got and (2, "weight", 0.5) in got and not any(g[1] in ("the", "of") for g in got)


def test_clauses_of_one_and_of_two_keywords(spark):
    kw = spark.createDataFrame([(1, 0, "a", 1.0), (2, 0, "b", 0.6), (2, 1, "c", 0.4)], "query_id int, position int, term string, weight double")
    syn = spark.createDataFrame([("bb", "b")], "alias string, standard string")
    got = rows(queries.clauses(kw, syn), "query_id", "layer", "term", "boost")
    assert got == [(1, "term", "a", 1.0), (2, "phrase", "b c", 6.0), (2, "synonym", "bb", 0.6), (2, "synonym_phrase", "bb", 0.7), (2, "term", "b", 3.0), (2, "term", "c", 2.0)]


@pytest.mark.parametrize(("text", "n"), [("重量<3kg", 1), ("算力>=10", 2), ("尺寸==100x100x50", 1), ("重量!=3", 1), ("重量 ? 3", 2)])
def test_spec_conditions(spark, text, n):
    df = spark.createDataFrame([("c", "s", "m1", {"重量": "2.5kg", "算力": "12TOPS", "尺寸": "100x100x50"}), ("c", "s", "m2", {"重量": "3kg", "算力": "10", "尺寸": "90", "空": ""})], "category string, series string, model string, params map<string,string>")
    assert specs.query(df, condition=text).count() == n


def test_spec_limits_and_order(spark):
    df = spark.createDataFrame([("c", "s", "m1", {"重量": "2.5kg", "b": "x"}), ("c", "s", "m2", {"功耗": "64W"})], "category string, series string, model string, params map<string,string>")
    m = specs.measures(df)
    assert rows(specs.constrained(m, {"重量": " <=2"}), "model") == [("m2",)]
    assert specs.constrained(m, {"重量": "about 2"}).count() == 2
    assert specs.required_first(df, ["b"]).where("model = 'm1'").first()["shown"][0]["name"] == "b"


def test_link_resolution(spark):
    pages = spark.createDataFrame([("A B", "p1", "---\ntitle: T\ntype: concept\n---\n[[a-b]] [[self]] [[nowhere]] [[c]] [[c]]"), ("a-b", "p2", "[[A B]]"), ("self", "p3", "[[self]]"), ("C", "p4", "x"), ("q", "p5", "---\ntype: query\n---\n[[C]]")], "id string, path string, text string")
    nodes, edges = graph.build(pages)
    deg = dict(rows(nodes, "id", "link_count"))
    assert deg == {"A B": 5, "a-b": 2, "self": 1, "C": 2} and edges.count() == 3


def test_louvain_and_propagation_split_two_cliques(spark):
    e = [(a, b, 1.0) for g in ("abcd", "wxyz") for i, a in enumerate(g) for b in g[i + 1 :]] + [("d", "w", 1.0)]
    edges = spark.createDataFrame(e, "source string, target string, weight double")
    nodes = spark.createDataFrame([(x,) for x in "abcdwxyz!"], "id string")
    got = dict(rows(graph.louvain(nodes, edges), "id", "community"))
    assert len({got[x] for x in "abcd"}) == len({got[x] for x in "wxyz"}) == 1 and got["a"] != got["w"] and got["!"] == "!"
    assert graph.louvain(nodes, edges.limit(0)).count() == 9 and graph.louvain(nodes.limit(0), edges.limit(0)).count() == 0
    by_spread = dict(rows(graph.propagate(edges), "id", "community"))
    assert set(by_spread) == set("abcdwxyz")
    assert graph.modularity(graph.louvain(nodes, edges), edges).first()[0] == pytest.approx(12 / 13 - 0.5, abs=1e-6)


def test_louvain_comes_near_the_best_split(spark):
    # a ring of eight cliques: the best split is the cliques, and the links between them are few
    e = [(f"{g}{i}", f"{g}{j}", 1.0) for g in "abcdefgh" for i in range(6) for j in range(i + 1, 6)] + [(f"{a}0", f"{b}1", 1.0) for a, b in zip("abcdefgh", "bcdefgha")]
    edges = spark.createDataFrame(e, "source string, target string, weight double")
    nodes = spark.createDataFrame([(f"{g}{i}",) for g in "abcdefgh" for i in range(6)], "id string")
    got = graph.louvain(nodes, edges)
    # one task and distributed rounds make the same moves
    assert rows(got, "id", "community") == rows(graph.louvain(nodes, edges, in_a_task=0), "id", "community")
    assert got.groupBy("community").count().where("count = 6").count() == 8
    stats = graph.numbered(got.groupBy("community").agg(F.count("*").alias("n_nodes")))
    assert rows(stats, "number") == [(i,) for i in range(8)]


def test_many_queries_go_in_blocks(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    q, v = rng.standard_normal((5000, 8)), rng.standard_normal((50, 8))
    asked = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "query_id int, query_vec array<double>")
    stored = spark.createDataFrame([(f"v{i:02d}", x.tolist()) for i, x in enumerate(v)], "chunk_id string, vec array<double>")
    got = {(r["query_id"], r["chunk_id"]) for r in retrieval.top(retrieval.knn(asked, stored, k=3, floor=-1.0), 3).collect()}
    cos = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (v / np.linalg.norm(v, axis=1, keepdims=True)).T
    assert got == {(i, f"v{j:02d}") for i in range(5000) for j in np.argsort(-cos[i])[:3]}
    fresh = asked.select(F.col("query_id").alias("chunk_id"), F.col("query_vec").alias("vec"))
    seen = stored.select(F.col("chunk_id"), "vec")
    left = {r["chunk_id"] for r in retrieval.semantic_new(seen, fresh, 0.8, block=20).collect()}
    assert left == {i for i in range(5000) if cos[i].max() <= 0.8}


def test_org_groups_chain(spark):
    df = spark.createDataFrame([("ABC", 1), ("ABC Corp", 5), ("The ABC Corp Ltd", 2), ("abc", 1), ("other", 9)], "name string, frequency int")
    got = dict(rows(entities.org_groups(df), "name", "representative"))
    assert {got[x] for x in ("ABC", "ABC Corp", "The ABC Corp Ltd", "abc")} == {"ABC Corp"} and got["other"] == "other"


def test_cooperation_is_merged_without_order(spark):
    df = spark.createDataFrame([(["b", "a"], "x", ["p"], "c1", 0.1, 1), (["a", "b"], "x", ["q"], "c2", 0.9, 2), (["a", "b"], "y", ["p"], "c3", 0.2, 3), (["a"], "z", [], "c4", 0.3, 4)], "units array<string>, content string, products_or_projects array<string>, source_chunk string, confidence double, position int")
    got = {tuple(r["units"]): r for r in entities.merge_cooperation(df).collect()}
    r = got["a", "b"]
    assert (r["content"], r["products"], r["source_chunks"], r["confidence"]) == ("x；y", ["p", "q"], ["c1", "c2", "c3"], 0.9)


def test_dictionary_counts_overlaps(spark):
    df = spark.createDataFrame([("c", "aaaa Bob"), ("d", None)], "chunk_id string, content string")
    terms = spark.createDataFrame([("aa", "A"), ("bob", "Robert")], "alias string, standard string")
    # a standard is a term itself, here of one character
    assert rows(entities.dictionary_hits(df, terms), "standard", "n") == [("A", 7), ("Robert", 1)]
    more = terms.union(spark.createDataFrame([("a", "One"), ("aaaa bob", "Long")], "alias string, standard string"))
    exp = [("A", 7), ("Long", 1), ("One", 4), ("Robert", 1)]
    assert rows(entities.dictionary_hits(df, more), "standard", "n") == rows(entities.dictionary_hits(df, more, most=0), "standard", "n") == exp


def test_versions_by_name_and_content(spark):
    f = spark.createDataFrame([("d", n) for n in ("x-v1.docx", "x-v2.docx", "会议纪要-v1.doc", "会议纪要-v2.doc", "a.docx", "a.pdf")], "folder string, filename string")
    assert [(r["base"], r["files"]) for r in versions.name_groups(f).collect()] == [("x", ["x-v1.docx", "x-v2.docx"])]
    t = "the quick brown fox jumps over the lazy dog and runs away from it all at once"
    c = spark.createDataFrame([("d", "a", t), ("d", "b", t + "!"), ("d", "c", t + "?"), ("e", "a2", t), ("d", "s", "short")], "folder string, filename string, content string")
    pairs = versions.similar_contents(c)
    assert rows(pairs, "a", "b") == [("a", "b"), ("a", "c"), ("b", "c")]
    assert rows(versions.greedy_clusters(pairs), "seed", "member") == [("a", "a"), ("a", "b"), ("a", "c")]


def test_wiki_blocks(spark):
    text = "- early bullet\nFILE: wiki/a.md\n---\ntitle: A\n---\nbody\n---\nmore\nREVIEW: check it\nType: Suggestion\nReason:why\n- one\n- two\nFILE: b.md\n---\nx"
    assert wiki.parse_files(text) == [("wiki/a.md", "---\ntitle: A\n---\nbody\n---\nmore"), ("b.md", "---\nx")]
    assert wiki.parse_reviews(text) == [("check it", "suggestion", "why", ["one", "two"])]
    df = spark.createDataFrame([(1, text), (2, None)], "reply_id int, text string")
    assert wiki.file_blocks(df).count() == 2 and wiki.review_blocks(df).count() == 1


def test_pages_merge(spark):
    old = spark.createDataFrame([("a", "---\ntitle: A\nsources: [s1]\n---\n\nold"), ("b", "only old")], "path string, text string")
    new = spark.createDataFrame([("a", "---\nsources: [s1, s2]\n---\n\nnew"), ("c", "only new")], "path string, text string")
    got = dict(rows(wiki.merge_pages(old, new), "path", "text"))
    twice = dict(rows(wiki.merge_pages(old.limit(0), new.union(spark.createDataFrame([("c", "more new")], "path string, text string"))), "path", "text"))
    assert "only new" in twice["c"] and "more new" in twice["c"] and twice["a"].endswith("new")
    assert got["a"] == "---\ntitle: A\nsources: [s1, s2]\n---\n\nold\n\nnew" and got["b"] == "only old" and got["c"] == "only new"


def test_upsert_delete_and_latest(spark):
    idx = spark.createDataFrame([("a", "d1", "old", 1), ("b", "d2", "keep", 1)], "chunk_id string, doc_id string, content string, ingested_at int")
    new = spark.createDataFrame([("a", "d1", "newer", 3), ("a", "d1", "new", 2), ("c", "d3", "more", 2)], "chunk_id string, doc_id string, content string, ingested_at int")
    got = index.upsert(idx, new)
    assert rows(got, "chunk_id", "content") == [("a", "newer"), ("b", "keep"), ("c", "more")]
    assert rows(index.upsert(got, new), "chunk_id", "content") == rows(got, "chunk_id", "content")
    assert rows(index.delete(got, got.where("doc_id = 'd2'")), "chunk_id") == [("a",), ("c",)]


def test_agent_stops_when_nothing_new_comes(spark):
    found = spark.createDataFrame([("c1", [1.0, 0.0]), ("c2", [0.0, 1.0])], "chunk_id string, vec array<float>")
    a = agent.Agent(lambda q, steps: {"tool": "search_knowledge", "arguments": '{"q": "x",', "tokens": 5}, {"bm25_search": lambda args: found})
    state = a.run("q")
    assert state.chunks.count() == 2 and [s["n_new"] for s in state.steps] == [2, 0, 0] and state.tokens == 15
    assert agent.repair_json("nonsense") is None


def test_files_to_contexts(spark, tmp_path):
    d = tmp_path / "raw" / "ds1"
    os.makedirs(d)
    (d / "x-v1.md").write_text("# T\n\n" + "The antenna weighs two kilograms and works well. " * 30)
    (d / "x-v2.md").write_text("# T\n\n" + "The antenna weighs three kilograms and works well. " * 30)
    (d / "t.csv").write_text("型号,重量\nNX1,2kg\n")
    (d / "~$tmp.md").write_text("no")
    (d / "bad.pdf").write_bytes(b"%PDF")
    (tmp_path / "v.json").write_text('{"x-v1.md": "x", "x-v2.md": "x"}')
    scanned = files.scan(spark, str(tmp_path / "raw"))
    assert rows(scanned, "relative", "format", "dataset_id") == [("ds1/bad.pdf", "pdf", "ds1"), ("ds1/t.csv", "csv", "ds1"), ("ds1/x-v1.md", "md", "ds1"), ("ds1/x-v2.md", "md", "ds1")]
    assert rows(files.to_markdown(scanned), "status") == [("no converter",), ("ok",), ("ok",), ("ok",)]
    made = pipelines.ingest(scanned, versions=files.version_map(spark, str(tmp_path / "v.json"))).cache()
    latest = {r["doc_title"] for r in made.where("is_latest").collect()}
    assert latest == {"x-v2", "t"} and made.where("chunk_type = 'child' and embedding_vector is null").count() == 0
    cache = scanned.select(F.sha2("content", 256).alias("content_hash"))
    assert files.not_cached(scanned, cache).count() == 0
    asked = spark.createDataFrame([(1, "antenna kilograms")], "query_id int, query string")
    seed = spark.createDataFrame([("ant", "antenna")], "alias string, standard string")
    got = pipelines.answer_contexts(asked, made, seed, embed=interfaces.hashed_embedder(), scorer=interfaces.overlap_scorer()).collect()
    assert "three kilograms" in got[0]["context"] and "two kilograms" not in got[0]["context"]
    assert files.version_map(spark, str(tmp_path / "none.json")).count() == 0


def test_stream_ingest(spark, tmp_path):
    schema = "chunk_id string, content string, ingested_at int"
    src, target = str(tmp_path / "in"), str(tmp_path / "out")
    run = lambda: ingest.ingest_chunks(ingest.stream(spark, src, schema, 1), target, str(tmp_path / "cp"), compact_every=2).awaitTermination()
    spark.createDataFrame([("a", "old", 1), ("b", "b", 1)], schema).coalesce(1).write.parquet(src)
    run()
    for i in range(2, 6):
        spark.createDataFrame([("a", f"new{i}", i)], schema).coalesce(1).write.mode("append").parquet(src)
        run()
    assert rows(ingest.read_index(spark, target), "chunk_id", "content") == [("a", "new5"), ("b", "b")]
    kept = os.listdir(target)
    assert "base-000000000003" in kept and "delta-000000000000" not in kept


def test_stream_ingest_survives_a_crash_between_writes(spark, tmp_path):
    schema = "chunk_id string, content string, ingested_at int"
    target = str(tmp_path / "out")
    one = spark.createDataFrame([("a", "old", 1), ("b", "b", 1)], schema)
    two = spark.createDataFrame([("a", "new", 2)], schema)
    ingest.write_batch(one, 0, target)
    # a delta whose write broke off has no mark of its end, and so has a base
    ingest.write_batch(two, 1, target, compact_every=2)
    os.remove(f"{target}/base-000000000001/_SUCCESS")
    assert rows(ingest.read_index(spark, target), "chunk_id", "content") == [("a", "new"), ("b", "b")]
    os.remove(f"{target}/delta-000000000001/_SUCCESS")
    assert rows(ingest.read_index(spark, target), "chunk_id", "content") == [("a", "old"), ("b", "b")]
    # the batch comes again after the restart
    ingest.write_batch(two, 1, target, compact_every=2)
    ingest.write_batch(two, 1, target, compact_every=2)
    assert rows(ingest.read_index(spark, target), "chunk_id", "content") == [("a", "new"), ("b", "b")]


def test_stream_ingest_flips_versions(spark, tmp_path):
    schema = "chunk_id string, doc_id string, dataset_id string, source_key string, content string, is_latest boolean, ingested_at int"
    target = str(tmp_path / "out")
    ingest.write_batch(spark.createDataFrame([("a", "d1", "s", "k", "1", True, 1), ("x", "d9", "s", None, "9", True, 1)], schema), 0, target)
    ingest.write_batch(spark.createDataFrame([("b", "d2", "s", "k", "2", True, 2)], schema), 1, target)
    assert rows(ingest.read_index(spark, target), "chunk_id", "is_latest") == [("a", False), ("b", True), ("x", True)]


def test_entities_are_merged_as_they_come(spark, tmp_path):
    schema = "entity_name string, entity_type string, frequency bigint, source_docs array<string>, source_chunks array<string>"
    target = str(tmp_path / "out")
    first = spark.createDataFrame([("A", "ORG", 2, ["d1"], ["c1"]), ("B", None, 1, None, [])], schema)
    for n in (0, 0, 1):
        ingest.fold_batch(first, n, target, ingest.merged_entities)
    got = {r["entity_name"]: (r["frequency"], r["source_docs"]) for r in ingest.read_state(spark, target).collect()}
    assert got == {"A": (4, ["d1"]), "B": (2, [])}


def test_types_and_patterns(spark):
    df = spark.createDataFrame([("c", "北方星座三号 uses B12, CPU and B12/C3"), ("d", None)], "chunk_id string, content string")
    assert rows(entities.pattern_hits(df), "standard", "entity_type", "n") == [("B12", "PRODUCT", 1), ("B12/C3", "PRODUCT", 1), ("北方星座三号", "PROJECT", 1)]
    got = rows(df.select("chunk_id", entities.domain_type("content").alias("t"), entities.domain_type("content", {"X": ["CPU"]}).alias("u")).where("chunk_id = 'c'"), "t", "u")
    assert got == [("PROJECT", "X")]


def test_components_of_long_chains_and_stars(spark):
    # down from n to 1 with 0 at the end of n: the smallest has to come along the whole chain
    chain = [("c%04d" % i, "c%04d" % (i + 1)) for i in range(1, 400)] + [("c0000", "c0400")]
    star = [("s999", "s%03d" % i) for i in range(300)]
    edges = spark.createDataFrame(chain + star + [("t", "u"), ("u", "t"), ("x", "x"), ("x", None)], "a string, b string")
    exp = {"c%04d" % i: "c0000" for i in range(401)} | {"s%03d" % i: "s000" for i in [*range(300), 999]} | {"t": "t", "u": "t"}
    assert {r["id"]: r["root"] for r in graph.components(edges).collect()} == exp
    # and by rounds alone
    assert {r["id"]: r["root"] for r in graph.components(edges, in_a_task=0).collect()} == exp


def test_louvain_of_long_chains_and_many_small_components(spark):
    chain = [("c%04d" % i, "c%04d" % (i + 1), 1.0) for i in range(1, 400)] + [("c0000", "c0400", 1.0)]
    threes = [(f"t{i}{a}", f"t{i}{b}", 1.0) for i in range(100) for a, b in ("ab", "bc", "ac")]
    edges = spark.createDataFrame(chain + threes, "source string, target string, weight double")
    nodes = edges.select(F.explode(F.array("source", "target")).alias("id"))
    got = graph.louvain(nodes, edges)
    # all in one share; small ones in shares and the chain by itself
    assert rows(got, "id", "community") == rows(graph.louvain(nodes, edges, in_a_task=1000), "id", "community")
    by = dict(rows(got, "id", "community"))
    assert len(by) == 701 and all(len({by[f"t{i}{a}"] for a in "abc"}) == 1 for i in range(100))
    assert graph.modularity(got, edges).first()[0] > 0.9


def test_greedy_clusters_of_a_long_chain(spark):
    chain = [("c%04d" % i, "c%04d" % (i + 1)) for i in range(1, 400)] + [("c0000", "c0400")]
    pairs = spark.createDataFrame([("f", a, b) for a, b in chain], "folder string, a string, b string")
    # each seed takes the next file, the last but one is left without a free one
    exp = [("c0000", "c0400")] + [("c%04d" % i, "c%04d" % (i + 1)) for i in range(1, 399, 2)]
    assert rows(versions.greedy_clusters(pairs), "seed", "member") == sorted((s, m) for s, t in exp for m in (s, t))
