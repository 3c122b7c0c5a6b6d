"""Operators from recognition to answers, on cases made by hand."""

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from tessellon.functions import interfaces
from tessellon.functions import text as X
from tessellon.operators import agent, chunking, entities, generation, knowledge, queries, retrieval, specs, wiki
from tessellon.plans import pipelines
from tessellon.sources import files


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def test_terms_are_normalised_longest_first(spark):
    df = spark.createDataFrame([(1, "Bob saw the Lab and Bobby"), (2, None), (3, "")], "id int, content string")
    terms = spark.createDataFrame([("bob", "Robert"), ("lab", "Laboratory"), ("Bobby", "Robin"), (None, "x")], "alias string, standard string")
    got = dict(rows(knowledge.normalise_terms(df, terms), "id", "content"))
    assert got == {1: "Robert saw the Laboratory and Robin", 2: None, 3: ""}
    whole = dict(rows(knowledge.normalise_terms(df.withColumn("content", F.lit("labs of bob")), terms, whole_words=True), "id", "content"))
    assert whole[1] == "labs of Robert"
    assert knowledge.normalise_terms(df, terms.limit(0)).count() == 3


def test_recognition_leaves_out_what_is_invalid(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "boom"), ("c", None)], "chunk_id string, content string")

    def find(text):
        if text == "boom":
            raise ValueError(text)
        return [{"name": " X ", "type": "ORG"}, {"name": "", "type": "ORG"}, {"type": "ORG"}]

    assert rows(knowledge.recognise(df, find), "chunk_id", "entity_name", "entity_type") == [("a", "X", "ORG")]


def test_parameters_are_filled_where_empty(spark):
    models = spark.createDataFrame([("t", "s", "m1", {"w": "", "p": "5W"}), ("t", "s", "m2", {"w": "1"})], "category string, series string, model string, params map<string,string>")
    contexts = spark.createDataFrame([("m1", "weighs 2 kg"), ("m2", "x")], "model string, context string")
    got = {r["model"]: r["params"] for r in knowledge.fill_parameters(models, contexts, lambda m, c, f: {"w": "2 kg", "p": "9W", "z": 1}, ["w", "p"]).collect()}
    assert got["m1"] == {"w": "2 kg", "p": "5W"} and got["m2"] == {"w": "1", "p": "9W"}


def test_knowledge_from_chunks_to_graph(spark, tmp_path):
    chunks = spark.createDataFrame([("c1", "d1", "Alpha Institute and Beta Works build A12"), ("c2", "d1", "Beta Works alone"), ("c3", "d2", None)], "chunk_id string, doc_id string, content string")
    terms = spark.createDataFrame([("alpha", "Alpha Institute"), ("beta", "Beta Works")], "alias string, standard string")
    models = spark.createDataFrame([("t", "s", "A12", {"合作单位": "Beta"})], "category string, series string, model string, params map<string,string>")

    def recognise(text):
        return [{"name": n, "type": "ORG"} for n in ("Alpha Institute", "Beta Works") if n in text]

    def coop(content, orgs):
        return [{"units": orgs, "content": "build together", "products_or_projects": ["A12"]}, {"units": orgs[:1]}]

    got = pipelines.build_knowledge(chunks, terms, models, recogniser=recognise, extract_cooperations=coop)
    found = {(r["entity_name"], r["entity_type"]): r["frequency"] for r in got["entities"].collect()}
    assert found["Alpha Institute", "ORG"] == 1 and found["Beta Works", "ORG"] == 2 and found["A12", "PRODUCT"] == 1
    assert rows(got["cooperations"], "units", "content") == [(["Alpha Institute", "Beta Works"], "build together")]
    assert rows(got["nodes"], "kind", "name") == [("MODEL", "A12"), ("ORG", "Alpha Institute"), ("ORG", "Beta Works")]
    assert rows(got["edges"], "kind") == [("COOPERATION",), ("OWNED_BY",)]
    knowledge.save(got["nodes"], got["edges"], str(tmp_path / "g"))
    nodes, edges = knowledge.load(spark, str(tmp_path / "g"))
    assert rows(nodes, "id", "name") == rows(got["nodes"], "id", "name") and edges.count() == 2
    assert rows(knowledge.model_nodes(models), "filled") == [(["合作单位"],)]
    assert set(pipelines.build_knowledge(chunks, terms, models, steps=("entities",))) == {"entities"}


def test_close_names_become_candidates(spark):
    found = spark.createDataFrame([("Alpha Institute", "ORG", 5), ("Alpha Institutes", "ORG", 1), ("Zebra", "ORG", 2), ("Alpha Institute", "TERM", 1)], "entity_name string, entity_type string, frequency int")
    got = knowledge.alias_candidates(found, interfaces.hashed_embedder(), 0.8).collect()
    assert [(r["standard_name"], [c["alias"] for c in r["candidate_aliases"]]) for r in got] == [("Alpha Institute", ["Alpha Institutes"])]


def test_phrases(spark):
    index = spark.createDataFrame([("a", "red big green box"), ("b", "green red"), ("c", "red one two three green"), ("d", None)], "chunk_id string, content string")
    wanted = spark.createDataFrame([(1, ["red", "green"], 2.0), (2, ["red", "green", "box"], 1.0), (3, [], 1.0)], "query_id int, phrase array<string>, boost double")
    found = retrieval.phrases(wanted, index)
    assert rows(found, "query_id", "chunk_id") == [(1, "a"), (2, "a")]
    scored = spark.createDataFrame([(1, "a", 1.0), (1, "b", 3.0)], "query_id int, chunk_id string, score double")
    assert rows(retrieval.with_phrases(scored, found), "query_id", "chunk_id", "score") == [(1, "a", 3.0), (1, "b", 3.0), (2, "a", 1.0)]
    assert retrieval.phrases(wanted.limit(0), index).count() == 0


def test_answers_are_asked_again_only_where_that_helps(spark):
    asked = spark.createDataFrame([(1, "ok"), (2, "busy"), (3, "bad"), (4, None)], "query_id int, prompt string")

    def call(prompt, attempt):
        if prompt == "bad":
            raise KeyError("no such model")
        if prompt == "busy" and attempt < 2:
            raise RuntimeError("429")
        return prompt.upper()

    got = {r["query_id"]: (r["answer"], r["tries"]) for r in generation.answers(asked, call, wait=lambda n: 0.0).collect()}
    assert got == {1: ("OK", 1), 2: ("BUSY", 3), 3: (None, 1), 4: (None, 0)}
    assert generation.back_off(1) == 2.0 and "prompt" in generation.stand_in("prompt")


def test_quick_search_from_words_to_answers(spark):
    docs = spark.createDataFrame([("d1", "# Power\n\n" + "The antenna draws forty watts in daylight. " * 30), ("d2", "# Mass\n\n" + "The mirror weighs two kilograms on the ground. " * 30)], "doc_id string, content string")
    made = chunking.chunk(docs).withColumn("embedding_vector", F.pandas_udf(interfaces.hashed_embedder(), "array<float>")("content"))
    index = made.withColumn("doc_title", F.col("doc_id")).withColumn("dataset_id", F.lit("s")).withColumn("is_latest", F.lit(True)).withColumn("summary", F.lit(None).cast("string"))
    asked = spark.createDataFrame([(1, "antenna watts"), (2, "mirror kilograms")], "query_id int, query string")
    seed = spark.createDataFrame([("ant", "antenna")], "alias string, standard string")
    got = {r["query_id"]: r for r in pipelines.quick_search(asked, index, seed, retrieval.Options(top_k=3), interfaces.hashed_embedder(), generate=lambda q, n: q + " hypothetical", n_hypothetical=2, scorer=interfaces.overlap_scorer(), call=lambda p, n: p[:6]).collect()}
    assert "forty watts" in got[1]["context"] and "two kilograms" in got[2]["context"] and got[1]["answer"].startswith("问题")
    near = agent.vector_search(asked, index, interfaces.hashed_embedder(), options=retrieval.Options(top_k=2))
    assert near.count() == 4
    groups = spark.createDataFrame([(1, ["mirror", "ground"]), (0, ["antenna"])], "group_id int, terms array<string>")
    assert [r["query_id"] for r in agent.term_search(groups, index, options=retrieval.Options(top_k=1)).collect()] == [0, 1]


def test_terms_are_protected_and_segmented(spark):
    df = spark.createDataFrame([(1, "用NX1智算机和卫星导航的重量")], "query_id int, query string")
    got = df.select(queries.protected("query", ["NX1智算机"], X.space_scripts).alias("t")).first()["t"]
    assert "NX1智算机" in got
    terms = spark.createDataFrame([("卫星", "卫星导航"), ("智算机", "智算机")], "alias string, standard string")
    words = [r["term"] for r in queries.segmented(df, terms).orderBy("position").collect()]
    assert "卫星导航" in words and "智算机" in words


def test_pages_go_in_by_rule(spark):
    pages = spark.createDataFrame([("index.md", "- a"), ("overview.md", "old"), ("p/x.md", "---\ntitle: X\nsources: [s1]\n---\n\nbody")], "path string, text string")
    said = []

    def ask(name, text, known):
        said.append((name, known.get("index.md")))
        return f"FILE: index.md\n---\n- {name}\nFILE: overview.md\n---\nnew {name}\nFILE: p/x.md\n---\nsources: [{name}]\n---\nmore {name}"

    got, taken = wiki.ingest_sources(pages, [("one", "t"), ("two", "t"), ("three", "t")], ask, done={"two"})
    text = dict(rows(got, "path", "text"))
    assert taken == ["one", "three"] and "- one" in said[1][1]
    assert "new three" in text["overview.md"] and "- one" in text["index.md"] and "- three" in text["index.md"] and "- [ingest] three" in text["log.md"]
    assert "body" in text["p/x.md"] and "more one" in text["p/x.md"] and "more three" in text["p/x.md"]
    assert rows(wiki.ingested(spark.createDataFrame([(x,) for x in text["log.md"].split("\n")], "line string")), "filename") == [("one",), ("three",)]


def _zip(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members.items():
            z.writestr(name, data)
    return out.getvalue()


def test_slides_and_sheets():
    a = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
    slide = lambda *ts: f"<s {a}>" + "".join(f"<a:p><a:r><a:t>{t}</a:t></a:r></a:p>" for t in ts) + "</s>"
    pptx = _zip({"ppt\\slides\\slide2.xml": slide("Second"), "ppt\\slides\\slide1.xml": slide("First", "text")})
    assert files.CONVERTERS["pptx"][0](pptx) == "# First\n\ntext\n\n# Second"
    m = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    sheet = f'<worksheet {m}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>7</v></c></row><row><c r="A2" t="inlineStr"><is><t>x|y</t></is></c></row></sheetData></worksheet>'
    xlsx = _zip({"xl/workbook.xml": f'<workbook {m}><sheets><sheet name="Data"/></sheets></workbook>', "xl/sharedStrings.xml": f"<sst {m}><si><t>head</t></si></sst>", "xl/worksheets/sheet1.xml": sheet})
    assert files.CONVERTERS["xlsx"][0](xlsx) == "## Data\n\n| head |  | 7 |\n| --- | --- | --- |\n| x\\|y |  |  |"


def test_limits_that_are_no_numbers_pass(spark):
    df = spark.createDataFrame([("m", {"重量": "2kg"})], "model string, params map<string,string>")
    assert specs.constrained(specs.measures(df), {"重量": "<=1.2.3"}).count() == 1
    assert specs.constrained(specs.measures(df), {"重量": "<=1.5"}).count() == 0


def test_low_quality_is_one_rule_in_both_places(spark):
    texts = ["", "a", "one two three", "<td>x</td>", "<p>some words here to read and more of them than fifteen in all so that it stays as it is</p>", "</td></tr><tr><td>", "共3", "<b>no</b>"]
    got = dict(rows(spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.is_low_quality("t").alias("low")), "t", "low"))
    assert got == {t: chunking._low_quality(t) for t in texts}


def test_partners_and_counts(spark):
    sets = spark.createDataFrame([("c1", ["A", "B"]), ("c2", ["A"])], "chunk_id string, orgs array<string>")
    assert rows(entities.partners(sets, "A"), "chunk_id", "others") == [("c1", ["B"])]
    assert isinstance(interfaces.first_sentence()(pd.Series(["abc"])), pd.Series)
