import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessellon.functions import text as X
from tessellon.operators import chunking as C


def value(spark, column, **columns):
    df = spark.createDataFrame([tuple(columns.values())], ", ".join(f"{k} string" for k in columns))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("raw", "low"), [("共3", True), ("64W", True), ("one two three", False), ("两个字", False), (None, True), ("<td>a</td></tr>\n<tr><td>", True), ("<table>" + "<b></b>" * 20 + "ab", True)])
def test_low_quality(spark, raw, low):
    assert value(spark, X.is_low_quality("t"), t=raw) is low


@pytest.mark.parametrize(("raw", "clean"), [("see [t](http://x.y/z) or http://a.b and me@c.de", "see [t](http://x.y/z) or  and "), ("![i](https://x/y.png)text", "text")])
def test_addresses(spark, raw, clean):
    assert value(spark, X.drop_addresses("t"), t=raw) == clean


@pytest.mark.parametrize(("raw", "plain", "words"), [("standard agenda", "stard age", "standard agenda"), ("on 2024-01-01 Page 3", "on 202401 ", "on 202401 "), ("on 2024年01月01日 x", "on  x", "on  x"), ("a 3/4 b", "a  b", "a  b")])
def test_headers_and_footers(spark, raw, plain, words):
    squeeze = lambda s: re.sub(" {2,}", " ", s)
    assert value(spark, X.drop_headers_footers("t"), t=raw) == squeeze(plain)
    assert value(spark, X.drop_headers_footers("t", whole_words=True), t=raw) == squeeze(words)


def test_meta_tables(spark):
    sign = "<table><tr><td>编制</td><td>审核</td></tr></table>"
    long = "<table>" + "<tr><td>编制 审核</td></tr>" * 21 + "</table>"
    assert value(spark, X.drop_meta_tables("t"), t=f"a{sign} {sign}b{long}") == f"ab{long}"
    assert value(spark, X.is_meta_table("t"), t=sign) and value(spark, X.is_meta_table("t"), t="<table> | - </table>")


def test_normal_forms(spark):
    assert value(spark, X.half_width("t"), t="ＡＢ　１２！") == "AB 12!"
    assert value(spark, X.compare_form("t"), t=" ＡB　c\n") == "abc"
    assert value(spark, X.space_scripts("t"), t="设备G1是多少") == "设备 G1 是多少"
    assert value(spark, X.slug("t"), t=" A B--c! ü ") == "a-b-c-ü"
    assert value(spark, X.safe_file_name("t"), t='a/b:c?"') == "a_b_c__"
    assert value(spark, X.escape_query("t"), t="a+b(c)") == "a\\+b\\(c\\)"


@pytest.mark.parametrize(("name", "base"), [("x-v1.5.docx", "x"), ("20240607-x.pdf", "x"), ("x_终版.doc", "x"), ("a.docx", "a"), ("报告 (2).pdf", "报告")])
def test_base_names(spark, name, base):
    assert value(spark, X.base_name("t"), t=name) == base


def test_version_order(spark):
    names = ["x_终版.doc", "x-v2.10.doc", "x.doc", "20240607-x.doc", "x-v2.9.doc"]
    df = spark.createDataFrame([(n,) for n in names], "n string").orderBy(X.version_order("n"))
    assert [r["n"] for r in df.collect()] == ["20240607-x.doc", "x-v2.9.doc", "x-v2.10.doc", "x.doc", "x_终版.doc"]


def test_front_matter_and_links(spark):
    page = "---\ntitle: \"A page\"\ntype: concept\ntags: [x, 'y']\n---\n\nBody [[A B]] and [[a-b|alias]]\n---\ntitle: not this"
    assert value(spark, X.front_value("t", "title"), t=page) == "A page"
    assert value(spark, X.front_list("t", "tags"), t=page) == ["x", "y"]
    assert value(spark, X.wiki_links("t"), t=page) == ["A B", "a-b"]
    assert value(spark, X.page_body("t"), t=page).endswith("title: not this")


@pytest.mark.parametrize(("reply", "found"), [('{"a": 1}', '{"a": 1}'), ('x ```json\n{"a": 1}\n``` y', '{"a": 1}'), ("well {'a': 1,} so", '{"a": 1}'), ("<html>{}</html>", None), ("none", None)])
def test_json_of_replies(spark, reply, found):
    assert value(spark, X.json_text("t"), t=reply) == found


def test_trigrams_and_jaccard(spark):
    assert sorted(value(spark, X.trigrams("t"), t="abcabc")) == ["abc", "bca", "cab"]
    assert value(spark, X.trigrams("t"), t="ab") == []
    assert value(spark, X.jaccard(X.trigrams("t"), X.trigrams("u")), t="ab", u="") == 0.0


# --- chunking ---------------------------------------------------------------


def test_tables_with_spans():
    html = "<table><tr><td rowspan='2'>a</td><td colspan=\"2\">b</td></tr><tr><td>c</td><td>d|e</td></tr></table>"
    assert C.table_markdown(html) == "| a | b | b |\n| --- | --- | --- |\n| a | c | d\\|e |"
    assert C.table_markdown("<table></table>") == ""


def test_split_table_repeats_its_header():
    md = "| h |\n| --- |\n" + "\n".join(f"| row {i:03d} |" for i in range(50))
    parts = C.split_table(md, 120)
    assert len(parts) > 1 and all(p.startswith("| h |\n| --- |") and len(p) <= 120 for p in parts)
    assert sum(p.count("row") for p in parts) == 50


def test_sections_drop_merge_and_split():
    text = "# 目录\n\nx\n\n# A\n\n" + "a " * 300 + "\n\n## B\n\n" + "b " * 300 + "\n\n# C\n\n" + "c " * 1100
    out = C.parents_of(text)
    assert all("目录" not in b for _, b in out) and out[0][0] == "A / B"
    assert "".join(b for _, b in out).count("c ") >= 1099


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="ab \n", min_size=0, max_size=1500))
def test_recursive_split_covers_the_text(text):
    parts = C.recursive_split(text, 100, 20)
    assert all(0 < len(p) <= 100 for p in parts)
    assert set("".join(text.split())) == set("".join("".join(parts).split()))
    assert len("".join("".join(parts).split())) >= len("".join(text.split()))


def test_short_children():
    assert C.merge_short([("cap", False), ("| t |", True)]) == ["cap\n\n| t |"]
    assert C.merge_short([("x" * 500, False), ("y", False)]) == ["x" * 500 + "\n\ny"]
    assert C.merge_short([("x" * 749, False), ("y", False), ("z" * 749, False)]) == ["x" * 749, "y", "z" * 749]


def test_chunk_ids_are_unique(spark):
    text = "\n\n".join(f"# H{i}\n\n" + f"sentence number {i} with words. " * 60 for i in range(6)) + "<table><tr><td>型号</td><td>重量</td></tr></table>"
    df = spark.createDataFrame([("d", text), ("e", None), ("f", "")], "doc_id string, content string")
    for apart in (False, True):
        out = C.chunk(df, tables_apart=apart).collect()
        ids = [r["chunk_id"] for r in out]
        assert len(ids) == len(set(ids)) and {r["doc_id"] for r in out} == {"d"}
        parents = {r["chunk_id"] for r in out if r["chunk_type"] == "parent"}
        assert {r["parent_id"] for r in out if r["chunk_type"] == "child"} <= parents
    assert any(r["table_type"] == "参数表" for r in out)
