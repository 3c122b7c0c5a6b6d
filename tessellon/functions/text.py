"""Column functions for cleaning, normalising and measuring text; all run inside the JVM."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of the cleaning steps, in the order in which they apply.
CONTROL = "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F\\uFFFE]"
CONTROL_LOOSE = "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F\\u00EF\\u00BF\\u00BE\\uFFFE]"
SPACES = "[\\t\\f\\r\\x20\\u00a0\\u1680\\u180e\\u2000-\\u200a\\u202f\\u205f\\u3000]{2,}"
EMAIL = "[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\\.[a-zA-Z0-9-.]+"
HEADER_FOOTER = [
    "第\\s*\\d+\\s*页",
    "(?iu)Page\\s*\\d+",
    "-\\s*\\d+\\s*-",
    "(?U)\\b\\d+\\s*/\\s*\\d+\\b",
    "(?m)^[\\s]*共\\s*\\d*\\s*页?[\\s]*$",
    "(?iu)SHEET\\s*\\d+\\s*/\\s*\\d+",
    "(?iu)DWG[_-]?\\d+",
    "原理图|电路图|PCB图|布线图",
    "\\d{4}[-/年]\\d{1,2}[-/月]\\d{1,2}[日]?",
    "(?iu)版本\\s*[A-Z]?\\d+[\\d.]*",
    "(?iu)版次\\s*\\d+",
    "(?iu)文件编号[：:]?\\s*[A-Z0-9_-]+",
    "(?iu)文档编号[：:]?\\s*[A-Z0-9_-]+",
    "(?iu)DOC\\s*NO[.:]?\\s*[A-Z0-9_-]+",
    "(?iud)©\\s*\\d{4}.*|版权所有|All\\s*rights\\s*reserved",
    "(?iu)机密|保密|NDA|CONFIDENTIAL",
    "编制\\s*[:-]?\\s*\\S+|审核\\s*[:-]?\\s*\\S+|批准\\s*[:-]?\\s*\\S+",
    "(?m)^[\\s]*续表\\s*[A-Z]?[\\d]*[\\s]*$",
    "(?m)^[\\s]*表\\s*\\d+\\s*[（(]续[)）][\\s]*$",
    "(?m)^[\\s]*(修订记录|修订履历|版本历史|变更记录|参考文献|目录|目  录|索引)[\\s]*$",
    "(?m)^[\\s]*(更改标记|更改单号|会\\s*签|签字[、，\\s]*日期|阶段标记)[\\s]*$",
]
TOC_LINE = "(?m)^\\s*\\d+(?:\\.\\d+)*\\s+\\S[^\\n]*?[.\\s]{2,}\\d{1,4}\\s*$"
TOC_HEADER = "^\\s*\\d+(?:\\.\\d+)*\\s+\\S.+[.\\s]{2,}\\d{1,4}\\s*$|^目\\s*录\\s*$"
META_HEADERS = [
    "目录", "table of contents", "index", "版本修订记录", "修订记录", "变更记录", "changelog", "版本历史", "免责声明", "版权声明", "声明", "注意事项", "重要声明",
    "preface", "foreword", "acknowledgement", "acknowledgments", "致谢", "abbreviation", "缩写", "glossary", "词汇表", "参考文献", "reference", "references",
]
META_TABLE = "编制|审核|批准|会签|签字|文件编号|研制单位|阶段标记|文档编号|版次|共.*页"
META_TABLE_WORDS = ["编制", "审核", "批准", "会签", "签字", "文件编号", "研制单位", "阶段标记", "文档编号", "版次"]
# Versions in file names.
VERSION_MARKS = [
    "[-_](?:v|V)\\d+(?:\\.\\d+)*",
    "(?:^|[-_])(20\\d{6}|20\\d{2}[-_]\\d{2}[-_]\\d{2})[-_]?",
    "[-_](?:终版|最新|定稿|终稿|会签版|签字版|修改版|修订版|改版|初稿|送审稿)",
    "[-_](?:final|draft|reviewed|approved|latest)",
    "\\s*\\(\\d+\\)",
]
FINAL_MARKS = ["final", "终版", "定稿", "终稿", "最新", "签字版", "会签版", "签发版", "发布版"]
GENERIC_NAMES = ["会议纪要", "纪要", "会议记录", "通知", "备忘录", "周报", "月报", "日报", "总结", "汇报", "报告", "meeting", "minutes", "notice", "report"]
EVENT_WORDS = ["会议纪要", "纪要", "会议记录", "会议", "通知", "备忘录", "周报", "月报", "日报", "汇报材料", "minutes", "meeting", "notice"]
# Kinds of documents and tables by the words that tell them, first match counts.
DOC_TYPES = {
    "技术文档": ["技术要求", "技术规范", "技术指标", "试验规范", "试验大纲"],
    "汇报材料": ["汇报", "报告", "工作进展", "情况报告", "请示", "建议"],
    "方案": ["整体方案", "实施方案", "设计方案", "建设方案"],
    "规范": ["规范", "标准", "要求", "准则"],
    "PPT资料": ["ppt", "pptx", "幻灯片", "演示"],
}
TABLE_TYPES = {
    "参数表": ["型号", "重量", "算力", "功耗", "接口", "尺寸", "存储", "内存", "GPU", "工作温度"],
    "合作表": ["合作单位", "地区", "合作内容", "合作模式", "预期成果", "承担单位"],
    "对比表": ["对比", "比较", "规格对比", "型号对比"],
    "指标表": ["指标", "性能指标", "技术指标", "试验指标"],
}
# Formats by suffix, and abbreviations that are no names of models.
FORMATS = {".pdf": "pdf", ".doc": "doc", ".docx": "docx", ".ppt": "ppt", ".pptx": "pptx", ".xls": "xls", ".xlsx": "xlsx", ".csv": "csv", ".md": "md"}
ABBREVIATIONS = ["API", "CPU", "GPU", "DNA", "RNA", "CEO", "CTO", "COO", "PDF", "MD"]


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(col(c), "(?U)^\\s+|\\s+\\z", "")


def hits(c: Column | str, words: list[str], fold: bool = True) -> Column:
    """How many of the words occur in the text."""
    text = F.lower(col(c)) if fold else col(c)
    return functools.reduce(lambda a, w: a + (F.instr(text, w.lower() if fold else w) > 0).cast("int"), words, F.lit(0))


def any_word(c: Column | str, words: list[str]) -> Column:
    return hits(c, words) > 0


# --- cleaning ---------------------------------------------------------------


def unbar(c: Column | str) -> Column:
    """'<|' and '|>' to plain angle brackets."""
    return F.replace(F.replace(col(c), F.lit("<|"), F.lit("<")), F.lit("|>"), F.lit(">"))


def drop_controls(c: Column | str, loose: bool = False) -> Column:
    """Without control characters; loose also takes the letters ï, ¿ and ¾ for remains of a byte order mark."""
    return F.regexp_replace(col(c), CONTROL_LOOSE if loose else CONTROL, "")


def squeeze(c: Column | str) -> Column:
    """Runs of three and more newlines to two, of two and more other spaces to one."""
    return F.regexp_replace(F.regexp_replace(col(c), "\\n{3,}", "\n\n"), SPACES, " ")


def drop_addresses(c: Column | str) -> Column:
    """Without images on the web, e-mail and web addresses; links [text](http...) stay whole."""
    no_images = F.regexp_replace(col(c), "!\\[[^\\n]*?\\]\\(https?://[^)]+\\)", "")
    return F.regexp_replace(no_images, "(\\[[^\\]]*\\]\\(https?://[^)]+\\))|" + EMAIL + "|https?://\\S+", "$1")


def drop_images(c: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(col(c), "!\\[[^\\]]*\\]\\([^)]*\\)", ""), "(?i)<img[^>]*>", "")


def drop_meta_tables(c: Column | str) -> Column:
    """Without groups of adjoining HTML tables that hold two words of sign-off sheets; groups of more than 20 rows stay."""
    groups = F.regexp_extract_all(col(c), F.lit("(?is)((?:<table[^>]*>.*?</table>\\s*)+)"), F.lit(1))
    meta = F.filter(groups, lambda g: (F.size(F.split(F.lower(g), "<tr")) - 1 <= 20) & (hits(g, META_TABLE_WORDS) >= 2))
    return F.aggregate(meta, col(c), lambda text, g: F.replace(text, g, F.lit("")))


def drop_headers_footers(c: Column | str, whole_words: bool = False) -> Column:
    """Without page numbers, dates, document numbers, marks of secrecy and the like. whole_words spares such letters inside words."""
    text = col(c)
    for p in HEADER_FOOTER:
        if whole_words and "NDA" in p:
            p = "(?iu)机密|保密|(?<![a-z])NDA(?![a-z])|(?<![a-z])CONFIDENTIAL(?![a-z])"
        text = F.regexp_replace(text, p, "")
    return squeeze(text)


def drop_toc(c: Column | str) -> Column:
    return strip(squeeze(F.regexp_replace(col(c), TOC_LINE, "")))


def clean(c: Column | str, images: bool = True, loose: bool = False) -> Column:
    """All cleaning steps in order; null and empty texts stay as they are."""
    text = drop_addresses(squeeze(drop_controls(unbar(c), loose)))
    text = drop_images(text) if images else text
    return F.when(col(c) == "", col(c)).otherwise(drop_toc(drop_headers_footers(drop_meta_tables(text))))


# --- quality ----------------------------------------------------------------


def effective_words(c: Column | str) -> Column:
    return F.regexp_count(col(c), F.lit("[\\u4e00-\\u9fff]|[a-zA-Z]{2,}|\\d+"))


def tag_ratio(c: Column | str) -> Column:
    plain = F.regexp_replace(col(c), "<[^>]+>", "")
    return (F.length(col(c)) - F.length(plain)) / F.greatest(F.length(col(c)), F.lit(1))


def is_low_quality(c: Column | str) -> Column:
    """Too few words, or mostly the remains of HTML tables."""
    text, words, part = col(c), effective_words(c), tag_ratio(c)
    plain = strip(F.regexp_replace(text, "<[^>]+>", ""))
    tables = ((part > 0.5) & (F.length(plain) < 20)) | text.rlike("(?i)</td>\\s*</tr>\\s*<tr>\\s*<td") | ((F.regexp_count(text, F.lit("(?i)</td>")) >= 3) & (words < 15)) | ((part > 0.15) & (words < 15))
    return F.when(text.isNull(), True).when(text.rlike("<[^>]+>"), tables).otherwise(words < 3)


def is_meta_header(c: Column | str) -> Column:
    return F.coalesce(any_word(c, META_HEADERS) | col(c).rlike(TOC_HEADER), F.lit(False))


def is_meta_table(c: Column | str) -> Column:
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(col(c), "<[^>]+>", ""), "(?U)\\s+", ""), "[|\\-:]", "")
    return F.lower(col(c)).rlike(META_TABLE) | (F.length(bare) < 5)


# --- normalising ------------------------------------------------------------

_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "\u3000"
_HALF = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + " "


def half_width(c: Column | str) -> Column:
    return F.translate(col(c), _WIDE, _HALF)


def compare_form(c: Column | str) -> Column:
    """Half-width, lower case, without white space."""
    return F.regexp_replace(F.lower(half_width(c)), "(?U)\\s+", "")


def space_scripts(c: Column | str) -> Column:
    """A space between ideographs and Latin letters or digits."""
    han, latin = "[\\u4e00-\\u9fa5]", "[A-Za-z0-9]"
    return F.regexp_replace(F.regexp_replace(col(c), f"({han})({latin})", "$1 $2"), f"({latin})({han})", "$1 $2")


def escape_query(c: Column | str) -> Column:
    return F.regexp_replace(col(c), "([+\\-&|!(){}\\[\\]^\"~*?:\\\\/])", "\\\\$1")


def slug(c: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(strip(c)), "(?U)[^\\w\\s-]", ""), "(?U)[-\\s]+", "-"), "^-+|-+$", "")


def safe_file_name(c: Column | str) -> Column:
    return F.translate(col(c), '/\\:*?"<>|', "_________")


def node_id(kind: Column | str, name: Column | str, hashed: bool = False) -> Column:
    """kind_ and the first eight letters of the name; hashed adds a digest so that names beginning alike stay apart."""
    base = F.concat(F.lower(col(kind)), F.lit("_"), F.substring(F.regexp_replace(col(name), "[^a-zA-Z0-9\\u4e00-\\u9fff]", ""), 1, 8))
    return F.concat(base, F.lit("_"), F.substring(F.md5(col(name)), 1, 6)) if hashed else base


def short_hash(c: Column | str) -> Column:
    return F.substring(F.sha2(col(c), 256), 1, 16)


def snippet(c: Column | str, n: int) -> Column:
    return F.when(F.length(col(c)) > n, F.concat(F.substring(col(c), 1, n), F.lit("..."))).otherwise(col(c))


def head_and_tail(c: Column | str, n: int, part: float = 0.8) -> Column:
    """A text above n characters as its beginning and its end."""
    head = int(n * part)
    return F.when(F.length(col(c)) > n, F.concat(F.substring(col(c), 1, head), F.lit("\n...\n"), F.substring(col(c), -(n - head), n - head))).otherwise(col(c))


def page_estimate(c: Column | str) -> Column:
    lines = F.split(col(c), "\n")
    rules = F.size(F.filter(lines, lambda x: strip(x).isin("---", "***", "___")))
    return F.when(rules > 0, rules + 1).otherwise(F.greatest(F.lit(1), F.floor(F.size(lines) / 50).cast("int")))


# --- file names -------------------------------------------------------------


def stem(c: Column | str) -> Column:
    return F.regexp_replace(F.regexp_extract(col(c), "([^/\\\\]*)$", 1), "(?<=.)\\.[^.]*$", "")


def file_format(c: Column | str) -> Column:
    suffix = F.lower(F.regexp_extract(col(c), "(\\.[^./\\\\]+)$", 1))
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in FORMATS.items() for x in kv]), suffix), F.lit("unknown"))


def base_name(c: Column | str) -> Column:
    """A file name's stem without version, date and state."""
    return strip(F.regexp_replace(functools.reduce(lambda s, p: F.regexp_replace(s, p, ""), VERSION_MARKS, stem(c)), "[-_ \u3000]+$", ""))


def is_versioned(c: Column | str) -> Column:
    return stem(c) != base_name(c)


def is_generic_name(c: Column | str) -> Column:
    name = strip(F.lower(col(c)))
    return (name == "") | name.isin(GENERIC_NAMES) | any_word(name, EVENT_WORDS)


def version_order(c: Column | str) -> Column:
    """What file names of one document sort by, oldest first: dated, numbered, unmarked, final."""
    number = F.regexp_extract(col(c), "[vV](\\d+(?:\\.\\d+)*)", 1)
    date = F.regexp_extract(col(c), "(20\\d{6})", 1)
    kind = F.when(any_word(c, FINAL_MARKS), 3).when(number != "", 1).when(date != "", 0).otherwise(2)
    parts = F.when(kind == 1, F.transform(F.split(number, "\\."), lambda x: x.cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.struct(kind.alias("kind"), parts.alias("number"), F.when(kind == 0, date).otherwise("").alias("date"), col(c).alias("name"))


def doc_type(c: Column | str) -> Column:
    out = None
    for name, words in DOC_TYPES.items():
        out = F.when(any_word(c, words), name) if out is None else out.when(any_word(c, words), name)
    return out.otherwise("其他")


def table_type(c: Column | str) -> Column:
    head = F.array_join(F.slice(F.split(strip(c), "\n"), 1, 3), "")
    out = None
    for name, words in TABLE_TYPES.items():
        out = F.when(hits(head, words) >= 2, name) if out is None else out.when(hits(head, words) >= 2, name)
    return out


def is_model_name(c: Column | str) -> Column:
    return col(c).rlike("(?i)^[A-Z]{1,3}\\d{1,4}[A-Z]?$")


# --- numbers and sets -------------------------------------------------------


def first_number(c: Column | str) -> Column:
    return F.regexp_extract(col(c), "([0-9.]+)", 1).try_cast("double")


def unit_number(c: Column | str, unit: str) -> Column:
    """The number before a unit, case aside; null without one."""
    return F.regexp_extract(col(c), f"(?i)([0-9]+(?:\\.[0-9]+)?)\\s*{unit}", 1).try_cast("double")


def characters(c: Column | str) -> Column:
    """The text's characters; indexing this is constant time, unlike substring."""
    return F.split(col(c), "")


def trigrams(c: Column | str, first: int | None = None) -> Column:
    text = F.substring(col(c), 1, first) if first else col(c)
    runs = F.zip_with(F.zip_with(characters(text), F.slice(characters(text), 2, 1_000_000_000), lambda a, b: F.concat(a, b)), F.slice(characters(text), 3, 1_000_000_000), lambda ab, d: F.concat(ab, d))
    return F.when(F.length(text) >= 3, F.array_distinct(F.filter(runs, lambda r: r.isNotNull()))).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column | str, b: Column | str) -> Column:
    union = F.size(F.array_union(col(a), col(b)))
    return F.when(union > 0, F.size(F.array_intersect(col(a), col(b))) / union).otherwise(0.0)


def tokens(c: Column | str) -> Column:
    """Words of letters and digits in lower case, each ideograph a token."""
    return F.regexp_extract_all(F.lower(half_width(c)), F.lit("([\\u4e00-\\u9fff]|[a-z0-9\\u00df-\\u00f6\\u00f8-\\u024f]+)"), F.lit(1))


def sentences(c: Column | str) -> Column:
    """Cut after marks of a sentence's end; empty ones are left out."""
    return F.filter(F.transform(F.split(col(c), "(?U)(?<=[。！？.!?])\\s+"), strip), lambda s: s != "")


# --- pages ------------------------------------------------------------------


def front_matter(c: Column | str) -> Column:
    return F.regexp_extract(col(c), "(?s)\\A\\s*---\\s*\\n(.*?)\\n---", 1)


def front_value(c: Column | str, key: str) -> Column:
    value = F.regexp_extract(front_matter(c), f"(?m)^{key}:[ \\t]*(.*)$", 1)
    return F.nullif(F.regexp_replace(strip(value), "^[\"']|[\"']$", ""), F.lit(""))


def front_list(c: Column | str, key: str) -> Column:
    inner = F.regexp_extract(front_matter(c), f"(?m)^{key}:[ \\t]*\\[(.*)\\]", 1)
    return F.filter(F.transform(F.split(inner, ","), lambda x: F.regexp_replace(strip(x), "^[\"']|[\"']$", "")), lambda x: x != "")


def page_body(c: Column | str) -> Column:
    return strip(F.regexp_replace(col(c), "(?s)\\A\\s*---\\s*\\n.*?\\n---\\s*", ""))


def wiki_links(c: Column | str) -> Column:
    return F.transform(F.regexp_extract_all(col(c), F.lit("\\[\\[([^\\]|]+)(?:\\|[^\\]]*)?\\]\\]"), F.lit(1)), strip)


def json_text(c: Column | str) -> Column:
    """The JSON object in a model's reply: the whole, a fenced block, or from the first brace to the last; a page of HTML is none."""
    text = strip(c)
    fenced = F.regexp_extract(text, "(?s)```(?:json)?\\s*(\\{.*?\\})\\s*```", 1)
    braces = F.regexp_extract(text, "(?s)(\\{.*\\})", 1)
    mend = lambda x: F.regexp_replace(F.regexp_replace(x, ",\\s*([}\\]])", "$1"), "'", '"')
    tries = [text, fenced, braces, mend(braces), F.concat(mend(F.regexp_extract(text, "(?s)(\\{.*)", 1)), F.lit("}"))]
    good = [F.when((t != "") & F.try_parse_json(t).isNotNull() & t.startswith("{"), t) for t in tries]
    return F.when(~F.lower(text).startswith("<!doctype") & ~F.lower(text).startswith("<html"), F.coalesce(*good))
