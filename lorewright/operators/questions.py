"""Question answering as columns: normalise, find entities, classify, route, query, verify, answer.

Every step is an expression or a join over a table of questions, so a batch of any size is
answered by one plan; each template is a join with the triples.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorewright.functions.text import cascade, holds
from lorewright.operators.models import ask
from lorewright.operators.sparql import SparqlError, select
from lorewright.operators.templates import NOT_GENERAL, RELATIONS
from lorewright.store import stored

# Ends of questions that are cut off.
TAILS = (
    "属于哪一派", "属于哪派", "属于哪个流派", "属于哪个派", "是什么人", "是哪位", "属于什么", "属于哪",
    "的弟子", "的徒弟", "的学生", "的门徒", "的师父", "的老师", "的师傅", "的老师傅",
    "有哪些弟子", "有哪些徒弟", "有哪些学生", "有哪些门徒", "有哪些人",
    "师从谁", "师从何人", "师谁", "受业于谁", "传自谁", "跟谁学", "从谁学", "跟谁", "从谁", "从何处",
    "有几个", "是多少", "有多少", "的字", "的号", "的生平", "的简介", "的籍贯", "的故乡", "的出生地",
    "是什么", "是谁", "是哪", "属于", "的人", "是什么关系", "什么关系", "是什么派别", "什么派别",
    "的最短关系路径", "的最短路径", "之间", "有哪些", "是哪个", "哪位", "哪些", "的吗", "的呢", "了吗", "吧", "啊", "呢",
)
# Beginnings of questions that are cut off.
HEADS = ("请问", "请告诉我", "你知道", "请帮我")
# Marks stripped from the end.
MARKS = "？?！!。.,，、；;：:"
# Words that are no names.
SKIP = (
    "什么", "哪个", "如何", "怎么", "为什么", "请问", "有人", "印人", "印派", "流派", "年代", "时期", "明代", "清代", "元代",
    "印学", "篆刻", "知识", "问题", "师承", "弟子", "师父", "老师", "学习", "研究", "开创", "著名", "多少", "哪些", "几个", "这里",
    "以上", "以下", "之间", "之前", "之后", "是谁", "是什么", "是哪", "怎样", "的人", "有哪些", "属于", "属于哪", "哪位", "哪一派",
    "徒弟", "学生", "门徒", "师傅", "老师傅", "朋友", "友人", "同门", "师兄", "师弟", "师姐", "师妹",
)
# Characters cut off a name's end and beginning, one each.
NAME_END, NAME_BEGIN = "的了是在和之有被所字师友吗呢啊呀哈呗人？?！!。.", "的了是在和之有被所字师友"
# Stands for a question that names two with 和 or 与 and asks for their 关系.
BOTH = ("和关系", "与关系")
# Intents by keyword; the first rule that fits counts. 学生 belongs to students.
INTENTS = (
    (("弟子", "徒弟", "门徒", "传人", "学徒", "学生"), "query_student"),
    (("师承", "师父", "老师", "师傅", "学自", "师从", "受业"), "query_relation"),
    (("学", "教", "传授"), "query_relation"),
    (("派", "流派", "属于", "开创", "创始人", "成员"), "query_school"),
    (("有哪些", "列举", "列出", "多少"), "query_list"),
    (("最短", "路径", "之间", "通过", "什么关系", "是何关系", "什么交情"), "query_path"),
    (BOTH, "query_path"),
    (("你觉得", "你认为", "好不好", "怎么样"), "opinion"),
    (("字", "号", "生年", "卒年", "生於", "籍贯", "籍貫", "朝代"), "query_attribute"),
    (("是谁",), "query_attribute"),
    (("帮我", "请", "能不能", "可以吗"), "general"),
)
# The template of an attribute question by keyword.
ATTRIBUTE_INTENTS = (
    (("字", "styleName"), "ask_style_name"),
    (("号", "hao"), "ask_hao"),
    (("生年", "生於", "出生"), "ask_birth"),
    (("卒年", "死", "去世"), "ask_death"),
    (("籍贯", "籍貫", "哪里人", "哪个地方"), "ask_native_place"),
    (("朝代", "哪个朝"), "ask_dynasty"),
    (("师父", "老师", "传授", "授业"), "ask_teacher"),
    (("弟子", "徒弟", "学生", "传承"), "ask_student"),
    (("朋友", "交往", "交游"), "ask_friend"),
    (("流派", "属于", "派"), "ask_school"),
    (("关系", "什么关系"), "ask_relation"),
    (("最短", "路径", "之间", "通过"), "ask_path"),
    (("开创", "创始人", "始创"), "ask_founder"),
    (("生平", "简介", "经历"), "ask_biography"),
    (("作品", "代表作"), "ask_masterpiece"),
)
# Labels of attributes and of result columns.
ATTRIBUTE_LABELS = {
    "styleName": "字", "hao": "号", "birthYear": "生年", "deathYear": "卒年", "nativePlace": "籍贯", "dynasty": "朝代", "occupation": "职业",
    "officialRank": "官职", "biography": "生平", "masterpiece": "代表作", "appellation": "字号",
}
RELATION_LABELS = {"teacherName": "师父", "studentName": "弟子", "friendName": "友人", "targetName": "关联人物", "schoolName": "流派"}
_PREDICATE = {"ask_style_name": "styleName", "ask_hao": "hao", "ask_birth": "birthYear", "ask_death": "deathYear", "ask_native_place": "nativePlace", "ask_dynasty": "dynasty", "ask_biography": "biography", "ask_masterpiece": "masterpiece"}


def _any(words: tuple[str, ...]) -> str:
    return "|".join(sorted((w.replace("?", r"\?").replace(".", r"\.") for w in words), key=lambda w: (-len(w), w)))


def stripped(question: Column) -> Column:
    """The question without end marks, up to five known tails, and one known head."""
    q = F.rtrim(question, F.lit(MARKS))
    for _ in range(5):
        q = F.regexp_replace(q, f"(?s)^(.+?)(?:{_any(TAILS)})$", "$1")
    return F.regexp_replace(q, f"^(?:{_any(HEADS)})", "")


# What a rewritten question may begin with, its length at most, and marks around it.
REWRITE_HEADS = ("改写:", "改写：", "答:", "答：", "输出:", "输出：")
REWRITE_CHARS, REWRITE_MARKS = 100, "\"'「」"
# Ends of school names that are cut off, in this order.
SCHOOL_ENDS = ("流派", "印派", "门", "派别")


def rewritten(question: Column, answer: Column) -> Column:
    """A model's rewriting of a question: without known beginnings, its first line, without marks around it.

    The question itself where the answer is null, empty or longer than REWRITE_CHARS.
    """
    a = F.trim(answer, F.lit(" \t\r\n"))
    for head in REWRITE_HEADS:
        a = F.regexp_replace(a, f"(?s)^{head}\\s*", "")
    a = F.trim(F.trim(F.regexp_extract(a, r"^([^\n]*)", 1), F.lit(" \t\r")), F.lit(REWRITE_MARKS))
    return F.when((a != "") & (F.length(a) <= REWRITE_CHARS), a).otherwise(question)


def normalized(rows: DataFrame, question: str, model: Callable[[list[str]], list[str | None]], prompt: str = "原句: \"{question}\"\n改写:") -> DataFrame:
    """*rows* with normalized_question. A distinct question is asked once; null ones stay null."""
    once = rows.where(F.col(question).isNotNull()).select(F.col(question).alias("__q")).distinct()
    asked = ask(once, F.replace(F.lit(prompt), F.lit("{question}"), F.col("__q")), model, "__a")
    answers_ = asked.select("__q", rewritten(F.col("__q"), F.col("__a")).alias("normalized_question"))
    return rows.join(answers_, F.col(question) == F.col("__q"), "left").drop("__q")


def school_names(entities: Column) -> Column:
    """Entities of a question about schools without the ends of SCHOOL_ENDS, one after the other; nothing becomes empty."""

    def cut(x: Column) -> Column:
        for end in SCHOOL_ENDS:
            x = F.when(F.endswith(x, F.lit(end)) & (F.length(x) > len(end)), F.substring(x, F.lit(1), F.length(x) - len(end))).otherwise(x)
        return x

    return F.transform(entities, cut)


def sparql_in(answer: Column) -> Column:
    """The query in a model's answer: from PREFIX, else SELECT, to the last brace; null without one."""
    t = F.trim(answer, F.lit(" \t\r\n"))
    begin = F.when(F.instr(t, F.lit("PREFIX")) > 0, F.instr(t, F.lit("PREFIX"))).otherwise(F.instr(t, F.lit("SELECT")))
    brace = F.instr(F.reverse(t), F.lit("}"))
    end = F.when(brace > 0, F.length(t) - brace + 1).otherwise(F.length(t))
    return F.when(begin > 0, F.trim(F.substring(t, begin, F.greatest(end - begin + 1, F.lit(0))), F.lit(" \t\r\n")))


def generated_query(triples: DataFrame, answer: str | None) -> tuple[DataFrame | None, str]:
    """(rows, error) of a model's answer: rows of the query in it, or null and what is wrong with it.

    Only what the SPARQL subset reads is run; nothing else of the answer is.
    """
    found = None if answer is None else triples.sparkSession.range(1).select(sparql_in(F.lit(answer)).alias("q")).first().q
    if not found:
        return None, "no query"
    try:
        return select(triples, found), ""
    except SparqlError as e:
        return None, str(e)


# How a failure is told to a model, and how long a passage it gets.
FAILURES = {"NO_RESULT": "查询执行成功，但图谱中未找到匹配数据", "NO_ENTITY": "未能从问题中识别人物实体"}
PASSAGE_CHARS = 300


def fallback_prompt(question: Column, person: Column, error: Column, detail: Column, passages: Column) -> Column:
    """The prompt for a question without an answer: the question, its person, what went wrong, and passages (array) found for it."""
    d = F.coalesce(detail, F.lit(""))
    told = _label(error, FAILURES)
    told = F.when(error == "SPARQL_SYNTAX_ERROR", F.concat(F.lit("SPARQL 查询语法错误："), d)).when(error == "SPARQL_EXEC_ERROR", F.concat(F.lit("查询执行错误："), d)).when(error.isin(*FAILURES), told)
    named = F.when(F.coalesce(person, F.lit("")) != "", F.concat(F.lit("已识别人物："), person))
    found = F.when(F.size(passages) > 0, F.concat(F.lit("【原文摘录】\n"), F.array_join(F.transform(passages, lambda x: F.substring(x, 1, PASSAGE_CHARS)), "\n")))
    return F.concat_ws("\n\n", F.concat(F.lit("用户问题："), question), named, F.concat(F.lit("情况说明："), told), found)


def with_fallback(rows: DataFrame, model: Callable[[list[str]], list[str | None]], corpus: str = "知识图谱") -> DataFrame:
    """rows(question, name, error_type, detail, passages, ...) with the model's answer, or the rule's message where it has none."""
    asked = ask(rows, fallback_prompt(*(F.col(c) for c in ("question", "name", "error_type", "detail", "passages"))), model)
    said = F.trim("answer", F.lit(" \t\r\n"))
    return asked.withColumn("answer", F.when(said != "", said).otherwise(fallback_message(F.col("error_type"), F.col("name"), F.col("detail"), corpus)))


def entity_spans(question: Column) -> Column:
    """The distinct runs of 2 to 4 CJK characters of a stripped question that can be names."""
    spaced = F.regexp_replace(question, "[和与及、，,]+", " ")
    found = F.filter(F.regexp_extract_all(spaced, F.lit("[一-龥]{2,4}"), F.lit(0)), lambda x: ~x.isin(*SKIP))
    cut = F.transform(found, lambda x: F.regexp_replace(F.regexp_replace(x, f"[{NAME_END}]$", ""), f"^[{NAME_BEGIN}]", ""))
    return F.array_distinct(F.filter(cut, lambda x: (F.length(x) >= 2) & ~x.isin(*SKIP)))


def intent(question: Column) -> Column:
    """The kind of a question; 'unknown' if no rule fits."""
    both = holds(question, ("和", "与")) & F.contains(question, F.lit("关系"))
    return cascade(question, [(both if words == BOTH else words, label) for words, label in INTENTS], "unknown")


def attribute_intent(question: Column) -> Column:
    return cascade(question, list(ATTRIBUTE_INTENTS), "general")


def template_of(question: Column, kind: Column, entities: Column, is_school: Column | None = None) -> Column:
    """The template that answers a question of a kind about its entities; null without an entity."""
    two = (F.size(entities) >= 2) & kind.isin("query_path", "query_relation", "query_list")
    school = F.lit("ask_school") if is_school is None else F.when(is_school, "ask_school_members").otherwise("ask_school")
    return (
        F.when(F.size(entities) == 0, None)
        .when(two, "two_person_relation")
        .when(kind == "query_attribute", attribute_intent(question))
        .when(kind == "query_relation", "ask_teacher")
        .when(kind == "query_student", "ask_student")
        .when(kind == "query_school", school)
        .when(kind.isin("query_path", "query_list"), "ask_relation")
        .otherwise("general")
    )


def route(kind: Column, entities: Column) -> Column:
    """'error' without an entity, 'fallback' for opinions and unknown kinds, else 'query'."""
    return F.when(kind.isin("opinion", "unknown"), "fallback").when(F.size(entities) == 0, "error").otherwise("query")


def results(asked: DataFrame, triples: DataFrame) -> DataFrame:
    """(qid, a, b, key_a, key_b): result rows of asked(qid, name, template); key_b null for one column.

    All templates are answered by one join: a question's person meets the statements that it stands
    in, as subject or (of relations) as object, and the template says which of them count.
    """
    p, outward, template = F.col("p"), F.col("outward"), F.col("template")
    names = triples.where("p in ('personName', 'schoolName')").select(F.col("s").alias("k"), p.alias("kind"), F.col("o").alias("label"))
    names = stored(names, "names")
    persons, schools = (names.where(F.col("kind") == kind).select("k", "label") for kind in ("personName", "schoolName"))
    q = asked.join(persons.toDF("person", "label"), F.col("name") == F.col("label")).select("qid", "template", "person")

    end = lambda person, other, out: F.struct(F.col(person).alias("person"), F.col(other).alias("k"), F.lit(out).alias("outward"))
    relation = p.isin(*RELATIONS)
    ends = F.array_compact(F.array(end("s", "o", True), F.when(relation, end("o", "s", False))))
    want = F.try_element_at(F.create_map(*(F.lit(x) for kv in _PREDICATE.items() for x in kv)), template)
    either = lambda out, back: p == F.when(outward, out).otherwise(back)
    attribute = want.isNotNull()
    counts = (
        F.when(attribute, outward & (p == want))
        .when(template == "general", outward & ~p.isin(*NOT_GENERAL))
        .when(template == "ask_school", outward & p.isin("belongsToSchool", "hasFounder"))
        .when(template == "ask_relation", relation)
        .when(template == "ask_teacher", either("hasTeacher", "hasStudent"))
        .when(template == "ask_student", either("hasStudent", "hasTeacher"))
    )
    hits = triples.select("p", F.explode(ends).alias("x")).select("p", "x.*").join(q, "person").where(counts)
    hits = stored(hits.select("qid", "template", "p", "k"), "hits")

    none, general = F.lit(None).cast("string"), template == "general"
    plain = hits.where(attribute | general).select(
        "qid", F.when(general, p).otherwise(F.col("k")).alias("a"), F.when(general, F.col("k")).alias("b"),
        F.when(general, "p").otherwise(p).alias("key_a"), F.when(general, "o").alias("key_b"),
    )
    school = hits.where(template == "ask_school").join(schools, "k").select("qid", F.col("label").alias("a"), none.alias("b"), F.lit("schoolName").alias("key_a"), none.alias("key_b")).distinct()
    related = template == "ask_relation"
    person = hits.where(template.isin("ask_relation", "ask_teacher", "ask_student")).join(persons, "k").select(
        "qid", F.when(related, p).otherwise(F.col("label")).alias("a"), F.when(related, F.col("label")).otherwise(p).alias("b"),
        F.when(related, "rel").when(template == "ask_teacher", "teacherName").otherwise("studentName").alias("key_a"),
        F.when(related, "targetName").otherwise("rel").alias("key_b"),
    )
    return plain.unionByName(school).unionByName(person)


def _label(key: Column, labels: dict[str, str]) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in labels.items() for x in kv)), key), key)


def verified(asked: DataFrame, rows: DataFrame) -> DataFrame:
    """asked with row_count, error_type (null, NO_ENTITY or NO_RESULT) and is_valid."""
    n = rows.groupBy("qid").agg(F.count("*").alias("row_count"))
    j = asked.join(n, "qid", "left").withColumn("row_count", F.coalesce("row_count", F.lit(0)))
    error = F.when(F.col("route") == "error", "NO_ENTITY").when((F.col("route") == "query") & (F.col("row_count") == 0), "NO_RESULT")
    return j.withColumn("error_type", error).withColumn("is_valid", F.col("row_count") > 0)


def fallback_message(error: Column, name: Column, detail: Column, corpus: str = "知识图谱") -> Column:
    """What to say where there is no answer, by the kind of error."""
    return (
        F.when(error == "NO_ENTITY", "抱歉，我在您的问题中没有识别到具体的人物姓名，请提供完整的人名。")
        .when(error == "SPARQL_SYNTAX_ERROR", F.concat(F.lit("很抱歉，查询过程中遇到了技术问题："), F.coalesce(detail, F.lit("")), F.lit("。建议您尝试简化问题。")))
        .when(error == "SPARQL_EXEC_ERROR", "很抱歉，查询遇到了问题，请稍后重试。")
        .when((error == "NO_RESULT") & (F.coalesce(name, F.lit("")) != ""), F.concat(F.lit(f"经过查询，{corpus}中暂未收录「"), name, F.lit("」的详细信息。")))
        .when(error == "NO_RESULT", f"很抱歉，{corpus}中未找到与您问题相关的信息。")
        .otherwise("很抱歉，我无法回答您的问题。")
    )


def answers(asked: DataFrame, triples: DataFrame, corpus: str = "知识图谱", most: int = 5) -> DataFrame:
    """(qid, answer, answer_source, row_count) for asked(qid, name, intent, template, route).

    Rows are in order of their values. Kinds without a form of their own show *most* rows.
    """
    asked = stored(asked, "asked")
    rows = results(asked.where("route = 'query'").select("qid", "name", "template"), triples)
    j = rows.join(asked.select("qid", "intent"), "qid")
    w = Window.partitionBy("qid").orderBy("a", F.col("b").asc_nulls_first())
    j = j.withColumn("n", F.row_number().over(w))
    one = F.concat(_label(F.col("key_a"), ATTRIBUTE_LABELS), F.lit("："), "a")
    attribute = F.when(F.col("key_a") == "p", F.concat(_label(F.col("a"), ATTRIBUTE_LABELS), F.lit("："), "b")).otherwise(one)
    relation = F.concat_ws("；", F.concat(_label(F.col("key_a"), RELATION_LABELS), F.lit("："), "a"), F.concat(_label(F.col("key_b"), RELATION_LABELS), F.lit("："), "b"))
    plain = F.concat_ws("；", F.concat("key_a", F.lit("："), "a"), F.concat("key_b", F.lit("："), "b"))
    line = (
        F.when(F.col("intent") == "query_attribute", attribute)
        .when(F.col("intent") == "query_relation", relation)
        .when(F.col("intent") == "query_school", F.col("a"))
        .when(F.col("n") <= most, plain)
    )
    j = j.withColumn("line", line)
    listed = F.transform(F.array_sort(F.collect_list(F.when(F.col("line").isNotNull(), F.struct("n", "line")))), lambda x: x["line"])
    text = j.groupBy("qid", "intent").agg(listed.alias("lines"), F.count("*").alias("row_count"))
    body = F.when(F.col("intent") == "query_school", F.concat(F.lit("包括："), F.array_join("lines", "、"))).otherwise(F.array_join("lines", "；"))
    text = text.select("qid", body.alias("body"), "row_count")
    out = asked.join(text, "qid", "left").withColumn("row_count", F.coalesce("row_count", F.lit(0)))
    found = F.concat(F.lit("关于「"), "name", F.lit("」："), "body", F.lit(f"\n（以上数据来源于{corpus}，共 "), F.col("row_count").cast("string"), F.lit(" 条记录）"))
    error = F.when(F.col("route") == "error", "NO_ENTITY").when((F.col("route") == "query") & (F.col("row_count") == 0), "NO_RESULT").otherwise("")
    answer = F.when((F.col("route") == "query") & (F.col("row_count") > 0), found).otherwise(fallback_message(error, F.col("name"), F.lit(""), corpus))
    source = F.when(F.col("row_count") > 0, "kg_query").otherwise("fallback")
    return out.select("qid", answer.alias("answer"), source.alias("answer_source"), "row_count")
