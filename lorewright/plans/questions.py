"""Queries of question answering: one generated question per supplier."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorewright.operators import questions as Q
from lorewright.plans.registry import query, table
from lorewright.sources.canonical import PRELUDE, triples

SUFFIXES = ("的字是什么", "的号是什么？", "的籍贯是什么", "的老师是谁", "的弟子有哪些", "属于哪个流派", "有哪些朋友", "是谁", "你觉得怎么样", "的故事")
_K = len(SUFFIXES)
_QUESTIONS = f"qs as (select s_suppkey as qid, s_name as name, s_name || list_extract({list(SUFFIXES)!r}, 1 + s_suppkey % {_K}) as question from supplier)"
_STRIPPED = ["", "", "", "", "", "", "有哪些朋友", "", "你觉得怎么样", "的故事"]


def asked(spark, sf_dir):
    """(qid, question, name, entities, intent, template, route); names are found by their pattern."""
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(k.alias("qid"), F.concat("s_name", F.element_at(F.array(*map(F.lit, SUFFIXES)), (1 + k % _K).cast("int"))).alias("question"))
    rows = rows.withColumn("entities", F.regexp_extract_all("question", F.lit(r"Supplier#\d+"), F.lit(0)))
    rows = rows.withColumns({"name": F.try_element_at("entities", F.lit(1)), "intent": Q.intent(F.col("question"))})
    return rows.withColumns({"template": Q.template_of(F.col("question"), F.col("intent"), F.col("entities")), "route": Q.route(F.col("intent"), F.col("entities"))})


@query(f"with {_QUESTIONS} select qid, name || list_extract({_STRIPPED!r}, 1 + qid % {_K}) as stripped from qs")
def question_strip(spark, sf_dir):
    return asked(spark, sf_dir).select("qid", Q.stripped(F.col("question")).alias("stripped"))


def _cascade(rules, default: str, column: str) -> str:
    legs = " ".join(f"when {' or '.join(f'''contains({column}, '{w}')''' for w in words)} then '{label}'" for words, label in rules)
    return f"case {legs} else '{default}' end"


_INTENT = _cascade(Q.INTENTS, "unknown", "question")
_ATTRIBUTE = _cascade(Q.ATTRIBUTE_INTENTS, "general", "question")
_ASKED = f"""{_QUESTIONS}, i as (select *, {_INTENT} as intent from qs), a as (select *, case intent when 'query_attribute' then {_ATTRIBUTE} when 'query_relation' then 'ask_teacher' when 'query_student' then 'ask_student'
  when 'query_school' then 'ask_school' when 'query_path' then 'ask_relation' when 'query_list' then 'ask_relation' else 'general' end as template, case when intent in ('opinion', 'unknown') then 'fallback' else 'query' end as route from i)"""


@query(f"with {_ASKED} select qid, intent, {_ATTRIBUTE} as attribute_intent from a")
def intent_classify(spark, sf_dir):
    return asked(spark, sf_dir).select("qid", "intent", Q.attribute_intent(F.col("question")).alias("attribute_intent"))


@query(f"with {_ASKED} select qid, template, route from a")
def question_route(spark, sf_dir):
    return asked(spark, sf_dir).select("qid", "template", "route")


# Questions of the language, with one or two names in each.
_ASKS = ("{A}和{B}是什么关系？", "请问{A}的老师是谁", "{A}的弟子有哪些", "{A}属于哪个流派？", "{A}的籍贯是什么", "{A}师从谁", "{A}与{B}", "你知道{A}是什么人")
_ENTITIES = ("{A},{B}", "{A}", "{A}", "{A}", "{A}", "{A}", "{A},{B}", "{A}")
_NAMES = ("何震", "文彭", "蘇宣", "程原", "丁敬", "江高", "陶碧")
_PAIR = f"list_extract({list(_NAMES)!r}, 1 + (k // {len(_ASKS)}) % 7) as a, list_extract({list(_NAMES)!r}, 1 + ((k // {len(_ASKS)}) % 7 + 1 + k % 6) % 7) as b"


def named_questions(spark, sf_dir):
    """(qid, question): one per customer."""
    name = lambda i: F.element_at(F.array(*map(F.lit, _NAMES)), (F.expr(i) + 1).cast("int"))
    n = len(_ASKS)
    text = F.element_at(F.array(*map(F.lit, _ASKS)), (F.col("k") % n + 1).cast("int"))
    text = F.replace(F.replace(text, F.lit("{A}"), name(f"(k div {n}) % 7")), F.lit("{B}"), name(f"((k div {n}) % 7 + 1 + k % 6) % 7"))
    return table(spark, sf_dir, "customer").withColumn("k", F.col("c_custkey")).select(F.col("k").alias("qid"), text.alias("question"))


@query(f"select k as qid, replace(replace(list_extract({list(_ENTITIES)!r}, 1 + k % {len(_ASKS)}), '{{A}}', a), '{{B}}', b) as entities from (select k, {_PAIR} from (select c_custkey as k from customer))")
def question_entities(spark, sf_dir):
    """Names found by their characters in questions of the language."""
    return named_questions(spark, sf_dir).select("qid", F.array_join(Q.entity_spans(Q.stripped(F.col("question"))), ",").alias("entities"))


# What a model may answer when asked to rewrite a question, and what is taken of it ({q}: the question itself).
_REWRITES = ("改写: {q}是谁", "答：「{q}」\n另一个", "{q}", "", "\n 输出：\"{q}的字是什么\" \n", None, "x" * 101, "改写：改写:{q}")
_TAKEN = ("{q}是谁", "{q}", "{q}", "{q}", "{q}的字是什么", "{q}", "{q}", "改写:{q}")


def _rewriter(prompts):
    """Stands for a model: the answer hangs on the number in the question."""
    import re

    out = []
    for p in prompts:
        q = re.search(r"Supplier#(\d+)", p)
        answer = _REWRITES[int(q[1]) % len(_REWRITES)]
        out.append(answer and answer.replace("{q}", q[0]))
    return out


@query(f"select s_suppkey as qid, replace(list_extract({list(_TAKEN)!r}, 1 + s_suppkey % {len(_TAKEN)}), '{{q}}', s_name) as normalized_question from supplier")
def question_normalize(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("qid"), F.col("s_name").alias("question"))
    return Q.normalized(rows, "question", _rewriter).select("qid", "normalized_question")


_ENDED = ("皖派流派", "浙派", "吴门", "莆田印派", "门", "流派", "新安派别", "漳海派流派", "甲门印派流派")
_CUT = ("皖派", "浙派", "吴", "莆田", "门", "流派", "新安", "漳海派", "甲")


@query(f"select s_suppkey as qid, list_extract({list(_CUT)!r}, 1 + s_suppkey % {len(_CUT)}) as school from supplier")
def school_suffix_cleanup(spark, sf_dir):
    name = F.element_at(F.array(*map(F.lit, _ENDED)), (1 + F.col("s_suppkey") % len(_ENDED)).cast("int"))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("qid"), Q.school_names(F.array(name))[0].alias("school"))


_GENERATED = ("好的：\nPREFIX ex: <http://x/>\nSELECT ?n WHERE { ?p ex:personName ?n }\n以上。", "SELECT ?a WHERE { ?a ?b ?c } .", "没有查询", "  SELECT ?a", "```SELECT ?a WHERE { { ?a ?b ?c } UNION { ?c ?b ?a } } ``` PREFIX", None)


def _sql(text):
    return "null" if text is None else "'" + text.replace("'", "''") + "'"


@query(
    f"""with g as (select s_suppkey as qid, trim(list_extract([{', '.join(map(_sql, _GENERATED))}], 1 + s_suppkey % {len(_GENERATED)}), ' ' || chr(10)) as t from supplier),
p as (select *, case when contains(t, 'PREFIX') then strpos(t, 'PREFIX') else strpos(t, 'SELECT') end as a, case when contains(t, '}}') then length(t) - strpos(reverse(t), '}}') + 1 else length(t) end as z from g)
select qid, case when a > 0 then trim(substr(t, a, greatest(z - a + 1, 0)), ' ' || chr(10)) end as query from p"""
)
def sparql_extract(spark, sf_dir):
    text = F.element_at(F.array(*map(F.lit, _GENERATED)), (1 + F.col("s_suppkey") % len(_GENERATED)).cast("int"))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("qid"), Q.sparql_in(text).alias("query"))


_MAP = " ".join(f"when '{k}' then '{v}'" for k, v in Q._PREDICATE.items())
_RESULTS = f"""{PRELUDE}, {_ASKED}, k as (select * from a where route = 'query'), rs as (
  select qid, intent, o as a, cast(null as varchar) as b, p as key_a, cast(null as varchar) as key_b from k join t on s = name and p = case template {_MAP} end
  union all select qid, intent, p, o, 'p', 'o' from k join t on s = name where template = 'general' and p not in ('personName', 'confidence', 'dataSource', 'extractionMethod', 'ctextId', 'cbdbId')
  union all select distinct qid, intent, n.o, null, 'schoolName', null from k join t on t.s = name and t.p in ('belongsToSchool', 'hasFounder') join t n on n.s = t.o and n.p = 'schoolName' where template = 'ask_school'
  union all select qid, intent, p, o, 'rel', 'targetName' from k join t on s = name where template = 'ask_relation' and p in ('hasTeacher', 'hasStudent', 'hasFriend', 'hasFather', 'hasSon', 'influencedBy', 'inheritedFrom')
  union all select qid, intent, p, s, 'rel', 'targetName' from k join t on o = name and o_kind = 'iri' where template = 'ask_relation' and p in ('hasTeacher', 'hasStudent', 'hasFriend', 'hasFather', 'hasSon', 'influencedBy', 'inheritedFrom')
  union all select qid, intent, o, p, 'teacherName', 'rel' from k join t on s = name and p = 'hasTeacher' where template = 'ask_teacher'
  union all select qid, intent, s, p, 'teacherName', 'rel' from k join t on o = name and p = 'hasStudent' where template = 'ask_teacher'
  union all select qid, intent, o, p, 'studentName', 'rel' from k join t on s = name and p = 'hasStudent' where template = 'ask_student'
  union all select qid, intent, s, p, 'studentName', 'rel' from k join t on o = name and p = 'hasTeacher' where template = 'ask_student')"""


@query(f"with {_RESULTS} select qid, a, b, key_a, key_b from rs")
def question_results(spark, sf_dir):
    q = asked(spark, sf_dir)
    return Q.results(q.where("route = 'query'").select("qid", "name", "template"), triples(spark, sf_dir))


@query(
    f"""with {_RESULTS}, c as (select qid, count(*) as n from rs group by qid)
select a.qid, coalesce(n, 0) as row_count, case when route = 'query' and n is null then 'NO_RESULT' end as error_type, n is not null as is_valid from a left join c on a.qid = c.qid"""
)
def verify_result(spark, sf_dir):
    q = asked(spark, sf_dir)
    rows = Q.results(q.where("route = 'query'").select("qid", "name", "template"), triples(spark, sf_dir))
    return Q.verified(q, rows).select("qid", "row_count", "error_type", "is_valid")


def _labels(labels: dict[str, str], column: str) -> str:
    return f"case {column} " + " ".join(f"when '{k}' then '{v}'" for k, v in labels.items()) + f" else {column} end"


@query(
    f"""with {_RESULTS}, o as (select *, row_number() over (partition by qid order by a, b nulls first) as n from rs),
l as (select qid, intent, n, case intent when 'query_attribute' then case when key_a = 'p' then {_labels(Q.ATTRIBUTE_LABELS, 'a')} || '：' || b else {_labels(Q.ATTRIBUTE_LABELS, 'key_a')} || '：' || a end
  when 'query_relation' then {_labels(Q.RELATION_LABELS, 'key_a')} || '：' || a || coalesce('；' || {_labels(Q.RELATION_LABELS, 'key_b')} || '：' || b, '') when 'query_school' then a
  else case when n <= 5 then key_a || '：' || a || coalesce('；' || key_b || '：' || b, '') end end as line from o),
g as (select qid, intent, count(*) as row_count, case when intent = 'query_school' then '包括：' || string_agg(line, '、' order by n) else string_agg(line, '；' order by n) end as body from l group by qid, intent)
select a.qid, case when route = 'fallback' then '很抱歉，我无法回答您的问题。' when row_count is null then '经过查询，知识图谱中暂未收录「' || name || '」的详细信息。'
  else '关于「' || name || '」：' || body || chr(10) || '（以上数据来源于知识图谱，共 ' || row_count || ' 条记录）' end as answer, case when row_count is null then 'fallback' else 'kg_query' end as answer_source, coalesce(row_count, 0) as row_count
from a left join g on a.qid = g.qid"""
)
def answer_format(spark, sf_dir):
    return Q.answers(asked(spark, sf_dir), triples(spark, sf_dir))


@query(
    f"""with {_RESULTS}, c as (select distinct qid from rs), d as (select doc_id, substr(text, 1, {Q.PASSAGE_CHARS}) as passage from documents where text is not null)
select a.qid, '用户问题：' || question || chr(10) || chr(10) || '已识别人物：' || name || case when route = 'query' then chr(10) || chr(10) || '情况说明：查询执行成功，但图谱中未找到匹配数据' else '' end
  || coalesce(chr(10) || chr(10) || '【原文摘录】' || chr(10) || passage, '') as prompt
from a left join c on a.qid = c.qid left join d on d.doc_id = a.qid where c.qid is null"""
)
def fallback_prompts(spark, sf_dir):
    """What a model is asked about questions without an answer, with the document of the question's number as its passage."""
    q = asked(spark, sf_dir)
    rows = Q.results(q.where("route = 'query'").select("qid", "name", "template"), triples(spark, sf_dir))
    open_ = Q.verified(q, rows).where("not is_valid")
    d = table(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").alias("d"), F.array("text").alias("passages"))
    open_ = open_.join(d, F.col("qid") == F.col("d"), "left").withColumn("passages", F.coalesce("passages", F.array().cast("array<string>")))
    return open_.select("qid", Q.fallback_prompt(F.col("question"), F.col("name"), F.col("error_type"), F.lit(None).cast("string"), F.col("passages")).alias("prompt"))


@query(f"with {_RESULTS}, c as (select distinct qid from rs) select a.qid, case when a.qid % 3 = 0 then 'm' || length(name) when route = 'query' then '经过查询，知识图谱中暂未收录「' || name || '」的详细信息。' else '很抱歉，我无法回答您的问题。' end as answer from a left join c on a.qid = c.qid where c.qid is null")
def fallback_answers(spark, sf_dir):
    """A model's answers to them, and the rule's message where it has none."""
    import re

    def model(prompts):
        names = [re.search(r"Supplier#(\d+)", p) for p in prompts]
        return [f" m{len(n[0])}\n" if int(n[1]) % 3 == 0 else "" for n in names]

    q = asked(spark, sf_dir)
    rows = Q.results(q.where("route = 'query'").select("qid", "name", "template"), triples(spark, sf_dir))
    none = F.lit(None).cast("string")
    open_ = Q.verified(q, rows).where("not is_valid").withColumns({"detail": none, "passages": F.array().cast("array<string>")})
    return Q.with_fallback(open_.withColumn("error_type", F.coalesce("error_type", F.lit(""))), model).select("qid", "answer")
