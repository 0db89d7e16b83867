"""Routing of requests by rules, and small state rules of the workflow."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What tells an intent.
RELATION = "关联|关系|联系|相关性|关联度|异同|共同点|相同点|相似之处|重叠|互补|主题分布"
COLLECTION = r"(这些|这批|这几个|这几份|各个|所有|全部|哪些|库里|库中|库内|知识库|文档库|上传)[^。？?!\n]{0,12}(文档|文件|资料|报告)|文档库|知识库|(文档|文件|资料|报告)之间"
LISTING = r"(有哪些|有什么|都有哪些|都有什么|多少个?|哪些|列出|列一下|清单|列表|包含哪些)[^。？?!\n]{0,4}(文档|文件|资料|pdf)|(文档|文件|资料|pdf)(列表|清单)|上传了(哪些|什么)(文档|文件|资料)?"
PRODUCE = "(?:生成|制作|导出|输出|撰写|写|整理|汇总|汇总成|做成|形成|创建|帮我写|帮我做|拟)"
PRODUCT = "(?:word|docx|WORD|文档|报告|说明书|纪要|会议纪要|方案|合同|简历|总结报告|分析报告)"
PRODUCTION = rf"{PRODUCE}[^。？?!\n]{{0,12}}{PRODUCT}|{PRODUCT}[^。？?!\n]{{0,6}}文件|(?:导出|下载)[^。？?!\n]{{0,8}}(?:word|docx|文档)"
SUMMARY, EVERY, LIBRARY = "总结|概括|概述|综述|概览|摘要|提炼|归纳|梳理", "所有|全部|整个|各个|每[一个份]|全[部库]|整[个库]", "全库|整库|库[里中内的]|知识库|文档库|资料库"
PAPER = "文档|文件|资料|报告|材料|附件|手册|纪要|方案|合同|简历"
NAMED_FILE = r"(?iU)[\w\x{4e00}-\x{9fa5}][\w\x{4e00}-\x{9fa5} \-_.·]{0,60}\.(?:pdf|docx?|xlsx?|pptx?|md|txt|csv)"
CHAT = (
    r"(?iU)^[\s,.，、!！?？~～]*(?:你好|您好|你们好|hi|hello|hey|嗨|哈喽|嗨喽|早上好|上午好|中午好|下午好|晚上好|晚安|在吗|在么|在不在|有人吗|再见|拜拜|bye|goodbye|"
    r"谢谢|多谢|感谢|thanks|thank you|辛苦了|你是谁|你叫什么名字?|你是什么(?:模型|ai|助手|机器人)?|介绍一下你自己?|自我介绍一下|你能做什么|你能干什么|你会什么|你有什么功能)[\s,.，、!！?？~～。]*$"
)
CHAT_MOST = 30
#: What tells that something is asked, small talk, and the lengths up to which a question and small talk are taken for it.
ASKING = (
    "(?i)怎[么样]|如何|咋(?:样|办)?|为什么|为啥|是什么|什么是|是啥|啥是|哪些|哪个|哪一种|哪种|多少|几个|原理|机制|流程|步骤|作用|区别|差异|优缺点|好处|坏处|影响|定义|含义|概念|架构|结构|功能|用途|适用|方法|策略|"
    "配置|参数|用法|报错|原因|条件|标准|规范|介绍|说明|解释|讲解|举例|对比|比较|能否|是否|可不可以|支持吗|可以吗|有没有|how|what|why|which|when|where|who|explain|describe|difference"
)
ASKING_END = r"(?U)吗[？?]?[\s。！!~～]*$"
SMALL_TALK = "天气|气温|几点|日期|星期几|礼拜几|节假日|冷笑话|笑话|讲个故事|唱歌|心情|吃(?:什么|啥|饭)|喝(?:什么|啥)|吃了(?:吗|没)|在干嘛|在干什么|聊聊天|无聊"
SMALL_TALK_MOST, QUESTION_MOST = 20, 200
#: Kinds of subtasks in their order, the marks of each, and other names a caller may give them.
TASKS = {
    "document": [r"文档", r"知识库", r"资料库", r"上传的", r"这几份", r"引用", r"合同", r"报表", r"\bdocument(?:s)?\b", r"\bknowledge base\b", r"\bcitation(?:s)?\b"],
    "research": [r"\bweb search\b", r"\bsearch the web\b", r"\bresearch\b", r"\blatest news\b", r"联网", r"上网", r"搜索", r"网页", r"最新(?:消息|新闻|进展|资料)", r"查一下.{0,12}(?:官网|新闻|资料)"],
    "code": [r"\bcode\b", r"\brepo(?:sitory)?\b", r"\bpull request\b", r"\brefactor\b", r"\bunit test\b", r"\bpytest\b", r"代码", r"仓库", r"修复.{0,12}(?:缺陷|bug|问题)", r"改.{0,8}代码", r"运行测试", r"提交.{0,8}(?:改动|补丁)"],
}
TASK_NAMES = {"document": "document", "rag": "document", "doc": "document", "knowledge": "document", "code": "code", "research": "research", "web": "research", "search": "research"}
_BLANK = " \t\n\r\x0b\x0c\x85\xa0\u2028\u2029\u3000"


def intent(query: Column) -> Column:
    """doc_relations, list_documents, document_agent, document_summary or general_chat where rules are sure, else null."""
    has = lambda p: query.rlike(p)
    bare = F.btrim(query, F.lit(_BLANK))
    whole = (has(PAPER) | has(LIBRARY)) & (has(EVERY) | has(LIBRARY))
    return (
        F.when(has(RELATION) & has(COLLECTION), "doc_relations").when(has(LISTING), "list_documents").when(has(PRODUCTION), "document_agent")
        .when(has(SUMMARY) & (has(NAMED_FILE) | whole), "document_summary").when((F.length(bare) <= CHAT_MOST) & has(CHAT), "general_chat")
    )


def seeks_knowledge(query: Column) -> Column:
    """Whether a query asks for knowledge: what sends small talk, as a model has it, to retrieval after all."""
    q = F.btrim(F.coalesce(query, F.lit("")), F.lit(_BLANK))
    talk = (F.length(q) <= SMALL_TALK_MOST) & q.rlike(SMALL_TALK)
    return F.length(q).between(1, QUESTION_MOST) & ~talk & (q.rlike(ASKING) | q.rlike(ASKING_END))


def plan(query: Column, kind: str = "auto") -> Column:
    """Subtasks (kind, objective, depends_on): those whose marks the request holds, document if none, or the one the caller names;
    code waits for all others. Null for a blank request."""
    chosen = (kind or "auto").strip().lower()
    if chosen != "auto" and chosen not in TASK_NAMES:
        raise ValueError(f"unknown kind of task {kind}")
    objective = F.btrim(F.regexp_replace(query, r"(?U)\s+", " "))
    if chosen != "auto":
        kinds = F.array(F.lit(TASK_NAMES[chosen]))
    else:
        holds = {k: F.lit(False) for k in TASKS}
        for k, marks in TASKS.items():
            for m in marks:
                holds[k] = holds[k] | objective.rlike(f"(?iU){m}")
        kinds = F.array_compact(F.array(*[F.when(h, F.lit(k)) for k, h in holds.items()]))
        kinds = F.when(F.size(kinds) == 0, F.array(F.lit("document"))).otherwise(kinds)
    waits = lambda k: F.when(k == "code", F.filter(kinds, lambda o: o != "code")).otherwise(F.array().cast("array<string>"))
    return F.when(objective != "", F.transform(kinds, lambda k: F.struct(k.alias("kind"), objective.alias("objective"), waits(k).alias("depends_on"))))


def aggregate_status(states: Column) -> Column:
    """completed if all are; else awaiting_approval, running or partial_failure, the first that is among them; partial_failure if
    some are completed; unavailable if all are; stopped if one is; else failed, for no states too."""
    has = lambda s: F.array_contains(states, s)
    all_are = lambda s: (F.size(states) > 0) & F.forall(states, lambda x: F.coalesce(x == s, F.lit(False)))
    return (
        F.when(all_are("completed"), "completed").when(has("awaiting_approval"), "awaiting_approval").when(has("running"), "running")
        .when(has("partial_failure") | has("completed"), "partial_failure").when(all_are("unavailable"), "unavailable").when(has("stopped"), "stopped").otherwise("failed")
    )


def skill(query: Column, skills: dict[str, list[str]]) -> Column:
    """The skill with most points, 2 * min(hits, 3) + 2 for one hit or more; none on a tie or without a hit."""
    low = F.lower(query)
    rows = F.array(*[F.struct(F.size(F.array_compact(F.array(*[F.when(F.contains(low, F.lit(w.lower())), 1) for w in words]))).alias("hits"), F.lit(name).alias("name")) for name, words in skills.items()])
    scored = F.filter(F.transform(rows, lambda r: F.struct((F.least(r["hits"], F.lit(3)) * 2 + 2).alias("points"), r["name"].alias("name"), r["hits"].alias("hits"))), lambda r: r["hits"] > 0)
    best = F.array_max(F.transform(scored, lambda r: r["points"]))
    top = F.filter(scored, lambda r: r["points"] == best)
    return F.when(F.size(top) == 1, F.get(top, F.lit(0))["name"])


def cross_language(query: Column, evidence: Column) -> Column:
    """A query with Han characters over evidence with more Latin letters than 80 and three times its Han characters."""
    han, latin = F.regexp_count(evidence, F.lit(r"[\x{4e00}-\x{9fff}]")), F.regexp_count(evidence, F.lit("[A-Za-z]"))
    return query.rlike(r"[\x{4e00}-\x{9fff}]") & (latin > F.greatest(F.lit(80), 3 * han))


#: Names that are ids as they stand, and the id of no name.
VALID_ID, DEFAULT_TENANT = r"^[A-Za-z0-9][A-Za-z0-9_.-]{0,63}$", "default"


def _named(name: Column, mark: str, none: Column) -> Column:
    plain = F.trim(F.coalesce(name, F.lit("")))
    return F.when(plain == "", none).when(plain.rlike(VALID_ID), plain).otherwise(F.concat(F.lit(mark), F.substring(F.sha1(plain), 1, 12)))


def tenant_id(name: Column) -> Column:
    """The trimmed name where it is a valid id, c and 12 digits of its SHA-1 where not, the default for none."""
    return _named(name, "c", F.lit(DEFAULT_TENANT))


def department_id(name: Column) -> Column:
    """As `tenant_id`, with d for c and null for none."""
    return _named(name, "d", F.lit(None).cast("string"))


#: Fixed value: a number of a table cell with its sign and unit.
CELL_NUMBER = r"[+-]?\p{Nd}+(?:[.,]\p{Nd}+)*(?:%|[A-Za-z]+)?"


def cell_numbers(text: Column) -> Column:
    """For each cell of a pipe table that holds a digit its numbers, in order, with signs and units."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"), lambda s: F.btrim(s, F.lit(_BLANK))), lambda s: s.startswith("|"))
    cells = F.flatten(F.transform(lines, lambda s: F.filter(F.split(s, r"\|"), lambda c: c.rlike(r"\p{Nd}"))))
    return F.transform(cells, lambda c: F.regexp_extract_all(c, F.lit(CELL_NUMBER), F.lit(0)))


def numeric_conflict(a: Column, b: Column) -> Column:
    """Whether two readings of a table differ in the numbers of their cells."""
    return cell_numbers(a) != cell_numbers(b)
