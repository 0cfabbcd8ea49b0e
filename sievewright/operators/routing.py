"""Rule-based routing of queries: alias normalisation, intent, partitions, refusal reasons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The rules of the router, as regular expressions without case; names of own projects are a parameter.
RULES = {
    "out_of_scope": r"天气|股票价格|股价|彩票|菜谱|航班|体育比分|weather\s+forecast|stock\s+price|lottery|recipe|flight\s+status",
    "private_claim": r"(?:列出|给出|返回|原文|明文|是什么).{0,35}(?:API\s*token|密钥|秘密|secret|credential)|隐藏\s*system prompt|未公开.{0,30}(?:原文|实现细节|来源授权)",
    "future_claim": r"(?:未来|下一个正式版本|明年|获批|批准|承诺).{0,50}(?:日期|功能|模块|人数|预算|完成|承诺)",
    "dynamic_cost": r"(?:价格|成本|cost).{0,40}(?:精确|多少|是多少)|(?:精确|exact).{0,20}(?:价格|成本|cost)",
    "telemetry": r"(?:生产环境|生产客户|真实用户|并发真实用户|线上).{0,60}(?:SLA|P99|延迟|内存|故障|事故|活跃用户|数据丢失|赔付|根因)",
    "dynamic_external": r"(?:截至今天|过去\s*24\s*小时|远程\s*GitHub|PyPI|最新发布|镜像站).{0,60}(?:多少|最新|SHA256|延迟|issue|下载量)",
    "external_scope": r"(?:截至|当前线上|生产环境|未来|下一个正式版本|远程\s*GitHub|未公开).{0,40}(?:多少|日期|何时|哪些|是否|能否|是什么)|(?:精确成本|线上价格).{0,30}(?:多少|是多少|分别|精确)|(?:团队|维护者).{0,30}(?:批准|承诺|未公开|来源授权)|live\s+users?|release\s+date|production\s+SLA",
    "comparison": r"对比|比较|区别|差异|是否符合|是否一致|一致性|\bvs\.?\b|versus|compare|comparison|difference|differ|comply|alignment",
    "official_signal": r"官方(?:规范|文档|说明)?|根据.{0,12}(?:规范|协议|标准)|协议规定|标准要求|文档怎么说|according\s+to|official|specification|\bspec\b|protocol|standard|documentation",
    "official_topic": r"\bMCP\b|Model\s+Context\s+Protocol|LangChain|LangGraph|StateSnapshot|JSON\s+Schema|Draft\s+2020-12|Python\s+3\.12|asyncio(?:\.run)?|pathlib(?:\.Path)?|sqlite3|subprocess|Docker|PayGate|支付回调",
    "internal": r"当前|项目|仓库|源码|代码|现有实现|current|repository|repo|source\s+code|codebase|implemented?",
    "project": r"项目|仓库|源码|代码|现有实现|repository|repo|source\s+code|codebase|implemented?",
    "internal_topic": r"ReAct|QueryEngine|AgentState|ToolRegistry|StreamingToolExecutor|OrderService|InventoryLedger|PaymentWebhookHandler|reserve_stock|confirm_payment|calculate_discount|订单|库存|优惠券|支付回调|checkpoint|snapshot|context|memory|subagent|sandbox|permission|shell\.run|search\.rg|file\.(?:read|write|patch)|skill\.load|agent\.(?:run|status)|手写循环|工具调用|上下文|长期记忆|检查点|子\s*Agent|权限|沙箱",
    "strong_design": r"为什么|为何|设计|架构|权衡|取舍|原理|决策|核心阶段|职责|角色|边界|限制|缺口|本质|生命周期|方案|系统层|教学型|生产级|Runtime|故障手册|运行手册|runbook|转化率|失败率|活跃订单|业务指标|应称为|不能说|不等同|不只是|又缺少|威胁模型|安全模型|成功率|准确率|Recall@\d+|吞吐量|失败恢复时间|P(?:50|90|95|99)|峰值内存|并发|benchmark|认证|审计报告|独立安全审计|是否由.{0,20}驱动|工具集合|event\s+sourcing|why|rationale|design|architecture|trade[- ]?off|decision",
    "implementation": r"在哪里|哪个文件|哪一行|调用链|执行流程|如何实现|怎么实现|函数|方法|类|模块|测试|报错|如何|怎样|怎么|哪些|什么时机|共同|映射|传递|保存|恢复|执行|处理|调用|注册|序列化|写入|查询|改变|where|which\s+file|line|call\s+flow|execution\s+flow|function|method|class|module|test|debug|trace",
    "artifact": r"\b(?:microcompact|autocompact|cache_reference|clear_cache|execute_one|validate_input|recall_attachment)\b",
    "design_override": r"(?:为什么|为何).{0,40}(?:选择|采用|拆分|设计|使用|需要|经过)|架构决策|权衡|取舍|是否由.{0,20}驱动|权限集合|五级上下文|默认上下文预算|压缩阈值|哪些状态.{0,40}哪些运行时资源|有何不同|(?:成功率|准确率|Recall@\d+|吞吐量).{0,30}(?:多少|分别|精确)",
}
# This one with case.
IDENTIFIER = r"\b(?:[A-Za-z_][A-Za-z0-9_]*[._][A-Za-z0-9_.]+|[A-Z][a-z0-9]+(?:[A-Z][A-Za-z0-9]*)+|SQLite[A-Z][A-Za-z0-9]*)\b"
# A misspelt name, what it means, and the contexts in which it is put right.
ALIASES = {"langchian": "LangChain"}
ALIAS_CONTEXT = r"什么是|是什[么麼]|介绍|简介|概述|官方(?:文档|规范|说明)?|怎么(?:用|使用|配置)|如何(?:用|使用|配置)|what\s+is|overview|documentation|docs?|getting[-_ ]started"
# What each intent searches.
ROUTES = {
    "implementation": ("internal", "code,test"),
    "design": ("internal", "design,history"),
    "official": ("official", "official"),
    "comparison": ("internal,official", "code,test,design,history,official"),
    "out_of_scope": ("", ""),
}
REASONS = [
    ("private_claim", "unverifiable_private_information"),
    ("future_claim", "future_commitment_not_documented"),
    ("dynamic_cost", "underspecified_dynamic_cost"),
    ("telemetry", "missing_production_telemetry"),
    ("dynamic_external", "dynamic_external_state_not_indexed"),
]


def _has(text: Column, rule: str, projects: tuple[str, ...] = ()) -> Column:
    pattern = RULES[rule] + "".join(f"|{p}" for p in projects if rule in ("internal", "project"))
    return text.rlike(f"(?i)(?:{pattern})")


def normalised(query: Column) -> Column:
    """The query with known misspellings put right, in a context that asks for a definition and outside back-ticks."""
    out = query
    for wrong, right in ALIASES.items():
        fixed = F.regexp_replace(out, f"(?i)(?<![A-Za-z0-9_]){wrong}(?![A-Za-z0-9_])", right)
        out = F.when(query.rlike(f"(?i)(?:{ALIAS_CONTEXT})") & ~query.rlike(f"(?i)`[^`\r\n]*{wrong}[^`\r\n]*`"), fixed).otherwise(out)
    return out


def intent(query: Column, projects: tuple[str, ...] = ()) -> Column:
    """implementation, design, official, comparison or out_of_scope."""
    text = normalised(F.trim(F.coalesce(query, F.lit(""))))
    has = lambda rule: _has(text, rule, projects)
    hint = has("project") | has("internal_topic")
    signal, topic, inside = has("official_signal"), has("official_topic"), has("internal")
    official = signal | (topic & ~inside)
    internal = inside | (has("internal_topic") & ~official)
    outside = has("private_claim") | has("future_claim") | has("dynamic_cost") | has("dynamic_external") | ((has("telemetry") | has("external_scope")) & ~hint)
    return (
        F.when((text == "") | has("out_of_scope") | outside, "out_of_scope")
        .when(signal & ~topic & ~internal, "out_of_scope")
        .when(has("comparison") & internal & official, "comparison")
        .when(official & ~internal, "official")
        .when((text.rlike(IDENTIFIER) | has("artifact")) & ~has("design_override"), "implementation")
        .when(has("design_override") | has("strong_design"), "design")
        .when(signal & topic & internal, "comparison")
        .when(has("implementation") | internal, "implementation")
        .otherwise("design")
    )


def route(found_intent: Column) -> tuple[Column, Column, Column]:
    """(corpora, authorities, matched_rule) of an intent."""
    pick = lambda k: F.coalesce(*(F.when(found_intent == name, F.lit(r[k])) for name, r in ROUTES.items()))
    arrays = [F.filter(F.split(pick(k), ","), lambda x: x != "") for k in (0, 1)]
    return arrays[0], arrays[1], F.concat(found_intent, F.lit("_rule"))


def refusal_reason(query: Column) -> Column:
    """The reason for an out-of-scope route, first rule first."""
    out = F.lit("outside_configured_corpus")
    for rule, reason in reversed(REASONS):
        out = F.when(_has(query, rule), reason).otherwise(out)
    return out
