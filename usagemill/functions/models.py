"""Who made a model, and which family it belongs to."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from usagemill.functions.tokens import UNKNOWN_SPELLINGS

# Creators by provider name (a name that maps to itself stands alone), and families by ordered patterns.
CREATORS = {
    "01.ai": "yi", "01ai": "yi", "ai2": "ai2", "ai21": "ai21", "ai360": "ai360", "allenai": "ai2", "anthropic": "anthropic", "baichuan": "baichuan",
    "baidu": "baidu", "chatglm": "chatglm", "claude": "anthropic", "cohere": "cohere", "databricks": "dbrx", "dbrx": "dbrx", "deepseek": "deepseek",
    "doubao": "doubao", "google": "google", "google-generative-ai": "google", "huggingface": "huggingface", "hunyuan": "hunyuan", "ibm": "ibm",
    "internlm": "internlm", "kimi": "kimi", "liquid": "liquid", "meta": "meta", "microsoft": "microsoft", "minimax": "minimax", "mistral": "mistral",
    "moonshot": "moonshot", "moonshotai": "moonshot", "nvidia": "nvidia", "openai": "openai", "openai-codex": "openai", "openai_codex": "openai",
    "perplexity": "perplexity", "rwkv": "rwkv", "sensenova": "sensenova", "skywork": "skywork", "snowflake": "snowflake", "stepfun": "stepfun",
    "tii": "tii", "wenxin": "wenxin", "x.ai": "xai", "xai": "xai", "xiaomimimo": "xiaomimimo", "yi": "yi", "z.ai": "zai", "z-ai": "zai", "zai": "zai",
    "zhipu": "zai", "zhipuai": "zai",
}
EDGE, END = r"(?:^|[/_.:-])", r"(?:$|[/_.:-]|\d)"
FAMILIES = [
    ("openai", "(?:gpt|codex)"), ("claude", "claude"), ("google", "(?:gemini|palm)"), ("gemma", "gemma"), ("deepseek", "deepseek"), ("chatglm", "chatglm"),
    ("zai", "(?:glm|codegeex)"), ("kimi", "kimi"), ("moonshot", "moonshot"), ("xai", "grok"), ("mistral", "(?:mistral|mixtral|codestral|ministral|pixtral)"),
    ("qwen", "(?:qwen|qwq|qvq)"), ("meta", "(?:llama|codellama)"), ("cohere", "(?:command[-_.:]?[ra]|aya)"), ("minimax", "(?:minimax|abab)"),
    ("baichuan", "baichuan"), ("yi", "yi"), ("hunyuan", "hunyuan"), ("doubao", "doubao"), ("internlm", "internlm"), ("microsoft", "phi"),
    ("wenxin", "(?:ernie|wenxin)"), ("nvidia", "nemotron"), ("stepfun", r"(?:stepfun|step[-_.:]?\d)"), ("ibm", "granite"), ("ai2", "olmo"),
    ("tii", "falcon"), ("rwkv", "rwkv"), ("dbrx", "dbrx"), ("huggingface", "smollm"), ("sensenova", "sensenova"), ("skywork", "skywork"),
    ("xiaomimimo", "mimo"), ("ai21", "jamba"), ("longcat", "longcat"), ("ai360", "(?:zhinao|360gpt)"), ("spark", "sparkdesk"),
    ("bedrock", "(?:amazon[-_.:]nova|nova[-_.:](?:pro|lite|micro|premier))"), ("perplexity", "sonar"), ("liquid", "lfm"), ("snowflake", "snowflake[-_.:]arctic"),
]
#: The last family's pattern ends differently.
LAST_FAMILY = ("openai", EDGE + r"o[134](?:$|[/_.:-])")


def creator(provider: Column) -> Column:
    """C17: the canonical creator of a provider; null if it isn't known."""
    table = F.create_map(*[F.lit(x) for pair in CREATORS.items() for x in pair])
    return F.try_element_at(table, F.lower(F.trim(provider)))


def family(provider: Column, model: Column) -> Column:
    """H7: the creator's sign, else the first family whose pattern occurs in the model's name, else generic."""
    name = F.lower(F.trim(model))
    out = F.when(name.isin(UNKNOWN_SPELLINGS), "generic")
    made_by = creator(provider)
    out = out.when(made_by.isNotNull(), F.when(made_by == "anthropic", "claude").otherwise(made_by))
    for sign, pattern in FAMILIES:
        out = out.when(name.rlike(EDGE + pattern + END), sign)
    return out.when(name.rlike(LAST_FAMILY[1]), LAST_FAMILY[0]).otherwise("generic")
