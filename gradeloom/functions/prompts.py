"""Prompt and chat rendering as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that outputs must equal (fixed values).
ANSWER_INSTRUCTION = r"Put the final answer inside \boxed{}."
SYSTEM_PROMPT = (
    "You are a careful mathematical reasoning assistant. Before responding, reason in <think>...</think>. Use it to understand the task, "
    "identify relevant constraints, reason logically, verify key steps, and correct mistakes when found. Then respond clearly and follow the user's instructions."
)
HINT_FORMAT = "{question}\n\nHint: {hint}"
TOOLS_BEGIN = "# Tools\n\nYou may call one or more functions to assist with the user query.\n\nYou are provided with function signatures within <tools></tools> XML tags:\n<tools>"
TOOLS_END = '\n</tools>\n\nFor each function call, return a json object with function name and arguments within <tool_call></tool_call> XML tags:\n<tool_call>\n{"name": <function-name>, "arguments": <args-json-object>}\n</tool_call>'
HINT_COLUMNS = {"nohint": None, "concise": "concise_hint", "detailmethod": "detailed_method_hint", "detailscaffold": "detailed_scaffold_hint"}
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def formatted(template: str, **parts: Column) -> Column:
    """A format string as one concat; doubled braces are braces."""
    import string

    out = []
    for text, name, _, _ in string.Formatter().parse(template):
        if text:
            out.append(F.lit(text))
        if name is not None:
            out.append(parts[name])
    return F.concat(*out)


def prompt_text(question: Column, hint: Column | None = None, hint_format: str = HINT_FORMAT) -> Column:
    """The question after the answer instruction; a null or empty hint is no hint."""
    q = F.concat(F.lit(f"{ANSWER_INSTRUCTION} "), question)
    if hint is None:
        return q
    return F.when(F.coalesce(hint, F.lit("")) == "", q).otherwise(formatted(hint_format, question=q, hint=hint))


def hint_column(condition: str) -> str | None:
    if condition not in HINT_COLUMNS:
        raise ValueError(f"unknown hint condition {condition!r}; one of {', '.join(HINT_COLUMNS)}")
    return HINT_COLUMNS[condition]


def block(role: Column | str, content: Column) -> Column:
    role = F.lit(role) if isinstance(role, str) else role
    return F.concat(F.lit(OPEN), role, F.lit("\n"), content, F.lit(CLOSE))


def generation_prompt(thinking: bool | None = None) -> str:
    return f"{OPEN}assistant\n" + ("<think>\n\n</think>\n\n" if thinking is False else "")


def model_input(prompt: Column, system: str | None = SYSTEM_PROMPT, thinking: bool | None = None) -> Column:
    """System and user blocks with the generation prompt."""
    parts = [block("system", F.lit(system))] if system else []
    return F.concat(*parts, block("user", prompt), F.lit(generation_prompt(thinking)))


def with_thought(thought: Column, solution: Column) -> Column:
    return F.when(F.coalesce(thought, F.lit("")) != "", F.concat(F.lit("<think>\n"), thought, F.lit("\n</think>\n"), solution)).otherwise(solution)


def _strip(c: Column, left: bool = True, right: bool = True) -> Column:
    """Without line ends at its sides."""
    trim = F.btrim if left and right else F.ltrim if left else F.rtrim
    return trim(c, F.lit("\n"))


def split_reasoning(message: Column) -> tuple[Column, Column]:
    """(reasoning, content) of an assistant message: its own field, else what stands in think tags."""
    content = F.coalesce(message["content"], F.lit(""))
    head = _strip(F.substring_index(content, "</think>", 1), left=False)
    inside, tagged = _strip(F.substring_index(head, "<think>", -1), right=False), content.contains("</think>")
    own = message["reasoning_content"]
    reasoning = F.when(own.isNotNull(), own).when(tagged, inside).otherwise(F.lit(""))
    rest = F.when(own.isNull() & tagged, _strip(F.substring_index(content, "</think>", -1), right=False)).otherwise(content)
    return reasoning, rest


def _thought_block(reasoning: Column, content: Column) -> Column:
    return F.concat(F.lit("<think>\n"), _strip(reasoning), F.lit("\n</think>\n\n"), _strip(content, right=False))


def chat_concise(messages: Column, generate: bool = False, thinking: bool | None = None) -> Column:
    """The short template: system, user and assistant blocks, reasoning wherever there is some. Messages are structs of role, content, reasoning_content."""

    def one(m: Column) -> Column:
        reasoning, content = split_reasoning(m)
        reply = F.when(reasoning != "", _thought_block(reasoning, content)).otherwise(content)
        return F.when(m["role"].isin("system", "user"), block(m["role"], F.coalesce(m["content"], F.lit("")))).when(m["role"] == "assistant", block("assistant", reply)).otherwise(F.lit(""))

    return F.concat(F.array_join(F.transform(messages, one), ""), F.lit(generation_prompt(thinking) if generate else ""))


def chat_full(messages: Column, tools: list[str] | None = None, generate: bool = False, thinking: bool | None = None) -> Column:
    """The full template. Reasoning is kept only after the last true user query; runs of tool answers share a user block; ``tools``
    are JSON signatures. Messages are structs of role, content, reasoning_content and, optionally, tool_calls (array of struct name, arguments as JSON text)."""
    n = F.size(messages)
    real = lambda m: (m["role"] == "user") & m["content"].isNotNull() & ~(m["content"].startswith("<tool_response>") & m["content"].endswith("</tool_response>"))
    queries = F.filter(F.transform(messages, lambda m, i: F.when(real(m), i)), lambda i: i.isNotNull())
    last = F.coalesce(F.array_max(queries), n - 1)
    role_at = lambda i: F.try_element_at(messages, i + 1)["role"]
    text = lambda m: F.coalesce(m["content"], F.lit(""))

    def called(m: Column, content: Column) -> Column:
        calls = F.transform(m["tool_calls"], lambda t, i: F.concat(F.when((i > 0) | (content != ""), F.lit("\n")).otherwise(F.lit("")), F.lit('<tool_call>\n{"name": "'), t["name"], F.lit('", "arguments": '), t["arguments"], F.lit("}\n</tool_call>")))
        return F.coalesce(F.array_join(calls, ""), F.lit(""))

    def one(m: Column, i: Column, has_calls: bool) -> Column:
        reasoning, content = split_reasoning(m)
        shown = (i > last) & ((i == n - 1) | (reasoning != ""))
        body = F.when(shown, _thought_block(reasoning, content)).otherwise(content)
        if has_calls:
            body = F.concat(body, called(m, content))
        first, final = (i == 0) | (role_at(F.greatest(i - 1, F.lit(0))) != "tool"), (i == n - 1) | (F.coalesce(role_at(i + 1), F.lit("")) != "tool")
        answer = F.concat(F.when(first, F.lit(f"{OPEN}user")).otherwise(F.lit("")), F.lit("\n<tool_response>\n"), text(m), F.lit("\n</tool_response>"), F.when(final, F.lit(CLOSE)).otherwise(F.lit("")))
        plain = (m["role"] == "user") | ((m["role"] == "system") & (i > 0))
        return F.when(plain, block(m["role"], text(m))).when(m["role"] == "assistant", block("assistant", body)).when(m["role"] == "tool", answer).otherwise(F.lit(""))

    return _chat(messages, tools, generate, thinking, one, text)


def _chat(messages, tools, generate, thinking, one, text) -> Column:
    first = F.try_element_at(messages, F.lit(1))
    own = F.when(first["role"] == "system", text(first))
    if tools:
        intro = TOOLS_BEGIN + "".join(f"\n{t}" for t in tools) + TOOLS_END
        head = block("system", F.concat(F.coalesce(F.concat(own, F.lit("\n\n")), F.lit("")), F.lit(intro)))
    else:
        head = F.coalesce(block("system", own), F.lit(""))
    with_calls = lambda m, i: one(m, i, bool(tools))
    return F.concat(head, F.array_join(F.transform(messages, with_calls), ""), F.lit(generation_prompt(thinking) if generate else ""))


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"), F.lit(None).cast("string").alias("reasoning_content"))


def sft_messages(system: Column, instruction: Column, output: Column, default_system: str | None = None, include_assistant: bool = True) -> Column:
    """Messages of a training record; an empty system prompt falls back to the default, and none at all is left out."""
    s = F.coalesce(F.nullif(system, F.lit("")), F.lit(default_system or None).cast("string"))
    rest = [message("user", instruction), *([message("assistant", output)] if include_assistant else [])]
    return F.when(F.coalesce(s, F.lit("")) != "", F.array(message("system", s), *rest)).otherwise(F.array(*rest))


def chat_payload(system: Column, question: Column, others: Column, single: bool = False) -> Column:
    """System, question, and each other prompt as a user turn; ``others`` is an array, or (``single``) one text."""
    others = F.array_compact(F.array(others)) if single else others
    turns = F.transform(F.coalesce(others, F.array().cast("array<string>")), lambda t: message("user", t))
    return F.concat(F.array(message("system", system), message("user", question)), turns)


def preference(prompt: Column, chosen: Column, rejected: Column) -> tuple[Column, Column, Column]:
    """Rendered prompt, and what each reply adds to it."""
    base = chat_concise(F.array(message("user", prompt)))
    tail = lambda reply: F.substring(chat_concise(F.array(message("user", prompt), message("assistant", reply))), F.length(base) + 1, F.lit(1 << 30))
    return base, tail(chosen), tail(rejected)


def hint_request(question: Column, solution: Column) -> Column:
    """The row's part of a hint prompt; the instructions stay the same for all rows."""
    return formatted("Question:\n{question}\n\nSolution:\n{solution}\n\nReturn output as valid JSON only.", question=question, solution=solution)
