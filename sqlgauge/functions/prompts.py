"""Prompts, chat messages and the bodies of chat requests and responses."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

MESSAGES_TYPE = "array<struct<role:string,content:string>>"

# Fixed value: the pinned system turn, shared by training and evaluation.
SYSTEM_PROMPT = (
    "You are an expert data analyst who writes SQLite queries. "
    "Given a database schema and a natural-language question, respond with a "
    "single valid SQLite query that answers the question. "
    "Return only the SQL query: no explanation, no markdown code fences."
)


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def user_prompt(schema: Column, question: Column, evidence: Column | None = None) -> Column:
    """The user turn. A knowledge line appears when the evidence is not empty,
    judged before it is stripped."""
    knowledge = F.lit("")
    if evidence is not None:
        knowledge = F.when(
            evidence != "", F.concat(F.lit("Knowledge: "), strip(evidence), F.lit("\n\n"))
        ).otherwise(F.lit(""))
    return F.concat(
        F.lit("Database schema:\n"), strip(schema), F.lit("\n\n"),
        knowledge,
        F.lit("Question: "), strip(question), F.lit("\n\nSQL:"),
    )


def build_messages(schema: Column, question: Column, evidence: Column | None = None) -> Column:
    """System turn and user turn as an array of structs."""
    prompt = user_prompt(schema, question, evidence)
    return F.array(message("system", F.lit(SYSTEM_PROMPT)), message("user", prompt))


def messages_or_default(messages: Column, schema: Column, question: Column) -> Column:
    """Stored messages, rebuilt when they are missing or an empty list."""
    return F.when(F.size(messages) > 0, messages).otherwise(build_messages(schema, question))


def append_answer(messages: Column, answer: Column) -> Column:
    """The conversation with the answer as a closing assistant turn."""
    return F.array_append(messages, message("assistant", answer))


@dataclass(frozen=True)
class ChatTemplate:
    """How turns become one string: ``turn`` renders one, ``separator`` joins them,
    ``generation_prompt`` is added when the model is to speak next."""

    turn: Callable[[Column, Column], Column]
    separator: str
    generation_prompt: str

    def render(self, messages: Column, add_generation_prompt: bool) -> Column:
        body = F.array_join(
            F.transform(messages, lambda m: self.turn(m["role"], m["content"])), self.separator
        )
        return F.concat(body, F.lit(self.generation_prompt)) if add_generation_prompt else body


def request_body(model: Column, messages: Column, max_tokens: int) -> Column:
    """One greedy chat-completion request as JSON text."""
    return F.to_json(
        F.struct(
            model.alias("model"),
            messages.alias("messages"),
            F.lit(0.0).alias("temperature"),
            F.lit(max_tokens).alias("max_tokens"),
        )
    )


RESPONSE_TYPE = (
    "struct<choices:array<struct<message:struct<content:string>>>,"
    "usage:struct<completion_tokens:bigint,prompt_tokens:bigint>>"
)


def parse_response(body: Column) -> Column:
    """Completion and token counts of a chat response; absent counts are 0."""
    parsed = F.from_json(body, RESPONSE_TYPE)
    return F.struct(
        F.get(parsed["choices"], F.lit(0))["message"]["content"].alias("content"),
        F.coalesce(parsed["usage"]["completion_tokens"], F.lit(0)).alias("out_tokens"),
        F.coalesce(parsed["usage"]["prompt_tokens"], F.lit(0)).alias("prompt_tokens"),
    )
