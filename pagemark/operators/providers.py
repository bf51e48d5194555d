"""Replies of model providers, as a table of what calls gave: a retry and fallback automaton.

attempts: request columns, provider, try (from 1), endpoint, status (null: the call failed on the way), body. A call that fails, or gives a status of
400 or more, or a body that is not as the provider's should be, is tried once more; the endpoint RESPONSES gives way to CHAT from
400 on, within the same try. A refusal, or a body without text, is an answer without a reply and is not tried again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import cleaned_reply

# providers' names and endpoints.
OPENAI, GEMINI, ANTHROPIC = "openai", "gemini", "anthropic"
RESPONSES, CHAT = "responses", "chat/completions"
TRIES = 2
# States of the automaton: a try is open, gives way to the other endpoint, is over; all is said.
OPEN, FALLBACK, OVER, SAID = range(4)

_BODY = {
    RESPONSES: "try_element_at(transform(filter(flatten(transform(filter(try_variant_get({v}, '$.output', 'array<variant>'), x -> try_variant_get(x, '$.type', 'string') = 'message'), "
    "x -> coalesce(try_variant_get(x, '$.content', 'array<variant>'), array()))), c -> try_variant_get(c, '$.type', 'string') = 'output_text'), c -> try_variant_get(c, '$.text', 'string')), 1)",
    CHAT: "try_variant_get({v}, '$.choices[0].message.content', 'string')",
    GEMINI: "try_variant_get({v}, '$.candidates[0].content.parts[0].text', 'string')",
    ANTHROPIC: "try_element_at(transform(filter(try_variant_get({v}, '$.content', 'array<variant>'), c -> try_variant_get(c, '$.type', 'string') = 'text'), c -> try_variant_get(c, '$.text', 'string')), 1)",
}
#: Bodies without this are not as they should be.
_NEEDED = {RESPONSES: "is_variant_null(try_variant_get({v}, '$', 'variant')) = false", CHAT: "try_variant_get({v}, '$.choices[0].message', 'variant') IS NOT NULL", GEMINI: "try_variant_get({v}, '$.candidates[0].content.parts[0].text', 'variant') IS NOT NULL", ANTHROPIC: "is_variant_null(try_variant_get({v}, '$', 'variant')) = false"}


def _each(kinds: dict[str, str], kind: Column, body: str) -> Column:
    out = F.when(F.lit(False), F.expr(kinds[CHAT].format(v=body)))
    for name, sql in kinds.items():
        out = out.when(kind == name, F.expr(sql.format(v=body)))
    return out


def outcomes(attempts: DataFrame) -> DataFrame:
    """attempts with known (is the provider one that there is?), state (what the call leads to) and reply."""
    kind = F.when(F.col("provider") == OPENAI, F.when(F.col("endpoint") == CHAT, CHAT).otherwise(RESPONSES)).otherwise(F.col("provider"))
    rows = attempts.withColumns({"_kind": kind, "_body": F.expr("try_parse_json(body)")})
    fine = (F.col("status") < 400) & F.col("_body").isNotNull() & F.coalesce(_each(_NEEDED, F.col("_kind"), "_body"), F.lit(False))
    refused = (F.col("_kind") == ANTHROPIC) & F.expr("coalesce(try_variant_get(_body, '$.stop_reason', 'string') = 'refusal', false)")
    state = F.when(fine, SAID).when((F.col("_kind") == RESPONSES) & (F.col("status") >= 400), FALLBACK).otherwise(OVER)
    return rows.select(*attempts.columns, F.col("_kind").isin(*_BODY).alias("known"), state.alias("state"), F.when(fine & ~refused, cleaned_reply(_each(_BODY, F.col("_kind"), "_body"))).alias("reply"))


def replies(attempts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, reply (null: none), calls (how many were made) of each request, as the automaton goes through its attempts."""
    told = outcomes(attempts)
    step = F.struct(F.col("try").cast("int").alias("try"), (F.col("endpoint") == CHAT).cast("int").alias("second"), F.col("provider").alias("provider"), "known", "state", "reply")
    listed = told.where(F.col("try") <= TRIES).groupBy(*keys).agg(F.array_sort(F.collect_list(step)).alias("_steps"))
    start = F.struct(F.lit(OPEN).alias("state"), F.lit(0).alias("try"), F.lit(None).cast("string").alias("reply"), F.lit(0).alias("calls"))

    def go(now: Column, x: Column) -> Column:
        again = x["try"] != now["try"]
        # the second endpoint is asked where the first gave way in the same try, the first where a try begins
        asked = x["known"] & (now["state"] != SAID) & F.when((x["provider"] == OPENAI) & (x["second"] == 1), ~again & (now["state"] == FALLBACK)).otherwise(again)
        made = F.struct(x["state"].alias("state"), x["try"].alias("try"), x["reply"].alias("reply"), (now["calls"] + 1).alias("calls"))
        return F.when(asked, made).otherwise(now)

    end = F.aggregate("_steps", start, go)
    return listed.select(*keys, end["reply"].alias("reply"), end["calls"].alias("calls"))
