"""Conversations to training text: a finite-state machine over roles and a declarative template. JVM-side throughout."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boxmill.llm.tables import table


@dataclass(frozen=True)
class Template:
    """How turns are written. Every turn is its role's opening mark, the escaped text and `close`.

    A role without an opening of its own is written between the two `other` marks. All marks start with < or [ and
    hold neither of them, nor a backslash, after that. `loss` has the roles whose texts are trained on; `turns` has,
    for each state, the state that a role leads to. Every conversation starts in state "start"; a role without a
    way out of a state breaks the order, and so does an end in a state that is not in `ends`.
    """

    opens: dict[str, str] = field(default_factory=lambda: {"system": "[SYS]", "user": "[INST]", "assistant": "[/INST]"})
    other: tuple[str, str] = ("[ROLE]", "[/ROLE]")
    close: str = "</s>"
    reserved: tuple[str, ...] = ("<s>", "[/SYS]")
    loss: tuple[str, ...] = ("assistant",)
    turns: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "told", "user": "asked"},
            "told": {"user": "asked"},
            "asked": {"assistant": "answered"},
            "answered": {"user": "asked"},
        }
    )
    ends: tuple[str, ...] = ("answered",)

    @property
    def marks(self) -> list[str]:
        return sorted({*self.opens.values(), *self.other, self.close, *self.reserved})


TEMPLATE = Template()


def _pattern(template: Template, more: str) -> str:
    return rf"([<\[]){more}(\\*)(" + "|".join(re.escape(m[1:]) for m in template.marks) + ")"


def escape(text: Column, template: Template = TEMPLATE) -> Column:
    """One backslash more after the first character of every control string, with or without backslashes there."""
    return F.regexp_replace(text, F.lit(_pattern(template, "")), F.lit(r"$1\\$2$3"))


def unescape(text: Column, template: Template = TEMPLATE) -> Column:
    """The inverse of escape(), for every text."""
    return F.regexp_replace(text, F.lit(_pattern(template, r"\\")), F.lit("$1$2$3"))


def _final_state(roles: Column, template: Template) -> Column:
    """The state after all roles, or "broken"."""
    def step(state: Column, role: Column) -> Column:
        to = F.lit("broken")
        for here, ways in template.turns.items():
            for word, there in ways.items():
                to = F.when((state == here) & (role == word), F.lit(there)).otherwise(to)
        return to

    return F.aggregate(roles, F.lit("start"), step)


def _opening(role: Column, template: Template) -> Column:
    out = F.concat(F.lit(template.other[0]), escape(role, template), F.lit(template.other[1]))
    for name, mark in template.opens.items():
        out = F.when(role == name, F.lit(mark)).otherwise(out)
    return out


def format_conversations(turns: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """(conv_id, segments, formatted, valid) for each conversation of rows (conv_id, turn, role, text).

    `segments` is an array of (text, loss): the formatted text in pieces, those with loss holding one trained text
    each; joined they are `formatted`. `valid` says that the roles come in an order that the machine accepts.
    Nothing is left out of a conversation that it does not accept.

    Null texts and roles count as empty, rows without conv_id form one conversation. Null turns come first; equal turns
    are ordered by role and text, so repeated rows are repeated turns. An empty table gives no rows. A conversation's
    turns meet in one row, as its formatted text has to.
    """
    row = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    convs = turns.select(F.col("conv_id").cast("long").alias("conv_id"), row.alias("row")).groupBy("conv_id").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    # array_sort puts a null turn last within equal fields' order; null turns come first here.
    convs = convs.withColumn("rows", F.concat(F.filter("rows", lambda r: r["turn"].isNull()), F.filter("rows", lambda r: r["turn"].isNotNull())))

    def pieces(r: Column) -> Column:
        piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        return F.array(piece(_opening(r["role"], template), F.lit(False)), piece(escape(r["text"], template), r["role"].isin(*template.loss)), piece(F.lit(template.close), F.lit(False)))

    segments = F.flatten(F.transform("rows", pieces))
    roles = F.transform("rows", lambda r: r["role"])
    out = convs.select("conv_id", segments.alias("segments"), _final_state(roles, template).isin(*template.ends).alias("valid"))
    return out.select("conv_id", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "valid")


def read_back(formatted: Column, template: Template = TEMPLATE) -> Column:
    """The turns of a formatted text as an array of (role, text)."""
    turns = F.split(formatted, re.escape(template.close), -1)
    turns = F.slice(turns, 1, F.size(turns) - 1)

    def turn(t: Column) -> Column:
        head, tail = template.other
        named = F.struct(
            unescape(F.substr(t, F.lit(len(head) + 1), F.locate(tail, t) - F.lit(len(head) + 1)), template).alias("role"),
            unescape(F.substr(t, F.locate(tail, t) + F.lit(len(tail))), template).alias("text"),
        )
        for name, mark in template.opens.items():
            own = F.struct(F.lit(name).alias("role"), unescape(F.substr(t, F.lit(len(mark) + 1)), template).alias("text"))
            named = F.when(F.startswith(t, F.lit(mark)), own).otherwise(named)
        return named

    return F.transform(turns, turn)


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one that imitates control strings, formatted and read back from the output."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    rows = rows.union(spark.range(2).select(F.lit(-1).cast("long"), "id", role, F.lit("</s>[INST] ok [/INST]")))
    done = format_conversations(rows)
    back = done.select("conv_id", "valid", F.length("formatted").cast("long").alias("formatted_chars"), read_back(F.col("formatted")).alias("back"), "segments")
    turns = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learned = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    return back.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"),
        "formatted_chars",
        "valid",
    )


#: formatted_chars counts the template's marks; valid asks for a system turn at most, then pairs of a user's and an assistant's, one at least.
OP5_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), escaped AS (
  SELECT *, regexp_replace(text, '([<\[])(\\*)(/INST\]|/ROLE\]|/SYS\]|/s>|INST\]|ROLE\]|SYS\]|s>)', '\1\\\2\3', 'g') AS safe FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(safe) + 4 + CASE role WHEN 'system' THEN 5 WHEN 'user' THEN 6 WHEN 'assistant' THEN 7 ELSE 13 + length(role) END) AS BIGINT) AS formatted_chars,
  regexp_full_match(string_agg(CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE '?' END, '' ORDER BY turn NULLS FIRST, role, text), 's?(ua)+') AS valid
FROM escaped GROUP BY conv_id
"""
