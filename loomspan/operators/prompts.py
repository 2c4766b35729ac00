"""Prompts: system text by method, sub-question conversations, backends and option checks."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

BASE = "You are a helpful assistant in solving physics problems."
INSTRUCTION = {"en": "Solve the question step by step and put each final answer in \\boxed{}.", "zh": "请逐步解答，并把最终答案写在 \\boxed{} 中。"}
PLAYBOOK = {"en": "Use the playbook below where it applies.", "zh": "请在适用时参考以下手册。"}
PLACEHOLDER = {"en": "(no answer was given)", "zh": "（未作答）"}
GUIDANCE = {"en": "Guidance", "zh": "提示"}


def by_language(values: dict[str, str], language: str) -> str:
    return values["zh" if language.lower() == "zh" else "en"]


def system_text(language: str = "en", playbook: str | None = None, skills: str | None = None, evolved: str | None = None) -> str:
    """The default line; a playbook is put after it, skills or an evolved prompt take its place. At most one of the three."""
    if sum(map(bool, (playbook, skills, evolved))) > 1:
        raise ValueError("playbook, skills and evolved prompt exclude each other")
    if skills or evolved:
        return (skills or evolved).strip()
    return f"{BASE}\n\n{by_language(PLAYBOOK, language)}\n\n## PLAYBOOK\n\n{playbook.strip()}\n\n## END PLAYBOOK" if playbook else BASE


def conversations(slots: DataFrame, language: str = "en", system: str = BASE, parent: str = "parent_index", attempt: str = "attempt_id") -> DataFrame:
    """Add messages: the questions so far with own answers between (thinking stripped, placeholder if empty), stem and instruction on the first only.

    Needs stem, problem, guidance (may be null), completion, slot_index.
    """
    guided = F.when(T.strip(F.coalesce("guidance", F.lit(""))) != "", F.concat(F.lit(f"\n\n[{by_language(GUIDANCE, language)}]\n"), T.strip("guidance"))).otherwise("")
    first = F.concat_ws("\n\n", F.lit(by_language(INSTRUCTION, language)), F.when(T.strip("stem") != "", F.col("stem")), F.col("problem"))
    asked = F.concat(F.when(F.col("slot_index") == 0, first).otherwise(F.col("problem")), guided)
    said = T.strip_think(F.coalesce("completion", F.lit("")), unclosed=True)
    said = F.when(said == "", by_language(PLACEHOLDER, language)).otherwise(said)
    turn = F.struct(asked.alias("q"), said.alias("a"))
    before = Window.partitionBy(parent, attempt).orderBy("slot_index").rowsBetween(Window.unboundedPreceding, -1)
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    history = F.flatten(F.transform(F.collect_list(turn).over(before), lambda t: F.array(message("user", t["q"]), message("assistant", t["a"]))))
    return slots.withColumn("messages", F.concat(F.array(message("system", F.lit(system))), history, F.array(message("user", asked))))


def earlier_statements(subs: DataFrame, parent: str = "parent_index", order: str = "slot_index", text: str = "problem") -> DataFrame:
    """Add context: the statements of a parent's earlier subs, in order."""
    w = Window.partitionBy(parent).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return subs.withColumn("context", F.collect_list(text).over(w))


def backend(name: str, model: str) -> str:
    """'auto' is local for a path (existing, or with a slash), else the API."""
    known = ("auto", "local", "api", "anthropic", "claude_code")
    if name not in known:
        raise ValueError(f"unknown backend {name!r}; one of {', '.join(known)}")
    return name if name != "auto" else "local" if "/" in model or os.path.exists(model) else "api"


def check_options(**options) -> None:
    """Method options exclude each other; limits select from a history and need one."""
    chosen = [k for k in ("playbook", "skills", "history", "guidance") if options.get(k)]
    if len([k for k in chosen if k != "guidance"]) > 1:
        raise ValueError(" and ".join(chosen) + " exclude each other")
    limits = [k for k in ("iteration", "rollouts") if options.get(k) is not None]
    if limits and not options.get("history"):
        raise ValueError(f"{limits[0]} needs a prompt history")
    if len(limits) > 1:
        raise ValueError("iteration and rollouts exclude each other")


def answer_types(kind: Column | str, sequence: Column | str) -> Column:
    """What a prompt says of the expected answer types."""
    names = {"NV": "a number", "EX": "an expression", "EQ": "an equation", "IN": "an interval", "MC": "a choice", "TF": "true or false", "QL": "a phrase"}
    listed = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    each = F.transform(F.filter(F.split(F.upper(F.coalesce(T.col(sequence), F.lit(""))), ","), lambda t: T.strip(t) != ""), lambda t: F.coalesce(F.try_element_at(listed, T.strip(t)), T.strip(t)))
    upper = F.upper(F.coalesce(T.col(kind), F.lit("")))
    return F.when(upper == "TUP", F.concat(F.lit("in this order: "), F.array_join(each, ", "))).when(upper == "ALT", F.concat(F.lit("any of: "), F.array_join(each, ", "))).otherwise(
        F.coalesce(F.try_element_at(listed, upper), F.lit("a short result"))
    )
