"""Evaluation runs: flatten, densify, resume, judge-resume, conversation prefixes, rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def subs_of(parents: DataFrame) -> Column:
    """sub_problems, or the legacy ``problems``, or none."""
    have = [c for c in ("sub_problems", "problems") if c in parents.columns]
    return F.coalesce(*(F.col(c) for c in have), F.array())


def slot_templates(parents: DataFrame, key: str = "parent_index") -> DataFrame:
    """One row per answer slot: a parent's subs, or one slot made from a parent without any."""
    solo = F.array(F.struct(F.col("source_problem_id").alias("problem_id"), "problem", "solution", "answer", "answer_type", "type_sequence"))
    subs = F.transform(subs_of(parents), lambda s: F.struct(*(s[c].alias(c) for c in ("problem_id", "problem", "solution", "answer", "answer_type", "type_sequence"))))
    chosen = F.when(F.size(subs) > 0, subs).otherwise(solo)
    return parents.select(key, (F.size(subs) > 0).alias("is_multi"), F.when(F.size(subs) > 0, F.col("problem")).otherwise("").alias("stem"),
                          F.posexplode(chosen).alias("slot_index", "s")).select(key, "is_multi", "stem", "slot_index", "s.*")


def missing_answers(parents: DataFrame, key: str = "parent_index") -> DataFrame:
    """Slots without an answer: what loading must reject."""
    return slot_templates(parents, key).where(F.coalesce(T.strip("answer"), F.lit("")) == "").select(key, "slot_index", "problem_id")


def key4(df: DataFrame, *columns: str) -> DataFrame:
    """Add text keys k_<column>, with null, 0 and false folded to the empty string."""
    return df.withColumns({f"k_{c}": T.falsy_to_empty(c) for c in columns})


def densify(parents: DataFrame, attempts: DataFrame, k: int, n_slots: str = "n_slots", parent: str = "parent_index") -> DataFrame:
    """Exactly attempts 0..k-1 of every parent: the last one of an id is reused if its slot count fits, others start empty."""
    w = Window.partitionBy(parent, "attempt_id").orderBy(F.desc("position"))
    last = attempts.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r", "position")
    grid = parents.select(parent, n_slots, F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("attempt_id"))
    joined = grid.join(last, [parent, "attempt_id"], "left")
    fits = F.size("completions") == F.col(n_slots)
    return joined.withColumn("completions", F.when(fits, F.col("completions"))).withColumn("reused", F.coalesce(fits, F.lit(False)))


def resume(slots: DataFrame, cached: DataFrame, keys: list[str], ordinals: list[str], value: str = "completion") -> DataFrame:
    """Fill empty slots from an earlier run: of a parent's repeats the first counts (ordinals[0]), of later levels the last."""
    usable = cached.where(F.coalesce(T.strip(value), F.lit("")) != "")
    first = Window.partitionBy(*keys).orderBy(ordinals[0], *(F.desc(o) for o in ordinals[1:]))
    one = usable.withColumn("__r", F.row_number().over(first)).where("__r = 1").select(*keys, F.col(value).alias("__old"))
    joined = slots.join(one, keys, "left")
    empty = F.coalesce(T.strip(value), F.lit("")) == ""
    return joined.withColumn("resumed", empty & F.col("__old").isNotNull()).withColumn(value, F.when(empty, F.col("__old")).otherwise(F.col(value))).drop("__old")


def reusable(correct: Column | str, message: Column | str) -> Column:
    return T.col(correct).isNotNull() & ~T.is_retryable(message)


def attempt_results(slots: DataFrame, parent: str = "parent", attempt: str = "attempt", correct: str = "correct") -> DataFrame:
    """attempt_correct: not empty and every slot correct (missing counts as wrong)."""
    ok = F.coalesce(F.col(correct), F.lit(False))
    return slots.groupBy(parent, attempt).agg(F.count("*").alias("n_slots"), F.min(ok.cast("int")).alias("attempt_correct"),
                                              F.sum(F.col(correct).isNull().cast("long")).alias("missing_correctness"))


def parent_results(slots: DataFrame, parent: str = "parent", **names) -> DataFrame:
    per = attempt_results(slots, parent, **names)
    return per.groupBy(parent).agg(F.count("*").alias("n_attempts"), F.sum("attempt_correct").alias("n_correct"), F.max("attempt_correct").alias("any_correct"))


def sub_results(slots: DataFrame, parent: str = "parent", slot: str = "slot", attempt: str = "attempt", correct: str = "correct") -> DataFrame:
    """By (parent, slot): any, first and number correct over the attempts."""
    ok = F.coalesce(F.col(correct), F.lit(False)).cast("int")
    return slots.groupBy(parent, slot).agg(F.count("*").alias("n_attempts"), F.max(ok).alias("any_correct"), F.min_by(ok, F.col(attempt)).alias("first_correct"), F.sum(ok).alias("n_correct"))


def rates_by(results: DataFrame, group: str, passed: str = "any_correct", unknown: str | None = None) -> DataFrame:
    """Pass rate of every group, null included (or named ``unknown``), best first."""
    key = F.coalesce(F.col(group), F.lit(unknown)) if unknown else F.col(group)
    out = results.groupBy(key.alias(group)).agg(F.count("*").alias("n"), F.sum(passed).alias("n_pass"))
    return out.withColumn("rate", T.ratio("n_pass", "n")).orderBy(F.desc("rate"), group)


def chat_prefix(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", placeholder: str = "(no answer)") -> DataFrame:
    """For each user turn, all messages before it and itself; assistant answers lose their thinking, empty ones get a placeholder."""
    said = F.when(F.col(role) == "assistant", T.strip_think(text, unclosed=True)).otherwise(F.col(text))
    said = F.when((F.col(role) == "assistant") & (T.strip(F.coalesce(said, F.lit(""))) == ""), placeholder).otherwise(said)
    w = Window.partitionBy(conv).orderBy(turn).rowsBetween(Window.unboundedPreceding, 0)
    message = F.struct(F.col(role).alias("role"), said.alias("content"))
    return turns.withColumn("messages", F.collect_list(message).over(w)).where(F.col(role) == "user").select(conv, turn, "messages")


def split_system(messages: Column | str) -> list[Column]:
    m = T.col(messages)
    return [F.array_join(F.transform(F.filter(m, lambda x: x["role"] == "system"), lambda x: x["content"]), "\n\n").alias("system"),
            F.filter(m, lambda x: x["role"] != "system").alias("rest")]


def flat_query(messages: Column | str) -> Column:
    """A conversation as one prompt; own answers are headed."""
    return F.array_join(F.transform(T.col(messages), lambda x: F.when(x["role"] == "assistant", F.concat(F.lit("[Your previous answer]\n"), x["content"])).otherwise(x["content"])), "\n\n")


def token_budget(max_tokens: Column, prompt_len: Column, cap: int | None = None) -> Column:
    room = F.greatest(F.lit(1), max_tokens - prompt_len)
    return F.least(room, F.lit(cap)) if cap else room


def as_of(history: DataFrame, at: DataFrame, key: str, order: str, limit: str) -> DataFrame:
    """The last history row of each key with ``order`` <= ``limit`` (all of it where limit is null)."""
    joined = at.join(history, key).where(F.col(limit).isNull() | (F.col(order) <= F.col(limit)))
    return joined.groupBy(key).agg(F.max_by(F.struct(*history.columns), F.col(order)).alias("r")).select("r.*")


def flatten_attempts(dump: DataFrame, key: str = "parent_index") -> DataFrame:
    """Nested parents (attempts[].completions[]) to one row per slot: key, attempt position and id, slot_index, completion fields."""
    attempts = dump.select(key, F.posexplode("attempts").alias("position", "a"))
    slots = attempts.select(key, "position", F.col("a.attempt_id").alias("attempt_id"), F.posexplode("a.completions").alias("slot_index", "c"))
    return slots.select(key, "position", "attempt_id", "slot_index", "c.*")


def nest_attempts(slots: DataFrame, fields: list[str], key: str = "parent_index") -> DataFrame:
    """The way back: attempts in the order of their ids, slots in theirs, an attempt correct if it has slots and all are."""
    per = slots.groupBy(key, "attempt_id").agg(
        F.array_sort(F.collect_list(F.struct("slot_index", F.struct(*fields).alias("c")))).alias("s"),
        F.min(F.coalesce("correctness", F.lit(False)).cast("int")).cast("boolean").alias("correctness"),
    )
    attempt = F.struct("attempt_id", "correctness", F.transform("s", lambda x: x["c"]).alias("completions"))
    return per.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("attempt_id", attempt.alias("a")))).alias("x")).select(key, F.transform("x", lambda x: x["a"]).alias("attempts"))


def write_back(parents: DataFrame, subs: DataFrame, fields: list[str], key: str = "parent_index", order: str = "slot_index") -> DataFrame:
    """Parents with their sub_problems replaced by rows of ``subs``, in order; parents without any keep what they had."""
    made = subs.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, F.struct(*fields).alias("s")))), lambda x: x["s"]).alias("__subs"))
    joined = parents.join(made, key, "left")
    own = lambda: F.transform("sub_problems", lambda x: F.struct(*(x[f].alias(f) for f in fields)))
    kept = F.coalesce("__subs", own()) if "sub_problems" in parents.columns else F.col("__subs")
    return joined.withColumn("sub_problems", kept).drop("__subs")


def slot_count_drift(slots: DataFrame, key: str = "parent_index") -> DataFrame:
    """Parents whose attempts differ in their number of slots."""
    per = slots.groupBy(key, "attempt_id").agg(F.count("*").alias("n"))
    return per.groupBy(key).agg(F.min("n").alias("least"), F.max("n").alias("most")).where("least <> most")


def overall(slots: DataFrame) -> DataFrame:
    """One row over all slots: parents, those with a right attempt and their rate, the rate of attempts, slots without a verdict."""
    per = attempt_results(slots)
    totals = per.agg(F.avg("attempt_correct").alias("attempt_rate"), F.sum("missing_correctness").alias("missing_correctness"))
    best = per.groupBy("parent").agg(F.max("attempt_correct").alias("any"))
    parents = best.agg(F.count("*").alias("n_parents"), F.sum("any").alias("n_any"), F.avg("any").alias("parent_rate"))
    return parents.crossJoin(totals)  # one row each
