"""Model and service calls as mapInPandas clients: injectable, retried inside the task, errors kept as a column."""

from __future__ import annotations

import hashlib
import json
import re
import time
from collections import deque
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import answers
from ..functions import text as T
from ..storage import materialize


class Client(Protocol):
    def complete(self, messages: list[dict], **options) -> str: ...


class StubClient:
    """Deterministic offline replies: a function of the messages, or a digest of them."""

    def __init__(self, reply: Callable[[list[dict]], str] | None = None, failures: int = 0):
        self.reply, self.failures = reply, failures

    def complete(self, messages: list[dict], **options) -> str:
        if self.failures:
            self.failures -= 1
            raise ConnectionError("rate limit")
        if self.reply:
            return self.reply(messages)
        return "## Equivalence Judgement\n" + ("TRUE" if int(hashlib.sha1(json.dumps(messages).encode()).hexdigest(), 16) % 2 else "FALSE")


class SlidingWindow:
    """At most ``most`` calls in any ``seconds``; a job's budget is split over its tasks."""

    def __init__(self, most: int, seconds: float = 60.0, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.most, self.seconds, self.clock, self.sleep = max(1, most), seconds, clock, sleep
        self.at: deque[float] = deque()

    def acquire(self) -> None:
        while True:
            now = self.clock()
            while self.at and now - self.at[0] >= self.seconds:
                self.at.popleft()
            if len(self.at) < self.most:
                self.at.append(now)
                return
            self.sleep(self.seconds - (now - self.at[0]))


def is_rate_limit(error: BaseException | None) -> bool:
    """Through the chain of causes: HTTP 429, or a message that says so."""
    seen = set()
    while error is not None and id(error) not in seen:
        seen.add(id(error))
        if getattr(error, "status_code", None) == 429 or any(m in str(error).lower() for m in ("rate limit", "too many requests", "429")):
            return True
        error = error.__cause__ or error.__context__
    return False


def call(client: Client, messages: list[dict], retries: int = 3, rate_retries: int = 10, wait: float = 2.0, accept: Callable[[str], bool] = bool,
         sleep: Callable[[float], None] = time.sleep, **options) -> tuple[str, str | None]:
    """(reply, error): a reply that ``accept`` refuses counts as a failure; rate limits wait and do not use up tries."""
    error = "no reply"
    tries = limited = 0
    while tries < retries:
        try:
            reply = client.complete(messages, **options)
            if accept(reply):
                return reply, None
            error = "unusable reply"
        except Exception as e:
            error = f"{type(e).__name__}: {e}"
            if is_rate_limit(e) and limited < rate_retries:
                limited += 1
                sleep(wait)
                continue
        tries += 1
    return "", error


def adapt_options(options: dict, message: str) -> dict | None:
    """Options changed as a 400 reply asks: temperature or top_p dropped, the token limit renamed; None if it asks nothing known."""
    out, low = dict(options), message.lower()
    if "max_tokens" in out and "max_completion_tokens" in low:
        out["max_completion_tokens"] = out.pop("max_tokens")
    elif "max_completion_tokens" in out and "max_completion_tokens" in low:
        out["max_tokens"] = out.pop("max_completion_tokens")
    elif (name := next((n for n in ("temperature", "top_p") if n in low and n in out), None)) is not None:
        out.pop(name)
    else:
        return None
    return out


def complete(df: DataFrame, client: Callable[[], Client], messages: str = "messages", per_minute: int | None = None, tasks: int = 1, retries: int = 3, **options) -> DataFrame:
    """Add reply and error. ``client`` is made once a task.

    ``per_minute`` is the job's budget: rows are dealt to ``tasks`` tasks, at most one a call of the budget, and each has its share.
    """
    if per_minute:
        tasks = max(1, min(tasks, per_minute))
        df = df.repartition(tasks)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = client()
        limit = SlidingWindow(per_minute // tasks) if per_minute else None
        for pdf in frames:
            got = []
            for m in pdf[messages]:
                if limit:
                    limit.acquire()
                got.append(call(made, [dict(x) if isinstance(x, dict) else {"role": x["role"], "content": x["content"]} for x in m], retries, **options))
            yield pdf.assign(reply=[r for r, _ in got], error=[e for _, e in got])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInPandas(run, f"{schema}, reply string, error string")


JUDGE_PROMPT = "Decide whether two answers say the same.\nProblem:\n{{problem}}\nReference:\n{{gold}}\nAnswer:\n{{pred}}\nEnd with a line '## Equivalence Judgement' and TRUE or FALSE below it."


def judge_with_fallback(df: DataFrame, client: Callable[[], Client], prompt: str = JUDGE_PROMPT, precision: float = 1e-8) -> DataFrame:
    """Rule judge first; only rows it refuses are asked of the model. Needs problem, pred, gold, answer_type, type_sequence."""
    ruled = materialize(df.withColumn("rule", answers.judge_column("pred", "gold", "answer_type", "type_sequence", precision)), "ruled")  # judged once
    good = ruled.where("rule").select("*", F.lit(True).alias("correctness"), F.lit(None).cast("string").alias("model_judge_msg"))
    text = F.lit(prompt)
    for name in ("problem", "gold", "pred"):
        text = F.replace(text, F.lit("{{" + name + "}}"), F.coalesce(name, F.lit("")))
    asked = complete(ruled.where("NOT rule").withColumn("messages", F.array(F.struct(F.lit("user").alias("role"), text.alias("content")))), client)
    verdict = T.judge_verdict("reply")
    told = F.when(F.col("error").isNotNull(), F.concat(F.lit("[aux_judge error] "), "error")).otherwise(F.col("reply"))
    bad = asked.select(*ruled.columns, (F.col("error").isNull() & verdict["verdict"]).alias("correctness"), told.alias("model_judge_msg"))
    return good.unionByName(bad)


def leaks(guidance: str, answer: str | None) -> list[str]:
    """:func:`text.leak_reasons` of one text, in plain Python, for the gate inside a task."""
    form = lambda t: re.sub(r"[^a-z0-9.+\-=/^]", "", re.sub(r"\\(?:left|right|,|;|!|quad|cdot|times)", "", re.sub(r"\\(?:text|mathrm|operatorname)\s*\{([^{}]*)\}", r"\1", t.lower())))
    bodies = re.findall(T.BOX, answer or "") or [answer or ""]
    here = form(guidance)
    found = {
        "contains-final-answer-phrase": "final answer" in guidance.lower(),
        "contains-boxed": "\\boxed" in guidance,
        "contains-special-token": re.search(T.SPECIAL_TOKEN, guidance),
        "contains-normalized-gold": any(len(f) >= 8 and f in here for f in map(form, bodies)),
        "contains-missing-data-claim": re.search(T.MISSING_DATA, guidance),
    }
    return sorted(k for k, v in found.items() if v)


def gated_guidance(df: DataFrame, client: Callable[[], Client], review: Callable[[], Client], tries: int = 3, max_chars: int = 4000) -> DataFrame:
    """Generate, pass the rule gate and the reviewer, at most ``tries`` times; else the last text sanitised, passed if nothing leaks.

    Needs messages and answer; adds guidance, passed, tries.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        writer, reader = client(), review()
        for pdf in frames:
            out = []
            for messages, answer in zip(pdf["messages"], pdf["answer"]):
                said, text, done = [dict(m) for m in messages], "", False
                for n in range(1, tries + 1):
                    text, error = call(writer, said)
                    leak = not text or bool(leaks(text, answer))
                    if not error and not leak:
                        verdict, _ = call(reader, [{"role": "user", "content": f"{text}\n---\n{answer}"}])
                        if "PASS" in verdict.upper() and "FAIL" not in verdict.upper():
                            done = True
                            break
                    said = [*messages, {"role": "user", "content": "Try again; give no result away."}]
                out.append((text, done, n))
            yield pdf.assign(__text=[t for t, _, _ in out], __ok=[d for _, d, _ in out], tries=[n for *_, n in out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    made = df.mapInPandas(run, f"{schema}, __text string, __ok boolean, tries int")
    safe = T.sanitize_reference("__text", "answer", max_chars)
    made = made.withColumn("guidance", F.when(F.col("__ok"), T.guidance_section("__text")).otherwise(safe))
    return made.withColumn("passed", F.col("__ok") | ((F.col("guidance") != "") & (F.size(T.leak_reasons("guidance", "answer")) == 0))).drop("__text", "__ok")


class QuotaError(RuntimeError):
    pass


class AuthError(RuntimeError):
    pass


# Codes of the parse service that end a run.
QUOTA_CODES, AUTH_CODES = {"-60018", "-60019"}, {"A0202", "A0211"}


def check_response(code, message: str = "") -> None:
    if str(code) in QUOTA_CODES:
        raise QuotaError(message)
    if str(code) in AUTH_CODES:
        raise AuthError(message)
    if str(code) not in ("0", "None", ""):
        raise RuntimeError(f"{code}: {message}")


def batches(df: DataFrame, order: str, size: int = 20, most: int = 50) -> DataFrame:
    """Add batch: chunks of at most ``size`` (never over ``most``) files in order, within ranges of the key."""
    from pyspark.sql import Window

    size = min(size, most)
    ranged = df.repartitionByRange(order).withColumn("__p", F.spark_partition_id())
    w = Window.partitionBy("__p").orderBy(order)
    return ranged.withColumn("batch", F.concat_ws("-", "__p", F.floor((F.row_number().over(w) - 1) / size).cast("string"))).drop("__p")


class ParseService(Protocol):
    def submit(self, names: list[str]) -> str: ...

    def state(self, batch: str) -> dict[str, str]: ...

    def result(self, batch: str, name: str) -> str: ...


def parse_pdfs(files: DataFrame, service: Callable[[], ParseService], poll: float = 5.0, timeout: float = 3600.0, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """(path, state, text): each batch submitted once, polled to done, failed or timeout; quota and login errors end the job."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        made, names = service(), list(pdf["path"])
        ticket = made.submit(names)
        waited, states = 0.0, {}
        while waited <= timeout:
            states = made.state(ticket)
            if all(states.get(n) in ("done", "failed") for n in names):
                break
            sleep(poll)
            waited += poll
        return pd.DataFrame([(n, s, made.result(ticket, n) if s == "done" else None) for n in names for s in [states.get(n) if states.get(n) in ("done", "failed") else "timeout"]],
                            columns=["path", "state", "text"])

    return batches(files, "path").groupBy("batch").applyInPandas(run, "path string, state string, text string")
