"""Verification of retrieved evidence: quotes, replies, demotion, priorities."""

from __future__ import annotations

import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.recovery import find_json
from ..functions.text import strip

QUOTE_FLOOR = 20
TYPES = ("concept", "law_or_equation", "technique", "assumption")
SOURCES = ("problem", "solution", "both")


def quote_form(text: str | None) -> str:
    """Compatibility form, lower case, without macros; letters and digits of ASCII only."""
    plain = unicodedata.normalize("NFKD", text or "").lower()
    return re.sub(r"[^0-9a-z]", "", re.sub(r"\\[a-zA-Z]+", "", plain))


def quote_in(quote: str | None, text: str | None, floor: int = QUOTE_FLOOR) -> bool:
    """Every part of the quote between ellipses has at least ``floor`` characters in normal form, and they are in the text."""
    hay = quote_form(text)
    parts = [quote_form(p) for p in re.split(r"\.\.\.+|…", quote or "")]
    parts = [p for p in parts if p] if len(parts) > 1 else parts
    return bool(hay) and bool(parts) and all(len(p) >= floor and p in hay for p in parts)


def quote_verified(quote: Column, text: Column) -> Column:
    @F.pandas_udf("boolean")
    def run(q: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([quote_in(*x) for x in zip(q, t)], dtype="bool")

    return run(quote, text)


def clamp_score(column: str) -> Column:
    """0..3; what is no integer is 0."""
    return F.greatest(F.lit(0), F.least(F.lit(3), F.coalesce(F.expr(f"try_cast({column} AS int)"), F.lit(0))))


def parsed_replies(replies: DataFrame, key: str = "kp_id", reply: str = "reply") -> DataFrame:
    """(key, index, position, score, quote, reason, error): the matches array of each reply; a reply without one gives an error row."""
    schema = "array<struct<index:string,score:string,quote:string,reason:string>>"

    @F.pandas_udf("string")
    def entries(texts: pd.Series) -> pd.Series:
        def one(t):
            found = find_json(t, "matches")
            got = json.loads(found)["matches"] if found else None
            if not isinstance(got, list):
                return None
            return json.dumps([{k: None if e.get(k) is None else str(e.get(k)) for k in ("index", "score", "quote", "reason")} for e in got if isinstance(e, dict)])

        return texts.map(one)

    read = replies.select(key, F.from_json(entries(reply), schema).alias("m"))
    each = read.select(key, F.col("m").isNull().alias("failed"), F.posexplode_outer("m").alias("position", "e"))
    return each.select(key, F.expr("try_cast(e.index AS int)").alias("index"), "position", F.col("e.score").alias("score"), F.col("e.quote").alias("quote"),
                       F.col("e.reason").alias("reason"), F.when(F.col("failed"), "unparseable reply").alias("error"))


def verified_matches(parsed: DataFrame, candidates: DataFrame, key: str = "kp_id") -> DataFrame:
    """Candidates (key, index, text, ...) with their scores: of repeated indexes the last counts, unknown ones go, and a
    score of 2 or more without a verified quote becomes 1."""
    last = parsed.where("index IS NOT NULL").groupBy(key, "index").agg(F.max_by(F.struct("score", "quote", "reason"), F.col("position")).alias("e"))
    joined = candidates.join(last, [key, "index"])
    scored = joined.withColumn("score_original", clamp_score("e.score")).withColumn("quote", F.col("e.quote")).withColumn("reason", F.col("e.reason"))
    scored = scored.withColumn("quote_verified", quote_verified(F.col("quote"), F.col("text")))
    demoted = (F.col("score_original") >= 2) & ~F.col("quote_verified")
    return scored.withColumn("score", F.when(demoted, 1).otherwise(F.col("score_original"))).withColumn("note", F.when(demoted, "quote not found; demoted")).drop("e")


def to_verify(entities: DataFrame) -> DataFrame:
    """Assumptions met once are not worth a call."""
    return entities.where(~((F.col("type") == "assumption") & (F.coalesce("n_sub_problems", F.lit(0)) <= 1)))


def knowledge_points(reply: str | None, most: int = 15) -> list[dict]:
    """The points of a reply in normal form, first of each (type, name), at most ``most``."""
    found = find_json(reply, "knowledge_points", last_fence=True)
    out, seen = [], set()
    for p in json.loads(found)["knowledge_points"] if found else ():
        if not isinstance(p, dict):
            continue
        kind, name, told = (str(p.get(k) or "").strip() for k in ("type", "name", "description"))
        if kind not in TYPES or not 1 <= len(name) <= 200 or not told or (kind, name.lower()) in seen:
            continue
        seen.add((kind, name.lower()))
        source = p.get("source") if p.get("source") in SOURCES else "solution"
        words = p.get("keywords") if isinstance(p.get("keywords"), list) else []
        out.append({"type": kind, "name": name, "description": told, "source": source, "keywords": [w.strip() for w in map(str, words) if 0 < len(w.strip()) <= 100]})
    return out[:most]


def knowledge_points_column(reply: Column | str) -> Column:
    @F.pandas_udf("string")
    def run(t: pd.Series) -> pd.Series:
        return t.map(lambda x: json.dumps(knowledge_points(x)))

    return F.from_json(run(reply), "array<struct<type:string,name:string,description:string,source:string,keywords:array<string>>>")


def labelled(points: Column | str) -> Column:
    """True if there are points and each is complete."""
    p = F.col(points) if isinstance(points, str) else points
    whole = F.forall(p, lambda x: x["type"].isin(*TYPES) & x["source"].isin(*SOURCES) & (strip(x["name"]) != "") & (strip(x["description"]) != ""))
    return F.coalesce((F.size(p) > 0) & whole, F.lit(False))
