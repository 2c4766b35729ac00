"""Quality rules by distribution divergence (native: DataFrame functions only).

A document's character-class and common-word histograms are compared with its
language's reference by Jensen-Shannon distance (base 2, so 0 to 1).

* Words are runs outside ``[\\x20\\x09-\\x0D]``; a null text has none.
* References are pooled counts over all documents of a language (the ``lang``
  column) that pass the base rules; integers, so every engine agrees on them.
* A distance may exceed its limit by ``length_slack`` over the root of the words: short
  histograms scatter that much by chance.
* Guards: a histogram of fewer than ``min_words`` words gives no verdict, nor does a
  language whose reference has fewer than ``min_reference_words`` words; the
  document is then kept. A null or unknown ``lang`` is a language like any other,
  with the words of all lists as its common words.
* Rows are judged one by one: repeated rows and ties get equal results, an empty
  table gives an empty result, and a null ``doc_id`` stays null.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD, Whole, materialize, pick

#: Frequent function words of each language.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "a", "in", "is", "that", "for", "it", "as", "with", "was", "on", "be", "by", "this", "are", "or", "from"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine", "als"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par", "au", "sur", "avec", "pas"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "una", "su", "para", "es", "al", "no"],
}
CLASSES = ["lower", "upper", "digit", "punct", "symbol", "other"]
SYMBOLS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class QualityRules:
    min_base_words: int = 50
    max_repeat_percent: int = 50
    min_words: int = 60
    min_reference_words: int = 1000
    max_class_distance: float = 0.2
    max_word_distance: float = 0.26
    length_slack: float = 0.8
    common_words: dict = field(default_factory=lambda: COMMON_WORDS)

    @property
    def all_words(self) -> list[str]:
        return sorted({w for ws in self.common_words.values() for w in ws})

    def lists(self) -> dict[str, list[str]]:
        return {**self.common_words, "": self.all_words}


def _left_out(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, ""))


def document_statistics(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """One row per row: doc_id, lang, the base counts, base_failed, and both histograms as arrays of long; a column ``__row`` of ``docs`` stays."""
    base = docs if docs.columns == ["doc_id", "lang", "text", "__row"] else pick(docs, "doc_id", "lang", "text").withColumn("__row", F.lit(None).cast("boolean"))
    base = base.withColumn("text", F.coalesce("text", F.lit("")))
    one = base.select(
        "doc_id", "lang", "__row",
        F.length("text").alias("__chars"),
        F.regexp_replace("text", f"[{SPACE}]+", "").alias("__tight"),
        F.expr(f"regexp_extract_all(text, r'{WORD}', 0)").alias("__words"),
        F.filter(F.split("text", "\n", -1), lambda line: line.rlike(f"[^{SPACE}]")).alias("__lines"),
    )
    words = F.col("__words")
    per_lang = None
    for lang, listed in rules.common_words.items():
        chosen = F.array(*map(F.lit, listed))
        per_lang = F.when(F.col("lang") == lang, chosen) if per_lang is None else per_lang.when(F.col("lang") == lang, chosen)
    everything = F.array(*map(F.lit, rules.all_words))
    two = one.select(
        "doc_id", "lang", "__row", "__tight", "__words",
        F.size(words).cast("long").alias("n_words"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.expr("""
            CASE WHEN size(__words) < 4 THEN cast(array() AS array<struct<h: bigint, i: int>>)
            ELSE sort_array(transform(sequence(0, size(__words) - 3),
                i -> named_struct('h', xxhash64(get(__words, i), get(__words, i + 1), get(__words, i + 2)), 'i', i))) END
        """).alias("__windows"),
        F.regexp_replace("__tight", r"[\p{L}]+", "").alias("__marks"),
        (per_lang.otherwise(everything) if per_lang is not None else everything).alias("__list"),
    )
    three = two.select(
        "doc_id", "lang", "__row", "n_words", "n_dup_lines", "__list",
        F.length("__tight").cast("long").alias("word_chars"),
        F.length("__marks").alias("__n_marks"),
        _left_out(F.col("__tight"), r"\P{Lu}+").alias("__upper"),
        _left_out(F.col("__tight"), r"\P{Ll}+").alias("__lower"),
        _left_out(F.col("__marks"), r"[^0-9]+").alias("__digit"),
        _left_out(F.col("__marks"), r"[^.,;:!?'()\"-]+").alias("__punct"),
        _left_out(F.col("__marks"), r"[^#*$%&|<>]+").alias("n_symbols"),
        F.expr("filter(transform(__words, w -> lower(regexp_replace(w, r'[.,;:!?]+$', ''))), w -> array_contains(__list, w))").alias("__common"),
        F.expr("""sort_array(transform(
            filter(__windows, (x, k) -> (k > 0 AND get(__windows, k - 1).h = x.h) OR coalesce(get(__windows, k + 1).h = x.h, false)),
            x -> x.i))""").alias("__starts"),
    )
    four = three.select(
        "doc_id", "lang", "__row", "n_words", "word_chars", F.col("n_symbols").cast("long").alias("n_symbols"), "n_dup_lines",
        F.expr("""aggregate(transform(__starts, (p, k) -> if(k = 0, 3, least(3, p - get(__starts, k - 1)))), 0L, (a, x) -> a + x)""").alias("n_repeat_words"),
        F.array(*(c.cast("long") for c in (
            F.col("__lower"), F.col("__upper"), F.col("__digit"), F.col("__punct"), F.col("n_symbols"),
            F.col("word_chars") - F.col("__lower") - F.col("__upper") - F.col("__digit") - F.col("__punct") - F.col("n_symbols"),
        ))).alias("__class_counts"),
        F.expr("""concat(transform(__list, c -> cast(size(filter(__common, w -> w = c)) AS bigint)),
                         array(n_words - size(__common)))""").alias("__word_counts"),
    )
    failed = (F.col("n_words") < rules.min_base_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    return four.withColumn("base_failed", failed)


def language_references(stats: DataFrame) -> DataFrame:
    """Pooled histograms by language over the rows of :func:`document_statistics` that pass the base rules."""

    # Conditions stay inside the sums: a filter would be pushed below, and copy, the array columns it reads.
    passed = lambda c: F.coalesce(F.sum(F.when(~F.col("base_failed"), c)), F.lit(0))

    def pooled(name: str, out: str, size: int) -> list[Column]:
        return [passed(F.get(name, F.lit(i))).alias(f"{out}{i}") for i in range(size)]

    n_words = 1 + max(len(ws) for ws in QualityRules().lists().values())
    return (
        stats.groupBy("lang")
        .agg(passed(F.col("n_words")).alias("__ref_words"), *pooled("__class_counts", "c", len(CLASSES)), *pooled("__word_counts", "w", n_words))
        .select(
            F.col("lang").alias("__ref_lang"), "__ref_words",
            F.array(*(F.col(f"c{i}") for i in range(len(CLASSES)))).alias("__ref_class"),
            F.array(*(F.col(f"w{i}") for i in range(n_words))).alias("__ref_word"),
        )
    )


def js_distance(a: str, b: str) -> Column:
    """Jensen-Shannon distance (base 2) of two count arrays; null if either sums to 0. ``b`` may be longer, with zeros."""
    return F.expr(f"""
        aggregate(array(struct(aggregate({a}, 0L, (s, x) -> s + x) AS na, aggregate({b}, 0L, (s, x) -> s + x) AS nb)), cast(NULL AS double), (z, t) ->
            CASE WHEN t.na > 0 AND t.nb > 0 THEN sqrt(greatest(0D, aggregate(
                zip_with({a}, {b}, (x, y) -> CASE
                    WHEN coalesce(x, 0L) = 0 THEN 0.5D * coalesce(y, 0L) / t.nb
                    WHEN coalesce(y, 0L) = 0 THEN 0.5D * x / t.na
                    ELSE 0.5D * (x / t.na) * log2(2D * (x / t.na) / (x / t.na + y / t.nb))
                       + 0.5D * (y / t.nb) * log2(2D * (y / t.nb) / (x / t.na + y / t.nb)) END),
                0D, (s, x) -> s + x))) END)
    """)


def judge(stats: DataFrame, references: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """Add class_distance, word_distance and kept. References hold one row per language; Spark chooses the join by their size."""
    joined = stats.join(references, F.col("lang").eqNullSafe(F.col("__ref_lang")), "left")
    measured = joined.withColumns({
        "class_distance": js_distance("__class_counts", "__ref_class"),
        "word_distance": js_distance("__word_counts", "__ref_word"),
    })
    guarded = (F.col("n_words") < rules.min_words) | (F.coalesce("__ref_words", F.lit(0)) < rules.min_reference_words)
    slack = rules.length_slack / F.sqrt(F.greatest("n_words", F.lit(1)))
    fits = (F.coalesce("class_distance", F.lit(0.0)) <= rules.max_class_distance + slack) & (F.coalesce("word_distance", F.lit(0.0)) <= rules.max_word_distance + slack)
    # least() of the two is their conjunction, as one predicate: halves of it are not pushed below the arrays either.
    return measured.withColumn("kept", F.least(~F.col("base_failed"), guarded | fits))


def quality_rules(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """Base counts and the verdict for every row of ``docs`` (doc_id, lang, text). The narrow statistics are written once, so texts are read once."""
    stats = materialize(document_statistics(docs, rules).drop("__row"), "quality-stats")
    return judge(stats, language_references(stats), rules).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance"
    )


def keep_good(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """The rows of ``docs``, all columns, that the rules keep; references come from all of ``docs``.

    Nulls, repeated rows and empty tables are as in :func:`quality_rules`; columns may have any
    names beside doc_id, lang and text. Statistics are made once and written beside their rows.
    """
    whole = Whole(docs, "doc_id", "lang", "text")
    rows = whole.frame.select(*(F.col(whole.at[n]).alias(n) for n in ("doc_id", "lang", "text")), F.struct("*").alias("__row"))
    stats = materialize(document_statistics(rows, rules), "quality-stats")
    return whole.back(judge(stats, materialize(language_references(stats), "language-references"), rules).where("kept").select("__row.*"))
