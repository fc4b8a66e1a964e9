"""Quality rules: a threshold table compiled into one projection.

Statistics are built from SQL functions. Windows of eight words are hashed by three rounds of
pairing (words into pairs, pairs into fours, fours into eights), sorted with their places, and the
stretches that repeated windows cover are added up, all inside the row: a text of any length costs
n log n and no shuffle. Windows are compared by 64-bit hashes; at 20,000 windows a text two
different ones meet with a chance of about 1e-11.

Null text counts as empty: all statistics 0, ``base_failed``. A null id passes through, repeated rows
are judged alike, and very long texts are read whole. Empty tables give no rows. Only the id and text
columns are looked at, so names of others do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, words

WINDOW = 8
SYMBOLS = "[#*$%&|<>]"
# Frequent function words of four languages.
STOP_WORDS = tuple(
    "a an and are as at be by for from has he in is it of on or that the this to was with "
    "auch auf das dem den der des die ein eine für ist mit nicht sich sie und von zu "
    "au avec ce dans de des du elle en est et il la le les ne pas pour que qui sur un une "
    "al como con de del el en es la las lo los no para por que se su un una y".split()
)

#: (rule, statistic, "min" or "max", threshold). A document is kept if it meets every row.
RULES: tuple[tuple[str, str, str, float], ...] = (
    ("too_short", "n_words", "min", 20),
    ("too_long", "n_words", "max", 1_000_000),
    ("words_too_short", "mean_word_chars", "min", 2.0),
    ("words_too_long", "mean_word_chars", "max", 16.0),
    ("symbols", "symbol_ratio", "max", 0.25),
    ("no_stop_words", "stop_word_ratio", "min", 0.01),
    ("repeated_lines", "dup_line_ratio", "max", 0.5),
    ("long_lines_only_dots", "ellipsis_line_ratio", "max", 0.5),
)


def base_columns(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Statistics of each text, all by SQL functions; arrays and hashes stay inside."""
    t = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    t = t.select("doc_id", "t", words(F.col("t")).alias("w"), F.filter(F.split("t", "\n"), lambda x: x.rlike(WORD)).alias("lines"))
    t = t.select("doc_id", "t", "lines", "w", F.size("w").cast("long").alias("n_words"), F.transform("w", lambda x: F.xxhash64(x)).alias("h"))
    for span in (1, 2, 4):
        n = F.greatest(F.size("h") - span, F.lit(0))
        t = t.withColumn("h", F.zip_with(F.slice("h", F.lit(1), n), F.slice("h", F.lit(1 + span), n), lambda a, b: F.xxhash64(a, b)))
    once = F.size(F.array_distinct("h")) == F.size("h")
    t = t.withColumn("s", F.when(once, None).otherwise(F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    again = F.filter("s", lambda e, j: (e["x"] == F.get(F.col("s"), j - 1)["x"]) | (e["x"] == F.get(F.col("s"), j + 1)["x"]))
    t = t.withColumn("at", F.sort_array(F.transform(again, lambda e: e["i"])))
    gaps = F.zip_with("at", F.slice("at", F.lit(2), F.greatest(F.size("at") - 1, F.lit(0))), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
    repeated = F.coalesce(F.aggregate(gaps, F.lit(0), lambda s, x: s + x), F.lit(0))
    return t.select(
        "doc_id",
        "n_words",
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated.cast("long").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.filter("w", lambda x: F.lower(x).isin(*dict.fromkeys(STOP_WORDS)))).cast("long").alias("n_stop_words"),
        F.size(F.filter("lines", lambda x: x.rlike("(\\.\\.\\.|…)\\s*$"))).cast("long").alias("n_ellipsis_lines"),
    )


def ratios() -> dict[str, Column]:
    def over(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)

    return {
        "mean_word_chars": over("word_chars", "n_words"),
        "symbol_ratio": over("n_symbols", "n_words"),
        "stop_word_ratio": over("n_stop_words", "n_words"),
        "dup_line_ratio": over("n_dup_lines", "n_lines"),
        "ellipsis_line_ratio": over("n_ellipsis_lines", "n_lines"),
    }


def compile_rules(rules: tuple[tuple[str, str, str, float], ...] = RULES) -> tuple[Column, Column]:
    """The verdict, and the names of the rules that a row breaks."""
    known = ratios()
    broken = [(name, (known[x] if x in known else F.col(x)) < limit if side == "min" else (known[x] if x in known else F.col(x)) > limit) for name, x, side, limit in rules]
    kept = F.lit(True)
    for _, b in broken:
        kept = kept & ~b
    return kept, F.array_compact(F.array(*[F.when(b, F.lit(name)) for name, b in broken])) if broken else F.array().cast("array<string>")


def apply_rules(docs: DataFrame, rules: tuple[tuple[str, str, str, float], ...] = RULES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Statistics, ``base_failed``, ``kept`` and ``broken`` (rules that fail) of every document."""
    base_failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    kept, broken = compile_rules(rules)
    return base_columns(docs, doc_id, text).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"), (~base_failed & kept).alias("kept"), broken.alias("broken")
    )
