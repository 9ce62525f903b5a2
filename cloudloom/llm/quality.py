"""Operator 1, quality rules at host level. Native: DataFrame functions only.

Each document gets counts and rule failures from its own row; failures are added up by host, the host's rate is
shrunk with a beta prior fitted to all hosts (method of moments), and the host's verdict is joined back.

Verdicts: `trusted` hosts keep what passes the base rules; `watch` hosts also lose documents that fail a soft
rule; `blocked` hosts lose all documents. A null text has no words and so fails the base rules; a null host is a
host of its own; repeated rows count as often as they occur; an empty table gives an empty result. Columns of the
input are kept apart in a struct, so names may clash.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, table

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_SYMBOL_PERCENT = 10
MAX_DUP_LINE_PERCENT = 30
#: Shrunk failure rates from which a host is watched, and blocked.
WATCH_RATE, BLOCK_RATE = 0.25, 0.6
#: Up to this many hosts (some tens of MB) the verdicts are broadcast; beyond, host and salt are joined.
BROADCAST_HOSTS = 200_000
SALTS = 64
_BLANKS = "\t\n\x0b\x0c\r"


def _let(value: Column, body) -> Column:
    """body(value) with value computed once: a lambda's variable is not expanded again for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """Runs of characters other than space and \\t..\\r, as an array."""
    spaced = F.trim(F.translate(F.coalesce(text, F.lit("")), _BLANKS, " " * len(_BLANKS)))
    return F.when(spaced == "", F.array().cast("array<string>")).otherwise(F.split(spaced, " +"))


def repeated_window_words(words: Column, size: int = 3) -> Column:
    """Words inside windows of `size` words that occur twice or more in the text.

    Windows are sorted by (hash, place); those with an equal neighbour repeat; the union of their ranges is summed
    over sorted places."""

    def window(w: Column, i: Column) -> Column:
        return F.xxhash64(*[F.get(w, i + k) for k in range(size)])

    def repeating(hashes: Column) -> Column:
        places = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return _let(
            places,
            lambda s: F.array_sort(
                F.transform(
                    F.filter(s, lambda x, j: F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False))),
                    lambda x: x["i"],
                )
            ),
        )

    def covered(p: Column) -> Column:
        gaps = F.transform(p, lambda x, j: F.least(F.lit(size), F.coalesce(F.get(p, j + 1) - x, F.lit(size))))
        return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

    def count(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(_let(repeating(hashes), covered))

    return F.when(F.size(words) < size + 1, F.lit(0)).otherwise(
        _let(words, lambda w: _let(F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: window(w, i)), count))
    )


def measures(text: Column) -> dict[str, Column]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) of a text."""
    text = F.coalesce(text, F.lit(""))

    def lines(a: Column) -> Column:
        return F.size(a) - F.size(F.array_distinct(a))

    worded = F.filter(F.split(text, "\n", -1), lambda x: F.translate(x, " " + _BLANKS, "") != "")
    both = _let(words_of(text), lambda w: F.struct(F.size(w).alias("n"), repeated_window_words(w).alias("r")))
    return {
        "_words": both,
        "word_chars": F.length(F.translate(text, " " + _BLANKS, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"),
        "n_dup_lines": _let(worded, lines).cast("long"),
        "_lines": (F.length(text) - F.length(F.translate(text, "\n", "")) + 1).cast("long"),
    }


def with_measures(docs: DataFrame, keep: list[Column], text: str = "text", host: str = "source") -> DataFrame:
    """The columns of keep, then host, the measures, base_failed and soft_failed."""
    m = measures(F.col(text))
    df = docs.select(*keep, F.col(host).cast("string").alias("_host"), *[c.alias(k) for k, c in m.items()])
    df = df.withColumns({"n_words": F.col("_words.n").cast("long"), "n_repeat_words": F.col("_words.r").cast("long")})
    return df.withColumns(
        {
            "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
            "soft_failed": (100 * F.col("n_symbols") > MAX_SYMBOL_PERCENT * F.col("word_chars")) | (100 * F.col("n_dup_lines") > MAX_DUP_LINE_PERCENT * F.col("_lines")),
        }
    ).drop("_words", "_lines")


def host_verdicts(measured: DataFrame) -> DataFrame:
    """_host, host_docs, host_failures, host_rate (shrunk), verdict: a row for each host."""
    failed = (F.col("base_failed") | F.col("soft_failed")).cast("long")
    hosts = staged(measured.groupBy("_host").agg(F.count(F.lit(1)).alias("host_docs"), F.sum(failed).alias("host_failures")), "hosts")
    rate = F.col("host_failures") / F.col("host_docs")
    m = hosts.agg(F.avg(rate).alias("m"), F.var_samp(rate).alias("v")).first()
    mean, var = m["m"] or 0.0, m["v"] or 0.0
    mean = min(max(mean, 1e-3), 1 - 1e-3)
    strength = min(max(mean * (1 - mean) / var - 1, 2.0), 1000.0) if var > 0 else 1000.0
    shrunk = (F.col("host_failures") + mean * strength) / (F.col("host_docs") + strength)
    verdict = F.when(F.col("host_rate") >= BLOCK_RATE, "blocked").when(F.col("host_rate") >= WATCH_RATE, "watch").otherwise("trusted")
    return hosts.withColumn("host_rate", shrunk).withColumn("verdict", verdict)


def judged(measured: DataFrame) -> DataFrame:
    """measured with host_rate, verdict and kept."""
    verdicts = host_verdicts(measured).select(F.col("_host").alias("_h"), "host_rate", "verdict")
    if verdicts.count() <= BROADCAST_HOSTS:
        joined = measured.join(F.broadcast(verdicts), F.col("_host").eqNullSafe(F.col("_h")))
    else:
        salted = verdicts.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        spread = measured.withColumn("_salt", F.pmod(F.xxhash64("n_words", "word_chars", "n_symbols"), F.lit(SALTS)).cast("int"))
        joined = spread.join(salted, F.col("_host").eqNullSafe(F.col("_h")) & (F.col("_salt") == F.col("_s"))).drop("_s", "_salt")
    kept = ~F.col("base_failed") & (F.col("verdict") != "blocked") & ~((F.col("verdict") == "watch") & F.col("soft_failed"))
    return joined.drop("_h").withColumn("kept", kept)


def quality_rules(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """A row for each document: doc_id, the measures, base_failed, kept, then soft_failed, host_rate and verdict."""
    measured = staged(with_measures(docs, [F.col("doc_id")], text, host), "measures")
    out = judged(measured)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "soft_failed", "host_rate", "verdict")


def keep_good(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The rows of docs that the rules keep, with their own columns. The whole row travels in a struct beside its measures."""
    measured = staged(with_measures(docs, [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")], text, host), "measured-docs")
    return judged(measured).filter("kept").select("_row.*")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """host_rate is rounded to six digits, the same in any engine."""
    out = quality_rules(table(spark, sf_dir, "documents"))
    return out.withColumn("host_rate", F.floor(F.col("host_rate") * 1e6 + 0.5) / 1e6)
