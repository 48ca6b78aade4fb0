"""Quality rules as a bitmask ledger, in native expressions only.

Every rule is evaluated once for each document. The ledger holds the measurements and
one bit for each rule that failed. A policy is a versioned set of rules; applying it is
one bitwise AND, so a new policy or an ablation never reads the texts again.

Defined results: a null text counts as empty (no words, so ``few_words`` fails). Rows are
never merged: repeated rows give repeated ledger rows. Null ids stay null.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lipika.columns import free_name, let, matches

WORD = r"[^\x20\x09-\x0D]+"
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_lower", "n_marks")

#: Rule -> the condition under which it fails, over the measurements. A rule's bit is its place here; new rules go last.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "repeated_lines": "n_lines >= 4 and 10 * n_dup_lines > 3 * n_lines",
    "word_length": "word_chars < 2 * n_words or word_chars > 20 * n_words",
    "shouting": "n_upper > 2 * n_lower and n_upper >= 50",
    "exclamation": "4 * n_marks > n_words and n_marks >= 10",
}

#: Versioned policies: a document is rejected if it fails any rule of the policy.
POLICIES: dict[str, tuple[str, ...]] = {
    "base-1": ("few_words", "repeated_windows"),
    "full-1": ("few_words", "repeated_windows", "symbols", "repeated_lines", "word_length"),
    "full-2": tuple(RULES),
}


def mask(rules: tuple[str, ...]) -> int:
    """The bits of some rules."""
    places = list(RULES)
    return sum(1 << places.index(r) for r in rules)


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def _repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window found at two places or more.

    Windows are compared by a 64-bit hash of their three words; within one document a
    false match is less likely than 1e-8 even at a million words.
    """
    windows = F.transform(
        F.sequence(F.lit(1), F.size(words) - 2),
        lambda i: F.xxhash64(F.element_at(words, i), F.element_at(words, i + 1), F.element_at(words, i + 2)),
    )

    def covered(hashes: Column) -> Column:
        ordered = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def positions(pairs: Column) -> Column:
            def at(k: Column) -> Column:
                return F.get(pairs, k)["h"]

            twice = F.transform(
                pairs,
                lambda p, k: F.when(F.coalesce(at(k - 1) == p["h"], F.lit(False)) | F.coalesce(at(k + 1) == p["h"], F.lit(False)), p["i"]),
            )
            return F.size(F.array_distinct(F.flatten(F.transform(F.array_compact(twice), lambda i: F.array(i, i + 1, i + 2)))))

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(ordered, positions))

    return F.when(F.size(words) < 4, F.lit(0)).otherwise(let(windows, covered))


def measurements(text: Column) -> Column:
    """Struct of :data:`MEASURES` (all long) for a text."""
    text = F.coalesce(text, F.lit(""))

    def of(t: Column) -> Column:
        lines = F.filter(F.split(t, "\n", -1), lambda x: F.length(_without(x, SPACE)) > 0)
        dense = _without(t, SPACE)
        n = F.length(t)

        def over(words: Column, body: Column) -> Column:
            fields = {
                "n_words": F.size(words),
                "word_chars": F.length(body),
                "n_symbols": n - F.length(_without(t, SYMBOLS)),
                "n_repeat_words": _repeat_words(words),
                "n_upper": F.length(body) - F.length(F.regexp_replace(body, r"\p{Lu}+", "")),
                "n_lower": F.length(body) - F.length(F.regexp_replace(body, r"\p{Ll}+", "")),
                "n_marks": n - F.length(_without(t, "!")),
            }
            return let(
                lines,
                lambda ls: F.struct(
                    *(v.cast("long").alias(k) for k, v in fields.items()),
                    F.size(ls).cast("long").alias("n_lines"),
                    (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
                ),
            )

        return let(matches(t, WORD), lambda words: let(dense, lambda body: over(words, body)))

    return let(text, of)


def ledger(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keys``, the measurements and ``failed`` (long: one bit for each failed rule).

    Only ``keys`` and the text are read, so other columns cannot clash with the ledger's.
    """
    measured = docs.select(*keys, measurements(docs[text]).alias("m"))
    rows = measured.select(*keys, *(F.col(f"m.{c}").alias(c) for c in MEASURES))
    bits = [F.when(F.expr(rule), F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, rule in enumerate(RULES.values())]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return rows.withColumn("failed", failed)


def passes(policy: str, failed: Column | str = "failed") -> Column:
    """Whether a ledger row passes a policy."""
    failed = F.col(failed) if isinstance(failed, str) else failed
    return failed.bitwiseAND(F.lit(mask(POLICIES[policy])).cast("long")) == 0


def apply_policy(rows: DataFrame, policy: str) -> DataFrame:
    """The ledger with ``policy`` and ``kept``."""
    return rows.withColumn("policy", F.lit(policy)).withColumn("kept", passes(policy))


def ablation(rows: DataFrame, policy: str) -> DataFrame:
    """One row for each rule of a policy: documents that fail it, that fail it alone, and that pass without it.

    The ledger is counted once by bit pattern (at most 2 ** rules rows, partial counts
    before the shuffle); everything else is bitwise arithmetic over those patterns.
    """
    used = mask(POLICIES[policy])
    patterns = rows.groupBy(F.col("failed").bitwiseAND(F.lit(used).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(mask((r,))).cast("long").alias("bit")) for r in POLICIES[policy]))
    each = patterns.select("bits", "n", F.explode(rules).alias("r")).select("bits", "n", "r.rule", "r.bit")
    fails = F.col("bits").bitwiseAND(F.col("bit")) != 0
    others = F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit"))) == 0
    return each.groupBy("rule").agg(
        F.sum(F.when(fails, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(fails & others, F.col("n")).otherwise(0)).alias("n_failed_alone"),
        F.sum(F.when(others, F.col("n")).otherwise(0)).alias("n_kept_without"),
    )


def passing(docs: DataFrame, policy: str = "full-2", text: str = "text") -> DataFrame:
    """The rows of the frame whose text passes a policy, with the frame's own columns."""
    name = free_name(docs, "measured")
    measured = docs.withColumn(name, measurements(docs[text]))
    failed = F.lit(0).cast("long")
    for k, rule in enumerate(RULES.values()):
        failed = failed.bitwiseOR(F.when(_over(name, rule), F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
    return measured.filter(passes(policy, failed)).drop(name)


def _over(struct: str, rule: str) -> Column:
    """A rule over the fields of a struct column."""
    return F.expr(re.sub(r"\b(" + "|".join(MEASURES) + r")\b", rf"`{struct}`.\1", rule))
