"""Error rates of recognised text against a reference, over grapheme clusters, code points and words; how much is made up; agreement of two systems.

All take normalised texts (:func:`lipika.functions.text.normalize` first, as a column of its own) and work row by row in native functions. Edit distances are those
of Spark over strings in which each distinct unit of the row is one character.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lipika.columns import free_name, let
from lipika.errors import require
from lipika.functions import text as T
from lipika.operators.dictionary import atom_of


def distance(a: Column, b: Column) -> Column:
    """Edit distance of two arrays of strings."""

    def over(x: Column) -> Column:
        coded = lambda units: F.array_join(F.transform(units, lambda u: atom_of(F.array_position(x["kinds"], u).cast("int"))), "")
        return F.levenshtein(coded(x["a"]), coded(x["b"]))

    return let(F.struct(a.alias("a"), b.alias("b"), F.array_distinct(F.concat(a, b)).alias("kinds")), over)


def _rate(a: Column, b: Column) -> Column:
    """Distance over the size of ``b``; null where ``b`` is empty."""
    return distance(a, b) / F.nullif(F.size(b), F.lit(0))


def gcer(hypothesis: Column, reference: Column) -> Column:
    """Grapheme cluster error rate: the headline figure."""
    return _rate(T.graphemes(hypothesis), T.graphemes(reference))


def cer(hypothesis: Column, reference: Column) -> Column:
    """Code point error rate: a secondary figure."""
    return F.levenshtein(hypothesis, reference) / F.nullif(F.length(reference), F.lit(0))


def wer(hypothesis: Column, reference: Column) -> Column:
    """Word error rate."""
    return _rate(T.words(hypothesis), T.words(reference))


def grams(units: Column, n: int = 4) -> Column:
    """Distinct runs of ``n`` units, joined by a character that no text holds."""

    def of(u: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(u) - n, F.lit(0)))
        runs = F.transform(starts, lambda k: F.concat_ws("\x01", *(F.get(u, k + i) for i in range(n))))  # slice() would copy the array for each
        return F.when(F.size(u) >= n, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))

    return let(units, of)  # else the text is cut anew for each run


def made_up(hypothesis: Column, reference: Column, n: int = 4) -> Column:
    """Share of the distinct ``n``-grams of clusters that the reference does not have; null where there are none."""
    h, r = grams(T.graphemes(hypothesis), n), grams(T.graphemes(reference), n)
    return let(h, lambda x: F.size(F.array_except(x, r)) / F.nullif(F.size(x), F.lit(0)))


def agreeing(first: DataFrame, second: DataFrame, key: str, text: str = "text", most: float = 0.1) -> DataFrame:
    """``first`` where ``second`` has the same key and a text within the error rate; one equi-join, no text is compared with another key's."""
    require(0 <= most <= 1, f"the rate must be between 0 and 1, got {most}")
    k, norm = free_name(first, "other_key"), free_name(first, "norm")
    other = second.select(F.col(key).alias(k), T.normalize(F.col(text)).alias("other_text"))
    mine = first.select(F.col(key).alias(k), T.normalize(F.col(text)).alias(norm)).join(other, k)
    agreed = mine.filter(F.coalesce(gcer(F.col(norm), F.col("other_text")), F.lit(1.0)) <= most).select(k)
    return first.join(agreed, F.col(key) == F.col(k), "left_semi")
