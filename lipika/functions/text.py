"""Text functions over columns. All are native except NFC, for which Spark has no function."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from lipika import charset as ch
from lipika.columns import let, matches
from lipika.errors import require

FEATURES = ("onset", "nuktas", "vowel", "modifiers", "has_zwj", "has_zwnj")


@F.pandas_udf(StringType())
def _nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def nfc(text: Column) -> Column:
    """NFC. Texts of code points below U+0300 are in it already and do not leave the JVM's row."""
    needs = text.rlike(r"[^\x{0000}-\x{02FF}]")
    return F.coalesce(_nfc(F.when(needs, text)), text)


def is_nfc(text: Column) -> Column:
    return nfc(text) == text


def normalize(text: Column, zwnj_policy: str = "preserve", canonical_khanda_ta: bool = True) -> Column:
    """Legacy khanda-ta, NFC, the three letters that NFC takes apart, and the joiner policy, in this order."""
    require(zwnj_policy in ("preserve", "strip"), f"unknown zwnj_policy {zwnj_policy!r}")
    if canonical_khanda_ta:
        text = F.replace(text, F.lit(ch.TA + ch.VIRAMA + ch.ZWJ), F.lit(ch.KHANDA_TA))
    text = nfc(text)
    for pair, letter in ch.RECOMPOSED.items():
        text = F.replace(text, F.lit(pair), F.lit(letter))
    return F.translate(text, ch.ZWJ + ch.ZWNJ, "") if zwnj_policy == "strip" else text


def words(text: Column) -> Column:
    """Pieces between white space."""
    return F.filter(F.split(text, f"[{ch.SPACE_CLASS}]+"), lambda w: w != "")


def is_blank(text: Column) -> Column:
    return text.isNull() | ~text.rlike(f"[^{ch.SPACE_CLASS}]")


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{ch.SPACE_CLASS}]+|[{ch.SPACE_CLASS}]+$", "")


def bytes_of(text: Column) -> Column:
    return F.octet_length(text)


def graphemes(text: Column) -> Column:
    """Extended grapheme clusters of Bengali, ASCII and scripts without conjuncts."""
    return matches(text, ch.GRAPHEME)


@F.pandas_udf(ArrayType(StringType()))
def graphemes_any_script(texts: pd.Series) -> pd.Series:
    """The same for every script, through a library: for rows of other Indic scripts."""
    import regex

    pattern = regex.compile(r"\X")
    return texts.map(pattern.findall, na_action="ignore")


def num_clusters(text: Column) -> Column:
    return F.size(graphemes(text))


def codepoints(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def chunks(text: Column) -> Column:
    """Syllables and single clusters of all else, as strings."""
    return matches(text, ch.CHUNK)


def is_akshara(chunk: Column) -> Column:
    return chunk.rlike(f"^[{ch.C}{ch.V}]")


def kind(chunk: Column) -> Column:
    return F.when(is_akshara(chunk), F.lit("akshara")).otherwise(F.lit("other"))


@F.arrow_udf(ArrayType(IntegerType()))
def _running(sizes: pa.Array) -> pa.Array:
    edges = np.asarray(sizes.offsets, np.int64)
    values = sizes.values.to_numpy(zero_copy_only=False)[edges[0] : edges[-1]]
    edges -= edges[0]
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    before = total[:-1] - np.repeat(total[edges[:-1]], np.diff(edges))
    return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(before, pa.int32()), mask=sizes.is_null())


def offsets(parts: Column) -> Column:
    """Where each string of an array starts, in code points: sums over the array, which no native function gives in linear time."""
    return _running(F.transform(parts, F.length))


def aksharas(text: Column) -> Column:
    """Chunks with kind and code point offsets (array of struct)."""
    parts = chunks(text)
    item = lambda c, at: F.struct(c.alias("text"), kind(c).alias("kind"), at.alias("start"), (at + F.length(c)).alias("end"))
    return F.zip_with(parts, offsets(parts), item)


def count_aksharas(text: Column) -> Column:
    """How many syllables. They can be counted alone, but where a letter may join a mark before it (prepended marks)."""
    return F.when(text.rlike(ch.PREPENDED), F.size(F.filter(chunks(text), is_akshara))).otherwise(F.regexp_count(text, F.lit(ch.akshara())))


def chunk_rows(df: DataFrame, key: str, text: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each chunk: ``key``, kept columns, ``pos``, ``chunk``, ``kind``, ``start``, ``end``; each text by itself, without a shuffle."""
    cut = df.select(key, *keep, chunks(F.col(text)).alias("chunk"))
    both = F.arrays_zip(F.col("chunk"), offsets(F.col("chunk")).alias("start"))
    rows = cut.select(key, *keep, F.posexplode(both).alias("pos", "c"))
    rows = rows.select(key, *keep, "pos", F.col("c.chunk").alias("chunk"), F.col("c.start").alias("start"))
    return rows.select(key, *keep, "pos", "chunk", kind(F.col("chunk")).alias("kind"), "start", (F.col("start") + F.length("chunk")).alias("end"))


def script_pieces(text: Column) -> Column:
    """The text cut at white space and where the script changes: runs of Bengali, Latin letters, digits, or anything else."""
    return matches(text, ch.SCRIPT_RUN)


# predicates of one cluster
def is_conjunct(c: Column) -> Column:
    return c.contains(ch.VIRAMA) & c.rlike(f"[{ch.C}]")


def has_reph(c: Column) -> Column:
    return c.startswith(ch.RA + ch.VIRAMA)


def has_ya_phala(c: Column) -> Column:
    return c.contains(ch.VIRAMA + ch.YA)


def has_ra_phala(c: Column) -> Column:
    return c.contains(ch.VIRAMA + ch.RA) & ~c.startswith(ch.RA)


def has_nukta(c: Column) -> Column:
    return c.contains(ch.NUKTA)


def is_bengali(c: Column) -> Column:
    return c.rlike(r"^[\x{0980}-\x{09FF}]")


def describe(c: Column) -> Column:
    """Struct of a cluster's structure."""
    return F.struct(
        c.alias("cluster"),
        F.length(c).alias("codepoints"),
        is_conjunct(c).alias("conjunct"),
        has_reph(c).alias("reph"),
        has_ya_phala(c).alias("ya_phala"),
        has_ra_phala(c).alias("ra_phala"),
        has_nukta(c).alias("nukta"),
        is_bengali(c).alias("bengali"),
    )


def matra_position(c: Column) -> Column:
    """Where a vowel sign is drawn; null for other characters."""
    table = F.create_map(*(F.lit(x) for pair in sorted(ch.MATRA_POSITION.items()) for x in pair))
    return F.element_at(table, c)


def codepoint_name(c: Column) -> Column:
    return F.format_string("U+%04X", F.ascii(c))


# lines
def is_clean_line(line: Column, min_ratio: float = 0.75, min_len: int = 4) -> Column:
    """Enough of the line is Bengali or printable ASCII."""
    size = F.length(line)
    good = size - F.length(F.regexp_replace(line, r"[\x{0980}-\x{09FF} -~]", ""))
    return (size >= min_len) & (good / F.nullif(size, F.lit(0)) >= min_ratio)


def split_lines(text: Column) -> Column:
    """Lines where there are two or more; else sentences after a terminator and white space; trimmed, none blank."""
    full = lambda parts: F.filter(F.transform(parts, trimmed), lambda p: p != "")
    stops = ch.CURRENCY_FOUR + ch.DANDA + ch.DOUBLE_DANDA
    return let(full(F.split(text, "\n")), lambda ls: F.when(F.size(ls) > 1, ls).otherwise(full(F.split(text, f"(?<=[{stops}])[{ch.SPACE_CLASS}]+"))))


# features of one syllable
def onset_part(chunk: Column) -> Column:
    return F.regexp_extract(chunk, ch.ONSET, 0)


def onset_tail(chunk: Column) -> Column:
    """Struct (onset, tail): the consonant chain and what follows; vowel-initial syllables are whole."""
    onset = F.when(chunk.rlike(f"^[{ch.V}]"), chunk).otherwise(onset_part(chunk))
    return let(onset, lambda o: F.struct(o.alias("onset"), F.substring(chunk, F.length(o) + 1, F.length(chunk)).alias("tail")))


def features(chunk: Column) -> Column:
    """Struct of a syllable's parts; null for other chunks. ``is_lossless``: the parts give the syllable again.

    The onset ends at a vowel sign and at a virama that a joiner follows; consonants after
    that are in no field, and then ``is_lossless`` is false.
    """
    vowel_first = chunk.rlike(f"^[{ch.V}]")
    onset = onset_part(chunk)
    rest = F.when(vowel_first, F.substring(chunk, 2, 1 << 30)).otherwise(F.substring(chunk, F.length(onset) + 1, F.length(chunk)))

    def of(x: Column) -> Column:
        units = matches(x["onset"], ch.ONSET_UNIT)
        nuktas = F.transform(units, lambda u: u.contains(ch.NUKTA))
        sign = F.get(F.reverse(matches(x["rest"], f"[{ch.M}]")), F.lit(0))
        vowel = F.coalesce(sign, F.when(vowel_first, F.substring(chunk, 1, 1)))
        marks = matches(x["rest"], f"[{ch.K}]")
        joined = F.array_join(F.transform(units, lambda u: F.concat(F.substring(u, 1, 1), F.when(u.contains(ch.NUKTA), F.lit(ch.NUKTA)).otherwise(F.lit("")))), ch.VIRAMA)
        again = F.concat(joined, F.coalesce(vowel, F.lit("")), F.array_join(marks, ""))
        return F.struct(
            chunk.alias("text"),
            F.transform(units, lambda u: F.substring(u, 1, 1)).alias("onset"),
            nuktas.alias("nuktas"),
            vowel.alias("vowel"),
            marks.alias("modifiers"),
            chunk.contains(ch.ZWJ).alias("has_zwj"),
            chunk.contains(ch.ZWNJ).alias("has_zwnj"),
            (again == chunk).alias("is_lossless"),
        )

    return F.when(is_akshara(chunk), let(F.struct(onset.alias("onset"), rest.alias("rest")), of))


def featurize(text: Column) -> Column:
    """Chunks of the normalised text, each with its kind and its features (null for other chunks)."""
    return F.transform(chunks(normalize(text)), lambda c: F.struct(c.alias("chunk"), kind(c).alias("kind"), features(c).alias("features")))
