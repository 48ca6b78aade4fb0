"""Document fingerprints as Merkle trees over sections and paragraphs, in native expressions only.

A text is cut into sections at blank lines (two line feeds), sections into paragraphs at
line feeds, and paragraphs into leaves: sentences, cut after ``LEAF`` code points where
they are longer. The cuts lose nothing, so two texts have equal roots only if they are
equal (up to collisions of 128-bit hashes).

A fingerprint is one string with all nodes of the tree: the root (32 hex digits), ``|``, and the sections
with ``/`` between them. A section is the first 16 digits of its hash, ``:``, and its
paragraphs with ``;`` between them; a paragraph is 16 digits of its hash, ``=``, and the
first 8 digits of each leaf's hash with ``,`` between them. Two strings are enough to walk
down the branches that differ (:func:`differing`).

Defined results: a null text is empty, and the empty text has one empty paragraph. Ties of
ids are ordered by a hash of the text, then by the text; null ids come last. Ids may be of any type that has an order. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lipika.columns import let, matches
from lipika.operators import corpus

LEAF = 160
#: Rows in a range by which neighbours are found.
ROWS = 2_000
LEAF_PATTERN = rf"[^.!?]{{1,{LEAF}}}[.!?]*|[.!?]+"


def tree(text: Column) -> Column:
    """Sections of paragraphs of leaf hashes: array<array<array<string>>>."""
    sections = F.split(F.coalesce(text, F.lit("")), "\n\n", -1)
    return F.transform(sections, lambda s: F.transform(F.split(s, "\n", -1), lambda p: F.transform(matches(p, LEAF_PATTERN), lambda x: F.md5(x))))


def fingerprint(text: Column) -> Column:
    """The fingerprint string of a text."""

    def paragraph(ls: Column) -> Column:
        short = F.array_join(F.transform(ls, lambda x: F.substring(x, 1, 8)), ",")
        return let(F.md5(F.array_join(ls, ",")), lambda h: F.struct(h.alias("h"), F.concat(F.substring(h, 1, 16), F.lit("="), short).alias("shown")))

    def section(ps: Column) -> Column:
        def of(nodes: Column) -> Column:
            h = F.md5(F.array_join(F.transform(nodes, lambda p: p["h"]), ";"))
            shown = F.array_join(F.transform(nodes, lambda p: p["shown"]), ";")
            return let(h, lambda x: F.struct(x.alias("h"), F.concat(F.substring(x, 1, 16), F.lit(":"), shown).alias("shown")))

        return let(F.transform(ps, paragraph), of)

    def show(nodes: Column) -> Column:
        root = F.md5(F.array_join(F.transform(nodes, lambda s: s["h"]), "/"))
        return F.concat(root, F.lit("|"), F.array_join(F.transform(nodes, lambda s: s["shown"]), "/"))

    return let(F.transform(tree(text), section), show)


def leaves(fingerprint: Column) -> Column:
    """Distinct leaves of a fingerprint."""
    return F.array_distinct(F.regexp_extract_all(fingerprint, F.lit("[=,]([0-9a-f]{8})"), F.lit(1)))


def likeness(a: Column, b: Column) -> Column:
    """Share of common leaves: 1 for equal fingerprints, 0 where no leaf is in both."""
    return F.when(a == b, F.lit(1.0)).otherwise(
        let(
            F.struct(leaves(a).alias("a"), leaves(b).alias("b")),
            lambda x: F.coalesce(
                2.0 * F.size(F.array_intersect(x["a"], x["b"])) / F.nullif(F.size(x["a"]) + F.size(x["b"]), F.lit(0)), F.lit(0.0)
            ),
        )
    )


def differing(a: Column, b: Column) -> Column:
    """Branches in which two fingerprints differ: array of (section, paragraph), from 0. Sections whose nodes are equal are not entered."""
    sections = lambda fp: F.split(F.substring_index(fp, "|", -1), "/", -1)
    node = lambda x, mark: F.substring_index(x, mark, 1)
    paragraphs = lambda s: F.when(s.isNull(), F.array().cast("array<string>")).otherwise(F.split(F.substring_index(s, ":", -1), ";", -1))

    def inside(k: Column, p: Column, q: Column) -> Column:
        def walk(x: Column) -> Column:
            most = F.greatest(F.size(x["p"]), F.size(x["q"]))
            each = F.transform(F.sequence(F.lit(0), most - 1), lambda j: F.struct(k.alias("section"), j.alias("paragraph"), node(F.get(x["p"], j), "=").eqNullSafe(node(F.get(x["q"], j), "=")).alias("same")))
            return F.filter(each, lambda y: ~y["same"])

        return let(F.struct(paragraphs(p).alias("p"), paragraphs(q).alias("q")), walk)

    def walk(x: Column) -> Column:
        most = F.greatest(F.size(x["a"]), F.size(x["b"]))
        pairs = F.transform(F.sequence(F.lit(0), most - 1), lambda k: F.struct(k.alias("k"), F.get(x["a"], k).alias("p"), F.get(x["b"], k).alias("q")))
        unlike = F.filter(pairs, lambda y: ~node(y["p"], ":").eqNullSafe(node(y["q"], ":")))
        found = F.flatten(F.transform(unlike, lambda y: inside(y["k"], y["p"], y["q"])))
        return F.transform(found, lambda y: F.struct(y["section"].alias("section"), y["paragraph"].alias("paragraph")))

    return let(F.struct(sections(a).alias("a"), sections(b).alias("b")), walk)


def with_next(docs: DataFrame, id_col: str, carry: list[str], text: str = "text") -> DataFrame:
    """Each row with ``next_<column>`` of the document before it by id; the first document follows the last.

    Rows are dealt into ranges of (id, hash of the text), whose cut points come from a sample of
    these and whose number grows with the table; so an id that a third of all rows share is
    spread. Each range is one window group and gets a copy of the row that follows it. The
    ranges' greatest keys (one row each) are broadcast. Rows are shuffled once.
    """
    keyed = docs.select(F.col(id_col), *carry, F.xxhash64(text).alias("text_hash"))
    order = [id_col, "text_hash"]
    part = corpus.range_of(keyed, order, corpus.cut_points(keyed, order, ROWS))
    dealt = keyed.withColumn("part", part).withColumn("copied", F.lit(False))
    tops = dealt.groupBy("part").agg(F.max(F.struct(*order)).alias("top"))
    up = Window.orderBy("part")  # one row a range
    goes = F.coalesce(F.lead("part").over(up), F.first("part").over(up))
    tops = tops.select(F.col("part").alias("of"), F.col(f"top.{id_col}").alias("top_id"), F.col("top.text_hash").alias("top_hash"), goes.alias("goes"))
    is_top = (F.col("part") == F.col("of")) & F.col(id_col).eqNullSafe(F.col("top_id")) & (F.col("text_hash") == F.col("top_hash"))
    copies = dealt.join(F.broadcast(tops), is_top).dropDuplicates(["of"])
    copies = copies.select(id_col, *carry, "text_hash", F.col("goes").alias("part"), F.lit(True).alias("copied"))
    window = Window.partitionBy("part").orderBy("copied", F.desc_nulls_last(id_col), F.desc("text_hash"), *carry)
    led = dealt.unionByName(copies).select("*", *(F.lead(c).over(window).alias(f"next_{c}") for c in carry))
    return led.filter(~F.col("copied")).drop("part", "copied", "text_hash")


def edits(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of texts and of their edited texts, their likeness to each other and to the next document, and the branches that the edit changed."""
    base = docs.select(id_col, F.coalesce(F.col(text), F.lit("")).alias("text"))
    base = base.withColumn("fingerprint", fingerprint(F.col("text")))
    led = with_next(base, id_col, ["text", "fingerprint"])
    n = F.length("text")
    tail = F.floor(n / 3).cast("int")
    edited = F.concat(F.col("text").substr(F.lit(1), n - tail), F.col("next_text").substr(F.lit(1), tail))
    made = led.select(id_col, n.cast("long").alias("n_chars"), "fingerprint", "next_fingerprint", edited.alias("edited"))
    made = made.select("*", fingerprint(F.col("edited")).alias("edited_fingerprint"))
    return made.select(
        id_col,
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
        differing(F.col("fingerprint"), F.col("edited_fingerprint")).alias("changed"),
    )
