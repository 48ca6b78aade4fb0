import random
from collections import Counter

from pyspark.sql import functions as F

from lipika.llm import spans

PASSAGE = "Then the grey ship came slowly past the mole. Nobody on the quay had seen her flag before. She carried salt and iron and nine letters. The harbour master wrote every name twice."


def filler(seed, n=6):
    return " ".join(f"Word{seed}x{k} stands here with others of group {seed * 7 + k} only." for k in range(n))


def brute(docs, run, min_words):
    """Removed sentence positions by plain counting over all runs in id order."""
    places = {}
    for i, t in docs:
        for at, h in spans.run_hashes(t, run, min_words):
            places.setdefault(h, []).append((i, at))
    gone = {i: set() for i, _ in docs}
    for found in places.values():
        for i, at in sorted(found)[1:]:
            gone[i] |= set(range(at, at + run))
    return {i: "".join(t[a:z] for k, (a, z, _) in enumerate(spans.sentences(t)) if k not in gone[i]) for i, t in docs}


def test_sentences_cover_the_text():
    for t in ["", "a", "One. Two!  Three?\n\nFour", "x " * 100, " lead. tail ", "no stop\nline", filler(3)]:
        cut = spans.sentences(t)
        assert "".join(t[a:z] for a, z, _ in cut) == (t if t.split() else "")
        assert Counter(w for s in cut for w in s[2]) == Counter(t.split())


def test_passages_go_from_all_but_the_first_and_nothing_else(spark):
    docs = [(3, filler(1) + " " + PASSAGE + " " + filler(2)), (5, filler(4) + "\n" + PASSAGE), (9, filler(8)), (7, "and so " + PASSAGE + " " + filler(6))]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, removed string")
    got = spans.remove_repeats(df)
    assert got.columns == ["doc_id", "text", "removed", "removed_1"]
    rows = {r.doc_id: r for r in got.collect()}
    expected = brute(sorted(docs), 2, 12)
    assert {i: r.text for i, r in rows.items()} == expected
    assert rows[3].text == docs[0][1] and rows[9].text == docs[2][1]
    assert "letters" not in rows[5].text and "twice" not in rows[7].text
    assert rows[7].text.startswith("and so ") and filler(6) in rows[7].text
    for i, t in docs:
        kept, at = "", 0
        for s in rows[i]["removed_1"]:
            kept, at = kept + t[at : s["start"]], s["end"]
        assert kept + t[at:] == rows[i].text


def test_query_equals_brute_force(spark):
    from lipika.llm.queries import op9_sentence_spans

    sf = "/root/testdata/sf0.001"
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    assert {r.doc_id: r.text for r in op9_sentence_spans(spark, sf).collect()} == brute(docs, 2, 12)


def test_nulls_ties_and_empty_tables(spark):
    rows = [(1, None), (2, ""), (None, PASSAGE), (4, PASSAGE), (4, PASSAGE), (6, "\n ")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted([(r.doc_id, r.text) for r in spans.remove_repeats(df).collect()], key=str)
    assert got == sorted([(1, None), (2, ""), (None, ""), (4, PASSAGE), (4, PASSAGE), (6, "\n ")], key=str)
    assert spans.remove_repeats(df.limit(0)).count() == 0


def test_passages_of_short_sentences(spark):
    """Over 50 words in sentences of three to five words: no two neighbours have 12."""
    rng = __import__("random").Random(3)
    passage = " ".join(" ".join(f"p{rng.randrange(10**6)}" for _ in range(rng.randrange(3, 6))) + "." for _ in range(15))
    docs = [(1, filler(1) + " " + passage + " " + filler(2)), (2, filler(3) + " " + passage + " " + filler(4)), (3, passage), (4, filler(5) + " " + passage.replace(". ", "\n"))]
    got = {r.doc_id: r.text for r in spans.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: docs[0][1], 2: filler(3) + " " + filler(4), 3: "", 4: docs[3][1]}
    assert got == brute(docs, 2, 12)


def test_each_sentence_of_a_passage_is_in_a_run_inside_it():
    rng = __import__("random").Random(1)
    for _ in range(300):
        sizes = [rng.randrange(1, 9) for _ in range(rng.randrange(1, 20))]
        found = spans.spans_of(sizes, 2, 12)
        assert all(sum(sizes[a:z]) >= 12 and (z - a >= 2 or len(sizes) == 1) for a, z in found)
        if sum(sizes) >= 12:
            assert {k for a, z in found for k in range(a, z)} == set(range(len(sizes)))


def plain(rows):
    """Brute force, on texts whose sentences end in a full stop and a space: every run of the fewest sentences that are two and have 12 words, from each sentence on and back."""
    def cut(text):
        return [p + ("" if k == len(text.split(". ")) - 1 else ". ") for k, p in enumerate(text.split(". "))]

    seen, kept = {}, []
    parts = [(i, cut(t)) for i, t in rows]
    def runs(ps):
        n = len(ps)
        out = set()
        for a in range(n):
            out |= {(a, z) for z in range(a + 2, n + 1) if sum(len(p.split()) for p in ps[a:z]) >= 12 and not (z - 1 >= a + 2 and sum(len(p.split()) for p in ps[a : z - 1]) >= 12)}
        for z in range(1, n + 1):
            found = [a for a in range(z - 1) if sum(len(p.split()) for p in ps[a:z]) >= 12]
            out |= {(max(found), z)} if found else set()
        return out
    for i, ps in sorted(parts):
        for a, z in sorted(runs(ps)):
            seen.setdefault(" ".join("".join(ps[a:z]).split()), (i, a))
    for i, ps in parts:
        gone = {k for a, z in runs(ps) if seen[" ".join("".join(ps[a:z]).split())] != (i, a) for k in range(a, z)}
        kept.append((i, "".join(p for k, p in enumerate(ps) if k not in gone)))
    return sorted(kept)


def test_equals_plain_loops(spark):
    rng = random.Random(11)
    pool = [" ".join(f"w{rng.randrange(40)}" for _ in range(rng.randrange(2, 9))) for _ in range(25)]
    rows = [(k, ". ".join(rng.choice(pool) for _ in range(rng.randrange(2, 30)))) for k in range(60)]
    got = sorted((r.doc_id, r.text) for r in spans.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), long=None).collect())
    assert got == plain(rows)


def test_a_run_that_fills_a_third_of_the_table(spark):
    words = "one two three four five six seven. eight nine ten eleven twelve thirteen fourteen. "
    rows = [(k, words + f"own {k} words here. and more {k * 7} of them too.") for k in range(1500)] + [(None, "x y z"), (5000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit(1).alias("row_key"), F.lit(2).alias("marks"), F.lit(3).alias("id"), F.lit(4).alias("h"), F.lit(5).alias("times"))
    got = {r.doc_id: r.text for r in spans.remove_repeats(df).collect()}
    assert got[0].startswith("one two") and all(not got[k].startswith("one two") and f"own {k}" in got[k] for k in range(1, 1500))
    assert got[None] == "x y z" and got[5000] is None
