import hashlib

from pyspark.sql import functions as F

from lipika.llm import merkle


def test_neighbours_over_ranges_ties_and_nulls(spark, monkeypatch):
    monkeypatch.setattr(merkle, "ROWS", 40)
    ids = [*range(0, 900, 3), 10**6, 10**6 + 5, -4]
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string")
    got = {r.text: r.next_text for r in merkle.with_next(df, "doc_id", ["text"]).collect()}
    order = [f"t{i}" for i in sorted(ids, reverse=True)]
    assert got == dict(zip(order, order[1:] + order[:1]))
    rows = [(None, "b"), (None, "a"), (5, "y"), (5, "x"), (2, "z")] + [(7, f"h{k}") for k in range(300)]  # an id with most rows
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for kind in ("long", "string"):
        keyed = df.withColumn("doc_id", F.col("doc_id").cast(kind))
        got = {r.text: r.next_text for r in merkle.with_next(keyed, "doc_id", ["text"]).collect()}
        order = [r.text for r in df.orderBy(F.desc_nulls_last("doc_id"), F.desc(F.xxhash64("text"))).collect()]
        assert got == dict(zip(order, order[1:] + order[:1]))
    cuts = merkle.corpus.cut_points(df.withColumn("h", F.xxhash64("text")), ["doc_id", "h"], 40)
    parts = df.withColumn("h", F.xxhash64("text")).select(merkle.corpus.range_of(df.withColumn("h", F.xxhash64("text")), ["doc_id", "h"], cuts).alias("p")).groupBy("p").count().collect()
    assert max(r["count"] for r in parts) < 150
    same = spark.createDataFrame([(1, "q")] * 200 + [(2, "r")], "doc_id long, text string")
    assert {(r.text, r.next_text) for r in merkle.with_next(same, "doc_id", ["text"]).collect()} == {("q", "q"), ("q", "r"), ("r", "q")}
    extremes = spark.createDataFrame([(2**63 - 1, "a"), (-(2**63), "b")], "doc_id long, text string")
    assert {(r.text, r.next_text) for r in merkle.with_next(extremes, "doc_id", ["text"]).collect()} == {("a", "b"), ("b", "a")}


def test_edits_and_branches(spark):
    rows = [(1, None, 3), (2, "One. Two. Three.\nFour five six.\n\nSeven. Eight.", 4), (3, "", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint int")
    got = {r.doc_id: r for r in merkle.edits(df).collect()}
    assert got[1].fingerprint == got[3].fingerprint and got[1].near_edited == 1.0 and got[1].n_chars == 0
    t = rows[1][1]
    edited = t[: len(t) - len(t) // 3]
    assert got[2].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    assert 0 < got[2].near_edited < 1 and got[2].near_next == 0.0
    assert merkle.edits(df.limit(0)).count() == 0
    long = spark.createDataFrame([(1, "Some words here. " * 60_000)], "doc_id long, text string")
    assert merkle.edits(long).first().n_chars == 17 * 60_000
    assert [tuple(x) for x in got[2].changed] == [(1, 0)]
    a, b = "A. B.\nC.\n\nD.\nE.", "A. B.\nX.\n\nD.\nE.\nF."
    fps = spark.range(1).select(merkle.fingerprint(F.lit(a)).alias("a"), merkle.fingerprint(F.lit(b)).alias("b"))
    found = fps.select(merkle.differing(F.col("a"), F.col("b")).alias("d"), merkle.differing(F.col("a"), F.col("a")).alias("same")).first()
    assert [tuple(x) for x in found.d] == [(0, 1), (1, 2)] and found.same == []


def test_native_plan(spark):
    plan = merkle.edits(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
