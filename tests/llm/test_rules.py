from lipika.llm import rules


def test_measures_of_small_texts(spark):
    rows = [(1, None), (2, ""), (3, "a b c a b c"), (4, "x\nx\n \ny"), (5, "### ok"), (5, "### ok"), (None, "a b c d a b c")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as failed", "2 as n_words", "3 as kept")
    got = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_lines, r.n_dup_lines, r.n_repeat_words) for r in rules.ledger(df).collect()]
    assert got == [
        (1, 0, 0, 0, 0, 0, 0),
        (2, 0, 0, 0, 0, 0, 0),
        (3, 6, 6, 0, 1, 0, 6),
        (4, 3, 3, 0, 3, 1, 0),
        (5, 2, 5, 3, 1, 0, 0),
        (5, 2, 5, 3, 1, 0, 0),
        (None, 7, 7, 0, 1, 0, 6),
    ]
    assert rules.ledger(df.limit(0)).count() == 0


def test_policies_and_ablation(spark):
    bits = [0, 1, 1, 3, 4, 96]
    rows = spark.createDataFrame([(b,) for b in bits], "failed long")
    assert [r.kept for r in rules.apply_policy(rows, "base-1").collect()] == [True, False, False, False, True, True]
    got = {r.rule: (r.n_failed, r.n_failed_alone, r.n_kept_without) for r in rules.ablation(rows, "full-2").collect()}
    for k, name in enumerate(rules.RULES):
        b = 1 << k
        assert got[name] == (sum(bool(x & b) for x in bits), sum(x == b for x in bits), sum(x & ~b == 0 for x in bits))
