import random

from lipika.llm.topk import most_frequent


def test_equals_sorting_everything(spark):
    rng = random.Random(6)
    rows = [(f"w{k}", int(rng.paretovariate(0.7))) for k in range(3000)]
    df = spark.createDataFrame(rows, "word string, n long")
    expected = sorted(rows, key=lambda r: (-r[1], r[0]))
    for k in (1, 7, 100, 2999, 5000):
        assert [tuple(r) for r in most_frequent(df, k, "word").collect()] == expected[:k]
    assert most_frequent(df.limit(0), 5, "word").count() == 0
