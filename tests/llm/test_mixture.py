import numpy as np

from tarnwise.llm import mixture


def test_budget_is_met_exactly():
    rng = np.random.default_rng(1)
    for _ in range(50):
        lengths = np.unique(rng.integers(1, 400, 60))
        counts = rng.integers(1, 30, len(lengths))
        total = int((lengths * counts).sum())
        budget = int(rng.integers(0, total + 1))
        take = mixture.fit_budget(lengths, counts, budget)
        got = int((take * lengths).sum())
        assert (take <= counts).all() and (take >= 0).all() and got <= budget and budget - got <= 1
    assert mixture.fit_budget(np.array([5, 7]), np.array([1, 1]), 6).tolist() == [1, 0]
    assert mixture.fit_budget(np.array([5, 7]), np.array([1, 1]), 99).tolist() == [1, 1]


def test_shares_and_repeats(spark):
    rows = [(i, "big", 10 + i % 7) for i in range(500)] + [(1000 + i, "small", 5 + i) for i in range(6)] + [(2000, None, 5), (2001, "other", 5), (2002, "big", 0)]
    sizes = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("big", 0.7, 1), ("small", 0.2, 3), ("none", 0.1, 2)], "source string, weight double, max_repeats int")
    chosen, report = mixture.mix(sizes, targets)
    got = {r["source"]: r for r in report.collect()}
    assert got["small"]["most_copies"] == 3 and got["none"]["tokens_used"] == 0
    assert abs(got["big"]["actual_share"] - 0.7 / 0.9) < 0.01 and got["big"]["tokens_used"] == got["big"]["tokens_target"]
    assert chosen.filter("copies > 3 or source not in ('big', 'small')").count() == 0
    again, _ = mixture.mix(sizes.repartition(5), targets)
    assert again.exceptAll(chosen).count() == 0
    _, short = mixture.mix(sizes, targets, total=5000)
    assert {r["source"]: r["tokens_used"] for r in short.collect()}["small"] == 3 * sum(5 + i for i in range(6))
    empty, report = mixture.mix(sizes.limit(0), targets)
    assert empty.count() == 0 and report.count() == 3
