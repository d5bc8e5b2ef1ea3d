from tarnwise.llm import truncation as T

WHOLE = [f"The patient {v} on day {i}. Seen by team {i}.\nDiet: low salt" for i, v in enumerate(["slept well", "ate little", "walked far", "felt fine"] * 10)]


def _docs(spark, extra):
    return spark.createDataFrame([(i, t, "s", "x") for i, t in enumerate(WHOLE)] + [(100 + i, t, "s", "x") for i, t in enumerate(extra)], "doc_id long, text string, source string, mask string")


def test_cut_and_whole(spark):
    cut = ["The patient slept w", "The patient ate little on day 3. The", "The patient walked far on day 2,   \n\t ", "The patient felt fine on ", "The patient ate little on day 3.\nDiet: low s", "The patient ate little on day 3.\nDie", "The patient fel�"]
    whole = ["The patient ate little on day 9.", "The patient ate little on day 9!  \n", None, "", " \n\t ", "The patient slept well on day 3.\nDiet: low salt", 'The patient said "fine."']
    got = {r["doc_id"] for r in T.find_cut(_docs(spark, cut + whole)).collect()}
    assert got == {100 + i for i in range(len(cut))}


def test_rates_and_empty(spark):
    docs = _docs(spark, ["The patient slept w"] * 3 + [None])
    r = T.rates(docs, T.find_cut(docs)).first()
    assert (r["n_docs"], r["n_cut"], r["usual_length"]) == (43, 3, 19)
    assert T.find_cut(docs.limit(0)).count() == 0
    assert T.find_cut(_docs(spark, ["x" * 200_000, "word " * 50_000])).count() >= 1
