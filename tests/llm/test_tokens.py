import os
import random

import numpy as np
import pytest

from tarnwise.llm import tokens

RANKS = tokens.rank_file("byte_bpe_50k")
pytestmark = pytest.mark.skipif(not os.path.exists(RANKS), reason="no vocabulary files")


@pytest.fixture(scope="module")
def enc():
    return tokens.Encoder(RANKS)


@pytest.fixture(scope="module")
def reference(enc):
    tiktoken = pytest.importorskip("tiktoken")
    return tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=enc.ranks, special_tokens={})


def test_same_ids_as_the_library(enc, reference):
    rnd = random.Random(1)
    letters = "abcdeghilnorst  .,-ABéñü漢字\n\t0123456789'\"()😀"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60))) for _ in range(2000)]
    texts += ["a" * 3000, " " * 2000, "<|endoftext|>", "naïve\r\n\r\n  x", None, ""]
    flat, offsets = enc.encode_batch(texts)
    for i, t in enumerate(texts):
        assert flat[offsets[i] : offsets[i + 1]].tolist() == (reference.encode_ordinary(t) if t else [])
    assert 0 < enc.exact < enc.proposed


def test_pairs_are_judged_as_merging_would(enc):
    inv = {v: k for k, v in enc.ranks.items()}
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 50256, 4000), np.r_[rng.integers(0, 400, 2000), rng.integers(0, 50256, 2000)]
    ok = enc.compatible(a, b)
    assert all(ok[i] == (enc._merge(inv[a[i]] + inv[b[i]]) == [a[i], b[i]]) for i in range(4000))


def test_frame(spark):
    df = spark.createDataFrame([(1, "fever and chills", 0), (2, "", 0), (3, None, 0), (4, "fever and chills", 0)], "doc_id long, text string, n_tokens int")
    got = {r["doc_id"]: (r["ids"], r["n_tokens"]) for r in tokens.encode(df, "doc_id").collect()}
    assert got[2] == ([], 0) and got[3] == ([], 0) and got[1] == got[4] and len(got[1][0]) == got[1][1]
    assert tokens.encode(df.limit(0), "doc_id", ids=False).count() == 0
