import math

import pytest

from lodestone.operators import metrics
from lodestone.plans import standins


@pytest.fixture(scope="module")
def gold(spark):
    return spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "question_id bigint, chunk_id bigint")


@pytest.fixture(scope="module")
def retrieved(spark):
    rows = [(1, 1, 10), (1, 2, 10), (2, 1, 5), (2, 2, 6), (2, 3, 20), (3, 1, 8)]
    return spark.createDataFrame(rows, "question_id bigint, rank int, chunk_id bigint")


def test_recall_and_mrr(gold, retrieved):
    row = metrics.retrieval_metrics(gold, retrieved).head()
    assert (row["n_questions"], row["recall"], row["mrr"]) == (3, pytest.approx(2 / 3), pytest.approx(4 / 9))
    assert metrics.retrieval_metrics(gold, retrieved, k=2).head()["recall"] == pytest.approx(1 / 3)


def test_recall_rises_with_k(gold, retrieved):
    rows = metrics.retrieval_sweep(gold, retrieved, [1, 2, 3, 9]).orderBy("k").collect()
    assert [round(r["recall"], 6) for r in rows] == [0.333333, 0.333333, 0.666667, 0.666667]
    assert all(r["n_questions"] == 3 for r in rows)


def test_batches_and_the_overall_row(gold, retrieved):
    scores = metrics.per_question_retrieval(gold, retrieved)
    rows = {r["batch_id"]: (r["n_questions"], r["recall"]) for r in metrics.batch_metrics(scores, "question_id", 2, ["recall"]).collect()}
    assert rows == {0: (2, 1.0), 1: (1, 0.0), None: (3, pytest.approx(2 / 3))}


def pairs(spark, *texts):
    return spark.createDataFrame([(i, p, r) for i, (p, r) in enumerate(texts)], "pair_id bigint, prediction string, reference string")


def test_squad(spark):
    got = {r["pair_id"]: (r["squad_exact_match"], r["squad_f1"]) for r in metrics.squad_per_pair(pairs(
        spark, ("The Point, State Park!", "point state park"), ("x y", "z"), ("a b b c", "b b d"), ("", ""), ("the", "word"),
    )).collect()}
    # "a" is an article: the bags are {b, b, c} and {b, b, d}.
    assert got == {0: (100.0, 100.0), 1: (0.0, 0.0), 2: (0.0, pytest.approx(200 / 3)), 3: (100.0, 0.0), 4: (0.0, 0.0)}


def test_rouge_uses_ascii_tokens(spark):
    row = metrics.rouge1(pairs(spark, ("The cat-sat", "the cat"), ("é", "é"))).head()
    assert row["rouge1"] == pytest.approx((2 * 2 / 5 + 0) / 2)


def test_bleu(spark, one):
    row = metrics.bleu1(pairs(spark, ("the the cat", "the cat sat down"), ("yes", "yes"))).head()
    assert row["bleu1"] == pytest.approx((3 + 1) / (4 + 1) * math.exp(1 - 5 / 4))
    longer = metrics.bleu1(pairs(spark, ("a b c", "a b"))).head()
    assert longer["bleu1"] == pytest.approx(3 / 4)
    assert metrics.bleu1(pairs(spark, ("", "x"))).head()["bleu1"] == 0.0


def test_bleu_tokens(one):
    assert one(metrics.bleu_tokens("t"), t="It's 3.5-4,000 (about) &amp; more.") == ["It's", "3.5", "-", "4,000", "(", "about", ")", "&", "more", "."]


def test_token_matching(spark):
    row = metrics.bertscore(pairs(spark, ("a b", "a b"), ("", "x")), standins.context_encoder(32)).head()
    assert row["bertscore_f1"] == pytest.approx(0.5) and row["n_pairs"] == 2
    one_sided = metrics.bertscore(pairs(spark, ("a", "a b")), standins.context_encoder(32)).head()
    assert one_sided["bertscore_precision"] == pytest.approx(1.0) and one_sided["bertscore_recall"] < 1


def test_token_matching_holds_few_texts_at_once(spark):
    import numpy as np

    from lodestone.operators import metrics

    def factory():
        def encode(texts):
            assert len(texts) <= 2 * metrics.BERT_PAIRS
            return [(t.split(), np.eye(4)[[int(w) for w in t.split()]]) for t in texts]
        return encode

    pairs = spark.createDataFrame([(i, f"{i % 4} {i // 4 % 4}", f"{i % 3} {i // 3 % 4} {i // 12 % 4}") for i in range(300)],
                                  "pair_id bigint, prediction string, reference string").coalesce(1)
    for r in metrics.bertscore_per_pair(pairs, factory).join(pairs, "pair_id").collect():
        p, t = r["prediction"].split(), r["reference"].split()
        assert abs(r["precision"] - np.mean([w in t for w in p])) < 1e-9 and abs(r["recall"] - np.mean([w in p for w in t])) < 1e-9


def test_greedy_matching_by_blocks():
    import numpy as np

    from lodestone.operators import metrics

    p, r = np.random.default_rng(1).normal(size=(2, 7, 3))
    whole = p @ r.T
    assert np.allclose(metrics._greedy(p, r, 3), (whole.max(axis=1).mean(), whole.max(axis=0).mean()))
