"""The sweep over three cut-offs against fusing, reranking and scoring each combination on its own."""

import random

from pyspark.sql import functions as F

from lodestone.operators import metrics, retrieve

SPARSE, DENSE, RERANK = [1, 2, 4], [1, 3], [1, 2, 5]


def test_grid_equals_each_combination_run_alone(spark):
    rng = random.Random(4)
    words = "a b c d e f".split()
    texts = {c: " ".join(rng.choices(words, k=3)) for c in range(12)}
    questions = {q: " ".join(rng.choices(words, k=2)) for q in range(15)}
    # Some questions have no hit in one channel or in both; question 14 has a gold chunk that nobody finds.
    channel = lambda k, none: [(q, i + 1, c) for q in questions if q not in none for i, c in enumerate(rng.sample(sorted(texts), k))]
    sparse_rows, dense_rows = channel(4, {3, 5}), channel(3, {4, 5})
    gold_rows = [(q, rng.randrange(12)) for q in range(14)] + [(14, 99)]
    ranked = "question_id bigint, rank int, chunk_id bigint"
    sparse, dense = spark.createDataFrame(sparse_rows, ranked), spark.createDataFrame(dense_rows, ranked)
    gold = spark.createDataFrame(gold_rows, "question_id bigint, chunk_id bigint")
    asked = spark.createDataFrame(list(questions.items()), "question_id bigint, question string")
    chunks = spark.createDataFrame(list(texts.items()), "chunk_id bigint, text_content string")

    scored = retrieve.scored_candidates(sparse, dense, asked, chunks).cache()
    pairs = {(r.question_id, r.chunk_id): r for r in scored.collect()}
    assert set(pairs) == {(q, c) for q, _, c in sparse_rows + dense_rows} and len(pairs) == scored.count()
    score = {k: r.score for k, r in pairs.items()}
    got = {(r.sparse_k, r.dense_k, r.rerank_k): (r.n_questions, round(r.recall, 9), round(r.mrr, 9))
           for r in metrics.retrieval_grid(gold, scored, SPARSE, DENSE, RERANK).collect()}
    assert len(got) == len(SPARSE) * len(DENSE) * len(RERANK)
    for s in SPARSE:
        for d in DENSE:
            order = {}
            for q, rank, c in [(q, (0, r), c) for q, r, c in sparse_rows if r <= s] + [(q, (1, r), c) for q, r, c in dense_rows if r <= d]:
                order.setdefault(q, {})
                order[q][c] = min(order[q].get(c, (2, 0)), rank)
            for k in RERANK:
                hits = []
                for q, g in gold_rows:
                    best = sorted(order.get(q, {}), key=lambda c: (-score[q, c], order[q][c]))[:k]
                    hits.append(best.index(g) + 1 if g in best else None)
                recall, mrr = sum(h is not None for h in hits) / 15, sum(1 / h for h in hits if h) / 15
                assert got[s, d, k] == (15, round(recall, 9), round(mrr, 9)), (s, d, k)
    # One combination by the operators themselves.
    fused = retrieve.fuse(sparse.filter("rank <= 2"), dense, dedup=True).join(chunks, "chunk_id").join(asked, "question_id")
    alone = metrics.retrieval_metrics(gold, retrieve.rerank(fused, n=2)).head()
    assert got[2, 3, 2] == (15, round(alone.recall, 9), round(alone.mrr, 9))
    assert metrics.retrieval_grid(gold.limit(0), scored, [1], [1], [1]).count() == 0
    empty = metrics.retrieval_grid(gold, scored.limit(0), [1], [1], [1]).head()
    assert (empty.n_questions, empty.recall, empty.mrr) == (15, 0.0, 0.0)


def test_an_injected_scorer_sees_each_pair_once(spark):
    ranked = "question_id bigint, rank int, chunk_id bigint"
    both = spark.createDataFrame([(1, 1, 7), (1, 2, 8)], ranked)
    asked = spark.createDataFrame([(1, "q")], "question_id bigint, question string")
    chunks = spark.createDataFrame([(7, "x"), (8, "longer")], "chunk_id bigint, text_content string")

    def factory():
        return lambda pairs: [float(len(p)) for _, p in pairs]

    rows = retrieve.scored_candidates(both, both.filter("rank = 2"), asked, chunks, scorer=factory).orderBy("chunk_id").collect()
    assert [tuple(r) for r in rows] == [(1, 7, 1, None, 1.0), (1, 8, 2, 2, 6.0)]
