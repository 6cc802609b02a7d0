"""Filters of addresses, mixtures, vectors and language models on small tables with awkward rows."""

import math
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.llm import ann, lm, mixing, neardup, shared, urls

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block")]


def judged(spark, addresses, rules=RULES):
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(addresses)], "page_id bigint, url string, host string")
    listed = spark.createDataFrame(rules, "host string, path string, verdict string")
    return {r.page_id: r for r in urls.judge(df, "page_id", "url", listed).collect()}


def test_the_longest_rule_wins_on_hosts_and_subdomains(spark):
    got = judged(spark, [
        "http://WWW.Example.com/en/x?q=/no", "https://a.example.com/en/", "https://a.example.com/fr/", "http://example.com",
        "http://notexample.com/en/", "x://a.net/es/1#t", "http://a.net/ES/1", None, "", "no scheme.com/en/", "http://", "a://b://c.com/",
        "http://Élan.com/", "http://a..com/en/", "http://" + "a." * 300 + "net/es/",
    ])
    assert [(r.host, r.path, r.rule, r.verdict) for _, r in sorted(got.items())] == [
        ("www.example.com", "/en/x", "www.example.com/en/", "allow"), ("a.example.com", "/en/", "example.com/en/", "block"),
        ("a.example.com", "/fr/", "com/", "allow"), ("example.com", "", None, "allow"), ("notexample.com", "/en/", "com/", "allow"),
        ("a.net", "/es/1", "net/es/", "block"), ("a.net", "/ES/1", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"),
        ("", "", None, "allow"), ("", "", None, "allow"), ("b:", "//c.com/", None, "allow"), ("Élan.com", "/", "com/", "allow"),
        ("a..com", "/en/", "com/", "allow"), ("a." * 300 + "net", "/es/", "net/es/", "block"),
    ]


def test_repeated_pages_conflicting_and_missing_rules(spark):
    rules = [("com", "/", "allow"), ("com", "/", "block"), (None, "/", "block"), ("org", None, "block")]
    df = spark.createDataFrame([(1, "http://a.com/")] * 3 + [(1, "http://b.org/"), (None, "http://a.com/")], "page_id bigint, url string")
    listed = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = Counter((r.page_id, r.host, r.verdict) for r in urls.judge(df, "page_id", "url", listed).collect())
    assert got == {(1, "a.com", "block"): 3, (1, "b.org", "allow"): 1, (None, "a.com", "block"): 1}
    assert urls.judge(df.limit(0), "page_id", "url", listed).count() == 0
    assert urls.judge(df, "page_id", "url", listed.limit(0), default="block").filter("verdict = 'block'").count() == 5


def test_a_large_rule_table_is_joined_without_broadcast(spark, monkeypatch):
    want = judged(spark, ["http://www.example.com/en/", "http://b.net/es/"])
    monkeypatch.setattr(urls, "BROADCAST_RULES", 1)
    assert judged(spark, ["http://www.example.com/en/", "http://b.net/es/"]) == want


def test_the_full_digest_decides_where_short_prefixes_meet(spark, monkeypatch):
    asked = [f"http://{a}.example.{b}/{c}/" for a in ("www", "x") for b in ("com", "net") for c in ("en", "es", "fr", "")]
    want = judged(spark, asked)
    monkeypatch.setattr(urls, "PREFIX_DIGITS", 1)
    assert judged(spark, asked) == want


def filled(sizes, weights, repeats):
    """Targets by handing out what is over again and again."""
    target, open_ = {}, dict(sizes)
    left = float(sum(sizes.values()))
    while open_:
        share = {s: left * weights[s] / sum(weights[o] for o in open_) for s in open_}
        full = [s for s in open_ if share[s] >= repeats * sizes[s]]
        if not full:
            return target | share
        for s in full:
            target[s] = repeats * sizes[s]
            left -= target[s]
            del open_[s]
    return target


def test_mixtures_reach_their_targets(spark):
    rng = np.random.default_rng(3)
    docs = [(i, "w " * int(n), s, "x") for i, (n, s) in enumerate(zip(rng.integers(1, 40, 900), rng.choice(["a", "b", "c", "é", None], 900, p=[.6, .2, .1, .05, .05])))]
    docs += [(1_000, None, "none", "x"), (1_001, "", "none", "x"), (1_002, " \n", "b", "x")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string, size string")
    got = mixing.mix(df, "doc_id", "text", "source", [1, 2, 3]).collect()
    assert len(got) == len(docs) and got[0].asDict().keys() == {"doc_id", "source", "size", "source_size", "target", "taken"}
    sizes, taken, targets = Counter(), Counter(), {}
    for r in got:
        assert r.size == len((docs[r.doc_id][1] or "").split() if r.doc_id < 900 else []) and r.taken <= 3 * r.size
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        targets[r.source] = r.target
    weights = dict(zip(sorted((s for s in sizes if s is not None)) + [None], [1, 2, 3] * 3))
    want = filled(dict(sizes), weights, 3)
    for s in sizes:
        assert math.isclose(targets[s], want[s], abs_tol=1e-6) and abs(taken[s] - want[s]) <= 20
    again = mixing.mix(df.repartition(3), "doc_id", "text", "source", [1, 2, 3]).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    drawn = Counter(r.doc_id for r in mixing.draw(df, "doc_id", "text", "source", [1, 2, 3]).collect())
    assert all(drawn[r.doc_id] * r.size == r.taken for r in got)


def test_mixtures_of_nothing(spark):
    df = spark.createDataFrame([(1, None, "a"), (1, "", "b"), (None, " ", None)], "doc_id bigint, text string, source string")
    assert [(r.size, r.target, r.taken) for r in mixing.mix(df, "doc_id", "text", "source", [1]).collect()] == [(0, 0.0, 0)] * 3
    assert mixing.mix(df.limit(0), "doc_id", "text", "source", [1]).count() == 0


BAD = [(900, [0.0] * 8), (920, None), (940, [float("nan")] * 8), (None, [1.0] * 8), (960, [None] * 8), (980, []), (1000, [1.0, 2.0])]


def vectors(spark, extra=()):
    rng = np.random.default_rng(11)
    base = rng.standard_normal((300, 8))
    base[200:] = base[:100] + rng.standard_normal((100, 8)) * rng.uniform(0, 0.3, (100, 1))
    base[250:260] = base[250]
    base[260] = base[250] * 3
    rows = [(i, v.astype(np.float32).tolist(), "x") for i, v in enumerate(base)] + [(*b, "x") for b in (*BAD, *extra)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, id string")
    return df, np.array([r[1] for r in rows[:300]])


@pytest.mark.parametrize("cut", [2_048, 5])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, cut):
    monkeypatch.setattr(neardup, "CUT", cut)
    df, x = vectors(spark)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    label = np.arange(300)
    for _ in range(300):
        label = np.where(near, label[None, :], 10**9).min(axis=1)
    got = {r.vec_id: r for r in neardup.near_duplicates(df, "vec_id", "embedding").collect()}
    assert len(got) == 300 + len(BAD)
    assert sum(got[i].n_links != near[i].sum() - 1 for i in range(300)) <= 3  # hashing may miss pairs near the threshold
    assert sum(got[i].component_id != label[i] for i in range(300)) <= 3
    assert all(got[i].kept == (got[i].component_id == i) for i in range(300))
    for i, _ in BAD:
        assert got[i].n_links == 0 and got[i].component_id == i


def test_repeated_vector_ids_hang_together(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 2.0]), (3, [1.0, 1.0])], "vec_id bigint, embedding array<double>")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in neardup.near_duplicates(df, "vec_id", "embedding").collect())
    assert got == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 0, 3)]
    assert neardup.near_duplicates(df.limit(0), "vec_id", "embedding").count() == 0


@pytest.mark.parametrize("cut", [4_096, 20])
def test_neighbours_reach_the_recall_with_exact_scores(spark, monkeypatch, cut):
    monkeypatch.setattr(ann, "CUT", cut)
    monkeypatch.setattr(ann, "LEAF", 16)
    df, x = vectors(spark)
    got = {}
    for r in ann.search(df, "vec_id", "embedding", F.col("id") % 20 == 0, k=10).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert sorted(got) == list(range(0, 300, 20))
    hits = 0
    for q, found in got.items():
        scores = x.astype(np.float64) @ x[q]
        scores[q] = -np.inf
        hits += len(set(np.lexsort((np.arange(300), -scores))[:10]) & {v for _, v, _ in found})
        assert [n for n, _, _ in sorted(found)] == list(range(1, 11))
        assert all(math.isclose(scores[v], s, abs_tol=1e-12) for _, v, s in found)
        assert sorted(found) == sorted(found, key=lambda f: (-f[2], f[1]))
    assert hits >= 0.9 * 10 * len(got)


def test_few_candidates_all_come_back_and_bad_vectors_take_no_part(spark):
    df = spark.createDataFrame([(20, [1.0, 0.0]), (40, [2.0, 0.0]), (3, [2.0, 0.0]), (60, [0.0, 0.0])], "vec_id bigint, embedding array<double>")
    got = [tuple(r) for r in ann.search(df, "vec_id", "embedding", F.col("id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(20, 1, 3, 2.0), (20, 2, 40, 2.0), (40, 1, 3, 4.0), (40, 2, 20, 2.0)]
    assert ann.search(df.limit(0), "vec_id", "embedding", F.col("id") % 20 == 0).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 5_000), max_size=60), st.lists(st.integers(0, 5_100), max_size=30), st.integers(5_101, 2**40))
def test_elias_fano_access_and_successor(numbers, asked, universe):
    values = np.sort(np.array(numbers, dtype=np.uint64))
    held = lm.EliasFano.of(values, universe)
    assert (held.access(np.arange(len(values))) == values).all() if len(values) else True
    x = np.array(asked, dtype=np.uint64)
    if len(x):
        assert (held.successor(x) == np.searchsorted(values, x)).all()


def model_scores(docs, order):
    learned, grams, contexts, followers = Counter(), Counter(), Counter(), Counter()
    split = [((t or "").encode().lower().split() + [None], train) for t, train in docs]

    def history(words, i, n):
        return tuple(([0] * (n - 1) + words)[i: i + n - 1])

    for words, train in split:
        if train:
            learned.update(words)
            for n in range(2, order + 1):
                for i, w in enumerate(words):
                    followers[history(words, i, n)] += (history(words, i, n), w) not in grams
                    grams[history(words, i, n), w] += 1
                    contexts[history(words, i, n)] += 1
    total, types = sum(learned.values()), len(learned)
    out = []
    for words, _ in split:
        alone = [(learned[w] + 0.1) / (total + 0.1 * (types + 1)) for w in words]
        mixed = []
        for i, (w, p) in enumerate(zip(words, alone)):
            for n in range(2, order + 1):
                h = history(words, i, n)
                if contexts[h]:
                    p = max(grams[h, w] - 0.75, 0) / contexts[h] + 0.75 * followers[h] / contexts[h] * p
            mixed.append(p)
        out.append((len(words), sum(w in learned for w in words), total, sum(map(math.log10, alone)), sum(map(math.log10, mixed))))
    return out


@pytest.mark.parametrize(("small", "order"), [(False, 3), (True, 3), (True, 2)])
def test_language_model_equals_plain_counting(spark, monkeypatch, small, order):
    if small:
        monkeypatch.setattr(lm, "BLOCK_BYTES", 500)
        monkeypatch.setattr(lm, "SHARD_TOKENS", 64)
    rng = np.random.default_rng(2)
    texts = [" ".join(f"w{int(n)}" for n in rng.zipf(1.3, 40) if n < 10**6) for _ in range(60)]
    texts += [None, "", " \t", "The the THE", "é É ß", "same again", "same again", "long " * 20_000]
    docs = [(t, i % 4 != 0) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(i, t, train, 0.5) for i, (t, train) in enumerate(docs)], "doc_id bigint, text string, learn boolean, score double")
    got = {r.doc_id: r for r in lm.score(df, "doc_id", "text", F.col("learn"), order=order).collect()}
    for i, want in enumerate(model_scores(docs, order)):
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[:3]
        assert math.isclose(r.base_score, want[3], rel_tol=1e-9) and abs(r.score - want[4]) <= 4e-4 * r.n_tokens


def test_language_model_without_anything_learned(spark):
    df = spark.createDataFrame([(1, "a b"), (None, None), (1, "a b")], "doc_id bigint, text string")
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in lm.score(df, "doc_id", "text", F.lit(False)).collect()), key=str)
    assert got == [(1, 3, 0, 0, 0.0, 0.0), (1, 3, 0, 0, 0.0, 0.0), (None, 1, 0, 0, 0.0, 0.0)]
    assert lm.score(df.limit(0), "doc_id", "text", F.lit(True)).count() == 0


def test_word_hashes_do_not_depend_on_place(monkeypatch):
    texts = [b"Alpha beta", b"", b" \n", b"gamma  ALPHA", b"x" * 5_000 + b" beta"]
    whole, counts = shared.hashed_words(texts)
    monkeypatch.setattr(shared, "PIECE", 7)
    cut, again = shared.hashed_words(texts)
    assert counts.tolist() == again.tolist() == [2, 0, 0, 2, 2] and (whole == cut).all()
    assert whole[0] == whole[3] and whole[1] == whole[5] and len(set(whole.tolist())) == 4


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(60)]
    star = [(1_000, i) for i in range(1_001, 1_200)]
    edges = spark.createDataFrame(path + star + [(5, 5), (3, 2)], "a bigint, b bigint")
    got = {r.node: r.component for r in shared.components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 1_000 for i in range(1_000, 1_200)}}
