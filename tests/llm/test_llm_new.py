"""Alignment of tokenizers, ranked lexical search and quality rules against plain counting, and awkward rows."""

import hashlib
import json
import math
import random
import re
import time
from collections import Counter, defaultdict
from pathlib import Path

import public_tokenizers
import pytest

import corpus_pipeline
from lodestone.llm import align, lexical, ngram_join, pii, quality
from lodestone.llm.queries import _byte_bpe as load_a, _piece_bpe as load_b

TEXTS = ["The quick brown fox", "", None, "naïve  café\n\tdéjà vu 漢字 ½ x²", "<s> <|endoftext|> <0x0A> ▁", "a", "The quick brown fox",
         "it's 'tis we'll\x85 \x1c end", "word " * 400]


def docs(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id bigint, text string, row string")


def plain_alignment(texts):
    """The expected rows by walking over both token lists."""
    (encode_a, bytes_a), (encode_b, bytes_b) = load_a(), load_b()
    links, out, count = [], [], Counter()
    for t in texts:
        a, b = (encode([t])[0] if t else [] for encode in (encode_a, encode_b))
        whole = b" " + (t or "").encode()
        if not t or b"".join(bytes_a[i] for i in a) != whole or b"".join(bytes_b[i] for i in b) != whole:
            a, b = [], []
        spans = []
        for ids, pieces in ((a, bytes_a), (b, bytes_b)):
            at, mine = 0, []
            for i in ids:
                mine.append((at, at + len(pieces[i]), i))
                at += len(pieces[i])
            spans.append(mine)
        mine = [(i, j) for s, e, i in spans[0] for u, v, j in spans[1] if s < v and u < e]
        ends = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        cut = [[",".join(str(i) for s, e, i in side if low < e <= high) for side in spans] for low, high in zip([0, *ends], ends)]
        links.append(mine)
        count.update(set(mine))
        out.append([len(a), len(b), len(ends), len(mine), ";".join("|".join(g) for g in cut)])
    best = defaultdict(int)
    for (i, _), n in count.items():
        best[i] = max(best[i], n)
    return [(*o[:4], sum(count[x] == best[x[0]] for x in m), sum(count[x] for x in m), o[4]) for o, m in zip(out, links)]


@pytest.mark.parametrize("few", [10 ** 6, 0])
def test_alignment_equals_a_walk_over_both_sides(spark, monkeypatch, few):
    monkeypatch.setattr(align, "BROADCAST_ROWS", few)
    monkeypatch.setattr(align, "HOT_SHARE", 20)
    fields = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups")
    got = {r.doc_id: tuple(r[f] for f in fields) for r in align.align(docs(spark), "doc_id", "text", load_a, load_b).collect()}
    assert [got[i] for i in range(len(TEXTS))] == plain_alignment(TEXTS)
    digests = align.align(docs(spark), "doc_id", "text", load_a, load_b, digest=True).collect()
    assert {r.doc_id: r.groups for r in digests} == {i: hashlib.sha256(g[-1].encode()).hexdigest() if g[-1] else "" for i, g in got.items()}


def test_ids_are_the_tokenizers_own(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    whole.encode_special_tokens = True
    texts = [t for t in TEXTS if t] + ["İſK x​ y　z ᠎﻿", "\U0001F600👍🏽 \U00010400 ১২৩ ⅷ _a_ 1_000"]
    assert load_a()[0](texts) == [e.ids for e in whole.encode_batch([" " + t for t in texts], add_special_tokens=False)]


def library(path):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(str(path))
    whole.encode_special_tokens = True
    return whole, lambda texts: [e.ids for e in whole.encode_batch([" " + t for t in texts], add_special_tokens=False)]


def test_ids_are_found_in_less_than_half_the_librarys_time():
    (_, own), encode = library(public_tokenizers.path("byte_bpe_50k.json")), load_a()[0]
    pick = random.Random(1)
    texts = ["".join(pick.choices("etaoinshrdlu  ,.\n", k=2_000)) for _ in range(200)]
    times = []
    for each in (own, encode):
        start = time.process_time()
        times.append((each(texts), time.process_time() - start))
    assert times[0][0] == times[1][0]
    assert times[1][1] < times[0][1] / 2


def test_every_character_is_cut_as_the_library_cuts_it():
    import tiktoken

    cut, single = library(public_tokenizers.path("byte_bpe_50k.json"))[0].pre_tokenizer, {bytes([i]): i for i in range(256)}
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    joined = {}
    for before in "a1!":  # a character goes on with one of its own kind
        starts = {s for _, (s, _) in cut.pre_tokenize_str("".join(before + c for c in every))}
        joined[before] = {c for i, c in enumerate(every) if 2 * i + 1 not in starts}
    rest = set(every) - joined["a"] - joined["1"] - joined["!"]
    for kind, expected in ((r"\p{L}", joined["a"]), (r"\p{N}", joined["1"]), (r"\s", rest)):
        found = tiktoken.Encoding("kind", pat_str=kind, mergeable_ranks=single, special_tokens={})
        assert set(bytes(found.encode_ordinary(every)).decode()) == expected


def test_mixed_texts_and_long_blanks_have_the_librarys_ids():
    (_, own), encode = library(public_tokenizers.path("byte_bpe_50k.json")), load_a()[0]
    pick = random.Random(2)
    kinds = "aZ é漢字1½ⅷ٣'strevdml!_=-\u0301\u200b\U0001F600\t\n\r\x0b\x1c\x85\xa0\u2003\u3000   "
    mixed = ["".join(pick.choices(kinds, k=pick.randint(1, 40))) for _ in range(5_000)]
    blanks = ["x" + c * n + "y" for c in " \n\u3000" for n in (align.BLANKS - 1, align.BLANKS, 1_200_000)]
    for texts in (mixed, blanks):
        assert encode(texts) == own(texts)


@pytest.mark.parametrize("change", [
    lambda spec: spec["model"]["merges"].insert(0, spec["model"]["merges"].pop(700)),  # ids no longer rise with the merges
    lambda spec: spec["model"].update(ignore_merges=True),
    lambda spec: spec.update(normalizer={"type": "Lowercase"}),
    lambda spec: spec["pre_tokenizer"].update(use_regex=False),
    lambda spec: spec["added_tokens"][0].update(special=False),
])
def test_other_files_are_left_to_the_library(tmp_path, change):
    spec = json.loads(Path(public_tokenizers.path("byte_bpe_50k.json")).read_text())
    change(spec)
    (tmp_path / "t.json").write_text(json.dumps(spec))
    encode = align.byte_level(str(tmp_path / "t.json"))[0]
    assert encode.__name__ == "own" and load_a()[0].__name__ == "encode"
    texts = [t for t in TEXTS if t]
    assert encode(texts) == library(tmp_path / "t.json")[1](texts)


def test_alignment_of_nothing_and_of_other_keys(spark):
    none = spark.createDataFrame([], "doc_id string, text string")
    assert align.align(none, "doc_id", "text", load_a, load_b).count() == 0
    named = spark.createDataFrame([("x", "ab"), (None, "ab")], "doc_id string, text string")
    assert sorted(r.count_sum for r in align.align(named, "doc_id", "text", load_a, load_b).collect())[0] > 0


def plain_search(items, rows, k):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    held = [(d, Counter(terms(t))) for d, t in rows if terms(t)]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(w for _, c in held for w in c)
    asked = defaultdict(set)
    for i, t in items:
        if i is not None:
            asked[i] |= set(terms(t))
    out = []
    for i, words in asked.items():
        scored = []
        for d, c in held:
            m = 10 + 90 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10 ** 9 * c[w] // (1000 * c[w] + 8 * m)) for w in words if c[w])
            if s > 0 and d is not None:
                scored.append((-s, d))
        out += [(i, r + 1, d, -s) for r, (s, d) in enumerate(sorted(scored)[:k])]
    return sorted(out)


@pytest.mark.parametrize("block, bundle", [(7, 2), (4_096, 256)])
def test_search_equals_plain_scores(spark, monkeypatch, block, bundle):
    import random

    monkeypatch.setattr(lexical, "BLOCK", block)
    monkeypatch.setattr(lexical, "BUNDLE", bundle)
    r = random.Random(3)
    words = [f"w{i}" for i in range(40)] + ["É", "the"] * 10
    rows = [(i % 70, " ".join(r.choices(words, k=r.randrange(0, 30)))) for i in range(80)] + [(200 + i, "same copy w1 w2") for i in range(30)]
    rows += [(None, "w1 w2 w3"), (300, None), (301, "The the THE")]
    items = [(i, " ".join(r.choices(words, k=6))) for i in range(5)] + [(5, None), (6, "nowhere"), (0, "w7"), (None, "w1"), (7, "copy, w1!")]
    found = lexical.search(spark.createDataFrame(items, "item_id int, text string"), "item_id", "text",
                           spark.createDataFrame(rows, "doc_id bigint, text string"), "doc_id", "text", k=4)
    assert sorted(map(tuple, found.collect())) == plain_search(items, rows, 4)


def test_search_without_items_or_documents(spark):
    none = spark.createDataFrame([], "id bigint, text string")
    some = spark.createDataFrame([(1, "a b")], "id bigint, text string")
    assert lexical.search(none, "id", "text", some, "id", "text").count() == 0
    assert lexical.search(some, "id", "text", none, "id", "text").count() == 0


def repeated(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen = Counter(zip(words, words[1:], words[2:]))
    return len({i + j for i in range(len(words) - 2) if seen[tuple(words[i:i + 3])] > 1 for j in range(3)})


def test_quality_counts_and_lines(spark):
    prose = "This is a line of plain prose that ends as it should.\n" * 2 + "\n".join(f"alpha{i} beta{i} gamma{i} delta{i}." for i in range(20))
    texts = [None, "", "\n \n", prose, "a a a a", "Home | About | Shop\n" + prose, "Please accept every Cookie here.\n" + prose,
             "A$$$ b### c%%%\n" + prose, "short\n" + prose, "junk ### $$$\n" * 40, "x" * 10 + " ß　y"]
    df = spark.createDataFrame([(i, t, "q") for i, t in enumerate(texts)], "doc_id bigint, text string, quality string")
    got = {r.doc_id: r.quality for r in quality.clean(df, "text").collect()}
    for i, t in enumerate(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        lines = [x for x in (t or "").split("\n") if x.strip(" \t\n\x0b\f\r")]
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), repeated(t), len(lines))
        q = got[i]
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words, q.n_lines) == want, t
        assert q.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
    assert got[3].kept and got[3].cleaned == prose
    assert [got[i].n_navigation for i in (5, 6)] == [1, 0] and [got[i].n_boilerplate for i in (5, 6)] == [0, 1]
    assert got[7].n_punctuation == got[8].n_punctuation == 1 and got[5].cleaned == prose and not got[9].kept and got[0].cleaned is None
    assert quality.clean(df.limit(0), "text").count() == 0


def test_every_set_of_a_repeated_key_is_linked(spark):
    base = [" ".join(f"{c}{i}" for i in range(60)) for c in "xy"]
    near = [t.replace(f"{c}59", "other") for c, t in zip("xy", base)]
    df = spark.createDataFrame([(1, base[0]), (1, base[1]), (5, near[0]), (6, near[1]), (7, "far away")], "doc_id bigint, text string")
    got = {(r.doc_id, r.component_id) for r in ngram_join.join(df, "doc_id", "text", words=3, percent=90).collect()}
    assert got == {(1, 1), (5, 1), (6, 1), (7, 7)}


def test_the_pipeline_drops_only_copies_of_a_repeated_id(spark):
    one, two = (" ".join(f"{c}{i}" for i in range(40)) for c in "xy")
    rows = [(1, one, "en", "a", 9), (1, two, "en", "b", 9), (1, two, "en", "a", 9), (3, two, "en", "a", 9), (4, one + " z", "en", "a", 9),
            (None, one, "en", "a", 9)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = corpus_pipeline.distinct_texts(spark, df, "").collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == [(0, one), (1, one), (1, two)]


def test_surrogates_have_no_dead_end(spark):
    texts = ["login password=****** please", "token: ------", "Dr Anna Petrova and Frau Anna Petrova", "Dr Ελένη Παπά", "token=漢字漢字漢字",
             "Г-н Иван Петров"] + [f"host 192.168.{i // 256}.{i % 256}" for i in range(65_536)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = [r.text for r in pii.surrogates(df, "doc_id", "text", "s").orderBy("doc_id").collect()]
    assert got[:2] == texts[:2]
    first, second = re.findall(r"(?:Dr|Frau) (\w+ \w+)", got[2])
    assert first == second and first.split()[0] in pii.FIRST_NAMES["latin", "f"]
    assert re.fullmatch(r"Dr [Ͱ-Ͽ]+ [Ͱ-Ͽ]+", got[3]) and re.fullmatch(r"token=[一-仿]{6}", got[4])
    assert re.fullmatch(r"Г-н [а-яА-Я]+ [а-яА-Я]+", got[5])
    assert len(set(got[6:])) == 65_536 and all(re.fullmatch(r"host 192\.168\.\d+\.\d+", t) for t in got[6:])
