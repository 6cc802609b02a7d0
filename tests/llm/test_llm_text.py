"""Languages, licences, tokens, personal data and n-gram joins on small tables with awkward rows."""

import hashlib
import re
from pathlib import Path

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import bpe, langid, licenses, ngram_join, pii

RANKS = Path(public_tokenizers.path("byte_bpe_50k.tiktoken")).read_bytes()
AWKWARD = [None, "", "   \n\t", "a", "Ä ß 漢字 🙂", "word " * 30_000, "x" * 50_000, "same text twice", "same text twice"]


def rows(spark, texts):
    """(doc_id, text) with columns that clash with names used inside and in results."""
    return spark.createDataFrame(
        [(i, t, "k", 1.5, "n") for i, t in enumerate(texts)],
        "doc_id bigint, text string, key string, score double, component_id string",
    )


@pytest.fixture(scope="module")
def encoding():
    import base64

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, RANKS.splitlines())}
    return tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_encoding_equals_the_library_and_decodes_to_the_same_bytes(spark, encoding):
    found = bpe.encode(rows(spark, AWKWARD), "doc_id", "text", RANKS, public_tokenizers.PATTERN)
    ids = {r.key: list(r.ids) for r in found.collect()}
    assert ids == {i: encoding.encode_ordinary(t or "") for i, t in enumerate(AWKWARD)}
    back = {r.key: bytes(r.bytes) for r in bpe.decode(found, "key", "ids", RANKS, public_tokenizers.PATTERN).collect()}
    assert back == {i: (t or "").encode() for i, t in enumerate(AWKWARD)}


def test_digests_are_those_of_the_ids(spark, encoding):
    text = "It's 12 o'clock,  say we're\n\n done " * 3_000
    got = bpe.digests(rows(spark, [text]), "doc_id", "text", RANKS, public_tokenizers.PATTERN, with_ids=True).head()
    ids = encoding.encode_ordinary(text)
    assert list(got.ids) == ids and got.n_tokens == len(ids)
    assert got.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert got.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "'re", "'", " ", "  ", "\n", "b1", "é", "!?", "x" * 40]), max_size=80), st.integers(20, 90))
def test_stitched_chunks_have_the_pre_tokens_of_the_whole(parts, chunk):
    text, overlap = "".join(parts), 18
    starts = range(0, max(len(text) - overlap, 1), chunk - overlap)
    cut = [(s, text[s: s + chunk], bpe.boundaries(text[s: s + chunk], s, public_tokenizers.PATTERN)) for s in starts]
    want = [m.group() for m in bpe._compiled(public_tokenizers.PATTERN).finditer(text)]
    assert [p for p in bpe.stitched(cut, public_tokenizers.PATTERN, guard=4) if p] == want


def test_empty_tables_give_no_rows(spark):
    none = rows(spark, ["x"]).limit(0)
    assert bpe.encode(none, "doc_id", "text", RANKS, public_tokenizers.PATTERN).count() == 0
    assert licenses.scan(none, "doc_id", "text").count() == 0
    assert langid.learn(none, "doc_id", "text", "key") == []
    assert langid.identify(none, "text", []).count() == 0
    assert ngram_join.join(none, "doc_id", "text").count() == 0
    assert pii.surrogates(none, "doc_id", "text", "s").count() == 0


def test_licence_places_equal_a_plain_search(spark):
    texts = AWKWARD + [
        "Released under the MIT License. mit LICENSE mit license", "the GNU general public license", "general public general public license",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance",
        "mit-license apache_license Mit\u00a0license", "MIT license " * 5_000, "All rights reserved.",
    ]
    got = {r.key: r for r in licenses.scan(rows(spark, texts), "doc_id", "text").collect()}
    for i, t in enumerate(texts):
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
        want = sorted(
            (label, n) for label, phrase in licenses.PHRASES for n in range(len(words))
            if words[n: n + len(phrase.split())] == phrase.split()
        )
        assert sorted((p.label, p.start) for p in got[i].places) == want
        assert got[i].n_words == len(words) and 0 <= got[i].score <= 1
    assert got[len(texts) - 1].labels == ["proprietary"]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), min_size=1, max_size=8), min_size=1, max_size=4), st.lists(st.sampled_from("abcd"), max_size=20))
def test_the_automaton_holds_the_longest_matches(templates, text):
    machine = licenses.Automaton([("t", " ".join(t)) for t in templates], [])
    _, anchors = machine.matches([c.encode() for c in text])
    joined = ["".join(t) for t in templates]

    def longest(end):
        return max((n for n in range(end + 1) if any("".join(text[end - n: end]) in t for t in joined)), default=0)

    sizes = [longest(e) for e in range(len(text) + 1)]
    want = [(e - sizes[e], sizes[e]) for e in range(1, len(text) + 1) if sizes[e] and (e == len(text) or sizes[e + 1] <= sizes[e])]
    assert [(s, n) for s, n, _ in anchors] == want
    for start, n, state in anchors:
        piece = "".join(text[start: start + n])
        ends = {(i, e) for i, t in enumerate(joined) for e in range(len(t) + 1) if t[:e].endswith(piece)}
        assert set(machine.places[state]) == ends


def test_licence_templates_are_found_with_gaps_and_left_out_words(spark):
    body = dict(licenses.TEMPLATES)["isc"].split()
    text = "intro " * 10 + " ".join(body[:14]) + " inserted words " + " ".join(body[16:]) + " outro"
    got = licenses.scan(rows(spark, [text, "permission to use this copy for any purpose"]), "doc_id", "text").orderBy("key").collect()
    assert got[0].labels == ["isc"] and got[0].score > 0.8 and got[0].spans[0].first_word == 10
    assert got[1].labels == []


SPEECH = {
    "en": "the house of the king was on the hill and the people of the town went there with their children every day",
    "de": "das haus des königs stand auf dem hügel und die leute der stadt gingen jeden tag mit ihren kindern dorthin",
    "fr": "la maison du roi était sur la colline et les gens de la ville y allaient chaque jour avec leurs enfants",
}


def test_languages_are_told_apart_and_doubt_is_rejected(spark):
    learn = spark.createDataFrame(
        [(i * 3 + n, " ".join(w for j, w in enumerate(t.split() * 3) if (j * 7 + i) % 5), lang) for i in range(20) for n, (lang, t) in enumerate(SPEECH.items())]
        + [(99, "no label", None), (100, None, "en"), (101, "123", "de")], "doc_id bigint, text string, lang string")
    models = langid.learn(learn, "doc_id", "text", "lang")
    assert sorted(m[0] for m in models) == ["de", "en", "fr"]
    asked = [t.upper() + "!! 12" for t in SPEECH.values()] + AWKWARD + ["12 !?"]
    got = langid.identify(rows(spark, asked), "text", models, keep=["doc_id", "key", "score"]).orderBy("doc_id").collect()
    assert [r.lang_pred for r in got[:3]] == list(SPEECH) and not any(r.rejected for r in got[:3])
    assert all(0 <= r.score <= 1 and r.key == "k" for r in got) and len(got) == len(asked)
    for i in (3, 4, 5, len(asked) - 1):
        assert got[i].lang_pred == "und" and got[i].rejected
    assert all(r.lang_pred == "und" for r in langid.identify(rows(spark, asked), "text", []).collect())


def test_surrogates_keep_kind_format_and_identity(spark):
    texts = AWKWARD + [
        "Mail jo.doe@site.org or JO.DOE@SITE.ORG, call +1 (017) 555-7713, again +1-017-555-7713.",
        "card 4845 1681 1440 7329, 4845168114407329, order 1234567890123456", "host 97.51.17.173 and 10.0.0.7, version 2.0.1",
        "token = \"24be64439e3e49cf46b2d7c90f3602a3d0b907ff\" and PASSWORD=E3B3ED3CC8548923D6",
        "Mrs. Anna Smith and Mr John Miller met Mrs Anna Smith", "Г-жа Вера Петрова", "clean text: nothing here, 12 apples",
        "jo.doe@site.org",
    ]
    n = len(AWKWARD)
    df = rows(spark, texts)
    got = {r.doc_id: r for r in pii.surrogates(df, "doc_id", "text", "secret").collect()}
    assert [got[i].text for i in range(n)] == AWKWARD and all(not got[i].replaced for i in range(n))
    mails = re.findall(r"\S+@\S+?\.(?:org|ORG)", got[n].text)
    assert len(mails) == 2 and mails[0].upper() == mails[1] and mails[0].lower() == got[n + 7].text != "jo.doe@site.org"
    phones = re.findall(r"\+1[ -]\(?(\d{3})\)?[ -](\d{3})-(\d{4})", got[n].text)
    assert len(phones) == 2 and phones[0] == phones[1] != ("017", "555", "7713")
    grouped, plain, order = re.findall(r"\d{4}(?: ?\d{4}){3}", got[n + 1].text)
    assert grouped.replace(" ", "") == plain != "4845168114407329" and order == "1234567890123456"
    assert sum(int(c) if i % 2 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(plain)) % 10 == 0
    assert re.fullmatch(r"host \d+\.\d+\.\d+\.\d+ and 10\.\d+\.\d+\.\d+, version 2\.0\.1", got[n + 2].text) and "97.51" not in got[n + 2].text
    assert re.fullmatch(r'token = "[0-9a-f]{40}" and PASSWORD=[0-9A-F]{18}', got[n + 3].text) and "24be64" not in got[n + 3].text
    first, second = re.findall(r"Mrs\.? (\w+ \w+)", got[n + 4].text)
    assert first == second and first.split()[0] in pii.FIRST_NAMES["latin", "f"]
    assert re.search(r"Mr (\w+) ", got[n + 4].text)[1] in pii.FIRST_NAMES["latin", "m"]
    assert re.fullmatch(r"Г-жа [А-Яа-я]+ [А-Яа-я]+а", got[n + 5].text) and "Петрова" not in got[n + 5].text
    assert got[n + 6].text == texts[n + 6] and got[n].key == "k"
    again = {r.doc_id: r.text for r in pii.surrogates(df, "doc_id", "text", "secret").collect()}
    other = {r.doc_id: r.text for r in pii.surrogates(df, "doc_id", "text", "other").collect()}
    assert again == {i: r.text for i, r in got.items()} and other[n] != got[n].text


def test_cards_beside_other_digits_are_found(spark):
    card = "4111 1111 1111 1111"
    texts = [
        f"{card} 12/26", "4111-1111-1111-1111 123", "2 4111111111111111", f"2024-01-15 {card}", f"{card} 8.196.197.208", f"{card} 123",
        f"1234567890123456 {card}", "3782 822463 10005 12", "41 11 11 11 11 11 11 11", "2024-01-15 1234 5678 9012 3456, 1234567890123456",
    ]
    got = [r for r in pii.surrogates(rows(spark, texts), "doc_id", "text", "s").orderBy("doc_id").collect()]
    kinds = [[m.kind for m in r.replaced] for r in got]
    assert kinds == [["card"]] * 4 + [["card", "ip"]] + [["card"]] * 4 + [[]]
    form = r"\d{4} \d{4} \d{4} \d{4}"
    forms = [f"{form} 12/26", r"\d{4}-\d{4}-\d{4}-\d{4} 123", r"2 \d{16}", f"2024-01-15 {form}", rf"{form} \d+\.\d+\.\d+\.\d+",
             f"{form} 123", f"1234567890123456 {form}", r"\d{4} \d{6} \d{5} 12", r"\d\d(?: \d\d){7}", re.escape(texts[9])]
    for r, text, shape in zip(got, texts, forms):
        assert re.fullmatch(shape, r.text) and (r.text != text or text is texts[9])
        assert "4111" not in r.text and "196.197" not in r.text and "822463" not in r.text
    same = [re.sub("[ -]", "", re.search(r"\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}", got[i].text)[0]) for i in (0, 1, 2, 5)]
    assert len(set(same)) == 1


def test_colliding_surrogates_are_drawn_again(spark):
    mails = [f"{c}@one.org" for c in "abcdefghijklmnopqrstuvwxyz"]
    got = pii.surrogates(rows(spark, [" ".join(mails), mails[3]]), "doc_id", "text", "s").orderBy("doc_id").collect()
    new = got[0].text.split()
    assert len(set(new)) == len(mails) and not set(new) & set(mails) and got[1].text == new[3]


def brute_components(texts, n, percent):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i: i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    label = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if a and b and 100 * len(a & b) >= percent * len(a | b):
                    label[i] = label[j] = min(label[i], label[j])
    return [(len(s), x) for s, x in zip(sets, label)]


@pytest.mark.parametrize("cut", [1_500, 6])
def test_joined_documents_equal_brute_force(spark, monkeypatch, cut):
    import random

    monkeypatch.setattr(ngram_join, "CUT", cut)
    rng, texts = random.Random(5), list(AWKWARD[:5]) + ["same text twice", "same text twice", "Same\tTEXT  twice"]
    for _ in range(4):
        base = [str(rng.randrange(500)) for _ in range(60)]
        for _ in range(14):
            copy = base[:]
            for _ in range(rng.randrange(6)):
                copy[rng.randrange(60)] = "edit"
            texts.append(" ".join(copy))
    texts += [" ".join(str(rng.randrange(500)) for _ in range(60)) for _ in range(20)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(rows(spark, texts), "doc_id", "text", 3, 80).collect()}
    assert got == dict(enumerate(brute_components(texts, 3, 80)))


def test_repeated_and_missing_ids_have_a_defined_component(spark):
    df = spark.createDataFrame(
        [(1, "a b c d e f"), (1, "p q r s t u"), (2, "p q r s t u"), (3, "a b c d e f"), (None, "a b c d e f"), (4, None)],
        "doc_id bigint, text string")
    got = sorted(((r.doc_id, r.component_id) for r in ngram_join.join(df, "doc_id", "text").collect()), key=str)
    assert got == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4), (None, None)]
