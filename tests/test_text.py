import pytest
from pyspark.sql import functions as F

from lodestone.functions import prompts, text


def test_whitespace_of_lists(one):
    assert one(text.normalize_list("t"), t=["  a \n b ", "", " c"]) == "a b c"


@pytest.mark.parametrize("raw, clean", [("a  b\x1c c", "a b c"), ("\t x\r\n", "x"), ("", "")])
def test_whitespace_of_every_kind(one, raw, clean):
    assert one(text.normalize_ws("t"), t=raw) == clean


def test_strip_keeps_the_inside(one):
    assert one(text.strip("t"), t="\n a  b ") == "a  b"


def test_join_leaves_out_empty_parts(one):
    assert one(text.join_nonempty("a", "b", "c"), a="x", b="", c="y") == "x y"


def test_terms(one):
    assert one(text.clean_terms("t"), t=[" New\tYork ", "", "\t"]) == ["new york"]


def test_run_counts(one):
    rows = one(text.run_counts(F.col("t"), "term", "tf"), t=["b", "a", "b", "c", "b"])
    assert [tuple(r) for r in rows] == [("a", 1), ("b", 3), ("c", 1)]
    assert one(text.run_counts(F.col("t"), "term", "tf"), t=[]) == []


def test_render_fills_and_guards(one):
    assert one(text.render("Q {q} / {{x}} {q}", q="a"), a="hi") == "Q hi / {x} hi"
    with pytest.raises(KeyError):
        text.render("{missing}", q="a")


def test_render_null_is_empty(spark):
    row = spark.createDataFrame([(None,)], "a string").select(text.render("<{a}>", a="a")).head()
    assert row[0] == "<>"


def test_reader_parse_takes_a_multi_line_answer(one):
    echo = "intro\n### Context\nc1\n\nc2\n\n### Question\nwho?\n\n### Answer\nline 1\nline 2"
    assert one(text.parse_answer("t"), t=echo).asDict() == {"context": "c1\n\nc2", "question": "who?", "answer": "line 1\nline 2"}


def test_reader_parse_without_headers(one):
    assert tuple(one(text.parse_answer("t"), t="nothing here")) == ("", "", "")


def test_expansion_parse(one):
    assert tuple(one(text.parse_expansion("t"), t="x\n### Question\nq\n\n### Paragraph\np1\np2")) == ("q", "p1\np2")


def test_summary_is_one_line(one):
    head = "### Concisely extracted relevant parts\n"
    assert one(text.parse_summary("t"), t=f"a\n{head}first\nsecond") == "first"
    assert one(text.parse_summary("t"), t=f"a\n{head}No relevant context.") == ""
    # The dot matches any character.
    assert one(text.parse_summary("t"), t=f"a\n{head}No relevant context!x") == "x"
    assert one(text.parse_summary("t"), t="no header") == ""


def test_qa_lines(one):
    parsed = one(text.parse_qa_pairs("t"), t=" Q: one?\nA: 1\nQ: two? Q: again\nnoise\nA: 2\nQ: three?")
    assert parsed["questions"] == ["one?", "two?  again", "three?"] and parsed["answers"] == ["1", "2"]
    both = one(text.parse_qa_pairs("t"), t="Q: x A: y")
    assert both["questions"] == ["x A: y"] and both["answers"] == []


def test_last_section(one):
    assert one(text.last_section("t"), t="a <answer> b <answer> c ") == "c"
    assert one(text.last_section("t"), t=" plain ") == "plain"


def test_sentences(one):
    assert one(text.sentences("t"), t="One  two. Three!\nFour?\n \n") == ["One two.", "Three!", "Four?"]


def test_default_prompts_fit_the_parsers(one):
    echo = F.concat(text.render(prompts.READER, context="c", question="q"), F.lit("yes"))
    assert tuple(one(text.parse_answer(echo), c="ctx", q="who")) == ("ctx", "who", "yes")
