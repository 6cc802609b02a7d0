"""Quality rules, line by line first: bad lines go, then documents that lost too much of their text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from .shared import lower_ascii

# What the rules look for. White space is 0x20 and 0x09 to 0x0D.
BLANKS = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
# A line of prose ends in one of these, maybe with closing marks behind it.
TERMINAL = ".!?…。！？"
CLOSING = "\"'”’»)]"
# Marks that a tenth of a line's characters may be, and three always.
MARKS = "#*$%&|<>!?{}[]=_~^@\\"
SEPARATORS = "|»›•·→"
BOILERPLATE = (r"cookie|javascript|privacy policy|terms of (?:use|service)|all rights reserved|lorem ipsum|click here|"
               r"read more|sign (?:in|up)|log ?in|subscribe|share this|skip to (?:main )?content|powered by|© ?[12][0-9]{3}")
# Each phrase holds one of these.
BOILERPLATE_GATES = ["cookie", "javascript", "privacy", "terms of", "all rights", "lorem", "click here", "read more", "sign in",
                     "sign up", "login", "log in", "subscribe", "share this", "skip to", "powered by", "©"]

# A line without a terminal mark is kept from this many words on: it may be a sentence that was cut.
CUT_WORDS = 10
MIN_WORDS = 50
MAX_REPEATED = 50
MAX_LOSS = 30


def _count_of(text: Column, marks: str) -> Column:
    return F.char_length(text) - F.char_length(F.translate(text, marks, ""))


def _visible(text: Column) -> Column:
    return F.char_length(F.translate(text, BLANKS, ""))


def _any_of(marks: str) -> str:
    return "[" + "".join("\\" + m if m in "[]\\^&-" else m for m in marks) + "]"


def line_fault(line: Column, menus: Column, phrases: Column, loud: Column) -> Column:
    """``navigation``, ``boilerplate`` or ``punctuation`` if a line that holds a word breaks that rule, else null.

    Navigation: two or more menu separators. Boilerplate: one of the listed phrases, whatever the case of A-Z.
    Punctuation: no terminal mark at the end of a line of fewer than ``CUT_WORDS`` words, or three or more marks that are
    over a tenth of its visible characters. ``menus``, ``phrases`` and ``loud`` say whether the whole text holds what the
    first two and the last rule look for; where not, its lines are not searched for it.
    """
    last = F.right(F.rtrim(line, F.lit(BLANKS + CLOSING)), F.lit(1))
    open_end = ~(F.lit(TERMINAL).contains(last) & (last != ""))
    marks = _count_of(line, MARKS)
    return (
        F.when(menus & (_count_of(line, SEPARATORS) >= 2), "navigation")
        .when(phrases & lower_ascii(line).rlike(BOILERPLATE), "boilerplate")
        .when(loud & (marks >= 3) & (marks * 10 > _visible(line)), "punctuation")
        .when(open_end & (F.regexp_count(line, F.lit(WORD)) < CUT_WORDS), "punctuation")
    )


def repeated_words(words: Column) -> Column:
    """Words that stand in a window of three which occurs at least twice among ``words``; overlapping windows count.

    The windows are sorted by 64-bit hash inside the row, so equal ones are neighbours: time is n log n however often
    one window occurs. In a text of a million words two different windows share a hash with probability 3e-8.
    """
    def counted(w: Column) -> Column:
        places = F.when(F.size(w) >= 3, F.sequence(F.lit(0), F.size(w) - 3)).otherwise(F.array().cast("array<int>"))
        windows = F.transform(places, lambda i: F.struct(
            F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("at")))
        return let(F.sort_array(windows), covered)

    def covered(s: Column) -> Column:
        found = F.filter(s, lambda x, i: x["h"].eqNullSafe(F.get(s, i - 1)["h"]) | x["h"].eqNullSafe(F.get(s, i + 1)["h"]))
        return let(F.sort_array(F.transform(found, lambda x: x["at"])), lambda at: F.aggregate(
            F.transform(at, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - p, F.lit(3)))),
            F.lit(0), lambda total, n: total + n))

    return let(words, counted)


def clean(df: DataFrame, text: str, out: str = "quality", min_words: int = MIN_WORDS, max_repeated: int = MAX_REPEATED,
          max_loss: int = MAX_LOSS) -> DataFrame:
    """``df`` plus the struct ``out``: the counts of each text, its lines by broken rule, the cleaned text and the verdict.

    Fields: n_words, word_chars (code points in words ``[^\\x20\\x09-\\x0D]+``), n_symbols, n_dup_lines (lines between
    \\n that hold a word and equal an earlier one), n_repeat_words, n_lines (that hold a word), n_punctuation,
    n_navigation, n_boilerplate (lines removed for that), left_chars (code points in words of the lines that stay),
    cleaned (those lines and the blank ones, joined by \\n), base_failed and kept.

    ``base_failed``: fewer than ``min_words`` words, or more than ``max_repeated`` percent of them repeated.
    ``kept``: not that, and at most ``max_loss`` percent of ``word_chars`` went with the removed lines. Lines are judged
    one by one, so their order and their neighbours do not matter.

    A null text counts as no words (cleaned stays null) and an empty one as one blank line; both fail the base rule.
    Every row is judged on its own, repeated ones too. All columns stay; one named ``out`` is replaced. Only DataFrame
    functions are used and nothing is shuffled.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    names = ("punctuation", "navigation", "boilerplate")
    gates, words_of, lines_of = "_quality_gates", "_quality_words", "_quality_lines"
    while {gates, words_of, lines_of} & {c.lower() for c in df.columns}:
        gates, words_of, lines_of = gates + "_", words_of + "_", lines_of + "_"
    # What a text does not hold at all need not be counted, nor looked for in its lines.
    symbols = F.when(body.rlike(_any_of(SYMBOLS)), _count_of(body, SYMBOLS)).otherwise(0)
    phrases = let(F.lower(body), lambda low: F.greatest(*(low.contains(gate) for gate in BOILERPLATE_GATES)))
    first = F.struct(
        _visible(body).cast("bigint").alias("word_chars"), symbols.cast("bigint").alias("n_symbols"),
        body.rlike(_any_of(SEPARATORS)).alias("menus"), phrases.alias("phrases"),
        F.when(body.rlike(_any_of(MARKS)), _count_of(body, MARKS) >= 3).otherwise(False).alias("loud"))
    words = F.array_remove(F.split(body, r"[\x20\x09-\x0D]+", -1), "")
    of_words = let(words, lambda w: F.struct(F.size(w).cast("bigint").alias("n_words"), repeated_words(w).cast("bigint").alias("n_repeat_words")))
    asked = [F.col(f"{gates}.{g}") for g in ("menus", "phrases", "loud")]
    lines = F.transform(F.split(body, "\n", -1), lambda s: F.struct(
        s.alias("text"), F.when(F.btrim(s, F.lit(BLANKS)) != "", F.coalesce(line_fault(s, *asked), F.lit(""))).alias("fault")))

    def counts(rows: Column) -> Column:
        """Of (text, fault) rows; the fault is null for a line without a word and empty for one that stays."""
        with_word = F.filter(rows, lambda r: r["fault"].isNotNull())
        bad = F.filter(rows, lambda r: r["fault"] != "")
        of_fault = lambda n: F.size(F.filter(rows, lambda r: r["fault"] == n))
        return F.struct(
            F.size(with_word).cast("bigint").alias("n_lines"),
            let(F.transform(with_word, lambda r: r["text"]), lambda t: F.size(t) - F.size(F.array_distinct(t))).cast("bigint").alias("n_dup_lines"),
            *(of_fault(n).cast("bigint").alias(f"n_{n}") for n in names),
            F.aggregate(bad, F.lit(0).cast("bigint"), lambda a, r: a + _visible(r["text"])).alias("lost"),
            F.array_join(F.transform(F.filter(rows, lambda r: F.coalesce(r["fault"] == "", F.lit(True))), lambda r: r["text"]), "\n").alias("cleaned"))

    found = df.drop(out) if out.lower() != text.lower() else df
    found = found.withColumn(gates, first).withColumn(words_of, of_words).withColumn(lines_of, let(lines, counts))
    word_chars, lost = F.col(f"{gates}.word_chars"), F.col(f"{lines_of}.lost")
    n_words, repeated = F.col(f"{words_of}.n_words"), F.col(f"{words_of}.n_repeat_words")
    base_failed = (n_words < min_words) | (repeated * 100 > n_words * max_repeated)
    made = F.struct(
        n_words, word_chars, F.col(f"{gates}.n_symbols"), F.col(f"{lines_of}.n_dup_lines"), repeated, F.col(f"{lines_of}.n_lines"),
        *(F.col(f"{lines_of}.n_{n}") for n in names), (word_chars - lost).alias("left_chars"),
        F.when(F.col(text).isNotNull(), F.col(f"{lines_of}.cleaned")).alias("cleaned"),
        base_failed.alias("base_failed"), (~base_failed & (lost * 100 <= word_chars * max_loss)).alias("kept"))
    return found.withColumn(out, made).drop(gates, words_of, lines_of)
