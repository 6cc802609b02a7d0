"""Whitespace, templates and the parsers of model output, as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space plus the ASCII separators, written so that Java and RE2 read it alike.
WS = r"[\s\x0b\x1c-\x1f\x85\p{Z}]+"
WORD = r"\p{L}+"

NO_OUTPUT = "No relevant context."


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, where a plain expression would repeat it at every use.

    Above all for values used inside the lambdas of array functions, which would compute them for every element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def run_counts(values: Column, value: str, count: str) -> Column:
    """Array of (value, count) structs, one per distinct value of an array, in value order.

    Counts inside the row, from the places where a new value starts in the sorted array; nothing is shuffled.
    """

    def runs(s: Column) -> Column:
        starts = F.filter(F.transform(s, lambda _, i: i), lambda i: ~F.get(s, i).eqNullSafe(F.get(s, i - 1)))
        return let(starts, lambda at: F.transform(at, lambda i, n: F.struct(
            F.get(s, i).alias(value), (F.coalesce(F.get(at, n + 1), F.size(s)) - i).cast("bigint").alias(count)
        )))

    return let(F.sort_array(values), runs)


def strip(c: Column | str) -> Column:
    """Remove white space of any kind at both ends (SQL ``trim`` removes spaces only)."""
    return F.regexp_replace(as_col(c), f"^{WS}|{WS}$", "")


def normalize_ws(c: Column | str) -> Column:
    """Collapse every run of white space to one space and strip the ends."""
    return F.trim(F.regexp_replace(as_col(c), WS, " "))


def join_nonempty(*parts: Column | str) -> Column:
    """Join the non-empty parts by one space."""
    return F.concat_ws(" ", *[F.nullif(as_col(p), F.lit("")) for p in parts])


def normalize_list(c: Column | str) -> Column:
    """Normalise each string of an array, drop the empty ones, join by a space."""
    cleaned = F.filter(F.transform(as_col(c), normalize_ws), lambda x: F.length(x) > 0)
    return F.array_join(cleaned, " ")


def words(c: Column | str) -> Column:
    """Lower-cased runs of letters."""
    return F.regexp_extract_all(F.lower(as_col(c)), F.lit(WORD), F.lit(0))


def tokens(c: Column | str) -> Column:
    """White-space tokens; empty text has none."""
    return F.filter(F.split(normalize_ws(c), " "), lambda t: F.length(t) > 0)


def sentences(c: Column | str) -> Column:
    """Runs that end in ``.``, ``!``, ``?`` or a line break, stripped, without empty ones."""
    parts = F.regexp_extract_all(as_col(c), F.lit(r"[^.!?\n]+[.!?]*"), F.lit(0))
    return F.filter(F.transform(parts, normalize_ws), lambda s: F.length(s) > 0)


def clean_terms(c: Column | str) -> Column:
    """Terms of the sparse index: stripped, tabs to spaces, lower-cased, non-empty."""
    return F.filter(
        F.transform(as_col(c), lambda t: F.lower(F.translate(strip(t), "\t", " "))),
        lambda t: F.length(t) > 0,
    )


def coerce_text(c: Column | str) -> Column:
    """A list of strings becomes one space-joined string."""
    return F.array_join(as_col(c), " ")


def render(template: str, **fields: Column | str) -> Column:
    """Fill ``{name}`` holes with columns. The template is split once, while the plan is built; NULL fills as ''."""
    parts: list[Column] = []
    for literal, name, _, _ in Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if name is not None:
            if name not in fields:
                raise KeyError(f"no column given for {{{name}}}")
            parts.append(F.coalesce(as_col(fields[name]).cast("string"), F.lit("")))
    return F.concat(*parts) if parts else F.lit("")


def parse_sections(c: Column | str, headers: list[tuple[str, str]]) -> Column:
    """Struct of the texts below consecutive ``header`` lines; all are '' unless every header is there in order.

    ``headers`` holds (field, header line). Each section but the last ends at a blank line before the next header.
    """
    pattern = "(?s)" + "\n\n".join(f"{header}\n(.*?)" for _, header in headers[:-1])
    pattern += ("\n\n" if len(headers) > 1 else "") + f"{headers[-1][1]}\n(.*)"
    text = as_col(c)
    return F.struct(*[
        F.regexp_extract(text, pattern, i).alias(name) for i, (name, _) in enumerate(headers, start=1)
    ])


def parse_answer(c: Column | str) -> Column:
    """context, question and answer out of the reader's echo."""
    return parse_sections(c, [("context", "### Context"), ("question", "### Question"), ("answer", "### Answer")])


def parse_expansion(c: Column | str) -> Column:
    """question and document out of the query expander's echo."""
    return parse_sections(c, [("question", "### Question"), ("document", "### Paragraph")])


def parse_summary(c: Column | str) -> Column:
    """The single line below the summary header, after the "nothing found" text was removed."""
    text = F.regexp_replace(as_col(c), NO_OUTPUT, "")
    return F.regexp_extract(text, "### Concisely extracted relevant parts\n([^\n]*)", 1)


def last_section(c: Column | str, marker: str = "<answer>") -> Column:
    """Stripped text after the last marker (the whole text if there is none)."""
    return strip(F.substring_index(as_col(c), marker, -1))


def parse_qa_pairs(c: Column | str) -> Column:
    """Struct of ``questions`` and ``answers``: lines that start with ``Q:`` or ``A:``, markers removed."""

    def marked(lines: Column, marker: str) -> Column:
        kept = F.filter(lines, lambda line: F.startswith(line, F.lit(marker)))
        return F.transform(kept, lambda line: strip(F.replace(line, F.lit(marker), F.lit(""))))

    return let(
        F.transform(F.split(as_col(c), "\n"), strip),
        lambda lines: F.struct(marked(lines, "Q:").alias("questions"), marked(lines, "A:").alias("answers")),
    )
