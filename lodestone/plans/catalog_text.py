"""Registered queries of text, dates, chunks, prompts and training sets, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import tables
from .registry import Registry
from ..functions import dates, prompts, text
from ..operators import chunking, metrics, trainset
from ..operators.ranking import global_number

r = Registry()
WS = r"[\s\x0b\x1c-\x1f\x85\p{Z}]+"


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sql_render(template: str, **fields: str) -> str:
    """SQL concatenation for a template."""
    parts = []
    for literal, name, _, _ in text.Formatter().parse(template):
        if literal:
            parts.append(quoted(literal))
        if name is not None:
            parts.append(f"coalesce({fields[name]}, '')")
    return " || ".join(parts)


def ws(expression: str) -> str:
    return f"trim(regexp_replace({expression}, '{WS}', ' ', 'g'))"


# ---- scalars ---------------------------------------------------------------------------------------------------


@r.query(f"SELECT doc_id, {ws('text')} AS text FROM documents")
def whitespace_normalize(spark, sf_dir):
    return tables.documents(spark, sf_dir).select("doc_id", text.normalize_ws("text").alias("text"))


@r.query(f"""
    SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda t:
           lower(replace(regexp_replace(t, '^{WS}|{WS}$', '', 'g'), chr(9), ' '))), lambda t: length(t) > 0) AS terms
    FROM documents""")
def term_cleaning(spark, sf_dir):
    lines = F.split("text", "\n")
    return tables.documents(spark, sf_dir).select("doc_id", text.clean_terms(lines).alias("terms"))


r.fragments.add("qa", """
    SELECT q.conv_id, q.turn, q.text AS question, a.text AS answer FROM conversations q JOIN conversations a
    ON a.conv_id = q.conv_id AND a.turn = q.turn + 1 AND a.role = 'assistant' WHERE q.role = 'user'""")


@r.query(f"""SELECT conv_id, turn, {sql_render(prompts.READER, context='answer', question='question')} AS prompt,
             {sql_render(prompts.EXPAND, question='question')} AS expansion_prompt,
             {sql_render(prompts.SUMMARY, question='question', context='answer')} AS summary_prompt FROM qa""")
def prompt_render(spark, sf_dir):
    return tables.qa_pairs(spark, sf_dir).select(
        "conv_id", "turn",
        text.render(prompts.READER, context="answer", question="question").alias("prompt"),
        text.render(prompts.EXPAND, question="question").alias("expansion_prompt"),
        text.render(prompts.SUMMARY, question="question", context="answer").alias("summary_prompt"),
    )


SECTIONS = r"(?s)### Context\n(.*?)\n\n### Question\n(.*?)\n\n### Answer\n(.*)"


@r.query(f"""
    SELECT conv_id, turn, regexp_extract(echo, '{SECTIONS}', 1) AS context, regexp_extract(echo, '{SECTIONS}', 2) AS question,
           regexp_extract(echo, '{SECTIONS}', 3) AS answer
    FROM (SELECT conv_id, turn, {sql_render(prompts.READER, context='answer', question='question')} || answer AS echo FROM qa)""")
def prompt_parse(spark, sf_dir):
    prompt = text.render(prompts.READER, context="answer", question="question")
    echoed = tables.qa_pairs(spark, sf_dir).select("conv_id", "turn", F.concat(prompt, "answer").alias("echo"))
    return echoed.select("conv_id", "turn", text.parse_answer("echo").alias("p")).select("conv_id", "turn", "p.*")


@r.query(r"""
    SELECT conv_id, turn, regexp_extract(e, '(?s)### Question\n(.*?)\n\n### Paragraph\n(.*)', 1) AS question,
           regexp_extract(e, '(?s)### Question\n(.*?)\n\n### Paragraph\n(.*)', 2) AS document,
           regexp_extract(replace(s, 'No relevant context.', ''), '### Concisely extracted relevant parts\n([^\n]*)', 1) AS summary
    FROM (SELECT conv_id, turn, """ + sql_render(prompts.EXPAND, question="question") + """ || answer AS e,
          """ + sql_render(prompts.SUMMARY, question="question", context="answer") + """ || answer AS s FROM qa)""")
def expansion_and_summary_parse(spark, sf_dir):
    echoed = tables.qa_pairs(spark, sf_dir).select(
        "conv_id", "turn",
        F.concat(text.render(prompts.EXPAND, question="question"), "answer").alias("e"),
        F.concat(text.render(prompts.SUMMARY, question="question", context="answer"), "answer").alias("s"),
    )
    return echoed.select(
        "conv_id", "turn", text.parse_expansion("e").alias("p"), text.parse_summary("s").alias("summary")
    ).select("conv_id", "turn", "p.question", "p.document", "summary")


# ---- dates -----------------------------------------------------------------------------------------------------

# One written form per order, chosen by its key: the parser meets every form on every kind of date.
FORMS = ["MMMM d, yyyy", "M/d/yyyy", "d MMM yyyy", "yyyy-MM-dd", "EEEE, MMM d, yyyy"]
SQL_FORMS = ["%B %-d, %Y", "%-m/%-d/%Y", "%-d %b %Y", "%Y-%m-%d", "%A, %b %-d, %Y"]


def written_date(day, key):
    form = F.date_format(day, FORMS[0])
    for i, pattern in enumerate(FORMS[1:], start=1):
        form = F.when(key % len(FORMS) == i, F.date_format(day, pattern)).otherwise(form)
    return form


@r.query(f"""
    SELECT o_orderkey, CASE o_orderkey % 5 {' '.join(f"WHEN {i} THEN strftime(o_orderdate, '{p}')" for i, p in enumerate(SQL_FORMS))} END AS written,
           strftime(o_orderdate, '%Y-%m-%dT00:00:00') || '-0' ||
           (date_diff('hour', o_orderdate::TIMESTAMP, timezone('UTC', timezone('America/New_York', o_orderdate::TIMESTAMP))))::VARCHAR || ':00' AS iso
    FROM orders""")
def date_parse(spark, sf_dir):
    orders = tables.spread(tables.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "o_orderkey")
    written = orders.select("o_orderkey", written_date(F.col("o_orderdate"), F.col("o_orderkey")).alias("written"))
    return written.select("o_orderkey", "written", dates.parse_date("written").alias("iso"))


@r.query("SELECT event_id, strftime(ts, '%Y-%m-%d') AS term FROM events")
def date_terms(spark, sf_dir):
    """Day terms of ISO timestamps."""
    iso = F.replace(F.col("ts").cast("timestamp_ntz").cast("string"), F.lit(" "), F.lit("T"))
    return tables.table(spark, sf_dir, "events").select("event_id", dates.date_term(iso).alias("term"))


@r.query("""
    SELECT doc_id, [strftime(o_orderdate, '%Y-%m-%d'), strftime(o_orderdate, '%Y-%m-01')] AS days
    FROM documents JOIN orders ON o_orderkey = doc_id""")
def find_dates(spark, sf_dir):
    """Days found in documents into which the date of an order was written, in full and as month and year."""
    orders = tables.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), "o_orderdate")
    written = tables.documents(spark, sf_dir).join(orders, "doc_id").select(
        "doc_id",
        F.concat_ws(" ", "text", F.lit("signed"), F.date_format("o_orderdate", "MMMM d, yyyy"), F.lit("filed"),
                    F.date_format("o_orderdate", "MMM yyyy")).alias("text"),
    )
    return written.select("doc_id", dates.date_terms("text").alias("days"))


# ---- chunks ----------------------------------------------------------------------------------------------------


@r.query(f"""
    SELECT doc_id, doc_id * 1048576 + p AS chunk_id, p AS position, len(w[p * 512 + 1:(p + 1) * 512]) AS n_tokens,
           array_to_string(w[p * 512 + 1:(p + 1) * 512], ' ') AS text_content
    FROM (SELECT doc_id, w, unnest(range(0, (len(w) + 511) // 512)) AS p FROM (
        SELECT doc_id, list_filter(string_split({ws('text')}, ' '), lambda x: length(x) > 0) AS w FROM documents))""")
def chunk_documents(spark, sf_dir):
    return chunking.chunk(tables.documents(spark, sf_dir))


@r.query("""
    SELECT doc_id, md5(text) AS joined_md5, length(text) AS n_chars, true AS placed, true AS full
    FROM documents WHERE text <> ''""")
def chunk_subwords(spark, sf_dir):
    """Chunks of 512 tokens of a byte-level tokenizer: joined they are the text, each lies where it says, all but the last are full."""
    import public_tokenizers

    documents, size = tables.documents(spark, sf_dir), chunking.CHUNK_TOKENS
    chunks = chunking.chunk_subwords(documents, chunking.tokenizer_starts(public_tokenizers.path("byte_bpe_50k.json")), size)
    n_chars = F.char_length("text_content")
    parts = chunks.select("doc_id", F.struct(
        "position", "start_char", "end_char", "n_tokens", n_chars.cast("bigint").alias("n_chars"), "text_content").alias("c"))
    whole = parts.groupBy("doc_id").agg(F.sort_array(F.collect_list("c")).alias("c"))
    before = lambda i: F.when(i > 0, F.col("c")[i - 1]["end_char"]).otherwise(F.lit(0))
    placed = F.transform("c", lambda x, i: (x["position"] == i) & (x["start_char"] == before(i)) & (x["end_char"] - x["start_char"] == x["n_chars"]))
    full = F.transform("c", lambda x, i: F.when(i < F.size("c") - 1, x["n_tokens"] == size).otherwise(x["n_tokens"].between(1, size)))
    return whole.select(
        "doc_id", F.md5(F.array_join("c.text_content", "")).alias("joined_md5"),
        F.aggregate("c.n_chars", F.lit(0).cast("bigint"), lambda a, n: a + n).alias("n_chars"),
        F.forall(placed, lambda ok: ok).alias("placed"), F.forall(full, lambda ok: ok).alias("full"))


# ---- pairs and training sets -----------------------------------------------------------------------------------

r.fragments.add("generated", f"""
    SELECT conv_id, turn, 'intro <answer> Q: ' || {ws('question')} || chr(10) || 'A: ' || {ws('answer')} ||
           CASE WHEN turn % 4 = 0 THEN chr(10) || 'Q: and then? A: same line' ELSE '' END AS said FROM qa""")
r.fragments.add("parsed", """
    SELECT conv_id, turn, list_transform(list_filter(lines, lambda x: starts_with(x, 'Q:')), lambda x: trim(replace(x, 'Q:', ''))) AS questions,
           list_transform(list_filter(lines, lambda x: starts_with(x, 'A:')), lambda x: trim(replace(x, 'A:', ''))) AS answers
    FROM (SELECT conv_id, turn, list_transform(string_split(string_split(said, '<answer>')[-1], chr(10)), lambda x: trim(x)) AS lines FROM generated)""")
r.fragments.add("numbered_pairs", """
    SELECT conv_id, row_number() OVER (ORDER BY conv_id, turn, p) AS question_id, questions[p] AS question, answers[p] AS gt_answer,
           abs(len(questions) - len(answers)) AS n_dropped
    FROM (SELECT *, unnest(range(1, least(len(questions), len(answers)) + 1)) AS p FROM parsed)""")


def generated(spark, sf_dir):
    """One text per question turn in the form a pair generator writes; some have a question too many."""
    more = F.when(F.col("turn") % 4 == 0, "\nQ: and then? A: same line").otherwise("")
    said = F.concat(
        F.lit("intro <answer> Q: "), text.normalize_ws("question"), F.lit("\nA: "), text.normalize_ws("answer"), more
    )
    return tables.qa_pairs(spark, sf_dir).select("conv_id", "turn", said.alias("said"))


def numbered_pairs(spark, sf_dir):
    entries = trainset.with_qa(generated(spark, sf_dir), "said")
    return trainset.qa_pairs(entries, ["conv_id"], ["conv_id", "turn"])


@r.query("SELECT conv_id, turn, questions, answers FROM parsed")
def qa_lists_parse(spark, sf_dir):
    return trainset.with_qa(generated(spark, sf_dir), "said").drop("said")


@r.query("SELECT * FROM numbered_pairs")
def qa_pairs_parse(spark, sf_dir):
    return numbered_pairs(spark, sf_dir)


r.fragments.add("examples", """
    SELECT question_id, p.conv_id AS chunk_id, question, gt_answer AS answer, d.text AS text_content
    FROM numbered_pairs p JOIN documents d ON d.doc_id = p.conv_id""")


def examples(spark, sf_dir):
    qa = numbered_pairs(spark, sf_dir).withColumnRenamed("conv_id", "chunk_id")
    return trainset.join_context(qa, tables.chunks(spark, sf_dir))


@r.query("SELECT * FROM examples")
def qa_context_join(spark, sf_dir):
    return examples(spark, sf_dir)


r.fragments.add("formatted", "SELECT question_id, " + sql_render(
    prompts.TRAINING, instruction=quoted(prompts.TRAINING_INSTRUCTION), context="text_content", question="question",
    answer="answer",
) + f" || {quoted(prompts.END_OF_TEXT)} AS text FROM examples")


@r.query("SELECT * FROM formatted")
def train_format(spark, sf_dir):
    return trainset.format_examples(examples(spark, sf_dir)).select("question_id", "text")


r.fragments.add("placed", """
    SELECT conv_id, turn, row_number() OVER (ORDER BY md5(concat_ws(':', conv_id * 4294967296 + turn, 42)), conv_id * 4294967296 + turn) - 1 AS position,
           count(*) OVER () AS n FROM qa""")
r.fragments.add("divided", """
    SELECT conv_id, turn, CASE WHEN position < ceil(n * 0.2) THEN 'test' ELSE 'train' END AS split FROM placed""")


def pair_key():
    """One number per turn: the conversation above 32 bits, the turn below."""
    return F.shiftleft("conv_id", 32) + F.col("turn")


@r.query("SELECT conv_id, turn, split FROM divided")
def train_split(spark, sf_dir):
    return trainset.split(tables.qa_pairs(spark, sf_dir).select("conv_id", "turn"), pair_key())


@r.query("SELECT split, count(*) AS n_rows FROM divided GROUP BY split")
def split_sizes(spark, sf_dir):
    return trainset.split_sizes(train_split(spark, sf_dir))


@r.query("SELECT conv_id, turn, position FROM placed")
def train_shuffle(spark, sf_dir):
    return trainset.shuffle(tables.qa_pairs(spark, sf_dir).select("conv_id", "turn"), pair_key())


@r.query("""
    SELECT line_no, doc_id, text FROM (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS line_no, doc_id, text FROM documents)
    WHERE line_no >= 50 AND line_no < 150""")
def line_slice(spark, sf_dir):
    """A range of lines in document order, the [start, end) argument of pair generation."""
    documents = tables.documents(spark, sf_dir)
    numbered = global_number(documents.select("doc_id"), ["doc_id"], "line_no")
    return trainset.line_slice(numbered, 50, 150).join(documents, "doc_id")


# ---- answer scores ---------------------------------------------------------------------------------------------

r.fragments.add("scored_pairs", """
    SELECT conv_id * 4294967296 + turn AS pair_id,
           CASE WHEN conv_id % 3 = 0 THEN 'The ' || answer || '!' ELSE question || ' ' || answer END AS prediction,
           answer AS reference FROM qa""")


def scored_pairs(spark, sf_dir):
    """Answers with an edit of them as the prediction: an equal one up to normalisation, or one with words added."""
    edited = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("The "), "answer", F.lit("!")))
    return tables.qa_pairs(spark, sf_dir).select(
        pair_key().alias("pair_id"), edited.otherwise(F.concat_ws(" ", "question", "answer")).alias("prediction"),
        F.col("answer").alias("reference"),
    )


def sql_bags(name: str, tokens: str, fragments=r.fragments, pairs: str = "scored_pairs") -> None:
    """Fragment ``name``: common, prediction and reference counts per pair for a token expression over {c}."""
    fragments.add(f"{name}_tokens", f"""
        SELECT pair_id, 1 AS side, unnest({tokens.format(c='prediction')}) AS token FROM {pairs}
        UNION ALL SELECT pair_id, 2, unnest({tokens.format(c='reference')}) FROM {pairs}""")
    fragments.add(f"{name}_bags", f"""
        SELECT s.pair_id, coalesce(sum(least(p, r)), 0) AS m, coalesce(sum(p), 0) AS t, coalesce(sum(r), 0) AS n FROM {pairs} s LEFT JOIN (
            SELECT pair_id, token, count(*) FILTER (side = 1) AS p, count(*) FILTER (side = 2) AS r
            FROM {name}_tokens GROUP BY ALL) USING (pair_id) GROUP BY s.pair_id""")


SQUAD = (
    "list_filter(string_split(trim(regexp_replace(regexp_replace(lower({c}), '[!-/:-@\\[-`{{-~]', '', 'g'), '"
    + WS.replace("{", "{{").replace("}", "}}") + "', ' ', 'g')), ' '), lambda x: x NOT IN ('', 'a', 'an', 'the'))"
)
sql_bags("squad", SQUAD)
ROUGE = "regexp_extract_all(lower({c}), '[a-z0-9]+')"
sql_bags("rouge", ROUGE)


@r.query(f"""
    SELECT count(*) AS n_pairs, round(avg(CASE WHEN {SQUAD.format(c='prediction')} = {SQUAD.format(c='reference')} THEN 100.0 ELSE 0.0 END), 6) AS squad_exact_match,
           round(avg(CASE WHEN m > 0 THEN 200.0 * m / (t + n) ELSE 0.0 END), 6) AS squad_f1
    FROM scored_pairs JOIN squad_bags USING (pair_id)""")
def squad_metrics(spark, sf_dir):
    scores = metrics.squad(scored_pairs(spark, sf_dir))
    return scores.select("n_pairs", *[F.round(c, 6).alias(c) for c in ("squad_exact_match", "squad_f1")])


@r.query("""SELECT count(*) AS n_pairs, round(avg(CASE WHEN m > 0 THEN 2.0 * m / (t + n) ELSE 0.0 END), 6) AS rouge1 FROM rouge_bags""")
def rouge1(spark, sf_dir):
    return metrics.rouge1(scored_pairs(spark, sf_dir)).withColumn("rouge1", F.round("rouge1", 6))


def sql_bleu_tokens() -> str:
    expression = "{c}"
    for pattern, replacement in metrics.BLEU_RULES:
        escaped = pattern.replace("{", "{{").replace("}", "}}").replace("\n", "\\n")
        target = replacement.replace("$", "\\")
        expression = f"regexp_replace({expression}, {quoted(escaped)}, {quoted(target)}, 'g')"
    return f"list_filter(string_split(trim(regexp_replace({expression}, '" + WS.replace("{", "{{").replace("}", "}}") + "', ' ', 'g')), ' '), lambda x: x <> '')"


BLEU = sql_bleu_tokens()
sql_bags("bleu", BLEU)


@r.query("""
    SELECT count(*) AS n_pairs, round((sum(m) + 1.0) / (sum(t) + 1.0) *
           CASE WHEN sum(t) > sum(n) THEN 1.0 ELSE exp(1 - sum(n)::DOUBLE / sum(t)) END, 6) AS bleu1 FROM bleu_bags""")
def bleu1(spark, sf_dir):
    return metrics.bleu1(scored_pairs(spark, sf_dir)).withColumn("bleu1", F.round("bleu1", 6))
