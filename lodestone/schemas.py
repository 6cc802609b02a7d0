"""Row types of the files the engine reads and writes."""

from pyspark.sql import types as T

_STRINGS = T.ArrayType(T.StringType())

PAGE = T.StructType([
    T.StructField("url", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("date_accessed", T.StringType()),
    T.StructField("text_content", T.StringType()),
    T.StructField("associated_dates", _STRINGS),
])

ENTITY = T.StructType([T.StructField("entity", T.StringType())])

# Ids may be quoted in the files, so they are read as text and cast. Text may be one string or a list of strings;
# JSON lists arrive in a string column as their JSON form (see sources.records.read_contexts).
CONTEXT_FILE = T.StructType([
    T.StructField("chunk_id", T.StringType()),
    T.StructField("source_id", T.StringType()),
    T.StructField("source_name", T.StringType()),
    T.StructField("text_content", T.StringType()),
    T.StructField("associated_dates", _STRINGS),
    T.StructField("extracted_entities", T.ArrayType(ENTITY)),
    T.StructField("extracted_dates", _STRINGS),
])

QUESTION_FILE = T.StructType([
    T.StructField("question_id", T.StringType()),
    T.StructField("chunk_id", T.StringType()),
    T.StructField("question", T.StringType()),
    T.StructField("gt_answer", T.StringType()),
])

ANSWER = T.StructType([
    T.StructField("question_id", T.LongType()),
    T.StructField("gt_chunk_id", T.LongType()),
    T.StructField("question", T.StringType()),
    T.StructField("gt_answer", T.StringType()),
    T.StructField("retrieved_chunk_ids", T.ArrayType(T.LongType())),
    T.StructField("raw_output", T.StringType()),
    T.StructField("retrieved_context", T.StringType()),
    T.StructField("generated_answer", T.StringType()),
])

QA_PAIR = T.StructType([
    T.StructField("source_id", T.StringType()),
    T.StructField("chunk_id", T.LongType()),
    T.StructField("source_name", T.StringType()),
    T.StructField("question_id", T.LongType()),
    T.StructField("question", T.StringType()),
    T.StructField("gt_answer", T.StringType()),
])

TRAINING_EXAMPLE = T.StructType([
    T.StructField("question", T.StringType()),
    T.StructField("answer", T.StringType()),
    T.StructField("text_content", T.StringType()),
])
