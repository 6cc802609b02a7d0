"""Default prompt templates. Every operator that builds a prompt takes its template as an argument.

Fixed values: the section headers, the hole names and the "nothing found" sentence, which the parsers look for.
"""

from .text import NO_OUTPUT

READER = (
    "Answer the question from the retrieved passages below, in at most 10 words.\n\n"
    "### Context\n{context}\n\n### Question\n{question}\n\n### Answer\n"
)

EXPAND = (
    "Write one paragraph, as it could stand on a web page, that answers the question.\n\n"
    "### Question\n{question}\n\n### Paragraph\n"
)

SUMMARY = (
    "Copy at most 3 sentences of the context that help to answer the question, word for word. "
    f'If there are none, write "{NO_OUTPUT}"\n\n'
    "### Question\n{question}\n\n### Context\n>>>\n{context}\n>>>\n\n### Concisely extracted relevant parts\n"
)

QA_GENERATION = (
    "Write 2 or 3 factual questions with short answers about the context.\n"
    "Context: {context}\n\nOutput format:\n\nQ: <question>, A: <answer>."
)

TRAINING = (
    "Below is an instruction, with some context. Write a response that fulfils it.\n\n"
    "### Instruction:\n{instruction}\n\n### Context:\n{context}\n\n### Q:\n{question}\n\n### A:\n{answer}"
)

TRAINING_INSTRUCTION = "Answer the question with words of the context only."
END_OF_TEXT = "</s>"
