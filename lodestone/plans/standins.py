"""Deterministic callables in the place of models, for tests and registered queries. They obey the prompts' formats."""

from __future__ import annotations

import hashlib

import numpy as np
import regex

WORD = regex.compile(r"\p{L}+")


def best_line(text: str, question: str) -> str:
    """The line of the whole text that shares most distinct words with the question, the first of equal ones."""
    asked = set(WORD.findall(question.lower()))
    return max(text.split("\n"), key=lambda line: len(asked.intersection(WORD.findall(line.lower()))))


def echo_reader():
    """Echoes the prompt and answers with the best line of the whole context, its white space normalised."""

    def read(batch: list[str]) -> list[str]:
        out = []
        for prompt in batch:
            context, rest = prompt.split("### Context\n", 1)[1].split("\n\n### Question\n", 1)
            out.append(prompt + " ".join(best_line(context, rest.rsplit("\n\n### Answer\n", 1)[0]).split()))
        return out

    return read


def echo_expander():
    """Echoes an expansion prompt and repeats the question as the paragraph."""

    def write(batch: list[str]) -> list[str]:
        return [p + p.split("### Question\n", 1)[1].split("\n\n### Paragraph\n", 1)[0] for p in batch]

    return write


def line_summarizer():
    """Echoes a summary prompt and copies the best line of the whole context; answers an expansion prompt like the expander."""

    def write(batch: list[str]) -> list[str]:
        expand = echo_expander()
        out = []
        for p in batch:
            if "### Paragraph\n" in p:
                out.extend(expand([p]))
            else:
                question, context = p.split("### Question\n", 1)[1].split("\n\n### Context\n>>>\n", 1)
                out.append(p + best_line(context.rsplit("\n>>>", 1)[0], question))
        return out

    return write


def context_encoder(dim: int = 64):
    """Encoder of texts: a token's vector has 1 at the bucket of the token and 1/2 at that of the token before it."""

    def build():
        def encode(texts: list[str]) -> list[tuple[list[str], np.ndarray]]:
            out = []
            for text in texts:
                tokens = [t for t in text.split(" ") if t]
                buckets = [int(hashlib.md5(t.encode()).hexdigest()[:8], 16) % dim for t in tokens]
                x = np.zeros((len(tokens), dim))
                for i, b in enumerate(buckets):
                    x[i, b] += 1.0
                    if i:
                        x[i, buckets[i - 1]] += 0.5
                out.append((tokens, x))
            return out

        return encode

    return build


def qa_writer():
    """Writes one question and answer about the context of a pair generation prompt."""

    def write(batch: list[str]) -> list[str]:
        out = []
        for p in batch:
            context = p.split("Context: ", 1)[1].rsplit("\n\nOutput format:", 1)[0].split()
            out.append(p + f"\nQ: what follows {' '.join(context[:3])}?\nA: {' '.join(context[3:6])}")
        return out

    return write
