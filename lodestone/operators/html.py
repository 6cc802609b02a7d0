"""Text of chosen parts of HTML pages.

Flat pages are handled by regular expressions inside generated code (``flat_text``, ``flat_title``). Nested scopes
need to know where elements end; a small standard-library parser runs over Arrow batches for those (``extract``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape as unescape_text
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.text import as_col, normalize_ws

# Elements that have no end tag.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
# The entities that are resolved in regular-expression mode, the ampersand last.
ENTITIES = [
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"),
    ("&middot;", "·"), ("&amp;", "&"),
]


@dataclass(frozen=True)
class Part:
    """An element test: tag name (or any), class tokens that must all be there, and a class substring."""

    tag: str | None = None
    tokens: tuple[str, ...] = ()
    substring: str | None = None
    exact: str | None = None

    def matches(self, tag: str, classes: str) -> bool:
        if self.tag is not None and tag != self.tag:
            return False
        if self.exact is not None and classes != self.exact:
            return False
        if self.substring is not None and self.substring not in classes:
            return False
        return not self.tokens or set(self.tokens) <= set(classes.split())


@dataclass(frozen=True)
class Scope:
    """Text below nested ``path`` elements (outermost first), without what lies in an ``exclude`` element.

    ``first`` takes only the first piece of text. ``own_text`` False leaves out text directly in the last path element.
    """

    path: tuple[Part, ...]
    exclude: tuple[Part, ...] = ()
    first: bool = False
    own_text: bool = True


class _Reader(HTMLParser):
    """Collects the text pieces of each scope in one walk over a page."""

    def __init__(self, scopes: list[Scope]) -> None:
        super().__init__(convert_charrefs=True)
        self.scopes = scopes
        self.pieces: list[list[str]] = [[] for _ in scopes]
        # One entry per open element: tag, then per scope (path elements met, inside an excluded one, is the last path element).
        self.open: list[tuple[str, list[tuple[int, bool, bool]]]] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID:
            return
        classes = next((v or "" for k, v in attrs if k == "class"), "")
        above = self.open[-1][1] if self.open else [(0, False, False)] * len(self.scopes)
        state = []
        for scope, (depth, out, _) in zip(self.scopes, above):
            reached = depth < len(scope.path) and scope.path[depth].matches(tag, classes)
            out = out or any(p.matches(tag, classes) for p in scope.exclude)
            state.append((depth + reached, out, reached and depth + 1 == len(scope.path)))
        self.open.append((tag, state))

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                return

    def handle_data(self, data: str) -> None:
        if not self.open:
            return
        for scope, pieces, (depth, out, is_last) in zip(self.scopes, self.pieces, self.open[-1][1]):
            if depth == len(scope.path) and not out and (scope.own_text or not is_last):
                pieces.append(data)


def read_scopes(page: str, scopes: list[Scope]) -> list[str | None]:
    """Text of each scope, pieces joined by a space; NULL where a scope has no piece."""
    reader = _Reader(scopes)
    reader.feed(page)
    reader.close()
    return [
        (pieces[0] if scope.first else " ".join(pieces)) if pieces else None
        for scope, pieces in zip(scopes, reader.pieces)
    ]


def extract(pages: DataFrame, scopes: dict[str, Scope]) -> DataFrame:
    """``pages(url, html)`` → url and one text column per scope; each page is walked once for all scopes."""
    names, wanted = list(scopes), list(scopes.values())

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [read_scopes(page or "", wanted) for page in batch["html"]]
            out = pd.DataFrame(rows, columns=names, dtype=object)
            out.insert(0, "url", batch["url"].to_numpy())
            yield out

    schema = ", ".join(["url string"] + [f"`{n}` string" for n in names])
    return pages.select("url", "html").mapInPandas(walk, schema)


@F.pandas_udf(StringType())
def _all_entities(texts: pd.Series) -> pd.Series:
    return texts.map(unescape_text, na_action="ignore")


def unescape(c: Column) -> Column:
    """Text with its entities resolved: the common ones by replacement, and all of a text that has any other."""
    plain = c
    for entity, character in ENTITIES:
        plain = F.replace(plain, F.lit(entity), F.lit(character))
    common = "|".join(entity[1:-1] for entity, _ in ENTITIES)
    other = c.rlike(rf"&(?!(?:{common});)(?:#\d+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")
    # Only texts with other entities are handed to the parser's own table.
    return F.coalesce(_all_entities(F.when(other, c)), plain)


def drop_elements(c: Column, tags: list[str]) -> Column:
    """Remove comments and whole elements of the given names (elements that do not nest in themselves)."""
    c = F.regexp_replace(c, r"(?s)<!--.*?-->", " ")
    for tag in tags:
        c = F.regexp_replace(c, rf"(?is)<{tag}(?:\s[^>]*)?>.*?</{tag}\s*>", " ")
    return c


def strip_tags(c: Column) -> Column:
    return normalize_ws(unescape(F.regexp_replace(c, r"<[^>]*>", " ")))


def flat_text(page: Column | str, container: str, drop: tuple[str, ...] = ("script", "style", "iframe")) -> Column:
    """Text of the first ``container`` element without scripts, styles and frames; '' if there is none."""
    cleaned = drop_elements(as_col(page), list(drop))
    return strip_tags(F.regexp_extract(cleaned, rf"(?is)<{container}(?:\s[^>]*)?>(.*?)</{container}\s*>", 1))


def flat_title(page: Column | str, tag: str = "h1") -> Column:
    """Texts of all ``tag`` elements, joined by a space."""
    found = F.regexp_extract_all(as_col(page), F.lit(rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}\s*>"), F.lit(1))
    bare = F.transform(found, lambda t: F.regexp_replace(t, r"<[^>]*>", " "))
    return normalize_ws(unescape(F.array_join(bare, " ")))
