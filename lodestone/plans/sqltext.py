"""SQL statements built from named common table expressions."""

from __future__ import annotations

import re


class Fragments:
    """Named CTE bodies. A statement gets, in order, every fragment that it or its fragments mention."""

    def __init__(self) -> None:
        self._bodies: dict[str, str] = {}

    def add(self, name: str, body: str) -> None:
        self._bodies[name] = body

    def include(self, other: "Fragments") -> None:
        self._bodies = {**other._bodies, **self._bodies}

    def _needed(self, text: str, seen: list[str]) -> None:
        for name, body in self._bodies.items():
            if name not in seen and re.search(rf"\b{name}\b", text):
                self._needed(body, seen)
                if name not in seen:
                    seen.append(name)

    def statement(self, final: str) -> str:
        needed: list[str] = []
        self._needed(final, needed)
        if not needed:
            return final
        # Several statements read one expression more than once; it is computed once.
        ctes = ",\n".join(f"{n} AS MATERIALIZED ({self._bodies[n]})" for n in needed)
        return f"WITH {ctes}\n{final}"
