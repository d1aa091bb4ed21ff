"""The full-text query language, from a string to a tree.

Words next to each other must all match; ``AND``, ``OR`` and ``NOT`` (upper case; NOT takes two sides) combine, binding from
tightest: words side by side, NOT, AND, OR. Parentheses group. ``"a b"``, ``a + b`` and words of several tokens are phrases,
``fox*`` is a prefix, ``^fox`` stands at the start, ``NEAR(a b, 5)`` asks for at most five tokens between. A hyphen is white
space. ``column:`` and ``{columns}:`` may name the one text column.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field

COLUMNS = ("text_content",)
NEAR_DEFAULT = 10


class QuerySyntaxError(ValueError):
    """The query isn't well formed."""


@dataclass(frozen=True)
class Phrase:
    """Tokens one after another; the last may be a prefix, the first may have to stand at the start."""

    tokens: tuple[str, ...]
    prefix: bool = False
    initial: bool = False


@dataclass(frozen=True)
class Near:
    phrases: tuple[Phrase, ...]
    distance: int


@dataclass(frozen=True)
class Combined:
    """``op`` is and, or, not; ``not`` has two parts."""

    op: str
    parts: tuple


@dataclass
class _Lexer:
    text: str
    tokens: list[tuple[str, str]] = field(default_factory=list)

    WORD = re.compile(r"[A-Za-z0-9_\x1a\u0080-\U0010ffff]+")

    def run(self) -> list[tuple[str, str]]:
        i, s = 0, self.text
        while i < len(s):
            c = s[i]
            if c in " \t\n\r":
                i += 1
            elif c == '"':
                j, out = i + 1, ""
                while True:
                    if j >= len(s):
                        raise QuerySyntaxError("unterminated string")
                    if s[j] == '"':
                        if s[j + 1 : j + 2] == '"':
                            out, j = out + '"', j + 2
                            continue
                        break
                    out, j = out + s[j], j + 1
                self.tokens.append(("string", out))
                i = j + 1
            elif c in "(){}:,+*^":
                self.tokens.append((c, c))
                i += 1
            elif m := self.WORD.match(s, i):
                word = m[0]
                self.tokens.append((word, word) if word in ("AND", "OR", "NOT") else ("word", word))
                i = m.end()
            else:
                raise QuerySyntaxError(f'syntax error near "{c}"')
        self.tokens.append(("end", ""))
        return self.tokens


def tokenize(text: str) -> list[str]:
    """The tokens of a query's word, folded like the indexed text."""
    plain = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))
    return [t for t in re.findall(r"[^\W_]+", unicodedata.normalize("NFC", plain))]


def sanitize(query: str) -> str:
    return query.replace("-", " ")


class _Parser:
    def __init__(self, text: str):
        self.tokens = _Lexer(text).run()
        self.at = 0

    def peek(self, ahead: int = 0) -> str:
        return self.tokens[min(self.at + ahead, len(self.tokens) - 1)][0]

    def take(self, kind: str) -> str:
        if self.peek() != kind:
            raise QuerySyntaxError(f'syntax error near "{self.tokens[self.at][1]}"')
        self.at += 1
        return self.tokens[self.at - 1][1]

    def query(self):
        if self.peek() == "end":
            raise QuerySyntaxError("empty query")
        out = self.either()
        self.take("end")
        return out

    def either(self):
        return self._chain("OR", "or", self.all_of)

    def all_of(self):
        return self._chain("AND", "and", self.without)

    def _chain(self, mark: str, op: str, below):
        parts = [below()]
        while self.peek() == mark:
            self.at += 1
            parts.append(below())
        return parts[0] if len(parts) == 1 else Combined(op, tuple(parts))

    def without(self):
        out = self.side_by_side()
        while self.peek() == "NOT":
            self.at += 1
            out = Combined("not", (out, self.side_by_side()))
        return out

    def side_by_side(self):
        if self._column_filter():
            return self.group() if self.peek() == "(" else self._words()
        return self.group() if self.peek() == "(" else self._words()

    def group(self):
        self.take("(")
        out = self.either()
        self.take(")")
        return out

    def _column_filter(self) -> bool:
        start = self.at
        if self.peek() == "{":
            self.at += 1
            names = []
            while self.peek() in ("word", "string"):
                names.append(self.take(self.peek()))
            self.take("}")
            self.take(":")
        elif self.peek() in ("word", "string") and self.peek(1) == ":":
            names = [self.take(self.peek())]
            self.take(":")
        else:
            return False
        for n in names:
            if n.lower() not in COLUMNS:
                raise QuerySyntaxError(f"no such column: {n}")
        return self.at > start

    def _words(self):
        parts = [self.unit()]
        while self.peek() in ("word", "string", "^", "{"):
            self._column_filter()
            parts.append(self.unit())
        parts = [p for p in parts if p is not None] or [Phrase(())]
        return parts[0] if len(parts) == 1 else Combined("and", tuple(parts))

    def unit(self):
        if self.peek() == "word" and self.tokens[self.at][1] == "NEAR" and self.peek(1) == "(":
            self.at += 2
            phrases = [self.phrase()]
            while self.peek() in ("word", "string", "^"):
                phrases.append(self.phrase())
            distance = NEAR_DEFAULT
            if self.peek() == ",":
                self.at += 1
                number = self.take("word")
                if not number.isdigit():
                    raise QuerySyntaxError(f'expected integer, got "{number}"')
                distance = int(number)
            self.take(")")
            kept = tuple(p for p in phrases if p.tokens)
            return Near(kept, distance) if len(kept) > 1 else (kept[0] if kept else Phrase(()))
        phrase = self.phrase()
        return phrase if phrase.tokens else None

    def phrase(self) -> Phrase:
        initial = self.peek() == "^"
        if initial:
            self.at += 1
        out: list[str] = []
        while True:
            if self.peek() not in ("word", "string"):
                raise QuerySyntaxError(f'syntax error near "{self.tokens[self.at][1]}"')
            out += tokenize(self.take(self.peek()))
            if self.peek() != "+":
                break
            self.at += 1
        prefix = self.peek() == "*"
        if prefix:
            self.at += 1
        return Phrase(tuple(out), prefix and bool(out), initial and bool(out))


def parse(query: str):
    """The tree of a query; a phrase without tokens, which matches nothing, if it holds none."""
    return _Parser(sanitize(query)).query()


def phrases(node) -> list[Phrase]:
    """All phrases of a tree, from left to right."""
    if isinstance(node, Phrase):
        return [node]
    return [p for part in (node.phrases if isinstance(node, Near) else node.parts) for p in phrases(part)]
