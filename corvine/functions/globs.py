"""File selection by glob patterns, as regular expressions that Catalyst can push into a filter.

A pattern without a slash is matched with the file's name; one with a slash with the whole path; ``**`` stands for any
number of folders. ``*`` and ``?`` don't cross slashes. A malformed pattern matches nothing.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# What is selected, and left out, if a collection says nothing.
INCLUDE = """*.md *.markdown *.bash *.c *.cc *.cjs *.cpp *.cs *.css *.cue *.cxx Dockerfile *.dockerfile *.elm *.ex *.exs *.go *.gradle
*.groovy *.h *.hcl *.hh *.hpp *.htm *.html *.hxx *.java *.js *.jsx *.kt *.kts *.lua *.mjs *.ml *.mli *.php *.phtml *.proto *.py *.pyi
*.pyw *.rb *.rake *.gemspec *.rs *.sc *.scala *.sh *.sql *.svelte *.swift *.tf *.toml *.ts *.tsx *.yaml *.yml""".split()
EXCLUDE = """.git node_modules vendor venv .venv env .env __pycache__ dist build target .next .nuxt .terraform out bin obj tmp temp CVS
pytest_cache PackageCache .DS_Store Thumbs.db package-lock.json yarn.lock pnpm-lock.yaml .corvine""".split()

NOTHING = r"(?!)"
_SPECIAL = set(".^$+{}()|\\[]*?")


def _segment(pattern: str) -> str | None:
    """The expression of a pattern within one path segment; None if it is malformed."""
    out, i, n = "", 0, len(pattern)
    while i < n:
        c = pattern[i]
        i += 1
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "\\":
            if i == n:
                return None
            out += _quoted(pattern[i])
            i += 1
        elif c == "[":
            negated = i < n and pattern[i] in "^!"
            i += negated
            body, count = "", 0
            while True:
                if i >= n:
                    return None
                if pattern[i] == "]" and count:
                    i += 1
                    break
                low, i = _member(pattern, i)
                if low is None:
                    return None
                high = low
                if i + 1 < n and pattern[i] == "-" and pattern[i + 1] != "]":
                    high, i = _member(pattern, i + 1)
                    if high is None or high < low:
                        return None
                body += f"\\x{{{ord(low):x}}}-\\x{{{ord(high):x}}}"
                count += 1
            out += f"[^/{body}]" if negated else f"(?!/)[{body}]"
        else:
            out += _quoted(c)
    return out


def _member(pattern: str, i: int) -> tuple[str | None, int]:
    if pattern[i] == "\\":
        i += 1
        if i >= len(pattern):
            return None, i
    elif pattern[i] in "-]":
        return None, i
    return pattern[i], i + 1


def _quoted(c: str) -> str:
    return "\\" + c if c in _SPECIAL else c


def to_regex(pattern: str) -> str:
    """An expression to be found in a path (with slashes, no leading one)."""
    if "/" not in pattern:
        body = _segment(pattern)
        return NOTHING if body is None else f"(?:^|/){body}$"
    if "**" not in pattern:
        parts = [_segment(p) for p in pattern.split("/")]
        return NOTHING if None in parts else "^" + "/".join(parts) + "$"
    out = "^"
    segments = pattern.split("/")
    for k, s in enumerate(segments):
        last = k == len(segments) - 1
        if s == "**":
            if last:  # what is below, and the folder itself
                out = out.removesuffix("/") + ("(?:/[^/]+)*" if k else "(?:[^/]+/)*[^/]+")
            else:
                out += "(?:[^/]+/)*"
            continue
        body = _segment(s)
        if body is None:
            return NOTHING
        out += body + ("" if last else "/")
    return out + "$"


def matches(path: Column, pattern: str) -> Column:
    return path.rlike(to_regex(pattern))


def any_matches(path: Column, patterns: list[str]) -> Column:
    """Whether any pattern matches, in one expression over the path."""
    if not patterns:
        return F.lit(False)
    return path.rlike("|".join(f"(?:{to_regex(p)})" for p in patterns))


def ancestors(path: Column) -> Column:
    """The folders above a path, the outermost first; the root is not among them."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 1, i), "/")))


def folder_pruned(path: Column, exclude: list[str]) -> Column:
    """Whether a folder above the path is excluded, so that nothing below it is walked."""
    if not exclude:
        return F.lit(False)
    rule = "|".join(f"(?:{to_regex(p)})" for p in exclude)
    return F.coalesce(F.exists(ancestors(path), lambda d: d.rlike(rule)), F.lit(False))


def include_folders(patterns: list[str]) -> list[str]:
    """The folders outside of which no pattern can match; empty if there is no such bound."""
    folders: list[str] = []
    for p in patterns:
        fixed = []
        for s in p.split("/")[:-1]:
            if any(c in s for c in "*?[\\"):
                break
            fixed.append(s)
        if not fixed:
            return []
        folders.append("/".join(fixed))
    return sorted(set(folders))


@dataclass
class FileFilter:
    """Which files of a tree belong to a collection.

    Named ``files`` are taken by path or name; ``exclude`` then only prunes folders. Without ``files``, a file is taken if
    an include pattern matches and no exclude pattern does. Folders that an exclude pattern matches are not walked.
    """

    files: list[str] = field(default_factory=list)
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.exclude = list(self.exclude) or list(EXCLUDE)
        self.include = list(self.include) or ([] if self.files else list(INCLUDE))

    def match(self, path: Column) -> Column:
        """The predicate on the file alone."""
        if self.files:
            name = F.element_at(F.split(path, "/"), -1)
            return path.isin(*self.files) | name.isin(*self.files) | any_matches(path, self.include)
        return any_matches(path, self.include) & ~any_matches(path, self.exclude)

    def walked(self, path: Column) -> Column:
        """The predicate of a walk: the file matches and its folders are entered. Named files count by their whole path."""
        entered = ~folder_pruned(path, self.exclude)
        if folders := include_folders(self.include):
            entered &= reduce(lambda a, b: a | b, [path.startswith(f + "/") for f in folders])
        walk = F.lit(bool(self.include)) & entered & self.match(path)
        return walk | path.isin(*self.files) if self.files else walk
