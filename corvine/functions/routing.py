"""Which parser reads which file.

A collection's own patterns go first: a file's name, an extension of several dots, one of a single dot, a wildcard, in this
order, then the longer pattern, then the alphabetically first; letter case doesn't matter. Then the default table by
extension, in which it does. Files without a parser are left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvine.functions.globs import to_regex
from corvine.functions.text import basename, extension

# Extensions with a parser; Markdown has its own, code shares one.
MARKDOWN = ".md .markdown".split()
CODE = """.bash .c .cc .cjs .cpp .cs .css .cxx .dockerfile .elm .ex .exs .go .gradle .groovy .h .hcl .hh .hpp .htm .html .hxx .java .js .jsx
.kt .kts .lua .mjs .ml .mli .php .phtml .proto .py .pyi .pyw .rb .rake .gemspec .rs .sc .scala .sh .sql .svelte .swift .tf .toml .ts .tsx
.yaml .yml""".split()


def priority(pattern: str) -> int:
    """4 a name, 3 an extension of several dots, 2 of one, 1 a wildcard."""
    if any(c in pattern for c in "*?["):
        return 1
    if pattern.startswith("."):
        return 3 if pattern.count(".") > 1 else 2
    return 4


def _applies(path: Column, pattern: str) -> Column:
    low = F.lower(path)
    kind = priority(pattern)
    if kind == 1:
        return F.lower(basename(path)).rlike(to_regex(pattern.lower()))
    return low.endswith(pattern.lower()) if kind in (2, 3) else F.lower(basename(path)) == pattern.lower()


def parser_of(path: Column, parsers: dict[str, str] | None = None) -> Column:
    """The parser's name; null if the file has none."""
    table = F.when(extension(path).isin(*MARKDOWN), F.lit("markdown")).when(extension(path).isin(*CODE) | (basename(path) == "Dockerfile"), F.lit("code"))
    own = sorted((parsers or {}).items(), key=lambda kv: (-priority(kv[0]), -len(kv[0]), kv[0]))
    if not own:
        return table
    chosen = reduce(lambda c, kv: c.when(_applies(path, kv[0]), F.lit(kv[1])), own[1:], F.when(_applies(path, own[0][0]), F.lit(own[0][1])))
    return F.coalesce(chosen, table)
