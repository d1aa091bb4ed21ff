"""Markup residue in text: HTML, Markdown, wiki and LaTeX notation turned into clean text that keeps its structure.

A text is read into nodes, each with the whole root-to-leaf path of the marks around it (``body/nav/ul/li/a``, ``heading``,
``table/cell``, ``script`` ...). Marks within a line (``strong``, ``a``, ``bold`` ...) belong to the block around them, so
blocks are what is judged: over all texts, number of blocks, length of text and punctuation below each path are summed. The
ratios of a path are smoothed over the paths beside it in the same container (``nav``, ``article``, ``div`` ...), in the
order in which they follow each other, then fused and compared with a threshold: mean less ``SPREAD`` standard deviations
of all paths. A path below it is poor, and nothing below it is content; all else is. Text outside of any mark is content;
scripts, comments and the like never are. All of this is DataFrame work over path rows, without a bound on their number;
poor paths are broadcast up to ``BROADCAST_BYTES`` and joined to the texts that hold them beyond that.

A record is marked if the text of its content that stands outside of all marks isn't its whole text, white space aside.
Nodes deeper than ``DEEPEST`` open elements stay at that depth, as in browsers.

Null and empty texts give an empty clean text and no notation. Rows of the same id and text are one record.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvine.session import materialize, prepare

PROSE = ("md", "markdown", "txt", "html", "htm", "wiki", "tex")
DEEPEST = 512
SPREAD = 0.8
BESIDE = 2  # paths on either side that a path is smoothed over
BROADCAST_BYTES = 4 << 20

# The names of HTML elements, and of the tags that wiki texts add.
TAGS = """a abbr address area article aside audio b base bdi bdo big blockquote body br button canvas caption center cite code
col colgroup data datalist dd del details dfn dialog div dl dt em embed fieldset figcaption figure font footer form frame
frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html i iframe img input ins kbd label legend li link main map mark menu
meta meter nav noscript object ol optgroup option output p param picture pre progress q rp rt ruby s samp script search
section select small source span strike strong style sub summary sup svg table tbody td template textarea tfoot th thead
time title tr track tt u ul var video wbr
math nowiki ref references gallery syntaxhighlight noinclude includeonly onlyinclude poem""".split()
VOID = set("area base br col embed frame hr img input link meta param source track wbr".split())
DROPPED = ("script", "style", "comment", "doctype", "link_target", "label", "meta", "head", "noscript", "template", "ref")
CONTAINERS = set("body main article section nav aside header footer div form dialog search menu".split())
INLINE = set("""a abbr b bdi bdo big button cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup
time tt u var wbr bold italic wikibold link reflink wikilink extlink autolink image command footnote magic formula math nowiki""".split())

_TAG = r"</?(?:" + "|".join(sorted(TAGS, key=len, reverse=True)) + r")(?:\s(?:[^<>\"']|\"[^\"]*\"|'[^']*')*)?\s*/?>"
_INLINE = re.compile(
    "|".join(
        f"(?P<{name}>{pattern})"
        for name, pattern in {
            "comment": r"<!--.*?(?:-->|$)",
            "doctype": r"<!DOCTYPE[^>]*>|<\?xml[^>]*\?>",
            "htmlmath": r"<math(?:\s[^<>]*)?>(?:(?!<math).)*?</math>",
            "script": r"<(?:script|style)(?:\s[^<>]*)?>.*?(?:</(?:script|style)\s*>|$)",
            "tag": _TAG,
            "autolink": r"<(?:https?|ftp|mailto):[^\s<>]+>",
            "entity": r"&(?:[A-Za-z][A-Za-z0-9]{1,31}|#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6});",
            "code": r"(?<!`)(?P<ticks>`+)(?!`)(?:.+?)(?<!`)(?P=ticks)(?!`)",
            "display": r"\$\$(?:[^$]|\$(?!\$))+\$\$|\\\[(?:[^\\]|\\(?![\[\]]))+\\\]|\\\((?:[^\\]|\\(?![()]))+\\\)",
            "math": r"(?<![\\$\w])\$(?=[^\s$])(?:[^$\n\\]|\\.)*?(?<=[^\s])\$(?![\w$])",
            "image": r"!\[[^\]\n]*\](?:\([^)\n]*\)|\[[^\]\n]*\])",
            "wikilink": r"\[\[[^\[\]\n]+\]\]",
            "template": r"\{\{[^{}\n]+\}\}",
            "extlink": r"\[(?:https?|ftp|mailto)://[^\s\]]+(?:\s[^\]\n]*)?\]",
            "footnote": r"\[\^[^\]\s]+\]",
            "link": r"\[[^\[\]\n]+\]\([^()\s]*(?:\([^()\s]*\))?[^()\n]*\)",
            "reflink": r"\[[^\[\]\n]+\]\[[^\[\]\n]*\](?!\[)",
            "wikibold": r"'''''.+?'''''|'''.+?'''|''(?!').+?''(?!')",
            "bold": r"\*\*(?=[^\s*])(?:[^*]|\*(?!\*))+(?<=[^\s*])\*\*|(?<!\w)__(?=[^\s_])(?:[^_]|_(?!_))+(?<=[^\s_])__(?!\w)",
            "strike": r"~~(?=[^\s~])[^~]+(?<=[^\s~])~~",
            "italic": r"(?<![\w*\\])\*(?=[^\s*])[^*\n]*?(?<=[^\s*])\*(?![\w*])|(?<![\w\\])_(?=[^\s_])[^_\n]*?(?<=[^\s_])_(?!\w)",
            "command": r"(?<!\\)\\[A-Za-z@]+\*?(?=[\[{])(?:\[[^\]\n]*\])*(?:\{(?:[^{}\n]|\{[^{}\n]*\})*\})*",
            "bare": r"(?<![\\\w:])\\(?:item|par|noindent|maketitle|tableofcontents|newpage|clearpage|centering|hline|dots|ldots|LaTeX|TeX|quad|qquad|toprule|midrule|bottomrule|bigskip|medskip|smallskip|[a-z]+(?=[ ,.;)]))(?![\\\w])",
            "escape": r"\\[%&_#${}~^\\](?![A-Za-z]:)",
            "magic": r"(?<!\w)__[A-Z]{3,}__(?!\w)|~{3,5}(?!~)",
        }.items()
    ),
    re.S | re.I,
)
_KINDS = {"li": ("item", 1), "pre": ("code", 0), "td": ("cell", 0), "th": ("cell", 0), "blockquote": ("quote", 0)}
_BLOCKS = set("p div li br tr pre table ul ol section article blockquote h1 h2 h3 h4 h5 h6".split())
_HINT = re.compile(r"[<&`$\[{'*_~\\]")
_ATX = re.compile(r"^ {0,3}(?P<mark>#{1,6}|▼{1,6})[ \t]+(?P<text>\S.*?)(?:[ \t]+#+)?[ \t]*$")
_WIKI_HEADING = re.compile(r"^(?P<mark>={1,6})\s*(?P<text>[^=\s].*?)\s*(?P=mark)\s*$")
_SETEXT = re.compile(r"^ {0,3}(?:={2,}|-{2,})[ \t]*$")
_FENCE = re.compile(r"^\s*(?P<mark>`{3,}|~{3,})(?P<info>[^`]*)$")
_ITEM = re.compile(r"^\s*(?:[-*+•]|\d{1,9}[.)]|[*#:;]{1,6})[ \t]+(?=\S)")
_WIKI_ITEM = re.compile(r"^[*#:;]+[ \t]*(?=\S)")
_QUOTE = re.compile(r"^ {0,3}>[ \t]?")
_TABLE = re.compile(r"^\s*\|.*\|\s*$")
_RULE = re.compile(r"^\s*(?:(?:\*[ \t]*){3,}|(?:_[ \t]*){3,}|(?:-[ \t]*){3,}|-{4,}|={4,}|-{5,}.*)$")
_REFERENCE = re.compile(r"^ {0,3}\[\^?[^\]\n]+\]:\s+\S")
_ENVIRONMENT = re.compile(r"^\s*\\begin\{(?P<name>[A-Za-z]+\*?)\}")
_MATH_ENVIRONMENTS = {"equation", "align", "gather", "multline", "eqnarray", "math", "displaymath", "split"}
_CODE_ENVIRONMENTS = {"verbatim", "lstlisting", "minted", "alltt", "Verbatim"}
_PUNCTUATION = re.compile(r"[.,;:!?。，；：！？、…\"”“()]")


@dataclass
class Node:
    path: str
    text: str
    kind: str = "paragraph"  # heading, item, code, formula, cell, quote, paragraph
    level: int = 0
    block: int = 0


class Reader:
    """Reads one text into nodes; ``notation`` counts the pieces of markup."""

    def __init__(self, text: str | None):
        self.nodes: list[Node] = []
        self.notation = 0
        self.stack: list[str] = []  # HTML elements that are open
        self.paths: list[str] = [""]  # the path to each of them
        self.inside: list[tuple[str, int]] = [("paragraph", 0)]  # kind and level within each of them, the text's own first
        self.open: dict[str, int] = defaultdict(int)
        self.block = 0
        if text:
            self._blocks(text)

    def _add(self, marks: list[str], text: str, kind: str, level: int = 0) -> None:
        path = "/".join([self.paths[-1], *marks] if self.paths[-1] else marks) or "text"
        self.nodes.append(Node(path, text, kind, level, self.block))

    def _blocks(self, text: str) -> None:
        lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        i, n = 0, len(lines)
        paragraph: list[str] = []

        def flush() -> None:
            if paragraph:
                self.block += 1
                self._inline("\n".join(paragraph), [], "paragraph")
                paragraph.clear()

        while i < n:
            line = lines[i]
            bare = line.strip()
            if not bare:
                flush()
                i += 1
                continue
            c = bare[0]
            if c in "`~" and (m := _FENCE.match(line)):
                flush()
                j = i + 1
                while j < n and not ((f := _FENCE.match(lines[j])) and not f["info"].strip()):
                    j += 1
                self._whole("\n".join(lines[i + 1 : j]), "code", ["code"])
                i = j + 1
                continue
            if c == "\\" and (m := _ENVIRONMENT.match(line)):
                flush()
                name, j = m["name"].rstrip("*"), i
                while j < n and f"\\end{{{m['name']}}}" not in lines[j]:
                    j += 1
                if name in _MATH_ENVIRONMENTS or name in _CODE_ENVIRONMENTS:
                    body = "\n".join(lines[i : j + 1])
                    body = re.sub(r"\\(?:begin|end)\{[^}]*\}(?:\[[^\]\n]*\])?", "", body).strip("\n")
                    self._whole(body, *(("formula", ["formula"]) if name in _MATH_ENVIRONMENTS else ("code", ["code"])))
                    i = j + 1
                else:
                    self.notation += 1
                    i += 1
                continue
            if bare.startswith("$$") or bare.startswith("\\["):
                flush()
                end = "$$" if c == "$" else "\\]"
                j = i
                while j < n and not (end in lines[j][2:] if j == i and bare != end else j > i and end in lines[j]):
                    j += 1
                joined = "\n".join(lines[i : j + 1]).strip()
                head, _, tail = joined[2:].partition(end)
                self._whole(head.strip(), "formula", ["formula"])
                if tail.strip():
                    paragraph.append(tail)
                i = j + 1
                continue
            if c in "#▼" and (m := _ATX.match(line)):
                flush()
                self.notation += 1
                self.block += 1
                self._inline(m["text"], ["heading"], "heading", len(m["mark"]))
            elif c == "=" and (m := _WIKI_HEADING.match(line)):
                flush()
                self.notation += 1
                self.block += 1
                self._inline(m["text"], ["heading"], "heading", len(m["mark"]))
            elif not paragraph and i + 1 < n and _SETEXT.match(lines[i + 1]) and not _ITEM.match(line) and not _TABLE.match(line):
                self.notation += 1
                self.block += 1
                self._inline(bare, ["heading"], "heading", 1 if "=" in lines[i + 1] else 2)
                i += 1
            elif c == "%":
                flush()
                self.notation += 1
                self.block += 1
                self._add(["comment"], bare.lstrip("% "), "paragraph")
            elif c == "{" and bare.startswith("{|") or c == "|" and bare in ("|-", "|}") or bare.startswith(("|-", "|}")):
                flush()
                self.notation += 1
            elif c in "!|" and (_TABLE.match(line) or re.match(r"^\s*[!|](?!\[)", line)):
                flush()
                self.notation += 1
                self.block += 1
                if not re.match(r"^[\s|:\-]+$", bare):
                    for cell in re.split(r"\|\||!!|\|", bare.strip("|! ")):
                        self._inline(cell.strip(), ["table", "cell"], "cell")
            elif c == ">" and (m := _QUOTE.match(line)):
                flush()
                self.notation += 1
                self.block += 1
                self._inline(line[m.end() :], ["quote"], "quote")
            elif _RULE.match(line):
                flush()
                self.notation += 1
            elif (m := _ITEM.match(line)) or (c in "*#:;" and (m := _WIKI_ITEM.match(line)) and not bare.startswith(("**", "#", ":", ";"))):
                flush()
                self.notation += 1
                self.block += 1
                self._inline(line[m.end() :], ["list", "item"], "item", (len(line) - len(line.lstrip())) // 2 + 1)
            elif c == "[" and _REFERENCE.match(line):
                flush()
                self.notation += 1
                self.block += 1
                self._add(["link_target"], bare, "paragraph")
            else:
                paragraph.append(line)
            i += 1
        flush()

    def _whole(self, text: str, kind: str, marks: list[str]) -> None:
        self.notation += 1
        self.block += 1
        self._add(marks, text, kind)

    def _inline(self, text: str, marks: list[str], kind: str, level: int = 0) -> None:
        if not _HINT.search(text):
            self._add(marks, text, kind, level)
            return
        at = 0
        for m in _INLINE.finditer(text):
            name, raw = m.lastgroup if m.lastgroup != "ticks" else "code", m[0]
            if name in ("entity", "escape"):
                value = html.unescape(raw) if name == "entity" else raw[1:]
                if name == "entity" and value == raw:
                    continue
            if m.start() > at:
                self._add(marks, text[at : m.start()], kind, level)
            at = m.end()
            self.notation += 1
            if name in ("entity", "escape"):
                self._add(marks, value, kind, level)
            elif name == "tag":
                kind, level = self._tag(raw, kind, level)
            elif name in ("comment", "doctype", "script", "template", "magic", "footnote"):
                self._add([*marks, name], raw, kind, level)
            elif name == "code":
                self._add([*marks, "code"], raw.strip("`").strip(), kind, level)
            elif name in ("display", "math", "htmlmath"):
                self._add([*marks, "formula"], re.sub(r"^(?:<math[^>]*>|\$\$?|\\[\[(])|(?:</math>|\$\$?|\\[\])])$", "", raw).strip(), kind, level)
            elif name == "command":
                self._command(raw, marks, kind, level)
            elif name == "bare":
                self._add([*marks, "command"], "", kind, level)
            else:
                self._add([*marks, name], self._shown(name, raw), kind, level)
        if at < len(text):
            self._add(marks, text[at:], kind, level)

    def _tag(self, raw: str, kind: str, level: int) -> tuple[str, int]:
        name = re.match(r"</?([A-Za-z][A-Za-z0-9]*)", raw)[1].lower()
        if raw.startswith("</"):
            if self.open[name]:
                while self._close() != name:
                    pass
        elif name not in VOID and not raw.endswith("/>"):
            if self.stack and self.stack[-1] == name and name in ("li", "p", "td", "th", "tr", "dt", "dd", "option"):
                self._close()  # its end tag may be left out
            heading = re.fullmatch(r"h([1-6])", name)
            own = ("heading", int(heading[1])) if heading else _KINDS.get(name)
            if len(self.stack) >= DEEPEST:
                self._close()
            self.stack.append(name)
            self.paths.append(f"{self.paths[-1]}/{name}" if self.paths[-1] else name)
            self.inside.append(own or self.inside[-1])
            self.open[name] += 1
        if name in _BLOCKS:
            self.block += 1
        return self.inside[-1]

    def _close(self) -> str:
        name = self.stack.pop()
        self.paths.pop()
        self.inside.pop()
        self.open[name] -= 1
        return name

    def _command(self, raw: str, marks: list[str], kind: str, level: int) -> None:
        name = re.match(r"\\([A-Za-z@]+)", raw)[1]
        inside = re.findall(r"\{((?:[^{}]|\{[^{}]*\})*)\}", raw)
        text = inside[-1] if inside else ""
        if name in ("chapter", "section", "subsection", "subsubsection", "paragraph", "part"):
            self.block += 1
            self._add([*marks, "heading"], _unescaped(text), "heading", ("part", "chapter", "section", "subsection", "subsubsection", "paragraph").index(name) or 1)
            self.block += 1
        elif name in ("label", "ref", "cite", "pageref", "eqref", "begin", "end", "usepackage", "documentclass", "bibliography", "input", "include"):
            self._add([*marks, "label"], text, kind, level)
        elif name in ("texttt", "verb", "lstinline"):
            self._add([*marks, "code"], _unescaped(text), kind, level)
        else:
            self._add([*marks, "command"], _unescaped(text), kind, level)

    @staticmethod
    def _shown(name: str, raw: str) -> str:
        if name in ("link", "image", "reflink"):
            return re.match(r"!?\[([^\]]*)\]", raw)[1]
        if name == "wikilink":
            return raw[2:-2].rsplit("|", 1)[-1]
        if name == "extlink":
            return raw[1:-1].partition(" ")[2] or raw[1:-1]
        if name == "autolink":
            return raw[1:-1]
        return raw.strip("*_'~")


def _unescaped(text: str) -> str:
    return re.sub(r"\\([%&_#${}])", r"\1", text)


def _judged(path: str) -> str | None:
    """The path of the block that a node belongs to; empty outside of all marks, None for what is never content."""
    marks = path.split("/")
    if not set(marks).isdisjoint(DROPPED):
        return None
    while marks and marks[-1] in INLINE:
        marks.pop()
    return "" if marks == ["text"] else "/".join(marks)


def _container(path: str) -> str:
    """The path to the innermost container around a block."""
    marks = path.split("/")
    last = max((i for i, m in enumerate(marks) if m in CONTAINERS), default=-1)
    return "/".join(marks[: last + 1])


def content(reader: Reader, poor: set[str] | frozenset[str] = frozenset()) -> list[Node]:
    """The nodes below paths of content."""
    known: dict[str, bool] = {}
    for path in {node.path for node in reader.nodes}:
        block = _judged(path)
        known[path] = block is not None and block not in poor
    return [node for node in reader.nodes if known[node.path]]


def is_marked(text: str | None, nodes: list[Node]) -> bool:
    """Whether the content outside of all marks isn't the whole text, white space aside."""
    return bool(text) and "".join("".join(n.text for n in nodes if n.path == "text").split()) != "".join(text.split())


def clean(nodes: list[Node]) -> tuple[str, list[dict]]:
    """The clean text of nodes of content, and its blocks with kind and level."""
    blocks: list[dict] = []
    last = -1
    for node in nodes:
        kind = "code" if node.path.endswith("/code") and node.kind == "code" else node.kind
        if kind in ("item", "quote", "heading", "code", "formula", "paragraph", "cell") and node.block == last and blocks and blocks[-1]["kind"] == kind:
            blocks[-1]["text"] += (" | " if kind == "cell" else "") + node.text
        else:
            blocks.append({"kind": kind, "level": node.level, "text": node.text})
        last = node.block
    for b in blocks:
        if b["kind"] not in ("code", "formula"):
            b["text"] = re.sub(r"[ \t]*\n[ \t]*|[ \t]+", " ", b["text"]).strip()
    blocks = [b for b in blocks if b["text"].strip()]
    shown = {"heading": lambda t: t, "item": lambda t: "• " + t}
    return "\n\n".join(shown.get(b["kind"], lambda t: t)(b["text"]) for b in blocks), blocks


def notation(text: str | None) -> int:
    """How many pieces of markup a text holds."""
    return Reader(text).notation


def _path_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, list[float]] = {}

    def rows() -> pa.RecordBatch:
        columns = list(zip(*sums.values())) or [[]] * 4
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([_container(p) for p in sums], pa.string()), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["path", "container", "blocks", "chars", "marks", "place"])

    for batch in batches:
        for text in batch.column(0).to_pylist():
            nodes, last = Reader(text).nodes, None
            of = {path: _judged(path) for path in {node.path for node in nodes}}
            for i, node in enumerate(nodes):
                if not (path := of[node.path]) or not node.text.strip():
                    continue
                s = sums.setdefault(path, [0, 0, 0, 0.0])
                if (path, node.block) != last:
                    s[0] += 1
                    s[3] += i / len(nodes)
                    last = (path, node.block)
                s[1] += len(node.text.strip())
                s[2] += len(_PUNCTUATION.findall(node.text))
        if len(sums) > 100_000:
            yield rows()
            sums.clear()
    yield rows()


def path_statistics(texts: DataFrame, column: str) -> DataFrame:
    """(path, container, blocks, chars, marks, place) over all texts: how many blocks a path has, text and punctuation below it, mean place."""
    prepare(texts.sparkSession)
    rows = texts.select(column).mapInArrow(_path_rows, "path string, container string, blocks long, chars long, marks long, place double")
    return rows.groupBy("path", "container").agg(*(F.sum(c).alias(c) for c in ("blocks", "chars", "marks")), (F.sum("place") / F.sum("blocks")).alias("place"))


def poor_paths(statistics: DataFrame, spread: float = SPREAD) -> DataFrame:
    """(path) of the paths whose fused ratio is below the threshold.

    Ratios are text and punctuation per block, smoothed over the paths beside a path in its container. A window holds the
    different paths of one container, never rows of texts.
    """
    beside = Window.partitionBy("container").orderBy("place", "path").rowsBetween(-BESIDE, BESIDE)
    blocks = F.sum("blocks").over(beside)
    fused = F.log1p(F.sum("chars").over(beside) / blocks) * (1 + F.log1p(F.sum("marks").over(beside) / blocks))
    rated = materialize(statistics.select("path", fused.alias("fused")), "paths")
    mean, deviation = rated.agg(F.avg("fused"), F.stddev_pop("fused")).first()
    return rated.where(F.col("fused") < (mean or 0.0) - spread * (deviation or 0.0)).select("path")


def _held_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        held = [sorted({p for p in map(_judged, {node.path for node in Reader(text).nodes}) if p}) for text in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held, pa.list_(pa.string()))], names=["row", "path"])


def cleaned(records: DataFrame, text: str, title: str, key: str, spread: float | None = SPREAD) -> DataFrame:
    """(key, marked, notation, clean_text, clean_title, blocks) of every record.

    ``notation`` counts the pieces of markup in text and title. Ids of several texts come out once per text. Without a
    ``spread`` no path is poor.
    """
    prepare(records.sparkSession)
    rows = records.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(title).alias("title"))
    poor = None if spread is None else materialize(poor_paths(path_statistics(rows.where(F.col("text").isNotNull()), "text"), spread), "poor")
    size = poor.agg(F.sum(F.octet_length("path"))).first()[0] or 0 if poor is not None else 0
    everywhere = frozenset()
    if size <= BROADCAST_BYTES:
        everywhere = frozenset(r[0] for r in poor.toLocalIterator()) if size else everywhere
        rows = rows.withColumn("poor", F.lit(None).cast("array<string>"))
    else:
        rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "numbered")
        held = rows.where(F.col("text").isNotNull()).select("row", "text").mapInArrow(_held_paths, "row long, path array<string>")
        found = held.select("row", F.explode("path").alias("path")).join(poor, "path", "left_semi").groupBy("row").agg(F.collect_set("path").alias("poor"))
        rows = rows.join(found, "row", "left").select("key", "text", "title", "poor")
    held_everywhere = records.sparkSession.sparkContext.broadcast(everywhere)  # at most BROADCAST_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marked, counts, texts, titles, blocks = [], [], [], [], []
            for body, head, poor in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3))):
                reader, title_reader = Reader(body), Reader(head)
                nodes, title_nodes = content(reader, poor or held_everywhere.value), content(title_reader)
                marked.append(is_marked(body, nodes) or is_marked(head, title_nodes))
                counts.append(reader.notation + title_reader.notation)
                shown, parts = clean(nodes)
                texts.append(shown)
                blocks.append(parts)
                titles.append(clean(title_nodes)[0])
            struct = pa.list_(pa.struct([("kind", pa.string()), ("level", pa.int32()), ("text", pa.string())]))
            kinds = (pa.bool_(), pa.int32(), pa.string(), pa.string(), struct)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip((marked, counts, texts, titles, blocks), kinds))], names=[key, "marked", "notation", "clean_text", "clean_title", "blocks"])

    kind = records.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"`{key}` {kind}, marked boolean, notation int, clean_text string, clean_title string, blocks array<struct<kind: string, level: int, text: string>>")
