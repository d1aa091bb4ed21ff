"""Credentials embedded in source code: where they are, and the text with them masked.

Literals near an assignment, header, URL, flag or comment that speaks of a credential are segmented into dictionary words by
Viterbi search; what no word explains is the residual, and a literal with a long residual is a secret. The dictionary is
counted over all distinct texts, each word once in each, without the literals that are judged by it and without runs beside
digits: however often a secret is repeated, it doesn't become a word that explains itself. A word of the dictionary stands
in a share (``WORD_SHARE``) of the distinct texts, so a text is judged alike in a small and in a large corpus, and the
dictionary has at most the mean number of words of a text times 1 / ``WORD_SHARE`` entries. Known forms of hashes (crypt
strings, digests with their name before them, hex digests under a signature's name) are no secrets; commit ids and the like
stand under names that don't speak of credentials and are left alone; public keys, references, paths and placeholders are
excluded by form. A private key block, a credential in a URL and a few unmistakable token forms are secrets wherever they
stand. No name, value or URL is too long to be read: all scanners take linear time.

Null and empty texts hold none; rows of the same id and text are one record. Lines are split at ``\\n`` and count from 1; a
value over several lines is one finding, at its first line.
"""

from __future__ import annotations

import base64
import binascii
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvine.session import materialize, prepare

WORD_SHARE = 1e-4  # of the distinct texts
LEAST_COUNT = 5  # what a word needs where that share is less than one text or a few
FLUSH_WORDS = 200_000
MASK = "REDACTED"

# What credentials are called, and what stands in for one.
PASSWORDS = {"password", "passwd", "pass", "passphrase", "pwd", "pgpass", "pw", "passcode"}
KEYS = {"secret", "token", "key", "apikey", "accesskey", "secretkey", "authtoken", "credential", "credentials", "apitoken", "sas", "signature"}
PUBLIC = {"public", "pub", "primary", "foreign", "sort", "partition", "cache", "row", "hash"}
PLACEHOLDER = re.compile(
    r"^(?:|none|null|nil|true|false|undefined|todo|tbd|changeme|change[-_ ]?me|replace[-_ ]?(?:me|this|with.*)|(?:your|my|the)[-_ ].*|example.*|dummy.*|fake.*|sample.*|placeholder.*|redacted|masked|hidden|secret|password|token"
    r"|<.*>|\[.*\]|\{\{.*\}\}|\$\{.*\}|\$\(.*\)|\$[a-z_]\w*|%\(?\w+\)?s?%?|@\w+@|__\w+__|[x*.•#?_-]+|.*(?:x{5}|\*{3}|\.{3}).*|env[.:(\[].*|.*environ.*|.*getenv.*|process\.env.*|vault:.*|file:.*|ref[:+].*|arn:.*|(?:\.{0,2}|~)/.*|[a-z]:\\.*)$",
    re.I | re.S,
)
# Forms of hashes.
HASH = re.compile(
    r"^(?:\$(?:2[abxy]?|1|5|6|7|y|md5|sha1|apr1|scrypt|argon2(?:id?|d)?|pbkdf2[\w\-]*)\$.+|\{S?(?:SHA|MD5|CRYPT|PBKDF2|ARGON2)[\w\-]*\}.+"
    r"|(?:md5|sha-?(?:1|224|256|384|512)|sha3-\d+|blake[23][bs]?|ripemd160)[:=\-].+|(?:pbkdf2|bcrypt|scrypt|argon2)[\w\-]*\$.+)$",
    re.I | re.S,
)
_DIGEST = re.compile(r"^(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128})$")

_QUOTED = r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`\n]*`"
# A name with what leads to its value, and the value; apart, so that values of other names are never read to their end.
_ASSIGN = (
    re.compile(r"(?<![\w.\-])(?P<name>[\w.\-]++)[\"'\]]{0,2}\s*+(?::=|=>|==?|:)\s*+"),
    re.compile(r"(?P<value>(?:[rbfu]{0,2}(?:" + _QUOTED + r")(?:\s*\+\s*(?:" + _QUOTED + r"))*)|[^\s,;\"'`()<>{}\[\]]+)"),
)
_FLAG = (re.compile(r"(?<!\S)--?(?P<name>[A-Za-z][\w\-]*+)[ =]++"), re.compile(r"(?P<value>" + _QUOTED + r"|[^\s\"'`;|&]+)"))
_INSIDE = (
    re.compile(r"(?i)(?<![A-Za-z])(?P<name>pwd|password|passwd|pass|token|secret|api[_-]?key|access[_-]?token|access[_-]?key|sig|signature|key)="),
    re.compile(r"(?P<value>[^;&\s\"'`,)]+)"),
)
_SCHEME = re.compile(r"(?i)\b(?:bearer|basic|token)\s+(?P<value>[A-Za-z0-9+/_.=\-~]{12,})")
_RUN = re.compile(r"[^\s\"'`<>]+")
_USER = re.compile(r"(?<!\S)(?:-u|--user)[ =]+[\"']?[\w.\-]+:(?P<value>[^\s\"'`]+)")
_HOOK = re.compile(r"(?i)https?://[^\s/\"'`]*hook[^\s/\"'`]*/(?P<value>[^\s\"'`<>)]+)")
_FORMS = re.compile(r"\b(?P<value>(?:AKIA|ASIA)[0-9A-Z]{16}|eyJ[\w\-]{10,}\.[\w\-]{10,}\.[\w\-]{8,}|gh[pousr]_[A-Za-z0-9]{30,}|xox[abprs]-[A-Za-z0-9\-]{10,})(?![\w])")
_PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_PEM_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_PEM_BODY = re.compile(r"^(?P<lead>\s*(?://|/\*|#|--|;|%|\*|>|\|)*\s*[\"'`]?)(?P<value>[A-Za-z0-9+/]{2,}={0,2})(?P<tail>(?:\\[nr])*\W*)$")
# What a text and a line must hold to be read at all: a name that counts as a credential's, which may stand in two parts
# (``pass_code``), or what another rule begins with.
_NAMES = sorted(n for n in PASSWORDS | KEYS if not any(m != n and m in n for m in PASSWORDS | KEYS))
_STARTS = ("bearer", "basic", "hook", "akia", "asia", "eyj", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "://", "-u ", "-u=", "--user", "private")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_LETTERS = re.compile(r"(?<![A-Za-z0-9])[A-Za-z]+(?![A-Za-z0-9])")
_NAME_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_BLOCK = re.compile(r"(?<![\w.\-])(?P<name>[\w.\-]++)[\"']?\s*+(?::=|=|:)\s*+(?:[|>][+\-]?|\"\"\"|'''|`|\\|\(|)\s*$")


def triggers(text: str) -> bool:
    low = text.lower()
    for start in _STARTS:
        if start in low:
            return True
    bare = low.replace("_", "").replace("-", "").replace(".", "")
    for name in _NAMES:
        if name in bare:
            return True
    return False


class Segmenter:
    """Viterbi segmentation of a literal's letters into dictionary words."""

    UNKNOWN = 7.0  # the cost of a character that no word explains; a word costs minus the log of its share

    def __init__(self, counts: dict[str, int]):
        total = sum(counts.values()) or 1
        self.cost = {w: math.log(total / n) for w, n in counts.items()}
        self.known: dict[str, int] = {}  # of runs seen before
        self.lengths = sorted({len(w) for w in counts}, reverse=True)

    def unexplained(self, run: str) -> int:
        """How many letters of one run of letters lie in no word of its cheapest segmentation."""
        n = len(run)
        best, back = [0.0] + [math.inf] * n, [(0, 0)] * (n + 1)
        for j in range(1, n + 1):
            best[j], back[j] = best[j - 1] + self.UNKNOWN, (j - 1, 1)
            for length in self.lengths:
                i = j - length
                c = self.cost.get(run[i:j]) if i >= 0 else None
                if c is not None and best[i] + c < best[j]:
                    best[j], back[j] = best[i] + c, (i, 0)
        left, j = 0, n
        while j:
            j, unknown = back[j]
            left += unknown
        return left

    def residual(self, value: str) -> int:
        """Letters in no word, plus digits; words only count where they stand as a program or a person would write them."""
        left = sum(c.isdigit() for c in value)
        for run in _WORDS.findall(value):
            if not self.cost:
                left += len(run)
                continue
            run = run.lower()
            if (own := self.known.get(run)) is None:
                if len(self.known) >= FLUSH_WORDS:
                    self.known.clear()
                own = self.known[run] = self.unexplained(run)
            left += own
        return left


def _name_kind(name: str, line: str, at: int) -> str:
    parts = [w.lower() for w in _NAME_WORDS.findall(name)]
    while parts and parts[-1].isdigit():
        parts.pop()
    if not parts:
        return ""
    last, joined = parts[-1], "".join(parts[-2:])
    if last in PASSWORDS or joined in PASSWORDS:
        return "password"
    if last in KEYS or joined in KEYS:
        before = re.findall(r"[A-Za-z]+", line[max(0, at - 16) : at])
        if PUBLIC & ({*parts[:-1]} | {w.lower() for w in before[-1:]}):
            return ""
        return "signature" if last == "signature" else "key"
    return ""


def _literal(raw: str) -> tuple[str, bool]:
    """The content of a literal, of all parts if it is put together, and whether it was quoted."""
    parts = re.findall(_QUOTED, raw)
    return ("".join(p[1:-1] for p in parts), True) if parts else (raw, False)


def secret_spans(line: str, words: Segmenter) -> list[tuple[int, int]]:
    """Where secrets stand in a line, without the blocks of private keys."""
    spans: list[tuple[int, int]] = []

    def plain(value: str, kind: str = "") -> bool:
        if HASH.match(value) or (kind == "signature" and _DIGEST.match(value)):
            return True
        return bool(PLACEHOLDER.match(value)) or value.startswith(("ssh-", "http://", "https://")) or "${" in value or "{{" in value

    def long_enough(value: str, kind: str) -> bool:
        left = words.residual(value)
        return len(value) >= 6 and left >= 3 if kind == "password" else len(value) >= 8 and left >= 6 and left * 4 >= len(value)

    has_equals, has_url, low = "=" in line, "://" in line, line.lower()
    for (names, values), has in ((_ASSIGN, has_equals or ":" in line), (_FLAG, "-" in line), (_INSIDE, has_equals)):
        if not has:
            continue
        at = 0
        while m := names.search(line, at):
            at = m.end()
            kind = _name_kind(m["name"], line, m.start())
            if not kind or not (v := values.match(line, at)):
                continue
            value, quoted = _literal(v["value"])
            if quoted:
                at = v.end()
            elif line[v.end() : v.end() + 1] in ("(", "[") or (_ATTRIBUTE.fullmatch(value) and not _is_random(value)) or re.fullmatch(r"[\d.]+", value):
                continue  # a call, an attribute, a choice by one, a number
            if " " in value or plain(value, kind) or not long_enough(value, kind):
                continue
            spans.append(v.span("value"))
            at = v.end()
    for m in _SCHEME.finditer(line) if "bearer" in low or "basic" in low or "token" in low else ():
        value = m["value"]
        if not plain(value) and (long_enough(value, "key") or _is_basic(value)):
            spans.append(m.span("value"))
    for a, b in _url_passwords(line):
        if not plain(line[a:b]) and words.residual(line[a:b]) >= 3:
            spans.append((a, b))
    has_form = any(form in low for form in ("akia", "asia", "eyj", "gh", "xox"))
    for pattern, kind, has in ((_USER, "password", "-u" in line or "--user" in line), (_HOOK, "hook", has_url and "hook" in low), (_FORMS, "form", has_form)):
        for m in pattern.finditer(line) if has else ():
            value = m["value"]
            if plain(value) and kind != "hook":
                continue
            if kind == "form" or (kind == "password" and words.residual(value) >= 3) or (kind == "hook" and words.residual(value) >= 16 and "{" not in value):
                spans.append(m.span("value"))
    return spans


_ATTRIBUTE = re.compile(r"[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)+(?:\?[\w.]+:[\w.]+)?")


def _is_random(value: str) -> bool:
    """Whether a part of a dotted value mixes cases and digits as no name does."""
    return any(len(p) >= 16 and len(re.findall(r"\d", p)) >= 2 and len(re.findall(r"[a-z][A-Z]|[A-Z][a-z]", p)) >= 4 for p in value.split("."))


def _url_passwords(line: str) -> Iterator[tuple[int, int]]:
    """Where ``scheme://user:password@`` has its password; each place is read once."""
    if "://" not in line:
        return
    for m in _RUN.finditer(line):
        run, at = m[0], 0
        while (i := run.find("://", at)) >= 0:
            at = i + 3
            if not i or not re.match(r"[A-Za-z0-9+.\-]", run[i - 1]):
                continue
            user = re.compile(r"[^/:@]*").match(run, at).end()
            if run[user : user + 1] != ":":
                continue
            end = run.find("@", user + 1)
            if end < 0:
                break  # nor has what follows one
            if end > user + 1:
                yield m.start() + user + 1, m.start() + end
            at = end


def _is_basic(value: str) -> bool:
    try:
        user, _, password = base64.b64decode(value, validate=True).decode("ascii").partition(":")
    except (binascii.Error, UnicodeDecodeError, ValueError):
        return False
    return bool(user and password)


NO_WORDS = Segmenter({})  # explains nothing, so that every literal that any dictionary could leave unexplained is found


def find(text: str | None, words: Segmenter) -> dict[int, list[tuple[int, int, int]]]:
    """Findings by line (from 1): spans as (line, begin, end); a finding over several lines has several spans."""
    if not text or not triggers(text):
        return {}
    found: dict[int, list[tuple[int, int, int]]] = {}
    lines = text.split("\n")
    block: int | None = None  # the line at which a private key begins
    body: list[tuple[int, int, int]] = []
    begun = False
    pending: tuple[str, int] | None = None  # a credential's name whose value stands on the lines after it

    def close() -> None:
        """The key ends; one whose body is masked is none."""
        if not body or any(lines[n - 1][a:b].strip() != MASK for n, a, b in body):
            found.setdefault(block, []).extend(body or [(block, 0, 0)])

    for n, line in enumerate(lines, 1):
        dashes = "-----" in line
        if block is None and dashes and (m := _PEM.search(line)):
            begun = True
            if end := _PEM_END.search(line, m.end()):  # all of it on one line
                inner = line[m.end() : end.start()]
                if inner.replace("\\n", "").strip() and MASK not in inner:
                    found.setdefault(n, []).append((n, m.end(), end.start()))
                continue
            block, body = n, []
            continue
        if block is not None:
            if _PEM_END.search(line):
                close()
                block = None
                continue
            m = _PEM_BODY.match(line)
            if m and (len(m["value"]) >= 8 or (n < len(lines) and _PEM_END.search(lines[n]))):
                body.append((n, *m.span("value")))
                continue
            if not line.strip() or re.match(r"^[\W_]*(?:[\w\-]+: .*)?[\W_]*$", line):
                continue
            close()
            block = None  # the key is cut off here
        elif not begun and dashes and _PEM_END.search(line):  # the key began in an earlier record
            begun, tail = True, []
            for k in range(n - 1, 0, -1):
                m = _PEM_BODY.match(lines[k - 1])
                if not m or not (len(m["value"]) >= 8 or k == n - 1):
                    break
                tail.append((k, *m.span("value")))
            if any(lines[k - 1][a:b] != MASK for k, a, b in tail):
                found.setdefault(tail[-1][0], []).extend(tail)
            continue
        if pending and (m := re.match(r"^\s*(?:[rbfu]{0,2}[\"'`]+)?(?P<value>[A-Za-z0-9+/_.=~!@#$%^&*\-]{8,})[\"'`)]*[,;]?\s*$", line)):
            value = m["value"]
            if not PLACEHOLDER.match(value) and not HASH.match(value) and words.residual(value) >= (3 if pending[0] == "password" else 8) and not _ASSIGN[0].match(line.strip()):
                found.setdefault(pending[1] or n, []).append((n, *m.span("value")))
                pending = (pending[0], pending[1] or n)
                continue
        pending = None
        if not triggers(line):
            continue
        for span in secret_spans(line, words):
            found.setdefault(n, []).append((n, *span))
        if (n not in found or words is NO_WORDS) and (m := _BLOCK.search(line)) and (kind := _name_kind(m["name"], line, m.start())):
            pending = (kind, 0)
    if block is not None:
        close()
    return found


def redact(text: str | None, words: Segmenter) -> str | None:
    """The text with every secret masked; lines, quotes, URLs and comments around them stay as they are.

    A private key block loses its body lines' content but keeps its markers, a URL or a command only the secret part.
    """
    found = find(text, words)
    if not found:
        return text
    lines = text.split("\n")
    by_line: dict[int, list[tuple[int, int]]] = {}
    for spans in found.values():
        for n, a, b in spans:
            by_line.setdefault(n, []).append((a, b))
    for n, spans in by_line.items():
        line, out, at = lines[n - 1], [], 0
        for a, b in sorted(set(spans)):
            if a < at:
                continue
            raw = line[a:b]
            if not raw:
                continue  # a key whose body stands in the next record
            prefix = re.match(r"[rbfu]{0,2}(?=[\"'`])", raw)[0] if re.match(r"[rbfu]{0,2}[\"'`]", raw) else ""
            quote = raw[len(prefix)] if raw[len(prefix) : len(prefix) + 1] in ("'", '"', "`") else ""
            out += [line[at:a], prefix, quote, MASK, quote]
            at = b
        lines[n - 1] = "".join(out) + line[at:]
    return "\n".join(lines)


def _unjudged(text: str) -> str:
    """The text without the literals in credential contexts, whose letters say nothing about what is a word."""
    found = find(text, NO_WORDS)
    if not found:
        return text
    lines, by_line, values = text.split("\n"), {}, set()
    for n, a, b in {span for spans in found.values() for span in spans}:
        by_line.setdefault(n, []).append((a, b))
        values.add(_literal(lines[n - 1][a:b])[0])
    for n, spans in by_line.items():
        for a, b in spans:
            lines[n - 1] = lines[n - 1][:a] + " " * (b - a) + lines[n - 1][b:]
    text = "\n".join(lines)
    for value in sorted(values, key=lambda v: (-len(v), v)):  # also where it stands outside such a context, unless it looks like a word
        if len(value) >= 6 and re.search(r"[^A-Za-z]|[a-z][A-Z]|[A-Z]{2}", value):
            text = text.replace(value, " ")
    return text


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter[str] = Counter()

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    for batch in batches:
        for text in batch.column(0).to_pylist():
            runs = _WORDS.findall(" ".join(set(_LETTERS.findall(_unjudged(text)))))
            seen.update({w.lower() for w in runs if len(w) >= 3})
            seen[""] += 1  # counts the texts
            if len(seen) > FLUSH_WORDS:
                yield rows()
                seen.clear()
    yield rows()


def dictionary(texts: DataFrame, column: str) -> dict[str, int]:
    """The words that stand in at least ``WORD_SHARE`` of all distinct texts, and in ``LEAST_COUNT`` of them.

    A word counts once in a text, and not where it stands in a literal that ``find`` judges or beside a digit.
    """
    distinct = texts.where(F.col(column).isNotNull()).select(column).distinct()
    counts = materialize(distinct.mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    total = counts.where("word = ''").select("n").first()
    least = max(LEAST_COUNT, math.ceil(WORD_SHARE * (total[0] if total else 0)))
    return {w: n for w, n in counts.where((F.col("n") >= least) & (F.col("word") != "")).toLocalIterator()}


def _readings(records: DataFrame, text: str, key: str, each, columns: str, kinds: list[pa.DataType]) -> DataFrame:
    """What ``each`` (text, findings, masked text) gives out for the records with findings, as rows."""
    prepare(records.sparkSession)
    held = records.sparkSession.sparkContext.broadcast(dictionary(records, text))
    kind = records.schema[key].dataType.simpleString()
    names = [key, *(c.split()[0] for c in columns.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Segmenter(held.value)
        for batch in batches:
            at, out = [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                if found := find(t, words):
                    rows = each(found, redact(t, words))
                    at += [i] * len(rows)
                    out += rows
            columns = list(zip(*out)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=names)

    rows = records.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(key, text)
    return rows.mapInArrow(run, f"`{key}` {kind}, {columns}")


def credentials(records: DataFrame, text: str, key: str) -> DataFrame:
    """(key, line_no, redacted) of every finding; ``redacted`` is the masked text of the finding's first line."""

    def each(found, masked):
        lines = masked.split("\n")
        return [(n, lines[n - 1]) for n in sorted(found)]

    return _readings(records, text, key, each, "line_no int, redacted string", [pa.int32(), pa.string()]).dropDuplicates([key, "line_no"])


def masked(records: DataFrame, text: str, key: str) -> DataFrame:
    """(key, findings, masked) of every record with a finding: its whole text, in which nothing is found any more.

    Repeated rows come out once; an id of several texts comes out once for each.
    """
    each = lambda found, text: [(len(found), text)]
    return _readings(records, text, key, each, "findings int, masked string", [pa.int32(), pa.string()]).distinct()
