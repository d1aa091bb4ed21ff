"""Source files that nobody wrote by hand: generated, minified, third-party, and data saved as code.

Each file is seen in three views: its path (folders, the marks its name ends in, character n-grams of the name), its opening
comments (beginnings of lines and their n-grams), and the rest of its text, in which the opening comments are masked so that
their giveaway words can't stand in for what the body shows (n-grams, and how much of it is dense lines or literals of data).
A linear support-vector classifier per view and kind (``CLASSES``) decides whether a file is a case: a score over 0 says so.
What lies within the margin above that (a score under ``SURE``) is a close call, and so is what scores less by no more than
``SLACK``; the rule of the class is asked about these only. All other files are decided by the classifiers alone.

The classifiers are fitted to a bounded sample (``TRAIN_ROWS``), chosen by a hash of the path, whose labels come from the
rules of this module. Validation is split by repository (by folder where a file names none): every fifth one stays out of the
fit, and the lowest case in those moves the line below which no question is asked. Features are hashed into ``2**BITS`` places. A size beyond ``BLOB_BYTES``
makes a file a case by itself.

Null paths and ids are no files; a null size says nothing. Of several rows of an id the newest counts. Files without text
are judged by path and size. Texts of several documents of a file are all looked at.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvine.llm.words import mix
from corvine.session import materialize, prepare

BITS = 18
BLOB_BYTES = 1_000_000
TRAIN_ROWS = 8_000
VALIDATE_EVERY = 5
EPOCHS = 15
COST = 1.0
SURE = 1.0  # a case scoring as much lies outside of the margin
SLACK = 0.25  # how far below the line a file is still asked about
CLASSES = ((0, "generated"), (0, "minified"), (0, "vendored"), (1, "generated"), (1, "vendored"), (2, "minified"), (2, "blob"))
VIEWS = ("path", "opening", "body")

# File types that are source or configuration, and prose and assets that are not.
SOURCE = """py pyi pyw js jsx mjs cjs ts tsx go java kt kts scala sc rb rs c cc cpp cxx h hh hpp hxx cs php phtml swift lua ml mli ex exs
elm groovy gradle sh bash sql proto tf hcl cue yaml yml toml json ini cfg conf env properties css scss less svelte vue
dockerfile xml rake gemspec""".split()
_NOT_SOURCE = "md markdown txt html htm wiki tex rst png jpg jpeg gif ico svg pdf csv".split()

# Names, folders and opening words that say where a file comes from.
GENERATED_NAME = re.compile(r"(?:[._-](?:generated|gen|pb|g|designer)\.[a-z]+|_pb2(?:_grpc)?\.pyi?|_pb\.[jt]sx?|_generated\.[a-z]+|\.pb\.(?:go|cc|h)|zz_generated\.[\w.]+)$", re.I)
MINIFIED_NAME = re.compile(r"[.-](?:min|bundle)\.(?:[cm]?js|css)$|\.(?:chunk|bundle)\.[0-9a-f]{6,}\.(?:js|css)$|\.[0-9a-f]{8,}\.min\.(?:js|css)$", re.I)
VENDORED_DIR = re.compile(r"(?:^|/)(?:vendor|vendors|vendored|third[_-]?party|3rd[_-]?party|node_modules|bower_components|jspm_packages|site-packages|dist-packages|Pods|Godeps|external|extern|deps)/[^/]+/", re.I)
GENERATED_HEAD = re.compile(
    r"^(?:code generated by\b|@generated\b|<auto-?generated\b|auto-?generated\b|automatically generated\b|machine[- ](?:written|generated)\b|generated (?:by|from|with|on|using)\b"
    r"|this (?:is an? (?:output|generated|auto-?generated) file\b|(?:file|code) (?:was|is|has been) (?:auto-?matically |auto-?|machine[- ])?(?:produced|generated|created|written) (?:automatically|by|from)\b)|(?:do not|don't) (?:edit|modify|touch)\b)",
    re.I,
)
VENDORED_HEAD = re.compile(
    r"^(?:vendored\b|third[- ]party (?:code|source|file|library|package)\b|imported (?:verbatim|unmodified|unchanged|as is)\b|bundled (?:from|with)\b|copied (?:verbatim |unmodified |unchanged )?from\b|taken (?:verbatim |unmodified )?from\b|this (?:file|code) (?:is|was) (?:a (?:verbatim |vendored )?copy of|copied|taken|vendored|imported)\b)",
    re.I,
)
_COMMENT = re.compile(r"\s*(?:(?P<block>/\*.*?\*/|<!--.*?-->|\"\"\".*?\"\"\"|'''.*?''')|(?P<line>(?:#|//|--|;|%)[^\n]*))", re.S)
_REMARK = re.compile(r"^[ \t]*(?://|(?:#|--|;|%)[ \t])[^\n]*$|(?<=[;})])[ \t]*//[ \t][^\n]*$", re.M)
_LEAD = re.compile(r"^[\s#/*;%!<\-\"']+|[\s*/>\-\"']+$")
_HEX = re.compile(r"(?<![a-z0-9])(?=[a-f]*\d)[0-9a-f]{6,}(?![a-z0-9])")
_DATA = re.compile(r"[\"'][A-Za-z0-9+/=_\-\\]{24,}[\"']|(?<![\w.])[-+]?(?:0[xX][0-9a-fA-F]+|\d+(?:\.\d+)?(?:[eE][-+]?\d+)?)(?![\w.])")


def opening(text: str) -> tuple[str, str]:
    """The comments before the first line of code, and the rest."""
    at = 0
    while m := _COMMENT.match(text, at):
        at = m.end()
    return text[:at], text[at:]


def head_kind(head: str) -> str:
    """``generated`` or ``vendored`` if a line of the opening comments says so of the file, else empty."""
    for line in head.splitlines():
        words = _LEAD.sub("", line) if "<auto" not in line.lower() else line[line.lower().index("<auto") :]
        if GENERATED_HEAD.match(words):
            return "generated"
        if VENDORED_HEAD.match(words):
            return "vendored"
    return ""


def path_kind(path: str) -> str:
    name = path.rsplit("/", 1)[-1]
    if GENERATED_NAME.search(name):
        return "generated"
    if MINIFIED_NAME.search(name):
        return "minified"
    return "vendored" if VENDORED_DIR.search(path) else ""  # a package has a folder of its own there


def _code(body: str) -> str:
    """The body without its comments: blocks, lines that are comments as a whole, and what follows a statement's end."""
    parts, at = [], 0
    for begin, end in (("/*", "*/"), ("<!--", "-->")):
        while (i := body.find(begin, at)) >= 0 and (j := body.find(end, i + len(begin))) >= 0:
            parts.append(body[at:i])
            at = j + len(end)
        body, parts, at = "".join(parts) + body[at:], [], 0
    return _REMARK.sub("", body)


def _is_dense(line: str) -> bool:
    return line.count(" ") <= 0.12 * len(line) and len(re.findall(r"[(){};=,&|?:\[\]]", line)) >= 0.12 * len(line)


def _dense_lines(code: str) -> list[str]:
    return [line for line in code.splitlines() if len(line) >= 200 and _is_dense(line)]


def _dense_share(code: str) -> float:
    return sum(map(len, _dense_lines(code))) / max(1, len(code))


def _is_minified(code: str) -> bool:
    """Lines of dense code make up nearly all of it, a long one among them."""
    code = code.strip()
    long = _dense_lines(code)
    return len(code) >= 300 and max(map(len, long), default=0) >= 500 and sum(map(len, long)) >= 0.8 * len(code) and _blob_share(code) < 0.7


def body_kind(body: str) -> str:
    """``minified``: long lines of dense code, comments aside; ``blob``: literals of data make up nearly all of it."""
    dense = body.strip()
    if len(dense) < 300:
        return ""
    if max(map(len, dense.splitlines())) >= 500 and (_is_minified(dense) or _is_minified(_code(dense))):
        return "minified"
    return "blob" if _blob_share(dense) >= 0.7 else ""


def _blob_share(body: str) -> float:
    data = sum(len(m) for m in _DATA.findall(body))
    rest = re.sub(r"[\s,;\[\](){}]", "", _DATA.sub("", body))
    return data / (data + len(rest)) if data >= 200 else 0.0


def rules(path: str, text: str | None) -> tuple[str, str, str]:
    """What the rules say of the path, the opening comments and the body: a kind, or nothing."""
    if not text or not text.strip():
        return path_kind(path), "", ""
    head, body = opening(text.lstrip("\ufeff"))
    return path_kind(path), head_kind(head), body_kind(body)


def _places(features: list[str]) -> np.ndarray:
    return np.unique(np.array([zlib.crc32(f.encode("utf-8", "surrogatepass")) >> (32 - BITS) for f in features], dtype=np.int32))


def grams(text: str, sizes: tuple[int, ...]) -> np.ndarray:
    """Hashed character n-grams of a text, as places of features."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    out = []
    for n in sizes:
        if len(codes) >= n:
            h = np.full(len(codes) - n + 1, n, dtype=np.uint64)
            for i in range(n):
                h = h * np.uint64(0x100000001B3) + codes[i : len(codes) - n + 1 + i]
            out.append((mix(h) >> np.uint64(64 - BITS)).astype(np.int32))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.int32)


def _view(marks: list[str], weight: float, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and values: marks weigh ``weight`` each, n-grams have unit length together."""
    own = _places(marks)
    places, counts = np.unique(found, return_counts=True)
    values = counts / max(1.0, float(np.sqrt((counts * counts).sum())))
    return np.concatenate([own, places]), np.concatenate([np.full(len(own), weight), values])


def path_view(path: str) -> tuple[np.ndarray, np.ndarray]:
    *folders, name = path.lower().split("/")
    name = re.sub(r"\d+", "0", _HEX.sub("#", name))
    parts = re.findall(r"[._-]+[^._-]*|^[^._-]+", name) or [name]
    ends = ["tail:" + "".join(parts[-k:]) for k in (1, 2, 3) if k <= len(parts)]
    marks = ["dir:" + f + "/" * (i + 1 < len(folders)) for i, f in enumerate(folders)] + ends + ["first:" + parts[0]]
    return _view(marks, 1.0, grams("^" + name[-24:] + "$", (3, 4, 5)))


def _starts(head: str) -> list[str]:
    lines = (line[line.lower().index("<auto") :] if "<auto" in line.lower() else _LEAD.sub("", line) for line in head.splitlines())
    return ["^" + line[:40].lower() for line in lines if len(line) > 2]


def opening_view(head: str) -> tuple[np.ndarray, np.ndarray]:
    starts = _starts(head)
    found = [grams(s, (4, 6)) for s in starts]
    return _view([f"begin{k}:{s[:k]}" for s in starts for k in (6, 9, 12, 16, 20, 25, 32)], 1.0, np.concatenate(found) if found else np.zeros(0, dtype=np.int32))


def body_view(body: str) -> tuple[np.ndarray, np.ndarray]:
    body = body.strip()
    longest = max(map(len, body.splitlines()), default=0)
    dense = max(_dense_share(body), _dense_share(_code(body).strip())) if longest >= 200 else 0.0
    data = _blob_share(body)
    marks = [f"long:{k}" for k in range(1, 13) if longest >= 100 * k] + [f"size:{k}" for k in range(1, 8) if len(body) >= 100 * k]
    marks += [f"dense:{k}" for k in range(1, 21) if dense >= k / 20] + [f"data:{k}" for k in range(1, 21) if data >= k / 20]
    return _view(marks, 0.7, grams(re.sub(r"\d", "0", body), (3,)))


def views(path: str, text: str | None) -> list[tuple[np.ndarray, np.ndarray] | None]:
    """Features of the path, of the opening comments, and of the body; None where there is nothing to see."""
    if not text or not text.strip():
        return [path_view(path), None, None]
    head, body = opening(text.lstrip("\ufeff"))
    return [path_view(path), opening_view(head) if head.strip() else None, body_view(body) if body.strip() else None]


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 3) -> np.ndarray:
    """A linear support-vector classifier (squared hinge loss, dual coordinate descent) of sparse rows; the last weight is the bias.

    Cases cost more than others, by the root of how much rarer they are.
    """
    rng = np.random.default_rng(seed)
    w, alpha = np.zeros((1 << BITS) + 1), np.zeros(len(rows))
    rare = min(20.0, max(1.0, float((~labels).sum()) / max(1, int(labels.sum())))) ** 0.5
    norms = [float(v @ v) + 1 for _, v in rows]
    signs, half = np.where(labels, 1.0, -1.0), np.where(labels, 0.5 / (COST * rare), 0.5 / COST)
    for _ in range(EPOCHS):
        moved = False
        for i in rng.permutation(len(rows)):
            x, v = rows[i]
            slope = signs[i] * (w[x] @ v + w[-1]) - 1 + alpha[i] * half[i]
            if abs(min(slope, 0.0) if alpha[i] == 0 else slope) > 1e-3:
                step = max(alpha[i] - slope / (norms[i] + half[i]), 0.0) - alpha[i]
                alpha[i] += step
                w[x] += step * signs[i] * v
                w[-1] += step * signs[i]
                moved = True
        if not moved:
            break
    return w.astype(np.float32)


def _score(w: np.ndarray, seen: tuple[np.ndarray, np.ndarray] | None) -> float:
    return float(w[seen[0]] @ seen[1] + w[-1]) if seen is not None and len(seen[0]) else -np.inf


def _labelled(every: int):
    """Features and labels of the sample, by view; opening comments are masked in the body view."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for path, text, repository in zip(*(batch.column(c).to_pylist() for c in range(3))):
                if zlib.crc32(path.encode("utf-8", "surrogatepass")) % every:
                    continue
                home = repository or path.rpartition("/")[0]
                held_out = zlib.crc32(home.encode("utf-8", "surrogatepass")) % VALIDATE_EVERY == 0
                for v, (seen, label) in enumerate(zip(views(path, text), rules(path, text))):
                    if seen is not None and len(seen[0]):
                        out.append((v, label, held_out, seen[0].astype("<i4").tobytes(), seen[1].astype("<f4").tobytes()))
            columns = list(zip(*out)) or [[]] * 5
            kinds = [pa.int32(), pa.string(), pa.bool_(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["view", "label", "held_out", "places", "shares"])

    return run, "view int, label string, held_out boolean, places binary, shares binary"


def train(files: DataFrame, count: int, rows: int = TRAIN_ROWS) -> tuple[np.ndarray, list[float], dict]:
    """Per class, weights and the score below which nothing is asked, fitted to about ``rows`` files (path, text, repository); and a report.

    The report has, of each class, the rows and cases of the fit and of the held-out repositories, and precision and recall
    on the latter by the sign of the score alone.
    """
    every = max(1, round(count / rows))
    sample = files.select("path", "text", "repository").mapInArrow(*_labelled(every)).limit(6 * rows).toArrow()
    # in an order of its own, so that the fit doesn't depend on how the rows were split into tasks
    sample = sample.sort_by([(c, "ascending") for c in ("view", "places", "shares", "label", "held_out")])
    columns = {c: sample.column(c).to_pylist() for c in sample.column_names}
    weights, lines, report = [], [], {}
    for v, kind in CLASSES:
        own = [i for i, x in enumerate(columns["view"]) if x == v]
        parsed = [(np.frombuffer(columns["places"][i], "<i4"), np.frombuffer(columns["shares"][i], "<f4").astype(np.float64)) for i in own]
        label, out = np.array([columns["label"][i] == kind for i in own], dtype=bool), np.array([columns["held_out"][i] for i in own], dtype=bool)
        inside = np.flatnonzero(~out) if (label & ~out).any() else np.arange(len(own))
        w = fit([parsed[i] for i in inside], label[inside]) if label.any() else np.zeros((1 << BITS) + 1, dtype=np.float32)
        score = np.array([_score(w, x) for x in parsed])
        tested = out if (label & out).any() else np.ones(len(own), dtype=bool)
        low = float(score[label & tested].min()) if label.any() else 0.0
        lines.append(min(0.0, low) - SLACK)
        said = (score > 0) & tested
        hit = int((said & label).sum())
        report[f"{VIEWS[v]} {kind}"] = {
            "rows": len(inside), "cases": int(label[inside].sum()), "held_out_rows": int(out.sum()), "held_out_cases": int((label & out).sum()),
            "recall": hit / max(1, int((label & tested).sum())), "precision": hit / max(1, int(said.sum())), "line": lines[-1],
        }
        weights.append(w)
    return np.stack(weights), lines, report


def decide(weights: np.ndarray, lines: list[float], path: str, text: str | None) -> tuple[str, bool]:
    """The kind of a file, empty if it isn't a case, and whether a rule had to be asked. Of several kinds that which ``CLASSES`` names first."""
    seen, asked = views(path, text), False
    for w, line, (v, kind) in zip(weights, lines, CLASSES):
        score = _score(w, seen[v])
        if score >= SURE:
            return kind, asked
        if score > line:
            asked = True
            if said := rules(path, text)[v]:
                return said, asked
    return "", asked


def extension(path: str) -> Column:
    name = F.lower(F.element_at(F.split(F.col(path), "/"), -1))
    return F.when(name.rlike(r"^\.env(\.|$)"), F.lit("env")).when(name.startswith("dockerfile"), F.lit("dockerfile")).otherwise(F.regexp_extract(name, r"\.([a-z0-9]+)$", 1))


def _slug(path: str) -> Column:
    """How a path stands in a chunk's slug."""
    return F.lower(F.replace(F.replace(F.replace(F.col(path), F.lit("/"), F.lit("--")), F.lit("."), F.lit("-")), F.lit(" "), F.lit("-")))


def file_texts(files: DataFrame, documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """(file_id, path, size, text, repository) of every source file and text of it.

    A document without a text, or that is missing while its chunks are there, has the text of its chunks in their order.
    """
    newest = F.max(F.struct("modified_at", F.col("file_path").alias("path"), "size"))
    current = files.where("id IS NOT NULL AND file_path IS NOT NULL").groupBy(F.col("id").alias("file_id")).agg(newest.alias("n")).select("file_id", "n.path", "n.size")
    current = current.where(extension("path").isin(*SOURCE))
    blank = F.coalesce(F.trim(F.regexp_replace("text", r"\s+", " ")), F.lit("")) == ""
    texts = documents.where(F.col("file_id").isNotNull()).select("doc_id", "file_id", F.col("text"), F.col("source").alias("repository"))
    # slug: collection--path--number
    of_source = F.regexp_extract(F.lower("slug"), r"-([a-z0-9_]+)--[0-9]+$", 1)
    kept = chunks.where(F.col("text_content").isNotNull() & (~of_source.isin(*_NOT_SOURCE) | F.col("slug").isNull())).select(
        "document_id", "id", F.col("chunk_index").alias("at"), "text_content", F.regexp_replace(F.regexp_replace(F.lower("slug"), r"--[0-9]+$", ""), r"^.*?--", "").alias("slug")
    )
    whole = texts.where(~blank)
    lost = kept.join(whole.select(F.col("doc_id").alias("document_id")), "document_id", "left_anti")
    joined = F.concat_ws("\n", F.transform(F.array_sort(F.collect_set(F.struct("at", "id", "text_content"))), lambda x: x["text_content"]))
    lost = lost.groupBy("document_id").agg(joined.alias("chunk_text"), F.first("slug").alias("slug"))
    by_id = texts.where(blank).join(lost.withColumnRenamed("document_id", "doc_id"), "doc_id").select("file_id", F.col("chunk_text").alias("text"), "repository")
    by_slug = (
        lost.join(texts.select(F.col("doc_id").alias("document_id")), "document_id", "left_anti")
        .join(current.select("file_id", _slug("path").alias("slug")), "slug")
        .select("file_id", F.col("chunk_text").alias("text"), F.lit(None).cast("string").alias("repository"))
    )
    every = whole.select("file_id", "text", "repository").unionByName(by_id).unionByName(by_slug)
    return current.join(every, "file_id", "left")


def judged(files: DataFrame, documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """(file_id, kind, asked) of every text of every source file; ``kind`` is empty where the file is hand-written."""
    spark = files.sparkSession
    prepare(spark)
    rows = materialize(file_texts(files, documents, chunks), "sources")
    weights, lines, _ = train(rows, rows.count())
    held = spark.sparkContext.broadcast((weights, lines))  # seven times 262 145 weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, lines = held.value
        for batch in batches:
            kinds, asked = [], []
            for path, size, text in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3))):
                kind, close = decide(weights, lines, path, text)
                kinds.append(kind or ("blob" if size is not None and size > BLOB_BYTES else ""))
                asked.append(close)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kinds, pa.string()), pa.array(asked, pa.bool_())], names=["file_id", "kind", "asked"])

    return rows.select("file_id", "path", "size", "text").mapInArrow(run, "file_id long, kind string, asked boolean")


def not_handwritten(files: DataFrame, documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """(file_id, kind) of the source files that are generated, minified, third-party or data."""
    return judged(files, documents, chunks).where("kind <> ''").groupBy("file_id").agg(F.min("kind").alias("kind"))
