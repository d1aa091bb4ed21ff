"""Text functions, chunkers, file selection and parser routing over the whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.functions import globs, routing
from corvine.functions import text as T
from corvine.functions.embedding_tokens import WordPiece, encode
from corvine.operators import chunking
from corvine.plans import model
from corvine.session import table

FILTER = globs.FileFilter(include=["src/**/*.py", "*.md", "docs/*.txt", "internal/**/*.go", "config/[a-m]*/*.ya?l"], exclude=["vendor", "**/generator/**", "*_pb2.py", "node_modules/**"])
PARSERS = {".generated.ts": "skip", ".ts": "typescript", "*_pb2.py": "stub", "*.toml": "config", ".wiki": "wiki"}


def slugify(spark: SparkSession, sf: str) -> DataFrame:
    rows = model.documents(spark, sf).join(model.files(spark, sf).select("file_id", "file_path"), "file_id")
    slug = T.slugify(F.coalesce("collection", F.lit("")), F.col("file_path"))
    return rows.select("document_id", slug.alias("doc_slug"), T.chunk_slug(slug, F.lit(3)).alias("chunk_slug"))


def sha256_hash(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), T.content_hash(F.col("text")).alias("hash"))


def snippet50(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", T.snippet(F.col("text")).alias("snippet"), F.length("text").alias("chars"), F.octet_length("text").alias("bytes"))


def line_range(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").where(F.size(F.split("text", "\n")) >= 3)
    return rows.select("doc_id", T.line_range(F.col("text"), 2, 4).alias("lines"))


def worth_embedding(spark: SparkSession, sf: str) -> DataFrame:
    return model.chunk_rows(spark, sf, "text_content").where(T.worth_embedding(F.col("text_content"))).select("chunk_id").distinct()


def metadata_json(spark: SparkSession, sf: str) -> DataFrame:
    return model.files(spark, sf).select("file_id", T.metadata(F.col("file_path")).alias("metadata"), T.basename(F.col("file_path")).alias("name"), T.extension(F.col("file_path")).alias("extension"))


def chunk_fixed_split(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", "text", F.lit(1).alias("line_start"), F.size(F.split("text", "\n")).alias("line_end"))
    parts = chunking.fixed_split(rows, "text", "line_start", "line_end")
    return parts.select("doc_id", "part", "total_chars", "line_start", "line_end", F.sha2("text_content", 256).alias("hash"))


def chunk_markdown(spark: SparkSession, sf: str) -> DataFrame:
    pieces = chunking.chunked(table(spark, sf, "documents"), "text", ["doc_id"])
    return pieces.select("doc_id", "chunk_index", "total_chars", "line_start", "line_end", "section_num", "section_title", F.sha2("text_content", 256).alias("hash"))


def chunk_code(spark: SparkSession, sf: str) -> DataFrame:
    code = model.files(spark, sf).where(routing.parser_of(F.col("file_path")) == "code").select("file_id")
    rows = table(spark, sf, "documents").join(code, "file_id", "left_semi")
    return chunking.chunked(rows, "text", ["doc_id"], "code").select("doc_id", "chunk_index", "total_chars", "line_start", "line_end")


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.fence_map(chunking.lines_of(table(spark, sf, "documents"), "text", ["doc_id"]), ["doc_id"])


def md_fence_map(spark: SparkSession, sf: str) -> DataFrame:
    return _lines(spark, sf).groupBy("doc_id").agg(F.count("*").alias("lines"), F.sum(F.col("in_code").cast("int")).alias("code_lines"))


def md_headings(spark: SparkSession, sf: str) -> DataFrame:
    rows = chunking.sections(_lines(spark, sf), ["doc_id"]).where("level > 0")
    return rows.select("doc_id", "line_no", "level", "section_num", T.heading_title(F.col("line")).alias("title"))


def md_sections(spark: SparkSession, sf: str) -> DataFrame:
    rows = chunking.sections(_lines(spark, sf), ["doc_id"])
    return rows.groupBy("doc_id", "section_num").agg(F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"), F.sum(F.length("line") + 1).alias("chars"))


def md_section_asof(spark: SparkSession, sf: str) -> DataFrame:
    own = chunking.sections(_lines(spark, sf), ["doc_id"]).where("level > 0").groupBy("doc_id").agg(F.collect_list(F.struct("line_no", T.heading_title(F.col("line")).alias("title"))).alias("headings"))
    chunks = model.chunks(spark, sf, "document_id", "line_start").withColumnRenamed("document_id", "doc_id")
    return chunks.join(own, "doc_id").select("chunk_id", chunking.heading_at(F.col("headings"), F.col("line_start")).alias("title"))


def glob_filter(spark: SparkSession, sf: str) -> DataFrame:
    return model.files(spark, sf).where(FILTER.match(F.col("file_path"))).select("file_id")


def ancestor_prune(spark: SparkSession, sf: str) -> DataFrame:
    return model.files(spark, sf).where(FILTER.walked(F.col("file_path"))).select("file_id")


def default_filter(spark: SparkSession, sf: str) -> DataFrame:
    return model.files(spark, sf).where(globs.FileFilter().walked(F.col("file_path"))).select("file_id")


def parser_routing(spark: SparkSession, sf: str) -> DataFrame:
    return model.files(spark, sf).select("file_id", routing.parser_of(F.col("file_path"), PARSERS).alias("parser")).where("parser IS NOT NULL")


def bert_pretokenize(spark: SparkSession, sf: str) -> DataFrame:
    words = F.regexp_extract_all("text", F.lit(r"(\p{P}|[^\s\p{P}\p{Z}\x{85}]+)"), 1)
    return table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.size(words).alias("words"), F.sha2(F.array_join(words, "\n"), 256).alias("hash"))


def wordpiece_encode(spark: SparkSession, sf: str) -> DataFrame:
    """With a small vocabulary of letters and common endings, as no model's vocabulary is at hand."""
    pieces = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", *"abcdefghijklmnopqrstuvwxyz0123456789.,;:!?", *(f"##{c}" for c in "abcdefghijklmnopqrstuvwxyz0123456789"), "the", "and", "##ing", "##er", "##or", "##tion"]
    tokenizer = WordPiece({"vocab": {p: i for i, p in enumerate(pieces)}, "continuing_subword_prefix": "##"})
    rows = model.chunk_rows(spark, sf, "text_content").select("chunk_id", encode(F.col("text_content"), tokenizer, 512).alias("t"))
    return rows.select("chunk_id", F.aggregate("t.attention_mask", F.lit(0).cast("long"), lambda a, x: a + x).alias("tokens"), F.size("t.input_ids").alias("length")).distinct()


QUERIES = {
    f.__name__: f
    for f in (
        slugify, sha256_hash, snippet50, line_range, worth_embedding, metadata_json, chunk_fixed_split, chunk_markdown, chunk_code, md_fence_map, md_headings,
        md_sections, md_section_asof, glob_filter, ancestor_prune, default_filter, parser_routing, bert_pretokenize, wordpiece_encode,
    )
}

_SLUG = "lower(replace(replace(replace(coalesce(collection, '') || '--' || file_path, '/', '--'), '.', '-'), ' ', '-'))"
_WHITE = r"[\s\x{b}\p{Z}\x{85}]"
_LINES = rf"""
    l AS (SELECT doc_id, i AS line_no, s[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents WHERE text IS NOT NULL), unnest(range(1, len(s) + 1)) AS t(i)),
    m AS (SELECT *, regexp_matches(line, '^[\s\x{{b}}]*(```|~~~)') AS mark FROM l),
    c AS (SELECT *, mark OR coalesce(sum(mark::INT) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT % 2 = 1 AS in_code FROM m),
    h AS (SELECT *, CASE WHEN in_code THEN 0 ELSE length(regexp_extract(line, '^[ \t]*(#+|▼+)[ \t]', 1)) END AS level FROM c),
    n AS (SELECT *, (sum((level > 0)::INT) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING))::BIGINT AS section_num FROM h)"""
_TITLE = rf"regexp_replace(regexp_replace(line, '^{_WHITE}+', ''), '{_WHITE}+$', '')"


def _any(patterns: list[str], path: str = "file_path") -> str:
    return "(" + " OR ".join(patterns).format(p=path) + ")"


# the patterns of FILTER and PARSERS, each written for RE2 by hand
_INCLUDE = _any([r"regexp_matches({p}, '^src/(.*/)?[^/]*\.py$')", r"regexp_matches({p}, '\.md$')", r"regexp_matches({p}, '^docs/[^/]*\.txt$')", r"regexp_matches({p}, '^internal/(.*/)?[^/]*\.go$')", r"regexp_matches({p}, '^config/[a-m][^/]*/[^/]*\.ya[^/]l$')"])
_EXCLUDE = [r"{p} = 'vendor' OR ends_with({p}, '/vendor')", r"regexp_matches({p}, '(^|/)generator(/|$)')", r"regexp_matches({p}, '_pb2\.py$')", r"regexp_matches({p}, '^node_modules(/|$)')"]
_DEFAULT_EXCLUDE = "string_split('" + " ".join(globs.EXCLUDE) + "', ' ')"
_DEFAULT_INCLUDE = "string_split('" + " ".join(p[1:] for p in globs.INCLUDE if p.startswith("*")) + "', ' ')"
_FOLDERS = "list_transform(range(1, len(string_split(file_path, '/'))), lambda i: array_to_string(string_split(file_path, '/')[1:i], '/'))"
_EXT = r"regexp_extract(file_path, '(\.[^./]*)$', 1)"

SQL = {
    "slugify": f"WITH {model.SQL} SELECT document_id, {_SLUG} AS doc_slug, {_SLUG} || '--3' AS chunk_slug FROM m_documents JOIN m_files USING (file_id)",
    "sha256_hash": "SELECT doc_id AS document_id, sha256(text) AS hash FROM documents",
    "snippet50": "SELECT doc_id, CASE WHEN length(text) <= 50 THEN text ELSE substr(text, 1, 50) || '...' END AS snippet, length(text) AS chars, strlen(text) AS bytes FROM documents WHERE text IS NOT NULL",
    "line_range": "SELECT doc_id, array_to_string(string_split(text, chr(10))[2:4], chr(10)) AS lines FROM documents WHERE len(string_split(text, chr(10))) >= 3",
    "worth_embedding": rf"WITH {model.SQL} SELECT chunk_id FROM m_chunks WHERE strlen(regexp_replace(regexp_replace(coalesce(text_content, ''), '^{_WHITE}+', ''), '{_WHITE}+$', '')) >= 3",
    "metadata_json": rf"WITH {model.SQL} SELECT file_id, to_json(struct_pack(path := file_path))::VARCHAR AS metadata, string_split(file_path, '/')[-1] AS name, {_EXT} AS extension FROM m_files",
    "chunk_fixed_split": """
        WITH d AS (SELECT doc_id, text, length(text) AS n, len(string_split(text, chr(10))) AS last, ceil(greatest(length(text), 1) / 1500)::INT AS parts FROM documents WHERE text IS NOT NULL),
        e AS (SELECT *, ceil(n / parts)::INT AS size FROM d),
        p AS (SELECT *, part, substr(text, (part * size + 1)::BIGINT, size) AS own, substr(text, 1, (part * size)::BIGINT) AS head FROM e, unnest(range(0, parts)) AS t(part)),
        q AS (SELECT *, 1 + length(head) - length(replace(head, chr(10), '')) AS line_start FROM p)
        SELECT doc_id, part, length(own) AS total_chars, line_start, CASE WHEN parts = 1 THEN last ELSE least(line_start + length(own) - length(replace(own, chr(10), '')), last) END AS line_end, sha256(own) AS hash FROM q""",
    "md_fence_map": f"WITH {_LINES} SELECT doc_id, count(*) AS lines, sum(in_code::INT)::BIGINT AS code_lines FROM c GROUP BY 1",
    "md_headings": f"WITH {_LINES} SELECT doc_id, line_no, level, section_num, {_TITLE} AS title FROM n WHERE level > 0",
    "md_sections": f"WITH {_LINES} SELECT doc_id, section_num, min(line_no) AS first_line, max(line_no) AS last_line, sum(length(line) + 1)::BIGINT AS chars FROM n GROUP BY 1, 2",
    "md_section_asof": f"""
        WITH {model.SQL}, {_LINES}, g AS (SELECT doc_id, line_no, {_TITLE} AS title FROM n WHERE level > 0),
        k AS (SELECT chunk_id, line_start, document_id FROM m_chunks WHERE document_id IN (SELECT doc_id FROM g))
        SELECT chunk_id, coalesce(g.title, '') AS title FROM k ASOF LEFT JOIN g ON k.document_id = g.doc_id AND k.line_start >= g.line_no""",
    "glob_filter": f"WITH {model.SQL} SELECT file_id FROM m_files WHERE {_INCLUDE} AND NOT {_any(_EXCLUDE)}",
    "ancestor_prune": f"WITH {model.SQL}, a AS (SELECT *, {_FOLDERS} AS folders FROM m_files) SELECT file_id FROM a WHERE {_INCLUDE} AND NOT {_any(_EXCLUDE)} AND len(list_filter(folders, lambda f: {_any(_EXCLUDE, 'f')})) = 0",
    "default_filter": f"""
        WITH {model.SQL} SELECT file_id FROM m_files
        WHERE NOT list_has_any(string_split(file_path, '/'), {_DEFAULT_EXCLUDE}) AND (string_split(file_path, '/')[-1] = 'Dockerfile' OR len(list_filter({_DEFAULT_INCLUDE}, lambda e: ends_with(file_path, e))) > 0)""",
    "parser_routing": f"""
        WITH {model.SQL}, r AS (SELECT file_id, CASE
          WHEN ends_with(lower(file_path), '.generated.ts') THEN 'skip' WHEN ends_with(lower(file_path), '.wiki') THEN 'wiki' WHEN ends_with(lower(file_path), '.ts') THEN 'typescript'
          WHEN ends_with(lower(file_path), '_pb2.py') THEN 'stub' WHEN ends_with(lower(file_path), '.toml') THEN 'config'
          WHEN {_EXT} IN ({", ".join(f"'{e}'" for e in routing.MARKDOWN)}) THEN 'markdown'
          WHEN {_EXT} IN ({", ".join(f"'{e}'" for e in routing.CODE)}) OR string_split(file_path, '/')[-1] = 'Dockerfile' THEN 'code' END AS parser FROM m_files)
        SELECT * FROM r WHERE parser IS NOT NULL""",
    "bert_pretokenize": r"WITH w AS (SELECT doc_id, regexp_extract_all(text, '\p{P}|[^\s\x{b}\p{P}\p{Z}\x{85}]+') AS w FROM documents WHERE text IS NOT NULL) SELECT doc_id, len(w) AS words, sha256(array_to_string(w, chr(10))) AS hash FROM w",
}
