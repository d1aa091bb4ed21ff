"""A workspace: collections of files that are synchronised, embedded and searched.

    ws = Workspace(spark, "/data/docs").init()
    ws.sync()
    ws.embed(HashingEmbedder())
    ws.search("snapshot policy", mode="hybrid").show()
"""

from __future__ import annotations

import logging
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.functions import routing
from corvine.functions.embedders import Embedder, embedded
from corvine.functions.text import chunk_slug, metadata, slugify, worth_embedding
from corvine.operators import catalog, chunking, fulltext, fusion, sync, vectors
from corvine.operators.identifiers import allocated
from corvine.session import materialize
from corvine.sources.config import DEFAULT, Config
from corvine.sources.filetree import read_listed, read_tree
from corvine.sources.snapshots import Snapshots

MARKER = ".corvine"
POOL = 5  # times the limit: what each ranking brings to the fusion
MODES = ("fts", "semantic", "hybrid")
SCHEMAS = {
    "files": "file_id long, file_path string, filename string, size long, modified_at long, content_hash string",
    "documents": "document_id long, file_id long, collection string, slug string, chunk_count int, total_chars long, metadata string",
    "chunks": "chunk_id long, document_id long, collection string, chunk_index int, text_content string, total_chars int, line_start int, line_end int, section_num int, section_title string, slug string, metadata string",
    "vectors": "collection string, chunk_id long, embedding array<float>",
    "postings": "document_id long, chunk_id long, collection string, n_tokens int, position int, term string",
    "lengths": "document_id long, chunk_id long, n_tokens int",
}
KEYS = {"files": "file_id", "documents": "document_id", "chunks": "document_id", "vectors": "chunk_id", "postings": "document_id", "lengths": "document_id"}  # by which rows go
log = logging.getLogger("corvine")


@dataclass
class SyncResult:
    unchanged: int = 0
    added: int = 0
    modified: int = 0
    moved: int = 0
    deleted: int = 0


class Workspace:
    def __init__(self, spark: SparkSession, root: str | Path, store: str | None = None):
        """``store`` may put the tables elsewhere, such as a distributed file system."""
        self.spark, self.root = spark, Path(root)
        self.home = self.root / MARKER
        self.tables = Snapshots(spark, store or f"file://{self.home.resolve()}/tables", SCHEMAS, KEYS)

    @classmethod
    def find(cls, spark: SparkSession, start: str | Path) -> Workspace:
        """The workspace of a folder or of one above it; a new one there if there is none."""
        at = Path(start).resolve()
        return cls(spark, next((p for p in (at, *at.parents) if (p / MARKER).is_dir()), at))

    def init(self) -> Workspace:
        self.home.mkdir(parents=True, exist_ok=True)
        if not (self.home / "config.yml").exists():
            Config().save(self.home / "config.yml")
        return self

    @property
    def config(self) -> Config:
        return Config.load(self.home / "config.yml")

    def collections(self) -> list[str]:
        return sorted(self.config.collections)

    def _files_of(self, collection: str) -> DataFrame:
        own = self.tables.read("documents").where(F.col("collection") == collection).select("file_id", "document_id")
        return self.tables.read("files").join(own, "file_id")

    # -- synchronisation

    def sync(self, collection: str | None = None, prune: bool = True, every: bool = False, verify_hash: bool = False) -> SyncResult:
        """Bring a collection (or all of them) in line with its files; one atomic commit per collection."""
        if every and collection:
            raise ValueError("either all collections or one")
        total = SyncResult()
        for name in self.collections() if every else [collection or DEFAULT]:
            one = self._sync(name, prune, verify_hash)
            total = SyncResult(*(getattr(total, f) + getattr(one, f) for f in SyncResult.__dataclass_fields__))
        return total

    def _sync(self, name: str, prune: bool, verify_hash: bool) -> SyncResult:
        own = self.config.collection(name)
        prefix = "" if own.path in (".", "") else own.path.strip("/") + "/"
        folder = str(self.root / own.path)
        listed = read_tree(self.spark, folder, own.filter(), prefix=prefix, listing=True, errors=True)
        listed = materialize(listed.withColumn("parser", routing.parser_of(F.col("file_path"), own.parsers)), "listed")
        files, documents, chunks = (self.tables.read(t) for t in ("files", "documents", "chunks"))
        stored = self._files_of(name)
        # files of the same time and size aren't opened
        wanted = listed.where(F.col("error").isNull() & F.col("parser").isin(*chunking.PARSERS)).select("file_path", "size", "modified_at", "parser")
        known_as = stored.select("file_path", "size", "modified_at", F.col("content_hash").alias("_hash"), F.col("filename").alias("_name")).dropDuplicates(["file_path"])
        same = None if verify_hash else wanted.join(known_as, ["file_path", "size", "modified_at"]).where("_hash IS NOT NULL")
        read = read_listed(wanted if same is None else wanted.join(same, "file_path", "left_anti"), folder, prefix).join(wanted.select("file_path", "parser"), "file_path")
        columns = ["file_path", "filename", "size", "modified_at", "content_hash", "content", "error", "parser"]
        if same is not None:
            text = F.lit(None).cast("string")
            read = read.select(*columns).unionByName(same.select("file_path", F.col("_name").alias("filename"), "size", "modified_at", F.col("_hash").alias("content_hash"), text.alias("content"), text.alias("error"), "parser"))
        scan = materialize(read.select(*columns), "scan")
        for r in listed.where("error IS NOT NULL").select("file_path", "error").unionByName(scan.where("error IS NOT NULL").select("file_path", "error")).limit(20).toLocalIterator():
            log.warning("not read: %s: %s", r.file_path, r.error)
        scan = scan.where("error IS NULL").drop("error")
        states = materialize(sync.states(scan.select("file_path", "modified_at", "content_hash"), stored.select("file_path", "modified_at", "content_hash"), verify_hash, prune), "states")
        result = SyncResult(**sync.tallies(states).first().asDict())

        fresh = states.where("state IN ('added', 'modified')").select("file_path").join(scan, "file_path")
        known = files.select("file_path", F.col("file_id").alias("_known"))
        new_files, next_file = allocated(fresh.join(known, "file_path", "left_anti").select("file_path"), "file_id", self.tables.next_id("files"), ["file_path"])
        with_id = fresh.join(new_files.unionByName(known.select("file_path", F.col("_known").alias("file_id"))), "file_path")
        changed_files = with_id.select("file_id", "file_path", "filename", "size", "modified_at", "content_hash")
        refreshed = states.where("refresh").select("file_path", F.col("modified_at").alias("_at")).join(files, "file_path").withColumn("modified_at", F.col("_at")).select(*files.columns)

        # documents and chunks of changed files are made anew; those of paths that are gone go
        gone = states.where("state IN ('moved', 'deleted')").select("file_path").join(stored, "file_path").select("document_id", "file_id")
        replaced = with_id.select("file_id").join(stored.select("file_id", "document_id"), "file_id").select("document_id", "file_id")
        dropped = gone.unionByName(replaced)
        keys = ["file_id", "file_path"]
        pieces = None
        for parser in chunking.PARSERS:
            part = chunking.chunked(with_id.where(F.col("parser") == parser), "content", keys, parser)
            pieces = part if pieces is None else pieces.unionByName(part)
        pieces = materialize(pieces, "pieces")
        counts = pieces.groupBy(*keys).agg(F.count("*").cast("int").alias("chunk_count"))
        made = with_id.select("file_id", "file_path", F.length("content").cast("long").alias("total_chars")).join(counts, keys, "left").fillna(0, ["chunk_count"])
        made, next_document = allocated(made, "document_id", self.tables.next_id("documents"), ["file_path"])
        slug = slugify(F.lit(name), F.col("file_path"))
        new_documents = made.select("document_id", "file_id", F.lit(name).alias("collection"), slug.alias("slug"), "chunk_count", "total_chars", metadata(F.col("file_path")).alias("metadata"))
        numbered, next_chunk = allocated(pieces.join(new_documents.select("file_id", "document_id", "slug"), "file_id"), "chunk_id", self.tables.next_id("chunks"), ["file_path", "chunk_index"])
        new_chunks = numbered.withColumns({"collection": F.lit(name), "slug": chunk_slug(F.col("slug"), F.col("chunk_index")), "metadata": F.lit("{}")}).select(*chunks.columns)

        dropped = materialize(dropped.select("document_id").distinct(), "dropped")
        kept = documents.join(dropped, "document_id", "left_anti").select("file_id").unionByName(new_documents.select("file_id"))
        # a file stays while any collection has a document of it; the table of files has one short row each and is written anew
        all_files = sync.upserted(files, changed_files.unionByName(refreshed), "file_id").select(*files.columns).join(kept, "file_id", "left_semi")
        changes = {"replace": {"files": all_files}}
        if not fresh.isEmpty():
            new_chunks = materialize(new_chunks, "chunks")
            index, owner = fulltext.Index.of(new_chunks, distinct=True), new_chunks.select("chunk_id", "document_id")
            postings = index.all_postings().join(owner, "chunk_id").select("document_id", "chunk_id", "collection", "n_tokens", "position", "term")
            lengths = index.all_lengths().join(owner, "chunk_id").select("document_id", "chunk_id", "n_tokens")
            changes["append"] = {"documents": new_documents, "chunks": new_chunks, "postings": postings.repartitionByRange("term", "chunk_id").sortWithinPartitions("term", "chunk_id"), "lengths": lengths}
        if not dropped.isEmpty():
            lost = chunks.join(dropped, "document_id", "left_semi").select("chunk_id")
            changes["gone"] = {"documents": dropped, "chunks": dropped, "vectors": lost, "postings": dropped, "lengths": dropped}
        self.tables.commit(**changes, next_ids={"files": next_file, "documents": next_document, "chunks": next_chunk})
        log.info("synchronised %s: %s", name, result)
        return result

    # -- vectors

    def embed(self, embedder: Embedder, collection: str | None = None, every: bool = False, rebuild: bool = False, prune: bool = False) -> int:
        """Give vectors to chunks that have none; the number of new ones. ``rebuild`` makes all of the collection anew."""
        if every and collection:
            raise ValueError("either all collections or one")
        names = self.collections() if every else [collection or DEFAULT]
        for name in names:
            self.config.collection(name)
        chunks, stored = self.tables.read("chunks"), self.tables.read("vectors")
        if rebuild or prune:
            for name in names if rebuild else []:
                stored = vectors.without_collection(stored, name)
            stored = materialize(vectors.pruned(stored, chunks).select("collection", "chunk_id", "embedding") if prune else stored, "stored")
        wanted = catalog.pending(chunks.where(F.col("collection").isin(*names)), stored)
        new = materialize(wanted.select("collection", "chunk_id", embedded(F.col("text_content"), embedder).alias("embedding")), "vectors")
        if rebuild or prune:
            self.tables.commit(replace={"vectors": vectors.upsert(stored, new).select("collection", "chunk_id", "embedding")})
        else:
            self.tables.commit(append={"vectors": new})
        return new.count()

    # -- queries

    def search(self, query: str, mode: str = "hybrid", collection: str | None = DEFAULT, limit: int = 5, rrf_k: int = fusion.RRF_K, embedder: Embedder | None = None) -> DataFrame:
        """The best chunks with file_path, snippet and rank. ``collection`` None means all.

        Without an embedder, or without vectors, ``hybrid`` and ``semantic`` fall back to full text.
        """
        if mode not in MODES:
            raise ValueError(f"mode is one of {', '.join(MODES)}")
        if collection is not None:
            self.config.collection(collection)
        chunks, pool = self.tables.read("chunks"), limit * POOL
        if mode != "fts" and (embedder is None or self.tables.read("vectors").isEmpty()):
            log.warning("no vectors to search; full text only")
            mode = "fts"
        text = near = None
        if mode != "semantic":
            index = fulltext.Index(None, self.tables.read("postings"), self.tables.read("lengths"), True)  # kept up to date by sync
            text = fulltext.search(index, chunks.select("chunk_id"), query, collection, pool, with_snippet=False).select("chunk_id", "rank")
        if mode != "fts":
            asked = [float(x) for x in embedder.embed([query])[0]]
            near = vectors.top_k(self.tables.read("vectors"), asked, pool, collection).select("chunk_id", F.col("score").alias("rank"))
        if mode == "hybrid":
            hits = fusion.fused(text, near, pool, rrf_k).select("chunk_id", F.col("score").alias("rank"))
        else:
            hits = text if mode == "fts" else near
        shown = catalog.enriched(hits, chunks, self.tables.read("documents"), self.tables.read("files"))
        if mode == "fts":
            shown = fulltext.grouped_by_file(shown, limit)
        else:
            shown = shown.orderBy(F.desc("rank"), "chunk_id").limit(limit)
        from corvine.operators.query_grammar import QuerySyntaxError, parse, phrases

        try:
            wanted = phrases(parse(query))
        except QuerySyntaxError:
            if mode == "fts":
                raise
            wanted = []
        shown = fulltext.with_snippets(shown.join(chunks.select("chunk_id", "text_content"), "chunk_id"), wanted).drop("text_content")
        return shown.orderBy(*(["file_place"] if mode == "fts" else []), F.desc("rank"), "chunk_id")

    def files(self, collection: str | None = DEFAULT, limit: int = 0, offset: int = 0) -> DataFrame:
        if collection is not None:
            self.config.collection(collection)
        return catalog.page(catalog.files_of(self.tables.read("files"), self.tables.read("documents"), collection), limit, offset)

    def stats(self) -> tuple[DataFrame, DataFrame]:
        """Totals, and counts per collection with those that are only configured or only indexed."""
        files, documents, chunks = (self.tables.read(t) for t in ("files", "documents", "chunks"))
        configured = self.spark.createDataFrame([(c,) for c in self.collections()], "collection string")
        return catalog.totals(files, documents, chunks), catalog.reconciled(configured, catalog.per_collection(documents, chunks))

    def orphan_vectors(self) -> DataFrame:
        return vectors.orphans(self.tables.read("vectors"), self.tables.read("chunks")).select("collection", "chunk_id")

    def worth_embedding(self) -> DataFrame:
        return self.tables.read("chunks").where(worth_embedding(F.col("text_content")))

    def line_range(self, path: str, start: int, end: int) -> str:
        """Lines of a file below the root, from 1, the end clamped."""
        lines = (self.root / path).read_text(errors="replace").split("\n")
        if not 1 <= start <= len(lines) or end < start:
            raise ValueError(f"no lines {start} to {end} in {path}")
        return "\n".join(lines[start - 1 : end])
