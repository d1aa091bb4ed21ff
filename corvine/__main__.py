"""``python -m corvine``: init, sync, embed, search, files, stats, version."""

from __future__ import annotations

import argparse
import json
import logging
import sys

from corvine import __version__


class JsonFormatter(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        return json.dumps({"time": self.formatTime(record), "level": record.levelname.lower(), "msg": record.getMessage()})


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="corvine")
    p.add_argument("-p", "--project", default=".", help="a folder in the workspace")
    p.add_argument("-v", "--verbose", action="store_true")
    p.add_argument("--log-format", choices=("minimal", "verbose", "json"), default="minimal")
    commands = p.add_subparsers(dest="command", required=True)
    commands.add_parser("init")
    commands.add_parser("version")
    stats = commands.add_parser("stats")
    stats.add_argument("what", nargs="?", choices=("root",))
    for name in ("sync", "embed", "files"):
        c = commands.add_parser(name)
        which = c.add_mutually_exclusive_group()
        which.add_argument("--all", action="store_true")
        which.add_argument("-c", "--collection")
        if name == "sync":
            c.add_argument("--no-prune", action="store_true")
        if name == "embed":
            c.add_argument("--rebuild", action="store_true")
            c.add_argument("--prune", action="store_true")
        if name == "files":
            c.add_argument("--limit", type=int, default=0)
            c.add_argument("--offset", type=int, default=0)
    s = commands.add_parser("search")
    s.add_argument("query", nargs="+")
    s.add_argument("-c", "--collection")
    s.add_argument("-m", "--mode", choices=("fts", "semantic", "hybrid"), default="hybrid")
    s.add_argument("--limit", type=int, default=5)
    s.add_argument("--rrfk", type=int, default=60)
    return p


def shown(hits: list, mode: str) -> str:
    """Hits as text: one after another, or, for full text, below their files."""
    out, last = [], None
    for n, h in enumerate(hits, 1):
        where = f"lines {h.line_start}-{h.line_end}" + (f", {h.section_title}" if h.section_title else "")
        if mode == "fts":
            if h.file_path != last:
                out.append(f"[{h.file_place}] {h.file_path} ({h.file_hits})")
                last = h.file_path
            out.append(f"    {where}: {h.snippet}")
        else:
            out += [f"[{n}] {h.file_path} ({where}) {h.rank:.4f}", f"    {h.snippet}"]
    return "\n".join(out) or "nothing found"


def main(args: list[str] | None = None, spark=None) -> int:
    a = parser().parse_args(args)
    if a.command == "version":
        print(__version__)
        return 0
    handler = logging.StreamHandler()
    handler.setFormatter(JsonFormatter() if a.log_format == "json" else logging.Formatter("%(asctime)s %(levelname)s %(name)s %(message)s" if a.log_format == "verbose" else "%(message)s"))
    logging.basicConfig(level=logging.DEBUG if a.verbose else logging.WARNING, handlers=[handler])
    logging.getLogger("py4j").setLevel(logging.WARNING)

    from pyspark.sql import SparkSession

    from corvine.functions.embedders import HashingEmbedder
    from corvine.operators.catalog import banner, files_of
    from corvine.sources.config import DEFAULT
    from corvine.workspace import Workspace

    spark = spark or SparkSession.builder.config("spark.ui.showConsoleProgress", "false").getOrCreate()
    ws = Workspace.find(spark, a.project)
    if a.command == "init":
        print(f"workspace at {ws.init().root}")
    elif a.command == "sync":
        print(ws.sync(a.collection, prune=not a.no_prune, every=a.all))
    elif a.command == "embed":
        print(f"{ws.embed(HashingEmbedder(), a.collection, every=a.all, rebuild=a.rebuild, prune=a.prune)} vectors")
    elif a.command == "search":
        hits = ws.search(" ".join(a.query), a.mode, a.collection or DEFAULT, a.limit, a.rrfk, None if a.mode == "fts" else HashingEmbedder())
        print(shown(hits.collect(), "fts" if "file_place" in hits.columns else a.mode))
    elif a.command == "files":
        own = None if a.all else a.collection or DEFAULT
        for r in ws.files(own, a.limit, a.offset).toLocalIterator():
            print(f"{r.file_path}\t{r.chunk_count} chunks\t{r.total_chars} chars")
        if line := banner(a.limit, a.offset, files_of(ws.tables.read("files"), ws.tables.read("documents"), own).count()):
            print(line)
    elif a.what == "root":
        print(ws.root)
    else:
        totals, per = ws.stats()
        print(json.dumps(totals.first().asDict()))
        for r in per.orderBy("collection").toLocalIterator():
            print(f"{r.collection}\t{r.documents} documents" + ("" if r.in_config else "\tnot configured"))
    return 0


if __name__ == "__main__":
    sys.exit(main())
