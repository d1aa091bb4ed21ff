import os
from pathlib import Path

import pytest

from corvine.functions.embedders import HashingEmbedder
from corvine.functions.globs import FileFilter
from corvine.operators import catalog
from corvine.sources.config import Collection, Config
from corvine.sources.filetree import Walk, read_tree
from corvine.workspace import SyncResult, Workspace


def put(root: Path, **files: str) -> None:
    for name, text in files.items():
        at = root / name.replace("__", "/")
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text)


def tree(root: Path, paths: list[str]) -> None:
    for p in paths:
        at = root / p
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text("x")


@pytest.mark.parametrize(
    "files, include, exclude, paths, want",
    [
        ([], [], [], [".git/README.md", "node_modules/pkg/index.js", "dist/output.yaml", "docs/intro.md", "script.exe", ".github/b.yml", "pkg/__init__.py"], [".github/b.yml", "docs/intro.md", "pkg/__init__.py"]),
        (["subdir/doc.md"], [], ["subdir"], ["subdir/doc.md", "other.md"], ["subdir/doc.md"]),
        (["README.md"], [], [], ["README.md", "sub/README.md"], ["README.md"]),
        ([], ["**/*"], ["**/node_modules"], ["a.ts", "node_modules/b.ts", "x/node_modules/c/d.ts"], ["a.ts"]),
        ([], ["**/*"], ["node_modules/**"], ["a.ts", "node_modules/b.ts", "x/node_modules/d.ts"], ["a.ts", "x/node_modules/d.ts"]),
        (["a.md"], ["*.md"], [], ["a.md", "b/a.md", "c.md"], ["a.md", "b/a.md", "c.md"]),
        ([], ["docs/**/*", "tests/**/*", "src/*.go"], [], ["docs/intro.md", "main.go", "src/util.go", "src/main.ts", "tests/auth/test2.go"], ["docs/intro.md", "src/util.go", "tests/auth/test2.go"]),
    ],
)
def test_walk_and_its_column_form(spark, tmp_path, files, include, exclude, paths, want):
    from pyspark.sql import functions as F

    tree(tmp_path, paths)
    rules = FileFilter(files, include, exclude)
    assert sorted(Walk(str(tmp_path), rules).paths()) == sorted(want)
    rows = spark.createDataFrame([(p,) for p in paths], "p string")
    assert sorted(r.p for r in rows.where(rules.walked(F.col("p"))).collect()) == sorted(want)


def test_read_tree_reads_hidden_names_and_bad_bytes(spark, tmp_path):
    (tmp_path / "_posts").mkdir()
    (tmp_path / "_posts" / "a.md").write_bytes(b"a\xffb")
    (tmp_path / ".hidden.md").write_text("hello world")
    got = {r.file_path: r for r in read_tree(spark, str(tmp_path), prefix="p/").collect()}
    assert set(got) == {"p/_posts/a.md", "p/.hidden.md"}
    assert got["p/_posts/a.md"].content == "a�b"
    assert got["p/.hidden.md"].content_hash == "b94d27b9934d3e08a52e52d7da7dabfac484efe37a5380ee9088f7ace2efcde9"
    assert read_tree(spark, str(tmp_path / "none")).count() == 0


def test_five_states_then_search_and_embed(spark, tmp_path):
    put(tmp_path, **{"a.md": "# A\nalpha text", "b.md": "beta text", "c.md": "gamma text", "d.md": "delta text"})
    ws = Workspace(spark, tmp_path).init()
    assert ws.sync() == SyncResult(added=4)
    assert ws.sync() == SyncResult(unchanged=4)
    ids = {r.chunk_id for r in ws.tables.read("chunks").collect()}

    (tmp_path / "b.md").write_text("beta changed")
    os.utime(tmp_path / "b.md", (1, 1))
    (tmp_path / "c.md").unlink()
    (tmp_path / "d.md").rename(tmp_path / "moved.md")
    put(tmp_path, **{"new.md": "epsilon zeta"})
    assert ws.sync() == SyncResult(unchanged=1, added=1, modified=1, moved=1, deleted=1)
    after = {r.chunk_id: r.text_content for r in ws.tables.read("chunks").collect()}
    assert sorted(after.values()) == ["# A\nalpha text", "beta changed", "delta text", "epsilon zeta"]
    assert not {i for i, t in after.items() if t != "# A\nalpha text"} & ids  # ids aren't used again

    assert [r.file_path for r in ws.search("beta", mode="fts").collect()] == ["b.md"]
    assert ws.search("gamma", mode="fts").count() == 0
    assert [r.file_path for r in ws.search("beta", embedder=HashingEmbedder()).collect()] == ["b.md"]  # no vectors yet
    assert ws.embed(HashingEmbedder()) == 4 and ws.embed(HashingEmbedder()) == 0 and ws.embed(HashingEmbedder(), rebuild=True) == 4
    assert ws.search("delta text", mode="semantic", embedder=HashingEmbedder(), limit=1).first().file_path == "moved.md"
    assert ws.search("epsilon zeta", embedder=HashingEmbedder(), limit=2).first().file_path == "new.md"
    (tmp_path / "moved.md").unlink()
    ws.sync()
    assert ws.tables.read("vectors").count() == 3 and ws.orphan_vectors().count() == 0
    with pytest.raises(ValueError):
        ws.search("a", mode="other")
    with pytest.raises(KeyError):
        ws.search("a", collection="other")


def test_two_collections_share_a_file(spark, tmp_path):
    put(tmp_path, docs__a="")
    put(tmp_path, **{"docs__a.md": "shared words", "docs__b.txt": "not indexed"})
    ws = Workspace(spark, tmp_path).init()
    Config({"docs": Collection(path="docs")}).save(ws.home / "config.yml")
    assert ws.sync(every=True) == SyncResult(added=2)
    totals, per = ws.stats()
    assert (totals.first().total_files, totals.first().total_documents, totals.first().total_chars) == (1, 2, 24)
    assert {r.collection: r.documents for r in per.collect()} == {"default": 1, "docs": 1}
    Config({"docs": Collection(path="docs", exclude=["*.md"])}).save(ws.home / "config.yml")
    assert ws.sync("docs") == SyncResult(deleted=1)
    assert [r.file_path for r in ws.files("default").collect()] == ["docs/a.md"]
    assert ws.files("docs").count() == 0


def test_pages(spark):
    rows = spark.createDataFrame([(f"f{i}",) for i in range(5)], "file_path string")
    assert [r[0] for r in catalog.page(rows, 2, 1).collect()] == ["f1", "f2"]
    assert catalog.page(rows, 0, 3).count() == 5 and catalog.page(rows, 2, 9).count() == 0
    assert catalog.banner(2, 1, 5) == "Showing 2-3 of 5" and catalog.banner(0, 3, 5) == "" and catalog.banner(9, 0, 5) == ""


def test_snapshots_add_parts_and_let_keys_go(spark, tmp_path, monkeypatch):
    from corvine.sources.snapshots import Snapshots

    monkeypatch.setattr(Snapshots, "FAN", 3)
    rows = lambda *ids: spark.createDataFrame([(i, f"t{i}") for i in ids], "id long, t string")
    keys = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id long")
    s = Snapshots(spark, f"file://{tmp_path}/s", {"a": "id long, t string", "b": "id long, t string"}, {"a": "id", "b": "id"})
    ids = lambda name: sorted(r.id for r in s.read(name).collect())
    assert ids("a") == [] and s.next_id("a") == 1
    s.commit(append={"a": rows(1, 2), "b": rows(9)}, next_ids={"a": 3})
    s.commit(append={"a": rows(3)}, gone={"a": keys(1)})
    assert ids("a") == [2, 3] and ids("b") == [9] and s.next_id("a") == 3
    for i in range(4, 9):
        s.commit(append={"a": rows(i)}, gone={"a": keys(i - 1)})
    assert ids("a") == [2, 8] and len(s._now()["tables"]["a"]["parts"]) <= 3
    with monkeypatch.context() as m:
        m.setattr(s.pointer, "create", lambda value: (_ for _ in ()).throw(OSError("killed")))
        with pytest.raises(OSError):
            s.commit(replace={"a": rows(77)}, gone={"b": keys(9)})
    assert ids("a") == [2, 8] and ids("b") == [9]
    s.vacuum()
    assert ids("a") == [2, 8] and len(list((tmp_path / "s" / "a").iterdir())) <= 6


def test_unchanged_files_are_not_opened_again(spark, tmp_path):
    import os

    put(tmp_path, **{"docs__a.md": "shared words", "docs__b.md": "other words"})
    ws = Workspace(spark, tmp_path).init()
    Config({"docs": Collection(path="docs")}).save(ws.home / "config.yml")
    assert ws.sync("docs").added == 2
    a = tmp_path / "docs" / "a.md"
    was = a.stat()
    a.write_text("SHARED WORDS")  # another text of the same size and time: only who opens the file sees it
    os.utime(a, ns=(was.st_atime_ns, was.st_mtime_ns))
    assert ws.sync("docs") == SyncResult(unchanged=2)
    assert ws.sync("docs", verify_hash=True) == SyncResult(unchanged=1, modified=1)


def test_walk_errors_are_rows(spark, tmp_path):
    from corvine.functions.globs import FileFilter
    from corvine.sources.filetree import read_tree

    put(tmp_path, **{"docs__a.md": "words"})
    (tmp_path / "docs" / "x.md").symlink_to(tmp_path / "nowhere.md")
    rules = FileFilter([], ["**/*.md"], [])
    got = {r.file_path: r for r in read_tree(spark, str(tmp_path), rules, errors=True).collect()}
    assert got["docs/x.md"].error and got["docs/x.md"].size is None and got["docs/a.md"].error is None and got["docs/a.md"].content == "words"
    assert [r.file_path for r in read_tree(spark, str(tmp_path), rules).collect()] == ["docs/a.md"]
    assert [(r.file_path, r.size, r.content_hash) for r in read_tree(spark, str(tmp_path), rules, listing=True).collect()] == [("docs/a.md", 5, None)]
    assert read_tree(spark, str(tmp_path / "none"), rules, errors=True).first().error
