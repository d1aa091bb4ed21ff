import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvine.functions import embedding_tokens, globs, routing
from corvine.functions import text as T
from corvine.functions.embedders import HashingEmbedder, embedded
from corvine.functions.vectors import inner_product, literal, mean_pooled, norm, normalized
from corvine.operators import fusion, sync, vectors
from corvine.sources.config import Collection, Config


@pytest.mark.parametrize(
    "files, include, exclude, want",
    [
        (["README.md", "index.html"], [], [], {"docs/README.md": True, "index.html": True, "sub/README.md": True, "docs/intro.md": False, "style.css": False}),
        ([], ["*.md", "*.go"], [], {"docs/intro.md": True, "main.go": True, "style.css": False}),
        ([], ["docs/**/*", "tests/**/*", "src/*.go"], [], {"docs/intro.md": True, "main.go": False, "src/util.go": True, "src/main.ts": False, "tests/auth/test2.go": True}),
        (["notes.txt"], ["*.go"], ["*.txt", "*.go"], {"notes.txt": True, "main.go": True, "README.md": False}),
        ([], ["**/*"], ["**/node_modules/**"], {"a/node_modules/b.ts": False, "node_modules/c/d.ts": False, "src/a.ts": True}),
        ([], ["**/*"], ["node_modules/**"], {"node_modules/a.ts": False, "x/node_modules/a.ts": True}),
        ([], ["**/*"], ["**/node_modules/*.ts"], {"node_modules/a.ts": False, "x/node_modules/a.ts": False, "node_modules/b/c.ts": True}),
        ([], ["[a-c]?.m[!d]", "x\\*.md", "bad[.md"], [], {"ax.mx": True, "dx.mx": False, "ax.md": False, "x*.md": True, "xy.md": False, "bad[.md": False}),
    ],
)
def test_filter(spark, files, include, exclude, want):
    rules = globs.FileFilter(files, include, exclude)
    rows = spark.createDataFrame([(p,) for p in want], "p string")
    assert {r.p: r.m for r in rows.select("p", rules.match(F.col("p")).alias("m")).collect()} == want


@pytest.mark.parametrize("patterns, folders", [(["src/*/file.go"], ["src"]), (["**/*.md"], []), (["src/a.go", "*.md"], []), (["docs/x/*.md", "src/*"], ["docs/x", "src"])])
def test_include_folders(patterns, folders):
    assert globs.include_folders(patterns) == folders


def test_folders_are_pruned_below_the_root_only(spark):
    rows = spark.createDataFrame([("vendor/a.go",), ("x/vendor/b/c.go",), ("vendor",), ("avendor/a.go",)], "p string")
    assert [r.p for r in rows.where(globs.folder_pruned(F.col("p"), ["vendor"])).collect()] == ["vendor/a.go", "x/vendor/b/c.go"]
    assert rows.where(globs.folder_pruned(F.col("p"), ["*"])).count() == 3  # the root itself is never tested


def test_routing(spark):
    parsers = {"hello.md": "hello", ".md": "markdown", ".rfc.md": "rfc", "*.js": "js", "a*.js": "long"}
    want = {"hello.md": "hello", "doc.rfc.md": "rfc", "other.MD": "markdown", "script.js": "js", "ab.js": "long", "style.css": "code", "x/Dockerfile": "code", "file.unknown": None, "noext": None, "A.PY": None}
    rows = spark.createDataFrame([(p,) for p in want], "p string")
    assert {r.p: r.m for r in rows.select("p", routing.parser_of(F.col("p"), parsers).alias("m")).collect()} == want


def test_text_functions(spark):
    row = spark.createDataFrame([("a/b c.md", "hello", "   x\n", "l1\nl2\nl3", "\t## T ")], "path string, t string, w string, lines string, h string").select(
        T.slugify(F.lit("C"), F.col("path")).alias("slug"), T.chunk_slug(F.lit("s"), F.lit(2)).alias("chunk"), T.snippet(F.col("t"), 3).alias("cut"), T.snippet(F.col("t"), 5).alias("whole"),
        T.trimmed(F.col("w")).alias("trimmed"), T.worth_embedding(F.col("w")).alias("worth"), T.line_range(F.col("lines"), 2, 9).alias("range"), T.heading_level(F.col("h")).alias("level"),
        T.heading_title(F.col("h")).alias("title"), T.content_hash(F.lit("hello world")).alias("hash"), T.tokens(F.lit("Élan naïve x_y ß")).alias("tokens"), T.metadata(F.lit('a"b')).alias("meta"),
    ).first()
    assert row.slug == "c--a--b-c-md" and row.chunk == "s--2" and (row.cut, row.whole) == ("hel...", "hello")
    assert (row.trimmed, row.worth, row.range, row.level, row.title) == ("x", False, "l2\nl3", 2, "## T")
    assert row.hash == "b94d27b9934d3e08a52e52d7da7dabfac484efe37a5380ee9088f7ace2efcde9"
    assert row.tokens == ["elan", "naive", "x", "y", "ß"] and json.loads(row.meta) == {"path": 'a"b'}
    for bad in ((0, 1), (4, 5), (2, 1)):
        with pytest.raises(Exception, match="no lines"):
            spark.createDataFrame([("a\nb\nc",)], "t string").select(T.line_range(F.col("t"), *bad)).collect()


@pytest.mark.parametrize("x, c, left, right, want", [(20, 20, 5, 0.5, 0.5), (22, 20, 5, 0.5, 0.7310585786300049), (19, 20, 5, 0.5, 0.0066928509242848554), (0.8, 0.6, 0.5, 5, 0.731058578630005), (0, 0.6, 0.5, 5, 0.425557483188341)])
def test_sigmoid(spark, x, c, left, right, want):
    assert spark.range(1).select(T.sigmoid(F.lit(float(x)), float(c), float(left), float(right))).first()[0] == pytest.approx(want, abs=1e-12)


def test_fusion(spark):
    text, near = (spark.createDataFrame(rows, "chunk_id long, rank double") for rows in ([(1, 0.9), (2, 0.8)], [(2, 0.7), (3, 0.6)]))
    got = [(r.chunk_id, r.score, r.in_text, r.in_vector) for r in fusion.fused(text, near, 10).collect()]
    assert [g[0] for g in got] == [2, 1, 3] and [g[2:] for g in got] == [(True, True), (True, False), (False, True)]
    assert [g[1] for g in got] == pytest.approx([0.02633328358924246, 0.01639344262295082, 0.008064516129032258], abs=1e-12)
    assert fusion.fused(text, near, 2).count() == 2 and fusion.fused(text.limit(0), near.limit(0), 5).count() == 0


def test_vector_search(spark):
    unit = lambda i: [1.0 if j == i else 0.0 for j in range(4)]
    rows = spark.createDataFrame([("c", 10, unit(0)), ("c", 20, unit(1)), ("c", 30, unit(2)), ("d", 5, unit(0)), ("c", 40, None), ("c", 50, [1.0])], "collection string, chunk_id long, embedding array<float>")
    assert [tuple(r) for r in vectors.top_k(rows, unit(0), 2, "c").collect()] == [(10, 1.0), (20, 0.0)]
    assert vectors.top_k(rows, unit(0), 99).count() == 4 and vectors.top_k(rows.limit(0), unit(0), 3).count() == 0
    asked = spark.createDataFrame([(1, unit(0)), (2, unit(2)), (3, None)], "query_id long, embedding array<float>")
    got = [(r.query_id, r.chunk_id, r.place) for r in vectors.batch_top_k(rows, asked, 2).orderBy("query_id", "place").collect()]
    assert got == [(1, 5, 1), (1, 10, 2), (2, 30, 1), (2, 5, 2)]
    assert vectors.batch_top_k(rows, asked.limit(0), 2).count() == 0
    ids = spark.createDataFrame([(20,), (30,), (999,)], "chunk_id long")
    assert sorted(r.chunk_id for r in vectors.remove(rows, ids).collect()) == [5, 10, 40, 50]
    assert vectors.upsert(rows, rows.where("chunk_id = 10")).count() == 6


def test_vector_expressions(spark):
    row = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0], [[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]], [1, 1, 0])], "v array<float>, z array<float>, s array<array<float>>, m array<int>").select(
        norm(F.col("v")).alias("n"), normalized(F.col("v")).alias("u"), normalized(F.col("z")).alias("z"), mean_pooled(F.col("s"), F.col("m")).alias("p"), inner_product(F.col("v"), literal([1, 2])).alias("i"), inner_product(F.col("v"), literal([1])).alias("x")
    ).first()
    assert row.n == 5 and row.u == pytest.approx([0.6, 0.8]) and row.z == [0, 0] and row.p == [2, 3] and row.i == 11 and row.x is None


def test_sync_tallies(spark):
    schema = "file_path string, modified_at long, content_hash string"
    was = spark.createDataFrame([("a", 1, "A"), ("b", 1, "B"), ("c", 1, "C"), ("d", 1, "D"), ("t", 1, "T")], schema)
    now = spark.createDataFrame([("a", 1, "A"), ("b", 2, "B2"), ("e", 2, "C"), ("n", 2, "N"), ("t", 5, "T")], schema)
    states = {r.file_path: (r.state, r.refresh) for r in sync.states(now, was).collect()}
    assert states == {"a": ("unchanged", False), "b": ("modified", False), "c": ("moved", False), "d": ("deleted", False), "e": ("added", False), "n": ("added", False), "t": ("unchanged", True)}
    assert sync.tallies(sync.states(now, was)).first().asDict() == {"unchanged": 2, "added": 1, "modified": 1, "moved": 1, "deleted": 1}
    assert sync.tallies(sync.states(now.limit(0), was.limit(0))).first().asDict() == dict.fromkeys(sync.STATES, 0)
    quiet = spark.createDataFrame([("a", 1, "other")], schema)
    assert sync.states(quiet, was, prune=False).first().state == "unchanged"
    assert sync.states(quiet, was, verify_hash=True, prune=False).first().state == "modified"


def test_wordpiece(tmp_path):
    vocab = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "un", "##aff", "##able", "cafe", "!", "$x"]
    at = tmp_path / "t.json"
    at.write_text(json.dumps({"model": {"type": "WordPiece", "vocab": {t: i for i, t in enumerate(vocab)}, "continuing_subword_prefix": "##"}}))
    t = embedding_tokens.load(str(at))
    assert t.ids("Unaffable Café! $x zzz " + "u" * 51) == [4, 5, 6, 7, 8, 9, 1, 1]
    assert embedding_tokens.tensors(t, "cafe", 5) == ([2, 7, 3, 0, 0], [1, 1, 1, 0, 0], [0] * 5)
    assert embedding_tokens.tensors(t, "cafe " * 9, 4) == ([2, 7, 7, 3], [1] * 4, [0] * 4)


def test_unigram(tmp_path):
    vocab = [["<s>", 0.0], ["<pad>", 0.0], ["</s>", 0.0], ["<unk>", -10.0], ["▁ab", -1.0], ["▁a", -2.0], ["b", -2.0], ["▁", -3.0], ["c", -1.0]]
    at = tmp_path / "u.json"
    at.write_text(json.dumps({"model": {"type": "Unigram", "vocab": vocab, "unk_id": 3}}))
    t = embedding_tokens.load(str(at))
    assert t.ids("AB c") == [4, 7, 8] and t.ids("") == [] and t.ids("axb") == [7, 3, 3, 6]  # the unknown step from the mark replaces the better piece
    at.write_text(json.dumps({"model": {"type": "BPE"}}))
    with pytest.raises(ValueError):
        embedding_tokens.load(str(at))


def test_embedded(spark):
    rows = spark.createDataFrame([(1, "some words"), (2, None), (3, "some words")], "id int, t string")
    got = {r.id: r.v for r in rows.select("id", embedded(F.col("t"), HashingEmbedder(16)).alias("v")).collect()}
    assert got[1] == got[3] and math.isclose(np.linalg.norm(got[1]), 1, abs_tol=1e-6) and not any(got[2])


def test_config_round_trip(tmp_path):
    config = Config({"docs": Collection("docs", {".md": "markdown"}, [], ["*.md"], []), "default": Collection("elsewhere")})
    config.save(tmp_path / "c.yml")
    again = Config.load(tmp_path / "c.yml")
    assert again.collections["docs"] == config.collections["docs"] and again.collections["default"].path == "."
    assert Config.load(tmp_path / "none.yml").collections.keys() == {"default"}
    with pytest.raises(KeyError):
        again.collection("other")
