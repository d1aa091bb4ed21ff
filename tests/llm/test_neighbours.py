import numpy as np
import pytest

from corvine.llm import neighbours as n
from corvine.llm.additive import Quantiser, Shard

SCHEMA = "id long, collection string, vector array<float>"


def vectors(rng, groups, copies, spread, dim=64):
    centres = rng.normal(size=(groups, dim))
    x = np.repeat(centres, copies, axis=0) + spread * rng.normal(size=(groups * copies, dim))
    return x.astype(np.float32)


def brute(rows, k, least):
    """Pairs (a, b) of one collection with a cosine of ``least``, one among the other's k best; ties by id."""
    out = set()
    by = {}
    for i, c, v in rows:
        if i is not None and c is not None and v is not None and len(v) == 64 and np.isfinite(v).all() and np.any(v):
            by.setdefault(c, {})[i] = np.asarray(v, dtype=np.float64) / np.linalg.norm(np.asarray(v, dtype=np.float64))
    for own in by.values():
        ids = sorted(own)
        x = np.array([own[i] for i in ids])
        s = np.round(x @ x.T, 9)
        for a in range(len(ids)):
            best = sorted((-s[a, b], ids[b]) for b in range(len(ids)) if b != a)[:k]
            out |= {(min(ids[a], j), max(ids[a], j)) for minus, j in best if -minus >= least}
    return out


def pairs(df):
    return {(min(r.id, r.neighbour), max(r.id, r.neighbour)) for r in df.collect()}


def rows_of(x, collection, first=0):
    return [(first + i, collection, v.tolist()) for i, v in enumerate(x)]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    return rows_of(vectors(rng, 150, 4, 0.2), "big") + rows_of(vectors(rng, 20, 3, 0.15), "small", 5000) + rows_of(rng.normal(size=(40, 64)), "alone", 9000)


def test_recall_and_no_false_pairs(spark, rows):
    want = brute(rows, 5, 0.9)
    got = pairs(n.neighbours(spark.createDataFrame(rows, SCHEMA), 5, 0.9))
    assert got <= want and len(got & want) >= 0.98 * len(want) and want


@pytest.mark.parametrize("leaf, shard, visit", [(100, 200, 1 << 19), (40, 64, 50), (5, 30, 1 << 19)])
def test_large_collections_are_split(spark, rows, monkeypatch, leaf, shard, visit):
    monkeypatch.setattr(n, "LEAF_ROWS", leaf)
    monkeypatch.setattr(n, "LEAF_ROOT", 1)
    monkeypatch.setattr(n, "SHARD_ROWS", shard)
    monkeypatch.setattr(n, "VISIT_ROWS", visit)
    want = brute(rows, 5, 0.9)
    got = pairs(n.neighbours(spark.createDataFrame(rows, SCHEMA), 5, 0.9))
    assert got <= want and len(got & want) >= 0.97 * len(want)


def test_a_cell_of_half_of_all_rows_is_split(spark, monkeypatch):
    monkeypatch.setattr(n, "LEAF_ROWS", 64)
    monkeypatch.setattr(n, "LEAF_ROOT", 1)
    rng = np.random.default_rng(11)
    x = np.concatenate([vectors(rng, 300, 4, 0.2), 3 * np.ones(64) + 0.05 * np.repeat(rng.normal(size=(300, 64)), 4, axis=0) + 0.01 * rng.normal(size=(1200, 64))])
    coded = rows_of(x, "c")
    df = spark.createDataFrame(coded, SCHEMA)
    small = spark.createDataFrame(rows_of(np.concatenate([x[:1200], x[1200:1204]]), "c"), SCHEMA)  # a quantiser that hardly knows the dense half
    got = pairs(n.neighbours(df, 3, 0.9, sample_from=small))
    want = brute(coded, 3, 0.9)
    assert len(got & want) >= 0.95 * len(want)


def test_layout_numbers_shards_by_counted_sizes(spark, monkeypatch):
    monkeypatch.setattr(n, "LEAF_ROWS", 20)
    monkeypatch.setattr(n, "LEAF_ROOT", 1)
    monkeypatch.setattr(n, "SHARD_ROWS", 100)
    rows = [("a", 1, i % 4) for i in range(400)] + [("a", 2, 0)] * 10 + [("a", 3, 7)] * 350 + [("tiny", 1, 1)] * 20
    got = {r.collection: r for r in n._layout(spark.createDataFrame(rows, "collection string, first int, second int")).collect()}
    assert set(got) == {"a"}
    a = got["a"]
    assert sorted(a.deep) == [1, 3] and set(a.shards) == {2} and sorted(a.inner[1]) == [0, 1, 2, 3]
    assert [a.inner[1][i] // 65536 for i in range(4)] == [0, 1, 2, 3] and a.shards[2] // 65536 == 4 and a.inner[3][7] == 4 * 65536 + 3


def test_without_threshold_every_row_has_k_neighbours(spark):
    rng = np.random.default_rng(5)
    data = rows_of(vectors(rng, 30, 8, 0.4), "c")
    got = n.neighbours(spark.createDataFrame(data, SCHEMA), 3).collect()
    assert len(got) == 240 * 3
    x = np.array([v for _, _, v in data], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    best = {(i, int(j)) for i in range(240) for j in np.argsort(-s[i])[:3]}
    assert len({(r.id, r.neighbour) for r in got} & best) >= 0.9 * 720
    assert all(abs(r.similarity - s[r.id, r.neighbour]) < 1e-5 for r in got)


def test_dirty_rows_copies_and_ties(spark):
    rng = np.random.default_rng(7)
    v = rng.normal(size=64).astype(np.float32)
    near = v + 0.05 * rng.normal(size=64)
    data = [(i, "c", v.tolist()) for i in range(1, 10)] + [(20, "c", near.tolist()), (21, "d", v.tolist())]
    bad = [(30, "c", None), (31, "c", [0.0] * 64), (32, "c", [1.0] * 5), (33, "c", [float("nan")] * 64), (34, "c", [float("inf")] * 64), (None, "c", v.tolist()), (35, None, v.tolist()), (36, "c", [None] * 64)]
    df = spark.createDataFrame(data + data[:3] + bad, SCHEMA)
    got = {(r.id, r.place): (r.neighbour, round(r.similarity, 3)) for r in n.neighbours(df, 5, 0.9).collect()}
    assert [got[(9, p)][0] for p in range(5)] == [1, 2, 3, 4, 5] and [got[(1, p)][0] for p in range(5)] == [2, 3, 4, 5, 6]
    assert [got[(20, p)][0] for p in range(5)] == [1, 2, 3, 4, 5] and not any(i in (21, *range(30, 37)) for i, _ in got)
    assert n.neighbours(df.limit(0), 5).count() == 0


def test_latest_result_counts_even_if_it_is_unusable(spark):
    df = spark.createDataFrame([(1, "2024-01-01", [1.0]), (1, "2024-02-01", None), (2, None, [2.0]), (2, "2023-01-01", [3.0]), (None, "2024-01-01", [4.0])], "id long, finished_at string, vector array<float>")
    assert {r.id: r.vector for r in n.latest_vectors(df).collect()} == {1: None, 2: [3.0]}


def test_quantiser_codes_better_than_its_first_book():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = Quantiser.train(x, books=4, entries=32)
    codes = q.encode(x)
    error = ((x - q.decode(codes)) ** 2).sum(1).mean()
    first = ((x - q.books[0][q.nearest_entries(x, 1)[:, 0]]) ** 2).sum(1).mean()
    assert error < 0.8 * first and error < ((x - q.decode(q.encode(x, beam=1))) ** 2).sum(1).mean() + 1e-6
    tables = q.tables(x[:5])
    looked_up = sum(tables[m][np.arange(5), codes[:5, m]] for m in range(q.m))
    assert np.allclose(looked_up, (x[:5] * q.decode(codes[:5])).sum(1), atol=1e-4)
    few = Quantiser.train(x[:3])
    code = few.encode(x[:3])
    decoded = few.decode(code)
    norm = np.linalg.norm(decoded, axis=1)
    whole = Shard(few, np.arange(3), x[:3], code, norm, np.einsum("nd,nd->n", x[:3], decoded) / norm, np.full(3, n.WHOLE), -1.0, 2)
    a, b, c, scored = whole.search(x[:3], np.arange(3), np.arange(3), np.full(3, n.WHOLE))
    assert len(a) == 6 and scored == 9


def test_search_gives_the_k_best_however_many_come_close():
    rng = np.random.default_rng(4)
    x = (2 + 0.3 * rng.normal(size=(900, 16))).astype(np.float32)  # all of them similar to each other
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = Quantiser.train(x, books=4, entries=16)
    code = q.encode(x)
    decoded = q.decode(code)
    norm = np.linalg.norm(decoded, axis=1)
    shard = Shard(q, np.arange(900), x, code, norm, np.einsum("nd,nd->n", x, decoded) / norm, np.full(900, n.WHOLE), 0.5, 4)
    a, b, c, _ = shard.search(x, np.arange(900), np.arange(900), np.full(900, n.WHOLE))
    s = x.astype(np.float64) @ x.T.astype(np.float64)
    np.fill_diagonal(s, -2)
    want = {(i, int(j)) for i in range(900) for j in np.argsort(-s[i])[:4]}
    assert len(a) < 1.05 * len(want) and len(want & set(zip(a.tolist(), b.tolist()))) >= 0.999 * len(want)


def test_nearest_pairs_are_the_nearest_sums_of_two_entries():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(2000, 8)).astype(np.float32)
    q = Quantiser.train(x, books=3, entries=16)
    first = q.nearest_entries(x[:20], 5)
    allowed = first % 2 == 0
    row, one, two = q.nearest_pairs(x[:20], first, allowed, 6)
    for r in range(20):
        sums = {(int(i), j): float(((x[r] - q.books[0][i] - q.books[1][j]) ** 2).sum()) for i in first[r][allowed[r]] for j in range(16)}
        best = set(sorted(sums, key=sums.get)[:6])
        assert {(int(a), int(b)) for a, b in zip(one[row == r], two[row == r])} == best
