import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corvine.llm import leaks, lexicon, repetition, tokenize
from corvine.llm.words import words


@pytest.fixture(scope="module")
def reference():
    tiktoken = pytest.importorskip("tiktoken")
    pytest.importorskip("public_tokenizers")
    rank = tokenize.ranks(tokenize.vocabulary_path())
    return tiktoken.Encoding("own", pat_str=tokenize.WORDS.pattern, mergeable_ranks=rank, special_tokens={})


TEXTS = ["", None, "   ", "\n\n\t x", "Hello world's <|endoftext|> 123456 été 你好世界 🙂🙂", "a" * 5000, "don't  stop\r\n\r\n", "x=1;" * 300, " ﻿\u2028b\x85c", "𝒜𝓃𝑔𝓁𝑒 ñandú"]


def test_ids_are_the_tokenizer_s(spark, reference):
    rows = [(i, t) for i, t in enumerate(TEXTS * 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.ids for r in tokenize.encode(df.repartition(3), "text", "doc_id").collect()}
    assert got == {i: reference.encode_ordinary(t) if t else [] for i, t in rows}
    assert reference.decode(got[4]) == TEXTS[4]
    assert tokenize.encode(df.limit(0), "text", "doc_id").count() == 0


@settings(max_examples=80, deadline=None)
@given(st.text(min_size=1, max_size=200))
def test_merges(reference, text):
    rank = tokenize.ranks(tokenize.vocabulary_path())
    assert [i for w in tokenize.WORDS.findall(text) for i in tokenize.merge(w.encode(), rank)] == reference.encode_ordinary(text)


def test_the_json_form_has_the_same_ranks(reference):
    import public_tokenizers

    one, two = tokenize.ranks(tokenize.vocabulary_path()), tokenize.ranks(public_tokenizers.path("byte_bpe_50k.json"))
    assert all(two[t] == i for t, i in one.items())


@settings(max_examples=60, deadline=None)
@given(st.sets(st.binary(min_size=1, max_size=6), max_size=40), st.lists(st.binary(min_size=1, max_size=7), max_size=20))
def test_transducer(tmp_path_factory, accepted, others):
    own = sorted(accepted)
    at = tmp_path_factory.mktemp("lexicon") / "l"
    at.write_bytes(lexicon.to_bytes(lexicon.build(own, [[i, i + 1] for i in range(len(own))])))
    l = lexicon.Lexicon(str(at))
    if own:
        assert l.index(own).tolist() == list(range(len(own)))
    if others:
        assert [i >= 0 for i in l.index(others)] == [o in accepted for o in others]


def test_transducer_is_minimal():
    arrays = lexicon.build([b"tap", b"taps", b"top", b"tops"], [[0]] * 4)
    assert len(arrays["final"]) - 1 == 5  # t, (a|o), p, s


def brute_leak(document, item):
    d, i = words(document), words(item)
    s = min(13, len(i))
    return s > 0 and bool({tuple(d[k : k + s]) for k in range(len(d) - s + 1)} & {tuple(i[k : k + s]) for k in range(len(i) - s + 1)})


def leak_rows(spark, seed=1):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    some = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    items = [(i, some(r.choice([1, 3, 12, 13, 14, 40]))) for i in range(20)] + [(90, None), (91, ""), (92, "...")]
    documents = []
    for k in range(120):
        tokens = some(r.randrange(0, 60)).split()
        own = words(r.choice(items[:20])[1])
        cut = own[r.randrange(0, 3) : len(own) - r.randrange(0, 3)]
        if k % 2:
            tokens[len(tokens) // 2 : len(tokens) // 2] = cut
        documents.append((k, ("; " if k % 3 else "\n").join(t.upper() if k % 5 == 0 else t for t in tokens)))
    documents += [(500, None), (501, ""), (502, "!")]
    df = spark.createDataFrame([(*d, 1) for d in documents + documents[:9]], "doc_id long, text string, key int").repartition(3)
    return documents, items, df, spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("bound", [leaks.BROADCAST_BYTES, 0])
def test_leaks_by_brute_force(spark, monkeypatch, bound):
    monkeypatch.setattr(leaks, "BROADCAST_BYTES", bound)
    documents, items, df, item_df = leak_rows(spark)
    got = [(r.doc_id, r.item_id) for r in leaks.leaked(leaks.leaks(df, "text", "doc_id", item_df)).collect()]
    assert sorted(got) == sorted({(d, i) for d, t in documents for i, u in items if brute_leak(t, u)}) and len(got) > 30
    assert leaks.leaks(df, "text", "doc_id", item_df.limit(0)).count() == 0


def test_tiles_are_greedy_and_count_reordered_passages():
    item = [f"i{k}" for k in range(30)]
    document = ["x"] + item[20:30] + ["y"] + item[0:18] + ["z"] + item[18:20]
    tiles = leaks.tile(document, item, 5)
    assert tiles == [(12, 0, 18), (1, 20, 10)]
    assert leaks.tile(["a"] * 20, ["a"] * 8, 3) == [(0, 0, 8)]
    assert leaks.tile([], item) == [] and leaks.tile(item, item) == [(0, 0, 30)]


def brute_share(text, run=8):
    w = words(text)
    seen, again, n = set(), 0, len(w) - run + 1
    for k in range(max(0, n)):
        t = tuple(w[k : k + run])
        again += t in seen
        seen.add(t)
    return again / n if n > 0 else 0.0


def repetition_texts():
    r = random.Random(2)
    out = [None, "", "one two", "a b c d e f g h", "a b c d e f g h i", "a " * 9, "A-b. " * 40, "x" * 100]
    for k in range(150):
        w = [f"v{r.randrange(40)}" for _ in range(r.randrange(5, 80))]
        piece = w[: r.randrange(1, len(w))]
        out.append(" ".join(w + piece * r.randrange(0, 4)))
    return out


def test_repetition_by_brute_force(spark):
    texts = repetition_texts()
    df = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(texts)], "doc_id long, text string, share double").repartition(3)
    want = {i: brute_share(t) for i, t in enumerate(texts)}
    got = {r.doc_id: r.share for r in repetition.repetitive(df, "text", "doc_id").collect()}
    assert got == {i: s for i, s in want.items() if s >= 0.3} and 20 < len(got) < 140
    assert {r.doc_id: r.run_share for r in repetition.measure(df, "text", "doc_id").collect()} == want
    assert repetition.repetitive(df.limit(0), "text", "doc_id").count() == 0


def test_rules_never_reject_a_case():
    for t in repetition_texts():
        x = repetition._Text(t)
        if repetition.exact_share(x, 8) >= 0.3:
            assert all(rule(x, 8, 0.3) for rule in repetition.RULES.values())


def test_rules_are_put_in_order_of_rejections_per_second(monkeypatch):
    import time

    def slow(x, run, least):
        time.sleep(0.001)
        return False

    monkeypatch.setattr(repetition, "RULES", {"slow": slow, "never": lambda *_: True, "fast": lambda *_: False})
    assert repetition.order_rules(["a b"] * 5) == ["fast", "slow"]


def test_words():
    assert words("Été_2-Foo's naïve ３") == ["été", "2", "foo", "s", "naïve", "３"] and words(None) == [] and words("İstanbul x") == ["i̇stanbul", "x"]


def test_tiles_do_not_depend_on_batches_or_on_the_bound(spark, monkeypatch):
    item = " ".join(f"w{i}" for i in range(20))
    texts = ["x y " + " ".join(f"w{i}" for i in range(9)), " ".join(f"w{i}" for i in range(9, 20)) + " z", item, "a b c"]  # the first two hold a seed only strung together
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    items = spark.createDataFrame([(1, item), (2, "a b c"), (3, ""), (4, None)], "item_id long, text string")
    got = []
    for size, bound in ((1, leaks.BROADCAST_BYTES), (10_000, leaks.BROADCAST_BYTES), (10_000, 0)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        monkeypatch.setattr(leaks, "BROADCAST_BYTES", bound)
        got.append(sorted(tuple(r) for r in leaks.leaks(df, "text", "doc_id", items).collect()))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got[0] == got[1] == got[2] and [(r[0], r[1]) for r in got[0]] == [(2, 1), (3, 2)]


@pytest.mark.parametrize("bound", [leaks.BROADCAST_BYTES, 0])
def test_reordered_passages_are_covered(spark, monkeypatch, bound):
    monkeypatch.setattr(leaks, "BROADCAST_BYTES", bound)
    parts = [[f"p{k}q{i}" for i in range(7)] for k in range(4)]
    item = " ".join(sum(parts, []))
    texts = [" ".join(sum(([*parts[k], "between"] for k in (3, 1, 0, 2)), [])), " ".join(parts[1]) + " and no more of it", "something else"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame([(5, item)], "item_id long, text string")
    assert leaks.leaks(df, "text", "doc_id", items).count() == 0  # no run of 13 words
    found = leaks.leaks(df, "text", "doc_id", items, run=leaks.TILE)
    assert [(r.doc_id, r.item_id, r.coverage) for r in leaks.covered(found).collect()] == [(0, 5, 1.0)] and found.count() == 2
