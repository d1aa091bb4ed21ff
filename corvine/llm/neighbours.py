"""The most similar vectors of every vector, by additive quantisation and exact reranking.

One quantiser is fitted to a bounded sample (``TRAIN_ROWS``). Every vector is indexed and every vector asks.

A collection is a tree of leaves of at most ``max(LEAF_ROWS, LEAF_ROOT sqrt(n))`` vectors: itself, if it isn't larger; the cells of
the entries of the first codebook; and within cells that are larger, the cells of the second one. A vector lives in one leaf
and looks into those of its ``PROBES`` nearest entries (``DEEP_PROBES`` nearest pairs of entries where cells are split), so
at most some ``16 (PROBES + DEEP_PROBES) n sqrt(n)`` pairs are scored, but for cells that the second codebook can't split.

Leaves in the order of their entries, near ones beside each other, are cut into shards of ``SHARD_ROWS`` vectors by their
counted sizes; a leaf that is larger gets several. A vector goes to its own shard with its code, the stored norm and itself
for the reranking, and just itself to the other shards that it looks into. A shard reads its vectors, then its visitors in
batches; where it has more than ``VISIT_ROWS`` of them, they are spread over copies of it.

Exact copies of a vector within a collection are one class: the shards see its first member only, and each member is
linked to the first ``k + 1`` members, which are the ones that count when ties are settled by the smaller id.

Rows with a null id, collection or vector, of another length than ``dimensions``, with a null, NaN or infinite value, or of
zero length take no part. Ties in similarity are settled by the smaller id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvine.llm.additive import Quantiser, Shard
from corvine.session import materialize, prepare

TRAIN_ROWS = 16_384
PROBES = 24
DEEP_PROBES = 48
LEAF_ROWS = 4_096
LEAF_ROOT = 16
SHARD_ROWS = 32_768
VISIT_ROWS = 524_288
BLOCK_ROWS = 4_096
WHOLE = -1  # the leaf of a collection that is none but itself
_DEEP = 512  # leaf number: first entry * 512 + second entry, or 256 where the first one's cell isn't split


def usable(vector: str, dimensions: int) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & (F.size(vector) == dimensions) & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def latest_vectors(results: DataFrame, key: str = "id", vector: str = "vector", at: str = "finished_at") -> DataFrame:
    """(id, vector): of several results of an id that with the greatest time; a null time is the oldest."""
    newest = F.max(F.struct(F.col(at).alias("at"), F.col(vector).alias("vector")))
    return results.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(newest.alias("n")).select("id", "n.vector")


def _unit(vectors: pa.Array, dimensions: int) -> np.ndarray:
    x = vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def train(vectors: DataFrame, vector: str, dimensions: int, rows: int = TRAIN_ROWS) -> Quantiser | None:
    """A quantiser of at most ``rows`` usable vectors, chosen by hash; None if there are none."""
    every = max(1, -(-vectors.count() // rows))
    sample = vectors.where(F.pmod(F.xxhash64(vector), F.lit(every)) == 0).where(usable(vector, dimensions)).select(vector).limit(rows).toArrow()
    return Quantiser.train(_unit(sample.column(0).combine_chunks(), dimensions)) if sample.num_rows else None


def _copies(rows: DataFrame, classes: DataFrame, most: int) -> DataFrame:
    """(collection, hash, n, ids) of the classes with several members; ``ids`` are the ``most`` smallest.

    In two steps over about the root of the class's size each, so that no task gets a large group.
    """
    by = ["collection", "hash"]
    members = rows.select(*by, "id").distinct().join(classes.where("n > 1").select(*by, "n"), by)
    smallest = lambda ids: F.slice(F.sort_array(ids), 1, most)
    first = members.groupBy(*by, "n", F.pmod(F.xxhash64("id"), F.ceil(F.sqrt("n")).cast("long")).alias("salt")).agg(smallest(F.collect_list("id")).alias("ids"))
    return first.groupBy(*by, "n").agg(smallest(F.flatten(F.collect_list("ids"))).alias("ids"))


def _cells(q: Quantiser, x: np.ndarray, deep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) of the leaves that vectors look into, in a collection whose cells ``deep`` are split."""
    first = q.nearest_entries(x, PROBES)
    split = np.isin(first, deep)
    rows = np.repeat(np.arange(len(x)), first.shape[1])[~split.ravel()]
    leaves = first.ravel()[~split.ravel()] * _DEEP + 256
    if not split.any():
        return rows, leaves
    row, one, two = q.nearest_pairs(x, first, split, DEEP_PROBES)
    return np.concatenate([rows, row]), np.concatenate([leaves, one * _DEEP + two])


def _layout(coded: DataFrame) -> DataFrame:
    """(collection, shards, deep, inner) of the collections that are more than one leaf.

    ``shards`` has, per entry of the first codebook, number of the first shard * 65 536 + how many more shards; ``deep``
    lists the cells that are split, and ``inner`` has their own lists per entry of the second codebook. At most 65 536
    counts belong to a collection.
    """
    counts = coded.groupBy("collection", "first", "second").agg(F.count("*").alias("n"))
    own = Window.partitionBy("collection")
    counts = counts.withColumn("size", F.sum("n").over(own)).withColumn("cell", F.sum("n").over(Window.partitionBy("collection", "first"))).where(F.col("size") > LEAF_ROWS)
    most = F.greatest(F.lit(LEAF_ROWS), (LEAF_ROOT * F.sqrt("size")).cast("long"))
    leaves = counts.withColumn("second", F.when(F.col("cell") > most, F.col("second")).otherwise(F.lit(256))).groupBy("collection", "first", "second").agg(F.sum("n").alias("n"))
    # a leaf's shards are those in which its first and its last vector lie, if all are laid in a row
    after = F.sum("n").over(own.orderBy("first", "second").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    begin = F.floor((F.col("after") - F.col("n")) / SHARD_ROWS)
    leaves = leaves.withColumn("after", after).select("collection", "first", "second", (begin * 65_536 + F.greatest(F.lit(0), F.ceil(F.col("n") / SHARD_ROWS) - 1)).cast("long").alias("at"))

    def entries(key: str):
        found = F.map_from_entries(F.collect_list(F.when(F.col("second") == 256, F.struct(F.col("first"), F.col("at")))))
        return found if key == "first" else F.map_from_entries(F.collect_list(F.struct("second", "at")))

    inner = leaves.where("second < 256").groupBy("collection", "first").agg(entries("second").alias("m"))
    inner = inner.groupBy("collection").agg(F.map_from_entries(F.collect_list(F.struct("first", "m"))).alias("inner"))
    shallow = leaves.groupBy("collection").agg(entries("first").alias("shards"))
    return shallow.join(inner, "collection", "left").withColumn("deep", F.coalesce(F.map_keys("inner"), F.array().cast("array<int>")))


def neighbours(vectors: DataFrame, k: int = 5, least: float = -1.0, dimensions: int = 64, sample_from: DataFrame | None = None) -> DataFrame:
    """(collection, id, neighbour, similarity, place) of the ``k`` most similar of each row of ``vectors`` (id, collection, vector).

    Only similarities of at least ``least`` come out. ``sample_from`` may name cheaper rows to fit the quantiser to.
    """
    spark = vectors.sparkSession
    prepare(spark)
    schema = "collection string, id long, neighbour long, similarity double"
    rows = vectors.where(F.col("id").isNotNull() & F.col("collection").isNotNull() & usable("vector", dimensions)).select("id", "collection", "vector", F.xxhash64("vector").alias("hash"))
    quantiser = train(sample_from if sample_from is not None else rows, "vector", dimensions)
    if quantiser is None:
        return spark.createDataFrame([], schema + ", place int")
    books = spark.sparkContext.broadcast(quantiser.books)  # 393 kB at most for 64 dimensions

    def coder(batches):
        q = Quantiser(books.value)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _unit(batch.column(2), dimensions)
            codes = q.encode(x)
            decoded = q.decode(codes)
            norm = np.maximum(np.linalg.norm(decoded, axis=1), 1e-6)
            fit = np.einsum("nd,nd->n", x, decoded) / norm
            first = q.nearest_entries(x, 1)[:, 0]
            units = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * dimensions), len(x), [None, pa.py_buffer(np.ascontiguousarray(x))]).cast(pa.binary())
            raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(q.m), len(x), [None, pa.py_buffer(np.ascontiguousarray(codes))]).cast(pa.binary())
            second = q.second_entries(x, first) if q.m > 1 else np.zeros(len(x))
            own = [units, raw, *(pa.array(c.astype(np.float32)) for c in (norm, fit)), *(pa.array(c.astype(np.int32)) for c in (first, second))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in (0, 1, 3, 4)), *own], names=["id", "collection", "hash", "n", "unit", "code", "norm", "fit", "first", "second"])

    # one row per distinct vector, under its smallest id
    classes = rows.groupBy("collection", "hash").agg(F.min("id").alias("id"), F.first("vector").alias("vector"), F.count("*").alias("n"))
    coded = classes.select("id", "collection", "vector", "hash", "n").mapInArrow(coder, "id long, collection string, hash long, n long, unit binary, code binary, norm float, fit float, first int, second int")
    coded = materialize(coded, "coded")
    layout = materialize(_layout(coded), "layout")

    def router(batches):
        q = Quantiser(books.value)
        for batch in batches:
            if not batch.num_rows:
                continue
            *kept, deep = batch.columns
            x = _floats(batch.column(2), dimensions)
            known = deep.is_valid().to_numpy(zero_copy_only=False)
            probes: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * len(x)
            lists = deep.to_pylist()
            groups: dict[tuple, list[int]] = {}
            for i in np.flatnonzero(known):
                groups.setdefault(tuple(lists[i]), []).append(i)
            for cells, at in groups.items():
                row, leaf = _cells(q, x[at], np.array(cells, dtype=np.int64))
                order = np.argsort(row, kind="stable")
                for i, part in zip(at, np.split(leaf[order], np.cumsum(np.bincount(row, minlength=len(at)))[:-1])):
                    probes[i] = part
            sizes = np.concatenate([[0], np.cumsum([len(p) for p in probes])]).astype(np.int32)
            flat = np.concatenate(probes) if probes else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*kept, pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat.astype(np.int32)))], names=["id", "collection", "unit", "code", "norm", "fit", "first", "second", "probes"])

    def place(first: Column, second: Column) -> Column:
        """Where a leaf's shards begin, and how many more there are; 0 where the collection is one leaf. Nothing for no leaf."""
        return F.coalesce(F.try_element_at(F.try_element_at(F.col("inner"), first), second), F.try_element_at(F.col("shards"), first))

    def parts(at: Column) -> Column:
        return F.sequence((at / 65_536).cast("int"), (at / 65_536).cast("int") + (at % 65_536).cast("int"))

    routed = coded.join(layout.select("collection", "deep"), "collection", "left").select("id", "collection", "unit", "code", "norm", "fit", "first", "second", "deep")
    routed = routed.mapInArrow(router, "id long, collection string, unit binary, code binary, norm float, fit float, first int, second int, probes array<int>").join(layout, "collection", "left")
    several = F.col("shards").isNotNull()
    leaf = F.when(~several, F.lit(WHOLE)).when(F.array_contains("deep", F.col("first")), F.col("first") * _DEEP + F.col("second")).otherwise(F.col("first") * _DEEP + 256)
    own = F.coalesce(place(F.col("first"), F.col("second")), F.lit(0).cast("long"))
    home = (own / 65_536).cast("int") + F.pmod(F.xxhash64("id"), (own % 65_536).cast("int") + 1).cast("int")
    looks = F.filter(F.transform("probes", lambda p: place((p / _DEEP).cast("int"), p % _DEEP)), lambda at: at.isNotNull())
    visits = F.array_distinct(F.concat(F.array("home"), F.flatten(F.transform(looks, parts))))
    routed = routed.withColumns({"leaf": leaf, "home": home}).select("id", "collection", "unit", "code", "norm", "fit", "leaf", "home", F.explode(visits).alias("shard"))
    # shards with more visitors than one task should take
    heavy = routed.where("shard <> home").groupBy("collection", "shard").agg(F.count("*").alias("visitors")).where(F.col("visitors") > VISIT_ROWS)
    heavy = materialize(heavy.select("collection", "shard", F.ceil(F.col("visitors") / VISIT_ROWS).cast("int").alias("copies")), "heavy")
    is_home = F.col("shard") == F.col("home")
    copies = F.coalesce("copies", F.lit(1))
    salt = F.pmod(F.xxhash64("id"), copies).cast("int")
    spread = F.explode(F.when(is_home, F.sequence(F.lit(0), copies - 1)).otherwise(F.array(salt))).alias("salt")
    bare = lambda c: F.when(is_home, F.col(c)).alias(c)
    visiting = routed.join(heavy, ["collection", "shard"], "left").select("collection", "shard", spread, "id", "unit", bare("code"), bare("norm"), bare("fit"), bare("leaf"), (salt.alias("own")))
    visiting = visiting.repartition("collection", "shard", "salt").sortWithinPartitions("collection", "shard", "salt", F.isnull("code"))

    def shards(batches):
        q = Quantiser(books.value)
        key, base, shard, deep = None, [], None, np.zeros(0, dtype=np.int64)

        def close():
            """The shard's own vectors are all there."""
            nonlocal shard, deep
            t = pa.Table.from_batches(base).combine_chunks()
            code = np.frombuffer(b"".join(t.column("code").to_pylist()), dtype=np.uint8).reshape(t.num_rows, -1)
            ids, norm, fit, leaf = (t.column(c).to_numpy() for c in ("id", "norm", "fit", "leaf"))
            x = _floats(t.column("unit").combine_chunks(), dimensions)
            shard = Shard(q, ids, x, code, norm, fit, leaf, least, k)
            deep = np.unique(leaf[(leaf >= 0) & (leaf % _DEEP < 256)] // _DEEP)
            asks = t.column("own").to_numpy() == t.column("salt").to_numpy()
            base.clear()
            return x[asks], ids[asks]

        def found(x, ids):
            for i in range(0, len(x), BLOCK_ROWS):
                part = x[i : i + BLOCK_ROWS]
                rows, leaves = _cells(q, part, deep) if shard.names[0] != WHOLE else (np.arange(len(part)), np.full(len(part), WHOLE))
                a, b, cosine, _ = shard.search(part, ids[i : i + BLOCK_ROWS], rows, leaves)
                yield pa.RecordBatch.from_arrays([pa.array([key[0]] * len(a), pa.string()), pa.array(ids[i : i + BLOCK_ROWS][a]), pa.array(b), pa.array(cosine)], names=["collection", "id", "neighbour", "similarity"])

        for batch in batches:
            for now, part in _runs(batch):
                if now != key:
                    if base:
                        yield from found(*close())
                    key, shard = now, None
                inside = part.filter(part.column("code").is_valid())
                if inside.num_rows:
                    base.append(inside)
                visitors = part.filter(part.column("code").is_null())
                if visitors.num_rows:
                    if base:
                        yield from found(*close())
                    if shard is not None:
                        yield from found(_floats(visitors.column("unit"), dimensions), visitors.column("id").to_numpy())
        if base:
            yield from found(*close())

    pairs = visiting.mapInArrow(shards, schema)
    if least > 0:  # what one of two finds, the other may have missed
        both_ways = F.array(F.struct("id", "neighbour"), F.struct(F.col("neighbour").alias("id"), F.col("id").alias("neighbour")))
        pairs = pairs.select("collection", "similarity", F.explode(both_ways).alias("p")).select("collection", "p.id", "p.neighbour", "similarity")
    # copies: only classes of several members are looked at
    again = coded.where("n > 1").select("collection", "hash", "n")
    copied = _copies(rows, again, k + 1)
    alike = copied.select("collection", F.element_at("ids", 1).alias("id"), "ids")
    mine, other = alike.withColumnRenamed("ids", "own"), alike.select("collection", F.col("id").alias("neighbour"), F.col("ids").alias("other"))
    spread = (
        pairs.join(mine, ["collection", "id"], "left")
        .join(other, ["collection", "neighbour"], "left")
        .select("collection", F.explode(F.coalesce("own", F.array("id"))).alias("id"), F.coalesce("other", F.array("neighbour")).alias("others"), "similarity")
        .select("collection", "id", F.explode("others").alias("neighbour"), "similarity")
    )
    within = rows.select("collection", "hash", "id").join(copied, ["collection", "hash"]).select("collection", "id", F.explode("ids").alias("neighbour"), F.lit(1.0).alias("similarity"))
    both = spread.unionByName(within).where("id <> neighbour")
    best = F.slice(F.sort_array(F.collect_set(F.struct((-F.col("similarity")).alias("minus"), "neighbour"))), 1, k)
    top = both.groupBy("collection", "id").agg(best.alias("best"))
    return top.select("collection", "id", F.posexplode("best").alias("place", "n")).select("collection", "id", F.col("n.neighbour").alias("neighbour"), (-F.col("n.minus")).alias("similarity"), "place")


def _floats(units: pa.Array, dimensions: int) -> np.ndarray:
    """The vectors behind binary values of four bytes a number."""
    return np.frombuffer(b"".join(units.to_pylist()), dtype=np.float32).reshape(-1, dimensions)


def _runs(batch: pa.RecordBatch):
    """(key, rows) of the runs of equal (collection, shard, salt) in a sorted batch."""
    keys = list(zip(*(batch.column(c).to_pylist() for c in ("collection", "shard", "salt"))))
    begin = 0
    for i in range(1, len(keys) + 1):
        if i == len(keys) or keys[i] != keys[begin]:
            yield keys[begin], batch.slice(begin, i - begin)
            begin = i
