"""Ranked full-text search (BM25) over chunks.

The index is three tables that follow from the chunks: postings (one row per token, with the chunk's collection), lengths,
and one row of corpus statistics. It is read from the texts as asked, or kept: written once, sorted by term, so that a
query reads the row groups of its terms and no text. Additions and deletions are parts of their own (``Workspace`` keeps them
in its snapshots). A query's tree becomes one plan: the postings of its terms are gathered into positions per chunk, phrases and
boolean structure are Column expressions over them, document frequencies are one aggregate row, and the top rows come from
a TakeOrderedAndProject. Statistics are those of the whole corpus; a collection only filters scored rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.functions.text import fold, folded_tokens, tokens
from corvine.operators.query_grammar import Combined, Near, Phrase, parse, phrases

# The ranking's parameters, and the weight of a phrase that most rows hold.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6

BROADCAST_HITS = 10_000


@dataclass
class Index:
    """Either ``texts`` (chunk_id, text), read as asked, or stored ``postings`` (chunk_id, position, term, n_tokens) and ``lengths``.

    ``distinct`` says that no chunk_id has several rows. If some have, nothing is sorted out before the postings of the
    asked terms are gathered: repeated rows have the same positions, which are gathered as sets, so texts are never
    shuffled. Unequal texts under one id would be ranked apart if their lengths differ, together if not.
    """

    texts: DataFrame | None
    postings: DataFrame | None = None
    lengths: DataFrame | None = None
    distinct: bool = False
    kept_statistics: DataFrame | None = None

    @classmethod
    def of(cls, chunks: DataFrame, key: str = "chunk_id", text: str = "text_content", distinct: bool = False) -> Index:
        collection = F.col("collection") if "collection" in chunks.columns else F.lit(None).cast("string")
        rows = chunks.where(F.col(key).isNotNull()).select(F.col(key).alias("chunk_id"), collection.alias("collection"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        return cls(rows, distinct=distinct)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Index:
        return cls(None, spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/lengths"), True, spark.read.parquet(f"{path}/statistics"))

    def save(self, path: str) -> None:
        """Write postings sorted by term, so that a query's terms prune row groups."""
        rows = self.all_postings() if self.distinct else self.all_postings().dropDuplicates(["term", "chunk_id", "position"])
        rows.repartitionByRange("term", "chunk_id").sortWithinPartitions("term", "chunk_id", "position").write.mode("overwrite").parquet(f"{path}/postings")
        lengths = self.all_lengths()
        lengths.write.mode("overwrite").parquet(f"{path}/lengths")
        Index(None, lengths=lengths.sparkSession.read.parquet(f"{path}/lengths")).statistics().coalesce(1).write.mode("overwrite").parquet(f"{path}/statistics")

    def all_postings(self) -> DataFrame:
        if self.postings is not None:
            return self.postings
        rows = self.texts.select("chunk_id", "collection", tokens(F.col("text")).alias("tokens"))
        return rows.select("chunk_id", "collection", F.size("tokens").alias("n_tokens"), F.posexplode("tokens").alias("position", "term"))

    def postings_of(self, wanted: list[tuple[str, bool]]) -> DataFrame:
        """The postings of tokens and prefixes. Texts are only split where one of them occurs in the folded text at all."""
        exact = [t for t, prefix in wanted if not prefix]
        test = F.col("term").isin(*exact) if exact else F.lit(False)
        for t, prefix in wanted:
            if prefix:
                test = test | F.col("term").startswith(t)
        if self.postings is not None:
            return self.postings.where(test)
        rows = self.texts.select("chunk_id", "collection", fold(F.col("text")).alias("folded"))
        some = F.lit(False)
        for t in sorted({t for t, _ in wanted}):
            some = some | F.contains(F.col("folded"), F.lit(t))
        rows = rows.where(some).select("chunk_id", "collection", folded_tokens(F.col("folded")).alias("tokens"))
        return rows.select("chunk_id", "collection", F.size("tokens").alias("n_tokens"), F.posexplode("tokens").alias("position", "term")).where(test)

    def all_lengths(self) -> DataFrame:
        if self.lengths is not None:
            return self.lengths
        sizes = self.texts.select("chunk_id", F.size(tokens(F.col("text"))).alias("n_tokens"))
        return sizes if self.distinct else sizes.groupBy("chunk_id").agg(F.max("n_tokens").alias("n_tokens"))

    def gathered(self, position: Column) -> Column:
        return F.collect_list(position) if self.distinct else F.collect_set(position)

    def statistics(self) -> DataFrame:
        """One row: n_rows, avg_tokens."""
        if self.kept_statistics is not None:
            return self.kept_statistics
        return self.all_lengths().agg(F.count("*").alias("n_rows"), F.avg("n_tokens").alias("avg_tokens"))

    def document_frequencies(self) -> DataFrame:
        """term, n_rows (chunks with it), n_total (occurrences)."""
        per_chunk = self.all_postings().groupBy("term", "chunk_id").agg((F.count("*") if self.distinct else F.size(F.collect_set("position"))).alias("tf"))
        return per_chunk.groupBy("term").agg(F.count("*").alias("n_rows"), F.sum("tf").alias("n_total"))


def _token_test(term: Column, token: str, prefix: bool) -> Column:
    return term.startswith(token) if prefix else term == token


def _slots(wanted: list[Phrase]) -> dict[tuple[str, bool], str]:
    """A column of positions for each distinct (token, prefix)."""
    slots: dict[tuple[str, bool], str] = {}
    for p in wanted:
        for i, t in enumerate(p.tokens):
            slots.setdefault((t, p.prefix and i == len(p.tokens) - 1), f"_p{len(slots)}")
    return slots


def _followed_by(starts: Column, places: Column, after: int) -> Column:
    return F.filter(starts, lambda x: F.array_contains(places, x + after))


def _starts(p: Phrase, slots: dict[tuple[str, bool], str]) -> Column:
    """Positions at which a phrase starts."""
    if not p.tokens:
        return F.array().cast("array<int>")
    columns = [F.col(slots[(t, p.prefix and i == len(p.tokens) - 1)]) for i, t in enumerate(p.tokens)]
    starts = columns[0]
    for i, c in enumerate(columns[1:], 1):
        starts = _followed_by(starts, c, i)
    return F.filter(starts, lambda x: x == 0) if p.initial else starts


def _near_starts(near: Near, slots: dict[tuple[str, bool], str]) -> list[Column]:
    """Per phrase, the starts that take part in a group with at most ``distance`` tokens between its first and last phrase."""
    starts = [_starts(p, slots) for p in near.phrases]
    sizes = [len(p.tokens) for p in near.phrases]

    def fits(chosen: dict[int, Column]) -> Column:
        last = F.greatest(*chosen.values())
        ends = F.least(*[s + sizes[i] for i, s in chosen.items()])
        return last - ends <= near.distance

    def some(i: int, chosen: dict[int, Column]) -> Column:
        if i == len(starts):
            return fits(chosen)
        if i in chosen:
            return some(i + 1, chosen)
        return F.exists(starts[i], lambda x: some(i + 1, chosen | {i: x}))

    def of(i: int) -> Column:
        return F.filter(starts[i], lambda x: some(0, {i: x}))

    return [of(i) for i in range(len(starts))]


def match(index: Index, query: str) -> DataFrame:
    """(chunk_id, collection, rank) of every chunk that the query's tree accepts; the greater rank is the better."""
    tree = parse(query)
    wanted = phrases(tree)
    slots = _slots(wanted)
    if not slots:
        return index.all_lengths().where(F.lit(False)).select("chunk_id", F.lit(None).cast("string").alias("collection"), F.lit(0.0).alias("rank"))
    gathered = index.postings_of(list(slots)).groupBy("chunk_id", "collection", F.col("n_tokens").alias("_len")).agg(
        *[index.gathered(F.when(_token_test(F.col("term"), t, prefix), F.col("position"))).alias(name) for (t, prefix), name in slots.items()]
    )
    # frequency of each phrase, by itself and as far as a NEAR group lets it count
    found: list[Column] = []
    plain: list[Column] = []
    within: dict[int, list[Column]] = {}  # per phrase, the conditions of the parts it is in: where one fails, it doesn't count

    def collect(node) -> Column:
        """Fills the frequencies from left to right; the node's condition."""
        begin = len(found)
        out = condition_of(node)
        for i in range(begin, len(found)):
            within.setdefault(i, []).append(out)
        return out

    def condition_of(node) -> Column:
        if isinstance(node, Phrase):
            found.append(F.size(_starts(node, slots)))
            plain.append(F.size(_starts(node, slots)))
            return F.col(f"_f{len(found) - 1}") > 0
        if isinstance(node, Near):
            own = []
            for p, s in zip(node.phrases, _near_starts(node, slots)):
                found.append(F.size(s))
                plain.append(F.size(_starts(p, slots)))
                own.append(F.col(f"_f{len(found) - 1}") > 0)
            condition = own[0]
            for c in own[1:]:
                condition = condition & c
            return condition
        parts = [collect(p) for p in node.parts]
        out = parts[0]
        for c in parts[1:]:
            out = out & c if node.op == "and" else out | c if node.op == "or" else out & ~c
        return out

    condition = collect(tree)
    counted = gathered.select("chunk_id", "collection", "_len", *[c.alias(f"_f{i}") for i, c in enumerate(found)], *[c.alias(f"_n{i}") for i, c in enumerate(plain)])
    frequencies = counted.agg(*[F.coalesce(F.sum((F.col(f"_n{i}") > 0).cast("long")), F.lit(0)).alias(f"_d{i}") for i in range(len(found))])
    ones = F.broadcast(frequencies.crossJoin(index.statistics()))  # a single row
    score = F.lit(0.0)
    for i in range(len(found)):
        idf = F.ln((F.col("n_rows") - F.col(f"_d{i}") + 0.5) / (F.col(f"_d{i}") + 0.5))
        idf = F.when(idf > 0, idf).otherwise(F.lit(LEAST_IDF))
        counts = within[i][0]
        for c in within[i][1:]:
            counts = counts & c
        f = F.when(counts, F.col(f"_f{i}")).otherwise(F.lit(0)).cast("double")
        score = score + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("_len") / F.col("avg_tokens")))
    return counted.where(condition).crossJoin(ones).select("chunk_id", "collection", score.alias("rank"))


def search(index: Index, chunks: DataFrame, query: str, collection: str | None = None, limit: int = 5, with_snippet: bool = True) -> DataFrame:
    """The best chunks for a query, with their columns, ``snippet`` and ``rank``; ties go to the smaller chunk_id.

    ``chunks`` has the chunks of the index; repeated rows of an id are one, of other versions the greatest. No or an empty
    collection means all; a negative limit means no limit. The best are chosen before any chunk is looked at.
    """
    hits = match(index, query)
    if collection:
        hits = hits.where(F.col("collection") == collection)
    hits = hits.select("chunk_id", "rank")
    if limit >= 0:
        hits = hits.orderBy(F.desc("rank"), "chunk_id").limit(limit)
    others = [c for c in chunks.columns if c not in ("chunk_id", "rank")]
    if others:
        found = chunks.drop("rank").join(F.broadcast(hits) if 0 <= limit <= BROADCAST_HITS else hits, "chunk_id")
        hits = found.groupBy("chunk_id", "rank").agg(F.max(F.struct(*others)).alias("_c")).select("chunk_id", "_c.*", "rank")
    if with_snippet and "text_content" in chunks.columns:
        hits = with_snippets(hits, phrases(parse(query)))
    return hits.orderBy(F.desc("rank"), "chunk_id")


def with_snippets(rows: DataFrame, wanted: list[Phrase], text: str = "text_content", width: int = 5) -> DataFrame:
    """Adds ``snippet``: the ``width`` tokens of the text that hold most of the phrases; dots where the text goes on.

    A window starts at each occurrence of a phrase, and at the start of the sentence it is in. It counts 1000 for each
    phrase it holds and 1 for each further occurrence, and 100 more for a sentence's start (120 for the text's). The first
    of the best windows is taken; unless it starts with a sentence, it is moved so that its phrases stand in its middle.
    """
    kept = [p for p in wanted if p.tokens]
    content, folded, pieces, n, head = (F.col(c) for c in ("_text", "_folded", "_pieces", "_n", "_head"))
    places = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: i < n)

    def hits(number: int, p: Phrase) -> Column:
        def here(i: Column) -> Column:
            test = (i == 0) if p.initial else F.lit(True)
            for k, t in enumerate(p.tokens):
                test = test & _token_test(F.get(folded, i + k), t, p.prefix and k == len(p.tokens) - 1)
            return F.coalesce(test, F.lit(False))

        return F.transform(F.filter(places, here), lambda i: F.struct(i.alias("at"), F.lit(number).alias("phrase"), F.lit(len(p.tokens)).alias("size")))

    found, opens = F.col("_found"), F.col("_opens")

    def inside(start: Column) -> Column:
        return F.filter(found, lambda h: (h["at"] >= start) & (h["at"] < start + width))

    def score(own: Column) -> Column:
        return F.size(F.array_distinct(F.transform(own, lambda h: h["phrase"]))) * 999 + F.size(own)

    def candidates(h: Column) -> Column:
        sentence = F.array_max(F.filter(opens, lambda i: i <= h["at"]))
        return F.struct(h["at"].alias("at"), inside(h["at"]).alias("own"), sentence.alias("sentence"), inside(sentence).alias("of_sentence"))

    def windows(c: Column) -> Column:
        last = F.element_at(c["own"], -1)
        moved = c["at"] - ((F.lit(width) - (last["at"] + last["size"] - c["at"])) / 2).cast("int")
        here = F.struct(score(c["own"]).alias("score"), (-2 * c["at"]).alias("order"), F.greatest(F.lit(0), F.least(moved, n - width)).alias("start"))
        bonus = F.when(c["sentence"] == 0, F.lit(120)).otherwise(F.lit(100))
        begin = F.struct((score(c["of_sentence"]) + bonus).alias("score"), (-2 * c["at"] - 1).alias("order"), c["sentence"].alias("start"))
        return F.when(c["sentence"] < c["at"], F.array(here, begin)).otherwise(F.array(here))

    nothing = F.array().cast("array<struct<at:int,phrase:int,size:int>>")
    best = F.coalesce(F.array_max(F.flatten(F.transform("_candidates", windows)))["start"], F.lit(0))
    shown = F.array_join(F.slice(pieces, F.col("_best") + head + 1, width), "")
    ended = F.when(n > F.col("_best") + width, F.concat(F.regexp_replace("_shown", r"[^\p{L}\p{M}\p{N}\p{Co}]+$", ""), F.lit("..."))).otherwise(F.col("_shown"))
    begun = F.when(F.col("_best") > 0, F.lit("...")).otherwise(F.array_join(F.slice(pieces, F.lit(1), head), ""))
    out = rows.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    # a piece is a token and what follows it; one without a token may come first
    out = out.withColumns({"_folded": tokens(content), "_pieces": F.split(content, r"(?=[\p{L}\p{N}\p{Co}])(?<![\p{L}\p{M}\p{N}\p{Co}])")})
    out = out.withColumns({"_n": F.size(folded), "_head": F.when(F.element_at(pieces, 1).rlike(r"^[\p{L}\p{N}\p{Co}]"), F.lit(0)).otherwise(F.lit(1))})
    opening = F.filter(places, lambda i: (i == 0) | F.coalesce(F.get(pieces, i + head - 1).rlike(r"[.:][ \t\r\n]+$"), F.lit(False)))
    out = out.withColumns({"_found": F.array_sort(F.concat(*[hits(i, p) for i, p in enumerate(kept)])) if kept else nothing, "_opens": opening})
    out = out.withColumn("_candidates", F.transform(found, candidates)).withColumn("_best", best).withColumn("_shown", shown)
    out = out.withColumn("snippet", F.when(n <= width, content).otherwise(F.concat(begun, ended)))
    return out.drop(*[c for c in out.columns if c.startswith("_") and c not in rows.columns])


def grouped_by_file(hits: DataFrame, limit: int) -> DataFrame:
    """The hits of the first ``limit`` files, files in the order of their best hit: adds ``file_place`` (from 1) and ``file_hits``.

    ``hits`` has rank, chunk_id and file_path, and is a bounded pool of search results; hits without a file are left out.
    """
    from pyspark.sql import Window

    order = Window.orderBy(F.desc("rank"), "chunk_id")  # over a pool of at most a few times the limit
    placed = hits.where(F.col("file_path").isNotNull()).withColumn("_place", F.row_number().over(order))
    of_file = Window.partitionBy("file_path")
    firsts = placed.withColumn("_first", F.min("_place").over(of_file)).withColumn("file_hits", F.count("*").over(of_file))
    return firsts.withColumn("file_place", F.dense_rank().over(Window.orderBy("_first"))).where(F.col("file_place") <= limit).drop("_place", "_first")
