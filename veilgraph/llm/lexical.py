"""Ranked lexical search of every document for each item of a benchmark, term at a time with few accumulators.

The items come in blocks of bounded size, each met by all documents. A task holds documents' postings for the
block's terms. For an item it takes the terms rarest first and adds up scores in accumulators; once the terms that
are left could not lift a document without an accumulator to the kth score so far, no more are made, and those
there are go on to their exact scores. A task keeps k documents an item, whose least score is where its next batch
begins; what tasks have kept meets by item, at most k rows a task.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilgraph.llm.words import splitter, sql_words
from veilgraph.plans.staging import discard, staged

#: Characters of items that are met at a time; an item longer than that is a block of its own.
BLOCK = 4_000_000
WEIGHT, SCALE, FLOOR, SPAN, PULL = 1000, 1_000_000_000, 10, 90, 8


def _blocks(items: DataFrame, most: int) -> list[DataFrame]:
    """items (item, text) in parts by hash, each of at most `most` characters or with a single item."""
    parts = 1
    while True:
        part = F.pmod(F.xxhash64("item"), F.lit(parts))
        sizes = items.groupBy(part.alias("part")).agg(F.sum(F.length("text")).alias("chars"), F.count_distinct(F.coalesce(F.xxhash64("item"), F.lit(0))).alias("items"))
        if not sizes.where((F.col("chars") > most) & (F.col("items") > 1)).limit(1).count():
            return [items.where(part == i) for i in range(parts)]
        parts *= 2


def _postings(vocab):
    """Of batches (doc, text): (doc, n, ids, tfs), the number of words and the counts of the words in vocab."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, get = splitter(digits=True), vocab.value.get
        for batch in batches:
            n, ids, tfs, ends = [], [], [], [0]
            for raw in batch.column("text").cast(pa.binary()):
                words = split(raw.as_py())
                found = Counter(map(get, words))
                found.pop(None, None)
                n.append(len(words))
                ids.extend(found.keys())
                tfs.extend(found.values())
                ends.append(len(ids))
            ends = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (ids, tfs)]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(n, pa.int64()), *lists], ["doc", "n", "ids", "tfs"])

    return run


def _flat(batch: pa.RecordBatch, total: int, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, document's place in the batch, share of its weight that the term earns) of each posting."""
    ids, tfs = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("ids", "tfs"))
    n = batch.column("n").to_numpy(zero_copy_only=False)
    at = np.repeat(np.arange(len(n)), np.diff(batch.column("ids").offsets.to_numpy()))
    length = FLOOR + (SPAN * n * total) // words
    return ids, at, (SCALE * tfs) // (1000 * tfs + PULL * length[at])


def _best(count: int, total: int, words: int):
    """Of batches of postings: (id, df, best), documents that hold a term and the largest share it earns in one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, best = np.zeros(count, np.int64), np.zeros(count, np.int64)
        for batch in batches:
            ids, _, share = _flat(batch, total, words)
            df += np.bincount(ids, minlength=count)
            np.maximum.at(best, ids, share)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some]), pa.array(best[some])], ["id", "df", "best"])

    return run


def _order(pair: tuple) -> tuple:
    return -pair[0], pair[1] is None, 0 if pair[1] is None else pair[1]


class Accumulators:
    """The scores of one item over one batch of documents; tells when no more accumulators need be made."""

    def __init__(self, docs: int, k: int, least: int):
        self.scores, self.k, self.least, self.growing = np.zeros(docs, np.int64), k, least, True

    def kth(self) -> int:
        s = self.scores
        return max(self.least, int(np.partition(s, len(s) - self.k)[len(s) - self.k]) if len(s) >= self.k else 0)

    def add(self, docs: np.ndarray, gain: np.ndarray, rest: int) -> None:
        """gain of a term for docs; rest is the most that this term and those after it can give."""
        if self.growing and (rest < self.least or (rest < self.scores.max(initial=0) and rest < self.kth())):
            self.growing = False
        if not self.growing:
            live = self.scores[docs] > 0
            docs, gain = docs[live], gain[live]
        self.scores[docs] += gain


def _search(plan, count: int, total: int, words: int, k: int, kinds: tuple[pa.DataType, pa.DataType]):
    """Of batches of postings: (item, doc, score), the k best documents of the task for each item of the plan."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, items = plan.value
        kept: list[list] = [[] for _ in items]
        for batch in batches:
            ids, at, share = _flat(batch, total, words)
            order = np.argsort(ids, kind="stable")
            at, gain = at[order], weights[ids[order]] * share[order]
            starts = np.concatenate([[0], np.cumsum(np.bincount(ids, minlength=count))])
            docs = batch.column("doc").to_pylist()
            for i, (_, terms, rest) in enumerate(items):
                least = kept[i][-1][0] if len(kept[i]) == k else 0
                if not len(terms) or rest[0] < least:
                    continue
                acc = Accumulators(len(docs), k, least)
                for t, r in zip(terms, rest, strict=True):
                    if starts[t] < starts[t + 1]:
                        acc.add(at[starts[t] : starts[t + 1]], gain[starts[t] : starts[t + 1]], r)
                new = np.flatnonzero(acc.scores >= max(acc.kth(), 1))
                kept[i] = sorted([*kept[i], *[(int(acc.scores[d]), docs[d]) for d in new]], key=_order)[:k]
        rows = [(item, doc, score) for (item, _, _), best in zip(items, kept, strict=True) for score, doc in best]
        columns = [pa.array([r[c] for r in rows], kind) for c, kind in enumerate((*kinds, pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["item", "doc", "score"])

    return run


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block: int = BLOCK) -> DataFrame:
    """(item_id, rank, doc_id, score): of each item the k documents of largest score above 0, ties to the smaller id.

    Rows of one item id are one item, with the terms of all; every row of docs is a document, so a repeated one may
    rank twice, and a null id ranks last among equals. Null and empty texts have no terms. Items that no document
    shares a term with have no rows; an empty table on either side gives none. Other columns are not looked at.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    texts = items.select(F.col(item_col).alias("item"), F.coalesce(F.col(item_text), F.lit("")).alias("text"))
    kind, item_kind = plain.schema["doc"].dataType.simpleString(), texts.schema["item"].dataType.simpleString()
    split, found = splitter(digits=True), None
    for part in _blocks(texts, block):
        of: dict = {}
        for item, text in part.toLocalIterator():
            of.setdefault(item, set()).update(split(text.encode()))
        vocab = {w: i for i, w in enumerate(sorted(set().union(*of.values())))}
        if not vocab:
            continue
        sent = spark.sparkContext.broadcast(vocab)
        postings = staged(plain.mapInArrow(_postings(sent), f"doc {kind}, n long, ids array<int>, tfs array<int>"), "postings")
        total, words = postings.agg(F.count(F.when(F.col("n") > 0, 1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        if words:
            best = postings.select("n", "ids", "tfs").mapInArrow(_best(len(vocab), total, words), "id long, df long, best long").groupBy("id").agg(F.sum("df").alias("df"), F.max("best").alias("best")).collect()  # a row a term of the block
            weights, bound = np.zeros(len(vocab), np.int64), np.zeros(len(vocab), np.int64)
            for r in best:
                weights[r["id"]] = math.floor(WEIGHT * math.log((2 * total + 2) / (2 * r["df"] + 1)))
                bound[r["id"]] = weights[r["id"]] * r["best"]
            plans = []
            for item, terms in of.items():
                ids = np.array([vocab[w] for w in terms], np.int64)
                ids = ids[bound[ids] > 0]
                ids = ids[np.lexsort((ids, -weights[ids]))]
                plans.append((item, ids, np.cumsum(bound[ids][::-1])[::-1].tolist()))
            plan = spark.sparkContext.broadcast((weights, plans))
            kinds = (postings.sparkSession.createDataFrame([], f"i {item_kind}, d {kind}").toArrow().schema.types)
            top = staged(postings.mapInArrow(_search(plan, len(vocab), total, words, k, (kinds[0], kinds[1])), f"item {item_kind}, doc {kind}, score long"), "top")
            found = top if found is None else found.unionByName(top)
            plan.unpersist()
        discard(postings)
        sent.unpersist()
    if found is None:
        found = spark.createDataFrame([], f"item {item_kind}, doc {kind}, score long")
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc").asc_nulls_last())
    ranks = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranks.select(F.col("item").alias("item_id"), "rank", F.col("doc").alias("doc_id"), "score")


def sql(k: int = 10) -> str:
    """DuckDB's SQL for search() of documents for benchmark."""
    return f"""
    WITH d AS (SELECT row_number() OVER () AS i, doc_id, {sql_words("text", True)} AS ws FROM documents),
    c AS (SELECT count(*) FILTER (len(ws) > 0)::BIGINT AS total, sum(len(ws))::BIGINT AS words FROM d),
    q AS MATERIALIZED (SELECT DISTINCT item_id, unnest({sql_words("text", True)}) AS w FROM benchmark),
    t AS (SELECT i, doc_id, len(ws) AS n, unnest(ws) AS w FROM d),
    p AS MATERIALIZED (SELECT i, doc_id, n, w, count(*) AS tf FROM t WHERE w IN (SELECT w FROM q) GROUP BY ALL),
    f AS (SELECT w, floor({WEIGHT} * ln((2 * total + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM p, c GROUP BY w, total),
    s AS (SELECT item_id, i, doc_id, sum(weight * (({SCALE} * tf) // (1000 * tf + {PULL} * ({FLOOR} + ({SPAN} * n * total) // words))))::BIGINT AS score
          FROM q JOIN p USING (w) JOIN f USING (w), c GROUP BY item_id, i, doc_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
    SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= {k}"""
