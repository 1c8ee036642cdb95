"""How the sources of a language differ in their words, with words known by fixed-width digests until the end.

Tasks count the words of their own documents and write (language, source, digest, word, counts). What is shuffled to
sum the counts is digests alone. Apart from that each digest's least and greatest word are looked up: where they
differ, several words share the digest, and its rows are told apart by the word as well. Words come back for the
rows of the result only.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilgraph.llm.words import splitter, sql_words
from veilgraph.plans.staging import discard, staged

LEAST, RANKS, UNIT = 3, 200, 1_000_000_000
#: Different words, and bytes of text, that a task counts before it writes; words whose spelling it knows it has written.
HELD, HELD_BYTES, KNOWN = 400_000, 64_000_000, 1_000_000
COUNTS = "lang string, source string, digest long, word string, tf long, df long"


def _counts(bits: int, named: bool):
    """Of batches (lang, source, text): COUNTS, summed over as many documents as a task holds words of.

    The word itself stands in the first row of a digest, or in all if `named`.
    """
    names = [c.split()[0] for c in COUNTS.split(", ")]

    def table(group: tuple, tf: Counter, df: Counter, known: set) -> pa.RecordBatch:
        digests = [xxhash.xxh64_intdigest(w) >> (64 - bits) for w in tf]
        words = list(tf) if named else [None if d in known else w for d, w in zip(digests, tf, strict=True)]
        known.update(digests)
        columns = [pa.array(np.array(digests, np.uint64).view(np.int64)), pa.array(words, pa.binary()).cast(pa.string()), pa.array(list(tf.values()), pa.int64()), pa.array(list(df.values()), pa.int64())]
        return pa.RecordBatch.from_arrays([*[pa.array([g] * len(tf), pa.string()) for g in group], *columns], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, counts, held, size, known = splitter(digits=False), {}, 0, 0, set()
        for batch in batches:
            for *group, raw in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                tf, df = counts.setdefault(tuple(group), (Counter(), Counter()))
                words, before = split(raw), len(tf)
                tf.update(words)
                df.update(dict.fromkeys(words).keys())  # in the order in which tf has them
                held, size = held + len(tf) - before, size + len(raw)
                if held > HELD or size > HELD_BYTES:
                    yield from (table(g, *c, known) for g, c in counts.items())
                    counts, held, size = {}, 0, 0
                    known = known if len(known) < KNOWN else set()
        yield from (table(g, *c, known) for g, c in counts.items())

    return run


def share(count: Column, words: Column, kinds: Column) -> Column:
    """1 + floor(UNIT * (count + 1) / (words + kinds)), exact at any count; for no kinds at all, UNIT * (count + 1) + 1."""
    wide = lambda c: c.cast("decimal(20,0)")
    below = F.greatest(words + kinds, F.lit(1))
    large = F.call_function("div", wide(count + 1) * F.lit(UNIT).cast("decimal(10,0)"), wide(below))
    return 1 + F.when(count < 9_000_000_000, F.call_function("div", UNIT * (count + 1), below)).otherwise(large)


def gap(p: Column, q: Column) -> Column:
    """floor((p - q) * (p - q) / q); the square stays within 64 bits, as shares are at most UNIT + 1."""
    return F.call_function("div", (p - q) * (p - q), q)


def audit(docs: DataFrame, least: int = LEAST, ranks: int = RANKS, bits: int = 64, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(lang, source, part, item, value, rank): what sets each source of a language apart.

    A language keeps the words in `least` of its documents or more. Part `pair`: the gaps of the source's shares to
    another source's, summed over all kept words; part `term`: a word's own gap to the whole language's share, for words
    that the source has and has more of, the first `ranks` of them. Null language, source and text are ''. Every row
    is a document, repeated ones too. Sources without words have pairs; an empty table gives no rows. Other columns are not
    looked at. `bits` of a digest tell words apart; words that share them are split.
    """
    none = lambda c: F.coalesce(F.col(c), F.lit(""))
    plain = docs.select(none(lang_col).alias("lang"), none(source_col).alias("source"), none(text_col).alias("text"))
    local = staged(plain.mapInArrow(_counts(bits, False), COUNTS), "word-counts")
    words = staged(local.where("word IS NOT NULL").groupBy("digest").agg(F.min("word").alias("word"), F.max("word").alias("last")), "words")
    shared = words.where("word < last").select("digest")
    sums = local.groupBy("lang", "source", "digest").agg(F.lit("").alias("split"), F.sum("tf").alias("tf"), F.sum("df").alias("df"))
    if shared.limit(1).count():
        apart = plain.mapInArrow(_counts(bits, True), COUNTS).join(shared, "digest", "left_semi").groupBy("lang", "source", "digest", F.col("word").alias("split")).agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))
        sums = sums.join(shared, "digest", "left_anti").unionByName(apart)
    each = F.collect_list(F.struct("source", "tf")).alias("each")  # a language's sources at most
    kept = staged(sums.groupBy("lang", "digest", "split").agg(F.sum("tf").alias("all"), F.sum("df").alias("df"), each).where(F.col("df") >= least), "kept")
    discard(local)
    groups = plain.select("lang", "source").distinct()
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kinds"), F.sum("all").alias("words"))
    counts = staged(kept.select("lang", F.explode("each").alias("e")).groupBy("lang", F.col("e.source").alias("source"), F.col("e.tf").alias("n")).agg(F.count(F.lit(1)).alias("c")), "counts")
    own = counts.groupBy("lang", "source").agg(F.sum(F.col("n") * F.col("c")).alias("words"), F.sum("c").alias("held"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    stats = groups.join(langs.withColumnRenamed("words", "all_words"), "lang", "left").join(own, ["lang", "source"], "left").select("lang", "source", *map(zero, ("kinds", "all_words", "words", "held")))
    stats = staged(stats.withColumn("none", share(F.lit(0), F.col("words"), F.col("kinds"))), "groups")
    out = _pairs(kept, counts, stats).unionByName(_terms(kept, stats, words, ranks))
    return out.select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))


def _pairs(kept: DataFrame, counts: DataFrame, stats: DataFrame) -> DataFrame:
    """Part `pair`. A sum over all words is that over the words of either source, as if the other had none of them, from
    the sources' numbers of words of each count; that over words of neither; and, for words in both, what the first was
    wrong by, from the words' own lists of sources."""
    group = F.map_from_entries(F.collect_list(F.struct("source", F.struct("words", "none"))))  # a language's sources
    of = stats.groupBy("lang", "kinds").agg(group.alias("of"))
    known = lambda e: F.struct(e["source"].alias("source"), share(e["tf"], F.col("of")[e["source"]]["words"], F.col("kinds")).alias("p"), F.col("of")[e["source"]]["none"].alias("z"))
    shares = kept.where(F.size("each") > 1).join(of, "lang").select("lang", F.transform("each", known).alias("each"))
    x = shares.select("lang", "each", F.explode("each").alias("x")).select("lang", "x", F.explode("each").alias("y")).where("x.source <> y.source")  # the pairs that are asked for
    parts = {k: F.col(f"{s}.{c}") for k, s, c in (("p", "x", "p"), ("zp", "x", "z"), ("q", "y", "p"), ("zq", "y", "z"))}
    wrong = gap(parts["p"], parts["q"]) - gap(parts["p"], parts["zq"]) - gap(parts["zp"], parts["q"]) + gap(parts["zp"], parts["zq"])
    wide = lambda c: c.cast("decimal(38,0)").alias("value")
    both = x.select("lang", F.col("x.source").alias("g"), F.col("y.source").alias("h"), wide(wrong)).groupBy("lang", "g", "h").agg(F.sum("value").alias("value"))
    side = lambda s, a: stats.select("lang", F.col("source").alias(s), F.col("none").alias(f"z{a}"), F.col("held").alias(f"n{a}"))
    pairs = staged(side("g", "p").join(side("h", "q"), "lang").where("g <> h").join(stats.select("lang", "kinds").distinct(), "lang"), "pairs")
    level = staged(counts.join(stats, ["lang", "source"]).groupBy("lang", "source", share(F.col("n"), F.col("words"), F.col("kinds")).alias("s")).agg(F.sum("c").alias("c")), "levels")
    first = pairs.join(level.withColumnRenamed("source", "g"), ["lang", "g"]).select("lang", "g", "h", wide(F.col("c") * gap(F.col("s"), F.col("zq")).cast("decimal(20,0)")))
    second = pairs.join(level.withColumnRenamed("source", "h"), ["lang", "h"]).select("lang", "g", "h", wide(F.col("c") * gap(F.col("zp"), F.col("s")).cast("decimal(20,0)")))
    rest = pairs.select("lang", "g", "h", wide((F.col("kinds") - F.col("np") - F.col("nq")) * gap(F.col("zp"), F.col("zq")).cast("decimal(20,0)")))
    every = both.select("lang", "g", "h", wide(F.col("value"))).unionByName(first).unionByName(second).unionByName(rest)
    sums = every.groupBy("lang", "g", "h").agg(F.sum("value").cast("long").alias("value"))
    out = sums.select("lang", F.col("g").alias("source"), F.lit("pair").alias("part"), F.col("h").alias("item"), "value")
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")))


def _terms(kept: DataFrame, stats: DataFrame, words: DataFrame, ranks: int) -> DataFrame:
    """Part `term`: words are fetched for values that reach the least of a group's first `ranks`, ties and all."""
    each = kept.select("lang", "digest", "split", "all", F.explode("each").alias("e")).select("lang", F.col("e.source").alias("source"), "digest", "split", "all", F.col("e.tf").alias("tf"))
    met = each.join(stats.select("lang", "source", "kinds", "all_words", "words"), ["lang", "source"])
    shares = met.select("lang", "source", "digest", "split", share(F.col("tf"), F.col("words"), F.col("kinds")).alias("p"), share(F.col("all"), F.col("all_words"), F.col("kinds")).alias("q")).where("p > q")
    valued = staged(shares.select("lang", "source", "digest", "split", gap(F.col("p"), F.col("q")).alias("value")), "values")
    ways = F.pmod(F.xxhash64("digest"), F.lit(64)).alias("way")  # a group's values in 64 parts, of each its first ones

    def firsts(rows: DataFrame, order: list) -> DataFrame:
        some = rows.withColumn("r", F.row_number().over(Window.partitionBy("lang", "source", "way").orderBy(*order))).where(F.col("r") <= ranks)
        return some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order))).where(F.col("rank") <= ranks)

    floor = firsts(valued.select("lang", "source", ways, "value"), [F.col("value").desc()]).groupBy("lang", "source").agg(F.min("value").alias("floor"))
    near = valued.join(floor, ["lang", "source"]).where("value >= floor").join(words.select("digest", "word"), "digest")
    named = near.select("lang", "source", ways, F.when(F.col("split") == "", F.col("word")).otherwise(F.col("split")).alias("item"), "value")
    return firsts(named, [F.col("value").desc(), F.col("item")]).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")


def sql(least: int = LEAST, ranks: int = RANKS) -> str:
    """DuckDB's SQL for audit() of documents."""
    p = lambda c, n: f"1 + ({UNIT}::HUGEINT * ({c} + 1)) // greatest({n} + kinds, 1)"
    return f"""
    WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {sql_words("text", False)} AS ws FROM documents),
    t AS (SELECT i, lang, source, unnest(ws) AS w FROM d),
    k AS MATERIALIZED (SELECT lang, w, count(*) AS n FROM t GROUP BY lang, w HAVING count(DISTINCT i) >= {least}),
    c AS MATERIALIZED (SELECT lang, source, w, count(*) AS n FROM t JOIN k USING (lang, w) GROUP BY lang, source, w),
    v AS (SELECT lang, count(*) AS kinds, sum(n)::BIGINT AS words FROM k GROUP BY lang),
    g AS MATERIALIZED (SELECT x.lang, x.source, coalesce(s, 0) AS words FROM (SELECT DISTINCT lang, source FROM d) x LEFT JOIN (SELECT lang, source, sum(n)::BIGINT AS s FROM c GROUP BY lang, source) y ON y.lang = x.lang AND y.source = x.source),
    f AS MATERIALIZED (SELECT g.lang, g.source, k.w, coalesce(c.n, 0) AS n, {p("coalesce(c.n, 0)", "g.words")} AS p, {p("k.n", "v.words")} AS q
          FROM g JOIN k ON k.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.w = k.w),
    pr AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p)::BIGINT AS value FROM f a JOIN f b ON a.lang = b.lang AND a.w = b.w AND a.source <> b.source GROUP BY ALL),
    pa AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pr ON pr.lang = a.lang AND pr.source = a.source AND pr.item = b.source),
    te AS (SELECT lang, source, 'term' AS part, w AS item, (((p - q) * (p - q)) // q)::BIGINT AS value FROM f WHERE n > 0 AND p > q),
    r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pa UNION ALL SELECT * FROM te))
    SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM r WHERE part = 'pair' OR rank <= {ranks}"""
