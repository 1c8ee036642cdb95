"""Lines that many documents share, found over ranges of their hashes and told as a keep bitmap a document.

A line's key (ends stripped, A-Z in lower case) becomes 128 bits of md5. Hashes go to ranges, sorted there by
document and position, so that one pass tells a hash's documents and its first line. What comes back is no text but,
for each document, the lines where keeping turns into dropping and back. A hash that would fill a range is known
beforehand: seen in enough documents of a sixteenth of all, it is decided, and its rows go to many ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilgraph.llm.mixing import free_name
from veilgraph.llm.words import LOWER, UPPER
from veilgraph.plans.staging import staged

LEAST, BLANKS = 10, " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    bare = F.btrim(line, F.lit(BLANKS))
    return F.when(F.length(bare) == F.octet_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def row_key(id_col: Column, text: Column) -> Column:
    """128 bits of md5 of id and text; n different documents share one with odds of n * n / 2 ** 129."""
    return F.unhex(F.md5(F.concat(F.coalesce(id_col.cast("string"), F.lit("-")), F.lit("|"), F.coalesce(text, F.lit("")))))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def keep_bitmaps(docs: DataFrame, least: int = LEAST, first: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, n_lines, n_dropped, turns) of each document: lines whose key `least` documents or more have are dropped.

    turns holds the line numbers, from 0, where dropping starts and ends, in turn: a bitmap of n_lines bits by its runs.
    With `first`, the first such line of all documents stays, by id (null first), then row, then position. Rows that
    agree in id and text are one document, and have one bitmap; row is their key. Lines are split at \\n alone; null and
    empty texts have one empty line, and lines of blanks have no key and stay. An empty table gives no bitmaps.
    """
    key = F.transform(_lines(F.col(text_col)), line_key)
    some = docs.select(F.col(id_col).alias("id"), row_key(F.col(id_col), F.col(text_col)).alias("row"), F.transform(key, lambda k: F.when(k != "", F.unhex(F.md5(k)))).alias("keys"))
    held = staged(some, "line-keys")
    lines = held.select("id", "row", F.posexplode("keys").alias("at", "h")).where("h IS NOT NULL")
    ranges = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sample = lines.where(F.substring(F.hex("row"), 1, 1) == "0")
    share = (sample.count() or 0) / (4 * ranges)
    heavy = staged(sample.groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.count_distinct("row").alias("docs")).where((F.col("docs") >= least) & (F.col("c") >= share)).select("h"), "heavy")  # 4 rows a range at most
    sure = heavy.select("h", F.lit(True).alias("sure"))
    salted = lines.join(F.broadcast(sure), "h", "left").withColumn("salt", F.when(F.col("sure"), F.pmod(F.xxhash64("row"), F.lit(ranges))).otherwise(0))
    group = Window.partitionBy("h", "salt")
    order = group.orderBy("id", "row", "at")
    met = salted.repartitionByRange(ranges, "h", "salt").withColumn("place", F.row_number().over(order)).withColumn("opens", F.coalesce(F.lag("row").over(order) != F.col("row"), F.lit(True)))
    common = met.withColumn("docs", F.sum(F.col("opens").cast("long")).over(group)).where((F.col("docs") >= least) | F.col("sure"))
    if first:
        common = staged(common.select("h", "id", "row", "at", "place"), "common")
        start = common.where("place = 1").groupBy("h").agg(F.min(F.struct("id", "row", "at")).alias("s")).select("h", F.col("s.row").alias("row"), F.col("s.at").alias("at"))
        common = common.join(start, ["h", "row", "at"], "left_anti")
    dropped = common.select("row", "at").groupBy("row").agg(F.array_sort(F.collect_set("at")).alias("at"))
    after = F.transform("at", lambda i: i + 1)
    turns = F.flatten(F.zip_with(F.array_except("at", after), F.array_except(after, "at"), lambda a, b: F.array(a, b)))
    told = dropped.select(F.col("row").alias("r"), F.size("at").cast("long").alias("dropped"), turns.alias("turns"))
    every = held.groupBy("row").agg(F.first("id").alias("id"), F.first(F.size("keys")).cast("long").alias("n_lines"))
    none = F.array().cast("array<int>")
    return every.join(told, F.col("row") == F.col("r"), "left").select("row", "id", "n_lines", F.coalesce("dropped", F.lit(0)).cast("long").alias("n_dropped"), F.coalesce("turns", none).alias("turns"))


def kept_text(text: Column, turns: Column) -> Column:
    """The lines of text that a bitmap keeps, joined by \\n."""
    lines = _lines(text)
    cuts = F.concat(F.array(F.lit(0)), turns, F.array(F.size(lines)))
    parts = F.transform(F.sequence(F.lit(0), F.size(turns), F.lit(2)), lambda i: F.slice(lines, F.get(cuts, i) + 1, F.get(cuts, i + 1) - F.get(cuts, i)))
    return F.array_join(F.flatten(parts), "\n")


def apply(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs and, last, n_lines, n_dropped and the kept text; underscores before names that docs has already."""
    names = {c: free_name(docs, c) for c in ("n_lines", "n_dropped", "kept")}
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_doc"), row_key(docs[id_col], docs[text_col]).alias("_key"))
    met = rows.join(bitmaps, rows["_key"] == bitmaps["row"])
    kept = F.when(F.size("turns") == 0, F.coalesce(F.col("_doc")[text_col], F.lit(""))).otherwise(kept_text(F.col("_doc")[text_col], F.col("turns")))
    return met.select(*[F.col("_doc")[c].alias(c) for c in docs.columns], F.col("n_lines").alias(names["n_lines"]), F.col("n_dropped").alias(names["n_dropped"]), kept.alias(names["kept"]))


def sql(least: int = LEAST) -> str:
    """DuckDB's SQL for the bitmaps of documents, applied."""
    key = f"translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}')"
    return f"""
    WITH d AS (SELECT row_number() OVER () AS i, * FROM (SELECT DISTINCT doc_id, coalesce(text, '') AS t FROM documents)),
    l AS (SELECT i, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS pos FROM d),
    k AS MATERIALIZED (SELECT i, pos, line, {key} AS k FROM l),
    f AS (SELECT k FROM k WHERE k <> '' GROUP BY k HAVING count(DISTINCT i) >= {least}),
    r AS (SELECT i, count(*) AS n_lines, count(f.k) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (f.k IS NULL), '') AS kept FROM k LEFT JOIN f ON f.k = k.k GROUP BY i)
    SELECT s.doc_id, n_lines, n_dropped, sha256(kept) AS kept_sha256 FROM documents s JOIN d ON d.doc_id IS NOT DISTINCT FROM s.doc_id AND d.t = coalesce(s.text, '') JOIN r ON r.i = d.i"""
