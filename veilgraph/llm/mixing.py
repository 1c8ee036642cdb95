"""Temperature mixing of sources, in DataFrame functions.

Source shares p of the tokens become weights p^a / sum p^a. The exponent a is bisected between 0 (uniform) and 1
(as found): the largest that keeps the weights' entropy at a target share of its maximum, then, should a source
repeat more often than allowed, the smallest that keeps to the limit. A source's budget of tokens is met by
whole permutations of its documents, an epoch each, and the head of one more: documents by md5, in blocks by
its leading digits, so that the running sum over a large source is taken block by block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilgraph.plans.staging import staged

ENTROPY, REPEATS, SEED, STEPS, DIGITS = 0.95, 4.0, 17, 40, 3


def tokens(text: Column) -> Column:
    """Runs of other characters than blank, tab and line ends; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\r]+")), F.lit(0)).cast("long")


def _at(shares: DataFrame, points: list[float]) -> list[tuple[float, float, float]]:
    """(a, entropy, largest repetition) of each exponent, from sums over the sources."""
    a = F.explode(F.array(*[F.lit(x) for x in points])).alias("a")
    rows = shares.select("p", a).groupBy("a").agg(F.sum(F.pow("p", "a")).alias("z"), F.sum(F.pow("p", "a") * F.log("p")).alias("y"), F.max(F.pow("p", F.col("a") - 1)).alias("m"))
    return sorted(rows.select("a", (F.log("z") - F.col("a") * F.col("y") / F.col("z")).alias("h"), (F.col("m") / F.col("z")).alias("r")).collect())


def _bisect(shares: DataFrame, keep) -> tuple[float, float]:
    """Bounds of the exponent where keep(entropy, repetition) turns; STEPS halvings, four a job."""
    low, high = 0.0, 1.0
    for _ in range(STEPS // 4):
        width = (high - low) / 16
        inner = [low + i * width for i in range(1, 16)]
        held = [a for a, h, r in _at(shares, inner) if keep(h, r)]
        low = max(held, default=low)
        high = low + width
    return low, high


def exponent(shares: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS) -> float:
    """Of shares (p): found by bisection; 1 if the shares meet the target as they are or there are none."""
    n, least = shares.agg(F.count("p"), F.min("p")).first()
    if not n:
        return 1.0
    target = entropy * float(shares.sparkSession.range(1).select(F.log(F.lit(float(n)))).first()[0])
    a = 1.0 if _at(shares, [1.0])[0][1] >= target else _bisect(shares, lambda h, r: h >= target)[0]
    if _at(shares, [a])[0][2] > repeats:
        a = _bisect(shares, lambda h, r: r > repeats)[1]
    return a


def _key(epoch: Column, id_col: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(SEED).cast("string"), epoch.cast("string"), id_col.cast("string")))


def mix(docs: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", whole: bool = False) -> DataFrame:
    """docs with a row for each epoch that a document is in, and last its number from 0.

    The number's column is `_epoch`, with more underscores before it if docs has one of that name.

    The token budget is the corpus's own size or, if `whole`, the least that has every document in one epoch at
    least; a source's is its weight, rounded to 9 decimals, of that. Whole
    epochs hold every document of a source; of the epoch after them, the documents whose running sum of tokens
    in md5 order stays in what is left, equal keys together. A null source is a source of its own; sources
    without tokens are kept once. Repeated rows and null texts count as they are. An empty table gives none.
    """
    slim = staged(docs.select(F.col(source_col).alias("s"), F.col(id_col).alias("i"), tokens(F.col(text_col)).alias("n")), "mix")
    totals = staged(slim.groupBy("s").agg(F.sum("n").alias("t")), "sources")
    total = totals.agg(F.sum("t")).first()[0] or 0
    shares = totals.where("t > 0").select("s", "t", (F.col("t") / F.lit(float(max(total, 1)))).alias("p"))
    a = exponent(shares, entropy, repeats)
    z = shares.agg(F.sum(F.pow("p", F.lit(a)))).first()[0]
    weight = F.round(F.pow("p", F.lit(a)) / F.lit(z or 1.0), 9)
    if whole:
        total = shares.agg(F.max(F.col("t") / weight)).first()[0] or 0
    amount = F.floor(weight * F.lit(float(total)) + 0.5).cast("long")
    budget = shares.select("s", "t", (F.greatest("t", amount) if whole else amount).alias("b"))
    plan = budget.select("s", F.floor(F.col("b") / F.col("t")).cast("long").alias("f"), F.pmod("b", "t").alias("left"))
    keyed = slim.join(plan, slim["s"].eqNullSafe(plan["s"])).where("left > 0").select(plan["s"], "left", "n", _key(F.col("f"), F.col("i")).alias("k")).withColumn("block", F.substring("k", 1, DIGITS))
    sums = keyed.groupBy("s", "block").agg(F.sum("n").alias("n")).withColumn("before", F.sum("n").over(Window.partitionBy("s").orderBy("block")) - F.col("n"))
    inner = F.sum("n").over(Window.partitionBy("s", "block").orderBy("k").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    run = keyed.withColumn("inner", inner).join(sums.select(F.col("s").alias("s2"), F.col("block").alias("block2"), "before"), F.col("s").eqNullSafe(F.col("s2")) & (F.col("block") == F.col("block2")))
    cut = run.where("before + inner <= left").groupBy("s").agg(F.max("k").alias("cut"))
    plan = plan.join(cut.select(F.col("s").alias("s2"), "cut"), F.col("s").eqNullSafe(F.col("s2")), "left").select(F.col("s").alias("_s"), F.col("f").alias("_f"), "cut")
    held = staged(plan.withColumnRenamed("cut", "_cut"), "plan")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), docs[source_col].alias("_source"), docs[id_col].alias("_id"))
    copies = F.when(F.col("_f").isNull(), 1).otherwise(F.col("_f") + F.when(_key(F.col("_f"), F.col("_id")) <= F.col("_cut"), 1).otherwise(0))
    met = rows.join(held, F.col("_source").eqNullSafe(F.col("_s")), "left").where(copies > 0)
    out = met.select("_row", F.explode(F.sequence(F.lit(0), (copies - 1).cast("int"))).alias("_e"))
    return out.select(*[F.col("_row")[c].alias(c) for c in docs.columns], F.col("_e").alias(free_name(docs, "_epoch")))


def free_name(df: DataFrame, name: str) -> str:
    """name, or the first of _name, __name and so on that no column of df has."""
    while name in df.columns:
        name = f"_{name}"
    return name


def sql(source: str = "documents", columns: str = "doc_id, source, epoch", entropy: float = ENTROPY, repeats: float = REPEATS, whole: bool = False) -> str:
    """DuckDB's SQL for mix() of a table or view."""
    h = "ln(list_sum([pow(p, m) for p in ps])) - m * list_sum([pow(p, m) * ln(p) for p in ps]) / list_sum([pow(p, m) for p in ps])"
    r = "list_max([pow(p, m - 1) for p in ps]) / list_sum([pow(p, m) for p in ps])"

    def search(name: str, keep: str) -> str:
        return f"""{name} AS (SELECT 0 AS i, 0.0::DOUBLE AS low, 1.0::DOUBLE AS high, ps, lim FROM g UNION ALL
          SELECT i + 1, CASE WHEN {keep} THEN m ELSE low END, CASE WHEN {keep} THEN high ELSE m END, ps, lim FROM (SELECT *, (low + high) / 2 AS m FROM {name}) WHERE i < {STEPS})"""

    return f"""
    WITH RECURSIVE d AS (SELECT *, coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r]+')), 0) AS n FROM {source}),
    t AS (SELECT source AS s, sum(n)::BIGINT AS t FROM d GROUP BY source),
    g AS (SELECT list(t::DOUBLE / total) AS ps, {entropy!r} * ln(count(*)) AS lim FROM t, (SELECT sum(t)::DOUBLE AS total FROM t) WHERE t > 0),
    {search("e", f"{h} >= lim")},
    {search("q", f"{r} > {repeats!r}")},
    a1 AS (SELECT ps, CASE WHEN (SELECT {h} FROM (SELECT 1.0::DOUBLE AS m, ps FROM g)) >= lim THEN 1.0 ELSE low END AS m FROM e WHERE i = {STEPS}),
    a AS (SELECT CASE WHEN {r} > {repeats!r} THEN (SELECT high FROM q WHERE i = {STEPS}) ELSE m END AS a FROM a1),
    w AS (SELECT s, t, {"greatest(t, " if whole else "("}floor(w * {"max(t / w) OVER ()" if whole else "total"} + 0.5)::BIGINT) AS b FROM (SELECT s, t, total, round(pow(t::DOUBLE / total, a) / z, 9) AS w
          FROM t, a, (SELECT sum(t)::DOUBLE AS total FROM t), (SELECT sum(pow(p, a)) AS z FROM (SELECT unnest(ps) AS p FROM g), a) WHERE t > 0)),
    p AS (SELECT s, b // t AS f, b % t AS left_over FROM w),
    k AS (SELECT d.*, f, left_over, md5(concat_ws('|', '{SEED}', f::VARCHAR, doc_id::VARCHAR)) AS k FROM d LEFT JOIN p ON d.source IS NOT DISTINCT FROM p.s),
    c AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY k RANGE UNBOUNDED PRECEDING) AS run FROM k),
    o AS (SELECT *, unnest(range(0, CASE WHEN f IS NULL THEN 1 ELSE f + CASE WHEN left_over > 0 AND run <= left_over THEN 1 ELSE 0 END END)) AS epoch FROM c)
    SELECT {columns} FROM o"""
