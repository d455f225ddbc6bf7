"""Mixing sources to target weights by capped water-filling.

Sources share a budget of words in proportion to their weights. A source whose share would pass
``max_epochs`` times its size is clamped there and the excess is dealt to the others by weight, until
no source is above its clamp. That fixed point is a water level L with
``sum(min(weight * L, cap)) = budget``, so it is found from the sources sorted by ``cap / weight``.

Each source is then repeated ``target / size`` times: whole repetitions take every document, and the
fractional rest takes documents in the order of a seeded hash of id and text until the target is met as nearly as whole
documents allow. The order is cut by a histogram of two levels, each of ``BUCKETS`` buckets, so that no source, however
large, is ordered in one task: of a source only one row in BUCKETS * BUCKETS is.

Edge cases: null texts have size 0 and are taken 0 times; a null source is a source of its own, the last
one; rows are taken one by one, whatever ids they have: rows that share id and text are counted before they are ordered,
and if the cut falls among them the rest takes as many of them as it needs, in the order of their other columns; a null
doc_id is an id like any other; an empty table gives an empty result; sources of size 0 have target 0; other
columns pass through (columns that begin with mix_ are refused).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, table, words_in, written

#: Hash buckets of a source, and of the bucket that holds the end of its fraction.
BUCKETS = 4096
HASH_DIGITS = 15


def order_hash(doc_id, text, seed: int):
    """A seeded hash of a document's id and text, as a long of 60 bits."""
    held = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), held)
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, HASH_DIGITS), 16, 10).cast("long")


def _bucket(h, level: int):
    """Bucket of a hash on the first or second level."""
    return F.pmod(F.shiftright(h, 4 * HASH_DIGITS - 12 * level), F.lit(BUCKETS)).cast("int")


def source_targets(sizes: DataFrame, weights=(3, 1, 2), budget: float = 1.5, max_epochs: int = 2) -> DataFrame:
    """(source, source_size) -> with weight and target; one row per source, so the global order is small."""
    by_name = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    n = F.row_number().over(by_name)
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), ((n - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("weight", weight).withColumn("cap", (F.lit(max_epochs) * F.col("source_size")).cast("long"))
    everything = Window.partitionBy(F.lit(0))
    ranked = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.encode("source", "UTF-8"))
    before = ranked.rowsBetween(Window.unboundedPreceding, -1)
    after = ranked.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    s = (
        s.withColumn("total", F.lit(budget) * F.sum("source_size").over(everything))
        .withColumn("filled", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("open_weight", F.sum("weight").over(after))
        # the level that would hold if the sources before this one are clamped and no other is
        .withColumn("level", (F.col("total") - F.col("filled")) / F.col("open_weight"))
        .withColumn("fits", F.col("level") <= F.col("cap") / F.col("weight"))
        .withColumn("water", F.min(F.when(F.col("fits"), F.struct("filled", "level"))).over(everything)["level"])
    )
    target = F.when(F.col("water").isNull(), F.col("cap").cast("double")).otherwise(
        F.least(F.col("weight") * F.col("water"), F.col("cap").cast("double"))
    )
    return s.select("source", "source_size", F.col("weight").cast("int").alias("weight"), target.alias("target"))


def cuts(sized: DataFrame, weights=(3, 1, 2), budget: float = 1.5, max_epochs: int = 2) -> DataFrame:
    """sized(doc_id, source, size, h) -> one row per source: its target, its whole repetitions, and where its fraction
    ends: all rows before (cut_h, cut_id), and ``cut_take`` of the ``cut_n`` rows there."""
    histogram = written(sized.groupBy("source", _bucket(F.col("h"), 1).alias("b")).agg(F.sum("size").alias("words")), "mix-histogram")
    t = source_targets(histogram.groupBy("source").agg(F.sum("words").alias("source_size")), weights, budget, max_epochs)
    t = t.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    # a goal of 0 takes nothing, not even empty documents
    t = written(t.withColumn("goal", F.col("target") - F.col("whole") * F.col("source_size")), "mix-targets")
    upto = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)

    def cut_bucket(histogram: DataFrame, ends: DataFrame) -> DataFrame:
        """ends(s, goal, below): the first bucket whose words pass the goal, and the words below it."""
        h = histogram.withColumn("upto", F.sum("words").over(upto)).join(ends, F.col("source").eqNullSafe(F.col("s")))
        past = h.filter((F.col("goal") > 0) & (F.col("below") + F.col("upto") > F.col("goal")))
        first = past.groupBy("s").agg(F.min(F.struct("b", "goal", (F.col("below") + F.col("upto") - F.col("words")).alias("below"))).alias("x"))
        return first.select("s", F.col("x.b").alias("at"), "x.goal", "x.below")

    one = written(cut_bucket(histogram, t.select(F.col("source").alias("s"), "goal", F.lit(0).cast("long").alias("below"))), "mix-cut-1")
    inside = sized.join(one, F.col("source").eqNullSafe(F.col("s")) & (_bucket(F.col("h"), 1) == F.col("at"))).select("source", "doc_id", "size", "h")
    # rows that share id and text become one with their number
    inside = inside.groupBy("source", "h", "doc_id", "size").agg(F.count(F.lit(1)).alias("n"))
    inside = written(inside.withColumn("b", _bucket(F.col("h"), 2)), "mix-inside")
    two = written(cut_bucket(inside.groupBy("source", "b").agg(F.sum(F.col("size") * F.col("n")).alias("words")), one.drop("at")), "mix-cut-2")
    edge = inside.join(two, F.col("source").eqNullSafe(F.col("s")) & (F.col("b") == F.col("at")))
    row = Window.partitionBy("source").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    before = F.col("below") + F.sum(F.col("size") * F.col("n")).over(row) - F.col("size") * F.col("n")
    # the k-th of n equal rows is taken if half of it lies within the goal
    room = F.floor((F.col("goal") - before) / F.col("size") + F.lit(0.5))
    take = F.when(F.col("size") == 0, F.when(before <= F.col("goal"), F.col("n")).otherwise(0)).otherwise(F.least(F.col("n"), F.greatest(F.lit(0), room)))
    edge = edge.select("source", F.struct("h", F.col("doc_id").alias("id"), "n", take.cast("long").alias("take")).alias("x"))
    ends = edge.groupBy("source").agg(F.min(F.when(F.col("x.take") < F.col("x.n"), F.col("x"))).alias("first"), F.max("x").alias("last"))
    ends = ends.select(F.col("source").alias("s"), F.coalesce("first", "last").alias("x"))
    out = t.join(ends, F.col("source").eqNullSafe(F.col("s")), "left")
    out = out.select("source", "source_size", "target", "whole", F.col("x.h").alias("cut_h"), F.col("x.id").alias("cut_id"), F.col("x.n").alias("cut_n"), F.col("x.take").alias("cut_take"))
    return written(out, "mix-cuts")


def with_copies(docs: DataFrame, cut: DataFrame, h) -> DataFrame:
    """docs(doc_id, source, ...) with mix_source_size, mix_target and mix_copies, whatever other columns there are; h is the
    order's hash. The rows stay where they are: the cuts are one row per source, broadcast only if the planner finds
    them small. Only where a cut falls among rows that share id and text are those counted and dealt out anew."""
    some = cut.filter("cut_take > 0 AND cut_take < cut_n")
    cut = cut.select(*[F.col(c).alias(f"mix_{c}") for c in cut.columns])
    clash = [c for c in docs.columns if c.lower().startswith("mix_")]
    if clash:
        raise ValueError(f"columns that begin with mix_ are the operator's own: {clash}")
    d = docs.join(cut, docs["source"].eqNullSafe(cut["mix_source"])).withColumn("mix_h", h)
    here, there = F.struct(F.col("mix_h").alias("h"), docs["doc_id"].alias("id")), F.struct(F.col("mix_cut_h").alias("h"), F.col("mix_cut_id").alias("id"))
    at_cut = F.coalesce((F.col("mix_h") == F.col("mix_cut_h")) & docs["doc_id"].eqNullSafe(F.col("mix_cut_id")), F.lit(False))
    extra = (F.col("mix_h") <= F.col("mix_cut_h")) & F.when(at_cut, F.col("mix_cut_take") == F.col("mix_cut_n")).otherwise(here < there)
    d = d.withColumn("mix_copies", (F.col("mix_whole") + F.coalesce(extra, F.lit(False)).cast("int")).cast("int"))
    names = [*docs.columns, "mix_source_size", "mix_target"]
    if some.isEmpty():
        return d.select(*names, "mix_copies")
    parted = at_cut & (F.col("mix_cut_take") > 0) & (F.col("mix_cut_take") < F.col("mix_cut_n"))
    equal = d.filter(parted).groupBy(*names, "mix_whole", "mix_cut_take").agg(F.count(F.lit(1)).alias("mix_n"))
    upto = F.sum("mix_n").over(Window.partitionBy("source").orderBy(F.xxhash64(*docs.columns)).rowsBetween(Window.unboundedPreceding, 0))
    equal = equal.withColumn("mix_upto", upto)
    taken = F.least(F.col("mix_n"), F.greatest(F.lit(0), F.col("mix_cut_take") - F.col("mix_upto") + F.col("mix_n")))
    dealt = F.array(F.struct(taken.alias("n"), (F.col("mix_whole") + 1).alias("copies")), F.struct((F.col("mix_n") - taken).alias("n"), F.col("mix_whole").alias("copies")))
    equal = equal.select(*names, F.explode(dealt).alias("mix_x")).filter("mix_x.n > 0")
    equal = equal.withColumn("mix_k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("mix_x.n"))))
    return d.filter(~parted).select(*names, "mix_copies").unionByName(equal.select(*names, F.col("mix_x.copies").cast("int").alias("mix_copies")))


def sizes(docs: DataFrame, seed: int) -> DataFrame:
    """The sizes of all documents, written once, so that the texts are read once."""
    d = docs.select("doc_id", "source", words_in("text").alias("size"), order_hash(F.col("doc_id"), F.col("text"), seed).alias("h"))
    return written(d, "mix-sizes")


def mix(docs: DataFrame, seed: int = 13, weights=(3, 1, 2), budget: float = 1.5, max_epochs: int = 2) -> DataFrame:
    """docs(doc_id, text, source) -> doc_id, source, size, h, source_size, target, copies (0 to max_epochs)."""
    sized = sizes(docs, seed)
    d = with_copies(sized, cuts(sized, weights, budget, max_epochs), F.col("h"))
    return d.withColumnsRenamed({f"mix_{c}": c for c in ("source_size", "target", "copies")})


def op6_mix(spark, sf_dir) -> DataFrame:
    m = mix(table(spark, sf_dir, "documents"))
    return m.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def stage(spark, docs: DataFrame, sf_dir: str, seed: int = 13) -> DataFrame:
    """Pipeline stage: each document as often as the mix takes it."""
    small_batches(spark)
    picked = with_copies(docs, cuts(sizes(docs, seed)), order_hash(docs["doc_id"], docs["text"], seed)).filter("mix_copies > 0")
    return picked.withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies")))).select(*docs.columns)


#: The result of op6_mix in DuckDB's SQL.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('13:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source IS NULL, encode(source))) - 1) % 3 + 1] AS weight, 2 * source_size AS cap FROM s),
r AS (SELECT *, 1.5::DOUBLE * sum(source_size) OVER () AS total,
        coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
        sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_weight
      FROM w WINDOW o AS (ORDER BY cap / weight::DOUBLE, source IS NULL, encode(source))),
l AS (SELECT *, (total - filled::DOUBLE) / open_weight::DOUBLE AS level FROM r),
v AS (SELECT arg_min(level, filled) AS water FROM l WHERE level <= cap / weight::DOUBLE),
t AS (SELECT source, source_size, CASE WHEN water IS NULL THEN cap::DOUBLE ELSE least(weight * water, cap::DOUBLE) END AS target FROM l CROSS JOIN v),
g AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
x AS (SELECT d.*, source_size, target, whole, target - whole * source_size AS goal,
        sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN goal > 0 AND upto - size / 2.0 <= goal THEN 1 ELSE 0 END))::BIGINT AS taken
FROM x
"""
