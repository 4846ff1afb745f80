"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target number of words; a document's expected copies are
its source's target over what the source holds, times the document's own
weight.  Whole copies are certain.  For the fractional rest ``p`` a document
draws ``u`` from its id and ranks by ``(u/(1-u)) / (p/(1-p))``: the documents
of smallest rank whose words fit are the sample, so its size is fixed by the
words still wanted.  More passes fill what the first document that did not fit
left over: some in the same rank order, the last by size, smallest first, after
which nothing that is left would fit.

Rows that agree in doc_id, source and size tie; as many of a tie are taken as
fit.

The cut in a source's rank order is found without gathering the source: words
per rank bucket (2**10, then 2**10 inside the bucket that holds the cut), and
only the documents of that last bucket are sorted.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlens.llm.common import replace_columns, stage, word_count

WEIGHTS = (3, 1, 2)          # repeating, sources by code point, null last
SHARE = 1.5                  # of all words
MOST = 2.0                   # copies of a source, and of a document
FILLS = 3                    # passes that fill the rest, the last of them smallest first
SEED = "mix-1"
MOST_BROADCAST_SOURCES = 50_000
NO_ID = -(1 << 63)


def _source_key() -> Column:
    return F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source")))


def _draw(seed: str) -> Column:
    """A uniform number in (0, 1) from the doc_id: 52 bits of an MD5, so reruns agree."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def _measured(docs: DataFrame, weight: Column | None, seed: str) -> DataFrame:
    """docs + __mix_k (source), size, __mix_w (weight), __mix_u (draw), __mix_id (order among ties)."""
    own = replace_columns(docs, ["size", "source_size", "target", "taken", "copies", "__mix_k", "__mix_w", "__mix_u", "__mix_id"])
    w = F.lit(1.0) if weight is None else F.greatest(F.coalesce(weight.cast("double"), F.lit(0.0)), F.lit(0.0))
    return own.withColumns({"__mix_k": _source_key(), "size": word_count(F.col("text")), "__mix_w": w, "__mix_u": _draw(seed),
                            "__mix_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))})


def source_targets(meta: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """One row a source: its words, its target and expected copies per unit of weight.

    Targets are ``weight x level``, or ``most`` times the source where that is
    less; the level is the one at which all targets share ``share`` of all
    words (what capped sources leave goes to the others by weight).
    """
    by = (meta.groupBy("__mix_k").agg(F.sum("size").alias("source_size"), F.sum(F.col("__mix_w") * F.col("size")).alias("ws")))
    by = by.withColumn("source", F.when(F.col("__mix_k") != "n", F.substring("__mix_k", 2, 1 << 30)))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    by = by.withColumn("w", F.get(cycle, (rank - 1) % len(weights)))
    by = by.withColumns({"cap": F.col("source_size") * F.lit(most), "full": F.col("source_size") * F.lit(most) / F.col("w")})
    w_all = Window.partitionBy()
    w_before = Window.orderBy("full", "__mix_k").rowsBetween(Window.unboundedPreceding, -1)
    by = by.withColumn("level", (F.sum("source_size").over(w_all) * F.lit(share)
                                 - F.coalesce(F.sum("cap").over(w_before), F.lit(0.0)))
                       / (F.sum("w").over(w_all) - F.coalesce(F.sum("w").over(w_before), F.lit(0.0))))
    by = by.withColumn("level", F.max(F.when(F.col("full") >= F.col("level"), F.col("level"))).over(w_all))
    by = by.withColumn("target", F.coalesce(F.least("cap", F.col("w") * F.col("level")), F.col("cap")))
    rate = F.when(F.col("ws") > 0, F.col("target") / F.col("ws")).otherwise(F.lit(1.0))
    return by.select("__mix_k", "source_size", "target", rate.alias("rate"))


def _ranked(meta: DataFrame, most: float) -> DataFrame:
    """+ __mix_whole (certain copies), __mix_p, __mix_t: Pareto rank mapped to (0, 1], order-preserving."""
    e = F.least(F.col("rate") * F.col("__mix_w"), F.lit(most))
    meta = meta.withColumn("__mix_whole", F.floor(e).cast("long")).withColumn("__mix_p", e - F.col("__mix_whole"))
    odds_u = F.col("__mix_u") / (F.lit(1.0) - F.col("__mix_u"))
    q = odds_u / (F.col("__mix_p") / (F.lit(1.0) - F.col("__mix_p")))
    return meta.withColumn("__mix_t", F.when(F.col("__mix_p") > 0, q / (q + 1.0)).otherwise(F.lit(1.0)))


def _open(r: int, most: float, fills: int) -> Column:
    """May a row still win a copy in pass ``r``?"""
    return _eligible(r, most) & ~_won(r, most, fills) if r else _eligible(0, most)


def _eligible(r: int, most: float) -> Column:
    """The first pass draws those with a fractional copy, later ones all with words that still fit."""
    below = F.col("__mix_whole") + 1 <= F.lit(most)
    if not r:
        return below & (F.col("__mix_p") > 0)
    return below & (F.col("size") > 0) & (F.col("size") <= F.col(f"amount{r}"))


def _rank(r: int, fills: int) -> Column:
    """A row's place in pass ``r``, in [0, 1]: its Pareto rank, but in the last fill its size first."""
    if r < fills or not r:
        return F.col("__mix_t")
    return F.try_divide(F.col("size") - 1 + F.col("__mix_t"), F.col(f"amount{r}"))


def _order(r: int, fills: int) -> Column:
    return F.struct(_rank(r, fills).alias("a"), F.col("__mix_id").alias("b"), F.col("size").alias("c"))


def _in_cut(r: int, fills: int) -> Column:
    return (_rank(r, fills) < F.col(f"edge{r}")) | F.coalesce(_order(r, fills) <= F.col(f"last{r}"), F.lit(False))


def _won(upto: int, most: float, fills: int) -> Column:
    """Did a row win a copy in a pass before ``upto``?

    A tie of which some rows won takes no part in later passes: what is left is less than their size.
    """
    won = F.lit(False)
    for r in range(upto):
        won = won | (_eligible(r, most) & _in_cut(r, fills))
    return won


def _cut(cand: DataFrame, r: int, fills: int, hint) -> DataFrame:
    """Per source: where the words, in the order of the pass, exceed its amount.

    Returns __mix_k, edge (all ranks below it are taken), last (the last taken
    rank at or above the edge, or null), part and n_part (the tie of which
    only some rows fit, and how many; or null) and words (taken).
    """
    cand = cand.select("__mix_k", "size", "__mix_id", F.col(f"amount{r}").alias("amount"), _rank(r, fills).alias("t"))
    cand = cand.withColumns({"b1": F.floor(F.col("t") * 1024), "b2": F.floor(F.col("t") * 1048576)})

    def crossing(rows, bucket):
        w = Window.partitionBy("__mix_k").orderBy(bucket).rowsBetween(Window.unboundedPreceding, 0)
        return (rows.withColumn("upto", F.col("before") + F.sum("s").over(w))
                .where((F.col("upto") > F.col("amount")) & (F.col("upto") - F.col("s") <= F.col("amount")))
                .select("__mix_k", bucket, (F.col("upto") - F.col("s")).alias("before")))

    one = (cand.groupBy("__mix_k", "b1").agg(F.sum("size").alias("s"), F.first("amount").alias("amount"))
           .withColumn("before", F.lit(0).cast("long")))
    b1 = crossing(one, "b1")
    two = (cand.join(hint(b1), ["__mix_k", "b1"]).groupBy("__mix_k", "b2")
           .agg(F.sum("size").alias("s"), F.first("amount").alias("amount"), F.first("before").alias("before")))
    b2 = stage(crossing(two, "b2"), "mix-bucket")
    w = Window.partitionBy("__mix_k").orderBy("t", "__mix_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    here = F.struct(F.col("t").alias("a"), F.col("__mix_id").alias("b"), F.col("size").alias("c"))
    full = F.col("upto") <= F.col("amount")
    fit = F.floor(F.try_divide(F.col("amount") - F.col("upto") + F.col("n") * F.col("size"), F.col("size"))).cast("long")
    leaf = (cand.join(hint(b2), ["__mix_k", "b2"]).groupBy("__mix_k", "t", "__mix_id", "size")
            .agg(F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in ("b2", "before", "amount")])
            .withColumn("upto", F.col("before") + F.sum(F.col("n") * F.col("size")).over(w))
            .withColumn("fit", F.when(~full & (F.col("upto") - F.col("n") * F.col("size") <= F.col("amount")), fit))
            .groupBy("__mix_k").agg(
                F.first("b2").alias("b2"), F.first("before").alias("before"),
                F.max(F.when(full, F.col("upto"))).alias("upto"), F.max(F.when(full, here)).alias("last"),
                F.max(F.when(F.col("fit") > 0, here)).alias("part"), F.max(F.when(F.col("fit") > 0, F.col("fit"))).alias("n_part")))
    return leaf.select("__mix_k", (F.col("b2") / F.lit(1048576.0)).alias("edge"), "last", "part", "n_part",
                       (F.coalesce("upto", "before") + F.coalesce(F.col("n_part") * F.col("part.c"), F.lit(0))).alias("words"))


def plan_mix(docs: DataFrame, weight: Column | None = None, weights=WEIGHTS, share: float = SHARE,
             most: float = MOST, fills: int = FILLS, seed: str = SEED):
    """Targets and rank cuts per source; ``apply_mix`` turns them into copies.

    Returns (table of one row a source, hint): the hint broadcasts that table
    when it has at most MOST_BROADCAST_SOURCES rows, otherwise Spark joins it
    by sort and merge (with its own skew handling).
    """
    meta = stage(_measured(docs, weight, seed).select("__mix_k", "size", "__mix_w", "__mix_u", "__mix_id"), "mix-meta")
    src = stage(source_targets(meta, weights, share, most), "mix-sources")
    hint = F.broadcast if src.count() <= MOST_BROADCAST_SOURCES else (lambda d: d)
    certain = (_ranked(meta.join(hint(src), "__mix_k"), most).groupBy("__mix_k")
               .agg(F.sum(F.col("__mix_whole") * F.col("size")).alias("certain")))
    src = stage(src.join(certain, "__mix_k", "left")
                .withColumn("amount0", F.greatest(F.col("target") - F.coalesce("certain", F.lit(0)), F.lit(0.0)))
                .drop("certain"), "mix-sources")
    for r in range(1 + fills):
        cand = _ranked(meta.join(hint(src), "__mix_k"), most).where(_open(r, most, fills))
        cut = _cut(cand, r, fills, hint)
        everything = (F.lit(2.0), F.lit(0.0))          # no crossing: all fit, nothing is wanted any more
        cut = cut.withColumnsRenamed({c: f"{c}{r}" for c in ("edge", "last", "part", "n_part")})
        src = (src.join(cut, "__mix_k", "left")
               .withColumn(f"amount{r + 1}", F.when(F.col("words").isNotNull(), F.col(f"amount{r}") - F.col("words"))
                           .otherwise(everything[1]))
               .withColumn(f"edge{r}", F.coalesce(f"edge{r}", everything[0])).drop("words"))
        src = stage(src, "mix-sources")
    return src, hint


def _some_of_ties(rows: DataFrame, fills: int, most: float) -> DataFrame:
    """Rows of ties of which only some fit, with __mix_more: 1 for the first of them as written, else 0.

    They are numbered by the task that wrote them, then over these tasks, so
    that a tie of any size is never in one task.
    """
    take = F.lit(None).cast("long")
    for r in range(1 + fills):
        mine = _eligible(r, most) & F.coalesce(_order(r, fills) == F.col(f"part{r}"), F.lit(False))
        take = F.coalesce(take, F.when(mine, F.col(f"n_part{r}")))
    tied = stage(rows.withColumn("__mix_take", take).where("__mix_take IS NOT NULL")
                 .withColumns({"__mix_task": F.spark_partition_id(), "__mix_row": F.monotonically_increasing_id()}), "mix-ties")
    tie = ["__mix_k", "__mix_id", "size"]
    before = Window.partitionBy(*tie).orderBy("__mix_task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = (tied.groupBy(*tie, "__mix_task").agg(F.count(F.lit(1)).alias("n"))
             .select(*tie, "__mix_task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__mix_before")))
    number = F.row_number().over(Window.partitionBy(*tie, "__mix_task").orderBy("__mix_row"))
    return (tied.withColumn("__mix_no", number).join(tasks, [*tie, "__mix_task"])
            .withColumn("__mix_more", (F.col("__mix_before") + F.col("__mix_no") <= F.col("__mix_take")).cast("int")))


def apply_mix(docs: DataFrame, plan, weight: Column | None = None, most: float = MOST, fills: int = FILLS,
              seed: str = SEED) -> DataFrame:
    """docs + size, source_size, target, copies and taken (words, repeats counted)."""
    src, hint = plan
    rows = _ranked(_measured(docs, weight, seed).join(hint(src), "__mix_k"), most)
    parts = [F.col(f"n_part{r}").isNotNull() for r in range(1 + fills)]
    ties = not src.where(reduce(or_, parts)).isEmpty()
    more = F.when(_won(1 + fills, most, fills), 1).otherwise(0)
    if ties:
        in_tie = reduce(or_, [_eligible(r, most) & F.coalesce(_order(r, fills) == F.col(f"part{r}"), F.lit(False))
                              for r in range(1 + fills)])
        some = _some_of_ties(rows, fills, most)
        rows = rows.where(~in_tie).withColumn("__mix_more", more)
        rows = rows.unionByName(some.select(*rows.columns))
        more = F.col("__mix_more")
    rows = rows.withColumn("copies", (F.col("__mix_whole") + more).cast("long")).withColumn("taken", F.col("copies") * F.col("size"))
    keep = [c for c in replace_columns(docs, ["size", "source_size", "target", "taken", "copies"]).columns]
    return rows.select(*keep, "size", "source_size", "target", "copies", "taken")


def mix(docs: DataFrame, weight: Column | None = None, **options) -> DataFrame:
    """All documents with the words the mix takes of each.

    A null text has no words; a null source is a source of its own; a source
    without words has target 0 and its documents one copy.  Of rows that share
    doc_id, source and size (also a null doc_id) as many are taken as fit;
    which of them is left open.  What a source takes stays below its target by
    less than its smallest document that could take another copy.  An empty
    table gives an empty result.  ``weight`` (null or negative: 0) makes
    inclusion odds unequal inside a source as well.  Input columns named like
    a result column are replaced, others pass through.
    """
    plan = plan_mix(docs, weight, **options)
    kept = {k: v for k, v in options.items() if k in ("most", "fills", "seed")}
    return apply_mix(docs, plan, weight, **kept)
