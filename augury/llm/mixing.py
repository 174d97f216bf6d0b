"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

Targets: each source's share of the mix follows its weight, up to a multiple of its own words; what a full source
can't take is shared again by weight among the rest. With the sources sorted by the level at which they fill up, the
level of the others follows from running sums.

Documents: a source of S words with target T wants every document T/S times on average, more or less by its
importance. The whole part of that number is allocated for certain. The fraction is an inclusion probability p: the
documents are ranked by the random odds u/(1-u) divided by the inclusion odds p/(1-p), and taken in this order until
their words come nearest to what the target leaves. The order is never formed over a whole source: words are first
added up in cells of the rank, so that only one cell's documents need sorting together.

Draws are hashes of seed, id and source: reruns and other partitionings agree. Cases: NULL text has size 0; a NULL
source is a source of its own, the last; rows with equal id, source and size share one decision, so repeated rows all
get the same; an empty table gives an empty mix; documents of size 0 are taken 0 times over; other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from augury.llm.common import WORD, text_or_empty
from augury.operators.ordered import null_safe_join, ordered
from augury.session import materialise

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
SEED = 7
CELLS = 4096  # per source: each holds about this part of the source's documents


def words(text: str) -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def length_importance() -> Column:
    """The number of binary digits of the size plus two: longer documents are somewhat likelier."""
    return F.length(F.bin(F.col("size") + 2))


def draw(seed: int) -> Column:
    """A number in (0, 1) from the first 52 bits of a hash of seed, id and source."""
    text = F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("id").cast("string"), F.lit("?")), F.coalesce(F.col("source").cast("string"), F.lit("?")))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Adds ``target`` to ``source, source_size``: sources by code point, NULL last, weigh ``weights`` in turn."""
    named = sources.withColumn("_null", F.col("source").isNull().cast("int"))
    placed = ordered(named, [], ["_null", "source"]).running("sum", F.lit(1), "_place").df
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("_place") - 1) % len(weights) + 1).cast("int")).cast("long")
    full = placed.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * most)
    full = materialise(full.withColumn("_level", F.col("_cap") / F.col("_w").cast("double")), "sources")
    sums = full.agg(F.sum("source_size").alias("_all"), F.sum("_w").alias("_ws"))
    filled = ordered(full, [], ["_level", "_place"]).running("sum", F.col("_cap"), "_caps").running("sum", F.col("_w"), "_weights").df
    level = (F.lit(float(share)) * F.col("_all") - (F.col("_caps") - F.col("_cap"))) / (F.col("_ws") - (F.col("_weights") - F.col("_w")))
    levels = filled.crossJoin(F.broadcast(sums)).select("_level", "_place", level.alias("_open")).where("_open <= _level")
    first = levels.agg(F.min_by("_open", F.struct("_level", "_place")).alias("_open"))
    return full.crossJoin(F.broadcast(first)).select(
        *sources.columns, F.least(F.col("_cap").cast("double"), F.coalesce(F.col("_open") * F.col("_w"), F.col("_cap").cast("double"))).alias("target")
    )


def mix(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    most: int = MOST,
    importance: Column | None = None,
    seed: int = SEED,
) -> DataFrame:
    """``id, source, size, source_size, target, copies, taken, n_rows``: one row for each (id, source, size).

    ``importance``: whole numbers from ``id``, ``source`` and ``size``; an average document has the source's average.
    """
    weigh = (F.lit(1) if importance is None else importance).cast("long")
    rows = docs.select(F.col(id).alias("id"), F.col(source).alias("source"), words(text).alias("size"))
    units = rows.groupBy("id", "source", "size").agg(F.count("*").alias("n_rows"))
    units = materialise(units.withColumns({"_u": draw(seed), "_v": weigh, "_x": F.col("size") * F.col("n_rows")}), "units")
    sources = units.groupBy("source").agg(F.sum("_x").alias("source_size"), F.sum(F.col("_x") * F.col("_v")).alias("_vx"))
    # Written, so that the joins with it are broadcast if its true size allows that and shuffled if not.
    sources = materialise(targets(materialise(sources, "sources"), weights, share, most), "targets")

    wanted = F.least(F.lit(float(most)), F.coalesce(F.try_divide(F.col("target") * F.col("_v"), F.col("_vx").cast("double")), F.lit(0.0)))
    some = null_safe_join(units, sources, ["source"], "left").withColumn("_wanted", wanted)
    some = some.withColumn("_whole", F.floor("_wanted")).withColumn("_p", F.col("_wanted") - F.col("_whole"))
    open_ = F.col("_whole") < most
    left = some.groupBy("source").agg(
        (F.first("target") - F.sum(F.col("_whole") * F.col("_x"))).alias("_left"),
        F.sum(F.when(open_, F.col("_x")).otherwise(0)).alias("_room"),
    )
    left = materialise(left, "left")
    some = null_safe_join(some, left, ["source"], "left")
    # The rank is scaled by the source's mean odds, which keeps its order and spreads it evenly over the cells.
    mean = F.least(F.lit(0.999999), F.greatest(F.lit(0.000001), F.coalesce(F.try_divide(F.col("_left"), F.col("_room").cast("double")), F.lit(0.0))))
    some = some.withColumn("_mean", mean)
    over, under = F.col("_u") * (1 - F.col("_p")) * F.col("_mean"), F.col("_p") * (1 - F.col("_u")) * (1 - F.col("_mean"))
    some = some.withColumn("_rank", F.when(~open_, 2.0).when(F.col("_p") <= 0, 1.0).otherwise(over / (over + under)))
    cell = F.floor(F.col("_rank") * CELLS) * CELLS + F.when(F.col("_rank") >= 1, F.floor(F.col("_u") * CELLS)).otherwise(0)
    some = some.withColumn("_cell", cell)

    cells = some.groupBy("source", "_cell").agg(F.sum("_x").alias("_words"))
    earlier = Window.partitionBy("source").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("source", "_cell", F.coalesce(F.sum("_words").over(earlier), F.lit(0)).alias("_before"))
    some = null_safe_join(some, cells, ["source", "_cell"], "left")
    within = Window.partitionBy("source", "_cell").orderBy("_rank", "_u", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("_before") + F.coalesce(F.sum("_x").over(within), F.lit(0))
    extra = (open_ & (2 * before + F.col("_x") <= 2 * F.col("_left"))).cast("long")
    copies = (F.col("_whole") + extra).cast("long")
    return some.withColumn("copies", copies).select(
        "id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "n_rows"
    )


def take(docs: DataFrame, decisions: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of ``docs`` as often as ``decisions`` of ``mix`` say, all columns kept."""
    chosen = decisions.where("copies > 0").select(F.col("id").alias("__id"), F.col("source").alias("__source"), F.col("size").alias("__size"), F.col("copies").alias("__copies"))
    same = F.col("__doc")[id].eqNullSafe(F.col("__id")) & F.col("__doc")[source].eqNullSafe(F.col("__source")) & (F.col("__words") == F.col("__size"))
    rows = docs.select(F.struct("*").alias("__doc"), words(text).alias("__words")).join(chosen, same)
    return rows.select("__doc", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select("__doc.*")
