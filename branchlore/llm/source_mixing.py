"""Mixing sources to target weights by weighted fair queueing.

Every source queues its documents in a shuffled order, up to three passes.  A copy's virtual
finish time is the source's words up to and with it, divided by the source's target.  The mix
is the queue of all copies in order of finish time, cut where the budget is used up.

Running sums never meet in one task: the shuffle key of a document is a uniform number, its
leading bits name a cell, cells are summed first, and only inside a cell rows are ordered.
The global queue is ranged the same way, by cells of the finish time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from branchlore.llm.common import SPACES, kept_columns, whole
from branchlore.staging import stage

WEIGHTS = (1, 2, 3)  # given to the sources in turn, by code point, null last
MAX_PASSES = 3
SEED = "mix"
KEY_BITS = 60
ROWS_PER_CELL = 4096
LEAST_CELLS = 64
KEY = "source_mixing_row_key"


def _key(rows: DataFrame) -> Column:
    """The key of a row's id, text and source; a missing source is unlike any text."""
    return F.xxhash64("doc_id", "text", F.col("source").isNull(), "source").alias(KEY)


def document_sizes(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """``doc_id``, ``source``, ``size`` (words), ``h`` (shuffle key) and the row key of every row."""
    rows = kept_columns(docs, "doc_id", "source", "text")
    name = F.coalesce(F.col("doc_id").cast("string"), whole("text"))
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), name)), 1, KEY_BITS // 4), 16, 10).cast("long")
    size = F.size(F.array_remove(F.split(whole("text"), SPACES), "")).cast("long")
    return rows.select("doc_id", "source", size.alias("size"), h.alias("h"), _key(rows))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``source``, ``source_size`` and ``target`` (words) of every source; one row per source.

    The targets share the sum of all sizes by weight.  No target is above three times its
    source's size: sources are taken by that limit per weight, and each that reaches it leaves
    the rest to the others.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), F.pmod(turn, F.lit(len(weights))).cast("int") + 1).cast("long")
    rows = per_source.select("source", "source_size", weight.alias("weight"))
    limit = F.col("source_size") * MAX_PASSES
    by_limit = Window.orderBy(limit.cast("double") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    after = by_limit.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    rows = rows.withColumns(
        {
            "rest": F.sum("source_size").over(every) - F.coalesce(F.sum(limit).over(before), F.lit(0)),
            "of": F.sum("weight").over(after),
        }
    )
    rows = rows.withColumn("full", limit * F.col("of") <= F.col("weight") * F.col("rest"))
    # the others share what is left at the first source below its limit
    first = F.min(F.when(~F.col("full"), F.struct(limit.cast("double") / F.col("weight"), F.col("source").isNull(), "source", "rest", "of"))).over(every)
    share = first["rest"].cast("double") * F.col("weight") / first["of"]
    return rows.select("source", "source_size", F.when(F.col("full"), limit.cast("double")).otherwise(share).alias("target"))


def _cells(rows: int) -> int:
    """A power of two that grows with the rows, so that a cell's rows do not."""
    cells = LEAST_CELLS
    while cells * ROWS_PER_CELL < rows:
        cells *= 2
    return cells


def finish_times(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, seed: str = SEED) -> DataFrame:
    """Every row with its source's size and target and ``upto``: the source's words up to and with it."""
    sizes = stage(document_sizes(docs, seed), "mix-sizes")
    cells = _cells(sizes.count())
    cell = F.shiftright("h", KEY_BITS - cells.bit_length() + 1).alias("cell")
    rows = sizes.select("*", cell)
    per_cell = rows.groupBy("source", "cell").agg(F.sum("size").alias("in_cell"))
    ahead = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    per_cell = per_cell.withColumn("ahead", F.coalesce(F.sum("in_cell").over(ahead), F.lit(0))).drop("in_cell")
    targets = source_targets(sizes, weights)
    same = lambda a, b, *on: [a[c].eqNullSafe(b[c]) for c in on]
    known = per_cell.join(targets, same(per_cell, targets, "source")).select(
        per_cell["source"], "cell", "ahead", "source_size", "target"
    )
    inside = Window.partitionBy("source", "cell").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("inside", F.sum("size").over(inside))
    return rows.join(known, same(rows, known, "source", "cell")).select(
        "doc_id", rows["source"], "size", "h", KEY, "source_size", "target", (F.col("ahead") + F.col("inside")).alias("upto")
    )


def _place(pass_: Column) -> Column:
    """Where a copy stands in the queue of all copies: finish time first, the rest breaks ties."""
    finish = (pass_ * F.col("source_size") + F.col("upto")).cast("double") / F.col("target")
    return F.struct(
        finish.alias("finish"), F.col("source").isNull().alias("n"), F.col("source"), pass_.alias("pass"), F.col("h"),
        F.col("doc_id"), F.col("size"),
    )


def taken_copies(timed: DataFrame) -> DataFrame:
    """Adds ``copies``: how many copies of the row stand before the cut of the global queue."""
    queue = timed.where("size > 0").select(
        "size", "target", "source_size", "source", "upto", "h", "doc_id", F.explode(F.sequence(F.lit(0), F.lit(MAX_PASSES - 1))).alias("pass")
    )
    queue = queue.select("size", _place(F.col("pass")).alias("place"))
    total, rows = timed.agg(F.sum("size"), F.count(F.lit(1))).first()
    if not total:
        return timed.withColumn("copies", F.lit(0).cast("long"))
    width = _cells(rows)
    cell = F.floor(F.col("place.finish") * width)
    cells = queue.groupBy(cell.alias("cell")).agg(F.sum("size").alias("in_cell"))
    cells = cells.withColumn("ahead", F.sum("in_cell").over(Window.orderBy("cell")) - F.col("in_cell"))
    at = cells.where((F.col("ahead") <= total) & (F.col("ahead") + F.col("in_cell") > total)).first()
    queue = queue.withColumn("cell", cell)
    if at is None:  # the budget is not used up
        last = queue.agg(F.max("place").alias("place"))
    else:
        running = F.sum("size").over(Window.orderBy("place"))  # equal places go together
        inside = queue.where(F.col("cell") == at.cell).withColumn("upto", running + at.ahead).where(F.col("upto") <= total)
        before = queue.where(F.col("cell") < at.cell)
        last = inside.select("place").unionByName(before.select("place")).agg(F.max("place").alias("place"))
    row = last.first()
    if row.place is None:
        return timed.withColumn("copies", F.lit(0).cast("long"))
    cut = F.struct(*[F.lit(row.place[f.name]).cast(f.dataType).alias(f.name) for f in last.schema["place"].dataType.fields])
    passes = [F.when(_place(F.lit(p)) <= cut, 1).otherwise(0) for p in range(MAX_PASSES)]
    counted = F.when(F.col("size") > 0, sum(passes[1:], passes[0])).otherwise(0)
    return timed.withColumn("copies", counted.cast("long"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, seed: str = SEED) -> DataFrame:
    """Per document row ``doc_id``, ``size``, ``source_size``, ``target`` and ``taken`` (words, repeats counted).

    Missing and empty texts have size 0 and are not taken; rows without an id are shuffled by
    their text; equal rows are queued one after the other; an empty table gives none.  The
    same table gives the same mix again, however its rows are spread.
    """
    timed = stage(finish_times(docs, weights, seed), "mix-times")
    return taken_copies(timed).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


def ordered_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, seed: str = SEED) -> DataFrame:
    """The mix itself in queue order: the document's columns, ``mix_pass`` and ``mix_finish``, one row per copy.

    Where the documents have columns of these names, the added ones get underscores in front.
    Missing and empty texts are in no mix; a document is taken whole, however long; a row gets
    copies of its own source's queue, and of rows equal in id, text and source the least by all
    other columns of a document gets the first ones; an empty table gives none.
    """
    timed = stage(finish_times(docs, weights, seed), "mix-times")
    chosen = taken_copies(timed).where("copies > 0").select(
        KEY, F.explode(F.sequence(F.lit(0), F.col("copies").cast("int") - 1)).alias("pass"), "size", "target", "source_size", "source", "upto", "h", "doc_id"
    )
    # equal rows share a key: number them on both sides so that each meets one
    nth = lambda order, *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    chosen = chosen.select(KEY, "pass", _place(F.col("pass")).alias("place")).withColumn("nth", nth(["place"], KEY, "pass"))
    others = [F.col(f"doc.{c}") for c in ("lang", "n_chars") if c in docs.columns] or [F.lit(1)]
    texts = docs.select(F.struct("*").alias("doc"), _key(docs)).withColumn("nth", nth(others, KEY))
    pass_, finish = "mix_pass", "mix_finish"
    while {pass_, finish} & set(docs.columns):
        pass_, finish = f"_{pass_}", f"_{finish}"
    # both sides lie by their key already; only that one is joined on, the number is compared after
    chosen = chosen.select(F.col(KEY).alias("key"), F.col("nth").alias("nth_copy"), "pass", "place")
    same = (F.col(KEY) == F.col("key")) & (F.col("nth") - F.col("nth_copy") == 0)
    ranged = texts.join(chosen, same).orderBy("place")
    return ranged.select("doc.*", F.col("pass").alias(pass_), F.col("place.finish").alias(finish))
