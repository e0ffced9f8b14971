"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barwright.llm.common import keep

WEIGHTS = (5, 2, 1)
SHARE = 1.5
REPEATS = 2


def word_count(text: F.Column) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """(source, source_size, weight, target) for sizes(source, source_size), one row per source.

    Sources in code point order, null last, get the weights in turn. The targets share `share` of all sizes by weight;
    a target stops at `repeats` times its source's size and the excess goes to the others by weight, until none is
    above. Each round is one aggregation, and only sums reach the driver.
    """
    ranged = keep(sizes.repartitionByRange(F.asc_nulls_last("source")).withColumn("p", F.spark_partition_id()))
    before = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    first = ranged.groupBy("p").agg(F.count("*").alias("n")).select("p", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))  # a row for each partition
    place = F.row_number().over(Window.partitionBy("p").orderBy(F.asc_nulls_last("source"))) - 1 + F.col("base")
    turn = F.array(*map(F.lit, weights))
    named = keep(ranged.join(F.broadcast(first), "p").select("source", "source_size", F.element_at(turn, (F.pmod(place, F.lit(len(weights))) + 1).cast("int")).cast("double").alias("weight")))
    cap = F.lit(float(repeats)) * F.col("source_size")
    budget = share * (named.agg(F.sum("source_size")).first()[0] or 0)
    rate, stopped = 0.0, None
    while True:
        full = F.lit(rate) * F.col("weight") > cap
        r = named.agg(F.coalesce(F.sum(F.when(full, cap)), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)), F.count(F.when(full, 1))).first()
        if r[2] == stopped or not r[1]:
            break
        stopped, rate = r[2], (budget - r[0]) / r[1]
    return named.withColumn("target", F.least(cap, F.lit(rate) * F.col("weight")))


def _sorted(rows: DataFrame, *order: F.Column) -> DataFrame:
    """Kept rows in ranges of the order, with the range's number as `p`. The last key must tell all rows apart."""
    return keep(rows.repartitionByRange(*order).withColumn("p", F.spark_partition_id()))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0, **how) -> DataFrame:
    """(id, source, size, source_size, target, copies, taken) for each row: how often the mix takes a document.

    A source's documents stand in an order shuffled by a hash of id and seed, `repeats` times over. Each copy ends at
    virtual time (its source's words up to and with it) / (its source's target); the copies of all sources are ranged by
    that time and taken while the words up to and with them are within the budget, the sum of targets. Copies are taken
    whole; one with no words costs nothing. taken is copies times size, at most `repeats` times size.

    Both orders are global range sorts: sums of ranges, a small table, give the words before each range, and a window
    within a range gives the rest. Ranges are as many as shuffle partitions and nearly equal in rows, whatever the sources,
    ids and times, so no source and no stretch of time is gathered in one task.

    Null texts and texts without words have size 0; a null source is a source; rows with null ids stand in an order by
    size; rows that agree in id, source and size are interchangeable. An empty table gives no rows.
    """
    repeats = how.get("repeats", REPEATS)
    text = F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.unhex(F.md5(text)).alias("h"))
    source = F.asc_nulls_last("source")
    ranged = _sorted(keep(rows.withColumn("n", F.monotonically_increasing_id())), source, "h", "id", "size", "n")
    parts = keep(ranged.groupBy("source", "p").agg(F.sum("size").alias("words")))
    plan = targets(parts.groupBy("source").agg(F.sum("words").alias("source_size")), **how)

    upto = Window.partitionBy("source").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("source", "p", F.coalesce(F.sum("words").over(upto), F.lit(0)).alias("start"))  # at most a row for each range and each source
    starts = starts.join(plan, starts["source"].eqNullSafe(plan["source"])).select(starts["source"].alias("s_source"), F.col("p").alias("s_p"), "start", "source_size", "target")
    inner = Window.partitionBy("p", "source").orderBy("h", "id", "size", "n").rowsBetween(Window.unboundedPreceding, 0)
    run = ranged.withColumn("within", F.sum("size").over(inner))
    placed = run.join(starts, (run["p"] == starts["s_p"]) & run["source"].eqNullSafe(starts["s_source"]))
    placed = keep(placed.select("n", "id", "source", "size", "h", "source_size", "target", (F.col("start") + F.col("within")).alias("upto")))

    copies = placed.where("size > 0").select("n", "source", "size", "h", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("copy"), "upto", "source_size", "target")
    time = (F.col("upto") + F.col("copy") * F.col("source_size")) / F.col("target")
    order = (F.col("time").asc(), source, F.col("h").asc(), F.col("copy").asc(), F.col("n").asc())
    queue = _sorted(copies.select("n", "source", "size", "h", "copy", time.alias("time")), *order)
    ahead = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    sums = queue.groupBy("p").agg(F.sum("size").alias("words"))
    sums = sums.select("p", "words", F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("before"))  # a row for each range
    budget = plan.agg(F.coalesce(F.sum("target"), F.lit(0.0))).first()[0]
    budget = round(budget + 1e-6, 3)
    # Ranges that are within the budget as a whole are taken; only the one that crosses it needs its rows in order.
    marked = queue.join(F.broadcast(sums), "p")
    whole = marked.where(F.col("before") + F.col("words") <= budget).select("n")
    ordered = Window.partitionBy("p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    cut = marked.where((F.col("before") < budget) & (F.col("before") + F.col("words") > budget))
    cut = cut.withColumn("at", F.col("before") + F.sum("size").over(ordered)).where(F.col("at") <= budget).select("n")
    taken = whole.unionByName(cut).groupBy("n").agg(F.count("*").alias("copies"))
    out = placed.join(taken, "n", "left").withColumn("copies", F.coalesce("copies", F.lit(0)))
    return out.select("id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def apply(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The rows of `docs`, all columns, each as often as the mix takes it.

    Rows that share an id, source and size have as many copies in all as mix() gives them together, dealt in the order
    of the texts. Documents without words are not taken.
    """
    taken = mix(docs, id_col, text_col, source_col, **how).where("copies > 0").groupBy("id", "source", "size").agg(F.count("*").alias("rows"), F.sum("copies").alias("copies"))
    picks = keep(taken.select(F.col("id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size"), "rows", F.col("copies").alias("_copies")))
    sized = docs.select(F.struct(*[docs[c].alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("row"), docs[id_col].alias("_i"), docs[source_col].alias("_s"), word_count(docs[text_col]).alias("_n"))
    same = sized["_i"].eqNullSafe(picks["_id"]) & sized["_s"].eqNullSafe(picks["_source"]) & (sized["_n"] == picks["_size"])
    both = sized.join(picks, same)
    one = both.where("rows = 1 and _copies > 0").select("row", "_copies")
    more = picks.where("rows > 1")
    if not more.isEmpty():
        several = Window.partitionBy("_id", "_source", "_size").orderBy("t")
        dealt = both.where("rows > 1").withColumn("t", F.col(f"row.c{docs.columns.index(text_col)}")).withColumn("k", F.row_number().over(several))
        spread = F.expr("_copies div rows + if(k <= _copies % rows, 1, 0)")
        one = one.unionByName(dealt.select("row", spread.alias("_copies")).where("_copies > 0"))
    out = one.select("row", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))).alias("_copy"))
    return out.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])
