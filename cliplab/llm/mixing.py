"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Every source s has a token target.  Among all document rates r between 0 and `limit` that meet the
targets, the ones nearest to the even rate q in relative entropy are

    r = min(limit, q * exp(lambda_s * size / mean_size_s)),

and lambda solves the convex dual, whose gradient per source is the tokens of the tilted rates minus
the target.  Newton steps, kept inside a bracket, run for all sources at once: each is one
aggregate over the counts of documents by (source, size), which is all that the rates depend on.

Rates become whole copies by systematic rounding: the fractional parts are added up in order of
size, and a copy is due whenever the sum passes a whole number; then one size per source gets a copy
more or less, the one that brings the source's words nearest to the target.  The sum runs over (source, size) counts; which documents
of one size get the copy is decided by rank of hash inside hash buckets, so neither a hot source
nor a hot size meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cliplab.llm.graph import sized
from cliplab.llm.stored import private, quoted
from cliplab.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
SLICES = 256  # hash buckets of the documents of one source and size
STEPS = 80
NEAR = 1e-10


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights: tuple[float, ...], share: float, limit: float) -> DataFrame:
    """(source, total) -> (source, source_size, target).

    Weights go to sources by code point, null last, and repeat.  Targets are share * (all sizes) by
    weight; what exceeds limit * (a source's size) is shared by weight among the others until none
    exceeds.  That is the level t with sum(min(limit * size, t * weight)) = share * all: sources fill
    up in order of limit * size / weight.  One row per source passes through one task.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    cap = F.col("source_size") * F.lit(float(limit))
    rows = sources.withColumns({"weight": weight, "cap": cap})
    rows = rows.withColumn("fills", F.col("cap") / F.col("weight"))
    filling = Window.orderBy("fills", F.col("source").asc_nulls_last())
    whole = filling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns(
        {
            "full": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
            "open": F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
            "budget": F.sum("source_size").over(whole) * F.lit(float(share)),
        }
    )
    level = (F.col("budget") - F.col("full")) / F.col("open")
    # the first source that does not fill up fixes the level of all after it
    fits = F.when(level <= F.col("fills"), level)
    level = F.first(fits, ignorenulls=True).over(whole)
    target = F.least("cap", F.coalesce(F.col("weight") * level, F.col("cap")))
    return rows.select("source", "source_size", target.alias("target"))


def _rate(limit: float) -> Column:
    return F.least(F.lit(float(limit)), F.col("even") * F.exp(F.col("tilt") * F.col("size") / F.col("mean")))


def _exact(total: Column) -> Column:
    """A sum that does not depend on the order of its rows."""
    return F.sum(total.cast("decimal(30,8)")).cast("double")


def tilts(counts: DataFrame, targets: DataFrame, share: float, limit: float) -> DataFrame:
    """(source, size, n) and targets -> one `tilt` per source, with `even` and `mean` to form rates.

    A source whose target is its limit gets no tilt but the rate `limit` at once (`full`).
    """
    mean = counts.groupBy("source").agg((F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("mean"))
    state = targets.join(mean, targets["source"].eqNullSafe(mean["source"])).drop(mean["source"])
    state = state.select(
        "source", "source_size", "target", F.greatest("mean", F.lit(1e-9)).alias("mean"),
        F.lit(min(share, limit)).alias("even"), F.lit(0.0).alias("tilt"), F.lit(-1e6).alias("low"), F.lit(1e6).alias("high"),
        (F.col("target") >= F.col("source_size") * limit * (1 - NEAR)).alias("full"), F.lit(1.0).alias("off"),
    )
    state = cut_lineage(state)
    many, few = counts.count(), state.count()
    counts, state = sized(counts, many), sized(state, few)
    for _ in range(STEPS):
        if state.filter(f"NOT full AND source_size > 0 AND off > {NEAR}").isEmpty():
            break
        met = sized(counts.join(state.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s"))), many)
        rate, words = _rate(limit), F.col("n") * F.col("size")
        slope = F.when(rate < limit, words * rate * F.col("size") / F.col("mean")).otherwise(0.0)
        step = met.groupBy("source").agg(_exact(words * rate).alias("got"), _exact(slope).alias("slope"))
        step = step.withColumnRenamed("source", "__s")
        now = state.join(step, F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s")
        over = F.col("got") > F.col("target")
        now = now.withColumns(
            {
                "low": F.when(over, F.col("low")).otherwise(F.col("tilt")),
                "high": F.when(over, F.col("tilt")).otherwise(F.col("high")),
                "off": F.abs(F.col("got") - F.col("target")) / F.greatest(F.col("target"), F.lit(1.0)),
            }
        )
        newton = F.col("tilt") + (F.col("target") - F.col("got")) / F.greatest("slope", F.lit(1e-300))
        inside = newton.between(F.col("low"), F.col("high")) & (F.abs(newton - F.col("tilt")) < 8)
        # outside the bracket, or far off, go on by doubling from zero or by halving the bracket
        far = F.when(over, F.least(F.col("tilt") * 2, F.col("tilt") - 1)).otherwise(F.greatest(F.col("tilt") * 2, F.col("tilt") + 1))
        halved = F.when(far.between(F.col("low"), F.col("high")), far).otherwise((F.col("low") + F.col("high")) / 2)
        settled = F.col("off") <= NEAR
        now = now.withColumn("tilt", F.when(settled, F.col("tilt")).otherwise(F.when(inside, newton).otherwise(halved)))
        state = cut_lineage(sized(now.select(*state.columns), few))
    return state.select("source", "source_size", "target", "mean", "even", F.round("tilt", 9).alias("tilt"), "full")


def _nearest(rated: DataFrame, limit: float) -> DataFrame:
    """Give one copy more or less to one size per source, the one that brings its words nearest to the target."""
    words = (F.col("whole") * F.col("n") + F.col("extra")) * F.col("size")
    gap = rated.groupBy(F.col("source").alias("__s")).agg((F.max("target") - F.sum(words)).alias("gap"))
    rows = rated.join(gap, F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    more = (F.col("gap") > 0) & (F.col("whole") + 1 <= limit) & (F.col("extra") < F.col("n"))
    less = (F.col("gap") < 0) & (F.col("extra") > 0)
    change = F.when(more, 1).when(less, -1)
    left = F.abs(F.col("gap") - change * F.col("size"))
    rows = rows.withColumns({"change": change, "left": F.when(left < F.abs("gap"), left)})
    best = rows.filter("left IS NOT NULL").groupBy(F.col("source").alias("__s")).agg(
        F.min(F.struct("left", "size")).getField("size").alias("__best")
    )
    chosen = rows.join(best, F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s")
    extra = F.col("extra") + F.when(F.col("size") == F.col("__best"), F.col("change")).otherwise(0)
    return chosen.withColumn("extra", extra.cast("long")).select(*rated.columns)


def mix_copies(
    docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, limit: float = 2.0, seed: int = 7
) -> DataFrame:
    """One row per row of `docs`: doc_id, text_hash, source, size, source_size, target, copies, taken (= copies * size).

    size is the number of words between ASCII white space (null text: 0).  copies is 0 to ceil(limit).
    Null sources are a source of their own; null doc_ids are kept; repeated rows count each for
    itself.  A document of size 0 gets the even rate, rounded like the others.  The result depends on
    the rows alone: reruns and other partitionings agree.
    """
    sized = docs.select("doc_id", "source", F.xxhash64("text").alias("text_hash"), word_count(F.col("text")).alias("size"))
    draw = F.xxhash64(F.lit(seed), "doc_id", "text_hash")
    sized = cut_lineage(sized.withColumns({"draw": draw, "slice": F.pmod(draw, F.lit(SLICES)).cast("int")}))
    cells = sized.groupBy("source", "size", "slice").agg(F.count(F.lit(1)).alias("n"))
    counts = cut_lineage(cells.groupBy("source", "size").agg(F.sum("n").alias("n")))
    totals = counts.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    solved = tilts(counts, source_targets(totals, weights, share, limit), share, limit)

    named = solved.withColumnRenamed("source", "__s")
    rated = counts.join(named, F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    rate = F.when(F.col("full"), F.lit(float(limit))).otherwise(_rate(limit))
    rated = rated.withColumn("rate", rate).withColumns(
        {"whole": F.floor("rate").cast("long"), "part": F.col("rate") - F.floor("rate")}
    )
    by_size = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    due = F.coalesce(F.sum(F.col("part") * F.col("n")).over(by_size), F.lit(0.0)) + 0.5
    extra = (F.floor(due + F.col("part") * F.col("n")) - F.floor(due)).cast("long")
    rated = cut_lineage(_nearest(rated.withColumn("extra", extra), limit))
    rated = rated.select(
        F.col("source").alias("__s"), F.col("size").alias("__z"), F.col("n").alias("__n"), "source_size", "target", "whole", "extra"
    )
    placed = cells.join(rated, F.col("source").eqNullSafe(F.col("__s")) & (F.col("size") == F.col("__z")))
    by_slice = Window.partitionBy("source", "size").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.coalesce(F.sum("n").over(by_slice), F.lit(0))
    share_of = lambda n: F.floor(F.col("extra") * n / F.col("__n"))  # noqa: E731  whole numbers: at most n per slice
    quota = placed.select(
        "__s", "__z", F.col("slice").alias("__b"), "source_size", "target", "whole",
        (share_of(begin + F.col("n")) - share_of(begin)).cast("long").alias("extra"),
    )
    in_slice = Window.partitionBy("source", "size", "slice").orderBy("draw", "doc_id", "text_hash")
    ranked = sized.withColumn("rank", F.row_number().over(in_slice))
    same = F.col("source").eqNullSafe(F.col("__s")) & (F.col("size") == F.col("__z")) & (F.col("slice") == F.col("__b"))
    copies = F.col("whole") + (F.col("rank") <= F.col("extra")).cast("long")
    out = ranked.join(quota, same).withColumn("copies", copies)
    return out.select(
        "doc_id", "text_hash", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """The mix itself: each row of `docs` as often as its copies.  Columns stay as they are, whatever their names.

    Rows are found by doc_id, source and a hash of the text, so null and repeated ids do no harm.  Of rows that are
    equal in all three, whichever Spark meets first stands for all their copies.
    """
    names = ("mix_doc_id", "mix_source", "mix_text_hash", "mix_hash", "mix_n", "mix_rows")
    doc_id, source, text_hash, of_text, n, rows = private(docs, *names)
    own = docs.withColumn(text_hash, F.xxhash64("text"))
    counts = mix_copies(docs, weights, share, limit).groupBy("doc_id", "source", "text_hash").agg(
        F.sum("copies").cast("int").alias(n), F.count(F.lit(1)).alias(rows)
    )
    counts = cut_lineage(counts.filter(F.col(n) > 0).withColumnsRenamed({"doc_id": doc_id, "source": source, "text_hash": of_text}))
    same = F.col("doc_id").eqNullSafe(F.col(doc_id)) & F.col("source").eqNullSafe(F.col(source)) & (F.col(text_hash) == F.col(of_text))
    taken = own.join(counts.filter(F.col(rows) == 1), same)
    several = counts.filter(F.col(rows) > 1)
    if not several.isEmpty():
        taken = taken.unionByName(own.join(several, same).dropDuplicates([doc_id, source, text_hash]))
    repeated = taken.withColumn(doc_id, F.explode(F.sequence(F.lit(1), F.col(n))))
    return repeated.select(*[F.col(quoted(c)) for c in docs.columns])
