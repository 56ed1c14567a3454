"""Entropy balancing: document rates that meet word targets per source, and their rounding into copies.

With word targets ``T`` and at most ``cap`` copies, the rates closest to 1 in (bounded) relative entropy have the form
``cap / (1 + exp(-(t0 + lambda * size / mean size)))``: their odds are tilted exponentially in the document's size,
and ``lambda = 0`` gives rate 1.  The words taken grow with ``lambda``, one number per source, so it is bracketed and found by
Newton steps that stay inside the bracket.  Documents of one source and size share a rate, so the sums run over
(source, size) cells, counted before the shuffle; a source that owns a third of all rows has as many cells as it has
distinct sizes.

Rates become whole copies per cell by differences of rounded running totals; what is left of the target (at most half
of the largest size) is then filled or taken back by whole copies, from large sizes down.  Inside a cell, documents in
hash order get the copies that the cell has beyond an equal share.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewire.functions.barrier import once

_KEY = ["__null", "__source"]
#: Walks after the first only serve sources whose documents below the rest are used up.
WALKS = 4


def source_targets(sources: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """Word targets of sources (one row each: ``__null``, ``__source``, ``source_size``).

    Sources in code-point order, null last, weigh ``weights`` in turn and share ``share`` of all words; a target
    stops at ``cap`` times the source's words, and what is above is shared again until none is above.  The rows are
    one per source name, so they are ordered in one place.
    """
    by_name = Window.orderBy(*_KEY)
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    everything = Window.partitionBy()
    weighed = sources.select(
        *_KEY, "source_size",
        F.element_at(cycle, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).alias("w"),
        (F.col("source_size") * F.lit(float(cap))).alias("most"),
    )
    ranked = Window.orderBy(F.col("most") / F.col("w"), *_KEY)
    level = weighed.select(
        "*",
        (F.sum("source_size").over(everything) * F.lit(float(share))
         - F.coalesce(F.sum("most").over(ranked.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).alias("left"),
        F.sum("w").over(ranked.rowsBetween(0, Window.unboundedFollowing)).alias("rest"),
    ).withColumn("free", F.col("most") * F.col("rest") > F.col("left") * F.col("w"))
    first = F.min(F.when(F.col("free"), F.struct(F.col("most") / F.col("w"), *_KEY, "left", "rest"))).over(everything)
    shared = F.col("__first.left") * F.col("w") / F.col("__first.rest")
    return level.withColumn("__first", first).select(
        *_KEY, "source_size", F.coalesce(F.least("most", shared), F.col("most")).alias("target")
    )


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once; inside ``aggregate`` there is no other way to name one."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _tilt(cap: float) -> Column:
    return F.lit(0.0) if cap <= 1 else F.log(F.lit(1.0 / (cap - 1.0)))


def _multiplier(cap: float) -> Column:
    """``lambda`` of a source with ``cells``: Newton steps inside a bracket, halved where a step leaves it or is slow.

    The words taken grow with ``lambda``, so the bracket holds the answer all the time.  It ends below a word's
    thousandth (or the sum's own precision), or when no number lies inside the bracket.  Every slow step halves the
    bracket, and doubles are halved about 1,100 times at most, which bounds the steps; 5 to 20 are usual.
    """
    t0 = _tilt(cap)
    per_word = F.col("docs_of_source") / F.col("source_size")

    def at(lam: Column) -> Column:
        def add(so_far: Column, cell: Column) -> Column:
            p = F.lit(1.0) / (1 + F.exp(-(t0 + lam * cell["size"] * per_word)))
            return _let(p, lambda p: F.struct(
                (so_far["words"] + cell["n"] * cell["size"] * F.lit(cap) * p).alias("words"),
                (so_far["slope"] + cell["n"] * cell["size"] * F.lit(cap) * p * (1 - p) * cell["size"] * per_word).alias("slope"),
            ))

        zero = F.struct(F.lit(0.0).alias("words"), F.lit(0.0).alias("slope"))
        return F.aggregate("cells", zero, add, lambda s: F.struct((s["words"] - F.col("target")).alias("gap"), s["slope"].alias("slope")))

    def state(lam, low, high, last, done) -> Column:
        return F.struct(lam.alias("lam"), low.alias("low"), high.alias("high"), last.alias("last"), done.alias("done"))

    def step(now: Column, _: Column) -> Column:
        def moved(g: Column) -> Column:
            low, high = F.when(g["gap"] < 0, now["lam"]).otherwise(now["low"]), F.when(g["gap"] < 0, now["high"]).otherwise(now["lam"])
            newton = now["lam"] - F.try_divide(g["gap"], g["slope"])
            fast = (newton > low) & (newton < high) & (2 * F.abs(newton - now["lam"]) <= now["last"])
            to = F.when(fast, newton).otherwise((low + high) / 2)
            near = F.abs(g["gap"]) <= F.greatest(F.lit(1e-3), F.col("target") * 1e-12)
            return _let(F.struct(low.alias("low"), high.alias("high"), to.alias("to")), lambda n: F.when(
                near | (n["to"] <= n["low"]) | (n["to"] >= n["high"]),
                state(now["lam"], n["low"], n["high"], now["last"], F.lit(True)),
            ).otherwise(state(n["to"], n["low"], n["high"], F.abs(n["to"] - now["lam"]), F.lit(False))))

        return F.when(now["done"], now).otherwise(_let(at(now["lam"]), moved))

    smallest = F.array_min(F.transform(F.filter("cells", lambda c: c["size"] > 0), lambda c: c["size"]))
    # where every document is at rate 0 or cap, to the last bit
    edge = (F.abs(t0) + 60.0) / (smallest * per_word)
    ratio = F.col("target") / (F.col("source_size") * F.lit(cap))
    first = F.greatest(-edge, F.least(edge, F.log(F.try_divide(ratio, 1 - ratio)) - t0))
    start = _let(edge, lambda e: state(first, -e, e, 2 * e, F.lit(False)))
    return F.aggregate(F.sequence(F.lit(1), F.lit(2300)), start, step, lambda s: s["lam"])


def _rates(cells: DataFrame, cap: float) -> DataFrame:
    """Cells with their rates.  A source's cells are one array in the order of sizes, so that sums, and with them
    reruns, agree to the last bit."""
    per_source = [*_KEY, "source_size", "docs_of_source", "target"]
    one = cells.groupBy(*per_source).agg(F.array_sort(F.collect_list(F.struct("size", "n"))).alias("cells"))
    ratio = F.try_divide(F.col("target"), F.col("source_size") * F.lit(cap))
    inner = (F.col("source_size") > 0) & (ratio > 0) & (ratio < 1)
    # computed once a source, before its cells are rows again
    one = once(one, lam=F.when(inner, _multiplier(cap)))
    out = one.select(*per_source, "lam", F.inline("cells"))
    rate = F.lit(cap) / (1 + F.exp(-(_tilt(cap) + F.col("lam") * F.col("size") * F.col("docs_of_source") / F.col("source_size"))))
    edge = F.when(ratio >= 1, F.lit(cap)).otherwise(F.lit(0.0))
    return out.select(*per_source, "size", "n", F.when(F.col("lam").isNotNull(), rate).otherwise(edge).alias("rate"))


def _filled(rest: Column) -> Column:
    """``cells`` (ascending sizes, ``m`` copies) after one walk down the sizes that brings the words ``rest`` nearer.

    Every cell gives all the copies that fit into what is still to do.  A cell that could give more than fits is a
    stop; what is left after a stop is below half of what was left after the stop before, so stops are few and are the
    only thing the walk keeps.  Where no size fits any more, the smallest larger one goes along if that comes nearer,
    and the next walk goes the other way.
    """
    todo, up = F.abs(rest), rest >= 0

    def room(cell: Column) -> Column:
        return F.when(up, cell["n"] * F.col("cap") - cell["m"]).otherwise(cell["m"])

    def state(left, bound, stops) -> Column:
        return F.struct(left.alias("left"), bound.alias("bound"), stops.alias("stops"))

    def stop(at, times, left) -> Column:
        return F.struct(at.alias("at"), times.alias("times"), left.alias("left"))

    def walk(now: Column, cell: Column) -> Column:
        fits = F.floor(F.try_divide(now["left"], cell["size"])).cast("long")
        after = now["left"] - fits * cell["size"]
        return (
            F.when((cell["size"] > now["bound"]) | (cell["size"] <= 0) | (room(cell) <= 0), now)
            .when(fits >= room(cell), state(now["left"] - room(cell) * cell["size"], now["bound"], now["stops"]))
            .otherwise(state(after, after, F.concat(now["stops"], F.array(stop(cell["size"], fits, after)))))
        )

    none = F.array().cast("array<struct<at:bigint,times:bigint,left:bigint>>")
    walked = F.aggregate(F.reverse("cells"), state(todo, todo, none), walk)

    def larger(w: Column) -> Column:
        able = F.filter("cells", lambda c: (c["size"] > w["left"]) & (c["size"] < 2 * w["left"]) & (room(c) > gives(w, c)))
        return F.array_min(F.transform(able, lambda c: c["size"]))

    def gives(w: Column, cell: Column) -> Column:
        earlier = F.array_min(F.transform(F.filter(w["stops"], lambda s: s["at"] > cell["size"]), lambda s: s["left"]))
        here = F.try_element_at(F.filter(w["stops"], lambda s: s["at"] == cell["size"]), F.lit(1))
        return F.when(here.isNotNull(), here["times"]).when((cell["size"] > 0) & (cell["size"] <= F.coalesce(earlier, todo)), room(cell)).otherwise(F.lit(0))

    def result(w: Column) -> Column:
        def changed(more: Column) -> Column:
            def cell(c: Column) -> Column:
                by = gives(w, c) + F.when(c["size"] == more, 1).otherwise(0)
                m = c["m"] + F.when(up, by).otherwise(-by)
                return F.struct(c["size"].alias("size"), c["n"].alias("n"), c["rate"].alias("rate"), m.cast("long").alias("m"))

            return F.transform("cells", cell)

        return _let(larger(w), changed)

    return _let(walked, result)


def _whole_copies(cells: DataFrame, cap: int) -> DataFrame:
    """``m`` copies for each cell: rounded running totals of the rates, then walks that fill or take back the rest."""
    per_source = [*_KEY, "source_size", "docs_of_source", "target"]
    down = Window.partitionBy(*_KEY).orderBy(F.col("size").desc())
    out = cells.withColumn("run", F.round(F.sum(F.col("n") * F.col("rate")).over(down.rowsBetween(Window.unboundedPreceding, Window.currentRow))).cast("long"))
    out = out.withColumn("m", F.col("run") - F.coalesce(F.lag("run").over(down), F.lit(0)))
    out = out.withColumn("m", F.greatest(F.lit(0), F.least(F.col("m"), F.col("n") * cap)).cast("long"))
    one = out.groupBy(*per_source).agg(F.array_sort(F.collect_list(F.struct("size", "n", "rate", "m"))).alias("cells"))
    one = one.withColumn("cap", F.lit(cap))
    taken = F.aggregate("cells", F.lit(0).cast("long"), lambda s, c: s + c["m"] * c["size"])
    for _ in range(WALKS):
        one = once(one, rest=F.round(F.col("target") - taken).cast("long"))
        one = once(one, now=F.when(F.col("rest") == 0, F.col("cells")).otherwise(_filled(F.col("rest"))))
        one = one.select(*per_source, "cap", F.col("now").alias("cells"))
    return one.select(*per_source, F.inline("cells"))


def balance(
    rows: DataFrame,
    key: Sequence[str],
    source: str = "source",
    size: str = "size",
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.0,
    cap: int = 3,
    buckets: int = 256,
) -> DataFrame:
    """Copies that each row gets, so that every source's words come near its target.

    ``key`` names columns that tell rows apart (ids, checksums); they give the hash order inside a cell.  Returns all
    columns of ``rows`` with ``source_size`` long, ``target`` double, ``rate`` double and ``copies`` int (0 .. cap).
    A null source is a source of its own, after the others; a null size counts as 0; rows without words get the
    copies that their rate rounds to.  Rows that agree in all of ``key`` are told apart by their position only.  An
    empty table stays empty.  Input columns named like an output are replaced.
    """
    given = [c for c in rows.columns if c not in ("source_size", "target", "rate", "copies")]
    cell, part = [*_KEY, "__size"], "__bucket"
    tagged = rows.select(*given).withColumns(
        {
            "__null": F.col(source).isNull(),
            "__source": F.coalesce(F.col(source).cast("string"), F.lit("")),
            "__size": F.coalesce(F.col(size).cast("long"), F.lit(0)),
            "__hash": F.xxhash64(*key),
        }
    )
    tagged = tagged.withColumn(part, F.pmod(F.col("__hash"), F.lit(buckets)))
    parts = tagged.groupBy(*cell, part).agg(F.count(F.lit(1)).alias("__n"))
    cells = parts.groupBy(*cell).agg(F.sum("__n").alias("n")).withColumnRenamed("__size", "size")
    sources = cells.groupBy(*_KEY).agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("docs_of_source"))
    targets = source_targets(sources.drop("docs_of_source"), weights, share, cap)
    cells = cells.join(sources, _KEY).join(targets.drop("source_size"), _KEY)
    whole = _whole_copies(_rates(cells, float(cap)), cap)
    whole = whole.select(*_KEY, F.col("size").alias("__size"), F.col("n").alias("__docs"), "source_size", "target", "rate", "m")
    earlier = Window.partitionBy(*cell).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.withColumn("__before", F.coalesce(F.sum("__n").over(earlier), F.lit(0))).join(whole, cell).drop("__n")
    inside = Window.partitionBy(*cell, part).orderBy("__hash", *key)
    placed = tagged.withColumn("__rank", F.row_number().over(inside)).join(offsets, [*cell, part])
    extra: Column = (F.col("__before") + F.col("__rank") <= F.expr("m % __docs")).cast("long")
    return placed.select(*given, "source_size", "target", "rate", (F.expr("m div __docs") + extra).cast("int").alias("copies"))
