"""Medians over the peers already visible at each row.

For every row: the exact median of a value over the rows of its cohort that come
earlier (filing day, then a tie key) and whose symbol is a member on the row's
day. Writing that as a self join emits all pairs of a cohort. Instead it is an
order statistic over a growing (and, with membership, shrinking) multiset:

1. every row is an insertion at its position, leaving and re-entering members
   are removals and insertions at their dates, and every row is also a question;
2. values are numbered in their order within the cohort, equal ones each for itself, and
   the numbers are cut into classes: about the square root of the cohort, 1,024 at least;
3. positions in time come from ``ranked`` too and are cut into blocks of bounded size;
4. per (cohort, block) the class holding the wanted rank is found from the class counts
   carried into the block plus the block's own events;
5. per (cohort, class, block) the number, so the value, is found in the same way.

A question goes down two levels and an event stays in its own block at both. What is
repeated are the counts carried into a block: one per class, and one per number of a class
for every block whose questions reach that class. For a cohort of n rows these are about
n ** 1.5 / BLOCK_ROWS and n, so fewer than the rows up to n = BLOCK_ROWS ** 2. No task holds
a cohort; the plan is the same for all sizes, and no count on the driver chooses a step.
Cohorts and rows go through the steps as hashes of 64 bits, metrics as numbers, so that what
is sorted and sent to Python is numbers only: a row is known by both hashes together.
"""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import cut, stack
from .ordering import null_safe_join, ranked
from .spans import OPEN_START

BLOCK_ROWS = 32_768
CLASS_ROWS = 1_024
MARK = "struct<value:double,node:long,child:long>"
PUT, ASK, CARRY = 1, 2, 3


def nth_in_stream(code: np.ndarray, weight: np.ndarray, rank: np.ndarray, carry: np.ndarray) -> tuple:
    """Order statistics over a changing multiset, all questions at once.

    Events are in time order; ``weight`` is +1/-1 for a change and 0 for a
    question with its 1-based ``rank``. ``carry[c]`` counts class c beforehand.
    Returns the class holding each question's rank and the rank inside it, by
    walking the classes bit by bit: at each bit a running count of the lower half
    tells every question which half to enter.
    """
    bits = max(1, int(len(carry) - 1).bit_length())
    size = 1 << bits
    prefix = np.concatenate([[0], np.cumsum(np.pad(carry, (0, size - len(carry))))])
    question = weight == 0
    node = np.zeros(len(code), dtype=np.int64)
    want = rank.astype(np.int64).copy()
    order = np.arange(len(code))
    for bit in range(bits - 1, -1, -1):
        half = 1 << bit
        n, c, q = node[order], code[order], question[order]
        low = np.where(q, 0, weight[order] * (((c >> bit) & 1) == 0))
        run = np.cumsum(low)
        first = np.concatenate([[True], n[1:] != n[:-1]])
        base = np.maximum.accumulate(np.where(first, np.arange(len(n)), 0))
        start = run[base] - low[base]
        lo_edge = n * 2 * half
        below = run - start + prefix[lo_edge + half] - prefix[lo_edge]
        right = np.where(q, want[order] > below, ((c >> bit) & 1) == 1)
        want[order] = np.where(q & right, want[order] - below, want[order])
        node[order] = n * 2 + right
        order = order[np.argsort(node[order], kind="stable")]
    return node, want


def _ints(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).combine_chunks().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)


def _in_block(table: pa.Table) -> pa.Table:
    """Step 4 for one (cohort, metric, block): classes and ranks of the block's questions."""
    kind, code, weight, seq = (_ints(table, c) for c in ("kind", "code", "weight", "seq"))
    carry = np.zeros(int(code.max()) + 1, dtype=np.int64)
    np.add.at(carry, code[kind == CARRY], weight[kind == CARRY])
    live = np.flatnonzero(kind != CARRY)
    live = live[np.argsort(seq[live], kind="stable")]
    asked = kind[live] == ASK
    change = np.where(asked, 0, weight[live])
    visible = np.cumsum(change) + carry.sum()
    rows = table.select(["cohort", "metric", "block", "seq", "row_id"]).take(pa.array(live[asked]))
    seen = visible[asked]
    parts = []
    for end, want in ((0, (visible + 1) // 2), (1, visible // 2 + 1)):
        found, rest = nth_in_stream(code[live], change, np.where(asked, want, 0), carry)
        parts.append(pa.table({
            **{n: rows.column(n) for n in rows.column_names},
            "end": pa.array(np.full(len(seen), end, dtype=np.int32)), "visible": pa.array(seen),
            "code": pa.array(found[asked].astype(np.int32)), "rank": pa.array(rest[asked])}))
    return pa.concat_tables(parts)


def _in_class(table: pa.Table) -> pa.Table:
    """Step 5 for one (cohort, metric, class, block): the values of the block's questions."""
    kind, child, weight, seq, rank, end = (_ints(table, c) for c in ("kind", "child", "weight", "seq", "rank", "end"))
    values = table.column("value").combine_chunks().to_numpy(zero_copy_only=False).astype(float)
    held = kind != ASK
    value_of = np.full(int(child.max()) + 1, np.nan)
    value_of[child[held]] = values[held]
    carry = np.zeros(len(value_of), dtype=np.int64)
    np.add.at(carry, child[kind == CARRY], weight[kind == CARRY])
    live = np.flatnonzero(kind != CARRY)
    order = live[np.lexsort((end[live], seq[live]))]
    asked = kind[order] == ASK
    found, _ = nth_in_stream(child[order], np.where(asked, 0, weight[order]), np.where(asked, rank[order], 0), carry)
    rows = table.select(["cohort", "metric", "row_id", "visible"]).take(pa.array(order[asked]))
    return rows.append_column("value", pa.array(value_of[found[asked]]))


def _events(rows: DataFrame, spans: DataFrame | None) -> DataFrame:
    """Changes and questions of one table of (cohort, metric, filed, tie, symbol, row_id, mark)."""
    dated = F.col("filed").isNotNull()
    # order within a cohort: phase, day, 0 = membership change / 1 = rows, tie key, step
    ask = rows.select("cohort", "metric", "row_id", F.lit(ASK).alias("kind"), F.lit(0).alias("weight"),
                      F.lit(None).cast(MARK).alias("mark"),
                      F.when(dated, 0).otherwise(2).alias("phase"), F.col("filed").alias("at"),
                      F.lit(1).alias("layer"), "tie", F.lit(1).alias("step"))
    cols = ask.columns
    valued = rows.where("mark is not null")
    entry = valued.select("cohort", "metric", "row_id", F.lit(PUT).alias("kind"), F.lit(1).alias("weight"), "mark",
                          F.when(dated, 0).otherwise(1).alias("phase"), F.col("filed").alias("at"),
                          F.lit(1).alias("layer"), "tie", F.lit(2).alias("step"), "symbol", "filed")
    # a row without a date sees its whole cohort except itself: take it out around its question
    aside = valued.where(~dated).select(
        "cohort", "metric", "row_id", F.lit(PUT).alias("kind"), "mark", "tie",
        F.explode(F.array(F.struct(F.lit(-1).alias("weight"), F.lit(0).alias("step")),
                          F.struct(F.lit(1).alias("weight"), F.lit(2).alias("step")))).alias("_m")) \
        .select("cohort", "metric", "row_id", "kind", F.col("_m.weight").alias("weight"), "mark",
                F.lit(2).alias("phase"), F.lit(None).cast("date").alias("at"), F.lit(1).alias("layer"), "tie",
                F.col("_m.step").alias("step"))
    if spans is None:
        changes = entry.select(*cols)
    else:
        # membership as disjoint intervals per symbol; symbols without any span are admitted
        floor_day = F.lit(OPEN_START).cast("date")
        steps = _disjoint(spans, floor_day)
        joined = entry.join(steps, "symbol", "left").where(
            F.col("s").isNull() | F.col("filed").isNull() | F.col("e").isNull() | (F.col("e") > F.col("filed")))
        late = F.col("s") > F.col("filed")
        begin = joined.where(F.col("filed").isNotNull()).select(
            "cohort", "metric", "row_id", "kind", "weight", "mark", "phase",
            F.when(late, F.col("s")).otherwise(F.col("at")).alias("at"),
            F.when(late, 0).otherwise(1).alias("layer"), "tie", "step")
        finish = joined.where(F.col("filed").isNotNull() & F.col("e").isNotNull()).select(
            "cohort", "metric", "row_id", "kind", F.lit(-1).alias("weight"), "mark", "phase", F.col("e").alias("at"),
            F.lit(0).alias("layer"), "tie", F.lit(0).alias("step"))
        # questions without a date see every member or not: bring all back after the dated phase
        undated = entry.where(F.col("filed").isNull()).select(*cols)
        away = entry.where(F.col("filed").isNotNull()).select(
            "cohort", "metric", "row_id", "kind", "weight", "mark", F.lit(1).alias("phase"),
            F.lit(None).cast("date").alias("at"), F.lit(1).alias("layer"), "tie", F.lit(2).alias("step"))
        gone = stack(begin, finish).select(
            "cohort", "metric", "row_id", "kind", (-F.col("weight")).alias("weight"), "mark",
            F.lit(1).alias("phase"), F.lit(None).cast("date").alias("at"), F.lit(0).alias("layer"), "tie",
            F.lit(3).alias("step"))
        has_undated = rows.where(F.col("filed").isNull()).select("cohort", "metric").distinct()
        restore = null_safe_join(stack(gone, away), has_undated, ["cohort", "metric"], "leftsemi")
        changes = stack(begin, finish, undated, restore.select(*cols))
    return stack(ask, changes.select(*cols), aside.select(*cols))


def _disjoint(spans: DataFrame, floor_day: Column) -> DataFrame:
    from .spans import membership_steps
    steps = membership_steps(spans, "symbol")
    w = Window.partitionBy("symbol").orderBy("date")
    edge = steps.withColumn("_was", F.lag("open_spans", 1, 0).over(w)) \
        .where("(open_spans > 0) <> (_was > 0) or date = date '0001-01-01'")
    nxt = edge.withColumn("e", F.lead("date").over(w))
    inside = nxt.where("open_spans > 0").select("symbol", F.col("date").alias("s"), "e")
    before = nxt.where("open_spans = 0 and date = date '0001-01-01'")
    return stack(inside, before.select("symbol", F.col("date").alias("s"), F.col("date").alias("e")))


def carried(puts: DataFrame, asked: DataFrame, within: Sequence[str], child: str) -> DataFrame:
    """What each child of a node holds before every block that asks for the node.

    ``puts``: (within, child, block, weight, value); ``asked``: (within, block, fan), a node
    and how many children it can have. Events are summed per child and block before they move.
    """
    held = puts.groupBy(*within, child, "block").agg(F.sum("weight").alias("weight"), F.max("value").alias("value"))
    wanted = asked.where("block > 0").select(*within, F.explode(F.sequence(F.lit(0).cast("long"), F.col("fan") - 1)).alias(child), "block",
                                             F.lit(0).cast("long").alias("weight"), F.lit(True).alias("wanted"))
    both = stack(held, wanted).groupBy(*within, child, "block").agg(
        F.sum("weight").alias("weight"), F.max("value").alias("value"), F.max("wanted").alias("wanted"))
    earlier = Window.partitionBy(*within, child).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = both.select(*within, child, "block", "wanted", F.sum("weight").over(earlier).alias("weight"),
                         F.max("value").over(earlier).alias("value"))
    return before.where("wanted and weight <> 0").drop("wanted").withColumn("kind", F.lit(CARRY))


def visible_medians(df: DataFrame, cohort: Sequence[str], metrics: Sequence[str], filed: str, tie: str,
                    symbol: str = "symbol", spans: DataFrame | None = None, min_peers: int = 5,
                    block_rows: int = BLOCK_ROWS, class_rows: int = CLASS_ROWS) -> DataFrame:
    """Add ``<metric>_median`` and ``<metric>_n_peers`` over the visible peers of each row.

    ``tie`` must be unique within a cohort and day. ``spans`` (symbol,
    start_date, end_date) restricts peers to members on the row's own day. ``df``
    is read twice; hand in a checkpointed one if it is costly. A task meets at most
    ``block_rows`` events, the questions among them and the counts of one class or of all
    classes; ``class_rows`` is the least size of a class.
    """
    row_key = [filed, tie]
    keyed = df.select(_hash(cohort).alias("cohort"), F.col(filed).alias("filed"), F.col(tie).alias("tie"),
                      F.col(symbol).alias("symbol"), _hash(row_key).alias("row_id"), *metrics)
    long = keyed.select("cohort", "filed", "tie", "symbol", "row_id", F.explode(F.array(*[
        F.struct(F.lit(i).alias("metric"), F.col(m).cast("double").alias("value")) for i, m in enumerate(metrics)])).alias("_m")) \
        .select("cohort", "filed", "tie", "symbol", "row_id", "_m.*")
    # the number of a row's value among the values of its cohort; rows without one come last
    numbered = ranked(long, ["cohort", "metric"], [F.col("value").asc_nulls_last(), F.col("row_id")], "number")
    sizes = long.groupBy("cohort", "metric").agg(F.count("value").alias("_n")).select(
        "cohort", "metric", F.greatest(F.lit(class_rows), F.ceil(F.sqrt("_n"))).cast("long").alias("width"), "_n") \
        .withColumn("classes", F.greatest(F.ceil(F.col("_n") / F.col("width")), F.lit(1)).cast("long")).drop("_n")
    number = F.col("number") - 1
    marked = numbered.join(sizes, ["cohort", "metric"]).withColumn("mark", F.when(F.col("value").isNotNull(), F.struct(
        "value", F.floor(number / F.col("width")).alias("node"), (number % F.col("width")).alias("child"))))
    log = _events(marked.select("cohort", "metric", "filed", "tie", "symbol", "row_id", "mark"), spans)
    events = ranked(log, ["cohort", "metric"],
                    [F.col(c) for c in ("phase", "at", "layer", "tie", "step", "weight", "row_id")], "seq")
    events = cut(events.select("cohort", "metric", F.floor(F.col("seq") / block_rows).alias("block"), "seq", "row_id", "kind",
                               F.col("weight").cast("long").alias("weight"), "mark.*"))
    puts = events.where(f"kind = {PUT}")

    # the class of each wanted rank
    blocks = events.select("cohort", "metric", "block").distinct().join(sizes, ["cohort", "metric"]).withColumn("fan", F.col("classes"))
    classes = carried(puts, blocks, ["cohort", "metric"], "node").drop("value")
    in_blocks = stack(events.drop("value", "child"), classes).withColumnRenamed("node", "code")
    asked = cut(in_blocks.groupBy("cohort", "metric", "block").applyInArrow(
        _in_block, "cohort long, metric int, block long, seq long, row_id long, end int, "
                   "visible long, code int, rank long"))

    # the value inside the class, for the classes and blocks that questions reached
    node = ["cohort", "metric", "node"]
    questions = asked.where(F.col("visible") >= max(min_peers, 1)).withColumn("node", F.col("code").cast("long"))
    reached = questions.select(*node, "block").distinct()
    values = carried(puts, reached.join(sizes, ["cohort", "metric"]).withColumn("fan", F.col("width")), node, "child")
    supply = puts.join(reached, [*node, "block"], "leftsemi").drop("row_id")
    demand = questions.select(*node, "block", "seq", "row_id", F.lit(ASK).alias("kind"), "rank", "end", "visible")
    ends = stack(demand, supply, values).groupBy(*node, "block").applyInArrow(
        _in_class, "cohort long, metric int, row_id long, visible long, value double")
    few = asked.where(F.col("visible") < max(min_peers, 1)).select("cohort", "metric", "row_id", "visible")
    return _attach(df, stack(ends, few), cohort, row_key, metrics)


def _hash(columns: Sequence[str]) -> Column:
    """64 bits of the values; nulls count, each at its place."""
    return F.xxhash64(*[x for c in columns for x in (F.col(c), F.col(c).isNull())])


def _attach(df: DataFrame, seen: DataFrame, cohort: Sequence[str], row_key: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Answers (cohort, row_id, metric, visible, value: the two middle ones) back as columns of the rows."""
    wide = seen.groupBy(F.col("cohort").alias("_its_cohort"), F.col("row_id").alias("_its_row")).agg(*[e for i, m in enumerate(metrics) for e in (
        F.avg(F.when(F.col("metric") == i, F.col("value"))).alias(f"{m}_median"),
        F.max(F.when(F.col("metric") == i, F.col("visible"))).alias(f"{m}_n_peers"))])
    out = df.withColumns({"_cohort": _hash(cohort), "_row": _hash(row_key)})
    joined = out.join(wide, (F.col("_cohort") == F.col("_its_cohort")) & (F.col("_row") == F.col("_its_row")), "left")
    joined = joined.drop("_cohort", "_row", "_its_cohort", "_its_row")
    return joined.withColumns({f"{m}_n_peers": F.coalesce(F.col(f"{m}_n_peers"), F.lit(0)) for m in metrics})
