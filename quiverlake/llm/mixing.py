"""Mixing sources to target weights by Pfair scheduling, DataFrame functions only.

Each source's documents are cut, in key order, into blocks of ``block`` rows. The
weight of a source is an integer w; with W the sum over active sources, its j-th
block is released at slot floor(j W / w) and due by slot ceil((j + 1) W / w), and
every slot goes to the released block with the earliest deadline (ties: the
source's name). The number of blocks a source has had after any number of slots
then stays less than one block from its share.

The schedule repeats every W slots and depends on the weights alone, so it is
worked out once for W slots in a SQL ``aggregate`` (W is held to
``MAX_PERIOD``; it doesn't grow with the data). When a source has no block left,
the others go on in a new phase, with their weights as they are: nothing is
dropped, and the last block of a source may be short. What is computed on the
driver is a table of phases: at most (number of weighted sources)**2 rows.

Rows are numbered without putting a source into one task: range partitioning by
(source, key), the row's place within its partition, and partition offsets.

Defined cases: sources without a weight (also null) share ``other`` as one source
named "" ; rows with equal keys are ordered by a hash of all their columns, so only
equal rows may change places; null keys come first; texts, however long, are passed
through and never looked into but for that hash; an empty table gives an empty result;
extra columns pass through, but those named like the result's are refused.
"""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stage

MAX_PERIOD = 20_000
RESERVED = {"_mix_source", "_mix_block", "_mix_slot", "_mix_position", "_mix_row", "_mix_tie", "_m", "_p", "_s", "_n", "_from", "_before", "_ps", "_a", "_b", "_at", "_period", "_slots"}


def integer_weights(weights: dict[str, int]) -> dict[str, int]:
    if not weights or any(not isinstance(w, int) or w < 1 for w in weights.values()):
        raise ValueError("weights are integers of 1 or more")
    g = gcd(*weights.values())
    if sum(weights.values()) // g > MAX_PERIOD:
        raise ValueError(f"weights add up to more than {MAX_PERIOD}")
    return {k: w // g for k, w in sorted(weights.items())}


def pfair_period(spark: SparkSession, weights: list[int]) -> list[int]:
    """The source (index) of each slot of one period, earliest deadline first among released blocks."""
    total, n = sum(weights), len(weights)
    w = F.array(*[F.lit(x).cast("bigint") for x in weights])

    def step(a: Column, t: Column) -> Column:
        # source i may take slot t if block done[i] is released: floor(done W / w) <= t
        def choice(d: Column, i: Column) -> Column:
            wi = F.get(w, i)
            due = F.floor((d * total + total + wi - 1) / wi)
            return F.when(F.floor(d * total / wi) <= t, F.struct(due.cast("bigint").alias("due"), i.alias("i")))

        best = F.array_min(F.transform(a["done"], choice))["i"]
        pick = lambda b: F.struct(F.transform(a["done"], lambda d, i: F.when(i == b, d + 1).otherwise(d)).alias("done"), F.concat(a["order"], F.array(b)).alias("order"))
        return F.transform(F.array(best), pick)[0]

    start = F.struct(F.array_repeat(F.lit(0).cast("bigint"), n).alias("done"), F.expr("cast(array() as array<int>)").alias("order"))
    return spark.range(1).select(F.aggregate(F.sequence(F.lit(0), F.lit(total - 1)), start, step, lambda a: a["order"]).alias("o")).first()["o"]


def phases(spark: SparkSession, weights: dict[str, int], blocks: dict[str, int]) -> list[tuple]:
    """(source, first block, past-last block, slot of the phase's start, first block's number in it is 0, period, slots of the source in a period)."""
    left = {s: n for s, n in blocks.items() if n}
    done, at, out = dict.fromkeys(left, 0), 0, []
    while left:
        names = sorted(left)
        g = gcd(*[weights[s] for s in names])
        order = pfair_period(spark, [weights[s] // g for s in names])
        period = len(order)
        slots = [[t for t, i in enumerate(order) if i == k] for k in range(len(names))]
        # the phase ends after the slot in which the first source gives its last block
        last = lambda k, n: (n - 1) // len(slots[k]) * period + slots[k][(n - 1) % len(slots[k])]
        end = min(last(k, left[s]) for k, s in enumerate(names)) + 1
        for k, s in enumerate(names):
            took = end // period * len(slots[k]) + sum(t < end % period for t in slots[k])
            if took:
                out.append((s, done[s], done[s] + took, at, period, slots[k]))
                done[s] += took
                left[s] -= took
        left = {s: n for s, n in left.items() if n}
        at += end
    return out


def numbered(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """rows (staged) with ``name``: the place, from 0, of each row among those of equal by[0], in the order of by."""
    spark = rows.sparkSession
    # the low 33 bits of monotonically_increasing_id are the row's place in its partition
    placed = stage(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_m", F.monotonically_increasing_id()), "mix")
    part = F.shiftright("_m", 33)
    parts = placed.groupBy(part.alias("_p"), F.col(by[0]).alias("_s")).agg(F.count(F.lit(1)).alias("_n"), F.min("_m").alias("_from"))
    # a row for each partition and source in it: at most partitions + sources
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_s").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = spark.createDataFrame(parts.withColumn("_before", before).select("_p", "_s", "_from", "_before").collect(), "_p bigint, _s string, _from bigint, _before bigint")
    return placed.join(F.broadcast(offsets), (part == offsets["_p"]) & placed[by[0]].eqNullSafe(offsets["_s"])).withColumn(name, F.col("_m") - F.col("_from") + F.col("_before")).drop("_m", "_p", "_s", "_from", "_before")


def mix_sources(docs: DataFrame, weights: dict[str, int], block: int = 64, other: int = 1, source: str = "source", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """docs with _mix_source, _mix_block (of its source), _mix_slot and _mix_position (bigint: the order to read them in)."""
    spark = docs.sparkSession
    clash = {c for c in docs.columns if c.lower() in RESERVED}
    if clash:
        raise ValueError(f"columns that the mixture has itself: {', '.join(sorted(clash))}")
    weights = integer_weights({**{str(k): v for k, v in weights.items()}, "": other})
    known = F.array(*[F.lit(s) for s in weights])
    name = F.when(F.array_contains(known, F.col(source)), F.col(source)).otherwise(F.lit(""))
    plain = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    rows = docs.withColumn("_mix_source", F.coalesce(name, F.lit(""))).withColumn("_mix_tie", F.xxhash64(*plain))
    rows = numbered(rows, ["_mix_source", *keys, "_mix_tie"], "_mix_row")
    rows = rows.withColumn("_mix_block", F.floor(F.col("_mix_row") / block).cast("bigint"))
    counts = {r["_mix_source"]: r["n"] for r in rows.groupBy("_mix_source").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most a row a weight
    table = phases(spark, weights, {s: -(-n // block) for s, n in counts.items()})
    plan = spark.createDataFrame(table, "_ps string, _a bigint, _b bigint, _at bigint, _period bigint, _slots array<int>")
    j = F.col("_mix_block") - F.col("_a")
    n = F.size("_slots")
    slot = F.col("_at") + F.floor(j / n) * F.col("_period") + F.get("_slots", (j % n).cast("int"))
    out = rows.join(F.broadcast(plan), (F.col("_mix_source") == F.col("_ps")) & (F.col("_mix_block") >= F.col("_a")) & (F.col("_mix_block") < F.col("_b")))
    out = out.withColumn("_mix_slot", slot.cast("bigint")).withColumn("_mix_position", (F.col("_mix_slot") * block + F.col("_mix_row") % block).cast("bigint"))
    return out.drop("_ps", "_a", "_b", "_at", "_period", "_slots", "_mix_row", "_mix_tie")


def oracle(weights: dict[str, int], block: int = 64, other: int = 1, table: str = "documents") -> str:
    """The same in DuckDB SQL: slot by slot in a recursive CTE."""
    w = integer_weights({**weights, "": other})
    names, values = "[" + ", ".join(f"'{k}'" for k in w) + "]", "[" + ", ".join(map(str, w.values())) + "]"
    return f"""
with recursive c as (select {names} as names, {values} as w),
d as (select doc_id, source, case when list_contains(c.names, source) then source else '' end as s from {table}, c),
r as (select doc_id, source, s, row_number() over (partition by s order by doc_id) - 1 as n from d),
b as (select s, ceil(count(*) / {float(block)})::bigint as blocks from r group by s),
lefts as (select list(coalesce(blocks, 0) order by i) as remaining from (select unnest(names) as s, generate_subscripts(names, 1) as i from c) n left join b using (s)),
run as (
  select 0::bigint as slot, 0::bigint as tau, remaining, list_transform(remaining, lambda x: 0::bigint) as done, list_transform(remaining, lambda x: 0::bigint) as gone, 0::bigint as pick, 0::bigint as nth from lefts
  union all
  select slot + 1, case when ended then 0 else tau + 1 end, rem2, case when ended then list_transform(done, lambda x: 0::bigint) else done2 end, gone2, p, gone[p]
  from (select *, list_contains(list_transform(rem2, lambda x, i: x = 0 and i = p), true) as ended
    from (select *, list_transform(remaining, lambda x, i: case when i = p then x - 1 else x end) as rem2, list_transform(done, lambda x, i: case when i = p then x + 1 else x end) as done2, list_transform(gone, lambda x, i: case when i = p then x + 1 else x end) as gone2
      from (select *, list_min(list_filter(list_transform(done, lambda x, i: case when remaining[i] > 0 and x * total // w[i] <= tau then ((x * total + total + w[i] - 1) // w[i]) * 1000 + i end), lambda x: x is not null)) % 1000 as p
        from (select run.*, c.w, list_sum(list_transform(run.remaining, lambda x, i: case when x > 0 then c.w[i] else 0 end))::bigint as total from run, c where list_sum(run.remaining) > 0)))))
select doc_id, source, s as mix_source, (n // {block})::bigint as mix_block, (slot - 1)::bigint as mix_slot, ((slot - 1) * {block} + n % {block})::bigint as mix_position
from r join run on run.pick > 0 and r.s = (select names from c)[run.pick] and run.nth = n // {block}"""
