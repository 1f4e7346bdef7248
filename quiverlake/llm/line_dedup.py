"""Line deduplication by a segment-partition edit join, DataFrame functions only.

Two lines (trimmed of white space, of ``min_length`` characters or more) link when
their edit distance is at most ``tau``; equal lines are one from the start.

1. *Lines.* Split and trimmed once, into a table on the shared folder. Two
   independently salted 64-bit hashes tell lines apart.
2. *Segments and probes.* A line is cut into tau + 1 segments. Of two linked lines,
   some segment i of the shorter stands whole in the longer, with exactly i - 1 edits
   before it and at most tau + 1 - i after it. Cuts depend on the class of a line's
   length alone (four classes between powers of two); the first segments are counted
   from the line's start, the others from its end, so that segment i can only have
   moved by min(i - 1, tau + 1 - i) characters. Its keys are hashes of windows a little
   shorter than the segment at a few places in it, so chosen that any two lines with
   such a shift have one in common. A line has the keys of its own class and of the
   classes of lines up to tau shorter: for tau = 3 six keys, mostly.
3. *Candidates.* Keys that only one line has are dropped by a count with partial
   aggregation. Of the lines that are left, pairs with a key in common, a difference
   of lengths up to tau and of letter counts up to 2 tau (read from one long) are
   verified by the banded bit-parallel distance (its 2 tau + 3 diagonals in one long) of
   what is left of them without common beginning and end. Each pair is verified once,
   whatever keys it shares.
4. *Large groups.* All lines of a key are first compared with a few leaders, which is
   linear and finds most links of a line's many variants. Only pairs in different
   components after that are compared with each other, by their numbers first (also by
   the parities of their pairs of characters) and each under one of its keys only, in
   one row, or in pairs of blocks of ``group`` / 2 lines where there are more than
   ``group``; only links leave the row. Lines that all share a segment, but hardly link,
   are the costly case: they are compared in pairs.

Lines are numbered in the order of their first places, so the smallest number of a
class is its first line.

Links are united into classes; a class's first line (by doc_id, then line number)
stays. Nothing is capped. Hashes stand for lines (128 bits) and, in the search for
candidates, for keys and lines (64 bits: of two near lines whose 64 bits are equal,
the link isn't found).

Defined cases: a null or empty text has no lines; blank lines aren't counted; lines
under ``min_length``, which must be more than tau, are only matched exactly; a very
long text or line is taken whole, a line's cost being in proportion to its length;
repeated rows repeat each other's lines; rows with equal doc_id are counted together,
rows without doc_id as one more document; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, discard, stage
from .graph import components
from .quality import let


def banded_distance(a: Column, b: Column, tau: int) -> Column:
    """Edit distance of two strings (a the shorter) if it is at most tau, else a larger number or null; bit-parallel over the band's diagonals."""
    w = 2 * tau + 3
    ones = (1 << w) - 1
    top = w - 1
    ahead = tau + 1

    def run(p: Column, t: Column) -> Column:
        m, n = F.size(p), F.size(t)

        def step(s: Column, j: Column) -> Column:
            # bit k: row j - ahead + k
            x = sum((F.when(F.get(p, j - ahead + k - 1) == F.get(t, j - 1), 1 << k).otherwise(0) for k in range(w)), F.lit(0)).cast("bigint")
            band = lambda v: v.bitwiseAND(F.lit(ones))
            inv = lambda v: v.bitwiseXOR(F.lit(ones))

            def after(x: Column) -> Column:
                vp, vn = s["vp"], s["vn"]
                d0 = band((x.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(x).bitwiseOR(vn))

                def moved(d0: Column) -> Column:
                    hp, hn = vn.bitwiseOR(inv(d0.bitwiseOR(vp))), d0.bitwiseAND(vp)

                    def out(h: Column) -> Column:
                        hp, hn = h["hp"], h["hn"]
                        half = F.shiftright(d0, 1)
                        bit = lambda v, k: F.call_function("shiftright", v, k.cast("int")).bitwiseAND(F.lit(1).cast("bigint"))
                        row = (m - j + ahead).cast("int")  # the last row's bit
                        down = F.lit(1).cast("bigint") - bit(d0, F.lit(top))
                        along = bit(hp, F.greatest(row, F.lit(0))) - bit(hn, F.greatest(row, F.lit(0)))
                        dist = s["dist"] + F.when(j + ahead <= m, down).otherwise(along)
                        return F.struct(band(hn.bitwiseOR(inv(half.bitwiseOR(hp)))).alias("vp"), half.bitwiseAND(hp).alias("vn"), dist.alias("dist"))

                    return let(F.struct(hp.alias("hp"), hn.alias("hn")), out)

                return let(d0, moved)

            return let(x, after)

        # before the first column the top bit stands at row ahead, at distance ahead; the last row is nearer in short strings
        start = F.struct(F.lit(ones & ~((1 << ahead) - 1)).cast("bigint").alias("vp"), F.lit(0).cast("bigint").alias("vn"), F.least(F.lit(ahead), m).cast("bigint").alias("dist"))
        return F.when(n == 0, m.cast("bigint")).otherwise(F.aggregate(F.sequence(F.lit(1), n), start, step, lambda s: s["dist"]))

    chars = lambda x: F.when(F.length(x) == 0, F.expr("cast(array() as array<string>)")).otherwise(F.split(x, ""))
    return let(chars(a), lambda p: let(chars(b), lambda t: run(p, t)))


def trimmed(a: Column, b: Column) -> Column:
    """struct(a, b) of two strings without their common beginning and end, which leave the edit distance as it is."""

    def common(part, x: Column, y: Column) -> Column:
        # by bisection: from the largest power of two down
        n = F.least(F.length(x), F.length(y))
        steps = F.transform(F.reverse(F.sequence(F.lit(0), F.length(F.bin(n.cast("bigint"))) - 1)), lambda e: F.call_function("shiftleft", F.lit(1), e))
        grow = lambda m, step: F.when((m + step <= n) & (part(x, m + step) == part(y, m + step)), m + step).otherwise(m)
        return F.aggregate(steps, F.lit(0), grow)

    def without_end(s: Column) -> Column:
        cut = lambda m: F.struct(F.left(s["a"], F.length(s["a"]) - m).alias("a"), F.left(s["b"], F.length(s["b"]) - m).alias("b"))
        return let(common(F.right, s["a"], s["b"]), cut)

    without_start = let(common(F.left, a, b), lambda m: F.struct(F.substr(a, m + 1, F.length(a)).alias("a"), F.substr(b, m + 1, F.length(b)).alias("b")))
    return let(without_start, without_end)


def within(a: Column, b: Column, tau: int) -> Column:
    """Whether two strings' edit distance is at most tau."""

    def near(s: Column) -> Column:
        short = F.length(s["a"]) <= F.length(s["b"])
        return F.coalesce(banded_distance(F.when(short, s["a"]).otherwise(s["b"]), F.when(short, s["b"]).otherwise(s["a"]), tau) <= tau, F.lit(False))

    return F.when(F.abs(F.length(a) - F.length(b)) <= tau, let(trimmed(a, b), near)).otherwise(False)


#: Lines of a key that are compared in one row; more are cut into blocks of half as many.
GROUP = 4096


def class_floor(n: Column) -> Column:
    """The least length in the class of length n: four classes between powers of two."""
    width = F.call_function("shiftleft", F.lit(1), F.length(F.bin(n.cast("bigint"))) - 3)
    return F.when(n < 8, n).otherwise(n - n % width)


def ruler(slack: int) -> list[int]:
    """Places whose differences are all numbers up to slack, found by a greedy rule."""
    out = [0]
    while missing := set(range(slack + 1)) - {abs(x - y) for x in out for y in out}:
        out.append(out[-1] + min(missing))
    return out


def keys(line: Column, raw: Column, n: Column, floors: list[Column], tau: int) -> Column:
    """Keys of a line of n > tau characters: hashes of (length class, segment, window). raw: its bytes, where each is a character, else null; floors: class_floor of n, n - 1, ... n - tau."""

    def of(text: Column, floor: Column, there: Column | None) -> list[Column]:
        size = F.floor(floor / (tau + 1)).cast("int")
        out = []
        for i in range(1, tau + 2):
            start = size * (i - 1) if i - 1 <= tau + 1 - i else n - size * (tau + 2 - i)
            places = ruler(min(i - 1, tau + 1 - i))
            for place in places:
                # where a segment is shorter than the ruler, its windows are empty and equal
                key = F.xxhash64(floor, F.lit(i), F.substr(text, start + 1 + place, F.greatest(size - places[-1], F.lit(0))))
                out.append(key if there is None else F.when(there, key))
        return out

    own = lambda text: F.array(*of(text, floors[0], None))
    more = [k for d in range(1, tau + 1) for k in of(line, floors[d], (floors[d] > tau) & (floors[d] != floors[d - 1]))]
    same = floors[tau] == floors[0]
    return F.when(same & raw.isNotNull(), own(raw)).when(same, own(line)).otherwise(F.array_compact(F.array(*of(line, floors[0], None), *more)))


def lines_of(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, no and line of each line that isn't blank."""
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("no", "line"))
    return rows.withColumn("line", F.btrim("line", F.lit(SPACES))).where(F.length("line") > 0)


#: Letters that are counted before two lines are compared.
COUNTED = " etaoinsrhldcumf"
#: Codes of counts mod 8 in which a step, from 7 to 0 too, changes one bit.
STEPS = [0b0000, 0b0001, 0b0011, 0b0111, 0b1111, 0b1110, 0b1100, 0b1000]


def letter_counts(line: Column) -> Column:
    """How often each of 16 letters occurs, mod 8, in four bits each: an edit changes at most two of the counts by one, so at most two bits."""
    steps = F.array(*[F.lit(x).cast("bigint") for x in STEPS])
    out = F.lit(0).cast("bigint")
    for i, c in enumerate(COUNTED):
        n = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(c)))
        out = out.bitwiseOR(F.shiftleft(F.get(steps, n % 8), 4 * i))
    return out


def alike(x: Column, y: Column, tau: int) -> Column:
    """Whether lengths (len) and letter counts leave it open that two lines link."""
    return (F.abs(x["len"] - y["len"]) <= tau) & (F.bit_count(x["counts"].bitwiseXOR(y["counts"])) <= 2 * tau)


def pair_parities(line: Column) -> Column:
    """Whether each kind of two neighbouring characters (64 kinds, by hash) occurs an odd number of times, as bits: an edit changes at most four."""
    one = F.lit(1).cast("bigint")
    flip = lambda c: lambda s, i: s.bitwiseXOR(F.call_function("shiftleft", one, F.pmod(F.hash(F.get(c, i - 1), F.get(c, i)), F.lit(64))))
    of = lambda c: F.aggregate(F.sequence(F.lit(1), F.size(c) - 1), F.lit(0).cast("bigint"), flip(c))
    return F.when(F.length(line) < 2, F.lit(0).cast("bigint")).otherwise(let(F.split(line, ""), of))


#: Up to so many pairs or ids (three numbers each at most) are broadcast; more are joined by merging.
MAX_BROADCAST = 500_000


def verified(pairs: DataFrame, nodes: DataFrame, tau: int) -> DataFrame:
    """The pairs (a, b) of node ids whose lines are within tau edits; each pair's two lines meet once."""
    pairs = stage(pairs.distinct(), "line-pairs")
    ends = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("_n"))
    lines = nodes.select("id", "line")
    hint = F.broadcast if pairs.count() <= MAX_BROADCAST else lambda x: x.hint("merge")
    both = lines.join(hint(ends), lines["id"] == ends["_n"]).groupBy("a", "b").agg(F.collect_list("line").alias("l"))
    links = stage(both.where(within(F.col("l")[0], F.col("l")[1], tau)).select("a", "b"), "line-links")
    discard(pairs)
    return links


def line_links(lines: DataFrame, first: DataFrame, tau: int, group: int) -> tuple[DataFrame, DataFrame]:
    """(nodes: id, row; links: a, b) of lines (ha, hb, n, line), whose first places are in first (ha, hb, first); ids are in the order of places."""
    floors = [F.col(f"f{d}") for d in range(tau + 1)]
    raw = F.when(F.octet_length("line") == F.col("n"), F.col("line").cast("binary"))
    keyed = lines.select("ha", "n", "line", raw.alias("raw"), *[class_floor(F.col("n") - d).alias(f"f{d}") for d in range(tau + 1)])
    keyed = keyed.select("ha", F.explode(keys(F.col("line"), F.col("raw"), F.col("n"), floors, tau)).alias("k"))
    # keys that different lines have; a line's occurrences are one before they are dealt
    met = keyed.groupBy("k").agg(F.min("ha").alias("lo"), F.max("ha").alias("hi")).where("lo <> hi").select(F.col("k").alias("_k"))
    cand = stage(keyed.join(met.hint("shuffle_hash"), keyed["k"] == met["_k"]).select("k", "ha"), "line-candidates")
    ids = stage(cand.select(F.col("ha").alias("_a")).distinct(), "line-ids")
    if ids.count() <= MAX_BROADCAST:
        nodes = lines.join(F.broadcast(ids), lines["ha"] == F.col("_a")).groupBy("ha", "hb").agg(F.first("line").alias("line"))
    else:  # equal lines are made one before they are dealt by hash
        nodes = lines.groupBy("ha", "hb").agg(F.first("line").alias("line")).join(ids.hint("merge"), F.col("ha") == F.col("_a")).drop("_a")
    nodes = nodes.join(first.withColumnsRenamed({"ha": "_fa", "hb": "_fb"}), (F.col("ha") == F.col("_fa")) & (F.col("hb") == F.col("_fb"))).drop("_fa", "_fb")
    nodes = nodes.repartitionByRange("first").sortWithinPartitions("first").withColumns({"id": F.monotonically_increasing_id(), "len": F.length("line"), "counts": letter_counts(F.col("line"))})
    nodes = stage(nodes, "line-nodes")
    traits = nodes.select(F.col("ha").alias("_a"), "id", "len", "counts")
    members = stage(cand.distinct().join(traits, cand["ha"] == F.col("_a")).select("k", "id", "len", "counts"), "line-members")
    discard(cand, ids)

    # leaders: the same for all lines of a key, by orders that have nothing to do with each other
    masks = [0, -1, 0x2545F4914F6CDD1D, 0x1FB21C651E98DF25]
    least = lambda m: F.min(F.col("id").bitwiseXOR(F.lit(m).cast("bigint"))).bitwiseXOR(F.lit(m).cast("bigint"))
    lead = members.groupBy("k").agg(F.count(F.lit(1)).alias("size"), *[least(m).alias(f"l{i}") for i, m in enumerate(masks)])
    lead = lead.select(F.col("k").alias("_k"), F.explode(F.array_distinct(F.array(*[f"l{i}" for i in range(len(masks))]))).alias("_l"))
    trait = lambda p: F.struct(F.col(f"{p}len").alias("len"), F.col(f"{p}counts").alias("counts"))
    lead = lead.join(nodes.select(F.col("id").alias("_i"), F.col("len").alias("_len"), F.col("counts").alias("_counts")), F.col("_l") == F.col("_i"))
    led = members.join(lead, (members["k"] == lead["_k"]) & (F.col("id") != F.col("_l"))).where(alike(trait(""), trait("_"), tau))
    found = verified(led.select(F.least("id", "_l").alias("a"), F.greatest("id", "_l").alias("b")), nodes, tau)

    # what leaders leave open: lines of a key that are in different components still
    comp = components(found).select(F.col("v").alias("_v"), F.col("comp").alias("_comp"))
    placed = stage(members.join(comp, members["id"] == F.col("_v"), "left").select("k", "id", "len", "counts", F.coalesce("_comp", "id").alias("comp")), "line-placed")
    open_ = placed.groupBy(F.col("k").alias("_k")).agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo <> hi and size > 2").select("_k", "size")
    blocks = F.when(F.col("size") <= group, F.lit(1).cast("bigint")).otherwise(F.ceil(F.col("size") / (group // 2 or 1)))
    opened = stage(placed.join(open_, placed["k"] == F.col("_k")).drop("_k"), "line-open")
    asked = opened.groupBy(F.col("id").alias("_i")).agg(F.collect_set("k").alias("keys"))  # a few a line
    texts = nodes.join(asked, nodes["id"] == asked["_i"]).select("_i", "keys", "line", pair_parities(F.col("line")).alias("pairs"))
    own = opened.join(texts, opened["id"] == F.col("_i")).withColumn("blocks", blocks).withColumn("g", F.pmod(F.xxhash64("id"), F.col("blocks")))
    own = own.withColumn("o", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    cells = own.groupBy("k", F.least("g", "o").alias("x"), F.greatest("g", "o").alias("y")).agg(F.collect_list(F.struct("id", "len", "counts", "comp", "g", "pairs", "keys", "line")).alias("m"))

    def mate(x: Column, y: Column) -> Column:
        other = (y["id"] > x["id"]) & (y["comp"] != x["comp"])
        here = (x["g"] != y["g"]) | (F.col("x") == F.col("y"))  # a block's own pairs are those of its cell on the diagonal
        near = alike(x, y, tau) & (F.bit_count(x["pairs"].bitwiseXOR(y["pairs"])) <= 4 * tau)
        once = F.array_min(F.array_intersect(x["keys"], y["keys"])) == F.col("k")  # of all keys that both have
        return other & here & near & once & within(x["line"], y["line"], tau)

    links = F.flatten(F.transform("m", lambda x: F.transform(F.filter("m", lambda y: mate(x, y)), lambda y: F.struct(x["id"].alias("a"), y["id"].alias("b")))))
    more = stage(cells.select(F.explode(links).alias("p")).select("p.a", "p.b"), "line-links")
    discard(members, placed, opened)
    return nodes.select("id", F.col("first.r").alias("row")), found.unionAll(more)


def line_verdicts(docs: DataFrame, tau: int = 1, min_length: int = 20, group: int = GROUP, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, no, line and verdict of each line that isn't blank: exact (equal to an earlier one), near (its class has an earlier line) or kept."""
    if min_length <= tau:
        raise ValueError("min_length must be more than tau: shorter lines have no segments")
    full = lines_of(docs, doc_id, text).withColumns({"n": F.length("line"), "ha": F.xxhash64("line"), "hb": F.xxhash64(F.lit(7), "line"), "row": F.monotonically_increasing_id()})
    full = stage(full, "lines", "zstd")
    # a null doc_id comes before all others; rows with equal doc_id have equal places but for the last field
    place = F.struct(F.col("doc_id").isNotNull().alias("h"), F.col("doc_id").alias("d"), F.col("no").alias("l"), F.col("row").alias("r"))
    first = stage(full.groupBy("ha", "hb").agg(F.min(place).alias("first")), "line-firsts")
    nodes, links = line_links(full.where(F.col("n") >= min_length).select("ha", "hb", "n", "line"), first, tau, group)
    near = components(links).where("v <> comp").select(F.col("v").alias("_v"))
    near = nodes.join(near, nodes["id"] == near["_v"]).select(F.col("row").alias("_n"))
    # by row, which is different for each, and not by line, of which one may be very common
    out = full.join(first.select(F.col("first.r").alias("_r")).hint("merge"), full["row"] == F.col("_r"), "left").join(near, full["row"] == F.col("_n"), "left")
    return out.select("doc_id", "no", "line", F.when(F.col("_r").isNull(), "exact").when(F.col("_n").isNotNull(), "near").otherwise("kept").alias("verdict"))


def line_dedup(docs: DataFrame, tau: int = 1, min_length: int = 20, group: int = GROUP, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_lines, n_exact (lines equal to an earlier one), n_near (others whose class has an earlier line) and n_kept, of each document, from its lines' verdicts."""
    lines = line_verdicts(docs, tau, min_length, group, doc_id, text).select("doc_id", "verdict")
    every = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.lit(None).cast("string").alias("verdict"))
    counts = [F.count_if(F.coalesce(F.col("verdict") == v, F.lit(False))).alias(f"n_{v}") for v in ("exact", "near", "kept")]
    return lines.unionAll(every).groupBy("doc_id").agg(F.count("verdict").alias("n_lines"), *counts)
