"""N-gram Jaccard self-join by a token-group matrix; links united into components.

Exact: two documents link when the Jaccard similarity of their sets of 5-word
shingles is at least 0.75. Equal sets are one class from the start. Then

1. *Shared prefix.* Of each set, in hash order, the first n - ceil(.75 n) + l
   shingles go into an exchange that counts in how many documents each occurs. A
   linked pair shares l shingles of these prefixes, so a set with fewer shared
   ones links with nothing. Counts travel as packed arrays by batch of documents,
   so a shingle of many documents is one entry a batch, not a group of rows.
2. *Shared set.* The same over the whole sets of those left: three quarters of a
   set's shingles must occur elsewhere.
3. *Clusters.* Rarest shingles first, a linked pair shares one of the first
   n - ceil(.75 n) + 1. Components over those shingles (each shingle tied to its
   smallest document, not all pairs) hold every link inside.
4. *Leaders' groups.* The matrix's first group of each cluster are up to ``LEADERS``
   central documents. A document's overlap with the union of their shingles bounds that
   with each; only where it can reach the threshold is the group opened. In copies with
   edits most links into a component are found here, in time linear in the cluster.
5. *Token-group matrix.* Clusters that are not one component yet are cut into
   groups of some ``GROUP`` similar documents, those of the main component and the others
   apart. The matrix has the rare shingles of step 3 by group; in a cluster of more than
   ``GROUP`` squared documents, a group of the others meets the groups that have one of its
   own: groups that share none never meet, however their clusters chain together (in a
   smaller cluster, all do). For each group its task stores the union of the members'
   shingles; a query document's overlap with the union bounds its overlap with every
   member, and only groups that can reach the threshold are opened. Pairs already in one
   component aren't compared.

All five are over all documents; nothing is capped. Sets, shingles and equal sets are
told by hashes (48 bits in the first count, which only makes candidates; 64 for shingles;
128 for sets). A rare shingle that very many groups share is the costly case of step 5:
they all meet.

Defined cases: a null or empty text, or one without words, has an empty set and
links with nothing; under five words the whole sequence is the one shingle; a very long
text is read whole, some numbers a word; rows with equal doc_id are one node; a null
doc_id links with nothing and has a null component; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, U64, Words, arrow_map, mix, n_parts, pieces, stage, text_bytes
from .graph import components

LEADERS = 6
GROUP = 48
BETA = 15  # per cent of a set that the prefixes hold beyond the least


def sets_of(column: pa.Array, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes, document by document, and offsets."""
    s, d, _ = Words(*text_bytes(column)).shingles(k)
    order = np.lexsort((s, d))
    s, d = s[order], d[order]
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != s[:-1]) | (d[1:] != d[:-1])
    s, d = s[keep], d[keep]
    return s, np.searchsorted(d, np.arange(len(column) + 1))


def signatures(s: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set, as two int64."""
    out = []
    for salt in (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25):
        run = np.concatenate([np.zeros(1, U64), np.cumsum(mix(s ^ U64(salt)), dtype=U64)])
        out.append(mix((run[first[1:]] - run[first[:-1]]) + np.diff(first).astype(U64)).view(np.int64))
    return out[0], out[1]


def ceil_part(n: np.ndarray, t: int) -> np.ndarray:
    return -(-n * t // 100)


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Concatenated ranges start:start+size."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


def pack(tokens: np.ndarray, bits: int) -> bytes:
    """Tokens (64 or their top 48 bits) as planes of 32 and 32 or 16 bits."""
    if bits == 64:
        return tokens.tobytes()
    return (tokens >> U64(16)).astype("<u4").tobytes() + (tokens & U64(0xFFFF)).astype("<u2").tobytes()


def unpack(blob: bytes, bits: int) -> np.ndarray:
    if bits == 64:
        return np.frombuffer(blob, U64)
    n = len(blob) // 6
    return (np.frombuffer(blob, "<u4", n).astype(U64) << U64(16)) | np.frombuffer(blob, "<u2", n, 4 * n)


#: About the bytes of a row of the batch table. An exchange has a row a batch and bucket: if batches are small, the rows' heads outgrow the tokens on a large input.
BATCH_TABLE_BYTES = 4 << 20
#: Bytes of a bucket of tokens, and the buckets a small input is dealt to for balance.
BUCKET_BYTES, LEAST_BUCKETS = 8 << 20, 1024

BATCH = "batch bigint, ids binary, nulls binary, sizes binary, sig_a binary, sig_b binary, sent binary, tokens binary"


def batch_table(docs: DataFrame, name: str, t: int, k: int, whole: bool) -> DataFrame:
    """A row a batch of documents: ids, set sizes and signatures, and of each set the tokens for the exchange (whole: all, else the prefix, 48 bits each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, seq = TaskContext.get().partitionId() << 32, 0
        held: list[list[bytes]] = []

        def row() -> pa.RecordBatch:
            *rest, tokens = [b"".join(x) for x in zip(*held)]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([base + seq], pa.int64()), *[pa.array([x], pa.binary()) for x in (*rest, pack(np.frombuffer(tokens, U64), 64 if whole else 48))]], [f.split()[0] for f in BATCH.split(", ")])

        for b in pieces(batches, "_text"):
            s, first = sets_of(b.column(1), k)
            n = np.diff(first)
            ids = b.column(0)
            a, c = signatures(s, first)
            sent = n if whole else np.minimum(n, np.where(n > 0, n - ceil_part(n, t) + 1 + n * BETA // 100, 0))
            tokens = s[ranges(first[:-1], sent)]
            held.append([np.asarray(ids.fill_null(0)).astype("<i8").tobytes(), np.asarray(ids.is_null()).astype(np.uint8).tobytes(), n.astype("<i4").tobytes(), a.tobytes(), c.tobytes(), sent.astype("<i4").tobytes(), (tokens if whole else tokens >> U64(16)).tobytes()])
            if sum(len(y) for x in held for y in x) >= BATCH_TABLE_BYTES:
                yield row()
                seq += 1
        if held:
            yield row()

    return stage(arrow_map(docs, run, BATCH), name)


def each_batch(batch: pa.RecordBatch) -> Iterator[dict]:
    for r in batch.to_pylist():
        for c, kind in (("ids", "<i8"), ("nulls", "u1"), ("sizes", "<i4"), ("sig_a", "<i8"), ("sig_b", "<i8"), ("sent", "<i4")):
            if c in r:
                r[c] = np.frombuffer(r[c], kind)
        yield r


def classes_of(table: DataFrame) -> DataFrame:
    """doc_id, n, sig_a, sig_b of every row (sig null where the set is empty or doc_id null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in each_batch(b):
                off = (r["nulls"] > 0) | (r["sizes"] == 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r["ids"], pa.int64(), mask=r["nulls"] > 0), pa.array(r["sizes"].astype(np.int64)), pa.array(r["sig_a"], pa.int64(), mask=off), pa.array(r["sig_b"], pa.int64(), mask=off)], ["doc_id", "n", "sig_a", "sig_b"]
                )

    return arrow_map(table.select("ids", "nulls", "sizes", "sig_a", "sig_b"), run, "doc_id bigint, n bigint, sig_a bigint, sig_b bigint")


def by_bucket(tokens: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct tokens ordered by bucket, their counts, the inverse, and each bucket's range."""
    u, inverse, c = np.unique(tokens, return_inverse=True, return_counts=True)
    tb = (mix(u) % U64(buckets)).astype(np.int64)
    order = np.argsort(tb, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return u[order], c[order], place[inverse], np.searchsorted(tb[order], np.arange(buckets + 1))


def counted(table: DataFrame, bits: int, name: str, apply: Callable, schema: str, columns: list[str]) -> DataFrame:
    """Counts each token's documents over the whole table and gives them back to the batches: apply(row, tokens, counts) -> RecordBatch; counts go up to 65535."""
    spark = table.sparkSession
    parts = n_parts(spark)
    total = table.agg(F.sum(F.length("tokens"))).first()[0] or 0
    buckets = int(max(min(3 * parts, LEAST_BUCKETS), total // BUCKET_BYTES + 1))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in each_batch(b):
                u, c, _, cut = by_bucket(unpack(r["tokens"], bits), buckets)
                c = np.minimum(c, 255).astype(np.uint8)
                full = np.flatnonzero(np.diff(cut))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(full, pa.int64()), pa.array([r["batch"]] * len(full), pa.int64()), pa.array([pack(u[cut[k] : cut[k + 1]], bits) for k in full], pa.binary()), pa.array([c[cut[k] : cut[k + 1]].tobytes() for k in full], pa.binary())], ["tb", "batch", "tokens", "n"]
                )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(held: list) -> pa.RecordBatch:
            toks = [unpack(x[2], bits) for x in held]
            u, inverse = np.unique(np.concatenate(toks), return_inverse=True)
            df = np.bincount(inverse, np.frombuffer(b"".join(x[3] for x in held), np.uint8), len(u))
            df = np.minimum(df, 65535).astype("<u2")[inverse]
            cut = np.cumsum([0, *map(len, toks)])
            return pa.RecordBatch.from_arrays([pa.array([x[1] for x in held], pa.int64()), pa.array([x[0] for x in held], pa.int64()), pa.array([df[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:])], pa.binary())], ["batch", "tb", "df"])

        held: list = []
        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(4))):
                if held and held[0][0] != row[0]:
                    yield done(held)
                    held = []
                held.append(row)
        if held:
            yield done(held)

    sent = arrow_map(table.select("batch", "tokens"), emit, "tb bigint, batch bigint, tokens binary, n binary")
    df = arrow_map(sent.repartition(parts, "tb").sortWithinPartitions("tb"), count, "batch bigint, tb bigint, df binary")
    df = df.groupBy(F.col("batch").alias("_b")).agg(F.array_sort(F.collect_list(F.struct("tb", "df"))).alias("_df"))
    joined = table.select(*columns).join(df, table["batch"] == df["_b"])

    def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in each_batch(b):
                tokens = unpack(r["tokens"], bits)
                _, _, inverse, _ = by_bucket(tokens, buckets)
                df = np.frombuffer(b"".join(x["df"] for x in r["_df"]), "<u2")
                yield apply(r, tokens, df[inverse])

    return stage(arrow_map(joined.drop("_b"), back, schema), name)


def link(a: np.ndarray, b: np.ndarray, t: int) -> bool:
    """Whether two sorted sets' Jaccard similarity is t per cent or more."""
    if 100 * min(len(a), len(b)) < t * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= t * (len(a) + len(b) - both)


# ------------------------------------------------------- the token-group matrix


class Group:
    """Documents of a group and the union of their tokens."""

    def __init__(self, rows: list[dict]):
        self.rows = rows
        self.sets = [np.frombuffer(r["tokens"], U64) for r in rows]
        self.union = np.unique(np.concatenate(self.sets))
        self.least = min(map(len, self.sets))

    def opens(self, q: np.ndarray, t: int) -> bool:
        """Whether the overlap with the union lets q link with any member."""
        need = max(len(q), self.least) * t
        at = np.minimum(np.searchsorted(self.union, q), len(self.union) - 1)
        return 100 * int((self.union[at] == q).sum()) >= need


def match_groups(a: list[dict], b: list[dict], t: int, sub: int = 16) -> list[tuple[int, int]]:
    """Links that unite the components (column comp) of a's and b's documents."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    groups = [Group(b[i : i + sub]) for i in range(0, len(b), sub)]
    for x in a:
        q = np.frombuffer(x["tokens"], U64)
        for g in groups:
            todo = [k for k, y in enumerate(g.rows) if find(y["comp"]) != find(x["comp"])]
            if todo and g.opens(q, t):
                for k in todo:
                    y = g.rows[k]
                    if find(y["comp"]) != find(x["comp"]) and link(q, g.sets[k], t):
                        out.append((x["doc_id"], y["doc_id"]))
                        parent[find(y["comp"])] = find(x["comp"])
    return out


EDGES = "a bigint, b bigint"


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([y for _, y in pairs], pa.int64())], ["a", "b"])


def by_cluster(rows: DataFrame, info: DataFrame, limit: int) -> DataFrame:
    """rows with their cluster's columns of info (cluster, size, ...). The few clusters of more than ``limit`` rows are broadcast, so their rows aren't dealt by cluster."""
    names = [*rows.columns, *(c for c in info.columns if c != "cluster")]
    info = info.withColumnRenamed("cluster", "_k")
    same = F.col("cluster") == F.col("_k")
    big = F.broadcast(info.where(F.col("size") > limit))
    hot = rows.join(big, same).select(names)
    cold = rows.join(big.select("_k"), same, "left_anti").join(info.where(F.col("size") <= limit), same).select(names)
    return hot.unionAll(cold)


def cluster_links(sets: DataFrame, t: int) -> DataFrame:
    """Links that make the components of the sets (doc_id, n, tokens, rare, centre)."""
    rare = sets.select("doc_id", F.explode("rare").alias("tok"))
    least = rare.groupBy("tok").agg(F.min("doc_id").alias("m"))
    ties = rare.join(least, "tok").where("doc_id <> m").select(F.col("doc_id").alias("a"), F.col("m").alias("b")).distinct()
    cluster = components(ties).select(F.col("v").alias("_v"), F.col("comp").alias("cluster"))
    rows = stage(sets.join(cluster, sets["doc_id"] == cluster["_v"]).drop("_v"), "clusters")
    discard(sets)

    clusters = rows

    # leaders: the most central documents, by several orders so that they differ
    orders = [F.struct((-F.col("centre")).alias("c"), F.col("doc_id").alias("d")), *[F.struct((-F.round("centre", 1)).alias("c"), F.xxhash64("doc_id", F.lit(i)).alias("h"), F.col("doc_id").alias("d")) for i in range(1, LEADERS)]]
    info = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"), *[F.min(o)["d"].alias(f"l{i}") for i, o in enumerate(orders)])
    info = stage(info.select("cluster", "size", F.array_distinct(F.array(*[f"l{i}" for i in range(LEADERS)])).alias("leaders")), "leaders")
    salt = lambda n: F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("size") / 64))
    chosen = info.select("cluster", "size", F.explode("leaders").alias("leader")).join(rows.select(F.col("doc_id").alias("leader"), F.col("tokens").alias("_t")), "leader")
    led = chosen.groupBy("cluster", "size").agg(F.collect_list(F.struct("leader", "_t")).alias("led"))  # LEADERS sets at most
    led = led.select(F.col("cluster").alias("_c"), "led", F.explode(F.sequence(F.lit(0).cast("bigint"), (F.ceil(F.col("size") / 64) - 1).cast("bigint"))).alias("_s"))
    limit = max(100, rows.count() // HOT_CLASSES)
    sized = by_cluster(rows, info.select("cluster", "size"), limit).withColumn("salt", salt(0))
    both = sized.join(led, (F.col("cluster") == F.col("_c")) & (F.col("salt") == F.col("_s"))).select("doc_id", "tokens", "led")

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaders, group = None, None
        for b in batches:
            out = []
            for r in b.to_pylist():
                if leaders != (own := [x["leader"] for x in r["led"]]):  # rows of a cluster mostly come together
                    leaders, group = own, Group([{"tokens": x["_t"]} for x in r["led"]])
                q = np.frombuffer(r["tokens"], U64)
                if group.opens(q, t):
                    out += [(r["doc_id"], x) for x, tokens in zip(leaders, group.sets) if x != r["doc_id"] and link(q, tokens, t)]
            yield _edges(out)

    found = stage(arrow_map(both, lead, EDGES), "led")

    # components so far; clusters of more than one go on
    comp = components(found).select(F.col("v").alias("_v"), F.col("comp").alias("_comp"))
    rows = rows.join(comp, rows["doc_id"] == comp["_v"], "left").withColumn("comp", F.coalesce("_comp", "doc_id")).drop("_v", "_comp")
    by_comp = rows.groupBy("cluster", "comp").agg(F.count(F.lit(1)).alias("n_comp"))
    open_ = by_comp.groupBy("cluster").agg(F.count(F.lit(1)).alias("n_comps"), F.max(F.struct("n_comp", "comp"))["comp"].alias("main"), F.max("n_comp").alias("n_main"), F.sum("n_comp").alias("size")).where("n_comps > 1")
    rest = stage(by_cluster(rows, open_.select("cluster", "main", "n_main", "size"), limit), "open")

    in_main = F.col("comp") == F.col("main")
    spread = F.xxhash64(F.substring("tokens", 1, 8), F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("size") / 64)))
    side = F.when(in_main, F.col("n_main")).otherwise(F.col("size") - F.col("n_main"))
    keyed = rest.withColumn("g", F.struct("cluster", in_main.alias("main"), F.pmod(spread, F.ceil(side / GROUP)).alias("n"))).withColumn("asks", ~in_main)
    pairs = stage(group_pairs(keyed.select("g", "comp", "rare", "size", "asks")), "group-pairs")
    cols = ["q", "t", "doc_id", "tokens", "comp"]
    query = keyed.where("asks").join(pairs, F.col("g") == F.col("q")).select(*cols, F.lit(0).alias("side"))
    target = keyed.join(pairs, F.col("g") == F.col("t")).select(*cols, F.lit(1).alias("side"))

    def cell(key, table):  # without hints: Spark infers the kind of function from them
        rows_ = table.to_pylist()
        a = [r for r in rows_ if r["side"] == 0]
        b = sorted((r for r in rows_ if r["side"] == 1), key=lambda r: (r["tokens"][:8], len(r["tokens"]), r["doc_id"]))  # similar ones together
        pairs_ = match_groups(a, b, t) if a and b else []
        return pa.Table.from_batches([_edges(pairs_)])

    met = query.unionAll(target).groupBy("q", "t").applyInArrow(cell, EDGES)
    out = found.unionAll(stage(met, "met"))
    discard(rest, clusters, pairs)
    return out


def group_pairs(rows: DataFrame) -> DataFrame:
    """q, t: groups of which q asks and that may hold a link between components, each two once; rows: g (a struct that begins with the cluster), comp, rare, size (the cluster's), asks."""
    limit = GROUP * GROUP
    groups = rows.groupBy("g").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("size").alias("size"), F.max("asks").alias("asks"))
    a = groups.where("asks").select(F.col("g").alias("q"), F.col("lo").alias("q_lo"), F.col("hi").alias("q_hi"), "size")
    b = groups.select(F.col("g").alias("t"), F.col("lo").alias("t_lo"), F.col("hi").alias("t_hi"), F.col("asks").alias("t_asks"))
    near = a.where(F.col("size") <= limit).join(b, F.col("q.cluster") == F.col("t.cluster"))
    matrix = rows.where(F.col("size") > limit).select("g", "asks", F.explode("rare").alias("tok")).distinct()
    met = matrix.where("asks").select("tok", F.col("g").alias("q")).join(matrix.select(F.col("tok").alias("_t"), F.col("g").alias("t")), F.col("tok") == F.col("_t")).select("q", F.col("t").alias("_g")).distinct()
    far = a.where(F.col("size") > limit).join(met, "q").join(b, F.col("_g") == F.col("t")).select(*near.columns)
    differ = (F.col("q_lo") != F.col("t_lo")) | (F.col("q_hi") != F.col("t_hi")) | (F.col("q_lo") != F.col("q_hi"))
    return near.unionAll(far).where(differ & (~F.col("t_asks") | (F.col("q") <= F.col("t")))).select("q", "t")


def jaccard_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 75, k: int = 5) -> DataFrame:
    """doc_id, n_shingles and component_id of each row of docs."""
    t = percent
    rows = docs.select(F.col(doc_id).cast("bigint").alias("_id"), F.col(text).alias("_text"))
    table = batch_table(rows, "prefixes", t, k, whole=False)
    classes = stage(classes_of(table), "sets")
    reps = classes.where("sig_a is not null").groupBy("sig_a", "sig_b").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("size"))

    def prefix(r: dict, tokens: np.ndarray, df: np.ndarray) -> pa.RecordBatch:
        run = np.concatenate([[0], np.cumsum(df >= 2)])
        end = np.cumsum(r["sent"])
        shared = run[end] - run[end - r["sent"]]
        n = r["sizes"].astype(np.int64)
        ok = (r["nulls"] == 0) & (n > 0) & (shared >= 1 + ceil_part(n, t) * BETA // 100)
        return pa.RecordBatch.from_arrays([pa.array(r["ids"][ok], pa.int64())], ["_d"])

    maybe_table = counted(table, 48, "maybe", prefix, "_d bigint", ["batch", "ids", "nulls", "sizes", "sent", "tokens"])
    maybe = maybe_table.distinct().join(reps.select(F.col("rep").alias("_d")), "_d", "left_semi")
    # merge: the ids grow with the documents, so the plan is that of a large input at any size
    discard(table)
    left = batch_table(rows.join(maybe.hint("merge"), rows["_id"] == maybe["_d"], "left_semi"), "wholes", t, k, whole=True)

    def whole(r: dict, tokens: np.ndarray, df: np.ndarray) -> pa.RecordBatch:
        ids, out = r["ids"], []
        end = np.cumsum(r["sent"])
        for d, j, n in zip(ids.tolist(), end.tolist(), r["sizes"].tolist()):
            own, c = tokens[j - n : j], df[j - n : j].astype(np.int64)
            if 100 * int((c >= 2).sum()) >= t * n:
                order = np.lexsort((own, c))[: n - int(ceil_part(np.int64(n), t)) + 1]
                rare = own[order][c[order] >= 2]
                out.append((d, n, own.tobytes(), rare.view(np.int64), float(np.log1p(c).mean())))
        c = list(zip(*out)) or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.binary()), pa.array(list(c[3]), pa.list_(pa.int64())), pa.array(c[4], pa.float64())], ["doc_id", "n", "tokens", "rare", "centre"])

    sets = counted(left, 64, "candidates", whole, "doc_id bigint, n bigint, tokens binary, rare array<bigint>, centre double", ["batch", "ids", "nulls", "sizes", "sent", "tokens"])
    discard(maybe_table, left)
    comp = components(cluster_links(sets, t)).select(F.col("v").alias("_v"), "comp")
    named = reps.join(comp, reps["rep"] == comp["_v"], "left").select(F.col("sig_a").alias("_a"), F.col("sig_b").alias("_b"), F.coalesce("comp", "rep").alias("_comp"), "size")
    return with_components(classes, stage(named, "named"))


#: A class of equal sets with more than one in so many rows is hot; there are at most so many of them.
HOT_CLASSES = 2000


def with_components(classes: DataFrame, named: DataFrame) -> DataFrame:
    """classes with the components of their signatures. The few hot classes are broadcast, so their rows aren't dealt by signature."""
    limit = max(100, classes.count() // HOT_CLASSES)
    hot = classes.join(F.broadcast(named.where(F.col("size") > limit).drop("size")), (classes["sig_a"] == F.col("_a")) & (classes["sig_b"] == F.col("_b")), "left").drop("_a", "_b")
    hot = hot.withColumnRenamed("_comp", "_hot")
    rest = named.where(F.col("size") <= limit).drop("size")
    cold = hot.where(F.col("_hot").isNull() & F.col("sig_a").isNotNull()).join(rest, (F.col("sig_a") == F.col("_a")) & (F.col("sig_b") == F.col("_b")), "left")
    done = hot.where(F.col("_hot").isNotNull() | F.col("sig_a").isNull())
    out = cold.select("doc_id", "n", F.coalesce("_comp", "doc_id").alias("c")).unionAll(done.select("doc_id", "n", F.coalesce("_hot", "doc_id").alias("c")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.col("c").alias("component_id"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 75) -> DataFrame:
    """docs with one row of each component, that of the smallest doc_id.

    Where rows share a doc_id, each different text is a document of its own, ordered by
    (doc_id, text), and of rows with equal doc_id and text one stays. All rows without a
    doc_id stay.
    """
    named = docs.where(docs[doc_id].isNotNull())
    again = named.groupBy(doc_id).agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
    node = doc_id
    if again:
        node = "_node"
        while node in docs.columns:
            node += "_"
        placed = named.dropDuplicates([doc_id, text]).repartitionByRange(doc_id, text).sortWithinPartitions(doc_id, text)
        named = stage(placed.withColumn(node, F.monotonically_increasing_id()), "nodes")
    found = jaccard_components(named, node, text, percent)
    keep = found.where("doc_id = component_id").select(F.col("doc_id").alias("_keep"))
    own = named.join(keep.distinct().hint("merge"), named[node] == F.col("_keep"), "left_semi")
    return own.select(*[F.col(f"`{c}`") for c in docs.columns]).unionAll(docs.where(docs[doc_id].isNull()))
