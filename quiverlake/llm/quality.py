"""Quality rules with host-level verdicts, DataFrame functions only.

Each document gets rule measures (lengths, symbols, repeated lines, repeated
3-word windows). Failures of the soft rules are summed by host (one row a host
after partial aggregation, so a hot host costs nothing), the rates are shrunk
towards a beta prior fitted by moments over all hosts, and the hosts' verdicts
join back to the documents.

Verdict of a document: rejected if it fails a base rule, if it fails a soft rule
grossly, or if it fails a soft rule and its host's shrunk failure rate for that
rule is over ``host_limit``. A document that fails no rule is kept whatever its
host.

Defined cases: a null or empty text has no words, so fails ``n_words < 50``; a
null host is a host of its own; a very long text is measured whole, in arrays of its
words and windows (some 60 bytes a word); repeated rows count each; rows with equal
keys are rows of their own; an empty table gives an empty result; extra columns are
ignored (``keep_documents`` passes them through, whatever their names).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, stage

#: The symbols of the contract.
SYMBOLS = "#*$%&|<>"

#: Soft rules: name -> (mild failure, gross failure), over the measures.
SOFT_RULES = {
    "symbols": ("10 * n_symbols > n_words", "2 * n_symbols > n_words"),
    "dup_lines": ("10 * n_dup_lines > 3 * n_lines", "4 * n_dup_lines > 3 * n_lines"),
    "word_length": ("word_chars < 3 * n_words or word_chars > 12 * n_words", "word_chars < 2 * n_words or word_chars > 25 * n_words"),
}


def let(value: Column, body) -> Column:
    """body(value) with value computed once (a lambda variable)."""
    return F.transform(F.array(value), body)[0]


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (long)."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(F.translate(t, SPACES, " " * len(SPACES)), " "), lambda w: w != "")
    # only Java's split of a one-character pattern is fast
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)

    def repeated(w: Column) -> Column:
        # windows as (hash, place), sorted: equal windows are neighbours
        n = F.size(w)
        grams = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        paired = lambda g: F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        hit = lambda s: F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]))
        places = lambda s: F.array_sort(F.transform(hit(s), lambda x: x["i"]))
        covered = lambda p: F.aggregate(
            p, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), lambda a, x: F.struct((a["n"] + F.least(F.lit(3), x - a["last"])).alias("n"), x.alias("last")), lambda a: a["n"].cast("bigint")
        )
        # most documents repeat nothing: a hash set tells, without sorting
        body = let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0).cast("bigint")).otherwise(let(F.array_sort(paired(g)), lambda s: let(places(s), covered))))
        return F.when(n >= 3, body).otherwise(F.lit(0).cast("bigint"))

    both = let(words, lambda w: F.struct(F.size(w).cast("bigint").alias("n_words"), repeated(w).alias("n_repeat_words")))
    dup = let(lines, lambda x: F.struct(F.size(x).cast("bigint").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines")))
    return docs.select(
        "*",
        both.alias("_w"),
        dup.alias("_l"),
        F.length(F.translate(t, SPACES, "")).cast("bigint").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
    )


MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def host_rates(measured: DataFrame, host: str, max_strength: float = 100.0) -> DataFrame:
    """host, n_host_docs and, for each soft rule, the failure rate shrunk by an empirical beta prior.

    The prior's mean m and variance v are the document-weighted moments of the
    hosts' rates; its strength m(1-m)/v - 1 is held in [1, max_strength].
    """
    by_host = measured.groupBy(host).agg(F.count(F.lit(1)).alias("n_host_docs"), *[F.sum(F.when(F.expr(mild), 1).otherwise(0)).alias(f"f_{k}") for k, (mild, _) in SOFT_RULES.items()])
    prior = by_host.agg(
        *[(F.sum(f"f_{k}") / F.sum("n_host_docs")).alias(f"m_{k}") for k in SOFT_RULES],
        *[(F.sum(F.col(f"f_{k}") * F.col(f"f_{k}") / F.col("n_host_docs")) / F.sum("n_host_docs")).alias(f"q_{k}") for k in SOFT_RULES],
    )
    out = by_host.crossJoin(F.broadcast(prior))  # prior: one row
    for k in SOFT_RULES:
        m, v = F.col(f"m_{k}"), F.col(f"q_{k}") - F.col(f"m_{k}") * F.col(f"m_{k}")
        raw = F.when(v > 1e-12, m * (1 - m) / v - 1).otherwise(F.lit(max_strength))
        strength = F.greatest(F.lit(1.0), F.least(F.lit(max_strength), raw))
        out = out.withColumn(f"rate_{k}", (F.col(f"f_{k}") + m * strength) / (F.col("n_host_docs") + strength))
    return out.select(host, "n_host_docs", *[f"rate_{k}" for k in SOFT_RULES])


MAX_BROADCAST_HOSTS = 500_000


def with_rates(rows: DataFrame, measured: DataFrame, host: str) -> DataFrame:
    """rows with their hosts' rates. Hosts up to MAX_BROADCAST_HOSTS (some 20 MB) are broadcast; more are joined by shuffle, where adaptive execution splits a hot host."""
    rates = stage(host_rates(measured, host), "hosts").select(F.col(host).alias("_h"), *[f"rate_{k}" for k in SOFT_RULES])
    if rates.count() <= MAX_BROADCAST_HOSTS:
        rates = F.broadcast(rates)
    return rows.join(rates, rows[host].eqNullSafe(rates["_h"]), "left")


def verdict(host_limit: float) -> tuple[Column, Column, Column]:
    """base_failed, host_rejected, and whether the document is rejected."""
    base = F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")
    gross, by_host = F.lit(False), F.lit(False)
    for k, (mild, much) in SOFT_RULES.items():
        gross = gross | F.expr(much)
        by_host = by_host | (F.expr(mild) & (F.col(f"rate_{k}") > host_limit))
    return base, by_host, base | gross | by_host


def quality_rules(docs: DataFrame, host: str = "source", text: str = "text", keys: tuple[str, ...] = ("doc_id",), host_limit: float = 0.3) -> DataFrame:
    """keys, the measures, base_failed, host_rejected and kept for each row of docs."""
    took = measures(docs.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col(host).alias("_host"), F.col(text).alias("_text")), "_text")
    flat = took.select(*[f"_k{i}" for i in range(len(keys))], "_host", *[F.col(f"{'_w.' if k in ('n_words', 'n_repeat_words') else '_l.' if k in ('n_lines', 'n_dup_lines') else ''}{k}").alias(k) for k in MEASURES])
    flat = stage(flat, "quality")  # a few numbers a row; else texts are read and measured for the hosts and again for the join
    joined = with_rates(flat, flat, "_host")
    base, by_host, rejected = verdict(host_limit)
    return joined.select(
        *[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)],
        *MEASURES,
        base.alias("base_failed"),
        by_host.alias("host_rejected"),
        (~rejected).alias("kept"),
    )


def keep_documents(docs: DataFrame, host: str = "source", text: str = "text", host_limit: float = 0.3) -> DataFrame:
    """The rows of docs that the rules keep, with docs' columns; texts are measured once and nothing is joined by a key of theirs."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_d"))
    took = measures(rows.select("_d", F.col(f"_d.{host}").alias("_host"), F.col(f"_d.{text}").alias("_text")), "_text")
    flat = stage(took.select("_d", "_host", *[F.col(f"{'_w.' if k in ('n_words', 'n_repeat_words') else '_l.' if k in ('n_lines', 'n_dup_lines') else ''}{k}").alias(k) for k in MEASURES]), "quality", "zstd")
    return with_rates(flat, flat.drop("_d"), "_host").where(~verdict(host_limit)[2]).select("_d.*")


def oracle(table: str = "documents", columns: str = "") -> str:
    """The same in DuckDB SQL; columns: what to return, by default the query's."""
    ws = r"[\x20\x09-\x0D]+"
    rules = lambda i: [(k, v[i]) for k, v in SOFT_RULES.items()]
    mild = ", ".join(f"sum(case when {e} then 1 else 0 end) as f_{k}" for k, e in rules(0))
    prior = ", ".join(f"sum(f_{k}) / sum(n_host_docs) as m_{k}, sum(f_{k} * f_{k} / n_host_docs) / sum(n_host_docs) as q_{k}" for k in SOFT_RULES)
    power = ", ".join(f"greatest(1.0, least(100.0, case when q_{k} - m_{k} * m_{k} > 1e-12 then m_{k} * (1 - m_{k}) / (q_{k} - m_{k} * m_{k}) - 1 else 100.0 end)) as s_{k}, m_{k}" for k in SOFT_RULES)
    rate = ", ".join(f"(f_{k} + m_{k} * s_{k}) / (n_host_docs + s_{k}) as rate_{k}" for k in SOFT_RULES)
    host = " or ".join(f"(({e}) and rate_{k} > 0.3)" for k, e in rules(0))
    gross = " or ".join(f"({e})" for _, e in rules(1))
    columns = columns or "doc_id, " + ", ".join(MEASURES) + ", base_failed, host_rejected, not (base_failed or host_rejected or gross) as kept"
    return rf"""
with d as (select row_number() over () as _row, *, coalesce(text, '') as _t from {table}),
s as (select *, list_filter(string_split_regex(_t, '{ws}'), lambda w: w <> '') as w,
        list_filter(string_split(_t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from d),
g as (select _row, unnest(list_transform(range(1, len(w) - 1), lambda i: struct_pack(i := i, g := w[i:i+2])), recursive := true) from s where len(w) >= 3),
c as (select _row, i, count(*) over (partition by _row, g) as n from g),
r as (select _row, count(distinct p) as n_repeat_words from (select _row, unnest([i, i + 1, i + 2]) as p from c where n > 1) group by 1),
m as (select s.* exclude (w, l), len(w)::bigint as n_words, length(regexp_replace(_t, '{ws}', '', 'g'))::bigint as word_chars,
        (length(_t) - length(regexp_replace(_t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols, len(l)::bigint as n_lines,
        (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words
      from s left join r using (_row)),
h as (select source as _h, count(*)::double as n_host_docs, {mild} from m group by 1),
p as (select {prior} from h),
q as (select {power} from p),
v as (select _h, {rate} from h, q),
j as (select m.*, (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed, ({host}) as host_rejected, ({gross}) as gross
      from m join v on m.source is not distinct from v._h)
select {columns} from j"""
