"""Quality rules (6): thresholds from mergeable quantile sketches per language and source.

The measures' distributions are sketched per (lang, source) as log-linear
histograms (HDR style: 32 sub-buckets an octave, relative error 1/32): a sketch is a set of (bucket, count)
rows, merging is adding counts, and a hot source is combined before it is shuffled. From a sketch follow the
lowest and highest tenth and the median; a group's are averaged with its language's, and those with the ones of all
documents, as if `PRIOR` documents of the wider group belonged to it. So every group of every size has thresholds of
its own, and small ones lean on the wider group. A threshold lies FENCE times as far beyond the outer tenth
as that lies beyond the median.

One symbol or one repeated line in a short text says nothing about its rate. So a rate beyond its threshold counts
only if its events are too many for chance: the sketch's share of documents without any event, and their mean size,
give the rate at which events come in the group (Poisson's: -ln(share) / size), and a document fails where as many
events as it has would come less often than once in exp(CHANCE), by Chernoff's bound. Events that come together, as the
words of a repeated sentence, count as one (`RATES`). Mean lengths of words vary more in short texts: their
distance grows as the root of the mean size over the text's. No allowance is the same for all groups.

Defined cases: null and empty texts have no words and fail the base rule; a null lang or source is a group of
its own; repeated rows count and are judged alike; an empty table gives no rows; every input column stays as
it is, even where its name equals one of ours (ours are then named with further underscores).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, small_batches, unused

MIN_WORDS = 50
#: Documents of the wider group that count in each group's quantiles.
PRIOR = 300
FENCE = 3
#: Highest bits of a value that its bucket keeps: 32 buckets to an octave.
BITS = 6
#: Rates: name -> (count, what it is counted in, how many come together as one event).
RATES = {"symbols": ("n_symbols", "n_words", 1), "dup_lines": ("n_dup_lines", "n_lines", 1), "repeats": ("n_repeat_words", "n_words", 12)}
#: A document fails by chance less often than once in exp(CHANCE): about a million.
CHANCE = 14
#: Rates are per UNIT, so that all values are whole numbers and sketches add up exactly.
UNIT = 10_000
#: Up to this many rows of thresholds are broadcast; beyond, the join is left to the planner.
BROADCAST_ROWS = 20_000


def _repeat_words(words: list) -> int:
    n = len(words)
    if n < 3:
        return 0
    seen: dict = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int64, count=n)
    _, pairs = np.unique(ids[:-1] * len(seen) + ids[1:], return_inverse=True)
    _, at, times = np.unique(pairs[:-1] * len(seen) + ids[2:], return_inverse=True, return_counts=True)
    hit = np.flatnonzero(times[at] > 1)
    marked = np.zeros(n, dtype=bool)
    for k in range(3):
        marked[hit + k] = True
    return int(marked.sum())


COUNTS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


@F.arrow_udf(T.StructType([T.StructField(c, T.LongType()) for c in COUNTS]))
def measure(texts: pa.Array) -> pa.Array:
    rows = []
    for text in texts:
        text = text.as_py() or ""
        words = text.encode("utf-8", "surrogatepass").split()  # bytes split at ASCII white space only
        lines = [x for x in text.split("\n") if x.strip(" \t\r\x0b\x0c")]
        rows.append((
            len(words), len(text) - sum(map(text.count, " \t\n\x0b\x0c\r")), sum(map(text.count, "#*$%&|<>")),
            len(lines), len(lines) - len(set(lines)), _repeat_words(words),
        ))
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [()] * len(COUNTS))], names=COUNTS)


measure = measure.asNondeterministic()  # so that no filter makes the planner run it a second time


def _values(m: str) -> dict[str, Column]:
    rate = lambda count, size: F.expr(f"({m}.{count} * {UNIT}) div greatest({m}.{size}, 1)")
    return {k: rate(count, size) for k, (count, size, _) in RATES.items()} | {"word_len": F.expr(f"({m}.word_chars * 100) div greatest({m}.n_words, 1)")}


def _size(k: str) -> str:
    return RATES[k][1] if k in RATES else "n_words"


def bucket(v: Column) -> Column:
    """Lower edge of the sketch's bucket of a whole number: its BITS highest bits."""
    shift = F.greatest(F.length(F.bin(v)) - BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", v, shift), shift)


def base_failed(m: str) -> Column:
    return F.expr(f"{m}.n_words < {MIN_WORDS} or 100 * {m}.n_repeat_words > 50 * {m}.n_words")


def sketch(measured: DataFrame, m: str) -> DataFrame:
    """(lang, source, measure, edge, n, size): the sketches of documents that pass the base rule; size adds up theirs."""
    pairs = F.array(*[F.struct(F.lit(k).alias("measure"), bucket(v).alias("edge"), F.col(f"{m}.{_size(k)}").alias("size")) for k, v in _values(m).items()])
    return (
        measured.where(~base_failed(m)).select("lang", "source", F.explode(pairs).alias("s"))
        .groupBy("lang", "source", "s.measure", "s.edge").agg(F.count("*").alias("n"), F.sum("s.size").alias("size"))
    )


def quantiles(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Per group and measure the number of documents, how many of them have the value 0, their size, and the edges at one,
    five and nine tenths of them."""
    merged = sketches.groupBy(*keys, "measure", "edge").agg(F.sum("n").alias("n"), F.sum("size").alias("size"))
    group = Window.partitionBy(*keys, "measure")  # one row for each bucket of the sketch
    ranked = merged.withColumn("upto", F.sum("n").over(group.orderBy("edge"))).withColumn("docs", F.sum("n").over(group))
    at = lambda tenths: F.min(F.when(F.col("upto") * 10 >= F.col("docs") * tenths, F.col("edge")))
    return ranked.groupBy(*keys, "measure").agg(
        F.max("docs").alias("docs"), F.coalesce(F.sum(F.when(F.col("edge") == 0, F.col("n"))), F.lit(0)).alias("none"), F.sum("size").alias("size"), *[at(t).alias(f"q{t}") for t in (1, 5, 9)])


def thresholds(sketches: DataFrame) -> DataFrame:
    """(lang, source, high_<measure>, rate_<measure>, size_<measure> ...) of each group. No distance between tenths counts as
    smaller than the sketch tells values apart."""
    wider = quantiles(sketches, []).selectExpr("measure", "q1", "q5", "q9", "none / (docs + 1) as none", "size / docs as size")
    for keys in (["lang"], ["lang", "source"]):
        own, known = quantiles(sketches, keys).alias("o"), wider.alias("w")
        same = F.expr(" and ".join(["o.measure = w.measure", *(f"o.{k} <=> w.{k}" for k in keys[:-1])]))
        leaning = [F.expr(f"(o.docs * o.q{t} + {PRIOR} * w.q{t}) div (o.docs + {PRIOR})").alias(f"q{t}") for t in (1, 5, 9)]
        leaning += [F.expr(f"(o.{c} + {PRIOR} * w.{c}) / (o.docs + {PRIOR})").alias(c) for c in ("none", "size")]
        wider = own.join(known, same).select(*[f"o.{k}" for k in keys], "o.measure", *leaning)
    above, below = (F.expr(f"greatest({x}, q5 div {1 << BITS - 1})") for x in ("q9 - q5", "q5 - q1"))
    edges = {"above": above, "below": below, "high": F.col("q9") + FENCE * above, "rate": -F.ln(F.greatest("none", F.lit(1e-9))) / F.col("size"), "size": F.col("size")}
    return wider.groupBy("lang", "source").agg(*[F.max(F.when(F.col("measure") == k, v)).alias(f"{name}_{k}") for k in [*RATES, "word_len"] for name, v in edges.items()],
                                               *[F.max(F.when(F.col("measure") == "word_len", F.col(q))).alias(f"{q}_word_len") for q in ("q1", "q9")])


def judged(measured: DataFrame, m: str, edges: DataFrame) -> tuple[DataFrame, Column, Column]:
    """measured with the verdicts beside it: the frame and its columns base_failed and kept. No text is shuffled."""
    side = edges.select(F.col("lang").alias("__lang"), F.col("source").alias("__source"), F.struct(*[c for c in edges.columns if c not in ("lang", "source")]).alias("__edges"))
    if edges.count() <= BROADCAST_ROWS:
        side = F.broadcast(side)
    joined = measured.join(side, measured["lang"].eqNullSafe(side["__lang"]) & measured["source"].eqNullSafe(side["__source"]), "left")
    e = side["__edges"]
    value, wide = _values(m)["word_len"], FENCE * F.greatest(F.lit(1.0), F.sqrt(e["size_word_len"] / F.greatest(F.col(f"{m}.n_words"), F.lit(1))))
    inside = (value <= e["q9_word_len"] + e["above_word_len"] * wide) & (value >= e["q1_word_len"] - e["below_word_len"] * wide)
    for k, (count, size, together) in RATES.items():
        events, expected = F.col(f"{m}.{count}") / F.lit(float(together)), e[f"rate_{k}"] * F.col(f"{m}.{size}")
        exponent = events * (F.ln(F.greatest(events, F.lit(1e-9)) / expected) - 1) + expected
        beyond = F.col(f"{m}.{count}") * UNIT > e[f"high_{k}"] * F.col(f"{m}.{size}")
        inside &= ~(beyond & (events > expected) & F.coalesce(exponent > CHANCE, F.lit(True)))
    return joined, base_failed(m), ~base_failed(m) & F.coalesce(inside, F.lit(True))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, the measures, base_failed and kept of every document."""
    small_batches(docs.sparkSession)
    measured = materialize(docs.select("doc_id", "lang", "source", measure("text").alias("m")), "measured")
    frame, failed, kept = judged(measured, "m", materialize(thresholds(sketch(measured, "m")), "thresholds"))
    return frame.select("doc_id", *[f"m.{c}" for c in COUNTS if c != "n_lines"], failed.alias("base_failed"), kept.alias("kept"))


def filter_quality(docs: DataFrame) -> DataFrame:
    """The documents that are kept, with the columns of docs.

    Texts are measured twice, for the thresholds and for the verdicts: that costs less disk than to write them again.
    """
    small_batches(docs.sparkSession)
    m, = unused(docs, "m_")
    counted = docs.select("lang", "source", measure("text").alias(m))
    edges = materialize(thresholds(sketch(counted, m)), "thresholds")
    measured = docs.withColumn(m, measure("text"))
    frame, _, kept = judged(measured, m, edges)
    return frame.where(kept).select(*[measured[c] for c in docs.columns])


#: The measures and thresholds in DuckDB's SQL; exact, since sketches of whole numbers add up exactly.
ORACLE = r"""
with d as (select row_number() over () as rid, doc_id, lang, source, coalesce(text, '') as text from documents),
w as (select rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as ws, string_split(text, chr(10)) as ls from d),
tri as (select rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] as g
        from (select rid, ws, unnest(range(1, len(ws) - 1)) as i from w where len(ws) >= 3)),
rep as (select rid, count(distinct p) as n from
         (select rid, unnest([i, i + 1, i + 2]) as p from
           (select rid, i, count(*) over (partition by rid, g) as c from tri) where c > 1) group by rid),
lines as (select rid, count(*) as n_lines, count(*) - count(distinct l) as n_dup_lines from
           (select rid, unnest(ls) as l from w) where regexp_matches(l, '[^\x20\x09-\x0D]') group by rid),
m as (select d.rid, d.doc_id, d.lang, d.source, len(ws)::bigint as n_words,
        length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
        coalesce(n_lines, 0)::bigint as n_lines, coalesce(n_dup_lines, 0)::bigint as n_dup_lines,
        coalesce(rep.n, 0)::bigint as n_repeat_words
      from d join w using (rid) left join lines using (rid) left join rep using (rid)),
b as (select *, (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed from m),
-- one row a measure: its value, the events and the size that rates are judged by, and how many events come together
v as (select rid, lang, source, 's' as measure, n_symbols * 10000 // n_words as v, n_symbols as k, n_words as n, 1 as together from b where not base_failed
  union all select rid, lang, source, 'd', n_dup_lines * 10000 // n_lines, n_dup_lines, n_lines, 1 from b where not base_failed
  union all select rid, lang, source, 'r', n_repeat_words * 10000 // n_words, n_repeat_words, n_words, 12 from b where not base_failed
  union all select rid, lang, source, 'w', word_chars * 100 // n_words, 0, n_words, 1 from b where not base_failed),
-- buckets of the sketch: 32 to an octave from 64 on
e as (select *, case when v < 64 then v else v // (1 << (floor(log2(v))::int - 5)) * (1 << (floor(log2(v))::int - 5)) end as edge from v),
p0 as (select measure, count(*) as docs, count(*) filter (edge = 0) as none, sum(n)::bigint as size, quantile_disc(edge, 0.1) as q1, quantile_disc(edge, 0.5) as q5, quantile_disc(edge, 0.9) as q9 from e group by all),
q0 as (select measure, q1, q5, q9, none::double / (docs + 1) as none, size::double / docs as size from p0),
p1 as (select lang, measure, count(*) as docs, count(*) filter (edge = 0) as none, sum(n)::bigint as size, quantile_disc(edge, 0.1) as q1, quantile_disc(edge, 0.5) as q5, quantile_disc(edge, 0.9) as q9 from e group by all),
q1 as (select lang, measure, (docs * p1.q1 + 300 * q0.q1) // (docs + 300) as q1, (docs * p1.q5 + 300 * q0.q5) // (docs + 300) as q5, (docs * p1.q9 + 300 * q0.q9) // (docs + 300) as q9,
         (p1.none + 300 * q0.none) / (docs + 300) as none, (p1.size + 300 * q0.size) / (docs + 300) as size from p1 join q0 using (measure)),
p2 as (select lang, source, measure, count(*) as docs, count(*) filter (edge = 0) as none, sum(n)::bigint as size, quantile_disc(edge, 0.1) as q1, quantile_disc(edge, 0.5) as q5, quantile_disc(edge, 0.9) as q9 from e group by all),
q2 as (select p2.lang, p2.source, p2.measure, (docs * p2.q1 + 300 * q1.q1) // (docs + 300) as q1, (docs * p2.q5 + 300 * q1.q5) // (docs + 300) as q5, (docs * p2.q9 + 300 * q1.q9) // (docs + 300) as q9,
         (p2.none + 300 * q1.none) / (docs + 300) as none, (p2.size + 300 * q1.size) / (docs + 300) as size from p2 join q1 on p2.measure = q1.measure and p2.lang is not distinct from q1.lang),
x as (select rid, v.measure, v, k, n, q1, q9, greatest(q9 - q5, q5 // 32) as above, greatest(q5 - q1, q5 // 32) as below, k / together::double as events, (-ln(greatest(none, 1e-9)) / size) * n as expected, greatest(1.0::double, sqrt(size / n)) as wide
  from v join q2 on v.measure = q2.measure and v.lang is not distinct from q2.lang and v.source is not distinct from q2.source),
bad as (select rid from x where case when measure = 'w' then v > q9 + above * (3 * wide) or v < q1 - below * (3 * wide)
          else k * 10000 > (q9 + 3 * above) * n and events > expected and events * (ln(greatest(events, 1e-9) / expected) - 1) + expected > 14 end)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (not base_failed and rid not in (select rid from bad)) as kept from b"""
