"""Source divergence audit over a three-dimensional cube (operator 12).

How far do the sources of a language differ in their words? Every (lang,
source) group gives each term a probability p in exact integers; a pair of
groups diverges by the sum of ``floor((p - q)^2 / (p + q))`` over all terms.

* Counting: tasks count the terms of a slice of documents at once; the partial
  aggregate of the same task adds up its slices before one shuffle by (lang,
  source, term). Terms of ``AT_LEAST`` documents of their language stay.
* Cube: groups of a language are cut into blocks of ``GROUPS``, its terms into
  blocks of about ``TERMS`` by hash. A task owns the cells (group block, group
  block, term block): a slice (group block, term block) is sent to each cell
  that needs it, the cell forms dense integer matrices of the terms that occur
  in it and adds up partial divergences of its pairs. The sums are reduced
  along the term axis.
* Terms that occur in neither block of a cell are not sent at all: they all add
  the same integer (both groups have count 0), and the reduction knows how many
  of the language's terms no cell of the pair has seen.

A cell holds at most 2 x GROUPS x (terms of its block) counts however large a
group is, so a source or language with a third of all rows is spread over its
term blocks. Integers: quotients are formed in decimals of 38 digits, all else
fits 64 bits (p is at most 10^9 + 1).

Defined results: null text, lang or source counts as ''; every row is a
document, repeated ids too; a group without terms takes part in its pairs, a
language with one group has none; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import Scratch
from . import textarr as ta

AT_LEAST, TOP = 10, 10
GROUPS, TERMS = 64, 2048
UNIT = 1_000_000_000

SEPARATOR = np.zeros(256, bool)
SEPARATOR[:0x80] = True
SEPARATOR[0x41:0x5B] = SEPARATOR[0x61:0x7B] = False
UPPER = (np.arange(256) >= 0x41) & (np.arange(256) <= 0x5A)

COUNTS = "lang string, source string, term string, n long, docs long"


def gathered(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The spans of ``buf`` as an Arrow string array."""
    size = end - start
    off = np.zeros(len(start) + 1, np.int64)
    np.cumsum(size, out=off[1:])
    at = np.arange(int(off[-1])) + np.repeat(start - off[:-1], size)
    return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(buf[at])))


def _slice_counts(buf, off, group) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(term, group, occurrences, documents) of one slice."""
    low = buf + (UPPER[buf] * np.uint8(32)).astype(np.uint8)
    w = ta.words(low, off, SEPARATOR)
    enc = gathered(low, w.start, w.end).dictionary_encode()
    terms, code = enc.dictionary, enc.indices.to_numpy().astype(np.int64)
    n = max(1, len(terms))
    doc = np.searchsorted(w.first, np.arange(len(code)), side="right") - 1
    pair, times = np.unique(doc * n + code, return_counts=True)
    key, back = np.unique(group[pair // n] * n + pair % n, return_inverse=True)
    return terms.take(pa.array(key % n)), key // n, np.bincount(back, times, len(key)).astype(np.int64), np.bincount(back, minlength=len(key))


def _count(batches):
    for batch in batches:
        lang, source = (batch.column(i).cast(pa.large_string()).fill_null("").dictionary_encode() for i in (1, 2))
        wide = max(1, len(source.dictionary))
        group = lang.indices.to_numpy().astype(np.int64) * wide + source.indices.to_numpy()
        langs, sources = lang.dictionary.cast(pa.string()), source.dictionary.cast(pa.string())
        buf_all, off_all = ta.utf8(batch.column(0))
        for p, q in ta.slices(off_all):
            term, g, n, docs = _slice_counts(buf_all[off_all[p]:off_all[q]], off_all[p:q + 1] - off_all[p], group[p:q])
            yield pa.RecordBatch.from_arrays([langs.take(pa.array(g // wide)), sources.take(pa.array(g % wide)), term.cast(pa.string()), pa.array(n), pa.array(docs)],
                                             names=["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents that hold it)."""
    return (docs.select("text", "lang", "source").mapInArrow(_count, COUNTS)
            .groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))


def probability(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (count + 2) / (total + 2 terms)), exact."""
    wide = "decimal(38,0)"
    part = F.call_function("div", F.lit(UNIT).cast("decimal(10,0)") * (count + 2).cast("decimal(20,0)"), (total + 2 * terms).cast(wide))
    return F.when(total + 2 * terms > 0, part + 1).otherwise(1).cast("long")


CELLS = "lang string, source string, other string, part long, seen long, rest long, terms long"


def _cell(table: pa.Table, block_size: int) -> pa.Table:
    """Partial divergences of one cell's pairs: over the terms seen in it
    (part, seen) and of one term that neither group has (rest)."""
    col = {c: table.column(c) for c in table.column_names}
    a, b, lang = col["a"][0].as_py(), col["b"][0].as_py(), col["lang"][0].as_py()
    head = col["term"].is_null().to_numpy()
    g, p = col["g"].to_numpy(), col["p"].to_numpy()
    enc = col["term"].combine_chunks().dictionary_encode()
    enc = enc.combine_chunks() if isinstance(enc, pa.ChunkedArray) else enc
    code = enc.indices.fill_null(0).to_numpy()
    n_terms = len(enc.dictionary)
    names, terms = col["source"].to_pylist(), col["terms"][0].as_py()
    matrix, none, label = {}, {}, {}
    for block in {a, b}:
        mine = np.flatnonzero(head & (g // block_size == block))
        mine = mine[np.argsort(g[mine])]
        first = int(g[mine[0]])
        none[block], label[block] = p[mine], [names[i] for i in mine]
        m = np.repeat(p[mine][:, None], n_terms, axis=1)
        body = np.flatnonzero(~head & (g // block_size == block))
        m[g[body] - first, code[body]] = p[body]
        matrix[block] = m
    out = [[] for _ in range(4)]
    for i, row in enumerate(matrix[a]):
        others = slice(i + 1, None) if a == b else slice(None)
        q, q0 = matrix[b][others], none[b][others]
        if len(q0):
            out[0] += [label[a][i]] * len(q0)
            out[1] += label[b][others]
            out[2].append(((row - q) ** 2 // (row + q)).sum(axis=1))
            out[3].append((none[a][i] - q0) ** 2 // (none[a][i] + q0))
    n = len(out[0])
    part, rest = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in out[2:])
    return pa.table({"lang": pa.array([lang] * n, pa.string()), "source": pa.array(out[0], pa.string()), "other": pa.array(out[1], pa.string()),
                     "part": part, "seen": np.full(n, n_terms, np.int64), "rest": rest, "terms": np.full(n, terms, np.int64)})


def cells(rows: DataFrame, groups: DataFrame, block_size: int, term_block: int) -> DataFrame:
    """Rows (lang, source, g, term, p) and groups (with p of count 0) at every
    cell that needs them. Cells are (lang, a <= b, t)."""
    n_blocks = F.ceil(F.col("groups") / block_size).cast("long")
    n_parts = F.greatest(F.lit(1), F.ceil(F.col("terms") / term_block)).cast("long")
    body = rows.select("lang", "source", "g", "term", "p", "groups", "terms", F.pmod(F.xxhash64("term"), n_parts).alias("t"))
    head = groups.select("lang", "source", "g", F.lit(None).cast("string").alias("term"), F.col("p0").alias("p"), "groups", "terms",
                         F.explode(F.sequence(F.lit(0).cast("long"), n_parts - 1)).alias("t"))
    mine = F.floor(F.col("g") / block_size)
    return (body.union(head).withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), n_blocks - 1)))
            .select("lang", "source", "g", "term", "p", "terms", "t", F.least(mine, "o").alias("a"), F.greatest(mine, "o").alias("b")))


def source_divergence(docs: DataFrame, at_least: int = AT_LEAST, top: int = TOP, block_size: int = GROUPS,
                      term_block: int = TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: for every group its divergence
    from each other source of the language (part ``pair``, all ranks), and the
    ``top`` terms it uses more than its language does (part ``term``). Runs
    jobs when called and keeps one table in the scratch folder."""
    s = Scratch(docs.sparkSession)
    counts = s.keep(term_counts(docs), "terms")
    kept = s.keep(counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all"))
                  .where(F.col("docs") >= at_least).select("lang", "term", "all"), "kept")
    rows = s.keep(counts.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "all"), "rows")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("all").alias("lang_total"))
    totals = rows.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    blank = F.lit("")
    seen = docs.select(F.coalesce("lang", blank).alias("lang"), F.coalesce("source", blank).alias("source")).distinct()
    size = seen.groupBy("lang").agg(F.count(F.lit(1)).alias("groups"))
    zero = F.lit(0).cast("long")
    groups = (seen.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").join(size, "lang")
              .select("lang", "source", "groups", F.coalesce("total", zero).alias("total"), F.coalesce("terms", zero).alias("terms"),
                      F.coalesce("lang_total", zero).alias("lang_total"))
              # one row per source: a window over a language's list of sources
              .withColumn("g", (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("long"))
              .withColumn("p0", probability(zero, F.col("total"), F.col("terms"))))
    groups = s.keep(groups, "groups")
    rated = s.keep(rows.join(groups, ["lang", "source"]).select(
        "lang", "source", "g", "groups", "terms", "term", probability(F.col("n"), F.col("total"), F.col("terms")).alias("p"),
        probability(F.col("all"), F.col("lang_total"), F.col("terms")).alias("q")), "rated")
    s.drop(counts, kept, rows)

    partial = cells(rated, groups, block_size, term_block).groupBy("lang", "a", "b", "t").applyInArrow(lambda t: _cell(t, block_size), CELLS)
    pairs = partial.groupBy("lang", "source", "other").agg(
        (F.sum("part") + (F.max("terms") - F.sum("seen")) * F.max("rest")).alias("value"))
    pairs = pairs.select("lang", F.explode(F.array(F.struct("source", F.col("other").alias("item")),
                                                   F.struct(F.col("other").alias("source"), F.col("source").alias("item")))).alias("x"), "value")
    pairs = pairs.select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")
    d, both = F.col("p") - F.col("q"), F.col("p") + F.col("q")
    terms = rated.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.call_function("div", d * d, both).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    # the rank's limit is applied inside the tasks before rows meet (WindowGroupLimit)
    best = terms.withColumn("rank", rank).where(F.col("rank") <= top)
    return pairs.withColumn("rank", rank).union(best)


def oracle() -> str:
    """The same rows in DuckDB, every pair over every kept term."""
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    p = f"1 + ({UNIT}::hugeint * ({{}} + 2)) // ({{}} + 2 * v)"
    return f"""
with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
        regexp_extract_all({low}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as w from documents),
o as (select r, lang, source, unnest(w) as term from d),
k as (select lang, term, count(*) as total from o group by 1, 2 having count(distinct r) >= {AT_LEAST}),
l as (select lang, count(*) as v, sum(total) as nl from k group by 1),
c as (select lang, source, term, count(*) as n from o join k using (lang, term) group by 1, 2, 3),
g as (select distinct lang, source from d),
gn as (select g.lang, g.source, coalesce(sum(n), 0)::hugeint as ng from g left join c using (lang, source) group by 1, 2),
m as (select gn.lang, gn.source, k.term, coalesce(n, 0) as n, {p.format('coalesce(n, 0)', 'ng')} as p, {p.format('total', 'nl')} as q
      from gn join l using (lang) join k using (lang) left join c using (lang, source, term)),
f as (select x.lang, x.source, y.source as item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) as value
      from m x join m y on x.lang = y.lang and x.term = y.term and x.source <> y.source group by 1, 2, 3),
a as (select x.lang, x.source, 'pair' as part, y.source as item, cast(coalesce(value, 0) as bigint) as value
      from g x join g y on x.lang = y.lang and x.source <> y.source
      left join f on f.lang = x.lang and f.source = x.source and f.item = y.source
      union all
      select lang, source, 'term', term, cast((p - q) * (p - q) // (p + q) as bigint) from m where n > 0 and p > q)
select lang, source, part, item, value, cast(rank as integer) as rank from (
  select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from a)
where part = 'pair' or rank <= {TOP}"""
