"""Filter interaction audit: what each quality filter removes in every order in which the filters can be applied.

n filters span a lattice of subsets. An edge (filters applied already, next filter) has the same numbers in every order
that passes through it, so documents are counted on the n * 2^(n-1) edges (80 for five filters), and the n * n! steps of
all orders (600) are read off them as paths.

Documents are first added up by what they fail, so that an edge is fed by at most 2^n kinds of documents for each part
and pair of marks, whatever the number of documents.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilframe.llm.common import UPPER

BLANKS = r"[\x20\x09-\x0D]+"
SIGNS = "[#$%&*|]"
#: Counts of a step besides kept, removed, redundant and unique_fails: its name and the mark of the documents lost.
LOST = {"good_lost": "good", "toxic_lost": "toxic"}


def text_filters(words: Column, text: Column) -> dict[str, Column]:
    """Where a text fails: too short, too repetitive, too many capitals, odd signs. words: array of its words."""
    size = F.size(words).cast("long")
    return {
        "A": size < 100,
        "B": F.size(F.array_distinct(words)).cast("long") * 100 < size * 80,
        "C": (F.length(text) - F.length(F.translate(text, UPPER, ""))).cast("long") * 100 > F.length(text).cast("long") * 10,
        "D": text.rlike(SIGNS),
    }


def failure_counts(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """Documents by part, mask (bits of A, B, C, D, E that they fail) and marks: columns part, mask, good, toxic, n.

    E: the text is that of a smaller id anywhere in the table. Null texts and parts are empty ones. Null ids are no
    documents' smaller ids and have none. Repeated rows count each; rows with the smallest id of a text keep E, all of them.
    A document is good (toxic) if any label of its id has quality (toxic) 1; null ids have no label.

    Only ids, digests and masks are shuffled. All rows of a text are added up before they meet at its digest, so a text
    that a third of the documents share is a row for each part and pair of marks there.
    """
    d = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    d = d.withColumn("words", F.array_remove(F.split("text", BLANKS), ""))
    rules = text_filters(F.col("words"), F.col("text"))
    mask = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(rules.values())), F.lit(0))
    d = d.select("id", "part", mask.alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest"))
    d = d.groupBy("id", "part", "mask", "digest").agg(F.count("*").alias("n"))
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    d = d.join(marks, "id", "left").na.fill(False, ["good", "toxic"])
    known = F.col("id").isNotNull()
    d = d.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(known, F.col("n"))), F.lit(0)).alias("n_known"),
        F.min(F.when(known, F.col("id"))).alias("id"), F.min(F.when(known, F.struct("id", "n"))).alias("first"))
    first = F.min("id").over(Window.partitionBy("digest"))
    d = d.withColumn("late", F.col("n_known") - F.when(F.col("id") == first, F.col("first.n")).otherwise(0))
    kinds = F.array(F.struct(F.col("mask"), (F.col("n") - F.col("late")).alias("n")), F.struct((F.col("mask") + (1 << len(rules))).alias("mask"), F.col("late").alias("n")))
    d = d.select("part", "good", "toxic", F.explode(kinds).alias("k")).groupBy("part", "k.mask", "good", "toxic")
    return d.agg(F.sum("k.n").alias("n"))


def lattice_edges(counts: DataFrame, n_filters: int, lost: dict[str, str] = LOST) -> DataFrame:
    """Add counts of documents (part, mask, n and boolean marks) to every edge: before (mask), filter (bit), counts.

    Every part has every edge, with zeros where no document is concerned. An empty table has none.
    """
    edges = [(s, 1 << f) for s in range(1 << n_filters) for f in range(n_filters) if not s >> f & 1]
    d = counts.withColumn("e", F.explode(F.array(*[F.struct(F.lit(s).alias("before"), F.lit(f).alias("filter")) for s, f in edges])))
    fails = F.col("mask").bitwiseAND(F.col("e.filter")) != 0
    gone = F.col("mask").bitwiseAND(F.col("e.before")) != 0
    total = lambda c, name: F.sum(F.when(c, F.col("n")).otherwise(0)).alias(name)
    return d.groupBy("part", "e.before", "e.filter").agg(
        total(~gone & ~fails, "kept"), total(~gone & fails, "removed"), total(gone & fails, "redundant"), total(F.col("mask") == F.col("e.filter"), "unique_fails"),
        *[total(~gone & fails & F.col(mark), name) for name, mark in lost.items()],
    )


def order_steps(edges: DataFrame, letters: str, lost: dict[str, str] = LOST) -> DataFrame:
    """Every order of the filters as a path over the edges: part, filter_order, step (from 1), the edge's counts, and
    shapley: what the step's filter removes, added up over all orders. An edge lies on |before|! (n - 1 - |before|)! of them."""
    n = len(letters)
    paths = [("".join(letters[i] for i in p), k + 1, sum(1 << i for i in p[:k]), 1 << p[k]) for p in permutations(range(n)) for k in range(n)]
    steps = edges.sparkSession.createDataFrame(paths, "filter_order string, step int, before int, filter int")
    weight = F.element_at(F.array(*[F.lit(factorial(k) * factorial(n - 1 - k)) for k in range(n)]), F.bit_count("before") + 1)
    total = F.sum(F.col("removed") * weight).over(Window.partitionBy("part", "filter"))
    known = edges.withColumn("shapley", total)
    return known.join(F.broadcast(steps), ["before", "filter"]).select(
        "part", "filter_order", "step", *[F.col(c).cast("long").alias(c) for c in ("kept", "removed", "redundant", "unique_fails", *lost, "shapley")]
    )


def filter_audit(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """The five filters A-E over documents, for each part, order and step (see the functions above for nulls and ties)."""
    return order_steps(lattice_edges(failure_counts(docs, labels, **columns), 5), "ABCDE")


ORACLE = r"""
with d as (select doc_id, coalesce(lang, '') part, coalesce("text", '') t from documents),
w as (select doc_id, part, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') ws from d),
l as (select doc_id, coalesce(bool_or(quality = 1), false) good, coalesce(bool_or(toxic = 1), false) toxic from labels group by doc_id),
f as (select part, coalesce(good, false) good, coalesce(toxic, false) toxic,
    case when len(ws) < 100 then 1 else 0 end + case when 100 * len(list_distinct(ws)) < 80 * len(ws) then 2 else 0 end
    + case when 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) then 4 else 0 end + case when regexp_matches(t, '[#$%&*|]') then 8 else 0 end
    + case when min(doc_id) over (partition by t) < doc_id then 16 else 0 end mask from w left join l using (doc_id)),
c as (select part, good, toxic, mask, count(*) n from f group by all),
x as (select unnest(['A', 'B', 'C', 'D', 'E']) a, unnest([1, 2, 4, 8, 16]) b),
o as (select p.a || q.a || r.a || s.a || v.a filter_order, [p.b, q.b, r.b, s.b, v.b] bits from x p, x q, x r, x s, x v where p.b + q.b + r.b + s.b + v.b = 31 and len(list_distinct([p.b, q.b, r.b, s.b, v.b])) = 5),
s as (select filter_order, step::int step, bits[step] f, coalesce(list_sum(bits[1:step - 1]), 0)::int before from o, range(1, 6) g(step)),
e as (select part, filter_order, step, f, sum(case when mask & (before | f) = 0 then n else 0 end)::bigint kept,
    sum(case when mask & before = 0 and mask & f <> 0 then n else 0 end)::bigint removed, sum(case when mask & before <> 0 and mask & f <> 0 then n else 0 end)::bigint redundant,
    sum(case when mask = f then n else 0 end)::bigint unique_fails, sum(case when good and mask & before = 0 and mask & f <> 0 then n else 0 end)::bigint good_lost,
    sum(case when toxic and mask & before = 0 and mask & f <> 0 then n else 0 end)::bigint toxic_lost from c, s group by all)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, f))::bigint shapley from e
"""
