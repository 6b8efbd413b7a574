"""Mixing a corpus to target weights over a tree of levels (domain, language, source)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WORD = "[^ \\t-\\r]+"
#: Above so many leaves their plan is joined, not broadcast (about 100 bytes each).
BROADCAST_LEAVES = 100_000


def word_count(text: str | Column) -> Column:
    """Words between white space; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _names(levels: list[str]) -> list[str]:
    return [f"__l{i}" for i in range(len(levels))]


def allocate(leaves: DataFrame, levels: list[str], weights: dict[tuple, int], target: int | None, max_epochs: int) -> DataFrame:
    """Budget of each leaf: `leaves` has the levels and `tokens`; adds `budget` (whole tokens).

    A leaf can give tokens * max_epochs, an inner node the sum of its children, a node of weight 0 nothing. From the
    root down, a node's budget is shared among its children by weight; a child that can't take its share gets what it
    can, and what is left goes to its siblings by weight, again and again. So a shortage leaves a node only when all
    children are full, and then the node's own siblings take it. Weights are whole numbers; paths that aren't
    listed weigh 1. Sizes below 9e18 / (sum of weights) are exact.
    """
    spark = leaves.sparkSession
    listed = spark.createDataFrame([("\x1f".join(map(str, p)), int(w)) for p, w in weights.items()] or [("", 1)], "__path string, __w long")
    path = lambda d: F.concat_ws("\x1f", *[F.col(x) for x in levels[:d]]) if d else F.lit("root")
    nodes = leaves.withColumn("__cap", F.col("tokens") * max_epochs)
    for d in range(len(levels), 0, -1):
        nodes = nodes.withColumn("__path", path(d)).join(F.broadcast(listed), "__path", "left").withColumn(f"__w{d}", F.coalesce("__w", F.lit(1))).drop("__path", "__w")
    # capacities from the leaves up; a node of weight 0 has none
    nodes = nodes.withColumn(f"__c{len(levels)}", F.when(F.col(f"__w{len(levels)}") > 0, F.col("__cap")).otherwise(0))
    for d in range(len(levels) - 1, -1, -1):
        inner = Window.partitionBy(*levels[:d]) if d else Window.partitionBy(F.lit(0))
        total = F.sum(f"__c{d + 1}").over(inner) if d == len(levels) - 1 else F.sum(F.when(F.col(f"__first{d + 1}") == 1, F.col(f"__c{d + 1}"))).over(inner)
        nodes = nodes.withColumn(f"__c{d}", total if d == 0 else F.when(F.col(f"__w{d}") > 0, total).otherwise(0))
        if d:
            nodes = nodes.withColumn(f"__first{d}", F.row_number().over(inner.orderBy(*levels)))
    root = F.col("__c0") if target is None else F.least(F.col("__c0"), F.lit(int(target)))
    plan = nodes.withColumn("__b0", root if target is not None else F.least(F.col("__c0"), F.sum("tokens").over(Window.partitionBy(F.lit(0)))))
    for d in range(1, len(levels) + 1):
        # one row per child of depth d
        kids = plan.select(*levels[:d], f"__w{d}", f"__c{d}", f"__b{d - 1}").distinct()
        parent = Window.partitionBy(*levels[: d - 1]) if d > 1 else Window.partitionBy(F.lit(0))
        order = parent.orderBy(F.expr(f"cast(__c{d} as double) / nullif(__w{d}, 0)").asc_nulls_first(), *levels[:d])
        upto, after = order.rowsBetween(Window.unboundedPreceding, Window.currentRow), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
        kids = kids.withColumn("__before", F.sum(f"__c{d}").over(upto) - F.col(f"__c{d}")).withColumn("__rest_w", F.sum(f"__w{d}").over(after))
        kids = kids.withColumn("__full", F.expr(f"(__b{d - 1} - __before) * __w{d} >= __c{d} * __rest_w"))
        kids = kids.withColumn("__rest", F.expr(f"__b{d - 1}") - F.sum(F.when(F.col("__full"), F.col(f"__c{d}")).otherwise(0)).over(parent))
        kids = kids.withColumn("__free", F.when(F.col("__full"), 0).otherwise(F.col(f"__w{d}")))
        kids = kids.withColumn("__all", F.sum("__free").over(parent)).withColumn("__cum", F.sum("__free").over(upto))
        kids = kids.withColumn(f"__b{d}", F.expr(f"case when __full then __c{d} else (__rest * __cum) div __all - (__rest * (__cum - __free)) div __all end"))
        plan = plan.join(kids.select(*levels[:d], f"__b{d}"), levels[:d])
    return plan.select(*leaves.columns, F.col(f"__b{len(levels)}").alias("budget"))


def mix(
    docs: DataFrame,
    levels: dict[str, Column],
    weights: dict[tuple, int],
    *,
    tokens: Column | None = None,
    target: int | None = None,
    max_epochs: int = 4,
    seed: int = 0,
    id_col: str = "doc_id",
    store=None,
) -> DataFrame:
    """Choose documents so that the leaves of the tree meet their budgets.

    levels: name -> expression, from the root down. target: tokens of the whole mix; default: as many as the corpus
    has. Every leaf is read in seeded epochs: in epoch e its documents are ordered by md5(seed:e:id). A leaf gives
    budget div size whole epochs and then the longest prefix of the next epoch's order that fits in what is left.

    Returns the columns of docs and mix_<level>, n_tokens, copies (epochs that take the document, 1 or more) and
    leaf_budget. Documents that no epoch takes are left out. The prefix is found from sums over 4096 ranges of the
    order; only the range in which a leaf's cut lies is sorted, so that no leaf meets in one task.

    A null level is the node ''. Null and empty texts have 0 tokens: they take no budget and are taken if they come
    before the cut. Rows that share an id have the same place in the order; ties go by tokens. An empty table
    gives an empty result. Columns named like the added ones are replaced.
    """
    from veilframe.llm.common import stored

    store = store or stored
    names = [f"mix_{k}" for k in levels]
    d = docs
    for n, e in zip(names, levels.values(), strict=True):
        d = d.withColumn(n, F.coalesce(e.cast("string"), F.lit("")))
    d = d.withColumn("n_tokens", tokens.cast("long") if tokens is not None else word_count("text"))
    leaves = d.groupBy(*names).agg(F.sum("n_tokens").alias("tokens"))
    plan = store(allocate(leaves, names, weights, target, max_epochs))
    plan = plan.withColumn("__whole", F.expr("case when tokens > 0 then budget div tokens else 0 end")).withColumn("__left", F.col("budget") - F.col("__whole") * F.col("tokens"))
    small = F.broadcast if plan.count() <= BROADCAST_LEAVES else (lambda x: x)
    d = d.join(small(plan.select(*names, F.col("budget").alias("leaf_budget"), "__whole", "__left")), names)
    d = d.withColumn("__h", F.md5(F.concat_ws(":", F.lit(str(seed)), (F.col("__whole") + 1).cast("string"), F.col(id_col).cast("string")))).withColumn("__range", F.substring("__h", 1, 3))
    ranges = d.groupBy(*names, "__left", "__range").agg(F.sum("n_tokens").alias("__sum"))
    upto = Window.partitionBy(*names).orderBy("__range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = ranges.withColumn("__end", F.sum("__sum").over(upto)).where("__end > __left").groupBy(*names).agg(F.min(F.struct("__range", (F.col("__end") - F.col("__sum")).alias("before"))).alias("__cut"))
    d = d.join(small(cut), names, "left")
    sure = d.where("__cut is null or __range <> __cut.__range").withColumn("__in", F.expr("__cut is null or __range < __cut.__range"))
    run = Window.partitionBy(*names, "__range").orderBy("__h", "n_tokens").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = d.where("__range = __cut.__range").withColumn("__in", F.col("__cut.before") + F.sum("n_tokens").over(run) <= F.col("__left"))
    out = sure.unionByName(near).withColumn("copies", F.col("__whole") + F.expr(f"case when __in and __whole < {max_epochs} then 1 else 0 end"))
    return out.where("copies > 0").drop("__whole", "__left", "__h", "__range", "__cut", "__in")


def epochs(mixed: DataFrame) -> DataFrame:
    """One row for each document and epoch that takes it (epoch from 1)."""
    return mixed.withColumn("epoch", F.explode(F.expr("sequence(1L, copies)")))


DOMAIN = "case when source = 'src0' then 'web' when try_cast(regexp_extract(source, '([0-9]+)$', 1) as int) % 2 = 1 then 'reference' else 'forum' end"
LEVELS = {"domain": DOMAIN, "lang": "lang", "source": "source"}
WEIGHTS: dict[tuple, int] = {("web",): 40, ("reference",): 35, ("forum",): 25} | {
    (d, lang): w for d in ("web", "reference", "forum") for lang, w in (("en", 6), ("de", 2), ("fr", 2), ("es", 1))
}
SEED, MAX_EPOCHS = 7, 4


def corpus_mix(docs: DataFrame) -> DataFrame:
    """The mix of documents (doc_id, text, lang, source) that query op1 and the pipeline make."""
    return mix(docs, {k: F.expr(v) for k, v in LEVELS.items()}, WEIGHTS, seed=SEED, max_epochs=MAX_EPOCHS)


def _level_sql(d: int) -> str:
    names = ["mix_domain", "mix_lang", "mix_source"][:d]
    up = ", ".join(names[:-1]) or "1"
    keys = ", ".join(names)
    path = "".join(f" and x{i} = {n}" for i, n in enumerate(names))
    return f"""
k{d} as (select {keys}, w, c, b, sum(c) over (partition by {up} order by c::double / nullif(w, 0) nulls first, {keys} rows unbounded preceding) - c bef,
  sum(w) over (partition by {up} order by c::double / nullif(w, 0) nulls first, {keys} rows between current row and unbounded following) rw
  from (select {keys}, any_value(w{d}) w, any_value(c{d}) c, any_value(b{d - 1}) b from p{d - 1} group by all)),
f{d} as (select *, (b - bef) * w >= c * rw as sat from k{d}),
g{d} as (select *, b - sum(case when sat then c else 0 end) over (partition by {up}) rest, case when sat then 0 else w end fr from f{d}),
h{d} as (select *, sum(fr) over (partition by {up}) al, sum(fr) over (partition by {up} order by c::double / nullif(w, 0) nulls first, {keys} rows unbounded preceding) cu from g{d}),
p{d} as (select p.*, (case when sat then h.c else (rest * cu) // al - (rest * (cu - fr)) // al end)::bigint b{d} from p{d - 1} p join h{d} h using ({keys}))"""


def oracle() -> str:
    """The same mix in DuckDB."""
    w1 = " ".join(f"when mix_domain = '{p[0]}' then {w}" for p, w in WEIGHTS.items() if len(p) == 1)
    w2 = " ".join(f"when mix_domain = '{p[0]}' and mix_lang = '{p[1]}' then {w}" for p, w in WEIGHTS.items() if len(p) == 2)
    return f"""
with d as (select doc_id, coalesce(case when source = 'src0' then 'web' when try_cast(regexp_extract(source, '([0-9]+)$', 1) as int) % 2 = 1 then 'reference' else 'forum' end, '') mix_domain,
  coalesce(lang, '') mix_lang, coalesce(source, '') mix_source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint n_tokens from documents),
leaf as (select mix_domain, mix_lang, mix_source, sum(n_tokens)::bigint tokens from d group by all),
n3 as (select *, case {w1} else 1 end w1, case {w2} else 1 end w2, 1 w3, tokens * {MAX_EPOCHS} c3 from leaf),
n2 as (select *, case when w2 > 0 then sum(c3) over (partition by mix_domain, mix_lang) else 0 end c2 from n3),
n1 as (select *, case when w1 > 0 then sum(c3) over (partition by mix_domain) else 0 end c1 from n2),
p0 as (select *, least(sum(c3) over (), sum(tokens) over ()) b0 from n1),{_level_sql(1)},{_level_sql(2)},{_level_sql(3)},
plan as (select mix_domain, mix_lang, mix_source, tokens, b3 budget, case when tokens > 0 then b3 // tokens else 0 end whole from p3),
o as (select d.*, budget leaf_budget, whole, budget - whole * tokens lft, md5('{SEED}:' || (whole + 1) || ':' || doc_id) h from d join plan using (mix_domain, mix_lang, mix_source)),
r as (select *, sum(n_tokens) over (partition by mix_domain, mix_lang, mix_source order by h, n_tokens rows unbounded preceding) cum from o)
select doc_id, mix_domain, mix_lang, mix_source, n_tokens, leaf_budget, (whole + case when cum <= lft and whole < {MAX_EPOCHS} then 1 else 0 end)::bigint copies
from r where whole + case when cum <= lft and whole < {MAX_EPOCHS} then 1 else 0 end > 0"""
