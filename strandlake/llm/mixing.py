"""Mixing sources to target weights: budgets down a tree, then seeded prefixes of the leaves.

Column expressions only. The tree is domain, language, source. A node's budget
is divided among its children in proportion to their weights; no child gets
more than its documents give in the allowed number of epochs, and what it
cannot take goes to its siblings by weight. As a node's own share is bounded in
the same way one level above, only what a whole family cannot take reaches the
families beside it.

A leaf goes through all of its documents for each whole epoch in its budget; of
the last epoch it takes documents in a seeded order for as long as they fit.
Where that order stops is found from sums over hash buckets, about the square
root of the leaf's documents in number, and then within one bucket.

Rows of one doc_id and leaf are taken together or not at all, as are those
without a doc_id. Null languages and sources are empty ones. Null, empty and
blank texts have no tokens and always fit. Ties of the order go by doc_id. An
empty table gives an empty mix; other columns are not looked at.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandlake.llm.shared import join_checked, text_or_empty, written

LEAF = ["domain", "lang", "source"]

# Weights by name, others have 1.
DOMAIN_WEIGHTS = {"d0": 4, "d1": 3, "d2": 2, "d3": 1}
LANG_WEIGHTS = {"en": 3, "fr": 2}
SOURCE_WEIGHTS: dict[str, int] = {}
#: Share of all tokens that the mix has, in percent; times that a document may come.
BUDGET_PERCENT, MOST_EPOCHS, SEED = 75, 2, "mix-1"


def domain_of(source: Column) -> Column:
    """Domain of a source: the number in its name modulo 4; other without one."""
    n = F.regexp_extract(source, "([0-9]+)$", 1).try_cast("bigint")
    return F.coalesce(F.concat(F.lit("d"), (n % 4).cast("string")), F.lit("other"))


def n_tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def _leaves(docs: DataFrame) -> list[Column]:
    return [domain_of(F.col("source").cast("string")).alias("domain"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source")]


def _weight(name: Column, weights: dict[str, int]) -> Column:
    out = F.lit(1)
    for k, v in weights.items():
        out = F.when(name == k, v).otherwise(out)
    return out.cast("decimal(19,0)")


def _shares(nodes: DataFrame, parent: list[str], name: str, weights: dict[str, int]) -> DataFrame:
    """nodes (parent, name, cap, budget of the parent) with budget as their own.

    Ordered by capacity for their weight, a node is full if the budget reaches
    its level: what nodes before it take, and its level for each weight from it on.
    """
    d = nodes.withColumns({"_w": _weight(F.col(name), weights), "_cap": F.col("cap").cast("decimal(19,0)"), "_b": F.col("budget").cast("decimal(19,0)")})
    family = W.partitionBy(*parent)
    order = family.orderBy(F.col("cap").cast("double") / F.col("_w").cast("double"), name)
    before = F.coalesce(F.sum("_cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("decimal(19,0)")
    rest = F.sum("_w").over(order.rowsBetween(0, W.unboundedFollowing)).cast("decimal(19,0)")
    d = d.withColumns({"_before": before, "_rest": rest})
    d = d.withColumn("_full", F.col("_before") * F.col("_w") + F.col("_cap") * F.col("_rest") <= F.col("_b") * F.col("_w"))
    d = d.withColumns({
        "_left": (F.col("_b") - F.coalesce(F.sum(F.when(F.col("_full"), F.col("_cap"))).over(family), F.lit(0))).cast("decimal(19,0)"),
        "_open": F.sum(F.when(~F.col("_full"), F.col("_w"))).over(family).cast("decimal(19,0)"),
        "_upto": F.sum(F.when(~F.col("_full"), F.col("_w"))).over(order.rowsBetween(W.unboundedPreceding, 0)).cast("decimal(19,0)"),
    })
    whole = F.when(F.col("_full"), F.col("cap")).otherwise(F.expr("_left * _upto div _open - _left * (_upto - _w) div _open").cast("long"))
    return d.select(*[c for c in nodes.columns if c != "budget"], whole.alias("budget"))


def leaf_budgets(slim: DataFrame, percent: int = BUDGET_PERCENT, epochs: int = MOST_EPOCHS) -> DataFrame:
    """domain, lang, source, n_docs, tokens and budget of each leaf of slim (the leaf's columns and n_tokens)."""
    leaves = written(slim.groupBy(*LEAF).agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("tokens")), "leaves")
    cap = (F.sum("tokens") * epochs).alias("cap")
    total = leaves.agg((F.sum("tokens") * percent / 100).cast("long").alias("budget"))
    domains = _shares(leaves.groupBy("domain").agg(cap).join(F.broadcast(total)), [], "domain", DOMAIN_WEIGHTS)  # total is one row
    langs = leaves.groupBy("domain", "lang").agg(cap).join(domains.select("domain", "budget"), "domain")
    langs = _shares(langs, ["domain"], "lang", LANG_WEIGHTS)
    own = leaves.withColumn("cap", F.col("tokens") * epochs).join(langs.select("domain", "lang", "budget"), ["domain", "lang"])
    return _shares(own, ["domain", "lang"], "source", SOURCE_WEIGHTS).select(*LEAF, "n_docs", "tokens", "budget")


def _order(epoch: Column, seed: str) -> Column:
    """Place of a document in an epoch: hex digits, then doc_id."""
    return F.substring(F.md5(F.concat_ws(":", F.lit(seed), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 16)


def _bucket(order: Column, n_docs: Column) -> Column:
    n = F.ceil(F.sqrt(n_docs.cast("double"))).cast("long")
    return F.floor(F.conv(F.substring(order, 1, 6), 16, 10).cast("long") * n / F.lit(1 << 24)).cast("long")


def plan(slim: DataFrame, seed: str = SEED, percent: int = BUDGET_PERCENT, epochs: int = MOST_EPOCHS) -> DataFrame:
    """Each leaf's n_docs, whole (epochs), and where the last epoch stops: bucket cut, last order h and doc_id in it."""
    leaves = leaf_budgets(slim, percent, epochs)
    whole = F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(0)
    leaves = written(leaves.withColumn("whole", whole.cast("long")).withColumn("rest", F.col("budget") - F.col("whole") * F.col("tokens")), "leaf-budgets")
    last = join_checked(slim, leaves.where("rest > 0"), LEAF, "inner").withColumn("h", _order(F.col("whole"), seed))
    last = last.withColumn("bucket", _bucket(F.col("h"), F.col("n_docs")))
    sums = last.groupBy(*LEAF, "bucket", "rest").agg(F.sum("n_tokens").alias("t"))
    upto = F.sum("t").over(W.partitionBy(*LEAF).orderBy("bucket"))
    cut = written(sums.withColumn("upto", upto).where("upto > rest and upto - t <= rest").select(*LEAF, F.col("bucket").alias("cut"), (F.col("upto") - F.col("t")).alias("used")), "mix-cuts")
    inside = join_checked(last, cut, LEAF, "inner").where("bucket = cut")
    inside = inside.groupBy(*LEAF, "rest", "used", "h", "doc_id").agg(F.sum("n_tokens").alias("n_tokens"))  # rows of one id, or of none, are one
    seen = F.col("used") + F.sum("n_tokens").over(W.partitionBy(*LEAF).orderBy("h", "doc_id"))  # peers count together
    ends = inside.withColumn("seen", seen).where("seen <= rest").groupBy(*LEAF).agg(F.max(F.struct("h", "doc_id")).alias("end"))
    return written(leaves.join(cut, LEAF, "left").join(ends, LEAF, "left").select(*LEAF, "n_docs", "whole", "rest", "cut", F.col("end.h").alias("end_h"), F.struct(F.col("end.h").alias("h"), F.col("end.doc_id").alias("doc_id")).alias("end")), "mix-plan")


def _chosen(rows: DataFrame, leaves: DataFrame, seed: str) -> DataFrame:
    """rows (with the leaf's columns) once for each epoch that takes them, with epoch."""
    out = join_checked(rows, leaves, LEAF, "inner").withColumn("_h", _order(F.col("whole"), seed))
    b = _bucket(F.col("_h"), F.col("n_docs"))
    into = (F.col("rest") > 0) & (F.col("cut").isNull() | (b < F.col("cut")) | ((b == F.col("cut")) & F.col("end_h").isNotNull() & (F.struct(F.col("_h").alias("h"), F.col("doc_id").alias("doc_id")) <= F.col("end"))))
    times = F.col("whole") + F.coalesce(into, F.lit(False)).cast("long")
    return out.withColumn("_times", times).where("_times > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_times") - 1)))


def slim_rows(docs: DataFrame) -> DataFrame:
    """doc_id, the leaf's columns and n_tokens of each row; null names are empty ones, a null text has no tokens."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_leaves(docs), n_tokens(text_or_empty()).alias("n_tokens"))


def mix(docs: DataFrame, seed: str = SEED, percent: int = BUDGET_PERCENT, epochs: int = MOST_EPOCHS) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens and epoch: a row for each time that a document is in the mix.

    Rows of one doc_id and leaf are taken together or not at all.
    """
    slim = written(slim_rows(docs), "mix-rows")
    return _chosen(slim, plan(slim, seed, percent, epochs), seed).select("doc_id", *LEAF, "n_tokens", "epoch")


def mix_documents(docs: DataFrame, seed: str = SEED, percent: int = BUDGET_PERCENT, epochs: int = MOST_EPOCHS) -> DataFrame:
    """doc_id, text, lang, source, n_chars (if docs have it), domain and epoch for each time that a document is in the mix."""
    leaves = plan(written(slim_rows(docs), "mix-rows"), seed, percent, epochs)
    own = [c for c in ("n_chars",) if c in docs.columns]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *own, *_leaves(docs))
    return _chosen(rows, leaves, seed).select("doc_id", "text", "lang", "source", *own, "domain", "epoch")


ORACLE = f"""
with slim as (
  select doc_id, coalesce('d' || cast(try_cast(regexp_extract(source, '([0-9]+)$', 1) as bigint) % 4 as varchar), 'other') as domain,
    coalesce(lang, '') as lang, coalesce(source, '') as source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as bigint) as n_tokens
  from documents),
leaves as (select domain, lang, source, count(*) as n_docs, cast(sum(n_tokens) as hugeint) as tokens from slim group by all),
d0 as (select domain, case domain when 'd0' then 4 when 'd1' then 3 when 'd2' then 2 else 1 end as w, {MOST_EPOCHS} * sum(tokens) as cap,
  (select cast(sum(tokens) as hugeint) * {BUDGET_PERCENT} // 100 from leaves) as b from leaves group by domain),
d1 as (select *, coalesce(sum(cap) over (order by cap::double / w, domain rows between unbounded preceding and 1 preceding), 0) * w
  + cap * sum(w) over (order by cap::double / w, domain rows between current row and unbounded following) <= b * w as f from d0),
d2 as (select domain, case when f then cap else l * u // o - l * (u - w) // o end as b from (select *, b - coalesce(sum(cap) filter (f) over (), 0) as l, sum(w) filter (not f) over () as o,
    sum(case when f then 0 else w end) over (order by cap::double / w, domain rows between unbounded preceding and current row) as u from d1)),
l0 as (select domain, lang, case lang when 'en' then 3 when 'fr' then 2 else 1 end as w, {MOST_EPOCHS} * sum(tokens) as cap, any_value(d2.b) as b
  from leaves join d2 using (domain) group by domain, lang),
l1 as (select *, coalesce(sum(cap) over (partition by domain order by cap::double / w, lang rows between unbounded preceding and 1 preceding), 0) * w
  + cap * sum(w) over (partition by domain order by cap::double / w, lang rows between current row and unbounded following) <= b * w as f from l0),
l2 as (select domain, lang, case when f then cap else l * u // o - l * (u - w) // o end as b from (select *, b - coalesce(sum(cap) filter (f) over (partition by domain), 0) as l, sum(w) filter (not f) over (partition by domain) as o,
    sum(case when f then 0 else w end) over (partition by domain order by cap::double / w, lang rows between unbounded preceding and current row) as u from l1)),
s0 as (select domain, lang, source, tokens, 1 as w, {MOST_EPOCHS} * tokens as cap, b from leaves join l2 using (domain, lang)),
s1 as (select *, coalesce(sum(cap) over (partition by domain, lang order by cap::double / w, source rows between unbounded preceding and 1 preceding), 0) * w
  + cap * sum(w) over (partition by domain, lang order by cap::double / w, source rows between current row and unbounded following) <= b * w as f from s0),
s2 as (select domain, lang, source, tokens, case when f then cap else l * u // o - l * (u - w) // o end as b from (select *, b - coalesce(sum(cap) filter (f) over (partition by domain, lang), 0) as l, sum(w) filter (not f) over (partition by domain, lang) as o,
    sum(case when f then 0 else w end) over (partition by domain, lang order by cap::double / w, source rows between unbounded preceding and current row) as u from s1)),
s3 as (select *, case when tokens > 0 then b // tokens else 0 end as whole from s2),
ordered as (select doc_id, domain, lang, source, n_tokens, whole, b - whole * tokens as rest, sum(n_tokens) over (partition by domain, lang, source
    order by substr(md5('{SEED}:' || cast(whole as varchar) || ':' || coalesce(cast(doc_id as varchar), '')), 1, 16), doc_id) as seen
  from slim join s3 using (domain, lang, source)),
taken as (select *, cast(whole + case when rest > 0 and seen <= rest then 1 else 0 end as bigint) as times from ordered)
select doc_id, domain, lang, source, n_tokens, unnest(range(times)) as epoch from taken where times > 0
"""
