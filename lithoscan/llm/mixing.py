"""Mixing sources to target weights by hierarchical budgets."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._base import checkpoint, fresh, if_small
from .packing import word_count


@dataclass(frozen=True)
class Mix:
    """Integer weights by name on each level of the tree; a name that isn't given has ``default``."""

    domains: dict[str, int] = field(default_factory=dict)
    languages: dict[str, int] = field(default_factory=dict)
    sources: dict[str, int] = field(default_factory=dict)
    default: int = 1
    #: Tokens wanted, as parts per thousand of the tokens there are.
    budget_permille: int = 1000
    #: Times that a document may be used.
    max_epochs: int = 4
    seed: int = 17


def _weight(c: Column, weights: dict[str, int], default: int) -> Column:
    out = F.lit(default)
    for name, w in weights.items():
        out = F.when(c == name, F.lit(w)).otherwise(out)
    return out.cast("bigint")


def water_fill(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Split each parent's ``budget`` over its children by ``weight``, none above its ``cap``.

    What a child can't take goes to its siblings by weight, so a shortage reaches the ancestors
    only where all siblings are at their caps: a parent's cap is the sum of its children's.
    Adds ``given``, in whole tokens.
    """
    part = Window.partitionBy(*parent)
    order = part.orderBy(F.col("cap") / F.col("weight"), name)
    n = nodes.withColumn("before", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    n = n.withColumn("from_here", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))).withColumn("k", F.row_number().over(order))
    free = (F.col("budget") - F.col("before")) * F.col("weight") <= F.col("cap") * F.col("from_here")
    n = n.withColumn("first_free", F.min(F.when(free, F.struct("k", (F.col("budget") - F.col("before")).alias("left"), F.col("from_here").alias("w")))).over(part))
    given = F.when(F.col("first_free").isNull() | (F.col("k") < F.col("first_free.k")), F.col("cap")).otherwise(F.expr("first_free.left * weight div first_free.w"))
    return n.withColumn("given", given).drop("before", "from_here", "k", "first_free")


def leaf_budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """(domain, language, source, tokens, given) from each leaf's tokens, from the root downwards."""
    cap = leaves.filter(F.col("tokens") > 0).withColumn("cap", F.col("tokens") * mix.max_epochs)
    dom = cap.groupBy("domain").agg(F.sum("cap").alias("cap")).withColumn("weight", _weight(F.col("domain"), mix.domains, mix.default)).filter("weight > 0")
    total = leaves.agg(F.expr(f"coalesce(sum(tokens), 0) * {mix.budget_permille} div 1000").alias("budget"))
    dom = water_fill(dom.crossJoin(total).withColumn("root", F.lit(0)), ["root"], "domain").select("domain", F.col("given").alias("budget"))
    lang = cap.groupBy("domain", "language").agg(F.sum("cap").alias("cap")).withColumn("weight", _weight(F.col("language"), mix.languages, mix.default)).filter("weight > 0")
    lang = water_fill(lang.join(dom, "domain"), ["domain"], "language").select("domain", "language", F.col("given").alias("budget"))
    src = cap.withColumn("weight", _weight(F.col("source"), mix.sources, mix.default)).filter("weight > 0")
    return water_fill(src.join(lang, ["domain", "language"]), ["domain", "language"], "source").select("domain", "language", "source", "tokens", "given")


def mix_sources(
    docs: DataFrame, mix: Mix, domain: Column, id_col: str = "doc_id", lang_col: str = "lang", source_col: str = "source",
    length: Column | None = None, bucket_chars: int = 3,
) -> DataFrame:
    """The rows of ``docs``, each as often as it is used, with ``domain_`` and ``epoch_`` columns.

    Weights are propagated through the tree domain-language-source (:func:`leaf_budgets`). A leaf
    with budget b and t tokens is used b // t times as a whole (epochs 0, 1, ...), and then gives
    a prefix of about b % t tokens of its next epoch: documents ordered by an MD5 of seed,
    epoch and id, so that each epoch has an order of its own. The prefix ends with or before the first
    document that exceeds it, whichever is nearer (with it, if both are), so that one long document early in the order doesn't
    empty a leaf's share; rows of one id stand or fall together.

    Order needs no global sort: tokens are summed by leaf and the first ``bucket_chars`` hex digits
    of the hash, and only each leaf's bucket in which its prefix ends is ordered. Texts aren't
    shuffled; every decision reaches the documents as a bound on the hash by leaf.

    Null languages, sources and domains count as the empty name, null ids as the empty string;
    documents without tokens stand in epoch 0 and in any prefix that reaches them, but those of a leaf without a token
    are left out; repeated rows count each; a very long text is a document of many tokens; an empty table
    gives no rows. Other columns are kept (added names get leading underscores if taken).
    """
    n = word_count("text") if length is None else length
    key = [F.coalesce(domain, F.lit("")), F.coalesce(F.col(lang_col), F.lit("")), F.coalesce(F.col(source_col), F.lit(""))]
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    slim = checkpoint(docs.select(key[0].alias("domain"), key[1].alias("language"), key[2].alias("source"), ident.alias("id"), F.coalesce(n, F.lit(0)).cast("bigint").alias("n")))
    leaf = ["domain", "language", "source"]
    given = leaf_budgets(slim.groupBy(*leaf).agg(F.sum("n").alias("tokens")), mix)
    given = checkpoint(given.withColumn("whole", F.expr("given div tokens")).withColumn("rest", F.expr("given % tokens")))

    def place(epoch: Column, doc: Column) -> Column:
        return F.md5(F.concat_ws(":", F.lit(str(mix.seed)), epoch.cast("string"), doc))

    placed = slim.join(if_small(given).filter("rest > 0").select(*leaf, "whole", "rest"), leaf).withColumn("h", place(F.col("whole"), F.col("id"))).withColumn("bucket", F.substring("h", 1, bucket_chars))
    run = Window.partitionBy(*leaf).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy(*leaf, "bucket").agg(F.sum("n").alias("s"), F.max("rest").alias("rest"))
    sums = sums.withColumn("before", F.coalesce(F.sum("s").over(run), F.lit(0)))
    edge = checkpoint(sums.filter(F.col("before") + F.col("s") > F.col("rest")).groupBy(*leaf).agg(F.min(F.struct("bucket", "before")).alias("e")).select(*leaf, F.col("e.bucket").alias("edge"), F.col("e.before").alias("before")))
    inside = placed.join(if_small(edge), leaf).filter(F.col("bucket") == F.col("edge"))
    inside = inside.groupBy(*leaf, "h").agg(F.sum("n").alias("n"), F.max("before").alias("before"), F.max("rest").alias("rest"))
    inside = inside.withColumn("upto", F.col("before") + F.sum("n").over(Window.partitionBy(*leaf).orderBy("h"))).filter("2 * upto - n <= 2 * rest")
    last = inside.groupBy(*leaf).agg(F.max("h").alias("last"))
    mark = fresh(docs, *[f"{x}__d" for x in leaf])
    at = fresh(docs, *[f"{x}__m" for x in leaf])
    whole, rest, bound = fresh(docs, "whole__m", "rest__m", "last__m")
    plan = given.join(edge, leaf, "left").join(last, leaf, "left").select(
        *[F.col(c).alias(a) for c, a in zip(leaf, at)], F.col("whole").alias(whole), F.col("rest").alias(rest), F.coalesce("last", "edge").alias(bound)
    )
    plan = if_small(checkpoint(plan))
    tagged = docs.withColumns(dict(zip(mark, key)))
    on = tagged[mark[0]] == plan[at[0]]
    for m, a in zip(mark[1:], at[1:]):
        on = on & (tagged[m] == plan[a])
    joined = tagged.join(plan, on)
    times = F.col(whole) + F.when((F.col(rest) > 0) & (place(F.col(whole), ident) <= F.col(bound)), 1).otherwise(0)
    dom, ep = fresh(docs, "domain_", "epoch_")
    return joined.filter(times > 0).select(*[docs[c] for c in docs.columns], F.col(mark[0]).alias(dom), F.explode(F.sequence(F.lit(0), (times - 1).cast("int"))).alias(ep))
