"""Operator 8: mixing sources to target weights by Poisson replication [native].

A source's target repetition rate is its share of the target times the rows
wanted, over its rows. Each document draws its count by inverting the Poisson
distribution with that mean at a uniform number hashed from the seed and its
id, is exploded by the count, and the copies are shuffled globally by a hash.
Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from gleaner.runtime import checked_join, private

SEED = 20250101
#: Sources that have no given weight share the rest in proportion to the square root of their rows.
TEMPER = 0.5


def uniform(seed: int, *keys: Column) -> Column:
    """A double in [0, 1) from the first 52 bits of an MD5 of the seed and keys."""
    text = F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(k.cast("string"), F.lit("null")) for k in keys))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def _poisson_cdf(rate: Column) -> Column:
    """The cumulative probabilities of 0, 1, 2, ... up to where the rest is below double precision."""
    steps = F.sequence(F.lit(1), F.ceil(rate + 12 * F.sqrt(rate) + 40).cast("int"))
    start = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("cdf"))

    def step(acc, i):
        p = acc["p"] * rate / i
        return F.struct(p.alias("p"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + p)).alias("cdf"))

    return F.aggregate(steps, start, step, lambda acc: acc["cdf"])


#: exp(-rate) must not underflow; a larger mean is drawn as a sum of equal parts.
_PART = 500.0


def rates(docs: DataFrame, source_col: str, weights: dict[str, float] | None, total: float, temper: float = TEMPER) -> DataFrame:
    """(source, n, rate) for each source; rate is the mean number of copies of its documents.

    Given weights are relative to each other and to the rest, whose weights
    are rows ** temper. `total` is the rows wanted over the rows there are.
    """
    own = docs.select(F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("mix_source"))
    counts = own.groupBy("mix_source").agg(F.count(F.lit(1)).alias("mix_n"))
    weight = F.pow(F.col("mix_n").cast("double"), F.lit(float(temper)))
    for source, w in (weights or {}).items():
        weight = F.when(F.col("mix_source") == source, F.lit(float(w))).otherwise(weight)
    weighted = counts.withColumn("mix_w", weight)
    sums = weighted.agg(F.sum("mix_n").alias("all_n"), F.sum("mix_w").alias("all_w")).first()
    if not sums["all_n"] or not sums["all_w"]:
        return weighted.withColumn("mix_rate", F.lit(0.0)).select("mix_source", "mix_n", "mix_rate")
    wanted = float(total) * sums["all_n"] / sums["all_w"]
    return weighted.withColumn("mix_rate", F.col("mix_w") * F.lit(wanted) / F.col("mix_n")).select("mix_source", "mix_n", "mix_rate")


def mix(
    docs: DataFrame, weights: dict[str, float] | None = None, total: float = 1.0, id_col: str = "doc_id", source_col: str = "source",
    seed: int = SEED, temper: float = TEMPER, copy_col: str | None = "copy",
) -> DataFrame:
    """`docs` replicated to the target weights and shuffled globally; `copy_col` (0, 1, ...) is added unless None.

    Source counts are partial sums; the few sources are joined by broadcast
    after they were measured. The shuffle deals rows by a hash of their plain
    columns, copy and place in the table, so that no source, id or repeated row makes
    an uneven partition, and sorts within partitions by it. `docs` should be a table,
    whose rows come in the same order should a task run again. Defined
    cases: null sources count as source ''; a null id draws as the text 'null';
    repeated rows draw the same count; a text of any length is carried whole
    and never looked into; an empty table gives no rows; a column of the copy's
    name in `docs`, in whatever case, is replaced, and other columns keep their names and values,
    whatever they are.
    """
    names = [c for c in docs.columns if copy_col is None or c.lower() != copy_col.lower()]
    source, key, copy, count, cdf, parts, place = private(docs, "source", "key", "copy", "count", "cdf", "parts", "place")
    table = rates(docs, source_col, weights, total, temper)
    shares = F.greatest(F.ceil(F.col("mix_rate") / _PART), F.lit(1)).cast("int")
    table = table.select(F.col("mix_source").alias(source), shares.alias(parts), "mix_rate")
    table = table.withColumn(cdf, _poisson_cdf(F.col("mix_rate") / F.col(parts))).drop("mix_rate")
    placed = docs.select(*names).withColumn(place, F.monotonically_increasing_id())
    keyed = placed.withColumn(source, F.coalesce(F.col(source_col).cast("string"), F.lit("")))
    joined = checked_join(keyed, table, source, "inner", limit=10_000)
    draw = lambda u: F.size(F.filter(cdf, lambda c: c <= u))
    one = draw(uniform(seed, F.col(id_col)))
    many = F.aggregate(F.sequence(F.lit(1), F.col(parts)), F.lit(0), lambda n, i: n + draw(uniform(seed, F.col(id_col), i)))
    counted = joined.withColumn(count, F.when(F.col(parts) == 1, one).otherwise(many)).where(F.col(count) > 0)
    copies = counted.withColumn(copy, F.explode(F.sequence(F.lit(0), F.col(count) - 1)))
    plain = [f.name for f in docs.schema if f.name in names and isinstance(f.dataType, AtomicType)]
    keyed = copies.withColumn(key, F.xxhash64(F.lit(seed), F.col(copy), F.col(place), *plain))
    dealt = keyed.repartition(key).sortWithinPartitions(key)
    return dealt.select(*names, *([F.col(copy).alias(copy_col)] if copy_col else []))
