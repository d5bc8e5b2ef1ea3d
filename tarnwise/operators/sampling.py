"""Seeded samples and splits that do not depend on partitions: order comes from a hash of the key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_hash(key: str | Column, seed: int) -> Column:
    """A hash other engines share, to order rows by."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), (F.col(key) if isinstance(key, str) else key).cast("string")))


def unit_hash(key: str, seed: int) -> Column:
    """A number in [0, 1) from the hash."""
    return F.conv(F.substring(order_hash(key, seed), 1, 8), 16, 10).cast("double") / float(1 << 32)


def hash_split(df: DataFrame, key: str, parts: Sequence[tuple[str, float]], seed: int = 42) -> DataFrame:
    """`df` with `split`: each key to a part by its hash, in about the given proportions; no shuffle."""
    u, out, total, edge = unit_hash(key, seed), F.lit(parts[-1][0]), sum(p for _, p in parts), 0.0
    cuts = []
    for name, p in parts:
        edge += p / total
        cuts.append((name, edge))
    for name, e in reversed(cuts[:-1]):
        out = F.when(u < e, name).otherwise(out)
    return df.withColumn("split", out)


def exact_split(df: DataFrame, key: str, parts: Sequence[tuple[str, float]], seed: int = 42) -> DataFrame:
    """(key, split) with floor(n * share) distinct keys in each part but the first, which takes the rest.

    Keys are ranked through 4096 hash ranges whose counts are summed first, so no task
    ranks more than one range.
    """
    ids = df.select(key).filter(F.col(key).isNotNull()).distinct().withColumn("_h", order_hash(key, seed)).withColumn("_b", F.substring("_h", 1, 3))
    counts = ids.groupBy("_b").agg(F.count(F.lit(1)).alias("_c"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_c").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # 4096 rows at most
    n = ids.count()
    ranked = ids.join(F.broadcast(before.select("_b", "_before")), "_b").withColumn("_r", F.col("_before") + F.row_number().over(Window.partitionBy("_b").orderBy("_h", key)))
    sizes = {name: int(n * p + 1e-9) for name, p in parts[1:]}
    first = n - sum(sizes.values())
    out, edge = F.lit(parts[-1][0]), first
    cuts = [(parts[0][0], first)]
    for name, _ in parts[1:]:
        edge += sizes[name]
        cuts.append((name, edge))
    for name, e in reversed(cuts):
        out = F.when(F.col("_r") <= e, name).otherwise(out)
    return ranked.select(key, out.alias("split"))


def stratified(df: DataFrame, stratum: str, key: str, quotas: dict[str, int], seed: int = 7) -> DataFrame:
    """The quota of each stratum, first in hash order. The window keeps `quota` rows a partition before it shuffles."""
    want = F.try_element_at(F.create_map(*[x for k, v in quotas.items() for x in (F.lit(k), F.lit(v))]), F.col(stratum))
    w = Window.partitionBy(stratum).orderBy(order_hash(key, seed), key)
    most = max(quotas.values())
    return df.filter(F.col(stratum).isin(list(quotas))).withColumn("rn", F.row_number().over(w)).filter((F.col("rn") <= most) & (F.col("rn") <= want))


def review_strata(df: DataFrame, flagged: Column, missed: Column) -> DataFrame:
    """`df` with `stratum`: flagged, possible_miss (not flagged, but suspect) or control; rows whose flag is null are left out."""
    return df.filter(flagged.isNotNull()).withColumn("stratum", F.when(flagged, "flagged").when(F.coalesce(missed, F.lit(False)), "possible_miss").otherwise("control"))


def numbered_sample(df: DataFrame, keys: Sequence[str], n: int, seed: int = 42, name: str = "sample_id") -> DataFrame:
    """The first `n` distinct rows in hash order of `keys`, numbered from 1. The sort keeps n rows a task."""
    rows = df.distinct().withColumn("_h", order_hash(F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("-")) for k in keys]), seed))
    some = rows.orderBy("_h", *keys).limit(n)
    return some.withColumn(name, F.row_number().over(Window.orderBy("_h", *keys))).drop("_h")  # n rows


def even_quotas(strata: Sequence[str], n: int) -> dict[str, int]:
    """n shared out evenly, the first strata taking the remainder."""
    base, more = divmod(n, len(strata))
    return {s: base + (i < more) for i, s in enumerate(strata)}


def with_ids(df: DataFrame, order: Sequence[Column], prefix: str = "A", width: int = 3) -> DataFrame:
    """A small sample numbered A001, A002, ... in order."""
    return df.withColumn("annot_id", F.format_string(f"{prefix}%0{width}d", F.row_number().over(Window.orderBy(*order))))


def family_split(names: Sequence[str], families: Sequence[Sequence[str]], seed: int = 42) -> tuple[set[str], set[str]]:
    """Two halves of a short list of names such that no family is parted: units in seeded order, each to the lesser half."""
    import hashlib

    known = set(names)
    units = [sorted(known & set(f)) for f in families]
    single = known - {n for u in units for n in u}
    units = [u for u in units if u] + [[n] for n in single]
    units.sort(key=lambda u: hashlib.md5(f"{seed}|{u[0]}".encode()).hexdigest())
    halves: tuple[set[str], set[str]] = (set(), set())
    for u in units:
        halves[len(halves[0]) > len(halves[1])].update(u)
    return halves


def attention_checks(df: DataFrame, key: str, text: str, n: int, seed: int = 5, kind: str = "reverse") -> DataFrame:
    """n rows turned into items a careful rater must flag: the text with a false statement put before it."""
    lead = {"reverse": "It is certain that the opposite holds: ", "foreign": "This is about another patient: "}[kind]
    picked = df.orderBy(order_hash(key, seed), key).limit(n)
    return picked.withColumn(text, F.concat(F.lit(lead), F.coalesce(text, F.lit("")))).withColumn("is_attention_check", F.lit(True))
