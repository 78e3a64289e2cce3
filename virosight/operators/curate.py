"""Filters, ordered de-duplication, subsampling and set operations on sample tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from virosight.functions.sequences import canonical, mismatch_share
from virosight.operators.ordered import quantiles


def length_filter(df: DataFrame, seq: str, least: int) -> DataFrame:
    return df.where(F.length(seq) >= least)


def canonical_filter(df: DataFrame, seq: str, slack: int = 3) -> DataFrame:
    return df.where(canonical(F.col(seq), slack))


def name_prefix_filter(df: DataFrame, name: str, pattern: str = "^[AB]/") -> DataFrame:
    return df.where(F.col(name).rlike(pattern))


def drop_egg_passages(df: DataFrame, passage: str) -> DataFrame:
    """Rows not passaged in eggs; a null passage stays."""
    return df.where(~F.coalesce(F.lower(passage).startswith("egg"), F.lit(False)))


def drop_gapped(df: DataFrame, seq: str) -> DataFrame:
    return df.where(~F.contains(F.col(seq), F.lit("-")))


def drop_listed(df: DataFrame, listed: DataFrame, on: str | list[str]) -> DataFrame:
    """Anti join; Catalyst broadcasts the list if it is small."""
    return df.join(listed, on, "left_anti")


def keep_listed(df: DataFrame, listed: DataFrame, on: str | list[str]) -> DataFrame:
    return df.join(listed, on, "left_semi")


def flag_listed(df: DataFrame, listed: DataFrame, on: str, out: str = "forced") -> DataFrame:
    """Adds whether the key is in the list."""
    marks = listed.select(on).distinct().withColumn(out, F.lit(True))
    return df.join(marks, on, "left").withColumn(out, F.coalesce(out, F.lit(False)))


def drop_similar(df: DataFrame, seq: str, probes: list[str], share: float = 0.02) -> DataFrame:
    """Drops sequences that differ from any of a few probe sequences in less than ``share`` of the places."""
    near = [F.coalesce(mismatch_share(F.col(seq), F.lit(p)) < share, F.lit(False)) for p in probes]
    return df.where(~reduce(Column.__or__, near, F.lit(False)))


def attribute_filter(df: DataFrame, wanted: dict[str, object]) -> DataFrame:
    """Every named attribute equals its value; ``all`` fits any."""
    tests = [F.col(k) == v for k, v in wanted.items() if v != "all"]
    return df.where(reduce(Column.__and__, tests, F.lit(True)))


def interval_filter(df: DataFrame, regions: list[str] | None, start: float, end: float, region: str = "region", date: str = "num_date") -> DataFrame:
    """Rows of the regions (all if None) in [start, end)."""
    kept = df.where((F.col(date) >= start) & (F.col(date) < end))
    return kept if regions is None else kept.where(F.col(region).isin(regions))


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """First row of each key in a stated order, all columns kept.

    A least-struct aggregation, not a window: rows are combined before the
    shuffle, so a key with very many rows doesn't meet in one task.
    """
    rest = [c for c in df.columns if c not in keys]
    ranked = [F.col(o) if isinstance(o, str) else o for o in order]
    packed = F.struct(*(o.alias(f"_o{i}") for i, o in enumerate(ranked)), F.struct(*rest).alias("_row"))
    return df.groupBy(*keys).agg(F.min(packed).alias("_m")).select(*keys, *(F.col(f"_m._row.{c}").alias(c) for c in rest)).select(*df.columns)


def round_robin_subsample(
    df: DataFrame, stratum: list[str], region: str, per_stratum: int, priority: Column, order: list, keep_priority: bool = False
) -> DataFrame:
    """Per stratum: the first of every region, then the second, and so on, priority rows before others.

    With ``keep_priority`` all priority rows stay and the rest fills up to the
    limit.  No more than ``per_stratum`` rows of a region can be wanted, so
    ranks are cut at that before rows are shuffled, and priority rows are
    ranked apart from the rest.
    """
    df = df.withColumn("_p", F.coalesce(priority.cast("boolean"), F.lit(False)))
    inner = Window.partitionBy(*stratum, region).orderBy(*order)
    outer = Window.partitionBy(*stratum).orderBy("_r", region, *order)

    def ranked(rows: DataFrame) -> DataFrame:
        first = rows.withColumn("_r", F.row_number().over(inner)).where(F.col("_r") <= per_stratum)
        return first.withColumn("_k", F.row_number().over(outer)).where(F.col("_k") <= per_stratum)

    first, rest = df.where("_p"), ranked(df.where("not _p"))
    taken = first.groupBy(*stratum).agg(F.count("*").alias("_taken"))
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in stratum]
    filled = rest.alias("l").join(taken.alias("r"), same, "left").where(F.col("_k") + F.coalesce("_taken", F.lit(0)) <= per_stratum).select("l.*")
    return (first if keep_priority else ranked(first)).unionByName(filled, allowMissingColumns=True).drop("_p", "_r", "_k")


def subsample(df: DataFrame, stratum: list[str], per_stratum: int, priority: Column, order: list) -> DataFrame:
    """``per_stratum`` rows of each stratum, priority rows first, then by a given (hash) order."""
    own = Window.partitionBy(*stratum).orderBy(priority.desc(), *order)
    return df.withColumn("_k", F.row_number().over(own)).where(F.col("_k") <= per_stratum).drop("_k")


def hash_split(df: DataFrame, key: list[str], fraction: float, seed: int = 0, always_train: Column | None = None) -> DataFrame:
    """Adds ``in_test``: a share of the keys chosen by hash, save those that must be trained on."""
    test = F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(10_000)) / 1e4 < fraction
    return df.withColumn("in_test", test if always_train is None else test & ~always_train)


def append_missing(df: DataFrame, curated: DataFrame, key: str) -> DataFrame:
    """Curated rows whose key is not there yet, and all rows."""
    return df.unionByName(curated.join(df.select(key), key, "left_anti"), allowMissingColumns=True)


def clock_filter(df: DataFrame, t: str, d: str, spread: float, keep: Column | None = None) -> DataFrame:
    """Rows whose residual of the line d ~ t is within ``spread`` interquartile ranges; rows in ``keep`` always stay.

    The fit is a one-row aggregate that is joined back; the exact quartiles
    come from ranges of the residuals, so no task holds them all.
    """
    line = df.agg(F.regr_slope(d, t).alias("_b"), F.regr_intercept(d, t).alias("_a"))
    res = df.join(F.broadcast(line)).withColumn("_r", F.col("_b") * F.col(t) + F.col("_a") - F.col(d))
    low, high = quantiles(res.select("_r"), "_r", [0.25, 0.75])
    ok = F.abs("_r") < F.lit(None if low is None else spread * (high - low)).cast("double")
    return res.where(ok if keep is None else ok | keep).drop("_a", "_b", "_r")


def recent_with_vaccines(df: DataFrame, start: float, older: DataFrame, span: float, key: str = "strain", date: str = "num_date") -> DataFrame:
    """Adds listed older strains from the ``span`` years before the start that are not there yet."""
    window = older.where((F.col(date) >= start - span) & (F.col(date) < start))
    return append_missing(df, window, key)


def sort_by_length(df: DataFrame, seq: str, key: str, seed: int = 0) -> DataFrame:
    """Longest first; ties in the order of a hash of the key."""
    return df.orderBy(F.desc(F.length(seq)), F.xxhash64(key, F.lit(seed)), key)


def transfer(nodes: DataFrame, attributes: DataFrame, on: str, fields: list[str]) -> DataFrame:
    """Nodes with the named attributes of the record of the same key; without a record they stay null."""
    return nodes.join(keep_first(attributes.select(on, *fields), [on], fields), on, "left")


def place_lookup(df: DataFrame, strain: str, synonyms: DataFrame, regions: DataFrame, prune: bool = False) -> DataFrame:
    """Adds ``country`` and ``region`` of the place in a strain name.

    Three candidates are cut from the name and looked up in turn (``synonyms``:
    label, country; ``regions``: country, region); without a hit both are
    ``Unknown``, and with ``prune`` rows of an unknown region go.  The lookups
    are joins; small tables are broadcast by the optimizer.
    """
    from virosight.functions.strings import location_labels
    from virosight.sources.readers import snake_case

    labels = keep_first(synonyms.select(F.lower("label").alias("_label"), snake_case(F.col("country")).alias("_c")), ["_label"], ["_c"])
    out = df
    for k, label in enumerate(location_labels(F.col(strain))):
        out = out.withColumn("_l", label).join(labels.toDF("_l", f"_c{k}"), "_l", "left").drop("_l")
    out = out.withColumn("country", F.coalesce("_c0", "_c1", "_c2", F.lit("Unknown"))).drop("_c0", "_c1", "_c2")
    known = keep_first(regions.select(snake_case(F.col("country")).alias("country"), snake_case(F.col("region")).alias("region")), ["country"], ["region"])
    out = out.drop("region").join(known, "country", "left").withColumn("region", F.coalesce("region", F.lit("Unknown")))
    return out.where("region <> 'Unknown'") if prune else out


def conditional_counts(df: DataFrame, condition: Column, by: list[str]) -> DataFrame:
    """Rows that meet a condition, counted by some columns, most frequent first."""
    return df.where(condition).groupBy(*by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *by)


def name_difference(names: DataFrame, other: DataFrame) -> DataFrame:
    """Distinct names that the other set doesn't hold."""
    return names.subtract(other)
