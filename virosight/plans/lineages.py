"""Builds of one lineage: a configuration and a list of DataFrame steps."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from virosight.functions import dates, sequences, strings
from virosight.operators import curate


@dataclass(frozen=True)
class LineageConfig:
    """What sets one lineage's curation apart."""

    name: str
    least_length: int
    date_spec: str = "year"
    name_pattern: str | None = "^[AB]/"
    outliers: tuple[str, ...] = ()
    probes: tuple[str, ...] = ()
    per_month: int = 50
    regions: tuple[str, ...] = ("africa", "south_asia", "europe", "china", "north_america", "south_america", "japan_korea", "oceania", "southeast_asia")
    extra: tuple[Callable[[DataFrame], DataFrame], ...] = field(default=())


LINEAGES = {
    "h3n2": LineageConfig("h3n2", 987, "full"),
    "h1n1pdm": LineageConfig("h1n1pdm", 987, "full"),
    "h1n1": LineageConfig("h1n1", 1701, "year"),
    "vic": LineageConfig("vic", 987, "full"),
    "yam": LineageConfig("yam", 987, "full"),
    "zika": LineageConfig("zika", 3000, "year", name_pattern=None),
}


def curated(raw: DataFrame, config: LineageConfig) -> DataFrame:
    """Names normalised, then length, alphabet, date and name filters, longest first copy of each strain, listed outliers dropped.

    ``raw``: strain, date (text), region, country, passage, seq.
    """
    df = raw.withColumn("strain", strings.fix_name(F.col("strain")))
    if config.name_pattern is None:
        df = df.withColumn("strain", F.when(F.col("strain").rlike("[A-Za-z]"), F.col("strain")).otherwise(F.concat(F.lit("V"), "strain")))
    else:
        df = curate.name_prefix_filter(df, "strain", config.name_pattern)
    df = curate.canonical_filter(curate.length_filter(df, "seq", config.least_length), "seq")
    df = df.withColumn("collected", dates.repaired_date(F.col("date"), F.col("strain"), config.date_spec)).where("collected is not null")
    if "passage" in df.columns:
        df = curate.drop_egg_passages(df, "passage")
    df = df.withColumn("strain_key", strings.strain_key(F.col("strain")))
    df = curate.keep_first(df, ["strain_key"], [-F.length("seq"), "date", "seq"])
    if config.outliers:
        df = df.where(~F.col("strain").isin(*config.outliers))
    if config.probes:
        df = curate.drop_similar(df, "seq", list(config.probes))
    for step in config.extra:
        df = step(df)
    return df


def sampled(df: DataFrame, config: LineageConfig, forced: DataFrame | None = None, seed: int = 0) -> DataFrame:
    """Round-robin subsample by month and region, forced strains first, ties by a hash of the key."""
    df = df.withColumns({"year": F.year("collected"), "month": F.month("collected")})
    df = curate.flag_listed(df, forced, "strain_key") if forced is not None else df.withColumn("forced", F.lit(False))
    order = [F.desc(F.length("seq")), F.xxhash64("strain_key", F.lit(seed)), "strain_key"]
    return curate.round_robin_subsample(df, ["year", "month"], "region", config.per_month, F.col("forced"), order)


def aligned(df: DataFrame, outgroup: str, spread: float = 3.0, order: str = "strain_key") -> DataFrame:
    """Outgroup's columns only, ambiguous letters masked, unique decimal dates, and clock outliers dropped."""
    df = df.withColumn("seq", sequences.mask_ambiguous(sequences.drop_insertions(F.col("seq"), F.lit(outgroup))))
    df = unique_dates(df, "collected", [order])
    root = sequences.mask_ambiguous(sequences.drop_insertions(F.lit(outgroup), F.lit(outgroup)))
    df = df.withColumn("distance", sequences.mismatch_share(F.substring("seq", 1, 987), F.substring(root, 1, 987)))
    return curate.clock_filter(df, "num_date", "distance", spread)


def unique_dates(df: DataFrame, date: str, order: list, out: str = "num_date") -> DataFrame:
    """Decimal years made unique by 1e-7 for each earlier row of the same day; no date stays null."""
    k = F.row_number().over(Window.partitionBy(date).orderBy(*order))
    return df.withColumn(out, dates.decimal_year(F.col(date)) + k * F.lit(1e-7))


def by_lineage(df: DataFrame, subtype: str, lineage: str, codes: dict[tuple[str, str], str], default: str = "other") -> DataFrame:
    """Lineage code of a (subtype, lineage) pair of header fields."""
    out = F.lit(default)
    for (s, g), code in codes.items():
        out = F.when((F.lower(subtype) == s) & (F.lower(lineage) == g), F.lit(code)).otherwise(out)
    return df.withColumn("lineage_code", out)


def build(raw: DataFrame, config: LineageConfig, steps: list[Callable[[DataFrame], DataFrame]] | None = None, forced: DataFrame | None = None) -> DataFrame:
    """Curate, then run the lineage's own steps (functions of a DataFrame, in order), then subsample."""
    df = curated(raw, config)
    for step in steps or []:
        df = df.transform(step)
    return sampled(df, config, forced)


def by_identity(df: DataFrame, seq: str, references: dict[str, str], share: float = 0.85, out: str = "lineage_code") -> DataFrame:
    """Fills a null ``out`` with the reference of most equal letters, place by place, if they are over ``share`` of its length; else ``other``.

    References are few literals, so this is one expression and no join.
    """
    same = {code: F.size(F.filter(F.arrays_zip(sequences.chars(F.col(seq)).alias("a"), sequences.chars(F.lit(ref)).alias("b")), lambda p: p["a"] == p["b"])) for code, ref in references.items()}
    scored = F.array(*(F.struct((n / F.lit(len(references[c]))).alias("s"), F.lit(c).alias("c")) for c, n in same.items()))
    best = F.array_max(scored)
    found = F.when(best["s"] > share, best["c"]).otherwise(F.lit("other"))
    own = F.col(out) if out in df.columns else F.lit(None).cast("string")
    return df.withColumn(out, F.coalesce(own, found))
