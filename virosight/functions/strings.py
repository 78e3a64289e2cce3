"""Column functions on names, passages, genotypes and titers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fix_name(name: Column) -> Column:
    """Strain name without blanks, quotes, brackets, subtype and host marks; double slashes and two-digit years are repaired.

    A last field of just two digits becomes 19yy above 16 and 20yy otherwise.
    """
    x = F.regexp_replace(name, r"H3N2|Human|human|[ '()]", "")
    x = F.replace(x, F.lit("//"), F.lit("/"))
    last = F.element_at(F.split(x, "/"), -1)
    year = F.when(last.rlike("^[0-9]{2}$"), last.try_cast("int"))
    return F.when(year.isNull(), x).otherwise(F.concat(F.substr(x, F.lit(1), F.length(x) - 2), F.when(year > 16, F.lit("19")).otherwise(F.lit("20")), last))


def fix_titer_name(name: Column, aliases: dict[str, str] | None = None) -> Column:
    """``fix_name`` after whole-name aliases, without leading stars."""
    x = name
    for old, new in (aliases or {}).items():
        x = F.when(name == old, F.lit(new)).otherwise(x)
    return F.regexp_replace(fix_name(x), r"^\*+", "")


def strain_key(name: Column) -> Column:
    """Case-insensitive key of a strain name (ASCII letters)."""
    return F.translate(name, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def titer_value(text: Column) -> Column:
    """Number of a raw titer: the first of several; null if it is below a bound (``<``), blank or no number."""
    first = F.try_element_at(F.split(F.trim(text), r"\s+"), F.lit(1))
    return F.when(~F.contains(text, F.lit("<")), first.try_cast("double"))


def location_labels(strain: Column) -> list[Column]:
    """Candidates for the place in a strain name, in the order in which they are looked up (lower-cased, empty if none)."""
    patterns = (r"^[AB]/([^/]+)/", r"^[AB]/([^\-/]+)[\-/]", r"^[AB]/([A-Z][a-z]+)[A-Z0-9]")
    return [F.lower(F.regexp_extract(strain, p, 1)) for p in patterns]


def passage_category(passage: Column) -> Column:
    """MDCK, SIAT or direct by the passage text, else the text itself."""
    up = F.upper(passage)
    direct = passage.rlike("linical|riginal|irect")
    return F.when(F.contains(up, F.lit("MDCK")), F.lit("MDCK")).when(F.contains(up, F.lit("SIAT")), F.lit("SIAT")).when(direct, F.lit("direct")).otherwise(passage)


def genotype_region(text: Column, default: str = "global") -> Column:
    """Region token (EU, NA, AS or OC) of a genotype string."""
    found = F.filter(F.split(F.trim(text), r"[\s/]+"), lambda t: t.isin("EU", "NA", "AS", "OC"))
    return F.coalesce(F.try_element_at(found, F.lit(1)), F.lit(default))


def genotype_states(text: Column) -> Column:
    """Position-and-state tokens of a genotype string, ordered by position and joined by ``/``."""
    tokens = F.filter(F.split(F.trim(text), r"[\s/]+"), lambda t: t.rlike("[0-9]+[A-Z*-]$"))
    keyed = F.transform(tokens, lambda t: F.struct(F.regexp_extract(t, "([0-9]+)[A-Z*-]$", 1).try_cast("int").alias("pos"), t.alias("token")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda k: k["token"]), "/")


def branch_label(text: Column, limit: int = 50, head: int = 45) -> Column:
    """Text of at most ``limit`` characters, longer ones cut to ``head`` and an ellipsis."""
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, head), F.lit("..."))).otherwise(text)


def unique_names(df: DataFrame, name: str, order: list[str], out: str = "unique_name") -> DataFrame:
    """Append -1, -2, ... in the given order to names that occur more than once."""
    own = Window.partitionBy(name)
    n, k = F.count("*").over(own), F.row_number().over(own.orderBy(*order))
    return df.withColumn(out, F.when(n > 1, F.concat(F.col(name), F.lit("-"), k.cast("string"))).otherwise(F.col(name)))
