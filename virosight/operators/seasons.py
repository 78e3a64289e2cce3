"""Seasons on trees: tip counts, frequencies, and ancestors with tips in the season before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from virosight.functions.sequences import binding_sites, differences, masked_sites


def season_table(spark: SparkSession, first: int, last: int) -> DataFrame:
    """``season, start, end``: October to April of each year."""
    y = F.col("id").cast("int")
    return spark.range(first, last + 1).select(y.alias("season"), F.make_date(y, F.lit(10), F.lit(1)).alias("start"), F.make_date(y + 1, F.lit(4), F.lit(1)).alias("end"))


def season_frequencies(closure: DataFrame, tips: DataFrame) -> DataFrame:
    """``node_id, season, n, freq``: tips of a season below each node over the season's tips.

    ``tips``: node_id, season; a tip in several seasons counts in none.
    """
    once = tips.groupBy("node_id").agg(F.min("season").alias("season"), F.count("*").alias("_k")).where("_k = 1").select(F.col("node_id").alias("node"), "season")
    total = once.groupBy("season").agg(F.count("*").alias("_all"))
    n = closure.join(once, "node").groupBy(F.col("ancestor").alias("node_id"), "season").agg(F.count("*").alias("n"))
    return n.join(total, "season").select("node_id", "season", "n", (F.col("n") / (F.col("_all") + F.lit(1e-10))).alias("freq"))


def season_ancestor(closure: DataFrame, frequencies: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node_id, season, ancestor``: for tips' seasons the nearest proper ancestor with tips in the season before, else the root."""
    before = frequencies.select(F.col("node_id").alias("ancestor"), (F.col("season") + 1).alias("season"))
    present = frequencies.select(F.col("node_id").alias("node"), "season")
    near = closure.where("steps > 0").join(before, "ancestor").join(present, ["node", "season"]).groupBy("node", "season").agg(F.min_by("ancestor", "steps").alias("near"))
    root = nodes.where("parent_id is null").select(F.col("node_id").alias("_root"))
    return present.join(near, ["node", "season"], "left").join(F.broadcast(root)).where("node <> _root").select(F.col("node").alias("node_id"), "season", F.coalesce("near", "_root").alias("ancestor"))


def season_distance(ancestors: DataFrame, masked: DataFrame) -> DataFrame:
    """``node_id, season, distance``: differing masked residues between a node and its ancestor of the season before.

    ``ancestors`` as ``season_ancestor`` gives them; ``masked``: node_id and
    ``residues``, the residues of the site class as one string.
    """
    own = masked.select("node_id", F.col("residues").alias("_a"))
    theirs = masked.select(F.col("node_id").alias("ancestor"), F.col("residues").alias("_b"))
    return ancestors.join(own, "node_id").join(theirs, "ancestor").select("node_id", "season", differences(F.col("_a"), F.col("_b")).cast("long").alias("distance"))


def site_distances(proteins: DataFrame, key: str, seq: str, root: str, mask: str) -> DataFrame:
    """``key, ep, ne, rb``: residues that differ from the root's at masked, unmasked and receptor-binding sites."""
    r, m, s = F.lit(root), F.lit(mask), F.col(seq)
    pair = lambda f: differences(f(s), f(r)).cast("long")
    return proteins.select(
        key, pair(lambda x: masked_sites(x, m)).alias("ep"), pair(lambda x: masked_sites(x, m, "0")).alias("ne"), pair(binding_sites).alias("rb")
    )


def aligned_tolerance(sites: DataFrame, mapping: DataFrame, preferences: DataFrame, key: str, other: float = 1e-5) -> DataFrame:
    """``key, tolerance`` over sites that are aligned gap-free to those of the preferences.

    ``mapping``: pos, site.  A residue without a preference at a mapped site
    has the probability ``other``; gaps and unmapped sites add nothing.
    """
    p = preferences.select("site", F.col("aa").alias("state"), "p")
    rows = sites.where("state <> '-'").join(mapping, "pos").join(p, ["site", "state"], "left")
    return rows.groupBy(key).agg(F.sum(F.ln(F.coalesce("p", F.lit(other)))).alias("tolerance"))


def tolerance(sites: DataFrame, preferences: DataFrame, key: str) -> DataFrame:
    """Summed log preference of each sequence's residues; a residue without preference adds nothing."""
    p = preferences.select(F.col("site").alias("pos"), F.col("aa").alias("state"), F.ln("p").alias("_l"))
    return sites.join(p, ["pos", "state"], "left").groupBy(key).agg(F.sum(F.coalesce("_l", F.lit(0.0))).alias("tolerance"))


def parent_mutations(nodes: DataFrame, sites: DataFrame, pairs: DataFrame, left: str, right: str) -> DataFrame:
    """``left, right, gene, mutation`` between the parents of two tips, which are what the tips' titers are attributed to."""
    up = nodes.select("node_id", "parent_id")
    parents = pairs.join(up.toDF(left, "_pl"), left).join(up.toDF(right, "_pr"), right)
    a = sites.select(F.col("node_id").alias("_pl"), "gene", "pos", F.col("state").alias("_a"))
    b = sites.select(F.col("node_id").alias("_pr"), "gene", "pos", F.col("state").alias("_b"))
    return parents.join(a, "_pl").join(b, ["_pr", "gene", "pos"]).where("_a <> _b").select(left, right, "gene", F.concat("_a", F.col("pos").cast("string"), "_b").alias("mutation"))


def quartet_additivity(pairs: DataFrame) -> DataFrame:
    """Four-point test of measured distances: for each complete quartet the two largest of the three pair sums and their difference.

    ``pairs``: a, b, d with a < b.  Quartets come from equality joins along
    shared members, so only measured ones are built.
    """
    e = lambda x, y, d: pairs.toDF(x, y, d)
    q = e("i", "j", "ij").join(e("i", "k", "ik"), "i").where("j < k").join(e("j", "k", "jk"), ["j", "k"])
    q = q.join(e("i", "l", "il"), "i").where("k < l").join(e("j", "l", "jl"), ["j", "l"]).join(e("k", "l", "kl"), ["k", "l"])
    s = F.array_sort(F.array(F.col("ij") + F.col("kl"), F.col("ik") + F.col("jl"), F.col("il") + F.col("jk")))
    return q.select("i", "j", "k", "l", s[2].alias("top"), s[1].alias("second"), (s[2] - s[1]).alias("gap"))


def grid_scan(measured: DataFrame, predictions: DataFrame, row: str, y: str, by: list[str]) -> DataFrame:
    """Errors of each parameter setting's predictions (by, row, predicted)."""
    e = F.col(y) - F.col("predicted")
    return predictions.join(measured.select(row, y), row).groupBy(*by).agg(F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rms"), F.avg(F.abs(e)).alias("abs"), F.regr_slope("predicted", y).alias("slope"), F.regr_intercept("predicted", y).alias("intercept"))
