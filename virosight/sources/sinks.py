"""Writers: the exports of a build, each from a flat table."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from virosight.functions.sequences import differs_only


def save_stage(df: DataFrame, folder: str, name: str) -> None:
    df.write.mode("overwrite").parquet(f"{folder}/{name}")


def sequence_differences(df: DataFrame, root: str, seq: str, key: str) -> DataFrame:
    """``key`` and a JSON object of place to state where a sequence differs from the root."""
    d = differs_only(df, F.lit(root), seq, key)
    pairs = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("pos").cast("string").alias("k"), F.col("state").alias("v")))))
    return d.groupBy(key).agg(F.to_json(pairs).alias("diff"))


def clade_annotation(nodes: DataFrame, members: DataFrame, clade: str = "clade", x: str = "xvalue", trajectories: DataFrame | None = None) -> DataFrame:
    """Of the inner nodes that fit each clade's criteria, the one nearest to the root; with its trajectory (feature, pivot, freq) if given.

    The trajectory is that of the feature named like the clade in lower case.
    """
    first = members.join(nodes, "node_id").groupBy(clade).agg(F.min_by("node_id", F.struct(x, "node_id")).alias("node_id"))
    if trajectories is None:
        return first
    curve = F.transform(F.array_sort(F.collect_list(F.struct("pivot", "freq"))), lambda p: F.round(p["freq"], 3)).alias("freq")
    return first.withColumn("_f", F.lower(clade)).join(trajectories.groupBy(F.col("feature").alias("_f")).agg(curve), "_f", "left").drop("_f")


def frequencies_json(trajectories: DataFrame) -> DataFrame:
    """One JSON row for each region and feature: ``region_feature`` and its frequencies in the order of pivots, 3 digits."""
    curve = F.transform(F.array_sort(F.collect_list(F.struct("pivot", "freq"))), lambda p: F.round(p["freq"], 3))
    rows = trajectories.groupBy("region", "feature").agg(curve.alias("freq"), F.array_sort(F.collect_list("pivot")).alias("pivots"))
    return rows.select(F.to_json(F.struct(F.concat_ws("_", "region", "feature").alias("key"), "pivots", "freq")).alias("value"))


def gene_places(cds: DataFrame) -> DataFrame:
    """``gene, location`` with start and end of each coding region, as the frequency export lists them."""
    return cds.select("gene", F.array("start", "end").alias("location"))


def entropy_json(entropy: DataFrame) -> DataFrame:
    return entropy.select(F.to_json(F.struct("pos", F.round("entropy", 4).alias("entropy"), "states")).alias("value"))


def month_rows(table: DataFrame) -> DataFrame:
    """``Y-M`` (the month not padded) and the counts by region in the regions' order."""
    regions = sorted(c for c in table.columns if c not in ("year", "month"))
    return table.select("year", "month", F.concat_ws("-", "year", "month").alias("label"), F.array(*regions).alias("counts"))


def tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, sep="\t", header=True)


def fasta_text(df: DataFrame, fields: list[str], seq: str = "seq", missing: str = "?", trailing: bool = True) -> DataFrame:
    """One text row a record: the fields after ``>``, nulls as ``?``, and the sequence on the next line."""
    head: Column = F.concat_ws("|", *(F.coalesce(F.col(f).cast("string"), F.lit(missing)) for f in fields))
    return df.select(F.concat(F.lit(">"), head, F.lit("|\n" if trailing else "\n"), F.col(seq)).alias("value"))


def effects_table(effects: DataFrame, counts: DataFrame, least: float | None = 0.001, digits: int = 4) -> DataFrame:
    """Effects with how often they occur, largest first: all of them without a least value."""
    rows = effects.join(counts, "mutation", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    kept = rows if least is None else rows.where(F.col("value") > least)
    return kept.select("mutation", F.round("value", digits).alias("effect"), "n").orderBy(F.desc("effect"), "mutation")


def effects_display(effects: DataFrame, counts: DataFrame) -> DataFrame:
    """The table that is shown: effects above 0.001, two digits."""
    return effects_table(effects, counts, 0.001, 2)


def effects_model(effects: DataFrame) -> DataFrame:
    """The table that predictions read: effects above 0.01 by ``gene:mutation``."""
    return effects.where(F.col("value") > 0.01).select("mutation", F.round("value", 4).alias("effect"))


def upsert_partition(df: DataFrame, path: str, keys: list[str]) -> None:
    """Replace the partitions of the keys' values that ``df`` holds, and leave the others as they are."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def titers_by_clade(titers: DataFrame, value: str = "norm") -> DataFrame:
    """For each reference and tested clade a map from serum to value (normalised, or ``raw`` medians)."""
    each = titers.groupBy("ref", "clade", "serum").agg(F.avg(value).alias("_v"))
    return each.groupBy("ref", "clade").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("serum", "_v")))).alias("titers"))


def model_terms(model: DataFrame, kind: str) -> DataFrame:
    """``key, value`` of one kind of a fit's columns: ``serum`` gives potencies, ``virus`` avidities, ``effect`` effects."""
    prefix = F.lit(f"{kind}:")
    return model.where(F.col("col").startswith(prefix)).select(F.substr("col", F.length(prefix) + 1).alias("key"), "value")


def flat_titers(titers: DataFrame, strains: DataFrame) -> DataFrame:
    """``test, ref, serum, source, titer`` text rows, tab-separated, of titers whose tested and reference strain are both known."""
    known = strains.select("strain").distinct()
    rows = titers.join(known.withColumnRenamed("strain", "test"), "test", "left_semi").join(known.withColumnRenamed("strain", "ref"), "ref", "left_semi")
    return rows.select(F.concat_ws("\t", "test", "ref", "serum", "source", F.col("titer").cast("string")).alias("value"))


def sequences_with_titers(df: DataFrame, titers: DataFrame, name: str, order: list) -> DataFrame:
    """The first sequence of each tested strain's reduced name."""
    from virosight.operators.curate import keep_first

    return keep_first(df.join(titers.select(F.col("test").alias(name)).distinct(), name, "left_semi"), [name], order)


def strains_with_titers(titers: DataFrame) -> DataFrame:
    return titers.groupBy("test").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "test")


def merged_accessions(tables: list[DataFrame]) -> DataFrame:
    """Distinct (strain, accession) rows of several lists."""
    out = tables[0].select("strain", "accession")
    for t in tables[1:]:
        out = out.union(t.select("strain", "accession"))
    return out.distinct()


def _children(pdf: pd.DataFrame) -> tuple[list, dict]:
    """Rows of one tree in child order, and each node's children."""
    rows = pdf.sort_values(["child_ord", "node_id"]).to_dict("records")
    kids: dict = {}
    for r in rows:
        kids.setdefault(None if pd.isna(r["parent_id"]) else r["parent_id"], []).append(r)
    return rows, kids


def nested_trees(nodes: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """``tree_id, value``: each tree as nested JSON, children in order, numbers with 5 digits; each tree is built in a task of its own."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, kids = _children(pdf)
        flat = {}
        for r in rows:
            own = {k: r[k] for k in keep if r.get(k) is not None and not (isinstance(r[k], float) and np.isnan(r[k]))}
            flat[r["node_id"]] = {k: round(v, 5) if isinstance(v, float) else v.item() if isinstance(v, np.generic) else v for k, v in own.items()}
        for parent, own in kids.items():
            if parent is not None:
                flat[parent]["children"] = [flat[r["node_id"]] for r in own]
        text = _nested_text(flat[kids[None][0]["node_id"]])
        return pd.DataFrame({"tree_id": [pdf["tree_id"].iloc[0]], "value": [text]})

    fields = [c for c in dict.fromkeys(("tree_id", "node_id", "parent_id", "child_ord", *keep))]
    return nodes.select(*fields).groupBy("tree_id").applyInPandas(run, "tree_id string, value string")


def _nested_text(node: dict) -> str:
    """JSON text of nested children of any depth."""
    out, todo = [], [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
            continue
        own = json.dumps({k: v for k, v in x.items() if k != "children"})
        if "children" not in x:
            out.append(own)
            continue
        out.append(own[:-1] + (", " if len(own) > 2 else "") + '"children": [')
        todo.append("]}")
        for k, child in reversed(list(enumerate(x["children"]))):
            todo.append(child)
            if k:
                todo.append(", ")
    return "".join(out)


def newick_text(nodes: DataFrame, label: str = "strain") -> DataFrame:
    """``tree_id, value``: each tree as Newick text, quoted labels and lengths with 6 digits; each tree is built in a task of its own."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        _, kids = _children(pdf)
        out, todo = [], [kids[None][0]]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                out.append(x)
                continue
            name = "" if pd.isna(x[label]) else "'" + str(x[label]).replace("'", "") + "'"
            own = name + ("" if pd.isna(x["branch_length"]) else f":{x['branch_length']:.6f}")
            below = kids.get(x["node_id"], [])
            if not below:
                out.append(own)
                continue
            out.append("(")
            todo.append(")" + own)
            for k, child in reversed(list(enumerate(below))):
                todo.append(child)
                if k:
                    todo.append(",")
        return pd.DataFrame({"tree_id": [pdf["tree_id"].iloc[0]], "value": ["".join(out) + ";"]})

    fields = ["tree_id", "node_id", "parent_id", "child_ord", "branch_length", label]
    return nodes.select(*fields).groupBy("tree_id").applyInPandas(run, "tree_id string, value string")
