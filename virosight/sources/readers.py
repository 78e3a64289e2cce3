"""Readers: text formats of sequences, titers, trees and records to DataFrames.

All read with Spark's own sources, so paths may lie in any store Spark knows
and ``.gz`` files are read as they are.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import zip_longest

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Header fields of surveillance sequence files, by place.
FASTA_FIELDS = {0: "strain", 2: "isolate_id", 3: "date", 4: "region", 5: "country", 7: "location", 8: "passage", 9: "lab"}


def fasta(spark: SparkSession, path: str, fields: dict[int, str] | None = None, upper: bool = False) -> DataFrame:
    """Records of a FASTA file with a header of ``|``-separated fields, and ``seq``.

    Fields past the end are empty; a field named twice is taken from the later
    place.  Records are split at ``>`` at the start of a line, so a file is
    read in parallel; any other ``>`` of a header is left out.
    """
    record = spark.read.text(path, lineSep="\n>").where(F.length(F.trim("value")) > 0)
    line = F.split(F.col("value"), "\n", 2)
    head = F.split(F.regexp_replace(F.trim(line[0]), "[>\r]", ""), r"\|")
    seq = F.regexp_replace(F.coalesce(F.get(line, F.lit(1)), F.lit("")), r"\s", "")
    names = {name: k for k, name in (fields or FASTA_FIELDS).items()}
    return record.select(*(F.trim(F.coalesce(F.get(head, F.lit(k)), F.lit(""))).alias(n) for n, k in names.items()), (F.upper(seq) if upper else seq).alias("seq"))


def fasta_plain(spark: SparkSession, path: str) -> DataFrame:
    """``strain`` (the whole header) and upper-case ``seq``."""
    return fasta(spark, path, {0: "strain"}, upper=True)


def genbank_cds(spark: SparkSession, path: str, genes: tuple[str, ...] = ("SigPep", "HA1", "HA2"), product: str | None = None) -> DataFrame:
    """``gene, start, end`` (1-based, closed) of coding features of the named genes, or with a product, and the file's ``origin`` sequence."""
    whole = spark.read.text(path, wholetext=True)
    feature = F.explode(F.split(F.element_at(F.split("value", "\nFEATURES"), 2), r"\n     (?=\S)")).alias("f")
    origin = F.upper(F.regexp_replace(F.regexp_extract("value", r"(?s)\nORIGIN[^\n]*\n(.*?)//", 1), r"[\s0-9]", ""))
    rows = whole.select(origin.alias("origin"), feature).where(F.col("f").startswith("CDS "))
    place = lambda k: F.regexp_extract("f", r"^CDS\s+<?(\d+)\.\.>?(\d+)", k).try_cast("int")
    out = rows.select(F.regexp_extract("f", '/gene="([^"]+)"', 1).alias("gene"), F.regexp_extract("f", '/product="([^"]+)"', 1).alias("product"), place(1).alias("start"), place(2).alias("end"), "origin")
    wanted = F.col("gene").isin(*genes) if product is None else F.col("product").contains(product)
    return out.where(wanted & F.col("start").isNotNull())


def titers_flat(spark: SparkSession, path: str, excluded: tuple[str, ...] = ()) -> DataFrame:
    """``test, ref, serum, source, titer`` of whitespace-separated rows, without excluded sources."""
    part = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.size(part) >= 5).select(*(part[i].alias(n) for i, n in enumerate(("test", "ref", "serum", "source"))), part[4].try_cast("double").alias("titer"))
    return rows.where(~F.col("source").isin(*excluded)) if excluded else rows


def titers_tsv(spark: SparkSession, path: str, value: Column | None = None) -> DataFrame:
    """``test, ref, serum, source, titer`` of a table with a header: columns 1, 4, 3, the last, and 6; rows without a number go."""
    from virosight.functions.strings import titer_value

    wide = spark.read.csv(path, sep="\t", header=True)
    c = wide.columns
    out = wide.select(F.col(f"`{c[0]}`").alias("test"), F.col(f"`{c[3]}`").alias("ref"), F.col(f"`{c[2]}`").alias("serum"), F.col(f"`{c[-1]}`").alias("source"), titer_value(F.col(f"`{c[5]}`")).alias("titer"))
    return out.where("titer is not null")


def _matrix(texts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in texts:
        rows = []
        for name, text in zip(batch["path"], batch["value"], strict=True):
            lines = [[x.strip() for x in line.split(",")] for line in text.splitlines()]
            sera = list(zip_longest(*lines[:3], fillvalue="")) if len(lines) > 3 else []
            part = ""
            for line in lines[3:]:
                first = line[0] if line else ""
                if first.upper().startswith(("REFERENCE", "TEST")):
                    part = first.upper().split()[0]
                elif part and first.startswith(("A/", "B/")):
                    rows += [(name, part.lower(), first, " ".join(filter(None, sera[j])), v) for j, v in enumerate(line[1:], 1) if v and j < len(sera)]
                elif part == "TEST" and first:
                    break
        yield pd.DataFrame(rows, columns=["source", "part", "test", "serum", "raw"])


def titer_matrix(spark: SparkSession, path: str) -> DataFrame:
    """Long form of wide titer tables (one file a table): ``source, part, test, serum, raw``.

    Three header rows name each serum; a reference part and a test part follow,
    which ends at the first name that is no strain.
    """
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return files.mapInPandas(_matrix, "source string, part string, test string, serum string, raw string")


def matrix_name(name: Column, places: dict[str, str] | None = None) -> Column:
    """Strain name of a wide titer table: the place spelled out if it is one of the abbreviations, and a two-digit year as a whole one.

    Years below 20 are of this century, unlike those of sequence names.
    """
    parts = F.split(F.regexp_replace(F.trim(name), r"\s+", ""), "/")
    place = F.upper(F.get(parts, F.lit(1)))
    long = place
    for short, full in (places or {}).items():
        long = F.when(place == short.upper(), F.lit(full)).otherwise(long)
    known = place.isin(*(k.upper() for k in places)) if places else F.lit(False)
    last = F.element_at(parts, -1)
    year = F.when(last.rlike("^[0-9]{2}$"), last.try_cast("int"))
    whole = F.when(year.isNull(), last).otherwise(F.concat(F.when(year < 20, F.lit("20")).otherwise(F.lit("19")), last))
    mapped = F.transform(parts, lambda p, i: F.when((i == 1) & known, long).when(i == F.size(parts) - 1, whole).otherwise(p))
    return F.array_join(mapped, "/")


def json_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True)


def dimension(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated lookup table with a header."""
    return spark.read.csv(path, sep="\t", header=True)


def snake_case(name: Column) -> Column:
    """``SouthAsia`` and ``South Asia`` to ``south_asia``."""
    return F.lower(F.regexp_replace(F.regexp_replace(name, r"\s+", "_"), r"(?<=[a-z])(?=[A-Z])", "_"))


def forced_strains(spark: SparkSession, path: str) -> DataFrame:
    """Keys of the first column of a list of strains that are always kept."""
    from virosight.functions.strings import fix_name, strain_key

    return spark.read.text(path).where(F.length(F.trim("value")) > 0).select(strain_key(fix_name(F.split("value", "\t")[0])).alias("strain_key")).distinct()


def keyed_masks(spark: SparkSession, path: str) -> DataFrame:
    """``key, mask`` of whitespace-separated lines."""
    part = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).where(F.size(part) >= 2).select(part[0].alias("key"), part[1].alias("mask"))


def preferences(spark: SparkSession, path: str, alphabet: str = "ACDEFGHIKLMNPQRSTVWY") -> DataFrame:
    """``site, aa, p`` of lines with a site and a preference for each residue."""
    part = F.filter(F.split(F.trim("value"), r"[\s,]+"), lambda x: x != "")
    rows = spark.read.text(path).where(F.split(F.trim("value"), r"\s+")[0].rlike(r"^\d+$")).select(part.alias("p"))
    values = F.slice("p", F.size("p") - len(alphabet) + 1, len(alphabet))
    return rows.where(F.size("p") > len(alphabet)).select(F.col("p")[0].cast("int").alias("site"), F.posexplode(values).alias("k", "v")).select("site", F.substr(F.lit(alphabet), F.col("k") + 1, F.lit(1)).alias("aa"), F.col("v").try_cast("double").alias("p"))


def best_record(df: DataFrame, sequences: str = "sequences", citations: str = "citations") -> DataFrame:
    """Each document with its longest sequence (of equal ones a later one if its accession is null) and the citation beside it."""
    pair = F.arrays_zip(F.col(sequences).alias("s"), F.col(citations).alias("c"))
    start = F.try_element_at(pair, F.lit(1))
    better = lambda a, x: (F.length(x["s"]["sequence"]) > F.length(a["s"]["sequence"])) | ((F.length(x["s"]["sequence"]) == F.length(a["s"]["sequence"])) & x["s"]["accession"].isNull())
    best = F.aggregate(F.slice(pair, 2, F.greatest(F.size(pair), F.lit(1))), start, lambda a, x: F.when(better(a, x), x).otherwise(a))
    rest = [c for c in df.columns if c not in (sequences, citations)]
    return df.select(*rest, best.alias("_b")).select(*rest, "_b.s.*", "_b.c.*")


def document_store(df: DataFrame, public_only: bool = True, countries: list[str] | None = None) -> DataFrame:
    kept = df.where("public") if public_only else df
    return kept if not countries else kept.where(F.col("country").isin(countries))


_NODES = "tree_id string, node_id int, parent_id int, child_ord int, branch_length double, strain string, num_date double"


def _number(x) -> float | None:
    try:
        return None if x in (None, "undefined", "") else float(x)
    except (TypeError, ValueError):
        return None


def parse_newick(text: str) -> list[tuple]:
    """Nodes (id in pre-order, parent, place among children, length, label) of one Newick tree; quoted labels may hold any character."""
    out: list[list] = [[0, None, 0, None, None]]
    stack, now, i, kids = [], 0, 0, {}

    def child(parent: int) -> int:
        out.append([len(out), parent, kids.get(parent, 0), None, None])
        kids[parent] = kids.get(parent, 0) + 1
        return len(out) - 1

    while i < len(text):
        c = text[i]
        if c == "(":
            stack.append(now)
            now = child(now)
        elif c == ",":
            now = child(stack[-1])
        elif c == ")":
            now = stack.pop()
        elif c == ";":
            break
        elif c == ":":
            j = i + 1
            while j < len(text) and text[j] not in ",();":
                j += 1
            out[now][3], i = _number(text[i + 1 : j].strip()), j - 1
        elif c in "'\"":
            j = text.index(c, i + 1)
            out[now][4], i = text[i + 1 : j], j
        elif not c.isspace():
            j = i
            while j < len(text) and text[j] not in ",():;":
                j += 1
            out[now][4], i = text[i:j].strip(), j - 1
        i += 1
    return [tuple(n) for n in out]


def newick(spark: SparkSession, path: str) -> DataFrame:
    """Node table of Newick files, one tree a file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(tree, i, p, k, n, label, None) for tree, text in zip(b["path"], b["value"], strict=True) for i, p, k, n, label in parse_newick(text)]
            yield pd.DataFrame(rows, columns=["tree_id", "node_id", "parent_id", "child_ord", "branch_length", "strain", "num_date"]).astype({"parent_id": "Int32"})

    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value").mapInPandas(run, _NODES)


def json_tree(spark: SparkSession, path: str) -> DataFrame:
    """Node table of nested JSON trees, one a file.

    An edge is the difference of ``xvalue`` to the parent's, else
    ``branch_length``, else 1; the text ``undefined`` is null.
    """

    def nodes(tree: str, text: str) -> list[tuple]:
        out, todo = [], [(json.loads(text), None, 0, None)]
        while todo:
            node, parent, place, x0 = todo.pop()
            x, own = _number(node.get("xvalue")), len(out)
            length = x - (x0 or 0.0) if x is not None else _number(node.get("branch_length"))
            out.append((tree, own, parent, place, 1.0 if length is None else length, node.get("strain"), _number(node.get("num_date"))))
            todo += [(child, own, k, x) for k, child in reversed(list(enumerate(node.get("children") or [])))]
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [n for tree, text in zip(b["path"], b["value"], strict=True) for n in nodes(tree, text)]
            yield pd.DataFrame(rows, columns=["tree_id", "node_id", "parent_id", "child_ord", "branch_length", "strain", "num_date"]).astype({"parent_id": "Int32"})

    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value").mapInPandas(run, _NODES)


def stage(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A stage's table as ``sinks.save_stage`` left it; a missing one is an error."""
    return spark.read.parquet(f"{folder}/{name}")
