"""Column functions on sequences.  Positions are 1-based; a gap is ``-``."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUCLEOTIDES, AMINO_ACIDS = "ACGT-N", "ACDEFGHIKLMNPQRSTVWY*X-"


def canonical(seq: Column, slack: int = 3) -> Column:
    """All but ``slack`` characters at most are A, C, G or T in either case."""
    return F.length(F.translate(seq, "ACGTacgt", "")) <= slack


def mask_ambiguous(seq: Column) -> Column:
    """Upper-case letters other than A, C, G and T become gaps."""
    return F.translate(seq, "BDEFHIJKLMNOPQRSUVWXYZ", "-" * 22)


def chars(seq: Column) -> Column:
    return F.filter(F.split(seq, ""), lambda c: c != "")


def drop_insertions(seq: Column, outgroup: Column) -> Column:
    """Upper-cased columns where the outgroup has no gap."""
    pairs = F.zip_with(chars(seq), chars(outgroup), lambda a, b: F.when(b != "-", F.upper(a)))
    return F.array_join(F.filter(pairs, lambda c: c.isNotNull()), "")


def mismatch_share(a: Column, b: Column) -> Column:
    """Share of differing places among those where neither has a gap; null if there is none."""
    pairs = F.filter(F.arrays_zip(chars(a).alias("a"), chars(b).alias("b")), lambda p: p["a"].isNotNull() & p["b"].isNotNull() & (p["a"] != "-") & (p["b"] != "-"))
    n = F.size(pairs)
    return F.when(n > 0, F.size(F.filter(pairs, lambda p: p["a"] != p["b"])) / n)


#: Amino acids of the standard code, codons in TCAG order.
_CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


def translate_codons(nuc: Column) -> Column:
    """Protein of the whole codons: ``*`` for stops, ``X`` for codons with other letters, ``-`` for three gaps."""
    entries = {"".join(c): a for c, a in zip(product("TCAG", repeat=3), _CODE, strict=True)} | {"---": "-"}
    table = F.create_map(*(F.lit(x) for kv in entries.items() for x in kv))
    n = F.floor(F.length(nuc) / 3).cast("int")
    codons = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.coalesce(F.try_element_at(table, F.upper(F.substr(nuc, i * 3 + 1, F.lit(3)))), F.lit("X")))
    return F.when(n > 0, F.array_join(codons, "")).otherwise(F.lit(""))


def masked_sites(protein: Column, mask: Column, keep: str = "1") -> Column:
    """Residues at the places where the mask, cut to the protein's length, has ``keep``."""
    pairs = F.arrays_zip(chars(protein).alias("a"), chars(mask).alias("m"))
    return F.array_join(F.transform(F.filter(pairs, lambda p: p["a"].isNotNull() & (p["m"] == keep)), lambda p: p["a"]), "")


#: Receptor-binding residues of the mature protein, and the length of the signal peptide before it.
BINDING_SITES, SIGNAL = (145, 155, 156, 158, 159, 189, 193), 16


def binding_sites(peptide: Column) -> Column:
    """Residues at the receptor-binding sites of signal peptide and first subunit in one."""
    return F.concat(*(F.substring(peptide, s + SIGNAL, 1) for s in BINDING_SITES))


def differences(a: Column, b: Column) -> Column:
    """Count of places with unequal residues, over the shorter length."""
    return F.size(F.filter(F.arrays_zip(chars(a).alias("a"), chars(b).alias("b")), lambda p: p["a"].isNotNull() & p["b"].isNotNull() & (p["a"] != p["b"])))


def mutations(ancestor: Column, derived: Column) -> Column:
    """``A12T`` for each differing place, in order, comma separated."""
    n = F.least(F.length(ancestor), F.length(derived))
    places = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (i <= n) & (F.substr(ancestor, i, F.lit(1)) != F.substr(derived, i, F.lit(1))))
    return F.array_join(F.transform(places, lambda i: F.concat(F.substr(ancestor, i, F.lit(1)), i.cast("string"), F.substr(derived, i, F.lit(1)))), ",")


def sites(df: DataFrame, seq: str, *keep: str) -> DataFrame:
    """Long form: the kept columns, ``pos`` and ``state``, a row for each place."""
    return df.select(*keep, F.posexplode(chars(F.col(seq))).alias("p", "state")).select(*keep, (F.col("p") + 1).alias("pos"), "state")


def differs_only(df: DataFrame, root: Column, seq: str, *keep: str) -> DataFrame:
    """Long form of the places of the root that differ from it: the sparse export.  Places behind the end of either have no state."""
    pairs = F.arrays_zip(chars(F.col(seq)).alias("a"), chars(root).alias("r"))
    at = F.filter(F.transform(pairs, lambda p, i: F.struct((i + 1).alias("pos"), p["a"].alias("state"), p["r"].alias("r"))), lambda s: s["state"] != s["r"])
    return df.select(*keep, F.explode(at).alias("d")).select(*keep, "d.pos", "d.state")


def state_at(diff: Column, root: Column, pos: Column) -> Column:
    """State at a place of a sparse map of differences over the root."""
    return F.coalesce(F.try_element_at(diff, pos), F.substr(root, pos, F.lit(1)))
