from pyspark.sql import functions as F

from virosight.functions import dates, numeric, sequences, strings


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_names(spark):
    L = F.lit
    got = one(spark, strings.fix_name(L("A/Place (1)//12/99")), strings.fix_name(L("A/X H3N2/5/07")), strings.fix_name(L("A/Y/2014")), strings.fix_titer_name(L("*A/Z/1/16"), {}), strings.strain_key(L("a/ß/x")))
    assert got == ("A/Place1/12/1999", "A/X/5/2007", "A/Y/2014", "A/Z/1/2016", "A/ß/X")


def test_titers_and_passages(spark):
    L = F.lit
    got = one(spark, *(strings.titer_value(L(x)) for x in ("160", "<40", "160 80", "", "nd")), strings.passage_category(L("mdck2")), strings.passage_category(L("Original")), strings.passage_category(L("Egg3")))
    assert got == (160.0, None, 160.0, None, None, "MDCK", "direct", "Egg3")


def test_genotype_strings(spark):
    L = F.lit
    assert one(spark, strings.genotype_region(L("EU 225D/159S")), strings.genotype_states(L("EU 225D/159S")), strings.genotype_region(L("159S"))) == ("EU", "159S/225D", "global")


def test_dates(spark):
    d = dates.parse_date(F.lit("2013-07-XX"))
    year, back, day = one(spark, dates.decimal_year(d), dates.calendar_date(dates.decimal_year(d)).cast("string"), dates.ordinal(F.lit("0001-01-01").cast("date")))
    assert abs(year - (2013 + 181 / 365.25)) < 1e-12 and back == "2013-07-01" and day == 1
    full, partial, bad = one(spark, *(dates.repaired_date(F.lit(x), F.lit(1), "full") for x in ("2013-11-11", "2013", "x")))
    assert str(full) == "2013-11-11" and partial is None and bad is None
    assert one(spark, F.year(dates.repaired_date(F.lit("2013-XX-XX"), F.lit(1))))[0] == 2013


def test_sequences(spark):
    L = F.lit
    got = one(
        spark, sequences.canonical(L("ACGTNNN")), sequences.canonical(L("ACGTNNNN")), sequences.mask_ambiguous(L("ACRNt")), sequences.mismatch_share(L("AC-T"), L("AGTT")), sequences.mismatch_share(L("--"), L("AC")),
        sequences.translate_codons(L("ATGTAANNN---A")), sequences.mutations(L("ACGT"), L("AGGA")), sequences.differences(L("ACGT"), L("AGGA")), sequences.masked_sites(L("ABCD"), L("0110")), sequences.drop_insertions(L("acgt"), L("A-GT")),
    )
    assert got == (True, False, "AC--t", 1 / 3, None, "M*X-", "C2G,T4A", 2, "BC", "AGT")


def test_numeric(spark):
    got = one(spark, numeric.inverse_logit(numeric.logit(F.lit(0.3))), numeric.clamp_frequency(F.lit(float("nan")), 0.01), numeric.pivots(F.lit(2000.1), F.lit(2000.4), 12))
    assert abs(got[0] - 0.3) < 1e-12 and got[1] == 0.01 and got[2][0] == 24001 / 12 and len(got[2]) == 5


def test_interpolation_extends_by_end_slopes(spark):
    points = spark.createDataFrame([("a", 0.0, 0.0), ("a", 1.0, 2.0), ("a", 3.0, 2.0)], "g string, x double, y double")
    grid = spark.createDataFrame([("a", t) for t in (-1.0, 0.5, 2.0, 4.0)], "g string, at double")
    assert {r["at"]: r["y"] for r in numeric.interpolate(points, grid, "x", "y", ["g"]).collect()} == {-1.0: -2.0, 0.5: 1.0, 2.0: 2.0, 4.0: 2.0}
