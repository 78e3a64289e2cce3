from virosight.plans import lineages


def test_build_of_a_lineage(spark):
    root = "ACGT" * 300
    rows = [("A/Place/1/2014", "2014-01-02", "asia", "cell", root), ("a/place/1/2014", "2014-01-02", "asia", "cell", root), ("A/place/1/2014", "2014-01-03", "asia", "cell", root[:1000])]
    for i in range(40):
        seq = list(root)
        for k in range(i % 5 + 1):
            seq[(17 * k + i) % 900] = "A"
        rows.append((f"A/P/{i}/14", f"2014-02-{i % 28 + 1:02d}", "asia" if i % 2 else "europe", None if i % 3 else "Egg1", "".join(seq)))
    rows += [("X/no", "2014-01-01", "asia", "", root), ("A/short/1/2014", "2014-01-01", "asia", "", "ACGT"), ("A/nodate/1/2014", "2014", "asia", "", root), (None, None, None, None, None)]
    raw = spark.createDataFrame(rows, "strain string, date string, region string, passage string, seq string")
    config = lineages.LINEAGES["h3n2"]
    df = lineages.curated(raw, config)
    names = {r["strain"] for r in df.collect()}
    assert "A/Place/1/2014" in names and "A/place/1/2014" not in names and "A/P/1/2014" in names
    assert not names & {"X/no", "A/short/1/2014", "A/nodate/1/2014", "A/P/0/2014"}
    small = lineages.sampled(df, lineages.LineageConfig("x", 1, per_month=6))
    assert {(r["month"], r["count"]) for r in small.groupBy("month").count().collect()} == {(1, 1), (2, 6)}
    out = lineages.aligned(df, root)
    assert 0 < out.count() <= df.count() and out.select("num_date").distinct().count() == out.count()
