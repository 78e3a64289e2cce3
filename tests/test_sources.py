import json

from virosight.sources import readers, sinks
from virosight.streaming import arrival


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fasta").write_text(">A/X/1/2014|f|E1|2014-01-02|asia|japan||to>kyo|cell|lab\nACGT\nAC\n>A/Y/2|f|E2\nGG\n")
    rows = {r["strain"]: r for r in readers.fasta(spark, str(tmp_path / "a.fasta")).collect()}
    assert rows["A/X/1/2014"]["seq"] == "ACGTAC" and rows["A/X/1/2014"]["country"] == "japan" and rows["A/X/1/2014"]["location"] == "tokyo" and rows["A/Y/2"]["date"] == ""
    assert readers.fasta_plain(spark, str(tmp_path / "a.fasta")).count() == 2


def test_genbank(spark, tmp_path):
    text = 'LOCUS x\nFEATURES             Location/Qualifiers\n     source          1..20\n                     /organism="v"\n     CDS             1..6\n                     /gene="SigPep"\n     CDS             7..12\n                     /gene="Other"\nORIGIN\n        1 acgtac gtacgt\n//\n'
    (tmp_path / "x.gb").write_text(text)
    assert [(r["gene"], r["start"], r["end"], r["origin"]) for r in readers.genbank_cds(spark, str(tmp_path / "x.gb")).collect()] == [("SigPep", 1, 6, "ACGTACGTACGT")]


def test_titer_files(spark, tmp_path):
    (tmp_path / "t.txt").write_text("A/1 A/2 F1 NIMR 160\nA/1 A/2 F1 old 80\n")
    assert [r["titer"] for r in readers.titers_flat(spark, str(tmp_path / "t.txt"), ("old",)).collect()] == [160.0]
    (tmp_path / "t.tsv").write_text("v\tx\tserum\tref\ty\ttiter\tsource\nA/1\t\tF1\tA/2\t\t<40\ts\nA/1\t\tF1\tA/2\t\t320\ts\n")
    assert [(r["test"], r["ref"], r["serum"], r["titer"]) for r in readers.titers_tsv(spark, str(tmp_path / "t.tsv")).collect()] == [("A/1", "A/2", "F1", 320.0)]
    (tmp_path / "m.csv").write_text(",A/Ser,A/Two\n,F1,F2\n,x,y\nREFERENCE,,\nA/Ref/1,160,<40\nTEST,,\nA/New/2,80,40\nnotes,1,2\n")
    wide = ",".join(f"A/S{i}" for i in range(300))
    (tmp_path / "w.csv").write_text(f",{wide}\n,{wide}\n,{wide}\nREFERENCE,\nA/Ref/1,{','.join(['80'] * 300)}\n")
    assert readers.titer_matrix(spark, str(tmp_path / "w.csv")).count() == 300
    got = readers.titer_matrix(spark, str(tmp_path / "m.csv")).collect()
    assert [(r["part"], r["test"], r["raw"]) for r in got] == [("reference", "A/Ref/1", "160"), ("reference", "A/Ref/1", "<40"), ("test", "A/New/2", "80"), ("test", "A/New/2", "40")]


def test_names_of_wide_tables(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("A/Vic/361/11",), ("A/Victoria/ 3/1975",), ("B/HK/8/73",)], "n string")
    got = [r[0] for r in rows.select(readers.matrix_name(F.col("n"), {"Vic": "VICTORIA", "HK": "HONGKONG"})).collect()]
    assert got == ["A/VICTORIA/361/2011", "A/Victoria/3/1975", "B/HONGKONG/8/1973"]


def test_trees(spark, tmp_path):
    (tmp_path / "t.nwk").write_text("(('A/x,(1)':0.1,B:0.2):0.3,C:1e-2)root;")
    rows = {r["strain"]: r for r in readers.newick(spark, str(tmp_path / "t.nwk")).collect()}
    assert rows["A/x,(1)"]["branch_length"] == 0.1 and rows["root"]["parent_id"] is None and rows["C"]["parent_id"] == rows["root"]["node_id"]
    (tmp_path / "t.json").write_text(json.dumps({"xvalue": 0, "children": [{"strain": "a", "xvalue": 0.5, "num_date": "undefined"}, {"strain": "b", "branch_length": 0.2}]}))
    rows = {r["strain"]: r for r in readers.json_tree(spark, str(tmp_path / "t.json")).collect()}
    assert rows["a"]["branch_length"] == 0.5 and rows["a"]["num_date"] is None and rows["b"]["branch_length"] == 0.2


def test_best_record(spark):
    df = spark.createDataFrame([("s", [("AC", "x"), ("AG", None), ("A", None)], [("c1",), ("c2",), ("c3",)])], "strain string, sequences array<struct<sequence:string,accession:string>>, citations array<struct<authors:string>>")
    r = readers.best_record(df).first()
    assert (r["sequence"], r["accession"], r["authors"]) == ("AG", None, "c2")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "ACGT"), (2, "AGGA")], "k int, s string")
    assert [r["diff"] for r in sinks.sequence_differences(df, "ACGT", "s", "k").collect()] == ['{"2":"G","4":"A"}']
    assert sinks.fasta_text(spark.createDataFrame([("x", None, "AC")], "a string, b string, seq string"), ["a", "b"]).first()[0] == ">x|?|\nAC"
    sinks.save_stage(df, str(tmp_path / "st"), "a")
    assert readers.stage(spark, str(tmp_path / "st"), "a").count() == 2


def test_stream_appends_new_rows_once(spark, tmp_path):
    src = str(tmp_path / "in")
    for k in range(2):
        spark.range(k * 15, k * 15 + 20).selectExpr("cast(id as string) as strain").write.mode("append").parquet(src)
        stream = spark.readStream.schema("strain string").parquet(src)
        arrival.append_new(stream, str(tmp_path / "out"), "strain", str(tmp_path / "ck")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out" / "*" / "*"))
    assert out.count() == out.distinct().count() == 35


def test_nested_trees_and_newick_round_trip(spark, tmp_path):
    text = "(('a':0.100000,'b':0.200000)'x':0.300000,'c':0.500000)'r':0.000000;"
    (tmp_path / "t.nwk").write_text(text)
    nodes = readers.newick(spark, str(tmp_path / "t.nwk"))
    assert sinks.newick_text(nodes).first()["value"] == text
    nested = json.loads(sinks.nested_trees(nodes, ("strain", "branch_length")).first()["value"])
    assert nested["strain"] == "r" and [c["strain"] for c in nested["children"]] == ["x", "c"] and [c["strain"] for c in nested["children"][0]["children"]] == ["a", "b"]
    deep = spark.range(3000).selectExpr("'t' as tree_id", "cast(id as int) as node_id", "cast(if(id > 0, id - 1, null) as int) as parent_id", "0 as child_ord", "1D as branch_length", "cast(id as string) as strain")
    assert sinks.nested_trees(deep, ("strain",)).first()["value"].count("children") == 2999


def test_exports(spark, tmp_path):
    effects = spark.createDataFrame([("HA1:A1T", 0.5), ("HA1:G2C", 0.005), ("HA1:C3A", 0.0)], "mutation string, value double")
    counts = spark.createDataFrame([("HA1:A1T", 7)], "mutation string, n long")
    assert [tuple(r) for r in sinks.effects_display(effects, counts).collect()] == [("HA1:A1T", 0.5, 7), ("HA1:G2C", 0.01, 0)]
    assert sinks.effects_table(effects, counts, None).count() == 3 and [r["mutation"] for r in sinks.effects_model(effects).collect()] == ["HA1:A1T"]
    titers = spark.createDataFrame([("r", "c", "s1", 2.0, "t", "x", 160.0), ("r", "c", "s1", 4.0, "u", "x", 80.0), ("r", "c", "s2", 1.0, "t", "x", 40.0)], "ref string, clade string, serum string, norm double, test string, source string, titer double")
    assert sinks.titers_by_clade(titers).first()["titers"] == {"s1": 3.0, "s2": 1.0}
    known = spark.createDataFrame([("t",), ("r",)], "strain string")
    assert sorted(r[0] for r in sinks.flat_titers(titers, known).collect()) == ["t\tr\ts1\tx\t160.0", "t\tr\ts2\tx\t40.0"]
    seqs = spark.createDataFrame([("t", 2, "AC"), ("t", 1, "GG"), ("z", 1, "TT")], "name string, o int, seq string")
    assert [tuple(r) for r in sinks.sequences_with_titers(seqs, titers, "name", ["o"]).collect()] == [("t", 1, "GG")]
    model = spark.createDataFrame([("serum:s1", 1.0), ("virus:t", 2.0), ("effect:e", 3.0)], "col string, value double")
    assert [tuple(r) for r in sinks.model_terms(model, "virus").collect()] == [("t", 2.0)]
    path = str(tmp_path / "up")
    for day, n in (("a", 1), ("b", 2), ("a", 3)):
        sinks.upsert_partition(spark.createDataFrame([(day, n)], "day string, n int"), path, ["day"])
    assert sorted((r["day"], r["n"]) for r in spark.read.parquet(path).collect()) == [("a", 3), ("b", 2)]
    curves = spark.createDataFrame([("EU", "x", 2001.0, 0.25), ("EU", "x", 2000.0, 0.12345)], "region string, feature string, pivot double, freq double")
    assert json.loads(sinks.frequencies_json(curves).first()["value"]) == {"key": "EU_x", "pivots": [2000.0, 2001.0], "freq": [0.123, 0.25]}
    nodes = spark.createDataFrame([(1, 0.2), (2, 0.1)], "node_id int, xvalue double")
    members = spark.createDataFrame([("X", 1), ("X", 2)], "clade string, node_id int")
    got = sinks.clade_annotation(nodes, members, trajectories=curves).first()
    assert got["node_id"] == 2 and got["freq"] == [0.123, 0.25]
    cds = spark.createDataFrame([("HA1", 49, 1035)], "gene string, start int, end int")
    assert sinks.gene_places(cds).first()["location"] == [49, 1035]


def test_waiting_rows_are_appended_once_enough_have_come(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    seen = []
    for k in range(3):
        spark.range(k * 6, k * 6 + 7).selectExpr("cast(id as string) as strain").write.mode("append").parquet(src)
        stream = spark.readStream.schema("strain string").parquet(src)
        arrival.append_new(stream, out, "strain", str(tmp_path / "ck")).awaitTermination()
        seen.append((spark.read.schema("strain string").parquet(f"{out}/rows").count(), spark.read.schema("strain string").parquet(f"{out}/pending/batch={k}").count()))
    assert seen == [(0, 7), (13, 0), (13, 6)]


def test_stateful_frequency_by_key(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [("a", i, True) for i in range(50)] + [("b", i, False) for i in range(50)]
    spark.createDataFrame(rows, "k string, i int, obs boolean").selectExpr("k", "timestamp_seconds(1000000 + i) as ts", "obs").write.parquet(src)
    stream = spark.readStream.schema("k string, ts timestamp, obs boolean").parquet(src)
    found = []
    query = arrival.filtered_frequency(stream, "k", "obs", "1 hour").writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "ck"))
    query.foreachBatch(lambda df, _: found.extend(map(tuple, df.collect()))).trigger(availableNow=True).start().awaitTermination()
    last = {k: (n, f) for k, n, f in found}
    assert last["a"][0] == last["b"][0] == 50 and last["a"][1] > 0.9 and last["b"][1] < 0.1


def test_particle_stream_equals_the_filter_over_all_rows(spark, tmp_path):
    import random

    from pyspark.sql import functions as F

    from virosight.operators import frequency

    rng, step, start = random.Random(2), 3_600_000, 1_000_000_000_000
    rows = sorted((start + rng.randrange(80 * step), "ab"[rng.random() < 0.3], rng.random() < 0.8) for _ in range(500))
    rows += [(start + 30 * step, "a", None), (start - 5, "a", True), (start + 200 * step, "z", True)]
    src = str(tmp_path / "in")
    for k in range(4):  # four batches, out of order within 10 steps
        part = [r for r in rows if k * 20 <= (r[0] - start) // step - (r[0] % 2) * 10 < (k + 1) * 20 or (k == 3 and r[0] > start + 100 * step) or (k == 0 and r[0] < start + 10 * step and r[0] % 2)]
        rng.shuffle(part)
        spark.createDataFrame(part, "ms long, k string, obs boolean").selectExpr("k", "timestamp_millis(ms) as ts", "obs").coalesce(1).write.mode("append").parquet(src)
    sent = spark.read.parquet(src)
    found = []
    for _ in range(2):  # a second run finds nothing new and goes on from its state
        stream = spark.readStream.schema("k string, ts timestamp, obs boolean").option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(src)
        query = arrival.particle_stream(stream, "k", "obs", "30 hours", start, step, particles=60).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "ck"))
        query.foreachBatch(lambda df, _: found.extend(map(tuple, df.select("k", F.unix_millis("at"), "freq").collect()))).trigger(availableNow=True).start().awaitTermination()
    years = sent.where("obs is not null").select("k", ((F.unix_millis("ts") - start) / arrival.YEAR).alias("num_date"), "obs").where("k <> 'z'")
    want = frequency.particle_filter(years, ["k"], 0.0, 170 * step / arrival.YEAR, particles=60, dt=step / arrival.YEAR).collect()
    want = {(r["k"], round(r["t"] * arrival.YEAR / step)): r["freq"] for r in want}
    got = {(k, (at - start) // step): f for k, at, f in found if k != "z"}
    assert len(found) == len({f[:2] for f in found}) and len(got) == 34
    assert got == {p: f for p, f in want.items() if p[1] <= 160}
