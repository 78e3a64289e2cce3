"""Registered queries of trees, designs, trajectories, predictions and interactive views, on the stand-ins of ``catalogue``."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from virosight.functions import dates, numeric, sequences, strings
from virosight.operators import ancestral, antigenic, curate, explore, frequency, prediction, seasons, series, sites, titer, trajectories, tree
from virosight.plans.catalogue import _DAILY, _SAMPLES, _TITERS, _TREE, _YEARS, _daily, node_table, query, samples, table, titers
from virosight.session import few, saved
from virosight.sources import readers

# Trees

_PATHS = """ranked AS (SELECT *, row_number() OVER (PARTITION BY parent_id ORDER BY child_ord, node_id) AS seat FROM tree),
paths AS (SELECT node_id, [0] AS path FROM ranked WHERE parent_id IS NULL UNION ALL SELECT r.node_id, list_append(p.path, r.seat) FROM ranked r
JOIN paths p ON r.parent_id = p.node_id),
spans AS (SELECT node_id, row_number() OVER (ORDER BY path) - 1 AS pre,
row_number() OVER (ORDER BY list_append(path, 1000000000)) - 1 AS post, len(path) - 1 AS depth FROM paths)"""


@query(f"""WITH RECURSIVE {_TREE}, {_PATHS}, n AS (SELECT ancestor AS node_id, count(*) AS n FROM closure GROUP BY 1)
SELECT node_id, pre, pre + n - 1 AS last, post, depth FROM spans JOIN n USING (node_id)""")
def tree_intervals(spark, sf_dir):
    return tree.intervals(node_table(spark, sf_dir)).drop("root")


@query(f"WITH RECURSIVE {_TREE} SELECT ancestor AS node_id, count(*) FILTER (node >= 1000) AS n_tips FROM closure GROUP BY ancestor")
def tree_interval_counts(spark, sf_dir):
    nodes = node_table(spark, sf_dir)
    return tree.subtree_counts(tree.intervals(nodes), nodes.select("node_id", (F.col("node_id") >= 1000).cast("int").alias("v")), "v", "n_tips")


@query(f"""WITH RECURSIVE {_TREE}, kept AS (SELECT * FROM tree WHERE NOT (node_id BETWEEN 100 AND 999 AND branch_length < 0.1)),
up AS (SELECT k.node_id, k.child_ord, k.branch_length, min_by(c.ancestor, c.steps) AS parent_id FROM kept k LEFT
JOIN closure c ON c.node = k.node_id AND c.steps > 0 AND c.ancestor IN (SELECT node_id FROM kept) GROUP BY ALL),
line AS (SELECT node_id AS node, node_id AS ancestor, 0 AS steps FROM up UNION ALL SELECT l.node, u.parent_id, l.steps + 1 FROM line l
JOIN up u ON l.ancestor = u.node_id WHERE u.parent_id IS NOT NULL),
below AS (SELECT ancestor AS node_id, round(sum(branch_length), 9) AS b FROM line JOIN up ON node = up.node_id GROUP BY 1),
seats AS (SELECT node_id, parent_id, branch_length, row_number() OVER (PARTITION BY parent_id ORDER BY b DESC, child_ord, node_id) AS seat FROM up
JOIN below USING (node_id)),
paths AS (SELECT node_id, [0] AS path FROM seats WHERE parent_id IS NULL UNION ALL SELECT s.node_id, list_append(p.path, s.seat) FROM seats s
JOIN paths p ON s.parent_id = p.node_id),
x AS (SELECT node AS node_id, sum(branch_length) AS x FROM line JOIN up ON ancestor = up.node_id GROUP BY 1)
SELECT node_id, s.parent_id, row_number() OVER (ORDER BY path) - 1 AS pre, row_number() OVER (ORDER BY list_append(path, 1000000000)) - 1 AS clade,
round(x, 9) AS xvalue,
CASE WHEN node_id NOT IN (SELECT parent_id FROM up WHERE parent_id IS NOT NULL) THEN (count(*) FILTER (node_id NOT IN (SELECT parent_id FROM up
WHERE parent_id IS NOT NULL)) OVER (ORDER BY path))::DOUBLE END AS tip_y
FROM seats s JOIN paths USING (node_id) JOIN x USING (node_id)""")
def tree_refine(spark, sf_dir):
    nodes = node_table(spark, sf_dir)
    out = tree.refine(nodes, F.col("node_id").between(100, 999) & (F.col("branch_length") < 0.1))
    inner = out.select(F.col("parent_id").alias("node_id")).distinct().withColumn("inner", F.lit(True))
    tip_y = F.when(F.col("inner").isNull(), F.col("yvalue"))
    return out.join(inner, "node_id", "left").select("node_id", "parent_id", "pre", "clade", F.round("xvalue", 9).alias("xvalue"), tip_y.alias("tip_y"))


_LAST = f"last AS (SELECT (1000 + o_custkey)::INT AS node_id, max({_YEARS}) AS num_date FROM orders GROUP BY 1)"


def _last_orders(spark, sf_dir):
    """Tips with the decimal date of their last order."""
    year = dates.decimal_year(F.col("o_orderdate"))
    return table(spark, sf_dir, "orders").groupBy((1000 + F.col("o_custkey")).cast("int").alias("node_id")).agg(F.max(year).alias("num_date"))


@query(f"""WITH RECURSIVE {_TREE}, {_LAST}, held AS (SELECT DISTINCT ancestor FROM closure JOIN last ON node = node_id
WHERE num_date >= 1998.5 AND num_date < 1998.55)
SELECT node_id, node_id IN (SELECT ancestor FROM held) AS alive FROM tree""")
def tree_alive(spark, sf_dir):
    nodes = node_table(spark, sf_dir)
    return tree.alive_in_window(nodes, tree.intervals(nodes), _last_orders(spark, sf_dir), "num_date", 1998.5, 1998.55)


@query(f"""WITH RECURSIVE {_TREE} SELECT ancestor AS node_id, min(child_ord % 97)::INT AS v FROM closure JOIN tree ON node = node_id
WHERE node >= 1000 GROUP BY 1""")
def tree_fill_from_children(spark, sf_dir):
    nodes = node_table(spark, sf_dir)
    return tree.fill_from_children(nodes, nodes.where("node_id >= 1000").select("node_id", (F.col("child_ord") % 97).alias("v")), "v", "min")


@query(f"""WITH RECURSIVE {_TREE} SELECT node_id, d AS choice_date, CASE WHEN node_id BETWEEN 1 AND 99 THEN 'region ' || node_id END AS label
FROM tree LEFT JOIN (SELECT o_custkey % 5000 AS k, min(o_orderdate)::DATE AS d FROM orders
WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 300000 GROUP BY 1) ON node_id = 1000 + k""")
def tree_choices(spark, sf_dir):
    nodes = node_table(spark, sf_dir).withColumn("strain", F.concat(F.lit("C"), (F.col("node_id") - 1000).cast("string")))
    big = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT' and o_totalprice > 300000")
    chosen = big.select(F.concat(F.lit("C"), (F.col("o_custkey") % 5000).cast("string")).alias("strain"), F.to_date("o_orderdate").alias("choice_date"))
    labels = nodes.where("node_id between 1 and 99").select("node_id", F.concat(F.lit("region "), F.col("node_id").cast("string")).alias("label"))
    return tree.mark_choices(nodes, chosen, labels).select("node_id", "choice_date", "label")


@query(f"""WITH RECURSIVE {_TREE}, {_LAST}, tips AS (SELECT node_id, 1998.6 - num_date AS age FROM last), held AS (SELECT ancestor AS node_id,
count(*) FILTER (age > 0 AND age < 0.5) AS n, count(*) FILTER (age > 0.5 AND age < 1.0) AS m FROM closure JOIN tips ON node = tips.node_id
GROUP BY 1),
f AS (SELECT tree.node_id, coalesce(n, 0) AS n, coalesce(n, 0) / (SELECT greatest(max(n), 1) FROM held) AS freq,
coalesce(m, 0) / (SELECT greatest(max(m), 1) FROM held) AS before FROM tree LEFT JOIN held USING (node_id))
SELECT node_id, n, round(freq, 8) AS freq, round((freq + 0.01) / (before + 0.01), 6) AS dfreq FROM f""")
def date_slider(spark, sf_dir):
    nodes = node_table(spark, sf_dir)
    out = explore.slide(nodes, tree.intervals(nodes), _last_orders(spark, sf_dir), 1998.6, 0.5)
    return out.select("node_id", "n", F.round("freq", 8).alias("freq"), F.round("dfreq", 6).alias("dfreq"))


@query(f"""WITH RECURSIVE {_TREE}, {_LAST} SELECT c.ancestor AS node_id, round(max(num_date), 6) AS newest, round(min(num_date), 6) AS oldest
FROM closure c JOIN last ON c.node = last.node_id GROUP BY 1""")
def tree_newest_and_oldest(spark, sf_dir):
    closure = tree.ancestors(node_table(spark, sf_dir))
    out = tree.subtree(closure, _last_orders(spark, sf_dir), "node_id", F.max("num_date").alias("newest"), F.min("num_date").alias("oldest"))
    return out.select("node_id", F.round("newest", 6).alias("newest"), F.round("oldest", 6).alias("oldest"))


# Places, records, filters

_CUSTOMER_NATION = """c AS (SELECT c_custkey, 'A/' || n_name || '/' || c_custkey || '/2014' AS strain, n_name, r_name FROM customer
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


@query(f"""WITH {_CUSTOMER_NATION} SELECT c_custkey, CASE WHEN n_name < 'K' THEN replace(lower(n_name), ' ', '_') ELSE 'Unknown' END AS country, CASE
WHEN n_name < 'K' THEN replace(lower(r_name), ' ', '_') ELSE 'Unknown' END AS region FROM c""")
def place_lookup(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    known = nation.where("n_name < 'K'")
    strain = F.concat(F.lit("A/"), "n_name", F.lit("/"), F.col("c_custkey").cast("string"), F.lit("/2014")).alias("strain")
    rows = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", strain)
    synonyms = known.select(F.col("n_name").alias("label"), F.col("n_name").alias("country"))
    regions = known.select(F.col("n_name").alias("country"), F.col("r_name").alias("region"))
    return curate.place_lookup(rows, "strain", synonyms, regions).select("c_custkey", "country", "region")


@query("SELECT doc_id, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)")
def attribute_transfer(spark, sf_dir):
    return curate.transfer(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id", ["quality", "toxic"])


@query("SELECT source, quality, count(*) AS n FROM documents JOIN labels USING (doc_id) WHERE toxic = 0 AND lang = 'en' GROUP BY ALL")
def conditional_counts(spark, sf_dir):
    both = table(spark, sf_dir, "documents").select("doc_id", "source", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    return curate.conditional_counts(both, (F.col("toxic") == 0) & (F.col("lang") == "en"), ["source", "quality"])


@query(f"""WITH {_SAMPLES} SELECT id, region FROM samples
WHERE region IN ('ASIA', 'EUROPE') AND {_YEARS.replace('o_orderdate', 'date')} >= 1995.25 AND {_YEARS.replace('o_orderdate', 'date')} < 1996.5""")
def interval_restriction(spark, sf_dir):
    rows = samples(spark, sf_dir).withColumn("num_date", dates.decimal_year(F.col("date")))
    return curate.interval_filter(rows, ["ASIA", "EUROPE"], 1995.25, 1996.5).select("id", "region")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '2-HIGH'")
def attribute_restriction(spark, sf_dir):
    return curate.attribute_filter(table(spark, sf_dir, "orders"), {"o_orderstatus": "F", "o_orderpriority": "2-HIGH", "o_custkey": "all"}).select("o_orderkey")


# Series


@query(f"""WITH {_DAILY} SELECT event_type, count(f) AS n, round(max(f), 6) AS top, round(avg(f), 6) AS mean, round(stddev_pop(f), 6) AS deviation
FROM daily GROUP BY 1""")
def interval_statistics(spark, sf_dir):
    out = series.interval_statistics(_daily(spark, sf_dir), ["event_type"], "f")
    return out.select("event_type", "n", *(F.round(c, 6).alias(c) for c in ("top", "mean", "deviation")))


@query(f"WITH {_SAMPLES} SELECT region, {', '.join(f'max(length) FILTER (year(date) = {y}) AS y{y}' for y in range(1993, 1998))} FROM samples GROUP BY 1")
def interval_table(spark, sf_dir):
    rows = samples(spark, sf_dir).withColumn("y", F.year("date"))
    out = series.interval_table(rows, ["region"], "y", "length", list(range(1993, 1998)))
    return out.withColumnsRenamed({str(y): f"y{y}" for y in range(1993, 1998)})


@query(f"""WITH {_DAILY}, d AS (SELECT event_type, abs(f - lag(f) OVER (PARTITION BY event_type ORDER BY day)) AS d FROM daily) SELECT event_type,
round(sum(d), 4) AS change FROM d GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3""")
def largest_changes(spark, sf_dir):
    return series.largest_changes(_daily(spark, sf_dir), ["event_type"], "day", "f", 3).select("event_type", F.round("change", 4).alias("change"))


@query("""SELECT event_type, user_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY value DESC, event_id) AS k
FROM events WHERE value IS NOT NULL) WHERE k = 1""")
def best_of_group(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", "user_id", "event_id", "value")
    return series.pick_best(rows, ["event_type", "user_id"], "value", ["event_id"]).select("event_type", "user_id", "value")


@query("""WITH a AS (SELECT user_id % 10 AS g, date_trunc('day', ts)::DATE AS day, count(*) AS n, avg(CASE WHEN event_type = 'error' THEN 1.0
ELSE 0.0 END) AS f FROM events GROUP BY 1, 2),
b AS (SELECT *, avg(n) OVER (PARTITION BY g ORDER BY day ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS m FROM a)
SELECT g, day, round(f - 2 * sqrt(f * (1 - f) / (m + 1)), 6) AS low, round(f + 2 * sqrt(f * (1 - f) / (m + 1)), 6) AS high FROM b""")
def error_band(spark, sf_dir):
    f = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 10).alias("g"), F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.avg((F.col("event_type") == "error").cast("double")).alias("f"))
    return series.band_of_two_errors(f, "f", "n", "day", ["g"]).select("g", "day", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query("SELECT event_id, round(sum(value) OVER (ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5, 6) AS smooth FROM events")
def padded_average(spark, sf_dir):
    out = series.running_average(table(spark, sf_dir, "events").select("event_id", "ts", "value"), "value", ["ts", "event_id"], 5, zero_padded=True)
    return out.select("event_id", F.round("smooth", 6).alias("smooth"))


@query("SELECT l_returnflag, count(*) AS n, round(avg(l_quantity), 6) AS mean, quantile_cont(l_extendedprice, 0.5) AS middle FROM lineitem GROUP BY 1")
def group_summary(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.avg("l_quantity"), 6).alias("mean"), F.median("l_extendedprice").alias("middle"))


@query("""SELECT floor(min(c_acctbal) / 0.5) * 0.5 AS low, ceil(max(c_acctbal) / 0.5) * 0.5 AS high, 3.0::DOUBLE AS step, ceil((ceil(max(c_acctbal) / 0.5) * 0.5 - floor(min(c_acctbal) / 0.5) * 0.5) / 3.0)::INT AS n_bins
FROM customer""")
def colour_domain(spark, sf_dir):
    return explore.domain(table(spark, sf_dir, "customer"), "c_acctbal")


@query("SELECT c_custkey, c_acctbal > 100 AND c_acctbal <= 2500 AS inside FROM customer")
def legend_match(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", explore.legend_match(F.col("c_acctbal"), 100.0, 2500.0).alias("inside"))


@query("SELECT c_custkey AS node_id, c_name AS strain FROM customer WHERE contains(lower(c_name), '00042')")
def strain_search(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node_id"), F.col("c_name").alias("strain"))
    return explore.search_strains(rows, "00042")


# Functions


@query("""SELECT o_orderkey, (o_orderdate::DATE - DATE '1992-01-01') / 365.25::DOUBLE AS years, o_orderdate::DATE + round(1.5::DOUBLE * 365.25)::INT AS later, (o_orderdate::DATE - DATE '1970-01-01') + 719163 AS ordinal
FROM orders""")
def date_arithmetic(spark, sf_dir):
    day = F.to_date("o_orderdate")
    start = F.lit("1992-01-01").cast("date")
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.year_difference(day, start).alias("years"), dates.add_years(day, 1.5).alias("later"), dates.ordinal(day).alias("ordinal"))


@query("""SELECT l_orderkey, l_linenumber, round(ln(greatest(x, 1e-10) / greatest(1 - x, 1e-10)), 6) AS logit,
round(exp(greatest(least(y, 7.0), -7.0)) / (1 + exp(greatest(least(y, 7.0), -7.0))), 6) AS back, greatest(least(x, 0.95), 0.05) AS clamped
FROM (SELECT l_orderkey, l_linenumber, l_discount * 10 AS x, l_quantity - 25 AS y FROM lineitem)""")
def frequency_transforms(spark, sf_dir):
    x, y = F.col("l_discount") * 10, F.col("l_quantity") - 25
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(numeric.logit(x), 6).alias("logit"), F.round(numeric.inverse_logit(y), 6).alias("back"), numeric.clamp_frequency(x, 0.05).alias("clamped")
    )


_NUC = "translate(lower(text), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC')"


@query(f"""WITH b AS (SELECT item_id, regexp_replace({_NUC}, '[^ACGT]', '', 'g') AS nuc FROM benchmark),
c AS (SELECT item_id, nuc, unnest(range(0, length(nuc) // 3)) AS i FROM b),
p AS (SELECT item_id, i, substring('FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG', 16 * (strpos('TCAG', substring(nuc, 3 * i + 1, 1)) - 1) + 4 * (strpos('TCAG', substring(nuc, 3 * i + 2, 1)) - 1) + strpos('TCAG', substring(nuc, 3 * i + 3, 1)), 1) AS aa
FROM c)
SELECT item_id, string_agg(aa, '' ORDER BY i) AS protein FROM p GROUP BY 1""")
def translated_codons(spark, sf_dir):
    nuc = F.regexp_replace(F.translate(F.lower("text"), "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC"), "[^ACGT]", "")
    return table(spark, sf_dir, "benchmark").select("item_id", sequences.translate_codons(nuc).alias("protein"))


@query("""WITH r AS (SELECT regexp_extract_all(text, '(?s).') AS r FROM benchmark ORDER BY item_id LIMIT 1),
d AS (SELECT item_id, regexp_extract_all(text, '(?s).') AS w FROM benchmark)
SELECT item_id, array_to_string([r[i] || i || w[i] FOR i IN range(1, 1 + least(len(r), len(w))) IF r[i] <> w[i]], ',') AS muts, len([i FOR i IN range(1, 1 + least(len(r), len(w))) IF r[i] <> w[i]])::INT AS n
FROM d, r""")
def mutation_strings(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark")
    rows = items.join(F.broadcast(items.agg(F.min_by("text", "item_id").alias("r"))))
    return rows.select("item_id", sequences.mutations(F.col("r"), F.col("text")).alias("muts"), sequences.differences(F.col("r"), F.col("text")).alias("n"))


@query("""SELECT c_custkey, CASE WHEN c_nationkey < 7 THEN 'EU'
ELSE 'global' END AS region, (c_nationkey % 9 + 1) || 'K/' || (c_nationkey + 100) || 'S' AS states FROM customer""")
def genotype_parse(spark, sf_dir):
    text = F.concat(F.when(F.col("c_nationkey") < 7, F.lit("EU ")).otherwise(F.lit("")), (F.col("c_nationkey") + 100).cast("string"), F.lit("S/"), (F.col("c_nationkey") % 9 + 1).cast("string"), F.lit("K"))
    return table(spark, sf_dir, "customer").select("c_custkey", strings.genotype_region(text).alias("region"), strings.genotype_states(text).alias("states"))


@query("""SELECT item_id, CASE WHEN length(text) > 50 THEN substring(text, 1, 45) || '...'
ELSE text END AS label, translate(substring(text, 1, 30), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS k FROM benchmark""")
def labels_and_keys(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", strings.branch_label(F.col("text")).alias("label"), strings.strain_key(F.substring("text", 1, 30)).alias("k"))


# Trajectories

_GENES = """g AS (SELECT o_orderkey, 'G' AS gene, unnest([1, 2, 3]) AS pos, unnest([o_orderstatus, substring(o_orderpriority, 1, 1), (o_orderkey % 3)::VARCHAR]) AS state, o_custkey % 2 AS region,
(floor((year(o_orderdate) + (dayofyear(o_orderdate) - 1) / 365.25::DOUBLE) * 100) + 0.5) / 100 AS t FROM orders)"""


def _gene_sites(spark, sf_dir):
    """Orders as samples of a gene of three places, by two regions."""
    states = F.array(F.struct(F.lit(1).alias("pos"), F.col("o_orderstatus").alias("state")), F.struct(F.lit(2).alias("pos"), F.substring("o_orderpriority", 1, 1).alias("state")), F.struct(F.lit(3).alias("pos"), (F.col("o_orderkey") % 3).cast("string").alias("state")))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 2).alias("region"), dates.decimal_year(F.col("o_orderdate")).alias("num_date"), F.explode(states).alias("s"))
    return rows.select("o_orderkey", "region", "num_date", F.lit("G").alias("gene"), "s.pos", "s.state")


def _gene_freqs(spark, sf_dir):
    return sites.site_frequencies(_gene_sites(spark, sf_dir), by=["gene"]).select("gene", "pos", "state", "freq")


_STATES = """w AS (SELECT pos, state FROM (SELECT pos, state, count(*) / sum(count(*)) OVER (PARTITION BY pos) AS f FROM g GROUP BY 1, 2)
WHERE f > 0.1 AND f < 0.9)"""


@query(f"""WITH {_GENES}, {_STATES}, n AS (SELECT region, pos, t, count(*) AS n FROM g GROUP BY ALL), y AS (SELECT region, pos, state, t,
count(*) AS y FROM g GROUP BY ALL)
SELECT n.region, n.pos, w.state, round(n.t, 3) AS t, coalesce(y, 0) AS yes, n FROM n JOIN w USING (pos) LEFT
JOIN y ON y.region = n.region AND y.pos = n.pos AND y.t = n.t AND y.state = w.state""")
def mutation_bins(spark, sf_dir):
    wanted = trajectories.between(_gene_freqs(spark, sf_dir), 0.1)
    out = trajectories.mutation_bins(_gene_sites(spark, sf_dir), wanted, ["region"])
    return out.select("region", "pos", "state", F.round("_t", 3).alias("t"), F.col("_yes").alias("yes"), F.col("_n").alias("n"))


@query(f"""WITH {_GENES}, {_STATES}, v AS (SELECT g.* FROM g JOIN w USING (pos, state)),
p AS (SELECT a.region, a.t, a.pos AS p, b.pos AS q, a.state AS s, b.state AS u FROM v a JOIN v b USING (o_orderkey) WHERE a.pos < b.pos),
y AS (SELECT region, p, q, s, u, t, count(*) AS y FROM p GROUP BY ALL), n AS (SELECT region, p, q, t, sum(y) AS n FROM y GROUP BY ALL),
k AS (SELECT DISTINCT region, p, q, s, u FROM y)
SELECT region, 'G:' || p || s || '/G:' || q || u AS feature, round(t, 3) AS t, coalesce(y, 0)::BIGINT AS yes, n::BIGINT AS n FROM n
JOIN k USING (region, p, q) LEFT JOIN y USING (region, p, q, s, u, t)""")
def genotype_pair_bins(spark, sf_dir):
    wanted = trajectories.between(_gene_freqs(spark, sf_dir), 0.1)
    out = trajectories.pair_bins(_gene_sites(spark, sf_dir), wanted, "o_orderkey", ["region"])
    return out.select("region", "feature", F.round("_t", 3).alias("t"), F.col("_yes").alias("yes"), F.col("_n").alias("n"))


def _designations(spark):
    return spark.createDataFrame([("a", "G", 1, "F"), ("a", "G", 3, "0"), ("b", "G", 2, "2"), ("c", "G", 1, "O"), ("c", "G", 2, "5"), ("c", "G", 3, "1")], "clade string, gene string, pos int, aa string")


_CLADES = """m AS (SELECT 'a' AS clade, o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 3 = 0 UNION ALL SELECT 'b', o_orderkey
FROM orders WHERE o_orderpriority[1] = '2'
UNION ALL SELECT 'c', o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority[1] = '5' AND o_orderkey % 3 = 1)"""


@query(f"WITH {_CLADES} SELECT * FROM m")
def clade_members(spark, sf_dir):
    return trajectories.clade_members(_gene_sites(spark, sf_dir), _designations(spark), "o_orderkey")


@query(f"""WITH {_CLADES}, o AS (SELECT o_orderkey, o_custkey % 2 AS region, (floor(({_YEARS}) * 100) + 0.5) / 100 AS t FROM orders),
n AS (SELECT region, t, count(*) AS n FROM o GROUP BY ALL), y AS (SELECT clade, region, t, count(*) AS y FROM o JOIN m USING (o_orderkey)
GROUP BY ALL)
SELECT region, clade, round(t, 3) AS t, coalesce(y, 0) AS yes, n FROM n CROSS JOIN (SELECT DISTINCT clade FROM m) LEFT JOIN y USING (clade, region, t)""")
def clade_bins(spark, sf_dir):
    s = _gene_sites(spark, sf_dir)
    members = trajectories.clade_members(s, _designations(spark), "o_orderkey")
    out = trajectories.clade_bins(s.select("o_orderkey", "region", "num_date").distinct(), members, "o_orderkey", ["region"])
    return out.select("region", "clade", F.round("_t", 3).alias("t"), F.col("_yes").alias("yes"), F.col("_n").alias("n"))


@query()
def mutation_trajectories(spark, sf_dir):
    return trajectories.mutation_trajectories(_gene_sites(spark, sf_dir), _gene_freqs(spark, sf_dir), ["region"], 1992.0, 1999.0, 0.1, per_year=6)


@query()
def genotype_trajectories(spark, sf_dir):
    return trajectories.genotype_trajectories(_gene_sites(spark, sf_dir), _gene_freqs(spark, sf_dir), "o_orderkey", ["region"], 1992.0, 1999.0, 0.15, per_year=3)


@query()
def clade_trajectories(spark, sf_dir):
    s = _gene_sites(spark, sf_dir)
    members = trajectories.clade_members(s, _designations(spark), "o_orderkey")
    return trajectories.clade_trajectories(s.select("o_orderkey", "region", "num_date").distinct(), members, "o_orderkey", ["region"], 1992.0, 1999.0, per_year=6)


def _tree_tips(spark, sf_dir):
    return _last_orders(spark, sf_dir).withColumn("region", F.lit("global"))


@query()
def nested_clade_frequencies(spark, sf_dir):
    nodes = node_table(spark, sf_dir)
    return frequency.tree_frequencies(nodes, tree.ancestors(nodes), _tree_tips(spark, sf_dir), 1997.0, 1999.0, per_year=6)


@query()
def censored_slopes(spark, sf_dir):
    nodes = node_table(spark, sf_dir)
    return trajectories.censored_slopes(nodes, tree.ancestors(nodes), _tree_tips(spark, sf_dir), [(1997, 1997.0, 1998.0), (1998, 1998.0, 1999.0)], per_year=6)


@query()
def particle_frequencies(spark, sf_dir):
    obs = samples(spark, sf_dir).select("region", dates.decimal_year(F.col("date")).alias("num_date"), F.col("priority").alias("obs"))
    return frequency.particle_filter(obs, ["region"], 1996.0, 1998.0)


# Antigenic models

_TREE_TITERS = """tt AS (SELECT l_orderkey * 10 + l_linenumber AS row_id, min((1000 + o_custkey)::INT) AS test, min((100 + s_nationkey)::INT) AS ref, min(l_suppkey) AS serum
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1)"""


def _tree_titers(spark, sf_dir):
    """Line items as titers of customers against their suppliers' nations, which are nodes of the tree."""
    t = lambda name: table(spark, sf_dir, name)
    places = t("supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    known = few(places)
    lines = t("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey").join(places if known is None else known, "l_suppkey")
    rows = lines.join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    # Line numbers repeat; a row id stands for one titer.  Where they have one digit, it names the order and the line, and rows of an order are together already.
    row_id = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    one_digit = t("lineitem").where("l_linenumber < 0 or l_linenumber > 9").isEmpty()
    once = rows.groupBy("l_orderkey", "l_linenumber") if one_digit else rows.groupBy(row_id.alias("row_id"))
    out = once.agg(F.min((1000 + F.col("o_custkey")).cast("int")).alias("test"), F.min((100 + F.col("s_nationkey")).cast("int")).alias("ref"), F.min("l_suppkey").alias("serum"))
    return out.select(row_id.alias("row_id") if one_digit else "row_id", "test", "ref", "serum")


@query(f"""WITH RECURSIVE {_TREE}, {_TREE_TITERS}, measured AS (SELECT test AS m FROM tt UNION SELECT ref FROM tt),
cls AS (SELECT ancestor AS node_id, min(node) || ':' || count(*) AS c FROM closure JOIN measured ON node = m GROUP BY 1 HAVING count(*) > 1),
u AS (SELECT test, ref, ancestor, 1 AS s FROM (SELECT DISTINCT test, ref FROM tt) JOIN closure ON node = test UNION ALL SELECT test, ref, ancestor, 2
FROM (SELECT DISTINCT test, ref FROM tt) JOIN closure ON node = ref),
path AS (SELECT DISTINCT test, ref, c FROM (SELECT test, ref, ancestor FROM u GROUP BY ALL HAVING count(*) = 1) JOIN cls ON ancestor = node_id),
n AS (SELECT serum, count(*) AS n FROM tt GROUP BY 1), w AS (SELECT tt.*, sqrt(1 / (1 + 0.2 * n)) AS w FROM tt JOIN n USING (serum))
SELECT row_id, 'effect:' || c AS col, round(w, 9) AS w FROM w JOIN path USING (test, ref) UNION ALL SELECT row_id, 'serum:' || serum, round(w, 9)
FROM w WHERE test <> ref UNION ALL SELECT row_id, 'virus:' || test, round(w, 9) FROM w""")
def tree_path_design(spark, sf_dir):
    return antigenic.tree_path_design(node_table(spark, sf_dir), _tree_titers(spark, sf_dir)).withColumn("w", F.round("w", 9))


@query("""WITH p AS (SELECT DISTINCT l_partkey AS test, (l_suppkey * 7) % 50 AS ref, l_partkey % 13 AS k FROM lineitem),
t AS (SELECT l_partkey AS test, (l_suppkey * 7) % 50 AS ref, l_suppkey AS serum, l_orderkey * 10 + l_linenumber AS row_id FROM lineitem),
e AS (SELECT DISTINCT row_id, 'HA1:A' || (k + 100) || 'T' AS effect FROM t JOIN p USING (test, ref)), f AS (SELECT row_id, effect FROM e
WHERE effect IN (SELECT effect FROM e GROUP BY 1 HAVING count(*) > 450)),
n AS (SELECT serum, count(*) AS n FROM t GROUP BY 1), w AS (SELECT t.*, sqrt(1 / (1 + 0.2 * n)) AS w FROM t JOIN n USING (serum))
SELECT row_id, 'effect:' || effect AS col, round(w, 9) AS w FROM w JOIN f USING (row_id) UNION ALL SELECT row_id, 'serum:' || serum, round(w, 9)
FROM w WHERE test <> ref UNION ALL SELECT row_id, 'virus:' || test, round(w, 9) FROM w""")
def mutation_design(spark, sf_dir):
    t = titers(spark, sf_dir)
    name = F.concat(F.lit("A"), (F.col("test") % 13 + 100).cast("string"), F.lit("T")).alias("mutation")
    pairs = t.select("test", "ref", F.lit("HA1").alias("gene"), name).distinct()
    return antigenic.mutation_design(t, pairs, 450).withColumn("w", F.round("w", 9))


@query(f"""WITH {_TITERS} SELECT test, ref, count(*) AS n FROM t WHERE test IN (SELECT p_partkey FROM part
WHERE p_size < 30) AND ref IN (SELECT p_partkey FROM part WHERE p_size < 30) GROUP BY ALL""")
def known_titers(spark, sf_dir):
    known = table(spark, sf_dir, "part").where("p_size < 30").select(F.col("p_partkey").alias("strain"))
    return antigenic.known_rows(titers(spark, sf_dir), known).groupBy("test", "ref").agg(F.count("*").alias("n"))


def _cluster_entries(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 500).alias("row_id"), (F.col("l_suppkey") % 40).alias("col"))


@query()
def collinear_clusters(spark, sf_dir):
    e = saved(_cluster_entries(spark, sf_dir).distinct())
    return antigenic.collinear_clusters(e.select("col").distinct().withColumn("place", F.col("col")), titer.colinear(e, 60))


@query("""SELECT source, distance, count(*) AS n, round(corr(y, x), 6) AS r
FROM (SELECT l_returnflag AS source, l_quantity AS y, unnest(['price', 'tax']) AS distance, unnest([l_extendedprice, l_tax]) AS x FROM lineitem)
GROUP BY ALL""")
def distance_correlations(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("source"), "l_quantity", F.col("l_extendedprice").alias("price"), F.col("l_tax").alias("tax"))
    return antigenic.distance_correlations(li, "l_quantity", ["price", "tax"], ["source"]).withColumn("r", F.round("r", 6))


@query(f"""WITH {_SAMPLES}, s AS (SELECT region, regr_count(y, x) AS n, regr_slope(y, x) AS slope, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy
FROM (SELECT region, {_YEARS.replace('o_orderdate', 'date')} AS x, length / 1e5 AS y FROM samples) GROUP BY 1)
SELECT region, n::BIGINT AS n, round(slope, 6) AS slope, round(sqrt(greatest(syy - slope * slope * sxx, 0) / (n - 2) / sxx), 6) AS error FROM s""")
def trunk_regression(spark, sf_dir):
    rows = samples(spark, sf_dir).select("region", dates.decimal_year(F.col("date")).alias("x"), (F.col("length") / 1e5).alias("y"))
    out = antigenic.trunk_regression(rows, "x", "y", ["region"])
    return out.select("region", "n", F.round("slope", 6).alias("slope"), F.round("error", 6).alias("error"))


@query(f"""WITH {_SAMPLES}, c AS (SELECT region AS feature, year(date) AS p, count(*) AS n FROM samples GROUP BY ALL),
f AS (SELECT feature, p, n / sum(n) OVER (PARTITION BY p) AS freq FROM c),
i AS (SELECT feature, min_by(freq, p) AS initial FROM f GROUP BY 1), e AS (SELECT r_name AS feature, r_regionkey * 0.2 AS value FROM region)
SELECT feature, p::INT AS "pivot", round(freq, 6) AS freq FROM f JOIN i USING (feature) JOIN e USING (feature) WHERE value > 0.3 AND initial < 0.25""")
def large_effect_trajectories(spark, sf_dir):
    counts = samples(spark, sf_dir).groupBy(F.col("region").alias("feature"), F.year("date").alias("pivot")).agg(F.count("*").alias("n"))
    freqs = counts.withColumn("freq", F.col("n") / F.sum("n").over(Window.partitionBy("pivot"))).select("feature", "pivot", "freq")
    effects = table(spark, sf_dir, "region").select(F.col("r_name").alias("feature"), (F.col("r_regionkey") * 0.2).alias("value"))
    return antigenic.large_effects(effects, freqs).select("feature", "pivot", F.round("freq", 6).alias("freq"))


def _fit_rows(spark, sf_dir):
    rows = titers(spark, sf_dir).select((F.col("test") % 30).alias("test"), (F.col("ref") % 30).alias("ref"), (F.col("serum") % 30).alias("serum"), "titer", "row_id")
    return titer.design(rows, rows.select("row_id", (F.abs(F.col("test") - F.col("ref")) % 8).alias("effect"))), rows.withColumn("y", F.log2("titer"))


@query()
def effect_fits(spark, sf_dir):
    entries, rows = _fit_rows(spark, sf_dir)
    entries = saved(entries)
    out = None
    for method in antigenic.METHODS:
        own = antigenic.fit_effects(entries, rows, "y", method).withColumn("method", F.lit(method))
        out = own if out is None else out.unionByName(own)
    return out


@query()
def penalty_scan(spark, sf_dir):
    entries, rows = _fit_rows(spark, sf_dir)
    return antigenic.scan_penalties(saved(entries), rows, "y", [(g, s, 0.3) for g in (0.1, 1.0, 10.0) for s in (0.3, 3.0)])


@query()
def reciprocal_cliques(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 60).alias("test"), (F.col("l_suppkey") % 60).alias("ref"), F.col("l_quantity").alias("norm")).where("norm > 40 and test <> ref")
    return antigenic.maximal_cliques(titer.reciprocal(li).select(F.col("test").alias("a"), F.col("ref").alias("b")), 3)


# Seasons, predictions


@query()
def predictor_table(spark, sf_dir):
    nodes = node_table(spark, sf_dir)
    tips = series.interval_join(_last_orders(spark, sf_dir), spark.createDataFrame([(1997, 1997.75, 1998.25), (1998, 1998.25, 1998.75)], "season int, a double, b double"), "num_date", "a", "b").select("node_id", "season", "num_date")
    scores = nodes.select("node_id", (F.col("child_ord") % 7).alias("ep"), F.col("branch_length").alias("tol"))
    return prediction.evaluate(prediction.Context(nodes, tips, scores, tau=0.01, seasons=[1997, 1998]), ["lb", "ep", "tol"])


_STATE_YEARS = """x AS (SELECT year(o_orderdate)::INT AS y, unnest([1, 2]) AS pos, unnest([o_orderstatus, substring(o_orderpriority, 1, 1)]) AS state, o_orderkey, o_totalprice / 1e6 AS score
FROM orders)"""


def _state_years(spark, sf_dir):
    states = F.array(F.struct(F.lit(1).alias("pos"), F.col("o_orderstatus").alias("state")), F.struct(F.lit(2).alias("pos"), F.substring("o_orderpriority", 1, 1).alias("state")))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.year("o_orderdate").alias("y"), (F.col("o_totalprice") / 1e6).alias("score"), F.explode(states).alias("s"))
    return rows.select("o_orderkey", "y", "score", "s.pos", "s.state")


@query(f"""WITH {_STATE_YEARS}, p AS (SELECT y, pos, state, sum(exp(score)) / sum(sum(exp(score))) OVER (PARTITION BY y, pos) AS p FROM x
GROUP BY 1, 2, 3), f AS (SELECT y - 1 AS y, pos, state, count(*) / sum(count(*)) OVER (PARTITION BY y, pos) AS f FROM x GROUP BY x.y, pos, state),
d AS (SELECT y, sum(f * (1 - f)) AS d FROM f GROUP BY 1), e AS (SELECT p.y, sum(p * (1 - coalesce(f, 0))) AS e FROM p LEFT
JOIN f ON p.y = f.y AND p.pos = f.pos AND p.state = f.state GROUP BY 1) SELECT y, round(e - d, 6) AS error FROM e JOIN d USING (y)""")
def allele_error(spark, sf_dir):
    rows = _state_years(spark, sf_dir)
    predicted = prediction.predicted_frequencies(rows, "score", ["y"])
    future = sites.site_frequencies(rows, by=["y"]).select((F.col("y") - 1).alias("y"), "pos", "state", "freq")
    return prediction.allele_error(predicted, future, ["y"]).withColumn("error", F.round("error", 6))


@query(f"""WITH {_STATE_YEARS}, p AS (SELECT y, pos, state, sum(exp(score)) / sum(sum(exp(score))) OVER (PARTITION BY y, pos) AS p FROM x GROUP BY 1, 2, 3)
SELECT y, o_orderkey, round(sum(1 - coalesce(p, 0)), 6) AS distance FROM x LEFT JOIN p USING (y, pos, state) GROUP BY 1, 2""")
def predicted_distance(spark, sf_dir):
    rows = _state_years(spark, sf_dir)
    out = prediction.predicted_distance(rows, prediction.predicted_frequencies(rows, "score", ["y"]), "o_orderkey", ["y"])
    return out.withColumn("distance", F.round("distance", 6))


@query("""WITH x AS (SELECT o_orderkey, unnest([1, 2]) AS pos, unnest([o_orderstatus, substring(o_orderpriority, 1, 1)]) AS state, year(o_orderdate) + (dayofyear(o_orderdate) - 1) / 365.25::DOUBLE AS t, o_totalprice AS score
FROM orders),
q AS (SELECT unnest([1994, 1995, 1996]) AS q), f AS (SELECT q, pos, state, count(*) / sum(count(*)) OVER (PARTITION BY q, pos) AS f FROM x, q
WHERE t >= q + 8 / 12.0::DOUBLE AND t < q + 18 / 12.0::DOUBLE GROUP BY 1, 2, 3),
e AS (SELECT q, o_orderkey, avg(1 - coalesce(f, 0)) AS d, max(score) AS s FROM (SELECT x.*, q FROM x, q
WHERE t >= q - 8 / 12.0::DOUBLE AND t < q + 2 / 12.0::DOUBLE) LEFT JOIN f USING (q, pos, state) GROUP BY 1, 2)
SELECT q::INT AS year, max_by(o_orderkey, [s, o_orderkey]) AS picked, round(max_by(d, [s, o_orderkey]), 6) AS picked_distance,
round(avg(d), 6) AS mean_distance FROM e GROUP BY 1""")
def back_test(spark, sf_dir):
    states = F.array(F.struct(F.lit(1).alias("pos"), F.col("o_orderstatus").alias("state")), F.struct(F.lit(2).alias("pos"), F.substring("o_orderpriority", 1, 1).alias("state")))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", dates.decimal_year(F.col("o_orderdate")).alias("num_date"), F.col("o_totalprice").alias("score"), F.explode(states).alias("s")).select("o_orderkey", "num_date", "score", "s.pos", "s.state")
    out = prediction.back_test(rows, [1994, 1995, 1996], "score", "o_orderkey")
    return out.select("year", "picked", *(F.round(c, 6).alias(c) for c in ("picked_distance", "mean_distance")))


@query()
def model_comparison(spark, sf_dir):
    s = samples(spark, sf_dir).groupBy(F.year("date").alias("season"), F.col("region").alias("clade")).agg(F.count("*").alias("n"), F.avg("length").alias("x1"), F.stddev_pop("length").alias("x2"))
    f = s.withColumn("freq", F.col("n") / F.sum("n").over(Window.partitionBy("season")))
    ahead = f.select((F.col("season") - 1).alias("season"), "clade", F.col("freq").alias("observed"))
    z = series.standardise(series.standardise(f, "x1", ["season"], "p1"), "x2", ["season"], "p2").join(ahead, ["season", "clade"])
    return prediction.compare_models(saved(z.select("season", "clade", "freq", "observed", "p1", "p2")), {"mean": ["p1"], "both": ["p1", "p2"]})


@query()
def ancestral_states(spark, sf_dir):
    nodes = node_table(spark, sf_dir).where("node_id < 1000 or child_ord >= 0")
    letter = F.substr(F.lit("ACGT"), (F.col("child_ord") * 7 + F.col("p")) % 4 + 1, F.lit(1))
    tips = nodes.where("node_id >= 1000").withColumn("p", F.explode(F.sequence(F.lit(1), F.lit(4)))).select("node_id", F.col("p").alias("pos"), letter.alias("state"))
    return ancestral.reconstruct(nodes, tips)


@query()
def ancestral_states_contracted(spark, sf_dir):
    nodes = node_table(spark, sf_dir)
    letter = F.substr(F.lit("ACGT"), (F.col("child_ord") * 7 + F.col("p")) % 4 + 1, F.lit(1))
    tips = nodes.where("node_id >= 1000").withColumn("p", F.explode(F.sequence(F.lit(1), F.lit(4)))).select("node_id", F.col("p").alias("pos"), letter.alias("state"))
    return ancestral.reconstruct_contracted(nodes, tips)


@query("SELECT c_custkey, lower(regexp_replace(regexp_replace(n_name || 'Asia', '\\s+', '_', 'g'), '([a-z])([A-Z])', '\\1_\\2', 'g')) AS snake FROM customer JOIN nation ON c_nationkey = n_nationkey")
def snake_case_names(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select("c_custkey", readers.snake_case(F.concat("n_name", F.lit("Asia"))).alias("snake"))


@query(f"""WITH RECURSIVE {_TREE}, {_LAST}, tips AS (SELECT node_id, CASE WHEN num_date < 1998.3 THEN 1997 ELSE 1998 END AS season FROM last),
fr AS (SELECT ancestor AS node_id, season, count(*) AS n FROM closure JOIN tips ON node = tips.node_id GROUP BY 1, 2),
near AS (SELECT c.node, p.season, min_by(c.ancestor, c.steps) AS a FROM closure c JOIN fr b ON b.node_id = c.ancestor
JOIN fr p ON p.node_id = c.node AND p.season = b.season + 1 WHERE c.steps > 0 GROUP BY 1, 2)
SELECT fr.node_id, fr.season::INT AS season, coalesce(a, 0)::INT AS ancestor FROM fr LEFT JOIN near ON node = fr.node_id AND near.season = fr.season
WHERE fr.node_id <> 0""")
def season_ancestors(spark, sf_dir):
    nodes = node_table(spark, sf_dir)
    closure = tree.ancestors(nodes)
    tips = _last_orders(spark, sf_dir).select("node_id", F.when(F.col("num_date") < 1998.3, 1997).otherwise(1998).alias("season"))
    return seasons.season_ancestor(closure, seasons.season_frequencies(closure, tips), nodes)
