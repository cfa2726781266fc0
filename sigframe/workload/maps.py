"""Queries on location maps, stimulus events and confounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sigframe.operators import confounds, events, regions
from sigframe.sources import tables
from sigframe.workload.base import regular_sql, series
from sigframe.workload.registry import query, table

# -- locations: customers; atlas A = market segment of the better balances, atlas B = nation ----------
# labels of customers with an odd key carry the second-hemisphere offset in map queries

_SEG = "CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 1 WHEN 'BUILDING' THEN 2 WHEN 'FURNITURE' THEN 3 WHEN 'HOUSEHOLD' THEN 4 ELSE 5 END"
_MAPS = f"""maps AS (SELECT 'segment' AS atlas, c_custkey AS loc, CAST(CASE WHEN c_acctbal > 5000 THEN {_SEG} ELSE 0 END AS INTEGER) AS label FROM customer
  UNION ALL SELECT 'nation', c_custkey, CAST(c_nationkey + 1 AS INTEGER) FROM customer),
sizes AS (SELECT atlas, label, count(*) AS size FROM maps WHERE label <> 0 GROUP BY 1, 2),
pairs AS (SELECT a.atlas, a.label, b.atlas AS other_atlas, b.label AS other_label, count(*) AS shared FROM maps a JOIN maps b ON a.loc = b.loc AND a.atlas <> b.atlas AND a.label <> 0 AND b.label <> 0 GROUP BY 1, 2, 3, 4),
over AS (SELECT p.*, s.size, o.size AS other_size FROM pairs p JOIN sizes s ON s.atlas = p.atlas AND s.label = p.label JOIN sizes o ON o.atlas = p.other_atlas AND o.label = p.other_label
  WHERE shared / s.size >= 0.1 OR shared / o.size >= 0.1)""".replace("over AS (", "near AS (")
_HEMI = "label_h AS (SELECT c_custkey AS loc, CAST(c_nationkey + 1 + 1000 * (c_custkey % 2) AS INTEGER) AS label, c_acctbal AS value, CASE WHEN c_acctbal > 2500 THEN 1 ELSE 0 END AS mask FROM customer)"


def segment_label():
    s = F.col("c_mktsegment")
    return F.when(s == "AUTOMOBILE", 1).when(s == "BUILDING", 2).when(s == "FURNITURE", 3).when(s == "HOUSEHOLD", 4).otherwise(5)


def maps(spark, d) -> DataFrame:
    c = table(spark, d, "customer")
    a = c.select(F.lit("segment").alias("atlas"), F.col("c_custkey").alias("loc"), F.when(F.col("c_acctbal") > 5000, segment_label()).otherwise(0).alias("label"))
    b = c.select(F.lit("nation").alias("atlas"), F.col("c_custkey").alias("loc"), (F.col("c_nationkey") + 1).alias("label"))
    return a.unionByName(b)


def located(spark, d) -> DataFrame:
    return table(spark, d, "customer").select(
        F.col("c_custkey").alias("loc"), (F.col("c_nationkey") + 1 + 1000 * (F.col("c_custkey") % 2)).cast("int").alias("label"),
        F.col("c_acctbal").alias("value"), (F.col("c_acctbal") > 2500).cast("int").alias("mask"))


def nation_labels(spark, d) -> DataFrame:
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.select((F.col("n_nationkey") + 1).alias("label"), F.col("n_name").alias("area"), F.concat("r_name", F.lit(" (group)")).alias("aggregate_label"))


_LABELS = "labels_n AS (SELECT CAST(n_nationkey + 1 AS INTEGER) AS label, n_name AS area, r_name || ' (group)' AS aggregate_label FROM nation JOIN region ON n_regionkey = r_regionkey)"


@query("a6_parcels", f"WITH {_HEMI} SELECT CAST(label % 1000 AS INTEGER) AS label, round(avg(value) FILTER (WHERE mask = 1), 4) AS value, round(avg(mask), 6) AS coverage, count(*) FILTER (WHERE mask = 1) AS n FROM label_h GROUP BY 1 HAVING avg(mask) >= 0.6")
def a6_parcels(spark, d):
    out = regions.parcel_values(located(spark, d), coverage_threshold=0.6)
    return out.select("label", F.round("value", 4).alias("value"), F.round("coverage", 6).alias("coverage"), "n")


@query("a6_parcels_unmasked", f"WITH {_HEMI} SELECT CAST(label % 1000 AS INTEGER) AS label, round(avg(value), 4) AS value, CAST(1 AS DOUBLE) AS coverage, count(*) AS n FROM label_h GROUP BY 1")
def a6_parcels_unmasked(spark, d):
    return regions.parcel_values(located(spark, d), mask_col=None).withColumn("value", F.round("value", 4))


@query("a6_parcel_members", f"WITH {_HEMI}, k AS (SELECT label % 1000 AS l FROM label_h GROUP BY 1 HAVING avg(mask) >= 0.6) SELECT CAST(label % 1000 AS INTEGER) AS label, loc, value FROM label_h JOIN k ON l = label % 1000 WHERE mask = 1")
def a6_parcel_members(spark, d):
    return regions.parcel_members(located(spark, d), coverage_threshold=0.6).select("label", "loc", "value")


@query("p11_mask", f"WITH {_HEMI} SELECT loc, CAST(CASE WHEN r_name IN ('ASIA', 'EUROPE') THEN 1 ELSE 0 END AS DOUBLE) AS mask FROM label_h JOIN nation ON n_nationkey + 1 = label % 1000 JOIN region ON n_regionkey = r_regionkey")
def p11_mask(spark, d):
    return regions.atlas_mask(located(spark, d), nation_labels(spark, d), ["ASIA (group)", "EUROPE (group)"]).select("loc", "mask")


@query("p12_subset", f"WITH {_MAPS}, {_LABELS} SELECT loc, CAST(CASE WHEN aggregate_label = 'AFRICA (group)' THEN m.label ELSE 0 END AS INTEGER) AS label FROM maps m JOIN labels_n USING (label) WHERE atlas = 'nation'")
def p12_subset(spark, d):
    atlas = maps(spark, d).where(F.col("atlas") == "nation")
    return regions.subset_regions(atlas, nation_labels(spark, d), ["AFRICA (group)"])[0].select("loc", "label")


@query("p13_mask_map", f"WITH {_HEMI} SELECT loc, CASE WHEN mask <> 0 THEN value END AS value FROM label_h")
def p13_mask_map(spark, d):
    m = located(spark, d)
    return regions.mask_map(m.select("loc", "value"), m.select("loc", "mask")).select("loc", "value")


@query("p15_probability_threshold", f"SELECT c_custkey AS loc, CAST(CASE WHEN c_acctbal / 10000 >= 0.3 THEN {_SEG} ELSE 0 END AS INTEGER) AS label FROM customer")
def p15_probability_threshold(spark, d):
    return _threshold_inputs(spark, d, "thresholded")


def _threshold_inputs(spark, d, return_type):
    c = table(spark, d, "customer")
    parcels = c.select(F.col("c_custkey").alias("loc"), (segment_label() + 0.2).alias("label"))
    probs = c.select(F.col("c_custkey").alias("loc"), (F.col("c_acctbal") / 10000).alias("value"))
    return regions.region_maps(parcels, probs, return_type, 0.3)


@query("j17_parcels", f"SELECT c_custkey AS loc, CAST({_SEG} AS INTEGER) AS label FROM customer")
def j17_parcels(spark, d):
    return _threshold_inputs(spark, d, "parcels")


@query("j17_probabilities", "SELECT c_custkey AS loc, c_acctbal / 10000 AS value FROM customer")
def j17_probabilities(spark, d):
    return _threshold_inputs(spark, d, "probabilities")


@query("j17_regrouped_atlas", f"""WITH {_MAPS}, {_LABELS}, g AS (SELECT trim(split_part(aggregate_label, '(', 1)) AS name, row_number() OVER (ORDER BY min(label)) AS new_label FROM labels_n GROUP BY 1)
SELECT loc, CAST(new_label AS INTEGER) AS label FROM maps JOIN labels_n USING (label) JOIN g ON name = trim(split_part(aggregate_label, '(', 1)) WHERE atlas = 'nation'""")
def j17_regrouped_atlas(spark, d):
    labels = nation_labels(spark, d).withColumn("aggregate_label", regions.clean_label(F.col("aggregate_label")))
    atlas = maps(spark, d).where(F.col("atlas") == "nation")
    return regions.regroup_atlas(atlas, regions.regroup_labels(labels)).select("loc", "label")


@query("a19_regroup", f"""WITH {_LABELS}, g AS (SELECT trim(split_part(aggregate_label, '(', 1)) AS aggregate_label, min(label) AS first, string_agg(DISTINCT area, ', ' ORDER BY area) AS areas FROM labels_n GROUP BY 1)
SELECT l.label, CAST(row_number FROM_G AS INTEGER) AS new_label, g.aggregate_label, areas FROM labels_n l JOIN g ON g.aggregate_label = trim(split_part(l.aggregate_label, '(', 1))""".replace(
    "CAST(row_number FROM_G AS INTEGER)", "CAST((SELECT count(*) FROM g h WHERE h.first <= g.first) AS INTEGER)"))
def a19_regroup(spark, d):
    labels = nation_labels(spark, d).withColumn("aggregate_label", regions.clean_label(F.col("aggregate_label")))
    return regions.regroup_labels(labels).select("label", "new_label", "aggregate_label", "areas")


@query("p26_cleanup", """SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'STG' WHEN p_size % 4 = 1 THEN 'STS' WHEN p_size % 4 = 2 THEN p_type ELSE trim(p_brand) END AS label FROM part""")
def p26_cleanup(spark, d):
    size = F.col("p_size") % 4
    raw = F.when(size == 0, F.when(F.col("p_size") % 8 == 0, "STGa").otherwise("STGd (dorsal)")).when(size == 1, "STSv").when(
        size == 2, F.concat("p_type", F.lit(" (kind)"))).otherwise(F.concat(F.lit(" "), "p_brand"))
    return table(spark, d, "part").select("p_partkey", regions.clean_label(raw).alias("label"))


@query("j7_map_by_atlas", f"WITH {_MAPS} SELECT atlas, label, count(*) AS n, round(avg(c_acctbal), 4) AS value FROM maps JOIN customer ON c_custkey = loc WHERE label <> 0 GROUP BY 1, 2")
def j7_map_by_atlas(spark, d):
    values = table(spark, d, "customer").select(F.col("c_custkey").alias("loc"), "c_acctbal")
    return maps(spark, d).where("label <> 0").join(values, "loc").groupBy("atlas", "label").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("c_acctbal"), 4).alias("value"))


@query("j8_overlap", f"WITH {_MAPS} SELECT * FROM near")
def j8_overlap(spark, d):
    return regions.overlapping_regions(maps(spark, d), 0.1)


_COMBINE = f"""{_MAPS}, won AS (SELECT DISTINCT ON (loc) loc, atlas, label, CASE atlas WHEN 'segment' THEN 0 ELSE 1 END AS p FROM maps WHERE label <> 0 ORDER BY loc, p),
win AS (SELECT atlas, label, CAST(row_number() OVER (ORDER BY p, label) AS INTEGER) AS new_label FROM (SELECT DISTINCT p, atlas, label FROM won))"""


def combined(spark, d):
    labels = maps(spark, d).where("label <> 0").select("atlas", "label").distinct().where("label < 20").withColumn(
        "aggregate_label", F.concat("atlas", F.lit("-"), "label"))
    return regions.combine(maps(spark, d), ["nation", "segment"], ["segment", "nation"], overlap_threshold=0.1, labels=labels)


@query("j9_combine", f"WITH {_COMBINE} SELECT loc, new_label AS label FROM won JOIN win USING (atlas, label)")
def j9_combine(spark, d):
    return combined(spark, d)[0]


@query("j9_combine_info", f"""WITH {_COMBINE}, nm AS (SELECT atlas, label, CASE WHEN label < 20 THEN atlas || '-' || label ELSE 'unknown_' || label END AS region FROM sizes),
ol AS (SELECT n.atlas, n.label, string_agg(DISTINCT region, ', ' ORDER BY region) AS overlapping FROM near n JOIN nm ON nm.atlas = n.other_atlas AND nm.label = n.other_label GROUP BY 1, 2)
SELECT new_label, region AS area, atlas, label, coalesce(overlapping, 'None') AS overlapping FROM win JOIN nm USING (atlas, label) LEFT JOIN ol USING (atlas, label)""")
def j9_combine_info(spark, d):
    return combined(spark, d)[1]


@query("j10_combined_atlas", f"""WITH net AS (SELECT 'network' AS atlas, c_custkey AS loc, CASE WHEN c_acctbal / 10000 >= 0.3 THEN {_SEG} ELSE 0 END AS label, 0 AS p FROM customer),
area AS (SELECT 'structure' AS atlas, c_custkey AS loc, CASE WHEN n_regionkey = 0 THEN c_nationkey + 1 ELSE 0 END AS label, 1 AS p FROM customer JOIN nation ON n_nationkey = c_nationkey),
u AS (SELECT * FROM net UNION ALL SELECT * FROM area), w AS (SELECT DISTINCT ON (loc) * FROM u WHERE label <> 0 ORDER BY loc, p),
n AS (SELECT atlas, label, row_number() OVER (ORDER BY p, label) AS new_label FROM (SELECT DISTINCT p, atlas, label FROM w))
SELECT loc, CAST(new_label AS INTEGER) AS label FROM w JOIN n USING (atlas, label)""")
def j10_combined_atlas(spark, d):
    """A probability-thresholded network over selected structural regions."""
    network = _threshold_inputs(spark, d, "thresholded").withColumn("atlas", F.lit("network"))
    nation = maps(spark, d).where(F.col("atlas") == "nation")
    wanted = table(spark, d, "nation").where("n_regionkey = 0").select((F.col("n_nationkey") + 1).alias("label"), F.lit("kept").alias("aggregate_label"))
    structure = regions.subset_regions(nation, wanted, ["kept"])[0].withColumn("atlas", F.lit("structure"))
    both = network.select("atlas", "loc", "label").unionByName(structure.select("atlas", "loc", "label"))
    return regions.combine(both, ["network", "structure"])[0]


@query("j11_unique_regions", f"WITH {_MAPS} SELECT atlas, label FROM sizes s WHERE NOT EXISTS (SELECT 1 FROM near n WHERE n.atlas = s.atlas AND n.label = s.label)")
def j11_unique_regions(spark, d):
    return regions.unique_regions(maps(spark, d), 0.1)


@query("j15_region_names", f"WITH {_MAPS}, {_LABELS} SELECT m.atlas, m.label, coalesce(l.area, 'unknown_' || m.label) AS region FROM (SELECT DISTINCT atlas, label FROM maps WHERE label <> 0) m LEFT JOIN labels_n l ON l.label = m.label AND m.atlas = 'nation'")
def j15_region_names(spark, d):
    labels = nation_labels(spark, d).select(F.lit("nation").alias("atlas"), "label", F.col("area").alias("aggregate_label"))
    return regions.region_name(labels, regions.labels_in(maps(spark, d)))


@query("u5_labels", f"WITH {_MAPS} SELECT DISTINCT atlas, label FROM maps WHERE label <> 0")
def u5_labels(spark, d):
    return regions.labels_in(maps(spark, d))


# -- stimulus events: order lines; onset = days since 1995, amplitude = quantity, duration = price ----

_EV = """ev AS (SELECT l_returnflag AS run, l_orderkey, l_linenumber, CAST(datediff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS DOUBLE) AS onset, l_quantity AS amplitude,
  l_extendedprice AS duration, CASE WHEN l_tax = 0.05 THEN NULL ELSE l_tax END AS note FROM lineitem)"""


def stimuli(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("run"), "l_orderkey", "l_linenumber",
        F.datediff(F.col("l_shipdate").cast("date"), F.lit("1995-01-01").cast("date")).cast("double").alias("onset"),
        F.col("l_quantity").alias("amplitude"), F.col("l_extendedprice").alias("duration"),
        F.when(F.col("l_tax") != 0.05, F.col("l_tax")).alias("note"))


@query("p4_complete", f"WITH {_EV} SELECT l_orderkey, l_linenumber, onset FROM ev WHERE note IS NOT NULL")
def p4_complete(spark, d):
    return events.complete(stimuli(spark, d)).select("l_orderkey", "l_linenumber", "onset")


@query("p5_shift", f"WITH {_EV} SELECT l_orderkey, l_linenumber, onset + 2.5 AS onset FROM ev")
def p5_shift(spark, d):
    return events.shift_onset(stimuli(spark, d), 2.5).select("l_orderkey", "l_linenumber", "onset")


@query("p6_duration_flag", f"WITH {_EV} SELECT l_orderkey, l_linenumber, duration >= 20000 AS time_filter FROM ev")
def p6_duration_flag(spark, d):
    return events.flag_duration(stimuli(spark, d), 20000.0).select("l_orderkey", "l_linenumber", "time_filter")


_TXT = {"times": "printf('%.2f', onset + 2.5)", "am": "printf('%.2f*%.2f', onset + 2.5, amplitude)",
        "dm": "printf('%.2f:%.2f', onset + 2.5, duration)", "dm_am": "printf('%.2f*%.2f:%.2f', onset + 2.5, amplitude, duration)"}
for _i, _form in enumerate(("times", "am", "dm", "dm_am")):
    @query(f"p{7 + _i}_{_form}_regressor", f"WITH {_EV} SELECT l_orderkey, l_linenumber, {_TXT[_form]} AS regressor FROM ev WHERE note IS NOT NULL {'AND duration >= 20000' if _form.startswith('dm') else ''}")
    def regressor(spark, d, form=_form):
        return events.regressors(stimuli(spark, d), form, offset=2.5, min_duration=20000.0).select("l_orderkey", "l_linenumber", "regressor")


@query("s12_regressor_lines", f"""WITH {_EV}, o AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY onset, l_orderkey, l_linenumber) - 1 AS pos FROM ev WHERE note IS NOT NULL)
SELECT run, CAST(pos // 500 AS BIGINT) AS part, string_agg(printf('%.2f', onset), ' ' ORDER BY pos) AS line FROM o GROUP BY 1, 2""")
def s12_regressor_lines(spark, d):
    out = events.regressors(stimuli(spark, d), "times")
    return events.regressor_lines(out, order_cols=["onset", "l_orderkey", "l_linenumber"], buckets=[F.col("onset"), F.floor(F.col("l_orderkey") / 4096)], per_part=500)


@query("s12_written_regressors", f"WITH {_EV} SELECT run, count(*) AS n, round(sum(onset), 2) AS total FROM ev WHERE note IS NOT NULL GROUP BY run")
def s12_written_regressors(spark, d):
    """Writes the text files and reads them back."""
    from sigframe.session import shared_dir

    path = f"{shared_dir(spark)}/regressors"
    tables.write_regressor(events.regressors(stimuli(spark, d), "times"), path)
    back = spark.read.option("lineSep", " ").schema("value string, run string").text(path)
    return back.where("value <> ''").groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("value").cast("double")), 2).alias("total"))


# -- confounds: user-day totals as columns; component attributes from the users' totals ---------------------

_CONF = f"""{regular_sql(86400.0)}, conf AS (SELECT t, max(value) FILTER (WHERE run = 'view') AS trans_x, max(value) FILTER (WHERE run = 'click') AS cosine00, max(n) FILTER (WHERE run = 'click') AS cosine01,
  max(value) FILTER (WHERE run = 'error') AS a_comp_cor_2, max(value) FILTER (WHERE run = 'purchase') AS a_comp_cor_10, max(value) FILTER (WHERE run = 'signup') AS t_comp_cor_00, max(n) FILTER (WHERE run = 'signup') AS motion_outlier00 FROM series GROUP BY t)"""


def confound_table(spark, d) -> DataFrame:
    s = series(spark, d, 86400.0)
    pick = lambda run, col, name: F.max(F.when(F.col("run") == run, F.col(col))).alias(name)
    return s.groupBy("t").agg(
        pick("view", "value", "trans_x"), pick("click", "value", "cosine00"), pick("click", "n", "cosine01"), pick("error", "value", "a_comp_cor_2"),
        pick("purchase", "value", "a_comp_cor_10"), pick("signup", "value", "t_comp_cor_00"), pick("signup", "n", "motion_outlier00"))


@query("p16_group", f"WITH {_CONF} SELECT t, cosine00, cosine01 FROM conf")
def p16_group(spark, d):
    return confounds.extract_group(confound_table(spark, d), "cosine", keys=["t"])


def components(spark, d) -> DataFrame:
    """Per supplier nation: its suppliers as components, singular value falling with the rank."""
    from pyspark.sql import Window

    s = table(spark, d, "supplier")
    w = Window.partitionBy("s_nationkey").orderBy(F.col("s_acctbal").desc(), "s_suppkey")
    rank = F.row_number().over(w)
    total = F.sum(F.abs("s_acctbal")).over(Window.partitionBy("s_nationkey"))
    share = F.sum(F.abs("s_acctbal")).over(w.rowsBetween(Window.unboundedPreceding, 0)) / total
    return s.select(
        "s_nationkey", F.concat(F.lit("a_comp_cor_"), rank).alias("name"), F.lit("aCompCor").alias("method"), (F.col("s_acctbal") > -500).alias("retained"),
        F.lit("CSF").alias("mask"), (-rank.cast("double")).alias("singular_value"), F.round(share, 6).alias("cumulative_variance"))


_COMP = """comp AS (SELECT s_nationkey, s_suppkey, row_number() OVER w AS r, round(sum(abs(s_acctbal)) OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey ROWS UNBOUNDED PRECEDING) / sum(abs(s_acctbal)) OVER (PARTITION BY s_nationkey), 6) AS cum, s_acctbal > -500 AS retained
  FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey)),
kept AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY r) AS rank, lag(cum) OVER (PARTITION BY s_nationkey ORDER BY r) AS prior FROM comp WHERE retained)"""


@query("a20_components_n", f"WITH {_COMP} SELECT s_nationkey, 'a_comp_cor_' || r AS name, CAST(rank AS INTEGER) AS rank FROM kept WHERE rank <= 3")
def a20_components_n(spark, d):
    return confounds.select_components(components(spark, d), 3, "aCompCor", "CSF", keys=["s_nationkey"]).select("s_nationkey", "name", "rank")


@query("a20_components_variance", f"WITH {_COMP} SELECT s_nationkey, 'a_comp_cor_' || r AS name, CAST(rank AS INTEGER) AS rank FROM kept WHERE prior IS NULL OR prior <= 0.6")
def a20_components_variance(spark, d):
    return confounds.select_components(components(spark, d), 0.6, "aCompCor", "CSF", keys=["s_nationkey"]).select("s_nationkey", "name", "rank")


@query("w6_order_check", """WITH w AS (SELECT s_nationkey, s_acctbal, lead(s_acctbal) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS nxt FROM supplier)
SELECT s_nationkey, count(*) FILTER (WHERE s_acctbal <= nxt) AS violations FROM w GROUP BY 1""")
def w6_order_check(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("s_nationkey").orderBy("s_suppkey")
    s = table(spark, d, "supplier").withColumn("nxt", F.lead("s_acctbal").over(w))
    return s.groupBy("s_nationkey").agg(F.count_if(F.col("s_acctbal") <= F.col("nxt")).alias("violations"))


@query("t2_natural_sort", f"WITH {_COMP} SELECT s_nationkey, 'a_comp_cor_' || r AS name, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY r) AS INTEGER) AS place FROM comp")
def t2_natural_sort(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("s_nationkey").orderBy(*confounds.name_order(F.col("name")))
    return components(spark, d).select("s_nationkey", "name", F.row_number().over(w).alias("place"))


@query("p17_confound_spec", f"WITH {_CONF} SELECT t, trans_x, cosine00, cosine01, a_comp_cor_2, a_comp_cor_10 FROM conf")
def p17_confound_spec(spark, d):
    """Two components (numbers 2 and 10) with attributes from the series they name."""
    s = series(spark, d, 86400.0)
    # the larger of both spreads comes first, so the order check holds on any data
    spread = s.where(F.col("run").isin("error", "purchase")).agg(F.stddev_pop("value").alias("sd"))
    comps = spread.select(F.explode(F.array(
        F.struct(F.lit("a_comp_cor_10").alias("name"), F.col("sd").alias("singular_value"), F.lit(0.9).alias("cumulative_variance")),
        F.struct(F.lit("a_comp_cor_2").alias("name"), (F.col("sd") + 1).alias("singular_value"), F.lit(0.5).alias("cumulative_variance")))).alias("c"))
    comps = comps.select("c.*", F.lit("aCompCor").alias("method"), F.lit(True).alias("retained"), F.lit("WM").alias("mask"))
    spec = {"confounds": ["trans_x", "cosine"], "aCompCor": {"n_comps": 2, "tissue": "WM"}}
    return confounds.extract_confounds(confound_table(spark, d), comps, spec, keys=["t"])


@query("s2_components_json", """SELECT s_nationkey, 'c' || s_suppkey AS name, 'tCompCor' AS method, s_acctbal > 0 AS retained, CAST(NULL AS VARCHAR) AS mask, s_acctbal AS singular_value, s_acctbal / 8 AS cumulative_variance FROM supplier""")
def s2_components_json(spark, d):
    s = table(spark, d, "supplier")
    entry = F.struct(F.lit("tCompCor").alias("Method"), (F.col("s_acctbal") > 0).alias("Retained"), F.col("s_acctbal").alias("SingularValue"), (F.col("s_acctbal") / 8).alias("CumulativeVarianceExplained"))
    # one sidecar object per nation
    text = s.groupBy("s_nationkey").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("c"), "s_suppkey"), entry)))).alias("j"))
    out = tables.components(text, F.col("j"), "s_nationkey")
    return out.select("s_nationkey", "name", "method", "retained", "mask", "singular_value", "cumulative_variance")


@query("s5_line_labels", r"""SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) AS INTEGER) AS parcel_index, line AS aggregate_label FROM (
  SELECT doc_id, i, trim(l[i], e' ') AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, regexp_split_to_array(text, '\r?\n') AS l FROM documents))) WHERE line <> ''""")
def s5_line_labels(spark, d):
    return tables.line_labels(table(spark, d, "documents"), F.col("text"), "doc_id")


# -- files: tables written in the formats the readers take, then read back ------------------------------------

@query("s3_region_table", "SELECT CAST(n_nationkey + 1 AS INTEGER) AS parcel_index, n_name AS area, 'Area of' || chr(10) || '\"' || r_name || '\"' AS description, r_name AS aggregate_label, CAST(NULL AS VARCHAR) AS cortex FROM nation JOIN region ON n_regionkey = r_regionkey")
def s3_region_table(spark, d):
    from sigframe.session import shared_dir

    path = f"{shared_dir(spark)}/regions"
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = n.select((F.col("n_nationkey") + 1).alias("parcel_index"), F.col("n_name").alias("area"), F.concat(F.lit("Area of\n\""), "r_name", F.lit("\"")).alias("description"),
                    F.col("r_name").alias("aggregate_label"), F.lit(None).cast("string").alias("cortex"))
    rows.write.csv(path, header=True, quoteAll=False, escape='"')
    return tables.read_region_table(spark, path)


@query("s4_colour_table", "SELECT CAST(n_nationkey AS INTEGER) AS parcel_index, replace(n_name, ' ', '_') AS aggregate_label FROM nation")
def s4_colour_table(spark, d):
    from sigframe.session import shared_dir

    path = f"{shared_dir(spark)}/colours"
    n = table(spark, d, "nation").select(F.concat_ws(" ", "n_nationkey", F.replace("n_name", F.lit(" "), F.lit("_"))).alias("value"))
    n.write.text(path)
    return tables.read_colour_table(spark, path)


@query("s2_confound_table", f"WITH {_CONF} SELECT t, trans_x, cosine00, CASE WHEN t = 0 THEN NULL ELSE a_comp_cor_2 END AS a_comp_cor_2 FROM conf")
def s2_confound_table(spark, d):
    from sigframe.session import shared_dir

    path = f"{shared_dir(spark)}/confounds"
    rows = confound_table(spark, d).select("t", "trans_x", "cosine00", F.when(F.col("t") != 0, F.col("a_comp_cor_2")).alias("a_comp_cor_2"))
    rows.write.csv(f"{path}/run.tsv", sep="\t", header=True, nullValue="n/a")
    sidecar = rows.agg(F.to_json(F.create_map(F.lit("a_comp_cor_2"), F.struct(F.lit("aCompCor").alias("Method"), F.lit(True).alias("Retained"), F.stddev_pop("trans_x").alias("SingularValue")))).alias("value"))
    sidecar.write.text(f"{path}/run.json")
    wide, comps = tables.read_confounds(spark, f"{path}/run.tsv")
    return wide.where(comps.agg(F.count(F.lit(1))).scalar() == 1)


@query("s7_banded_files", f"WITH {regular_sql()} SELECT run, t, CAST(f AS INTEGER) AS feature, CASE f WHEN 0 THEN value ELSE CAST(n AS DOUBLE) END AS x FROM series, (SELECT unnest([0, 1]) AS f)")
def s7_banded_files(spark, d):
    from sigframe.session import shared_dir

    path = shared_dir(spark)
    s = series(spark, d)
    s.select("run", "t", F.array("value").alias("x")).write.parquet(f"{path}/amount")
    s.select("run", "t", F.array(F.col("n").cast("double")).alias("x")).write.parquet(f"{path}/count")
    x, _ = tables.read_banded_features(spark, [f"{path}/amount", f"{path}/count"], ["amount", "count"])
    return x.select("run", "t", F.posexplode("x").alias("feature", "x"))


@query("s8_word_vectors", "SELECT 'w' || vec_id AS word, CAST(i - 1 AS INTEGER) AS dim, round(CAST(embedding[i] AS DOUBLE), 6) AS value FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings)")
def s8_word_vectors(spark, d):
    from sigframe.session import shared_dir

    path = f"{shared_dir(spark)}/vectors"
    e = table(spark, d, "embeddings")
    e.select(F.concat_ws(" ", F.concat(F.lit("w"), "vec_id"), F.array_join(F.col("embedding").cast("array<string>"), " ")).alias("value")).write.text(path)
    v = tables.read_word_vectors(spark, path)
    return v.select("word", F.posexplode("vector").alias("dim", "value")).select("word", "dim", F.round(F.col("value").cast("double"), 6).alias("value"))


@query("s13_logits", "SELECT event_type AS run, event_id AS pos, CAST(user_id AS VARCHAR) AS token, value AS logit FROM events")
def s13_logits(spark, d):
    from sigframe.session import shared_dir

    path = f"{shared_dir(spark)}/logits"
    e = table(spark, d, "events").select(F.col("event_type").alias("run"), F.col("event_id").alias("pos"), F.col("user_id").cast("string").alias("token"), F.col("value").alias("logit"))
    tables.write_logits(e, path)
    return spark.read.parquet(path).select("run", "pos", "token", "logit")
