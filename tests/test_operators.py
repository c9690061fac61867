import os

import pytest
from auxograph.functions import chemistry
from auxograph.operators import joins, mapping, matrices, plates, ranking, sinks
from auxograph.sources.compounds import Compound, CompoundTable
from pyspark.errors import PySparkException
from pyspark.sql import functions as F


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def test_smart_join(spark):
    left = frame(spark, "well string, a double, b int, c string", ("A1", float("nan"), 1, None), ("B1", 2.0, 2, "x"))
    right = frame(spark, "well string, a double, b int, c string, d int", ("A1", float("nan"), 1, None, 7), ("B1", 2.0, 3, "x", 8))
    got = joins.smart_join(left, right)
    assert got.columns == ["well", "a", "b", "c", "b_right", "d"]
    assert joins.smart_join(left.where("false"), right).columns == ["well", "a", "b", "c", "d"]
    assert joins.smart_join_drop_right(left, right).columns == ["well", "a", "b", "c", "d"]
    assert joins.smart_join(left, right.where("well = 'A1'"), how="left").count() == 2


def test_lookups(spark):
    words = frame(spark, "w string", ("a",), ("b",), ("zz",))
    table = frame(spark, "name string, iupac string, n int", ("a", "a", 1), ("x", "b", 2), ("b", "", 3))
    assert sorted((r.w, r.n) for r in joins.by_either_key(words, "w", table, ["name", "iupac"], []).collect()) == [("a", 1), ("b", 2), ("b", 3)]
    first = joins.first_match(words, table.withColumnRenamed("iupac", "w"), ["w"], ["n"])
    assert sorted((r.w, r.n) for r in first.collect()) == [("a", 1), ("b", 2), ("zz", None)]
    assert joins.last_wins(frame(spark, "k string, v int, o int", ("a", 1, 2), ("a", 5, 1)), "k", "v", ["o"]).first().v == 1


PLATE = [(r, c, f"{r}{c}", t, float(ord(r) + c + t), s) for r in "AB" for c in (1, 2, 10) for t in (0.0, 1.0) for s in [f"S{c}" if r == "A" else "WT1"]]


def test_replicates_by_well(spark):
    df = frame(spark, "well_row string, well_col int, well string, time_h double, od double, strain string", *PLATE)
    got = {(r.group_id, r.time_h): r for r in plates.replicates_by_well(df, "alpha", 3).collect()}
    assert set(got) == {(g, t) for g in ("A_1-10", "B_1-10") for t in (0.0, 1.0)}
    a = got["A_1-10", 0.0]
    assert (a.wells, a.well_rows, a.well_cols, a.n_replicates) == ("A1,A10,A2", "A", "1,10,2", 3)
    assert a.od_mean == pytest.approx((66 + 67 + 75) / 3) and a.strain == "S1"
    down = {r.group_id for r in plates.replicates_by_well(df, "num", 2, 0).collect()}
    assert down == {"AB_1", "AB_2", "AB_10"}
    assert all(r.od_std == 0.0 for r in plates.replicates_by_well(df, "num", 1, 0).collect())
    assert all(r.od_std is None for r in plates.replicates_by_well(df, "num", 1, 1).collect())
    for bad in ({"sample_size": 4}, {"sample_size": 0}, {"direction": "sideways"}):
        with pytest.raises(ValueError):
            plates.replicates_by_well(df, **{"sample_size": 3, **bad})


def test_replicates_by_rules(spark):
    df = frame(spark, "well_row string, well_col int, well string, time_h double, od double, strain string", *PLATE, ("C", 1, "C1", 0.0, 1.0, None))
    rules = {"S": {"sample_size": 3}, "WT": {"direction": "numerical", "sample_size": 1}, "other": {"sample_size": 2}}
    got = {(r.strain, r.group_id, r.time_h): r for r in plates.replicates_by_rules(df, "[A-Za-z]+", rules, 0).collect()}
    assert {k[:2] for k in got} == {("S", "A_1-10"), ("WT", "B_1"), ("WT", "B_2"), ("WT", "B_10")}
    assert plates.replicates_by_rules(df, "[A-Za-z]+", {"nan": {"sample_size": 1}}).count() == 1
    assert plates.replicates_by_rules(df, "[A-Za-z]+", {"nan": {"sample_size": 1}}, missing_as=None).count() == 0
    assert plates.replicates_by_rules(df, "[A-Za-z]+", {}).count() == 0
    with pytest.raises(ValueError, match="can't be divided"):
        plates.replicates_by_rules(df, "[A-Za-z]+", {"S": {"sample_size": 2}})


def test_a_well_of_two_strains(spark):
    """Readings of a well meet the groups of their own strain only."""
    rows = [("A", c, f"A{c}", 0.0, od, s) for c in (1, 2) for s, od in (("S1", 1.0 + c), ("WT", 11.0 * c))]
    df = frame(spark, "well_row string, well_col int, well string, time_h double, od double, strain string", *rows)
    rules = {"S": {"sample_size": 2}, "WT": {"direction": "numerical", "sample_size": 1}}
    got = {(r.strain, r.group_id): (r.od_mean, r.n_replicates) for r in plates.replicates_by_rules(df, "[A-Za-z]+", rules, 0).collect()}
    assert got == {("S", "A_1-2"): (2.5, 2), ("WT", "A_1"): (11.0, 1), ("WT", "A_2"): (22.0, 1)}


def test_ranked(spark):
    """Numbers over many ranges, one hot group, null groups, ties and clashing names; no window over all rows."""
    n = 200_000
    df = spark.range(n).selectExpr("case when id % 3 = 0 then null when id % 97 = 1 then id % 5 else 7 end as g", "pmod(hash(id), 50000) as v", "id as row", "'x' as place", "'y' as start")
    got = ranking.ranked(df, ["v"], ranges=64)
    assert "SinglePartition" not in got._jdf.queryExecution().toString() and got.columns == [*df.columns, "rank"]
    assert [r.rank for r in got.orderBy("rank").select("rank").collect()] == list(range(1, n + 1))
    assert got.selectExpr("lag(v) over (order by rank) > v as bad").where("bad").count() == 0
    by = ranking.ranked(df, [df.v.desc()], by=["g"], ranges=64)
    want = df.selectExpr("*", "count(*) over (partition by g) as n")
    bad = by.join(want.select("row", "n"), "row").groupBy("g").agg({"rank": "max", "n": "max", "*": "count"}).toDF("g", "x", "y", "z").where("x <> y or x <> z").count()
    assert bad == 0 and by.selectExpr("lag(v) over (partition by g order by rank) < v as bad").where("bad").count() == 0
    assert ranking.ranked(df.limit(0), ["v"], by=["g"]).count() == 0


def test_replicates_of_many_wells(spark):
    """Wells of any number are grouped without a task for all of them; groups of ``by`` are numbered apart."""
    df = spark.range(60_000).selectExpr("chr(65 + id % 8) as well_row", "cast(id div 8 as int) as well_col", "concat(chr(65 + id % 8), id div 8) as well", "0.0D as time_h", "cast(id as double) as od", "id % 2 as plate")
    got = plates.replicates_by_well(df, "numerical", 4, 1)
    assert "SinglePartition" not in got._jdf.queryExecution().toString()
    assert got.count() == 15_000 and got.where("n_replicates <> 4 or length(wells) < 11").count() == 0
    small = df.where("well_col < 3").unionByName(df.where("well_col < 3").withColumn("plate", df.plate + 2))
    by = {(r.plate, r.group_id): r.wells for r in plates.replicates_by_well(small, "alpha", 3, by=["plate"]).collect()}
    assert by[0, "A_0-2"] == by[2, "A_0-2"] == "A0,A1,A2" and len(by) == 16
    with pytest.raises(ValueError, match="12 wells of [0-3] can't"):
        plates.replicates_by_well(small, "alpha", 5, by=["plate"])


def test_ddof(spark):
    df = frame(spark, "v double", (1.0,), (2.0,), (4.0,), (None,))
    got = df.agg(*[plates.standard_deviation("v", k).alias(f"d{k}") for k in range(4)]).first()
    mean = 7 / 3
    ss = sum((x - mean) ** 2 for x in (1, 2, 4))
    assert (got.d0, got.d1, got.d2, got.d3) == (pytest.approx((ss / 3) ** 0.5), pytest.approx((ss / 2) ** 0.5), pytest.approx(ss**0.5), None)


def test_chemistry(spark):
    vectors = {
        "[Na+]": ({"Na": 1}, 1), "[Cl-]": ({"Cl": 1}, -1), "[NH4+]": ({"N": 1, "H": 4}, 1), "[Ca++]": ({"Ca": 1}, 2),
        "[Fe(CN)6]4-": ({"Fe": 1, "C": 1, "N": 6}, -4), "[Ca+2]": ({"Ca": 1}, 2), "CC(=O)[O-]": ({"C": 2, "O": 2}, -1), "[13CH4]": ({"C": 1, "H": 4}, 0), "OP(=O)([O-])[O-]": ({"O": 4, "P": 1}, -2),
    }
    df = frame(spark, "s string", *[(k,) for k in vectors])
    for r in df.select("s", chemistry.composition("s").alias("c"), chemistry.charge("s").alias("q")).collect():
        assert (r.c, r.q) == vectors[r.s]
    with pytest.raises(PySparkException, match="unknown element"):
        frame(spark, "s string", ("[Xx]",)).select(chemistry.molar_mass(chemistry.composition("s"))).collect()
    table = frame(spark, chemistry.COMPOUND_COLUMNS, ("na", 1, "[Na+]", "sodium", 22.99))
    got = chemistry.with_mass_fractions(chemistry.ions(frame(spark, "salt string", ("[Na+].[Cl-]",)), "salt", table), ["salt"]).orderBy("ion").collect()
    assert [(r.smiles_component, r.iupac_name, r.iupac_name_secondary, r.pubchem_cid) for r in got] == [("Na", "sodium", "sodium", 1), ("Cl", "Unknown", None, None)]
    assert sum(r.mass_fraction for r in got) == pytest.approx(1)
    weights = chemistry.molecular_weights(frame(spark, "x string", ("NA",), ("k",)), "x", table).collect()
    assert {(r.x, r.molecular_weight) for r in weights} == {("NA", 22.99), ("k", None)}


TABLE = CompoundTable([
    Compound("glucose", 5793, molecular_weight=180.0), Compound("sodium", 1, molecular_weight=23.0), Compound("phosphate", 2, molecular_weight=95.0),
    Compound("proton", 3, molecular_weight=1.0), Compound("azanium", 4, molecular_weight=18.0),
])
MODEL = {"glucose": "EX_glc__D_e", "sodium": "EX_na1_e", "phosphate": "EX_pi_e", "proton": "EX_h_e", "ammonium": "EX_nh4_e", "ribose": "EX_rib__D_e", None: "EX_x"}


def fold(custom=None, supplements=(), strict=False):
    m = mapping.Mappings(MODEL, TABLE, strict=strict)
    m.update(custom or {})
    m.mark_supplements(list(supplements))
    m.check()
    return {r.name: r for r in m.rows}, m


def test_mapping_merges(spark):
    rows, m = fold({"glucose": {"exchange_name": "EX_glc__D_e", "mass_per_litre": 3.6, "source": "medium", "other_names": ["dextrose"]}}, ["riboze", "nothing like it"])
    assert rows["glucose"].mmol_concentration == pytest.approx(20.0) and rows["glucose"].other_names == {"dextrose", "glucose"}
    assert rows["ribose"].source == "supplement" and rows["ribose"].other_names == {"riboze"}
    assert len(rows) == 6 and any("nothing like it" in w for w in m.warnings)
    rows, _ = fold({"sugar": {"exchange_name": "EX_glc__D_e", "mass_per_litre": 1.0, "pubchem_name": "glucose"}})
    assert rows["sugar"].exchange_reaction == "EX_glc__D_e" and len(rows) == 7
    rows, m = fold({"odd": {"exchange_name": "EX_odd_e"}})
    assert "odd" not in rows and m.warnings
    with pytest.raises(ValueError, match="no exchange"):
        fold({"odd": {"exchange_name": "EX_odd_e"}}, strict=True)


def test_mapping_compounds(spark):
    salt = {"na2hpo4": {"mass_per_litre": 14.2, "is_compound": True, "compounds": ["sodium", "sodium", "phosphate", "proton"], "source": "medium"}}
    rows, _ = fold(salt)
    assert rows["sodium"].mass_per_litre == pytest.approx(14.2 * 23 / 142) and rows["phosphate"].mass_per_litre == pytest.approx(14.2 * 95 / 142)
    assert rows["sodium"].source == "medium" and rows["sodium"].mmol_concentration == pytest.approx(14.2 / 142 * 1000)
    with pytest.raises(ValueError, match="without parts"):
        fold({"empty": {"is_compound": True}})


def test_build_mappings_and_audit(spark, tmp_path):
    (tmp_path / "c.yaml").write_text("custom_mapping:\n  salt: {exchange_name: EX_na1_e, mass_per_litre: 1.0, source: fixed, flux_upper_bound: 5}\n")
    growth = frame(spark, "supplements string", (" Glucose ; RIBOSE",), (None,), ("",))
    got = mapping.build_mappings(growth, {k: v for k, v in MODEL.items() if k}, TABLE, custom_file=str(tmp_path / "c.yaml"))
    rows = {r.name: r for r in got.collect()}
    assert rows["glucose"].source == rows["ribose"].source == "supplement" and rows["salt"].flux_upper_bound == 5.0
    assert [r.name for r in mapping.mapping_report(got).collect()] == ["salt", "glucose", "ribose"]
    table = frame(spark, "name string, exchange_reaction string", ("glucose", "EX_glc__D_e"), ("ribose", "EX_rib__D_e"))
    audit = {r.token: (r.result, r.exchange_reaction) for r in matrices.mapping_audit(frame(spark, "supplements string", ("glucose;riboze;qqq",)), table).collect()}
    assert audit == {"glucose": ("exact", "EX_glc__D_e"), "riboze": ("fuzzy", "EX_rib__D_e"), "qqq": ("unmapped", None)}


def test_fuzzy(spark):
    found = mapping.fuzzy_top(frame(spark, "w string", ("ab",), ("riboze",), ("zzz",), (None,)), "w", frame(spark, "c string", ("ac",), ("ad",), ("ribose",)), "c")
    got = {r.w: (r.match, round(r.score, 4) if r.score else None) for r in found.collect()}
    assert got == {"ab": (None, None), "riboze": ("ribose", 0.8333), "zzz": (None, None), None: (None, None)}
    assert mapping.closest("ab", ["ac", "ad"], 0.4) == "ad"


GROWTH = "supplements string, max_time double, success boolean, mu_max double"
MAPPED = "name string, iupac_name string, exchange_reaction string, mmol_concentration double, flux_upper_bound double, source string"


def test_matrices(spark):
    mapped = frame(
        spark, MAPPED, ("glucose", "", "EX_g", 20.0, 0.0, "supplement"), ("salt", "", "EX_g", 5.0, 0.0, "medium"), ("ala", "alanine", "EX_a", 2.0, 0.0, "supplement"),
        ("water", "", "EX_w", 0.0, 1000.0, "fixed"), ("broth", "", "EX_b", 6.0, 0.0, "medium"), ("air", "", "EX_z", 0.0, 9.0, "unstated"),
    )
    growth = frame(spark, GROWTH, (" GLUCOSE;alanine", 4.0, True, 0.5), (None, 0.0, True, 0.25), ("glucose", 2.0, False, 0.1))
    flux = matrices.flux_matrix(growth, mapped).collect()
    assert [r.asDict() for r in flux] == [
        {"EX_a": 0.5, "EX_b": 1.5, "EX_g": 5.0, "EX_w": 1000.0, "mu_max": 0.5},
        {"EX_a": 0.0, "EX_b": 0.0, "EX_g": 0.0, "EX_w": 1000.0, "mu_max": 0.25},
    ]
    present = matrices.presence_matrix(growth, mapped, suffix="_i")
    assert present.columns == ["EX_a_i", "EX_b_i", "EX_g_i", "EX_w_i", "mu_max"]
    assert [tuple(r)[:4] for r in present.collect()] == [(1, 1, 1, 1), (0, 1, 0, 1)]
    bounds = {r.name: r for r in matrices.bounds_matrix(present, mapped, matrices.flux_matrix(growth, mapped), custom_bounds={"EX_w_i": (7, 70)}, suffix="_i").collect()}
    assert [bounds["max_value"][f"EX_{x}_i"] for x in "abgw"] == [0.5, 1.5, 5.0, 70.0]
    assert [bounds["level"][f"EX_{x}_i"] for x in "abgw"] == [100.0, 100.0, 100.0, 7.0]
    defaults = matrices.bounds_matrix(present, mapped.where("false"), present.where("false"), model_bounds={"EX_a": (3, 30)}, suffix="_i").collect()
    assert (defaults[1]["EX_a_i"], defaults[1]["EX_b_i"]) == (30.0, 1000.0)
    table = frame(spark, "name string, exchange_reaction string", ("glucose", "EX_g"), ("alanine", "EX_a"))
    assert [tuple(r) for r in matrices.supplement_matrix(growth, table, ["EX_w"]).collect()] == [(1, 1, 1, 0.5), (0, 0, 1, 0.25)]


def test_matrices_of_many_exchanges(spark):
    kinds = ("supplement", "medium", "fixed")
    rows = [(f"it's `{i}`", f"IU\u00e4 {i}".lower(), f"EX_{i:04d}`'\"\\", i + 1.0, 10.0, kinds[i % 3]) for i in range(3_000)]
    mapped = frame(spark, MAPPED, *rows)
    growth = frame(spark, GROWTH, ("IT'S `3`; iu\u00e4 2997 ;unknown", 2.0, True, 0.5), ("", 4.0, True, 0.25))
    names = sorted(r[2] for r in rows)
    given = [{3, 2997}, set()]
    value = lambda i, n: (i + 1.0) / (2, 4)[n] if i % 3 == 1 or i in given[n] else 10.0 if i % 3 == 2 else 0.0
    flux = matrices.flux_matrix(growth, mapped)
    assert flux.columns == [*names, "mu_max"]
    want = [[value(i, n) for i in range(3_000)] for n in (0, 1)]
    assert [list(r)[:-1] for r in flux.collect()] == want
    present = matrices.presence_matrix(growth, mapped).collect()
    assert [list(r)[:-1] for r in present] == [[int(i % 3 > 0 or i in given[n]) for i in range(3_000)] for n in (0, 1)]
    sparse = [r.fluxes for r in matrices.flux_sparse(growth, mapped).collect()]
    assert sparse == [{e: v for e, v in zip(names, w) if v} for w in want]
    plan = flux._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "from_json" not in plan and "invoke" not in plan  # the literal is read once, not per row


def test_matrices_over_shuffled_rows(spark, tmp_path):
    mapped = frame(
        spark, MAPPED, ("a", "", "EX_a", 2.0, 0.0, "supplement"), ("bee", "b", "EX_b", 3.0, 0.0, "supplement"), ("salt", "", "EX_m", 6.0, 0.0, "medium"),
    )
    given = F.expr("case id % 4 when 0 then 'A; b' when 1 then 'b' when 2 then 'zzz' end")
    growth = spark.range(200_000).select(given.alias("supplements"), (F.col("id") % 5).cast("double").alias("max_time"), F.lit(True).alias("success"), F.col("id").alias("mu_max")).repartition(7)
    flux = matrices.flux_matrix(growth, mapped)
    wrong = "EX_a <> if(mu_max % 5 > 0 and mu_max % 4 = 0, 2.0 / (mu_max % 5), 0) or EX_b <> if(mu_max % 5 > 0 and mu_max % 4 < 2, 3.0 / (mu_max % 5), 0) or EX_m <> if(mu_max % 5 > 0, 6.0 / (mu_max % 5), 0)"
    assert flux.count() == 200_000 and flux.where(wrong).count() == 0
    present = matrices.presence_matrix(growth, mapped)
    assert present.where("EX_a <> cast(mu_max % 4 = 0 as int) or EX_b <> cast(mu_max % 4 < 2 as int) or EX_m <> 1").count() == 0
    straight = spark.read.schema(GROWTH).csv(str(tmp_path))
    for made in (matrices.flux_matrix(straight, mapped), matrices.presence_matrix(straight, mapped), matrices.flux_long(straight, mapped)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" not in plan
    assert matrices.flux_long(growth.limit(40), mapped).count() == 120
    with pytest.raises(ValueError, match="more than"):
        matrices.reference_rows(spark.range(11), "a table", 10)


def test_conflicts(spark):
    rows = frame(spark, "exchange_reaction string, source string, record_origin string", *[("a", "fixed", "updated")] * 2, ("b", "fixed", "updated"), ("b", "medium", "updated"), ("c", "medium", "smbl"), ("c", "medium", "updated"))
    assert [tuple(r) for r in mapping.mapping_conflicts(rows).collect()] == [("a", 2, 2, 1)]


def test_names_and_ranks(spark):
    df = frame(spark, "g int, name string", *[(i % 2, f"n{i:03d}") for i in range(300)], (0, None), (1, "n001"))
    got = {r.g: r.names.split(";") for r in plates.first_names(df, "name", ["g"], 3).collect()}
    assert got == {0: ["n000", "n002", "n004"], 1: ["n001", "n003", "n005"]}
    assert len(plates.first_names(df, "name").first().names.split(";")) == 96
    assert joins.smart_join(df, df, ["name"], differing=["g"]).columns == ["name", "g", "g_right"]


def test_sinks(spark, tmp_path):
    df = frame(spark, "a int, b string", (1, "x"), (2, None))
    path = sinks.write_output(df, str(tmp_path / "out.csv"))[0]
    assert open(path).read().splitlines()[0] == "a,b" and len(open(path).read().splitlines()) == 3
    assert sinks.write_output(None, path) == []
    with pytest.raises(TypeError):
        sinks.write_output({"a": 1}, path)
    sinks.write_output((df, {"s": {2, 1}}), [str(tmp_path / "1.csv"), str(tmp_path / "2.json")])
    assert sinks.write_output(df, f"{tmp_path}/t.parquet/") and spark.read.parquet(str(tmp_path / "t.parquet")).count() == 2
    assert '"s": [' in (tmp_path / "2.json").read_text()
    for e, rows in (("e1", "strain,mu\nSLAB1,0.5\nWT1,1\n"), ("e2", "strain,mu\nSLAB7,0.25\n12,3\n")):
        os.makedirs(tmp_path / "all" / e)
        (tmp_path / "all" / e / "g.csv").write_text(rows)
    folders = [str(tmp_path / "all" / e) for e in ("e1", "e2")]
    got = [r.output_file for r in sinks.collate_by_group(spark, folders, "g.csv", pattern="[A-Za-z]+").collect()]
    assert got == [str(tmp_path / "all" / k / "report.csv") for k in ("SLAB", "WT")]
    assert sorted(open(got[0]).read().split()) == ["SLAB1,0.5,e1", "SLAB7,0.25,e2", "strain,mu,experiment"]


def test_plots(spark):
    df = spark.range(10).select(F.lit("A/1").alias("well"), F.col("id").cast("double").alias("t"), (F.col("id") * 2.0).alias("v"), (F.col("id") * 2.1).alias("f"))
    row = sinks.svg_plots(df, ["well"], "t", "v", "f").first()
    # the name holds the key "A/1" with its slash escaped: replaced by a hyphen it would be that of "A-1"
    assert row.file_name == "A%2f;1.svg" and row.svg.count("<circle") == 10 and "polyline" in row.svg


def test_saved_plots(spark, tmp_path):
    from auxograph.plans.registry import OPERATORS

    df = spark.range(8).select(F.explode(F.array(F.lit("A1"), F.lit("B1"))).alias("well"), F.col("id").cast("double").alias("t"), F.lit(0.5).alias("v"), F.lit(0.1).alias("sd"))
    params = frame(spark, "well string, y0 double, A double, mu_max double, lambda double", ("A1", 0.0, 1.0, 0.5, 1.0))
    arguments = dict(df=df, params_df=params, time_col="t", value_col="v", group_cols=["well"], save_plot_data=True, output_dir=str(tmp_path), standard_deviation_column="sd")
    done = OPERATORS["predict_modified_gompertz_per_series"].call(spark, arguments)
    assert done.where("od600_fit is null").count() == 8
    assert os.listdir(tmp_path / "plots") == ["A1.svg"] or set(os.listdir(tmp_path / "plots")) == {"A1.svg", ".A1.svg.crc"}
    text = (tmp_path / "plots" / "A1.svg").read_text()
    assert text.count("<circle") == text.count("<line") == 8


def test_most_similar_candidates(spark):
    """The join has the answers of comparing every word with every candidate."""
    import difflib
    import random

    from auxograph.operators import similarity

    random.seed(3)
    made = lambda n, letters, most: sorted({"".join(random.choices(letters, k=random.randint(0, most))) for _ in range(n)})
    for letters, most, cutoff in (("abcdefgh", 9, 0.6), ("ab", 6, 0.75), ("abcdefghijklmnopqrstuvwxyz", 14, 0.4)):
        words, candidates = made(120, letters, most), made(150, letters, most)
        words += ["x" * 250 + "y", "ab" * 120, *candidates[:5]]
        candidates += ["x" * 249 + "yz", "ab" * 120, "ab" * 119 + "ba"]
        got = similarity.most_similar(frame(spark, "w string, k int", *[(w, 1) for w in words], (None, 2), (words[3], 3)), "w", frame(spark, "c string", *[(c,) for c in candidates], (None,)), "c", cutoff)
        assert got.columns == ["w", "k", "match", "score"]
        rows = got.collect()
        assert len(rows) == len(words) + 2
        for r in rows:
            scored = [(difflib.SequenceMatcher(None, c, r.w).ratio(), c) for c in candidates] if r.w is not None else []
            best = max(((s, c) for s, c in scored if s >= cutoff), default=(None, None))
            assert (r.score, r.match) == best, r.w
    assert similarity.most_similar(frame(spark, "w string", ("a",)), "w", frame(spark, "c string", ("a",)).where("false"), "c").first().match is None
    with pytest.raises(ValueError, match="cutoff"):
        similarity.most_similar(got, "w", got, "w", 0.0)


def test_file_names_of_plots(spark):
    rows = [(k, t, 1.0 + t) for k in ("a b", "a-b", "a_b", "a%20;b", "A b") for t in (0.0, 1.0)]
    names = [r.file_name for r in sinks.svg_plots(frame(spark, "k string, t double, v double", *rows), ["k"], "t", "v").collect()]
    assert len({n.lower() for n in names}) == 4 and len(set(names)) == 5


def test_plots_of_long_series(spark):
    """A plot shows at most four points a pixel column, the extremes of each among them, whatever the length of the series."""
    long = spark.range(40_000, numPartitions=4).select(F.lit("a&b").alias("k"), (F.col("id") / 100.0).alias("t"), F.sin("id").alias("v"))
    other = frame(spark, "k string, t double, v double", ("x", 1.0, 2.0), ("x", 1.0, 2.0), ("x", None, 5.0), ("none", None, None), (None, 1.0, 1.0))
    shown = {r.k: r for r in sinks.plot_points(long.unionByName(other), ["k"], "t", "v", "v", columns=50).collect()}
    assert set(shown) == {"a&b", "x", "none"} and [tuple(p) for p in shown["x"].points] == [(1.0, 2.0, None)]
    assert shown["none"].points == shown["none"].line == []
    import math

    cells = {}
    for i in range(40_000):
        p = (i / 100.0, math.sin(i))
        cells.setdefault(math.floor(p[0] / 399.99 * 50), []).append(p)
    want = {f(c, key=key) for c in cells.values() for f in (min, max) for key in (lambda p: p, lambda p: (p[1], p[0]))}
    got = [(p.t, p.v) for p in shown["a&b"].points]
    assert len(got) <= 4 * 51 and got == sorted(got)
    assert [t for t, _ in got] == sorted(t for t, _ in want)
    svg = sinks.svg_plots(long, ["k"], "t", "v", "v").first()
    assert svg.file_name == "a%26;b.svg" and "a&amp;b" in svg.svg and svg.svg.count("<circle") <= 4 * 571
