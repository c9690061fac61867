import os

import pytest
from auxograph.functions import tables
from auxograph.plans import diagrams
from auxograph.plans.actions import run_actions
from auxograph.plans.cli import main
from auxograph.plans.dataflow import Fork, Identity, MissingArguments, Step
from auxograph.plans.registry import register
from auxograph.plans.yaml_plans import SHIPPED, PlanError, build, build_shipped, run_batch
from test_sources import SBML

one = Step(lambda x: {"y": x + 1})
two = Step(lambda y: {"z": 10 * y})
other = Step(lambda x: {"y": -x})


def test_sequence_and_fork():
    assert (one >> two)(x=1) == {"y": 2, "z": 20}
    assert (one * other)(x=1) == ({"y": 2}, {"y": -1})
    assert ((one * other) >> two)(x=1) == {"y": -1, "z": -10}
    joined = (one * other) / [{"y": "a"}, {"y": "b"}]
    assert joined(x=1) == {"a": 2, "b": -1}
    assert (joined >> Step(lambda a, b: a + b, gives="sum"))(x=1)["sum"] == 1
    assert len(one * 3) == 3 and Identity()(x=1) == {}
    fork = one * other
    fork[1] = one
    assert fork(x=1) == ({"y": 2}, {"y": 2}) and isinstance(fork * other, Fork)
    with pytest.raises(MissingArguments, match="needs y"):
        two(x=1)
    with pytest.raises(ValueError):
        one * 0


PLAN = """
pipelines:
  - p:
      Inputs:
        - t: [{src: IN}, {package: tables}, {method: read_csv}]
      Processes:
        - doubled: {package: test, method: double_it, parameters: {df: t, column: v}}
        - both: {package: joins, method: smart_join, parameters: {left_df: t, right_df: doubled, on_cols: [k]}}
      Outputs:
        - both: both.csv
        - nothing: nothing.csv
"""


@pytest.fixture(scope="module", autouse=True)
def doubling():
    register("double_it", lambda df, column: df.withColumn(column, df[column] * 2))


def test_plan(spark, tmp_path):
    (tmp_path / "in.csv").write_text("k,v\na,1\nb,2\n")
    out = tmp_path / "out"
    out.mkdir()
    plan = build(PLAN, "p", str(out), {"t": str(tmp_path / "in.csv")})
    assert plan.references == {"doubled": ["t"], "both": ["t", "doubled"]}
    results = plan.run(spark)
    assert sorted(map(tuple, results["both"].collect())) == [("a", 1, 2), ("b", 2, 4)]
    assert sorted((out / "both.csv").read_text().split()) == ["a,1,2", "b,2,4", "k,v,v_right"] and not (out / "nothing.csv").exists()
    done = run_batch(spark, PLAN, "p", {"good": {"t": str(tmp_path / "in.csv")}, "bad": {"t": str(tmp_path / "none.csv")}}, str(tmp_path / "batch"))
    assert done["good"] == "ok" and done["bad"] != "ok"


@pytest.mark.parametrize(
    ("change", "error"),
    [
        (("pipelines", "others"), "no 'pipelines'"), (("- p:", "- q:"), "no pipeline"), (("Outputs", "Results"), "no Outputs"), (("{src: IN}, ", ""), "no src"),
        (("double_it", "os.system"), "not registered"), (("column: v", "column: v, depth: 1"), "takes no depth"), (("df: t,", "df: both,"), "comes later"),
    ],
)
def test_plan_errors(change, error):
    with pytest.raises(PlanError, match=error):
        build(PLAN.replace(*change), "p")


def plate(rows: dict[str, list[float]]) -> str:
    n = len(next(iter(rows.values())))
    lines = ["preamble", "Well Row,Well Col,Content" + ",Raw Data (600)" * n, ",,Time," + ",".join(f"{i // 4} h {15 * (i % 4)} min" for i in range(n))]
    return "\n\n".join(lines + [f"{w[0]},{w[1:]},Sample," + ",".join(f"{v:.4f}" for v in vs) for w, vs in rows.items()]) + "\n"


@pytest.fixture(scope="module")
def experiment(tmp_path_factory):
    import numpy as np
    from auxograph.operators.gompertz import curve

    folder = tmp_path_factory.mktemp("experiment")
    t = np.arange(97) / 4
    r = np.random.default_rng(1)
    wells = {f"A{c}": 0.1 * np.exp(curve(t, (0, 2.5 + 0.1 * c, 0.4, 5.0), 50) + r.normal(0, 0.005, len(t))) for c in (1, 2, 3)} | {"B1": np.full(97, 0.1)}
    (folder / "plate.csv").write_text(plate({k: list(v) for k, v in wells.items()}))
    (folder / "protocol.csv").write_text(
        "=== Experiment Data ===\nWell,Strain,Supplements,Total Volume (µL)\nA1,SLAB1,Glucose,460\nA2,SLAB2,Glucose,460\nA3,SLAB3,Glucose,460\nB1,BLANK,,460\n"
    )
    return folder


@pytest.mark.parametrize(
    ("name", "files"),
    [
        ("growth_rate_fit_pipeline", {"parsed_data.csv", "report.csv", "transformed_data.csv", "predictions.csv", "growth_rates.csv"}),
        ("growth_rate_replicates_fit_pipeline", {"parsed_data.csv", "report.csv", "predictions.csv", "growth_rates.csv"}),
        ("growth_rate_post_replicates_fit_pipeline", {"parsed_data.csv", "report.csv", "growth_rates.csv"}),
    ],
)
def test_growth_plans(spark, experiment, tmp_path, name, files):
    sources = {"raw_data": str(experiment / "plate.csv"), "meta_data": str(experiment / "protocol.csv")}
    results = build_shipped("growth.yaml", name, output_dir=str(tmp_path), sources=sources).run(spark)
    assert {f for f in os.listdir(tmp_path) if f.endswith(".csv") and not f.startswith(".")} == files
    assert results["df_report"].count() == 0
    rates = results["df_combined_fit_2" if "post" in name else "df_combined_fit"].collect()
    by = {(r["well"] if name == "growth_rate_fit_pipeline" else r["group_id"]): r for r in rates}
    if name == "growth_rate_fit_pipeline":
        assert set(by) == {"A1", "A2", "A3", "B1"} and by["A2"].mv_mu_max == pytest.approx(0.4, rel=0.1) and by["A2"].mu_max == pytest.approx(0.4, rel=0.05)
        assert not by["B1"].success
    elif "post" in name:
        assert by["A_1-3"].mu_max_mean == pytest.approx(0.4, rel=0.05) and by["A_1-3"].mv_mu_max_mean == pytest.approx(0.4, rel=0.1)
    else:
        assert set(by) == {"A_1-3", "B_1"} and by["A_1-3"].mu_max == pytest.approx(0.4, rel=0.05)


def test_model_plan(spark, tmp_path):
    (tmp_path / "model.xml").write_text(SBML.replace("D_Glucose_e", "glucose").replace('name="Proton_e"', 'name="proton"'))
    (tmp_path / "growth.csv").write_text("well,supplements,mu_max,max_value,max_time,success,total_volume_uL\nA1,Glucose,0.5,1.0,10.0,true,460\nA2,,0.1,1.0,5.0,true,460\nA3,x,0,0,0,false,460\n")
    sources = {"growth_data": str(tmp_path / "growth.csv"), "model_sbml": str(tmp_path / "model.xml"), "model_sbml_bounds": str(tmp_path / "model.xml")}
    results = build_shipped("models.yaml", "AMN_build_dataset_pipeline", output_dir=str(tmp_path), sources=sources).run(spark)
    assert results["df_AMN_input"].count() == 2
    assert {"mappings.csv", "df_flux.csv", "df_AMN_input.csv", "df_AMN_level.csv"} <= set(os.listdir(tmp_path))
    assert [r.name for r in results["df_AMN_level"].collect()] == ["level", "max_value", "ratio_drawing"]


def test_collate_plan(spark, tmp_path):
    for e, rows in (("e1", "strain,mu\nSLAB1,0.5\n"), ("e2", "strain,mu\nSLAB2,0.25\nWT1,1\n")):
        (tmp_path / "in" / e).mkdir(parents=True)
        (tmp_path / "in" / e / "growth_rates.csv").write_text(rows)
    out = tmp_path / "out"
    out.mkdir()
    results = build_shipped("models.yaml", "collate_per_strain_pipeline", output_dir=str(out), sources={"folders_list": str(tmp_path / "in")}).run(spark)
    assert [os.path.relpath(r.output_file, out) for r in results["saved_dataframes"].collect()] == ["SLAB/report.csv", "WT/report.csv"]


def test_cli(spark, tmp_path, capsys):
    (tmp_path / "p.yaml").write_text(PLAN)
    (tmp_path / "in.csv").write_text("k,v\na,1\n")
    path = str(tmp_path / "p.yaml")
    assert main(["list", path]) == 0 and capsys.readouterr().out.strip() == "p"
    assert main(["run", path, "p", "-o", str(tmp_path / "o"), "-i", f"t={tmp_path}/in.csv"], spark) == 0
    assert "both: DataFrame" in capsys.readouterr().out and (tmp_path / "o" / "both.csv").exists()
    assert main(["run", path, "q"], spark) == 1 and main(["run", path, "p", "-i", "t"], spark) == 1 and main(["list", "none.yaml"]) == 1


def test_diagrams(tmp_path):
    plan = diagrams.structure(PLAN)[0]
    assert ("t", "doubled") in plan["edges"] and ("doubled", "both") in plan["edges"] and ("both", "both_out") in plan["edges"]
    assert "t --> doubled" in diagrams.diagram(PLAN) and '"t" -> "doubled"' in diagrams.diagram(PLAN, "graphviz")
    assert "<pre" in diagrams.diagram(PLAN, "html")
    with pytest.raises(ValueError):
        diagrams.diagram(PLAN, name="q")
    (tmp_path / "p.yaml").write_text(PLAN)
    assert main(["draw", str(tmp_path / "p.yaml"), "--format", "html", "--output", str(tmp_path / "p.html")]) == 0
    with open(os.path.join(SHIPPED, "growth.yaml"), encoding="utf-8") as f:
        assert len(diagrams.plan_names(f.read())) == 3


def test_actions_overlap(spark, tmp_path):
    """Two jobs wait for each other in their tasks; a third fails, and its error comes with their results."""

    def waiting(mine, theirs):
        def rows(batches):
            import time
            from pathlib import Path

            Path(mine).touch()
            until = time.time() + 60
            while not Path(theirs).exists():
                assert time.time() < until, "the other job does not run"
                time.sleep(0.05)
            yield from batches

        return spark.range(3).repartition(1).mapInPandas(rows, "id long")

    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    shared = {"a": lambda: waiting(a, b).count(), "b": lambda: waiting(b, a).count(), "c": lambda: spark.range(1).select("nothing").count()}
    done = run_actions(spark, shared, at_once=3)
    assert list(done) == ["a", "b", "c"] and (done["a"].value, done["b"].value) == (3, 3)
    assert done["a"].error is None and "nothing" in str(done["c"].error)
    assert spark.sparkContext.getLocalProperty("spark.scheduler.pool") is None
    serial = run_actions(spark, {"x": lambda: 1 / 0, "y": lambda: 2}, at_once=1)
    assert isinstance(serial["x"].error, ZeroDivisionError) and serial["y"].value == 2
    with pytest.raises(ValueError):
        run_actions(spark, {}, at_once=0)


TWO_OUTPUTS = """
pipelines:
  - both:
      Inputs:
        - given: [{src: none}, {package: tables}, {method: read_csv}, {schema: "k string, v double"}]
      Processes:
        - good: {package: tables, method: table_function, parameters: {df: given, function: rising_runs, partition_by: [k], order_by: [v], key: k, value: v}}
        - bad: {package: test, method: broken_rows, parameters: {df: given}}
        - worse: {package: test, method: broken_rows, parameters: {df: given}}
      Outputs:
        - bad: bad.csv
        - good: good.csv
        - worse: worse.csv
"""


def test_outputs_at_once(spark, tmp_path):
    """An output that fails stops none of the others; their errors come together."""
    from pyspark.sql import functions as F

    register("broken_rows", lambda df: df.withColumn("v", F.raise_error(F.lit("broken")).cast("double")))
    (tmp_path / "in.csv").write_text("k,v\na,1\nb,\nb,3\n")
    plan = build(TWO_OUTPUTS, "both", str(tmp_path / "out"), {"given": str(tmp_path / "in.csv")})
    (tmp_path / "out").mkdir()
    with pytest.raises(ExceptionGroup, match="bad, worse failed") as raised:
        plan.run(spark, at_once=3)
    assert len(raised.value.exceptions) == 2
    assert sorted((tmp_path / "out" / "good.csv").read_text().split()) == ["a,1,1,1.0,1.0", "b,1,1,3.0,3.0", "series,run,n,first_value,last_value"]


def test_table_functions(spark):
    """Runs by hand, nulls left out; unknown functions and columns are errors before anything runs."""
    rows = [("a", 1, 1.0), ("a", 2, 2.0), ("a", 3, 2.0), ("a", 4, None), ("a", 5, 0.5), ("b", 1, None), (None, 1, 3.0), (None, 2, 1.0)]
    df = spark.createDataFrame(rows, "k string, t int, v double").repartition(3)
    got = tables.table_function(df, "rising_runs", ["k"], ["t"], key="k", value="v")
    want = [("a", 1, 3, 1.0, 2.0), ("a", 2, 1, 0.5, 0.5), (None, 1, 1, 3.0, 3.0), (None, 2, 1, 1.0, 1.0)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert tables.table_function(df.limit(0), "rising_runs", ["k"], key="k", value="v").count() == 0
    with pytest.raises(ValueError, match="no table function"):
        tables.table_function(df, "none", ["k"])
    with pytest.raises(Exception, match="has no column w"):
        tables.table_function(df, "rising_runs", ["k"], key="k", value="w").schema  # noqa: B018
    with pytest.raises(TypeError):
        tables.register_table_function("x", object)
