"""Steps whose work must be shared by tasks: files written and read, and models in parts."""

import os
import shutil

import duckdb
from auxograph import catalogue_files
from auxograph.operators import sinks
from auxograph.sources import experiments, sbml

SF = "/root/testdata/sf0.001"


def test_tasks_write_plots_under_their_names(spark, tmp_path, monkeypatch):
    def renamed(*_):
        raise AssertionError("the driver renames files one by one")

    monkeypatch.setattr(sinks, "_named_files", renamed)
    plots = spark.createDataFrame([(f"{i}.svg", f"<svg>é{i}</svg>") for i in range(20)], "file_name string, svg string").repartition(3)
    folder = str(tmp_path / "plots")
    for _ in range(2):  # the second time over the files of the first
        written = sinks.save_plots(plots, folder)
        assert sorted(written) == sorted(f"{folder}/{i}.svg" for i in range(20))
        assert sorted(os.listdir(folder)) == sorted(f"{i}.svg" for i in range(20))
        assert {r.value for r in spark.read.text(folder, wholetext=True).collect()} == {f"<svg>é{i}</svg>\n" for i in range(20)}


def test_files_of_experiments_are_opened_once(spark, tmp_path):
    for kind, text in (("raw", "Well Row,Well Col,Content,Raw Data (600)\n,,Time,0 h 0 min\nA,1,X,0.5\n"), ("protocol", "=== Experiment Data ===\nWell,Strain\nA1,S\n")):
        for i in range(3):
            path = tmp_path / kind / f"{i}.csv"
            path.parent.mkdir(exist_ok=True)
            path.write_text("nothing" if i == 2 else text)
    pairs = spark.createDataFrame([(f"e{i}", f"raw/{i}.csv", f"protocol/{i}.csv") for i in range(4)], experiments.PAIRS)
    found = experiments.read_experiments(spark, str(tmp_path / "raw"), str(tmp_path / "protocol"), pairs)
    shutil.rmtree(tmp_path / "raw")
    shutil.rmtree(tmp_path / "protocol")
    assert sorted((r.experiment, r.well, r.strain, r.od) for r in found.parsed.collect()) == [("e0", "A1", "S", 0.5), ("e1", "A1", "S", 0.5)]
    assert sorted(r.experiment for r in found.errors.collect()) == ["e2", "e2", "e3", "e3"]


def test_plates_lie_in_one_folder(spark):
    for root in catalogue_files.experiment_files(spark, SF):
        assert all(os.path.isfile(f"{root}/{name}") for name in os.listdir(root))


def test_a_model_is_written_in_parts(spark, tmp_path):
    kept = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as little as this would be one part
    try:
        root = catalogue_files.model_file(spark, SF)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", kept)
    parts = [open(f"{root}/{name}").read() for name in sorted(os.listdir(root)) if name.startswith("part-")]
    assert sum("id=" in p for p in parts) > 1
    assert all(p.startswith("<sbml") and p.endswith("</model></sbml>\n") for p in parts)
    whole = "".join(parts)
    assert whole.rindex("<parameter id=") < whole.index("<species ") < whole.rindex("<species ") < whole.index("<reaction ")
    db = duckdb.connect()
    db.execute(f"create view part as select * from '{SF}/part.parquet'")
    for read, name in ((sbml.read_exchanges, "sbml_exchanges"), (sbml.read_bounds, "sbml_bounds")):
        assert sorted(map(tuple, read(spark, root).collect())) == sorted(db.execute(catalogue_files.ORACLES[name]).fetchall())


def test_the_last_reaction_of_the_last_file_counts(spark, tmp_path):
    # the larger file is read first
    for name, n in (("part-0", 1000), ("part-1", 1)):
        reactions = "".join(f'<reaction id="EX_{name}_{i}" name="same"/>\n' for i in range(n))
        (tmp_path / f"{name}.xml").write_text(f"<sbml><model>{reactions}</model></sbml>")
    assert [tuple(r) for r in sbml.read_exchanges(spark, str(tmp_path)).collect()] == [("same", "EX_part-1_0")]
