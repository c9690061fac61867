import pytest
from auxograph.functions.time_labels import with_time
from auxograph.functions.values import number
from auxograph.operators.plates import parse, replicates_by_well, report
from auxograph.sources import exchanges, experiments, sbml, tables
from auxograph.sources.plate_export import in_plate_order, read_plate
from auxograph.sources.protocol import read_protocol
from pyspark.errors import PySparkException

PLATE = """User: me,,

Test run 1,,

Well Row,Well Col,Content,Raw Data (600),Raw Data (600),Raw Data (600)

,,Time,0 h ,0 h 15 min,0 h 60 min

A,1,Sample X1,0.081,0.09,bad

B,2,Sample X2,0.1,,0.3
"""
PROTOCOL = """=== Experiment Data ===
 Well ,Strain,Media Type,Supplements,Total Volume (µL)
A1, SLAB1 ,2x_M9,Glucose;Ala,460
B2,Blank,2x_M9,"Sucrose, fine",x
A1,SLAB9,2x_M9,Other,1
=== Notes ===
nothing
"""
SBML = """<?xml version="1.0"?>
<sbml xmlns="http://www.sbml.org/sbml/level3/version1/core" xmlns:fbc="http://www.sbml.org/sbml/level3/version1/fbc/version2">
 <model id="m">
  <listOfSpecies><species id="M_glc_e" name="D_Glucose_e"/><species id="M_o2_e" name=""/></listOfSpecies>
  <listOfParameters><parameter id="top" value="1000000"/><parameter id="ten" value="10.7"/></listOfParameters>
  <listOfReactions>
   <reaction id="R_EX_glc__D_e" name="glucose exchange" fbc:upperFluxBound="ten"><listOfReactants><speciesReference species="M_glc_e"/></listOfReactants></reaction>
   <reaction id="EX_o2_e" name="oxygen exchange" fbc:upperFluxBound="top"><listOfReactants><speciesReference species="M_o2_e"/></listOfReactants></reaction>
   <reaction id="EX_h_e" name="Proton_e"><kineticLaw><listOfParameters><parameter id="UPPER_BOUND" value="25"/></listOfParameters></kineticLaw></reaction>
   <reaction id="PGI" name="inside"/>
  </listOfReactions>
 </model>
</sbml>
"""


@pytest.fixture
def files(tmp_path):
    (tmp_path / "plate.csv").write_text(PLATE, encoding="utf-8")
    (tmp_path / "protocol.csv").write_text(PROTOCOL, encoding="utf-8")
    (tmp_path / "model.xml").write_text(SBML, encoding="utf-8")
    return tmp_path


def test_time_labels(spark):
    vectors = {
        "3 h 15 min": (3.25, 3, 15), "0 h 60 min": (1.0, 1, 0), "2 h": (2.0, 2, 0), "30 min": (0.5, 0, 30), "": (0.0, 0, 0),
        "0 h ": (0.0, 0, 0), "1 h 20 min": None, "n/a": (None, None, None), None: (0.0, 0, 0), "1 h": (1.0, 1, 0),
    }
    rows = with_time(spark.createDataFrame([(k,) for k in vectors], "time_label string")).collect()
    for r in rows:
        if (want := vectors[r.time_label]) is not None:
            assert (r.time_h, r.time_h_int, r.time_min_int) == want
            assert r.time_min == (None if want[0] is None else round(want[0] * 60, 3))


def test_numbers(spark):
    rows = spark.createDataFrame([(x,) for x in ("1.5", " 2 ", "x", "", None, "NaN", "Infinity")], "t string")
    assert [r.n for r in rows.select(number("t").alias("n")).collect()] == [1.5, 2.0, None, None, None, None, None]


def test_plate(spark, files):
    rows = in_plate_order(read_plate(spark, str(files / "plate.csv"), "od600")).collect()
    assert [(r.well, r.time_label, r.od600) for r in rows] == [
        ("A1", "0 h", 0.081), ("A1", "0 h 15 min", 0.09), ("A1", "0 h 60 min", None),
        ("B2", "0 h", 0.1), ("B2", "0 h 15 min", None), ("B2", "0 h 60 min", 0.3),
    ]
    assert [r.time_min for r in rows[:3]] == [0.0, 15.0, 60.0]
    (files / "empty.csv").write_text("nothing\nhere\n")
    with pytest.raises(PySparkException, match="no line starts with"):
        read_plate(spark, str(files / "empty.csv")).collect()


def test_protocol(spark, files):
    rows = {r.well: r for r in read_protocol(spark, str(files / "protocol.csv")).collect()}
    assert set(rows) == {"A1", "B2"}
    assert (rows["A1"].strain, rows["A1"].total_volume_uL, rows["A1"].is_blank) == ("SLAB1", 460.0, False)
    assert (rows["B2"].supplements, rows["B2"].total_volume_uL, rows["B2"].is_blank) == ("Sucrose, fine", None, True)
    (files / "none.csv").write_text("=== Other ===\nWell\nA1\n")
    with pytest.raises(ValueError, match="no section"):
        read_protocol(spark, str(files / "none.csv"))


def test_parse_and_report(spark, files):
    readings, protocol = read_plate(spark, str(files / "plate.csv"), "od600"), read_protocol(spark, str(files / "protocol.csv"))
    parsed = parse(readings, protocol, "od600")
    assert parsed.columns[0] == "well" and parsed.columns[-1] == "od600" and parsed.count() == 6
    found = {r.issue: (r["count"], r.wells) for r in report(readings, protocol.where("well = 'A1'"), "od600").collect()}
    assert found == {"wells_missing_in_metadata": (1, "B2"), "non_numeric_od600_values": (2, None)}
    assert report(readings.where("od600 is not null"), protocol, "od600").count() == 0
    with pytest.raises(ValueError, match="not unique"):
        parse(readings, protocol.union(protocol), "od600")


def test_sbml(spark, files):
    path = str(files / "model.xml")
    assert {(r.name, r.exchange_reaction) for r in sbml.read_exchanges(spark, path).collect()} == {
        ("d glucose", "EX_glc__D_e"), ("m o2", "EX_o2_e"), ("proton", "EX_h_e"),
    }
    assert {(r.exchange_reaction, r.level, r.max_value) for r in sbml.read_bounds(spark, path).collect()} == {
        ("EX_glc__D_e", 1, 10), ("EX_o2_e", 1, 1000), ("EX_h_e", 1, 25),
    }


def test_mapping_files(tmp_path):
    (tmp_path / "m.csv").write_text("meta,raw\na,b\nc,d\n")
    (tmp_path / "m.yaml").write_text("a: b\n")
    (tmp_path / "m.py").write_text("x = 1\nfile_mapping = {'a': 'b'}\n")
    (tmp_path / "m.txt").write_text("{'a': 'b'}")
    (tmp_path / "bad.py").write_text("file_mapping = open('x')\n")
    assert tables.load_mapping(str(tmp_path / "m.csv")) == {"a": "b", "c": "d"}
    for name in ("m.yaml", "m.py", "m.txt"):
        assert tables.load_mapping(str(tmp_path / name)) == {"a": "b"}
    for name, error in (("bad.py", ValueError), ("none.csv", FileNotFoundError)):
        with pytest.raises(error):
            tables.load_mapping(str(tmp_path / name))


def test_folders_and_pairs(spark, tmp_path):
    for name, rows in (("e2", "strain,mu\nSLAB1,0.5\n"), ("e1", "strain,mu,extra\nWT2,0.25,1\n")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "growth.csv").write_text(rows)
    folders = tables.list_folders(str(tmp_path))
    assert [f.rsplit("/", 1)[1] for f in folders] == ["e1", "e2"]
    rows = tables.read_folders(spark, folders, "growth.csv").collect()
    assert {(r.experiment, r.strain, r.extra) for r in rows} == {("e1", "WT2", 1), ("e2", "SLAB1", None)}
    for n in ("r2.csv", "r1.csv", "r3.csv", "p1.txt", "p2.txt"):
        (tmp_path / n).write_text("")
    assert tables.pair_files(str(tmp_path), "r*.csv", "p*.txt") == {"r1.csv": "p1.txt", "r2.csv": "p2.txt"}
    with pytest.raises(ValueError):
        tables.list_folders(str(tmp_path / "r1.csv"))


def test_literal_tables(spark):
    assert exchanges.supplement_exchanges(spark).count() == 25 and exchanges.minimal_medium(spark).count() == 23
    custom = exchanges.load_custom_mapping()
    assert len(custom) == 69 and custom["na2hpo4"]["compounds"].count("sodium") == 2


def test_infinite_bounds_and_long_plates(spark, tmp_path):
    model = '<sbml><model><parameter id="u" value="INF"/>\n<reaction id="R_EX_a_e" upperFluxBound="u"/>\n<reaction id="R_EX_b_e" upperFluxBound="v"/></model></sbml>'
    (tmp_path / "m.xml").write_text(model)
    assert {tuple(r) for r in sbml.read_bounds(spark, str(tmp_path / "m.xml")).collect()} == {("EX_a_e", 1, 1000), ("EX_b_e", 1, 1000)}
    n = 100_500
    head = "Well Row,Well Col,Content" + ",Raw Data" * n + "\n,,Time," + ",".join(f"{i} min" for i in range(n))
    (tmp_path / "p.csv").write_text(head + "\nA,1,X," + ",".join(map(str, range(n))) + "\n")
    (tmp_path / "q.csv").write_text("Well Row,Well Col,Content,Raw Data")
    plate = read_plate(spark, [str(tmp_path / "p.csv"), str(tmp_path / "q.csv")])
    assert plate.count() == n and plate.where("od <> time_min").count() == 0
    assert "Exchange" not in plate._jdf.queryExecution().executedPlan().toString()


def test_static_table(spark, tmp_path):
    (tmp_path / "n.csv").write_text("name,iupac,exchange\nwater,oxidane,EX_h2o_e\nair,,EX_o2_e\n")
    assert [tuple(r) for r in exchanges.read_name_exchanges(spark, str(tmp_path / "n.csv")).collect()] == [("water", "oxidane", "EX_h2o_e"), ("air", None, "EX_o2_e")]


def test_experiments(spark, tmp_path):
    """Plates with protocols of differing columns in one job; broken files are told, and stop nothing."""
    plate = lambda *v: "x\nWell Row,Well Col,Content,Raw Data\n,,Time,0 h\n" + "\n".join(f"A,{i + 1},c,{x}" for i, x in enumerate(v))
    files = {
        "raw_1.csv": plate(1.0, 2.0), "raw_2.csv": plate(3.0), "raw_3.csv": "no header", "raw_4.csv": plate(4.0), "raw_5.csv": plate(5.0),
        "protocol_1.csv": "=== Experiment Data ===\nWell,Strain\nA1,one\nA1,two", "protocol_2.csv": '=== Experiment Data ===\nNote,Total Volume (µL), Well \n"a, b",7,A1',
        "protocol_3.csv": "=== Experiment Data ===\nWell\nA1", "protocol_4.csv": "=== Other ===\nWell\nA1", "protocol_5.csv": "=== Experiment Data ===\nStrain\nx", "unrelated.csv": "x",
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
    pairs = experiments.pairs_by_rank(spark, str(tmp_path), "raw*.csv", "protocol*.csv")
    assert [(r.experiment, r.protocol_file[-5:]) for r in pairs.orderBy("experiment").collect()] == [(f"raw_{i}", f"{i}.csv") for i in range(1, 6)]
    named = [("shared", "raw_1.csv", "protocol_2.csv"), ("twice", "raw_1.csv", "protocol_1.csv"), ("twice", "raw_2.csv", "protocol_1.csv")]
    more = experiments.pairs_of(spark, {"raw_9.csv": "protocol_1.csv"}).unionByName(spark.createDataFrame(named, experiments.PAIRS))
    found = experiments.read_experiments(spark, f"{tmp_path}/raw*", f"{tmp_path}/protocol*", pairs.unionByName(more))
    got = {(r.experiment, r.well): (r.od, r.strain, r.total_volume_uL, r.is_blank) for r in found.parsed.collect()}
    assert got == {
        ("raw_1", "A1"): (1.0, "one", None, False), ("raw_1", "A2"): (2.0, None, None, None), ("raw_2", "A1"): (3.0, None, 7.0, None),
        ("shared", "A1"): (1.0, None, 7.0, None), ("shared", "A2"): (2.0, None, None, None),
    }
    wrong = {r.experiment: r.error for r in found.errors.collect()}
    assert set(wrong) == {"raw_3", "raw_4", "raw_5", "raw_9", "twice"} and wrong["raw_9"] == "no such file" and "no section" in wrong["raw_4"]
    # what comes after takes the experiment as a key
    assert replicates_by_well(found.parsed, sample_size=1, by=["experiment"]).count() == 5
    with pytest.raises(ValueError, match="raw_3"):
        experiments.parsed_experiments(spark, str(tmp_path), "raw*.csv", "protocol*.csv")
    assert experiments.parsed_experiments(spark, str(tmp_path), "raw_[12].csv", "protocol_[12].csv").count() == 3
