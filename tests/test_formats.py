import io
import random

import pytest
from auxograph.functions.stored import folder
from auxograph.sources import formats
from auxograph.sources.plate_export import read_plate, readings_of_lines, text_lines
from auxograph.sources.protocol import sections

PLATE = "User: me,,\r\n\r\nWell Row,Well Col,Content,Raw Data (600),Raw Data (600)\r\n \r\n,,Time,0 h ,0 h 15 min\r\n\r\n{}\r\n"
PROTOCOL = "before\n=== General ===\nby,x\n=== Experiment Data ===\nWell\nold\n\n===  Experiment Data===\r  Well ,Strain\rA1,é\n===Empty===\n"


def wells(n, first=1):
    return "\r\n".join(f"{'ABCDEFGH'[i % 8]},{i},Sample X{i}, {i / 7:.3f},{'' if i % 5 else 'bad'}" for i in range(first, first + n))


def plates(root, names=("a", "b c", "sub/d=1")):
    for i, n in enumerate(names):
        path = root / f"{n}.csv"
        path.parent.mkdir(parents=True, exist_ok=True)
        text = PLATE.format(wells(5 + 40 * i))
        path.write_bytes((text if i % 2 else text.replace("\r\n", "\n")).encode())
    (root / "_hidden.csv").write_text("nothing")
    (root / "empty-labels.csv").write_text("Well Row,Well Col,Content,Raw Data (600)\n")


def test_lines_of_ranges():
    """Whatever the ranges and blocks, each line comes once, at its place."""
    random.seed(1)
    for _ in range(300):
        data = "".join(random.choices(["a", "é", "\r", "\n", "\r\n", "bc"], k=random.randint(0, 30))).encode()
        want, at = [], 0
        for line in formats._END.split(data):
            want.append((data.find(line, at) if line else at, line))
            at = want[-1][0] + len(line)
            at += len(formats._END.match(data, at).group()) if at < len(data) else 0
        if want[-1][1] == b"":
            want.pop()
        cuts = sorted({0, len(data), *random.choices(range(len(data) + 1), k=3)})
        got = [x for a, b in zip(cuts, cuts[1:]) for x in formats.lines(io.BytesIO(data), a, b, random.randint(1, 9))]
        assert got == want, data


def test_packs():
    files = [(0, "a", 5), (1, "b", 0), (2, "c", 3 * formats.TASK_BYTES + 1)]
    packs = formats.packed(files, formats.TASK_BYTES, False)
    covered = [r for p in packs for r in p.ranges]
    assert [r for r in covered if r[0] != "c"] == [("a", 0, 5), ("b", 0, 0)] and len(packs[0].ranges) == 2
    of_c = [r for r in covered if r[0] == "c"]
    assert of_c[0][1] == 0 and of_c[-1][2] == files[2][2] and all(x[2] == y[1] for x, y in zip(of_c, of_c[1:]))
    assert len(formats.packed(files, formats.TASK_BYTES, True)) == 2


@pytest.mark.parametrize("size", [301, 1 << 20])
def test_plates_are_read_as_by_read_plate(spark, tmp_path, size):
    plates(tmp_path)
    formats.register_formats(spark)
    rows = spark.read.format("plate_export").option("maxBytes", size).load(str(tmp_path))
    want = read_plate(spark, [str(tmp_path / n) for n in ("a.csv", "b c.csv", "sub/d=1.csv", "empty-labels.csv")])
    got = readings_of_lines(rows)
    assert got.columns == want.columns and got.count() == 2 * (5 + 45 + 85)
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0
    spark.sql(f"create or replace temporary view lines_of_plates using plate_export options (path '{tmp_path}', pathGlobFilter 'a*')")
    assert spark.table("lines_of_plates").count() == 5


def test_protocols(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"p{i}.csv").write_bytes((PROTOCOL * (i + 1)).encode())
    formats.register_formats(spark)
    got = spark.read.format("protocol").load(str(tmp_path)).drop("error")
    want = sections(text_lines(spark, str(tmp_path))).select(got.columns)
    assert got.count() == want.count() == 12
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0


def test_errors(spark, tmp_path):
    plates(tmp_path, ("a",))
    (tmp_path / "bad.csv").write_text("nothing\n" * 50)
    formats.register_formats(spark)
    read = spark.read.format("plate_export").option("maxBytes", 100)
    with pytest.raises(Exception, match="no line starts with"):
        read.load(str(tmp_path)).collect()
    kept = read.option("errors", "rows").load(str(tmp_path))
    bad = kept.where("error is not null").collect()
    assert [(r.source_file.endswith("bad.csv"), r.line) for r in bad] == [(True, None)]
    assert readings_of_lines(kept).count() == 10
    (tmp_path / "none").mkdir()
    assert read.load(str(tmp_path / "none")).count() == 0


def test_stream(spark, tmp_path):
    """Files that come between runs are read once; a run without new files adds nothing."""
    source, out, seen = tmp_path / "in", folder(spark, "out"), folder(spark, "seen")
    source.mkdir()
    formats.register_formats(spark)

    def run():
        lines = spark.readStream.format("plate_export").option("settle", 0).option("maxBytes", 90).load(str(source))
        readings_of_lines(lines).writeStream.format("parquet").option("checkpointLocation", seen).trigger(availableNow=True).start(out).awaitTermination()
        return spark.read.schema(readings_of_lines(spark.read.format("plate_export").load(str(source))).schema).parquet(out)

    plates(source, ("a",))
    assert run().count() == 10
    plates(source / "later", ("b", "c"))
    got, want = run(), read_plate(spark, [str(source / n) for n in ("a.csv", "later/b.csv", "later/c.csv")])
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0 and got.count() == want.count()
    assert run().count() == want.count()
