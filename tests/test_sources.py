"""Text, binary and history sources with the awkward inputs."""

import struct

import numpy as np
import pytest

from gradframe.sources import fixedrecord, history, images, scores, tables


def rows_of(df):
    return [(r["id"], list(r["x"]), list(r["y"])) for r in df.orderBy("id").collect()]


def test_malformed_lines_go_to_the_side_table(spark, tmp_path):
    f = tmp_path / "a.csv"
    f.write_text("a,b,c\n# note\n1,2,0\n\n3,x,1\n4,5\n 6 , 7,1\n8,9,1,2\n")
    got = rows_of(tables.read_table(spark, str(f), header=True, width=3))
    assert got == [(0, [1.0, 2.0], [0.0]), (1, [6.0, 7.0], [1.0])]
    bad = tables.read_rejects(spark, str(f), header=True, width=3)
    assert {r["line"] for r in bad.collect()} == {"3,x,1", "4,5", "8,9,1,2"}


def test_roles_and_separators(spark, tmp_path):
    f = tmp_path / "a.txt"
    f.write_text("1::2::3::4\n5::6::7::8\n")
    got = rows_of(tables.read_table(spark, str(f), "::", y=[0, 3], skip=[-1, 1]))
    assert got == [(0, [3.0], [1.0, 4.0]), (1, [7.0], [5.0, 8.0])]


def test_ids_run_through_files_and_blocks(spark, tmp_path):
    for name in "abc":
        lines = [f"{ord(name)},{i},0" for i in range(500)]
        (tmp_path / f"{name}.csv").write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        got = rows_of(tables.read_table(spark, str(tmp_path)))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [g[0] for g in got] == list(range(1500))
    assert [g[1] for g in got] == [[float(ord(n)), float(i)] for n in "abc" for i in range(500)]
    first = rows_of(tables.read_table(spark, str(tmp_path), first=700))
    assert first == got[:700]
    shard = rows_of(tables.read_table(spark, str(tmp_path), shard=(4, 3)))
    assert shard == got[3::4]


def test_sequences(spark, tmp_path):
    f = tmp_path / "a.csv"
    f.write_text("1,1,2,3,4\n0,5,6\n0,7\nx,1,2\n")
    got = tables.read_sequences(spark, str(f), unit=2).orderBy("id").collect()
    assert [(r["xs"], r["y"]) for r in got] == [([[1.0, 2.0], [3.0, 4.0]], [1.0]), ([[5.0, 6.0]], [0.0])]


def test_write_table_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(0, [0.1, 1e-9], [1.0]), (1, [2.0, 3.5], [0.0])], "id bigint, x array<double>, y array<double>")
    tables.write_table(df.coalesce(1), str(tmp_path / "out"))
    assert rows_of(tables.read_table(spark, str(tmp_path / "out"))) == rows_of(df)


def test_records_are_split_and_numbered(spark, tmp_path):
    for name, values in (("b", range(100, 150)), ("a", range(100))):
        (tmp_path / name).write_bytes(b"HEAD" + b"".join(struct.pack("<if", v, v / 2) for v in values))
    df = fixedrecord.read_records(spark, str(tmp_path), 8, 4, split_bytes=64)
    assert df.rdd.getNumPartitions() == 20
    got = fixedrecord.decode(df, {"a": ("<i4", 0), "b": ("<f4", 0)}).orderBy("row").collect()
    assert [(r["row"], r["a"], r["b"]) for r in got] == [(v, v, v / 2) for v in range(150)]


def test_pixels_are_unsigned_unless_asked(spark, tmp_path):
    image_file, label_file = images.MNIST[True]
    (tmp_path / image_file).write_bytes(bytes(16) + bytes([200] * 784 + [3] * 784))
    (tmp_path / label_file).write_bytes(bytes(8) + bytes([7, 1]))
    got = images.mnist(spark, str(tmp_path)).orderBy("id").collect()
    assert [(r["x"][0], r["y"].index(1.0)) for r in got] == [(200.0, 7), (3.0, 1)]
    signed = images.mnist(spark, str(tmp_path), signed=True, first=1).collect()
    assert [r["x"][0] for r in signed] == [-56.0]


def test_cifar_batches_are_one_set(spark, tmp_path):
    for i, name in enumerate(images.CIFAR10[True]):
        (tmp_path / name).write_bytes(b"".join(bytes([i]) + bytes([i * 10 + r] * 3072) for r in range(3)))
    got = images.cifar(spark, str(tmp_path)).orderBy("id").collect()
    assert [(r["id"], r["y"].index(1.0), r["x"][5]) for r in got] == [
        (3 * i + r, i, float(i * 10 + r)) for i in range(5) for r in range(3)
    ]


def test_history_imports(spark, tmp_path):
    (tmp_path / "h.txt").write_text("0,0.5,10,1,2\n1,1.5,20,3,4\n")
    (tmp_path / "h.bin").write_bytes(
        struct.pack("<idQ2d", 0, 0.5, 10, 1, 2) + struct.pack("<idQ2d", 1, 1.5, 20, 3, 4)
    )
    want = [(0, 0.5, 10, [1.0, 2.0]), (1, 1.5, 20, [3.0, 4.0])]
    for df in (history.read_text(spark, str(tmp_path / "h.txt")), history.read_binary(spark, str(tmp_path / "h.bin"), 2)):
        assert [tuple(r) for r in df.orderBy("iter").collect()] == want
        assert tuple(history.last(df)) == want[1]
        assert [tuple(r) for r in history.nth(df, 0).collect()] == want[:1]


def test_model_file(spark, tmp_path):
    (tmp_path / "m.txt").write_text("2-1-1\n1,2,3\n4,5\n")
    got = history.read_model(spark, str(tmp_path / "m.txt"), shape_line=True).orderBy("j").collect()
    assert [tuple(r) for r in got] == [(j, float(j + 1)) for j in range(5)]


def test_gradient_blocks(spark, tmp_path):
    values = np.arange(2 * 3 * 2, dtype="<f8")
    (tmp_path / "g.bin").write_bytes(values.tobytes())
    got = scores.read_gradients(spark, str(tmp_path / "g.bin"), points=3, width=2).orderBy("iter", "id").collect()
    assert [(r["iter"], r["id"], r["g"]) for r in got] == [
        (i, p, [float(6 * i + 2 * p), float(6 * i + 2 * p + 1)]) for i in range(2) for p in range(3)
    ]


@pytest.mark.parametrize("columns", [4, 5, 6, 7])
def test_score_layouts(spark, tmp_path, columns):
    (tmp_path / "s.csv").write_text(",".join(str(i) for i in range(columns)) + "\n")
    row = scores.read_scores(spark, str(tmp_path / "s.csv"), columns).first()
    assert row["iteration"] == 0.0 and row["loss"] == (3.0 if columns == 7 else 2.0)
