import random

import pytest
from pyspark.sql import functions as F

from skinnyla.functions.scalar import block_of
from skinnyla.operators.diagnostics import dump
from skinnyla.sources import matrices as mx


def write(path, *files):
    path.mkdir(exist_ok=True)
    for k, text in enumerate(files):
        (path / f"part-{k:05d}").write_text(text)
    return str(path)


def test_rows_keep_their_order_over_files_and_splits(spark, tmp_path):
    lines = ["".join(f"{i * 3 + j} " for j in range(3)) for i in range(500)]
    path = write(tmp_path / "m", "\n".join(lines[:200]) + "\n", "\n".join(lines[200:201]) + "\n", "\n".join(lines[201:]) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        m = mx.from_text(spark, path)
        got = [(r.row_id, list(r.v)) for r in m.rows.orderBy("row_id").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert m.columns == 3 and got == [(i, [i * 3.0, i * 3 + 1.0, i * 3 + 2.0]) for i in range(500)]


@pytest.mark.parametrize("text", ["1 2\n3\n", "1 2\n1  2\n", "1 2\n 1 2\n", "1 2\nx y\n"])
def test_ragged_lines_fail(spark, tmp_path, text):
    with pytest.raises(Exception, match="numbers|CAST_INVALID"):
        mx.from_text(spark, write(tmp_path / "m", text)).rows.collect()


def test_empty_input_fails(spark, tmp_path):
    with pytest.raises(ValueError):
        mx.from_text(spark, write(tmp_path / "m", ""))


def blocks_of(n, s):
    """Blocks cut every s rows; a rest shorter than s joins the last."""
    out, block = [], 1
    for r in range(n):
        if r and r % s == 0 and n - r >= s:
            block += 1
        out.append(block)
    return out


def test_block_rule(spark):
    rng = random.Random(0)
    for n, s in [(rng.randint(1, 60), rng.randint(1, 20)) for _ in range(12)] + [(5, 9), (10, 10)]:
        got = [r.b for r in spark.range(n).orderBy("id").select(block_of(F.col("id"), n, s).alias("b")).collect()]
        assert got == blocks_of(n, s), (n, s)


def test_blocks_round_trip(spark, tmp_path):
    m = mx.from_text(spark, write(tmp_path / "m", "\n".join(f"{i} {-i}" for i in range(23))))
    b = m.blocks(5)
    assert [(r.block_id, r.row_start, r.m) for r in b.orderBy("block_id").collect()] == [(1, 0, 5), (2, 5, 5), (3, 10, 5), (4, 15, 8)]
    mx.write_blocks(b, str(tmp_path / "b"))
    assert sorted(map(str, mx.read_blocks(spark, str(tmp_path / "b")).rows.collect())) == sorted(map(str, m.rows.collect()))
    text = dump(b.where("block_id = 1")).first().text
    assert text.startswith("key: 1\nm 5, n 2\n0.0 -0.0 \n1.0 -1.0 ") or text.startswith("key: 1\nm 5, n 2\n0.0 0.0 \n1.0 -1.0 ")
    mx.write_text(m, str(tmp_path / "t"))
    assert mx.from_text(spark, str(tmp_path / "t")).rows.count() == 23


def test_sparse_and_prefix(spark, tmp_path):
    coo = spark.createDataFrame([(0, 1, 2.0), (0, 1, 3.0), (4, 0, -1.0)], "row_id long, col_id int, val double")
    m = mx.from_coo(coo, 3)
    assert sorted((r.row_id, list(r.v)) for r in m.rows.collect()) == [(0, [0, 5, 0]), (4, [-1, 0, 0])]
    assert m.coo().count() == 2
    path = write(tmp_path / "m", "1 2\n", "3 4\n")
    assert mx.read_lines(spark, path, "part-00001").count() == 1 and mx.read_lines(spark, path, "Q").count() == 0
    up = mx.random_upper(spark, 3, 4).collect()
    assert len(up) == 4 and len({tuple(r.data) for r in up}) == 1 and up[0].data[3] == 0 and up[0].data[1] != 0
