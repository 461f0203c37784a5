import numpy as np

from skinnyla.cli import main
from skinnyla.plans import runner

from .test_factorisations import R, sample_path  # noqa: F401


def test_runs(spark, tmp_path, capsys, sample_path):  # noqa: F811
    out, sample = str(tmp_path / "out"), sample_path
    assert main(["qr", "-input", sample, "-output", out, "-subRowSize", "10", "-reduceSchedule", "4,1", "-job1ReduceTasks", "4"]) == 0
    assert "factors " in capsys.readouterr().out
    r = runner.read_matrix(spark, f"{out}/R")
    q = np.array([x.q for x in spark.read.parquet(f"{out}/Q").orderBy("row_id").collect()])
    assert q.shape == (100, 5) and np.allclose(r, R)
    assert main(["qr", "--input", sample, "--output", out, "--ingest", "false", "--factor", "false"]) == 0
    assert main(["qtb", "-input", sample, "-inputB", sample, "-output", out + "b", "-outputQ", "true"]) == 0
    assert np.allclose(runner.read_matrix(spark, f"{out}b/QtB"), r, atol=1e-9)
    assert main(["ssvd", "-input", sample, "-output", out + "s", "-rank", "2", "-powerIter", "1", "-reduceTasks", "8"]) == 0
    assert spark.read.parquet(f"{out}s/U").count() == 100 and spark.read.parquet(f"{out}s/V").count() == 5
    assert main(["dump", "-input", f"{out}/blocks"]) == 0 and "m 10, n 5" in capsys.readouterr().out
    assert main(["genr", "-size", "3", "-number", "2", "-output", out + "g"]) == 0
    assert spark.read.parquet(out + "g").count() == 2
    assert runner.gather(spark, f"{out}/blocks", "part-").count() >= 1


def test_split_grows_with_the_input(spark, tmp_path, monkeypatch):
    (tmp_path / "x").write_text("1 2\n" * 1000)
    assert runner.split_for(spark, str(tmp_path), 64) == 64
    monkeypatch.setattr(runner, "check_split", lambda split, total, memory, slots: (split, total, memory > 0, slots))
    assert runner.split_for(spark, str(tmp_path), 8) == (8, 4000, True, spark.sparkContext.defaultParallelism)
