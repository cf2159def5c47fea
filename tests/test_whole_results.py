"""Nothing is lost: sources by column name, strict positions, blocks beyond the broadcast bounds."""

import math
import random

import pytest

from glucoframe.operators import masking as M
from glucoframe.operators import shape
from glucoframe.operators import vectors as V
from glucoframe.sources import io as IO


def test_csv_columns_by_name(spark, tmp_path):
    (tmp_path / "a.csv").write_text("hba1c,id,types\n1.5,x,T2D\n,y,\n")
    got = [tuple(r) for r in IO.read_labels(spark, str(tmp_path), "id string, types string, hba1c double").collect()]
    assert got == [("x", "T2D", 1.5), ("y", None, None)]
    with pytest.raises(ValueError, match="age"):
        IO.read_labels(spark, str(tmp_path), "id string, age int")


def test_csv_malformed_or_other_header_raises(spark, tmp_path):
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "a.csv").write_text("id,hba1c\nx,high\n")
    with pytest.raises(Exception):
        IO.read_labels(spark, str(tmp_path / "bad"), "id string, hba1c double").collect()
    (tmp_path / "two").mkdir()
    (tmp_path / "two" / "a.csv").write_text("id,hba1c\nx,1\n")
    (tmp_path / "two" / "b.csv").write_text("hba1c,id\n2,y\n")
    with pytest.raises(Exception):
        IO.read_labels(spark, str(tmp_path / "two"), "id string, hba1c double").collect()


@pytest.mark.parametrize("rows", [[("x", 0, 1.0), ("x", 0, 9.0)], [("y", 400, 1.0)], [("z", -1, 1.0)], [("n", None, 1.0)]])
def test_to_array_refuses_lossy_positions(spark, rows):
    df = spark.createDataFrame(rows, "sample_id string, pos int, value double")
    with pytest.raises(Exception, match="to_array"):
        shape.to_array(df, "sample_id").collect()


def test_to_array_drops_on_request(spark):
    df = spark.createDataFrame([("x", 0, 1.0), ("x", 9, 2.0)], "sample_id string, pos int, value double")
    assert shape.to_array(df, "sample_id", length=3, out_of_range="drop").first().input_ids == [1.0, None, None]


def _close(a, b):
    assert a.keys() == b.keys()
    assert all(math.isclose(a[k], b[k], abs_tol=1e-12) for k in a)


def test_clusters_in_blocks(spark):
    rng = random.Random(4)
    vec = [[rng.gauss(0, 1) for _ in range(5)] for _ in range(60)]
    refs = spark.createDataFrame([(f"C{i % 11:02d}", v) for i, v in enumerate(vec)], "cluster string, vec array<double>")
    targets = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(5)]) for i in range(20)] + [(20, [0.0] * 5)],
                                    "vec_id long, vec array<double>")

    def sims(**kw):
        return {(r.vec_id, r.cluster): r.sim for r in V.cluster_similarity(targets, refs, **kw).collect()}

    def best(**kw):
        return {r.vec_id: r.cluster for r in V.assign_cluster(targets, refs, **kw).collect()}

    assert len(sims()) == 21 * 11
    _close(sims(), sims(max_clusters=3))
    assert best() == best(max_clusters=3)
    assert best()[20] == "C00"  # all scores are 0, the smallest name wins


def test_adjusted_mutual_information_in_blocks(spark):
    rng = random.Random(5)
    df = spark.createDataFrame([(f"a{rng.randrange(6) ** 2}", f"b{rng.randrange(5) ** 2}") for _ in range(400)], "a string, b string")
    one = V.adjusted_mutual_information(df, "a", "b").first().asDict()
    _close(one, V.adjusted_mutual_information(df, "a", "b", max_sizes=2, step=7).first().asDict())


def test_mutual_information_has_no_one_task_window(spark):
    df = spark.createDataFrame([("x", "u"), ("y", "v"), ("y", "u")], "a string, b string")
    plan = V.mutual_information(df, "a", "b")._jdf.queryExecution().executedPlan().toString()
    assert "windowspecdefinition(specifiedwindowframe" not in plan


def test_masked_rows_are_complete(spark):
    toks = spark.createDataFrame([("s", p, 50 + p, 0) for p in (1, 2, 4)] + [("t", 5, 60, 0)], "sample_id string, tpos int, token int, scope int")
    probs = spark.createDataFrame([(0, 51, 1.0), (0, 52, 0.0), (0, 60, 1.0)], "scope int, token int, prob double")
    for most in (10, 0):  # broadcast, salted
        out = M.masked_rows(M.apply_mask(M.attach_probs(toks, probs, most=most)), length=5)
        got = {r.sample_id: (r.input_ids, r.labels) for r in out.collect()}
        ids, labels = got["s"]
        assert labels == [-100, 51, -100, -100, -100, -100]
        assert [ids[i] for i in (0, 2, 3, 4, 5)] == [265, 52, 264, 54, 264]
        assert got["t"][1] == [-100] * 5 + [60] and got["t"][0][:5] == [265] + [264] * 4
