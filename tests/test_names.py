"""Numbers of repeated names past those that exist, against the loop in path order."""

import os
import random

from lumenfold.operators import naming


def loop(rows, old):
    names = [n for _, n in sorted(rows)]
    parts = [os.path.splitext(n) for n in names]
    return dict(zip([p for p, _ in sorted(rows)], naming.assign(names, [b for b, _ in parts], [e for _, e in parts], set(old)), strict=True))


def test_many_equal_names(spark):
    rng = random.Random(4)
    rows = [(f"/s/d{rng.randrange(50):02d}/{i:05d}", rng.choice(["a.jpg"] * 9 + ["b.jpg", "c.png"])) for i in range(6000)]
    rows += [(f"/s/e{i}/{n}", n) for i in range(3) for n in ("x_1.jpg", "x.jpg")]
    old = ["a.jpg", "b_1.jpg", "b_01.jpg", "b_7.jpg", "b_900.jpg", "b_99999999999999999999.jpg", "other.jpg", "c_2.png", "x_2.jpg", *(f"a_{k}.jpg" for k in rng.sample(range(1, 9000), 2500)), *(f"a_{k}.jpg" for k in range(1000, 1100))]
    slim = spark.createDataFrame([(p, "/t", n) for p, n in rows], "path string, target_dir string, name string").repartition(6)
    out = naming.unique_names(slim, spark.createDataFrame([(f"/t/{n}",) for n in sorted(set(old))], "path string"))
    assert {r["path"]: r["target_name"] for r in out.collect()} == loop(rows, old)


def test_a_new_name_that_exists(spark):
    rows = [("/s/1", "a.jpg"), ("/s/2", "lone.jpg"), ("/s/3", "n.jpg"), ("/s/4", "n.jpg")]
    out = naming.unique_names(spark.createDataFrame([(p, "/t", n) for p, n in rows], "path string, target_dir string, name string"), spark.createDataFrame([("/t/a.jpg",), ("/t/n_1.jpg",), ("/u/lone.jpg",)], "path string"))
    assert {r["path"]: r["target_name"] for r in out.collect()} == {"/s/1": "a_1.jpg", "/s/2": "lone.jpg", "/s/3": "n.jpg", "/s/4": "n_2.jpg"}
