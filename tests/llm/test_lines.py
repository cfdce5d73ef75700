import duckdb
import pandas as pd

from lumenfold.llm import lines


def test_against_sql(spark):
    rows = []
    for i in range(120):
        parts = [f"own line number {i} here", "ab cd"]
        parts += ["seen on every site always"] if i % 2 else []
        parts += ["  seen on three sites only "] if i % 20 in (0, 1, 2) else []
        parts += ["seen on two sites only"] if i % 20 in (3, 4) else []
        parts += ["", "seen on every site always"] if i % 9 == 0 else []
        rows.append((i, "\n".join(parts), f"s{i % 20}" if i % 20 else None))
    frame = pd.DataFrame(rows, columns=["doc_id", "text", "source"])
    got = lines.line_dedup(spark.createDataFrame(rows, "doc_id long, text string, source string")).select("doc_id", "n_lines", "n_removed", "text")
    con = duckdb.connect()
    con.register("documents", frame)
    expected = con.execute(lines.OP9_SQL).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(expected)
    assert sum(r[2] for r in expected) > 60


def test_wide_and_close_lines_agree(spark):
    """Every threshold gives the exact distinct counts, whether the sketch or the count decides."""
    rows = [(i, f"line of {n} sites", f"s{i}", h) for h, n in enumerate(range(1, 41)) for i in range(n)]
    own = spark.createDataFrame(rows, "doc_id long, line string, site string, h1 long").selectExpr("doc_id", "doc_id AS text_hash", "0 AS pos", "site", "h1", "h1 AS h2")
    for threshold in (2, 3, 5, 10, 20):
        assert {r["h1"] for r in lines.boilerplate(own, threshold).collect()} == {h for h, n in enumerate(range(1, 41)) if n >= threshold}
