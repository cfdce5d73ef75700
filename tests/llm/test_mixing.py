from fractions import Fraction

from hypothesis import given, settings
from hypothesis import strategies as st

from lumenfold.llm import mixing


def test_targets():
    assert mixing.targets([100, 100, 100], [1, 2, 3]) == [Fraction(50), Fraction(100), Fraction(150)]
    # the third may take 30 only; the rest goes to the others by weight
    assert mixing.targets([100, 190, 10], [1, 2, 3]) == [Fraction(90), Fraction(180), Fraction(30)]
    assert mixing.targets([], []) == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1000), st.integers(0, 60)), min_size=1, max_size=8), st.integers(0, 200))
def test_highest_quotients(parties, seats):
    claims, caps = [a for a, _ in parties], [b for _, b in parties]
    got, plain = mixing.sainte_lague(claims, seats, caps), [0] * len(claims)
    for _ in range(seats):
        open_ = [i for i in range(len(claims)) if plain[i] < caps[i] and claims[i] > 0]
        if not open_:
            break
        plain[max(open_, key=lambda i: (Fraction(claims[i], 2 * plain[i] + 1), -i))] += 1
    assert got == plain


def test_mix_against_blocks(spark):
    """Words taken, counted block by block."""
    docs = spark.createDataFrame([(i, " ".join(["w"] * (1 + i * 7 % 50)), "abc"[i % 3] if i % 11 else None) for i in range(400)], "doc_id long, text string, source string")
    rows = mixing.mix(docs, docs_per_shard=40).collect()
    again = mixing.mix(docs.repartition(7), docs_per_shard=40).collect()
    key = lambda rs: sorted((r["doc_id"], r["taken"], r["shard"], r["shard_quota"]) for r in rs)
    assert key(rows) == key(again)
    by = {}
    for r in rows:
        by.setdefault((r["source"], r["shard"]), []).append(r)
    for shard in by.values():
        n, q = shard[0]["shard_blocks"], shard[0]["shard_quota"]
        assert q <= 3 * n
        size, taken = sum(r["size"] for r in shard), sum(r["taken"] for r in shard)
        assert (q // n) * size <= taken <= -(-q // n) * size
    for source in {r["source"] for r in rows}:
        own = [r for r in rows if r["source"] == source]
        assert own[0]["source_size"] == sum(r["size"] for r in own)
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 0.03 * own[0]["target"]
        assert all(r["taken"] <= 3 * r["size"] for r in own)


def test_sizes(spark):
    rows = spark.createDataFrame([("a\x0bb\x0cc d\te\r\nf",), (" x y",), (None,), (" ",)], "text string")
    assert [r[0] for r in rows.select(mixing.n_words("text")).collect()] == [6, 2, 0, 0]
