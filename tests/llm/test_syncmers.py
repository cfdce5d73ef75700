import hashlib

import numpy as np

from lumenfold.llm import syncmers as S


def plain_anchors(text, k, s):
    """Closed syncmers by their definition, with the module's hash of substrings."""
    points = S.code_points(text)
    out = []
    for i in range(len(text) - k + 1):
        window = points[i : i + k]
        small = [int(S.anchors(window[j : j + s], s, s)[1][0]) for j in range(k - s + 1)]
        if min(small) in (small[0], small[-1]):
            out.append(i)
    return out


def test_anchors_by_definition():
    rng = np.random.default_rng(0)
    text = "".join(rng.choice(list("abé\U0001f600"), 300))
    # with k = s the hash of a window is a function of its one substring's hash, so ranks differ: compare by own ranks
    k, s = 12, 5
    at, _ = S.anchors(S.code_points(text), k, s)
    codes = S.code_points(text).astype(np.uint64)
    h = []
    for i in range(len(text) - s + 1):
        x = np.zeros(1, dtype=np.uint64)
        x[0] = codes[i]
        for j in range(1, s):
            x = x * S._MIX + codes[i + j]
        h.append(int(S.mixed(x.copy())[0]))
    expected = [i for i in range(len(text) - k + 1) if min(h[i : i + k - s + 1]) in (h[i], h[i + k - s])]
    assert at.tolist() == expected


def test_anchors_do_not_depend_on_context():
    rng = np.random.default_rng(1)
    word = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    passage = word(400)
    a, b = word(123) + passage + word(50), word(31) + passage
    move, agree = S.shift(a, b)
    assert move == 31 - 123 and agree > 20


def plain_likeness(a, b, least=S.LEAST, share=S.SHARE):
    """By the definition, over lists of (hash, position)."""
    k, s = S.window_of(min(len(a), len(b)))
    kept, bounds = [], []
    for t in (a, b):
        at, h = S.anchors(S.code_points(t), k, s)
        own = sorted(zip(h.tolist(), at.tolist(), strict=True))
        if not own and t:
            own = [(int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8).digest(), "little"), 0)]
        bound = max((1 << 64) // share - 1, own[least - 1][0]) if len(own) > least else 1 << 64
        bounds.append(bound if any(x > bound for x, _ in own) else 1 << 64)
        kept.append(own)
    kept = [[(h, p) for h, p in own if h <= min(bounds)] for own in kept]
    if not kept[0] or not kept[1]:
        return float(not kept[0] and not kept[1])
    moves = []
    for h in {h for h, _ in kept[0]}:
        moves += [y - x for x, y in zip([p for g, p in kept[0] if g == h], [p for g, p in kept[1] if g == h])]  # noqa: B905
    n = len(moves) if len(moves) < 8 else sum(moves.count(m) > 1 for m in moves)
    return n / (len(kept[0]) + len(kept[1]) - n)


def test_sketches():
    texts = ["", "short", "short", "x" * 500, "the quick brown fox jumps over the lazy dog " * 3, "".join(map(chr, range(200, 40_000)))]
    own = S.sketches(texts)
    assert [S.text_of(x) for x in own] == [S.text_of(S.sketches([t])[0]) for t in texts]
    assert S.likeness(own[0], own[0]) == 1.0 and S.likeness(own[0], own[1]) == 0.0 and S.likeness(own[1], own[2]) == 1.0
    for t, x in zip(texts, own, strict=True):
        at, h = S.anchors(S.code_points(t), *S.window_of(len(t)))
        assert len(x.at) >= min(S.LEAST, len(at)) and set(zip(x.at.tolist(), x.hashes.tolist(), strict=True)) <= set(zip(at.tolist(), h.tolist(), strict=True))
        assert {v for v in h.tolist() if v <= x.bound} == set(x.hashes.tolist())
    assert len(own[5].at) > S.LEAST < len(S.anchors(S.code_points(texts[5]))[0])


def test_half_a_text_is_never_lost():
    rng = np.random.default_rng(4)
    for n in [*range(2, 130), 1000, 30_000]:
        a, b = ("".join(rng.choice(list("abcdefgh "), n)) for _ in range(2))
        e = a[: n - n // 2] + b[: n // 2]
        x, y = S.sketches([a, e])
        assert S.likeness(x, y) > 0


def test_estimates_of_long_texts():
    """Against all anchors: within four standard errors."""
    rng = np.random.default_rng(6)
    for n in (3000, 20_000, 100_000):
        a = "".join(rng.choice(list("abcdefgh "), n))
        b = a[: n // 3] + "".join(rng.choice(list("abcdefgh "), n // 2)) + a[n // 3 :]
        exact = S.likeness(*S.sketches([a, b], least=10**9))
        x, y = S.sketches([a, b])
        assert abs(S.likeness(x, y) - exact) < 4 * (exact * (1 - exact) / min(len(x.at), len(y.at))) ** 0.5
        assert abs(exact - 2 / 3) < 0.03


def test_next_documents_over_many_ranges(spark, monkeypatch):
    rng = np.random.default_rng(2)
    word = [f"{''.join(rng.choice(list('abcd é'), 7))} " for _ in range(60)]
    rows = [(int(i) * 3, "".join(rng.choice(word if i % 3 else list("abcd é"), int(rng.integers(0, 300 if i % 20 else 3000))))) for i in range(211)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    real = S.with_next
    monkeypatch.setattr(S, "with_next", lambda d: real(d, rows_per_range=10))
    got = {r["doc_id"]: r for r in S.compared(docs).collect()}
    assert len(got) == len(rows)
    for n, (i, a) in enumerate(rows):
        b = rows[(n + 1) % len(rows)][1]
        edited = a[: len(a) - len(a) // 2] + b[: len(a) // 2]
        r = got[i]
        fa, fe = S.sketches([a, edited])
        assert r["n_chars"] == len(a) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert (r["fingerprint"], r["edited_fingerprint"]) == (S.text_of(fa), S.text_of(fe))
        assert (r["near_edited"], r["near_next"]) == (plain_likeness(a, edited), plain_likeness(a, b))


def test_one_document_is_its_own_next(spark):
    r = S.compared(spark.createDataFrame([(None, "alone in the table")], "doc_id long, text string")).collect()
    assert [(x["n_chars"], x["near_next"]) for x in r] == [(18, 1.0)]
