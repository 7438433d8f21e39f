"""Jaccard groups, repeated strings and nearest neighbours against brute force."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import docs_frame, words
from pyspark.sql import functions as F

from fieldtally.llm import jaccard, nearest, repeats


def shingles(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain_groups(rows):
    sets = [(d, shingles(t)) for d, t in rows]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for d, s in sets:
        if d is not None:
            root(d)
    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if a is not None and b is not None and s and t and 100 * len(s & t) >= 80 * len(s | t):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return Counter((d, len(s), None if d is None else root(d)) for d, s in sets)


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[rng.randrange(len(w))] = words(rng, 1)
    return " ".join(w)


@pytest.fixture
def near_copies(rng):
    texts = []
    for _ in range(12):
        base = words(rng, rng.choice([3, 8, 12, 30, 80, 150]))
        texts += [base, base.upper()] + [edited(rng, base, rng.randint(0, 4)) for _ in range(rng.randint(1, 9))]
    big = words(rng, 120)
    texts += [edited(rng, big, rng.randint(1, 6)) for _ in range(60)]
    passage = words(rng, 40)
    texts += [words(rng, rng.randint(5, 60)) + " " + passage for _ in range(30)]
    texts += [None, "", " \n", "a", "a", "A b c d", "a b c d", "a b c d e", "a b c d e"]
    rng.shuffle(texts)
    rows = [(10 * k + 3, t) for k, t in enumerate(texts)]
    return rows + [rows[0], rows[5], (None, texts[1]), (rows[9][0], texts[2])]


def test_jaccard_groups(spark, near_copies):
    docs = docs_frame(spark, near_copies).withColumn("node", F.lit(1)).withColumn("component_id", F.lit("x")).repartition(3)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar_groups(docs).collect())
    assert got == plain_groups(near_copies)
    kept = jaccard.one_of_each_group(docs)
    assert kept.columns == docs.columns
    heads = {c for _, n, c in got if c is not None}
    ids = Counter(r.doc_id for r in kept.collect())
    assert set(ids) - {None} == heads and max(v for k, v in ids.items() if k is not None) == 1


@pytest.mark.parametrize("small", [0, 6, 25, 64])
def test_every_boundary_finds_all_links(spark, near_copies, small, monkeypatch):
    monkeypatch.setattr(jaccard, "boundary", lambda *a, **k: small)
    rows = near_copies[:90]
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar_groups(docs_frame(spark, rows)).collect())
    assert got == plain_groups(rows)


def test_parity_bits_keep_every_link(rng):
    """Whatever the sizes and sides, a set with a linked one stays; unrelated sets leave."""
    sets = []
    for size in [1, 2, 5, 40, 63, 64, 65, 120, 128, 129, 250, 700]:
        base = [rng.getrandbits(64) for _ in range(size)]
        for drop, add in [(0, 0), (0, size // 4), (size // 5, 0), (size // 9, size // 9), (size // 7, size // 7)]:
            sets.append(sorted({*base[drop:], *(rng.getrandbits(64) for _ in range(add))}))
    values, first = np.array(sum(sets, []), np.uint64), np.cumsum([0, *map(len, sets)])
    bits = jaccard.parity_bits(values, first)
    sides = np.array([k % 2 for k in range(len(sets))])
    for s in (None, sides):
        close = [
            any(100 * len({*a} & {*b}) >= 80 * len({*a} | {*b}) for j, b in enumerate(sets) if j != i and (s is None or s[i] != s[j]))
            for i, a in enumerate(sets)
        ]
        stay = jaccard.may_link(bits, s)
        assert any(close) and (stay | ~np.array(close)).all()
    alone = [[rng.getrandbits(64) for _ in range(n)] for n in range(30, 300, 3)]
    unlike = jaccard.parity_bits(np.array(sum(alone, []), np.uint64), np.cumsum([0, *map(len, alone)]))
    assert jaccard.may_link(unlike, None).sum() < 5


def test_sets_that_only_share_passages_are_not_sent(spark, rng, monkeypatch):
    """No shingle is rare, so whatever leads is shared; whole sets are sent of near copies only."""
    passages = [words(rng, 60) for _ in range(12)]
    rows = [(k, " ".join(rng.sample(passages, 3))) for k in range(40)]
    rows += [(100, rows[0][1] + " x"), (101, rows[1][1] + " y z")]
    sent = []
    sets_of = jaccard.sets_of
    monkeypatch.setattr(jaccard, "sets_of", lambda texts, nodes, width: (sent.append(nodes.count()), sets_of(texts, nodes, width))[1])
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar_groups(docs_frame(spark, rows)).collect())
    want = plain_groups(rows)
    assert got == want
    size = Counter(c for _, _, c in want)
    assert sent[0] < 42 and sent[0] <= sum(1 for _, _, c in want if size[c] > 1) + 4


def plain_repeats(rows):
    seen, out = set(), {}
    for d, t in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, repeats._tie((r[1] or "").encode()))):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - 99):
            if raw[i : i + 100] in seen:
                gone[i : i + 100] = b"x" * 100
            seen.add(raw[i : i + 100])
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        runs = len(re.findall(b"x+", bytes(gone)))
        out[d, t] = (d, len(raw), gone.count(b"x"), runs, hashlib.sha256(kept).hexdigest())
    return Counter(out[r] for r in rows)


@pytest.mark.parametrize("hot", [repeats.HOT, 10])
def test_repeats(spark, rng, hot, monkeypatch):
    sketch = repeats.anchor_sketch
    monkeypatch.setattr(repeats, "anchor_sketch", lambda sources, bits: sketch(sources, bits, hot))
    base = "".join(rng.choice("abcdeé ") for _ in range(2500))

    def cut(most):
        return base[rng.randrange(2000) :][: rng.randrange(most)]

    rows = [(k, cut(800) + words(rng, rng.randint(0, 9)) + cut(300)) for k in range(90)]
    rows += [(200, "ab" * 400), (201, None), (202, ""), (203, "ab" * 300), (None, base[:500]), (204, "é" * 130)]
    rows += [(205, base[:99]), (206, base[:99]), (207, base[:100]), (208, base[:100]), (5, base[100:400]), (5, base[100:400]), rows[7]]
    docs = docs_frame(spark, rows).withColumn("n_bytes", F.lit("x")).repartition(4)
    got = repeats.find_repeats(docs)
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()) == plain_repeats(rows)


def test_difference_cover_has_every_difference():
    cover = repeats.difference_cover()
    assert {(a - b) % repeats.MODULUS for a in cover for b in cover} == set(range(repeats.MODULUS))


def plain_nearest(rows, step, k):
    good = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good.setdefault((i, tuple(v)))
    out = defaultdict(list)
    for i, v in good:
        if i % step == 0:
            a = np.array(v)
            for j, u in good:
                if j != i and len(u) == len(v):
                    b = np.array(u)
                    out[i].append((-float(a @ b / math.sqrt((a @ a) * (b @ b))), j))
    return {i: sorted(x)[:k] for i, x in out.items()}


def test_nearest(spark, rng):
    base = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(150)]
    rows = list(enumerate(base)) + [(200 + k, base[10]) for k in range(40)] + [(300 + k, base[0]) for k in range(3)]
    rows += [(400, None), (405, []), (410, [0.0] * 8), (415, [1.0, None] * 4), (420, [float("nan")] * 8), (425, [float("inf")] * 8)]
    rows += [(430, [1e200] * 8), (431, [1e-200] * 8), (435, [1.0, 2.0]), (436, [2.0, 1.0]), (440, [1.0, 2.0, 3.0]), (None, base[3]), (10, base[10])]
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, rank int").repartition(3)
    got = defaultdict(list)
    for r in nearest.nearest_neighbours(frame, F.col("vec_id") % 5 == 0, block=32).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    want = plain_nearest([r for r in rows if r[0] not in (430, 431)], 5, 5)
    scaled = plain_nearest([(i, [x / max(map(abs, v)) for x in v] if i in (430, 431) else v) for i, v in rows], 5, 5)
    assert set(got) == set(scaled) and set(want) <= set(got)
    for q, hits in scaled.items():
        assert [s for _, s in got[q]] == pytest.approx([-s for s, _ in hits], abs=1e-12)
        if len({round(s, 9) for s, _ in hits}) == len(hits):
            assert [i for i, _ in got[q]] == [i for _, i in hits]
    assert [i for i, _ in got[200]] == [10, 201, 202, 203, 204]


def test_empty_tables(spark):
    docs = docs_frame(spark, [])
    assert jaccard.similar_groups(docs).count() == 0
    assert jaccard.one_of_each_group(docs).count() == 0
    assert repeats.find_repeats(docs).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert nearest.nearest_neighbours(vectors, F.col("vec_id") % 50 == 0).count() == 0
