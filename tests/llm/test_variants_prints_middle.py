"""Spelling variants, fingerprints and fill-in-the-middle against plain Python."""

import hashlib
import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from helpers import docs_frame, words

from fieldtally.llm import fill_in_middle, phrases, spelling
from fieldtally.llm.text import mix, utf8

LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


# fill in the middle


def plain_middle(text, doc_id):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h4 % 100 < 20 else "psm"
    out = f"<S>{suffix}<P>{prefix}<M>{middle}" if form == "spm" else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return n, form, len(prefix), len(middle), out


def test_middle_of_odd_texts(spark, rng):
    texts = [None, "", "a", " ", "<P>", "x <M> y", "<<S", "P>", "é", "漢字 kanji", "a\nb\r\n\tc", "<" * 50, "word " * 60_000]
    texts += ["".join(rng.choice("ab <>PSMé\nÿ漢😀") for _ in range(rng.randint(0, 60))) for _ in range(150)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(12, texts[12]), (3, "other"), (None, "no id"), (None, None)]
    docs = docs_frame(spark, rows).withColumnRenamed("lang", "form").withColumnRenamed("source", "output")
    got = fill_in_middle.restore_text(fill_in_middle.fill_in_middle(docs)).collect()
    plain = Counter((d, *plain_middle(t, d), t or "") for d, t in rows)
    assert Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored) for r in got) == plain
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_every_cut_and_form_comes_back():
    text = "ab<cé>漢 d".encode()
    for first, second in itertools.combinations_with_replacement(range(len(text) + 1), 2):
        for form in ("psm", "spm"):
            assert fill_in_middle.restore(fill_in_middle.to_form(text, first, second, form), form) == text


def test_rotation_exchanges_neighbours():
    for a, b, c in itertools.combinations_with_replacement(range(8), 3):
        buffer = bytearray(b"01234567")
        meet = fill_in_middle.exchange(buffer, a, b, c)
        assert buffer == b"01234567"[:a] + b"01234567"[b:c] + b"01234567"[a:b] + b"01234567"[c:]
        assert meet == a + c - b


def test_middle_of_an_empty_table(spark):
    made = fill_in_middle.restore_text(fill_in_middle.fill_in_middle(docs_frame(spark, [])))
    assert made.count() == 0
    with pytest.raises(ValueError):
        fill_in_middle.restore_text(made)


# fingerprints


def plain_labels(symbols):
    for _ in range(3 if max(symbols) < 256 else 4):
        found = []
        for k, x in enumerate(symbols):
            low = 1 if k == 0 else (x ^ symbols[k - 1]) & -(x ^ symbols[k - 1])
            found.append(2 * (low.bit_length() - 1) + bool(x & low))
        symbols = found
    return symbols


def plain_parse(text):
    """Levels of names, one phrase after the other."""
    one = lambda x: int(mix(np.array([x], np.uint64))[0])
    wrap = (1 << 64) - 1
    golden = int(phrases._GOLDEN)
    symbols, names_of, levels = list(text.encode()), lambda b: int(phrases._BYTE_NAMES[b]), []
    while True:
        runs = [(s, len(list(g))) for s, g in itertools.groupby(symbols)]
        names = [names_of(s) if n == 1 else one(names_of(s) ^ one(n * golden & wrap)) for s, n in runs]
        label = plain_labels([s for s, _ in runs]) if levels or max(symbols) < 256 else None
        assert all(0 <= x <= 5 for x in label) and all(x != y for x, y in itertools.pairwise(label))
        cuts = [k for k in range(len(label)) if k == 0 or (k + 1 < len(label) and label[k - 1] < label[k] > label[k + 1])]
        parts = [names[a:b] for a, b in zip(cuts, [*cuts[1:], len(names)], strict=True)]
        assert all(len(p) <= phrases.LONGEST for p in parts)
        symbols = [one((sum(x * int(w) for x, w in zip(p, phrases._PLACE, strict=False)) + len(p) * golden) & wrap) for p in parts]
        levels.append(symbols)
        if len(symbols) == 1:
            return levels
        names_of = lambda s: s


def prints_of(texts):
    return phrases.fingerprints(*utf8(pa.array(texts, pa.string())))


def test_parse_equals_the_plain_one(rng):
    texts = ["a", "ab", "aaaaaaa", "abababab" * 9, "é漢😀" * 5, words(rng, 200), words(rng, 9) * 7]
    texts += ["".join(rng.choice("abc \n") for _ in range(rng.randint(1, 90))) for _ in range(60)]
    for text, found in zip(texts, prints_of(texts), strict=True):
        levels = plain_parse(text)
        root, *sketches = found.split("/")
        assert root == f"{levels[-1][0]:016x}"
        assert [int(s.split(":")[0]) for s in sketches] == [len(x) for x in levels[: phrases.TOP]]


def test_equal_substrings_are_parsed_alike_inside(rng):
    passage = words(rng, 300)
    inside = Counter(plain_parse(passage)[1])
    for before in ("", "x", "yz ", words(rng, 33)):
        whole = Counter(plain_parse(before + passage + words(rng, 20))[1])
        assert (inside & whole).total() >= 0.93 * inside.total()


def test_likeness_follows_the_shared_part(rng):
    one, other = words(rng, 900), words(rng, 900)
    half = one[: len(one) // 2] + other[len(other) // 2 :]
    a, b, c, same = prints_of([one, other, half, one])
    assert a == same and phrases.likeness(a, same) == 1
    assert phrases.likeness(a, b) < 0.1
    assert 0.25 < phrases.likeness(a, c) < 0.75
    assert phrases.likeness("-", a) == 0 and phrases.likeness("-", "-") == 1


def plain_edited(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    texts = [t or "" for _, t in order]
    return [
        (d, len(x), hashlib.sha256((x[: len(x) - len(x) // 3] + y[: len(x) // 3]).encode()).hexdigest(), x, y)
        for (d, _), x, y in zip(order, texts, texts[1:] + texts[:1], strict=True)
    ]


def test_edited_texts_and_next_documents(spark, rng):
    texts = [None, "", "é", "漢字kanji", "Of " * 300, words(rng, 30_000)] + [words(rng, rng.randint(0, 200)) for _ in range(300)]
    rows = [(3 * k - 50, t) for k, t in enumerate(texts)] + [(None, "no id")]
    docs = docs_frame(spark, rows).withColumnRenamed("lang", "place").withColumnRenamed("source", "part").repartition(7)
    got = {r.doc_id: r for r in phrases.compare_with_next(docs).collect()}
    assert len(got) == len(rows)
    for d, n, digest, x, y in plain_edited(rows):
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (n, digest)
        edited = x[: n - n // 3] + y[: n // 3]
        own, changed, following = prints_of([x, edited, y])
        assert (r.fingerprint, r.edited_fingerprint) == (own, changed)
        assert r.near_edited == phrases.likeness(own, changed) and r.near_next == phrases.likeness(own, following)


def test_edited_texts_of_repeated_rows(spark, rng):
    text = words(rng, 50)
    rows = [(1, text)] * 400 + [(2, "above " * 9), (0, "below " * 9)]
    got = phrases.compare_with_next(docs_frame(spark, rows).repartition(5)).collect()
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == Counter(x[:3] for x in plain_edited(rows))
    alone = phrases.compare_with_next(docs_frame(spark, [(5, "abcdef")])).collect()
    assert [(r.doc_id, r.edited_sha256) for r in alone] == [(5, hashlib.sha256(b"abcdab").hexdigest())]
    assert phrases.compare_with_next(docs_frame(spark, [])).count() == 0
    ids = docs_frame(spark, rows).withColumnRenamed("lang", "fingerprint")
    assert {r.fingerprint for r in phrases.fingerprint_documents(ids.where("doc_id = 1")).collect()} == set(prints_of([text]))


# spelling variants


def plain_near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    k = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def plain_forms(rows, least=6):
    counts = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'null' if d is None else d}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= least and c >= 5}
    near = {w: [v for v in n if plain_near(w, v)] for w in n}
    form = {w: min(vs, key=lambda v: (-n[v], v)) for w, vs in near.items() if vs}
    form = {w: v for w, v in form.items() if n[v] >= 5 * n[w]}
    out = {}
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out[w] = (n[w], form.get(w), n.get(form.get(w)), root, len(near[w]))
    return out


@pytest.mark.parametrize("alphabet", ["ab", "abcdefgh", "aéÿz"])
def test_forms_equal_plain_ones(spark, rng, alphabet, monkeypatch):
    monkeypatch.setattr(spelling, "LIST", 8)
    monkeypatch.setattr(spelling, "_HELD", 50)
    base = ["".join(rng.choice(alphabet) for _ in range(rng.randint(5, 9))) for _ in range(60)]
    pool = []
    for w in base:
        pool += [w] * rng.choice([1, 3, 5, 20, 200])
        for _ in range(4):
            k = rng.randrange(len(w))
            pool += [rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice(alphabet) + w[k:], w.upper(), "Ö" + w])] * rng.choice([1, 5, 30])
    rng.shuffle(pool)
    rows = [(k, " ".join(pool[k::40])) for k in range(40)] + [(None, " ".join(pool[:50])), (7, None), (8, ""), (1, " ".join(pool[1::40]))]
    got = spelling.spelling_forms(docs_frame(spark, rows).withColumnRenamed("lang", "word").withColumnRenamed("source", "n")).collect()
    assert {r.word: (r.n, r.form, r.form_n, r.root, r.n_near) for r in got} == plain_forms(rows)
    assert len(got) == len({r.word for r in got}) and any(r.form for r in got)


def test_chains_end_at_their_root(spark):
    counts = {"abcdef": 5, "abcdeg": 25, "abcdhg": 125, "abcihg": 625, "abjihg": 3125, "zzzzzz": 5}
    docs = docs_frame(spark, [(0, " ".join(f"{w} " * c for w, c in counts.items()))])
    got = {r.word: r.root for r in spelling.spelling_forms(docs, spelling.Words(drop_one_in=0)).collect()}
    assert got == {w: "zzzzzz" if w == "zzzzzz" else "abjihg" for w in counts}


def test_no_words(spark):
    assert spelling.spelling_forms(docs_frame(spark, [])).count() == 0
    assert spelling.spelling_forms(docs_frame(spark, [(1, None), (2, "short words only")])).count() == 0
    with pytest.raises(ValueError):
        spelling.Words(least_length=3)


def test_pivots_are_the_cheapest_disjoint_pair(rng):
    for _ in range(300):
        places = sorted(rng.sample(range(12), rng.randint(3, 6)))
        weights = [rng.randint(1, 9) for _ in places]
        pairs = [(a, b) for a, b in itertools.combinations(range(len(places)), 2) if places[b] - places[a] >= 2]
        a, b = spelling.choose_pivots(places, weights)
        assert (a, b) in pairs and weights[a] + weights[b] == min(weights[x] + weights[y] for x, y in pairs)
