"""Packing, token files, toxicity, URL filters and the pipeline."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow.fs as pafs
import pytest
from helpers import docs_frame, words
from pyspark.sql import functions as F

from fieldtally.llm import packing, token_files, toxicity, url_filter
from fieldtally.llm.queries import URL_RULES, tokenizer_path
from fieldtally.llm.tokens import encoder

ODD = [None, "", "x", " x  y ", "<|endoftext|> a", "Kelvin \u212a \u00c5", "a\x1cb", "\u03a3\u03b1\u03c2", "it's Don'T", "ab \x00cd", "e\u0301"]


def plain_ids(tokenizer, text, end):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, end], "<u4")


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_fast_ids_are_the_tokenizers(name, rng):
    made = encoder(tokenizer_path(name))
    texts = ODD + [words(rng, rng.randint(1, 80)).capitalize() + ".\n\u00c9t\u00e9 " + words(rng, 5) for _ in range(50)]
    for text, ids in zip(texts, made.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == plain_ids(made.plain, text, 0)[:-1].tolist(), repr(text)


@pytest.mark.parametrize("length", [8, 64, 2048])
def test_groups_pack_without_padding(length):
    rng = np.random.default_rng(length)
    for n in (0, 1, 2, 30, 200):
        sizes = rng.integers(1, 3 * length, n)
        docs, sequences = defaultdict(list), defaultdict(list)
        for doc, start, size, at, offset in packing.pack_group(sizes, length):
            docs[doc].append((start, size))
            sequences[at].append((offset, size))
        for doc in range(n):
            at = 0
            for start, size in sorted(docs[doc]):
                assert start == at
                at += size
            assert at == sizes[doc]
        for parts in sequences.values():
            at = 0
            for offset, size in sorted(parts):
                assert offset == at
                at += size
            assert at == length or at & (at - 1) == 0


def test_packing_round_trip(spark, rng):
    path = tokenizer_path("byte_bpe_50k.json")
    rows = list(enumerate(ODD + [words(rng, rng.randint(1, 400)) for _ in range(60)] + [words(rng, 9000)])) + [(3, ODD[3]), (None, "q")]
    docs = docs_frame(spark, rows).withColumn("start", F.lit("x"))
    pieces = packing.pack_documents(docs, path, group_bytes=20000).collect()
    made, want = encoder(path).plain, Counter()
    for d, t in rows:
        want[d, tuple(plain_ids(made, t, 1).tolist())] += 1
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in pieces:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for d in {d for d, _ in rows if d != 3}:
        ids = b"".join(r.ids for r in sorted(by_doc[d], key=lambda r: r.start))
        assert want[d, tuple(np.frombuffer(ids, "<u4").tolist())] == 1
    assert sum(r.length for r in by_doc[3]) == 2 * by_doc[3][0].doc_tokens
    for parts in by_sequence.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at == 2048 or at & (at - 1) == 0
    again = packing.pack_documents(docs.repartition(5), path, group_bytes=20000).collect()
    assert Counter(map(str, again)) == Counter(map(str, pieces))


def test_token_files_round_trip(spark, rng, monkeypatch):
    monkeypatch.setattr(token_files, "SHARD_BYTES", 8000)
    path = tokenizer_path("word_bpe_49k.json")
    rows = list(enumerate(ODD + [words(rng, rng.randint(1, 200)) for _ in range(80)])) + [(3, "again"), (3, "again"), (None, "q")]
    docs = docs_frame(spark, rows).repartition(4)
    folder = token_files.write_token_files(docs, path)
    got = token_files.read_token_files(spark, folder).collect()
    made, at = encoder(path).plain, 0
    assert Counter((r.doc_id, bytes(r.ids)) for r in got) == Counter((d, plain_ids(made, t, 2).tobytes()) for d, t in rows)
    for r in sorted(got, key=lambda r: r.start):
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(r.ids) // 4, zlib.crc32(r.ids))
        at += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order[-1] is None and order[:-1] == sorted(order[:-1])
    shards = spark.read.parquet(f"{folder}/manifest").orderBy("shard").collect()
    assert len(shards) > 2
    first = token_files.read_document(folder, shards[0].name, 2)
    assert first.tolist() == plain_ids(made, "x", 2).tolist()
    filesystem, root = pafs.FileSystem.from_uri(folder)
    with filesystem.open_input_file(f"{root}/{shards[0].name}") as file, pytest.raises(ValueError, match="another dictionary"):
        token_files.ShardReader(file, b"other")
    empty = token_files.write_token_files(docs_frame(spark, []), path)
    assert token_files.read_token_files(spark, empty).count() == 0
    assert packing.pack_documents(docs_frame(spark, []), path).count() == 0


def plain_segments(scores):
    """Maximal-scoring segments by their definition: split at the best segment, again and again."""
    out = []

    def best(a, b):
        found, prefix = None, np.concatenate([[0.0], np.cumsum(scores[a:b])])
        for i in range(b - a):
            for j in range(i + 1, b - a + 1):
                s = prefix[j] - prefix[i]
                if s > 1e-12 and (found is None or s > found[0] + 1e-9):
                    found = (s, a + i, a + j)
        if found:
            out.append((found[1], found[2] - 1, found[0]))
            best(a, found[1])
            best(found[2], b)

    best(0, len(scores))
    return sorted(out)


def test_all_maximal_segments():
    rng = np.random.default_rng(5)
    for _ in range(200):
        n = int(rng.integers(0, 25))
        hit = rng.random(n) < 0.3
        gain = rng.uniform(0.2, 3.0, n)
        scores = np.where(hit, gain, -toxicity.STEP)
        got = toxicity.maximal_segments(np.flatnonzero(hit), gain[hit])
        want = plain_segments(scores)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert [s for _, _, s in got] == pytest.approx([s for _, _, s in want])


def test_toxicity_on_held_out_documents(spark, rng):
    bad = ["zzgrim", "zzvile", "zzfoul", "zzrank"]
    rows, labels = [], []
    for k in range(1500):
        w = words(rng, rng.randint(20, 150)).split()
        toxic = k % 6 == 0
        for _ in range(rng.randint(3, 8) if toxic else 0):
            w.insert(rng.randrange(len(w)), rng.choice(bad) + (words(rng, 1) if rng.random() < 0.3 else ""))
        rows.append((k, " ".join(w)))
        labels.append((k, int(toxic)))
    rows += [(None, rows[0][1]), (2000, None), (2001, ""), (5, rows[5][1])]
    table = spark.createDataFrame([*labels, (None, 1), (7, None), (6, 0)], "doc_id long, toxic int")
    docs = docs_frame(spark, rows)
    got = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, table)).withColumn("out", toxicity.held_out(F.col("doc_id"))).collect()
    assert Counter(r.doc_id for r in got) == Counter(d for d, _ in rows)
    assert all(0 <= r.score <= 1 for r in got)
    test = [(r.score >= 0.3, labels[r.doc_id][1]) for r in got if r.out and r.doc_id is not None and r.doc_id < 1500]
    assert all(out == (zlib.crc32(str(d).encode()) % 4 == 2) for d, out in ((r.doc_id, r.out) for r in got if r.doc_id is not None))
    assert sum(p and y for p, y in test) >= 0.9 * sum(y for _, y in test)
    assert sum(p and not y for p, y in test) <= 0.02 * len(test)
    none = toxicity.fit_toxicity(docs, table.where("false"))
    assert all(r.score < 0.01 for r in toxicity.score_toxicity(docs, none).collect())


def test_url_parts_rules_and_templates(spark, rng):
    urls = [None, "", "example.org/x", "http://Example.ORG", "http://a.example.org/es/1?x=/", "https://example.org/en/12", "http://notexample.org/es/1"]
    urls += ["http://x.com/de/1#a", "http://com/fr/", "http://h?a/b", "http://h/p://q", "http://good.net/a/1", "http://bad.net/ads/77"]
    urls += [f"http://site.net/{'ads' if k % 2 else 'news'}/{k}" for k in range(400)]
    urls += [f"http://wide.net/{words(rng, 2).replace(' ', '-')}/page" for k in range(200)]
    rows = [(k, u) for k, u in enumerate(urls)] + [(11, urls[11]), (None, urls[12])]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit(1))
    labels = spark.createDataFrame([(k, "ads" not in (u or "")) for k, u in enumerate(urls) if k % 3], "page_key long, good boolean")
    got = url_filter.judge_urls(pages, labels, URL_RULES).collect()
    assert len(got) == len(rows)
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    by_key = {r.page_id: r for r in got}
    for k, u in enumerate(urls):
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            cut = min([len(rest), *(rest.index(c) for c in "/?#" if c in rest)])
            host, rest = rest[:cut].translate(table), rest[cut:]
            path = rest[: min([len(rest), *(rest.index(c) for c in "?#" if c in rest)])]
        fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        rule = max(fits, key=lambda r: len(r.text), default=None)
        r = by_key[k]
        assert (r.host, r.path, r.rule) == (host, path, rule and rule.text)
        if rule:
            assert r.verdict == rule.action
        elif host == "site.net":
            assert r.verdict == ("block" if "/ads/" in path else "allow"), (u, r.template)
    assert {r.template for r in got if r.host == "wide.net"} == {"*/page"} or len({r.template for r in got if r.host == "wide.net"}) < 5
    none = spark.createDataFrame([], "page_key long, good boolean")
    assert url_filter.judge_urls(pages.limit(0), none, URL_RULES).count() == 0
    assert {r.verdict for r in url_filter.judge_urls(pages.where("url LIKE '%site%'"), none, ()).collect()} == {"allow"}


def test_branches_of_deep_paths_part(spark, rng):
    deep = "http://deep.net/" + "/".join("abcdefghi")
    urls = [f"{deep}/{'ads' if k % 2 else 'news'}/x" for k in range(200)]
    urls += [f"{deep}/w/{words(rng, 2).replace(' ', '-')}{'q' * (k % 5)}-{'abcdefghij'[k % 10]}/page" for k in range(200)]
    urls.append("http://deep.net" + "/s" * 300)
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(k, "/ads/" not in u) for k, u in enumerate(urls) if k % 3], "page_key long, good boolean")
    got = {r.page_id: r for r in url_filter.judge_urls(pages, labels, ()).collect()}
    assert len(got) == len(urls)
    for k, u in enumerate(urls):
        assert got[k].verdict == ("block" if "/ads/" in u else "allow"), (u, got[k].template)
    wide = {got[k].template for k in range(200, 400)}
    assert len(wide) == 1 and url_filter.WILDCARD in wide.pop().split("/")
    assert len({got[k].template for k in range(200)}) == 2


def test_pipeline_by_stages(spark, rng):
    import corpus_pipeline as pipeline

    clean = [(k, words(rng, rng.randint(60, 200))) for k in range(60)]
    copies = [(100 + k, clean[k][1] + " tail") for k in range(10)]
    junk = [(200 + k, " ".join(w + "$$$" for w in words(rng, 60).split())) for k in range(12)]
    secret = [(300, words(rng, 60) + " password=hunter2222 " + words(rng, 60))]
    rows = clean + copies + junk + secret + [(400, None), (1, clean[1][1])]
    docs = docs_frame(spark, rows, [("a", "b", "c")[k % 3] for k in range(len(rows))])
    seen, columns = [docs], docs.columns
    for name, stage in pipeline.STAGES:
        seen.append(stage(spark, seen[-1], "").cache())
        if name != "packing":
            assert seen[-1].columns == columns
    ids = [{r.doc_id for r in f.select("doc_id").distinct().collect()} for f in seen]
    assert ids[1] == {d for d, _ in clean + copies + secret}
    assert ids[2] == {d for d, _ in clean + secret} and seen[2].count() == len(ids[2])
    assert ids[3] == ids[2] and seen[3].where("text LIKE '%hunter%'").count() == 0
    made = encoder(tokenizer_path("byte_bpe_50k.json")).plain
    texts = Counter(r.text for r in seen[4].collect())
    assert sum(r.length for r in seen[5].collect()) == sum(n * len(plain_ids(made, t, 1)) for t, n in texts.items())
