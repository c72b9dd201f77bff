import base64
import gzip
import hashlib
import math
import os
from collections import Counter

import numpy as np
import pytest

from kiloqueue.llm import ngram_trie, queries, warc
from kiloqueue.llm.common import Scratch, read
from tests.conftest import SF
from tests.llm import brute
from tests.llm.tables import documents, edge_rows, empty, rows


def page_rows():
    return [(5, "http://www.Example.com:80/a?b=1#x", "same"), (3, "https://example.com/a", "same"), (9, None, "same"), (4, "http://b.example.org/é x", "other"),
            (1, "http://b.example.org/", None), (2, "http://b.example.org/", ""), (7, "not a url\r\nX: y", "<p>é</p>"), (8, "http://[bad", "z" * 200_000),
            (6, "http://b.example.org/", "other"), (10, "", "t"), (10, "", "t"), (None, "http://n.example.net/", "null id"), (11, "http://n.example.net/", "null id")]


def expected(pages):
    first = {}
    for i, _, h in pages:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    out = []
    for i, _, h in pages:
        data = (h or "").encode()
        response = first.get(h or "") == i
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if response else "revisit", None if response else first[h or ""]))
    return sorted(out, key=str)


def test_round_trip(spark):
    pages = spark.createDataFrame(page_rows(), "page_id long, url string, html string").selectExpr("*", "1 AS payload", "2 AS sha1", "3 AS first")
    got = warc.round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=str) == expected(page_rows())
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_round_trip_of_given_pages(spark):
    pages = read(spark, SF, "pages")
    got = warc.round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got), key=str) == expected(rows(pages, "page_id", "url", "html"))


def test_index_is_sorted_and_sparse(spark):
    pages = spark.createDataFrame([(i, f"http://h{i % 7}.example.com/{i % 900}", f"page {i}") for i in range(4000)], "page_id long, url string, html string")
    tmp = Scratch(spark, "t")
    archives = warc.write_archives(pages, tmp)
    blocks, tops = warc.build_index(archives, tmp)
    assert blocks.agg({"lines": "max"}).first()[0] <= warc.BLOCK_LINES and blocks.agg({"lines": "sum"}).first()[0] == 4000
    keys = [r.first_key for r in sorted(blocks.collect(), key=lambda r: (tops[1].index(r.part), r.block))]
    assert keys == sorted(keys)
    wanted = spark.createDataFrame([(17, "http://h3.example.com/17"), (17, "http://h3.example.com/18"), (5000, "http://zz.example.com/")], "page_id long, url string")
    found = warc.look_up(wanted, blocks, tops)
    assert [r.page_id for r in warc.read_records(found, archives).collect()] == [17]
    # members in order of offset are a gzip file
    name = archives.first().archive
    file = b"".join(r.member for r in sorted(archives.filter(archives.archive == name).collect(), key=lambda r: r.offset))
    assert gzip.decompress(file).count(b"WARC/1.1\r\n") == archives.filter(archives.archive == name).count()


def test_url_keys():
    assert warc.url_key("http://www.Example.com:80/a?b=1#x") == "com,example)/a?b=1"
    assert warc.url_key("https://m.example.com:8443") == "com,example,m:8443)/"
    assert warc.url_key(None) == warc.url_key("") == "-"


def plain_scores(data, prior=ngram_trie.PRIOR):
    texts = [[*brute.words(t), None] for _, t in data]
    held = [brute.held(i, 10, 0) for i, _ in data]
    c, pairs, before = Counter(), Counter(), Counter()
    for t, h in zip(texts, held):
        if not h:
            c.update(t)
            pairs.update(zip(["", *t[:-1]], t))
            before.update(["", *t[:-1]])
    n, v = sum(c.values()), len(c)
    often = {w: k for w, k in c.items() if k * ngram_trie.FREQUENT >= n}
    rest = (n - sum(often.values()) + 1) / (n + 1) / (v - len(often) + 1)
    q = lambda w: often[w] / (n + 1) if w in often else rest
    out = []
    for (i, _), t, h in zip(data, texts, held):
        out.append((i, h, len(t), sum(c[w] > 0 for w in t), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t),
                    sum(math.log10((pairs[a, w] + prior * q(w)) / (before[a] + prior)) for a, w in zip(["", *t[:-1]], t))))
    return out


@pytest.mark.parametrize("shard_tokens, frequent", [(4_000_000, 1 << 17), (3_000, 64)])
def test_scores_equal_plain_model(spark, monkeypatch, shard_tokens, frequent):
    monkeypatch.setattr(ngram_trie, "SHARD_TOKENS", shard_tokens)
    monkeypatch.setattr(ngram_trie, "FREQUENT", frequent)
    monkeypatch.setattr(ngram_trie, "BATCH_CHARS", 100_000)
    docs = read(spark, SF, "documents")
    data = rows(docs, "doc_id", "text")
    got = sorted(map(tuple, ngram_trie.score_documents(docs).collect()))
    for g, w in zip(got, plain_scores(data), strict=True):
        assert g[:5] == w[:5]
        assert g[5] == pytest.approx(w[5], rel=1e-9)
        assert g[6] == pytest.approx(w[6], rel=2e-3, abs=0.01)


def test_all_words_keep_their_counts(spark, monkeypatch):
    """Words that are not frequent have their own lower-order probability in the registered query."""
    monkeypatch.setattr(ngram_trie, "SHARD_TOKENS", 3_000)
    monkeypatch.setattr(ngram_trie, "BATCH_CHARS", 100_000)
    monkeypatch.setattr(ngram_trie, "FREQUENT", 64)
    got = sorted(map(tuple, queries.op8_ngram_scores(spark, SF).collect()))
    monkeypatch.setattr(ngram_trie, "FREQUENT", 1 << 40)
    for g, w in zip(got, plain_scores(rows(read(spark, SF, "documents"), "doc_id", "text")), strict=True):
        assert g[:5] == w[:5] and g[6] == pytest.approx(w[6], rel=2e-3, abs=0.01)


def test_scores_of_edge_rows(spark):
    data = edge_rows()
    got = ngram_trie.score_documents(documents(spark, data)).collect()
    want = plain_scores([(i, t) for i, t, *_ in data])
    key = lambda r: (r[0] is not None, r[0] or 0, r[2], r[5])
    for g, w in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], rel=2e-3, abs=0.01)
    assert ngram_trie.score_documents(empty(spark)).count() == 0
    unseen = ngram_trie.score_documents(documents(spark, [(None, "a b", "en", "a")])).collect()[0]
    assert unseen.held_out and unseen.n_known == 0 and unseen.train_tokens == 0 and math.isfinite(unseen.score)


def test_held_out_score_beats_unigrams(spark):
    r = ngram_trie.score_documents(read(spark, SF, "documents")).filter("held_out").toPandas()
    assert r.score.sum() > r.base_score.sum()


@pytest.mark.parametrize("n, top", [(0, 1), (1, 1 << 63), (500, 600), (500, 1 << 60), (3000, 100_000)])
def test_elias_fano(n, top):
    r = np.random.default_rng(n)
    values = np.sort(r.integers(0, top, n).astype(np.uint64))
    ef = ngram_trie.EliasFano.build(values)
    assert (ef.get(np.arange(n)) == values).all()
    asked = np.concatenate([values, r.integers(0, top, 200).astype(np.uint64), np.array([0, top - 1, top], np.uint64)])
    assert (ef.successor(asked) == np.searchsorted(values, asked)).all()
    present = np.isin(asked, values)
    found = ef.find(asked)
    assert (found[~present] == -1).all() and (values[found[present]] == asked[present]).all()
    if n == 3000:
        lo, hi = np.full(len(asked), 100), np.full(len(asked), 2000)
        assert (ef.successor(asked, lo, hi) == np.clip(np.searchsorted(values, asked), 100, 2000)).all()
        assert sum(a.nbytes for a in ef.arrays()) < values.nbytes


def test_trie_file(tmp_path):
    contexts, runs = np.array([3, 9, 2**63], np.uint64), np.array([2, 1, 3])
    successors = np.array([1, 5, 5, 1, 2, 7], np.uint64)
    logp = -np.arange(1, 7) / 4.0
    trie = ngram_trie.Trie.build(contexts, runs, successors, logp, np.array([-0.5, -0.25, -1.0]))
    trie.save(path := os.path.join(tmp_path, "t"))
    opened = ngram_trie.Trie.open(path)
    assert isinstance(opened.codes.base, np.memmap) or isinstance(opened.codes, np.memmap)
    ask, words = np.array([3, 4, 9, 2**63], np.uint64), np.array([1, 5, 7, 8], np.uint64)
    of, word = np.repeat(np.arange(4), 4), np.tile(np.arange(4), 4)
    got = opened.score(ask, of, words, word, np.array([-2.0, -3.0, -4.0, -5.0]))
    want = [-0.25, -0.5, -4.5, -5.5, -2, -3, -4, -5, -2.25, -0.75, -4.25, -5.25, -1.0, -4.0, -1.5, -6.0]
    assert got == pytest.approx(want, abs=1e-3)


