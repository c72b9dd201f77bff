import numpy as np
import pytest

from kiloqueue.llm import decontaminate, line_dedup, minhash
from kiloqueue.llm.common import Scratch, hash_words, read
from tests.conftest import SF
from tests.llm import brute
from tests.llm.tables import documents, edge_rows, empty, prose, rows


def changed(text, every, seed):
    w = text.split()
    return " ".join(f"z{seed}x{i}" if i % every == seed % every else x for i, x in enumerate(w))


def copies():
    base = prose(400, 5)
    data = [(i, base, "en", "a") for i in range(0, 40)]  # exact copies
    data += [(100 + i, changed(base, 60, i), "en", "a") for i in range(60)]  # near copies, some near the threshold
    data += [(200 + i, prose(60, 100 + i), "en", "b") for i in range(60)]
    data += [(300, prose(20, 9), "en", "b"), (301, changed(prose(20, 9), 19, 3), "en", "b"), (302, "a b", "en", "b"), (303, "A  b", "en", "b"), (304, "a", "en", "b")]
    return data


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_equal_brute_force(spark, width):
    got = minhash.near_duplicates(documents(spark, copies()), width).collect()
    want = brute.near_components([(i, t) for i, t, *_ in copies()], width)
    assert {r.doc_id: r.component_id for r in got} == want
    for r in got:
        assert r.kept == (r.doc_id == r.component_id)
        assert r.n_shingles == len(brute.shingles(next(t for i, t, *_ in copies() if i == r.doc_id), width))


def test_copies_that_only_resemble_the_original(spark):
    """Copies edited in their own places are linked through the original alone; a second group has none to link it."""
    data = []
    for group, original in ((0, [0]), (10_000, [])):
        base = prose(600, 40 + group).split()
        data += [(group + i, " ".join(base), "en", "a") for i in original]
        for i in range(1, 401):
            places = np.random.default_rng(group + i).choice(len(base), 26, replace=False)
            data.append((group + i, " ".join(f"z{group}x{i}x{k}" if k in set(places.tolist()) else w for k, w in enumerate(base)), "en", "a"))
    want = brute.near_components([(i, t) for i, t, *_ in data], 2)
    assert len({c for i, c in want.items() if i < 10_000}) == 1 and len({c for i, c in want.items() if i >= 10_000}) > 100
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(documents(spark, data), 2).collect()} == want


def test_near_duplicates_of_given_documents(spark):
    docs = read(spark, SF, "documents")
    want = brute.near_components(rows(docs, "doc_id", "text"), 2)
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, 2).collect()} == want


def test_near_duplicates_edge_rows(spark):
    got = minhash.near_duplicates(documents(spark, edge_rows()), 2).toPandas()
    assert len(got) == len(edge_rows())
    assert (got[got.n_shingles == 0].doc_id.fillna(-1) == got[got.n_shingles == 0].component_id.fillna(-1)).all()
    assert got.kept.all()
    assert minhash.near_duplicates(empty(spark), 2).count() == 0
    docs = documents(spark, edge_rows())
    kept = minhash.keep_first(docs, 2)
    assert kept.columns == docs.columns and kept.filter("doc_id = 7").count() == 1 and kept.filter("doc_id is null").count() == 2


def test_components_of_a_long_chain(spark):
    n = 200
    order = np.random.default_rng(0).permutation(n).tolist()
    links = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(1000, 1001)], "a long, b long")
    got = {r.node: r.component for r in minhash.components(links, Scratch(spark, "t"), "c").collect()}
    assert got == {**dict.fromkeys(range(n), 0), 1000: 1000, 1001: 1000}


def test_signatures_estimate_similarity():
    r = np.random.default_rng(1)
    for n in (5, 60, 3000):
        both = r.integers(0, 1 << 63, 4 * n, dtype=np.uint64)
        a, b = (np.unique(np.concatenate([both, r.integers(0, 1 << 63, n // 2, dtype=np.uint64)]) * np.uint64(2)) for _ in range(2))
        s = minhash.signatures([a, b])
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((s[0] == s[1]).mean() - true) < 0.15


def test_word_hashes_do_not_depend_on_neighbours():
    texts = ["Ab c d", None, "", " \x0b ab", "É x", "c"]
    h, at = hash_words(texts)
    assert np.diff(at).tolist() == [len(brute.words(t)) for t in texts]
    for i, t in enumerate(texts):
        assert (hash_words([t])[0] == h[at[i]: at[i + 1]]).all()
    assert h[0] == h[at[3]]


def lines_data():
    p = [" ".join(f"p{k}w{i}" for i in range(9)) for k in range(30)]
    long = " ".join(f"l{i}" for i in range(70))
    return [
        (1, "\n".join(p[:12]), "en", "a"), (2, "\n".join(["x y", *p[2:9], "tail"]), "en", "a"), (3, "\n".join(p[4:8]), "en", "a"),
        (4, f"{long}\nshort one\nend", "en", "b"), (5, f"q\n{long}\nshort one\n\nother", "en", "b"), (6, f"{long}", "en", "b"),
        (7, "\n".join(["same line of five words"] * 40), "en", "b"), (8, None, "en", "b"), (9, "", "en", "b"), (10, "\n \n", "en", "b"),
        (11, "  " + "\n\t".join(p[:12]) + " ", "en", "c"), (12, "\n".join([*p[20:24], *p[0:7], *p[24:26], *p[5:12]]), "en", "c"),
        (13, prose(20_000, 3), "en", "c"), (14, "\n".join(["a"] * 60), "en", "c"), (15, "\n".join(["a"] * 55 + ["b"]), "en", "c"),
    ]


def test_line_dedup_equals_brute_force(spark):
    want = brute.dedup_lines([(i, t) for i, t, *_ in lines_data()])
    got = {r.doc_id: r for r in line_dedup.dedup_lines(documents(spark, lines_data())).collect()}
    for i, t in want.items():
        assert got[i].text == t, i
        assert got[i].n_chars == len(t or "")
    assert got[3].n_removed == 0 and got[11].n_removed == 12 and got[11].text == ""


def test_line_dedup_of_given_documents(spark):
    docs = read(spark, SF, "documents")
    assert dict(brute.dedup_lines(rows(docs, "doc_id", "text"))) == {r.doc_id: r.text for r in line_dedup.without_copies(docs).collect()}


def test_line_dedup_edge_rows(spark):
    docs = documents(spark, [*edge_rows(), (None, prose(300, 1), "en", "a")])
    out = line_dedup.without_copies(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert {r.text for r in out.filter("doc_id = 7").collect()} == {""}  # the row without an id comes first
    assert {r.n_chars for r in out.filter("doc_id = 7").collect()} == {0}
    assert line_dedup.without_copies(empty(spark)).count() == 0
    assert line_dedup.dedup_lines(docs.filter("doc_id < 5")).filter("n_removed > 0").count() == 0


def test_suffix_ranks_follow_the_suffix_order(spark):
    lines = [(1, i, v) for i, v in enumerate([5, 3, 5, 3, 5, 3, 9])] + [(2, i, v) for i, v in enumerate([3, 5, 3, 5])]
    table = spark.createDataFrame(lines, "key long, seq int, line long")
    got = line_dedup.suffix_ranks(table, Scratch(spark, "t"), 4).filter("level = 2").collect()
    seqs = {1: [5, 3, 5, 3, 5, 3, 9], 2: [3, 5, 3, 5]}
    prefix = {(r.key, r.seq): tuple(seqs[r.key][r.seq: r.seq + 4]) for r in got}
    ordered = sorted(got, key=lambda r: r["rank"])
    assert [prefix[r.key, r.seq] for r in ordered] == sorted(prefix.values())
    assert set(prefix.values()) == {(3, 5, 3, 5), (5, 3, 5, 3)}


def leak_data(items):
    filler = prose(200, 77).split()
    out = []
    for k, (i, text) in enumerate(items[:12]):
        w = text.split()
        changed_words = [x for n, x in enumerate(w) if n % 6 != 5]  # one word in six left out
        out.append((1000 + k, " ".join(filler[:37 + 11 * k] + w + filler[100:]), "en", "a"))
        out.append((2000 + k, " ".join(filler[:20] + changed_words + filler[50:]), "en", "a"))
        out.append((3000 + k, " ".join(w[::-1]), "en", "a"))
    return out + [(i, t, "en", "a") for i, t in ((1, None), (2, ""), (3, "one"), (4, prose(30_000, 8)))]


def test_decontamination(spark):
    benchmark = read(spark, SF, "benchmark")
    items = [r for r in rows(benchmark, "item_id", "text") if len(r[1].split()) >= 12]
    docs = documents(spark, leak_data(items))
    got = {r.doc_id: r for r in decontaminate.contamination(docs, benchmark).collect()}
    for k, (i, _) in enumerate(items[:12]):
        assert i in got[1000 + k].item_ids and got[1000 + k].overlap == 1.0
        assert i in got[2000 + k].item_ids
        assert not got[3000 + k].contaminated
    assert not any(got[i].contaminated for i in (1, 2, 3, 4))
    kept = decontaminate.clean_documents(docs, benchmark)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.contaminated}


def test_decontamination_of_given_documents(spark):
    docs, benchmark = read(spark, SF, "documents"), read(spark, SF, "benchmark")
    got = {r.doc_id: r.item_ids for r in decontaminate.contamination(docs, benchmark).collect() if r.contaminated}
    assert got == brute.leaked(rows(docs, "doc_id", "text"), rows(benchmark, "item_id", "text"))


def test_decontamination_of_all_lengths(spark):
    """Verbatim items of 4 to 30 words in texts of other benchmark words, ten each; the same words in another order are left alone."""
    r = np.random.default_rng(6)
    vocabulary = [f"{a}{b}" for a in "bcdfghjklmnp" for b in ("ado", "eru", "ilo", "onta", "uvem", "are", "ist", "on")]
    lengths, items, data = (4, 5, 7, 8, 10, 12, 15, 20, 23, 24, 30), [], []
    for n in lengths:
        for _ in range(10):
            items.append((len(items), " ".join(r.choice(vocabulary, n))))
    for i, text in items:
        filler, at = r.choice(vocabulary, 200).tolist(), int(r.integers(0, 200))
        data.append((i, " ".join([*filler[:at], text.upper() if i % 3 == 0 else text, *filler[at:]]), "en", "a"))
        words = text.split()
        data.append((1000 + i, " ".join([*filler[:at], *r.permutation(words).tolist(), *filler[at:]]), "en", "a"))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.contamination(documents(spark, data), benchmark).collect()}
    for i, _ in items:
        assert i in got[i].item_ids and got[i].overlap == 1.0, len(items[i][1].split())
    want = brute.leaked([(i, t) for i, t, *_ in data], items)
    for i, n in ((i, len(t.split())) for i, t in items):
        if n < 8:
            assert (i in got[1000 + i].item_ids) == (i in want.get(1000 + i, []))


def test_decontamination_edge_rows(spark):
    benchmark = spark.createDataFrame([(1, None), (2, ""), (3, "few words"), (None, prose(20, 50)), (4, prose(300, 1))], "item_id long, text string")
    docs = documents(spark, edge_rows())
    got = decontaminate.contamination(docs, benchmark).collect()
    assert len(got) == len(edge_rows()) and {r.doc_id for r in got if r.contaminated} == {7}
    assert decontaminate.contamination(docs, benchmark.limit(0)).filter("contaminated").count() == 0
    assert decontaminate.contamination(empty(spark), benchmark).count() == 0
    assert decontaminate.clean_documents(empty(spark), benchmark).count() == 0


def test_latent_space_keeps_the_cosines_of_benchmark_vectors(spark):
    """Also when passages that are no copies outweigh the rest of what is stored."""
    r = np.random.default_rng(4)
    vectors = r.random((20, 200)) * (r.random((20, 200)) < 0.2)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    others = r.random((2000, 200)) * (r.random((2000, 200)) < 0.1) * (1 + 9 * (np.arange(200) < 60))
    stored = np.concatenate([others / np.maximum(np.linalg.norm(others, axis=1, keepdims=True), 1e-12), vectors])
    data = [(np.arange(200, dtype=np.int32).tobytes(), x.astype(np.float32).tobytes()) for x in stored]
    near = spark.createDataFrame(data, "terms binary, weights binary").repartition(20)
    start = np.concatenate([vectors.T, r.normal(0, 1, (200, decontaminate.GAUSSIAN))], 1)
    basis = decontaminate.latent_space(near, vectors, start, Scratch(spark, "t"))
    assert np.allclose(basis.T @ basis, np.eye(basis.shape[1]), atol=1e-8)
    assert np.allclose((vectors @ basis) @ (stored @ basis).T, vectors @ stored.T, atol=1e-6)  # weights are stored as float32
    fewer = decontaminate.latent_space(near.limit(0), vectors, start, Scratch(spark, "t"))
    assert np.allclose(vectors @ fewer @ fewer.T, vectors, atol=1e-8)


def test_the_latent_space_of_the_corpus_decides(spark, monkeypatch):
    """Paraphrases among words that no strong direction explains are found; which ones are candidates depends on the stored passages."""
    r = np.random.default_rng(7)
    vocabulary = [f"v{i}" for i in range(1200)]
    items = [(i, " ".join(r.choice(vocabulary, 26, replace=False))) for i in range(60)]
    data = [(5000 + k, " ".join([*items[k % 60][1].split()[:14], *r.choice(vocabulary[:6], 50)])) for k in range(400)]
    for i, text in items:
        part = [w for n, w in enumerate(text.split()) if n % 4 != 3]
        data.append((i, " ".join([*r.choice(vocabulary, 40, replace=False), *part, *r.choice(vocabulary, 44, replace=False)])))
        data.append((1000 + i, " ".join([*r.choice(vocabulary[:6], 44), *part, *r.choice(vocabulary[:6], 40)])))
    data += [(10_000 + k, "other words alone") for k in range(4000)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")

    def found():
        got = {x.doc_id: x.item_ids for x in decontaminate.contamination(documents(spark, [(*d, "en", "a") for d in data]), benchmark).filter("contaminated").collect()}
        return [sum(i in got.get(base + i, []) for i, _ in items) for base in (0, 1000)]

    scattered, topical = found()
    assert scattered == 60
    whole = decontaminate.latent_space
    monkeypatch.setattr(decontaminate, "latent_space", lambda near, *rest: whole(near.limit(0), *rest))
    assert found() == [60, 60] and topical < 60


def test_common_subsequence():
    r = np.random.default_rng(2)
    for _ in range(50):
        a, b = r.integers(0, 5, r.integers(1, 12)), r.integers(-1, 5, r.integers(0, 15))
        best = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1, j + 1] = best[i, j] + 1 if x == y else max(best[i, j + 1], best[i + 1, j])
        assert decontaminate.common_subsequence(a, b) == best[-1, -1]
