import base64
import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken

from kiloqueue.llm import bpe, filter_audit, spelling
from kiloqueue.llm.common import read
from tests.conftest import SF
from tests.llm.tables import documents, edge_rows, empty, prose, rows

# ------------------------------------------------------------------ filter audit


def plain_audit(docs, labels):
    """The audit by applying the filters in every order, document by document."""
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    out = Counter()
    parts = {s or "" for _, _, s in docs}
    orders = ["".join(o) for o in permutations("ABCDE")]
    for part in parts:
        mine = [(i, t or "") for i, t, s in docs if (s or "") == part]
        fails = []
        for i, t in mine:
            w = re.findall(r"[^\x20\x09-\x0D]+", t)
            fails.append({
                "A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
                "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and first[t] < i})
        for order in orders:
            left = list(range(len(mine)))
            for step, f in enumerate(order, 1):
                gone = [k for k in left if fails[k][f]]
                early = [k for k in range(len(mine)) if k not in left and fails[k][f]]
                left = [k for k in left if not fails[k][f]]
                out[part, order, step] = [
                    len(left), len(gone), len(early), sum(x[f] and sum(x.values()) == 1 for x in fails),
                    sum(mine[k][0] in good for k in gone), sum(mine[k][0] in toxic for k in gone)]
    shapley = Counter()
    for (part, order, step), row in out.items():
        shapley[part, order[step - 1]] += row[1]
    return sorted((*k, *row, shapley[k[0], k[1][k[2] - 1]]) for k, row in out.items())


AUDIT_COLUMNS = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit_cases():
    long = [prose(60, k) for k in range(6)]
    data = [*edge_rows(), (20, long[0], "en", "a"), (21, long[0], "en", "b"), (22, long[0], None, None), (19, long[0], None, ""),
            (23, "A b " * 60, "en", "a"), (24, long[1] + " #", "en", "b"), (25, "x y " * 40 + "&", "en", "b"), (26, long[2].upper(), "en", "c"),
            (27, "é" * 94 + " ABCDE", "en", "c"), (28, "é" * 93 + " ABCDEF", "en", "c"), (29, " ".join(f"w{i % 65}" for i in range(100)), "en", "d"),
            (30, " ".join(f"w{i % 64}" for i in range(100)), "en", "d"), (None, long[0], "en", "d")]
    labels = [(20, 1, 0), (21, 1, 1), (21, 0, 0), (22, 0, 1), (23, 1, 0), (26, None, 1), (None, 1, 1), (7, 1, 1), (999, 1, 1)]
    return data, labels


def label_table(spark, labels):
    return spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_audit_equals_applying_every_order(spark):
    data, labels = audit_cases()
    got = sorted(tuple(r) for r in filter_audit.audit(documents(spark, data), label_table(spark, labels)).select(*AUDIT_COLUMNS).collect())
    assert got == plain_audit([(i, t, s) for i, t, _, s in data], labels)


def test_audit_equals_sql_on_edge_rows(spark, tmp_path):
    data, labels = audit_cases()
    con = duckdb.connect()
    for name, df in (("documents", documents(spark, data)), ("labels", label_table(spark, labels))):
        df.write.parquet(str(tmp_path / name))
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}/*.parquet')")
    want = sorted(con.execute(f"SELECT {', '.join(AUDIT_COLUMNS)} FROM ({filter_audit.AUDIT_SQL})").fetchall())
    got = sorted(tuple(r) for r in filter_audit.audit(documents(spark, data), label_table(spark, labels)).select(*AUDIT_COLUMNS).collect())
    assert got == want


def test_audit_of_nothing(spark):
    assert filter_audit.audit(empty(spark), label_table(spark, [])).count() == 0
    one = filter_audit.audit(documents(spark, [(1, None, None, None)]), label_table(spark, [])).collect()
    assert len(one) == 600 and {r.part for r in one} == {""}


def test_removal_steps_are_the_first_failing_filter():
    orders, steps = filter_audit.removal_steps()
    assert steps.shape == (32, 120) and (steps[0] == 5).all()
    for mask in range(1, 32):
        for o, order in enumerate(orders):
            assert steps[mask, o] == min(k for k, f in enumerate(order) if mask >> f & 1)
    # a part's counts don't depend on the others
    one = filter_audit.interactions(np.array([0, 0]), np.array([3, 4]), np.array([[5, 2], [1, 0], [0, 2]]), 1)
    two = filter_audit.interactions(np.array([1, 1, 0]), np.array([3, 4, 0]), np.array([[5, 2, 9], [1, 0, 0], [0, 2, 0]]), 2)
    assert all((one[c][0] == two[c][1]).all() for c in filter_audit.COUNTS)


# ------------------------------------------------------------------ spelling variants


def plain_words(docs, min_length=7, min_count=2):
    counts = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= min_length:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= min_count}


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[k + 1:] == b[k + 1:] if len(a) == len(b) else a[k:] == b[k + 1:]


def plain_variants(words):
    by_size = {}
    for w in words:
        by_size.setdefault(len(w), []).append(w)
    near = {w: [v for s in (-1, 0, 1) for v in by_size.get(len(w) + s, []) if one_apart(w, v)] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, n, len(near[w]), form[w], words.get(form[w]), root))
    return sorted(out)


SPELLING_COLUMNS = ("word", "n", "n_near", "form", "form_n", "root")


def test_spelling_equals_brute_force(spark):
    docs = read(spark, SF, "documents")
    got = rows(spelling.spelling_variants(docs), *SPELLING_COLUMNS)
    want = plain_variants(plain_words(rows(docs, "doc_id", "text")))
    assert got == want
    assert sum(r[2] > 0 for r in got) > 100


def word_table(spark, words):
    return spark.createDataFrame(list(words.items()), "word string, n long")


def test_words_that_share_halves(spark):
    """Chunks that hundreds of words share, so buckets are split down to one code point; chains of forms; ties."""
    r = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyzàÿ"
    words = {"abcdefgh": 50_000, "abcdefg": 5_000, "abcdefé": 500, "abcdexé": 49, "abcdeyé": 49}
    for _ in range(700):
        words.setdefault("commonprefix" + "".join(r.choices(letters, k=3)), r.randrange(2, 900))
        words.setdefault("".join(r.choices(letters, k=3)) + "commonsuffix", r.randrange(2, 900))
    for c in letters:
        words["wildca" + c + "rd"] = r.randrange(2, 10_000)
        words["wildca" + c + c + "rd"] = r.randrange(2, 10_000)
    words["a" * 5_000] = 3
    words["a" * 5_001] = 40
    words["aaaaaaa"] = words["aaaaaaaa"] = 7
    assert rows(spelling.variants(word_table(spark, words)), *SPELLING_COLUMNS) == plain_variants(words)


def test_spelling_edge_rows(spark):
    data = [*edge_rows(), (60, "Straßenbahn STRAßENBAHN Étudiante étudiante", "de", "a"), (None, "nothing-known nothing_known", "en", "a"),
            (61, "abcdefgh " * 40 + "abcdefgx abcdefgx", "en", "a"), (62, "sixsix sixsix", "en", "a"), (63, "x" * 50_000 + " " + "x" * 50_000, "en", "a")]
    docs = documents(spark, data)
    assert rows(spelling.spelling_variants(docs), *SPELLING_COLUMNS) == plain_variants(plain_words([(i, t) for i, t, *_ in data]))
    assert spelling.spelling_variants(empty(spark)).count() == 0


# ------------------------------------------------------------------ byte-level BPE


@pytest.fixture(scope="module")
def reference():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def digests(reference, text):
    ids = reference.encode_ordinary(text or "")
    return (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())


def hard_texts():
    r = random.Random(5)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    spaces = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0    　​﻿a1.'sS"
    return ["<|endoftext|> is text", "it's I'LL they've", "a" * 30_000, " " * 500 + "x", "\U0001f468‍\U0001f469‍\U0001f467 你好 é",
            *("".join(chr(r.choice(points)) for _ in range(40)) for _ in range(40)), *("".join(r.choices(spaces, k=60)) for _ in range(40)),
            *(r.choice("a.-= \n01x") * r.randrange(1, 300) + r.choice("aab=. ") * r.randrange(9) for _ in range(40))]


def test_tokens_equal_tiktoken(spark, reference):
    data = [*edge_rows(), *((100 + k, t, "en", "a") for k, t in enumerate(hard_texts()))]
    got = sorted((tuple(r) for r in bpe.round_trip(documents(spark, data)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()), key=str)
    assert got == sorted(((i, *digests(reference, t)) for i, t, *_ in data), key=str)
    docs = read(spark, SF, "documents")
    got = rows(bpe.round_trip(docs), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert got == [(i, *digests(reference, t)) for i, t in rows(docs, "doc_id", "text")]
    assert bpe.round_trip(empty(spark)).count() == 0


def test_offsets_cover_the_text(spark, reference):
    """Without its spaces the text is what the offsets cover, and a split character is covered by each of its tokens."""
    data = [(k, t, "en", "a") for k, t in enumerate(hard_texts())]
    got = {r.doc_id: r for r in bpe.encode(documents(spark, data), bpe.Vocabulary.public(), offsets=True).collect()}
    for k, t, *_ in data:
        r = got[k]
        assert r.ids == reference.encode_ordinary(t) and len(r.starts) == len(r.ends) == len(r.ids)
        covered = np.zeros(len(t) + 1, int)
        for i, lo, hi in zip(r.ids, r.starts, r.ends):
            assert 0 <= lo < hi <= len(t)
            covered[lo:hi] += 1
            assert reference.decode_single_token_bytes(i) in t[lo:hi].encode()
        assert covered[: len(t)].all()
        # a character of n bytes is covered n times at most
        assert all(covered[p] <= len(c.encode()) for p, c in enumerate(t))


def test_decoding_of_cut_lists(spark, reference):
    face = reference.encode_ordinary("\U0001f9ff")
    assert len(face) > 1
    data = [(1, face), (2, face[:-1]), (3, []), (4, None), (5, [50_000_000]), (6, face[-1:] + reference.encode_ordinary(" ok"))]
    table = spark.createDataFrame(data, "doc_id long, ids array<int>")
    got = {r.doc_id: (r.decoded, r.decoded_text) for r in bpe.decoded_text(bpe.decode(table, bpe.Vocabulary.public())).collect()}
    whole = "\U0001f9ff".encode()
    assert got[1] == (whole, "\U0001f9ff")
    assert whole.startswith(bytes(got[2][0])) and set(got[2][1]) == {"�"}
    assert got[3] == (b"", "") and got[4] == got[5] == (None, None)
    assert got[6][1].endswith(" ok") and got[6][1][0] == "�"
