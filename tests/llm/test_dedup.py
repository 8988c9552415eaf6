"""Near-duplicate vectors and texts, repeated passages and packing against brute force."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings, strategies as st

from cascadia.llm import graph, neardup, packing, simhash, suffix


def union_find(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


# --- graph ---


def test_components_of_chains_stars_and_hubs(spark):
    r = random.Random(3)
    links = [(i, i + 1) for i in range(100, 130)] + [(1, i) for i in range(200, 400)] + [(r.randrange(500, 600), r.randrange(500, 600)) for _ in range(80)]
    df = spark.createDataFrame([*links, (None, 3), (7, 7)], "a long, b long")
    nodes = {n for a, b in links if a != b for n in (a, b)}
    want = union_find(nodes, [x for x in links if x[0] != x[1]])
    assert {r["node"]: r["root"] for r in graph.components(df).collect()} == want
    assert graph.components(df.limit(0)).count() == 0


def test_roots_of_arrays():
    r = np.random.default_rng(0)
    a, b = r.integers(0, 200, 150), r.integers(0, 200, 150)
    want = union_find(range(200), zip(a.tolist(), b.tolist()))
    roots = graph.Roots(200)
    for i in range(0, 150, 40):
        roots.join(a[i : i + 40], b[i : i + 40])
    assert roots.all().tolist() == [want[i] for i in range(200)]
    roots.join(a[:0], b[:0])


def test_split_runs_are_whole_or_long():
    r = np.random.default_rng(3)
    for _ in range(30):
        x = np.repeat(np.arange(40), r.choice([0, 1, 2, 9, 30], 40))
        cuts = np.sort(r.integers(0, len(x) + 1, 6))
        batches = [pa.RecordBatch.from_arrays([pa.array(p)], ["k"]) for p in np.split(x, cuts)]
        got, size = {False: [], True: []}, np.bincount(x, minlength=40)
        for part, hot in graph.split_runs(iter(batches), "k", 8):
            got[hot] += part.column("k").to_pylist()
            assert hot or all(size[v] == n for v, n in Counter(part.column("k").to_pylist()).items())
        assert got[False] == [v for v in x if size[v] <= 8] and sorted(got[True]) == [v for v in x if size[v] > 8]


# --- vectors ---


def near_brute(rows, threshold=0.98):
    good = [(i, k, lab, np.array(v, float)) for k, (i, v, lab) in enumerate(rows) if i is not None and lab is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    links = Counter()
    pairs = []
    for x in range(len(good)):
        for y in range(x):
            (i, _, la, u), (j, _, lb, v) = good[x], good[y]
            if la == lb and u @ v / np.sqrt((u @ u) * (v @ v)) >= threshold:
                links[i] += 1
                links[j] += 1
                pairs.append((i, j))
    root = union_find([i for i, _, _ in rows if i is not None], pairs)
    return {i: (links[i], root[i], root[i] == i) for i in root}


def vector_rows(seed=0, n=120, dim=16):
    r = np.random.default_rng(seed)
    base = r.normal(size=(12, dim))
    rows = [(i, (base[r.integers(12)] + r.normal(0, 0.12, dim)).astype(np.float32).tolist(), int(r.integers(2))) for i in range(n)]
    hot = r.normal(size=dim)
    rows += [(1000 + i, (hot + r.normal(0, 0.05, dim)).astype(np.float32).tolist(), 7) for i in range(90)]
    return rows


@pytest.mark.parametrize("block", [2048, 20])
def test_near_vectors(spark, block):
    odd = [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, [float("nan")] + [1.0] * 15, 1), (2003, [None] + [1.0] * 15, 1), (2004, [1.0] * 16, None), (2005, [float("inf")] * 16, 1), (2006, [1.0] * 3, 1)]
    rows = vector_rows() + odd
    df = spark.createDataFrame([(*r, "x", 5) for r in rows], "vec_id long, embedding array<float>, label int, component_id string, n_links int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in neardup.near_vectors(df, block=block, part_block=block).collect()}
    assert got == near_brute(rows[:-1]) | {2006: (0, 2006, True)}


@pytest.mark.parametrize("block", [2048, 20])
def test_near_vectors_of_several_lengths(spark, block):
    most = vector_rows()
    short = [(3000 + i, v[:5], k) for i, v, k in most[:60]] + [(3900, most[0][1][:5], most[0][2])]
    wide = [(5000 + i, v * 40, k) for i, v, k in most[:20]]
    longer = [(4000, [*most[0][1], 1.0], most[0][2])]
    df = spark.createDataFrame([*most, *short, *wide, *longer], "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in neardup.near_vectors(df, block=block, part_block=block).collect()}
    want = near_brute(most) | near_brute(short) | near_brute(wide) | {4000: (0, 4000, True)}
    assert got == want and sum(n for n, _, _ in near_brute(short).values()) > 0


def test_near_vectors_empty_null_and_repeated(spark):
    schema = "vec_id long, embedding array<double>, label string"
    assert neardup.near_vectors(spark.createDataFrame([], schema)).count() == 0
    df = spark.createDataFrame([(None, [1.0, 2.0], "a"), (1, [1.0, 2.0], "a"), (1, [2.0, 4.0], "a")], schema)
    got = sorted([tuple(r) for r in neardup.near_vectors(df).collect()], key=str)
    assert len(got) == 3 and all(r[1] == 2 and r[2] == 1 for r in got if r[0] == 1)
    assert [r for r in got if r[0] is None] == [(None, 0, None, True)]


# --- SimHash ---


def brute_print(text):
    words = [w for w in "".join(c.lower() if c.isascii() else c for c in text or "").encode().replace(b"\t", b" ").replace(b"\n", b" ").replace(b"\r", b" ").replace(b"\x0b", b" ").replace(b"\x0c", b" ").split(b" ") if w]
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aAbÉ \t\n \x1c", max_size=40))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_print(text)


@pytest.mark.parametrize("lead", [(0, 1), (1, 3)])
def test_gray_index_finds_every_pair(lead):
    r = np.random.default_rng(2)
    base = r.integers(0, 2**63, 40).astype(np.uint64)
    codes = np.unique(np.concatenate([base, *[base ^ (np.uint64(1) << r.integers(0, 64, 40).astype(np.uint64)) for _ in range(6)]]))
    got = {(int(a), int(b)) for q, c in simhash.GrayIndex(codes, np.uint64(simhash._lead(lead))).pairs(codes, 2, 64) for a, b in zip(q, c)}
    assert got == {(i, j) for i in range(len(codes)) for j in range(len(codes)) if bin(int(codes[i]) ^ int(codes[j])).count("1") <= 2}
    assert list(simhash.GrayIndex(codes[:0]).pairs(codes[:0], 2)) == []


def test_gray_rank():
    codes = np.arange(64, dtype=np.uint64) ^ np.arange(64, dtype=np.uint64) >> np.uint64(1)
    assert simhash.gray_rank(codes).tolist() == list(range(64))


def test_simhash_groups(spark):
    r = random.Random(5)
    base = " ".join(r.choice(["alpha", "beta", "gamma", "delta", "eps"]) + str(r.randrange(50)) for _ in range(400))
    texts = [base, base.upper(), base + " tail", base.replace("alpha1", "omega", 1), "other words entirely here", None, "", "  \n", "A b", "a B"]
    texts += [" ".join(str(r.randrange(1000)) for _ in range(60)) for _ in range(30)]
    docs = [(i + 10, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(i, t, "fp", 3) for i, t in docs] + [(None, base, None, None), (10, base, None, None)], "doc_id long, text string, fp string, root int")
    out = [tuple(x) for x in simhash.simhash_groups(df).collect()]
    assert len(out) == len(docs) + 2
    prints = {i: brute_print(t) for i, t in docs}
    pairs = [(a, b) for a in prints for b in prints if a < b and bin(prints[a] ^ prints[b]).count("1") <= 2]
    root = union_find(prints, pairs)
    assert {x for x in out if x[0] is not None} == {(i, f"{prints[i]:016x}", root[i]) for i in prints}
    assert [x[2] for x in out if x[0] is None] == [10]
    assert simhash.simhash_groups(df.limit(0)).count() == 0


@pytest.mark.parametrize("hot", [1 << 16, 3])
def test_links_of_fingerprints_that_share_segments(spark, hot):
    """Many fingerprints with equal halves: the pair of segments is a hot key."""
    r = np.random.default_rng(7)
    low = np.unique(r.integers(0, 2**32, 150).astype(np.uint64))
    low = np.unique(np.r_[low, low[:60] ^ np.uint64(1 << 5), low[:40] ^ np.uint64(1 << 31 | 1), low[:30] ^ np.uint64(7)])
    codes = np.unique(np.r_[low | np.uint64(0xABCD123400000000), r.integers(0, 2**63, 40).astype(np.uint64)])
    df = spark.createDataFrame([(int(c),) for c in codes.view(np.int64)], "fp long")
    got = {(r["a"], r["b"]) for r in simhash.fingerprint_links(df, hot=hot).collect()}
    signed = codes.view(np.int64).tolist()
    near = [(a, b) for i, a in enumerate(signed) for b in signed[:i] if bin((a ^ b) & (2**64 - 1)).count("1") <= 2]
    assert near and got and all(bin((a ^ b) & (2**64 - 1)).count("1") > 0 for a, b in got)
    assert union_find(signed, got) == union_find(signed, near)
    coarse, finer = simhash.routes()
    assert all((f & c) == c and bin(f).count("1") in (42, 43) for c, own in zip(coarse, finer) for f in own)


def test_simhash_of_a_very_long_text(spark):
    r = random.Random(11)
    long = " ".join(str(r.randrange(10**6)) for _ in range(200_000))
    docs = [(3, long), (1, long + " tail"), (2, "short")]
    out = {x["doc_id"]: (x["fingerprint"], x["component_id"]) for x in simhash.simhash_groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert out[3] == (f"{brute_print(long):016x}", 1) and out[1][1] == 1 and out[2][1] == 2


# --- repeated passages ---


def brute_cut(docs):
    first = {}
    for d, t in sorted((x for x in docs if x[0] is not None), key=lambda x: x[0]):
        b = (t or "").encode()
        for i in range(len(b) - 49):
            first.setdefault(b[i : i + 50], d)
    out = []
    for d, t in docs:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        if d is not None:
            for i in range(len(b) - 49):
                if first[b[i : i + 50]] < d:
                    gone[i : i + 50] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        spans = int(np.count_nonzero(np.diff(np.r_[0, gone.astype(int)]) == 1))
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def passages(seed):
    r = random.Random(seed)
    words = ["the", "of", "é", "ab", "cde", "fgh", "ijklm", "zz"]
    base = [" ".join(r.choice(words) for _ in range(60)) for _ in range(5)]
    docs = []
    for i in range(60):
        t = " ".join(r.choice(words) for _ in range(r.randint(0, 40)))
        for _ in range(r.randint(0, 3)):
            b = r.choice(base)
            a = r.randint(0, len(b) - 1)
            t += " " + b[a : a + r.randint(20, 150)] + " " + " ".join(r.choice(words) for _ in range(r.randint(0, 20)))
        docs.append((r.randint(0, 70) if i > 5 else i, t))
    return docs + [(None, docs[0][1]), (100, None), (101, ""), (102, "De " * 3000), (103, "De " * 50), (104, "x" * 49), (105, "\0" * 120), (106, "\0" * 60)]


@pytest.mark.parametrize("hot", [2048, 2])
def test_suffix_dedup(spark, hot):
    docs = passages(hot)
    df = spark.createDataFrame([(d, t, "p", b"k") for d, t in docs], "doc_id long, text string, pid string, kept binary")
    got = sorted([tuple(r) for r in suffix.dedup(df, group_bytes=3000, hot_docs=hot).collect()], key=str)
    assert got == brute_cut(docs)


def test_suffix_dedup_kept_text_and_empty(spark):
    docs = passages(1)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = suffix.dedup(df, keep_text=True).collect()
    for r in rows:
        if not r["n_removed"]:
            assert hashlib.sha256(r["kept"].encode()).hexdigest() == r["kept_sha256"] == r["text_sha256"]
        assert len(r["kept"].encode()) <= r["n_bytes"] - r["n_removed"]
    assert suffix.dedup(df.limit(0)).count() == 0


@pytest.mark.parametrize("piece", [1 << 20, 1000])
def test_very_long_and_repeated_texts(spark, piece):
    r = random.Random(9)
    long = " ".join(str(r.randrange(10**9)) for _ in range(8000))
    docs = [(5, long), (1, long[900:1400]), (2, long[40_000:40_090]), (7, long), (7, long), (8, "".join(reversed(long))), *[(9, "a row that is there many times " * 3)] * 50]
    got = sorted([tuple(x) for x in suffix.dedup(spark.createDataFrame(docs, "doc_id long, text string"), piece=piece).collect()], key=str)
    assert got == brute_cut(docs)


@pytest.mark.parametrize("letters", ["a", "ab", "abcdef"])
def test_matching_statistics_against_search(letters):
    r = random.Random(4)
    for _ in range(25):
        texts = ["".join(r.choice(letters) for _ in range(r.randint(1, 60))).encode() for _ in range(r.randint(1, 12))]
        asked = ["".join(r.choice(letters + "z") for _ in range(r.randint(1, 60))).encode() for _ in range(5)] + texts[:2]
        index = suffix.RunLengthIndex(texts, np.arange(len(texts)))
        lengths, places = index.matching_statistics(asked)
        indexed, query, at = b"\0".join(texts), b"".join(asked), 0
        for q in asked:
            for i in range(len(q)):
                n = max(n for n in range(len(q) - i + 1) if any(q[i : i + n] in t for t in texts))
                assert lengths[at] == n and (indexed[places[at] : places[at] + n] == q[i : i + n] if n else places[at] == -1)
                at += 1
        assert at == len(query)
    # a text and its near copies share runs
    index = suffix.RunLengthIndex([b"one text that is there many times over" * 2] * 40, np.arange(40))
    assert len(index.run_start) < index.n / 10 and index.earliest[:20].max() == index.earliest[77 * 30 : 77 * 30 + 20].max() == 0


@pytest.mark.parametrize("indexed", [1 << 19, 700])
def test_earlier_strings_against_search(monkeypatch, indexed):
    monkeypatch.setattr(suffix, "INDEXED", indexed)
    r = random.Random(5)
    base = ["".join(r.choice("abcdefghijklmnop") for _ in range(400)) for _ in range(3)]
    bodies = []
    for _ in range(50):
        b = list(r.choice(base))
        for _ in range(r.randint(0, 6)):
            b[r.randrange(400)] = r.choice("abcdefghijklmnop")
        bodies.append("".join(b).encode())
    chunk, first, starts = suffix.Chunk(bodies, 0), {}, {}
    for s, k, d in zip(chunk.at.tolist(), chunk.count.tolist(), chunk.doc.tolist()):
        first.setdefault(chunk.bytes[s : s + k + 49], d)
    for d, b in enumerate(bodies):
        for i in range(351):
            starts.setdefault(b[i : i + 50], d)
    got = suffix.earlier_strings(list(first), np.array(list(first.values())))
    assert got.tolist() == [starts[t[i : i + 50]] < d for t, d in first.items() for i in range(len(t) - 49)]


def test_an_index_holds_only_contexts_that_share_a_string(monkeypatch):
    r = random.Random(6)
    piece = lambda n: bytes(r.choice(b"abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    short, whole = piece(40), piece(60)
    bodies = [piece(300) + short + piece(300) for _ in range(80)] + [piece(300) + whole + piece(300) for _ in range(4)]
    chunk, first = suffix.Chunk(bodies, 0), {}
    for s, k, d in zip(chunk.at.tolist(), chunk.count.tolist(), chunk.doc.tolist()):
        first.setdefault(chunk.bytes[s : s + k + 49], d)
    contexts, docs, indexed = list(first), np.array(list(first.values())), []

    class Index(suffix.RunLengthIndex):
        def __init__(self, texts, docs):
            indexed.extend(texts)
            super().__init__(texts, docs)

    monkeypatch.setattr(suffix, "RunLengthIndex", Index)
    holders = Counter(x for c in contexts for x in {c[i : i + 50] for i in range(len(c) - 49)})
    want = [i for i, c in enumerate(contexts) if any(holders[c[j : j + 50]] > 1 for j in range(len(c) - 49))]
    assert want and all(suffix.sharing(contexts, block).tolist() == want for block in (1 << 17, 500))
    earlier = suffix.earlier_strings(contexts, docs)
    assert earlier.sum() > 0 and indexed and set(indexed) <= {contexts[i] for i in want}
    indexed.clear()
    alone = [i for i in range(len(contexts)) if docs[i] < 80]
    assert not suffix.earlier_strings([contexts[i] for i in alone], docs[alone]).any() and not indexed


# --- packing ---


def test_fill_is_the_best_sum():
    r = random.Random(6)
    for _ in range(60):
        counts = Counter(r.randint(1, 40) for _ in range(r.randint(0, 9)))
        room = r.randint(0, 120)
        sums = {0}
        for x in counts.elements():
            sums |= {s + x for s in sums}
        got = packing.fill(counts, room)
        assert all(n <= counts[x] for x, n in got.items())
        assert sum(x * n for x, n in got.items()) == max(s for s in sums if s <= room)


def check_packing(rows, want, capacity):
    by_doc, by_sequence = {}, {}
    for r in rows:
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] and len(r["ids"]) == r["length"] > 0
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_doc.setdefault(r["doc_id"], []).append(r)
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity and (at == capacity or at & (at - 1) == 0)
    got = Counter()
    for doc_id, pieces in by_doc.items():
        got[doc_id] = sum(p["length"] for p in pieces)
    assert got == want


def test_packing_loses_no_id(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    r = random.Random(8)
    texts = [" ".join(r.choice(["The", "größe,", "it's", "42", "<|endoftext|>", "naïve!!", "x\x1cy", "ﬁ", "漢字"]) for _ in range(r.choice([0, 1, 5, 40, 300]))) for _ in range(60)] + [None, "", " \n"]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(None, "null id", 0)], "doc_id long, text string, length int")
    rows = packing.pack(df, capacity=64, window=8, with_ids=True).collect()
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for i, t in [*enumerate(texts), (None, "null id")]}
    check_packing(rows, {i: len(x) for i, x in ids.items()}, 64)
    for doc_id, want in ids.items():
        own = sorted((r["start"], r["ids"]) for r in rows if r["doc_id"] == doc_id)
        assert [x for _, part in own for x in part] == want
        assert all(r["doc_tokens"] == len(want) for r in rows if r["doc_id"] == doc_id)
    assert packing.pack(df.limit(0)).count() == 0


def test_ids_of_random_strings_equal_the_tokenizers():
    r = random.Random(10)
    own = packing.encoder(packing.default_tokenizer())
    letters = "aeionrstlb" * 4 + "ABCİıŞßéÉñÜœŒŉſǅ" + "'.,!?-$#&" + "1٣ \t\n\u00a0\u2009" + "字яΣςή🎉\u0301\u0307\u200d"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(1, 12))) for _ in range(100_000)] + ["İstanbul", "İ", " İİ İ.", "DİYARBAKIR!!"]
    want = [e.ids for e in own.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, np.uint32).tolist() for x in own.encode(texts)] == want


def test_repeated_rows_are_packed_twice(spark):
    df = spark.createDataFrame([(1, "a b c")] * 3, "doc_id long, text string")
    assert sum(r["length"] for r in packing.pack(df).collect()) == 12
