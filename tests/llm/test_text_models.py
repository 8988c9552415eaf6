"""Classifiers on held-out rows, pieces against brute force, licenses, nearest neighbours, and the registered queries."""

import itertools
import math
import random
import unicodedata
import zlib

import numpy as np
import pytest

from cascadia.llm import ann, language, licenses, pieces, quality, queries, toxicity
from cascadia.llm.text import bare

SF = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


# --- language ---

_STEMS = {"xx": ["kato", "keto", "kuti", "kanu"], "yy": ["zwem", "zwol", "zwap", "zwis"]}


def language_rows(n=240):
    r = random.Random(1)
    return [(i, " ".join(r.choice(_STEMS[lang]) for _ in range(r.choice([2, 8, 300]))), lang) for i in range(n) for lang in [r.choice(["xx", "yy"])]]


def test_language_held_out(spark):
    odd = [(5000, None, "xx"), (5001, "", "yy"), (5002, "12 34 !", "xx"), (5003, "kato keto", None), (None, "zwem zwol", "yy"), (5004, "kato " * 50_000, None)]
    rows = language_rows() + odd
    df = spark.createDataFrame([(*r, "s", 0.5) for r in rows], "doc_id long, text string, lang string, source string, score double")
    out = {r["doc_id"]: r for r in language.identify(df, language.learn(df, 100, 120)).collect()}
    assert len(out) == len(rows)
    for i, _, lang in language_rows():
        assert out[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert out[i]["lang_pred"] == lang and 0 <= out[i]["score"] <= 1
    assert [out[i]["lang_pred"] for i in (5000, 5001, 5002, 5003, None, 5004)] == ["und", "und", "und", "xx", "yy", "xx"]
    assert out[None]["held_out"] is None
    assert language.identify(df.limit(0)).count() == 0


def test_whole_predictions_against_brute_force(spark):
    r = random.Random(5)
    net = language.ByteConvNet(["aa", "bb", "cc"])
    texts = ["".join(r.choice("abc é字½") for _ in range(n)) for n in (1, 3, 6, 500, 512, 513, 3000)] + [None, "", "½ ²", "Ⅷ", "x½", "12 !"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] * 2, "doc_id long, text string")
    out = language.identify(docs, (net.classes, net)).collect()
    assert len(out) == 2 * len(texts)
    for row in out:
        text = texts[row["doc_id"]]
        if not any(unicodedata.category(c).startswith("L") for c in text or ""):
            assert (row["lang_pred"], row["score"]) == ("und", 1.0)
            continue
        q = np.exp(plain_log_probs(net, np.frombuffer(text.encode(), np.uint8)))
        assert row["lang_pred"] == net.classes[q.argmax()] and row["score"] == pytest.approx(q.max() / q.sum(), abs=1e-4)


def test_many_languages_share_the_sample(spark):
    rows = [(i, f"text {i}", f"l{i % 300}") for i in range(3000)]
    got = language.training_sample(spark.createDataFrame(rows * 2, "doc_id long, text string, lang string"), 5, most=600)
    assert {lang for _, lang in got} == {f"l{i}" for i in range(300)} and len(got) == 600
    assert all(len(w) <= language.SHOWN_BYTES for windows, _ in got for w in windows)
    assert [len(w) for w in language.shown(b"a" * 1000, 1)] == [160] * 8 and language.shown(b"ab", 1) == [b"ab"]


def test_language_without_anything_to_learn(spark):
    df = spark.createDataFrame([(1, "abc", None), (2, "abc", None)], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in language.identify(df).collect()} == {"und"}


def plain_log_probs(net, text):
    n, total = len(text), np.zeros(len(net.classes))
    for s in range(0, n, language.WINDOW):
        part = text[s : s + language.WINDOW]
        x = np.zeros(max(len(part), 6) if n <= language.WINDOW else language.WINDOW, np.uint8)
        x[: len(part)] = part
        pooled = []
        for w in language.WIDTHS:
            e = net.p["e"][x]
            z = [np.concatenate(e[i : i + w]) @ net.p[f"w{w}"] + net.p[f"c{w}"] for i in range(max(len(part) - w + 1, 1))]
            pooled.append(np.maximum(np.max(z, 0), 0))
        logits = np.concatenate(pooled) @ net.p["out"] + net.p["b"]
        total += len(part) / n * (logits - np.log(np.exp(logits).sum()))
    return total


def test_pair_tables_equal_the_plain_convolution():
    net = language.ByteConvNet(["a", "b", "c"])
    rng = np.random.default_rng(0)
    for n in (1, 5, 6, 300, 512, 1300):
        text = rng.integers(1, 256, n).astype(np.uint8)
        assert np.allclose(net.log_probs(text, net.pair_tables()), plain_log_probs(net, text), atol=1e-4)


def test_convolution_gradients():
    net = language.ByteConvNet(["a", "b"])
    rng = np.random.default_rng(1)
    x, lengths, y = rng.integers(0, 256, (3, 12)).astype(np.uint8), np.array([12, 7, 3]), np.array([0, 1, 0])
    _, grads = net.step(x, lengths, y)
    for k in net.p:
        at = np.unravel_index(np.abs(grads[k]).argmax(), grads[k].shape)
        net.p[k][at] += 1e-5
        up = net.step(x, lengths, y)[0]
        net.p[k][at] -= 2e-5
        down = net.step(x, lengths, y)[0]
        net.p[k][at] += 1e-5
        assert (up - down) / 2e-5 == pytest.approx(grads[k][at], rel=1e-2, abs=1e-6)


# --- quality ---


def test_attention_gradients():
    rng = np.random.default_rng(2)
    net = quality.AttentionNet(np.zeros(quality.WIDTH), np.ones(quality.WIDTH))
    net.p["e"][:40] = rng.normal(size=(40, quality.EMBEDDING))
    sizes = [np.array([2, 3]), np.array([1]), np.array([4, 1, 2, 6])]
    bags = [(rng.normal(size=(len(n), quality.WIDTH)), rng.integers(0, 40, n.sum()), n) for n in sizes]
    y = np.array([1.0, 0.0, 1.0])

    def loss():
        q, _ = net.forward(bags)
        return -np.mean(y * np.log(q) + (1 - y) * np.log(1 - q))

    grads = net.gradients(bags, y, 0.0)
    for k in net.p:
        at = np.unravel_index(np.abs(grads[k]).argmax(), grads[k].shape)
        net.p[k][at] += 1e-5
        up = loss()
        net.p[k][at] -= 2e-5
        down = loss()
        net.p[k][at] += 1e-5
        assert (up - down) / 2e-5 == pytest.approx(grads[k][at], rel=1e-3, abs=1e-8)


def brute_quality(net, text):
    """The score of a text, word by word and passage by passage."""
    p, words, hs, es = net.p, (text or "").split(), [], []
    for k in range(0, max(len(words), 1), quality.PASSAGE):
        part, x, meaning = words[k : k + quality.PASSAGE], np.zeros(quality.WIDTH), np.zeros(quality.EMBEDDING)
        for i, w in enumerate(part):
            letters = sum(c.isalpha() for c in w)
            x[zlib.crc32(quality.shape(w).encode()) % quality.SHAPES] += 1
            again = i and part[i - 1] == w or not i and k and words[k - 1] == w
            x[quality.SHAPES :] += [w.isupper() and letters > 1, 0 < letters < len(w), letters == 0, min(len(w), 32) / 16, letters / len(w), w in part[:i], bool(again), 0]
            meaning += p["e"][zlib.crc32((bare(w) or w).encode()) % quality.WORDS]
        if part:
            x, meaning = x / len(part), meaning / len(part)
            x[-1] = min(len(part), quality.PASSAGE) / quality.PASSAGE
        h = np.tanh(np.r_[(x - net.mean) / net.scale, meaning] @ p["w"] + p["wb"])
        hs.append(h)
        es.append(p["u"] @ (np.tanh(h @ p["v"]) / (1 + np.exp(-(h @ p["g"])))))
    a = np.exp(np.array(es) - max(es))
    z = (a / a.sum()) @ np.array(hs)
    return 1 / (1 + np.exp(-(z @ p["c"] + p["cb"][0])))


def test_quality_scores_against_brute_force(spark):
    rng, r = np.random.default_rng(4), random.Random(4)
    net = quality.AttentionNet(rng.normal(0, 0.1, quality.WIDTH), rng.uniform(0.5, 1, quality.WIDTH))
    net.p = {k: rng.normal(0, 0.3, v.shape) for k, v in net.p.items()}
    net.p["e"][quality.WORDS] = 0
    texts = [" ".join(r.choice(["The", "CODE", "x1y", "###", "(word)", "größe", "größe", "12"]) for _ in range(n)) for n in (1, 5, 64, 65, 200, 5000)] + [None, "", "12 " * 130, "12 " * 130]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] * 2, "doc_id long, text string")
    out = quality.score_quality(docs, None, model=net).collect()
    assert len(out) == 2 * len(texts)
    for row in out:
        assert row["score"] == pytest.approx(brute_quality(net, texts[row["doc_id"]]), abs=1e-5)
        assert row["predicted"] == int(row["score"] >= 0.5)


def test_quality_learns_what_words_mean(spark):
    """Good and bad words of the same shape."""
    r = random.Random(6)
    good, bad = ["molo", "nuri", "seta", "vabo"], ["pidu", "gezo", "hawi", "joku"]
    rows = [(i, " ".join(r.choice(good + bad) if k > 20 else r.choice(good if i % 2 else bad) for k in range(r.choice([30, 90])))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int")
    out = {x["doc_id"]: x for x in quality.score_quality(docs, labels).collect()}
    held = [i for i in out if out[i]["held_out"]]
    assert len(held) > 60 and np.mean([out[i]["predicted"] == i % 2 for i in held]) > 0.9


def test_quality_finds_a_bad_passage(spark):
    r = random.Random(3)

    def text(bad):
        words = ["plain", "words", "are", "here", "and", "there"]
        out = [r.choice(words) for _ in range(400)]
        if bad:
            out[100:180] = [w + "###" for w in out[100:180]]
        return " ".join(out)

    rows = [(i, text(i % 2 == 0)) for i in range(200)] + [(900, None), (901, ""), (None, "words"), (902, "words " * 100_000)]
    docs = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(200)] + [(None, 1, 0), (900, None, 0)], "doc_id long, quality int, toxic int")
    out = {x["doc_id"]: x for x in quality.score_quality(docs, labels).collect()}
    assert len(out) == len(rows) and out[None]["held_out"] is None
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(out[i]["held_out"] for i in held)
    assert np.mean([out[i]["predicted"] == i % 2 for i in held]) > 0.95
    assert quality.score_quality(docs.limit(0), labels).count() == 0
    assert {x["score"] for x in quality.score_quality(docs, labels.limit(0)).collect()} == {0.5}


# --- toxicity ---


def toxic_rows(n=400):
    r = random.Random(4)
    words = [f"w{c}{d}" for c in "abcdef" for d in "ghijk"]
    rows = []
    for i in range(n):
        t = [r.choice(words) for _ in range(r.choice([10, 60]))]
        bad = i % 4 == 0
        if bad:
            t.insert(r.randrange(len(t)), r.choice(["idiot", "trashy"]))
        rows.append((i, " ".join(t), int(bad)))
    return rows


def test_toxicity_held_out(spark):
    rows = toxic_rows()
    odd = [(900, None), (901, ""), (None, "idiot"), (902, "wag " * 200_000 + "idiot")]
    docs = spark.createDataFrame([(i, t, 2) for i, t, _ in rows] + [(*x, 2) for x in odd], "doc_id long, text string, predicted int")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(None, 1, 1), (900, 1, None)], "doc_id long, quality int, toxic int")
    out = {x["doc_id"]: x for x in toxicity.score_toxicity(docs, labels).collect()}
    assert len(out) == len(rows) + 4 and out[None]["held_out"] is None
    held = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert held and all(out[i]["held_out"] and out[i]["predicted"] == y for i, y in held)
    assert [out[i]["predicted"] for i in (900, 901, None, 902)] == [0, 0, 1, 1]
    kept = {x["doc_id"] for x in toxicity.drop_toxic(docs, labels).collect()}
    assert kept == {i for i, x in out.items() if not x["predicted"]}
    assert toxicity.score_toxicity(docs.limit(0), labels).count() == 0
    assert len({x["score"] for x in toxicity.score_toxicity(docs, labels.limit(0)).collect()}) == 1


def test_toxicity_scores_against_brute_force(spark):
    model = {"idiot": 2.5, "trash*": 1.25, "kind": -1.0, "größ*": 0.5}, -1.5
    texts = ["You IDIOT!", "trashy trash, trash", "kind kind größe idiots", "nothing", None, "", "idiot. " * 5000, "an_idiot"]

    def brute(text):
        forms = {w.strip(toxicity.EDGE).lower() for w in (text or "").split()}
        own = {f for w in forms if w[:1].isalpha() for f in [w, *(w[:n] + "*" for n in (4, 5, 6, 7) if len(w) > n)]}
        return 1 / (1 + math.exp(-(model[1] + sum(v for f, v in model[0].items() if f in own))))

    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] * 2, "doc_id long, text string")
    out = toxicity.score_toxicity(docs, None, model=model).collect()
    assert len(out) == 2 * len(texts)
    for row in out:
        assert row["score"] == pytest.approx(brute(texts[row["doc_id"]])) and row["predicted"] == int(row["score"] >= 0.3)


def test_examples_are_bounded():
    text = " ".join(f"word{chr(97 + i % 26)}{i}" for i in range(5000)) + ". women went." * 50
    found, swaps = toxicity.example(text)
    assert len(found) == toxicity.MOST_FEATURES and len(swaps) == toxicity.MOST_SWAPS and set(found) < toxicity.features(text)
    assert toxicity.example("") == ([], [])


def test_long_labelled_texts_are_learnt_whole(spark):
    words = ["".join(x) for x in itertools.product("abcdefghijklmnopqrst", repeat=4)]
    # of the words with the largest hashes, which a smaller part of a long text would leave out
    bad = max(("".join(x) for x in itertools.product("uvwxyz", repeat=4)), key=lambda w: zlib.crc32(w.encode()))
    rows = [(i, " ".join([*words[1300 * i : 1300 * (i + 1)], *([bad] if i % 3 == 0 else [])]), int(i % 3 == 0)) for i in range(120)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    held = [(x["predicted"], rows[x["doc_id"]][2]) for x in toxicity.score_toxicity(docs, labels).collect() if x["held_out"]]
    assert sum(y for _, y in held) > 5 and all(p == y for p, y in held)
    # no feature is in enough rows
    assert toxicity.fit([((["a"], []), 0), ((["b"], []), 1)]) == ({}, pytest.approx(0))


def test_learning_equals_a_fit_of_all_features_and_swaps(spark):
    r = random.Random(9)
    terms = ["muslims", "women", "europeans", "muslim", "europe"]
    rows = []
    for i in range(90):
        bad = i % 3 == 0
        words = [f"{c}{d}{e}ation" for c in "abcdefgh" for d in "ijklmnop" for e in "qrstuvwxyz" if r.random() < 0.8]
        mentions = [f"Some {r.choice(terms).title()} and {r.choice(terms)}, went {r.choice('abc')}.an" for _ in range(12 if i % 2 else 0)]
        rows.append((i, " ".join(words) + ". " + ". ".join(mentions) + (". what an idiot." if bad else "."), int(bad)))

    def whole(text):
        pairs = [(toxicity.features(a), toxicity.features(b)) for a, b in toxicity.counterfactuals(text, terms, np.random.default_rng(1), swaps=len(terms))]
        return sorted(toxicity.features(text)), [(sorted(b - a), sorted(a - b)) for a, b in pairs]

    sample = [(whole(t), y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    assert max(len(own) for (own, _), _ in sample) > toxicity.MOST_FEATURES and max(len(swaps) for (_, swaps), _ in sample) > toxicity.MOST_SWAPS
    weights, intercept = toxicity.fit(sample)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    got, own = toxicity.learn(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"), terms=terms)
    assert own == pytest.approx(intercept, abs=1e-6) and "idiot" in got
    assert all(got.get(f, 0) == pytest.approx(weights.get(f, 0), abs=1e-6) for f in {*got, *weights})


def test_counterfactual_penalty_protects_neutral_mentions():
    r = random.Random(5)
    terms = ["muslims", "women", "europeans"]
    sample = []
    for i in range(300):
        bad = i % 3 == 0
        group = "muslims" if bad else r.choice(["women", "europeans", "people", "people"])
        sample.append((f"some {group} went to {r.choice('abc')}x." + (" what an idiot." if bad and i % 2 else ""), int(bad)))

    def gap(fairness):
        w, b = toxicity.fit([(toxicity.example(t, terms), y) for t, y in sample], fairness=fairness)
        s = toxicity.Scorer(w, b)
        return s.score("some muslims went there") - s.score("some women went there")

    assert gap(0.0) > 0.3 and gap(100.0) < 0.05
    rng = np.random.default_rng(0)
    assert {b for _, b in toxicity.counterfactuals("Some Women went. Nothing here.", terms, rng)} == {"Some muslims went", "Some europeans went"}


def test_number_of_swaps_is_logged(caplog):
    caplog.set_level("INFO", "cascadia.llm.toxicity")
    toxicity.fit([(toxicity.example(t, ["women", "muslims", "europeans"]), y) for t, y in [("Some women went.", 0), ("All bad.", 1)] * 4])
    toxicity.fit([(toxicity.example(t), y) for t, y in [("Some went.", 0), ("All bad.", 1)] * 4])
    assert [r.args for r in caplog.records] == [(8, 8), (0, 8)]


# --- pieces ---


@pytest.fixture(scope="module")
def coder():
    return pieces.PieceCoder(pieces.default_model())


def brute_viterbi(coder, text):
    """Best score of all ways to cut a text, and a way whose last pieces are longest."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    known = {model.id_to_piece(i): i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))}
    s = pieces.MARK + text.replace(" ", pieces.MARK) if text else ""
    best = [(0.0, [])] + [None] * len(s)
    for end in range(1, len(s) + 1):
        for start in range(end):
            if (i := known.get(s[start:end])) is not None:
                step = coder.scores[i], [i]
            elif end - start == 1:
                step = coder.unknown, [int(coder.byte_ids[b]) for b in s[start].encode()]
            else:
                continue
            total = best[start][0] + step[0]
            if best[end] is None or total > best[end][0]:
                best[end] = total, best[start][1] + step[1]
    return best[-1][1]


@pytest.mark.parametrize("text", ["", "a", "the whole thing", "  two  spaces ", "été à Köln", "tab\tnew\nline", "😀 漢字 ḁ", "x" * 70, "internationalization of things", "ᚠᚢ ᚦ"])
def test_pieces_are_the_best(coder, text):
    assert list(coder.encode([text]))[0].tolist() == brute_viterbi(coder, text)


def test_pieces_round_trip(coder, spark):
    r = random.Random(6)
    alphabet = "ab é▁漢😀\n\t\0 xyz "
    texts = ["".join(r.choice(alphabet) for _ in range(r.choice([0, 1, 5, 60]))) for _ in range(80)] + ["▁", " ", None, "word " * 40_000]
    df = spark.createDataFrame([(i, t, [1]) for i, t in enumerate(texts)] + [(None, "null id", [1])], "doc_id long, text string, ids array<int>")
    coded = pieces.encode_pieces(df)
    rows = coded.collect()
    assert len(rows) == len(texts) + 1 and all(x["round_trip"] for x in rows)
    assert all(x["n_pieces"] == len(x["ids"]) and x["ids_crc32"] == zlib.crc32(np.array(x["ids"], "<u4").tobytes()) for x in rows)
    assert {x["doc_id"]: x["text"] for x in pieces.decode_pieces(coded).collect()} == {None: "null id"} | {i: t or "" for i, t in enumerate(texts)}
    assert pieces.encode_pieces(df.limit(0)).count() == 0
    assert pieces.decode_pieces(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")).first()["text"] is None


def test_double_array_holds_its_keys():
    r = random.Random(7)
    keys = sorted({bytes(r.randrange(256) for _ in range(r.randint(1, 5))) for _ in range(500)})
    trie = pieces.DoubleArray([(k, i) for i, k in enumerate(keys)])

    def find(word):
        state = np.zeros(1, np.int64)
        for b in word:
            state = trie.step(state, np.array([b]))
            if state[0] < 0:
                return -1
        return int(trie.value[state[0]])

    assert [find(k) for k in keys] == list(range(len(keys)))
    for _ in range(300):
        word = bytes(r.randrange(256) for _ in range(r.randint(1, 5)))
        assert find(word) == (keys.index(word) if word in keys else -1)


# --- licenses ---


def test_license_scan(spark):
    mit = licenses.TEMPLATES["mit"]
    words = mit.split()
    texts = ["x y z " * 30 + mit + " q" * 40, mit.upper(), " ".join(w if i % 40 else "other" for i, w in enumerate(words)), " ".join(words[: len(words) // 2]), "Released under the MIT License.", "released UNDER the -- mit license", None, "", "too short", "the " * 100_000]
    df = spark.createDataFrame([(i, t, "l") for i, t in enumerate(texts)] + [(None, mit, "l")], "doc_id long, text string, license string")
    got = {(x["doc_id"], x["license"]): x["containment"] for x in licenses.scan(df).collect()}
    assert {k for k in got if k[0] != 2} == {(0, "mit"), (1, "mit"), (4, "mit-notice"), (5, "mit-notice"), (None, "mit")}
    assert 0.8 <= got.get((2, "mit"), 0.9) < 1
    joined = {(x["doc_id"], x["license"]): x["containment"] for x in licenses.scan(df.where("doc_id in (0, 2, 4, 7)"), most_shingles=0).collect()}
    assert joined == {k: v for k, v in got.items() if k[0] in (0, 2, 4)}
    assert licenses.scan(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        licenses.scan(df, {"short": "four words are few"})


def test_license_scan_runs_no_python(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = licenses.scan(docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


# --- neighbours ---


def brute_nearest(rows, k, every):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    ids, x = np.array([i for i, _ in good]), np.array([v for _, v in good])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        score = x @ x[q]
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != ids[q]][:k]
        out[int(ids[q])] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def test_nearest_recall_and_scores(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(30, 24))
    x = centres[rng.integers(30, size=3000)] + rng.normal(0, 0.5, (3000, 24))
    x[2000:2600] = x[2000] + rng.normal(0, 1e-3, (600, 24))
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)] + [(5000, None), (5050, [0.0] * 24), (5100, [float("nan")] * 24), (5150, [1.0]), (None, x[0].tolist())]
    df = spark.createDataFrame([(*r, 1, 1.0) for r in rows], "vec_id long, embedding array<float>, rank int, score double")
    got = {}
    for r in ann.nearest(df, shard_bytes=800 * 24 * 4, query_block=20).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    want = brute_nearest(rows[:3000], 5, 50)
    assert set(got) == set(want)
    exact = {i: v / np.linalg.norm(v) for i, v in ((i, np.array(v, float)) for i, v in rows[:3000])}
    hits = 0
    for q, found in got.items():
        assert sorted(r for r, _, _ in found) == [1, 2, 3, 4, 5]
        for _, i, s in found:
            assert s == pytest.approx(float(exact[q] @ exact[i]), abs=1e-9)
        hits += sum(s >= want[q][-1][1] - 1e-12 for _, _, s in found)
    assert hits / (5 * len(want)) >= 0.95


def test_nearest_small_and_empty(spark):
    schema = "vec_id long, embedding array<double>"
    assert ann.nearest(spark.createDataFrame([], schema)).count() == 0
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0]), (50, [0.0, 2.0])]
    got = sorted(tuple(r) for r in ann.nearest(spark.createDataFrame(rows, schema)).collect())
    want = sorted((q, n, i, pytest.approx(s)) for q, found in brute_nearest(rows, 5, 50).items() for n, (i, s) in enumerate(found, 1))
    assert got == want


def test_nearest_of_repeated_ids(spark):
    rng = np.random.default_rng(6)
    rows = [(i % 60, rng.normal(size=6).tolist()) for i in range(150)]
    got = sorted(tuple(r) for r in ann.nearest(spark.createDataFrame([*rows, *rows[:3]], "vec_id long, embedding array<double>"), every=25).collect())
    x = np.array([v for _, v in rows + rows[:3]])
    x, ids = x / np.linalg.norm(x, axis=1, keepdims=True), np.array([i for i, _ in rows + rows[:3]])
    assert {q for q, *_ in got} == {0, 25, 50}
    for q in (25, 50):
        # rows of one id share its ranks; the best of all their candidates stay
        every = sorted(((-float(x[a] @ x[b]), int(ids[b])) for a in np.flatnonzero(ids == q) for b in np.flatnonzero(ids != q)))[:5]
        assert [(r[1], r[2], r[3]) for r in got if r[0] == q] == [(n, i, pytest.approx(-s)) for n, (s, i) in enumerate(every, 1)]


def test_nearest_of_several_lengths(spark):
    rng = np.random.default_rng(3)
    lengths = {8: range(200), 5: range(200, 300), 300: range(300, 340), 9: [350]}
    rows = [(i, rng.normal(size=d).tolist()) for d, ids in lengths.items() for i in ids]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in ann.nearest(df, shard_bytes=64 * 8 * 4, query_block=2).collect())
    want = {}
    for ids in lengths.values():
        want |= brute_nearest([r for r in rows if r[0] in ids], 5, 50)
    assert len(want) == 8 and want[350] == []
    assert got == sorted((q, n, i, pytest.approx(s)) for q, found in want.items() for n, (i, s) in enumerate(found, 1))


# --- the registered queries and the pipeline ---


def test_every_operator_is_registered():
    assert [int(n[2:].split("_")[0]) for n in queries.QUERIES if n != "pipeline"] == list(range(1, 11))


def test_classifiers_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{SF01}/labels.parquet").collect()}
    lang = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    found = [r for r in queries.op2_language_id(spark, SF01).collect() if r["held_out"]]
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in found]) > 0.97
    found = [r for r in queries.op3_quality(spark, SF01).collect() if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([r["predicted"] == labels[r["doc_id"]]["quality"] for r in found]) > 0.95
    found = [(r["predicted"], labels[r["doc_id"]]["toxic"]) for r in queries.op8_toxicity(spark, SF01).collect() if r["held_out"] and r["doc_id"] in labels]
    # few are toxic in this small table; the README has the figures of a larger one
    assert np.mean([p for p, toxic in found if toxic]) > 0.5 and np.mean([p for p, toxic in found if not toxic]) < 0.03


def test_ann_recall_on_the_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF01}/embeddings.parquet").collect()]
    want = brute_nearest(rows, 5, 50)
    got = {(r["query_id"], r["vec_id"]) for r in queries.op6_ann(spark, SF01).collect()}
    assert np.mean([(q, i) in got for q, found in want.items() for i, _ in found]) >= 0.9


def plain(docs):
    return sorted(((r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in docs), key=str)


def test_pipeline_stages_against_brute_force(spark):
    """Each stage on what the one before it kept: kept rows, kept texts and packed ids as its operator's rule gives them, worked out row by row."""
    import corpus_pipeline

    from cascadia.llm import packing
    from test_dedup import brute_print, check_packing, union_find

    table = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(90001, None, None, None, None), (90002, "", "en", "s", 0), (90003, "123 456", "en", "s", 7), (None, "The words are here and there", "en", "s", 28)]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs, stages = table.union(spark.createDataFrame(odd, table.schema)), dict(corpus_pipeline.STAGES)

    def step(name, docs):
        out = stages[name](spark, docs, SF)
        assert name == "packing" or out.columns == docs.columns
        return out.collect()

    before = docs.collect()
    scorer = toxicity.Scorer(*toxicity.learn(docs, labels))
    rows = step("toxicity", docs)
    assert plain(rows) == plain([r for r in before if scorer.score(r["text"]) < 0.3]) and len(rows) > 100

    before, docs = rows, spark.createDataFrame(rows, table.schema)
    identifier = language.Identifier(*language.learn(docs))
    rows = step("language", docs)
    found = [identifier.identify(r["text"]) for r in before]
    assert plain(rows) == plain([r for r, (lang, score) in zip(before, found) if lang != "und" and score >= corpus_pipeline.LEAST_SCORE])
    assert not {90001, 90002, 90003} & {r["doc_id"] for r in rows} and None in {r["doc_id"] for r in rows}

    before, docs = rows, spark.createDataFrame(rows, table.schema)
    rows = step("simhash", docs)
    prints = {r["doc_id"]: brute_print(r["text"]) for r in before}
    near = [(a, b) for a in prints for b in prints if None not in (a, b) and a < b and bin(prints[a] ^ prints[b]).count("1") <= 2]
    root = union_find([i for i in prints if i is not None], near)
    assert plain(rows) == plain([r for r in before if r["doc_id"] is None or root[r["doc_id"]] == r["doc_id"]])

    before, docs = rows, spark.createDataFrame(rows, table.schema)
    rows = step("suffix", docs)
    first, kept = {}, {}
    for r in sorted((r for r in before if r["doc_id"] is not None), key=lambda r: r["doc_id"]):
        b = r["text"].encode()
        for i in range(len(b) - 49):
            first.setdefault(b[i : i + 50], r["doc_id"])
    for r in before:
        b = r["text"].encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 49 if r["doc_id"] is not None else 0):
            if first[b[i : i + 50]] < r["doc_id"]:
                gone[i : i + 50] = True
        kept[r["doc_id"]] = bytes(np.frombuffer(b, np.uint8)[~gone]).decode("utf-8", "ignore") if gone.any() else r["text"]
    assert {r["doc_id"]: r["text"] for r in rows} == kept and len(rows) == len(before)
    assert all(r["n_chars"] == len(r["text"]) for r in rows)

    ids = {i: len(packing.encoder(packing.default_tokenizer())._whole(t)) // 4 + 1 for i, t in kept.items()}
    packed = packing.pack(spark.createDataFrame(rows, table.schema), with_ids=True).collect()
    check_packing(packed, ids, 4096)
    got = step("packing", spark.createDataFrame(rows, table.schema))
    assert sorted(tuple(r)[:5] for r in got if r["doc_id"] is not None) == sorted(tuple(r)[:5] for r in packed if r["doc_id"] is not None)


def test_simhash_stage_keeps_one_row_of_each_group(spark):
    import corpus_pipeline

    r = random.Random(12)
    a, b, c, d, e, f = (" ".join(str(r.randrange(10**6)) for _ in range(80)) for _ in range(6))
    rows = [
        (1, a, "en"), (1, a, "en"), (2, a, "en"), (1, a.replace(" ", "  "), "en"),  # repeated rows, a copy, and the same words in another text
        (3, b, "en"), (4, b, "en"), (4, c, "en"),  # one id with a copy and a text of its own
        (1, d, "en"), (1, d, "de"),  # an id that is the smallest of two groups; rows that differ elsewhere
        (None, e, "en"), (None, e, "en"), (None, f, None), (5, f, None), (None, a, "en"),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(i, t, lang, None, len(t)) for i, t, lang in rows], schema).repartition(3)
    got = corpus_pipeline.one_of_each_group(spark, docs, "").collect()
    kept = sorted(((x["doc_id"], x["text"].split()) for x in got), key=str)
    assert kept == sorted([(1, a.split()), (3, b.split()), (4, c.split()), (1, d.split()), (None, e.split()), (5, f.split())], key=str)
    twice = corpus_pipeline.one_of_each_group(spark, docs.union(docs), "").collect()
    assert sorted(twice, key=str) == sorted(got, key=str)


def test_pipeline_runs_whole(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and out.count() > 0
