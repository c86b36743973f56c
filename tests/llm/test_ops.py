"""Each corpus operator against brute force, a round trip or held-out accuracy, over nulls, repeats, empty and odd rows."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from lexarium.llm import byte_bpe, decontamination, embedding_dedup, language_id, lm_score, ngram_join, substring_dedup, token_counts, toxicity, warc
from lexarium.llm._bytes import grams, split_words

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, anchor int, wins string, c0 int, k int, own_d int"
VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def base_rows():
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice(["ka", "lo", "mi", "té", "su"]) for _ in range(rnd.randint(1, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared, long_ = text(60), text(400)
    near = long_.split()
    near[200] = "changed"
    return [long_, " ".join(near), long_, None, "", "   \n\t", "one", "one", "One two three", shared + " " + text(80), text(70) + "\n" + shared, text(3), "a b it's 12 𝔘 ½", text(30) + "!", shared]


def frame(spark, texts=None):
    texts = base_rows() if texts is None else texts
    rows = [(i, t, "x", "s", len(t or ""), 1, "w", 2, 3, 4) for i, t in enumerate(texts)]
    if texts:
        rows.append(rows[0])  # a repeated row
    return spark.createDataFrame(rows, SCHEMA)


def words(t, lower=False):
    raw = (t or "").encode()
    return re.findall(rb"[^\x20\x09-\x0D]+", raw.translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))) if lower else raw)


def test_bpe_is_tiktoken(spark):
    bpe = byte_bpe.load(VOCABULARY, public_tokenizers.PATTERN)
    ref = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    for t in [*filter(None, base_rows()), "a" * 5000, "ab" * 3000, " \n\n  x'll 'sam", "\x1c\x85 1½"]:
        assert bpe.encode(t).tolist() == ref.encode_ordinary(t)
    got = byte_bpe.encode(frame(spark), VOCABULARY, public_tokenizers.PATTERN, with_ids=True)
    for r, (i, t) in zip(sorted(got.collect(), key=lambda r: r["doc_id"])[1:], enumerate(base_rows()), strict=True):
        ids = ref.encode_ordinary(t or "")
        assert (r["doc_id"], r["n_tokens"], r["ids"]) == (i, len(ids), ids) and bytes(r["decoded"]) == (t or "").encode()
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert byte_bpe.encode(frame(spark, []), VOCABULARY, public_tokenizers.PATTERN).count() == 0
    assert byte_bpe.decode(got, VOCABULARY, public_tokenizers.PATTERN).where("doc_id = 6").first()["decoded"] == b"one"


def test_rank_bitmap():
    b = byte_bpe.RankBitmap(300_000)
    for r in (5, 299_999, 64, 4096, 5, 0):
        b.add(r)
    assert [b.pop() for _ in range(6)] == [0, 5, 64, 4096, 299_999, -1]


def test_token_counts_are_greedy(spark):
    import base64

    vocabulary = {base64.b64decode(x.split()[0]) for x in open(VOCABULARY, "rb")}
    longest = max(map(len, vocabulary))

    def pieces(w):
        w, i, n = b" " + w, 0, 0
        while i < len(w):
            i = next(j for j in range(min(len(w), i + longest), i, -1) if w[i:j] in vocabulary)
            n += 1
        return n

    got = {r["doc_id"]: (r["n_words"], r["n_tokens"]) for r in token_counts.count_tokens(frame(spark), VOCABULARY).collect()}
    for i, t in enumerate(base_rows()):
        assert got[i] == (len(words(t)), sum(map(pieces, words(t))))


def brute_components(texts):
    sets = [frozenset(zip(*[w[k:] for k in range(5)])) if len(w) >= 5 else frozenset([tuple(w)] if w else []) for w in (words(t, True) for t in texts)]
    label = list(range(len(sets)))
    for _ in sets:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if i != j and a and b and 100 * len(a & b) >= 80 * len(a | b):
                    label[i] = label[j] = min(label[i], label[j])
    return sets, label


def test_jaccard_components(spark):
    texts = base_rows()
    sets, label = brute_components(texts)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join_components(frame(spark)).collect()}
    assert got == {i: (len(s), label[i]) for i, s in enumerate(sets)}
    kept = ngram_join.deduplicate(frame(spark, texts[:9])).columns
    assert kept == frame(spark).columns


@pytest.mark.parametrize("bits", [3, 64])
def test_jaccard_dense_group(spark, monkeypatch, bits):
    """Edited copies of one passage, many of them just under or over the threshold, searched in small blocks; with 3 bits, digests stand for several sets."""
    monkeypatch.setattr(ngram_join, "BLOCK_TOKENS", 700)
    rnd = random.Random(8)
    passage, texts = [f"w{k}" for k in range(80)], []
    for i in range(60):
        own = list(passage)
        for _ in range(rnd.randint(1, 3)):
            own[rnd.randrange(80)] = f"x{i}"
        texts.append(" ".join(own[rnd.randint(0, 8) :]))
    sets, label = brute_components(texts)
    assert 5 < len(set(label)) < 55
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.join_components(frame(spark, texts), digest_bits=bits).collect()}
    assert got == dict(enumerate(label))


def test_trie_walk_over_suffixes():
    rnd = np.random.default_rng(5)
    sets = [np.unique(rnd.integers(0, 30, rnd.integers(8, 40))).astype(np.uint64) for _ in range(120)]
    sizes = [len(s) + 2 for s in sets]
    q, r = ngram_join.Trie(sets[:70], sizes[:70]).search_all(sets[40:], sizes[40:], 60)
    both = lambda a, b: len(np.intersect1d(sets[a], sets[b]))
    want = {(a, b) for a in range(40, 120) for b in range(70) if 100 * both(a, b) >= 60 * (sizes[a] + sizes[b] - both(a, b))}
    assert {(a + 40, b) for a, b in zip(q.tolist(), r.tolist(), strict=True)} == want and len(want) > 40


def test_trie_finds_all():
    rnd = np.random.default_rng(2)
    sets = [np.unique(rnd.integers(0, 40, rnd.integers(1, 40))).astype(np.uint64) for _ in range(150)]
    trie = ngram_join.Trie(sets)
    for q in sets[:40]:
        want = {i for i, s in enumerate(sets) if 100 * len(np.intersect1d(q, s)) >= 80 * len(np.union1d(q, s))}
        assert set(trie.search(q)) == want


def test_substrings(spark):
    texts = base_rows()
    first, want = {}, {}
    for i, t in enumerate(texts):
        w = words(t)
        for p in range(len(w) - 12):
            first.setdefault(tuple(w[p : p + 13]), i)
    for i, t in enumerate(texts):
        w = words(t)
        gone = {p + k for p in range(len(w) - 12) if first[tuple(w[p : p + 13])] < i for k in range(13)}
        want[i] = (len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest())
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.report(frame(spark)).collect()}
    assert got == want and any(v[1] for v in want.values())
    out = substring_dedup.deduplicate(frame(spark))
    assert out.columns == frame(spark).columns and {r["doc_id"] for r in out.collect()} >= {0, 3, 4, 9, 10}


def test_substrings_by_seed_and_extension(spark, monkeypatch):
    """Passages cut, joined and overlapping at random; string ids; seeds dealt over tasks; maximal repeats; rows with equal ids."""
    monkeypatch.setattr(substring_dedup, "DEALT", 3)
    rnd = random.Random(11)
    pool = [[f"{rnd.choice('abcdefg')}{rnd.randint(0, 4)}" for _ in range(40)] for _ in range(6)]
    texts = []
    for i in range(60):
        part = lambda: (w := rnd.choice(pool))[(a := rnd.randint(0, 25)) : a + rnd.randint(5, 30)]
        texts.append(" ".join(x for _ in range(4) for x in [*part(), *[f"own{i}"] * rnd.randint(0, 2)]))
    texts += ["own" + " p q" * 30, "z" + " p q" * 25 + " own", "p q r " * 12, "r p q " * 14]
    first = {}
    for i, t in enumerate(texts):
        for p in range(len(t.split()) - 12):
            first.setdefault(tuple(t.split()[p : p + 13]), i)
    want = {}
    for i, t in enumerate(texts):
        starts = [p for p in range(len(t.split()) - 12) if first[tuple(t.split()[p : p + 13])] < i]
        runs = [p for p in starts if p - 1 not in starts]
        want[f"d{i:03}"] = (sorted((p, next(q for q in range(p, 10**6) if q + 1 not in starts) - p + 13) for p in runs), len({p + k for p in starts for k in range(13)}))
    df = spark.createDataFrame([(f"d{i:03}", t) for i, t in enumerate(texts)] + [("d001", "other words with this id")], "doc_id string, text string")
    got = {k: [] for k in want}
    for r in substring_dedup.repeats(df).collect():
        got[r["doc_id"]].append((r["start"], r["n_words"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: v[0] for k, v in want.items()} and sum(len(v[0]) for v in want.values()) > 40
    report = [(r["doc_id"], r["n_removed"]) for r in substring_dedup.report(df).collect() if r["n_words"] != 5]
    assert dict(report) == {k: v[1] for k, v in want.items()}
    assert substring_dedup.report(df.limit(0)).count() == 0


def test_anchors_of_short_texts():
    rnd = random.Random(2)
    for n in range(60):
        raw = np.frombuffer(" ".join(rnd.choice("abc") for _ in range(n)).encode(), np.uint8)
        w = split_words(raw, np.array([0, len(raw)]))
        g = grams(w.hashes(), 5).tolist()
        chosen = [min(range(s, s + 9), key=lambda p: (g[p], p)) for s in range(n - 12)]
        p, doc, h, left, right = (x.tolist() for x in substring_dedup.anchors_of(w, 13, 5))
        assert p == sorted(set(chosen)) and h == [g[x] for x in p] and not any(doc)
        assert [list(range(x - a, x + b - 7)) for x, a, b in zip(p, left, right, strict=True)] == [[s for s, c in enumerate(chosen) if c == x] for x in p]


def test_substrings_in_stretches(spark, monkeypatch):
    """A copied passage leaves as few rows, not one for each of its seeds; short stretches, windows compared over all tasks and several rows of the leading id change nothing."""
    rnd = random.Random(5)
    text = lambda n: [f"{rnd.choice('abcdefgh')}{rnd.randint(0, 40)}" for _ in range(n)]
    long_, same = text(2000), text(5)
    texts = [(0, long_), (1, long_), (2, text(9) + long_[300:900] + text(9))]
    parts = [[*text(20)[:k], *same, *text(20)] for k in (8, 6, 8, 7)]
    texts += [(3, text(30) + same + text(30)), (4, parts[0] + text(3) + parts[1]), (5, parts[1] + parts[0]), (6, parts[2]), (6, parts[3]), (7, parts[3] + parts[2]), (8, parts[0] + parts[3])]
    texts += [(i, (rnd.choice(parts)[: rnd.randint(15, 30)] + rnd.choice(parts)) * 2) for i in range(9, 30)]
    first = {}
    for i, w in texts:
        for p in range(len(w) - 12):
            first.setdefault(tuple(w[p : p + 13]), i)
    want = sorted((i, len({p + k for p in range(len(w) - 12) if first[tuple(w[p : p + 13])] < i for k in range(13)})) for i, w in texts)
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in texts], "doc_id bigint, text string")
    written, cut = {}, substring_dedup.Cuts.cut
    monkeypatch.setattr(substring_dedup.Cuts, "cut", lambda self, d, name: (out := cut(self, d, name), written.update({name: out.count()}))[0])
    substring_dedup.report(df.where("doc_id < 3")).collect()
    assert written["found"] < 60
    monkeypatch.setattr(substring_dedup.Cuts, "cut", cut)
    for dealt, chain, held in ((256, 64, 10**6), (2, 2, 10**6), (256, 3, 4)):
        for name, value in (("DEALT", dealt), ("CHAIN", chain), ("HELD", held)):
            monkeypatch.setattr(substring_dedup, name, value, raising=False)
        assert sorted((r["doc_id"], r["n_removed"]) for r in substring_dedup.report(df).collect()) == want


def test_substrings_of_periodic_texts(spark, monkeypatch):
    """A passage of two words repeated leaves a row for each stretch of a text and one for each of its two windows, not one for each place."""
    rnd = random.Random(8)
    texts = [[*[f"own{i}x{k}" for k in range(rnd.randint(1, 5))], *["p", "q"] * rnd.randint(90, 110), f"end{i}"] for i in range(40)]
    first = {}
    for i, w in enumerate(texts):
        for p in range(len(w) - 12):
            first.setdefault(tuple(w[p : p + 13]), i)
    want = [(i, len({p + k for p in range(len(w) - 12) if first[tuple(w[p : p + 13])] < i for k in range(13)})) for i, w in enumerate(texts)]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id bigint, text string")
    written, cut = {}, substring_dedup.Cuts.cut
    monkeypatch.setattr(substring_dedup.Cuts, "cut", lambda self, d, name: (out := cut(self, d, name), written.update({name: out.count()}))[0])
    for dealt, held in ((256, 10**6), (10**6, 10**6), (256, 50)):
        monkeypatch.setattr(substring_dedup, "DEALT", dealt)
        monkeypatch.setattr(substring_dedup, "HELD", held)
        assert sorted((r["doc_id"], r["n_removed"]) for r in substring_dedup.report(df).collect()) == want
        assert held < 10**6 or written["found"] < 600  # 40 texts of two stretches, and of some 200 places each


def test_decontamination(spark):
    texts = base_rows()
    bench = spark.createDataFrame([(1, " ".join(texts[9].split()[3:14])), (2, " ".join(texts[9].split()[20:31])), (3, "One, TWO three"), (4, None), (None, "x y"), (5, "..")], "item_id bigint, text string")
    got = {r["doc_id"]: (r["n_hit"], r["n_items"], r["contaminated"]) for r in decontamination.report(frame(spark), bench).collect()}
    assert got[9][1:] == (2, True) and got[10][1:] == (2, True) and got[8] == (3, 1, False) and got[3] == (0, 0, False) and got[0] == (0, 0, False)
    kept = decontamination.decontaminate(frame(spark), bench)
    assert kept.columns == frame(spark).columns and {r["doc_id"] for r in kept.collect()} == {i for i, v in got.items() if not v[2]}
    cut = {r["doc_id"]: r["text"] for r in decontamination.decontaminate(frame(spark), bench, remove="spans").collect()}
    assert cut[0] == texts[0] and len(cut[9].split()) == len(texts[9].split()) - got[9][0]
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontamination.report(frame(spark), none).where("contaminated").count() == 0


def test_embeddings(spark):
    rnd = np.random.default_rng(5)
    base = rnd.normal(size=(60, 8))
    vectors = np.concatenate((base, base[:20] + 0.01 * rnd.normal(size=(20, 8)), base[:3], 2 * base[3:5]))
    rows = [(i, [float(np.float32(x)) for x in v], i % 2) for i, v in enumerate(vectors)]
    rows += [(900, None, 1), (901, [0.0] * 8, 1), (902, [float("nan")] * 8, 1), (903, [None] + [1.0] * 7, 0), (904, rows[0][1], None), (905, [], 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    unit = vectors.astype(np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    link = unit @ unit.T >= 0.98
    own = np.arange(len(unit))
    link &= (own[:, None] % 2 == own[None, :] % 2) & (own[:, None] != own[None, :])
    label = own.copy()
    for _ in own:
        label = np.minimum(label, np.where(link, label[None, :], 999).min(axis=1))
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_duplicates(df).collect()}
    assert all(got[i] == (link[i].sum(), label[i], label[i] == i) for i in own.tolist())
    assert all(got[i] == (0, i, True) for i in range(900, 906))


def test_graph_recall():
    rnd = np.random.default_rng(1)
    centre = rnd.normal(size=(300, 16))
    x = np.concatenate([c + 0.08 * rnd.normal(size=(rnd.integers(1, 12), 16)) for c in centre])
    g = embedding_dedup.Graph(x)
    found, truth = g.audited(x, 0.98), g.brute(x, 0.98)
    hits = sum(len(np.intersect1d(a, b)) for a, b in zip(found, truth, strict=True))
    assert hits >= 0.99 * sum(map(len, truth)) and hits == sum(map(len, found))


def test_language(spark):
    rnd = random.Random(4)
    say = {"aa": ["the", "with", "thing", "and"], "bb": ["schön", "über", "nicht", "und"]}
    rows = [(i, " ".join(rnd.choice(say[k]) for _ in range(rnd.randint(5, 200))), k) for i in range(300) for k in [("aa", "bb")[i % 2]]]
    rows += [(900, None, "aa"), (901, "123 ...", None), (902, "", "bb")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    net = language_id.train(df.where("doc_id < 200"))
    got = {r["doc_id"]: r for r in language_id.identify(df, net, held_out=F.col("doc_id") >= 200).collect()}
    assert sum(got[i]["lang_pred"] == k for i, _, k in rows[200:300]) >= 98
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (900, 901, 902))
    assert language_id.train(df.where("doc_id < 0")) is None


def test_pair_tables_are_the_convolution():
    rnd = np.random.default_rng(3)
    net = language_id.ByteConvNet(["a", "b"])
    x = rnd.integers(0, language_id.CLASSES, (5, language_id.WINDOW)).astype(np.uint8)
    got, e = net.pooled(x), net.p["embed"][x]
    want = np.concatenate([np.stack([np.maximum(np.max([np.einsum("we,wef->f", e[i, p : p + w], net.p[f"conv{w}"]) for p in range(language_id.WINDOW - w + 1)], axis=0) + net.p[f"bias{w}"], 0) for i in range(5)]) for w in language_id.WIDTHS], axis=1)
    assert got == pytest.approx(want, abs=1e-4)


def test_incomplete_vocabulary_is_an_error():
    with pytest.raises(ValueError):
        token_counts.PieceCounter([b"a"])


def test_toxicity_learns_from_long_texts(spark):
    """Long texts are learnt from in stretches from their beginning to their end, and only toxic words near the end still show."""
    text = "".join(chr(97 + k % 26) for k in range(1000))
    row = spark.createDataFrame([(text,)], "t string").select(toxicity.stretches(F.col("t"), 80).alias("long"), toxicity.stretches(F.col("t"), 1000).alias("short")).first()
    parts = row["long"].split("\n")
    assert row["short"] == text and len(parts) == 8 and all(len(p) == 10 and p in text for p in parts) and text.startswith(parts[0]) and text.endswith(parts[-1])
    filler = " ".join(f"word{k % 97}" for k in range(2000))
    docs = [(k, filler + (" grobian lout" * 300 if k % 4 == 0 else "")) for k in range(80)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(80)], "doc_id bigint, toxic int")
    crf = toxicity.train(df, labels, max_chars=4000)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(df, crf).collect()}
    assert all((v >= 0.3) == (k % 4 == 0) for k, v in got.items())


def test_toxicity(spark):
    rnd = random.Random(6)
    clean = ["alpha", "bravo", "delta", "golf", "hotel", "india", "über"]
    rows, labels = [], []
    for i in range(400):
        w = [rnd.choice(clean) for _ in range(rnd.randint(3, 80))]
        if i % 3 == 0:
            for _ in range(2):
                w[rnd.randrange(len(w))] = "vile" + rnd.choice(["ka", "lo", "mi", "su"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 3 == 0)))
    rows += [(900, None), (901, ""), (902, "alpha VILEka bravo")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    crf = toxicity.train(df, spark.createDataFrame(labels[:250], "doc_id bigint, toxic int"))
    got = {r["doc_id"]: r for r in toxicity.score(df, crf, spans=True).collect()}
    assert all((got[i]["score"] >= 0.3) == bool(y) for i, y in labels[250:])
    assert got[900]["score"] < 0.3 and got[901]["score"] < 0.3 and got[902]["spans"][0]["end"] == 12


def test_toxicity_learns_in_a_task(spark, monkeypatch):
    """The driver holds neither the sample nor its features, and rows in another order give the same field."""

    def fit(*_):
        raise AssertionError("fitted on the driver")

    monkeypatch.setattr(toxicity.ToxicCRF, "fit", fit)
    rows = [(k, f"{'vile ' if k % 4 == 0 else ''}word{k % 7} of text{k % 5}") for k in range(200)]
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(200)], "doc_id bigint, toxic int")
    fields = [toxicity.train(spark.createDataFrame(r, "doc_id bigint, text string"), labels) for r in (rows, rows[::-1])]
    assert fields[0].weight.any() and np.array_equal(fields[0].weight, fields[1].weight) and np.array_equal(fields[0].curve, fields[1].curve)
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert toxicity.train(none, labels).curve.tolist() == [-30, 0, 0]


def test_chain_marginals():
    rnd = np.random.default_rng(0)
    first, T, B = np.array([0, 4, 4, 9]), rnd.normal(size=(2, 2)), rnd.normal(size=2)
    e = rnd.normal(size=9)
    got = toxicity.chain_marginals(e, first, T, B, lanes=3)
    for a, b in ((0, 4), (4, 9)):
        weights, on = 0.0, np.zeros(b - a)
        for code in range(2 ** (b - a)):
            y = [(code >> k) & 1 for k in range(b - a)]
            s = np.exp(B[y[0]] + sum(e[a + k] * y[k] for k in range(b - a)) + sum(T[y[k - 1], y[k]] for k in range(1, b - a)))
            weights += s
            on += s * np.array(y)
        assert got[a:b] == pytest.approx(on / weights)


def test_language_model(spark):
    import math
    from collections import Counter

    rnd = random.Random(8)
    rows = [(i, " ".join(f"{'xy'[i % 2]}{rnd.randint(0, 9)}" for _ in range(rnd.randint(1, 60)))) for i in range(200)] + [(300, None), (301, ""), (302, "Unseen X1")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    train = F.col("doc_id") < 150
    got = {r["doc_id"]: r for r in lm_score.score(df, train).collect()}
    n = Counter(x for i, t in rows[:150] for x in [*words(t, True), b""])
    N, V = sum(n.values()), len(n)
    for i, t in rows:
        w = [*words(t, True), b""]
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (len(w), sum(n[x] > 0 for x in w), N)
        assert got[i]["base_score"] == pytest.approx(sum(math.log10((n[x] + 1) / (N + V + 1)) for x in w))
    held = range(150, 200)
    assert sum(got[i]["score"] for i in held) > sum(got[i]["base_score"] for i in held)


def test_language_model_learns_from_long_texts(spark):
    rnd = random.Random(4)
    rows = [(i, " ".join(x for _ in range(3000) for x in rnd.choice([("aa", "bb"), ("cc", "dd")]))) for i in range(4)] + [(10, "aa bb cc dd"), (11, "bb aa dd cc")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r["score"] for r in lm_score.score(df, F.col("doc_id") < 4).collect()}
    assert got[10] > got[11] + 2  # random context weights score both orders about alike


def test_every_token_is_learnt_from(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "CHUNK", 500)
    rnd = np.random.default_rng(2)
    docs = [np.append(rnd.integers(1, 5, rnd.integers(1, 400)), 0).astype(np.uint16) for _ in range(60)]
    encoded = spark.createDataFrame([(i * 7919, d.tobytes()) for i, d in enumerate(docs)], "draw bigint, outcomes binary")
    n = sum(map(len, docs))
    states = []
    for rows in (encoded, encoded.repartition(7)):
        model = lm_score.LogBilinear(np.bincount(np.concatenate(docs)).astype(float))
        assert lm_score.train(model, rows, n) == n
        states.append(model.state())
    assert np.array_equal(*states)


def test_outcomes_sum_to_one():
    model = lm_score.LogBilinear(np.arange(1.0, 40.0))
    p = np.exp(model.log_probability(np.arange(39), np.full(39, 3), np.full(39, 39)))
    assert p.sum() == pytest.approx(1, abs=1e-5)


def test_warc(spark):
    pages = spark.createDataFrame([(1, "http://a/", "<html><head><title>T\nt</title></head><body><p>A &amp; B<br>c</p><script>x</script><a href='u'>l</a></body></html>"), (2, None, None)], "page_id bigint, url string, html string")
    source = warc.responses(pages)
    out = {(r["page_id"], r["record_type"]): r for r in warc.serialise(warc.derive(source)).collect()}
    text, meta, src = out[1, "conversion"], out[1, "metadata"], source.where("page_id = 1").first()
    assert text["block"] == "A & B\nc\nl" and out[2, "conversion"]["block"] == ""
    assert text["refers_to"] == meta["refers_to"] == src["record_id"] and text["linked_id"] == meta["record_id"] and meta["linked_id"] == text["record_id"]
    assert "title: T t" in meta["block"] and "outlink: u\r\n" in meta["block"] and meta["source_digest"] == "sha256:" + hashlib.sha256(src["payload"].encode()).hexdigest()
    back = warc.parse(bytes(text["warc"]) + bytes(meta["warc"]))
    assert [r["block"].decode() for r in back] == [text["block"], meta["block"]] and back[0]["headers"]["warc-refers-to"] == f"<{src['record_id']}>"
