"""Language model, classifiers, token counts, top-k search and the pipeline."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import ball_tree, lm, quality, token_counts, toxicity
from quillspark.llm.common import doc_remainder

from .conftest import frame, prose

# language model


def test_lm_counts_and_scores(spark, rng, odd_rows):
    rows = [*odd_rows, *((100 + i, prose(rng, 5 + i % 50, 40) + (" zz9" * (i % 4))) for i in range(120))]
    df = frame(spark, rows)
    held = doc_remainder(F.col("doc_id"), 5) == 1
    got = lm.score_corpus(df, held).collect()
    tokens = [((i), [*(t or "").encode().lower().split(), None]) for i, t in rows]
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    c = Counter()
    for i, w in tokens:
        if not out(i):
            c.update(w)
    n, v = sum(c.values()), len(c)
    want = sorted((-1 if i is None else i, out(i), len(w), sum(x in c for x in w), round(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 4)) for i, w in tokens)
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], round(r["base_score"], 4)) for r in got) == want
    assert all(r["train_tokens"] == n and r["score"] < 0 for r in got)
    assert lm.score_corpus(frame(spark, []), held).count() == 0
    none = lm.score_corpus(df.where("doc_id IN (1, 2)"), F.lit(True)).collect()
    assert [(r["n_known"], r["train_tokens"]) for r in none] == [(0, 0), (0, 0)] and all(abs(r["score"] - r["base_score"]) < 1e-9 for r in none)


def net_of(n=40, classes=5):
    h = np.sort(np.random.default_rng(0).integers(0, 2**63, n).astype(np.uint64))
    counts = np.arange(n, 0, -1)
    ids = np.arange(n)
    per = -(-n // classes)
    w = lm.Words(h, np.log10(counts + 0.5), ids, np.append(np.arange(0, n, per), n), counts, int(counts.sum()) + 30, n + 9)
    return w, lm.fresh(w)


def test_lm_is_a_distribution_and_learns():
    w, net = net_of()
    rng = np.random.default_rng(1)
    prefix = rng.integers(0, 41, 6)
    total = 0.0
    alone = lm.log_likelihoods(net, w, prefix, np.array([0, 6]))[0]
    for x in range(41):
        ids = np.append(prefix, x)
        total += 10 ** (lm.log_likelihoods(net, w, ids, np.array([0, 7]))[0] - alone)
    assert abs(total - 1) < 1e-4
    docs = [np.tile([3, 8, 20], 60) if i % 2 else np.tile([5, 30], 90) for i in range(64)]
    ids, off = np.concatenate(docs), np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    before = lm.log_likelihoods(net, w, ids, off).sum()
    for _ in range(6):
        lm.train(net, w, ids, off, slots=16)
    after = lm.log_likelihoods(net, w, ids, off).sum()
    assert after > 0.3 * before
    slots = lm.log_likelihoods(net, w, ids, off, slots=3)
    assert np.allclose(slots, lm.log_likelihoods(net, w, ids, off, slots=64), atol=1e-3)  # state goes with the document


def test_lm_gradients():
    w, net = net_of(12, 3)
    ids, off = np.array([0, 4, 11, 12, 2, 7, 1, 3]), np.array([0, 5, 8])
    loss = lambda n: -lm.log_likelihoods(n, w, ids, off).sum() * math.log(10) / len(ids)
    steps = {}
    real = lm._step
    lm._step = lambda net, name, where, grad, rate: steps.setdefault(name, []).append((where, grad))
    try:
        copy = net.filled(net.flat())
        lm.train(copy, w, ids, off)
    finally:
        lm._step = real
    for name in ("gates", "class_out"):
        grad = steps[name][0][1]
        for at in ((0, 0), (1, 2)):
            a, b = net.filled(net.flat()), net.filled(net.flat())
            getattr(a, name)[at] += 1e-2
            getattr(b, name)[at] -= 1e-2
            assert abs((loss(a) - loss(b)) / 2e-2 - grad[at]) < 2e-3


def plain_log10(net, w, ids):
    """One document, a token at a time, in double precision."""
    n = net.gates.shape[0]
    h, total = np.zeros(n), 0.0
    words_in, gates, class_out, word_out = (getattr(net, x).astype(np.float64) for x in ("words_in", "gates", "class_out", "word_out"))
    for y in ids:
        logit = class_out @ h + net.class_bias
        c = next((k for k in range(len(w.bounds) - 1) if w.bounds[k] <= y < w.bounds[k + 1]), len(w.bounds) - 1)
        total += logit[c] - math.log(sum(math.exp(x) for x in logit))
        if c < len(w.bounds) - 1:
            own = range(w.bounds[c], w.bounds[c + 1])
            logits = {k: float(word_out[k] @ h + net.word_bias[k]) for k in own}
            total += logits[y] - math.log(sum(math.exp(x) for x in logits.values()))
        a = gates.T @ h
        z, r = (1 / (1 + np.exp(-(a[k * n : (k + 1) * n] + words_in[y][k * n : (k + 1) * n]))) for k in (0, 1))
        new = np.tanh(words_in[y][2 * n :] + r * a[2 * n :])
        h = new + z * (h - new)
    return total / math.log(10)


def test_lm_scores_token_by_token():
    w, net = net_of()
    rng = np.random.default_rng(4)
    docs = [rng.integers(0, 41, n) for n in (1, 3, 700, 64, 65, 2, 130)]
    ids, off = np.concatenate(docs), np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    lm.train(net, w, ids, off, slots=4)
    want = [plain_log10(net, w, d) for d in docs]
    for slots in (1, 3, 64):
        assert np.allclose(lm.log_likelihoods(net, w, ids, off, slots=slots), want, rtol=1e-4, atol=1e-3)


def test_lm_softmax_of_far_apart_rows():
    x = np.array([[900.0, 899.0], [-900.0, -901.0], [0.0, 0.0]], np.float32)
    assert np.allclose(lm._softmax(x)[:2, 0], 1 / (1 + math.exp(-1))) and np.allclose(lm._log_sum(x), [900 + math.log(1 + math.exp(-1)), -900 + math.log(1 + math.exp(-1)), math.log(2)])


def test_lm_finds_known_words(monkeypatch):
    monkeypatch.setattr(lm, "LOOK_BITS", 3)
    rng = np.random.default_rng(2)
    known = np.unique(np.append(rng.integers(0, 2**63, 50).astype(np.uint64) * np.uint64(2), np.array([0, 2**64 - 1], np.uint64)))
    w = lm.Words(known, np.zeros(len(known)), np.arange(len(known)), np.array([0, 1]), np.ones(1))
    asked = np.concatenate([known, known + np.uint64(1), rng.integers(0, 2**63, 50).astype(np.uint64)])
    at, is_known = w.look(asked)
    assert is_known.tolist() == [x in set(known.tolist()) for x in asked.tolist()] and (known[at[is_known]] == asked[is_known]).all()


def test_lm_classes_follow_the_counts():
    n = np.sort((10_000 / np.arange(1, 500)).astype(np.int64))[::-1]
    b = lm.class_bounds(n, 20)
    assert b[0] == 0 and b[-1] == len(n) and (np.diff(b) > 0).all() and b[1] < b[-1] - b[-2]
    assert lm.class_bounds(n[:3], 20).tolist() == [0, 1, 2, 3] and lm.class_bounds(n[:0], 20).tolist() == [0]


def test_lm_learns_from_every_training_document(spark, rng, monkeypatch):
    df = frame(spark, [(i, prose(rng, 12, 40)) for i in range(1400)])
    passes, real = [], lm._trained

    def spied(docs, sent, tasks):
        passes.append(sorted(r["doc_id"] for r in docs.select("doc_id").collect()))
        return real(docs, sent, tasks)

    monkeypatch.setattr(lm, "_trained", spied)
    lm.score_corpus(df, doc_remainder(F.col("doc_id"), 5) == 1)
    assert passes[-1] == [i for i in range(1400) if zlib.crc32(str(i).encode()) % 5 != 1]


# classifiers


def test_quality(spark, rng, odd_rows):
    good = lambda: prose(rng, rng.randrange(30, 120))
    junk = [lambda: " | ".join(prose(rng, 40).split()), lambda: prose(rng, 60).upper().replace(" ", "!! "), lambda: " ".join([prose(rng, 1)] * 80)]
    rows = [(i, rng.choice(junk)() if i % 4 == 0 else good()) for i in range(1, 601)]
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(1, 601)] + [(1, 1), (2, None), (None, 0)], "doc_id long, quality int")
    df = frame(spark, rows)
    model = quality.learn(df, labels, doc_remainder(F.col("doc_id"), 4) != 2)
    got = {r["doc_id"]: r for r in quality.score(df, model).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(got[i]["predicted"] == int(i % 4 != 0) for i in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got.values())
    kept = quality.keep_good(df, model)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["predicted"]}
    odd = quality.score(frame(spark, odd_rows), model)
    assert odd.count() == len(odd_rows) and odd.where("score IS NULL OR isnan(score)").count() == 0
    assert quality.learn(df, labels.limit(0)) is None
    assert quality.score(df, None).where("predicted = 1").count() == len(rows)
    assert quality.score(frame(spark, []), model).count() == 0


def plain_features(t):
    """The classifier's features by plain Python."""
    raw = (t or "").encode()
    if not raw:
        return [0.0] * len(quality.FEATURES)
    n = len(raw)
    share = [raw.count(bytes([c])) / n for c in range(256)]
    out = [math.log1p(n)] + [sum(share[c] for c in own) for own in quality._CLASSES.values()]
    out.append(-sum(x * math.log2(x) for x in share if x))
    w = raw.lower().split()
    out.append(math.log1p(len(w)))
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    lines = [x for x in raw.split(b"\n") if x.strip()]
    most = lambda x: max(Counter(x).values()) / len(x)
    out += [math.log(n / len(w)), len(set(w)) / len(w), most(w), sum(a == b for a, b in zip(w, w[1:])) / (len(w) - 1) if len(w) > 1 else 0] if w else [0.0] * 4
    out += [1 - len(set(tri)) / len(tri) if tri else 0.0, 1 - len(set(lines)) / len(lines) if lines else 0.0, most(tri) if tri else 0.0]
    return out


def test_quality_scores_are_sums_of_bins(spark, rng, odd_rows):
    from bisect import bisect_right

    rows = [(i, prose(rng, rng.randrange(1, 90)) if i % 3 else " | ".join(prose(rng, 30).split())) for i in range(1, 400)]
    df = frame(spark, rows)
    model = quality.learn(df, spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(1, 400)], "doc_id long, quality int"))
    assert len(model.pairs) == quality.PAIRS and sum(abs(t).max() > 0 for t in model.tables) > 3
    every = [*((1000 + k, t) for k, (_, t) in enumerate(odd_rows)), *rows]
    got = {r["doc_id"]: r["score"] for r in quality.score(frame(spark, every), model).collect()}
    for i, t in every:
        b = [bisect_right(e.tolist(), x) for e, x in zip(model.edges, plain_features(t))]
        z = model.base + sum(m[k] for m, k in zip(model.tables, b)) + sum(m[model.coarse[x][b[x]], model.coarse[y][b[y]]] for (x, y), m in zip(model.pairs, model.pair_tables))
        near = [abs(x - e).min() if len(e) else 1 for x, e in zip(plain_features(t), model.edges)]
        assert min(near) < 1e-9 or abs(got[i] - 1 / (1 + math.exp(-max(-30, min(30, z))))) < 1e-9
    assert [r["score"] for r in quality.score(frame(spark, rows).repartition(7), model).orderBy("doc_id").collect()] == [got[i] for i, _ in rows]
    again = quality.learn(df.repartition(5), spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(1, 400)], "doc_id long, quality int"))
    assert all(np.array_equal(a, b) for a, b in zip(model.tables, again.tables))


def test_gam_finds_interactions():
    rng = np.random.default_rng(3)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x[:3000], y[:3000])
    assert (1, 0) in model.pairs or (0, 1) in model.pairs
    assert ((model.scores(x[3000:]) > 0.5) == y[3000:]).mean() > 0.9


def test_toxicity(spark, rng, odd_rows):
    bad = ["grumpfel", "grumpfelig", "snarkolo", "vilezzo"]

    def text(i):
        w = prose(rng, rng.randrange(20, 200)).split()
        if i % 5 == 0:
            for _ in range(rng.randrange(1, 4)):
                w[rng.randrange(len(w))] = rng.choice(bad).capitalize()
        return " ".join(w)

    rows = [(i, text(i)) for i in range(1, 801)]
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(1, 801)], "doc_id long, toxic int")
    df = frame(spark, rows)
    model = toxicity.learn(df, labels, doc_remainder(F.col("doc_id"), 5) != 0)
    got = {r["doc_id"]: r for r in toxicity.score(df, model).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i]["predicted"] == int(i % 5 == 0) for i in held) >= 0.95 * len(held)
    kept = toxicity.keep_clean(df, model)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if not r["predicted"]}
    assert toxicity.score(frame(spark, odd_rows), model).where("score BETWEEN 0 AND 1").count() == len(odd_rows)
    late = [(1, prose(rng, 90_000) + " grumpfel snarkolo grumpfelig vilezzo")]  # far beyond one block
    assert toxicity.score(frame(spark, late), model).first()["score"] > toxicity.score(frame(spark, [(1, late[0][1].split(" grumpfel")[0])]), model).first()["score"]
    assert toxicity.learn(df, labels.limit(0)) is None and toxicity.score(df, None).where("predicted = 0").count() == len(rows)
    assert toxicity.score(frame(spark, []), model).count() == 0


def plain_cells(t):
    """Cells of a text's n-grams by plain Python integers."""
    t = f" {(t or '').lower()} "
    codes = [ord(" ") if ord(c) < 128 and not c.isalnum() else ord(c) for c in t]
    out = set()
    for i in range(len(codes)):
        h = 0
        for n, c in enumerate(codes[i : i + max(toxicity.ORDERS)], 1):
            h = (h + c) * int(toxicity._MULTIPLY[n - 1]) % 2**64
            h ^= h >> 29
            if n in toxicity.ORDERS:
                out.add(h * int(toxicity._LAST) % 2**64 >> 64 - toxicity.CELL_BITS)
    return out


def test_toxicity_by_plain_sums(spark, rng, odd_rows):
    rows = [(i, prose(rng, rng.randrange(4, 30)) + (" grumpfel" if i % 4 == 0 else "") + (" snarkolo" if i % 8 == 0 else "")) for i in range(1, 401)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(1, 401)], "doc_id long, toxic int")
    model = toxicity.learn(frame(spark, rows), labels)
    sets = [plain_cells(t) for _, t in rows]
    count = [Counter(), Counter()]
    for (i, _), s in zip(rows, sets):
        count[int(i % 4 == 0)].update(s)
    n = [300, 100]
    seen = set(count[0]) | set(count[1])
    limit, chosen = math.sqrt(2 * math.log(len(seen))), {}
    for c in seen:
        share = (count[0][c] + count[1][c]) / 400
        z = abs(count[1][c] / n[1] - count[0][c] / n[0]) / (math.sqrt(share * (1 - share) * (1 / n[0] + 1 / n[1])) + 1e-9)
        if z > limit:
            chosen[c] = (count[1][c] + 1, count[0][c] + 1)
    assert set(np.flatnonzero(model.wanted).tolist()) == set(chosen)
    p, q = (sum(x[k] for x in chosen.values()) for k in (0, 1))
    ratio = {c: math.log(a / p / (b / q)) for c, (a, b) in chosen.items()}
    z = [model.intercept + sum(model.weight[c] for c in s & set(chosen)) for s in sets]
    prob = [1 / (1 + math.exp(-x)) for x in z]
    loss = sum(math.log1p(math.exp(x)) - x * (i % 4 == 0) for x, (i, _) in zip(z, rows)) + toxicity.PENALTY / 2 * sum((model.weight[c] / r) ** 2 for c, r in ratio.items() if r)
    slope = [sum((pr - (i % 4 == 0)) * ratio[c] for pr, s, (i, _) in zip(prob, sets, rows) if c in s) + toxicity.PENALTY * model.weight[c] / ratio[c] for c in chosen if ratio[c]]
    assert max(map(abs, slope)) < 0.05 * loss  # near the least penalised loss
    every = [*rows, *((1000 + k, t) for k, (_, t) in enumerate(odd_rows) if len(t or "") < 1000)]
    got = {r["doc_id"]: r["score"] for r in toxicity.score(frame(spark, every), model).collect()}
    for i, t in every:
        want = model.intercept + sum(model.weight[c] for c in plain_cells(t) & set(chosen))
        assert abs(got[i] - 1 / (1 + math.exp(-want))) < 1e-9
    again = toxicity.learn(frame(spark, rows).repartition(5), labels)
    assert np.array_equal(model.wanted, again.wanted) and np.allclose(model.weight, again.weight, atol=1e-9)
    twice = toxicity.learn(frame(spark, [*rows, *rows, (4, "z" * 50)]), labels)  # a text for each doc_id
    assert np.array_equal(model.wanted, twice.wanted)


def test_ngrams_of_parts(monkeypatch):
    texts = ["Ab cd-EF", None, "", "hello hello", "x" * 50 + "yz"]
    whole = toxicity.cells(texts)
    monkeypatch.setattr(toxicity, "BLOCK_CHARS", 7)
    parts = toxicity.cells(texts)
    assert np.array_equal(whole[0], parts[0]) and np.array_equal(whole[1], parts[1])
    wanted = np.zeros(1 << toxicity.CELL_BITS, bool)
    wanted[whole[1][::3]] = True
    some = toxicity.cells(texts, wanted)
    keep = wanted[whole[1]]
    assert np.array_equal(some[0], whole[0][keep]) and np.array_equal(some[1], whole[1][keep])


# token counts


@pytest.mark.parametrize("block", [1, 3, 16, 1000])
def test_separator_scan(spark, rng, odd_rows, block):
    rows = [*odd_rows, *((200 + i, r[1]) for i, r in enumerate(odd_rows) if i < 3)] + [(100 + i, prose(rng, rng.randrange(0, 12))) for i in range(60)]
    encode = lambda t: [len(w) % 9 for w in t.split()]
    files = token_counts.token_files(frame(spark, rows).repartition(3), encode, 9, block_tokens=block)
    files = files.cache()
    got = token_counts.named(token_counts.scan(files, 9), files).collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"]) for r in got) == sorted((-1 if i is None else i, len((t or "").split())) for i, t in rows)
    flat = {}
    for r in files.where("tokens IS NOT NULL").orderBy("file_id", "block").collect():
        flat.setdefault(r["file_id"], []).extend(np.frombuffer(r["tokens"], "<u2").tolist())
    for r in got:
        part = flat[r["file_id"]][r["start"] : r["start"] + r["n_tokens"] + 1]
        assert part[-1] == 9 and 9 not in part[:-1]


def test_scan_of_unended_file(spark, monkeypatch):
    for run_blocks in (1, 2, 4096):
        monkeypatch.setattr(token_counts, "RUN_BLOCKS", run_blocks)
        check_unended(spark)
    rng = np.random.default_rng(6)
    flat = {f: rng.integers(0, 9, 200) for f in range(3)}
    rows = [(f, k, bytearray(x[k * 7 : k * 7 + 7].astype("<u2").tobytes())) for f, x in flat.items() for k in range(-(-len(x) // 7))]
    monkeypatch.setattr(token_counts, "RUN_BLOCKS", 3)
    got = sorted(tuple(r) for r in token_counts.scan(spark.createDataFrame(rows, "file_id long, block long, tokens binary"), 7).collect())
    want = []
    for f, x in flat.items():
        ends = [-1, *np.flatnonzero(x == 7).tolist()]
        want += [(f, k, a + 1, b - a - 1, True) for k, (a, b) in enumerate(zip(ends, ends[1:]))]
        if ends[-1] + 1 < len(x):
            want.append((f, len(ends) - 1, ends[-1] + 1, len(x) - ends[-1] - 1, False))
    assert got == want


def test_empty_token_files(spark):
    files = token_counts.token_files(frame(spark, []), lambda t: [1], 9)
    assert token_counts.named(token_counts.scan(files, 9), files).count() == 0


def test_token_counts_with_the_real_vocabulary(spark, odd_rows, rng):
    import base64
    import os

    if not os.path.exists(token_counts.VOCABULARY):
        pytest.skip("no vocabulary here")
    import tiktoken

    with open(token_counts.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain = tiktoken.Encoding("plain", pat_str=token_counts.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [*(r for r in odd_rows if r[0] != 11), *((100 + i, prose(rng, i)) for i in range(30))]
    files = token_counts.token_files(frame(spark, rows), token_counts.bpe_encoder(spark)).cache()
    got = token_counts.named(token_counts.scan(files), files).collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"]) for r in got) == sorted((-1 if i is None else i, len(plain.encode_ordinary(t or ""))) for i, t in rows)


def check_unended(spark):
    blocks = spark.createDataFrame([(5, 1, bytearray(np.array([7, 1, 2], "<u2").tobytes())), (5, 0, bytearray(np.array([1, 7, 7, 3], "<u2").tobytes())), (6, 0, bytearray(b""))], "file_id long, block long, tokens binary")
    got = sorted(tuple(r) for r in token_counts.scan(blocks, 7).collect())
    assert got == [(5, 0, 0, 1, True), (5, 1, 2, 0, True), (5, 2, 3, 1, True), (5, 3, 5, 2, False)]
    assert token_counts.scan(blocks.limit(0), 7).count() == 0


def test_long_texts_encode_alike(spark, monkeypatch):
    try:
        encode = token_counts.bpe_encoder(spark)
    except FileNotFoundError:
        pytest.skip("no vocabulary here")
    text = "some words, and  more\n\nof them <|endoftext|> " * 40
    whole = encode(text)
    monkeypatch.setattr(token_counts, "LONG_TEXT", 50)
    assert encode(text) == whole and token_counts.END_ID not in whole


# top-k


def plain_top(vectors, k):
    out = []
    for n, (q, e) in enumerate(vectors):
        if q % 20:
            continue
        s = sorted((-int(np.dot(e, v)), i) for i, v in vectors if i != q and len(v) == len(e))[:k]
        out += [(q, r + 1, i, -x) for r, (x, i) in enumerate(s)]
    return sorted(out)


@pytest.mark.parametrize("shard", [7, 64, 10_000])
def test_top_k_is_exact(spark, shard):
    rng = np.random.default_rng(5)
    e = rng.normal(size=(300, 6))
    e[50:120] = e[50]  # many alike: ties
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(e)] + [(400, None), (420, [None] * 6), (440, [float("nan")] * 6), (460, [float("inf")] * 6), (480, [])]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, block int")
    v = ball_tree.integer_vectors(df)
    whole = [(i, np.floor(64 * np.array(x)).astype(int)) for i, x in rows[:300]]
    got = ball_tree.top_k(v, F.col("vec_id") % 20 == 0, 20, shard_rows=shard, query_rows=5)
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got.collect()) == plain_top(whole, 20)


def test_top_k_odd_cases(spark):
    big = 2.0**52
    df = spark.createDataFrame([(0, [big, -big]), (1, [big, 1.0]), (2, [1.0, 1.0]), (20, [3.0])], "vec_id long, embedding array<double>")
    got = ball_tree.top_k(ball_tree.integer_vectors(df, 0.5), F.col("vec_id") % 20 == 0, 5).collect()
    assert [(r["query_id"], r["vec_id"]) for r in sorted(got, key=lambda r: (r["query_id"], r["rank"]))] == [(0, 1), (0, 2)]
    assert [r["score"] for r in sorted(got, key=lambda r: r["rank"])][0] == 2**63 - 1
    assert ball_tree.top_k(ball_tree.integer_vectors(df.limit(0)), F.col("vec_id") % 20 == 0, 5).count() == 0


def test_top_k_leaves_shards_out(spark):
    rng = np.random.default_rng(12)
    base = rng.normal(size=(40, 16))
    e = np.concatenate([10 * b + 0.2 * rng.normal(size=(50, 16)) for b in base])
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(e)], "vec_id long, embedding array<double>")
    met = []
    got = ball_tree.top_k(ball_tree.integer_vectors(df), F.col("vec_id") % 20 == 0, 20, shard_rows=50, query_rows=20, met=met)
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got.collect()) == plain_top([(i, np.floor(64 * v).astype(int)) for i, v in enumerate(e)], 20)
    assert met[2] < 0.35 * met[0] * met[1]


def test_top_k_broadcasts_no_vectors(spark, monkeypatch):
    tables, write = {}, ball_tree.written
    monkeypatch.setattr(ball_tree, "written", lambda df, label: tables.setdefault(label, write(df, label)))
    rng = np.random.default_rng(8)
    vectors = [(i, [int(x) for x in rng.integers(-40, 40, 4)]) for i in range(400)]
    got = ball_tree.top_k(spark.createDataFrame(vectors, "vec_id long, v array<long>"), F.col("vec_id") % 20 == 0, 20, shard_rows=20, query_rows=5)
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    for name in ("topk-near", "topk-rest"):  # a pair of block and shard costs some bytes, whatever the block holds
        assert "binary" not in dict(tables[name].dtypes).values() and tables[name].count()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got.collect()) == plain_top(vectors, 20)


# pipeline


def rows_of_stages(spark, d, rows, items, labels):
    import corpus_pipeline as cp

    frame(spark, rows).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return cp.run(spark, d)


def test_pipeline_of_empty_tables(spark, rng, tmp_path):
    text = prose(rng, 30)
    rows = [(1, text), (2, text), (3, prose(rng, 30)), (3, prose(rng, 30)), (None, None)]
    got = rows_of_stages(spark, str(tmp_path / "a"), rows, [], [])  # nothing is learnt or looked for: only the copy goes
    assert sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in got.collect()) == [-1, 1, 3, 3]
    got = rows_of_stages(spark, str(tmp_path / "b"), rows, [(1, text)], [])
    assert sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in got.collect()) == [-1, 3, 3]
    got = rows_of_stages(spark, str(tmp_path / "c"), [], [(1, text)], [(1, 1, 0)])
    assert got.count() == 0


def test_pipeline_stages(spark, rng, odd_rows, tmp_path):
    import corpus_pipeline as cp

    base = prose(rng, 80)
    leak = prose(rng, 30)
    rows = [*odd_rows, *((100 + i, prose(rng, 60)) for i in range(300)), (600, base), (601, base), (602, base + " more"), (700, prose(rng, 20) + " " + leak)]
    rows += [(800 + i, " | ".join(prose(rng, 40).split())) for i in range(80)] + [(900 + i, prose(rng, 40) + " grumpfel snarkolo") for i in range(80)]
    d = str(tmp_path)
    frame(spark, rows).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    labels = [(100 + i, 1, 0) for i in range(250)] + [(800 + i, 0, 0) for i in range(60)] + [(900 + i, 1, 1) for i in range(60)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in cp.STAGES] == ["quality_classifier", "toxicity", "ngram_jaccard_join", "benchmark_decontamination", "packing"]
    for name, stage in cp.STAGES:
        docs = cp.written(stage(spark, docs, d), name)
        if name != "packing":
            assert docs.columns == columns
    left = {r["doc_id"] for r in docs.collect()}
    assert {100 + i for i in range(300)} <= left and 600 in left
    assert not left & ({601, 602, 700} | {800 + i for i in range(80)} | {900 + i for i in range(80)})
