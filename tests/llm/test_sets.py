"""N-gram join, components, decontamination, chat formatting, resharding and packing against plain versions."""

import glob
import hashlib

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import chat_format, components, decontaminate, ngram_join, packing, resharding, words
from quillspark.llm.common import shared_dir, utf8
from quillspark.llm.queries import QUERIES

from .conftest import frame, prose


def plain_sets(rows, k):
    out = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        out.append((i, {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()))
    return out


def plain_classes(rows, k, num, den):
    sets = plain_sets(rows, k)
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if a and b and den * len(a & b) >= num * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d if d is not None else -1, len(s), -1 if (x := (least.get(find(i)) if s else d)) is None else x) for i, (d, s) in enumerate(sets))


def classes_of(df):
    return sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_shingles"], -1 if r["component_id"] is None else r["component_id"]) for r in df.collect())


def test_word_hashes_tell_words_apart(rng):
    import pyarrow as pa

    texts = [prose(rng, rng.randrange(0, 300)) for _ in range(50)] + ["", " a\x0bB\x1cC ", None, "W" * 5000]
    raw, at = utf8(pa.array(texts))
    seen, back, n = {}, {}, 0
    for first, offsets, h in words.word_hashes(raw, at, piece=700):
        for i in range(len(offsets) - 1):
            own = (texts[first + i] or "").encode().lower().split()
            got = h[offsets[i] : offsets[i + 1]].tolist()
            assert len(own) == len(got)
            for w, x in zip(own, got, strict=True):
                assert seen.setdefault(w, x) == x and back.setdefault(x, w) == w
            n += 1
    assert n == len(texts)


@pytest.mark.parametrize(("k", "num"), [(4, 85), (5, 80)])
def test_ngram_join_is_exact(spark, rng, k, num):
    rows = []
    passage = prose(rng, 30)
    for g in range(12):
        base = prose(rng, rng.randrange(20, 160)).split()
        for _ in range(rng.randrange(1, 9)):
            w = list(base)
            for _ in range(rng.randrange(0, 5)):
                w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(w).upper() if rng.random() < 0.3 else " ".join(w)))
    rows += [(1000 + i, f"{passage} {prose(rng, 12)}") for i in range(40)] + [(2000 + i, rows[0][1]) for i in range(30)]
    got = ngram_join.jaccard_classes(frame(spark, rows), k, num, 100)
    assert classes_of(got) == plain_classes(rows, k, num, 100)


def test_ngram_join_odd_rows(spark, odd_rows):
    assert classes_of(ngram_join.jaccard_classes(frame(spark, odd_rows), 4, 85, 100)) == plain_classes(odd_rows, 4, 85, 100)


def test_ngram_join_splits_large_tiles(spark, rng, monkeypatch):
    monkeypatch.setattr(ngram_join, "TILE_ROWS", 4)
    base = prose(rng, 60).split()
    rows = [(i, " ".join(base[: 30 + i % 3 * 2] + [f"z{i}"] * (i % 4) + base[30:])) for i in range(30)]
    assert classes_of(ngram_join.jaccard_classes(frame(spark, rows), 4, 85, 100)) == plain_classes(rows, 4, 85, 100)


def test_ngram_join_empty(spark):
    assert ngram_join.jaccard_classes(frame(spark, [])).count() == 0
    assert ngram_join.keep_one(frame(spark, [])).count() == 0


def test_keep_one(spark, odd_rows):
    df = frame(spark, odd_rows)
    kept = ngram_join.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in kept.collect()) == [-1, 1, 2, 3, 4, 5, 6, 8, 10, 11, 12]


def test_keep_one_tells_rows_of_one_id_apart(spark, rng):
    a, b, c = (prose(rng, 40) for _ in range(3))
    near = a + " more"
    rows = [(3, a), (8, a), (8, b), (9, c), (None, a), (None, c), (12, near), (12, near), (20, b), (20, b), (21, "alone " + c), (21, "alone " + c), (30, None), (30, None)]
    kept = ngram_join.keep_one(frame(spark, rows)).collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["text"] or "") for r in kept) == sorted([(3, a), (8, b), (9, c), (30, ""), (30, "")])
    same_id = [(5, a), (5, near), (5, b)]
    assert len(ngram_join.keep_one(frame(spark, same_id)).collect()) == 2
    assert [r["doc_id"] for r in ngram_join.keep_one(frame(spark, [(None, a), (None, a)])).collect()] == [None]


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, x) for x in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(1, 41), 0), **dict.fromkeys(range(101, 140), 100), 201: 200}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# decontamination


def plain_leaks(rows, items):
    """(doc_id, item_id) by edit distance of every window against every place."""

    def norm(t):
        return b" ".join((t or "").encode().lower().split())

    out = set()
    for i, t in rows:
        d = np.frombuffer(norm(t), np.uint8)
        for j, b in items:
            x = norm(b)
            if len(x) < decontaminate.SHORT:
                if x and b" " + x + b" " in b" " + d.tobytes() + b" ":
                    out.add((i, j))
                continue
            size = min(len(x), decontaminate.WINDOW)
            last = len(x) - size
            for a in {*range(0, last + 1, decontaminate.STRIDE), last}:
                row = np.zeros(len(d) + 1, int)
                for c in x[a : a + size]:
                    new = np.concatenate([[row[0] + 1], np.minimum(row[:-1] + (d != c), row[1:] + 1)])
                    steps = np.arange(len(new))
                    row = np.minimum.accumulate(new - steps) + steps
                if row.min() <= decontaminate.bound(size)[0]:
                    out.add((i, j))
                    break
    return out


def test_leaks_are_exact(spark, rng):
    items = [(j, prose(rng, n, 30)) for j, n in enumerate((10, 12, 20, 30, 7))] + [(90, None), (91, ""), (92, "short")]
    rows = []
    for i in range(60):
        t = prose(rng, rng.randrange(5, 60), 30)
        if i % 3 == 0:
            leak = list(rng.choice(items[:5])[1])
            for _ in range(rng.randrange(0, 22)):
                at = rng.randrange(len(leak))
                leak[at : at + rng.randrange(2)] = rng.choice(["", "q", "QQ", " "])
            t = t[: len(t) // 2] + ("  \n" if i % 2 else "") + "".join(leak).replace(" ", rng.choice([" ", "\n ", "\t"])) + t[len(t) // 2 :]
        rows.append((i, t))
    got = decontaminate.leaks(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    found = {(r["doc_id"], r["item_id"]) for r in got.collect()}
    assert found == plain_leaks(rows, items)
    assert any(found)
    kept = {r["doc_id"] for r in decontaminate.clean(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert kept == {i for i, _ in rows} - {i for i, _ in found}


def test_leak_spans_and_odd_rows(spark, odd_rows, rng):
    item = prose(rng, 30)
    rows = [*odd_rows, (50, "éé " + item + " tail"), (51, prose(rng, 90_000) + "\n\n" + item.upper())]
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.leaks(frame(spark, rows), items).collect()}
    assert set(got) == {50, 51}
    for i in (50, 51):
        t = dict(rows)[i]
        assert t[got[i]["start"] : got[i]["end"]].lower().strip() == item
    assert decontaminate.leaks(frame(spark, []), items).count() == 0
    assert decontaminate.leaks(frame(spark, rows), items.limit(0)).count() == 0
    assert decontaminate.clean(frame(spark, rows), items.limit(0)).count() == len(rows)
    assert decontaminate.clean(frame(spark, rows), items).columns == frame(spark, rows).columns


def test_short_items_count_as_a_whole(spark):
    items = spark.createDataFrame([(1, "Yes"), (2, "the  Answer is 42"), (3, ""), (4, "answer"), (5, "\u00e9t\u00e9 x")], "item_id long, text string")
    rows = [(1, "oh yes"), (2, "yes, no"), (3, "so the answer\nIS 42 indeed"), (4, "the answer is 421"), (5, "yesyes"), (6, "yes"), (7, None), (8, "l'\u00e9t\u00e9 x"), (9, "un \u00e9t\u00e9 x"), (10, "a yes"), (11, "yes b")]
    got = {(r["doc_id"], r["item_id"]): (r["start"], r["end"], r["edits"]) for r in decontaminate.leaks(frame(spark, rows), items).collect()}
    assert got == {(1, 1): (3, 6, 0), (3, 2): (3, 19, 0), (3, 4): (7, 13, 0), (4, 4): (4, 10, 0), (6, 1): (0, 3, 0), (9, 5): (3, 8, 0), (10, 1): (2, 5, 0), (11, 1): (0, 3, 0)}
    assert {r["doc_id"] for r in decontaminate.clean(frame(spark, rows), items).collect()} == {2, 5, 7, 8}


def test_large_benchmark_is_one_pass(rng):
    class Table:
        def select(self, *_):
            return self

        def toLocalIterator(self):
            return ({"item_id": i, "text": text} for i in range(1000))

    text = prose(rng, 1800)
    assert 10_000_000 < 1000 * len(text) < decontaminate.PART_BYTES
    asked = []
    real, decontaminate.index = decontaminate.index, lambda part: asked.append(len(part))
    try:
        list(decontaminate._parts(Table()))
    finally:
        decontaminate.index = real
    assert asked == [1000]


# chat


def test_chat_round_trip(spark, odd_rows):
    turns = [(1, 0, "user", "a<|b"), (1, 1, "user", "<\\|im_end|>"), (1, 2, "assistant", None), (1, 3, "assistant", "x<|im_next|>y<"), (1, 4, None, "\\"), (2, 0, "sys\ntem<|im_start|>", ""), (2, 0, "a", "tie"), (2, 0, "a", "tie")]
    turns += [(3, k, "assistant" if k % 2 else "user", t) for k, (_, t) in enumerate(odd_rows)]
    df = spark.createDataFrame([(*t, "z") for t in turns], "conv_id long, turn long, role string, text string, segments string")
    chats = chat_format.format_chats(df)
    back = {r["conv_id"]: [(t["role"], t["text"]) for t in r["t"]] for r in chats.select("conv_id", chat_format.read_back(F.col("formatted")).alias("t")).collect()}
    want = {}
    for c, n, role, text in sorted((c, n, r or "", t or "") for c, n, r, t in turns):
        want.setdefault(c, []).append((role, text))
    assert back == want
    d = {r["conv_id"]: r for r in chat_format.digests(chats).collect()}
    for c, t in want.items():
        loss = "".join(x for r, x in t if r == "assistant")
        assert d[c]["n_turns"] == len(t) and d[c]["loss_chars"] == len(loss)
        assert d[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert d[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in t).encode()).hexdigest()
    first = next(r for r in chats.collect() if r["conv_id"] == 1)
    assert first["formatted"].count(chat_format.START) == 3  # same roles share a block
    assert "".join(s["text"] for s in first["segments"]) == first["formatted"]
    assert chat_format.digests(chat_format.format_chats(df.limit(0))).count() == 0


# resharding


def test_fewest_moves_is_least():
    flow = resharding.fewest_moves([5, 9, 0], [4, 4, 4, 2])
    assert [sum(r) for r in flow] == [5, 9, 0] and all(sum(c) <= k for c, k in zip(zip(*flow, strict=True), [4, 4, 4, 2], strict=True))
    assert sum(x for i, r in enumerate(flow) for j, x in enumerate(r) if i != j) == 6
    dear = resharding.fewest_moves([3, 3], [3, 3], [[5, 1], [1, 5]])
    assert dear == [[0, 3], [3, 0]]
    with pytest.raises(ValueError):
        resharding.fewest_moves([5], [4])


@pytest.mark.parametrize("blocks", [None, 7])
def test_reshard(spark, rng, blocks, tmp_path):
    rows = [(i, None if i % 50 == 0 else prose(rng, 1 + int(rng.paretovariate(1.2)))) for i in range(900)]
    df = frame(spark, rows)
    sized = resharding.sized(df).withColumn("old_shard", (F.col("doc_id") % 3).cast("int"))
    placed = resharding.reshard(sized, 5, blocks=blocks)
    got = placed.collect()
    assert sorted(r["doc_id"] for r in got) == sorted(i for i, _ in rows)
    text = dict(rows)
    assert all(r["size"] == len((text[r["doc_id"]] or "").encode()) + 1 and r["text_crc32"] == zlib.crc32((text[r["doc_id"]] or "").encode()) for r in got)
    total = [sum(r["size"] for r in got if r["shard"] == k) for k in range(5)]
    assert max(total) - min(total) <= 200
    for k in range(5):
        assert sorted(r["slot"] for r in got if r["shard"] == k) == list(range(sum(r["shard"] == k for r in got)))
    least = sum(max(0, sum(r["size"] for r in got if r["old_shard"] == k) - sum(total) / 5) for k in range(3))
    assert sum(r["size"] for r in got if r["moved"]) <= least + 2 * max(r["size"] for r in got)
    affected = {r["shard"] for r in resharding.rewrite(df, placed, str(tmp_path / "new")).collect()}
    back = spark.read.parquet(str(tmp_path / "new"))
    assert sorted(r["doc_id"] for r in back.select("doc_id").collect()) == sorted(r["doc_id"] for r in got if r["shard"] in affected)


def test_reshard_odd_rows(spark, odd_rows):
    sized = resharding.sized(frame(spark, odd_rows)).withColumn("old_shard", F.lit(4))
    got = resharding.reshard(sized, 3).collect()
    assert len(got) == len(odd_rows)
    for k in range(3):
        mine = [r["slot"] for r in got if r["shard"] == k]
        assert sorted(mine) == list(range(len(mine)))
    assert resharding.reshard(sized.limit(0), 3).count() == 0


def test_reshard_writes_files_and_reads_them_back(spark, odd_rows, rng, tmp_path):
    rows = odd_rows + [(8, "another text of the same id"), (None, "a second row without id")] + [(i, prose(rng, 9)) for i in range(100, 300)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    before = set(glob.glob(f"{shared_dir(spark)}/op10-shards-*".removeprefix("file:")))
    got = QUERIES["op10_resharding"](spark, str(tmp_path)).collect()
    (out,) = set(glob.glob(f"{shared_dir(spark)}/op10-shards-*".removeprefix("file:"))) - before
    key = lambda i, t: (str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == sorted(key(i, t) for i, t in rows)
    files, affected = spark.read.parquet(out).collect(), {k for r in got if r["moved"] for k in (r["old_shard"], r["shard"])}
    assert len(affected) > 4 and {r["shard"] for r in files} <= affected
    in_files, told = ({(r["shard"], r["slot"], *x) for r, x in pairs} for pairs in (
        [(r, key(r["doc_id"], r["text"])) for r in files], [(r, (str(r["doc_id"]), r["size"], r["text_crc32"])) for r in got if r["shard"] in affected]))
    assert in_files == told and len(files) == len(told)
    assert not Counter((str(r["doc_id"]), r["text"], r["lang"]) for r in files) - Counter((str(i), t, "en") for i, t in rows)
    for k in range(8):
        mine = [r["slot"] for r in got if r["shard"] == k]
        assert sorted(mine) == list(range(len(mine)))


def test_reshard_leaves_files_of_other_shards(spark, tmp_path):
    rows = [(3 * i + k, "x") for k, n in enumerate((10, 14, 6)) for i in range(n)]
    got = resharding.rewritten(frame(spark, rows), F.col("doc_id") % 3, 3, f"{tmp_path}/new").collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in rows) and Counter(r["shard"] for r in got) == {0: 10, 1: 10, 2: 10}
    assert {r["shard"] for r in spark.read.parquet(f"{tmp_path}/new").collect()} == {1, 2} and sum(r["moved"] for r in got) == 4
    same = resharding.rewritten(frame(spark, rows[:10]), F.lit(0), 1, f"{tmp_path}/none")
    assert same.count() == 10 and not (tmp_path / "none").exists()
    assert resharding.rewritten(frame(spark, []), F.lit(0), 3, f"{tmp_path}/empty").count() == 0


# packing


def plain_padding(lengths, buckets):
    bins = sorted(set(lengths))
    best = {-1: 0}
    for _ in range(buckets):
        new = dict(best)
        for j, top in enumerate(bins):
            for i in range(-1, j):
                if i in best:
                    lo = bins[i] if i >= 0 else -1
                    new[j] = min(new.get(j, 10**18), best[i] + sum(top - x for x in lengths if lo < x <= top))
        best = new
    return best[len(bins) - 1]


@pytest.mark.parametrize("buckets", [1, 2, 3, 5, 40])
def test_boundaries_are_best(rng, buckets):
    lengths = [int(rng.paretovariate(0.8) * 3) % 200 + 1 for _ in range(150)]
    b, c = np.unique(lengths, return_counts=True)
    ends = packing.best_boundaries(b, c, b * c, buckets)
    assert len(ends) <= buckets and ends[-1] == len(b) - 1
    low, cost = -1, 0
    for e in ends:
        cost += sum(int(b[e]) - x for x in lengths if low < x <= b[e])
        low = int(b[e])
    assert cost == plain_padding(lengths, buckets)


def test_pack(spark, rng, odd_rows):
    rows = [*odd_rows, *((100 + i, prose(rng, 1 + i % 90)) for i in range(400))]
    got = packing.pack(frame(spark, rows), token_budget=300, buckets=6).collect()
    assert len(got) == len(rows)
    batches = {}
    for r in got:
        batches.setdefault(r["batch_id"], []).append(r)
    assert sorted(batches) == list(range(len(batches)))
    for b in batches.values():
        assert len({r["bucket"] for r in b}) == 1 and sorted(r["place"] for r in b) == list(range(len(b)))
        assert len(b) == 1 or len(b) * b[0]["bucket_len"] <= 300
        assert all(r["padding"] == r["bucket_len"] - r["n_tokens"] >= 0 for r in b)
    long = [r for r in got if r["n_tokens"] > 60_000]
    assert len(long) == 2 and all(len(batches[r["batch_id"]]) == 1 for r in long)
    assert packing.pack(frame(spark, [])).count() == 0


