"""Operators of the second round against plain versions, and network access against a local server."""

import http.server
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators import clustering, coordination, grouping, image_match, keyword, links, status
from quillspark.sources import api, net, sinks, tables


@pytest.fixture(scope="module")
def server():
    class Handler(http.server.BaseHTTPRequestHandler):
        def _answer(self, body):
            if self.path == "/moved":
                self.send_response(302)
                self.send_header("Location", "/page")
            elif self.path == "/loop":
                self.send_response(301)
                self.send_header("Location", "/loop")
            elif self.path == "/nohead" and self.command == "HEAD":
                self.send_response(405)
            elif self.path == "/gone":
                self.send_response(404)
            else:
                self.send_response(200)
                self.send_header("Content-Type", "text/html; charset=latin-1")
            self.end_headers()
            if body and self.path in ("/page", "/nohead"):
                self.wfile.write("<html>é</html>".encode("latin-1"))

        def do_GET(self):
            self._answer(True)

        def do_HEAD(self):
            self._answer(False)

        def log_message(self, *_):
            pass

    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_address[1]}"
    s.shutdown()


def test_fetcher_follows_and_reports(spark, server):
    urls = [f"{server}/{p}" for p in ("page", "moved", "loop", "nohead", "gone")] + ["http://127.0.0.1:1/x", "no address"]
    got = {r["url"].rpartition("/")[2]: r for r in links.fetch_all(spark.createDataFrame([(u,) for u in [*urls, urls[0]]], "url string"), net.Fetcher(timeout=3, max_redirects=3)).collect()}
    assert len(got) == len(urls)
    assert got["page"]["http_status"] == 200 and got["page"]["html"] == "<html>é</html>" and got["page"]["chain"] == [urls[0]]
    assert got["moved"]["final_url"] == urls[0] and got["moved"]["chain"] == [urls[1], urls[0]]
    assert got["loop"]["error"] == "Exceeded max_redirects=3" and got["nohead"]["html"] and got["gone"]["http_status"] == 404
    assert got["x"]["error"] and got["no address"]["error"] and got["x"]["http_status"] is None


def test_prober(spark, server):
    port = int(server.rpartition(":")[2])
    sites = spark.createDataFrame([(1, [f"{server}/page"]), (2, ["http://127.0.0.1:1/"]), (3, ["http://no-such-host.invalid/"]), (4, [])], "site int, candidates array<string>")
    p = links.probe_all(sites, net.Prober(timeout=2, ports=(port, 1)))
    rows = {r["site"]: r for r in p.collect()}
    assert rows[1]["dns_ok"] and rows[1]["tcp_443_ok"] and not rows[1]["tcp_80_ok"] and rows[1]["attempts"][0]["http_status"] == 200
    assert rows[2]["attempts"][0]["error"] and rows[3]["dns_error"].startswith("DNS error") and rows[4]["attempts"] is None
    live = {r["site"]: r["is_live"] for r in links.live_verdict(p).collect()}
    assert live == {1: True, 2: False, 3: False, 4: False}


def test_fetch_goes_on_after_an_abort(spark, tmp_path):
    urls = spark.createDataFrame([(f"u{i}",) for i in range(40)], "url string")
    folder = str(tmp_path / "got")
    real, seen = links.fetch_all, []

    def failing(df, fetch, schema):
        seen.append(1)
        if len(seen) == 3:
            raise RuntimeError("stopped")
        return real(df, fetch, schema)

    links.fetch_all = failing
    try:
        with pytest.raises(RuntimeError):
            links.fetch_batches(urls, lambda u: {"http_status": 1}, folder, 4)
    finally:
        links.fetch_all = real
    got = links.fetch_batches(urls, lambda u: {"http_status": 2}, folder, 4)
    codes = {r["http_status"]: r["n"] for r in got.groupBy("http_status").agg(F.count("*").alias("n")).collect()}
    assert sum(codes.values()) == 40 and set(codes) == {1, 2}


def test_keys_stay_distributed_and_pages_end(spark):
    keys = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "k string")
    got = api.read_keys(keys, "n long", lambda k, c: (200, [(c or 0,)], (c or 0) + 1 if k == "a" or (c or 0) < 1 else None), api.Paging(max_pages=3)).collect()
    assert sorted((r["key"], r["n"]) for r in got if r["error"] is None) == [("a", 0), ("a", 1), ("a", 2), ("b", 0), ("b", 1)]
    assert [r["error"] for r in got if r["error"]] == ["more than 3 pages"]


def test_upload_checks_first(spark, tmp_path):
    good = spark.createDataFrame([(i, f"t{i}") for i in range(25)], "id long, text string")
    done, folder = [], str(tmp_path)

    def client(rows, folder=folder):
        import uuid

        with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
            f.write(str(len(rows)))

    assert sinks.upload(good, client, 4, "id", "text", lambda: done.append("made"), done.append) == 25 and done == ["made", "text"]
    sizes = [int(p.read_text()) for p in tmp_path.iterdir()]
    assert sum(sizes) == 25 and max(sizes) <= 4
    for bad, said in ((good.drop("text"), "no column"), (good.withColumn("x", F.array(F.lit(1))), "types"), (good.union(good), "repeats"), (good.limit(0), "no rows"), (good.withColumn("id", F.lit(" ")), "blank")):
        done.clear()
        with pytest.raises(ValueError, match=said):
            sinks.upload(bad, client, 4, "id", "text", lambda: done.append("made"))
        assert not done


def test_jdbc_rows_push_down(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "a cat"), (2, "a dog"), (3, "cats"), (4, None)], "id int, text string")
    asked = {}

    class Reader:
        def format(self, name):
            asked["format"] = name
            return self

        def options(self, **o):
            asked.update(o)
            return self

        def load(self):
            return rows

    class Session:
        read = Reader()

    got = tables.jdbc_rows(Session(), "jdbc:x", "posts", "text", "cat", "id", 5, driver="d")
    assert [r["id"] for r in got.collect()] == [3, 1] and asked == {"format": "jdbc", "url": "jdbc:x", "dbtable": "posts", "driver": "d"}


def test_check_one_and_registry(spark):
    assert status.check_one(spark, "https://x.com/a/status/12", lambda i: {"http_status": 404}) == {"raw": "https://x.com/a/status/12", "post_id": "12", "status": "gone"}
    assert status.check_one(spark, "??", lambda i: {"http_status": 200})["status"] == "invalid_url"
    assert not status.supported("q", "posts")
    status.register("q", posts=(status.parse_post, status.post_verdict))
    assert status.supported("q", "posts")
    del status.REGISTRY["q"]


def plain_phash(grey):
    """By loops: Lanczos across and down with rounding, a cosine transform, and the median."""
    import math

    def shrink(row, n):
        out, scale = [], len(row) / n
        wide = max(scale, 1.0)
        for k in range(n):
            c = (k + 0.5) * scale
            lo, hi = max(0, int(c - 3 * wide + 0.5)), min(len(row), int(c + 3 * wide + 0.5))
            w = []
            for x in range(lo, hi):
                t = (x - c + 0.5) / wide
                w.append(0.0 if abs(t) >= 3 else 1.0 if t == 0 else math.sin(math.pi * t) / (math.pi * t) * math.sin(math.pi * t / 3) / (math.pi * t / 3))
            s = sum(w)
            fixed = [int(x / s * (1 << 22) + (0.5 if x >= 0 else -0.5)) for x in w]
            out.append(min(255, max(0, sum(f * int(row[lo + i]) for i, f in enumerate(fixed)) + (1 << 21) >> 22)))
        return out

    rows = [shrink(r, 64) if len(r) != 64 else list(map(int, r)) for r in grey]
    cols = [shrink(c, 64) if len(c) != 64 else list(c) for c in zip(*rows)]
    pixels = np.array(cols, float).T
    low = [[sum(pixels[y, x] * math.cos(math.pi * u * (2 * y + 1) / 128) * math.cos(math.pi * v * (2 * x + 1) / 128) for y in range(64) for x in range(64)) for v in range(16)] for u in range(16)]
    mid = np.median(low)
    bits = "".join("1" if x > mid else "0" for r in low for x in r)
    return [int.from_bytes(int(bits[k : k + 64], 2).to_bytes(8, "big"), "big", signed=True) for k in range(0, 256, 64)]


def test_phash_is_the_usual_one():
    rng = np.random.default_rng(8)
    for shape in ((64, 64), (100, 37), (20, 150)):
        grey = rng.integers(0, 256, shape)
        got, want = image_match.phash(grey.astype(np.uint8)).tolist(), plain_phash(grey)
        assert sum((a ^ b).bit_count() if (a ^ b) >= 0 else (a ^ b & (1 << 64) - 1).bit_count() for a, b in zip(got, want)) == 0


def test_copies_in_lsh_join(spark):
    base = [0x1234567812345678, 3, 5, 7]
    rows = [(i, f"n{i}", base) for i in range(30)] + [(100, "near", [base[0] ^ 1, 3, 5, 7]), (101, "far", [0x7FFF000011112222, 0x4444333322221111, -5, -7])]
    got = image_match.lsh_join(spark.createDataFrame(rows, "idx long, name string, hash array<long>"), 5).collect()
    assert len(got) == 30 * 29 // 2 + 30 and sum(r["exact"] for r in got) == 435 and {r["image_b"] for r in got if not r["exact"]} == {"near"}


def test_hashed_vectors(spark):
    texts = ["abcabc", "ABC", "", None, "é𝔘x" * 40, "ab"]
    got = {r["row_index"]: np.array(r["embedding"]) for r in clustering.hashed_vectors(spark.createDataFrame(list(enumerate(texts)), "i long, t string"), "i", "t").collect()}
    assert all(len(v) == 256 and abs((v**2).sum() - 1) < 1e-9 for v in got.values())
    assert np.count_nonzero(got[1]) == 1 and np.count_nonzero(got[0]) <= 3 and got[0] @ got[1] > 0.5 and np.array_equal(got[2], got[3])
    assert np.array_equal(clustering._hashed("abcabc", 256, 3), got[0])


def test_open_rows_are_an_error(spark):
    v = spark.createDataFrame([(i, [1.0, i / 10]) for i in range(8)], "row_index long, embedding array<double>")
    with pytest.raises(RuntimeError):
        clustering.near_duplicates(v, 0.995, most_rounds=1)


def test_token_stop_words(spark):
    got = {r["value"]: r["mentions"] for r in grouping.token_counts(spark.createDataFrame([("Into any #tag the people www x@y into",)], "t string"), "t").collect()}
    assert got == {"into": 2, "any": 1, "#tag": 1, "x@y": 1}


def test_windows_of_many_entities_pair(spark):
    e = spark.sql("SELECT timestamp_ntz'2024-01-01 00:00:00' AS ts, cast(id AS string) AS entity, id AS row_index FROM range(0, 230)")
    assert coordination.pairwise_co_posts(e).count() == 230 * 229 // 2
    assert coordination.pairwise_co_posts(e, most_entities=200).count() == 0 and coordination.pairwise_co_posts(e, compat_first20=True).count() == 190


def test_factors_against_numpy(spark):
    rng = np.random.default_rng(9)
    a = rng.random((60, 6)) @ np.diag([9, 7, 5, 3, 2, 1]) @ rng.random((6, 60))
    a = a + a.T
    rows = spark.createDataFrame([(i, list(range(60)), a[i].tolist()) for i in range(60)], "i int, at array<int>, value array<double>")
    x = keyword._factors(rows, 60, 4)
    u, s, _ = np.linalg.svd(a)
    assert np.allclose(np.abs(x), np.abs(u[:, :4] * np.sqrt(s[:4])), atol=1e-6)


def test_ppmi_against_plain_counts(spark):
    from collections import Counter

    texts = ["a b c a d", "b c", "", "c c a e b a", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, t string")
    got = {(r["a"], r["b"]): r["count"] for r in keyword.ppmi(keyword.corpus(df, "i", "t", (1, 1), 1), 1, 2, 4).collect()}
    vocab, want = set("abc") | {"d"}, Counter()  # the four most frequent by documents, ties by term
    for t in texts:
        w = [x for x in (t or "").split() if x in vocab]
        for i, x in enumerate(w):
            for y in w[i + 1 : i + 3]:
                want[x, y] += 1
                want[y, x] += 1
    assert got == dict(want)


def test_word_list(spark, tmp_path):
    (tmp_path / "stop.txt").write_text("The of\n the  AND\n\n")
    assert keyword.word_list(spark, str(tmp_path / "stop.txt")) == ["and", "of", "the"]
    none = "array()"
    c = spark.sql(f"SELECT * FROM VALUES ('actually', 0.9D, 'semantic', array('semantic'), 'x', {none}, NULL, 9L), ('cabal', 0.5D, 'semantic', array('semantic'), 'x', {none}, NULL, 9L) AS t({', '.join(p.split()[0] for p in keyword.CANDIDATE.split(', '))})")
    assert [r["term"] for r in keyword.merge(c, ["seed"], stop=["actually"]).collect()] == ["cabal"]
