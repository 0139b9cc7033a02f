"""Importance resampling, whitening and media chunks against plain brute force, and on odd rows."""

import hashlib
import math
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from verdigris.llm import common, media, resampling, whitening

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    w = WORD.findall((text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))))
    return [*w, *(a + b" " + b for a, b in zip(w, w[1:]))], len(w)


def plain_resample(docs, target, percent=25, least=20):
    def counts(texts):
        c = [0] * 10000
        for t in texts:
            for f in features(t)[0]:
                c[zlib.crc32(f) % 10000] += 1
        return c

    s, t = counts(x for _, x in docs), counts(target)
    S, T = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((b + 1) * (S + 10000) / ((a + 1) * (T + 10000)))) for a, b in zip(s, t)]
    rows = []
    for k, x in docs:
        f, n = features(x)
        weight = sum(gain[zlib.crc32(y) % 10000] for y in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        rows.append([k, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    fit = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for i, r in enumerate(fit[: percent * len(fit) // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return [tuple(r) for r in common.table(spark, sf, "documents").select("doc_id", "text").collect()]


def test_op11_equals_brute_force(spark, sf, docs):
    target = [r["text"] for r in common.table(spark, sf, "benchmark").collect()]
    assert got(resampling.op11_importance_resampling(spark, sf)) == plain_resample(docs, target)


def test_resample_odd_rows(spark, odd, odd_rows, none):
    cols = ["doc_id", "n_features", "weight", "score", "rank"]
    rows = [(r[0], r[1]) for r in odd_rows] * 3
    target = spark.createDataFrame([("quick brown fox",), (None,), ("",)], "text string")
    tripled = odd.unionByName(odd).unionByName(odd)
    assert got(resampling.resample(tripled, target).select(*cols)) == plain_resample(rows, ["quick brown fox", None, ""])
    assert got(resampling.resample(odd, none).select(*cols)) == plain_resample([(r[0], r[1]) for r in odd_rows], [])
    assert got(resampling.resample(none, target).select(*cols)) == []


def test_automaton_on_words_longer_than_its_steps_and_text_ends():
    import pyarrow as pa

    texts = ["a" * 63 + " " + "B" * 64 + "-" + "c" * 65 + "é" * 100, "", "x", "Y z", "日本 語" * 50, "-", "tail" * 5000]
    reader = resampling.Automaton(10000, 3)
    have = [[] for _ in texts]
    for i, b in ((i, b) for text_of, bucket in reader.runs(pa.array([None, *texts]).fill_null("").slice(1)) for i, b in zip(text_of, bucket)):
        have[i].append(int(b))
    for t, h in zip(texts, have):
        w = WORD.findall(t.encode().lower())
        runs = [b" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]
        assert sorted(h) == sorted(zlib.crc32(r) % 10000 for r in runs)


def whole(v):
    return [math.floor(64 * float(np.float64(x))) + 1000000 for x in v]


def check_whitened(rows, vectors, most=32):
    """rows: of the query; vectors: key -> usable vector."""
    keys = sorted(vectors)
    x = [whole(vectors[k]) for k in keys]
    n, d = len(x), len(x[0])
    S = [sum(c) for c in zip(*x)]
    y = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(r, S)] for r in x])
    cov = y.T @ y / n
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1], v[:, ::-1]
    k = min(most, int((e > 1e-9 * e.sum()).sum()))
    by = {(r["vec_id"], r["component"]): r for r in rows}
    assert len(by) == len(rows) == n * k
    for i, key in enumerate(keys):
        for c in range(k):
            r = by[key, c + 1]
            assert r["n"] == n and r["deviation"] == sum((n * a - s) ** 2 for a, s in zip(x[i], S))
            assert r["explained"] == pytest.approx(e[c] / e.sum(), rel=1e-6) and r["identity_error"] < 1e-8
    w = np.array([[by[key, c + 1]["whitened"] for c in range(k)] for key in keys])
    assert np.abs(w.T @ w / n - np.eye(k)).max() < 1e-8
    back = (w * np.sqrt(e[:k])) @ (w * np.sqrt(e[:k])).T  # independent of signs
    assert np.allclose(back, y @ v[:, :k] @ v[:, :k].T @ y.T, rtol=1e-6, atol=1e-5 * e[0])
    return d


def test_op12_equals_brute_force(spark, sf):
    vectors = {r["vec_id"]: r["embedding"] for r in common.table(spark, sf, "embeddings").collect()}
    check_whitened(whitening.op12_embedding_whitening(spark, sf).collect(), vectors)


def test_whiten_odd_vectors(spark):
    rng = np.random.default_rng(5)
    good = {i: (rng.normal(size=5) * [1, 2, 3, 4, 100]).tolist() for i in range(40)}
    for v in good.values():
        v[3] = v[0]  # a dimension twice: four components
    bad = [(100, None), (101, []), (102, [1.0, None, 2.0, 3.0, 4.0]), (103, [1.0, float("nan"), 2.0, 3.0, 4.0]), (104, [float("inf")] * 5), (105, [1.0, 2.0]), (106, [1e300] * 5)]
    rows = [(k, v, "x") for k, v in [*good.items(), *bad]]
    schema = "vec_id long, embedding array<double>, component string"
    args = {"scale": 64.0, "shift": 1_000_000}
    check_whitened(whitening.whiten(spark.createDataFrame(rows, schema), **args).collect(), good)
    assert whitening.whiten(spark.createDataFrame([], schema), **args).collect() == []
    assert whitening.whiten(spark.createDataFrame(bad[:3], "vec_id long, embedding array<double>"), **args).collect() == []
    same = [(None, [1.0, 2.0], "x")] * 3 + [(1, [1.0, 2.0], "x")]
    assert whitening.whiten(spark.createDataFrame(same, schema), **args).collect() == []
    line = whitening.whiten(spark.createDataFrame([(None, [1.0, 2.0], "x"), (None, [3.0, 2.0], "x"), (2, [1.0, 2.0], "x")], schema), **args).collect()
    assert [r["component"] for r in line] == [1, 1, 1] and {float(r["explained"]) for r in line} == {1.0}


def test_large_entries_and_tiny_components():
    """Eigenvalues down to 1e-19 of the largest come out, and products of 50-bit numbers keep 100 bits."""
    rng = np.random.default_rng(3)
    q = np.linalg.qr(rng.normal(size=(20, 20)))[0]
    e = 10.0 ** -np.linspace(0, 19, 20)
    a = (q * np.sqrt(e)).T.copy()
    cov = whitening.exact_product((a, a * 0), (a, a * 0))
    got, x = whitening.eigen(cov)
    assert np.allclose(got, e, rtol=1e-4)
    y = x / np.sqrt(got)
    eye = whitening.exact_product((y, y * 0), whitening.exact_product(cov, (y, y * 0)))
    assert np.abs(sum(eye) - np.eye(20)).max() < 1e-5
    x = (rng.integers(-5, 5, size=(300, 3)) + 10**15).astype(np.float64)
    hi, lo = whitening.exact_product((x, x * 0), (x, x * 0))
    plain = [[sum(int(r[i]) * int(r[j]) for r in x) for j in range(3)] for i in range(3)]
    assert all(abs(int(hi[i, j]) + int(lo[i, j]) - plain[i][j]) <= plain[i][j] >> 100 for i in range(3) for j in range(3))


def plain_media(text):
    data = (text or "").encode()
    payload = data + bytes(-len(data) % 64) or bytes(64)
    n = len(payload)
    wav = b"RIFF" + (n + 36).to_bytes(4, "little") + b"WAVEfmt " + b"".join(v.to_bytes(s, "little") for v, s in ((16, 4), (1, 2), (1, 2), (8000, 4), (8000, 4), (1, 2), (8, 2))) + b"data" + n.to_bytes(4, "little") + payload
    x = [b - 128 for b in payload]
    changes = sum((a < 0) != (b < 0) for a, b in zip(x, x[1:]))
    return (len(data), n, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(wav), hashlib.sha256(wav).hexdigest(), f"pcm8:{n}:{sum(x)}:{sum(v * v for v in x)}:{changes}")


def test_op13_equals_brute_force(spark, sf, docs):
    want = sorted(((k, *plain_media(t)) for k, t in docs), key=repr)
    assert got(media.op13_media_chunks(spark, sf)) == want


def test_media_odd_rows(spark, odd, odd_rows, none):
    assert got(media.store_and_verify(odd)) == sorted(((r[0], *plain_media(r[1])) for r in odd_rows), key=repr)
    assert got(media.store_and_verify(none)) == []


def test_cuts_follow_the_content_and_equal_a_byte_loop():
    rng = np.random.default_rng(1)
    payload = rng.integers(0, 256, 300_000, dtype=np.uint8).tobytes()
    table = media.gear()

    def plain(p):
        ends, begin, h = [], 0, 0
        for i, b in enumerate(p):
            h = ((h << 1) + int(table[b])) & 0xFFFFFFFF
            if i + 1 - begin >= media.LEAST and h < (1 << 32) // media.MEAN or i + 1 - begin == media.MOST or i + 1 == len(p):
                ends.append(i + 1)
                begin = i + 1
        return ends

    assert media.cuts(payload, table) == plain(payload)
    assert b"".join(media.chunks(payload, table)) == payload
    edited = payload[:150_000] + b"something new" + payload[150_000:]
    old, new = set(media.chunks(payload, table)), set(media.chunks(edited, table))
    assert len(new - old) <= 4  # cuts meet again after the edit


def test_chunks_are_stored_once_and_not_again(spark, odd):
    first = media.ingest(odd)
    digests = [bytes(r["digest"]) for r in first.chunks.select("digest").collect()]
    assert len(digests) == len(set(digests))
    more = odd.limit(5).selectExpr("doc_id", "concat(text, ' and a new end ', repeat('z', 3000)) AS text").unionByName(odd.select("doc_id", "text"))
    second = media.ingest(more, earlier=first)
    all_digests = [bytes(r["digest"]) for r in second.chunks.select("digest").collect()]
    assert len(all_digests) == len(set(all_digests)) > len(digests)
    out = media.read_back(second, media.digests, "payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    assert got(out) == sorted(((r[0], *plain_media(r[1])) for r in more.collect()), key=repr)


def test_a_wrong_chunk_is_noticed(spark, odd):
    stored = media.ingest(odd)
    data = stored.chunks.where("length(data) > 150").first()["data"]
    stored.chunks = stored.chunks.withColumn("data", F.when(F.length("data") > 150, F.lit(bytes(data))).otherwise(F.col("data")))
    with pytest.raises(Exception, match="differs from what was stored"):
        media.read_back(stored, media.digests, "payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string").collect()


def test_chunks_that_many_runs_share_go_to_all_tasks(spark, monkeypatch):
    monkeypatch.setattr(media, "RUN_BYTES", 1)  # a run a row
    rng = np.random.default_rng(2)
    shared = "".join(chr(c) for c in rng.integers(97, 123, 6000))
    rows = [(i, shared if i % 3 else f"{i} " * 400 + shared) for i in range(60)] + [(None, None)] * 12
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(media.store_and_verify(docs)) == sorted(((k, *plain_media(t)) for k, t in rows), key=repr)
