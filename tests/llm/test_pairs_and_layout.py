"""op3, op4, op5, op6, op8, op9 and the pipeline: against brute force, and on odd rows."""

import math
import random
import re
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from verdigris.llm import binary_output, common, decontaminate, mixing, near_dedup, token_counts, units, url_filter


# ---- op3 ------------------------------------------------------------------------------------


def edf(parts, n):
    q, done, out = sum(parts), [0] * len(parts), []
    for t in range(n):
        due = [(-(-(d + 1) * q // p), i) for i, (p, d) in enumerate(zip(parts, done)) if d * q // p <= t]
        i = min(due)[1]
        out.append(i)
        done[i] += 1
    return out


def test_op3_schedule_is_earliest_deadline_first_with_lag_below_one():
    parts = [500, 250, 120, 77, 50, 2, 1]
    stream, _, slot, _, _ = mixing.schedule(parts, [2 * p for p in parts])
    assert stream[:1000] == edf(parts, 1000) and slot == list(range(2000))
    q, done = sum(parts), [0] * len(parts)
    for t, s in enumerate(stream, 1):
        done[s] += 1
        assert all(abs(d - t * p / q) < 1 for d, p in zip(done, parts))


def test_op3_long_schedules_are_stored_in_pieces(spark, monkeypatch):
    parts, blocks = [5, 3, 0, 2], [40, 70, 6, 10]
    want = list(zip(*mixing.schedule(parts, blocks)))
    assert len(want) == 126 and all(s == 2 for s, *_ in want[120:]) and [b for s, b, *_ in want if s == 2] == list(range(6))
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 25)
    got = mixing.stored_schedule(spark, parts, blocks).orderBy("mix_position").collect()
    assert [tuple(r)[:5] for r in got] == want and [r.mix_position for r in got] == list(range(126))


def test_op3_more_sources_than_shares_and_weights_of_zero(spark):
    sizes = {f"s{i:04}": 3 for i in range(1500)} | {"none": 9}
    part = mixing.shares(sizes, 1000, 0.5, {f"s{i:04}": 0.001 * (i % 3) for i in range(1200)} | {"none": 0.0})
    assert part["none"] == part["s0000"] == 0 and part["s1499"] > 0 and part["s0002"] == 2 * part["s0001"] > 0
    stream, block, *_ = mixing.schedule(list(part.values()), list(sizes.values()))
    assert len(set(zip(stream, block))) == len(stream) == sum(sizes.values())
    with pytest.raises(ValueError):
        mixing.shares(sizes, 1000, 0.5, {"none": -1.0})


def test_op3_places_every_row_once(spark):
    rows = [(i, f"s{min(i % 7, 3)}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, source string")
    weights = {"s0": 0.1, "s1": 0.2, "s2": 0.3, "s3": 0.4}
    got = mixing.mix(df, weights=weights, block_docs=4, chunk_rows=100).collect()
    assert len(got) == len({r.mix_order for r in got}) == 3000
    by = defaultdict(list)
    for r in got:
        assert r.mix_release <= r.mix_slot < r.mix_deadline
        by[r.source].append(r.mix_block)
    for s, bs in by.items():
        assert sorted(set(bs)) == list(range(-(-len(bs) // 4))) and max(map(bs.count, set(bs))) <= 4
    blocks = sorted({(r.mix_position, r.source, r.mix_slot) for r in got})
    assert [b[0] for b in blocks] == list(range(len(blocks)))
    assert [b[2] for b in blocks] == sorted(b[2] for b in blocks)
    seen = defaultdict(int)
    for t, (_, s, slot) in enumerate(blocks, 1):
        seen[s] += 1
        if slot == t - 1:  # before a source runs out
            assert all(abs(seen[x] - t * w) < 1 for x, w in weights.items())


def test_op3_odd_rows(odd, none):
    got = mixing.mix(odd).collect()
    assert len(got) == odd.count() == len({r.mix_order for r in got})
    order = mixing.in_mixed_order(odd)
    assert order.columns == odd.columns and order.count() == odd.count()
    pooled = mixing.mix(odd, max_streams=1).collect()
    assert len(pooled) == odd.count()
    assert mixing.mix(none).collect() == [] and mixing.in_mixed_order(none).collect() == []


def test_op3_lag_is_below_one_for_weights_that_thousandths_cannot_express():
    sizes = {"hot": 400_000, **{f"s{i:02}": 40_000 for i in range(19)}}
    part = list(mixing.shares(sizes, 1000, 0.5, None).values())
    weight = [n**0.5 / sum(n**0.5 for n in sizes.values()) for n in sizes.values()]
    blocks = [-(-n // 16) for n in sizes.values()]
    stream, _, slot, release, deadline = mixing.schedule(part, blocks)
    assert len(stream) == 72_500 and all(r <= t < d for r, t, d in zip(release, slot, deadline))
    done = [0] * 20
    for t, (s, at) in enumerate(zip(stream, slot), 1):
        if at != t - 1:
            break
        done[s] += 1
        assert all(abs(d - t * w) < 1 for d, w in zip(done, weight)) or any(map(int.__eq__, done, blocks))
    assert t > 40_000
    tiny = mixing.shares({"a": 1, "b": 1}, 1000, 0.5, {"a": 0.9999, "b": 0.0001})
    assert tiny == {"a": 9999, "b": 1}
    assert len(mixing.schedule([10**12, 1], [3, 50])[0]) == 53  # weights far from sizes end soon


def test_op3_schedules_every_source(spark):
    rows = [(i, f"s{i % 150:03}") for i in range(150 * 8)]
    df = spark.createDataFrame([*rows, *[(10_000 + i, "tail") for i in range(6)]], "doc_id long, source string")
    got = mixing.mix(df, weights={f"s{i:03}": 0.004 for i in range(150)} | {"tail": 0.4}, block_docs=1).collect()
    assert len(got) == len({r.mix_order for r in got}) == len(rows) + 6
    # each by its own windows, the smallest source at its given weight
    assert all(r.mix_release <= r.mix_slot < r.mix_deadline for r in got)
    assert [r.mix_release for r in sorted(got, key=lambda r: r.mix_block) if r.source == "tail"] == [0, 2, 5, 7, 10, 12]
    assert all(len({r.mix_block for r in got if r.source == s}) == 8 for _, s in rows[:150])


# ---- op4 ------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def encode():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=units.pattern(), mergeable_ranks=units.load(None), special_tokens={}).encode_ordinary


def random_text(rng, n):
    return "".join(rng.choice(["a", "be", "The", " ", "  ", "\n", "\n\n", "\t", "'s", "'ll", "1", "42", ".", "...", "é", "日", "\u00a0", "\x1c", "\u2028", " x", "$%"]) for _ in range(n))


def test_units_cover_text_and_tokens(encode):
    rng = random.Random(1)
    cache = units.UnitCache(units.load(None), units.pattern(), 50)
    for _ in range(400):
        t = random_text(rng, rng.randrange(0, 60))
        us = units.split_units(t)
        assert "".join(us) == t
        assert [i for u in us for i in encode(u)] == encode(t), repr(t)
        assert sum(cache.of(us)) == len(encode(t)), repr(t)
        parts = list(units.stretches(t, rng.randrange(1, 20)))
        assert "".join(parts) == t and [i for p in parts for i in encode(p)] == encode(t), repr(t)


def test_op4_counts_equal_a_full_encoding(encode):
    rng = random.Random(2)
    cache = units.UnitCache(units.load(None), units.pattern())
    for _ in range(150):
        t = random_text(rng, rng.randrange(0, 200))
        tree = token_counts.Tree(*token_counts.cut_leaves(t, cache, 4))
        for _ in range(5):
            a = rng.randrange(0, len(t) + 3)
            b = a + rng.choice([0, 0, 1, 3, 30])
            t2 = tree.edit(t, a, b, random_text(rng, rng.choice([0, 1, 5, 40])), cache, 4)
            t = t2
            assert tree.tokens[1] == len(encode(t)) and tree.chars[1] == len(t), repr(t)


def test_op4_edits_stay_local(encode):
    rng = random.Random(4)
    cache = units.UnitCache(units.load(None), units.pattern())
    t = " ".join(rng.choice(["word", "other", "thing."]) for _ in range(20_000))
    tree = token_counts.Tree(*token_counts.cut_leaves(t, cache))
    for _ in range(20):
        t = tree.edit(t, at := rng.randrange(len(t)), at, " inserted", cache)
    assert tree.moved == 0 and tree.reencoded < 40 * 64 * 8  # no leaf split, nothing balanced
    for _ in range(3000):  # all in one place: leaves split there, and the depth stays logarithmic
        t = tree.edit(t, 50_000, 50_000, " at this place", cache)
    assert tree.tokens[1] == len(encode(t)) and tree.chars[1] == len(t)
    assert tree.moved < 10_000

    def depth(i):
        return 1 + max(depth(tree.left[i]), depth(tree.right[i])) if tree.left[i] else 0

    assert depth(1) < 30 and max(tree.leaves()[1]) < 6 * 64
    while len(t) > 100:
        a = rng.randrange(len(t))
        t = tree.edit(t, a, a + rng.randrange(9000), "", cache)
    assert tree.tokens[1] == len(encode(t)) and tree.chars[1] == len(t)


def test_op4_query_and_odd_rows(spark, sf, odd, none, encode):
    docs = common.table(spark, sf, "documents").select(F.col("doc_id") + 1000, "text").union(odd.select("doc_id", "text")).toDF("doc_id", "text")
    trees = token_counts.build_trees(docs)
    edited = token_counts.apply_edits(trees, token_counts.derived_edits(F.col("doc_id"), F.col("text")), keep_text=True)
    rows, texts = edited.collect(), {(r.doc_id, r.text) for r in docs.collect()}
    assert len(rows) == docs.count()
    for r in rows:
        if len(r.text_after) < 100_000:
            assert r.n_tokens_after == len(encode(r.text_after)) == sum(r.leaf_tokens)
    by = {d: t for d, t in texts if d is not None}
    assert all(r.n_tokens == len(encode(by[r.doc_id] or "")) for r in rows if r.doc_id is not None)
    assert sum(r.reencoded_chars for r in rows) < sum(r.n_chars_after for r in rows)
    assert token_counts.apply_edits(token_counts.build_trees(none), token_counts.derived_edits(F.col("doc_id"), F.col("text"))).collect() == []
    edits = spark.createDataFrame([(1, 1, 0, 3, "Hello"), (1, 0, 5, 5, "!")], "doc_id long, seq int, start int, end int, replacement string")
    joined = token_counts.with_edits(odd.select("doc_id", "text"), edits).where("doc_id = 1").first()
    assert [e["replacement"] for e in joined.edits] == ["!", "Hello"]


# ---- op5 ------------------------------------------------------------------------------------


def url_parts(u):
    if u is None or "://" not in u:
        return "", ""
    m = re.match(r"(?s)([^/?#]*)([^?#]*)", u.split("://", 1)[1])
    return re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]


def url_rule(host, path):
    fit = [r for _, r in url_filter.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return max(fit, key=len, default=None)


URLS = [None, "", "no scheme", "http://", "HTTP://A.Example.NET/en/x", "https://example.com/de/1?x=1&y=2#z", "https://notexample.com/de/1", "x://y.org/fr/a://b", "https://net", "https://net/", "https://a.net:80/", "ftp://u@h.net/a%20b", "https://a.org/fr", "\nhttps://b.net/q\nr", "https://İ.NET/en/", "https://a.net?x", "https://a.net/en/x"]


def test_op5_rules_and_model(spark, sf):
    pages = common.table(spark, sf, "pages").select("page_id", "url").union(spark.createDataFrame([(10_000 + i, u) for i, u in enumerate(URLS)], "page_id long, url string"))
    want = {r.page_id: r.url for r in pages.collect()}
    got = url_filter.filter_urls(pages, n_trees=3).collect()
    assert len(got) == len(want)
    decided = {r: v for v, r in url_filter.RULES}
    for r in got:
        host, path = url_parts(want[r.page_id])
        rule = url_rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule), want[r.page_id]
        assert r.verdict == (decided[rule] if rule else "block" if r.block_score >= 0.5 else "allow")


def test_op5_held_out_accuracy(spark):
    rng = random.Random(3)
    rows = []
    for i in range(1200):
        bad = rng.random() < 0.4
        host = "".join(rng.choice("abcdefghij0123456789" if bad else "aeionrst") for _ in range(18 if bad else 8))
        rows.append((i, f"https://{host}.{rng.choice(['biz', 'com'] if bad else ['com', 'edu'])}/{'x/' * rng.randrange(3)}{'?a=1&b=2&c=3' if bad else ''}", float(bad)))
    df = spark.createDataFrame(rows, "page_id long, url string, label double")
    model = url_filter.train(df.where("page_id < 800"), n_trees=4)
    held = model.score(df.where("page_id >= 800"), "url", "p").collect()
    assert sum((r.p >= 0.5) == (r.label == 1) for r in held) >= 0.95 * len(held)


def test_op5_edge_tables(spark):
    none = spark.createDataFrame([], "page_id long, url string, verdict string, f0 int")
    assert url_filter.filter_urls(none).collect() == []
    one = spark.createDataFrame([(1, "https://a.com/x", "v", 3), (1, "https://a.com/x", "v", 3)], none.schema)
    got = url_filter.filter_urls(one).collect()
    assert [r.verdict for r in got] == ["allow", "allow"] and got[0].f0 == 3


# ---- op6 ------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 3, 17, 256, 1000, 4097])
def test_op6_permutation(n):
    assert sorted(binary_output.slot_of(np.arange(n), n)) == list(range(n))
    if n > 16:
        assert list(binary_output.slot_of(np.arange(n), n)) != list(range(n))
        assert list(binary_output.slot_of(np.arange(n), n, 1)) != list(binary_output.slot_of(np.arange(n), n, 2))


def test_op6_round_trip(spark, odd, none, encode, tmp_path):
    length, per = 64, 8
    docs = odd.repartition(3)
    store = binary_output.materialise(docs, length=length, per_shard=per).persist()
    rows = sorted(store.collect(), key=lambda r: r.shard)
    n = sum(r.n_sequences for r in rows)
    assert [r.first_slot for r in rows] == [i * per for i in range(len(rows))] and all(r.n_sequences == per for r in rows[:-1])
    assert all(len(r.payload) == r.n_sequences * r.stride == r.n_sequences * length * 2 for r in rows)
    ids = lambda t: encode(t or "")
    assert all(ids(r.text) == encode(r.text or "") for r in docs.collect() if len(r.text or "") < 100_000)
    want = [(r.doc_id, *ids(r.text)) for r in docs.collect()]
    assert sum(r.n_tokens for r in rows) == sum(map(len, want)) and n == -(-sum(map(len, want)) // length)
    key = lambda d: -1 if d is None else d
    assert sorted((d for r in rows for d in r.doc_ids), key=key) == sorted((x[0] for x in want), key=key)
    got = dict(binary_output.read_slots(store, 0, n, per))
    assert sorted(got) == list(range(n))
    assert [t for t, _ in binary_output.read_slots(store, 5, 9, per)] == list(range(5, 14))
    # undo the permutation: sequence i of the packed order is at slot P(i); the texts come back
    flat = np.concatenate([got[int(s)] for s in binary_output.slot_of(np.arange(n), n)]).tolist()
    texts, cur = [], []
    for t in flat[: sum(map(len, want))]:
        if t == binary_output.END_ID:
            texts.append(tuple(cur))
            cur = []
        else:
            cur.append(t)
    assert sorted(texts) == sorted(x[1:] for x in want)
    files = binary_output.export_files(store, str(tmp_path)).collect()
    assert len(files) == len(rows) and (tmp_path / "shard-000000000.bin").read_bytes() == bytes(rows[0].payload)
    assert binary_output.materialise(none).collect() == []


def test_op6_shards_depend_on_the_rows_alone(spark, sf):
    docs = common.table(spark, sf, "documents").select("doc_id", "text")
    before, got = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for files, parts, window in ((1, 2, None), (5, 7, None), (2, 3, 16), (4, 5, 16)):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            rows = binary_output.materialise(docs.repartition(files), length=256, per_shard=32, window=window).collect()
            got.append(sorted((r.shard, r.n_sequences, r.n_tokens, tuple(r.doc_ids), bytes(r.payload)) for r in rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got[0] == got[1] != got[2] == got[3]


def test_op6_ids_of_four_bytes_and_keys_of_text(spark, encode):
    docs = spark.createDataFrame([("b", "some words here"), ("a", "x"), (None, "y")], "doc_id string, text string")
    store = binary_output.materialise(docs, length=4, per_shard=2, end_id=70_000)
    rows = store.collect()
    assert all(r.stride == 16 for r in rows) and sorted(d or "" for r in rows for d in r.doc_ids) == ["", "a", "b"]
    n = sum(r.n_sequences for r in rows)
    got = dict(binary_output.read_slots(store, 0, n, 2))
    flat = np.concatenate([got[int(s)] for s in binary_output.slot_of(np.arange(n), n)]).tolist()
    want = [i for t in ("y", "x", "some words here") for i in [*encode(t), 70_000]]
    assert flat[: len(want)] == want and set(flat[len(want) :]) <= {70_000}


# ---- op8 ------------------------------------------------------------------------------------


def brute_components(docs, k, percent):
    sets = {}
    for d, t in docs:
        ws = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        ws = re.findall(r"[^\x20\x09-\x0D]+", ws)
        sets[d] = frozenset([tuple(ws)] if 0 < len(ws) < k else [tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)] if ws else [])
    ids = sorted(sets)
    par = {i: i for i in ids}

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                n = len(sets[a] & sets[b])
                if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                    x, y = find(a), find(b)
                    par[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def family(rng, n_docs):
    vocab = [f"w{i}" for i in range(400)]
    docs = []
    for f in range(12):
        base = [rng.choice(vocab) for _ in range(rng.choice([5, 30, 120]))]
        for _ in range(n_docs):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                t[rng.randrange(len(t))] = rng.choice(vocab)
            docs.append(" ".join(t))
    rng.shuffle(docs)
    return list(enumerate([*docs, "", None, "one", "One", "a b", "a B", "\n"]))


def test_op8_equals_brute_force(spark):
    docs = family(random.Random(5), 12)
    want = brute_components(docs, 4, 80)
    got = near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), k=4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_op8_equals_its_sql(spark, sf):
    import duckdb

    docs = pd.DataFrame(family(random.Random(8), 12), columns=["doc_id", "text"])
    for given, view in ((spark.createDataFrame(docs), "docs"), (spark.read.parquet(f"{sf}/documents.parquet"), f"'{sf}/documents.parquet'")):
        con = duckdb.connect()
        con.register("docs", docs)
        con.execute(f"CREATE VIEW documents AS SELECT * FROM {view}")
        got = near_dedup.near_duplicates(given, k=4).select("doc_id", "n_shingles", "component_id", "kept")
        assert sorted(map(tuple, got.collect())) == sorted(con.sql(near_dedup.OP8_SQL).fetchall())


def test_op8_parts_of_large_buckets(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "PART", 6)
    monkeypatch.setattr(near_dedup, "BROADCAST_IDS", 0)
    docs = family(random.Random(6), 14)
    want = brute_components(docs, 4, 80)
    got = near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), k=4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_op8_pairs_that_are_alone_in_their_parts(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "PART", 6)
    tables = near_dedup.TABLES
    signatures = near_dedup.signatures

    def crafted(*args):
        # one first half-key for all, one second half-key for each pair, the other half-keys unique
        own = F.transform(F.sequence(F.lit(0), F.lit(2 * tables - 1)), lambda i: F.col("id") * 1000 + i + 1)
        halves = F.transform(own, lambda x, i: F.when(i == 0, F.lit(-1)).when(i == tables, -2 - F.floor(F.col("id") / 2)).otherwise(x))
        return signatures(*args).withColumn("halves", halves.cast("array<bigint>"))

    monkeypatch.setattr(near_dedup, "signatures", crafted)
    texts = [" ".join(f"p{d // 2}w{i}" for i in range(60)) + (" more" if d % 2 else "") for d in range(40)]
    got = near_dedup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {d: d - d % 2 for d in range(40)}


def test_op8_odd_rows(odd, none):
    rows = near_dedup.near_duplicates(odd, k=4).collect()
    assert len(rows) == odd.count()
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert (by[6].component_id, by[6].kept, by[5].component_id, by[12].component_id) == (1, False, 4, 7)
    kept = near_dedup.deduplicate(odd)
    assert kept.columns == odd.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=lambda x: -1 if x is None else x)
    assert ids == [None, None, 1, 2, 3, 4, 7, 9, 10, 11]
    assert near_dedup.near_duplicates(none).collect() == [] and near_dedup.deduplicate(none).collect() == []


def test_op8_family_components_on_any_order():
    rng = np.random.default_rng(4)
    for _ in range(60):
        base = rng.integers(0, 1 << 40, (rng.integers(1, 4), 30))
        sets = []
        for _ in range(rng.integers(1, 25)):
            x = base[rng.integers(len(base))].copy()
            x[rng.integers(0, 30, rng.integers(0, 9))] = rng.integers(0, 1 << 40)
            sets.append(np.unique(x))
        n = len(sets)
        par = list(range(n))

        def find(x):
            while par[x] != x:
                x = par[x]
            return x

        for i in range(n):
            for j in range(i):
                both = len(np.intersect1d(sets[i], sets[j]))
                if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                    par[find(i)] = find(j)
        got = near_dedup.family_components(sets, 80)
        assert all((got[i] == got[j]) == (find(i) == find(j)) for i in range(n) for j in range(n))


def exact_components(texts):
    hashes = near_dedup.WordHashes()
    sets = {d: near_dedup.shingle_set((t or "").encode(), 4, hashes) for d, t in texts}
    full = [d for d in sorted(sets) if len(sets[d])]
    comp = near_dedup.family_components([sets[d] for d in full], 80)
    least = {}
    for d, c in zip(full, comp.tolist()):
        least.setdefault(c, d)
    return {d: d for d in sets} | {d: least[c] for d, c in zip(full, comp.tolist())}


@pytest.mark.parametrize("part", [near_dedup.PART, 5])
def test_op8_loses_no_link_of_a_thousand_documents(spark, monkeypatch, part):
    monkeypatch.setattr(near_dedup, "PART", part)
    sf = "/root/testdata/sf0.01"
    want = exact_components([(r.doc_id, r.text) for r in common.table(spark, sf, "documents").collect()])
    got = {r.doc_id: r.component_id for r in near_dedup.op8_near_dedup(spark, sf).collect()}
    assert got == want and sum(d != c for d, c in want.items()) > 50


def test_op8_boilerplate_makes_few_ties():
    rng = np.random.default_rng(9)
    shared = rng.integers(0, 1 << 62, 100).astype(np.uint64)
    n = 400
    sets = [np.unique(np.concatenate([shared, rng.integers(0, 1 << 62, 117).astype(np.uint64)])) for _ in range(n)]  # similarity 0.3
    h = near_dedup.half_keys(sets, near_dedup.TABLES)
    met = [(h[:, None, i] == h[None, :, i]) for i in range(h.shape[1])]
    both = np.any(met[: near_dedup.TABLES], axis=0) & np.any(met[near_dedup.TABLES :], axis=0)
    share = (both.sum() - n) / (n * (n - 1))
    assert share < 0.2


def test_op8_rows_that_share_an_id_are_one_node(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    df = spark.createDataFrame([(5, a), (5, b), (3, a), (4, b), (9, c)], "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in near_dedup.near_duplicates(df).collect()}
    assert got == {(5, 3), (3, 3), (4, 3), (9, 9)}


# ---- op9 ------------------------------------------------------------------------------------


def edit_search(p, t):
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        new = [i]
        for j, d in enumerate(t, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    best = min(row)
    return best, row.index(best)


def test_op9_myers_is_the_edit_distance():
    rng = random.Random(7)
    for _ in range(200):
        p = "".join(rng.choice("abc ") for _ in range(rng.randrange(1, 90)))
        t = "".join(rng.choice("abc ") for _ in range(rng.randrange(0, 120)))
        got, want = decontaminate.myers(p, t), edit_search(p, t)
        assert got[0] == want[0] and (got[0] == len(p) or got[1] == want[1])


def test_op9_misses_nothing_within_the_budget(spark):
    rng = random.Random(8)
    item = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(25))
    items = [(i, item()) for i in range(6)] + [(90, None), (91, ""), (92, "short")]
    docs = []
    for d in range(60):
        t = list(rng.choice(items[:6])[1])
        for _ in range(rng.randrange(0, 12)):
            at = rng.randrange(len(t))
            t[at : at + rng.randrange(2)] = rng.choice(["", "x", "yz"])
        docs.append((d, f"{item()}  {''.join(t).upper()}\n{item()}"))
    df = spark.createDataFrame([*docs, (100, None), (101, ""), (102, "a (Short) one"), (103, "shorter, ashort")], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {(102, 92, 0)}
    for d, t in docs:
        for i, x in items[:6]:
            n = decontaminate.normalise(x)
            got, _ = edit_search(n, decontaminate.normalise(t))
            if got <= len(n) * decontaminate.RATE_PERCENT // 100:
                want.add((d, i, got))
    for block in (decontaminate.BLOCK_CHARS, 200):  # one pass, or several
        rows = decontaminate.match_benchmark(df, bench, block_chars=block).collect()
        assert {(r.doc_id, r.item_id, r.distance) for r in rows} == want
        text = {d: decontaminate.normalise(t) for d, t in [*docs, (102, "a (short) one")]}
        for r in rows:
            assert edit_search(decontaminate.normalise(dict(items)[r.item_id]), text[r.doc_id][r.start : r.end])[0] == r.distance
    left = {r.doc_id for r in decontaminate.decontaminate(df, bench).collect()}
    assert left == {d for d, _ in docs} - {d for d, _, _ in want} | {100, 101, 103}


def test_op9_odd_rows(spark, odd, none):
    bench = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog")], "item_id long, text string")
    assert {r.doc_id for r in decontaminate.match_benchmark(odd, bench).collect()} == {1, 6}
    left = decontaminate.decontaminate(odd, bench)
    assert left.columns == odd.columns and left.count() == odd.count() - 2
    assert decontaminate.match_benchmark(none, bench).collect() == []
    empty = bench.limit(0)
    assert decontaminate.match_benchmark(odd, empty).collect() == [] and decontaminate.decontaminate(odd, empty).count() == odd.count()


# ---- pipeline -------------------------------------------------------------------------------


def test_pipeline_stages(spark, sf, odd, none):
    import corpus_pipeline as p

    docs = common.table(spark, sf, "documents")
    for name, stage in p.STAGES[:-1]:
        before = docs.count()
        docs = common.written(stage(spark, docs, sf), f"test-{name}")
        assert docs.columns == common.table(spark, sf, "documents").columns
        assert 0 < docs.count() <= before
        if name == "mixing":
            assert docs.count() == before
    ids = sorted(r.doc_id for r in docs.collect())
    stored = sorted(d for r in p.STAGES[-1][1](spark, docs, sf).collect() for d in r.doc_ids)
    assert stored == ids
    for table in (odd, none):
        for _, stage in p.STAGES:
            stage(spark, table, sf).count()


def least_edits(p, t):
    """edit_search's distance, a row of the table at a time."""
    text, steps = np.frombuffer(t.encode("utf-32-le"), np.uint32), np.arange(len(t) + 1)
    row = np.zeros(len(t) + 1, np.int64)
    for i, c in enumerate(p, 1):
        new = np.minimum(row + 1, np.append(i, row[:-1] + (text != ord(c))))
        row = np.minimum.accumulate(new - steps) + steps
    return row.min()


def test_pipeline_equals_brute_force(spark, sf, encode):
    import duckdb

    import corpus_pipeline as p
    from verdigris.llm import quality_rules

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    kept = {d for d, k in con.sql(quality_rules.OP7_SQL).select("doc_id, kept").fetchall() if k}
    texts = {r.doc_id: r.text for r in common.table(spark, sf, "documents").collect() if r.doc_id in kept}
    groups = brute_components(sorted(texts.items()), 5, 80)
    texts = {d: t for d, t in texts.items() if groups[d][1] == d}
    items = [decontaminate.normalise(r.text) for r in common.table(spark, sf, "benchmark").collect()]
    assert all(len(x) >= decontaminate.MIN_CHARS for x in items)
    clean = {d: t for d, t in texts.items() if not any(least_edits(x, decontaminate.normalise(t)) <= len(x) * decontaminate.RATE_PERCENT // 100 for x in items)}
    assert len(kept) > len(texts) > len(clean) > 50
    rows = p.run(spark, sf).collect()
    assert sorted(d for r in rows for d in r.doc_ids) == sorted(clean)
    assert sum(r.n_tokens for r in rows) == sum(len(encode(t)) + 1 for t in clean.values())


def test_pipeline_shards_have_the_target_proportions(spark, sf):
    import corpus_pipeline as p

    # 5/8 of the rows are hot, 0.427 by weight; a document fills a sequence or so, and no source runs out in the first window
    kind = lambda i: "hot" if i % 8 < 5 else f"s{i % 8}"
    df = spark.range(8000).selectExpr("id AS doc_id", "repeat('word ', 1020) AS text", "CASE WHEN id % 8 < 5 THEN 'hot' ELSE concat('s', id % 8) END AS source")
    weight = 5**0.5 / (5**0.5 + 3)
    got = {r.shard: r.doc_ids for r in p.shards(spark, df, sf).select("shard", "doc_ids").collect()}
    assert sorted(d for ids in got.values() for d in ids) == list(range(8000))
    for s in range(8):
        assert abs(sum(kind(d) == "hot" for d in got[s]) / len(got[s]) - weight) < 0.08
    # the windows together are a permutation of what was packed
    assert got[0] != sorted(got[0])


def test_components_of_hubs_chains_and_random_edges(spark):
    from verdigris.llm.components import components

    rng = random.Random(12)
    edges = [(5, i) for i in range(1000, 4000)] + [(i, i + 1) for i in range(10_000, 10_060)] + [(rng.randrange(20_000, 20_400), rng.randrange(20_000, 20_400)) for _ in range(260)]
    edges += [(4000 + i, 5000) for i in range(900)] + [(7, 7)]
    par = {x: x for e in edges for x in e}

    def find(x):
        while par[x] != x:
            par[x] = par[par[x]]
            x = par[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        par[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}


def test_op5_trees_and_scores_equal_plain_boosting(spark, sf):
    """The trees of the query's model, grown again by loops over its binned rows."""
    pages = common.table(spark, sf, "pages").select("page_id", "url")
    scored = url_filter.filter_urls(pages)
    labelled = scored.where("rule is not null").select("url", F.element_at(F.create_map(*[F.lit(x) for v, r in url_filter.RULES for x in (r, 1.0 if v == "block" else 0.0)]), F.col("rule")).alias("label"))
    model = url_filter.train(labelled)
    distinct = labelled.select(F.coalesce("url", F.lit("")).alias("url"), F.col("label").alias("y")).groupBy("url", "y").agg(F.count("*").alias("w"))
    feats = model.features(F.col("url"))
    rows = distinct.select("url", "y", "w", *[feats[n].alias(n) for n in model.names]).select("y", "w", *model.binned({n: F.col(n) for n in model.names})).collect()
    data = [([r[f"f{i}"] for i in range(len(model.names))], r["y"], r["w"]) for r in rows]
    margins = [model.prior] * len(data)
    assert len(model.trees) == 10
    for splits, leaves in model.trees:
        grads = [(w * (y - 1 / (1 + math.exp(-m))), w * (1 / (1 + math.exp(-m))) * (1 - 1 / (1 + math.exp(-m)))) for (_, y, w), m in zip(data, margins)]
        at = [0] * len(data)
        for _ in range(3):
            for leaf in sorted(set(at)):
                here = [i for i, a in enumerate(at) if a == leaf]
                G, H = sum(grads[i][0] for i in here), sum(grads[i][1] for i in here)

                def gain(f, cut, least=0.0):
                    g, h = (sum(grads[i][k] for i in here if data[i][0][f] <= cut) for k in (0, 1))
                    return g * g / (h + 1) + (G - g) ** 2 / (H - h + 1) - G * G / (H + 1) if min(h, H - h) >= least else -1.0

                every = [gain(f, cut, 0.5 + 1e-4) for f in range(len(model.names)) for cut in sorted({data[i][0][f] for i in here})[:-1]]
                if leaf in splits:  # the split taken is the best one, up to the rounding of its sums
                    assert gain(*splits[leaf]) >= max(every) - 1e-3
                    f, cut = splits[leaf]
                    for i in here:
                        at[i] = 2 * leaf + (1 if data[i][0][f] <= cut else 2)
                else:
                    assert all(x <= 1e-3 for x in every)
                assert leaf in splits or leaves[leaf] == pytest.approx(0.3 * G / (H + 1), abs=1e-4)
        for leaf in set(at):
            here = [i for i, a in enumerate(at) if a == leaf]
            assert leaves[leaf] == pytest.approx(0.3 * sum(grads[i][0] for i in here) / (sum(grads[i][1] for i in here) + 1), abs=1e-4)
        margins = [m + leaves[a] for m, a in zip(margins, at)]
    by_bins = {tuple(b): 1 / (1 + math.exp(-m)) for (b, _, _), m in zip(data, margins)}
    got = scored.select(F.coalesce("url", F.lit("")).alias("url"), "block_score").distinct()
    got = got.select("block_score", "url", *[model.features(F.col("url"))[n].alias(n) for n in model.names]).select("block_score", *model.binned({n: F.col(n) for n in model.names})).collect()
    known = [(r["block_score"], by_bins[k]) for r in got if (k := tuple(r[f"f{i}"] for i in range(len(model.names)))) in by_bins]
    assert len(known) >= 20 and all(a == pytest.approx(b, abs=1e-6) for a, b in known)
