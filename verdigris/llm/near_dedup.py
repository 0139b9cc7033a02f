"""Near-duplicates by MinHash with tensored banding, candidates verified on full shingle sets.

A document is the set of its distinct k-word shingles (all words as one shingle where there are
fewer than k; the empty set without words, which links with nothing). Documents with equal sets form
one class and only its least id goes on.

Tensored banding: two collections of `tables` half-keys, each of three minhash values. A table (i, j) is
keyed by half-key i of the first collection and j of the second, so tables**2 tables cost
6 * tables minhash functions. At similarity 0.8 and 14 half-keys a pair shares none of the 196 tables
with probability 9e-5; at 0.3 it shares one with 0.10, at 0.2 with 0.01.

Tables are not expanded into pairs. Inside each, everyone is tied to one hub (the member closest to the
bucket's commonest half-keys; large buckets are dealt into parts, and one member a part ties them); what hangs together so is a family, and every pair that shares a table
lies in one. A family's full sets meet in one task, which verifies on an inverted index: first a central
document against all, then each document outside the family's largest component against all. Pairs
inside one component, whose links change nothing, are skipped; no link between components is lost, and
only a family's components leave the task. Families of more than PART documents or PART_SHINGLES
shingles are dealt into parts: their commonest hub is compared with all, row by row; those linked to it form one
component, and each part of the others meets each part of the family in a task of its own.

Keys are integers. Null and empty texts form components of their own; equal rows fall in one class; rows that
share an id are one node. Empty tables give empty results. Extra columns are ignored by `near_duplicates` and
passed on by `deduplicate`.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .components import components

TABLES = 14
#: Minhash values of a half-key.
ROWS = 3
#: A bucket or family of more members is worked on in parts of about this size.
PART = 4096
PART_SHINGLES = 4_000_000
#: Ids broadcast to pick the candidates' texts; beyond it, a shuffled semi-join.
BROADCAST_IDS = 1_000_000
CACHE_WORDS = 400_000


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    def __missing__(self, w: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = self[w] = xxhash.xxh3_64_intdigest(w)
        return h


def shingle_set(text: bytes | None, k: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < k:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=1)], np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = len(words) - k + 1
    s = np.zeros(n, np.uint64)
    for i in range(k):
        s = s * np.uint64(0x9E3779B97F4A7C15) + mixed(h[i : i + n] + np.uint64(i))
    return np.unique(mixed(s))


def half_keys(sets: list[np.ndarray], tables: int) -> np.ndarray:
    """[set, 2 * tables] half-keys: a hash of ROWS 32-bit minhash values each. All sets are non-empty."""
    rng = np.random.default_rng(20_24)
    a = rng.integers(0, 1 << 63, 2 * ROWS * tables, np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 63, 2 * ROWS * tables, np.uint64)
    flat = np.concatenate(sets)
    at = np.cumsum([0, *map(len, sets)])[:-1]
    out = np.zeros((len(sets), 2 * tables), np.uint64)
    for i in range(2 * ROWS * tables):
        least = np.minimum.reduceat((flat * a[i] + b[i]) >> np.uint64(32), at)
        out[:, i // ROWS] = mixed(out[:, i // ROWS] * np.uint64(0x9E3779B97F4A7C15) + least)
    return out.astype(np.int64)


def signatures(docs: DataFrame, text: str, key: str, k: int, tables: int) -> DataFrame:
    """(id, n, set_hash, halves) of every document."""

    def make():
        hashes = WordHashes()

        def step(c):
            import pyarrow as pa

            sets = [shingle_set(t, k, hashes) for t in c["t"].cast(pa.binary()).to_pylist()]
            halves: list = [None] * len(sets)
            full = [i for i, s in enumerate(sets) if len(s)]
            for a in range(0, len(full), 100):
                for i, row in zip(full[a : a + 100], half_keys([sets[i] for i in full[a : a + 100]], tables)):
                    halves[i] = row
            return {"id": c["id"], "n": [len(s) for s in sets], "set_hash": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets], "halves": halves}

        return step

    return common.map_rows(docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t")), make, "id long, n long, set_hash binary, halves array<bigint>")


def shingle_sets(docs: DataFrame, ids: DataFrame, n_ids: int, text: str, key: str, k: int) -> DataFrame:
    """(id, shingles) of the documents named by ids."""
    if n_ids <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    picked = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t")).join(ids, "id", "left_semi")

    def make():
        hashes = WordHashes()

        def step(c):
            import pyarrow as pa

            return {"id": c["id"], "shingles": [shingle_set(t, k, hashes).view(np.int64) for t in c["t"].cast(pa.binary()).to_pylist()]}

        return step

    return common.map_rows(picked, make, "id long, shingles array<bigint>")


def hub_pairs(ids: np.ndarray, h: np.ndarray, tables: int) -> np.ndarray:
    """[2, pairs]: members and hubs inside one bucket of a first half-key; the second half-keys split it into tables."""
    agree = np.zeros(len(ids), np.int64)
    for c in range(h.shape[1]):
        _, inverse, count = np.unique(h[:, c], return_inverse=True, return_counts=True)
        agree += inverse.ravel() == count.argmax()
    order = np.lexsort((ids, -agree))  # the closest to the commonest half-keys first
    out = []
    for j in range(tables):
        _, first, inverse = np.unique(h[order, tables + j], return_index=True, return_inverse=True)
        hub = order[first[inverse.ravel()]]
        use = hub != order
        out.append(np.stack([order[use], hub[use]]))
    return ids[np.unique(np.concatenate(out, axis=1), axis=1)]


def hub_edges(buckets: DataFrame, keys: list[str], tables: int) -> DataFrame:
    """(u, v) of every bucket: rows come sorted by bucket, and many small buckets are worked on at once."""
    spark = buckets.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        import pyarrow as pa

        held = None
        for b in _and_end(batches):
            if b is not None:
                held = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])]).combine_chunks()
            if held is None or not len(held):
                continue
            k = np.stack([held[c].to_numpy() for c in keys])
            change = np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1
            upto = len(held) if b is None else (int(change[-1]) if len(change) else 0)  # the last bucket may go on
            bounds = np.concatenate([[0], change[change < upto], [upto]]) if upto else np.zeros(1, np.int64)
            ids = held["id"].to_numpy()
            h = held["halves"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), 2 * tables)
            size = np.diff(bounds)
            two = bounds[:-1][size == 2]
            two = two[(h[two, tables:] == h[two + 1, tables:]).any(axis=1)]  # some table holds both
            found = [np.stack([ids[two], ids[two + 1]])] + [hub_pairs(ids[a : a + m], h[a : a + m], tables) for a, m in zip(bounds[:-1], size) if m > 2]
            pairs = np.concatenate(found, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0], pa.int64()), pa.array(pairs[1], pa.int64())], names=["u", "v"])
            held = held.slice(upto).combine_chunks()

    dealt = buckets.select(*keys, "id", "halves").repartition(n, *keys).sortWithinPartitions(*keys, "id")
    return dealt.mapInArrow(run, "u bigint, v bigint")


def across_parts(split: DataFrame, tables: int) -> DataFrame:
    """(u, v) that tie the parts of buckets: of every table, one member a part, lone ones included, to the least of all parts."""
    second = F.posexplode(F.slice("halves", tables + 1, tables)).alias("table", "second")
    one = split.select("pos", "value", "part", "id", second).groupBy("pos", "value", "table", "second", "part").agg(F.min("id").alias("u"))
    least = F.min("u").over(Window.partitionBy("pos", "value", "table", "second"))  # a row per part
    return one.select("u", least.alias("v")).where("u <> v")


def _and_end(batches):
    yield from batches
    yield None


def family_components(sets: list[np.ndarray], percent: int, core: np.ndarray | None = None) -> np.ndarray:
    """A component number per set: sets of at least that Jaccard similarity are linked, exactly. Those of core are in one already."""
    n = len(sets)
    sizes = np.array(list(map(len, sets)), np.int64)
    owner = np.repeat(np.arange(n), sizes)
    flat, shingle = np.unique(np.concatenate(sets), return_inverse=True)
    shingle = shingle.ravel()
    posting = owner[np.argsort(shingle, kind="stable")]
    count = np.bincount(shingle, minlength=len(flat))
    start = np.cumsum(count) - count
    begin = np.cumsum(sizes) - sizes
    comp = np.arange(n)
    members = {i: [i] for i in range(n)}
    if core is not None and core.any():
        one = np.flatnonzero(core).tolist()
        comp[one] = one[0]
        members = {i: [i] for i in range(n) if not core[i]} | {one[0]: one}

    def visit(i: int) -> None:
        """Merges the components of all that i is linked with."""
        c = shingle[begin[i] : begin[i] + sizes[i]]
        c = c[count[c] > 1]
        if not len(c):
            return
        k = count[c]
        at = np.repeat(start[c] - (np.cumsum(k) - k), k) + np.arange(k.sum())
        both = np.bincount(posting[at], minlength=n)
        for other in np.unique(comp[100 * both >= percent * (sizes + sizes[i] - both)]):
            a, b = comp[i], other
            if a != b and b in members:
                if len(members[a]) < len(members[b]):
                    a, b = b, a
                comp[members[b]] = a
                members[a] += members.pop(b)

    weight = np.bincount(owner, count[shingle], minlength=n) / np.maximum(sizes, 1)
    order = np.argsort(-weight, kind="stable").tolist()
    visit(order[0])  # the most central
    todo = order[1:]
    while todo:
        # whoever is outside the largest component is compared with all; the rest wait, should another become the largest
        largest, wait = max(members, key=lambda c: len(members[c])), []
        for i in todo:
            if comp[i] == largest:
                wait.append(i)
                continue
            visit(i)
            if comp[i] != largest and len(members[comp[i]]) >= len(members.get(largest, ())):
                largest = comp[i]
        largest = max(members, key=lambda c: len(members[c]))
        todo = [i for i in wait if comp[i] != largest]
    return comp


def link_family(group, percent: int):
    """(u, v): each document of a family (or of two parts of one) and the least id of its component there."""
    import pyarrow as pa

    ids = group["id"].to_numpy()
    flat = group["shingles"].combine_chunks()
    values, off = flat.values.to_numpy(zero_copy_only=False), flat.offsets.to_numpy()
    core = group["core"].to_numpy()
    comp = family_components([values[a:b] for a, b in zip(off, off[1:])], percent, core)
    least: dict[int, int] = {}
    for i, c in zip(ids.tolist(), comp.tolist()):
        least[c] = min(least.get(c, i), i)
    v = np.array([least[c] for c in comp.tolist()], np.int64)
    use = ids != v
    return pa.table({"u": pa.array(ids[use], pa.int64()), "v": pa.array(v[use], pa.int64())})


def by_center(docs: DataFrame, big: DataFrame, n_big: int, stars: DataFrame, text: str, key: str, k: int, percent: int) -> DataFrame:
    """(family, id, mine, parts, center, linked) of the members of families in parts: the family's commonest hub, and whether it is linked with it."""
    hubs = stars.groupBy(F.col("v").alias("id")).agg(F.count("*").alias("tied"))
    center = big.join(hubs, "id", "left").groupBy("family", "parts").agg(F.max_by("id", F.struct(F.coalesce("tied", F.lit(0)), -F.col("id"))).alias("center"))
    of_center = shingle_sets(docs, center.select(F.col("center").alias("id")), n_big, text, key, k).withColumnRenamed("shingles", "central").dropDuplicates(["id"])
    # a copy for each part, so that a family's rows need not meet in one task
    copies = center.join(of_center, center["center"] == of_center["id"]).select("family", "center", "central", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("mine"))
    sets = shingle_sets(docs, big.select("id"), n_big, text, key, k).join(big, "id")
    both = F.size(F.array_intersect("shingles", "central"))
    linked = 100 * both >= percent * (F.size("shingles") + F.size("central") - both)
    return sets.join(copies, ["family", "mine"]).select("family", "id", "mine", "parts", "center", linked.alias("linked"))


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", k: int = 5, percent: int = 80, tables: int = TABLES) -> DataFrame:
    """One row per row of docs: key, n_shingles, class_id (least id with the same set), component_id, kept."""
    if docs.schema[key].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError("near-duplicates need a key column of integers")
    sig = common.written(signatures(docs, text, key, k, tables), "signatures")
    full = sig.where("n > 0")
    classes = full.groupBy("set_hash", "n").agg(F.min("id").alias("class_id"), F.count("*").alias("size"))
    classes = common.written(classes, "classes")
    # classes of over a thousandth of all rows, of which there are under a thousand, are broadcast: their rows meet nowhere
    rows = classes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    large = F.broadcast(classes.where(F.col("size") * 1000 > rows).select("set_hash", "n", F.col("class_id").alias("large_id")))
    small = classes.where((F.col("size") > 1) & (F.col("size") * 1000 <= rows)).select("set_hash", "n", "class_id")
    named = sig.select("id", "n", "set_hash").join(large, ["set_hash", "n"], "left")
    member = named.where("large_id IS NULL").drop("large_id").join(small, ["set_hash", "n"], "left").unionByName(named.where("large_id IS NOT NULL").withColumnRenamed("large_id", "class_id"))
    member = member.select("id", "n", F.coalesce("class_id", "id").alias("class_id"))
    reps = full.groupBy("set_hash", "n").agg(F.min_by(F.struct("id", "halves"), "id").alias("r")).select("r.id", "n", "r.halves")

    # half-keys that two or more classes share; a document needs one of each collection
    reps = common.written(reps, "representatives")
    half = reps.select("id", F.posexplode("halves").alias("pos", "value"))
    shared = half.groupBy("pos", "value").agg(F.count("*").alias("size")).where("size > 1")
    met = half.join(shared, ["pos", "value"])
    able = met.groupBy("id").agg(F.bool_or(F.col("pos") < tables).alias("a"), F.bool_or(F.col("pos") >= tables).alias("b")).where("a and b").select("id")
    buckets = (
        met.where(F.col("pos") < tables)
        .join(able, "id")
        .join(reps, "id")
        .withColumn("part", F.pmod(F.xxhash64("id"), F.ceil(F.col("size") / PART)))
    )
    buckets = common.written(buckets.select("pos", "value", "size", "part", "id", "halves"), "buckets")
    # rows that share an id but not a text: their classes are one node
    own = member.where("n > 0").select("id", "class_id").distinct()
    shared_ids = own.groupBy("id").agg(F.min("class_id").alias("v"), F.count("*").alias("c")).where("c > 1")
    same_id = own.join(shared_ids, "id").select(F.col("class_id").alias("u"), "v").where("u <> v")
    ids = buckets.select("id").distinct()
    n_ids = ids.count()
    if not n_ids:
        return finish(member, components(same_id), key)
    # families: what hangs together by hubs
    stars = common.written(hub_edges(buckets, ["pos", "value", "part"], tables).distinct(), "stars")
    family = components(stars.unionByName(across_parts(buckets.where(F.col("size") > PART), tables))).withColumnsRenamed({"node": "id", "component": "family"})
    family = family.join(reps.select("id", "n"), "id")
    sizes = family.groupBy("family").agg(F.ceil(F.greatest(F.count("*") / PART, F.sum("n") / PART_SHINGLES)).cast("int").alias("parts"))
    member_of = family.join(sizes, "family").withColumn("mine", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    member_of = common.written(member_of.select("family", "id", "mine", "parts"), "families")
    task = lambda a, b: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"))
    roles = member_of.where("parts = 1").select("family", "id", F.lit(False).alias("core"), F.array(task(F.lit(0), F.lit(0))).alias("tasks"))
    links, stored = same_id, [reps, buckets, stars, member_of]
    big = member_of.where("parts > 1")
    if n_big := big.count():
        # families in parts: who is not linked with the center, by parts, meets all parts
        judged = common.written(by_center(docs, big, n_big, stars, text, key, k, percent), "judged")
        stored.append(judged)
        others = judged.where(~F.col("linked")).groupBy("family").agg(F.ceil(F.count("*") / PART).cast("int").alias("rest"))
        every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
        own = F.transform(every("rest"), lambda a: task(a, F.col("mine")))
        all_parts = F.transform(every("parts"), lambda b: task(F.pmod(F.xxhash64("id"), F.col("rest")), b))
        meets = F.when(F.col("linked"), own).otherwise(F.array_union(own, all_parts))
        roles = roles.unionByName(judged.join(others, "family").select("family", "id", F.col("linked").alias("core"), meets.alias("tasks")))
        links = links.unionByName(judged.where("linked AND id <> center").select(F.col("id").alias("u"), F.col("center").alias("v")))
    sets = shingle_sets(docs, member_of.select("id"), n_ids, text, key, k).join(roles, "id")
    dealt = sets.select("family", "id", "core", "shingles", F.explode("tasks").alias("task")).select("family", "task.a", "task.b", "id", "core", "shingles")
    found = dealt.groupBy("family", "a", "b").applyInArrow(lambda g: link_family(g, percent), "u bigint, v bigint")
    labels = components(links.unionByName(found))
    for table in stored:
        common.drop_written(table)
    return finish(member, labels, key)


def finish(member: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    out = member.join(labels.withColumnRenamed("node", "class_id"), "class_id", "left").withColumn("component", F.coalesce("component", "class_id"))
    return out.select(
        F.col("id").alias(key), F.col("n").alias("n_shingles"), "class_id", F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept")
    )


def deduplicate(docs: DataFrame, text: str = "text", key: str = "doc_id", k: int = 5, percent: int = 80, tables: int = TABLES) -> DataFrame:
    """docs without the documents whose component has a lesser id, and without repeated rows of one id and text; null ids stay."""
    drop = near_duplicates(docs, text, key, k, percent, tables).where(~F.col("kept")).select(F.col(key).alias("id_")).distinct()
    rows = docs.select(F.col(key).alias("id_"), F.xxhash64(text).alias("text_"), F.struct(*docs.columns).alias("row_"))
    left = rows.join(drop, "id_", "left_anti").withColumn("salt_", F.when(F.col("id_").isNull(), F.monotonically_increasing_id()))
    w = Window.partitionBy("id_", "salt_", "text_").orderBy("text_")
    return left.withColumn("rank_", F.row_number().over(w)).where("rank_ = 1").select("row_.*")


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"), k=4).select("doc_id", "n_shingles", "component_id", "kept")


#: The same by comparing all pairs of classes that share a shingle.
OP8_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i : i + 3], ' ')) END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
sets AS (SELECT doc_id, md5(string_agg(sh, chr(10) ORDER BY sh)) AS m FROM s GROUP BY doc_id),
class AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY m) AS class_id FROM sets),
one AS (SELECT s.doc_id, sh FROM s JOIN class c ON c.doc_id = s.doc_id AND c.class_id = c.doc_id),
r AS (SELECT sh, list(doc_id) AS docs FROM one GROUP BY sh HAVING count(*) > 1),
pairs AS (SELECT a, unnest(list_filter(docs, lambda b: b > a)) AS b FROM (SELECT docs, unnest(docs) AS a FROM r)),
shared AS (SELECT a, b, count(*) AS c FROM pairs GROUP BY a, b),
link AS MATERIALIZED (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
edge AS MATERIALIZED (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT a AS v, a AS u FROM edge UNION SELECT reach.v, edge.b FROM reach JOIN edge ON edge.a = reach.u),
comp AS (SELECT v, min(u) AS component_id FROM reach GROUP BY v)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(comp.component_id, class.class_id, d.doc_id) AS component_id, coalesce(comp.component_id, class.class_id, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN class ON class.doc_id = d.doc_id LEFT JOIN comp ON comp.v = class.class_id
"""
