"""SimHash near-dedup with covering locality-sensitive hashing.

Nulls and empty texts have fingerprint zero and link like any other; repeated rows and ties fall in one class. The pipeline's
near copies are the SimHash classes, held to a Jaccard similarity on whole texts, and the copies that fingerprints leave apart.
"""
from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from lodestone.llm.common import chunked, components, materialise, numbered, trim

RADIUS, CHUNK = 3, 4096
# Near copies: odd multiplier, words a shingle, least similarity, shingles to meet at, centres tried
MIX = np.uint64(0x9E3779B97F4A7C15)
SHINGLE, SIMILAR, SHARED, STARS = 5, 0.8, 4, 3
# Common shingles: one row in SAMPLE is counted, OFTEN times or more there, MOST at most
SAMPLE, OFTEN, MOST = 16, 8, 100_000
# Most row keys that are broadcast to choose texts; beyond that the texts are shuffled to the keys
SENT = 1_000_000


def fingerprint_of(text: str | None, shingle: int = 3) -> int:
    """Signed 64-bit SimHash of the whole text; bytes.lower and bytes.split touch ASCII only."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return 0
    buf = b" ".join(words)
    if n < shingle:
        at = [(0, len(buf))]
    else:
        lens = np.fromiter(map(len, words), np.int64, n)
        ends = np.cumsum(lens + 1) - 1
        at = list(zip((ends - lens)[: n - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True))
    ones = np.zeros(64, np.int64)
    for k in range(0, len(at), 65536):
        h = np.array([xxhash.xxh64_intdigest(buf[a:b], 42) for a, b in at[k : k + 65536]], dtype="<u8")
        lanes = np.unpackbits(h.view(np.uint8), bitorder="little").view(np.uint64).reshape(-1, 8)
        ones += np.add.reduceat(lanes, np.arange(0, len(h), 255), axis=0).view(np.uint8).reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(at), bitorder="little").view("<i8")[0])


def masks(radius: int = RADIUS) -> list[int]:
    """2^(radius+1)-1 masks: bit i is kept in mask v if <m(i), v> is odd, so any radius positions are clear in one."""
    m = [1 + i % (2 ** (radius + 1) - 1) for i in range(64)]
    return [sum(1 << i for i in range(64) if bin(m[i] & v).count("1") % 2) for v in range(1, 2 ** (radius + 1))]


def _link(pdf: pd.DataFrame, radius: int) -> pd.DataFrame:
    """Breadth-first search in one bucket; a row per fingerprint, not per pair."""
    f = np.unique(pdf["fp"].to_numpy(np.int64))
    u, left, out = f.view(np.uint64), np.arange(len(f)), []
    while len(left):
        queue, left, root = [left[0]], left[1:], f[left[0]]
        while queue and len(left):
            near = np.bitwise_count(u[left] ^ u[queue.pop()]) <= radius
            queue += (got := left[near]).tolist()
            out += [(f[i], root) for i in got]
            left = left[~near]
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def simhash_classes(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """docs plus fp (signed long) and component_id; every pair of fingerprints within the radius is linked."""
    @F.pandas_udf("long")
    def fp(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in it:
            yield s.map(fingerprint_of).astype("int64") if len(s) else pd.Series([], dtype="int64")
            trim()

    ids = materialise(docs.select("doc_id", fp(F.coalesce("text", F.lit(""))).alias("fp")), "simhash")
    reps = ids.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    signed = [m - (1 << 64) if m >> 63 else m for m in masks(radius)]
    keyed = reps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in signed])).alias("tab", "key"))
    keys = ["tab", "key"]
    edges = chunked(keyed, keys, "fp", CHUNK).groupBy(*keys, "ci", "cj").applyInPandas(lambda p: _link(p, radius), "a long, b long")
    comp = components(edges)
    rooted = reps.join(comp, reps.fp == comp.node, "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    low = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    return ids.join(rooted.join(low, "root").select("fp", "component_id"), "fp")


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * MIX  # wraps, as meant
    return (h ^ (h >> np.uint64(32))) * MIX


def shingles_of(text: str | None) -> np.ndarray:
    """Sorted hashes of the whole text's distinct five-word shingles (one of all words, where they are fewer)."""
    from xxhash import xxh3_64_digest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.frombuffer(b"".join(map(xxh3_64_digest, words)), "<u8")
    width = min(SHINGLE, len(h))
    mixed = np.zeros(len(h) - width + 1, np.uint64)
    for i in range(width):
        mixed = _mix(mixed) + h[i : len(h) - width + 1 + i]
    return np.unique(_mix(mixed))


def needed(n: int, least: float) -> int:
    """Shingles that a text of n must share with any text as similar as `least`."""
    return ceil(least * n - 1e-9)


def heads_of(grams: np.ndarray, common: np.ndarray, least: float, shared: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Shingles to meet at, their kinds, the number of rare shingles, and a hash of the set of common ones.

    The order for all texts: rare shingles by hash, then the `common`. Two texts as similar as `least` hold their first
    min(shared, needed) common shingles among the first n - needed + shared of both. Kind 0 are the rare ones of these, kind 1
    the common ones, and kind 2 is the set's hash; the last two only where the common ones alone can reach `least`.
    """
    n, often = len(grams), np.isin(grams, common, assume_unique=True)
    rare, rest, need = grams[~often], grams[often], needed(n, least)
    size = n - need + min(shared, need)
    if len(rest) < need:
        return rare[:size], np.zeros(min(size, len(rare)), np.int8), len(rare), 0
    from xxhash import xxh3_64_intdigest

    whole = np.array([xxh3_64_intdigest(rest.astype("<u8").tobytes())], np.uint64)
    ends = rest[: size - len(rare)]
    return np.concatenate([rare, ends, whole]), np.repeat(np.arange(3, dtype=np.int8), [len(rare), len(ends), 1]), len(rare), int(whole.view(np.int64)[0])


def _sets(docs: DataFrame) -> DataFrame:
    """row, doc_id, n, digest of the shingle set of each row of docs (row, doc_id, text)."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for b in it:
            n, digests = [], []
            for t in b.column(2):
                g = shingles_of(t.as_py())
                n.append(len(g))
                digests.append(xxh3_128_digest(g.astype("<u8").tobytes()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int32()), pa.array(digests, pa.binary())], ["row", "doc_id", "n", "digest"])
            trim()

    return docs.select("row", F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "row long, doc_id long, n int, digest binary")


def _exploded(texts: DataFrame, take) -> DataFrame:
    """take(shingles) = (h, kind, r, g) of each row of texts (row, text), one hash a row, with the row and its number of shingles n."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                grams = [shingles_of(t.as_py()) for t in part.column(1)]
                heads = [take(g) for g in grams]
                many = np.array([len(x[0]) for x in heads])
                h = np.concatenate([*(x[0] for x in heads), np.zeros(0, np.uint64)]).astype("<u8").view("<i8")
                kind = np.concatenate([*(x[1] for x in heads), np.zeros(0, np.int8)])
                n, r = (np.repeat(np.array(x, np.int32), many) for x in (list(map(len, grams)), [x[2] for x in heads]))
                g = np.where(kind == 1, np.repeat(np.array([x[3] for x in heads], np.int64), many), 0)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (h, kind, np.repeat(part.column(0).to_numpy(), many), n, r, g)], ["h", "kind", "row", "n", "r", "g"])
            trim()

    return texts.select("row", "text").mapInArrow(run, "h long, kind byte, row long, n int, r int, g long")


def _common(texts: DataFrame) -> np.ndarray:
    """Shingles often met in a sample, MOST at most; any choice gives the same links, a good one fewer candidates."""
    part = texts.where(F.pmod(F.xxhash64("row"), F.lit(SAMPLE)) == 0)
    often = _exploded(part, lambda g: (g, np.zeros(len(g), np.int8), 0, 0)).groupBy("h").agg(F.count("*").alias("k")).where(F.col("k") >= OFTEN)
    top = often.orderBy(F.desc("k"), "h").limit(MOST).select("h").toPandas()["h"]
    return np.sort(top.to_numpy(np.int64).view(np.uint64))


def _similar(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose whole shingle sets have a Jaccard similarity of `least`, as a table.

    Only the texts of pairs move; their sets, which compress badly, are made where the two meet.
    """
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}

        def grams(row: int, text) -> np.ndarray:
            if row not in held:
                if len(held) >= 256:
                    held.pop(next(iter(held)))
                held[row] = shingles_of(text.as_py())
            return held[row]

        for p in it:
            keep = []
            for a, b, ta, tb in zip(p.column(0).to_pylist(), p.column(1).to_pylist(), p.column(2), p.column(3), strict=True):
                x, y = grams(a, ta), grams(b, tb)
                at = np.searchsorted(x, y)
                at[at == len(x)] = 0
                both = np.count_nonzero(x[at] == y)
                keep.append(both >= least * (len(x) + len(y) - both) - 1e-9)
            yield p.select([0, 1]).filter(pa.array(keep, pa.bool_()))
            trim()

    pairs = materialise(pairs, "pairs")
    rows = pairs.select(F.explode(F.array("a", "b")).alias("row")).distinct()
    few = rows.limit(SENT + 1).count() <= SENT
    texts = texts.select("row", "text").join(F.broadcast(rows) if few else rows, "row", "left_semi")
    one, two = texts.select(F.col("row").alias("b"), F.col("text").alias("tb")), texts.select(F.col("row").alias("a"), F.col("text").alias("ta"))
    return materialise(pairs.join(one, "b").join(two, "a").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long"), "similar")


def _simhash_links(texts: DataFrame, least: float) -> DataFrame:
    """(a, b): rows of texts (row, text) with the smallest row of their SimHash class, where the whole sets are as similar as `least`."""
    found = simhash_classes(texts.select(F.col("row").alias("doc_id"), "text")).where("doc_id <> component_id")
    return _similar(found.select(F.col("doc_id").alias("a"), F.col("component_id").alias("b")), texts, least)


def _near_links(texts: DataFrame, least: float, shared: int) -> DataFrame:
    """(a, b) links that connect all pairs of rows of texts (row, text) with a similarity of `least`, and only such.

    First each row is held against the smallest row of its SimHash class. Fingerprints of pairs near `least` differ by more bits
    than the radius; a prefix filter finds those that the classes leave apart: every pair meets at min(shared, needed) shingles of
    both prefixes. Each row is held against the centres of its buckets, a few at most: the rows with the least share of rare
    shingles, as an original has among its copies. Then all pairs that these links leave apart and whose lengths and meetings
    allow the similarity.

    A rare shingle is in few texts, so its buckets are small. Pairs that meet at common shingles alone share no rare one, thus
    at most the smaller number of common ones: most pairs of large buckets end there, unread. Of rows with the same common
    shingles the centre has the fewest rare ones: a row that it does not reach is reached by no other of them in this way.
    """
    linked = _simhash_links(texts, least)
    common = _common(texts)
    keyed = _exploded(texts, lambda g: heads_of(g, common, least, shared))
    eps, need = F.lit(1e-9), lambda n: F.ceil(n * F.lit(least) - F.lit(1e-9))
    fits = lambda x, y: F.least(x, y) >= F.greatest(x, y) * F.lit(least) - eps
    w = W.partitionBy("kind", "h")
    met = keyed.withColumn("c", F.count("*").over(w)).withColumn("f", F.min(F.struct((F.col("r") / F.col("n")).alias("share"), "row", "n")).over(w)).where("c > 1")
    met = materialise(met.select("h", "kind", "row", "n", "r", "g", F.col("f.row").alias("b"), F.col("f.n").alias("m")), "buckets")
    centres = met.where((F.col("row") != F.col("b")) & fits("n", "m")).groupBy(F.col("row").alias("a"), "b").agg(F.count("*").alias("k"), F.max("kind").alias("kind"))
    first = centres.withColumn("_r", F.row_number().over(W.partitionBy("a").orderBy(F.desc("k"), "b"))).where((F.col("_r") <= STARS) | (F.col("kind") == 2))
    first = first.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    for end in ("a", "b"):  # linked is a star of each class: its `b` is the label of `a`, once
        first = first.join(linked.select(F.col("a").alias(end), F.col("b").alias(f"label_{end}")), end, "left")
    first = first.where(F.coalesce("label_a", "a") != F.coalesce("label_b", "b")).select("a", "b")
    known = materialise(components(linked.unionByName(_similar(first, texts, least))), "known")
    w = W.partitionBy("h")
    x = met.where("kind < 2").select("h", "kind", "row", "n", "r", "g").join(known.select(F.col("node").alias("row"), F.col("root").alias("label")), "row", "left").withColumn("label", F.coalesce("label", "row"))
    x = x.withColumn("lo", F.min("label").over(w)).withColumn("hi", F.max("label").over(w)).where("lo <> hi").drop("lo", "hi")
    y = x.select("h", F.col("row").alias("b"), F.col("n").alias("m"), F.col("r").alias("s"), F.col("g").alias("o"), F.col("label").alias("l"))
    overlap = (F.col("n") + F.col("m")) * F.lit(least / (1 + least)) - eps
    both = F.least(F.col("n") - F.col("r"), F.col("m") - F.col("s"))
    pairs = x.join(y, "h").where((F.col("row") > F.col("b")) & (F.col("label") != F.col("l")) & fits("n", "m") & ((F.col("kind") == 0) | ((F.col("g") != F.col("o")) & (both >= overlap))))
    numbers = [F.first(c).alias(c) for c in ("n", "m", "r", "s")]
    pairs = pairs.groupBy(F.col("row").alias("a"), "b").agg(F.count("*").alias("k"), F.count_if(F.col("kind") == 0).alias("k0"), *numbers)
    meet = F.least(F.lit(shared), need(F.least("n", "m")))
    ends = lambda n, r: F.col(r) < F.col(n) - need(F.col(n)) + F.least(F.lit(shared), need(F.col(n)))
    # all rare shingles of both are prefixes: common ones can add to k0 no more than the smaller number
    few = ends("n", "r") & ends("m", "s")
    pairs = pairs.where(F.when(few, (F.col("k0") + both >= overlap) & ((F.col("k0") > 0) | (F.col("k") >= meet))).otherwise(F.col("k0") >= meet)).select("a", "b")
    return known.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(_similar(pairs, texts, least))


def near_rows(docs: DataFrame, least: float = SIMILAR, shared: int = SHARED) -> DataFrame:
    """row, doc_id, root: rows of docs (row, doc_id, text), a table, linked by a Jaccard similarity of `least` on five-word shingles.

    Rows with equal sets are one; of the others SimHash makes the first links, and a prefix filter the rest. Exact at any length, but for equal 64-bit hashes of different shingles. Nulls and texts without words are one class.
    """
    ids = materialise(_sets(docs), "shingles")
    groups = ids.groupBy("digest").agg(F.min("row").alias("b"), F.count("*").alias("k")).where("k > 1")
    same = materialise(ids.select("row", "digest").join(groups, "digest").where("row <> b").select(F.col("row").alias("a"), "b"), "same")
    alone = ids.where("n > 0").select("row").join(same.select(F.col("a").alias("row")), "row", "left_anti")
    few = same.limit(SENT + 1).count() <= SENT
    left_out = same.select(F.col("a").alias("row")).unionByName(ids.where("n = 0").select("row"))
    texts = docs.join(F.broadcast(left_out), "row", "left_anti") if few else docs.join(alone, "row", "left_semi")
    comp = components(same.unionByName(_near_links(texts, least, shared)))
    return ids.select("row", "doc_id").join(comp, F.col("row") == F.col("node"), "left").select("row", "doc_id", F.coalesce("root", "row").alias("root"))


def near_classes(docs: DataFrame, least: float = SIMILAR, shared: int = SHARED) -> DataFrame:
    """doc_id, component_id of every row: the smallest doc_id of its class of near copies."""
    rows, key = numbered(docs.select("doc_id", "text"))
    rows = materialise(near_rows(rows.withColumnRenamed(key, "row"), least, shared), "near")
    low = rows.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return rows.join(low, "root").select("doc_id", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each class of near copies stays: the smallest doc_id's, null last, the first of equal ones."""
    rows, key = numbered(docs)
    near = materialise(near_rows(rows.select(F.col(key).alias("row"), "doc_id", "text")), "near")
    kept = near.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("m"), F.count("*").alias("k")).where("k > 1")
    gone = near.join(kept, "root").where("row <> m.row").select(F.col("row").alias(key))
    return rows.join(gone, key, "left_anti").select(docs.columns)


def query(docs: DataFrame) -> DataFrame:
    return simhash_classes(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
