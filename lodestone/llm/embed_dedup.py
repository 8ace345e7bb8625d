"""Embedding near-dedup by a forest of random-projection trees with spill overlap.

Null, empty, zero, non-finite vectors and null labels link with nothing. Exact copies are one representative with a multiplicity.
A pair is counted only in the first leaf its vectors share, so that no pair leaves a task. Vectors of different lengths are not
compared. An empty table gives no rows; other columns are not read.
"""
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lodestone.llm.common import chunked, components, materialise

LIMIT, TREES, LEAF, SPILL, SAMPLE, CHUNK, SEED = 0.98, 8, 256, 0.1, 20_000, 2048, 7


def fit(reps: DataFrame, trees: int = TREES, leaf: int = LEAF, sample: int = SAMPLE) -> dict:
    """Split thresholds from a bounded sample; depth from the largest label's size."""
    most = reps.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    some = [r[0] for r in reps.orderBy(F.xxhash64("rep")).select("embedding").limit(sample).collect()]
    if not some:
        return {"dirs": np.zeros((trees, 0, 0)), "cuts": [], "spill": []}
    wide = max(map(len, some))
    x = np.array([v for v in some if len(v) == wide], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    depth = max(0, int(np.ceil(np.log2(max(1, most) / leaf))))
    dirs = np.random.default_rng(SEED).normal(size=(trees, depth, wide))
    dirs /= np.maximum(np.linalg.norm(dirs, axis=2, keepdims=True), 1e-12)
    cuts, spill = [], []
    for t in range(trees):
        node, per, sp = np.zeros(len(x), int), [], []
        for lv in range(depth):
            p = x @ dirs[t, lv]
            mid = {n: float(np.median(p[node == n])) for n in np.unique(node) if (node == n).sum() >= 16}
            per.append((mid, float(np.median(p))))
            sp.append(float(p.std()))
            cut = np.array([mid.get(n, per[-1][1]) for n in node])
            node = 2 * node + (p >= cut)
        cuts.append(per)
        spill.append(sp)
    return {"dirs": dirs, "cuts": cuts, "spill": spill}


def leaves(v: np.ndarray, forest: dict, width: float = SPILL) -> list[int]:
    """Sorted codes of all leaves of one unit vector; near a cut it goes to both sides."""
    out = []
    dirs = forest["dirs"]
    for t in range(len(forest["cuts"])):
        nodes = [0]
        if dirs.shape[1] and dirs.shape[2] == len(v):
            for lv, p in enumerate(dirs[t] @ v):
                mid, other = forest["cuts"][t][lv]
                tau = width * forest["spill"][t][lv]
                nodes = [2 * n + s for n in nodes for s in (0, 1) if (p < mid.get(n, other) + tau if s == 0 else p >= mid.get(n, other) - tau)]
        out += [(t << 48) + n for n in nodes]
    return sorted(set(out)) or [0]


def _compare(pdf: pd.DataFrame, limit: float) -> pd.DataFrame:
    """Links of one leaf (or pair of its chunks): for each vector its local component and its count of new links."""
    ci, cj, code = int(pdf["ci"].iat[0]), int(pdf["cj"].iat[0]), int(pdf["code"].iat[0])
    same = {len(v) for v in pdf["unit"]}
    parts = [pdf[pdf["unit"].map(len) == n].reset_index(drop=True) for n in same]
    out = []
    for g in parts:
        x, chunk, rep, mult = np.array(g["unit"].tolist(), float), g["chunk"].to_numpy(), g["rep"].to_numpy(), g["mult"].to_numpy()
        link = np.zeros((len(x), len(x)), bool)
        for k in range(0, len(x), 512):
            link[k : k + 512] = x[k : k + 512] @ x.T >= limit
        np.fill_diagonal(link, False)
        if ci != cj:
            link &= chunk[:, None] != chunk[None, :]
        rows = np.nonzero(link.any(1))[0]
        if not len(rows):
            continue
        link, new = link[np.ix_(rows, rows)], None
        new = link.copy()
        has: dict[int, list[int]] = {}
        for i, cs in enumerate(g["codes"].iloc[rows]):
            for c in cs:
                if c < code:
                    has.setdefault(int(c), []).append(i)
        for idx in has.values():
            if len(idx) > 1:
                new[np.ix_(idx, idx)] = False
        count = new @ mult[rows]
        left, root = np.ones(len(rows), bool), np.arange(len(rows))
        for s in range(len(rows)):
            if left[s]:
                left[s], todo = False, [s]
                while todo:
                    near = np.nonzero(link[todo.pop()] & left)[0]
                    left[near], root[near] = False, s
                    todo += near.tolist()
        out.append(pd.DataFrame({"a": rep[rows], "b": rep[rows][root], "n": count.astype("int64")}))
    return pd.concat(out) if out else pd.DataFrame({"a": [], "b": [], "n": []}, dtype="int64")


def near_dups(vecs: DataFrame, limit: float = LIMIT, leaf: int = LEAF) -> DataFrame:
    """vec_id, n_links, component_id of every row."""
    e = F.col("embedding").cast("array<double>")
    fine = F.col("label").isNotNull() & F.coalesce(F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0), F.lit(False))
    base = vecs.select("vec_id", "embedding", "label", fine.alias("fine"))
    reps = materialise(base.where("fine").groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("mult")), "vectors")
    forest = reps.sparkSession.sparkContext.broadcast(fit(reps, leaf=leaf))

    def route(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in it:
            unit = [np.asarray(v, float) / np.linalg.norm(np.asarray(v, float)) for v in p["embedding"]]
            yield pd.DataFrame({"label": p["label"], "rep": p["rep"], "mult": p["mult"], "unit": unit, "codes": [leaves(v, forest.value) for v in unit]})

    kind = dict(reps.dtypes)["label"]
    routed = reps.select("label", "rep", "mult", "embedding").mapInPandas(route, f"label {kind}, rep long, mult long, unit array<double>, codes array<long>")
    dealt = chunked(materialise(routed, "routed").withColumn("code", F.explode("codes")), ["label", "code"], "rep", CHUNK)
    found = materialise(dealt.groupBy("label", "code", "ci", "cj").applyInPandas(partial(_compare, limit=limit), "a long, b long, n long"), "links")
    links = found.groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    rooted = reps.join(links, "rep", "left").join(components(found), F.col("rep") == F.col("node"), "left")
    rooted = rooted.select(F.col("label").alias("l"), F.col("embedding").alias("e"), (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    yes = base.where("fine").join(rooted, (F.col("label") == F.col("l")) & (F.col("embedding") == F.col("e"))).select("vec_id", "n_links", "component_id")
    return yes.unionByName(base.where("not fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))


def query(vecs: DataFrame) -> DataFrame:
    return near_dups(vecs).withColumn("kept", F.col("vec_id") == F.col("component_id"))
