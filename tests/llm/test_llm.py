"""Brute-force versions, round trips and held-out accuracy on small tables, and edge rows."""
import hashlib
import itertools
import random
import re
import subprocess
import sys
import tracemalloc
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import embed_dedup, exact_dedup, langid, license_scan, mixing, packing, quality, records, simhash, tokens, toxicity

D = "/root/testdata/sf0.01"
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
EDGE = [(1, None, None, None, 0), (2, "", "en", None, 0), (3, "Same text here. one two three", "en", "a", 0), (4, "same TEXT here. one two three", "en", "a", 0), (4, "same TEXT here. one two three", "en", "a", 0), (5, "GNU General Public License! " + "x y z " * 30000, "en", "b", 0), (6, "éÉ 123   ..\n\n  two  spaces", None, "b", 0)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module", params=["sf", "edge", "empty"])
def docs(request, spark):
    if request.param == "sf":
        return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = EDGE if request.param == "edge" else []
    return spark.createDataFrame(rows, SCHEMA).withColumn("fp", F.lit(1)).withColumn("score", F.lit("x")).withColumn("root", F.lit(2))


def texts(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


def brute_components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("sent", [exact_dedup.SENT, 0])
def test_exact_dedup(docs, sent, monkeypatch):
    monkeypatch.setattr(exact_dedup, "SENT", sent)
    groups = defaultdict(list)
    for d, t in texts(docs):
        groups[t.translate(AZ)].append(d)
    want = Counter((d, max(g), len(g), d == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for d in g)
    assert Counter(map(tuple, exact_dedup.query(docs).collect())) == want


def test_index_of_few_rows_is_small(spark):
    """The folder follows the rows, not the number of partitions."""
    docs = spark.createDataFrame([(i, f"text {i % 300}") for i in range(400)], "doc_id long, text string").repartition(40)
    index = exact_dedup.Index(spark)
    assert index.flush(docs).count() == 400 and index.compact().count() == 300
    files = [f for f in Path(index.top.removeprefix("file://")).rglob("*") if f.is_file()]
    assert sum(f.stat().st_size for f in files) < 500_000


def fingerprint(t):
    ws = re.findall(r"[^\x20\x09-\x0D]+", t.translate(AZ))
    sh = [" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] or ([" ".join(ws)] if ws else [])
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def test_simhash(docs):
    fps = [(d, fingerprint(t)) for d, t in texts(docs)]
    comp = brute_components({d for d, _ in fps}, [(a, b) for (a, x), (b, y) in itertools.combinations(fps, 2) if (x ^ y).bit_count() <= 3])
    want = Counter((d, f"{f:016x}", comp[d]) for d, f in fps)
    assert Counter(map(tuple, simhash.query(docs).collect())) == want


def test_masks_cover_every_triple():
    ms = simhash.masks()
    assert all(any(not m & (1 << a | 1 << b | 1 << c) for m in ms) for a, b, c in itertools.combinations(range(64), 3))


def test_near_classes(docs):
    sets = {}
    for d, t in texts(docs):
        ws = re.findall(r"[^\x20\x09-\x0D]+", t.translate(AZ))
        sets[d] = {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} or ({tuple(ws)} if ws else set())
    sim = {(a, b): (len(sets[a] & sets[b]) / len(sets[a] | sets[b]) if sets[a] | sets[b] else 1.0) for a, b in itertools.combinations(sorted(sets), 2)}
    sure = brute_components(sets, [p for p, j in sim.items() if j >= 0.88])
    most = brute_components(sets, [p for p, j in sim.items() if j >= 0.72])
    got = {r.doc_id: r.component_id for r in simhash.near_classes(docs).collect()}
    assert got.keys() == sets.keys()
    assert all(got[a] == got[b] for a, b in sure.items())
    assert all(most[got[d]] == most[d] for d in sets)


def test_near_classes_at_the_limit_exactly(docs):
    sets = {}
    for d, t in texts(docs):
        ws = re.findall(r"[^\x20\x09-\x0D]+", t.translate(AZ))
        sets[d] = {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} or ({tuple(ws)} if ws else set())
    links = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    assert {r.doc_id: r.component_id for r in simhash.near_classes(docs).collect()} == brute_components(sets, links)


@pytest.mark.parametrize(("sample", "often"), [(16, 8), (1, 2), (1, 10**9)])
def test_near_classes_of_common_passages(spark, monkeypatch, sample, often):
    """Copies of one original at all distances, passages with ends of their own, and mixed passages, by brute force."""
    monkeypatch.setattr(simhash, "SAMPLE", sample)
    monkeypatch.setattr(simhash, "OFTEN", often)
    rng, rows = np.random.default_rng(5), []
    original, one, two = ([f"{c}{i}" for i in range(90)] for c in "opq")
    for k in range(250):
        copy = list(original)
        for i in rng.permutation(90)[: rng.integers(0, 7)]:
            copy[i] = f"n{rng.integers(0, 400)}"
        ends = [f"e{rng.integers(0, 3000)}" for _ in range(rng.integers(0, 30))]
        cut = int(rng.integers(0, 40))
        rows += [" ".join(copy), " ".join(one + ends), " ".join(one[: 90 - cut] + two[:cut] + ends[: k % 4])]
    rows = [(int(i), t, "en", "a", 0) for i, t in zip(rng.permutation(len(rows)), rows, strict=True)]
    sets = {d: shingle_set(t) for d, t, *_ in rows}
    links = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    want = brute_components(sets, links)
    assert len(set(want.values())) > 20
    assert {r.doc_id: r.component_id for r in simhash.near_classes(spark.createDataFrame(rows, SCHEMA)).collect()} == want


def test_near_limit_of_long_texts(spark):
    """Pairs of texts of 4000 shingles at 0.8 or just below it: one shingle decides."""
    rows, want = [], {}
    for k, cut in enumerate([444, 445] * 6):
        words = [f"t{k}x{i}" for i in range(4000 + 4)]
        # the last `cut` words changed leave 4000 - cut shingles of 4000 + cut: 3556 / 4444 >= 0.8 > 3555 / 4445
        rows += [(2 * k, " ".join(words), "en", "a", 0), (2 * k + 1, " ".join(words[:-cut] + [f"u{k}x{i}" for i in range(cut)]), "en", "a", 0)]
        want |= {2 * k: 2 * k, 2 * k + 1: 2 * k + (cut == 445)}
    assert {r.doc_id: r.component_id for r in simhash.near_classes(spark.createDataFrame(rows, SCHEMA)).collect()} == want


def shingle_set(text):
    ws = text.split()
    return {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)}


def edited_pairs(lengths, most, each, seed=7):
    """(text, near copy, Jaccard similarity) by length: single words replaced, by common or by unseen ones, until below a bound in 0.78..most."""
    rng, out = np.random.default_rng(seed), defaultdict(list)
    for n, k in itertools.product(lengths, range(each)):
        words = [f"w{i}" for i in rng.zipf(1.3, n) % 20000]
        copy, whole, bound, j = list(words), shingle_set(" ".join(words)), rng.uniform(0.78, most), 1.0
        for step, i in enumerate(rng.permutation(n).tolist()):
            if step % max(1, n // 500) == 0:
                part = shingle_set(" ".join(copy))
                if (now := len(whole & part) / len(whole | part)) < bound:
                    break
                kept, j = list(copy), now
            copy[i] = f"new{n}x{k}x{i}" if k % 2 else f"w{rng.zipf(1.3) % 20000}"
        out[n].append((" ".join(words), " ".join(kept), j))
    return out


def test_near_copies_of_any_length(spark):
    pairs = [p for got in edited_pairs([60, 150, 400, 1500, 10000], 0.88, 12).values() for p in got]
    rows = [(2 * i + s, p[s], "en", "a", 0) for i, p in enumerate(pairs) for s in (0, 1)]
    got = {r.doc_id: r.component_id for r in simhash.near_classes(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, (_, _, j) in enumerate(pairs):
        assert (got[2 * i + 1] == got[2 * i] == 2 * i) if j >= 0.8 else (got[2 * i + 1] == 2 * i + 1)


def test_near_rows_begin_with_simhash(spark, monkeypatch):
    """SimHash classes give the first candidates, an exact check follows, and no later pair is one that they have linked."""
    rng, texts, seen, similar = np.random.default_rng(11), [], [], simhash._similar
    for k in range(20):
        words = [f"w{i}" for i in rng.integers(0, 5000, 400)]
        texts += [words, [*words, "end"], [f"x{k}y{i}" if i % 67 == 33 else w for i, w in enumerate(words)]]
    # a repeated line rules the fingerprint: equal ones of unlike sets
    texts += [["a", "b", "c"] * 3000 + [f"{c}{i}" for i in range(30)] for c in "pq"]
    texts = [" ".join(t) for t in texts]

    def spy(pairs, *rest):
        out = similar(pairs, *rest)
        seen.append([{(r.a, r.b) for r in x.collect()} for x in (pairs, out)])
        return out

    monkeypatch.setattr(simhash, "_similar", spy)
    docs = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "row long, doc_id long, text string")
    got = {r.row: r.root for r in simhash.near_rows(docs).collect()}
    fps, sets = list(map(fingerprint, texts)), list(map(shingle_set, texts))
    near = lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
    pairs = list(itertools.combinations(range(len(texts)), 2))
    prints = brute_components(range(len(texts)), [(a, b) for a, b in pairs if (fps[a] ^ fps[b]).bit_count() <= 3])
    stars = {(a, b) for a, b in prints.items() if a != b}
    assert len(stars) > 15 and (61, 60) in stars and not near(60, 61)
    assert seen[0] == [stars, {(a, b) for a, b in stars if near(a, b)}]
    assert len(seen) == 3 and not seen[0][1] & (seen[1][0] | seen[2][0])
    assert got == brute_components(range(len(texts)), [(a, b) for a, b in pairs if near(a, b)])
    assert set(got.values()) == {*range(0, 60, 3), 60, 61}


def test_mixing(docs):
    rows = mixing.query(docs).join(docs.select("doc_id", "source").distinct(), "doc_id").collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    assert Counter((r.doc_id, r.size) for r in rows) == Counter((d, size(t)) for d, t in texts(docs))
    src = {r.source: r.source_size for r in rows}
    order = sorted((s for s in src if s is not None)) + ([None] if None in src else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    want, free, left = {}, set(order), sum(src.values())
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > 3 * src[s]}
        want |= {s: 3 * src[s] if over else left * weight[s] / total for s in over or free}
        left -= sum(want[s] for s in over)
        free = free - over if over else set()
    taken = Counter()
    for r in rows:
        assert r.target == pytest.approx(want[r.source])
        assert r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s in order:
        assert abs(taken[s] - want[s]) <= max(r.size for r in rows if r.source == s)


def test_license_scan(docs):
    for d, t in texts(docs):
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(AZ))
        assert [w.decode() for w in license_scan.words(t)] == ws
    got = {r.doc_id: r for r in license_scan.query(docs).collect()}
    for d, t in texts(docs):
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(AZ))
        hits = [(i, lab) for p, lab in license_scan.BASE for i in range(len(ws)) if ws[i : i + len(p.split())] == p.split()]
        r = got[d]
        assert (r.n_words, r.n_base, r.base_labels) == (len(ws), len(hits), ",".join(sorted({x for _, x in hits})))
        assert (r.first_word, r.last_word) == ((min(hits)[0], max(hits)[0]) if hits else (None, None))
        own = {lab for p, lab, th, base in license_scan.TEMPLATES if not base and any(len(set(ws[i : i + len(p)]) & set(p)) >= th * len(set(p)) - 1e-9 for i in range(max(1, len(ws) - len(p) + 1)))}
        assert r.labels == ",".join(sorted({x for _, x in hits} | own))


def encoded(name, end, t):
    import public_tokenizers as p
    from tokenizers import Tokenizer

    if name not in encoded.memo:
        encoded.memo[name] = Tokenizer.from_file(p.path(name))
    tok = encoded.memo[name]
    return np.array(tok.encode(t, add_special_tokens=False).ids + [end], "<u4")


encoded.memo = {}


def test_packing(docs):
    seqs, pieces = defaultdict(list), defaultdict(list)
    ids = {d: encoded("word_bpe_49k.json", 1, t) for d, t in texts(docs)}
    for r in packing.query(docs).collect():
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        seqs[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id] += range(r.start, r.start + r.length)
    many = Counter(d for d, _ in texts(docs))
    assert {d: sorted(p) for d, p in pieces.items()} == {d: sorted(list(range(len(ids[d]))) * many[d]) for d in ids}
    pad = 0
    for s in seqs.values():
        s.sort()
        n = sum(x for _, x in s)
        assert [a for a, _ in s] == list(itertools.accumulate([x for _, x in s], initial=0))[:-1]
        assert n <= 2048
        pad += 0 if n & (n - 1) == 0 else 2048 - n
    assert pad <= 2048 * 8 and (len(ids) < 100 or pad < 0.03 * sum(map(len, ids.values())))


def test_packing_by_tiers():
    rng = np.random.default_rng(3)
    for lengths in (rng.integers(20, 251, 4000), np.minimum(rng.lognormal(5.5, 1.2, 4000).astype(int) + 1, 9000)):
        p = packing.Packer(1 << 40)
        for d, n in enumerate(lengths.tolist()):
            p.add(d, np.full(n, d, "<u4").tobytes())
            if p.held > 200_000:
                p.flush(False)
        p.flush(True)
        seqs, groups, tokens = defaultdict(list), defaultdict(set), Counter()
        for doc, start, n, total, seq, at, tier, group, ids in p.rows:
            seqs[seq, tier].append((at, n, total))
            groups[group].add((seq, tier))
            tokens[doc] += n
        assert tokens == Counter(dict(enumerate(lengths.tolist())))
        assert all(g >> 40 == 1 and len({t for _, t in s}) == 1 for g, s in groups.items())
        assert sum(sum(n for _, n, _ in s) != t for (_, t), s in seqs.items()) <= 1
        by = Counter(t for _, t in seqs)
        if lengths.max() <= 256:
            assert by[256] >= sum(by.values()) - 4
        else:
            # each tier has its own sequences, led by a piece of its own
            assert all(by[t] > 20 for t in packing.TIERS)
            led = Counter(t for (_, t), s in seqs.items() if min(s)[1] > t // 2 or t == 256)
            assert all(led[t] >= by[t] - 4 for t in packing.TIERS)
        sizes = defaultdict(list)
        for s in groups.values():
            sizes[next(iter(s))[1]].append(len(s))
        for t, many in sizes.items():
            full = 8 * 2048 // t
            assert max(many) <= full and (len(many) == 1 or min(many) >= full // 2 or sum(many) % (8 * full) <= full)


def test_records(docs):
    got = Counter(map(tuple, records.query(docs).collect()))
    at, want = 0, Counter()
    for d, t in sorted(texts(docs)):
        x = encoded("byte_bpe_50k.json", 2, t)
        want[(d, at, len(x), zlib.crc32(x.tobytes()))] += 1
        at += len(x)
    assert got == want


ODD = list("abzAZ .,'!<|>019\n\t  \r\x0b\x0c\x1c\x85\xa0éÉßİ\u0301\u030cJj\u0338\u2003\u3000あ中😀\u200bǰ&$%#") + ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "'s", "'ll", " the"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_batches_give_the_library_s_ids(name, monkeypatch):
    """Random strings of awkward characters, with a memo that turns over."""
    monkeypatch.setattr(tokens, "MEMO", 500)
    rng = random.Random(5)
    given = ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + ["", "<|endof", "text|>", "x" * 5000]
    enc = tokens.Encoder(tokens.encoder(name).path)
    for _ in range(2):
        ids, at = enc.batch(pa.array(given), 7)
        for i, t in enumerate(given):
            assert ids[at[i] : at[i + 1]].tolist() == encoded(name, 7, t).tolist(), t


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_unseen_words_go_to_the_model(name, monkeypatch):
    """Words of letters take the model alone, with the ids of all steps; what the pre-tokenizer may cut or fold takes all."""
    rng, enc, rest = random.Random(6), tokens.Encoder(tokens.encoder(name).path), []
    monkeypatch.setattr(enc, "_encode", lambda pieces, group, got, f=enc._encode: (rest.extend(pieces[i] for i in group), f(pieces, group, got)))
    latin = [*"abcxyzABCIXYZ", *map(chr, range(0xC0, 0x100))]
    words = ["".join(rng.choice(latin) for _ in range(rng.randint(1, 12))) for _ in range(3000)]
    given = [" ".join(words[k : k + 10]) for k in range(0, 3000, 10)] + ["I\u0307 \u00c9\u0301x \u0130I \u0178y a\u00d7b \u00f7", *map(chr, range(0xC0, 0x250))]
    ids, at = enc.batch(pa.array(given), 7)
    for i, t in enumerate(given):
        assert ids[at[i] : at[i + 1]].tolist() == encoded(name, 7, t).tolist(), t
    signs = re.compile("[^a-zA-Z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff ]")
    assert rest and all(signs.search(p.decode()) for p in rest)


def test_packed_batches_are_small():
    """Workers hold few results at once, and long documents make many batches."""
    texts = pa.array([f"{i} " + "word " * 3000 for i in range(700)])
    b = pa.RecordBatch.from_arrays([pa.array(range(700), pa.int64()), texts], ["doc_id", "text"])
    out = list(packing.packed(iter([b]), tokens.encoder("word_bpe_49k.json"), packing.Packer(0), 1))
    assert len(out) > 1 and max(x.nbytes for x in out) < 9 << 20
    assert sum(sum(x.column(2).to_pylist()) for x in out) == sum(len(encoded("word_bpe_49k.json", 1, t)) for t in texts.to_pylist())


def test_workers_give_memory_back():
    """What a worker has freed goes back to the system, as the workers of one stage live on in the next."""
    run = """
import re, sys
import numpy as np
from lodestone.llm.common import trim

def anon():
    return int(re.search(r"Anonymous:\\s+(\\d+)", open("/proc/self/smaps_rollup").read())[1]) // 1024

before = anon()
held = [np.ones(12_500) for _ in range(2000)]
end = np.ones(10)
assert anon() > before + 150
del held[:-1]
trim()
assert anon() < before + 40, anon() - before
"""
    subprocess.run([sys.executable, "-c", run], check=True, cwd=Path(corpus_pipeline.__file__).parent, timeout=100)


def test_records_in_any_order(docs, spark):
    odd = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(None, "no id")], "doc_id long, text string"))
    manifest = records.write(odd)
    want = [(r.doc_id, r.n_tokens, bytes(r.ids)) for r in records.read(manifest).orderBy("start").collect()]
    assert want[0][0] is None and want[0][2] == encoded("byte_bpe_50k.json", 2, "no id").tobytes()
    mixed = [(r.doc_id, r.n_tokens, bytes(r.ids)) for r in records.shuffled(manifest, 3).collect()]
    assert Counter(mixed) == Counter(want) and (len(want) < 100 or mixed != want)
    first = manifest.where("docs > 0").orderBy("shard").first()
    pairs = spark.createDataFrame([(first.shard, k) for k in reversed(range(first.docs))], "shard long, record long")
    got = {r.record: (r.doc_id, r.n_tokens, bytes(r.ids)) for r in records.look_up(manifest, pairs).collect()}
    assert [got[k] for k in range(first.docs)] == want[: first.docs]


def test_damaged_index(spark):
    manifest = records.write(spark.createDataFrame([(1, "one"), (2, "two")], "doc_id long, text string").coalesce(1))
    row = manifest.where("docs > 0").first()
    with open(row.path + ".idx", "r+b") as f:
        f.write(np.array([3], "<u8").tobytes())
    with pytest.raises(Exception, match="checksum"):
        records.look_up(manifest, spark.createDataFrame([(row.shard, 0)], "shard long, record long")).collect()


def test_wide_ids():
    for doc, ids in ((None, [1, 65536]), (-5, [0, 65535]), (3, [])):
        got = records.unpack(records.pack(doc, np.array(ids, "<u4")))
        assert (got[0], got[1].tolist()) == (doc, ids)


def test_damaged_record():
    import io

    good = records.frame(b"12345678ab")
    assert records.read_record(io.BytesIO(good)) == b"12345678ab"
    with pytest.raises(ValueError):
        records.read_record(io.BytesIO(good[:-6] + b"x" + good[-5:]))


def test_classifiers(docs, spark):
    if docs.count() > 100:
        docs = spark.read.parquet(f"{D}/documents.parquet")
    labels = spark.read.parquet(f"{D}/labels.parquet")
    n = docs.count()
    tox, lang, q = toxicity.query(docs, labels).collect(), langid.query(docs).collect(), quality.score(docs, labels).collect()
    assert len(tox) == len(lang) == len(q) == n
    assert all(0 <= r.score <= 1 for r in [*tox, *lang, *q])
    for r in [*tox, *lang]:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % (5 if "predicted" in r else 4) == (0 if "predicted" in r else 2))
    by = {d: t for d, t in texts(docs)}
    assert all((r.lang_pred == "und") == (not re.search(r"[^\W\d_]", by[r.doc_id])) for r in lang if n >= 100)
    if n >= 100:
        truth = {r.doc_id: r.toxic for r in labels.collect()}
        held = [(truth[r.doc_id], r.predicted) for r in tox if r.held_out and r.doc_id in truth]
        assert sum(a == b for a, b in held) / len(held) > 0.9
        real = {r.doc_id: r.lang for r in docs.collect()}
        ok = [real[r.doc_id] == r.lang_pred for r in lang if r.held_out]
        assert sum(ok) / len(ok) > 0.95


def test_toxicity_fit_is_small_on_the_driver():
    rng = np.random.default_rng(3)
    names = ["".join(rng.choice(list("abcdefgh"), 9)) for _ in range(3000)]
    texts = [". ".join(" ".join(rng.choice(names, 25)) for _ in range(30)) for _ in range(400)]
    y = np.array([i % 2 for i in range(400)], float)
    texts = [t + ". you vile wretch" if i % 2 else t for i, t in enumerate(texts)] + [None, "", "...", "you"]
    y = np.append(y, [0.0, 0.0, 0.0, 1.0])
    tracemalloc.start()
    try:
        model = toxicity.choose(texts, y)
        peak = tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()
    scorer = toxicity.Scorer(model)
    got = np.array([scorer.one(t)[0] for t in texts])
    assert ((got >= 0.5) == (y == 1))[:400].all() and not got[400:402].any()
    print("fit, peak MB", peak)
    assert peak < 15
    bags = toxicity.Bags.of(texts)
    assert np.allclose(toxicity.chances(bags, model), got, atol=1e-12)
    part = y == 1
    assert np.allclose(toxicity.chances(bags.pick(part), model), got[part], atol=1e-12)


def test_embeddings(spark):
    vecs = spark.read.parquet(f"{D}/embeddings.parquet")
    odd = spark.createDataFrame([(10**6, None, 1), (10**6 + 1, [0.0] * 64, 1), (10**6 + 2, [float("nan")] * 64, 1), (10**6 + 3, [1.0] * 64, None), (10**6 + 4, [1.0] * 64, 1), (10**6 + 5, [2.0] * 64, 1), (10**6 + 6, [2.0] * 64, 1)], vecs.schema)
    for v in (vecs.unionByName(odd), vecs.limit(0)):
        rows = v.collect()
        good = [(r.vec_id, r.label, np.array(r.embedding, float)) for r in rows if r.embedding is not None and r.label is not None and np.isfinite(r.embedding).all() and any(r.embedding)]
        links = [(a, b) for (a, la, x), (b, lb, y) in itertools.combinations(good, 2) if la == lb and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98]
        n = Counter(itertools.chain(*links))
        comp = brute_components([r.vec_id for r in rows], links)
        want = {r.vec_id: (n[r.vec_id], comp[r.vec_id]) for r in rows}
        assert {r.vec_id: (r.n_links, r.component_id) for r in embed_dedup.query(v).collect()} == want


def test_embedding_recall_in_a_deep_forest(spark):
    """Planted pairs among vectors of one label, in leaves so small that the trees are at least six levels deep."""
    rng = np.random.default_rng(11)
    base = rng.normal(size=(6000, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    near = base[:1500] + rng.normal(size=(1500, 64)) * rng.uniform(0.002, 0.025, (1500, 1))
    x = np.vstack([base, near]).astype("<f4").astype(float)
    vecs = spark.createDataFrame([(i, v, 1) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>, label int")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    sim = unit @ unit.T
    links = [(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(sim >= 0.98, 1)), strict=True)]
    assert len(links) > 1000 and np.ceil(np.log2(len(x) / 64)) >= 6
    found = {r.vec_id: r for r in embed_dedup.near_dups(vecs, leaf=64).collect()}
    recall = sum(found[a].component_id == found[b].component_id for a, b in links) / len(links)
    counted = sum(r.n_links for r in found.values()) / 2 / len(links)
    print("recall", recall, counted)
    assert recall >= 0.97 and 0.97 <= counted <= 1
    comp = brute_components(range(len(x)), links)
    assert all(comp[i] == comp[r.component_id] for i, r in found.items())


def test_merge_index_levels_and_later_batches(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "FANOUT", 3)
    first = spark.createDataFrame([(i, f"t{i % 50}") for i in range(400)], "doc_id long, text string").repartition(11)
    second = spark.createDataFrame([(1000 + i, f"T{i % 80}") for i in range(160)], "doc_id long, text string").repartition(4)
    index = exact_dedup.Index(spark)
    assert index.flush(first).count() == 400
    # before any compaction, a batch is looked up in all runs
    got = {r.doc_id: (r.keep_id, r.n) for r in index.probe(second, first).collect()}
    assert got == {1000 + i: ((i % 80, 8) if i % 80 < 50 else (None, None)) for i in range(160)}
    one = {r.digest: (r.keep_id, r.n) for r in index.compact().collect()}
    assert sorted(one.values()) == [(i, 8) for i in range(50)] and len(index.levels) == 4 and not any(index.levels[:-1])
    assert {r.doc_id: (r.keep_id, r.n) for r in index.probe(second, first).collect()} == got
    index.flush(second)
    assert sorted((r.keep_id, r.n) for r in index.compact().collect()) == sorted([(i, 10) for i in range(50)] + [(1000 + i, 2) for i in range(50, 80)])


def test_license_blocks():
    compiled = license_scan.compile_templates({})
    body = next(p for p, lab, _ in license_scan.OWN if lab == "isc-text").split()
    text = " ".join(["x"] * 300 + ["changed" if w == "hereby" else w for w in body] + ["y"] * 300)
    got = license_scan.scan_one(text, compiled)
    assert got["labels"] == "isc-text" and len(got["blocks"]) == 1
    block = got["blocks"][0]
    assert block["start"] <= 300 and block["end"] >= 300 + len(body) - 1 and 0.9 < block["containment"] < 1
    assert license_scan.scan_one(" ".join(["software", "the", "license"] * 50), compiled)["blocks"] == []
    # the positional filter leaves no window where too few template words stand around
    assert license_scan.reaches([5, 90], [5], 10, 2, 100) == [] and license_scan.reaches([5, 9], [5], 10, 2, 100) == [(0, 5)]


def test_quality_against_brute_force(docs, spark):
    labels = spark.read.parquet(f"{D}/labels.parquet")
    got = quality.score(docs, labels).collect()
    host = lambda r: "\0" if r.source is None else r.source.split("/")[0]
    e, hosts, paths = np.array([r.evidence for r in got]), [host(r) for r in got], [(host(r), r.path) for r in got]

    def level(groups, parents):
        """Strength of the prior by the variances inside and between groups; parents' means are the centre."""
        sums, n, big = defaultdict(list), len(e), defaultdict(list)
        for g, p, x in zip(groups, parents, e, strict=True):
            sums[g].append(x)
            big[p].append(x)
        of = dict(zip(groups, parents, strict=True))
        inside = sum(((np.array(x) - np.mean(x)) ** 2).sum() for x in sums.values()) / max(1, n - len(sums))
        between = sum(len(x) * (np.mean(x) - np.mean(big[of[g]])) ** 2 for g, x in sums.items()) - (len(sums) - len(big)) * inside
        free = n - sum(sum(len(x) ** 2 for g, x in sums.items() if of[g] == p) / len(big[p]) for p in big)
        between = max(0.0, between) / max(1e-9, free)
        return (1e12 if between == 0 else min(1e12, max(1e-6, inside / between))), {g: (sum(x), len(x)) for g, x in sums.items()}

    if got:
        prior = e.mean()
        hk, hsum = level(hosts, [0] * len(e))
        pk, psum = level(paths, hosts)
        for r, h, p in zip(got, hosts, paths, strict=True):
            hp = (hsum[h][0] - r.evidence + hk * prior) / (hsum[h][1] - 1 + hk)
            pp = (psum[p][0] - r.evidence + pk * hp) / (psum[p][1] - 1 + pk)
            if len(got) > 100:
                assert (r.host_posterior, r.path_posterior) == (pytest.approx(hp, rel=1e-3), pytest.approx(pp, rel=1e-3))
            o = lambda x: np.log(np.clip(x, 1e-9, 1 - 1e-9) / (1 - np.clip(x, 1e-9, 1 - 1e-9)))
            assert r.score == pytest.approx(1 / (1 + np.exp(-(o(r.evidence) + o(r.path_posterior) - o(prior)))), rel=1e-6)


def test_quality_of_held_out_documents(spark):
    docs, labels = spark.read.parquet(f"{D}/documents.parquet"), spark.read.parquet(f"{D}/labels.parquet")
    truth = {r.doc_id: r.quality for r in labels.where(toxicity.held_out(5, 0)).collect()}
    got = [(truth[r.doc_id], int(r.kept)) for r in quality.score(docs, labels.where(~toxicity.held_out(5, 0))).collect() if r.doc_id in truth]
    print("quality, held out", len(got), sum(a == b for a, b in got) / len(got))
    assert sum(a == b for a, b in got) / len(got) > 0.8


def test_without_labels(docs, spark):
    labels = spark.read.parquet(f"{D}/labels.parquet")
    for none in (labels.limit(0), labels.where("toxic = 1"), labels.withColumn("doc_id", F.col("doc_id") + 10**9)):
        assert {(r.score, r.predicted) for r in toxicity.query(docs, none).collect()} <= {(0.0, 0)}
        assert toxicity.keep_clean(docs, none).count() == docs.count()


def test_clashing_names_stay(spark):
    names = ["toxicity", "language", "_row", "_copies", "_one", "_c", "row", "digest", "key", "size"]
    docs = spark.createDataFrame(EDGE, SCHEMA).select("*", *[F.lit(f"own {n}").alias(n) for n in names])
    labels = spark.read.parquet(f"{D}/labels.parquet")
    for out in (toxicity.keep_clean(docs, labels), exact_dedup.keep_one(docs), simhash.keep_one(docs), mixing.apply(docs)):
        assert out.columns == docs.columns
        assert {tuple(r[n] for n in names) for r in out.collect()} == {tuple(f"own {n}" for n in names)}
    x, name = langid.predict(docs, {"families": [], "inside": {}, "langs": {}})
    assert name == "_language" and x.columns == [*docs.columns, "_language"]


def test_mixing_takes_no_row_more_than_three_times(spark):
    rows = [(i, "" if i % 3 else "w " * 5, "en", "big" if i % 2 else "small", 0) for i in range(60)] + [(None, "a b", "en", "c", 0), (None, "c d", "en", "c", 0)]
    rows += [(1000 + i, "w " * 400, "en", "d", 0) for i in range(20)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows) and max(r.copies for r in got) == 3 and all(r.taken == r.copies * r.size for r in got)
    assert sorted(map(tuple, mixing.mix(docs.repartition(7), buckets=2).collect()), key=str) == sorted(map(tuple, got), key=str)


def test_pipeline_stages(spark):
    at, cols = spark.read.parquet(f"{D}/documents.parquet"), None
    for name, stage in corpus_pipeline.STAGES[:3]:
        cols, before = at.columns, {r.doc_id for r in at.select("doc_id").collect()}
        at = stage(spark, at, D)
        assert at.columns == cols and {r.doc_id for r in at.select("doc_id").collect()} <= before
    assert at.groupBy(F.lower("text")).count().where("count > 1").isEmpty()


def test_pipeline_on_odd_ids(spark):
    """All stages keep each text once on null and repeated ids, and run on the empty table."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(None, a, "en", "s", 0), (None, a, "en", "s", 0), (7, b, "en", "s", 0), (7, b, "en", "s", 0), (7, c, "en", "s", 0), (9, c, "en", "s", 0), *EDGE]
    for given in (rows, []):
        docs = spark.createDataFrame(given, SCHEMA)
        want = Counter((r[1] or "").translate(AZ) for r in given)
        for keep in (exact_dedup.keep_one, simhash.keep_one):
            assert Counter((r.text or "").translate(AZ) for r in keep(docs).collect()) == dict.fromkeys(want, 1)
        assert {r.doc_id for r in exact_dedup.keep_one(docs).collect() if r.text == c} <= {9}
        mixed = Counter((r.doc_id, r.text) for r in mixing.apply(docs).collect())
        took = Counter()
        for r in mixing.mix(docs).collect():
            took[r.doc_id] += r.copies
        assert {d: sum(n for (x, _), n in mixed.items() if x == d) for d in took} == dict(took)
        at = docs
        for name, stage in corpus_pipeline.STAGES:
            at = stage(spark, at, "/root/testdata/sf0.001")
            if name != "packing":
                assert at.columns == docs.columns
        at.collect()
