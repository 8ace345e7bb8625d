"""License scans: exact set-similarity join of text windows with templates by containment.

A window, as long as the template, that holds a share t of a template's different tokens is a hit. Tokens are ordered by corpus
frequency, rarest first, so a hit holds one of the template's n - need + 1 rarest tokens (prefix), lies in a text of at least
`need` words (length), and has at least `need` template tokens around that place, counted from it to both sides as far as
windows reach (position). What passes is counted exactly, window by window. Adjoining hits are one block.

Null text is empty; repeated rows are scanned one by one; an empty table gives no rows; texts are scanned whole; other columns
are not read. Base phrases are templates at threshold 1 whose windows are then checked word by word.
"""
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Base phrases and labels.
BASE = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]
# Own templates from public license texts, label and containment threshold.
OWN = [
    ("this work is licensed under the gnu general public license version 3", "gpl-notice", 0.8),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "gpl-notice", 0.8),
    ("this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", "lgpl-notice", 0.85),
    ("under the terms of the gnu affero general public license as published by the free software foundation", "agpl-notice", 0.9),
    ("licensed under the apache license version 2 0", "apache-notice", 0.8),
    ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", "apache-notice", 0.8),
    ("released under the mit license", "mit-notice", 0.8),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", "mit-text", 0.8),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "isc-text", 0.8),
    ("licensed under cc by nc 4 0", "cc-by-nc-notice", 0.8),
    ("this work is licensed under a creative commons attribution sharealike 4 0 international license", "cc-by-sa-notice", 0.85),
    ("to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "cc0-notice", 0.8),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd", 0.8),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-notice", 0.8),
    ("this is free and unencumbered software released into the public domain", "unlicense", 0.8),
]
TEMPLATES = [(p.split(), lab, 1.0, True) for p, lab in BASE] + [(p.split(), lab, t, False) for p, lab, t in OWN]
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def frequencies(docs: DataFrame) -> dict[str, int]:
    """Corpus counts of the templates' tokens; the result is bounded by the templates."""
    vocab = {w.encode() for t in TEMPLATES for w in t[0]}

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Counter = Counter()
        for p in it:
            for t in p.column(0):
                c.update(filter(vocab.__contains__, words(t.as_py())))
        yield pa.RecordBatch.from_arrays([pa.array([k.decode() for k in c], pa.string()), pa.array(list(c.values()), pa.int64())], ["w", "n"])

    return dict(map(tuple, docs.select("text").mapInArrow(count, "w string, n long").groupBy("w").agg(F.sum("n")).collect()))


def compile_templates(freq: dict[str, int]) -> list[dict]:
    out = []
    for phrase, label, t, base in TEMPLATES:
        order = sorted({w.encode() for w in phrase}, key=lambda w: (freq.get(w.decode(), 0), w))
        need = ceil(t * len(order) - 1e-9)
        out.append({"phrase": [w.encode() for w in phrase], "label": label, "base": base, "need": need, "n": len(order), "tokens": set(order), "prefix": set(order[: len(order) - need + 1])})
    return out


def reaches(places: list[int], spots: list[int], size: int, need: int, last: int) -> list[tuple[int, int]]:
    """Ranges of window starts around the prefix `spots` that hold `need` template tokens' `places` at all; merged, ascending."""
    out: list[tuple[int, int]] = []
    for i in spots:
        lo, hi = max(0, i - size + 1), min(i, last)
        first, end = bisect_left(places, lo), bisect_left(places, hi + size)
        if lo > hi or end - first < need:
            continue
        # `need` places from lo on must lie before the window's end, and as many before hi's end not before its start
        lo, hi = max(lo, places[first + need - 1] - size + 1), min(hi, places[end - need])
        if lo > hi:
            continue
        if out and lo <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def hits_of(ws: list[bytes], c: dict, index: dict[bytes, list[int]]) -> Iterator[tuple[int, int]]:
    """(start, number of different template tokens) of every window that holds enough of them."""
    size, need = len(c["phrase"]), c["need"]
    if len(ws) < need:  # length filter
        return
    spots = sorted(i for w in c["prefix"] for i in index.get(w, ()))
    if not spots:
        return
    tokens, last = c["tokens"], max(0, len(ws) - size)
    near = {i for s in spots for i in range(max(0, s - size + 1), min(len(ws), s + size))} if len(spots) * size < len(ws) else range(len(ws))
    places = sorted(i for i in near if ws[i] in tokens)
    for lo, hi in reaches(places, spots, size, need, last):  # positional filter
        held = Counter(w for w in ws[lo : lo + size] if w in tokens)
        for s in range(lo, hi + 1):
            if s > lo:
                if (gone := ws[s - 1]) in tokens:
                    held[gone] -= 1
                    if not held[gone]:
                        del held[gone]
                if s + size <= len(ws) and (new := ws[s + size - 1]) in tokens:
                    held[new] += 1
            if len(held) >= need:
                yield s, len(held)


def scan_one(text: str | None, compiled: list[dict]) -> dict:
    """Counts, places and labels of one text, and its blocks: (first word, last word, label, best containment)."""
    ws = words(text)
    base, labels, best, blocks = [], set(), 0.0, []
    index: dict[bytes, list[int]] = {}
    wanted = set().union(*(c["prefix"] for c in compiled))
    for i, w in enumerate(ws):
        if w in wanted:
            index.setdefault(w, []).append(i)
    for c in compiled if index else []:
        size, open_at = len(c["phrase"]), None
        for s, share in hits_of(ws, c, index):
            if c["base"]:
                if ws[s : s + size] != c["phrase"]:
                    continue
                base.append((s, c["label"]))
            else:
                labels.add(c["label"])
            share = share / c["n"]
            best, end = max(best, share), min(s + size, len(ws)) - 1
            if open_at is not None and s <= blocks[-1][1] + 1:
                blocks[-1] = (blocks[-1][0], end, c["label"], max(blocks[-1][3], share))
            else:
                open_at = s
                blocks.append((s, end, c["label"], share))
    found = sorted({x for _, x in base})
    return {
        "n_words": len(ws), "n_base": len(base), "first_word": min((s for s, _ in base), default=None), "last_word": max((s for s, _ in base), default=None),
        "base_labels": ",".join(found), "labels": ",".join(sorted({*found, *labels})), "score": best,
        "blocks": [dict(zip(("start", "end", "label", "containment"), b, strict=True)) for b in sorted(blocks)],
    }


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, blocks array<struct<start:long,end:long,label:string,containment:double>>"
_BLOCK = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("containment", pa.float64())])
_ARROW = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_words", "n_base", "first_word", "last_word")), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("blocks", pa.list_(_BLOCK))])


def scan(docs: DataFrame) -> DataFrame:
    """A row per document, with its license blocks by word places."""
    compiled = compile_templates(frequencies(docs))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in it:
            for at in range(0, p.num_rows, 1000):
                part = p.slice(at, 1000)
                rows = [{"doc_id": d, **scan_one(t.as_py(), compiled)} for d, t in zip(part.column(0).to_pylist(), part.column(1), strict=True)]
                yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def query(docs: DataFrame) -> DataFrame:
    return scan(docs).withColumn("n_blocks", F.size("blocks").cast("long")).drop("blocks")
