"""Hierarchical multi-length packing: tiers of 2048, 1024, 512 and 256 tokens, no shuffle.

Each task packs windows of at most WINDOW ids: full 2048 blocks leave first, remainders go to the tier that holds them. Each
tier packs its own pieces, longest first; gaps are filled with pieces of shorter tiers, the last one cut, and with own ones
where no shorter are left. Step groups hold sequences of one tier, dealt by attention cost so that groups of a block are
alike. Null text is empty and packs as its end id; repeated rows pack one by one, under a null doc_id as well; an empty table
gives no rows; a text of any length is cut at 2048 ids; other columns are not read.
"""
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from lodestone.llm.common import trim
from lodestone.llm.tokens import Encoder, encoder

TIERS, WINDOW, GROUP, BLOCK, END = (2048, 1024, 512, 256), 2_000_000, 8, 8, 1
ROWS = 1000  # a batch of results, 8 MB of ids at most
SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, tier long, step_group long, ids binary"


def _size(piece: tuple) -> int:
    return len(piece[2]) // 4


class Packer:
    def __init__(self, base: int, tiers: tuple[int, ...] = TIERS):
        self.tiers, self.base, self.rows = tiers, base, []
        self.sequences = self.groups = self.held = 0
        self.wait: dict[int, list] = {t: [] for t in tiers}  # ascending sizes
        self.tokens = {t: 0 for t in tiers}
        self.block: dict[int, list] = {t: [] for t in tiers}

    def emit(self, parts: list, tier: int) -> None:
        self.block[tier].append(parts)
        if len(self.block[tier]) == BLOCK * GROUP * self.tiers[0] // tier:
            self.deal(tier)

    def deal(self, tier: int) -> None:
        """Step groups of a block, to and fro by falling attention cost; group sizes differ by one sequence at most."""
        seqs, self.block[tier] = sorted(self.block[tier], key=lambda parts: -sum(_size(p) ** 2 for p in parts)), []
        many = -(-len(seqs) // (GROUP * self.tiers[0] // tier))
        for i, parts in enumerate(seqs):
            lap, k = divmod(i, many)
            seq, group, at = self.base + self.sequences, self.base + self.groups + (many - 1 - k if lap % 2 else k), 0
            self.sequences += 1
            for doc, start, ids, total in parts:
                self.rows.append((doc, start, len(ids) // 4, total, seq, at, tier, group, ids))
                at += len(ids) // 4
        self.groups += many

    def file(self, piece: tuple) -> None:
        n = _size(piece)
        tier = min(t for t in self.tiers if t >= n)
        insort(self.wait[tier], piece, key=_size)
        self.tokens[tier] += n
        self.held += n

    def take(self, tier: int, at: int) -> tuple:
        piece = self.wait[tier].pop(at)
        self.tokens[tier] -= _size(piece)
        self.held -= _size(piece)
        return piece

    def add(self, doc: int, ids: bytes) -> None:
        total, long = len(ids) // 4, self.tiers[0]
        for k in range(0, total, long):
            piece = (doc, k, ids[4 * k : 4 * (k + long)], total)
            if _size(piece) == long:
                self.emit([piece], long)
            else:
                self.file(piece)

    def fill(self, tier: int, length: int) -> None:
        """One sequence of `length`: the tier's longest piece, then the longest of shorter tiers that fit, then own ones; the last is cut."""
        order = [*(t for t in self.tiers if t < tier), tier] if tier > self.tiers[-1] else [tier]
        parts, room, piece = [], length, self.take(tier, -1)
        while True:
            doc, start, ids, total = piece
            n = min(room, len(ids) // 4)
            parts.append((doc, start, ids[: 4 * n], total))
            room -= n
            if 4 * n < len(ids):
                self.file((doc, start + n, ids[4 * n :], total))
            if not room or not any(self.wait[t] for t in order):
                break
            fit = next(((t, at - 1) for t in order if (at := bisect_right(self.wait[t], room, key=_size))), None)
            piece = self.take(*(fit or (next(t for t in (*order[-2::-1], tier) if self.wait[t]), 0)))
        self.emit(parts, length)

    def flush(self, last: bool) -> None:
        """Fill each tier's sequences exactly; what cannot fill one waits, or goes to the largest it fills, or ends padded."""
        for tier in self.tiers:
            below = [t for t in self.tiers if t <= tier]
            while self.wait[tier] and sum(self.tokens[t] for t in below) >= tier:
                self.fill(tier, tier)
        while last and self.held:
            length = next((t for t in self.tiers if self.held >= t), None)
            tier = next(t for t in self.tiers if self.wait[t])
            self.fill(tier, length or min(t for t in self.tiers if t >= self.held))
        for tier in self.tiers if last else ():
            if self.block[tier]:
                self.deal(tier)


def _batches(p: Packer, least: int) -> Iterator[pa.RecordBatch]:
    """The packer's rows, ROWS a batch, until fewer than `least` are left."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = [pa.int64()] * 8 + [pa.binary()]
    while len(p.rows) >= least:
        rows, p.rows = p.rows[:ROWS], p.rows[ROWS:]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def packed(it: Iterator[pa.RecordBatch], enc: Encoder, p: Packer, end: int) -> Iterator[pa.RecordBatch]:
    """The rows of pack() of batches (doc_id, text), by one packer."""
    trim()
    for b in it:
        ids_of = b.column(0).to_pylist()
        for at, ids, places in enc.slices(b.column(1), end):
            for doc, x, y in zip(ids_of[at:], places[:-1].tolist(), places[1:].tolist(), strict=False):
                p.add(doc, ids[x:y].tobytes())
                if p.held > WINDOW:
                    p.flush(False)
                if len(p.rows) >= ROWS:
                    yield from _batches(p, ROWS)
    p.flush(True)
    yield from _batches(p, 1)


def pack(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end: int = END) -> DataFrame:
    """A row per piece, with its little-endian ids; step groups hold up to GROUP x 2048 tokens of one tier."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return packed(it, encoder(tokenizer), Packer(TaskContext.get().partitionId() << 40), end)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def query(docs: DataFrame) -> DataFrame:
    return pack(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")
