"""Token files: ids in document order, coded by adaptive context mixing.

Texts are encoded with a tokenizer of the tokenizers library, sorted by doc_id over
range partitions, and every partition writes one file:

    magic, then blocks, then the document table, then a footer

A block holds ``BLOCK`` ids (the last one fewer) and stands alone: its model starts
anew, and a checksum of its ids follows in the header. The model predicts the next id
from contexts of order 2 (the last two ids) and order 1 (the last id), each by the id
that followed there last. Whether the order-2 prediction holds, then whether the
order-1 prediction does, are decisions whose chances are mixed from adaptive
estimates under the order-2 confidence, the order-1 confidence and no context. An id
that neither predicts is coded by order-0 counts of the size class of its number and
its place in that class. A carry-less 64-bit range coder turns the decisions into bytes.

All blocks of a slab are coded in step, one id of each at a time, so the work is on
arrays; each block's bytes depend on that block only.

Encoding: pieces of a text between single spaces are encoded once per process; a
pre-tokenizer of the byte-level kind never joins across such a space. Texts with
other white space after a space, or with an added token, are encoded whole.

Defined results: a null or empty text is one end id. Rows of one doc_id are ordered by
a hash of their text; null doc_ids come first. An empty table gives no file.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratingml.llm import files
from ratingml.llm.common import fresh_path, stored

END_ID = 2
BLOCK = 2048
#: Blocks that are coded in step.
SLAB = 4096
MAGIC = b"TOKCM03\n"

_SLOTS = 2048
#: No id; ids lie below it.
_NONE = 0xFFFFFFFF
#: Ids by their number of bits, up to 16; the last class holds all larger ones.
_CLASSES = 18
_LARGE = _CLASSES - 1
_BITS = np.append(np.frexp(np.arange(1 << 16))[1].astype(np.int64), _LARGE)
#: No id followed a context yet.
_NOTHING = -4
#: Ids from here on need wider context tables.
_WIDE = 1 << 29
#: Steps after which the order-0 intervals follow their counts.
_REFRESH = 32
_U = np.uint64
_TOP, _BOTTOM = _U(1 << 48), _U(1 << 40)


class _Model:
    """The state of all blocks of a slab; every block has rows of its own.

    The lanes at work are always the first ``n``, so their state is read and written as slices.
    """

    def __init__(self, lanes: int, kind: type):
        self.lanes = np.arange(lanes)
        self.slot = self.lanes * _SLOTS
        self.four = self.lanes << 2
        # by context: the id that followed last, and in the lowest two bits how sure that is
        self.next1 = np.full(lanes * _SLOTS, _NOTHING, kind)
        self.next2 = np.full(lanes * _SLOTS, _NOTHING, kind)
        # chances (of 65536) that the order-2 prediction holds: by its own confidence, by that
        # of order 1, and over all; then the same for the order-1 prediction
        self.hold2 = [np.full(lanes * 4, 32_768, np.int64), np.full(lanes * 4, 32_768, np.int64), np.full(lanes, 32_768, np.int64)]
        self.hold1 = [np.full(lanes * 4, 16_384, np.int64), np.full(lanes, 16_384, np.int64)]
        self.counts = np.ones((lanes, _CLASSES), np.int64)
        self.last = np.zeros(lanes, np.int64)
        self.before = np.zeros(lanes, np.int64)
        self.refresh()

    def refresh(self) -> None:
        """Order-0 intervals (of 4096) from the counts so far, one row per class."""
        sums = np.cumsum(self.counts, axis=1)
        # every class keeps a width of one at least
        ends = sums * (4096 - _CLASSES) // sums[:, -1:] + np.arange(1, _CLASSES + 1)
        self.ends = np.zeros((_CLASSES + 1, len(ends)), np.int16)
        self.ends[1:] = ends.T

    def look(self, n: int) -> None:
        mixed, slot, four = self.last[:n] * 40_503, self.slot[:n], self.four[:n]
        self.at1 = slot + ((mixed >> 4) & (_SLOTS - 1))
        self.at2 = slot + (((mixed ^ self.before[:n] * 60_493) >> 4) & (_SLOTS - 1))
        next1, next2 = [t.take(at).astype(np.int64) for t, at in ((self.next1, self.at1), (self.next2, self.at2))]
        self.guess1, self.guess2 = next1 >> 2, next2 >> 2
        self.s1, self.s2 = next1 & 3, next2 & 3
        self.four1, self.four2 = four + self.s1, four + self.s2

    def chance2(self, n: int) -> np.ndarray:
        """Chance (of 4096) of the order-2 prediction."""
        a, b, c = self.hold2
        self.own = a.take(self.four2), b.take(self.four1), c[:n]
        return _bounded((2 * self.own[0] + self.own[1] + self.own[2]) >> 6)

    def chance1(self, n: int) -> np.ndarray:
        a, c = self.hold1
        self.own = a.take(self.four1), c[:n]
        return _bounded((self.own[0] + self.own[1]) >> 5)

    def held2(self, n: int, coded: np.ndarray, hit: np.ndarray) -> None:
        goal = hit * 65_535
        for chances, where, own in zip(self.hold2, (self.four2, self.four1, slice(n)), self.own):
            chances[where] = own + ((goal - own) >> 4) * coded

    def held1(self, n: int, coded: np.ndarray, hit: np.ndarray) -> None:
        goal = hit * 65_535
        for chances, where, own in zip(self.hold1, (self.four1, slice(n)), self.own):
            chances[where] = own + ((goal - own) >> 4) * coded

    def learn(self, n: int, ids: np.ndarray) -> None:
        high = ids << 2
        self.next2[self.at2] = high + np.minimum(self.s2 + 1, 3) * (self.guess2 == ids)
        self.next1[self.at1] = high + np.minimum(self.s1 + 1, 3) * (self.guess1 == ids)
        self.before[:n] = self.last[:n]
        self.last[:n] = ids


def _bounded(chance: np.ndarray) -> np.ndarray:
    return np.minimum(np.maximum(chance, 16), 4080).view(np.uint64)


def _class_of(ids: np.ndarray) -> np.ndarray:
    """Number of bits of an id, or the class of large ones."""
    return _BITS.take(np.minimum(ids, len(_BITS) - 1))


class _Range:
    """What writing and reading share: an interval per lane, kept above ``_BOTTOM`` without carries."""

    def __init__(self, lanes: int):
        self.lanes = np.arange(lanes)
        self.low = np.zeros(lanes, np.uint64)
        self.width = np.full(lanes, 0xFFFFFFFFFFFFFFFF, np.uint64)

    def decide(self, n: int, unit: np.ndarray, part: np.ndarray, missed: np.ndarray, hit: np.ndarray) -> None:
        """Go to the lower part of the interval where ``hit``, to the upper one where ``missed``."""
        low, width = self.low[:n], self.width[:n]
        low += part * missed
        np.copyto(width, (unit << _U(12)) - part, where=missed)
        np.copyto(width, part, where=hit)

    def settle(self, n: int) -> None:
        self._settle(self.lanes[:n], self.low[:n], self.width[:n])

    def put(self, lanes: np.ndarray, low: np.ndarray, width: np.ndarray) -> None:
        """The intervals of some lanes, settled."""
        self.low[lanes], self.width[lanes] = low, width
        self._settle(lanes, low, width)

    def _settle(self, lanes: np.ndarray, low: np.ndarray, width: np.ndarray) -> None:
        """Shift out what no longer changes, 16 bits at a time."""
        while True:
            same = (low ^ (low + width)) < _TOP
            go = np.flatnonzero(same | (width < _BOTTOM))
            if not len(go):
                return
            lanes, low, width, same = lanes.take(go), low.take(go), width.take(go), same.take(go)
            # an interval across a border is cut there
            width = np.where(same, width, (~low + _U(1)) & (_BOTTOM - _U(1)))
            self.shift(lanes, low)
            low, width = low << _U(16), width << _U(16)
            self.low[lanes], self.width[lanes] = low, width


class _Writer(_Range):
    def __init__(self, lanes: int, room: int):
        super().__init__(lanes)
        self.out = np.zeros((lanes, room), "<u2")
        self.size = np.zeros(lanes, np.int64)

    def shift(self, lanes: np.ndarray, low: np.ndarray) -> None:
        size = self.size.take(lanes)
        self.out[lanes, size] = low >> _U(48)
        self.size[lanes] = size + 1

    def flag(self, n: int, chance: np.ndarray, coded: np.ndarray, hit: np.ndarray) -> None:
        unit = self.width[:n] >> _U(12)
        self.decide(n, unit, unit * chance, coded & ~hit, hit)

    def end(self, lanes: np.ndarray) -> None:
        for shift in (48, 32, 16, 0):
            self.out[lanes, self.size[lanes]] = ((self.low[lanes] >> _U(shift)) & _U(65_535)).astype(np.uint16)
            self.size[lanes] += 1


class _Reader(_Range):
    def __init__(self, data: list[bytes]):
        super().__init__(len(data))
        room = max(map(len, data)) + 16
        self.data = np.frombuffer(b"".join(d.ljust(room, b"\0") for d in data), "<u2").reshape(len(data), room // 2)
        self.code = np.zeros(len(data), np.uint64)
        for i in range(4):
            self.code = (self.code << _U(16)) | self.data[:, i].astype(np.uint64)
        self.at = np.full(len(data), 4, np.int64)

    def shift(self, lanes: np.ndarray, low: np.ndarray) -> None:
        at = self.at.take(lanes)
        more = self.data[lanes, np.minimum(at, self.data.shape[1] - 1)]
        self.code[lanes] = (self.code.take(lanes) << _U(16)) | more
        self.at[lanes] = at + 1

    def flag(self, n: int, chance: np.ndarray, coded: np.ndarray) -> np.ndarray:
        unit = self.width[:n] >> _U(12)
        part = unit * chance
        hit = coded & (self.code[:n] - self.low[:n] < part)
        self.decide(n, unit, part, coded & ~hit, hit)
        return hit


def _place(code: np.ndarray, unit: np.ndarray, most: np.ndarray | int) -> np.ndarray:
    """The unit of an interval in which ``code`` lies."""
    return np.minimum((code // unit).view(np.int64), most)


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """Code blocks of ids (longest first) in step; each result stands alone."""
    lengths = np.array([len(b) for b in blocks])
    ids = np.zeros((int(lengths.max()), len(blocks)), np.uint32)
    for lane, block in enumerate(blocks):
        if len(block) and not 0 <= int(block.min()) <= int(block.max()) < _NONE:
            raise ValueError(f"an id lies from 0 to {_NONE - 1}")
        ids[: len(block), lane] = block
    kind_of = np.int32 if ids.max(initial=0) < _WIDE else np.int64
    model, coder = _Model(len(blocks), kind_of), _Writer(len(blocks), 4 * len(ids) + 16)
    working = (lengths > np.arange(len(ids))[:, None]).sum(1).tolist()
    for at, n in enumerate(working):
        now = ids[at, :n].astype(np.int64)
        model.look(n)
        coded, hit = model.guess2 >= 0, model.guess2 == now
        coder.flag(n, model.chance2(n), coded, hit)
        model.held2(n, coded, hit)
        open_ = ~hit
        coded = open_ & (model.guess1 >= 0) & (model.guess1 != model.guess2)
        hit = coded & (model.guess1 == now)
        coder.flag(n, model.chance1(n), coded, hit)
        model.held1(n, coded, hit)
        open_ &= ~hit
        coder.settle(n)
        lanes = np.flatnonzero(open_)
        values = now.take(lanes)
        kind = _class_of(values)
        bits = np.maximum(kind - 1, 0)
        large = kind == _LARGE
        inner = np.where(large, values >> 16, (values - (1 << bits)) * (kind > 0))
        first, end = model.ends[kind, lanes].astype(np.uint64), model.ends[kind + 1, lanes].astype(np.uint64)
        unit = coder.width.take(lanes) >> _U(12)
        width = unit * (end - first) >> bits.view(np.uint64)
        coder.put(lanes, coder.low.take(lanes) + unit * first + width * inner.view(np.uint64), width)
        if large.any():
            # the upper half of a large id is coded, now the lower one
            some, low = lanes[large], (values[large] & 65_535).view(np.uint64)
            width = coder.width[some] >> _U(16)
            coder.put(some, coder.low[some] + width * low, width)
        model.counts[lanes, kind] += 4
        model.learn(n, now)
        if at % _REFRESH == 0:
            model.refresh()
    coder.end(model.lanes)
    return [coder.out[i, : coder.size[i]].tobytes() for i in range(len(blocks))]


def decode_blocks(data: list[bytes], lengths: list[int], kind_of: type = np.int32) -> list[np.ndarray]:
    """Blocks back from their bytes; lengths from the longest to the shortest."""
    sizes = np.array(lengths)
    ids = np.zeros((int(sizes.max()), len(data)), np.uint32)
    model, coder = _Model(len(data), kind_of), _Reader(data)
    places = np.zeros(len(data), np.int16)
    working = (sizes > np.arange(len(ids))[:, None]).sum(1).tolist()
    for at, n in enumerate(working):
        model.look(n)
        coded = model.guess2 >= 0
        hit = coder.flag(n, model.chance2(n), coded)
        model.held2(n, coded, hit)
        open_ = ~hit
        coded = open_ & (model.guess1 >= 0) & (model.guess1 != model.guess2)
        hit = coder.flag(n, model.chance1(n), coded)
        model.held1(n, coded, hit)
        open_ &= ~hit
        now = np.where(hit, model.guess1, model.guess2)
        coder.settle(n)
        lanes = np.flatnonzero(open_)
        low = coder.low.take(lanes)
        code = coder.code.take(lanes) - low
        unit = coder.width.take(lanes) >> _U(12)
        places[lanes] = _place(code, unit, 4095)
        # how many classes end at the place or before it
        kind = np.add.reduce((model.ends[1:, :n] <= places[:n]).view(np.uint8), 0, np.uint8).take(lanes).astype(np.int64)
        kind = np.minimum(kind, _CLASSES - 1)
        bits = np.maximum(kind - 1, 0)
        first, end = model.ends[kind, lanes].astype(np.uint64), model.ends[kind + 1, lanes].astype(np.uint64)
        width = unit * (end - first) >> bits.view(np.uint64)
        start = unit * first
        inner = _place(code - start, width, (1 << bits) - 1)
        coder.put(lanes, low + start + width * inner.view(np.uint64), width)
        large = kind == _LARGE
        values = np.where(large, inner << 16, ((1 << bits) + inner) * (kind > 0))
        if large.any():
            some = lanes[large]
            width = coder.width[some] >> _U(16)
            lower = _place(coder.code[some] - coder.low[some], width, 65_535)
            coder.put(some, coder.low[some] + width * lower.view(np.uint64), width)
            values[large] += lower
            if kind_of is np.int32 and values.max() >= _WIDE:
                return decode_blocks(data, lengths, np.int64)
        model.counts[lanes, kind] += 4
        now[lanes] = values
        ids[at, :n] = now
        model.learn(n, now)
        if at % _REFRESH == 0:
            model.refresh()
    return [ids[:n, i].astype(np.int64) for i, n in enumerate(lengths)]


class Encoder:
    """Ids of whole texts; pieces between single spaces are looked up."""

    REMEMBERED = 400_000
    #: White space after a space, or white space that not all libraries see alike.
    _ODD = re.compile(r" \s|[\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")

    def __init__(self, tokenizer_file: str, end_id: int = END_ID):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.end_id = end_id
        kind = self.tokenizer.pre_tokenizer
        self.by_piece = isinstance(kind, pre_tokenizers.ByteLevel) and self.tokenizer.normalizer is None and not kind.add_prefix_space
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat = np.zeros(0, np.int32)
        self.sizes = np.zeros(0, np.int64)

    def _whole(self, text: str) -> bool:
        return not self.by_piece or self._ODD.search(text) is not None or any(a in text for a in self.added)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, each text with its end id, and the number of ids of each text."""
        if len(self.known) > self.REMEMBERED:
            self.forget()
        known, new, split = self.known, [], []
        for text in texts:
            if not text:
                parts = []
            elif self._whole(text):
                parts = [text]
            else:
                first, *others = text.split(" ")
                parts = ([first] if first else []) + [" " + p for p in others]
            for p in parts:
                if p not in known:
                    known[p] = len(known)
                    new.append(p)
            split.append(parts)
        if new:
            coded = [e.ids for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)]
            self.sizes = np.concatenate([self.sizes, np.fromiter(map(len, coded), np.int64, len(coded))])
            self.flat = np.concatenate([self.flat, np.fromiter((i for c in coded for i in c), np.int32)])
        starts = np.concatenate([[0], np.cumsum(self.sizes)])
        # the end id is one more part of each text
        flat = np.append(self.flat, np.int32(self.end_id))
        last = len(self.sizes)
        starts, sizes = np.append(starts[:-1], len(self.flat)), np.append(self.sizes, 1)
        counts = np.array([len(p) + 1 for p in split], np.int64)
        part = np.full(int(counts.sum()), last, np.int64)
        ends = np.cumsum(counts)
        inner = np.ones(len(part), bool)
        inner[ends - 1] = False
        part[inner] = np.fromiter((known[p] for parts in split for p in parts), np.int64, int(inner.sum()))
        lengths = sizes[part]
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        ids = flat[np.repeat(starts[part] - offsets[:-1], lengths) + np.arange(offsets[-1])]
        if any(len(p) > 64 for p in new):
            self.forget()
        bounds = np.concatenate([[0], ends])
        return ids, offsets[bounds[1:]] - offsets[bounds[:-1]]


_ENCODERS: dict[str, Encoder] = {}


def _encoder(tokenizer_file: str) -> Encoder:
    """One encoder per Python process: later tasks find the parts of earlier ones."""
    # tasks already use all cores
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if tokenizer_file not in _ENCODERS:
        _ENCODERS[tokenizer_file] = Encoder(tokenizer_file)
    return _ENCODERS[tokenizer_file]


class FileWriter:
    """Collects ids and documents of one file; codes a slab of blocks whenever one is full."""

    def __init__(self, out):
        self.out = out
        out.write(MAGIC)
        self.waiting: list[np.ndarray] = []
        self.n_waiting = self.n_ids = 0
        self.docs: list[np.ndarray] = []

    def add(self, doc_ids: np.ndarray, known: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        self.docs.append(np.stack([doc_ids, known.astype(np.int64), counts], 1))
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        self.n_ids += len(ids)
        while self.n_waiting >= BLOCK * SLAB:
            whole = np.concatenate(self.waiting)
            self._code(whole[: BLOCK * SLAB])
            self.waiting, self.n_waiting = [whole[BLOCK * SLAB :]], len(whole) - BLOCK * SLAB

    def _code(self, ids: np.ndarray) -> None:
        blocks = [ids[i : i + BLOCK] for i in range(0, len(ids), BLOCK)]
        for block, data in zip(blocks, encode_blocks(blocks)):
            self.out.write(struct.pack("<III", len(block), len(data), zlib.crc32(block.astype("<u4").tobytes())))
            self.out.write(data)

    def close(self) -> None:
        if self.n_waiting:
            self._code(np.concatenate(self.waiting))
        self.out.write(struct.pack("<III", 0, 0, 0))
        rows = np.concatenate(self.docs) if self.docs else np.zeros((0, 3), np.int64)
        data = zlib.compress(rows.astype("<i8").tobytes(), 1)
        self.out.write(struct.pack("<QQI", len(rows), len(data), zlib.crc32(data)))
        self.out.write(data)
        self.out.close()


def read_file(source) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Slabs of ids, then once the document table (id, known, number of ids) with no ids."""
    if source.read(len(MAGIC)) != MAGIC:
        raise ValueError("not a token file")
    none = np.zeros((0, 3), np.int64)
    while True:
        data, lengths, sums = [], [], []
        n = -1
        while len(data) < SLAB:
            n, size, check = struct.unpack("<III", source.read(12))
            if not n:
                break
            data.append(source.read(size))
            lengths.append(n)
            sums.append(check)
        if data:
            blocks = decode_blocks(data, lengths)
            for block, check in zip(blocks, sums):
                if zlib.crc32(block.astype("<u4").tobytes()) != check:
                    raise ValueError("a block of a token file is damaged")
            yield np.concatenate(blocks), none
        if not n:
            break
    rows, size, check = struct.unpack("<QQI", source.read(20))
    data = source.read(size)
    if zlib.crc32(data) != check:
        raise ValueError("the document table of a token file is damaged")
    yield np.zeros(0, np.int64), np.frombuffer(zlib.decompress(data), "<i8").reshape(rows, 3)


def write_files(docs: DataFrame, tokenizer_file: str, folder: str, partitions: int) -> DataFrame:
    """One file per range of doc_ids; gives ``part, path, n_docs, n_ids`` in the order of the ids."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder, writer, path, n_docs = _encoder(tokenizer_file), None, "", 0
        for batch in batches:
            for start in range(0, len(batch), 500):
                some = batch.iloc[start : start + 500]
                if writer is None:
                    path = files.new_name(folder, "tokens", "bin")
                    writer = FileWriter(files.create(path))
                ids, counts = coder.encode([t if isinstance(t, str) else "" for t in some["text"]])
                known = some["doc_id"].notna().to_numpy()
                writer.add(some["doc_id"].fillna("0").astype("int64").to_numpy(), known, counts, ids)
                n_docs += len(some)
        if writer is not None:
            writer.close()
            yield pd.DataFrame([(TaskContext.get().partitionId(), path, n_docs, writer.n_ids)], columns=["part", "path", "n_docs", "n_ids"])

    rows = docs.select("doc_id", "text").repartitionByRange(partitions, F.col("doc_id").asc_nulls_first())
    rows = rows.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    # as text, since ids with nulls would become floats
    rows = rows.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return stored(rows.mapInPandas(write, "part int, path string, n_docs long, n_ids long"), "token-files")


def read_files(manifest: DataFrame, partitions: int) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, decoded from the files."""
    # one row per file
    rows = sorted(manifest.collect(), key=lambda r: r["part"])
    places, before = [], 0
    for row in rows:
        places.append((row["path"], before))
        before += row["n_ids"]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, base in zip(batch["path"], batch["base"]):
                with files.open_stream(path) as source:
                    table = np.zeros((0, 3), np.int64)
                    # ids as they come; the table at the end cuts them into documents
                    parts = []
                    for ids, found in read_file(source):
                        parts.append(ids.astype("<u2") if len(ids) and ids.max() < 65_536 else ids.astype("<u4"))
                        table = found if len(found) else table
                ids = np.concatenate(parts).astype("<u4")
                ends = np.cumsum(table[:, 2])
                starts = ends - table[:, 2]
                sums = [zlib.crc32(ids[s:e].tobytes()) for s, e in zip(starts.tolist(), ends.tolist())]
                yield pd.DataFrame(
                    {
                        "doc_id": pd.array(table[:, 0], dtype="Int64").copy(),
                        "start": starts + base,
                        "n_tokens": table[:, 2],
                        "ids_crc32": np.array(sums, np.int64),
                    }
                ).assign(doc_id=lambda d: d["doc_id"].where(table[:, 1] == 1))

    spark = manifest.sparkSession
    work = spark.createDataFrame(places, "path string, base long").repartition(partitions, "path")
    return work.mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer_file: str) -> DataFrame:
    """Write the token files of a table and read them back."""
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    manifest = write_files(docs, tokenizer_file, fresh_path(spark, "tokens"), partitions)
    return read_files(manifest, partitions)
