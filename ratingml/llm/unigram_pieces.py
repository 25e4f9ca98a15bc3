"""Unigram encoding and decoding with the pieces of a SentencePiece model.

The pieces sit in a double-array trie over UTF-8 bytes. A text gets a leading space,
spaces become the marker U+2581, and the best sum of log scores is found by the
Viterbi recursion. Characters that no piece covers become byte pieces. A marker that
is in the text itself is encoded by bytes, so decoding gives back every text exactly.

Models of type unigram bring their log scores. Models of another type rank their
pieces only; a piece of rank r then gets ``-log(r + 2)``, Zipf's law without its
constant. Ties go to the longer last piece.

No piece continues after a marker that follows another character, unless the model
says so. The recursion therefore splits at such markers, and equal parts are solved
once: all new parts of a batch together, one step of the recursion for all of them
at a time, parts of more than ``LONG`` bytes each in a loop of their own.

Defined results: a null text gives null ids, an empty text no ids. Repeated rows and
other columns pass through.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ratingml.llm.common import quoted

MARKER = "▁"
LONG = 256
#: Parts that an encoding process remembers, and the bytes a remembered part may have.
REMEMBERED = 300_000
REMEMBERED_BYTES = 64
#: Rows that are encoded together.
ROWS = 500

_PARTS = re.compile(r" *[^ ]+| +")


class Vocabulary(NamedTuple):
    """Pieces by id as bytes, their log scores, the id of byte 0, and the trie."""

    pieces: list[bytes]
    scores: np.ndarray
    first_byte: int
    fallback: float
    base: np.ndarray
    check: np.ndarray
    value: np.ndarray
    splits: bool


def double_array(words: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``base, check, value``: the child of node s by byte c is ``base[s] + c`` if ``check`` there is s."""
    tree: list[dict[int, int]] = [{}]
    ends: dict[int, int] = {}
    for word, number in words.items():
        node = 0
        for c in word:
            child = tree[node].get(c)
            if child is None:
                child = len(tree)
                tree[node][c] = child
                tree.append({})
            node = child
        ends[node] = number
    size = 4 * len(tree) + 8192
    base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    free = np.ones(size, bool)
    free[0] = False
    place, waiting, hint, window = {0: 0}, [0], 1, 2048
    while waiting:
        node = waiting.pop()
        own = place[node]
        value[own] = ends.get(node, -1)
        children = sorted(tree[node].items())
        if not children:
            continue
        at = hint
        while True:
            if at + window + 256 >= len(free):
                grow = len(free)
                free = np.concatenate([free, np.ones(grow, bool)])
                base = np.concatenate([base, np.zeros(grow, np.int32)])
                check, value = (np.concatenate([x, np.full(grow, -1, np.int32)]) for x in (check, value))
            fits = np.logical_and.reduce([free[at + c : at + c + window] for c, _ in children])
            if fits.any():
                at += int(fits.argmax())
                break
            at += window
        # full stretches on the left are not searched again
        if not free[hint : hint + window].any():
            hint += window
        elif len(children) == 1 and at > hint + window:
            hint += window // 8
        base[own] = at
        for c, child in children:
            free[at + c] = False
            check[at + c] = own
            place[child] = at + c
            waiting.append(child)
    # slack, so that base + byte never leaves the arrays
    return tuple(np.concatenate([a, np.full(257, -1, np.int32)]) for a in (base, check, value))


def load(model_file: str) -> Vocabulary:
    """Read the pieces of a SentencePiece model file on the driver; the vocabulary's size bounds the result."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(model_file, "rb") as f:
        model.ParseFromString(f.read())
    kinds = pb.ModelProto.SentencePiece
    ranked = model.trainer_spec.model_type != pb.TrainerSpec.UNIGRAM
    pieces, scores, words, rank = [], [], {}, 0
    for number, p in enumerate(model.pieces):
        if p.type == kinds.BYTE:
            pieces.append(bytes([int(p.piece[3:5], 16)]))
            scores.append(0.0)
        elif p.type in (kinds.NORMAL, kinds.USER_DEFINED):
            pieces.append(p.piece.encode())
            scores.append(-math.log(rank + 2) if ranked else p.score)
            rank += 1
            words.setdefault(p.piece.encode(), number)
        else:
            pieces.append(b"")
            scores.append(0.0)
    return vocabulary(pieces, scores, words, [p.piece for p in model.pieces].index("<0x00>"))


def vocabulary(pieces: list[bytes], scores: list[float], words: dict[bytes, int], first_byte: int) -> Vocabulary:
    own = np.array(scores, np.float64)
    lowest = min((own[i] for i in words.values()), default=0.0)
    splits = not any(MARKER in w.decode().lstrip(MARKER) for w in words)
    return Vocabulary(pieces, own, first_byte, float(lowest) - 10.0, *double_array(words), splits)


def matches(data: np.ndarray, ends: np.ndarray, starts: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, ...]:
    """All pieces at all given starts: start, end and id; ``ends[i]`` is where the part of start i ends."""
    node = np.zeros(len(starts), np.int64)
    at, own, stop = starts.copy(), starts, ends
    found = []
    while len(at):
        inside = at < stop
        node, at, own, stop = node[inside], at[inside], own[inside], stop[inside]
        child = vocab.base[node] + data[at].astype(np.int64)
        good = (vocab.base[node] > 0) & (vocab.check[child] == node)
        node, at, own, stop = child[good], at[good] + 1, own[good], stop[good]
        ids = vocab.value[node]
        hit = ids >= 0
        found.append((own[hit], at[hit], ids[hit].astype(np.int64)))
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    return tuple(np.concatenate([f[i] for f in found]) for i in range(3))


def solve(parts: list[bytes], blocked: list[bytes], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The best ids of all parts end to end, and the number of ids of each. ``blocked`` marks, per byte, where no piece may start or pass (1)."""
    data = np.frombuffer(b"".join(parts), np.uint8)
    shut = np.frombuffer(b"".join(blocked), np.uint8)
    lengths = np.array([len(p) for p in parts], np.int64)
    begins = np.concatenate([[0], np.cumsum(lengths)])
    part_of = np.repeat(np.arange(len(parts)), lengths)
    is_start = (data & 0xC0) != 0x80
    char_at = np.flatnonzero(is_start)
    char_end = np.append(char_at[1:], len(data))
    start, end, ids = matches(data, begins[part_of[char_at] + 1], char_at, vocab)
    if shut.any():
        before = np.concatenate([[0], np.cumsum(shut)])
        free = before[end] == before[start]
        start, end, ids = start[free], end[free], ids[free]
    # a character without a piece of its own goes as bytes
    end_of_char = np.zeros(len(data), np.int64)
    end_of_char[char_at] = char_end
    bare = is_start.copy()
    bare[start[end == end_of_char[start]]] = False
    bare_at = np.flatnonzero(bare)
    start, end = np.concatenate([start, bare_at]), np.concatenate([end, end_of_char[bare_at]])
    gain = np.concatenate([vocab.scores[ids], np.full(len(bare_at), vocab.fallback)])
    ids = np.concatenate([ids, np.full(len(bare_at), -1)])
    long_part = lengths[part_of[start]] > LONG if len(start) else np.zeros(0, bool)
    # one more place per part, for its end
    place = start + part_of[start]
    goal = end + part_of[start]
    best = np.full(len(data) + len(parts), -np.inf)
    best[begins[:-1] + np.arange(len(parts))] = 0.0
    via = np.full(len(best), -1, np.int64)
    step = start - begins[part_of[start]]
    short = np.flatnonzero(~long_part)
    short = short[np.argsort(step[short], kind="stable")]
    cuts = np.flatnonzero(np.diff(step[short])) + 1
    for rows in np.split(short, cuts) if len(short) else []:
        new = best[place[rows]] + gain[rows]
        better = new > best[goal[rows]]
        rows = rows[better]
        best[goal[rows]] = new[better]
        via[goal[rows]] = rows
    slow = np.flatnonzero(long_part)
    slow = slow[np.argsort(place[slow], kind="stable")]
    top: dict[int, float] = {}
    for row, a, b, g in zip(slow.tolist(), place[slow].tolist(), goal[slow].tolist(), gain[slow].tolist()):
        new = top.get(a, 0.0) + g
        if new > top.get(b, -math.inf):
            top[b] = new
            via[b] = row
    # walk back from all ends at once
    open_ = np.flatnonzero(lengths > 0)
    at = begins[1:][open_] + open_
    walked = []
    while len(open_):
        row = via[at]
        walked.append((open_, row))
        at = place[row]
        going = at > begins[open_] + open_
        open_, at = open_[going], at[going]
    if not walked:
        return np.zeros(0, np.int32), np.zeros(len(parts), np.int64)
    of = np.concatenate([w[0] for w in walked])
    row = np.concatenate([w[1] for w in walked])[::-1]
    of = of[::-1]
    by = np.argsort(of, kind="stable")
    of, row = of[by], row[by]
    width = np.where(ids[row] >= 0, 1, end[row] - start[row])
    firsts = np.concatenate([[0], np.cumsum(width)])
    flat = np.repeat(ids[row], width)
    bare_ids = np.flatnonzero(flat < 0)
    source = np.repeat(start[row] - firsts[:-1], width) + np.arange(len(flat))
    flat[bare_ids] = vocab.first_byte + data[source[bare_ids]].astype(np.int64)
    return flat.astype(np.int32), np.bincount(of, width, len(parts)).astype(np.int64)


class Encoder:
    """Encodes texts batch by batch and remembers the ids of short parts."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.byte_of = [p for p in vocab.pieces]
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat: list[np.ndarray] = [np.zeros(0, np.int32)]
        self.sizes: list[np.ndarray] = [np.zeros(0, np.int64)]

    def parts_of(self, text: str) -> list[str]:
        """Parts with their leading spaces; together they are a space and the text."""
        if not text:
            return []
        if not self.vocab.splits:
            return [" " + text]
        found = text.split(" ")
        if "" not in found:
            return [" " + p for p in found]
        return _PARTS.findall(" " + text)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and the number of ids of each text."""
        if len(self.known) > REMEMBERED:
            self.forget()
        split = [self.parts_of(t) for t in texts]
        counts = np.array([len(s) for s in split], np.int64)
        new: dict[str, int] = {}
        known = self.known
        for parts in split:
            for p in parts:
                if p not in known:
                    new[p] = known[p] = len(known)
        if new:
            data, blocked = [], []
            for p in new:
                # a marker of the text itself is shut out of the pieces
                own = p.replace(" ", MARKER).encode("utf-8", "surrogatepass")
                data.append(own)
                if MARKER in p:
                    mark = b"".join(b"\1\1\1" if c == MARKER else bytes(len((MARKER if c == " " else c).encode("utf-8", "surrogatepass"))) for c in p)
                else:
                    mark = bytes(len(own))
                blocked.append(mark)
            flat, sizes = solve(data, blocked, self.vocab)
            self.flat.append(flat)
            self.sizes.append(sizes)
        flat, sizes = np.concatenate(self.flat), np.concatenate(self.sizes)
        self.flat, self.sizes = [flat], [sizes]
        starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        total = int(counts.sum())
        part = np.fromiter((known[p] for parts in split for p in parts), np.int64, total)
        lengths = sizes[part] if total else np.zeros(0, np.int64)
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        ids = flat[np.repeat(starts[part] - offsets[:-1], lengths) + np.arange(offsets[-1])] if total else np.zeros(0, np.int32)
        bounds = np.concatenate([[0], np.cumsum(counts)])
        if any(len(p) > REMEMBERED_BYTES for p in new):
            self.forget()
        return ids, offsets[bounds[1:]] - offsets[bounds[:-1]]

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The texts of ids laid end to end."""
        table = self.byte_of
        texts, at = [], 0
        marker = MARKER.encode()
        first, last = self.vocab.first_byte, self.vocab.first_byte + 256
        for n in counts.tolist():
            own = ids[at : at + n]
            at += n
            plain = (own >= first) & (own < last)
            if plain.any():
                # markers in byte pieces are text, those in other pieces are spaces
                out = b"".join(table[i] if first <= i < last else table[i].replace(marker, b" ") for i in own.tolist())
            else:
                out = b"".join([table[i] for i in own.tolist()]).replace(marker, b" ")
            texts.append(out[1:].decode("utf-8", "surrogatepass"))
        return texts


def encoded(docs: DataFrame, vocab: Vocabulary, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: all), ``ids``, and ``round_trip``: whether decoding them gives the text.

    Rows leave in small batches, ids as one flat array each, so memory does not grow with
    the size of a batch that comes in.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocab)
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("ids", "round_trip")]
    rows = docs.select(*[quoted(c) for c in keep], quoted(text_col).alias("__text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(shared.value)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                some = batch.slice(start, ROWS)
                texts = some.column(len(keep)).to_pylist()
                ids, counts = coder.encode([t or "" for t in texts])
                ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                none = np.array([t is None for t in texts], bool)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(ids, pa.int32()), mask=pa.array(none))
                same = [t is None or t == d for t, d in zip(texts, coder.decode(ids, counts))]
                yield pa.RecordBatch.from_arrays(
                    [*some.columns[: len(keep)], lists, pa.array(same, pa.bool_())], names=[*keep, "ids", "round_trip"]
                )

    schema = T.StructType([*[rows.schema[c] for c in keep], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("round_trip", T.BooleanType())])
    return rows.mapInArrow(encode, schema)
