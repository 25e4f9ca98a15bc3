"""Join of texts whose word shingles have a Jaccard similarity of at least a threshold.

Texts with the same set of five-word shingles are one class and stand for each other.
Every class gets a MinHash signature of ``TREES`` labels of ``DEPTH`` values. A tree is a
prefix trie of its labels, held as sorted labels with the length of the prefix that
neighbours share:

1. Labels that agree in the shortest prefix meet: that is the length at which two sets at
   the threshold share a prefix in some tree with probability ``target_recall`` (4 of 8
   values in 16 trees for 0.8 give 0.9997). There they are sorted.
2. Matched prefixes are compared at full depth first, by whole signatures; pairs well below
   the threshold end here. Then the prefix is shortened value by value, and only classes
   that are not yet connected meet in the larger subtree; a subtree whose classes are all
   connected is done. This goes on until the target recall is reached.
3. What agrees are the edges of a spanning forest of each subtree. Connected candidates
   form components; shingle sets go to their component once, and all pairs in it are
   compared exactly.

A group or component of any size is cut into blocks, and each pair of blocks is one
unit of work of bounded size, so no task and no shuffle key holds a whole hot group.
Per class the number of linked documents is summed; pairs are never written out.

Defined results: texts of 1 to 4 words are one shingle. A text without words (null,
empty) has no shingle and no link; it is a class of its own. Copies of a row are
documents of their own. Classes are told apart by a 64-bit hash of their sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratingml.llm.common import stored
from ratingml.llm.fm_decontam import words_of

WORDS = 5
THRESHOLD = 0.8
TREES = 16
DEPTH = 8
TARGET_RECALL = 0.999
#: Standard deviations of the signature's estimate below the threshold at which a pair ends.
MARGIN = 4.5
#: Members of a block, and shingles of a block of whole sets.
BLOCK = 512
BLOCK_SHINGLES = 1_000_000

_rng = np.random.default_rng(20_240_229)
_FACTORS = _rng.integers(1, 1 << 32, TREES * DEPTH, dtype=np.uint32) | np.uint32(1)
_OFFSETS = _rng.integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint32)


def prefix_length(threshold: float, target: float = TARGET_RECALL, trees: int = TREES, depth: int = DEPTH) -> int:
    """Shorten the prefix until pairs at the threshold share one in some tree often enough."""
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < target:
        depth -= 1
    return depth


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class _Hashes(dict):
    """64-bit hash of a word, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def shingles(text: str | None, known: _Hashes, words: int = WORDS) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    found = words_of(text)
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
    n = max(1, len(h) - words + 1)
    total = np.zeros(n, np.uint64)
    for i in range(min(words, len(h))):
        total = total * np.uint64(0x9E3779B97F4A7C15) + _mixed(h[i : i + n] + np.uint64(i))
    return np.unique(_mixed(total))


def set_id(members: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(members.tobytes(), digest_size=8).digest(), "little", signed=True)


def signature(members: np.ndarray) -> np.ndarray:
    """The lowest value of each hash function, 16 bits each."""
    low = (members >> np.uint64(32)).astype(np.uint32)
    out = np.empty(TREES * DEPTH, np.uint32)
    step = max(1, (1 << 18) // max(1, len(low)))
    for at in range(0, len(out), step):
        values = low[None, :] * _FACTORS[at : at + step, None] + _OFFSETS[at : at + step, None]
        # the high bits of a product mix best
        out[at : at + step] = (values ^ (values >> np.uint32(15))).min(1)
    return (out * np.uint32(0x9E3779B1) >> np.uint32(16)).astype("<u2")


def _id_key(id_col: Column) -> Column:
    return F.coalesce(id_col, F.lit(-(1 << 63)))


def signed(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """``id, text_hash, class, n_shingles, sig`` of every row; null class without words."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Hashes()
        for batch in batches:
            rows = []
            done: dict[str, tuple] = {}
            for text in batch["text"]:
                text = text if isinstance(text, str) else ""
                if text not in done:
                    own = shingles(text, known, words)
                    done[text] = (set_id(own), len(own), signature(own).tobytes()) if len(own) else (None, 0, None)
                rows.append(done[text])
            frame = pd.DataFrame(rows, columns=["class", "n_shingles", "sig"])
            # a column with nulls would turn the 64-bit numbers into floats
            frame["class"] = pd.array([r[0] for r in rows], dtype="Int64")
            frame.insert(0, "text_hash", batch["text_hash"].to_numpy())
            frame.insert(0, "id", batch["id"])
            yield frame

    rows = docs.select(
        F.col(id_col).cast("string").alias("id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text")
    )
    out = rows.mapInPandas(sign, "id string, text_hash long, class long, n_shingles long, sig binary")
    return out.withColumn("id", F.col("id").cast("long"))


def _runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Rows sorted by the keys in frames that never cut a group; a frame has whole groups."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        last = tuple(batch[k].iloc[-1] for k in keys)
        same = np.logical_and.reduce([(batch[k] == v).to_numpy() for k, v in zip(keys, last)])
        begin = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        first = tuple(batch[k].iloc[0] for k in keys)
        if held and tuple(held[-1][k].iloc[-1] for k in keys) != first:
            yield pd.concat(held, ignore_index=True)
            held = []
        if begin:
            yield pd.concat([*held, batch.iloc[:begin]], ignore_index=True)
            held = []
        held.append(batch.iloc[begin:])
    if held:
        yield pd.concat(held, ignore_index=True)


def _bounds(frame: pd.DataFrame, keys: list[str]) -> np.ndarray:
    new = np.zeros(len(frame), bool)
    new[:1] = True
    for k in keys:
        values = frame[k].to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return np.append(np.flatnonzero(new), len(frame))


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member that each of n members is connected with."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        while (new != new[new]).any():
            new = new[new]
        new = new[label]
        if (new == label).all():
            break
        label = new
    return label


def in_blocks(rows: DataFrame, key: str, sizes: DataFrame, member: str) -> DataFrame:
    """Deal the members of each group to pairs of blocks: adds ``lo``, ``hi`` and ``block``.

    ``sizes`` has ``key`` and ``blocks``. A group of one block is one unit; a member of
    a group of n blocks is in n units.
    """
    joined = rows.join(sizes, key)
    own = F.pmod(F.xxhash64(member, F.lit(11)), F.col("blocks")).cast("int")
    joined = joined.withColumn("block", own)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    joined = joined.withColumn("other", other)
    return joined.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other")).drop("other", "blocks")


def _units(rows: DataFrame, key: str) -> DataFrame:
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, key, "lo", "hi").sortWithinPartitions(key, "lo", "hi")


def sorted_trie(unit: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts the labels of each unit, and the prefix length each shares with the one before (-1 at a new unit)."""
    order = np.lexsort((*labels.T[::-1], unit))
    rows, owner = labels[order], unit[order]
    shared = np.full(len(order), -1)
    same = np.cumprod(rows[1:] == rows[:-1], axis=1).sum(1)
    shared[1:] = np.where(owner[1:] == owner[:-1], same, -1)
    return order, shared


def descend(
    shared: np.ndarray, sides: np.ndarray, shortest: int, agree: Callable[[np.ndarray, np.ndarray], np.ndarray], batch: int = 100_000
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sorted labels that agree, from whole labels down to the shortest prefix.

    ``sides`` is 0 or 1 where only members of different blocks are compared, -1 elsewhere. A pair that
    agreeing pairs already connect is left out, so what comes back connects what all pairs would.
    """
    n = len(shared)
    root = np.arange(n)
    inner = np.arange(n)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    waiting: list[tuple[np.ndarray, np.ndarray]] = []

    def settle() -> None:
        nonlocal root
        if waiting:
            a, b = (np.concatenate([w[i] for w in waiting]) for i in (0, 1))
            waiting.clear()
            good = agree(a, b)
            a, b = a[good], b[good]
            found.append((a, b))
            root = _roots(n, root[a], root[b])[root]

    for depth in range(DEPTH, shortest - 1, -1):
        new = shared < depth
        subtree = np.cumsum(new) - 1
        begins = np.append(np.flatnonzero(new), n)
        # subtrees of one connected class need no longer reach
        first = root[begins[:-1]]
        apart = np.zeros(len(begins) - 1, bool)
        np.logical_or.at(apart, subtree, root != first[subtree])
        size = 0
        for at in np.flatnonzero(apart).tolist():
            start, end = int(begins[at]), int(begins[at + 1])
            step, i = 8, start
            while i < end:
                own, others = np.arange(i, min(end, i + step)), np.arange(i, end)
                keep = (own[:, None] < others[None, :]) & (root[own][:, None] != root[None, i:end])
                if depth < DEPTH:
                    keep &= inner[own][:, None] != inner[None, i:end]
                if sides[start] >= 0:
                    keep &= sides[own][:, None] != sides[None, i:end]
                x, y = np.nonzero(keep)
                if len(x):
                    waiting.append((own[x], others[y]))
                    size += len(x)
                i += step
                # the first members of a large subtree connect most of it
                step = min(256, 2 * step)
                if size > batch or end - start > 64:
                    settle()
                    size = 0
                    if (root[start:end] == root[start]).all():
                        break
        settle()
        inner = subtree
    a, b = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in (0, 1))
    return a, b


def candidates(classes: DataFrame, depth: int, threshold: float) -> DataFrame:
    """Edges ``a, b`` of spanning forests of the classes that agree by signature; ``depth`` is the shortest prefix."""
    floor = int(np.floor(TREES * DEPTH * (threshold - MARGIN * np.sqrt(threshold * (1 - threshold) / (TREES * DEPTH)))))
    width = 2 * DEPTH
    prefixes = F.array(
        *[F.xxhash64(F.lit(t), F.substring("sig", t * width + 1, 2 * depth)) for t in range(TREES)]
    )
    placed = classes.select("class", F.posexplode(prefixes).alias("tree", "prefix"))
    placed = stored(placed.select("class", "tree", "prefix"), "forest-prefixes")
    sizes = placed.groupBy("prefix").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    sizes = sizes.select("prefix", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    shared = stored(in_blocks(placed, "prefix", sizes, "class"), "forest-shared")
    rows = _units(shared.join(classes.select("class", "sig"), "class"), "prefix")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _runs(batches, ["prefix", "lo", "hi"]):
            bounds = _bounds(frame, ["prefix", "lo", "hi"])
            unit = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            sigs = np.frombuffer(b"".join(frame["sig"]), "<u2").reshape(-1, TREES * DEPTH)
            tree = frame["tree"].to_numpy()
            order, common = sorted_trie(unit, sigs.reshape(-1, TREES, DEPTH)[np.arange(len(sigs)), tree])
            sigs, tree, ids = sigs[order], tree[order], frame["class"].to_numpy()[order]
            block, lo, hi = (frame[c].to_numpy()[order] for c in ("block", "lo", "hi"))
            owned: list[tuple[np.ndarray, np.ndarray]] = []

            def agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
                good = np.zeros(len(a), bool)
                for at in range(0, len(a), 100_000):
                    x, y = a[at : at + 100_000], b[at : at + 100_000]
                    same = sigs[x] == sigs[y]
                    part = same.sum(1) >= floor
                    good[at : at + 100_000] = part
                    x, y, same = x[part], y[part], same[part]
                    # the first tree in which they share the prefix writes the pair; later ones only use it
                    first = same.reshape(-1, TREES, DEPTH)[:, :, :depth].all(2).argmax(1)
                    own = first == tree[x]
                    owned.append((x[own], y[own]))
                return good

            descend(common, np.where(lo == hi, -1, (block == hi).astype(int)), depth, agree)
            a, b = (np.concatenate([f[i] for f in owned]) if owned else np.zeros(0, np.int64) for i in (0, 1))
            root = _roots(len(frame), a, b)
            linked = np.flatnonzero(root != np.arange(len(frame)))
            yield pd.DataFrame({"a": ids[linked], "b": ids[root[linked]]})

    return rows.select("class", "tree", "prefix", "lo", "hi", "block", "sig").mapInPandas(compare, "a long, b long")


def components(edges: DataFrame, name: str) -> DataFrame:
    """``node, root`` for all nodes of the edges; alternates large and small stars until nothing changes.

    Every round goes to the shared folder; the driver sees two numbers per round.
    """
    edges = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    mark = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stored(large.filter("a <> b").distinct(), name)
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").select(F.col("b").alias("x"), "m").filter("x <> m").union(lowest.select("a", "m"))
        edges = stored(small.toDF("a", "b").distinct(), name)
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of a few sets."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    values, place, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # what one set alone has is in no intersection
    often = counts > 1
    column = np.cumsum(often) - 1
    keep = often[place]
    owner, column = owner[keep], column[place[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((n, n), np.float32)
    width = max(64, 4_000_000 // max(1, n))
    for begin in range(0, int(often.sum()), width):
        a, b = np.searchsorted(column, [begin, begin + width])
        part = np.zeros((n, min(width, int(often.sum()) - begin)), np.float32)
        part[owner[a:b], column[a:b] - begin] = 1
        # exact: no count reaches 2**24 within a chunk of this width
        out += part @ part.T
    return out.astype(np.int64)


def verified(members: DataFrame, threshold: float) -> DataFrame:
    """``a, b, n``: per unit the linked documents of each class (b = a), and spanning edges (n = 0)."""
    rows = _units(members, "root")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _runs(batches, ["root", "lo", "hi"]):
            bounds = _bounds(frame, ["root", "lo", "hi"])
            ids, n_docs = frame["class"].to_numpy(), frame["n_docs"].to_numpy()
            block, lo, hi = (frame[c].to_numpy() for c in ("block", "lo", "hi"))
            raw = frame["members"].tolist()
            out = []
            for start, end in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                if end - start < 2:
                    continue
                sets = [np.frombuffer(s, "<u8") for s in raw[start:end]]
                size = np.array([len(s) for s in sets])
                inter = shared_counts(sets)
                union = size[:, None] + size[None, :] - inter
                linked = inter >= threshold * union - 1e-9 * union
                np.fill_diagonal(linked, False)
                if lo[start] != hi[start]:
                    own = block[start:end]
                    linked &= own[:, None] != own[None, :]
                totals = linked @ n_docs[start:end]
                a, b = np.nonzero(np.triu(linked))
                root = _roots(end - start, a, b)
                some = np.flatnonzero(totals)
                out.append(np.stack([ids[start:end][some], ids[start:end][some], totals[some]], 1))
                away = np.flatnonzero(root != np.arange(end - start))
                out.append(np.stack([ids[start:end][away], ids[start:end][root[away]], np.zeros(len(away), np.int64)], 1))
            table = np.concatenate(out) if out else np.zeros((0, 3), np.int64)
            yield pd.DataFrame(table, columns=["a", "b", "n"])

    return rows.select("class", "n_docs", "root", "lo", "hi", "block", "members").mapInPandas(compare, "a long, b long, n long")


def with_sets(docs: DataFrame, reps: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """``class, members`` of the chosen classes, made again from the text of one document each."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Hashes()
        for batch in batches:
            sets = [shingles(t, known, words).astype("<u8").tobytes() for t in batch["text"]]
            yield pd.DataFrame({"class": batch["class"], "members": sets})

    rows = docs.select(_id_key(F.col(id_col)).alias("__id"), F.xxhash64(F.col(text_col)).alias("__hash"), F.col(text_col).alias("text"))
    # the list grows with the documents, so it is never sent to all tasks; the plan is the same at every size
    chosen = rows.join(reps.hint("merge"), (F.col("__id") == F.col("rep")) & (F.col("__hash") == F.col("rep_hash")))
    return chosen.select("class", "text").mapInPandas(make, "class long, members binary")


def joined(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, words: int = WORDS, target_recall: float = TARGET_RECALL
) -> DataFrame:
    """One row per document: ``id, class_id, n_links, text_hash, lead_hash``.

    ``class_id`` is the smallest id of all documents that links connect (the document's
    own id without any link); ``n_links`` counts the other documents at or above the threshold.
    """
    depth = prefix_length(threshold, target_recall)
    all_rows = stored(signed(docs, id_col, text_col, words), "forest-signed")
    rows = all_rows.filter("class IS NOT NULL")
    classes = rows.groupBy("class").agg(
        F.min(F.struct(_id_key(F.col("id")).alias("id"), "text_hash")).alias("rep"),
        F.count(F.lit(1)).alias("n_docs"),
        F.max("n_shingles").alias("n_shingles"),
        F.first("sig").alias("sig"),
    )
    classes = stored(
        classes.select("class", F.col("rep.id").alias("rep"), F.col("rep.text_hash").alias("rep_hash"), "n_docs", "n_shingles", "sig"),
        "forest-classes",
    )
    maybe = components(candidates(classes, depth, threshold), "forest-maybe")
    picked = classes.drop("sig").join(maybe, F.col("class") == F.col("node")).drop("node")
    picked = stored(picked, "forest-picked")
    sizes = picked.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("s"))
    sizes = sizes.select("root", F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("s") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    sets = with_sets(docs, picked.select("class", "rep", "rep_hash"), id_col, text_col, words)
    # repeated rows of one document give its set more than once
    sets = stored(sets.groupBy("class").agg(F.first("members").alias("members")), "forest-sets")
    dealt = in_blocks(picked.select("class", "n_docs", "root"), "root", sizes, "class")
    found = stored(verified(dealt.join(sets, "class"), threshold), "forest-found")
    links = found.filter("n > 0").groupBy(F.col("a").alias("class")).agg(F.sum("n").alias("links"))
    roots = components(found.filter("n = 0").select("a", "b"), "forest-roots").withColumnRenamed("node", "class")
    grouped = classes.select("class", "rep", "rep_hash", "n_docs").join(roots, "class", "left").join(links, "class", "left")
    grouped = stored(grouped.withColumn("root", F.coalesce("root", "class")), "forest-grouped")
    first = grouped.groupBy("root").agg(F.min(F.struct("rep", "rep_hash")).alias("lead"))
    first = first.select("root", F.col("lead.rep").alias("first"), F.col("lead.rep_hash").alias("first_hash"))
    total = F.col("n_docs") - 1 + F.coalesce("links", F.lit(0))
    result = grouped.join(first, "root").select("class", "first", "first_hash", total.alias("n_links"))
    null_id = F.lit(-(1 << 63))
    out = all_rows.select("id", "text_hash", "class").join(result, "class", "left")
    return out.select(
        F.col("id").alias(id_col),
        F.when(F.col("first").isNull(), F.col("id")).when(F.col("first") != null_id, F.col("first")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        "text_hash",
        F.coalesce("first_hash", "text_hash").alias("lead_hash"),
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One document of each connected group: the one with the smallest id and, among equal or null ids, text hash.

    Repeated rows of that document are one row of the result. Texts without words stay.
    """
    found = joined(docs, id_col, text_col, **options)
    keyed = found.select(F.col(id_col).alias("__own"), "class_id", F.col("text_hash").alias("__hash"), "lead_hash")
    counts = stored(keyed.groupBy("__own", "class_id", "__hash", "lead_hash").agg(F.count(F.lit(1)).alias("__n")), "forest-kept")
    same = F.col(id_col).eqNullSafe(F.col("__own")) & (F.xxhash64(F.col(text_col)) == F.col("__hash"))
    leads = F.col("__own").eqNullSafe(F.col("class_id")) & (F.col("__hash") == F.col("lead_hash"))
    # few rows go, so those are the side that is sent around
    once = docs.join(counts.filter(~leads | (F.col("__n") > 1)), same, "left_anti")
    copies = docs.join(counts.filter(leads & (F.col("__n") > 1)), same, "left_semi")
    return once.unionByName(copies.dropDuplicates([id_col, text_col]))
