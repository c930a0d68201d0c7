"""N-gram Jaccard join: exact links between documents, found with signature trees."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marquee.llm.arrays import give_back, hash_runs, mix64, owners, parts, runs, tidy
from marquee.llm.components import connected
from marquee.llm.shared import join_groups
from marquee.session import durable

#: Share of the shingle hashes that the repeat test looks at, in terms of the distance allowed.
SAMPLE = 3
#: Shingles of one bucket of the repeat test.
BUCKET_SHINGLES = 2_000_000
#: A tree holds about so many sets, and so many shingles.
TREE_SETS, TREE_SHINGLES = 4_000, 4_000_000
LEAF, FAN = 16, 8
#: Characters of the texts whose shingles are held at once, and sets whose bitmaps are made at once.
PORTION, BITMAPS = 8_000_000, 512
#: A group of more shingles leaves enough behind to be given back.
LARGE_GROUP = 500_000
#: 64-bit words of the filter by which texts of sets without a possible partner stay where they are.
FILTER_WORDS = 1 << 19


# --- shingle sets ---------------------------------------------------------------------------


def shingle_sets(texts: list[str], width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each whole text.

    Words are runs of characters other than ASCII white space, with A-Z in lower case; a text
    of fewer words than ``width`` has its whole sequence as one shingle, a text without words
    none.
    """
    blank = np.zeros(256, dtype=bool)
    blank[[9, 10, 11, 12, 13, 32]] = True
    for a, b in parts(texts):
        raw = [t.encode("utf-8", "surrogatepass").lower() for t in texts[a:b]]
        codes = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
        bounds = np.concatenate(([0], np.cumsum([len(r) + 1 for r in raw])))
        begins, ends = runs(~blank[codes])
        words = hash_runs(codes, begins, ends)
        owner = owners(begins, bounds)
        first = np.searchsorted(owner, np.arange(len(raw) + 1))
        step = np.uint64(0x9E3779B97F4A7C15)
        rolled = words.copy()
        for k in range(1, width):
            later = np.zeros_like(words)
            later[:-k] = words[k:]
            rolled = mix64(rolled * step + later)
        for i in range(len(raw)):
            lo, hi = first[i], first[i + 1]
            if hi - lo >= width:
                yield np.unique(rolled[lo : hi - width + 1])
            elif hi > lo:
                value = np.zeros(1, dtype=np.uint64)
                for w in words[lo:hi]:
                    value = mix64(value * step + w + np.uint64(hi - lo))
                yield value
            else:
                yield words[:0]


def set_key(shingles: np.ndarray) -> str:
    """Name of a set; equal sets have equal names."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).hexdigest()


def described(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """_id, _n (set size), _set (its name) of each document with a key."""

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets = [(len(s), set_key(s)) for s in shingle_sets([t or "" for t in batch["_text"]], width)]
            yield pd.DataFrame(
                {"_id": batch["_id"], "_n": [s[0] for s in sets], "_set": [s[1] for s in sets]}
            )

    kind = docs.schema[key].dataType.simpleString()
    return (
        docs.where(F.col(key).isNotNull())
        .select(F.col(key).alias("_id"), F.col(text).alias("_text"))
        .mapInPandas(tidy(describe), f"_id {kind}, _n long, _set string")
    )


# --- which sets can have a partner ----------------------------------------------------------


def _sender(width: int, share: float, buckets: int):
    limit = np.uint64(min(int(share * 2.0**64), 2**64 - 1))
    low_bits = np.uint64(max(1, buckets))

    def portion(texts: list[str], seen: set[str]) -> pd.DataFrame:
        names, picked = [], []
        for shingles in shingle_sets(texts, width):
            name = set_key(shingles)
            if name not in seen:
                seen.add(name)
                picked.append(shingles[: np.searchsorted(shingles, limit)].copy())
                names.append(bytes.fromhex(name))
        sizes = [len(p) for p in picked]
        rows: list[tuple[int, bytes, bytes, bytes]] = []
        if sum(sizes):
            hashes, who = np.concatenate(picked), np.repeat(np.arange(len(sizes), dtype=np.uint32), sizes)
            del picked
            # Two sets of a portion settle a shingle for everybody, so no more are sent.
            order = np.argsort(hashes, kind="stable")
            hashes, who = hashes[order], who[order]
            third = np.zeros(len(hashes), dtype=bool)
            third[2:] = hashes[2:] == hashes[:-2]
            hashes, who = hashes[~third], who[~third]
            bucket = (mix64(hashes) % low_bits).astype(np.int64)
            order = np.lexsort((who, bucket))
            edges = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1))
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                mine = order[a:b]
                present, local = np.unique(who[mine], return_inverse=True)
                rows.append(
                    (
                        int(bucket[mine[0]]),
                        b"".join(names[i] for i in present),
                        local.astype("<u4").tobytes(),
                        hashes[mine].tobytes(),
                    )
                )
        return pd.DataFrame(rows, columns=["_bucket", "_names", "_who", "_hashes"])

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, seen = [t or "" for t in batch["_text"]], set()
            for a, b in parts(texts, PORTION):
                yield portion(texts[a:b], seen)

    return send


def lonely_shingles(docs: DataFrame, text: str, width: int, share: float, buckets: int) -> DataFrame:
    """_set, _lonely: how many of the sampled shingles of a set occur in no other set.

    Shingles whose hash lies in the lowest ``share`` of all values are sampled, alike in every
    set.  A portion of a batch sends each of them, packed, to the bucket of its hash, with two of its
    sets at most: a bucket need only know whether there is a second one.
    """
    low_bits = np.uint64(max(1, buckets))

    def count(frame: pd.DataFrame) -> pd.DataFrame:
        names = [np.frombuffer(n, dtype="V16") for n in frame["_names"]]
        offset = np.concatenate(([0], np.cumsum([len(n) for n in names])))
        who = np.concatenate(
            [np.frombuffer(w, dtype="<u4") + o for w, o in zip(frame["_who"], offset[:-1], strict=True)]
        )
        known, owner = np.unique(np.concatenate(names), return_inverse=True)
        hashes = np.frombuffer(b"".join(frame["_hashes"]), dtype=np.uint64)
        owner = owner.ravel()[who]
        order = np.lexsort((owner, hashes))
        hashes, owner = hashes[order], owner[order]
        fresh = np.ones(len(hashes), dtype=bool)
        fresh[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
        hashes, owner = hashes[fresh], owner[fresh]
        same = hashes[1:] == hashes[:-1]
        alone = np.ones(len(hashes), dtype=bool)
        alone[1:] &= ~same
        alone[:-1] &= ~same
        totals = np.bincount(owner[alone], minlength=len(known))
        # Packed again, by set: the part of a set that names the place where its counts meet.
        hit = np.flatnonzero(totals)
        names, totals = known[hit], totals[hit]
        place = names.view(np.uint64).reshape(-1, 2)[:, 0] % low_bits if len(hit) else np.zeros(0, dtype=np.uint64)
        order = np.argsort(place, kind="stable")
        edges = np.flatnonzero(np.diff(place[order].astype(np.int64), prepend=-1, append=-1))
        rows = [
            (int(place[order[a]]), names[order[a:b]].tobytes(), totals[order[a:b]].astype("<u4").tobytes())
            for a, b in zip(edges[:-1], edges[1:], strict=True)
        ]
        give_back()
        return pd.DataFrame(rows, columns=["_place", "_names", "_counts"])

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        names = np.frombuffer(b"".join(frame["_names"]), dtype="V16")
        counts = np.frombuffer(b"".join(frame["_counts"]), dtype="<u4")
        known, owner = np.unique(names, return_inverse=True)
        totals = np.bincount(owner.ravel(), weights=counts, minlength=len(known)).astype(np.int64)
        return pd.DataFrame({"_set": [n.tobytes().hex() for n in known], "_lonely": totals})

    sent = docs.select(F.col(text).alias("_text")).mapInPandas(
        tidy(_sender(width, share, buckets)), "_bucket long, _names binary, _who binary, _hashes binary"
    )
    counted = sent.groupBy("_bucket").applyInPandas(count, "_place long, _names binary, _counts binary")
    return counted.groupBy("_place").applyInPandas(add, "_set string, _lonely long")


def likely(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The rows of ``docs`` (_key, ...) whose key may be a ``_first`` of ``classes``: all that are, few others.

    The filter is broadcast and has FILTER_WORDS words at every size.  Beyond some ten million
    classes it lets more and more other rows pass, which the join that follows takes out.
    """
    word = lambda c: F.shiftright(F.xxhash64(c), 6).bitwiseAND(F.lit(FILTER_WORDS - 1))
    bit = lambda c: F.expr(f"shiftleft(1L, CAST(xxhash64({c}) & 63 AS INT))")
    words = classes.groupBy(word("_first").alias("_word")).agg(F.bit_or(bit("_first")).alias("_bits"))
    found = docs.join(F.broadcast(words), word("_key") == F.col("_word"))
    return found.where(F.col("_bits").bitwiseAND(bit("_key")) != 0).drop("_word", "_bits")


def sets_of(docs: DataFrame, classes: DataFrame, twice: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """_set, _n, _shingles of the classes (_set, _first): the set of the document ``_first``.

    Only keys in ``twice`` (_id) have more than one row; their rows alone are compared again.
    """
    chosen = (
        likely(docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")), classes)
        .join(classes, F.col("_key") == F.col("_first"))
        .select("_set", "_first", "_text")
    )

    def hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            names, texts = batch["_set"].tolist(), [t or "" for t in batch["_text"]]
            for a, b in parts(texts, PORTION):
                rows = [
                    (name, len(s), s.view(np.int64))
                    for name, s in zip(names[a:b], shingle_sets(texts[a:b], width), strict=True)
                    if set_key(s) == name
                ]
                yield pd.DataFrame(rows, columns=["_set", "_n", "_shingles"])

    def made(rows: DataFrame) -> DataFrame:
        return rows.select("_set", "_text").mapInPandas(tidy(hashes), "_set string, _n long, _shingles array<long>")

    if twice.isEmpty():
        return made(chosen)
    again = F.col("_first") == F.col("_id")
    return made(chosen.join(twice, again, "left_anti")).unionByName(
        # Rows with one key and text give one set.
        made(chosen.join(twice, again, "left_semi")).dropDuplicates(["_set"])
    )


def families(sets: DataFrame, num: int, den: int, share: float) -> DataFrame:
    """_no, _family: sets that can link are in one family.

    In any one order of all shingles, two sets that reach the threshold share one of the first
    (1 - threshold) of the shingles of each, and their sizes differ by that factor at most.  The
    order is that of sampled shingles (the lowest ``share`` of the hashes) from the rarest on, then
    the others by hash; so only the sample is counted and shuffled.  Sets with a common shingle
    there and sizes in the same or the next power of the factor are put together.
    """
    limit = min(int(share * 2.0**64), 2**64 - 1)
    low = F.filter("_shingles", lambda x: x.bitwiseXOR(F.lit(-(2**63))) < F.lit(limit - 2**63))
    prefix = (F.col("_n") - F.ceil(F.col("_n") * num / den) + 1).cast("int")
    power = F.floor(F.log(F.col("_n")) / float(np.log(den / num)) + 1e-9) if den > num else F.col("_n")
    described_sets = sets.select(
        "_no", prefix.alias("_prefix"), power.cast("int").alias("_power"), low.alias("_low"), "_shingles"
    ).withColumn("_sampled", F.size("_low"))
    about = ("_no", "_power", "_prefix", "_sampled")
    entries = described_sets.select(*about, F.explode("_low").alias("_shingle"))
    total = described_sets.agg(F.sum("_sampled")).first()[0] or 0
    often = entries.groupBy("_shingle").agg(F.count("*").alias("_df")).where("_df > 1")
    shared = join_groups(entries, durable(often), "_shingle", "_df", total).where("_facts IS NOT NULL")
    # Sampled shingles of one set alone are the rarest and meet nobody: they only take up places.
    rare = (
        shared.groupBy(*about)
        .agg(F.sort_array(F.collect_list(F.struct(F.col("_facts._df").alias("df"), F.col("_shingle").alias("x")))).alias("_s"))
        .withColumn("_places", F.greatest(F.lit(0), F.col("_prefix") - F.col("_sampled") + F.size("_s")))
        .select("_no", "_power", F.explode(F.slice("_s", F.lit(1), F.col("_places"))["x"]).alias("_shingle"))
    )
    # The shingles are in hash order, so the first ones after the sample follow it.
    beyond = described_sets.where("_prefix > _sampled").select(
        "_no",
        "_power",
        F.explode(F.slice("_shingles", F.col("_sampled") + 1, F.col("_prefix") - F.col("_sampled"))).alias("_shingle"),
    )
    joined = durable(
        rare.unionByName(beyond)
        .select("_no", F.explode(F.array("_power", F.col("_power") + 1)).alias("_power"), "_shingle")
        .select("_no", F.xxhash64("_shingle", "_power").alias("_group"))
    )
    hubs = joined.groupBy("_group").agg(F.min("_no").alias("_hub"), F.count("*").alias("_size")).where("_size > 1")
    members = join_groups(joined, durable(hubs), "_group", "_size", joined.count()).where("_facts IS NOT NULL")
    edges = members.select(F.col("_no").alias("a"), F.col("_facts._hub").alias("b")).where("a != b")
    found = connected(edges)
    return found.select(F.col("node").alias("_no"), F.col("label").alias("_family"))


# --- signature trees ------------------------------------------------------------------------


class Level(NamedTuple):
    """Nodes of one height: ranges of the sorted sets, OR of their bitmaps, sizes, collisions."""

    begin: np.ndarray
    end: np.ndarray
    bits: np.ndarray
    low: np.ndarray
    high: np.ndarray
    slack: np.ndarray


def tree(bits: np.ndarray, sizes: np.ndarray) -> list[Level]:
    """Levels of a signature tree over sets in size order, leaves first, one root last.

    A node's bitmap is the OR of those below; ``slack`` is the most shingles that any of its
    sets has beyond its bits, so a set meets another in at most (common bits + slack) shingles.
    """
    slack = sizes - np.bitwise_count(bits).sum(axis=1).astype(np.int64)
    begin = np.arange(0, len(sizes), LEAF)
    first = True
    levels: list[Level] = []
    while True:
        if first:
            end = np.minimum(begin + LEAF, len(sizes))
            level = Level(
                begin, end, np.bitwise_or.reduceat(bits, begin, axis=0), sizes[begin], sizes[end - 1],
                np.maximum.reduceat(slack, begin),
            )
            first = False
        else:
            below = levels[-1]
            at = np.arange(0, len(below.begin), FAN)
            level = Level(
                below.begin[at], below.end[np.minimum(at + FAN, len(below.begin)) - 1],
                np.bitwise_or.reduceat(below.bits, at, axis=0),
                np.minimum.reduceat(below.low, at), np.maximum.reduceat(below.high, at),
                np.maximum.reduceat(below.slack, at),
            )
        levels.append(level)
        if len(level.begin) == 1:
            return levels


def bitmaps(flat: np.ndarray, start: np.ndarray, width: int) -> np.ndarray:
    """A bitmap of ``width`` bits of each set, ``flat[start[i]:start[i + 1]]``: the low bits of its shingles."""
    out = []
    for a in range(0, len(start) - 1, BITMAPS):
        bounds = start[a : a + BITMAPS + 1]
        marks = np.zeros((len(bounds) - 1, width), dtype=bool)
        low = (flat[bounds[0] : bounds[-1]] & np.uint64(width - 1)).astype(np.int64)
        marks[np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)), low] = True
        out.append(np.packbits(marks, axis=1).view(np.uint64))
    return np.concatenate(out)


def ranks(values: np.ndarray) -> np.ndarray:
    """For each value how many smaller different ones there are; at most 2^31 values."""
    order = np.argsort(values)
    out = np.empty(len(values), dtype=np.int32)
    fresh = np.diff(values[order], prepend=values[order[:1]]) != 0
    out[order] = np.cumsum(fresh, dtype=np.int32)
    return out


def links(
    sets: list[np.ndarray], num: int, den: int, every: bool, side: np.ndarray | None = None
) -> list[tuple[int, int, int]]:
    """Pairs (i, j, common shingles) with den * common >= num * union, by dual traversal.

    A pair of nodes is dropped when sizes differ too much or when the largest possible overlap
    of their sets is too small.  Unless ``every`` pair is wanted, it is also dropped when all
    their sets are linked already: the pairs returned then connect what all pairs would.
    With ``side``, only pairs across the two sides count.
    """
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    least = np.array([s[0] if len(s) else 0 for s in sets], dtype=np.uint64)
    order = np.lexsort((least, sizes))
    sizes = sizes[order]
    flat = np.concatenate([sets[i] for i in order])
    start = np.concatenate(([0], np.cumsum(sizes)))
    width = 256
    while width < 4 * np.median(sizes) and width < 8192:
        width *= 2
    bits = bitmaps(flat, start, width)
    token = ranks(flat)
    del flat
    slack = sizes - np.bitwise_count(bits).sum(axis=1).astype(np.int64)
    levels = tree(bits, sizes)
    group = np.arange(len(sizes))
    sides = None if side is None else np.asarray(side)[order]
    present = np.zeros(token.max() + 1, dtype=bool)
    out: list[tuple[int, int, int]] = []

    def leaf(a: int, b: int) -> None:
        lowest = levels[0]
        to = lowest.end[b]
        for x in range(lowest.begin[a], lowest.end[a]):
            y = np.arange(max(x + 1, lowest.begin[b]), to)
            y = y[den * sizes[x] >= num * sizes[y]]
            if not every:
                y = y[group[y] != group[x]]
            if sides is not None:
                y = y[sides[y] != sides[x]]
            if not len(y):
                continue
            common = np.bitwise_count(bits[y] & bits[x]).sum(axis=1).astype(np.int64)
            most = common + np.minimum(slack[y], slack[x])
            y = y[(num + den) * most >= num * (sizes[x] + sizes[y])]
            if not len(y):
                continue
            mine = token[start[x] : start[x + 1]]
            present[mine] = True
            for part in np.array_split(y, max(1, int(sizes[y].sum()) // 1_000_000)):
                at = np.concatenate([token[start[j] : start[j + 1]] for j in part])
                offsets = np.concatenate(([0], np.cumsum(sizes[part])))[:-1]
                overlap = np.add.reduceat(present[at].astype(np.int64), offsets)
                hit = (num + den) * overlap >= num * (sizes[x] + sizes[part])
                for j, n in zip(part[hit], overlap[hit], strict=True):
                    if every or group[j] != group[x]:
                        out.append((int(order[x]), int(order[j]), int(n)))
                        if group[j] != group[x]:
                            group[group == group[j]] = group[x]
            present[mine] = False

    stack = [(len(levels) - 1, 0, 0)]
    while stack:
        height, a, b = stack.pop()
        level = levels[height]
        if den * level.high[a] < num * level.low[b]:
            continue
        if a != b:
            common = int(np.bitwise_count(level.bits[a] & level.bits[b]).sum())
            most = common + min(level.slack[a], level.slack[b])
            if (num + den) * most < num * (level.low[a] + level.low[b]):
                continue
        if not every:
            one, two = group[level.begin[a] : level.end[a]], group[level.begin[b] : level.end[b]]
            if one[0] == two[0] and (one == one[0]).all() and (two == one[0]).all():
                continue
        if height == 0:
            leaf(a, b)
            continue
        below = len(levels[height - 1].begin)
        left = range(a * FAN, min(a * FAN + FAN, below))
        right = range(b * FAN, min(b * FAN + FAN, below))
        # Pushed last is done first: sets near in size are most likely to link.
        pairs = [(height - 1, i, j) for i in left for j in right if i <= j]
        stack.extend(sorted(pairs, key=lambda p: p[1] - p[2]))
    return out


# --- the join -------------------------------------------------------------------------------


def _linker(num: int, den: int, every: bool, across: bool):
    def link(frame: pd.DataFrame) -> pd.DataFrame:
        names = frame["_set"].tolist()
        sets = [np.asarray(s, dtype=np.int64).view(np.uint64) for s in frame["_shingles"]]
        side = frame["_side"].to_numpy() if across else None
        pairs = links(sets, num, den, every, side)
        if every:
            rows = [(min(names[i], names[j]), max(names[i], names[j]), n) for i, j, n in pairs]
        else:
            rows = _stars(pairs, names)
        if sum(map(len, sets)) > LARGE_GROUP:
            give_back()
        return pd.DataFrame(rows, columns=["a", "b", "common"])

    return link


SCHEMA = "a string, b string, common long"


def _stars(pairs: list[tuple[int, int, int]], names: list[str]) -> list[tuple[str, str, int]]:
    """Links that connect what ``pairs`` connect, from the least name of each component."""
    root = list(range(len(names)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j, _ in pairs:
        one, two = find(i), find(j)
        if names[one] > names[two]:
            one, two = two, one
        root[two] = one
    return [(names[find(i)], names[i], 0) for i in range(len(names)) if find(i) != i]


def set_links(sets: DataFrame, num: int, den: int, every: bool, share: float = 1.0) -> DataFrame:
    """Links (a, b, common) between sets: all of them, or stars that connect what they connect.

    A family makes one signature tree; a large one is dealt into several by a hash.  Each
    tree is traversed against itself, and then every two trees of a family against each other,
    in tasks of their own.  Where connecting is enough, trees are first tied by one set of
    each, and two trees whose sets are all connected by then are left out.
    """
    family = durable(families(sets, num, den, share))
    sized = family.join(sets.select("_no", "_n"), "_no").groupBy("_family").agg(
        F.count("*").alias("_m"), F.sum("_n").alias("_shingle_count")
    )
    # Families of one set have no rows here.
    trees = F.greatest(
        F.ceil(F.col("_m") / TREE_SETS), F.ceil(F.col("_shingle_count") / TREE_SHINGLES)
    ).cast("long")
    known = sized.select("_family", "_m", trees.alias("_trees"))
    total = family.count()
    placed = durable(
        join_groups(family, known, "_family", "_m", total)
        .select(
            "_no", "_family", F.col("_facts._trees").alias("_trees"),
            F.pmod(F.xxhash64("_no"), F.col("_facts._trees")).alias("_tree"),
        )
        .join(sets.select("_no", "_set", "_shingles"), "_no")
        .drop("_no")
    )
    inner = durable(
        placed.groupBy("_family", "_tree").applyInPandas(_linker(num, den, every, False), SCHEMA)
    )
    split = placed.where("_trees > 1")
    if split.isEmpty():  # every family is one tree: no trees are left to compare
        return inner
    if not every:
        first = split.groupBy("_family", "_tree").agg(F.min("_set").alias("_set")).select("_set")
        tied = (
            split.join(first, "_set")
            .withColumn("_part", F.expr(f"_tree div {TREE_SETS}"))
            .groupBy("_family", "_part")
            .applyInPandas(_linker(num, den, every, False), SCHEMA)
        )
        inner = durable(inner.unionByName(tied))
        label = connected(inner)
        split_labels = split.select("_set", "_family", "_tree").join(
            label.withColumnRenamed("node", "_set"), "_set", "left"
        )
        split_labels = split_labels.withColumn("label", F.coalesce("label", "_set"))
    else:
        split_labels = split.select("_set", "_family", "_tree").withColumn("label", F.col("_set"))
    range_of = durable(
        split_labels.groupBy("_family", "_tree").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    )
    one, two = range_of.alias("one"), range_of.alias("two")
    pairs = durable(
        one.join(two, (F.col("one._family") == F.col("two._family")) & (F.col("one._tree") < F.col("two._tree")))
        .where("NOT (one.lo = one.hi AND two.lo = two.hi AND one.lo = two.lo)")
        .select(F.col("one._family").alias("_family"), F.col("one._tree").alias("_t"), F.col("two._tree").alias("_u"))
    )
    sides = pairs.select("_family", "_t", "_u", F.explode(F.array("_t", "_u")).alias("_tree"))
    across = (
        split.join(sides, ["_family", "_tree"])
        .withColumn("_side", (F.col("_tree") == F.col("_t")).cast("int"))
        .groupBy("_family", "_t", "_u")
        .applyInPandas(_linker(num, den, every, True), SCHEMA)
    )
    return durable(inner.unionByName(across))


class Join(NamedTuple):
    """documents: _id, _n, _set.  classes: _set, _n, _first, _size.  links: a, b, common."""

    documents: DataFrame
    classes: DataFrame
    links: DataFrame


def jaccard_join(
    docs: DataFrame,
    width: int = 5,
    num: int = 80,
    den: int = 100,
    every: bool = True,
    key: str = "doc_id",
    text: str = "text",
) -> Join:
    """Links between documents whose shingle sets have a Jaccard similarity of num/den or more.

    Shingles are ``width`` consecutive words (see :func:`shingle_sets`).  Documents with equal
    sets form a class, so copies never multiply; links join classes, and with ``every`` none is
    left out.  Without it the links connect the same classes with fewer pairs.

    A set with more shingles of its own than the threshold allows cannot link; a test on a
    hash range of all shingles, which errs on the safe side only, puts most sets aside.  The
    rest is divided into families by the rarest shingles of the same hash range, and each family
    joined by signature trees.

    A null text counts as empty; a document without words has an empty set and no link, not
    even to others without words.  Rows without a key take no part.  Repeated rows are
    members of one class.  Other columns are ignored, and an empty table gives empty results.
    """
    documents = durable(described(docs, key, text, width))
    classes = durable(
        documents.where("_n > 0")
        .groupBy("_set")
        .agg(F.first("_n").alias("_n"), F.min("_id").alias("_first"), F.count("*").alias("_size"))
    )
    shingles = classes.agg(F.sum("_n")).first()[0] or 0
    share = min(1.0, SAMPLE * (1 - num / den))
    buckets = int(shingles * share) // BUCKET_SHINGLES + 1
    lonely = lonely_shingles(docs.where(F.col(key).isNotNull()), text, width, share, buckets)
    joined = classes.join(lonely, "_set", "left")
    able = joined.where(F.coalesce("_lonely", F.lit(0)) * den <= F.col("_n") * (den - num))
    able = durable(able.select("_set", "_first"))
    twice = durable(documents.groupBy("_id").agg(F.count("*").alias("_rows")).where("_rows > 1").select("_id"))
    sets = sets_of(docs, able, twice, key, text, width).withColumn("_no", F.monotonically_increasing_id())
    return Join(documents, classes, set_links(durable(sets), num, den, every, share))


def jaccard_components(
    docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per document: key, n_shingles, component_id, the least key reachable by links.

    Rows without a key have a null component.  Cases as for :func:`jaccard_join`.
    """
    join = jaccard_join(docs, width, num, den, False, key, text)
    label = connected(join.links).select(F.col("node").alias("_set"), "label")
    labelled = join.classes.join(label, "_set", "left").withColumn("label", F.coalesce("label", "_set"))
    least = labelled.groupBy("label").agg(F.min("_first").alias("_least"), F.count("*").alias("_classes"))
    members = join_groups(labelled.select("_set", "_size", "label"), least, "label", "_classes", join.classes.count())
    facts = durable(members.select("_set", "_size", F.col("_facts._least").alias("_least")))
    worded = join_groups(
        join.documents.where("_n > 0"), facts, "_set", "_size", join.documents.count()
    ).select("_id", "_n", F.col("_facts._least").alias("_least"))
    wordless = join.documents.where("_n = 0").select("_id", "_n", F.col("_id").alias("_least"))
    without = docs.where(F.col(key).isNull())
    found = worded.unionByName(wordless).select(
        F.col("_id").alias(key), F.col("_n").alias("n_shingles"), F.col("_least").alias("component_id")
    )
    unkeyed = described(without.select(F.lit(0).cast("long").alias(key), text), key, text, width)
    kind = docs.schema[key].dataType
    return found.unionByName(
        unkeyed.select(
            F.lit(None).cast(kind).alias(key), F.col("_n").alias("n_shingles"), F.lit(None).cast(kind).alias("component_id")
        )
    )


def keep_one(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component the least key stays, once.

    Rows without a key stay.  All columns are kept.
    """
    found = durable(jaccard_components(docs, width, num, den, key, text).where(F.col(key).isNotNull()))
    marked = durable(
        found.groupBy(F.col(key).alias("_key"))
        .agg(F.min("component_id").alias("_least"), F.count("*").alias("_rows"))
        .where("_key != _least OR _rows > 1")
        .select("_key", (F.col("_key") != F.col("_least")).alias("_gone"))
    )
    single = docs.join(marked, docs[key] == marked["_key"], "left_anti")
    twice = marked.where("NOT _gone")
    repeated = docs.join(twice, docs[key] == twice["_key"], "left_semi").dropDuplicates([key])
    return single.unionByName(repeated)
