"""Jaccard self-join on word shingles, with a count-vector R-tree.

A document's set holds its distinct five-word shingles; equal sets form a class, and all work is
on classes. Each shingle is hashed into a group, and a class is the point of its group counts. Two
classes share at most the sum over groups of the smaller count, so the R-tree, whose nodes keep the
largest counts and the smallest size below them, passes over every node whose bound is too small;
points that survive are verified on the full sets. A set of n shingles has about n / 4 groups, as
the bound of unrelated sets would otherwise rise with their size; points with more groups are
folded, by adding neighbours, to be compared with others.

Which points an R-tree holds: a pair at the threshold shares a shingle among the first
n - ceil(0.75 n) + 1 of either set under any fixed order of shingles, rare ones first. Classes
that share such a shingle are led by the smallest of them, and a tree is built over each leader's
members. So no link is missed, trees stay small, and no tree is needed for unrelated documents.

No pair leaves a task before it is verified. Members of a leader are dealt into tiles of bounded
size. Points alone say which members of a tile may link with any other; only those fetch their
sets, and the tile links them: first with the leader, then what the tree finds for members outside
the largest component, passing over what is connected already. A tile hands on a spanning forest.
Where a leader has several tiles, its members outside their largest component meet all tiles in a
second round. Links inside a component that is known already aren't looked for; no component is
lost. ``jaccard_links`` verifies all pairs instead and returns them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import components, materialize, parts_for, table

WORDS = 5
#: Linked when SHARED * |A and B| >= SIZES * (|A| + |B|), which is 100 * both >= 75 * either.
SHARED, SIZES = 7, 3
#: Groups of a set: a power of two, at least LEAST_GROUPS and at least a fourth of its size.
LEAST_GROUPS = 64
LEAF = 16
#: Members of a tile, about, and shingles in their sets.
BLOCK, BLOCK_SHINGLES = 2048, 1 << 21
#: Members that one call joins, about, in one tile or several, and shingles in their sets.
TASK_ROWS, TASK_SHINGLES = 1000, 1 << 20
#: At most so many frequent shingles are known as such when shingles are put in order.
FREQUENT = 1 << 17
#: Shingles in about 2 ** HOT_LEVEL classes or more are dealt to several tasks.
HOT_LEVEL = 13
_SALTS = 8
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def shingle_set(text: bytes | None) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a text (A-Z lower-cased, words between
    ASCII white space); fewer than five words are one shingle, none gives an empty set."""
    words = (text or b"").lower().split()
    if len(words) < WORDS:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), 1)] if words else [], dtype=np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    n = len(words) - WORDS + 1
    out = np.zeros(n, dtype=np.uint64)
    for i, factor in enumerate(_MIX):
        out ^= hashes[i : i + n] * factor
        out *= np.uint64(0xFF51AFD7ED558CCD)
    out ^= out >> np.uint64(32)
    out.sort()
    return out[np.concatenate(([True], out[1:] != out[:-1]))]


def class_hashes(shingles: np.ndarray, bits: int = 64) -> tuple[int, int]:
    """Two signed 64-bit hashes of a set; ``bits`` of the first are kept."""
    whole = xxhash.xxh3_128_intdigest(shingles.tobytes())
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return signed(whole & (1 << bits) - 1), signed(whole >> 64)


def groups_for(n: int) -> int:
    return max(LEAST_GROUPS, 1 << (-(-n // 4) - 1).bit_length())


def count_vector(shingles: np.ndarray) -> np.ndarray:
    """Group counts, as bytes; in the odd case that a group has over 255, there are more groups."""
    groups = groups_for(len(shingles))
    while True:
        shift = np.uint64(65 - groups.bit_length())
        counts = np.bincount((shingles >> shift).astype(np.int64), minlength=groups)
        if counts.max(initial=0) < 256:
            return counts.astype(np.uint8)
        groups *= 2


def folded(vectors: np.ndarray, groups: int) -> np.ndarray:
    """Counts of ``groups`` groups, from one vector or rows of them with as many or more."""
    return vectors.reshape(*vectors.shape[:-1], groups, -1).sum(axis=-1, dtype=np.int32)


def _sets(texts, bits: int, twins: frozenset[int], seen: set[tuple[int, int]]):
    """(class, second hash, size, set) of each text; set is None for a class that this task had
    before, and for empty sets."""
    for text in texts.cast(pa.binary()).to_pylist():
        own = shingle_set(text)
        cls, check = class_hashes(own, bits)
        if cls in twins:
            cls = check
        if len(seen) > 1_000_000:
            seen.clear()
        new = (cls, check) not in seen
        seen.add((cls, check))
        yield cls, check, len(own), own if new and len(own) else None


def _record(names: list[str], types: list[pa.DataType], columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def _survey(bits: int):
    names, types = ["doc_id", "key", "cls", "check", "n", "vec", "token"], [pa.int64()] * 5 + [pa.binary(), pa.int64()]

    def survey(batches):
        """A row for each document, with the count vector where its class is new to the task, and
        a row for each shingle that several classes of a batch share."""
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            rows, sets = [], []
            for doc_id, key, (cls, check, n, own) in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _sets(batch.column(2), bits, frozenset(), seen), strict=True):
                rows.append((doc_id, key, cls, check, n, None if own is None else count_vector(own).tobytes(), None))
                if own is not None:
                    sets.append(own)
            if rows:
                yield _record(names, types, zip(*rows, strict=True))
            if sets:
                tokens, counts = np.unique(np.concatenate(sets), return_counts=True)
                many = counts >= 3
                none = [None] * int(many.sum())
                yield _record(names, types, (none, none, none, none, counts[many], none, tokens[many].view(np.int64)))

    return survey


def _frequent(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted tokens and their levels (rounded log2 of the count), at most FREQUENT of them."""
    sums = materialize(counts.groupBy("token").agg(F.sum("n").alias("n")).where("n >= 8").withColumn("level", F.floor(F.log2("n"))), "frequent")
    sizes = {r["level"]: r["k"] for r in sums.groupBy("level").agg(F.count(F.lit(1)).alias("k")).collect()}
    least, total = 64, 0
    for level in sorted(sizes, reverse=True):
        if (total := total + sizes[level]) > FREQUENT:
            break
        least = level
    got = sums.where(F.col("level") >= least).select("token", "level").toPandas().sort_values("token")
    tokens, levels = got["token"].to_numpy(np.int64).view(np.uint64), got["level"].to_numpy(np.int64)
    order = np.argsort(tokens)
    return tokens[order], levels[order]


def prefix(shingles: np.ndarray, tokens: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first n - ceil(0.75 n) + 1 shingles, in the order of (level, hash), and their levels."""
    n = len(shingles)
    level = np.zeros(n, dtype=np.int64)
    if len(tokens) and n:
        at = np.minimum(np.searchsorted(tokens, shingles), len(tokens) - 1)
        level = np.where(tokens[at] == shingles, levels[at], 0)
        order = np.argsort(level, kind="stable")
        shingles, level = shingles[order], level[order]
    cut = n - -(-3 * n // 4) + 1
    return shingles[:cut], level[:cut]


def salt_of(cls: int, level: np.ndarray) -> np.ndarray:
    """-1, or for shingles of very many classes the part of them that the class is in."""
    salts = 1 << np.clip(level - HOT_LEVEL + 1, 0, 10)
    return np.where(level >= HOT_LEVEL, (cls >> 7) % salts, -1)


def _leaders(batches):
    """From (token, salt, cls) in that order: (leader, cls, token), leader being the smallest
    class that has the token, or a part of its classes; only then the token is told. One row is
    held back from batch to batch, however long a token's rows are."""
    last = leader = None
    for batch in batches:
        t, s, c = (batch.column(i).to_numpy() for i in range(3))
        if not len(t):
            continue
        starts = np.concatenate(([True], (t[1:] != t[:-1]) | (s[1:] != s[:-1])))
        lead = c[np.maximum.accumulate(np.where(starts, np.arange(len(t)), 0))]
        if last == (t[0], s[0]):
            lead[: np.argmax(starts[1:]) + 1 if starts[1:].any() else len(t)] = leader
        last, leader = (t[-1], s[-1]), lead[-1]
        hot = s >= 0
        found = np.unique(np.stack((lead, c), axis=1)[(lead != c) & ~hot], axis=0)
        parts = np.unique(np.stack((lead, c, t), axis=1)[hot], axis=0)
        told = pa.array(np.concatenate((np.zeros(len(found), dtype=np.int64), parts[:, 2])), mask=np.arange(len(found) + len(parts)) < len(found))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((found[:, i], parts[:, i]))) for i in (0, 1)] + [told], ["leader", "cls", "token"])


def may_link(va: np.ndarray, na, vb: np.ndarray, nb) -> np.ndarray:
    """Whether the summed coordinate minima leave room for a link."""
    return SHARED * np.minimum(va, vb).sum(axis=-1, dtype=np.int64) >= SIZES * (na + nb)


class CountTree:
    """An R-tree over count vectors, bulk-loaded by sorting and tiling."""

    def __init__(self, vectors: np.ndarray, sizes: np.ndarray, labels: np.ndarray):
        spread = np.argsort(-vectors.var(axis=0), kind="stable")[:2]  # the widest coordinates
        slab = np.argsort(np.argsort(sizes, kind="stable")) // max(LEAF * LEAF, int(len(sizes) ** 0.75))
        order = np.lexsort((vectors[:, spread[1]], vectors[:, spread[0]], slab))
        self.order, self.vectors, self.sizes, self.labels = order, vectors[order], sizes[order], labels[order]
        self.levels = []
        top, least, low, high = self.vectors, self.sizes, self.labels, self.labels
        while len(top) > 1:
            cuts = np.arange(0, len(top), LEAF)
            top, least = np.maximum.reduceat(top, cuts), np.minimum.reduceat(least, cuts)
            low, high = np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts)
            self.levels.append((top, least, low, high))

    def search(self, vector: np.ndarray, size: int, label: int) -> np.ndarray:
        """Positions of points that may link with the given one and carry another label."""
        nodes = np.zeros(1, dtype=np.int64)
        for top, least, low, high in reversed(self.levels):
            nodes = nodes[nodes < len(top)]
            nodes = nodes[may_link(top[nodes], least[nodes], vector, size) & ~((low[nodes] == label) & (high[nodes] == label))]
            nodes = (nodes[:, None] * LEAF + np.arange(LEAF)).ravel()
        nodes = nodes[nodes < len(self.order)]
        ok = may_link(self.vectors[nodes], self.sizes[nodes], vector, size) & (self.labels[nodes] != label)
        return self.order[nodes[ok]]


class Points:
    """Trees over points of any numbers of groups. The tree of a number has the points with just
    so many, and folded ones with more that are small enough to link with one of those."""

    def __init__(self, vectors: list[np.ndarray], sizes: np.ndarray, labels: np.ndarray, held: np.ndarray):
        self.vectors, self.sizes, self.labels = vectors, sizes, labels
        self.groups = np.array([len(x) for x in vectors], dtype=np.int64)
        self.trees = []
        for level in np.unique(self.groups):
            own = self.groups == level
            most = sizes[own].max()
            at = np.flatnonzero(held & (own | ((self.groups > level) & (SHARED * most >= SIZES * (most + sizes)))))
            if len(at):
                tree = CountTree(np.stack([folded(vectors[i], level) for i in at]), sizes[at], labels[at])
                self.trees.append((level, at, own[at], most, tree))

    def near(self, i: int) -> np.ndarray:
        """Positions of held points with another label that may link with point i."""
        out, size = [np.zeros(0, dtype=np.int64)], self.sizes[i]
        for level, at, own, most, tree in self.trees:
            if level <= self.groups[i] and (most >= size or SHARED * most >= SIZES * (most + size)):
                found = tree.search(folded(self.vectors[i], level), size, self.labels[i])
                out.append(at[found if level == self.groups[i] else found[own[found]]])
        return np.concatenate(out)


def star(vectors: list[np.ndarray], sizes: np.ndarray) -> np.ndarray:
    """Which points may link with the first one, which is among them."""
    out = np.zeros(len(vectors), dtype=bool)
    groups = np.array([len(x) for x in vectors])
    for g in np.unique(groups):
        at, level = np.flatnonzero(groups == g), min(g, groups[0])
        out[at] = may_link(folded(np.stack([vectors[i] for i in at]), level), sizes[at], folded(vectors[0], level), sizes[0])
    return out


def wanted(vectors: list[np.ndarray], sizes: np.ndarray, labels: np.ndarray, asks: np.ndarray) -> np.ndarray:
    """Which points of a tile may link with any other of another label. ``asks``: those that meet
    the others; where all do, the first one is the leader."""
    if asks.all():
        mark = star(vectors, sizes)
        mark[0] = mark[1:].any()
        rest, held = np.flatnonzero(~mark), np.ones(len(vectors), dtype=bool)
        rest = rest[rest > 0]
    else:
        mark, rest, held = np.zeros(len(vectors), dtype=bool), np.flatnonzero(asks), ~asks
    if len(rest):
        points = Points(vectors, sizes, labels, held)
        for i in rest:
            found = points.near(i)
            mark[found] = True
            mark[i] |= len(found) > 0
    return mark


class Sets:
    """Shingle sets of a tile, with shingles numbered within it."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(x) for x in sets], dtype=np.int64)
        self.ends = np.cumsum(self.sizes)
        names, ids = np.unique(np.concatenate(sets), return_inverse=True)
        self.parts = np.split(ids, self.ends[:-1])
        self.marks = np.zeros(len(names), dtype=bool)

    def linked(self, i: int, others: np.ndarray) -> np.ndarray:
        """Those of ``others`` that link with set i."""
        if not len(others):
            return others
        self.marks[self.parts[i]] = True
        hits = self.marks[np.concatenate([self.parts[j] for j in others])]
        self.marks[self.parts[i]] = False
        both = np.add.reduceat(hits, np.concatenate(([0], np.cumsum(self.sizes[others])[:-1])), dtype=np.int64)
        return others[SHARED * both >= SIZES * (self.sizes[i] + self.sizes[others])]


def link_tile(vectors: list[np.ndarray], sets: list[np.ndarray], labels: np.ndarray, asks: np.ndarray, every: bool) -> list[tuple[int, int]]:
    """Links of a tile as pairs of positions: all of them, or a forest that joins what they join.
    Sets with a common label are taken to be connected."""
    held = np.ones(len(sets), dtype=bool) if asks.all() else ~asks
    known, sizes, labels = Sets(sets), np.array([len(x) for x in sets]), labels.copy()
    out: list[tuple[int, int]] = []

    def join(i: int, found: np.ndarray) -> None:
        if every:
            out.extend((i, j) for j in found)
            return
        found = found[labels[found] != labels[i]]
        olds, first = np.unique(labels[found], return_index=True)
        out.extend((i, j) for j in found[first])
        labels[np.isin(labels, olds)] = labels[i]

    if asks.all() and not every:
        join(0, known.linked(0, np.arange(1, len(sets))))
    if every or len(np.unique(labels)) > 1:
        points = Points(vectors, sizes, labels.copy(), held)
        names, counts = np.unique(labels, return_counts=True)
        rest = asks if every or not asks.all() else labels != names[np.argmax(counts)]
        for i in np.flatnonzero(rest):
            near = points.near(i)
            near = near[near > i] if every and asks.all() else near[every | (labels[near] != labels[i])]
            join(i, known.linked(i, near))
    return out


def _parts(count: str, shingles: str) -> Column:
    """How many blocks hold so many members with so many shingles."""
    return F.greatest(F.ceil(F.col(count) / BLOCK), F.ceil(F.col(shingles) / BLOCK_SHINGLES)).cast("int")


def _salted(rows: DataFrame, few: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join with a table of one row for each key, in which a hot key's rows aren't all together."""
    each = few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("cls"), F.lit(_SALTS)).cast("int")).join(each, [*keys, "salt"], how).drop("salt")


def _part(name: str, seed: int) -> Column:
    return F.pmod(F.xxhash64("cls", F.lit(seed)), F.col(name)).cast("int")


def _each(name: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(name) - 1))


def _dealt(rows: DataFrame) -> DataFrame:
    """(leader, i, j, cls, label, asks, n, vec): rows (leader, cls, n, vec) in tiles. Tile i of a
    leader has the leader and a part of its members, all of which ask."""
    hot = rows.groupBy("leader").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("shingles")).select("leader", _parts("m", "shingles").alias("parts"))
    out = _salted(rows, materialize(hot.where("parts > 1"), "hot"), ["leader"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    out = out.withColumn("i", F.explode(F.when(F.col("leader") == F.col("cls"), every).otherwise(F.array(_part("parts", 1)))))
    return out.select("leader", "i", F.lit(0).alias("j"), "cls", F.col("cls").alias("label"), F.lit(True).alias("asks"), "n", "vec")


def _dealt_again(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Tiles in which members of one leader's different tiles meet: those outside the leader's
    largest component ask, in parts j, all members in parts i; leaders with one tile or component are
    left out. Linked sets differ in size by a third at most, so members meet by steps of size, each
    step's askers in its own and the next ones. Without labels all ask."""
    hot = rows.groupBy("leader").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("shingles")).where(_parts("m", "shingles") > 1).select("leader")
    named = _salted(rows, materialize(hot, "hot"), ["leader"])
    if labels is None:
        named = named.withColumn("label", F.col("cls"))
    else:
        named = named.join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("component", "cls"))
    named = materialize(named.select("leader", "cls", "label", "n", "vec", F.floor(F.log("n") / F.log(F.lit(1.34))).cast("int").alias("step")), "named")
    sums = named.groupBy("leader", "label").agg(F.count(F.lit(1)).alias("m"))
    sums = materialize(sums.groupBy("leader").agg(F.max_by("label", F.struct("m", "label")).alias("largest"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k"), "largest")
    held = _salted(named, sums, ["leader"])
    asking = (held if labels is None else held.where("label <> largest")).withColumn("step", F.explode(F.array(F.col("step") - 1, F.col("step"), F.col("step") + 1)))
    sized = lambda frame, name: frame.groupBy("leader", "step").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("shingles")).select("leader", "step", _parts("m", "shingles").alias(name))
    tiles = materialize(sized(held, "parts").join(sized(asking, "turns"), ["leader", "step"]), "tiles")
    held = _salted(held, tiles, ["leader", "step"]).withColumn("i", _part("parts", 1)).withColumn("j", _each("turns"))
    asking = _salted(asking, tiles, ["leader", "step"]).withColumn("j", _part("turns", 2)).withColumn("i", _each("parts"))
    columns = lambda frame, asks: frame.select("leader", (F.shiftleft("step", 24) + F.col("i")).alias("i"), "j", "cls", "label", F.lit(asks).alias("asks"), "n", "vec")
    return columns(held, False).unionByName(columns(asking, True))


def _by_tile(rows: DataFrame, sized: DataFrame, columns: list[str], each, schema: str) -> DataFrame:
    """Calls ``each`` with the rows of some tiles at a time: (pdf, positions of each tile's rows).
    ``sized`` has about as many rows, and is counted."""
    size = sized.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    tasks = max(parts_for(size["rows"], TASK_ROWS), parts_for(size["n"], TASK_SHINGLES))
    dealt = rows.select(F.pmod(F.xxhash64("leader", "i", "j"), F.lit(tasks)).alias("task"), *columns)

    def within(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(_lead=pdf["leader"] != pdf["cls"]).sort_values(["leader", "i", "j", "asks", "_lead", "cls"], ignore_index=True)
        return each(pdf, pdf.groupby(["leader", "i", "j"], sort=False).indices.values())

    return dealt.groupBy("task").applyInPandas(within, schema)


_TILE = ["leader", "i", "j", "asks", "cls", "label", "n", "vec"]


def _vectors(pdf: pd.DataFrame) -> list[np.ndarray]:
    return [np.frombuffer(x, dtype=np.uint8) for x in pdf["vec"]]


def _marked(rows: DataFrame, sized: DataFrame) -> DataFrame:
    """The rows whose points may link with another one of their tile."""

    def mark(pdf: pd.DataFrame, tiles) -> pd.DataFrame:
        vectors, keep = _vectors(pdf), np.zeros(len(pdf), dtype=bool)
        sizes, labels, asks = pdf["n"].to_numpy(), pdf["label"].to_numpy(), pdf["asks"].to_numpy()
        for at in tiles:
            if len(at) > 1:
                keep[at] = wanted([vectors[i] for i in at], sizes[at], labels[at], asks[at])
        return pdf.loc[keep, _TILE]

    return _by_tile(rows, sized, _TILE, mark, "leader long, i int, j int, asks boolean, cls long, label long, n long, vec binary")


def _links(rows: DataFrame, sets: DataFrame, every: bool) -> DataFrame:
    """Links (a, b) of the tiles' members, verified on their sets."""

    def link(pdf: pd.DataFrame, tiles) -> pd.DataFrame:
        vectors, sets, out = _vectors(pdf), [np.frombuffer(x, dtype=np.uint64) for x in pdf["set"]], [np.zeros((0, 2), dtype=np.int64)]
        cls, labels, asks = pdf["cls"].to_numpy(), pdf["label"].to_numpy(), pdf["asks"].to_numpy()
        for at in tiles:
            found = link_tile([vectors[i] for i in at], [sets[i] for i in at], labels[at], asks[at], every)
            out.append(cls[at[np.array(found, dtype=np.int64).reshape(-1, 2)]])
        pairs = np.unique(np.sort(np.concatenate(out), axis=1), axis=0)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    return _by_tile(rows.join(sets, "cls"), rows, [*_TILE, "set"], link, "a long, b long")


class _Join:
    """The steps over one table (doc_id, text) of documents."""

    def __init__(self, docs: DataFrame, bits: int):
        self.bits = bits
        self.rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("key"), F.col("text").cast("string").alias("text"))
        survey = materialize(self.rows.mapInArrow(_survey(bits), "doc_id long, key long, cls long, check long, n long, vec binary, token long"), "survey")
        owned = survey.where("token IS NULL").drop("token")
        info = owned.where("n > 0").groupBy("cls", "check").agg(F.max("n").alias("n"), F.max("vec").alias("vec"), F.min("doc_id").alias("least"), F.min("key").alias("key"))
        info = materialize(info, "classes")
        # different sets with one first hash: the second one names them; none are to be expected below some 10^9 classes
        self.twins = frozenset(r["cls"] for r in info.groupBy("cls").count().where("count > 1").select("cls").collect())
        name = F.when(F.col("cls").isin(list(self.twins)), F.col("check")).otherwise(F.col("cls")) if self.twins else F.col("cls")
        self.owned, self.info = owned.withColumn("cls", name), info.withColumn("cls", name)
        self.counts = survey.where("token IS NOT NULL").select("token", "n")

    def groups(self) -> DataFrame:
        """(leader, cls, n, vec): the members of each leader, itself among them."""
        frequent = self.rows.sparkSession.sparkContext.broadcast(_frequent(self.counts))
        bits, twins = self.bits, self.twins

        def prefixes(batches):
            seen: set[tuple[int, int]] = set()
            for batch in batches:
                parts = []
                for cls, _, _, own in _sets(batch.column(0), bits, twins, seen):
                    if own is not None:
                        first, level = prefix(own, *frequent.value)
                        parts.append((first.view(np.int64), salt_of(cls, level), np.full(len(first), cls, dtype=np.int64)))
                if parts:
                    yield _record(["token", "salt", "cls"], [pa.int64()] * 3, [np.concatenate(x) for x in zip(*parts, strict=True)])

        routed = self.rows.select("text").mapInArrow(prefixes, "token long, salt long, cls long").repartition("token", "salt").sortWithinPartitions("token", "salt", "cls")
        found = materialize(routed.mapInArrow(_leaders, "leader long, cls long, token long"), "leaders")
        parts = found.where("token IS NOT NULL")
        tops = F.broadcast(parts.groupBy("token").agg(F.min("leader").alias("top")))  # of at most FREQUENT shingles
        parts = parts.join(tops, "token").select(F.col("top").alias("leader"), "cls")
        members = found.where("token IS NULL").select("leader", "cls").unionByName(parts).where("leader <> cls").distinct()
        groups = members.unionByName(members.select("leader", F.col("leader").alias("cls")).distinct())
        return materialize(groups.join(self.info.select("cls", "n", "vec"), "cls").select("leader", "cls", "n", "vec"), "groups")

    def sets_of(self, rows: DataFrame) -> DataFrame:
        """(cls, set) of the classes of rows: only texts that stand for them are read."""
        keys = materialize(rows.select("cls").distinct().join(self.info.select("cls", "key"), "cls").select("key").distinct(), "keys")
        bits, twins = self.bits, self.twins

        def listed(batches):
            seen: set[tuple[int, int]] = set()
            for batch in batches:
                out = [(cls, own.tobytes()) for cls, _, _, own in _sets(batch.column(0), bits, twins, seen) if own is not None]
                if out:
                    yield _record(["cls", "set"], [pa.int64(), pa.binary()], zip(*out, strict=True))

        texts = self.rows.join(keys, "key", "left_semi").select("text")
        return texts.mapInArrow(listed, "cls long, set binary").groupBy("cls").agg(F.first("set").alias("set"))

    def links(self, dealt: DataFrame, sized: DataFrame, every: bool = False) -> DataFrame:
        """Links (a, b) that the tiles find."""
        marked = materialize(_marked(dealt, sized), "marked")
        return materialize(_links(marked, self.sets_of(marked), every).distinct(), "links")


def jaccard_components(docs: DataFrame, bits: int = 64) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs (doc_id, text).

    component_id is the smallest doc_id reachable by links, itself included. A null or empty text
    has no shingles and is linked with nothing. Repeated rows have equal sets and so link; a null
    doc_id takes its component's smallest doc_id, or null. An empty table gives an empty result.
    ``bits``: of a class's first hash; sets that share it are told apart by a second one."""
    join = _Join(docs, bits)
    groups = join.groups()
    links = join.links(_dealt(groups), groups)
    labels = materialize(components(links), "labels")
    again = _dealt_again(groups, labels)
    more = join.links(again, again)
    if not more.isEmpty():
        labels = materialize(components(links.unionByName(more)), "labels", labels)
    info = join.info.select("cls", "least")
    named = info.join(labels, info["cls"] == labels["node"], "left").select("cls", F.coalesce("component", "cls").alias("component"), "least")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of_class = materialize(named.join(least, "component").select("cls", "component_id"), "components")
    owned = join.owned.select("doc_id", "cls", "n")
    out = owned.join(of_class.withColumnRenamed("cls", "_cls"), F.col("cls") == F.col("_cls"), "left")
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def jaccard_links(docs: DataFrame, bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """The join itself: all links (a, b), a < b, between different sets, and (doc_id, cls) of every
    row of docs, cls being null where a text has no words. Rows with a common cls have equal sets."""
    join = _Join(docs, bits)
    groups = join.groups()
    links, again = join.links(_dealt(groups), groups, True), _dealt_again(groups, None)
    links = links.unionByName(join.links(again, again, True)).distinct()
    return links, join.owned.select("doc_id", F.when(F.col("n") > 0, F.col("cls")).alias("cls"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """jaccard_components() over all documents."""
    return jaccard_components(table(spark, sf_dir, "documents", "doc_id", "text"))
