"""N-gram Jaccard join by PartEnum signatures.

A document's set is its distinct shingles of five words. Sets are banded by size; within a band,
a pair that reaches the threshold differs in at most k shingles, k known from the band's largest
size. A hash cuts the shingle domain into groups of three parts, k // 2 + 1 + e groups, so such a pair
differs in at most one shingle within at least e + 1 groups, and there agrees on two of the three
parts. A signature is a subset of two parts of a group, all three subsets being enumerated; linked sets
share e + 1 of them and more. In an order that all sets agree on, the signatures of most shingles
first, each set leaves out its last e: linked sets still share one, and signatures that hold next to
nothing are gone. One that is left without a shingle is replaced by its combinations with the signatures
of a second, independent partition. A set signs its own band and the next, so that the pair meets in
the band of the larger set.

Candidates are verified on whole shingle sets. Within a signature's bucket all members are first
compared with its leader, the smallest id. Members whose leader's bucket is then in several components
are compared across components, once for all buckets of a leader, unless sketches of their sets prove
them too far apart. Where that leaves many pairs, each component's closest pair goes first, until those
link nothing more. A leader with very many members has them signed once more by a third partition first.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, free_names, frugal, mix, shuffle_width, slices, small, stage, utf8, word_hashes

SHINGLE = 5
#: Similarity in percent.
THRESHOLD = 80
#: The subsets of two of a group's three parts.
SUBSETS = ((0, 1), (0, 2), (1, 2))
#: Members of a cell that one task compares with as many others.
BLOCK = 2048
#: Members of a leader's buckets from which they are signed again before they are compared.
CROWD = 8192
#: Pairs per member of a cell up to which all are verified at once.
MANY = 4
#: Text bytes whose signatures one group of the bucket stage holds, at most about.
PART_BYTES = 12 << 20
#: Members of cells per group of the second look, at most about.
PART_DOCS = 20_000
SKETCH_WORDS = 8
#: Text bytes whose signatures a mapping task holds at once.
MAP_BYTES = 4 << 20
_STEP = np.array([0x8CB92BA72F3D8DD7, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def shingle_sets(hashes: np.ndarray, before: np.ndarray, size: int = SHINGLE) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes, from its words' hashes; shorter texts have their
    whole sequence as one."""
    steps = [int(_STEP[j % 5]) + 2 * (j // 5) for j in range(size)]
    n = max(0, len(hashes) - size + 1)
    rolled = np.zeros(n, np.uint64)
    for j, step in enumerate(steps):
        rolled += hashes[j : j + n] * np.uint64(step)
    rolled = mix(rolled)
    sets = []
    for a, b in zip(before[:-1], before[1:]):
        if b - a >= size:
            sets.append(np.unique(rolled[a : b - size + 1]))
        elif b > a:
            whole = sum((int(h) * s for h, s in zip(hashes[a:b], steps)), start=int(b - a))
            sets.append(mix(np.array([whole & (2**64 - 1)], np.uint64)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def farthest(a: int, b: int, threshold: int = THRESHOLD) -> int:
    """The most shingles in which sets of sizes a and b differ when they link."""
    return (a + b) * (100 - threshold) // (100 + threshold)


@lru_cache
def bands(most: int, threshold: int = THRESHOLD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First sizes, number of groups and spare signatures e of the bands up to size `most` and one more."""
    first, groups, spare = [], [], []
    low = 1
    while True:
        high = low * 100 // threshold
        k = farthest(high, high, threshold)
        first.append(low)
        spare.append(1 + k // 10)
        groups.append(k // 2 + 1 + spare[-1] if k else 0)  # without differences only equal sets link
        if low > most:
            return np.array(first), np.array(groups), np.array(spare)
        low = high + 1


def signatures(sets: list[np.ndarray], threshold: int = THRESHOLD, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(owner, signature) of all sets; owner is a position in sets. Partitions of other salts are
    independent of each other."""
    owner, sign, held = _enumerated(sets, threshold, salt)
    if len(bare := np.flatnonzero(held == 0)):
        few, at = np.unique(owner[bare], return_inverse=True)
        whose, again, _ = _enumerated([sets[i] for i in few], threshold, salt + 101)
        first, n = np.searchsorted(whose, np.arange(len(few))), np.bincount(whose, minlength=len(few))[at]
        run = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[at], n)
        joint = mix(np.repeat(sign[bare], n) * np.uint64(0x9FB21C651E98DF25) + again[run])
        keep = held > 0
        owner, sign = np.concatenate([owner[keep], np.repeat(owner[bare], n)]), np.concatenate([sign[keep], joint])
    return owner, sign


def _enumerated(sets: list[np.ndarray], threshold: int, salt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, signature, shingles in it) by owner, without each set's spare last ones."""
    sizes = np.array([len(s) for s in sets], np.int64)
    if not sizes.sum():
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first, groups, spare = bands(int(sizes.max()), threshold)
    own = np.searchsorted(first, np.maximum(sizes, 1), "right") - 1
    owner2 = np.tile(np.arange(len(sets)), 2)
    band = np.concatenate([own, own + 1])
    count = np.where(sizes[owner2] > 0, 3 * groups[band], 0)
    base = np.concatenate([[0], np.cumsum(count)])
    values = np.concatenate([*sets, *sets])
    placed = mix(values + np.uint64(salt * 0x632BE59BD9B4E019 & (2**64 - 1))) if salt else values
    wide = np.repeat(count, sizes[owner2])
    live = wide > 0
    at = np.repeat(base[:-1], sizes[owner2])[live] + ((placed[live] >> np.uint64(20)) % wide[live].astype(np.uint64)).astype(np.int64)
    total = np.zeros(base[-1], np.uint64)
    np.add.at(total, at, mix(values[live] ^ np.uint64(0x51ED270B35A17C4D)))
    held = np.bincount(at, minlength=base[-1]).reshape(-1, 3)
    row = np.repeat(np.arange(len(count)), count)
    part = (np.arange(base[-1]) - np.repeat(base[:-1], count)).astype(np.uint64)
    name = (np.uint64(salt) << np.uint64(56)) + (band[row].astype(np.uint64) << np.uint64(40)) + part + np.uint64(1)
    marks = mix(total + mix(name)).reshape(-1, 3)
    sign = np.stack([mix(marks[:, a] + np.uint64(3) * marks[:, b]) for a, b in SUBSETS], 1).ravel()
    held = np.stack([held[:, a] + held[:, b] for a, b in SUBSETS], 1).ravel()
    order = np.lexsort((sign, -held, row))
    rank = np.arange(len(order)) - np.repeat(base[:-1], count)
    order = order[rank < np.repeat(count - spare[band], count)]
    order = order[np.argsort(owner2[row[order]], kind="stable")]
    return owner2[row[order]], sign[order], held[order]


def sketch(values: np.ndarray) -> bytes:
    """Parities of hash cells, 512 or for large sets a power of two times as many: two sets differ in at
    least as many elements as their sketches in bits. A sketch folds to half its size by xor of its halves."""
    bits = 64 * SKETCH_WORDS
    while bits < len(values) * 2:
        bits *= 2
    cell = (values & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits(np.bincount(cell, minlength=bits) & 1).tobytes()


def _folded(own: str, other: str) -> F.Column:
    """A sketch at the size of another that is half as large, else as it is."""
    half = F.size(other)
    xor = F.zip_with(F.slice(own, 1, half), F.slice(own, half + 1, half), lambda x, y: x.bitwiseXOR(y))
    return F.when(F.size(own) == half * 2, xor).otherwise(F.col(own))


def _digest(values: np.ndarray) -> bytes:
    """128 bits that tell sets apart."""
    other = mix(values ^ np.uint64(0x2545F4914F6CDD1D))
    return int(other.sum(dtype=np.uint64)).to_bytes(8, "little") + int((mix(other) * np.uint64(3)).sum(dtype=np.uint64)).to_bytes(8, "little")


def _star(signs: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Members sorted by (signature, id): the order, the run's first id for each, and which lead a run."""
    order = np.lexsort((ids, signs))
    s = signs[order]
    lead = np.ones(len(s), bool)
    lead[1:] = s[1:] != s[:-1]
    heads = np.flatnonzero(lead)
    return order, np.repeat(ids[order][heads], np.diff(np.append(heads, len(s)))), lead


def _followers(low: np.ndarray, own: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signature, leader, member) of the members of one part's buckets beside their leaders. low: the five
    bytes of each signature; at: its owner's position in own, the sorted ids."""
    wide = np.zeros((len(low), 8), np.uint8)
    if len(own) <= 1 << 24:  # signature and position fit one word, which is sorted in place
        wide[:, 3:] = low
        sign = wide.view("<u8").ravel()
        sign |= at.astype(np.uint64)
        sign.sort()
        owner = own[(sign & np.uint64((1 << 24) - 1)).astype(np.int64)]
        sign >>= np.uint64(24)
    else:
        wide[:, :5] = low
        sign = wide.view("<u8").ravel()
        order = np.lexsort((at, sign))
        sign, owner = sign[order], own[at[order]]
    lead = np.ones(len(sign), bool)
    lead[1:] = sign[1:] != sign[:-1]
    heads, rest = np.flatnonzero(lead), np.flatnonzero(~lead)
    return sign[rest], owner[heads[np.searchsorted(heads, rest, "right") - 1]], owner[rest]


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers as the bytes of their differences, by byte position: zeros lie together, for the shuffle's compression."""
    return np.ascontiguousarray(np.diff(values, prepend=values.dtype.type(0)).view(np.uint8).reshape(len(values), -1).T).tobytes()


def _unpacked(raw: bytes, kind=np.int64) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.cumsum(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(kind).ravel(), dtype=kind)


_MAPPED = "part int, ids binary, counts binary, signs binary, a binary, b binary, sign binary, sizes binary, digests binary, widths binary, sketches binary"
_FOUND = "kind int, a long, b long, sign long, n long, digest binary, sketch array<long>"


def _mapper(parts: int, threshold: int):
    blank = {k: None for k in ("ids", "counts", "signs", "a", "b", "sign", "sizes", "digests", "widths", "sketches")}

    def packed(batch):
        """The packed rows of one block of texts."""
        data, at = utf8(batch.column("text"))
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
        sizes, digests, sketches, owners, signs = [], [], [], [], []
        seen: set[bytes] = set()
        for a, b in slices(at):
            sets = shingle_sets(*word_hashes(data[at[a] : at[b]], at[a : b + 1] - at[a]))
            marks = [_digest(s) for s in sets]
            sizes += [len(s) for s in sets]
            digests += marks
            sketches += [sketch(s) for s in sets]
            fresh = []
            for i, mark in enumerate(marks):  # a copy within the block signs nothing new
                if mark not in seen and len(sets[i]):
                    seen.add(mark)
                    fresh.append(i)
            o, s = signatures([sets[i] for i in fresh], threshold)
            owners.append(ids[a:b][np.array(fresh, np.int64)][o] if len(o) else o)
            home = (s >> np.uint64(32)) % np.uint64(parts)
            signs.append((home << np.uint64(40)) + (s & np.uint64((1 << 40) - 1)))  # its task and 40 bits tell a bucket
        out = [blank | {"part": int(ids[0] % parts), "ids": _packed(ids), "sizes": _packed(np.array(sizes, np.int64)), "digests": b"".join(digests), "widths": _packed(np.array([len(k) // 8 for k in sketches], np.int64)), "sketches": b"".join(sketches)}]
        owner, sign = np.concatenate(owners), np.concatenate(signs)
        # members of one bucket meet here first: only their leader goes on to the bucket's task
        order, head, lead = _star(sign, owner)
        pairs = {"a": head[~lead], "b": owner[order][~lead], "sign": sign[order][~lead]}
        home = pairs["b"] % parts
        for p in np.unique(home):
            out.append(blank | {"part": int(p)} | {k: _packed(v[home == p].view(np.int64)) for k, v in pairs.items()})
        keep = np.sort(order[lead])
        owner, sign = owner[keep], sign[keep]
        home = (sign >> np.uint64(40)).astype(np.int64)
        low = sign.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
        by = np.argsort(home, kind="stable")
        cut = np.searchsorted(home[by], np.arange(parts + 1))
        for p in range(parts):
            if cut[p] < cut[p + 1]:
                own = owner[by[cut[p] : cut[p + 1]]]
                turn = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                counts = np.diff(np.append(turn, len(own)))
                out.append(blank | {"part": p, "ids": _packed(own[turn]), "counts": _packed(counts), "signs": low[by[cut[p] : cut[p + 1]]].tobytes()})
        types = {"part": pa.int32()}
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], types.get(c, pa.binary())) for c in _MAPPED_NAMES], _MAPPED_NAMES)

    def rows(batches):
        for batch in batches:
            at = utf8(batch.column("text"))[1]
            for a, b in slices(at, MAP_BYTES):
                yield packed(batch.slice(a, b - a))

    return rows


_MAPPED_NAMES = [c.split()[0] for c in _MAPPED.split(", ")]


def _whole(values: list) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *(_unpacked(v) for v in values if v is not None)])


def _reduce(rows: pa.Table) -> pa.Table:
    pa.default_memory_pool().release_unused()  # of the group before
    cols = {c: rows.column(c).to_pylist() for c in _MAPPED_NAMES}
    docs = [i for i, s in enumerate(cols["sizes"]) if s is not None]
    signed = [i for i, s in enumerate(cols["signs"]) if s is not None]
    pick = lambda c, at: _whole([cols[c][i] for i in at])
    joined = lambda c, at: b"".join(cols[c][i] for i in at)
    ids, sizes = pick("ids", docs), pick("sizes", docs)
    digests, sketches = joined("digests", docs), joined("sketches", docs)
    own, at = np.unique(pick("ids", signed), return_inverse=True)
    low = np.frombuffer(joined("signs", signed), np.uint8).reshape(-1, 5)
    sign, head, tail = _followers(low, own, np.repeat(at, pick("counts", signed)))
    sign += np.uint64(cols["part"][0]) << np.uint64(40)
    a = np.concatenate([_whole(cols["a"]), head])
    b = np.concatenate([_whole(cols["b"]), tail])
    s = np.concatenate([_whole(cols["sign"]), sign.view(np.int64)])
    distinct = a != b
    a, b, s = a[distinct], b[distinct], s[distinct]
    m, n = len(ids), len(a)
    widths = np.concatenate([[0], np.cumsum(pick("widths", docs))])
    bits = pa.ListArray.from_arrays(pa.array(widths, pa.int32()), pa.array(np.frombuffer(sketches, np.int64)))
    null = lambda k, t: pa.nulls(k, t)
    return pa.Table.from_arrays(
        [
            pa.array(np.append(np.zeros(m, np.int32), np.ones(n, np.int32))),
            pa.array(np.append(ids, a)),
            pa.concat_arrays([null(m, pa.int64()), pa.array(b)]),
            pa.concat_arrays([null(m, pa.int64()), pa.array(s)]),
            pa.concat_arrays([pa.array(sizes), null(n, pa.int64())]),
            pa.concat_arrays([pa.array([digests[i : i + 16] for i in range(0, 16 * m, 16)], pa.binary()), null(n, pa.binary())]),
            pa.concat_arrays([bits, null(n, bits.type)]),
        ],
        names=[c.split()[0] for c in _FOUND.split(", ")],
    )


def _shingled(batches):
    for batch in batches:
        data, at = utf8(batch.column("text"))
        for a, b in slices(at):
            sets = shingle_sets(*word_hashes(data[at[a] : at[b]], at[a : b + 1] - at[a]))
            shingles = pa.array([s.astype(np.int64) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array([_digest(s) for s in sets], pa.binary()), shingles], ["doc_id", "digest", "shingles"])


def _verified(pairs: DataFrame, sizes: DataFrame, docs: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) of documents with sets, with `linked`. Only documents in pairs are shingled again."""
    slim = sizes.select("doc_id", "n", "digest", "sketch")
    apart = F.aggregate(F.zip_with(_folded("ka", "kb"), _folded("kb", "ka"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    near = (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * threshold) & (apart * (100 + threshold) <= (F.col("na") + F.col("nb")) * (100 - threshold))
    told = (
        pairs.join(slim.toDF("a", "na", "da", "ka"), "a")
        .join(slim.toDF("b", "nb", "db", "kb"), "b")
        .select("a", "b", "na", "nb", (F.col("da") == F.col("db")).alias("same"), near.alias("near"))
    )
    told = stage(told, "pairs")
    open_ = told.where("near AND NOT same")
    ends = stage(open_.select(F.col("a").alias("doc_id")).union(open_.select(F.col("b").alias("doc_id"))).distinct(), "ends")
    sets = stage(docs.select("doc_id", "text").join(small(ends), "doc_id", "left_semi").mapInArrow(frugal(_shingled), "doc_id long, digest binary, shingles array<long>"), "sets")
    if sizes.where("repeated").isEmpty():
        sets = sets.select("doc_id", "shingles")
    else:  # one text of a repeated doc_id speaks for all
        sets = sets.join(slim.select("doc_id", "digest"), ["doc_id", "digest"], "left_semi").dropDuplicates(["doc_id"]).select("doc_id", "shingles")
    shared = F.size(F.array_intersect("sa", "sb"))
    tested = (
        open_.join(sets.toDF("b", "sb"), "b")
        .join(sets.toDF("a", "sa"), "a")
        .select("a", "b", (shared * 100 >= (F.col("na") + F.col("nb") - shared) * threshold).alias("linked"))
    )
    return stage(told.where("same OR NOT near").select("a", "b", F.col("same").alias("linked")).unionByName(tested), "verified")


def _apart(one: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Bits in which a sketch differs from each of others that are as long or twice or half as long."""
    w = min(len(one), rest.shape[1])
    fold = lambda x: x if x.shape[-1] == w else x[..., :w] ^ x[..., w:]
    return np.bitwise_count(fold(one) ^ fold(rest)).sum(1).astype(np.int64)


def _across(threshold: int, every: bool):
    """The pairs (a, b) within the cells of one part that lie across components and may still link. Of a
    cell with many more than it has members only each component's pair whose sketches are closest,
    and a row with `low` and `high` that the cell is to be looked at again, unless `every` pair is asked for."""

    def of_cell(comp: np.ndarray, n: np.ndarray, side: np.ndarray, sketches: dict[int, tuple[np.ndarray, np.ndarray]]):
        """(i, j, bits apart) by rows of the cell; sketches by length: rows and matrix."""
        main = np.bincount(np.unique(comp, return_inverse=True)[1])
        label = np.unique(comp, return_inverse=True)[1]
        main = label == main.argmax()  # a pair across components has an end outside the largest
        for w, (rows, bits) in sketches.items():
            for v in (w // 2, w, w * 2):
                if v not in sketches:
                    continue
                others, there = sketches[v]
                for at in np.flatnonzero(~main[rows]):
                    i = rows[at]
                    open_ = (comp[others] != comp[i]) & ((side[others] != side[i]) | (side[i] == 0)) & (main[others] | (others > i))
                    open_ &= np.minimum(n[others], n[i]) * 100 >= np.maximum(n[others], n[i]) * threshold
                    if len(js := np.flatnonzero(open_)):
                        apart = _apart(bits[at], there[js])
                        near = apart <= (n[i] + n[others[js]]) * (100 - threshold) // (100 + threshold)
                        yield np.full(near.sum(), i), others[js[near]], apart[near]

    def pairs(rows: pa.Table) -> pa.Table:
        pa.default_memory_pool().release_unused()  # of the group before
        rows = rows.sort_by([("cell", "ascending"), ("low", "ascending"), ("high", "ascending")])
        get = lambda c: rows.column(c).to_numpy()
        ids, comp, n, side = get("doc_id"), get("component"), get("n"), get("side")
        kept = rows.column("sketch").combine_chunks()
        words, at = kept.flatten().to_numpy().view(np.uint64), kept.offsets.to_numpy() - kept.offsets[0].as_py()
        wide = np.diff(at)
        cell = np.stack([get("cell"), get("low").astype(np.int64), get("high").astype(np.int64)])
        turn = np.append(np.flatnonzero(np.append(True, (cell[:, 1:] != cell[:, :-1]).any(0))), len(ids))
        out = []
        for a, b in zip(turn[:-1], turn[1:]):
            sketches = {}
            for w in np.unique(wide[a:b]):
                own = np.flatnonzero(wide[a:b] == w)
                sketches[int(w)] = own, words[at[a + own][:, None] + np.arange(w)]
            found, many = [], 0
            nearest: dict[int, tuple] = {}
            for i, j, apart in of_cell(comp[a:b], n[a:b], side[a:b], sketches):
                i, j = i + a, j + a
                many += len(i)
                if every or many <= MANY * (b - a):
                    found += zip(ids[i].tolist(), ids[j].tolist())
                if not every and len(i):
                    by = np.lexsort((apart, comp[j]))
                    by = by[np.append(True, np.diff(comp[j][by]) != 0)]
                    for k in by:
                        told = (int(apart[k]), int(ids[i[k]]), int(ids[j[k]]))
                        for c in (int(comp[i[k]]), int(comp[j[k]])):
                            nearest[c] = min(nearest.get(c, told), told)
            if not every and many > MANY * (b - a):
                found = [t[1:] for t in nearest.values()]
                out.append((int(cell[0, a]), None, int(cell[1, a]), int(cell[2, a])))
            out += [(min(p), max(p), None, None) for p in set(found)]
        names, kinds = ["a", "b", "low", "high"], [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 4, kinds)], names)

    return pairs


def _signer(threshold: int, salt: int):
    def rows(batches):
        for batch in batches:
            data, at = utf8(batch.column("text"))
            for a, b in slices(at):
                sets = shingle_sets(*word_hashes(data[at[a] : at[b]], at[a : b + 1] - at[a]))
                owner, sign = signatures(sets, threshold, salt)
                n = np.append(0, np.cumsum(np.bincount(owner, minlength=len(sets))))
                sign = sign[np.argsort(owner, kind="stable")].view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.ListArray.from_arrays(pa.array(n.astype(np.int32)), pa.array(sign))], ["doc_id", "signs"])

    return rows


def _cells(inside: DataFrame, docs: DataFrame, threshold: int) -> DataFrame:
    """(cell, doc_id) of the members that have to be compared with each other. inside: sign, doc_id of the
    open buckets. All buckets of one leader are one cell, unless they hold a crowd: then its members
    meet only where they share a signature of another partition too."""
    lead = inside.groupBy("sign").agg(F.min("doc_id").alias("cell"), F.count("*").alias("members")).where("members > 2")  # two have been compared
    cells = stage(inside.join(lead.drop("members"), "sign").select("cell", "doc_id").distinct(), "cells")
    crowds = stage(cells.groupBy("cell").agg(F.count("*").alias("members")).where(F.col("members") > CROWD).select("cell"), "crowds")
    if crowds.isEmpty():
        return cells
    crowd = stage(cells.join(small(crowds), "cell"), "crowd")
    ends = stage(crowd.select("doc_id").distinct(), "crowd-ends")
    again = docs.join(small(ends), "doc_id", "left_semi").mapInArrow(frugal(_signer(threshold, 7)), "doc_id long, signs array<long>")
    again = stage(again.select("doc_id", F.explode("signs").alias("again")).distinct(), "again")
    split = crowd.join(again, "doc_id").select(F.xxhash64("cell", "again").alias("cell"), "doc_id")
    return stage(cells.join(small(crowds), "cell", "left_anti").unionByName(split), "cells")


def _uncounted(batches):
    for batch in batches:
        data, at = utf8(batch.column("text"))
        sizes = [len(s) for a, b in slices(at) for s in shingle_sets(*word_hashes(data[at[a] : at[b]], at[a : b + 1] - at[a]))]
        yield pa.RecordBatch.from_arrays([pa.array(sizes, pa.int64())], ["n_shingles"])


def _sha(text: str):
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def _nodes(docs: DataFrame) -> DataFrame | None:
    """(own, sha, node): a number, none of the doc_ids, for each text of a doc_id that several rows have; None if no id
    repeats. docs: doc_id, text."""
    twice = stage(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "twice")
    if twice.isEmpty():
        return None
    texts = docs.join(small(twice), "doc_id", "left_semi").select(F.col("doc_id").alias("own"), _sha("text").alias("sha")).distinct()
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    at = F.monotonically_increasing_id()
    if low > -(1 << 62):
        node = F.lit(low) - 1 - at
    elif high < 1 << 62:
        node = F.lit(high) + 1 + at
    else:
        raise ValueError("doc_ids that repeat need room beside the others within 64 bits")
    return stage(texts.withColumn("node", node), "nodes")


def _renamed(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(doc_id, text) with nodes for the doc_ids that repeat."""
    odd = docs.withColumn("key", _sha("text")).join(small(nodes), (F.col("doc_id") == F.col("own")) & (F.col("key") == F.col("sha")), "left")
    return odd.select(F.coalesce("node", "doc_id").alias("doc_id"), "text")


def jaccard_components(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, and class_id.

    Links join documents whose shingle sets have a Jaccard similarity of threshold percent or more;
    component_id is the smallest doc_id reachable over links, class_id the smallest doc_id of an
    equal set. Null and empty texts have no shingles and no links. doc_ids are whole numbers. Rows that repeat one
    are told apart by their texts, each with its own shingles and links; rows without one are linked with nothing and
    have neither component nor class. Extra columns are ignored. Shingles are compared by 64-bit hashes.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    nameless = docs.where("doc_id IS NULL").select("text").mapInArrow(frugal(_uncounted), "n_shingles long")
    docs = docs.where("doc_id IS NOT NULL")
    nodes = _nodes(docs)
    if nodes is None:
        named = _components_by_id(docs, threshold)
    else:
        named = _components_by_id(_renamed(docs, nodes), threshold)
        own = small(nodes.select("node", "own"))
        named = stage(named.join(own, F.col("doc_id") == F.col("node"), "left").withColumn("doc_id", F.coalesce("own", "doc_id")).drop("node", "own"), "named")
        for name in ("component_id", "class_id"):
            least = named.groupBy(F.col(name).alias("was")).agg(F.min("doc_id").alias("least"))
            named = named.join(least, F.col(name) == F.col("was")).withColumn(name, F.col("least")).drop("was", "least")
    none = F.lit(None).cast("long")
    return named.unionByName(nameless.select(none.alias("doc_id"), "n_shingles", none.alias("component_id"), none.alias("class_id")))


def _components_by_id(docs: DataFrame, threshold: int) -> DataFrame:
    """The rows of jaccard_components for docs (doc_id, text) whose doc_id tells the text."""
    spark = docs.sparkSession
    bytes_ = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = min(1 << 22, max(shuffle_width(spark), bytes_ // PART_BYTES))
    found = stage(docs.mapInArrow(frugal(_mapper(parts, threshold)), _MAPPED).groupBy("part").applyInArrow(_reduce, _FOUND), "signed")
    rows = found.where("kind = 0").select(F.col("a").alias("doc_id"), "n", "digest", "sketch")
    sizes = stage(rows.groupBy("doc_id").agg(F.max(F.struct("n", "digest", "sketch")).alias("v"), (F.count("*") > 1).alias("repeated")).select("doc_id", "v.*", "repeated"), "sizes")
    buckets = found.where("kind = 1").select("a", "b", "sign")

    classes = stage(sizes.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("class_id")), "classes")
    member = stage(rows.select("doc_id").join(sizes, "doc_id").join(classes, "digest", "left").select("doc_id", "n", F.coalesce("class_id", "doc_id").alias("class_id")), "members")
    copies = member.where("doc_id <> class_id").select(F.col("class_id").alias("a"), F.col("doc_id").alias("b"))
    first = _verified(buckets.select("a", "b").distinct(), sizes, docs, threshold)
    edges = first.where("linked").select("a", "b").unionByName(copies)
    comp = components(edges)

    # buckets of three and more that the first comparison leaves in several components
    label = lambda end: comp.select(F.col("node").alias(end), F.col("component").alias(f"c{end}"))
    failed = first.where("NOT linked").join(label("a"), "a", "left").join(label("b"), "b", "left")
    failed = stage(failed.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b"), "failed")
    open_signs = stage(buckets.join(small(failed), ["a", "b"]).select("sign").distinct(), "open")
    if not open_signs.isEmpty():
        inside = buckets.join(small(open_signs), "sign").select("sign", F.explode(F.array("a", "b")).alias("doc_id"))
        members = _cells(stage(inside.distinct(), "inside"), docs, threshold)
        blocks = members.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        cells = members.join(stage(blocks, "blocks"), "cell").withColumn("own", F.pmod(F.xxhash64("doc_id"), "blocks").cast("int"))
        cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        cells = cells.select("cell", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), F.signum(F.col("own") - F.col("other")).cast("int").alias("side"), "doc_id")
        cells = stage(cells, "blocked")
        every = False
        while True:
            width = max(shuffle_width(spark, 4), cells.count() // PART_DOCS)
            told = sizes.join(comp.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", F.coalesce("component", "doc_id").alias("component"), "n", "sketch")
            part = F.pmod(F.xxhash64("cell", "low", "high"), F.lit(width)).alias("part")
            more = stage(cells.join(told, "doc_id").select("*", part).groupBy("part").applyInArrow(_across(threshold, every), "a long, b long, low int, high int"), "across")
            late = _verified(more.where("low IS NULL").select("a", "b").distinct(), sizes, docs, threshold).where("linked").select("a", "b")
            linked = not late.isEmpty()
            if linked:
                comp = components(late.unionByName(comp.select(F.col("component").alias("a"), F.col("node").alias("b"))))
            again = more.where("low IS NOT NULL").select(F.col("a").alias("cell"), "low", "high")
            if again.isEmpty():
                break
            cells = stage(cells.join(small(again), ["cell", "low", "high"], "left_semi"), "blocked")
            every = not linked  # where the closest pairs link nothing more, the rest is looked at too
    return (
        member.join(comp.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"), "class_id")
    )


def kept_documents(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """One document of each component stays, the one with the smallest doc_id (of several texts of that id, any one),
    with all columns. Documents without words or without a doc_id stay. Rows that repeat a doc_id and its text
    are copies, of which one stays."""
    slim = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id IS NOT NULL")
    nodes = _nodes(slim)
    if nodes is None:
        found = _components_by_id(slim, threshold)
        gone = stage(found.where("doc_id <> component_id").select("doc_id").distinct(), "gone")
        return docs.join(small(gone), "doc_id", "left_anti").select(*docs.columns)
    found = _components_by_id(_renamed(slim, nodes), threshold).select("doc_id", "component_id").distinct()
    found = stage(found.join(small(nodes), F.col("doc_id") == F.col("node"), "left").withColumn("own", F.coalesce("own", "doc_id")), "found")
    keep = found.groupBy("component_id").agg(F.min(F.struct("own", "doc_id")).alias("keep"))
    gone = stage(found.join(keep, "component_id").where(F.col("keep.doc_id") != F.col("doc_id")).select("doc_id", "own", "sha"), "gone")
    row, sha, stay = free_names(docs, "row", "sha", "stay")
    again = small(nodes.select(F.col("own").alias(row)).distinct())
    plain = docs.withColumn(row, F.col("doc_id").cast("long")).join(small(gone.where("sha IS NULL").select(F.col("doc_id").alias(row))), row, "left_anti").join(again, row, "left_anti")
    left = nodes.join(gone.select(F.col("doc_id").alias("node")), "node", "left_anti")
    left = small(stage(left.select(F.col("own").alias(stay), F.col("sha").alias(f"{stay}_sha")), "left"))
    odd = docs.withColumns({row: F.col("doc_id").cast("long"), sha: _sha("text")}).join(again, row, "left_semi")
    odd = odd.join(left, (F.col(row) == F.col(stay)) & (F.col(sha) == F.col(f"{stay}_sha")), "left_semi").dropDuplicates([row, sha])
    return plain.select(*docs.columns).unionByName(odd.select(*docs.columns))


def op8_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP8_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
x AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b, c = p.n AND c = q.n AS same FROM x JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
k AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a),
e AS (SELECT a AS doc_id, min(b) AS class_id FROM l WHERE same GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, least(doc_id, coalesce(class_id, doc_id)) AS class_id
FROM k LEFT JOIN n USING (doc_id) LEFT JOIN e USING (doc_id)
"""
