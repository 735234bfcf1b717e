"""Exact Jaccard self-join of documents on word shingles, with connected components.

Jaccard distance is a metric, but nearly all pairs of documents are at a distance
close to 1, so whole documents as pivots separate nothing: every triangle window
would hold the corpus (figures in the README).  Regions are therefore made in the
metric that bounds it, the size of the symmetric difference.  Two linked sets of
``a`` and ``b`` shingles differ in at most ``D = (100-t)(a+b)/(100+t)`` of them.

1. *Regions.*  Sets are grouped by size; a set near a border is replicated to the next
   group.  A group cuts the space of shingles into more than ``D`` slices, so linked sets
   agree on a whole slice: the content of a slice is a region.
2. *Pivots.*  Each region takes as pivot the member that shares most regions, and its
   members are compared with pivots exactly.  A region whose members all connect is
   done, whatever its size.
3. *The rest, recursively.*  Components that share a region without a link between its
   pivot and a member stay open.  A member with more shingles that no other open component
   has than linked sets can differ in has no link left to find and goes.  The others form
   regions again, and pairs from different components are compared exactly unless their
   sizes, such shingles, the number of regions they share, or the differences of their
   distances to fixed pivots (a triangle window) rule a link out.

Equal sets cost one entry per block, and nothing is gathered by region outside a shard.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rolemill.llm.blocks import (
    BATCH_BYTES, BLOCK_BYTES, answer, ask, by_shard, from_bytes, pack, restore, shard_count, tell, to_bytes)
from rolemill.llm.graph import components
from rolemill.llm.words import U64, Words, hash_ranges, mix, runs
from rolemill.plans.session import materialize

SHINGLE = 4
PERCENT = 85
TILE = 512
SLICES = 256  # slices of the distance tables
COARSE = 64  # slices of the small tables that travel with regions, half a byte each
SETS_AT_ONCE = 1600
TEXT_AT_ONCE = 2 << 20  # bytes of texts whose words are taken together
PARTS = (4, 1)  # lone shingles are counted in a fourth of the space of shingles first, then in all of it
OPEN = "key long, root long, body binary, size long, slices binary, lone long, coarse binary"


def shingle_sets(texts, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle hash) without repeats, ordered by both, and the size of each set."""
    words = Words(texts, lower=True)
    hashes = words.hashes(21)
    at, text = runs(words.first, k)
    found = hash_ranges(hashes, at, at + k, 22)
    few = np.flatnonzero((words.counts() > 0) & (words.counts() < k))
    if len(few):
        whole = hash_ranges(hashes, words.first[few], words.first[few + 1], 22)
        text, found = np.concatenate((text, few)), np.concatenate((found, whole))
    order = np.lexsort((found, text))
    text, found = text[order], found[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (found[1:] != found[:-1])
    text, found = text[new], found[new]
    return text, found, np.bincount(text, minlength=len(words.first) - 1)


def _stretches(sizes: np.ndarray) -> list[tuple[int, int]]:
    """Starts and ends of neighbours that take TEXT_AT_ONCE together; what takes more is alone."""
    starts, held = [0], 0
    for i, size in enumerate(sizes.tolist()):
        if i > starts[-1] and held + size > TEXT_AT_ONCE:
            starts.append(i)
            held = 0
        held += size
    return list(zip(starts, [*starts[1:], len(sizes)]))


def _sets(texts: pa.Array | pa.ChunkedArray, sizes: np.ndarray, k: int, opened=lambda part: part) -> tuple[np.ndarray, ...]:
    """`shingle_sets` of texts of the given sizes, a few megabytes at a time."""
    out = []
    for start, end in _stretches(sizes):
        text, found, n = shingle_sets(opened(texts.slice(start, end - start)), k)
        out.append((text + start, found, n))
    return tuple(np.concatenate(c) for c in zip(*out))


def _text_sets(texts: pa.Array | pa.ChunkedArray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return _sets(texts, pc.fill_null(pc.binary_length(texts), 0).to_numpy(), k)


#: Intermediate tables: Python gets few bytes at a time, and zstd streams where snappy holds whole pages outside the heap.
_kept = partial(materialize, batch_bytes=BATCH_BYTES, compression="zstd")


def _summed(index: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, U64)
    np.add.at(out, index, values)
    return out


def size_groups(percent: int, largest: int) -> tuple[np.ndarray, np.ndarray]:
    """Largest set size of each group and its number of slices (more than linked sets can differ by)."""
    top = [max(1, (99 + percent) // (2 * (100 - percent)))]
    while top[-1] < largest:
        top.append(max(top[-1] + 1, top[-1] * 3 // 2, top[-1] * 100 // percent))
    top = np.array([*top, max(top[-1] * 3 // 2, top[-1] * 100 // percent) + 1], np.int64)
    differ = 2 * top * (100 - percent) // (100 + percent)
    return top, np.where(differ > 0, differ + 2 + differ // 40, 1)


def signatures(text: np.ndarray, found: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, ...]:
    """Slice contents of every set: (hash, text, whether made in the next size group), and filled slices by group.

    An empty slice counts only for a set with so many of them that a partner could
    differ in all others; such a partner has as many and gives them too.
    """
    top, slices = size_groups(percent, int(sizes.max()) if len(sizes) else 1)
    own = np.searchsorted(top, sizes)
    above = np.where((sizes > 0) & (100 * sizes >= percent * (top[own] + 1)), own + 1, -1)
    out_hash, out_text, out_above, in_use = [], [], [], []
    for next_up, group in enumerate((np.where(sizes > 0, own, -1), above)):
        width = np.where(group >= 0, slices[group], 0)
        start = np.cumsum(width) - width
        mine = group[text] >= 0
        t, f = text[mine], found[mine]
        place = start[t] + (mix(f, 31) % width[t].astype(U64)).astype(np.int64)
        total = int(width.sum())
        content = _summed(place, mix(f, 32), total)
        filled = np.bincount(place, minlength=total) > 0
        of = np.repeat(np.arange(len(sizes)), width)
        partner = np.minimum(top[group], 100 * sizes // percent)
        differ = (100 - percent) * (sizes + partner) // (100 + percent)
        in_use.append(np.bincount(of[filled], minlength=len(sizes)))
        scarce = in_use[-1] <= differ
        use = np.flatnonzero(filled | scarce[of])
        name = group[of[use]].astype(U64) * U64(1 << 40) + (use - start[of[use]]).astype(U64)
        out_hash.append(mix(content[use] ^ mix(name, 33), 34))
        out_text.append(of[use])
        out_above.append(np.full(len(use), next_up, bool))
    return np.concatenate(out_hash), np.concatenate(out_text), np.concatenate(out_above), np.stack(in_use)


def _groups(signature: np.ndarray, order_by: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries whose signature occurs twice or more, ordered by it; group starts and sizes."""
    order = np.argsort(signature, kind="stable")
    ordered = signature[order]
    same = ordered[1:] == ordered[:-1]
    shared = np.zeros(len(order), bool)
    shared[1:] |= same
    shared[:-1] |= same
    order = order[shared]
    order = order[np.lexsort((order_by[order], signature[order]))]
    new = np.ones(len(order), bool)
    new[1:] = signature[order][1:] != signature[order][:-1]
    starts = np.flatnonzero(new)
    return order, starts, np.diff(np.append(starts, len(order)))


STARS = "a long, b long, n long, f1 long, f2 long, is_row boolean"


def _stars(entries: list[bytes]) -> pa.Table:
    """Pairs (pivot, member) of all regions of a shard, and in ``n`` the number of regions that propose each.

    Pivot is the member that shares most regions with others, so one document tends to be
    the pivot of many regions and to lie in the middle of its group.
    """
    signature, keys = (np.concatenate(c) for c in zip(*(from_bytes(e, U64, np.int64) for e in entries)))
    order, starts, sizes = _groups(signature, mix(keys.astype(U64), 41))
    members, of = np.unique(keys[order], return_inverse=True)
    central = np.bincount(of, np.repeat(np.log(np.maximum(sizes, 1)), sizes), len(members))
    group = np.repeat(np.arange(len(starts)), sizes)
    first = np.lexsort((mix(members.astype(U64), 41)[of], -np.round(central, 6)[of], group))[starts] if len(starts) else starts
    a, b = np.repeat(members[of[first]], sizes), keys[order]
    a, b = a[a != b], b[a != b]
    pairs = np.lexsort((b, a))
    a, b = a[pairs], b[pairs]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    votes = np.diff(np.append(np.flatnonzero(new), len(a)))
    a, b = a[new], b[new]
    none = np.zeros(len(a), np.int64)
    return pa.table([pa.array(a), pa.array(b), pa.array(votes, pa.int64()), pa.array(none), pa.array(none),
                     pa.array(none > 0)], names=["a", "b", "n", "f1", "f2", "is_row"])


def _apart_by(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sum of absolute differences of two tables of counts, a lower bound of the symmetric difference of the sets."""
    return (np.maximum(x, y) - np.minimum(x, y)).sum(1, dtype=np.int64)


def _tables(text: np.ndarray, found: np.ndarray, n: int, slices: int, seed: int, most: int = 255) -> np.ndarray:
    """Counts of every set in so many slices; a count above ``most`` stays there, which only lowers differences."""
    at = text * slices + (mix(found, seed) % U64(slices)).astype(np.int64)
    return np.minimum(np.bincount(at, minlength=n * slices), most).astype(np.uint8).reshape(n, slices)


def _coarse(text: np.ndarray, found: np.ndarray, n: int) -> np.ndarray:
    """Tables of COARSE counts up to 15, two in a byte."""
    counts = _tables(text, found, n, COARSE, 62, most=15)
    return counts[:, ::2] | counts[:, 1::2] << 4


def _summed_pairs(found: list[np.ndarray]) -> np.ndarray:
    """Rows (a, b, agree, need) without repeated pairs; ``agree`` is added up."""
    a, b, agree, need = np.concatenate(found, axis=1)
    order = np.lexsort((b, a))
    a, b, agree, need = a[order], b[order], agree[order], need[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    starts = np.flatnonzero(new)
    return np.stack((a[starts], b[starts], np.add.reduceat(agree, starts) if len(starts) else agree, need[starts]))


def _across(entries: list[bytes], percent: int) -> pa.Table:
    """Pairs of one region that are in different components and whose sizes and small tables allow a link.

    ``agree`` is the number of slices of the shard on which a pair agrees, counted in the
    size group of its larger set only.  There linked sets differ in at most as many slices
    as shingles, so they agree on at least ``need`` of those that the fuller one has filled.
    An entry's sizes carry the number of lone shingles (see `_still_open`) above 32 bits, its
    small tables leave those out: two sets differ in all of them besides what the tables show.
    """
    facts, coarse, signature, row, at = [], [], [], [], 0
    for e in entries:
        m = int(np.frombuffer(e, np.int64, 1)[0])
        facts.append(from_bytes(e[8:8 + 32 * m], np.int64, np.int64, np.int64, np.int32, np.int32))
        end = 8 + (32 + COARSE // 2) * m
        coarse.append(np.frombuffer(e, np.uint8, COARSE // 2 * m, 8 + 32 * m).reshape(m, COARSE // 2))
        s, i = from_bytes(e[end:], U64, np.uint32)
        signature.append(s)
        row.append(i.astype(np.int64) + 2 * at)
        at += m
    key, root, size, *filled = (np.concatenate(x) for x in zip(*facts))
    coarse, signature, row = np.concatenate(coarse), np.concatenate(signature), np.concatenate(row)
    filled = np.stack(filled).astype(np.int64)
    size, lone = size & 0xFFFFFFFF, size >> 32
    order, starts, counts = _groups(signature, key[row >> 1].astype(U64))
    times, members = {}, {}
    for start, count in zip(starts.tolist(), counts.tolist()):
        own = row[order[start:start + count]]
        if (root[own >> 1] == root[own[0] >> 1]).all():
            continue
        name = (key[own >> 1] * 2 + (own & 1)).tobytes()
        times[name] = times.get(name, 0) + 1
        members[name] = own
    found, held = [np.zeros((4, 0), np.int64)], 0
    for name, own in members.items():
        own = own[np.argsort(root[own >> 1], kind="stable")]
        above, own = own & 1, own >> 1
        full = filled[above, own]
        for i in range(0, len(own), TILE):
            for j in range(i, len(own), TILE):
                x, y = own[i:i + TILE], own[j:j + TILE]
                if root[x[0]] == root[y[-1]]:  # in order of roots: one component
                    continue
                low = np.minimum(size[x][:, None], size[y][None, :])
                high = np.maximum(size[x][:, None], size[y][None, :])
                p, q = np.nonzero((root[x][:, None] != root[y][None, :]) & (100 * low >= percent * high)
                                  & ((above[i:i + TILE][:, None] & above[j:j + TILE][None, :]) == 0))
                differ = (100 - percent) * (size[x[p]] + size[y[q]]) // (100 + percent)
                cx, cy = coarse[x[p]], coarse[y[q]]
                near = _apart_by(cx & 15, cy & 15) + _apart_by(cx >> 4, cy >> 4) <= differ - lone[x[p]] - lone[y[q]]
                p, q, differ = p[near], q[near], differ[near]
                need = np.maximum(1, np.maximum(full[i + p], full[j + q]) - differ)
                p, q = key[x[p]], key[y[q]]
                if i == j:
                    once = p < q
                    p, q, need = p[once], q[once], need[once]
                found.append(np.stack((np.minimum(p, q), np.maximum(p, q), np.full(len(p), times[name]), need)))
                held += len(p)
                if held > 2_000_000 and held > 2 * found[0].shape[1]:
                    found = [_summed_pairs(found)]
                    held = found[0].shape[1]
    a, b, agree, need = _summed_pairs(found)
    return pa.table([pa.array(a), pa.array(b), pa.array(agree.astype(np.int32)), pa.array(need.astype(np.int32))],
                    names=["a", "b", "agree", "need"])


def _near_enough(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Pairs that their sizes and distance tables cannot rule out.

    A set's counts in slices are its distances to fixed pivots; by the triangle inequality
    their differences bound the symmetric difference of two sets from below.
    """
    def check(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, SLICES) for c in ("xa", "xb"))
            total = batch.column("na").to_numpy() + batch.column("nb").to_numpy()
            close = (100 + percent) * _apart_by(x, y) <= (100 - percent) * total
            yield batch.select(["a", "b"]).filter(pa.array(close))

    side = lambda c: texts.select(F.col("key").alias(c), F.col("size").alias("n" + c), F.col("slices").alias("x" + c))
    return (pairs.join(side("b"), "b").join(side("a"), "a")
            .where((100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")))
            .select("a", "b", "na", "nb", "xa", "xb").mapInArrow(check, "a long, b long"))


def _squeezed(texts: pa.Array) -> pa.Array:
    """Texts as compressed binary, their length in front: candidates' texts are written and joined several times."""
    codec = pa.Codec("zstd", compression_level=1)
    raw = [t.as_py().encode() if t.is_valid else b"" for t in texts]
    return pa.array([len(r).to_bytes(8, "little") + codec.compress(r, asbytes=True) for r in raw], pa.binary())


def _whole(bodies: pa.Array) -> pa.Array:
    """The texts of `_squeezed`; equal neighbours, as of one pivot's pairs, are opened once."""
    codec, out, last, text = pa.Codec("zstd"), [], None, None
    for b in bodies.to_pylist():
        if b != last:
            last, text = b, codec.decompress(b[8:], int.from_bytes(b[:8], "little"), asbytes=True).decode()
        out.append(text)
    return pa.array(out, pa.string())


def _bytes_of(bodies: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Sizes of the texts of `_squeezed`."""
    return np.frombuffer(b"".join(pc.binary_slice(bodies, 0, 8).to_pylist()), "<i8")


def _opened(bodies: pa.Array | pa.ChunkedArray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`shingle_sets` of the texts of `_squeezed`, of which a few megabytes are open at a time."""
    return _sets(bodies, _bytes_of(bodies), k, _whole)


def _lone(entries: list[bytes]) -> list[bytes]:
    """For the shingles that blocks ask about, a bit each: whether one component alone has it.

    An entry names roots (-1: several in that block), then has 32 bits and the root's place for each shingle.
    Two shingles with the same 32 bits pass for one, so a bit may be missing, but none is set wrongly.
    """
    tokens, roots = [], []
    for e in entries:
        m = int(np.frombuffer(e, np.int64, 1)[0])
        token, at = from_bytes(e[8 + 8 * m:], np.uint32, np.uint32)
        tokens.append(token)
        roots.append(np.frombuffer(e, np.int64, m, 8)[at])
    ends = np.cumsum([len(t) for t in tokens])
    token, root = np.concatenate(tokens), np.concatenate(roots)
    order = np.argsort(token, kind="stable")
    first = np.ones(len(order), bool)
    first[1:] = token[order][1:] != token[order][:-1]
    starts = np.flatnonzero(first)
    low, high = np.minimum.reduceat(root[order], starts), np.maximum.reduceat(root[order], starts)
    out = np.zeros(len(token), bool)
    out[order] = np.repeat((low == high) & (low >= 0), np.diff(np.append(starts, len(order))))
    return [np.packbits(x).tobytes() for x in np.split(out, ends[:-1])]


def _still_open(sets: DataFrame, k: int, percent: int, part: int) -> DataFrame:
    """The sets that may link with one of another component, as OPEN.

    A shingle is lone if of all these sets only those of one component have it, so two sets
    of different components differ in the lone shingles of both: a set with more of them than
    linked sets can differ in has no link outside its component, whatever region it shares.
    With ``part`` above 1 only that fraction of the shingles, by hash, is looked at in every
    set.  ``lone`` is then too small and fewer sets go, but none wrongly.
    """
    blocks = pack(sets.select("key", "root", "body", "size", "slices"), "body", BLOCK_BYTES // 4)
    shards = shard_count(blocks, 4_000_000 // part)

    def parted(rows):
        text, found, sizes = _opened(rows["body"], k)
        seen = mix(found, 63) % U64(part) == 0
        return text, found, sizes, seen

    def ask_components(block, rows):
        text, found, _, seen = parted(rows)
        text, found = text[seen], found[seen]
        roots, component = np.unique(rows["root"].to_numpy(), return_inverse=True)
        order = np.argsort(found, kind="stable")
        hashes, starts = np.unique(found[order], return_index=True)
        if not len(hashes):
            return
        of = component[text[order]]
        low, high = np.minimum.reduceat(of, starts), np.maximum.reduceat(of, starts)
        roots = np.append(roots, -1)
        for s, (h, c) in by_shard(shards, hashes, hashes, np.where(low == high, low, len(roots) - 1)):
            used, at = np.unique(c, return_inverse=True)
            yield s, np.int64(len(used)).tobytes() + roots[used].tobytes() + to_bytes(
                (h // U64(shards)).astype(np.uint32), at.astype(np.uint32))

    def use(block, rows, told):
        if rows is None:
            return pa.table({"key": pa.array([], pa.int64()), "root": pa.array([], pa.int64()), "body": pa.array([], pa.binary()),
                             "size": pa.array([], pa.int64()), "slices": pa.array([], pa.binary()),
                             "lone": pa.array([], pa.int64()), "coarse": pa.array([], pa.binary())})
        text, found, sizes, seen = parted(rows)
        hashes, at = np.unique(found[seen], return_inverse=True)
        asked = dict(zip(*(x.tolist() for x in np.unique(hashes % U64(shards), return_counts=True))))
        bits = {t["shard"]: np.unpackbits(np.frombuffer(t["entries"], np.uint8), count=asked[t["shard"]]) for t in told}
        alone = np.zeros(len(found), bool)
        alone[seen] = restore(shards, hashes, bits, bool)[at]
        lone = np.bincount(text[alone], minlength=len(sizes))
        coarse = _coarse(text[~alone], found[~alone], len(sizes))
        out = (rows.append_column("lone", pa.array(lone.astype(np.int64)))
               .append_column("coarse", pa.array([r.tobytes() for r in coarse], pa.binary())))
        return out.filter(pa.array(100 * (sizes - lone) >= percent * sizes))

    return _kept(tell(blocks, answer(ask(blocks, ask_components), _lone), use, OPEN), "open")


def _linked(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b, linked) for the pairs of keys that may link, by comparing their whole sets."""
    def compare(batches):
        for batch in batches:
            for start, end in _stretches(_bytes_of(batch.column("ta")) + _bytes_of(batch.column("tb"))):
                part = batch.slice(start, end - start)
                ta, fa, na = shingle_sets(_whole(part.column("ta")), k)
                tb, fb, nb = shingle_sets(_whole(part.column("tb")), k)
                text, found = np.concatenate((ta, tb)), np.concatenate((fa, fb))
                order = np.lexsort((found, text))
                text, found = text[order], found[order]
                twice = (text[1:] == text[:-1]) & (found[1:] == found[:-1])
                both = np.bincount(text[1:][twice], minlength=part.num_rows)
                ok = (100 * both >= percent * (na + nb - both)) & (both > 0)
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(ok)],
                                                 names=["a", "b", "linked"])

    a = texts.select(F.col("key").alias("a"), F.col("body").alias("ta"))
    b = texts.select(F.col("key").alias("b"), F.col("body").alias("tb"))
    return _near_enough(pairs, texts, percent).join(b, "b").join(a, "a").select("a", "b", "ta", "tb").mapInArrow(
        compare, "a long, b long, linked boolean")


class JaccardJoin:
    """Clusters of a table: ``rows`` has (key, id, n_shingles, root, component_id), one per row of the table.

    ``root`` is the key that names a row's component, null for a row without links; ids need not be unique.
    """

    def __init__(self, docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = SHINGLE,
                 percent: int = PERCENT):
        if not 1 <= percent < 100:
            raise ValueError("percent lies between 1 and 99")
        self.docs = docs
        self.id = next(f.name for f in docs.schema if f.name == id)
        self.text = next(f.name for f in docs.schema if f.name == text)
        self.shingle, self.percent = shingle, percent
        self.blocks = pack(docs, self.text)
        self.rows = self._cluster()

    def _cluster(self) -> DataFrame:
        k, percent, id_, text_ = self.shingle, self.percent, self.id, self.text
        shards = shard_count(self.blocks, 2_200_000)

        def ask_regions(block, rows):
            text, found, sizes = _text_sets(rows[text_], k)
            n = len(sizes)
            f1, f2 = _summed(text, mix(found, 51), n), _summed(text, mix(found, 52), n)
            ids = rows[id_].cast(pa.int64())
            keys = (block << 20) + np.arange(n)
            known = np.array([x is not None for x in ids.to_pylist()])
            yield -1 - block % shards, to_bytes(keys, ids.fill_null(0).to_numpy(), known.astype(np.int64),
                                                sizes.astype(np.int64), f1, f2)
            _, first = np.unique(np.stack((f1, f2, sizes.astype(U64))), axis=1, return_index=True)
            once = np.zeros(n, bool)
            once[first] = True
            kept = once[text]
            signature, of, _, _ = signatures(text[kept], found[kept], np.where(once, sizes, 0), percent)
            for s, cols in by_shard(shards, signature, signature, keys[of]):
                yield s, to_bytes(*cols)

        def decide(table: pa.Table) -> pa.Table:
            entries = table["entries"].to_pylist()
            if table["shard"][0].as_py() >= 0:
                return _stars(entries)
            keys, ids, known, sizes, f1, f2 = (np.concatenate(c) for c in zip(
                *(from_bytes(e, np.int64, np.int64, np.int64, np.int64, np.int64, np.int64) for e in entries)))
            return pa.table([pa.array(keys), pa.array(ids, mask=known == 0), pa.array(sizes), pa.array(f1), pa.array(f2),
                             pa.array(np.ones(len(keys), bool))], names=["a", "b", "n", "f1", "f2", "is_row"])

        found = _kept(ask(self.blocks, ask_regions).groupBy("shard").applyInArrow(decide, STARS), "regions")
        rows = found.where("is_row").select(F.col("a").alias("key"), F.col("b").alias("id"), "n", "f1", "f2")
        facts = F.struct("n", "f1", "f2")
        stars = found.where("not is_row").groupBy("a", "b").agg(F.sum("n").alias("votes"))
        # Members of regions: also equal sets inside one block, of which only the first asked.
        block = F.shiftright("key", 20)
        local = (rows.where("n > 0").groupBy(block.alias("block"), "n", "f1", "f2")
                 .agg(F.min("key").alias("a"), F.collect_list("key").alias("keys")).where(F.size("keys") > 1)
                 .select("a", F.explode("keys").alias("b")).where("a <> b"))
        known = (stars.join(rows.select(F.col("key").alias("a"), facts.alias("fa")), "a")
                 .join(rows.select(F.col("key").alias("b"), facts.alias("fb")), "b"))
        known = _kept(known.select("a", "b", "votes", (F.col("fa") == F.col("fb")).alias("equal")), "stars")
        compared = known.select("a").unionByName(known.select(F.col("b").alias("a"))).distinct()
        texts = self._texts(compared)
        # First the pivot that most regions propose, then the other pivots of what is still apart.
        rank = F.struct("votes", F.xxhash64("a"), "a")
        first = known.where("not equal").groupBy("b").agg(F.max_by("a", rank).alias("a")).select("a", "b")
        tested = _kept(_linked(first, texts, k, percent).unionByName(
            known.where("equal").select("a", "b", F.lit(True).alias("linked"))).unionByName(
            local.withColumn("linked", F.lit(True))), "tested")
        final = _kept(components(tested.where("linked").select("a", "b")), "components")
        for candidates in (lambda: (self._apart(known, final).select("a", "b"), texts),
                           lambda: self._across_components(self._apart(known, final), final, texts)):
            pairs, bodies = candidates()
            more = _kept(_linked(pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti"),
                                       bodies, k, percent), "tested")
            tested = tested.unionByName(more)
            final = _kept(components(final.select(F.col("node").alias("a"), F.col("root").alias("b"))
                                           .unionByName(more.where("linked").select("a", "b"))), "components")
        members = final.join(rows.select(F.col("key").alias("node"), "id"), "node")
        lowest = members.groupBy("root").agg(F.min("id").alias("component_id"))
        named = final.join(lowest, "root").select(F.col("node").alias("key"), "root", "component_id")
        return rows.join(named, "key", "left").select("key", "id", F.col("n").alias("n_shingles"), "root",
                                                      F.coalesce("component_id", "id").alias("component_id"))

    def _texts(self, keys: DataFrame) -> DataFrame:
        """(key, body, size, slices) of the given keys, column ``a``."""
        text_, k = self.text, self.shingle

        def pick(block, rows, told):
            at = np.array(sorted(t["a"] - (block << 20) for t in told), np.int64) if rows is not None else np.zeros(0, np.int64)
            body = rows[text_].cast(pa.string()).take(pa.array(at)).combine_chunks() if len(at) else pa.array([], pa.string())
            text, found, sizes = _text_sets(body, k)
            slices = _tables(text, found, len(at), SLICES, 61)
            return pa.table([pa.array((block << 20) + at), _squeezed(body), pa.array(sizes.astype(np.int64)),
                             pa.array([r.tobytes() for r in slices], pa.binary())], names=["key", "body", "size", "slices"])

        asked = keys.select(F.shiftright("a", 20).alias("block"), "a")
        return _kept(tell(self.blocks, asked, pick, "key long, body binary, size long, slices binary"), "texts")

    @staticmethod
    def _apart(stars: DataFrame, linked: DataFrame) -> DataFrame:
        """Pairs (a, b) of pivots and members in different components, with their roots ``ra`` and ``rb``."""
        of = lambda c: linked.select(F.col("node").alias(c), F.col("root").alias("r" + c))
        return (stars.select("a", "b").join(of("a"), "a", "left").join(of("b"), "b", "left")
                .select("a", "b", F.coalesce("ra", "a").alias("ra"), F.coalesce("rb", "b").alias("rb")).where("ra <> rb"))

    def _across_components(self, apart: DataFrame, linked: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Pairs (a, b) of one region, in different components so far, for the components of ``apart``; and their texts."""
        open_ = apart.select(F.col("ra").alias("root")).unionByName(apart.select(F.col("rb").alias("root"))).distinct()
        everyone = linked.unionByName(open_.join(linked.select("root").distinct(), "root", "left_anti")
                                      .select(F.col("root").alias("node"), "root"))
        left = texts.join(everyone.join(open_, "root", "left_semi").select(F.col("node").alias("key"), "root"), "key")
        for part in PARTS:
            left = _still_open(left, self.shingle, self.percent, part)
        return (self._in_regions(left).groupBy("a", "b").agg(F.sum("agree").alias("agree"), F.max("need").alias("need"))
                .where("agree >= need").select("a", "b"), left)

    def _in_regions(self, left: DataFrame) -> DataFrame:
        """Rows (a, b, agree, need) of all shards, see `_across`, for sets as OPEN."""
        k, percent = self.shingle, self.percent
        shards = max(1, left.count() * 4000 // (8 << 20))

        def emit(batches):
            for batch in batches:
                for at in range(0, batch.num_rows, SETS_AT_ONCE):
                    part = batch.slice(at, SETS_AT_ONCE)
                    text, found, sizes = _opened(part.column("body"), k)
                    facts = [part.column("key").to_numpy(), part.column("root").to_numpy(),
                             sizes.astype(np.int64) | part.column("lone").to_numpy() << 32]
                    signature, who, above, filled = signatures(text, found, sizes, percent)
                    coarse = np.frombuffer(b"".join(part.column("coarse").to_pylist()), np.uint8)
                    facts += [*filled.astype(np.int32), coarse.reshape(-1, COARSE // 2)]
                    shard, entries = [], []
                    for s, (sig, w, up) in by_shard(shards, signature, signature, who, above):
                        docs, local = np.unique(w, return_inverse=True)
                        shard.append(s)
                        entries.append(np.int64(len(docs)).tobytes() + to_bytes(*(f[docs] for f in facts))
                                       + to_bytes(sig, (2 * local + up).astype(np.uint32)))
                    yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(entries, pa.binary())],
                                                     names=["shard", "entries"])

        return (left.mapInArrow(emit, "shard int, entries binary").groupBy("shard")
                .applyInArrow(lambda t: _across(t["entries"].to_pylist(), percent), "a long, b long, agree int, need int"))

    def result(self) -> DataFrame:
        """One row per row of the table: its id, ``n_shingles`` and ``component_id``."""
        return self.rows.select(F.col("id").alias(self.id), "n_shingles", "component_id")

    def representatives(self) -> DataFrame:
        """The rows of the table that stay: of each group of linked rows the one with the smallest id, and all others.

        Only links make a group: rows with one id but unlinked texts all stay, and linked rows
        without an id are one group.  Among equal ids the first row of the table stays.
        """
        id_ = self.id
        first = F.min_by("key", F.struct(F.col("id").isNull(), "id", "key"))
        groups = self.rows.where("root is not null").groupBy("root").agg(first.alias("key"))
        keep = groups.select("key").unionByName(self.rows.where("root is null").select("key"))
        schema = StructType(list(self.docs.schema))

        def pick(block, rows, told):
            if rows is None:
                return pa.table({id_: pa.array([], pa.int64())})
            return rows.take(pa.array(sorted(t["key"] - (block << 20) for t in told), pa.int64()))

        return tell(self.blocks, keep.select(F.shiftright("key", 20).alias("block"), "key"), pick, schema)
