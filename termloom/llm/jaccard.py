"""Word n-gram Jaccard self-join with signature trees.

A pair of Jaccard t or more shares at least t of either set, so it shares one of each set's rarest (1 - t) n-grams,
whatever the order of rarity (prefix filtering). Groups are therefore found exactly:

1. Texts with equal n-gram sets are told by their signatures and stand behind one representative.
2. Each n-gram's document frequency is counted in buckets of hashes. A chunk of texts travels as sorted, difference-coded
   hashes with the texts' numbers in the chunk, and n-grams of several texts come back to their chunk. An n-gram that a
   chunk has several times goes to its bucket once, with their number, so that a bucket isn't filled by a frequent one. A
   set of which too few n-grams are anywhere else has no partner and goes.
3. Sets that share one of their rarest n-grams are connected; a group is a connected component.
4. In each group a signature tree is built: leaves are sets, a node holds the OR of the token bitmaps below it and the
   range of their sizes. A traversal of two trees against each other drops a pair of nodes whose maximum possible overlap,
   from the common bits and the sizes, is below what the threshold needs. Pairs of leaves that are left are verified.

A group of many sets is cut into blocks of similar size (``_blocks``); each pair of blocks that sizes allow is a task of
its own. Tasks return counts of links and a spanning forest, never the pairs, so a group of n sets gives n rows.

N-grams are known by 48 bits of hash: two that differ agree by chance in one of 10**9 pairs of texts of 500 words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import NO_ID, cut, doc_id, documents, parts, released
from ._words import U, Words, mix, ngrams

N, THRESHOLD, FAN = 3, 0.5, 8
#: Stands for the texts of an n-gram that a chunk has several times.
SEVERAL = np.uint32(2**32 - 1)
#: Bytes and number of texts of a chunk, n-grams that a bucket is meant to hold.
CHUNK, MOST, PER_BUCKET = 8_000_000, 50_000, 1_000_000
#: Sets of a block: from the first number on a group is cut into eight, up to the second each.
BLOCK = 1024, 32768
_SALT = [U((k + 1) * 0x9E3779B97F4A7C15 % 2**64) for k in (40, 41)]


def gram_sets(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes text by text, and where each text's begin. A text of fewer than n words has one gram of all of them."""
    w = Words(texts)
    at, h = w.grams(n)
    of = w.doc[at]
    count = np.diff(w.first)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        extra = np.array([ngrams(w.hash[w.first[i] : w.first[i + 1]], int(count[i]))[1][0] for i in short], U)
        of, h = np.concatenate([of, short]), np.concatenate([h, extra])
    order = np.lexsort((h, of))
    of, h = of[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    of, h = of[new], h[new]
    return h, np.searchsorted(of, np.arange(len(texts) + 1))


def _sums(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    out = np.zeros(len(first) - 1, U)
    some = np.flatnonzero(np.diff(first))
    if len(some):
        out[some] = np.add.reduceat(h, first[some])
    return out


# ------------------------------------------------------------------ chunks


def _chunks(frames: Iterator[pd.DataFrame], n: int, piece: int = 1_000_000) -> Iterator[tuple[int, int, pd.DataFrame, np.ndarray, np.ndarray]]:
    """(chunk, its content's hash, rows, n-gram hashes, n-grams of each row). Numbers follow from the task's partition, so that a second reading gives the same."""
    task = TaskContext.get()
    number, seq = (task.partitionId() if task else 0) << 16, 0
    rows, hashes, sizes, held, count = [], [], [], 0, 0

    def flush():
        nonlocal rows, hashes, sizes, held, count, seq
        h, size, f = np.concatenate(hashes), np.concatenate(sizes), pd.concat(rows, ignore_index=True)
        if seq >= 1 << 16:
            raise ValueError("over 2**16 chunks in a partition; read the table in smaller splits")
        content = int(np.bitwise_xor.reduce(mix(f["_x"].to_numpy(np.int64).view(U) + np.arange(len(f), dtype=U)), initial=U(0)).view(np.int64))
        out = number | seq, content, f, h, size
        rows, hashes, sizes, held, count, seq = [], [], [], 0, 0, seq + 1
        return out

    for f in frames:
        texts = [b"" if t is None else bytes(t) for t in f["text"]]
        thin = f[["_d", "_x"]]
        begin = total = 0
        for i, t in enumerate(texts):
            total += len(t)
            if total >= piece or i + 1 == len(texts) or i + 1 - begin == 10_000:
                h, first = gram_sets(texts[begin : i + 1], n)
                rows.append(thin.iloc[begin : i + 1])
                hashes.append(h)
                sizes.append(np.diff(first))
                held, count = held + total, count + i + 1 - begin
                begin, total = i + 1, 0
                if held >= CHUNK or count >= MOST:
                    yield flush()
    if rows:
        yield flush()


def _sketches(n: int):
    @released
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for c, content, f, h, size in _chunks(frames, n):
            first = np.concatenate([[0], np.cumsum(size)])
            one, two = (_sums(mix(h + salt), first).view(np.int64) for salt in _SALT)
            yield pd.DataFrame({"_c": c, "_g": content, "_i": np.arange(len(f), dtype=np.int32), "_d": f["_d"], "_x": f["_x"], "_n": size, "_s": one, "_t": two})

    return run


def packed(h: np.ndarray, *more: np.ndarray) -> bytes:
    """Sorted hashes as differences, with further columns of 32 bits at most; bytes of one weight stand together."""
    gap = np.diff(h, prepend=U(0))
    wide = max(1, (int(gap.max(initial=0)).bit_length() + 7) // 8)
    out = [np.array([len(h), wide, len(more)], np.int32).tobytes(), np.ascontiguousarray(gap.view(np.uint8).reshape(-1, 8)[:, :wide].T).tobytes()]
    out += [np.ascontiguousarray(x.astype(np.uint32).view(np.uint8).reshape(-1, 4).T).tobytes() for x in more]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unpacked(data: bytes) -> list[np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(data)
    n, wide, more = np.frombuffer(data, np.int32, 3)
    gap = np.zeros((n, 8), np.uint8)
    gap[:, :wide] = np.frombuffer(data, np.uint8, n * wide, 12).reshape(wide, n).T
    out, at = [np.cumsum(gap.view(U).ravel(), dtype=U)], 12 + n * wide
    for k in range(more):
        out.append(np.ascontiguousarray(np.frombuffer(data, np.uint8, 4 * n, at + 4 * n * k).reshape(4, n).T).view(np.uint32).ravel())
    return out


def _sent(n: int, width: int):
    """For each chunk and bucket of hashes a row (_b, _c, _g, _x): n-grams, the text or ``SEVERAL``, the number of texts. For each chunk a row of no bucket, with the texts of the n-grams that several have."""

    @released
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for c, content, _, h, size in _chunks(frames, n):
            h, i = h >> U(16), np.repeat(np.arange(len(size), dtype=np.uint32), size)
            order = np.argsort(h)
            h, i = h[order], i[order]
            at = np.flatnonzero(np.append(True, h[1:] != h[:-1])[: len(h)])
            times = np.diff(np.append(at, len(h)))
            own = np.repeat(times > 1, times)
            out = [(-1 - int(mix(np.array([c], U))[0] >> U(33)), c, content, packed(h[own], i[own]))] if own.any() else []
            h, i = h[at], np.where(times > 1, SEVERAL, i[at])
            bucket = ((h >> U(24)) * U(width) >> U(24)).astype(np.int64)
            cuts = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(h))
            out += [(bucket[a], c, content, packed(h[a:b], i[a:b], times[a:b])) for a, b in zip(cuts[:-1], cuts[1:])]
            yield pd.DataFrame(out, columns=["_b", "_c", "_g", "_x"])

    return run


def by_key(frames: Iterator[pd.DataFrame], column: str) -> Iterator[tuple[int, pd.DataFrame]]:
    """(key, its rows) of frames in which rows of one key follow each other."""
    now, held = None, []
    for f in frames:
        k = f[column].to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero(k[1:] != k[:-1]) + 1, [len(k)]])
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a == b:
                continue
            if held and k[a] != now:
                yield now, pd.concat(held, ignore_index=True)
                held = []
            now = k[a]
            held.append(f.iloc[a:b])
    if held:
        yield now, pd.concat(held, ignore_index=True)


@released
def _returned(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """From a bucket to each chunk: its n-grams that are in several texts, the texts' numbers and the frequencies. Rows of no bucket pass."""
    for bucket, f in by_key(frames, "_b"):
        if bucket < 0:
            yield f[["_c", "_g", "_x"]]
            continue
        blobs = [unpacked(x) for x in f["_x"]]
        h, i, times = map(np.concatenate, zip(*blobs))
        of = np.repeat(np.arange(len(f), dtype=np.int32), [len(x[0]) for x in blobs])
        del blobs
        order = np.argsort(h, kind="stable")
        hs = h[order]
        at = np.flatnonzero(np.append(True, hs[1:] != hs[:-1]))
        df, n = np.add.reduceat(times[order], at, dtype=np.int64), np.diff(np.append(at, len(hs)))
        df = np.repeat(df, n)
        many = df > 1
        order, df = order[many], df[many]
        again = np.argsort(of[order], kind="stable")  # by chunk, then hash
        order, df = order[again], df[again]
        own = of[order]
        cuts = np.append(np.flatnonzero(np.diff(own, prepend=-1)), len(own))
        c, g = f["_c"].to_numpy(), f["_g"].to_numpy()
        out = [(c[own[a]], g[own[a]], packed(h[order[a:b]], i[order[a:b]], np.minimum(df[a:b], 2**32 - 1))) for a, b in zip(cuts[:-1], cuts[1:])]
        yield pd.DataFrame(out, columns=["_c", "_g", "_x"])


def _live(t: float):
    """(_v, _n, _w, _m, _grams, _rare): representatives that may have a partner, their n-grams that other sets have, and the rarest of them."""

    @released
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for c, f in by_key(frames, "_c"):
            if f["_g"].nunique() > 1 or not (f["_i"] == -2).any():
                raise ValueError("the documents came in another order when they were read again; write them to a table first")
            reps, blobs = f[f["_i"] >= 0], f[f["_i"] == -1]
            if not len(reps) or not len(blobs):
                continue
            top = int(reps["_i"].max()) + 1
            n, times = np.zeros(top, np.int64), np.full(top, 2**40)
            n[reps["_i"]], times[reps["_i"]] = reps["_n"], reps["_r"]
            parts_ = [unpacked(x) for x in blobs["_x"]]
            h, i, df = map(np.concatenate, zip(*[x for x in parts_ if len(x) == 3]))
            if any(len(x) == 2 for x in parts_):  # texts of the chunk that share an n-gram
                h2, i2 = map(np.concatenate, zip(*[x for x in parts_ if len(x) == 2]))
                several = i == SEVERAL
                order = np.argsort(h[several])
                df2 = df[several][order][np.searchsorted(h[several][order], h2)]
                h, i, df = (np.concatenate([x[~several], y]) for x, y in ((h, h2), (i, i2), (df, df2)))
            i = i.astype(np.int64)
            ok = i < top
            ok[ok] = df[ok] > times[i[ok]]  # all copies of a set have its n-grams; what only they have isn't shared
            h, i, df = h[ok], i[ok], df[ok]
            have = np.bincount(i, minlength=top)
            spare = n - np.ceil(t * n - 1e-9).astype(np.int64) + 1 - (n - have)  # of the prefix, what is left for shared n-grams
            ok = (spare > 0)[i]
            h, i, df = h[ok], i[ok], df[ok]
            order = np.lexsort((h, df, i))
            cuts = np.append(np.flatnonzero(np.diff(i[order], prepend=-1)), len(i))
            of = dict(zip(reps["_i"], zip(reps["_n"], reps["_w"], reps["_m"])))
            out = []
            for a, b in zip(cuts[:-1], cuts[1:]):
                k = int(i[order[a]])
                own = h[order[a:b]]
                out.append((int(c) << 16 | k, *of[k], packed(np.sort(own)), own[: spare[k]].tobytes()))
            if out:
                yield pd.DataFrame(out, columns=["_v", "_n", "_w", "_m", "_grams", "_rare"])

    return run


# ------------------------------------------------------------------ groups


@released
def _local_stars(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of the sets of a batch that share a rare n-gram, edges to the least; that one alone goes on to the n-gram's task."""
    for f in frames:
        own = [np.frombuffer(x, U) for x in f["_rare"]]
        h = np.concatenate(own).view(np.int64)
        v = np.repeat(f["_v"].to_numpy(np.int64), [len(x) for x in own])
        order = np.lexsort((v, h))
        h, v = h[order], v[order]
        new = np.append(True, h[1:] != h[:-1])
        least = v[np.flatnonzero(new)][np.cumsum(new) - 1]
        edges = np.unique(np.stack([v, least], 1)[~new], axis=0)
        yield pd.DataFrame({"_h": h[new], "_a": v[new], "_b": None}).astype({"_b": "Int64"})
        yield pd.DataFrame({"_h": edges[:, 0], "_a": edges[:, 0], "_b": edges[:, 1]}).astype({"_b": "Int64"})


@released
def _stars(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges as they are, and from each set of an n-gram to the first; sorted by n-gram."""
    at = first = None
    for f in frames:
        done = f["_b"].notna().to_numpy()
        yield f.loc[done, ["_a", "_b"]].astype("int64")
        h, a = f["_h"].to_numpy(np.int64)[~done], f["_a"].to_numpy(np.int64)[~done]
        if not len(h):
            continue
        new = np.append(at is None or h[0] != at, h[1:] != h[:-1])
        heads = a[new]
        if not new[0]:
            heads = np.append(np.int64(first), heads)
        least = heads[np.cumsum(new) - int(new[0])]
        at, first = h[-1], least[-1]
        ok = a != least
        if ok.any():
            edges = np.unique(np.stack([a, least], 1)[ok], axis=0)
            yield pd.DataFrame({"_a": edges[:, 0], "_b": edges[:, 1]})


class Tree:
    """Signature tree over sets in a given order: levels from the leaves up, each with bitmaps and size ranges."""

    def __init__(self, sets: list[np.ndarray], size: np.ndarray | None = None, fan: int = FAN, bits: int | None = None):
        own = np.array([len(s) for s in sets], np.int64)
        size = own if size is None else size
        bits = bits or bits_for(own)
        self.fan, self.levels = fan, []
        maps = np.zeros((len(sets), bits // 64), U)
        for i, s in enumerate(sets):
            b = np.unique(s & U(bits - 1)).astype(np.int64)
            np.bitwise_or.at(maps[i], b >> 6, U(1) << (b & 63).astype(U))
        spare = own - np.bitwise_count(maps).sum(1).astype(np.int64)
        self.levels.append((maps, size, size, spare))
        while len(maps) > 1:
            self._up()
            maps = self.levels[-1][0]

    def _up(self) -> None:
        maps, low, high, spare = self.levels[-1]
        cuts = np.arange(0, len(maps), self.fan)
        self.levels.append((np.bitwise_or.reduceat(maps, cuts, axis=0), np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts), np.maximum.reduceat(spare, cuts)))

    def pairs(self, t: float, other: Tree | None = None, block: int = 1 << 22) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of leaves, a < b of this tree or one of each of two, whose possible overlap reaches Jaccard ``t``, in blocks."""
        two = other or self
        for x, y in ((self, two), (two, self)):
            while len(x.levels) < len(y.levels):
                x._up()
        todo = [(len(self.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while todo:
            level, a, b = todo.pop()
            maps, low, high, spare = self.levels[level]
            maps2, low2, high2, spare2 = two.levels[level]
            most = max(1, block // (8 * maps.shape[1]))
            if len(a) > most:
                todo += [(level, a[i : i + most], b[i : i + most]) for i in range(0, len(a), most)]
                continue
            need = t / (1 + t) * (low[a] + low2[b]) - 1e-9
            ok = (np.minimum(high[a], high2[b]) >= need) & (high[a] >= t * low2[b] - 1e-9) & (high2[b] >= t * low[a] - 1e-9)
            a, b, need = a[ok], b[ok], need[ok]
            common = np.bitwise_count(maps[a] & maps2[b]).sum(1).astype(np.int64) + np.minimum(spare[a], spare2[b])
            ok = common >= need
            if other is None:
                ok |= (a == b) & (level > 0)
            a, b = a[ok], b[ok]
            if not level:
                if other is None:
                    ok = a < b
                    a, b = a[ok], b[ok]
                if len(a):
                    yield a, b
                continue
            f = np.arange(self.fan)
            x = (a[:, None, None] * self.fan + f[:, None] + 0 * f).ravel()
            y = (b[:, None, None] * self.fan + f + 0 * f[:, None]).ravel()
            ok = (x < len(self.levels[level - 1][1])) & (y < len(two.levels[level - 1][1]))
            if other is None:
                ok &= x <= y
            if ok.any():
                todo.append((level - 1, x[ok], y[ok]))


def bits_for(sizes: np.ndarray) -> int:
    return 1 << int(np.clip(np.ceil(np.log2(max(1, np.median(sizes)) * 16)), 8, 16))


def join_group(sets: list[np.ndarray], size: np.ndarray, t: float, others: list[np.ndarray] | None = None, size2: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, overlap) for the pairs of Jaccard >= t, a < b of one list or one of each of two. ``size``: of whole sets, of which ``sets`` may leave out what no other has."""
    two, sz2 = (sets, size) if others is None else (others, size2)
    bits = bits_for(np.array([len(s) for s in [*sets, *(others or [])]], np.int64))
    tree = Tree(sets, size, bits=bits)
    flat, first = np.concatenate(two), np.concatenate([[0], np.cumsum([len(s) for s in two])])
    have = np.diff(first)
    for a, b in tree.pairs(t, None if others is None else Tree(others, size2, bits=bits)):
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        cuts = np.append(np.flatnonzero(np.diff(a, prepend=-1)), len(a))
        for i, j in zip(cuts[:-1], cuts[1:]):
            own, far = sets[a[i]], b[i:j]
            n = have[far]
            begin = np.cumsum(n) - n
            every = flat[np.repeat(first[far] - begin, n) + np.arange(n.sum())]
            hit = own[np.minimum(np.searchsorted(own, every), len(own) - 1)] == every
            o = np.add.reduceat(hit, begin, dtype=np.int64)
            ok = o >= t * (size[a[i]] + sz2[far] - o) - 1e-9
            if ok.any():
                yield np.full(int(ok.sum()), a[i]), far[ok], o[ok]


def merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``label``, the least member of each one's component so far, after joining a and b."""
    while len(a):
        x, y = label[a], label[b]
        ok = x != y
        a, b, x, y = a[ok], b[ok], x[ok], y[ok]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
    return label


def _linked(t: float):
    """(_v, _l, _u, _cut) for each set with a link: links to documents of other sets in this task, the least set of its component here."""

    @released
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, f in by_key(frames, "_q"):
            if len(f) < 2:
                continue
            sets = [unpacked(x)[0] for x in f["_grams"]]
            order = np.array(sorted(range(len(f)), key=lambda k: (bool(f["_second"].iat[k]), sets[k][:4].tolist(), k)))  # those alike side by side
            f, sets = f.iloc[order], [sets[k] for k in order]
            v, w, size = (f[c].to_numpy(np.int64) for c in ("_v", "_w", "_n"))
            k = int((~f["_second"].to_numpy(bool)).sum())
            if f["_cut"].iat[0] < 2:
                found, shift = join_group(sets, size, t), 0
            elif 0 < k < len(f):
                found, shift = join_group(sets[:k], size[:k], t, sets[k:], size[k:]), k
            else:
                continue
            links, label = np.zeros(len(f), np.int64), np.arange(len(f))
            held: list = []

            def apply(held, label):
                a, b = map(np.concatenate, zip(*held))
                np.add.at(links, a, w[b])
                np.add.at(links, b, w[a])
                return merged(label, a, b)

            for a, b, _ in found:
                held.append((a, b + shift))
                if len(held) >= 1000:
                    label, held = apply(held, label), []
            if held:
                label = apply(held, label)
            some = links > 0
            if some.any():
                yield pd.DataFrame({"_v": v[some], "_l": links[some], "_u": v[label[some]], "_cut": f["_cut"].to_numpy()[some] > 0})

    return run


def _blocks(live: DataFrame, label: DataFrame, t: float, block: tuple[int, int]) -> DataFrame:
    """Rows of ``live`` with the key ``_q`` of each task that they go to. ``_cut``: 0 a whole group, 1 a block with itself, 2 two blocks.

    A group of up to ``block[0]`` sets is one task. A larger one is cut by size, so that a set's partners are in its own class of
    sizes and the two beside it, and by hash into blocks of an eighth of a class, but no more than ``block[1]`` sets. The sizes of
    these groups are broadcast, a row for each, so that sets are copied where they lie and no task gathers a group.
    """
    base = float(np.log(1 / t))
    rows = live.join(label.select("_v", "_root"), "_v").withColumn("_k", F.floor(F.log(F.col("_n").cast("double")) / base + 1e-9).cast("int"))
    thin = live.select("_v", "_n").join(label.select("_v", "_root"), "_v").withColumn("_k", F.floor(F.log(F.col("_n").cast("double")) / base + 1e-9).cast("int"))
    sizes = thin.groupBy("_root", "_k").agg(F.count("*").alias("_c"))
    large = sizes.groupBy("_root").agg(F.sum("_c").alias("_all"), F.map_from_entries(F.collect_list(F.struct("_k", "_c"))).alias("_by")).filter(F.col("_all") > block[0])
    rows = rows.join(F.broadcast(large.select("_root", "_by")), "_root", "left")
    m = lambda k: F.ceil(F.coalesce(F.element_at("_by", k), F.lit(0)) / F.least(F.greatest(F.element_at("_by", k) / 8, F.lit(block[0])), F.lit(block[1]))).cast("int")
    own = F.pmod(F.xxhash64("_v"), m(F.col("_k"))).cast("int")
    task = lambda k, i, l, j, second, how: F.struct(k.alias("k"), i.alias("i"), l.alias("l"), j.alias("j"), F.lit(second).alias("second"), how.cast("int").alias("cut"))
    k, up, down = F.col("_k"), F.col("_k") + 1, F.col("_k") - 1
    every = lambda n, f: F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), f))
    none = F.array().cast("array<struct<k:int,i:int,l:int,j:int,second:boolean,cut:int>>")
    same = every(m(k), lambda j: F.when(j >= own, task(k, own, k, j, False, F.when(j == own, 1).otherwise(2))).otherwise(task(k, j, k, own, True, F.lit(2))))
    above = every(F.coalesce(m(up), F.lit(0)), lambda j: task(k, own, up, j, False, F.lit(2)))
    below = every(F.coalesce(m(down), F.lit(0)), lambda j: task(down, j, k, own, True, F.lit(2)))
    zero = F.lit(0)
    tasks = F.when(F.col("_by").isNull(), F.array(task(zero, zero, zero, zero, False, zero))).otherwise(F.concat(same, F.coalesce(above, none), F.coalesce(below, none)))
    rows = rows.select("_root", "_v", "_n", "_w", "_grams", F.explode(tasks).alias("_task"))
    return rows.select(F.xxhash64("_root", "_task.k", "_task.i", "_task.l", "_task.j").alias("_q"), "_v", "_n", "_w", "_grams", F.col("_task.second").alias("_second"), F.col("_task.cut").alias("_cut"))


def _sets(docs: DataFrame, n: int, t: float, block: tuple[int, int]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents (_d, _x, _s, _t, _n, rows _r), sets (_s, _t, _n, _v, _m least id, _w documents), and links (_v, _l, _root) of the sets that have any."""
    text = documents(docs, F.xxhash64("text").alias("_x")).select("_d", "_x", F.col("text").cast("binary").alias("text"))
    sketch = cut(text.mapInPandas(_sketches(n), "_c bigint, _g bigint, _i int, _d bigint, _x bigint, _n bigint, _s bigint, _t bigint"))
    one = sketch.filter("_n > 0").groupBy("_s", "_t", "_n", "_d").agg(F.count("*").alias("_r"), F.min(F.struct("_c", "_i")).alias("_p"))
    sets = cut(one.groupBy("_s", "_t", "_n").agg(F.min(F.struct("_d", "_p")).alias("_f"), F.sum("_r").alias("_r"), F.count("*").alias("_w")))
    sets = sets.select("_s", "_t", "_n", "_r", "_w", F.col("_f._d").alias("_m"), F.col("_f._p._c").alias("_c"), F.col("_f._p._i").alias("_i"), (F.shiftleft("_f._p._c", 16).bitwiseOR(F.col("_f._p._i").cast("bigint"))).alias("_v"))
    total = sketch.agg(F.sum("_n")).first()[0] or 0
    width = parts(docs)
    sent = text.mapInPandas(_sent(n, max(width, -(-total // PER_BUCKET))), "_b bigint, _c bigint, _g bigint, _x binary")
    back = sent.repartition(width, "_b").sortWithinPartitions("_b").mapInPandas(_returned, "_c bigint, _g bigint, _x binary")
    null = lambda kind: F.lit(None).cast(kind)
    content = sketch.groupBy("_c").agg(F.first("_g").alias("_g"))
    rows = back.select("_c", "_g", F.lit(-1).alias("_i"), "_x", null("bigint").alias("_n"), null("bigint").alias("_r"), null("bigint").alias("_w"), null("bigint").alias("_m"))
    rows = rows.unionByName(content.select("_c", "_g", F.lit(-2).alias("_i")), allowMissingColumns=True)
    rows = rows.unionByName(sets.join(content, "_c").select("_c", "_g", "_i", "_n", "_r", "_w", "_m"), allowMissingColumns=True)
    rows = rows.repartition(width, "_c").sortWithinPartitions("_c")
    live = cut(rows.mapInPandas(_live(t), "_v bigint, _n bigint, _w bigint, _m bigint, _grams binary, _rare binary"))
    stars = live.select("_v", "_rare").mapInPandas(_local_stars, "_h bigint, _a bigint, _b bigint")
    label = components(stars.repartition(width, "_h").sortWithinPartitions("_h", "_a").mapInPandas(_stars, "_a bigint, _b bigint"))
    tasks = _blocks(live, label, t, block).repartition(width, "_q").sortWithinPartitions("_q", "_v")
    met = cut(tasks.mapInPandas(_linked(t), "_v bigint, _l bigint, _u bigint, _cut boolean"))
    links = met.groupBy("_v").agg(F.sum("_l").alias("_l"), F.first("_u").alias("_root"), F.max("_cut").alias("_cut"))
    if not met.filter("_cut").isEmpty():
        far = components(met.filter("_cut").select(F.col("_v").alias("_a"), F.col("_u").alias("_b")))
        links = links.join(far.select("_v", F.col("_root").alias("_far")), "_v", "left").withColumn("_root", F.coalesce("_far", "_root"))
    return sketch, sets, cut(links.select("_v", "_l", "_root"))


def similar(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, block: tuple[int, int] = BLOCK) -> DataFrame:
    """(doc_id, class_id, n_links) for each document: its class and the number of other documents with a Jaccard of at least ``threshold``.

    The Jaccard is that of the sets of word n-grams; none is missed. A class is a connected component of such links,
    ``class_id`` the least doc_id in it, the document's own where it has no link. Documents of equal sets count as links of
    each other (Jaccard 1). A word is a run of non-space; a text of fewer than n words has one gram, all its words; a null,
    empty or blank text has none and no link. A null doc_id counts as the least: it stays null, and so does the class_id of a
    class that holds it. Rows that repeat id and set count once, as one row; texts of one id with different sets are
    documents of their own. An empty table gives no rows. Further columns are not read. ``docs`` is read twice and must give
    its rows in the same order, as a table does; else it raises. ``block``: see ``_blocks``.
    """
    if not 0 < threshold < 1:
        raise ValueError("threshold must be between 0 and 1")
    sketch, sets, links = _sets(docs, n, threshold, block)
    least = links.join(sets.select("_v", "_m"), "_v").groupBy("_root").agg(F.min("_m").alias("_least"))
    of = links.join(least, "_root").select("_v", "_l", "_least")
    of = sets.join(of, "_v", "left").select("_s", "_t", "_n", F.coalesce("_least", "_m").alias("_class"), (F.coalesce("_l", F.lit(0)) + F.col("_w") - 1).alias("n_links"))
    some = sketch.filter("_n > 0").select("_d", "_s", "_t", "_n").distinct().join(of, ["_s", "_t", "_n"])
    none = sketch.filter("_n = 0").select("_d").distinct()
    out = some.select("_d", "_class", "n_links").unionByName(none.select("_d", F.col("_d").alias("_class"), F.lit(0).cast("bigint").alias("n_links")))
    return out.select(doc_id("_d").alias("doc_id"), doc_id("_class").alias("class_id"), "n_links")


@released
def _contracted(frames: Iterator[pd.DataFrame], most: int = 2_000_000) -> Iterator[pd.DataFrame]:
    """Edges from each vertex to the least of its component, by pieces of ``most`` edges."""

    def stars(held: list[pd.DataFrame]) -> pd.DataFrame:
        e = np.concatenate([f.to_numpy(np.int64) for f in held])
        v, at = np.unique(e, return_inverse=True)
        at = at.reshape(e.shape)
        label = v[merged(np.arange(len(v)), at[:, 0], at[:, 1])]
        return pd.DataFrame({"_a": v[label != v], "_b": label[label != v]})

    held: list[pd.DataFrame] = []
    for f in frames:
        held.append(f[["_a", "_b"]])
        if sum(map(len, held)) >= most:
            yield stars(held)
            held = []
    if held:
        yield stars(held)


def components(edges: DataFrame) -> DataFrame:
    """(_v, _root) for the vertices of ``edges`` (_a, _b): the least vertex of each connected component.

    Each task first replaces its edges by stars (``_contracted``). Then every vertex points to its least neighbour, pointers
    are doubled until they stay, the edges are contracted to the roots; this is repeated until no edge is left.
    """
    edges = cut(edges.filter("_a <> _b").select("_a", "_b").distinct().mapInPandas(_contracted, "_a bigint, _b bigint"))
    label = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("_b").alias("_a"), F.col("_a").alias("_b")))
        up = cut(both.groupBy(F.col("_a").alias("_v")).agg(F.least(F.min("_b"), F.first("_a")).alias("_p")))
        while True:
            to = up.select(F.col("_v").alias("_p"), F.col("_p").alias("_q"))
            new = cut(up.join(to, "_p").select("_v", F.col("_q").alias("_p"), (F.col("_p") != F.col("_q")).alias("_c")))
            moved = not new.filter("_c").isEmpty()
            up = new.select("_v", "_p")
            if not moved:
                break
        if label is None:
            label = up.withColumnRenamed("_p", "_root")
        else:
            next_ = up.select(F.col("_v").alias("_root"), F.col("_p").alias("_n"))
            label = label.join(next_, "_root", "left").select("_v", F.coalesce("_n", "_root").alias("_root"))
        label = cut(label)
        to = up.select(F.col("_v").alias("_a"), F.col("_p").alias("_x"))
        far = up.select(F.col("_v").alias("_b"), F.col("_p").alias("_y"))
        edges = cut(edges.join(to, "_a").join(far, "_b").filter("_x <> _y").select(F.col("_x").alias("_a"), F.col("_y").alias("_b")).distinct())
    return label if label is not None else edges.select(F.col("_a").alias("_v"), F.col("_b").alias("_root"))


def thinned(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, block: tuple[int, int] = BLOCK) -> DataFrame:
    """``docs`` with one document of each class of ``similar``, that of least doc_id (null is the least); all its columns as they were.

    Texts of one id are documents of their own, told by a hash of the text. Rows that repeat id and text are one document
    and stay or go together. Documents without a word stay.
    """
    sketch, sets, links = _sets(docs, n, threshold, block)
    root = sets.join(links.select("_v", "_root"), "_v", "left").withColumn("_root", F.coalesce("_root", "_v"))
    root = root.select("_s", "_t", "_n", "_root", "_w", F.struct("_m", "_v").alias("_f"))
    large = root.groupBy("_root").agg(F.min("_f").alias("_f"), F.sum("_w").alias("_all")).filter("_all > 1")
    member = root.drop("_f").join(large, "_root").select("_s", "_t", "_n", "_f")
    named = sketch.filter("_n > 0").select("_d", "_x", "_s", "_t", "_n", F.shiftleft("_c", 16).bitwiseOR(F.col("_i").cast("bigint")).alias("_v"))
    hits = named.join(member, ["_s", "_t", "_n"])
    keeper = F.max(F.struct(F.col("_f._v") == F.col("_v"), F.lit(0)))
    gone = hits.groupBy("_d", "_x").agg(keeper.alias("_k")).filter("not _k.col1").select(F.col("_d").alias("_gone"), F.col("_x").alias("_hash"))
    return docs.join(cut(gone), (F.coalesce(docs["doc_id"].cast("bigint"), F.lit(NO_ID)) == F.col("_gone")) & (F.xxhash64(docs["text"].cast("string")) == F.col("_hash")), "left_anti")


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(text, '[^ \t\n\r\f\x0B]+') AS w FROM documents WHERE text IS NOT NULL),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM w WHERE len(w) > 0),
s AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS h FROM g GROUP BY doc_id),
m AS (SELECT *, min(doc_id) OVER (PARTITION BY h) AS m, count(*) OVER (PARTITION BY h) AS k FROM s),
r AS (SELECT doc_id, n, k FROM m WHERE doc_id = m),
rg AS (SELECT g.doc_id, g.g FROM g JOIN r USING (doc_id)),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM rg a JOIN rg b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b, x.k AS ka, y.k AS kb FROM o JOIN r x ON x.doc_id = a JOIN r y ON y.doc_id = b WHERE o >= 0.5e0 * (x.n + y.n - o)),
f AS (SELECT a, b, kb AS k FROM e UNION ALL SELECT b, a, ka FROM e),
c(v, root) AS (SELECT DISTINCT a, a FROM f UNION SELECT f.b, c.root FROM c JOIN f ON f.a = c.v),
l AS (SELECT v, min(root) AS class_id FROM c GROUP BY v),
n AS (SELECT a AS v, sum(k) AS n FROM f GROUP BY a)
SELECT d.doc_id, coalesce(l.class_id, m.m, d.doc_id) AS class_id, CAST(coalesce(n.n, 0) + coalesce(m.k - 1, 0) AS BIGINT) AS n_links
FROM documents d LEFT JOIN m USING (doc_id) LEFT JOIN l ON l.v = m.m LEFT JOIN n ON n.v = m.m
"""
