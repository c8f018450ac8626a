"""N-gram Jaccard join: sets in a trie, traversed with shared partial overlaps.

1. Every text becomes a set of 64-bit shingle hashes in one global order (by hash). Texts with equal sets share a node.
2. Sets that can link meet by signatures. In a class of sizes, a set of the class differs from one it links with in at
   most d hashes, so of the first d + 1 non-empty segments of the hash range one is equal; each gives a signature.
   Shingles that many texts hold are left out of the segments of sets that have enough others, so shared passages don't
   tie unlike texts together. Signatures are combined in each task before the shuffle and give a forest of candidates,
   never pairs of a group.
3. The sets of a connected candidate group are put in a compressed trie. Each set is matched against the trie along the
   paths to the sets that share a rare token with it; the overlap with a shared prefix is counted once for all sets
   below, and a subtree is left as soon as its sizes and the remaining lengths can't reach the threshold, or when all its
   sets are joined to the set already. In a group, tokens are ordered from rare to frequent.
   Groups above ``GROUP`` are first parted by the rare shingles that their sets share. What is still above is mostly copies
   of one text: it is cut into blocks that each take ``PIVOTS`` of the group's sets along, which joins nearly all of it, and
   then only the sets outside the group's largest part meet those of the other blocks.
4. Links are whole-number tests, 100 * intersection >= percent * union; components are the smallest ids reachable.

Defined cases: A-Z is lower-cased and words are runs of other bytes than 09-0D and 20; a text with fewer words than a
shingle is one shingle of all its words; without words (or null) the set is empty and links with nothing. A row without
an id links with nothing. Repeated rows belong to the same node. Texts are taken whole, however long. An empty table gives
no rows. Other columns of the input are not returned, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrow import quoted, release, slices
from .shared import attach, components, hot_bound, remove, store

#: Shingles of sets that are together in one task, where each set counts as ``SET`` shingles more.
GROUP, SET = 1_500_000, 32
#: Tokens that two sets must have in common among their first ones before the trie is walked from one to the other.
SHARED = 4
#: Sets of a large group that every block of it holds.
PIVOTS = 3
#: Rows of (id, node, block) that are broadcast at most (8 MB); more are met by a shuffle of the texts.
FEW = 150_000
#: Signatures that a task combines at a time, and words whose hashes it keeps.
COMBINE = 1_000_000
WORDS = 150_000
#: Texts sampled for popular shingles, how many of them hold one, and how many are broadcast at most (2 MB).
SAMPLE, OFTEN, POPULAR = 10_000, 4, 1 << 18

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of MurmurHash3 (fmix64)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class Shingler:
    """Sorted distinct shingle hashes of texts; word hashes are kept in a bounded table."""

    def __init__(self, n: int):
        import xxhash

        self.n, self.hash, self.known = n, xxhash.xxh3_64_intdigest, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().lower().split()
        if not words:
            return np.empty(0, np.uint64)
        known = self.known
        fresh = set(words).difference(known)
        if fresh:
            if len(known) + len(fresh) > WORDS:
                known.clear()
                fresh = set(words)
            known.update((w, self.hash(w)) for w in fresh)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = min(self.n, len(h))
        out = np.full(len(h) - n + 1, n, np.uint64)
        for k in range(n):
            out = mix(out * _A + h[k : len(h) - n + 1 + k] * _B + _C)
        return np.unique(out)


def digest(sets: np.ndarray) -> tuple[int, int]:
    """Two hashes of a set's elements and size, as signed longs: its node, and a check that tells apart unlike sets of the
    same node."""
    if not len(sets):
        return 0, 0
    size = np.uint64(len(sets))
    sums = np.array([np.add.reduce(mix(sets ^ _A)) + size, np.add.reduce(mix(sets * _C ^ _B)) ^ size])
    node, check = mix(sums).view(np.int64).tolist()
    return node, check


class Classes:
    """Size classes of ratio 2 and their segments, for a threshold in percent."""

    def __init__(self, percent: int):
        self.percent = percent

    def differ(self, sizes: int) -> int:
        """Most hashes in which linked sets of this total size differ."""
        return sizes * (100 - self.percent) // (100 + self.percent)

    def schemes(self, n: int) -> Iterator[tuple[int, int, int, int]]:
        """(class, segments, most, largest size) of each class that the larger set of a pair with a set of n may have;
        ``most`` is the number of hashes in which such a pair can differ. Classes where only equal sets link are left out."""
        c, furthest = n.bit_length(), n * 100 // self.percent
        for k in (c, c + 1):
            largest = (1 << k) - 1
            if k == c or furthest > (1 << c) - 1:
                most = self.differ(2 * largest)
                own = self.differ(n + min(furthest, largest))
                if own:
                    yield k, most + 2 + most // 8, own, largest


def _segments(sets: np.ndarray, c: int, k: int, most: int, salt: np.uint64) -> Iterator[np.ndarray]:
    """Signatures of the first ``most + 1`` non-empty of k segments of sorted hashes; all, and those of the empty ones,
    where there are fewer.

    Of two linked sets take the one that stops first: at most ``most`` of its non-empty segments so far differ from the
    other's, so one is equal, and the other set gives it too."""
    c = np.uint64(c) ^ salt
    if len(sets):
        seg = ((sets >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)  # keeps the order of the hashes
        first = np.concatenate([[0], np.flatnonzero(seg[1:] != seg[:-1]) + 1])
        sums = np.add.reduceat(mix(sets ^ _B), first)
        seg = seg[first]
        yield mix(sums + mix(seg * _A + c))[: most + 1]
    else:
        seg = np.empty(0, np.uint64)
    if len(seg) <= most:
        empty = np.setdiff1d(np.arange(k, dtype=np.uint64), seg)
        yield mix(mix(empty * _A + c) ^ _C)


def signatures(sets: np.ndarray, classes: Classes, popular: np.ndarray) -> Iterator[np.ndarray]:
    """Signatures of a set, such that linked unequal sets have one in common.

    Linked sets differ in at most ``most`` hashes, so their numbers of rare (not popular) hashes do too: where both have
    ``enough`` rare ones, segments of rare hashes meet; where one has fewer, the other has at most ``most`` more, and
    segments of all hashes meet."""
    n, rare = len(sets), sets
    if len(popular):
        rare = sets[popular[np.minimum(np.searchsorted(popular, sets), len(popular) - 1)] != sets]
    for c, k, most, largest in classes.schemes(n):
        enough = 3 * largest // 10
        if len(rare) >= enough:
            yield from _segments(rare, c, k, most, _A)
        if len(rare) <= enough + most:
            yield from _segments(sets, c, k, most, _B)


def combine(sigs: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each distinct signature its smallest node; and the edges from that to its other nodes."""
    order = np.lexsort((nodes, sigs))
    sigs, nodes = sigs[order], nodes[order]
    new = np.concatenate([[True], sigs[1:] != sigs[:-1]]) if len(sigs) else np.empty(0, bool)
    least = nodes[new][np.cumsum(new) - 1] if len(sigs) else nodes
    other = nodes != least
    pairs = np.unique(np.stack([least[other], nodes[other]]), axis=1) if other.any() else np.empty((2, 0), np.int64)
    return sigs[new], nodes[new], pairs[0], pairs[1]


def popular_hashes(df: DataFrame, text: str, n: int) -> np.ndarray:
    """Sorted hashes of shingles that many texts hold, by a sample of at most about ``SAMPLE`` texts: ``POPULAR`` at most.

    Which they are changes only which signatures are used, never which sets link."""
    texts = df.select(quoted(text).alias("text")).filter("text is not null")
    total = texts.count()
    if total > SAMPLE:
        texts = texts.filter(F.pmod(F.xxhash64("text", F.lit(n)), F.lit(1_000_000)) < int(1_000_000 * SAMPLE / total))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(n)
        for batch in batches:
            for part in slices(batch.column(0)):
                found, times = np.unique(np.concatenate([shingle(t) for t in part]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(times)], ["h", "n"])

    heavy = texts.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= OFTEN)
    rows = heavy.orderBy(F.desc("n"), "h").limit(POPULAR).select("h").toArrow()
    return np.sort(rows["h"].to_numpy().view(np.uint64))


#: What ``scan`` writes: facts of a row (id, node, check, size), a signature and the smallest of its nodes in a task, or an edge.
FACT, SIGNATURE, EDGE = 0, 1, 2
SCANNED = "kind int, x long, y long, z long, w long"


def _scanned(kind: int, *columns: pa.Array | np.ndarray | list[int]) -> pa.RecordBatch:
    n = len(columns[0])
    filled = [c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns] + [pa.nulls(n, pa.int64())] * (4 - len(columns))
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), *filled], ["kind", "x", "y", "z", "w"])


def scan(df: DataFrame, doc_id: str, text: str, n: int, percent: int) -> DataFrame:
    """One pass over the texts: rows of ``SCANNED``. Signatures are combined in each task; rows without an id have none."""
    frequent = df.sparkSession.sparkContext.broadcast(popular_hashes(df, text, n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, classes, popular = Shingler(n), Classes(percent), frequent.value
        sigs: list[np.ndarray] = []
        nodes: list[np.ndarray] = []
        seen: set[int] = set()

        def flush() -> Iterator[pa.RecordBatch]:
            if sigs:
                s, m, a, b = combine(np.concatenate(sigs), np.concatenate(nodes))
                sigs.clear()
                nodes.clear()
                seen.clear()
                for at in range(0, len(s), 100_000):
                    yield _scanned(SIGNATURE, s[at : at + 100_000].view(np.int64), m[at : at + 100_000])
                yield _scanned(EDGE, a, b)

        held = 0
        for batch in batches:
            ids, at = batch.column(0), 0
            for texts in slices(batch.column(1)):
                sets = list(map(shingle, texts))
                keys = [digest(s) for s in sets]
                own = ids.slice(at, len(texts))
                at += len(texts)
                yield _scanned(FACT, own, [k[0] for k in keys], [k[1] for k in keys], [len(s) for s in sets])
                for s, (node, _), known in zip(sets, keys, own.is_valid().to_pylist()):
                    if not len(s) or not known or node in seen:
                        continue
                    seen.add(node)
                    for found in signatures(s, classes, popular):
                        sigs.append(found)
                        nodes.append(np.full(len(found), node, np.int64))
                        held += len(found)
                if held >= COMBINE:
                    yield from flush()
                    held = 0
        yield from flush()
        del shingle
        release()

    return df.select(quoted(doc_id).cast("long").alias("doc_id"), quoted(text).alias("text")).mapInArrow(run, SCANNED)


def candidates(scanned: DataFrame) -> DataFrame:
    """(a, b): a forest of candidate nodes; sets that link are connected in it. A task has a signature once, so the window
    holds one row for each task at most."""
    met = scanned.filter(F.col("kind") == SIGNATURE).select(F.col("x").alias("sig"), F.col("y").alias("a"))
    edges = met.withColumn("b", F.min("a").over(Window.partitionBy("sig"))).filter("a <> b").select("a", "b")
    return edges.unionByName(scanned.filter(F.col("kind") == EDGE).select(F.col("x").alias("a"), F.col("y").alias("b")))


class Trie:
    """Compressed trie of sorted token lists: a node covers the leaves lo to hi and the tokens of leaf lo between two depths.
    ``size`` are the sizes of the sets, which may hold more than the lists."""

    def __init__(self, lists: list[np.ndarray], size: np.ndarray):
        self.order = sorted(range(len(lists)), key=lambda k: lists[k].astype(">u4").tobytes())
        self.lists = [lists[k] for k in self.order]
        self.size = size[self.order]
        self.length = np.array([len(x) for x in self.lists], np.int64)
        self.root = self.build([self.common(a, b) for a, b in zip(self.lists, self.lists[1:])])

    @staticmethod
    def common(a: np.ndarray, b: np.ndarray) -> int:
        n = min(len(a), len(b))
        differ = a[:n] != b[:n]
        return int(differ.argmax()) if n and differ.any() else n

    def build(self, lcp: list[int]) -> tuple:
        """(lo, hi, from, to, smallest size, longest list, children, first leaves of the children) of the root, without
        recursion on depth."""
        made: dict[tuple[int, int], tuple] = {}
        lcp = np.array(lcp, np.int64)
        stack = [(0, len(self.lists), 0, False)]
        while stack:
            lo, hi, above, ready = stack.pop()
            if hi - lo == 1:
                made[lo, hi] = (lo, hi, above, int(self.length[lo]), int(self.size[lo]), int(self.length[lo]), (), None)
                continue
            to = int(lcp[lo : hi - 1].min())
            cuts = [lo, *(np.flatnonzero(lcp[lo : hi - 1] == to) + lo + 1).tolist(), hi]
            parts = list(zip(cuts, cuts[1:]))
            if ready:
                made[lo, hi] = (lo, hi, above, to, int(self.size[lo:hi].min()), int(self.length[lo:hi].max()), tuple(made.pop(p) for p in parts), np.array(cuts[:-1]))
            else:
                stack.append((lo, hi, above, True))
                stack += [(a, b, to, False) for a, b in parts]
        return next(iter(made.values()))

    def linked(self, x: np.ndarray, n: int, wanted: np.ndarray, percent: int, open_: Callable[[np.ndarray], np.ndarray]) -> Iterator[int]:
        """Leaves among ``wanted`` (sorted) that link with the list x of a set of n. Only the paths to them are walked;
        ``open_`` leaves those of some leaves that still matter, and is asked again below each fork."""
        stack = [(self.root, 0, wanted)]
        while stack:
            (lo, hi, at, to, small, longest, children, firsts), overlap, wanted = stack.pop()
            wanted = open_(wanted)
            if not len(wanted):
                continue
            edge, alive, chunk = self.lists[lo], True, 64
            while alive and at < to:
                step = edge[at : min(to, at + chunk)]
                at, chunk = at + len(step), min(chunk * 2, 1024)
                where = np.searchsorted(x, step)
                overlap += int((x[np.minimum(where, len(x) - 1)] == step).sum())
                rest = len(x) - int(np.searchsorted(x, step[-1], "right"))
                alive = (100 + percent) * (overlap + min(rest, longest - at)) >= percent * (n + small)
            if not alive:
                continue
            if children:
                of = np.searchsorted(firsts, wanted, "right") - 1
                cuts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]
                stack += [(children[of[a]], overlap, wanted[a:b]) for a, b in reversed(list(zip(cuts, cuts[1:])))]
            elif (100 + percent) * overlap >= percent * (n + small):
                yield lo


class Parts:
    """Union-find over the leaves of a trie."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def of(self, leaves: np.ndarray) -> np.ndarray:
        at = self.root[leaves]
        while (self.root[at] != at).any():
            at = self.root[at]
        self.root[leaves] = at
        return at

    def one(self, leaf: int) -> int:
        root = self.root
        while root[leaf] != leaf:
            root[leaf] = root[root[leaf]]
            leaf = root[leaf]
        return int(leaf)

    def join(self, a: int, b: int) -> None:
        a, b = self.one(a), self.one(b)
        self.root[max(a, b)] = min(a, b)


def trie_components(sets: list[np.ndarray], percent: int, labels: list | None = None) -> np.ndarray:
    """The first set (index) of each set's connected part, by matching each set against the trie of all. Sets of equal
    ``labels`` are known to be connected.

    Tokens are ordered by how many of these sets hold them, then by hash. A token of one set alone is left out of its
    list (it counts in the set's size, never in an overlap). Two sets that link share s tokens among the first
    ``size - least overlap + s`` of each, so only sets that do are looked for in the trie (s is ``SHARED``, or the least
    overlap of the smaller set); a token whose sets are all joined is not looked at again."""
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    tokens, inverse, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(tokens), np.int64)
    rank[np.lexsort((tokens, times))] = np.arange(len(tokens))
    lone = int((times == 1).sum())  # ranks below are of one set
    ends = np.cumsum(size)
    whole = [np.sort(rank[inverse[e - k : e]]) for e, k in zip(ends, size)]
    lists = [w[np.searchsorted(w, lone) :].astype(np.uint32) for w in whole]
    trie = Trie(lists, size)
    overlap = -(-trie.size * percent // 100)
    shared = np.minimum(SHARED, overlap)
    heads = [x[:m] for x, m in zip(trie.lists, np.maximum(0, trie.length - overlap + shared).tolist())]
    owners = np.repeat(np.arange(n), [len(h) for h in heads])
    flat = np.concatenate(heads)
    order = np.argsort(flat, kind="stable")  # leaves of a token stay in order
    owners = owners[order]
    held, first = np.unique(flat[order], return_index=True)
    first = np.append(first, len(owners))
    calm = np.zeros(len(held), bool)
    parts = Parts(n)
    if labels is not None:
        leader: dict = {}
        for leaf, k in enumerate(trie.order):
            parts.join(leader.setdefault(labels[k], leaf), leaf)
    for k in range(n):
        open_ = np.searchsorted(held, heads[k])
        open_ = open_[~calm[open_]]
        if not len(open_):
            continue
        met = [owners[first[t] : first[t + 1]] for t in open_.tolist()]
        own = np.concatenate(met)
        mine = parts.one(k)
        other = parts.of(own) != mine
        starts = np.cumsum([0, *map(len, met[:-1])])
        calm[open_[~np.logical_or.reduceat(other, starts)]] = True
        own = own[other & (own > k)]
        if len(own) * 8 > n:
            times = np.bincount(own, minlength=n)
            wanted = np.flatnonzero(times)
            times = times[wanted]
        else:
            wanted, times = np.unique(own, return_counts=True)
        near, there = trie.size[k], trie.size[wanted]
        wanted = wanted[(times >= np.minimum(shared[k], shared[wanted])) & (100 * there >= percent * near) & (percent * there <= 100 * near)]
        if len(wanted):
            unjoined = lambda leaves: leaves[parts.of(leaves) != parts.one(k)]  # noqa: B023, E731
            for found in trie.linked(trie.lists[k], int(near), wanted, percent, unjoined):
                parts.join(found, k)
    # a part's name is its smallest index among the sets
    root = parts.of(np.arange(n))
    least = np.full(n, n, np.int64)
    np.minimum.at(least, root, np.array(trie.order))
    out = np.empty(n, np.int64)
    out[trie.order] = least[root]
    return out


def join_groups(texts: DataFrame, n: int, percent: int) -> DataFrame:
    """(a, b): links found among rows (comp, i, j, doc_id, node, check, label, text) that are sorted by (comp, i, j) in a
    partition; rows of one label (not null) are joined already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(n)
        key, sets = None, {}

        def close() -> Iterator[pa.RecordBatch]:
            if len(sets) > 1:
                rows = sorted(sets.values(), key=lambda r: r[0])
                root = trie_components([r[2] for r in rows], percent, None if rows[0][1] is None else [r[1] for r in rows])
                owner = np.array([r[0] for r in rows], np.int64)
                mine = np.flatnonzero(root != np.arange(len(rows)))
                if len(mine):
                    yield pa.RecordBatch.from_arrays([pa.array(owner[mine]), pa.array(owner[root[mine]])], ["a", "b"])

        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(7)]
            at = 0
            for part in slices(batch.column(7)):
                for text in part:
                    comp, i, j, doc, node, check, label = (c[at] for c in columns)
                    at += 1
                    if (comp, i, j) != key:
                        yield from close()
                        key, sets = (comp, i, j), {}
                    if (node, check) not in sets:
                        s = shingle(text)
                        if len(s) and digest(s) == (node, check):
                            sets[node, check] = (doc, label, s)
        yield from close()
        sets.clear()
        release()

    return texts.mapInArrow(run, "a long, b long")


def with_text(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows (doc_id and more) with the texts of their ids. Up to ``FEW`` rows, which are counted, go to the texts, so that only
    texts that are needed are shuffled later; more meet them by a shuffle."""
    few = rows.count() <= FEW
    return texts.join(F.broadcast(rows) if few else rows.hint("shuffle_hash"), "doc_id")


def links_of(texts: DataFrame, dealt: DataFrame, n: int, percent: int) -> DataFrame:
    """The links within each (comp, i, j) of ``dealt`` (node, check, rep, comp, i, j, label)."""
    rows = dealt.select(F.col("rep").alias("doc_id"), "node", "check", "comp", F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), "label")
    met = with_text(texts, rows).select("comp", "i", "j", "doc_id", "node", "check", "label", "text")
    return join_groups(met.repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j"), n, percent)


def blocks_of(weight: Column) -> Column:
    """Blocks for sets of this weight in all; any two blocks fit in one task."""
    return F.ceil(2 * weight / GROUP).cast("int")


WEIGHT = f"n + {SET}"


def sized(members: DataFrame) -> DataFrame:
    """``members`` (node, check, rep, n, comp) of groups of two or more, with their group's ``n_blocks``."""
    sizes = members.groupBy("comp").agg(blocks_of(F.sum(F.expr(WEIGHT))).alias("n_blocks"), F.count(F.lit(1)).alias("n_sets"))
    return attach(members, sizes.filter("n_sets > 1"), ["comp"], "n_sets", hot_bound(members.count())).filter("n_blocks is not null")


def shared_prefixes(texts: DataFrame, large: DataFrame, n: int, percent: int) -> DataFrame:
    """(a, b): a finer forest of candidates among the nodes of large groups (node, check, rep, n, comp).

    In a group shingles are ordered from rare to frequent. Linked sets share one among the first
    ``size - least overlap + 1`` of each, so nodes with as many shingles of their own link with nothing and go, and the others
    are tied by the shared shingles of those first ones. A shingle is counted by partial sums, and its count goes back to its
    rows by ``attach``, so one that all sets of a large group hold is not one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(n)
        for batch in batches:
            comp, node, check = (batch.column(k).to_pylist() for k in range(3))
            at = 0
            for part in slices(batch.column(3)):
                for text in part:
                    s = shingle(text)
                    if len(s) and digest(s) == (node[at], check[at]):
                        own = mix(s ^ np.uint64(comp[at] & 0xFFFFFFFFFFFFFFFF))  # a shingle of another group is another token
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), node[at], np.int64)), pa.array(own.view(np.int64))], ["node", "token"])
                    at += 1

    met = with_text(texts, large.select(F.col("rep").alias("doc_id"), "comp", "node", "check")).select("comp", "node", "check", "text")
    tokens, path = store(met.mapInArrow(run, "node long, token long"))
    often = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    shared = attach(tokens, often.withColumn("times", F.col("df")), ["token"], "times", hot_bound(tokens.count())).filter("df is not null")
    lists = shared.groupBy("node").agg(F.sort_array(F.collect_set(F.struct("df", "token"))).alias("l"))
    first = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - (F.col("n") - F.size("l"))
    heads = lists.join(large.groupBy("node").agg(F.max("n").alias("n")), "node").filter(first > 0)
    rows, rows_path = store(heads.select("node", F.explode(F.slice("l", F.lit(1), first.cast("int"))).alias("x")).select("node", F.col("x.token").alias("token")))
    least = rows.groupBy("token").agg(F.min("node").alias("b"), F.count(F.lit(1)).alias("times")).filter("times > 1")
    forest, _ = store(attach(rows, least, ["token"], "times", hot_bound(rows.count())).filter("b <> node").select(F.col("node").alias("a"), "b").distinct())
    remove(large.sparkSession, path)
    remove(large.sparkSession, rows_path)
    return forest


def large_links(texts: DataFrame, large: DataFrame, n: int, percent: int) -> DataFrame:
    """(a, b): links of groups that don't fit in a task, such that all their linked sets are connected.

    First each block with the group's pivots; then the sets that aren't in the largest part so far (``rest``) against the blocks
    of all others: two sets of the largest part need no look. For copies of one text that is work in proportion."""
    place = lambda blocks: F.pmod(F.xxhash64("node", "check"), blocks).cast("int")
    keys = ("node", "check", "rep", "n")
    one = F.struct(*keys)
    pivots = large.groupBy("comp", "n_blocks").agg(F.array(*[F.min_by(one, F.struct(F.xxhash64("node", F.lit(k)), "node", "check")) for k in range(PIVOTS)]).alias("p"))
    pivots = pivots.select("comp", "n_blocks", F.explode(F.array_distinct("p")).alias("p")).select("comp", "p.*", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("i"))
    dealt = large.select("comp", *keys, place(F.col("n_blocks")).alias("i")).unionByName(pivots).dropDuplicates(["comp", "node", "check", "i"])
    found, _ = store(links_of(texts, dealt.select("*", F.lit(0).alias("j"), F.lit(None).cast("long").alias("label")), n, percent))
    parts = components(found).select(F.col("node").alias("rep"), "component")
    labelled, _ = store(large.select("comp", *keys).join(parts, "rep", "left").select("comp", *keys, F.coalesce("component", "rep").alias("label")))
    sizes = labelled.groupBy("comp", "label").agg(F.sum(F.expr(WEIGHT)).alias("w"), F.count(F.lit(1)).alias("n_sets"))
    top = sizes.groupBy("comp").agg(F.max(F.struct("w", "label")).alias("top"), F.sum("w").alias("w"), F.sum("n_sets").alias("n_sets"))
    open_ = top.filter("w > top.w").select("comp", F.col("top.label").alias("top"), blocks_of(F.col("w") - F.col("top.w")).alias("n_rest"), blocks_of(F.col("top.w")).alias("n_top"), "n_sets")
    mine = attach(labelled, open_, ["comp"], "n_sets", hot_bound(labelled.count())).filter("top is not null").withColumn("rest", F.col("label") != F.col("top"))
    mine = mine.withColumn("mine", F.when(F.col("rest"), place(F.col("n_rest"))).otherwise(F.col("n_rest") + place(F.col("n_top"))))
    others = F.sequence(F.lit(0), F.when(F.col("rest"), F.col("n_rest") + F.col("n_top")).otherwise(F.col("n_rest")) - 1)
    met = mine.withColumn("other", F.explode(F.filter(others, lambda k: k != F.col("mine"))))
    met = met.select("comp", *keys, "label", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
    return found.unionByName(links_of(texts, met, n, percent))


def jaccard_components(df: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 3, percent: int = 90) -> DataFrame:
    """One row per row of ``df``: doc_id, n_shingles, component_id. A pair links when 100 * |intersection| >= percent * |union|."""
    scanned, _ = store(scan(df, doc_id, text, n, percent))
    table = scanned.filter(F.col("kind") == FACT).select(F.col("x").alias("doc_id"), F.col("y").alias("node"), F.col("z").alias("check"), F.col("w").alias("n_shingles"))
    known = table.filter("doc_id is not null and n_shingles > 0")
    nodes, _ = store(known.groupBy("node", "check").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n"), F.count(F.lit(1)).alias("copies")))
    comps = components(candidates(scanned)).withColumnRenamed("component", "comp")
    texts = df.select(quoted(doc_id).cast("long").alias("doc_id"), quoted(text).alias("text"))
    columns = ["node", "check", "rep", "n", "comp"]
    groups, _ = store(sized(comps.join(nodes, "node").select(*columns)))
    small, large = groups.filter("n_blocks <= 2"), groups.filter("n_blocks > 2")
    if large.limit(1).count():
        finer = components(shared_prefixes(texts, large, n, percent)).withColumnRenamed("component", "comp")
        parted, _ = store(sized(large.drop("comp", "n_blocks").join(finer, "node").select(*columns)))
        small, large = small.unionByName(parted.filter("n_blocks <= 2")), parted.filter("n_blocks > 2")
    dealt = small.select("node", "check", "rep", "comp", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(None).cast("long").alias("label"))
    links = links_of(texts, dealt, n, percent)
    if large.limit(1).count():
        links = links.unionByName(large_links(texts, large, n, percent))
    final = components(links).select(F.col("node").alias("rep"), F.col("component"))
    facts = nodes.join(final, "rep", "left").select("node", "check", "copies", F.coalesce("component", "rep").alias("component_id"))
    linked = attach(known, facts, ["node", "check"], "copies", hot_bound(known.count())).select("doc_id", "n_shingles", "component_id")
    alone = table.filter("doc_id is null or n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)
