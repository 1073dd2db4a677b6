"""Word n-gram Jaccard join over whole texts, by signature trees.

1. Every text becomes the set of its distinct word shingles (64-bit hashes). Texts are read once, in blocks; rows of
   equal text in a block are one member of it.
2. Blocks ask, range by range of the hash space, in how many texts each of their shingles occurs. A text links only
   if the share p/q of its shingles occurs elsewhere, so all others are done here.
3. Of what is left, shingles are ordered from rare to frequent (all texts agree on the order). Linked sets share one
   of their first n - ceil(p * n / q) + 1 shingles, so texts that share such a shingle meet, and texts that meet form
   candidate groups. Frequent passages come last and bring nobody together unless a text has little else.
4. The groups are joined by signature trees: leaves and inner nodes hold OR-combined shingle bitmaps and size
   ranges, a dual traversal drops pairs of nodes whose largest possible overlap is too small, and the remaining
   pairs of sets are compared exactly. Groups over `chunk` texts are cut into chunks by size class and neighbourhood;
   only pairs of chunks that share one of those shingles, and whose sizes fit, become tasks, of two chunks each.
5. Linked texts become components. Each task returns a spanning forest, not all pairs.
"""

from __future__ import annotations

import math
import time

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkframe.llm.common import Scratch, connected_components, mix64, release, salted, slices, table, tidy

_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTES = _rng.integers(1, 2**64, 256, dtype=np.uint64)
_BASE = 0x9E6C63D0876A9A35 | 1
_INV = pow(_BASE, -1, 1 << 64)
_C = _rng.integers(1, 2**64, 16, dtype=np.uint64) | np.uint64(1)
_SLICE = 1 << 20
#: A shingle in more texts of a block than this is asked for once, with its count: a frequent one costs an entry a block.
_FREQUENT = 16
_BLOCK_TEXTS = 60_000  # members of a block are numbered by 16 bits

class _Powers:
    """Powers of the base and of its inverse modulo 2**64, as many as were needed so far."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def need(self, n: int) -> None:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(_BASE, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(_INV, k, 1 << 64))])


_POWERS = _Powers()


def _slices(data: bytes):
    """Pieces of about _SLICE bytes that end at white space."""
    at = 0
    while len(data) - at > _SLICE:
        end = max(data.rfind(c, at, at + _SLICE) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")) + 1
        if end <= at:
            break
        yield data[at:end]
        at = end
    yield data[at:]


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word [^\\x20\\x09-\\x0D]+ of the text, A-Z lower-cased."""
    out = []
    for data in _slices((text or "").encode("utf-8", "surrogatepass").lower()):
        b = np.frombuffer(data, np.uint8)
        if not len(b):
            continue
        word = (b != 32) & ((b < 9) | (b > 13))
        step = np.flatnonzero(np.diff(word, prepend=False, append=False))
        start, end = step[::2], step[1::2]
        _POWERS.need(len(b) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[b] * _POWERS.up[: len(b)], dtype=np.uint64)])
        out.append((sums[end] - sums[start]) * _POWERS.down[start])
    return mix64(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles; of the whole sequence if there are fewer words; none without words."""
    h = word_hashes(text)
    if not len(h):
        return h
    k = min(n, len(h))
    s = sum((h[i : len(h) - k + 1 + i] * _C[i % 8] + _C[8 + i % 8] for i in range(1, k)), h[: len(h) - k + 1] * _C[0])
    return np.unique(mix64(s + np.uint64(k)))


class SignatureTree:
    """Sets in order of size, leaves of `leaf` sets, inner nodes of `fan` nodes.

    Each node has an OR-combined bitmap, a size range and the most elements by which a set exceeds its bitmap. A set
    may leave out elements that no other set holds; its size counts them all the same.
    """

    def __init__(self, sets: list[np.ndarray], size: list[int], bits: int, leaf: int = 32, fan: int = 8):
        self.sets, self.leaf, self.fan = sets, leaf, fan
        self.size = np.array(size, np.int64)
        self.maps = np.zeros((len(sets), bits // 64), np.uint64)
        for row, s in zip(self.maps, sets, strict=True):
            bit = s & np.uint64(bits - 1)
            np.bitwise_or.at(row, (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
        self.excess = np.array([len(s) for s in sets], np.int64) - np.bitwise_count(self.maps).sum(1, dtype=np.int64)
        level, step = (self.maps, self.size, self.size, self.excess), leaf
        self.levels = []
        while not self.levels or len(level[1]) > 1:
            at = np.arange(0, len(level[1]), step)
            level = (np.bitwise_or.reduceat(level[0], at), np.minimum.reduceat(level[1], at), np.maximum.reduceat(level[2], at), np.maximum.reduceat(level[3], at))
            self.levels.append(level)
            step = fan


def dual_traversal(a: SignatureTree, b: SignatureTree, p: int, q: int):
    """Pairs of leaves (i, j) of both trees that may hold a link; with a is b, i <= j."""

    def may(la, i, lb, j) -> bool:
        overlap = min(la[2][i], lb[2][j], int(np.bitwise_count(la[0][i] & lb[0][j]).sum()) + min(la[3][i], lb[3][j]))
        return overlap * (p + q) >= p * (la[1][i] + lb[1][j])

    todo = [(len(a.levels) - 1, 0, len(b.levels) - 1, 0)]
    while todo:
        x, i, y, j = todo.pop()
        if (a is b and x == y and i > j) or not may(a.levels[x], i, b.levels[y], j):
            continue
        if x == 0 and y == 0:
            yield i, j
            continue
        if a is b and x == y:
            ii = range(i * a.fan, min((i + 1) * a.fan, len(a.levels[x - 1][1])))
            jj = range(j * b.fan, min((j + 1) * b.fan, len(b.levels[y - 1][1])))
            todo += [(x - 1, m, y - 1, n) for m in ii for n in jj]
        elif x >= y:
            todo += [(x - 1, m, y, j) for m in range(i * a.fan, min((i + 1) * a.fan, len(a.levels[x - 1][1])))]
        else:
            todo += [(x, i, y - 1, n) for n in range(j * b.fan, min((j + 1) * b.fan, len(b.levels[y - 1][1])))]


def _overlap(x: np.ndarray, y: np.ndarray) -> int:
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum())


def forest(left: list, right: list | None, p: int, q: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among left, or (given right) between left and right; right's ids follow left's.

    Each entry is (size, elements that another set may hold, sorted).
    """
    sets = left + (right or [])
    if len(sets) < 2:
        return []
    bits = 256
    while bits < 8 * max(len(s) for _, s in sets) and bits < 1 << 16:
        bits *= 2
    sides = ((0, left), (len(left), right or []))
    ids = [sorted(range(k, k + len(s)), key=lambda i: (sets[i][0], int(sets[i][1][0]))) for k, s in sides]
    trees = [SignatureTree([sets[i][1] for i in own], [sets[i][0] for i in own], bits) for own in ids if own]
    a, b = trees[0], trees[-1]
    ia, ib = np.array(ids[0]), np.array(ids[-1] if right else ids[0])
    root = np.arange(len(sets))
    out = []
    for i, j in dual_traversal(a, b, p, q):
        ra = np.arange(i * a.leaf, min((i + 1) * a.leaf, len(a.sets)))
        rb = np.arange(j * b.leaf, min((j + 1) * b.leaf, len(b.sets)))
        both = a.size[ra][:, None] + b.size[rb][None, :]
        common = np.bitwise_count(a.maps[ra][:, None, :] & b.maps[rb][None, :, :]).sum(2, dtype=np.int64)
        most = common + np.minimum(a.excess[ra][:, None], b.excess[rb][None, :])
        most = np.minimum(most, np.minimum(a.size[ra][:, None], b.size[rb][None, :]))
        fits = (most * (p + q) >= p * both) & (root[ia[ra]][:, None] != root[ib[rb]][None, :])
        if a is b:
            fits &= ra[:, None] < rb[None, :]
        for m, n in zip(*np.nonzero(fits), strict=True):
            x, y = int(ia[ra[m]]), int(ib[rb[n]])
            if root[x] == root[y]:
                continue
            if _overlap(sets[x][1], sets[y][1]) * (p + q) >= p * both[m, n]:
                root[root == max(root[x], root[y])] = min(root[x], root[y])
                out.append((x, y))
    return out


def text_key(text: Column) -> tuple[Column, Column]:
    """128 bits that name a text; null is the empty text."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    return F.xxhash64(t).alias("h1"), F.xxhash64(F.lit(1), t).alias("h2")


class Exchange:
    """The rows (part, block, kind, data) by which blocks of texts learn where else their shingles occur.

    A shingle's part is its first `bits` bits; of the rest, the next 48 travel.
    """

    MEMBERS, ASK, ASK_FREQUENT, OWN_FREQUENT, TELL, TELL_FREQUENT = range(6)
    SCHEMA = "part long, block long, kind int, data binary"

    def __init__(self, n: int, p: int, q: int, total: int):
        """total: about the number of shingles of all texts."""
        self.n, self.p, self.q = n, p, q
        # Parts and blocks grow alike with the input, from a million entries to 32 million each.
        self.block = int(min(max(8 * math.sqrt(total), 1 << 20), 1 << 25))
        self.bits = max(4, math.ceil(math.log2(max(1, total / self.block))))

    def _pack(self, tokens: np.ndarray) -> bytes:
        rest = tokens << np.uint64(self.bits)
        return (rest >> np.uint64(32)).astype("<u4").tobytes() + (rest >> np.uint64(16)).astype("<u2").tobytes()

    def _unpack(self, data: bytes, part: int, m: int) -> np.ndarray:
        high, low = np.frombuffer(data, "<u4", m).astype(np.uint64), np.frombuffer(data, "<u2", m, 4 * m).astype(np.uint64)
        rest = (high << np.uint64(32)) | (low << np.uint64(16))
        return np.uint64(part << (64 - self.bits)) | (rest >> np.uint64(self.bits))

    @staticmethod
    def _rows(rows: list[tuple]) -> pa.RecordBatch:
        cols = zip(*rows, strict=True) if rows else ((), (), (), ())
        kinds = pa.int64(), pa.int64(), pa.int32(), pa.binary()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["part", "block", "kind", "data"])

    def ask(self, it):
        """Texts (doc_id, h1, h2, text), equal ones in a row, to the blocks' members and questions."""
        block, last = TaskContext.get().partitionId() << 24, None
        ids, keys, sets, held = [], [], [], 0
        for b in slices(it):
            for doc_id, h1, h2, text in zip(*(b.column(c).to_pylist() for c in ("doc_id", "h1", "h2", "text")), strict=True):
                if (h1, h2) == last:
                    ids[-1].append(doc_id)
                    continue
                if held >= self.block or len(sets) >= _BLOCK_TEXTS:
                    yield from self._ask(block, ids, keys, sets)
                    block, ids, keys, sets, held = block + 1, [], [], [], 0
                last = h1, h2
                ids.append([doc_id]), keys.append(last), sets.append(shingle_set(text, self.n))
                held += len(sets[-1])
        if sets:
            yield from self._ask(block, ids, keys, sets)

    def _ask(self, block: int, ids: list, keys: list, sets: list):
        size = np.array([len(s) for s in sets], np.int64)
        h1, h2 = zip(*keys, strict=True)
        members = pa.RecordBatch.from_arrays([pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(size), pa.array(ids, pa.list_(pa.int64()))], ["h1", "h2", "n", "ids"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, members.schema) as w:
            w.write_batch(members)
        home = (1 << self.bits) + block  # rows that no part has to see
        rows = [(home, block, self.MEMBERS, sink.getvalue().to_pybytes())]
        token, member = np.concatenate(sets), np.repeat(np.arange(len(sets)).astype("<u2"), size)
        order = np.argsort(token)
        token, member = token[order], member[order]
        first = np.flatnonzero(np.diff(token, prepend=~token[:1]))
        times = np.diff(np.append(first, len(token)))
        often = np.repeat(times > _FREQUENT, times)
        if often.any():
            rows.append((home, block, self.OWN_FREQUENT, token[often].astype("<u8").tobytes() + member[often].tobytes()))
            much = times > _FREQUENT
            for part, own in self._parts(token[first[much]]):
                rows.append((part, block, self.ASK_FREQUENT, self._pack(token[first[much]][own]) + times[much][own].astype("<u4").tobytes()))
            token, member = token[~often], member[~often]
        for part, own in self._parts(token):
            rows.append((part, block, self.ASK, self._pack(token[own]) + member[own].tobytes()))
            if len(rows) == 64:
                yield self._rows(rows)
                rows = []
        yield self._rows(rows)

    def _parts(self, token: np.ndarray):
        """Slices of sorted tokens, part by part."""
        if not len(token):
            return
        part = (token >> np.uint64(64 - self.bits)).astype(np.int64)
        at = np.flatnonzero(np.diff(part, prepend=-1))
        for x, y in zip(at.tolist(), [*at[1:].tolist(), len(token)], strict=True):
            yield int(part[x]), slice(x, y)

    def tell(self, t: pa.Table) -> pa.Table:
        """A part's questions to answers: entries whose shingle occurs twice or more, with a class of its frequency."""
        rows = list(zip(*(t.column(c).to_pylist() for c in t.column_names), strict=True))
        asked = [r for r in rows if r[2] in (self.ASK, self.ASK_FREQUENT)]
        out = [r for r in rows if r[2] not in (self.ASK, self.ASK_FREQUENT)]
        if asked:
            m = [len(r[3]) // (8 if r[2] == self.ASK else 10) for r in asked]
            token = np.concatenate([self._unpack(d, part, k) for (part, _, _, d), k in zip(asked, m, strict=True)])
            weight = np.concatenate([np.ones(k, np.int64) if r[2] == self.ASK else np.frombuffer(r[3], "<u4", k, 6 * k).astype(np.int64) for r, k in zip(asked, m, strict=True)])
            order = np.argsort(token)
            first = np.flatnonzero(np.diff(token[order], prepend=~token[order[:1]]))
            sums = np.add.reduceat(weight[order], first)
            often = np.empty(len(token), np.int64)
            often[order] = np.repeat(sums, np.diff(np.append(first, len(token))))
            at = 0
            for (part, block, kind, data), k in zip(asked, m, strict=True):
                own, times = token[at : at + k], often[at : at + k]
                at += k
                hit = times > 1
                if hit.any():
                    more = np.frombuffer(data, "<u2", k, 6 * k)[hit].tobytes() if kind == self.ASK else b""
                    level = np.minimum(4 * np.log2(times[hit]), 255).astype(np.uint8).tobytes()
                    out.append((part, block, self.TELL if kind == self.ASK else self.TELL_FREQUENT, self._pack(own[hit]) + level + more))
        return pa.Table.from_batches([self._rows(out)])

    def choose(self, t: pa.Table) -> pa.Table:
        """A block's answers to its members: with the shingles that occur elsewhere, and the first of them, where it may link."""
        members, own, told, often = None, None, [], []
        for part, _, kind, data in zip(*(t.column(c).to_pylist() for c in t.column_names), strict=True):
            if kind == self.MEMBERS:
                members = pa.ipc.open_stream(data).read_all()
            elif kind == self.OWN_FREQUENT:
                own = np.frombuffer(data, "<u8", len(data) // 10), np.frombuffer(data, "<u2", len(data) // 10, len(data) // 10 * 8)
            elif kind == self.TELL:
                k = len(data) // 9
                told.append((self._unpack(data, part, k), np.frombuffer(data, np.uint8, k, 6 * k), np.frombuffer(data, "<u2", k, 7 * k)))
            else:
                k = len(data) // 7
                often.append((self._unpack(data, part, k), np.frombuffer(data, np.uint8, k, 6 * k)))
        if own:
            token, level = (np.concatenate(c) for c in zip(*often, strict=True))
            order = np.argsort(token)
            kept = np.uint64((1 << 64) - (1 << max(0, 16 - self.bits)))
            told.append((own[0] & kept, level[order][np.searchsorted(token[order], own[0] & kept)], own[1]))
        n = members.column("n").to_numpy()
        sets, heads = [None] * len(n), [None] * len(n)
        if told:
            token, level, member = (np.concatenate(c) for c in zip(*told, strict=True))
            held = np.bincount(member, minlength=len(n))
            links = (n > 0) & (held * self.q >= n * self.p)
            live = links[member]
            token, level, member = token[live], level[live], member[live]
            order = np.lexsort((token, level, member))
            token, member = token[order], member[order]
            at = np.searchsorted(member, np.arange(len(n) + 1))
            # The shingles that occur nowhere else come first in the order, and bring nobody together.
            head = n - -(-n * self.p // self.q) + 1 - (n - held)
            for k in np.flatnonzero(links).tolist():
                s = token[at[k] : at[k + 1]]
                heads[k] = s[: head[k]].view(np.int64)
                sets[k] = np.sort(s).astype("<u8").tobytes()
        ids = (t.column("block")[0].as_py() << 16) + np.arange(len(n))
        cols = {"id": pa.array(ids, pa.int64())} | {c: members.column(c) for c in ("h1", "h2", "n", "ids")}
        return pa.table(cols | {"tokens": pa.array(sets, pa.binary()), "head": pa.array(heads, pa.list_(pa.int64()))})

    INDEX = "id long, h1 long, h2 long, n long, ids array<long>, tokens binary, head array<long>"


def _last(work):
    """A function of a group's table that now and then gives freed memory back."""
    at = [0.0]

    def run(t: pa.Table) -> pa.Table:
        out = work(t)
        if time.monotonic() > at[0] + 1:
            release()
            at[0] = time.monotonic()
        return out

    return run


def text_groups(docs: DataFrame, keep: Scratch, n: int, p: int, q: int, chunk: int) -> DataFrame:
    """Rows (h1, h2, n, ids, g1, g2): members of blocks (a text and the doc_ids of its rows there) and their component.

    Texts of one component, and only those, have the same (g1, g2). A text without words has n = 0.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *text_key(F.col("text")), text.alias("text"))
    total = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    x = Exchange(n, p, q, total // 7)
    # Sorted, so that a task that runs again numbers its texts as before.
    asked = src.sortWithinPartitions("h1", "h2", "doc_id").mapInArrow(tidy(x.ask), x.SCHEMA)
    index = asked.groupBy("part").applyInArrow(_last(x.tell), x.SCHEMA)
    index = index.groupBy("block").applyInArrow(_last(x.choose), x.INDEX)
    index = keep.save(index, "index")
    alike = index.where("tokens IS NOT NULL").groupBy("h1", "h2")
    nodes = alike.agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("tokens").alias("tokens"), F.first("head").alias("head"))
    nodes = keep.save(nodes, "nodes")

    heads = nodes.select("id", F.explode("head").alias("token"))
    hubs = heads.groupBy("token").agg(F.min("id").alias("hub"), F.count("*").alias("c")).where("c > 1").drop("c")
    met = keep.save(salted(heads, hubs, "token", "id").select("id", "token", "hub"), "met")
    groups = connected_components(met.select(F.col("hub").alias("a"), F.col("id").alias("b")), keep, "groups")
    links = keep.save(_links(nodes, met, keep.save(groups, "groups"), keep, p, q, chunk), "links")
    comps = connected_components(links, keep, "components")
    # A component is named by one of its texts.
    named = keep.save(nodes.select("id", "h1", "h2").join(comps.withColumnRenamed("node", "id").hint("merge"), "id"), "named")
    root = named.where("id = comp").select("comp", F.col("h1").alias("g1"), F.col("h2").alias("g2"))
    of = keep.save(salted(named, root, "comp", "id").select("h1", "h2", "g1", "g2"), "of")
    out = index.select("h1", "h2", "n", "ids").join(of.hint("merge"), ["h1", "h2"], "left")
    out = out.select("h1", "h2", "n", "ids", F.coalesce("g1", "h1").alias("g1"), F.coalesce("g2", "h2").alias("g2"))
    out = keep.save(out, "texts")
    keep.drop("index", "nodes", "met", "groups", "links", "named", "of")
    return out


def _classes(p: int, q: int) -> list[int]:
    """Least sizes of size classes: linked sets are of one class or of neighbouring ones."""
    low = [1]
    while low[-1] < 1 << 40:
        low.append(max(low[-1] + 1, -(-low[-1] * q // p)))
    return low


def _links(nodes: DataFrame, met: DataFrame, groups: DataFrame, keep: Scratch, p: int, q: int, chunk: int) -> DataFrame:
    """Spanning forests (a, b) of the links inside the groups."""
    groups = groups.withColumnRenamed("node", "id")
    sizes = keep.save(groups.groupBy("comp").agg(F.count("*").alias("size")), "sizes")
    total = sizes.agg(F.sum("size")).first()[0] or 0
    small = salted(groups, sizes.where(F.col("size") <= chunk), "comp", "id").select("id", F.col("comp").alias("chunk"))
    task = F.pmod(F.xxhash64("chunk"), F.lit(max(1, 4 * total // chunk)))
    parts = small.select(F.col("chunk").alias("i"), F.col("chunk").alias("j"), "chunk", "id", task.alias("task"))
    large = sizes.where(F.col("size") > chunk)
    if not large.isEmpty():
        low = F.array(*[F.lit(v) for v in _classes(p, q)])
        near = met.groupBy("id").agg(F.min("hub").alias("lead"))
        cls = F.size(F.filter(low, lambda v: v <= F.col("n"))).alias("cls")
        big = salted(groups, large, "comp", "id").join(near, "id").join(nodes.select("id", "n"), "id").select("id", "comp", "lead", cls)
        big = keep.save(big, "big")
        # Texts of one size class and one neighbourhood share a chunk, as far as there is room.
        many = lambda by: big.groupBy(*by).agg(F.ceil(F.count("*") / chunk).alias("m"))
        big = salted(big, many(["comp", "cls"]), ["comp", "cls"], "id").withColumn("near", F.pmod(F.xxhash64("lead"), F.col("m"))).drop("m")
        big = keep.save(big, "near")
        big = salted(big, many(["comp", "cls", "near"]), ["comp", "cls", "near"], "id").withColumn("place", F.pmod(F.xxhash64("id"), F.col("m")))
        big = keep.save(big.select("id", "cls", F.xxhash64("comp", "cls", "near", "place").alias("chunk")), "chunks")
        seen = keep.save(met.select("id", "token").join(big, "id").select("token", "cls", "chunk").distinct(), "seen")
        one, two = seen.select("token", F.col("cls").alias("c1"), F.col("chunk").alias("i")), seen.select("token", F.col("cls").alias("c2"), F.col("chunk").alias("j"))
        pairs = one.join(two, "token").where("i <= j AND abs(c1 - c2) <= 1").select("i", "j").distinct()
        sides = pairs.select("i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("chunk"))
        parts = parts.union(big.join(sides, "chunk").select("i", "j", "chunk", "id", F.xxhash64("i", "j").alias("task")))

    def run(t: pa.Table) -> pa.Table:
        todo: dict[tuple, tuple[dict, dict]] = {}
        for i, j, c, node, size, tokens in zip(*(t.column(x).to_pylist() for x in ("i", "j", "chunk", "id", "n", "tokens")), strict=True):
            todo.setdefault((i, j), ({}, {}))[c != i][node] = size, np.frombuffer(tokens, "<u8")
        a, b = [], []
        for (i, j), (left, right) in todo.items():
            ids = [*left, *right]
            for x, y in forest([*left.values()], [*right.values()] if i != j else None, p, q):
                a.append(ids[x]), b.append(ids[y])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    rows = parts.hint("merge").join(nodes.select("id", "n", "tokens"), "id")
    return rows.groupBy("task").applyInArrow(run, "a long, b long")


def ngram_jaccard_join(docs: DataFrame, n: int = 5, p: int = 8, q: int = 10, chunk: int = 512) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id), one per row of docs (doc_id, text, anything else).

    Documents link when q * intersection >= p * union of their sets of n-word shingles; component_id is the
    smallest doc_id that links reach. A null or word-less text has an empty set and links with nothing; repeated
    rows are copies and link, and so do other texts of one doc_id where they are alike. A null doc_id stays null, and
    is never a component_id of rows that have another. An empty table gives no rows; other columns are not used.
    """
    keep = Scratch(docs.sparkSession, "ngram")
    texts = text_groups(docs, keep, n, p, q, chunk)
    worded = texts.where("n > 0")
    first = worded.groupBy("g1", "g2").agg(F.min(F.array_min("ids")).alias("first"))
    rows = salted(worded, first, ["g1", "g2"], "h1").select(F.explode("ids").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("first").alias("component_id"))
    none = texts.where("n = 0").select(F.explode("ids").alias("doc_id"), F.col("n").alias("n_shingles"))
    out = keep.save(rows.unionByName(none.withColumn("component_id", F.col("doc_id"))), "rows")
    keep.drop("texts")
    return out


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """3-word shingles of all documents, linked from a Jaccard similarity of 0.9 on."""
    return ngram_jaccard_join(table(spark, sf_dir, "documents"), n=3, p=90, q=100)


#: Brute force in SQL: all pairs of texts that share a shingle, then the closure of the links.
OP3_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b FROM e x JOIN e y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))),
reach(a, b) AS (SELECT a, b FROM pairs UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(min(r.b), s.doc_id)) AS component_id
FROM s LEFT JOIN reach r ON r.a = s.doc_id GROUP BY s.doc_id, len(s.s)
"""
