"""Exact token counts at every prefix, by dynamic programming over pre-tokens.

For byte-pair encoding, the encoding of a prefix ends in the one token t for which the token before it and t,
put together, encode to just these two. So last[i] and count[i] = count[i - len(t)] + 1 follow from shorter
prefixes, without encoding any prefix anew. Which pairs fit is asked of the model once and remembered. The distinct
words of a batch take their steps together, as columns.
"""

from __future__ import annotations

import functools
import itertools
import json
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from inkframe.llm.common import small_batches, table, tidy
from inkframe.llm.pieces import PLAIN, byte_names, cut, runs, spell, tokenizer_path

#: Fixed value: the pre-token pattern of the byte-level tokenizer.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Fixed value: the characters that the pattern takes for white space; Python's own notion holds four more.
_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_EDGE = regex.compile(f"(?<=[^{_SPACE}])(?=[{_SPACE}])")
#: Characters whose classes no Unicode version changed; other texts are cut by the library itself.
_STABLE = regex.compile(r"[\t\n\r\x20-\x7e\xa0-ȳΑ-ΡΣ-ωА-я‐-‧ぁ-ゖ一-龥]*")


class Numbers:
    """Open addressing from 64-bit keys to small numbers, looked up many at once."""

    def __init__(self, bits: int):
        self.bits, self.held = bits, 0
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """New distinct keys; as soon as half of the room is taken, all others are forgotten."""
        if self.held + len(keys) > 1 << (self.bits - 1):
            self.__init__(max(self.bits, int(len(keys)).bit_length() + 2))
        self.held += len(keys)
        last = len(self.keys) - 1
        for at, key, value in zip(self._slot(keys).tolist(), keys.tolist(), values.tolist(), strict=True):
            while self.values[at] >= 0:
                at = (at + 1) & last
            self.keys[at], self.values[at] = key, value

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Values of the keys; -1 for those that are not held."""
        slot = self._slot(keys)
        out = self.values[slot]
        wrong = np.flatnonzero((out >= 0) & (self.keys[slot] != keys))
        while len(wrong):
            slot[wrong] = (slot[wrong] + 1) & (len(self.keys) - 1)
            out[wrong] = self.values[slot[wrong]]
            wrong = wrong[(out[wrong] >= 0) & (self.keys[slot[wrong]] != keys[wrong])]
        return out


_BASE = 0x9E6C63D0876A9A35 | 1
_POWERS = np.array([pow(_BASE, k, 1 << 64) for k in range(256)], np.uint64)


class PrefixCounter:
    """Token counts of all prefixes of texts under a byte-level BPE file of the tokenizers library."""

    #: Words of more bytes are counted one by one.
    WIDE = 48

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.names = sorted(t for t in spec["model"]["vocab"] if t not in self.special and len(self.model.tokenize(t)) == 1)
        self.tokens = set(self.names)
        self.longest = max(map(len, self.tokens))
        self.fits: dict[tuple[str, str], bool] = {}
        # The same for columns: tokens by number, found by a hash of their bytes; pairs of them.
        byte = {name: b for b, name in byte_names().items()}
        self.length = np.array([len(t) for t in self.names], np.int32)
        hashes = []
        for t in self.names:
            h = 0
            for c in t:
                h = (h * _BASE + byte[c] + 1) & ((1 << 64) - 1)
            hashes.append(h)
        self.numbers = Numbers(18)
        self.numbers.put(np.array(hashes, np.uint64), np.arange(len(hashes), dtype=np.int32))
        self.pairs = Numbers(21)

    def fit(self, a: str, b: str) -> bool:
        """The two tokens, put together, encode to just these two."""
        got = self.model.tokenize(a + b)
        return len(got) == 2 and got[0].value == a

    def fit_all(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """fit of pairs of token numbers."""
        keys = (a.astype(np.uint64) << np.uint64(20)) | b.astype(np.uint64)
        out = self.pairs.get(keys)
        if len(miss := np.flatnonzero(out < 0)):
            new, at = np.unique(keys[miss], return_inverse=True)
            names = self.names
            value = np.array([self.fit(names[k >> 20], names[k & 0xFFFFF]) for k in new.tolist()], np.int32)
            self.pairs.put(new, value)
            out[miss] = value[at.ravel()]
        return out == 1

    def tables(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """table of many words at once: counts of all byte prefixes but the empty one, word after word, and each word's bytes."""
        size = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        first = np.cumsum(size) - size
        out = np.zeros(int(size.sum()), np.int32)
        _, offsets, data = words.cast(pa.large_string()).buffers()
        raw = np.frombuffer(data, np.uint8)[np.frombuffer(offsets, np.int64)[words.offset] :] if len(words) else np.zeros(0, np.uint8)
        for k in np.flatnonzero(size > self.WIDE).tolist():
            out[first[k] : first[k] + size[k]] = self.table(words[k].as_py())[1:]
        low = 0
        for high in (6, 10, 16, 28, self.WIDE):
            rows = np.flatnonzero((size > low) & (size <= high))
            rows = rows[np.argsort(-size[rows], kind="stable")]
            for at in range(0, len(rows), 1 << 16):
                self._columns(raw, first, size, rows[at : at + (1 << 16)], out)
            low = high
        return out, size

    def _columns(self, raw: np.ndarray, first: np.ndarray, size: np.ndarray, rows: np.ndarray, out: np.ndarray) -> None:
        """The dynamic programme of words of about one length, from long to short, position by position."""
        n, width = len(rows), int(size[rows[0]]) if len(rows) else 0
        sums = np.zeros((width + 1, n), np.uint64)  # hashes of prefixes
        last, count = np.zeros((width + 1, n), np.int32), np.zeros((width + 1, n), np.int32)
        flat_last, flat_count = last.ravel(), count.ravel()
        own = size[rows]
        for i in range(1, width + 1):
            m = int(np.searchsorted(-own, -i, side="right"))
            sums[i, :m] = sums[i - 1, :m] * np.uint64(_BASE) + raw[first[rows[:m]] + i - 1] + np.uint64(1)
            open_ = np.arange(m)

            def attempt(which: np.ndarray, length, i=i) -> np.ndarray:
                """Of the words in which, those whose last `length` bytes are the token that ends here."""
                j = i - length
                token = self.numbers.get(sums[i, which] - sums[j, which] * _POWERS[length])
                ok = token >= 0
                inner = np.flatnonzero(ok & (j > 0))
                if len(inner):
                    before = flat_last[(j[inner] if isinstance(j, np.ndarray) else j) * n + which[inner]]
                    ok[inner] = self.fit_all(before, token[inner])
                hit = which[ok]
                last[i, hit] = token[ok]
                count[i, hit] = flat_count[(j[ok] if isinstance(j, np.ndarray) else j) * n + hit] + 1
                return which[~ok]

            # Just one token fits, so the order of trying is free: the last token grown by a byte, this byte alone, any other.
            if i > 1:
                grown = self.length[last[i - 1, :m]].astype(np.int64) + 1
                open_ = attempt(open_, grown)
            for length in range(1, min(i, self.longest) + 1):
                if not len(open_):
                    break
                open_ = attempt(open_, length)
            if len(open_):
                raise ValueError("no token ends here")
            out[first[rows[:m]] + i - 1] = count[i, :m]

    def table(self, text: str) -> list[int]:
        """Token counts of all byte prefixes of a pre-token, the empty one included."""
        data = spell(text)
        last, count = [""], [0]
        tokens, fits = self.tokens, self.fits
        for i in range(1, len(data) + 1):
            # Just one token fits, so the order of trying is free: the last token grown by a byte, this byte alone, any other.
            for j in itertools.chain((i - 1 - len(last[-1]), i - 1), range(max(0, i - self.longest), i)):
                t = data[j:i]
                if t not in tokens:
                    continue
                if j:
                    pair = (last[j], t)
                    ok = fits.get(pair)
                    if ok is None:
                        if len(fits) > 400_000:
                            fits.clear()
                        ok = fits[pair] = self.fit(*pair)
                    if not ok:
                        continue
                last.append(t)
                count.append(count[j] + 1)
                break
            else:
                raise ValueError("no token ends here")
        return count

    def pretokens(self, text: str) -> list[str]:
        if _STABLE.fullmatch(text):
            return PATTERN.findall(text)
        spans = self.library.pre_tokenizer.pre_tokenize_str(text)
        return [text[a:b] for _, (a, b) in spans]

    def segments(self, text: str) -> list[tuple[str, bool]]:
        """Ordinary text and special strings in turn."""
        if not any(s in text for s in self.special):
            return [(text, False)]
        cut = regex.split("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")", text)
        return [(x, bool(k % 2)) for k, x in enumerate(cut) if x]

    def total(self, text: str) -> int:
        n = 0
        for x, special in self.segments(text):
            n += 1 if special else sum(self.table(p)[-1] for p in self.pretokens(x))
        return n

    def piece(self, text: str) -> bytes:
        """Entry i, an unsigned 32-bit integer: the tokens of text[:i + 1] by itself."""
        if not (m := PLAIN.fullmatch(text)):
            return array("I", self.prefixes(text)[1:]).tobytes()
        t = self.table(m[1])
        if len(t) > len(m[1]) + 1:  # some characters take two bytes
            t = [t[0], *(t[k] for k in itertools.accumulate(1 + (c > "\x7f") for c in m[1]))]
        if m[2]:
            t += [t[-1] + k for k in self.table(m[2])[1:]]
        return array("I", t[1:]).tobytes()

    def prefixes(self, text: str) -> list[int]:
        """Entry i: the tokens of text[:i] by itself, for i from 0 to len(text)."""
        out, base = [0], 0
        for x, special in self.segments(text):
            if special:  # short of its end a special string is ordinary text, which may join what stands before it
                at = max((m.end() for m in _EDGE.finditer(text[: len(out) - 1])), default=0)
                whole = out[at]
                out += [whole + self.total(text[at : len(out) + k]) for k in range(len(x) - 1)] + [base + 1]
                base += 1
                continue
            run, run_base = "", base  # white space that stands before the pre-token
            for p in self.pretokens(x):
                t = self.table(p)
                ends, k = [], 0
                for c in p:
                    k += len(c.encode("utf-8", "replace"))
                    ends.append(base + t[k])
                if p in ("'re", "'ve", "'ll"):
                    ends[1] = base + t[1] + 1
                if not p.strip(_SPACE):
                    if run:
                        j, k = self.table(run + p), len(run.encode())
                        for m, c in enumerate(p):
                            k += len(c.encode())
                            ends[m] = run_base + j[k]
                        run += p
                    else:
                        run, run_base = p, base
                else:
                    if run and p[0] in _SPACE:
                        ends[0] = run_base + self.table(run + p[0])[-1]
                    run = ""
                out += ends
                base += t[-1]
        return out

    def truncate(self, text: str, budget: int) -> int:
        """Most characters whose prefix stays within the budget at every shorter prefix too."""
        return next((i - 1 for i, n in enumerate(self.prefixes(text)) if n > budget), len(text))


class PrefixTable:
    """Counts at every prefix of pieces: of words, with marks perhaps, by columns; of others one by one, remembered up to `most`."""

    WORD = r"^(?P<feed>\n?)(?P<word> ?[A-Za-zÀ-ÖØ-öø-ȳ]+)(?P<marks>[.,;:!?]*)$"

    def __init__(self, path: str, most: int = 200_000):
        self.counter, self.most, self.known = PrefixCounter(path), most, {}

    def one(self, text: str) -> bytes:
        v = self.known.get(text)
        if v is None:
            if len(self.known) >= self.most:
                self.known.clear()
            v = self.counter.piece(text)
            if len(text) <= 64:
                self.known[text] = v
        return v

    def load(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts, and for each piece where its own start among them and how many (one a character) they are."""
        coded = pieces.dictionary_encode()
        distinct = coded.dictionary
        parts = pc.extract_regex(distinct, self.WORD)
        plain = pc.is_valid(parts)
        parts = parts.filter(plain)
        feed = pc.binary_length(parts.field("feed")).to_numpy(zero_copy_only=False).astype(np.int64)
        word, marks = parts.field("word").dictionary_encode(), parts.field("marks").dictionary_encode()
        # Words: counts at the ends of characters, those of bytes that no continuation byte follows.
        count, size = self.counter.tables(word.dictionary)
        raw = np.frombuffer("".join(word.dictionary.to_pylist()).encode(), np.uint8)
        ends = np.append((raw[1:] & 0xC0) != 0x80, True)[: len(raw)]
        total = count[np.cumsum(size) - 1] if len(size) else count
        chars = np.add.reduceat(ends, np.cumsum(size) - size, dtype=np.int64) if len(size) else size
        tails = [np.array(self.counter.table(m)[1:] if m else [], np.int32) for m in marks.dictionary.to_pylist()]
        tail_size = np.array([len(t) for t in tails], np.int64)
        flat_tail = np.concatenate(tails) if tails else count
        w, m = (x.indices.to_numpy(zero_copy_only=False) for x in (word, marks))
        own = feed + chars[w] + tail_size[m]
        start = np.cumsum(own) - own
        flat = np.ones(int(own.sum()), np.int32)  # a line feed that leads is one token

        def fill(at, pick, n, values, add):
            """values[pick : pick + n] + add at flat[at : at + n], for many."""
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            flat[np.repeat(at, n) + step] = values[np.repeat(pick, n) + step] + np.repeat(add, n)

        fill(start + feed, (np.cumsum(chars) - chars)[w], chars[w], count[ends], feed)
        fill(start + feed + chars[w], (np.cumsum(tail_size) - tail_size)[m], tail_size[m], flat_tail, feed + total[w])
        others = [self.one(x) for x in distinct.filter(pc.invert(plain)).to_pylist()]
        sure = plain.to_numpy(zero_copy_only=False)
        starts, sizes = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
        starts[sure], sizes[sure] = start, own
        sizes[~sure] = [len(v) // 4 for v in others]
        starts[~sure] = len(flat) + np.cumsum(sizes[~sure]) - sizes[~sure]
        flat = np.concatenate([flat, np.frombuffer(b"".join(others), np.int32)])
        at = coded.indices.to_numpy(zero_copy_only=False)
        return flat, starts[at], sizes[at]


@functools.cache
def counters(path: str) -> PrefixTable:
    """A worker keeps it from task to task."""
    return PrefixTable(path)


def _fit(limit: int, before: np.ndarray, chars: np.ndarray, start: np.ndarray, flat: np.ndarray) -> int:
    """Most characters of a text whose prefix, and every shorter one, stays within the limit.

    Per piece: tokens before it, its characters, and where its prefix counts start.
    """
    at = 0
    for k in range(len(chars)):
        if before[k] + 4 * chars[k] > limit:  # a character has four tokens at most
            over = np.flatnonzero(before[k] + flat[start[k] : start[k] + chars[k]] > limit)
            if len(over):
                return at + int(over[0])
        at += int(chars[k])
    return at


def token_counts(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", limit: int = 1024, prefixes: bool = False) -> DataFrame:
    """Rows (doc_id, n_bytes, n_tokens, over_limit, fit_chars[, prefix_tokens]), one per row of docs (doc_id, text, anything else).

    fit_chars is the number of characters up to which every prefix has `limit` tokens at most. prefix_tokens[i] is the
    exact count of the first i characters. A null text counts as empty: 0 tokens. Repeated rows are rows like
    others; an empty table gives no rows.
    """

    @tidy
    def run(it):
        table = counters(tokenizer_path(tokenizer))
        for t in runs(it):
            texts = pc.fill_null(pa.concat_arrays(t.column("text").chunks), "")
            pieces, at = cut(texts)
            flat, start, chars = table.load(pieces)
            counts = flat[start + chars - 1].astype(np.int64) if len(start) else start
            sums = np.concatenate([[0], np.cumsum(counts)])
            n = sums[at[1:]] - sums[at[:-1]]
            length = np.concatenate([[0], np.cumsum(chars)])
            fit = length[at[1:]] - length[at[:-1]]
            # Inside its last pieces a text may pass the limit, though all of it does not.
            for k in np.flatnonzero(n + 256 > limit).tolist():
                own = slice(at[k], at[k + 1])
                fit[k] = _fit(limit, sums[own] - sums[at[k]], chars[own], start[own], flat)
            size = pc.binary_length(texts).cast(pa.int64())
            cols = [pa.concat_arrays(t.column("doc_id").chunks), size, pa.array(n), pa.array(n > limit), pa.array(fit)]
            names = ["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars"]
            if prefixes:
                own = np.repeat(sums[:-1], chars) + flat[np.repeat(start - length[:-1], chars) + np.arange(length[-1])]
                text = np.repeat(np.arange(len(n)), length[at[1:]] - length[at[:-1]])
                own = np.insert(own - sums[at[:-1]][text], length[at[:-1]], 0)
                ends = length[at] + np.arange(len(at))
                cols.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(own, pa.int32())))
                names.append("prefix_tokens")
            yield pa.RecordBatch.from_arrays(cols, names)

    small_batches(docs.sparkSession)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long" + ", prefix_tokens array<int>" * prefixes)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, byte-level BPE of 50,257 ids, limit 1024."""
    return token_counts(table(spark, sf_dir, "documents"))
