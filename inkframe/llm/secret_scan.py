"""Secrets in whole texts: one automaton of all rules finds where matches end, in one pass; the reversed one where they start."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkframe.llm.automaton import Automaton, Backward
from inkframe.llm.common import small_batches, slices, table, tidy


class Rule(NamedTuple):
    """A match is a head, then all characters of the tail class that follow (`most` at most).

    It needs one of them to be a match, and `least` to count: a shorter match is dropped, but what it took is taken.
    No byte of the tail class may prolong a head. The automata ask for `seek` of the tail's characters at least, as
    counters multiply states: one but where one is common.
    """

    head: bytes
    tail: bytes
    least: int
    seek: int
    most: int = 1 << 62

    def regex(self, more: bytes) -> bytes:
        return self.head + (self.tail + b"{%d%s}" % (self.seek, more) if self.tail else b"")


#: The base kinds, in order.
BASE = {
    "assign": Rule(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", rb"[A-Za-z0-9+/_.=-]", 6, 1),
    "access": Rule(rb"AKIA", rb"[A-Z0-9]", 16, 1),
    "hex": Rule(rb"", rb"[0-9a-f]", 24, 12),
}
#: Kinds beyond the base ones.
MORE = {
    "github": Rule(rb"gh[opsu]_", rb"[A-Za-z0-9]", 36, 1, 36),
    "slack": Rule(rb"xox[abprs]-", rb"[A-Za-z0-9-]", 10, 1),
    "pem": Rule(rb"-----BEGIN [A-Z ]*PRIVATE KEY-----", rb"", 0, 0, 0),
}
RULES = BASE | MORE
KINDS = [*RULES]


class Scanner:
    """Spans (start, kind number, end) in code points of many texts.

    One pass of the common automaton says at which bytes matches of which rules end; a tail's bytes follow each other,
    so the last of them is where the tail ends. From the first of them the reversed automaton leads to the start.
    """

    def __init__(self):
        self.rules = [*RULES.values()]
        self.forward = Automaton([r.regex(b",") for r in self.rules])
        self.backward = Backward([r.regex(b"") for r in self.rules])

    def _of_rule(self, kind: int, data: bytes, places: np.ndarray):
        """(start, end) of a rule's matches, from left to right, by the places at which matches of it may end."""
        rule, floor = self.rules[kind], 0
        first = np.flatnonzero(np.diff(places, prepend=-2) > 1)
        final = np.flatnonzero(np.diff(places, append=-2) != 1)
        for p, last in zip(places[first].tolist(), places[final].tolist(), strict=True):
            while p <= last:
                start = self.backward.start(data, p, kind, floor)
                tail = p + 1 - rule.seek
                end = min(last + 1, tail + rule.most)
                if start < 0 or (fails := end - tail < rule.least) and rule.most == rule.least:
                    p += 1  # what no match took may hold the next one's head
                    continue
                if not fails:
                    yield start, end
                floor, p = end, end + max(1, rule.seek) - 1

    def scan(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        raw = [t.encode("utf-8", "replace") for t in texts]
        begin = np.cumsum([0, *[len(r) + 1 for r in raw]])
        data = b"\n".join(raw)  # a line feed is a reset byte
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        places, bits = self.forward.hits(data)
        found = [(s, kind, e) for kind in range(len(self.rules)) for s, e in self._of_rule(kind, data, places[bits >> kind & 1 > 0])]
        if not found:
            return out
        start, kinds, end = np.array(sorted(found)).T
        own = np.searchsorted(begin, start, "right") - 1
        # Code points are counted between the places that are asked for, once over all texts.
        asked, at = np.unique(np.concatenate([[0], begin[own], start, end]), return_inverse=True)
        points = np.add.reduceat((np.frombuffer(data + b" ", np.uint8) & 0xC0) != 0x80, asked, dtype=np.int64)
        points = np.concatenate([[0], np.cumsum(points)[:-1]])[at[1:]].reshape(3, -1)
        for k, s, kind, e in zip(own.tolist(), (points[1] - points[0]).tolist(), kinds.tolist(), (points[2] - points[0]).tolist(), strict=True):
            out[k].append((s, kind, e))
        return [sorted(x) for x in out]


def secret_spans(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, spans array<struct<kind, start, end, secret>>), one per row of docs (doc_id, text, anything else).

    Spans are in code points, by start, then kind. A null or empty text has none; a null doc_id stays; repeated rows
    are rows like others; an empty table gives no rows.
    """

    shared = docs.sparkSession.sparkContext.broadcast(Scanner())  # a table of about a megabyte, whatever the input

    @tidy
    def run(it):
        scanner = shared.value
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("secret", pa.string())]))
        for b in slices(it):
            texts = [t or "" for t in b.column("text").to_pylist()]
            spans = [[{"kind": KINDS[k], "start": s, "end": e, "secret": t[s:e]} for s, k, e in own] for t, own in zip(texts, scanner.scan(texts), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(spans, kind)], ["doc_id", "spans"])

    small_batches(docs.sparkSession)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, spans array<struct<kind: string, start: long, end: long, secret: string>>")


def span_digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of the base spans and the list of all spans; without spans 0, the digest of nothing, and ''."""
    label = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    joined = lambda xs: F.concat_ws(",", F.transform(xs, label))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    count = [F.size(F.expr(f"filter(spans, s -> s.kind = '{k}')")).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *count, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redact(text: str, spans: list[tuple[int, int]], mask: str = "[secret]") -> str:
    """The text with each run of overlapping spans replaced by the mask."""
    out, at = [], 0
    for s, e in sorted(spans):
        if s >= at:
            out += [text[at:s], mask]
        at = max(at, e)
    return "".join(out) + text[at:]


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents."""
    return span_digest(secret_spans(table(spark, sf_dir, "documents")))
