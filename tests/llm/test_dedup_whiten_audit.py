"""Content sort, whitening and filter audit against plain Python, on odd tables too."""

import hashlib
import itertools
import math
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkframe.llm import exact_dedup, filter_audit, queries, whitening

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string"


def rows_of_sql(name):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    r = con.sql(queries.ORACLE_SQL[name])
    return r.columns, r.fetchall()


@pytest.mark.parametrize("name", ["op11_exact_dedup", "op13_filter_audit"])
def test_sql(spark, name):
    columns, want = rows_of_sql(name)
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(tuple(r) for r in got.select(*columns).collect()) == sorted(want)


# --- exact duplicates ----------------------------------------------------------------------------------------------


def dedup(rows, largest, change=lambda t: t):
    """(doc_id, keep_id, group_size, text_sha256) of each row, sorted, and kept rows a text."""
    groups = {}
    for d, t, *_ in rows:
        groups.setdefault(change(t or ""), []).append(d)
    best = lambda ids: (max if largest else min)((d for d in ids if d is not None), default=None)
    return sorted(((d, best(ids), len(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items() for d in ids), key=str), len(groups)


@pytest.mark.parametrize("largest", [True, False])
def test_dedup(spark, largest):
    r = random.Random(5)
    long = "x" * (exact_dedup.SPLITTER + 10)
    texts = [None, "", " ", "a", "A", "a ", "é", "é" * 2000, "\U0010ffff", "￿", "\x00", long + "a", long + "b"] + ["".join(r.choice("ab") for _ in range(r.randint(1, 9))) for _ in range(60)]
    rows = [(k, r.choice(texts), "s") for k in range(700)] + [(10_000 + k, "hot text", "s") for k in range(500)]
    rows += [(None, "hot text", "s"), (None, None, "s"), (None, "only without id", "s"), (None, "only without id", "s"), (5, "twice", "s"), (5, "twice", "s"), (-(1 << 63), "least", None), ((1 << 63) - 1, "least", None), (None, "least", None)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, DOCS).select(F.lit("no").alias("TEXT"), "*", F.lit(1).alias("a.b"), F.lit(2).alias("range"))
    got = exact_dedup.exact_dedup(df, largest=largest).collect()
    want, n = dedup(rows, largest)
    assert sorted(((g.doc_id, g.keep_id, g.group_size, g.text_sha256) for g in got), key=str) == want
    kept = [g for g in got if g.kept]
    assert len({g.text_sha256 for g in kept}) == len(kept) == n and all(g.doc_id == g.keep_id for g in kept)


def test_dedup_ranges(spark):
    """A text that fills many ranges on its own, and each of them in one run."""
    rows = [(k, "same", None) for k in range(2000)]
    src = spark.createDataFrame(rows, DOCS).select("text", F.col("doc_id").alias("back"))
    bounds = exact_dedup.splitters(src, 16)
    assert len(bounds) == 15 and all(t == "same" for t, _ in bounds)
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, DOCS)).collect()
    assert {(g.keep_id, g.group_size) for g in got} == {(0, 2000)} and [g.doc_id for g in got if g.kept] == [0]


def test_dedup_splitters_are_folded(spark):
    rows = spark.createDataFrame([(k, f"{k:05d}", None) for k in range(300)], DOCS)
    at = exact_dedup._range(F.col("text"), F.lit(0), [("00100", 0), ("00200", 0)])
    plan = rows.select(at.alias("r"))
    assert "from_json" not in plan._jdf.queryExecution().optimizedPlan().toString()
    assert [r.r for r in rows.select("text", at.alias("r")).orderBy("text").collect()] == [0] * 100 + [1] * 100 + [2] * 100


def test_dedup_normalised_and_empty(spark):
    rows = [(1, " A b", None), (2, "a  B ", None), (3, None, None), (4, "  ", None)]
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, DOCS), lambda t: F.trim(F.regexp_replace(F.lower(t), r"\s+", " "))).collect()
    assert sorted((g.doc_id, g.keep_id, g.kept) for g in got) == [(1, 1, True), (2, 1, False), (3, 3, True), (4, 3, False)]
    assert exact_dedup.exact_dedup(spark.createDataFrame([], DOCS)).collect() == []


# --- whitening -----------------------------------------------------------------------------------------------------


def expected(vectors, most=16):
    x = np.floor(np.array(vectors, float) * 64).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    v = (fit - s / n).T @ (fit - s / n) / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:most], u[:, ::-1][:, :most]
    return n, ((n * x - s) ** 2).sum(1), (x - s / n) @ u / np.sqrt(e), e / np.trace(v)


def test_whitening(spark):
    r = np.random.default_rng(3)
    base = (r.normal(size=(60, 20)) * np.arange(1, 21) / 20).astype(np.float32)
    good = [[float(c) for c in v] for v in [*base, base[0], base[0], base[7]]]
    rows = [(k, v, 0) for k, v in enumerate(good)] + [(0, good[0], 0)]
    bad = [(900, None, 0), (901, [None] + good[0][1:], 0), (902, [math.nan] + good[0][1:], 0), (903, [-math.inf] + good[0][1:], 0), (904, [], 0)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, x int").withColumn("n", F.lit(1)).withColumn("a.b", F.lit(1))
    got = {}
    for g in whitening.whitening(df).collect():
        got.setdefault((g.vec_id, g.component), []).append(g)
    n, deviation, white, share = expected(good)
    assert n == 60 and {k for k, _ in got} == set(range(len(good))) and {c for _, c in got} == set(range(1, 17))
    sign = {c: np.sign(got[0, c][0].whitened * white[0, c - 1]) for c in range(1, 17)}
    for (k, c), gs in got.items():
        assert len(gs) == (2 if k == 0 else 1)
        for g in gs:
            assert g.n == n and g.deviation == deviation[k] and g.identity_error < 1e-9
            assert g.whitened * sign[c] == pytest.approx(white[k, c - 1], abs=1e-9) and g.explained == pytest.approx(share[c - 1], rel=1e-9)


def test_whitening_edges(spark):
    schema = "vec_id long, embedding array<double>"
    assert whitening.whitening(spark.createDataFrame([], schema)).collect() == []
    one = whitening.whitening(spark.createDataFrame([(1, [0.5, 0.25])], schema)).collect()
    assert [(g.component, g.n, g.deviation, g.whitened, g.explained, g.identity_error) for g in one] == [(1, 1, 0, None, 0.0, None), (2, 1, 0, None, 0.0, None)]
    # Two lengths; one dimension without variance; entries that overflow a deviation, and one that no long holds.
    rows = [(1, [1.0, 2.0]), (2, [3.0, 2.0]), (3, [1.0]), (4, [2.0**50]), (5, [1e300]), (None, [1.0])]
    got = {(g.vec_id, g.component): g for g in whitening.whitening(spark.createDataFrame(rows, schema)).collect()}
    assert set(got) == {(1, 1), (1, 2), (2, 1), (2, 2), (3, 1), (4, 1), (None, 1)}
    assert got[1, 1].n == 2 and abs(got[1, 1].whitened) == pytest.approx(1) and got[1, 2].whitened is None
    assert got[1, 1].deviation == 128**2 and got[3, 1].deviation is None and abs(got[3, 1].whitened) == pytest.approx(1)


def test_whitening_blocks(spark, monkeypatch):
    """More pairs than one aggregation takes."""
    v = np.random.default_rng(1).normal(size=(40, 9))
    df = spark.createDataFrame([(k, [float(c) for c in x]) for k, x in enumerate(v)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(whitening, "PAIRS", 10)
    got = {(g.vec_id, g.component): abs(g.whitened) for g in whitening.whitening(df).collect()}
    _, _, white, _ = expected(v)
    assert all(got[k, c + 1] == pytest.approx(abs(white[k, c]), abs=1e-9) for k in range(40) for c in range(9))


# --- filter audit --------------------------------------------------------------------------------------------------

WORD = re.compile("[^\x20\x09-\x0d]+")


def fails(text):
    w = WORD.findall(text)
    return [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), bool(re.search("[#$%&*|]", text))]


@given(st.lists(st.text(st.sampled_from("aB \t\n\x0b#é日😀\x00 \x1c"), max_size=40) | st.none(), min_size=1, max_size=12))
@settings(max_examples=150, deadline=None)
def test_scan(texts):
    got = filter_audit.scan(pa.array(["cut", *texts], pa.string()).slice(1))
    for k, t in enumerate(x or "" for x in texts):
        w = WORD.findall(t)
        assert (got["words"][k], got["distinct"][k], got["capitals"][k], got["symbols"][k], got["points"][k]) == (len(w), len(set(w)), t.count("B"), t.count("#"), len(t))


@pytest.mark.parametrize("hashes", [filter_audit._hashes, lambda raw, start, size: np.zeros(len(start), np.uint64), lambda raw, start, size: size.astype(np.uint64) << np.uint64(40)])
def test_distinct_words_verified(hashes):
    """Words of any length, with hashes that all collide as well."""
    r = random.Random(2)
    words = ["a" * n + "b" * m for n in (1, 7, 8, 9, 63, 64, 65, 3000) for m in (0, 1, 2)]
    docs = [[r.choice(words) for _ in range(r.randint(0, 50))] for _ in range(20)]
    flat = [(d, w.encode()) for d, ws in enumerate(docs) for w in ws]
    raw = np.frombuffer(b" ".join(w for _, w in flat) + b" " * 8, np.uint8)
    size = np.array([len(w) for _, w in flat])
    start = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    got = filter_audit.distinct_words(raw, start, size, np.array([d for d, _ in flat]), len(docs), hashes)
    assert got.tolist() == [len(set(ws)) for ws in docs]


def test_audit(spark):
    r = random.Random(8)
    make = lambda: " ".join(r.choice(["Abc", "de", "f#", f"w{r.randint(0, 400)}"]) for _ in range(r.choice([5, 250, 300])))
    texts = [make() for _ in range(40)] + [" ".join(f"v{k}" for k in range(300)), None, "", "é " * 400, "w" * 2_000_000, "x " * 700_000]
    rows = [(k, r.choice(texts), r.choice(["a", "b", None, ""])) for k in range(220)] + [(3, "again", "a"), (3, "again", "a"), (None, "again", "b"), (None, "lone", "c"), (None, "lone", "c")]
    labels = [(k, r.choice([0, 1, None]), r.choice([0, 1])) for k in range(0, 220, 2)] + [(4, 1, 0), (None, 1, 1), (10_000, 1, 1)]
    want = {}
    marks = [(p or "", [*fails(t or ""), any((s or "") == (t or "") and e is not None and (d is None or e < d) for e, s, _ in rows)], d) for d, t, p in rows]
    good = lambda d: any(x == d and q == 1 for x, q, _ in labels) and d is not None
    toxic = lambda d: any(x == d and t == 1 for x, _, t in labels) and d is not None
    sums = {}
    for order in itertools.permutations(range(5)):
        for part in {p for p, _, _ in marks}:
            left = [m for m in marks if m[0] == part]
            for step, f in enumerate(order):
                out = [m for m in left if m[1][f]]
                left = [m for m in left if not m[1][f]]
                every = [m for m in marks if m[0] == part and m[1][f]]
                want[part, "".join("ABCDE"[k] for k in order), step + 1] = [len(left), len(out), len(every) - len(out), sum(sum(m[1]) == 1 for m in every), sum(good(m[2]) for m in out), sum(toxic(m[2]) for m in out)]
                sums[part, f] = sums.get((part, f), 0) + len(out)
    for (part, order, step), v in want.items():
        v.append(sums[part, "ABCDE".index(order[step - 1])])
    docs = spark.createDataFrame(rows, DOCS).select("*", F.lit(1).alias("part"), F.lit("").alias("Text"), F.lit(1).alias("a.b"))
    marks_table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("good", F.lit(1))
    got = {(g.part, g.filter_order, g.step): [g.kept, g.removed, g.redundant, g.unique_fails, g.good_lost, g.toxic_lost, g.shapley] for g in filter_audit.audit(docs, marks_table).collect()}
    assert got == want
    assert filter_audit.audit(docs.limit(0), marks_table).collect() == []
    assert len(filter_audit.audit(docs.where("doc_id = 0"), marks_table.limit(0)).collect()) == 600
