"""Operators against brute force, exact round trips or held-out accuracy, and on odd tables."""

import base64
import hashlib
import itertools
import math
import random
import re
import zlib
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import corpus_pipeline
from inkframe.llm import automaton, decontaminate, embedding_dedup, language_id, ngram_join, queries, rans, secret_scan, source_mix, token_binary, token_counts, toxicity, warc
from inkframe.llm.common import Scratch, connected_components

SF = "/root/testdata/sf0.01"
ODD = [(None, None, None, None, 1), (None, "", "s", "en", 1), (1, "a", None, None, 2), (1, "a", None, None, 2), (2, " \n\t ", "s", "en", 3), (3, "é ß 日本 😀 " * 300, "t", "de", 3), (4, "word " * 3000, "s", "en", 4), (5, "word " * 3000, "s", "en", 4)]
SCHEMA = "doc_id long, text string, source string, lang string, size int"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def docs():
    return duckdb.sql(f"SELECT doc_id, text, lang, source FROM read_parquet('{SF}/documents.parquet') ORDER BY 1").fetchall()


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def closure(links, nodes):
    comp = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(comp[a], comp[b])
            if (comp[a], comp[b]) != (m, m):
                comp[a] = comp[b] = m
                changed = True
    return comp


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(500, k) for k in range(501, 560)] + [(k, k + 1) for k in range(600, 640)]
    got = {x.node: x.comp for x in connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t"), "cc").collect()}
    edges = [e for e in edges if e[0] != e[1]]
    assert got == closure(edges, {x for e in edges for x in e})


def test_op1(spark, docs):
    out = queries.QUERIES["op1_source_mix"](spark, SF).collect()
    again = {r.doc_id: r.taken for r in queries.QUERIES["op1_source_mix"](spark, SF).collect()}
    size = {d: len(words(t)) for d, t, _, _ in docs}
    totals, taken, target = {}, {}, {}
    for d, _, _, s in docs:
        totals[s] = totals.get(s, 0) + size[d]
    want, free, left = {}, {s: 1 + k % 3 for k, s in enumerate(sorted(totals))}, float(sum(totals.values()))
    while free:
        unit = left / sum(free.values())
        over = [s for s, w in free.items() if unit * w > 3 * totals[s]]
        for s in over or list(free):
            want[s] = min(3 * totals[s], unit * free[s])
            left -= want[s]
            del free[s]
    for r in out:
        assert r.size == size[r.doc_id] and r.source_size == totals[r.source] and 0 <= r.taken <= 3 * r.size and again[r.doc_id] == r.taken
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
    assert target == pytest.approx(want)
    assert all(abs(taken[s] - want[s]) < 0.02 * want[s] for s in want)


def test_op1_capped(spark):
    df = spark.createDataFrame([(k, "w " * (5 if k < 3 else 50), "abc"[k % 3]) for k in range(30)] + [(99, "x", None)], "doc_id long, text string, source string")
    out = source_mix.entropy_mix(df).collect()
    none = [r for r in out if r.source is None]
    assert none[0].target == 3 and none[0].taken == 3


@settings(max_examples=30, deadline=None)
@given(st.lists(st.lists(st.integers(0, 60000), max_size=50), min_size=1, max_size=20))
def test_rans(lists):
    ids = [np.array([*x, 0], np.uint32) for x in lists]
    image = rans.Image(rans.encode(np.concatenate(ids), list(range(len(ids))), np.array([len(x) for x in ids])))
    assert (image.decode() == np.concatenate(ids)).all() and image.lengths.tolist() == [len(x) for x in ids]


def test_rans_blocks_and_damage():
    ids = (np.random.default_rng(0).zipf(1.3, 50_000) % 50_000).astype(np.uint32)
    data = rans.encode(ids, [None], np.array([len(ids)]))
    image = rans.Image(data)
    assert image.blocks == 4 and image.doc_ids == [None]
    assert (image.decode(2, 3) == ids[2 * rans.BLOCK : 3 * rans.BLOCK]).all()
    with pytest.raises(ValueError, match="block 3"):
        rans.Image(data[:-1] + bytes([data[-1] ^ 1])).decode()
    with pytest.raises(ValueError, match="header"):
        rans.Image(data[:60] + bytes([data[60] ^ 1]) + data[61:])


def test_op2_op7(spark, docs, tok):
    at, ids_want, counts_want = 0, [], []
    for d, t, _, _ in docs:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        counts_want.append((d, len(t.encode()), len(ids), len(ids) > 1024))
        ids_want.append((d, at, len(ids) + 1, zlib.crc32(np.array([*ids, 0], "<u4").tobytes())))
        at += len(ids) + 1
    assert sorted(tuple(r)[:4] for r in queries.QUERIES["op2_token_binary"](spark, SF).collect()) == ids_want
    got = sorted(map(tuple, queries.QUERIES["op7_token_counts"](spark, SF).collect()))
    assert [r[:4] for r in got] == counts_want
    count = lambda t: len(tok.encode(t, add_special_tokens=False).ids)
    assert any(r[3] for r in got)
    for (_, _, _, over, fit), (_, t, _, _) in zip(got, docs, strict=True):
        assert fit == len(t) if not over and fit == len(t) else count(t[:fit]) <= 1024 < count(t[: fit + 1])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["'re", "'ve", " ", "  ", "\n", "the", "don't", "é", "日本", "12", "...", "<|endoftext|>", "😀", " a", "_", "\x1c", "\x85"]), max_size=10).map("".join))
def test_prefix_counts(text):
    path = public_tokenizers.path("byte_bpe_50k.json")
    counter = _counter(path)
    assert counter.prefixes(text) == [len(counter.library.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]


_counters = {}


def _counter(path):
    if path not in _counters:
        _counters[path] = token_counts.PrefixCounter(path)
    return _counters[path]


SNIPPETS = ["'re", "'ve", " ", "  ", "\n", "\n\n", "\t", "the", "don't", "é", "日本", "12", "...", "<|endoftext|>", "😀", " a", "_", "\x1c", "\x85", "\u00a0", "\u3000", "word", "Ünder", "ÿ,", "-"]


def test_encode_odd_strings(tok):
    """Ids of whole texts, cut in batches, are the library's."""
    r = random.Random(12)
    texts = ["".join(r.choice(SNIPPETS) for _ in range(r.randint(0, 12))) for _ in range(20_000)] + [None, ""]
    table = token_binary.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    ids, lengths = token_binary.encode(pa.array(texts, pa.string()), table, 0)
    ends = np.cumsum(lengths)
    got = [ids[e - n : e].tolist() for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
    want = [[*e.ids, 0] for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert got == want
    sliced, n = token_binary.encode(pa.array(texts, pa.string())[5:9], table, 0)
    assert sliced.tolist() == sum(want[5:9], []) and n.tolist() == [len(w) for w in want[5:9]]


def test_prefix_tables_by_columns():
    """Words side by side get what they get one by one; what is remembered is bounded."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    counter = _counter(path)
    r = random.Random(6)
    texts = ["".join(r.choice("abcdeéßÿñ") for _ in range(r.randint(1, 70))) for _ in range(300)] + [" word", "été", " É", "a" * 200]
    count, size = counter.tables(pa.array(texts))
    assert size.tolist() == [len(t.encode()) for t in texts]
    assert count.tolist() == sum((counter.table(t)[1:] for t in texts), [])
    table = token_counts.PrefixTable(path, most=4)
    own = pa.array([" one", "two!?", "\nthree", "x-y", "1234", "...", "a b", "é's", "日本", " one", "\n\n", "Naïve,"])
    for _ in range(2):
        flat, start, chars = table.load(own)
        got = [flat[a : a + n].tolist() for a, n in zip(start.tolist(), chars.tolist(), strict=True)]
        assert got == [counter.prefixes(t)[1:] for t in own.to_pylist()] and len(table.known) <= 4
    assert table.load(pa.array([], pa.large_string()))[1].tolist() == []
    full = token_counts.Numbers(4)
    for k in range(40):
        full.put(np.array([k], np.uint64), np.array([k], np.int32))
        assert full.get(np.array([k, 99], np.uint64)).tolist() == [k, -1]


def test_prefixes_of_documents(spark, docs, tok):
    """prefix_tokens of whole documents, fit_chars and truncate against the library."""
    r = random.Random(2)
    rows = [(d, t) for d, t, _, _ in docs if len(t) < 700][:25] + [(10_000 + k, "".join(r.choice(SNIPPETS) for _ in range(60))) for k in range(15)] + [(20_000, None), (20_001, "")]
    counter = _counter(public_tokenizers.path("byte_bpe_50k.json"))
    count = lambda t: len(tok.encode(t, add_special_tokens=False).ids)
    got = token_counts.token_counts(spark.createDataFrame(rows, "doc_id long, text string"), limit=50, prefixes=True).collect()
    assert len(got) == len(rows)
    for x in got:
        t = dict(rows)[x.doc_id] or ""
        want = [count(t[:i]) for i in range(len(t) + 1)]
        assert x.prefix_tokens == want and x.n_tokens == want[-1] and x.over_limit == (want[-1] > 50)
        assert x.fit_chars == counter.truncate(t, 50) == next((i - 1 for i, n in enumerate(want) if n > 50), len(t))


def test_op3_small(spark):
    r = random.Random(4)
    base = [[r.choice("abcdefghijklmnop") + r.choice("xyz") * r.randint(1, 3) for _ in range(n)] for n in (3, 9, 30, 60, 200)]
    rows, k = [], 0
    for b in base:
        for _ in range(40):
            w = list(b)
            for _ in range(r.randint(0, max(1, len(b) // 20))):
                w[r.randrange(len(w))] = r.choice(["q", "Q", "zz"])
            rows.append((k, " ".join(w)))
            k += 1
    rows += [(k, None), (k + 1, ""), (k + 2, "one two"), (k + 3, "One\ttwo")]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = sorted(con.sql(ngram_join.OP3_SQL).fetchall())
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for chunk in (1024, 16):  # 16: groups over several tasks
        assert sorted(map(tuple, ngram_join.ngram_jaccard_join(df, 3, 90, 100, chunk).collect())) == want


def test_op4(spark):
    rng = np.random.default_rng(1)
    b = rng.standard_normal((300, 32))
    x = np.concatenate([b, b + 0.05 * rng.standard_normal(b.shape), b[:40] * 2, b[:1] + 0.1 * rng.standard_normal((150, 32))])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    comp = closure(np.argwhere(near).tolist(), range(len(x)))
    out = embedding_dedup.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), chunk=64).collect()
    assert sum(r.n_links for r in out) >= 0.97 * near.sum() and all(r.n_links <= near[r.vec_id].sum() for r in out)
    assert sum(r.component_id == comp[r.vec_id] for r in out) >= 0.97 * len(out) and all(r.kept == (r.vec_id == r.component_id) for r in out)
    bad = [(1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [1.0, None]), (5, []), (6, [1e300, 2e300]), (7, [1.0, 2.0]), (8, [float("inf"), 0.0])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(spark.createDataFrame(bad, "vec_id long, embedding array<double>")).collect()}
    assert got == {k: (0, k) for k, _ in bad if k not in (6, 7)} | {6: (1, 6), 7: (1, 6)}


def brute_spans(t):
    """All six kinds by Python's regexes."""
    kinds = [
        (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[1]) >= 6),
        ("AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
        ("[0-9a-f]+", lambda m: len(m[0]) >= 24),
        ("gh[opsu]_[A-Za-z0-9]{36}", lambda m: True),
        ("xox[abprs]-([A-Za-z0-9-]+)", lambda m: len(m[1]) >= 10),
        ("-----BEGIN [A-Z ]*PRIVATE KEY-----", lambda m: True),
    ]
    return sorted((m.start(), k, m.end()) for k, (p, ok) in enumerate(kinds) for m in re.finditer(p, t, re.A) if ok(m))


def test_op5(spark, docs):
    r = random.Random(3)
    bits = ["password", "TOKEN", "api_key", "Apikey", " = ", ":", '"', "'", " ", "=", "AKIA", "ABCDEFGHIJKL0123", "0123456789abcdef", "deadbeef", "é", "\n", ",", "ſecret", "value-1/2", "ghp_" + "a1" * 18, "gho_", "a1" * 17]
    bits += ["xoxb-", "xoxz-", "12-ab", "-----BEGIN ", "RSA ", "PRIVATE KEY", "-----", "BEGIN", "日本"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 40))) for _ in range(3000)] + ["", "token=abcdef", "x" * 50_000 + " secret: abcdefg"]
    assert secret_scan.Scanner().scan(texts) == [brute_spans(t) for t in texts]
    assert {k for t in texts for _, k, _ in brute_spans(t)} == set(range(6))
    out = {x.doc_id: x for x in queries.QUERIES["op5_secret_scan"](spark, SF).collect()}
    label = lambda s: ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in s)
    for d, t, _, _ in docs:
        s, x = brute_spans(t), out[d]
        assert x.base_sha256 == hashlib.sha256(label([y for y in s if y[1] < 3]).encode()).hexdigest() and x.spans == label(s)
        assert (x.n_assign, x.n_access, x.n_hex) == tuple(sum(k == n for _, k, _ in s) for n in range(3))
    assert secret_scan.redact("a token=abcdef b", [(2, 14)]) == "a [secret] b"


def test_automaton_accepts_by_rule():
    rules = [rb"ab+c", rb"(?i:x|yz)[0-9]{2}", rb"[^a-z\n]{3}"]
    machine, back = automaton.Automaton(rules), automaton.Backward(rules)
    r = random.Random(1)
    for _ in range(200):
        data = bytes(r.choice(b"abcxyzXYZ019 \n") for _ in range(60))
        places, bits = machine.hits(data, lanes=7)
        for k, p in enumerate(rules):  # each byte that a match ends with
            ends = {e - 1 for s in range(len(data)) for e in range(s + 1, len(data) + 1) if re.fullmatch(p, data[s:e])}
            assert set(places[bits >> k & 1 > 0].tolist()) == ends
            for e in ends:
                begins = [s for s in range(e + 1) if re.fullmatch(p, data[s : e + 1])]
                assert back.start(data, e, k, 0) == begins[0] and back.start(data, e, k, begins[-1]) == begins[-1] and back.start(data, e, k, begins[-1] + 1) == -1
        got, at = dict(zip(places.tolist(), bits.tolist(), strict=True)), 0
        for part in re.split(rb"[" + re.escape(bytes(np.flatnonzero(machine.reset).astype(np.uint8))) + rb"]", data):
            own = [b for p, b in got.items() if at <= p < at + len(part)]
            assert np.bitwise_or.reduce(np.array(own, int)) == sum(1 << k for k, p in enumerate(rules) if re.search(p, part))
            at += len(part) + 1


def test_op6(spark):
    out = {r.doc_id: r for r in queries.QUERIES["op6_toxicity"](spark, "/root/testdata/sf0.1").collect()}
    y = duckdb.sql("SELECT doc_id, toxic FROM read_parquet('/root/testdata/sf0.1/labels.parquet')").fetchall()
    held = [(t, out[d].predicted) for d, t in y if out[d].held_out]
    hit = sum(a and b for a, b in held)
    assert hit / sum(a for a, _ in held) > 0.75 and hit / sum(b for _, b in held) > 0.75
    model = toxicity.fit([], np.zeros(0, bool))
    assert len(model.score([None, "", "x"])) == 3


def test_op6_inserted():
    base = ["you are an idiot today", "what an idiot that was", "idiot people here", "he is an idiot"] * 5
    model = toxicity.fit(base + ["the sun is warm", "people were here today", "that was good", "he is a friend"] * 5, np.arange(40) < 20)
    s = model.score(["an idi-ot here", "an i d i o t here", "the warm friend"])
    assert s[0] > s[2] and s[1] > s[2]


def test_op8(spark):
    r = random.Random(5)
    voc = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 4))) for _ in range(400)]
    items = [(k, " ".join(r.choice(voc) for _ in range(r.randint(15, 50)))) for k in range(20)] + [(90, "zq zw ze"), (91, None), (92, "")]
    rows, want = [], set()
    for k in range(60):
        w = [r.choice(voc) for _ in range(r.randint(0, 300))]
        if k % 2:
            i = r.randrange(20)
            p = items[i][1].split()
            for j in r.sample(range(len(p)), len(p) // 12):
                p[j] = "zzz"
            at = r.randint(0, len(w))
            w[at:at] = p
            want.add((k, i))
        rows.append((k, " ".join(w), 1))
    rows += [(100, "So: zq ZW, ze!", 1), (101, "zq zw", 1), (None, None, 1)]
    found = decontaminate.find_leaks(spark.createDataFrame(rows, "doc_id long, text string, item_id int"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(x.doc_id, x.item_id) for x in found.collect()} == want | {(100, 90)}


def test_op8_all_substitutions(spark):
    """Items of 1 to 14 words with every allowed set of substituted words, at even and odd places; one more is no leak under 14."""
    items, rows, want = [], [], set()
    for n in range(1, 15):
        w = [f"w{n}x{k}" for k in range(n)]
        items.append((n, " ".join(w)))
        most = min(n, 13) - math.ceil(0.8 * min(n, 13))
        for cut in range(most + 2):
            for at in itertools.combinations(range(n), cut):
                for before in ((), ("a",)):
                    if cut <= most:
                        want.add((len(rows), n))
                    if cut <= most or n < 14:
                        rows.append((len(rows), " ".join([*before, *("zzz" if k in at else x for k, x in enumerate(w)), "b"])))
    found = decontaminate.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(x.doc_id, x.item_id) for x in found.collect()} == want


def test_op8_repeated_items(spark):
    """Items of equal words leak under each of their ids."""
    text = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    items = spark.createDataFrame([(3, text), (9, text.upper() + "!"), (9, text), (None, text), (4, "another item"), (5, "Another, item")], "item_id long, text string")
    rows = spark.createDataFrame([(1, "so " + text), (2, "an another item"), (3, "nothing")], "doc_id long, text string")
    found = [(x.doc_id, x.item_id) for x in decontaminate.find_leaks(rows, items).collect()]
    assert sorted(found, key=str) == [(1, 3), (1, 9), (1, None), (2, 4), (2, 5)]


def test_op8_whole_items(spark, docs):
    items = duckdb.sql(f"SELECT item_id, text FROM read_parquet('{SF}/benchmark.parquet')").fetchall()
    got = {(r.doc_id, r.item_id) for r in queries.QUERIES["op8_decontaminate"](spark, SF).collect()}
    assert got == {(d, i) for d, t, _, _ in docs for i, b in items if b in t}


def test_op9(spark, docs):
    out = {r.doc_id: r for r in queries.QUERIES["op9_language_id"](spark, SF).collect()}
    held = [out[d].lang_pred == lang for d, _, lang, _ in docs if out[d].held_out]
    assert sum(held) / len(held) > 0.97
    assert all(out[d].held_out == (zlib.crc32(str(d).encode()) % 4 == 2) for d, *_ in docs)


def test_language_stage_rows(spark):
    """Texts with a letter stay, whether or not any row can be learned from."""
    held = next(k for k in range(100) if language_id.held_out(k))
    texts = ["the sun", "日本", "é1", None, "", " \n", "12 !"]
    for rows in ([(k, t, None) for k, t in enumerate(texts)], [(held, t, "en") for t in texts], [(None, t, "en") for t in texts], [(None, t, "und") for t in texts]):
        left = language_id.stage(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), "").collect()
        assert sorted(r.text for r in left) == sorted(texts[:3])


def test_op10(spark):
    first, want = {}, []
    for p, h in duckdb.sql(f"SELECT page_id, html FROM read_parquet('{SF}/pages.parquet') ORDER BY 1").fetchall():
        b = (h or "").encode()
        f = first.setdefault(b, p)
        want.append((p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if f == p else "revisit", None if f == p else f))
    assert sorted(map(tuple, queries.QUERIES["op10_warc"](spark, SF).collect())) == want
    pages = spark.createDataFrame([(None, None, None), (7, "u", ""), (3, "u\r\nX: y", ""), (2, "é" * 3000, "<b>é\r\n\r\n</b>")], "page_id long, url string, html string")
    rows = warc.read_archives(warc.write_archives(pages, Scratch(spark, "t")))
    got = warc.assemble(rows).collect()
    assert len(got) == 4 and {bytes(r.main.payload).decode() for r in got} == {"", "<b>é\r\n\r\n</b>"}


def test_op10_nulls_and_repeats(spark):
    """Each row is a capture with ids of its own; a payload has one response, that of the smallest page_id, null last."""
    rows = [(None, None, None), (None, "u", ""), (7, "u", ""), (3, "u\r\nX: y", ""), (2, "é" * 3000, "<b>é\r\n\r\n</b>"), (4, "b", "y"), (4, "a", "y"), (4, "a", "y"), (None, "q", "n"), (None, "q", "n"), (None, None, "n")]
    pages = spark.createDataFrame([(*r, k, "z") for k, r in enumerate(rows)], "page_id long, url string, html string, first int, sha string")
    got = warc.assemble(warc.read_archives(warc.write_archives(pages, Scratch(spark, "t")))).collect()
    assert len(got) == len(rows) and len({r.capture for r in got}) == len(rows)
    assert all(len(r.requests) == len(r.metadata) == 1 for r in got)
    assert all(r.requests[0].target_uri == r.metadata[0].target_uri == r.main.target_uri for r in got)
    page = lambda rid: None if rid.split(":")[3] == "null" else int(rid.split(":")[3])
    by_payload = {}
    for r in got:
        by_payload.setdefault(bytes(r.main.payload).decode(), []).append(r)
    for payload, first in (("", (3, "u X: y")), ("y", (4, "a")), ("n", (None, "q")), ("<b>é\r\n\r\n</b>", (2, "é" * 3000))):
        responses = [r for r in by_payload[payload] if r.main.type == "response"]
        assert len(responses) == 1 and (page(responses[0].main.record_id), responses[0].main.target_uri) == first
        assert all(r.main.refers_to == responses[0].main.record_id for r in by_payload[payload] if r.main.type == "revisit")
    empty = pages.limit(0)
    assert warc.assemble(warc.read_archives(warc.write_archives(empty, Scratch(spark, "t")))).count() == 0
    small = warc.assemble(warc.read_archives(warc.write_archives(pages, Scratch(spark, "t"), min_revisit=2))).collect()
    assert all(r.main.type == "response" for r in small if len(r.main.payload) < 2)


def test_odd_tables(spark, odd):
    for t in (odd, odd.limit(0)):
        n = t.count()
        assert len(token_binary.token_binary(t).collect()) == n
        assert len(token_counts.token_counts(t, prefixes=True).collect()) == n
        assert len(ngram_join.ngram_jaccard_join(t).collect()) == n
        assert len(secret_scan.span_digest(secret_scan.secret_spans(t)).collect()) == n
        assert len(source_mix.entropy_mix(t).collect()) == n
        assert language_id.stage(spark, t, "").columns == t.columns
        assert decontaminate.stage(spark, t, SF).columns == t.columns
        assert corpus_pipeline.near_duplicates(spark, t, "").columns == t.columns
        assert len(toxicity.score(t, toxicity.fit(["a b"], np.array([True]))).collect()) == n
    comps = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.ngram_jaccard_join(odd).collect()}
    assert (4, 1, 4) in comps and (5, 1, 4) in comps and (1, 1, 1) in comps and (2, 0, 2) in comps


def test_near_duplicates_rows(spark):
    """Null and repeated ids: one row of each component stays, and no row goes for its id alone."""
    a, b, c, d, e = (" ".join(f"{x}{k}" for k in range(100)) for x in "abcde")
    rows = [(None, a, 1), (None, a, 2), (None, a + " end", 3), (7, b, 1), (7, b + " end", 2), (4, c, 1), (5, c + " end", 1), (5, d, 1), (None, e, 1), (8, e, 1), (9, "", 1), (9, "", 1), (None, "", 1), (None, "", 1)]
    left = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string, size int"), "").collect()]
    assert sorted(((i, t[:1]) for i, t in left), key=str) == [(4, "c"), (5, "d"), (7, "b"), (8, "e"), (9, ""), (None, ""), (None, ""), (None, "a")]


def test_pipeline(spark, tok, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 300").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = sorted(corpus_pipeline.run(spark, str(tmp_path)).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in out] == sorted(r.doc_id for r in out)
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM read_parquet('{SF}/documents.parquet')").fetchall())
    at = 0
    for r in out:
        ids = [*tok.encode(texts[r.doc_id], add_special_tokens=False).ids, 0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    # What the run leaves: files that give every id, with no more than Python and their path.
    files = sorted({r.file for r in out})
    images = [rans.Image(Path(f).read_bytes()) for f in files]
    assert np.concatenate([i.decode() for i in images]).tolist() == [t for r in out for t in [*tok.encode(texts[r.doc_id], add_special_tokens=False).ids, 0]]
    assert sum(len(i.doc_ids) for i in images) == len(out) and sum(Path(f).stat().st_size for f in files) < 4 * at


def test_pipeline_brute_force(spark, tmp_path):
    """Which documents stay, and how many copies of each size, on planted copies, leaks and texts without a letter."""
    r = random.Random(8)
    text = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    items = [(k, text(n)) for k, n in enumerate((20, 16, 13, 10, 7, 3))]
    texts = [text(r.randint(20, 60)) for _ in range(90)]
    for k in range(24):  # near copies, and from 16 on too far ones
        w = texts[k].split()
        for j in range(1 if k < 16 else 8):
            w[-1 - 6 * j % len(w)] = "zzz"
        texts.append(" ".join(w))
    for k in range(18):  # leaks, every third with one word too many substituted
        w = items[k % 6][1].split()
        least = min(len(w), 13) - math.ceil(0.8 * min(len(w), 13))
        for j in range(least + (k % 3 == 2)):
            w[(2 + 5 * j) % len(w)] = "zzz"
        texts.append(f"{text(20 + k % 2)} {' '.join(w)} {text(15)}")
    texts += [None, "", " \n", "12 34 !"]
    r.shuffle(texts)
    rows = [(i, t, ("en", "de")[k % 2], "abc"[k % 3]) for k, (i, t) in enumerate(zip(r.sample(range(1000), len(texts)), texts, strict=True))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    left = {i: (t.split(), s) for i, t, _, s in rows if t and any(c.isalpha() for c in t)}
    sets = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} for i, (w, _) in left.items()}
    comp = closure([(a, b) for a in sets for b in sets if a < b and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])], sets)
    assert 0 < sum(i != c for i, c in comp.items()) < 24
    left = {i: x for i, x in left.items() if comp[i] == i}

    def leaks(w, b):
        span = min(len(b), 13)
        same = lambda at, off: sum(0 <= at + off + k < len(w) and w[at + off + k] == b[off + k] for k in range(span))
        return any(same(at, off) >= math.ceil(0.8 * span) for at in range(-len(b), len(w)) for off in range(len(b) - span + 1))

    bad = {i for i, (w, _) in left.items() if any(leaks(w, b.split()) for _, b in items)}
    assert 10 <= len(bad) < 18
    left = {i: (len(w), s) for i, (w, s) in left.items() if i not in bad}

    totals = {s: sum(n for n, x in left.values() if x == s) for s in "abc"}
    want, free, rest = {}, {s: 1 + k for k, s in enumerate("abc")}, float(sum(totals.values()))
    while free:
        unit = rest / sum(free.values())
        over = [s for s, w in free.items() if unit * w > 3 * totals[s]]
        for s in over or list(free):
            want[s] = min(3 * totals[s], unit * free[s])
            rest -= want[s]
            del free[s]
    copies = {}
    for s in "abc":
        count = {}
        for n, x in left.values():
            if x == s:
                count[n] = count.get(n, 0) + 1
        mean = totals[s] / sum(count.values())
        rate = lambda n, lam: min(3.0, math.exp(min(50.0, lam * n / mean)))  # noqa: B023, E731
        lo, hi = -50.0, 50.0
        for _ in range(200):
            lam = (lo + hi) / 2
            lo, hi = (lam, hi) if sum(k * n * rate(n, lam) for n, k in count.items()) < want[s] else (lo, lam)
        carry = 0.0
        for n in sorted(count, reverse=True):
            carry += count[n] * n * rate(n, lam)
            copies[s, n] = max(0, min(3 * count[n], math.floor(carry / n + 0.5)))
            carry -= n * copies[s, n]
        assert abs(carry) <= 60
    out = [x.doc_id for x in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert set(out) <= left.keys()
    each = {i: out.count(i) for i in left}
    got = {}
    for i, (n, s) in left.items():
        got.setdefault((s, n), []).append(each[i])
    assert {k: sum(v) for k, v in got.items()} == copies
    assert all(max(v) - min(v) <= 1 for v in got.values())
