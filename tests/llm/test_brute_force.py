"""Joins, kernels and scores against plain Python on small inputs with frequent passages, hubs, nulls and repeats."""

import math
import random
import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from inkframe.llm import common, decontaminate, embedding_dedup, language_id, ngram_join, rans, source_mix, token_binary, toxicity, warc
from inkframe.llm.common import Scratch


def closure(links, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text, n):
    w = text.split()
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def corpus(seed):
    r = random.Random(seed)
    text = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(n))
    passage, line = text(60), text(9)
    rows = [f"{text(r.randint(5, 80))} {passage} {text(r.randint(5, 80))}" for _ in range(60)]  # a frequent passage
    rows += [f"{passage} {text(r.randint(1, 4))}" for _ in range(30)]  # little but the passage
    rows += [f"{text(r.randint(0, 20))} {line} {text(r.randint(0, 20))}" for _ in range(40)]
    base = text(120).split()
    for _ in range(50):  # near copies of one text, some of them too far from it
        w = list(base)
        for k in r.sample(range(len(w)), r.randint(0, 6)):
            w[k] = r.choice(["x", "y", "zz"])
        rows.append(" ".join(w))
    rows += [text(3), text(4), "one two", "one two", " one\ttwo ", "", " ", None]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("n", "p", "q"), [(5, 8, 10), (3, 90, 100), (2, 1, 2)])
def test_join(spark, n, p, q):
    rows = list(enumerate(corpus(n)))
    sets = {k: shingles(t or "", n) for k, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and q * len(sets[a] & sets[b]) >= p * len(sets[a] | sets[b])]
    comp = closure(links, sets)
    assert len(set(comp.values())) < len(comp) - 40
    df = spark.createDataFrame([(k, t, 1, "n") for k, t in rows], "doc_id long, text string, n int, h1 string")
    for chunk in (1024, 8):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.ngram_jaccard_join(df, n, p, q, chunk).collect()}
        assert got == {k: (len(sets[k]), comp[k]) for k in sets}


def test_join_small_blocks(spark, monkeypatch):
    """Texts over many blocks and parts, with frequent shingles asked for by count."""
    rows = list(enumerate(corpus(9)))
    want = sorted(map(tuple, ngram_join.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    made = ngram_join.Exchange.__init__

    def small(self, *args):
        made(self, *args)
        self.block, self.bits = 500, 6

    monkeypatch.setattr(ngram_join.Exchange, "__init__", small)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, ngram_join.ngram_jaccard_join(df).collect())) == want


def test_join_ids(spark):
    """Null ids stay null and name no component of others; a repeated id's texts are judged one by one."""
    a, b = (" ".join(f"{x}{k}" for k in range(50)) for x in "ab")
    rows = [(None, a), (None, a + " end"), (7, a), (3, b), (3, a + " more"), (None, b + " x"), (None, None), (5, None), (None, "lone words here")]
    out = ngram_join.ngram_jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=str)
    assert got == sorted([(None, 46, 3), (None, 47, 3), (7, 46, 3), (3, 46, 3), (3, 47, 3), (None, 47, 3), (None, 0, None), (5, 0, 5), (None, 1, None)], key=str)


def test_join_many_rows_without_id(spark):
    df = spark.range(600).selectExpr("cast(null as long) AS doc_id", "concat('same words in every row ', id % 3) AS text")
    assert ngram_join.ngram_jaccard_join(df).count() == 600


def test_near_duplicates_extra_columns(spark):
    rows = [(1, "a b c d e f", "x", {"k": 1}), (2, "a b c d e f", "y", {"k": 2}), (2, "a b c d e f", "y", {"k": 2}), (3, "g", "z", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, gone string, __row map<string,int>")
    left = corpus_pipeline.near_duplicates(spark, df, "")
    assert left.columns == df.columns and sorted(r.doc_id for r in left.collect()) == [1, 3]


def test_embeddings_at_the_threshold(spark):
    """Pairs planted at cosines of 0.9 to 0.92, in and between clusters: recall of at least 0.95, and no false link."""
    rng = np.random.default_rng(7)
    d = 48
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    centres = unit(rng.standard_normal((12, d)))
    x = unit(np.concatenate([centres[rng.integers(0, 12, 1500)] + 0.9 * unit(rng.standard_normal((1500, d))), rng.standard_normal((1500, d))]))
    base = x[rng.choice(len(x), 600, replace=False)]
    side = rng.standard_normal(base.shape)
    side = unit(side - (side * base).sum(1, keepdims=True) * base)
    c = rng.uniform(0.9, 0.92, (600, 1))
    x = np.concatenate([x, c * base + np.sqrt(1 - c**2) * side])
    near = unit(x) @ unit(x).T >= 0.9
    np.fill_diagonal(near, False)
    assert near.sum() >= 1100
    rows = spark.createDataFrame([(i, v.tolist(), 1, 2) for i, v in enumerate(x)], "vec_id long, embedding array<double>, node int, times int")
    for chunk in (2048, 100):
        out = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(rows, chunk=chunk).collect()}
        assert all(out[i] <= n for i, n in enumerate(near.sum(1))) and sum(out.values()) >= 0.95 * near.sum()


def test_embeddings_whole_traversal(spark):
    """With a traversal of everything all links are found, each once, whatever the chunks."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((40, 8))
    x = np.concatenate([x, x + 0.1 * rng.standard_normal(x.shape), x[:5], -x[:5], x[:3].astype(np.float32).astype(float)])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    comp = closure(np.argwhere(near).tolist(), range(len(x)))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    for chunk in (2048, 7):
        out = embedding_dedup.near_duplicates(rows, recall=1.0, chunk=chunk).collect()
        assert {r.vec_id: (r.n_links, r.component_id) for r in out} == {i: (int(near[i].sum()), comp[i]) for i in range(len(x))}
    empty = embedding_dedup.near_duplicates(rows.limit(0))
    assert empty.collect() == [] and empty.columns == ["vec_id", "n_links", "component_id", "kept"]


def test_blocks_are_those_of_the_traversal():
    rng = np.random.default_rng(0)
    x = embedding_dedup._units(rng.standard_normal((300, 16)))
    index = embedding_dedup.MultiIndex(x, 22, 0.9, 0.9)
    _, row, block = index.blocks(x)
    _, moved = index.place(x)
    for k in range(0, 300, 17):
        far = {}
        for i, p in enumerate(moved[0][k].tolist()):
            for j, q in enumerate(moved[1][k].tolist()):
                b = i // embedding_dedup.SIDE * index.across + j // embedding_dedup.SIDE
                far[b] = min(far.get(b, p + q), p + q)
        got = block[row == k].tolist()
        assert sorted(got) == sorted(b for b, d in far.items() if d <= index.reach)
        assert [far[b] for b in got] == sorted(far[b] for b in got)  # nearest first


def test_traverse():
    rng = np.random.default_rng(2)
    for n, p, q in ((50, 7, 4), (1, 1, 1), (20, 3, 9)):
        one, two = rng.integers(0, 5, (n, p)) * 0.5, rng.integers(0, 5, (n, q)) * 0.5  # with ties
        for reach in (-1.0, 0.0, 2.0, 9.0):
            row, i, j = embedding_dedup.traverse(one, two, reach)
            assert (np.diff(row) >= 0).all()
            for k in range(n):
                got = list(zip(i[row == k].tolist(), j[row == k].tolist(), strict=True))
                sums = [one[k, a] + two[k, b] for a, b in got]
                assert sums == sorted(sums) and sorted(got) == sorted((a, b) for a in range(p) for b in range(q) if one[k, a] + two[k, b] <= reach)


def naive_kernel(v, w):
    def weights(word):
        c = [toxicity._CLASS[ord(x)] if ord(x) < len(toxicity._CLASS) else 95 for x in f"^{word.strip(toxicity._STRIP) or word}$"]
        out = {}
        for i in range(len(c)):
            for j in range(i + 1, len(c)):
                for k in range(j + 1, min(len(c), i + toxicity.SPAN)):
                    key = c[i], c[j], c[k]
                    out[key] = out.get(key, 0.0) + toxicity.DECAY ** (k - i - 2)
        return out

    a, b = weights(v), weights(w)
    norm = math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))
    return (sum(x * b.get(k, 0.0) for k, x in a.items()) / norm) ** toxicity.POWER if norm else 0.0


def test_kernel():
    words = ["idiot", "idi-ot", "id iot", "stupid,", "a", "is", "été", "straße", "日本", "aaaa", "(ok)", "--"]
    marks = ["idiot", "stupid", "aaa", "été", "x"]
    got = toxicity.Landmarks(marks).kernel(words)
    assert got == pytest.approx(np.array([[naive_kernel(w, m) for m in marks] for w in words]))


def test_toxicity_scores(spark):
    """One label only: everybody's score is the share, texts without words included. Nothing depends on the company a text is in."""
    one = toxicity.fit(["a b", "c"], np.array([True, True]))
    assert one.score([None, "", "x y"]).tolist() == pytest.approx([0.75] * 3)
    none = toxicity.train(spark.createDataFrame([(1, "a")], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, toxic int"))
    assert none.score(["a", None]).tolist() == pytest.approx([0.5] * 2)
    texts = ["you are an idiot today", "what an idiot that was", "the sun is warm", "people were here"] * 6
    model = toxicity.fit(texts, np.arange(24) % 4 < 2)
    assert model.score([None, "", " \n"]).max() < 0.01
    assert model.score(texts).tolist() == pytest.approx([float(model.score([t])[0]) for t in texts])


def test_language_scores():
    """Log-probabilities added up gram by gram."""
    mask = (1 << 64) - 1
    codes = [int(c) for c in language_id._CODES]

    def buckets(text):
        c = [ord(x) for x in f" {text.lower()} "]
        for n in language_id.ORDERS:
            for at in range(len(c) - n + 1):
                h = c[at] * codes[0] & mask
                for i in range(1, n):
                    h = ((h ^ (h >> 29)) * codes[i] + c[at + i]) & mask
                yield ((h + n) * codes[1] & mask) >> 49

    texts = ["le chat est là", "the cat is there", "", "x", None, "123 !", "die Katze 日本", "a" * 300]
    rng = np.random.default_rng(0)
    model = language_id.Model(["de", "en", "fr"], rng.integers(0, 50, (language_id.BUCKETS, 3)))
    for (lang, p), t in zip(model.predict(texts), texts, strict=True):
        if not t or not any(x.isalpha() for x in t):
            assert (lang, p) == ("und", 0.0)
            continue
        total = sum(model.logp[b] for b in buckets(t))
        assert lang == model.langs[int(np.argmax(total))] and p == pytest.approx(1 / np.exp(total - total.max()).sum())
    assert language_id.Model([], np.zeros((language_id.BUCKETS, 0))).predict(["a"]) == [("und", 0.0)]


def test_long_text_grams(monkeypatch):
    texts = ["abcdefghij" * 30, "kl", "mnop" * 40]
    whole = sorted((a, b) for rows in language_id.grams(texts) for a, b in zip(*(x.tolist() for x in rows), strict=True))
    monkeypatch.setattr(language_id, "_SLICE", 37)
    assert sorted((a, b) for rows in language_id.grams(texts) for a, b in zip(*(x.tolist() for x in rows), strict=True)) == whole


def test_mix_bound_and_ties(spark):
    """A source's words come within half its smallest size of the target where its sizes allow it; copies of equal rows differ by one at most."""
    r = random.Random(4)
    rows = [(k % 50 if k % 7 else None, " ".join(["w"] * r.randint(1, 60)), "abcde"[k % 5], k) for k in range(900)]
    out = source_mix.entropy_mix(spark.createDataFrame(rows, "doc_id long, text string, source string, size int")).collect()
    assert len(out) == 900
    for s in "abcde":
        own = [x for x in out if x.source == s]
        assert abs(sum(x.taken for x in own) - own[0].target) <= 30
        by_size = {}
        for x in own:
            by_size.setdefault(x.size, []).append(x.copies)
        assert all(max(c) - min(c) <= 1 for c in by_size.values())


def test_mix_many_sources(spark):
    """Weights go by code point over ranges of names, null last."""
    names = [f"s{k:03d}" for k in range(40)] + ["Z", "é", None]
    rows = [(k, "w " * (1 + k % 9), s) for k, s in enumerate(names * 3)]
    out = source_mix.entropy_mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    total = {}
    for x in out:
        total[x.source] = total.get(x.source, 0) + x.size
    order = sorted((s for s in total if s is not None), key=lambda s: s.encode()) + [None]
    free, want, left = {s: 1 + k % 3 for k, s in enumerate(order)}, {}, float(sum(total.values()))
    while free:
        unit = left / sum(free.values())
        over = [s for s, w in free.items() if unit * w > 3 * total[s]]
        for s in over or list(free):
            want[s] = min(3 * total[s], unit * free[s])
            left -= want[s]
            del free[s]
    assert {x.source: x.target for x in out} == pytest.approx(want)


def test_leaks_odd_tables(spark):
    """Empty tables, clashing columns, and the shuffled join of more hashes than are broadcast."""
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"), (2, "short item here")], "item_id long, text string")
    text = "so one two three four five six seven eight nine ten eleven twelve thirteen fourteen end"
    docs = spark.createDataFrame([(1, text, 1, "a"), (1, "clean text", 2, "b"), (None, "a Short, item HERE", 3, "c"), (None, None, 4, "d")], "doc_id long, text string, key int, h string")
    pairs = lambda d, i: sorted(((r.doc_id, r.item_id) for r in decontaminate.find_leaks(d, i).collect()), key=str)
    assert pairs(docs, items) == [(1, 1), (None, 2)]
    assert pairs(docs.limit(0), items) == pairs(docs, items.limit(0)) == []
    few = decontaminate.BROADCAST_ROWS
    try:
        decontaminate.BROADCAST_ROWS = 0
        assert pairs(docs, items) == [(1, 1), (None, 2)]
    finally:
        decontaminate.BROADCAST_ROWS = few


def test_scratch_leaves_a_set_batch_size(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "77")
        keep = Scratch(spark, "t")
        with keep.batch_rows(4):
            assert spark.conf.get(key) == "4"
        assert spark.conf.get(key) == "77"
    finally:
        spark.conf.set(key, before)


def test_files(spark, tmp_path):
    """Token files and archives as files of their own, written twice, and read back."""
    docs = spark.createDataFrame([(k, f"text {k} of some words") for k in range(50)], "doc_id long, text string")
    files = token_binary.encode_files(docs)
    for _ in range(2):
        done = common.write_objects(files, "image", f"file://{tmp_path}/tokens", ".ids").collect()
    got = sorted(d for r in done for d in rans.Image(Path(r.path).read_bytes()).doc_ids)
    assert got == list(range(50)) and len(list((tmp_path / "tokens").iterdir())) == len(done)
    pages = spark.createDataFrame([(k, f"u{k}", f"<p>{k % 3}") for k in range(9)], "page_id long, url string, html string")
    archives = warc.write_archives(pages, Scratch(spark, "t"))
    common.write_objects(archives, "archive", f"file://{tmp_path}/pages", ".warc.gz").collect()
    back = spark.read.format("binaryFile").load(f"{tmp_path}/pages").select(F.col("content").alias("archive"))
    got = warc.assemble(warc.read_archives(back)).collect()
    assert len(got) == 9 and sum(r.main.type == "response" for r in got) == 3


def test_token_files_are_written_where_they_are_made(spark, tmp_path):
    """One Python function a task: an image does not pass to another process."""
    docs = spark.createDataFrame([(k, f"text {k} of some words") for k in range(50)], "doc_id long, text string")
    files = token_binary.encode_files(docs, folder=f"file://{tmp_path}/ids")
    assert files._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    done = {(r.part, r.seq): r for r in files.collect()}
    want = token_binary.encode_files(docs).collect()
    assert len(want) == len(done) == len(list((tmp_path / "ids").iterdir()))
    for r in want:
        f = done[r.part, r.seq]
        assert Path(f.path).read_bytes() == bytes(r.image) and (f.n_bytes, f.n_tokens) == (len(r.image), r.n_tokens)


def test_token_files_stay(spark, tmp_path):
    """The files of the query's own folder hold every id, each row names its file; rows without id are dealt over parts."""
    rows = [(k, f"text {k} of some words") for k in range(40)] + [(None, f"no id {k}") for k in range(2000)] + [(None, None), (None, "twice"), (None, "twice")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("a.b", F.lit(1))
    out = sorted(token_binary.token_binary(docs, folder=f"file://{tmp_path}/ids").collect(), key=lambda r: r.start)
    files = sorted((tmp_path / "ids").iterdir())
    images = {str(f): rans.Image(f.read_bytes()) for f in files}
    assert {r.file for r in out} == images.keys() and len(files) > 1
    assert sorted((d is not None, d or 0) for i in images.values() for d in i.doc_ids) == sorted((d is not None, d or 0) for d, _ in rows)
    ids = np.concatenate([images[str(f)].decode() for f in files])  # names are in the order of parts
    assert len(ids) == sum(r.n_tokens for r in out) and all(ids[r.start + r.n_tokens - 1] == 0 for r in out)
    assert [r.start for r in out] == np.cumsum([0, *[r.n_tokens for r in out[:-1]]]).tolist()
    assert max(len(i.doc_ids) for i in images.values()) < 1500
    assert token_binary.token_binary(docs.limit(0), folder=f"file://{tmp_path}/none").collect() == []


def test_query_files_stay(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda spark: f"file://{tmp_path}")
    captures = warc.op10_warc(spark, "/root/testdata/sf0.001").count()
    found = [r for f in tmp_path.rglob("*.warc.gz") for r in warc.records(f.read_bytes())]
    assert len(found) == 3 * captures > 0


def test_reader_is_linear():
    """16 MB of small records, and one large member, in time by their size."""
    small = b"".join(warc.record("metadata", f"urn:x:{k}", "u", b"n: %d" % k) for k in range(2000))
    many = small * (16_000_000 // len(small) + 1)
    at = time.monotonic()
    assert sum(1 for _ in warc.records(many)) == 2000 * (len(many) // len(small))
    assert time.monotonic() - at < 20
    big = np.random.default_rng(0).integers(0, 256, 5_000_000).astype(np.uint8).tobytes()
    assert [b for _, b in warc.records(warc.record("resource", "urn:y", "u", big) + small[:0])] == [big]
    for cut in (1, 100, len(small) // 2):
        with pytest.raises(ValueError):
            list(warc.records(warc.record("resource", "urn:y", "u", big)[:-cut]))


def test_columns_of_any_name(spark):
    rows = [(1, "a b", "en", 1, 2, 3, 4), (2, "9 9", "en", 1, 2, 3, 4), (3, None, "en", 1, 2, 3, 4), (4, "c d", "de", 5, 6, 7, 8)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "lang", "a.b", "__language", "text ", "TEXT"])
    got = language_id.stage(spark, docs, "")
    assert got.columns == docs.columns and sorted(map(tuple, got.collect())) == [rows[0], rows[3]]


def test_too_many_languages(spark):
    docs = spark.range(2000).selectExpr("id AS doc_id", "'a b' AS text", "cast(id AS string) AS lang")
    with pytest.raises(ValueError, match="values of lang"):
        language_id.train(docs)
