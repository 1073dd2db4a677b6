"""Token ids of whole texts, written in the rANS file format of rans.py and read back."""

from __future__ import annotations

import functools
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkframe.llm import rans
from inkframe.llm.common import Scratch, exact, object_opener, object_writer, parallelism, release, table, tidy, uri_of
from inkframe.llm.pieces import byte_names, cut, runs, tokenizer_path

_PIECES = 1 << 15
RUN_BYTES = 4_000_000  # of texts that are encoded at once; memory goes by it
FILE_IDS = 1 << 20  # a file image is closed once it holds this many ids


class Encoder:
    """Ids of pieces by the tokenizers library."""

    #: Pieces whose pre-tokens are sure: letters, digits and marks in turn, after a space or line feed perhaps.
    PLAIN = r"^[ \n]?[0-9A-Za-zÀ-ÖØ-öø-ȳ!-&(-/:-@\[-`{-~]+$"
    PRETOKEN = r"(\n| ?[A-Za-zÀ-ÖØ-öø-ȳ]+| ?[0-9]+| ?[!-&(-/:-@\[-`{-~]+)"

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        # The same model on pre-tokens that are cut and spelled already.
        self.spelled = Tokenizer(self.library.model)
        self.spelled.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.size = np.zeros(self.library.get_vocab_size(), np.int64)
        for token, k in self.library.get_vocab().items():
            self.size[k] = len(token)
        self.names = np.zeros(256, np.uint16)
        for byte, name in byte_names().items():
            self.names[byte] = ord(name)
        self.names[1] = ord(" ")  # stands between pre-tokens

    def ids(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and for each piece where its own start among them and how many they are."""
        plain = pc.match_substring_regex(pieces, self.PLAIN)
        for x in self.special:
            plain = pc.and_not(plain, pc.match_substring(pieces, x))
        own = pieces.filter(plain)
        cut = pc.replace_substring_regex(own, self.PRETOKEN, "\\1\x01")
        _, offsets, data = cut.buffers()
        ends = np.frombuffer(offsets, np.int64)[cut.offset : cut.offset + len(cut) + 1]
        raw, flat = np.frombuffer(data, np.uint8) if len(cut) else None, [np.zeros(0, np.uint32)]
        for at in ends[:-1:_PIECES].tolist():  # a few at once, as the library keeps much of each id
            text = self.names[raw[at : ends[min(len(cut), np.searchsorted(ends, at) + _PIECES)]]].tobytes().decode("utf-16-le")
            flat.append(np.array(self.spelled.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32))
        flat = np.concatenate(flat)
        # A token is as long as the bytes that it spells, so sums of lengths tell pieces apart.
        length = pc.binary_length(own).to_numpy(zero_copy_only=False)
        places = np.concatenate([[0], np.searchsorted(np.cumsum(self.size[flat]), np.cumsum(length)) + 1])
        if places[-1] != len(flat) and len(own):
            raise ValueError("the tokenizer is not a byte-level one")
        start, size = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        sure = plain.to_numpy(zero_copy_only=False)
        start[sure], size[sure] = places[:-1], np.diff(places)
        more = [np.array(e.ids, np.uint32) for e in self.library.encode_batch_fast(pieces.filter(pc.invert(plain)).to_pylist(), add_special_tokens=False)]
        size[~sure] = [len(x) for x in more]
        start[~sure] = len(flat) + np.cumsum(size[~sure]) - size[~sure]
        return np.concatenate([flat, *more]), start, size


@functools.cache
def encoder(path: str) -> Encoder:
    """A worker keeps it from task to task."""
    return Encoder(path)


def encode(texts: pa.Array, own: Encoder, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in turn, each text's followed by end_id, and how many each has."""
    pieces, at = cut(texts)
    coded = pieces.dictionary_encode()
    which = coded.indices.to_numpy(zero_copy_only=False)
    flat, start, size = own.ids(coded.dictionary)
    start, size = start[which], size[which]
    before = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    lengths = before[at[1:]] - before[at[:-1]] + 1
    ids = np.full(int(lengths.sum()), end_id, np.uint32)
    inside = np.ones(len(ids), bool)
    inside[np.cumsum(lengths) - 1] = False
    step = np.int32 if max(len(flat), len(ids)) < 1 << 31 else np.int64
    ids[inside] = flat[np.repeat((start - before[:-1]).astype(step), size) + np.arange(before[-1], dtype=step)]
    return ids, lengths


def encode_files(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0, folder: str | None = None) -> DataFrame:
    """File images (part, seq, n_tokens, image) of docs (doc_id, text) in ascending doc_id order, null first.

    With a folder (a URI) the task that makes an image also writes it there as a file: path and n_bytes take its place,
    and no image passes between processes.

    Each document's ids end with end_id; a null or empty text has that id alone. Rows of one doc_id go by a hash of
    their text, then by text, so that many of them are dealt over parts too. Files are in order by part, then seq.
    """
    spark = docs.sparkSession

    @tidy
    def run(it):
        part, seq = TaskContext.get().partitionId(), 0
        tool = encoder(tokenizer_path(tokenizer))
        own, ids, lengths, size = [], [], [], 0

        def close():
            image = rans.encode(np.concatenate(ids), own, np.concatenate(lengths))
            kinds = {"part": pa.int64(), "seq": pa.int64(), "n_tokens": pa.int64(), "image": pa.binary()}
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((part, seq, size, image), kinds.values(), strict=True)], [*kinds])

        for t in runs(it, RUN_BYTES):
            docs_, at, one = t.column("doc_id").to_pylist(), 0, 0
            more, n = encode(pa.concat_arrays(t.column("text").chunks), tool, end_id)
            ends = np.cumsum(n)
            while at < len(n):
                stop = min(len(n), int(np.searchsorted(ends, ends[at] - n[at] + FILE_IDS - size)) + 1)
                last = int(ends[stop - 1])
                own += docs_[at:stop]
                ids.append(more[one:last]), lengths.append(n[at:stop])
                size, at, one = size + last - one, stop, last
                if size >= FILE_IDS:
                    yield close()
                    own, ids, lengths, size, seq = [], [], [], 0, seq + 1
                    release()
        if own:
            yield close()

    src = exact(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    dealt = src.repartitionByRange(parallelism(spark), *order).sortWithinPartitions(*order, "text")
    if folder is None:
        return dealt.mapInArrow(run, "part long, seq long, n_tokens long, image binary")
    write = object_writer("image", folder, ".rans")
    return dealt.mapInArrow(lambda it: write(run(it)), "part long, seq long, n_tokens long, path string, n_bytes long")


def decode_files(files: DataFrame, uri: str) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32, file) of token files (part, seq, n_tokens, path) in the folder uri, start counting over all files."""
    # Files are placed within their part, and parts, of which there is one a task, among themselves.
    before = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens"))
    parts = parts.select("part", before(Window.orderBy("part")).alias("first"))
    place = files.withColumn("base", before(Window.partitionBy("part").orderBy("seq"))).join(F.broadcast(parts), "part")
    # Rows are small and what they name is large: as many tasks as there may be.
    same = place.select((F.col("first") + F.col("base")).alias("base"), "path").repartition(parallelism(files.sparkSession))

    @tidy
    def run(it):
        read = object_opener(uri)
        for b in it:
            for base, path in zip(b.column("base").to_pylist(), b.column("path").to_pylist(), strict=True):
                doc, start, n, crc = [], [], [], []
                image = rans.Image(read(path))
                raw = image.decode().astype("<u4").tobytes()
                at = 0
                for d, k in zip(image.doc_ids, image.lengths.tolist(), strict=True):
                    doc.append(d), start.append(base + at), n.append(k), crc.append(zlib.crc32(raw[4 * at : 4 * (at + k)]))
                    at += k
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (doc, start, n, crc)), pa.array([path] * len(doc))], ["doc_id", "start", "n_tokens", "ids_crc32", "file"])
                release()

    return same.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, file string")


def token_binary(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0, folder: str | None = None) -> DataFrame:
    """Write token files to a folder (a URI), read them back: a row per document (doc_id, start, n_tokens, ids_crc32, file).

    The files stay: rans.Image reads each by itself. Without a folder they go to a new one under the shared folder. An
    empty table gives no rows and no files. Other columns of docs are not used.
    """
    spark = docs.sparkSession
    keep = Scratch(spark, "tokens")
    folder = folder or uri_of(keep.path("files"))
    files = keep.save(encode_files(docs, tokenizer, end_id, folder), "written")
    out = keep.save(decode_files(files, folder), "documents")
    keep.drop("written")
    return out


def op2_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, byte-level BPE of 50,257 ids."""
    return token_binary(table(spark, sf_dir, "documents"))
