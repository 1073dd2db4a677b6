"""Cut texts where byte-level BPE always cuts, and remember what each piece encodes to.

The byte-level pattern gives a single space between two other characters to what follows it, and makes a single line
feed between two other characters a pre-token of its own. So a text encodes to the encodings, in turn, of the pieces
that start at such a space or line feed. Special strings hold neither, so a piece holds them whole; other white
space, and runs of it, stay within one piece. Texts are cut side by side in their Arrow buffers, and only the distinct pieces
of a batch are looked at one by one.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from inkframe.llm.common import slices

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core

#: One or two pre-tokens for certain: letters, and marks after them.
PLAIN = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ȳ]+)([.,;:!?]*)")
_SPACE = np.zeros(256, bool)
_SPACE[[*range(9, 14), *range(28, 33)]] = True
#: White space beyond ASCII, in UTF-8.
_TWO = {b"\xc2\x85", b"\xc2\xa0"}
_THREE = {chr(c).encode() for c in (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)}


def byte_names() -> dict[int, str]:
    """Byte-level BPE spells a byte by a printable character: its own where that is printable, else the next from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


_NAMES = byte_names()


def spell(text: str) -> str:
    """The text's bytes in byte-level characters."""
    return text.encode("utf-8", "replace").decode("latin-1").translate(_NAMES)


def cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All pieces of the texts in turn, and where each text's pieces start (one entry more than texts). An empty text has none."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if offsets else np.zeros(1, np.int64)
    first, last = int(ends[0]), int(ends[-1])
    raw = np.frombuffer(data, np.uint8)[first:last] if data and last > first else np.zeros(0, np.uint8)
    ends = ends - first
    at = np.flatnonzero((raw == 32) | (raw == 10))
    at = at[(at > 0) & (at < len(raw) - 1)]
    fit = ~_SPACE[raw[at - 1]] & ~_SPACE[raw[at + 1]]
    # A neighbour beyond ASCII may be white space too.
    for k in np.flatnonzero(fit & ((raw[at - 1] > 127) | np.isin(raw[at + 1], (0xC2, 0xE1, 0xE2, 0xE3)))).tolist():
        s = int(at[k])
        before, after = raw[max(0, s - 3) : s].tobytes(), raw[s + 1 : s + 4].tobytes()
        fit[k] = not (before[-2:] in _TWO or before in _THREE or after[:2] in _TWO or after in _THREE)
    # A text's own start cuts; a space or line feed there, or at its end, stands beside another text's character.
    edges = np.zeros(len(raw) + 1, bool)
    edges[at[fit]] = True
    edges[ends[1:][ends[1:] > 0] - 1] = False
    edges[ends] = True
    starts = np.flatnonzero(edges)
    pieces = pa.Array.from_buffers(pa.large_string(), max(0, len(starts) - 1), [None, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(raw)])
    return pieces, np.searchsorted(starts, ends)


def runs(batches, most: int = 8_000_000):
    """Record batches put together to tables of about `most` bytes, so that a piece is looked at once in many texts."""
    held, size = [], 0
    for b in slices(batches):
        held.append(b)
        size += b.nbytes
        if size >= most:
            yield pa.Table.from_batches(held).combine_chunks()
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return name if os.path.sep in name else public_tokenizers.path(name)
