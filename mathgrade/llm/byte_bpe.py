"""Byte-level BPE encoding and decoding by prefix dynamic programming.

A byte string's encoding is valid if and only if every two adjacent tokens are
what BPE makes of their joined bytes. So each prefix of a string has exactly
one valid last token: among the tokens t that end the prefix, the one that
forms a valid pair with the last token of the prefix before t. ``PrefixTable``
stores that token for every prefix. Appending bytes only adds entries; after an
edit, the entries before it stand and later ones are recomputed. Following the
last tokens back from the end gives the encoding.

Pair validity is decided once per pair, by following the merges on both sides
of the border, and remembered. Tokens that merging can't make (a rank list may hold
some) never take part, except that a piece which is itself in the rank list is
that one token, as the tiktoken library has it.

Texts are cut by a pattern first and each match is encoded alone. Encodings of
matches are remembered by each worker, in a table that drops what the texts at
hand don't use when it is full.

Definitions for odd input. A null text encodes like an empty one: no tokens. A
long text without a break is one match; work is linear in its length times the
longest token. Rows are encoded one by one, so repeated rows, null ids and
extra columns change nothing; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import trimmed

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Characters of text handled at once, and entries of the tables of remembered matches and pairs in each task.
RUN_CHARS, LONG_MATCHES = 2 << 20, 200_000
REMEMBERED = 400_000
_NEVER = float("inf")


class Vocabulary:
    """Byte strings by rank, with BPE merging and pair validity."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self._pairs: dict[int, bool] = {}
        self._made: dict[int, bool] = {}
        self._spines: dict[tuple[int, bool], list[tuple[bytes, float]]] = {}
        lengths: dict[bytes, set[int]] = {}
        for b in ranks:
            if len(b) > 2:
                lengths.setdefault(b[-3:], set()).add(len(b))
        #: By the last three bytes of a text, the lengths of the tokens that can end it, longest first.
        self.ending = {k: (*sorted(v, reverse=True), *self._short(k[1:])) for k, v in lengths.items()}
        #: All tokens' bytes in one buffer, with start and length by id, for decoding whole arrays.
        size = max(self.bytes_of, default=0) + 1
        self._buffer = np.frombuffer(b"".join(self.bytes_of.get(i, b"") for i in range(size)), np.uint8)
        self._length = np.array([len(self.bytes_of.get(i, b"")) for i in range(size)], np.int64)
        self._start = np.cumsum(self._length) - self._length

    def _short(self, pair: bytes) -> tuple[int, ...]:
        """Lengths of the tokens of at most two bytes that can end a text with these last two bytes."""
        return (2, 1) if len(pair) == 2 and pair in self.ranks else (1,)

    @classmethod
    def parse(cls, lines: bytes) -> Vocabulary:
        return cls({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines.splitlines()) if token})

    def merge(self, text: bytes) -> list[int]:
        """Plain BPE: join the adjacent parts of lowest rank, leftmost first, until none is in the ranks."""
        parts = [text[i:i + 1] for i in range(len(text))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def makes(self, token: int) -> bool:
        """Whether merging the token's bytes gives the token."""
        known = self._made.get(token)
        if known is None:
            known = self._made[token] = self.merge(self.bytes_of[token]) == [token]
        return known

    def _spine(self, token: int, last: bool) -> list[tuple[bytes, float]]:
        """The parts that stand at the token's end (or start) while its bytes merge, each with the rank of the
        merge that replaces it."""
        spine = self._spines.get((token, last))
        if spine is None:
            text, side = self.bytes_of[token], -1 if last else 0
            parts = [text[i:i + 1] for i in range(len(text))]
            spine = []
            while len(parts) > 1:
                rank, at = min((self.ranks.get(a + b, _NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
                if rank == _NEVER:
                    break
                if at == (len(parts) - 2 if last else 0):
                    spine.append((parts[side], rank))
                parts[at:at + 2] = [parts[at] + parts[at + 1]]
            spine.append((parts[side], _NEVER))
            self._spines[token, last] = spine
        return spine

    def fits(self, left: int, right: int) -> bool:
        """Whether the two tokens are what merging their joined bytes gives: no merge across their border comes
        before the merges that the parts beside the border still have to make. Of equal ranks the leftmost goes
        first."""
        key = left << 32 | right
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) >= REMEMBERED:
                self._pairs.clear()
            a, b, i, j = self._spine(left, True), self._spine(right, False), 0, 0
            known = self.makes(left) and self.makes(right)
            while known:
                (p, p_next), (q, q_next) = a[i], b[j]
                across = self.ranks.get(p + q, _NEVER)
                if across < p_next and across <= q_next and across != _NEVER:
                    known = False
                elif p_next == q_next == _NEVER:
                    break
                elif p_next <= q_next:
                    i += 1
                else:
                    j += 1
            self._pairs[key] = known
        return known

    def decode(self, ids) -> bytes:
        """The bytes of all tokens, gathered from one buffer."""
        ids = np.asarray(ids, np.int64)
        n = self._length[ids]
        ends = np.cumsum(n)
        return self._buffer[np.repeat(self._start[ids] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)].tobytes()


class PrefixTable:
    """The unique valid last token of every prefix of a byte string."""

    def __init__(self, vocabulary: Vocabulary, text: bytes = b""):
        self.vocabulary = vocabulary
        self.text = b""
        self.last: list[int] = []
        self.append(text)

    def append(self, more: bytes) -> PrefixTable:
        """Extend the string; the stored prefixes stand."""
        v, last, text = self.vocabulary, self.last, self.text + more
        ranks, fits, known, ending, short = v.ranks, v.fits, v._pairs, v.ending, v._short
        for end in range(len(self.text) + 1, len(text) + 1):
            for length in ending.get(text[end - 3:end]) or short(text[end - 2:end]) if end > 2 else range(end, 0, -1):
                begin = end - length
                if begin < 0:
                    continue
                token = ranks.get(text[begin:end])
                if token is None:
                    continue
                if begin:
                    before = last[begin - 1]
                    good = known.get(before << 32 | token)
                    if good is None:
                        good = fits(before, token)
                else:
                    good = v.makes(token)
                if good:
                    last.append(token)
                    break
            else:
                raise ValueError("a byte is missing from the vocabulary")
        self.text = text
        return self

    def replace(self, begin: int, end: int, new: bytes) -> PrefixTable:
        """Edit the string; only prefixes that reach past ``begin`` are done again."""
        text = self.text
        self.text = text[:begin]
        del self.last[begin:]
        return self.append(new + text[end:])

    def ids(self) -> list[int]:
        """The encoding, read back from the end."""
        out, at = [], len(self.text)
        while at:
            out.append(self.last[at - 1])
            at -= len(self.vocabulary.bytes_of[out[-1]])
        return out[::-1]


class Matches(dict):
    """Encodings of pattern matches, as little-endian 32-bit ids.

    ``learn`` encodes new matches in byte order with one prefix table, so each match only appends the bytes in
    which it differs from the one before."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        size = max(vocabulary.bytes_of, default=0) + 1
        self.packed = [i.to_bytes(4, "little") for i in range(size)]

    def learn(self, matches: set[str]) -> None:
        ranks, packed = self.vocabulary.ranks, self.packed
        table = PrefixTable(self.vocabulary)
        for raw, match in sorted((m.encode(), m) for m in matches):
            whole = ranks.get(raw)
            if whole is not None:
                self[match] = packed[whole]
                continue
            held = table.text
            same, most = 0, min(len(raw), len(held))
            while same < most and raw[same] == held[same]:
                same += 1
            table.replace(same, len(held), raw[same:])
            self[match] = b"".join([packed[i] for i in table.ids()])


_LOADED: dict[bytes, tuple[Vocabulary, Matches]] = {}


def _loaded(lines: bytes) -> tuple[Vocabulary, Matches]:
    """The vocabulary of this worker process, parsed once."""
    key = hashlib.sha256(lines).digest()
    if key not in _LOADED:
        v = Vocabulary.parse(lines)
        _LOADED[key] = (v, Matches(v))
    return _LOADED[key]


def encoder(lines: bytes, pattern: str):
    """A function from a list of texts to their packed ids."""
    import regex

    compiled = regex.compile(pattern)
    matches = _loaded(lines)[1]

    def packed(found: list[list[str]]) -> list[bytes]:
        every = set().union(*found)
        unknown = every - matches.keys()
        if unknown:
            if len(matches) + len(unknown) > REMEMBERED:
                used = {m: matches[m] for m in every - unknown}  # what this run needs stays
                matches.clear()
                matches.update(used)
            matches.learn(unknown)
        return [b"".join(map(matches.__getitem__, f)) for f in found]

    def encode_all(texts: list[str]) -> list[bytes]:
        if len(texts) == 1 and len(texts[0]) > RUN_CHARS:  # a very long text in parts, match by match
            parts = batched((m.group() for m in compiled.finditer(texts[0])), LONG_MATCHES)
            return [b"".join(packed([list(part)])[0] for part in parts)]
        return packed([compiled.findall(t) for t in texts])
    return encode_all


def _text_runs(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """The column cut into runs of at most ``RUN_CHARS`` characters (a longer text alone)."""
    start, held, texts = 0, 0, []
    for i, value in enumerate(column):
        text = value.as_py() or ""
        if texts and held + len(text) > RUN_CHARS:
            yield start, texts
            start, held, texts = i, 0, []
        texts.append(text)
        held += len(text)
    if texts:
        yield start, texts


def _mapper(lines: bytes, pattern: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_all, vocabulary = encoder(lines, pattern), _loaded(lines)[0]
        for batch in batches:
            for start, texts in _text_runs(batch.column("text")):
                packed = encode_all(texts)
                counts = [len(p) // 4 for p in packed]
                decoded = [vocabulary.decode(np.frombuffer(p, "<u4")) for p in packed]
                columns = [batch.column("doc_id").slice(start, len(texts)), pa.array(counts, pa.int64()),
                           pa.array([hashlib.sha256(p).hexdigest() for p in packed]),
                           pa.array([hashlib.sha256(d).hexdigest() for d in decoded])]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    ends = np.r_[0, np.cumsum(counts)].astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), "<i4"))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)
    return run


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids of every row of ``docs``.

    ``path`` names a rank file (by default the multilingual one of the installed public tokenizers), read on the
    driver and sent with the task; it must be below 16 MB."""
    import os

    import public_tokenizers

    path = path or public_tokenizers.path(VOCABULARY)
    if os.path.getsize(path) > 16 << 20:
        raise ValueError("rank file too large to send with each task")
    with open(path, "rb") as f:
        lines = f.read()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    return rows.mapInArrow(trimmed(_mapper(lines, pattern or public_tokenizers.PATTERN, with_ids)), schema)
