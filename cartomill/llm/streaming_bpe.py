"""Encoding with a byte-level BPE as a streaming transducer of bounded lookahead.

From the merge list follows how many bytes right of a token can still change it: its
sufficient lookahead. A long run of bytes is read through a window; tokens that end
more than the lookahead before the window's end are stable and are emitted, so memory
stays constant. Where no token of the vocabulary spans two neighbouring characters the
lookahead is zero and the run is cut at once. Repeated pieces come from a bounded memo.
Decoding feeds the tokens' bytes to an incremental UTF-8 decoder.

Scale: no shuffle; one pass over documents in Arrow batches. The driver broadcasts the
vocabulary, whose size is fixed (50,000 merges).
"""

from __future__ import annotations

import codecs
import json
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartomill import runtime

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Fixed value: the pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters read at once, bytes of a run encoded in one piece, entries of the memo, longest piece kept in it,
#: ids after which the texts encoded so far are sent on.
BLOCK, WINDOW, MEMO, MEMO_CHARS, FLUSH_IDS = 32_768, 192, 200_000, 48, 250_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 itself, others from U+0100."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Tables:
    """Vocabulary and merges of a byte-level BPE, with what follows from them."""

    def __init__(self, token_bytes: list[bytes], merges: list[tuple[int, int, int]]):
        self.token_bytes = token_bytes
        self.of_byte = [0] * 256
        for i, t in enumerate(token_bytes):
            if len(t) == 1:
                self.of_byte[t[0]] = i
        #: pair of ids -> (priority, new id), packed into integers
        self.merge = {(a << 20) | b: (rank << 20) | new for rank, (a, b, new) in enumerate(merges)}
        self.lookahead = sufficient_lookahead(token_bytes, merges)
        self.spanning = spanning_pairs(token_bytes)


def read_tables(path: str = VOCABULARY) -> Tables:
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    letters = byte_letters()
    vocab = model["vocab"]
    raw: list[bytes] = [b""] * (max(vocab.values()) + 1)
    for text, i in vocab.items():
        if all(ch in letters for ch in text):
            raw[i] = bytes(letters[ch] for ch in text)
    merges = []
    for m in model["merges"]:
        a, b = m if isinstance(m, list) else m.split(" ")
        merges.append((vocab[a], vocab[b], vocab[a + b]))
    special = {new for _, _, new in merges} | {i for i, t in enumerate(raw) if len(t) == 1}
    raw = [t if i in special else b"" for i, t in enumerate(raw)]
    return Tables(raw, merges)


def sufficient_lookahead(token_bytes: list[bytes], merges: list[tuple[int, int, int]]) -> int:
    """Bytes right of any token that can decide whether it stands.

    A token, or a part on its right edge before it is merged in, is lost to an earlier
    merge with a right neighbour; that neighbour must itself stand until then, which
    depends on merges earlier still. Going up the list, each merge's reach is its right
    part's length plus what that part needs; a part needs the most of the merges it
    begins so far and of those its own right edge could be lost to.
    """
    begins = [0] * len(token_bytes)  # most reach of merges so far whose left part is the token
    inner = [0] * len(token_bytes)  # what the right edge needed when the token was made
    most = 0
    for a, b, new in merges:
        reach = len(token_bytes[b]) + max(begins[b], inner[b])
        inner[new] = max(inner[new], begins[b], inner[b])
        begins[a] = max(begins[a], reach)
        most = max(most, reach)
    return most


def spanning_pairs(token_bytes: list[bytes]) -> frozenset[tuple[bytes, bytes]]:
    """Ends and beginnings of characters that some token holds side by side."""
    pairs = set()
    for t in token_bytes:
        starts = [i for i, b in enumerate(t) if b & 0xC0 != 0x80]
        for k, p in enumerate(starts):
            if p == 0:
                continue
            before = starts[k - 1] if k else 0
            after = starts[k + 1] if k + 1 < len(starts) else len(t)
            pairs.add((t[before:p], t[p:after]))
    return frozenset(pairs)


class Encoder:
    """Streaming encoder; one per Python worker."""

    def __init__(self, tables: Tables, window: int = WINDOW):
        import regex

        self.t = tables
        self.window = max(window, tables.lookahead + 1)
        self.split = regex.compile(PATTERN)
        self.memo: dict[str, tuple[int, ...]] = {}
        self.cuts: dict[tuple[str, str], bool] = {}

    def merged(self, data: bytes) -> list[int]:
        """All merges within data, in order of priority."""
        of, get = self.t.of_byte, self.t.merge.get
        ids = [of[b] for b in data]
        while len(ids) > 1:
            best, at = None, -1
            for i in range(len(ids) - 1):
                r = get((ids[i] << 20) | ids[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            new, a, b = best & 0xFFFFF, ids[at], ids[at + 1]
            out, i = ids[:at], at
            while i < len(ids):
                if ids[i] == a and i + 1 < len(ids) and ids[i + 1] == b:
                    out.append(new)
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids

    def stream(self, data: bytes) -> Iterator[int]:
        """Ids of a long run: emit what the lookahead makes stable, keep the rest."""
        size, ahead, start = self.window * 2, self.t.lookahead, 0
        lengths = self.t.token_bytes
        while start < len(data):
            ids = self.merged(data[start : start + size])
            if start + size >= len(data):
                yield from ids
                return
            limit, used = size - ahead, 0
            for i in ids:
                end = used + len(lengths[i])
                if end > limit:
                    break
                yield i
                used = end
            start += used
            if not used:  # a token wider than the window
                size *= 2

    def parts(self, piece: str) -> Iterator[str]:
        """Cut between characters that no token spans."""
        cuts, spanning, last = self.cuts, self.t.spanning, 0
        for i in range(1, len(piece)):
            pair = (piece[i - 1], piece[i])
            cut = cuts.get(pair)
            if cut is None:
                a, b = pair[0].encode(), pair[1].encode()
                cut = not any((a[-m:], b[:n]) in spanning for m in range(1, len(a) + 1) for n in range(1, len(b) + 1))
                if len(cuts) >= MEMO:
                    cuts.clear()
                cuts[pair] = cut
            if cut:
                yield piece[last:i]
                last = i
        yield piece[last:]

    def piece(self, piece: str) -> tuple[int, ...]:
        """Ids of one piece of the splitting pattern."""
        if len(piece) > 6 and not piece.isascii():
            out: list[int] = []
            memo = self.memo
            for part in self.parts(piece):
                ids = memo.get(part)
                if ids is None:
                    ids = self._run(part)
                    self._keep(part, ids)
                out.extend(ids)
            return tuple(out)
        return self._run(piece)

    def _run(self, text: str) -> tuple[int, ...]:
        data = text.encode("utf-8", "surrogatepass")
        return tuple(self.merged(data)) if len(data) <= self.window else tuple(self.stream(data))

    def _keep(self, text: str, ids: tuple[int, ...]) -> None:
        if len(text) <= MEMO_CHARS:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[text] = ids

    def pieces(self, text: str) -> Iterator[list[str]]:
        """Lists of pieces, block by block; pieces near a block's end wait for the next."""
        if len(text) <= BLOCK:
            yield self.split.findall(text)
            return
        start, size = 0, BLOCK
        while start < len(text):
            stop = start + size
            if stop >= len(text):
                yield self.split.findall(text[start:])
                return
            block, done, out = text[start:stop], 0, []
            for m in self.split.finditer(block):
                if m.end() > len(block) - 3:
                    break
                out.append(m.group())
                done = m.end()
            yield out
            start += done
            size = BLOCK if done else size * 2  # a piece longer than the block

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text; none for an empty or null one."""
        return self.encode_into([], text)

    def encode_into(self, out, text: str | None):
        """out with the ids of a text added, a list or an array; none for an empty or null text."""
        if not text:
            return out
        get, extend = self.memo.get, out.extend
        for block in self.pieces(text):
            for p in block:
                ids = get(p)
                if ids is None:
                    ids = self.piece(p)
                    self._keep(p, ids)
                extend(ids)
        return out


class Decoder:
    """Ids to text, piece by piece: bytes of a character may come in several tokens."""

    def __init__(self, tables: Tables):
        self.bytes = tables.token_bytes
        self.state = codecs.getincrementaldecoder("utf-8")(errors="replace")

    def feed(self, ids) -> str:
        return "".join(self.state.decode(self.bytes[i]) for i in ids)

    def finish(self) -> str:
        text = self.state.decode(b"", final=True)
        self.state.reset()
        return text


_ENCODER: dict[int, Encoder] = {}


def worker_encoder(shared) -> Encoder:
    """The process's encoder for broadcast tables, made once."""
    tables = shared.value
    if id(tables) not in _ENCODER:
        _ENCODER.clear()
        _ENCODER[id(tables)] = Encoder(tables)
    return _ENCODER[id(tables)]


def encode(df: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, ids array<int>) of every row; repeated rows stay, in any number.

    Empty and null texts have the empty list. No special tokens: their spellings in a
    text are ordinary text. Other columns are not read.
    """
    spark = df.sparkSession
    runtime.ship_package(spark)
    shared = spark.sparkContext.broadcast(read_tables(vocabulary))
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = worker_encoder(shared)
        for b in batches:
            offsets, flat, first = [0], array("i"), 0
            for row, x in enumerate(b.column(1), 1):
                enc.encode_into(flat, x.as_py())
                offsets.append(len(flat))
                # tokens are sent on in pieces of bounded size, whatever the batch holds
                if len(flat) >= FLUSH_IDS or row == len(b):
                    ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(flat, dtype=np.int32), pa.int32()))
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(first, row - first), ids], ["key", "ids"])
                    offsets, flat, first = [0], array("i"), row

    out = df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, ids array<int>")
    return out.withColumnRenamed("key", key)


def count_tokens(df: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, n_tokens) of every row; 0 for empty and null texts."""
    spark = df.sparkSession
    runtime.ship_package(spark)
    shared = spark.sparkContext.broadcast(read_tables(vocabulary))
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = worker_encoder(shared)
        for b in batches:
            n = [len(enc.encode(x.as_py())) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], ["key", "n_tokens"])

    out = df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, n_tokens bigint")
    return out.withColumnRenamed("key", key)


def decode(df: DataFrame, key: str, ids: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, text) from id lists; null lists give the empty text, as encode has none for them."""
    spark = df.sparkSession
    runtime.ship_package(spark)
    shared = spark.sparkContext.broadcast(read_tables(vocabulary))
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dec = Decoder(shared.value)
        for b in batches:
            texts = [dec.feed(x.as_py() or []) + dec.finish() for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["key", "text"])

    out = df.select(F.col(key).alias("key"), F.col(ids).alias("ids")).mapInArrow(run, f"key {kind}, text string")
    return out.withColumnRenamed("key", key)
