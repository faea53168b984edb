"""BPE encoding and decoding as streaming transducers with bounded lookahead.

The encoder reads a text in windows and emits a token once no later text can change it; the decoder
turns ids into text with a byte-to-text state machine that holds at most three pending bytes.  Both
keep constant memory whatever the text's length: what waits is a window, or of a pre-token longer
than that (a run of letters, digits, signs or white space) the bytes the merge list's lookahead needs.

Three facts make emission safe.  A pre-token stands once two characters follow it in what has been read
(a contraction takes two after its apostrophe, a run of white space one).  Inside a pre-token longer
than a window, merges run in rank order, so what follows a cut reaches back only through a chain of
merges of rising rank: :func:`sufficient_lookahead` bounds the chain's length for the given merge
list, and tokens that end that far before the cut are final.  A control string ends the text before
it, and as many last characters as may begin one are held back.
"""

from __future__ import annotations

import heapq
import re
import struct
import sys
import unicodedata
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.common import whole_text
from driftline.llm.vocabulary import Vocabulary, library, load

SCHEMA = "doc_id long, n_tokens long, ids binary, decoded string"
#: Characters an encoder reads at a time.
WINDOW = 1 << 10
#: Bytes of a pre-token longer than a window that are merged at a time, besides the lookahead.
STRETCH = 1 << 13
#: Bytes of a pre-token up to which its pairs are searched rather than kept in a heap.
SHORT = 64


def sufficient_lookahead(vocabulary: Vocabulary) -> int:
    """Bytes after a token's end that decide whether it is final.

    Let two texts agree up to a cut.  A merge (u, v) can differ between them left of the cut only if
    its v starts where the difference starts so far; the difference then starts len(u) further left,
    and the token there begins with u.  So the reach of (u, v) is len(u) plus the longest reach of an
    earlier merge whose left part is a prefix of v.
    """
    by_left: dict[bytes, int] = {}
    reach = 0
    for a, b in vocabulary.merges:
        left, right = vocabulary.bytes[a], vocabulary.bytes[b]
        far = len(left) + max((by_left.get(right[:k], 0) for k in range(1, len(right) + 1)), default=0)
        by_left[left] = max(far, by_left.get(left, 0))
        reach = max(reach, far)
    return reach


def merged(vocabulary: Vocabulary, piece: bytes) -> list[int]:
    """Ids of a pre-token: the pair of lowest rank merges first, the leftmost of equals.

    In a long one neighbours are linked and pairs lie in a heap; a pair whose ends changed meanwhile is passed over.
    """
    ids = [vocabulary.byte_ids[b] for b in piece]
    if len(ids) <= SHORT:
        return _merged_short(vocabulary, ids)
    merges, n = vocabulary.merges, len(ids)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(merges[pair], k, pair) for k, pair in enumerate(zip(ids, ids[1:])) if pair in merges]
    heapq.heapify(heap)
    while heap:
        (_, made), k, (a, b) = heapq.heappop(heap)
        nxt = after[k]
        if ids[k] != a or nxt >= n or ids[nxt] != b:
            continue
        ids[k], ids[nxt] = made, -1
        after[k] = far = after[nxt]
        if far < n:
            before[far] = k
            if (pair := (made, ids[far])) in merges:
                heapq.heappush(heap, (merges[pair], k, pair))
        if (last := before[k]) >= 0 and (pair := (ids[last], made)) in merges:
            heapq.heappush(heap, (merges[pair], last, pair))
    return [i for i in ids if i >= 0]


def _merged_short(vocabulary: Vocabulary, ids: list[int]) -> list[int]:
    """The same over a short list, in which the lowest rank is searched anew each time."""
    rank, made_by, none = vocabulary.ranks.get, vocabulary.made, len(vocabulary.made)
    ranks = [rank(a << 32 | b, none) for a, b in zip(ids, ids[1:])]
    while ranks and (least := min(ranks)) < none:
        k = ranks.index(least)
        made = ids[k] = made_by[least]
        del ids[k + 1], ranks[k]
        if k < len(ranks):
            ranks[k] = rank(made << 32 | ids[k + 1], none)
        if k:
            ranks[k - 1] = rank(ids[k - 1] << 32 | made, none)
    return ids


class _Pieces(dict):
    """Packed ids of pre-tokens seen; emptied when it has grown to ``most`` entries."""

    def __init__(self, vocabulary: Vocabulary, most: int = 1 << 18):
        super().__init__()
        self.vocabulary, self.most = vocabulary, most

    def __missing__(self, piece: str) -> bytes:
        ids = merged(self.vocabulary, piece.encode())
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(self) >= self.most:
            self.clear()
        if len(piece) <= 64:
            self[piece] = packed
        return packed


@lru_cache(maxsize=1)
def _unassigned() -> np.ndarray:
    """Whether this Python's Unicode tables know a code point; libraries of other ages may class the others differently."""
    return np.array([unicodedata.category(chr(c)) == "Cn" for c in range(sys.maxunicode + 1)])


class Splitter:
    """Pre-tokens of a text, as the tokenizers library cuts them."""

    def __init__(self, path: str):
        import public_tokenizers
        import regex

        pattern = public_tokenizers.PATTERN
        self.any = regex.compile(pattern).findall
        self.ascii = re.compile(pattern.replace(r"\s\p{L}\p{N}", r"\sA-Za-z0-9").replace(r"\p{L}", "[A-Za-z]").replace(r"\p{N}", "[0-9]"), re.ASCII).findall
        self.library = library(path).pre_tokenizer
        self.run = regex.compile(r"\s*").match

    def __call__(self, text: str) -> list[str]:
        if text.isascii():
            return self.ascii(text)
        if _unassigned()[np.frombuffer(text.encode("utf-32-le"), dtype="<u4")].any():
            return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]
        return self.any(text)


class Encoder:
    """Text in, ids out: ``feed`` as often as needed, then ``close``."""

    def __init__(self, path: str, window: int = WINDOW):
        self.vocabulary = load(path)
        self.split = Splitter(path)
        self.pieces = _Pieces(self.vocabulary)
        self.size = [len(b) for b in self.vocabulary.bytes]
        self.reach = sufficient_lookahead(self.vocabulary)
        self.stretch = max(STRETCH if window >= WINDOW else window, 1) + self.reach
        self.special = self.vocabulary.special
        self.window = max(16, window)  # longer than a contraction, so a piece that fills it is a run of one kind
        self.waiting = ""
        self.inside = None  # the unmerged bytes of a pre-token that is longer than a window
        self.kind = ""

    def merge_piece(self, piece: bytes) -> list[int]:
        return merged(self.vocabulary, piece)

    def feed(self, text: str) -> list[int]:
        return np.frombuffer(self.feed_packed(text), dtype="<u4").tolist()

    def close(self) -> list[int]:
        return np.frombuffer(self.close_packed(), dtype="<u4").tolist()

    def feed_packed(self, text: str) -> bytes:
        """As ``feed``; ids as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        for k in range(0, len(text), self.window):
            self.waiting += text[k : k + self.window]
            self._controls(out)
            held = self._begun()
            usable = self.waiting[: len(self.waiting) - held]
            if len(usable) >= self.window:
                self.waiting = self._read(usable, out) + self.waiting[len(usable) :]
        return b"".join(out)

    def close_packed(self) -> bytes:
        out: list[bytes] = []
        self._controls(out)
        text, self.waiting = self.waiting, ""
        self._end(text, out)
        return b"".join(out)

    def _controls(self, out: list[bytes]) -> None:
        """Read up to and with every control string that has arrived whole."""
        while found := [(at, -len(s), s) for s in self.special if (at := self.waiting.find(s)) >= 0]:
            at, _, s = min(found)
            self._end(self.waiting[:at], out)
            out.append(np.array([self.special[s]], dtype="<u4").tobytes())
            self.waiting = self.waiting[at + len(s) :]

    def _begun(self) -> int:
        """How many last characters may begin a control string."""
        return max((k for s in self.special for k in range(1, min(len(s), len(self.waiting) + 1)) if s.startswith(self.waiting[-k:])), default=0)

    def _read(self, text: str, out: list[bytes]) -> str:
        """Emit what is stable whatever follows ``text``; returns what must wait."""
        while len(text) >= self.window:
            if self.inside is not None:
                text = self._continue(text, out, False)
                continue
            pieces = self.split(text)
            held = 0
            while pieces and held < 2:
                held += len(pieces.pop())
            if pieces:
                out.append(b"".join(map(self.pieces.__getitem__, pieces)))
                return text[len(text) - held :]
            first = self.split(text)[0]
            if self.split.run(first).end() == len(first):
                self.kind = " "
                keep = len(first) - 1  # a run of white space leaves its last character to a word after it
            else:
                self.kind = next(c for c in "x1!" if len(self.split(c + first[-1])) == 1)
                keep = len(first)
            self.inside = first[:keep].encode()
            text = text[keep:]
        if self.inside is not None:
            text = self._continue(text, out, False)
        return text

    def _continue(self, text: str, out: list[bytes], final: bool) -> str:
        """Read what still belongs to the long pre-token; returns the text after it, or what must wait."""
        if self.kind == " ":
            run = self.split.run(text).end()
            goes_on = run == len(text)
            n = run if goes_on and final else max(0, run - 1)
        else:
            n = len(self.split(self.kind + text)[0]) - 1
            goes_on = n == len(text)
        for k in range(0, n, self.window):
            self.inside += text[k : min(n, k + self.window)].encode()
            if len(self.inside) >= self.stretch:
                self._drain(out)
        if final or not goes_on:
            out.append(np.array(self.merge_piece(self.inside), dtype="<u4").tobytes())
            self.inside = None
        return text[n:]

    def _end(self, text: str, out: list[bytes]) -> None:
        """Read the rest of a text that ends here."""
        if self.inside is not None:
            text = self._continue(text, out, True)
        out.append(b"".join(map(self.pieces.__getitem__, self.split(text))))

    def _drain(self, out: list[bytes]) -> None:
        """Emit the tokens of a long piece that end ``reach`` bytes before what has been read of it."""
        left = len(self.inside) - self.reach
        used, ids = 0, []
        for i in self.merge_piece(self.inside):
            if used + self.size[i] > left:
                break
            used += self.size[i]
            ids.append(i)
        out.append(np.array(ids, dtype="<u4").tobytes())
        self.inside = self.inside[used:]


class Decoder:
    """Ids in, text out.  States: the bytes of an unfinished character, three at most."""

    def __init__(self, path: str):
        self.token = load(path).bytes
        self.pending = b""

    def feed(self, ids) -> str:
        token = self.token
        data = self.pending + b"".join([token[i] for i in (ids.tolist() if isinstance(ids, np.ndarray) else ids)])
        keep = self._unfinished(data)
        self.pending = data[len(data) - keep :]
        return data[: len(data) - keep].decode("utf-8", "replace")

    def close(self) -> str:
        data, self.pending = self.pending, b""
        return data.decode("utf-8", "replace")

    @staticmethod
    def _unfinished(data: bytes) -> int:
        """How many last bytes begin a character that more bytes could complete."""
        for k in range(1, min(3, len(data)) + 1):
            b = data[-k]
            if b < 0x80:
                return 0
            if b >= 0xC0:
                need = 2 if b < 0xE0 else 3 if b < 0xF0 else 4
                return k if b < 0xF5 and k < need else 0
        return 0


@lru_cache(maxsize=2)
def _worker(path: str) -> tuple[Encoder, Decoder]:
    return Encoder(path), Decoder(path)


def encode_packed(path: str, text: str) -> bytes:
    """All ids of a text as little-endian unsigned 32-bit integers.  A control string of the file keeps its own id, as in the tokenizers library."""
    encoder = _worker(path)[0]
    return encoder.feed_packed(text) + encoder.close_packed()


def encode_text(path: str, text: str) -> list[int]:
    return np.frombuffer(encode_packed(path, text), dtype="<u4").tolist()


def decode_ids(path: str, ids, step: int = 1 << 16) -> str:
    decoder = _worker(path)[1]
    parts = [decoder.feed(ids[k : k + step]) for k in range(0, len(ids), step)]
    return "".join(parts) + decoder.close()


def round_trip(docs: DataFrame, tokenizer: str, flush: int = 1 << 23) -> DataFrame:
    """Encode and decode every text of ``docs(doc_id, text, ...)``.

    Returns doc_id, n_tokens, ids (little-endian unsigned 32-bit) and decoded.  A null text counts as
    empty and gives no ids; a text may be of any length and hold runs of any length; rows with a null or repeated doc_id are
    treated one by one; an empty table gives an empty table.  Other columns are not read.  There is
    no shuffle: rows stay in the partition they are read in.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))

    def run(batches):
        import pyarrow as pa

        def table(cols):
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "n_tokens", "ids", "decoded"])

        for batch in batches:
            cols: list[list] = [[], [], [], []]
            held = 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = encode_packed(tokenizer, text.as_py())
                ids = np.frombuffer(data, dtype="<u4")
                for col, value in zip(cols, (doc, len(ids), data, decode_ids(tokenizer, ids))):
                    col.append(value)
                held += len(data)
                if held > flush:
                    yield table(cols)
                    cols, held = [[], [], [], []], 0
            yield table(cols)

    return rows.mapInArrow(run, SCHEMA)
