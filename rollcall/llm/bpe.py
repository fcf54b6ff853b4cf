"""BPE encoding and decoding with chunks that documents share (operator 2)."""

from __future__ import annotations

import gc
import hashlib
import json
import re
from collections.abc import Iterator
from functools import cached_property, partial
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rollcall.llm.words import by_bytes, hand_back, hash_windows

# Fixed value: how byte-level vocabularies of this family cut text before merging.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Rolling-hash chunks: window, average, smallest and largest length in bytes.
WINDOW, AVERAGE, SMALLEST, LARGEST = 32, 2048, 512, 16384
#: Bytes of chunk text whose encodings a task keeps before it starts anew.
CACHE_BYTES = 24 << 20
#: A stretch without white space of this many bytes goes to the tokenizers library, which merges long runs faster.
LONG_RUN = 2048
#: Tokens at each end of a chunk in which joins may start; a join that needs more encodes its document in one go.
REACH = 16
#: A visible ASCII character before a space or line end.
EDGE = re.compile(rb"[!-~](?=[ \n])")

WHITE = np.zeros(256, bool)
WHITE[[32, 9, 10, 11, 12, 13]] = True


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies: printable bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Codec:
    """Encoder and decoder of one byte-level BPE vocabulary, given as the text of its tokenizer file."""

    def __init__(self, tokenizer_json: str):
        import tiktoken

        spec, alphabet = json.loads(tokenizer_json), byte_alphabet()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocabulary = {bytes(alphabet[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.special}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        if any(spec["model"]["vocab"][a + b] != 256 + i for i, (a, b) in enumerate(pairs)):
            raise ValueError("token ids must follow the order of the merges")
        self.fast = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=vocabulary, special_tokens=self.special)
        self.tokenizer_json = tokenizer_json
        size = max([*vocabulary.values(), *self.special.values()]) + 1
        self.bytes_of = [b""] * size
        for token, i in vocabulary.items():
            self.bytes_of[i] = token
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.length_of = [len(b) for b in self.bytes_of]
        self.digits_of = [str(i) for i in range(size)]
        self.kept: dict[bytes, Chunk] = {}
        self.joins: dict[bytes, np.ndarray] = {}
        self.kept_bytes = 0
        self.n_encoded = self.n_reused = 0

    @cached_property
    def whole(self):
        """The tokenizers library's own encoder, made when a text needs it."""
        from tokenizers import Tokenizer

        whole = Tokenizer.from_str(self.tokenizer_json)
        whole.no_padding()
        whole.no_truncation()
        return whole

    def plain(self, text: str) -> np.ndarray:
        """Ids of a text encoded in one go."""
        if len(text) > LONG_RUN and longest_run(text.encode()) > LONG_RUN:
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.fast.encode_to_numpy(text, allowed_special="all")

    def chunk(self, piece: bytes) -> Chunk:
        found = self.kept.get(piece)
        if found is None:
            self.n_encoded += 1
            if self.kept_bytes > CACHE_BYTES:
                self.kept, self.joins, self.kept_bytes = {}, {}, 0
            found = self.kept[piece] = Chunk(self, piece)
            self.kept_bytes += len(piece)
        else:
            self.n_reused += 1
        return found

    def join(self, piece: bytes) -> np.ndarray:
        found = self.joins.get(piece)
        if found is None:
            found = self.joins[piece] = self.plain(piece.decode())
        return found

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text from the encodings of its chunks, equal to encoding it in one go."""
        raw = text.encode()
        pieces = cut_chunks(raw)
        if len(pieces) < 2:
            return self.plain(text)
        ids: list[np.ndarray] = []
        left, bridge = self.chunk(pieces[0]), b""
        done = 0  # tokens of ``left`` that are already in ids
        for piece in pieces[1:]:
            right = self.chunk(piece)
            if len(right.packed_edges) < 2:  # no room for a join inside: it becomes part of the join
                bridge += piece
                continue
            joined = self.repair(left, done, bridge, right)
            if joined is None:
                return self.plain(text)
            keep, middle, skip = joined
            ids += [left.ids[done:keep], middle]
            left, done, bridge = right, skip, b""
        if bridge:
            joined = self.repair(left, done, bridge, None)
            if joined is None:
                return self.plain(text)
            return np.concatenate([*ids, left.ids[done : joined[0]], joined[1]])
        return np.concatenate([*ids, left.ids[done:]])

    def repair(self, left: Chunk, done: int, bridge: bytes, right: Chunk | None) -> tuple[int, np.ndarray, int] | None:
        """Re-encodes the text around a join, wider each time, until it gives the tokens that both sides hold at its ends.

        Returns how many tokens of the left chunk stay, the tokens between, and how many of the right chunk are replaced.
        None: the sides hold no place where they agree.
        """
        reach = 1
        edges = [e for e in left.edges if e[1] >= done]
        heads = [] if right is None else right.edges
        while reach < len(edges) and (right is None or reach < len(heads)):
            (from_byte, from_token), (_, to_token) = edges[-1 - reach], edges[-1]
            before = left.ids[from_token:to_token]
            head, after, skip = b"", left.ids[:0], 0
            if right is not None:
                (_, skip), (head_byte, head_token) = heads[0], heads[reach]
                head, after = right.piece[:head_byte], right.ids[skip:head_token]
            ids = self.join(left.piece[from_byte:] + bridge + head)
            if np.array_equal(ids[: len(before)], before) and np.array_equal(ids[len(ids) - len(after) :], after):
                return to_token, ids[len(before) : len(ids) - len(after)], skip
            reach *= 2
        return None

    def decode(self, ids: list[int]) -> str:
        return b"".join([self.bytes_of[i] for i in ids]).decode("utf-8", errors="replace")


class Chunk:
    """A chunk's ids and its edges (byte, token): between a visible ASCII character and a space or line end no token can lie across, whatever surrounds the chunk."""

    def __init__(self, codec: Codec, piece: bytes):
        self.piece, self.ids = piece, codec.plain(piece.decode())
        ids, sizes = self.ids, codec.length_of
        near = REACH if len(ids) > 2 * REACH else len(ids)  # joins start close to the ends
        ends = {at: k for k, at in enumerate(accumulate([sizes[i] for i in ids[:near].tolist()]), 1)}
        edges = [m.end() for m in EDGE.finditer(piece, 0, max(ends, default=0) + 1)]
        if near < len(ids):
            back = list(accumulate([sizes[i] for i in ids[: -near - 1 : -1].tolist()]))
            ends |= {len(piece) - at: len(ids) - k for k, at in enumerate(back, 1)}
            at_tail = len(piece) - back[-1]
            edges += [m.end() for m in EDGE.finditer(piece, at_tail, len(piece))]
        self.packed_edges = np.array([(at, ends[at]) for at in edges if at in ends], np.int32).reshape(-1, 2)

    @property
    def edges(self) -> list[list[int]]:
        """Kept as one small array: as tuples they would take more memory than the text."""
        return self.packed_edges.tolist()


def longest_run(raw: bytes) -> int:
    """Longest stretch of either only white space or none."""
    space = WHITE[np.frombuffer(raw, np.uint8)]
    turns = np.flatnonzero(space[1:] != space[:-1]) + 1
    return int(np.diff(np.concatenate(([0], turns, [space.size]))).max())


def cut_chunks(raw: bytes) -> list[bytes]:
    """Cuts where the hash of the last ``WINDOW`` bytes says so, at code points, within the length bounds."""
    if len(raw) < 2 * AVERAGE:
        return [raw]
    cuts, last = [0], 0
    for at in (np.flatnonzero(hash_windows(raw, WINDOW) % np.uint64(AVERAGE) == 0) + WINDOW).tolist() + [len(raw)]:
        while at - last > LARGEST:
            last = code_point(raw, last + LARGEST)
            cuts.append(last)
        if at - last >= SMALLEST and at < len(raw):
            last = code_point(raw, at)
            cuts.append(last)
    return [raw[a:b] for a, b in zip(cuts, [*cuts[1:], len(raw)], strict=True) if b > a]


def code_point(raw: bytes, at: int) -> int:
    while at < len(raw) and raw[at] & 0xC0 == 0x80:
        at += 1
    return at


def _encode_rows(batches: Iterator[pa.RecordBatch], spec, with_ids: bool) -> Iterator[pa.RecordBatch]:
    codec = Codec(spec.value)
    gc.freeze()  # the vocabulary stays; no need to look through it again and again
    for batch in by_bytes(batches, "text"):
        texts = batch.column("text").to_pylist()
        counts, digests, decoded, lists = [], [], [], []
        for text in texts:
            ids = codec.encode(text or "").tolist()
            counts.append(len(ids))
            digests.append(hashlib.sha256(",".join([codec.digits_of[i] for i in ids]).encode()).hexdigest())
            decoded.append(hashlib.sha256(codec.decode(ids).encode()).hexdigest())
            if with_ids:
                lists.append(np.array(ids, np.int32))
        columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if with_ids:
            offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
            columns.append(pa.ListArray.from_arrays(offsets, np.concatenate([np.zeros(0, np.int32), *lists])))
            names.append("ids")
        yield pa.RecordBatch.from_arrays(columns, names)
    del codec
    hand_back()


def encode(docs: DataFrame, tokenizer: str, with_ids: bool = True) -> DataFrame:
    """Encodes every whole text with the tokenizer file at ``tokenizer`` and decodes it again.

    Returns (doc_id, n_tokens, ids_sha256, decoded_sha256[, ids array<int>]), a row per row of ``docs``. Texts are cut
    into rolling-hash chunks; a task encodes a chunk once however many of its documents share it (``CACHE_BYTES`` of
    text are kept), then repairs the joins. Added tokens of the file are found in texts as the file says. The file is
    read on the driver and broadcast: its size is the vocabulary's, not the data's.
    Null text counts as empty and gives no tokens; null ids pass through; repeated rows give repeated rows; an empty
    table gives no rows; other columns are not read. Nothing is shuffled.
    """
    with open(tokenizer, encoding="utf-8") as file:
        spec = docs.sparkSession.sparkContext.broadcast(file.read())
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text").mapInArrow(partial(_encode_rows, spec=spec, with_ids=with_ids), schema)
