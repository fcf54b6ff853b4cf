"""Token counts without token lists: batches of equal bytes, long texts split where no token can lie across (operator 11)."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from rollcall.llm.words import by_bytes

#: Characters of a long text that are encoded at once, where a safe boundary comes soon enough.
PIECE = 1 << 14
#: Characters that go to the library in one call.
BATCH = 1 << 19


class Pieces:
    """Counts of a sentencepiece file. A text may be cut between two characters that no token holds side by side."""

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        self.processor = SentencePieceProcessor(model_proto=model)
        spec = sentencepiece_model_pb2.ModelProto()
        spec.ParseFromString(model)
        tokens = [p.piece for p in spec.pieces if p.type in (p.NORMAL, p.USER_DEFINED)]
        rules = spec.normalizer_spec
        # White space is squeezed or characters are rewritten over a cut, or unknown ones merge: such files take whole texts.
        self.cuttable = rules.name == "identity" and not rules.remove_extra_whitespaces and spec.trainer_spec.byte_fallback and not spec.trainer_spec.treat_whitespace_as_suffix
        self.beside = {token[k : k + 2] for token in tokens for k in range(len(token) - 1)}
        # A later part starts with a mark that no token holds, so what the library puts before a text does not touch the part.
        self.mark = "\n"
        self.cuttable &= not any(self.mark in token for token in tokens)
        self.mark_count = len(self.processor.encode(self.mark))

    def safe(self, left: str, right: str) -> bool:
        return left.replace(" ", "▁") + right.replace(" ", "▁") not in self.beside

    def parts(self, text: str) -> Iterator[tuple[str, int]]:
        """Parts of a text, each with the tokens that its mark adds."""
        first, extra = 0, 0
        while self.cuttable and len(text) - first > 2 * PIECE:
            cut = first + PIECE
            while cut < len(text) and not self.safe(text[cut - 1], text[cut]):
                cut += 1
            yield self.mark * bool(extra) + text[first:cut], extra
            first, extra = cut, self.mark_count
        if first < len(text) or not first:
            yield self.mark * bool(extra) + text[first:], extra

    def lengths(self, texts: list[str]) -> list[int]:
        return [len(ids) for ids in self.processor.encode(texts, num_threads=1)]


class Whole:
    """Counts of a tokenizers file, which may rewrite or split text over any distance: texts stay whole."""

    def __init__(self, model: bytes):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(model)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()

    def parts(self, text: str) -> Iterator[tuple[str, int]]:
        yield text, 0

    def lengths(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]


def count(counter: Pieces | Whole, texts: list[str | None]) -> np.ndarray:
    """Tokens of each text, in calls of about ``BATCH`` characters whatever the texts' own lengths."""
    totals = np.zeros(len(texts), np.int64)
    rows: list[int] = []
    waiting: list[str] = []
    size = 0

    def flush() -> None:
        np.add.at(totals, rows, np.array(counter.lengths(waiting), np.int64))

    for row, text in enumerate(texts):
        for part, extra in counter.parts(text or ""):
            totals[row] -= extra
            rows.append(row)
            waiting.append(part)
            size += len(part)
            if size >= BATCH:
                flush()
                rows, waiting, size = [], [], 0
    if waiting:
        flush()
    return totals


def _count_rows(batches: Iterator[pa.RecordBatch], model, kind: Callable[[bytes], Pieces | Whole], limit: int) -> Iterator[pa.RecordBatch]:
    counter = kind(model.value)
    gc.freeze()
    for batch in by_bytes(batches, "text"):
        tokens = count(counter, batch.column("text").to_pylist())
        sizes = pc.cast(pc.fill_null(pc.binary_length(batch.column("text")), 0), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), sizes, pa.array(tokens), pa.array(tokens > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"]
        )


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 4096) -> DataFrame:
    """Length in bytes and in tokens of every whole text: (doc_id, n_bytes, n_tokens, over_limit), a row per row of ``docs``.

    ``tokenizer`` is a sentencepiece ``.model`` or a tokenizers ``.json`` file; begin, end and added special tokens are
    left out, special strings inside texts are handled as the library does by itself. The file is read on the driver
    and broadcast: its size is the vocabulary's. Token ids never leave the library call, and nothing is shuffled.
    Long texts are split between characters that no token holds side by side, so counts of the parts add up exactly;
    a text without such a place, or with a file that rewrites text, is encoded whole.
    Null text counts as empty and has 0 bytes and 0 tokens; null ids pass through; repeated rows give repeated rows;
    an empty table gives no rows; other columns are not read.
    """
    with open(tokenizer, "rb") as file:
        model = docs.sparkSession.sparkContext.broadcast(file.read())
    kind = Pieces if tokenizer.endswith(".model") else Whole
    rows = docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text")
    return rows.mapInArrow(partial(_count_rows, model=model, kind=kind, limit=limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
