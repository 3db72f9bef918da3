"""Sequence packing by the dot-product heuristic of vector bin packing (Panigrahy et al., 2011).

A sequence is a bin with three limits at once: tokens, segments and loss-bearing tokens. The open bin takes, among the
pieces that fit, the one whose demand has the largest dot product with what is left in the bin, each dimension scaled by
its limit. Every task packs what it reads with a bounded pool of open pieces: no shuffle, and memory does not grow.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encoding import MEMO, encoder, release


@dataclass(frozen=True)
class Limits:
    """What a sequence may hold; each limit is 1 at least."""

    tokens: int = 1024
    segments: int = 128
    loss_tokens: int = 1024
    #: Pieces may be cut to fill a sequence, and a last sequence falls apart into lengths that are powers of two. Without,
    #: only a document that breaks a limit alone is cut, into pieces as long as the limits allow.
    cut: bool = True
    #: Leading tokens of a document that bear no loss, as nothing much stands before them.
    context: int = 0
    #: Pieces that wait at once in a task.
    pool: int = 1024

    def __post_init__(self):
        if min(self.tokens, self.segments, self.loss_tokens, self.pool) < 1 or self.context < 0:
            raise ValueError(f"limits must be positive: {self}")


@dataclass
class Piece:
    doc: int  # index into the packer's documents
    start: int
    length: int


class Packer:
    """Feed documents with ``add``, take finished placements from ``done``; ``finish`` packs what still waits."""

    def __init__(self, limits: Limits):
        self.limits = limits
        self.docs: dict[int, tuple] = {}  # number -> (doc_id, ids, prompt tokens)
        self.waiting: dict[int, int] = {}  # number -> pieces of it not placed yet
        self.done: list[tuple[int, Piece, int, int]] = []  # (number, piece, sequence, offset)
        self.sequences = 0
        self._next = 0
        n = limits.pool + 64
        self._pieces: list[Piece | None] = [None] * n
        self._need = np.zeros((n, 3))
        self._free = list(range(n))[::-1]
        self._scale = np.array([limits.tokens, limits.segments, limits.loss_tokens], float)
        self._bound = limits.loss_tokens < limits.tokens

    def _loss(self, doc: int, start: int, length: int) -> int:
        return max(0, start + length - max(start, self.docs[doc][2]))

    def _push(self, p: Piece) -> None:
        if not self._free:
            n = len(self._pieces)
            self._pieces += [None] * n
            self._need = np.vstack([self._need, np.zeros((n, 3))])
            self._free = list(range(n, 2 * n))[::-1]
        k = self._free.pop()
        self._pieces[k] = p
        self._need[k] = (p.length, 1, self._loss(p.doc, p.start, p.length))

    def _pop(self, k: int) -> Piece:
        p = self._pieces[k]
        self._pieces[k] = None
        self._need[k] = 0
        self._free.append(k)
        return p

    @property
    def pooled(self) -> int:
        return len(self._pieces) - len(self._free)

    def _longest(self, doc: int, start: int, tokens: int, loss: int) -> int:
        """Longest head of a document's rest that keeps both limits."""
        prompt = self.docs[doc][2]
        return min(tokens, max(0, prompt - start) + loss)

    def add(self, doc_id, ids: np.ndarray, prompt: int = 0) -> None:
        number = self._next
        self._next += 1
        self.docs[number] = (doc_id, ids, max(prompt, min(self.limits.context, len(ids))))
        self.waiting[number] = 0
        start, lim = 0, self.limits
        while (rest := len(ids) - start) > 0:  # longer than a sequence: fill whole ones first
            take = min(rest, self._longest(number, start, lim.tokens, lim.loss_tokens))
            self.waiting[number] += 1
            p = Piece(number, start, take)
            if take < rest and (take == lim.tokens or not lim.cut):
                self._place([p])
            else:  # what fills a sequence up may come from other documents
                self._push(p)
            start += take
        while self.pooled > lim.pool:
            self._fill()

    def _place(self, pieces: list[Piece]) -> None:
        at = 0
        for p in pieces:
            self.done.append((p.doc, p, self.sequences, at))
            at += p.length
        self.sequences += 1

    def _best(self, left: np.ndarray) -> int:
        score = self._need @ (left / self._scale**2)
        score[self._need[:, 0] > left[0]] = 0
        if self._bound:  # else no piece can break the loss limit alone: it has no more loss than tokens
            score[self._need[:, 2] > left[2]] = 0
        k = int(score.argmax())
        return k if score[k] > 0 else -1

    def _fill(self) -> None:
        """Fill and close one sequence."""
        left = self._scale.copy()
        chosen: list[Piece] = []
        while left[0] > 0 and left[1] > 0 and self.pooled:
            k = self._best(left)
            if k >= 0:
                left -= self._need[k]
                chosen.append(self._pop(k))
                continue
            if not self.limits.cut:
                break
            # no piece fits whole: the one with the longest head that fits (a piece's lossless tokens stand in front)
            head = np.minimum(np.minimum(self._need[:, 0], left[0]), self._need[:, 0] - self._need[:, 2] + left[2])
            k = int(np.argmax(np.where(self._need[:, 1] > 0, head, 0)))
            p = self._pieces[k]
            if p is None:
                break
            take = self._longest(p.doc, p.start, int(left[0]), int(left[2]))
            if take <= 0:
                break
            self._pop(k)
            head = Piece(p.doc, p.start, take)
            left -= (take, 1, self._loss(p.doc, p.start, take))
            chosen.append(head)
            self.waiting[p.doc] += 1
            self._push(Piece(p.doc, p.start + take, p.length - take))
        self._place(chosen)

    def finish(self) -> None:
        while self.pooled:
            total, pieces, loss = self._need.sum(0).astype(int)
            if self.limits.cut and total < self.limits.tokens and total & (total - 1) and pieces <= self.limits.segments and loss <= self.limits.loss_tokens:
                self._powers()
            else:
                self._fill()

    def _powers(self) -> None:
        """The last pieces, in order, as sequences whose lengths are powers of two: no padding."""
        pieces = [self._pop(k) for k in np.flatnonzero(self._need[:, 1]).tolist()]
        total = sum(p.length for p in pieces)
        while total:
            size = 1 << (total.bit_length() - 1)
            total -= size
            own: list[Piece] = []
            while size:
                p = pieces.pop(0)
                take = min(size, p.length)
                if take < p.length:
                    self.waiting[p.doc] += 1
                    pieces.insert(0, Piece(p.doc, p.start + take, p.length - take))
                own.append(Piece(p.doc, p.start, take))
                size -= take
            self._place(own)

    def take(self) -> list[tuple]:
        """Finished placements as (doc_id, start, length, ids, doc tokens, loss tokens, sequence, offset)."""
        out = []
        for number, p, sequence, at in self.done:
            doc_id, ids, _ = self.docs[number]
            out.append((doc_id, p.start, p.length, ids[p.start : p.start + p.length].tobytes(), len(ids), self._loss(number, p.start, p.length), sequence, at))
            self.waiting[number] -= 1
            if not self.waiting[number]:
                self.waiting.pop(number)
                self.docs.pop(number)
        self.done = []
        return out


_OUT = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("loss_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def pack(docs: DataFrame, vocabulary: str, end_id: int = 0, limits: Limits = Limits(), text: str = "text", prompt: str | None = None, remember: int = MEMO) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, loss_tokens, sequence_id, offset``.

    A document is its text's ids and ``end_id`` behind them (null text: only that). ``prompt`` names an optional text
    column whose tokens stand in front and bear no loss. Every id lies in one piece, pieces of a sequence are gapless from
    offset 0, and each sequence keeps all limits. Ties and repeated rows are documents of their own; a null doc_id stays
    null; an empty table gives no rows. Sequence ids are unique, not dense: the task's number stands in the high bits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, remember)
        packer = Packer(limits)
        base = TaskContext.get().partitionId() << 40
        end = np.array([end_id], "<u4")

        def out():
            rows = packer.take()
            for k in range(0, len(rows), 4096):
                columns = list(zip(*rows[k : k + 4096]))
                columns[6] = [base + s for s in columns[6]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _OUT)], schema=_OUT)

        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                heads = encode.ids_of(part.column(2).to_pylist()) if prompt else None
                for k, (doc_id, ids) in enumerate(zip(part.column(0).to_pylist(), encode.ids_of(part.column(1).to_pylist()))):
                    head = heads[k] if heads else ids[:0]
                    packer.add(doc_id, np.concatenate([head, ids, end]), len(head))
                yield from out()
        packer.finish()
        yield from out()
        release()

    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")] + ([F.col(prompt).alias("prompt")] if prompt else [])
    return docs.select(*columns).mapInArrow(run, "doc_id long, start long, length long, ids binary, doc_tokens long, loss_tokens long, sequence_id long, offset long")
