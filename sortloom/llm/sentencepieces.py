"""SentencePiece encoding and decoding of merge-type (BPE) vocabularies.

The encoder is a score-ordered agenda of adjacent symbol pairs. Every distinct stretch of text that
it encodes is checked, in Arrow batches, against the sentencepiece library; a difference is an error, so
no ids come from anything but the agenda.

Where a merge can happen is known beforehand: a merge makes a vocabulary piece, so two neighbouring
characters that stand next to each other in no piece are never merged, and a text falls apart at such
places into stretches that can be encoded each by itself. Stretches recur, so their ids are remembered
in a table of bounded size.

Defined results: null or empty text has no ids and decodes to the empty text; characters outside the
vocabulary become byte pieces (or the unknown piece, where the vocabulary has no bytes); repeated rows
give repeated rows; an empty table gives an empty table.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sortloom.llm.common import alone, table

MARK = "▁"
#: Texts over so many characters have an agenda of their own. A rank after all others.
LONG, NEVER = 36, np.int32(2**31 - 1)
#: How a table keeps ids.
PACKED = np.dtype(np.uint32)
#: Stretches in a worker's table before it becomes the older of two (together about 140 MB).
REMEMBERED = 300_000
SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, n_checked bigint"


def public_model() -> str:
    """Where the installed public vocabulary lies."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def packed(ids: list[int]) -> bytes:
    return np.array(ids, PACKED).tobytes()


class Encoder:
    """encode() gives a text's ids; `checked` counts stretches held against the library."""

    def __init__(self, model: str, remembered: int = REMEMBERED, check: bool = True):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model)
        lib = self.library
        n = lib.get_piece_size()
        self.ids, self.scores, self.bytes = {}, {}, {}
        for i in range(n):
            piece = lib.id_to_piece(i)
            if lib.is_byte(i):
                self.bytes[int(piece[3:-1], 16)] = i
            elif not (lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i)):
                # Inside, the mark of a word's start is the blank that it stands for.
                if " " in piece:
                    raise ValueError("a vocabulary with blanks isn't supported")
                piece = piece.replace(MARK, " ")
                self.ids[piece], self.scores[piece] = i, lib.get_score(i)
        self.unknown = lib.unk_id()
        self.touching = {a + b for p in self.ids for a, b in zip(p, p[1:], strict=False)}
        if any(" " in p.lstrip(" ") for p in self.ids):
            raise ValueError("a vocabulary whose pieces run over word starts isn't supported")
        together = {c for pair in self.touching for c in pair}
        alone = "".join(c for c in "\n\t\r|" if c not in together)
        #: What stands before a stretch without a blank when the library is asked, and its ids.
        self.before = alone[:1]
        self.before_ids = lib.encode(self.before) if alone else []
        x = re.escape(alone)
        self.stretches = re.compile(f" +[^ {x}]*|[^ {x}]+" + (f"|[{x}]" if alone else "")).findall
        self.decimals = [str(i) for i in range(n)]
        self._tables()
        self.remembered, self.check, self.known, self.older = remembered, check, {}, {}
        self.checked = 0

    def agenda(self, text: str) -> list[int]:
        """Merges the best-scored adjacent pair (leftmost of equals) until none is in the vocabulary."""
        scores = self.scores
        symbols = list(text)
        after = [*range(1, len(symbols)), -1]
        before = [*range(-1, len(symbols) - 1)]
        pairs = []
        for i in range(len(symbols) - 1):
            s = scores.get(symbols[i] + symbols[i + 1])
            if s is not None:
                pairs.append((-s, i, symbols[i] + symbols[i + 1], i + 1))
        heapq.heapify(pairs)
        while pairs:
            _, i, piece, j = heapq.heappop(pairs)
            if symbols[i] is None or symbols[j] is None or after[i] != j or symbols[i] + symbols[j] != piece:
                continue
            symbols[i], symbols[j] = piece, None
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                s = scores.get(piece + symbols[k])
                if s is not None:
                    heapq.heappush(pairs, (-s, i, piece + symbols[k], k))
            h = before[i]
            if h >= 0:
                s = scores.get(symbols[h] + piece)
                if s is not None:
                    heapq.heappush(pairs, (-s, h, symbols[h] + piece, i))
        out: list[int] = []
        for s in symbols:
            if s is None:
                continue
            i = self.ids.get(s)
            if i is not None:
                out.append(i)
            elif self.bytes:
                out += [self.bytes[b] for b in s.encode()]
            else:
                out.append(self.unknown)
        return out

    def apart(self, stretch: str) -> list[str]:
        """The stretch, split between neighbours that no piece holds."""
        touching, parts, start = self.touching, [], 0
        for i in range(1, len(stretch)):
            if stretch[i - 1 : i + 1] not in touching:
                parts.append(stretch[start:i])
                start = i
        return [*parts, stretch[start:]]

    def _tables(self) -> None:
        """For agendas(): symbols are numbered (pieces by id, then other characters of pieces), and every pair that makes a piece is listed."""
        number = dict(self.ids)
        for c in sorted({c for p in self.ids for c in p} - number.keys()):
            number[c] = len(self.decimals) + len(number) - len(self.ids)
        self.none = len(self.decimals) + len(number) - len(self.ids)  # pairs with nothing
        order = {x: r for r, x in enumerate(sorted({-x for x in self.scores.values()}))}
        made = sorted((number[p[:i]] * (self.none + 1) + number[p[i:]], order[-self.scores[p]], number[p]) for p in self.ids for i in range(1, len(p)) if p[:i] in number and p[i:] in number)
        self.keys, self.ranks, self.makes = (np.array(x, t) for x, t in zip(zip(*made, strict=True), (np.int64, np.int32, np.int32), strict=True))
        self.of_char = np.full(0x110000, self.none, np.int32)
        for c, i in number.items():
            if len(c) == 1:
                self.of_char[ord(c)] = i

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank of the piece that the two symbols make, or NEVER; its id)."""
        key = left.astype(np.int64) * (self.none + 1) + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NEVER), self.makes[at]

    def agendas(self, parts: list[str]) -> list[bytes]:
        """agenda() of many short texts at once, as packed ids: a row each, in every round each row merges its best-scored pair, the leftmost of equals."""
        length = np.fromiter(map(len, parts), np.int64, len(parts))
        width = int(length.max())
        symbol = np.full((len(parts), width + 2), self.none, np.int32)
        at = np.repeat(np.cumsum(length) - length, length)
        row = np.repeat(np.arange(len(parts)), length)
        symbol[row, np.arange(len(row)) - at + 1] = self.of_char[np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)]
        after = np.tile(np.minimum(np.arange(1, width + 3), width + 1), (len(parts), 1))
        before = np.tile(np.maximum(np.arange(-1, width + 1), 0), (len(parts), 1))
        rank, make = self._pairs(symbol[:, :-1], symbol[:, 1:])
        left = np.arange(len(parts))
        while len(left):
            best = rank[left].argmin(1)
            more = rank[left, best] < NEVER
            left, best = left[more], best[more]
            if not len(left):
                break
            gone = after[left, best]
            beyond, prior = after[left, gone], before[left, best]
            symbol[left, best], symbol[left, gone] = make[left, best], -1
            after[left, best], before[left, beyond] = beyond, best
            rank[left, gone.clip(max=width)] = NEVER
            rank[left, best], make[left, best] = self._pairs(symbol[left, best], symbol[left, beyond])
            got = self._pairs(symbol[left, prior], symbol[left, best])
            rank[left, prior], make[left, prior] = np.where(prior > 0, got[0], NEVER), got[1]
        inner = symbol[:, 1:-1]
        inner[np.arange(width) >= length[:, None]] = -1
        flat, ends = inner[inner >= 0].astype(PACKED).tobytes(), (np.cumsum((inner >= 0).sum(1)) * PACKED.itemsize).tolist()
        odd = (inner >= len(self.decimals)).any(1).tolist()
        return [packed(self.agenda(p)) if o else flat[s:e] for p, o, s, e in zip(parts, odd, [0, *ends], ends, strict=False)]

    def learn(self, stretches: set[str]) -> None:
        """Encodes stretches that aren't in the table and checks them, all at once, against the library."""
        known, older, new, split = self.known, self.older, {}, {}
        for s in stretches:
            if s in older:
                known[s] = older[s]
            else:
                split[s] = self.apart(s)
        by_length: dict[int, list[str]] = {}
        for p in {p for parts in split.values() for p in parts}:
            ids = known.get(p) or older.get(p)
            if ids is not None:
                new[p] = ids
            else:
                by_length.setdefault(0 if len(p) > LONG else -(-len(p) // 6), []).append(p)
        for k, parts in by_length.items():
            for i in range(0, len(parts), 8192):
                some = parts[i : i + 8192]
                new |= zip(some, self.agendas(some) if k else map(packed, map(self.agenda, some)), strict=True)
        for s, parts in split.items():
            if len(parts) > 1:
                known |= ((p, new[p]) for p in parts)
            known[s] = b"".join(map(new.__getitem__, parts))
        if self.check and split:
            # The library puts a mark before a text: what starts with one is given without it, anything else behind a character that merges with nothing.
            inner = {p for parts in by_length.values() for p in parts if p[0] == " "}
            marked = [s for s in split.keys() | inner if s[0] == " " and s != " "]
            self._held_against([known[s] if s in known else new[s] for s in marked], [s[1:] for s in marked], 0)
            other = [s for s in split if s[0] != " "]
            self._held_against([known[s] for s in other], [self.before + s for s in other], len(self.before_ids))

    def _held_against(self, own: list[bytes], asked: list[str], skip: int) -> None:
        """Fails unless the library's ids, but for the first `skip`, are the own ones."""
        answers = self.library.encode(asked, num_threads=1)
        self.checked += len(asked)
        if skip:
            answers = [x[skip:] for x in answers]
        if b"".join(own) != packed(list(chain.from_iterable(answers))) or list(map(len, own)) != [len(x) * PACKED.itemsize for x in answers]:
            wrong = next(s for s, mine, theirs in zip(asked, own, map(packed, answers), strict=True) if mine != theirs)
            raise ValueError(f"the agenda's ids differ from the library's for {wrong!r}")

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0][0]

    def encode_all(self, texts: list[str]) -> list[tuple[list[int], str]]:
        """(ids, the same as decimals joined by commas) of each text."""
        if len(self.known) > self.remembered:
            self.older, self.known = self.known, {}
        known, cut = self.known, [self.stretches(" " + t.replace(MARK, " ")) if t else [] for t in texts]
        if missing := {s for found in cut for s in found if s not in known}:
            self.learn(missing)
        spell, out = self.decimals.__getitem__, []
        for found in cut:
            ids = np.frombuffer(b"".join(map(known.__getitem__, found)), PACKED).tolist()
            out.append((ids, ",".join(map(spell, ids))))
        return out

    def forget(self) -> None:
        self.known, self.older = {}, {}


@cache
def encoder(model: str) -> Encoder:
    return Encoder(model)


def encode_documents(docs: DataFrame, model: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and, if asked for, ids) of each row's whole text."""
    model = model or public_model()
    sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model)
        alone("sentencepieces", enc.forget)
        gc.disable()  # the tables hold no cycles, and looking for some takes a seventh of the time
        try:
            yield from encoded(enc, batches)
        finally:
            gc.enable()

    def encoded(enc: Encoder, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = [t or "" for t in batch.column(1).to_pylist()]
                was = enc.checked
                got = enc.encode_all(texts)
                decoded = enc.library.decode([ids for ids, _ in got], num_threads=1)
                columns = [
                    batch.column(0),
                    pa.array([len(ids) for ids, _ in got], pa.int64()),
                    pa.array([sha(line) for _, line in got]),
                    pa.array([sha(t) for t in decoded]),
                    pa.array([enc.checked - was] + [0] * (len(got) - 1), pa.int64()),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_checked"]
                if with_ids:
                    columns, names = [*columns, pa.array([ids for ids, _ in got], pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text")).mapInArrow(run, SCHEMA + ", ids array<int>" * with_ids)


def decode_documents(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id and text of rows with doc_id and ids, by the library's decoder; null ids give the empty text."""
    model = model or public_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lib = encoder(model).library
        for batch in batches:
            texts = lib.decode([ids or [] for ids in batch.column(1).to_pylist()], num_threads=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, text string")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents")).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
