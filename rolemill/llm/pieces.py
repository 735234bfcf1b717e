"""SentencePiece encoding and decoding by a streaming Viterbi search.

For a merge model every prefix of a text has one best path, and its last piece is the
only piece that may follow the path it starts from: two pieces may stand side by side if
merging their text gives the same two again.  So the search keeps one survivor per
boundary, with a pointer back to the boundary where its last piece starts.  No piece is
longer than the window, so only boundaries inside it can still be extended; as soon as
all of their back-pointer paths run through one boundary, the ids up to it are final and
leave the window.  In a short run, which is at hand as a whole, survivors are worked out
from its end, only for the boundaries that a path asks for.

A boundary that no piece of the vocabulary can span, before a space that follows another
character, is such a point by itself.  The runs between them repeat a lot and are encoded
once per task.  Characters outside the vocabulary become byte pieces.
"""

from __future__ import annotations

import re
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

SPACE = "▁"
KNOWN_RUNS = 600_000  # runs a task remembers
SHORT = 40  # longer runs are not remembered
COMMIT_EVERY = 256


class PieceModel:
    """Pieces, ranks and byte ids of a merge model file (identity normalization, space put in front)."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        if model.normalize("A  éﬁ") != f"{SPACE}A{SPACE}{SPACE}éﬁ":
            raise ValueError("only models that keep text as it is are supported")
        self.size = model.get_piece_size()
        self.bytes: dict[int, int] = {}
        self.ids: dict[str, int] = {}
        self.raw: list[bytes] = []
        scores = {}
        for i in range(self.size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(piece[1:-1], 16)] = i
                self.raw.append(bytes([int(piece[1:-1], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.raw.append(b"")
            else:
                text = piece.replace(SPACE, " ")
                self.ids[text] = i
                scores[text] = model.get_score(i)
                self.raw.append(text.encode("utf-8"))
        if len(self.bytes) != 256:
            raise ValueError("only models with byte pieces are supported")
        self.longest = max(map(len, self.ids))
        self.splits = not any(" " in p.lstrip(" ") for p in self.ids)
        longer = sorted((p for p in self.ids if len(p) > 1), key=lambda p: (-scores[p], self.ids[p]))
        #: Merges happen in this order; single characters need none.
        self.rank = {p: n + 1 for n, p in enumerate(longer)} | {p: 0 for p in self.ids if len(p) == 1}
        self.halves: dict[str, tuple[str, str]] = {}
        for p in longer:
            parts = self.merge(list(p), upto=self.rank[p])
            if len(parts) == 2 and parts[0] in self.ids and parts[1] in self.ids:
                self.halves[p] = (parts[0], parts[1])
        #: Pieces that merging can make at all.
        self.made = {p: self.ids[p] for p in self.ids if len(p) == 1 or p in self.halves}
        #: Length of the longest such piece that ends with these three characters.
        self.reach: dict[str, int] = {}
        for p in self.made:
            if len(p) > 2:
                self.reach[p[-3:]] = max(len(p), self.reach.get(p[-3:], 0))
        self._beside: dict[tuple[str, str], bool] = {}

    def merge(self, parts: list[str], upto: int | None = None) -> list[str]:
        """Merge the pair of smallest rank (leftmost first) below ``upto`` until none is left."""
        while True:
            best, at = upto if upto is not None else 1 << 30, -1
            for i in range(len(parts) - 1):
                r = self.rank.get(parts[i] + parts[i + 1], 1 << 30)
                if r < best:
                    best, at = r, i
            if at < 0:
                return parts
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def beside(self, left: str, right: str) -> bool:
        """Whether merging the joined text of two pieces gives the two pieces again.

        Undo the merges of both from the latest on; a merge across the border that
        would come before the ones still standing breaks the pair.
        """
        key = (left, right)
        known = self._beside.get(key)
        if known is None:
            known = self._check(left, right)
            if len(self._beside) < 2_000_000:
                self._beside[key] = known
        return known

    def _check(self, left: str, right: str) -> bool:
        rank, halves = self.rank, self.halves
        before = 1 << 30  # merges across the border count if they come before this one
        while True:
            across = rank.get(left + right)
            if across is not None and across < before:
                return False
            a, b = rank.get(left, 0), rank.get(right, 0)
            if a == 0 and b == 0:
                return True
            if a > b:  # the left piece was made later: step back to its right half
                before, left = a, halves[left][1]
            else:  # at equal rank the left one is merged first, so a merge across at that rank loses
                before, right = b + 1, halves[right][0]


def extend_paths(model: PieceModel, text: str, last: list[str], before: str | None) -> None:
    """Add the last piece of the best path to every boundary of ``text`` that ``last`` does not reach yet."""
    made, longest, beside, known = model.made, model.longest, model.beside, model._beside.get
    for end in range(len(last), len(text) + 1):
        for start in range(end - longest if end > longest else 0, end):
            piece = text[start:end]
            if piece in made:
                left = last[start] if start else before
                if left is None or left not in made:
                    last.append(piece)
                    break
                fits = known((left, piece))
                if beside(left, piece) if fits is None else fits:
                    last.append(piece)
                    break
            elif end - start == 1:
                last.append(piece)  # outside the vocabulary: its bytes


def survivor(model: PieceModel, text: str, end: int, last: list[str | None]) -> str:
    """Last piece of the best path to ``end`` of a short text; boundaries no path asks for stay open in ``last``."""
    made, known = model.made, model._beside.get
    longest = model.reach.get(text[end - 3:end], 2) if end > 2 else end
    for start in range(end - longest if end > longest else 0, end):
        piece = text[start:end]
        if piece in made:
            if not start:
                break
            left = last[start] or survivor(model, text, start, last)
            if left not in made:
                break
            fits = known((left, piece))
            if model.beside(left, piece) if fits is None else fits:
                break
        elif end - start == 1 and start and not last[start]:
            survivor(model, text, start, last)  # the piece is outside the vocabulary: its bytes
    last[end] = piece
    return piece


def path_ids(model: PieceModel, last: list[str], end: int) -> list[int]:
    """Ids along the back pointers from a boundary to the start."""
    made, out = model.made, []
    while end:
        piece = last[end]
        known = made.get(piece)
        if known is None:
            out.extend(model.bytes[b] for b in reversed(piece.encode("utf-8", "replace")))
        else:
            out.append(known)
        end -= len(piece)
    out.reverse()
    return out


class StreamingEncoder:
    """Ids of a text that comes in parts; holds no more than a bounded window of undecided text."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.text = " "  # undecided text
        self.last: list[str] = [""]  # last piece of the best path to every boundary of it
        self.empty = True
        self.before: str | None = None  # the piece that was committed last
        self.widest = 0

    def feed(self, part: str) -> list[int]:
        out: list[int] = []
        for at in range(0, len(part), COMMIT_EVERY):
            self.text += part[at:at + COMMIT_EVERY].replace(SPACE, " ")
            self.empty = False
            if len(self.text) >= COMMIT_EVERY:
                extend_paths(self.model, self.text, self.last, self.before)
                out += self._commit()
        self.widest = max(self.widest, len(self.text))
        return out

    def finish(self) -> list[int]:
        if self.empty:
            return []
        extend_paths(self.model, self.text, self.last, self.before)
        out = path_ids(self.model, self.last, len(self.text))
        self.text, self.last, self.before = "", [""], None
        return out

    def _commit(self) -> list[int]:
        """Decide up to the last boundary that all surviving paths run through."""
        live = set(range(max(0, len(self.text) - self.model.longest + 1), len(self.text) + 1))
        while len(live) > 1:
            high = max(live)
            live.remove(high)
            live.add(high - len(self.last[high]) if high else 0)
            if 0 in live:
                return []
        at = live.pop()
        out = path_ids(self.model, self.last, at)
        self.before = self.last[at] or self.before
        self.text, self.last = self.text[at:], ["", *self.last[at + 1:]]
        return out


class Encoder:
    """Encodes and decodes whole texts; repeated runs between certain boundaries are looked up."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.known: dict[str, tuple[int, ...]] = {}

    def _run(self, run: str) -> tuple[int, ...] | list[int]:
        """Ids of a run that starts with a space; a long one is streamed."""
        if len(run) > SHORT:
            stream = StreamingEncoder(self.model)
            return stream.feed(run[1:]) + stream.finish()
        last: list[str | None] = [None] * (len(run) + 1)
        survivor(self.model, run, len(run), last)
        if len(self.known) >= KNOWN_RUNS:
            self.known.clear()
        ids = self.known[run] = tuple(path_ids(self.model, last, len(run)))
        return ids

    def encode(self, text: str) -> array:
        out = array("i")
        if not text:
            return out
        if not self.model.splits:
            stream = StreamingEncoder(self.model)
            out.extend(stream.feed(text) + stream.finish())
            return out
        known, extend = self.known.get, out.extend
        for run in re.findall(" +[^ ]*", " " + text.replace(SPACE, " ")):
            extend(known(run) or self._run(run))
        return out

    def decode(self, ids) -> str:
        raw = b"".join(map(self.model.raw.__getitem__, ids))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


def worker_encoder(path: str) -> Encoder:
    """The encoder of this Python worker: the tasks it runs one after the other share the model and the known runs.

    Task functions are shipped with the job, so what outlives a task hangs on a module of the worker's own.
    """
    import sys
    import types

    held = sys.modules.setdefault("_piece_encoders", types.ModuleType("_piece_encoders")).__dict__
    if path not in held:
        held[path] = Encoder(PieceModel(path))
    return held[path]


def encode_texts(docs: DataFrame, path: str, text: str = "text", keep_text: bool = False) -> DataFrame:
    """Rows of ``docs`` with ``ids``, ``n_ids`` and ``decoded_sha256``, the digest of the text decoded from them.

    A null or empty text has no ids and decodes to the empty text.  Decoding gives the
    text back, but for the space marker U+2581, which comes back as a space.  ``path``
    names a model file that every machine has.  Without ``keep_text`` the text column is
    left out.  A column named like an added one is replaced.
    """
    added = ["ids", "n_ids", "decoded_sha256"]
    own = next(f.name for f in docs.schema if f.name == text)
    names = [f.name for f in docs.schema if f.name not in added and (keep_text or f.name != own)]
    schema = StructType([docs.schema[n] for n in names]
                        + [StructField("ids", ArrayType(IntegerType())), StructField("n_ids", LongType()),
                           StructField("decoded_sha256", StringType())])

    def run(batches):
        import hashlib

        encoder = worker_encoder(path)
        for batch in batches:
            ids, ends, digests = array("i"), [0], []
            for value in batch.column(own):
                found = encoder.encode(value.as_py() or "")
                ids.extend(found)
                ends.append(len(ids))
                digests.append(hashlib.sha256(encoder.decode(found).encode("utf-8")).hexdigest())
            lists = pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)),
                                             pa.array(np.frombuffer(ids, np.int32) if len(ids) else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), lists, pa.array(np.diff(ends).astype(np.int64)),
                 pa.array(digests, pa.string())], names=[*names, *added])

    return docs.mapInArrow(run, schema)
