"""Removal of passages that occur more than once in a corpus (repeated-phrase automata).

A window is a run of ``window`` consecutive words.  Every word covered by a window
whose word sequence also starts anywhere else goes, first occurrences included.

1. *Candidates.*  The smallest hash among the short phrases inside a window depends on
   its words alone, so equal windows share it.  Consecutive windows with one such
   phrase form a run, about one run for 15 words; shards count phrases and run contents.
2. *Confirmation.*  A run whose whole content recurs is confirmed.  Where a phrase
   recurs in differing runs, shards count their single windows by two 64-bit hashes.
   Consecutive confirmed windows make a passage.
3. *Automata.*  Every block compiles its own passages, as word sequences, into one
   Aho-Corasick automaton.
4. *Streaming.*  The block's documents run through it; words covered by an occurrence go.
   Equal windows have one status, so these are the words of the confirmed windows: the
   counts decide, and no passage meets the documents of another block.

Phrases and windows travel as one entry per block, so a passage in a third of all
documents burdens no task.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from rolemill.llm.blocks import BATCH_BYTES, answer, ask, by_shard, from_bytes, pack, restore, shard_count, tell, to_bytes
from rolemill.llm.words import U64, Words, hash_ranges, runs, sliding_min
from rolemill.plans.session import materialize

WINDOW = 35
PHRASE = 8
SINGLE, SAME, MIXED = 0, 1, 2  # how often a phrase occurs, and whether in one run content


class _Windows:
    """The windows of a block's texts and the runs they form."""

    def __init__(self, texts, window: int, phrase: int):
        self.words = Words(texts)
        self.hash = self.words.hashes(1)
        n = len(self.hash)
        self.at, self.text = runs(self.words.first, window)
        if not len(self.at):
            self.low = self.at.astype(U64)
            self.run = self.starts = self.at
            self.span = self.low
            return
        grams = hash_ranges(self.hash, np.arange(n - phrase + 1), np.arange(phrase, n + 1), 2)
        self.low = sliding_min(grams, window - phrase + 1)[self.at]
        new = np.ones(len(self.at), bool)
        new[1:] = (self.low[1:] != self.low[:-1]) | (self.text[1:] != self.text[:-1])
        self.starts = np.flatnonzero(new)
        self.run = np.cumsum(new) - 1
        last = np.append(self.starts[1:], len(self.at)) - 1
        self.span = hash_ranges(self.hash, self.at[self.starts], self.at[last] + window, 5)

    def phrases(self):
        """Distinct phrases, one run content of each, how they occur, and the phrase of each run."""
        keys = self.low[self.starts]
        found, of_run, counts = np.unique(keys, return_inverse=True, return_counts=True)
        order = np.argsort(of_run, kind="stable")
        edges = np.cumsum(counts) - counts
        span = self.span[order]
        least = np.minimum.reduceat(span, edges) if len(edges) else span
        most = np.maximum.reduceat(span, edges) if len(edges) else span
        kind = np.where(least != most, MIXED, np.where(counts > 1, SAME, SINGLE)).astype(np.uint8)
        return found, least, kind, of_run

    def keys(self, chosen: np.ndarray, window: int):
        """Distinct (hash, second hash) of the chosen windows, whether repeated here, and the key of each window."""
        at = self.at[chosen]
        one = hash_ranges(self.hash, at, at + window, 3)
        two = hash_ranges(self.hash, at, at + window, 4)
        order = np.lexsort((two, one))
        new = np.ones(len(order), bool)
        new[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(new) - 1
        counts = np.bincount(group) if len(group) else np.zeros(0, np.int64)
        first = order[new]
        return one[first], two[first], (counts > 1).astype(np.uint8), group


def _grouped(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Order by the given columns (first one leading) and where groups start in it."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    for i, k in enumerate(keys):
        differs = k[order][1:] != k[order][:-1]
        new[1:] = differs if i == 0 else new[1:] | differs
    return order, np.flatnonzero(new)


def _back(entries: list[bytes], sizes: list[int], values: np.ndarray) -> list[bytes]:
    ends = np.cumsum(sizes)
    return [values[e - n:e].tobytes() for n, e in zip(sizes, ends.tolist())]


def _phrase_status(entries: list[bytes]) -> list[bytes]:
    parts = [from_bytes(e, U64, U64, np.uint8) for e in entries]
    low, span, kind = (np.concatenate([p[i] for p in parts]) for i in range(3))
    order, starts = _grouped([low])
    sizes = np.diff(np.append(starts, len(order)))
    least = np.minimum.reduceat(span[order], starts)
    most = np.maximum.reduceat(span[order], starts)
    worst = np.maximum.reduceat(kind[order], starts)
    status = np.where((least != most) | (worst == MIXED), MIXED, np.where((sizes > 1) | (worst == SAME), SAME, SINGLE))
    out = np.empty(len(order), np.uint8)
    out[order] = np.repeat(status.astype(np.uint8), sizes)
    return _back(entries, [len(p[0]) for p in parts], out)


def _window_status(entries: list[bytes]) -> list[bytes]:
    parts = [from_bytes(e, U64, U64, np.uint8) for e in entries]
    one, two, twice = (np.concatenate([p[i] for p in parts]) for i in range(3))
    order, starts = _grouped([one, two])
    sizes = np.diff(np.append(starts, len(order)))
    again = (sizes > 1) | (np.maximum.reduceat(twice[order], starts) > 0)
    out = np.empty(len(order), np.uint8)
    out[order] = np.repeat(again.astype(np.uint8), sizes)
    return _back(entries, [len(p[0]) for p in parts], out)


def _passages(win: _Windows, confirmed: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Word ranges of consecutive confirmed windows of one text."""
    at, text = win.at[confirmed], win.text[confirmed]
    if not len(at):
        return []
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (text[1:] != text[:-1])
    starts = np.flatnonzero(new)
    last = np.append(starts[1:], len(at)) - 1
    return list(zip(at[starts].tolist(), (at[last] + window).tolist()))


def _stream(win: _Windows, passages: list[tuple[int, int]]) -> np.ndarray:
    """Words covered by any occurrence of any passage, found by one automaton."""
    gone = np.zeros(len(win.hash) + 1, np.int64)
    if not passages:
        return gone[:-1] > 0
    _, ids = np.unique(win.hash, return_inverse=True)
    ids = ids.tolist()
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for a, b in passages:
        automaton.add_word(tuple(ids[a:b]), b - a)
    automaton.make_automaton()
    ends, lengths = [], []
    first = win.words.first.tolist()
    for a, b in zip(first, first[1:]):
        for end, length in automaton.iter(tuple(ids[a:b])):
            ends.append(a + end + 1)
            lengths.append(length)
    ends, lengths = np.array(ends, np.int64), np.array(lengths, np.int64)
    np.add.at(gone, ends - lengths, 1)
    np.add.at(gone, ends, -1)
    return np.cumsum(gone[:-1]) > 0


def remove_repeats(docs: DataFrame, text: str = "text", window: int = WINDOW, phrase: int = PHRASE,
                   digest: bool = False) -> DataFrame:
    """Rows of ``docs`` with ``n_words``, ``n_removed`` and ``kept_text`` (kept words joined by one space).

    With ``digest``, ``kept_sha256`` replaces ``kept_text`` and the text column.  A null, empty or blank
    text has no words and keeps the empty text; a text shorter than a window keeps all
    words.  Repeated rows are repeated texts.  Other columns pass through unchanged; a
    column named like an added one is replaced.  An empty table gives an empty result.
    """
    if not 1 <= phrase <= window:
        raise ValueError("a phrase has 1 to `window` words")
    added = ["n_words", "n_removed", "kept_sha256" if digest else "kept_text"]
    own = next(f.name for f in docs.schema if f.name == text)
    schema = StructType([f for f in docs.schema if f.name not in added and not (digest and f.name == own)]
                        + [StructField(added[0], LongType()), StructField(added[1], LongType()),
                           StructField(added[2], StringType())])
    names = schema.names[:-3]
    blocks = pack(docs, text)
    shards = shard_count(blocks, 800_000)

    def ask_phrases(block, rows):
        found, span, kind, _ = _Windows(rows[own], window, phrase).phrases()
        for s, cols in by_shard(shards, found, found, span, kind):
            yield s, to_bytes(*cols)

    status = materialize(answer(ask(blocks, ask_phrases), _phrase_status), "phrases", batch_bytes=BATCH_BYTES)

    def windows_of(rows, told):
        win = _Windows(rows[own], window, phrase)
        found, _, _, of_run = win.phrases()
        answers = {t["shard"]: np.frombuffer(t["entries"], np.uint8) for t in told if not t.get("windows")}
        state = restore(shards, found, answers, np.uint8)[of_run][win.run] if len(found) else np.zeros(0, np.uint8)
        return win, state

    def ask_windows(block, rows, told):
        names_ = ["shard", "block", "entries"]
        types = [pa.int32(), pa.int64(), pa.binary()]
        asked = []
        if rows is not None and told:
            win, state = windows_of(rows, told)
            one, two, twice, _ = win.keys(np.flatnonzero(state == MIXED), window)
            asked = [(s, block, to_bytes(*cols)) for s, cols in by_shard(shards, one, one, two, twice)]
        return pa.table([pa.array([a[i] for a in asked], t) for i, t in enumerate(types)], names=names_)

    asked = tell(blocks, status, ask_windows, "shard int, block long, entries binary")
    told = status.withColumn("windows", F.lit(False)).unionByName(
        answer(asked, _window_status).withColumn("windows", F.lit(True)))

    def cut(block, rows, told):
        if rows is None:
            return pa.table({"n": pa.array([], pa.int64())})
        win, state = windows_of(rows, told)
        confirmed = state == SAME
        mixed = np.flatnonzero(state == MIXED)
        if len(mixed):
            one, _, _, group = win.keys(mixed, window)
            answers = {t["shard"]: np.frombuffer(t["entries"], np.uint8) for t in told if t["windows"]}
            confirmed[mixed] = restore(shards, one, answers, np.uint8)[group] > 0
        alone = np.flatnonzero(state == SINGLE)  # repeats inside one run: text with a short period
        if len(alone):
            at = win.at[alone]
            one = hash_ranges(win.hash, at, at + window, 3)
            ordered = np.sort(one)
            if (ordered[1:] == ordered[:-1]).any():
                _, _, twice, group = win.keys(alone, window)
                confirmed[alone] = twice[group] > 0
        gone = _stream(win, _passages(win, confirmed, window))
        words, raw = win.words, win.words.data.tobytes()
        removed, kept = [], []
        for j, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist())):
            mine = raw[words.offs[j]:words.offs[j + 1]].split()
            lost = int(gone[a:b].sum())
            removed.append(lost)
            kept.append(b" ".join(compress(mine, (~gone[a:b]).tolist()) if lost else mine))
        last = [hashlib.sha256(k).hexdigest() for k in kept] if digest else [k.decode("utf-8") for k in kept]
        return pa.table([*(rows[n] for n in names), pa.array(words.counts().tolist(), pa.int64()),
                         pa.array(removed, pa.int64()), pa.array(last, pa.string())], names=[*names, *added])

    return tell(blocks, told, cut, schema)
