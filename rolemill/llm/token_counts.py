"""Token counts of whole texts: lengths only leave the Arrow function.

A tokenizer that drops white space encodes what stands between ASCII white space
independently, so such places are safe boundaries: a text's count is the sum over its
pieces.  Pieces not met before are encoded in batches cut by bytes, not by rows.  Texts
of any other tokenizer, such as one that keeps white space in its tokens, are encoded whole.
"""

from __future__ import annotations

import json

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

BATCH_BYTES = 1 << 18
KNOWN_PIECES = 400_000  # pieces a task remembers
SHORT = 48  # longer pieces are not remembered


#: Splits that drop white space between what they match.
WORDS_ONLY = {r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}


def drops_spaces(path: str) -> bool:
    """Whether a tokenizer file is known to drop white space and to see nothing across it."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)

    def parts(kind: str, inner: str) -> list[dict]:
        one = spec.get(kind)
        return one[inner] if one and one["type"] == "Sequence" else [one] if one else []

    for n in parts("normalizer", "normalizers"):
        spaces = n["type"] == "Replace" and n["pattern"] == {"Regex": r"\s+"} and n["content"] == " "
        if not spaces and n["type"] not in ("NFC", "Lowercase"):
            return False
    if any(c.isspace() for token in spec.get("added_tokens") or [] for c in token["content"]):
        return False
    first, *rest = parts("pre_tokenizer", "pretokenizers") or [{"type": None}]
    split = (first["type"] == "Split" and first["pattern"].get("Regex") in WORDS_ONLY
             and first["behavior"] == "Removed" and first["invert"])
    return split and all(r["type"] == "ByteLevel" and not r["add_prefix_space"] and not r["use_regex"] for r in rest)


def _batches(pieces: list[str], most: int):
    part, held = [], 0
    for piece in pieces:
        if part and held + len(piece) > most:
            yield part
            part, held = [], 0
        part.append(piece)
        held += len(piece)
    if part:
        yield part


def count_tokens(docs: DataFrame, path: str, text: str = "text", limit: int = 2048,
                 batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Rows of ``docs`` without the text, with ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens).

    ``path`` names a tokenizer file that every machine has, of any kind.  Special strings inside a
    text are handled as the file's default; none are added.  A null text counts as
    empty: zero bytes and tokens.  A column named like an added one is replaced.
    """
    added = ["n_bytes", "n_tokens", "over_limit"]
    own = next(f.name for f in docs.schema if f.name == text)
    names = [f.name for f in docs.schema if f.name != own and f.name not in added]
    schema = StructType([docs.schema[n] for n in names]
                        + [StructField(added[0], LongType()), StructField(added[1], LongType()),
                           StructField(added[2], BooleanType())])

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_padding()
        tokenizer.no_truncation()
        table = str.maketrans("\t\n\r\x0b\x0c", "     ")
        cut = drops_spaces(path)
        known: dict[str, int] = {}
        for batch in batches:
            texts = pc.fill_null(batch.column(own), "")
            counts = []
            for value in texts:
                pieces = value.as_py().translate(table).split(" ") if cut else [value.as_py()]
                if len(known) > KNOWN_PIECES:
                    known = {}
                new = list(set(pieces).difference(known))
                extra = {}
                for part in _batches(new, batch_bytes):
                    for piece, found in zip(part, tokenizer.encode_batch(part, add_special_tokens=False)):
                        (known if len(piece) <= SHORT else extra)[piece] = len(found)
                if extra:
                    counts.append(sum(extra[p] if p in extra else known[p] for p in pieces))
                else:
                    counts.append(sum(map(known.__getitem__, pieces)))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pc.binary_length(texts).cast(pa.int64()), pa.array(counts, pa.int64()),
                 pa.array([c > limit for c in counts], pa.bool_())], names=[*names, *added])

    return docs.mapInArrow(run, schema)
