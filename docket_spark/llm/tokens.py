"""Token ids and token counts with a public byte-level BPE vocabulary.

The vocabulary file of the ``tokenizers`` library is the reference: ids and counts equal what it gives
by default, without added tokens, special strings inside a text included. Texts of code points below
U+0250 are encoded by ``tiktoken`` from the ranks in the same file, about four times as fast and, on
these code points, with the same word classes; all other texts go to the library itself.

Long texts are cut where a space or line break follows an ASCII letter or digit. No word of the
vocabulary's own cutting reaches across such a place, so the ids of the parts are those of the text.
"""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from docket_spark.llm.columns import by_bytes, column, field, utf8

# Fixed values of the vocabulary: its special string and the pattern that cuts words.
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BATCH_BYTES = 1 << 20
LONG_TEXT = 1 << 16

_FOREIGN = re.compile("[^\x00-\u024f]")
_SAFE = re.compile(r"(?<=[A-Za-z0-9])(?=[ \n])")


def safe_parts(text: str, size: int = LONG_TEXT) -> list[str]:
    """``text`` cut at safe places into parts of ``size`` characters or a little more.

    A stretch without a safe place stays whole.
    """
    parts, start = [], 0
    while len(text) - start > size and (place := _SAFE.search(text, start + size)):
        parts.append(text[start : place.start()])
        start = place.start()
    return [*parts, text[start:]]


def _byte_of() -> dict[str, int]:
    """The printable characters that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Encoder:
    """Ids of texts as arrays of unsigned 32-bit numbers."""

    def __init__(self, path: str):
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        byte_of = _byte_of()
        ranks = {
            bytes(byte_of[c] for c in word): rank
            for word, rank in vocabulary.items()
            if word != SPECIAL
        }
        self.fast = tiktoken.Encoding(
            "ranks", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={SPECIAL: SPECIAL_ID}
        )

    @functools.cached_property
    def library(self):
        """The reference, loaded by the first text that needs it."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        return [self._foreign(x) if _FOREIGN.search(x) else self._plain(x) for x in texts]

    def _plain(self, text: str) -> np.ndarray:
        encode = functools.partial(self.fast.encode_to_numpy, allowed_special="all")
        if len(text) <= LONG_TEXT:
            return encode(text)
        return np.concatenate([encode(part) for part in safe_parts(text)])

    def _foreign(self, text: str) -> np.ndarray:
        parts = self.library.encode_batch_fast(safe_parts(text), add_special_tokens=False)
        return np.concatenate([np.array(x.ids, dtype=np.uint32) for x in parts])


@functools.cache
def encoder(path: str) -> Encoder:
    """One encoder per Python worker and vocabulary."""
    return Encoder(path)


def token_counts(
    docs: DataFrame,
    vocabulary: str,
    doc_id: str = "doc_id",
    text: str = "text",
    limit: int = 512,
) -> DataFrame:
    """Per row: its id, n_bytes, n_tokens and over_limit (n_tokens > ``limit``).

    Only lengths leave Python. Batches hold about one megabyte of text, a longer text is a batch of
    its own. A null text is the empty text: no bytes, no tokens. Ids are passed on as they are, null
    and repeated ones too; rows that repeat are counted each. Invalid UTF-8 is read with U+FFFD in
    place of bad bytes for tokens, and with its own bytes for ``n_bytes``.
    """
    schema = T.StructType(
        [
            field(docs, doc_id),
            T.StructField("n_bytes", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("over_limit", T.BooleanType()),
        ]
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).ids
        for batch in batches:
            for part in by_bytes(batch, "body", BATCH_BYTES):
                raw = utf8(part.column("body"))
                tokens = [len(x) for x in encode([x.decode("utf-8", "replace") for x in raw])]
                yield pa.record_batch(
                    [
                        part.column("id"),
                        pa.array([len(x) for x in raw], pa.int64()),
                        pa.array(tokens, pa.int64()),
                        pa.array([n > limit for n in tokens], pa.bool_()),
                    ],
                    names=[doc_id, "n_bytes", "n_tokens", "over_limit"],
                )

    rows = docs.select(column(doc_id).alias("id"), column(text).cast("string").alias("body"))
    return rows.mapInArrow(count, schema)
