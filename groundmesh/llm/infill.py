"""Fill-in-middle transformation, with cuts placed by a sparse exception index.

A text stays the bytes it is. Only its multibyte characters are recorded, each by its place and its bytes beyond the first; a cut in code
points becomes one in bytes, and the other way round, by a binary search among them, and by arithmetic where all is ASCII.

Texts are cut into units, tokens ``[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+`` or code points. Two draws from the hash of seed and doc_id
place the cuts, two more decide the form: ``plain`` (the text itself), ``psm`` (prefix, suffix, middle) or ``spm`` (suffix, prefix,
middle). ``restored`` rebuilds the text from an output and its form.

Defined cases: null texts are empty; an empty text, and one that holds a marker, is plain; an empty text has no units; a null doc_id draws as the
empty number; repeated rows give repeated outputs; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from groundmesh.llm.common import small

SEED = 42
#: Per hundred texts those that are transformed, and of them those in the order suffix, prefix, middle.
FIM_PERCENT = 50
SPM_PERCENT = 80
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
TRANSFORMED = "doc_id long, n long, form string, prefix_chars long, middle_chars long, prefix_bytes long, middle_bytes long, output binary"

_space = np.zeros(256, dtype=bool)
_space[[0x20, *range(0x09, 0x0E)]] = True


class ExceptionIndex:
    """Where a text's characters are not one byte each: the places of its multibyte characters, and the excess bytes up to each."""

    def __init__(self, raw: np.ndarray) -> None:
        self.size = len(raw)
        self.places = self.chars = self.excess = np.zeros(0, dtype=np.int64)
        high = np.flatnonzero(raw >= 0x80)
        if len(high):
            lead = np.flatnonzero((raw[high] & 0xC0) != 0x80)
            self.places = high[lead]
            self.excess = np.cumsum(np.diff(lead, append=len(high)) - 1)
            self.chars = self.places - np.concatenate([[0], self.excess[:-1]])  # the same places in code points

    def code_points(self, at: int) -> int:
        """Code points before a cut in bytes, which lies between characters."""
        before = int(np.searchsorted(self.places, at))
        return at - (int(self.excess[before - 1]) if before else 0)

    def bytes_before(self, at: int) -> int:
        """Bytes before a cut in code points."""
        before = int(np.searchsorted(self.chars, at))
        return at + (int(self.excess[before - 1]) if before else 0)


def token_ends(raw: np.ndarray) -> np.ndarray:
    """Where the tokens of a text end, in bytes: white space is ASCII, so code points need not be known."""
    if not len(raw):
        return np.zeros(0, dtype=np.int64)
    space = _space[raw]
    return np.append(np.flatnonzero(~space[:-1] & space[1:]) + 1, len(raw))


def draws(seed: int, doc_id: Column) -> list[Column]:
    """Four whole numbers below 2**32 of a document."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def arranged(whole: memoryview, first: int, second: int, form: str) -> bytes:
    prefix, middle, suffix = whole[:first], whole[first:second], whole[second:]
    head = (PREFIX, prefix, SUFFIX, suffix) if form == "psm" else (SUFFIX, suffix, PREFIX, prefix)
    return b"".join((*head, MIDDLE, middle))


def rebuilt(output: bytes, form: str) -> bytes:
    """The text of an output. Its parts hold no marker, so each marker is where it is found first."""
    if form == "plain":
        return output
    second = SUFFIX if form == "psm" else PREFIX
    at, end = output.index(second), output.index(MIDDLE)
    parts = output[len(PREFIX) : at], output[at + len(second) : end]
    prefix, suffix = parts if form == "psm" else parts[::-1]
    return prefix + output[end + len(MIDDLE) :] + suffix


def transform(docs: DataFrame, seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT, unit: str = "token") -> DataFrame:
    """TRANSFORMED columns of every document: units n, form, sizes of prefix and middle in code points and bytes (null if plain), the output."""
    if unit not in ("token", "char"):
        raise ValueError("unit is token or char")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            columns: list[list] = [[] for _ in range(7)]
            for text, *h in zip(batch["text"], *(batch[f"h{i}"].to_pylist() for i in range(1, 5)), strict=True):
                buffer = text.as_buffer()
                raw, whole = np.frombuffer(buffer, np.uint8), buffer.to_pybytes()
                index = ExceptionIndex(raw)
                ends = token_ends(raw) if unit == "token" else None
                n = len(ends) if unit == "token" else index.code_points(len(raw))
                if not whole or h[2] % 100 >= fim_percent or PREFIX in whole or SUFFIX in whole or MIDDLE in whole:
                    row = (n, "plain", None, None, None, None, whole)
                else:
                    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
                    first, second = (int(ends[k - 1]) if k else 0 for k in (low, high)) if unit == "token" else map(index.bytes_before, (low, high))
                    form = "spm" if h[3] % 100 < spm_percent else "psm"
                    chars = index.code_points(first)
                    row = (n, form, chars, index.code_points(second) - chars, first, second - first, arranged(memoryview(whole), first, second, form))
                for column, value in zip(columns, row, strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *map(pa.array, columns, kinds)], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "prefix_bytes", "middle_bytes", "output"])

    doc_id = F.col("doc_id").cast("long")
    return docs.select(doc_id.alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"), *draws(seed, doc_id)).mapInArrow(run, TRANSFORMED)


@F.arrow_udf(BinaryType())
def restored(output: pa.Array, form: pa.Array) -> pa.Array:
    """The exact text that an output was made from."""
    return pa.array([rebuilt(o.as_buffer().to_pybytes(), f) for o, f in zip(output, form.to_pylist(), strict=True)], pa.binary())


def round_trip(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, and SHA-256 of each output and of the text rebuilt from it."""
    rows = transform(docs)
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored("output", "form"), 256).alias("restored_sha256"))
