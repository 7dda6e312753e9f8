"""Fill-in-the-middle samples with a sparse index of multibyte characters.

Two cuts split a text into prefix, middle and suffix, which are put in another
order between markers. A cut is chosen in units (lines or code points), made in
UTF-8 bytes and reported in code points. Only multibyte characters make the two
differ, so the index holds nothing else: the byte place of each one and the bytes
that it and those before it have beyond one. A binary search in it turns a byte
place into a code point and back; between two entries both run in step, and a
text of ASCII has no entries at all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import chunks

#: Markers before the prefix, the suffix and the middle.
MARKERS = ("<P>", "<S>", "<M>")
#: Share of texts (percent) that are transformed, and of those that get the suffix first.
RATE, SPM_RATE = 100, 50
SEED = 7
#: What a text is cut into.
UNITS = ("line", "char")

_NEWLINE = 10
_COLUMNS = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]


class MultibyteIndex:
    """Places of the multibyte characters of a UTF-8 text, and their excess bytes."""

    def __init__(self, data: np.ndarray):
        self.byte = np.flatnonzero(data >= 0xC0)
        lead = data[self.byte]
        #: excess[k]: bytes beyond one of the first k multibyte characters
        self.excess = np.zeros(len(lead) + 1, np.int64)
        np.cumsum(1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0), out=self.excess[1:])
        self.point = self.byte - self.excess[:-1]

    def points(self, at: np.ndarray) -> np.ndarray:
        """Code points before the byte places ``at``, which are character borders."""
        return at - self.excess[np.searchsorted(self.byte, at)]

    def bytes(self, at: np.ndarray) -> np.ndarray:
        """Bytes before the code points ``at``."""
        return at + self.excess[np.searchsorted(self.point, at)]


class Cutter:
    """Units of a chunk of texts, and the byte places of their borders."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, unit: str):
        self.offsets, self.unit, self.index = offsets, unit, MultibyteIndex(data)
        self.start = offsets[:-1]
        if unit == "line":
            newline = np.flatnonzero(data == _NEWLINE)
            self.ends = newline + 1
            self.first = np.searchsorted(newline, offsets)
            lines = np.diff(self.first)
            last = np.maximum(offsets[1:] - 1, 0)
            open_ = (np.diff(offsets) > 0) & (data[last] != _NEWLINE if len(data) else False)
            self.n = lines + open_
        else:
            self.first = self.index.points(offsets)
            self.n = np.diff(self.first)

    def place(self, units: np.ndarray) -> np.ndarray:
        """Byte place in the chunk after the first ``units`` units of each text."""
        if self.unit == "char":
            return self.index.bytes(self.first[:-1] + units)
        # the last line may have no end of its own
        end = self.first[:-1] + units
        inner = np.r_[self.ends, 0][np.minimum(np.maximum(end - 1, 0), len(self.ends))]
        return np.where(units == 0, self.start, np.where(units == self.n, self.offsets[1:], inner))


def _arranged(body: bytes, a: int, b: int, form: str, markers: tuple[bytes, bytes, bytes]) -> bytes:
    prefix, middle, suffix = body[:a], body[a:b], body[b:]
    p, s, m = markers
    if form == "psm":
        return b"".join((p, prefix, s, suffix, m, middle))
    return b"".join((s, suffix, p, prefix, m, middle))


def _transform(unit: str, rate: int, spm_rate: int, markers: tuple[str, str, str]):
    raw = tuple(m.encode() for m in markers)

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            h = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(2, 6)]
            for start, stop, data, offsets in chunks(batch.column(1)):
                cutter = Cutter(data, offsets, unit)
                h1, h2, h3, h4 = (x[start:stop] for x in h)
                first, second = h1 % (cutter.n + 1), h2 % (cutter.n + 1)
                cuts = np.stack([cutter.place(np.minimum(first, second)), cutter.place(np.maximum(first, second))])
                points = cutter.index.points(np.vstack([offsets[:-1], cuts]))
                prefix_chars, middle_chars = np.diff(points, axis=0)
                forms, outputs = [], []
                body = data.tobytes()
                for at, end, a, b, use, spm in zip(offsets[:-1].tolist(), offsets[1:].tolist(), *cuts.tolist(),
                                                   (h3 % 100 < rate).tolist(), (h4 % 100 < spm_rate).tolist()):
                    text = body[at:end]
                    if not text or not use or any(m in text for m in raw):
                        forms.append("plain")
                        outputs.append(text)
                    else:
                        forms.append("spm" if spm else "psm")
                        outputs.append(_arranged(text, a - at, b - at, forms[-1], raw))
                plain = np.array([f == "plain" for f in forms], bool)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(start, stop - start), pa.array(cutter.n.astype(np.int64)), pa.array(forms, pa.string()),
                     pa.array(prefix_chars, mask=plain), pa.array(middle_chars, mask=plain),
                     pa.array(outputs, pa.binary()).cast(pa.string())], names=_COLUMNS)

    return run


def fill_in_middle(docs: DataFrame, unit: str = "line", rate: int = RATE, spm_rate: int = SPM_RATE, seed: int = SEED,
                   markers: tuple[str, str, str] = MARKERS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars (code points;
    null if plain) and output (the transformed text) of every row.

    The cuts and the form come from the SHA-256 of ``seed:id``, so they do not depend on
    the partitioning. A null text is empty, an empty one or one that holds a marker stays
    plain, a null id is hashed as an empty one, rows that share an id are cut by the same
    numbers, and an empty table gives an empty result. Other columns are not read."""
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {UNITS}")
    if len(set(markers)) < 3 or not all(markers) or any(a.find(b[0], 1) >= 0 for a in markers for b in markers):
        raise ValueError("markers must differ, and their first characters occur in them only at the start")
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")))
    digest = F.sha2(name, 256)
    numbers = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), *numbers)
    return rows.mapInArrow(_transform(unit, rate, spm_rate, tuple(markers)),
                           "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The original text, from the output and its form alone."""
    p, s, m = markers

    def between(left: str, right: str | None) -> Column:
        start = F.locate(left, output) + len(left)
        return F.substring(output, start, (F.locate(right, output) if right else F.length(output) + 1) - start)

    middle = between(m, None)
    return (F.when(form == "plain", output)
            .when(form == "psm", F.concat(between(p, s), middle, between(s, m)))
            .when(form == "spm", F.concat(between(p, m), middle, between(s, p))))
