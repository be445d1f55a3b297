"""Words of texts as Arrow arrays: runs of the code points that the engine's own ``[\\p{L}\\p{N}]`` matches.

The class is asked from the engine once, as ranges of code points; words are then cut from the bytes of a
batch of folded texts, without a regular expression or a string a word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from lexiloom.operators.dedup import folded

WORD = r"[\p{L}\p{N}]"
#: Bytes of texts that are cut at a time, one text at least.
CUT_BYTES = 1 << 22
_ranges: dict[str, np.ndarray] = {}


def tokens(text) -> Column:
    return F.regexp_extract_all(folded(text), F.lit(f"({WORD}+)"), 1)


def leading(text, n: int) -> Column:
    """The first ``n`` words; the rest of the text is not cut."""
    return F.regexp_extract_all(F.regexp_extract(folded(text), rf"^(?:[^\p{{L}}\p{{N}}]*+{WORD}++){{1,{n}}}+", 0), F.lit(f"({WORD}+)"), 1)


def word_ranges(spark: SparkSession) -> np.ndarray:
    """Begins and ends, in turn, of the ranges of code points that stand in words."""
    app = spark.sparkContext.applicationId
    if app not in _ranges:
        other = spark._jvm.java.util.regex.Pattern.compile(r"[^\p{L}\p{N}]+")  # what the functions of regular expressions use
        known = np.zeros(0x110001, np.int8)
        for at in range(0, 0x110000, 0x10000):
            every = "".join(chr(c) for c in range(at, at + 0x10000) if not 0xD800 <= c < 0xE000)  # without surrogates
            known[[ord(c) for c in other.matcher(every).replaceAll("")]] = 1
        _ranges.clear()
        _ranges[app] = np.flatnonzero(np.diff(known, prepend=0)).astype(np.int32)
    return _ranges[app]


class Cutter:
    """Cuts batches of folded texts into words."""

    def __init__(self, ranges: np.ndarray):
        edges = np.zeros(0x110000, np.int8)
        edges[ranges[::2]], edges[ranges[1::2]] = 1, -1
        self.known = np.cumsum(edges, dtype=np.int8).astype(bool)
        self.byte = np.zeros(256, bool)
        self.byte[:128] = self.known[:128]

    def pieces(self, texts: pa.Array):
        """(place of the first text, words of some texts, how many each text has); null texts have none."""
        texts = texts.cast(pa.string()).fill_null("")
        ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset + 1 : texts.offset + 1 + len(texts)] if len(texts) else np.zeros(0, np.int32)
        at, before = 0, np.frombuffer(texts.buffers()[1], np.int32)[texts.offset] if len(texts) else 0
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
        while at < len(texts):
            upto = max(at + 1, int(np.searchsorted(ends, int(before) + CUT_BYTES, side="right")))
            yield at, *self._cut(data[before : ends[upto - 1]], np.concatenate([[0], ends[at:upto].astype(np.int64) - before]))
            at, before = upto, ends[upto - 1]

    def _cut(self, data: np.ndarray, offsets: np.ndarray) -> tuple[pa.StringArray, np.ndarray]:
        n = len(data)
        word = np.zeros(n + 1, bool)
        word[:n] = self.byte[data]
        lead = np.flatnonzero(data >= 0xC0)
        if len(lead):
            first = data[lead].astype(np.int64)
            size = 2 + (first >= 0xE0) + (first >= 0xF0)
            point = first & (0x7F >> size)
            for k in (1, 2, 3):
                more = np.flatnonzero(size > k)
                point[more] = (point[more] << 6) | (data[np.minimum(lead[more] + k, n - 1)] & 0x3F)
            held = self.known[np.minimum(point, 0x10FFFF)]
            lead, size = lead[held], size[held]
            for k in range(4):
                word[np.minimum(lead[size > k] + k, n)] = True
            word[n] = False
        begins = word.copy()
        begins[1:] &= ~word[:-1]
        begins[offsets] = word[offsets]  # no word goes on in the next text
        ends = word[:-1] & (~word[1:] | begins[1:])
        begins = np.flatnonzero(begins)
        held = np.concatenate([[0], np.cumsum(np.flatnonzero(ends) + 1 - begins)]).astype(np.int32)
        words = pa.StringArray.from_buffers(len(begins), pa.py_buffer(held), pa.py_buffer(data[word[:n]]))
        return words, np.diff(np.searchsorted(begins, offsets))
