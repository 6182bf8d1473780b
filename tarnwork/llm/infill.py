"""Fill-in-middle: texts cut in three and put together in another order, and the way back.

Units are runs of the letters A-Z and a-z, and single other code points. While a text's units are counted, its byte and
code-point offsets at every STEP-th unit are noted: a sparse index, so that no list of all units is ever held. A cut after
so many units is found by binary search among those checkpoints and a scan of at most STEP units on.

A null text is empty; an empty text, one that holds a sentinel, and a fixed share of the others stay as they are (plain).
Where a text is cut, and its form, depend on its doc_id and length alone; a row without a doc_id counts as having an empty
one. Repeated rows come out alike, an empty table gives an empty one, and only the two columns named are read.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks before the prefix, the suffix and the middle.
SENTINELS = ("<P>", "<S>", "<M>")
STEP = 256
#: Bytes that are counted, or scanned, at a time; bytes of texts that one output batch is made of.
CHUNK, SCAN, BATCH = 1 << 18, 1 << 12, 1 << 20


def _starts(part: np.ndarray, after_letter: bool) -> tuple[np.ndarray, np.ndarray, bool]:
    """For each byte of a stretch, whether a code point begins there, and whether a unit does; whether it ends in a letter."""
    letter = ((part | 32) - 97) < 26  # uint8 wraps below 97
    point = (part & 0xC0) != 0x80
    before = np.empty(len(part), bool)
    before[0], before[1:] = after_letter, letter[:-1]
    return point, point & ~(letter & before), bool(letter[-1])


class Index:
    """Units of a UTF-8 text and the checkpoints: unit numbers, byte and code-point offsets."""

    def __init__(self, data: bytes, step: int = STEP):
        self.data, self.units, self.bytes, self.points = np.frombuffer(data, np.uint8), [], [], []
        n = points = 0
        letter = False
        for at in range(0, len(self.data), CHUNK):
            point, start, letter = _starts(self.data[at : at + CHUNK], letter)
            places = np.flatnonzero(start)
            marked = places[-n % step :: step]
            self.units += range(n + -n % step, n + len(places), step)
            self.bytes += (marked + at).tolist()
            self.points += (np.cumsum(point)[marked] - 1 + points).tolist() if len(marked) else []
            n, points = n + len(places), points + int(np.count_nonzero(point))
        self.n, self.n_points = n, points

    def offsets(self, cut: int) -> tuple[int, int]:
        """Byte and code-point offset of the place after `cut` units."""
        if cut >= self.n:
            return len(self.data), self.n_points
        i = bisect_right(self.units, cut) - 1
        at, points, ahead, letter = self.bytes[i], self.points[i], cut - self.units[i], False
        while True:
            point, start, letter = _starts(self.data[at : at + SCAN], letter)
            places = np.flatnonzero(start)
            if ahead < len(places):
                return at + int(places[ahead]), points + int(np.count_nonzero(point[: places[ahead]]))
            ahead, at, points = ahead - len(places), at + SCAN, points + int(np.count_nonzero(point))


def _arranged(data: bytes, h: tuple, sentinels: tuple, plain: int, spm: int, step: int):
    index = Index(data, step)
    low, high = sorted((h[0] % (index.n + 1), h[1] % (index.n + 1)))
    if not data or any(s in data for s in sentinels) or h[2] % 100 >= 100 - plain:
        return index.n, "plain", None, None, data
    (a, first), (b, second) = index.offsets(low), index.offsets(high)
    p, s, m = sentinels
    parts = (s, data[b:], p, data[:a], m, data[a:b]) if h[3] % 100 < spm else (p, data[:a], s, data[b:], m, data[a:b])
    return index.n, "spm" if parts[0] == s else "psm", first, second - first, b"".join(parts)


def fill(docs: DataFrame, key: str = "doc_id", text: str = "text", sentinels: tuple = SENTINELS, plain: int = 10, spm: int = 20, step: int = STEP) -> DataFrame:
    """key, n (units), form, prefix_chars, middle_chars (null if plain), output of each row.

    plain: of a hundred documents, those that stay as they are; spm: of a hundred others, those with the suffix first."""
    hashed = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    numbers = [F.conv(F.substring(hashed, 8 * i + 1, 8), 16, 10).cast("long").alias(f"_h{i}") for i in range(4)]
    marks = tuple(s.encode() for s in sentinels)
    types = dict(docs.dtypes)

    def run(batches):
        for whole in batches:
            texts, at = whole.column(1), 0
            while at < whole.num_rows:  # a few texts at a time, however long the rows of a batch are
                end, size, rows = at, 0, []
                while end < whole.num_rows and (end == at or size < BATCH):
                    data = bytes(texts[end].as_buffer() or b"") if texts[end].is_valid else b""
                    rows.append(_arranged(data, tuple(whole.column(2 + i)[end].as_py() for i in range(4)), marks, plain, spm, step))
                    size, end = size + len(data), end + 1
                n, form, first, middle, out = zip(*rows)
                made = [pa.array(n, pa.int64()), pa.array(form), pa.array(first, pa.int64()), pa.array(middle, pa.int64()), pa.array(out, pa.binary()).view(pa.string())]
                yield pa.RecordBatch.from_arrays([whole.column(0).slice(at, end - at), *made], [key, "n", "form", "prefix_chars", "middle_chars", "output"])
                at = end

    rows = docs.select(F.col(key), F.col(text).alias("_text"), *numbers)
    return rows.mapInArrow(run, f"`{key}` {types[key]}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restored(output: Column, form: Column, sentinels: tuple = SENTINELS) -> Column:
    """The text that an output was made of. A text with a sentinel in it is plain, so each of the others has each once."""
    parts = F.split(output, "|".join(map(re.escape, sentinels)), -1)
    one, two, three = (F.get(parts, F.lit(i)) for i in (1, 2, 3))
    psm, spm = F.concat(one, three, two), F.concat(two, three, one)
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
