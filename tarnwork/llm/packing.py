"""Packing of tokenized documents by the sum-of-squares rule.

Documents longer than a window are cut into whole windows and a rest. Rests come online to a packer that keeps, for
every fill level, how many windows stand at it, and puts each rest where the sum of squares of those counts over
partially filled windows grows least (a new window is level 0). Packers work side by side on groups of some tens of
thousands of pieces, dealt by hash; a group's state is one array of levels and its open windows.

Rows: a null text is empty, and an empty document is its end token alone. Repeated rows are packed each. Ties between
levels go to the fullest. Other columns are not looked at. An empty table packs into nothing.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ngrams import _powers
from .shared import staged
from .suffixes import _mix

LENGTH = 4096
END = 2
#: Pieces in one packer's group, about; pieces, and pieces of texts with far characters, kept with their ids in each worker.
GROUP, CACHED, WORDS = 50_000, 2_000_000, 300_000
_tokenizers: dict[str, tuple] = {}


def _loaded(path: str):
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _tokenizers[path] = (Tokenizer.from_file(path), {"": b""}, _Known())
    return _tokenizers[path]


def _latin(category: str) -> str:
    """Members of a character class for letters (L) or numbers (N) below U+0180."""
    return "".join(re.escape(chr(c)) for c in range(0x180) if unicodedata.category(chr(c))[0] == category)


#: Where the tokenizer cuts lowered text before it merges; below U+0180, where Unicode composition changes nothing.
_PIECE = re.compile(rf"'(?:s|t|re|ve|m|ll|d)|[{_latin('L')}]+|[{_latin('N')}]|[^\t-\r \x85\xa0{_latin('L')}{_latin('N')}]+")
_FAR = re.compile("[^\x00-\u017f]|\u0130|<[|]")


def _cut(text: str) -> list[str]:
    """Strings whose ids, one after the other, are the text's."""
    return [x for w in text.replace("\n", " ").split(" ") if w for x in ([w] if _FAR.search(w) else _PIECE.findall(w.lower()))]


#: Kinds of characters below U+0180: 0 white space, 1 letters, 2 numbers, 3 all others.
_KIND = np.array([0 if c in (*range(9, 14), 32, 0x85, 0xA0) else {"L": 1, "N": 2}.get(unicodedata.category(chr(c))[0], 3) for c in range(0x180)], np.uint8)
_CHAR = np.random.default_rng(49).integers(1, 2**63, 0x180, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _Known:
    """Ids of pieces, by the pieces' 64-bit hashes: sorted arrays, so that many pieces are looked up in one step."""

    def __init__(self):
        self.keys, self.at, self.n, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")


def _bounds(chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each piece of lowered text starts and ends: runs of letters, single numbers, runs of other characters; an
    apostrophe that starts a piece takes in an s, t, re, ve, m, ll or d behind it."""
    kind = _KIND[chars]
    turn = np.flatnonzero(np.concatenate([[True], (kind[1:] != kind[:-1]) | (kind[1:] == 2)])) if len(kind) else np.zeros(0, np.int64)
    some = kind[turn] > 0
    a, b = turn[some], np.append(turn[1:], len(kind))[some]
    mark = np.flatnonzero((chars[a] == 39) & (b == a + 1))
    mark = mark[(mark + 1 < len(a))]
    mark = mark[(a[mark + 1] == b[mark]) & (kind[np.minimum(b[mark], len(kind) - 1)] == 1)]
    if len(mark):
        one = chars[b[mark]]
        two = np.where(b[mark] + 1 < len(chars), chars[np.minimum(b[mark] + 1, len(chars) - 1)], 0)
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        take = np.where(np.isin(one, [ord(c) for c in "stmd"]), 1, np.where(long, 2, 0))
        b[mark] += take
        a[mark + 1] += take
        left = a < b
        a, b = a[left], b[left]
    return a, b


def _plain(texts: list[str], tokenizer, known: _Known) -> list[bytes]:
    """Ids of lowered texts below U+0180, all pieces at a time."""
    whole = "\n".join(texts)
    chars = np.frombuffer(whole.encode("utf-32-le"), "<u4")
    a, b = _bounds(chars)
    up, down = _powers(max(1, len(chars)))
    sums = np.zeros(len(chars) + 1, np.uint64)
    np.cumsum(_CHAR[chars] * up[: len(chars)], out=sums[1:])
    names, first, which = np.unique(_mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)), return_index=True, return_inverse=True)
    place = np.searchsorted(known.keys, names)
    hit = known.keys[np.minimum(place, len(known.keys) - 1)] == names if len(known.keys) else np.zeros(len(names), bool)
    at, n, ids = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64), known.ids
    at[hit], n[hit] = known.at[place[hit]], known.n[place[hit]]
    if not hit.all():
        new = [whole[x:y] for x, y in zip(a[first[~hit]].tolist(), b[first[~hit]].tolist())]
        found = dict(_encoded(tokenizer, new))
        raw = [found[x] for x in new]
        n[~hit] = [len(r) // 4 for r in raw]
        at[~hit] = len(ids) + np.cumsum(n[~hit]) - n[~hit]
        ids = np.concatenate([ids, np.frombuffer(b"".join(raw), "<u4")])
        if len(known.keys) + len(new) <= CACHED:
            known.keys, known.at, known.n = (np.insert(x, place[~hit], y[~hit]) for x, y in ((known.keys, names), (known.at, at), (known.n, n)))
            known.ids = ids
    size = n[which]
    upto = np.concatenate([[0], np.cumsum(size)])
    raw = ids[np.repeat(at[which] - upto[:-1], size) + np.arange(upto[-1])].tobytes()
    ends = np.cumsum([len(t) + 1 for t in texts])
    cuts = [0, *(4 * upto[np.searchsorted(a, ends)]).tolist()]
    return [raw[x:y] for x, y in zip(cuts, cuts[1:])]


def encode(texts: list[str], path: str) -> list[bytes]:
    """Ids of each text as little-endian 32-bit numbers.

    The tokenizer drops white space, lowers, and merges within pieces of letters, single digits or other characters. So a
    text's ids are those of its pieces, and pieces' ids are kept from batch to batch, up to CACHED. A word with
    characters from U+0180 on, which may compose, or with what may be a special token is given to the tokenizer as it is.
    """
    tokenizer, words, known = _loaded(path)
    far = [i for i, t in enumerate(texts) if t and _FAR.search(t)]
    plain = [(t or "").lower() for t in texts]
    for i in far:
        plain[i] = ""
    out = _plain(plain, tokenizer, known)
    split = [_cut(texts[i]) for i in far]
    new = list({p for x in split for p in x if p not in words})
    words.update(_encoded(tokenizer, new))
    for i, x in zip(far, split):
        out[i] = b"".join(map(words.get, x))
    if len(words) > WORDS:
        for p in new[max(0, len(new) - (len(words) - WORDS)) :]:
            del words[p]
    return out


def _encoded(tokenizer, strings: list[str], together: int = 1024):
    """(string, ids) of each. Pieces go to the tokenizer many at a time, between blanks, and are told apart by the
    tokens that end a piece; what isn't one piece goes alone."""
    one = [x for x in strings if not _FAR.search(x)]
    alone = [x for x in strings if _FAR.search(x)]
    ends = _ends(tokenizer)
    for i in range(0, len(one), together):
        some = one[i : i + together]
        ids = np.array(tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
        cuts = (4 * (np.flatnonzero(ends[ids]) + 1)).tolist()
        if len(cuts) != len(some):
            alone += some
            continue
        raw = ids.tobytes()
        yield from zip(some, (raw[a:b] for a, b in zip([0, *cuts], cuts)))
    for i in range(0, len(alone), together):
        some = alone[i : i + together]
        yield from zip(some, (array("I", e.ids).tobytes() for e in tokenizer.encode_batch_fast(some, add_special_tokens=False)))


_end_tables: dict[int, np.ndarray] = {}


def _ends(tokenizer) -> np.ndarray:
    """Which ids stand for the end of a piece."""
    if id(tokenizer) not in _end_tables:
        vocabulary = tokenizer.get_vocab(with_added_tokens=True)
        table = np.zeros(max(vocabulary.values()) + 1, bool)
        table[[i for s, i in vocabulary.items() if s.endswith("</w>")]] = True
        _end_tables[id(tokenizer)] = table
    return _end_tables[id(tokenizer)]


def pieces(docs: DataFrame, path: str, length: int = LENGTH, end: int = END, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens (and ids): documents cut into whole windows and a rest."""
    last = int(end).to_bytes(4, "little")

    def cut(batches):
        for whole in batches:
            at = 0
            while at < whole.num_rows:  # a few texts at a time, however long the rows of a batch are
                b, size = at, 0
                while b < whole.num_rows and (b == at or size < 1 << 20):
                    size += len(whole["text"][b].as_buffer() or b"") if whole["text"][b].is_valid else 0
                    b += 1
                part = whole.slice(at, b - at)
                at = b
                rows = {x: [] for x in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if with_ids else []))}
                for doc, ids in zip(part["doc_id"].to_pylist(), encode(part["text"].to_pylist(), path)):
                    ids = memoryview(ids + last)
                    n = len(ids) // 4
                    for start in range(0, n, length):
                        piece = ids[4 * start : 4 * (start + length)]
                        for x, v in zip(rows, (doc, start, len(piece) // 4, zlib.crc32(piece), n, bytes(piece) if with_ids else None)):
                            rows[x].append(v)
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.binary() if x == "ids" else pa.int64()) for x, v in rows.items()], list(rows))

    return docs.select("doc_id", "text").mapInArrow(cut, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint" + (", ids binary" if with_ids else ""))


def sum_of_squares(sizes, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Window and place in it of each size, online."""
    count = np.zeros(length + 1, np.int64)
    count[length] = 0
    open_at: dict[int, list[int]] = {}
    window, place = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    never = np.iinfo(np.int64).max
    n = 0
    for i, s in enumerate(sizes):
        s = int(s)
        best, level = (2 * int(count[s]) + 1, 0) if s < length else (0, 0)
        top = length - s
        if top > 0:
            have = count[1 : top + 1]
            grows = 2 * (count[s + 1 : length + 1] - have) + 2
            grows[-1] -= 1  # a window that becomes full counts no more: 1 - 2n, not 2 - 2n
            grows[have == 0] = never
            at = top - 1 - int(np.argmin(grows[::-1]))
            if grows[at] <= best:
                level = at + 1
        if level:
            w = open_at[level].pop()
            count[level] -= 1
        else:
            w, n = n, n + 1
        window[i], place[i] = w, level
        if level + s < length:
            count[level + s] += 1
            open_at.setdefault(level + s, []).append(w)
    return window, place


def pack(cut: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """The pieces with sequence_id and offset. Sequences are padded to length."""
    groups = max(1, -(-cut.count() // group))

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["_order", "doc_id", "start", "ids_crc32"], kind="stable").reset_index(drop=True)
        window, place = sum_of_squares(rows["length"].to_numpy(), length)
        return rows.drop(columns=["_group", "_order"]).assign(sequence_id=window * groups + key[0], offset=place)

    order = F.xxhash64("doc_id", "start", "ids_crc32")
    dealt = cut.withColumn("_order", order).withColumn("_group", F.pmod(F.col("_order"), F.lit(groups)).cast("int"))
    # A repeated row hashes alike; its copies go to one group and are packed there one by one.
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema)
    return dealt.groupBy("_group").applyInPandas(one, f"{fields}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, path: str, length: int = LENGTH, end: int = END, with_ids: bool = False) -> DataFrame:
    return pack(staged(pieces(docs, path, length, end, with_ids), "pieces"), length)
