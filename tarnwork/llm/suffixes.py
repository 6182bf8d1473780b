"""Removal of 50-byte strings that an earlier document has too, by a distributed sparse suffix array.

Sorting every suffix would move each text fifty times over, so suffixes are first thinned without loss. Every window of
``span`` bytes names one of its ``k``-byte substrings, the one of smallest hash (the leftmost of several): its anchor.
Equal windows have equal anchors at equal places, so only anchors that come twice or more in the corpus matter. A first
exchange of sorted anchor hashes, delta-coded by hash range, finds those. For the rest:

* the run of windows around a kept anchor is a segment, at most ``2 * span - k`` bytes;
* segments are partitioned by range of the leading bytes of the suffix that starts at the anchor, between splitters
  drawn from a bounded sample (a repeated splitter is refined by the bytes that follow). An anchor that is a splitter more
  than once has segments for several ranges, which differ around it: these are cut into groups of ``GROUP`` neighbouring
  windows, and a group goes to one of those ranges by the bytes that its windows have in common;
* each range sorts the suffixes of its segments by multikey quicksort, eight bytes a step, down to ``span`` bytes, and
  compares neighbours; equal ones find their smallest doc_id. Splitters lie between different leading strings and equal
  suffixes share their anchor's, so neighbours across a boundary always differ before the anchor's end;
* a batch of texts sends equal segments once, with their smallest doc_id, so that a hot passage reaches a range no more
  often than there are batches.

Rows: a null text is empty. Rows of one doc_id never cut each other; a null doc_id comes after all others. Repeated
rows are returned each, and rows without an id are dealt by their text. Texts under ``span`` bytes stay whole; longer
ones are read a chunk at a time, however long. A span may be of 17 to 122 bytes. An empty table gives an empty result. Other columns may have any names;
they are kept only by ``deduplicate(keep_columns=True)``.
"""

from __future__ import annotations

import hashlib
import pickle

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import partitions

SPAN = 50
#: Spans whose anchors fill a leading string and whose segments' windows fit the bits of a word.
LEAST_SPAN, MOST_SPAN = 17, 122
CHUNK = 1 << 19
#: Neighbouring windows of a hot anchor that stay together.
GROUP = 3
_LAST = np.int64(2**63 - 1)
_U = np.uint64
_M = _U(0x9E3779B97F4A7C15 | 1)
_BYTE = np.random.default_rng(50).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
#: Rows (documents) that splitters are drawn from, at most, and leading strings from each of them.
SAMPLED, SAMPLED_EACH = 1_000, 50


def _power(n: int) -> np.uint64:
    return _U(pow(int(_M), n, 1 << 64))


def _mix(h: np.ndarray, by: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _U(by)
    return h ^ (h >> _U(29))


class _Rolling:
    """Hashes of all substrings of 2**i bytes of a buffer; any length is put together from them."""

    def __init__(self, buf: np.ndarray, most: int):
        self.by = {1: _BYTE[buf]}
        n = 1
        while 2 * n <= most and len(self.by[n]) > n:
            a = self.by[n]
            self.by[2 * n] = a[:-n] * _power(n) + a[n:]
            n *= 2

    def at(self, length: int, where) -> np.ndarray:
        """Of the substrings of that length that start at the places given (an array, or a number of first places)."""
        out, done = None, 0
        for n in sorted(self.by, reverse=True):
            while length - done >= n:
                a = self.by[n]
                x = a[done : done + where] if isinstance(where, int) else a[where + done]
                out = x if out is None else out * _power(n) + x
                done += n
        return out


def _sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    n = 1
    while 2 * n <= width:
        a = np.minimum(a[:-n], a[n:])
        n *= 2
    return np.minimum(a[: len(a) - (width - n)], a[width - n :]) if width > n else a


def runs(buf: np.ndarray, ends: np.ndarray, span: int, k: int, hashes: bool = False) -> dict[str, np.ndarray]:
    """Runs of windows with one anchor: first and last window start, anchor's place, anchor's 48-bit id.

    ends: where each text in buf ends. hashes: also those of the first and last window.
    """
    out: dict[str, list] = {x: [] for x in ("first", "last", "anchor", "id", *(("a", "b") if hashes else ()))}
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    turn = np.zeros(len(buf) + 1, np.int8)
    long = ends - starts >= span
    turn[starts[long]] += 1
    turn[ends[long] - span + 1] -= 1
    valid_all = np.cumsum(turn, dtype=np.int8)
    for at in range(0, max(0, len(buf) - span + 1), CHUNK):
        n = min(CHUNK, len(buf) - span + 1 - at)  # windows of this chunk
        valid = valid_all[at : at + n].astype(bool)
        if not valid.any():
            continue
        rolling = _Rolling(buf[at : at + n + span - 1], 16)
        grams = rolling.at(k, n + span - k)
        chosen = _sliding_min((_mix(grams) >> _U(24) << _U(24)) | np.arange(len(grams), dtype=np.uint64), span - k + 1)[:n]
        anchor = (chosen & _U(0xFFFFFF)).astype(np.int64)
        edge = np.flatnonzero((anchor[1:] != anchor[:-1]) | (valid[1:] != valid[:-1])) + 1
        first, last = np.concatenate([[0], edge]), np.concatenate([edge, [n]]) - 1
        first, last = first[valid[first]], last[valid[first]]
        p = anchor[first]
        out["first"].append(first + at)
        out["last"].append(last + at)
        out["anchor"].append(p + at)
        out["id"].append(_mix(grams[p], 0xA0761D6478BD642F) >> _U(16))
        if hashes:
            out["a"].append(rolling.at(span, first))
            out["b"].append(rolling.at(span, last))
    return {x: np.concatenate(v) if v else np.zeros(0, np.uint64 if x in ("id", "a", "b") else np.int64) for x, v in out.items()}


def _pack(*arrays) -> bytes:
    raw = pickle.dumps([np.ascontiguousarray(a) for a in arrays], protocol=5)
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def _unpack(blob: bytes) -> list[np.ndarray]:
    return pickle.loads(pa.Codec("zstd").decompress(blob[8:], int.from_bytes(blob[:8], "little"), asbytes=True))


def _planes(sorted_ids: np.ndarray) -> np.ndarray:
    """The six low bytes of each difference, as planes; those of the high bytes are nearly empty and pack well."""
    d = np.diff(sorted_ids, prepend=_U(0))
    return np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8)[:, :6].T)


def _from_planes(planes: np.ndarray) -> np.ndarray:
    d = np.zeros((planes.shape[1], 8), np.uint8)
    d[:, :6] = planes.T
    return np.cumsum(d.view(np.uint64).ravel(), dtype=np.uint64)


def _texts(docs: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
    """Rows in the order of (doc_id, text), all their bytes, each text's end, each doc_id."""
    docs = docs.take(pc.sort_indices(docs, sort_keys=[("doc_id", "ascending"), ("text", "ascending")]))
    text = pc.fill_null(docs["text"].cast(pa.large_binary()), b"").combine_chunks()
    text = text.chunk(0) if isinstance(text, pa.ChunkedArray) and text.num_chunks else text
    if not docs.num_rows:
        return docs, np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
    offsets = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1, text.offset * 8)
    data = text.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return docs, buf, offsets[1:] - offsets[0], pc.fill_null(docs["doc_id"].cast(pa.int64()), int(_LAST)).to_numpy()


def _words(buf: bytes) -> np.ndarray:
    """The eight bytes from each place on, first byte highest."""
    return np.ndarray((len(buf) - 7,), ">u8", buf, strides=(1,))


def multikey_sort(words: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at starts, cut at length bytes, and where each run of equal ones begins in that order.

    One step a word of eight bytes. A group in which all have the same next word is left as it stands; only the groups
    that fall apart are sorted on.
    """
    key = words[starts].astype(np.uint64)
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
    for depth in range(8, length, 8):
        key = words[starts[order] + depth].astype(np.uint64)
        if length - depth < 8:
            key >>= _U(8 * (8 - (length - depth)))
        differs = np.concatenate([[False], key[1:] != key[:-1]]) & ~new
        if differs.any():
            group = np.cumsum(new) - 1
            torn = np.zeros(group[-1] + 1, bool)
            torn[group[differs]] = True
            at = np.flatnonzero(torn[group])
            at_sorted = at[np.lexsort((key[at], group[at]))]
            order[at], key[at] = order[at_sorted], key[at_sorted]
            new |= np.concatenate([[True], key[1:] != key[:-1]])
    return order, np.flatnonzero(new)


def _place(w1, w2, s1, s2) -> np.ndarray:
    """Number of splitters at or below each (first, second) leading word."""
    lo, hi = np.searchsorted(s1, w1, "left"), np.searchsorted(s1, w1, "right")
    for i in np.flatnonzero(hi - lo > 0) if len(s1) else ():
        lo[i] += np.searchsorted(s2[lo[i] : hi[i]], w2[i], "right")
    return lo


def _lead(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    words = _words(buf.tobytes() + bytes(16))
    return words[at].astype(np.uint64), words[at + 8].astype(np.uint64)


def _hashes(buf: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Of the strings of that length at the places given, a few at a time."""
    powers = np.array([pow(int(_M), length - 1 - i, 1 << 64) for i in range(length)], np.uint64)
    out = np.empty(len(starts), np.uint64)
    for a in range(0, len(starts), 1 << 14):
        at = starts[a : a + (1 << 14), None] + np.arange(length)
        out[a : a + (1 << 14)] = (_BYTE[buf[at]] * powers).sum(axis=1, dtype=np.uint64)
    return out


def _hot(s1: np.ndarray, s2: np.ndarray) -> tuple[np.ndarray, ...]:
    """Leading words that are splitters more than once, the first range that is theirs, and how many are."""
    new = np.flatnonzero(np.concatenate([[True], (s1[1:] != s1[:-1]) | (s2[1:] != s2[:-1])])) if len(s1) else np.zeros(0, np.int64)
    many = np.diff([*new, len(s1)])
    at = new[many > 1]
    return s1[at], s2[at], at + 1, many[many > 1]


def _hot_of(w1: np.ndarray, w2: np.ndarray, hot: tuple[np.ndarray, ...]) -> np.ndarray:
    """Which of the hot leading words each is; -1 for none. There are fewer of them than ranges."""
    out = np.full(len(w1), -1)
    likely = np.flatnonzero(np.isin(w1, hot[0])) if len(hot[0]) else ()
    for i, (a, b) in enumerate(zip(hot[0], hot[1]) if len(likely) else ()):
        out[likely[(w1[likely] == a) & (w2[likely] == b)]] = i
    return out


def _splitters(docs: DataFrame, parts: int, span: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """parts - 1 quantiles of the leading words of the anchored suffixes of a bounded sample of documents, rows without ids
    and repeated ones alike. Equal segments of the sample, which a batch sends once, count once."""

    def leads(batches):
        for b in batches:
            _, buf, ends, _ = _texts(pa.Table.from_batches([b]))
            r = runs(buf, ends, span, k, hashes=True)
            keep = np.argsort(r["id"], kind="stable")[: SAMPLED_EACH * b.num_rows]
            w1, w2 = _lead(buf, r["anchor"][keep])
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (w1, w2, r["a"][keep] ^ _mix(r["b"][keep]))], ["w1", "w2", "segment"])

    n = docs.count()
    some = docs.sample(min(1.0, SAMPLED / n), seed=7).limit(2 * SAMPLED) if n > SAMPLED else docs
    rows = some.mapInArrow(leads, "w1 bigint, w2 bigint, segment bigint").toPandas().drop_duplicates()
    w1, w2 = (rows[c].to_numpy(np.int64).view(np.uint64) for c in ("w1", "w2"))
    order = np.lexsort((w2, w1))
    at = order[(np.arange(1, parts) * len(order)) // parts] if len(order) else order
    return w1[at], w2[at]


def deduplicate(docs: DataFrame, span: int = SPAN, keep_columns: bool = False, batch_bytes: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans; with keep_columns instead all columns of docs, text cut.

    spans: array of (start, end) in bytes of the text as it came. A text cut inside a character loses the rest of it in
    the text returned, not in kept_sha256.
    """
    if not LEAST_SPAN <= span <= MOST_SPAN:
        raise ValueError(f"a span is of {LEAST_SPAN} to {MOST_SPAN} bytes")
    spark, names = docs.sparkSession, docs.columns
    # Names of our own on the way: groups in Arrow can't have all names that tables can.
    docs = docs.toDF(*(c if c in ("doc_id", "text") else f"_{i}" for i, c in enumerate(names)))
    k = max(16, span // 2 - 1)
    narrow = docs.select("doc_id", "text")
    total = narrow.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    batch_bytes = batch_bytes or min(1 << 24, max(1 << 20, total // 256))
    n_batches = max(1, -(-total // batch_bytes))
    parts = partitions(spark)
    n_ranges = max(parts, total // (1 << 26))  # of anchor hashes: about 4 million in each
    n_sorted = max(parts, total // (1 << 25))  # of leading strings: an eighth of the text repeated makes them 20 MB or so each
    s1, s2 = _splitters(narrow, n_sorted, span, k)
    hot = _hot(s1, s2)
    deal = "_batch"
    by_batch = (docs if keep_columns else narrow).withColumn(deal, F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_batches)).cast("int"))

    def distinct_ids(r):
        ids, counts = np.unique(r["id"], return_counts=True)
        return ids, counts

    def cuts(ids):
        return np.searchsorted(ids, (np.arange(1, n_ranges, dtype=object) * (1 << 48) // n_ranges).astype(np.uint64)) if n_ranges > 1 else np.zeros(0, np.int64)

    def send_ids(key, table):
        _, buf, ends, _ = _texts(table)
        ids, counts = distinct_ids(runs(buf, ends, span, k))
        at = [0, *cuts(ids), len(ids)]
        rows = [(i, key[0].as_py(), _pack(_planes(ids[a:b]), np.packbits(counts[a:b] > 1))) for i, (a, b) in enumerate(zip(at, at[1:])) if b > a]
        return pa.table([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int32(), pa.int32(), pa.binary()))], ["_range", "_batch", "blob"])

    def find_repeats(key, table):
        """Of each batch's anchors in this range of hashes: does one come again, here or in another batch?"""
        parts = [_unpack(x) for x in table["blob"].to_pylist()]
        ids = [_from_planes(p) for p, _ in parts]
        again = np.concatenate([np.unpackbits(m, count=len(i)) for i, (_, m) in zip(ids, parts)]).astype(bool)
        every = np.concatenate(ids)
        order = np.argsort(every, kind="stable")
        same = every[order[1:]] == every[order[:-1]]
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        at = np.cumsum([0, *map(len, ids)])
        masks = [np.packbits(again[a:b]).tobytes() for a, b in zip(at, at[1:])]
        return pa.table([pa.array([key[0].as_py()] * len(ids), pa.int32()), table["_batch"].combine_chunks(), pa.array(masks, pa.binary())], ["_range", "_batch", "blob"])

    def send_segments(key, table, masks):
        _, buf, ends, doc_ids = _texts(table)
        r = runs(buf, ends, span, k, hashes=True)
        ids, _ = distinct_ids(r)
        at = [0, *cuts(ids), len(ids)]
        again = np.zeros(len(ids), bool)
        for i, blob in zip(masks["_range"].to_pylist(), masks["blob"].to_pylist()):
            a, b = at[i], at[i + 1]
            again[a:b] = np.unpackbits(np.frombuffer(blob, np.uint8), count=b - a).astype(bool)
        keep = np.flatnonzero(again[np.searchsorted(ids, r["id"])]) if len(ids) else np.zeros(0, np.int64)
        first, last, anchor, a_hash, b_hash = (r[x][keep] for x in ("first", "last", "anchor", "a", "b"))
        of_hot = _hot_of(*_lead(buf, anchor), hot) if len(hot[0]) else np.full(len(keep), -1)
        whole, torn = of_hot < 0, np.flatnonzero(of_hot >= 0)
        # Runs around a hot anchor: a piece for each group of windows, numbered by how far before the anchor they start.
        nearest, groups = (anchor - last)[torn] // GROUP, (anchor - first)[torn] // GROUP - (anchor - last)[torn] // GROUP + 1
        piece = np.repeat(torn, groups)
        group = np.repeat(nearest, groups) + np.arange(len(piece)) - np.repeat(np.cumsum(groups) - groups, groups)
        end = anchor[piece] - group * GROUP
        begin, end = np.maximum(first[piece], end - GROUP + 1), np.minimum(last[piece], end)
        common = _hashes(buf, anchor[piece] - group * GROUP, span - GROUP + 1)
        goes_hot = np.concatenate([np.full(int(whole.sum()), -1), hot[2][of_hot[piece]] + (_mix(common) % hot[3][of_hot[piece]].astype(np.uint64)).astype(np.int64)]) if len(piece) else np.full(len(first), -1)
        if len(piece):
            first, last, anchor = (np.concatenate([x[whole], y]) for x, y in ((first, begin), (last, end), (anchor, anchor[piece])))
            a_hash, b_hash = (np.concatenate([x[whole], _hashes(buf, y, span)]) for x, y in ((a_hash, begin), (b_hash, end)))
            by_place = np.argsort(first, kind="stable")
            first, last, anchor, a_hash, b_hash, goes_hot = (x[by_place] for x in (first, last, anchor, a_hash, b_hash, goes_hot))
        doc = doc_ids[np.searchsorted(ends, first, "right")] if len(first) else np.zeros(0, np.int64)
        # Equal segments: both outermost windows are, and together they cover it. Rows are in the order of doc_id.
        same = np.stack([a_hash, b_hash, ((last - first) * 64 + anchor - first).astype(np.uint64)])
        order = np.lexsort(same)
        new = np.concatenate([[True], (same[:, order[1:]] != same[:, order[:-1]]).any(axis=0)]) if len(order) else np.zeros(0, bool)
        rep_sorted = np.cumsum(new) - 1
        rep = np.empty(len(order), np.int64)
        rep[order] = rep_sorted
        lead = order[new]  # lexsort is stable: of equal segments the first, of the smallest doc_id
        w1, w2 = _lead(buf, anchor[lead])
        goes = np.where(goes_hot[lead] >= 0, goes_hot[lead], _place(w1, w2, s1, s2))
        by_range = np.argsort(goes, kind="stable")
        bounds = np.flatnonzero(np.concatenate([[True], goes[by_range][1:] != goes[by_range][:-1]])) if len(lead) else np.zeros(0, np.int64)
        of_range = np.empty(len(lead), np.int64)
        of_range[by_range] = np.repeat(np.arange(len(bounds)), np.diff([*bounds, len(lead)]))
        within = np.empty(len(lead), np.int64)
        within[by_range] = np.arange(len(lead)) - np.repeat(bounds, np.diff([*bounds, len(lead)]))
        occ_order = np.argsort(of_range[rep], kind="stable") if len(rep) else rep
        occ_bounds = np.searchsorted(of_range[rep][occ_order], np.arange(len(bounds) + 1)) if len(rep) else [0]
        rows = []
        for j, (a, b) in enumerate(zip(bounds, [*bounds[1:], len(lead)])):
            segs, occ = lead[by_range[a:b]], occ_order[occ_bounds[j] : occ_bounds[j + 1]]
            sizes = last[segs] - first[segs] + span
            at_byte = np.repeat(first[segs] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
            whole = doc[occ] != doc[lead[rep[occ]]]  # an earlier document of this batch has the same segment
            rows.append((int(goes[by_range[a]]), key[0].as_py(), _pack(doc[segs], sizes.astype(np.uint8), (anchor[segs] - first[segs]).astype(np.uint8), buf[at_byte], within[rep[occ]].astype(np.uint32), first[occ].astype(np.int64), whole)))
        return pa.table([pa.array([x[c] for x in rows], t) for c, t in enumerate((pa.int32(), pa.int32(), pa.binary()))], ["_range", "_batch", "blob"])

    def compare(table):
        """Removed windows of each occurrence of each segment in this range of leading strings."""
        parts = [_unpack(x) for x in table["blob"].to_pylist()]
        doc = np.concatenate([p[0] for p in parts])
        sizes = np.concatenate([p[1] for p in parts]).astype(np.int64)
        pre = np.concatenate([p[2] for p in parts]).astype(np.int64)
        flat = np.concatenate([p[3] for p in parts]).tobytes() + bytes(16)
        words = _words(flat)
        begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        mask = np.zeros(len(doc), np.uint64)
        lead = words[begin + pre].astype(np.uint64)
        order = np.argsort(lead, kind="stable")
        edge = np.flatnonzero(np.concatenate([[True], lead[order][1:] != lead[order][:-1]]))
        at = 0
        while at < len(order):  # by slices between different leading words, so that memory stays bounded
            i = np.searchsorted(edge, at + 100_000)
            to = int(edge[i]) if i < len(edge) else len(order)
            if to <= at:
                to = len(order)
            segs = order[at:to]
            many = sizes[segs] - span + 1
            of = np.repeat(np.arange(len(segs)), many)
            nth = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
            sort, group = multikey_sort(words, begin[segs][of] + nth, span)
            d = doc[segs][of]
            least = np.repeat(np.minimum.reduceat(d[sort], group), np.diff([*group, len(sort)]))
            gone = np.zeros(len(of), np.uint64)
            gone[sort] = (d[sort] > least).astype(np.uint64)
            mask[segs] = np.add.reduceat(gone << nth.astype(np.uint64), np.cumsum(many) - many)
            at = to
        rows, base = [], 0
        for batch, p in zip(table["_batch"].to_pylist(), parts):
            rep = p[4].astype(np.int64) + base
            hit = np.where(p[6], (_U(1) << (sizes[rep] - span + 1).astype(np.uint64)) - _U(1), mask[rep])
            some = hit > 0
            if some.any():
                rows.append((batch, _pack(p[5][some], hit[some])))
            base += len(p[0])
        return pa.table([pa.array([x[c] for x in rows], t) for c, t in enumerate((pa.int32(), pa.binary()))], ["_batch", "blob"])

    def cut(key, table, hits):
        docs, buf, ends, _ = _texts(table)
        parts = [_unpack(x) for x in hits["blob"].to_pylist()]
        gone = np.zeros(0, np.int64)
        if parts:
            first, mask = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            gone = np.unique(np.concatenate([first[(mask >> _U(i)) & _U(1) > 0] + i for i in range(span - k + 1)]))
        of = np.searchsorted(ends, gone, "right")
        new = np.concatenate([[True], (gone[1:] > gone[:-1] + span) | (of[1:] != of[:-1])]) if len(gone) else np.zeros(0, bool)
        a = gone[new]
        b = gone[np.concatenate([new[1:], [True]])] + span if len(gone) else gone
        of = of[new]
        starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        lo, hi = np.searchsorted(of, np.arange(len(ends))), np.searchsorted(of, np.arange(len(ends)), "right")
        raw = memoryview(buf.tobytes())
        kept, shas, spans = [], [], []
        for i in range(len(ends)):
            pieces, at = [], starts[i]
            for j in range(lo[i], hi[i]):
                pieces.append(raw[at : a[j]])
                at = b[j]
            pieces.append(raw[at : ends[i]])
            if keep_columns:
                kept.append(b"".join(pieces).decode("utf-8", "ignore"))
            else:
                h = hashlib.sha256()
                for p in pieces:
                    h.update(p)
                shas.append(h.hexdigest())
                spans.append([{"start": int(a[j] - starts[i]), "end": int(b[j] - starts[i])} for j in range(lo[i], hi[i])])
        if keep_columns:
            docs = docs.drop_columns([deal])
            return docs.set_column(docs.schema.get_field_index("text"), "text", pa.array(kept, pa.string()))
        removed = np.zeros(len(ends), np.int64)
        np.add.at(removed, of, b - a)
        return pa.table(
            {
                "doc_id": docs["doc_id"], "n_bytes": pa.array(ends - starts, pa.int64()), "n_removed": pa.array(removed), "n_spans": pa.array(hi - lo, pa.int64()),
                "kept_sha256": pa.array(shas, pa.string()), "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            }
        )

    ranged = "_range int, _batch int, blob binary"
    # The exchange of texts by batch is the same in all three uses, and Spark runs it once.
    again = by_batch.select("doc_id", "text", deal).groupBy(deal).applyInArrow(send_ids, ranged).groupBy("_range").applyInArrow(find_repeats, ranged)
    segments = by_batch.select("doc_id", "text", deal).groupBy(deal).cogroup(again.groupBy("_batch")).applyInArrow(send_segments, ranged)
    hits = segments.groupBy("_range").applyInArrow(compare, "_batch int, blob binary")
    if keep_columns:
        out = docs.schema
    else:
        out = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<start: bigint, end: bigint>>"
    done = by_batch.groupBy(deal).cogroup(hits.groupBy("_batch")).applyInArrow(cut, out)
    return done.toDF(*names) if keep_columns else done
