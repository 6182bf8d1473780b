"""N-gram Jaccard join by vertical partitioning of the global n-gram order.

The global order is that of 64-bit n-gram hashes. Two cuts of it are used.

*Candidates.* For sets of up to U grams, linked pairs differ in at most d = 2U(1-t)/(1+t) grams, so if the order is cut
into more than d fragments, some fragment holds the same grams of both. Every set sends a signature of each fragment,
by size class (own and next, so that every pair of linkable sizes shares a cut). With half as many spare fragments a linked
pair has a third of them equal, and at least one that isn't empty, unless a set leaves more than the spare ones empty; such sets
send the empty ones too. No pair is lost, and no gram is too frequent: equal fragments, not common grams, make
candidates, and a set that shares too few of them with others is out.

*Overlaps.* The order is cut into ``FRAGMENTS`` ranges; for each candidate pair the overlap is counted in each range
on its own, and the partial counts are summed per pair and held against the threshold.

Sets, not documents, are joined: equal sets are one node, however many documents have them. Sets that chains of common
signatures join are a family; each is held against the family's hub first, the set with most common signatures, and what
that leaves of a large family against further hubs, while these link a share of it: each cluster of near copies gets a hub
of its own. Links that this leaves out are then found from how the members differ from the first hub (see ``between``),
without trying all pairs.

Nothing is gathered by key in one task: signatures are rows, combined before they are shuffled; what meets a hot
signature is a table, so that Spark splits its rows; and a family's members meet their hub in shares of ``FAMILY`` sets,
each with a copy of the hub's grams.

Rows: a null text has no words. A text of fewer words than the gram is one gram of all its words; without words the set
is empty, linked with nothing, and its component is its own doc_id. Repeated rows are linked like any equal sets. A null
doc_id never names a component unless all its members are null. A pair just at the threshold is linked. Texts of any
length are read whole. An empty table gives no rows. Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import discard, staged
from .suffixes import _mix

#: Rounds in which sets without enough common signatures go.
PRUNED = 3
FRAGMENTS = 8
BATCH_BYTES = 1 << 19
#: Signatures that a task gathers before it sends each different one on; members of a family that share a copy of the hub.
GATHERED, FAMILY = 1 << 18, 512
#: Members that a family's hubs leave out before it gets another hub, and one in how many of them the last hub must have linked.
LEFT_OUT, WORTH = 64, 16
_U = np.uint64
_B = 0x9E3779B97F4A7C55
_BYTES = np.random.default_rng(3).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return _made_powers(1 << 20) if n <= 1 << 20 else _made_powers.__wrapped__(n)  # those of longer texts aren't kept


@functools.lru_cache(1)
def _made_powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _U(_B)), np.full(n, _U(pow(_B, -1, 1 << 64)))
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def word_hashes(buf: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each whitespace word (A-Z lowered) of the texts in buf, and the text it is in."""
    if not len(buf):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inside = ~_SPACE[buf]
    starts = np.concatenate([[0], ends[:-1]])
    starts = starts[starts < len(buf)]
    before, after = np.empty_like(inside), np.empty_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[starts] = False
    after[-1] = False
    after[starts[starts > 0] - 1] = False
    a, b = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    up, down = _powers(len(buf))
    sums = np.empty(len(buf) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTES[_LOWER[buf]] * up[: len(buf)], out=sums[1:])
    return _mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64) * _U(0xC2B2AE3D27D4EB4F)), np.searchsorted(ends, a, "right")


def sets(buf: np.ndarray, ends: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-gram hashes of each text, sorted within it, one text after the other; where each text's end."""
    words, of = word_hashes(buf, ends)
    n = np.bincount(of, minlength=len(ends))
    at = np.cumsum(n) - n
    grams, g_of = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(words) >= k:
        full = of[k - 1 :] == of[: len(of) - k + 1]
        mixed = sum((words[i : len(words) - k + 1 + i] * _U(pow(0xFF51AFD7ED558CCD, i + 1, 1 << 64)) for i in range(k)), np.zeros(len(words) - k + 1, np.uint64))
        grams, g_of = _mix(mixed[full]), of[: len(of) - k + 1][full]
    few = np.flatnonzero((n > 0) & (n < k))
    if len(few):
        h = np.zeros(len(few), np.uint64)
        for i in range(k - 1):
            has = n[few] > i
            h[has] += words[at[few[has]] + i] * _U(pow(0xFF51AFD7ED558CCD, i + 1, 1 << 64))
        grams, g_of = np.concatenate([grams, _mix(h + n[few].astype(np.uint64) * _U(0x9FB21C651E98DF25))]), np.concatenate([g_of, few])
        order = np.argsort(g_of, kind="stable")
        grams, g_of = grams[order], g_of[order]
    to = np.cumsum(np.bincount(g_of, minlength=len(ends)))
    a = 0
    for b in to:
        grams[a:b].sort()
        a = b
    new = np.concatenate([[True], (grams[1:] != grams[:-1]) | (g_of[1:] != g_of[:-1])]) if len(grams) else np.zeros(0, bool)
    return grams[new], np.cumsum(np.bincount(g_of[new], minlength=len(ends)))


def set_hash(grams: np.ndarray, to: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set, 0 for empty ones."""
    sums = np.concatenate([[_U(0)], np.cumsum(_mix(grams, 0x8EBC6AF09C88C6E3), dtype=np.uint64)])
    n = np.diff(to, prepend=0)
    return np.where(n > 0, _mix(sums[to] - sums[to - n] + n.astype(np.uint64) * _U(0xE7037ED1A0B428DB)), _U(0))


@functools.lru_cache(8)
def _classes(num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least size, number of differing grams, and spare fragments of each size class."""
    least, differ, low = [], [], 1
    while low < 1 << 40:
        high = low * den // num
        least.append(low)
        differ.append(2 * high * (den - num) // (den + num))
        low = high + 1
    return np.array(least), np.array(differ), np.maximum(np.array(differ) // 2, 2)


def signatures(grams: np.ndarray, to: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """48-bit signatures of the fragments of each set, and the set each is of; and how many a linked pair shares.

    A signature's last bit is its class's, so it tells a set's own class from the next. The third result has, for each
    set and last bit, the number of signatures that the set shares with any set it is linked with in that class.
    """
    least, differ, spares = _classes(num, den)
    n = np.diff(to, prepend=0)
    own = np.searchsorted(least, n, "right") - 1
    of = np.repeat(np.arange(len(to)), n)
    weight = np.concatenate([[_U(0)], np.cumsum(_mix(grams, 0x589965CC75374CC3), dtype=np.uint64)])
    sigs, owners, need = [], [], np.ones((len(to), 2), np.int32)
    for step in (0, 1):
        c = np.maximum(own + step, 0)
        spare = spares[c]
        m = np.where((n > 0) & (differ[c] > 0), differ[c] + 1 + spare, 0)
        at = np.flatnonzero(m[of] > 0)
        if not len(at):
            continue
        part = ((grams[at] >> _U(32)) * m[of[at]].astype(np.uint64)) >> _U(32)
        edge = np.concatenate([[True], (part[1:] != part[:-1]) | (of[at][1:] != of[at][:-1])])
        first = np.flatnonzero(edge)
        begin, end = at[first], np.concatenate([at[first[1:] - 1], [at[-1]]]) + 1
        owner = of[begin]
        tag = lambda part, owner: part * _U(0x1D8E4E27C47D124F) + c[owner].astype(np.uint64) * _U(0xEB44ACCAB455D165)
        named = lambda x, owner: ((_mix(x + tag(*owner)) >> _U(17)) << _U(1)) | (c[owner[1]] & 1).astype(np.uint64)
        sigs.append(named(weight[end] - weight[begin], (part[first], owner)))
        owners.append(owner)
        empty = m - np.bincount(owner, minlength=len(to))
        need[np.arange(len(to)), c & 1] = np.where(empty <= spare, spare + 1 - empty, 1)
        for i in np.flatnonzero(empty > spare):
            gone = np.setdiff1d(np.arange(m[i], dtype=np.uint64), part[first][owner == i])
            sigs.append(named(np.zeros(len(gone), np.uint64), (gone, np.full(len(gone), i))))
            owners.append(np.full(len(gone), i))
    if not sigs:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), need
    return np.concatenate(sigs), np.concatenate(owners), need


def _buffers(batches, size: int = BATCH_BYTES):
    """(table, bytes, ends) of about that many bytes of text; a longer text comes alone or last."""

    def made(held):
        t = pa.Table.from_batches(held)
        text = pc.fill_null(t["text"].cast(pa.large_binary()), b"").combine_chunks()
        text = text.chunk(0) if isinstance(text, pa.ChunkedArray) else text
        offsets = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1, text.offset * 8)
        data = text.buffers()[2]
        return t, np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8), offsets[1:] - offsets[0]

    held, n = [], 0
    for b in batches:
        at = 0
        sizes = pc.fill_null(pc.binary_length(b.column(b.schema.get_field_index("text"))), 0).to_numpy(zero_copy_only=False)
        for i, s in enumerate(sizes):
            n += int(s)
            if n >= size:
                held.append(b.slice(at, i + 1 - at))
                yield made(held)
                held, n, at = [], 0, i + 1
        if at < b.num_rows:
            held.append(b.slice(at))
    if held:
        yield made(held)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


_SENT = "doc_id bigint, text_hash bigint, n_shingles bigint, node bigint, need_0 int, need_1 int, run bigint, member bigint"
_KINDS = {"bigint": pa.int64(), "int": pa.int32()}


def _sent(**columns) -> pa.RecordBatch:
    """Rows of _SENT of one kind: the columns given, all others null."""
    n = len(next(iter(columns.values())))
    names = [x.split() for x in _SENT.split(", ")]
    return pa.RecordBatch.from_arrays([columns[x].cast(_KINDS[t]) if x in columns else pa.nulls(n, _KINDS[t]) for x, t in names], [x for x, _ in names])


def send_all(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """One pass over the texts. Rows of two kinds: what each document's set is; and (run, member), a signature and a set that
    has it, once for some hundred thousand signatures."""

    def gathered(held):
        sig, node = map(np.concatenate, zip(*held))
        order = np.lexsort((node, sig))
        sig, node = sig[order], node[order]
        keep = np.concatenate([[True], (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])]) if len(sig) else np.zeros(0, bool)
        return _sent(run=_signed(sig[keep]), member=_signed(node[keep]))

    def send(batches):
        held, n = [], 0
        for t, buf, ends in _buffers(batches):
            grams, to = sets(buf, ends, k)
            names = set_hash(grams, to)
            sig, own, need = signatures(grams, to, num, den)
            yield _sent(
                doc_id=t["doc_id"].combine_chunks(), text_hash=t["text_hash"].combine_chunks(), n_shingles=pa.array(np.diff(to, prepend=0)), node=_signed(names), need_0=pa.array(need[:, 0]), need_1=pa.array(need[:, 1])
            )
            held.append((sig, names[own]))
            n += len(sig)
            if n >= GATHERED:
                yield gathered(held)
                held, n = [], 0
        if held:
            yield gathered(held)

    return staged(docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(send, _SENT), "ngram-signatures")


def _shared(members: DataFrame) -> DataFrame:
    """run, node of the runs that come more than once: of different rows, those that several sets have."""
    several = members.groupBy("run").agg(F.count("*").alias("_n")).filter("_n > 1").select("run")
    return members.join(staged(several, "ngram-runs"), "run", "left_semi")


def candidates(sent: DataFrame) -> DataFrame:
    """run, node: the sets of each signature that several have, without those that can't be linked with any.

    A linked pair shares at least as many signatures of a class as each of the two needs, so a set that has fewer
    signatures with others goes; then others may have fewer, and so on, for PRUNED rounds.
    """
    # A set of many copies is sent more than once with one run, so what is left, each once, must share runs as well. Table
    # by table, so that the shuffle files of one step are gone when the next writes its own.
    first = staged(_shared(sent.filter(F.col("run").isNotNull()).select("run", F.col("member").alias("node"))), "ngram-members")
    once = staged(first.distinct(), "ngram-members")
    discard(first)
    members = staged(_shared(once), "ngram-members")
    discard(once)
    needs = sent.filter(F.col("need_0").isNotNull()).groupBy("node").agg(F.min("need_0").alias("need_0"), F.min("need_1").alias("need_1"))
    needs = staged(needs.join(members.select("node").distinct(), "node", "left_semi"), "ngram-needs")
    for _ in range(PRUNED):
        side = F.pmod("run", F.lit(2))
        enough = members.groupBy("node", side.alias("side")).agg(F.count("*").alias("_n")).join(needs, "node").filter(F.col("_n") >= F.when(F.col("side") == 0, F.col("need_0")).otherwise(F.col("need_1")))
        kept = members.withColumn("side", side).join(enough.select("node", "side"), ["node", "side"], "left_semi").select("run", "node")
        before, members = members, staged(_shared(kept), "ngram-members")
        discard(before)
    # The rarest signature that a linked pair shares is among all but need - 1 of each set's, rarest first: the others,
    # which common passages make, needn't join sets into families.
    size = staged(members.groupBy("run").agg(F.count("*").alias("_c")), "ngram-run-sizes")
    own = Window.partitionBy("node", "side")
    ranked = members.withColumn("side", F.pmod("run", F.lit(2))).join(size, "run")
    ranked = ranked.withColumn("_i", F.row_number().over(own.orderBy("_c", "run"))).withColumn("_n", F.count("*").over(own)).join(needs, "node")
    first = ranked.filter(F.col("_i") <= F.col("_n") - F.when(F.col("side") == 0, F.col("need_0")).otherwise(F.col("need_1")) + 1).select("run", "node")
    out = staged(_shared(first), "ngram-members")
    discard(members, needs, size)
    return out


def fragments(docs: DataFrame, k: int) -> DataFrame:
    """node, n, part, grams: the hashes of each set in each of FRAGMENTS ranges of the global order."""

    def cut(batches):
        for _, buf, ends in _buffers(batches):
            grams, to = sets(buf, ends, k)
            n = np.diff(to, prepend=0)
            names = set_hash(grams, to)
            step = (np.arange(1, FRAGMENTS, dtype=object) * (1 << 64) // FRAGMENTS).astype(np.uint64)
            at = np.concatenate([np.concatenate([[b - c], b - c + np.searchsorted(grams[b - c : b], step)]) for b, c in zip(to, n)] + [[len(grams)]]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(at), _signed(grams))
            yield pa.RecordBatch.from_arrays([_signed(np.repeat(names, FRAGMENTS)), pa.array(np.repeat(n, FRAGMENTS)), pa.array(np.tile(np.arange(FRAGMENTS, dtype=np.int32), len(to))), lists], ["node", "n", "part", "grams"])

    return docs.select("text").mapInArrow(cut, "node bigint, n bigint, part int, grams array<bigint>")


def _hubs(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """facts of the hubs (node) as a and s: a copy for each share of the hub's family."""
    return pairs.select("a", "s").distinct().join(facts.withColumnRenamed("node", "a"), "a")


def overlaps(pairs: DataFrame, parts: DataFrame, num: int, den: int) -> DataFrame:
    """a, b of the pairs (a, b, s) that are linked: partial overlaps counted in each range, then summed per pair."""
    sizes = parts.filter(F.col("part") == 0).select("node", "n")
    fit = pairs.join(_hubs(pairs, sizes.withColumnRenamed("n", "n_a")), ["a", "s"]).join(sizes.select(F.col("node").alias("b"), F.col("n").alias("n_b")), "b")
    fit = fit.filter(F.lit(den) * F.least("n_a", "n_b") >= F.lit(num) * F.greatest("n_a", "n_b")).select("a", "b", "s", "n_a", "n_b")
    left = _hubs(pairs, parts.select("node", "part", F.col("grams").alias("grams_a")))
    right = parts.select(F.col("node").alias("b"), "part", F.col("grams").alias("grams_b"))
    counted = fit.join(left, ["a", "s"]).join(right, ["b", "part"]).select("a", "b", "n_a", "n_b", F.size(F.array_intersect("grams_a", "grams_b")).alias("same"))
    same = F.col("same")
    return counted.groupBy("a", "b").agg(F.max("n_a").alias("n_a"), F.max("n_b").alias("n_b"), F.sum("same").alias("same")).filter(F.lit(den) * same >= F.lit(num) * (F.col("n_a") + F.col("n_b") - same)).select("a", "b")


def families(members: DataFrame) -> DataFrame:
    """a, b, s: each set (b) and the hub (a) of its family, the sets that chains of common signatures join, and the share of
    the family that the set is in. The hub is the set with most common signatures."""
    degree = staged(members.groupBy("node").agg(F.count("*").alias("_n")), "ngram-degrees")
    first = staged(members.groupBy("run").agg(F.min("node").alias("a")), "ngram-firsts")
    joined = components(members.join(first, "run").select("a", F.col("node").alias("b")))
    family = staged(joined.join(degree, "node"), "ngram-families")
    hub = family.groupBy("label").agg(F.max(F.struct("_n", "node")).alias("_m"), F.count("*").alias("_all")).select("label", F.col("_m.node").alias("a"), F.ceil(F.col("_all") / FAMILY).alias("_shares"))
    return family.join(staged(hub, "ngram-hubs"), "label").filter("node <> a").select("a", F.col("node").alias("b"), F.pmod(F.xxhash64("node"), F.col("_shares")).alias("s"))


def further_hubs(pairs: DataFrame, links: DataFrame, parts: DataFrame, num: int, den: int) -> DataFrame:
    """a, b: links of sets that their family's hub is not linked with. Of a family with many such, one is the next hub, and
    the others are held against it; what that leaves out goes on, as long as each hub links its share. A cluster of near
    copies is linked as a whole when one of it is the hub. Small rests, and families that fall apart into many, are left."""
    left = staged(pairs.join(links, ["a", "b"], "left_anti").select(F.col("a").alias("family"), "b"), "ngram-left")
    found = []
    while True:
        order = F.struct(F.xxhash64("b"), "b")
        hub = left.groupBy("family").agg(F.count("*").alias("_all"), F.min(order).alias("_h")).filter(F.col("_all") >= LEFT_OUT)
        hub = staged(hub.select("family", "_all", F.col("_h.b").alias("a")), "ngram-hubs")
        share = F.pmod(F.xxhash64("b"), F.ceil(F.col("_all") / FAMILY)).alias("s")
        tries = staged(left.join(hub, "family").filter("a <> b").select("family", "a", "b", share), "ngram-pairs")
        discard(left)
        if tries.isEmpty():
            discard(hub, tries)
            break
        now = staged(overlaps(tries.select("a", "b", "s"), parts, num, den), "ngram-links")
        found.append(now)
        linked = tries.select("family", "a", "b").join(now, ["a", "b"]).groupBy("family").agg(F.count("*").alias("_n"))
        on = hub.join(linked, "family").filter(F.col("_n") * WORTH >= F.col("_all")).select("family")
        left = staged(tries.join(now, ["a", "b"], "left_anti").select("family", "b").join(on, "family", "left_semi"), "ngram-left")
        discard(hub, tries)
    out = links
    for x in found:
        out = out.unionByName(x)
    return out


def between(pairs: DataFrame, parts: DataFrame, label: DataFrame, num: int, den: int) -> DataFrame:
    """a, b: links between different components of one family, which its hub's links don't show.

    A set x of hub L is known by its difference E from L (grams in one of them only): two sets of the family differ by
    |Ex| + |Ey| - 2 |Ex & Ey| grams. If x isn't linked with L (it is outside) and x and y are linked, Ex and Ey must share
    grams, at least o = (|Ex| + |Ey| - allowed) / 2, where allowed = (|x| + |y|)(1-t)/(1+t). With grams in the order of
    how many sets of the family have them in their difference, rarest first, the first gram that a linked pair shares
    stands among the first |E| - o + 1 of both. Differences of edits made on their own are rare grams, so hardly any pair
    meets; a pair is tried only if the grams left after the one it meets at can still make up o.
    """
    q, s = den - num, den + num
    one = label.select(F.col("node").alias("_l"), F.col("label"))
    own = lambda df, c: df.join(one, F.col(c) == F.col("_l"), "left").withColumn("label", F.coalesce("label", c)).drop("_l")
    named = own(pairs, "b")
    # Pairs with the hub are tried already, so a family matters only if its other sets are of several components.
    torn = named.groupBy("a").agg(F.min("label").alias("_x"), F.max("label").alias("_y")).filter("_x <> _y").select("a")
    inside = named.join(_hubs(pairs, torn), ["a", "s"])
    left = _hubs(pairs, parts.select("node", "part", F.col("n").alias("l"), F.col("grams").alias("_g")))
    right = parts.select(F.col("node").alias("b"), "part", "n", F.col("grams").alias("_h"))
    differ = F.concat(F.array_except("_g", "_h"), F.array_except("_h", "_g"))
    # Range by range, like the overlaps: sizes and later counts are sums over ranges.
    apart = inside.join(right, "b").join(left, ["a", "s", "part"]).select("a", "b", "part", "l", "n", "label", differ.alias("grams"))
    apart = staged(apart, "ngram-differences")
    whole = apart.groupBy("a", "b").agg(F.max("l").alias("l"), F.max("n").alias("n"), F.max("label").alias("label"), F.sum(F.size("grams")).cast("long").alias("size"))
    each = apart.select("a", "b", F.explode("grams").alias("e"))
    often = staged(each.groupBy("a", "e").agg(F.count("*").alias("_c")).filter("_c > 1"), "ngram-often")
    # Grams that one set alone has come first in its order, however many they are; the others are ranked after them.
    shared = Window.partitionBy("a", "b")
    rank = F.row_number().over(shared.orderBy("_c", "e")) - F.count("*").over(shared)
    size, n, hub = F.col("size"), F.col("n"), F.col("l")
    outside = s * size > q * (n + hub)
    least = lambda x, y: F.ceil(x / y).cast("long")
    more = lambda x, y: (F.floor(x / y) + 1).cast("long")
    with_outside = more(s * size + q * (hub - n), F.lit(2 * s))  # whatever the partner, if that is outside
    with_any = F.when(outside, F.greatest(F.lit(1), least(s * size - q * (n + hub), F.lit(2 * s)))).otherwise(with_outside)
    with_larger = least(2 * s * num * size - q * (num + den) * n, F.lit(2 * s * num))
    first = size + 1 - F.greatest(with_any, with_larger, F.lit(1))  # as the smaller of the two
    second_out = size + 1 - F.greatest(with_outside, F.lit(1))  # as the larger, by what the smaller is
    second_in = F.when(outside, size + 1 - with_any).otherwise(F.lit(0))
    facts = whole.select("a", "b", "l", "n", "size", "label", outside.alias("out"), first.alias("first"), second_out.alias("second_out"), second_in.alias("second_in"))
    ranked = each.join(often, ["a", "e"]).withColumn("_r", rank).join(facts, ["a", "b"]).withColumn("i", F.col("size") + F.col("_r"))
    ranked = staged(ranked.filter(F.col("i") <= F.greatest("first", "second_out", "second_in")), "ngram-prefixes")
    # What only sets of one component differ by, as a cluster of near copies does from another's hub, joins no two that matter.
    torn_by = ranked.groupBy("a", "e").agg(F.min("label").alias("_x"), F.max("label").alias("_y")).filter("_x <> _y").select("a", "e")
    ranked = ranked.join(staged(torn_by, "ngram-torn"), ["a", "e"], "left_semi")
    x = ranked.filter("i <= first").select("a", "e", *(F.col(c).alias(f"x_{c}") for c in ("b", "i", "n", "size", "label", "out")))
    y = ranked.filter("i <= greatest(second_out, second_in)").select("a", "e", *(F.col(c).alias(f"y_{c}") for c in ("b", "i", "n", "size", "label", "out", "second_out", "second_in")))
    need = F.ceil((s * (F.col("x_size") + F.col("y_size")) - q * (F.col("x_n") + F.col("y_n"))) / F.lit(2 * s))
    fits = (
        (F.col("x_label") != F.col("y_label"))
        & (F.col("x_out") | F.col("y_out"))
        & ((F.col("x_size") < F.col("y_size")) | ((F.col("x_size") == F.col("y_size")) & (F.col("x_b") < F.col("y_b"))))
        & (F.col("y_i") <= F.when(F.col("x_out"), F.col("y_second_out")).otherwise(F.col("y_second_in")))
        & (den * F.least("x_n", "y_n") >= num * F.greatest("x_n", "y_n"))
        & (need <= 1 + F.least(F.col("x_size") - F.col("x_i"), F.col("y_size") - F.col("y_i")))
    )
    tries = staged(x.join(y, ["a", "e"]).filter(fits).select("a", "x_b", "y_b", "x_n", "y_n", "x_size", "y_size").distinct(), "ngram-tries")
    one = apart.select("a", "part", F.col("b").alias("x_b"), F.col("grams").alias("_g"))
    two = apart.select("a", "part", F.col("b").alias("y_b"), F.col("grams").alias("_h"))
    parts_of = tries.join(one, ["a", "x_b"]).join(two, ["a", "y_b", "part"])
    counted = parts_of.groupBy("x_b", "y_b", "x_n", "y_n", "x_size", "y_size").agg(F.sum(F.size(F.array_intersect("_g", "_h"))).alias("same"))
    return counted.filter(s * (F.col("x_size") + F.col("y_size") - 2 * F.col("same")) <= q * (F.col("x_n") + F.col("y_n"))).select(F.col("x_b").alias("a"), F.col("y_b").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """node, label of every node in links (a, b): label is the smallest node reachable.

    Alternates large and small stars until the edges no longer change; each round is a table in the shared folder.
    """
    edges = staged(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "stars")
    mark = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = mark(edges)
    while before[0]:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = staged(both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m")), "stars-least")
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(smallest.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        last, edges = edges, staged(small, "stars")
        discard(last, least)
        after = mark(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def join(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id, label of every row of docs; k-word sets with Jaccard >= num / den are linked.

    text_hash (xxhash64 of the text) tells apart rows that share a doc_id. label is the component's, whatever its ids are;
    null for empty sets.
    """

    docs = docs.select("doc_id", "text")
    sent = send_all(docs.withColumn("doc_id", F.col("doc_id").cast("long")), k, num, den)
    rows = staged(sent.filter(F.col("need_0").isNotNull()).select("doc_id", "text_hash", "n_shingles", "node"), "ngram-sets")
    members = candidates(sent)
    discard(sent)
    pairs = staged(families(members), "ngram-pairs")
    discard(members)
    nodes = pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node"))).distinct()
    one = rows.filter("doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id")).join(nodes, "node", "left_semi").select("doc_id")
    spare = rows.groupBy("node").agg(F.max("doc_id").alias("d")).filter("d is null").join(nodes, "node", "left_semi")
    texts = docs.join(one, "doc_id", "left_semi")
    if spare.take(1):
        texts = texts.unionAll(docs.filter("doc_id is null"))
    # Texts first, so that their shuffle files are gone when the grams' are written.
    texts = staged(texts, "ngram-texts")
    parts = staged(fragments(texts, k).dropDuplicates(["node", "part"]), "ngram-fragments")
    discard(texts)
    links = staged(overlaps(pairs, parts, num, den), "ngram-links")
    label = staged(components(further_hubs(pairs, links, parts, num, den)), "ngram-components")
    more = staged(between(pairs, parts, label, num, den), "ngram-links")
    discard(parts)
    if more.take(1):
        label = staged(components(label.select(F.col("node").alias("a"), F.col("label").alias("b")).unionAll(more)), "ngram-components")
    of = rows.join(label, "node", "left").select("doc_id", "text_hash", "n_shingles", F.coalesce("label", "node").alias("label"))
    # A table, so that the join has an exchange of its own on either side, of which Spark splits a hot component's.
    least = staged(of.filter("n_shingles > 0").groupBy("label").agg(F.min("doc_id").alias("least")), "ngram-least")
    some = F.col("n_shingles") > 0
    return of.join(least, "label", "left").select("doc_id", "text_hash", "n_shingles", F.when(some, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"), F.when(some, F.col("label")).alias("label"))
