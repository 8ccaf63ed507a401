"""Exact n-gram Jaccard join through a token-group matrix.

A document's set is its distinct 5-word shingles, each a 64-bit hash.  The join runs on *classes*
(documents with equal sets, by 128 bits of signature) and goes:

1. one scan gives each document's set size and signature, and a fixed-size sketch of how often each
   token occurs in the corpus;
2. every class emits the rarest part of its set, long enough that linked sets share at least ``l``
   tokens of it; tokens of a single class drop out at once;
3. *groups*: classes whose most shared token is the same one are dealt, in two different ways, into
   blocks of bounded size; those whose rare parts meet often enough in their block are compared there.
   Classes linked so form one group, what stays unlinked is grouped by its block, and a class without
   a much-shared token stands alone;
4. *token-group matrix*: a token's row lists the groups whose token union has it; a query class counts,
   for every other group, the tokens of its rare part that lie in the group's union.  The count bounds
   the overlap with each member, so only groups that reach the required count are opened;
5. opened groups are compared with their queries, part by part and lot by lot, first by the rare parts that
   are at hand, and what can still be linked by whole sets; components are taken over all links.

Frequency only orders the tokens, so its sketch affects speed and never the result.  Sets meet in
blocks, as products of incidence matrices; a block reports a spanning forest of its links, so no
group's pairs are ever emitted, and nothing is compared inside a group that is already connected.

Nothing is gathered without a bound: a block has at most ``BLOCK`` classes, a group's members and its queries
meet in parts and lots of that many, and the entries of a token that very many classes share are spread over
buckets by class.

Defined results: null or wordless texts have an empty set and link with nothing; a text of one to
four words has its whole word sequence as its one shingle; a text may be of any length; equal texts share a
class; repeated rows are kept; a pair at exactly the threshold links; a null id is never a component's id
unless its whole component has none; an empty table gives an empty result; columns besides ``doc_id`` and
``text`` are not looked at.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm.common import connected_components, discard, emit_segments, fold_segments, frugal, materialize, partitions, spanning_edges
from fathom.llm.shingles import mix, row_sets

#: Counters of the frequency sketch; a parameter of cost, not of the result.
SKETCH_BITS = 21
#: A class emits 1/16 of its set beyond the shortest safe part, and so must share that much more.
EXTRA = 16
#: A token of so many classes is much shared: it draws its classes into blocks of this size.
HOT, BLOCK = 8, 64
#: A token of more than two to this many classes has its entries spread over buckets by class.
SPREAD_BITS = 18
#: Bits of the filter of wanted classes (two to this many), and of the first half of a signature.
FILTER_BITS, SIGNATURE_BITS = 28, 64
#: Visitors compared at once, and columns of an incidence matrix.
_VISITORS, _COLUMNS = 512, 4096
#: What a document with any word holds.
WORD = r"[^\x20\x09-\x0D]"
#: Entries gathered in a task before they are packed into rows.
_FLUSH = 1 << 20


#: The sketch travels in bytes on a logarithmic scale: what a task has counted, and what a byte stands for.
_COUNT_OF = np.rint(2 ** (np.arange(256) / 16) - 1).astype(np.uint32)


def _byte_of(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.rint(16 * np.log2(1.0 + counts)), 255).astype(np.uint8)


def _signatures(own: np.ndarray, bits: int = 64) -> tuple[int, int]:
    """Twice 64 bits of the whole set, the same for equal sets in any order; the first cut to ``bits``."""
    mixed = mix(own)
    with np.errstate(over="ignore"):
        total, odd = np.add.reduce(mixed), np.bitwise_xor.reduce(mixed)
        both = np.array([total * np.uint64(3) + odd, total * np.uint64(2) + odd])
    first, second = mix(both)
    return int((first & np.uint64((1 << bits) - 1)).view(np.int64)), int(second.view(np.int64))


class _Namer:
    """The number of a set's class: the first half of its signature, unless another class was there first."""

    def __init__(self, renamed: dict[tuple[int, int], int], bits: int):
        self.renamed, self.bits = renamed, bits

    def __call__(self, own: np.ndarray) -> int:
        pair = _signatures(own, self.bits)
        return self.renamed.get(pair, pair[0]) if self.renamed else pair[0]


def _scan(docs: DataFrame) -> DataFrame:
    """Per row of ``docs(doc_id, text, mark)``: id, mark, set size, signatures; besides, each task's sketch."""
    bits = SIGNATURE_BITS

    def run(batches):
        names = ["doc_id", "mark", "n", "sig", "check", "seg", "payload"]
        counts = np.zeros(1 << SKETCH_BITS, dtype=np.uint32)
        mask = np.uint64((1 << SKETCH_BITS) - 1)
        seen: set[int] = set()
        held: list[np.ndarray] = []
        size = 0

        def count() -> None:
            nonlocal size
            if held:
                counts[:] += np.bincount((np.concatenate(held) & mask).astype(np.int64), minlength=len(counts)).astype(np.uint32)
            held.clear()
            size = 0

        for batch in frugal(batches):
            sizes, sigs, checks = [], [], []
            for _, own in row_sets(batch.column(1)):
                sig, check = _signatures(own, bits) if len(own) else (None, None)
                sizes.append(len(own))
                sigs.append(sig)
                checks.append(check)
                if sig is not None and sig not in seen:
                    seen.add(sig)
                    held.append(own)
                    size += len(own)
                    if size > _FLUSH:
                        count()
            arrays = [batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(sigs, pa.int64()), pa.array(checks, pa.int64())]
            yield pa.RecordBatch.from_arrays([*arrays, pa.nulls(len(batch), pa.int32()), pa.nulls(len(batch), pa.binary())], names=names)
        count()
        rows = list(emit_segments(_byte_of(counts)))
        if rows:
            empty = [pa.nulls(len(rows), pa.int64())] * 5
            yield pa.RecordBatch.from_arrays([*empty, pa.array([s for s, _ in rows], pa.int32()), pa.array([p for _, p in rows], pa.binary())], names=names)

    return materialize(docs.mapInArrow(run, "doc_id long, mark long, n long, sig long, check long, seg int, payload binary"), "jaccard-profile")


def _named(profile: DataFrame) -> tuple[DataFrame, _Namer]:
    """``(doc_id, mark, n, sig)`` with one ``sig`` a class, and what gives it to a set.

    Of classes that share the first half of their signature all but one get another number.  They are about
    the square of the classes over 2**65: none up to a thousand million, some hundreds for a hundred thousand million.
    """
    halves = profile.filter("n > 0").groupBy("sig").agg(F.min("check").alias("least"), F.max("check").alias("most")).filter("least <> most")
    halves = materialize(halves.select("sig", "least"), "jaccard-clashes")
    clash = [] if halves.isEmpty() else profile.join(halves, "sig").filter("check <> least").select("sig", "check").distinct().collect()
    renamed = {}
    for sig, check in clash:
        renamed[sig, check] = int(mix(np.array([check], dtype=np.int64).view(np.uint64) + np.uint64(1))[0].view(np.int64))
    rows = profile.select("doc_id", "mark", "n", "sig", "check")
    if renamed:
        other = profile.sparkSession.createDataFrame([(*k, v) for k, v in renamed.items()], "sig long, check long, other long")
        rows = rows.join(F.broadcast(other), ["sig", "check"], "left").withColumn("sig", F.coalesce("other", "sig"))
    return rows.select("doc_id", "mark", "n", "sig"), _Namer(renamed, SIGNATURE_BITS)


def _filter_places(sig: np.ndarray, bits: int) -> np.ndarray:
    u = sig.view(np.uint64)
    return np.stack([(m & np.uint64((1 << bits) - 1)).astype(np.int64) for m in (mix(u), mix(u) >> np.uint64(32), mix(u + np.uint64(1)))])


def _membership_filter(ids: DataFrame, bits: int) -> np.ndarray:
    """A Bloom filter of the column ``sig`` in ``2**bits`` bits, folded on the executors."""

    def build(batches):
        own = np.zeros((1 << bits) // 8, dtype=np.uint8)
        for batch in frugal(batches):
            at = _filter_places(batch.column(0).to_numpy(zero_copy_only=False), bits).ravel()
            np.bitwise_or.at(own, at >> 3, (1 << (at & 7)).astype(np.uint8))
        rows = list(emit_segments(own))
        yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in rows], pa.int32()), pa.array([p for _, p in rows], pa.binary())], names=["seg", "payload"])

    return fold_segments(ids.coalesce(partitions(ids.sparkSession)).mapInArrow(build, "seg int, payload binary"), (1 << bits) // 8, "or")


def _sets_of(docs: DataFrame, ids: DataFrame, profile: DataFrame, name_of: _Namer) -> DataFrame:
    """``(sig, tokens)`` of the classes in ``ids(sig)``, once each, and perhaps of a few others.

    Up to a stated number of classes a filter of theirs goes to every task; beyond it the texts are joined
    with one row of each class.
    """
    ids = materialize(ids.distinct(), "jaccard-wanted")
    bits = max(20, math.ceil(math.log2(12 * ids.count() + 1)))
    shared = None
    texts = docs.select("text")
    if bits <= FILTER_BITS:
        shared = docs.sparkSession.sparkContext.broadcast(_membership_filter(ids, bits))
    else:
        marks = profile.join(ids, "sig").groupBy("sig").agg(F.min("mark").alias("mark")).select("mark").distinct()
        texts = docs.join(materialize(marks, "jaccard-marks"), "mark", "left_semi").select("text")

    def wanted(batches):
        seen: set[int] = set()
        for batch in frugal(batches):
            sigs, blobs = [], []
            for _, own in row_sets(batch.column(0)):
                if not len(own):
                    continue
                sig = name_of(own)
                if sig in seen:
                    continue
                if shared is not None:
                    at = _filter_places(np.array([sig]), bits)
                    if not (shared.value[at >> 3] >> (at & 7) & 1).all():
                        continue
                seen.add(sig)
                sigs.append(sig)
                blobs.append(own.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(sigs, pa.int64()), pa.array(blobs, pa.binary())], names=["sig", "tokens"])

    sets = texts.mapInArrow(wanted, "sig long, tokens binary").groupBy("sig").agg(F.first("tokens").alias("tokens"))
    found = materialize(sets, "jaccard-sets")
    discard(ids)
    return found


def _often_together(residents: list, visitors: list | None, percent: int) -> np.ndarray:
    """Which visitors (rows) meet which residents (columns) in enough tokens of their rare parts to be linked.

    A side lists arrays ``(sig, n, token)``; without visitors the residents meet each other.
    """

    def side(parts):
        sig, n, token = (np.concatenate(c) for c in zip(*parts, strict=True))
        ids, owner = np.unique(sig, return_inverse=True)
        size = np.zeros(len(ids), dtype=np.int64)
        size[owner] = n
        return ids, owner, size, token

    r_ids, r_owner, r_size, r_token = side(residents)
    if visitors is None:
        v_ids, v_owner, v_size, v_token = r_ids, r_owner, r_size, r_token
        tokens, times = np.unique(r_token, return_counts=True)
        common = tokens[times > 1]
    else:
        v_ids, v_owner, v_size, v_token = side(visitors)
        common = np.intersect1d(r_token, v_token)

    def columns(token, owner):
        at = np.searchsorted(common, token)
        at[at == len(common)] = 0
        hit = common[at] == token if len(common) else np.zeros(len(token), dtype=bool)
        order = np.argsort(at[hit], kind="stable")
        return at[hit][order], owner[hit][order]

    (ra, ro), (va, vo) = columns(r_token, r_owner), columns(v_token, v_owner)
    both = np.zeros((len(v_ids), len(r_ids)), dtype=np.float32)
    for k in range(0, len(common), _COLUMNS):
        wide = min(_COLUMNS, len(common) - k)
        pair = []
        for at, owner, count in ((va, vo, len(v_ids)), (ra, ro, len(r_ids))):
            own = slice(*np.searchsorted(at, (k, k + wide)))
            one = np.zeros((count, wide), dtype=np.float32)
            one[owner[own], at[own] - k] = 1
            pair.append(one)
        both += pair[0] @ pair[1].T
    if visitors is None:
        np.fill_diagonal(both, 0)
    low, high = np.minimum(v_size[:, None], r_size[None, :]), np.maximum(v_size[:, None], r_size[None, :])
    return (both >= 1 + low // EXTRA) & (100 * low >= percent * high)


def _worth_comparing(rows: DataFrame, percent: int) -> DataFrame:
    """Of ``rows(key, part, kind, sig, n, token)`` (kinds as in :func:`_compare`) the ``(key, part, kind, sig)`` that
    can be linked with what they would be compared with, by the tokens that their rare parts share."""
    n_tasks = partitions(rows.sparkSession)

    def run(batches):
        key: tuple[int, int] | None = None
        sides: dict[int, list] = {0: [], 1: [], 2: []}
        wanted: set[int] = set()

        def found(kind: int, sig: np.ndarray):
            full = [pa.array(np.full(len(sig), v), pa.int64()) for v in key]
            return pa.RecordBatch.from_arrays([*full, pa.array(np.full(len(sig), kind), pa.int32()), pa.array(sig, pa.int64())], names=["key", "part", "kind", "sig"])

        def visit(last: bool):
            guests = sides[1]
            if not guests or not sides[0]:
                guests.clear()
                return
            sig, n, token = (np.concatenate(c) for c in zip(*guests, strict=True))
            # A class whose entries may go on in the next batch waits.
            now = np.ones(len(sig), dtype=bool) if last else sig != sig[-1]
            guests[:] = [] if last else [(sig[~now], n[~now], token[~now])]
            if now.any():
                hit = _often_together(sides[0], [(sig[now], n[now], token[now])], percent)
                residents = np.unique(np.concatenate([r[0] for r in sides[0]]))
                wanted.update(residents[hit.any(0)].tolist())
                yield found(1, np.unique(sig[now])[hit.any(1)])

        def close():
            if key is None:
                return
            yield from visit(True)
            if wanted:
                yield found(0, np.array(sorted(wanted), dtype=np.int64))
            if sides[2]:
                hit = _often_together(sides[2], None, percent)
                yield found(2, np.unique(np.concatenate([r[0] for r in sides[2]]))[hit.any(0)])
            for side in sides.values():
                side.clear()
            wanted.clear()

        for batch in frugal(batches):
            k, part, kind, sig, n, token = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            cut = np.flatnonzero((k[1:] != k[:-1]) | (part[1:] != part[:-1]) | (kind[1:] != kind[:-1])) + 1
            for a, b in zip(np.concatenate(([0], cut)).tolist(), np.concatenate((cut, [len(k)])).tolist(), strict=True):
                if a == b:
                    continue
                if (int(k[a]), int(part[a])) != key:
                    yield from close()
                    key = (int(k[a]), int(part[a]))
                sides[int(kind[a])].append((sig[a:b], n[a:b], token[a:b]))
                if sum(len(g[0]) for g in sides[1]) > 50_000:
                    yield from visit(False)
        yield from close()

    dealt = rows.select("key", "part", "kind", "sig", "n", "token").repartition(n_tasks, "key", "part").sortWithinPartitions("key", "part", "kind", "sig")
    return dealt.mapInArrow(run, "key long, part long, kind int, sig long")


def linked(residents: list[np.ndarray], visitors: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions ``(visitor, resident)`` of pairs with ``100 * intersection >= percent * union``."""

    def flat(sets):
        return np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])

    (rt, ro), (vt, vo) = flat(residents), flat(visitors)
    if residents is visitors:
        tokens, times = np.unique(rt, return_counts=True)
        common = tokens[times > 1]
    else:
        common = np.intersect1d(rt, vt)

    def columns(tokens, owners):
        at = np.searchsorted(common, tokens)
        at[at == len(common)] = 0
        hit = common[at] == tokens if len(common) else np.zeros(len(tokens), dtype=bool)
        order = np.argsort(at[hit], kind="stable")
        return at[hit][order], owners[hit][order]

    (ra, ro), (va, vo) = columns(rt, ro), columns(vt, vo)
    both = np.zeros((len(visitors), len(residents)), dtype=np.float32)
    for k in range(0, len(common), _COLUMNS):
        wide = min(_COLUMNS, len(common) - k)
        sides = []
        for at, owner, sets in ((va, vo, visitors), (ra, ro, residents)):
            own = slice(*np.searchsorted(at, (k, k + wide)))
            side = np.zeros((len(sets), wide), dtype=np.float32)
            side[owner[own], at[own] - k] = 1
            sides.append(side)
        both += sides[0] @ sides[1].T
    sizes = [np.array([len(x) for x in sets], dtype=np.float64) for sets in (visitors, residents)]
    return np.nonzero(100 * both.astype(np.float64) >= percent * (sizes[0][:, None] + sizes[1][None, :] - both))


def _compare(rows: DataFrame, percent: int) -> DataFrame:
    """Links within ``rows(key, part, kind, sig, tokens)``, rows dealt by key and part.

    Kind 0 is a resident, kind 1 a visitor that is compared with the residents of its key and part, and
    kind 2 a resident that is compared with the other residents.  Of each block's links only so many
    are returned as connect the same classes.
    """
    n = partitions(rows.sparkSession)

    def run(batches):
        key = None
        kept: list[tuple[int, np.ndarray]] = []
        guests: list[tuple[int, np.ndarray]] = []
        inner = False

        def meet():
            if not kept or not (guests or inner):
                guests.clear()
                return
            ids, sets = [k for k, _ in kept], [t for _, t in kept]
            if inner:
                vids, (v, r) = ids, linked(sets, sets, percent)
                keep = v < r
                v, r = v[keep], r[keep]
            else:
                vids = [k for k, _ in guests]
                v, r = linked(sets, [t for _, t in guests], percent)
            guests.clear()
            u, w = np.array(vids, dtype=np.int64)[v], np.array(ids, dtype=np.int64)[r]
            forest = spanning_edges(u, w)
            yield pa.RecordBatch.from_arrays([pa.array(u[forest]), pa.array(w[forest])], names=["u", "v"])

        for batch in frugal(batches):
            keys = zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True)
            for i, (own, part, kind, sig) in enumerate(keys):
                if (own, part) != key:
                    yield from meet()
                    key, inner = (own, part), kind == 2
                    kept, guests = [], []
                tokens = np.frombuffer(batch.column(4)[i].as_py(), dtype=np.uint64)
                (guests if kind == 1 else kept).append((sig, tokens))
                if len(guests) >= _VISITORS:
                    yield from meet()
        yield from meet()

    dealt = rows.select("key", "part", "kind", "sig", "tokens").repartition(n, "key", "part").sortWithinPartitions("key", "part", "kind")
    return dealt.mapInArrow(run, "u long, v long")


def _entries(docs: DataFrame, levels: np.ndarray, buckets: int, percent: int, name_of: _Namer) -> DataFrame:
    """Every class's ``(token, sig, n, many)`` over the rarest part of its set; ``many`` (two or more)
    classes have the token in that part, or about so many, if its entries are spread over buckets."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)
    #: Over how many buckets the entries of a token of each level (twice the logarithm of its count) go.
    spread = np.array([1 << max(0, -(-(min(x, 64) - 2 * SPREAD_BITS) // 2)) for x in range(256)], dtype=np.uint64)

    def rare_parts(batches):
        level, mask = shared.value, np.uint64(len(shared.value) - 1)
        seen: set[int] = set()
        held: list[tuple[np.ndarray, int, int]] = []

        def pack():
            token = np.concatenate([h[0] for h in held])
            times = [len(h[0]) for h in held]
            sig = np.repeat(np.array([h[1] for h in held], dtype=np.int64), times)
            n = np.repeat(np.array([h[2] for h in held], dtype=np.int32), times)
            lot = sig.view(np.uint64) % spread[level[(token & mask).astype(np.int64)]]
            where = (((token >> np.uint64(24)) + lot * np.uint64(7_919)) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(where, kind="stable")
            token, sig, n, where = token[order], sig[order], n[order], where[order]
            cut = np.flatnonzero(np.diff(where)) + 1
            ids = [int(where[i]) for i in np.concatenate(([0], cut))]
            cols = [pa.array([part.tobytes() for part in np.split(c, cut)], pa.binary()) for c in (token, sig, n)]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), *cols], names=["bucket", "token", "sig", "n"])

        size = 0
        for batch in frugal(batches):
            for _, own in row_sets(batch.column(0)):
                n = len(own)
                if not n or (sig := name_of(own)) in seen:
                    continue
                seen.add(sig)
                part = min(n, n - -(-percent * n // 100) + 1 + n // EXTRA)
                rank = (level[(own & mask).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (mix(own) >> np.uint64(8))
                held.append((own[np.argpartition(rank, part - 1)[:part]], sig, n))
                size += part
                if size > _FLUSH:
                    yield pack()
                    size = 0
        if held:
            yield pack()

    def shared_tokens(batches):
        parts: list[tuple[np.ndarray, ...]] = []
        for batch in frugal(batches):
            for row in zip(*(batch.column(k) for k in (1, 2, 3)), strict=True):
                parts.append(tuple(np.frombuffer(v.as_py(), dtype=d) for v, d in zip(row, (np.uint64, np.int64, np.int32), strict=True)))
        if not parts:
            return
        token, sig, n = (np.concatenate(c) for c in zip(*parts, strict=True))
        parts.clear()
        order = np.argsort(token, kind="stable")
        token = token[order]
        same = token[1:] == token[:-1]
        met = np.concatenate((same, [False])) | np.concatenate(([False], same))
        met |= spread[shared.value[(token & np.uint64(len(shared.value) - 1)).astype(np.int64)]] > 1
        order, token = order[met], token[met]
        sig, n = sig[order], n[order]
        order = np.lexsort((sig, token))
        token, sig, n = token[order], sig[order], n[order]
        if not len(token):
            return
        fresh = np.concatenate(([True], (token[1:] != token[:-1]) | (sig[1:] != sig[:-1])))
        token, sig, n = token[fresh], sig[fresh], n[fresh]
        first = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
        times = np.diff(np.append(first, len(token)))
        lots = spread[shared.value[(token & np.uint64(len(shared.value) - 1)).astype(np.int64)]].astype(np.int64)
        many = np.repeat(times, times) * lots
        token, sig, n, many = (x[many > 1] for x in (token, sig, n, many))
        for k in range(0, len(token), 100_000):
            cut = slice(k, k + 100_000)
            columns = [token[cut].view(np.int64), sig[cut], n[cut].astype(np.int64), many[cut]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["token", "sig", "n", "many"])

    packed = docs.select("text").mapInArrow(rare_parts, "bucket int, token binary, sig binary, n binary")
    return packed.repartition(buckets, "bucket").mapInArrow(shared_tokens, "token long, sig long, n long, many long")


def _components(docs: DataFrame, percent: int) -> DataFrame:
    """``(doc_id, mark, n, component)`` of every row of ``docs(doc_id, text, mark)``; no component without words."""
    spark = docs.sparkSession
    scanned = _scan(docs)
    profile, name_of = _named(scanned.filter("seg is null"))
    sketch = fold_segments(scanned.filter("seg is not null"), 1 << SKETCH_BITS, "sum", _COUNT_OF)
    levels = np.floor(2 * np.log2(np.maximum(sketch, 1))).astype(np.uint8)
    size = int(profile.agg(F.sum("n")).first()[0] or 0)
    buckets = max(partitions(spark), math.ceil(size * 0.32 / 1_500_000))
    entries = materialize(_entries(docs, levels, buckets, percent, name_of), "jaccard-entries")

    # Groups: blocks of the classes with the same most shared token, dealt in two ways.
    classes = entries.groupBy("sig", "n").agg(F.max(F.struct("many", "token")).alias("top"))
    classes = materialize(classes.select("sig", "n", F.when(F.col("top.many") >= HOT, F.col("top.token")).alias("draw")), "jaccard-classes")
    drawn = classes.filter("draw is not null")
    wide = drawn.groupBy("draw").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    drawn = drawn.join(wide, "draw").withColumn("block", F.pmod("sig", "blocks"))
    drawn = materialize(drawn.withColumn("other_block", F.pmod(F.xxhash64("sig"), "blocks")), "jaccard-drawn")
    blocks = F.array(F.col("block"), F.when(F.col("blocks") > 1, -1 - F.col("other_block")))
    dealt = drawn.select("sig", F.col("draw").alias("key"), F.explode(blocks).alias("part")).filter("part is not null")
    parts = entries.select("token", "sig", "n").join(dealt.withColumn("kind", F.lit(2)), "sig")
    near = materialize(_worth_comparing(parts, percent), "jaccard-near")
    sets = _sets_of(docs, near.select("sig"), profile, name_of)
    inner = materialize(_compare(near.join(sets, "sig"), percent), "jaccard-inner")
    discard(sets)
    joined = materialize(connected_components(inner, "jaccard-groups").select(F.col("node").alias("sig"), "root"), "jaccard-joined")
    block_group = drawn.select("sig", F.xxhash64("draw", "block").alias("block_group"))
    grouped = classes.select("sig", "n").join(joined, "sig", "left").join(block_group, "sig", "left")
    grouped = grouped.select("sig", "n", F.coalesce("root", "block_group", "sig").alias("grp"))
    grouped = materialize(grouped, "jaccard-grouped")
    sizes = grouped.groupBy("grp").agg(F.count("*").alias("size"))
    grouped = materialize(grouped.join(sizes, "grp"), "jaccard-sized")

    # Token-group matrix: queries against the token unions of groups that are not smaller than theirs.
    # Dealt by token once: the matrix's distinct rows and the join with it need no other exchange.
    tagged = entries.select("token", "sig", "n").join(grouped.select("sig", "grp", "size"), "sig").repartition("token")
    matrix = tagged.select("token", F.struct("size", "grp").alias("other")).distinct()
    overlap = tagged.join(matrix, "token").filter(F.struct("size", "grp") < F.col("other")).groupBy("sig", "n", "other").agg(F.count("*").alias("shared"))
    opened = overlap.filter(F.expr(f"shared >= 1 + floor({percent} * n / 100) div {EXTRA}"))
    opened = materialize(opened.select("sig", F.col("other.grp").alias("key"), F.ceil(F.col("other.size") / BLOCK).alias("parts")), "jaccard-opened")

    # Open the qualifying groups: their members, part by part, against their queries, lot by lot.
    lots = opened.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).alias("lots"))
    opened = opened.join(lots, "key")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    scatter = F.xxhash64("sig", "key")
    members = grouped.withColumnRenamed("grp", "key").join(lots, "key").withColumn("lot", every("lots"))
    members = members.select("key", (F.pmod("sig", F.ceil(F.col("size") / BLOCK)) * F.col("lots") + F.col("lot")).alias("part"), F.lit(0).alias("kind"), "sig")
    queries = opened.withColumn("at", every("parts"))
    queries = queries.select("key", (F.col("at") * F.col("lots") + F.pmod(scatter, "lots")).alias("part"), F.lit(1).alias("kind"), "sig")
    # Members that no query of their part meets often enough, and such queries, need not be fetched.
    rows = members.unionByName(queries).join(entries.select("token", "sig", "n"), "sig")
    rows = materialize(_worth_comparing(rows, percent), "jaccard-meetings")
    discard(entries)
    sets = _sets_of(docs, rows.select("sig"), profile, name_of)
    outer = _compare(rows.join(sets, "sig"), percent)

    links = outer.unionByName(joined.select(F.col("sig").alias("u"), F.col("root").alias("v")))
    component = connected_components(links, "jaccard-components").select(F.col("node").alias("sig"), F.col("root").alias("component"))
    discard(sets)
    named = profile.join(component, "sig", "left").select("doc_id", "mark", "n", F.when(F.col("n") > 0, F.coalesce("component", "sig")).alias("component"))
    return materialize(named, "jaccard-named")


def _marked(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.xxhash64("text").alias("mark"))


def jaccard_groups(docs: DataFrame, percent: int = 75) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for every row of ``docs(doc_id, text, ...)``."""
    named = _components(_marked(docs), percent)
    # Written, so that it is joined by its size and a large group's rows may be split among tasks.
    least = materialize(named.filter("component is not null").groupBy("component").agg(F.min("doc_id").alias("least")), "jaccard-least")
    out = named.join(least, "component", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def one_of_each_group(docs: DataFrame, percent: int = 75) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: the least id (a null one last), then the least text hash.

    It goes by rows, so texts under one id stay or go each on their own.  Rows that also share id and text are
    one row; of them that stays whose other columns are least as JSON.  Rows without words are nobody's copies.
    """
    named = _components(_marked(docs), percent).filter("n > 0")
    first = named.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "mark")).alias("first"))
    stays = materialize(first.select("first.doc_id", "first.mark"), "jaccard-kept")

    # Own names for the keys and one struct for the row: no column of the documents can clash with them.
    whole = F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in docs.columns))
    keyed = docs.select(whole.alias("row"), F.col("doc_id").isNull().alias("unnamed"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.xxhash64("text").alias("mark"), F.col("text").rlike(WORD).alias("spoken"))
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    order = F.to_json(F.struct(*(F.col("row").getField(c).alias(f"c{k}") for k, c in enumerate(rest)))) if rest else F.lit("")
    single = keyed.filter("spoken").groupBy("unnamed", "id", "mark").agg(F.min_by("row", order).alias("row"))
    stays = stays.select(F.col("doc_id").isNull().alias("unnamed"), F.coalesce("doc_id", F.lit(0)).alias("id"), "mark")
    kept = single.join(stays, ["unnamed", "id", "mark"], "left_semi").select("row")
    silent = keyed.filter(~F.coalesce("spoken", F.lit(False))).select("row")
    both = kept.unionByName(silent)
    return both.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
