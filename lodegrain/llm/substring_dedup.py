"""Substring de-duplication by MinHash banding of paragraphs.

Paragraphs are content-defined: a word begins one where the hash of it and its successor is the smallest
among the six words on either side.  A passage that is repeated anywhere, whatever stands around it and
however its lines are broken, then falls into the same paragraphs but for its edges.

1. Each paragraph has four bands of two MinHash values over its five-word shingles (98 % recall at a Jaccard
   similarity of 0.8; the whole paragraph is the only shingle of a shorter one).  Band keys travel packed in bins
   by bucket, with a fingerprint of the paragraph's content.  Equal contents are settled first: they go to the first
   of them, within a task's share and then in the bucket, and only one of each goes on.
2. Different contents of one band key are cut out of their texts and joined by their exact Jaccard similarity, each
   with every other.  A key with many contents is split by further MinHash values, eight of them, so that a
   similar pair still meets (all but 0.2 ** 8 of them at 0.8).
3. Components of the links are the clusters; a cluster's first paragraph, by doc_id and place, stays.
4. Runs of neighbouring paragraphs to remove grow word by word, to the left and right, while the words equal those
   around the paragraph that stays, and then count if they have at least ``least_words`` words.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodegrain.sources.workspace import spread

from .common import bound_batches, bounded_bytes, components, row_ids, stage
from .kernels import Words, buffers, mix, narrow, pieces, release, widen

REACH, SHINGLE, PERCENT = 6, 5, 80
BANDS, ROWS = 4, 2
#: Words that a removed run has at least; words beside a run that are compared; bytes that two joined runs may be apart.
LEAST_WORDS, CONTEXT, GAP_BYTES = 40, 32, 24
CONTEXT_BYTES = 512
BUCKET_KEYS, FLUSH_ENTRIES = 1 << 19, 1 << 18
#: Contents of one band key beyond which they are split by so many further MinHash values.
SPLIT, SPLIT_WAYS = 64, 8
_U = np.uint64
_SEEDS = mix(np.arange(1, BANDS * ROWS + SPLIT_WAYS + 1, dtype=np.uint64) * _U(0xD1B54A32D192ED03))
_ENTRY = np.dtype([("key", "<u8"), ("content", "<u8"), ("doc", "<i8"), ("at", "<i8"), ("size", "<i8"), ("words", "<i8")])
_PLACE = "doc long, at long, size long, words long"
_NODE = ("doc", "at", "size", "words")


class Paragraphs:
    """Content-defined paragraphs of a piece of texts: ``start`` and ``stop`` (words), ``row``, ``at`` (first byte
    in its text) and ``size`` (bytes up to the next one or the text's end).  Texts without words have none."""

    def __init__(self, words: Words, reach: int = REACH):
        self.words, n = words, len(words.hash)
        pair = words.hash.copy()
        if n > 1:
            inside = words.row[1:] == words.row[:-1]
            pair[:-1] += np.where(inside, words.hash[1:] * _U(0x9E3779B97F4A7C15), _U(0))
        value = mix(pair) >> _U(1)
        place = np.arange(n) + (words.row + 1) * reach  # texts set apart, so no window spans two
        wide = np.full((place[-1] if n else 0) + reach + 1, np.iinfo(np.uint64).max, np.uint64)
        wide[place] = value
        least = np.ones(len(wide), bool)
        for k in range(1, reach + 1):
            least[k:] &= wide[k:] < wide[:-k]
            least[:-k] &= wide[:-k] <= wide[k:]
        cut = least[place]
        first = np.zeros(n, bool)
        first[words.first[:-1][words.count > 0]] = True
        self.start = np.flatnonzero(cut | first)
        self.stop = np.append(self.start[1:], n) if n else self.start
        self.row = words.row[self.start]
        text = words.off[self.row]
        self.at = words.start[self.start] - text
        last = np.append(self.row[1:] != self.row[:-1], True) if n else np.zeros(0, bool)
        self.size = np.where(last, words.off[self.row + 1] - text, np.append(self.at[1:], 0) if n else self.at) - self.at

    def content_keys(self) -> np.ndarray:
        """A fingerprint of each paragraph's words in their order."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        place = np.arange(len(self.words.hash)) - np.repeat(self.start, self.stop - self.start)
        total = np.add.reduceat(mix(self.words.hash + mix(place.astype(np.uint64) + _U(1))), self.start)
        return mix(total + (self.stop - self.start).astype(np.uint64))

    def band_keys(self) -> np.ndarray:
        """(paragraphs, BANDS) keys."""
        h, n = self.words.hash, len(self.words.hash)
        value = h.copy()
        for k in range(1, SHINGLE):
            value[: max(0, n - k)] += h[k:] * _SEEDS[k]
        # the shingles of a paragraph end in it; one too short for any goes by its content
        last = np.maximum(self.stop - SHINGLE + 1, self.start + 1)
        cuts = np.column_stack([self.start, last]).ravel()
        keys = np.zeros((len(self.start), BANDS), np.uint64)
        padded = np.append(mix(value), _U(0))
        for b in range(BANDS):
            for r in range(ROWS):
                keys[:, b] = keys[:, b] * _U(0x9E3779B97F4A7C15) + np.minimum.reduceat(mix(padded ^ _SEEDS[b * ROWS + r]), cuts)[::2]
            keys[:, b] = mix(keys[:, b] + _U(b))
        short = self.stop - self.start < SHINGLE
        keys[short] = mix(self.content_keys()[short, None] + np.arange(BANDS, dtype=np.uint64))
        return keys


def _repeated(key: np.ndarray) -> np.ndarray:
    """Places of the values that occur more than once, in order of value."""
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1] if len(key) else np.zeros(0, bool)
    again = np.zeros(len(key), bool)
    again[1:] = same
    again[:-1] |= same
    return order[again]


def _classes(e: np.ndarray, band: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of entries sorted by key, content, document and place: (which are the first of their content, rows
    (doc, at, size, words, and the first's doc, at, size) of the others).  Equal contents meet in every band, so the
    first band's rows are enough."""
    new = np.ones(len(e), bool)
    new[1:] = (e["key"][1:] != e["key"][:-1]) | (e["content"][1:] != e["content"][:-1])
    hub = e[np.maximum.accumulate(np.where(new, np.arange(len(e)), 0))] if len(e) else e
    other = ~new & (band == 0)
    other[other] = (e["doc"][other] != hub["doc"][other]) | (e["at"][other] != hub["at"][other])
    return new, np.column_stack([*(e[c][other] for c in _NODE), *(hub[c][other] for c in _NODE[:3])])


def _in_order(e: np.ndarray) -> np.ndarray:
    return e[np.lexsort((e["at"], e["doc"], e["content"], e["key"]))]


def _candidates(rows: DataFrame, buckets_bits: int) -> DataFrame:
    """(doc, at, size, words, hub_doc, hub_at, hub_size, inner, band, many): each paragraph whose content is repeated
    with the first of that content in its task's share (``inner``) or of all (``band`` null), and the first of each
    content of a band key that has several (hub null), ``many`` or few."""
    shift, n_buckets = _U(64 - buckets_bits), 1 << buckets_bits
    at_band = _U(32 - buckets_bits)  # the two lowest bits that are kept of a key are its band
    low = _U(BANDS - 1) << at_band

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            e = np.concatenate(held)
            held.clear()
            twice = _in_order(e[_repeated(e["key"])])
            new, pairs = _classes(twice, (twice["key"] & low) >> at_band)
            once = np.ones(len(e), bool)
            once[_repeated(e["key"])] = False
            first = np.concatenate([e[once], twice[new]])
            first = first[np.argsort(first["key"], kind="stable")]
            at = np.append(np.searchsorted(first["key"], np.arange(n_buckets, dtype=np.uint64) << shift), len(first))
            key = ((first["key"] << _U(buckets_bits)) >> _U(32)).astype(np.uint32)
            used = [q for q in range(n_buckets) if at[q] < at[q + 1]]
            home = int(first["content"][0] % _U(len(used)))
            return pa.RecordBatch.from_arrays([
                pa.array(used, pa.int32()),
                *(pa.array([x[at[q] : at[q + 1]].tobytes() for q in used], pa.binary()) for x in (key, first["content"])),
                *(pa.array([narrow(first[c][at[q] : at[q + 1]]) for q in used], pa.binary()) for c in _NODE),
                pa.array([pairs.tobytes() if k == home and len(pairs) else None for k in range(len(used))], pa.binary()),
            ], names=["bucket", "key", "content", *_NODE, "pairs"])

        for b in batches:
            for i, j in pieces(b.column(1)):
                p = Paragraphs(Words(*buffers(b.column(1).slice(i, j - i))))
                if not len(p.start):
                    continue
                ids = b.column(0).slice(i, j - i).to_numpy(zero_copy_only=False).astype(np.int64)
                e = np.empty((len(p.start), BANDS), _ENTRY)
                e["key"] = (p.band_keys() & ~low) | (np.arange(BANDS, dtype=np.uint64) << at_band)
                for c, x in (("content", p.content_keys()), ("doc", ids[p.row]), ("at", p.at), ("size", p.size), ("words", p.stop - p.start)):
                    e[c] = x[:, None]
                held.append(e.ravel())
                if sum(map(len, held)) >= FLUSH_ENTRIES:
                    yield flush()
        if held:
            yield flush()

    def meet(group: pa.Table) -> pa.Table:
        release()
        key = np.concatenate([np.frombuffer(x, np.uint32) for x in group["key"].to_pylist()])
        again = _repeated(key)
        e = np.empty(len(again), _ENTRY)
        e["key"] = key[again]
        e["content"] = np.concatenate([np.frombuffer(x, np.uint64) for x in group["content"].to_pylist()])[again]
        for c in _NODE:
            e[c] = np.concatenate([widen(x) for x in group[c].to_pylist()])[again]
        e = _in_order(e)
        new, pairs = _classes(e, e["key"] & _U(BANDS - 1))
        inner = np.concatenate([np.zeros((0, 7), np.int64), *(np.frombuffer(x, np.int64).reshape(-1, 7) for x in group["pairs"].to_pylist() if x is not None)])
        e = e[new]
        _, back, size = np.unique(e["key"], return_inverse=True, return_counts=True)
        several = size[back] > 1
        e, many = e[several], size[back][several] > SPLIT
        band = (_U(group["bucket"][0].as_py()) << _U(32) | e["key"]).astype(np.int64)
        none = lambda n, t: pa.nulls(n, t)
        links, n, m = np.concatenate([pairs, inner]), len(pairs) + len(inner), len(e)
        out = [pa.chunked_array([np.ascontiguousarray(links[:, k]), np.ascontiguousarray(e[c])]) for k, c in enumerate(_NODE)]
        out += [pa.chunked_array([pa.array(np.ascontiguousarray(links[:, k])), none(m, pa.int64())]) for k in (4, 5, 6)]
        out += [pa.chunked_array([pa.array(np.arange(n) >= len(pairs)), none(m, pa.bool_())]), pa.chunked_array([none(n, pa.int64()), pa.array(band)]), pa.chunked_array([none(n, pa.bool_()), pa.array(many)])]
        return pa.table(out, names=[*_NODE, "hub_doc", "hub_at", "hub_size", "inner", "band", "many"])

    packed = rows.mapInArrow(cut, "bucket int, key binary, content binary, doc binary, at binary, size binary, words binary, pairs binary")
    return packed.groupBy("bucket").applyInArrow(meet, f"{_PLACE}, hub_doc long, hub_at long, hub_size long, inner boolean, band long, many boolean")


def _asked(rows: DataFrame, asks: DataFrame, name: str) -> DataFrame:
    """(doc, text, a, b): the texts of ``rows`` with the two numbers of each of their (doc, a, b) asks, packed."""

    def pack(group: pa.Table) -> pa.Table:
        release()
        doc, a, b = (group[c].to_numpy() for c in ("doc", "a", "b"))
        order = np.lexsort((b, a, doc))
        doc, a, b = doc[order], a[order], b[order]
        cuts = np.append(np.flatnonzero(np.append(True, doc[1:] != doc[:-1])), len(doc))
        spans = list(zip(cuts[:-1], cuts[1:], strict=True))
        return pa.table({"doc": doc[cuts[:-1]], "a": pa.array([narrow(a[x:y]) for x, y in spans], pa.binary()), "b": pa.array([narrow(b[x:y]) for x, y in spans], pa.binary())})

    counted = stage(asks.select("doc", F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")), name)
    groups = max(1, counted.count() // BUCKET_KEYS)
    wanted = stage(counted.groupBy(F.pmod(F.xxhash64("doc"), F.lit(groups * 8))).applyInArrow(pack, "doc long, a binary, b binary"), f"{name}-packed")
    held = wanted.agg(F.sum(F.length("a") + F.length("b") + 48)).first()[0] or 0
    return rows.join(bounded_bytes(wanted, held), "doc").select("doc", "text", "a", "b")


def _slices(raw: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of some ranges, one after another, and their offsets."""
    off = np.append(0, np.cumsum(size))
    return raw[np.arange(off[-1]) + np.repeat(begin - off[:-1], size)], off


def _per_ask(b: pa.RecordBatch) -> Iterator[tuple]:
    """For pieces of a batch of :func:`_asked`: (bytes, text begins, text ends, doc ids, text number, a, b of each ask)."""
    for i, j in pieces(b.column(1)):
        part = b.slice(i, j - i)
        raw, off = buffers(part.column(1))
        a, c = ([widen(x.as_py()) for x in part.column(k)] for k in (2, 3))
        row = np.repeat(np.arange(j - i), [len(x) for x in a])
        yield raw, off[row], off[row + 1], part.column(0).to_numpy(zero_copy_only=False).astype(np.int64)[row], row, np.concatenate(a), np.concatenate(c)


def shingle_sets(words: np.ndarray, off: np.ndarray) -> list[frozenset[int]]:
    """Shingles of each run ``words[off[i] : off[i + 1]]`` of word hashes."""
    value = words.astype(np.uint64)
    total = value.copy()
    for k in range(1, SHINGLE):
        total[: max(0, len(value) - k)] += mix(value[k:] + _SEEDS[k])
    total = mix(total)
    out = []
    for a, n in zip(off[:-1].tolist(), np.diff(off).tolist(), strict=True):
        if n >= SHINGLE:
            out.append(frozenset(total[a : a + n - SHINGLE + 1].tolist()))
        else:  # the whole run is the only one
            own = mix(value[a : a + n] + np.arange(1, n + 1, dtype=np.uint64) * _SEEDS[0]).sum(dtype=np.uint64)
            out.append(frozenset([int(own)] if n else ()))
    return out


def _contents(asked: DataFrame) -> DataFrame:
    """(meet, doc, at, size, words, content) of paragraphs with the band keys they are compared under: a is the place,
    b the band with ``many`` as its lowest bit; ``content`` has the 32-bit hash of each word."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw, low, _, ids, _, a, band in _per_ask(batch):
                at, size = a >> 32, a & 0xFFFFFFFF
                some, off = _slices(raw, low + at, size)
                w = Words(some, off)
                small = (w.hash >> _U(32)).astype(np.uint32)
                many = np.flatnonzero(band & 1)
                ways = np.ones(len(a), np.int64)
                ways[many] = SPLIT_WAYS
                pick = np.repeat(np.arange(len(a)), ways)
                meet = (band >> 1)[pick]
                if len(many):
                    sets = shingle_sets(*_slices(small, w.first[many], w.count[many]))
                    to = np.cumsum(ways) - ways
                    for k, s in zip(many, sets, strict=True):
                        values = np.fromiter(s, np.uint64, len(s))
                        least = np.array([mix(values ^ _SEEDS[BANDS * ROWS + i]).min() + _U(i) if len(values) else 0 for i in range(SPLIT_WAYS)], np.uint64)
                        meet[to[k] : to[k] + SPLIT_WAYS] = mix(least ^ mix(np.array([band[k]]).view(np.uint64))).view(np.int64)
                content = [small[w.first[k] : w.first[k + 1]].tobytes() for k in range(len(a))]
                yield pa.RecordBatch.from_arrays([pa.array(meet), *(pa.array(x[pick]) for x in (ids, at, size, w.count)), pa.array(content, pa.binary()).take(pa.array(pick))], names=["meet", *_NODE, "content"])

    return asked.mapInArrow(run, f"meet long, {_PLACE}, content binary")


def alike(a: frozenset, b: frozenset, percent: int = PERCENT) -> bool:
    """Exact Jaccard test of two sets."""
    both = len(a & b)
    return 100 * both >= percent * (len(a) + len(b) - both)


def linked(sets: list[frozenset], percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links between ``sets`` with the components that all pairs of at least ``percent`` similarity would have.

    Few sets are compared pair by pair.  Of many, each is ordered from its rarest shingle on; a similar pair
    shares one so near the beginning of both that enough can follow (prefix filter), and only such are compared."""
    root = list(range(len(sets)))
    out = []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def try_all(rows: list[int], depth: list[int]) -> None:
        for k, i in enumerate(rows[:-1]):
            r, n, d = find(i), len(sets[i]), depth[k]
            left = 0
            for j, e in zip(rows[k + 1 :], depth[k + 1 :], strict=True):
                if find(j) == r:
                    continue
                m = len(sets[j])
                if (100 + percent) * min(n - d, m - e) >= percent * (n + m) and alike(sets[i], sets[j], percent):
                    root[find(j)] = r
                    out.append((i, j))
                else:
                    left += 1
            if not left:  # all that follow are in this component
                break

    if len(sets) <= 12:
        try_all(list(range(len(sets))), [0] * len(sets))
        return out
    often: dict = {}
    for x in sets:
        for t in x:
            often[t] = often.get(t, 0) + 1
    lists: dict = {}
    for i, x in enumerate(sets):
        reach = len(x) - -(-percent * len(x) // 100) + 1
        for d, t in enumerate(sorted(x, key=lambda t: (often[t], t))[:reach]):
            if often[t] > 1:
                lists.setdefault(t, []).append((d, i))
    for held in lists.values():
        if len(held) > 1:
            held.sort()
            try_all([i for _, i in held], [d for d, _ in held])
    return out


def _verified(contents: DataFrame, tasks: int, percent: int) -> DataFrame:
    """(a, b) links, as structures (doc, at, size, words), between similar contents that meet."""
    names = [f"{s}{c}" for s in "ab" for c in _NODE]

    def verify(group: pa.Table) -> pa.Table:
        release()
        meet, data = group["meet"].to_numpy(), group["content"].combine_chunks()
        order = np.argsort(meet, kind="stable")
        cuts = np.append(np.flatnonzero(np.append(True, meet[order][1:] != meet[order][:-1])), len(order))
        links = []
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            if y - x > 1:
                own = order[x:y]
                held = [np.frombuffer(data[int(k)].as_buffer(), np.uint32) for k in own]
                sets = shingle_sets(np.concatenate(held), np.append(0, np.cumsum([len(h) for h in held])))
                links += [(own[i], own[j]) for i, j in linked(sets, percent)]
        i, j = np.array(links, np.int64).reshape(-1, 2).T
        return pa.table({f"{s}{c}": group[c].take(pa.array(at)) for s, at in (("a", i), ("b", j)) for c in _NODE})

    bucket = F.pmod(F.xxhash64("meet"), F.lit(tasks))
    found = contents.groupBy(bucket).applyInArrow(verify, ", ".join(f"{n} long" for n in names))
    return found.select(*(F.struct(*(F.col(f"{s}{c}").alias(c) for c in _NODE)).alias(s) for s in "ab"))


def _contexts(asked: DataFrame) -> DataFrame:
    """(doc, pos, side, edge, hashes, places) for asks (a: byte position, b: 0 left or 1 right of it): the 32-bit hashes
    of up to CONTEXT whole words on that side, nearest first, and their far ends in bytes; ``edge`` is the end
    of the last word before the position."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw, low, high, ids, _, pos, side in _per_ask(batch):
                at, right = low + pos, side == 1
                begin = np.where(right, at, np.maximum(low, at - CONTEXT_BYTES))
                stop = np.where(right, np.minimum(high, at + CONTEXT_BYTES), at)
                w = Words(*_slices(raw, begin, stop - begin))
                small = (w.hash >> _U(32)).astype(np.uint32)
                shift = begin - low - w.off[:-1]  # from the slices' bytes to the text's
                # words that a slice's far end cuts, or may
                first = w.first[:-1] + ((w.count > 0) & ~right & (begin > low) & (w.start[np.minimum(w.first[:-1], max(0, len(w.start) - 1))] == w.off[:-1]) if len(w.start) else 0)
                last = w.first[1:] - ((w.count > 0) & right & (stop < high) & (w.end[np.maximum(w.first[1:] - 1, 0)] == w.off[1:]) if len(w.end) else 0)
                last = np.maximum(first, last)
                hashes, places = [], []
                for x, y, r, s in zip(first.tolist(), last.tolist(), right.tolist(), shift.tolist(), strict=True):
                    pick = slice(x, min(y, x + CONTEXT)) if r else slice(max(x, y - CONTEXT), y)
                    step = 1 if r else -1
                    hashes.append(small[pick][::step].tobytes())
                    places.append(((w.end if r else w.start)[pick][::step] + s).astype(np.int32).tobytes())
                back = Words(*_slices(raw, np.maximum(low, at - CONTEXT_BYTES), at - np.maximum(low, at - CONTEXT_BYTES)), hashes=False)
                has = back.count > 0
                edge = pos.copy()
                edge[has] = back.end[back.first[1:][has] - 1] - back.off[1:][has] + pos[has]
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(pos), pa.array(side), pa.array(edge), pa.array(hashes, pa.binary()), pa.array(places, pa.binary())], names=["doc", "pos", "side", "edge", "hashes", "places"])

    return asked.mapInArrow(run, "doc long, pos long, side long, edge long, hashes binary, places binary")


def _grown(ends: DataFrame) -> DataFrame:
    """(doc, run, side, reach, more): how far the run's end on that side goes when the words beside it equal those beside
    the paragraph that stays, and by how many words it grows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            more, reach = [], []
            for side, pos, edge, h, p, o in zip(*(b.column(c).to_pylist() for c in ("side", "pos", "edge", "hashes", "places", "other")), strict=True):
                mine, other = np.frombuffer(h or b"", np.uint32), np.frombuffer(o or b"", np.uint32)
                m = min(len(mine), len(other))
                differ = np.flatnonzero(mine[:m] != other[:m])
                n = int(differ[0]) if len(differ) else m
                more.append(n)
                reach.append(int(np.frombuffer(p, np.int32)[n - 1]) if n else edge if side else pos)
            yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("run"), b.column("side"), pa.array(reach, pa.int64()), pa.array(more, pa.int64())], names=["doc", "run", "side", "reach", "more"])

    return ends.mapInArrow(run, "doc long, run long, side long, reach long, more long")


def _spans(rows: DataFrame, percent: int, least_words: int) -> DataFrame:
    """(doc, begin, end, n_words, kept) of (doc, text) rows."""
    rows = spread(rows)
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    bits = max(6, int(np.ceil(np.log2(max(1, total / 6 / (2 * REACH + 1) * BANDS / BUCKET_KEYS)))))
    found = stage(_candidates(rows, bits), "paragraph-pairs")
    members = found.where("band is not null").select("doc", F.expr("shiftleft(at, 32) | size").alias("a"), F.expr("shiftleft(band, 1) | cast(many as int)").alias("b"))
    contents = _contents(_asked(rows, members, "compared"))
    cluster = stage(components(stage(_verified(contents, 4 << bits, percent), "similar")), "clusters").select(F.col("node.doc").alias("n_doc"), F.col("node.at").alias("n_at"), "node", "root")

    # a repeat goes to the first of its content in its task, that to the first of all, that to its cluster's first
    hub = ["hub_doc", "hub_at", "hub_size"]
    same = found.where("band is null").select(*_NODE, *hub, "inner")
    above = same.where("not inner").select(F.col("doc").alias("hub_doc"), F.col("at").alias("hub_at"), *(F.col(c).alias(f"up_{c}") for c in hub))
    inner = same.where("inner").join(above, ["hub_doc", "hub_at"], "left")
    flat = same.where("not inner").select(*_NODE, *hub).unionByName(inner.select(*_NODE, *(F.coalesce(f"up_{c}", c).alias(c) for c in hub)))
    size = cluster.count()
    to = cluster.select(F.col("n_doc").alias("hub_doc"), F.col("n_at").alias("hub_at"), "root")
    copies = flat.join(bounded_bytes(to, size * 80), ["hub_doc", "hub_at"], "left").select(*_NODE, *(F.coalesce(f"root.{c}", f"hub_{c}").alias(f"r_{c}") for c in _NODE[:3]))
    others = cluster.select(*(F.col(f"node.{c}").alias(c) for c in _NODE), *(F.col(f"root.{c}").alias(f"r_{c}") for c in _NODE[:3]))
    removed = copies.unionByName(others).where("doc <> r_doc").dropDuplicates(["doc", "at"])

    order = W.partitionBy("doc").orderBy("at")
    run = F.sum(F.when(F.col("at") == F.lag(F.col("at") + F.col("size")).over(order), 0).otherwise(1)).over(order)
    pos = lambda a, s: F.col(a) + F.col(s)
    runs = stage(
        removed.withColumn("run", run).groupBy("doc", "run").agg(
            F.min("at").alias("begin"), F.max(pos("at", "size")).alias("stop"), F.sum("words").alias("n_words"),
            F.min_by(F.struct("r_doc", F.col("r_at").alias("pos")), "at").alias("l"), F.max_by(F.struct("r_doc", pos("r_at", "r_size").alias("pos")), "at").alias("r"), F.collect_set("r_doc").alias("kept"),
        ), "runs",
    )
    side = lambda at, near, k: F.struct(F.col(at).alias("pos"), F.lit(k).cast("long").alias("side"), F.col(near)["r_doc"].alias("o_doc"), F.col(near)["pos"].alias("o_pos"))
    ends = runs.select("doc", "run", F.explode(F.array(side("begin", "l", 0), side("stop", "r", 1))).alias("e")).select("doc", "run", "e.*")
    asks = ends.select("doc", F.col("pos").alias("a"), F.col("side").alias("b")).unionByName(ends.select(F.col("o_doc").alias("doc"), F.col("o_pos").alias("a"), F.col("side").alias("b"))).distinct()
    around = stage(_contexts(_asked(rows, asks, "ends")), "contexts")
    beside = around.select(F.col("doc").alias("o_doc"), F.col("pos").alias("o_pos"), "side", F.col("hashes").alias("other"))
    grown = _grown(ends.join(around, ["doc", "pos", "side"]).join(beside, ["o_doc", "o_pos", "side"], "left").select("doc", "run", "side", "pos", "edge", "hashes", "places", "other"))
    reach = grown.groupBy("doc", "run").agg(F.min(F.when(F.col("side") == 0, F.col("reach"))).alias("begin"), F.max(F.when(F.col("side") == 1, F.col("reach"))).alias("end"), F.sum("more").alias("more"))
    wide = runs.drop("begin", "stop").join(reach, ["doc", "run"])
    order = W.partitionBy("doc").orderBy("begin", "run")
    before = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    joined = wide.withColumn("span", F.sum(F.when(F.col("begin") <= before + GAP_BYTES, 0).otherwise(1)).over(order))
    spans = joined.groupBy("doc", "span").agg(F.min("begin").alias("begin"), F.max("end").alias("end"), F.sum(F.col("n_words") + F.col("more")).alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("kept")))).alias("kept"))
    return spans.where(F.col("n_words") >= least_words).drop("span")


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, begin, end, n_words, kept_doc_ids): the repeated passages to remove from each document, as
    byte offsets into its UTF-8 text, and the documents in which their paragraphs stay.

    Neighbouring paragraphs make one span, which grows word by word as far as the passages agree; spans at most
    GAP_BYTES apart are one.  A span has at least ``least_words`` words.  Repeats within one document stay.  Null or
    empty texts and rows with a null doc_id have none, nor has an empty table.  Rows that repeat a doc_id and its
    text are one document; different texts under one doc_id are documents of their own.
    """
    bound_batches(docs.sparkSession)
    rows, names = row_ids(docs.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")), "doc_id", "text")
    spans = _spans(rows.select("doc", "text"), percent, least_words)
    if names is None:
        return spans.select(F.col("doc").alias("doc_id"), "begin", "end", "n_words", F.col("kept").alias("kept_doc_ids"))
    spans = stage(spans, "spans")
    named = lambda c: F.coalesce(F.col("doc_id"), F.col(c)).alias("doc_id")
    kept = spans.select("doc", "begin", F.explode("kept").alias("k")).join(names.withColumnRenamed("doc", "k"), "k", "left").select("doc", "begin", named("k"))
    kept = kept.groupBy("doc", "begin").agg(F.array_sort(F.collect_set("doc_id")).alias("kept_doc_ids"))
    return spans.join(kept, ["doc", "begin"]).join(names, "doc", "left").select(named("doc"), "begin", "end", "n_words", "kept_doc_ids")


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the byte ranges; where a cut joins two runs of white space the first one stays."""
    data, out, at = text.encode(), [], 0
    for begin, end in sorted(spans):
        out.append(data[at:begin])
        at = max(at, end)
        if (not out[-1] and len(out) == 1) or (out[-1] and out[-1][-1:].isspace()):
            while at < len(data) and data[at : at + 1].isspace():
                at += 1
    out.append(data[at:])
    return b"".join(out).decode().rstrip() if at >= len(data) else b"".join(out).decode()


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", length: str | None = "n_chars", percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with the repeated passages of :func:`repeated_spans` cut out; ``length``, if it is a column, is
    set anew for the texts that change.  A document of which nothing but white space is left goes.  Rows are judged by
    doc_id and text; rows with a null doc_id or text, and those without repeats, stay as they are."""
    bound_batches(docs.sparkSession)
    columns, schema = docs.columns, docs.schema
    names = [f"c{i}" for i in range(len(columns))]
    at, size_at = columns.index(text), columns.index(length) if length in columns else -1
    k, t = names[columns.index(key)], names[at]
    plain, _ = row_ids(docs.toDF(*names), k, t)
    found = stage(_spans(plain.where(f"doc is not null and {t} is not null").select("doc", F.col(t).cast("string").alias("text")), percent, least_words), "spans")
    spans = stage(found.groupBy("doc").agg(F.collect_list(F.struct("begin", "end")).alias("spans")), "cuts")

    def apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, cuts, lost = b.column(at).to_pylist(), b.column(len(columns)), []
            for i in np.flatnonzero(cuts.is_valid().to_numpy(zero_copy_only=False)):
                if texts[i] is not None:
                    texts[i] = cut_spans(texts[i], [(s["begin"], s["end"]) for s in cuts[int(i)].as_py()])
                    lost.append(i)
            held = list(b.columns[: len(columns)])
            held[at] = pa.array(texts, pa.string())
            if size_at >= 0 and lost:
                sizes = b.column(size_at).to_pylist()
                for i in lost:
                    sizes[i] = len(texts[i])
                held[size_at] = pa.array(sizes, b.column(size_at).type)
            stay = np.ones(b.num_rows, bool)
            stay[[i for i in lost if not texts[i].strip()]] = False
            yield pa.RecordBatch.from_arrays(held, names=names).filter(pa.array(stay))

    held = spans.agg(F.sum(F.size("spans") * 32 + 48)).first()[0] or 0
    joined = plain.join(bounded_bytes(spans, held), "doc", "left").select(*names, "spans")
    typed = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, schema, strict=True))
    return joined.mapInArrow(apply, typed).toDF(*columns)
