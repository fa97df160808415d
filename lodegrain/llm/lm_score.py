"""Language-model scores from a log-frequency Bloom filter of n-gram counts.

The filter holds no counts as such: an n-gram seen c times is entered once for each level 1 .. 1 + log2(c), and
a count is read back by probing levels until one is missing.  It is built in slices, each from the n-grams of
one hash range and as long as its entries need (about 12 bits each, 1 % false hits a level).  All bits of an entry lie
in one 64-bit word, so a level is read by one look into memory.  A filter of at most
PART_BYTES is broadcast.  A larger one stays in its slices: the probes of a piece of documents travel to them, packed
by up to 16 neighbouring slices, and the levels travel back to the piece, so there is one pass over the documents at any size.

The model interpolates bigrams with add-one unigrams.  Bigram counts are discounted by n1 / (n1 + 2 n2), n1 and n2
being the numbers of bigrams seen once and twice, as most of those seen once say little.  Every unigram and every bigram of the training texts is
entered, and the counts of tokens, pairs and histories are all read from the filter, at any size of the corpus; the number of
texts, the count of a text's beginning, is known.  The base score takes exact counts: those of head tokens, with at least a
millionth of all tokens, of which there can only be 2**20, are broadcast; those of all others meet the documents' tokens in
packed bins by hash range.  All counts cover every training document.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegrain.sources.workspace import spread

from .common import bound_batches, stage
from .kernels import Words, buffers, mix, pieces, release

HEAD = 1 << 20
PART_BYTES = 128 * 1024 * 1024
BITS_PER_ENTRY, PROBES = 12, 5
#: Slices, or buckets, that are asked together: 2**4, if at least 2**6 groups are left.
TOGETHER, LEAST_GROUPS = 4, 6
BUCKET_KEYS = 1 << 20
MIXTURE, TRUST = 0.25, 100.0
LOCAL_KEYS = 2_000_000
_U = np.uint64
END, BEGIN = (int(x) for x in mix(np.array([0x0E4D, 0xBE61], dtype=np.uint64)))
_ONE, _TWO = _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9)


def sequence(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, token, history) of every token: each row's words, then one end."""
    n_rows = len(words.count)
    size = words.count + 1
    row = np.repeat(np.arange(n_rows), size)
    token = np.full(len(row), END, np.uint64)
    stop = np.cumsum(size)
    inner = np.ones(len(row), bool)
    inner[stop - 1] = False
    token[inner] = words.hash
    history = np.empty_like(token)
    history[1:] = token[:-1]
    history[stop - size] = BEGIN
    return row, token, history


def unigram_key(token: np.ndarray) -> np.ndarray:
    return mix(token * _ONE)


def bigram_key(history: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mix(history * _TWO + mix(token ^ _ONE))


def quantise(count: np.ndarray) -> np.ndarray:
    """Level of a count: 1 + floor(log2(count)); 0 for none."""
    return np.where(count > 0, np.frexp(count.astype(np.float64))[1], 0)


def level_count(level: np.ndarray) -> np.ndarray:
    """The middle of a level's counts; 0 for level 0."""
    return np.where(level > 0, (np.exp2(level - 1.0) + np.exp2(level.astype(np.float64)) - 1) / 2, 0.0)


class Layout:
    """Where a key lives: a slice by its first bits."""

    def __init__(self, bits: int):
        self.bits, self.slices = bits, 1 << bits

    def place(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = key >> _U(64 - self.bits) if self.bits else np.zeros(len(key), np.uint64)
        return own.astype(np.int64), (key & _U(0xFFFFFFFF)).astype(np.uint32)

    def codes(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(slice, key within it) of the distinct keys in order, and where each key is among them."""
        place, sub = self.place(key)
        code, back = np.unique(place.astype(np.uint64) << _U(32) | sub, return_inverse=True)
        return (code >> _U(32)).astype(np.int64), (code & _U(0xFFFFFFFF)).astype(np.uint32), back


def _entry(sub: np.ndarray, level: int, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The word of each n-gram's entry for a level, of so many, and a hash whose first bits, six by six, name bits of it."""
    h = mix(sub.astype(np.uint64) | _U(level << 32))
    return ((h >> _U(32)) * words) >> _U(32), h


def _bit(h: np.ndarray, i: int) -> np.ndarray:
    return (h >> _U(6 * i)) & _U(63)


def build_slice(sub: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Bytes of the slice of n-grams ``sub`` seen ``count`` times; empty for none."""
    level = quantise(count)
    total = int(level.sum())
    if not total:
        return np.zeros(0, np.uint8)
    words = -(-total * BITS_PER_ENTRY // 64)
    held = np.zeros(words * 64, bool)
    for j in range(1, int(level.max()) + 1):
        word, h = _entry(sub[level >= j], j, _U(words))
        for i in range(PROBES):
            held[(word << _U(6)) | _bit(h, i)] = True
    return np.packbits(held, bitorder="little")


class LogBloom:
    """Some slices of the filter, one after another."""

    def __init__(self, slices: dict[int, bytes], n_slices: int):
        size = np.zeros(n_slices + 1, np.int64)
        for q, data in slices.items():
            size[q + 1] = len(data)
        self.begin = np.cumsum(size)
        self.has = np.zeros(n_slices, bool)
        self.has[list(slices)] = True
        self.data = np.frombuffer(b"".join(slices[q] for q in sorted(slices)), np.uint64)

    def level(self, place: np.ndarray, sub: np.ndarray) -> np.ndarray:
        """Level of each n-gram, by probing levels until one is missing."""
        level = np.zeros(len(sub), np.int64)
        words = (self.begin[place + 1] - self.begin[place]) >> 3
        live = np.flatnonzero(words > 0)
        begin, words, sub = (self.begin[place[live]] >> 3).astype(np.uint64), words[live].astype(np.uint64), sub[live]
        for j in range(1, 64):
            if not len(live):
                break
            word, h = _entry(sub, j, words)
            need = _U(1) << _bit(h, 0)
            for i in range(1, PROBES):
                need |= _U(1) << _bit(h, i)
            hit = self.data[begin + word] & need == need
            live, begin, words, sub = live[hit], begin[hit], words[hit], sub[hit]
            level[live] = j
        return level


def _merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(count, first) if len(first) else count


def _tally(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = np.sort(x)
    first = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)
    return x[first], np.diff(np.append(first, len(x)))


def _bits_for(total: int, least: int) -> int:
    return max(least, int(np.ceil(np.log2(max(1, total / BUCKET_KEYS)))))


def together(bits: int) -> int:
    """Of 2**bits slices, 2**so many neighbours are asked together, so a piece makes few records for each of them."""
    return max(0, min(TOGETHER, bits - LEAST_GROUPS))


def unigram_counts(train: DataFrame, bits: int) -> DataFrame:
    """(bucket, token binary, count binary, n_tokens, n_types): exact counts, sorted by token hash."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        counts: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            k, c = _merged(keys, counts)
            keys.clear(), counts.clear()
            at = np.append(np.searchsorted(k, np.arange(1 << bits, dtype=np.uint64) << _U(64 - bits)), len(k))
            used = [q for q in range(1 << bits) if at[q] < at[q + 1]]
            return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([k[at[q] : at[q + 1]].tobytes() for q in used], pa.binary()), pa.array([c[at[q] : at[q + 1]].astype(np.int64).tobytes() for q in used], pa.binary())], names=["bucket", "token", "count"])

        for b in batches:
            for i, j in pieces(b.column(1)):
                k, c = _tally(sequence(Words(*buffers(b.column(1).slice(i, j - i))))[1])
                keys.append(k)
                counts.append(c)
                if sum(map(len, keys)) > LOCAL_KEYS:
                    merged = _merged(keys, counts)
                    keys[:], counts[:] = [merged[0]], [merged[1]]
                    if len(keys[0]) > LOCAL_KEYS // 2:
                        yield flush()
        if keys:
            yield flush()

    def add(group: pa.Table) -> pa.Table:
        release()
        k, c = _merged([np.frombuffer(x, _U) for x in group["token"].to_pylist()], [np.frombuffer(x, np.int64) for x in group["count"].to_pylist()])
        return pa.table({"bucket": [group["bucket"][0].as_py()], "token": [k.tobytes()], "count": [c.tobytes()], "n_tokens": [int(c.sum())], "n_types": [len(k)]}, schema=pa.schema([("bucket", pa.int32()), ("token", pa.binary()), ("count", pa.binary()), ("n_tokens", pa.int64()), ("n_types", pa.int64())]))

    return train.mapInArrow(cut, "bucket int, token binary, count binary").groupBy("bucket").applyInArrow(add, "bucket int, token binary, count binary, n_tokens long, n_types long")


def _slices(train: DataFrame, unigrams: DataFrame, layout: Layout) -> DataFrame:
    """(slice, single, data, ones, twos): the filter's slices from all unigrams (``single``) and from all bigrams, and how
    many of a slice's n-grams were seen once and twice."""
    schema = "slice int, sub binary, count binary"

    def packed(place: np.ndarray, sub: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(place, kind="stable")
        place, sub, count = place[order], sub[order], np.minimum(count[order], 2**31 - 1).astype(np.uint32)
        small = count < 256
        used, at = np.unique(place, return_index=True)
        at = np.append(at, len(place))
        pack = lambda a, z: (count[a:z].astype(np.uint8).tobytes() if small[a:z].all() else count[a:z].tobytes())
        return pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([sub[a:z].tobytes() for a, z in zip(at[:-1], at[1:], strict=True)], pa.binary()), pa.array([pack(a, z) for a, z in zip(at[:-1], at[1:], strict=True)], pa.binary())], names=["slice", "sub", "count"])

    def singles(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[], []]

        def flush() -> pa.RecordBatch:
            token, count = map(np.concatenate, held)
            held[0].clear(), held[1].clear()
            return packed(*layout.place(unigram_key(token)), count)

        for b in batches:
            for t, c in zip(b.column(0), b.column(1), strict=True):
                token, count = np.frombuffer(t.as_buffer(), _U), np.frombuffer(c.as_buffer(), np.int64)
                held[0].append(token)
                held[1].append(count)
                if sum(map(len, held[0])) > LOCAL_KEYS:
                    yield flush()
        if held[0]:
            yield flush()

    def pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[], []]

        def flush() -> pa.RecordBatch:
            code, count = _merged(*held)
            held[0].clear(), held[1].clear()
            return packed((code >> _U(32)).astype(np.int64), (code & _U(0xFFFFFFFF)).astype(np.uint32), count)

        for b in batches:
            for i, j in pieces(b.column(1)):
                _, token, history = sequence(Words(*buffers(b.column(1).slice(i, j - i))))
                place, sub = layout.place(bigram_key(history, token))
                code, count = _tally(place.astype(np.uint64) << _U(32) | sub)
                held[0].append(code)
                held[1].append(count)
                if sum(map(len, held[0])) > 2 * LOCAL_KEYS:
                    yield flush()
        if held[0]:
            yield flush()

    def build(group: pa.Table) -> pa.Table:
        release()
        subs, counts = [], []
        for s, c in zip(group["sub"].to_pylist(), group["count"].to_pylist(), strict=True):
            subs.append(np.frombuffer(s, np.uint32))
            counts.append(np.frombuffer(c, np.uint8 if len(c) * 4 == len(s) else np.uint32).astype(np.int64))
        single = [s == "1" for s in group["kind"].to_pylist()]
        kinds = [x for x in (True, False) if x in single]
        merged = [_merged([s for s, x in zip(subs, single, strict=True) if x == kind], [c for c, x in zip(counts, single, strict=True) if x == kind]) for kind in kinds]
        data, seen = [build_slice(*m).tobytes() for m in merged], [[int((c == n).sum()) for _, c in merged] for n in (1, 2)]
        return pa.table({"slice": [group["slice"][0].as_py()] * len(kinds), "single": kinds, "data": data, "ones": seen[0], "twos": seen[1]}, schema=pa.schema([("slice", pa.int32()), ("single", pa.bool_()), ("data", pa.binary()), ("ones", pa.int64()), ("twos", pa.int64())]))

    one = unigrams.select("token", "count").mapInArrow(singles, schema).withColumn("kind", F.lit("1"))
    two = train.mapInArrow(pairs, schema).withColumn("kind", F.lit("2"))
    return one.unionByName(two).groupBy("slice").applyInArrow(build, "slice int, single boolean, data binary, ones long, twos long")


class Asked:
    """The tokens of a piece of texts, and the distinct n-grams whose counts they need."""

    def __init__(self, texts: pa.Array, layout: Layout):
        words = Words(*buffers(texts))
        self.n = len(words.count)
        self.row, self.token, self.history = sequence(words)
        self.single = layout.codes(unigram_key(self.token))
        self.pair = layout.codes(bigram_key(self.history, self.token))

    def scores(self, single: np.ndarray, pair: np.ndarray, texts: int, floor: int, discount: float) -> np.ndarray:
        """log10 probability of each text from the levels of the distinct unigrams and bigrams, learnt from so many ``texts``."""
        one, two = level_count(single)[self.single[2]], level_count(pair)[self.pair[2]]
        after = np.empty(len(one))
        after[1:] = one[:-1]
        after[self.history == _U(BEGIN)] = texts
        trust = MIXTURE * after / (after + TRUST)
        after = np.maximum(after, 1)
        # what the discount takes from a history's bigrams is at least ``discount``, and so much goes to unigrams
        chance = trust * np.minimum(1.0, np.maximum(two - discount, 0) / after) + (1 - trust + trust * discount / after) * (one + 1) / floor
        return np.bincount(self.row, np.log10(chance), self.n)


def exact_counts(token: np.ndarray, head: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of head tokens, and which are such; the others have 0."""
    if not len(head[0]):
        return np.zeros(len(token), np.int64), np.zeros(len(token), bool)
    at = np.minimum(np.searchsorted(head[0], token), len(head[0]) - 1)
    known = head[0][at] == token
    return np.where(known, head[1][at], 0), known


def _packed_texts(texts: pa.Array) -> bytes:
    """The texts of a piece, compressed, as they are shuffled twice."""
    sink, batch = pa.BufferOutputStream(), pa.RecordBatch.from_arrays([texts], names=["texts"])
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


_EXACT, _SINGLE, _PAIR = 0, 1 << 40, 2 << 40


def score_documents(docs: DataFrame, train: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, is_train, n_tokens, n_known, train_tokens, base_score, score) of every row.

    ``train`` marks the rows to learn from.  ``base_score`` is the sum over tokens of log10((c + 1) / (N + V
    + 1)) with exact counts; ``score`` is the model's log10 probability.  A null or empty text is one end token.
    Without training rows all counts are 0.  Null keys and repeated rows are kept, and learnt from, each.
    """
    bound_batches(docs.sparkSession)
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    rows = spread(docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"), F.coalesce(train, F.lit(False)).alias("_train")))
    learn = rows.where("_train").select("_key", "_text")
    size = learn.agg(F.count("*"), F.sum(F.length("_text"))).first()
    bits = _bits_for((size[1] or 0) // 6, 6)
    unigrams = stage(unigram_counts(learn, bits), "unigrams")
    total = unigrams.agg(F.sum("n_tokens"), F.sum("n_types")).first()
    n_all, n_types = total[0] or 0, total[1] or 0
    least = max(1, -(-n_all // HEAD))

    def pick(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t, c in zip(b.column(0), b.column(1), strict=True):
                token, count = np.frombuffer(t.as_buffer(), np.int64), np.frombuffer(c.as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(token[count >= least]), pa.array(count[count >= least])], names=["token", "count"])

    top = unigrams.select("token", "count").mapInArrow(pick, "token long, count long").toArrow()  # at most HEAD rows
    token = top["token"].to_numpy().view(np.uint64)
    order = np.argsort(token)
    head = spark.sparkContext.broadcast((token[order], top["count"].to_numpy()[order]))
    layout = Layout(_bits_for(2 * n_all, 6))
    slices = stage(_slices(learn, unigrams, layout), "bloom")
    seen = slices.agg(F.sum(F.length("data")), F.sum(F.when(~F.col("single"), F.col("ones"))), F.sum(F.when(~F.col("single"), F.col("twos")))).first()
    held, once, twice = (x or 0 for x in seen)
    discount = once / (once + 2 * twice) if once else 0.0
    whole = None
    if held <= PART_BYTES:
        filtered = lambda kind: LogBloom({r["slice"]: bytes(r["data"]) for r in slices.where(F.col("single") == kind).toLocalIterator()}, layout.slices)
        whole = spark.sparkContext.broadcast((filtered(True), filtered(False)))
    floor = n_all + n_types + 1
    share, joint = together(bits), together(layout.bits)
    buckets = 1 << bits - share
    homes = [_EXACT | q for q in range(buckets)] + [base | q for base in (() if whole else (_SINGLE, _PAIR)) for q in range(layout.slices >> joint)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a piece, by what they ask: exact counts of its rare tokens and, of a filter that is not here,
        levels; one of them, any, carries the piece's sums so far."""
        k = 0
        for b in batches:
            part = b.column(3)[0].as_py() if b.num_rows else 0
            for i, j in pieces(b.column(1)):
                texts, ids = b.column(1).slice(i, j - i), b.column(0).slice(i, j - i)
                a = Asked(texts, layout)
                piece, k = part << 24 | k, k + 1
                exact, known = exact_counts(a.token, head.value)
                train = b.column(2).slice(i, j - i).to_numpy(zero_copy_only=False)
                info = np.concatenate([np.bincount(a.row, np.log10(exact + 1.0), a.n), np.bincount(a.row[known], minlength=a.n), np.bincount(a.row, minlength=a.n), train]).astype(np.float64)
                score = a.scores(whole.value[0].level(*a.single[:2]), whole.value[1].level(*a.pair[:2]), size[0], floor, discount).tobytes() if whole else None
                rare = np.flatnonzero(~known)
                order = rare[np.argsort(a.token[rare], kind="stable")]
                cuts = np.append(np.searchsorted(a.token[order], np.arange(buckets, dtype=np.uint64) << _U(64 - bits + share)), len(order))
                # one of the groups that are asked carries the piece's own columns, which may be its texts
                home = homes[int(mix(np.array([piece], np.uint64))[0] % _U(len(homes)))]
                used = [q for q in range(buckets) if cuts[q] < cuts[q + 1] or _EXACT | q == home]
                group = [_EXACT | q for q in used]
                asks = [a.token[order[cuts[q] : cuts[q + 1]]].tobytes() for q in used]
                at = [a.row[order[cuts[q] : cuts[q + 1]]].astype(np.uint16).tobytes() for q in used]
                for base, (place, sub, _) in () if whole else ((_SINGLE, a.single), (_PAIR, a.pair)):
                    ends = np.searchsorted(place, np.arange(layout.slices + 1))
                    for q in range(layout.slices >> joint):
                        within = ends[q << joint : (q + 1 << joint) + 1]
                        if within[0] < within[-1] or base | q == home:
                            group.append(base | q)
                            asks.append(sub[within[0] : within[-1]].tobytes())
                            at.append(np.diff(within).astype(np.uint32).tobytes())
                own = [q == home for q in group]
                mine = lambda x, t: pa.array([x if o else None for o in own], t)
                yield pa.RecordBatch.from_arrays([
                    pa.array(group, pa.int64()), pa.array([piece] * len(group), pa.int64()), pa.array(asks, pa.binary()), pa.array(at, pa.binary()),
                    mine(info.tobytes(), pa.binary()), mine(score, pa.binary()), mine(ids.to_pylist(), pa.list_(b.column(0).type)), mine(None if whole else _packed_texts(texts), pa.binary()),
                ], names=names)

    names = ["group", "piece", "asks", "row", "info", "score", "ids", "texts"]
    extra = f"info binary, score binary, ids array<{kind}>, texts binary"
    asked = rows.withColumn("_part", F.spark_partition_id()).mapInArrow(run, f"group long, piece long, asks binary, row binary, {extra}")

    def look(group: pa.Table) -> pa.Table:
        release()
        base = group["group"][0].as_py() & (_SINGLE | _PAIR)
        held = group.filter(pa.compute.is_valid(group["known"])).select(["part", "known", "count"]).sort_by("part")
        table = list(zip(*(held[c].to_pylist() for c in held.column_names), strict=True))
        own = group.filter(pa.compute.is_valid(group["piece"]))
        replies = []
        if base:
            bloom = LogBloom({q: data for q, data, _ in table}, 1 << joint)
            asks = [np.frombuffer(t, np.uint32) for t in own["asks"].to_pylist()]
            sizes = [np.frombuffer(r, np.uint32) for r in own["row"].to_pylist()]
            x = 0
            while x < len(asks):  # the asks of many pieces at a time
                y, n = x, 0
                while y < len(asks) and (y == x or n + len(asks[y]) <= LOCAL_KEYS // 4):
                    n += len(asks[y])
                    y += 1
                place = np.repeat(np.tile(np.arange(1 << joint), y - x), np.concatenate(sizes[x:y]))
                level = bloom.level(place, np.concatenate(asks[x:y])).astype(np.uint8)
                ends = np.cumsum([len(t) for t in asks[x:y]])
                replies += [level[e - len(t) : e].tobytes() for t, e in zip(asks[x:y], ends, strict=True)]
                x = y
        elif table:  # buckets in order, so tokens are
            known, count = (np.concatenate([np.frombuffer(t[k], kind) for t in table]) for k, kind in ((1, _U), (2, np.int64)))
        for t, r in () if base else zip(own["asks"].to_pylist(), own["row"].to_pylist(), strict=True):
            if not t or not table:
                replies.append(None)
            else:
                t, r = np.frombuffer(t, _U), np.frombuffer(r, np.uint16)
                at = np.minimum(np.searchsorted(known, t), len(known) - 1)
                hit = known[at] == t
                n = int(r.max()) + 1
                replies.append(np.concatenate([np.bincount(r[hit], np.log10(count[at[hit]] + 1.0), n), np.bincount(r[hit], minlength=n).astype(np.float64)]).tobytes())
        return pa.table({"piece": own["piece"], "group": own["group"], "reply": pa.array(replies, pa.binary()), "info": own["info"], "score": own["score"], "ids": own["ids"], "texts": own["texts"]})

    def gather(group: pa.Table) -> pa.Table:
        release()
        group = group.sort_by("group")
        k = next(i for i, x in enumerate(group["info"]) if x.is_valid)
        base, known, n_tokens, is_train = np.frombuffer(group["info"][k].as_py(), np.float64).reshape(4, -1)
        base, known = base.copy(), known.copy()
        levels: dict[int, list[np.ndarray]] = {_SINGLE: [], _PAIR: []}
        for q, x in zip(group["group"].to_pylist(), group["reply"].to_pylist(), strict=True):
            if q >= _SINGLE:
                levels[q & (_SINGLE | _PAIR)].append(np.frombuffer(x, np.uint8))
            elif x is not None:
                s, c = np.frombuffer(x, np.float64).reshape(2, -1)
                base[: len(s)] += s
                known[: len(c)] += c
        if levels[_SINGLE]:  # the replies are in order of slice, as the distinct n-grams of the piece are
            a = Asked(pa.ipc.open_stream(group["texts"][k].as_buffer()).read_all()["texts"], layout)
            score = a.scores(*(np.concatenate(levels[x]).astype(np.int64) for x in (_SINGLE, _PAIR)), size[0], floor, discount)
        else:
            score = np.frombuffer(group["score"][k].as_py(), np.float64)
        return pa.table({"_key": group["ids"][k].values, "is_train": pa.array(is_train > 0), "n_tokens": n_tokens.astype(np.int64), "n_known": known.astype(np.int64), "train_tokens": np.full(len(base), n_all, np.int64), "base_score": base - n_tokens * np.log10(float(floor)), "score": score})

    blank = lambda t, n: F.lit(None).cast(t).alias(n)
    rest = [blank("long", "piece"), blank("binary", "asks"), blank("binary", "row"), blank("binary", "info"), blank("binary", "score"), blank(f"array<{kind}>", "ids"), blank("binary", "texts")]
    table = unigrams.select(F.shiftright(F.col("bucket"), share).cast("long").alias("group"), *rest, F.col("bucket").alias("part"), F.col("token").alias("known"), "count")
    if whole is None:
        own = F.when(F.col("single"), F.lit(_SINGLE)).otherwise(F.lit(_PAIR)) + F.shiftright(F.col("slice"), joint)
        part = F.col("slice").bitwiseAND((1 << joint) - 1)
        table = table.unionByName(slices.where(F.length("data") > 0).select(own.alias("group"), *rest, part.alias("part"), F.col("data").alias("known"), blank("binary", "count")))
    replies = asked.withColumn("part", blank("int", "part")).withColumn("known", blank("binary", "known")).withColumn("count", blank("binary", "count")).unionByName(table)
    replies = replies.groupBy("group").applyInArrow(look, f"piece long, group long, reply binary, {extra}")
    return replies.groupBy("piece").applyInArrow(gather, f"_key {kind}, is_train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double").withColumnRenamed("_key", key)
