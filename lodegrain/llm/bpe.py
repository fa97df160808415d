"""BPE encoding as a streaming transducer with bounded lookahead, and incremental decoding.

The merge list fixes how far to the right a token boundary can depend on: :func:`sufficient_lookahead`
computes that bound once.  A word is fed through a window; a boundary that lies at least that far from the
window's end is stable whatever follows, and what is on its two sides tokenizes independently, so the tokens
up to it are emitted and dropped.  Tokens and digests are streamed in constant memory; a text is normalised in pieces
that end at white space, one without any as a whole.  Short words fit into one window, and their tokens are kept in a
cache of bounded size.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodegrain.sources.workspace import spread

from .common import bound_batches

#: Bytes that a worker's cache of words may take, and about what an entry takes besides its word and tokens.
CACHE_BYTES, ENTRY_BYTES = 24 * 1024 * 1024, 200
_TOKEN_BITS = 20
_TOKEN, _NONE = (1 << _TOKEN_BITS) - 1, 1 << 62
CHUNK = 1 << 18
#: White space of the tokenizer's regular expressions (fixed values).
_SPACE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Letters and numbers up to U+017F (fixed values), for texts with no other characters.
_LATIN = "A-Za-z\\xaa\\xb5\\xba\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\u024f"
_DIGIT = "0-9\\xb2\\xb3\\xb9\\xbc-\\xbe"
_CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
_WORD_SPLIT = _CONTRACTIONS + r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_BEYOND = re.compile("[^\\x00-\\u017f]")
_FAST = re.compile(f"{_CONTRACTIONS}|[{_LATIN}]+|[{_DIGIT}]|[^{_SPACE}{_LATIN}{_DIGIT}]+")
_BREAK = re.compile(f"[{_SPACE}]")


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 stands for itself,
    the others follow from U+0100 on in order."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


def sufficient_lookahead(merges: list[tuple[int, int]], made: list[int], length: dict[int, int], text: dict[int, str], size_of: dict[str, int]) -> int:
    """Symbols after a boundary beyond which nothing can change it.

    Run the merges over a window and over any continuation of it.  By rank, the two can first differ at a
    boundary only if a merge (u, v) there sees a different right neighbour: v's end reaches the window's
    end (at most |v| symbols), or a boundary inside v was merged in one run and not in the other, or one
    just behind v was, in a longer token that begins with v.  Each refers to an earlier merge, so one pass in
    rank order bounds the distance of every merge, and the largest distance is sufficient.
    """
    inner: dict[int, list[tuple[int, int]]] = {}  # token: (offset, distance of the merge at that offset)
    behind: dict[int, int] = {}  # token v: the largest distance of a merge just behind it
    most = 1
    for (u, v), t in zip(merges, made, strict=True):
        far = max([length[v], *(o + d for o, d in inner.get(v, ()))])
        if v in behind:
            far = max(far, length[v] + behind[v])
        most = max(most, far)
        if t in inner:  # another way to the same token: both sets of merges can be inside
            old = dict(inner[t])
        else:
            old = {}
        n = length[u]
        for o, d in [*inner.get(u, ()), (n, far), *((n + o, d) for o, d in inner.get(v, ()))]:
            old[o] = max(old.get(o, 0), d)
        inner[t] = sorted(old.items())
        for o, d in inner[t]:
            head = size_of.get((text[t], o))
            if head is not None:
                behind[head] = max(behind.get(head, 0), d)
    return most


class Transducer:
    """Encoder and decoder of one tokenizer file (BPE with byte-level symbols and word ends)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        split = [p for p in spec["pre_tokenizer"]["pretokenizers"]]
        steps = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or steps != ["NFC", "Replace", "Lowercase"] or split[0]["pattern"] != {"Regex": _WORD_SPLIT} or spec["decoder"] is not None:
            raise ValueError(f"{path}: not a tokenizer of the kind handled here")
        vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        merges = [(vocab[a], vocab[b]) for a, b in pairs]
        made = [vocab[a + b] for a, b in pairs]
        self.rank = {}
        for i, (m, t) in enumerate(zip(merges, made, strict=True)):
            self.rank.setdefault(m, (i, t))
        self.coded = {m: i << _TOKEN_BITS | t for m, (i, t) in self.rank.items()}
        symbol = byte_symbols()
        self.byte_of = {c: b for b, c in enumerate(symbol)}
        self.library = Tokenizer.from_file(path)
        self.middle = [vocab[s] for s in symbol]
        self.last = [vocab[s + self.end] for s in symbol]
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.out = [names.get(i, "").encode() for i in range(max(names) + 1)]
        length = {i: len(t.removesuffix(self.end)) for t, i in vocab.items()}
        text = {i: t for t, i in vocab.items()}
        heads = {(text[t], o): h for t in set(made) for o in range(1, length[t]) if (h := vocab.get(text[t][:o])) is not None}
        self.lookahead = sufficient_lookahead(merges, made, length, text, heads)
        self.length = length
        self.words: dict[str, bytes] = {}
        self.held = 0

    def merge(self, ids: list[int]) -> list[int]:
        """Apply the merges to a short run of symbols: lowest rank first, left to right."""
        get = self.coded.get
        pairs = [get(p, _NONE) for p in zip(ids, ids[1:])]
        while pairs:
            least = min(pairs)
            if least == _NONE:
                break
            i = pairs.index(least)
            ids[i] = least & _TOKEN
            del ids[i + 1], pairs[i]
            if i:
                pairs[i - 1] = get((ids[i - 1], ids[i]), _NONE)
            if i < len(pairs):
                pairs[i] = get((ids[i], ids[i + 1]), _NONE)
        return ids

    def merge_long(self, ids: list[int]) -> list[int]:
        """The same by a queue, for windows."""
        n, ids = len(ids), list(ids)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        rank, live = self.rank, [True] * n
        queue = [(got[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (got := rank.get((ids[i], ids[i + 1])))]
        heapq.heapify(queue)
        while queue:
            _, i, a, b = heapq.heappop(queue)
            j = nxt[i]
            if not live[i] or j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], live[j], nxt[i] = rank[a, b][1], False, nxt[j]
            if nxt[j] < n:
                prv[nxt[j]] = i
            for left in ((prv[i], i) if prv[i] >= 0 else (i,)):
                right = nxt[left]
                if right < n and (got := rank.get((ids[left], ids[right]))):
                    heapq.heappush(queue, (got[0], left, ids[left], ids[right]))
        return [x for x, ok in zip(ids, live, strict=True) if ok]

    def stream_word(self, data: bytes) -> Iterator[list[int]]:
        """Tokens of one word, in runs, each emitted once it is stable."""
        look = self.lookahead
        middle, begin, n, window = self.middle, 0, len(data), 4 * look
        while begin < n:
            stop = min(n, begin + window)
            ids = [middle[b] for b in data[begin:stop]]
            if stop == n:
                ids[-1] = self.last[data[-1]]
                yield self.merge_long(ids)
                return
            out, at = [], 0
            for t in self.merge_long(ids):
                if at + self.length[t] > window - look:
                    break
                out.append(t)
                at += self.length[t]
            if not out:  # cannot happen while the window is wider than lookahead plus the longest token
                raise RuntimeError("window too narrow")
            yield out
            begin += at

    def _miss(self, word: str) -> bytes:
        data = word.encode(errors="surrogateescape")
        if len(data) <= 24:
            ids = [self.middle[b] for b in data]
            ids[-1] = self.last[data[-1]]
            found = np.array(self.merge(ids), dtype="<u4").tobytes()
        else:
            found = b"".join(np.array(r, dtype="<u4").tobytes() for r in self.stream_word(data))
        if len(data) <= 64:
            self.held += ENTRY_BYTES + 2 * len(word) + len(found)
            if self.held > CACHE_BYTES:
                self.words.clear()
                self.held = 0
            self.words[word] = found
        return found

    def encode(self, text: str) -> Iterator[bytes]:
        """Ids of a whole text as little-endian unsigned 32-bit integers, in pieces."""
        get, miss = self.words.get, self._miss
        for part in self._parts(text):
            for i, run in enumerate(self.cut.split(part) if "<|" in part else (part,)):
                if i % 2:
                    yield self.special[run].to_bytes(4, "little")
                    continue
                words = self.split(run)
                if words:
                    yield b"".join([get(w) or miss(w) for w in words])

    def split(self, run: str) -> list[str]:
        """Normalised words of a text without special tokens.  Beyond U+017F, and for the one letter
        below whose lower case lies beyond, the library's own tables of normal forms and classes decide."""
        if _BEYOND.search(run) or "İ" in run:
            level = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(run))
            return [bytes(map(self.byte_of.__getitem__, w)).decode(errors="surrogateescape") for w, _ in level]
        return _FAST.findall(run.lower())

    @staticmethod
    def _parts(text: str) -> Iterator[str]:
        """Pieces of about CHUNK characters that end at white space, which no token crosses."""
        begin = 0
        while len(text) - begin > CHUNK:
            cut = _BREAK.search(text, begin + CHUNK)
            if cut is None:
                break
            yield text[begin : cut.start()]
            begin = cut.start()
        yield text[begin:] if begin else text


class Decoder:
    """Ids to text, piece by piece: the state is whether a token has been written, and so whether the
    next one is set off by a space (this vocabulary's word ends stay as they are written)."""

    def __init__(self, transducer: Transducer):
        self.out, self.begun = transducer.out, False

    def feed(self, ids: bytes) -> bytes:
        """UTF-8 text of some ids (whole 32-bit integers)."""
        out = self.out
        text = b" ".join([out[i] for i in memoryview(ids).cast("I")])
        if not ids:
            return b""
        text, self.begun = b" " + text if self.begun else text, True
        return text


@lru_cache(maxsize=4)
def transducer(path: str) -> Transducer:
    return Transducer(path)


def encode_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256[, ids array<int>]) of every row's whole text.

    A null or empty text has no tokens and the digests of nothing.  Special tokens written in a text are
    read as such.  Null keys and repeated rows are kept; other columns are not read.
    """
    bound_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = transducer(path)
        for batch in batches:
            counts, first, second, lists = [], [], [], []
            for value in batch.column(1):
                ids, plain, n, decoder, kept = hashlib.sha256(), hashlib.sha256(), 0, Decoder(coder), []
                for piece in coder.encode(value.as_py() or ""):
                    ids.update(piece)
                    plain.update(decoder.feed(piece))
                    n += len(piece) // 4
                    if with_ids:
                        kept.append(piece)
                counts.append(n)
                first.append(ids.hexdigest())
                second.append(plain.hexdigest())
                lists.append(np.frombuffer(b"".join(kept), "<i4"))
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())]
            if with_ids:
                columns.append(pa.array(lists, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names=["_key", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(columns)])

    schema = f"_key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    return spread(docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"))).mapInArrow(run, schema).withColumnRenamed("_key", key)
