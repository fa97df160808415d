"""Benchmark decontamination by pigeonhole edit matching.

An item that occurs in a document with at most ``k`` edits leaves one of its ``k + 1`` pieces unedited.  The
pieces of a block of items form one Aho-Corasick automaton; each exact piece hit in a document's text names an
item and where it would begin, and Myers' bit-parallel distance, over the text around there, decides.  Items
are taken in blocks of bounded size, each against all documents, so nothing that is broadcast grows with them.

Texts are compared in lower case with each run of anything but letters and digits as one blank.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegrain.sources.workspace import spread

from .common import bound_batches, stage

#: Edits allowed, as a share of an item's normalised length, and the length below which none are.
EDIT_SHARE = 0.05
EXACT_BELOW = 40
#: Words that an item has at least; what is shorter occurs in clean text too.
LEAST_WORDS = 2
BLOCK_ITEMS = 10_000
_GAP = re.compile(r"[\W_]+")
CHUNK = 1 << 20


def normalise(text: str | None) -> str:
    """Lower case, blanks between words and at both ends; '' for a text without letters and digits."""
    flat = _GAP.sub(" ", (text or "").lower()).strip()
    return f" {flat} " if flat else ""


def budget(length: int, share: float = EDIT_SHARE) -> int:
    return int(length * share) if length >= EXACT_BELOW else 0


def cut(item: str, edits: int) -> list[tuple[int, str]]:
    """The item as ``edits + 1`` pieces of near-equal length, with their offsets."""
    n = edits + 1
    at = [len(item) * i // n for i in range(n + 1)]
    return [(at[i], item[at[i] : at[i + 1]]) for i in range(n)]


def masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def myers(pattern: str, text: str, most: int, peq: dict[str, int] | None = None) -> tuple[int, int] | None:
    """(distance, end) of the best match of ``pattern`` anywhere in ``text``, the first of equals, if its edit
    distance is at most ``most``.  Each column of the dynamic program is a few operations on integers
    as wide as the pattern."""
    m = len(pattern)
    peq = masks(pattern) if peq is None else peq
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, None
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (~(xh | pv) & full), pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv, mv = mh | (~(xv | ph) & full), ph & xv
        if score <= most and (best is None or score < best[0]):
            best = (score, j + 1)
            if not score:
                break
    return best


def _covered(begins: list[int], stops: list[int], begin: int, stop: int) -> bool:
    """Whether one of the ranges holds [begin, stop); both ends of the ranges rise."""
    at = bisect_right(begins, begin) - 1
    return at >= 0 and stops[at] >= stop


def _enter(begins: list[int], stops: list[int], begin: int, stop: int) -> None:
    """Put a range in its place, in place of those that it holds."""
    at = bisect_right(begins, begin)
    if at and begins[at - 1] == begin:
        at -= 1
    end = at
    while end < len(begins) and stops[end] <= stop:
        end += 1
    begins[at:end], stops[at:end] = [begin], [stop]


class Matcher:
    """A block of items: (item ids, normalised text) with equal texts together."""

    def __init__(self, items: Sequence[tuple[tuple[int | None, ...], str]], share: float = EDIT_SHARE):
        self.items = [(ids, text, budget(len(text), share)) for ids, text in items]
        self.peq: dict[int, dict[str, int]] = {}
        found: dict[str, list[tuple[int, int]]] = {}
        for i, (_, text, edits) in enumerate(self.items):
            for at, piece in cut(text, edits):
                found.setdefault(piece, []).append((i, at))
        self.automaton = ahocorasick.Automaton()
        for piece, places in found.items():
            self.automaton.add_word(piece, (len(piece), tuple(places)))
        if found:
            self.automaton.make_automaton()
        self.reach = max((len(t) + 2 * k for _, t, k in self.items), default=0)

    def find(self, text: str, first: bool = False) -> dict[int, tuple[int, int]]:
        """Item number: (distance, end) of its best match in a normalised text; with ``first``, of any one item."""
        best: dict[int, tuple[int, int]] = {}
        if not self.items or not text:
            return best
        tried: dict[int, tuple[list[int], list[int]]] = {}
        for end, (size, places) in self.automaton.iter(text):
            for i, at in places:
                _, item, edits = self.items[i]
                if i in best and best[i][0] == 0:
                    continue
                begin = max(0, end + 1 - size - at - edits)
                stop = min(len(text), end + 1 - size - at + len(item) + edits)
                done = tried.setdefault(i, ([], []))
                if _covered(*done, begin, stop):
                    continue
                # a little wider, so the hits of neighbouring pieces share one verification
                begin, stop = max(0, begin - edits), min(len(text), stop + edits)
                _enter(*done, begin, stop)
                if i not in self.peq:
                    self.peq[i] = masks(item)
                got = myers(item, text[begin:stop], edits, self.peq[i])
                if got and (i not in best or got[0] < best[i][0]):
                    best[i] = (got[0], begin + got[1])
                    if first:
                        return best
        return best


def short_items(benchmark: DataFrame, item_key: str = "item_id", item_text: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """(item_key, item_text, words) of the items with fewer than ``least_words`` words, which are not searched for; a
    null text has none."""
    flat = F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(item_text).cast("string"), F.lit(""))), r"(?U)[\W_]+", " "))
    words = F.when(flat == "", 0).otherwise(F.size(F.split(flat, " ")))
    return benchmark.select(F.col(item_key).alias(item_key), F.col(item_text).alias(item_text), words.alias("words")).where(F.col("words") < least_words)


def _blocks(benchmark: DataFrame, item_key: str, item_text: str, block_items: int, least_words: int) -> Iterator[Broadcast]:
    """The items, (ids, normalised text) with equal texts together, in broadcast blocks of about ``block_items``."""
    spark = benchmark.sparkSession
    asked = stage(benchmark.select(F.col(item_key).cast("long").alias("id"), F.col(item_text).cast("string").alias("t")).where("t is not null"), "items")
    blocks = max(1, -(-asked.count() // block_items))
    for n in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("t"), F.lit(blocks)) == n) if blocks > 1 else asked
        groups: dict[str, list[int | None]] = {}
        for r in block.toLocalIterator():
            if len((flat := normalise(r["t"])).split()) >= max(1, least_words):
                groups.setdefault(flat, []).append(r["id"])
        yield spark.sparkContext.broadcast([(tuple(v), k) for k, v in sorted(groups.items())])


def find_contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", share: float = EDIT_SHARE, block_items: int = BLOCK_ITEMS, least_words: int = LEAST_WORDS) -> DataFrame:
    """(key, item_id, distance int, match_end long) for each document and benchmark item that occurs in it
    within the item's edit budget; ``match_end`` is a position in the normalised text.

    Null and empty texts, on either side, match nothing.  Items of under 40 normalised characters must occur
    exactly, between word ends; items of under ``least_words`` words are left out (:func:`short_items` lists them).  Items with equal texts each give a row, as do repeated documents; null keys
    and ids stay null.  Other columns are not read.
    """
    bound_batches(docs.sparkSession)
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    schema = f"_key {kind}, item_id long, distance int, match_end long"
    rows = spread(docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text")))
    out = None
    for sent in _blocks(benchmark, item_key, item_text, block_items, least_words):

        def match(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(sent.value, share)
            for b in batches:
                found = []
                for i, t in enumerate(b.column(1)):
                    for item, (distance, end) in matcher.find(normalise(t.as_py())).items():
                        found += [(i, x, distance, end) for x in matcher.items[item][0]]
                if found:
                    at, ids, far, end = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(ids, pa.int64()), pa.array(far, pa.int32()), pa.array(end, pa.int64())], names=["_key", "item_id", "distance", "match_end"])

        part = rows.mapInArrow(match, schema)
        out = part if out is None else out.unionByName(part)
    return out.withColumnRenamed("_key", key)


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", share: float = EDIT_SHARE, block_items: int = BLOCK_ITEMS, least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark item within its edit budget.

    Each row is judged by its own text, so rows that share a key, or have none, do not fall with one another; null and
    empty texts stay, and an empty benchmark takes nothing, nor do items of under ``least_words`` words.  All columns are kept as they are."""
    bound_batches(docs.sparkSession)
    columns, at = docs.columns, docs.columns.index(text)
    names = [f"c{i}" for i in range(len(columns))]
    typed = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.schema, strict=True))
    kept = spread(docs).toDF(*names)
    for sent in _blocks(benchmark, item_key, item_text, block_items, least_words):

        def clean(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(sent.value, share)
            for b in batches:
                yield b.filter(pa.array([not matcher.find(normalise(t.as_py()), first=True) for t in b.column(at)], pa.bool_()))

        kept = kept.mapInArrow(clean, typed)
    return kept.toDF(*columns)
