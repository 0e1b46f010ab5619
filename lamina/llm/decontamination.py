"""Benchmark decontamination: windows of normalised benchmark words in a broadcast hash set, sought in all texts.

Words are runs of digits, a-z (A-Z lower-cased) and bytes above 0x7F. An item's windows are its runs of ``WINDOW``
consecutive words, or all of them if it has fewer. Each task turns a text's words into numbers (0 for a word that
no item has), hashes only the positions where a whole window is of known words, looks the hashes up in the set, and
verifies each hit word by word. Hits can be reported, removed as spans, or remove their document.

The set is broadcast in blocks of at most ``BLOCK`` windows of ``WINDOW`` words: a benchmark of any size is sought block by
block, every block against all texts, and the hits united; one block is the usual case.
Defined results: null texts and texts without words have no words, no hits; null item texts and items without
words have no windows; items with the same id count once and those without an id aren't named but their windows
hit; overlapping windows hit each word once; an empty table on either side gives rows without hits; repeated rows
are scanned each; extra columns aren't read, or pass through ``keep``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import dropped, written

WINDOW, BLOCK = 10, 200_000
#: Broadcast bound of a window's text in bytes; a longer one counts for as many windows as it fills.
WINDOW_BYTES = 256
_WORDS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


class WindowSet:
    """Hash set of windows of word numbers, by window length."""

    def __init__(self, windows: dict[tuple[bytes, ...], set[str]]):
        self.number: dict[bytes, int] = {}
        for w in windows:
            for x in w:
                self.number.setdefault(x, len(self.number) + 1)
        by_length: dict[int, dict[int, list[tuple[tuple[int, ...], set[str]]]]] = {}
        for w, items in windows.items():
            ids = tuple(self.number[x] for x in w)
            by_length.setdefault(len(w), {}).setdefault(int(self.hashes(np.array(ids), len(w))[0]), []).append((ids, items))
        self.lengths = [(n, table, np.sort(np.array(list(table), np.uint64))) for n, table in sorted(by_length.items())]

    @staticmethod
    def hashes(ids: np.ndarray, n: int) -> np.ndarray:
        """A hash for each run of ``n`` numbers."""
        out = np.zeros(len(ids) - n + 1, np.uint64)
        for k in range(n):
            out = (out ^ ids[k : len(ids) - n + 1 + k].astype(np.uint64)) * _BASE
            out ^= out >> np.uint64(29)
        return out

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """(first word, number of words) of each window met, and the items that have it."""
        spans, items = [], set()
        ids = np.array([self.number.get(w, 0) for w in words], np.int64)
        known = np.concatenate(([0], np.cumsum(ids != 0)))
        for n, table, sorted_hashes in self.lengths:
            if len(ids) < n:
                break
            at = np.flatnonzero(known[n:] - known[:-n] == n)
            if not len(at):
                continue
            runs = np.split(at, np.flatnonzero(np.diff(at) > 1) + 1)
            for run in runs:
                h = self.hashes(ids[run[0] : run[-1] + n], n)
                where = np.minimum(np.searchsorted(sorted_hashes, h), len(sorted_hashes) - 1)
                for k in np.flatnonzero(sorted_hashes[where] == h).tolist():
                    first = int(run[0]) + k
                    for own, of in table[int(h[k])]:
                        if tuple(ids[first : first + n].tolist()) == own:
                            spans.append((first, n))
                            items |= of
        return spans, items


def item_windows(text: bytes, window: int) -> set[tuple[bytes, ...]]:
    words = words_of(text)
    if not words:
        return set()
    return {tuple(words[k : k + window]) for k in range(max(1, len(words) - window + 1))}


def window_sets(benchmark: DataFrame, id_col: str, text_col: str, window: int, block: int) -> Iterator[WindowSet]:
    """Sets of at most ``block`` windows; the driver holds one at a time."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(item, b" ".join(w)) for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for w in item_windows((text or "").encode(), window)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], names=["item", "window"])

    rows = benchmark.select(F.col(id_col).cast("string"), text_col).mapInArrow(of_batches, "item string, window binary").distinct()
    held: dict[tuple[bytes, ...], set[str]] = {}
    filled = 0
    for r in rows.toLocalIterator():
        key = tuple(bytes(r["window"]).split(b" "))
        if key not in held and filled >= block:
            yield WindowSet(held)
            held, filled = {}, 0
        filled += 1 + len(r["window"]) // WINDOW_BYTES
        held.setdefault(key, set()).update([r["item"]] if r["item"] is not None else [])
    yield WindowSet(held)


def scan(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", keep: tuple[str, ...] = (), window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """``keep`` and _scan_text, _scan_words, _scan_spans (first word and number of words of united hits), _scan_items of every row."""
    shown = docs.select(*keep, F.col(text_col).alias("_scan_text"), F.lit(None).cast("bigint").alias("_scan_words"), F.lit(None).cast("array<struct<first:int,n:int>>").alias("_scan_spans"), F.lit(None).cast("array<string>").alias("_scan_items"))
    return in_passes(shown, window_sets(benchmark, item_id, item_text, window, block), scanner)


def in_passes(rows: DataFrame, parts: Iterable, function: Callable) -> DataFrame:
    """``rows`` changed by ``function`` of each of ``parts`` in turn: a job for each, so that a worker holds one part at a time. The last one runs with the result."""
    context, held = rows.sparkSession.sparkContext, None
    for part, is_last in with_last(parts):
        shared = context.broadcast(part)
        out = rows.mapInArrow(function(shared), rows.schema)
        if not is_last:
            out = written(out, "pass")
            shared.destroy()
        if held is not None and not is_last:
            dropped(held)
        rows, held = out, out
    return rows


def with_last(parts: Iterable) -> Iterator[tuple]:
    """Each of ``parts`` and whether it is the last."""
    none = before = object()
    for part in parts:
        if before is not none:
            yield before, False
        before = part
    if before is not none:
        yield before, True


def scanner(shared):
    kind = pa.list_(pa.struct([("first", pa.int32()), ("n", pa.int32())]))

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, all_spans, all_items = [], [], []
            for text, spans, items in zip(batch.column(batch.num_columns - 4), batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                words = words_of(text.as_buffer().to_pybytes()) if text.is_valid else []
                found, of = shared.value.find(words)
                n_words.append(len(words))
                all_spans.append(united(found + [(s["first"], s["n"]) for s in spans or ()]))
                all_items.append(sorted(of | set(items or ())))
            new = [pa.array(n_words, pa.int64()), pa.array([[{"first": a, "n": n} for a, n in s] for s in all_spans], kind), pa.array(all_items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-3], *new], names=batch.schema.names)

    return of_batches


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and adjacent spans as one."""
    out: list[tuple[int, int]] = []
    for first, n in sorted(spans):
        if out and first <= out[-1][0] + out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], first + n - out[-1][0]))
        else:
            out.append((first, n))
    return out


def without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of ``spans`` and what stands between them."""
    import re

    words = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]
    out, at = [], 0
    for first, n in spans:
        out.append(text[at : words[first][0]])
        at = words[first + n - 1][1]
    return "".join(out) + text[at:]


def report(scanned: DataFrame, *keep: str) -> DataFrame:
    """``keep``, n_words, n_hit, n_items, items_sha256, contaminated."""
    n_hit = F.expr("aggregate(_scan_spans, 0L, (n, s) -> n + s.n)")
    return scanned.select(*keep, F.col("_scan_words").alias("n_words"), n_hit.alias("n_hit"), F.size("_scan_items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "_scan_items"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def remove_documents(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """Rows of ``docs`` in which no window occurs; a row is carried as one value, so its columns may have any names."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(text_col).alias("body"))
    return scan(rows, benchmark, text_col="body", keep=("row",), **options).filter(F.size("_scan_spans") == 0).select("row.*")


def remove_spans(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``docs`` with hit words cut out of ``text_col``; columns as in ``remove_documents``."""
    cut = F.udf(lambda text, spans: without_spans(text, [(s["first"], s["n"]) for s in spans]) if spans else text, "string", useArrow=True)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(text_col).alias("body"))
    marked = scan(rows, benchmark, text_col="body", keep=("row",), **options).withColumn("_scan_cut", cut("_scan_text", "_scan_spans"))
    return marked.select(*(F.col("_scan_cut").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns))
