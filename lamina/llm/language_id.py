"""Language identification with a bit-sliced Bloom filter of n-grams.

The filter has slots of one bit for each language; an n-gram sets its language's bit in ``HASHES`` slots.
One lookup, the AND of those slots, returns all languages that contain the n-gram. A text's
n-grams (``GRAM`` bytes of its lower-cased letters, words apart by one space) are looked up, each language's hits
counted, and corrected for the share of hits that its fill rate gives by chance: h' = (h / n - f) / (1 - f),
f = fill ** HASHES. The language with the largest h' is predicted; the score is its share of all h'.

Every n-gram of every training text is in the filter. Spark gathers the different ones of each language and sets their
bits in blocks of slots, so the driver and the workers hold the filter only. It has ``SLOTS_A_GRAM`` slots for
each n-gram of the largest language. Where these are more than ``FILTER_BYTES``, n-grams are dealt by a hash to as many filters of that size as it
takes, and texts pass by one after the other, adding up corrected hits: a worker and the driver hold one filter at a time, and none
fills up however large the corpus is. The bound is of memory; it changes no prediction but by chance hits.
Defined results: null texts and those without a letter are ``und`` with score 0, as is everything if nothing
was learned; a text with letters but no known n-gram gets the language with most training text, score 0; ties go to
the language with more training text, then the one first by code points; a null id counts as the empty text in the split;
rows without a language don't teach; repeated rows are predicted each; an empty table gives no rows; extra columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import dropped, written

HASHES, GRAM, SLOTS_A_GRAM, FILTER_BYTES = 3, 5, 16, 128 << 20
#: Slots of a block, N-grams handled at a time, and different ones that a worker holds of a language.
BLOCK, STEP, HELD = 1 << 14, 1 << 21, 1 << 20
UNDETERMINED = "und"
_KEEP = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256))
# Odd factors of multiplicative hashing, fixed.
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_PART = np.uint64(0xD6E8FEB86659FD93)


def letters(text: str) -> bytes:
    """Lower case, ASCII other than letters as spaces, one space around each word."""
    return b" " + b" ".join(text.lower().encode().translate(_KEEP).split()) + b" "


def steps(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """N-grams of ``texts`` as integers with the number of their text, in steps of bounded size."""
    held, numbers, n = [], [], 0
    for k, text in enumerate(texts):
        for at in range(0, max(1, len(text) - GRAM + 1), STEP):
            part = text[at : at + STEP + GRAM - 1]
            if len(part) >= GRAM:
                held.append(part)
                numbers.append(k)
                n += len(part)
            if n >= STEP:
                yield grams(held, numbers)
                held, numbers, n = [], [], 0
    if held:
        yield grams(held, numbers)


def grams(held: list[bytes], numbers: list[int]) -> tuple[np.ndarray, np.ndarray]:
    b = np.frombuffer(b"".join(held), np.uint8).astype(np.int64)
    value = sum(b[j : len(b) - GRAM + 1 + j] << 8 * j for j in range(GRAM))
    lengths = np.array([len(x) for x in held])
    keep = np.ones(len(b), bool)
    ends = np.cumsum(lengths)
    for j in range(1, GRAM):
        keep[ends - j] = False
    return value[keep[: len(value)]], np.repeat(numbers, lengths - GRAM + 1)


def slots(value: np.ndarray, n: int) -> list[np.ndarray]:
    """The slots of each n-gram in a filter of ``n`` (a power of two)."""
    return [(value.astype(np.uint64) * f >> np.uint64(64 - (n.bit_length() - 1))).astype(np.int64) for f in _FACTORS[:HASHES]]


def plane_kind(languages: int) -> np.dtype:
    """The narrowest word with a bit for each language; over 64 languages have a plane for each 64."""
    return np.dtype(next(k for n, k in ((8, np.uint8), (16, np.uint16), (32, np.uint32), (10**9, np.uint64)) if languages <= n))


def filter_slots(languages: int, largest: int) -> tuple[int, int]:
    """Slots of a filter and the number of filters, powers of two: ``SLOTS_A_GRAM`` for each n-gram of the largest language, ``FILTER_BYTES`` in a filter."""
    most = FILTER_BYTES // (-(-languages // 64) * plane_kind(languages).itemsize) if languages else BLOCK
    n, parts = BLOCK, 1
    while n * parts < SLOTS_A_GRAM * largest:
        n, parts = (2 * n, parts) if 2 * n <= most else (n, 2 * parts)
    return n, parts


def part_of(value: np.ndarray, parts: int) -> np.ndarray:
    """The filter that has an n-gram, of ``parts`` (a power of two)."""
    return (value.astype(np.uint64) * _PART >> np.uint64(32)).astype(np.int64) & (parts - 1)


class LanguageFilter:
    """``planes``: for each 64 languages a word for every slot; ``sizes``: training n-grams by language. One of ``parts`` has the n-grams dealt to ``part``."""

    def __init__(self, languages: list[str], planes: np.ndarray, sizes: list[int], part: int = 0, parts: int = 1):
        self.languages, self.planes, self.sizes, self.part, self.parts = languages, planes, np.array(sizes), part, parts
        self.n_slots = planes.shape[1]
        bit = lambda k: planes.dtype.type(1 << k % 64)
        fill = [np.count_nonzero(planes[k // 64] & bit(k)) / self.n_slots for k in range(len(languages))]
        self.chance = np.array(fill) ** HASHES

    def hits(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """By text the hits of each language less those by chance, and the number of n-grams, of those that this filter has."""
        hits, n = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        for value, number in steps(texts):
            if self.parts > 1:
                own = part_of(value, self.parts) == self.part
                value, number = value[own], number[own]
            n += np.bincount(number, minlength=len(texts))
            where = slots(value, self.n_slots)
            for p, plane in enumerate(self.planes):
                all_of = plane[where[0]]
                for s in where[1:]:
                    all_of &= plane[s]
                for k in range(64 * p, min(len(self.languages), 64 * p + 64)):
                    of = number[(all_of >> plane.dtype.type(k % 64) & plane.dtype.type(1)).astype(bool)]
                    hits[:, k] += np.bincount(of, minlength=len(texts))
        return (hits - self.chance * n[:, None]) / np.maximum(1 - self.chance, 1e-9), n

    def decided(self, texts: list[str | None], hits: np.ndarray, n: np.ndarray) -> tuple[list[str], list[float], list[dict[str, float]]]:
        """The language, its score, and the share of n-grams that each language has, by text."""
        rate = np.clip(hits / np.maximum(n, 1)[:, None], 0, 1)
        names, scores, rates = [], [], []
        for k, text in enumerate(texts):
            total = rate[k].sum()
            rates.append(dict(zip(self.languages, rate[k].tolist())))
            if not text or not self.languages or not any(map(str.isalpha, text)):
                names.append(UNDETERMINED)
                scores.append(0.0)
            else:
                best = max(range(len(self.languages)), key=lambda j: (rate[k, j], self.sizes[j], -j))
                names.append(self.languages[best])
                scores.append(float(rate[k, best] / total) if total else 0.0)
        return names, scores, rates

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[dict[str, float]]]:
        return self.decided(texts, *self.hits([letters(t or "") for t in texts]))


class Known:
    """What was learned: the n-grams of each language, from which filters are made one at a time."""

    def __init__(self, languages: list[str], sizes: list[int], counts: DataFrame, n_slots: int, parts: int):
        self.languages, self.sizes, self.counts, self.n_slots, self.parts = languages, sizes, counts, n_slots, parts

    def filters(self) -> Iterator[LanguageFilter]:
        kind = plane_kind(len(self.languages))
        for part in range(self.parts):
            planes = np.zeros((max(1, -(-len(self.languages) // 64)), self.n_slots), kind)
            if any(self.sizes):
                for r in filter_blocks(self.counts, self.languages, self.n_slots, part, self.parts).toArrow().to_pylist():
                    planes[r["plane"], r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(r["words"], kind)
            yield LanguageFilter(self.languages, planes, self.sizes, part, self.parts)


def gram_counts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """lang, gram, n over all of ``docs``."""

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            by_lang: dict[str, list[bytes]] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by_lang.setdefault(lang, []).append(letters(text or ""))
            for lang, texts in by_lang.items():
                for value, _ in steps(texts):
                    held.setdefault(lang, []).append(np.unique(value, return_counts=True))
                    if len(held[lang]) >= 8:
                        held[lang] = [merged(held[lang])]
                        if len(held[lang][0][0]) > HELD:
                            yield of_counts(lang, *held.pop(lang)[0])
        for lang, parts in held.items():
            yield of_counts(lang, *merged(parts))

    return docs.select(text_col, lang_col).mapInArrow(of_batches, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def of_counts(lang: str, value: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([lang] * len(value), pa.string()), pa.array(value, pa.int64()), pa.array(n, pa.int64())], names=["lang", "gram", "n"])


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    value, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return value, np.bincount(where, np.concatenate([p[1] for p in parts])).astype(np.int64)


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Known:
    """What all labelled texts of ``docs`` teach."""
    labelled = docs.filter(F.col(lang_col).isNotNull())
    counts = written(gram_counts(labelled, text_col, lang_col), "language-grams")
    known = {r["lang"]: r for r in counts.groupBy("lang").agg(F.sum("n").alias("size"), F.count("*").alias("grams")).collect()}
    languages = sorted({r[0] for r in labelled.select(lang_col).distinct().collect()})  # a row for each language, some without an n-gram
    sizes = [known[x]["size"] if x in known else 0 for x in languages]
    return Known(languages, sizes, counts, *filter_slots(len(languages), max((r["grams"] for r in known.values()), default=0)))


def filter_blocks(counts: DataFrame, languages: list[str], n: int, part: int = 0, parts: int = 1) -> DataFrame:
    """plane, block, words: the filter's blocks of ``BLOCK`` slots that have a bit set."""
    number, kind = {x: k for k, x in enumerate(languages)}, plane_kind(len(languages))

    def of_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, value = np.array([number[x] for x in batch.column(0).to_pylist()], np.int32), batch.column(1).to_numpy()
            if parts > 1:
                here = part_of(value, parts) == part
                own, value = own[here], value[here]
            for slot in slots(value, n):
                yield pa.RecordBatch.from_arrays([pa.array((own // 64).astype(np.int32)), pa.array((slot // BLOCK).astype(np.int32)), pa.array((slot % BLOCK).astype(np.int32)), pa.array(own % 64)], names=["plane", "block", "slot", "bit"])

    def of_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, words = None, np.zeros(BLOCK, kind)
        for batch in batches:
            plane, block, slot, bit = (batch.column(k).to_numpy() for k in range(4))
            at = np.flatnonzero(np.append(True, (plane[1:] != plane[:-1]) | (block[1:] != block[:-1]))[: len(plane)])
            for a, b in zip(at.tolist(), [*at[1:].tolist(), len(plane)]):
                if of not in (None, (int(plane[a]), int(block[a]))):
                    yield of_block(*of, words)
                    words = np.zeros(BLOCK, kind)
                of = int(plane[a]), int(block[a])
                np.bitwise_or.at(words, slot[a:b], kind.type(1) << bit[a:b].astype(kind))
        if of is not None:
            yield of_block(*of, words)

    bits = counts.select("lang", "gram").mapInArrow(of_grams, "plane int, block int, slot int, bit int")
    return bits.repartition("plane", "block").sortWithinPartitions("plane", "block").mapInArrow(of_blocks, "plane int, block int, words binary")


def of_block(plane: int, block: int, words: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([plane], pa.int32()), pa.array([block], pa.int32()), pa.array([words.tobytes()], pa.binary())], names=["plane", "block", "words"])


def identify(docs: DataFrame, known: Known, text_col: str = "text", keep: tuple[str | Column, ...] = (), names: tuple[str, ...] = ("lang_pred", "score")) -> DataFrame:
    """``keep``, the predicted language and score and, if ``names`` has a third one, the share of n-grams by language, for every row of ``docs``.

    Columns of ``keep`` with one of these names give way to the result.
    """
    kept = docs.select(*keep).columns
    rows = docs.select(*(F.col(c) if isinstance(c, str) else c for c in keep), F.col(text_col).alias("text of the row"))
    rows = rows.toDF(*(f"keep {k}" for k in range(len(kept))), "text of the row")
    held = [T.StructField("hits", T.ArrayType(T.DoubleType())), T.StructField("n", T.DoubleType())]
    result = [T.StructField(n, k) for n, k in zip(names, (T.StringType(), T.DoubleType(), T.MapType(T.StringType(), T.DoubleType())))]
    whole = T.StructType(rows.schema.fields[:-1] + result)
    counts = T.StructType(rows.schema.fields + held)
    kinds = (pa.string(), pa.float64(), pa.map_(pa.string(), pa.float64()))

    def passing(shared, first: bool, last: bool):
        def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own, at = shared.value, rows_width
                texts = batch.column(at - 1).to_pylist()
                hits, n = own.hits([letters(t or "") for t in texts])
                if not first:
                    hits += np.array(batch.column(at).to_pylist(), float).reshape(hits.shape)
                    n += batch.column(at + 1).to_numpy()
                if last:
                    found = own.decided(texts, hits, n)
                    new = [pa.array([list(x.items()) for x in column] if k == 2 else column, kinds[k]) for k, column in enumerate(found[: len(names)])]
                    yield pa.RecordBatch.from_arrays([*batch.columns[: at - 1], *new], names=whole.names)
                else:
                    yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(hits.tolist(), pa.list_(pa.float64())), pa.array(n)], names=counts.names)

        return of_batches

    rows_width, context, before = len(rows.columns), docs.sparkSession.sparkContext, None
    for part, own in enumerate(known.filters()):
        first, last = part == 0, part == known.parts - 1
        shared = context.broadcast(own)
        if last:
            rows = rows.mapInArrow(passing(shared, first, last), whole)
        else:
            rows = written(rows.mapInArrow(passing(shared, first, last), counts), "language-pass")
            shared.destroy()
            if before is not None:
                dropped(before)
            before = rows
    return rows.select(*(F.col(f"keep {k}").alias(c) for k, c in enumerate(kept) if c not in names), *names)
