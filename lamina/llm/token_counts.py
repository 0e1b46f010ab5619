"""Token counts of whole texts by overlap resynchronisation.

A text over ``CHUNK`` characters is encoded in chunks that overlap, each whole by the library and with offsets. Two
neighbouring encodings are spliced at a stable common boundary: an offset in the overlap where a token begins in both,
with ``RUN`` tokens of equal offsets and ids on either side. Such an offset is proven stable in two cases.

* A pre-token begins there in both. Pre-token patterns look only ahead, so the later encoding is right from there on
  and the earlier one up to there.
* The overlap lies within one pre-token in both (text without spaces, say). Byte-pair merges on either side of an
  offset that none of them crosses don't see the other side, and whether one crosses depends on the two tokens that meet
  there alone; as both encodings have the same two, none does in the whole text. Long pre-tokens must be runs of a
  class of characters, as in the patterns of the known tokenizers.

Boundaries within ``EDGE`` characters of a chunk's cut end aren't trusted (special strings, look-ahead), nor those
at which normalisation could compose characters. Where an overlap has no stable boundary it is doubled and the
chunk encoded anew, at the worst from the earlier chunk's begin and up to the text's end. Shorter texts are encoded whole.

Each different word goes to the library once where the tokenizer can't see across a space (``stands_apart``: spaces are removed before
merges, no normalisation, pre-token or special string reaches over one). Then the encoding of a text or chunk is that of its words, one
after the other, and a worker keeps the encodings of words. Other tokenizers encode texts and chunks in one call.

Memory: a batch of bounded bytes, the encodings of ``CALL`` bytes of short texts or of two chunks; twice ``KNOWN`` bytes of known words.
Defined results: a null or empty text has 0 bytes and 0 tokens; repeated rows each give a row; an
empty table gives no rows; columns besides ``id_col`` and ``text_col`` aren't read. Only BPE tokenizers are taken.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .storage import bounded_batches

#: Characters of a chunk, of the first overlap, and at a cut end that aren't trusted; tokens that must agree on either side.
CHUNK, OVERLAP, EDGE, RUN = 16_384, 1_024, 64, 4
#: Characters of short texts encoded in one call of the library.
CALL = 1 << 20
#: Words encoded in one call; bytes of words that are kept, after which all are forgotten.
WORDS, KNOWN = 1 << 13, 64 << 20
#: Bytes of a token in ``Encoder.pieces``: four numbers.
TOKEN = 4 * array("i").itemsize
#: A pattern of pre-tokens that matches no white space and looks at nothing beside a match.
WITHIN_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def stands_apart(spec: dict) -> bool:
    """Whether a tokenizer file is known to encode a text as its parts between spaces, one after the other."""
    normalizer, pre = spec["normalizer"] or {}, spec["pre_tokenizer"] or {}
    steps = normalizer.get("normalizers", [normalizer] if normalizer else [])
    allowed = ({"type": "NFC"}, {"type": "Lowercase"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "})
    split = {"type": "Split", "pattern": {"Regex": WITHIN_WORDS}, "behavior": "Removed", "invert": True}
    level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
    own = all(not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] or " " in t["content"]) for t in spec["added_tokens"])
    return own and all(x in allowed for x in steps) and pre.get("pretokenizers") == [split, level] and spec["post_processor"] is None and not spec["model"].get("dropout")


class Encoded:
    """A chunk's tokens: where each begins in the text, its id, whether a pre-token begins with it."""

    def __init__(self, start: np.ndarray, ids: np.ndarray, opens: np.ndarray, clean: np.ndarray):
        #: ``clean`` is False where a token begins inside a character that the one before it has begun.
        self.start, self.ids, self.opens, self.clean = start, ids, opens, clean

    def from_offset(self, at: int) -> int:
        """The first token that begins at ``at`` or later."""
        return int(np.searchsorted(self.start, at))


class Known:
    """What is known of words, up to about ``most`` bytes: ``find`` gives it for a list of new ones."""

    def __init__(self, find: Callable[[list[str]], list], most: int = KNOWN):
        self.find, self.most, self.held, self.words = find, most, 0, {}

    def of(self, words: list[str]) -> list:
        new = list(set(words).difference(self.words))
        if new:
            if self.held > self.most:
                self.held, self.words, new = 0, {}, list(set(words))
            for k in range(0, len(new), WORDS):
                some = new[k : k + WORDS]
                found = self.find(some)
                self.words.update(zip(some, found))
                self.held += sum(map(sys.getsizeof, some)) + sum(map(sys.getsizeof, found)) + 64 * len(some)
        return list(map(self.words.__getitem__, words))


class Encoder:
    """A tokenizer file's library, without special tokens, truncation or padding."""

    def __init__(self, tokenizer_file: str):
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        if not isinstance(self.tokenizer.model, BPE):
            raise ValueError("common boundaries are proven stable for byte-pair encoding only")
        self.apart = stands_apart(json.loads(self.tokenizer.to_str()))
        self.sizes, self.parts = Known(self.lengths), Known(self.pieces)

    def lengths(self, texts: list[str]) -> list[int]:
        return list(map(len, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)))

    def pieces(self, texts: list[str]) -> list[bytes]:
        """Of each text, for each token: begin, id, whether a pre-token begins with it, whether it begins behind the end of the one before."""
        out = []
        for found in self.tokenizer.encode_batch(texts, add_special_tokens=False):
            rows, last, reached = array("i"), None, 0
            for k, ((start, end), token, word) in enumerate(zip(found.offsets, found.ids, found.word_ids)):
                rows.extend((start, token, k == 0 or word is None or word != last, start >= reached))  # special strings stand alone
                last, reached = word, end
            out.append(rows.tobytes())
        return out

    def counts(self, texts: list[str]) -> list[int]:
        out, k = [], 0
        while k < len(texts):
            stop, n = k, 0
            while stop < len(texts) and (n == 0 or n + len(texts[stop]) <= CALL):
                n, stop = n + len(texts[stop]), stop + 1
            out += self.counts_of_words(texts[k:stop]) if self.apart else self.lengths(texts[k:stop])
            k = stop
        return out

    def counts_of_words(self, texts: list[str]) -> list[int]:
        words = [t.split(" ") for t in texts]
        sizes = iter(self.sizes.of([w for own in words for w in own]))
        return [sum(islice(sizes, len(own))) for own in words]

    def chunk(self, text: str, begin: int, end: int) -> Encoded:
        words = text[begin:end].split(" ") if self.apart else [text[begin:end]]
        pieces = self.parts.of(words) if self.apart else self.pieces(words)
        at = begin + np.cumsum([0] + [len(w) + 1 for w in words[:-1]])
        start, ids, opens, clean = np.frombuffer(b"".join(pieces), np.int32).reshape(-1, 4).T
        return Encoded(start + np.repeat(at, [len(p) // TOKEN for p in pieces]), ids, opens.astype(bool), clean.astype(bool))


@lru_cache(1)
def encoder(tokenizer_file: str) -> Encoder:
    """A worker's own, kept from task to task."""
    return Encoder(tokenizer_file)


def composes(text: str, at: int) -> bool:
    """Whether normalisation may join or reorder characters across ``at``."""
    a, b = text[at - 1], text[at]
    jamo = "ᅠ" <= b <= "ᇿ" or "ힰ" <= b <= "퟿"
    return jamo or unicodedata.category(b)[0] == "M" or unicodedata.normalize("NFC", a + b) != unicodedata.normalize("NFC", a) + unicodedata.normalize("NFC", b)


def seam(text: str, left: Encoded, right: Encoded, low: int, high: int, overlap: tuple[int, int]) -> tuple[int, int, bool] | None:
    """The token in ``left`` and in ``right`` with which a stable boundary from ``low`` to ``high`` begins, and whether it is within a pre-token."""
    i, j = (x.from_offset(low) + np.flatnonzero(x.clean[x.from_offset(low) : x.from_offset(high + 1)]) for x in (left, right))
    at, of_i, of_j = np.intersect1d(left.start[i], right.start[j], return_indices=True)
    i, j = i[of_i], j[of_j]
    good = (i >= RUN) & (j >= RUN) & (i + RUN <= len(left.ids)) & (j + RUN <= len(right.ids))
    at, i, j = at[good], i[good], j[good]
    same = np.ones(len(at), bool)
    for k in range(-RUN, RUN):
        same &= (left.ids[i + k] == right.ids[j + k]) & (left.start[i + k] == right.start[j + k])
    at, i, j = at[same], i[same], j[same]
    opens = left.opens[i] & right.opens[j]
    begin, end = overlap
    inside = any(x.opens[x.from_offset(begin + 1) : x.from_offset(end)].any() for x in (left, right))
    for k in np.flatnonzero(opens) if inside else range(len(at)):
        if not composes(text, int(at[k])):
            return int(i[k]), int(j[k]), not opens[k]
    return None


def resynchronised(text: str, encode: Encoder, chunk: int = CHUNK, overlap: int = OVERLAP, edge: int = EDGE) -> tuple[int, int, int, int]:
    """Tokens of ``text``, seams, those of them within a pre-token, and how often an overlap had to be widened."""
    total = seams = inner = widened = 0
    begin, end, first = 0, min(chunk, len(text)), 0  # ``first``: the token of ``left`` up to which ``total`` counts
    left = encode.chunk(text, begin, end)
    while end < len(text):
        counted = int(left.start[first]) if first < len(left.ids) else begin
        back = overlap
        while True:
            start = max(begin, end - back)
            stop = min(len(text), start + chunk + back)
            right = encode.chunk(text, start, stop)
            if start == begin:  # nothing lies before: lengthen the earlier chunk instead
                left, end = right, stop
                first = left.from_offset(counted)
                break
            found = seam(text, left, right, max(counted + 1, start + edge), end - edge, (start, end))
            if found:
                i, j, within = found
                total, seams, inner = total + i - first, seams + 1, inner + within
                begin, end, left, first = start, stop, right, j
                break
            widened += 1
            back *= 2
    return total + len(left.ids) - first, seams, inner, widened


def count_tokens(
    docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text",
    limit: int = 2048, chunk: int = CHUNK, overlap: int = OVERLAP, edge: int = EDGE,
) -> DataFrame:
    """``id_col``, n_bytes, n_tokens, over_limit, n_seams, n_inner (seams within a pre-token), n_widened for every row of ``docs``."""
    if not 2 * edge < overlap < chunk:
        raise ValueError("an overlap is shorter than a chunk and longer than both of its untrusted edges")
    bounded_batches(docs.sparkSession)
    key, names = docs.schema[id_col], ("n_seams", "n_inner", "n_widened")

    def of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = encoder(tokenizer_file)
        for batch in batches:
            sizes = [len(t.as_buffer()) if t.is_valid else 0 for t in batch.column(1)]
            texts = [t or "" for t in batch.column(1).to_pylist()]
            short = iter(encode.counts([t for t in texts if len(t) <= chunk]))
            rows = [(next(short), 0, 0, 0) if len(t) <= chunk else resynchronised(t, encode, chunk, overlap, edge) for t in texts]
            tokens, *others = zip(*rows) if rows else ((),) * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_()), *(pa.array(x, pa.int32()) for x in others)],
                names=[id_col, "n_bytes", "n_tokens", "over_limit", *names],
            )

    fields = [key, T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]
    return docs.select(id_col, text_col).mapInArrow(of_batches, T.StructType(fields + [T.StructField(n, T.IntegerType()) for n in names]))
