"""Quality rules: counts over the text, and how well a public vocabulary fits it.

Tokeniser fertility is measured over the words of each document by a public byte-fallback vocabulary: characters
per token, the share of byte-fallback tokens, and the entropy of the token distribution. A document whose script has a band
is rejected outside it.

Defined cases: a null or empty text has no words and fails the base rules; scripts without a band of their own take
``other``; a tie between scripts goes to the first in ``BANDS``; repeated rows are judged row by row; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .inputs import per_batch
from .textkernel import SPACE, chunks, covered, inside_document, long_column, mix, split_words, sum_by, window_hashes, byte_hashes
from .units import piece_bpe, tokenizer_file

U64 = np.uint64

#: Fixed bands per script: least and most characters per token, most byte-fallback share, least token entropy (bits).
#: Written text in an alphabet takes 1.5 to 6 characters a token; symbol noise falls below, padding runs above.
#: CJK text takes about one character a token, and rare characters go to bytes.
BANDS = {
    "latin": (1.3, 7.0, 0.05, 3.0),
    "greek": (0.8, 6.0, 0.2, 3.0),
    "cyrillic": (1.0, 6.0, 0.2, 3.0),
    "semitic": (0.5, 6.0, 0.5, 3.0),
    "indic": (0.3, 6.0, 0.9, 3.0),
    "cjk": (0.3, 3.0, 0.8, 3.0),
    "other": (0.2, 8.0, 1.0, 2.0),
}
SCRIPTS = list(BANDS)

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, script string, n_tokens long, chars_per_token double, byte_share double, token_entropy double"
)


def _script_of_lead() -> np.ndarray:
    """The script that the first byte of a character speaks for; -1 for none."""
    lead = np.full(256, -1, np.int8)
    for first, last, name in ((65, 90, "latin"), (97, 122, "latin"), (0xC3, 0xC9, "latin"), (0xCD, 0xCF, "greek"), (0xD0, 0xD3, "cyrillic"), (0xD6, 0xDB, "semitic"), (0xE0, 0xE0, "indic"), (0xE3, 0xED, "cjk"), (0xE1, 0xE2, "other"), (0xF0, 0xF4, "other")):
        lead[first : last + 1] = SCRIPTS.index(name)
    return lead


_LEAD = _script_of_lead()
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def _per_doc(flag: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flag, dtype=np.int64)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def dup_lines(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Lines with a word that equal an earlier line of their document."""
    n = len(offsets) - 1
    breaks = np.flatnonzero(data == 0x0A)
    begin = np.unique(np.concatenate([offsets[:-1], breaks + 1]))
    begin = begin[begin < len(data)]
    doc = np.searchsorted(offsets, begin, "right") - 1
    end = np.minimum(np.concatenate([begin[1:], [len(data)]]), offsets[doc + 1])
    end = end - ((end > begin) & (data[np.maximum(end - 1, 0)] == 0x0A))
    worded = np.searchsorted(starts, end) > np.searchsorted(starts, begin)
    begin, end, doc = begin[worded], end[worded], doc[worded]
    key = mix(byte_hashes(data, begin, end) + doc.astype(U64) * U64(0x9E3779B97F4A7C15))
    _, where = np.unique(key, return_index=True)
    return np.bincount(doc, minlength=n) - np.bincount(doc[where], minlength=n)


def repeat_words(hashes: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Words in runs of three words that a document has twice or more."""
    inside = np.flatnonzero(inside_document(doc, 3))
    key = mix(window_hashes(hashes, 3)[inside] + doc[inside].astype(U64) * U64(0x9E3779B97F4A7C15))
    _, back, count = np.unique(key, return_inverse=True, return_counts=True)
    hit = covered(inside[count[back] >= 2], 3, len(doc))
    return np.bincount(doc[hit], minlength=n)


def measure(data: np.ndarray, offsets: np.ndarray, vocabulary: str) -> dict[str, np.ndarray]:
    """All measures of the documents of a chunk."""
    n = len(offsets) - 1
    words = split_words(data, offsets)
    out = {"n_words": words.counts()}
    out["word_chars"] = _per_doc(((data & 0xC0) != 0x80) & ~SPACE[data], offsets)
    out["n_symbols"] = _per_doc(_SYMBOL[data], offsets)
    out["n_dup_lines"] = dup_lines(data, offsets, words.start)
    out["n_repeat_words"] = repeat_words(words.hashes(), words.doc, n)
    out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEAT_PERCENT * out["n_words"])
    script = _LEAD[data]
    counts = np.stack([_per_doc(script == i, offsets) for i in range(len(SCRIPTS))])
    dominant = np.where(counts.any(0), counts.argmax(0), SCRIPTS.index("other"))
    out["script"] = dominant
    cache, is_byte = piece_bpe(tokenizer_file(vocabulary))
    flat, size = cache.ids(cache.slots_of(data, words.start, words.end))
    doc = np.repeat(words.doc, size)
    tokens = np.bincount(doc, minlength=n)
    some = np.maximum(tokens, 1)
    out["n_tokens"] = tokens
    out["chars_per_token"] = out["word_chars"] / some
    out["byte_share"] = np.bincount(doc[is_byte[flat]], minlength=n) / some
    key, count = np.unique(doc.astype(np.int64) * len(is_byte) + flat, return_counts=True)
    share = count / some[key // len(is_byte)]
    out["token_entropy"] = np.maximum(0, -sum_by(share * np.log2(share), key // len(is_byte), n))
    low, high, byte, entropy = np.array(list(BANDS.values())).T[:, dominant]
    fits = (out["chars_per_token"] >= low) & (out["chars_per_token"] <= high) & (out["byte_share"] <= byte) & (out["token_entropy"] >= entropy)
    out["kept"] = ~out["base_failed"] & fits
    return out


def quality_rules(docs: DataFrame, vocabulary: str = "piece_bpe_32k.model", remember: bool = False) -> DataFrame:
    """The measures and the verdict of each row."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = [measure(data, offsets, vocabulary) for _, _, data, offsets in chunks(batch.column(1))]
        got = {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
        whole = lambda k: long_column(got[k])
        return pa.RecordBatch.from_pydict({
            "doc_id": batch.column(0), **{k: whole(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")},
            "base_failed": got["base_failed"], "kept": got["kept"], "script": pa.array([SCRIPTS[i] for i in got["script"]]), "n_tokens": whole("n_tokens"),
            **{k: got[k].astype(float) for k in ("chars_per_token", "byte_share", "token_entropy")},
        })

    return per_batch(docs.select(F.col("doc_id").cast("long"), "text"), work, SCHEMA, remember)


def filter_quality(docs: DataFrame, vocabulary: str = "piece_bpe_32k.model") -> DataFrame:
    """The rows that the rules keep, with all their columns."""
    at = docs.columns.index("text")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        kept = [measure(data, offsets, vocabulary)["kept"] for _, _, data, offsets in chunks(batch.column(at))]
        return batch.filter(pa.array(np.concatenate(kept)))

    return per_batch(docs, work, docs.schema)
